"""Faceted views, search, sorts and KPIs over evaluated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.text import strip_accents

CUT = 30
NOVEL = ("novo", "atualizado", "nova_edicao")
#: Fixed weights of the novelty order.
NOVELTY_WEIGHT = {"atualizado": 4, "nova_edicao": 3, "novo": 2, "inicial": 1}


def recommended() -> Column:
    return (F.col("status") == "aberto") & (F.coalesce("priority", F.lit(0.0)) >= CUT)


def view(df: DataFrame, name: str, favourites: DataFrame | None = None) -> DataFrame:
    tests = {
        "recommended": recommended(),
        "open": F.col("status") == "aberto",
        "check": F.col("status") == "verificar",
        "new": F.col("novelty").isin(*NOVEL) if "novelty" in df.columns else F.lit(False),
        "history": F.lit(True),
    }
    if name == "saved":
        return df.join(favourites, "url", "left_semi")
    return df.filter(tests[name])


def facets(df: DataFrame, region: str | None = None, eligibility: str | None = None, themes=(), search: str = "", searched=()) -> DataFrame:
    """Filters that are set; themes match if any does, the search ignores accents and case."""
    if region:
        df = df.filter(F.col("region") == region)
    if eligibility == "individual":
        df = df.filter(F.col("eligibility") == "via_individual")
    elif eligibility == "unblocked":
        df = df.filter(F.col("eligibility") != "restricao_conhecida")
    if themes:
        df = df.filter(F.arrays_overlap("themes", F.array(*map(F.lit, themes))))
    if search:
        text = F.lower(strip_accents(F.concat_ws(" ", *searched)))
        df = df.filter(F.contains(text, F.lower(strip_accents(F.lit(search)))))
    return df


def order(name: str) -> list[Column]:
    weights = F.create_map(*[F.lit(x) for p in NOVELTY_WEIGHT.items() for x in p])
    novel = F.coalesce(F.try_element_at(weights, F.col("novelty")), F.lit(0)).desc()
    by_priority = F.coalesce("priority", F.lit(0.0)).desc()
    if name == "deadline":
        return [F.when(F.col("status") == "aberto", F.coalesce("days_left", F.lit(999999))).otherwise(999999).asc(), by_priority]
    if name == "recent":
        return [F.col("first_seen").desc_nulls_last(), novel]
    if name == "default":
        return [(F.col("status") == "aberto").desc(), by_priority, F.coalesce("days_left", F.lit(99999)).asc()]
    return [by_priority, novel, F.coalesce("days_left", F.lit(999999)).asc()]


def kpis(df: DataFrame) -> DataFrame:
    """One pass, one row."""
    live = F.col("status") == "aberto"
    return df.agg(
        F.count_if(live).alias("n_open"), F.count_if(recommended()).alias("n_recommended"), F.count_if(live & F.col("days_left").between(0, 14)).alias("n_urgent"), F.count_if(F.col("status") == "verificar").alias("n_check"), F.count("*").alias("n_total")
    )


def panel_json(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows as JSON lines fit for a script element, in panel order; a partitioned sink, not one driver string."""
    return df.orderBy(*keys).select(F.replace(F.to_json(F.struct(*df.columns)), F.lit("</"), F.lit("<\\/")).alias("value"))


#: Shown names of the panel's codes.
LABELS = {
    "region": {"es": "Espírito Santo", "nacional": "Brasil", "internacional": "Exterior"},
    "status": {"aberto": "Aberto confirmado", "verificar": "Prazo a verificar", "futuro": "Ainda não abriu", "resultado": "Resultado", "retificacao": "Retificação", "encerrado": "Encerrado"},
    "eligibility": {"via_individual": "Candidatura individual", "restricao_conhecida": "Restrição conhecida", "verificar": "Verificar exigências", "sem_catalogo": "Elegibilidade não catalogada"},
    "novelty": {"novo": "Novo", "atualizado": "Atualizado", "nova_edicao": "Nova edição", "inicial": "Acervo inicial"},
}


def label(kind: str, code: Column) -> Column:
    """The shown name of a code; an unknown code shows itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS[kind].items() for x in p]), code), code)


def is_new(first_seen: Column, as_of: Column, days: int = 7) -> Column:
    """First seen within the last ``days`` days; unknown times are not new."""
    return F.coalesce(first_seen >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def active_filters(view_name: str = "recommended", region: str | None = None, eligibility: str | None = None, themes=(), search: str = "") -> int:
    """How many filters are set beside the view."""
    return sum(map(bool, (region, eligibility, search.strip()))) + len(set(themes))
