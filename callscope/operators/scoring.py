"""Relevance scoring, classification, eligibility and priority as projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import cues
from callscope.functions.dates import NORM, settled, with_status
from callscope.functions.text import any_prefix_pattern, contains_any, let, matches_any, noise, normalise, normalise_words, path_of, slug_title, strip_accents
from callscope.operators import lexicon as L


def _strings(values) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")")


def axis_hits(norm: Column, profile: L.Profile) -> Column:
    """array<struct<key, label, weight, hits, themes>>, heaviest first; up to five hits each."""
    rows = []
    for a in profile.ranked:
        hits = F.slice(F.filter(_strings(a.terms), lambda t: F.contains(norm, t)), 1, 5)
        rows.append(F.when(contains_any(norm, a.terms), F.struct(F.lit(a.key).alias("key"), F.lit(a.label).alias("label"), F.lit(a.weight).alias("weight"), hits.alias("hits"), _strings(a.themes).alias("themes"))))
    return F.array_compact(F.array(*rows))


def international_reason(norm: Column, profile: L.Profile, curated: Column | None = None) -> Column:
    """Why a text is international, null if it is not: curated source, explicit term, or a place near an anchor."""
    anchors = "|".join(map(re.escape, cues.ANCHORS))
    out = F.when(F.lit(False) if curated is None else F.coalesce(curated, F.lit(False)), F.lit("curated source"))
    for t in profile.strong:
        out = out.when(F.contains(norm, F.lit(t)), F.lit(f"explicit: {t}"))
    for t in profile.places:
        p = re.escape(t)
        out = out.when(F.contains(norm, F.lit(t)) & norm.rlike(f"(?s)(?:{anchors}).{{0,450}}{p}|{p}.{{0,450}}(?:{anchors})"), F.lit(f"place: {t}"))
    return out


def _on(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def prequalify_score(norm: Column, axes: Column, profile: L.Profile, curated_calls: Column | None = None, curated_abroad: Column | None = None) -> Column:
    no = F.lit(False)
    calls, abroad = (no if c is None else F.coalesce(c, no) for c in (curated_calls, curated_abroad))
    years = "|".join(map(str, profile.years))
    score = (
        F.least(F.lit(50), F.coalesce(F.get(axes, F.lit(0))["weight"], F.lit(0)))
        + F.least(F.lit(8), 3 * F.greatest(F.size(axes) - 1, F.lit(0)))
        + F.when(contains_any(norm, profile.international), 18).when(abroad, 12).otherwise(0)
        + _on(contains_any(norm, profile.funding), 10)
        + _on(contains_any(norm, profile.opportunity), 8)
        + _on(contains_any(norm, profile.priority_places), 5)
        + _on(contains_any(norm, cues.CLOSED) | contains_any(norm, cues.RESULT), -35)
        + _on(calls & norm.rlike(rf"\b(?:{years})\b"), 3)
    )
    return F.when(F.length(norm) < 8, -100).otherwise(score)


def prequalified(norm: Column, score: Column, axes: Column, profile: L.Profile, curated_calls: Column | None = None) -> Column:
    calls = F.lit(False) if curated_calls is None else F.coalesce(curated_calls, F.lit(False))
    years = "|".join(map(str, profile.years))
    return (score >= 8) | (F.size(axes) > 0) | (calls & norm.rlike(rf"\b(?:{years})\b"))


def _why_relevant(axes: Column) -> Column:
    """What speaks for a row: its two heaviest axes, reach, money, date."""
    named = F.array_join(F.transform(F.slice(axes, 1, 2), lambda a: a["label"]), " / ")
    parts = (F.when(F.size(axes) > 0, named), F.when(F.col("international"), "international"), F.when(F.col("funding"), "funding or fellowship"), F.when(F.col("deadline").isNotNull(), F.concat(F.lit("deadline "), F.col("deadline_text"))))
    return F.concat_ws(" | ", *parts)


def evaluate(df: DataFrame, text: str, as_of: str, profile: L.Profile = L.PROFILE, curated: Column | None = None, need_local: Column | None = None) -> DataFrame:
    """Status, signals, score 0-100, relevance, themes, audience, warnings and reasons of every row."""
    rows = with_status(df, text, as_of, keep_norm=True)
    norm, axes = F.col(NORM), F.col("axes")
    rows = settled(rows.withColumns({"axes": axis_hits(norm, profile), "why_international": international_reason(norm, profile, curated)}))
    rows = rows.withColumns(
        {
            "international": F.col("why_international").isNotNull(),
            "local": contains_any(norm, cues.LOCAL),
            "funding": contains_any(norm, profile.funding),
            "opportunity": contains_any(norm, profile.opportunity) | F.col("deadline").isNotNull(),
            "inbound_only": matches_any(norm, cues.INBOUND) & ~contains_any(norm, cues.OUTBOUND),
            "public_only": matches_any(norm, cues.PUBLIC_ONLY),
        }
    )
    raw = (
        F.coalesce(F.get(axes, F.lit(0))["weight"], F.lit(0))
        + F.least(F.lit(10), 5 * F.greatest(F.size(axes) - 1, F.lit(0)))
        + _on(F.col("international"), 12)
        + _on(F.col("funding"), 8)
        + _on(F.col("opportunity"), 5)
        + _on(contains_any(norm, profile.priority_places), 4)
        + _on(contains_any(norm, profile.priority_areas), 2)
        + _on(F.col("inbound_only"), -45)
        + _on(F.col("public_only"), -18)
    )
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    unlocal = F.lit(False) if need_local is None else F.coalesce(need_local, F.lit(False)) & ~F.col("local")
    relevant = (F.size(axes) > 0) & F.col("international") & F.col("opportunity") & (F.col("score") >= profile.threshold) & ~F.col("inbound_only") & ~unlocal
    listed = F.array_distinct(F.flatten(F.transform(axes, lambda a: a["themes"])))
    front = F.when(F.col("international") & ~F.array_contains(listed, "internacional"), F.concat(F.array(F.lit("internacional")), listed)).otherwise(listed)
    warn = lambda c, t: F.when(c, F.lit(t))
    rows = rows.withColumns(
        {
            "relevant": relevant,
            "active": relevant & (F.col("status") == "aberto"),
            "axis_keys": F.transform(axes, lambda a: a["key"]),
            "axis_labels": F.transform(axes, lambda a: a["label"]),
            "relevance_reason": _why_relevant(axes),
            "themes": F.when(F.col("funding") & ~F.array_contains(front, "bolsas"), F.concat(front, F.array(F.lit("bolsas")))).otherwise(front),
            "audience": F.array_compact(F.array(*[warn(contains_any(norm, t), k) for k, t in profile.audiences.items()])),
            "warnings": F.array_compact(F.array(warn(F.col("inbound_only"), "inbound mobility"), warn(F.col("public_only"), "public institutions only"), warn(F.col("status") == "verificar", "deadline not confirmed"), warn(unlocal, "no local connection"))),
        }
    ).drop(NORM)
    return settled(rows)


def reject_reason(profile: L.Profile = L.PROFILE, need_date: Column | None = None) -> Column:
    """The first gate that an evaluated row fails; null for accepted ones. No row is dropped."""
    dated = F.lit(True) if need_date is None else ~need_date | F.col("deadline").isNotNull()
    return F.when(~F.col("relevant"), "not relevant").when(F.col("status") != "aberto", F.concat(F.lit("status "), F.col("status"))).when(~dated, "no confirmed deadline")


def merged_themes(tags: Column, suggested: Column, themes=L.THEMES) -> Column:
    """Tags and those suggested ones that the theme table has, each once, by priority and then in table order."""
    ranked = sorted(themes, key=lambda t: t.priority)
    return let(F.array_union(tags, suggested), lambda both: F.filter(_strings([t.key for t in ranked]), lambda k: F.array_contains(both, k)))


def with_public_only(found: Column, public_only: Column) -> Column:
    """Restrictions and, where a text limits a call to public institutions, a blocking one that says so."""
    extra = F.struct(F.lit("found in the text").alias("programme"), F.lit("public institutions only; confirm in the call").alias("requires"), F.lit("bloqueia").alias("impact"))
    return F.when(F.coalesce(public_only, F.lit(False)), F.concat(found, F.array(extra))).otherwise(found)


def theme_tags(words: Column, themes=L.THEMES) -> Column:
    """Keys of the themes with a matching word, in table order."""
    return F.array_compact(F.array(*[F.when(words.rlike(any_prefix_pattern(t.words)), F.lit(t.key)) for t in themes]))


def text_tags(text: Column, themes=L.THEMES) -> Column:
    """``theme_tags`` of a text, which is brought to its words once."""
    return let(normalise_words(text), lambda words: theme_tags(words, themes))


def document_status(words: Column, table=L.DOC_STATUS) -> Column:
    out = None
    for key, terms in table:
        hit = words.rlike(any_prefix_pattern(terms))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise("aberto")


def classified(title: Column, url: Column, extra: Column | None = None, themes=L.THEMES, statuses=L.DOC_STATUS, noise_words=L.NOISE, forced: Column | None = None, need_theme: bool = True) -> Column:
    """struct<title, tags, status, points> of a link by its title, URL and further text; null for noise and, with ``need_theme``, without a theme.

    A missing title is read from the URL's slug; ``forced`` adds the theme ``internacional``.
    """
    given = F.trim(F.coalesce(title, F.lit("")))
    named = F.when(given == "", slug_title(url)).otherwise(given)
    address = F.translate(F.coalesce(url, F.lit("")), "-/", "  ")
    parts = [named, slug_title(url), address] + ([] if extra is None else [extra])
    force = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))

    # Each of these is used many times below it, so each is worked out once.
    def judge(words: Column) -> Column:
        def tagged(found: Column) -> Column:
            tags = F.when(force & ~F.array_contains(found, "internacional"), F.array_append(found, F.lit("internacional"))).otherwise(found)
            return F.when((F.size(tags) > 0) | F.lit(not need_theme), let(F.struct(tags.alias("tags"), document_status(words, statuses).alias("status")), row))

        return let(theme_tags(words, themes), tagged)

    def row(x: Column) -> Column:
        ranked = _strings([t.key for t in sorted(themes, key=lambda t: t.priority)])
        return F.struct(named.alias("title"), F.filter(ranked, lambda k: F.array_contains(x["tags"], k)).alias("tags"), x["status"].alias("status"), theme_points(x["tags"], x["status"], themes, force).alias("points"))

    return F.when(~noise(named, noise_words), let(F.concat_ws(" ", *map(normalise_words, parts)), judge))


def theme_points(tags: Column, status: Column, themes=L.THEMES, forced: Column | None = None) -> Column:
    per = {1: 10, 2: 4, 3: 2}
    has = lambda k: F.array_contains(tags, k)
    base = sum((_on(has(t.key), per.get(t.priority, 2)) for t in themes), F.lit(0))
    abroad = has("internacional") | (F.lit(False) if forced is None else forced)
    whole = base + _on(abroad, 8) + _on(has("cotutela"), 6) + _on(has("mobilidade"), 4) + _on(abroad & (has("mobilidade") | has("cotutela")), 6)

    def reduced(points: Column) -> Column:
        cut = lambda f: F.greatest(F.lit(1), F.floor(points * F.lit(f)).cast("int"))
        return F.when(status == "resultado", cut(0.45)).when(status == "retificacao", cut(0.7)).when(status == "encerrado", cut(0.25)).otherwise(points)

    return let(whole, reduced)


def restrictions(title: Column, url: Column, catalogue=L.RESTRICTIONS) -> Column:
    """array<struct<programme, requires, impact>> of the catalogue's entries that match, one a programme."""
    target = F.lower(strip_accents(F.concat_ws(" ", title, url)))
    kept = list({r.programme: r for r in reversed(L.usable(catalogue))}.values())[::-1]
    return F.array_compact(F.array(*[F.when(target.rlike(f"(?i){r.pattern}"), F.struct(F.lit(r.programme).alias("programme"), F.lit(r.requires).alias("requires"), F.lit(r.impact).alias("impact"))) for r in kept]))


def _impact(found: Column, impact: str) -> Column:
    return F.exists(found, lambda r: r["impact"] == impact)


def eligibility(found: Column) -> Column:
    return F.when(F.size(found) == 0, "sem_catalogo").when(_impact(found, "bloqueia"), "restricao_conhecida").when(_impact(found, "favoravel"), "via_individual").otherwise("verificar")


def priority(points: Column, weight: Column, found: Column, status: Column) -> Column:
    """Points by source weight, impact and status, to one decimal."""
    value = points * F.coalesce(weight, F.lit(1.0))
    value = value * F.when(_impact(found, "bloqueia"), 0.2).when(_impact(found, "favoravel"), 1.4).when(_impact(found, "atencao"), 0.85).otherwise(1.0)
    value = value * F.when(status == "encerrado", 0.15).when(status == "resultado", 0.4).when(status == "retificacao", 0.8).otherwise(1.0)
    return F.bround(value, 1)


def fit_label(value: Column) -> Column:
    return F.when(value >= 45, "very high").when(value >= 30, "high").when(value >= 20, "medium").otherwise("complementary")


def listing_score(label: Column, url: Column) -> Column:
    """How likely a link leads to a page that lists calls."""
    texts = F.struct(normalise_words(label).alias("t"), normalise_words(F.translate(path_of(url), "-/", "  ")).alias("path"))
    hints = F.array(*[F.struct(F.lit(h).alias("hint"), F.lit(w).alias("path"), F.lit(int(w * 0.7)).alias("label")) for h, w in cues.LISTING_HINTS])
    shape = _on(url.rlike("(?i)/(editais|chamadas|oportunidades|calls|bolsas|scholarships)/?"), 4) - _on(F.lower(url).rlike(r"\.(pdf|docx?|zip)$"), 8) - _on(url.rlike(r"\d{2,}[-_/]\d{4}"), 3)

    def score(x: Column) -> Column:
        found = F.aggregate(hints, F.lit(0), lambda n, h: n + F.when(F.contains(x["path"], h["hint"]), h["path"]).when(F.contains(x["t"], h["hint"]), h["label"]).otherwise(0))
        return F.when(contains_any(F.concat_ws(" ", x["t"], x["path"]), cues.LISTING_VETOES), 0).otherwise(F.greatest(F.lit(0), found + shape))

    return let(texts, score)
