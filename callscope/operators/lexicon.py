"""Rule tables: what users edit to change what is found and how it counts."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from callscope.functions import cues


def plain(term: str) -> str:
    """The driver-side twin of the column normaliser, used once on each term."""
    t = "".join(c for c in unicodedata.normalize("NFKD", term or "") if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", t.lower()).strip()


@dataclass(frozen=True)
class Axis:
    key: str
    label: str
    weight: int
    terms: tuple[str, ...]
    themes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """Axes and signals; every list may be replaced."""

    axes: tuple[Axis, ...]
    international: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    funding: tuple[str, ...] = ()
    opportunity: tuple[str, ...] = ()
    priority_places: tuple[str, ...] = ()
    priority_areas: tuple[str, ...] = ()
    audiences: dict[str, tuple[str, ...]] = field(default_factory=dict)
    threshold: int = 30
    years: tuple[int, ...] = (2026, 2027, 2028)

    @property
    def ranked(self) -> list[Axis]:
        """By weight, heaviest first; equal weights in the order given."""
        return sorted(self.axes, key=lambda a: -a.weight)


@dataclass(frozen=True)
class Theme:
    key: str
    priority: int
    words: tuple[str, ...]


@dataclass(frozen=True)
class Restriction:
    programme: str
    pattern: str
    requires: str
    impact: str


def usable(restrictions) -> list[Restriction]:
    """Entries whose pattern compiles; the rest are left out."""
    out = []
    for r in restrictions:
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        out.append(r)
    return out


def plain_words(term: str) -> str:
    """``plain`` with punctuation as spaces."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", plain(term))).strip()


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _entries(table: dict | None) -> dict:
    """Without keys that begin with ``_``: those are notes."""
    return {k: v for k, v in (table or {}).items() if not k.startswith("_")}


# The names of tables and fields in rule files, ours first.
_PROFILE_KEYS = {
    "international": ("international", "sinais_internacionais"),
    "strong": ("strong", "sinais_internacionais_fortes"),
    "places": ("places", "sinais_geograficos"),
    "funding": ("funding", "sinais_fomento"),
    "opportunity": ("opportunity", "sinais_oportunidade"),
    "priority_places": ("priority_places", "paises_prioritarios"),
    "priority_areas": ("priority_areas", "areas_prioritarias"),
}


def _first(table: dict, *names: str, default=None):
    return next((table[n] for n in names if n in table), default)


def load_profile(path: str) -> Profile:
    """A profile from JSON: axes by key with label, weight, terms and themes; lists of signals; audiences by key; the threshold."""
    raw = _read(path)
    axes = tuple(
        Axis(k, _first(a, "label", "rotulo", default=k), int(_first(a, "weight", "peso", default=0)), tuple(map(plain, _first(a, "terms", "termos", default=()))), tuple(_first(a, "themes", "temas", default=())))
        for k, a in _entries(_first(raw, "axes", "eixos", default={})).items()
    )
    lists = {k: tuple(map(plain, _first(raw, *names, default=()))) for k, names in _PROFILE_KEYS.items()}
    groups = _entries(_first(raw, "audiences", "publicos", default={}))
    return Profile(axes, audiences={k: tuple(map(plain, v)) for k, v in groups.items()}, threshold=int(_first(raw, "threshold", "limiar_aderencia", default=30)), **lists)


def load_themes(path: str) -> tuple[tuple[Theme, ...], tuple, tuple[str, ...]]:
    """Themes, document statuses (first match first) and noise words from JSON; the theme ``internacional`` gains countries and foreign calls."""
    raw = _read(path)
    themes = []
    for key, t in _entries(_first(raw, "themes", "temas_interesse", default={})).items():
        words = tuple(map(plain_words, _first(t, "words", "palavras", default=())))
        themes.append(Theme(key, int(_first(t, "priority", "prioridade", default=3)), tuple(w for w in words + ((*cues.COUNTRIES, *cues.FOREIGN_CALLS) if key == "internacional" else ()) if w)))
    found = {k: tuple(map(plain_words, _first(v, "words", "palavras", default=()))) for k, v in _entries(_first(raw, "statuses", "status_edital", default={})).items()}
    statuses = tuple((k, found[k]) for k in ("encerrado", "resultado", "retificacao") if found.get(k))
    noise = _first(raw, "noise", "ruido", default=())
    noise = _first(noise, "words", "palavras", default=()) if isinstance(noise, dict) else noise
    return tuple(themes), statuses, tuple(w for w in map(plain_words, noise) if w)


def load_restrictions(path: str) -> tuple[tuple[Restriction, ...], dict[str, float]]:
    """The catalogue of restrictions, unusable patterns left out, and the sources' weights from JSON."""
    raw = _read(path)
    rows = [Restriction(_first(r, "programme", "programa"), _first(r, "pattern", "padrao"), _first(r, "requires", "exige", default=""), _first(r, "impact", "impacto", default="atencao")) for r in _first(raw, "restrictions", "restricoes", default=())]
    return tuple(usable(rows)), {k: float(v) for k, v in _entries(_first(raw, "source_weights", "peso_por_fonte")).items()}


PROFILE = Profile(
    axes=(
        Axis("cooperation", "International cooperation", 40, ("cooperacao internacional", "joint research", "international grant"), ("cooperacao",)),
        Axis("mobility", "Academic mobility", 30, ("mobilidade academica", "fellowship abroad", "programa internacional"), ("mobilidade",)),
        Axis("licensing", "Open licences", 22, ("license", "general public"), ("abertura",)),
    ),
    international=("internacional", "international", "abroad"),
    strong=("cooperacao internacional", "international", "abroad", "internacional"),
    places=("portugal", "france", "germany"),
    funding=("grant", "fellowship", "bolsa"),
    opportunity=("chamada", "edital", "call", "inscricoes"),
    priority_places=("portugal",),
    priority_areas=("research",),
    audiences={"researchers": ("research", "pesquis"), "students": ("academica", "student")},
)
THEMES = (
    Theme("internacional", 1, ("internacional", "international", "abroad")),
    Theme("mobilidade", 1, ("mobilidade academica", "fellowship")),
    Theme("cotutela", 1, ("cotutela",)),
    Theme("pesquisa", 2, ("joint research", "research")),
    Theme("bolsas", 3, ("grant", "bolsa")),
)
DOC_STATUS = (("encerrado", ("prazo encerrado", "inscricoes encerrad")), ("resultado", ("resultado final", "resultado preliminar")), ("retificacao", ("retificad", "errata")))
RESTRICTIONS = (
    Restriction("Joint research", r"joint research", "partner abroad", "favoravel"),
    Restriction("Mobility edition", r"mobilidade academica", "enrolment", "atencao"),
    Restriction("Forthcoming grant", r"forthcoming", "opening", "bloqueia"),
    Restriction("broken", r"(unclosed", "", "atencao"),
)
NOISE = ("mapa do site", "fale conosco", "acesso a informacao", "voltar ao topo")
SOURCE_WEIGHTS = {0: 1.3, 1: 1.2, 2: 0.7}
