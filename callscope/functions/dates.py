"""Dates in free text, deadline choice and status.

Patterns are matched in the normalised text, so spans and context windows index
the same string. The rules are SQL expressions over a column that holds that text
once (``with_norm``): they are long, and as text they are built once, when this
module is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import cues
from callscope.functions.text import any_pattern, mend_year, normalise

_NAMES = any_pattern(cues.MONTHS, whole=True)
NORM = "__norm"


def quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    if "'" in pattern:
        raise ValueError(f"a quote in {pattern}")
    return f"r'{pattern}'"


def any_of(text: str, terms) -> str:
    """Whether any term is a substring, as SQL; ``text`` is a name, as it is read for each term."""
    return f"exists(array({', '.join(map(quoted, terms))}), term -> contains({text}, term))"


# The written forms of dates. A pattern begins with the character itself, as a look back at every place is slow.
_KINDS = (
    ("dmy", r"\d(?<!\d\d)\d?\s*[./-]\s*\d{1,2}\s*[./-]\s*20[0-4]\d(?!\d)"),
    ("ymd", r"2(?<!\d2)0[0-4]\d\s*[-/]\s*\d{1,2}\s*[-/]\s*\d{1,2}(?!\d)"),
    ("dmy", rf"\d(?<!\d\d)\d?\s+(?:de\s+)?(?:{_NAMES})\s+(?:de\s+)?20[0-4]\d"),
    ("mdy", rf"\b(?:{_NAMES})\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s*20[0-4]\d\b"),
)


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_MONTH = "map(" + ", ".join(f"'{k}', '{v:02d}'" for k, v in cues.MONTHS.items()) + ")"
_NONE = "CAST(array() AS array<struct<start:int,day:date,end:int>>)"


def _date(kind: str, named: bool, text: str) -> str:
    """The day that a match names, null if there is no such day."""
    d, m, y = {"dmy": (0, 1, 2), "ymd": (2, 1, 0), "mdy": (1, 0, 2)}[kind]
    month = f"lpad(get(p, {m}), 2, '0')"
    month = f"coalesce(try_element_at({_MONTH}, get(p, {m})), {month})" if named else month
    day = f"try_cast(concat(get(p, {y}), '-', {month}, '-', lpad(get(p, {d}), 2, '0')) AS date)"
    bare = f"regexp_replace({text}, {quoted(r'(?<=\d)(?:st|nd|rd|th)\b|\bde\b')}, ' ')" if named else text
    return _let(f"regexp_extract_all({bare}, '[a-z]+|[0-9]+', 0)", "p", day)


def _spans(text: str, kind: str, pattern: str) -> str:
    """Dates of one pattern with offsets, kept running over the matches and what lies between them."""
    # split() would compile the pattern for each text; what lies before a match is matched from the end of the last one.
    gaps = f"regexp_extract_all({text}, {quoted(rf'(?s)\G(.*?)(?:{pattern})')}, 1)"
    pairs = f"zip_with(found, {gaps}, (m, g) -> struct(m AS m, g AS g))"
    one = f"struct(x.at + length(s.g) AS start, {_date(kind, 'a' in pattern, 's.m')} AS day, x.at + length(s.g) + length(s.m) AS end)"
    step = f"(x, s) -> struct(x.at + length(s.g) + length(s.m) AS at, array_append(x.out, {one}) AS out)"
    run = f"aggregate({pairs}, struct(0 AS at, {_NONE} AS out), {step}, x -> x.out)"
    return _let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", "found", f"if(size(found) = 0, {_NONE}, {run})")


def _all_dates(text: str) -> str:
    """array<struct<start, day, end>> in order, invalid days dropped, one a (day, start / 4)."""
    every = f"sort_array(filter(concat({', '.join(_spans(text, k, p) for k, p in _KINDS)}), d -> d.day IS NOT NULL))"
    # Twins begin within four characters, so they stand side by side: four patterns, four places.
    twin = "exists(slice(dates, greatest(i - 15, 1), least(i, 16)), o -> o.day = d.day AND floor(o.start / 4) = floor(d.start / 4))"
    return f"if(rlike({text}, {quoted(r'20[0-4]\d')}), {_let(every, 'dates', f'if(size(dates) < 2, dates, filter(dates, (d, i) -> NOT {twin}))')}, {_NONE})"


# What stands before a closing date; windows and points of a date's surroundings.
_CLOSING = r"(?=[adecs])(?:\bate\b|deadline|encerramento|closing date|close(?:s|d)?(?: on)?|apply by|submission deadline).{0,35}$"
_UNTIL = r"(?=[abu])\b(?:ate|until|by)\b"


def _points(wide: str, near: str, before: str) -> str:
    """Points by the surroundings (150 characters either way, 55 either way, 90 before); what is not in the wide ones is not in the near ones."""
    named = f"if({any_of(wide, cues.DEADLINE)}, if({_let(near, 'near', any_of('near', cues.DEADLINE))}, 13, 8), 0)"
    return f"{named} + if(rlike({wide}, {quoted(_UNTIL)}), 3, 0) + if({any_of(wide, cues.NOT_A_DEADLINE)}, -4, 0) + if({any_of(before, cues.OPENING_BEFORE)}, -20, 0) + if(rlike({before}, {quoted(_CLOSING)}), 8, 0)"


def _score(text: str, d: str) -> str:
    """Points of one date by what stands around it; each surrounding is cut out once."""

    def around(before: int, after: int | None) -> str:
        start = f"greatest({d}.start - {before}, 0)"
        end = f"{d}.start" if after is None else f"least({d}.end + {after}, length({text}))"
        return f"substr({text}, {start} + 1, {end} - {start})"

    cuts = f"struct({around(150, 150)} AS wide, {around(90, None)} AS before)"
    return _let(cuts, "w", _points("w.wide", around(55, 55), "w.before"))


def _deadline(text: str) -> str:
    """struct<score, day, start, excerpt> of the best date with a positive score; null if none.

    The greatest score wins, then the later day, then the later place.
    """
    scored = f"struct({_score(text, 'd')} AS score, d.day AS day, d.start AS start, substr({text}, greatest(d.start - 150, 0) + 1, 360) AS excerpt)"
    return _let(_all_dates(text), "dates", f"array_max(filter(transform(dates, d -> {scored}), c -> c.score > 0))")


ALL_DATES, DEADLINE = _all_dates(NORM), _deadline(NORM)


def with_norm(df: DataFrame, text: str) -> DataFrame:
    """Adds the text that dates and cues are looked for in: normalised, split years mended."""
    return settled(df.withColumn(NORM, mend_year(normalise(F.col(text)))))


def with_dates(df: DataFrame, text: str) -> DataFrame:
    """Adds ``dates``: array<struct<start, day, end>> of all dates in order of place."""
    return with_norm(df, text).withColumn("dates", F.expr(ALL_DATES)).drop(NORM)


def with_deadline(df: DataFrame, text: str) -> DataFrame:
    """Adds ``best``: struct<score, day, start, excerpt> of the date that is the deadline, null if there is none."""
    return with_norm(df, text).withColumn("best", F.expr(DEADLINE)).drop(NORM)


#: What a text says of its status, each looked for once.
_CUES = {name: any_of(NORM, terms) for name, terms in (("__open", cues.OPEN), ("__closed", cues.CLOSED), ("__ahead", cues.FORTHCOMING), ("__result", cues.RESULT))}


def _status_columns() -> dict[str, str]:
    """Status fields by name, over the columns of ``_CUES``, ``best``, ``__day`` and ``__listed``."""
    is_open, closed, ahead, result = _CUES
    dated = f"CASE WHEN best.day < __day THEN 'encerrado' WHEN {closed} AND NOT {is_open} THEN 'encerrado' WHEN {ahead} AND NOT {is_open} THEN 'futuro' ELSE 'aberto' END"
    undated = f"CASE WHEN {result} OR {closed} THEN 'encerrado' WHEN {ahead} AND NOT {is_open} THEN 'futuro' WHEN {is_open} OR __listed THEN 'aberto' ELSE 'verificar' END"
    trust = f"CASE WHEN {result} OR {closed} THEN 80 WHEN {ahead} AND NOT {is_open} THEN 65 WHEN {is_open} THEN 65 WHEN __listed THEN 55 ELSE 0 END"
    shown = "date_format(best.day, 'dd/MM/yyyy')"
    dated_why = f"CASE WHEN best.day < __day THEN concat('deadline passed on ', {shown}) WHEN {closed} AND NOT {is_open} THEN 'page says that applications are closed' WHEN {ahead} AND NOT {is_open} THEN 'announced, not open yet' ELSE concat('deadline confirmed: ', {shown}) END"
    undated_why = f"CASE WHEN {result} OR {closed} THEN 'page tells of results or of the end' WHEN {ahead} AND NOT {is_open} THEN 'page tells of a call to come' WHEN {is_open} THEN 'page says that applications are open' WHEN __listed THEN 'listed as open by its source' ELSE 'no deadline found' END"
    return {
        "status": f"if(best.day IS NOT NULL, {dated}, {undated})",
        "deadline": "best.day",
        "deadline_text": shown,
        "days_left": "datediff(best.day, __day)",
        "confidence": f"if(best.day IS NOT NULL, least(100, 45 + 5 * best.score), {trust})",
        "excerpt": "if(best.day IS NOT NULL, best.excerpt, '')",
        "status_reason": f"if(best.day IS NOT NULL, {dated_why}, {undated_why})",
    }


_STATUS = _status_columns()


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: filters on worked-out columns stop here.

    Catalyst pushes a filter below projections by writing out each column it
    names, which would work long text rules out twice or more.
    """
    return df.selectExpr("inline(array(struct(*)))")


def with_status(df: DataFrame, text: str, as_of: str, listed_open: Column | None = None, keep_norm: bool = False) -> DataFrame:
    """Adds status, deadline, deadline_text, days_left, confidence, excerpt and status_reason; with ``keep_norm`` the normalised text as well."""
    listed = F.lit(False) if listed_open is None else F.coalesce(listed_open, F.lit(False))
    rows = df.withColumns({NORM: mend_year(normalise(F.col(text))), "__day": F.lit(as_of).cast("date"), "__listed": listed})
    found = settled(settled(rows).withColumns({name: F.expr(x) for name, x in {"best": DEADLINE, **_CUES}.items()}))
    kept = [F.col(f"`{c}`") for c in (*df.columns, *([NORM] if keep_norm else [])) if c not in _STATUS]
    return settled(found.select(*kept, *[F.expr(x).alias(c) for c, x in _STATUS.items()]))


def refreshed_status(status: Column, day: Column, last_seen: Column, as_of: Column, stale_days: int = 7) -> Column:
    """Open records past their deadline close; without a deadline they age to ``verificar``."""
    aged = (status == "aberto") & day.isNull() & (last_seen.cast("date") < F.date_sub(as_of, stale_days))
    return F.when(day.isNotNull() & (day < as_of) & (status == "aberto"), "encerrado").when(aged, "verificar").otherwise(status)


def urgency(status: Column, days: Column) -> Column:
    live = status == "aberto"
    return (
        F.when(live & (days == 0), "today").when(live & (days == 1), "tomorrow").when(live & days.between(2, 7), "urgent").when(live & days.between(8, 14), "soon").when(live & (days > 14), "later").when(status == "verificar", "confirm").when(days < 0, "ended").otherwise("")
    )
