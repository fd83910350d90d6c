"""Text functions as Column expressions: normalisers, predicates, titles, signatures."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions import cues


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """The compatibility decomposition without combining marks, from the Unicode rule: characters, what each becomes, and those that become several.

    Characters beyond the second string's length vanish. Hangul is left to ``_HANGUL``.
    """
    one, gone, many = {}, [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char:
            continue
        if len(plain) == 1:
            one[char] = plain
        elif plain:
            many[char] = plain
        else:
            gone.append(char)
    return "".join([*one, *gone]), "".join(one.values()), many


def _ranges(chars) -> str:
    """A regular expression's class of characters."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


_FROM, _TO, _MANY = _decomposed()
_SEVERAL = _ranges([*_MANY, chr(0xAC00), *map(chr, range(0xAC01, 0xD7A4))])
#: Leading, vowel and trailing letters of Hangul; a syllable's number is (leading * 21 + vowel) * 28 + trailing.
_HANGUL = tuple("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _spread(char: Column) -> Column:
    """What a character that becomes several becomes."""
    number = F.ascii(char) - 0xAC00
    letter = lambda table, at: F.substring(F.lit(table), at + 1, F.lit(1))
    trailing = number % 28
    syllable = F.concat(letter(_HANGUL[0], (number / 588).cast("int")), letter(_HANGUL[1], (number % 588 / 28).cast("int")), F.when(trailing > 0, letter(_HANGUL[2], trailing - 1)).otherwise(""))
    table = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")
    return F.when(number.between(0, 0xD7A3 - 0xAC00), syllable).otherwise(F.coalesce(F.try_element_at(table, char), char))


def strip_accents(text: Column) -> Column:
    """Compatibility form (NFKD) without combining marks, of any script; case and spaces stay. Native.

    ASCII text passes after one look; characters that become several are looked for
    among the others only and replaced one after another, each once, where a text has any.
    """
    rest = lambda t: F.regexp_replace(t, r"[\x00-\x7F]+", "")
    several = lambda t: F.array_distinct(F.regexp_extract_all(rest(t), F.lit(_SEVERAL), F.lit(0)))
    # A lambda whose body names another one's argument keeps Spark from finding a Python function over the result.
    spread = lambda t: F.when(rest(t).rlike(_SEVERAL), F.aggregate(several(t), t, lambda s, c: F.replace(s, c, _spread(c)))).otherwise(t)
    return F.when(text.rlike(r"[^\x00-\x7F]"), let(F.translate(text, _FROM, _TO), spread)).otherwise(text)


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed; lone spaces are not touched."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " "))


def folded(plain: Column) -> Column:
    """Text without accents in lower case with single spaces. Null is empty."""
    return squeeze(F.lower(F.coalesce(plain, F.lit(""))))


def normalise(text: Column) -> Column:
    """Accents off, lower case, single spaces; punctuation stays. Null is empty."""
    return folded(strip_accents(text))


def normalise_words(text: Column) -> Column:
    """``normalise`` with punctuation as spaces."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s]", " "))


def contains_any(text: Column, terms) -> Column:
    """Whether any term is a substring; one alternation, so one pass over the text."""
    terms = [t for t in terms if t]
    return text.rlike(any_pattern(terms)) if terms else F.lit(False)


def matches_any(text: Column, patterns) -> Column:
    return text.rlike("(?is)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def prefix_pattern(term: str) -> str:
    """A term's words in order, each a word prefix, with up to two words between."""
    first, *rest = term.split()
    return r"\b" + re.escape(first) + "".join(r"(?:\s+\w+){0,2}\s+" + re.escape(w) for w in rest)


_GAP = r"(?:\s+\w+){0,2}\s+"


def _tree(sequences, whole: bool = False, before: str = "") -> str:
    """A pattern that finds what the alternation of the sequences finds, which takes one way from each atom to the next.

    A plain alternation is tried term by term at every place of a text. Unless ``whole``, a
    sequence that begins with another one is left out, as the other one is found where it is.
    What must hold ``before`` it, such as a word's beginning, is looked at behind its first character's test, which is quicker.
    """
    root: dict = {}
    for atoms in sequences:
        node = root
        for a in atoms:
            node = node.setdefault(a, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [a + written(below) for a, below in node.items() if a]
        if not ways or ("" in node and not whole):
            return ""
        joined = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return joined + "?" if "" in node else joined

    first = "".join(a for a in root if a)
    return f"(?=[{first}]){before}{written(root)}"


def any_pattern(terms, whole: bool = False) -> str:
    """Any of the terms (none empty) as a substring, as a pattern; with ``whole`` the longest that goes on to match."""
    return _tree([[re.escape(c) for c in t] for t in terms], whole)


def any_prefix_pattern(terms) -> str:
    """Any of the terms by ``prefix_pattern``, as one pattern."""
    atoms = lambda t: [a for i, w in enumerate(t.split()) for a in ([_GAP] if i else []) + [re.escape(c) for c in w]]
    return _tree(map(atoms, terms), before=r"\b") if terms else ""


def mend_year(text: Column) -> Column:
    """``202 6`` -> ``2026``."""
    return F.regexp_replace(text, r"(?=2)\b(20[0-4])\s+([0-9])\b", "$1$2")


def glued_cases(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[a-zà-ÿ][A-ZÀ-Þ]"))


def year_of(title: Column, url: Column | None = None) -> Column:
    """The latest year 2000-2049 standing alone in title or URL; null if none."""
    text = title if url is None else F.concat_ws(" ", title, url)
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(20[0-4]\d)\b"), 1), lambda y: y.cast("int")))


def stale_edition(title: Column, url: Column, year: int) -> Column:
    named = title.rlike("(?i)chamada|edital|call|programa|convocat|appel|bolsa")
    return F.coalesce(named & (year_of(title, url) < year), F.lit(False))


def generic_label(label: Column) -> Column:
    """Too short or general to name anything."""
    starts = lambda t: F.exists(F.array(*map(F.lit, cues.GENERIC_LABELS)), lambda g: F.startswith(t, g) & (F.length(t) <= F.length(g) + 20))
    return let(normalise_words(label), lambda t: (F.length(t) < 12) | starts(t))


def noise(title: Column, words) -> Column:
    """Shorter than 12, only digits, equal to a noise word or mostly one."""
    words = [w for w in words if w]

    def judge(t: Column) -> Column:
        mostly = F.exists(F.array(*map(F.lit, words)), lambda w: (t == w) | (F.contains(t, w) & (F.length(w) / F.length(t) > 0.6))) if words else F.lit(False)
        return (F.length(t) < 12) | t.rlike(r"^[\d\s]+$") | mostly

    return let(normalise_words(title), judge)


def slug_title(url: Column) -> Column:
    slug = F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1)
    return squeeze(F.regexp_replace(F.regexp_replace(slug, r"(?i)\.(pdf|html?|aspx?|php)$", ""), "[-_+]+", " "))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def file_type(url: Column) -> Column:
    """PDF, DOC, XLS, ZIP or PPT by the suffix of the URL's path, else empty."""
    found = F.regexp_extract(F.lower(path_of(url)), r"\.(pdf|docx?|xlsx?|zip|rar|od[ts]|pptx?)$", 1)
    kinds = F.create_map(*[F.lit(x) for p in cues.FILE_TYPES.items() for x in p])
    return F.coalesce(F.try_element_at(kinds, found), F.lit(""))


def is_next_label(label: Column) -> Column:
    """Whether a link's label leads to the following page; labels of the last page do not."""
    known = lambda t: ~contains_any(t, cues.LAST_LABELS) & (F.trim(label).isin(*cues.NEXT_SYMBOLS) | contains_any(t, cues.NEXT_LABELS))
    return let(normalise_words(label), known)


def page_url(url: Column, number: Column, kind: str = "query", parameter: str | Column = "page") -> Column:
    """A listing's page: the marker ``{pagina}`` filled in, or one query parameter set (repeated ones dropped)."""
    if kind == "template":
        return F.replace(url, F.lit("{pagina}"), number.cast("string"))
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    name = F.lit(parameter) if isinstance(parameter, str) else parameter
    rest = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(rest, F.array(F.concat(name, F.lit("="), number.cast("string")))), "&"))


# Markup that leaks into titles, where long titles may be cut, the length limit.
_TECHNICAL = (r"<path[^>]*>", r'd="M[\d\s\.,\-A-Za-z]+"', r'viewBox="[^"]*"', r'xmlns="[^"]*"', r"<svg[^>]*>", r"</?\w+\s*/?>", r"\{[^}]{20,}\}")


SEPARATORS = (". ", " — ", " – ", " | ", "; ")


def clean_title(title: Column, prefixes=cues.TITLE_PREFIXES, body_cues=cues.BODY_CUES, limit: int = 110) -> Column:
    """Markup off, category prefixes off, cut where the body begins or at a sentence end if long.

    ``prefixes`` and ``body_cues`` are patterns; the first cue whose first match is
    at character 12 or later cuts, once.
    """
    t = F.coalesce(title, F.lit(""))
    for p in _TECHNICAL:
        t = F.regexp_replace(t, p, " ")
    t = squeeze(t)
    for p in prefixes:
        t = F.trim(F.regexp_replace(t, f"(?iU){p}", ""))

    def cut_body(t: Column) -> Column:
        cut = None
        for p in body_cues:
            head = F.regexp_extract(t, f"(?isU)^(.*?){p}", 1)
            found = F.length(head) >= 12  # empty where the cue is not found
            cut = F.when(found, F.trim(head)) if cut is None else cut.when(found, F.trim(head))
        return t if cut is None else cut.otherwise(t)

    def shorten(t: Column) -> Column:
        short = F.substring(t, 1, limit)
        ended = None
        for sep in SEPARATORS:
            kept = F.length(short) - F.length(F.substring_index(short, sep, -1)) - len(sep)
            ok = F.contains(short, F.lit(sep)) & (kept > 40)
            part = F.substr(short, F.lit(1), kept)
            ended = F.when(ok, part) if ended is None else ended.when(ok, part)
        return F.regexp_replace(F.when(F.length(t) > limit, F.trim(ended.otherwise(short))).otherwise(t), r"[ .,;:\-–—|]+$", "")

    return let(let(t, cut_body), shorten)


def signature_tokens(title: Column) -> Column:
    """The sorted distinct words that name an opportunity, years and the call's number included."""
    raw = F.coalesce(title, F.lit(""))
    numbers = F.array_sort(F.regexp_extract_all(raw, F.lit(r"\b(\d{1,3})\s*/\s*20[0-4]\d\b"), 1))
    marker = F.when(F.size(numbers) > 0, F.array(F.concat(F.lit("num"), F.array_join(numbers, "-")))).otherwise(F.array().cast("array<string>"))
    empty = F.array(*map(F.lit, dict.fromkeys(cues.EMPTY_WORDS)))
    year = lambda w: w.rlike(r"^20\d\d$")
    words = F.filter(F.split(normalise_words(raw), " "), lambda w: ~F.array_contains(empty, w) & F.when(w.rlike(r"^\d+$"), year(w)).otherwise(F.length(w) > 2))
    return F.array_sort(F.array_distinct(F.concat(marker, words)))


def signature(title: Column) -> Column:
    return F.array_join(signature_tokens(title), " ")


def without_year(title: Column) -> Column:
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"\b20[0-4]\d\b", " ")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def json_for_script(text: Column) -> Column:
    return F.replace(text, F.lit("</"), F.lit("<\\/"))
