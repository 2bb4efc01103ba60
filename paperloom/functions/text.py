"""Text columns: normal forms, tokens, coverage, tests, redaction. In the JVM but for ``nfkc`` and ``unescape``."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: a run of one script; tokens are runs of more than one character.
RUNS = r"[\p{IsHan}]+|[\p{IsLatin}\p{N}_-]+|[\p{IsGreek}\p{N}]+"
#: A reference to a numbered figure or equation, and the label of a display.
FIGURES = r"(?i)(?<![A-Za-z0-9_])fig(?:ure)?s?\.?\s*([\dIVX]+[a-z]?)(?![A-Za-z0-9_])"
FORMULAS = r"(?i)(?:(?:(?<![A-Za-z0-9_])(?:eq(?:uation)?|formula)\.?|公式(?:编号)?|方程(?:式)?(?:编号)?)\s*\(?|\()(\d{1,4}[a-z]?)\)?"
LABELS = r"\((\d{1,4}[a-z]?)\)"
#: Latin ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _single_forms() -> tuple[str, str]:
    """All characters whose compatibility composition is one other character, and those, in order."""
    pairs = [(chr(i), n) for i in (*range(0x80, 0xD800), *range(0xE000, 0x30000)) if len(n := unicodedata.normalize("NFKC", chr(i))) == 1 and n != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Compatibility forms of single characters (full width, mathematical letters and the like), by Unicode's own rule.
FORMS, PLAIN = _single_forms()
#: Shapes of headings and formulas.
HEADING = r"^(?:(?:[IVXLC]+|\d+(?:\.\d+)*)\.?\s+\p{Lu}.*|(?i:appendix)(?:\s+[A-Z])?\s*.*)$"
MATH = r"[=<>±×÷∑∫√∞≈≤≥^_{}\[\]|]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities, named and numeric, as characters."""
    return text.map(lambda s: s if s is None else html.unescape(s))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The value brought into a range; null and NaN give the low end."""
    return F.when(c.isNull() | F.isnan(c), F.lit(low)).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unified(c: Column) -> Column:
    """Compatibility forms of single characters, and Latin ligatures, as plain characters, in the JVM. Other
    decompositions of more than one character are what ``nfkc`` has beyond that."""
    plain = F.translate(c, FORMS, PLAIN)
    apart = plain
    for one, letters in LIGATURES.items():
        apart = F.replace(apart, F.lit(one), F.lit(letters))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.when(c.rlike("[ﬀ-ﬆ]"), apart).otherwise(plain)).otherwise(c)


def sql_unified(expression: str) -> str:
    """``unified`` in SQL."""
    quoted = lambda t: t.replace("'", "''")
    out = f"translate({expression}, '{quoted(FORMS)}', '{quoted(PLAIN)}')"
    for one, letters in LIGATURES.items():
        out = f"replace({out}, '{one}', '{letters}')"
    return out


def sql_pattern(pattern: str) -> str:
    """A pattern of this module for an engine without looking around but with ASCII word boundaries."""
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")


def compact(c: Column) -> Column:
    """Lower-case letters and digits only, compatibility forms as plain ones."""
    return F.regexp_replace(F.lower(unified(c)), r"[^\p{L}\p{Nd}]", "")


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens; a null text has none."""
    found = F.regexp_extract_all(F.lower(unified(F.coalesce(c, F.lit("")))), F.lit(RUNS), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def query_coverage(query: Column, query_tokens: Column, text: Column, text_tokens: Column) -> Column:
    """1 if the text contains the query (letters and digits only), else the share of the query's tokens that it has; 0
    without either."""
    q, t = compact(query), compact(text)
    share = F.size(F.array_intersect(query_tokens, text_tokens)) / F.nullif(F.size(query_tokens), F.lit(0))
    return F.when((q == "") | (t == "") | q.isNull() | t.isNull(), 0.0).when(F.contains(t, q), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def beginning(query: Column, text: Column) -> Column:
    """The length of the common beginning of two compact forms by that of the query, taken as at least 4; at most 1."""
    places = F.sequence(F.lit(1), F.least(F.length(query), F.length(text)))
    same = F.size(F.filter(places, lambda i: F.substring(query, F.lit(1), i) == F.substring(text, F.lit(1), i)))
    return F.when((query == "") | (text == ""), 0.0).otherwise(F.least(F.lit(1.0), same / F.greatest(F.lit(4), F.length(query))))


def numbers_in(c: Column, pattern: str) -> Column:
    """Distinct numbers, in lower case, that a pattern's group finds."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)), F.lower))


def fingerprint(c: Column) -> Column:
    """What headers and footers have in common: lower case, numbers as #, other marks as spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), r"[^\p{L}#]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean_ratio(c: Column) -> Column:
    """The share of characters that aren't replacement, private or control characters; null without characters."""
    bad = F.length(c) - F.length(F.regexp_replace(c, r"[\x{FFFD}\p{Co}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}]", ""))
    return 1 - bad / F.nullif(F.length(c), F.lit(0))


def is_heading(c: Column) -> Column:
    """Whether a line looks like a heading: numbered, an appendix, or almost all capitals and short."""
    text = collapsed(c)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    capitals = (letters >= 4) & (F.length(text) <= 80) & (upper >= F.ceil(letters * 0.85)) & (F.size(F.split(text, " ")) <= 12)
    return F.coalesce((F.length(c) <= 140) & (text != "") & (text.rlike(HEADING) | capitals), F.lit(False))


def is_formula(c: Column) -> Column:
    """Whether a line looks like a formula: two mathematical marks and few letters."""
    text = collapsed(c)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    marks = F.regexp_count(c, F.lit(MATH))
    return F.coalesce((F.length(c) <= 220) & (text != "") & (marks >= 2) & (letters / F.length(c) < 0.68), F.lit(False))


def ends_sentence(c: Column) -> Column:
    """Whether a text ends with a sentence mark."""
    return F.coalesce(c.rlike(r"[.!?。！？]\s*$"), F.lit(False))


def language(c: Column) -> Column:
    """ZH if a text has two Han characters and 0.12 of its Latin letters in Han, else EN; null stays null."""
    han, latin = F.regexp_count(c, F.lit(r"\p{IsHan}")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(c.isNull(), None).when((han >= 2) & (han >= latin * 0.12), "ZH").otherwise("EN")


def redacted(c: Column) -> Column:
    """Keys and bearer tokens masked."""
    one = F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***")
    return F.regexp_replace(one, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1***")


def words_of_name(c: Column) -> Column:
    """An identifier as lower-case words: camel case parted, other marks as spaces."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"(\p{Ll}|\d)(\p{Lu})", "$1 $2"), r"[^\p{L}\p{Nd}]+", " ")))


def shortened(c: Column, most: int) -> Column:
    """A text cut to ``most`` characters, the last being an ellipsis if any are lost."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def joined_paragraph(parts: Column) -> Column:
    """Lines as one paragraph: a hyphen before a line that begins in lower case is taken out."""
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, "\n"), r"(\p{L})-\n(\p{Ll})", "$1$2"), "\n", " ")


def classified(c: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The first class of which the text has a word, in the order of the rules."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def duration(seconds: Column) -> Column:
    """Hours and minutes, as 2h 05m or 7m."""
    h, m = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm", m))


def first_nonempty(*columns: Column) -> Column:
    """The first column that isn't null or empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
