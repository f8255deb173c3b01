"""Column builders for text: every function takes and gives a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and scripts as Python's re module has them, for Java and RE2 alike.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"
TOKEN_PIECE = rf"[{CJK}]|[\p{{L}}\p{{N}}_]+|[^{WS}]"
MARKER = r"\[[ \t-\r]*[0-9]+(?:[ \t-\r]*,[ \t-\r]*[0-9]+)*[ \t-\r]*\]"
TERM = "[a-z0-9]+"
ELLIPSIS = "…"
SNIPPET_LENGTH, PREVIEW_LENGTH, TITLE_LENGTH = 300, 200, 60
ATX = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def blank(c: Column) -> Column:
    """Whether there is no text, or white space only."""
    return F.coalesce(~c.rlike(f"[^{WS}]"), F.lit(True))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def token_count(c: Column) -> Column:
    """Estimated tokens: a character of CJK or punctuation is one, a word a quarter of its length, rounded up."""
    pieces = F.regexp_extract_all(c, F.lit(TOKEN_PIECE), F.lit(0))
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda n, p: n + F.ceil(F.length(p) / 4))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), F.lit(0))).cast("bigint")


def shorten(c: Column, limit: int) -> Column:
    """Collapsed and cut to ``limit`` characters with an ellipsis, at a space if one is late enough."""
    flat = collapse(c)
    cut = F.substring(flat, 1, limit - 1)
    back = F.instr(F.reverse(cut), " ")
    last = F.length(cut) - back
    end = F.when((back > 0) & (last > limit // 2), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(end), F.lit(ELLIPSIS)))


def title(c: Column) -> Column:
    return F.substring(collapse(c), 1, TITLE_LENGTH)


def cut_question(c: Column, most: int = 128_000) -> Column:
    return F.substring(c, 1, most)


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def escape_attribute(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def pages_label(start: Column, end: Column, dash: str = "-") -> Column:
    """'p. n', 'pp. a-b', or null; one page missing is taken from the other."""
    one = F.coalesce(start, end)
    both = start.isNotNull() & end.isNotNull() & (start != end)
    return F.when(one.isNull(), None).when(both, F.concat(F.lit("pp. "), start, F.lit(dash), end)).otherwise(F.concat(F.lit("p. "), one))


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "")


def _kept(marker: Column, sources: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(marker, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.filter(numbers, lambda i: (i >= 1) & (i <= sources))


def valid_markers(c: Column, sources: Column) -> Column:
    """Text with each marker rewritten to its numbers within 1..sources, one bracket each, none if none is."""
    parts = F.split(c, MARKER, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(MARKER), F.lit(0)), lambda m: F.array_join(F.transform(_kept(m, sources), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ""))
    pairs = F.transform(F.arrays_zip(parts.alias("p"), found.alias("m")), lambda z: F.concat(z["p"], F.coalesce(z["m"], F.lit(""))))
    return F.array_join(pairs, "")


def markers_used(c: Column, sources: Column) -> Column:
    """The numbers that survive, sorted, once each."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(MARKER), F.lit(0)), lambda m: _kept(m, sources)))))


def terms(c: Column) -> Column:
    """Lexical terms: lower case, runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def phrase(c: Column) -> Column:
    return collapse(F.lower(c))


def heading_label(c: Column) -> Column:
    """A heading's own text, its number signs gone."""
    return collapse(F.regexp_replace(c, rf"^#{{1,6}}[{WS}]+|[{WS}]+#*[{WS}]*$", ""))


def repetition_key(c: Column) -> Column:
    """The form in which running headers of different pages are equal: numbers are one sign."""
    return F.regexp_replace(F.lower(collapse(c)), "[0-9]+", "#")


def bytes_label(n: Column) -> Column:
    kb, mb = n / 1024.0, n / 1048576.0
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(F.round(kb, 0).cast("bigint").cast("string"), F.lit(" KB")))
        .when(mb < 10, F.concat(F.format_string("%.1f", F.round(mb, 1)), F.lit(" MB")))
        .otherwise(F.concat(F.round(mb, 0).cast("bigint").cast("string"), F.lit(" MB")))
    )


def iso_z(c: Column) -> Column:
    """UTC time as text with six digits of seconds and a Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def display_name(email: Column) -> Column:
    clean = F.lower(strip(email))
    local = F.split_part(clean, F.lit("@"), F.lit(1))
    return F.when(local == "", clean).otherwise(local)
