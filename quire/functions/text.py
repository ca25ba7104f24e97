"""Scalar functions over text, as Column expressions: canonical forms, hashes, tests and tokens."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of one chunk are joined by these two characters, a backslash and an n.
PART_JOIN = r"\n"

# The patterns that tell headings, list items, labelled values and periods.
HEADING_NUMBER = r"(?U)^\s*(\d+(?:\.\d+)*)\.?\s+\S+"
LIST_MARK = r"(?U)^\s*(?:[-*•]\s+|\(?\d+[).\]]\s+|\(?[a-zA-Z][).\]]\s+)"
KEY_VALUE = r"(?Umd)^\s*([A-Za-z][A-Za-z0-9\s\-]+?)\s*[:\-]\s*(.+?)\s*$"
PERIOD = r"(?i)(Q[1-4]\s*\d{4}|FY\s*\d{4})"
TABLE_MENTION = r"(?iU)\bTable\s+(\d+)\b"
FIGURE_MENTION = r"(?iU)\bFigure\s+(\d+)\b"

# Words that don't count as the substance of a claim.
CLAIM_STOPWORDS = (
    "the and is in to be this that not should would could are was were been have has had do does did will can may might "
    "must shall say says said report reports verified verification verify every all any some it its or for on with as at "
    "by from an if no so than but when which who what where how"
).split()


#: The characters that are white space, in ASCII and beyond.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space, also beyond ASCII, at both ends; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def visible_at(text: Column, place: int) -> Column:
    """Whether the character at a place (-1: the last) is in ASCII and no white space."""
    return F.substring(text, place, 1).between("!", "~")


def strip_column(text: Column) -> Column:
    """As strip, for a column of a table: texts that begin and end with visible ASCII, as most do, aren't looked through for white space."""
    return F.when(visible_at(text, 1) & visible_at(text, -1), text).otherwise(strip(text))


def ascii_only(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def plain_spaces(text: Column) -> Column:
    """Whether a stripped text surely has no white space but single spaces: no pattern is needed for most texts."""
    return reduce(Column.__and__, [~F.contains(text, F.lit(c)) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")], ascii_only(text))


def canonical_text(text: Column, stripped: bool = False) -> Column:
    t = text if stripped else strip(text)
    return F.when(plain_spaces(t), t).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column, stripped: bool = False) -> Column:
    t = text if stripped else strip(text)
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(t == "", 0).when(plain_spaces(t), spaces + 1).otherwise(F.size(F.split(t, r"(?U)\s+")))


def content_hash(content_type: Column, text: Column, payload: Column | None = None, stripped: bool = False) -> Column:
    """16 hex digits of the SHA-256 of type, canonical text and, unless null or empty, the payload's canonical JSON."""
    last = F.lit(None).cast("string") if payload is None else F.nullif(payload, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", content_type, canonical_text(text, stripped), last).cast("binary"), 256), 1, 16)


def json_string(text: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay as they are. Only texts with something to escape need a writer."""
    array = F.to_json(F.array(text))
    escaped = F.substring(array, F.lit(2), F.length(array) - 2)
    return F.when(F.rlike(text, F.lit(r'^[^\x00-\x1f"\\\x7f-\x9f]*\z')), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(escaped)


def json_ascii(json: Column) -> Column:
    """JSON text with its characters beyond ASCII as escapes, those beyond 16 bits as two."""
    code = lambda c: F.ascii(c)
    one = lambda n: F.format_string("\\u%04x", n)
    pair = lambda n: F.concat(one(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), one(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
    escaped = lambda c: F.when(code(c) < 128, c).when(code(c) < 0x10000, one(code(c))).otherwise(pair(code(c)))
    return F.when(ascii_only(json), json).otherwise(F.array_join(F.transform(F.split(json, ""), escaped), ""))


def json_list(items: Column, write) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, write), ", "), F.lit("]"))


def json_object(fields: Iterable[tuple[str, Column]]) -> Column:
    """An object of the fields in the given order, null ones left out, with a space after commas and colons."""
    # a null makes its part null, so that no value is computed once to test it and once more to write it
    parts = [F.concat(F.lit(f'"{name}": '), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def looks_like_heading(text: Column, stripped: bool = False) -> Column:
    """A short numbered line, or a shorter one with letters, all of them capitals."""
    t = text if stripped else strip(text)
    # cheap tests that most texts fail come first
    may = F.substring(t, 1, 1).between("0", "9") | ~ascii_only(F.substring(t, 1, 1))
    numbered = (F.length(t) <= 80) & may & F.rlike(t, F.lit(HEADING_NUMBER))
    capitals = (F.length(t) <= 60) & (F.upper(t) == t) & F.rlike(t, F.lit(r"\p{Lu}")) & ~F.rlike(t, F.lit(r"[\p{L}&&[^\p{Lu}]]"))
    return numbered | capitals


def is_list_item(text: Column, stripped: bool = False) -> Column:
    """Whether the first line starts with a bullet, or a number or letter with a mark."""
    t = text if stripped else strip(text)
    return F.rlike(F.when(plain_spaces(t), t).otherwise(F.get(F.split(t, r"\R", 2), F.lit(0))), F.lit(LIST_MARK))


def heading_level(title: Column) -> Column:
    """One more than the dots of the leading section number; 1 without one."""
    number = F.regexp_extract(strip(title), r"^(\d+(?:\.\d+)*)\.?\s*", 1)
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1


def claim_terms(claim: Column) -> Column:
    """The distinct lower-case words of two or more characters."""
    return F.array_distinct(F.transform(F.filter(words(claim), lambda w: F.length(w) >= 2), F.lower))


def substantive_terms(claim: Column) -> Column:
    return F.array_except(claim_terms(claim), F.array(*[F.lit(w) for w in CLAIM_STOPWORDS]))


def topic_tokens(topic: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(strip(topic)), r"(?U)\W+"), lambda w: F.length(w) > 1))


def query_terms(query: Column, most: int = 10) -> Column:
    return F.slice(words(query), 1, most)


def snippet(text: Column, most: int = 300) -> Column:
    return strip(F.substring(text, 1, most))


def key_values(text: Column) -> Column:
    """An array of (metric, value) for labelled lines that keep the limits on length; see may_have_key_values."""
    t = strip(text)
    pairs = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(KEY_VALUE), F.lit(1)).alias("metric"), F.regexp_extract_all(t, F.lit(KEY_VALUE), F.lit(2)).alias("value")
    )
    pairs = F.transform(pairs, lambda p: F.struct(strip(p["metric"]).alias("metric"), strip(p["value"]).alias("value")))
    short = lambda p: (F.length(p["metric"]) <= 50) & (F.length(p["value"]) <= 200) & ~F.rlike(p["metric"], F.lit(r"^\d+$"))
    return F.when(F.length(t) >= 3, F.filter(pairs, short)).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def may_have_key_values(text: Column) -> Column:
    """Whether a text has a mark that each labelled line has."""
    return F.contains(text, F.lit(":")) | F.contains(text, F.lit("-"))


def may_have_periods(text: Column) -> Column:
    """Whether a text has letters that each period has."""
    low = F.lower(text)
    return F.contains(low, F.lit("q")) | F.contains(low, F.lit("fy"))


def periods(text: Column) -> Column:
    """Distinct quarters and fiscal years as written, in order."""
    t = strip(text)
    return F.when(F.length(t) >= 3, F.array_distinct(F.regexp_extract_all(t, F.lit(PERIOD), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def without_code_fence(text: Column) -> Column:
    """The content of a fenced Markdown block, or the text itself."""
    t = strip(text)
    inner = F.regexp_extract(t, r"(?s)^```(?:json|JSON)?\s*\n?(.*?)\n?\s*```\s*$", 1)
    return F.when(F.startswith(t, F.lit("```")), strip(inner)).otherwise(t)


def utc_text(time: Column) -> Column:
    """A time as ISO text in UTC, to the microsecond."""
    return F.concat(F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def utc_time(text: Column) -> Column:
    """The time that ISO text says; a Z is UTC. Null for what is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def language_code(text: Column) -> Column:
    """The code in lower case if it is two to five ASCII letters, else null."""
    code = F.lower(strip(text))
    return F.when(F.rlike(code, F.lit("^[a-z]{2,5}$")), code)
