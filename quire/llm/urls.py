"""URL filters: pattern rules indexed by their rarest literal token, so that a URL runs few regular expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import HOT, blocks, broadcast_if_small, looked_up, stored
from quire.plans.storage import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of hosts and paths: verdict, and host with path. A rule fits its host, all subdomains, and paths that start so.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Patterns for the URLs that no host rule fits: adult, gambling and spam hosts, advertising paths, session links.
PATTERNS = (
    ("block", "||adult-*"), ("block", "||spam-*"), ("block", "||casino-*"), ("block", "||porn-*"), ("block", "||warez.*"), ("block", "/ads/"), ("block", "/adserver/"),
    ("block", "/xxx/"), ("block", "/gambling/"), ("block", "?sessionid="), ("block", "&sessionid="), ("allow", "/ads/policy/"),
)
DEFAULT = "allow"


def host_of(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and what follows it: after the first `://`, up to `/`, `?`, `#` or the end. Both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.substring(rest, F.length(host) + 1, F.length(url)), F.lit(""))


def tokens(text: Column) -> Column:
    """The runs of ASCII letters and digits of a text in lower case, each once, and the empty token, which every text has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))))


def literal_tokens(pattern: Column) -> Column:
    """Tokens that a URL must have if the pattern fits: runs that end on both sides at something that is no `*` and no open end."""
    closed = F.concat(F.when(pattern.startswith("|"), "").otherwise("*"), pattern, F.when(pattern.endswith("|"), "").otherwise("*"))
    return F.regexp_extract_all(F.translate(closed, UPPER, LOWER), F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0))


def regular(pattern: Column) -> Column:
    """The regular expression of a pattern over host, path, query and fragment.

    `||` at the start: a host or the part of one behind a dot; `|` at either end: the URL's; `*`: anything; `^`: a
    separator or the end. All else is literal, capitals included.
    """
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    body = F.regexp_replace(body, r"[\\.\[\](){}+?$|]", r"\\$0")
    body = F.replace(F.replace(body, F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|\z)")), F.lit("*"), F.lit(".*"))
    start = F.when(pattern.startswith("||"), r"(?s)^(?:[^/?#]*\.)?").when(pattern.startswith("|"), "(?s)^").otherwise("(?s)")
    return F.concat(start, body, F.when(pattern.endswith("|"), r"\z").otherwise(""))


def rules(spark: SparkSession, hosts: Sequence[tuple[str, str]] = HOST_RULES, patterns: Sequence[tuple[str, str]] = PATTERNS) -> DataFrame:
    """Host rules, which have names and go before, and patterns, which have none, as the table that `judged` takes."""
    made = [(path, f"||{path}", verdict, 1) for verdict, path in hosts] + [(None, pattern, verdict, 0) for verdict, pattern in patterns]
    return spark.createDataFrame(made, "name string, pattern string, verdict string, tier int")


def index(urls: DataFrame, ranked: DataFrame) -> DataFrame:
    """token, seen (URLs that have it), expression and rank: each rule under the rarest of its literal tokens.

    A rule without any comes under the empty token. urls: token. Ties go to the longer token, then the lesser.
    """
    own = ranked.select("rank", regular(F.col("pattern")).alias("expression"), literal_tokens(F.col("pattern")).alias("own"))
    own = own.select("rank", "expression", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.lit("")))).alias("token"))
    asked = own.select("token").distinct()
    few = broadcast_if_small(asked, asked.count())
    # a large table of rules meets tokens that are counted already, so that no frequent one is dealt out by itself
    seen = urls.groupBy("token").agg(F.count(F.lit(1)).alias("seen")) if few is asked else urls.join(few, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    counted = own.join(seen, "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rarest = F.min(F.struct("seen", (-F.length("token")).alias("short"), "token")).alias("best")
    return counted.groupBy("rank", "expression").agg(rarest).select("best.token", "best.seen", "expression", "rank")


def judged(pages: DataFrame, table: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every page.

    table: name, pattern, verdict and tier, as `rules` makes it. Of the rules that fit a URL the one of the highest tier
    decides, then the longest pattern, then one that blocks; rule is its name, verdict and pattern its own. A URL that
    none fits has null rule and pattern and the default verdict. A null URL or one without `://` has an empty host and
    path, and is judged as such. Rules without a pattern fit nothing. Pages that repeat come alike, each of them; other
    columns are not read; an empty table stays empty, and without rules all have the default.

    A URL meets only the rules that are indexed under one of its tokens. The index is broadcast if it is small; otherwise
    frequent tokens' rules are broadcast in blocks and the rest is joined by shuffling. Hits are merged before they are
    dealt out by URL, and meet the pages in a join whose frequent URLs Spark splits.
    """
    order = [F.col("tier"), F.length("pattern"), F.col("verdict") == "block", F.col("pattern"), F.col("name")]
    ranked = numbered(table.filter("pattern is not null"), "rank", *order).withColumn("rank", (F.col("rank") + 1).cast("long"))
    host, tail = host_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), tail.alias("tail"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat("host", "tail"))))
    urls = rows.select("key", F.concat("host", "tail").alias("subject"), F.explode(tokens(F.concat("host", "tail"))).alias("token"))
    found = stored(index(urls.select("token"), ranked))
    n = found.count()
    small = broadcast_if_small(found, n)
    parts = [small]
    if small is found:
        frequent = found.filter(F.col("seen") > HOT)
        parts = [found.filter(F.col("seen") <= HOT), *blocks(frequent, frequent.count(), F.col("rank"))]
    best = None
    for part in parts:
        hits = urls.join(part, "token").filter(F.rlike(F.col("subject"), F.col("expression"))).groupBy("key").agg(F.max("rank").alias("rank"))
        best = hits if best is None else best.unionByName(hits).groupBy("key").agg(F.max("rank").alias("rank"))
    none = F.lit(None).cast("string")
    said = ranked.select("rank", F.col("name").alias("rule"), "verdict", "pattern")
    said = said.unionByName(pages.sparkSession.range(1).select(F.lit(0).cast("long").alias("rank"), none.alias("rule"), F.lit(default).alias("verdict"), none.alias("pattern")))
    rows = rows.join(best, "key", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    rows = rows.select("page_id", "host", F.regexp_extract("tail", r"^[^?#]*", 0).alias("path"), "rank")
    return looked_up(rows, said, "rank", n + 1).select("page_id", "host", "path", "rule", "verdict", "pattern")
