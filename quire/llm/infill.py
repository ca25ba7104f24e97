"""Fill-in-the-middle examples: texts are cut at two of their units and put together in another order (Bavarian et al., 2022)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, text_or_empty

#: Patterns of units by name. Their matches follow each other without gaps from the start of any text to its end.
UNITS = {"char": r"[\s\S]", "word": r"(?:\s*\S+|\s+)", "line": r"(?:[^\n]*\n|[^\n]+)"}
#: Marks of prefix, suffix and middle. A text that has one stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units that one row of the relation of units stands for; only the rows in which a cut lies are looked into.
RUN = 512
#: Of 100 documents so many are left plain, and of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that doc_id and the seed decide: the first digits of a SHA-256. A null id counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and key: rows with the same doc_id and text have the same key, and so the same cuts."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "text"))))


def placed_runs(docs: DataFrame, unit: str) -> DataFrame:
    """doc_id, key, place (from 0), units, chars, before (characters before it) and n (the text's units) of each run of units.

    A text is taken apart where it lies and only lengths are shuffled. Rows that repeat are merged before the windows, so
    that a document that is there a million times doesn't meet in one task.
    """
    run = F.regexp_extract_all("text", F.lit(f"{UNITS[unit]}{{1,{RUN}}}+"), F.lit(0))
    rows = keyed(docs).withColumn("runs", run).select("doc_id", "key", F.size("runs").alias("of"), F.posexplode("runs").alias("place", "run"))
    # all runs but the last are full
    units = F.when(F.col("place") < F.col("of") - 1, F.lit(RUN)).otherwise(F.regexp_count("run", F.lit(UNITS[unit])))
    rows = rows.select("doc_id", "key", "place", F.length("run").cast("long").alias("chars"), units.cast("long").alias("units"))
    by = Window.partitionBy("key")
    before = F.coalesce(F.sum("chars").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = by.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.distinct().withColumns({"before": before, "n": F.sum("units").over(whole)})


def cut_offsets(runs: DataFrame, seed: int) -> DataFrame:
    """key, n, and first and second: the runs in which the two cuts lie, with the units of them that are before the cut.

    A cut after unit number u asks for that unit by its ordinal; one before all units asks for none and is null.
    """
    h1, h2, *_ = draws(F.col("doc_id"), seed)
    cuts = [F.pmod(h, F.col("n") + 1) for h in (h1, h2)]
    asked = F.array(F.struct(F.lit(1).alias("cut"), F.least(*cuts).alias("unit")), F.struct(F.lit(2).alias("cut"), F.greatest(*cuts).alias("unit")))
    requests = runs.filter("place = 0").select("key", "n", F.inline(asked))
    at = F.floor((F.col("unit") - 1) / RUN).cast("int")
    requests = requests.select("key", "n", "cut", F.when(F.col("unit") > 0, at).alias("place"), (F.col("unit") - at * RUN).alias("rest"))
    found = requests.join(runs.select("key", "place", "before", "chars", "units"), ["key", "place"], "left")
    where = F.when(F.col("before").isNotNull(), F.struct("before", "chars", "units", "rest"))
    return found.groupBy("key").agg(F.max("n").alias("n"), F.max(F.when(F.col("cut") == 1, where)).alias("first"), F.max(F.when(F.col("cut") == 2, where)).alias("second"))


def chars_before(cut: Column, unit: str) -> Column:
    """How many characters of the text are before a cut. Where a run has as many characters as units, each unit is one."""
    run = F.substring(F.col("text"), (cut["before"] + 1).cast("int"), cut["chars"].cast("int"))
    units = F.slice(F.regexp_extract_all(run, F.lit(UNITS[unit]), F.lit(0)), F.lit(1), cut["rest"].cast("int"))
    inside = F.when(cut["chars"] == cut["units"], cut["rest"]).otherwise(F.aggregate(units, F.lit(0).cast("long"), lambda so_far, u: so_far + F.length(u)))
    return F.coalesce(cut["before"] + inside, F.lit(0).cast("long"))


def restored(output: Column, form: Column) -> Column:
    """The text from what was made of it. Texts have no marks of their own, so the first mark of a kind is the one put in."""
    part = lambda since, to: F.substring(output, since, to - since)
    rest = lambda since: F.substring(output, since, F.length(output))
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    after = lambda at: at + 3
    psm = F.concat(part(after(p), s), rest(after(m)), part(after(s), m))
    spm = F.concat(part(after(p), m), rest(after(m)), part(after(s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infilled(docs: DataFrame, unit: str = "char", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and output of each document.

    Prefix, middle and suffix are cut after two numbers of units that doc_id, seed and n decide. Form is plain (output:
    the text) for empty texts, texts that have a mark, and for `plain` in 100 documents; spm (suffix, prefix, middle) for
    `suffix_first` in 100 of the others, else psm. Lengths are in code points, null where the form is plain. A null text
    is an empty one, a null doc_id draws like the word null. Rows that repeat come alike, each of them; other columns are
    not read; an empty table stays empty.

    The relation of units is stored, in runs of 512, so a text of any length is a few rows, and its own row is shuffled
    once, to meet its cuts. Rows of one key are split by Spark's skew join.
    """
    offsets = cut_offsets(stored(placed_runs(docs, unit)), seed)
    rows = keyed(docs).join(offsets, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    *_, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "from": chars_before(F.col("first"), unit), "to": chars_before(F.col("second"), unit)})
    part = lambda since, count: F.substring(F.col("text"), (since + 1).cast("int"), count.cast("int"))
    prefix, middle = part(F.lit(0), F.col("from")), part(F.col("from"), F.col("to") - F.col("from"))
    suffix = part(F.col("to"), F.length("text").cast("long"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_plain = F.col("form") == "plain"
    output = F.when(is_plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(
        "doc_id", "text", "n", "form", F.when(~is_plain, F.col("from")).alias("prefix_chars"), F.when(~is_plain, F.col("to") - F.col("from")).alias("middle_chars"), output.alias("output")
    )


def digests(docs: DataFrame) -> DataFrame:
    """What `infilled` makes of documents by code points, with SHA-256 of each output and of the text rebuilt from it."""
    made = infilled(docs)
    digest = lambda text: F.sha2(text, 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
