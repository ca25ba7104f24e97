"""How tables are stored and met: written once where a plan would compute them for each branch, numbered, and paired in blocks."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Questions that are broadcast, and questions of one block if there are more; their bytes are bounded too.
FEW, FEW_BYTES = 10_000, 32 << 20
#: Rows of keys and numbers that are broadcast.
FEW_KEYS = 100_000
#: The folders of this process's applications, and stored tables by what they are made of.
KEPT: dict[str, SparkSession] = {}
MADE: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder in the one of spark.checkpoint.dir, which executors share; it goes when the program ends.

    Where none is set, a program on one machine has one beside its warehouse; on a cluster that would be a folder of the
    driver's machine, so there it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {context.master} share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints")
    path = context._jsc.sc().getCheckpointDir().get()
    # Spark makes it for this application alone; checkpoints in it are of no use to another one
    KEPT[path] = spark
    return path


def written(df: DataFrame) -> str:
    """Where df has been written to as Parquet, in the shared folder; the files go when the program ends."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again.

    What follows scans only the columns that it needs, has a size to choose joins by, and can be computed again from
    the files when executors are lost.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def table_of(path: str) -> str:
    """The name in the catalog of a table that is stored in buckets."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def written_by(df: DataFrame, key: str, parts: int) -> str:
    """Where df has been written to in so many buckets of a key: what reads it from the catalog need not deal it out again."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(parts, key).saveAsTable(table_of(path))
    return path


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    name = table_of(path)
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


@contextmanager
def dealt_by(spark: SparkSession) -> Iterator[None]:
    """While this lasts, tables dealt out by a part of a join's keys meet as they lie, without being dealt out again."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def forget() -> None:
    """Delete what has been stored, as long as the session that wrote it still runs."""
    for path, spark in KEPT.items():
        if (context := spark.sparkContext)._jsc is not None:
            file = context._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(context._jsc.hadoopConfiguration()).delete(file, True)
    KEPT.clear()
    MADE.clear()


def stored_once(name: str, sources: list[DataFrame], make: Callable[[], DataFrame | str]) -> DataFrame:
    """make(), stored the first time that this application asks for it over these files as they are now; or where make has stored it."""
    spark = sources[0].sparkSession
    hadoop, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = sorted(f for df in sources for f in df.inputFiles())
    state = []
    for f in files:
        status = path_of(f).getFileSystem(hadoop).getFileStatus(path_of(f))
        state.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, *state)
    there = key in MADE and path_of(MADE[key]).getFileSystem(hadoop).exists(path_of(f"{MADE[key]}/_SUCCESS"))
    if not there:
        made = make()
        MADE[key] = made if isinstance(made, str) else written(made)
    return read_stored(spark, MADE[key])


def asked_of(rows: DataFrame, questions: DataFrame, on: Column | None = None, few: int = FEW) -> DataFrame:
    """Each row with each of all questions, however many, if `on` holds or isn't given.

    Questions are broadcast only if they are counted as few and measured as small. Otherwise they are dealt into blocks,
    and each task pairs one block with one part of the rows, so that no task and no driver holds all questions.
    """
    n, size = questions.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct(*questions.columns)))), F.lit(0))).first()
    if n <= few and size <= FEW_BYTES:
        return rows.join(F.broadcast(questions), on)
    blocks = max(-(-n // few), -(-size // FEW_BYTES))
    return rows.join(questions.repartition(blocks).hint("shuffle_replicate_nl"), on)


def kept(rows: DataFrame, table: DataFrame, n: int, how: str, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """rows joined to a stored table of n narrow rows, which is broadcast only if these are few."""
    return rows.join(F.broadcast(table) if n <= FEW_KEYS else table, list(keys), how)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows, stored, with their places from 0 in this order as `name`: counted by parts of the sort, not in one task."""
    placed = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part of the sort
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + inside).drop("__at", "__part", "__before")


def numbered_in(rows: DataFrame, name: str, groups: Sequence[str], *order: Column | str) -> DataFrame:
    """rows with their places from 0 as `name`, in the order of groups (columns without nulls) and in each of `order`.

    Groups alone are counted and put in one order; rows are counted within their group, so that rows which lie in these
    groups already aren't dealt out, and none are stored on the way. A group's rows are counted in one task.
    """
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    placed = stored(sizes.orderBy(*groups).withColumn("__part", F.spark_partition_id()))
    sums, earlier = placed.groupBy("__part").agg(F.sum("__n").alias("__sum")), lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each part of the sort
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier(Window.orderBy("__part"))), F.lit(0)).alias("__offset"))
    inside = F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__part").orderBy(*groups))), F.lit(0))
    before = placed.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").select(*groups, (F.col("__offset") + F.col("__inside")).alias("__before"))
    counted = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return counted.join(before, list(groups)).select(*rows.columns, (F.col("__before") + F.col("__at") - 1).alias(name))
