"""What the operators share: the folder all machines see, tables written to cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "lectern", *_scopes[-1:], f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write inside goes when the block ends; a result that is to outlive it has to be written elsewhere first."""
    _scopes.append("/".join([*_scopes[-1:], uuid.uuid4().hex]))
    try:
        yield
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern/{_scopes.pop()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(df: DataFrame, results: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """df with its columns named c0, c1, ..., so that an operator's own columns clash with none of them.

    Also the new name of each column, and Columns that give all of them back. A column named like one of `results`, in any
    case, comes back with underscores added.
    """
    inner = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    taken = {x.lower() for x in results} | {x.lower() for x in df.columns}
    back = []
    for k, c in enumerate(df.columns):
        name = c
        if c.lower() in {x.lower() for x in results}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        back.append(F.col(f"c{k}").alias(name))
    return inner, {c: f"c{k}" for k, c in enumerate(df.columns)}, back


def free(name: str, df: DataFrame) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Steps over a table's files that neither repeat rows nor mix them, so that file and place still tell rows apart.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "View"}


def _as_read(df: DataFrame) -> bool:
    """Whether each row of df is a row of its own in the Parquet files that it is read from."""
    steps = [df._jdf.queryExecution().analyzed()]
    while steps:
        step = steps.pop()
        if step.nodeName() not in _ROW_BY_ROW:
            return False
        children = step.children()
        steps += [children.apply(k) for k in range(children.size())]
    return True


def with_key(df: DataFrame, name: str) -> DataFrame:
    """df with a 64-bit name for each row that is the same in all readings: a hash of the file and the place it is read from.

    Rows that come from anything but the selected or filtered rows of Parquet files, such as joined, exploded, sampled or
    united ones, are written first and named by their places there. Two rows share a name with a chance of 2**-64.
    """
    if _as_read(df):
        try:
            place = df.metadataColumn("_metadata")
            return df.withColumn(name, F.xxhash64(place["file_path"], place["row_index"]))
        except AnalysisException:  # no files
            pass
    table = written(df, "rows")
    place = table.metadataColumn("_metadata")
    return table.withColumn(name, F.xxhash64(place["file_path"], place["row_index"]))


#: At most so many keys are handed out by broadcast.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined on key with a table of one row for each key, of which `weight` is the number of rows with that key.

    Keys of more than a HOT-th of the `total` rows, at most HOT of them, are broadcast, so that their rows stay where they
    are; no task of the shuffle for the others gets more than such a share for one key. how: inner or left.
    """
    hot = table.where(F.col(weight) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) * HOT <= total), key, how)
    return rows.join(F.broadcast(hot), key).select(*rest.columns).unionByName(rest)


def n_words(text: str | Column) -> Column:
    """How many words a text has; none for null."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+")
    # split() leaves an empty string where the text begins or ends with white space
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, root), root the smallest id, one per id that an edge names.

    Alternates large-star and small-star steps. Each step takes minima by a partially aggregated groupBy, writes them, and
    hands them back by a join: a small table of minima is broadcast, and of a large one Spark splits the partitions that a
    hub crowds, since a written table leaves both sides of the join free. So the neighbours of one id are never gathered in
    one task; nothing but a row count and a checksum reaches the driver. Loops and repeated edges are allowed. The number
    of rounds grows with the logarithm of the number of ids; beyond max_rounds it raises.
    """
    # u > v in every pair, in and out of each step
    def large(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("v").alias("w"), F.col("u").alias("other")).unionByName(pairs.select(F.col("u").alias("w"), F.col("v").alias("other")))
        low = written(both.groupBy("w").agg(F.least(F.min("other"), F.col("w")).alias("m")), "minima")
        return pairs.withColumnRenamed("v", "w").join(low, "w").select("u", F.col("m").alias("v"))

    def small(pairs: DataFrame) -> DataFrame:
        low = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = pairs.join(low, "u").where("v <> m")
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))

    def counted(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        mark = [F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")]
        out = written(pairs.distinct().observe(seen, *mark), "edges")
        return out, (seen.get["n"], seen.get["h"])

    now, seen = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now, got = counted(small(large(now)))
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("id"), "root").unionByName(
        stars.select(F.col("root").alias("id"), "root").distinct()
    )


def gapless(df: DataFrame, group: list[str], order: Column, name: str, buckets: int = 4096, weight: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a hash bucket and then of `order`.

    With a weight, each row gets the sum of the weights of those before it. No task gets a whole group: totals by (group,
    bucket) give each bucket its offset, and only a bucket is numbered by a window. `order` is a Column of hashes that
    tells rows apart and is the same in two readings. The columns of `group` must not be null; names that begin with
    gapless_ are taken.
    """
    rows = df.withColumn("gapless_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    one = F.col(weight) if weight else F.lit(1)
    totals = rows.groupBy(*group, "gapless_b").agg(F.sum(one).alias("gapless_n"))
    before = Window.partitionBy(*group).orderBy("gapless_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "gapless_b", F.coalesce(F.sum("gapless_n").over(before), F.lit(0)).alias("gapless_o"))
    own = Window.partitionBy(*group, "gapless_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("gapless_i", F.coalesce(F.sum(one).over(own), F.lit(0)))
    # equality on the window's own keys: the join takes its partitioning over
    return numbered.join(offsets, [*group, "gapless_b"]).select(*df.columns, (F.col("gapless_o") + F.col("gapless_i")).cast("long").alias(name))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 in the order of some columns that tell them apart: by ranges, so that no task sorts them all."""
    parts = written(df.repartitionByRange(*order).withColumn("ranked_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("ranked_p").agg(F.count(F.lit(1)).alias("ranked_n"))  # a row for each task
    before = Window.orderBy("ranked_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("ranked_p", F.coalesce(F.sum("ranked_n").over(before), F.lit(0)).alias("ranked_o"))
    own = F.row_number().over(Window.partitionBy("ranked_p").orderBy(*order))
    return parts.withColumn("ranked_i", own).join(F.broadcast(offsets), "ranked_p").select(*df.columns, (F.col("ranked_o") + F.col("ranked_i") - 1).alias(name))
