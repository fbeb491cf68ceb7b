"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker looks at together. Spark bounds the batches
#: it sends by bytes itself (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of a few numbers, or of texts, that fill a partition of some MB.
NUMBER_ROWS, TEXT_ROWS = 1 << 18, 1 << 12


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string, null becomes empty).

    Every operator starts here, so other columns of the input, whatever they
    are called, can't clash with the names an operator works with.
    """
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to BATCH_ROWS rows and BATCH_BYTES of a text column; one row may be longer."""
    for b in batches:
        ends = [0, *pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).cumsum(dtype="int64").tolist()]
        at = 0
        while at < b.num_rows:
            upto = at + 1
            while upto < b.num_rows and upto - at < BATCH_ROWS and ends[upto + 1] - ends[at] <= BATCH_BYTES:
                upto += 1
            yield b.slice(at, upto - at)
            at = upto


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in local mode without that setting gets one of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif sc.master.split("[")[0] == "local":
            named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


#: Of each open ``scratch``, innermost last, what was made inside: paths, and tables as (path, name).
_made: list[list[tuple[str, str | None]]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At the end deletes all that ``cut``, ``written`` and ``stored`` made inside.

    A result that is still to be read goes through ``lasting`` first.
    """
    _made.append([])
    try:
        yield
    finally:
        for path, name in _made.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def noted(path: str, name: str | None = None, outer: bool = False) -> None:
    open_ = _made[:-1] if outer else _made
    if open_:
        open_[-1].append((path, name))


def gathered(df: DataFrame, rows: int, each: int = NUMBER_ROWS) -> DataFrame:
    """The same rows in at most two partitions a core, or one for each so many rows if that is more.

    Where Spark doesn't join small partitions itself, a stored table has a file for
    each one, and to make a file Hadoop starts two processes (``chmod``) from the
    executor on a local disk. ``rows`` is about what ``df`` has at most; it bounds
    nothing but the number of partitions.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def cut(df: DataFrame, outer: bool = False) -> DataFrame:
    """Cut the lineage of a small table by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        noted(file.get(), outer=outer)
    return out


def lasting(df: DataFrame) -> DataFrame:
    """The rows of ``df`` once computed, so that they outlive the ``scratch`` around (but not the one around that)."""
    return cut(df, outer=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write inside removes its shuffle files when it has ended; the setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    noted(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str, parts: int, by: str) -> DataFrame:
    """Write a table in the shared folder, bucketed, so that joins by that column don't move it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    noted(path, table)
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, by).saveAsTable(table)
    return spark.table(table)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node``, ``component``
    (the component's smallest node) for each node that has an edge. Each round
    is a partial aggregate and an equi-join, so a node with very many edges is
    pre-aggregated and its join can be split; nothing but two numbers a round
    reaches the driver. Nulls and self loops are dropped; no edges give no rows.
    ``rows`` is about how many edges there are at most, if that is known (``gathered``).
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.filter("u is not null and v is not null and u != v").distinct()
    e = cut(e if rows is None else gathered(e, rows))
    sums = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    mark = e.agg(*sums).first()
    for _ in range(most_rounds):
        # large star: neighbours above a node move to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        e1 = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below move to the smallest of them
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        moved = e1.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(gathered(moved.select("x.u", "x.v").filter("u != v").distinct(), mark[0]))
        now = e.agg(*sums).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.withColumn("component", F.col("node")))
