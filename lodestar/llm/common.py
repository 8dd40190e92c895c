"""What the training-data operators share: checkpoints, text normalisation, components."""

from __future__ import annotations

import ctypes
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir (see shared_folder).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, else of its configuration.

    Where neither names one, a temporary folder serves on a local master, as in tests. On a
    cluster there is no such folder that all machines see, so that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Bytes of an Arrow batch that Spark makes for a worker.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH bytes, unless they ended sooner.

    Otherwise they end at 10,000 rows or 64 MB: some 20 MB of texts, which stand in the JVM, whose
    allocator keeps such room, and again in the worker. Results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def freed(work):
    """work, for mapInArrow, after whose last row the worker gives unused memory back to the system.

    Spark keeps a worker for later tasks, and for a minute without any, beside a JVM that needs the room.
    """

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """A name like `name` that no column of docs has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, and that column's name.

    Numbers follow from where rows are stored, so two reads agree on a stored table only.
    """
    name = fresh(docs, "__row")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose numbers (see numbered) the one column of rows holds (left_semi) or lacks (left_anti)."""
    counted, name = numbered(docs)
    return counted.join(rows.toDF(name), name, how).select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


#: Links up to which components are found on the driver: 3 MB.
FEW = 200_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = np.split(ends, 2)
    label, was = np.arange(len(nodes)), None
    while was is None or (label != was).any():
        was = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    return nodes, nodes[label]


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root), root the smallest node reachable.

    Up to FEW distinct links are joined on the driver: every round on the executors writes two
    checkpoints of a file for each partition, however few the rows. More links stay there:
    minimum labels spread along the links and are then short-cut by pointer jumping, so the
    rounds grow with the logarithm of the longest path in practice. Each round reads labels
    from a checkpoint, so both sides of each join are plain exchanges that adaptive
    execution can split at hubs; the minimum itself is combined before the shuffle.
    No links: no rows.
    """
    once = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if once.count() <= FEW:
        few = once.toArrow()
        nodes, roots = _roots(*(few.column(x).to_numpy().astype(np.int64) for x in "ab"))
        return links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}), "node long, root long")
    both = once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    total = None
    while True:
        said = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "root")
        spread = cut(labels.union(said).groupBy("node").agg(F.min("root").alias("root")))
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = cut(spread.join(jump, "root").select("node", F.col("further").alias("root")))
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
