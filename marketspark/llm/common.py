"""Helpers shared by the training-data operators: staging, identities, connected groups.

Intermediate tables go to the folder that all executors share: the one the cluster
names in ``spark.checkpoint.dir``. Only in local mode, where driver and executors are one
process, a temporary folder stands in for it. A staged table cuts the lineage, so a lost
executor costs a re-read and no recomputation of what came before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_results: list[str] = []  # paths that returned DataFrames still read
MASKS = 1 << 18  # words of 64 bits
#: Spark's setting by which a finished query's shuffle files go at once, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; raises where a cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder by Spark's own file systems, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns it as read back, for results: the files stay until drop_results()."""
    path = new_path(df.sparkSession, name)
    _results.append(path)
    return _written(df, path)


def staged_so_far() -> list[str]:
    """The paths that stage() has written in this process and that are still there."""
    return list(_results)


def drop_results(spark: SparkSession, paths: list[str], read: DataFrame | None = None) -> None:
    """Deletes these of the paths that stage() wrote, but for those with files that ``read`` reads.

    For callers that have written the results elsewhere and won't read the returned
    DataFrames again.
    """
    used = read.inputFiles() if read is not None and paths else []
    for path in paths:
        if path in _results and not any(path.rsplit("/", 1)[1] in f for f in used):
            delete(spark, path)
            _results.remove(path)


class Scratch:
    """Tables on the way to a result. drop() deletes them as soon as what follows is written.

    Used as a context: at its end all are deleted, also after an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths[path] = name
        return _written(df, path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names; without names, all."""
        for path, name in list(self.paths.items()):
            if not names or name in names:
                delete(self.spark, path)
                del self.paths[path]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that df has none like: longer than any of its own."""
    longest = max([len(c) for c in df.columns], default=0)
    return [f"{name}_{'x' * longest}" for name in names]


def parted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts, without a shuffle: rows whose key may be in keys' one column, and rows whose key is not.

    A bit map of the keys' hashes, MASKS words at most, is broadcast. With more keys than it
    can tell apart more rows may come into the first part, none into the wrong one, so an exact
    join of that part alone gives what a join of df would. For joins that meet few of df's rows.
    Such a join is asked for as a merge join, as all are whose other side grows with the
    documents: the same plan at every size, and no broadcast of a table without a bound.
    """
    word, bit, mask, hit = new_names(df, "word", "bit", "mask", "hit")

    def places(c: Column) -> list[Column]:
        h = F.xxhash64(F.lit(3), c)
        return [F.pmod(h, F.lit(MASKS)).alias(word), F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int").alias(bit)]

    masks = keys.select(*places(F.col(keys.columns[0]))).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(mask))
    masks = stage(masks, "masks")
    marked = df.select("*", *places(key)).join(F.broadcast(masks), word, "left")
    marked = marked.withColumn(hit, F.coalesce(F.expr(f"(shiftrightunsigned({mask}, {bit}) & 1L) = 1L"), F.lit(False)))
    return tuple(marked.where(c).drop(word, bit, mask, hit) for c in (F.col(hit), ~F.col(hit)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(n: int | Column, *cols: Column | str) -> Column:
    """A bucket from 0 to n - 1, by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n)


def component_labels(edges: DataFrame, kept: Scratch, rounds: int = 60) -> DataFrame:
    """Smallest node of each connected group: (node, root) for every node of edges (u, v).

    Every round links each node's neighbours to the smallest label known, then jumps
    labels to their own label, so that the rounds grow with the logarithm of the
    longest path. Labels and edges stay distributed; only a count of changes comes back.
    Raises if ``rounds`` didn't suffice. No edges: no rows. The result is staged in ``kept``.
    """
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.stage(
            edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
            "edges",
        )
        labels = scratch.stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "labels-0")
        for number in range(1, rounds + 1):
            offered = (
                both.join(labels, both.u == labels.node)
                .groupBy(F.col("v").alias("at"))
                .agg(F.min("root").alias("offer"))
            )
            # What the neighbours know reaches the node and the node's present root.
            lowered = labels.join(offered, labels.node == offered["at"]).select("node", "root", F.least("root", "offer").alias("low"))
            lowered = scratch.stage(lowered, "lowered")
            hooks = lowered.where("low < root").groupBy(F.col("root").alias("hook")).agg(F.min("low").alias("hook_low"))
            step = lowered.join(hooks, lowered.node == hooks.hook, "left").select(
                "node", "root", F.least("low", F.coalesce("hook_low", "low")).alias("low")
            )
            jump = step.select(F.col("node").alias("at"), F.col("low").alias("next"))
            new = scratch.stage(
                step.join(jump, step.low == jump["at"]).select("node", F.least("low", "next").alias("root"), (F.col("root") != F.least("low", "next")).alias("moved")),
                f"labels-{number}",
            )
            scratch.drop("lowered", f"labels-{number - 1}")
            labels = new.select("node", "root")
            if not new.where("moved").limit(1).count():
                return kept.stage(labels, "labels")
    raise RuntimeError(f"the groups didn't settle in {rounds} rounds")
