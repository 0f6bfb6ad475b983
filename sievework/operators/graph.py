"""Connected components, and the reliable cut of a plan's lineage that iterations need."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the whole cluster shares.

    Where neither it nor a checkpoint folder is set, a local master (tests) gets a
    temporary one, and a cluster an error, as its executors couldn't read each other's files.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="sievework-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there.

    A table read again carries neither the plan nor what Spark had inferred of it,
    which grows with each round of an iteration, and its size is known. Row groups are
    small, as readers hold up to one of them at once however long its rows are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievework-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame, shuffled: bool = True) -> None:
    """Delete the files of frames that ``cut`` returned and that nothing reads any more; with ``shuffled`` what was shuffled for them too.

    Spark deletes shuffle files when the driver collects its garbage, so that is asked for.
    """
    sc = frames[0].sparkSession.sparkContext
    for df in frames:
        path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if shuffled:
        del frames, df
        gc.collect()
        sc._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b), both bigint; ``label`` is the component's least node.

    Each round a node takes the least label among its own, its neighbours' and
    that label's own label, so far-off labels are reached in few rounds. A hub's
    edges are combined before the shuffle and its join is one that Spark splits.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        labels = state.select("node", "label")
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        heard = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = cut(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = cut(new.join(jump, "label").select("node", "old", F.least("label", "root").alias("label")))
        discard(state, new, shuffled=False)
        if after.where("label <> old").isEmpty():
            del labels, seen, heard, new, jump, state
            discard(both)
            return after.select("node", "label")
        state = after
