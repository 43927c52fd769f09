"""Session helpers shared by every operator: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest plan-time estimate (bytes) of a side that may be hinted for broadcast.
BROADCAST_LIMIT = 32 * 1024 * 1024


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="colloquy-")
    atexit.register(shutil.rmtree, own, True)
    path = os.path.join(own, "colloquy.zip")
    with zipfile.ZipFile(path, "w") as z:  # the driver's own file; Spark serves it to the executors
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("colloquy", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Only a session in one local process may go without a setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"colloquy-{spark.sparkContext.applicationId}")


_folders: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; deleted when its driver ends."""
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete an application's written tables and checkpoints, unless its session is gone before."""
    context = spark.sparkContext
    if context._jsc is None:  # stopped: whoever owns the folder cleans it
        return
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except (OSError, Py4JError) as e:
        print(f"colloquy: {folder} is left: {e}", file=sys.stderr)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor never costs the result."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(own_dir(df.sparkSession))
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a cut whose columns stay prunable."""
    ship(df.sparkSession)
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint df for broadcast when its estimated size is under limit; else leave the join to Catalyst."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint df, a side of a join that grows with the input, for a sort-merge join.

    Left to itself, Catalyst goes by bytes of files or shuffles; what these unpack to is several times as much, and
    would be collected by the driver join by join.
    """
    return df.hint("merge")


#: Bytes of files a task of costly per-row work should stand for, at most.
SPREAD_BYTES = 32 * 1024 * 1024
_SHUFFLES = ("Aggregate", "Join", "Window", "Sort", "Repartition", "Distinct", "Deduplicate")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give costly per-row work enough partitions.

    A plain scan of as many splits as there are cores, or more, is left as it is. Anything else is shuffled by the
    keys into as many partitions as its files' size asks for: what comes out of a shuffle would be coalesced by bytes,
    which says nothing of the work per row.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if not any(x in text for x in _SHUFFLES) and df.rdd.getNumPartitions() >= cores:
        return df
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # rows without files report no size
    return df.repartition(min(max(2 * cores, -(-known // SPREAD_BYTES)), 1_000_000), *keys)
