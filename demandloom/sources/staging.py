"""Written intermediate tables and size-checked broadcasts.

A staged table is Parquet in the shared checkpoint folder: it cuts lineage, survives
the loss of any executor, keeps column pruning and gives Catalyst true file sizes.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A lookup is broadcast only up to this many rows. Lookups hold a key and a few numbers
# (well under 100 bytes a row), so the bound is about 100 MB per executor.
BROADCAST_ROWS = 1_000_000

_LOCAL_ROOTS: dict[str, str] = {}
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _LOCAL_ROOTS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="demandloom-"))


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/demandloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[staged] = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads.

    For the frames that ``stage`` returned, once everything built on them is written itself: a lost
    executor must not need them again.
    """
    for staged in tables:
        path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(staged))
        path.getFileSystem(staged.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a row count; beyond the bound the join stays a shuffle join.

    For cheap inputs (dimension files, staged tables), because the count runs the plan.
    """
    bound = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def stage_lookup(df: DataFrame, label: str, max_rows: int | None = None) -> DataFrame:
    """Stage an aggregate of the facts and broadcast it when its size allows.

    Rows are counted while they are written, so the check costs no job. A retried task may
    count twice, which can only turn a broadcast into a shuffle join.
    """
    counter = Observation()
    staged = stage(df.observe(counter, F.count(F.lit(1)).alias("rows")), label)
    bound = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(staged) if counter.get["rows"] <= bound else staged
