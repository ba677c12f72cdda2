"""Small helpers of the operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows beyond which a side is joined by shuffle rather than broadcast; its rows are a few numbers each.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut; lost executors cost nothing of it."""
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a session without executors of its own may go without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Sent:
    """A value of bounded size for every task: broadcast as a pickle that holds its classes, so workers need no copy of them."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._pickled = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self) -> dict:
        return {"_pickled": self._pickled, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._pickled.value)
        return self._value


def small(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a stored frame for broadcast if its counted rows are within the bound; else Spark shuffles."""
    bound = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(frame) if frame.limit(bound + 1).count() <= bound else frame


def unit(*parts) -> F.Column:
    """A number in (0, 1) from the parts, the same in every run and engine: 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shared_prefix(a: str | bytes, b: str | bytes) -> int:
    """The length of the longest common prefix, by halving: whole slices are compared."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low
