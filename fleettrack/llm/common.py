"""Helpers shared by the corpus operators: shared-folder tables, text batches, table access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local mode (one process, as in tests) has a temporary one; a cluster has none, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="fleettrack-"))
    return _own_dir[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table to the shared folder and read back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a plan may hold whose rows come in the same order whenever they are read.
SAME_ORDER = {"Project", "Filter", "SubqueryAlias", "View", "Union", "LogicalRelation", "LocalRelation", "Range"}


def same_order(df: DataFrame) -> bool:
    """Whether each reading of `df` gives its rows in the same order and partitions: files and local rows, filtered at most. Shuffles deal theirs out as they arrive. False where the plan can't be seen."""
    frame = getattr(df, "_jdf", None)
    todo = [frame.queryExecution().analyzed()] if frame else []
    while todo:
        node = todo.pop()
        if node.nodeName() not in SAME_ORDER or not node.deterministic():
            return False
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return bool(frame)


def mark() -> int:
    """How many tables `stored` has made; for `made_since`."""
    return len(_made)


def made_since(number: int) -> list[str]:
    """Places of the tables that `stored` has made since `mark` gave `number`."""
    return [p for p in _made[number:] if p]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no frame in use reads any more. Without a classic session they stay until the shared folder goes."""
    jvm = getattr(spark, "_jvm", None)
    for p in paths if jvm else ():
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in _made:
            _made[_made.index(p)] = ""


def place_of(df: DataFrame) -> str:
    """Where `stored` put `df`, which was the last to be stored."""
    return _made[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame, least: int = 1) -> int:
    """Partitions for a keyed repartition: the session's setting."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that Python holds few whole texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
