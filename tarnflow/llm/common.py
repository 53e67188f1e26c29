"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators' contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once in the shared folder and read back: cuts lineage so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> F.Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


#: Each empties what an operator keeps in a worker process between its tasks.
KEPT: list[Callable[[], None]] = []


def lean(forget: bool = True) -> None:
    """Gives a worker's free memory back to the system; with forget, also what other operators keep in it. Workers outlive a stage."""
    if forget:
        for drop in KEPT:
            drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def leaving_none(run: Callable[[Iterator], Iterator], forget: bool = True) -> Callable[[Iterator], Iterator]:
    """A task's function for mapInArrow or mapInPandas that leaves no free memory in its worker: an idle worker keeps what it has.

    Memory is given back when run has ended, so that what it held is free by then.
    """

    def task(batches: Iterator) -> Iterator:
        lean(forget)
        yield from run(batches)
        lean(forget)

    return task


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
