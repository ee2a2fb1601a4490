"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: ASCII white space, as every word rule here has it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else os.path.join(tempfile.gettempdir(), "rangeforge-checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there.

    What was shuffled for earlier cuts is of no more use, but Spark keeps the
    files until the driver's references to them are collected, which may take
    half an hour. They are collected here, so that a loop holds the files of its
    last rounds only.
    """
    shared_folder(df.sparkSession)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df.checkpoint(eager=True)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes for no column of df to have it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def joined_by_hot_keys(rows: DataFrame, named: DataFrame, key: str, copies: str, *, hot: int = 1000) -> DataFrame:
    """rows joined with named (one row a key, `copies` of which are in rows) on key.

    A key with over one in `hot` of all rows is hot: there are fewer than `hot`
    of those, so they are broadcast and their rows stay where they are; all
    other keys are dealt by an exchange.
    """
    total = named.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    often = F.broadcast(named.where(F.col(copies) * hot > total))
    seldom = rows.join(often.select(key), key, "left_anti").join(named.where(F.col(copies) * hot <= total), key)
    return rows.join(often, key).unionByName(seldom)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def public_tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Before Python stages: ships the package, and bounds Arrow batches by rows and bytes, so that very long texts don't meet in one large batch.

    The options stay set in the session, as plans read them when they run.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trimmed(step):
    """A mapInArrow function that gives Arrow's unused memory back to the machine when a task ends, as its worker goes on to other work."""

    @functools.wraps(step)
    def run(batches):
        import pyarrow

        yield from step(batches)
        pyarrow.default_memory_pool().release_unused()

    return run


@contextlib.contextmanager
def no_collection():
    """Without Python's cycle collector, which would walk large word tables again and again; for code that makes no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
