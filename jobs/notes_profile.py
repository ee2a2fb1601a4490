"""Profile of the notes that recorders keep with their runs, brought up to date as files of notes arrive.

A file stream with a checkpoint takes only new files, measures each note once
and keeps the measures, one partition a batch. A batch that is taken again after
a failure replaces its own partition, so nothing counts twice. The report, by
source and language, is then made from all measures: how many notes and words
there are, from which length on a note is unusually long there (the mean of two
order statistics of the lengths), how many are, and the longest that has an id.

    python -m jobs.notes_profile --input DOCUMENTS --output FOLDER [--config jobs/notes_profile.json]

DOCUMENTS is a folder of Parquet files or a pattern such as `notes/*.parquet`.
FOLDER/report is the report, a partition a source; FOLDER/measures and
FOLDER/progress are what a later run goes on from. New notes come as new files
under DOCUMENTS; a file that was taken isn't read again, even if it is changed.
Null texts have no words; a note without a source or language counts under
`unknown` and `und`. Repeated rows count as often as they stand. With no rows the
report is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import keep_empty, log, main, settings
from rangeforge.operators.aggregates import order_statistic_threshold

DEFAULTS = {"words_per_level": 8, "low": 0.3, "high": 0.8, "least_threshold": 4.0, "files_at_once": 64}
#: Lengths are told apart up to this level, as intensities are.
LEVELS = 256
NOTES = "doc_id long, text string, lang string, source string"
MEASURES = "doc_id long, source string, lang string, words long, level int, batch long"
REPORT = "lang string, notes long, words long, threshold double, long_notes long, longest_id long, source string"


def measured(notes: DataFrame, words_per_level: int) -> DataFrame:
    """(doc_id, source, lang, words, level) of notes."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    named = lambda c, other: F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(F.col(c)).alias(c)
    rows = notes.select("doc_id", named("source", "unknown"), named("lang", "und"), words.alias("words"))
    return rows.withColumn("level", F.least(F.lit(LEVELS - 1), F.floor(F.col("words") / words_per_level)).cast("int"))


def report(measures: DataFrame, use: dict) -> DataFrame:
    """One row a source and language. Lengths are counted by level before anything is ordered, so a source of any size costs a few hundred rows a task."""
    keys = ["source", "lang"]
    limits = order_statistic_threshold(measures, keys, "level", use["low"], use["high"], use["least_threshold"])
    # Few rows, one for each source and language: the join is planned by their size.
    rows = measures.join(limits, keys)
    longest = F.max_by("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct("words", -F.col("doc_id")))).alias("longest_id")
    found = rows.groupBy(*keys).agg(F.count("*").alias("notes"), F.sum("words").alias("words"), F.min("threshold").alias("threshold"), F.sum((F.col("level") > F.col("threshold")).cast("long")).alias("long_notes"), longest)
    return found.select("lang", "notes", "words", "threshold", "long_notes", "longest_id", "source")


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> str:
    """Takes the notes that are new under `source`, writes the report and returns its path."""
    use = settings(DEFAULTS, config)
    measures, progress, out = f"{output}/measures", f"{output}/progress", f"{output}/report"
    keep_empty(spark.createDataFrame([], MEASURES), measures)

    def take(batch: DataFrame, number: int) -> None:
        rows = measured(batch, use["words_per_level"]).withColumn("batch", F.lit(number).cast("long"))
        rows.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(measures)

    notes = spark.readStream.schema(NOTES).option("maxFilesPerTrigger", use["files_at_once"]).parquet(source)
    stream = notes.writeStream.foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    taken = sum(p["numInputRows"] for p in stream.recentProgress)
    held = spark.read.schema(MEASURES).parquet(measures)
    report(held, use).write.partitionBy("source").mode("overwrite").parquet(out)
    log.info("read %d new notes of %s; wrote %d rows of the report to %s", taken, source, spark.read.schema(REPORT).parquet(out).count(), out)
    return out


if __name__ == "__main__":
    main(run, "notes_profile", "Profile of the notes kept with runs, brought up to date with new files.")
