"""What both jobs share: the command line, the config file and the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("rangeforge.jobs")


def settings(defaults: dict, given: dict | None) -> dict:
    """defaults with what is given in their place; a name that the defaults don't have is an error."""
    if unknown := set(given or {}) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (given or {})


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, read by Spark, as it may lie in a remote store."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def keep_empty(rows: DataFrame, path: str) -> None:
    """Makes the folder of a table, so that it can be read before there are rows; what is there stays."""
    rows.limit(0).write.mode("append").parquet(path)


def main(run: Callable, name: str, about: str) -> None:
    """The command line of a job: makes the session, calls run(spark, input, output, config) and stops the session."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    parser.add_argument("--input", required=True, help="table to read, a path of Parquet files")
    parser.add_argument("--output", required=True, help="folder for what the job writes and remembers")
    parser.add_argument("--config", help="JSON file with settings")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.input, given.output, read_config(spark, given.config) if given.config else None)
    finally:
        spark.stop()
