"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def started(name: str, arguments: list[str], config: str, paths: list[str]) -> tuple[SparkSession, dict]:
    """The session of a command line, and its paths with the values of its config file.

    Paths and config are read by Spark, so they may be in any store it knows.
    """
    parser = argparse.ArgumentParser(name)
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("--config", default=config)
    given = vars(parser.parse_args(arguments))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    text = "\n".join(r["value"] for r in spark.read.text(given.pop("config"), wholetext=True).collect())
    return spark, given | json.loads(text)
