"""What the jobs share: their logger and config files."""

from __future__ import annotations

import json
import logging
from dataclasses import fields

from pyspark.sql import SparkSession


def logger(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def config(spark: SparkSession, kind: type, path: str | None):
    """A config of this kind from a JSON file, which may lie anywhere that Spark reads; keys that it does not know are refused."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if odd := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"{path}: unknown settings {sorted(odd)}")
    return kind(**given)


def command_line_session(app: str) -> SparkSession:
    """A session for a command line; master and all else come from spark-submit or the environment."""
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("jobs").setLevel(logging.INFO)
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").getOrCreate()
