"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "recordloom", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` is set on top (dots as ``__``)."""
    builder = SparkSession.builder.appName(name).config(
        map={
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
        | {k.replace("__", "."): v for k, v in conf.items()}
    )
    if "spark__master" not in conf and "SPARK_MASTER" not in os.environ:
        builder = builder.master("local[*]")
    return builder.getOrCreate()
