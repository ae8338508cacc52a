"""Session settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    # timestamps without a zone are read as UTC
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: size-checked broadcasts, splitting of hot join keys
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sessions are merged inside each partition before they are shuffled
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Python workers import this package
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
