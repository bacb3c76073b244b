"""Intermediate tables of the evidence engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, written once under ``spark.checkpoint.dir``; a cluster that has no such folder computes it again for each use."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            return df
        base = f"file://{os.path.join(tempfile.gettempdir(), 'tracelake-' + spark.sparkContext.applicationId)}"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
