"""A folder that driver and executors share, for queries that write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from fieldbook.sources.shared import shared_folder


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
