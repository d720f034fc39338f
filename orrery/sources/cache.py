"""Results stored in the shared folder under the hash of what made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.sources.shared import shared_dir
from orrery.sources.sinks import write_safely
from orrery.sources.tables import exists


def cached(spark: SparkSession, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table of ``parameters`` in this application, built and written as a whole if it is not there yet."""
    key = json.dumps({"app": spark.sparkContext.applicationId, **parameters}, sort_keys=True)
    path = f"{shared_dir(spark)}/cache-{hashlib.sha256(key.encode()).hexdigest()[:32]}.parquet"
    if not exists(spark, path):
        write_safely(build(), path)
    return spark.read.parquet(path)
