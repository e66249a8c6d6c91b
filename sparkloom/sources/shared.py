"""Places that the driver and all executors see, for checkpoints of streams and tables in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a temporary folder serves local masters, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="spark-shared-")
        place = _local["dir"]
    return f"{(place if ':' in place else f'file://{place}').rstrip('/')}/{name}-{uuid.uuid4().hex}"
