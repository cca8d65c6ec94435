"""Sessions for tests, the bench and interactive use; on a cluster the caller brings their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the library relies on; all else is left to the cluster's settings.
NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "6g", **more: str) -> SparkSession:
    conf = NEEDED | {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.config(map=conf | more).getOrCreate()
