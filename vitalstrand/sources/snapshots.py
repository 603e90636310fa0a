"""Atomic versions of a table in a shared folder.

Data is written to a path of its own first; one commit row, written last, makes it visible. Readers look at commit rows
only, so a half-written version is never seen and the one before stays readable. A retried commit of a version adds a
second, equal copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version BIGINT, kind STRING, name STRING"


class Snapshots:
    """Committed versions of one table; ``kind`` tells tables apart that share a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, df: DataFrame, version: int, kind: str = "table", partition_by: Sequence[str] = ()) -> str:
        name = f"data/{kind}-{version}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.folder}/{name}")
        one = self.spark.range(0, 1, 1, 1)
        row = one.select(F.lit(version).cast("long").alias("version"), F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        row.write.parquet(f"{self.folder}/commits/{name.rsplit('/', 1)[1]}")
        return f"{self.folder}/{name}"

    def committed(self) -> list[tuple[int, str, str]]:
        """(version, kind, path) in ascending order: one small row for each version, the later of equal copies."""
        try:
            rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found = {(r["version"], r["kind"]): r["name"] for r in sorted(rows, key=lambda r: r["name"])}
        return [(version, kind, f"{self.folder}/{name}") for (version, kind), name in sorted(found.items())]

    def next_version(self, kind: str = "table") -> int:
        return 1 + max((v for v, k, _ in self.committed() if k == kind), default=-1)

    def read(self, fallback: DataFrame | None = None, kind: str = "table") -> DataFrame:
        """Newest committed version, else ``fallback``."""
        paths = [path for _, k, path in self.committed() if k == kind]
        if paths:
            return self.spark.read.parquet(paths[-1])
        if fallback is None:
            raise FileNotFoundError(f"no committed version of {kind} in {self.folder}")
        return fallback
