"""Several tables committed together: staged under a run's folder, published by one manifest.

Readers see the runs that manifests name, so a run whose manifest was never written does
not exist for them.  A run is the unit of reuse: its processing key is unique, and a run
whose key is published already is not written again.  Creation of the manifest is the
commit; on object stores it needs a conditional put or a lock.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunStore:
    """Tables of runs below ``path``: ``runs/<key>/<table>`` and ``manifests/<key>.json``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, key: str):
        return self._fs_path(f"{self.path}/manifests/{key}.json")

    def published(self, key: str) -> bool:
        return self._fs.exists(self._manifest(key))

    def commit(self, key: str, tables: dict[str, DataFrame], failed: str | None = None) -> bool:
        """Write the tables and publish them; False if the key was published before, by this or another writer."""
        if self.published(key):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/runs/{key}/{name}")
        body = json.dumps({"key": key, "tables": sorted(tables), "failed": failed}).encode()
        self._fs.mkdirs(self._fs_path(f"{self.path}/manifests"))
        try:
            out = self._fs.create(self._manifest(key), False)  # never over another's manifest
        except Exception as error:
            if "exist" in str(error).lower():
                return False
            raise
        out.write(bytearray(body))
        out.close()
        return True

    def manifests(self) -> DataFrame:
        """(key, tables, failed) of all published runs."""
        schema = "key string, tables array<string>, failed string"
        if not self._fs.exists(self._fs_path(f"{self.path}/manifests")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/manifests")

    def read(self, name: str) -> DataFrame:
        """One table over all published, completed runs, with each run's key."""
        runs = self.manifests().filter(F.col("failed").isNull() & F.array_contains("tables", name)).select(F.col("key").alias("run_key"))
        rows = self.spark.read.parquet(f"{self.path}/runs/*/{name}").withColumn("run_key", F.regexp_extract(F.input_file_name(), r"/runs/([^/]+)/", 1))
        return rows.join(runs, "run_key", "left_semi")

    def pending(self, wanted: DataFrame, key_col: str) -> DataFrame:
        """The rows of ``wanted`` whose key is not published yet."""
        done = self.manifests().filter("failed is null").select(F.col("key").alias(key_col))
        return wanted.join(done, key_col, "left_anti")
