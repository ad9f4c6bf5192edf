"""Guarded writes: proposals are applied to a store of documents only if what they expect is still there.

A store is a folder of numbered versions; a version's table is staged first, and becomes current when its manifest file is
created, which only one writer can do. A writer that comes second finds the number taken and reports a lost race.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a store's documents and of proposals. expected_sha256 is null where the document must be absent.
DOCUMENTS = "bundle_id string, path string, content string"
PROPOSALS = "bundle_id string, path string, expected_sha256 string, expected_bytes bigint, proposed string"


def preflight(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals with outcome: ready, appeared (must be absent, is there), missing, changed (hash or length differ), or repeated (a path proposed more than once)."""
    state = current.groupBy("bundle_id", "path").agg(F.min(F.sha2("content", 256)).alias("_sha"), F.min(F.octet_length("content").cast("long")).alias("_bytes"))
    times = proposals.groupBy("bundle_id", "path").agg(F.count(F.lit(1)).alias("_times"))
    joined = proposals.join(state, ["bundle_id", "path"], "left").join(times, ["bundle_id", "path"])
    absent, there = F.col("expected_sha256").isNull(), F.col("_sha").isNotNull()
    same = (F.col("_sha") == F.lower("expected_sha256")) & (F.col("_bytes") == F.col("expected_bytes"))
    outcome = F.when(F.col("_times") > 1, "repeated").when(absent & there, "appeared").when(absent, "ready").when(~there, "missing").when(same, "ready").otherwise("changed")
    return joined.select(*proposals.columns, outcome.alias("outcome"))


def applied(current: DataFrame, ready: DataFrame) -> DataFrame:
    """current with the proposed texts in place of what they replace."""
    kept = current.join(ready.select("bundle_id", "path"), ["bundle_id", "path"], "left_anti")
    return kept.unionByName(ready.select("bundle_id", "path", F.col("proposed").alias("content")))


class Store:
    """Versions of a set of documents under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the current version, 0 for an empty store."""
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], DOCUMENTS)
        table = json.loads(self.spark.read.text(f"{self.folder}/manifest/{version}", wholetext=True).first()[0])["table"]
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.folder}/{table}")

    def commit(self, documents: DataFrame, base: int) -> int | None:
        """Makes documents the version after base; None if another writer was first, whose version stays as it is."""
        table = f"staged/{uuid.uuid4().hex}"
        documents.select("bundle_id", "path", "content").write.parquet(f"{self.folder}/{table}")
        path, fs = self._path(f"manifest/{base + 1}")
        try:
            out = fs.create(path, False)
        except Exception as error:
            if not fs.exists(path):
                raise
            staged, at = self._path(table)
            at.delete(staged, True)
            if "AlreadyExists" not in str(error):
                raise
            return None
        out.write(json.dumps({"table": table}).encode())
        out.close()
        return base + 1

    def write(self, proposals: DataFrame, partial: bool = False) -> tuple[int | None, DataFrame]:
        """Applies proposals and reports each one's outcome: applied, or why not; lost-race for all where another writer was first.

        Without partial, one that is not ready holds all of them back (held); a later version makes them be looked at anew.
        """
        base = self.version()
        current = self.read(base)
        looked = preflight(current, proposals)
        open_ = looked.where("outcome <> 'ready'").limit(1).count() > 0
        if open_ and not partial:
            return None, looked.withColumn("outcome", F.when(F.col("outcome") == "ready", "held").otherwise(F.col("outcome")))
        made = self.commit(applied(current, looked.where("outcome = 'ready'")), base)
        # The report is made from the version that was looked at, which stays readable.
        done = "applied" if made else "lost-race"
        return made, looked.withColumn("outcome", F.when(F.col("outcome") == "ready", done).otherwise(F.col("outcome")))
