"""Document sources: folders of Markdown files, tables, and a catalogue of bundles found under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that discovery passes over.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", ".next", ".nuxt", ".pnpm-store", ".turbo", ".vscode-test", ".yarn", "bower_components", "coverage", "node_modules")


def read_bundle(spark: SparkSession, root: str, bundle_id: str) -> DataFrame:
    """documents(bundle_id, uri, bundle_path, content BINARY) of one folder, without the root AGENTS.md and .agents/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    docs = files.select(F.lit(bundle_id).alias("bundle_id"), F.col("path").alias("uri"), path.alias("bundle_path"), "content")
    return docs.where((F.col("bundle_path") != "AGENTS.md") & ~F.col("bundle_path").startswith(".agents/"))


def read_root_index(spark: SparkSession, root: str, bundle_id: str) -> DataFrame:
    """Only the root index, by its own path: no other file is listed."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/index.md")
    return files.select(F.lit(bundle_id).alias("bundle_id"), F.col("path").alias("uri"), F.lit("index.md").alias("bundle_path"), "content")


def discover(spark: SparkSession, root: str, limit: int = 128) -> DataFrame:
    """Roots of bundles under a folder: each folder with an index.md whose ancestors have none, at most `limit` in path order; omitted counts the rest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "index.md").load(root).select(F.regexp_replace("path", "/index\\.md$", "").alias("root"))
    found = found.where(~F.arrays_overlap(F.split("root", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))).distinct()
    steps = F.split("root", "/")
    above = found.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("above"))
    nested = above.join(found.select(F.col("root").alias("outer")), F.col("above") == F.col("outer")).select(F.col("root").alias("inner")).distinct()
    top = found.join(nested, F.col("root") == F.col("inner"), "left_anti")
    return top.withColumn("nth", F.row_number().over(Window.orderBy("root"))).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - limit, F.lit(0))).where(F.col("nth") <= limit).drop("nth")
