"""Keeping tables fresh: sync before a query, lazy rebuilds, caches by key, staged builds and append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synced(store: DataFrame, listing: DataFrame, slack: float = 0.01) -> DataFrame:
    """The store (filepath, mtime, content_hash, ...) brought to a listing with the same columns. A file that is no later than its row
    (within the slack), or of the same hash, keeps its row; another is replaced, a new one added, and one that isn't listed goes. One join by
    filepath does all four; both sides have one row a file."""
    rest = [c for c in store.columns if c != "filepath"]
    old = store.select("filepath", F.struct(*rest).alias("_old"))
    same = (F.col("mtime") <= F.col("_old.mtime") + slack) | (F.col("content_hash") == F.col("_old.content_hash"))
    return listing.join(old, "filepath", "left").select("filepath", *(F.when(same, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in rest))


def dirty(built: DataFrame, files: DataFrame) -> DataFrame:
    """The files (filepath, content_hash, ...) that the index wasn't built from, as built(filepath, content_hash) says."""
    return files.join(built.select("filepath", "content_hash"), ["filepath", "content_hash"], "left_anti").select(*files.columns)


def refreshed(index: DataFrame, built: DataFrame, files: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index (filepath, ...) as of the files: rows of unchanged files stay, only dirty files are built again, those of files that
    are gone go. The versions stand in `built`, so a rebuild that a lost executor or a time limit ends is simply due again."""
    clean = built.join(files.select("filepath", "content_hash"), ["filepath", "content_hash"], "left_semi").select("filepath")
    return index.join(clean, "filepath", "left_semi").select(*index.columns).unionByName(build(dirty(built, files)))


def cached(cache: DataFrame, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The cache with rows for all wanted keys; compute gets one row of each key that the cache lacks and returns the cache's columns."""
    missing = wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return cache.unionByName(compute(missing).select(*cache.columns))


def trimmed(cache: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """The last `most` rows by key, the bound of a saved cache; what is dropped is computed again when it is wanted."""
    return cache.orderBy(F.desc(key)).limit(most)


def append_log(events: DataFrame, path: str) -> None:
    """Events as JSON lines below the path, each with an event_id, beside those that are there."""
    events.withColumn("event_id", F.expr("uuid()")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def build_and_swap(df: DataFrame, path: str) -> None:
    """Df is written beside the path as Parquet and takes its place by renames when it is whole. If writing fails, the table that was
    there stays; if the second rename fails, it is put back. Readers that have listed the old files must start again."""
    spark = df.sparkSession
    path, mark = path.rstrip("/"), uuid.uuid4().hex
    at = lambda end: spark._jvm.org.apache.hadoop.fs.Path(path + end)
    here, new, old = at(""), at(f"-new-{mark}"), at(f"-old-{mark}")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(f"{path}-new-{mark}")
        had = fs.exists(here)
        if had and not fs.rename(here, old):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(new, here):
            if had:
                fs.rename(old, here)
            raise OSError(f"{path} can't be replaced")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)
