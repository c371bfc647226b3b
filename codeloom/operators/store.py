"""Tables of the store (K1 to K13, P14, P15, J18, S13 to S15): upserts, deletions and merges as joins that give new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import descend


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """K1, K2: new rows replace old ones of the same key; columns in keep stay as they were. New keys occur once each."""
    fresh = new.dropDuplicates(keys)
    kept = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_old"))
    merged = fresh.join(kept, keys, "left").select(*(F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns))
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(merged)


def update(old: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of values where a row has them, else as before."""
    names = [c for c in values.columns if c not in keys]
    new = values.select(*keys, *(F.col(c).alias(f"_{c}") for c in names))
    return old.join(new, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns))


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """K3: rows(filepath, ...) without those of files(filepath)."""
    return rows.join(files.select("filepath"), "filepath", "left_anti").select(*rows.columns)


def stale(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """Tracked files that are no more."""
    return tracked.join(current.select("filepath"), "filepath", "left_anti").select("filepath")


def changed(tracked: DataFrame, listing: DataFrame, slack: float = 0.01) -> DataFrame:
    """(filepath, state) of the listing: new, same (no later than it was, or of the same hash), or changed."""
    t = tracked.select("filepath", F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    state = F.when(F.col("_m").isNull(), "new").when(F.col("mtime") <= F.col("_m") + slack, "same").when(F.col("content_hash") == F.col("_h"), "same").otherwise("changed")
    return listing.join(t, "filepath", "left").select("filepath", state.alias("state"))


def cascade_delete(nodes: DataFrame, contains: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """K4: nodes and edges without the seeds, all that they contain, and edges at either end of those."""
    gone = descend(contains, seeds, depth)
    rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), rest.select(*edges.columns)


def purge_orphans(identifiers: DataFrame, links: DataFrame) -> DataFrame:
    """K4: identifiers that a HAS_IDENTIFIER edge still reaches."""
    return identifiers.join(links.select(F.col("dst").alias("id")), "id", "left_semi")


def load_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """K5: old with the new ids that it lacks; of equal new ids one is taken."""
    return old.unionByName(new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(*old.columns))


def load_edges(edges: DataFrame) -> DataFrame:
    """K6: distinct by ends, relation and properties."""
    return edges.dropDuplicates([c for c in ("src", "dst", "rel", "props") if c in edges.columns])


def federated(repositories: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables of all repositories, marked by repo, one row a key: that of the repository first by name."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("repo", F.lit(name)) for name, df in sorted(repositories.items())))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("repo", *(c for c in rest if c != "repo"))).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as zstd Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load_snapshot(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """K8, K9: one row (report) of JSON, a list of rows for each section. Sections are summaries, so their rows are few."""
    parts = [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in sections.items()]
    rows = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    return rows.select(F.to_json(F.struct(*sections)).alias("report"))


def report_lines(sections: dict[str, DataFrame], yaml: bool = False) -> DataFrame:
    """(section, item), a line of JSON for each row of each section, or an item of a YAML list (JSON is YAML's flow style). Rows stay
    distributed, so sections may be long; written by section they are one file set each."""
    item = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    parts = (df.select(F.lit(name).alias("section"), (F.concat(F.lit("- "), item) if yaml else item).alias("item")) for name, df in sections.items())
    return reduce(DataFrame.unionByName, parts)


def identity(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """A node's id: file, kind, qualified name and line."""
    return F.concat_ws("::", path, kind, name, line.cast("string"))


def node_uuid(id_: Column) -> Column:
    """the 16 bytes of the id's MD5."""
    return F.unhex(F.md5(id_))


def next_record(records: DataFrame, title: str) -> DataFrame:
    """The next number of decision records(number, title), and the file name of a new one."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.lit(title)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return records.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).cast("long").alias("number")).select("number", F.concat(F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("-"), slug, F.lit(".md")).alias("filename"))
