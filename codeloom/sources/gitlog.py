"""Git history as DataFrames (S7, S8, F12 to F14, F28, F29, W9). Logs are text files of lines, read by Spark; git itself runs only in the
data source below."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Formats that the readers here expect.
COMMIT_FORMAT = "%H%x09%at%x09%aN%x09%aE%x09%s"
NUMSTAT_FORMAT = "commit:%H"


def commits(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of COMMIT_FORMAT: commit, ts, author, mail, subject."""
    p = F.split(F.col(column), "\t", 5)
    return lines.where(F.size(p) == 5).select(p[0].alias("commit"), F.timestamp_seconds(p[1].cast("long")).alias("ts"), p[2].alias("author"), p[3].alias("mail"), p[4].alias("subject"))


def numstat(lines: DataFrame) -> DataFrame:
    """source, pos, line of `git log --numstat` with NUMSTAT_FORMAT: commit, file, added, deleted. A line's commit is the last header
    before it in its source; '-' counts as 0."""
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").startswith("commit:"), F.expr("substring(line, 8)"))
    p = F.split("line", "\t", 3)
    rows = lines.withColumn("commit", F.last(header, ignorenulls=True).over(w)).where(~F.col("line").startswith("commit:") & (F.size(p) == 3))
    count = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    return rows.select("commit", p[2].alias("file"), count(p[0]).alias("added"), count(p[1]).alias("deleted"))


def as_log(changes: DataFrame, buckets: int = 16) -> DataFrame:
    """The reverse of numstat: (source, pos, line), commits dealt to several sources."""
    text = changes.groupBy("commit_id").agg(F.sort_array(F.collect_list(F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "file"))).alias("l"))
    lines = text.select("commit_id", F.pmod(F.xxhash64("commit_id"), F.lit(buckets)).alias("source"), F.posexplode(F.concat(F.array(F.concat(F.lit("commit:"), F.col("commit_id").cast("string"))), "l")).alias("k", "line"))
    return lines.select("source", (F.col("commit_id") * 1_000_000 + F.col("k")).alias("pos"), "line")


def shortstat(line: Column) -> dict[str, Column]:
    """files, insertions and deletions of a --shortstat line; what isn't named is 0."""
    number = lambda what: F.coalesce(F.regexp_extract(line, rf"(\d+) {what}", 1).try_cast("long"), F.lit(0).cast("long"))
    return {"files": number("files? changed"), "insertions": number("insertion"), "deletions": number("deletion")}


def renames(lines: DataFrame) -> DataFrame:
    """--name-status lines: status, old and new path; a rename has both."""
    p = F.split("line", "\t")
    return lines.where(F.size(p) >= 2).select(F.substring(p[0], 1, 1).alias("status"), F.when(F.size(p) > 2, p[1]).alias("old"), F.element_at(p, -1).alias("file"))


def tree(lines: DataFrame) -> DataFrame:
    """`git ls-tree -r -l` lines: blob, size, path; submodules (kind commit) are out."""
    p = F.split(F.regexp_replace("line", r"^(\S+) (\S+) (\S+) +(\S+)\t", "$1\t$2\t$3\t$4\t"), "\t", 5)
    return lines.select(p[1].alias("kind"), p[2].alias("blob"), p[3].try_cast("long").alias("size"), p[4].alias("path")).where("kind = 'blob'").drop("kind")


def main_branch(branches: list[str], remote_head: str | None = None, current: str | None = None, configured: str | None = None) -> str | None:
    """the remote's head, else the current branch, the configured one, a usual name, or the first."""
    for name in (remote_head, current, configured, "main", "master", "develop"):
        if name in branches:
            return name
    return branches[0] if branches else None


def since(commits: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """commits from one instant to another, both inclusive."""
    df = commits if first is None else commits.where(F.col("ts") >= F.lit(first).cast("timestamp"))
    return df if last is None else df.where(F.col("ts") <= F.lit(last).cast("timestamp"))


class GitLog(DataSource):
    """spark.read.format("gitlog").option("repository", path).load(): a partition per repository (paths by ';'). Each task runs
    git, so the paths must be reachable where executors run."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return "repository string, commit string, ts long, author string, mail string, subject string"

    def reader(self, schema):
        return _Reader(self.options["repository"].split(";"))


class _Reader(DataSourceReader):
    def __init__(self, paths):
        self.paths = paths

    def partitions(self):
        from pyspark.sql.datasource import InputPartition

        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        log = subprocess.run(["git", "-C", partition.value, "log", "--all", f"--format={COMMIT_FORMAT}"], capture_output=True, text=True, errors="replace")
        for line in log.stdout.splitlines():
            p = line.split("\t", 4)
            if len(p) == 5:
                yield partition.value, p[0], int(p[1]), p[2], p[3], p[4]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
