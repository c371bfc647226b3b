"""Unified diffs without context as line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hunks(lines: DataFrame) -> DataFrame:
    """source, pos, line of `git diff -U0`: file, start, end of the new side. A range without a count is one line; one of no lines (a pure
    deletion) stands for the line at its start."""
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.expr("substring(line, 5)"), "^b/", ""))
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("line", head, 1).try_cast("long")
    size = F.coalesce(F.regexp_extract("line", head, 2).try_cast("long"), F.lit(1).cast("long"))
    rows = lines.withColumn("file", F.last(file, ignorenulls=True).over(w)).where(F.col("line").rlike(head) & (F.col("file") != "/dev/null"))
    return rows.select("file", start.alias("start"), (start + F.greatest(size, F.lit(1).cast("long")) - 1).alias("end"))
