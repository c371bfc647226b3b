"""A bounded sample of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part


def sample(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, label, text) of at most `most` labelled rows that aren't held out, half of each class where there are so many.

    Rows are taken by a hash of their id, so the choice doesn't depend on the size or order of the tables. Ids
    that are null, or labelled twice with different labels, aren't used; an id that stands more than once in docs counts once, with the text of
    the least hash.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1) & (crc_part(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(target).alias("label"), F.max(target).alias("other")).where("label = other")
    order = F.xxhash64("id")
    halves = [known.where(F.col("label") == k).select("id", "label").orderBy(order, "id").limit(most // 2) for k in (0, 1)]
    picked = F.broadcast(halves[0].union(halves[1]))  # at most `most` rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("one")
    return rows.groupBy("id", "label").agg(one).select("id", "label", F.col("one.text").alias("text"))
