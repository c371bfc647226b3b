"""A corpus pipeline in five stages, each one of the operators in codeloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to documents, writing each one's rows as Parquet
in the shared folder and reading them as the next one's docs. All but the last return the columns of documents.

ORACLE_SQL is None: SQL can't express the trained classifier or the tokenizer. tests/llm holds the stages
against brute force.

Cases, for every stage: rows are judged one by one, known by KEY, a hash of id and text, so rows with a null id, and rows of one id with
different texts, are judged like others; null and empty texts count as empty; very long texts are whole; an empty table gives an empty result;
other columns pass unchanged, whatever their names (but KEY and SPANS).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.byte_bpe import decode_ids, encode_documents
from codeloom.llm.common import table
from codeloom.llm.decontaminate import overlaps
from codeloom.llm.ngram_join import jaccard_classes
from codeloom.llm.quality import fit_quality, score_quality
from codeloom.llm.secret_scans import KINDS, scan_secrets
from codeloom.session import written

KEY, SPANS = "_row_key", "_row_spans"
#: Keys (64 bits each), and spans (three numbers each), that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_SPANS = 1_000_000, 500_000


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose KEY isn't among keys."""
    keys = written(keys.select(KEY).distinct(), "keys")
    return keyed(docs).join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, KEY, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be of quality 1. Repeated rows stay or go together; without labels all stay."""
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    if machine is None:
        return docs
    return without(docs, score_quality(keyed(docs), machine, id_col=KEY).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links (five words, 0.8): the one with the least id, null being greatest; on a tie of
    ids the least hash of the text. Of repeated rows the one whose other columns are least. A text without words is in no group, so
    only repeated rows of it are reduced."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.col(KEY).alias("key")).alias("place")
    classes = written(jaccard_classes(keyed(docs).select(order, "text"), id_col="place", size=5, share=80), "classes")
    left = without(docs, classes.where("place != component_id").select(F.col("place.key").alias(KEY)))
    twice = written(classes.where("place = component_id").groupBy(F.col("place.key").alias(KEY)).count().where("count > 1").select(KEY), "twice")
    if twice.isEmpty():
        return left
    few = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice
    least = F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("row")
    once = keyed(left).join(few, KEY, "left_semi").groupBy(KEY).agg(least).select("row.*")
    return keyed(left).join(few, KEY, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Repeated rows stay or go together."""
    return without(docs, overlaps(keyed(docs), table(spark, sf_dir, "benchmark"), id_col=KEY))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret's span replaced by its kind in brackets; overlapping spans are one. n_chars follows where a text changed."""
    found = scan_secrets(keyed(docs), id_col=KEY).where(F.size("spans") > 0)
    found = written(found.groupBy(KEY).agg(F.first("spans").alias(SPANS)), "found")
    few = found.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(SPANS)), F.lit(0))).first()[0] <= BROADCAST_SPANS
    joined = keyed(docs).join(F.broadcast(found) if few else found, KEY, "left").drop(KEY)
    name = F.array(*map(F.lit, KINDS))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(name, s["kind"] + 1), F.lit("]")).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    masked = F.aggregate(SPANS, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = joined.withColumn(KEY, F.when(F.col(SPANS).isNotNull(), masked))
    out = {"text": F.coalesce(KEY, "text").alias("text"), "n_chars": F.coalesce(F.length(KEY).cast("long"), "n_chars").alias("n_chars")}
    return changed.select(*(out.get(c, F.col(c)) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; a row for each row."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode_documents(docs, path, public_tokenizers.PATTERN)
    return decode_ids(ids, path, public_tokenizers.PATTERN, digest=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
