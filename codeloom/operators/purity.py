"""Functional analysis (A11, R21) and summaries of a repository's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import n

def lambda_density(contains: DataFrame, lambdas: DataFrame, files: DataFrame, depth: int = 3, most: int = 20) -> DataFrame:
    """The files(id, name) with most lambdas(parent) at most `depth` containment steps (src holds dst) above their parent. Counts climb by
    container, summed at each step, so lambdas aren't joined one by one; two paths to a lambda count twice, as matches of a path pattern do."""
    level, found = lambdas.groupBy(F.col("parent").alias("id")).agg(n().alias("lambdas")), None
    for _ in range(depth):
        level = level.join(contains.select(F.col("dst").alias("id"), "src"), "id").groupBy(F.col("src").alias("id")).agg(F.sum("lambdas").alias("lambdas"))
        found = level if found is None else found.unionByName(level)
    counts = found.groupBy("id").agg(F.sum("lambdas").alias("lambdas"))
    return counts.join(files.select("id", F.col("name").alias("file")), "id").select("file", "lambdas").orderBy(F.desc("lambdas"), "file").limit(most)


def state_mutations(accesses: DataFrame, symbols: DataFrame, most: int = 20) -> DataFrame:
    """The symbols(id, name) with most accesses(src, is_mutation, is_taint) that change state or carry taint."""
    counts = accesses.where(F.col("is_mutation") | F.col("is_taint")).groupBy(F.col("src").alias("id")).agg(n().alias("mutations"))
    return counts.join(symbols.select("id", F.col("name").alias("function")), "id").groupBy("function").agg(F.sum("mutations").alias("mutations")).orderBy(F.desc("mutations"), "function").limit(most)


def recursive_symbols(edges: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """Symbols(id, name, filepath) that call themselves, the first by name and file."""
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    return symbols.join(loops, "id", "left_semi").select(F.col("name").alias("function"), "filepath").orderBy("function", "filepath").limit(most)


def complexity_summary(files: DataFrame) -> DataFrame:
    """One row for files(cyclomatic, complexity_class): how many, mean and largest complexity, and files of each class."""
    of = lambda c: F.count(F.when(F.col("complexity_class") == c, 1)).alias(f"{c}_files")
    return files.agg(n().alias("files"), F.round(F.avg("cyclomatic"), 4).alias("mean"), F.max("cyclomatic").alias("most"), *map(of, ("simple", "moderate", "complex", "very_complex")))


def halstead_summary(files: DataFrame) -> DataFrame:
    """One row for files(volume, difficulty, effort, bugs): how many, means, and all estimated bugs."""
    mean = lambda c: F.round(F.avg(c), 2).alias(f"mean_{c}")
    return files.agg(n().alias("files"), *map(mean, ("volume", "difficulty", "effort")), F.round(F.sum("bugs"), 3).alias("bugs"))


def object_summary(files: DataFrame) -> DataFrame:
    """One row for files(classes, abstract, methods, attributes, ca, ce, coupling): totals, mean coupling of files with classes, and
    abstractness, instability and distance of the whole."""
    sums = files.agg(n().alias("files"), F.count(F.when(F.col("classes") > 0, 1)).alias("files_with_classes"), *(F.sum(c).alias(c) for c in ("classes", "abstract", "methods", "attributes", "ca", "ce", "coupling")))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    abstractness, instability = part(c("abstract"), c("classes")), part(c("ce"), c("ce") + c("ca"))
    return sums.select("files", "files_with_classes", "classes", "abstract", "methods", "attributes", F.round(part(c("coupling"), c("files_with_classes")), 4).alias("mean_coupling"), F.round(abstractness, 4).alias("abstractness"), F.round(instability, 4).alias("instability"), F.round(F.abs(abstractness + instability - 1), 4).alias("distance"))
