"""Structural embeddings of graphs of any size (G6): subspace iteration, whose vectors stay in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def _times(matrix: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """The matrix (a, b, w) times the rows x(id, v); partial sums are combined before the shuffle."""
    sums = [F.sum(F.col("w") * F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    return matrix.join(x.select(F.col("id").alias("b"), "v"), "b").groupBy(F.col("a").alias("id")).agg(*sums).select("id", F.array(*(f"s{i}" for i in range(width))).alias("v"))


def _inner(x: DataFrame, width: int, other: str = "v") -> np.ndarray:
    """v' other, a matrix of width * width: one partial product a partition, summed in Spark."""

    def partial(frames):
        import numpy as np
        import pandas as pd

        total = np.zeros((width, width))
        for f in frames:
            if len(f):
                total += np.stack(f["v"]).T @ np.stack(f[other])
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    parts = x.select(*{"v", other}).mapInPandas(partial, "i long, j long, s double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # width * width rows
        out[r["i"], r["j"]] = r["s"]
    return (out + out.T) / 2


def _turned(x: DataFrame, by: np.ndarray) -> DataFrame:
    """Rows times a small matrix."""
    kind = x.schema["id"].dataType.simpleString()

    def turn(frames):
        import numpy as np

        for f in frames:
            if len(f):
                yield f[["id"]].assign(v=list(np.stack(f["v"]) @ by))

    return x.select("id", "v").mapInPandas(turn, f"id {kind}, v array<double>")


def _whitened(x: DataFrame, width: int) -> tuple[DataFrame, int]:
    """x with orthonormal columns; those that depend on the others go."""
    size, axes = np.linalg.eigh(_inner(x, width))
    good = size > 1e-13 * max(size.max(), 1e-300)
    return _turned(x, axes[:, good] / np.sqrt(size[good])), int(good.sum())


def subspace_embedding(edges: DataFrame, dim: int = 64, rounds: int = 12, spare: int = 8) -> DataFrame:
    """(id, vector array<tinyint>) as `graph.structural_embedding` has it, up to the columns' signs, for any number of nodes: the `dim`
    largest singular pairs of A + A' by subspace iteration with `spare` columns more, from hashes of the ids. An axis converges by the ratio
    of its singular value to the first one left out, to the power of rounds; axes of equal value may come turned among themselves. Only
    matrices of (dim + spare) squared reach the driver. Loops count twice, repeated edges once, null ends not at all; no edges, no rows."""
    pairs = edges.select("src", "dst").na.drop().distinct()
    both = pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(pairs.select("dst", "src"))
    matrix = written(both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")), "adjacency")
    nodes = written(matrix.groupBy(F.col("a").alias("id")).agg((1 / F.sqrt(F.sum("w"))).alias("d")), "degrees")
    size = nodes.count()
    if size < 2:
        return nodes.select("id", F.lit(None).cast("array<tinyint>").alias("vector")).limit(0)
    width = min(dim + spare, size)
    start: list[Column] = [F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1 << 20)) / float(1 << 19) - 1.0 for i in range(width)]
    x, before = nodes.select("id", F.array(*start).alias("v")), None
    for _ in range(rounds):
        y = written(_times(matrix, x, width), "product")
        turned, width = _whitened(y, width)
        x = written(turned, "subspace")
        discard(y, *([before] if before else []))
        before = x
    ax = _times(matrix, x, width).withColumnRenamed("v", "w")
    values, axes = np.linalg.eigh(_inner(x.join(ax, "id"), width, "w"))
    first = np.argsort(-np.abs(values), kind="stable")[: max(1, min(dim, size - 1))]
    width = len(first)
    x = written(_turned(x, axes[:, first] * np.sqrt(np.abs(values[first]))), "embedding")
    discard(before)
    scaled = lambda rows: rows.join(nodes, "id").select("id", F.transform("v", lambda c: c * F.col("d")).alias("v"))
    one = written(scaled(_times(matrix, scaled(x), width)), "smoothed")
    two = scaled(_times(matrix, scaled(one), width))
    mixed = x.join(one.withColumnRenamed("v", "p"), "id").join(two.withColumnRenamed("v", "q"), "id").select("id", F.array(*(0.5 * F.col("v")[i] + 0.3 * F.col("p")[i] + 0.2 * F.col("q")[i] for i in range(width))).alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    whole = F.transform("v", lambda c: F.when(F.col("top") == 0, 0.0).otherwise(F.bround(127 * c / F.col("top"), 0)).cast("tinyint"))
    return mixed.withColumn("top", top).select("id", F.concat(whole, F.array_repeat(F.lit(0).cast("tinyint"), dim - width)).alias("vector"))
