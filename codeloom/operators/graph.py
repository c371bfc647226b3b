"""

Traversals are loops of equi-joins over a bounded number of hops; frontiers are written to the shared folder where a loop is
long, so plans stay short and a lost executor costs one step. Iterative operators have fixed numbers of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

L = "long"


def n() -> Column:
    return F.count(F.lit(1))


def neighbours(edges: DataFrame, seeds: DataFrame, forward: bool = True) -> DataFrame:
    """(seed, id) callees (forward) or callers of each seed(id)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.join(seeds.select(F.col("id").alias(a)), a, "left_semi").select(F.col(a).alias("seed"), F.col(b).alias("id")).distinct()


def trace(edges: DataFrame, seeds: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """(id, hop) with the least hop at which each node is reached, 1 to depth. A frontier holds new nodes only and is written, so
    each hop joins the edges once; edges that are themselves the result of a long plan are best written before."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0).cast(L))
    frontier = seen
    for hop in range(1, depth + 1):
        new = step.join(frontier.select("id"), "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop).cast(L))
        new = written(new, "frontier")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen.where("hop > 0")


def impact(edges: DataFrame, seeds: DataFrame, depth: int, names: DataFrame) -> DataFrame:
    """Names of what depends on the seeds within depth, each once with its least distance."""
    return trace(edges, seeds, depth, forward=False).join(names, "id").groupBy("name").agg(F.min("hop").alias("distance"))


def walks(edges: DataFrame, depth: int) -> DataFrame:
    """(id, paths): the number of ancestor paths of length 1 to depth that end at each node. Counts are carried along, so
    paths are never listed."""
    ending = edges.groupBy(F.col("dst").alias("id")).agg(n().alias("paths"))
    total = ending
    for _ in range(depth - 1):
        ending = edges.join(ending.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        total = total.unionByName(ending)
    return total.groupBy("id").agg(F.sum("paths").alias("paths"))


def degrees(edges: DataFrame) -> DataFrame:
    """A4: in and out degree, from one aggregation over both ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).cast(L).alias("i"), F.lit(1).cast(L).alias("o")).union(edges.select("dst", F.lit(1).cast(L), F.lit(0).cast(L)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def instability(edges: DataFrame) -> DataFrame:
    """Out / (in + out), and coupling."""
    both = F.col("in_degree") + F.col("out_degree")
    return degrees(edges).select("id", "in_degree", "out_degree", both.alias("coupling"), F.round(F.when(both == 0, 0.0).otherwise(F.col("out_degree") / both), 4).alias("instability"))


def bridges(edges: DataFrame) -> DataFrame:
    """Per node the pairs a -> n -> b with a != b, over the largest such count. in * out less the pairs with a = b
    gives the count without joining the pairs."""
    d = degrees(edges.where("src != dst"))
    back = edges.alias("x").join(edges.alias("y"), F.expr("x.src = y.dst AND x.dst = y.src AND x.src != x.dst")).groupBy(F.col("x.src").alias("id")).agg(n().alias("back"))
    counts = d.join(back, "id", "left").select("id", (F.col("in_degree") * F.col("out_degree") - F.coalesce("back", F.lit(0))).alias("bridges"))
    top = counts.agg(F.max("bridges").alias("top"))
    return counts.join(F.broadcast(top)).select("id", "bridges", F.round(F.when(F.col("top") == 0, 0.0).otherwise(F.col("bridges") / F.col("top")), 4).alias("betweenness"))  # one row


def loops(edges: DataFrame) -> DataFrame:
    """Nodes that call themselves."""
    return edges.where("src = dst").select(F.col("src").alias("id")).distinct()


def caller_counts(edges: DataFrame, symbols: DataFrame, kinds=("function", "method")) -> DataFrame:
    """Symbols of the kinds with the number of distinct callers, 0 without any."""
    callers = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return symbols.where(F.col("kind").isin(*kinds)).select("id", "name").join(callers, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast(L)))


def dead_code(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls."""
    return symbols.where(F.col("kind").isin("function", "method")).join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "name", "kind")


def resolve_suffix(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls(id, callee) to methods(id, name) where the callee is the name or ends with '.' and the name. The callee's
    dotted suffixes are exploded, so the join is by equality; all matches stay."""
    parts = F.split("callee", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return calls.select("id", "callee", F.explode(suffixes).alias("name")).join(methods.select("name", F.col("id").alias("target")), "name").select("id", "callee", "target").distinct()


def containing(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points(file, line) in spans(file, id, start, end); the span that starts first, then the least id. Spans are cut in bins
    of lines, so the join is by equality with a range filter."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    hit = points.withColumn("bin", F.floor(F.col("line") / width)).join(binned, ["file", "bin"]).where("line BETWEEN start AND end")
    return hit.groupBy("file", "line").agg(F.min_by("id", F.struct("start", "id")).alias("owner"))


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """The shortest span around each point, then the least id."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    hit = points.withColumn("bin", F.floor(F.col("line") / width)).join(binned, ["file", "bin"]).where("line BETWEEN start AND end")
    return hit.groupBy("file", "line").agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), F.col("id"))).alias("owner"))


def overlapping(hunks: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(id, hunks): spans(file, id, start, end) that a hunk(file, start, end) of their file touches. Both are cut in bins of lines; a
    pair counts in the first bin they share."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    h = hunks.withColumn("bin", bins).select("file", "bin", F.col("start").alias("hs"), F.col("end").alias("he"))
    near = spans.withColumn("bin", bins).join(h, ["file", "bin"]).where("hs <= end AND he >= start")
    return near.where(F.col("bin") == F.floor(F.greatest("start", "hs") / width)).groupBy("id").agg(n().alias("hunks"))


def change_impact(edges: DataFrame, changed: DataFrame, per_symbol: int = 10) -> DataFrame:
    """(id, caller, hop) callers within 2 hops of each changed(id), at most per_symbol of each, nearest first."""
    one = edges.join(changed.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("caller"), F.lit(1).cast(L).alias("hop"))
    two = one.join(edges.select(F.col("dst").alias("caller"), F.col("src").alias("next")), "caller").select("id", F.col("next").alias("caller"), F.lit(2).cast(L).alias("hop"))
    near = one.union(two).groupBy("id", "caller").agg(F.min("hop").alias("hop"))
    top = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("hop", "caller"))), 1, per_symbol).alias("top"))
    return top.select("id", F.explode("top").alias("t")).select("id", "t.caller", "t.hop")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, keep: int = 5) -> DataFrame:
    """G1: (id, rank), dangling mass shared out, ranks sum to 1. edges are distinct pairs."""
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(n().alias("out"))
    weighted = written(edges.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("w")), "edges")
    nodes = written(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling")), "nodes")
    size = nodes.count()
    if not size:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks = nodes.select("id", "dangling", F.lit(1.0 / size).alias("rank"))
    for i in range(rounds):
        given = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(given, "id", "left").join(F.broadcast(lost)).select("id", "dangling", ((1 - damping) / size + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / size)).alias("rank"))  # one row
        if (i + 1) % keep == 0:
            ranks = written(ranks, "ranks")
    return ranks.select("id", "rank")


def personalised(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 10, most_near: int = 1500, most_kept: int = 500) -> DataFrame:
    """(id, score) on out-edges of seeds(id, weight) and of up to most_kept of their neighbours, if those are fewer than
    most_near; dangling mass is lost; scores over the largest."""
    total = seeds.agg(F.sum("weight").alias("t"))
    start = seeds.join(F.broadcast(total)).select("id", (F.col("weight") / F.col("t")).alias("p"))  # one row
    first = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    near = first.select(F.col("dst").alias("id")).distinct().join(seeds.select("id"), "id", "left_anti")
    more = edges.join(near.orderBy("id").limit(most_kept).select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct() if near.limit(most_near).count() < most_near else first.where("false")
    sub = first.union(more).distinct()
    sub = written(sub.join(sub.groupBy("src").agg(n().alias("out")), "src").select("src", "dst", (1.0 / F.col("out")).alias("w")), "sub")
    scores = start.select("id", F.col("p").alias("score"))
    for i in range(rounds):
        given = sub.join(scores.select(F.col("id").alias("src"), "score"), "src").select(F.col("dst").alias("id"), ((1 - alpha) * F.col("score") * F.col("w")).alias("s"))
        scores = given.union(start.select("id", (alpha * F.col("p")).alias("s"))).groupBy("id").agg(F.sum("s").alias("score"))
        if i % 4 == 3:
            scores = written(scores, "scores")
    top = scores.agg(F.max("score").alias("top"))
    return scores.join(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("score"))  # one row


def label_propagation(edges: DataFrame, rounds: int = 5, resolution: float = 0.0) -> DataFrame:
    """communities(id, community) by synchronous propagation: each node takes the label most of its neighbours have, the
    least label on ties; resolution adds weight to its own. The native algorithm of the reference isn't deterministic, so this
    takes its place."""
    both = written(edges.where("src != dst").select("src", "dst").union(edges.where("src != dst").select("dst", "src")).distinct(), "both")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for i in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").select(F.col("src").alias("id"), "community", F.lit(1.0).alias("v"))
        votes = votes.union(labels.select("id", "community", F.lit(resolution))).groupBy("id", "community").agg(F.sum("v").alias("v"))
        labels = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community"))
        if i % 2:
            labels = written(labels, "labels")
    return labels


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (nodes, ari) for two partitions (id, community) of their common nodes."""
    both = a.select("id", F.col("community").alias("a")).join(b.select("id", F.col("community").alias("b")), "id")
    cell = both.groupBy("a", "b").agg(n().alias("c"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    s = cell.agg(pairs("c").alias("ij"), F.coalesce(F.sum("c"), F.lit(0)).alias("nodes"))
    x = cell.groupBy("a").agg(F.sum("c").alias("c")).agg(pairs("c").alias("i"))
    y = cell.groupBy("b").agg(F.sum("c").alias("c")).agg(pairs("c").alias("j"))
    all_ = F.col("nodes") * (F.col("nodes") - 1) / 2
    expected = F.when(all_ == 0, 0.0).otherwise(F.col("i") * F.col("j") / all_)
    mean = (F.col("i") + F.col("j")) / 2
    return s.join(F.broadcast(x)).join(F.broadcast(y)).select("nodes", F.round(F.when(mean == expected, 1.0).otherwise((F.col("ij") - expected) / (mean - expected)), 6).alias("ari"))  # one row each


def levels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level) by layers from the leaves: a node's level is one more than its callees' greatest. Self loops don't count; in a
    cycle the nodes with fewest remaining callees, then the least id, go first. Every node gets a level; more than `most` rounds are an error."""
    left = written(edges.where("src != dst").select("src", "dst").distinct(), "left")
    todo = written(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct(), "todo")
    done = None
    level = 0
    while not todo.isEmpty():
        if most is not None and level >= most:
            raise ValueError(f"nodes are left after {most} rounds")
        ready = todo.join(left.select(F.col("src").alias("id")), "id", "left_anti")
        if ready.isEmpty():
            ready = left.groupBy(F.col("src").alias("id")).agg(n().alias("c")).orderBy("c", "id").limit(1).select("id")
        ready = written(ready.withColumn("level", F.lit(level).cast(L)), "ready")
        done = ready if done is None else done.unionByName(ready)
        gone = ready.select("id")
        todo = written(todo.join(gone, "id", "left_anti"), "todo")
        left = written(left.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti"), "left")
        level += 1
    return done if done is not None else todo.withColumn("level", F.lit(0).cast(L))


def summaries(symbols: DataFrame, edges: DataFrame, levelled: DataFrame, depth: int | None = None, most: int = 5) -> DataFrame:
    """(id, summary) bottom up to the greatest level: kind, name, complexity, and up to five callees with the first sentence of
    theirs. A level over depth is an error."""
    own = symbols.select("id", "name", F.concat(F.initcap("kind"), F.lit(" "), "name", F.lit(". Complexity score: "), F.col("complexity").cast("string"), F.lit(".")).alias("own"))
    placed = written(own.join(levelled, "id", "left").withColumn("level", F.coalesce("level", F.lit(0).cast(L))), "placed")
    deepest = placed.agg(F.max("level")).first()[0] or 0
    if depth is not None and deepest > depth:
        raise ValueError(f"levels up to {deepest}; at most {depth}")
    out = placed.where("level = 0").select("id", "name", F.col("own").alias("summary"))
    for level in range(1, deepest + 1):
        mine = placed.where(F.col("level") == level)
        calls = edges.where("src != dst").select(F.col("src").alias("id"), F.col("dst").alias("callee")).distinct().join(mine.select("id"), "id", "left_semi").join(out.select(F.col("id").alias("callee"), F.col("name").alias("cname"), F.substring_index("summary", ". ", 1).alias("first")), "callee")
        listed = calls.groupBy("id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("callee", "cname", "first"))), 1, most), lambda c: F.concat(c["cname"], F.lit(" ("), c["first"], F.lit(")"))), ", ").alias("calls"))
        out = written(out.unionByName(mine.join(listed, "id", "left").select("id", "name", F.concat("own", F.when(F.col("calls").isNull(), "").otherwise(F.concat(F.lit(" Calls: "), "calls", F.lit(".")))).alias("summary"))), "summaries")
    return out.select("id", "summary")


def descend(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """K4: ids at or below seeds within depth."""
    return seeds.select("id").distinct().union(trace(edges, seeds, depth).select("id")).distinct()


def structural_embedding(edges: DataFrame, dim: int = 64, most_nodes: int = 20_000) -> DataFrame:
    """(id, vector array<tinyint>): truncated SVD of the symmetric adjacency, u times the root of s, smoothed over neighbours
    (0.5, 0.3, 0.2 of 0, 1 and 2 steps of the normalised adjacency), each row scaled to int8. Up to most_nodes nodes go to numpy
    in one task; a larger graph is refused, since its dense SVD has no distributed form here."""
    import numpy as np

    kind = edges.schema["src"].dataType.simpleString()
    pairs = edges.select("src", "dst").distinct()
    size = pairs.select("src").union(pairs.select("dst")).distinct().count()
    if size > most_nodes:
        raise ValueError(f"{size} nodes; at most {most_nodes}")

    def solve(frames):
        import pandas as pd

        pdf = pd.concat(list(frames)) if frames else pd.DataFrame(columns=["src", "dst"])
        if not len(pdf):
            return
        ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
        i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        a = np.zeros((len(ids), len(ids)))
        a[i, j] = 1
        a = a + a.T
        u, s, _ = np.linalg.svd(a, hermitian=True)
        k = max(1, min(dim, len(ids) - 1))
        x = u[:, :k] * np.sqrt(s[:k])
        x = x * np.where(x[np.abs(x).argmax(0), np.arange(k)] < 0, -1, 1)  # one sign for each column
        d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
        step = lambda v: d[:, None] * (a @ (d[:, None] * v))
        x = 0.5 * x + 0.3 * step(x) + 0.2 * step(step(x))
        top = np.abs(x).max(1, keepdims=True)
        q = np.pad(np.round(127 * x / np.where(top == 0, 1, top)).astype(np.int8), ((0, 0), (0, dim - k)))
        yield pd.DataFrame({"id": ids, "vector": list(q)})

    return pairs.coalesce(1).mapInPandas(solve, f"id {kind}, vector array<tinyint>")
