"""Lookups of symbols, class metrics and the code-quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L = "long"


def paged(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A slice of the ordered rows, each with total_count, the number of all."""
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, limit)).join(F.broadcast(total))  # one row is broadcast


def file_nodes(nodes: DataFrame, scope: Column, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Nodes of a file or folder whose name holds the text, in any case, paged in order of id."""
    return paged(nodes.where(scope & F.lower("name").contains(text.lower())), ["id"], limit, offset)


def usages(nodes: DataFrame, calls: DataFrame, text: str, most: int = 5) -> DataFrame:
    """The `most` best symbols for a text (by pagerank, then id), each with its `most` first callers, null where it has none."""
    found = nodes.where(F.lower("name").contains(text.lower())).orderBy(F.desc("pagerank"), "id").limit(most).select("id", "name")
    to = calls.join(F.broadcast(found.select(F.col("id").alias("dst"))), "dst").select("src", "dst").distinct()  # at most `most` rows are broadcast
    first = to.withColumn("k", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("k") <= most)
    return found.join(first.select(F.col("dst").alias("id"), F.col("src").alias("caller")), "id", "left")


def snippet(nodes: DataFrame, symbol: str, most: int = 10) -> DataFrame:
    """Symbols of that name or id; if there are none, those whose name ends with it."""
    exact = nodes.where((F.col("name") == symbol) | (F.col("id").cast("string") == symbol)).orderBy("id").limit(most)
    none = exact.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").drop("_n").withColumn("_none", F.lit(True))
    ends = nodes.where(F.col("name").endswith(symbol)).orderBy("id").limit(most).join(F.broadcast(none)).drop("_none")  # a row or none
    return exact.unionByName(ends)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Similarity edges (a, b, ...) in both directions."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def truncated(items: Column, limit: int) -> Column:
    """The first items of a list, and a marker with the number of the others."""
    more = F.concat(F.lit("... "), (F.size(items) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit), F.array(more))).otherwise(items)


def likely_calls(unresolved: DataFrame, symbols: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, dst, confidence) for calls (src, folder, name) without a target: of the symbols (id, folder, name) of that name, other
    than the caller, one of its folder (confidence 1), else any (0.5), the least id first. The two least ids of each name and folder are
    enough to pass over the caller, so callers never meet all symbols of a frequent name."""
    two = F.slice(F.sort_array(F.collect_set("id")), 1, 2)

    def least_two(*keys: str) -> DataFrame:
        ranked = symbols.select(*keys, "id").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
        return ranked.where("k <= 2").groupBy(*keys).agg(two.alias("_".join(("two", *keys))))

    other = lambda ids: F.try_element_at(F.filter(ids, lambda x: x != F.col("src")), F.lit(1))
    found = unresolved.join(least_two("name"), "name", "left").join(least_two("name", "folder"), ["name", "folder"], "left")
    here, there = other(F.col("two_name_folder")), other(F.col("two_name"))
    out = found.select("src", F.coalesce(here, there).alias("dst"), F.when(here.isNotNull(), 1.0).otherwise(0.5).alias("confidence"))
    return out.where(F.col("dst").isNotNull() & (F.col("confidence") > least))


def class_metrics(methods: DataFrame, calls: DataFrame, uses: DataFrame, parents: DataFrame, most_levels: int = 64) -> DataFrame:
    """M8: per class wmc (summed complexity), dit (levels above it), noc (children), cbo (other classes it calls or is called from), rfc
    (its methods and the methods of others that they call) and lcom (pairs of methods without a common field less those with one, 0 at least).

    methods(class, method, complexity), calls(src, dst) of methods, uses(method, field), parents(class, parent). Methods with the same
    fields are counted together, and only such groups are paired."""
    size = methods.groupBy("class").agg(F.sum("complexity").alias("wmc"), F.count(F.lit(1)).alias("m"))
    own = methods.select("class", "method")
    ends = calls.join(own.select(F.col("method").alias("src"), F.col("class").alias("a")), "src").join(own.select(F.col("method").alias("dst"), F.col("class").alias("b")), "dst").where("a != b")
    far = ends.groupBy("a").agg(F.countDistinct("dst").alias("far")).withColumnRenamed("a", "class")
    pairs = ends.select(F.col("a").alias("class"), F.col("b").alias("o")).union(ends.select("b", "a")).groupBy("class").agg(F.countDistinct("o").alias("cbo"))
    fields = own.join(uses.groupBy("method").agg(F.sort_array(F.collect_set("field")).alias("fields")), "method").groupBy("class", "fields").agg(F.count(F.lit(1)).alias("c"))
    each = fields.select("class", "fields", "c", F.explode("fields").alias("field"))
    x, y = each.alias("x"), each.alias("y")
    met = x.join(y, F.expr("x.class = y.class AND x.field = y.field AND x.fields < y.fields")).select(F.col("x.class").alias("class"), F.col("x.fields").alias("f"), F.col("y.fields").alias("g"), (F.col("x.c") * F.col("y.c")).alias("q")).distinct()
    within = fields.select("class", F.expr("c * (c - 1) div 2").alias("q"))
    joint = met.select("class", "q").union(within).groupBy("class").agg(F.sum("q").alias("q"))
    noc = parents.groupBy(F.col("parent").alias("class")).agg(F.countDistinct(parents["class"]).alias("noc"))
    depth = parents.select("class", "parent", F.lit(1).cast(L).alias("d"))
    tops, climbing = depth.select("class", "d"), depth
    up = parents.select(F.col("class").alias("parent"), F.col("parent").alias("next"))
    for _ in range(most_levels):
        climbing = climbing.join(up, "parent").select("class", F.col("next").alias("parent"), (F.col("d") + 1).alias("d"))
        if climbing.isEmpty():
            break
        tops = tops.union(climbing.select("class", "d"))
    else:
        raise ValueError("inheritance is deeper than most_levels, or has a cycle")
    out = size
    for other in (far, pairs, joint, noc, tops.groupBy("class").agg(F.max("d").alias("dit"))):
        out = out.join(other, "class", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(L)
    lcom = F.greatest(F.lit(0).cast(L), F.expr("m * (m - 1) div 2").cast(L) - 2 * zero("q"))
    return out.select("class", F.col("wmc").cast(L).alias("wmc"), zero("dit").alias("dit"), zero("noc").alias("noc"), zero("cbo").alias("cbo"), (F.col("m") + zero("far")).alias("rfc"), lcom.alias("lcom"))


def code_quality(files: DataFrame, bus: DataFrame) -> DataFrame:
    """Mean of three scores: mean complexity beyond 10, the bus factor (a quarter each), and the part of large files. files(complexity,
    large), bus(bus_factor) of one row."""
    f = files.agg(F.avg("complexity").alias("c"), F.avg(F.col("large").cast("double")).alias("part"))
    zero = F.lit(0.0)
    out = f.join(F.broadcast(bus.select("bus_factor"))).select(  # one row is broadcast
        F.round(F.greatest(zero, 100 - 10 * (F.col("c") - 10)), 4).alias("complexity"), F.least(25.0 * F.col("bus_factor"), F.lit(100.0)).alias("collaboration"), F.round(F.greatest(zero, 100 - 100 * F.col("part")), 4).alias("organisation")
    )
    return out.withColumn("score", F.round((F.col("complexity") + F.col("collaboration") + F.col("organisation")) / 3, 4))
