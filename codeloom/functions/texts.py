"""Small text functions (F18) and the checks of a request (P18), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes, the longest query, the largest limit and depth, characters that a file name can't hold.
MODES = "fts callers callees impact usages intent dsl functional-analysis cypher hybrid semantic community trace snippet explain auto".split()
LONGEST_QUERY, MOST_ROWS, DEEPEST = 200, 100, 10
UNSAFE = '/\\:*?"<>|'


def duration(seconds: Column) -> Column:
    """'12.3s', '2m 5s' or '1h 2m 5s'; halves go to the even digit. Null for null."""
    s = seconds.cast("double")
    whole = lambda x: F.floor(x).cast("string")
    rest = F.concat(F.bround(F.pmod(s, F.lit(60.0)), 0).cast("long").cast("string"), F.lit("s"))
    minutes = F.concat(whole(F.pmod(s, F.lit(3600.0)) / 60), F.lit("m "), rest)
    return F.when(s < 60, F.concat(F.format_string("%.1f", F.bround(s, 1)), F.lit("s"))).when(s < 3600, minutes).otherwise(F.concat(whole(s / 3600), F.lit("h "), minutes))


def file_name(text: Column) -> Column:
    """Each unsafe character as an underscore."""
    return F.translate(text, UNSAFE, "_" * len(UNSAFE))


def stamp(text: Column) -> Column:
    """A whole number of seconds; 0 for anything else, null too."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint")), F.lit(0).cast("long"))


def checked(requests: DataFrame) -> DataFrame:
    """Requests (query, mode, limit, offset, depth, ...) with query and mode trimmed, numbers brought into their ranges, and error: null,
    'mode' for an unknown mode, else 'query' for a NUL or line end inside the query."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    between = lambda c, low, high: F.greatest(F.lit(low), F.least(F.col(c), F.lit(high)) if high else F.col(c)).cast("long").alias(c)
    query, mode = F.substring(trim("query"), 1, LONGEST_QUERY), F.lower(trim("mode"))
    error = F.when(~F.coalesce(mode.isin(MODES), F.lit(False)), "mode").when(query.rlike(r"[\x00\n\r]"), "query")
    done = {"query": query.alias("query"), "mode": mode.alias("mode"), "limit": between("limit", 1, MOST_ROWS), "offset": between("offset", 0, None), "depth": between("depth", 1, DEEPEST)}
    return requests.select(*(done.get(c, F.col(c)) for c in requests.columns), error.alias("error"))
