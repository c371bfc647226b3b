"""

Every function takes DataFrames with the columns that codeloom.adapters documents, and returns a plan; nothing
is collected. Instants such as "now" are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L = "long"


def n(x: str = "*") -> Column:
    return F.count(F.lit(1) if x == "*" else x)


def ratio(a, b, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), digits)


def share_if(condition: Column, digits: int = 4) -> Column:
    return F.round(F.avg(condition.cast("double")), digits)


def entropy(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Shannon entropy (bits) of the shares of `by` within keys, from one count per pair."""
    counts = rows.groupBy(*keys, by).agg(n().alias("c"))
    # H = log2(N) - sum(c log2 c) / N, so no second pass over the pairs is needed
    return counts.groupBy(*keys).agg(F.sum("c").alias("N"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s")).select(*keys, F.round(F.abs(F.log2(F.col("N").cast("double")) - F.col("s") / F.col("N")), 4).alias("ownership_entropy"))


def file_features(changes: DataFrame, as_of: str) -> DataFrame:
    """Per file commits, churn, authors, ages, share of fixes and ownership entropy."""
    per_author = changes.groupBy("file", "author").agg(n().alias("c"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(F.col("fix").cast(L)).alias("fixes"))
    out = per_author.groupBy("file").agg(
        F.sum("c").alias("commits"), F.sum("churn").alias("churn"), n().alias("authors"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("fixes").alias("fixes"),
        F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"),
    )
    total = F.col("commits").cast("double")
    return out.select(
        "file", "commits", "churn", "authors", F.datediff("last", "first").cast(L).alias("survival_days"), F.datediff(F.lit(as_of).cast("date"), "last").cast(L).alias("days_since_change"),
        F.round(F.col("fixes") / total, 4).alias("bug_fix_ratio"), F.round(F.abs(F.log2(total) - F.col("s") / total), 4).alias("ownership_entropy"),
    )


def co_change(changed: DataFrame, least: int = 2, most: int = 50, count: int = 2, jaccard: float = 0.1) -> DataFrame:
    """Pairs of files that change together. changed(commit, file). Commits of more than `most` files are out, so
    pairs per commit are bounded."""
    files = changed.select("commit", "file").distinct()
    eligible = files.groupBy("commit").agg(n().alias("size")).where(F.col("size").between(least, most)).select("commit")
    kept = files.join(eligible, "commit")
    per_file = kept.groupBy("file").agg(n().alias("n"))
    # explode combinations inside a commit's bounded list: one shuffle by commit instead of a self-join
    lists = kept.groupBy("commit").agg(F.sort_array(F.collect_list("file")).alias("f"))
    pairs = lists.select(F.explode(F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(n().alias("together")).where(F.col("together") >= count)
    both = pairs.join(per_file.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(per_file.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return both.withColumn("jaccard", F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).where(F.col("jaccard") >= jaccard).select("a", "b", "together", F.round("jaccard", 6).alias("jaccard"))


def week_of_year(ts: str | Column) -> Column:
    """%W, weeks from Monday, days before the first Monday in week 0."""
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def histogram(rows: DataFrame, unit: str) -> DataFrame:
    """Counts by a unit of time, with the share of the busiest."""
    keys = {
        "hour": [F.hour("ts").cast(L).alias("hour")], "weekday": [F.weekday("ts").cast(L).alias("weekday")], "hour_of_week": [F.weekday("ts").cast(L).alias("weekday"), F.hour("ts").cast(L).alias("hour")],
        "month_of_year": [F.month("ts").cast(L).alias("month")], "year_week": [F.concat_ws("-", F.date_format("ts", "yyyy"), F.lpad(week_of_year("ts").cast("string"), 2, "0")).alias("year_week")],
    }[unit]
    return rows.groupBy(*keys).agg(n().alias("commits"))


def with_peak(counts: DataFrame, value: str = "commits") -> DataFrame:
    """Each row's distance to the busiest; the peak is aggregated, not windowed over one partition."""
    peak = counts.agg(F.max(value).alias("peak"))
    return counts.join(F.broadcast(peak)).withColumn("is_peak", (F.col(value) == F.col("peak")).cast(L)).drop("peak")  # one row


def by_period(commits: DataFrame, fmt: str, by_author: bool = False) -> DataFrame:
    """Commits by month or year, and by author."""
    keys = [F.date_format("ts", fmt).alias("period")] + (["author"] if by_author else [])
    return commits.groupBy(*keys).agg(n().alias("commits"))


def author_of_period(commits: DataFrame, fmt: str) -> DataFrame:
    """The author with most commits in each period; the least id wins ties. An aggregate, so hot periods combine early."""
    c = by_period(commits, fmt, True)
    return c.groupBy("period").agg(F.max_by("author", F.struct("commits", -F.col("author"))).alias("author"), F.max("commits").alias("commits"), n().alias("contenders"))


def author_totals(changes: DataFrame) -> DataFrame:
    """Commits and lines by author."""
    return changes.groupBy("author", "commit_id").agg(F.sum("added").alias("a"), F.sum("deleted").alias("d")).groupBy("author").agg(n().alias("commits"), F.sum("a").alias("added"), F.sum("d").alias("deleted"))


def author_spans(commits: DataFrame) -> DataFrame:
    """First and last day, active days and span of each author."""
    out = commits.groupBy("author").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.countDistinct(F.to_date("ts")).alias("active_days"), n().alias("commits"))
    return out.select("author", F.date_format("f", "yyyy-MM-dd").alias("first_day"), F.date_format("l", "yyyy-MM-dd").alias("last_day"), "active_days", "commits", F.datediff("l", "f").cast(L).alias("span_days"))


def _above(counts: DataFrame, value: str) -> DataFrame:
    """(value, m, above, sum_above): how many rows have each value, and how many, and what sum, have a greater one. The window runs over the
    distinct values, whose number grows like the root of their sum at most, not over rows."""
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    values = counts.groupBy(value).agg(n().alias("m"))
    zero = F.lit(0).cast(L)
    return values.select(value, "m", F.coalesce(F.sum("m").over(w), zero).alias("above"), F.coalesce(F.sum(F.col("m") * F.col(value)).over(w), zero).alias("sum_above"))


def placed(counts: DataFrame, value: str, name: str) -> DataFrame:
    """T5: each row's place by a value; equal values share the least."""
    return counts.join(_above(counts, value).select(value, (F.col("above") + 1).alias(name)), value).select(*counts.columns, name)


def ranked(counts: DataFrame, value: str, key: str) -> DataFrame:
    """Place by value (ties: the greater key first) and percent of the total. A row's place is the number of rows of greater values
    and its place among its equals."""
    total = counts.agg(F.sum(value).alias("total"))
    among = F.row_number().over(Window.partitionBy(value).orderBy(F.desc(key))).cast(L)
    out = counts.join(_above(counts, value).select(value, "above"), value).select(*counts.columns, (F.col("above") + among).alias("place"))
    return out.join(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col(value) / F.col("total"), 4)).drop("total")


def bus_factor(counts: DataFrame, value: str = "commits", key: str = "author", share: float = 0.5) -> DataFrame:
    """The fewest authors that reach the share of all commits: those of greater values, and as many of the value that crosses it as
    are needed."""
    total = counts.agg((share * F.sum(value)).alias("goal"), n().alias("authors"))
    reached = _above(counts, value).join(F.broadcast(total)).where(F.col("sum_above") + F.col("m") * F.col(value) >= F.col("goal"))
    needed = F.col("above") + F.greatest(F.lit(1), F.ceil((F.col("goal") - F.col("sum_above")) / F.col(value))).cast(L)
    return reached.groupBy("authors").agg(F.min(needed).alias("bus_factor"))


def daily_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.to_date("ts").alias("day")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def running_lines(changes: DataFrame) -> DataFrame:
    """Lines by day and the running net. The window runs over days, whose number calendar time bounds."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily_totals(changes).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "added", "deleted", F.sum(F.col("added") - F.col("deleted")).over(w).alias("total_lines"))


def author_running(changes: DataFrame) -> DataFrame:
    """Each author's commits and lines so far, by day."""
    daily = changes.groupBy("author", F.to_date("ts").alias("day")).agg(F.countDistinct("commit_id").alias("c"), F.sum("added").alias("a"))
    w = Window.partitionBy("author").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("author", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("c").over(w).alias("commits"), F.sum("a").over(w).alias("added"))


def monotone_stamps(rows: DataFrame, key: str) -> DataFrame:
    """Stamps that never go back, in order of key: a running maximum within each author."""
    w = Window.partitionBy("author").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("author", key, (F.max("ts").over(w) > F.col("ts")).cast(L).alias("moved"))


def pace(changes: DataFrame, unit: str) -> DataFrame:
    """Insertions and deletions together by week, month or year."""
    key = F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("period")
    return changes.groupBy(key).agg(F.sum(F.col("added") + F.col("deleted")).alias("pace"), F.countDistinct("commit_id").alias("commits"))


def streaks(rows: DataFrame) -> DataFrame:
    """Active days, longest run of consecutive days and mean gap of each author."""
    days = rows.select("author", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("author").orderBy("day")
    marked = days.select("author", "day", F.datediff("day", F.lag("day").over(w)).alias("gap"), F.date_sub("day", F.row_number().over(w)).alias("island"))
    runs = marked.groupBy("author", "island").agg(n().alias("run"), F.sum("gap").alias("gaps"), F.count("gap").alias("ngaps"))
    return runs.groupBy("author").agg(F.sum("run").alias("active_days"), F.max("run").alias("longest_streak"), F.round(F.coalesce(F.sum("gaps") / F.sum("ngaps"), F.lit(0.0)), 4).alias("mean_gap"))


#: Words that tell a commit's kind.
FEATURE = ("add", "new", "feature", "implement", "create")
REFACTOR = ("refactor", "cleanup", "reorganize", "restructure", "optimize")


def mentions(message: Column, words: tuple[str, ...]) -> Column:
    """whether a message holds one of the words, in any case."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(words))


def commit_sizes(changes: DataFrame) -> DataFrame:
    return changes.groupBy("commit_id", "author", "ts", "message", "fix").agg(F.sum(F.col("added") + F.col("deleted")).alias("size"), n().alias("files"))


def commit_patterns(changes: DataFrame) -> DataFrame:
    """Size classes, frequency, kinds (fixes; features and refactorings by their words) and files per commit of each author."""
    out = commit_sizes(changes).groupBy("author").agg(
        n().alias("commits"), F.round(F.avg("size"), 4).alias("mean_size"), F.sum((F.col("size") < 10).cast(L)).alias("small"), F.sum(((F.col("size") >= 10) & (F.col("size") < 100)).cast(L)).alias("medium"),
        F.sum((F.col("size") >= 100).cast(L)).alias("large"), F.sum(F.col("fix").cast(L)).alias("fixes"), F.sum(mentions(F.col("message"), FEATURE).cast(L)).alias("features"), F.sum(mentions(F.col("message"), REFACTOR).cast(L)).alias("refactorings"), F.round(F.avg("files"), 4).alias("mean_files"), F.datediff(F.max("ts"), F.min("ts")).alias("span"),
    )
    frequency = F.when(F.col("span") == 0, F.col("commits").cast("double")).otherwise(F.round(F.col("commits") / F.col("span"), 4))
    return out.withColumn("per_day", frequency).drop("span")


def commit_size_split(changes: DataFrame) -> DataFrame:
    """Whether commits are mostly small, often large, or balanced."""
    s = commit_sizes(changes).agg(n().alias("commits"), F.sum((F.col("size") < 10).cast(L)).alias("small"), F.sum((F.col("size") >= 100).cast(L)).alias("large"))
    return s.withColumn("style", F.when(F.col("small") > 0.5 * F.col("commits"), "small").when(F.col("large") > 0.2 * F.col("commits"), "large").otherwise("balanced"))


def working_patterns(rows: DataFrame) -> DataFrame:
    """Activity of each author by part of the day (night 22 to 6, early 6 to 9, work 9 to 17, evening 17 to 22)."""
    h, day = F.hour("ts"), F.weekday("ts")
    some = lambda c: F.sum(c.cast(L))
    hourly = rows.groupBy("author", h.alias("h"), day.alias("d")).agg(n().alias("c"))
    h, day, c = F.col("h"), F.col("d"), F.col("c")
    some = lambda k: F.sum(F.when(k, c).otherwise(F.lit(0).cast(L)))
    return hourly.groupBy("author").agg(
        F.sum(c).alias("total"), some((h >= 22) | (h < 6)).alias("night"), some((h >= 6) & (h < 9)).alias("early"), some((h >= 9) & (h < 17) & (day < 5)).alias("workday"), some((h >= 17) & (h < 22)).alias("evening"), some(day >= 5).alias("weekend"),
    )


def peak_hours(rows: DataFrame) -> DataFrame:
    """Each author's busiest hour and weekday; the earliest wins ties."""
    hours = rows.groupBy("author", F.hour("ts").cast(L).alias("u")).agg(n().alias("c")).groupBy("author").agg(F.max_by("u", F.struct("c", -F.col("u"))).alias("peak_hour"))
    days = rows.groupBy("author", F.weekday("ts").cast(L).alias("u")).agg(n().alias("c")).groupBy("author").agg(F.max_by("u", F.struct("c", -F.col("u"))).alias("peak_weekday"))
    return hours.join(days, "author")


def file_impact(changes: DataFrame, critical: Column) -> DataFrame:
    """min(10 changes, 100) + min(5 authors, 25) + 50 if critical."""
    out = changes.groupBy("file").agg(n().alias("changes"), F.countDistinct("author").alias("authors"))
    return out.withColumn("critical", critical.cast(L)).withColumn("impact", F.least(10 * F.col("changes"), F.lit(100).cast(L)) + F.least(5 * F.col("authors"), F.lit(25).cast(L)) + 50 * F.col("critical"))


def author_impact(changes: DataFrame, impact: DataFrame) -> DataFrame:
    """Over the files each author touched: critical ones, summed impact, those above 50; and the share of fixes."""
    touched = changes.groupBy("author", "file").agg(n().alias("c"), F.sum(F.col("fix").cast(L)).alias("fixes"))
    return touched.join(impact.select("file", "critical", "impact"), "file").groupBy("author").agg(
        n().alias("files"), F.sum("critical").alias("critical_files"), F.sum("impact").alias("impact"), F.sum((F.col("impact") > 50).cast(L)).alias("high_impact"), F.round(100.0 * F.sum("fixes") / F.sum("c"), 4).alias("maintenance_percent")
    )


def co_authors(changes: DataFrame) -> DataFrame:
    """Per author, the distinct others on the files that they touched. Authors by file come from one distinct list."""
    touched = changes.select("file", "author").distinct()
    pairs = touched.alias("a").join(touched.alias("b"), F.expr("a.file = b.file AND a.author != b.author")).select(F.col("a.author").alias("author"), F.col("b.author").alias("other")).distinct()
    return pairs.groupBy("author").agg(n().alias("coworkers"))


def size_score(avg: Column) -> Column:
    return F.when(avg < 20, 5 * avg).when(avg <= 50, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100 - 2 * (avg - 50)))


def team_performance(changes: DataFrame, impact: DataFrame) -> DataFrame:
    """Activity, consistency, collaboration and overall scores of each author, and the share of all commits."""
    pattern, streak = commit_patterns(changes), streaks(changes.select("author", "ts").distinct())
    joined = pattern.join(streak, "author").join(author_impact(changes, impact).select("author", "impact", "critical_files", "maintenance_percent"), "author").join(co_authors(changes), "author", "left")
    total = pattern.agg(F.sum("commits").alias("total"))
    hundred = lambda x: F.least(x, F.lit(100.0))
    diversity = F.greatest(F.lit(0.0), hundred(100 * (35.0 * F.col("features") + 35.0 * F.col("refactorings") + 30.0 * F.col("fixes")) / F.col("commits")))
    activity = 0.6 * size_score(F.col("mean_size")) + 0.4 * diversity
    gap = F.when(F.col("active_days") > 1, F.col("mean_gap")).otherwise(30.0)
    consistency = 0.4 * hundred(20 * F.col("per_day")) + 0.3 * hundred(5.0 * F.col("longest_streak")) + 0.3 * F.greatest(F.lit(0.0), 100 - 3 * gap)
    collaboration = 0.4 * hundred(F.col("impact") / 10.0) + 0.3 * hundred(10.0 * F.coalesce("coworkers", F.lit(0))) + 0.3 * hundred(20.0 * F.col("critical_files"))
    out = joined.select("author", "commits", activity.alias("x"), consistency.alias("y"), collaboration.alias("z")).join(F.broadcast(total))
    return out.select("author", F.round("x", 3).alias("activity"), F.round("y", 3).alias("consistency"), F.round("z", 3).alias("collaboration"), F.round(0.4 * F.col("x") + 0.3 * F.col("y") + 0.3 * F.col("z"), 3).alias("overall"), F.round(100.0 * F.col("commits") / F.col("total"), 3).alias("contribution"))


def recent(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Activity by day of the last so many days before an instant."""
    end = F.lit(as_of).cast("timestamp")
    return rows.where((F.col("ts") > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= end)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n().alias("commits"), F.countDistinct("author").alias("authors"))


def directory_activity(changes: DataFrame) -> DataFrame:
    """Commits, lines and files by directory ('.' for the root)."""
    d = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    return changes.groupBy(d.alias("dir")).agg(F.countDistinct("commit_id").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.countDistinct("file").alias("files"))


def most_revised(changes: DataFrame, k: int = 20) -> DataFrame:
    """The k files with most revisions."""
    return changes.groupBy("file").agg(n().alias("revisions")).orderBy(F.desc("revisions"), "file").limit(k)


def domains(commits: DataFrame, mail: Column) -> DataFrame:
    """Commits by the text after the last @, '?' without one."""
    d = F.when(F.instr(mail, "@") > 0, F.substring_index(mail, "@", -1)).otherwise("?")
    return commits.groupBy(d.alias("domain")).agg(n().alias("commits"), F.countDistinct("author").alias("authors"))


def work_distribution(totals: DataFrame) -> DataFrame:
    """Each author's percent of commits and of lines."""
    all_ = totals.agg(F.sum("commits").alias("c"), F.sum("added").alias("a"))
    return totals.join(F.broadcast(all_)).select("author", F.round(100.0 * F.col("commits") / F.col("c"), 4).alias("percent_commits"), F.round(100.0 * F.col("added") / F.col("a"), 4).alias("percent_lines"))


def files_per_commit_by_year(changes: DataFrame) -> DataFrame:
    """The largest and mean number of files of a commit by year."""
    return commit_sizes(changes).groupBy(F.year("ts").cast(L).alias("year")).agg(F.max("files").alias("most_files"), F.round(F.avg("files"), 4).alias("mean_files"), n().alias("commits"))


def tag_stats(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Commits and authors since the tag before. tags(tag, tag_ts) is a bounded list, so consecutive tags bound intervals
    that the commits are joined to by range."""
    w = Window.orderBy("tag_ts")
    spans = tags.select("tag", F.lag("tag_ts").over(w).alias("after"), F.col("tag_ts").alias("until"))
    inside = (F.col("ts") <= F.col("until")) & (F.col("after").isNull() | (F.col("ts") > F.col("after")))
    return commits.join(F.broadcast(spans), inside).groupBy("tag").agg(n().alias("commits"), F.countDistinct("author").alias("authors"))


def branch_stats(changes: DataFrame, branch: Column) -> DataFrame:
    """Commits, lines and authors of each branch, busiest first place."""
    return changes.groupBy(branch.alias("branch")).agg(F.countDistinct("commit_id").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.countDistinct("author").alias("authors"))


def extension_stats(files: DataFrame) -> DataFrame:
    """Files and lines by extension; '' where there is no dot, only a leading one, or more than 10 characters."""
    base = F.substring_index("filepath", "/", -1)
    ext = F.regexp_extract(base, r"^.+\.([^.]{1,10})$", 1)
    return files.groupBy(ext.alias("ext")).agg(n().alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("size"))


def repository_totals(changes: DataFrame) -> DataFrame:
    """One row of totals and averages; age counts days inclusively."""
    per = changes.groupBy("file").agg(n().alias("r"), F.sum("added").alias("a"), F.sum("deleted").alias("d"))
    files = per.agg(n().alias("files"), F.sum("a").alias("added"), F.sum("d").alias("deleted"), F.round(F.avg("r"), 4).alias("revisions_per_file"))
    whole = changes.agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors"), (F.floor(F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) / 86400) - F.floor(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))) / 86400) + 1).cast(L).alias("age_days"))
    return whole.join(F.broadcast(files))  # one row each
