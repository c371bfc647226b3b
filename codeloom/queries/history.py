
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..operators import history as H
from ..session import written
from . import query

ENTROPY = "round(abs(log2(CAST(sum(c) AS DOUBLE)) - sum(c * log2(CAST(c AS DOUBLE))) / sum(c)), 4)"


@query(with_("changes", f"""
, pa AS (SELECT file, author, count(*) AS c, sum(added + deleted) AS churn, min(ts) AS f, max(ts) AS l, count(*) FILTER (fix) AS fixes FROM changes GROUP BY file, author)
SELECT file, CAST(sum(c) AS BIGINT) AS commits, CAST(sum(churn) AS BIGINT) AS churn, count(*) AS authors, date_diff('day', CAST(min(f) AS DATE), CAST(max(l) AS DATE)) AS survival_days,
  date_diff('day', CAST(max(l) AS DATE), DATE '{A.AS_OF_COMMITS}') AS days_since_change, round(CAST(sum(fixes) AS DOUBLE) / sum(c), 4) AS bug_fix_ratio, {ENTROPY} AS ownership_entropy
FROM pa GROUP BY file"""))
def file_history_features(spark, d):
    return H.file_features(A.changes(spark, d), A.AS_OF_COMMITS)


@query(f"WITH p AS (SELECT l_suppkey AS supplier, l_partkey, count(*) AS c FROM lineitem GROUP BY ALL) SELECT supplier, {ENTROPY} AS ownership_entropy FROM p GROUP BY supplier")
def ownership_entropy(spark, d):
    return H.entropy(A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey"), ["supplier"], "l_partkey")


@query(with_("activity", """
, f AS (SELECT DISTINCT author, file FROM activity), e AS (SELECT author FROM f GROUP BY author HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT * FROM f SEMI JOIN e USING (author)),
n AS (SELECT file, count(*) AS n FROM k GROUP BY file), p AS (SELECT a.file AS a, b.file AS b, count(*) AS together FROM k a JOIN k b ON a.author = b.author AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, together, round(CAST(together AS DOUBLE) / (x.n + y.n - together), 6) AS jaccard FROM p JOIN n x ON x.file = a JOIN n y ON y.file = b WHERE CAST(together AS DOUBLE) / (x.n + y.n - together) >= 0.1"""))
def co_change_jaccard(spark, d):
    return H.co_change(A.activity(spark, d).select(F.col("author").alias("commit"), "file"))


@query(with_("activity", "SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS commits FROM activity GROUP BY 1, 2"))
def activity_hour_of_week(spark, d):
    return H.histogram(A.activity(spark, d), "hour_of_week")


@query(with_("activity", ", h AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS commits FROM activity GROUP BY 1) SELECT *, CAST(commits = (SELECT max(commits) FROM h) AS BIGINT) AS is_peak FROM h"))
def activity_hour_of_day(spark, d):
    return H.with_peak(H.histogram(A.activity(spark, d), "hour"))


@query(with_("activity", ", h AS (SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, count(*) AS commits FROM activity GROUP BY 1) SELECT *, CAST(commits = (SELECT max(commits) FROM h) AS BIGINT) AS is_peak FROM h"))
def activity_weekday(spark, d):
    return H.with_peak(H.histogram(A.activity(spark, d), "weekday"))


@query(with_("commits", "SELECT strftime(ts, '%Y-%W') AS year_week, count(*) AS commits FROM commits GROUP BY 1"))
def activity_year_week(spark, d):
    return H.histogram(A.commits(spark, d), "year_week")


@query(with_("commits", "SELECT CAST(month(ts) AS BIGINT) AS month, count(*) AS commits FROM commits GROUP BY 1"))
def activity_month_of_year(spark, d):
    return H.histogram(A.commits(spark, d), "month_of_year")


@query(with_("commits", "SELECT strftime(ts, '%Y-%m') AS period, count(*) AS commits FROM commits GROUP BY 1"))
def commits_by_month(spark, d):
    return H.by_period(A.commits(spark, d), "yyyy-MM")


@query(with_("commits", "SELECT strftime(ts, '%Y') AS period, author, count(*) AS commits FROM commits GROUP BY 1, 2"))
def commits_by_author_year(spark, d):
    return H.by_period(A.commits(spark, d), "yyyy", True)


AUTHOR_OF = ", c AS (SELECT strftime(ts, '{}') AS period, author, count(*) AS commits FROM commits GROUP BY 1, 2) SELECT period, max_by(author, struct_pack(c := commits, a := -author)) AS author, max(commits) AS commits, count(*) AS contenders FROM c GROUP BY period"


@query(with_("commits", AUTHOR_OF.format("%Y-%m")))
def author_of_month(spark, d):
    return H.author_of_period(A.commits(spark, d), "yyyy-MM")


@query(with_("commits", AUTHOR_OF.format("%Y")))
def author_of_year(spark, d):
    return H.author_of_period(A.commits(spark, d), "yyyy")


TOTALS = ", per AS (SELECT author, commit_id, sum(added) AS a, sum(deleted) AS d FROM changes GROUP BY 1, 2), totals AS (SELECT author, count(*) AS commits, CAST(sum(a) AS BIGINT) AS added, CAST(sum(d) AS BIGINT) AS deleted FROM per GROUP BY author) "


@query(with_("changes", TOTALS + "SELECT * FROM totals"))
def author_totals(spark, d):
    return H.author_totals(A.changes(spark, d))


@query(with_("commits", "SELECT author, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) AS commits, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span_days FROM commits GROUP BY author"))
def author_spans(spark, d):
    return H.author_spans(A.commits(spark, d))


@query(with_("commits", ", c AS (SELECT author, count(*) AS commits FROM commits GROUP BY 1) SELECT author, commits, row_number() OVER (ORDER BY commits DESC, author DESC) AS place, round(100.0::DOUBLE * commits / sum(commits) OVER (), 4) AS percent FROM c"))
def author_rank(spark, d):
    return H.ranked(A.commits(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("commits")), "commits", "author")


@query(with_("commits", ", c AS (SELECT author, count(*) AS commits FROM commits GROUP BY 1), r AS (SELECT sum(commits) OVER (ORDER BY commits DESC, author ROWS UNBOUNDED PRECEDING) AS reached, row_number() OVER (ORDER BY commits DESC, author) AS place, sum(commits) OVER () AS total, count(*) OVER () AS authors FROM c) SELECT authors, min(place) AS bus_factor FROM r WHERE reached >= 0.5 * total GROUP BY authors"))
def bus_factor(spark, d):
    return H.bus_factor(A.commits(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("commits")))


@query(with_("changes", ", t AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM changes GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, added, deleted, CAST(sum(added - deleted) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_lines FROM t"))
def running_net_loc(spark, d):
    return H.running_lines(A.changes(spark, d))


@query(with_("changes", ", t AS (SELECT author, CAST(ts AS DATE) AS day, count(DISTINCT commit_id) AS c, sum(added) AS a FROM changes GROUP BY 1, 2) SELECT author, strftime(day, '%Y-%m-%d') AS day, CAST(sum(c) OVER w AS BIGINT) AS commits, CAST(sum(a) OVER w AS BIGINT) AS added FROM t WINDOW w AS (PARTITION BY author ORDER BY day ROWS UNBOUNDED PRECEDING)"))
def author_running_totals(spark, d):
    return H.author_running(A.changes(spark, d))


@query(with_("commits", "SELECT author, commit_id, CAST(epoch_us(max(ts) OVER (PARTITION BY author ORDER BY commit_id ROWS UNBOUNDED PRECEDING)) > epoch_us(ts) AS BIGINT) AS moved FROM commits"))
def clock_skew_fix(spark, d):
    return H.monotone_stamps(A.commits(spark, d), "commit_id")


PACE = "SELECT strftime(date_trunc('{}', ts), '%Y-%m-%d') AS period, CAST(sum(added + deleted) AS BIGINT) AS pace, count(DISTINCT commit_id) AS commits FROM changes GROUP BY 1"


@query(with_("changes", PACE.format("week")))
def pace_by_week(spark, d):
    return H.pace(A.changes(spark, d), "week")


@query(with_("changes", PACE.format("month")))
def pace_by_month(spark, d):
    return H.pace(A.changes(spark, d), "month")


STREAKS = """, days AS (SELECT DISTINCT author, CAST(ts AS DATE) AS day FROM {src}), m AS (SELECT author, day, date_diff('day', lag(day) OVER w, day) AS gap, day - CAST(row_number() OVER w AS INT) AS island FROM days WINDOW w AS (PARTITION BY author ORDER BY day)),
runs AS (SELECT author, island, count(*) AS run, sum(gap) AS gaps, count(gap) AS ngaps FROM m GROUP BY 1, 2),
streak AS (SELECT author, CAST(sum(run) AS BIGINT) AS active_days, max(run) AS longest_streak, round(coalesce(CAST(sum(gaps) AS DOUBLE) / nullif(sum(ngaps), 0), 0), 4) AS mean_gap FROM runs GROUP BY author) """


@query(with_("activity", STREAKS.format(src="activity") + "SELECT * FROM streak"))
def author_streaks(spark, d):
    return H.streaks(A.activity(spark, d))


PATTERNS = """, sizes AS (SELECT commit_id, author, ts, message, fix, sum(added + deleted) AS size, count(*) AS files FROM changes GROUP BY ALL),
pattern AS (SELECT author, count(*) AS commits, round(avg(size), 4) AS mean_size, count(*) FILTER (size < 10) AS small, count(*) FILTER (size >= 10 AND size < 100) AS medium, count(*) FILTER (size >= 100) AS "large", count(*) FILTER (fix) AS fixes, count(*) FILTER (regexp_matches(lower(message), 'add|new|feature|implement|create')) AS features, count(*) FILTER (regexp_matches(lower(message), 'refactor|cleanup|reorganize|restructure|optimize')) AS refactorings, round(avg(files), 4) AS mean_files,
  CASE WHEN date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) = 0 THEN CAST(count(*) AS DOUBLE) ELSE round(CAST(count(*) AS DOUBLE) / date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 4) END AS per_day FROM sizes GROUP BY author) """


@query(with_("changes", PATTERNS + "SELECT * FROM pattern"))
def commit_patterns(spark, d):
    return H.commit_patterns(A.changes(spark, d))


@query(with_("changes", PATTERNS + """, s AS (SELECT count(*) AS commits, count(*) FILTER (size < 10) AS small, count(*) FILTER (size >= 100) AS "large" FROM sizes) SELECT *, CASE WHEN small > 0.5 * commits THEN 'small' WHEN "large" > 0.2 * commits THEN 'large' ELSE 'balanced' END AS style FROM s"""))
def commit_size_split(spark, d):
    return H.commit_size_split(A.changes(spark, d))


@query(with_("activity", """, h AS (SELECT author, hour(ts) AS h, isodow(ts) - 1 AS d FROM activity) SELECT author, count(*) AS total, count(*) FILTER (h >= 22 OR h < 6) AS night, count(*) FILTER (h >= 6 AND h < 9) AS early, count(*) FILTER (h >= 9 AND h < 17 AND d < 5) AS workday, count(*) FILTER (h >= 17 AND h < 22) AS evening, count(*) FILTER (d >= 5) AS weekend FROM h GROUP BY author"""))
def working_patterns(spark, d):
    return H.working_patterns(A.activity(spark, d))


@query(with_("activity", """, h AS (SELECT author, CAST(hour(ts) AS BIGINT) AS u, count(*) AS c FROM activity GROUP BY 1, 2), w AS (SELECT author, CAST(isodow(ts) - 1 AS BIGINT) AS u, count(*) AS c FROM activity GROUP BY 1, 2),
a AS (SELECT author, max_by(u, struct_pack(c := c, u := -u)) AS peak_hour FROM h GROUP BY author), b AS (SELECT author, max_by(u, struct_pack(c := c, u := -u)) AS peak_weekday FROM w GROUP BY author) SELECT * FROM a JOIN b USING (author)"""))
def peak_hours(spark, d):
    return H.peak_hours(A.activity(spark, d))


IMPACT = """, im AS (SELECT file, count(*) AS changes, count(DISTINCT author) AS authors, CAST(contains(file, 'Brand#1/') AS BIGINT) AS critical FROM changes GROUP BY file),
impact AS (SELECT *, least(10 * changes, 100) + least(5 * authors, 25) + 50 * critical AS impact FROM im) """
AUTHOR_IMPACT = """, touched AS (SELECT author, file, count(*) AS c, count(*) FILTER (fix) AS fixes FROM changes GROUP BY 1, 2),
author_impact AS (SELECT author, count(*) AS files, CAST(sum(critical) AS BIGINT) AS critical_files, CAST(sum(impact) AS BIGINT) AS impact, count(*) FILTER (impact > 50) AS high_impact, round(100.0::DOUBLE * sum(fixes) / sum(c), 4) AS maintenance_percent FROM touched JOIN impact USING (file) GROUP BY author) """


def critical():
    return F.col("file").contains("Brand#1/")



@query(with_("changes", IMPACT + "SELECT * FROM impact"))
def file_impact_scores(spark, d):
    return H.file_impact(A.changes(spark, d), critical())


@query(with_("changes", IMPACT + AUTHOR_IMPACT + "SELECT * FROM author_impact"))
def author_impact(spark, d):
    changes = A.changes(spark, d)
    return H.author_impact(changes, H.file_impact(changes, critical()))


CO = ", fa AS (SELECT DISTINCT file, author FROM changes), co AS (SELECT a.author, count(DISTINCT b.author) AS coworkers FROM fa a JOIN fa b ON a.file = b.file AND a.author <> b.author GROUP BY a.author) "


@query(with_("changes", CO + "SELECT * FROM co"))
def co_authors(spark, d):
    return H.co_authors(A.changes(spark, d))


@query(with_("changes", PATTERNS + STREAKS.format(src="changes") + IMPACT + AUTHOR_IMPACT + CO + """, x AS (SELECT p.author, p.commits, sum(p.commits) OVER () AS total,
  0.6::DOUBLE * (CASE WHEN mean_size < 20 THEN 5 * mean_size WHEN mean_size <= 50 THEN 100 ELSE greatest(0, 100 - 2 * (mean_size - 50)) END) + 0.4::DOUBLE * greatest(0, least(100, 100 * (35.0::DOUBLE * features + 35.0::DOUBLE * refactorings + 30.0::DOUBLE * p.fixes) / p.commits)) AS x,
  0.4::DOUBLE * least(20 * per_day, 100) + 0.3::DOUBLE * least(5.0::DOUBLE * longest_streak, 100) + 0.3::DOUBLE * greatest(0, 100 - 3 * (CASE WHEN active_days > 1 THEN mean_gap ELSE 30 END)) AS y,
  0.4::DOUBLE * least(impact / 10.0::DOUBLE, 100) + 0.3::DOUBLE * least(10.0::DOUBLE * coalesce(coworkers, 0), 100) + 0.3::DOUBLE * least(20.0::DOUBLE * critical_files, 100) AS z
  FROM pattern p JOIN streak s USING (author) JOIN author_impact i ON i.author = p.author LEFT JOIN co ON co.author = p.author)
SELECT author, round(x, 3) AS activity, round(y, 3) AS consistency, round(z, 3) AS collaboration, round(0.4::DOUBLE * x + 0.3::DOUBLE * y + 0.3::DOUBLE * z, 3) AS overall, round(100.0::DOUBLE * commits / total, 3) AS contribution FROM x"""))
def team_performance(spark, d):
    changes = written(A.changes(spark, d).select("commit_id", "author", "ts", "message", "fix", "file", "added", "deleted"), "changes")  # five branches read it
    return H.team_performance(changes, H.file_impact(changes, critical()))


@query(with_("activity", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS commits, count(DISTINCT author) AS authors FROM activity WHERE ts > TIMESTAMP '{A.AS_OF_EVENTS}' - INTERVAL 30 DAYS AND ts <= TIMESTAMP '{A.AS_OF_EVENTS}' GROUP BY 1"))
def recent_activity(spark, d):
    return H.recent(A.activity(spark, d), A.AS_OF_EVENTS, 30)


@query(with_("changes", "SELECT regexp_replace(file, '/[^/]*$', '') AS dir, count(DISTINCT commit_id) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT file) AS files FROM changes GROUP BY 1"))
def dir_activity(spark, d):
    return H.directory_activity(A.changes(spark, d))


@query(with_("changes", "SELECT file, count(*) AS revisions FROM changes GROUP BY file ORDER BY revisions DESC, file LIMIT 20"))
def top_revised_files(spark, d):
    return H.most_revised(A.changes(spark, d))


@query(with_("commits", ", m AS (SELECT author, CASE author % 3 WHEN 0 THEN 'a@x' || (author % 5) || '.org' WHEN 1 THEN 'b@' || subject ELSE 'none' END AS mail FROM commits) SELECT CASE WHEN contains(mail, '@') THEN regexp_extract(mail, '@([^@]*)$', 1) ELSE '?' END AS domain, count(*) AS commits, count(DISTINCT author) AS authors FROM m GROUP BY 1"))
def email_domains(spark, d):
    a = F.col("author")
    mail = F.when(a % 3 == 0, F.concat(F.lit("a@x"), (a % 5).cast("string"), F.lit(".org"))).when(a % 3 == 1, F.concat(F.lit("b@"), "subject")).otherwise("none")
    return H.domains(A.commits(spark, d), mail)


@query(with_("changes", TOTALS + "SELECT author, round(100.0::DOUBLE * commits / (SELECT sum(commits) FROM totals), 4) AS percent_commits, round(100.0::DOUBLE * added / (SELECT sum(added) FROM totals), 4) AS percent_lines FROM totals"))
def work_distribution(spark, d):
    return H.work_distribution(H.author_totals(A.changes(spark, d)))


@query(with_("changes", PATTERNS + "SELECT CAST(year(ts) AS BIGINT) AS year, max(files) AS most_files, round(avg(files), 4) AS mean_files, count(*) AS commits FROM sizes GROUP BY 1"))
def files_per_commit_by_year(spark, d):
    return H.files_per_commit_by_year(A.changes(spark, d))


@query(with_("commits", ", tags AS (SELECT 'v' || y AS tag, make_timestamp(y, 7, 1, 0, 0, 0.0) AS t FROM range(1995, 2002) r(y)), s AS (SELECT tag, lag(t) OVER (ORDER BY t) AS a, t AS u FROM tags) SELECT tag, count(*) AS commits, count(DISTINCT author) AS authors FROM commits JOIN s ON ts <= u AND (a IS NULL OR ts > a) GROUP BY tag"))
def tag_stats(spark, d):
    tags = spark.range(1995, 2002).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("tag"), F.make_timestamp(F.col("id").cast("int"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("tag_ts"))
    return H.tag_stats(A.commits(spark, d), tags)


@query(with_("changes", "SELECT substr(subject, 3) AS branch, count(DISTINCT commit_id) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT author) AS authors FROM changes GROUP BY 1"))
def branch_stats(spark, d):
    return H.branch_stats(A.changes(spark, d), F.substring("subject", 3, 100))


@query(with_("changes", ", p AS (SELECT file, count(*) AS r, sum(added) AS a, sum(deleted) AS d FROM changes GROUP BY file) SELECT (SELECT count(DISTINCT commit_id) FROM changes) AS commits, (SELECT count(DISTINCT author) FROM changes) AS authors, (SELECT CAST(floor(epoch(max(ts)) / 86400) - floor(epoch(min(ts)) / 86400) + 1 AS BIGINT) FROM changes) AS age_days, count(*) AS files, CAST(sum(a) AS BIGINT) AS added, CAST(sum(d) AS BIGINT) AS deleted, round(avg(r), 4) AS revisions_per_file FROM p"))
def repository_totals(spark, d):
    return H.repository_totals(A.changes(spark, d))
