"""Event-time operators that work on streams and tables alike (X1 to X10): debounced batches, windows, filters, telemetry, and the
incremental re-index as a foreachBatch sink. Watermarks and windows are extensions; the reference has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.store import upsert


def late(events: DataFrame, delay: str | None, ts: str = "ts") -> DataFrame:
    """Events with a watermark; on a table it has no effect."""
    return events.withWatermark(ts, delay) if delay else events


def debounced(events: DataFrame, gap: str = "2 seconds", keys: list[str] | None = None, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Batches of events no further apart than the gap: keys, start, end and the number of events."""
    w = F.session_window(ts, gap)
    out = late(events, delay, ts).groupBy(w.alias("w"), *(keys or [])).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*(keys or []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def debounced_paths(events: DataFrame, gap: str = "2 seconds", delay: str | None = None) -> DataFrame:
    """The distinct paths of each batch of file events (ts, path)."""
    return late(events, delay).groupBy(F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths")).select(F.col("w.start").alias("start"), "paths")


def tumbling(events: DataFrame, width: str, keys: list[str], ts: str = "ts", value: str = "value", delay: str | None = None) -> DataFrame:
    out = late(events, delay, ts).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", value: str = "value", delay: str | None = None) -> DataFrame:
    out = late(events, delay, ts).groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "n", "mean")


def accepted(events: DataFrame, *ignored: Column) -> DataFrame:
    """Events that no rule ignores."""
    for rule in ignored:
        events = events.where(~rule)
    return events


def telemetry(searches: DataFrame) -> DataFrame:
    """searches(mode, latency_ms) by mode."""
    return searches.groupBy("mode").agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.max("latency_ms"), 4).alias("max_latency"))


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key, with state that the watermark bounds."""
    return late(events, delay, ts).dropDuplicatesWithinWatermark(keys)


def reindexed(changes: DataFrame, store: str, keys: list[str], keep: tuple[str, ...] = ()) -> DataStreamWriter:
    """A stream of rows upserted into the Parquet table below `store`, one version a batch; the version file names the
    last complete one, so a batch that runs again writes the same version again."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, store, number) if number else None
        rows = batch.dropDuplicates(keys)
        (rows if old is None else upsert(old, rows, keys, keep)).write.mode("overwrite").parquet(f"{store}/version={number:012d}")

    return changes.writeStream.foreachBatch(apply)


def latest(spark, store: str, before: int | None = None) -> DataFrame | None:
    """The table's last complete version, or the last before a number."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(root)]
    done = sorted(n for n in found if n.startswith("version=") and fs.exists(hadoop.Path(f"{store}/{n}/_SUCCESS")) and (before is None or int(n[8:]) < before))
    return spark.read.parquet(f"{store}/{done[-1]}") if done else None


def observed(events: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Events with counters that listeners see."""
    return events.observe(name, F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))


def on_batches(handler: Callable[[int, int], None]):
    """A listener that is told each batch's number and rows."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            handler(event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    return Listener()
