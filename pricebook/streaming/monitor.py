"""Monitoring of import runs: metrics, alerts, history and health, batch and streaming.

Functions named without ``stream`` take batch or streaming frames where a
projection suffices; ``*_stream`` variants add event-time windows or state.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricebook.functions.text import rx
from pricebook.operators import load as load_job
from pricebook.operators.scale import last_rows
from pricebook.sources import versions
from pricebook.sources.workbooks import decode_workbooks

# Metric patterns.
PROCESSING = r"traitement.*terminé.*en.*?(\d+(?:\.\d+)?)\s*secondes?"
SUCCESS = r"(\d+)\s*fichiers?\s*traités?\s*avec\s*succès"
TOTAL = r"total\s*de\s*(\d+)\s*fichiers?"
ERRORS = r"\berror\b|\berreur\b"
# Error families of the monitor.
ALERT_FAMILIES = {
    "sharepoint_connection": (r"sharepoint.*connection.*error", r"authentication.*failed", r"access.*denied.*sharepoint"),
    "excel_processing": (r"excel.*error", r"xlrd.*error", r"openpyxl.*error", r"engine.*not.*supported"),
    "timeout_issues": (r"timeout", r"connection.*timed.*out", r"request.*timeout"),
    "memory_issues": (r"memory.*error", r"out.*of.*memory", r"memoryerror"),
    "import_failures": (r"import.*failed", r"import.*error", r"database.*error"),
}
# Bounds: metric, comparison, bound, level, title.
BOUNDS = (("processing_time", ">", 300.0, "warning", "Temps de traitement élevé"),
          ("success_rate", "<", 0.8, "error", "Taux de succès faible"))


def extract_metrics(lines: DataFrame) -> DataFrame:
    """Metric values of each line: processing times, success rate where both counts stand, error words."""
    times = F.transform(F.regexp_extract_all("text", F.lit(rx(PROCESSING)), 1),
                        lambda v: F.struct(F.lit("processing_time").alias("name"), v.cast("double").alias("value")))
    ok, total = (F.regexp_extract("text", rx(p), 1).try_cast("double") for p in (SUCCESS, TOTAL))
    rate = F.when(total > 0, F.array(F.struct(F.lit("success_rate").alias("name"), F.try_divide(ok, total).alias("value"))))
    errors = F.regexp_count("text", F.lit(rx(ERRORS))).cast("double")
    count = F.when(errors > 0, F.array(F.struct(F.lit("error_count").alias("name"), errors.alias("value"))))
    empty = F.array().cast("array<struct<name:string,value:double>>")
    both = F.filter(F.coalesce(rate, empty), lambda s: s["value"].isNotNull())
    return lines.select("file", "line_no", "ts", F.explode(F.concat(times, both, F.coalesce(count, empty))).alias("m")).select(
        F.col("m.name").alias("name"), F.col("m.value").alias("value"), "ts", F.col("file").alias("source_file"), "line_no")


def file_success_rate(lines: DataFrame) -> DataFrame:
    """Rate of a whole log from its last success and total counts."""
    def last(p):
        v = F.element_at(F.regexp_extract_all("text", F.lit(rx(p)), 1), -1)
        hit = F.col("text").rlike(rx(p))
        return F.max_by(F.when(hit, v), F.when(hit, F.col("line_no"))).cast("double")
    r = lines.groupBy("file").agg(last(SUCCESS).alias("_s"), last(TOTAL).alias("_t"))
    return r.filter("_t > 0 and _s is not null").select(F.col("file").alias("source_file"), (F.col("_s") / F.col("_t")).alias("success_rate"))


def alert_hits(lines: DataFrame) -> DataFrame:
    """One row per line and family with the number of matching patterns' occurrences."""
    fam = [F.struct(F.lit(f).alias("family"), sum((F.regexp_count("text", F.lit(rx(p))) for p in ps[1:]),
                                                  F.regexp_count("text", F.lit(rx(ps[0])))).alias("n")) for f, ps in ALERT_FAMILIES.items()]
    return (lines.select("file", "line_no", "ts", "text", F.explode(F.array(*fam)).alias("h"))
            .filter("h.n > 0").select("file", "line_no", "ts", "text", F.col("h.family").alias("error_type"), F.col("h.n").alias("n")))


def _first_matches(h, keys, examples):
    """Occurrences, latest time and first matches in line order (repeated numbers: by text) per key."""
    w = Window.partitionBy(*keys).orderBy("line_no", "text")
    ex = (h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= examples).groupBy(*keys)
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("matches")))
    return h.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.max("ts").alias("ts")).join(ex, keys)


def error_alerts(lines: DataFrame, examples=5) -> DataFrame:
    """Alert per log and family with its occurrences and first examples."""
    return _first_matches(alert_hits(lines), ["file", "error_type"], examples).select(
        F.lit("warning").alias("level"), F.concat(F.lit("Erreur détectée: "), F.col("error_type")).alias("title"), "error_type",
        "occurrences", "matches", F.col("file").alias("source_file"), "ts")


def _windowed(hits, window):
    """Hits with the ends of their event-time window in milliseconds; lines without a time are in no window."""
    return hits.select(F.window("ts", window).alias("_w"), "file", "error_type", "ts", "n", F.col("line_no").cast("long").alias("line_no"),
                       "text").select("*", F.unix_millis("_w.start").alias("start_ms"), F.unix_millis("_w.end").alias("end_ms")).drop("_w")


def _alert_columns(df):
    return df.select(F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "error_type", "occurrences",
                     "matches", F.col("file").alias("source_file"))


ALERT_KEY = ["start_ms", "end_ms", "file", "error_type"]


class FirstMatches(StatefulProcessor):
    """One log and family in one event-time window: occurrences and the first ``examples`` matches by line number.

    The state holds one count and at most ``examples`` lines; it is sent and cleared when the watermark passes the end
    of the window. Lines of a window that was already sent are late and dropped, as Spark's own windows do.
    """

    examples = 5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long")
        self.first = handle.getListState("first", "line_no long, text string")

    def handleInputRows(self, key, rows, timerValues):
        end, n, kept = int(key[1]), 0, []
        late = end <= timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            if not late:
                n += int(pdf["n"].sum())
                kept = sorted(kept + list(zip(pdf["line_no"].astype("int64").tolist(), pdf["text"])))[:self.examples]
        if not late:
            before = self.total.get()[0] if self.total.exists() else 0
            self.total.update((before + n,))
            earlier = [tuple(x) for x in self.first.get()] if self.first.exists() else []
            self.first.put(sorted(earlier + kept)[:self.examples])
            self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, lines = self.total.get()[0], [text for _, text in self.first.get()]
        self.total.clear()
        self.first.clear()
        yield pd.DataFrame({"start_ms": [key[0]], "end_ms": [key[1]], "file": [key[2]], "error_type": [key[3]],
                            "occurrences": [n], "matches": [lines]})

    def close(self) -> None:
        pass


def _cut_matches(examples):
    """Per task and key the first matches only; the first of them carries the occurrences of all."""
    def run(batches):
        kept = None
        for pdf in batches:
            both = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(["line_no", "text"]).reset_index(drop=True)
            group = both.groupby(ALERT_KEY, sort=False, dropna=False)
            place = group.cumcount()
            both["n"] = group["n"].transform("sum").where(place == 0, 0)
            kept = both[place < examples]
        if kept is not None:
            yield kept
    return run


def error_alerts_stream(lines: DataFrame, window="5 minutes", delay="10 minutes", examples=5) -> DataFrame:
    """The same by event-time window: occurrences per log and family, with its first ``examples`` matching lines.

    A batch frame gives all windows. A stream (append mode, RocksDB state store provider) gives each window once, when
    the watermark passes its end; lines may come late by ``delay`` and in any order. Each task of a micro-batch passes
    on at most ``examples`` lines per key, so a failing log does not meet in one task. Lines carry a number.
    """
    if not lines.isStreaming:
        return _alert_columns(_first_matches(_windowed(alert_hits(lines), window), ALERT_KEY, examples))
    hits = _windowed(alert_hits(lines.withWatermark("ts", delay)), window).drop("ts")
    processor = type("AlertState", (FirstMatches,), {"examples": examples})
    sent = hits.select(*ALERT_KEY, "n", "line_no", "text").mapInPandas(
        _cut_matches(examples), "start_ms long, end_ms long, file string, error_type string, n long, line_no long, text string")
    return _alert_columns(sent.groupBy(*ALERT_KEY).transformWithStateInPandas(
        statefulProcessor=processor(), outputMode="Append", timeMode="EventTime",
        outputStructType="start_ms long, end_ms long, file string, error_type string, occurrences long, matches array<string>"))


def threshold_alerts(metrics: DataFrame, bounds=BOUNDS) -> DataFrame:
    """Metric values beyond their bound; a stream joins the same literal table."""
    table = metrics.sparkSession.createDataFrame(list(bounds), "name string, op string, bound double, level string, title string")
    beyond = F.when(F.col("op") == ">", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound"))
    return metrics.join(F.broadcast(table), "name").filter(beyond).select(      # two literal rules
        "level", "title", "name", "value", "bound", "ts", "source_file")


def metric_history(metrics: DataFrame, n=1000, order=("ts", "seq")) -> DataFrame:
    """Last ``n`` values per metric, for any ``n``; a metric is first cut to ``n`` rows in each of its hash buckets."""
    return last_rows(metrics, ["name"], [F.desc(c) for c in order], n, "rank")


class History(StatefulProcessor):
    """Keeps the last ``limit`` values of one metric and reports the count and mean kept."""

    limit = 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues):
        kept = list(self.values.get()) if self.values.exists() else []
        for pdf in rows:
            kept += [(t.to_pydatetime(), float(v)) for t, v in zip(pdf["ts"], pdf["value"])]
            kept = sorted(kept)[-self.limit:]
        self.values.put(kept)
        yield pd.DataFrame({"name": [key[0]], "kept": [len(kept)], "mean": [sum(v for _, v in kept) / len(kept)],
                            "last_value": [kept[-1][1]]})

    def close(self) -> None:
        pass


def _cut(n):
    """Per task, the last ``n`` values of each metric."""
    def run(batches):
        kept = None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf])
            kept = kept.sort_values(["ts", "value"]).groupby("name", sort=False).tail(n)
        if kept is not None:
            yield kept
    return run


def metric_history_stream(metrics: DataFrame, n=1000) -> DataFrame:
    """Bounded history per metric in stream state (needs the RocksDB state store provider).

    Each task of a micro-batch passes on at most ``n`` values per metric, so a busy metric does not meet in one task.
    """
    processor = type("BoundedHistory", (History,), {"limit": n})
    cut = metrics.select("name", "ts", "value").mapInPandas(_cut(n), "name string, ts timestamp, value double")
    return cut.groupBy("name").transformWithStateInPandas(
        statefulProcessor=processor(), outputStructType="name string, kept int, mean double, last_value double",
        outputMode="Update", timeMode="None")


def _mean(cond=None):
    v = F.col("value").cast("decimal(18,4)")
    v = v if cond is None else F.when(cond, v)
    return F.coalesce(F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double")), F.lit(0.0))


def metric_summary(metrics: DataFrame, now) -> DataFrame:
    """All-time and last-hour counts and means, extremes and last value per metric; ``now`` is a timestamp column."""
    recent = F.col("ts") > now - F.expr("interval 1 hour")
    return metrics.groupBy("name").agg(
        F.count("*").alias("total_count"), F.count_if(recent).alias("recent_count"), _mean().alias("average"), _mean(recent).alias("recent_average"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", F.struct("ts", "seq")).alias("last_value"))


def metric_summary_stream(metrics: DataFrame, window="1 hour", slide="5 minutes", delay="10 minutes") -> DataFrame:
    return (metrics.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "name")
            .agg(F.count("*").alias("n"), F.avg("value").alias("average"), F.min("value").alias("min"), F.max("value").alias("max"))
            .select("window.start", "window.end", "name", "n", "average", "min", "max"))


def stream_files(spark, path, max_files_per_trigger=1000) -> DataFrame:
    """New workbooks as a stream; with a checkpoint each file is seen once."""
    return (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,xls}").option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .schema("path string, modificationTime timestamp, length bigint, content binary").load(path))


def watch_folder(spark, path, checkpoint, on_batch, **options):
    """Run ``on_batch(listing, batch_id)`` for each set of new files until none is left; restart-safe."""
    listing = stream_files(spark, path, **options).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return (listing.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def import_new_files(spark, path, warehouse, checkpoint, stream="import", max_files_per_trigger=1000, on_existing="replace", today=None, **how):
    """Import workbooks as they appear, each exactly once, until none is left.

    The checkpoint gives a batch the same files and the same number again after a stop; the commit of an import carries
    (stream, number), so a batch that was committed before the stop is passed over and one that was not is done anew.
    ``stream`` names this query in the warehouse; use one name with one checkpoint.
    """
    def load(files, number):
        batch, run = (stream, number), f"{stream}-{number}"
        if not load_job.loaded_before(versions.version(files.sparkSession, warehouse), batch):
            found = load_job.detect_workbooks(files.sparkSession, decode_workbooks(files), run, **how)
            load_job.load_found(files.sparkSession, found, warehouse, run, on_existing, today, batch)

    return (stream_files(spark, path, max_files_per_trigger).writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def recent_alerts(alerts: DataFrame, now, hours=24) -> DataFrame:
    return alerts.filter(F.col("ts") > now - F.make_interval(hours=F.lit(hours)))


def commonest_family(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(1)


def health(summary: DataFrame, alerts: DataFrame) -> DataFrame:
    """Score and status from the recent means and the errors of the last hour (alerts already filtered)."""
    errors = alerts.agg(F.count_if(F.col("level").isin("error", "critical")).alias("errors"))
    s = summary.agg(F.max(F.when(F.col("name") == "processing_time", F.col("recent_average"))).alias("time"),
                    F.max(F.when(F.col("name") == "success_rate", F.col("recent_average"))).alias("rate"))
    j = errors.crossJoin(F.broadcast(s))      # two single aggregate rows
    return j.select("errors", *_score())


def _score():
    slow, low = F.coalesce(F.col("time") > 300, F.lit(False)), F.coalesce(F.col("rate") < 0.8, F.lit(False))
    score = 100 - 10 * F.col("errors") - F.when(slow, 20).otherwise(0) - F.when(low, 30).otherwise(0)
    return score.alias("score"), F.when(score >= 80, "healthy").when(score >= 60, "warning").otherwise("critical").alias("status")


def health_stream(metrics: DataFrame, window="1 hour", delay="10 minutes", bounds=BOUNDS) -> DataFrame:
    """Health per event-time window: means and threshold errors of the window; ``health_alerts`` applies as it is."""
    def count(name, op, bound):
        beyond = F.col("value") > bound if op == ">" else F.col("value") < bound
        return F.count_if((F.col("name") == name) & beyond)
    errors = [count(n, op, b) for n, op, b, level, _ in bounds if level in ("error", "critical")]
    g = metrics.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(
        sum(errors[1:], errors[0]).alias("errors") if errors else F.lit(0).alias("errors"),
        _mean(F.col("name") == "processing_time").alias("_time"), F.count_if(F.col("name") == "processing_time").alias("_nt"),
        _mean(F.col("name") == "success_rate").alias("_rate"), F.count_if(F.col("name") == "success_rate").alias("_nr"))
    g = g.select("window.start", "window.end", "errors", F.when(F.col("_nt") > 0, F.col("_time")).alias("time"),
                 F.when(F.col("_nr") > 0, F.col("_rate")).alias("rate"))
    return g.select("start", "end", "errors", *_score())


def health_alerts(h: DataFrame) -> DataFrame:
    return h.filter("status <> 'healthy'").select(
        F.when(F.col("status") == "critical", "critical").otherwise("warning").alias("level"),
        F.when(F.col("status") == "critical", "Santé du système critique").otherwise("Santé du système dégradée").alias("title"), "score")


def dedupe_lines(lines: DataFrame, delay="10 minutes") -> DataFrame:
    """Each (file, line) once, late and repeated lines dropped; batch frames are simply deduplicated."""
    if not lines.isStreaming:
        return lines.dropDuplicates(["file", "line_no"])
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file", "line_no"])
