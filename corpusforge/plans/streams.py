"""Extensions: queries that run as streams over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as X
from .runs import METRICS, _STEPS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("stream_dedup", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def stream_dedup(spark, d):
    s = X.first_of_text(X.read_folder(spark, f"{d}/documents.parquet").select("doc_id", "text"))
    return X.drain(s.select(F.md5("text").alias("text_md5")))


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    out = X.drain(X.window_counts(X.read_folder(spark, f"{d}/events.parquet"), late="36500 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_GAPS = "SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)"


@query("stream_sessions", f"SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM ({_GAPS}) GROUP BY user_id, k")
def stream_sessions(spark, d):
    out = X.drain(X.sessions(X.read_folder(spark, f"{d}/events.parquet"), late="36500 days"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_best", "SELECT run_name, step, val_loss FROM train_metrics WHERE val_loss IS NOT NULL AND step IS NOT NULL AND run_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_name ORDER BY val_loss, written_at, step) <= 3")
def stream_best(spark, d):
    """The three best rows of each run, kept as the rows come; the last state of each."""
    out = X.drain(X.best_rows(X.read_folder(spark, f"{d}/train_metrics.parquet")), "update")
    last = out.groupBy("run_name").agg(F.max("version").alias("version"))
    return out.join(last, ["run_name", "version"]).select("run_name", "step", "val_loss")


@query("stream_upsert", _STEPS)
def stream_upsert(spark, d):
    s = X.upserted(X.read_folder(spark, f"{d}/train_metrics.parquet"), ["run_name", "step"], "written_at", METRICS)
    return X.drain(s, "complete")
