"""Queries over metric series of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import runs as M
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


METRICS = ("train_loss", "lr", "grad_norm", "tokens_per_sec", "val_loss")
_STEPS = "SELECT run_name, step, " + ", ".join(f"max_by({m}, (written_at, {m})) FILTER ({m} IS NOT NULL) AS {m}" for m in METRICS) + " FROM train_metrics GROUP BY run_name, step"


def steps(spark: SparkSession, d: str) -> DataFrame:
    return M.upsert(table(spark, d, "train_metrics"), ["run_name", "step"], "written_at", METRICS)


@query("metrics_upsert", _STEPS)
def metrics_upsert(spark, d):
    return steps(spark, d)


@query("metrics_long", f"SELECT metric, count(*) AS n, avg(value) AS mean FROM (UNPIVOT ({_STEPS}) ON {', '.join(METRICS)} INTO NAME metric VALUE value) GROUP BY metric")
def metrics_long(spark, d):
    long = steps(spark, d).unpivot(["run_name", "step"], list(METRICS), "metric", "value").filter("value is not null")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("best_so_far", f"SELECT run_name, step, min(val_loss) OVER (PARTITION BY run_name ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM ({_STEPS}) WHERE val_loss IS NOT NULL")
def best_so_far(spark, d):
    return M.running(steps(spark, d).filter("val_loss is not null").select("run_name", "step", "val_loss"), "run_name", "step", "val_loss", "min", "best").select("run_name", "step", "best")


@query("tokens_seen", f"SELECT run_name, step, row_number() OVER (PARTITION BY run_name ORDER BY step) * 524288 AS tokens_seen FROM ({_STEPS})")
def tokens_seen(spark, d):
    one = steps(spark, d).select("run_name", "step", F.lit(524_288).cast("long").alias("t"))
    return M.running(one, "run_name", "step", "t", "sum", "tokens_seen").select("run_name", "step", "tokens_seen")


@query("last_values", "SELECT run_name, " + ", ".join(f"max_by({m}, step) FILTER ({m} IS NOT NULL) AS {m}" for m in METRICS) + f" FROM ({_STEPS}) GROUP BY run_name")
def last_values(spark, d):
    at = [F.max(F.when(F.col(m).isNotNull(), F.struct("step", m)))[m].alias(m) for m in METRICS]
    return steps(spark, d).groupBy("run_name").agg(*at)


_RUN = f"SELECT run_name, max(step) AS last_step, min(val_loss) AS best_val, min_by(step, (val_loss, step)) FILTER (val_loss IS NOT NULL) AS best_step, count(*) AS n_steps FROM ({_STEPS}) GROUP BY run_name"


def summary(spark, d):
    return M.summarise(steps(spark, d))


@query("run_summary", _RUN)
def run_summary(spark, d):
    return summary(spark, d)


@query("topk_runs", f"SELECT run_name, best_val FROM ({_RUN}) WHERE best_val IS NOT NULL ORDER BY best_val, run_name LIMIT 5")
def topk_runs(spark, d):
    return summary(spark, d).filter("best_val is not null").orderBy("best_val", "run_name").limit(5).select("run_name", "best_val")


@query("keep_newest", "SELECT run_name, step FROM (SELECT run_name, step, row_number() OVER (PARTITION BY run_name ORDER BY w DESC, step DESC) AS k FROM (SELECT run_name, step, max(written_at) AS w FROM train_metrics GROUP BY run_name, step)) WHERE k <= 3")
def keep_newest(spark, d):
    """Retention: the three newest steps of a run."""
    w = Window.partitionBy("run_name").orderBy(F.desc("w"), F.desc("step"))
    newest = table(spark, d, "train_metrics").groupBy("run_name", "step").agg(F.max("written_at").alias("w"))
    return newest.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("run_name", "step")


@query("keep_best", f"SELECT run_name, step, val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY val_loss, step) AS k FROM ({_STEPS}) WHERE val_loss IS NOT NULL) WHERE k <= 3")
def keep_best(spark, d):
    """The three best steps of a run; of ties the earlier, as a later one must be strictly better."""
    w = Window.partitionBy("run_name").orderBy("val_loss", "step")
    return steps(spark, d).filter("val_loss is not null").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("run_name", "step", "val_loss")


_CONFIG = f"SELECT regexp_replace(run_name, '_s\\d+$', '') AS config, run_name, best_val FROM ({_RUN})"


@query("seed_aggregate", f"SELECT config, count(*) AS n_runs, avg(best_val) AS mean_loss, coalesce(stddev_samp(best_val), 0.0) AS std_loss, avg(exp(best_val)) AS mean_ppl FROM ({_CONFIG}) WHERE best_val IS NOT NULL GROUP BY config")
def seed_aggregate(spark, d):
    s = summary(spark, d).filter("best_val is not null").withColumn("config", T.strip_seed("run_name"))
    return s.groupBy("config").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("best_val").alias("mean_loss"), F.coalesce(F.stddev_samp("best_val"), F.lit(0.0)).alias("std_loss"), F.avg(F.exp("best_val")).alias("mean_ppl"))


_TIMED = f"SELECT regexp_replace(r.run_name, '_s\\d+$', '') AS config, r.run_name, best_val, secs, n_params FROM ({_RUN}) r JOIN (SELECT run_name, epoch(max(logged_at)) - epoch(min(logged_at)) AS secs FROM train_metrics GROUP BY run_name) t USING (run_name) JOIN (SELECT run_name, (50257 * d_model + n_layers * (4 * d_model * d_model + CASE activation WHEN 'swiglu' THEN 3 ELSE 2 END * d_model * d_ff + 2 * d_model) + d_model)::BIGINT AS n_params FROM ({{shaped}})) p USING (run_name) WHERE best_val IS NOT NULL"


def seed_table(spark, d):
    """Configs over their seeds: parameters of the first run, mean and spread of
    loss and perplexity, mean time from the first to the last row."""
    exact = F.unix_micros(F.max("logged_at").cast("timestamp")) - F.unix_micros(F.min("logged_at").cast("timestamp"))
    secs = table(spark, d, "train_metrics").groupBy("run_name").agg((exact / 1e6).alias("secs"))
    runs = summary(spark, d).filter("best_val is not null").join(secs, "run_name").join(parameter_count(spark, d).select("run_name", "n_params"), "run_name").withColumn("config", T.strip_seed("run_name"))
    return runs.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.min(F.struct("run_name", "n_params"))["n_params"].alias("n_params"), F.avg("best_val").alias("mean_loss"), F.stddev_samp("best_val").alias("std_loss"),
        F.avg(F.exp("best_val")).alias("mean_ppl"), F.stddev_samp(F.exp("best_val")).alias("std_ppl"), F.avg("secs").alias("mean_runtime"),
    )


@query("seed_stability", f"SELECT config, avg(best_val) AS mean, stddev_pop(best_val) AS std, max(best_val) - min(best_val) AS spread, min_by(run_name, (best_val, run_name)) AS best_run, CASE WHEN stddev_pop(best_val) < 0.005 THEN 'stable' WHEN stddev_pop(best_val) < 0.02 THEN 'fair' ELSE 'unstable' END AS verdict FROM ({_CONFIG}) WHERE best_val IS NOT NULL GROUP BY config")
def seed_stability(spark, d):
    s = summary(spark, d).filter("best_val is not null").withColumn("config", T.strip_seed("run_name"))
    std = F.stddev_pop("best_val")
    return s.groupBy("config").agg(F.avg("best_val").alias("mean"), std.alias("std"), (F.max("best_val") - F.min("best_val")).alias("spread"), F.min(F.struct("best_val", "run_name"))["run_name"].alias("best_run"), F.when(std < 0.005, "stable").when(std < 0.02, "fair").otherwise("unstable").alias("verdict"))


@query("phase_counts", "SELECT split_part(run_name, '_', 1) AS phase, count(DISTINCT run_name) AS n_runs, count(*) AS n_rows FROM train_metrics GROUP BY 1")
def phase_counts(spark, d):
    by = table(spark, d, "train_metrics").groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(F.split("run_name", "_")[0].alias("phase")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_rows"))


@query("capped_perplexity", f"SELECT run_name, step, exp(least(val_loss, 20)) AS ppl, CASE WHEN val_loss >= 20 THEN 'inf'::DOUBLE ELSE exp(val_loss) END AS open_ppl FROM ({_STEPS}) WHERE val_loss IS NOT NULL")
def capped_perplexity(spark, d):
    v = F.col("val_loss")
    return steps(spark, d).filter("val_loss is not null").select("run_name", "step", F.exp(F.least(v, F.lit(20.0))).alias("ppl"), F.when(v >= 20, F.lit(float("inf"))).otherwise(F.exp(v)).alias("open_ppl"))


@query("accumulation_windows", f"SELECT run_name, (k - 1) // 8 AS window_id, count(*) AS n, avg(train_loss) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY step) AS k FROM ({_STEPS})) GROUP BY 1, 2")
def accumulation_windows(spark, d):
    """Means over eight steps. Steps are numbered as a running sum in blocks, so a long run is many tasks."""
    one = steps(spark, d).select("run_name", "step", "train_loss", F.lit(1).cast("long").alias("one"))
    numbered = M.running(one, "run_name", "step", "one", "sum", "k")
    return numbered.groupBy("run_name", F.floor((F.col("k") - 1) / 8).alias("window_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("train_loss").alias("loss"))


@query("tail_values", f"SELECT run_name, step, train_loss FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY step DESC) AS k FROM ({_STEPS})) WHERE k <= 10")
def tail_values(spark, d):
    k = F.row_number().over(Window.partitionBy("run_name").orderBy(F.desc("step")))
    return steps(spark, d).withColumn("k", k).filter("k <= 10").select("run_name", "step", "train_loss")


_FACTOR = "CASE WHEN s < 100 THEN s / 100.0 %s ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (s - %s) / %s))) END"


@query("lr_cosine", f"SELECT s AS step, 3e-4 * {_FACTOR % ('', 100, 900.0)} AS lr FROM range(0, 1200) t(s)")
def lr_cosine(spark, d):
    return spark.range(1200).select(F.col("id").alias("step"), M.cosine(F.col("id"), 3e-4, 0.1, 100, 1000).alias("lr"))


@query("lr_wsd", f"SELECT s AS step, 3e-4 * {_FACTOR % ('WHEN s < 800 THEN 1.0', 800, 200.0)} AS lr FROM range(0, 1200) t(s)")
def lr_wsd(spark, d):
    return spark.range(1200).select(F.col("id").alias("step"), M.warm_stable_decay(F.col("id"), 3e-4, 0.1, 100, 1000, 0.2).alias("lr"))


_SHAPED = "SELECT run_name, CASE WHEN contains(run_name, 'swiglu') THEN 'swiglu' ELSE 'gelu' END AS activation, 128 + 64 * (length(run_name) % 7) AS d_model, 4 + length(run_name) % 5 AS n_layers, 8 * (128 + 64 * (length(run_name) % 7)) // 3 AS d_ff FROM (SELECT DISTINCT run_name FROM train_metrics)"


@query("parameter_count", f"SELECT run_name, activation, d_model, n_layers, d_ff, (50257 * d_model + n_layers * (4 * d_model * d_model + CASE activation WHEN 'swiglu' THEN 3 ELSE 2 END * d_model * d_ff + 2 * d_model) + d_model)::BIGINT AS n_params FROM ({_SHAPED})")
def parameter_count(spark, d):
    """The closed form over the runs, with shapes that stand for their configs."""
    size = F.length("run_name")
    h = F.lit(128) + 64 * (size % 7)
    runs = table(spark, d, "train_metrics").select("run_name").distinct()
    shapes = runs.select("run_name", F.when(F.contains("run_name", F.lit("swiglu")), "swiglu").otherwise("gelu").alias("activation"), h.cast("long").alias("d_model"), (4 + size % 5).cast("long").alias("n_layers"), F.floor(8 * h / 3).alias("d_ff"))
    return M.parameter_count(shapes)


@query("experiment_grid", f"SELECT 'sft' || p || '_b' || b || '_e' || e AS name, run_name AS checkpoint, b AS beta, e AS epochs FROM (SELECT run_name, row_number() OVER (ORDER BY best_val, run_name) AS p FROM ({_RUN}) WHERE best_val IS NOT NULL QUALIFY p <= 2), (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS b), (SELECT unnest([1, 3]) AS e)")
def experiment_grid(spark, d):
    """The settings of a sweep over the two best runs."""
    best = topk_runs(spark, d)
    first = best.withColumn("place", F.row_number().over(Window.orderBy("best_val", "run_name"))).filter("place <= 2")  # five rows
    return M.sweep(first.select("place", F.col("run_name").alias("checkpoint")), (0.1, 0.3, 0.5), (1, 3))


@query("trial_table", f"SELECT run_name, best_val, exp(best_val) AS val_ppl, n_steps, 100.0 * (max(best_val) OVER () - best_val) / max(best_val) OVER () AS gain_pct FROM ({_RUN}) WHERE best_val IS NOT NULL")
def trial_table(spark, d):
    """Runs with a value, their perplexity, and how far they are below the worst."""
    done = summary(spark, d).filter("best_val is not null").select("run_name", "best_val", F.exp("best_val").alias("val_ppl"), "n_steps")
    return M.improvement(done)


@query("throughput", f"SELECT run_name, avg(tokens_per_sec) AS mean_rate, sum(524288) / sum(524288 / tokens_per_sec) AS overall_rate, rank() OVER (ORDER BY avg(tokens_per_sec) DESC, run_name) = 1 AS fastest FROM ({_STEPS}) WHERE tokens_per_sec > 0 GROUP BY run_name")
def throughput(spark, d):
    """Tokens a second of each run, over steps and over time, and which is fastest."""
    rate = F.col("tokens_per_sec")
    by = steps(spark, d).filter(rate > 0).groupBy("run_name").agg(F.avg(rate).alias("mean_rate"), (F.sum(F.lit(524_288)) / F.sum(F.lit(524_288) / rate)).alias("overall_rate"))
    top = by.agg(F.min(F.struct(-F.col("mean_rate"), "run_name"))["run_name"].alias("_top"))
    return by.crossJoin(F.broadcast(top)).select("run_name", "mean_rate", "overall_rate", (F.col("run_name") == F.col("_top")).alias("fastest"))  # one row


query("seed_table", f"SELECT config, count(*) AS n_seeds, min_by(n_params, run_name) AS n_params, avg(best_val) AS mean_loss, stddev_samp(best_val) AS std_loss, avg(exp(best_val)) AS mean_ppl, stddev_samp(exp(best_val)) AS std_ppl, avg(secs) AS mean_runtime FROM ({_TIMED.format(shaped=_SHAPED)}) GROUP BY config")(seed_table)


@query("best_per_phase", f"SELECT phase, coalesce(min_by(run_name, (best_val, run_name)) FILTER (best_val IS NOT NULL), max_by(run_name, (rate, run_name)) FILTER (rate IS NOT NULL)) AS run_name, count(best_val) > 0 AS by_loss FROM (SELECT split_part(run_name, '_', 1) AS phase, run_name, CASE WHEN contains(run_name, 'base') THEN NULL ELSE best_val END AS best_val, rate FROM ({_RUN}) JOIN (SELECT run_name, avg(tokens_per_sec) AS rate FROM ({_STEPS}) GROUP BY run_name) USING (run_name)) GROUP BY phase")
def best_per_phase(spark, d):
    """The run of least loss of each phase; by rate where no run has a loss, as
    is so here for the base runs."""
    rate = steps(spark, d).groupBy("run_name").agg(F.avg("tokens_per_sec").alias("rate"))
    known = summary(spark, d).join(rate, "run_name").select(F.split("run_name", "_")[0].alias("phase"), "run_name", F.when(~F.contains("run_name", F.lit("base")), F.col("best_val")).alias("best_val"), "rate")
    return M.best_per_group(known, "phase", "run_name", "best_val", "rate")


@query("run_slug", "SELECT DISTINCT run_name, trim(regexp_replace(lower(run_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(run_name, '_s\\d+$', '') AS config FROM train_metrics")
def run_slug(spark, d):
    return table(spark, d, "train_metrics").select("run_name").distinct().select("run_name", T.slug("run_name").alias("slug"), T.strip_seed("run_name").alias("config"))


@query("unique_labels", "SELECT run_name, phase || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS unique_label FROM (SELECT run_name, phase, row_number() OVER (PARTITION BY phase ORDER BY run_name) AS k FROM (SELECT DISTINCT run_name, split_part(run_name, '_', 1) AS phase FROM train_metrics))")
def unique_labels(spark, d):
    from ..functions.prompts import unique_labels as numbered

    runs = table(spark, d, "train_metrics").select("run_name").distinct().withColumn("phase", F.split("run_name", "_")[0])
    return numbered(runs, "phase", "run_name").select("run_name", "unique_label")
