"""Queries that write to the shared folder and read back: datasets, caches,
token files, logs, results, configs. What comes back is compared in SQL with
what went out."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decontam, packing, sampling
from ..session import checkpoint_dir
from ..sources import files
from ..sources.tables import table
from .documents import _IDS, hashed_ids, texts
from .instructions import _NORM, _TOK, tokenised
from .runs import METRICS, _STEPS, steps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each run of a query."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("save_per_source", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents")
def save_per_source(spark, d):
    path = _folder(spark, "dataset")
    files.save_dataset(table(spark, d, "documents").select("doc_id", "text", "source"), path, ["source"])
    return spark.read.schema("doc_id long, text string, source string").parquet(path).select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("snapshot_csv", "SELECT row_id::VARCHAR AS row_id, md5(coalesce(instruction,'')) AS instruction_md5 FROM sft_rows")
def snapshot_csv(spark, d):
    """A dated snapshot, read back from its CSV."""
    rows = table(spark, d, "sft_rows").select("row_id", "source", T.text_of("instruction").alias("instruction"))
    path = files.snapshot(rows, _folder(spark, "snapshots"), "2024-06-01", csv=True)
    return files.read_any(spark, f"{path}/rows.csv", "row_id string, source string, instruction string").select("row_id", F.md5(T.text_of("instruction")).alias("instruction_md5"))


@query("records_jsonl", "SELECT row_id, coalesce(instruction,'') AS instruction, coalesce(input,'') AS input, coalesce(output,'') AS output FROM sft_rows")
def records_jsonl(spark, d):
    """Pairs as chat records in lines of JSON, read back by their suffix and normalised."""
    path = _folder(spark, "records") + ".jsonl"
    rows = table(spark, d, "sft_rows").select("row_id", F.col("instruction").alias("prompt"), F.col("input").alias("context"), F.col("output").alias("completion"))
    rows.write.json(path)
    return files.normalise_records(files.read_any(spark, path, "row_id long, prompt string, context string, completion string")).select("row_id", "instruction", "input", "output")


@query("cache_by_parameters", "SELECT source, count(*) AS n, 2 AS built FROM documents WHERE source IS NOT NULL GROUP BY source")
def cache_by_parameters(spark, d):
    """A cache that is asked for three times, the last time under other parameters."""
    path, built = _folder(spark, "cache"), []

    def build() -> DataFrame:
        built.append(1)
        return table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))

    for version in (1, 1, 2):
        out = files.cached(spark, path, {"tables": d, "version": version}, build, say=lambda _: None)
    return out.withColumn("built", F.lit(len(built)))


@query("cached_eval_hashes", f"SELECT sha256(t) AS h, array_to_string(list_sort(list_distinct(list(eval_set))), ',') AS eval_sets FROM (SELECT {_NORM % 'text'} AS t, eval_set FROM eval_items WHERE text IS NOT NULL) WHERE t <> '' GROUP BY t")
def cached_eval_hashes(spark, d):
    """Hashes of evaluation texts by way of their cache, which keeps the sets' names."""
    path = _folder(spark, "hashes")
    for _ in range(2):
        out = files.cached_hashes(spark, path, lambda: decontam.eval_hashes(table(spark, d, "eval_items")))
    return out.select("h", F.array_join("eval_sets", ",").alias("eval_sets"))


_ALL_IDS = f"SELECT doc_id, list_append({_IDS}, 50256) AS ids FROM documents"


@query("token_files", f"SELECT count(*) AS n_ids, sum(id)::BIGINT AS total, sum(id * (pos % 1000003))::BIGINT AS ordered FROM (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM ({_ALL_IDS})))")
def token_files(spark, d):
    """The corpus as token files, and of what is read back a sum that depends on the order."""
    path = _folder(spark, "tokens")
    ids = texts(spark, d).select("doc_id", hashed_ids("text").alias("ids")).withColumn("ids", packing.with_eos("ids"))
    files.write_tokens(ids, path)
    blocks = files.read_tokens(spark, path, 1 << 16)
    sized = blocks.select(F.concat("path", F.format_string("#%09d", "block")).alias("place"), F.size("ids").cast("long").alias("n_tokens"))
    placed = packing.offsets(sized, "place").select("place", "token_offset")
    each = blocks.withColumn("place", F.concat("path", F.format_string("#%09d", "block"))).join(placed, "place").select("token_offset", F.posexplode("ids").alias("k", "id"))
    return each.agg(F.count(F.lit(1)).alias("n_ids"), F.sum(F.col("id").cast("long")).alias("total"), F.sum(F.col("id") * ((F.col("token_offset") + F.col("k")) % 1_000_003)).alias("ordered"))


@query("token_split_files", f"SELECT split, sum(len(ids))::BIGINT AS n_ids FROM (SELECT ids, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS split FROM ({_ALL_IDS})) GROUP BY split UNION ALL SELECT 'test', 0")
def token_split_files(spark, d):
    ids = texts(spark, d).select("doc_id", hashed_ids("text").alias("ids")).withColumn("ids", packing.with_eos("ids"))
    written = files.write_splits(sampling.split_corpus(ids), _folder(spark, "splits"))
    return spark.createDataFrame(sorted(written.items()), "split string, n_ids long")


@query("pair_cache_scan", f"SELECT source, count(*) AS n, sum(p + least(b, 64 - p - 1) + 1)::BIGINT AS tokens, sum(least(b, 64 - p - 1) + 1) FILTER (p > 0)::BIGINT AS response_tokens, count(*) FILTER (truncated) AS truncated FROM ({_TOK}) WHERE NOT dropped GROUP BY source")
def pair_cache_scan(spark, d):
    """Tokenised pairs, written as a cache and scanned as records."""
    root = _folder(spark, "pairs")
    rows = tokenised(spark, d).filter("not dropped").select("input_ids", "prompt_len", "source", "truncated")
    rows.write.parquet(f"{root}/mix/train")
    back = files.read_pair_caches(spark, root)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("seq_len").alias("tokens"), F.sum("response_len").alias("response_tokens"), F.count_if("truncated").alias("truncated"))


@query("metric_logs", f"SELECT run_name, step, {', '.join(METRICS)} FROM ({_STEPS})")
def metric_logs(spark, d):
    """Upserted steps, appended to a log in two goes and read back."""
    path = _folder(spark, "runs") + "/metrics.jsonl"
    rows = steps(spark, d)
    late = F.pmod(F.xxhash64("run_name", "step"), F.lit(2)) == 1
    for part in (rows.filter(~late), rows.filter(late)):
        files.write_metrics(part, path)
    return files.read_metrics(spark, [path], "run_name string, step long, " + ", ".join(f"{m} double" for m in METRICS)).select("run_name", "step", *METRICS)


@query("result_files", "SELECT 'x_best' AS model_name, 12 AS step, count(*) AS n_items FROM eval_items")
def result_files(spark, d):
    folder = _folder(spark, "results")
    n = table(spark, d, "eval_items").count()
    files.write_result(spark, folder, "a/checkpoints/x/best.pt", {"step": 12, "val_loss": 1.5}, datetime(2024, 6, 1), benchmarks={"all": {"n": n}})
    return files.read_results(spark, folder).select("model_name", F.col("step").cast("int").alias("step"), F.col("benchmarks.all.n").alias("n_items"))


@query("arena_log", "SELECT item_id, md5(coalesce(text,'')) AS prompt_md5, count(*) AS n FROM (SELECT * FROM eval_items UNION ALL SELECT * FROM eval_items) GROUP BY item_id, text")
def arena_log(spark, d):
    """Two appends of every item as a prompt."""
    base = _folder(spark, "arena")
    rows = table(spark, d, "eval_items").select("item_id", T.text_of("text").alias("prompt"))
    for _ in range(2):
        files.append_log(rows, f"{base}/log.jsonl", base)
    return files.read_any(spark, f"{base}/log.jsonl", "item_id long, prompt string").groupBy("item_id", F.md5("prompt").alias("prompt_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("config_scan", "SELECT name, hf_dataset_id, ratio FROM source_configs")
def config_scan(spark, d):
    """The configured sources, written as a config file and read back."""
    rows = table(spark, d, "source_configs").collect()  # a row a source
    sources = [{k: r[k] for k in ("name", "hf_dataset_id", "hf_subset", "hf_split", "text_column", "ratio")} | {"unknown": 1} for r in rows]
    path = _folder(spark, "config") + ".json"
    files._put(spark, path, json.dumps({"data": {"sources": sources, "min_chars": 60}}))
    config = files.read_config(path, ("data.min_chars=70",), spark)
    return spark.createDataFrame([(s.name, s.hf_dataset_id, s.ratio) for s in config.sources], "name string, hf_dataset_id string, ratio double")


@query("cache_keys", "SELECT DISTINCT source, 16 AS n_digits FROM sft_rows WHERE source IS NOT NULL")
def cache_keys(spark, d):
    """A key for each source alone; all differ."""
    names = sorted(r[0] for r in table(spark, d, "sft_rows").select("source").filter("source is not null").distinct().collect())  # a row a source
    keys = {n: sampling.cache_key({n: 1.0}, [n], 512, None, True) for n in names}
    if len(set(keys.values())) < len(keys):
        raise ValueError("two sources have one key")
    return spark.createDataFrame([(n, len(k)) for n, k in keys.items()], "source string, n_digits int")
