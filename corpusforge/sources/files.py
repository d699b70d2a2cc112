"""Files: records of any shape, metric logs, datasets, caches with parameters,
token files, evaluation results, configs.

Paths are of any file system Spark knows. The driver touches small files only
(manifests, results, configs), through Spark's own file systems; tasks read
and write token files through Arrow's.
"""

from __future__ import annotations

import json
import time
import tomllib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath
from typing import Any

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_name, strip

# -------------------------------------------------------------- file systems


def _located(spark: SparkSession, path: str):
    """(file system, path) of Spark's; a path without a scheme is of the default one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _located(spark, path)
    return system.exists(at)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, whole: under another name first."""
    system, at = _located(spark, path)
    held = at.suffix(".writing")
    out = system.create(held, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    system.delete(at, False)
    if not system.rename(held, at):
        raise OSError(f"could not write {path}")


def _get(spark: SparkSession, path: str) -> str:
    """A small text file."""
    rows = spark.read.text(path, wholetext=True).collect()  # one row
    return rows[0][0] if rows else ""


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder, in order of their names."""
    system, at = _located(spark, path)
    if not system.exists(at):
        raise FileNotFoundError(path)
    return sorted((f.getPath().toString(), f.getLen()) for f in system.listStatus(at) if f.isFile() and not f.getPath().getName().startswith((".", "_")))


def _task_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's (file system, path), for use inside tasks."""
    return arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


# ------------------------------------------------------------------ records

# The names under which the three fields arrive, first wins.
ALIASES = {
    "instruction": ("instruction", "prompt", "question", "query"),
    "input": ("input", "context", "passage", "document"),
    "output": ("output", "response", "answer", "completion"),
}


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a file or folder by its suffix: jsonl, json (a list, or an
    object with a list under ``data`` or ``rows``), csv with a header, parquet.
    ``schema`` is for lines and tables that may be empty."""
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".jsonl":
        return reader.json(path)
    if suffix == ".json":
        df = spark.read.option("multiLine", True).json(path)
        for name in ("data", "rows"):
            if name in df.columns and len(df.columns) == 1:
                return df.select(F.explode(name).alias("r")).select("r.*")
        return df
    if suffix == ".csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix in (".parquet", ".pq"):
        return reader.parquet(path)
    raise ValueError(f"no reader for {suffix or 'a file without suffix'}: {path}")


#: Names of the speakers and of their fields in chat records.
USERS, ASSISTANTS = ("user", "human", "prompter"), ("assistant", "gpt", "bot")
ROLES, CONTENTS = ("role", "from"), ("content", "value", "text")


def chat_fields(df: DataFrame) -> dict[str, Column]:
    """instruction, input and output of the chat of a row (``messages`` or
    ``conversations``): the last turn of each side, and the turns before as
    blocks, paired as far as both go; null where a side is silent or there is no chat."""
    for name in ("messages", "conversations"):
        kind = df.schema[name].dataType if name in df.columns else None
        if kind is not None and kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            break
    else:
        return {}
    known = kind.elementType.fieldNames()

    def first(x: Column, names: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(strip(x[n].cast("string")), F.lit("")) for n in names if n in known], F.lit(""))

    def said(roles: Sequence[str]) -> Column:
        turns = F.filter(F.coalesce(F.col(name), F.array()), lambda x: F.lower(first(x, ROLES)).isin(*roles))
        return F.filter(F.transform(turns, lambda x: first(x, CONTENTS)), lambda t: t != "")

    users, replies = said(USERS), said(ASSISTANTS)
    both = (F.size(users) > 0) & (F.size(replies) > 0)
    early = lambda xs: F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0)))
    n = F.least(F.size(users), F.size(replies)) - 1
    pairs = F.slice(F.arrays_zip(early(users).alias("u"), early(replies).alias("a")), F.lit(1), F.greatest(n, F.lit(0)))
    blocks = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("User:\n"), p["u"], F.lit("\n\nAssistant:\n"), p["a"])), "\n\n")
    return {"instruction": F.when(both, F.element_at(users, -1)), "input": F.when(both, blocks), "output": F.when(both, F.element_at(replies, -1))}


def normalise_records(df: DataFrame) -> DataFrame:
    """``df`` with instruction, input and output, each the first of its aliases
    that is there and not empty, else that of the row's chat; empty where none is."""
    chat = chat_fields(df)

    def first(field_name: str, names: Sequence[str]) -> Column:
        own = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*own, *([chat[field_name]] if chat else []), F.lit(""))

    return df.withColumns({k: first(k, v) for k, v in ALIASES.items()})


class Registry:
    """Loaders by name."""

    def __init__(self) -> None:
        self.loaders: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str) -> Callable:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.loaders[name] = f
            return f

        return add

    def load(self, name: str, *args: Any, **options: Any) -> DataFrame:
        if name not in self.loaders:
            raise ValueError(f"unknown dataset {name!r}; registered: {', '.join(sorted(self.loaders))}")
        return self.loaders[name](*args, **options)


def read_metrics(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Metric logs, csv or jsonl, with ``run`` from the folder's name; columns
    that a file lacks are null. ``schema`` is for logs that may be empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = None
    for path in paths:
        df = reader.option("header", True).option("inferSchema", schema is None).csv(path) if path.endswith(".csv") else reader.json(path)
        df = df.withColumn("run", F.lit(PurePosixPath(path).parent.name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no metric file")
    return out


def write_metrics(df: DataFrame, path: str, kind: str = "json") -> None:
    """Append a metric frame; numbers that are not finite become null in JSON."""
    if kind == "json":
        doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
        finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in doubles}
        df.withColumns(finite).write.mode("append").json(path)
    else:
        df.write.mode("append").option("header", True).csv(path)


# ------------------------------------------------------- datasets and caches


def save_dataset(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A dataset as parquet, in folders by the values of ``by``; what was there goes."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, root: str, date: str, csv: bool = False) -> str:
    """A dated copy under ``root``, and as CSV beside it on wish; its path."""
    path = f"{root}/{date}"
    df.write.mode("overwrite").parquet(f"{path}/rows.parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows.csv")
    return path


def cached(spark: SparkSession, path: str, params: dict[str, Any], build: Callable[[], DataFrame], force: bool = False, say: Callable[[str], None] = print) -> DataFrame:
    """The parquet at ``path`` if it was written under the same parameters,
    else built, written and read. A folder without a manifest is not trusted;
    every parameter upstream belongs into ``params``."""
    manifest = f"{path}.params.json"
    wanted = json.loads(json.dumps(params, sort_keys=True, default=str))
    if not force and _exists(spark, manifest) and _exists(spark, path):
        known = json.loads(_get(spark, manifest))
        if known == wanted:
            return spark.read.parquet(path)
        for key in sorted({*known, *wanted}):
            if known.get(key) != wanted.get(key):
                say(f"{path}: {key} was {known.get(key)!r}, is {wanted.get(key)!r}")
    # while it is written the folder is not to be trusted
    system, at = _located(spark, manifest)
    system.delete(at, False)
    build().write.mode("overwrite").parquet(path)
    _put(spark, manifest, json.dumps(wanted, sort_keys=True))
    return spark.read.parquet(path)


#: Fixed value: how long cached hashes of evaluation texts are used.
KEPT_SECONDS = 7 * 24 * 3600


def cached_hashes(spark: SparkSession, path: str, build: Callable[[], DataFrame], seconds: float = KEPT_SECONDS, force: bool = False, now: float | None = None) -> DataFrame:
    """Hashes with the names of their sets, from ``path`` if written less than
    ``seconds`` ago, else built and written."""
    marker = f"{path}/_SUCCESS"
    now = time.time() if now is None else now
    if not force and _exists(spark, marker):
        system, at = _located(spark, marker)
        if now - system.getFileStatus(at).getModificationTime() / 1000 < seconds:
            return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_pair_caches(spark: SparkSession, root: str) -> DataFrame:
    """Cached tokenised pairs, ``<root>/<cache>/<train or val>`` in parquet with
    input_ids, prompt_len, source and truncated, as records: (record_id, source,
    split, truncated, seq_len, prompt_len, response_len). A record without a
    source has its cache's name; lengths of 0 are null."""
    df = spark.read.option("recursiveFileLookup", True).parquet(root)
    path = F.col("_metadata.file_path")
    place = F.regexp_extract(path, "([^/]+)/(train|val)(?:\\.parquet)?(?:/[^/]+)?$", 1)
    split = F.regexp_extract(path, "([^/]+)/(train|val)(?:\\.parquet)?(?:/[^/]+)?$", 2)
    name = F.regexp_extract(path, "([^/]+)$", 1)
    rows = df.select("*", place.alias("_cache"), split.alias("split"), F.concat_ws(":", place, split, name, F.col("_metadata.row_index")).alias("record_id")).filter("split <> ''")
    n, p = F.nullif(F.size("input_ids"), F.lit(0)), F.nullif(F.col("prompt_len").cast("int"), F.lit(0))
    return rows.select("record_id", F.coalesce(F.nullif(strip("source"), F.lit("")), "_cache").alias("source"), "split", F.coalesce("truncated", F.lit(False)).alias("truncated"), n.alias("seq_len"), p.alias("prompt_len"), F.when(n.isNotNull() & p.isNotNull(), F.greatest(n - p, F.lit(0))).alias("response_len"))


# ------------------------------------------------------------------ results


def write_result(spark: SparkSession, folder: str, checkpoint: str, meta: dict[str, Any], when: datetime | None = None, **parts: Any) -> str:
    """One evaluation as a JSON file named by model, step and time; its path."""
    when = when or datetime.now(timezone.utc)
    name = spark.range(1).select(model_name(F.lit(checkpoint))).first()[0]
    step = int(meta.get("step") or 0)
    payload = {"model_name": name, "checkpoint": checkpoint, "timestamp": when.isoformat(), "step": step, "val_loss": meta.get("val_loss"), "tokens_seen": meta.get("tokens_seen") or 0, **parts}
    path = f"{folder}/{name}_step{step:06d}_{when:%Y%m%d_%H%M%S}.json"
    _put(spark, path, json.dumps(payload, indent=2))
    return path


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluations of a folder."""
    return spark.read.option("multiLine", True).json(folder)


def append_log(df: DataFrame, path: str, workspace: str) -> None:
    """Append rows, with the time, to a JSONL log inside ``workspace``: a folder
    of lines, as a file can't be appended to everywhere."""
    if PurePosixPath(path).suffix.lower() != ".jsonl":
        raise ValueError(f"a log ends with .jsonl: {path}")
    inside, own = PurePosixPath(workspace), PurePosixPath(path)
    if ".." in own.parts or not own.is_relative_to(inside):
        raise ValueError(f"the log must lie in {workspace}: {path}")
    df.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


# -------------------------------------------------------------- token files


def write_tokens(df: DataFrame, path: str, order: str = "doc_id", ids: str = "ids") -> int:
    """Little-endian 16-bit ids of all rows in order, as numbered part files in
    the shared folder ``path``; the number of ids. Ids above 65535 are an error.

    Rows are ranged by ``order`` and sorted inside each part; nothing comes
    through the driver but the counts. What was there goes. No rows give one part of one zero.
    """
    spark = df.sparkSession
    system, at = _located(spark, path)
    system.delete(at, True)
    system.mkdirs(at)
    folder = system.makeQualified(at).toString()
    parts = df.select(order, ids).repartitionByRange(order).sortWithinPartitions(order)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        k, n = TaskContext.get().partitionId(), 0
        target, base = _task_system(folder)
        # a task that runs again writes the same file anew
        held, final = f"{base}/.part-{k:05d}.{TaskContext.get().taskAttemptId()}", f"{base}/part-{k:05d}.bin"
        with target.open_output_stream(held) as out:
            for frame in frames:
                for one in frame[ids]:
                    x = np.asarray(one if one is not None else [], np.int64)
                    if len(x) and (x.max() > 65535 or x.min() < 0):
                        raise ValueError(f"token id out of range: {x.max()}")
                    out.write(x.astype("<u2").tobytes())
                    n += len(x)
        if n:
            target.move(held, final)
        else:
            target.delete_file(held)
        yield pd.DataFrame({"part": [k], "n": [n]})

    total = parts.mapInPandas(write, "part int, n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total == 0:
        out = system.create(at.suffix("/part-00000.bin"), True)
        out.write(bytearray(2))
        out.close()
    return total


def write_splits(df: DataFrame, path: str, split: str = "split", names: Sequence[str] = ("train", "val", "test"), order: str = "doc_id", ids: str = "ids") -> dict[str, int]:
    """Token files of each split in a folder of its name; ids written of each.
    Rows of other splits are left out."""
    return {name: write_tokens(df.filter(F.col(split) == name), f"{path}/{name}", order, ids) for name in names}


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """One file of the parts in order, where a reader wants a single one: a task
    streams piece by piece, so its memory is bounded and its time is that of the bytes."""
    system, at = _located(spark, target)
    whole = system.makeQualified(at).toString()
    parts = [name for name, _ in _listed(spark, path)]

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            files, base = _task_system(whole)
            with files.open_output_stream(base) as out:
                for name in frame["names"].iloc[0]:
                    source, place = _task_system(name)
                    with source.open_input_stream(place) as part:
                        while piece := part.read(1 << 22):
                            out.write(piece)
            yield pd.DataFrame({"ok": [True]})

    spark.createDataFrame([(parts,)], "names array<string>").mapInPandas(copy, "ok boolean").collect()  # one row


def read_tokens(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(path, block, ids) of token files, in blocks of bounded size: the files'
    names and sizes are listed on the driver, their bytes read by the tasks."""
    plan = [(name, k, k * block * 2) for name, size in _listed(spark, path) for k in range(max(1, -(-size // (block * 2))))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, k, start in zip(frame["path"], frame["block"], frame["at"]):
                system, place = _task_system(name)
                with system.open_input_file(place) as file:
                    file.seek(start)
                    ids = np.frombuffer(file.read(block * 2), "<u2").astype(np.int32)
                yield pd.DataFrame({"path": [name], "block": [k], "ids": [ids.tolist()]})

    return spark.createDataFrame(plan, "path string, block int, at long").mapInPandas(run, "path string, block int, ids array<int>")


# ------------------------------------------------------------------ configs


@dataclass(frozen=True)
class Source:
    name: str
    hf_dataset_id: str
    hf_subset: str | None = None
    hf_split: str = "train"
    text_column: str = "text"
    ratio: float = 0.0


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    total_tokens: int = 800_000_000
    min_chars: int = 50
    ngram: int = 13
    val_fraction: float = 0.05
    seed: int = 42
    extra: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class PostTraining:
    """Settings of instruction and preference training."""

    datasets: tuple[str, ...] = ()
    dataset_weights: dict[str, float] = field(default_factory=dict)
    max_samples: int | None = None
    max_seq_len: int = 512
    val_fraction: float = 0.05
    batch_size: int = 16
    grad_accum_steps: int = 1
    epochs: float = 1.0
    seed: int = 42
    beta: float = 0.1
    label_smoothing: float = 0.0
    reference_free: bool = False


def _parsed(spark: SparkSession | None, path: str) -> dict[str, Any]:
    text = _get(spark, path) if spark is not None else Path(path).read_text(encoding="utf-8")
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".toml":
        return tomllib.loads(text)
    if suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError("YAML configs need the package yaml") from missing
        return yaml.safe_load(text) or {}
    return json.loads(text)


def read_post_training(path: str, overrides: tuple[str, ...] = (), section: str = "posttraining", spark: SparkSession | None = None) -> PostTraining:
    """The settings of a section of a config; unknown keys are left out."""
    raw = _overridden(_parsed(spark, path), overrides)
    known = {f.name for f in fields(PostTraining)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.get(section, {}).items() if k in known}
    return replace(PostTraining(), **values)


def read_config(path: str, overrides: tuple[str, ...] = (), spark: SparkSession | None = None) -> Config:
    """A TOML, JSON or YAML config; unknown keys are left out. ``overrides`` are
    ``key.sub=value``, read as the type that stands there. With a session the
    path is of any file system, else of the machine's."""
    raw = _overridden(_parsed(spark, path), overrides)
    data = raw.get("data", raw)
    known = {f.name for f in fields(Source)}
    sources = tuple(Source(**{k: v for k, v in s.items() if k in known}) for s in data.get("sources", ()))
    total = sum(s.ratio for s in sources)
    plain = {f.name for f in fields(Config)} - {"sources", "extra"}
    config = replace(Config(), sources=sources, **{k: v for k, v in data.items() if k in plain})
    return replace(config, extra={"ratio_off": bool(sources) and abs(total - 1) > 0.01})


def _overridden(raw: dict[str, Any], overrides: tuple[str, ...]) -> dict[str, Any]:
    for text in overrides:
        key, sign, value = text.partition("=")
        if not sign:
            raise ValueError(f"no '=' in override {text!r}")
        *parents, last = key.strip().split(".")
        node = raw
        for p in parents:
            node = node[p]
        node[last] = _as(node.get(last), value.strip())
    return raw


def _as(old: Any, text: str) -> Any:
    if isinstance(old, bool):
        return text.lower() in ("true", "1", "yes")
    for kind in (int, float):
        if isinstance(old, kind):
            try:
                return kind(text)
            except ValueError:
                return text
    return text
