import json

import numpy as np
import pytest

from corpusforge.sources import files


def test_read_any(spark, tmp_path):
    rows = [{"prompt": "p", "response": "r"}, {"instruction": "i", "prompt": "x"}]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    (tmp_path / "b.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "c.csv").write_text('instruction,output\n"a, b","say ""x"""\n')
    for name in ("a.jsonl", "b.json"):
        got = sorted(tuple(r) for r in files.normalise_records(files.read_any(spark, str(tmp_path / name))).select("instruction", "input", "output").collect())
        assert got == [("i", "", ""), ("p", "", "r")]
    assert files.read_any(spark, str(tmp_path / "c.csv")).first().output == 'say "x"'
    with pytest.raises(ValueError, match="no reader"):
        files.read_any(spark, "x.xml")


def test_cache_follows_parameters(spark, tmp_path):
    path, said, built = str(tmp_path / "c"), [], []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert files.cached(spark, path, {"n": 3}, lambda: build(3), say=said.append).count() == 3
    assert files.cached(spark, path, {"n": 3}, lambda: build(9), say=said.append).count() == 3
    assert files.cached(spark, path, {"n": 4}, lambda: build(4), say=said.append).count() == 4
    assert built == [3, 4] and said == [f"{path}: n was 3, is 4"]


@pytest.mark.parametrize("lists", [[], [[]], [[1, 2], [65535], [], [7] * 5]])
def test_token_files(spark, tmp_path, lists):
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    n = files.write_tokens(df, str(tmp_path / "t"))
    flat = [i for x in lists for i in x]
    assert n == len(flat)
    files.join_parts(spark, str(tmp_path / "t"), str(tmp_path / "one.bin"))
    assert np.fromfile(tmp_path / "one.bin", "<u2").tolist() == (flat or [0])
    back = files.read_tokens(spark, str(tmp_path / "one.bin"), block=3).orderBy("block").collect()
    assert [i for r in back for i in r.ids] == (flat or [0])


def test_parts_come_in_order(spark, tmp_path):
    lists = [[k] * (k % 5) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(7)
    path = "file://" + str(tmp_path / "parts")
    flat = [i for x in lists for i in x]
    assert files.write_tokens(df, path) == files.write_tokens(df, path) == len(flat)
    rows = files.read_tokens(spark, path, block=50).orderBy("path", "block").collect()
    assert [i for r in rows for i in r.ids] == flat
    files.join_parts(spark, path, "file://" + str(tmp_path / "one.bin"))
    assert np.fromfile(tmp_path / "one.bin", "<u2").tolist() == flat
    with pytest.raises(FileNotFoundError):
        files.read_tokens(spark, str(tmp_path / "none"))


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "train"), (2, [3], "val"), (3, [4], "other"), (4, None, "train")], "doc_id long, ids array<int>, split string")
    assert files.write_splits(df, str(tmp_path / "s")) == {"train": 2, "val": 1, "test": 0}
    assert files.read_tokens(spark, str(tmp_path / "s" / "train")).first().ids == [1, 2]


def test_datasets_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 'x, "y"'), (2, None, None)], "doc_id long, source string, text string")
    files.save_dataset(df, str(tmp_path / "d"), ["source"])
    files.save_dataset(df, str(tmp_path / "d"), ["source"])
    assert sorted(map(str, (r.source for r in spark.read.parquet(str(tmp_path / "d")).collect()))) == ["None", "a"]
    path = files.snapshot(df, str(tmp_path / "snap"), "2024-01-02", csv=True)
    assert path.endswith("2024-01-02") and files.read_any(spark, path + "/rows.csv").filter("doc_id = 1").first().text == 'x, "y"'


def test_hash_cache(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("h", ["a", "b"])], "h string, eval_sets array<string>")

    import time

    path = str(tmp_path / "h")
    for now, force in ((None, False), (None, False), (None, True), (time.time() + 100, False)):
        assert files.cached_hashes(spark, path, build, 50, force, now).first().eval_sets == ["a", "b"]
    assert len(built) == 3


def test_results_and_logs(spark, tmp_path):
    from datetime import datetime

    path = files.write_result(spark, str(tmp_path / "r"), "a/checkpoints/x/best.pt", {"step": 12, "val_loss": 1.5}, datetime(2024, 5, 6, 7, 8, 9), benchmarks={"b": {"score": 0.5}})
    assert path.endswith("x_best_step000012_20240506_070809.json")
    assert files.read_results(spark, str(tmp_path / "r")).select("val_loss", "benchmarks.b.score").first() == (1.5, 0.5)
    df = spark.createDataFrame([("p", {"m": 1.0})], "prompt string, timings map<string,double>")
    for _ in range(2):
        files.append_log(df, str(tmp_path / "log.jsonl"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "log.jsonl")).count() == 2
    for bad in ("log.txt", "../log.jsonl"):
        with pytest.raises(ValueError):
            files.append_log(df, str(tmp_path / bad), str(tmp_path))
    with pytest.raises(ValueError):
        files.append_log(df, "/elsewhere/log.jsonl", str(tmp_path))


def test_pair_caches(spark, tmp_path):
    schema = "input_ids array<int>, prompt_len int, source string, truncated boolean"
    spark.createDataFrame([([1, 2, 3], 2, "s", True), ([], 0, " ", None)], schema).coalesce(1).write.parquet(str(tmp_path / "c1" / "train"))
    spark.createDataFrame([([1], 5, None, False)], schema).coalesce(1).write.parquet(str(tmp_path / "c2" / "val"))
    rows = files.read_pair_caches(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.split, r.truncated, r.seq_len, r.prompt_len, r.response_len) for r in rows if r.seq_len) == [("c2", "val", False, 1, 5, 0), ("s", "train", True, 3, 2, 1)]
    assert len({r.record_id for r in rows}) == 3 and [(r.source, r.seq_len, r.response_len) for r in rows if not r.seq_len] == [("c1", None, None)]


def test_chat_records(spark):
    turns = [("user", "one"), ("assistant", "two"), ("human", " three "), ("gpt", "four"), ("system", "x"), ("user", "")]
    df = spark.createDataFrame([(1, None, [{"from": a, "value": b} for a, b in turns]), (2, "own", [{"from": "user", "value": "q"}]), (3, None, None)], "id long, prompt string, conversations array<struct<from:string,value:string>>")
    got = {r.id: (r.instruction, r.input, r.output) for r in files.normalise_records(df).collect()}
    assert got == {1: ("three", "User:\none\n\nAssistant:\ntwo", "four"), 2: ("own", "", ""), 3: ("", "", "")}


def test_token_overflow(spark, tmp_path):
    with pytest.raises(Exception, match="out of range"):
        files.write_tokens(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), str(tmp_path / "t"))


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, float("inf")), (3, float("nan"))], "step long, loss double")
    for run in ("a", "b"):
        files.write_metrics(df, str(tmp_path / run / "m.jsonl"))
    back = files.read_metrics(spark, [str(tmp_path / run / "m.jsonl") for run in ("a", "b")])
    assert back.filter("loss is null").count() == 4 and {r.run for r in back.select("run").distinct().collect()} == {"a", "b"}


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[data]\nmin_chars = 60\nunknown = 1\n[[data.sources]]\nname = "a"\nhf_dataset_id = "x"\nratio = 0.7\nodd = 2\n')
    c = files.read_config(str(path), ("data.min_chars=70",))
    assert c.min_chars == 70 and c.sources[0].ratio == 0.7 and c.extra["ratio_off"]
    with pytest.raises(ValueError):
        files.read_config(str(path), ("data.min_chars",))
    with pytest.raises(KeyError):
        files.read_config(str(path), ("nope.x=1",))


def test_other_configs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"posttraining": {"datasets": ["a", "b"], "epochs": 3, "odd": 1, "dataset_weights": {"a": 2.0}}}))
    c = files.read_post_training(str(tmp_path / "c.json"), ("posttraining.epochs=2",), spark=spark)
    assert c.datasets == ("a", "b") and c.epochs == 2 and c.dataset_weights == {"a": 2.0} and c.batch_size == 16
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("data:\n  min_chars: 61\n  sources:\n    - {name: a, hf_dataset_id: x, ratio: 1.0}\n")
    y = files.read_config(str(tmp_path / "c.yaml"), spark=spark)
    assert y.min_chars == 61 and not y.extra["ratio_off"]


def test_registry():
    r = files.Registry()
    r.register("a")(lambda: 1)
    assert r.load("a") == 1
    with pytest.raises(ValueError, match="registered: a"):
        r.load("b")
