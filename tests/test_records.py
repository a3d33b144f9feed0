import random
import statistics

import pytest
from pyspark.sql import functions as F

from loamwork.functions import sampling
from loamwork.operators import generation as gen
from loamwork.sources import files, tables


def test_yaml_round_trip_and_foreign_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    rows = [(i, f"text {i}: \"q\" - #x\n  é", ["a", "b"] if i % 2 else []) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, content string, tags array<string>").repartition(3)
    files.write_yaml(df, f"{tmp_path}/own")
    back = files.read_yaml(spark, f"{tmp_path}/own", "id int, content string, tags array<string>")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.yaml").write_text(yaml.safe_dump([{"content": "x\ny", "metadata": {"k": 1}}, "odd", {"id": 3}]), "utf-8")
    (tmp_path / "other" / "b.yaml").write_text("no: list", "utf-8")
    got = files.with_hash(files.read_yaml(spark, f"{tmp_path}/other", "id int, content string, metadata map<string,string>")).collect()
    assert [(r.id, r.content, r.metadata) for r in got] == [(None, "x\ny", {"k": "1"}), (3, None, None)] and len({r.hash for r in got}) == 2


def test_split_writes_its_counts(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").otherwise("eval").alias("part"))
    assert files.write_split(df, f"{tmp_path}/s") == {"train": 7, "eval": 3}
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/s/_stats/metadata.json").select("train", "eval").collect()] == [(7, 3)]


def test_config_hash_and_json_safe():
    a = tables.config_hash(total=3, kinds={"b": 1, "a": 2})
    assert a == tables.config_hash(kinds={"a": 2.0, "b": 1.0}, total=3) != tables.config_hash(total=4, kinds={"b": 1, "a": 2}) and len(a) == 16
    assert tables.json_safe({"a": (1, object()), 2: {(1, 2): 3, "k": None}}) == {"a": [1, None], 2: {"k": None}}


def test_logs_and_upserts(spark):
    lines = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}'), (3, '{"a"'), (4, '{"a":4}')], "id int, line string")
    assert [r.a for r in tables.read_log(lines, "a:int").orderBy("id").collect()] == [1, 2]
    assert tables.usable(lines, "h", "h").count() == 4 and tables.usable(lines, "h", "g").count() == 0
    new = spark.createDataFrame([(2, "x"), (9, "y")], "id int, line string")
    assert {r.id: r.line for r in tables.upsert(lines, new).collect()} == {1: '{"a":1}', 2: "x", 3: '{"a"', 4: '{"a":4}', 9: "y"}


def test_records_have_defaults(spark):
    df = spark.createDataFrame([('{"id":"t","messages":[{"role":"user"},{"role":"assistant","content":"c","tool_calls":[{"id":"1"}]}]}',), ("{bad",)], "line string")
    one, bad = df.select(tables.from_record(F.col("line")).alias("r")).collect()
    assert [m.asDict(True) for m in one.r.messages] == [
        {"role": "user", "content": "", "tool_calls": None, "tool_call_id": None, "name": None},
        {"role": "assistant", "content": "c", "tool_calls": [{"name": "", "arguments": "{}", "id": "1"}], "tool_call_id": None, "name": None},
    ]
    assert (one.r.scores, one.r.metadata, one.r.errors) == ({}, {}, None) and bad.r.id is None and bad.r.messages == []


def test_numbers_and_quantiles_without_one_task(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.5, 7.0, rng.random()]) for _ in range(301)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v double").repartition(5)
    got = {r.id: r.n for r in sampling.numbered(df.where("v IS NOT NULL"), F.desc("v"), "id").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])), 1)}
    (row,) = sampling.exclusive_quantiles(df, "v", [0.25, 0.5, 0.75]).collect()
    assert list(row) == pytest.approx(statistics.quantiles(values, n=4))
    totals = {r.v: r.upto for r in sampling.running_totals(df, "v").collect()}
    assert totals == {v: sum(x <= v for x in values) for v in values}
    assert [tuple(r) for r in sampling.exclusive_quantiles(df.limit(0), "v", [0.5]).collect()] == [(None,)]
    assert [tuple(r) for r in sampling.exclusive_quantiles(df.where("id = 3"), "v", [0.5]).collect()] == [(values[3],)]


def test_plan_batch_redistributes_what_is_full():
    assert gen.plan_batch({"lookup": 5, "multi_hop": 20}, {"lookup": 4}, {"lookup": 0.5, "multi_hop": 0.5}, 10) == {"lookup": 1, "multi_hop": 9}
    assert gen.plan_batch({"a": 3, "b": 3}, {"a": 3, "b": 3}, {}, 10) == {"a": 0, "b": 0}
    assert sum(gen.plan_batch({"a": 2, "b": 2}, {}, {"a": 1.0, "zz": 5.0}, 10).values()) == 2


def test_next_tasks(spark):
    seeds = spark.range(3).select("id")
    rows = gen.next_tasks(spark, seeds, counts={"lookup": 4, "multi_hop": 5}, modes={"x": 3, "y": 2}, hops={"2": 4, "3": 1}, iteration=1).collect()
    assert len({r.task_id for r in rows}) == 9 and {r.seed_id for r in rows} == {"0", "1", "2"}
    multi = [r for r in rows if r.qa_type == "multi_hop"]
    assert sorted(r["mode"] for r in multi) == ["x", "x", "x", "y", "y"] and sorted(r.hops for r in multi) == [2, 2, 2, 2, 3]
    assert {r.seed_id for r in gen.next_tasks(spark, seeds.limit(0), counts={"lookup": 2}, modes={}, hops={}, iteration=1).collect()} == {"fallback_0", "fallback_1"}


def test_templates(spark):
    row = spark.createDataFrame([("v", None, "")], "a string, b string, c string")
    fill = lambda t: row.select(gen.template(t, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}).alias("t")).first().t
    assert fill("{a}-{b}-{{a}} [[if a]]A[[if b]]B[[endif]]{a}[[endif]][[ if c ]]C{c}[[endif]][[if zz]]Z[[endif]]$1") == "v--{a} Av$1"
    for bad in ("[[if a]]x", "x[[endif]]"):
        with pytest.raises(ValueError):
            fill(bad)
    with pytest.raises(KeyError):
        fill("{zz}")


def test_retries_drop_unknown_limits():
    seen = []

    def ask(prompt, **limits):
        seen.append(dict(limits))
        if "max_tokens" in limits and "max_completion_tokens" in limits:
            raise RuntimeError("Unsupported parameter: 'max_tokens' is not supported")
        if len(seen) < 3:
            raise TimeoutError("busy")
        return prompt

    assert gen.with_retries(ask, attempts=4, max_tokens=5, max_completion_tokens=5)("p") == "p"
    assert seen == [{"max_tokens": 5, "max_completion_tokens": 5}, {"max_completion_tokens": 5}, {"max_completion_tokens": 5}]
    with pytest.raises(TimeoutError):
        gen.with_retries(lambda p: (_ for _ in ()).throw(TimeoutError()), attempts=2)("p")


def test_config_and_registry():
    bounds = {"size": (1, 10), "share": (0.0, 1.0)}
    assert gen.load_config({"size": "99", "share": -1, "models": "a, b,", "name": "x"}, bounds) == {"size": 10, "share": 0.0, "models": ["a", "b"], "name": "x"}
    with pytest.raises(ValueError):
        gen.load_config({"old": 1}, bounds, ("old",))
    assert gen.registry({"p": ["b", "a"], "q": ["c"]}) == ["a", "b", "c"] and gen.registry({"p": ["a"]}, ["z", "a"]) == ["a"]
    with pytest.raises(ValueError):
        gen.registry({"p": ["a"]}, ["z"])


def test_refinement_ends(spark):
    items = spark.range(4).select("id", F.lit(0).alias("tries"))
    judge = lambda df: df.withColumn("status", F.when(F.col("tries") >= F.col("id"), "passed").otherwise("needs_refinement")).withColumn("reason", F.lit("r"))
    again = lambda df: df.withColumn("tries", F.col("tries") + 1)
    got = {r.id: (r.status, r.reason, r.rounds) for r in gen.refine(items, judge, again, 2).collect()}
    assert got == {0: ("passed", "r", 0), 1: ("passed", "r", 1), 2: ("passed", "r", 2), 3: ("rejected", "refinement_budget_exhausted", 2)}
    assert gen.refine(items.limit(0), judge, again).count() == 0
