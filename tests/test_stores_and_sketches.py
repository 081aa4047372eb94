"""Stores that rewrite only what changed, sketches, split running sums, and the parts of a context."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklight.operators import analytics as A
from tracklight.operators import decisions as D
from tracklight.operators import listing as L
from tracklight.operators import text as T
from tracklight.operators import windows as W
from tracklight.plans import registry
from tracklight.sources import io


def files(path):
    return {p.parent.name: sorted(x.name for x in p.parent.glob("part-*")) for p in path.glob("*/part-*")}


def test_a_store_rewrites_only_what_changed(spark, tmp_path):
    path, schema = tmp_path / "store", "trajectory_id string, version int, domain_type string, text string"
    old = [(f"t{i}", 2, "abc"[i % 3], "old") for i in range(30)] + [("n", 1, None, "old")]
    io.write_trajectories(spark.createDataFrame(old, schema), str(path))
    before = files(path)
    # t0 gets newer, t3 stays, t1 moves from b to a, u is new
    new = [("t0", 3, "a", "new"), ("t3", 1, "a", "new"), ("t1", 3, "a", "new"), ("u", 1, "a", "new")]
    touched = io.upsert_store(spark, str(path), spark.createDataFrame(new, schema))
    assert sorted(touched) == ["a", "b"]
    after = files(path)
    assert all(after[d] == before[d] for d in ("domain_type=c", "domain_type=__HIVE_DEFAULT_PARTITION__")) and after["domain_type=a"] != before["domain_type=a"]
    want = {(i, v, d, x) for i, v, d, x in old if i not in ("t0", "t1")} | {("t0", 3, "a", "new"), ("t1", 3, "a", "new"), ("u", 1, "a", "new")}
    assert {tuple(r) for r in spark.read.parquet(str(path)).select("trajectory_id", "version", "domain_type", "text").collect()} == want
    # all of c and the one without a domain go: their folders too
    gone = spark.createDataFrame([(i,) for i, _, d, _ in old if d in ("c", None)], "trajectory_id string")
    assert set(io.delete_from_store(spark, str(path), gone, "trajectory_id")) == {"c", None}
    assert set(files(path)) == {"domain_type=a", "domain_type=b"} and files(path)["domain_type=a"] == after["domain_type=a"]
    assert io.delete_from_store(spark, str(path), gone, "trajectory_id") == []


def test_dependants_follow(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    parts = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "part string, owner bigint")
    left, few = L.delete_with_dependants(rows, rows.where("id < 3"), "id", [(parts, "owner")], spare=rows.where("id = 2"))
    assert sorted(r.id for r in left.collect()) == [2, 3] and sorted(r.part for r in few.collect()) == ["b", "c"]


def test_strict_updates_refuse_unknown_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "batch int, agent string, status string")
    new = spark.createDataFrame([(1, "a", "y"), (2, "a", "y")], "batch int, agent string, status string")
    assert sorted(r.status for r in L.bulk_update(rows, new, ["batch", "agent"], ["status"]).collect()) == ["x", "y"]
    with pytest.raises(LookupError, match=r"1 updates name no row, as \[\(2, 'a'\)\]"):
        L.bulk_update(rows, new, ["batch", "agent"], ["status"], strict=True)


def test_extractors_write_new_entities_once(spark, tmp_path):
    Q, path = registry.decision_queries, str(tmp_path / "store")
    calls = spark.createDataFrame([("t1", "run", "a"), ("t1", "run", "a"), ("t2", "run", "b")], "trajectory_id string, action string, agent_id string")
    both = {"tools": Q.tools_of, "agents": Q.agents_of}
    assert D.extract_into(spark, calls, both, path) == 4
    kept = sorted(p.name for p in (tmp_path / "store").glob("part-*"))
    assert D.extract_into(spark, calls, both, path) == 0
    assert sorted(p.name for p in (tmp_path / "store").glob("part-*")) == kept
    more = calls.unionByName(spark.createDataFrame([("t2", "stop", "b")], calls.schema))
    assert D.extract_into(spark, more, both, path) == 1
    got = sorted((r.trajectory_id, r.entity_id) for r in spark.read.parquet(path).collect())
    assert got == [("t1", "agent:a"), ("t1", "tool:run"), ("t2", "agent:b"), ("t2", "tool:run"), ("t2", "tool:stop")]


def test_sketches_keep_ranks_and_merge(spark):
    """Percentiles of sketches rolled up from stored ones: ranks within the sketch's error, for each attribute."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(100, 20_000), rng.normal(500, 10, 5_000), np.full(5_000, 7.0)])
    rows = [(("x", "y")[i % 2], i % 5, float(v), None if i % 3 else float(-v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "kind string, part int, ttft double, cost double").repartition(8)
    stored = A.sketches(df, ["ttft", "cost"], ["kind", "part"], 200)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    for by in (["kind"], []):
        for r in A.percentiles(A.roll_up(stored, by, 200), shares).collect():
            at = 2 if r.metric == "ttft" else 3
            own = np.sort([x[at] for x in rows if x[at] is not None and (not by or x[0] == r.kind)])
            assert r.n == len(own) and abs(r.mean - own.mean()) < 1e-6 * abs(own.mean()) and (r.least, r.most) == (own[0], own[-1])
            for name, p in shares.items():
                low, high = np.searchsorted(own, r[name], "left") / len(own), np.searchsorted(own, r[name], "right") / len(own)
                assert low - 0.03 <= p <= high + 0.03
    assert {r.metric for r in A.latency(df, {"ttft": (0, 100, 4), "cost": (-50, 0, 2)}, ["kind"]).collect()} == {"ttft", "cost"}


def test_concurrency_over_many_ranges(spark, monkeypatch):
    """One group over many ranges gives what one window gives."""
    rng = random.Random(3)
    calls = [("hot" if rng.random() < 0.8 else None if rng.random() < 0.3 else "b", s, s + rng.randint(0, 40)) for s in (rng.randint(0, 300) for _ in range(1500))]
    df = spark.createDataFrame(calls, "g string, s bigint, e bigint")
    want = []
    for g in {c[0] for c in calls}:
        steps = [x for c in calls if c[0] == g for x in ((c[1], 1), (c[2], -1))]
        want += [(g, at, d, sum(y for x, y in steps if (x, y) <= (at, d))) for at, d in steps]
    for per in (1_000_000, 30):
        monkeypatch.setattr(L, "RANGE_ROWS", per)
        got = [tuple(r) for r in W.concurrency(df, "s", "e", "g").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def tokens(text):
    return (len((text or "").encode()) + 3) // 4


def parts_of(text):
    base, core, rest = (text.find(m) for m in T.PARTS)
    return (text[base:core].strip() if base >= 0 and core >= 0 else "", text[core:rest].strip() if core >= 0 and rest >= 0 else "", text[rest:].strip() if rest >= 0 else "")


def test_context_parts_equal_a_plain_loop(spark):
    a, b, c = T.PARTS
    systems = [f"x {a} do\n {b} é blocks \n{c} 5 rows ", f"{a} only", f"{b} core {c}", f"{c} back {b} to {a} front", f"{a}{b}", "plain", "", None, f"{a} q {c}"]
    rows, want = [], {}
    for i, s in enumerate(systems):
        for second in (T.SUMMARY + "talk", "hello", None):
            key = f"{i}-{second}"
            said = [("system", s), *([("user", second)] if second else []), ("assistant", "ok é"), ("user", T.SUMMARY)]
            rows += [(key, n, role, text) for n, (role, text) in enumerate(said)]
            system, core, external = parts_of(s or "")
            summary = second if second and second.startswith(T.SUMMARY) else None
            rest = said[2:] if summary else said[1:]
            want[key] = (tokens(system or "own"), tokens(core), tokens(external), tokens(summary), sum(tokens(x) for _, x in rest), 2 * tokens('{"a": 1}') if i % 2 else 0)
    rows += [("bare", 0, "user", "no system"), ("bare", 1, "user", T.SUMMARY)]
    want["bare"] = (tokens("own"), 0, 0, tokens(T.SUMMARY), 0, 0)
    messages = spark.createDataFrame(rows, "trajectory_id string, sequence_id int, role string, text string")
    agents = messages.select("trajectory_id", F.lit("own").alias("system")).distinct()
    tools = spark.createDataFrame([(k, '{"a": 1}') for k in want if k != "bare" and int(k[0]) % 2 for _ in range(2)], "trajectory_id string, schema string")
    for r in T.context_breakdown(messages, agents, tools).collect():
        got = (r.system, r.core, r.external, r.summary, r.messages, r.functions)
        assert got == want[r.trajectory_id] and r.total == sum(got)
