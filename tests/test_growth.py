"""What a job holds, shuffles or writes grows no faster than its input: findings of the third round, each with a small case."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracklight.operators import analytics as A
from tracklight.operators import capture as C
from tracklight.operators import listing as L
from tracklight.operators import search as S
from tracklight.plans import registry
from tracklight.streaming import jobs

from test_streams import files

SF = "/root/testdata/sf0.001"


def test_links_are_counted_before_they_are_joined(spark):
    """passages are counted by archive and size below the join with agents, so no link is written out."""
    lines = registry.QUERIES["j2_agent_passages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Relation" in line and "n_chars" in line)
    above, here = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            above.append(line.lstrip(" :+-").split()[0])
    assert "Aggregate" in above[: above.index("Join")]
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "z")], "agent string, archive string")
    rows = spark.createDataFrame([("x", "s", "p2"), ("x", "s", "p1"), ("x", "l", "p3"), ("y", "s", "p0"), (None, "s", "p9")], "archive string, size string, id string")
    agents = links.select("agent").distinct()
    got = L.linked_counts(agents, links, L.counts_by(rows, ["archive", "size"], "id"), "agent", "archive", ["size"])
    plain = L.linked(agents, links, rows, "agent", "archive").groupBy("agent", "size").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) == [("a", "l", 1, "p3"), ("a", "s", 3, "p0"), ("b", "l", 1, "p3"), ("b", "s", 2, "p1")]


def test_storage_texts_round_ties_as_the_sql_does(spark):
    """F2: 72 passages are 1.125 MB, told as 1.12, and 65,536 are a GB, in the operator and in the query's SQL."""
    sizes = {"a": 72, "b": 104, "c": 3, "d": 65_536, "e": 40, "f": 8}
    owners = spark.createDataFrame(list(sizes.items()), "source string, size int").select("source", F.explode(F.sequence(F.lit(1), "size")).alias("doc_id"))
    got = {r.source: r.pretty for r in A.storage_estimate(owners, "source").collect()}
    assert got == {"a": "1.12 MB", "b": "1.62 MB", "c": "48.00 KB", "d": "1.00 GB", "e": "640.00 KB", "f": "128.00 KB"}
    assert {r.source: r.pretty for r in A.storage_estimate(owners.where("source = 'c'"), "source", 5, 1).collect()} == {"c": "15 B"}
    con = duckdb.connect()
    con.execute("create table documents as select s as source, i as doc_id, 'en' as lang, 10 as n_chars, '' as text from (values ('a', 72), ('b', 104), ('c', 3), ('d', 65536), ('e', 40), ('f', 8)) v(s, n), lateral (select unnest(range(n)) as i) r")
    told = {r[0].removeprefix("archive-"): (r[1], r[2], r[3]) for r in con.execute("select archive_id, n, bytes, pretty from (" + registry.ORACLES["a21_storage"] + ")").fetchall()}
    assert told == {s: (n, n * 16384, got[s]) for s, n in sizes.items()}


def test_bm25_scores_every_row_that_shares_a_word(spark):
    """the query keeps every scored document, not the ten best; F11: rows come out as they are scored."""
    docs = spark.createDataFrame([(i, f"red {'blue ' * (i % 3)}w{i}") for i in range(40)] + [(40, None), (41, "none of it")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "blue w7"), (3, "absent"), (4, None)], "query_id bigint, query string")
    got = {(r.query_id, r.doc_id): r.score for r in S.bm25(docs, asked, None).collect()}
    best = {(r.query_id, r.doc_id): r.score for r in S.bm25(docs, asked, 1000).collect()}
    assert got == best and {d for q, d in got if q == 1} == set(range(40)) and {d for q, d in got if q == 2} == {i for i in range(40) if i % 3 or i == 7}
    found = registry.QUERIES["v14_bm25"](spark, SF)
    assert set(found.columns) == {"query_id", "doc_id", "score"} and max(r["count"] for r in found.groupBy("query_id").count().collect()) > 10


def test_a_matrix_of_similarities_is_bounded(monkeypatch):
    """however large an Arrow batch and the block of queries, a worker's matrix has at most CELLS cells."""
    rng = np.random.default_rng(3)
    vectors, q, seen = np.round(rng.normal(size=(3_000, 4)), 1), np.round(rng.normal(size=(50, 4)), 1), []
    plain = S.similarities
    monkeypatch.setattr(S, "similarities", lambda kind, a, b: seen.append(len(a) * len(b)) or plain(kind, a, b))
    monkeypatch.setattr(S, "CELLS", 5_000)
    names = [f"t{i}" for i in range(len(vectors))]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 1_700]), pa.array(vectors[lo : lo + 1_700].tolist())], names=["k", "v"]) for lo in (0, 1_700)]
    for floor in (None, 0.9):
        (out,) = S._best_of_task(iter(batches), list(range(50)), q, 5, "cosine", "trajectory_id", floor, 6)
        want = []
        for i, s in enumerate(np.round(plain("cosine", q, vectors), 6).T):
            want += [(i, names[j], s[j]) for j in sorted(range(len(s)), key=lambda j: (-s[j], names[j])) if floor is None or s[j] >= floor][:5]
        got = list(zip(*(c.to_pylist() for c in out.columns), strict=True))
        assert [(a, b, round(c, 6)) for a, b, c in got] == [(a, b, round(float(c), 6)) for a, b, c in [w for i in range(50) for w in [x for x in want if x[0] == i][:5]]]
    assert max(seen) <= 5_000


def test_a_provider_gets_few_rows_at_once(spark):
    """an Arrow batch of 10,000 rows is embedded in parts, each row once and in order; a failing part gives nulls."""

    def provider(texts):
        if len(texts) > S.PROVIDER_ROWS or (texts == "bad").any():
            raise ValueError
        return [[float(len(x))] for x in texts]

    rows = spark.range(0, 5_000, 1, 1).select("id", F.when(F.col("id") == 4_999, "bad").otherwise(F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("text"))
    got = [(r.id, r.embedding) for r in S.embed(rows, "text", provider).collect()]
    assert got == [(i, [float(i % 7)] if i < 4_000 else None) for i in range(5_000)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= S.BATCH_BYTES


def exchanges(df):
    """Exchanges of rows by a key in the plan before it runs (a plan that adapts is told as it stands)."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_steps_and_messages_are_dealt_once(spark, tmp_path):
    """one exchange deals steps and messages, one the runs; documents are stored compressed."""
    runs = spark.createDataFrame([(r, "a", "completed", None, None, None) for r in ("r1", "r2", "r3", None)], "run_id string, agent_id string, status string, stop_reason string, created_at timestamp, completed_at timestamp")
    steps = spark.createDataFrame([("r1", 2, "m", 1, None), ("r1", 1, "n", 2, 3), ("r1", 1, None, 5, 5), ("r1", None, "m", 7, 7), (None, 1, "m", 9, 9)], "run_id string, step_no int, model string, prompt_tokens bigint, completion_tokens bigint")
    messages = spark.createDataFrame(
        [("r1", 1, 2, "b", "user", "x", ["t"]), ("r1", 1, 1, "a", "tool", "y", None), ("r1", None, 3, "c", "user", "z", ["s", "t"]), ("r2", 1, 4, "d", "user", "w", []), ("r1", 9, 5, "e", "user", "v", None)],
        "run_id string, step_no int, seq bigint, message_id string, role string, text string, tools array<string>",
    )
    whole = C.build_trajectories(runs, steps, messages)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(C.build_trajectories(runs, steps, messages)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.run_id: r for r in whole.collect()}
    turns = [(t.step_no, t.model, t.input_tokens, t.output_tokens, [m.message_id for m in t.messages]) for t in got["r1"].turns]
    assert turns == [(None, "m", 7, 7, []), (1, None, 5, 5, ["a", "b"]), (1, "n", 2, 3, ["a", "b"]), (2, "m", 1, None, [])]
    m = got["r1"].metadata
    assert (m.step_count, m.message_count, m.tools_used, m.input_tokens, m.output_tokens, m.total_tokens, m.models) == (4, 4, ["s", "t"], 15, 15, 30, ["m", "n"])
    assert got["r2"].turns is None and (got["r2"].metadata.message_count, got["r2"].metadata.step_count, got["r2"].metadata.models) == (1, 0, [])
    assert got["r3"].turns is None and got[None].turns is None and got[None].metadata.step_count == 0
    read = registry.QUERIES["s1_read_store"](spark, SF)
    assert all(f.endswith(".json.gz") for f in read.inputFiles())


def test_captured_turns_are_not_read_for_metadata(spark):
    """F8: of the captured table, what a query tells of it is shuffled once, without the turns."""
    read = registry.QUERIES["r1_continuous_capture"](spark, SF)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert exchanges(read) == 1 and "Join" not in plan and "turns" not in plan


def test_files_share_the_state_of_their_group(spark, tmp_path):
    """Python is called, and a state kept, for a group of files; each file's rules are as told one by one."""
    start, wait, groups, draw = datetime(2024, 1, 1), 400, 16, random.Random(9)
    rows = [(f"f{i}" if i else None, k * 1_000 + i, start + timedelta(seconds=draw.randrange(40_000)), draw.choice([*jobs.STEPS, "parsing", "embedding"])) for i in range(300) for k in range(draw.randrange(1, 5))]
    rows.sort(key=lambda r: r[2] + timedelta(minutes=draw.randrange(50)))  # late, but no later than the watermark
    events, seen = files(spark, tmp_path, [rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3] for k in range(3)], "id string, event_id bigint, ts timestamp, asked string"), []
    told = jobs.drain(jobs.file_machine(events, wait, groups=groups), "update", seen=seen).collect()
    got = {r.id: (r.status, r.error, r.refused) for r in sorted(told, key=lambda r: r.step)}
    ms = lambda ts: int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)
    end, want = max(ms(r[2]) for r in rows) - 3_600_000, {}
    for i in {r[0] for r in rows}:
        status, error, refused, last = jobs.asked_for(("pending", None, 0, 0), sorted((ms(ts), e, asked) for j, e, ts, asked in rows if j == i), wait * 60_000)
        late = status not in jobs.FINAL and last + wait * 60_000 < end
        want[i] = ("error", jobs.TIMED_OUT, refused) if late else (status, error, refused)
    assert got == want and len(want) == 300 and {s for s, _, _ in want.values()} == {"parsing", "pending", "embedding", "completed", "error"}
    assert len({(r.id, r.step) for r in told}) == len(told)
    held = [s["numRowsTotal"] for p in seen for s in p["stateOperators"]]
    assert len(held) >= 3 and max(held) == groups + 1  # one of them is that of files without a name
