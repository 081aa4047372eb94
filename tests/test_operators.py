"""Golden rows, invariants and edge cases of single operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklight.functions import expressions as X
from tracklight.operators import analytics as A
from tracklight.operators import capture as C
from tracklight.operators import decisions as D
from tracklight.operators import listing as L
from tracklight.operators import privacy as P
from tracklight.operators import search as S
from tracklight.operators import text as T
from tracklight.operators import windows as W
from tracklight.plans import registry
from tracklight.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hash_and_summary(spark):
    assert one(spark, X.hash_identifier(F.lit("id"), "salt")) == "6a267e25e7f7c926"
    assert one(spark, X.first_sentence(F.lit("A. B"))) == "A."
    assert one(spark, X.first_sentence(F.lit("x" * 120))) == "x" * 100 + "..."
    assert one(spark, X.token_estimate(F.lit("abc"))) == 1
    assert one(spark, X.clamp(F.lit(None).cast("double"))) is None


def test_upper_median(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert A.duration_stats(rows, "v").first().median_value == 3.0
    assert A.duration_stats(rows.where("false"), "v").first().median_value is None


@pytest.mark.parametrize("status,stop,users,name,confidence,kind,reasons", [
    ("completed", "end_turn", 1, "completed", 0.8, "success", ["Run completed without errors", "Agent naturally ended turn", "Used 2 tool calls"]),
    ("completed", "end_turn", 4, "completed", 0.9, "success", ["Run completed without errors", "Agent naturally ended turn", "High user engagement (4 user messages)", "Used 2 tool calls"]),
    ("completed", "max_tokens", 9, "incomplete", 0.5, "partial_success", ["Run completed without errors", "Hit token limit (may be incomplete)", "Used 2 tool calls"]),
    ("completed", "error", 1, "completed", 0.7, "success", ["Run completed without errors", "Used 2 tool calls"]), ("completed", None, 4, "completed", 0.8, "success", ["Run completed without errors", "High user engagement (4 user messages)", "Used 2 tool calls"]),
    ("failed", None, 1, "failed", 0.9, "failure", ["Run failed with error", "Error: boom", "Used 2 tool calls"]), ("cancelled", None, 1, "failed", 0.8, "failure", ["Run was cancelled", "Used 2 tool calls"]),
    ("running", None, 1, "unknown", 0.5, "unknown", ["Used 2 tool calls"]),
])
def test_outcome(spark, status, stop, users, name, confidence, kind, reasons):
    o = one(spark, C.outcome(F.lit(status), F.lit(stop).cast("string"), F.lit(users), F.lit(2), F.lit("boom")))
    assert (o.status, o.confidence, o.type, o.reasoning) == (name, confidence, kind, reasons)


def test_fallbacks(spark):
    said = lambda done, words: F.struct(F.lit(done).cast("boolean").alias("completed"), F.lit(words).cast("string").alias("feedback"))
    for outcome, score, why in (
        (said(True, "I LOVED it, not bad"), 0.9, "Task completed, Positive user feedback"), (said(False, "it didn't help"), 0.1, "Task not completed, Negative user feedback"), (said(None, "poor"), 0.1, "Task not completed, Negative user feedback"),
        (said(True, "thank you"), 0.7, "Task completed"), (F.when(F.lit(False), said(True, "")), 0.5, "no clear signals"),
    ):
        got = one(spark, C.fallback_score(outcome))
        assert (got.score, got.reasoning) == (score, f"Heuristic score based on: {why}")
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    assert one(spark, C.fallback_summary(F.lit("do"), F.lit(False), F.lit("fine"), F.lit(7))) == "User request: do | Status: Abandoned | Feedback: fine"
    assert one(spark, C.fallback_summary(none, flag, none, F.lit(7))) == "Agent execution trace with 7 bytes"
    for turns, tools, messages, want in ((2, 0, 10, ("simple", ["general"])), (5, 1, 11, ("moderate", ["tool_usage", "extended_interaction"])), (10, 0, 11, ("complex", ["extended_interaction"]))):
        got = one(spark, C.fallback_labels(F.lit(turns), F.lit(tools), F.lit(messages)))
        assert (got.complexity, got.tags) == want


def test_cost_of_all_kinds_of_tokens(spark):
    prices = spark.createDataFrame([("a-b-c", 2.0, 4.0, 0.5, 3.0, 8.0), ("m", 1.0, 1.0, None, None, None)], "model string, input double, output double, cached double, cache_write double, reasoning double")
    steps = spark.createDataFrame([("p/m", 10, 0, 4, None, 2), ("a-b-c-2024", 1_000_000, 500_000, 100_000, 200_000, 250_000), ("x", 5, 5, 5, 5, 5), ("m", 0, 0, 0, 0, 0)], "model string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint")
    got = {r.model: tuple(r[c] for c in ("input_cost", "output_cost", "cached_cost", "cache_write_cost", "reasoning_cost", "total_cost")) for r in A.step_cost(steps, prices).collect()}
    assert got["a-b-c-2024"] == (2.0, 2.0, 0.05, 0.6000000000000001, 2.0, 6.65)  # prompt tokens are billed in full
    assert got["p/m"] == (1e-05, None, 0.0, None, 0.0, 1e-05)
    assert got["x"] == (None,) * 6 and got["m"] == (None,) * 6


def test_confidence_and_score_bins(spark):
    rows = spark.createDataFrame([(0.3,), (1.0,), (0.05,)], "v double")
    assert {r.label for r in A.histogram(rows, "v", percent=True).collect()} == {"20-30%", "90-100%", "0-10%"}
    assert {r.label for r in A.histogram(rows, "v").collect()} == {"0.3-0.4", "0.9-1.0", "0.0-0.1"}
    assert {r.label for r in A.histogram(rows, "v", 4, percent=True).collect()} == {"25-50%", "75-100%", "0-25%"}


@pytest.mark.parametrize("text,kind", [("Validation TIMEOUT", "Timeout"), ("validation error", "ValidationError"), ("Unauthorized", "PermissionError"), ("file not found: error", "NotFoundError"), ("an Exception", "Error"), ("bad", None)])
def test_error_types(spark, text, kind):
    assert one(spark, X.error_type(F.lit(text))) == kind


def test_ranks_over_ranges(spark, monkeypatch):
    """The same medians, shares and percentiles, however many ranges the values are dealt to."""
    rng = random.Random(2)
    rows = [(rng.choice("aab"), float(rng.randrange(40)) if rng.random() < 0.7 else rng.random()) for _ in range(500)] + [("c", None), ("a", -5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for per in (1_000_000, 20):
        monkeypatch.setattr(L, "RANGE_ROWS", per)
        stats = {r.g: r.median_value for r in A.duration_stats(df, "v", ["g"]).collect()}
        for g in "ab":
            of = sorted(v for k, v in rows if k == g and v is not None)
            assert stats[g] == of[len(of) // 2]
        for r in A.cumulative_share(df.where("v is not null"), "v", ["g"]).collect():
            of = [v for k, v in rows if k == r.g and v is not None]
            assert abs(r.share - sum(v <= r.v for v in of) / len(of)) < 1e-12
        line = np.quantile([v for _, v in rows if v is not None], 0.9)
        assert L.above_percentile(df, "v", 0.9).count() == sum(v >= line - 1e-12 for _, v in rows if v is not None)


def test_searchable_and_embedding_texts(spark):
    row = spark.createDataFrame([("run", "reasoning", True, "", None, '{"a": "%s", "b": {"c": 1}, "d": [1], "e": 2, "f": false, "g": 1}' % ("y" * 51))], "action string, decision_type string, success boolean, response_text string, error_type string, arguments string")
    assert row.select(D.searchable_text(F.lit("r" * 600)).alias("x")).first().x == f"Action: run | Type: reasoning | Rationale: {'r' * 500} | Outcome: success"
    assert row.select(D.searchable_text().alias("x")).first().x == "Action: run | Type: reasoning | Outcome: success"
    args = f"a={'y' * 47}..., b=<dict>, d=<list>, e=2, f=False"
    want = f"Decision type: reasoning | Context: c | Available actions: x, y | Action: run | Arguments: {args} | Rationale: why | Outcome: Success | Alternatives considered: p, q, r"
    assert row.select(D.embedding_text(F.lit("c"), F.array(F.lit("x"), F.lit("y")), F.lit("why"), F.array(*[F.lit(c) for c in "pqrs"])).alias("x")).first().x == want
    assert row.withColumn("arguments", F.lit("{}")).select(D.embedding_text().alias("x")).first().x == "Decision type: reasoning | Action: run | Outcome: Success"
    made = D.embed_decisions(row, lambda d: S.embed(d, "searchable_text"), lambda: F.upper("action")).first()
    assert made.searchable_text == "RUN" and len(made.embedding) == 64


def test_middle_cut_budgets(spark):
    cut = lambda text, n: one(spark, T.middle_cut(F.lit(text), n))
    text = "".join(chr(97 + i % 26) for i in range(1000))
    got = cut(text, 200)
    assert got.dropped == 880 and got.text == text[:60] + "\n[TRUNCATED: dropped 880 middle chars due to context budget]\n" + text[-60:]
    small = cut(text, 100)  # the marker needs 61 characters of 40: 21 of the tail's 30 go, its last ones
    assert small.dropped == 940 and small.text.startswith(text[:30] + "\n[TRUNCATED: dropped 940")
    assert small.text.endswith("budget]\n" + text[-30:][:-21])
    assert cut(text, 40).text == text[:12] + "\n[TRUNCATED: dropped 976 middle chars due to context budget]\n"
    assert tuple(cut("short", 5)) == ("short", 0) and tuple(cut(text, 0)) == (text, 0)


def test_eviction_without_the_message_it_looks_for(spark):
    def kept(f, roles, *args):
        rows = spark.createDataFrame([("c", i, r, "x") for i, r in enumerate(roles)], "trajectory_id string, sequence_id int, role string, text string")
        return [r.kept for r in f(rows, *args).orderBy("sequence_id").collect()]

    s, u, a = "system", "user", "assistant"
    assert kept(T.static_evict, [s, u, a, u, a, a], 4, 2) == [True, False, False, False, False, False]  # no user message follows
    assert kept(T.static_evict, [s, u, a, u, a, u], 4, 3) == [True, False, False, True, True, True]
    assert kept(T.static_evict, [s, u, a, u, a], 4, 9) == [True] * 5
    assert kept(T.partial_evict, [s, a, u, u], 0.5) == [None] * 4
    rows = spark.createDataFrame([("c", i, u, "x") for i in range(4)], "trajectory_id string, sequence_id int, role string, text string")
    assert T.partial_evict(rows, 0.5).first().error == "No assistant message found from indices 2 to 4"


@pytest.mark.parametrize("include,hits,misses", [("*.py", ["a.PY", "d/x.py"], ["a.pyc"]), ("b?*.md", ["ab1.md", "b_.md"], ["b.MD", "bmd"]), ("test", ["my_TEST_1"], ["tst"]), ("^a.*", ["ab"], ["ba"])])
def test_name_patterns_search(spark, include, hits, misses):
    rx = re.compile(L.name_pattern(include))
    assert all(rx.search(x) for x in hits) and not any(rx.search(x) for x in misses)


def test_unique_names(spark):
    rows = [(1, "s", "a.tar.gz", False), (2, "s", "a.tar.gz", True), (3, "s", "a.tar.gz", False), (4, "s", "a.tar.gz", False), (5, "r", ".env", False), (6, "r", ".env", False), (7, "s", "z" * 300 + ".md", False), (8, "s", "z" * 299 + ".md", False)]
    df = spark.createDataFrame(rows, "file_id int, source_id string, file_name string, is_deleted boolean").withColumn("source_name", F.concat(F.lit("src "), "source_id"))
    got = [r.unique_name for r in W.unique_names(df).orderBy("file_id").collect()]
    z = "z" * (255 - 3 - 6)
    assert got == ["src s/a.tar.gz", "src s/a.tar_(1).gz", "src s/a.tar_(1).gz", "src s/a.tar_(2).gz", "src r/.env", "src r/.env_(1)", f"src s/{z}.md", f"src s/{z}_(1).md"]


@pytest.mark.parametrize("name,want", [("/a/b/c.txt", "c.txt"), ("a<b>:c?.md", "abc.md"), (".env", None), ("CON.txt", "CON_.txt"), ("tail. .pdf", "tail.pdf"), ("x" * 300 + ".md", "x" * 252 + ".md"), ("d\\e.txt", "de.txt"), ("a.tar.gz", "a.tar.gz")])
def test_file_names(spark, name, want):
    assert one(spark, X.sanitise_file_name(F.lit(name))) == want


def test_entity_filters(spark):
    def match(arguments, *args):
        return one(spark, S.entity_match(F.lit(arguments), *args))

    assert match("{}") and not match("{}", "world") and not match('{"k": "42"}', None, "42")
    assert match('{"type": "world"}', "world") and match('{"entity_type": "world"}', "world", "other")
    assert match('{"world_id": "w"}', "world", "w") and not match('{"world_id": "w"}', "story", "w")
    assert match('{"id": "w"}', None, "w") and match('{"entity_id": "w"}', None, "w")
    active = F.array(F.struct(F.lit("world").alias("entity_type"), F.lit("w").alias("entity_id")))
    assert match("{}", "world", "w", active) and not match("{}", "world", "v", active) and match(None, None, "w", active)


def test_context_block_format(spark):
    rows = spark.createDataFrame(
        [(1, "success", 1, 0.876, "law", None, "file", "because", None, None, None), (1, "failure", 1, 0.5, "law", "late", "appeal", None, "too late", "Timeout", "ask first"), (2, "failure", 1, 0.25, None, None, "x", "", None, None, None)],
        "query_id int, kind string, rank int, similarity double, domain string, context string, action string, rationale string, result string, error_type string, feedback string",
    )
    got = {r.query_id: r.block for r in S.context_block(rows).collect()}
    assert got[1] == (
        "## Relevant Past Decisions\n\nConsider these successful past approaches:\n\n### Example 1 (similarity: 0.88, outcome: ✓ Success)\n**Domain**: law\n**Action**: file\n**Reasoning**: because\n**Result**: Success\n\n"
        "## Anti-Patterns to Avoid\n\nThe following approaches led to poor outcomes:\n\n### Example 1 (similarity: 0.50, outcome: ✗ Failed)\n**Domain**: law\n**Context**: late\n**Action**: appeal\n**Result**: too late\n**Error**: Timeout\n**Lesson**: ask first\n"
    )
    assert got[2] == "## Anti-Patterns to Avoid\n\nThe following approaches led to poor outcomes:\n\n### Example 1 (similarity: 0.25, outcome: ✗ Failed)\n**Action**: x\n**Result**: Failed\n"


def test_context_block_rounds_similarities_as_the_sql_does(spark, tmp_path):
    """each similarity that ends in a 5 at the third place is told as by printf, in the operator and in the query."""
    told = sorted({n / 1000 for n in range(-995, 1000, 10)} | {-0.001, -0.0, 0.285001, 0.994999, 1.0})
    rows = spark.createDataFrame([(i, "success", 1, s, "x", "y") for i, s in enumerate(told)], "query_id int, kind string, rank int, similarity double, action string, result string")
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("domain", "context", "rationale", "error_type", "feedback")])
    got = {r.query_id: re.findall(r"similarity: (.*?),", r.block) for r in S.context_block(rows).collect()}
    assert got == {i: [f"{s:.2f}"] for i, s in enumerate(told)}

    # every call's trajectory is linked to the only document; a query has the cosine s with it
    con = duckdb.connect()
    con.execute("create table documents as select cast(0 as bigint) as doc_id, 'a' as text, 'en' as lang, 's' as source, 1 as n_chars")
    con.execute("create table labels as select doc_id, 1 as quality, 0 as toxic from documents where false")
    con.execute("create table events as select i as event_id, timestamp '2024-01-01' + to_hours(cast(i as int)) as ts, i as user_id, 'click' as event_type, cast(50 * (i % 4) as double) as value, 'p' as props from range(12) r(i)")
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [(50 * i, [s, (1 - s * s) ** 0.5]) for i, s in enumerate([1.0, *told])])
    for t in ("documents", "labels", "events", "embeddings"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = dict(con.execute("select query_id, block from (" + registry.ORACLES["v12_context_block"] + ")").fetchall())
    assert {r.query_id: r.block for r in registry.QUERIES["v12_context_block"](spark, str(tmp_path)).collect()} == want
    assert {k: set(re.findall(r"similarity: (.*?),", v)) for k, v in want.items()} == {50 * i: {f"{s + 0.0:.2f}"} for i, s in enumerate([1.0, *told])}
    assert all(len(re.findall("✓", v)) == 5 and len(re.findall("✗", v)) == 5 for v in want.values())


def scored(queries, rows):
    """Each query with each row that has a vector, and their cosine: all pairs of small tables."""
    pairs = rows.where("embedding is not null").crossJoin(queries)
    return pairs.withColumn("similarity", X.cosine("query_embedding", "embedding"))


def test_nearest_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"r{i:03d}", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)] + [("none", None), ("zero", [0.0] * 6)]
    df = spark.createDataFrame(rows, "trajectory_id string, embedding array<double>").repartition(5)
    q = df.where("trajectory_id like 'r00%' or trajectory_id = 'zero'").select(F.col("trajectory_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    exact = scored(q, df).withColumn("similarity", F.round("similarity", 6))
    for block in (1000, 3):
        monkeypatch.setattr(S.blocks, "__defaults__", (block,))
        want = sorted((r.query_id, r["rank"], r.trajectory_id, r.similarity) for r in S.best(exact, 7).collect())
        assert sorted((r.query_id, r["rank"], r.trajectory_id, r.similarity) for r in S.nearest(q, df, 7).collect()) == want
    floor = S.best(exact.where("similarity >= 0.5"), 4)
    assert S.nearest(q, df, 4, floor=0.5).select("query_id", "trajectory_id").exceptAll(floor.select("query_id", "trajectory_id")).count() == 0
    assert S.nearest(q, df, 400).count() == exact.count() and S.nearest(q, df.where("false"), 4).count() == 0 and S.nearest(q.where("false"), df, 4).count() == 0


def test_wrapped_lines_equal_a_plain_loop(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", "  ", "x" * 250 + " y", "aa " * 300]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.wrap_chunks(F.col("text")).alias("lines"))
    for r in got.collect():
        lines, text = r.lines, texts[r.i]
        if text is None:
            assert lines is None
            continue
        assert " ".join(lines).split() == text.split()
        for a, b in zip(lines, lines[1:], strict=False):
            words = a.split()
            assert len(words) == 1 or len(a) <= 101  # letters and gaps
            assert sum(map(len, words)) + len(b.split()[0]) + len(words) > 100


def test_passages_equal_a_plain_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    first = {}
    for i, text in sorted(docs, key=lambda d: str(d[0])):
        w = (text or "").split()
        for n, at in enumerate(range(0, max(0, len(w) - 11) + 1, 40) if w else ()):
            chunk = " ".join(w[at : at + 50])
            vector = tuple(round(x, 9) for x in S.hashed_tokens([chunk])[0])
            first.setdefault(vector, (str(i), n, hashlib.sha256(chunk.encode()).hexdigest()))
    got = registry.QUERIES["s5_load_passages"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.file_id, r.position, r.text_sha256) for r in got) == sorted(first.values())


def test_default_embeddings_equal_a_plain_loop(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in registry.QUERIES["v27_embed"](spark, "/root/testdata/sf0.001").collect():
        v = [0] * 64
        for w in texts[r.doc_id].lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & 0x10000 else -1
        size = sum(x * x for x in v) ** 0.5
        assert r.dimension == 64 and all(abs(a - x / size) < 2e-6 for a, x in zip(r.embedding, v, strict=True))


def test_block_history(spark):
    log = [("checkpoint", "a"), ("undo", None), ("redo", None), ("checkpoint", "b"), ("checkpoint", "c"), ("undo", None), ("undo", None), ("undo", None), ("checkpoint", "d"), ("redo", None), ("undo", None)]
    rows = [("x", i, k, v) for i, (k, v) in enumerate(log)] + [("y", 0, "undo", None), ("y", 1, "redo", None), ("y", 2, "checkpoint", "e")]
    got = W.block_versions(spark.createDataFrame(rows, "block_id string, at int, kind string, value string").repartition(3)).orderBy("block_id", "at").collect()
    assert [(r.sequence, r.value, r.checkpoints) for r in got if r.block_id == "x"] == [(1, "a", 1), (1, "a", 1), (1, "a", 1), (2, "b", 2), (3, "c", 3), (2, "b", 3), (1, "a", 3), (1, "a", 3), (2, "d", 2), (2, "d", 2), (1, "a", 2)]
    assert [(r.sequence, r.value) for r in got if r.block_id == "y"] == [(0, None), (0, None), (1, "e")]


def test_clean_conversation(spark):
    ddl = "conversation int, seq int, role string, text string, calls array<string>, call_id string, is_summary boolean, approved boolean"

    def clean(*rows):
        df = spark.createDataFrame([(1, i, r, t, c, k, s, a) for i, (r, t, c, k, s, a) in enumerate(rows)], ddl)
        return [(r.role, r.text, r.calls) for r in W.clean_conversation(df).orderBy("seq").collect()]

    u = ("user", "hi", [], None, False, None)
    asks = ("approval", "may I", ["b", "a"], None, False, None)
    assert clean(u, ("assistant", "do ", ["a", "a"], None, False, None), asks, ("tool", "r1", [], "a", False, None), ("tool", "r2", [], "a", False, None), u) == [
        ("user", "hi", []), ("assistant", "do may I", ["a", "b"]), ("tool", "r1", []), ("user", "hi", [])]
    assert clean(u, ("assistant", "do", ["a"], None, False, None), asks) == [("user", "hi", [])]  # a lone request and its call
    assert clean(u, ("assistant", None, [], None, False, None)) == [("user", "hi", [])]  # reasons alone
    assert clean(u, asks, ("user", "sum", [], None, True, None), ("approval", "", [], None, False, True)) == [("user", "hi", []), ("user", "sum", []), ("approval", "", [])]


def test_capture_golden(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([("r", "a", "completed", "end_turn", t0, t0 + dt.timedelta(seconds=330)), ("e", "a", "failed", None, t0, None)], "run_id string, agent_id string, status string, stop_reason string, created_at timestamp, completed_at timestamp")
    steps = spark.createDataFrame([("r", 1, "m", 100, 50), ("r", 2, "m", 150, 75)], "run_id string, step_no int, model string, prompt_tokens bigint, completion_tokens bigint")
    messages = spark.createDataFrame([("r", 1, 1, "m1", "user", "hi", None), ("r", 1, 2, "m2", "assistant", "x", ["search_memory"]), ("r", None, 3, "m3", "user", "lost", None)], "run_id string, step_no int, seq bigint, message_id string, role string, text string, tools array<string>")
    got = {r.run_id: r for r in C.build_trajectories(runs, steps, messages).collect()}
    m = got["r"].metadata
    assert (m.input_tokens, m.output_tokens, m.total_tokens, m.duration_ns, m.tools_used) == (250, 125, 375, 330_000_000_000, ["search_memory"])
    assert [len(t.messages) for t in got["r"].turns] == [2, 0]
    assert got["e"].metadata.duration_ns is None and got["e"].metadata.step_count == 0 and got["e"].turns is None


def test_fusion_golden(spark):
    a = spark.createDataFrame([("m1", 1), ("m2", 2), ("m3", 3)], "id string, rank int")
    b = spark.createDataFrame([("m2", 1), ("m3", 2), ("m1", 3)], "id string, rank int")
    got = S.reciprocal_rank_fusion(a, b, 3, weights=(0.6, 0.4)).collect()
    assert [r.id for r in got] == ["m2", "m1", "m3"]
    assert abs(got[1].score - (0.6 / 61 + 0.4 / 63)) < 1e-12
    assert S.reciprocal_rank_fusion(a.where("false"), b.where("false"), 3).count() == 0
    assert [r.id for r in S.reciprocal_rank_fusion(a, b.where("false"), 3).collect()] == ["m1", "m2", "m3"]


def test_half_even_start(spark):
    rows = spark.createDataFrame([("c", i, "assistant", "x") for i in range(5)], "trajectory_id string, sequence_id int, role string, text string")
    assert [r.kept for r in T.partial_evict(rows, 0.5).orderBy("sequence_id").collect()] == [True, False, True, True, True]


def test_inverted_lists_are_pruned(spark, tmp_path):
    """A query opens the files of its own lists alone; neighbours at a boundary are found on its other side."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("trajectory_id"), "embedding")
    queries = rows.where("cast(trajectory_id as int) % 50 = 0").select(F.col("trajectory_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    path, centres = str(tmp_path / "lists"), S.centres_of(rows, 64)
    S.write_lists(rows, centres, path)
    stored = spark.read.parquet(path)
    assert stored.select("k").distinct().count() == rows.count() and rows.count() < stored.count() <= 4 * rows.count()
    exact = S.nearest(queries, rows, 10)
    found = S.probe(queries, path, centres, 16, 10)
    assert S.recall(found, exact).first().recall >= 0.9
    assert found.groupBy("query_id", "trajectory_id").count().where("count > 1").count() == 0
    one_ = queries.limit(1).collect()[0]
    near = np.argsort(-S.similarities("cosine", centres, np.array([one_.query_embedding], float)), axis=1)[0, :16]
    read = S.read_lists(spark, path, near)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan or "PartitionFilters: [isnotnull(list#" in plan
    rows_read, whole = read.select("k"), stored.select("k")
    rows_read.collect(), whole.collect()
    scan = lambda df: df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    opened, everything = (scan(df).apply("numPartitions").value() for df in (rows_read, whole))
    assert 0 < opened <= 16 < everything
    # clear clusters need no copies
    apart = spark.createDataFrame([(str(i), [1.0 if j == i % 4 else 0.01 * (i % 3) for j in range(4)]) for i in range(80)], "trajectory_id string, embedding array<double>")
    S.write_lists(apart, S.centres_of(apart, 4), str(tmp_path / "apart"))
    assert spark.read.parquet(str(tmp_path / "apart")).count() == 80


def plain_bm25(docs, query, k1=1.2, b=0.75):
    import math

    cut = {i: [w for w in re.split(r"\W+", (t or "").lower()) if w] for i, t in docs}
    mean, terms = sum(map(len, cut.values())) / len(cut), set(w for w in re.split(r"\W+", query.lower()) if w)
    df = {t: sum(t in w for w in cut.values()) for t in terms}
    out = []
    for i, w in cut.items():
        s = sum(math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in terms)
        if s > 0:
            out.append((-round(s, 6), i))
    return sorted(out)


def test_bm25_best_k_equal_the_full_ranking(spark, monkeypatch):
    """Several queries, stop words among them, over blocks of rows and of queries; no posting is shuffled."""
    rng = random.Random(11)
    often, seldom = ["the", "of", "and", "é"], [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(often if rng.random() < 0.6 else seldom) for _ in range(rng.randint(0, 40)))) for i in range(700)] + [(700, None), (701, "W1 w1. THE w1"), (702, "")]
    queries = [("q1", "the w1 W2"), ("q2", "w5"), ("q3", "zzz"), ("q4", "of the and é"), ("q5", ""), ("q6", None), ("q7", " ".join(seldom[:30]))]
    df, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(queries, "query_id string, query string")
    for rows, block in ((512, 1000), (7, 1000), (64, 2)):
        monkeypatch.setattr(S, "BOUND_ROWS", rows)
        monkeypatch.setattr(S.blocks, "__defaults__", (block,))
        got = S.bm25(df, q, 9)
        have = {}
        for r in got.orderBy("query_id", "rank").collect():
            have.setdefault(r.query_id, []).append((r.doc_id, r.score))
        want = {i: [(d, -s) for s, d in plain_bm25(docs, text)[:9]] for i, text in queries if text}
        for i, found in want.items():
            assert [d for d, _ in have.get(i, [])] == [d for d, _ in found]
            assert all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(have.get(i, []), found, strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(query_id" in plan
    assert S.bm25(df.where("false"), q, 3).count() == 0 and S.bm25(df, q.where("false"), 3).count() == 0


def test_bounds_skip_blocks_of_rows():
    """A query that has its k best looks at no block whose weights cannot reach them."""
    import pyarrow as pa

    words = [["a", "b"]] * 3 + [["a"] + ["x"] * 30] * 500
    batch = pa.record_batch({"k": list(range(len(words))), "w": words})
    (out,) = S._best_texts(iter([batch]), ["a", "b"], ["q"], [np.array([0, 1])], np.array([0.5, 2.0]), 5.0, 3, 1.2, 0.75, 6, "k")
    assert out.column(1).to_pylist() == [0, 1, 2]


def test_v26_finds_neighbours_of_all_stated_queries(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(S.blocks, "__defaults__", (3,))
    t = registry.Tables(spark, sf)
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = registry.QUERIES["v26_ivf"](spark, sf).cache()
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == {r.query_id for r in queries.select("query_id").collect()}
    assert S.recall(got, S.best(scored(queries, t.v_trajectories), 10)).first().recall >= 0.9


def test_nest_and_flatten_are_inverse(spark):
    d = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y"), ("a", 3, 0, "z"), ("b", 1, 0, "x")], "trajectory_id string, turn_index int, decision_index int, action string")
    assert sorted(map(tuple, D.flatten_decisions(D.nest_decisions(d)).collect())) == sorted(map(tuple, d.collect()))


def test_anonymised_output_has_no_ids(spark):
    rows = spark.createDataFrame([("t-1", [("m-1", "secret. more", {"k": "secret"})])], "trajectory_id string, messages array<struct<message_id:string,text:string,content:map<string,string>>>")
    for policy in (P.Policy(salt="s"), P.LEARNING):
        text = str(P.anonymise(rows, policy).collect())
        assert "t-1" not in text and "m-1" not in text and "more" not in text


def test_tool_entities_at_any_depth(spark):
    deep = '{"path":"/deep"}'
    for _ in range(300):
        deep = '{"a":[%s]}' % deep
    arguments = [
        '{"files":[{"path":"/a"},{"x":[{"url":"u1"}]},"/no",5]}', '{"a":{"b":{"c":{"d":{"e":{"key":"k6"}}}}}}', deep, '{"file":"[draft] b","id":7,"ref":"","name":null,"target":true}', '[{"path":"/top"}]', "no json", None, "{}",
        '{"id":%s,"uri":"u2"}' % ("9" * 5000), '{"entity":"\\ud800"}', '{"path":"{\\"path\\":\\"/in a text\\"}"}',
        '{"user_id":"http://x"}', '{"file_url":"u3"}', '{"resource_id":"http://y"}',
    ]
    rows = spark.createDataFrame([("t", 0, i, "run", a) for i, a in enumerate(arguments)], "trajectory_id string, ts int, event_id int, action string, arguments string")
    got = sorted(r.entity_id for r in D.tool_entities(rows).collect())
    assert got == sorted(["tool:run", "file:/a", "url:u1", "reference:k6", "file:/deep", "file:[draft] b", "url:u2", "reference:?", 'file:{"path":"/in a text"}', "resource:http://x", "file:u3", "resource:http://y"])


def test_page_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", None), ("e", None), ("f", 2)], "id string, created_at int")
    seen, cursor = [], None
    while True:
        page = [r.id for r in L.page(rows, "id", 2, after=cursor).collect()]
        if not page:
            break
        seen += page
        cursor = page[-1]
    assert seen == ["f", "c", "b", "a", "e", "d"]


def test_strip_html_against_parser(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", T.strip_html(F.col("html")).alias("text")).collect():
        p = Words()
        p.feed(r.html)
        drop = lambda ws: re.sub(r"&\w+;|[©·]", "", "".join(ws))
        assert drop(r.text.split()) == drop(p.words)


def test_stores(spark, tmp_path):
    doc = '{"run_id": "r", "metadata": {"status": "completed"}}'
    (tmp_path / "one.json").write_text(doc)
    got = io.read_trajectories(spark, str(tmp_path / "one.json"), "run_id string, metadata struct<status:string>").first()
    assert (got.run_id, got.metadata.status) == ("r", "completed")
    (tmp_path / "chat.jsonl").write_text('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}\n')
    assert [(r.turn, r.role, r.text) for r in io.read_chat_log(spark, str(tmp_path / "chat.jsonl")).orderBy("turn").collect()] == [(0, "user", "a"), (1, "assistant", "b")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert io.read_any(spark, str(tmp_path / "t.csv"), "csv").first().b == "x"
    names = {r.name: r["size"] for r in io.list_files(spark, str(tmp_path), "*.csv").collect()}
    assert names == {"t.csv": 8}
    rows = spark.createDataFrame([("a", "d1"), ("b", "d2")], "trajectory_id string, domain_type string")
    io.write_trajectories(rows, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("domain_type = 'd2'").first().trajectory_id == "b"


def test_empty_tables(spark):
    calls = spark.createDataFrame([], "trajectory_id string, turn_index int, ts timestamp, event_id bigint, call_id string, action string, arguments string, response_text string, confidence double, pivotal boolean, decision_type string")
    d = D.judge(D.match_responses(D.extract_decisions(calls), D.responses_of(calls)))
    assert d.count() == 0 and A.success_rate(d).count() == 0 and A.snapshot(d, d.select("trajectory_id", F.lit("x").alias("outcome"), F.lit(1).alias("turns"), F.lit(1).alias("messages"))).first().trajectories == 0
    assert D.tool_entities(calls).count() == 0 and io.spans(d).count() == 0
    assert W.evict_open_files(spark.createDataFrame([], "agent_id string, file_id string, is_open boolean, last_accessed_at timestamp"), 3).count() == 0
