"""Golden rows of rules that a query and its SQL could share an error in."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tracklight.operators import analytics as A
from tracklight.operators import privacy as P
from tracklight.operators import search as S
from tracklight.operators import text as T
from tracklight.operators import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


DECISIONS = "trajectory_id string, turn_index int, action string, success boolean, error_type string, decision_type string, pivotal boolean, confidence double"


def decisions(spark):
    rows = [("a", 0, "run", True, None, "reasoning_step", True, 0.5)] * 3 + [("a", 1, "run", False, "Timeout", None, False, None), ("b", 0, "stop", None, None, None, None, 1.0), ("b", 0, "go", False, "Error", None, False, None), ("b", 2, "go", True, "Error", None, False, None)]
    ended = spark.createDataFrame([("a", "success", 2, 9), ("b", None, 3, 4), ("c", "success", 0, 0)], "trajectory_id string, outcome string, turns int, messages int")
    return spark.createDataFrame(rows, DECISIONS), ended


def test_snapshot_counts_turns_messages_and_outcomes(spark):
    got = A.snapshot(*decisions(spark)).first()
    assert (got.trajectories, got.turns, got.decisions, got.messages) == (3, 5, 7, 13)
    assert (got.avg_turns, got.avg_decisions) == (5 / 3, 7 / 5)  # decisions by turn, not by trajectory
    assert got.success_rate == 4 / 6 and got.pivotal == 3 and got.avg_confidence == 2.5 / 4
    assert (got.action, got.error_type, got.decision_type) == ("go=2,run=4,stop=1", "Error=2,Timeout=1", "reasoning_step=3")
    assert (got.turn_distribution, got.outcomes, got.success_rates) == ("0=1,2=1,3=1", "success=2,unknown=1", "go=0.5,run=0.75,stop=0.0")


def test_report_text(spark):
    got = A.report(*decisions(spark)).first().report
    assert got.split("\n") == [
        "=== OTS Analytics Summary ===", "", "Totals:", "  Trajectories: 3", "  Turns: 5", "  Decisions: 7", "  Messages: 13", "", "Averages:", "  Turns per trajectory: 1.7", "  Decisions per turn: 1.4", "  Overall success rate: 66.7%", "",
        "Top Actions:", "  run: 4 calls (75% success)", "  go: 2 calls (50% success)", "  stop: 1 calls (0% success)", "", "Outcomes:", "  success: 2", "  unknown: 1", "", "Top Errors:", "  Error: 2", "  Timeout: 1",
    ]
    d, e = decisions(spark)
    assert A.report(d.where("error_type is null"), e).first().report.endswith("  unknown: 1")


def test_examples_need_score_and_result(spark):
    d = spark.createDataFrame([("good", True), ("good", False), ("bad", True), ("bad", False), ("none", True), ("none", False), ("mid", True), ("mid", False)], "trajectory_id string, success boolean").withColumns({"decision_id": F.concat_ws("-", "trajectory_id", F.col("success").cast("string")), "action": F.lit("run"), "arguments": F.lit("{}")})
    found = spark.createDataFrame([("q", "good", 0.9, 0.9), ("q", "bad", 0.8, 0.2), ("q", "none", 0.7, None), ("q", "mid", 0.6, 0.6)], "query_id string, trajectory_id string, similarity double, outcome_score double")
    got = sorted((r.kind, r["rank"], r.decision_id) for r in S.context_examples(found, d, 5).collect())
    assert got == [("failure", 1, "bad-false"), ("failure", 2, "none-false"), ("success", 1, "good-true"), ("success", 2, "none-true")]


def evicted(roles, sizes, share, window):
    """The cutoff by trying shares one after the other, or the reason that there is none."""
    n, tokens, p, at = len(roles), window, share, None
    while tokens >= (1 - share) * window and p < 1.0:
        p += 0.10
        at = next((i for i in reversed(range(1, round(p * n) + 1)) if i < n and roles[i] == "assistant"), None)
        if at is not None:
            tokens = sizes[0] + sum(sizes[at:])
    if at is None or p >= 1.0:
        return None, T.NO_CUT
    if at >= n - (2 if roles[-1] == "approval" else 1):
        return None, T.AT_END % at
    return at, None


def test_sliding_window_equals_a_loop(spark):
    import random

    rng, rows, want = random.Random(7), [], {}
    for c in range(120):
        n = rng.randint(1, 24)
        roles = ["system", *(rng.choice(["user", "assistant", "tool"]) for _ in range(n - 1))]
        if n > 2 and c % 5 == 0:
            roles[-1] = "approval"
        sizes = [rng.randint(1, 30) for _ in roles]
        rows += [(f"c{c}", i, r, "abcd" * s) for i, (r, s) in enumerate(zip(roles, sizes, strict=True))]
        want[f"c{c}"] = (roles, sizes)
    df = spark.createDataFrame(rows, "trajectory_id string, sequence_id int, role string, text string")
    for share, window in ((0.3, 200), (0.5, 300), (0.05, 120), (0.9, 5000)):
        got = {r.trajectory_id: (r.cutoff, r.error) for r in T.window_evict(df, share, window).collect()}
        assert got == {k: evicted(*v, share, window) for k, v in want.items()}


def test_clipped_summaries_say_so(spark):
    assert one(spark, T.clip(F.lit("abcdef"), 3)) == "abc... [summary truncated to fit]" and one(spark, T.clip(F.lit("abc"), 3)) == "abc"


def test_packed_summaries(spark):
    at = [datetime(2024, 1, 31, 18, 5, tzinfo=timezone.utc), datetime(2024, 7, 4, 6, 30, 59, tzinfo=timezone.utc), datetime(2024, 3, 10, 9, 59, 59, tzinfo=timezone.utc), datetime(2024, 3, 10, 10, tzinfo=timezone.utc)]
    for zone, names in (("America/Los_Angeles", ("PST", "PDT")), ("Asia/Kolkata", ("IST", "IST")), ("Australia/Sydney", ("AEST", "AEDT")), ("UTC", ("UTC", "UTC"))):
        rows = spark.createDataFrame([(i, int(x.timestamp())) for i, x in enumerate(at)], "i int, s bigint")
        got = {r.i: r.x for r in rows.select("i", T.local_stamp(F.timestamp_seconds("s"), zone, names).alias("x")).collect()}
        assert got == {i: x.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %I:%M:%S %p %Z%z") for i, x in enumerate(at)}
    limits = "hidden from view due to conversation memory constraints."
    packed = lambda message: json.dumps({"type": "system_alert", "message": message, "time": "now"}, indent=2, ensure_ascii=False)
    now, text, none = F.lit("now"), 'é "a"\n\\ 100%d', F.lit(None).cast("string")
    three = (F.lit(3), F.lit(4), F.lit(9))
    assert one(spark, T.packed_summary(F.lit(text), now, *three)) == packed(f"Note: prior messages (4 of 9 total messages) have been {limits}\nThe following is a summary of the previous 3 messages:\n {text}")
    assert one(spark, T.packed_summary(F.lit(text), now)) == packed(f"Note: prior messages have been {limits}\nThe following is a summary of the previous messages:\n {text}")
    assert one(spark, T.packed_summary(none, now, *three)) == packed(f"Note: 4 prior messages with the user have been {limits} Older messages are stored in Recall Memory and can be viewed using functions.")
    assert one(spark, T.packed_summary(none, now)) is None and one(spark, T.packed_summary(F.lit("x"), now, F.lit(3), F.lit(None).cast("int"), F.lit(9))) is None


CALL = "array<struct<name:string,arguments:string>>"


@pytest.mark.parametrize(
    "role,text,name,calls,want",
    [
        ("system", "x", None, None, ""), ("user", None, None, None, ""), ("user", 'say "hi"\n', None, None, {"content": 'say "hi"\n'}), ("user", '{"a": 1}', None, None, '{"a": 1}'), ("user", ' {"type": "heartbeat", "n": 1}', None, None, ""),
        ("user", "{type: heartbeat", None, None, {"content": "{type: heartbeat"}), ("tool", '{"a": 1}', "run", None, {"content": '{"a": 1}'}), ("tool", "ok", "send_message", None, ""), ("tool", "ok", "conversation_search", None, ""),
        ("assistant", "hm", None, [("send_message", '{"message": "é\\"x"}')], {"thinking": "hm", "content": 'é"x'}), ("assistant", "hm", None, [("send_message", "{}")], {"thinking": "hm", "content": ""}),
        ("assistant", "hm", None, [("send_message", "no json")], {"content": "hm"}), ("assistant", "hm", None, [("run", "{}"), ("conversation_search", "{}")], ""), ("assistant", "[1]", None, [("run", "{}")], "[1]"), ("assistant", "", None, None, {"content": ""}),
    ],
)
def test_searchable_messages(spark, role, text, name, calls, want):
    row = spark.createDataFrame([(role, text, name, calls)], f"role string, text string, name string, calls {CALL}")
    got = row.select(T.searchable_message(*map(F.col, ("role", "text", "name", "calls"))).alias("x")).first().x
    assert json.loads(got) == want if isinstance(want, dict) else got == want


def test_transcripts(spark):
    rows = [
        ("user", " hi \n", 0, None, None), ("system", "rules", 0, None, None), ("user", "look", 1, None, None), ("user", None, 3, None, None), ("assistant", None, 0, None, [("send_message", '{"message": "yo"}'), ("run", '{"a": 1}')]),
        ("tool", "sent", 0, "send_message", None), ("tool", "done", 0, "run", None), ("assistant", None, 0, None, None), ("assistant", None, 0, None, [("send_message", "broken")]), ("assistant", "", 0, None, [("run", "{}")]),
    ]
    df = spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], f"trajectory_id string, sequence_id int, role string, text string, images int, name string, calls {CALL}")
    want = ["user: hi", "user: look [Image omitted]", "user: [3 images omitted]", 'assistant: yo {"a": 1}', "tool: done", "assistant: broken", "assistant: "]
    assert T.transcript(df).first().transcript.split("\n") == want
    assert T.transcript(df, include_system=True).first().transcript.split("\n")[1] == "system: rules"


def test_file_views(spark):
    text = F.lit("  a\n\n\tb 1\r\n   \nc0\n")
    lines = T.lines_of(text)
    assert one(spark, lines) == ["a", "b 1", "c0"] or one(spark, lines) == ["a", "\tb 1", "c0"]
    view = lambda **k: one(spark, T.file_view(F.array(*[F.lit(x) for x in ("a", "b", "c")]), **k))
    assert view().lines == ["[Viewing file start (out of 3 lines)]", "1: a", "2: b", "3: c"]
    assert view(start=1, end=9).lines == ["[Viewing lines 2 to 3 (out of 3 lines)]", "2: b", "3: c"]
    assert view(start=2, kind="sentences").lines == ["[Viewing sentences 3 to end (out of 3 sentences)]", "3: c"]
    assert view(start=1, end=2, header=False).lines == ["2: b"]
    assert view(start=3).lines is None and view(start=3).error == "only 3 lines, but requested offset 4 is out of range"


def test_tool_texts(spark):
    schema = json.dumps({"description": "other", "parameters": {"properties": {"z": {"description": "last", "type": "int"}, "a": {}, "m": {"description": ""}}}})
    got = json.loads(one(spark, T.tool_text(F.lit("run"), F.lit("does"), F.lit(schema), F.array(F.lit("t")))))
    assert got == {"name": "run", "description": "does", "schema_description": "other", "parameters": ["z (int): last", "a (any)", "m (any)"], "tags": ["t"]}
    none = F.lit(None).cast("string")
    assert json.loads(one(spark, T.tool_text(none, none, F.lit('{"description": ""}')))) == {"name": "", "description": ""}


def test_redacted_contents(spark):
    def made(kind, text, tool, data):
        s = lambda x: F.lit(x).cast("string")
        r = one(spark, P.redact_message(s(kind), s(text), s(tool), F.lit(data)))
        return r.text, r.data and json.loads(r.data)

    assert made("tool_call", "secret", "run", True) == (None, {"tool_call": {"name": "run", "arguments": "[REDACTED]"}})
    assert made("tool_call", "secret", None, True) == (None, {"type": "redacted"}) and made("tool_call", "secret", None, False) == ("[REDACTED]", None)
    assert made("tool_response", "secret", None, False) == (None, {"type": "tool_response", "content": "[REDACTED]"})
    assert made("text", "secret", None, True) == ("[REDACTED]", {"type": "redacted"}) and made("text", "", None, False) == (None, None)


def test_open_files_make_room(spark):
    files = spark.createDataFrame([("a", f"f{i}", i != 4, i) for i in range(6)], "agent_id string, file_id string, is_open boolean, last_accessed_at int")
    opened = spark.createDataFrame([("a", "f4")], "agent_id string, file_id string")
    got = {r.file_id: (r.stays, r.closed) for r in W.evict_open_files(files, 3, opened).collect()}
    assert {f for f, (stays, _) in got.items() if stays} == {"f4", "f5", "f3"} and {f for f, (_, closed) in got.items() if closed} == {"f0", "f1", "f2"}
    again = {r.file_id for r in W.evict_open_files(files, 3, opened.withColumn("file_id", F.lit("f0"))).collect() if r.stays}
    assert again == {"f0", "f5", "f3"}  # a file that is open already keeps its slot


def test_visible_content(spark):
    long = "x" * 300
    got = one(spark, W.visible_content(F.lit(long), F.lit(True), 200))
    assert len(got) == 200 and got == "x" * (200 - len(W.TRUNCATED)) + W.TRUNCATED
    assert one(spark, W.visible_content(F.lit(long), F.lit(False), 200)) == "" and one(spark, W.visible_content(F.lit("ab"), F.lit(True), 200)) == "ab"


@pytest.mark.parametrize(
    "page,want",
    [
        ("# A *b*\n\ntext", "A b\n\ntext"), ("```py\n# x *y*\n~~~\n| a |\n```\nz", "# x *y*\n~~~\n| a |\nz"), ("~~~~\na\n~~~\n~~~~\nb", "a\n~~~\nb"), ("- one\n  * two\n3. three\n- [x] done", "one\n  two\nthree\ndone"),
        ("| a | b |\n|:--|--:|\n| 1 | x \\| y |", "a\tb\n1\tx | y"), ("see [the *page*](http://x \"t\") and ![pic](p.png) <https://a.b>", "see the page and pic https://a.b"), ("> > quoted `code_x`", "quoted code_x"), ("***\n---\ntext\n===", "text"),
        ("snake_case_name and 2 * 3 * 4", "snake_case_name and 2 * 3 * 4"), ("**bold** _it_ ~~gone~~ \\*kept\\*", "bold it gone *kept*"), ("```\nopen to the end\n# x", "open to the end\n# x"), ("", ""),
    ],
)
def test_markdown(spark, page, want):
    assert one(spark, T.markdown_text(F.lit(page))) == want


def test_passages_by_cosine(spark):
    rows = spark.createDataFrame([("a", 1, "x", ["t"], [1.0, 0.0]), ("b", 2, "x", ["t"], [0.0, 1.0]), ("c", 3, "x", [], [1.0, 1.0]), ("d", 4, "x", ["t"], None), ("e", 5, "x", ["t"], [2.0, 0.0])], "passage_id string, created_at int, text string, tags array<string>, embedding array<double>")
    assert [r.passage_id for r in S.passages_page(rows, 3, near=[1.0, 0.1]).collect()] == ["a", "e", "c"]
    assert [r.passage_id for r in S.passages_page(rows, 2, near=[1.0, 0.1], ascending=False).collect()] == ["e", "a"]
