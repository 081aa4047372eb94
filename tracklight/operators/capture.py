"""Capture: runs, steps and messages become nested trajectories, and nested trajectories their analytic form.

Steps and messages are grouped before they are joined to runs, so a run meets one row of each.  All nesting is
``collect_list`` of structs that begin with the sort key, sorted once per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import expressions as X

TEXT_BLOCKS = "array<struct<type:string,text:string>>"


def content_blocks(content: Column) -> Column:
    """A JSON list of blocks, or plain text, as an array of (type, text)."""
    return F.coalesce(F.from_json(content, TEXT_BLOCKS), F.when(content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))))


def first_text(blocks: Column) -> Column:
    return F.get(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), 0)["text"]


def joined_text(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def run_parts(steps: DataFrame, messages: DataFrame) -> DataFrame:
    """What steps and messages say of each run: step sums and models, message counts and tools, and ``turns``, each step with
    its messages in order, ``[]`` for steps without any; messages without a step are in no turn.

    Steps and messages are dealt by run once, together, and grouped in place: by step, then by run.
    """
    strings = F.array().cast("array<string>")
    said = messages.select("run_id", "step_no", F.struct(F.col("seq").cast("bigint").alias("seq"), "message_id", "role", "text").alias("m"), F.coalesce("tools", strings).alias("tools"))
    done = steps.select("run_id", "step_no", F.struct("model", "prompt_tokens", "completion_tokens").alias("s"))
    dealt = said.unionByName(done, allowMissingColumns=True).where("run_id is not null").repartition("run_id")
    mine = F.when(F.col("step_no").isNotNull(), F.array_sort(F.collect_list("m"))).otherwise(F.array().cast(T.ArrayType(said.schema["m"].dataType)))
    by_step = dealt.groupBy("run_id", "step_no").agg(
        F.collect_list("s").alias("steps"), mine.alias("messages"), F.count("s").alias("n_steps"), F.count("m").alias("n_messages"), F.count_if(F.col("m.role") == "user").alias("users"),
        F.count_if(F.size("tools") > 0).alias("with_tools"), F.array_distinct(F.flatten(F.collect_list("tools"))).alias("tools"),
        F.sum(F.coalesce("s.prompt_tokens", F.lit(0))).alias("input"), F.sum(F.coalesce("s.completion_tokens", F.lit(0))).alias("output"), F.collect_set("s.model").alias("models"),
    )
    turn = lambda s: F.struct("step_no", s["model"].alias("model"), s["prompt_tokens"].alias("input_tokens"), s["completion_tokens"].alias("output_tokens"), "messages")
    every = lambda c: F.flatten(F.collect_list(c))
    turns = F.array_sort(every(F.transform("steps", turn)))
    return by_step.groupBy("run_id").agg(
        F.sum("n_steps").alias("step_count"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.array_sort(F.array_distinct(every("models"))).alias("models"),
        F.sum("n_messages").alias("message_count"), F.sum("users").alias("user_messages"), F.sum("with_tools").alias("tool_messages"), F.array_sort(F.array_distinct(every("tools"))).alias("tools_used"),
        F.when(F.sum("n_steps") > 0, turns).alias("turns"),
    )


# The reasons that an outcome states.
REASONS = {
    "completed": "Run completed without errors", "end_turn": "Agent naturally ended turn", "max_tokens": "Hit token limit (may be incomplete)", "failed": "Run failed with error", "error": "Error: %s",
    "cancelled": "Run was cancelled", "busy": "High user engagement (%d user messages)", "tools": "Used %d tool calls",
}


def outcome(status: Column, stop_reason: Column, user_messages: Column, tool_messages: Column, error: Column | None = None) -> Column:
    """Execution status, confidence, reasons and the older type word, by rules on status and stop reason.

    More than three user messages raise the confidence of completed runs only; ``error`` is what a failed run recorded.
    """
    done, ended, full = status == "completed", stop_reason.eqNullSafe("end_turn"), stop_reason.eqNullSafe("max_tokens")
    users, tools = F.coalesce(user_messages, F.lit(0)), F.coalesce(tool_messages, F.lit(0))
    name = F.when(done & full, "incomplete").when(done, "completed").when(status.isin("failed", "cancelled"), "failed").otherwise("unknown")
    base = F.when(done & ended, 0.8).when(done & full, 0.5).when(done, 0.7).when(status == "failed", 0.9).when(status == "cancelled", 0.8).otherwise(0.5)
    busy = (name == "completed") & (users > 3)
    confidence = F.least(F.lit(1.0), base + F.when(busy, 0.1).otherwise(0.0))
    said = F.lit(None).cast("string") if error is None else error
    reasons = F.array_compact(F.array(
        F.when(done, REASONS["completed"]), F.when(done & ended, REASONS["end_turn"]), F.when(done & full, REASONS["max_tokens"]), F.when(status == "failed", REASONS["failed"]),
        F.when((status == "failed") & said.isNotNull(), F.format_string(REASONS["error"], said)), F.when(status == "cancelled", REASONS["cancelled"]),
        F.when(busy, F.format_string(REASONS["busy"], users)), F.when(tools > 0, F.format_string(REASONS["tools"], tools)),
    ))
    kind = F.when(name == "completed", "success").when(name == "incomplete", "partial_success").when(name == "failed", "failure").otherwise("unknown")
    return F.struct(name.alias("status"), F.round(confidence, 6).alias("confidence"), reasons.alias("reasoning"), kind.alias("type"))


def build_trajectories(runs: DataFrame, steps: DataFrame, messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One nested trajectory for each run: run_id, metadata, turns, outcome, and the columns of ``runs`` to ``keep``.

    runs: run_id, agent_id, status, stop_reason, created_at, completed_at (and error, if known).  steps: run_id, step_no, model,
    prompt_tokens, completion_tokens.  messages: run_id, step_no, seq, message_id, role, text, tools.
    """
    whole = runs.join(run_parts(steps, messages), "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    strings = F.array().cast("array<string>")
    ns = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) * 1000
    meta = F.struct(
        F.col("created_at").alias("start_time"), F.col("completed_at").alias("end_time"), ns.alias("duration_ns"), "status", "stop_reason", zero("step_count").alias("step_count"), zero("message_count").alias("message_count"),
        F.coalesce("tools_used", strings).alias("tools_used"), zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), (zero("input_tokens") + zero("output_tokens")).alias("total_tokens"), F.coalesce("models", strings).alias("models"),
    )
    return whole.select("run_id", "agent_id", meta.alias("metadata"), "turns", outcome(F.col("status"), F.col("stop_reason"), F.col("user_messages"), F.col("tool_messages"), F.col("error") if "error" in runs.columns else None).alias("outcome"), *keep)


def to_analytic(trajectories: DataFrame) -> DataFrame:
    """The analytic form: known roles, turn timestamps by order, task description, system message, outcome word."""
    known = ("system", "user", "assistant", "tool")
    message = lambda m: F.struct(F.when(m["role"].isin(*known), m["role"]).otherwise("assistant").alias("role"), m["text"].alias("text"), m["message_id"].alias("message_id"))
    turn = lambda t, i: F.struct(i.alias("turn_id"), t["step_no"].alias("span"), F.transform(t["messages"], message).alias("messages"))
    out = trajectories.withColumn("turns", F.transform("turns", turn))
    return out.withColumns({"task": task_description(F.lit(None).cast("string"), F.col("turns")), "system_message": system_message(F.col("turns")), "result": X.outcome_map(F.col("outcome.type"))})


def task_description(summary: Column, turns: Column, cut: int = 500) -> Column:
    """The summary, else the first non-empty user text, cut, else ``Unknown task``."""
    users = F.filter(F.flatten(F.transform(turns, lambda t: t["messages"])), lambda m: (m["role"] == "user") & (F.trim(m["text"]) != ""))
    return F.coalesce(summary, F.substring(F.get(users, 0)["text"], 1, cut), F.lit("Unknown task"))


def system_message(turns: Column) -> Column:
    """The system text of the first turn."""
    return F.get(F.filter(F.get(turns, 0)["messages"], lambda m: m["role"] == "system"), 0)["text"]


def context_resources(calls: DataFrame, uri: Column) -> DataFrame:
    """(trajectory_id, resources): distinct uris of a trajectory's calls in first-seen order."""
    rows = calls.select("trajectory_id", "ts", "event_id", uri.alias("uri")).where("uri is not null")
    nth = F.row_number().over(Window.partitionBy("trajectory_id", "uri").orderBy("ts", "event_id"))
    once = rows.withColumn("nth", nth).where("nth = 1")
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "uri")))
    return once.groupBy("trajectory_id").agg(F.transform(listed, lambda r: r["uri"]).alias("resources"))


def fallback_summary(request: Column, completed: Column, feedback: Column, size: Column) -> Column:
    """Request, status and feedback, those that are known; without any, the size of the trace in bytes."""
    status = F.when(completed, "Completed").when(~completed, "Abandoned")
    known = X.labelled([("User request", request), ("Status", status), ("Feedback", feedback)])
    return F.when(known != "", known).otherwise(F.format_string("Agent execution trace with %d bytes", size))


# Words of feedback that raise, or else lower, the fallback score, and the reasons given for it.
PRAISE, COMPLAINT = ("good", "great", "loved", "excellent", "perfect"), ("bad", "poor", "didn't", "not")
DONE, NOT_DONE, LIKED, DISLIKED, NOTHING = "Task completed", "Task not completed", "Positive user feedback", "Negative user feedback", "no clear signals"


def fallback_score(outcome: Column) -> Column:
    """(score, reasoning) of an outcome (completed, feedback): 0.5, 0.2 up or down for its end (unknown counts as not
    completed), 0.2 up for praise or else down for a complaint; 0.5 for a null outcome."""
    known, done, low = outcome.isNotNull(), F.coalesce(outcome["completed"], F.lit(False)), F.lower(F.coalesce(outcome["feedback"], F.lit("")))
    praise, complaint = low.rlike("|".join(PRAISE)), low.rlike("|".join(COMPLAINT))
    ended = F.when(~known, 0.0).when(done, 0.2).otherwise(-0.2)
    said = F.when(~known, 0.0).when(praise, 0.2).when(complaint, -0.2).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(known & done, DONE).when(known, NOT_DONE), F.when(known & praise, LIKED).when(known & complaint, DISLIKED)))
    why = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(NOTHING)
    return F.struct(F.round(X.clamp(0.5 + ended + said), 6).alias("score"), F.concat(F.lit("Heuristic score based on: "), why).alias("reasoning"))


def fallback_labels(turns: Column, tools: Column, messages: Column) -> Column:
    """Complexity by turns, and tags by tools and length."""
    level = F.when(turns <= 2, "simple").when(turns >= 10, "complex").otherwise("moderate")
    tags = F.array_compact(F.array(F.when(tools > 0, "tool_usage"), F.when(messages > 10, "extended_interaction")))
    return F.struct(level.alias("complexity"), F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("general"))).alias("tags"))


# Complexity levels that an enrichment may give.
LEVELS = ("trivial", "simple", "moderate", "complex", "expert")


def enrich(rows: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], fallback: dict[str, Column]) -> DataFrame:
    """Summary, score and complexity from a provider (an Arrow batch at a time), validated; ``fallback`` fills the rest."""
    schema = T.StructType([*rows.schema.fields, T.StructField("p_summary", T.StringType()), T.StructField("p_score", T.DoubleType()), T.StructField("p_level", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = provider(batch)
            yield batch.assign(p_summary=got["summary"].to_numpy(), p_score=got["score"].to_numpy(), p_level=got["level"].to_numpy())

    made = rows.mapInPandas(run, schema)
    return made.select(
        *rows.columns, F.coalesce("p_summary", fallback["summary"]).alias("summary"), F.coalesce(F.when(~F.isnan("p_score"), X.clamp("p_score")), fallback["score"]).alias("score"),
        F.when(F.col("p_level").isin(*LEVELS), F.col("p_level")).otherwise(fallback["level"]).alias("level"),
    )


def judged(response: Column, ddl: str, required: Sequence[str], fallback: Column) -> Column:
    """A judge's JSON answer (code fences and talk around it are ignored); the fallback unless all required fields are there."""
    parsed = F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), ddl)
    ok = parsed.isNotNull()
    for f in required:
        ok = ok & parsed[f].isNotNull()
    return F.when(ok, parsed).otherwise(fallback)


def typed_events(messages: DataFrame, send_tool: str = "send_message", types: Sequence[str] | None = None) -> DataFrame:
    """Messages as typed events: reasoning, tool_call, tool_return, assistant, user, system, approval_request and
    approval_response; only some ``types`` of them, if given.

    messages: trajectory_id, sequence_id, role, text, reasoning, call_id, tool, and approved (true, false or null), if there
    are approvals.  A call of ``send_tool`` is an assistant text, and its tool return is dropped.  A message of role approval
    asks for its tool, or answers with approve or deny.
    """
    approved = F.col("approved") if "approved" in messages.columns else F.lit(None).cast("boolean")
    sent = messages.where((F.col("role") == "assistant") & (F.col("tool") == send_tool)).select("trajectory_id", "call_id")
    rest = messages.join(sent.withColumn("__sent", F.lit(True)), ["trajectory_id", "call_id"], "left").where(~((F.col("role") == "tool") & F.coalesce("__sent", F.lit(False))))
    role = F.col("role")
    event = lambda test, kind: F.when(test, F.struct(F.lit(kind).alias("event"), F.col("text").alias("body")))
    kinds = F.array_compact(F.array(
        F.when(F.col("reasoning").isNotNull(), F.struct(F.lit("reasoning").alias("event"), F.col("reasoning").alias("body"))),
        event((role == "assistant") & F.col("tool").isNotNull() & (F.col("tool") != send_tool), "tool_call"), event((role == "assistant") & (F.col("tool").isNull() | (F.col("tool") == send_tool)), "assistant"),
        event(role == "tool", "tool_return"), event(role == "user", "user"), event(role == "system", "system"),
        F.when((role == "approval") & approved.isNull() & F.col("tool").isNotNull(), F.struct(F.lit("approval_request").alias("event"), F.col("tool").alias("body"))),
        F.when((role == "approval") & approved.isNotNull(), F.struct(F.lit("approval_response").alias("event"), F.when(approved, "approve").otherwise("deny").alias("body"))),
    ))
    out = rest.select("trajectory_id", "sequence_id", F.posexplode(kinds).alias("part", "e")).select("trajectory_id", "sequence_id", "part", "e.*")
    return out if types is None else out.where(F.col("event").isin(*types))
