"""Anonymisation: salted hashes, summaries, and nested rewrites that a policy turns into column expressions.

A policy says which field names are ids (hashed), which hold content (summarised or redacted) and which are kept.
``anonymise`` walks the schema once at planning time and builds one nested expression; no data reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X


@dataclass(frozen=True)
class Policy:
    """Field names to hash, to redact and to keep; ``summarise`` keeps a first sentence instead of ``[REDACTED]``."""

    salt: str = ""
    ids: frozenset[str] = frozenset({"trajectory_id", "agent_id", "organization_id", "message_id", "call_id", "decision_id", "user_id", "id", "tool_call_id", "run_id"})
    content: frozenset[str] = frozenset({"text", "content", "response_text", "arguments", "reasoning", "rationale", "searchable_summary"})
    kept: frozenset[str] = field(default_factory=frozenset)
    summarise: bool = False
    cut: int = 100


#: Keeps what learning needs: reasons and summaries are shortened, not removed.
LEARNING = Policy(summarise=True, kept=frozenset({"rationale"}))


def rewrite(value: Column, kind: T.DataType, name: str, policy: Policy) -> Column:
    """``value`` as the policy wants it, through structs, arrays and maps."""
    if name in policy.kept:
        return value
    if isinstance(kind, T.StructType):
        made = F.struct(*[rewrite(value[f.name], f.dataType, f.name, policy).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rewrite(x, kind.elementType, name, policy))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: rewrite(v, kind.valueType, name, policy) if name not in policy.content else F.lit("[REDACTED]").cast(kind.valueType))
    if isinstance(kind, T.StringType):
        if name in policy.ids:
            return X.hash_identifier(value, policy.salt)
        if name in policy.content:
            return X.first_sentence(value, policy.cut) if policy.summarise else F.when(value.isNotNull(), "[REDACTED]")
    return value


def anonymise(df: DataFrame, policy: Policy | None = None) -> DataFrame:
    """All columns rewritten; numbers, flags, times and names outside the policy stay."""
    p = policy or Policy()
    return df.select(*[rewrite(F.col(f.name), f.dataType, f.name, p).alias(f.name) for f in df.schema.fields])


def redact_message(kind: Column, text: Column, tool: Column, has_data: Column, policy: Policy | None = None) -> Column:
    """Message content (type, text, data) by type: a tool call keeps its tool's name, a response that it is one; other texts
    are redacted (or cut to their first sentence, if the policy summarises), other data replaced.  ``data`` is JSON;
    ``has_data`` says whether the content had some, ``tool`` is the name of the call in it, null if there is no call."""
    p = policy or Policy()
    # What stands for names, arguments, contents and data.
    called = F.concat(F.lit('{"tool_call": {"name": "'), F.coalesce(F.nullif(tool, F.lit("")), F.lit("[UNKNOWN]")), F.lit('", "arguments": "[REDACTED]"}}'))
    gone, returned = F.lit('{"type": "redacted"}'), F.lit('{"type": "tool_response", "content": "[REDACTED]"}')
    call, response = (kind == "tool_call") & has_data, kind == "tool_response"
    plain = X.first_sentence(text, p.cut) if p.summarise else F.lit("[REDACTED]")
    data = F.when(call, F.when(tool.isNotNull(), called).otherwise(gone)).when(response, returned).when(has_data, gone)
    return F.struct(kind.alias("type"), F.when(~call & ~response & (text != ""), plain).alias("text"), data.alias("data"))


def redact_decisions(decisions: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Decisions with action, success, error type, confidence and credit kept; ids hashed, arguments and results gone."""
    return anonymise(decisions, policy or Policy())


def structural_view(trajectories: DataFrame, organization_id: str, salt: str = "") -> DataFrame:
    """What an organisation sees of shared trajectories: its own as they are; of others the summary, score, tags, measures and
    outcome, with ids hashed and every message redacted.

    Columns of the result: those of the input but ``organization_id``, and ``visibility`` and ``source_organization_hash``.
    ``turns`` (step_no, model, input_tokens, output_tokens, messages with tools) become (model, input_tokens, output_tokens,
    message_count, tool_calls_count, messages as one word).
    """
    own = F.col("organization_id") == organization_id
    hidden = lambda c: F.when(own, F.col(c)).otherwise(X.redacted(c, salt)).alias(c)
    said = lambda t: F.transform(t["messages"], lambda m: F.concat_ws(": ", m["role"], m["text"]))
    called = lambda t: F.aggregate(t["messages"], F.lit(0), lambda n, m: n + F.greatest(F.lit(0), F.size(F.coalesce(m["tools"], F.array().cast("array<string>")))))
    turn = lambda t: F.struct(t["model"].alias("model"), t["input_tokens"].alias("input_tokens"), t["output_tokens"].alias("output_tokens"), F.size(t["messages"]).alias("message_count"), called(t).alias("tool_calls_count"), F.when(own, F.array_join(said(t), "\n")).otherwise("[REDACTED]").alias("messages"))
    special = {"trajectory_id": hidden, "agent_id": hidden, "turns": lambda c: F.transform(c, turn).alias(c)}
    kept = [special.get(c, F.col)(c) for c in trajectories.columns if c != "organization_id"]
    return trajectories.select(*kept, F.when(own, "own").otherwise("shared").alias("visibility"), X.redacted("organization_id", salt).alias("source_organization_hash"))


def set_sharing(trajectories: DataFrame, ids: DataFrame, shared: bool) -> DataFrame:
    """The sharing flag set for the given ids."""
    marked = trajectories.join(ids.select("trajectory_id").distinct().withColumn("__hit", F.lit(True)), "trajectory_id", "left")
    return marked.withColumn("share_cross_org", F.when(F.col("__hit"), F.lit(shared)).otherwise(F.col("share_cross_org"))).drop("__hit")
