"""Order-dependent work inside an agent, conversation or file: windows partitioned by the owner."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import expressions as X
from .listing import ranked
from .text import SEND, json_text, searchable_message


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Position from 0 in the order, within the keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def backfill_call_ids(messages: DataFrame) -> DataFrame:
    """Missing ``tool_call_id`` of tool messages: the call of the last assistant message with exactly one call, unless a
    tool message came between.  Messages: conversation, seq, role, calls (ids), tool_call_id."""
    before = Window.partitionBy("conversation").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    single = F.when((F.col("role") == "assistant") & (F.size("calls") == 1), F.struct(F.element_at("calls", 1).alias("id")))
    marker = F.when(F.col("role") == "assistant", F.coalesce(single, F.struct(F.lit(None).cast("string").alias("id")))).when(F.col("role") == "tool", F.struct(F.lit(None).cast("string").alias("id")))
    last = F.last(marker, ignorenulls=True).over(before)
    return messages.withColumn("tool_call_id", F.when(F.col("role") == "tool", F.coalesce("tool_call_id", last["id"])).otherwise(F.col("tool_call_id")))


def shown_value(value: Column) -> Column:
    """A JSON value (variant) of a call's argument as text: quoted strings, True, False and None; numbers, lists and objects
    as JSON."""
    kind, raw = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    quoted = lambda q: F.concat(F.lit(q), F.replace(F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("'") if q == "'" else F.lit("\0"), F.lit("\\'") if q == "'" else F.lit("\0")), F.lit(q))
    double = raw.contains("'") & ~raw.contains('"')
    return F.when(kind == "STRING", F.when(double, quoted('"')).otherwise(quoted("'"))).when(kind == "BOOLEAN", F.initcap(raw)).when(kind == "VOID", "None").otherwise(F.to_json(value))


def call_text(name: Column, arguments: Column) -> Column:
    """``name(key=value, ...)`` of a tool call; without its arguments where they are no JSON object."""
    pairs = F.map_entries(F.from_json(F.when(F.try_parse_json(arguments).isNotNull(), arguments), "map<string,variant>"))
    shown = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), shown_value(e["value"]))), ", ")
    return F.concat(name, F.lit("("), F.coalesce(shown, F.lit("")), F.lit(")"))


def result_text(text: Column) -> Column:
    """A tool's result in short: the message or else the status of a JSON object, all else as it is."""
    is_object = F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull()
    message, status = F.get_json_object(text, "$.message"), F.get_json_object(text, "$.status")
    return F.when(is_object & message.isNotNull(), message).when(is_object & status.isNotNull(), F.concat(F.lit("Status: "), status)).otherwise(text)


def combine_with_response(messages: DataFrame) -> DataFrame:
    """(conversation, seq, role, text): messages as search stores them, each assistant call together with the next message,
    if that answers one of its calls.

    Columns: conversation, seq, role, text, name (of a return), calls (id, name, arguments), tool_call_id.  Messages that search
    skips are left out.  A call and its return become thinking, call and result; a return of ``SEND`` adds nothing to the
    assistant's text.
    """
    w = Window.partitionBy("conversation").orderBy("seq")
    plain = F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    found = messages.withColumn("__text", searchable_message(F.col("role"), F.col("text"), F.col("name"), plain))
    matching = lambda calls, wanted: F.get(F.filter(calls, lambda c: c["id"] == wanted), 0)
    seen = found.withColumns({"__next": F.lead(F.struct("role", "tool_call_id", "name", "text")).over(w), "__prev": F.lag(F.struct("role", "calls", "__text")).over(w)})
    call = matching(F.col("calls"), F.col("__next.tool_call_id"))
    answered = (F.col("role") == "assistant") & (F.col("__text") != "") & F.coalesce(F.col("__next.role") == "tool", F.lit(False)) & call.isNotNull()
    before = matching(F.col("__prev.calls"), F.col("tool_call_id"))
    consumed = (F.col("role") == "tool") & F.coalesce(F.col("__prev.role") == "assistant", F.lit(False)) & F.coalesce(F.col("__prev.__text") != "", F.lit(False)) & before.isNotNull()
    thinking = F.coalesce("text", F.lit(""))
    whole = F.concat(F.lit('{"thinking": '), json_text(thinking), F.lit(', "tool_call": '), json_text(call_text(call["name"], call["arguments"])), F.lit(', "tool_result": '), json_text(result_text(F.coalesce("__next.text", F.lit("")))), F.lit("}"))
    text = F.when(answered, F.when(F.col("__next.name").eqNullSafe(SEND), thinking).otherwise(whole)).otherwise(F.col("__text"))
    return seen.where(~consumed & (F.col("__text") != "")).select("conversation", "seq", "role", text.alias("text"))


# Fixed value: what a file's view ends with where it is cut.
TRUNCATED = "...[TRUNCATED]\n# NOTE: This block is truncated, use functions to view the full content."


def visible_content(text: Column, is_open: Column, limit: int) -> Column:
    """What an agent sees of a file: nothing of a closed one; a longer text is cut so that it and the warning after it
    have ``limit`` characters."""
    shown = F.when(is_open, F.coalesce(text, F.lit(""))).otherwise("")
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, max(0, limit - len(TRUNCATED))), F.lit(TRUNCATED))).otherwise(shown)


def evict_open_files(files: DataFrame, limit: int, opened: DataFrame | None = None) -> DataFrame:
    """Files with ``stays``: the most recently used ``limit`` open files of each agent.

    ``opened`` (agent_id, file_id; one for an agent) are files that are being opened: each is open from now on and has a
    slot of its own, so that ``limit - 1`` others stay; ``closed`` tells which open files lost theirs.
    """
    rows = files.withColumn("__new", F.lit(False)) if opened is None else files.join(opened.select("agent_id", "file_id", F.lit(True).alias("__new")).hint("merge"), ["agent_id", "file_id"], "left").withColumn("__new", F.coalesce("__new", F.lit(False)))
    open_ = rows.withColumn("__open", F.col("is_open") | F.col("__new"))
    rank = F.row_number().over(Window.partitionBy("agent_id", "__open").orderBy(F.desc("__new"), F.desc("last_accessed_at"), "file_id"))
    out = open_.withColumn("stays", F.col("__open") & (rank <= limit))
    return out.withColumn("closed", F.col("is_open") & ~F.col("stays")).drop("__new", "__open")


def block_versions(events: DataFrame) -> DataFrame:
    """A block's history from its log (block_id, at, kind, value): for each event the sequence that the block is at, its
    value there and how many checkpoints exist.

    A checkpoint drops those after the current one and adds one; undo and redo move to the next one before or after, and do
    nothing where there is none.  Blocks are hashed to tasks, sorted there and folded in passing: a task holds one block's
    checkpoints at a time.
    """
    schema = T.StructType([events.schema["block_id"], events.schema["at"], T.StructField("sequence", T.LongType()), events.schema["value"], T.StructField("checkpoints", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, values = None, 0, []
        for batch in batches:
            out = []
            for b, when, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, at, values = b, 0, []
                if kind == "checkpoint":
                    del values[at:]
                    values.append(value)
                    at += 1
                elif kind == "undo":
                    at = max(at - 1, min(at, 1))
                elif kind == "redo":
                    at = min(at + 1, len(values))
                out.append((b, when, at, values[at - 1] if at else None, len(values)))
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), batch.schema.field(3).type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=schema.names)

    return events.select("block_id", "at", "kind", "value").repartition("block_id").sortWithinPartitions("block_id", "at").mapInArrow(fold, schema)


def unique_names(files: DataFrame, keys: Sequence[str] = ("source_id",), limit: int = 255, live: str | None = "is_deleted") -> DataFrame:
    """``source/name.ext``, or ``source/name_(k).ext`` where k earlier files of the source (by file_id, without deleted
    ones) have the same name.  Bases are cut first, so that the name and six more characters fit ``limit``."""
    base, ext = X.split_extension(F.col("file_name"))
    short = F.substring(base, F.lit(1), F.lit(limit - 6) - F.length(ext))
    named = files.withColumns({"__base": short, "__ext": ext})
    w = Window.partitionBy(*keys, "__base", "__ext").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    k = F.coalesce(F.sum(F.lit(1) if live is None else (~F.col(live)).cast("int")).over(w), F.lit(0))
    suffix = F.when(k > 0, F.concat(F.lit("_("), k.cast("string"), F.lit(")"))).otherwise("")
    return named.withColumn("unique_name", F.concat("source_name", F.lit("/"), "__base", suffix, "__ext")).drop("__base", "__ext")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def tiers(df: DataFrame, score: str, order: Sequence[Column], k: int, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """The best k rows of the success, failure and moderate tiers."""
    s = F.col(score)
    tier = F.when(s >= high, "success").when(s <= low, "failure").otherwise("moderate")
    return top_per(df.where(s.isNotNull()).withColumn("tier", tier), ["tier"], order, k)


def concurrency(calls: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """Running calls after each start or end, per group; ends count before starts at one instant.

    Starts and ends are first counted by instant; the running sum over these goes range by range (see ``ranked``), so a
    group may be many tasks.
    """
    steps = calls.select(by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(by, "e.*")
    at = steps.groupBy(by, "at").agg(F.sum("d").alias("__d"), F.sum(F.greatest("d", F.lit(0))).alias("__begun"))
    summed = ranked(at, "at", [by], "__d").select(F.col(by).alias("__by"), F.col("at").alias("__at"), "__upto", "__begun")
    met = steps.join(summed.hint("merge"), steps[by].eqNullSafe(summed["__by"]) & (steps["at"] == summed["__at"]))
    return met.select(by, "at", "d", (F.col("__upto") - F.when(F.col("d") < 0, F.col("__begun")).otherwise(0)).alias("running"))


def clean_conversation(messages: DataFrame) -> DataFrame:
    """Messages as a model may see them.  Columns: conversation, seq, role, text, calls (ids), call_id (of tool returns),
    is_summary, approved (of approval responses).

    Out go an approval request that a summary follows (with a response or nothing after it), a last lone approval request
    and the call before it, and a last assistant message without text and calls.  A call and the approval request after it
    become one; tool returns of one call are kept once, as are repeated calls of a message.
    """
    order, whole = Window.partitionBy("conversation").orderBy("seq"), Window.partitionBy("conversation")
    asks, calls = (F.col("role") == "approval") & (F.size("calls") > 0), (F.col("role") == "assistant") & (F.size("calls") > 0)
    nothing = F.array().cast("array<string>")
    flat = messages.withColumn("calls", F.coalesce("calls", nothing))
    after, then = F.lead("is_summary", 1, False).over(order), F.lead(F.struct("seq", F.col("approved").isNotNull().alias("answers")), 2).over(order)
    cut_off = flat.withColumn("__drop", asks & after & (then.isNull() | then["answers"])).where("not __drop")
    last, before = F.row_number().over(Window.partitionBy("conversation").orderBy(F.desc("seq"))), F.lead(F.struct(asks.alias("asks"))).over(order)["asks"]
    ends = cut_off.withColumns({"__r": last, "__next": F.coalesce(before, F.lit(False))})
    open_ = ends.where(~(((F.col("__r") == 1) & asks) | ((F.col("__r") == 2) & F.col("__next") & calls)))
    lone = (F.col("role") == "assistant") & (F.size("calls") == 0) & (F.coalesce(F.col("text"), F.lit("")) == "")
    said = open_.withColumn("__last", F.max("seq").over(whole)).where(~((F.col("seq") == F.col("__last")) & lone))
    next_, prev = F.lead(F.struct(asks.alias("asks"), "text", "calls")).over(order), F.lag(calls).over(order)
    met = said.withColumns({"__n": next_, "__p": F.coalesce(prev, F.lit(False))}).withColumn("__join", calls & F.coalesce(F.col("__n.asks"), F.lit(False)))
    one = met.where(~(asks & F.col("__p"))).withColumns({
        "text": F.when(F.col("__join"), F.concat(F.coalesce("text", F.lit("")), F.coalesce("__n.text", F.lit("")))).otherwise(F.col("text")),
        "calls": F.when(F.col("role") == "assistant", F.array_distinct(F.when(F.col("__join"), F.concat("calls", "__n.calls")).otherwise(F.col("calls")))).otherwise(F.col("calls")),
    })
    nth = F.row_number().over(Window.partitionBy("conversation", "role", "call_id").orderBy("seq"))
    kept = one.withColumn("__k", nth).where((F.col("role") != "tool") | F.col("call_id").isNull() | (F.col("__k") == 1))
    return kept.select(*messages.columns)
