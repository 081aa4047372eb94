"""Decisions and entities: tool calls joined to their responses, flattened, enriched, described and nested again.

Calls: trajectory_id, turn_index, ts, event_id, call_id, action, arguments.  Responses: trajectory_id, turn_index,
call_id, position, response_text.  All windows and joins use (trajectory_id, turn_index, ...), so one hash partitioning
by trajectory serves them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X

TURN = ["trajectory_id", "turn_index"]


def extract_decisions(calls: DataFrame, template: str = "t{turn}-tc-{n}") -> DataFrame:
    """One row a tool call with ``decision_index`` in its turn and an id from the template (turn, n, traj, call)."""
    order = Window.partitionBy(*TURN).orderBy("ts", "event_id")
    out = calls.withColumn("decision_index", F.row_number().over(order) - 1)
    parts, rest = [], template
    names = {"turn": "turn_index", "n": "decision_index", "traj": "trajectory_id", "call": "call_id"}
    while "{" in rest:
        text, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        parts += [F.lit(text), F.col(names[key]).cast("string")]
    return out.withColumn("decision_id", F.concat(*parts, F.lit(rest)))


def responses_of(events: DataFrame) -> DataFrame:
    """The tool responses of an event table, with their position."""
    return events.where("response_text is not null").select(*TURN, "call_id", F.col("event_id").alias("position"), "response_text")


def match_responses(calls: DataFrame, responses: DataFrame, scope: str = "turn") -> DataFrame:
    """Calls with the first response of equal id in the same turn (``scope='trajectory'``: in any turn)."""
    keys = ["trajectory_id", "call_id"] + (["turn_index"] if scope == "turn" else [])
    first = responses.groupBy(*keys).agg(F.min_by("response_text", "position").alias("response_text"))
    return calls.drop("response_text").join(first, keys, "left")


def judge(decisions: DataFrame, profile: str = "full", summary: int = 200) -> DataFrame:
    """success (true without a response), error_type, result_summary."""
    failed = X.has_error("response_text", profile)
    return decisions.withColumns({"success": ~failed, "error_type": F.when(failed, F.coalesce(X.error_type("response_text"), F.lit("tool_error"))), "result_summary": X.summarise_result("response_text", summary)})


def parse_arguments(arguments: Column | str) -> Column:
    """A JSON object as a map of strings; anything else under ``raw``."""
    a = F.col(arguments) if isinstance(arguments, str) else arguments
    return F.coalesce(F.from_json(a, "map<string,string>"), F.create_map(F.lit("raw"), a))


def reasoning_text(reasoning: Column, text: Column) -> Column:
    """The message's reasoning and its <thinking> blocks, joined by a blank line."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<thinking>(.*?)</thinking>"), F.lit(1)), lambda b: F.trim(b))
    return F.array_join(F.filter(F.concat(F.array(reasoning), blocks), lambda b: F.length(b) > 0), "\n\n")


def merge_extracted(decisions: DataFrame, extracted: DataFrame) -> DataFrame:
    """Enriches the first decision of each (turn, action) with the extracted rationale; appends those without a call.

    ``extracted``: trajectory_id, turn_index, action, rationale, relates_to_tool_call.
    """
    keys = [*TURN, "action"]
    ranked = decisions.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("decision_index")))
    known = extracted.where("relates_to_tool_call is not null").groupBy(*keys).agg(F.min("rationale").alias("rationale")).withColumn("nth", F.lit(1))
    enriched = ranked.join(known, [*keys, "nth"], "left").select(*TURN, "decision_id", "action", "rationale")
    loose = extracted.where("relates_to_tool_call is null")
    n = F.row_number().over(Window.partitionBy(*TURN).orderBy("action", "rationale")) - 1
    return enriched.unionByName(loose.select(*TURN, F.concat(F.lit("t"), F.col("turn_index"), F.lit("-rs-"), n).alias("decision_id"), "action", "rationale"))


def deferred_state(state: Column) -> Column:
    """An empty state where none was captured."""
    return F.coalesce(state, F.struct(F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("entities")))


def nest_decisions(decisions: DataFrame) -> DataFrame:
    """Trajectories with turns and their decisions, in order (the inverse of ``flatten_decisions``)."""
    fields = [c for c in decisions.columns if c not in TURN]
    turn = decisions.groupBy(*TURN).agg(F.array_sort(F.collect_list(F.struct("decision_index", *[c for c in fields if c != "decision_index"]))).alias("decisions"))
    return turn.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "decisions"))).alias("turns"))


def flatten_decisions(trajectories: DataFrame) -> DataFrame:
    """One row a decision of nested trajectories."""
    turns = trajectories.select("trajectory_id", F.explode("turns").alias("t"))
    return turns.select("trajectory_id", "t.turn_index", F.explode("t.decisions").alias("d")).select(*TURN, "d.*")


def fill_missing_turns(trajectories: DataFrame, extracted: DataFrame) -> DataFrame:
    """Turns with decisions keep them; turns without get the extracted ones.  Both sides are shuffled by turn."""
    have = trajectories.select("trajectory_id", F.explode("turns").alias("t")).select("trajectory_id", "t.*")
    more = extracted.groupBy(*TURN).agg(F.array_sort(F.collect_list(F.struct("decision_index", "decision_id", "action"))).alias("extracted"))
    return have.join(more.hint("merge"), TURN, "left").select(*TURN, F.when(F.size("decisions") > 0, F.col("decisions")).otherwise(F.coalesce("extracted", F.col("decisions"))).alias("decisions"))


def prefer_stored(stored: DataFrame, programmatic: DataFrame) -> DataFrame:
    """Stored decisions of a trajectory where it has any, else the programmatic ones, with ``origin``."""
    ids = stored.select("trajectory_id").distinct()
    return stored.withColumn("origin", F.lit("stored")).unionByName(programmatic.join(ids, "trajectory_id", "left_anti").withColumn("origin", F.lit("programmatic")))


def searchable_text(rationale: Column | None = None) -> Column:
    """Text that decision search indexes: action, type, rationale (500 characters), outcome, error, result (200)."""
    why = F.substring(F.lit(None).cast("string") if rationale is None else rationale, 1, 500)
    return X.labelled([
        ("Action", F.col("action")), ("Type", F.col("decision_type")), ("Rationale", F.when(why != "", why)), ("Outcome", F.when(F.col("success"), "success").otherwise("failure")),
        ("Error", F.col("error_type")), ("Result", _said(F.substring("response_text", 1, 200))),
    ])


def _said(text: Column) -> Column:
    """The text, null if it is empty."""
    return F.when(text != "", text)


def embed_decisions(decisions: DataFrame, embed: Callable[[DataFrame], DataFrame], builder: Callable[[], Column] = searchable_text, name: str = "searchable_text") -> DataFrame:
    """Decisions with the text that ``builder`` makes of a row's columns, and what ``embed`` adds to it."""
    return embed(decisions.withColumn(name, builder()))


def arguments_summary(arguments: Column, most: int = 5, each: int = 50, total: int = 100) -> Column:
    """``key=value`` of the first arguments of a JSON object, in its order: so many, long strings cut with three dots,
    nested values as their kind, the whole cut."""
    entries = F.slice(F.map_entries(F.from_json(arguments, "map<string,variant>")), 1, most)

    def shown(e: Column) -> Column:
        kind, text = F.schema_of_variant(e["value"]), F.try_variant_get(e["value"], "$", "string")
        cut = F.when((kind == "STRING") & (F.length(text) > each), F.concat(F.substring(text, 1, each - 3), F.lit("..."))).otherwise(text)
        # How nested values, truth values and nothing are written.
        value = F.when(kind.startswith("OBJECT"), "<dict>").when(kind.startswith("ARRAY"), "<list>").when(kind == "BOOLEAN", F.initcap(text)).when(e["value"].isNull() | (kind == "VOID"), "None").otherwise(cut)
        return F.concat(e["key"], F.lit("="), value)

    return F.substring(F.array_join(F.transform(entries, shown), ", "), 1, total)


def embedding_text(context: Column | None = None, available: Column | None = None, rationale: Column | None = None, alternatives: Column | None = None) -> Column:
    """Text that a decision's embedding is made from; ``available`` and ``alternatives`` (the first three) are arrays."""
    none = F.lit(None).cast("string")
    listed = lambda a: none if a is None else F.when(F.size(a) > 0, F.array_join(a, ", "))
    summary = F.when(F.size(F.from_json("arguments", "map<string,variant>")) > 0, arguments_summary(F.col("arguments")))
    return X.labelled([
        ("Decision type", F.coalesce("decision_type", F.lit("unknown"))), ("Context", none if context is None else _said(context)), ("Available actions", listed(available)), ("Action", F.col("action")),
        ("Arguments", summary), ("Rationale", none if rationale is None else _said(rationale)), ("Outcome", F.when(F.col("success"), "Success").otherwise("Failure")),
        ("Result", _said(F.substring("response_text", 1, 200))), ("Alternatives considered", listed(None if alternatives is None else F.slice(alternatives, 1, 3))),
    ])


def trajectory_text(messages: DataFrame, first: int = 3, cut: int = 500) -> DataFrame:
    """(trajectory_id, embedding_text) from the first messages of each trajectory."""
    n = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("sequence_id"))
    head = messages.withColumn("n", n).where(F.col("n") <= first)
    texts = F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, cut).alias("text"))))
    return head.groupBy("trajectory_id").agg(F.array_join(F.transform(texts, lambda t: t["text"]), X.SEPARATOR).alias("embedding_text"))


# Argument names that point at entities.
ENTITY_KEYS = ("id", "name", "file", "path", "url", "uri", "resource", "entity", "key", "ref", "target")


def entity_arguments(text: str | None) -> list[dict]:
    """(level, key, value) of the non-empty strings whose key points at an entity, in a JSON object, the objects in it and those in its lists, at any depth.

    What isn't a JSON object has none.  The parser's own limit of nesting raises: no depth is left out silently.
    """
    try:
        top = json.loads(text or "null", parse_int=float)
    except json.JSONDecodeError:
        return []
    found, todo = [], [(1, top)] if isinstance(top, dict) else []
    while todo:
        level, node = todo.pop()
        for key, value in node.items():
            if isinstance(value, str):
                if value and any(k in key.lower() for k in ENTITY_KEYS):
                    found.append({"level": level, "key": _valid(key), "value": _valid(value)})
            else:
                todo.extend((level + 1, x) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict))
    return found


def _valid(text: str) -> str:
    """The text with half surrogates, which JSON can escape, as question marks."""
    return text.encode("utf-8", "replace").decode()


def tool_entities(calls: DataFrame) -> DataFrame:
    """Entities of a trajectory: its tools, and string arguments at any depth whose key names one.

    (trajectory_id, entity_id, entity_type, name), first seen kept.  The key alone tells the type: file, url, resource (ids)
    or reference.
    """
    kind_of = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.string()), ("value", pa.string())]))

    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([entity_arguments(x) for x in texts.to_pylist()], type=kind_of)

    named = F.arrow_udf(walk, "array<struct<level:int,key:string,value:string>>")
    tools = calls.select("trajectory_id", "ts", "event_id", F.lit(0).alias("level"), F.concat(F.lit("tool:"), "action").alias("entity_id"), F.lit("tool").alias("entity_type"), F.col("action").alias("name"))
    pairs = calls.select("trajectory_id", "ts", "event_id", F.inline(named("arguments")))
    key, value = F.lower("key"), F.col("value")
    kind = F.when(key.rlike("file|path"), "file").when(key.rlike("url|uri"), "url").when(key.contains("id"), "resource").otherwise("reference")
    hits = pairs.select("trajectory_id", "ts", "event_id", "level", F.concat(kind, F.lit(":"), value).alias("entity_id"), kind.alias("entity_type"), value.alias("name"))
    return first_seen(tools.unionByName(hits), ["trajectory_id", "entity_id"], ["ts", "event_id", "level", "name"]).select("trajectory_id", "entity_id", "entity_type", "name")


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, blank keys dropped."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where(F.trim(F.col(keys[-1])) != "").withColumn("__n", n).where("__n = 1").drop("__n")


def domain_entities(records: DataFrame, schemas: dict[str, tuple[str, str]]) -> DataFrame:
    """Entities from JSON records (trajectory_id, kind, json): for each kind a DDL schema and the field that names it."""
    out = None
    for kind, (ddl, field) in schemas.items():
        j = F.from_json("json", ddl)
        part = records.where(F.col("kind") == kind).select("trajectory_id", F.lit(kind).alias("entity_type"), j[field].cast("string").alias("name"), X.slug(j[field].cast("string")).alias("entity_id"))
        out = part if out is None else out.unionByName(part)
    return first_seen(out, ["trajectory_id", "entity_type", "entity_id"], ["name"])


def merge_entities(context: DataFrame, new: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The context's entities and the new ones it lacks, of the given types."""
    pick = (lambda d: d.where(F.col("entity_type").isin(*types))) if types else (lambda d: d)
    return pick(context).unionByName(pick(new).join(context.select("trajectory_id", "entity_id"), ["trajectory_id", "entity_id"], "left_anti"))


def evaluations_to_annotations(decisions: DataFrame) -> DataFrame:
    """One annotation for each decision that carries an evaluation score."""
    return decisions.where("confidence is not null").select("trajectory_id", F.col("turn_index").alias("turn_id"), "decision_id", F.lit("extractor").alias("evaluator_id"), F.col("confidence").alias("score"))


def best_annotation(annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The annotation with the highest score of each key (ties: smallest evaluator)."""
    best = F.min_by(F.struct("evaluator_id", "score", "label"), F.struct((-F.col("score")).alias("s"), "evaluator_id"))
    return annotations.where("score is not null").groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def run_extractors(tables: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A registry's extractors, unioned; an entity counts once."""
    out = None
    for name in sorted(extractors):
        part = extractors[name](tables).withColumn("extractor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return first_seen(out, ["trajectory_id", "entity_id"], ["extractor", "name"])


def extract_into(spark, tables: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], path: str, keys: Sequence[str] = ("trajectory_id", "entity_id")) -> int:
    """Runs a registry over ``tables`` and adds to the store at ``path`` the entities that it lacks, by ``keys``; how many
    those are.  What is stored keeps its first extractor and name, and no stored file is written again."""
    found = run_extractors(tables, extractors)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        known = spark.read.schema(found.schema).parquet(path).select(*keys)
        found = found.join(known.hint("merge"), list(keys), "left_anti").select(*found.columns)
    stage = f"{path}.new-{uuid.uuid4().hex}"
    found.write.parquet(stage)
    new = spark.read.schema(found.schema).parquet(stage)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
