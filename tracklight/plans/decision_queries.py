"""Queries on tool calls, decisions, entities and their analytics (with the SQL that checks them)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics as A
from ..operators import decisions as D
from ..streaming import jobs
from .registry import Tables, query

CALLS = ["trajectory_id", "agent_id", "organization_id", "domain_type", "ts", "event_id", "turn_index", "call_id", "action", "arguments", "confidence", "duration_ms", "pivotal", "decision_type"]


def decisions(t: Tables):
    """Judged decisions: calls joined to the responses of their own turn."""
    events = t.v_tool_events
    return D.judge(D.match_responses(D.extract_decisions(events.select(*CALLS)), D.responses_of(events)))


#: The same in SQL, for the checks below.
DECIDED = """with x as (select *, coalesce(regexp_matches(lower(response_text), 'error|exception|failed|failure|invalid'), false) as bad, lower(response_text) as low from v_tool_events),
d as (select *, not bad as success, row_number() over (partition by trajectory_id, turn_index order by ts, event_id) - 1 as decision_index,
case when not bad then null when low like '%timeout%' then 'Timeout' when low like '%validation%' then 'ValidationError' when low like '%permission%' or low like '%auth%' then 'PermissionError'
when low like '%not found%' then 'NotFoundError' when low like '%error%' or low like '%exception%' then 'Error' else 'tool_error' end as error_type from x) """


@query("flagship_actions", DECIDED + """select action, count(*) as calls, avg(cast(success as int)) as success_rate,
(select e.error_type from (select d2.action, d2.error_type, count(*) as c from d d2 where d2.error_type is not null group by 1, 2) e where e.action = d.action order by e.c desc, e.error_type limit 1) as top_error
from d group by action""")  # fmt: skip
def flagship_actions(t: Tables):
    """Calls, success rate and most frequent error of each action."""
    d = decisions(t)
    errors = d.where("error_type is not null").groupBy("action", "error_type").agg(F.count("*").alias("c"))
    top = errors.groupBy("action").agg(F.min_by("error_type", F.struct((-F.col("c")).alias("c"), "error_type")).alias("top_error"))
    return A.success_rate(d).join(top, "action", "left").orderBy("action")


@query("x1_extract", DECIDED + "select trajectory_id, turn_index, call_id, 't'||cast(turn_index as varchar)||'-tc-'||cast(decision_index as varchar) as decision_id from d")
def x1(t):
    return D.extract_decisions(t.v_tool_events).select("trajectory_id", "turn_index", "call_id", "decision_id")


@query("x1b_id_styles", DECIDED + "select call_id, 't'||cast(turn_index as varchar)||'-d'||cast(decision_index as varchar) as adapter_id, trajectory_id||'-'||cast(turn_index as varchar)||'-'||cast(decision_index as varchar) as analytics_id from d")
def x1b(t):
    a = D.extract_decisions(t.v_tool_events, "t{turn}-d{n}").withColumnRenamed("decision_id", "adapter_id").drop("decision_index")
    return D.extract_decisions(a, "{traj}-{turn}-{n}").select("call_id", "adapter_id", F.col("decision_id").alias("analytics_id"))


@query("x2_tool_join", DECIDED + "select call_id, response_text, success from d")
def x2(t):
    return decisions(t).select("call_id", "response_text", "success")


@query("x2_trajectory_scope", "select call_id, response_text from v_tool_events")
def x2b(t):
    """Responses matched in any turn of the trajectory."""
    e = t.v_tool_events
    return D.match_responses(e.select(*CALLS), D.responses_of(e), scope="trajectory").select("call_id", "response_text")


@query("x3_error_profiles", """select sum(cast(coalesce(regexp_matches(lower(response_text), 'error|exception|failed|failure|invalid'), false) as int)) as full_, sum(cast(coalesce(regexp_matches(lower(response_text), 'error|exception|failed|failure'), false) as int)) as adapter,
sum(cast(coalesce(regexp_matches(lower(response_text), 'error|failed|exception'), false) as int)) as short, sum(cast(coalesce(regexp_matches(lower(response_text), 'error|failed|exception|traceback'), false) as int)) as router, action from v_tool_events group by action""")
def x3(t):
    return t.v_tool_events.groupBy("action").agg(*[F.count_if(X.has_error("response_text", p)).alias("full_" if p == "full" else p) for p in X.ERROR_WORDS])


@query("x4_error_type", DECIDED + "select error_type, count(*) as n from d group by 1")
def x4(t):
    return decisions(t).groupBy("error_type").agg(F.count("*").alias("n"))


@query("x5_result_summary", "select call_id, case when length(response_text) > 12 then substring(response_text, 1, 12)||'...' else response_text end as short, substring(response_text, 1, 5) as cut from v_tool_events")
def x5(t):
    return t.v_tool_events.select("call_id", X.summarise_result("response_text", 12).alias("short"), X.summarise_result("response_text", 5, dots=False).alias("cut"))


@query("x6_arguments", "select call_id, case when event_id%5=0 then null else cast(json_extract_string(arguments, '$.k') as varchar) end as k, case when event_id%5=0 then 'call '||arguments end as raw from v_tool_events")
def x6(t):
    """Arguments that are JSON objects as maps; others kept whole (every fifth is made plain text)."""
    a = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("call "), "arguments")).otherwise(F.col("arguments"))
    m = D.parse_arguments(a)
    return t.v_tool_events.select("call_id", F.element_at(m, "k").alias("k"), F.element_at(m, "raw").alias("raw"))


@query("x7_reasoning", "select message_id, 'r'||cast(turn_index as varchar)||chr(10)||chr(10)||role||coalesce(chr(10)||chr(10)||nullif(trim(text), ''), '') as reasoning from v_messages")
def x7(t):
    """Whole texts as thinking blocks."""
    m = t.v_messages
    text = F.concat(F.lit("a <thinking>"), "role", F.lit(" </thinking> b <THINKING>"), F.coalesce("text", F.lit("")), F.lit("</Thinking> c"))
    return m.select("message_id", D.reasoning_text(F.concat(F.lit("r"), "turn_index"), text).alias("reasoning"))


@query("x8_merge_extracted", DECIDED + """, r as (select *, row_number() over (partition by trajectory_id, turn_index, action order by decision_index) as nth from d),
k as (select trajectory_id, turn_index, action, min('why '||arguments) as rationale from d where event_id%4=0 group by 1, 2, 3),
l as (select trajectory_id, turn_index, action, 'loose '||cast(event_id as varchar) as rationale from d where event_id%50=1)
select r.trajectory_id, r.turn_index, 't'||cast(r.turn_index as varchar)||'-tc-'||cast(decision_index as varchar) as decision_id, r.action, k.rationale from r left join k on r.trajectory_id=k.trajectory_id and r.turn_index=k.turn_index and r.action=k.action and r.nth=1
union all select trajectory_id, turn_index, 't'||cast(turn_index as varchar)||'-rs-'||cast(row_number() over (partition by trajectory_id, turn_index order by action, rationale)-1 as varchar), action, rationale from l""")
def x8(t):
    d = decisions(t)
    e = t.v_tool_events
    known = e.where("event_id % 4 = 0").select(*D.TURN, "action", F.concat(F.lit("why "), "arguments").alias("rationale"), F.col("call_id").alias("relates_to_tool_call"))
    loose = e.where("event_id % 50 = 1").select(*D.TURN, "action", F.concat(F.lit("loose "), F.col("event_id").cast("string")).alias("rationale"), F.lit(None).cast("string").alias("relates_to_tool_call"))
    return D.merge_extracted(d, known.unionByName(loose))


@query("x9_deferred_state", "select call_id, case when event_id%2=0 then action end as summary, case when event_id%2=0 then 1 else 0 end as n_entities from v_tool_events")
def x9(t):
    s = D.deferred_state(F.when(F.col("event_id") % 2 == 0, F.struct(F.col("action").alias("summary"), F.array("action").alias("entities"))))
    return t.v_tool_events.select("call_id", s["summary"].alias("summary"), F.size(s["entities"]).alias("n_entities"))


@query("x10_fill_turns", "select trajectory_id, turn_index, count(*) as n from v_tool_events group by 1, 2")
def x10(t):
    """Every second trajectory lost its decisions; the extracted ones fill its turns."""
    d = D.extract_decisions(t.v_tool_events).select(*D.TURN, "decision_index", "decision_id", "action", "event_id")
    lost = F.when(F.col("event_id") % 2 == 0, F.col("decisions")).otherwise(F.slice("decisions", 1, 0))
    turns = d.groupBy(*D.TURN).agg(F.min("event_id").alias("event_id"), F.array_sort(F.collect_list(F.struct("decision_index", "decision_id", "action"))).alias("decisions"))
    nested = turns.withColumn("decisions", lost).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "decisions"))).alias("turns"))
    return D.fill_missing_turns(nested, d.drop("event_id")).select(*D.TURN, F.size("decisions").cast("bigint").alias("n"))


@query("x11_flatten", DECIDED + "select trajectory_id, turn_index, decision_index, action, success from d")
def x11(t):
    """Nested and flattened again: all rows are back."""
    d = decisions(t).select(*D.TURN, "decision_index", "action", "success")
    return D.flatten_decisions(D.nest_decisions(d)).select(*D.TURN, F.col("decision_index").cast("bigint").alias("decision_index"), "action", "success")


@query("t9_nest", DECIDED + "select trajectory_id, count(distinct turn_index) as n_turns, count(*) as n_decisions, string_agg(action, ',' order by turn_index, decision_index) as actions from d group by 1")
def t9(t):
    n = D.nest_decisions(decisions(t).select(*D.TURN, "decision_index", "action"))
    flat = F.flatten(F.transform("turns", lambda x: x["decisions"]))
    return n.select("trajectory_id", F.size("turns").cast("bigint").alias("n_turns"), F.size(flat).cast("bigint").alias("n_decisions"), F.array_join(F.transform(flat, lambda x: x["action"]), ",").alias("actions"))


@query("x12_searchable_text", DECIDED + "select call_id, concat_ws(' | ', 'Action: '||action, 'Type: '||decision_type, 'Rationale: '||substring(repeat(arguments, 60), 1, 500), 'Outcome: '||case when success then 'success' else 'failure' end, 'Error: '||error_type, 'Result: '||substring(response_text, 1, 200)) as searchable from d")
def x12(t):
    return decisions(t).select("call_id", D.searchable_text(F.repeat("arguments", F.lit(60))).alias("searchable"))


@query("x13_embedding_text", DECIDED + "select call_id, concat_ws(' | ', 'Decision type: '||coalesce(decision_type, 'unknown'), 'Context: '||case when event_id%2=0 then agent_id end, 'Available actions: click, '||action, 'Action: '||action, 'Arguments: k='||json_extract_string(arguments, '$.k')||', long='||repeat('x', 47)||'..., list=<list>, flag=True, none=None', 'Rationale: because '||action, 'Outcome: '||case when success then 'Success' else 'Failure' end, 'Result: '||substring(response_text, 1, 200), 'Alternatives considered: a, b, '||action) as embedding_text from d")
def x13(t):
    d = decisions(t)
    more = F.concat(F.lit('{"k": '), F.get_json_object("arguments", "$.k"), F.lit(', "long": "' + "x" * 60 + '", "list": [1, 2], "flag": true, "none": null, "sixth": 6}'))
    text = D.embedding_text(F.when(F.col("event_id") % 2 == 0, F.col("agent_id")), F.array(F.lit("click"), "action"), F.concat(F.lit("because "), "action"), F.array(F.lit("a"), F.lit("b"), F.col("action"), F.lit("z")))
    return d.withColumn("arguments", more).select("call_id", text.alias("embedding_text"))


@query("e5_text_builder", DECIDED + "select call_id, action||'/'||coalesce(error_type, 'fine') as searchable_text, length(action||'/'||coalesce(error_type, 'fine')) as size from d")
def e5(t):
    """Decisions described by a builder of the caller's, with what an embedding step adds."""
    builder = lambda: F.concat_ws("/", "action", F.coalesce("error_type", F.lit("fine")))
    made = D.embed_decisions(decisions(t), lambda d: d.withColumn("size", F.length("searchable_text")), builder)
    return made.select("call_id", "searchable_text", "size")


@query("x14_trajectory_text", "with m as (select *, row_number() over (partition by trajectory_id order by sequence_id) as n from v_messages) select trajectory_id, string_agg(substring(text, 1, 500), ' | ' order by n) as embedding_text from m where n <= 3 group by 1")
def x14(t):
    return D.trajectory_text(t.v_messages)


@query("x15_prefer_stored", "with s as (select distinct trajectory_id from v_tool_events where event_id%3=0) select e.call_id, case when s.trajectory_id is null then 'programmatic' else 'stored' end as origin from v_tool_events e left join s on e.trajectory_id=s.trajectory_id where s.trajectory_id is null or e.event_id%3=0")
def x15(t):
    e = t.v_tool_events.select("trajectory_id", "call_id", "event_id")
    return D.prefer_stored(e.where("event_id % 3 = 0"), e).select("call_id", "origin")


@query("x16_tool_entities", """with a as (select trajectory_id, ts, event_id, action, cast(json_extract_string(arguments, '$.k') as varchar) as k from v_tool_events),
f as (select trajectory_id, 'tool:'||action as entity_id, 'tool' as entity_type, action as name from a union select trajectory_id, 'file:http://h/'||k, 'file', 'http://h/'||k from a
union select trajectory_id, 'url:http://l/'||k, 'url', 'http://l/'||k from a union select trajectory_id, 'resource:'||k, 'resource', k from a union select trajectory_id, 'reference:r'||k, 'reference', 'r'||k from a)
select * from f""")
def x16(t):
    """Tools and nested argument entities (arguments are wrapped to have six levels and a list)."""
    k = F.get_json_object("arguments", "$.k")
    deep = F.struct(F.struct(F.concat(F.lit("http://h/"), k).alias("uri_path"), F.array(F.struct(F.concat(F.lit("http://l/"), k).alias("url"))).alias("links")).alias("c"))
    wrapped = F.to_json(F.struct(k.alias("user_id"), F.lit(1).alias("size"), F.concat(F.lit("r"), k).alias("target"), F.struct(F.struct(deep.alias("b")).alias("a")).alias("options")))
    return D.tool_entities(t.v_tool_events.withColumn("arguments", wrapped))


@query("x17_domain_entities", """select distinct trajectory_id, entity_type, name, lower(name) as entity_id from (
select trajectory_id, 'world' as entity_type, 'World '||json_extract_string(arguments, '$.k') as name from v_tool_events where event_id%2=0
union all select trajectory_id, 'rule', 'Rule '||action from v_tool_events where event_id%2=1) x""".replace("lower(name)", "replace(lower(name), ' ', '-')").replace("lower(replace", "replace(lower").replace("'Rule '||action", "'Rule '||replace(action, '_', ' ')"))
def x17(t):
    e, k = t.v_tool_events, F.get_json_object("arguments", "$.k")
    kind = F.when(F.col("event_id") % 2 == 0, "world").otherwise("rule")
    json = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("World "), k).alias("world_name")))).otherwise(F.to_json(F.struct(F.concat(F.lit("Rule "), F.replace("action", F.lit("_"), F.lit(" "))).alias("rule"))))
    return D.domain_entities(e.select("trajectory_id", kind.alias("kind"), json.alias("json")), {"world": ("world_name string", "world_name"), "rule": ("rule string", "rule")})


@query("x18_slug", r"select doc_id, substring(regexp_replace(regexp_replace(regexp_replace(lower(trim(substring(text, 1, 80))), '[^a-z0-9\s_-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), 1, 50) as slug from documents")
def x18(t):
    return t.documents.select("doc_id", X.slug(F.substring("text", 1, 80)).alias("slug"))


@query("x19_merge_entities", "select trajectory_id, 'tool:'||action as entity_id from v_tool_events group by 1, 2")
def x19(t):
    e = t.v_tool_events.select("trajectory_id", F.concat(F.lit("tool:"), "action").alias("entity_id"), F.lit("tool").alias("entity_type"), "event_id").distinct()
    context = D.first_seen(e.where("event_id % 2 = 0"), ["trajectory_id", "entity_id"], ["event_id"])
    new = D.first_seen(e, ["trajectory_id", "entity_id"], ["event_id"])
    return D.merge_entities(context, new, ["tool"]).select("trajectory_id", "entity_id")


@query("x20_entity_dedupe", "select trajectory_id, action as entity_id, min(event_id) as event_id from v_tool_events group by 1, 2")
def x20(t):
    return D.first_seen(t.v_tool_events.select("trajectory_id", F.col("action").alias("entity_id"), "event_id"), ["trajectory_id", "entity_id"], ["event_id"])


@query("x21_evaluations", DECIDED + "select trajectory_id, turn_index as turn_id, 't'||cast(turn_index as varchar)||'-tc-'||cast(decision_index as varchar) as decision_id, 'extractor' as evaluator_id, confidence as score from d where confidence is not null")
def x21(t):
    return D.evaluations_to_annotations(decisions(t))


@query("x22_best_annotation", "select trajectory_id, evaluator_id, score, label from (select *, row_number() over (partition by trajectory_id order by score desc, evaluator_id) as rn from v_annotations where score is not null) where rn=1")
def x22(t):
    return D.best_annotation(t.v_annotations, ["trajectory_id"])


# ------------------------------------------------------------------------------------------------ analytics
@query("a1_success_rate", DECIDED + "select action, count(*) as calls, avg(cast(success as int)) as success_rate from d group by 1")
def a1(t):
    return A.success_rate(decisions(t))


@query("a2_action_freq", "select action, count(*) as n from v_tool_events group by 1 order by 2 desc, 1 limit 3")
def a2(t):
    return A.frequency(t.v_tool_events, "action", top=3)


@query("a3_decision_types", "select coalesce(decision_type, 'unknown') as decision_type, count(*) as n from v_tool_events group by 1")
def a3(t):
    return A.frequency(t.v_tool_events, "decision_type", unknown="unknown")


@query("a4_turn_dist", "select turns, count(*) as n from (select trajectory_id, count(distinct turn_index) as turns from v_tool_events group by 1) group by 1")
def a4(t):
    return A.turn_counts(t.v_tool_events)


@query("a5_error_freq", DECIDED + "select error_type, count(*) as n from d where error_type is not null group by 1 order by 2 desc, 1 limit 5")
def a5(t):
    return A.frequency(decisions(t), "error_type", top=5)


@query("a6_outcomes", "select outcome, count(*) as n from (select case when outcome_score is null then 'unknown' when outcome_score>=0.7 then 'success' when outcome_score>=0.4 then 'partial' else 'failure' end as outcome from v_trajectories) group by 1")
def a6(t):
    o = F.when(F.col("outcome_score").isNotNull(), X.outcome_of_score("outcome_score"))
    return A.frequency(t.v_trajectories.withColumn("outcome", o), "outcome", unknown="unknown")


@query("a7_duration_stats", """select action, min(duration_ms) as min_value, max(duration_ms) as max_value, avg(duration_ms) as mean_value, max(case when rn = n//2 + 1 then duration_ms end) as median_value
from (select action, duration_ms, row_number() over (partition by action order by duration_ms) as rn, count(*) over (partition by action) as n from v_tool_events where duration_ms is not null) group by 1""")
def a7(t):
    return A.duration_stats(t.v_tool_events, "duration_ms", ["action"])


@query("a8_confidence_hist", "select bin, n, cast(bin*10 as varchar)||'-'||cast(bin*10+10 as varchar)||'%' as label from (select least(cast(floor(confidence/cast(0.1 as double)) as int), 9) as bin, count(*) as n from v_tool_events where confidence is not null group by 1) b")
def a8(t):
    return A.histogram(t.v_tool_events, "confidence", percent=True)


@query("a9_pivotal", "select action, sum(cast(pivotal as int)) as pivotal, avg(cast(pivotal as int)) as pivotal_rate from v_tool_events group by 1")
def a9(t):
    return A.pivotal(t.v_tool_events)


#: Trajectories of calls: an outcome by how many calls went well (null for those of three calls), turns, and messages.
ENDED = ", t as (select trajectory_id, case when count(*)=3 then null when sum(cast(success as int))=count(*) then 'success' when sum(cast(success as int))=0 then 'failure' else 'partial_success' end as outcome, count(distinct turn_index) as turns, count(*)+count(response_text) as messages from d group by 1) "


def _ended(d):
    ok, n = F.count_if("success"), F.count("*")
    outcome = F.when(n == 3, None).when(ok == n, "success").when(ok == 0, "failure").otherwise("partial_success")
    return d.groupBy("trajectory_id").agg(outcome.alias("outcome"), F.count_distinct("turn_index").alias("turns"), (n + F.count("response_text")).alias("messages"))


@query("a10_snapshot", DECIDED + ENDED + """select (select count(*) from t) as trajectories, (select sum(turns) from t) as turns, count(*) as decisions, (select sum(messages) from t) as messages,
(select sum(turns)/count(*) from t) as avg_turns, count(*)/(select sum(turns) from t) as avg_decisions, avg(cast(success as int)) as success_rate, sum(cast(pivotal as int)) as pivotal, avg(confidence) as avg_confidence,
(select string_agg(k||'='||cast(c as varchar), ',' order by k) from (select action as k, count(*) as c from d group by 1)) as action,
(select string_agg(k||'='||cast(c as varchar), ',' order by k) from (select error_type as k, count(*) as c from d where error_type is not null group by 1)) as error_type,
(select string_agg(k||'='||cast(c as varchar), ',' order by k) from (select decision_type as k, count(*) as c from d where decision_type is not null group by 1)) as decision_type,
(select string_agg(cast(k as varchar)||'='||cast(c as varchar), ',' order by k) from (select turns as k, count(*) as c from t group by 1)) as turn_distribution,
(select string_agg(k||'='||cast(c as varchar), ',' order by k) from (select coalesce(outcome, 'unknown') as k, count(*) as c from t group by 1)) as outcomes,
(select string_agg(k||'='||cast(c as varchar), ',' order by k) from (select action as k, round(avg(cast(success as int)), 6) as c from d group by 1)) as success_rates from d""")
def a10(t):
    d = decisions(t)
    return A.snapshot(d, _ended(d))


@query("a11_report", DECIDED + ENDED + """, p as (select action, count(*) as n, 100.0*avg(cast(success as int)) as rate from d group by 1), r as (select *, row_number() over (order by n desc, action) as rk from p),
e as (select error_type, count(*) as n, row_number() over (order by count(*) desc, error_type) as rk from d where error_type is not null group by 1), o as (select coalesce(outcome, 'unknown') as k, count(*) as n from t group by 1), s as (select count(*) as t, sum(turns) as u, sum(messages) as m from t), q as (select count(*) as d, 100.0*avg(cast(success as int)) as rate from d)
select concat_ws(chr(10), '=== OTS Analytics Summary ===', '', 'Totals:', printf('  Trajectories: %d', t), printf('  Turns: %d', cast(u as bigint)), printf('  Decisions: %d', d), printf('  Messages: %d', cast(m as bigint)), '', 'Averages:', printf('  Turns per trajectory: %.1f', u/t), printf('  Decisions per turn: %.1f', d/u), printf('  Overall success rate: %.1f%%', rate), '', 'Top Actions:',
(select string_agg(printf('  %s: %d calls (%.0f%% success)', action, n, rate), chr(10) order by rk) from r where rk<=5), '', 'Outcomes:', (select string_agg(printf('  %s: %d', k, n), chr(10) order by n desc, k) from o), '', 'Top Errors:', (select string_agg(printf('  %s: %d', error_type, n), chr(10) order by rk) from e where rk<=3)) as report from s, q""")
def a11(t):
    d = decisions(t)
    return A.report(d, _ended(d))


@query("a12_score_hist", "select least(cast(floor(outcome_score*10) as int), 9) as bin, count(*) as n, printf('%.1f-%.1f', least(cast(floor(outcome_score*10) as int), 9)/10.0, (least(cast(floor(outcome_score*10) as int), 9)+1)/10.0) as label from v_trajectories where outcome_score is not null group by 1")
def a12(t):
    return A.histogram(t.v_trajectories, "outcome_score")


@query("a13_tags", "select tag, count(*) as n from (select domain_type as tag from v_trajectories union all select task_category from v_trajectories union all select complexity_level from v_trajectories) where tag is not null group by 1")
def a13(t):
    return A.frequency(t.v_trajectories.select(F.explode(F.array("domain_type", "task_category", "complexity_level")).alias("tag")), "tag")


@query("a14_daily", "select cast(ts as date) as day, count(*) as n, avg(confidence) as avg_score from v_tool_events where ts >= timestamp '2024-01-31' - interval 15 day group by 1")
def a14(t):
    return A.daily(t.v_tool_events, "ts", "confidence", F.lit("2024-01-31").cast("timestamp_ntz"), 15)


@query("a15_agent_stats", "select agent_id, count(*) as n, avg(outcome_score) as avg_score from v_trajectories group by 1")
def a15(t):
    return A.per_agent(t.v_trajectories)


@query("a16_annotation_agg", """select a.trajectory_id, count(*) as n, avg(score) as avg_score, min(score) as min_score, max(score) as max_score, count(distinct evaluator_id) as evaluators, max(l.labels) as labels from v_annotations a
left join (select trajectory_id, string_agg(label||'='||cast(c as varchar), ',' order by label) as labels from (select trajectory_id, label, count(*) as c from v_annotations where label is not null group by 1, 2) group by 1) l on a.trajectory_id=l.trajectory_id group by 1""")
def a16(t):
    return A.annotation_summary(t.v_annotations)


@query("a17_agents_per_tag", "select tag, count(distinct agent_id) as n from v_agent_tags group by 1 having count(distinct agent_id) >= 100")
def a17(t):
    """Agents per linked object, those with enough of them."""
    return t.v_agent_tags.groupBy("tag").agg(F.count_distinct("agent_id").alias("n")).where("n >= 100")


@query("a18_status", "select s.processing_status, count(v.trajectory_id) as n from (values ('pending'), ('processing'), ('completed'), ('failed')) s(processing_status) left join v_trajectories v on v.processing_status=s.processing_status group by 1 union all select 'total', count(*) from v_trajectories")
def a18(t):
    return A.zero_filled(t.v_trajectories, "processing_status", ["pending", "processing", "completed", "failed"])


@query("a19_tag_counts", "select archive_id, tag, count(*) as n from (select archive_id, tag_lang as tag from v_passages union all select archive_id, tag_size from v_passages) where tag is not null group by 1, 2")
def a19(t):
    return A.tag_counts(t.v_passages, "archive_id", ["tag_lang", "tag_size"])


@query("a19_distinct_tags", "select distinct tag from v_agent_tags where tag like '%1%' and tag > 't0' order by 1 limit 3")
def a19b(t):
    """Distinct agent tags that contain a text, after a cursor."""
    return t.v_agent_tags.select("tag").distinct().where(F.col("tag").contains("1") & (F.col("tag") > "t0")).orderBy("tag").limit(3)


@query("a20_counts", "select organization_id, count(*) as n from v_trajectories where domain_type = 'en' group by 1")
def a20(t):
    return t.v_trajectories.where("domain_type = 'en'").groupBy("organization_id").agg(F.count("*").alias("n"))


@query("a21_storage", "select archive_id, n, n*16384 as bytes, case when n < 64 then printf('%.2f KB', n*16.0) when n < 64*1024 then printf('%.2f MB', n/64.0) when n < 64*1024*1024 then printf('%.2f GB', n/(64.0*1024)) else printf('%.2f TB', n/(64.0*1024*1024)) end as pretty from (select archive_id, count(*) as n from v_passages group by 1)")
def a21(t):
    return A.storage_estimate(t.v_passages, "archive_id")


@query("a22_source_stats", "select source_id, sum(case when is_deleted then 0 else 1 end) as n_files, sum(case when is_deleted then 0 else size end) as bytes from v_files group by 1 union all select 'total', sum(case when is_deleted then 0 else 1 end), sum(case when is_deleted then 0 else size end) from v_files")
def a22(t):
    return A.source_stats(t.v_files)


@query("a23_usage", "select run_id, count(*) as steps, sum(prompt_tokens) as prompt_tokens, sum(completion_tokens) as completion_tokens, sum(prompt_tokens+completion_tokens) as total_tokens, nullif(sum(coalesce(cached_tokens,0)), 0) as cached_tokens, nullif(sum(coalesce(cache_write_tokens,0)), 0) as cache_write_tokens, nullif(sum(coalesce(reasoning_tokens,0)), 0) as reasoning_tokens from v_steps group by 1")
def a23(t):
    return A.run_usage(t.v_steps)


COSTS = ("input_cost", "output_cost", "cached_cost", "cache_write_cost", "reasoning_cost", "total_cost")


@query("a24_cost", """with p as (select s.*, coalesce(a.input, b.input, c.input) as pi, coalesce(a.output, b.output, c.output) as po, coalesce(a.cached, b.cached, c.cached) as pc, coalesce(a.cache_write, b.cache_write, c.cache_write, 0) as pw, coalesce(a.reasoning, b.reasoning, c.reasoning, 0) as pr from v_steps s left join v_prices a on a.model=s.model
left join v_prices b on b.model=regexp_replace(s.model, '^[^/]*/', '') left join v_prices c on c.model=array_to_string(list_slice(string_split(s.model, '-'), 1, 3), '-')),
k as (select run_id, case when prompt_tokens>0 then prompt_tokens*pi/1e6 end as i, case when completion_tokens>0 then completion_tokens*po/1e6 end as o, case when cached_tokens>0 then cached_tokens*pc/1e6 end as c, case when cache_write_tokens>0 then cache_write_tokens*pw/1e6 end as w, case when reasoning_tokens>0 then reasoning_tokens*pr/1e6 end as r from p)
select run_id, sum(i) as input_cost, sum(o) as output_cost, sum(c) as cached_cost, sum(w) as cache_write_cost, sum(r) as reasoning_cost, sum(nullif(coalesce(i,0)+coalesce(o,0)+coalesce(c,0)+coalesce(w,0)+coalesce(r,0), 0)) as total_cost from k group by 1""")
def a24(t):
    return A.step_cost(t.v_steps, t.v_prices).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COSTS])


@query("a25_run_metrics", "select s.run_id, count(*) as num_steps, coalesce(max(m.run_ns), cast((epoch(max(s.created_at)) - epoch(min(s.created_at))) as bigint)*1000000000) as run_ns, string_agg(distinct case when step_no=3 and model<>'model-a' then 'tool-'||model end, ',' order by case when step_no=3 and model<>'model-a' then 'tool-'||model end) as tools_used from v_steps s left join v_run_metrics m on s.run_id=m.run_id group by 1")
def a25(t):
    calls = t.v_steps.where("step_no = 3").select("run_id", F.col("model").alias("tool"))
    tools = t.v_steps.where("model <> 'model-a'").select(F.col("model").alias("name"), F.concat(F.lit("tool-"), "model").alias("tool_id")).distinct()
    return A.run_metrics(t.v_steps, t.v_run_metrics, calls, tools).withColumn("tools_used", F.array_join("tools_used", ","))


#: Metrics of steps, by model and whether feedback was given: times in ms, tokens, and cost in millionths.
STEP_METRICS = """s as (select model, feedback is not null as rated, cast(prompt_tokens*2 as double) as ttft, cast(prompt_tokens*2+completion_tokens*3 as double) as llm, cast(cached_tokens*7 as double) as tool,
cast(prompt_tokens*2+completion_tokens*3+coalesce(cached_tokens,0)*7 as double) as step, cast(prompt_tokens*5+completion_tokens*25 as double) as cost, cast(completion_tokens as double) as tokens from v_steps)"""
BOUNDS = {"ttft": (0, 10_000, 10), "llm": (0, 15_000, 10), "tool": (0, 3_000, 10), "step": (0, 20_000, 10), "cost": (0, 50_000, 10), "tokens": (100, 1_000, 9)}
LONG = "m as (" + " union all ".join(f"select model, rated, '{x}' as metric, {x} as value, cast({lo} as double) as lo, cast({hi} as double) as hi, {n} as k from s where {x} is not null" for x, (lo, hi, n) in BOUNDS.items()) + ")"


def _step_metrics(t):
    c, cached = F.col, F.coalesce("cached_tokens", F.lit(0))
    llm = c("prompt_tokens") * 2 + c("completion_tokens") * 3
    return t.v_steps.select("model", c("feedback").isNotNull().alias("rated"), (c("prompt_tokens") * 2).alias("ttft"), llm.alias("llm"), (c("cached_tokens") * 7).alias("tool"), (llm + cached * 7).alias("step"), (c("prompt_tokens") * 5 + c("completion_tokens") * 25).alias("cost"), c("completion_tokens").alias("tokens"))


@query("a26_latency", f"with {STEP_METRICS}, {LONG} select model, metric, case when value<lo then 0 when value>=hi then k+1 else cast(floor((value-lo)/((hi-lo)/k)) as int)+1 end as bucket, count(*) as n, avg(value) as mean_value from m group by 1, 2, 3")
def a26(t):
    """Histograms of six metrics of steps by model."""
    return A.latency(_step_metrics(t), BOUNDS, ["model"])


@query("a26_percentiles", f"with {STEP_METRICS}, {LONG}, g as (select model, metric, count(*) as n, min(value) as least, max(value) as most, avg(value) as mean, list_sort(list(value)) as v from m group by 1, 2) select model, metric, n, least, most, mean, v[cast(ceil(0.5*n) as bigint)] as p50, v[cast(ceil(0.9*n) as bigint)] as p90, v[cast(ceil(0.99*n) as bigint)] as p99 from g")
def a26b(t):
    """Percentiles by model, rolled up from sketches by model and feedback (exact at this size)."""
    stored = A.sketches(_step_metrics(t), list(BOUNDS), ["model", "rated"])
    return A.percentiles(A.roll_up(stored, ["model"]), {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("a27_batches", "select agent_id, count(*) as total, sum(cast(status='running' as int)) as running, sum(cast(status='completed' as int)) as completed, sum(cast(status='failed' as int)) as failed, sum(cast(status<>'running' or cast(substring(run_id, 5) as bigint)%4=0 as int)) as updated from v_runs group by 1")
def a27(t):
    """Batches after a poll: all runs were running before, and every fourth one is new."""
    number = F.substring("run_id", F.lit(5), F.length("run_id")).cast("bigint")
    before = t.v_runs.where(number % 4 != 0).select("run_id", F.lit("running").alias("status"))
    return A.batch_summary(t.v_runs, "agent_id", before)


@query("a28_decision_counts", "select trajectory_id, turn_index, count(*) as n from v_tool_events group by 1, 2")
def a28(t):
    return t.v_tool_events.groupBy(*D.TURN).agg(F.count("*").alias("n"))


@query("e3_extractor_registry", "select trajectory_id, 'tool:'||action as entity_id, 'tools' as extractor from v_tool_events union select trajectory_id, 'agent:'||agent_id, 'agents' from v_tool_events")
def e3(t):
    """Two registered extractors run over the calls as they come in two parts that overlap; the store gets what is new."""
    path = f"{jobs.shared_dir(t.spark)}/entities-{uuid.uuid4().hex}"
    for part in (t.v_tool_events.where("event_id % 3 <> 0"), t.v_tool_events.where("event_id % 3 <> 1")):
        D.extract_into(t.spark, part, {"tools": tools_of, "agents": agents_of}, path)
    return t.spark.read.parquet(path).select("trajectory_id", "entity_id", "extractor")


def tools_of(calls):
    return calls.select("trajectory_id", F.concat(F.lit("tool:"), "action").alias("entity_id"), F.col("action").alias("name"))


def agents_of(calls):
    return calls.select("trajectory_id", F.concat(F.lit("agent:"), "agent_id").alias("entity_id"), F.col("agent_id").alias("name"))
