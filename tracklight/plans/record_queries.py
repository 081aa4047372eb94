"""Queries on captured runs, exports and streams (with the SQL that checks them)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import capture as C
from ..sources import io
from ..streaming import jobs
from .decision_queries import decisions
from .registry import query


def _runs(runs):
    return runs.withColumn("completed_at", F.when(F.col("background"), F.col("created_at").cast("timestamp") + F.expr("interval 90 seconds")))


def _messages(t):
    """A message for every second step, with the step's model as its tool."""
    return t.v_steps.where("step_no % 2 = 1 or step_no = 4").select("run_id", F.when(F.col("step_no") != 4, F.col("step_no")).alias("step_no"), F.col("step_no").cast("bigint").alias("seq"), F.concat("run_id", F.lit("/"), F.col("step_no").cast("string")).alias("message_id"), F.when(F.col("step_no").isin(1, 3, 4, 7), "user").when(F.col("step_no") == 5, "robot").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("step_no").cast("string")).alias("text"), F.when(F.col("step_no") == 3, F.array("model")).alias("tools"))


def _captured(t):
    """Runs of orders, steps of line items, and their messages."""
    return C.build_trajectories(_runs(t.v_runs), t.v_steps, _messages(t))


def _told(trajectories, **more):
    m = F.col("metadata")
    return trajectories.select("run_id", m["duration_ns"].alias("duration_ns"), m["step_count"].alias("step_count"), m["message_count"].alias("message_count"), F.array_join(m["tools_used"], ",").alias("tools"), m["total_tokens"].alias("total_tokens"), F.array_join(m["models"], ",").alias("models"), *[c.alias(n) for n, c in more.items()])


CAPTURE = """with s as (select run_id, count(*) as step_count, sum(prompt_tokens) as i, sum(completion_tokens) as o, string_agg(distinct model, ',' order by model) as models, count(case when step_no%2=1 or step_no=4 then 1 end) as message_count, string_agg(distinct case when step_no=3 then model end, ',' order by case when step_no=3 then model end) as tools from v_steps group by 1)
select r.run_id, case when background then cast(90000000000 as bigint) end as duration_ns, coalesce(step_count,0) as step_count, coalesce(message_count,0) as message_count, coalesce(tools,'') as tools, coalesce(i,0)+coalesce(o,0) as total_tokens, coalesce(models,'') as models from v_runs r left join s on r.run_id=s.run_id"""


@query("t1_capture", CAPTURE)
def t1(t):
    return _told(_captured(t))


@query("t1b_turns", "select run_id, step_no, case when step_no%2=1 then count(*) over (partition by run_id, step_no) else 0 end as n_messages from v_steps where exists (select 1 from v_runs r where r.run_id=v_steps.run_id)")
def t1b(t):
    """Steps without messages stay as empty turns; messages without a step are left out."""
    turns = _captured(t).select("run_id", F.explode("turns").alias("x"))
    return turns.select("run_id", "x.step_no", F.size("x.messages").alias("n_messages"))


OUTCOME = """with u as (select run_id, count(case when step_no in (1, 3, 4, 7) then 1 end) as users, count(case when step_no=3 then 1 end) as tools from v_steps group by 1), o1 as (select r.run_id, status, stop_reason, coalesce(tools,0) as tools, coalesce(users,0) as users,
case when status='completed' and coalesce(stop_reason,'')='max_tokens' then 'incomplete' when status='completed' then 'completed' when status in ('failed','cancelled') then 'failed' else 'unknown' end as name from v_runs r left join u on r.run_id=u.run_id),
o as (select *, case when status='completed' and stop_reason='end_turn' then 0.8 when status='completed' and stop_reason='max_tokens' then 0.5 when status='completed' then 0.7 when status='failed' then 0.9 when status='cancelled' then 0.8 else 0.5 end + case when name='completed' and users>3 then 0.1 else 0 end as confidence,
concat_ws('; ', case when status='completed' then 'Run completed without errors' when status='failed' then 'Run failed with error' when status='cancelled' then 'Run was cancelled' end, case when status='completed' and stop_reason='end_turn' then 'Agent naturally ended turn' when status='completed' and stop_reason='max_tokens' then 'Hit token limit (may be incomplete)' end,
case when name='completed' and users>3 then 'High user engagement ('||cast(users as varchar)||' user messages)' end, case when tools>0 then 'Used '||cast(tools as varchar)||' tool calls' end) as reasons from o1) """


@query("t1c_outcome", OUTCOME + "select run_id, name, cast(confidence as double) as confidence, case name when 'completed' then 'success' when 'incomplete' then 'partial_success' when 'failed' then 'failure' else 'unknown' end as kind, reasons from o")
def t1c(t):
    o = F.col("outcome")
    return _captured(t).select("run_id", o["status"].alias("name"), o["confidence"].alias("confidence"), o["type"].alias("kind"), F.array_join(o["reasoning"], "; ").alias("reasons"))


@query("t2_content", "select message_id, text as first_text, text||chr(10)||role as joined from v_messages")
def t2(t):
    blocks = lambda *xs: F.to_json(F.array(*[F.struct(F.lit(k).alias("type"), x.alias("text")) for k, x in xs]))
    as_list = C.content_blocks(blocks(("image", F.lit("no")), ("text", F.col("text")), ("text", F.col("role"))))
    return t.v_messages.select("message_id", C.first_text(as_list).alias("first_text"), C.joined_text(as_list).alias("joined"))


@query("t2_plain_text", "select message_id, text as joined from v_messages")
def t2b(t):
    return t.v_messages.select("message_id", C.joined_text(C.content_blocks(F.col("text"))).alias("joined"))


@query("t3_analytic", OUTCOME + ", w as (select run_id, min(case when step_no in (1, 3, 7) then step_no end) as first_user, count(*) as n from v_steps group by 1) select o.run_id, coalesce('text '||cast(first_user as varchar), 'Unknown task') as task, case name when 'completed' then 'success' when 'incomplete' then 'partial' else 'failure' end as result, n as n_turns from o join w on o.run_id=w.run_id")
def t3(t):
    a = C.to_analytic(_captured(t)).where("turns is not null")
    return a.select("run_id", "task", "result", F.size("turns").cast("bigint").alias("n_turns"))


@query("t4_outcome_map", "select status, case when status in ('completed','success') then 'success' when status in ('incomplete','partial_success') then 'partial' else 'failure' end as outcome from v_runs")
def t4(t):
    return t.v_runs.select("status", X.outcome_map("status").alias("outcome"))


@query("t5_outcome_of_score", "select trajectory_id, case when outcome_score is null or outcome_score>=cast(0.7 as double) then 'success' when outcome_score>=cast(0.4 as double) then 'partial' else 'failure' end as outcome from v_trajectories")
def t5(t):
    return t.v_trajectories.select("trajectory_id", X.outcome_of_score("outcome_score").alias("outcome"))


@query("t6_task", "select trajectory_id, coalesce(substring(min_by(text, sequence_id) filter (where role='user' and trim(text)<>''), 1, 500), 'Unknown task') as task, min_by(text, sequence_id) filter (where role='system') as system_text from v_messages group by 1")
def t6(t):
    """Task and system text of each conversation, taken as one turn (also T7)."""
    m = F.array_sort(F.collect_list(F.struct("sequence_id", "role", "text", "message_id")))
    turns = F.array(F.struct(F.col("messages")))
    rows = t.v_messages.groupBy("trajectory_id").agg(m.alias("messages"))
    return rows.select("trajectory_id", C.task_description(F.lit(None).cast("string"), turns).alias("task"), C.system_message(turns).alias("system_text"))


@query("t8_resources", "select trajectory_id, string_agg(uri, ',' order by ts, event_id) as resources from (select *, row_number() over (partition by trajectory_id, uri order by ts, event_id) as n from (select trajectory_id, ts, event_id, '/'||action as uri from v_tool_events)) where n=1 group by 1")
def t8(t):
    r = C.context_resources(t.v_tool_events, F.concat(F.lit("/"), "action"))
    return r.select("trajectory_id", F.array_join("resources", ",").alias("resources"))


#: What runs say in place of a request, an end and feedback; every fifth run says nothing.
SAID = "select run_id, agent_id, created_at, o % 5 <> 0 as says, case when o % 3 = 0 then 'do '||run_id end as request, case when o % 7 <> 0 then status = 'completed' end as completed, case cast(o % 4 as int) when 0 then 'Not GOOD' when 1 then 'It did not work' when 2 then 'fine' end as feedback from (select *, cast(substring(run_id, 5) as bigint) as o from v_runs) r0"


def _said(t):
    o = F.substring("run_id", F.lit(5), F.length("run_id")).cast("bigint")
    feedback = F.when(o % 4 == 0, "Not GOOD").when(o % 4 == 1, "It did not work").when(o % 4 == 2, "fine")
    return t.v_runs.select("run_id", (o % 5 != 0).alias("says"), F.when(o % 3 == 0, F.concat(F.lit("do "), "run_id")).alias("request"), F.when(o % 7 != 0, F.col("status") == "completed").alias("completed"), feedback.alias("feedback"))


@query("t10_summary", "select run_id, case when not says or (request is null and completed is null and feedback is null) then 'Agent execution trace with '||cast(length(run_id) as varchar)||' bytes' else concat_ws(' | ', 'User request: '||request, 'Status: '||case when completed then 'Completed' when not completed then 'Abandoned' end, 'Feedback: '||feedback) end as summary from (" + SAID + ") s")
def t10(t):
    known = lambda c: F.when(F.col("says"), F.col(c))
    return _said(t).select("run_id", C.fallback_summary(known("request"), known("completed"), known("feedback"), F.octet_length("run_id")).alias("summary"))


@query("t11_score", "select run_id, round(greatest(0, least(1, cast(0.5 as double)+case when not says then 0 when completed then 0.2 else -0.2 end+case when not says or feedback is null then 0 when feedback='Not GOOD' then 0.2 when feedback='It did not work' then -0.2 else 0 end)), 6) as score, 'Heuristic score based on: '||case when not says then 'no clear signals' else concat_ws(', ', case when completed then 'Task completed' else 'Task not completed' end, case feedback when 'Not GOOD' then 'Positive user feedback' when 'It did not work' then 'Negative user feedback' end) end as reasoning from (" + SAID + ") s")
def t11(t):
    s = C.fallback_score(F.when(F.col("says"), F.struct("completed", "feedback")))
    return _said(t).select("run_id", s["score"].alias("score"), s["reasoning"].alias("reasoning"))


@query("t12_labels", "select agent_id, case when turns<=2 then 'simple' when turns>=10 then 'complex' else 'moderate' end as complexity, case when tools=0 and n<=10 then 'general' else concat_ws(',', case when tools>0 then 'tool_usage' end, case when n>10 then 'extended_interaction' end) end as tags from (select agent_id, count(case when background then 1 end) as turns, count(case when stop_reason is null then 1 end) as tools, count(*) as n from v_runs group by 1) g")
def t12(t):
    g = t.v_runs.groupBy("agent_id").agg(F.count_if("background").alias("turns"), F.count_if(F.col("stop_reason").isNull()).alias("tools"), F.count("*").alias("n"))
    x = C.fallback_labels(F.col("turns"), F.col("tools"), F.col("n"))
    return g.select("agent_id", x["complexity"].alias("complexity"), F.array_join(x["tags"], ",").alias("tags"))


@query("t13_enrich", "select trajectory_id, case when created_seq%3=0 then 'fallback' else upper(complexity_level) end as summary, case when created_seq%3=0 then 0.5 when created_seq%3=1 then 1.0 else 0.25 end as score, case when created_seq%3=2 then 'simple' else complexity_level end as level from v_trajectories")
def t13(t):
    """A provider that fails on every third row, oversteps the score on another third and invents levels on the rest."""

    def provider(b: pd.DataFrame) -> pd.DataFrame:
        third = b["created_seq"] % 3
        return pd.DataFrame({"summary": b["complexity_level"].str.upper().where(third != 0, None), "score": third.map({0: float("nan"), 1: 7.0, 2: 0.25}), "level": b["complexity_level"].where(third != 2, "odd")})

    rows = t.v_trajectories.select("trajectory_id", "created_seq", "complexity_level")
    made = C.enrich(rows, provider, {"summary": F.lit("fallback"), "score": F.lit(0.5), "level": F.lit("simple")})
    return made.select("trajectory_id", "summary", "score", "level")


@query("t14_judge", "select event_id, case when event_id%3=0 then cast(-1 as double) else cast(event_id%10 as double)/10 end as score from events")
def t14(t):
    n = (F.col("event_id") % 10 / 10).cast("string")
    answer = F.when(F.col("event_id") % 3 == 0, "no json").otherwise(F.concat(F.lit('Sure:\n```json\n{"score": '), n, F.lit(', "reason": "r"}\n```')))
    fallback = F.struct(F.lit(-1.0).alias("score"), F.lit("unparsed").alias("reason"))
    return t.events.select("event_id", C.judged(answer, "score double, reason string", ["score", "reason"], fallback)["score"].alias("score"))


@query("t15_typed_events", """with m as (select *, case cast(sequence_id%4 as int) when 0 then 'send_message' when 1 then 'search' end as tool, case when sequence_id%7=2 then 'approval' else role end as kind, case cast(sequence_id%3 as int) when 0 then true when 1 then false end as yes from v_messages),
e as (select sequence_id, 'reasoning' as event, message_id as body from m where sequence_id%5=0 union all select sequence_id, case when kind='assistant' and tool='search' then 'tool_call' else kind end, message_id from m where kind<>'approval' union all select sequence_id, case when yes is null then 'approval_request' else 'approval_response' end, case when yes is null then tool when yes then 'approve' else 'deny' end from m where kind='approval' and (yes is not null or tool is not null))
select sequence_id, event, body from e where event<>'system'""")
def t15(t):
    """All kinds of events but the system's, approvals among them."""
    n = F.col("sequence_id")
    tool = F.when(n % 4 == 0, "send_message").when(n % 4 == 1, "search")
    kind = F.when(n % 7 == 2, "approval").otherwise(F.col("role"))
    rows = t.v_messages.select("trajectory_id", "sequence_id", kind.alias("role"), F.col("message_id").alias("text"), F.when(n % 5 == 0, F.col("message_id")).alias("reasoning"), F.lit(None).cast("string").alias("call_id"), tool.alias("tool"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("approved"))
    kinds = ("reasoning", "tool_call", "tool_return", "assistant", "user", "approval_request", "approval_response")
    return C.typed_events(rows, types=kinds).select("sequence_id", "event", "body")


# ------------------------------------------------------------------------------------------------ stores and exports
def _written(t, rows, kind: str) -> str:
    """The path of rows written as files in the shared folder."""
    path = f"{jobs.shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"
    (rows.write.option("header", True).csv(path) if kind == "csv" else rows.write.option("compression", "gzip").json(path))
    return path


@query("s1_read_store", "select run_id, agent_id, status, coalesce(n, 0) as n_turns from v_runs r left join (select 'run-'||cast(l_orderkey as varchar) as id, count(*) as n from lineitem group by 1) s on r.run_id=s.id")
def s1(t):
    """Captured trajectories written as JSON documents and read with a schema."""
    path = _written(t, _captured(t).select("run_id", "agent_id", "metadata", "turns"), "json")
    rows = io.read_trajectories(t.spark, path, "run_id string, agent_id string, metadata struct<status:string>, turns array<struct<step_no:int>>", lines=True)
    return rows.select("run_id", "agent_id", "metadata.status", F.coalesce(F.size("turns"), F.lit(0)).cast("bigint").alias("n_turns"))


@query("s6_chat_log", "select row_number() over (partition by conv_id order by turn)-1 as turn, role, text from conversations")
def s6(t):
    """Conversations written as a chat log and read back."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    logs = t.conversations.groupBy("conv_id").agg(m.alias("messages")).select(F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return io.read_chat_log(t.spark, _written(t, logs, "json")).select("turn", "role", "text")


@query("s7_read_any", "select c_custkey, c_name, c_acctbal from customer")
def s7(t):
    """Customers written as CSV and read back."""
    return io.read_any(t.spark, _written(t, t.customer.select("c_custkey", "c_name", "c_acctbal"), "csv"), "csv", "c_custkey bigint, c_name string, c_acctbal double")


@query("s2_upsert", "select doc_id, lang, 3 as version, 'new' as origin from documents where doc_id%3=0 and lang='fr' union all select doc_id, lang, 2, 'old' from documents where not (doc_id%3=0 and lang='fr')")
def s2(t):
    """A store partitioned by language; an update with newer and older versions rewrites its own partition."""
    path = f"{jobs.shared_dir(t.spark)}/store-{uuid.uuid4().hex}"
    old = t.documents.select("doc_id", "lang", F.lit(2).alias("version"), F.lit("old").alias("origin"))
    io.write_trajectories(old, path, "lang")
    new = t.documents.where("doc_id % 3 < 2 and lang = 'fr'").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1).alias("version"), F.lit("new").alias("origin"))
    io.upsert_store(t.spark, path, new, "doc_id", part="lang")
    return t.spark.read.parquet(path).select("doc_id", "lang", "version", "origin")


@query("s3_promoted", "select r.run_id, r.agent_id as domain_type, r.created_at as timestamp_start, coalesce(s.model, '') as tags, r.status from v_runs r left join (select run_id, string_agg(distinct model, ',' order by model) as model from v_steps where step_no=3 group by 1) s on r.run_id=s.run_id")
def s3(t):
    p = io.promoted(_captured(t))
    return p.select("run_id", "domain_type", "timestamp_start", F.array_join("tags", ",").alias("tags"), F.get_json_object("data", "$.metadata.status").alias("status"))


@query("s4_list_files", "select 'documents.parquet' as name, 'parquet' as ext, count(*) as rows, count(distinct source) as sources from documents")
def s4(t):
    """Files found by a pattern, and what is read from them by path."""
    found = io.list_files(t.spark, t.sf_dir, "*.parquet").where("path like '%/documents.parquet%'").select("path", "ext")
    rows = t.documents.select(F.col("_metadata.file_path").alias("path"), "source").groupBy("path", "source").agg(F.count("*").alias("n"))
    met = rows.join(found.hint("merge"), "path")
    return met.agg(F.lit("documents.parquet").alias("name"), F.max("ext").alias("ext"), F.sum("n").alias("rows"), F.count_distinct("source").alias("sources"))


@query("s8_spans", "with d as (select trajectory_id, turn_index, count(*) as n from v_tool_events group by 1, 2) select trajectory_id as trace_id, 'trajectory' as name, count(*) as n from (select distinct trajectory_id from d) group by 1 union all select trajectory_id, 'turn', count(*) from d group by 1 union all select trajectory_id, 'decision', sum(n) from d group by 1")
def s8(t):
    return io.spans(decisions(t)).groupBy("trace_id", "name").agg(F.count("*").alias("n"))


@query("s9_traces", "with s as (select *, row_number() over (partition by trajectory_id, turn_index order by ts, event_id)-1 as i from v_tool_events) select trajectory_id, count(distinct turn_index) as n_generations, string_agg(cast(turn_index as varchar)||':'||cast(i as varchar)||action||coalesce('='||response_text, ''), ';' order by turn_index, i) as spans from s group by 1")
def s9(t):
    """Traces read back from their JSON."""
    trace, _ = io.traces(decisions(t))
    back = F.from_json("trace", "trajectory_id string, generations array<struct<turn_index:int,spans:array<struct<decision_index:int,id:string,name:string,output:string>>>>")
    told = lambda g: F.transform(g["spans"], lambda s: F.concat(g["turn_index"].cast("string"), F.lit(":"), s["decision_index"].cast("string"), s["name"], F.coalesce(F.concat(F.lit("="), s["output"]), F.lit(""))))
    return trace.select(back.alias("b")).select("b.trajectory_id", F.size("b.generations").cast("bigint").alias("n_generations"), F.array_join(F.flatten(F.transform("b.generations", told)), ";").alias("spans"))


@query("s9_scores", "select trajectory_id as trace_id, confidence as value from v_tool_events where confidence is not null")
def s9b(t):
    return io.traces(decisions(t))[1].select("trace_id", "value")


@query("s10_last_turns", "with u as (select *, row_number() over (partition by trajectory_id order by sequence_id desc) as r from v_messages where role='user'), c as (select trajectory_id, min(sequence_id) as cut from u where r<=2 group by 1), y as (select trajectory_id, min(sequence_id) as sys from v_messages where role='system' group by 1) select m.message_id from v_messages m left join c on m.trajectory_id=c.trajectory_id left join y on m.trajectory_id=y.trajectory_id where (role<>'system' and sequence_id>=coalesce(cut,0)) or sequence_id=sys")
def s10(t):
    return io.last_user_turns(t.v_messages, 2).select("message_id")


@query("s12_passage_rule", "select doc_id, (doc_id%2=0) <> (doc_id%3=0) as accepted from documents")
def s12(t):
    rule = io.passage_rule(F.when(F.col("doc_id") % 2 == 0, "a"), F.when(F.col("doc_id") % 3 == 0, "s"))
    return t.documents.select("doc_id", rule.alias("accepted"))


# ------------------------------------------------------------------------------------------------ streams
def run_updates(t, orders):
    """A stream of orders as run updates: the run as it ended, and a word from before that says it was cancelled."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    reason = F.create_map(*[F.lit(x) for p in {"1-URGENT": "error", "2-HIGH": "max_tokens", "3-MEDIUM": "end_turn", "5-LOW": "cancelled"}.items() for x in p])
    named = orders.select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("agent-"), F.col("o_custkey").cast("string")).alias("agent_id"), status.alias("status"), F.get(F.map_values(F.map_filter(reason, lambda k, _: k == F.col("o_orderpriority"))), F.lit(0)).alias("stop_reason"), (F.col("o_orderkey") % 3 == 0).alias("background"), F.col("o_orderdate").alias("created_at"))
    again = F.explode(F.array(F.struct(F.lit(1).alias("at"), F.col("status").alias("s")), F.struct(F.lit(0).alias("at"), F.when(F.col("status") != "running", "cancelled").alias("s")))).alias("again")
    return _runs(named.select("*", again).withColumns({"at": F.col("again.at"), "status": F.col("again.s")}).drop("again"))


@query("r1_continuous_capture", f"select c.*, r.status from ({CAPTURE}) c join v_runs r on c.run_id=r.run_id where r.status in ('completed', 'failed')")
def r1(t):
    """Trajectories of ended runs, captured from a stream of updates joined with steps and messages, merged by run."""
    got = jobs.capture_stream(run_updates(t, jobs.source(t.spark, f"{t.sf_dir}/orders.parquet")), t.v_steps, _messages(t))
    return _told(got, status=F.col("metadata.status"))


@query("r2_exactly_once", "select event_id, event_type from events")
def r2(t):
    """Every event arrives twice and is kept once."""
    return jobs.ingest_once(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", "event_type")


@query("r3_status_machine", "with a as (select user_id, event_type, value >= 20 as bad, row_number() over (partition by user_id order by event_id) as n from events), s as (select user_id, min(case when not coalesce(bad, false) then n end) as ok, count(*) as c, max(case when n=4 then event_type end) as fourth from a group by 1) select user_id, case when ok<=4 then 'completed' when c>=4 then 'failed' else 'processing' end as status, cast(case when ok<=4 then ok else least(c, 4) end as int) as attempts, case when not coalesce(ok<=4, false) and c>=4 then 'Failed after 3 retries: '||fourth||' failed' end as error from s")
def r3(t):
    """Attempts until the first good one, three retries at most, and the error of those that gave up."""
    return jobs.status_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("r4_file_timer", """with recursive e as (select user_id, row_number() over (partition by user_id order by epoch_us(ts)//1000, event_id) as i, epoch_us(ts)//1000 as ms, case event_type when 'view' then 'parsing' when 'click' then 'embedding' when 'purchase' then 'completed' else case when value > 100 then 'error' else 'parsing' end end as asked from events),
f as (select user_id, cast(0 as bigint) as i, cast(0 as bigint) as last, 'pending' as status, cast(null as varchar) as error, 0 as refused from e where i=1
union all select user_id, i, ms, case when legal then asked else s1 end, case when legal then case when asked='error' then 'asked to fail' end else e1 end, refused + case when legal then 0 else 1 end from
(select *, (asked='parsing' and s1 in ('pending','parsing')) or (asked='embedding' and s1 in ('parsing','embedding')) or (asked='completed' and s1 in ('embedding','completed')) or (asked='error' and s1 in ('pending','parsing','embedding')) as legal from
(select f.user_id, e.i, e.ms, asked, refused, case when status not in ('completed','error') and last>0 and ms-last > 86400000 then 'error' else status end as s1, case when status not in ('completed','error') and last>0 and ms-last > 86400000 then 'Processing timed out' else error end as e1 from f join e on e.user_id=f.user_id and e.i=f.i+1)))
select user_id, case when late then 'error' else status end as status, case when late then 'Processing timed out' else error end as error, refused from (select *, status not in ('completed','error') and last+86400000 < (select max(epoch_us(ts)//1000) from events) - 3600000 as late from f where (user_id, i) in (select user_id, max(i) from e group by 1))""")
def r4(t):
    """Legal steps only; files that are not final and hear nothing for a day of event time end in error."""
    return jobs.file_stream(t.spark, f"{t.sf_dir}/events.parquet", minutes=1440)


@query("r5_daily", "select cast(ts as date) as day, count(*) as n, avg(value) as avg_score from events group by 1")
def r5(t):
    """Only the windows that a batch changed are written; the table is read by key."""
    return jobs.daily_stream(jobs.source(t.spark, f"{t.sf_dir}/events.parquet"))


@query("r6_latency", "select event_type, time_bucket(interval 6 hour, ts) as start, count(*) as n from events group by 1, 2")
def r6(t):
    return jobs.latency_stream(jobs.source(t.spark, f"{t.sf_dir}/events.parquet"))


@query("r7_chunks", "with c as (select user_id as run, row_number() over (partition by user_id order by event_id) as seq, case when event_type='purchase' then 'complete' else 'delta' end as kind, cast(event_id as varchar) as body from events), d as (select *, min(case when kind='complete' then seq end) over (partition by run) as last from c) select run, seq, kind, body, kind='complete' as complete from d where seq > 1 and (last is null or seq <= last)")
def r7(t):
    """Chunks that come twice and in any order, each once and in order up to the end marker, replayed from the second on."""
    return jobs.chunk_stream(t.spark, f"{t.sf_dir}/events.parquet", after=1)


@query("r8_latest_status", "select user_id, max_by(event_type, event_id) as status from events group by 1")
def r8(t):
    return jobs.latest_status(t.spark, f"{t.sf_dir}/events.parquet")
