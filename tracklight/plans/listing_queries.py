"""Queries that list, filter, page and join operational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import analytics as A
from ..operators import listing as L
from ..operators import windows as W
from ..sources import io
from ..streaming import jobs
from .registry import query

TAGGED = lambda df: df.withColumn("tags", F.array_compact(F.array("domain_type", "task_category", "complexity_level")))


@query("f1_scope", "select run_id, status from v_runs where organization_id='org-1'")
def f1(t):
    return L.scoped(t.v_runs, "org-1").select("run_id", "status")


@query("f2_generic", "select event_id, action from v_tool_events where action in ('click', 'view') and json_extract_string(arguments, '$.k')='7' and lower(trajectory_id) like '%2024-01-1%' and event_id > 100 and event_id < 9000 and response_text is not null")
def f2(t):
    return L.matching(t.v_tool_events, {"action": ["click", "view"]}, {"arguments.k": "7"}, {"trajectory_id": "2024-01-1"}, ("event_id", 100), ("event_id", 9000), ["response_text"]).select("event_id", "action")


@query("f3_cursor_page", "with c as (select created_at, run_id from v_runs where run_id='run-500') select r.run_id, r.created_at from v_runs r, c where (r.created_at < c.created_at) or (r.created_at = c.created_at and r.run_id < c.run_id) order by r.created_at desc, r.run_id desc limit 25")
def f3(t):
    return L.page(t.v_runs, "run_id", 25, after="run-500").select("run_id", "created_at")


@query("f3_before_page", "with c as (select created_at, run_id from v_runs where run_id='run-500') select r.run_id, r.created_at from v_runs r, c where (r.created_at > c.created_at) or (r.created_at = c.created_at and r.run_id > c.run_id) order by r.created_at asc, r.run_id asc limit 25")
def f3b(t):
    return L.page(t.v_runs, "run_id", 25, before="run-500").select("run_id", "created_at")


@query("f4_middle", "with c as (select min(event_id) as lo, max(event_id) as hi from v_tool_events) select event_id from v_tool_events, c where event_id > lo and event_id < hi order by event_id limit 20 offset 10")
def f4(t):
    """The middle of what follows the first row and comes before the last (cursors taken from the data; one row)."""
    ends = t.v_tool_events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    rows = t.v_tool_events.select("event_id").join(F.broadcast(ends), (F.col("event_id") > F.col("lo")) & (F.col("event_id") < F.col("hi")))
    return L.middle(rows.select("event_id"), [F.col("event_id")], 20)


@query("f5_null_cursor", "select trajectory_id, outcome_score from v_trajectories where outcome_score is null and trajectory_id < 'doc-50' order by trajectory_id desc limit 20")
def f5(t):
    """After a cursor whose own value is null, only nulls follow."""
    rows = t.v_trajectories.where("outcome_score is null or trajectory_id <= 'doc-900'")
    first = rows.withColumn("outcome_score", F.when(F.col("trajectory_id") != "doc-50", F.col("outcome_score")))
    return L.page(first, "trajectory_id", 20, order="outcome_score", after="doc-50").select("trajectory_id", "outcome_score")


@query("f6_list", "select trajectory_id, outcome_score from v_trajectories where agent_id='agent-src3' and outcome_score>=0.3 and outcome_score<=0.9 order by created_seq desc limit 10 offset 2")
def f6(t):
    rows = t.v_trajectories.where((F.col("agent_id") == "agent-src3") & (F.col("outcome_score") >= 0.3) & (F.col("outcome_score") <= 0.9))
    return rows.orderBy(F.desc("created_seq")).offset(2).limit(10).select("trajectory_id", "outcome_score")


@query("f7_store_list", "select trajectory_id from v_trajectories where domain_type='en' and (task_category='debugging' or complexity_level='expert' or domain_type='xx') order by created_seq desc limit 50")
def f7(t):
    rows = TAGGED(t.v_trajectories).where((F.col("domain_type") == "en") & L.any_tag(F.col("tags"), ["debugging", "expert", "xx"]))
    return rows.orderBy(F.desc("created_seq")).limit(50).select("trajectory_id")


@query("f7_substring_mode", "select trajectory_id from v_trajectories where coalesce(task_category,'') like '%gen%' or complexity_level like '%gen%' or domain_type like '%gen%' or coalesce(task_category,'') like '%triv%' or complexity_level like '%triv%' or domain_type like '%triv%'")
def f7b(t):
    return TAGGED(t.v_trajectories).where(L.any_tag(F.col("tags"), ["gen", "triv"], substring=True)).select("trajectory_id")


@query("f8_tags_all", "select trajectory_id from v_trajectories where task_category='design' and complexity_level='simple'")
def f8(t):
    return TAGGED(t.v_trajectories).where(L.all_tags(F.col("tags"), ["design", "simple"])).select("trajectory_id")


@query("f9_tags_any", "select passage_id, tag_lang='fr' or tag_size='long' as any_, tag_lang='fr' and tag_size='long' as all_ from v_passages")
def f9(t):
    tags = F.array("tag_lang", "tag_size")
    return t.v_passages.select("passage_id", L.any_tag(tags, ["fr", "long"]).alias("any_"), L.all_tags(tags, ["fr", "long"]).alias("all_"))


@query("f10_agents", "select c_custkey, c_name from customer c where lower(c_name) like '%1%' and c_nationkey in (1,2,3) and exists (select 1 from v_agent_tags a where a.agent_id='agent-'||cast(c_custkey as varchar) and a.tag='t2')")
def f10(t):
    agents = t.customer.withColumn("agent_id", F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")))
    rows = L.matching(agents, {"c_nationkey": [1, 2, 3]}, contains={"c_name": "1"})
    return L.with_tags(rows, t.v_agent_tags, "agent_id", some=["t2"]).select("c_custkey", "c_name")


@query("f11_decisions", "select call_id from v_tool_events where action='click' and decision_type='tool_selection' and confidence>=0.1 and pivotal")
def f11(t):
    return L.matching(t.v_tool_events, {"action": "click", "decision_type": "tool_selection", "pivotal": True}).where(F.col("confidence") >= 0.1).select("call_id")


@query("f12_annotations", "select trajectory_id, evaluator_id, score from v_annotations where evaluator_type='model' and score>=0.5 and label='good' order by trajectory_id desc limit 40")
def f12(t):
    rows = L.matching(t.v_annotations, {"evaluator_type": "model", "label": "good"}).where("score >= 0.5")
    return rows.orderBy(F.desc("trajectory_id"), "evaluator_id").limit(40).select("trajectory_id", "evaluator_id", "score")


@query("f13_grain", "select trajectory_id, turn_id, score from v_annotations where turn_id is null or turn_id=2")
def f13(t):
    return t.v_annotations.where("turn_id is null or turn_id = 2").orderBy(F.asc_nulls_first("turn_id"), "trajectory_id").select("trajectory_id", "turn_id", "score")


@query("f14_runs", "select r.run_id, m.num_steps, m.run_ns from v_runs r left join v_run_metrics m on r.run_id=m.run_id where status in ('completed','failed') and background and num_steps>=3 and run_ns<150000000 order by run_ns desc nulls last, r.run_id desc limit 200")
def f14(t):
    return L.list_runs(t.v_runs, t.v_run_metrics, ["completed", "failed"], background=True, steps=("gte", 3), duration=("lt", 150_000_000), order="run_ns", limit=200).select("run_id", "num_steps", "run_ns")


@query("f15_percentile", "with j as (select r.run_id, run_ns from v_runs r left join v_run_metrics m on r.run_id=m.run_id where organization_id='org-1') select run_id, run_ns from j where run_ns >= (select percentile_cont(0.9) within group (order by run_ns) from j)")
def f15(t):
    return L.above_percentile(L.with_metrics(L.scoped(t.v_runs, "org-1"), t.v_run_metrics), "run_ns", 0.9).select("run_id", "run_ns")


@query("f16_steps", "select run_id, step_no, model from v_steps where model='model-a' and feedback is null and created_at >= timestamp '1998-01-01' and created_at < timestamp '1999-01-01'")
def f16(t):
    return t.v_steps.where((F.col("model") == "model-a") & F.col("feedback").isNull() & (F.col("created_at") >= F.lit("1998-01-01").cast("date")) & (F.col("created_at") < F.lit("1999-01-01").cast("date"))).select("run_id", "step_no", "model")


@query("f17_messages", "select message_id from v_messages where role in ('user','assistant') and lower(text) like '%tion%' and sequence_id > 20000 order by sequence_id limit 60")
def f17(t):
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("tion").alias("text")))
    rows = t.v_messages.where(F.col("role").isin("user", "assistant") & L.text_in_content(content, "tion") & (F.col("sequence_id") > 20000))
    return rows.orderBy("sequence_id").limit(60).select("message_id")


@query("f18_jobs", "select run_id from v_runs where status='failed' and stop_reason='error' and created_at > timestamp '1996-01-01' order by created_at desc, run_id desc limit 50")
def f18(t):
    rows = L.matching(t.v_runs, {"status": "failed", "stop_reason": "error"}).where(F.col("created_at") > F.lit("1996-01-01").cast("date"))
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(50).select("run_id")


@query("f19_blocks", "select doc_id from documents where lower(text) like '%license%' and lang='en'")
def f19(t):
    return L.matching(t.documents, {"lang": "en"}, contains={"text": "License"}).select("doc_id")


@query("f20_batch_messages", "select s.run_id, s.step_no, r.status, m.num_steps from v_steps s join v_runs r on s.run_id=r.run_id join v_run_metrics m on m.run_id=r.run_id where r.status='running' and r.created_at >= timestamp '1998-01-01'")
def f20(t):
    running = t.v_runs.where((F.col("status") == "running") & (F.col("created_at") >= F.lit("1998-01-01").cast("date")))
    return t.v_steps.select("run_id", "step_no").join(running.select("run_id", "status"), "run_id").join(t.v_run_metrics.select("run_id", "num_steps"), "run_id")


@query("f21_date_range", "select event_id from v_tool_events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08'")
def f21(t):
    low, high = L.date_bounds("2024-01-05", "2024-01-07")
    ts = F.col("ts").cast("timestamp")
    return t.v_tool_events.where((ts >= low) & (ts <= high)).select("event_id")


@query("f22_glob", "select file_id, regexp_matches(file_name, '(?i)age.7\\.h.*l$') as by_glob, regexp_matches(file_name, '(?i)^PAGE[13]') as by_regex from v_files where regexp_matches(file_name, '(?i)age.7\\.h.*l$') or regexp_matches(file_name, '(?i)^PAGE[13]')")
def f22(t):
    """A glob matches at the end of a name, from any place; what isn't one is an expression."""
    glob, regex = (F.col("file_name").rlike(L.name_pattern(p)) for p in ("age?7.h*l", "^PAGE[13]"))
    return t.v_files.where(glob | regex).select("file_id", glob.alias("by_glob"), regex.alias("by_regex"))


@query("f23_tools", "select distinct action from v_tool_events where action not in ('click') and lower(action) like '%e%'")
def f23(t):
    return L.matching(t.v_tool_events.select("action").distinct(), contains={"action": "E"}, excluded={"action": ["click"]})


@query("f24_by_domain", "select trajectory_id, agent_id, searchable_summary as summary, 'own' as visibility from v_trajectories where domain_type='de' and organization_id='org-1' union all select '[REDACTED:'||substring(sha256('s'||trajectory_id),1,8)||']', '[REDACTED:'||substring(sha256('s'||agent_id),1,8)||']', searchable_summary, 'shared' from v_trajectories where domain_type='de' and organization_id<>'org-1' and share_cross_org")
def f24(t):
    """Own trajectories of a domain and those that others share: summaries stay, ids are hashed."""
    rows = t.v_trajectories.select("trajectory_id", "agent_id", F.col("searchable_summary").alias("summary"), "organization_id", "domain_type", "share_cross_org")
    hide = lambda d: d.withColumns({c: X.redacted(c, "s") for c in ("trajectory_id", "agent_id")})
    return L.visible_across(rows, "org-1", "de", hide).select("trajectory_id", "agent_id", "summary", "visibility")


@query("f25_pages", "select source_id, file_id, cast((rn-1)//5 as bigint) as page, ((rn-1)//5+1)*5 < c as has_more from (select *, row_number() over (partition by source_id order by file_id) as rn, count(*) over (partition by source_id) as c from v_files)")
def f25(t):
    return L.pages_of(t.v_files, "source_id", [F.col("file_id")], 5).select("source_id", "file_id", F.col("page").cast("bigint").alias("page"), "has_more")


# ------------------------------------------------------------------------------------------------ joins
@query("j1_run_metrics", "select r.run_id, r.status, m.num_steps, m.run_ns from v_runs r left join v_run_metrics m on r.run_id=m.run_id")
def j1(t):
    return L.with_metrics(t.v_runs, t.v_run_metrics).select("run_id", "status", "num_steps", "run_ns")


@query("j2_agent_passages", "select a.agent_id, p.tag_size, count(*) as n, min(p.passage_id) as first_passage from (select distinct agent_id, 'archive-src'||cast(cast(substring(agent_id, 7) as bigint)%20 as varchar) as archive_id from v_agent_tags) a join v_passages p on a.archive_id=p.archive_id group by 1, 2")
def j2(t):
    """Passages of every agent through its archives, counted by size."""
    n = F.substring("agent_id", F.lit(7), F.length("agent_id")).cast("bigint")
    agents = t.v_agent_tags.select("agent_id").distinct()
    junction = agents.withColumn("archive_id", F.concat(F.lit("archive-src"), (n % 20).cast("string")))
    counts = L.counts_by(t.v_passages, ["archive_id", "tag_size"], "passage_id")
    return L.linked_counts(agents, junction, counts, "agent_id", "archive_id", ["tag_size"]).select("agent_id", "tag_size", "n", F.col("first").alias("first_passage"))


@query("j3_union_passages", "select passage_id as id, archive_id, cast(null as varchar) as source_id, 'archival' as kind from v_passages union all select file_id, null, source_id, 'source' from v_files")
def j3(t):
    return L.union_passages(t.v_passages.select(F.col("passage_id").alias("id"), "archive_id"), t.v_files.select(F.col("file_id").alias("id"), "source_id"))


@query("j4_exists_tags", "select distinct agent_id from v_agent_tags a where tag in ('t2','t4')")
def j4(t):
    return L.with_tags(t.v_agent_tags.select("agent_id").distinct(), t.v_agent_tags, "agent_id", some=["t2", "t4"])


@query("j5_match_tags", "select agent_id from v_agent_tags group by 1 having count(distinct case when tag in ('t0','t1') then tag end)=2 and count(case when tag in ('t3','t4') then 1 end)>0")
def j5(t):
    return L.with_tags(t.v_agent_tags.select("agent_id").distinct(), t.v_agent_tags, "agent_id", every=["t0", "t1"], some=["t3", "t4"]).orderBy("agent_id")


@query("j6_split", "select d.doc_id, case when l.doc_id is null then 'new' else 'known' end as side from documents d left join (select distinct doc_id from labels) l on d.doc_id=l.doc_id")
def j6(t):
    new, known = L.split_known(t.documents.select("doc_id"), t.labels, "doc_id")
    return new.withColumn("side", F.lit("new")).unionByName(known.withColumn("side", F.lit("known")))


@query("j7_counts_or_zero", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey=o_custkey group by 1 having count(o_orderkey) < 12")
def j7(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return L.counted(t.customer.select("c_custkey"), counts, "c_custkey", "n").where("n < 12")


@query("j8_source_files", "select s.source_id, f.file_id from (select distinct source_id from v_files) s left join (select * from v_files where not is_deleted and size > 3000) f on s.source_id=f.source_id")
def j8(t):
    live = t.v_files.where("not is_deleted and size > 3000").select("source_id", "file_id")
    return t.v_files.select("source_id").distinct().join(live, "source_id", "left")


@query("j10_bulk_update", "select run_id, agent_id, case when cast(substring(run_id, 5) as bigint)%5=0 then 'updated' else status end as status from v_runs")
def j10(t):
    updates = t.v_runs.where(F.substring("run_id", F.lit(5), F.length("run_id")).cast("bigint") % 5 == 0).select("run_id", "agent_id", F.lit("updated").alias("status"))
    return L.bulk_update(t.v_runs.select("run_id", "agent_id", "status"), updates, ["run_id", "agent_id"], ["status"], strict=True)


@query("j11_ordered", "select trajectory_id, turn_index, event_id from v_tool_events where trajectory_id like 'traj-1-%'")
def j11(t):
    return t.v_tool_events.where(F.col("trajectory_id").startswith("traj-1-")).orderBy("trajectory_id", "turn_index", "event_id").select("trajectory_id", "turn_index", "event_id")


@query("j12_upsert", "select doc_id, 'new' as origin from documents where doc_id%3=0 union all select doc_id, 'old' from documents where doc_id%3<>0 and doc_id%2=0")
def j12(t):
    old = t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("origin"))
    return L.upsert(old, t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("origin")), "doc_id")


@query("j13_hydrate", "select m.message_id, m.role from v_messages m where lower(text) like '%erin%'")
def j13(t):
    hits = t.v_messages.where(F.lower("text").contains("erin")).select("message_id")
    return hits.join(t.v_messages.select("message_id", "role"), "message_id")


@query("j15_tool_ids", "select trajectory_id, string_agg(distinct cast(length(action) as varchar)||':'||action, ',' order by cast(length(action) as varchar)||':'||action) as tools from v_tool_events group by 1")
def j15(t):
    e = t.v_tool_events
    tools = e.select("action").distinct().withColumn("tool_id", F.concat(F.length("action").cast("string"), F.lit(":"), "action"))
    return e.select("trajectory_id", "action").join(tools, "action").groupBy("trajectory_id").agg(F.array_join(F.array_sort(F.collect_set("tool_id")), ",").alias("tools"))


@query("j16_step_trace", "select s.run_id, s.step_no, part from v_steps s join (select 'run-'||cast(l_orderkey as varchar) as run_id, l_linenumber as step_no, cast(l_partkey as bigint) as part from lineitem where l_linenumber=1) p on s.run_id=p.run_id and s.step_no=p.step_no")
def j16(t):
    traces = t.lineitem.where("l_linenumber = 1").select(F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"), F.col("l_linenumber").alias("step_no"), F.col("l_partkey").cast("bigint").alias("part"))
    return t.v_steps.select("run_id", "step_no").join(traces, ["run_id", "step_no"])


GONE = "(trajectory_id in (select trajectory_id from v_messages where role='system') and role<>'system')"


@query("j17_delete", f"select 'message' as kind, message_id as id from v_messages m where not {GONE} union all select 'part', m.message_id||'/'||cast(p as varchar) from v_messages m, range(2) x(p) where not {GONE} union all select 'archive', archive_id from (select distinct archive_id from v_passages) a where archive_id > 'archive-src15'")
def j17(t):
    """Messages by agent with exclusions, and their parts with them; a store whose partitions go or stay whole."""
    m = t.v_messages
    doomed = m.join(m.where("role = 'system'").select("trajectory_id"), "trajectory_id", "left_semi").select("message_id")
    parts = m.select("message_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).select(F.concat("message_id", F.lit("/"), F.col("p").cast("string")).alias("id"), F.col("message_id").alias("owner"))
    left, left_parts = L.delete_with_dependants(m.select("message_id"), doomed, "message_id", [(parts, "owner")], spare=m.where("role = 'system'"))
    path = f"{jobs.shared_dir(t.spark)}/passages-{uuid.uuid4().hex}"
    io.write_trajectories(t.v_passages.select("passage_id", "archive_id"), path, "archive_id")
    io.delete_from_store(t.spark, path, t.v_passages.where("archive_id <= 'archive-src15'").select("passage_id"), "passage_id", "archive_id")
    stored = t.spark.read.parquet(path).select(F.lit("archive").alias("kind"), F.col("archive_id").alias("id")).distinct()
    return left.select(F.lit("message").alias("kind"), F.col("message_id").alias("id")).unionByName(left_parts.select(F.lit("part").alias("kind"), "id")).unionByName(stored)


# ------------------------------------------------------------------------------------------------ windows
@query("w1_ordinals", "select event_id, row_number() over (partition by trajectory_id, turn_index order by ts, event_id)-1 as n from v_tool_events")
def w1(t):
    return W.ordinal(t.v_tool_events, ["trajectory_id", "turn_index"], ["ts", "event_id"], "n").select("event_id", "n")


@query("w2_first_seen", "select agent_id, action, min(event_id) as event_id from v_tool_events group by 1, 2")
def w2(t):
    return W.top_per(t.v_tool_events.select("agent_id", "action", "event_id"), ["agent_id", "action"], [F.col("event_id")], 1).drop("rank")


W_MESSAGES = """with m as (select user_id as conversation, event_id as seq, case when event_id%3=0 then 'assistant' when event_id%3=1 then 'tool' else 'user' end as role, 'c'||cast(event_id//3 as varchar) as cid from events) """


def _dialogue(t):
    e = t.events
    role = F.when(e.event_id % 3 == 0, "assistant").when(e.event_id % 3 == 1, "tool").otherwise("user")
    return e.select(F.col("user_id").alias("conversation"), F.col("event_id").alias("seq"), role.alias("role"), F.concat(F.lit("c"), F.floor(F.col("event_id") / 3).cast("string")).alias("cid"), "event_type")


@query("w3_backfill_ids", W_MESSAGES + """, g as (select *, (select count(*) from (select 1)) as one, last_value(case when role='assistant' then seq when role='tool' then -seq end ignore nulls) over (partition by conversation order by seq rows between unbounded preceding and 1 preceding) as mark from m)
select g.seq, a.cid as tool_call_id from g left join m a on g.mark=a.seq where g.role='tool'""")
def w3(t):
    m = _dialogue(t).select("conversation", "seq", "role", F.when(F.col("role") == "assistant", F.array("cid")).otherwise(F.array().cast("array<string>")).alias("calls"), F.lit(None).cast("string").alias("tool_call_id"))
    return W.backfill_call_ids(m).where("role = 'tool'").select("seq", "tool_call_id")


@query("w4_combine", W_MESSAGES.replace("from events)", "from events where event_id%7<>0)") + """, x as (select *, case when role='assistant' then case when seq%5=0 then 'send_message' else 'run' end when role='tool' then case when (seq-1)%5=0 then 'send_message' else 'run' end end as name, 't'||cast(seq as varchar) as said from m),
n as (select *, lead(role) over w as nr, lead(cid) over w as nc, lead(name) over w as nn, lead(seq) over w as ns, lag(role) over w as pr, lag(cid) over w as pc from x window w as (partition by conversation order by seq))
select seq, role, case when role='assistant' and nr='tool' and nc=cid and nn='send_message' then said when role='assistant' and nr='tool' and nc=cid then said||' | run(k='||cast(seq as varchar)||', s='||chr(39)||cid||chr(39)||', b=True) | '||case when ns%2=0 then 'done '||cast(ns as varchar) else 'Status: s'||cast(ns as varchar) end when role='assistant' and name='send_message' then said||' / hi' when role='tool' then case when seq%2=0 then '{"message": "done '||cast(seq as varchar)||'"}' else '{"status": "s'||cast(seq as varchar)||'"}' end else said end as text
from n where not (role='tool' and coalesce(pr,'')='assistant' and pc=cid) and not (role='tool' and name='send_message')""")
def w4(t):
    """Calls with the returns that answer one of them, read back from their JSON."""
    n, role = F.col("seq"), F.col("role")
    name = F.when(role == "assistant", F.when(n % 5 == 0, "send_message").otherwise("run")).when(role == "tool", F.when((n - 1) % 5 == 0, "send_message").otherwise("run"))
    args = F.when(name == "send_message", F.lit('{"message": "hi"}')).otherwise(F.concat(F.lit('{"k": '), n.cast("string"), F.lit(', "s": "'), "cid", F.lit('", "b": true}')))
    calls = F.when(role == "assistant", F.array(F.struct(F.lit("other").alias("id"), F.lit("run").alias("name"), F.lit("{}").alias("arguments")), F.struct(F.col("cid").alias("id"), name.alias("name"), args.alias("arguments"))))
    result = F.when(n % 2 == 0, F.concat(F.lit('{"message": "done '), n.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"status": "s'), n.cast("string"), F.lit('"}')))
    m = _dialogue(t).where("seq % 7 <> 0").select("conversation", "seq", "role", F.when(role == "tool", result).otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("text"), F.when(role == "tool", name).alias("name"), calls.alias("calls"), F.when(role == "tool", F.col("cid")).alias("tool_call_id"))
    j = lambda k: F.get_json_object("text", f"$.{k}")
    told = F.when(j("tool_call").isNotNull(), F.concat_ws(" | ", j("thinking"), j("tool_call"), j("tool_result"))).when(j("thinking").isNotNull(), F.concat_ws(" / ", j("thinking"), j("content"))).when(j("content").isNotNull(), j("content")).otherwise(F.col("text"))
    return W.combine_with_response(m).select("seq", "role", told.alias("text"))


@query("w5_lru", """with o as (select agent_id, max(file_id) as file_id from v_open_files where not is_open group by 1), f as (select v.*, o.file_id is not null as fresh from v_open_files v left join o on v.agent_id=o.agent_id and v.file_id=o.file_id),
r as (select *, (is_open or fresh) and row_number() over (partition by agent_id, (is_open or fresh) order by fresh desc, last_accessed_at desc, file_id) <= 5 as stays from f) select agent_id, file_id, stays, is_open and not stays as closed from r""")
def w5(t):
    """Each agent opens one of its closed files; the least recently used ones make room."""
    opened = t.v_open_files.where("not is_open").groupBy("agent_id").agg(F.max("file_id").alias("file_id"))
    return W.evict_open_files(t.v_open_files, 5, opened).select("agent_id", "file_id", "stays", "closed")


@query("w6_block_history", """with recursive e as (select user_id as b, event_id as "at", row_number() over (partition by user_id order by event_id) as i, case cast(event_id%5 as int) when 3 then 'undo' when 4 then 'redo' else 'checkpoint' end as kind, event_type as value from events),
f as (select b, i, "at", 1 as pos, [value] as vals from (select * from e where i=1 and kind='checkpoint') union all select b, i, "at", 0, cast([] as varchar[]) from e where i=1 and kind<>'checkpoint'
union all select e.b, e.i, e."at", case e.kind when 'checkpoint' then pos+1 when 'undo' then greatest(pos-1, least(pos, 1)) else least(pos+1, len(vals)) end, case when e.kind='checkpoint' then list_append(list_slice(vals, 1, pos), e.value) else vals end from f join e on e.b=f.b and e.i=f.i+1)
select b as block_id, "at", pos as sequence, vals[pos] as value, len(vals) as checkpoints from f""")
def w6(t):
    n = F.col("event_id") % 5
    kind = F.when(n == 3, "undo").when(n == 4, "redo").otherwise("checkpoint")
    return W.block_versions(t.events.select(F.col("user_id").alias("block_id"), F.col("event_id").alias("at"), kind.alias("kind"), F.col("event_type").alias("value")))


@query("w7_unique_names", """with f as (select file_id, source_id, is_deleted, case when cast(substring(file_id, 6) as bigint)%3=0 then repeat('y', 260)||'.'||file_name else file_name end as name from v_files), s as (select *, left(left(name, length(name)-5), 244) as base from f)
select file_id, source_id||'/'||base||case when k>0 then '_('||cast(k as varchar)||')' else '' end||'.html' as unique_name from (select *, coalesce(sum(case when is_deleted then 0 else 1 end) over (partition by source_id, base order by file_id rows between unbounded preceding and 1 preceding), 0) as k from s)""")
def w7(t):
    """Every third name is too long and is cut."""
    third = F.substring("file_id", F.lit(6), F.length("file_id")).cast("bigint") % 3 == 0
    name = F.when(third, F.concat(F.lit("y" * 260 + "."), "file_name")).otherwise(F.col("file_name"))
    return W.unique_names(t.v_files.withColumns({"file_name": name, "source_name": F.col("source_id")})).select("file_id", "unique_name")


@query("w8_top_k", "select event_id from v_tool_events where confidence is not null order by confidence desc, ts desc, event_id limit 20")
def w8(t):
    return t.v_tool_events.where("confidence is not null").orderBy(F.desc("confidence"), F.desc("ts"), "event_id").limit(20).select("event_id")


@query("w9_tiers", "select tier, trajectory_id, rank from (select *, row_number() over (partition by tier order by outcome_score desc, trajectory_id) as rank from (select *, case when outcome_score>=0.7 then 'success' when outcome_score<=0.3 then 'failure' else 'moderate' end as tier from v_trajectories where outcome_score is not null)) where rank<=5")
def w9(t):
    return W.tiers(t.v_trajectories, "outcome_score", [F.desc("outcome_score"), F.col("trajectory_id")], 5).select("tier", "trajectory_id", "rank")


@query("w10_time_ago", "select event_id, case when s<60 then cast(s as varchar)||'s ago' when s<3600 then cast(s//60 as varchar)||'m ago' when s<86400 then cast(s//3600 as varchar)||'h ago' else cast(s//86400 as varchar)||'d ago' end as ago from (select event_id, cast(epoch(timestamp '2024-02-01') - floor(epoch(ts)) as bigint) as s from events)")
def w10(t):
    return t.events.select("event_id", X.time_ago("ts", F.lit("2024-02-01").cast("timestamp_ntz")).alias("ago"))


@query("w11_concurrency", "with s as (select user_id, event_id as instant, 1 as d from events union all select user_id, event_id+cast(floor(value) as bigint)*20+1, -1 from events) select user_id, instant, d, sum(d) over (partition by user_id order by instant, d) as running from s")
def w11(t):
    calls = t.events.select("user_id", F.col("event_id").alias("begin"), (F.col("event_id") + F.floor("value").cast("bigint") * 20 + 1).alias("end"))
    return W.concurrency(calls, "begin", "end", "user_id").withColumnRenamed("at", "instant")


@query("w11_latency_cdf", "select event_id, cume_dist() over (partition by action order by duration_ms) as share from v_tool_events where duration_ms is not null")
def w11b(t):
    return A.cumulative_share(t.v_tool_events.where("duration_ms is not null").select("event_id", "action", "duration_ms"), "duration_ms", ["action"]).select("event_id", "share")


@query("w12_view", "select doc_id, case when doc_id%4=0 then '' when length(text)>200 then substring(text, 1, 200-" + str(len(W.TRUNCATED)) + ")||'...[TRUNCATED]'||chr(10)||'# NOTE: This block is truncated, use functions to view the full content.' else coalesce(text, '') end as shown from documents")
def w12(t):
    return t.documents.select("doc_id", W.visible_content(F.col("text"), F.col("doc_id") % 4 != 0, 200).alias("shown"))


@query("w13_clean", """with m as (select user_id as conversation, event_id as seq, case cast(event_id%4 as int) when 0 then 'assistant' when 1 then 'approval' when 2 then 'tool' else 'user' end as role, case when event_id%7<>0 then props end as text,
case when event_id%4<2 and event_id%3<>0 then ['c'||cast(event_id//8 as varchar), 'd'||event_type] else [] end as calls, case when event_id%4=2 then 'c'||cast(event_id//12 as varchar) end as call_id, event_id%5=0 as is_summary, case when event_id%4=1 and event_id%3=0 then true end as approved from events),
a as (select *, coalesce(lead(is_summary) over w, false) as s1, lead(seq, 2) over w as q2, lead(approved, 2) over w as a2 from m window w as (partition by conversation order by seq)), b as (select * from a where not (role='approval' and len(calls)>0 and s1 and (q2 is null or a2 is not null))),
c as (select *, row_number() over (partition by conversation order by seq desc) as r, coalesce(lead(role='approval' and len(calls)>0) over (partition by conversation order by seq), false) as n1 from b), d as (select * from c where not ((r=1 and role='approval' and len(calls)>0) or (r=2 and n1 and role='assistant' and len(calls)>0))),
e as (select *, max(seq) over (partition by conversation) as l from d), f as (select * from e where not (seq=l and role='assistant' and len(calls)=0 and coalesce(text, '')='')),
g as (select *, coalesce(lead(role='approval' and len(calls)>0) over w, false) as nj, lead(text) over w as nt, lead(calls) over w as nc, coalesce(lag(role='assistant' and len(calls)>0) over w, false) as pj from f window w as (partition by conversation order by seq)),
h as (select conversation, seq, role, case when nj and role='assistant' and len(calls)>0 then coalesce(text,'')||coalesce(nt,'') else text end as text, case when nj and role='assistant' and len(calls)>0 then list_concat(calls, nc) else calls end as calls, call_id from g where not (role='approval' and len(calls)>0 and pj)),
k as (select *, row_number() over (partition by conversation, role, call_id order by seq) as n from h)
select conversation, seq, role, text, case when role='assistant' then (select string_agg(x, ',' order by i) from (select unnest(calls) as x, generate_subscripts(calls, 1) as i) u where list_position(calls, x)=i) else array_to_string(calls, ',') end as calls from k where role<>'tool' or call_id is null or n=1""".replace("case when role='assistant' then (select", "case when role='assistant' then coalesce((select").replace("list_position(calls, x)=i) else", "list_position(calls, x)=i), '') else"))
def w13(t):
    e, n = t.events, F.col("event_id")
    role = F.when(n % 4 == 0, "assistant").when(n % 4 == 1, "approval").when(n % 4 == 2, "tool").otherwise("user")
    group = lambda by: F.concat(F.lit("c"), F.floor(n / by).cast("string"))
    m = e.select(
        F.col("user_id").alias("conversation"), n.alias("seq"), role.alias("role"), F.when(n % 7 != 0, F.col("props")).alias("text"), F.when((n % 4 < 2) & (n % 3 != 0), F.array(group(8), F.concat(F.lit("d"), "event_type"))).alias("calls"),
        F.when(n % 4 == 2, group(12)).alias("call_id"), (n % 5 == 0).alias("is_summary"), F.when((n % 4 == 1) & (n % 3 == 0), True).alias("approved"),
    )
    return W.clean_conversation(m).select("conversation", "seq", "role", "text", F.array_join("calls", ",").alias("calls"))
