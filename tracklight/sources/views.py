"""Canonical tables (tool calls, runs, steps, messages, ...) derived from the given tables.

The text of each view runs on Spark (table names in braces are DataFrames) and, with plain names, as a common table
expression in the SQL that checks a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_tool_events": """
select event_id, 'traj-'||cast(user_id as varchar(20))||'-'||cast(cast(ts as date) as varchar(10)) as trajectory_id,
'agent-'||cast(user_id%10 as varchar(20)) as agent_id, 'org-'||cast(user_id%4 as varchar(20)) as organization_id, 'domain-'||cast(user_id%3 as varchar(20)) as domain_type,
ts, cast(hour(ts) as int) as turn_index, 'call-'||cast(event_id as varchar(20)) as call_id, event_type as action, props as arguments,
case when event_id%17=0 then null when value>=150 then 'Error: timeout while calling '||event_type when value>=120 then 'Validation failed' when value>=100 then 'Permission denied: exception' when value>=90 then 'failed: not found' when value>=80 then 'Traceback: invalid state' else 'ok '||props end as response_text,
round(value/500,4) as confidence, value*10 as duration_ms, event_id%11=0 as pivotal,
case cast(event_id%4 as int) when 0 then 'tool_selection' when 1 then 'parameter_choice' when 2 then 'reasoning_step' else null end as decision_type from {events}""",
    "v_runs": """
select 'run-'||cast(o_orderkey as varchar(20)) as run_id, 'agent-'||cast(o_custkey as varchar(20)) as agent_id, 'org-'||cast(c_nationkey%4 as varchar(20)) as organization_id,
case o_orderstatus when 'F' then 'completed' when 'P' then 'failed' else 'running' end as status,
case o_orderpriority when '1-URGENT' then 'error' when '2-HIGH' then 'max_tokens' when '3-MEDIUM' then 'end_turn' when '5-LOW' then 'cancelled' else null end as stop_reason,
o_orderkey%3=0 as background, o_orderdate as created_at from {orders} join {customer} on o_custkey=c_custkey""",
    "v_run_metrics": """
select 'run-'||cast(l_orderkey as varchar(20)) as run_id, cast(sum(l_quantity)*1000000 as bigint) as run_ns, cast(count(*) as int) as num_steps from {lineitem} where l_orderkey%10<>0 group by l_orderkey""",
    "v_steps": """
select 'run-'||cast(l_orderkey as varchar(20)) as run_id, l_linenumber as step_no, cast(l_quantity*100 as bigint) as prompt_tokens, cast(floor(l_extendedprice/100) as bigint) as completion_tokens,
case when l_discount>0.05 then cast(l_quantity*10 as bigint) else null end as cached_tokens, case when l_tax>0.04 then cast(l_quantity*5 as bigint) else null end as cache_write_tokens, case when l_linenumber<=2 then cast(l_quantity*3 as bigint) else null end as reasoning_tokens,
case l_returnflag when 'A' then 'model-a' when 'N' then 'vendor/model-n' else 'model-r-2024-x' end as model, case l_linestatus when 'O' then 'positive' else null end as feedback, l_shipdate as created_at from {lineitem}""",
    "v_messages": """
select 'conv-'||cast(conv_id as varchar(20)) as trajectory_id, 'msg-'||cast(conv_id as varchar(20))||'-'||cast(turn as varchar(20)) as message_id, conv_id*1000+turn as sequence_id, cast(turn as int) as turn_index, role, text from {conversations}""",
    "v_annotations": """
select 'doc-'||cast(doc_id as varchar(20)) as trajectory_id, cast(null as int) as turn_id, 'quality-model' as evaluator_id, 'model' as evaluator_type, cast(quality as double) as score, case when quality=1 then 'good' else 'bad' end as label from {labels}
union all select 'doc-'||cast(doc_id as varchar(20)), cast(doc_id%5 as int), 'safety-rules', 'heuristic', cast(1-toxic as double), case when toxic=1 then 'toxic' else null end from {labels}""",
    "v_trajectories": """
select 'doc-'||cast(d.doc_id as varchar(20)) as trajectory_id, 'agent-'||source as agent_id, 'org-'||cast(d.doc_id%4 as varchar(20)) as organization_id, lang as domain_type, d.doc_id%2=0 as share_cross_org,
text as searchable_summary, case when l.doc_id is null then null else (cast(0.6 as double)*quality+cast(0.4 as double)*(1-toxic)) end as outcome_score,
case when n_chars<500 then 'trivial' when n_chars<2000 then 'simple' when n_chars<6000 then 'moderate' when n_chars<15000 then 'complex' else 'expert' end as complexity_level,
case cast(d.doc_id%5 as int) when 0 then 'debugging' when 1 then 'research' when 2 then 'code_generation' when 3 then 'design' else null end as task_category,
case cast(d.doc_id%7 as int) when 0 then 'failed' when 1 then 'pending' else 'completed' end as processing_status, d.doc_id as created_seq, e.embedding
from {documents} d left join {labels} l on d.doc_id=l.doc_id left join {embeddings} e on e.vec_id=d.doc_id""",
    "v_passages": """
select 'passage-'||cast(doc_id as varchar(20)) as passage_id, 'archive-'||source as archive_id, lang as tag_lang, case when n_chars>2000 then 'long' else 'short' end as tag_size, text from {documents}""",
    "v_queries": "select vec_id as query_id, embedding as query_embedding from {embeddings} where vec_id%50=0",
    "v_agent_tags": """
select distinct agent_id, tag from (select 'agent-'||cast(c_custkey as varchar(20)) as agent_id, 't'||cast(c_custkey%2 as varchar(20)) as tag from {customer}
union all select 'agent-'||cast(c_custkey as varchar(20)), 't'||cast(c_custkey%3 as varchar(20)) from {customer}
union all select 'agent-'||cast(c_custkey as varchar(20)), 't'||cast(c_custkey%5 as varchar(20)) from {customer}) x""",
    "v_files": """
select 'file-'||cast(page_id as varchar(20)) as file_id, 'source-'||cast(page_id%7 as varchar(20)) as source_id, 'page'||cast(page_id%50 as varchar(20))||'.html' as file_name, cast(length(html) as bigint) as size, page_id%13=0 as is_deleted, html from {pages}""",
    "v_open_files": """
select 'agent-'||cast(user_id as varchar(20)) as agent_id, 'file-'||cast(event_id as varchar(20)) as file_id, event_id%3<>0 as is_open, ts as last_accessed_at from {events}""",
    "v_prices": """
select 'model-a' as model, cast(5 as double) as input, cast(25 as double) as output, cast(0.5 as double) as cached, cast(6 as double) as cache_write, cast(30 as double) as reasoning
union all select 'model-n', cast(1 as double), cast(4 as double), cast(0.1 as double), cast(null as double), cast(5 as double) union all select 'model-r-2024', cast(2 as double), cast(8 as double), cast(0.2 as double), cast(2.4 as double), cast(null as double)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table, or one of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}) if used else spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """``sql`` with the canonical tables that it names as common table expressions before its own."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    plain = {t: t for t in TABLES}
    ctes = ", ".join(f"{v} as ({VIEWS[v].format(**plain).strip()})" for v in named)
    if not ctes:
        return sql
    body = sql.strip()
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"
