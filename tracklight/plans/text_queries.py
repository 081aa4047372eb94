"""Queries on texts, conversations, token budgets and privacy (with the SQL that checks them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import capture as C2
from ..operators import listing as L
from ..operators import privacy as P
from ..operators import search as S
from ..operators import text as C
from . import record_queries as R
from .decision_queries import decisions
from .registry import query


LINES = "l as (select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) as v from documents)"


@query("c1_lines", f"with {LINES} select doc_id, generate_subscripts(v, 1) as line_no, unnest(v) as line from l")
def c1(t):
    return C.line_chunks(t.documents)


@query("c1_view", f"with {LINES} select doc_id, case when len(v)>2 then array_to_string(list_prepend('[Viewing lines 3 to '||cast(least(6, len(v)) as varchar)||' (out of '||cast(len(v) as varchar)||' lines)]', list_transform(v[3:6], lambda x, i: cast(i+2 as varchar)||': '||x)), chr(10)) end as shown, case when len(v)<=2 then 'only '||cast(len(v) as varchar)||' lines, but requested offset 3 is out of range' end as error from l where v is not null")
def c1b(t):
    """Lines 3 to 6 of every file, numbered, under a header; files that are too short say so."""
    view = C.file_view(C.lines_of(F.col("text")), start=2, end=6)
    return t.documents.where("text is not null").select("doc_id", view.alias("v")).select("doc_id", F.array_join("v.lines", "\n").alias("shown"), "v.error")


@query("c2_sentences", r"select doc_id, len(s) as n, array_to_string(s, '#') as sentences from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as s from documents)")
def c2(t):
    s = C.sentence_chunks(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_join("s", "#").alias("sentences"))


@query("c3_wrap")
def c3(t):
    """Every line of word-wrapped texts (tests hold it against a plain loop)."""
    return t.documents.select("doc_id", F.posexplode(C.wrap_chunks(F.col("text"))).alias("line_no", "line"))


@query("c4_strategy", "select file_id, case when cast(substring(file_id, 6) as bigint)%4=0 then 'structured_data' when cast(substring(file_id, 6) as bigint)%4=1 then 'documentation' else 'line_based' end as strategy from v_files")
def c4(t):
    n = F.substring("file_id", F.lit(6), F.length("file_id")).cast("bigint") % 4
    files = t.v_files.select("file_id", F.when(n == 0, "application/json").alias("mime"), F.when(n == 1, "a.md").otherwise("a.bin").alias("file_name"))
    types = t.spark.sql("select 'application/json' as mime, 'json' as ext, 'structured_data' as strategy union all select 'text/markdown', 'md', 'documentation' union all select 'text/x-python', 'py', 'code'")
    return C.chunk_strategy(files, types).select("file_id", "strategy")


@query("c5_fixed_chunks", r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents), s as (select doc_id, w, unnest(range(0, greatest(0, len(w)-11)+1, 40)) as i from w where len(w) > 0) select doc_id, i, array_to_string(list_slice(w, i+1, i+50), ' ') as chunk from s""")
def c5(t):
    made = t.documents.select("doc_id", F.posexplode(C.fixed_chunks(F.col("text"), 50, 10)).alias("pos", "chunk"))
    return made.select("doc_id", (F.col("pos") * 40).cast("bigint").alias("i"), "chunk")


GREP = "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), c as (select *, lag(line) over w as before, lead(line) over w as after from l window w as (partition by doc_id order by line_no)), h as (select * from c where regexp_matches(line, '(?i)licen[sc]e')) "


@query("c6_grep", GREP + "select doc_id, line_no, line, coalesce(before, '') as before, coalesce(after, '') as after, cast((row_number() over (partition by doc_id order by line_no)-1)//20 as int) as page from h")
def c6(t):
    return C.grep(t.documents, "licen[sc]e", "doc_id", "text")


@query("a29_file_matches", GREP + "select doc_id, count(*) as n from h group by 1")
def a29(t):
    counted = t.documents.where(F.col("text").rlike("(?i)licen[sc]e")).select("doc_id", F.size(C.matching_lines(F.col("text"), "licen[sc]e", 0)).cast("bigint").alias("n"))
    return counted.where("n > 0").orderBy(F.desc("n"), "doc_id")


#: Messages with calls, returns, images, JSON texts, heartbeats and none at all.
CALLED = """c as (select *, case when text is null then '' else trim(text) end as bare, case cast(sequence_id%6 as int) when 0 then 'send_message' when 1 then 'conversation_search' when 2 then 'other' end as tool, case when sequence_id%4=0 then '{"message": "hi '||message_id||'"}' else 'not json' end as args, case cast(sequence_id%7 as int) when 3 then 1 when 4 then 2 else 0 end as images, case when sequence_id%5=0 then null when sequence_id%9=0 then '{"type": "heartbeat"}' when sequence_id%11=0 then '[1, 2]' else text end as said, case when role='user' and sequence_id%8=0 then 'tool' else role end as kind from v_messages)"""


def _called(t):
    n = F.col("sequence_id")
    tool = F.when(n % 6 == 0, "send_message").when(n % 6 == 1, "conversation_search").when(n % 6 == 2, "other")
    args = F.when(n % 4 == 0, F.concat(F.lit('{"message": "hi '), "message_id", F.lit('"}'))).otherwise("not json")
    said = F.when(n % 5 == 0, None).when(n % 9 == 0, '{"type": "heartbeat"}').when(n % 11 == 0, "[1, 2]").otherwise(F.col("text"))
    kind = F.when((F.col("role") == "user") & (n % 8 == 0), "tool").otherwise(F.col("role"))
    calls = F.when((kind == "assistant") & tool.isNotNull(), F.array(F.struct(tool.alias("name"), args.alias("arguments"))))
    return t.v_messages.select("trajectory_id", "message_id", "sequence_id", kind.alias("role"), said.alias("text"), F.when(kind == "tool", tool).alias("name"), calls.alias("calls"), F.when(n % 7 == 3, 1).when(n % 7 == 4, 2).otherwise(0).alias("images"))


@query("c7_search_text", f"""with {CALLED}, j as (select *, kind='assistant' and tool is not null as calls, case when said is null or kind='system' or (kind='tool' and coalesce(tool in ('send_message', 'conversation_search'), false)) or said like '{{"type": "heart%' or (kind='assistant' and coalesce(tool='conversation_search', false)) then 'none' when kind='assistant' and tool='send_message' and args<>'not json' then 'sent' when kind in ('user', 'assistant') and json_valid(said) then 'json' else 'plain' end as how from c)
select message_id, how, case when how='json' then said end as raw, case when how in ('plain', 'sent') then said end as said, case when how='sent' then 'hi '||message_id end as sent from j""")
def c7(t):
    """What search indexes, read back from its JSON."""
    j = C.searchable_message(F.col("role"), F.col("text"), F.col("name"), F.col("calls"))
    m = _called(t).select("message_id", j.alias("j"))
    read = lambda k: F.get_json_object("j", f"$.{k}")
    how = F.when(F.col("j") == "", "none").when(F.col("j").startswith('{"thinking": '), "sent").when(F.col("j").startswith('{"content": '), "plain").otherwise("json")
    return m.select("message_id", how.alias("how"), F.when(how == "json", F.col("j")).alias("raw"), F.when(how == "plain", read("content")).when(how == "sent", read("thinking")).alias("said"), F.when(how == "sent", read("content")).alias("sent"))


@query("c8_transcript", f"""with {CALLED}, x as (select *, case when said is not null or images>0 then concat_ws(' ', nullif(trim(said, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), ''), case images when 1 then '[Image omitted]' when 2 then '[2 images omitted]' end) when kind='assistant' and tool='send_message' and args<>'not json' then 'hi '||message_id when kind='assistant' and tool is not null then args end as shown from c where kind<>'system' and not (kind='tool' and coalesce(tool='send_message', false) and (said is not null or images>0)))
select trajectory_id, string_agg(kind||': '||shown, chr(10) order by sequence_id) as transcript from x where shown is not null group by 1""")
def c8(t):
    return C.transcript(_called(t))


@query("c9_middle_cut", "select doc_id, case when n>100 then substring(text,1,30)||chr(10)||'[TRUNCATED: dropped '||cast(n-60 as varchar)||' middle chars due to context budget]'||chr(10)||substring(text, n-30+1, greatest(0, 30-greatest(0, 58+length(cast(n-60 as varchar))-40))) else text end as cut, case when n>100 then n-60 else 0 end as dropped from (select doc_id, text, length(text) as n from documents) d")
def c9(t):
    return t.documents.select("doc_id", C.middle_cut(F.col("text"), 100).alias("c")).select("doc_id", F.col("c.text").alias("cut"), F.col("c.dropped").alias("dropped"))


@query("c10_tokens", "select doc_id, cast((strlen(text)+3)//4 as bigint) as tokens, cast(floor(cast((strlen(text)+3)//4 as bigint)*cast(1.3 as double)) as bigint) as with_margin from documents")
def c10(t):
    return t.documents.select("doc_id", X.token_estimate("text").alias("tokens"), X.token_estimate("text", 1.3).alias("with_margin"))


#: Conversations whose system text is cut by marks, that open with a summary, and that have tools.
CONTEXTS = """c0 as (select trajectory_id, sequence_id, role, row_number() over (partition by trajectory_id order by sequence_id)-1 as idx, cast(substring(trajectory_id, 6) as bigint) as nr, text from v_messages),
c as (select *, case when role='system' and nr%2=0 then '<base_instructions> '||text||' <memory_blocks>'||case when nr%4=0 then 'blocks '||trajectory_id||' <memory_metadata> '||cast(nr as varchar) else '' end when role='user' and nr%3=0 then 'The following is a summary of the previous '||text else text end as said from c0),
p as (select *, strpos(said, '<memory_blocks>') as m, strpos(said, '<memory_metadata>') as x, idx=0 and role='system' as first, idx=1 and role='user' and nr%3=0 as summed from c),
q as (select trajectory_id, max(nr) as nr, max(case when first and m>0 then trim(substring(said, 1, m-1)) end) as system, max(case when first and x>0 then trim(substring(said, m, x-m)) end) as core, max(case when first and x>0 then trim(substring(said, x)) end) as external, sum(case when summed then (strlen(said)+3)//4 else 0 end) as summary, sum(case when idx>0 and not summed then (strlen(said)+3)//4 else 0 end) as messages from p group by 1),
r as (select trajectory_id, (strlen(coalesce(system, 'own '||trajectory_id))+3)//4 as system, coalesce((strlen(core)+3)//4, 0) as core, coalesce((strlen(external)+3)//4, 0) as external, summary, messages, case when nr%5=0 then 2*((strlen('{"name": "'||trajectory_id||'"}')+3)//4) else 0 end as functions from q)"""


@query("c11_breakdown", f"with {CONTEXTS} select *, system+core+external+summary+messages+functions as total from r")
def c11(t):
    """Seven parts of each context; every second system text has marks, every third conversation a summary."""
    nr = F.substring("trajectory_id", F.lit(6), F.length("trajectory_id")).cast("bigint")
    marked = F.concat(F.lit("<base_instructions> "), "text", F.lit(" <memory_blocks>"), F.when(nr % 4 == 0, F.concat(F.lit("blocks "), "trajectory_id", F.lit(" <memory_metadata> "), nr.cast("string"))).otherwise(""))
    said = F.when((F.col("role") == "system") & (nr % 2 == 0), marked).when((F.col("role") == "user") & (nr % 3 == 0), F.concat(F.lit(C.SUMMARY), "text")).otherwise(F.col("text"))
    messages = t.v_messages.withColumn("text", said)
    ids = t.v_messages.select("trajectory_id").distinct()
    tools = ids.where(nr % 5 == 0).select("trajectory_id", F.explode(F.array(*[F.concat(F.lit('{"name": "'), "trajectory_id", F.lit('"}'))] * 2)).alias("schema"))
    return C.context_breakdown(messages, ids.withColumn("system", F.concat(F.lit("own "), "trajectory_id")), tools)


NUMBERED = "with m as (select *, row_number() over (partition by trajectory_id order by sequence_id)-1 as idx, count(*) over (partition by trajectory_id) as n, (strlen(text)+3)//4 as tokens from v_messages) "


@query("c12_static_evict", NUMBERED + ", s as (select *, min(case when role='user' and idx>=greatest(1, n-3) then idx end) over (partition by trajectory_id) as start from m) select message_id, n<=4 or idx=0 or coalesce(idx>=start, false) as kept from s")
def c12(t):
    return C.static_evict(t.v_messages, 4, 3).select("message_id", "kept")


@query("c13_partial_evict", NUMBERED + ", s as (select *, cast(round_even((1-cast(0.3 as double))*n, 0) as int) as target from m), p as (select *, min(case when role='assistant' and idx>=target then idx end) over (partition by trajectory_id) as start from s) select message_id, case when start is not null then idx=0 or idx>=start end as kept, case when start is null then 'No assistant message found from indices '||cast(target as varchar)||' to '||cast(n as varchar) end as error from p")
def c13(t):
    return C.partial_evict(t.v_messages, 0.3).select("message_id", "kept", "error")


SHARES = [0.3 + 0.10, 0.3 + 0.10 + 0.10, 0.3 + 0.10 + 0.10 + 0.10, 0.3 + 0.10 + 0.10 + 0.10 + 0.10, 0.3 + 0.10 + 0.10 + 0.10 + 0.10 + 0.10, 0.3 + 0.10 + 0.10 + 0.10 + 0.10 + 0.10 + 0.10]


@query("c14_window_evict", NUMBERED + f""", x as (select *, sum(tokens) over (partition by trajectory_id order by idx desc) as suffix from m), r(i, p) as (values {", ".join(f"({i}, cast({p!r} as double))" for i, p in enumerate(SHARES) if p < 1)}),
k as (select trajectory_id, idx, suffix, i from x, r where role='assistant' and idx>0 and idx<=round_even(n*p, 0)), e as (select trajectory_id, i, max(idx) as idx, arg_max(suffix, idx) as suffix from k group by 1, 2), f as (select trajectory_id, max(case when idx=0 then tokens end) as first, max(n) as n from m group by 1),
g as (select e.trajectory_id, arg_min(idx, i) as idx, arg_min(first+suffix, i) as kept from e join f on e.trajectory_id=f.trajectory_id where first+suffix < 0.7*400 group by 1)
select f.trajectory_id, case when idx<n-1 then idx end as cutoff, case when idx<n-1 then kept end as kept_tokens, case when idx is null then '{C.NO_CUT}' when idx>=n-1 then 'Assistant message index '||cast(idx as varchar)||' is at the end of the message buffer, skipping summarization' end as error from f left join g on f.trajectory_id=g.trajectory_id""")
def c14(t):
    return C.window_evict(t.v_messages, 0.3, 400)


@query("c15_clip", "select doc_id, case when length(text)>80 then substring(text,1,80)||'... [summary truncated to fit]' else text end as clipped from documents")
def c15(t):
    return t.documents.select("doc_id", C.clip(F.col("text"), 80).alias("clipped"))


@query("c15_packed", r"""with d as (select doc_id, case when doc_id%7<>0 then case when length(text)>80 then substring(text,1,80)||'... [summary truncated to fit]' else text end end as s, doc_id%50 as n, strftime(epoch_ms(1704067200000+doc_id*3607000), '%Y-%m-%d %I:%M:%S %p UTC+0000') as t from documents)
select doc_id, '{'||chr(10)||'  "type": "system_alert",'||chr(10)||'  "message": '||cast(to_json(case when s is null then 'Note: '||n||' prior messages with the user have been hidden from view due to conversation memory constraints. Older messages are stored in Recall Memory and can be viewed using functions.'
else 'Note: prior messages ('||n||' of '||2*n+1||' total messages) have been hidden from view due to conversation memory constraints.'||chr(10)||'The following is a summary of the previous '||n+1||' messages:'||chr(10)||' '||s end) as varchar)||','||chr(10)||'  "time": "'||t||'"'||chr(10)||'}' as packed from d""")
def c15_packed(t):
    """Clipped texts as the message that stands for evicted ones; every seventh has no summary."""
    n = F.col("doc_id") % 50
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3607)
    summary = F.when(F.col("doc_id") % 7 != 0, C.clip(F.col("text"), 80))
    return t.documents.select("doc_id", C.packed_summary(summary, C.local_stamp(at, "UTC", ("UTC", "UTC")), n + 1, n, 2 * n + 1).alias("packed"))


@query("c16_blocks", "select doc_id as block_id, case when doc_id%3=0 then substring(upper(lang)||text, 1, 50) else lang end as value from documents")
def c16(t):
    blocks = t.documents.select(F.col("doc_id").alias("block_id"), F.col("lang").alias("value"))
    updates = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("block_id"), F.concat(F.upper("lang"), "text").alias("value"))
    return C.update_blocks(blocks, updates, 50)


@query("c17_tool_text", """select event_id, event_type as name, 'does '||event_type as description, case when event_id%3=0 then 'schema of '||event_type end as schema_description,
'k ('||json_extract_string(props, '$.k')||'): a number;z (any)' as parameters, case when event_id%2=0 then 't1;t2' end as tags from events""")
def c17(t):
    """Tools as search texts, read back from their JSON."""
    e = t.events
    schema = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("schema of "), "event_type")).otherwise(F.concat(F.lit("does "), "event_type")).alias("description"), F.struct(F.struct(F.struct(F.lit("a number").alias("description"), F.get_json_object("props", "$.k").alias("type")).alias("k"), F.struct(F.lit("").alias("description")).alias("z")).alias("properties")).alias("parameters")))
    tags = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("t1"), F.lit("t2"))).otherwise(F.array().cast("array<string>"))
    text = C.tool_text(F.col("event_type"), F.concat(F.lit("does "), "event_type"), schema, tags)
    back = F.from_json(text, "struct<name:string,description:string,schema_description:string,parameters:array<string>,tags:array<string>>")
    return e.select("event_id", back.alias("b")).select("event_id", "b.name", "b.description", "b.schema_description", F.array_join("b.parameters", ";").alias("parameters"), F.array_join("b.tags", ";").alias("tags"))


@query("c18_markdown", """select doc_id, array_to_string(list_value(coalesce(source, ''), 'head '||cast(doc_id as varchar)||' and '||coalesce(lang, ''), 'item '||coalesce(source, ''), 'a'||chr(9)||'b '||coalesce(lang, ''), '# not a *heading*', 'said '||coalesce(lang, '')), chr(10)) as text from documents""")
def c18b(t):
    """A page of Markdown for every document: heading, emphasis, list, link, table, fence and quote."""
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    page = F.concat(F.lit("# "), source, F.lit("\n**head** "), F.col("doc_id").cast("string"), F.lit(" and `"), lang, F.lit("`\n- [item "), source, F.lit("](http://x/y)\n| a | b "), lang, F.lit(" |\n|---|:-:|\n```md\n# not a *heading*\n```\n> _said_ "), lang)
    return t.documents.select("doc_id", C.markdown_text(page).alias("text"))


@query("c18_html_text")
def c18(t):
    """Pages as plain text (a regular-expression job; tests hold it against a small parser)."""
    return t.pages.select("page_id", C.strip_html(F.col("html")).alias("text"))


@query("s5_load_passages")
def s5(t):
    """Documents into passages with embeddings, repeated embeddings dropped (tests hold it against a plain loop)."""
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_id"), "text")
    made = C.ingest(files, lambda c: S.embed(c, "text"), 50, 10)[0]
    return made.select("file_id", "position", F.sha2("text", 256).alias("text_sha256"), F.size("embedding").alias("dimension"))


# ------------------------------------------------------------------------------------------------ privacy
@query("p1_hash", "select trajectory_id, substring(sha256('salt'||trajectory_id), 1, 16) as hashed from v_trajectories")
def p1(t):
    return t.v_trajectories.select("trajectory_id", X.hash_identifier("trajectory_id", "salt").alias("hashed"))


@query("p2_redacted", "select trajectory_id, '[REDACTED:'||substring(sha256(trajectory_id), 1, 8)||']' as hidden from v_trajectories")
def p2(t):
    return t.v_trajectories.select("trajectory_id", X.redacted("trajectory_id").alias("hidden"))


@query("p3_full", "select substring(sha256('s'||trajectory_id), 1, 16) as trajectory_id, string_agg(cast(sequence_id as varchar)||'/'||role||'/'||case when text is null then '' else '[REDACTED]' end||'/'||substring(sha256('s'||message_id), 1, 16), ',' order by sequence_id) as messages from v_messages group by v_messages.trajectory_id")
def p3(t):
    """Nested conversations anonymised: ids hashed, texts redacted, structure kept."""
    m = F.array_sort(F.collect_list(F.struct("sequence_id", "role", "text", "message_id")))
    nested = t.v_messages.groupBy("trajectory_id").agg(m.alias("messages"))
    hidden = P.anonymise(nested, P.Policy(salt="s"))
    told = F.transform("messages", lambda x: F.concat_ws("/", x["sequence_id"].cast("string"), x["role"], F.coalesce(x["text"], F.lit("")), x["message_id"]))
    return hidden.select("trajectory_id", F.array_join(told, ",").alias("messages"))


FIRST = "case when strpos(substring({c},1,{n}), '.')>0 then string_split({c}, '.')[1]||'.' when length({c})<={n} then {c} else substring({c},1,{n})||'...' end"


@query("p4_learning_policy", "select substring(sha256(message_id), 1, 16) as message_id, role, " + FIRST.format(c="text", n=100) + " as text from v_messages")
def p4(t):
    return P.anonymise(t.v_messages.select("message_id", "role", "text"), P.LEARNING)


@query("p5_summarise", "select doc_id, " + FIRST.format(c="text", n=100) + " as summary from documents")
def p5(t):
    return t.documents.select("doc_id", X.first_sentence("text").alias("summary"))


@query("p6_messages", """select message_id, case role when 'system' then 'image' when 'assistant' then 'tool_call' when 'user' then case when sequence_id%3=0 then 'tool_response' else 'text' end end as type, case when role='system' or (role='user' and sequence_id%3<>0) then case when text<>'' then '[REDACTED]' end when role='assistant' and sequence_id%5=0 and text<>'' then '[REDACTED]' end as text,
case when role='user' and sequence_id%3=0 then '{"type": "tool_response", "content": "[REDACTED]"}' when sequence_id%5=0 then null when role='assistant' then case when sequence_id%2=0 then '{"tool_call": {"name": "run", "arguments": "[REDACTED]"}}' else '{"type": "redacted"}' end else '{"type": "redacted"}' end as data from v_messages""")
def p6(t):
    n = F.col("sequence_id")
    kind = F.when(F.col("role") == "system", "image").when(F.col("role") == "assistant", "tool_call").when(n % 3 == 0, "tool_response").otherwise("text")
    made = P.redact_message(kind, F.col("text"), F.when(n % 2 == 0, "run"), n % 5 != 0)
    return t.v_messages.select("message_id", made.alias("c")).select("message_id", "c.type", "c.text", "c.data")


@query("p7_decisions", "select substring(sha256(call_id), 1, 16) as call_id, action, not coalesce(regexp_matches(lower(response_text), 'error|exception|failed|failure|invalid'), false) as success, '[REDACTED]' as arguments, case when response_text is not null then '[REDACTED]' end as response_text, confidence from v_tool_events")
def p7(t):
    return P.redact_decisions(decisions(t).select("call_id", "action", "success", "arguments", "response_text", "confidence"))


@query("p8_cross_org", """with u as (select *, case when step_no%2=1 then count(*) over (partition by run_id, step_no) else 0 end as c from v_steps),
s as (select run_id, sum(prompt_tokens+completion_tokens) as tokens, sum(c) as said, sum(case when step_no=3 then c else 0 end) as tools, string_agg(array_to_string(list_transform(range(c), lambda x: case step_no when 5 then 'robot' else 'user' end||': text '||cast(step_no as varchar)), chr(10)), '|' order by step_no) as words, count(*) as n from u group by 1)
select case when organization_id='org-1' then r.run_id else '[REDACTED:'||substring(sha256('x'||r.run_id),1,8)||']' end as trajectory_id, case when organization_id='org-1' then agent_id else '[REDACTED:'||substring(sha256('x'||agent_id),1,8)||']' end as agent_id, 'a '||status as searchable_summary, coalesce(tokens, 0) as total_tokens, coalesce(said, 0) as messages, coalesce(tools, 0) as tool_calls,
case when organization_id='org-1' then coalesce(words, '') else array_to_string(list_transform(range(coalesce(n, 0)), lambda x: '[REDACTED]'), '|') end as words, case when organization_id='org-1' then 'own' else 'shared' end as visibility, '[REDACTED:'||substring(sha256('x'||organization_id),1,8)||']' as source_organization_hash from v_runs r left join s on r.run_id=s.run_id where organization_id='org-1' or background""")
def p8(t):
    """Captured runs as another organisation sees them: measures and turns stay, messages and ids do not."""
    runs = t.v_runs.where("organization_id = 'org-1' or background")
    with_tools = R._messages(t)
    nested = C2.build_trajectories(R._runs(runs), t.v_steps, with_tools).join(runs.select("run_id", "organization_id", F.concat(F.lit("a "), "status").alias("searchable_summary")), "run_id")
    used = lambda m: m.withField("tools", F.when(m["seq"] == 3, F.array(F.lit("model"))))
    turns = F.transform("turns", lambda x: x.withField("messages", F.transform(x["messages"], used)))
    seen = P.structural_view(nested.select(F.col("run_id").alias("trajectory_id"), "agent_id", "organization_id", "searchable_summary", F.col("metadata.total_tokens").alias("total_tokens"), F.coalesce(turns, F.array().cast(nested.select(turns).schema[0].dataType)).alias("turns")), "org-1", "x")
    add = lambda field: F.aggregate("turns", F.lit(0), lambda n, x: n + x[field])
    return seen.select("trajectory_id", "agent_id", "searchable_summary", "total_tokens", add("message_count").alias("messages"), add("tool_calls_count").alias("tool_calls"), F.array_join(F.transform("turns", lambda x: x["messages"]), "|").alias("words"), "visibility", "source_organization_hash")


@query("p9_sharing", "select trajectory_id, case when agent_id='agent-src5' then true else share_cross_org end as share_cross_org from v_trajectories")
def p9(t):
    rows = t.v_trajectories.select("trajectory_id", "share_cross_org")
    return P.set_sharing(rows, t.v_trajectories.where("agent_id = 'agent-src5'"), True)


# ------------------------------------------------------------------------------------------------ scalar functions
@query("u1_times", "select event_id, cast(epoch_us(ts)//1000000 as bigint) as seconds, strftime(ts, '%Y-%m-%d') as day, cast(floor(duration_ms) as bigint) as ms from v_tool_events where duration_ms is not null")
def u1(t):
    ns = (F.floor("duration_ms") * 1_000_000).cast("bigint")
    return t.v_tool_events.where("duration_ms is not null").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (ns / 1_000_000).cast("bigint").alias("ms"))


@query("u2_clamp", "select event_id, greatest(0, least(1, value/100)) as clamped from events")
def u2(t):
    return t.events.select("event_id", X.clamp(F.col("value") / 100).alias("clamped"))


@query("u3_matches", "select doc_id, lower(text) like '%license%' as has, text ilike 'the%' as begins, text like '%.' as ends from documents")
def u3(t):
    text = F.col("text")
    return t.documents.select("doc_id", F.lower(text).contains("license").alias("has"), text.ilike("the%").alias("begins"), text.like("%.").alias("ends"))


@query("u4_json_path", "select event_id, json_extract_string(props, '$.k') as k, cast(json_extract_string(props, '$.k') as bigint) % 10 as digit from events where json_extract_string(props, '$.k') <> '7'")
def u4(t):
    rows = L.matching(t.events.withColumn("nested", F.concat(F.lit('{"a":'), "props", F.lit("}"))), excluded={}).where(F.get_json_object("nested", "$.a.k") != "7")
    return rows.select("event_id", F.get_json_object("nested", "$.a.k").alias("k"), (F.variant_get(F.parse_json("props"), "$.k", "bigint") % 10).alias("digit"))


@query("u5_json", "select event_id, 'k,type' as keys, '{\"k\":'||json_extract_string(props, '$.k')||',\"type\":\"'||event_type||'\"}' as dumped from events")
def u5(t):
    """JSON objects parsed, their keys, and written again."""
    full = F.concat(F.substring("props", F.lit(1), F.length("props") - 1), F.lit(', "type": "'), "event_type", F.lit('"}'))
    return t.events.select("event_id", F.array_join(F.json_object_keys(full), ",").alias("keys"), F.to_json(F.from_json(full, "k bigint, type string")).alias("dumped"))


@query("u6_file_names", r"""with n as (select page_id, case cast(page_id%6 as int) when 0 then url when 1 then '/a/b?c:'||regexp_replace(url, '^.*/', '')||'.tar.gz' when 2 then 'dir/.hidden' when 3 then 'NUL.txt' when 4 then repeat('x', 300)||'.html' else 'tail. .pdf' end as name from pages),
b as (select page_id, regexp_replace(name, '^.*/', '') as f from n), s as (select page_id, regexp_extract(f, '[^.].*?(\.[^.]*)$', 1) as ext, f from b),
c as (select page_id, ext, regexp_replace(regexp_replace(left(f, length(f)-length(ext)), '[\x00-\x1f\x7f/\\:*?"<>|]', '', 'g'), '[ .]+$', '') as base from s)
select page_id, case when base like '.%' then null else left(base||case when regexp_matches(base, '(?i)^(con|prn|aux|nul|clock\$|com[1-9]|lpt[1-9])$') then '_' else '' end, 255-length(ext))||ext end as name from c""")
def u6(t):
    n, last = F.col("page_id") % 6, F.regexp_replace("url", r"^.*/", "")
    name = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("/a/b?c:"), last, F.lit(".tar.gz"))).when(n == 2, "dir/.hidden").when(n == 3, "NUL.txt").when(n == 4, "x" * 300 + ".html").otherwise("tail. .pdf")
    return t.pages.select("page_id", X.sanitise_file_name(name).alias("name"))


@query("u7_formats", "select action, printf('%.2f', sum(confidence)/count(*)) as two, printf('%.1f%%', 100.0*sum(cast(pivotal as int))/count(*)) as share from v_tool_events group by 1")
def u7(t):
    g = t.v_tool_events.groupBy("action").agg(F.sum("confidence").alias("c"), F.count("*").alias("n"), F.count_if("pivotal").alias("p"))
    return g.select("action", F.format_string("%.2f", F.col("c") / F.col("n")).alias("two"), F.format_string("%.1f%%", 100.0 * F.col("p") / F.col("n")).alias("share"))


@query("u8_arrays", "select trajectory_id, array_to_string(list_sort(list_distinct(list(action))), ',') as actions from v_tool_events group by 1")
def u8(t):
    return t.v_tool_events.groupBy("trajectory_id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("action"))), ",").alias("actions"))


@query("u9_expectations", "select sum(cast(confidence is null or confidence<0 or confidence>1 as int)) as bad_confidence, sum(cast(duration_ms<0 as int)) as bad_duration, count(*) as n from v_tool_events")
def u9(t):
    c = F.col("confidence")
    return t.v_tool_events.agg(F.count_if(c.isNull() | ~c.between(0, 1)).alias("bad_confidence"), F.count_if(F.col("duration_ms") < 0).alias("bad_duration"), F.count("*").alias("n"))


@query("u10_indexed_id", "select event_id, substring(h, 1, 30)||lower(printf('%02x', (cast('0x'||substring(h, 31, 2) as int) & 128) | cast(event_id%128 as int))) as derived from (select event_id, md5(cast(event_id as varchar)) as h from events)")
def u10(t):
    return t.events.select("event_id", X.indexed_id(F.md5(F.col("event_id").cast("string")), F.col("event_id") % 128).alias("derived"))
