"""Chunking, line search, transcripts, token budgets and context eviction, per document or conversation.

Everything is column functions and windows partitioned by the document or conversation; word wrap alone, which is
sequential, is a loop over Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X


def lines_of(text: Column, code: bool = False) -> Column:
    """The lines of a text that are not blank, without white space around them; code keeps its indentation."""
    kept = F.filter(F.split(text, r"\R"), lambda x: F.trim(x) != "")
    return F.transform(kept, lambda x: F.rtrim(x) if code else F.trim(x))


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", code: bool = False) -> DataFrame:
    """(key, line_no, line): non-blank lines, numbered from 1 without the blank ones."""
    lines = docs.select(key, F.posexplode(lines_of(F.col(text), code)).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def file_view(lines: Column, kind: str = "lines", start: int | None = None, end: int | None = None, header: bool = True) -> Column:
    """(lines, error): the chunks of a file from ``start`` to before ``end`` (from 0), each with its number (from 1), under a
    header that says which are shown; a start beyond the last one is an error."""
    n, at = F.size(lines), max(0, start or 0)
    upto = n if end is None else F.least(F.lit(end), n)
    shown = F.when(n > 0, F.slice(lines, at + 1, F.greatest(F.lit(0), upto - at))).otherwise(lines)
    numbered = F.transform(shown, lambda x, i: F.concat((i + at + 1).cast("string"), F.lit(": "), x))
    # The headers and the error.
    if start is not None and end is not None:
        said = F.format_string(f"[Viewing {kind} {start + 1} to %d (out of %d {kind})]", upto, n)
    elif start is not None:
        said = F.format_string(f"[Viewing {kind} {start + 1} to end (out of %d {kind})]", n)
    else:
        said = F.format_string(f"[Viewing file start (out of %d {kind})]", n)
    beyond = F.lit(start is not None) & (F.lit(start or 0) >= n)
    error = F.when(beyond, F.format_string(f"only %d {kind}, but requested offset {(start or 0) + 1} is out of range", n))
    return F.struct(F.when(~beyond, F.concat(F.array(said), numbered) if header else numbered).alias("lines"), error.alias("error"))


def sentence_chunks(text: Column) -> Column:
    """Sentences: cut after ., ! or ? before an upper-case letter; white space squeezed; blanks dropped."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def wrapped(text: str | None, width: int) -> list[str] | None:
    """Words packed greedily: a line is full when its letters, its gaps and the next word pass ``width``."""
    if text is None:
        return None
    lines, line, size = [], [], 0
    for word in text.split():
        if line and size + len(word) + len(line) > width:
            lines.append(" ".join(line))
            line, size = [], 0
        line.append(word)
        size += len(word)
    return lines + [" ".join(line)] if line else lines


def wrap_chunks(text: Column, width: int = 100) -> Column:
    """Words packed greedily into lines of at most ``width`` characters (longer words get a line of their own)."""
    kind = pa.list_(pa.string())
    pack = F.arrow_udf(lambda texts: pa.array([wrapped(x, width) for x in texts.to_pylist()], type=kind), "array<string>")
    return pack(text)


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it occurs."""
    return F.get(F.transform(F.array(value), use), 0)


def fixed_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Runs of ``size`` words, each sharing ``overlap`` words with the one before; the last may be shorter."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def chunk_strategy(files: DataFrame, types: DataFrame) -> DataFrame:
    """Strategy by MIME type, then by extension, then ``line_based``; the type table is a constant and broadcast."""
    by_mime = F.broadcast(types.select(F.col("mime").alias("m"), F.col("strategy").alias("s1")).where("m is not null"))
    by_ext = F.broadcast(types.select(F.col("ext").alias("e"), F.col("strategy").alias("s2")).where("e is not null"))
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    out = files.join(by_mime, files["mime"] == F.col("m"), "left").join(by_ext, ext == F.col("e"), "left")
    return out.select(*files.columns, F.coalesce("s1", "s2", F.lit("line_based")).alias("strategy"))


def matching_lines(text: Column, pattern: str, context: int = 1) -> Column:
    """The lines of a text that match a pattern (any case), in order, as (line_no, line, before, after)."""

    def hits(lines: Column) -> Column:
        around = lambda i, steps: F.array_join(F.array_compact(F.array(*[F.get(lines, i + k) for k in steps])), "\n")
        line = lambda x, i: F.when(x.rlike(f"(?i){pattern}"), F.struct((i + 1).alias("line_no"), x.alias("line"), around(i, range(-context, 0)).alias("before"), around(i, range(1, context + 1)).alias("after")))
        return F.array_compact(F.transform(lines, line))

    return bound(F.split(text, r"\R"), hits)


def grep(files: DataFrame, pattern: str, key: str, text: str, context: int = 1, per_page: int = 20) -> DataFrame:
    """Lines that match a pattern (any case) with their neighbours, and the page each falls on: (key, line_no, line,
    before, after, page).  Only hits leave their row; nothing is shuffled."""
    some = files.where(F.col(text).rlike(f"(?i){pattern}")).select(key, F.posexplode(matching_lines(F.col(text), pattern, context)).alias("nth", "h"))
    return some.select(key, "h.*", F.floor(F.col("nth") / per_page).cast("int").alias("page"))


# The tools whose calls and returns message search and transcripts treat apart, and the argument that holds a text.
SEND, SEARCH_CALL, SENT = "send_message", "conversation_search", "message"


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("c")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def searchable_message(role: Column, text: Column, name: Column | None = None, calls: Column | None = None) -> Column:
    """What message search indexes of a message, as JSON; empty for what is not searched.

    System messages, heartbeats, messages without content, returns of ``SEND`` and ``SEARCH_CALL``, and calls of the latter are
    not searched.  A user's or assistant's text that is JSON stays as it is; an assistant that calls ``SEND`` is its text
    as thinking and the argument as content; all else is content.  ``calls``: array of (name, arguments).
    """
    none = F.lit(None).cast("array<struct<name:string,arguments:string>>")
    calls, name = none if calls is None else calls, F.lit(None).cast("string") if name is None else name
    parsed = F.try_parse_json(text)
    heartbeat = F.ltrim(text).startswith("{") & F.coalesce(F.get_json_object(text, "$.type") == "heartbeat", F.lit(False)) & parsed.isNotNull()
    plain = F.concat(F.lit('{"content": '), json_text(text), F.lit("}"))
    sent = F.get(F.filter(calls, lambda c: (c["name"] == SEND) & F.try_parse_json(c["arguments"]).isNotNull()), 0)["arguments"]
    said = F.coalesce(F.get_json_object(sent, f"$.{SENT}"), F.lit(""))
    thought = F.concat(F.lit('{"thinking": '), json_text(text), F.lit(', "content": '), json_text(said), F.lit("}"))
    searches = F.coalesce(F.exists(calls, lambda c: c["name"] == SEARCH_CALL), F.lit(False))
    out = (role == "tool") & F.coalesce(name.isin(SEND, SEARCH_CALL), F.lit(False))
    searched = role.isin("assistant", "user", "tool")
    return (
        F.when(~searched | text.isNull() | out | heartbeat | ((role == "assistant") & searches), "")
        .when((role == "assistant") & sent.isNotNull(), thought).when(role.isin("user", "assistant") & parsed.isNotNull(), text).otherwise(plain)
    )


def transcript(messages: DataFrame, key: str = "trajectory_id", include_system: bool = False) -> DataFrame:
    """(key, transcript): ``role: text`` lines in sequence.

    System messages, returns of ``SEND`` and messages with nothing to show are left out; images have a placeholder; a message
    without content shows its calls: the text that ``SEND`` sends, the arguments of others.  Columns: role, text (null: no
    content), and, if there are any, images (a number), name and calls (array of name, arguments).
    """
    have = lambda c, kind: F.col(c) if c in messages.columns else F.lit(None).cast(kind)
    images, calls = F.coalesce(have("images", "int"), F.lit(0)), have("calls", "array<struct<name:string,arguments:string>>")
    content = F.col("text").isNotNull() | (images > 0)
    # The placeholders.
    shown = F.when(images == 1, "[Image omitted]").when(images > 1, F.format_string("[%d images omitted]", images))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    said = F.concat_ws(" ", F.when(text != "", text), shown)
    one = lambda c: F.when(c["name"] == SEND, F.coalesce(F.get_json_object(c["arguments"], f"$.{SENT}"), c["arguments"])).otherwise(c["arguments"])
    called = F.trim(F.array_join(F.transform(calls, one), " "))
    returned = (F.col("role") == "tool") & F.coalesce(have("name", "string") == SEND, F.lit(False))
    rows = messages.where((content & ~returned) | (~content & (F.size(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>"))) > 0)))
    rows = rows if include_system else rows.where("role <> 'system'")
    line = F.concat("role", F.lit(": "), F.when(content, said).otherwise(called))
    turns = F.array_sort(F.collect_list(F.struct("sequence_id", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("transcript"))


def middle_cut(text: Column, budget: int, head: float = 0.3, tail: float = 0.3) -> Column:
    """(text, dropped): the first and last parts of a text beyond ``budget`` characters, with the count of dropped
    characters between; the tail loses at its end what the marker is too long, all of it if need be."""
    first, last = max(0, int(budget * head)), max(0, int(budget * tail))
    last = min(last, max(0, budget - first))
    n = F.length(text)
    dropped = n - F.lit(first) - F.lit(last)
    # Fixed value: the marker.
    marker = F.format_string("\n[TRUNCATED: dropped %d middle chars due to context budget]\n", dropped)
    over = F.greatest(F.lit(0), F.length(marker) - (budget - first - last))
    end = F.substring(text, n - last + 1, F.greatest(F.lit(0), F.lit(last) - over)) if last else F.lit("")
    whole = F.lit(budget <= 0) | (n <= budget)
    return F.when(text.isNotNull(), F.struct(F.when(whole, text).otherwise(F.concat(F.substring(text, 1, first), marker, end)).alias("text"), F.when(whole, 0).otherwise(dropped).alias("dropped")))


# Where the parts of a system text begin, and how a summary of earlier messages opens.
PARTS = ("<base_instructions>", "<memory_blocks>", "<memory_metadata>")
SUMMARY = "The following is a summary of the previous "


def system_parts(text: Column) -> Column:
    """(system, core, external) of a system text: what lies between the three marks, in their order; empty where one of the
    marks that bound a part is missing, or comes before the one that opens it."""
    base, core, rest = (F.coalesce(F.instr(text, m), F.lit(0)) for m in PARTS)
    bare = lambda part: F.regexp_replace(part, r"(?U)^\s+|\s+$", "")
    between = lambda a, b: F.when((a > 0) & (b > 0), bare(F.substring(text, a, F.greatest(F.lit(0), b - a)))).otherwise("")
    end = F.when(rest > 0, bare(F.substring(text, rest, F.length(text)))).otherwise("")
    return F.struct(between(base, core).alias("system"), between(core, rest).alias("core"), end.alias("external"))


def context_breakdown(messages: DataFrame, agents: DataFrame | None = None, functions: DataFrame | None = None, key: str = "trajectory_id") -> DataFrame:
    """Token estimates of each conversation's context: system, core, external, summary, messages, functions, and total.

    The first message, if it is the system's, is cut at its marks; without them the agent's own instructions (``agents``: key,
    system) stand for it.  A user message right after it that opens like a summary is one; all later ones are messages.
    ``functions``: key, schema (JSON) of each tool.
    """
    rows = _numbered(messages, key)
    first = (F.col("idx") == 0) & (F.col("role") == "system")
    is_summary = (F.col("idx") == 1) & (F.col("role") == "user") & F.coalesce(F.contains("text", F.lit(SUMMARY)), F.lit(False))
    tokens = F.coalesce(X.token_estimate("text"), F.lit(0))
    per = rows.groupBy(key).agg(
        F.max(F.when(first, system_parts(F.col("text")))).alias("s"), F.sum(F.when(is_summary, tokens).otherwise(0)).alias("summary"), F.sum(F.when((F.col("idx") > 0) & ~is_summary, tokens).otherwise(0)).alias("messages"),
    )
    own = per.withColumn("__own", F.lit("")) if agents is None else per.join(agents.select(key, F.col("system").alias("__own")).hint("merge"), key, "left")
    if functions is None:
        told = own.withColumn("functions", F.lit(0).cast("bigint"))
    else:
        told = own.join(functions.groupBy(key).agg(F.sum(X.token_estimate("schema")).alias("functions")).hint("merge"), key, "left")
    system = F.when(F.coalesce(F.col("s.system"), F.lit("")) == "", F.coalesce("__own", F.lit(""))).otherwise(F.col("s.system"))
    out = told.select(key, X.token_estimate(system).alias("system"), X.token_estimate(F.col("s.core")).alias("core"), X.token_estimate(F.col("s.external")).alias("external"), "summary", "messages", F.coalesce("functions", F.lit(0)).alias("functions"))
    parts = ("system", "core", "external", "summary", "messages", "functions")
    return out.withColumn("total", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def _numbered(messages: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key)
    return messages.withColumns({"idx": F.row_number().over(w.orderBy("sequence_id")) - 1, "n": F.count("*").over(w)})


def static_evict(messages: DataFrame, limit: int, minimum: int, key: str = "trajectory_id") -> DataFrame:
    """Messages with ``kept``: all within the limit; beyond it the first, and from the first user message among the last
    ``minimum`` on (none, if there is no such message)."""
    rows = _numbered(messages, key)
    target = F.greatest(F.lit(1), F.col("n") - minimum)
    start = F.min(F.when((F.col("role") == "user") & (F.col("idx") >= target), F.col("idx"))).over(Window.partitionBy(key))
    return rows.withColumn("kept", (F.col("n") <= limit) | (F.col("idx") == 0) | F.coalesce(F.col("idx") >= start, F.lit(False)))


def partial_evict(messages: DataFrame, share: float, key: str = "trajectory_id") -> DataFrame:
    """Messages with ``kept``: the first, and from the first assistant message at or after round((1 - share) * n), half
    to even, on.  Where there is no such message, ``kept`` is null and ``error`` says so."""
    rows = _numbered(messages, key)
    target = F.bround((1 - F.lit(share)) * F.col("n"), 0).cast("int")
    start = F.min(F.when((F.col("role") == "assistant") & (F.col("idx") >= target), F.col("idx"))).over(Window.partitionBy(key))
    # Fixed value: the message of the error.
    error = F.when(start.isNull(), F.format_string("No assistant message found from indices %d to %d", target, F.col("n")))
    return rows.withColumns({"kept": F.when(start.isNotNull(), (F.col("idx") == 0) | (F.col("idx") >= start)), "error": error})


# Why a window cannot be moved.
NO_CUT, AT_END = "No assistant message found for sliding window summarization", "Assistant message index %d is at the end of the message buffer, skipping summarization"


def window_evict(messages: DataFrame, share: float, window: int, key: str = "trajectory_id") -> DataFrame:
    """(key, cutoff, kept_tokens, error): from which message on a conversation is kept, beside its first one, so that it takes
    less than ``1 - share`` of the window.

    Shares are tried from ``share`` and a tenth on, in tenths, up to all: the cutoff is the last assistant message at or before
    that share of the messages (rounded half to even).  It must be found before all are tried, and may not be the last message,
    nor the one before a last approval.  All tries of a conversation are made at once, on suffix sums.
    """
    rows = _numbered(messages, key).withColumn("tokens", X.token_estimate("text"))
    w = Window.partitionBy(key).orderBy(F.desc("idx"))
    rows = rows.withColumn("suffix", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tries, p = [], share
    while p < 1.0:
        p += 0.10
        tries.append(p)
    tries = [x for x in tries if x < 1.0]  # what is found at the last one is refused
    cuts = F.array(*[F.struct(F.lit(i).alias("try"), F.rint(F.lit(x) * F.col("n")).cast("int").alias("cut")) for i, x in enumerate(tries)]) if tries else F.array().cast("array<struct<try:int,cut:int>>")
    tried = rows.where("role = 'assistant' and idx > 0").select(key, "idx", "suffix", F.explode(cuts).alias("c")).where("idx <= c.cut")
    each = tried.groupBy(key, "c.try").agg(F.max_by(F.struct("idx", "suffix"), "idx").alias("at"))
    first = rows.groupBy(key).agg(F.sum(F.when(F.col("idx") == 0, F.col("tokens"))).alias("first"), F.max("n").alias("n"), F.max_by("role", "idx").alias("last"))
    took = first.join(each.hint("merge"), key, "left").withColumn("kept", F.col("first") + F.col("at.suffix"))
    goal = F.lit((1 - share) * window)
    good = took.groupBy(key).agg(F.first("n").alias("n"), F.first("last").alias("last"), F.min_by(F.struct("at.idx", "kept"), F.when(F.col("kept") < goal, F.col("try"))).alias("g"))
    most = F.col("n") - F.when(F.col("last") == "approval", 2).otherwise(1)
    error = F.when(F.col("g").isNull(), NO_CUT).when(F.col("g.idx") >= most, F.format_string(AT_END, F.col("g.idx")))
    return good.select(key, F.when(error.isNull(), F.col("g.idx")).alias("cutoff"), F.when(error.isNull(), F.col("g.kept")).alias("kept_tokens"), error.alias("error"))


def clip(text: Column, limit: int, suffix: str = "... [summary truncated to fit]") -> Column:
    """A summary, cut to ``limit`` characters with a word that says so."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def local_stamp(at: Column, zone: str, names: tuple[str, str]) -> Column:
    """A UTC time in a zone as ``2024-01-31 05:00:00 PM PST-0800``; ``names``: its abbreviations in standard and in summer time."""
    at = at.cast("timestamp")
    shift = lambda t: (F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t)).cast("bigint")
    january = F.date_trunc("year", at)
    off, standard = shift(at), F.least(shift(january), shift(january + F.expr("interval 181 days")))
    minutes = F.abs(off).cast("bigint") / 60
    offset = F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad(F.floor(minutes % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd hh:mm:ss a "), F.when(off > standard, names[1]).otherwise(names[0]), offset)


def alert(message: Column, time: Column) -> Column:
    """The JSON of a notice of the system, indented by two; null without a message or a time."""
    said = F.concat(F.lit('{\n  "type": "system_alert",\n  "message": '), json_text(message), F.lit(',\n  "time": '), json_text(time), F.lit("\n}"))
    return F.when(message.isNotNull() & time.isNotNull(), said)


# What a packed summary says.
HIDDEN = "Note: prior messages (%d of %d total messages) have been hidden from view due to conversation memory constraints.\nThe following is a summary of the previous %d messages:\n %s"
HIDDEN_UNCOUNTED = "Note: prior messages have been hidden from view due to conversation memory constraints.\nThe following is a summary of the previous messages:\n %s"
HIDDEN_ALONE = "Note: %d prior messages with the user have been hidden from view due to conversation memory constraints. Older messages are stored in Recall Memory and can be viewed using functions."


def packed_summary(summary: Column, time: Column, summed: Column | None = None, hidden: Column | None = None, total: Column | None = None) -> Column:
    """The message that stands for evicted ones: their summary, with counts if they are given.  A row whose summary is
    null says only how many are hidden, or has no message where that isn't given either; a null count, no message."""
    hidden = F.lit(None).cast("bigint") if hidden is None else hidden
    alone = F.when(hidden.isNotNull(), F.format_string(HIDDEN_ALONE, hidden))
    if summed is None or total is None:
        said = F.format_string(HIDDEN_UNCOUNTED, summary)
    else:
        said = F.when(hidden.isNotNull() & total.isNotNull() & summed.isNotNull(), F.format_string(HIDDEN, hidden, total, summed, summary))
    return alert(F.when(summary.isNull(), alone).otherwise(said), time)


def update_blocks(blocks: DataFrame, updates: DataFrame, limit: int) -> DataFrame:
    """Block values replaced where an update exists, cut to the limit; updates of unknown blocks are skipped."""
    new = updates.select("block_id", F.substring("value", 1, limit).alias("__v"))
    return blocks.join(new, "block_id", "left").withColumn("value", F.coalesce("__v", "value")).drop("__v")


PARAMETERS = "struct<description:string,parameters:struct<properties:map<string,struct<description:string,type:string>>>>"


def tool_text(name: Column, description: Column, schema: Column, tags: Column | None = None) -> Column:
    """Search text of a tool, as JSON: name, description, the schema's own description if it is another, its parameters as
    ``name (type): description`` in their order, and tags, if there are any."""
    s = F.from_json(schema, PARAMETERS)
    own, told = F.coalesce(description, F.lit("")), s["description"]
    each = lambda e: F.concat(e["key"], F.lit(" ("), F.coalesce(e["value"]["type"], F.lit("any")), F.lit(")"), F.coalesce(F.when(e["value"]["description"] != "", F.concat(F.lit(": "), e["value"]["description"])), F.lit("")))
    params = F.transform(F.map_entries(s["parameters"]["properties"]), each)
    tags = F.lit(None).cast("array<string>") if tags is None else tags
    return F.to_json(F.struct(
        F.coalesce(name, F.lit("")).alias("name"), own.alias("description"), F.when((told != "") & ~told.eqNullSafe(description), told).alias("schema_description"),
        F.when(F.size(params) > 0, params).alias("parameters"), F.when(F.size(tags) > 0, tags).alias("tags"),
    ))


def strip_html(html: Column) -> Column:
    """A page as text for chunking: scripts, styles, comments and tags out, common references decoded, blank runs squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|tr|ul|ol|article|nav|footer)>|<br\s*/?>", "\n"), r"(?s)<[^>]*>", " ")
    # The references that are decoded.
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def ingest(files: DataFrame, embed, size: int = 512, overlap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(passages, counts): files cut into chunks, empty ones dropped, and of equal embeddings the first by file and
    position kept.  Embeddings are compared by two 64-bit hashes; vectors stay where they are."""
    chunks = files.select("file_id", F.posexplode(fixed_chunks(F.col("text"), size, overlap)).alias("position", "text")).where(F.length("text") > 0)
    made = embed(chunks).withColumns({"__h": F.xxhash64("embedding"), "__g": F.xxhash64(F.lit(1), "embedding")})
    nth = F.row_number().over(Window.partitionBy("__h", "__g").orderBy("file_id", "position"))
    passages = made.withColumn("__n", nth).where("__n = 1 or embedding is null").drop("__n", "__h", "__g")
    return passages, passages.agg(F.count("*").alias("passages"), F.count_distinct("file_id").alias("files"))


def markdown_text(markdown: Column) -> Column:
    """Markdown as plain text before chunking, block by block.

    Lines in a fence (three or more backticks or tildes, closed by at least as many of the same) stay as they are, without
    the fence.  Elsewhere headings, quotes and lists lose their marks, rules and the line under a table's head go, table
    rows become their cells with tabs between, links and images become their text, emphasis and code lose their signs, and
    escaped signs lose their backslash.
    """
    lines = F.split(markdown, r"\R")
    opening = r"^ {0,3}(`{3,}|~{3,})"
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def fold(state: Column, line: Column) -> Column:
        mark, fence = F.regexp_extract(line, opening, 1), state["fence"]
        inside = fence != ""
        closes = inside & (F.substring(mark, 1, 1) == F.substring(fence, 1, 1)) & (F.length(mark) >= F.length(fence)) & line.rlike(opening + r"\s*$")
        opens = ~inside & (mark != "") & ~((F.substring(mark, 1, 1) == "`") & F.regexp_replace(line, opening, "").contains("`"))
        kept = F.when(inside, F.concat(state["out"], F.array(line))).otherwise(F.concat(state["out"], plain_line(line)))
        return F.struct(F.when(closes, "").when(opens, mark).otherwise(fence).alias("fence"), F.when(closes | opens, state["out"]).otherwise(kept).alias("out"))

    return F.array_join(F.aggregate(lines, start, fold, lambda s: s["out"]), "\n")


def plain_line(line: Column) -> Column:
    """A Markdown line outside of fences as an array of one line, or of none."""
    rule = line.rlike(r"^ {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$") | line.rlike(r"^ {0,3}(=+|-+)\s*$")
    under_head = line.rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
    text = F.regexp_replace(line, r"^ {0,3}(> ?)+", "")
    text = F.regexp_replace(text, r"^ {0,3}#{1,6}(\s+|$)", "")
    text = F.regexp_replace(text, r"^(\s*)([-*+]|\d{1,9}[.)])\s+(\[[ xX]\]\s+)?", "$1")
    text = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)\s]*(\s+\"[^\"]*\")?\)", "$1")
    text = F.regexp_replace(text, r"!?\[([^\]]+)\]\[[^\]]*\]", "$1")
    text = F.regexp_replace(text, r"<(https?://[^>\s]+)>", "$1")
    text = F.regexp_replace(text, r"(`+)([^`]+)\1", "$2")
    for sign in (r"\*\*\*", r"\*\*", r"__", r"\*", r"~~"):
        text = F.regexp_replace(text, rf"(?<!\\)(?<![\w]){sign}(?=\S)([^*_~]+?)(?<=\S){sign}(?![\w])", "$1")
    text = F.regexp_replace(text, r"(?<![\w\\])_(?=\S)([^_]+?)(?<=\S)_(?!\w)", "$1")
    cells = F.transform(F.split(F.regexp_replace(F.trim(text), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    text = F.when(line.rlike(r"^\s*\|.*\|\s*$"), F.array_join(cells, "\t")).otherwise(text)
    text = F.rtrim(F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1"))
    return F.when(rule | under_head, F.array().cast("array<string>")).otherwise(F.array(text))
