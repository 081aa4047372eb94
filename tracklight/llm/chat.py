"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log of events is partitioned by conversation and ordered by sequence number.  Events of one message fold into its
final text: the last of its ``message``, ``edit`` and ``regenerate`` events sets the text, later ``delta`` events are
appended, and a ``delete`` after them removes the message.  The final messages, in the order in which they began, are
rendered with a template whose control strings are escaped, reversibly, inside roles and texts.  The loss mask is a
list of code-point spans of the rendered string.

Messages fold in tasks of their own, so a long conversation is spread until its finished messages are joined into
its one output string, which is the smallest thing a training example can be.

Defined results: a null text is empty; a message's role is the first that any of its events names, and an empty one if
none does; events without a message id are whole messages; of several ``message``, ``edit`` and ``regenerate`` events
with one sequence number the last by kind and text counts, and deltas count only after it; repeated deltas count each
time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read

#: The template: marker before the role, between role and text, after the text.
BEGIN, MIDDLE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings, of this template and of common others, begin with one of these; `~` breaks them up.
CONTROL = r"([<\[])(~*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])~(~*)(\||/?s>|/?INST\])"
#: Whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``text`` without any control string; ``unescape`` gives it back."""
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text) of each final message.

    ``events``: conv_id, seq, message_id (null: a whole message), kind (message, delta, edit, regenerate, delete), role,
    text.
    """
    text, delta = F.coalesce(F.col("text"), F.lit("")), F.col("kind") == "delta"
    plain = events.select("conv_id", "seq", "message_id", "kind", "role", text.alias("text"))
    whole = plain.where("message_id is null").select("conv_id", F.col("seq").alias("at"), "role", "text")
    folded = plain.where("message_id is not null").groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("at"), F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("role"),
        F.max(F.when(~delta, F.struct("seq", "kind", "text"))).alias("base"), F.array_sort(F.collect_list(F.when(delta, F.struct("seq", "text")))).alias("deltas"),
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (d["seq"] > F.col("base.seq")))
    said = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    live = folded.where("base is null or base.kind <> 'delete'")
    return whole.unionByName(live.select("conv_id", "at", "role", said.alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one string a conversation, and the code-point spans (first, length) under the loss mask.

    Where a message's text begins is a running sum of lengths over its conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    piece = messages.select("conv_id", "at", role.alias("role"), F.concat(F.lit(BEGIN), escape(role), F.lit(MIDDLE)).alias("head"), escape(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("at", "role", "head", "body")
    size = (F.length("head") + F.length("body") + len(END)).cast("bigint")
    placed = piece.withColumns({"n": F.row_number().over(order), "before": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size})
    span = F.when(F.col("role") == LOSS_ROLE, F.struct((F.col("before") + F.length("head")).cast("int").alias("first"), F.length("body").alias("length")))
    one = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("text"), span.alias("span")))).alias("turns"))
    loss = F.array_compact(F.transform("turns", lambda t: t["span"]))
    return one.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a rendered string."""
    blocks = F.slice(F.split(formatted, r"<\|start\|>"), 2, F.length(formatted))

    def turn(b: Column) -> Column:
        head = F.instr(b, MIDDLE) - 1
        return F.struct(unescape(F.substring(b, F.lit(1), head)).alias("role"), unescape(F.substring(b, head + 1 + len(MIDDLE), F.length(b) - head - len(MIDDLE) - len(END))).alias("text"))

    return F.transform(blocks, turn)


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Registered query: all conversations and the test conversation -1, read back from what was rendered.

    Every row becomes a message of its own, streamed as an opening, a draft that is regenerated, and two deltas, so that the
    result comes from the fold.  Rows of one turn follow each other by role and text.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("turn"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    half = F.floor(F.length("text") / 2).cast("int")
    streamed = [("message", F.col("role"), None), ("delta", None, F.lit("a draft")), ("regenerate", None, None), ("delta", None, F.substring("text", F.lit(1), half)), ("delta", None, F.substring("text", half + 1, F.length("text")))]
    none = F.lit(None).cast("string")
    log = [F.struct((F.col("nth") * len(streamed) + i).alias("seq"), F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text")) for i, (kind, role, text) in enumerate(streamed)]
    numbered = rows.unionByName(extra).withColumn("nth", nth)
    events = numbered.select("conv_id", F.concat(F.lit("m"), F.col("nth").cast("string")).alias("message_id"), F.explode(F.array(*log)).alias("e")).select("conv_id", "message_id", "e.*")
    out = render(fold_events(events))
    turns = parse(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["first"] + 1, s["length"]))), "")
    return out.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: DuckDB: the digests need only the turns; the rendered length is the turns with one more character for each escape.
OP9_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, regexp_replace(role, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g') as er,
  regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g') as et from rows_
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(er) + length(et) + 27) as bigint) as formatted_chars
from sized group by conv_id
"""
