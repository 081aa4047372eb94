"""Line dedup with overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines are hashed (two 64-bit hashes); hashes that occur more than once anywhere are repeated
windows; their first occurrence, by smallest doc_id and then position, stays, and each later one covers its lines.
The merged covered lines of a document are removed.  Only hashes and positions are shuffled; a hash that occurs in a
third of all documents is counted with partial sums and joined as a skewed key.

Defined results: a document of one or two lines is one window, equal only to documents of the same lines; null and
empty texts have no lines and stay as they are; windows of blank lines only are never repeated; a null doc_id comes
after all others; repeated rows (same doc_id and text) share one verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, spool

WINDOW = 3
#: So many covered lines may be broadcast; beyond it the same join shuffles.
BROADCAST_LINES = 1_000_000


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(k_id, k_hash, lines): positions (from 0, sorted) that later occurrences cover, by doc_id and hash of the text."""
    lines = docs.where((F.length(text) > 0)).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.split(text, "\n", -1).alias("ls"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ls") - (size - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.slice("ls", i, size).alias("w")))
    full = F.filter(cut, lambda c: F.exists(c["w"], lambda x: F.trim(x) != ""))
    hashed = F.transform(full, lambda c: F.struct(c["pos"].alias("pos"), F.size(c["w"]).alias("n"), F.xxhash64(c["w"], F.size(c["w"])).alias("h1"), F.xxhash64(F.lit(17), F.reverse(c["w"])).alias("h2")))
    windows = spool(lines.select("id", "hash", F.explode(hashed).alias("c")).select("id", "hash", "c.*"), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos"))
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1").select("h1", "h2", "first")
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
    spread = later.select("id", "hash", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("line"))
    return spread.groupBy(F.col("id").alias("k_id"), F.col("hash").alias("k_hash")).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with a struct ``deduped`` (n_lines, removed positions, text); underscores if the name is taken."""
    name = fresh(docs, "deduped")
    gone = spool(covered_lines(docs, doc_id, text, size), "covered")
    few = (gone.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]) <= BROADCAST_LINES
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("body"))
    met = rows.join(gone.hint("broadcast" if few else "merge"), F.col("id").eqNullSafe(F.col("k_id")) & (F.xxhash64("body") == F.col("k_hash")), "left")
    lines = F.when(F.length("body") > 0, F.split("body", "\n", -1)).otherwise(F.array().cast("array<string>"))
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    # what lies between two removed lines stays: a slice for each gap, so that the work grows with the lines alone
    edge = lambda j, otherwise: F.coalesce(F.get("removed", j), F.lit(otherwise) if isinstance(otherwise, int) else otherwise)
    begin = lambda j: F.when(j == 0, 0).otherwise(edge(j - 1, 0) + 1)
    gap = lambda j: F.slice("all", begin(j) + 1, F.greatest(F.lit(0), edge(j, F.size("all")) - begin(j)))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("removed")), gap)), "\n")
    done = met.select("row", "body", lines.alias("all"), removed.alias("removed"))
    clean = F.when(F.size("removed") > 0, kept).otherwise(F.col("body"))
    return done.select("row.*", F.struct(F.size("all").cast("bigint").alias("n_lines"), "removed", clean.alias("text")).alias(name))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents."""
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    d = F.col("deduped")
    return found.select("doc_id", d["n_lines"].alias("n_lines"), F.size(d["removed"]).cast("bigint").alias("n_removed"), F.sha2(F.coalesce(d["text"], F.lit("")), 256).alias("clean_sha256"))


OP3_SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents where length(text) > 0),
w0 as (select doc_id, text, ls, unnest(range(1, greatest(len(ls) - 2, 1) + 1)) as i from l),
w as (select doc_id, text, i, list_slice(ls, i, i + 2) as win from w0),
w1 as (select * from w where len(list_filter(win, lambda x: trim(x) <> '')) > 0),
f as (select *, row_number() over (partition by win order by doc_id nulls last, i) as rn from w1),
c as (select distinct doc_id, text, unnest(range(i, i + len(win))) as pos from f where rn > 1),
e as (select doc_id, text, unnest(ls) as line, generate_subscripts(ls, 1) as pos from l),
k as (select e.doc_id, e.text, count(*) as n_lines, count(c.pos) as n_removed,
  coalesce(string_agg(e.line, chr(10) order by e.pos) filter (where c.pos is null), '') as clean
  from e left join c on e.doc_id = c.doc_id and e.text = c.text and e.pos = c.pos group by e.doc_id, e.text)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.clean, d.text, '')) as clean_sha256
from documents d left join k on d.doc_id = k.doc_id and d.text = k.text
"""
