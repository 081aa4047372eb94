"""A Merkle manifest of a dataset: an SHA midstate tree whose nodes resume instead of starting again.

Every row is a leaf; a source's leaves ascend by ``doc_id`` and every 16 consecutive nodes have one parent, up to the
source's subroot; subroots, in order of source, have a tree of their own up to the root.  A parent hashes its children's
digests as hexadecimal text.  Such a text is 64 bytes, exactly one SHA-256 block, so the hash state before each child
slot is eight words: a parent keeps a copy of each (``states``) beside its children's digests.  A changed leaf is folded
upwards by taking the parent's copy for its slot and feeding the replacement and the siblings to its right, never those
to its left, and so on at every level.

Leaves are hashed by Spark's ``sha2`` where the texts are, and no text is shuffled.  Ranks within a source come from
ranges of (doc_id, leaf) with exact counts, so one source may be as large as it likes; a run of 16 is then one row.  Each
level is a table in the shared folder, a sixteenth of the one below.  Paths go down again run by run: what a run needs of
the levels above it is 16 digests and 16 states each.

Defined results: a null field is ``-`` and an empty one ``0:``; rows with a null ``doc_id`` come before all others of their
source, and rows of one id are ordered by their leaf (equal rows are interchangeable); a null source is a source, before
all others; a missing column among the leaf's fields raises; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, fresh, read, spool

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range in which ranks are counted.
RANGE_ROWS = 500_000
#: Runs of 16 rows that one numpy step folds.
RUNS = 512

PATH = "slot int, digests binary, states binary"


# ---------------------------------------------------------------------------------------------------- SHA-256 states
def _primes(n: int) -> list[int]:
    found, k = [], 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid - 1)
    return lo


#: The standard's constants: leading bits of the fractions of square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resume(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each of n hash states (n, 8) after one more block of 16 big-endian words (n, 16)."""
    w = [blocks[:, i].astype(np.uint32) for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (states[:, i] for i in range(8))
    for i in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


_HEX = np.array([f"{i:02x}".encode() for i in range(256)], "S2").view(np.uint8).reshape(256, 2)


def finish(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests, as blocks (n, 16) of their hexadecimal text, of states that took ``children`` blocks each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 1 << 31
    last[:, 15] = children * 512
    words = np.ascontiguousarray(resume(states, last).astype(">u4")).view(np.uint8)
    return np.ascontiguousarray(_HEX[words].reshape(-1, 64)).view(">u4").astype(np.uint32)


def as_text(blocks: np.ndarray) -> list[str]:
    """Blocks as the hexadecimal texts they hold."""
    raw = np.ascontiguousarray(blocks.astype(">u4")).tobytes().decode("ascii")
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]


def padded(values: Sequence[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to 16 items of ``width`` big-endian words, filled up with zeros, and how many each row has."""
    out = np.zeros((len(values), FAN, width), np.uint32)
    n = np.zeros(len(values), np.int64)
    for i, v in enumerate(values):
        if v:
            n[i] = len(v) // (4 * width)
            out[i, : n[i]] = np.frombuffer(v, ">u4").reshape(-1, width)
    return out, n


def close_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's children, as a list of hexadecimal texts, hashed into their parent: its digest, what it hashed, and the
    copies of its state before each slot."""
    for batch in batches:
        table = pa.table(batch)
        for lo in range(0, len(table), RUNS):
            part = table.slice(lo, RUNS)
            joined = ["".join(c).encode() for c in part["children"].to_pylist()]
            blocks, n = padded(joined, 16)
            state, copies = np.repeat(START[None, :], len(n), axis=0), np.zeros((len(n), FAN, 8), np.uint32)
            for k in range(int(n.max(initial=0))):
                on = n > k
                copies[on, k] = state[on]
                state[on] = resume(state[on], blocks[on, k])
            kept = [copies[i, : n[i]].astype(">u4").tobytes() for i in range(len(n))]
            made = [part["tree"], part["run"], part["nodes"], pa.array(as_text(finish(state, n))), pa.array(joined, pa.binary()), pa.array(kept, pa.binary())]
            yield from pa.table(made, names=["tree", "run", "nodes", "digest", "digests", "states"]).to_batches()


def fold(run: np.ndarray, leaf: np.ndarray, paths: list[list[dict]], own: np.ndarray) -> np.ndarray:
    """Root digests (blocks) after the leaves (n, 16) take their places.  ``run``: the index in ``paths`` of each leaf;
    ``own``: its slot in the first level.  A path lists slot, digests and states level by level; a null slot is the leaf's."""
    current = leaf.copy()
    for level in range(max((len(p) for p in paths), default=0)):
        here = [p[level] if level < len(p) else None for p in paths]
        blocks, n = padded([h and h["digests"] for h in here], 16)
        states, _ = padded([h and h["states"] for h in here], 8)
        slot_of = np.array([-1 if h is None or h["slot"] is None else h["slot"] for h in here], np.int64)
        live = np.flatnonzero(n[run] > 0)
        at = run[live]
        slot = np.where(slot_of[at] < 0, own[live], slot_of[at])
        state = resume(states[at, slot], current[live])
        for step in range(1, FAN):
            on = np.flatnonzero(slot + step < n[at])
            if not len(on):
                break
            state[on] = resume(state[on], blocks[at[on], slot[on] + step])
        current[live] = finish(state, n[at])
    return current


# ---------------------------------------------------------------------------------------------------- trees
def ranked(rows: DataFrame, tree: str, order: list[str], rank: str, nodes: str) -> DataFrame:
    """``rows`` with their rank (from 0) in their ``tree`` by ``order``, and the tree's rows.  Ranges of all rows are
    counted by tree, so no tree is ever in one task."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    tie = fresh(rows, "tie")
    told = rows.withColumn(tie, F.monotonically_increasing_id())
    laid = spool(told.repartitionByRange(n, *order, tie).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = laid.groupBy(tree, "__range").agg(F.count("*").alias("__n"))
    line = Window.partitionBy(tree)
    before = F.sum("__n").over(line.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = spool(counts.select(tree, "__range", before.alias("__start"), F.sum("__n").over(line).alias(nodes)), "starts")
    place = F.row_number().over(Window.partitionBy(tree, "__range").orderBy(*order, tie)) - 1
    return laid.withColumn("__place", place).join(starts.hint("merge"), [tree, "__range"]).withColumn(rank, F.col("__start") + F.col("__place")).drop("__range", "__start", "__place", tie)


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level of all trees, and each tree's top (tree, digest).  ``nodes``: tree, rank, nodes (of the tree),
    digest."""
    tops, runs = [], []
    bounded_batches(nodes.sparkSession)
    while True:
        tops.append(nodes.where("nodes = 1").select("tree", "digest"))
        more = nodes.where("nodes > 1")
        if more.isEmpty():
            break
        child = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        gathered = more.groupBy("tree", F.expr(f"rank div {FAN}").alias("run")).agg(F.first("nodes").alias("nodes"), F.transform(child, lambda c: c["digest"]).alias("children"))
        closed = gathered.mapInArrow(close_runs, "tree string, run bigint, nodes bigint, digest string, digests binary, states binary")
        runs.append(spool(closed, "runs"))
        nodes = runs[-1].select("tree", F.col("run").alias("rank"), F.expr(f"(nodes + {FAN - 1}) div {FAN}").alias("nodes"), "digest")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return runs, out


def step(slot: Column, digests: str = "digests", states: str = "states") -> Column:
    """One level of a path."""
    return F.struct(slot.cast("int").alias("slot"), F.col(digests).alias("digests"), F.col(states).alias("states"))


def paths(runs: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, run, path, subroot, root) of the lowest runs: their own level first, its slot left open, and all that is
    ``above`` (tree, path, subroot, root: what a tree's top has over it)."""
    down = None
    for k, here in reversed(list(enumerate(runs))):
        own = here.select("tree", "run", "nodes", step(F.lit(None)).alias("own"))
        rest = own.where(f"nodes <= {FAN}").join(above.hint("merge"), "tree").select("tree", "run", "own", "path", "subroot", "root")
        if down is not None:
            up = down.select("tree", F.col("run").alias("up"), "path", "subroot", "root")
            inner = own.where(f"nodes > {FAN}").withColumn("up", F.expr(f"run div {FAN}")).join(up.hint("merge"), ["tree", "up"])
            # the level above learns which of its slots this run is
            first = F.get("path", F.lit(0)).withField("slot", F.expr(f"cast(run % {FAN} as int)"))
            rest = rest.unionByName(inner.select("tree", "run", "own", F.concat(F.array(first), F.expr("slice(path, 2, greatest(size(path) - 1, 0))")).alias("path"), "subroot", "root"))
        down = rest.select("tree", "run", F.concat(F.array("own"), "path").alias("path"), "subroot", "root")
        down = spool(down, "paths") if k else down
    return down


def field(c: str) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row's fields, some of them ``changed``."""
    parts = []
    for c in fields:
        if changed and c in changed:
            text = changed[c].cast("string")
            parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        else:
            parts.append(field(c))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, replacement: Column | None = None, keep: Sequence[str] | None = None, name: str = "sealed") -> DataFrame:
    """``keep`` columns (all by default) and a struct ``name``: leaf, subroot, root, proof_sha256 (of all siblings from the
    leaf's run up to the root's, left to right), folded_root and verified.

    ``replacement`` is the leaf digest to verify for each row, for example recomputed from another copy of the data; null
    means the row's own.  Underscores are added if ``name`` is taken."""
    keep, name = list(docs.columns if keep is None else keep), fresh(docs, name)
    leaf = leaf_of(fields)
    # '0' for no source, else '1' and the source: null comes first, and all others in the order of their bytes
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))
    rows = docs.select(F.struct(*keep).alias("kept"), tree.alias("tree"), F.col(doc_id).alias("id"), leaf.alias("leaf"), (leaf if replacement is None else F.coalesce(replacement, leaf)).alias("offered"))
    leaves = spool(ranked(spool(rows, "hashed"), "tree", ["id", "leaf"], "rank", "nodes"), "leaves")
    runs, tops = levels(leaves.select("tree", "rank", "nodes", F.col("leaf").alias("digest")))
    crown = spool(ranked(tops.select(F.lit("root").alias("all"), "tree", "digest"), "all", ["tree"], "rank", "nodes"), "subroots")
    upper, root = levels(crown.select(F.col("all").alias("tree"), "rank", "nodes", "digest"))
    none = F.expr(f"cast(array() as array<struct<{PATH.replace(' ', ':').replace(',:', ',')}>>)")
    high = paths(upper, root.select("tree", none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))) if upper else None
    seated = crown.select(F.col("tree").alias("source"), F.col("all").alias("tree"), F.expr(f"rank div {FAN}").alias("run"), F.expr(f"cast(rank % {FAN} as int)").alias("slot"), F.col("digest").alias("subroot"))
    if high is None:  # one source, or none: its subroot is the root
        above = seated.select(F.col("source").alias("tree"), none.alias("path"), "subroot", F.col("subroot").alias("root"))
    else:
        met = seated.join(high.drop("subroot").hint("merge"), ["tree", "run"])
        first = F.get("path", F.lit(0)).withField("slot", F.col("slot"))
        above = met.select(F.col("source").alias("tree"), F.concat(F.array(first), F.expr("slice(path, 2, greatest(size(path) - 1, 0))")).alias("path"), "subroot", "root")
    above = spool(above, "crown")
    alone = above.join(tops.join(leaves.where("nodes = 1").select("tree"), "tree", "left_semi").select("tree"), "tree", "left_semi").withColumn("run", F.lit(0).cast("bigint"))
    whole = alone.select("tree", "run", "path", "subroot", "root")
    if runs:
        whole = paths(runs, above).unionByName(whole)
    member = F.struct("rank", "leaf", "offered", "kept")
    grouped = leaves.groupBy("tree", F.expr(f"rank div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(member), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("members"), (F.first("nodes") == 1).alias("single"))
    return folded(grouped.join(whole.hint("merge"), ["tree", "run"]), docs, keep, name)


SEALED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(runs: DataFrame, docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """A row for each member of each run (members, single, path, subroot, root), its leaf folded up to the root."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    schema = StructType([docs.schema[c] for c in keep] + [StructField(name, StructType.fromDDL(SEALED))])
    arrow, n_keep = to_arrow_schema(schema), len(keep)
    made = list(arrow.field(n_keep).type)
    sent = runs.select("members.leaf", "members.offered", "members.kept", "single", "path", "subroot", "root").toDF("leaf", "offered", "kept", "single", "path", "subroot", "root")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            for lo in range(0, len(table), RUNS):
                part = table.slice(lo, RUNS).combine_chunks()
                leaves, way = part["leaf"].to_pylist(), part["path"].to_pylist()
                subroots, roots = part["subroot"].to_pylist(), part["root"].to_pylist()
                size = np.array([len(x) for x in leaves], np.int64)
                run = np.repeat(np.arange(len(size)), size)
                own = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
                offered = part["offered"].combine_chunks().flatten().to_pylist()
                block = np.frombuffer("".join(offered).encode("ascii"), ">u4").reshape(-1, 16).astype(np.uint32)
                got = as_text(fold(run, block, way, own))
                proofs = []
                for members, steps, single in zip(leaves, way, part["single"].to_pylist(), strict=True):
                    over = b"".join(s["digests"][: 64 * s["slot"]] + s["digests"][64 * s["slot"] + 64 :] for s in steps[0 if single else 1 :])
                    text = "".join(members).encode() if not single else b""
                    proofs += [hashlib.sha256(text[: 64 * i] + text[64 * i + 64 :] + over).hexdigest() for i in range(len(members))]
                flat = {"leaf": [x for m in leaves for x in m], "subroot": [subroots[r] for r in run], "root": [roots[r] for r in run], "proof_sha256": proofs, "folded_root": got}
                flat["verified"] = [a == b for a, b in zip(got, flat["root"], strict=True)]
                kept = part["kept"].combine_chunks().flatten()
                columns = [pa.concat_arrays([c]).cast(arrow.field(i).type) for i, c in enumerate(kept.flatten())] if n_keep else []
                struct = pa.StructArray.from_arrays([pa.array(flat[f.name], type=f.type) for f in made], fields=made)
                yield pa.RecordBatch.from_arrays([*columns, struct], schema=arrow)
        pa.default_memory_pool().release_unused()

    return sent.mapInArrow(climb, schema)


def lower_case(text: str) -> Column:
    """The text with A-Z alone in lower case."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents; where 5 divides the id's crc32, the text offered for verification is lower-cased."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of(changed={"text": lower_case("text")}))
    found = manifest(docs, replacement=tampered, keep=["doc_id"], name="m")
    return found.select("doc_id", *[f"m.{c}" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")])


def _oracle(depth: int = 5) -> str:
    """SQL of the query for trees of at most 16**depth leaves: every parent is hashed anew, none is resumed."""
    f = lambda e: f"coalesce(cast(strlen({e}) as varchar)||':'||{e}, '-')"
    leaf = lambda text: "sha256(" + "||".join(f(e) for e in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda c, b: xor(c >> 8, bits[cast(xor(c, b) & 255 as int) + 1])))"
    bits = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"
    ctes = [
        f"crc as (select {bits} as bits)",
        f"d0 as (select *, '1'||source as tree, {leaf('text')} as leaf, case when ({crc}) % 5 = 0 then {leaf(lower)} end as t from documents, crc)",
        "d as (select doc_id, coalesce(tree, '0') as tree, leaf, coalesce(t, leaf) as f from d0)",
        "n0 as (select tree, leaf as h, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by tree) as n from d)",
        "w0 as (select doc_id, tree, leaf, f, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as r, '' as proof from d)",
    ]

    def climb(a: str, b: str, seats: str, carried: str) -> str:
        """A level: ``a`` nodes and ``b`` walkers become the next ones."""
        ctes.append(f"g{a} as (select tree, r // {FAN} as r, n, list(h order by r) as hs from n{a} group by tree, r // {FAN}, n)")
        after = f"{seats}{int(a[len(seats):] or 0) + 1}"
        ctes.append(f"n{after} as (select tree, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h, r, (n + {FAN - 1}) // {FAN} as n from g{a})")
        slot = f"cast(w.r % {FAN} as int)"
        left, right = f"array_to_string(hs[1:{slot}], '')", f"array_to_string(hs[{slot} + 2:], '')"
        ctes.append(f"w{after} as (select {carried}, w.tree, case when n = 1 then f else sha256({left}||f||{right}) end as f, w.r // {FAN} as r, case when n = 1 then proof else proof||{left}||{right} end as proof from w{b} w join g{a} g on w.tree = g.tree and w.r // {FAN} = g.r)")
        return after

    at = "0"
    for _ in range(depth):
        at = climb(at, at, "", "doc_id, leaf")
    ctes.append(f"nr0 as (select '' as tree, tree as source, h, row_number() over (order by tree) - 1 as r, count(*) over () as n from n{at})")
    ctes.append(f"wr0 as (select doc_id, leaf, n.h as subroot, '' as tree, f, n.r, proof from w{at} w join nr0 n on w.tree = n.source)")
    top = "r0"
    for _ in range(depth):
        top = climb(top, top, "r", "doc_id, leaf, subroot")
    return f"with {', '.join(ctes)} select w.doc_id, w.leaf, w.subroot, n.h as root, sha256(w.proof) as proof_sha256, w.f as folded_root, w.f = n.h as verified from w{top} w, n{top} n"


OP12_SQL = _oracle()
