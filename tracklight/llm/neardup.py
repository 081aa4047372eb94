"""Near-duplicate documents by SetSketch registers: band, estimate jointly by likelihood, verify on full sets.

A document's set holds its distinct five-word shingles.  Each set gets ``REGISTERS`` SetSketch registers: the minimum
of exponentially distributed values over its members, on an exponentially spaced, truncated scale (registers of a
union are the maxima of the registers).  The values come from one Poisson process per member, whose points fall on
random registers; generation stops where no register of the set can change any more.

1. Documents with equal sets (two 64-bit sums over the members) form a class; its smallest ``doc_id`` stands for it.
2. Classes that share a band of registers meet in a bucket.  A bucket never emits all its pairs: its members are first
   compared with its smallest member, the hub.  26 bands of 5 registers miss a pair at similarity 0.85 about once in four
   million, and one at 0.80 about once in thirty thousand.
3. A pair's similarity is estimated by maximum likelihood from how many registers are smaller, equal and larger, given
   both set sizes; only pairs for which the threshold is all but impossible are dropped.
4. What remains is confirmed on the full sets, computed from the whole texts of both sides.
5. Components by minimum-label propagation with pointer jumping; every step is a table in the shared folder.
6. Buckets of one hub form a group.  Groups whose members are then in one component are done.  In the others, pairs of
   different components are still open, and are searched for exactly and without a cap.  First every member's shingles are
   put in one order, rare ones first: two sets that reach the threshold (say 0.85) share a shingle among the first 15 in a
   hundred of the larger and the first 8 in a hundred of the smaller one.  Members that meet no other component in such a shingle
   are done, at a cost that grows with the members alone, however large their group.  The rest, which differ from others by
   little more or less than the threshold (more than registers can tell), are compared exactly: the group is cut into
   blocks of bounded size, and a task gets two blocks, counts all common shingles by one product of two incidence
   matrices, and returns no more links than connect them.

Defined results: null, empty and wordless texts have an empty set, linked with nothing; texts of fewer than five
words are one shingle; a null ``doc_id`` is linked with nothing and has a null component; repeated rows get the same
verdict, and of rows that repeat both id and text ``drop_near_duplicates`` keeps one.  An id is taken to name one document:
rows of one id with different texts link what each of them is linked with.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, NONSPACE_BYTES, annotate, bounded_batches, fresh, mix64, read, slices, span_hashes, spool, utf8, word_spans

SHINGLE = 5
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: The registers' scale: base, rate, largest value.
BASE, RATE, LIMIT = 1.01, 20.0, 8190
#: Similarity of a link, in hundredths: of the operator and the pipeline's stage, and of the registered query.
THRESHOLD, QUERY_THRESHOLD = 80, 85
#: A pair is dropped unseen only if its best likelihood beats that at the threshold by this many nats.
SURE = 18.0
#: Tables of at most so many ids may be broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000
#: Members and text bytes of a block of a group.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20
#: Shared shingles that one step of the incidence product covers.
BLOCK_COLUMNS = 16_384
#: Counters of the table that tells rare shingles from frequent ones (any table gives an order, so its size bears on cost
#: alone, not on what is found).
COUNTERS = 1 << 18

SET = "n bigint, bytes bigint, f1 bigint, f2 bigint, regs binary, bands array<bigint>"


# ---------------------------------------------------------------------------------------------------- sets
def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted within the row, and how many each row has."""
    raw, offsets = utf8(texts)
    raw = ASCII_LOWER[raw]
    starts, ends, counts = word_spans(raw, offsets, NONSPACE_BYTES)
    words = span_hashes(raw, starts, ends)
    # a shingle hashes `size` words; shorter texts hash all their words, after padding that no word equals
    n = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    first = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    limit = np.repeat(np.cumsum(counts), n)
    mixed = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = first + k
        inside = at < limit
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(0x1B873593 + k))
    mixed = mix64(mixed)
    edge = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        mixed[a:b].sort()
    row = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (row[1:] != row[:-1])
    return mixed[new], np.bincount(row[new], minlength=len(n))


def registers(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SetSketch registers of consecutive sets, a row of ``REGISTERS`` values each (0 for empty sets)."""
    m = REGISTERS
    least = np.full(len(counts) * m, np.inf)
    row, state, x = np.repeat(np.arange(len(counts)), counts), members, np.zeros(len(members))
    step = 1
    while len(state):
        for _ in range(step):
            state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
            uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            x = x - np.log(uniform) / (m * RATE)
            spot = ((mix64(state ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(least, row * m + spot, x)
        bound = least.reshape(-1, m).max(axis=1)
        live = x < bound[row]
        row, state, x = row[live], state[live], x[live]
        step = min(32, step * 2)
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(value, 0, LIMIT + 1).astype(np.uint16).reshape(-1, m)


def describe(_, texts: pa.Array) -> dict[str, list]:
    """Set size, set fingerprint, registers and band hashes of each row."""
    members, counts = shingle_sets(texts)
    regs = registers(members, counts)
    ends = np.cumsum(counts)
    total = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(members ^ np.uint64(salt)))])
        total.append((sums[ends] - sums[ends - counts]).view(np.int64))
    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(counts), axis=0) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x100000001B3) + regs[:, k::ROWS].astype(np.uint64))
    bands = h.view(np.int64)
    return {"n": counts, "bytes": np.diff(utf8(texts)[1]), "f1": total[0], "f2": total[1], "regs": [r.tobytes() for r in regs], "bands": list(bands)}


# ---------------------------------------------------------------------------------------------------- pairs
def log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given the sets' shares ``u + v = 1`` of both sizes and the counts of register relations."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def plausible(_, ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array, threshold: int = THRESHOLD) -> dict[str, list]:
    """The likeliest similarity of each pair, and whether the threshold is still possible."""
    a = np.frombuffer(b"".join(ra.to_pylist()), np.uint16).reshape(-1, REGISTERS)
    b = np.frombuffer(b"".join(rb.to_pylist()), np.uint16).reshape(-1, REGISTERS)
    na, nb = na.to_numpy(zero_copy_only=False).astype(float), nb.to_numpy(zero_copy_only=False).astype(float)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        c, d = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = log_likelihood(c, u, v, more, less, same) < log_likelihood(d, u, v, more, less, same)
        lo, hi = np.where(right, c, lo), np.where(right, hi, d)
    best = (lo + hi) / 2
    line = np.minimum(threshold / 100, np.minimum(u / v, v / u))
    gap = log_likelihood(best, u, v, more, less, same) - log_likelihood(line, u, v, more, less, same)
    return {"estimate": best, "possible": (best >= line) | (gap < SURE)}


def confirm(_, ta: pa.Array, tb: pa.Array, ia: pa.Array, ib: pa.Array, threshold: int = THRESHOLD) -> dict[str, list]:
    """Whether each pair's full sets reach the threshold; a text that occurs in several pairs is cut up once."""
    n = len(ta)
    ids = pa.concat_arrays([ia, ib]).to_numpy(zero_copy_only=False)
    texts = pa.concat_arrays([ta, tb])
    _, first, back = np.unique(ids, return_index=True, return_inverse=True)
    members, counts = shingle_sets(texts.take(pa.array(first)))
    ends = np.cumsum(counts)
    linked = []
    for x, y in zip(back[:n].tolist(), back[n:].tolist(), strict=True):
        a, b = members[ends[x] - counts[x] : ends[x]], members[ends[y] - counts[y] : ends[y]]
        both = len(a) + len(b)
        common = both - len(np.union1d(a, b)) if both else 0
        linked.append(bool(both) and 100 * common >= threshold * (both - common))
    return {"linked": linked}


def semi(big: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """``big`` with (or without, ``left_anti``) the ids: broadcast if they are counted as few, else by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return big.join(ids.hint("broadcast" if few else "merge"), key, how)


def told_once(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one row for each id and text; only the ids in ``again`` repeat.  Partial aggregates leave
    one row a task of however many repeat."""
    if again.isEmpty():
        return docs
    h = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    once = spool(semi(docs, again, "doc_id").groupBy("doc_id", *h).agg(F.first("text").alias("text")).select("doc_id", "text"), "once")
    return semi(docs, again, "doc_id", "left_anti").unionByName(once)


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of class representatives that are links."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    sized = sized.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    rated = annotate(sized, ["ra", "rb", "na", "nb"], "estimate double, possible boolean", partial(plausible, threshold=threshold), "e", keep=["a", "b"])
    likely = spool(rated.where("e.possible").select("a", "b").distinct(), "pairs")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = semi(docs.select("doc_id", "text"), ids, "doc_id")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    joined = likely.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    sure = annotate(joined, ["ta", "tb", "a", "b"], "linked boolean", partial(confirm, threshold=threshold), "v", keep=["a", "b"])
    return sure.where("v.linked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each linked id can reach."""
    both = spool(links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*"), "links")
    labels = spool(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.hint("merge"), both["y"] == labels["id"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), labels["id"] == near["x"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("via"))
        new = spool(step.join(jump.hint("merge"), "label").select("id", F.least("label", "via").alias("label"), "old"), "labels")
        labels = new.select("id", "label")
        if new.where("label < old").isEmpty():
            return labels


def count_shingles(texts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """About how many texts have each shingle, by the lowest bits of its hash."""

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                members, _ = shingle_sets(batch.column(0).slice(lo, hi - lo))
                total += np.bincount((members & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    bounded_batches(texts.sparkSession)
    got = texts.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most `counters` rows
    out = np.zeros(counters, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def prefixes(counts: np.ndarray, texts: pa.Array, threshold: int = THRESHOLD) -> dict[str, list]:
    """The first shingles of each set, rare ones first: as many as a set that is not larger can miss, and how many of them
    one that is not smaller can."""
    members, n = shingle_sets(texts)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((members, counts[(members & np.uint64(len(counts) - 1)).astype(np.int64)], row))
    members = members[order].view(np.int64)
    begin = np.cumsum(n) - n
    probe = n - -(-threshold * n // 100) + 1
    index = n - -(-2 * threshold * n // (100 + threshold)) + 1
    some = n > 0
    return {"shingles": [members[a : a + k] for a, k in zip(begin.tolist(), np.where(some, probe, 0).tolist(), strict=True)], "n_index": np.where(some, index, 0), "n": n}


def close_members(members: DataFrame, texts: DataFrame, counters: int = COUNTERS, threshold: int = THRESHOLD) -> DataFrame:
    """The members (rep, label, out) that share a leading shingle with one of another component, one of both being out:
    every pair across components that reaches the threshold is among them.  ``texts``: doc_id, text of the members."""
    shared = texts.sparkSession.sparkContext.broadcast(count_shingles(texts, counters))
    cut = annotate(texts, ["text"], "shingles array<bigint>, n_index bigint, n bigint", lambda _, t: prefixes(shared.value, t, threshold), "p", keep=["doc_id"])
    first = cut.select(F.col("doc_id").alias("rep"), F.posexplode("p.shingles").alias("pos", "key"), F.col("p.n_index").alias("n_index"))
    rows = spool(first.join(members.hint("merge"), "rep").select("key", "rep", "label", "out", (F.col("pos") < F.col("n_index")).alias("short")), "prefixes")
    keys = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max("short").alias("short"), F.max("out").alias("out")).where("least < most and short and out").select("key")
    met = rows.join(spool(keys, "keys").hint("merge"), "key", "left_semi")
    return members.join(met.select("rep").distinct().hint("merge"), "rep", "left_semi")


def block_links(_, ids_a: pa.Array, ids_b: pa.Array, labels_a: pa.Array, labels_b: pa.Array, texts_a: pa.Array, texts_b: pa.Array, threshold: int = THRESHOLD) -> dict[str, list]:
    """Links between members of two blocks that are in different components: a spanning forest of them."""
    out = []
    for row in range(len(ids_a)):
        ids = np.array(ids_a[row].as_py() + ids_b[row].as_py())
        labels = np.array(labels_a[row].as_py() + labels_b[row].as_py())
        texts = pa.concat_arrays([texts_a[row].values, texts_b[row].values])
        members, counts = shingle_sets(texts)
        p, owner = len(ids_a[row]), np.repeat(np.arange(len(ids)), counts)
        values, where, often = np.unique(members, return_inverse=True, return_counts=True)
        column = np.cumsum(often > 1) - 1  # only shared shingles matter
        shared = often[where] > 1
        owner, where = owner[shared], column[where[shared]]
        common = np.zeros((p, len(ids) - p), np.float32)
        for lo in range(0, int((often > 1).sum()), BLOCK_COLUMNS):
            now = (where >= lo) & (where < lo + BLOCK_COLUMNS)
            has = np.zeros((len(ids), BLOCK_COLUMNS), np.float32)
            has[owner[now], where[now] - lo] = 1
            common += has[:p] @ has[p:].T
        union = counts[:p, None] + counts[None, p:] - common
        linked = (100 * common >= threshold * union) & (labels[:p, None] != labels[None, p:])
        root = {x: x for x in labels.tolist()}

        def find(x: int, root: dict = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, j in np.argwhere(linked).tolist():
            a, b = find(int(labels[i])), find(int(labels[p + j]))
            if a != b:
                root[a] = b
                found.append({"a": int(ids[i]), "b": int(ids[p + j])})
        out.append(found)
    return {"links": out}


def group_links(groups: DataFrame, labels: DataFrame, docs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) across components within each group (hub, rep): none is missed, and pairs are compared block by block."""
    named = groups.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("hub", "rep", F.coalesce("label", "rep").alias("label"))
    named = spool(named.join(sets.select(F.col("doc_id").alias("rep"), "bytes").hint("merge"), "rep"), "named")
    own = named.where("hub = rep").select("hub", F.col("label").alias("hub_label"))
    marked = spool(named.join(own.hint("merge"), "hub").withColumn("main", F.col("label") == F.col("hub_label")), "marked")
    open_hubs = spool(marked.where("not main").select("hub").distinct(), "open")
    marked = spool(marked.join(open_hubs.hint("merge"), "hub"), "marked")
    members = spool(marked.groupBy("rep").agg(F.first("label").alias("label"), F.max(~F.col("main")).alias("out")), "members")
    texts = semi(docs.select("doc_id", "text"), members.select(F.col("rep").alias("doc_id")), "doc_id")
    close = spool(close_members(members, texts, threshold=threshold).select("rep"), "close")
    marked = spool(marked.join(close.hint("merge"), "rep", "left_semi"), "marked")
    part = lambda main, what: F.sum(F.when(F.col("main") == main, what).otherwise(0))
    blocks = lambda main: F.ceil(F.greatest(part(main, F.lit(1)) / BLOCK_ROWS, part(main, F.col("bytes")) / BLOCK_BYTES)).cast("int")
    open_ = marked.groupBy("hub").agg(blocks(True).alias("n_main"), blocks(False).alias("n_out"), F.count("*").alias("many")).where("n_out > 0 and many > 1")
    open_ = spool(open_, "groups")  # a table, so that the join below has no aggregate in its stage and a hot group can be split
    at = marked.select("hub", "rep", "label", "main").join(open_.drop("many").hint("merge"), "hub")
    at = spool(at.withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_out"))))), "open")
    texts = semi(docs.select("doc_id", "text"), at.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").withColumnRenamed("doc_id", "rep")
    full = at.join(texts.hint("merge"), "rep").groupBy("hub", "main", "block").agg(F.first("n_main").alias("n_main"), F.first("n_out").alias("n_out"), F.collect_list(F.struct("rep", "label", "text")).alias("m"))
    full = spool(full, "blocks")
    none = F.array().cast("array<struct<main:boolean,block:bigint>>")
    targets = F.concat(
        F.when(F.col("n_main") > 0, F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda j: F.struct(F.lit(True).alias("main"), j.cast("bigint").alias("block")))).otherwise(none),
        F.transform(F.sequence(F.col("block").cast("int"), F.col("n_out") - 1), lambda j: F.struct(F.lit(False).alias("main"), j.cast("bigint").alias("block"))),
    )
    left = full.where("not main").select("hub", F.explode(targets).alias("t"), F.col("m").alias("ma")).select("hub", "t.*", "ma")
    met = left.join(full.select("hub", "main", "block", F.col("m").alias("mb")).hint("merge"), ["hub", "main", "block"])
    sides = met.select("ma.rep", "mb.rep", "ma.label", "mb.label", "ma.text", "mb.text").toDF("ia", "ib", "la", "lb", "ta", "tb")
    found = annotate(sides, ["ia", "ib", "la", "lb", "ta", "tb"], "links array<struct<a:bigint,b:bigint>>", partial(block_links, threshold=threshold), "f", keep=[])
    return found.select(F.explode("f.links").alias("l")).select("l.*").distinct()


def link(docs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, label) of all linked class representatives.  ``sets``: a row for each class, with registers and bands."""
    rows = sets.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("rep").alias("hub")).where("many > 1").select("key", "hub")
    groups = spool(rows.join(shared.hint("merge"), "key").select("hub", "rep").distinct(), "groups")
    links = spool(verify(groups.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")), docs, sets, threshold), "links")
    labels = components(links)
    more = spool(group_links(groups, labels, docs, sets, threshold), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def verdicts(plain: DataFrame, threshold: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``plain`` (doc_id, text, and columns that are carried)."""
    carried = [c for c in plain.columns if c != "text"]
    sketched = annotate(plain, ["text"], SET, describe, "s", keep=carried)
    table = spool(sketched.select(*carried, "s.*", F.monotonically_increasing_id().alias("__place")), "sketches")
    members = table.where("n > 0 and doc_id is not null")
    # one row stands for a class, however many repeat its smallest id
    least = F.min(F.struct("doc_id", F.col("__place").alias("place"))).alias("least")
    classes = spool(members.groupBy("f1", "f2", "n").agg(least).select("f1", "f2", "n", F.col("least.doc_id").alias("rep"), "least.place"), "classes")
    sets = spool(members.join(classes.select(F.col("place").alias("__place")).hint("merge"), "__place", "left_semi").select("doc_id", "n", "bytes", "regs", "bands"), "sets")
    again = spool(members.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    labels = link(told_once(plain.select("doc_id", "text"), again), sets, threshold)
    named = classes.join(labels.hint("merge"), classes["rep"] == labels["id"], "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("label"))
    joined = table.drop("bytes", "regs", "bands", "__place").join(named.hint("merge"), ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    return joined.select(*carried, F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (see the module's text)."""
    return verdicts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), threshold)


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose component has a smaller ``doc_id``, and with one of each set of rows that repeat
    both id and text; all columns stay.  Rows without words and rows without an id stay as they are."""
    key = ["doc_id", fresh(docs, "text_a"), fresh(docs, "text_b")]
    hashed = docs.withColumns({key[1]: F.xxhash64("text"), key[2]: F.xxhash64(F.lit(1), "text")})
    judged = verdicts(hashed.select("text", *key), threshold).where("n_shingles > 0 and doc_id is not null")
    told = judged.groupBy(*key).agg(F.max("kept").alias("stays"), F.count("*").alias("rows_"))
    told = spool(told.where("not stays or rows_ > 1"), "gone")
    rest = semi(hashed, told.select(*key), key, "left_anti").select(*docs.columns)
    again = told.where("stays").select(*key)
    if again.isEmpty():
        return rest
    # partial aggregates leave one row a task of however many repeat
    one = semi(hashed, again, key).groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return rest.unionByName(one.select("row.*"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, links at similarity 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), threshold=QUERY_THRESHOLD)
