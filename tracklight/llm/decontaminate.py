"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of rows of one Spark partition.  Its words become symbols, an FM-index is built over them
(suffix order by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix positions), the test
windows are searched backwards, occurrences are located by walking to sampled positions, and the covered word
spans of each document are merged.

Alphabet: the index keeps the words that occur in some benchmark item.  All other words, document ends, and runs of
benchmark words that are shorter than the shortest window are gaps, which no window crosses; this is exact, since no
occurrence can touch them.

Defined results: null or wordless texts have no words and no hits; repeated rows and repeated ``doc_id`` are judged row
by row; items without words are ignored; a null ``item_id`` is reported as the text ``null``; items with one id count
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, WORD_BYTES, annotate, fresh, mix64, span_hashes, spool, utf8, word_spans

#: Words in a window.
WINDOW = 13
#: Benchmark text that one pass over the documents searches for (its phrases take about twice as many bytes in the driver
#: and in each worker); larger benchmarks take one pass for each such block.
BLOCK_BYTES = 16 << 20
#: Text in a shard (the rows that one index covers).
SHARD_BYTES = 3 << 20
#: Every so many positions the index stores where a suffix lies.
SAMPLE_EVERY = 16

RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,last:bigint>>"


# ---------------------------------------------------------------------------------------------------- phrases
class Phrases:
    """The distinct windows of some items, as places in the items' text of symbols (1, 2, ... over their vocabulary).

    Windows are kept by their rarest word, so that a shard only searches those whose words it has.  Each holds a few
    numbers, whatever its width.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = np.array(sorted({str(i) for i, _ in items}), object)
        raw, offsets = utf8(pa.array([t for _, t in items], type=pa.string()))
        raw = ASCII_LOWER[raw]
        starts, ends, counts = word_spans(raw, offsets, WORD_BYTES)
        self.vocabulary, symbols = np.unique(span_hashes(raw, starts, ends), return_inverse=True)
        self.text = symbols.astype(np.int32) + 1
        width = np.minimum(window, counts)
        many = np.where(counts > 0, counts - width + 1, 0)  # windows of each item
        item = np.repeat(np.arange(len(counts)), many)
        at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(counts) - counts, many)
        length = width[item]
        # equal windows have equal hashes of their symbols; the first of each stands for all
        h = mix64(length.astype(np.uint64))
        for k in range(int(length.max()) if len(length) else 0):
            inside = k < length
            h[inside] = mix64(h[inside] * np.uint64(0x9E3779B97F4A7C15) + self.text[at[inside] + k].astype(np.uint64))
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        owner = np.searchsorted(self.ids.astype(str), np.array([str(i) for i, _ in items]))[item] if len(item) else item
        pairs = np.unique(np.stack([same, owner]), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        self.at, self.length = at[first].astype(np.int32), length[first].astype(np.int32)
        # by rarest word
        often = np.bincount(self.text, minlength=len(self.vocabulary) + 1)
        rare = np.zeros(len(self.at), np.int64)
        if len(self.at):
            table = self.rows(np.arange(len(self.at)))
            rare = table[np.arange(len(table)), np.where(table > 0, often[table], 1 << 62).argmin(axis=1)]
        order = np.argsort(rare, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.length = self.at[order], self.length[order]
        self.by_word = np.searchsorted(rare[order], np.arange(len(self.vocabulary) + 2))
        window_of, self.owner = place[pairs[0]], pairs[1].astype(np.int32)
        by_window = np.argsort(window_of, kind="stable")
        self.owner, self.owned = self.owner[by_window], np.searchsorted(window_of[by_window], np.arange(len(self.at) + 1))
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The symbols of some windows, a right-aligned row each."""
        width = int(self.length.max()) if len(self.length) else 0
        k = np.arange(width)[None, :] - (width - self.length[which].astype(np.int64))[:, None]
        return np.where(k >= 0, self.text[np.maximum(self.at[which][:, None] + k, 0)], 0).astype(np.int64)

    def candidates(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose words are ``present`` (a flag for each symbol, from 0), and their symbols."""
        words = np.flatnonzero(present[1:]) + 1
        lo, many = self.by_word[words], self.by_word[words + 1] - self.by_word[words]
        which = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        table = self.rows(which)
        whole = (present[table] | (table == 0)).all(axis=1)
        return which[whole], table[whole]

    def items(self, windows: np.ndarray) -> list[str]:
        """The ids of the items with any of some windows, sorted."""
        if not len(windows):
            return []
        return self.ids[np.unique(np.concatenate([self.owner[self.owned[w] : self.owned[w + 1]] for w in windows.tolist()]))].tolist()


# ---------------------------------------------------------------------------------------------------- index
class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """A wavelet matrix: the symbols' bits from the highest down, each level stably split by the bit above."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs among the first ``i``."""
        lo = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            r_lo, r_i = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + r_lo, lo - r_lo), np.where(one, zeros + r_i, i - r_i)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions ``i``."""
        out = np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, r = bits.get(i), bits.rank(i)
            out = out * 2 + one
            i = np.where(one == 1, zeros + r, i - r)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order, each compared up to its first gap (0), ties by position.

    Two suffixes with the same words up to a gap are ordered by position, which is also the order of what follows the
    first word, so the order is consistent under last-to-first mapping.
    """
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    at = np.arange(n)
    rest = gaps[np.searchsorted(gaps, at)] - at  # words before the next gap; the text ends with a gap
    order = np.argsort(text, kind="stable")
    rank = text.astype(np.int64)
    done = 1
    while True:
        srt = rank[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(srt[1:], srt[:-1], out=new[1:])
        dense = np.cumsum(new) - 1
        rank = np.empty(n, np.int64)
        rank[order] = dense
        alone = np.append(new[1:], True) & new
        if not np.any(~alone & (rest[order] >= done)):  # all ties left have ended within what was compared
            return order
        follow = np.where(rest >= done, rank[np.minimum(at + done, n - 1)] + 1, 0)
        rank = rank * np.int64(n + 2) + follow
        order = np.argsort(rank, kind="stable")
        done *= 2


class FMIndex:
    """Count and locate word sequences in ``text`` (symbols from 1; 0 is a gap; it must end with a gap)."""

    def __init__(self, text: np.ndarray, alphabet: int, every: int = SAMPLE_EVERY):
        order = suffix_order(text)
        before = np.append(0, text)[order]  # the symbol left of each suffix: the transform
        self.first = np.zeros(alphabet + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=alphabet)[:alphabet], out=self.first[1:])
        self.n, self.wavelet = len(text), Wavelet(before, alphabet)
        sampled = (order % every == 0) | (before == 0)  # starts of runs too: no walk crosses a gap
        self.marks, self.positions = Bits(sampled.astype(np.uint8)), order[sampled]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each right-aligned row of symbols the range of suffixes that begin with it, by backward search."""
        lo = np.zeros(len(table), np.int64)
        hi = np.full(len(table), self.n, np.int64)
        for column in table.T[::-1]:
            live = np.flatnonzero((column > 0) & (hi > lo))
            if not len(live):
                continue
            c = column[live]
            base = self.first[c]
            lo[live], hi[live] = base + self.wavelet.rank(c, lo[live]), base + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by last-to-first steps to the nearest sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            here = self.marks.get(rows) == 1
            out[todo[here]] = self.positions[self.marks.rank(rows[here])] + steps
            todo, rows = todo[~here], rows[~here]
            if len(rows):
                c = self.wavelet.access(rows)
                rows = self.first[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


# ---------------------------------------------------------------------------------------------------- shards
def search_shard(phrases: Phrases, texts: pa.Array) -> dict[str, list]:
    """Word counts, hit words, items and merged spans (first and last word, from 0) of each row."""
    n = len(texts)
    raw, offsets = utf8(texts)
    raw = ASCII_LOWER[raw]
    starts, ends, counts = word_spans(raw, offsets, WORD_BYTES)
    out = {"n_words": counts, "n_hit": np.zeros(n, np.int64), "items": [[] for _ in range(n)], "spans": [[] for _ in range(n)]}
    if not phrases.shortest or not len(starts):
        return out
    words = span_hashes(raw, starts, ends)
    spot = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[spot] == words, spot + 1, 0)
    row = np.repeat(np.arange(n), counts)
    # runs of benchmark words within a row, long enough for some window
    known = symbol > 0
    opens = known & np.append(True, ~known[:-1] | (row[1:] != row[:-1]))
    run = np.cumsum(opens)
    length = np.bincount(run[known], minlength=int(run[-1]) + 1)
    keep = np.flatnonzero(known & (length[run] >= phrases.shortest))
    if not len(keep):
        return out
    gap_before = np.append(False, run[keep][1:] != run[keep][:-1])
    place = np.arange(len(keep)) + np.cumsum(gap_before)  # where each kept word lies in the indexed text
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = symbol[keep]
    word_at = np.full(len(text), -1, np.int64)
    word_at[place] = keep

    present = np.zeros(len(phrases.vocabulary) + 1, bool)
    present[text] = True
    candidates, table = phrases.candidates(present)
    if not len(candidates):
        return out
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(table)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    many = (hi - lo)[hit]
    which = np.repeat(candidates[hit], many)
    rows = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[hit], many)
    first_word = word_at[index.locate(rows)]
    # merge the spans: words that some occurrence covers
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first_word, 1)
    np.add.at(cover, first_word + phrases.length[which], -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_hit"] = np.bincount(row[covered], minlength=n)
    begin = np.cumsum(counts) - counts
    edge = covered & np.append(True, ~covered[:-1] | (row[1:] != row[:-1]))
    last = covered & np.append(~covered[1:] | (row[1:] != row[:-1]), True)
    for a, b in zip(np.flatnonzero(edge).tolist(), np.flatnonzero(last).tolist(), strict=True):
        r = int(row[a])
        out["spans"][r].append({"first": a - int(begin[r]), "last": b - int(begin[r])})
    pairs = np.unique(row[first_word] * len(phrases.at) + which)
    for r in np.unique(pairs // len(phrases.at)).tolist():
        mine = pairs[np.searchsorted(pairs, r * len(phrases.at)) : np.searchsorted(pairs, (r + 1) * len(phrases.at))]
        out["items"][r] = phrases.items(mine % len(phrases.at))
    return out


def search_block(docs: DataFrame, benchmark: DataFrame, text: str, window: int, name: str, keep: list[str]) -> DataFrame:
    """One pass: each row's ``keep`` columns and the struct that ``search_shard`` gives for a block (item, text) of items."""
    found = benchmark.select("item", "text").sort("item", "text").collect()  # bounded by block_bytes
    shared = docs.sparkSession.sparkContext.broadcast(Phrases([(r.item, r.text) for r in found], window))
    return annotate(docs, [text], RESULT, lambda _, texts: search_shard(shared.value, texts), name, keep, slice_bytes=SHARD_BYTES)


def cut_items(batches: Iterator[pa.RecordBatch], window: int, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts of (item, text) in pieces of about ``piece_bytes`` that share a window less one word: no window is lost, and a
    piece has no window that the text lacks."""
    for batch in batches:
        items, cut = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw, offsets = utf8(pa.array([text.as_py()], pa.string()))
            starts, ends, _ = word_spans(ASCII_LOWER[raw], offsets, WORD_BYTES)
            first = 0
            while first < len(starts):
                last = int(np.searchsorted(ends, starts[first] + piece_bytes, side="right")) - 1
                last = min(max(last, first + window - 1), len(starts) - 1)  # one whole window at least
                items.append(item)
                cut.append(raw[starts[first] : ends[last]].tobytes().decode())
                first = last - window + 2 if last < len(starts) - 1 else len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(cut, pa.string())], names=["item", "text"])


def item_blocks(items: DataFrame, total: int, window: int, block_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Distinct items (item, text) with their block (part, nr), and all blocks: parts of a shuffle are cut by running sums
    of sizes, and items larger than a block are cut into pieces, so a block is bounded by twice ``block_bytes``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    long = items.where(size > block_bytes).mapInArrow(lambda b: cut_items(b, window, max(1, block_bytes // 2)), "item string, text string")
    pieces = items.where(size <= block_bytes).unionByName(long)
    laid = spool(pieces.repartition(total // block_bytes + 1, "item", "text").select("item", "text", F.spark_partition_id().alias("part")), "items")
    before = Window.partitionBy("part").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    cut = spool(laid.withColumn("nr", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / block_bytes)), "blocks")
    return cut, sorted((r.part, r.nr) for r in cut.select("part", "nr").distinct().collect())  # one row a pass


def merged(parts: DataFrame) -> DataFrame:
    """(rid, n_words, n_hit, items, spans) from rows (rid, r) of several passes: spans that touch or overlap become one,
    found by a running maximum over each row's spans in order."""
    order = Window.partitionBy("rid").orderBy("first", "last")
    spans = parts.select("rid", F.explode("r.spans").alias("s")).select("rid", "s.*")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    each = opened.withColumn("k", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = each.groupBy("rid").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    items = parts.groupBy("rid").agg(F.first("r.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.items")))).alias("items"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return items.join(whole.hint("merge"), "rid", "left").select("rid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), "items", F.coalesce("spans", none).alias("spans"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, name: str = "contamination", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each row's ``keep`` columns (all by default) and a struct ``name``: n_words, n_hit, items, spans.

    The phrases travel to the tasks, so the benchmark's distinct items are measured first.  Beyond ``block_bytes`` of text it is cut into
    blocks: rows are then numbered in a table of their own, each block is one pass over that, which leaves a table of
    counts, items and spans, and the passes are merged by row; one block's phrases are held at a time.
    """
    plain = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")).distinct()
    total = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    spans = fresh(docs, name)
    kept = list(docs.columns if keep is None else keep)
    if total < block_bytes:
        return search_block(docs, plain, text, window, spans, kept)
    rid = fresh(docs, "rid")
    rows = spool(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    parts = None
    items, blocks = item_blocks(plain, int(total), window, block_bytes)
    for part_, nr in blocks:
        part = search_block(rows, items.where((F.col("part") == part_) & (F.col("nr") == nr)), text, window, fresh(rows, "r"), [rid])
        part = spool(part.toDF("rid", "r"), "pass")
        parts = part if parts is None else parts.unionByName(part)
    found = spool(merged(parts), "merged").select(F.col("rid").alias(rid), F.struct("n_words", "n_hit", "items", "spans").alias(spans))
    return rows.join(found.hint("merge"), rid).select(*kept, spans)


def contaminated(result: str = "contamination"):
    """The contract's rule: some hit, and hit words at least a twentieth of all."""
    return (F.col(result)["n_hit"] > 0) & (20 * F.col(result)["n_hit"] >= F.col(result)["n_words"])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Registered query: every document against every benchmark item."""
    from .common import read

    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    r = F.col("contamination")
    return found.select(
        "doc_id", r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"), F.size(r["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
