"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (character classes, word and line shapes, repetition) are computed with numpy in the tasks.
The trees are fitted to a bounded sample of labelled rows (``TRAIN_ROWS``, drawn by a hash of the id from all rows
outside the held-out fold), on binned statistics with gradient histograms, and flattened into arrays, so that scoring
is a few vectorised numpy steps over all rows and trees at once.  Labels, language, source and ids are never inputs.

Defined results: null texts count as empty and are scored like any text; ids without text, null ids and null labels
are not learned from; an id with several labels counts with their mean, rounded; without labelled rows, or with one
class only, every score is the smoothed share of good labels (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, NONSPACE_BYTES, annotate, fresh, read, span_hashes, utf8, word_spans

#: Labelled rows that the trees are fitted to, at most (about, as a hash draws them).
TRAIN_ROWS = 16_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.15, 1.0, 5.0
THRESHOLD = 0.7

#: Exclusive byte classes.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "bar", "symbol", "quote", "lead", "tail", "other")
_CLASS = np.full(256, CLASSES.index("other"), np.int32)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t"), ("newline", b"\n\r"), ("stop", b"."), ("comma", b",;:"),
    ("bang", b"!?"), ("bar", b"|"), ("symbol", b"#$%&*+/<=>@\\^_`{}~[]"), ("quote", b"\"'()-"), ("lead", range(192, 256)), ("tail", range(128, 192)),
):
    _CLASS[list(_bytes)] = CLASSES.index(_name)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the most frequent key's count, in each row."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(k))))
    return np.bincount(r[at], minlength=n).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(texts)
    raw, offsets = utf8(texts)
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    k = len(CLASSES)
    counts = np.bincount(row * np.int32(k) + _CLASS[raw], minlength=n * k).reshape(n, k).astype(float)
    chars = size - counts[:, CLASSES.index("tail")]
    shares = counts / np.maximum(chars, 1)[:, None]
    starts, ends, words = word_spans(raw, offsets, NONSPACE_BYTES)
    wrow, length = np.repeat(np.arange(n), words), (ends - starts).astype(float)
    hashes = span_hashes(ASCII_LOWER[raw], starts, ends)
    mean = _ratio(np.bincount(wrow, length, n), words)
    spread = np.sqrt(np.maximum(0, _ratio(np.bincount(wrow, length**2, n), words) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, wrow, length)
    distinct, top = _distinct(hashes, wrow, n)
    same_row = wrow[1:] == wrow[:-1]
    stutter = np.bincount(wrow[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=n)
    pairs = (hashes[1:] * np.uint64(3) + hashes[:-1])[same_row]
    two, top_two = _distinct(pairs, wrow[1:][same_row], n)
    upper = (raw >= 65) & (raw <= 90)
    alpha = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    ups, alphas = np.append(0, np.cumsum(upper)), np.append(0, np.cumsum(alpha))
    w_up, w_alpha = ups[ends] - ups[starts], alphas[ends] - alphas[starts]
    shout = np.bincount(wrow[(w_up >= 2) & (w_up * 2 > w_alpha)], minlength=n)
    mute = np.bincount(wrow[w_alpha == 0], minlength=n)
    noisy = np.bincount(wrow[length - w_alpha >= 2], minlength=n)
    single = np.bincount(wrow[length == 1], minlength=n)
    is_line = np.ones(256, np.int8)
    is_line[10] = 0
    l0, l1, lines = word_spans(raw, offsets, is_line)
    lrow = np.repeat(np.arange(n), lines)
    ld, ltop = _distinct(span_hashes(raw, l0, l1), lrow, n)
    ended = np.bincount(lrow[raw[l1 - 1] == 46], minlength=n) if len(l1) else np.zeros(n)
    ll = (l1 - l0).astype(float)
    return np.column_stack([
        shares, np.log1p(chars), np.log1p(words), mean, spread, longest, _ratio(distinct, words), _ratio(top, words), _ratio(stutter, words), _ratio(two, words - 1),
        _ratio(top_two, words - 1), _ratio(shout, words), _ratio(mute, words), _ratio(noisy, words), _ratio(single, words), lines, _ratio(ld, lines), _ratio(ltop, lines),
        _ratio(ended, lines), _ratio(np.bincount(lrow, ll, n), lines), _ratio(words, lines),
        _ratio(distinct, np.sqrt(np.maximum(words, 1))), _ratio(counts[:, CLASSES.index("stop")], words), _ratio(counts[:, CLASSES.index("upper")], words),
    ]).astype(np.float32)


# ---------------------------------------------------------------------------------------------------- trees
class Trees:
    """Fitted trees as arrays: split feature and bin of each inner node, value of each leaf, for all trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, d = x.shape if len(x) else (0, 1)
        share = (y.sum() + 1) / (n + 2) if n else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.zeros(0, np.float32)] * d
        self.feature, self.split, self.leaf = (np.zeros((0, (1 << DEPTH) - 1), np.int64), np.zeros((0, (1 << DEPTH) - 1), np.int64), np.zeros((0, 1 << DEPTH)))
        if n and 0 < y.sum() < n:
            self.edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS).astype(np.float32)) for f in range(d)]
            self._fit(self.bins(x), y)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _fit(self, b: np.ndarray, y: np.ndarray) -> None:
        n, d = b.shape
        score, inner = np.full(n, self.base), (1 << DEPTH) - 1
        features, splits, leaves = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, feature, split = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
            for level in range(DEPTH):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-9)
                for f in range(d):
                    key = (node - first) * BINS + b[:, f]
                    gs, hs = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = -1
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], feature[first:][:width][better], split[first:][:width][better] = top[better], f, at[better]
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > split[node])
            where = node - inner
            value = RATE * np.bincount(where, g, 1 << DEPTH) / (np.bincount(where, h, 1 << DEPTH) + RIDGE)
            score = score + value[where]
            features.append(feature), splits.append(split), leaves.append(value)
        self.feature, self.split, self.leaf = np.array(features), np.array(splits), np.array(leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of a good label: all rows go down all trees together."""
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            b, rows, trees = self.bins(x), np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, self.feature[trees, node]] > self.split[trees, node])
            total += self.leaf[trees, node - ((1 << DEPTH) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


# ---------------------------------------------------------------------------------------------------- operator
def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted to about ``rows`` labelled ids outside the held-out fold, drawn from all by a hash of the id; of an id
    with several texts, the one with the least statistics counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.round(F.avg(label)).alias("y"))
    chance = rows / max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int(min(1.0, chance) * (1 << 30)))
    with_text = docs.select("doc_id", "text").join(drawn.hint("broadcast"), "doc_id")  # at most about `rows` ids
    stats = annotate(with_text, ["text"], "x array<float>", lambda _, t: {"x": list(statistics(t))}, "s", keep=["doc_id", "y"])
    # one row an id, however many repeat it, and sorted, so that the order of tasks doesn't matter
    once = stats.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("s.x").alias("x"))
    got = sorted((r.doc_id, r.y, tuple(r.x)) for r in once.collect())
    return Trees(np.array([x for *_, x in got], np.float32), np.array([y for _, y, _ in got], float))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, label: str = "quality") -> tuple[DataFrame, str]:
    """``keep`` columns (all by default) and a struct with ``score``; also the struct's name."""
    name = fresh(docs, "rated")
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    rate = lambda _, t: {"score": np.round(trees.value.score(statistics(t)), 6)}
    return annotate(docs, ["text"], "score double", rate, name, keep=keep), name


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without what the classifier rejects; all columns stay."""
    rated, name = score_quality(docs, labels)
    return rated.where(F.col(f"{name}.score") >= THRESHOLD).select(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents."""
    rated, name = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    score = F.col(f"{name}.score")
    return rated.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
