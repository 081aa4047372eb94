"""Language identification with language-bitmask n-gram filters.

Each language keeps its most frequent four-letter grams (words are lower-cased and bounded by a marker).  All languages
share one bit-sliced Bloom filter: position p holds a mask with one bit per language, and the AND of a gram's
positions is the set of languages that contain it.  A text's grams are counted per language by bit; the counts are
corrected for each filter's false-positive rate, divided by the share of its own language's grams that a filter covers,
and the largest share decides.

Learned from a bounded sample: at most about ``TRAIN_ROWS`` documents of each language, drawn by a hash of the id from
all rows with text, language and an id outside the held-out fold.  Language, source and id are never inputs.

Defined results: texts that are null or have no letter are ``und`` with score 0; letters without any known gram give
the most frequent language with score 0; without anything to learn from all texts are ``und``; repeated rows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import annotate, fresh, mix64, read

GRAM = 4
#: Documents learned from and grams kept, for each language.
TRAIN_ROWS, GRAMS = 2_000, 4_000
#: Positions of the filter (a power of two) and hashes for each gram.
BITS, HASHES = 1 << 17, 4
#: Distinct languages that the sampling table may have to be broadcast.
BROADCAST_LANGS = 10_000
#: Languages that are learned at most, the most frequent ones: what reaches the driver is bounded by this times ``GRAMS``.
LANGUAGES = 2_000

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """A flag for each code point: is it a letter?  (Made once in a worker.)"""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes of a slice of texts, the row of each, and whether each row has a letter."""
    rows = ["" if t is None else t for t in texts.to_pylist()]
    # a line feed is no letter, so no gram crosses two texts; the one before the first text bounds its first word
    lowered = [t.lower() for t in rows]
    code = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "replace"), np.uint32)
    row = np.append(0, np.repeat(np.arange(len(rows)), [len(t) + 1 for t in lowered]))  # with the line feed after it
    letter = letters()[code]
    keep = letter | np.append(True, letter[:-1])  # the first non-letter after a word bounds it
    code, row, letter = np.where(letter, code, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    has = np.bincount(row[letter], minlength=len(rows)) > 0
    if len(code) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    n = len(code) - GRAM + 1
    h, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        h = h * np.uint64(0x110003) + code[k : k + n]
        if 0 < k < GRAM - 1:
            inner &= letter[k : k + n]
    inner &= letter[:n] | (row[:n] <= row[GRAM - 1 :])
    return mix64(h[inner]), row[1 : n + 1][inner], has


class Filters:
    """The bit-sliced filter; ``counted``: (lang, gram, count, all grams of the language)."""

    def __init__(self, counted: list[tuple[str, int, int, int]]):
        self.langs = sorted({x[0] for x in counted})
        index = {x: i for i, x in enumerate(self.langs)}
        self.words = max(1, -(-len(self.langs) // 64))
        self.masks = np.zeros((self.words, BITS), np.uint64)
        which = np.array([index[x[0]] for x in counted], np.int64)
        hashes = np.array([x[1] for x in counted], np.int64).view(np.uint64)
        count = np.array([x[2] for x in counted], float)
        for spot in self.spots(hashes):
            np.bitwise_or.at(self.masks, (which // 64, spot), np.uint64(1) << (which % 64).astype(np.uint64))
        total = np.ones(len(self.langs))
        total[which] = [x[3] for x in counted]
        self.coverage = np.maximum(np.bincount(which, count, len(self.langs)) / total, 1e-9)
        fill = np.array([np.count_nonzero(self.masks[i // 64] & (np.uint64(1) << np.uint64(i % 64))) / BITS for i in range(len(self.langs))])
        self.false = fill**HASHES
        self.common = int(total.argmax()) if len(self.langs) else 0

    @staticmethod
    def spots(hashes: np.ndarray) -> list[np.ndarray]:
        width = np.uint64(BITS.bit_length() - 1)
        out, h = [], hashes
        for k in range(HASHES):
            if k and k % 3 == 0:  # three positions come from one 64-bit hash
                h = mix64(h ^ np.uint64(0x94D049BB133111EB))
            out.append(((h >> (width * np.uint64(k % 3))) & np.uint64(BITS - 1)).astype(np.int64))
        return out

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """For each gram the masks of the languages that contain it (a row for each 64 languages)."""
        found = np.full((self.words, len(hashes)), ~np.uint64(0))
        for spot in self.spots(hashes):
            found &= self.masks[:, spot]
        return found

    def predict(self, texts: pa.Array) -> dict[str, list]:
        hashes, row, has = grams(texts)
        n, k = len(has), len(self.langs)
        if not k:
            return {"lang": ["und"] * n, "score": np.zeros(n)}
        masks = self.languages(hashes)
        count = np.column_stack([np.bincount(row[(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=n) for i in range(k)])
        total = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
        share = np.clip((count / total - self.false) / (1 - self.false), 0, 1) / self.coverage
        share[share.max(axis=1) <= 0, self.common] = 1e-12
        best = share.argmax(axis=1)
        score = share[np.arange(n), best] / share.sum(axis=1)
        score[share.max(axis=1) <= 1e-9] = 0
        return {"lang": np.where(has, np.array(self.langs, object)[best], "und").tolist(), "score": np.round(np.where(has, score, 0.0), 6)}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _counted(_, texts: pa.Array) -> dict[str, list]:
    hashes, row, has = grams(texts)
    found, counts = [], []
    edge = np.searchsorted(row, np.arange(len(has) + 1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        g, c = np.unique(hashes[a:b].view(np.int64), return_counts=True)
        found.append(g), counts.append(c)
    return {"gram": found, "n": counts}


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, keep: int = GRAMS) -> Filters:
    """Filters from at most about ``rows`` ids a language, of the ``LANGUAGES`` most frequent languages; ``keep`` grams a
    language reach the driver.  A text that one id repeats is learned once."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang", "doc_id").count().groupBy("lang").agg(F.count("*").alias("many"))
    sizes = sizes.orderBy(F.desc("many"), "lang").limit(LANGUAGES)
    few = sizes.count() <= BROADCAST_LANGS
    u = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(sizes.hint("broadcast" if few else "merge"), "lang").where(u * F.col("many") < rows)
    drawn = drawn.groupBy("lang", "doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    cut = annotate(drawn, ["text"], "gram array<bigint>, n array<bigint>", _counted, "g", keep=["lang"])
    flat = cut.select("lang", F.explode(F.arrays_zip("g.gram", "g.n")).alias("x")).select("lang", F.col("x.gram").alias("gram"), F.col("x.n").alias("n"))
    counted = flat.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("lang")
    top = counted.withColumn("total", F.sum("n").over(of)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= keep)
    return Filters(sorted((r.lang, r.gram, r.n, r.total) for r in top.select("lang", "gram", "n", "total").collect()))


def identify(docs: DataFrame, model: Filters, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns (all by default) and a struct (lang, score); also the struct's name."""
    name = fresh(docs, "spoken")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, ["text"], "lang string, score double", lambda _, t: shared.value.predict(t), name, keep=keep), name


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents."""
    docs = read(spark, sf_dir, "documents")
    found, name = identify(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
