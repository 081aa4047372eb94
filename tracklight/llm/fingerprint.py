"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it is one less than a multiple of the block size, so boundaries
depend on nearby text only.  The block size is the smallest ``3 * 2**k`` that cuts the whole text into at most 64
chunks; each chunk gives one base-64 character, and a second signature has twice the block size.  Fingerprints are
compared at equal or neighbouring block sizes by the edit distance (insertions and deletions) of their signatures,
computed bit-parallel for many pairs at once; signatures without a common run of ``RUN`` characters are unlike.

Neighbours: documents in descending order of id are dealt to ranges between sampled splitters; each range also gets a
copy of the first document of the range after it, so that every task finds each document's successor in its own sorted
run, which it reads in passing.  Null and much-repeated ids are split by a hash of their text, and equal rows by their
place, so no id fills a range.

Defined results: a null text is empty, with fingerprint ``3::``; rows that share an id are ordered by hash of their
text and text; null ids come last; ids must be integers; the only document is its own successor; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, fresh, read, span_hashes, spool, utf8

WINDOW = 7
FIRST_BLOCK, LONGEST = 3, 64
#: Characters in a row that two signatures must share (all of a shorter signature).
RUN = 4
#: Text bytes in a range, about, and ranges at most (their splitters and first rows are what reaches the driver; beyond
#: it ranges grow, which tasks read in passing).
RANGE_BYTES, RANGES = 24 << 20, 10_000

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def levels(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the rolling hash ends a chunk at block size 3, and up to which power of two it still does."""
    n = len(raw)
    h = np.zeros(n, np.uint32)
    since = np.minimum(np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)), WINDOW).astype(np.uint8)
    low, shifts = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(min(WINDOW, n)):
        c = np.zeros(n, np.uint32)
        c[j:] = raw[: n - j] if j else raw
        c[since < j] = 0  # before the row's first byte
        low += np.uint32(WINDOW + 1 - j) * c  # the plain and the weighted sum
        shifts ^= c << np.uint32(5 * j)
    h = low + shifts + np.uint32(1)
    at = np.flatnonzero((h % np.uint32(FIRST_BLOCK) == 0) & (h != 0))
    v = h[at].astype(np.int64)
    return at, np.bitwise_count((v & -v) - 1).astype(np.int64)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text: k (block size 3 * 2**k); two signatures as rows of 0..63 (padded with 255), and their lengths."""
    n = len(texts)
    raw, offsets = utf8(texts)
    size = np.diff(offsets)
    at, level = levels(raw, offsets)
    row = np.searchsorted(offsets, at, side="right") - 1
    # a boundary on the last byte leaves no rest, but counting one chunk more than boundaries is right for all others
    top = int(level.max()) + 2 if len(level) else 1
    many = np.bincount(row * top + np.minimum(level, top - 1), minlength=n * top).reshape(n, top)
    above = many[:, ::-1].cumsum(axis=1)[:, ::-1]  # boundaries at each k
    fits = above < LONGEST
    k = np.where(fits.any(axis=1), fits.argmax(axis=1), top)
    signatures, lengths = [], []
    for more in (0, 1):
        cut = level >= k[row] + more
        ends = at[cut] + 1
        rests = offsets[1:][size > 0]
        ends = np.union1d(ends, rests)
        owner = np.searchsorted(offsets, ends - 1, side="right") - 1
        starts = np.append(0, ends[:-1])
        if len(ends):
            starts = np.maximum(starts, offsets[owner])
        code = (span_hashes(raw, starts, ends) >> np.uint64(58)).astype(np.uint8)
        length = np.bincount(owner, minlength=n)
        sig = np.full((n, LONGEST), 255, np.uint8)
        sig[owner, np.arange(len(ends)) - np.repeat(np.cumsum(length) - length, length)] = code
        signatures.append(sig), lengths.append(length)
    return k, signatures, lengths


def written(k: np.ndarray, signatures: list[np.ndarray], lengths: list[np.ndarray]) -> list[str]:
    """Fingerprints as text: block size, signature, signature at twice the size."""
    text = [[ALPHABET[s[i, : m[i]]].tobytes().decode() for i in range(len(k))] for s, m in zip(signatures, lengths, strict=True)]
    return [f"{FIRST_BLOCK << int(x)}:{a}:{b}" for x, a, b in zip(k, *text, strict=True)]


def alike(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """1 - edit distance / both lengths, row by row: the longest common subsequence, one bit per character of ``a``."""
    n = len(a)
    masks = np.zeros((n, 256), np.uint64)
    rows = np.arange(n)
    for i in range(LONGEST):
        on = i < la
        masks[rows[on], a[on, i]] |= np.uint64(1) << np.uint64(i)
    masks[:, 255] = 0
    v = np.full(n, ~np.uint64(0))
    for j in range(LONGEST):
        m = masks[rows, b[:, j]]
        u = v & m
        v = (v + u) | (v - u)
    full = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~v & full).astype(float)
    score = np.where(la + lb > 0, 2 * common / np.maximum(la + lb, 1), 1.0)
    run = np.minimum(RUN, np.minimum(la, lb))
    shares = np.ones(n, bool)
    for r in range(1, RUN + 1):
        who = np.flatnonzero(run == r)
        if len(who):
            grams = []
            for s, m in ((a[who], la[who]), (b[who], lb[who])):
                g = sum(s[:, k : LONGEST - r + 1 + k].astype(np.int64) << (8 * k) for k in range(r))
                g[np.arange(g.shape[1])[None, :] > (m - r)[:, None]] = -1 - len(grams)
                grams.append(g)
            shares[who] = [bool(np.isin(x, y).any()) for x, y in zip(*grams, strict=True)]
    shares[(run == 0) & (la + lb > 0)] = False
    return np.where(shares, score, 0.0)


def likeness(x: tuple, y: tuple) -> np.ndarray:
    """Of fingerprints row by row, at equal or neighbouring block sizes; others are unlike."""
    (ka, (a1, a2), (la1, la2)), (kb, (b1, b2), (lb1, lb2)) = x, y
    out = np.zeros(len(ka))
    for who, pairs in (
        (ka == kb, ((a1, la1, b1, lb1), (a2, la2, b2, lb2))),
        (ka == kb + 1, ((a1, la1, b2, lb2),)),
        (kb == ka + 1, ((a2, la2, b1, lb1),)),
    ):
        for a, la, b, lb in pairs:
            if who.any():
                out[who] = np.maximum(out[who], alike(a[who], la[who], b[who], lb[who]))
    return np.round(out, 6)


def take(fp: tuple, which: slice) -> tuple:
    k, s, m = fp
    return k[which], [x[which] for x in s], [x[which] for x in m]


def compare_run(texts: list[str]) -> dict[str, list]:
    """Rows for all but the last of consecutive documents; each one's successor follows it."""
    own = fingerprints(pa.array(texts, pa.string()))
    edited = [t[: len(t) - len(t) // 2] + s[: len(t) // 2] for t, s in zip(texts[:-1], texts[1:], strict=True)]
    changed = fingerprints(pa.array(edited, pa.string()))
    here, after = take(own, slice(0, -1)), take(own, slice(1, None))
    return {
        "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": written(*here), "edited_fingerprint": written(*changed), "near_edited": likeness(here, changed), "near_next": likeness(here, after),
    }


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, name: str = "printed") -> DataFrame:
    """``keep`` columns (all by default) and a struct ``name`` of ``RESULT``, for every row of ``docs``; underscores are
    added if the name is taken."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegralType, StructField, StructType

    from .sharding import range_of, splitters_for

    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must hold integers, to be ordered")
    spark = docs.sparkSession
    bounded_batches(spark)
    keep, name = list(docs.columns if keep is None else keep), fresh(docs, name)
    body = F.coalesce(F.col(text), F.lit(""))
    # ascending by the complement of the id is descending by id; then by the text's hash, whose lowest bits are given up for
    # a row's place: that spreads equal rows over ranges, and nothing else depends on it
    h = F.coalesce(F.bitwise_not(F.col(doc_id).cast("bigint")), F.lit((1 << 63) - 1))
    content = F.xxhash64(body).bitwiseAND(F.lit(-65536))
    tie = content.bitwiseOR(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(65536)))
    plain = docs.select(F.struct(*keep).alias("kept"), body.alias("body"), h.alias("h"), content.alias("content"), tie.alias("tie"))
    keys = spool(plain.select("h", "tie", (F.octet_length("body") + 32).cast("bigint").alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = splitters_for(keys, min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // RANGE_BYTES) + 1)))
    # a range begins with all rows of a text, or cuts through equal ones: no place in the table moves any other row
    whole = [(a, b & -65536) for a, b in cuts]
    cuts = sorted({cut if i and c == whole[i - 1] else c for i, (c, cut) in enumerate(zip(whole, cuts, strict=True))})
    ranges = len(cuts) + 1
    # one row a range: what it begins with; each range, empty or not, is visited by what the next one begins with
    begins = sorted((r["range"], r["first"].h, r["first"].tie & -65536) for r in keys.withColumn("range", range_of(cuts)).groupBy("range").agg(F.min(F.struct("h", "tie")).alias("first")).collect())
    visits: dict[tuple[int, int], list[int]] = {}
    for i, (r, *_) in enumerate(begins):
        upto = begins[i + 1][0] if i + 1 < len(begins) else ranges + begins[0][0]
        visits.setdefault(tuple(begins[(i + 1) % len(begins)][1:]), []).extend(x % ranges for x in range(r, upto))
    asked = spark.createDataFrame([(a, b, to) for (a, b), to in visits.items()], "h bigint, content bigint, to array<int>")
    guests = plain.join(F.broadcast(asked), ["h", "content"]).groupBy("h", "content").agg(F.first("body").alias("body"), F.first("to").alias("to"))  # at most a row a range
    guests = guests.select(F.lit(None).cast(plain.schema["kept"].dataType).alias("kept"), "h", "body", F.explode("to").alias("to"), F.lit(True).alias("guest"))
    home = plain.select("kept", "h", "body", range_of(cuts).cast("int").alias("to"), F.lit(False).alias("guest"))
    run = home.unionByName(guests).repartitionById(ranges, "to").sortWithinPartitions("to", "guest", "h", F.xxhash64("body"), "body").select("kept.*", F.col("body").alias("__body"), F.col("to").alias("__to"), F.col("guest").alias("__guest"))
    schema = StructType([docs.schema[c] for c in keep] + [StructField(name, StructType.fromDDL(RESULT))])
    arrow, n_keep = to_arrow_schema(schema), len(keep)
    made = list(arrow.field(n_keep).type)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts, size, where, done = [], [], 0, None, False

        def flush() -> Iterator[pa.RecordBatch]:
            if len(texts) > 1:
                got = compare_run(texts)
                struct = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type) for f in made], fields=made)
                columns = [pa.array([row[i] for row in kept[:-1]], type=arrow.field(i).type) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*columns, struct], schema=arrow)
            del kept[:-1], texts[:-1]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, (t, to, guest) in enumerate(zip(*columns[n_keep:], strict=True)):
                if to != where:
                    yield from flush()
                    kept.clear(), texts.clear()
                    where, done, size = to, False, 0
                if done:
                    continue  # only the first guest is a successor
                kept.append([c[i] for c in columns[:n_keep]]), texts.append(t)
                done, size = guest, size + len(t)
                if size > SLICE_BYTES:
                    yield from flush()
                    size = len(t)
        yield from flush()

    return run.mapInArrow(compare, schema)


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents."""
    found = fingerprint(read(spark, sf_dir, "documents"), keep=["doc_id"], name="p")
    return found.select("doc_id", "p.n_chars", "p.edited_sha256", "p.fingerprint", "p.edited_fingerprint", "p.near_edited", "p.near_next")
