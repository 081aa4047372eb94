"""Packing, the Merkle manifest and hard negatives against brute force, with every awkward row."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tracklight.llm import hardneg, merkle, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(H.documents(), H.SCHEMA).repartition(3).cache()


# ------------------------------------------------------------------------------------------------ 11
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_text())


def words32(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_are_the_tokenizers():
    rng, coder, plain = random.Random(3), packing.Encoder(packing.tokenizer_text()), model()
    texts = ["", " ", "<|endoftext|> a <|startoftext|>", "it's I'll 'some !'s YOU'RE don't''t", "Áb é!! É! é=­İ_", "a b　c d\x1ce\x85f", "日本語、テスト!! x日本!", "a≠b ̸= ΑΣ ΑΣ!", "x\x00y \x01"]
    letters = "aAé'ßs t!?.%̸́=<1²Ⅷ日😀 \x1c_İΣǅ​­"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [words32(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert coder.encode([t.encode() for t in texts]) == want


def test_ids_of_long_texts_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 64)
    monkeypatch.setattr(packing, "KEPT_BYTES", 2000)
    rng, coder, plain = random.Random(5), packing.Encoder(packing.tokenizer_text()), model()
    texts = [H.prose(rng, n) for n in (1, 50, 400)] + ["x" * 500, "é!" * 200 + " end"]
    assert coder.encode([t.encode() for t in texts]) == [words32(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def fewest(lengths, capacity):
    """The least number of sequences, by search over all ways."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(order):
            best[0] = len(room)
            return
        for r in sorted({x for x in room if x >= order[i]}):
            k = room.index(r)
            go(i + 1, room[:k] + [r - order[i]] + room[k + 1 :])
        go(i + 1, [*room, capacity - order[i]])

    go(0, [])
    return best[0]


def test_bounds_hold_and_certify():
    rng, tight = random.Random(1), 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 20])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 9))])
        best, bound = fewest(lengths.tolist(), capacity), packing.lower_bound(np.bincount(lengths, minlength=capacity + 1))
        bins, offsets, left = packing.best_fit(lengths, capacity)
        assert bound <= best <= len(left)
        tight += bound == best
        for b in range(len(left)):
            inside = sorted((int(o), int(n)) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b)
            assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))] and sum(n for _, n in inside) + left[b] == capacity
    assert tight > 135
    # sixes and sevens of ten do not share a sequence: their sum alone would not show it
    assert packing.lower_bound(np.bincount([6, 7, 6, 7, 6], minlength=11)) == 5


def test_exchanges_save_sequences(spark):
    """Many small partitions leave gaps; after exchanges all lengths together meet their bound."""
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    items = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "row bigint, piece int, length bigint")
    alone = packing.deal(items, 3000, 100, 0, 40).select("sequence_id").distinct().count()
    placed = packing.place(items, 100, 40)
    used = placed.select("sequence_id").distinct().count()
    assert packing.lower_bound(np.bincount(lengths, minlength=101)) <= used < alone - 50 and placed.count() == 3000


def held(rows, texts, length):
    """Every piece is right, and sequences have no gaps; the number of sequences."""
    plain, seq, pieces = model(), {}, {}
    for doc, p in rows:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length, p.ids))
        pieces.setdefault(doc, []).append((p.piece, p.start, p.length, p.ids_crc32, bytes(p.ids)))
    for doc, many in texts.items():
        got, want = sorted(pieces.pop(doc)), []
        for text in many:
            ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), length):
                part = words32(ids[k : k + length])
                want.append((k // length, k, len(part) // 4, zlib.crc32(part), part))
        assert got == sorted(want)
    assert not pieces
    for items in seq.values():
        at = 0
        for offset, n, _ in sorted(items):
            assert offset == at
            at += n
        assert at <= length
    return seq


def test_packing_equals_brute_force(spark, docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    extra = [(None, "null id", None, None, 7), (0, "again", "en", "s1", 5), (0, "again", "en", "s1", 5)]
    texts[None], texts[0] = ["null id"], texts[0] + ["again", "again"]
    packed = packing.pack(docs.unionByName(spark.createDataFrame(extra, H.SCHEMA)).withColumns({"packed": F.lit(1), "_": F.lit(2), "row": F.lit(3)}), length=64)
    assert packed.columns == ["doc_id", "lang", "source", "n_chars", "packed", "_", "row", "packed_"]
    seq = held([(r.doc_id, r.packed_) for r in packed.collect()], texts, 64)
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(packed, "packed_").collect()}
    assert whole == {k: (sum(n for _, n, _ in v), b"".join(bytes(i) for *_, i in sorted(v))) for k, v in seq.items()}


def test_packing_of_empty_tables_and_the_query(spark, docs):
    assert packing.pack(docs.limit(0)).count() == 0
    rows = packing.op11_packing(spark, SF).collect()
    lengths = np.array([r.length for r in rows])
    assert len({r.sequence_id for r in rows}) <= packing.lower_bound(np.bincount(lengths, minlength=2049)) + 1
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# ------------------------------------------------------------------------------------------------ 12
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def sealed(rows, change):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree_of([leaf_of(r) for r in by[s]]) for s in order}
    top, out = tree_of([trees[s][-1][0] for s in order]), []
    for i, s in enumerate(order):
        for j, r in enumerate(by[s]):
            now, proof = leaf_of(change(r)), ""
            for nodes, k in ((trees[s], j), (top, i)):
                for level in nodes[:-1]:
                    run, at = level[k // 16 * 16 :][:16], k % 16
                    proof += "".join(run[:at] + run[at + 1 :])
                    now, k = sha("".join([*run[:at], now, *run[at + 1 :]])), k // 16
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return out


def tampered(r):
    return (*r[:4], H.lower(r[4]) if r[4] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r


def folded(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    change = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_of(changed={"text": merkle.lower_case("text")}))
    got = merkle.manifest(docs, replacement=change, **more)
    return [(r.doc_id, *r.sealed) for r in got.select("doc_id", "sealed").collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 700, None: 3, "": 1, "é": 40, "B": 257}, {f"s{i}": i % 3 + 1 for i in range(40)}])
def test_merkle_equals_brute_force(spark, sizes):
    rng, rows = random.Random(4), []
    for source, n in sizes.items():
        rows += [(rng.randint(0, 10**6), source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice([None, "", "Abc Ä", H.prose(rng, 3).upper()])) for _ in range(n)]
    assert key(folded(spark, rows)) == key(sealed(rows, tampered))


def test_merkle_of_null_and_repeated_ids(spark):
    rows = [(None, "a", None, None, t) for t in ("x", "Y", "x")] + [(5, "a", "en", 1, "A")] * 40 + [(5, None, "en", 1, "B"), (7, "a", "en", 1, "T" * 100_000)]
    got = folded(spark, rows)
    assert key(got) == key(sealed(rows, tampered)) and len(got) == len(rows)
    assert folded(spark, []) == []


def test_merkle_keeps_columns_and_folds_right_siblings_only(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t", i) for i in range(20)], "doc_id bigint, source string, lang string, n_chars bigint, text string, sealed bigint")
    got = merkle.manifest(docs)
    assert got.columns == [*docs.columns, "sealed_"] and all(r.sealed_.verified and r.sealed == r.doc_id for r in got.collect())
    # a state kept for a slot makes all to its left irrelevant: digests there may be lost
    nodes = [sha(str(i)) for i in range(16)]
    batch = pa.record_batch({"tree": ["t"], "run": [0], "nodes": [16], "children": [nodes]})
    run = next(iter(merkle.close_runs(iter([batch])))).to_pylist()[0]
    assert run["digest"] == sha("".join(nodes))
    lost = b"0" * (64 * 9) + run["digests"][64 * 9 :]
    block = np.frombuffer(sha("new").encode(), ">u4").reshape(1, 16).astype(np.uint32)
    found = merkle.fold(np.zeros(1, np.int64), block, [[{"slot": None, "digests": lost, "states": run["states"]}]], np.array([9]))
    assert merkle.as_text(found) == [sha("".join([*nodes[:9], sha("new"), *nodes[10:]]))]


# ------------------------------------------------------------------------------------------------ 13
def mined(rows, anchors, positives=5, negatives=10):
    out = []
    for a, label, v in anchors:
        score = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=False))
        ranked = sorted((-score(w), i, other) for i, other, w in rows)
        for s, p, _ in [r for r in ranked if r[2] == label and r[1] != a][:positives]:
            inside = [r for r in ranked if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside)]
    return sorted(out)


SIX = "id bigint, label bigint, vector array<bigint>"


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(6)
    centres = [[rng.randint(-40, 60) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        rows.append((i, rng.randint(0, 3), [x + rng.randint(-9, 9) for x in c]))
    rows += [(1, rows[1][1], rows[1][2])] * 30 + [(2000, 0, [3, 4]), (2001, 1, []), (2002, 9, [5] * 6), (30, rows[30][1], rows[30][2])]
    df = spark.createDataFrame(rows, SIX).repartition(5)
    want = mined(rows, [r for r in rows[:900] if r[0] % 30 == 0])
    for block, wave in ((1024, 1 << 20), (7, 7 * 8 * 6)):  # one tree, and many waves
        got = hardneg.hard_negatives(df, df.where("id % 30 = 0 and id < 900"), block=block, wave_bytes=wave)
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 500


def test_bounds_spare_scores():
    """Anchors close to each other: most candidates are decided by their bounds."""
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, (1, 16))
    anchors = base + rng.integers(-1, 2, (40, 16))
    table = pa.table({"rank": np.arange(40), "id": np.arange(40), "label": np.zeros(40, np.int64), "vector": pa.array(anchors.tolist(), pa.list_(pa.int64()))})
    (block,) = hardneg.blocks_of(table)
    v = rng.integers(-50, 50, (3000, 16)).astype(float)
    cut = np.sort(v @ block.vectors[0])[-30]
    scored = hardneg.sweep(block, v, np.sqrt((v**2).sum(axis=1)), lambda c, low, high: np.flatnonzero(high >= cut), lambda *_: None)
    assert scored < 0.5 * v.shape[0] * 40


def test_hard_negatives_edges(spark):
    schema = "vec_id bigint, embedding array<float>, label int, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1, 0), (1, [1.0, 0.25], 1, 0), (2, [0.5, 0.5], 2, 0), (3, None, 2, 0), (4, [nan, 1.0], 2, 0), (5, [inf, 1.0], 2, 0), (6, [None, 1.0], 2, 0), (7, [0.5, 0.5], None, 0), (None, [0.5, 0.5], 2, 0)]
    whole = hardneg.whole_vectors(spark.createDataFrame(rows, schema), F.col("label"))
    assert sorted(r.id for r in whole.collect()) == [0, 1, 2]
    got = hardneg.hard_negatives(whole, whole.where("id = 0")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256 + 128 * 64, 256 * 128 + 128 * 128)]
    assert hardneg.hard_negatives(whole.limit(0), whole.limit(0)).count() == 0
    assert hardneg.hard_negatives(whole, whole.where("id = 2")).count() == 0  # no positive
    with pytest.raises(Exception, match="scores do not fit"):
        big = spark.createDataFrame([(0, [1e12], 1, 0), (1, [1e12], 1, 0)], schema)
        big = hardneg.whole_vectors(big, F.col("label"))
        hardneg.hard_negatives(big, big).count()
