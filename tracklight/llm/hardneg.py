"""Hard-negative mining by bounds along a spanning tree of anchors.

Anchors are a stated part of the rows; their positives are the nearest rows of their label, and their hard negatives the
best rows of other labels whose score lies in a window below each positive's.  Scores are inner products of integers.

Anchors are numbered by label and dealt to blocks; a block's minimum spanning tree links anchors that lie close together.
Tasks read the vectors in batches and go through a block from its root: for a child anchor c of p and a candidate v,
``|<c,v> - <p,v>| <= |c - p| |v|``, so p's score (or p's own bounds, where v was not scored there) plus or minus the edge
times v's norm bounds c's score.  Only candidates whose bounds meet what is still open are scored: for positives, all at or
above the fifth best of the label so far; for negatives, the windows, whose lower ends rise to the tenth best so far.
Vectors are never shuffled: a task returns five rows an anchor, or ten a positive, and those are ranked together.

Anchors reach the driver and the tasks in waves of bounded bytes, each with two passes over the vectors.  The work grows
with anchors times rows; that is what was asked for, a stated query set against all rows, in blocks.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part; a shorter vector
has zeros at its end; repeated rows are candidates each, and equal anchors (id, label and vector) one anchor; rows of the
anchor's id are never its positives; ties go by id; an anchor without positives, or a positive without negatives in its
window (as any with a negative score), has no rows; scores beyond 2**53 raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, read, spool
from .merkle import ranked

POSITIVES, NEGATIVES = 5, 10
#: A negative's score against its positive's, in hundredths.
WINDOW = (30, 90)
SCALE = 256
#: Anchors of a block (of one tree), bytes of a wave of blocks, and rows that one numpy step looks at.
BLOCK, WAVE_BYTES, ROWS = 1024, 16 << 20, 4096


@dataclass
class Block:
    """Anchors of one tree, parents before children: ``parent`` is a place in the same order, -1 for the root."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree from the vector nearest to the mean: the order in which anchors join it, each one's parent
    (its place in that order) and the length of its edge."""
    n = len(vectors)
    root = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    away, via = np.full(n, np.inf), np.zeros(n, np.int64)
    order, parent, edge = [], [], []
    nearest, out = root, np.ones(n, bool)
    for k in range(n):
        order.append(nearest), parent.append(int(via[nearest]) if k else -1), edge.append(float(away[nearest]) if k else 0.0)
        out[nearest] = False
        far = np.sqrt(((vectors - vectors[nearest]) ** 2).sum(axis=1))
        closer = out & (far < away)
        away[closer], via[closer] = far[closer], k
        nearest = int(np.where(out, away, np.inf).argmin())
    return np.array(order), np.array(parent), np.array(edge)


def blocks_of(table: pa.Table, size: int = BLOCK) -> list[Block]:
    """Anchors (rank, id, label, vector), cut by rank."""
    vectors, rank = matrix(table["vector"].combine_chunks()), table["rank"].to_numpy()
    out = []
    for b in np.unique(rank // size):
        at = np.flatnonzero(rank // size == b)
        order, parent, edge = spanning_tree(vectors[at])
        at = at[order]
        out.append(Block(rank[at], table["id"].to_numpy()[at], table["label"].to_numpy()[at], vectors[at], parent, edge))
    return out


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as rows of doubles, with zeros at the end of shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def sweep(block: Block, vectors: np.ndarray, norms: np.ndarray, wanted: Callable, take: Callable) -> int:
    """Visit a block's anchors, parents first.  ``wanted(anchor, low, high)`` names the rows to score by their bounds,
    ``take(anchor, rows, scores)`` gets them.  Returns how many scores were computed."""
    children = np.bincount(block.parent[1:], minlength=len(block.ids))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for c, p in enumerate(block.parent.tolist()):
        if p < 0:
            low = vectors @ block.vectors[c]
            high, rows, scored = low.copy(), wanted(c, low, low), scored + len(low)
            scores = low[rows]
        else:
            reach = norms * block.edge[c]
            reach += 1e-9 * reach + 1e-3  # the roots are rounded, scores are whole numbers
            low, high = known[p][0] - reach, known[p][1] + reach
            children[p] -= 1
            if not children[p]:
                del known[p]
            rows = wanted(c, low, high)
            scores = vectors[rows] @ block.vectors[c]
            low[rows] = high[rows] = scores
            scored += len(rows)
        if children[c]:
            known[c] = (low, high)
        if len(rows):
            take(c, rows, scores)
    return scored


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by falling score, then rising id."""
    if len(scores) > 4 * k:  # only what can be among them is sorted
        at = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def steps(batches: Iterator[pa.RecordBatch], blocks: list[Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, vectors and norms of at most ``ROWS`` rows."""
    width = max((b.vectors.shape[1] for b in blocks), default=0)
    most = max((float(np.sqrt((b.vectors**2).sum(axis=1)).max()) for b in blocks), default=0.0)
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            v = matrix(part.column(2))
            if v.shape[1] != width:  # what one side lacks is zero, and adds nothing
                v = v[:, :width] if v.shape[1] > width else np.pad(v, ((0, 0), (0, width - v.shape[1])))
            norms = np.sqrt((v**2).sum(axis=1))
            if float(norms.max(initial=0)) * most >= 2.0**53:
                raise ValueError("scores do not fit: vectors are too long for exact inner products")
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), v, norms


def find_positives(batches: Iterator[pa.RecordBatch], blocks: list[Block], k: int) -> Iterator[pa.RecordBatch]:
    """Each anchor's first k other rows of its label, of those in this task: number, id, score."""
    none = (np.zeros(0), np.zeros(0, np.int64))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for ids, labels, v, norms in steps(batches, blocks):
        of_label = {x: labels == x for x in np.unique(labels).tolist()}
        for block in blocks:

            def wanted(c: int, low: np.ndarray, high: np.ndarray, block: Block = block) -> np.ndarray:
                same = of_label.get(int(block.labels[c]))
                if same is None:
                    return np.zeros(0, np.int64)
                have = found.get(int(block.number[c]), none)[0]
                open_ = same & (ids != block.ids[c])
                return np.flatnonzero(open_ & (high >= have[-1]) if len(have) == k else open_)

            def take(c: int, rows: np.ndarray, scores: np.ndarray, block: Block = block) -> None:
                a, b = found.get(int(block.number[c]), none)
                found[int(block.number[c])] = best(np.concatenate([a, scores]), np.concatenate([b, ids[rows]]), k)

            sweep(block, v, norms, wanted, take)
    for number, (scores, ids) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(ids), pa.array(scores.astype(np.int64))], names=["number", "id", "score"])


def find_negatives(batches: Iterator[pa.RecordBatch], blocks: list[Block], windows: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of other labels in each positive's window, of those in this task: number, place (of the positive),
    id, score.  ``windows``: lowest and highest score for each positive of an anchor."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    open_ = {n: w.astype(float).copy() for n, w in windows.items()}
    for ids, labels, v, norms in steps(batches, blocks):
        for block in blocks:

            def wanted(c: int, low: np.ndarray, high: np.ndarray, block: Block = block) -> np.ndarray:
                w = open_.get(int(block.number[c]))
                if w is None:
                    return np.zeros(0, np.int64)
                return np.flatnonzero((high >= w[:, 0].min()) & (low <= w[:, 1].max()) & (labels != block.labels[c]))

            def take(c: int, rows: np.ndarray, scores: np.ndarray, block: Block = block) -> None:
                number = int(block.number[c])
                for place, (least, most) in enumerate(open_[number].tolist()):
                    inside = (scores >= least) & (scores <= most)
                    if inside.any():
                        a, b = found.get((number, place), (np.zeros(0), np.zeros(0, np.int64)))
                        got = best(np.concatenate([a, scores[inside]]), np.concatenate([b, ids[rows[inside]]]), k)
                        found[number, place] = got
                        if len(got[0]) == k:
                            open_[number][place, 0] = got[0][-1]

            sweep(block, v, norms, wanted, take)
    for (number, place), (scores, ids) in found.items():
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.full(n, place, np.int32)), pa.array(ids), pa.array(scores.astype(np.int64))], names=["number", "place", "id", "score"])


def window_of(scores: np.ndarray, window: tuple[int, int] = WINDOW) -> np.ndarray:
    """Lowest and highest whole score allowed below each positive's score."""
    return np.stack([-((-window[0] * scores) // 100), (window[1] * scores) // 100], axis=1)


def whole_vectors(rows: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, label and vector (whole numbers) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    sound = F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite
    return rows.where(sound).select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def first(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k rows of each group by falling score, then rising id, and their ``rank`` from 1."""
    line = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  ``rows`` and ``anchors``: id, label and
    vector, as ``whole_vectors`` gives them."""
    spark = rows.sparkSession
    bounded_batches(spark)
    # by label, so that a block's anchors lie close; equal anchors are one
    numbered = ranked(anchors.dropDuplicates(["id", "label", "vector"]).withColumn("all", F.lit("all")), "all", ["label", "id"], "rank", "anchors")
    numbered = spool(numbered.drop("all", "anchors"), "anchors")
    total, width = numbered.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    wave = max(1, wave_bytes // (8 * max(1, width) * block)) * block
    out = None
    for start in range(0, total, wave):
        mine = numbered.where((F.col("rank") >= start) & (F.col("rank") < start + wave))
        trees = spark.sparkContext.broadcast(blocks_of(mine.toArrow(), block))  # at most `wave_bytes` of vectors
        near = rows.mapInArrow(lambda b, t=trees, k=positives: find_positives(b, t.value, k), "number bigint, id bigint, score bigint")
        chosen = first(near, ["number"], positives).toArrow().sort_by([("number", "ascending"), ("rank", "ascending")])  # a few rows for each anchor of the wave
        numbers, scores = chosen["number"].to_numpy(), chosen["score"].to_numpy()
        edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1)) if len(numbers) else np.zeros(1, np.int64)
        windows = {int(numbers[a]): window_of(scores[a:b], window) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        asked = spark.sparkContext.broadcast(windows)
        kept = rows.mapInArrow(lambda b, t=trees, w=asked, k=negatives: find_negatives(b, t.value, w.value, k), "number bigint, place int, id bigint, score bigint")
        ids = {int(n): int(i) for tree in trees.value for n, i in zip(tree.number, tree.ids, strict=True)}
        pairs = [(int(n), int(r) - 1, ids[int(n)], int(p), int(s)) for n, r, p, s in zip(numbers, chosen["rank"].to_numpy(), chosen["id"].to_numpy(), scores, strict=True)]
        named = spark.createDataFrame(pairs, "number bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        got = first(kept, ["number", "place"], negatives).join(F.broadcast(named), ["number", "place"])
        part = spool(got.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        out = part if out is None else out.unionByName(part)
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.createDataFrame([], empty) if out is None else out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Registered query: every hundredth row of ``embeddings`` against all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(read(spark, sf_dir, "embeddings"), label)
    return hard_negatives(rows, rows.where("id % 100 = 0"))


OP13_SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from v a join v b on a.id <> b.id where a.id % 100 = 0),
p as (select a, b as p, score as ps from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.p, p.ps, s.b, s.score, row_number() over (partition by p.a, p.p order by s.score desc, s.b) as rank
  from p join s on p.a = s.a and not s.same where 30 * p.ps <= 100 * s.score and 100 * s.score <= 90 * p.ps)
select a as anchor_id, p as positive_id, cast(rank as int) as rank, b as negative_id, ps as positive_score, score as negative_score from n where rank <= 10"""
