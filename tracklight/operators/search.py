"""Search: cosine, text and BM25 ranking, rank fusion, tiers, context retrieval, and inverted-list vector search.

A *table* of queries is matched against all rows in one job.  Query tables are measured before they are broadcast;
larger ones are worked off in blocks.  The best k of each query come from partial top-k lists: every task keeps k rows
a query, so the corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import expressions as X
from .listing import all_tags, any_tag, page

#: Queries, and bytes of them, in one broadcast block.
QUERY_BLOCK, BLOCK_BYTES = 1_000, 32 << 20
#: Other small sides are broadcast up to so many rows, counted first; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Largest Arrow batch sent to a Python worker, and the cells of one matrix of rows and queries in it.
BATCH_BYTES, CELLS = 8 << 20, 1 << 18


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts (only ever lowers the session's limit)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def blocks(queries: DataFrame, key: str, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The query table in parts of about ``block`` rows and ``BLOCK_BYTES`` of vectors, each small enough to broadcast."""
    wide = [F.size(f.name) * 8 if f.dataType.typeName() == "array" else F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in queries.schema.fields]
    rows, size = queries.agg(F.count("*"), F.coalesce(F.sum(reduce(lambda a, b: a + b, wide)), F.lit(0))).first()
    n = int(max(rows // block, size // BLOCK_BYTES)) + 1
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def small(side: DataFrame) -> DataFrame:
    """A side to join: broadcast if it is counted as small, else sorted and merged."""
    return side.hint("broadcast" if side.count() <= BROADCAST_ROWS else "merge")


def similarities(kind: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of every query (rows of ``q``) with every row of ``r``: cosine, or 1 / (1 + Euclidean distance)."""
    dot = r @ q.T
    qq, rr = (q * q).sum(axis=1), (r * r).sum(axis=1)
    if kind == "cosine":
        size = np.sqrt(rr)[:, None] * np.sqrt(qq)[None, :]
        return np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
    out = np.empty_like(dot)
    for i in range(len(q)):
        out[:, i] = np.sqrt(((r - q[i]) ** 2).sum(axis=1))
    return 1 / (1 + out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, kind: str = "cosine", key: str = "trajectory_id", vector: str = "embedding", floor: float | None = None, places: int = 6) -> DataFrame:
    """(query_id, key, similarity, rank): the k rows most similar to each query, ties by key; similarities are rounded to
    ``places`` and those below ``floor`` do not count.

    Each task multiplies Arrow batches of vectors with a broadcast block of query vectors and keeps k rows a query, so only
    tasks x queries x k rows are shuffled, whatever the size of the table.  A worker holds one batch, a matrix of ``CELLS``
    similarities and its k rows a query.
    """
    found = None
    bounded_batches(queries.sparkSession)
    plain = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("similarity", T.DoubleType())]
    for block in blocks(queries, "query_id"):
        held = block.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where("v is not null").collect()  # a block
        if not held:
            continue
        shared = queries.sparkSession.sparkContext.broadcast(([r.query_id for r in held], np.array([r.v for r in held])))
        part = plain.mapInArrow(lambda batches, s=shared: _best_of_task(batches, *s.value, k, kind, key, floor, places), T.StructType(fields))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], T.StructType(fields))
    return best(found, k, tie=key)


def _best_of_task(batches: Iterator[pa.RecordBatch], ids: list, q: np.ndarray, k: int, kind: str, key: str, floor: float | None, places: int) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = [np.zeros(0, object)] * len(ids)
    scores: list[np.ndarray] = [np.zeros(0)] * len(ids)
    least = np.full(len(ids), -np.inf if floor is None else floor)  # what a row needs to count for a query
    for part in (batch.slice(lo, step) for step in [max(1, CELLS // max(1, len(ids)))] for batch in batches for lo in range(0, batch.num_rows, step)):
        flat = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False)
        found = np.round(similarities(kind, q, flat.reshape(part.num_rows, -1)), places)
        enough = found >= least
        hit, here = np.flatnonzero(enough.any(axis=0)), None
        for i in hit.tolist():
            s, on = found[:, i], np.flatnonzero(enough[:, i])
            if len(on) > 4 * k:  # no row below the k-th best of the part can matter
                on = on[s[on] >= np.partition(s[on], -k)[-k]]
            here = np.array(part.column(0).to_pylist(), object) if here is None else here
            s, names = np.append(scores[i], s[on]), np.append(keys[i], here[on])
            order = sorted(range(len(s)), key=lambda j: (-s[j], names[j]))[:k]
            scores[i], keys[i] = s[order], names[order]
            if len(order) == k:
                least[i] = max(least[i], scores[i][-1])
    names = [x for per in keys for x in per]
    flat = [x for i, per in zip(ids, keys, strict=True) for x in [i] * len(per)]
    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(names), pa.array(np.concatenate(scores))], names=["query_id", key, "similarity"])


def best(rows: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "similarity", tie: str = "trajectory_id") -> DataFrame:
    """The k best rows for each query with ``rank`` from 1; ties by ``tie`` ascending."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_trajectories(
    queries: DataFrame, trajectories: DataFrame, k: int, organization_id: str | None = None, domain: str | None = None, min_score: float | None = None, max_score: float | None = None,
    category: str | None = None, complexity: str | None = None,
) -> DataFrame:
    """Top k trajectories for each query among those that pass the filters."""
    rows = trajectories
    for column, value in (("organization_id", organization_id), ("domain_type", domain), ("task_category", category), ("complexity_level", complexity)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if min_score is not None:
        rows = rows.where(F.col("outcome_score") >= min_score)
    if max_score is not None:
        rows = rows.where(F.col("outcome_score") <= max_score)
    return nearest(queries, rows, k)


def search_across(queries: DataFrame, trajectories: DataFrame, organization_id: str, domain: str, k: int, salt: str = "") -> DataFrame:
    """Own trajectories and other organisations' shared ones of the same domain, the latter anonymised, merged by similarity."""
    if not domain:
        raise ValueError("a search across organisations needs a domain")
    rows = trajectories.where(F.col("domain_type") == domain)
    own = rows.where(F.col("organization_id") == organization_id).withColumn("visibility", F.lit("own"))
    other = rows.where((F.col("organization_id") != organization_id) & F.col("share_cross_org")).withColumn("visibility", F.lit("shared"))
    both = own.unionByName(other)
    found = both.select("trajectory_id", "visibility").join(small(nearest(queries, both, k)), "trajectory_id")
    hidden = F.col("visibility") == "shared"
    return found.withColumn("trajectory_id", F.when(hidden, X.redacted("trajectory_id", salt)).otherwise(F.col("trajectory_id")))


def newest_fallback(rows: DataFrame, order: str, k: int) -> DataFrame:
    """Newest rows with similarity 0 where no query vector exists."""
    return rows.orderBy(F.desc(order)).limit(k).withColumn("similarity", F.lit(0.0))


def text_score(description: Column, tags: Column, query: str, flat: bool = False) -> Column:
    """0.8 if the description contains the query, at least 0.7 if a tag does; flat: 0.8 for text or an equal tag."""
    q = query.lower()
    in_text = F.coalesce(F.lower(description).contains(q), F.lit(False))
    if flat:
        return F.when(in_text | F.array_contains(F.transform(tags, F.lower), q), 0.8).otherwise(0.0)
    in_tags = F.coalesce(F.exists(tags, lambda t: F.lower(t).contains(q)), F.lit(False))
    return F.greatest(F.when(in_text, 0.8).otherwise(0.0), F.when(in_tags, 0.7).otherwise(0.0))


def from_distance(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda w: w != "")


#: Rows that share one upper bound.
BOUND_ROWS = 512


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, places: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the k best rows for each query (query_id, query) by Robertson's BM25, ties by key;
    scores are rounded to ``places``.

    The queries' terms travel to the rows, a counted block of queries at a time, so no posting is shuffled, however frequent
    its term.  A first pass counts rows, lengths and the terms' document frequencies, a few numbers a task.  In the second
    one every ``BOUND_ROWS`` rows get the largest weight that each term has among them; a query whose weights add up to less
    than its k-th best so far skips the block.  A task returns k rows a query.  Without ``k`` every row
    that has a term of a query is returned with its score, as it is found, and no ranks.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(key).alias("k"), tokens(F.coalesce(text, F.lit(""))).alias("w"))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())]
    found = None
    for block in blocks(queries.select("query_id", "query"), "query_id"):
        held = block.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("w")).where("w is not null").collect()  # a block
        terms = sorted({w for r in held for w in r.w})
        if not terms:
            continue
        place = {w: i for i, w in enumerate(terms)}
        asked = spark.sparkContext.broadcast((terms, [r.query_id for r in held], [np.array(sorted(place[w] for w in r.w), np.int64) for r in held]))
        counted = plain.select("w").mapInArrow(lambda batches, s=asked: _term_counts(batches, s.value[0]), "term int, n bigint")
        n = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term
        rows, words = n.get(-1, 0), n.get(-2, 0)
        if not rows:
            continue
        df = np.array([n.get(i, 0) for i in range(len(terms))], float)
        idf, mean = np.log(1 + (rows - df + 0.5) / (df + 0.5)), words / rows
        if k is None:
            part = plain.mapInArrow(lambda batches, s=asked, idf=idf, mean=mean: _all_texts(batches, *s.value, idf, mean, k1, b, places, key), T.StructType(fields))
        else:
            part = plain.mapInArrow(lambda batches, s=asked, idf=idf, mean=mean: _best_texts(batches, *s.value, idf, mean, k, k1, b, places, key), T.StructType(fields))
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], T.StructType(fields)) if found is None else found
    return found if k is None else best(found, k, score="score", tie=key)


def _matches(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of words: the lists' lengths, and for each word among ``terms`` its list and its term."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.fill_null(pc.index_in(pc.list_flatten(column), value_set=terms), -1).to_numpy(zero_copy_only=False)
    on = np.flatnonzero(term >= 0)
    return sizes, np.repeat(np.arange(len(sizes)), sizes)[on], term[on].astype(np.int64)


def _term_counts(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """How many rows have each term, by its place; as -1 and -2, how many rows and words there are."""
    known, df, rows, words = pa.array(terms), np.zeros(len(terms), np.int64), 0, 0
    for batch in batches:
        sizes, row, term = _matches(batch.column(0), known)
        rows, words = rows + len(sizes), words + int(sizes.sum())
        df += np.bincount(np.unique(row * len(terms) + term) % len(terms), minlength=len(terms))
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int32()), pa.array(np.append(df[at], [rows, words]))], names=["term", "n"])


def _weights(batches: Iterator[pa.RecordBatch], terms: list[str], idf: np.ndarray, mean: float, k1: float, b: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Every ``BOUND_ROWS`` rows that have a term: the rows, the weight of each of their terms in each row, and the terms'
    columns (-1: not among them)."""
    known = pa.array(terms)
    for part in (batch.slice(lo, BOUND_ROWS) for batch in batches for lo in range(0, batch.num_rows, BOUND_ROWS)):
        sizes, row, term = _matches(part.column(1), known)
        if not len(term):
            continue
        pairs, tf = np.unique(row * len(terms) + term, return_counts=True)
        row, term = pairs // len(terms), pairs % len(terms)
        here = np.unique(term)  # the terms of this block, as columns
        column = np.full(len(terms), -1)
        column[here] = np.arange(len(here))
        weight = np.zeros((part.num_rows, len(here)))
        weight[row, column[term]] = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean))
        yield part, weight, column


def _all_texts(batches: Iterator[pa.RecordBatch], terms: list[str], ids: list, wanted: list[np.ndarray], idf: np.ndarray, mean: float, k1: float, b: float, places: int, key: str) -> Iterator[pa.RecordBatch]:
    kind = pa.array(ids).type
    for part, weight, column in _weights(batches, terms, idf, mean, k1, b):
        for i, mine in zip(ids, wanted, strict=True):
            at = column[mine]
            at = at[at >= 0]
            on = np.flatnonzero((weight[:, at] > 0).any(axis=1))
            if len(on):
                score = np.round(weight[on[:, None], at].sum(axis=1), places)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(on), kind), part.column(0).take(pa.array(on)), pa.array(score)], names=["query_id", key, "score"])


def _best_texts(batches: Iterator[pa.RecordBatch], terms: list[str], ids: list, wanted: list[np.ndarray], idf: np.ndarray, mean: float, k: int, k1: float, b: float, places: int, key: str) -> Iterator[pa.RecordBatch]:
    kept: list[list[tuple]] = [[] for _ in ids]
    for part, weight, column in _weights(batches, terms, idf, mean, k1, b):
        most, names = weight.max(axis=0), None
        for q, mine in enumerate(wanted):
            at = column[mine]
            at = at[at >= 0]
            if not len(at) or (len(kept[q]) == k and round(float(most[at].sum()) + 1e-9, places) < -kept[q][-1][0]):
                continue
            score = weight[:, at].sum(axis=1)
            on = np.flatnonzero(score > 0)
            names = names or part.column(0).to_pylist()
            kept[q] = sorted(kept[q] + [(-s, names[i]) for s, i in zip(np.round(score[on], places).tolist(), on.tolist(), strict=True)])[:k]
    flat = [(i, name, -s) for i, found in zip(ids, kept, strict=True) for s, name in found]
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat]) for j in range(2)] + [pa.array([x[2] for x in flat], pa.float64())], names=["query_id", key, "score"]) if flat else pa.RecordBatch.from_arrays([pa.nulls(0), pa.nulls(0), pa.nulls(0)], names=["query_id", key, "score"])


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int, key: str = "id", weights: tuple[float, float] = (0.5, 0.5), constant: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Fuses two ranked lists (``rank`` from 1): weight / (constant + rank), 0 where a list lacks the id."""
    a = first.select(*by, key, F.col("rank").alias("rank_a"))
    c = second.select(*by, key, F.col("rank").alias("rank_b"))
    part = lambda col, w: F.coalesce(F.lit(float(w)) / (constant + F.col(col)), F.lit(0.0))
    both = a.hint("merge").join(c.hint("merge"), [*by, key], "full_outer").withColumn("score", part("rank_a", weights[0]) + part("rank_b", weights[1]))
    if by:
        return best(both, k, by, "score", key)
    return both.orderBy(F.desc("score"), key).limit(k)


#: Ways to search: by time alone, by text, by vector, or by the last two together.
MODES = ("timestamp", "fts", "vector", "hybrid")


def search(rows: DataFrame, queries: DataFrame, mode: str, k: int, key: str, text: str = "text", vector: str = "embedding", order: str = "created_at", weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(query_id, key, rank, score, vector_rank, fts_rank): the k best of ``rows`` for each query (query_id, query,
    query_embedding) in one of ``MODES``.

    A single mode scores 1 / rank; ``hybrid`` fuses the k best of both lists, and keeps both ranks.  Filters come before:
    they are predicates on ``rows``.
    """
    if mode not in MODES:
        raise ValueError(f"a search mode is one of {MODES}")
    none = F.lit(None).cast("int")
    if mode == "timestamp":
        newest = rows.orderBy(F.desc(order), key).limit(k).select(key, F.row_number().over(Window.orderBy(F.desc(order), key)).alias("rank"))  # k rows
        ranks = small(queries.select("query_id")).join(F.broadcast(newest)).withColumns({"vector_rank": none, "fts_rank": none})
        return ranks.select("query_id", key, "rank", (F.lit(1.0) / F.col("rank")).alias("score"), "vector_rank", "fts_rank")
    by_vector = nearest(queries, rows, k, key=key, vector=vector).select("query_id", key, "rank") if mode != "fts" else None
    by_text = bm25(rows, queries, k, key, text).select("query_id", key, "rank") if mode != "vector" else None
    if mode == "hybrid":
        fused = reciprocal_rank_fusion(by_vector, by_text, k, key, weights, by=["query_id"])
        return fused.select("query_id", key, "rank", "score", F.col("rank_a").alias("vector_rank"), F.col("rank_b").alias("fts_rank"))
    one = by_vector if mode == "vector" else by_text
    return one.select("query_id", key, "rank", (F.lit(1.0) / F.col("rank")).alias("score"), (F.col("rank") if mode == "vector" else none).alias("vector_rank"), (F.col("rank") if mode == "fts" else none).alias("fts_rank"))


def local_time(at: Column, zone: str) -> Column:
    """A UTC time in a zone of fixed offset (``-05:00``), in ISO form, with fractions only where there are some."""
    local = F.from_utc_timestamp(at.cast("timestamp"), zone)
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(at.cast("timestamp")), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit(zone))


def archive_response(found: DataFrame, zone: str) -> DataFrame:
    """Rows of an archive search as a caller sees them: timestamp, content, tags, relevance (JSON of what is known)."""
    relevance = F.to_json(F.struct(F.col("score").alias("rrf_score"), "vector_rank", "fts_rank"))
    return found.withColumns({"timestamp": local_time(F.col("created_at"), zone), "content": F.col("text"), "tags": F.coalesce("tags", F.array().cast("array<string>")), "relevance": F.when(relevance != "{}", relevance)})


# Fixed value: the tool whose calls a conversation search leaves out.
SEARCH_TOOL = "conversation_search"


def conversation_response(found: DataFrame, zone: str, now: Column, mode: str) -> DataFrame:
    """Messages of a search as a caller sees them, without tool messages and calls of the search itself: timestamp,
    time_ago, role, content, relevance.  Columns: created_at, role, text, tools (names that the message calls), score,
    vector_rank, fts_rank."""
    own = (F.col("role") == "assistant") & F.coalesce(F.array_contains("tools", SEARCH_TOOL), F.lit(False))
    relevance = F.to_json(F.struct(F.col("score").alias("rrf_score"), "vector_rank", "fts_rank", F.lit(mode).alias("search_mode")))
    return found.where((F.col("role") != "tool") & ~own).withColumns({"timestamp": local_time(F.col("created_at"), zone), "time_ago": X.time_ago("created_at", now), "content": F.col("text"), "relevance": relevance})


def passages_page(passages: DataFrame, limit: int, contains: str | None = None, start: Column | None = None, end: Column | None = None, after: str | None = None, before: str | None = None, ascending: bool = True, tags: Sequence[str] = (), every: bool = False, near: Sequence[float] | None = None) -> DataFrame:
    """Passages without a vector index: text filter, dates, cursors, order by time, limit, and only then tags, any or all.

    Columns: passage_id, created_at, text, tags.  With ``near``, a query's vector, the nearest by cosine come first (column
    embedding; rows without one are left out), then by time and id, and cursors do not count.
    """
    rows = passages if contains is None else passages.where(F.lower("text").contains(contains.lower()))
    if start is not None:
        rows = rows.where(F.col("created_at") >= start)
    if end is not None:
        rows = rows.where(F.col("created_at") <= end)
    if near is not None:
        q = F.array(*[F.lit(float(x)) for x in near])
        time = F.asc("created_at") if ascending else F.desc("created_at")
        rows = rows.where("embedding is not null").orderBy(F.round(X.cosine("embedding", q), 6).desc(), time, "passage_id").limit(limit)
    else:
        rows = page(rows, "passage_id", limit, ascending=ascending, after=after, before=before)
    return rows.where((all_tags if every else any_tag)(F.col("tags"), list(tags))) if tags else rows


def decisions_of(found: DataFrame, decisions: DataFrame, k: int, tie: str = "decision_id") -> DataFrame:
    """Decisions of the found trajectories, with their similarity, cut to k for each query."""
    met = decisions.join(small(found.select("query_id", "trajectory_id", "similarity")), "trajectory_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "trajectory_id", tie)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context_examples(found: DataFrame, decisions: DataFrame, k: int, min_success: float = 0.7, action: str | None = None, entity_type: str | None = None, entity_id: str | None = None) -> DataFrame:
    """The k most similar successful and failed decisions for each query (kind: success, failure).

    found: query_id, trajectory_id, similarity, outcome_score.  A success is a decision that succeeded, of a trajectory with a
    score of at least ``min_success`` or none; a failure one that failed, of a trajectory with a score below 0.5 or none.
    """
    met = decisions.join(small(found.select("query_id", "trajectory_id", "similarity", "outcome_score")), "trajectory_id")
    if action is not None:
        met = met.where(F.col("action") == action)
    if entity_type or entity_id:
        met = met.where(entity_match(F.col("arguments"), entity_type, entity_id))
    well = F.coalesce("success", F.lit(False))
    good, bad = F.coalesce(F.col("outcome_score") >= min_success, F.lit(True)), F.coalesce(F.col("outcome_score") < 0.5, F.lit(True))
    kind = F.when(well & good, "success").when(~well & bad, "failure")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("similarity"), "trajectory_id", "decision_id")
    return met.withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def entity_match(arguments: Column, entity_type: str | None = None, entity_id: str | None = None, active: Column | None = None) -> Column:
    """Does an argument named type or entity_type hold the type, one named id, entity_id or {type}_id the id, or is an
    entity in ``active`` (entity_type, entity_id) of that type and id?  Without either all match."""
    tests = []
    if entity_type:
        tests += [(p, entity_type) for p in ("type", "entity_type")]
    if entity_id:
        tests += [(p, entity_id) for p in ("id", "entity_id", f"{entity_type}_id")]
    if not tests:
        return F.lit(True)
    hits = [F.coalesce(F.get_json_object(arguments, f"$.{p}") == v, F.lit(False)) for p, v in tests]
    if active is not None:
        same = lambda e: (F.lit(True) if not entity_type else e["entity_type"] == entity_type) & (F.lit(True) if not entity_id else e["entity_id"] == entity_id)
        hits.append(F.coalesce(F.exists(active, same), F.lit(False)))
    return reduce(lambda a, b: a | b, hits)


# The headings, openings and labels of a context block.
GOOD = ("## Relevant Past Decisions", "Consider these successful past approaches:", "✓ Success", "Success")
BAD = ("## Anti-Patterns to Avoid", "The following approaches led to poor outcomes:", "✗ Failed", "Failed")


def example_text(failed: Column) -> Column:
    """A decision as lines of context: domain, context, action, reasoning, result, and what failed and was learned.

    Columns: domain, context, action, rationale, result, error_type, feedback; nulls and empty texts have no line.
    """
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"**{label}**: "), c))
    result = F.coalesce(F.when(F.col("result") != "", F.substring("result", 1, 200)), F.when(failed, BAD[3]).otherwise(GOOD[3]))
    return F.concat_ws(
        "\n", line("Domain", F.col("domain")), line("Context", F.col("context")), F.concat(F.lit("**Action**: "), "action"), line("Reasoning", F.col("rationale")), line("Result", result),
        F.when(failed, line("Error", F.col("error_type"))), F.when(failed, line("Lesson", F.substring("feedback", 1, 200))),
    )


def context_block(examples: DataFrame) -> DataFrame:
    """(query_id, block): markdown of a query's examples (kind, rank, similarity and the columns of ``example_text``), what
    succeeded before what failed.

    Similarities are told by ``format_number``, which rounds the double itself, ties to even, as printf and Python do;
    ``format_string`` rounds ties of its shortest decimal form up.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "kind", "similarity", example_text(F.col("kind") == "failure").alias("text"))))

    def part(kind: str, words: tuple[str, ...]) -> Column:
        mine = F.filter("rows", lambda r: r["kind"] == kind)
        two = lambda r: F.format_number(r["similarity"], 2)
        each = lambda r: F.concat(F.format_string("### Example %d (similarity: %s, outcome: " + words[2] + ")\n", r["rank"], two(r)), r["text"], F.lit("\n"))
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"{words[0]}\n\n{words[1]}\n\n"), F.array_join(F.transform(mine, each), "\n")))

    return examples.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.concat_ws("\n", part("success", GOOD), part("failure", BAD)).alias("block"))


def rule_applied(record: Column, rule: str) -> Column:
    """Does the JSON record list the rule under segment.world_evolution.rules_applied?"""
    parsed = F.from_json(record, "struct<segment:struct<world_evolution:struct<rules_applied:array<string>>>>")
    return F.coalesce(F.array_contains(parsed["segment"]["world_evolution"]["rules_applied"], rule), F.lit(False))


# ---------------------------------------------------------------------------------------------------- vectors
def centres_of(rows: DataFrame, lists: int, seed: int = 7, sample: int = 20_000, key: str = "trajectory_id") -> np.ndarray:
    """Centres of ``lists`` clusters of directions, fitted to at most about ``sample`` vectors, drawn by a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_vector = rows.where("embedding is not null")
    n = max(1, with_vector.count())
    drawn = with_vector.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)))
    model = KMeans(k=lists, seed=seed, maxIter=20, distanceMeasure="cosine").fit(drawn.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    return np.array([[float(x) for x in c] for c in model.clusterCenters()])


def write_lists(rows: DataFrame, centres: np.ndarray, path: str, copies: int = 4, margin: float = 0.3, key: str = "trajectory_id") -> None:
    """Every row with a vector into the lists of its nearest centres: always the nearest one, and up to ``copies`` in all
    whose cosine is within ``margin`` of that, so that vectors near a boundary are on both of its sides.

    The table is partitioned by list, and each list is dealt to as many files as it fills.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
            near = similarities("cosine", shared.value, flat.reshape(batch.num_rows, -1))
            order = np.argsort(-near, axis=1, kind="stable")[:, :copies]
            best_ = np.take_along_axis(near, order, axis=1)
            in_ = best_ >= best_[:, :1] - margin
            lists = pa.array([o[i].tolist() for o, i in zip(order, in_, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["k", "v", "lists"])

    plain = rows.where("embedding is not null").select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("v"))
    schema = T.StructType([*plain.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    dealt = plain.mapInArrow(deal, schema).select("k", "v", F.explode("lists").alias("list"))
    dealt.hint("rebalance", "list").write.partitionBy("list").parquet(path)


def read_lists(spark, path: str, lists: Sequence[int]) -> DataFrame:
    """Rows (k, v, list) of some lists; no file of another one is opened."""
    return spark.read.parquet(path).where(F.col("list").isin([int(x) for x in lists])).select("list", "k", "v")


def probe(queries: DataFrame, path: str, centres: np.ndarray, nprobe: int, k: int, key: str = "trajectory_id", key_type: str = "string") -> DataFrame:
    """Top k of each query within its ``nprobe`` nearest lists, by exact cosine.

    Queries go in blocks; a block reads the lists that one of its queries asks for, and a
    task multiplies the rows of a list with the queries that probe it.
    """
    spark = queries.sparkSession
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, T._parse_datatype_string(key_type)), T.StructField("similarity", T.DoubleType())]
    found = None
    for block in blocks(queries, "query_id"):
        held = block.select("query_id", F.col("query_embedding").cast("array<double>").alias("v")).where("v is not null").collect()  # a block
        if not held:
            continue
        q = np.array([r.v for r in held])
        near = np.argsort(-similarities("cosine", centres, q), axis=1, kind="stable")[:, :nprobe]
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in held], object), q, near))
        part = read_lists(spark, path, np.unique(near)).mapInArrow(lambda batches, s=shared: _probed(batches, *s.value, k), T.StructType(fields))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return best(spark.createDataFrame([], T.StructType(fields)), k, tie=key)
    once = found.groupBy("query_id", key).agg(F.max("similarity").alias("similarity"))  # copies of a row in several lists
    return best(once, k, tie=key)


def _probed(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, near: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    kept: dict = {}
    for batch in batches:
        lists = batch.column(0).to_numpy(zero_copy_only=False)
        for one in np.unique(lists):
            rows, who = np.flatnonzero(lists == one), np.flatnonzero((near == one).any(axis=1))
            if len(who):
                part = pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in (1, 2)], names=["k", "v"])
                (out,) = _best_of_task(iter([part]), ids[who].tolist(), q[who], k, "cosine", "trajectory_id", None, 15)
                for i, name, s in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    mine = kept.setdefault(i, {})
                    mine[name] = max(s, mine.get(name, s))
        kept = {i: dict(sorted(x.items(), key=lambda e: (-e[1], e[0]))[:k]) for i, x in kept.items()}
    flat = [(i, name, s) for i, x in kept.items() for name, s in x.items()]
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], type=t) for j, t in enumerate((pa.array(ids.tolist()).type, pa.string(), pa.float64()))], names=["query_id", "trajectory_id", "similarity"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact answers that were found."""
    hit = exact.join(found.select("query_id", "trajectory_id", F.lit(1).alias("hit")), ["query_id", "trajectory_id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


# ---------------------------------------------------------------------------------------------------- providers
def hashed_tokens(texts: pd.Series, dimension: int = 64) -> list[list[float] | None]:
    """The deterministic default embedding: token hashes as signed counts, scaled to length one."""
    import zlib

    import numpy as np

    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        v = np.zeros(dimension)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dimension] += 1.0 if h & 0x10000 else -1.0
        n = float(np.sqrt((v * v).sum()))
        out.append((v / n if n else v).tolist())
    return out


#: Rows that a provider gets at once.
PROVIDER_ROWS = 1_000


def embed(rows: DataFrame, text: str, provider: Callable[[pd.Series], list] = hashed_tokens, name: str = "embedding") -> DataFrame:
    """All rows with a provider's embedding of ``text``, at most ``PROVIDER_ROWS`` at a time; where it fails they get nulls."""
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (batch.iloc[lo : lo + PROVIDER_ROWS] for batch in batches for lo in range(0, len(batch), PROVIDER_ROWS)):
            try:
                made = provider(part[text])
            except Exception:  # a provider is outside code: its failures are data, not errors of the job
                made = [None] * len(part)
            yield part.assign(**{name: made})

    return rows.mapInPandas(run, schema)
