"""Listing, filtering, paging and joining of operational tables (runs, steps, messages, passages, tags, blocks, jobs).

Filters are composed ``Column`` predicates, so they reach the Parquet scan; pages are keyset predicates with a sort and
a limit, which Spark plans as a top-k; set membership is a semi or anti join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X


def scoped(df: DataFrame, organization_id: str, deleted: bool | None = None) -> DataFrame:
    """Rows of one organisation; optionally only those that are (not) deleted."""
    out = df.where(F.col("organization_id") == organization_id)
    return out if deleted is None else out.where(F.col("is_deleted") == deleted)


def matching(
    df: DataFrame, equal: dict | None = None, json: dict[str, str] | None = None, contains: dict[str, str] | None = None, after: tuple | None = None, before: tuple | None = None,
    present: Sequence[str] = (), excluded: dict | None = None,
) -> DataFrame:
    """Generic filter: equality or membership, ``column.path`` in JSON, case-insensitive contains, exclusive ranges
    (column, bound), columns that must be present, values that must not occur."""
    tests: list[Column] = []
    for k, v in (equal or {}).items():
        tests.append(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k).isNull() if v is None else F.col(k) == v)
    for k, v in (excluded or {}).items():
        tests.append(F.col(k).isNull() | ~F.col(k).isin(*v))
    for k, v in (json or {}).items():
        column, _, path = k.partition(".")
        tests.append(F.get_json_object(column, f"$.{path}") == v)
    for k, v in (contains or {}).items():
        tests.append(F.lower(k).contains(v.lower()))
    if after:
        tests.append(F.col(after[0]) > after[1])
    if before:
        tests.append(F.col(before[0]) < before[1])
    tests += [F.col(c).isNotNull() for c in present]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, key: str, limit: int, order: str = "created_at", ascending: bool = False, after: str | None = None, before: str | None = None, nulls_last: bool = True) -> DataFrame:
    """A page by (order, key) after or before the row with the cursor's key.

    Ties on ``order`` are broken by ``key`` in the page's own direction; null order values come last (first if not
    ``nulls_last``).  With both cursors, the rows between them.  A ``before`` page is the one that ends at its cursor.
    """
    null_rank = F.when(F.col(order).isNull(), 1 if nulls_last else -1).otherwise(0)
    keyed = df.withColumns({"__n": null_rank, "__o": F.col(order)})

    def beyond(cursor: str, forward: bool, rows: DataFrame) -> DataFrame:
        at = df.where(F.col(key) == cursor).select(null_rank.alias("cn"), F.col(order).alias("co"), F.col(key).alias("ck")).limit(1)
        up = ascending == forward
        o, k = (F.col("__o") > F.col("co"), F.col(key) > F.col("ck")) if up else (F.col("__o") < F.col("co"), F.col(key) < F.col("ck"))
        n = F.col("__n") > F.col("cn") if forward else F.col("__n") < F.col("cn")
        same = (F.col("__n") == F.col("cn")) & (F.col("__o").eqNullSafe(F.col("co")))
        test = n | ((F.col("__n") == F.col("cn")) & (F.coalesce(o, F.lit(False)) | (same & k)))
        return rows.join(F.broadcast(at), test, "left_semi")  # the cursor is one row

    rows = keyed
    if after is not None:
        rows = beyond(after, True, rows)
    if before is not None:
        rows = beyond(before, False, rows)
    ordering = lambda up: [F.col("__n").asc() if up == ascending else F.col("__n").desc(), F.col("__o").asc() if up else F.col("__o").desc(), F.col(key).asc() if up else F.col(key).desc()]
    if before is not None and after is None:
        rows = rows.orderBy(*ordering(not ascending)).limit(limit)
    return rows.orderBy(*ordering(ascending)).limit(limit).drop("__n", "__o")


def middle(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The middle ``limit`` of at most twice as many rows between two cursors."""
    rows = df.orderBy(*order).limit(2 * limit)
    w = Window.orderBy(*order)  # at most twice a page
    numbered = rows.withColumns({"__r": F.row_number().over(w), "__c": F.count("*").over(Window.partitionBy())})
    start = F.greatest(F.lit(0), F.floor((F.col("__c") - limit) / 2))
    return numbered.where((F.col("__r") > start) & (F.col("__r") <= start + limit)).drop("__r", "__c")


def pages_of(df: DataFrame, owner: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Every row with its owner's page number and whether a further page follows."""
    w = Window.partitionBy(owner)
    n = F.row_number().over(w.orderBy(*order))
    out = df.withColumns({"page": F.floor((n - 1) / limit), "__c": F.count("*").over(w)})
    return out.withColumn("has_more", (F.col("page") + 1) * limit < F.col("__c")).drop("__c")


def any_tag(tags: Column, wanted: Sequence[str], substring: bool = False) -> Column:
    """Does the array share a tag (or, as a mode, contain one as part of a tag)?"""
    if substring:
        return F.exists(tags, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in wanted]))
    return F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted]))


def all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tags)) == 0


def with_tags(df: DataFrame, tags: DataFrame, key: str, every: Sequence[str] = (), some: Sequence[str] = ()) -> DataFrame:
    """Rows whose tag table has all of ``every`` and one of ``some``: semi joins, so no row is repeated."""
    out = df
    if every:
        full = tags.where(F.col("tag").isin(*every)).groupBy(key).agg(F.count_distinct("tag").alias("__n")).where(F.col("__n") == len(set(every)))
        out = out.join(full, key, "left_semi")
    if some:
        out = out.join(tags.where(F.col("tag").isin(*some)), key, "left_semi")
    return out


def compare(column: str, op: str, value) -> Column:
    """A comparison by name: eq, gt, gte, lt, lte."""
    c = F.col(column)
    return {"eq": c == value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def with_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics, where there are any."""
    return runs.join(metrics, "run_id", "left")


def list_runs(
    runs: DataFrame, metrics: DataFrame, statuses: Sequence[str] = (), stop_reasons: Sequence[str] = (), background: bool | None = None, steps: tuple[str, int] | None = None,
    duration: tuple[str, int] | None = None, order: str = "created_at", limit: int = 100,
) -> DataFrame:
    """Runs by status, stop reason, background, step count and duration; newest or longest first; at most 1000."""
    out = with_metrics(runs, metrics)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if stop_reasons:
        out = out.where(F.col("stop_reason").isin(*stop_reasons))
    if background is not None:
        out = out.where(F.col("background") == background)
    if steps:
        out = out.where(compare("num_steps", *steps))
    if duration:
        out = out.where(compare("run_ns", *duration))
    return out.orderBy(F.desc_nulls_last(order), F.desc("run_id")).limit(min(limit, 1000))


def above_percentile(runs: DataFrame, value: str, p: float) -> DataFrame:
    """Rows at or above a percentile (interpolated) of their own population.

    Ranks come from counts of distinct values, range by range, so that no task sees all values.
    """
    counts = runs.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__m"))
    seen = ranked(counts, value, weight="__m")
    at = (F.col("__n") - 1) * F.lit(float(p))
    of = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    ends = seen.agg(of(F.floor(at)).cast("double").alias("lo"), of(F.ceil(at)).cast("double").alias("hi"), F.max(at - F.floor(at)).alias("part"))
    line = ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("__line"))
    return runs.join(F.broadcast(line), F.col(value) >= F.col("__line")).drop("__line")  # one row


#: Rows that one range of ``ranked`` holds on average, and its ranges at most (their bounds are a constant in the plan).
RANGE_ROWS, RANGES = 1_000_000, 4_096


def ranked(rows: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``rows`` with ``__upto`` (rows of the group with at most this value) and ``__n`` (rows of the group).

    Values are dealt to ranges between approximate quantiles; ranks inside a range come from a window, those of the ranges
    before it from the ranges' totals.  So a group may hold any share of the rows without being in one task.
    """
    m = F.lit(1) if weight is None else F.col(weight)
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    if ranges == 1:  # few rows: each group is one window
        whole = Window.partitionBy(*by)
        return rows.withColumns({"__upto": F.sum(m).over(whole.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)), "__n": F.sum(m).over(whole)})
    marks = sorted(set(rows.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []))
    dealt = rows.withColumn("__r", X.bucket_of(F.col(value), marks))
    keys = [*by, "__r"]
    totals = dealt.groupBy(*keys).agg(F.sum(m).alias("__here"))  # at most RANGES rows a group
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__here").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumns({"__before": before, "__n": F.sum("__here").over(w)}).drop("__here")
    same = [dealt[k].eqNullSafe(totals[k]) for k in keys]
    met = dealt.join(totals.hint("merge"), reduce(lambda a, b: a & b, same)).drop(*[totals[k] for k in keys])
    inside = F.sum(m).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return met.withColumn("__upto", F.col("__before") + inside).drop("__before", "__r")


def name_pattern(include: str) -> str:
    """A file-name filter as a regular expression to search for (any case): a glob if it has a star and nothing that only
    expressions have, anchored at its end alone; anything else is an expression already."""
    glob = "*" in include and not set(include) & set("^$()[]{}\\+")
    if glob:
        include = "".join({".": r"\.", "*": ".*", "?": "."}.get(c, c) for c in include) + "$"
    return "(?i)" + include


def date_bounds(start: str | None, end: str | None, zone: str = "UTC") -> tuple[Column | None, Column | None]:
    """ISO or date-only bounds in a zone as UTC timestamps; a date-only end means the end of that day."""
    at = lambda s: F.to_utc_timestamp(F.to_timestamp(F.lit(s)), zone)
    low = at(start) if start else None
    high = None
    if end:
        high = at(end) + F.expr("interval 1 day") - F.expr("interval 1 microsecond") if len(end) == 10 else at(end)
    return low, high


def text_in_content(content: Column, query: str) -> Column:
    """Does a text element of a content array contain the query (any case)?"""
    return F.exists(content, lambda c: (c["type"] == "text") & F.lower(c["text"]).contains(query.lower()))


def visible_across(trajectories: DataFrame, organization_id: str, domain: str, hide) -> DataFrame:
    """Own rows of a domain in full, and other organisations' shared ones as ``hide`` rewrites them."""
    rows = trajectories.where(F.col("domain_type") == domain)
    own = rows.where(F.col("organization_id") == organization_id).withColumn("visibility", F.lit("own"))
    other = hide(rows.where((F.col("organization_id") != organization_id) & F.col("share_cross_org"))).withColumn("visibility", F.lit("shared"))
    return own.unionByName(other)


# ---------------------------------------------------------------------------------------------------- joins
def linked(left: DataFrame, junction: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``right`` for each row of ``left`` through a junction table."""
    return left.join(junction.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def counts_by(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """``n`` rows and the ``first`` key of each group of ``rows``."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def linked_counts(left: DataFrame, junction: DataFrame, counts: DataFrame, left_key: str, right_key: str, by: Sequence[str] = ()) -> DataFrame:
    """What ``linked`` finds for each row of ``left``, counted by ``by``: ``counts`` (see ``counts_by``) holds a row for each
    group of a right key, so links of single rows are never written out."""
    met = linked(left, junction, counts, left_key, right_key)
    return met.groupBy(left_key, *by).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def union_passages(archival: DataFrame, source: DataFrame) -> DataFrame:
    """Both kinds of passages, the columns that one lacks filled with nulls."""
    return archival.withColumn("kind", F.lit("archival")).unionByName(source.withColumn("kind", F.lit("source")), allowMissingColumns=True)


def split_known(incoming: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new, known) incoming rows by id."""
    ids = stored.select(key)
    return incoming.join(ids, key, "left_anti"), incoming.join(ids, key, "left_semi")


def counted(left: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with a count per key, 0 where none."""
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def bulk_update(rows: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str], strict: bool = False) -> DataFrame:
    """New values where a key was updated, old ones elsewhere.  ``strict`` refuses updates of unknown keys, as one error."""
    if strict:
        lost = updates.join(rows.select(*keys), list(keys), "left_anti").select(*keys).distinct()
        n, some = lost.count(), [tuple(r) for r in lost.orderBy(*keys).limit(5).collect()]
        if n:
            raise LookupError(f"{n} updates name no row, as {some}")
    new = updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, list(keys), "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: str = "new") -> DataFrame:
    """Union by key: the new row wins, or (``keep='old'``) the old one."""
    if keep == "old":
        return old.unionByName(new.join(old.select(key), key, "left_anti"))
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_with_dependants(rows: DataFrame, doomed: DataFrame, key: str, dependants: Sequence[tuple[DataFrame, str]] = (), spare: DataFrame | None = None) -> list[DataFrame]:
    """``rows`` without the doomed keys (but for the spared ones), and each dependant table without the rows whose foreign
    key (named beside it) points at one that went.  Rows that point nowhere stay."""
    gone = doomed.select(key) if spare is None else doomed.select(key).join(spare.select(key), key, "left_anti")
    out = [rows.join(gone, key, "left_anti")]
    for table, foreign in dependants:
        out.append(table.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*table.columns))
    return out


def delete_set(rows: DataFrame, doomed: DataFrame, key: str, spare: DataFrame | None = None) -> DataFrame:
    """Rows without the doomed keys, but for the spared ones."""
    gone = doomed.select(key) if spare is None else doomed.select(key).join(spare.select(key), key, "left_anti")
    return rows.join(gone, key, "left_anti")
