"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a key (a hash of the text, so that equal texts are neighbours, then a hash of the id).  A
size-weighted sample of keys gives quantile boundaries; records are dealt to the ranges between them, ranges that
turn out overfull are subdivided by a denser sample of their own, and each range is sorted on its own.  Exact range
totals then place every record on one line of bytes, which is cut into shards of equal length: law ``bytes``.  Equal
texts lie next to each other on that line, so a group of them stays in one shard unless one of the cuts (one fewer than
shards) falls inside it.  A cut is not moved to the group's edge: the law promises sizes that differ by no more than a
record, and a moved cut would make them differ by up to half a group.

Defined results: a null text counts as empty (size 1, crc32 0); null ids and repeated rows are records like any other;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, read, spool

SHARDS = 8
#: Ranges for each shard at least; records, and bytes where whole records move, in a range on average; ranges at most
#: (their splitters and totals are what reaches the driver; beyond it ranges grow and their sorts spill).
RANGES_PER_SHARD, RANGE_ROWS, RANGE_BYTES, RANGES = 8, 500_000, 64 << 20, 40_000
#: Sampled keys for each range.
SAMPLES = 16
#: A range is overfull beyond so many times the mean; rounds of subdividing.
OVERFULL, ROUNDS = 2.0, 3


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def literal(values: list[int]) -> Column:
    """A constant array of longs (folded once at planning time)."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (h, tie), by binary search."""
    if not splitters:
        return F.lit(0)
    n, step = len(splitters), 1
    while step * 2 <= n:
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    first, second = literal([a for a, _ in splitters]), literal([b for _, b in splitters])

    def probe(at: Column, by: Column) -> Column:
        i = at + by
        a, b = F.get(first, i - 1), F.get(second, i - 1)
        below = (a < F.col("h")) | ((a == F.col("h")) & (b <= F.col("tie")))
        return F.when((i <= n) & below, i).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe)


def sample_splitters(keys: DataFrame, total: int, ranges: int, samples: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample of about ``samples`` keys (that many reach the driver)."""
    rate = samples / max(1, total)
    chance = F.pmod(F.xxhash64("h", "tie", F.lit(8)), F.lit(1 << 40)) / float(1 << 40)
    drawn = keys.where(chance < F.col("size") * rate).select("h", "tie", F.greatest(F.lit(1.0), F.col("size") * rate).alias("weight"))
    rows = sorted((r.h, r.tie, r.weight) for r in drawn.collect())
    whole, run, cuts = sum(w for *_, w in rows), 0.0, []
    for h, tie, weight in rows:
        run += weight
        if run >= whole * (len(cuts) + 1) / ranges and len(cuts) < ranges - 1:
            cuts.append((h, tie))
    return cuts


def splitters_for(keys: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Boundaries between which records (h, tie, size) lie evenly; overfull ranges get boundaries from samples of their
    own."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = sorted(set(sample_splitters(keys, total, ranges, ranges * SAMPLES)))
    for _ in range(ROUNDS):
        ranged = keys.withColumn("range", range_of(cuts))
        full = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * total / ranges).collect()}
        if not full:
            break
        inside = ranged.where(F.array_contains(literal(sorted(full)), F.col("range").cast("bigint")))
        size = sum(full.values())
        parts = int(2 * size / (total / ranges)) + 1
        more = sorted(set(cuts) | set(sample_splitters(inside, size, parts, parts * SAMPLES)))
        if len(more) == len(cuts):
            break
        cuts = more
    return cuts


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (all of ``docs`` by default) with ``size``, ``law``, ``shard`` and ``slot`` as a struct named
    ``placed`` (underscores are added if ``docs`` has that name)."""
    name = fresh(docs, "placed")
    content = F.coalesce(F.col(text), F.lit(""))
    # the tie is the id's hash; its lowest bits tell repeated rows apart, so that even those can be split
    tie = F.xxhash64(doc_id).bitwiseAND(F.lit(-65536)).bitwiseOR(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(65536)))
    key = F.struct(F.xxhash64(content).alias("h"), tie.alias("tie"), size_of(text).alias("size"))
    keyed = docs.select(F.struct(*(keep if keep is not None else docs.columns)).alias("row"), key.alias("key")).select("row", "key.*")
    keys = spool(keyed.select("h", "tie", "size"), "keys")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(RANGES, max(RANGES_PER_SHARD * shards, rows // RANGE_ROWS + 1, total // RANGE_BYTES + 1 if keep is None else 0))
    cuts = splitters_for(keys, int(ranges))
    line = Window.partitionBy("range").orderBy("h", "tie")
    laid = keyed.withColumn("range", range_of(cuts)).select(
        "row", "size", "range",
        (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("bytes_before"),
        (F.row_number().over(line) - 1).cast("bigint").alias("rows_before"),
    )
    laid = spool(laid, "ranges")
    # one row a range reaches the driver: exact totals, in order
    totals = sorted(laid.groupBy("range").agg(F.sum("size"), F.count("*")).collect())
    most = max((r[0] for r in totals), default=0) + 1
    byte_start, row_start, bytes_, rows_ = [0] * most, [0] * most, 0, 0
    for r, size, count in totals:
        byte_start[r], row_start[r] = bytes_, rows_
        bytes_, rows_ = bytes_ + size, rows_ + count
    start = F.get(literal(byte_start), F.col("range")) + F.col("bytes_before")
    middle = F.expr(f"2 * {max(1, bytes_)}")
    number = F.least(F.lit(shards - 1), F.floor(((2 * start + F.col("size")).cast("decimal(38,0)") * shards) / middle).cast("int"))
    placed = laid.withColumn("shard", number).withColumn("at", F.get(literal(row_start), F.col("range")) + F.col("rows_before"))
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("at")).collect()}
    origin = literal([first.get(s, 0) for s in range(shards)])
    slot = F.col("at") - F.get(origin, F.col("shard"))
    return placed.select("row.*", F.struct("size", F.lit("bytes").alias("law"), "shard", slot.alias("slot")).alias(name))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents into eight shards of equal bytes."""
    docs = read(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32")
    placed = shard(docs, keep=[F.col("doc_id"), crc])
    return placed.select("doc_id", "placed.size", "text_crc32", "placed.law", "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"))
