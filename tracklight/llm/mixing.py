"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Of all document rates between 0 and ``MOST`` whose token sums meet each source's target, the mix takes the ones of
largest entropy relative to one copy each.  By duality they are exponentially tilted: rate = min(MOST, exp(lambda *
size / mean size)), with one multiplier for each source.  The multipliers come from Newton steps on the convex dual,
kept inside a bracket.  The dual needs only how many documents of a source have a size, so each step is one small
join and sum over that table, for all sources at once.

Rates become copies by systematic rounding down the sizes (largest first), then by a few rounds that give or take
copies of ever smaller documents until a source's sum meets its target, and by exchanges of one copy for another whose
sizes differ by what is still missing.  Which documents of one source and size get
the odd copy is decided by a hash of their id and text, found with a salted rank; rows that agree in both are told apart by
a hash of their place in the table, found likewise.  So neither a source nor a size nor a repeated row is ever in one task.

Defined results: null texts have size 0 and one copy of nothing; a null source is a source of its own, the last;
null and repeated ids and repeated rows are documents of their own; a source without words takes none; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, read, spool

WEIGHTS = (1, 2, 3)
MOST = 3
#: Newton steps, halvings of the bracket after them, rounds of corrections to the rounding, and of exchanges of two
#: documents' copies.
STEPS, HALVINGS, CORRECTIONS, EXCHANGES = 30, 90, 2, 3
#: Newton steps or halvings that one job makes.
ROUNDS_A_JOB = 5
#: Salts that spread the documents of one source and size; rows for each salt beyond which there are more.
SALTS, SALT_ROWS = 64, 1_000_000
#: Tables of source and size with at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_CLASSES = 500_000


def words_of(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_key(source: str) -> Column:
    """A source's name that is never null: ``s`` and the source, or ``n``."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_targets(classes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, target): shares of all words by weight, held to ``most`` times a source's own words.

    Water-filling in closed form: in order of cap / weight, a source is at its cap if its cap is below what the
    rest of the words would give it.  The windows have one row for each source.
    """
    sums = classes.groupBy("src").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    by_name = Window.orderBy(F.col("src") == "n", "src")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    weighed = sums.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), "src")
    rest, weight = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", rest / weight)
    held = level.withColumn("held", F.col("cap") < F.col("level") * F.col("w"))
    final = F.max(F.when(~F.col("held"), F.col("level"))).over(Window.partitionBy())  # the first source below its cap sets the level; later ones would lower it
    return held.select("src", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("w"))).alias("target"))


def multipliers(classes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(src, source_size, target, mean, lam): the dual's solution for each source."""
    shape = classes.where("size > 0").groupBy("src").agg(F.sum(F.col("c") * F.col("size")) / F.sum("c"), F.min("size")).toDF("src", "mean", "least")
    state = targets.join(shape.hint("merge"), "src", "left").select(
        "src", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
        (-60.0 * F.col("mean") / F.col("least")).alias("lo"), (math.log(most) * F.col("mean") / F.col("least")).alias("hi"),
    )
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    idle = (F.col("source_size") == 0) | full
    start = F.when(F.col("source_size") == 0, 0.0).when(full, F.col("hi")).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")) * 0.5)
    state = spool(state.withColumn("lam", F.greatest(F.coalesce("lo", F.lit(0.0)), F.least(F.coalesce("hi", F.lit(0.0)), start))).withColumn("done", idle), "dual")
    sized = classes.where("size > 0").select("src", F.col("size").alias("s"), "c")
    ends = ["src", "source_size", "target", "mean", "lo", "hi", "lam", "done"]
    for round_ in range(STEPS + HALVINGS):
        tilt = F.exp(F.col("lam") * F.col("s") / F.col("mean"))
        mass = F.col("c") * F.col("s")
        # sources and their sizes stay where their name was hashed to, so rounds follow each other without another shuffle
        sums = state.join(sized.hint("merge"), "src", "left").groupBy(*ends).agg(
            F.sum(mass * F.least(tilt, F.lit(float(most)))).alias("got"),
            F.sum(F.when(tilt < most, mass * F.col("s") / F.col("mean") * tilt).otherwise(0.0)).alias("slope"),
        )
        low = F.col("got") < F.col("target")
        lo, hi = F.when(low, F.col("lam")).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.col("slope")
        step = F.when(F.lit(round_ < STEPS) & (F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        # met, or as near as doubles come
        met = (F.abs(F.col("got") - F.col("target")) <= 0.01 + 1e-9 * F.col("target")) | (hi - lo <= 1e-14 * F.greatest(F.abs(lo), F.abs(hi)))
        running = ~F.col("done")
        state = sums.select(
            "src", "source_size", "target", "mean", F.when(running, lo).otherwise(F.col("lo")).alias("lo"), F.when(running, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(running & ~met, step).otherwise(F.col("lam")).alias("lam"), (F.col("done") | met).alias("done"),
        )
        if round_ % ROUNDS_A_JOB == ROUNDS_A_JOB - 1 or round_ == STEPS + HALVINGS - 1:
            state = spool(state, "dual")
            if state.where(~F.col("done")).isEmpty():
                break
    else:
        raise ArithmeticError("the dual of the mix has not been solved")
    return state.select("src", "source_size", "target", "mean", "lam")


def class_copies(classes: DataFrame, duals: DataFrame, most: int = MOST) -> DataFrame:
    """(src, size, c, source_size, target, copies): whole copies of each source and size, all its documents together."""
    tilted = classes.join(duals.hint("merge"), "src")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    down = Window.partitionBy("src").orderBy(F.desc("size"))
    upto = F.sum(F.col("c") * rate).over(down.rowsBetween(Window.unboundedPreceding, 0))
    out = tilted.withColumn("upto", F.floor(upto + 0.5)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    out = out.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), most * F.col("c"))))
    for _ in range(CORRECTIONS):
        off = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("src"))
        out = out.withColumn("off", off)
        room = F.when(F.col("off") > 0, most * F.col("c") - F.col("copies")).otherwise(F.col("copies"))
        out = out.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("off")), room).otherwise(0))
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fit = F.least(F.col("room"), F.greatest(F.lit(0), F.floor((F.abs("off") - before) / F.greatest(F.col("size"), F.lit(1)))))
        out = out.withColumn("copies", F.col("copies") + F.signum("off").cast("bigint") * fit)
    out = out.select("src", "size", "c", "source_size", "target", "copies")
    for _ in range(EXCHANGES):
        out = exchange(spool(out, "copies"), most)
    return out


def exchange(out: DataFrame, most: int) -> DataFrame:
    """One copy more of one size for one less of another (either may be none), where that brings a source's sum nearest
    to its target.

    Adding size a and taking size b leaves the gap ``off - a + b``: for each a the best b is the neighbour of
    ``a - off`` in order of size, found by one sorted run over both.
    """
    base = out.withColumn("off", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("src")))
    some, none = F.col("size") > 0, F.lit(None).cast("bigint")
    idle = base.groupBy("src").agg(F.first("off").alias("off"))
    adds = base.where(some & (F.col("copies") < most * F.col("c"))).select("src", "off", (F.col("size") - F.col("off")).alias("v"), F.col("size").alias("plus"), none.alias("minus"))
    adds = adds.unionByName(idle.select("src", "off", (-F.col("off")).alias("v"), F.lit(0).cast("bigint").alias("plus"), none.alias("minus")))
    takes = base.where(some & (F.col("copies") > 0)).select("src", "off", F.col("size").cast("double").alias("v"), none.alias("plus"), F.col("size").alias("minus"))
    takes = takes.unionByName(idle.select("src", "off", F.lit(0.0).alias("v"), none.alias("plus"), F.lit(0).cast("bigint").alias("minus")))
    run = Window.partitionBy("src").orderBy("v", "plus", "minus")
    below = F.last("minus", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("minus", ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing))
    met = adds.unionByName(takes).withColumns({"below": below, "above": above}).where("plus is not null")
    options = met.select("src", "off", "v", "plus", F.explode(F.array("below", "above")).alias("minus")).where("minus is not null")
    best = options.groupBy("src").agg(F.min(F.struct(F.abs(F.col("minus") - F.col("v")).alias("gap"), "plus", "minus", "off")).alias("b")).where("b.gap < abs(b.off)")
    moved = out.join(best.hint("merge"), "src", "left")
    plus, minus = ((some & F.coalesce(F.col("size") == F.col(f"b.{x}"), F.lit(False))).cast("bigint") for x in ("plus", "minus"))
    return moved.select("src", "size", "c", "source_size", "target", (F.col("copies") + plus - minus).alias("copies"))


def row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """A row's place in the order that hands out odd copies: a hash of its id and text, and one of its place in the
    table, which tells rows apart that have both in common."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.lit("mix")), F.xxhash64(F.monotonically_increasing_id())


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with a struct ``mixed`` (size, source_size, target, copies); underscores are added if the name is taken."""
    name = fresh(docs, "mixed")
    h, m = row_keys(doc_id, text)
    sized = spool(docs.select(h.alias("h"), m.alias("m"), source_key(source).alias("src"), words_of(text).alias("size")), "sized")
    salts = max(SALTS, sized.count() // SALT_ROWS)
    salt = F.pmod(F.col("h"), F.lit(salts))
    salted = spool(sized.groupBy("src", "size", salt.alias("salt")).agg(F.count("*").alias("c")), "salted")
    classes = spool(salted.groupBy("src", "size").agg(F.sum("c").alias("c")), "classes")
    duals = multipliers(classes, source_targets(classes))
    taken = spool(class_copies(classes, duals), "copies")
    # the odd copies go to the lowest salts, and within the last of them to the lowest hashes
    odd = F.pmod("copies", F.col("c"))
    run = Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cut = salted.withColumnRenamed("c", "here").withColumn("before", F.coalesce(F.sum("here").over(run), F.lit(0))).join(taken.hint("merge"), ["src", "size"]).where((F.col("before") <= odd) & (odd < F.col("before") + F.col("here")))
    cut = cut.select("src", "size", F.col("salt").alias("cut"), (odd - F.col("before")).alias("nth"))
    # the edge is a hash; rows that share it are told apart by their place, in salts again, however many they are
    inside = sized.withColumn("cut", salt).join(cut.hint("merge"), ["src", "size", "cut"]).groupBy("src", "size", "cut", "nth", "h").agg(F.count("*").alias("alike"))
    below = Window.partitionBy("src", "size").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    edge = inside.withColumn("before", F.coalesce(F.sum("alike").over(below), F.lit(0))).where((F.col("before") <= F.col("nth")) & (F.col("nth") < F.col("before") + F.col("alike")))
    edge = spool(edge.select("src", "size", "cut", F.col("h").alias("edge"), (F.col("nth") - F.col("before")).alias("nth"), "alike"), "edges")
    again = edge.where("alike > 1").select("src", "size", F.col("edge").alias("h"), "nth")
    place = F.pmod(F.col("m"), F.lit(salts))
    if again.isEmpty():
        edge = edge.select("src", "size", "cut", "edge", F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("last"))
    else:
        twins = spool(sized.join(again.hint("merge"), ["src", "size", "h"]).select("src", "size", "nth", place.alias("place"), "m"), "twins")
        upto = Window.partitionBy("src", "size").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        salted_ = twins.groupBy("src", "size", "nth", "place").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
        at = salted_.where((F.col("before") <= F.col("nth")) & (F.col("nth") < F.col("before") + F.col("here"))).select("src", "size", "place", (F.col("nth") - F.col("before")).alias("k"))
        row = F.row_number().over(Window.partitionBy("src", "size").orderBy("m")) - 1
        last = twins.drop("nth").join(at.hint("merge"), ["src", "size", "place"]).withColumn("row", row).where("row = k").select("src", "size", "place", F.col("m").alias("last"))
        edge = edge.join(last.hint("merge"), ["src", "size"], "left").select("src", "size", "cut", "edge", "place", "last")
    plan = spool(taken.join(edge.hint("merge"), ["src", "size"]).select(F.col("src").alias("k_src"), F.col("size").alias("k_size"), "source_size", "target", F.floor(F.col("copies") / F.col("c")).alias("whole"), (odd > 0).alias("odd"), "cut", "edge", F.col("place").alias("k_place"), "last"), "plan")
    few = plan.count() <= BROADCAST_CLASSES
    keyed = docs.select(F.struct(*docs.columns).alias("row"), h.alias("h"), m.alias("m"), source_key(source).alias("src"), words_of(text).alias("size"))
    met = keyed.join(plan.hint("broadcast" if few else "merge"), (F.col("src") == F.col("k_src")) & (F.col("size") == F.col("k_size")))
    earlier = (place < F.col("k_place")) | ((place == F.col("k_place")) & (F.col("m") < F.col("last")))
    first = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.coalesce(earlier, F.lit(False)))
    extra = F.col("odd") & ((salt < F.col("cut")) | ((salt == F.col("cut")) & first))
    return met.select("row.*", F.struct("size", "source_size", "target", (F.col("whole") + extra.cast("bigint")).alias("copies")).alias(name))


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it; all columns stay."""
    name = fresh(docs, "mixed")
    taken = mix(docs).where(F.col(f"{name}.copies") > 0)
    again = fresh(taken, "again")
    return taken.withColumn(again, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{name}.copies")))).select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, weights 1, 2, 3 repeating over the sources."""
    m = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", (F.col("mixed.copies") * F.col("mixed.size")).alias("taken"), "source", F.col("mixed.copies").alias("copies"))
