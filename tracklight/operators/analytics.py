"""Aggregations over decisions, trajectories, annotations, steps and files: one scan, partial sums, small results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .listing import ranked


def success_rate(decisions: DataFrame, by: str = "action") -> DataFrame:
    """Share of successes; rows without a verdict do not count."""
    return decisions.where("success is not null").groupBy(by).agg(F.count("*").alias("calls"), F.avg(F.col("success").cast("int")).alias("success_rate"))


def frequency(rows: DataFrame, by: str, top: int | None = None, unknown: str | None = None) -> DataFrame:
    """Counts in descending order; nulls are left out, or named ``unknown``."""
    key = F.col(by) if unknown is None else F.coalesce(F.col(by), F.lit(unknown))
    counts = rows.select(key.alias(by)).where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), by)
    return ordered.limit(top) if top else ordered


def turn_counts(decisions: DataFrame) -> DataFrame:
    """How many trajectories have so many turns."""
    per = decisions.groupBy("trajectory_id").agg(F.count_distinct("turn_index").alias("turns"))
    return per.groupBy("turns").agg(F.count("*").alias("n"))


def duration_stats(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """min, max, mean and the upper median (element floor(n/2) in ascending order, from 0), per group.

    Repeated values are counted first, and ranks are taken range by range, so a group of any size is spread.
    """
    keys = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m"))
    seen = ranked(counts, value, keys, "m")
    median = F.min(F.when(F.col("__upto") > F.floor(F.col("__n") / 2), F.col(value)))
    return seen.groupBy(*keys).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), (F.sum(F.col(value) * F.col("m")) / F.sum("m")).alias("mean_value"), median.alias("median_value"))


def cumulative_share(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``share``: the part of the group's rows that have at most this value."""
    return ranked(rows, value, by).withColumn("share", F.col("__upto") / F.col("__n")).drop("__upto", "__n")


def histogram(rows: DataFrame, value: str, buckets: int = 10, percent: bool = False) -> DataFrame:
    """Counts of [0, 1] values in equal bins, 1.0 in the last, in numeric order.

    Labels are ``0.0-0.1``, of bins by ``value * buckets``; with ``percent`` they are ``0-10%``, of bins by
    ``value / (1 / buckets)``, which differ in the last bit (0.3 falls into ``20-30%``).
    """
    at = F.col(value) / F.lit(1.0 / buckets) if percent else F.col(value) * buckets
    bin_ = F.least(F.floor(at), F.lit(buckets - 1)).cast("int")
    width = 100 / buckets
    form = "%d-%d%%" if width.is_integer() else "%.1f-%.1f%%"
    edge = lambda x: (x * 100 / buckets).cast("int") if width.is_integer() else x * 100 / buckets
    label = F.format_string(form, edge(F.col("bin")), edge(F.col("bin") + 1)) if percent else F.format_string("%.1f-%.1f", F.col("bin") / buckets, (F.col("bin") + 1) / buckets)
    return rows.where(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn("label", label)


def pivotal(decisions: DataFrame) -> DataFrame:
    """Pivotal decisions and their share, by action."""
    return decisions.groupBy("action").agg(F.count_if("pivotal").alias("pivotal"), (F.count_if("pivotal") / F.count("*")).alias("pivotal_rate"))


def snapshot(decisions: DataFrame, trajectories: DataFrame) -> DataFrame:
    """All headline metrics in one row, counts and rates by key as ``key=value`` texts.

    ``trajectories``: trajectory_id, outcome (null: unknown), turns and messages of each.  Turns, messages and outcomes are
    theirs; decisions are counted by the three keys, whose combinations are few, in one pass.
    """
    n_turns, known = F.coalesce("turns", F.lit(0)), F.coalesce("outcome", F.lit("unknown"))
    total = trajectories.agg(F.count("*").alias("trajectories"), F.coalesce(F.sum(n_turns), F.lit(0)).alias("turns"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"))
    keys = ("action", "error_type", "decision_type")
    counts = decisions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("success").alias("known"), F.count_if("success").alias("ok"), F.count_if("pivotal").alias("pivotal"), F.sum("confidence").alias("conf"), F.count("confidence").alias("n_conf"),
    )
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "known", "ok", "pivotal", "conf", "n_conf")])
    told = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(k).cast("string").alias("k")) for k in keys])).alias("e"), "n", "known", "ok")
    told = told.where("e.k is not null").groupBy("e.of", "e.k").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("ok").alias("ok"))
    number = lambda of, k: trajectories.groupBy(k.alias("k")).agg(F.count("*").alias("n")).select(F.lit(of).alias("of"), F.col("k").cast("string").alias("k"), "n", F.lit(0).alias("known"), F.lit(0).alias("ok"))
    told = told.unionByName(number("turn_distribution", n_turns)).unionByName(number("outcomes", known))
    listed = lambda of: F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct(F.when(F.lit(of == "turn_distribution"), F.col("k").cast("bigint")).alias("by"), "k", "n", "known", "ok"))))
    text = lambda of, value, name: F.array_join(F.transform(listed(of), lambda e: F.concat(e["k"], F.lit("="), value(e).cast("string"))), ",").alias(name)
    rate = lambda e: F.when(e["known"] > 0, F.round(e["ok"] / e["known"], 6)).otherwise(F.lit(0.0))
    texts = told.agg(*[text(k, lambda e: e["n"], k) for k in (*keys, "turn_distribution", "outcomes")], text("action", rate, "success_rates"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = total.join(F.broadcast(sums)).join(F.broadcast(texts))  # three one-row tables
    return out.select(
        "trajectories", "turns", F.col("n").alias("decisions"), "messages", share("turns", "trajectories").alias("avg_turns"), share("n", "turns").alias("avg_decisions"), share("ok", "known").alias("success_rate"),
        "pivotal", share("conf", "n_conf").alias("avg_confidence"), *keys, "turn_distribution", "outcomes", "success_rates",
    )


def report(decisions: DataFrame, trajectories: DataFrame, top: int = 5, errors: int = 3) -> DataFrame:
    """A text report: totals, averages, the most frequent actions with their rate, outcomes, and the most frequent errors.
    Columns as in ``snapshot``; names break ties."""
    counts = decisions.groupBy("action", "error_type").agg(F.count("*").alias("n"), F.count("success").alias("known"), F.count_if("success").alias("ok"))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("d"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"))
    total = trajectories.agg(F.count("*").alias("t"), F.coalesce(F.sum("turns"), F.lit(0)).alias("u"), F.coalesce(F.sum("messages"), F.lit(0)).alias("m"))
    percent = lambda ok, known, places: F.bround(F.when(known > 0, 100.0 * ok / known).otherwise(F.lit(0.0)), places)
    ranked_ = lambda rows: F.row_number().over(Window.orderBy(F.desc("n"), "k"))  # noqa: E731, ARG005 - a row for each name
    actions = counts.groupBy(F.col("action").alias("k")).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("ok").alias("ok"))
    actions = actions.select(F.lit("a").alias("of"), ranked_(actions).alias("r"), F.format_string("  %s: %d calls (%.0f%% success)", "k", "n", percent(F.col("ok"), F.col("known"), 0)).alias("line")).where(F.col("r") <= top)
    plain = lambda rows, of: rows.select(F.lit(of).alias("of"), ranked_(rows).alias("r"), F.format_string("  %s: %d", "k", "n").alias("line"))
    failed = plain(counts.where("error_type is not null").groupBy(F.col("error_type").alias("k")).agg(F.sum("n").alias("n")), "e").where(F.col("r") <= errors)
    ended = plain(trajectories.groupBy(F.coalesce("outcome", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n")), "o")
    lines = lambda of: F.transform(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.struct("r", "line")))), lambda x: x["line"])
    part = actions.unionByName(failed).unionByName(ended).agg(*[lines(x).alias(x) for x in "aeo"])
    mean = lambda a, b: F.bround(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 1)
    # The report's words.
    head = F.array(
        F.lit("=== OTS Analytics Summary ==="), F.lit(""), F.lit("Totals:"), F.format_string("  Trajectories: %d", "t"), F.format_string("  Turns: %d", "u"), F.format_string("  Decisions: %d", "d"), F.format_string("  Messages: %d", "m"), F.lit(""),
        F.lit("Averages:"), F.format_string("  Turns per trajectory: %.1f", mean("u", "t")), F.format_string("  Decisions per turn: %.1f", mean("d", "u")), F.format_string("  Overall success rate: %.1f%%", percent(F.col("ok"), F.col("known"), 1)), F.lit(""), F.lit("Top Actions:"),
    )
    last = F.when(F.size("e") > 0, F.concat(F.array(F.lit(""), F.lit("Top Errors:")), F.col("e"))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(head, F.col("a"), F.array(F.lit(""), F.lit("Outcomes:")), F.col("o"), last)
    return total.join(F.broadcast(sums)).join(F.broadcast(part)).select(F.array_join(whole, "\n").alias("report"))  # three one-row tables


def daily(rows: DataFrame, ts: str, score: str, as_of: Column, days: int = 30) -> DataFrame:
    """Counts and mean score of the last days, ascending."""
    day = F.to_date(F.col(ts))
    recent = rows.where(F.col(ts) >= as_of - F.expr(f"interval {days} days"))
    return recent.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score")).orderBy("day")


def per_agent(rows: DataFrame, score: str = "outcome_score") -> DataFrame:
    """Count and mean score; missing scores only miss in the mean."""
    return rows.groupBy("agent_id").agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """count, mean, min, max, evaluators and the label counts of each trajectory; a score of 0 stays 0."""
    stats = annotations.groupBy("trajectory_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_distinct("evaluator_id").alias("evaluators"),
    )
    labels = annotations.where("label is not null").groupBy("trajectory_id", "label").agg(F.count("*").alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "c"))), lambda e: F.concat(e["label"], F.lit("="), e["c"].cast("string"))), ",")
    return stats.join(labels.groupBy("trajectory_id").agg(joined.alias("labels")), "trajectory_id", "left")


def zero_filled(rows: DataFrame, by: str, known: Sequence[str]) -> DataFrame:
    """Counts of each known value (0 where none) and ``total``."""
    spark = rows.sparkSession
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias(by))
    filled = names.join(counts.hint("shuffle_hash"), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("total").alias(by), "n"))


def tag_counts(rows: DataFrame, owner: str, tags: Sequence[str]) -> DataFrame:
    """Counts of each tag of an owner, from tag columns."""
    return rows.select(owner, F.explode(F.array(*tags)).alias("tag")).where("tag is not null").groupBy(owner, "tag").agg(F.count("*").alias("n"))


def source_stats(files: DataFrame) -> DataFrame:
    """Files and bytes of each source without deleted files, 0 when none; the grand total has source ``total``."""
    live = files.where("not is_deleted").groupBy("source_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    each = files.select("source_id").distinct().join(live, "source_id", "left").select("source_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return each.rollup("source_id").agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes")).select(F.coalesce("source_id", F.lit("total")).alias("source_id"), "n_files", "bytes")


def run_usage(steps: DataFrame) -> DataFrame:
    """Token sums of each run; cached, cache-write and reasoning tokens are null unless some were seen."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    seen = lambda c: F.when(F.sum(zero(c)) > 0, F.sum(zero(c))).alias(c)
    return steps.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.sum(zero("prompt_tokens")).alias("prompt_tokens"), F.sum(zero("completion_tokens")).alias("completion_tokens"), F.sum(zero("prompt_tokens") + zero("completion_tokens")).alias("total_tokens"),
        seen("cached_tokens"), seen("cache_write_tokens"), seen("reasoning_tokens"),
    )


#: Token counts of a step, the price that each is billed at, and the name of its cost.
BILLED = (
    ("prompt_tokens", "input", "input_cost"), ("completion_tokens", "output", "output_cost"), ("cached_tokens", "cached", "cached_cost"), ("cache_write_tokens", "cache_write", "cache_write_cost"),
    ("reasoning_tokens", "reasoning", "reasoning_cost"),
)
#: A price list of at most so many rows is broadcast; a longer one is joined by a shuffle.
PRICES = 100_000


def step_cost(steps: DataFrame, prices: DataFrame) -> DataFrame:
    """USD of each step and kind of token: price by exact model name, else without the provider prefix, else by the
    name's first three dash parts.

    Every count is billed in full (prompt tokens include cached ones); a missing price of a listed model is 0; a count
    that is null or 0 has no cost, nor has a model without a price; a total of 0 is null.
    """
    few = "broadcast" if prices.count() <= PRICES else "merge"
    short, three = F.regexp_replace("model", r"^[^/]*/", ""), F.concat_ws("-", F.slice(F.split("model", "-"), 1, 3))
    out, found = steps, []
    for i, key in enumerate((F.col("model"), short, three)):
        p = prices.select(F.col("model").alias(f"m{i}"), F.struct(*[F.coalesce(price, F.lit(0.0)).alias(price) for _, price, _ in BILLED]).alias(f"p{i}"))
        out = out.join(p.hint(few), key == F.col(f"m{i}"), "left")
        found.append(F.col(f"p{i}"))
    price = F.coalesce(*found)
    parts = {cost: F.when(F.col(count) > 0, F.col(count) / 1_000_000.0 * price[name]) for count, name, cost in BILLED}
    out = out.withColumns(parts).drop("m0", "m1", "m2", "p0", "p1", "p2")
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in parts])
    return out.withColumn("total_cost", F.when(total > 0, total))


def run_metrics(steps: DataFrame, given: DataFrame, calls: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """num_steps of each run, with the given run_ns where there is one, and the ids of the tools it used, sorted; null
    if it used none.  ``calls``: run_id, tool (a name); ``tools``: name, tool_id; names without an id do not count."""
    counts = steps.groupBy("run_id").agg(F.count("*").alias("num_steps"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    span = (F.col("last").cast("timestamp").cast("bigint") - F.col("first").cast("timestamp").cast("bigint")) * 1_000_000_000
    out = counts.join(given.select("run_id", "run_ns"), "run_id", "left").withColumn("run_ns", F.coalesce("run_ns", span))
    if calls is None or tools is None:
        return out.select("run_id", "num_steps", "run_ns", F.lit(None).cast("array<string>").alias("tools_used"))
    used = calls.select("run_id", F.col("tool").alias("name")).distinct().join(tools.select("name", "tool_id").hint("merge"), "name")
    ids = used.groupBy("run_id").agg(F.array_sort(F.collect_set("tool_id")).alias("tools_used"))
    return out.join(ids, "run_id", "left").select("run_id", "num_steps", "run_ns", "tools_used")


def stacked(rows: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row (attributes, metric, value) for each metric that a row has."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(*by, F.explode(pairs).alias("__m")).select(*by, "__m.metric", "__m.value").where("value is not null")


def latency(rows: DataFrame, metrics: dict[str, tuple[float, float, int]], by: Sequence[str]) -> DataFrame:
    """Count, mean and equal-width bucket counts of each metric (lowest bound, highest bound, buckets) for each attribute
    combination; bucket 0 is below the bounds, the last one above."""
    long = stacked(rows, list(metrics), by)
    bucket = F.coalesce(*[F.when(F.col("metric") == m, F.width_bucket(F.col("value"), F.lit(float(low)), F.lit(float(high)), F.lit(n))) for m, (low, high, n) in metrics.items()])
    return long.groupBy(*by, "metric", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


#: Items that a quantile sketch keeps of each level: ranks are off by about 1 / 4000 of the rows (exact up to so many rows).
SKETCH_ITEMS = 32_768


def sketches(rows: DataFrame, metrics: Sequence[str], by: Sequence[str], items: int = SKETCH_ITEMS) -> DataFrame:
    """A mergeable quantile sketch (KLL) of each metric for each attribute combination, with count, sum and ends: what is
    stored instead of the rows."""
    made = F.kll_sketch_agg_double("value", F.lit(items)).alias("sketch")
    return stacked(rows, metrics, by).groupBy(*by, "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), made)


def roll_up(stored: DataFrame, by: Sequence[str], items: int = SKETCH_ITEMS) -> DataFrame:
    """Sketches of fewer attributes, merged from stored ones; the rows are not read again."""
    merged = F.kll_merge_agg_double("sketch", F.lit(items)).alias("sketch")
    return stored.groupBy(*by, "metric").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), merged)


def percentiles(stored: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' quantiles, a column for each of ``shares``."""
    return stored.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in shares.items()}).withColumn("mean", F.col("total") / F.col("n")).drop("sketch", "total")


def batch_summary(rows: DataFrame, by: str, before: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """Total, running, completed and failed items of each batch, and how many were updated: those whose status is not the
    one they had ``before`` (key, status; items that it lacks are new, and count)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    if before is None:
        told = rows.withColumn("__new", F.lit(False))
    else:
        met = rows.join(before.select(key, F.col("status").alias("__old")).hint("merge"), key, "left")
        told = met.withColumn("__new", ~F.col("status").eqNullSafe(F.col("__old")))
    return told.groupBy(by).agg(F.count("*").alias("total"), is_("running").alias("running"), is_("completed").alias("completed"), is_("failed").alias("failed"), F.count_if("__new").alias("updated"))


def storage_estimate(rows: DataFrame, by: str, dimension: int = 4096, width: int = 4) -> DataFrame:
    """Embedding storage of each owner in bytes and as a text of two places (a tie goes to the even digit, as in C and
    Python; Java's formatter would round it up)."""
    n = F.count("*") * dimension * width
    units = ("KB", "MB", "GB", "TB")
    text = F.when(n < 1024, F.format_string("%d B", n))
    for i, unit in enumerate(units, 1):
        told = F.format_string(f"%.2f {unit}", F.bround(n / 1024**i, 2))
        text = text.otherwise(told) if unit == units[-1] else text.when(n < 1024 ** (i + 1), told)
    return rows.groupBy(by).agg(F.count("*").alias("n"), n.alias("bytes"), text.alias("pretty"))
