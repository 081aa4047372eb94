"""Columns of doubles, by query: rounded to six places on both sides, as sums depend on the order of their terms."""

PLACES = 6

ROUNDED = {
    "a10_snapshot": ("avg_confidence", "avg_decisions", "avg_turns", "success_rate"),
    "a14_daily": ("avg_score",),
    "a15_agent_stats": ("avg_score",),
    "a16_annotation_agg": ("avg_score", "max_score", "min_score"),
    "a1_success_rate": ("success_rate",),
    "a24_cost": ("cache_write_cost", "cached_cost", "input_cost", "output_cost", "reasoning_cost", "total_cost"),
    "a26_latency": ("mean_value",),
    "a26_percentiles": ("mean",),
    "a7_duration_stats": ("max_value", "mean_value", "median_value", "min_value"),
    "a9_pivotal": ("pivotal_rate",),
    "e6_sql_function": ("distance",),
    "f12_annotations": ("score",),
    "f13_grain": ("score",),
    "f5_null_cursor": ("outcome_score",),
    "f6_list": ("outcome_score",),
    "flagship_actions": ("success_rate",),
    "p7_decisions": ("confidence",),
    "r5_daily": ("avg_score",),
    "s9_scores": ("value",),
    "t11_score": ("score",),
    "t13_enrich": ("score",),
    "t14_judge": ("score",),
    "t1c_outcome": ("confidence",),
    "u2_clamp": ("clamped",),
    "v14_bm25": ("score",),
    "v15_vector_mode": ("similarity",),
    "v16_rrf": ("score",),
    "v19_messages": ("score",),
    "v19_recent": ("score",),
    "v1_cosine": ("similarity",),
    "v25_export": ("outcome_score", "sq"),
    "v2_topk": ("similarity",),
    "v3_cross_org": ("similarity",),
    "v4_fallback": ("similarity",),
    "v5_tags": ("score",),
    "v5_text": ("score",),
    "v6_distance": ("similarity",),
    "v7_decision_search": ("similarity",),
    "w11_latency_cdf": ("share",),
    "x21_evaluations": ("score",),
    "x22_best_annotation": ("score",),
}
