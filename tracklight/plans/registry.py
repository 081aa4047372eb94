"""All registered queries outside the training-data subpackage, with the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import view, with_views
from .rounding import PLACES, ROUNDED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder by name: ``t.events``, ``t.v_runs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def rounded(name: str, sql: str) -> str:
    """``sql`` with the query's double columns rounded."""
    columns = ", ".join(f"round({c}, {PLACES}) as {c}" for c in ROUNDED.get(name, ()))
    return f"select * replace ({columns}) from ({sql}) as r" if columns else sql


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of ``Tables`` as a query, and its SQL (canonical views may be named in it)."""

    def add(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(c, PLACES) for c in ROUNDED[name]}) if name in ROUNDED else out

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = rounded(name, with_views(sql))
        return run

    return add


from . import decision_queries, listing_queries, record_queries, search_queries, text_queries  # noqa: E402, F401
