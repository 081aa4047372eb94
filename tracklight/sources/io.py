"""Readers, sinks and exports: trajectory stores, file lists, chat logs, spans and traces, ingest rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_trajectories(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One JSON document a file (``lines``: a line) for each trajectory, with a given schema (no inference pass)."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def upsert_versions(old: DataFrame, new: DataFrame, key: str = "trajectory_id", version: str = "version") -> DataFrame:
    """The latest version of each key; of equal versions the new row."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__n", n).where("__n = 1").drop("__n", "__new")


def write_trajectories(df: DataFrame, path: str, part: str = "domain_type") -> None:
    """Parquet, partitioned by domain, so that a domain filter reads its own files only."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def _replace_parts(spark: SparkSession, path: str, rows: DataFrame, touched: list, part: str) -> None:
    """The partitions ``touched`` of the store hold ``rows`` from now on; no other one is written."""
    stage = f"{path}.stage-{uuid.uuid4().hex}"  # rows are read from the store itself
    rows.write.parquet(stage)
    new = spark.read.schema(rows.schema).parquet(stage)
    new.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    left = {r[0] for r in new.select(part).distinct().collect()}
    gone = [x for x in touched if x not in left]
    if gone:  # partitions without rows have nothing to overwrite them
        found = spark.read.parquet(path).where(F.col(part).isin([x for x in gone if x is not None]) | (F.col(part).isNull() if None in gone else F.lit(False)))
        folders = {r[0].rsplit("/", 1)[0] for r in found.select(F.col("_metadata.file_path")).distinct().collect()}
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in sorted(folders):
            p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            p.getFileSystem(conf).delete(p, True)


def _parts(store: DataFrame, touched: list, part: str) -> DataFrame:
    """The rows of some partitions, read from their files alone."""
    some = F.col(part).isin([x for x in touched if x is not None])
    return store.where(some | F.col(part).isNull() if None in touched else some)


def upsert_store(spark: SparkSession, path: str, new: DataFrame, key: str = "trajectory_id", version: str = "version", part: str = "domain_type") -> list:
    """Puts ``new`` rows into a stored table: the latest version of each key stays.  Only the partitions are rewritten that
    ``new`` has rows for, or that held one of its keys before; their names are returned (a few: a row each)."""
    old = spark.read.parquet(path)
    old = old.select(*[old[c].cast(new.schema[c].dataType).alias(c) for c in new.columns])
    here = old.join(new.select(key).distinct(), key, "left_semi").select(part)
    touched = [r[0] for r in new.select(part).unionByName(here).distinct().collect()]
    if touched:
        _replace_parts(spark, path, upsert_versions(_parts(old, touched, part), new, key, version).select(*new.columns), touched, part)
    return touched


def delete_from_store(spark: SparkSession, path: str, doomed: DataFrame, key: str, part: str = "domain_type") -> list:
    """Takes rows with ``doomed`` keys out of a stored table, rewriting only the partitions that hold one."""
    rows = spark.read.parquet(path)
    touched = [r[0] for r in rows.join(doomed.select(key), key, "left_semi").select(part).distinct().collect()]
    if touched:
        _replace_parts(spark, path, _parts(rows, touched, part).join(doomed.select(key), key, "left_anti").select(*rows.columns), touched, part)
    return touched


def promoted(df: DataFrame) -> DataFrame:
    """Searchable fields of nested trajectories at top level: domain, start, tags, and the document itself."""
    return df.select("run_id", F.col("agent_id").alias("domain_type"), F.col("metadata.start_time").alias("timestamp_start"), F.col("metadata.tools_used").alias("tags"), F.to_json(F.struct("metadata", "outcome")).alias("data"))


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Name, extension, size and time of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), "modificationTime")


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of ``{"messages": [{role, content}]}`` as (conversation, turn, role, text)."""
    rows = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    return rows.withColumn("conversation", F.xxhash64(F.to_json("messages"))).select("conversation", F.posexplode("messages").alias("turn", "m")).select("conversation", "turn", "m.role", F.col("m.content").alias("text"))


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, JSON or text lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).csv(path)
    return reader.json(path) if kind == "json" else spark.read.text(path)


def spans(decisions: DataFrame) -> DataFrame:
    """Root, turn and decision spans: trace_id, span_id, parent_id, name, attributes."""
    none = F.lit(None).cast("string")
    attributes = F.create_map(F.lit("action"), "action", F.lit("success"), F.col("success").cast("string"))
    root = decisions.groupBy("trajectory_id").agg(F.count("*").alias("n"))
    turn = decisions.groupBy("trajectory_id", "turn_index").agg(F.count("*").alias("n"))
    turn_id = F.concat("trajectory_id", F.lit(":"), F.col("turn_index").cast("string"))
    counted = F.create_map(F.lit("decisions"), F.col("n").cast("string"))
    return (
        root.select(F.col("trajectory_id").alias("trace_id"), F.col("trajectory_id").alias("span_id"), none.alias("parent_id"), F.lit("trajectory").alias("name"), counted.alias("attributes"))
        .unionByName(turn.select(F.col("trajectory_id").alias("trace_id"), turn_id.alias("span_id"), F.col("trajectory_id").alias("parent_id"), F.lit("turn").alias("name"), counted.alias("attributes")))
        .unionByName(decisions.select(F.col("trajectory_id").alias("trace_id"), F.concat(turn_id, F.lit(":"), "decision_id").alias("span_id"), turn_id.alias("parent_id"), F.lit("decision").alias("name"), attributes.alias("attributes")))
    )


def traces(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one nested JSON trace per trajectory, one score row per scored decision)."""
    span = F.struct("decision_index", F.col("decision_id").alias("id"), F.col("action").alias("name"), F.col("response_text").alias("output"))
    generation = decisions.groupBy("trajectory_id", "turn_index").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    trace = generation.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "spans"))).alias("generations"))
    scores = decisions.where("confidence is not null").select(F.col("trajectory_id").alias("trace_id"), "decision_id", F.lit("confidence").alias("name"), F.col("confidence").alias("value"))
    return trace.select("trajectory_id", F.to_json(F.struct("trajectory_id", "generations")).alias("trace"), F.size("generations").alias("n_generations")), scores


def last_user_turns(messages: DataFrame, n: int, key: str = "trajectory_id") -> DataFrame:
    """Messages from the n-th last user message on, and the first system message."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sequence_id")))
    cut = messages.where("role = 'user'").withColumn("r", rank).where(F.col("r") <= n).groupBy(key).agg(F.min("sequence_id").alias("cut"))
    first = messages.where("role = 'system'").groupBy(key).agg(F.min("sequence_id").alias("sys"))
    marked = messages.join(cut, key, "left").join(first, key, "left")
    return marked.where(((F.col("role") != "system") & (F.col("sequence_id") >= F.coalesce("cut", F.lit(0)))) | (F.col("sequence_id") == F.col("sys"))).drop("cut", "sys")


def passage_rule(archive: Column, source: Column) -> Column:
    """A passage belongs to an archive or a source, to exactly one of them."""
    return archive.isNotNull() != source.isNotNull()
