"""Structured Streaming jobs, each over a Parquet stream source, drained with ``availableNow``.

A job has a ``home``, a folder that driver and executors share: its log of offsets and state, a folder for each batch, and
a manifest that names the batches that are whole.  A batch that is run again, because the job died after writing it,
overwrites its own folder, so no row is ever there twice; a job that is started again with the same home goes on where it
stopped.  Tables that change are written in update mode, only what changed in a batch, and read by key, the last batch's row
of each; so a watermark can drop state.
"""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.capture import build_trajectories
from ..operators.search import BROADCAST_ROWS

#: Finished runs.
TERMINAL = ("completed", "failed", "cancelled")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only on one machine: a cluster must name a shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def source(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A Parquet file or folder as a stream of at most so many ``files`` a batch; event times get the type that watermarks
    need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else stream


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def new_home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def batch_path(home: str, i: int) -> str:
    return f"{home}/batches/{i}"


def write_batch(batch: DataFrame, i: int, home: str) -> None:
    """A batch's rows into its own folder, replacing what an earlier try left there."""
    batch.write.mode("overwrite").parquet(batch_path(home, i))


def commit(spark: SparkSession, i: int, home: str) -> None:
    """The manifest names batch ``i``: from now on it is read."""
    spark.createDataFrame([(i,)], "batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest/{i}")


def committed(spark: SparkSession, home: str) -> list[int]:
    """The batches that the manifest names (one small row each)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{home}/manifest")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return []
    return sorted(r.batch for r in spark.read.schema("batch bigint").parquet(f"{home}/manifest/*").collect())


def table(spark: SparkSession, home: str, schema: T.StructType, numbered: str | None = None) -> DataFrame:
    """The rows of all committed batches; ``numbered`` names a column with each row's batch."""
    parts = [batch_path(home, i) for i in committed(spark, home)]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    if numbered:
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("bigint") if parts else F.lit(None).cast("bigint")
        rows = rows.select("*", at.alias(numbered))
    return rows


def run_all(stream: DataFrame, mode: str, home: str, write: Callable[[DataFrame, int, str], None] = write_batch, seen: list | None = None) -> None:
    """Runs a stream over all available input: each batch is written by ``write`` (batch, number, home), then committed.
    ``seen`` gets the progress of every batch."""
    spark = stream.sparkSession

    def each(batch: DataFrame, i: int) -> None:
        write(batch, i, home)
        commit(spark, i, home)

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).foreachBatch(each).start()
    job.awaitTermination()
    if seen is not None:
        seen += job.recentProgress


def drain(stream: DataFrame, mode: str, home: str | None = None, seen: list | None = None) -> DataFrame:
    """Runs a stream over all available input into the table of ``home`` (a new one by default), and reads that."""
    home = home or new_home(stream.sparkSession)
    run_all(stream, mode, home, seen=seen)
    return table(stream.sparkSession, home, stream.schema)


def live(stream: DataFrame, key: list[str], home: str | None = None, seen: list | None = None) -> DataFrame:
    """Runs a stream in update mode into a live table: the last row of each key."""
    spark, home = stream.sparkSession, home or new_home(stream.sparkSession)
    run_all(stream, "update", home, seen=seen)
    rows = table(spark, home, stream.schema, numbered="__batch")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "__batch").alias("__last")).select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def capture_stream(updates: DataFrame, steps: DataFrame, messages: DataFrame, home: str | None = None) -> DataFrame:
    """Nested trajectories of the runs that have ended, captured as their updates arrive.

    ``updates`` is a stream of run_id, agent_id, status, stop_reason, created_at, completed_at and ``at``; ``steps`` and
    ``messages`` are tables (see ``build_trajectories``), of which a batch reads what its runs need.  A run that is updated again is
    captured again: its newest update counts, in whatever batch it came.
    """
    spark, home = updates.sparkSession, home or new_home(updates.sparkSession)
    columns = updates.columns

    def write(batch: DataFrame, i: int, home: str) -> None:
        newest = batch.groupBy("run_id").agg(F.max_by(F.struct(*columns), "at").alias("u")).select("u.*")
        newest.write.mode("overwrite").parquet(f"{home}/runs/{i}")
        runs = spark.read.schema(updates.schema).parquet(f"{home}/runs/{i}")
        few = runs.count() <= BROADCAST_ROWS  # else it costs less to deal all rows once than to deal them to find the batch's own
        mine = lambda rows: rows.join(F.broadcast(runs.select("run_id")), "run_id", "left_semi") if few else rows
        write_batch(build_trajectories(runs, mine(steps), mine(messages), keep=["at"]), i, home)

    run_all(updates.where(F.col("status").isin(*TERMINAL)), "append", home, write)
    shape = build_trajectories(spark.createDataFrame([], updates.schema), steps, messages, keep=["at"]).schema
    rows = table(spark, home, shape, numbered="__batch")
    # a column each, so that a reader of some columns reads and shuffles no other one; a batch has one row a run
    return rows.groupBy("run_id").agg(*[F.max_by(c, F.struct("at", "__batch")).alias(c) for c in ("agent_id", "metadata", "turns", "outcome")])


def ingest_once(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    """Events that may arrive again within the watermark, kept once by id."""
    twice = source(spark, path).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(twice.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]), "append", home)


# Fixed value: how a record says that it gave up.
GAVE_UP = "Failed after %d retries: %s"


def status_machine(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """A stream of attempts (id, seq, error: null if it went well) as status rows (id, seq, status, attempts, error).

    A record is pending until its first attempt, then processing; a good attempt completes it; a failed one is tried again up
    to ``retries`` times, after which the record has failed and keeps the last error.  Completed and failed are final:
    later attempts are ignored.
    """
    schema = T.StructType([attempts.schema["id"], T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, tries = state.get if state.exists else ("pending", 0)
        out = []
        for seq, error in sorted((int(s), e) for b in batches for s, e in zip(b["seq"], b["error"], strict=True)):
            if status in ("completed", "failed"):
                break
            tries += 1
            bad = isinstance(error, str)
            status = "completed" if not bad else "failed" if tries > retries else "processing"
            out.append((key[0], seq, status, tries, GAVE_UP % (retries, error) if status == "failed" else None))
        state.update((status, tries))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    return attempts.groupBy("id").applyInPandasWithState(step, schema, "status string, attempts int", "append", GroupStateTimeout.NoTimeout)


def latest(rows: DataFrame) -> DataFrame:
    """The last status row of each id."""
    return rows.groupBy("id").agg(F.max_by(F.struct("status", "attempts", "error"), "seq").alias("s")).select("id", "s.*")


def status_stream(spark: SparkSession, path: str, retries: int = 3) -> DataFrame:
    """Status of every user's processing: each event is an attempt, which fails if its value is high."""
    error = F.when(F.col("value") >= 20, F.concat("event_type", F.lit(" failed")))
    attempts = source(spark, path).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), error.alias("error"))
    return latest(drain(status_machine(attempts, retries), "append")).withColumnRenamed("id", "user_id")


def daily_stream(events: DataFrame, late: str = "2 days", home: str | None = None, seen: list | None = None) -> DataFrame:
    """Daily counts and mean values as a live table of a stream (ts, value).  Days that ended more than ``late`` before the
    newest event are final: their state is dropped, and so is what comes for them."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.avg("value").alias("avg_score"))
    return live(days.select(F.to_date("window.start").alias("day"), "n", "avg_score"), ["day"], home, seen)


def latency_stream(events: DataFrame, late: str = "1 day", home: str | None = None, seen: list | None = None) -> DataFrame:
    """Counts per type and six-hour window as a live table of a stream (event_type, ts)."""
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return live(w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), ["event_type", "start"], home, seen)


# Kinds of chunks that end a run.
LAST_CHUNKS = ("complete", "error")


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (run, seq, kind, body), in any order and with repeats, as (run, seq, kind, body, complete): each
    chunk once, a run's chunks in order from 1, none after its end marker; what comes early waits in the run's state."""
    schema = T.StructType([chunks.schema["run"], T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("body", T.StringType()), T.StructField("complete", T.BooleanType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        upto, ended, early = state.get if state.exists else (0, False, [])
        waiting = {int(s): (k, b) for s, k, b in early}
        for b in batches:
            for s, k, body in zip(b["seq"], b["kind"], b["body"], strict=True):
                if s > upto:
                    waiting.setdefault(int(s), (k, body))
        out = []
        while not ended and upto + 1 in waiting:
            upto += 1
            kind, body = waiting.pop(upto)
            ended = kind in LAST_CHUNKS
            out.append((key[0], upto, kind, body, ended))
        state.update((upto, ended, [] if ended else [(s, k, body) for s, (k, body) in sorted(waiting.items())]))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    return chunks.groupBy("run").applyInPandasWithState(step, schema, "upto bigint, ended boolean, early array<struct<seq:bigint,kind:string,body:string>>", "append", GroupStateTimeout.NoTimeout)


def replay(chunks: DataFrame, after: int = 0) -> DataFrame:
    """The chunks of each run after a sequence number, in order."""
    return chunks.where(F.col("seq") > after).orderBy("run", "seq")


def chunk_stream(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Every user's events as a run of chunks, a purchase as its end, replayed from after a sequence number.

    Chunks are numbered by the table that they come from, and every one arrives twice.
    """
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = spark.read.parquet(path).select(F.col("user_id").alias("run"), n.cast("bigint").alias("seq"), F.when(F.col("event_type") == "purchase", "complete").otherwise("delta").alias("kind"), F.col("event_id").cast("string").alias("body"))
    home = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).orderBy(F.xxhash64("body", "again")).drop("again").write.option("maxRecordsPerFile", max(1, rows.count() // 3)).parquet(home)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(home)
    return replay(drain(ordered_chunks(stream), "append"), after)


def latest_status(spark: SparkSession, path: str, home: str | None = None) -> DataFrame:
    """The latest polled status of each batch."""
    polls = source(spark, path).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))
    return live(polls, ["user_id"], home)


# From which statuses a file may come to each; the final ones; what a file that stopped moving is told.
STEPS = {"parsing": ("pending", "parsing"), "embedding": ("parsing", "embedding"), "completed": ("embedding", "completed"), "error": ("pending", "parsing", "embedding")}
FINAL = ("completed", "error")
TIMED_OUT = "Processing timed out"


def asked_for(file: tuple, events: list[tuple], wait: int) -> tuple:
    """A file (status, error, refused, last) after events (ms, id, asked) in order."""
    status, error, refused, last = file
    for ms, _, asked in events:
        if status not in FINAL and last and ms - last > wait:
            status, error = "error", TIMED_OUT
        if status in STEPS[asked] and not (status in FINAL and asked != status):
            status, error = asked, "asked to fail" if asked == "error" else None
        else:
            refused += 1
        last = max(last, ms)
    return status, error, refused, last


def _news(group: int | None, batches: Iterator[pd.DataFrame]) -> dict:
    """The requests (ms, id, asked) of each file of a group; files without a name are a group of their own."""
    news: dict = {}
    for b in batches:
        ids = [None] * len(b) if pd.isna(group) else b["id"].tolist()
        for i, *row in zip(ids, b["ms"].astype("int64").tolist(), b["event_id"].astype("int64").tolist(), b["asked"].tolist(), strict=True):
            news.setdefault(i, []).append(tuple(row))
    return news


# Fixed value: how many groups files are dealt into.  A job that is started again must use the number that it began with.
FILE_GROUPS = 1024


def file_machine(events: DataFrame, minutes: int = 30, late: str = "1 hour", groups: int = FILE_GROUPS) -> DataFrame:
    """A stream of requests (id, event_id, ts, asked) as rows (id, status, error, refused, step), the last step of each id
    being its present state.

    Each file begins as pending; a request is refused unless its step is legal; a file that is not final and hears nothing for
    ``minutes`` of event time ends in error.  Requests count in order of event time, whatever batch they come in: those newer
    than the watermark, which trails the newest event by ``late``, wait in the file's state, and what is told of it meanwhile
    is provisional.  Of what is later than that, Spark drops what the watermark of the batch before had already passed; the rest
    counts when it comes.

    Files are dealt by a hash of their id into ``groups``, whose state has a list for each field, so that a batch calls Python
    once a group and not once a file; a group is called for if one of its files has news or is due.
    """
    wait = minutes * 60_000
    names = ["id", "status", "error", "refused", "step"]
    named = events.schema["id"].dataType
    schema = T.StructType([T.StructField("id", named), *T.StructType.fromDDL("status string, error string, refused bigint, step bigint").fields])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, files = state.getCurrentWatermarkMs(), {}
        if state.exists:
            *kept, counts, ms, event_ids, asked = state.get
            waiting = zip(ms, event_ids, asked, strict=True)
            files = {i: (tuple(file), told, list(islice(waiting, n))) for i, *file, told, n in zip(*kept, counts, strict=True)}
        news = _news(key[0], batches)
        due = lambda file, rest: rest[0][0] if rest else file[3] + wait if file[3] and file[0] not in FINAL else None
        timers = {i: due(file, rest) for i, (file, _, rest) in files.items()}
        out = []
        for i in [*news, *[i for i, at in timers.items() if at is not None and at < now and i not in news]]:
            file, told, rest = files.get(i, (("pending", None, 0, 0), 0, []))
            rows = sorted(rest + news.get(i, []))
            n = bisect_right(rows, now, key=lambda r: r[0])
            file, rest = asked_for(file, rows[:n], wait), rows[n:]
            status, error, refused, last = file
            if status not in FINAL and last and last + wait < now:  # all that is left is newer still
                file = "error", TIMED_OUT, refused, last
            files[i], timers[i] = (file, told + 1, rest), due(file, rest)
            status, error, refused, _ = asked_for(file, rest, wait)
            out.append((i, status, error, refused, told + 1))
        rest = [r for _, _, rows in files.values() for r in rows]
        kept = [(i, *file, told, len(rows)) for i, (file, told, rows) in files.items()]
        state.update((*map(list, zip(*kept, strict=True)), *([r[k] for r in rest] for k in range(3))))
        ahead = [at for at in timers.values() if at is not None]
        if ahead:
            state.setTimeoutTimestamp(max(min(ahead), now + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    group = F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(groups))).alias("group")
    rows = events.withWatermark("ts", late).select(group, "id", "event_id", "ts", F.unix_millis("ts").alias("ms"), "asked")
    lists = "status array<string>, error array<string>, refused array<bigint>, last array<bigint>, told array<bigint>, n array<bigint>, ms array<bigint>, event_id array<bigint>, asked array<string>"
    held = T.StructType([T.StructField("id", T.ArrayType(named)), *T.StructType.fromDDL(lists).fields])
    return rows.groupBy("group").applyInPandasWithState(step, schema, held, "update", GroupStateTimeout.EventTimeTimeout)


def file_stream(spark: SparkSession, path: str, minutes: int = 30, late: str = "1 hour", home: str | None = None) -> DataFrame:
    """Every user as a file: each event asks for a status, by its type.  Gives status, error and refused requests."""
    kind = F.col("event_type")
    asked = F.when(kind == "view", "parsing").when(kind == "click", "embedding").when(kind == "purchase", "completed").when(F.col("value") > 100, "error").otherwise("parsing")
    events = source(spark, path).select(F.col("user_id").alias("id"), "event_id", "ts", asked.alias("asked"))
    done = drain(file_machine(events, minutes, late), "update", home)
    return done.groupBy(F.col("id").alias("user_id")).agg(F.max_by(F.struct("status", "error", "refused"), "step").alias("s")).select("user_id", "s.*")
