"""Shared helpers: table reading, shared-folder spooling, and per-row Arrow jobs that keep every input row.

Names: operators put what they compute in ONE new struct column whose name is free in the input, so an extra
input column that happens to be called ``score`` or ``n_words`` can never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Largest Arrow batch sent to a Python worker, and the text bytes that one numpy step looks at.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Powers are kept for texts of up to so many bytes; those of a longer text are made for it alone.
KEPT_POWERS = 2 * SLICE_BYTES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` under ``sf_dir`` (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, from the session (``spark.checkpoint.dir``).

    Only on one machine, as in tests, a fresh temporary folder stands in where that is unset; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def spool(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors and gives
    the optimiser true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (ignoring case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long documents (only ever lowers the session's limit)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) < 0 or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each, one row at least (of lists: one row)."""
    n = len(column)
    if not n:
        return
    if pa.types.is_nested(column.type):
        yield from ((i, i + 1) for i in range(n))
        return
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float))
    ends = np.cumsum(sizes + 1)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0.0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def annotate(
    docs: DataFrame,
    inputs: Sequence[str],
    ddl: str,
    make: Callable[..., dict[str, Sequence]],
    name: str,
    keep: Sequence[str] | None = None,
    start: Callable[[], object] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Each row's ``keep`` columns (all by default) and a struct ``name`` that ``make`` computes from ``inputs``.

    ``make(state, *columns)`` gets Arrow arrays of a slice of rows (sliced by the bytes of the first one) and returns
    one sequence per field of ``ddl``.  ``state`` is ``start()``, made once per task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = list(docs.columns if keep is None else keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.StructType.fromDDL(ddl))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    fields = list(arrow.field(len(keep)).type)
    n_keep = len(keep)
    # inputs are carried under private names, so that any clash between kept and read columns is harmless
    carried = docs.select(*[docs[c] for c in keep], *[docs[c].alias(f"__in{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            kept, read_ = batch.columns[:n_keep], batch.columns[n_keep:]
            for lo, hi in slices(read_[0], slice_bytes):
                got = make(state, *[c.slice(lo, hi - lo) for c in read_])
                made = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=True) for f in fields], fields=fields)
                cols = [c.slice(lo, hi - lo).cast(arrow.field(i).type) for i, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays([*cols, made], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers stay for the next task or stage

    return carried.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array and each row's first offset in it (n + 1 of them); null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        wide = np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply), for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row, as maximal runs of bytes with ``is_word`` set: start and end in ``raw``, and words per row.

    ``is_word`` is a table of 256 flags.  All bytes of a non-ASCII character must share one flag.
    """
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = is_word[raw]
    step = np.diff(inside)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word that would run over the end of a row
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    if len(cuts):
        cuts = np.unique(cuts)
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.diff(np.searchsorted(starts, offsets, side="left"))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in an odd base modulo 2**64, mixed with the length.

    Prefix sums of byte * base**i give every span's polynomial at once; the base's inverse moves it to i = 0.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = len(raw)
    power = powers(base, n)
    back = powers(inverse, n)
    prefix = np.zeros(n + 1, np.uint64)
    np.take(_BYTE_VALUES, raw, out=prefix[1:])
    prefix[1:] *= power[:n]
    np.cumsum(prefix, out=prefix)
    h = (prefix[ends] - prefix[starts]) * back[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_POWERS: dict[int, np.ndarray] = {}
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the longest so far, up to a bound, is kept for the worker's next slices."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        full = np.full(n + 1, base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have[: n + 1]


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: digits, a-z, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, dtype=np.int8)
WORD_BYTES[48:58] = 1
WORD_BYTES[97:123] = 1
WORD_BYTES[128:] = 1

#: `[^\x20\x09-\x0D]`
NONSPACE_BYTES = np.ones(256, dtype=np.int8)
NONSPACE_BYTES[32] = 0
NONSPACE_BYTES[9:14] = 0
