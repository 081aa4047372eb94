"""Best-fit packing of tokenised documents into sequences of a fixed length, repacked as far as bounds leave room.

A document's ids and a final 0 are one item; only longer ones are cut, into whole sequences and a rest.  Items are dealt to
partitions by a hash of their place, so hot sources and copies spread; a task packs one partition best-fit decreasing.  How
few sequences a partition can have is bounded from below by dual-feasible functions of its lengths: a function f with
sum f(x) <= 1 over whatever fits one sequence makes sum f over all items a bound.  Where the number reached is that bound, it is
certified; all partitions together are held to the bound of all lengths.  While the two differ, the partitions with gaps
exchange documents: what lies in their unfilled sequences is dealt anew, to fewer partitions, and packed again, and that
stands if it saves sequences.  Rounds end when certified, or when one saves nothing.

Tokens are made once, where the texts are; only lengths and places are shuffled.  The tokenizer drops white space and its
pattern never crosses it, so a chunk between white space always has the same ids: a worker keeps those of the chunks it met,
in bounded memory, and those of their words, and asks the tokenizer's model for new words only.  A text that holds a special token goes to it whole.

Defined results: a null or empty text is the single id 0; a null or repeated id and repeated rows are documents like
any others; an empty table has no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, fresh, read, spool

LENGTH = 2048
#: Items of a partition, on average (each round of exchanges doubles it), and rounds of exchanges at most.
PART_ITEMS, EXCHANGES = 100_000, 4
#: Functions of the second family that bounds are taken from.
FUNCTIONS = 100
#: Bytes of chunks, and of words, with their ids that a worker keeps, text bytes that are cut into chunks at a time, and the
#: longest chunk that is looked at word by word.
KEPT_BYTES, SEGMENT, LONG = 80 << 20, 1 << 20, 10_000

# The tokenizer's pattern for chunks of printable ASCII and the letters from U+00C0 to U+017F, in lower case.  Those
# letters have no other normal form, and all but U+0130 have a lower case among themselves.
LATIN = "\u00df-\u00f6\u00f8-\u017f"
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+")
SPACE = re.compile(rb"[ \t-\r]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


# ---------------------------------------------------------------------------------------------------- tokens
class Kept(dict):
    """Values made when first asked for; ``bytes`` is about what they take."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.bytes = make, 0

    def __missing__(self, key):
        value = self[key] = self.make(key)
        self.bytes += len(key) + len(value) + 150
        return value

    def bound(self) -> None:
        if self.bytes > KEPT_BYTES:
            self.clear()
            self.bytes = 0


class Encoder:
    """Ids of texts, as little-endian 32-bit words, with those of chunks and words remembered."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.merge = self.tokenizer.model.tokenize
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.words, self.chunks = Kept(self.word), Kept(self.chunk)

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of what the pattern found: the model alone merges its bytes."""
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(shown)])

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk without white space."""
        text = chunk.decode()
        if len(text) > LONG or not PLAIN.fullmatch(text):
            return self.whole(chunk)
        found = PLAIN_WORDS.findall(text.lower())
        return self.words[found[0]] if len(found) == 1 else b"".join([self.words[w] for w in found])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids."""
        return [self.whole(t) if any(m in t for m in self.marks) else self.plain(t) for t in texts]

    def plain(self, text: bytes) -> bytes:
        """Ids of a text without special tokens, cut at white space into segments, and these into chunks."""
        out, lo = [], 0
        while lo < len(text):
            end = SPACE.search(text, min(lo + SEGMENT, len(text)))
            hi = end.start() if end else len(text)
            self.words.bound(), self.chunks.bound()
            out.append(b"".join(map(self.chunks.__getitem__, text[lo:hi].split())))
            lo = hi
        return b"".join(out)


_ENCODERS: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's encoder for a tokenizer file's text: it outlives a task."""
    key = zlib.crc32(model.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def cut_up(coder: Encoder, texts: pa.Array, length: int, with_ids: bool) -> dict[str, list]:
    """Lengths, checksums and, if asked for, ids of each text's pieces."""
    lengths, sums, ids = [], [], []
    for got in coder.encode([t or b"" for t in texts.cast(pa.binary()).to_pylist()]):
        whole = memoryview(got + b"\0\0\0\0")
        at = range(0, len(whole), 4 * length)
        lengths.append([min(4 * length, len(whole) - a) // 4 for a in at])
        sums.append([zlib.crc32(whole[a : a + 4 * length]) for a in at])
        if with_ids:
            ids.append([bytes(whole[a : a + 4 * length]) for a in at])
    return {"lengths": lengths, "sums": sums, "ids": ids}


def pieces(docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] = (), length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: kept (a struct), row (a number of the document), piece, start, length, ids_crc32 and,
    if asked for, ids (little-endian 32-bit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a tokenizer's file
    rows = docs.select(F.struct(F.lit(0).alias(fresh(docs, "_")), *keep).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    ddl = "lengths array<int>, sums array<bigint>" + (", ids array<binary>" if with_ids else "")
    made = annotate(rows, ["text"], ddl, lambda coder, t: cut_up(coder, t, length, with_ids), "t", keep=["kept", "row"], start=lambda: encoder(shared.value))
    both = F.arrays_zip("t.lengths", "t.sums", *(["t.ids"] if with_ids else []))
    out = made.select("kept", "row", F.posexplode(both).alias("piece", "z"))
    columns = ["kept", "row", "piece", (F.col("piece") * F.lit(length).cast("bigint")).alias("start"), F.col("z.lengths").cast("bigint").alias("length"), F.col("z.sums").alias("ids_crc32")]
    return out.select(*columns, *([F.col("z.ids").alias("ids")] if with_ids else []))


# ---------------------------------------------------------------------------------------------------- packing
def lower_bound(counts: np.ndarray) -> int:
    """Fewest sequences that items can have, by dual-feasible functions; ``counts[x]`` items have length x, and the last
    index is a sequence's length."""
    c = len(counts) - 1
    x = np.arange(c + 1)
    total = np.cumsum(counts * x)
    many = np.cumsum(counts)
    bound = -(-int(total[-1]) // c)
    # items above c - k count as whole sequences, those below k not at all
    k = np.arange(1, c // 2 + 1)
    whole = (many[-1] - many[c - k]) * c + total[c - k] - total[k - 1]
    bound = max(bound, -(-int(whole.max(initial=0)) // c))
    # shares are rounded down to multiples of 1/k, but for multiples of 1/(k+1), which stay
    for n in range(1, FUNCTIONS + 1):
        f = np.where((n + 1) * x % c == 0, n * x, (n + 1) * x // c * c)
        bound = max(bound, -(-int((counts * f).sum()) // (n * c)))
    return bound


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's sequence and its offset there, and how much each sequence has left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    with_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: some sequence has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_left[room].pop()
            if not with_left[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        if room > n:
            with_left[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, np.array(left, np.int64)


PLACED = "row bigint, piece int, length bigint, sequence_id bigint, offset bigint, free bigint, gap boolean"


def pack_part(table: pa.Table, capacity: int, turn: int) -> pa.Table:
    """One partition's items packed; ``gap`` marks what it offers for exchange: its unfilled sequences, if it is not
    certified or they leave as much room as a sequence has; else its emptiest one, which its bound rounds up."""
    table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
    lengths = table["length"].to_numpy()
    bins, offsets, left = best_fit(lengths, capacity)
    certified = len(left) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
    base = (turn << 58) + (table["part"][0].as_py() << 22)
    free = left[bins]
    gap = free > 0 if not certified or left.sum() >= capacity else free == max(1, left.max(initial=0))
    made = [table["row"], table["piece"].cast(pa.int32()), table["length"], pa.array(base + bins), pa.array(offsets), pa.array(free), pa.array(gap)]
    return pa.table(made, names=["row", "piece", "length", "sequence_id", "offset", "free", "gap"])


def deal(items: DataFrame, total: int, capacity: int, turn: int, part_items: int) -> DataFrame:
    """Items (row, piece, length) dealt to partitions of about ``part_items`` and packed there."""
    parts = -(-max(1, total) // part_items)
    part = F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(parts)).alias("part")
    return items.select("row", "piece", "length", part).groupBy("part").applyInArrow(lambda t: pack_part(t, capacity, turn), PLACED)


def place(items: DataFrame, capacity: int = LENGTH, part_items: int = PART_ITEMS) -> DataFrame:
    """row, piece, sequence_id, offset of all items (row, piece, length)."""
    # one row for each length: at most `capacity` of them
    found = items.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[found["length"].to_numpy()] = found["n"].to_numpy()
    total, bound = int(counts.sum()), lower_bound(counts)
    placed = spool(deal(items, total, capacity, 0, part_items), "packed")
    for turn in range(1, EXCHANGES + 1):
        used = placed.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
        if used <= bound:
            break
        pool = placed.where("gap")
        n, old = pool.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if old < 2:
            break
        again = spool(deal(pool, n, capacity, turn, part_items << turn), "packed")
        if again.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0] >= old:
            break
        placed = spool(placed.where("not gap").unionByName(again), "packed")
    return placed.select("row", "piece", "sequence_id", "offset")


def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer's file, read by the driver; by default the public word tokenizer's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: Sequence[str] | None = None, length: int = LENGTH, part_items: int = PART_ITEMS, with_ids: bool = True, name: str = "packed") -> DataFrame:
    """A row for each piece: ``keep`` columns (by default all but the text) and a struct ``name`` of piece, start, length,
    ids_crc32, sequence_id, offset and ids (little-endian 32-bit).  Underscores are added if ``name`` is taken."""
    keep, name = [c for c in docs.columns if c != text] if keep is None else list(keep), fresh(docs, name)
    cut = spool(pieces(docs, tokenizer_text(tokenizer), text, keep, length, with_ids), "pieces")
    seats = place(cut.select("row", "piece", "length"), length, part_items)
    joined = cut.join(seats.hint("merge"), ["row", "piece"])
    fields = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return joined.select(*[F.col("kept")[c].alias(c) for c in keep], F.struct(*fields).alias(name))


def sequences(packed: DataFrame, name: str = "packed") -> DataFrame:
    """sequence_id, length and ids of the finished sequences of ``pack`` (with ids)."""
    item = F.struct(f"{name}.offset", f"{name}.ids")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["ids"])
    return packed.groupBy(F.col(f"{name}.sequence_id").alias("sequence_id")).agg(F.sum(f"{name}.length").alias("length"), F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """Registered query: all documents, in sequences of 2048 tokens."""
    docs = read(spark, sf_dir, "documents")
    found = pack(docs, keep=["doc_id"], with_ids=False, name="p")
    return found.select("doc_id", *[f"p.{c}" for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
