"""Column expressions that several operators share: texts, scores, ids, privacy forms, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a tool response as failed, by profile.
ERROR_WORDS = {
    "full": ("error", "exception", "failed", "failure", "invalid"),
    "adapter": ("error", "exception", "failed", "failure"),
    "short": ("error", "failed", "exception"),
    "router": ("error", "failed", "exception", "traceback"),
}
SEPARATOR = " | "
#: Minimum score of each outcome.
OUTCOME_STEPS = ((0.7, "success"), (0.4, "partial"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_error(text: Column | str, profile: str = "full") -> Column:
    """Does the response contain one of the profile's words (any case)?  Null texts do not."""
    return F.coalesce(F.lower(_col(text)).rlike("|".join(ERROR_WORDS[profile])), F.lit(False))


# Words of a failed response and the error type that the first match names.
ERROR_TYPES = ((("timeout",), "Timeout"), (("validation",), "ValidationError"), (("permission", "auth"), "PermissionError"), (("not found",), "NotFoundError"), (("error", "exception"), "Error"))


def error_type(text: Column | str) -> Column:
    """The type that the first matching words name; else null."""
    low, out = F.lower(_col(text)), F.lit(None).cast("string")
    for words, name in reversed(ERROR_TYPES):
        out = F.when(F.coalesce(low.rlike("|".join(words)), F.lit(False)), name).otherwise(out)
    return out


def summarise_result(text: Column | str, limit: int = 200, dots: bool = True) -> Column:
    """The first ``limit`` characters, with three dots after a cut."""
    t = _col(text)
    cut = F.substring(t, 1, limit)
    return F.when(F.length(t) > limit, F.concat(cut, F.lit("..."))).otherwise(t) if dots else cut


def outcome_of_score(score: Column | str, steps: Sequence[tuple[float, str]] = OUTCOME_STEPS) -> Column:
    """Outcome by score thresholds; a missing score counts as success."""
    s = _col(score)
    out = F.when(s.isNull(), "success")
    for least, name in steps:
        out = out.when(s >= F.lit(float(least)), name)
    return out.otherwise("failure")


def outcome_map(kind: Column | str) -> Column:
    """Stored outcome words to success, partial or failure."""
    k = _col(kind)
    return F.when(k.isin("completed", "success"), "success").when(k.isin("incomplete", "partial_success"), "partial").otherwise("failure")


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between two bounds; null stays null (``least`` alone would skip it)."""
    c = _col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def labelled(parts: Sequence[tuple[str, Column]], separator: str = SEPARATOR) -> Column:
    """``label: value`` of the parts that are not null, joined."""
    return F.concat_ws(separator, *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in parts])


def hash_identifier(value: Column | str, salt: str) -> Column:
    """First 16 hex digits of SHA-256 over salt and id; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _col(value)), 256), 1, 16)


def redacted(value: Column | str, salt: str = "") -> Column:
    """``[REDACTED:`` and eight hex digits."""
    return F.concat(F.lit("[REDACTED:"), F.substring(hash_identifier(value, salt), 1, 8), F.lit("]"))


def first_sentence(text: Column | str, n: int = 100) -> Column:
    """Short texts as they are; else the first sentence of the text if a full stop is among the first ``n`` characters,
    else a cut with three dots."""
    t = _col(text)
    cut = F.substring(t, 1, n)
    return F.when(F.locate(".", cut) > 0, F.concat(F.substring_index(t, ".", 1), F.lit("."))).when(F.length(t) <= n, t).otherwise(F.concat(cut, F.lit("...")))


def token_estimate(text: Column | str, margin: float = 1.0) -> Column:
    """A token for each four UTF-8 bytes, rounded up, times a safety margin."""
    n = F.floor((F.coalesce(F.octet_length(_col(text)), F.lit(0)) + 3) / 4).cast("bigint")
    return n if margin == 1.0 else F.floor(n * F.lit(margin)).cast("bigint")


def slug(text: Column | str, limit: int = 50) -> Column:
    """Lower-cased id: specials dropped, white space and underscores to one dash, cut."""
    s = F.regexp_replace(F.lower(F.trim(_col(text))), r"[^a-z0-9\s_-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), "-+", "-"), 1, limit)


# Names that some systems keep for devices.
DEVICES = ("con", "prn", "aux", "nul", "clock$", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def split_extension(name: Column) -> tuple[Column, Column]:
    """A file name's base and extension (from its last dot; leading dots begin none)."""
    ext = F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def sanitise_file_name(name: Column | str, limit: int = 255) -> Column:
    """The last path part of a name without control and reserved characters or trailing blanks and dots in its base, an
    underscore after a device's name, the base cut so that all fits ``limit``; null if the base begins with a dot."""
    base, ext = split_extension(F.regexp_replace(_col(name), r"^.*/", ""))
    clean = F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f\x7f/\\:*?"<>|]', ""), r"[ .]+$", "")
    free = F.when(F.lower(clean).isin(*DEVICES), F.concat(clean, F.lit("_"))).otherwise(clean)
    return F.when(~clean.startswith("."), F.concat(F.substring(free, F.lit(1), F.lit(limit) - F.length(ext)), ext))


def time_ago(then: Column | str, now: Column) -> Column:
    """``5m`` style distance: seconds, minutes, hours or days."""
    s = (now.cast("timestamp").cast("bigint") - _col(then).cast("timestamp").cast("bigint")).cast("bigint")
    unit = lambda by, u: F.concat(F.floor(s / by).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def indexed_id(base: Column | str, index: Column) -> Column:
    """A derived id: the last two hex digits of ``base`` with the low seven bits replaced by ``index``."""
    b = _col(base)
    last = F.conv(F.substring(b, -2, 2), 16, 10).cast("int")
    low = F.lower(F.lpad(F.hex(last.bitwiseAND(F.lit(128)).bitwiseOR(index.cast("int").bitwiseAND(F.lit(127))).cast("bigint")), 2, "0"))
    return F.concat(F.substring(b, F.lit(1), F.length(b) - 2), low)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, over the shorter length."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    a = _col(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def bucket_of(value: Column | str, marks: Sequence) -> Column:
    """How many of the sorted constants ``marks`` are below the value, by binary search."""
    if not len(marks):
        return F.lit(0)
    v, n = _col(value), len(marks)
    constants = F.array(*[F.lit(m) for m in marks])
    steps = [1 << s for s in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, by: F.when((at + by <= n) & (F.get(constants, at + by - 1) < v), at + by).otherwise(at))
