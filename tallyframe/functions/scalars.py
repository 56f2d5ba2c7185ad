"""Scalar expressions over ledger columns. Everything here stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMOUNT_BIN_EDGES, CONFLICT_TOLERANCE_SECONDS

# ---- fixed values -------------------------------------------------------------------
# White space as statement scripts see it (includes the no-break space of Nordic amounts,
# which plain Java `\s` does not).
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NUMERIC_PREFIX = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
ISO_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"
DEFAULT_FEATURE_DATE = "2024-01-01"


# ---- dates and times ----------------------------------------------------------------
def strict_date(d: Column) -> Column:
    """`YYYY-MM-DD` text as a date, NULL for any other shape or an impossible day."""
    return F.when(F.length(d) == 10, d.try_cast("date"))


def month_of(d: Column) -> Column:
    """`YYYY-MM` of an ISO date or date-time; NULL when it is not one.

    The usual ten-character date is a plain substring. Only other texts take the slow
    branch, where a day past the end of its month rolls over into the next month.
    """
    first = F.concat(F.substring(d, 1, 7), F.lit("-01")).try_cast("date")
    day = F.substring(d, 9, 2).try_cast("int")
    odd = F.when(
        d.rlike(DATE_SHAPE) & day.between(1, 31),
        F.date_format(F.date_add(first, day - 1), "yyyy-MM"),
    )
    return F.coalesce(F.when(strict_date(d).isNotNull(), F.substring(d, 1, 7)), odd)


def iso_epoch(ts: Column) -> Column:
    """Seconds since 1970 of a strict `YYYY-MM-DDTHH:MM:SSZ` text, else NULL."""
    return F.when(ts.rlike(ISO_SECONDS), F.unix_timestamp(ts.try_cast("timestamp")))


def within_tolerance(a: Column, b: Column, seconds: int = CONFLICT_TOLERANCE_SECONDS) -> Column:
    """Both timestamps valid and at most `seconds` apart, the limit included."""
    return F.coalesce(F.abs(iso_epoch(a) - iso_epoch(b)) <= seconds, F.lit(False))


def date_or_default(d: Column) -> Column:
    """The date, else the date in the first ten characters, else a fixed default."""
    return F.coalesce(
        strict_date(d), strict_date(F.substring(d, 1, 10)), F.lit(DEFAULT_FEATURE_DATE).cast("date")
    )


# ---- money and text -----------------------------------------------------------------
def money_text(minor: Column) -> Column:
    """Two-decimal text of a minor-unit amount, by exact decimal arithmetic."""
    return (minor.cast("decimal(19,0)") / F.lit(100)).cast("decimal(21,2)").cast("string")


def to_major(minor: Column) -> Column:
    return minor / F.lit(100.0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


def clean_text(text: Column) -> Column:
    """Merchant part of a statement text: before the first slash, trimmed, lower case."""
    return F.lower(F.trim(F.substring_index(text, "/", 1)))


def first_filled(*options: Column) -> Column:
    """First option that is neither NULL nor empty; an empty text when there is none."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def is_filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def parse_minor(text: Column, exact: bool = False) -> Column:
    """Statement number to minor units: white space dropped, first comma read as a point,
    leading numeric part taken, multiplied by 100 and truncated toward zero.

    The default multiplies in binary floating point, so `19.99` gives 1998, the way the
    statements were always booked; `exact` multiplies in decimal. NULL if not a number.
    """
    packed = F.regexp_replace(text, SPACE, "")
    dotted = F.regexp_replace(packed, r"^([^,]*),", "$1.")
    prefix = F.regexp_extract(dotted, NUMERIC_PREFIX, 0)
    if exact:
        return (prefix.try_cast("decimal(38,12)") * F.lit(100)).try_cast("bigint")
    return (prefix.try_cast("double") * F.lit(100.0)).try_cast("bigint")


def content_id(value_date: Column, reference: Column, text: Column, amount: Column,
               balance: Column) -> Column:
    """Content hash that makes a repeated upload of the same row a duplicate."""
    return F.md5(F.concat(value_date, reference, text, amount.cast("string"), balance.cast("string")))


# ---- keys and comparison ------------------------------------------------------------
def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def key_head(row_id: Column) -> Column:
    return F.substring_index(row_id, ":", 1)


def key_tail(row_id: Column) -> Column:
    """Everything after the first colon."""
    return F.substr(row_id, F.instr(row_id, ":") + F.lit(1))


def differs(a: Column, b: Column) -> Column:
    """Inequality where NULL equals NULL."""
    return ~a.eqNullSafe(b)


# ---- model features -----------------------------------------------------------------
def amount_base(minor: Column) -> Column:
    """Amount in major units, in single precision as the classifier was trained."""
    return (minor.cast("float") / F.lit(100.0)).cast("float")


def amount_bin(base: Column) -> Column:
    """Index of the first edge above the amount; the number of edges when there is none."""
    edges = F.array(*[F.lit(e).cast("float") for e in AMOUNT_BIN_EDGES])
    return F.size(F.filter(edges, lambda e: base >= e))


def signed_log(base: Column) -> Column:
    magnitude = F.log((F.abs(base) + F.lit(1.0).cast("float")).cast("float"))
    return (F.when(base >= 0, magnitude).otherwise(-magnitude)).cast("float")


def one_hot(position: Column, size: int, start: int = 0) -> Column:
    """`size` floats with a one where the running index equals `position`.

    Written out element by element: the shared `position` is then computed once per row,
    which the body of a lambda would repeat for every element.
    """
    return F.array(*[(position == i).cast("float") for i in range(start, start + size)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once for use inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_pool(tokens: Column, mask: Column, size: int) -> Column:
    """Mean of the token vectors whose mask is 1, scaled to unit length."""
    zero = F.array_repeat(F.lit(0.0), size)
    pairs = F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, F.transform(t, lambda x: x.cast("double"))))
    kept = F.filter(pairs, lambda v: v.isNotNull())
    count = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    mean = let(count, lambda n: F.transform(total, lambda x: x / n))
    return let(mean, lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)),
        lambda norm: F.transform(v, lambda x: x / norm)))


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log probability of `label`, shifted by the maximum for stability."""
    return let(F.array_max(logits), lambda top: F.get(logits, label) - top - F.log(
        F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))


def argmax_last(scores: Column) -> Column:
    """Index of the largest score; the last one among equals."""
    top = F.array_max(scores)
    return F.size(scores) - F.array_position(F.reverse(scores), top).cast("int")
