"""Numbers and flags out of whatever a model or a header says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Words that count as true (fixed values).
TRUE_WORDS = ("true", "yes", "1", "是", "有")


def fixed(x: Column, digits: int = 3) -> Column:
    """Rounded half up in double arithmetic, the same in every engine, ties included."""
    unit = F.lit(float(10**digits))
    return F.floor(x * unit + F.lit(0.5)).cast("double") / unit


def number(x: Column) -> Column:
    """The double that a string spells in plain or scientific notation, else null."""
    return F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))


def as_confidence(x: Column) -> Column:
    """A double in [0, 1] with 3 digits: null and non-finite are 0, above 1 up to 100 are percent."""
    finite = F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x), F.lit(0.0))
    share = F.when((finite > 1) & (finite <= 100), finite / 100.0).otherwise(finite)
    return fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def as_bool(x: Column) -> Column:
    """Whether a string is one of the words for true; null is false."""
    return F.coalesce(F.lower(F.trim(x)).isin(*TRUE_WORDS), F.lit(False))


def variant_bool(v: Column) -> Column:
    """Truth of a VARIANT of any type: a boolean's value, a word for true, a number other than 0, an array or object that isn't empty; null is false."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number_ = F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False))
    full = ~F.to_json(v).isin("[]", "{}")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(False)).when(kind == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
        .when(kind == "STRING", as_bool(text)).when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), full).otherwise(number_)
    )


def ratio(n: Column, d: Column) -> Column:
    """n / d with 4 digits; null where d is 0."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), 4)


def http_date(x: Column) -> Column:
    """The instant of an HTTP date, whatever the session's zone: GMT or an offset, UTC without either; null if it is none."""
    day = F.regexp_extract(x, r"(\d{1,2}[ -][A-Za-z]{3}[ -]\d{4} \d{2}:\d{2}:\d{2})\s*(GMT|UTC|Z|[+-]\d{4})?\s*$", 1)
    offset = F.regexp_extract(x, r"([+-]\d{4})\s*$", 1)
    text = F.concat_ws(" ", F.translate(day, "-", " "), F.coalesce(F.nullif(offset, F.lit("")), F.lit("+0000")))
    return F.when(day != "", F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for (a number or an HTTP date), 0 at least; null if it says neither. `now` is an instant."""
    left = (F.unix_micros(http_date(header)) - F.unix_micros(now)).cast("double") / 1e6
    asked = F.coalesce(number(header), left)
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), asked))


def retryable_model(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425, 429) | status.between(500, 599), F.lit(False))


def retryable_download(status: Column) -> Column:
    return F.coalesce(status.isin(408, 429) | status.between(500, 599), F.lit(False))


def backoff_seconds(attempt: Column, asked: Column | None = None, base: float = 1.0) -> Column:
    """Delay after a failed attempt (from 1): doubling, or what the server asked for if longer. Jitter is the caller's."""
    own = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return own if asked is None else F.greatest(own, F.coalesce(asked, F.lit(0.0)))
