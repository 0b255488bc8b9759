"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso(ts: Column) -> Column:
    """UTC text of a timestamp, of one width so that texts sort as times do."""
    return F.date_format(ts, ISO)


def parse_iso(text: Column) -> Column:
    """Timestamp of RFC 3339 text, null if it is none."""
    return F.try_to_timestamp(text)


def partition_value(text: Column) -> Column:
    """Text that is safe as a partition value: trimmed lower case, slashes and spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(text)), "[/ ]", "_")


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero for positive values, the same in every engine."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def nonempty(x: Column, default: Column | None = None) -> Column:
    """The text, or the default where it is null or empty."""
    value = F.nullif(x, F.lit(""))
    return value if default is None else F.coalesce(value, default)


def contains_folded(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def escape_query(text: Column) -> Column:
    """Backslashes before the characters that a search language reserves (fixed values: + ^ ` : { } " [ ] ( ) ~ ! \\ *)."""
    return F.regexp_replace(text, r'([+^`:{}"\[\]()~!\\*])', r"\\$1")


def epoch_ceiling(ts: Column) -> Column:
    """Seconds since the epoch, rounded up."""
    return F.ceil(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def is_late(received: Column, observed: Column, hours: int = 12) -> Column:
    """Whether an event came in more than so many hours after it happened."""
    return F.coalesce(received > observed + F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def tenure_bucket(index: Column) -> Column:
    """Tenure label that is derived from the principal's number, for lack of a start date."""
    years = (index.cast("double") * F.lit(7.3)) % F.lit(6.0)
    return F.when(years < 0.25, "<3mo").when(years < 1.0, "3-12mo").when(years < 3.0, "1-3yr").when(years < 5.0, "3-5yr").otherwise("5yr+")


#: Privilege level by role; every other role is regular.
PRIVILEGE = {"security-admin": "admin", "executive": "elevated", "manager": "elevated", "staff-engineer": "elevated"}


def privilege_level(role: Column) -> Column:
    chosen = F.lit("regular")
    for name, level in PRIVILEGE.items():
        chosen = F.when(role == name, level).otherwise(chosen)
    return chosen


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.parse_json(text))


def encode_cursor(fields: Column) -> Column:
    """Base64 of JSON in one line, with the alphabet that is safe in urls."""
    return F.translate(F.base64(F.to_json(fields).cast("binary")), "+/\r\n", "-_")


def decode_cursor(text: Column, schema: str) -> Column:
    return F.from_json(F.unbase64(F.translate(text, "-_", "+/")).cast("string"), schema)


def attribute(json: Column, name: str, kind: str, default) -> Column:
    """A typed attribute of a JSON object; the default where it is missing or of another type."""
    value = F.parse_json(json)
    own = {"boolean": "BOOLEAN", "string": "STRING", "bigint": "BIGINT"}[kind]
    typed = F.startswith(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit(own))
    return F.coalesce(F.when(typed, F.try_variant_get(value, f"$.{name}", kind)), F.lit(default))


def padded(values: Column, n: int, pad: Column) -> Column:
    """The first ``n`` elements, filled up with ``pad``."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(pad, F.greatest(F.lit(0), F.lit(n) - F.size(values))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of unit vectors, within 0 and 1."""
    return clamp(F.lit(1.0) - dot(a, b), 0.0, 1.0)


def huber_like(x: Column, beta: float = 1.0) -> Column:
    """Quadratic up to ``beta``, linear beyond."""
    return F.when(F.abs(x) <= beta, 0.5 * x * x).otherwise(beta * (F.abs(x) - 0.5 * beta))


def power_mean(x: Column, w: float) -> Column:
    """Aggregate: the mean that leans to large values."""
    return F.pow(F.avg(F.pow(x, F.lit(w))), F.lit(1.0 / w))


def to_places(x: Column | str, n: int) -> Column:
    """``F.round`` of numbers that aren't negative, halves up, without a decimal for each: for columns of pairs."""
    at = F.lit(10.0**n)
    return F.floor((F.col(x) if isinstance(x, str) else x) * at + 0.5) / at
