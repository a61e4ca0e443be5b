"""Numeric expressions with one rounding rule, and identity hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """Half-up rounding of a non-negative double."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def bounded(x: Column) -> Column:
    """Clamped to 0..1, four digits."""
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def total(parts) -> Column:
    """A sum in the order given, which doubles need to be reproducible."""
    return reduce(lambda a, b: a + b, parts)


def bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def age_hours(anchor: Column, at: Column) -> Column:
    """Hours from ``at`` to the anchor; 0 for the future."""
    return F.greatest(F.lit(0.0), (F.unix_micros(anchor) - F.unix_micros(at)).cast("double") / F.lit(3.6e9))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def hex_id(prefix: str, text: Column) -> Column:
    """A prefix and 20 hexadecimal digits of the text's SHA-256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 20))


def content_hash(title: Column, abstract: Column) -> Column:
    return F.sha2(F.concat(F.lower(title), F.lit("\n"), F.lower(F.coalesce(abstract, F.lit("")))), 256)


def fnv1a(text: Column) -> Column:
    """The unsigned 32-bit FNV-1a hash over a text's UTF-16 code units.

    Fixed values: the hash's offset basis and prime.
    """
    octets = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.filter(F.sequence(F.lit(0), (F.length(octets) / 4).cast("int")), lambda i: i > 0), lambda i: F.conv(F.substring(octets, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: h.bitwiseXOR(u) * F.lit(0x01000193) % F.lit(1 << 32))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cost_micros(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Cost of a call in millionths, prices being for a million tokens."""
    return F.round(prompt * F.lit(prompt_price) + completion * F.lit(completion_price)).cast("long")


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")
