"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING_KEYS = "fbclid gclid ref source utm_campaign utm_content utm_medium utm_source utm_term".split()
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, k)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    """Form encoding: space is +, ~ stays, * is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url: Column, preserve_fragment: bool = False) -> Column:
    """http(s) URLs in one form, null for others.

    Scheme and authority in lower case, no trailing slash, query pairs
    without tracking keys, decoded, sorted and encoded anew (blank values and
    repeated keys stay), and no fragment unless asked for.
    """
    scheme, host = F.lower(_part(url, 1)), F.lower(_part(url, 2))
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_KEYS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    tail = _part(url, 5) if preserve_fragment else F.lit("")
    whole = F.concat(
        scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)), F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("#"), tail)),
    )
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def is_public_url(url: Column) -> Column:
    """https only, no local host, and no private, loopback or link-local address."""
    host = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^[^@]*@", ""), r":\d+$", ""))
    private = r"^(localhost|.*\.localhost|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\..*|22[4-9]\..*|2[3-5]\d\..*|\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\])$"
    return F.coalesce((_part(url, 1) == "https") & (host != "") & ~host.rlike(private), F.lit(False))
