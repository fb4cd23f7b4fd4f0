"""Parsers of sizes, volume arguments and addresses, as columns (the engine's own use them through literals)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import MAX_AVG, MIN_AVG

# What a rate-limited answer says, in lower case.
RATE_LIMIT_SIGNS = ("429", "too many requests", "secondary rate limit", "rate limit")


def chunk_size(text: Column) -> Column:
    """Bytes of "512k", "1m" or a plain number, null if malformed or out of bounds."""
    form = r"^\+?0*([0-9]{1,12})\s*([kKmM]?)$"
    number, unit = F.regexp_extract(F.trim(text), form, 1), F.lower(F.regexp_extract(F.trim(text), form, 2))
    factor = F.when(unit == "k", F.lit(1 << 10)).when(unit == "m", F.lit(1 << 20)).otherwise(F.lit(1)).cast("long")
    size = F.when(number != "", number.cast("long") * factor)
    return F.when(size.between(MIN_AVG, MAX_AVG), size)


def volume_id(text: Column) -> Column:
    """The part before the first "=", null unless both parts are there."""
    return F.when(_volume_ok(text), F.regexp_extract(text, r"(?s)^([^=]+)=(.+)$", 1))


def volume_url(text: Column) -> Column:
    return F.when(_volume_ok(text), F.regexp_extract(text, r"(?s)^([^=]+)=(.+)$", 2))


def _volume_ok(text: Column) -> Column:
    return text.rlike(r"(?s)^([^=]+)=(.+)$")


def _repository(url: Column, part: int) -> Column:
    path = F.regexp_extract(url, r"(?s)^.*?://[^/]*/(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"(\.git)+$", "")
    found = F.regexp_extract(path, r"(?s)([^/]+)/([^/]+)$", part)
    return F.when(found != "", found)


def url_owner(url: Column) -> Column:
    """The last folder but one of a repository's address, without a trailing "/" or ".git"; null if there is none."""
    return _repository(url, 1)


def url_name(url: Column) -> Column:
    return _repository(url, 2)


def rate_limited(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for sign in RATE_LIMIT_SIGNS:
        out = out | low.contains(sign)
    return out


def fanout_path(chunk_id: Column) -> Column:
    return F.concat_ws("/", F.substring(chunk_id, 1, 2), F.substring(chunk_id, 3, 2), chunk_id)


def says_rate_limited(text: str) -> bool:
    """rate_limited() for an error that the driver holds."""
    low = text.lower()
    return any(sign in low for sign in RATE_LIMIT_SIGNS)
