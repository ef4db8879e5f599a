"""Per-column cleaning of counts, ids, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: address used where an event carries none.
NO_ADDRESS = "0.0.0.0"


def coerce_id(text: Column) -> Column:
    """``int(float(text))``: '100221.0' is a valid id, anything unreadable becomes null."""
    return coerce_number(text).try_cast("bigint")


def coerce_number(text: Column) -> Column:
    """Strict numeric read: text with thousands separators is not a number here."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def normalize_count(text: Column) -> Column:
    """Lenient count: thousands separators stripped, truncated to an integer, blank is null."""
    return coerce_number(F.replace(F.trim(text.cast("string")), F.lit(","), F.lit(""))).try_cast("bigint")


def clean_count(count: Column) -> Column:
    """Null and negative counts become 0."""
    return F.coalesce(F.greatest(count, F.lit(0)), F.lit(0)).cast("bigint")


def log_count(count: Column) -> Column:
    return F.log1p(count.cast("double"))


def normalize_ip(*candidates: Column, default: str | None = NO_ADDRESS) -> Column:
    """First usable address among the candidates; blank, ``N/A`` and ``null`` do not count."""
    usable = []
    for column in candidates:
        trimmed = F.trim(column)
        missing = (trimmed == "") | (trimmed == "N/A") | (F.lower(trimmed) == "null")
        usable.append(F.when(~missing, trimmed))
    if default is not None:
        usable.append(F.lit(default))
    return F.coalesce(*usable)


def label_binary(label: Column, positive: str = "attack") -> Column:
    return F.when(label == positive, 1).otherwise(0)


def normalize_host(host: Column, null_host: str | None = None) -> Column:
    """Blank and ``N/A`` hosts become null, or the given literal."""
    trimmed = F.trim(host)
    cleaned = F.when(~trimmed.isin("", "N/A"), trimmed)
    return cleaned if null_host is None else F.coalesce(cleaned, F.lit(null_host))
