"""Rule, family and feature names: classification, display text and payload text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default family, feature-name prefixes.
NO_FAMILY = "Uncategorized"
FAMILY_PREFIX = "family_"
RULE_PREFIX = "rule_"


def rule_family(name: Column, patterns: Sequence[tuple[str, str]], explicit: Column | None = None) -> Column:
    """Explicit family if given, else that of the first matching name pattern."""
    by_name = F.lit(NO_FAMILY)
    for pattern, family in reversed(list(patterns)):
        by_name = F.when(name.rlike(pattern), family).otherwise(by_name)
    return by_name if explicit is None else F.coalesce(explicit, by_name)


def priority_bucket(name: Column | None, feature: Column | None, prefix: str, keyword: str) -> Column:
    """0: prefix and keyword, 1: prefix, 2: keyword, 3: neither (case-insensitive)."""
    blank = F.lit("")
    name = F.lower(F.trim(F.coalesce(name, blank))) if name is not None else blank
    feature = F.lower(F.trim(F.coalesce(feature, blank))) if feature is not None else blank
    prefix, keyword = prefix.lower(), keyword.lower()
    leads = (
        name.startswith(prefix) | feature.startswith(prefix) | feature.startswith(FAMILY_PREFIX + prefix)
    )
    mentions = name.contains(keyword) | feature.contains(keyword)
    return F.when(leads & mentions, 0).when(leads, 1).when(mentions, 2).otherwise(3)


def feature_rule_id(feature: Column) -> Column:
    return F.nullif(F.regexp_extract(feature, r"^rule_(\d+)$", 1), F.lit("")).try_cast("bigint")


def feature_family(feature: Column) -> Column:
    return F.nullif(F.regexp_extract(feature, r"^family_(.+)$", 1), F.lit(""))


def shorten(text: Column, width: int | None = None, mark: str = "...") -> Column:
    """Collapse white space; if wider than a given width, keep the whole words that fit before the mark."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if width is None:
        return flat
    room = width - len(mark)
    # the first `room` characters end on a word boundary if the next one is a blank
    head = F.when(F.substring(flat, room + 1, 1) == " ", F.substring(flat, 1, room)).otherwise(
        F.regexp_replace(F.substring(flat, 1, room), r"\s*\S*$", "")
    )
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(head), F.lit(mark)))


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in candidates])


def feature_display(feature_id: Column, label: Column, width: int | None = None) -> Column:
    return shorten(F.concat_ws(" | ", feature_id, F.nullif(label, F.lit(""))), width)


def feature_importance(importance: Column, score: Column, value: Column) -> Column:
    """Importance, else a non-zero score, else the value."""
    return F.coalesce(importance, F.when(score != 0, score), value)


def confidence_pct(confidence: Column) -> Column:
    """Probabilities (up to 1.5) are scaled to percent, percentages are kept."""
    value = confidence.cast("double")
    scaled = F.when(value <= 1.5, value * 100).otherwise(value)
    # a null argument would be printed, so the missing case is decided first
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", scaled))


def sanitize_text(text: Column, max_len: int | None = None) -> Column:
    """One-line message, of bounded length if the receiver asks for one."""
    line = F.translate(text, "\r\n", "  ")
    return line if max_len is None else F.substring(line, 1, max_len)


def clean_value(text: Column) -> Column:
    """Value inside a key=value line: no tabs, line breaks or equal signs."""
    return F.translate(text, "\t\n=", "  :")


def indexed_keys(entries: Column) -> Column:
    """``[{rule_id, value}, …]`` to maps with keys ``rule_id-1``, ``value-1``, …"""

    def number(entry: Column, position: Column) -> Column:
        suffix = (position + 1).cast("string")
        return F.create_map(
            F.concat(F.lit("rule_id-"), suffix),
            entry["rule_id"].cast("string"),
            F.concat(F.lit("value-"), suffix),
            entry["value"].cast("string"),
        )

    return F.transform(entries, number)


def resolve_rule_name(
    rule_id: Column, own_name: Column, list_name: Column, map_name: Column, family: Column
) -> Column:
    """Keep a descriptive name; else look it up; else show the id; then add the family."""
    resolved = F.coalesce(
        F.when(~own_name.rlike(r"^\d+$"), own_name),
        F.nullif(F.coalesce(list_name, map_name), F.lit("")),
        own_name,
        rule_id.cast("string"),
    )
    with_family = F.coalesce(F.concat(resolved, F.lit("("), family, F.lit(")")), family)
    return F.when(family.isNull() | (family == ""), resolved).otherwise(with_family)


def rule_display(rule_id: Column, name: Column) -> Column:
    """``name (ID:n)``, or the bare id if the rule has no name."""
    return F.coalesce(
        F.concat(name, F.lit(" (ID:"), rule_id.cast("string"), F.lit(")")), rule_id.cast("string")
    )


def family_share_value(importance: Column, child_count: Column, family_count: Column) -> Column:
    """A family's importance split over its rules in proportion to their counts."""
    return F.when(family_count > 0, importance * child_count / family_count).otherwise(importance)
