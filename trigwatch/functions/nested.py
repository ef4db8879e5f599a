"""JSON, map and dotted-path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rules_text(rules: Column) -> Column:
    return F.to_json(rules)


def rules_map(text: Column) -> Column:
    return F.from_json(text, "map<string,bigint>")


def get_path(document: Column, path: str) -> Column:
    """Dotted lookup in a JSON document; a missing step gives null."""
    return F.get_json_object(document, json_path(path))


def json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split(".") if part)


def payloads(document: Column, path: str) -> Column:
    """JSON payloads of a document: one for an object, one per object of a list,
    else the document itself."""
    found = get_path(document, path)
    as_list = F.from_json(found, "array<string>")
    objects = F.filter(as_list, lambda item: F.ltrim(item).startswith("{"))
    return (
        F.when(F.ltrim(found).startswith("{"), F.array(found))
        .when(F.ltrim(found).startswith("["), objects)
        .otherwise(F.array(document))
    )


def first_nonempty_map(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates])


def safe_map_value(mapping: Column, key: Column) -> Column:
    return F.try_element_at(mapping, key)
