"""Payloads without a schema: JSON texts as Variant values, walked, bounded and compared by column expressions.

A Variant holds the keys of each object in order, so what is written back from one is canonical at every
depth. A text that is no JSON, or repeats a key in one object, is NULL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.text import any_term, let

# Bounds of a public projection.
DEPTH, MOST, TEXT = 3, 30, 2000


def canonical(x: Column) -> Column:
    """Compact JSON with the keys of every object in order."""
    return F.to_json(F.try_parse_json(x))


def canonical_hash(x: Column) -> Column:
    return F.sha2(canonical(x), 256)


def value_at(x: Column, *keys: str) -> Column:
    """The Variant below these keys; NULL if one is missing or stands in no object."""
    return value_of(F.try_parse_json(x), *keys)


def value_of(v: Column, *keys: str) -> Column:
    """value_at of a Variant, as the other functions in _of: a payload whose parts are asked for one by one is parsed once."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), "variant")


def bounded(v: Column, depth: int = DEPTH, most: int = MOST, text: int = TEXT) -> Column:
    """A Variant cut for the public: texts to so many characters, arrays and objects to so many entries, nothing nested
    deeper than depth (NULL stands there), and no infinite numbers. Of an object the first keys in order stay."""
    return let(v, lambda x: _bounded(x, depth, most, text))


def _bounded(x: Column, depth: int, most: int, text: int) -> Column:
    null = F.lit(None).cast("variant")
    kind = F.schema_of_variant(x)
    entries, items = F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), F.try_variant_get(x, "$", "array<variant>")
    if depth:
        inner = lambda c: let(c, lambda y: _bounded(y, depth - 1, most, text))
        record = F.to_variant_object(F.map_from_entries(F.transform(F.slice(entries, 1, most), lambda e: F.struct(e["key"].alias("key"), inner(e["value"]).alias("value")))))
        listed = F.to_variant_object(F.transform(F.slice(items, 1, most), inner))
    else:
        record = listed = null
    number = F.try_variant_get(x, "$", "double")
    return (
        F.when(x.isNull() | F.is_variant_null(x), null)
        .when(F.startswith(kind, F.lit("OBJECT")), record)
        .when(F.startswith(kind, F.lit("ARRAY")), listed)
        .when(kind == "STRING", F.substring(F.try_variant_get(x, "$", "string"), 1, text).cast("variant"))
        .when(kind.isin("DOUBLE", "FLOAT") & (F.isnan(number) | (F.abs(number) == float("inf"))), null)
        .otherwise(x)
    )


def changed_keys(before: Column, after: Column) -> Column:
    """Sorted keys of two payloads' objects whose values differ, missing ones as NULL; a payload that is no object has none."""
    return changed_fields(fields_of(F.try_parse_json(before)), fields_of(F.try_parse_json(after)))


def fields_of(v: Column) -> Column:
    """The fields of a Variant's object as JSON, by key; none of what is no object."""
    fields = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(fields, lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))


def changed_fields(before: Column, after: Column) -> Column:
    """Sorted keys of two payloads' fields_of whose values differ, missing ones as NULL; a NULL payload has none."""
    none = F.create_map().cast("map<string,string>")
    both = F.struct(F.coalesce(before, none).alias("a"), F.coalesce(after, none).alias("b"))
    shown = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit("null"))
    return let(both, lambda p: F.sort_array(F.filter(F.array_union(F.map_keys(p["a"]), F.map_keys(p["b"])), lambda k: shown(p["a"], k) != shown(p["b"], k))))


def all_keys(x: Column) -> Column:
    """Distinct keys of a payload at any depth, as JSON writes them, in order.

    In compact JSON only a key has a brace or comma before its quotes and a colon after them.
    """
    return _keys(canonical(x))


def _keys(compact: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(compact, F.lit(r'[{,]"((?:[^"\\]|\\.)*)":'), F.lit(1))))


def forbidden_keys(x: Column, names: list[str], prefixes: list[str] = []) -> Column:
    """Keys at any depth that are forbidden, in any case, or begin as forbidden ones do."""
    return forbidden_of(canonical(x), names, prefixes)


def forbidden_of(compact: Column, names: list[str], prefixes: list[str] = []) -> Column:
    """forbidden_keys of a payload in canonical form."""
    pattern = f"(?i)^(?:(?:{any_term(names)})$" + (f"|(?:{any_term(prefixes)})" if prefixes else "") + ")"
    return F.filter(_keys(compact), lambda k: k.rlike(pattern))
