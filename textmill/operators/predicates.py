"""Predicates and projections: filter compilation, JSON edits, null rules, searches, classifications."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def compile_filter(filters: dict[str, Any], direct: Iterable[str], json_col: str, ignored: Iterable[str] = ()) -> Column:
    """A metadata filter as one condition.

    Names in ``direct`` are text columns and reach the scan; others are keys of the JSON column, whose values must contain the wanted
    one with its type. A list means any of its values; an empty list matches nothing; ``ignored`` names are skipped.
    """
    document = F.try_parse_json(json_col)
    direct, skipped, found = set(direct), set(ignored), []
    for name, wanted in filters.items():
        if name in skipped:
            continue
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        if not values:
            found.append(F.lit(False))
        elif name in direct:
            found.append(F.col(name).isin([str(v) for v in values]))
        else:
            found.append(any_of(json_contains(document, {name: v}) for v in values))
    return all_of(found)


def json_contains(document: Column, wanted: Any) -> Column:
    """Whether a VARIANT holds ``wanted``: equal scalars of one type, all entries of an object, all elements of an array."""
    kind = F.schema_of_variant(document)
    if wanted is None:
        found = F.is_variant_null(document)
    elif isinstance(wanted, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(document, "$", "boolean") == wanted)
    elif isinstance(wanted, (int, float)):
        found = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(document, "$", "double") == float(wanted))
    elif isinstance(wanted, dict):
        found = kind.startswith("OBJECT") & all_of(json_contains(F.try_variant_get(document, _json_path(k), "variant"), v) for k, v in wanted.items())
    elif isinstance(wanted, (list, tuple)):
        elements = F.try_variant_get(document, "$", "array<variant>")

        def held(part: Any) -> Column:
            return F.exists(elements, lambda x: json_contains(x, part))

        found = kind.startswith("ARRAY") & all_of(map(held, wanted))
    else:
        found = (kind == "STRING") & (F.try_variant_get(document, "$", "string") == str(wanted))
    return F.coalesce(found, F.lit(False))


def _json_path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def half_open(ts: Column, start: str | None, end: str | None) -> Column:
    bounds = [ts >= F.lit(start).cast("timestamp")] if start else []
    return all_of(bounds + ([ts < F.lit(end).cast("timestamp")] if end else []))


def require_fields(df: DataFrame, active: dict[str, Any], needs: dict[str, str]) -> DataFrame:
    """Fail before any work when an active filter needs a column the data lacks."""
    missing = sorted(needs[k] for k, v in active.items() if v not in (None, "", [], ()) and k in needs and needs[k] not in df.columns)
    if missing:
        raise ValueError(f"filters need missing columns: {', '.join(missing)}")
    return df


def missing_fields(document: Column, active: dict[str, Any], needs: dict[str, str]) -> Column:
    """The fields, in order, that active filters need and a JSON object lacks; null values and what is no object lack them."""
    wanted = sorted({needs[k] for k, v in active.items() if v not in (None, "", [], ()) and k in needs})
    parsed = F.try_parse_json(document)
    return F.array_compact(F.array(*(F.when(F.try_variant_get(parsed, f"$['{f}']", "string").isNull(), f) for f in wanted)))


def drop_json_keys(json_col: str, keys: Iterable[str]) -> Column:
    """The JSON object without top-level keys, others in order; values keep their types at any depth. Null where it is no object."""
    return F.to_json(F.map_filter(_entries(F.col(json_col)), lambda k, _: ~k.isin(list(keys))))


def merge_json(left: str, right: dict[str, Column]) -> Column:
    """The JSON object with entries added, keys in order; the right side wins, and all values keep their types. No object counts as an empty one."""
    added = _entries(F.to_json(F.struct(*(v.alias(k) for k, v in right.items())), {"ignoreNullFields": "false"}))
    nothing = _entries(F.lit("{}"))
    old = F.map_filter(F.coalesce(_entries(F.col(left)), nothing), lambda k, _: ~k.isin(list(right)))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, added)), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))


def _entries(document: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def search_terms(fields: Iterable[str], query: str) -> Column:
    """Every term of the query is contained, without case, in one of the fields."""
    lowered = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return all_of(any_of(f.contains(term) for f in lowered) for term in query.lower().split())


def any_field_matches(columns: Iterable[str], pattern: str) -> Column:
    return F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), lambda x: x.rlike(pattern))


def account_status(registered: Column, active: Column, verified: Column) -> Column:
    return F.when(~registered, "pending").when(~active, "disabled").when(verified, "enabled").otherwise("registered")


def present_fields(fields: Iterable[str]) -> Column:
    """A JSON object of the non-null whitelisted fields."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
