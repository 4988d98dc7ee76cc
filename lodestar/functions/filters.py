"""The metadata filter language: a dict, checked before any job runs, compiled to one boolean column.

Leaves are two-valued: a missing field compares false, so ``$ne`` and ``$nin`` match rows without it.
Numbers, strings, booleans and lists of strings are different kinds; a value never equals one of
another kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

RANGES = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def kind_of(value: object) -> str:
    """Kind of a literal; anything but a boolean, a string or a finite number is refused."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)) and math.isfinite(value):
        return "number"
    raise InvalidArgument(f"not a filter value: {value!r}")


def parse(spec: object) -> tuple:
    """A filter dict to nested tuples ``("and"|"or", parts)``, ``("not", part)``, ``("in", field, values)``, ``("range", field, op, x)``, ``("exists", field)``, ``("all",)``."""
    if not isinstance(spec, dict):
        raise InvalidArgument("a filter is an object")
    parts = []
    for name, condition in spec.items():
        if name in ("$and", "$or"):
            if not isinstance(condition, list) or not condition:
                raise InvalidArgument(f"{name} takes a list of filters that is not empty")
            parts.append((name[1:], tuple(parse(x) for x in condition)))
        elif not isinstance(name, str) or name.startswith("$"):
            raise InvalidArgument(f"unknown operator {name!r}")
        else:
            parts += _field(name, condition)
    return ("and", tuple(parts)) if parts else ("all",)


def _field(name: str, condition: object) -> list[tuple]:
    if not isinstance(condition, dict):
        kind_of(condition)
        return [("in", name, (condition,))]
    if not condition:
        raise InvalidArgument(f"empty condition on {name!r}")
    out = []
    for op, x in condition.items():
        if op in ("$eq", "$ne"):
            kind_of(x)
            out.append(("in", name, (x,)) if op == "$eq" else ("not", ("in", name, (x,))))
        elif op in ("$in", "$nin"):
            if not isinstance(x, list):
                raise InvalidArgument(f"{op} takes a list")
            for v in x:
                kind_of(v)
            out.append(("in", name, tuple(x)) if op == "$in" else ("not", ("in", name, tuple(x))))
        elif op in RANGES:
            if kind_of(x) != "number":
                raise InvalidArgument(f"{op} takes a number")
            out.append(("range", name, op, float(x)))
        elif op == "$exists":
            if not isinstance(x, bool):
                raise InvalidArgument("$exists takes true or false")
            out.append(("exists", name) if x else ("not", ("exists", name)))
        else:
            raise InvalidArgument(f"unknown operator {op!r}")
    return out


#: Field name to {kind: column}; a column is null where the row's value is of another kind.
Resolver = Callable[[str], dict[str, Column]]


def typed(schema: T.StructType, prefix: str = "") -> Resolver:
    """Fields are columns; the kind is that of the column's type, so predicates reach the Parquet scan."""
    kinds = {}
    for f in schema.fields:
        col = F.col(f"{prefix}`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = {"bool": col}
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = {"number": col}
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = {"string": col}
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            kinds[f.name] = {"list": col}
        else:
            kinds[f.name] = {"other": col}
    return lambda name: kinds.get(name, {})


def variant(column: str) -> Resolver:
    """Fields are keys of a VARIANT object. A type tag guards each reading, as casts alone would let ``true`` or ``"1"`` equal 1."""

    def resolve(name: str) -> dict[str, Column]:
        key = name.replace("\\", "\\\\").replace('"', '\\"')
        path = f'$["{key}"]'
        tag = F.schema_of_variant(F.try_variant_get(column, path, "variant"))
        get = lambda kind: F.try_variant_get(column, path, kind)
        return {
            "bool": F.when(tag == "BOOLEAN", get("boolean")),
            "string": F.when(tag == "STRING", get("string")),
            "number": F.when(tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL"), get("double")),
            "list": F.when(tag.startswith("ARRAY"), get("array<string>")),
        }

    return resolve


def compile_filter(spec: dict | None, resolve: Resolver) -> Column:
    """One column, never null. An empty filter or None is true."""
    return _column(parse(spec or {}), resolve)


def _column(node: tuple, resolve: Resolver) -> Column:
    op = node[0]
    if op == "all":
        return F.lit(True)
    if op in ("and", "or"):
        return reduce(and_ if op == "and" else or_, [_column(x, resolve) for x in node[1]])
    if op == "not":
        return ~_column(node[1], resolve)
    cols = resolve(node[1])
    if op == "exists":
        return reduce(or_, [c.isNotNull() for c in cols.values()]) if cols else F.lit(False)
    if op == "range":
        return F.coalesce(RANGES[node[2]](cols["number"], F.lit(node[3])), F.lit(False)) if "number" in cols else F.lit(False)
    by_kind: dict[str, list] = {}
    for v in node[2]:
        by_kind.setdefault(kind_of(v), []).append(float(v) if kind_of(v) == "number" else v)
    hits = [cols[k].isin(vs) for k, vs in by_kind.items() if k in cols]
    if "list" in cols and "string" in by_kind:
        hits.append(F.arrays_overlap(cols["list"], F.array(*map(F.lit, by_kind["string"]))))
    return reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]) if hits else F.lit(False)


def matches(spec: dict, record: dict) -> bool:
    """The same language on one record in plain Python: for checks, not for tables."""

    def test(node: tuple) -> bool:
        op = node[0]
        if op == "all":
            return True
        if op in ("and", "or"):
            return (all if op == "and" else any)(test(x) for x in node[1])
        if op == "not":
            return not test(node[1])
        v = record.get(node[1])
        if op == "exists":
            return v is not None
        if op == "range":
            return isinstance(v, (int, float)) and not isinstance(v, bool) and RANGES[node[2]](float(v), node[3])
        same = lambda a, b: isinstance(a, (bool, str, int, float)) and kind_of(a) == kind_of(b) and a == b
        return any(same(x, y) for x in (v if isinstance(v, list) else [v]) for y in node[2])

    return test(parse(spec))
