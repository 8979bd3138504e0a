"""Typed metadata filters as columns over a variant.

A filter maps a field to a value, or to operators: {"year": {"gte": 2020, "lt": 2024}, "tag": "a"}.
All parts must hold.  Numbers and booleans compare as numbers, strings as strings, never one as the
other; in an ordering every number comes before every string.  Arrays and objects compare as their
JSON text.  A missing or null field makes a comparison null, so its row is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.errors import FilterError

OPERATORS = ("eq", "gt", "gte", "lt", "lte", "in")


def check_field(name) -> str:
    if not isinstance(name, str) or not name or not all(c.isalnum() or c in "_-" for c in name):
        raise FilterError(f"bad field name {name!r}")
    return name


def field(metadata: Column, name: str) -> tuple[Column, Column]:
    """(number, text) of a field of a variant: one of them, or neither for a missing or null field."""
    path = f"$['{check_field(name)}']"
    value = F.try_variant_get(metadata, path, "variant")
    kind = F.schema_of_variant(value)
    numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL|BOOLEAN)")
    number = F.when(numeric, F.try_variant_get(metadata, path, "double"))
    text = F.when(kind == "STRING", F.try_variant_get(metadata, path, "string")).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(value))
    return number, text


def whole_number(metadata: Column, name: str) -> Column:
    """A whole number of at most 38 digits as such, as doubles can't tell those beyond 2^53 apart; null for all else."""
    path = f"$['{check_field(name)}']"
    kind = F.schema_of_variant(F.try_variant_get(metadata, path, "variant"))
    return F.when(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))"), F.try_variant_get(metadata, path, "decimal(38,0)"))


def _ordered(mine: Column, op: str, v: Column) -> Column:
    return {"eq": mine == v, "gt": mine > v, "gte": mine >= v, "lt": mine < v, "lte": mine <= v}[op]


def _compare(number: Column, whole: Column, text: Column, op: str, value) -> Column:
    known = number.isNotNull() | text.isNotNull()
    if value is None:
        return F.lit(None).cast("boolean")
    if isinstance(value, (bool, int, float)):
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        try:
            same = _ordered(number, op, F.lit(float(value)))
        except OverflowError:
            raise FilterError("a number must be within the range of a double") from None
        if isinstance(value, int) and abs(value) < 10**38:
            same = F.when(whole.isNotNull(), _ordered(whole, op, F.lit(str(int(value))).cast("decimal(38,0)"))).otherwise(same)
        other, first = text, F.lit(op in ("gt", "gte"))
    elif isinstance(value, str):
        same, other, first = _ordered(text, op, F.lit(value)), number, F.lit(op in ("lt", "lte"))
    else:
        raise FilterError(f"a value must be a number, a string or a boolean, not {type(value).__name__}")
    across = F.lit(False) if op == "eq" else first
    return F.when(known, F.when(other.isNotNull(), across).otherwise(same))


def parse_filter(spec: dict, metadata: str | Column = "metadata") -> Column:
    """The condition of a filter; an empty filter always holds."""
    if not isinstance(spec, dict):
        raise FilterError("a filter is a mapping of fields")
    source = F.col(metadata) if isinstance(metadata, str) else metadata
    parts = []
    for name, want in spec.items():
        number, text = field(source, name)
        whole = whole_number(source, name)
        clauses = want if isinstance(want, dict) else {"eq": want}
        if not clauses:
            raise FilterError(f"no operator for {name!r}")
        for op, value in clauses.items():
            if op not in OPERATORS:
                raise FilterError(f"unknown operator {op!r}; known are {', '.join(OPERATORS)}")
            if op == "in":
                if not isinstance(value, (list, tuple)) or not value:
                    raise FilterError("'in' needs a list that isn't empty")
                parts.append(reduce(lambda a, b: a | b, [_compare(number, whole, text, "eq", v) for v in value]))
            else:
                parts.append(_compare(number, whole, text, op, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
