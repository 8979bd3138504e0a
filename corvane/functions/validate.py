"""Checks of rows, as columns that name what is wrong, and of arguments, on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import errors
from corvane.functions.metrics import METRICS

# Limits of the data model (fixed values).
MAX_ID, MAX_NAME = 512, 256
M_RANGE, EF_RANGE = (2, 128), (10, 2000)
BAD_ID = r"[/ \t\n\r\x00]"


def vector_error(vector: Column, dimension: int, metric: str = "euclidean") -> Column:
    """Null for a good vector, else the first thing wrong with it, in a fixed order."""
    as_float = F.transform(vector, lambda x: x.cast("float"))
    infinite = F.exists(as_float, lambda x: F.abs(x) == float("inf"))
    zero = F.lit(metric == "cosine") & ~F.exists(as_float, lambda x: x != 0)
    return (
        F.when(vector.isNull(), "null_vector")
        .when(F.size(vector) == 0, "empty_vector")
        .when(F.size(vector) != dimension, "wrong_dimension")
        .when(F.exists(vector, lambda x: x.isNull()), "null_element")
        .when(F.exists(vector, lambda x: F.isnan(x)), "nan_element")
        .when(infinite, "infinite_element")
        .when(zero, "zero_vector")
    )


def id_error(id_: Column) -> Column:
    return F.when(id_.isNull(), "null_id").when(F.length(id_) == 0, "empty_id").when(F.length(id_) > MAX_ID, "long_id").when(id_.rlike(BAD_ID), "bad_character")


def metadata_error(json: Column) -> Column:
    """Metadata is null or the JSON text of an object."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(json.isNull(), None).when(F.try_parse_json(json).isNull(), "malformed_metadata").when(~kind.startswith("OBJECT"), "metadata_not_an_object")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise errors.InvalidConfig(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    return metric


def _whole(name: str, value, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or high is not None and value > high:
        raise errors.InvalidConfig(f"{name} must be a whole number from {low}" + (f" to {high}" if high else "") + f", not {value!r}")
    return value


def check_config(name: str, dimension: int, metric: str, m: int, ef_construction: int) -> None:
    if not isinstance(name, str) or not 1 <= len(name) <= MAX_NAME or not re.fullmatch(r"[^/\\\x00]+", name) or name in (".", ".."):
        raise errors.InvalidConfig(f"bad collection name {name!r}")
    _whole("dimension", dimension, 1)
    check_metric(metric)
    _whole("m", m, *M_RANGE)
    _whole("ef_construction", ef_construction, *EF_RANGE)


def check_search(k: int, ef: int | None = None, overfetch: int | None = None, strategy: str = "pre") -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise errors.InvalidSearch(f"k must be a positive whole number, not {k!r}")
    if ef is not None and ef < k:
        raise errors.InvalidSearch(f"ef ({ef}) must be at least k ({k})")
    if overfetch is not None and overfetch < 2:
        raise errors.InvalidSearch("the overfetch factor must be at least 2")
    if strategy == "auto":
        raise NotImplementedError("the strategy 'auto' is not offered; choose 'pre' or 'post'")
    if strategy not in ("pre", "post"):
        raise errors.InvalidSearch(f"unknown strategy {strategy!r}")
