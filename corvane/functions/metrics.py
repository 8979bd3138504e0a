"""Vector metrics as column expressions; sums are in double whatever the element type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.errors import InvalidConfig

#: Whether a higher score is the better one.
HIGHER = {"cosine": True, "dot": True, "euclidean": False}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity kept within [-1, 1]; a zero vector on either side raises an error."""
    size = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))
    return F.when(size == 0, F.raise_error(F.lit("cosine of a zero vector")).cast("double")).otherwise(value)


def euclidean(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a) -> Column:
    """The vector divided by its length (plus 1e-10, so that a zero vector stays zero)."""
    size = norm(a) + F.lit(1e-10)
    return F.transform(_col(a), lambda x: x.cast("double") / size)


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def score(metric: str, a, b) -> Column:
    if metric not in METRICS:
        raise InvalidConfig(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def best_first(metric: str, column: str = "score") -> Column:
    return F.desc(column) if HIGHER[metric] else F.asc(column)
