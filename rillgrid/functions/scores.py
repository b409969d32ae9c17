"""Scalar score, grade and age expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Reference labels of the five equal grades, lowest first.
FIXED_GRADES = ("안전", "관심", "주의", "경계", "위험")
# Reference labels and lower bounds of the five uneven index grades.
INDEX_GRADES = ("매우낮음", "낮음", "보통", "높음", "매우높음")
INDEX_BOUNDS = (0.01, 0.25, 0.50, 0.75)
# Flood depth classes and their midpoints in metres.
DEPTH_MIDPOINTS = {
    "~0.5": 0.25,
    "0.5~1.0": 0.75,
    "1.0~1.5": 1.25,
    "1.5~2.0": 1.75,
    "2.0~3.0": 2.5,
    "3.0~": 3.5,
}
# Exposure class (row) by sensitivity class (column), both 1 = worst, to the matrix grade.  The published
# plan names the four grades only; this table is this library's default and a parameter.
GRADE_MATRIX = ((1, 1, 2, 2), (1, 2, 2, 3), (2, 2, 3, 4), (2, 3, 4, 4))


def grade_fixed(score, include_lowest: bool = False) -> Column:
    """Five right-closed bins over (0, 1]; a score of exactly 0 has no grade."""
    s = _c(score)
    below = s < 0 if include_lowest else s <= 0
    out = F.when(below, F.lit(None).cast("string"))
    for top, label in zip((0.2, 0.4, 0.6, 0.8, 1.0), FIXED_GRADES):
        out = out.when(s <= top, label)
    return out


def grade_index(score) -> Column:
    """Left-closed bins at .01, .25, .50 and .75."""
    s = _c(score)
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(INDEX_BOUNDS, INDEX_GRADES):
        out = out.when(s < bound, label)
    return out.otherwise(INDEX_GRADES[-1])


def class_code(value, breaks) -> Column:
    """1 for values up to the first break, one more per break passed (right-closed)."""
    v = _c(value)
    code = F.lit(1)
    for b in breaks:
        code = code + F.when(v > F.lit(float(b)), 1).otherwise(0)
    return F.when(v.isNotNull(), code)


def matrix_grade(exposure, sensitivity, matrix=GRADE_MATRIX) -> Column:
    """Two 4-class codes with 1 = worst to the grade I..IV as 1..4 by table lookup."""
    table = F.array(*[F.lit(v) for row in matrix for v in row])
    return F.element_at(table, ((_c(exposure) - 1) * 4 + _c(sensitivity)).cast("int"))


def depth_mid(label) -> Column:
    pairs = [F.lit(v) for kv in DEPTH_MIDPOINTS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(_c(label)))


def bayes_shrink(hits, trials, prior, strength: float = 20.0) -> Column:
    """Pull the share of small cells towards the overall share."""
    return (_c(hits) + F.lit(strength) * _c(prior)) / (_c(trials) + F.lit(strength))


def weibull_defect(age, eta: float, beta: float) -> Column:
    return 1 - F.exp(-F.pow(_c(age) / F.lit(eta), F.lit(beta)))


def wetness_index(upstream, slope_tangent, floor: float = 0.001) -> Column:
    return F.log(_c(upstream) / F.greatest(_c(slope_tangent), F.lit(floor)))


def age_of(year, base: int = 2026) -> Column:
    return F.lit(base) - _c(year)


def is_old(age, limit: int = 30) -> Column:
    """Inclusive threshold; unknown age stays unknown."""
    return _c(age) >= F.lit(limit)


def safe_ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))
