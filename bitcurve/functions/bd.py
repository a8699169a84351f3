"""Bjontegaard deltas as Spark SQL expressions.

A curve is ``array<struct<rate:double, quality:double>>``; arguments are column names or SQL
expressions. Both fits are expanded in discrete orthogonal polynomials and evaluated at the two
Gauss-Legendre nodes of the common interval, which integrates a cubic exactly: no antiderivative
and no Python. The text is parsed once by Spark, which is far cheaper than building the same tree
column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INFINITY = "double('Infinity')"


def finite_sql(value: str) -> str:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return f"coalesce(NOT isnan({value}) AND abs({value}) <> {INFINITY}, false)"


def let_sql(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once under ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def clean_points_sql(points: str) -> str:
    """Drop points with a non-finite member or a rate that is not positive."""
    return f"filter({points}, p -> {finite_sql('p.rate')} AND {finite_sql('double(p.quality)')} AND p.rate > 0)"


def clean_points(points: str) -> Column:
    return F.expr(clean_points_sql(points))


def _fit(curve: str, degree: str, nodes: str) -> str:
    """Least-squares polynomial through (x, y) of ``curve.xy``, summed over both nodes.

    State: ``now``/``before`` are the last two basis polynomials at the points, u/v (and u0/v0)
    the same at the nodes, ``norm`` the squared norm of the previous one, ``fit`` the result."""
    start = f"""named_struct(
        'now', transform({curve}.xy, z -> 1D), 'before', transform({curve}.xy, z -> 0D), 'norm', 1D,
        'u', 1D, 'u0', 0D, 'v', 1D, 'v0', 0D, 'fit', 0D)"""
    sums = f"""aggregate(
        zip_with({curve}.xy, s.now, (z, b) -> named_struct('bb', b*b, 'xbb', z.x*b*b, 'yb', z.y*b)),
        named_struct('bb', 0D, 'xbb', 0D, 'yb', 0D),
        (t, w) -> named_struct('bb', t.bb + w.bb, 'xbb', t.xbb + w.xbb, 'yb', t.yb + w.yb))"""
    constants = """named_struct('alpha', m.xbb/nullif(m.bb, 0D), 'coef', m.yb/nullif(m.bb, 0D),
        'beta', CASE WHEN d = 0 THEN 0D ELSE m.bb/nullif(s.norm, 0D) END, 'norm', m.bb)"""
    following = f"""named_struct(
        'now', zip_with(zip_with({curve}.xy, s.now, (z, b) -> (z.x - k.alpha)*b), s.before, (z, b) -> z - k.beta*b),
        'before', s.now, 'norm', k.norm,
        'u', ({nodes}.u - k.alpha)*s.u - k.beta*s.u0, 'u0', s.u,
        'v', ({nodes}.v - k.alpha)*s.v - k.beta*s.v0, 'v0', s.v,
        'fit', s.fit + k.coef*(s.u + s.v))"""
    step = let_sql("k", let_sql("m", sums, constants), following)
    return f"aggregate(sequence(0, {degree}), {start}, (s, d) -> {step}, s -> s.fit)"


def _curve(points: str, x: str, y: str) -> str:
    xy = f"transform({clean_points_sql(points)}, p -> named_struct('x', {x}, 'y', {y}))"
    xs = "transform(c, z -> z.x)"
    return let_sql(
        "c",
        xy,
        f"named_struct('xy', c, 'n', size(c), 'distinct', size(array_distinct({xs})),"
        f" 'lo', array_min({xs}), 'hi', array_max({xs}))",
    )


def _degree(curve: str, fixed: int | None) -> str:
    order = str(fixed) if fixed is not None else f"CASE WHEN {curve}.n >= 4 THEN 3 WHEN {curve}.n = 3 THEN 2 ELSE 1 END"
    return f"greatest(least({order}, {curve}.distinct - 1), 0)"


def _mean_gap(anchor: str, test: str, x: str, y: str, fixed: int | None = None, bounds=None) -> str:
    """Mean of fit(test) - fit(anchor) over the common x interval; NULL if undefined."""
    lo, hi = bounds or ("greatest(g.a.lo, g.t.lo)", "least(g.a.hi, g.t.hi)")
    least = 1 if fixed is not None else 2
    nodes = f"""named_struct('lo', {lo}, 'hi', {hi}, 'u', ({lo} + {hi})/2 - ({hi} - {lo})/2/sqrt(3D),
        'v', ({lo} + {hi})/2 + ({hi} - {lo})/2/sqrt(3D))"""
    gap = f"""CASE WHEN g.a.n >= 2 AND g.t.n >= 2 AND g.a.distinct >= {least} AND g.t.distinct >= {least}
        AND i.hi > i.lo THEN ({_fit('g.t', _degree('g.t', fixed), 'i')} - {_fit('g.a', _degree('g.a', fixed), 'i')})/2
        END"""
    both = f"named_struct('a', {_curve(anchor, x, y)}, 't', {_curve(test, x, y)})"
    return let_sql("g", both, let_sql("i", nodes, gap))


_LOG_RATE, _QUALITY = "ln(p.rate)", "double(p.quality)"


def bd_rate_sql(anchor: str, test: str) -> str:
    gap = _mean_gap(anchor, test, _QUALITY, _LOG_RATE)
    return let_sql("r", f"(exp({gap}) - 1)*100", f"CASE WHEN {finite_sql('r')} THEN r END")


def bd_rate(anchor: str, test: str) -> Column:
    """Mean rate change of ``test`` against ``anchor`` at equal quality, in percent; NULL if undefined."""
    return F.expr(bd_rate_sql(anchor, test))


def bd_metric_sql(anchor: str, test: str) -> str:
    gap = _mean_gap(anchor, test, _LOG_RATE, _QUALITY)
    return let_sql("r", gap, f"CASE WHEN {finite_sql('r')} THEN r END")


def bd_metric(anchor: str, test: str) -> Column:
    """Mean quality change of ``test`` against ``anchor`` at equal rate; NULL if undefined."""
    return F.expr(bd_metric_sql(anchor, test))


def bd_rate_quadratic(anchor: str, test: str) -> Column:
    """Degree-2 BD-rate that raises an error where the delta is undefined."""
    gap = _mean_gap(anchor, test, _QUALITY, _LOG_RATE, fixed=2)
    return F.expr(f"coalesce((exp({gap}) - 1)*100, double(raise_error('quality ranges do not overlap')))")


def bd_quality_quadratic(anchor: str, test: str) -> Column:
    """Degree-2 mean quality change. The interval runs between the rates of the points of lowest
    and highest quality, which differ from the extreme rates when a curve is not monotone."""

    def end(points: str, position: int) -> str:
        ordered = f"transform({clean_points_sql(points)}, p -> named_struct('q', {_QUALITY}, 'r', {_LOG_RATE}))"
        return f"element_at(array_sort({ordered}), {position}).r"

    lo = f"greatest({end(anchor, 1)}, {end(test, 1)})"
    hi = f"least({end(anchor, -1)}, {end(test, -1)})"
    gap = _mean_gap(anchor, test, _LOG_RATE, _QUALITY, fixed=2, bounds=(lo, hi))
    return F.expr(f"coalesce({gap}, double(raise_error('rate ranges do not overlap')))")


def pareto_score(quality: str, rate: str, quality_weight: float = 1.0, rate_weight: float = 0.15) -> Column:
    """Weighted quality minus weighted log1p(rate); negative rates are an error."""
    checked = f"CASE WHEN {rate} < 0 THEN double(raise_error('rate must not be negative')) ELSE {rate} END"
    return F.expr(f"{quality_weight}D*{quality} - {rate_weight}D*log1p({checked})")


def register(spark: SparkSession) -> None:
    """Make the deltas callable from SQL as ``bd_rate(anchor, test)`` and ``bd_metric(anchor, test)``."""
    curve = "ARRAY<STRUCT<rate: DOUBLE, quality: DOUBLE>>"
    for name, body in (("bd_rate", bd_rate_sql), ("bd_metric", bd_metric_sql)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(anchor {curve}, test {curve}) RETURNS DOUBLE"
            f" RETURN {body('anchor', 'test')}"
        )
