"""Measurement-shaped inputs derived from the whole driver tables, in Spark and in DuckDB SQL.

Each column is one SQL expression written once and rendered for either engine. ``U(s)`` is a
uniform value in [0, 1) taken from md5, equal in both.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitcurve.schema import CANDIDATES
from bitcurve.session import parallelism
from workload.registry import table

try:
    from _md5 import md5 as _MD5  # CPython's own: OpenSSL's takes longer to start than to hash a short text
except ImportError:
    from hashlib import md5 as _MD5

_U = re.compile(r"\bU\(((?:[^()]|\([^()]*\))*)\)")
_DOUBLE = re.compile(r"(\d*\.?\d+)D\b")
_OF_SOURCE = re.compile(r"\bU\('[^']*'\|\|k\)")
_OF_ROW = re.compile(r"\bU\('([^']*)'\|\|ck\)")
MANY_SEEDS = 8  # from so many values of a row on, digests are faster taken in batches than as hexadecimal strings


def spark_sql(text: str) -> str:
    return _U.sub(r"(CAST(conv(substring(md5(\1),1,8),16,10) AS BIGINT)/4294967296.0D)", text)


def duck_sql(text: str) -> str:
    text = _U.sub(r"(('0x'||substr(md5(\1),1,8))::BIGINT/4294967296.0::DOUBLE)", text)
    return _DOUBLE.sub(r"\1::DOUBLE", text).replace("STRING", "VARCHAR")


def uniform_values(seeds):
    """``U(seed||key)`` of each seed, as a struct u0, u1, ... for a column of keys."""
    starts = [seed.encode() for seed in seeds]

    @F.arrow_udf("struct<" + ", ".join(f"u{i}: double" for i in range(len(starts))) + ">")
    def uniform(keys: pa.Array) -> pa.Array:
        keys = [key.encode() for key in keys.to_pylist()]
        columns = []
        for start in starts:
            digests = b"".join([_MD5(start + key).digest() for key in keys])
            columns.append(pa.array(np.frombuffer(digests, ">u4")[::4]/4294967296.0))
        return pa.StructArray.from_arrays(columns, [f"u{i}" for i in range(len(columns))])

    return uniform


def _names() -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CANDIDATES))
    return f"CASE cand_idx {cases} END"


# Values per candidate row; k = source, ck = source|qp|candidate (with the codec for all but h264).
MEASURE = {
    "class": "p_brand",
    "candidate": _names(),
    "bpp": "p_retailprice/4000.0D * (1.0D - 0.2D*ci) * pow(0.5D, qi*0.45D)"
    " * (1.0D - 0.05D*cand_idx*(0.4D + U('r|'||ck)))",
    "correct_a": "U('c0|'||k) < 0.86D - 0.15D*qi - 0.004D*cand_idx*U('d0|'||ck)*5.0D",
    "correct_b": "U('c1|'||k) < 0.80D - 0.14D*qi - 0.008D*cand_idx*U('d1|'||ck)*5.0D",
    "correct_c": "U('c2|'||k) < 0.78D - 0.13D*qi - 0.012D*cand_idx*U('d2|'||ck)*5.0D",
    # Gentler losses, for decisions in which some policies pass.
    "correct_d": "U('c0|'||k) < 0.86D - 0.15D*qi - 0.0035D*cand_idx*U('d0|'||ck)",
    "correct_e": "U('c1|'||k) < 0.80D - 0.14D*qi - 0.003D*cand_idx*U('d1|'||ck)",
    "correct_f": "U('c2|'||k) < 0.78D - 0.13D*qi - 0.0045D*cand_idx*U('d2|'||ck)",
    "a_kl_source": "0.02D + 0.02D*cand_idx*U('k|'||ck) + 0.01D*qi",
    "a_feature_distance": "0.01D + 0.012D*cand_idx*U('f|'||ck) + 0.01D*qi",
    "a_source_confidence": "U('s|'||k)",
    "a_source_margin": "U('s|'||k)*U('sm|'||k)",
    "a_source_top1_agrees": "U('g|'||ck) > 0.1D + 0.02D*cand_idx",
    "a_confidence": "U('cf|'||ck)",
    "a_margin": "U('cf|'||ck)*U('mg|'||ck)",
    "a_entropy": "2.0D*U('en|'||ck)",
    "a_source_top1_prob": "U('sp|'||ck)",
    "a_kl_anchor": "0.05D*cand_idx*U('ka|'||ck)",
    "a_anchor_top1_agrees": "cand_idx = 0 OR U('ga|'||ck) > 0.08D*cand_idx",
    "b_kl_source": "0.03D + 0.015D*cand_idx*U('kb|'||ck) + 0.012D*qi",
    "b_feature_distance": "0.015D + 0.01D*cand_idx*U('fb|'||ck) + 0.008D*qi",
    "b_source_confidence": "U('sb|'||k)",
    "b_source_margin": "U('sb|'||k)*U('smb|'||k)",
    "b_source_top1_agrees": "U('gb|'||ck) > 0.08D + 0.03D*cand_idx",
    "b_confidence": "U('cfb|'||ck)",
    "b_margin": "U('cfb|'||ck)*U('mgb|'||ck)",
    "b_entropy": "2.0D*U('enb|'||ck)",
    "b_source_top1_prob": "U('spb|'||ck)",
    "b_kl_anchor": "0.04D*cand_idx*U('kab|'||ck)",
    "b_anchor_top1_agrees": "cand_idx = 0 OR U('gab|'||ck) > 0.07D*cand_idx",
    "target_prob_a": "0.9D - 0.12D*qi - 0.01D*cand_idx*U('tp|'||ck) - 0.05D*U('tq|'||k)",
    "risk_a": "0.05D*cand_idx*U('d0|'||ck)",
    "risk_b": "0.04D*cand_idx*U('d1|'||ck)",
    "prob_a": "0.8D - 0.1D*qi - 0.02D*cand_idx*U('d0|'||ck) + 0.02D*sign(cand_idx)",
    "prob_b": "0.7D - 0.1D*qi - 0.04D*cand_idx*U('d1|'||ck) + 0.02D*sign(cand_idx)",
    "harm_a": "0.03D*cand_idx*U('d0|'||ck)",
    "gain_a": "0.03D*sign(cand_idx)*U('gna|'||ck)",
    "harm_b": "0.03D*cand_idx*U('d1|'||ck)",
    "gain_b": "0.03D*sign(cand_idx)*U('gnb|'||ck)",
    "proxy_error": "0.02D + 0.03D*cand_idx*U('px|'||ck) + 0.005D*qi",
    "complexity": "0.5D*U('cx|'||k)",
    "ce_a": "0.5D + 0.2D*qi + 0.02D*cand_idx*(U('ea|'||ck) - 0.4D)",
    "ce_b": "0.6D + 0.2D*qi + 0.02D*cand_idx*(U('eb|'||ck) - 0.4D)",
    "predicted_rate": "(U('pr|'||ck) - 0.7D)*0.2D*cand_idx",
    "predicted_regret": "(U('pg|'||ck) - 0.5D)*0.1D*cand_idx",
    "predicted_harm_logit": "8.0D*U('d0|'||ck)*U('d1|'||ck) - 6.0D",
    "action_prob": "U('ap|'||ck)",
    "clean_a": "U('c0|'||k) < 0.9D - 0.003D*cand_idx*U('cl|'||k)",
    "coded_bytes": "CAST(round(20000.0D + 8000.0D*U('cb|'||ck)) AS BIGINT)",
}

CODECS = ("h264", "h265")


def measurements(spark: SparkSession, sf_dir: str, *columns: str, codecs=("h264",), batches: bool = True) -> DataFrame:
    """One row per source x codec x qp x candidate, derived from every row of ``part``.

    The narrow ``part`` rows are spread by source before they are exploded, so later grouping by
    (source, ...) needs no further exchange; but behind digests taken in batches Spark does not know how rows lie, and
    exchanges them. Without ``batches`` digests take longer, and wide rows that are grouped stay where they are."""
    spread = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    spread = spread.repartition(parallelism(spark), "p_partkey").withColumnRenamed("p_partkey", "source_id")
    # A uniform value of the source alone is hashed once a source, not in each of its 30 rows a codec.
    values = {c: MEASURE[c] for c in columns}
    hashed = dict.fromkeys(u for v in values.values() for u in _OF_SOURCE.findall(v))
    hashed = {u: f"_u{i}" for i, u in enumerate(hashed)}
    values = {c: _OF_SOURCE.sub(lambda u: hashed[u.group()], v) for c, v in values.items()}
    spread = spread.withColumn("k", F.expr("CAST(source_id AS STRING)"))
    spread = spread.withColumns({name: F.expr(spark_sql(u)) for u, name in hashed.items()})
    # A cross join, not an explode: Spark multiplies the sizes of both sides, so it knows the rows are many.
    # After an explode it took them for as few as the rows of ``part`` and broadcast them in later joins.
    number = {c: CODECS.index(c) for c in codecs}
    offers = spark.range(30 * len(codecs)).selectExpr(
        f"element_at(array({', '.join(repr(c) for c in codecs)}), int(id DIV 30) + 1) AS codec",
        f"element_at(array({', '.join(str(number[c]) for c in codecs)}), int(id DIV 30) + 1) AS ci",
        "int(id DIV 6 % 5) AS qi", "int(id % 6) AS cand_idx",
    )
    grid = (
        spread.crossJoin(F.broadcast(offers))  # 30 rows a codec
        .selectExpr(
            "*",
            "30 + 5*qi AS qp",
            "concat(CASE ci WHEN 1 THEN 'h265|' ELSE '' END, CAST(source_id AS STRING),'|',30 + 5*qi,'|',cand_idx)"
            " AS ck",
        )
    )
    seeds = list(dict.fromkeys(seed for v in values.values() for seed in _OF_ROW.findall(v)))
    if batches and len(seeds) >= MANY_SEEDS:
        grid = grid.withColumn("_u", uniform_values(seeds)("ck"))
        values = {c: _OF_ROW.sub(lambda u: f"_u.u{seeds.index(u.group(1))}", v) for c, v in values.items()}
    return grid.selectExpr(
        "source_id", "codec", "qp", "cand_idx", *[f"{spark_sql(v)} AS {c}" for c, v in values.items()]
    )


def duck_measurements(*columns: str, codecs=("h264",), name: str = "m") -> str:
    """The same rows as a DuckDB common table expression."""
    values = ", ".join(f"{duck_sql(MEASURE[c])} AS {c}" for c in columns)
    codec_rows = ", ".join(f"('{c}', {CODECS.index(c)})" for c in codecs)
    return f"""{name}_grid AS (
  SELECT p_partkey AS source_id, p_brand, p_retailprice, c.codec, c.ci, qi, cand_idx, 30 + 5*qi AS qp,
         CAST(p_partkey AS VARCHAR) AS k,
         (CASE c.ci WHEN 1 THEN 'h265|' ELSE '' END)||CAST(p_partkey AS VARCHAR)||'|'||(30 + 5*qi)||'|'||cand_idx AS ck
  FROM part, (VALUES {codec_rows}) c(codec, ci), (SELECT unnest(range(0, 5)) AS qi) q,
       (SELECT unnest(range(0, 6)) AS cand_idx) d),
{name} AS MATERIALIZED (SELECT source_id, codec, qp, cand_idx{', ' if values else ''}{values} FROM {name}_grid)"""


def duck_bd(source: str, keys: str, name: str = "bd") -> str:
    """CTEs computing both deltas from ``source(keys, side 'a'|'t', rate, quality)``.

    Orthogonal polynomials again, but relational: one window pass per degree. The result ``name``
    has columns keys, bd_rate, bd_metric."""
    parts = []
    for kind, x, y in (("r", "quality", "ln(rate)"), ("m", "ln(rate)", "quality")):
        p = f"{name}_{kind}"
        w = f"(PARTITION BY {keys}, side)"
        parts.append(f"""{p}0 AS (
  SELECT {keys}, side, {x} AS x, {y} AS y FROM {source}
  WHERE rate > 0 AND isfinite(rate) AND isfinite(quality)),
{p}s AS (
  SELECT {keys}, side, count(*) AS n, count(DISTINCT x) AS nd, min(x) AS mn, max(x) AS mx FROM {p}0 GROUP BY ALL),
{p}b AS (
  SELECT {keys}, max(mn) AS lo, min(mx) AS hi, min(n) AS n, min(nd) AS nd, count(*) AS sides FROM {p}s GROUP BY ALL),
{p}1 AS (
  SELECT p.*, 1.0::DOUBLE AS p0, x - avg(x) OVER {w} AS p1, avg(x) OVER {w} AS a0, avg(y) OVER {w} AS c0,
         count(*) OVER {w} AS n FROM {p}0 p),
{p}2 AS (
  SELECT *, sum(p1*p1) OVER {w} AS n1, sum(y*p1) OVER {w} AS y1, sum(x*p1*p1) OVER {w} AS x1 FROM {p}1),
{p}3 AS (
  SELECT *, y1/nullif(n1,0) AS c1, x1/nullif(n1,0) AS a1, n1/n AS b1, (x - x1/nullif(n1,0))*p1 - n1/n AS p2
  FROM {p}2),
{p}4 AS (
  SELECT *, sum(p2*p2) OVER {w} AS n2, sum(y*p2) OVER {w} AS y2, sum(x*p2*p2) OVER {w} AS x2 FROM {p}3),
{p}5 AS (
  SELECT *, y2/nullif(n2,0) AS c2, x2/nullif(n2,0) AS a2, n2/nullif(n1,0) AS b2,
         (x - x2/nullif(n2,0))*p2 - n2/nullif(n1,0)*p1 AS p3 FROM {p}4),
{p}6 AS (
  SELECT *, sum(p3*p3) OVER {w} AS n3, sum(y*p3) OVER {w} AS y3 FROM {p}5),
{p}7 AS (
  SELECT {keys}, side, any_value(a0) AS a0, any_value(c0) AS c0, any_value(a1) AS a1, any_value(b1) AS b1,
         any_value(c1) AS c1, any_value(a2) AS a2, any_value(b2) AS b2, any_value(c2) AS c2,
         any_value(y3/nullif(n3,0)) AS c3 FROM {p}6 GROUP BY ALL),
{p}8 AS (
  SELECT {keys}, side, b.lo, b.hi, b.n AS nmin, b.nd AS ndmin, b.sides,
         least(CASE WHEN s.n >= 4 THEN 3 WHEN s.n = 3 THEN 2 ELSE 1 END, s.nd - 1) AS deg, f.*,
         (lo+hi)/2 - (hi-lo)/2/sqrt(3) AS t1, (lo+hi)/2 + (hi-lo)/2/sqrt(3) AS t2
  FROM {p}7 f JOIN {p}s s USING ({keys}, side) JOIN {p}b b USING ({keys})),
{p}9 AS (
  SELECT *, t1 - a0 AS u1, t2 - a0 AS v1, (t1 - a1)*(t1 - a0) - b1 AS u2, (t2 - a1)*(t2 - a0) - b1 AS v2 FROM {p}8),
{p}v AS (
  SELECT {keys}, side, lo, hi, nmin, ndmin, sides,
         c0 + CASE WHEN deg >= 1 THEN c1*(u1+v1)/2 ELSE 0 END + CASE WHEN deg >= 2 THEN c2*(u2+v2)/2 ELSE 0 END
         + CASE WHEN deg >= 3 THEN c3*((t1-a2)*u2 - b2*u1 + (t2-a2)*v2 - b2*v1)/2 ELSE 0 END AS mean
  FROM {p}9),
{p} AS (
  SELECT {keys}, CASE WHEN any_value(nmin) >= 2 AND any_value(ndmin) >= 2 AND any_value(sides) = 2
                       AND any_value(hi) > any_value(lo)
         THEN max(mean) FILTER (side = 't') - max(mean) FILTER (side = 'a') END AS raw
  FROM {p}v GROUP BY ALL),
{p}z AS (SELECT * EXCLUDE (raw), CASE WHEN abs(raw) < 1e-12 THEN 0 ELSE raw END AS gap FROM {p})""")
    keys_on = f"USING ({keys})"
    parts.append(
        f"{name} AS (SELECT {keys}, (exp({name}_rz.gap) - 1)*100 AS bd_rate, {name}_mz.gap AS bd_metric"
        f" FROM {name}_rz FULL JOIN {name}_mz {keys_on})"
    )
    return ",\n".join(parts)
