"""Queries of the placement and reduction probes, with their oracles; directions and grids stand in the SQL as numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rankmill.functions import kernels as K
from rankmill.operators import placement as P
from rankmill.operators import research
from rankmill.plans.catalogue import _RANK, AXES, BASE, DIM, SQL_FLAT, asked, query, scored, summed, truth, vectors

_TRUE = f"t AS (SELECT query_id, row_id FROM ({scored(SQL_FLAT)}))"
_PAIRS = "n AS (SELECT count(*) AS n FROM embeddings), pr AS (SELECT v.id AS a, (v.id * 7 + 1) % n AS b FROM v, n)"


def _pairs(v):
    """Each row with another one of the table; ids are numbered from 0."""
    return v.select(F.col("row_id").alias("a"), F.pmod(F.col("row_id") * 7 + 1, F.lit(v.count())).alias("b"))


def _numbers(row) -> str:
    return "[" + ", ".join(repr(float(x)) for x in row) + "]"


def _rounded(frame, *columns):
    return frame.select(*(F.round(c, 6).alias(c) if c in columns else c for c in frame.columns))


GRIDS = {"spiral": P.spiral(8), "random": research.directions(3, 8, 1)}
_GRID = ", ".join(f"('{n}', {i}, {_numbers(p)})" for n, g in GRIDS.items() for i, p in enumerate(g))


@query(f"""WITH {BASE}, {_PAIRS}, g(method, i, p) AS (VALUES {_GRID}), tr AS (SELECT v.id, u.k, v.x[3 * u.k + 1] AS x0, v.x[3 * u.k + 2] AS x1, v.x[3 * u.k + 3] AS x2 FROM v, range(21) AS u(k)),
ad AS (SELECT id, k, method, arg_max(i, x0 * p[1] + x1 * p[2] + x2 * p[3]) AS i FROM tr, g GROUP BY 1, 2, 3),
fa AS (SELECT pr.a, pr.b, x.method, sum(abs(x.i - y.i))::DOUBLE AS far FROM pr JOIN ad x ON x.id = pr.a JOIN ad y ON y.id = pr.b AND y.method = x.method AND y.k = x.k GROUP BY 1, 2, 3
UNION ALL SELECT pr.a, pr.b, 'sign', {summed('((q.x[i] > 0) <> (v.x[i] > 0))::INT')}::DOUBLE FROM pr JOIN v q ON q.id = pr.a JOIN v ON v.id = pr.b),
co AS (SELECT pr.a, pr.b, 1 - {SQL_FLAT} / q.norm / v.norm AS c FROM pr JOIN v q ON q.id = pr.a JOIN v ON v.id = pr.b),
rc AS (SELECT a, b, row_number() OVER (ORDER BY c, a, b) AS r FROM co), rf AS (SELECT a, b, method, row_number() OVER (PARTITION BY method ORDER BY far, a, b) AS r FROM fa)
SELECT method, round(corr(rf.r, rc.r), 4) AS rho FROM rf JOIN rc ON rf.a = rc.a AND rf.b = rc.b GROUP BY 1""")
def address_locality(spark, sf_dir):
    """EXP-4."""
    v = vectors(spark, sf_dir)
    return P.address_locality(v, _pairs(v), GRIDS).withColumn("rho", F.round("rho", 4))


@query(f"""WITH {BASE}, m AS (SELECT rk.pos, avg(CASE WHEN norm > 0 THEN rk.x / norm ELSE 0 END) AS m FROM rk JOIN v ON v.id = rk.id GROUP BY 1), l AS (SELECT sqrt(sum(m * m)) AS l FROM m)
SELECT pos::INT AS pos, round(m / l, 6) AS axis, round(l, 6) AS resultant FROM m, l""")
def mean_direction(spark, sf_dir):
    """EXP-5: the axis that a corpus shares."""
    return _rounded(P.mean_direction(vectors(spark, sf_dir)), "axis", "resultant")


def _router(arms, radii):
    axes = ", ".join(f"('{arm}', {i}, {_numbers(row)})" for arm, rows in arms.items() for i, row in enumerate(rows))
    return f"""WITH {BASE}, {_TRUE}, axes(arm, axis, d) AS (VALUES {axes}), p AS (SELECT v.id, arm, axis, {summed('v.x[i] * axes.d[i]')} AS x FROM v, axes),
e AS (SELECT arm, axis, min(x) AS low, max(x) AS high FROM p GROUP BY 1, 2),
b AS (SELECT id, p.arm, p.axis, greatest(0, least(15, floor((x - low) / (high - low) * 16)))::INT AS b FROM p JOIN e ON p.arm = e.arm AND p.axis = e.axis), z(radius) AS (VALUES {', '.join(f'({r})' for r in radii)}),
c AS (SELECT DISTINCT q.arm, radius, q.id AS query_id, d.id AS row_id FROM z, b AS q JOIN b AS d ON q.arm = d.arm AND q.axis = d.axis WHERE abs(q.b - d.b) <= radius AND q.id % 100 = 0),
rr AS (SELECT arm, radius::INT AS radius, round(count(*) / (SELECT count(*) FROM v WHERE id % 100 = 0), 6)::DOUBLE AS scanned, round(count(t.row_id) / (SELECT count(*) FROM t), 6)::DOUBLE AS recall
FROM c LEFT JOIN t ON t.query_id = c.query_id AND t.row_id = c.row_id GROUP BY 1, 2)"""


SHARED = K.unit(np.ones((1, DIM)))[0]
PLACED = {"random": AXES, "spiral": P.spiral_directions(DIM, 4, 2), "away": P.spiral_directions(DIM, 4, 2, SHARED)}


@query(f"{_router(PLACED, [0, 1])} SELECT * FROM rr")
def placed_routers(spark, sf_dir):
    """EXP-5: random directions, spiral ones, and spiral ones off a shared axis."""
    v = vectors(spark, sf_dir)
    return _rounded(P.router_recall(v, asked(v), truth(spark, sf_dir), PLACED, [0, 1]), "scanned", "recall")


_CUTS = ", ".join(str(i / 16) for i in range(1, 16))
_CALIBRATED = _router({"random": AXES}, [0, 1, 2]).replace("min(x) AS low, max(x) AS high", f"quantile_disc(x, [{_CUTS}]) AS cuts").replace("greatest(0, least(15, floor((x - low) / (high - low) * 16)))::INT AS b", "len(list_filter(cuts, lambda c: c < x))::INT AS b")


@query(f"{_CALIBRATED} SELECT * FROM rr")
def calibrated_router(spark, sf_dir):
    """EXP-5, CND-15: buckets between the quantiles of each projection."""
    v = vectors(spark, sf_dir)
    return _rounded(P.router_recall(v, asked(v), truth(spark, sf_dir), {"random": AXES}, [0, 1, 2], calibrated=True), "scanned", "recall")


#: Eight rows at right angles: the subspace in which directions are placed.
BASIS = np.linalg.qr(research.directions(DIM, 8, 5).T)[0].T
SUBSPACE = {k: P.subspace_directions(k, 6, 8, 3) for k in ("random", "net", "additive", "axes")}
LIFTED = {k: d @ BASIS for k, d in SUBSPACE.items()}


@query(f"{_router(LIFTED, [0, 1, 2])}, a AS (SELECT DISTINCT arm FROM rr) SELECT a.arm, coalesce(max(CASE WHEN scanned <= 0.8 * (SELECT count(*) FROM v) THEN recall END), 0) AS best FROM a JOIN rr ON rr.arm = a.arm GROUP BY 1")
def subspace_routers(spark, sf_dir):
    """EXP-7: the best recall of each rule that scans at most four fifths of the rows."""
    v = vectors(spark, sf_dir)
    found = _rounded(P.router_recall(v, asked(v), truth(spark, sf_dir), LIFTED, [0, 1, 2]), "scanned", "recall")
    return P.envelope(found, 0.8 * v.count())


_SUB = ", ".join(f"('{k}', {_numbers(row)})" for k, d in SUBSPACE.items() for row in d)


@query(f"""WITH s(arm, d) AS (VALUES {_SUB}), h AS (SELECT vec_id * 8 + i AS i, embedding[8 * i + 1 : 8 * i + 8]::DOUBLE[] AS n FROM embeddings, range(8) AS t(i)),
f AS (SELECT arm, i, avg((list_sum(list_transform(range(1, 9), lambda j: d[j] * n[j])) > 0)::INT) AS share FROM s, h GROUP BY 1, 2)
SELECT arm, round(max(abs(share - 0.5)), 6) AS discrepancy FROM f GROUP BY 1""")
def direction_discrepancy(spark, sf_dir):
    """EXP-7: how evenly each rule places its directions, by the half-spaces of all rows' eighths."""
    eighths = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    normals = vectors(spark, sf_dir).select(F.explode(eighths).alias("embedding"))
    return _rounded(P.half_space_discrepancy(normals, SUBSPACE), "discrepancy")


_FOOT = summed("abs(q.r[i] - v.r[i])")


@query(f"""WITH {BASE}, {_TRUE}, {_PAIRS}, f AS (SELECT t.query_id, {_FOOT} AS f FROM t JOIN v q ON q.id = t.query_id JOIN v ON v.id = t.row_id), g AS (SELECT query_id, list(f ORDER BY f)[count(*) // 2 + 1] AS m FROM f GROUP BY 1),
fx AS (SELECT {_FOOT} AS f FROM pr JOIN v q ON q.id = pr.a JOIN v ON v.id = pr.b), y AS (SELECT list(f ORDER BY f)[count(*) // 2 + 1]::DOUBLE AS random FROM fx)
SELECT round(avg(m), 6)::DOUBLE AS near, max(random) AS random, round(avg(m) / max(random), 6)::DOUBLE AS ratio FROM g, y""")
def rank_locality(spark, sf_dir):
    """EXP-6: how near in rank space true neighbours are."""
    v = vectors(spark, sf_dir)
    return _rounded(P.rank_locality(v, asked(v), truth(spark, sf_dir), _pairs(v)), "near", "ratio")


RADII = [800.0, 1000.0, 1200.0, 1400.0, 1600.0]


@query(f"""WITH {BASE}, f AS (SELECT {_FOOT} AS f FROM v q, v WHERE q.id % 100 = 0), r AS (SELECT unnest({RADII})::DOUBLE AS radius), c AS (SELECT radius, count(f) AS rows FROM r LEFT JOIN f ON f <= radius GROUP BY 1),
s AS (SELECT rows, lag(rows) OVER (ORDER BY radius) AS before FROM c) SELECT radius, rows, round((SELECT exp(avg(ln(rows / before))) FROM s WHERE before > 0), 6) AS growth FROM c""")
def rank_fan_out(spark, sf_dir):
    """EXP-6: how a neighbourhood grows."""
    v = vectors(spark, sf_dir)
    return _rounded(P.fan_out(v, asked(v), RADII), "growth")


BINS = [2, 3, 5, 8, 13, 21]


def _cut(bins):
    return f"""SELECT {bins}::INT AS bins, round(log2({bins}), 6) AS bits, round(count(o.row_id) / count(*), 6)::DOUBLE AS recall FROM t LEFT JOIN (SELECT * FROM (SELECT q.id AS query_id, v.id AS row_id,
row_number() OVER (PARTITION BY q.id ORDER BY {summed(f'abs((q.r[i] * {bins}) // 64 - (v.r[i] * {bins}) // 64)')}, v.id) AS n FROM v q, v WHERE q.id % 100 = 0) WHERE n <= 30) o ON o.query_id = t.query_id AND o.row_id = t.row_id"""


@query(f"WITH {BASE}, {_TRUE} {' UNION ALL '.join(map(_cut, BINS))}")
def rank_coarsening(spark, sf_dir):
    """EXP-6: what a number of bins finds."""
    v = vectors(spark, sf_dir)
    return _rounded(P.coarsening(v, asked(v), truth(spark, sf_dir), BINS, 30), "bits", "recall")


_FIRST = ", ".join(str(b) for b in BINS)


@query(f"WITH {BASE}, b AS (SELECT unnest([{_FIRST}]) AS bins), k AS (SELECT id, bins, list((r * bins) // 64 ORDER BY pos) AS c FROM rk, b WHERE pos < 6 GROUP BY 1, 2) SELECT bins::INT AS bins, count(DISTINCT c) AS codes FROM k GROUP BY 1")
def merged_codes(spark, sf_dir):
    """EXP-6: how codes of the first six coordinates fall together as bins get fewer."""
    v = vectors(spark, sf_dir).select(F.slice(_RANK(), 1, 6).alias("ranks"))
    return P.distinct_codes(v, DIM, BINS)
