"""Every query of the engine on the embeddings table, with its oracle for DuckDB.

The rows are all of embeddings; the stated query set is every vector whose id is divisible by 100. k is 10.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill.functions import encode as E
from rankmill.functions import kernels as K
from rankmill.operators import contingency as C
from rankmill.operators import evaluation as V
from rankmill.operators import mutate, nullmodel, research, search, validate
from rankmill.spec import CandidatePolicy

DIM, TOP, KEEP, STAGE = 64, 16, 10, 50
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


# ---- inputs


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding", "label")


def asked(v):
    return v.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")


def coded(v, bits, vector="embedding"):
    return v.withColumn("codes", E.bucket_codes(F.col(vector), DIM, bits))


def pairs(v, columns):
    """Every row beside every query, with columns(name) of both, as d and q."""
    rows, q = v.select("row_id", *columns("d")), asked(v).select("query_id", *columns("q"))
    return C.with_queries(rows, q)


# ---- oracle building blocks

BASE = """x AS (SELECT vec_id AS id, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
rk AS (SELECT id, pos, x, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN x = 0 THEN 0 ELSE x END, pos) - 1 AS r,
  row_number() OVER (PARTITION BY id ORDER BY CASE WHEN x = 0 THEN 0 ELSE x END DESC, pos) - 1 AS rq FROM x),
v AS (SELECT id, list(r ORDER BY pos) AS r, list(rq ORDER BY pos) AS rq, list(x ORDER BY pos) AS x, sqrt(sum(x * x)) AS norm FROM rk GROUP BY id)"""


def summed(expr: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {expr}))"


def scored(score: str, order: str = "DESC", k: int = KEEP, out: str = "round(s, 6)::DOUBLE", where: str = "TRUE") -> str:
    return f"""WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0),
s AS (SELECT q.id AS query_id, v.id AS row_id, {score} AS s FROM q, v WHERE {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, row_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, row_id, {out} AS score FROM t WHERE rank <= {k}"""


def code(side: str, bits: int) -> str:
    return f"(({side}.r[i] * {1 << bits}) // 64)"


def c2(side: str, bits: int) -> str:
    return f"(2 * {code(side, bits)} - {(1 << bits) - 1})"


UNIT = "(CASE WHEN q.norm <= 1e-12 THEN 0 ELSE q.x[i] / q.norm END)"
#: Squared norms as SQL, not as the engine works them out: of centred ranks, and of centred buckets over all ranks.
NORM2_RANK = "(SELECT sum((r - 31.5::DOUBLE) * (r - 31.5::DOUBLE)) FROM range(64) AS n(r))"


def norm2(bits: int) -> str:
    return f"(SELECT sum(pow((r * {1 << bits}) // 64 - {((1 << bits) - 1) / 2}::DOUBLE, 2)) FROM range(64) AS n(r))"


SQL_RANK_SYM = f"{summed('(2 * q.r[i] - 63) * (2 * v.r[i] - 63)')} / 4 / {NORM2_RANK}"
SQL_RANK_ASYM = f"({summed(f'{UNIT} * v.r[i]')} - 31.5 * {summed(UNIT)}) / sqrt({NORM2_RANK})"
SQL_FLAT = summed("q.x[i] * v.x[i]")
SQL_OVERLAP = summed(f"(q.rq[i] < {TOP} AND v.r[i] >= {64 - TOP})::INT")
SQL_HAMMING = summed("((q.x[i] > 0) <> (v.x[i] > 0))::INT")


def sql_sym(bits):
    return f"{summed(f'{c2("q", bits)} * {c2("v", bits)}')} / 4 / {norm2(bits)}"


def sql_asym(bits):
    return f"{summed(f'{UNIT} * ({code("v", bits)} - {((1 << bits) - 1) / 2})')} / sqrt({norm2(bits)})"


def rounded(found):
    return found.withColumn("score", F.round("score", 6))


# ---- encoders


def _encoder(name, column, sql):
    """One row per coordinate: (row_id, pos, value)."""

    def run(spark, sf_dir):
        return vectors(spark, sf_dir).select("row_id", F.posexplode(column()).alias("pos", "value")).select("row_id", "pos", F.col("value").cast("long").alias("value"))

    query(f"WITH {BASE} {sql}", name)(run)


_RANK = lambda: E.rank_transform(F.col("embedding"))
_encoder("rank_transform", _RANK, "SELECT id AS row_id, pos::INT AS pos, r::BIGINT AS value FROM rk")
for _b in (1, 2, 4, 8):
    _encoder(f"bucket_codes_b{_b}", lambda b=_b: E.bucket_codes(F.col("embedding"), DIM, b), f"SELECT id AS row_id, pos::INT AS pos, ((r * {1 << _b}) // 64)::BIGINT AS value FROM rk")
_PACKED = "SELECT id AS row_id, (pos // 4)::INT AS pos, sum(((r * 4) // 64) * (64 >> (2 * (pos % 4)::INT)))::BIGINT AS value FROM rk GROUP BY 1, 2"
_encoder("pack_codes_b2", lambda: E.from_binary(E.to_binary(E.packed_bytes(E.bucket_codes(F.col("embedding"), DIM, 2), DIM, 2))), _PACKED)
_encoder("unpack_codes_b2", lambda: E.unpack_bytes(E.packed_bytes(E.bucket_codes(F.col("embedding"), DIM, 2), DIM, 2), DIM, 2), "SELECT id AS row_id, pos::INT AS pos, ((r * 4) // 64)::BIGINT AS value FROM rk")
_WORD = "SELECT id AS row_id, 0::INT AS pos, bit_or(CASE WHEN {c} THEN CASE WHEN pos = 63 THEN -9223372036854775808 ELSE 1::BIGINT << pos::INT END ELSE 0 END)::BIGINT AS value FROM rk GROUP BY id"
_encoder("doc_top_bitmap", lambda: E.top_bits_of_doc(_RANK(), DIM, TOP), _WORD.format(c=f"r >= {64 - TOP}"))
_encoder("query_top_bitmap", lambda: E.top_bits_of_query(F.col("embedding"), DIM, TOP), _WORD.format(c=f"rq < {TOP}"))
_encoder("sign_bitmap", lambda: E.sign_bits(F.col("embedding"), DIM), _WORD.format(c="x > 0"))
_encoder("bucket_range_bitmap", lambda: E.bucket_range_bits(E.bucket_codes(F.col("embedding"), DIM, 2), DIM, 1, 2), _WORD.format(c="(r * 4) // 64 BETWEEN 1 AND 2"))
_encoder("multi_bucket_bitmaps_b2", lambda: F.flatten(E.multi_bucket_bits(E.bucket_codes(F.col("embedding"), DIM, 2), DIM, 2)),
         "SELECT id AS row_id, b::INT AS pos, bit_or(CASE WHEN (r * 4) // 64 = b THEN CASE WHEN pos = 63 THEN -9223372036854775808 ELSE 1::BIGINT << pos::INT END ELSE 0 END)::BIGINT AS value FROM rk, range(4) AS t(b) GROUP BY id, b")
_encoder("fastscan_nibbles", lambda: E.pair_nibbles(E.bucket_codes(F.col("embedding"), DIM, 2), DIM), "SELECT id AS row_id, (pos // 2)::INT AS pos, sum(((r * 4) // 64) * CASE WHEN pos % 2 = 0 THEN 4 ELSE 1 END)::BIGINT AS value FROM rk GROUP BY 1, 2")
_encoder("top_membership", lambda: F.transform(E.top_membership(E.bucket_codes(F.col("embedding"), DIM, 2), 4), lambda x: x.cast("int")), "SELECT id AS row_id, pos::INT AS pos, ((r * 4) // 64 = 3)::BIGINT AS value FROM rk")


@query(f"WITH {BASE} SELECT rk.id AS row_id, pos::INT AS pos, round(CASE WHEN norm <= 1e-12 THEN 0 ELSE rk.x / norm END, 6) AS value FROM rk JOIN v ON rk.id = v.id")
def l2_normalise(spark, sf_dir):
    return vectors(spark, sf_dir).select("row_id", F.posexplode(E.l2_normalise(F.col("embedding"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {BASE} SELECT pos::INT AS pos, round(avg(x), 6) AS mean FROM rk GROUP BY pos")
def coord_mean(spark, sf_dir):
    return research.coordinate_means(vectors(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"))


@query(f"""WITH {BASE}, m AS (SELECT pos, avg(x) AS m FROM rk GROUP BY pos),
c AS (SELECT id, rk.pos, row_number() OVER (PARTITION BY id ORDER BY (x - m)::FLOAT, rk.pos) - 1 AS r FROM rk JOIN m ON rk.pos = m.pos)
SELECT id AS row_id, pos::INT AS pos, ((r * 4) // 64)::BIGINT AS value FROM c""")
def centred_codes(spark, sf_dir):
    c = coded(research.centre(vectors(spark, sf_dir)), 2)
    return c.select("row_id", F.posexplode("codes").alias("pos", "value")).select("row_id", "pos", F.col("value").cast("long").alias("value"))


# ---- searches


def _search(name, scorer, sql, order="DESC", k=KEEP):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        return rounded(search.search(v, asked(v), scorer(), k))

    query(scored(sql, order, k), name)(run)


_search("rank_search_sym", lambda: K.rank_symmetric(DIM), SQL_RANK_SYM)
_search("rank_search_asym", lambda: K.rank_asymmetric(DIM), SQL_RANK_ASYM)
for _b in (1, 2, 4):
    _search(f"rankquant_search_sym_b{_b}", lambda b=_b: K.bucket_symmetric(DIM, b), sql_sym(_b))
for _b in (1, 2, 4, 8):
    _search(f"rankquant_search_asym_b{_b}", lambda b=_b: K.bucket_asymmetric(DIM, b), sql_asym(_b))
_search("rankquant_eval_b3", lambda: K.bucket_any_bits(DIM, 3), sql_sym(3))
_search("rankquant_byte_lut_b2", lambda: K.bucket_asymmetric(DIM, 2), sql_asym(2))
_search("bitmap_search", lambda: K.bitmap_overlap(TOP), SQL_OVERLAP)
_search("sign_search", K.sign_hamming, SQL_HAMMING, "ASC")
_search("flat_inner_product_topk", K.inner_product, SQL_FLAT)
_search("code_l1_search", lambda: K.code_l1(2), summed(f"abs({code('q', 2)} - {code('v', 2)})"), "ASC")
_search("footrule_search", K.footrule, summed("abs(q.r[i] - v.r[i])"), "ASC")

FASTSCAN = f"""WITH {BASE}, q AS (SELECT id, list_transform(range(1, 65), lambda i: CASE WHEN norm <= 1e-12 THEN 0 ELSE x[i] / norm END) AS u FROM v WHERE id % 100 = 0),
l AS (SELECT q.id, p, c, q.u[2 * p + 1] * (c // 4 - 1.5::DOUBLE) + q.u[2 * p + 2] * (c % 4 - 1.5::DOUBLE) AS t FROM q, range(32) AS a(p), range(16) AS b(c)),
g AS (SELECT id, min(t) AS low, CASE WHEN max(t) > min(t) THEN 255 / (max(t) - min(t)) ELSE 1 END AS scale FROM l GROUP BY id),
u AS (SELECT l.id, p, c, least(255, greatest(0, floor((t - low) * scale + 0.5)))::BIGINT AS e FROM l JOIN g ON l.id = g.id),
n AS (SELECT id, pos // 2 AS p, sum(((r * 4) // 64) * CASE WHEN pos % 2 = 0 THEN 4 ELSE 1 END)::BIGINT AS c FROM rk GROUP BY 1, 2),
s AS (SELECT u.id AS query_id, n.id AS row_id, sum(e) AS acc FROM u JOIN n ON u.p = n.p AND u.c = n.c GROUP BY 1, 2),
t AS (SELECT query_id, row_id, (low * 32 + acc / scale) / sqrt({norm2(2)}) AS s, row_number() OVER (PARTITION BY query_id ORDER BY acc DESC, row_id) AS rank FROM s JOIN g ON s.query_id = g.id)
SELECT query_id, rank::INT AS rank, row_id, round(s, 6) AS score FROM t WHERE rank <= {KEEP}"""


@query(FASTSCAN)
def fastscan_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(search.search(v, asked(v), K.pair_scan(DIM), KEEP))


def _lists(name, scorer, sql, order):
    """(query_id, pos, row_id): candidates without scores."""

    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        return search.candidates(v, asked(v), scorer(), STAGE)

    query(f"SELECT query_id, (rank - 1)::INT AS pos, row_id FROM ({scored(sql, order, STAGE)})", name)(run)


_lists("bitmap_top_m", lambda: K.bitmap_overlap(TOP), SQL_OVERLAP, "DESC")
_lists("sign_top_m", K.sign_hamming, SQL_HAMMING, "ASC")


@query(f"""WITH c AS (SELECT query_id, list(row_id ORDER BY rank) AS l FROM ({scored(SQL_HAMMING, 'ASC', STAGE)}) GROUP BY 1),
o AS (SELECT *, sum(len(l)) OVER (ORDER BY query_id) AS e FROM c) SELECT query_id, (e - len(l))::BIGINT AS start, e::BIGINT AS "end", array_to_string(l, ',') AS candidates FROM o""")
def sign_top_m_csr(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = search.csr(search.candidates(v, asked(v), K.sign_hamming(), STAGE))
    return c.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(f"WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0) SELECT q.id AS query_id, v.id AS row_id, (64 - {SQL_HAMMING})::INT AS score FROM q, v")
def sign_score_all(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.score_all(v, asked(v), K.sign_hamming()).select("query_id", "row_id", (DIM - F.col("score")).cast("int").alias("score"))


# ---- given candidates: for each query, the 50 nearest by sign bits, some of them twice


def listed(v):
    c = search.candidates(v, asked(v), K.sign_hamming(), STAGE)
    return c.union(c.where("pos % 10 = 0").withColumn("pos", F.col("pos") + STAGE))


_LISTED = f"""{BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0), h AS (SELECT q.id AS query_id, v.id AS row_id, row_number() OVER (PARTITION BY q.id ORDER BY {SQL_HAMMING}, v.id) - 1 AS pos FROM q, v),
c AS (SELECT query_id, pos, row_id FROM h WHERE pos < {STAGE} UNION ALL SELECT query_id, pos + {STAGE}, row_id FROM h WHERE pos < {STAGE} AND pos % 10 = 0)"""


def subset_sql(score, k=KEEP):
    return f"""WITH {_LISTED}, s AS (SELECT c.query_id, c.pos, c.row_id, {score} AS s FROM c JOIN q ON q.id = c.query_id JOIN v ON v.id = c.row_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id, pos) AS rank FROM s)
SELECT query_id, rank::INT AS rank, row_id, round(s, 6)::DOUBLE AS score FROM t WHERE rank <= {k}"""


@query(subset_sql(sql_asym(2)))
def rankquant_subset_b2(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(search.search_subset(v, asked(v), listed(v), K.bucket_asymmetric(DIM, 2), KEEP))


@query(subset_sql(sql_asym(2), 55))
def subset_with_duplicates(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(search.search_subset(v, asked(v), listed(v), K.bucket_asymmetric(DIM, 2), 55))


@query(f"""WITH g AS (SELECT vec_id AS query_id, unnest(range(1, 81))::INT AS rank FROM embeddings WHERE vec_id % 100 = 0)
SELECT g.query_id, g.rank, coalesce(row_id, -1) AS row_id, coalesce(score, '-inf'::DOUBLE) AS score FROM g LEFT JOIN ({subset_sql(sql_asym(2), 80)}) s ON g.query_id = s.query_id AND g.rank = s.rank""")
def subset_padded_grid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.padded(rounded(search.search_subset(v, asked(v), listed(v), K.bucket_asymmetric(DIM, 2), 80)), asked(v), 80)


@query(subset_sql(SQL_OVERLAP))
def bitmap_search_subset(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.search_subset(v, asked(v), listed(v), K.bitmap_overlap(TOP), KEEP)


@query(f"WITH {_LISTED} SELECT c.query_id, c.pos::INT AS pos, c.row_id, ({SQL_OVERLAP})::DOUBLE AS score FROM c JOIN q ON q.id = c.query_id JOIN v ON v.id = c.row_id")
def bitmap_overlap_subset(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.score_candidates(v, asked(v), listed(v), K.bitmap_overlap(TOP))


# ---- two stages


def stage_sql(first, order, second, m, second_order="DESC"):
    return f"""WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0),
h AS (SELECT q.id AS query_id, v.id AS row_id, row_number() OVER (PARTITION BY q.id ORDER BY {first} {order}, v.id) AS pos FROM q, v),
s AS (SELECT query_id, row_id, {second} AS s FROM h JOIN q ON q.id = h.query_id JOIN v ON v.id = h.row_id WHERE pos <= {m}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {second_order}, row_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, row_id, round(s, 6)::DOUBLE AS score FROM t WHERE rank <= {KEEP}"""


def _two(name, first, first_sql, order, m):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        count = CandidatePolicy().candidate_count(KEEP, v.count()) if m is None else m
        return rounded(search.two_stage(v, asked(v), first(), K.bucket_asymmetric(DIM, 2), count, KEEP))

    query(stage_sql(first_sql, order, sql_asym(2), m or 320), name)(run)


_two("two_stage_sign_b2", K.sign_hamming, SQL_HAMMING, "ASC", STAGE)
_two("two_stage_bitmap_b2", lambda: K.bitmap_overlap(TOP), SQL_OVERLAP, "DESC", STAGE)
_two("two_stage_policy", K.sign_hamming, SQL_HAMMING, "ASC", None)


@query(stage_sql(sql_asym(2), "DESC", f"{summed(f'CASE WHEN q.rq[i] < {TOP} THEN list_sum(list_transform(range(1, 65), lambda j: CASE WHEN q.rq[j] < {TOP} AND q.r[i] > q.r[j] AND v.r[i] < v.r[j] THEN 1 ELSE 0 END)) ELSE 0 END')} / {TOP * (TOP - 1) // 2}.0", STAGE, "ASC"))
def tau_rerank(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(search.two_stage(v, asked(v), K.bucket_asymmetric(DIM, 2), K.tau_on_query_top(TOP), STAGE, KEEP))


# ---- contingency tables

CELLS = f"""{BASE}, q AS (SELECT id, pos, (r * 4) // 64 AS a FROM rk WHERE id % 100 = 0), e AS (SELECT id, pos, (r * 4) // 64 AS b FROM rk),
p AS (SELECT q.id AS query_id, e.id AS row_id, a, b, count(*) AS n FROM q JOIN e ON q.pos = e.pos GROUP BY 1, 2, 3, 4),
z AS (SELECT i.query_id, i.row_id, a.a, b.b, coalesce(p.n, 0)::BIGINT AS n FROM (SELECT DISTINCT query_id, row_id FROM p) i CROSS JOIN range(4) AS a(a) CROSS JOIN range(4) AS b(b)
  LEFT JOIN p ON p.query_id = i.query_id AND p.row_id = i.row_id AND p.a = a.a AND p.b = b.b)"""


def tables(spark, sf_dir):
    """The table of each pair, a column a cell, from bitmaps of the buckets."""
    v = coded(C.dealt(vectors(spark, sf_dir)), 2).withColumn("bits", E.multi_bucket_bits(F.col("codes"), DIM, 2))
    return C.counted(pairs(v, lambda name: C.word_columns(F.col("bits"), 4, DIM // 64, name)), 4, DIM // 64)


@query(f"WITH {CELLS} SELECT query_id, row_id, a::INT AS a, b::INT AS b, n FROM z")
def contingency_table(spark, sf_dir):
    return C.cells(tables(spark, sf_dir), 4)


@query(f"WITH {CELLS} SELECT query_id, row_id, coalesce(a::INT, -1) AS a, coalesce(b::INT, -1) AS b, sum(n)::BIGINT AS n FROM z GROUP BY GROUPING SETS ((query_id, row_id, a), (query_id, row_id, b), (query_id, row_id))")
def contingency_margins(spark, sf_dir):
    return C.margins(tables(spark, sf_dir), 4).fillna(-1, ["a", "b"])


@query(f"WITH {CELLS} SELECT query_id, row_id, (a // 2)::INT AS a, (b // 2)::INT AS b, sum(n)::BIGINT AS n FROM z GROUP BY 1, 2, 3, 4")
def contingency_coarsened(spark, sf_dir):
    return C.coarsened(tables(spark, sf_dir), 4, 2)


@query(f"""WITH {CELLS} SELECT query_id, row_id, sum(CASE WHEN a = 3 AND b = 3 THEN n ELSE 0 END)::BIGINT AS top, sum(CASE WHEN a = b THEN n ELSE 0 END)::BIGINT AS diagonal,
sum(CASE WHEN abs(a - b) <= 1 THEN n ELSE 0 END)::BIGINT AS band_1, sum(CASE WHEN a >= 2 AND b >= 2 THEN n ELSE 0 END)::BIGINT AS top_group_2, sum(abs(a - b) * n)::BIGINT AS l1,
(sum((2 * a - 3) * (2 * b - 3) * n) / 4)::DOUBLE AS symmetric FROM z GROUP BY 1, 2""")
def projections_named(spark, sf_dir):
    c = C.cell_columns(4)
    return tables(spark, sf_dir).select("query_id", "row_id", C.top_overlap(c, 4).alias("top"), C.diagonal_agreement(c, 4).alias("diagonal"), C.band_agreement(c, 4, 1).alias("band_1"),
        C.top_group_overlap(c, 4, 2).alias("top_group_2"), C.bucket_l1(c, 4).alias("l1"), C.symmetric_score(c, 4).alias("symmetric"))


@query(f"WITH {CELLS} SELECT query_id, row_id, sum((a + 1) * (2 * b - 3) * n)::DOUBLE AS score FROM z GROUP BY 1, 2")
def projection_weighted(spark, sf_dir):
    w = [float((a + 1) * (2 * b - 3)) for a in range(4) for b in range(4)]
    return tables(spark, sf_dir).select("query_id", "row_id", C.project(C.cell_columns(4), w).alias("score"))


@query(f"WITH {CELLS} SELECT query_id, row_id, a::INT AS a, b::INT AS b, n FROM z")
def contingency_from_bitmaps(spark, sf_dir):
    return C.cells(tables(spark, sf_dir), 4)


@query(f"WITH {CELLS} SELECT query_id, row_id, a::INT AS bucket, n FROM z WHERE a = b")
def diagonal_overlap(spark, sf_dir):
    return tables(spark, sf_dir).select("query_id", "row_id", F.posexplode(F.array(*C.cell_columns(4)[::5])).alias("bucket", "n"))


@query(f"""WITH {CELLS} SELECT query_id, row_id, (sum((2 * a - 3) * (2 * b - 3) * n) / 4)::DOUBLE AS outer_score, sum(CASE WHEN a = b THEN n ELSE 0 END)::DOUBLE AS diagonal_score,
(sum(CASE WHEN abs(a - b) <= 1 THEN (2 * a - 3) * (2 * b - 3) * n ELSE 0 END) / 4)::DOUBLE AS banded_score FROM z GROUP BY 1, 2""")
def project_all(spark, sf_dir):
    c = C.cell_columns(4)  # one table for all projections
    return tables(spark, sf_dir).select("query_id", "row_id", C.project(c, C.outer_weights(2)).alias("outer_score"), C.project(c, C.diagonal_weights(2)).alias("diagonal_score"), C.project(c, C.banded_weights(2, 1)).alias("banded_score"))


@query(scored(f"{summed(f'CASE WHEN abs({code("q", 2)} - {code("v", 2)}) <= 1 THEN {c2("q", 2)} * {c2("v", 2)} ELSE 0 END')} / 4"))
def bilinear_top_m(spark, sf_dir):
    v, w = vectors(spark, sf_dir), C.banded_weights(2, 1)
    return rounded(search.search(v, asked(v), K.bilinear(2, [w[i : i + 4] for i in range(0, 16, 4)]), KEEP))


# ---- null model

_FACT = "CASE WHEN {n} < 0 OR {k} < 0 OR {k} > {n} THEN 0::DOUBLE ELSE round(exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))) END"
_NULL = f"f AS (SELECT o, {_FACT.format(n=TOP, k='o')} * {_FACT.format(n=DIM - TOP, k=f'({TOP} - o)')} AS c FROM range({TOP + 1}) AS t(o)), p AS (SELECT o, sum(c) OVER (ORDER BY o DESC) / sum(c) OVER () AS p FROM f)"


@query(f"""WITH {BASE}, {_NULL}, q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT {SQL_OVERLAP} AS o, count(*) AS n FROM q, v GROUP BY 1), a AS (SELECT sum(n) AS a FROM s)
SELECT {DIM}::INT AS dim, {TOP}::INT AS weight, p.o::INT AS overlap, round(p, 9) AS tail_prob, coalesce(n, 0)::BIGINT AS seen, round((SELECT coalesce(sum(n), 0) FROM s WHERE s.o >= p.o) / a, 9)::DOUBLE AS seen_share FROM p LEFT JOIN s ON s.o = p.o, a""")
def overlap_null_table(spark, sf_dir):
    """What chance says of each overlap, beside how often queries and rows have it."""
    v = vectors(spark, sf_dir)
    seen = search.histogram(v, asked(v), K.bitmap_overlap(TOP)).groupBy(F.col("score").alias("overlap")).agg(F.sum("n").alias("seen"))
    t = nullmodel.with_seen(nullmodel.null_table(spark, DIM, TOP), seen)
    return t.select("dim", "weight", "overlap", F.round("tail_prob", 9).alias("tail_prob"), "seen", F.round("seen_share", 9).alias("seen_share"))


@query(f"WITH {_NULL} SELECT s.query_id, s.rank, s.row_id, s.score, round(p.p, 9) AS tail_prob FROM ({scored(SQL_OVERLAP)}) s JOIN p ON p.o = s.score")
def overlap_tail_prob(spark, sf_dir):
    found = QUERIES["bitmap_search"](spark, sf_dir)
    return nullmodel.with_tail_probability(found, DIM, TOP).withColumn("tail_prob", F.round("tail_prob", 9))


@query(f"WITH {CELLS}, w AS (SELECT unnest([1, 2, 3]) AS w) SELECT query_id, row_id, w::INT AS width, sum(CASE WHEN a >= 4 - w AND b >= 4 - w THEN n ELSE 0 END)::BIGINT AS n FROM z, w GROUP BY 1, 2, 3")
def top_group_overlap(spark, sf_dir):
    v = coded(C.dealt(vectors(spark, sf_dir)), 2).withColumn("bits", nullmodel.top_group_bits(F.col("codes"), DIM, 4, [1, 2, 3]))
    p = pairs(v, lambda name: C.word_columns(F.col("bits"), 3, DIM // 64, name))
    p = p.select("query_id", "row_id", F.posexplode(F.array(*(C.shared(i, i, DIM // 64) for i in range(3)))).alias("i", "n"))
    return p.select("query_id", "row_id", (F.col("i") + 1).alias("width"), "n")


# ---- evaluation


def truth(spark, sf_dir, k=KEEP):
    v = vectors(spark, sf_dir)
    return search.search(v, asked(v), K.inner_product(), k)


def recall_sql(pred, k=KEEP):
    return f"""SELECT t.query_id, round(count(p.row_id) / {k}, 6)::DOUBLE AS recall FROM ({scored(SQL_FLAT, 'DESC', k)}) t LEFT JOIN (SELECT DISTINCT query_id, row_id FROM ({pred})) p
ON t.query_id = p.query_id AND t.row_id = p.row_id GROUP BY 1"""


@query(recall_sql(scored(sql_asym(2))))
def recall_at_k(spark, sf_dir):
    return V.recall_at(QUERIES["rankquant_search_asym_b2"](spark, sf_dir), truth(spark, sf_dir), KEEP).withColumn("recall", F.round("recall", 6))


@query(recall_sql(scored(SQL_HAMMING, "ASC", STAGE)))
def candidate_recall(spark, sf_dir):
    return V.recall_at(QUERIES["sign_top_m"](spark, sf_dir), truth(spark, sf_dir), KEEP).withColumn("recall", F.round("recall", 6))


@query(recall_sql(stage_sql(SQL_HAMMING, "ASC", sql_asym(2), STAGE)))
def ann_recall(spark, sf_dir):
    return V.recall_at(QUERIES["two_stage_sign_b2"](spark, sf_dir), truth(spark, sf_dir), KEEP).withColumn("recall", F.round("recall", 6))


def judged(spark, sf_dir):
    """A row is relevant to a query of its label."""
    v = vectors(spark, sf_dir)
    return asked(v).select("query_id", "label").join(v.select(F.col("row_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", F.lit(1).alias("rel"))


def per_query(spark, sf_dir, name="rankquant_search_asym_b2"):
    run = QUERIES[name](spark, sf_dir).select("query_id", F.col("row_id").alias("doc_id"), "score")
    return V.metrics_at(run, judged(spark, sf_dir), KEEP)


def metric_sql(run):
    return f"""WITH run AS ({run}), j AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 100 = 0),
n AS (SELECT query_id, count(*) AS rel, sum(1) AS x FROM j GROUP BY 1), i AS (SELECT query_id, rel, (SELECT sum(1 / log2(k + 1)) FROM range(1, {KEEP + 1}) AS t(k) WHERE k <= rel) AS idcg FROM n),
o AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM run),
h AS (SELECT o.query_id, rank, count(*) OVER (PARTITION BY o.query_id ORDER BY rank) AS hits FROM o JOIN j ON j.query_id = o.query_id AND j.doc_id = o.row_id),
a AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, sum(hits / rank) AS ap, count(*) AS n, 1 / min(rank) AS mrr FROM h GROUP BY 1)
SELECT i.query_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg, round(coalesce(ap, 0) / rel, 6) AS map, round(coalesce(n, 0) / rel, 6) AS recall, round(coalesce(n, 0) / {KEEP}, 6) AS precision, round(coalesce(mrr, 0), 6) AS mrr
FROM i LEFT JOIN a ON i.query_id = a.query_id"""


_METRICS = metric_sql(scored(sql_asym(2)))
for _name, _metric in (("ndcg_at_10", "ndcg"), ("map_at_10", "map"), ("mrr_at_10", "mrr"), ("precision_at_10", "precision")):

    def _one(spark, sf_dir, metric=_metric):
        return per_query(spark, sf_dir).select("query_id", F.round(metric, 6).alias(metric))

    query(f"SELECT query_id, {_metric} FROM ({_METRICS})", _name)(_one)

_METHODS = {"rankquant_search_asym_b2": scored(sql_asym(2)), "flat_inner_product_topk": scored(SQL_FLAT)}


@query("SELECT coalesce(method, 'all') AS method, coalesce(query_id::VARCHAR, 'all') AS query_id, round(avg(ndcg), 5) AS ndcg FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, ndcg FROM ({metric_sql(s)})" for m, s in _METHODS.items()) + ") GROUP BY ROLLUP (method, query_id)")
def metric_rollup(spark, sf_dir):
    parts = [per_query(spark, sf_dir, m).withColumn("method", F.lit(m)) for m in _METHODS]
    return V.rolled_up(parts[0].union(parts[1]), ["method", "query_id"], "ndcg").select(F.coalesce("method", F.lit("all")).alias("method"), F.coalesce(F.col("query_id").cast("string"), F.lit("all")).alias("query_id"), F.round("ndcg", 5).alias("ndcg"))


# ---- checks


@query(f"WITH {BASE}, c AS (SELECT id, (r * 4) // 64 AS b, count(*) AS n FROM rk GROUP BY 1, 2) SELECT id AS row_id, (count(*) = 4 AND min(n) = 16 AND max(n) = 16) AS balanced FROM c GROUP BY id")
def composition_check(spark, sf_dir):
    return coded(vectors(spark, sf_dir), 2).select("row_id", validate.is_balanced(F.col("codes"), DIM, 4).alias("balanced"))


@query(f"WITH {BASE} SELECT id AS row_id, (count(DISTINCT r) = 64 AND min(r) = 0 AND max(r) = 63) AS permutation FROM rk GROUP BY id")
def permutation_check(spark, sf_dir):
    return vectors(spark, sf_dir).select("row_id", validate.is_permutation(_RANK(), DIM).alias("permutation"))


@query(f"WITH {BASE} SELECT id AS row_id, sum((r >= {64 - TOP})::INT)::BIGINT AS ones FROM rk GROUP BY id")
def popcount_check(spark, sf_dir):
    return vectors(spark, sf_dir).select("row_id", validate.popcount(E.top_bits_of_doc(_RANK(), DIM, TOP)).alias("ones"))


@query("SELECT vec_id + 250 AS row_id FROM embeddings WHERE vec_id + 250 NOT IN (SELECT vec_id FROM embeddings)")
def candidate_range_check(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return validate.unknown_candidates(v.select((F.col("row_id") + 250).alias("row_id")), v)


@query("SELECT vec_id AS row_id FROM embeddings WHERE sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) NOT BETWEEN 0.999 AND 1.001")
def unit_length_check(spark, sf_dir):
    return validate.unit_length_issues(vectors(spark, sf_dir), DIM)


# ---- growing and shrinking


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS row_id, vec_id AS source FROM embeddings UNION ALL SELECT vec_id + n, vec_id FROM embeddings, n")
def append_rows(spark, sf_dir):
    t = mutate.with_row_ids(vectors(spark, sf_dir).select(F.col("row_id").alias("source")), "source").select("row_id", "source")
    return mutate.append(t, t.select("source"), "source").select(F.col("row_id").cast("long").alias("row_id"), "source")


@query("SELECT CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN 7 ELSE vec_id END AS row_id, vec_id AS source FROM embeddings WHERE vec_id <> 7")
def swap_remove(spark, sf_dir):
    return mutate.swap_remove(vectors(spark, sf_dir).select("row_id", F.col("row_id").alias("source")), 7)


# ---- analyses


@query(f"""WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT q.id AS query_id, sqrt(greatest(0, 2 - 2 * {SQL_FLAT})) AS d FROM q, v WHERE q.id <> v.id),
t AS (SELECT query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d) AS k FROM s), m AS (SELECT max(CASE WHEN k = 2 THEN d END) / max(CASE WHEN k = 1 THEN d END) AS mu FROM t WHERE k <= 2 GROUP BY query_id),
o AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT round(sum(x * -ln(1 - i / n)) / sum(x * x), 5) AS dimension FROM o WHERE i < greatest(1, floor(n * 0.9))""")
def twonn_dimension(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return spark.createDataFrame([(research.twonn(v, asked(v)),)], "dimension double").select(F.round("dimension", 5).alias("dimension"))


def tops(v):
    """(row_id, top): the places of each row's TOP largest coordinates. Ranks are worked out once a row, not once a place."""
    top = E.let(_RANK(), lambda r: F.filter(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.get(r, i) >= DIM - TOP))
    return v.select("row_id", top.alias("top"))


@query(f"WITH {BASE}, f AS (SELECT pos, count(*) AS c FROM rk WHERE r >= {64 - TOP} GROUP BY pos), n AS (SELECT count(*) AS n FROM v) SELECT max(n) AS rows, {TOP}::DOUBLE AS weight, round(sum((c / n) ** 2), 6) AS expected_by_frequency FROM f, n")
def overlap_decomposition(spark, sf_dir):
    return research.overlap_decomposition(tops(vectors(spark, sf_dir))).withColumn("expected_by_frequency", F.round("expected_by_frequency", 6))


_TOPS = summed(f"(q.r[i] >= {64 - TOP} AND v.r[i] >= {64 - TOP})::INT")


@query(f"""WITH {BASE}, f AS (SELECT pos, count(*)::DOUBLE AS c FROM rk WHERE r >= {64 - TOP} GROUP BY pos), n AS (SELECT count(*)::DOUBLE AS n FROM v),
e AS (SELECT sum((c / n) ** 2) AS own, sum(c * (c - 1)) / max(n * (n - 1)) AS seen FROM f, n),
s AS (SELECT q.id AS query_id, {_TOPS} AS o, row_number() OVER (PARTITION BY q.id ORDER BY {SQL_FLAT} DESC, v.id) AS k FROM v AS q, v WHERE q.id % 100 = 0 AND q.id <> v.id),
t AS (SELECT avg(o) AS o FROM s WHERE k <= {KEEP})
SELECT n::BIGINT AS rows, {TOP * TOP / DIM!r}::DOUBLE AS expected_uniform, round(own, 6) AS expected_by_frequency, round(seen, 6) AS observed_random, round(o, 6) AS observed_neighbours FROM e, t, n""")
def overlap_levels(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = research.overlap_levels(tops(v), research.true_neighbours(v, asked(v), KEEP), DIM)
    return found.select("rows", "expected_uniform", *(F.round(c, 6).alias(c) for c in ("expected_by_frequency", "observed_random", "observed_neighbours")))


@query(f"""WITH {BASE}, m AS (SELECT pos, avg(x) AS m FROM rk GROUP BY pos),
c AS (SELECT id, sum(CASE WHEN x > m THEN 1 << rk.pos::INT ELSE 0 END)::BIGINT AS cell FROM rk JOIN m ON rk.pos = m.pos WHERE rk.pos < 6 GROUP BY id),
p AS (SELECT id AS query_id, near, bit_count(xor(cell, near)) AS distance, row_number() OVER (PARTITION BY id ORDER BY bit_count(xor(cell, near)), near) AS probe FROM c, range(64) AS t(near) WHERE id % 100 = 0)
SELECT query_id, probe::INT AS probe, distance::INT AS distance, id AS row_id FROM p JOIN c ON c.cell = p.near WHERE probe <= 8""")
def cell_candidates(spark, sf_dir):
    import numpy as np

    v = vectors(spark, sf_dir)
    mean = np.array([r.mean for r in research.coordinate_means(v).orderBy("pos").collect()])
    return research.cell_candidates(v, asked(v), np.eye(6, DIM), 8, mean)


@query(f"""WITH {BASE}, c AS (SELECT id, sum(CASE WHEN pos < 6 AND x > 0 THEN 1 << pos::INT ELSE 0 END) AS cell FROM rk GROUP BY id), n AS (SELECT cell, count(*) AS n FROM c GROUP BY cell),
o AS (SELECT n, row_number() OVER (ORDER BY n, cell) AS i FROM n) SELECT round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM o""")
def cell_gini(spark, sf_dir):
    import numpy as np

    cells = research.cell_keys(vectors(spark, sf_dir), np.eye(6, DIM))
    return research.gini(cells.groupBy("cell").agg(F.count("*").alias("n"))).withColumn("gini", F.round("gini", 6))


AXES = research.directions(DIM, 4, 0)
_AXIS = ", ".join(f"({a}, [{', '.join(repr(float(x)) for x in row)}])" for a, row in enumerate(AXES))
_DOT = summed("v.x[i] * axes.d[i]")


@query(f"""WITH {BASE}, axes(axis, d) AS (VALUES {_AXIS}), p AS (SELECT v.id, axis, {_DOT} AS x FROM v, axes), e AS (SELECT axis, min(x) AS low, max(x) AS high FROM p GROUP BY axis),
b AS (SELECT id, p.axis, greatest(0, least(15, floor((x - low) / (high - low) * 16)))::INT AS b FROM p JOIN e ON p.axis = e.axis)
SELECT DISTINCT q.id AS query_id, d.id AS row_id FROM b AS q JOIN b AS d ON q.axis = d.axis AND abs(q.b - d.b) <= 1 WHERE q.id % 100 = 0""")
def bucket_router(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return research.route(v, asked(v), axes=AXES)


def _axes_sql(count: int, squarings: int = 16) -> str:
    """CTEs that end in axes(a, u): the axes of most variance, by squaring the covariance until one axis is left of it, then
    taking that axis out. What is left has its largest diagonal where the axis has its farthest coordinate: that one is positive."""
    over = "range(1, 65)"
    scaled = f"list_transform(m, lambda r: list_transform(r, lambda y: y / list_sum(list_transform({over}, lambda i: m[i][i]))))"
    diagonal = f"list_transform({over}, lambda i: p[i][i])"
    unit = "list_transform(k, lambda y: y / sqrt(list_dot_product(k, k)))"
    weight = "list_dot_product(u, list_transform(c, lambda r: list_dot_product(r, u)))"
    less = f"list_transform({over}, lambda i: list_transform({over}, lambda j: c[i][j] - w * u[i] * u[j]))"
    return f"""cov AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS c FROM (SELECT p.pos AS i, q.pos AS j, covar_pop(p.x, q.x) AS c FROM x AS p JOIN x AS q ON p.id = q.id GROUP BY 1, 2) GROUP BY i)),
steps AS (SELECT 0 AS a, 0 AS step, c, {scaled} AS p FROM (SELECT c, c AS m FROM cov) UNION ALL
SELECT CASE WHEN step = {squarings} THEN a + 1 ELSE a END, CASE WHEN step = {squarings} THEN 0 ELSE step + 1 END, c, {scaled} FROM (
SELECT a, step, CASE WHEN step = {squarings} THEN {less} ELSE c END AS c, CASE WHEN step = {squarings} THEN {less} ELSE list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s))) END AS m
FROM (SELECT *, {weight} AS w FROM (SELECT *, {unit} AS u FROM (SELECT *, p[list_position({diagonal}, list_max({diagonal}))] AS k FROM steps WHERE a < {count}))))),
axes AS (SELECT a, {unit} AS u FROM (SELECT a, p[list_position({diagonal}, list_max({diagonal}))] AS k FROM steps WHERE step = {squarings} AND a < {count}))"""


@query(f"""WITH RECURSIVE {BASE}, {_axes_sql(6)}
SELECT v.id AS row_id, sum(CASE WHEN list_dot_product(v.x, axes.u) > 0 THEN 1 << a ELSE 0 END)::BIGINT AS cell FROM v, axes GROUP BY v.id""")
def principal_cells(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return research.cell_keys(v, research.principal_axes(v, 6))


@query("SELECT label AS label, count(*) AS n, round(avg(n), 6) AS mean_length FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY label")
def cone_baseline(spark, sf_dir):
    n = F.sqrt(E.dot(F.col("embedding"), F.col("embedding")))
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"))


from rankmill.plans import more, placements  # noqa: E402, F401  (further queries, registered in the tables above)
