"""Further queries of the engine with their oracles: rules with planted faults, files, indexes, evaluation and probes.

They are registered in the catalogue's tables; the inputs are those of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankmill import index as I
from rankmill import spec as S
from rankmill.functions import encode as E
from rankmill.functions import kernels as K
from rankmill.operators import codes as CO
from rankmill.operators import contingency as C
from rankmill.operators import evaluation as V
from rankmill.operators import cells, nullmodel, probes, report, research, search, validate
from rankmill.plans import catalogue as cat
from rankmill.plans.catalogue import AXES, BASE, CELLS, DIM, KEEP, QUERIES, SQL_FLAT, SQL_HAMMING, SQL_OVERLAP, STAGE, TOP, asked, coded, judged, metric_sql, query, recall_sql, rounded, scored, sql_asym, sql_sym, stage_sql, summed, truth, vectors
from rankmill.sources import formats, results
from rankmill.spec import CandidatePolicy
from rankmill.storage import place, written

# ---- wider vectors: two words a bitmap. The second half is the first one reversed, times -1/2.

WIDE = 128


def wide(v):
    back = F.transform(F.reverse("embedding"), lambda x: (x * F.lit(-0.5)).cast("float"))
    return v.withColumn("embedding", F.concat("embedding", back))


WBASE = """w AS (SELECT vec_id AS id, list_concat(embedding, list_transform(list_reverse(embedding), lambda y: (y * -0.5)::FLOAT)) AS e FROM embeddings),
x AS (SELECT id, unnest(range(0, 128)) AS pos, unnest(e)::DOUBLE AS x FROM w),
rk AS (SELECT id, pos, x, row_number() OVER (PARTITION BY id ORDER BY x, pos) - 1 AS r, row_number() OVER (PARTITION BY id ORDER BY x DESC, pos) - 1 AS rq FROM x)"""
_WWORD = "SELECT id AS row_id, (pos // 64)::INT AS pos, bit_or(CASE WHEN {c} THEN CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (pos % 64)::INT END ELSE 0 END)::BIGINT AS value FROM rk GROUP BY 1, 2"


def _wide_bits(name, column, sql):
    def run(spark, sf_dir):
        return wide(vectors(spark, sf_dir)).select("row_id", F.posexplode(column()).alias("pos", "value"))

    query(f"WITH {WBASE} {_WWORD.format(c=sql)}", name)(run)


_wide_bits("wide_doc_top_bitmap", lambda: E.top_bits_of_doc(E.rank_transform(F.col("embedding")), WIDE, 32), "r >= 96")
_wide_bits("wide_query_top_bitmap", lambda: E.top_bits_of_query(F.col("embedding"), WIDE, 32), "rq < 32")
_wide_bits("wide_sign_bitmap", lambda: E.sign_bits(F.col("embedding"), WIDE), "x > 0")


def _wide_search(name, scorer, pair, order):
    def run(spark, sf_dir):
        v = wide(vectors(spark, sf_dir))
        return search.search(v, asked(v), scorer(), KEEP)

    query(f"""WITH {WBASE}, s AS (SELECT q.id AS query_id, d.id AS row_id, sum(({pair})::INT)::DOUBLE AS s FROM rk AS q JOIN rk AS d ON q.pos = d.pos WHERE q.id % 100 = 0 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, row_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, row_id, s AS score FROM t WHERE rank <= {KEEP}""", name)(run)


_wide_search("wide_bitmap_search", lambda: K.bitmap_overlap(32), "q.rq < 32 AND d.r >= 96", "DESC")
_wide_search("wide_sign_search", K.sign_hamming, "(q.x > 0) <> (d.x > 0)", "ASC")

# ---- codes: other widths, checked constructors, norms


def _coordinates(name, column, sql):
    def run(spark, sf_dir):
        return vectors(spark, sf_dir).select("row_id", F.posexplode(column()).alias("pos", "value")).select("row_id", "pos", F.col("value").cast("long").alias("value"))

    query(f"WITH {BASE} {sql}", name)(run)


for _b in (1, 4):
    _per = 8 // _b
    _codes = lambda b=_b: E.bucket_codes(F.col("embedding"), DIM, b)
    _shift = f"(1 << ({_b} * ({_per - 1} - (pos % {_per}))::INT))"
    _coordinates(f"pack_codes_b{_b}", lambda b=_b, c=_codes: E.from_binary(E.to_binary(E.packed_bytes(c(), DIM, b))), f"SELECT id AS row_id, (pos // {_per})::INT AS pos, sum(((r * {1 << _b}) // 64) * {_shift})::BIGINT AS value FROM rk GROUP BY 1, 2")
    _coordinates(f"unpack_codes_b{_b}", lambda b=_b, c=_codes: E.unpack_bytes(E.packed_bytes(c(), DIM, b), DIM, b), f"SELECT id AS row_id, pos::INT AS pos, ((r * {1 << _b}) // 64)::BIGINT AS value FROM rk")

for _b in (5, 7):

    def _eval(spark, sf_dir, b=_b):
        v = vectors(spark, sf_dir)
        return rounded(search.search(v, asked(v), K.bucket_any_bits(DIM, b), KEEP))

    query(scored(sql_sym(_b)), f"rankquant_eval_b{_b}")(_eval)


@query(f"""WITH {BASE}, o AS (SELECT bits, avg(n) AS observed FROM (SELECT id, b AS bits, sqrt(sum(pow((r * (1 << b::INT)) // 64 - ((1 << b::INT) - 1) / 2.0::DOUBLE, 2))) AS n FROM rk, range(1, 9) AS b(b) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT d.d AS dim, b.b AS bits FROM (VALUES (16), (48), (64), (384), (1024)) AS d(d), range(1, 9) AS b(b)),
s AS (SELECT dim, bits, sum(pow((r * (1 << bits::INT)) // dim - ((1 << bits::INT) - 1) / 2.0::DOUBLE, 2)) AS e FROM (SELECT dim, bits, unnest(range(dim)) AS r FROM c) GROUP BY 1, 2)
SELECT dim::INT AS dim, s.bits::INT AS bits, round(sqrt(dim::DOUBLE * (dim * dim - 1) / 12), 6) AS rank_norm, round(sqrt(dim::DOUBLE * (pow(2, s.bits) * pow(2, s.bits) - 1) / 12), 6) AS bucket_norm, round(sqrt(e), 6) AS empirical_norm,
round(CASE WHEN s.bits = 8 AND dim % 256 <> 0 THEN sqrt(e) ELSE sqrt(dim::DOUBLE * (pow(2, s.bits) * pow(2, s.bits) - 1) / 12) END, 6) AS asymmetric_norm, (3 % (1 << s.bits::INT) - ((1 << s.bits::INT) - 1) / 2.0)::DOUBLE AS centre,
round(observed, 6) AS observed FROM s LEFT JOIN o ON s.dim = 64 AND s.bits = o.bits""")
def norms(spark, sf_dir):
    """ENC-8 to ENC-12: the formulas, and the mean length of the table's centred codes."""
    rows = [(d, b, S.rank_norm(d), S.bucket_norm(d, b), S.empirical_norm(d, b), S.asymmetric_norm(d, b), float(S.bucket_centre(3 % (1 << b), b))) for d in (16, 48, 64, 384, 1024) for b in range(1, 9)]
    t = spark.createDataFrame(rows, "dim int, bits int, rank_norm double, bucket_norm double, empirical_norm double, asymmetric_norm double, centre double")
    ranks = vectors(spark, sf_dir).select(E.rank_transform(F.col("embedding")).alias("r"))
    size = lambda b: F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, r: a + F.pow(F.floor(r * (1 << b) / DIM) - ((1 << b) - 1) / 2, F.lit(2.0))))
    seen = ranks.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), size(b).alias("n")) for b in range(1, 9)))).alias("s")).groupBy(F.col("s.bits").alias("bits")).agg(F.avg("s.n").alias("observed"))
    t = t.join(seen.withColumn("dim", F.lit(DIM)), ["dim", "bits"], "left")
    return t.select("dim", "bits", *(F.round(c, 6).alias(c) for c in ("rank_norm", "bucket_norm", "empirical_norm", "asymmetric_norm")), "centre", F.round("observed", 6).alias("observed"))


@query("""WITH d AS (SELECT dim, count(*) AS n FROM (SELECT unnest([1 + vec_id % 64, 64 * (1 + vec_id % 12)]) AS dim FROM embeddings) GROUP BY 1),
c AS (SELECT *, dim BETWEEN 2 AND 65535 AND bits IN (1, 2, 4, 8) AND dim % greatest(1, 8 // bits) = 0 AS whole, dim % (1 << bits::INT) = 0 AS even FROM d, (VALUES (1), (2), (3), (4), (8)) AS b(bits))
SELECT dim::INT AS dim, bits::INT AS bits, n, whole AND even AS valid, CASE WHEN whole AND even THEN (dim * bits // 8)::INT END AS bytes_per_vec, whole AND bits = 8 AND NOT even AS asymmetric_only FROM c""")
def bucket_specs(spark, sf_dir):
    """VAL-4, VAL-13, ENC-7: which indexes could take the table's rows, cut short and repeated to all lengths."""
    i = F.col("row_id").cast("int")
    cut, long_ = F.slice("embedding", 1, 1 + i % 64), F.flatten(F.array_repeat("embedding", 1 + i % 12))
    d = vectors(spark, sf_dir).select(F.explode(F.array(F.size(cut), F.size(long_))).alias("dim")).groupBy("dim").agg(F.count("*").alias("n"))
    d = d.select("dim", F.explode(F.array(*(F.lit(b) for b in (1, 2, 3, 4, 8)))).alias("bits"), "n")
    return d.select("dim", "bits", "n", *(c.alias(k) for k, c in validate.bucket_rules(F.col("dim"), F.col("bits")).items()))


_CODE_ROWS = "SELECT id AS row_id, pos::INT AS pos, ((r * 4) // 64)::BIGINT AS value FROM rk"


def _long(t):
    return t.select("row_id", F.posexplode("codes").alias("pos", "value")).select("row_id", "pos", F.col("value").cast("long").alias("value"))


@query(f"WITH {BASE} {_CODE_ROWS}")
def codes_from_ranks(spark, sf_dir):
    return _long(CO.codes_from_ranks(vectors(spark, sf_dir).select("row_id", E.rank_transform(F.col("embedding")).alias("ranks")), DIM, 4))


@query(f"WITH {BASE} {_CODE_ROWS}")
def codes_from_vectors(spark, sf_dir):
    return _long(CO.codes_from_vectors(vectors(spark, sf_dir), DIM, 2))


@query(f"WITH {BASE} {_CODE_ROWS}")
def checked_codes(spark, sf_dir):
    return _long(CO.checked_codes(coded(vectors(spark, sf_dir), 2), DIM, 4))


@query(f"WITH {BASE} SELECT id AS row_id, sum(((r * 4) // 64 = 3)::INT)::BIGINT AS weight FROM rk GROUP BY id")
def bitmap_weight(spark, sf_dir):
    return coded(vectors(spark, sf_dir), 2).select("row_id", CO.weight(E.top_membership(F.col("codes"), 4)).alias("weight"))


# ---- rules, with faults planted by row id

_FAULT = """f AS (SELECT vec_id AS row_id, CASE vec_id % 7 WHEN 1 THEN 'nan' WHEN 2 THEN 'infinite' WHEN 3 THEN 'short' WHEN 4 THEN 'null' WHEN 5 THEN 'long' ELSE '' END AS kind FROM embeddings)"""


def planted(v):
    """Vectors of which some are broken: by the rest of row_id / 7."""
    k, e = F.col("row_id") % 7, F.col("embedding")
    first = lambda x: F.concat(F.array(F.lit(x).cast("float")), F.slice(e, 2, DIM - 1))
    bad = F.when(k == 1, first(float("nan"))).when(k == 2, first(float("-inf"))).when(k == 3, F.slice(e, 1, DIM - 1)).when(k == 4, F.lit(None)).when(k == 5, F.concat(e, F.slice(e, 1, 1))).otherwise(e)
    return v.withColumn("embedding", bad)


@query(f"WITH {_FAULT} SELECT row_id, kind NOT IN ('nan', 'infinite', 'null') AS finite, kind NOT IN ('short', 'long', 'null') AS whole FROM f")
def vector_faults(spark, sf_dir):
    """VAL-1, VAL-2."""
    v = planted(vectors(spark, sf_dir))
    return v.select("row_id", validate.finite(F.col("embedding")).alias("finite"), F.coalesce(F.size("embedding") == DIM, F.lit(False)).alias("whole"))


@query("WITH u AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 3 = 0 THEN 1.0 WHEN vec_id % 3 = 1 THEN 1.0005 ELSE 1.002 END AS n FROM embeddings) SELECT row_id FROM u WHERE n > 1.001")
def unit_length_faults(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("embedding", E.l2_normalise(F.col("embedding")))
    grown = F.when(F.col("row_id") % 3 == 0, 1.0).when(F.col("row_id") % 3 == 1, 1.0005).otherwise(1.002)
    return validate.unit_length_issues(v.withColumn("embedding", F.transform("embedding", lambda x: x * grown)), DIM)


@query("SELECT vec_id AS row_id, vec_id % 5 NOT IN (1, 2) AS permutation, vec_id % 5 NOT IN (1, 3) AS balanced, (16 - (vec_id % 5 = 4)::INT)::BIGINT AS ones FROM embeddings")
def code_faults(spark, sf_dir):
    """VAL-3, VAL-8, VAL-10: ranks with a repeat (1) or out of range (2), codes that fill a bucket too much (1, 3), a bitmap with a bit less (4)."""
    k = F.col("row_id") % 5
    t = vectors(spark, sf_dir).select("row_id", E.rank_transform(F.col("embedding")).alias("r"))
    r = F.when(k == 1, F.transform("r", lambda x: F.when(x == 63, 0).otherwise(x))).when(k == 2, F.transform("r", lambda x: F.when(x == 63, 64).otherwise(x))).otherwise(F.col("r"))
    c = F.when(k.isin(1, 3), F.transform("r", lambda x: F.when(x == 63, 0).otherwise(F.floor(x / 16)).cast("int"))).otherwise(E.bucket_ranks(F.col("r"), DIM, 2))
    bits = E.fold_words(F.transform("r", lambda x: (x >= DIM - TOP) & ~((k == 4) & (x == 63))), DIM)
    return t.select("row_id", validate.is_permutation(r, DIM).alias("permutation"), validate.is_balanced(c, DIM, 4).alias("balanced"), validate.popcount(bits).alias("ones"))


@query("""WITH q AS (SELECT vec_id AS id, (vec_id // 100) % 5 AS k FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT * FROM (VALUES (1, 'length'), (1, 'unknown_row'), (2, 'length'), (3, 'falling'), (3, 'length'), (4, 'gap')) AS r(k, code))
SELECT id AS query_id, code FROM q JOIN r ON q.k = r.k""")
def csr_faults(spark, sf_dir):
    """VAL-6: candidate lists of all queries, a fault planted in most."""
    v = vectors(spark, sf_dir)
    lists, k = search.csr(search.candidates(v, asked(v), K.sign_hamming(), 5)), F.floor(F.col("query_id") / 100) % 5
    lists = lists.withColumn("candidates", F.when(k == 1, F.concat("candidates", F.array(F.lit(1 << 40)))).when(k == 2, F.slice("candidates", 1, 4)).otherwise(F.col("candidates")))
    return validate.csr_issues(lists.withColumn("end", F.when(k == 3, F.col("start") - 1).otherwise(F.col("end"))), v.count())


@query("SELECT label, times, count(*) * times AS n, count(*) * times <= 67108864 AS fits FROM embeddings, (VALUES (1), (100000), (1000000), (100000000)) AS t(times) GROUP BY 1, 2")
def capacity_check(spark, sf_dir):
    """VAL-7: whether a label's rows, so many times as many, would fit one file."""
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    n = n.select("label", F.explode(F.array(*(F.lit(x) for x in (1, 100000, 1000000, 100000000)))).alias("times"), "n").withColumn("n", F.col("n") * F.col("times"))
    return n.withColumn("fits", validate.fits(F.col("n")))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT * FROM (VALUES (0), (1), (7), (10), (100)) AS k(k), n, (VALUES (256, 32, NULL), (4, 2, 15), (50, 1, 60)) AS p(least, times, most))
SELECT label, k::INT AS k, n, least::INT AS min_candidates, CASE WHEN k = 0 THEN 0 ELSE least(greatest(least, k * times), coalesce(most, 1000000000), n) END::BIGINT AS candidates FROM c""")
def candidate_policy(spark, sf_dir):
    """CND-12: how many candidates each label's rows would hand on."""
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    asked_for = [(k, p) for k in (0, 1, 7, 10, 100) for p in (CandidatePolicy(), CandidatePolicy(4, 2, 15), CandidatePolicy(50, 1, 60))]
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p.min_candidates).alias("min_candidates"), p.candidates(k, F.col("n")).alias("candidates")) for k, p in asked_for))
    return n.select("label", "n", F.explode(each).alias("e")).select("label", "e.k", "n", "e.min_candidates", "e.candidates")


# ---- null model: counts as text

_COMB = "(SELECT product(({n} - ({k}) + j)::DOUBLE / j) FROM range(1, ({k}) + 1) AS t(j))"


_HALF_RANK = "row_number() OVER (PARTITION BY id ORDER BY CASE WHEN x = 0 THEN 0 ELSE x END{d}, pos) - 1"


@query(f"""WITH {BASE}, h AS (SELECT id, pos, {_HALF_RANK.format(d='')} AS r, {_HALF_RANK.format(d=' DESC')} AS rq FROM x WHERE pos < 32),
s AS (SELECT o, count(*) AS n FROM (SELECT sum((q.rq < 8 AND d.r >= 24)::INT) AS o FROM h AS q JOIN h AS d ON q.pos = d.pos WHERE q.id % 100 = 0 GROUP BY q.id, d.id) GROUP BY 1),
f AS (SELECT o, (CASE WHEN o = 0 THEN 1 ELSE round({_COMB.format(n=8, k='o')}) END * CASE WHEN o = 8 THEN 1 ELSE round({_COMB.format(n=24, k='8 - o')}) END)::HUGEINT AS c FROM range(9) AS o(o)),
t AS (SELECT o, c, sum(c) OVER (ORDER BY o DESC) AS tail, sum(c) OVER () AS space FROM f)
SELECT 32::INT AS dim, 8::INT AS weight, t.o::INT AS overlap, c::VARCHAR AS fibers, tail::HUGEINT::VARCHAR AS tail, round(tail / space, 9)::DOUBLE AS tail_prob, space::HUGEINT::VARCHAR AS space, 2.0::DOUBLE AS expected, coalesce(n, 0)::BIGINT AS seen FROM t LEFT JOIN s ON s.o = t.o""")
def overlap_null_counts(spark, sf_dir):
    """NUL-1 to NUL-5, NUL-7: exact counts for the first 32 coordinates, beside how often queries and rows have each overlap."""
    v = vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 32))
    seen = search.histogram(v, asked(v), K.bitmap_overlap(8)).groupBy(F.col("score").alias("overlap")).agg(F.sum("n").alias("seen"))
    t = nullmodel.with_seen(nullmodel.null_table(spark, 32, 8), seen)
    return t.select("dim", "weight", "overlap", "fibers", "tail", F.round("tail_prob", 9).alias("tail_prob"), F.lit(str(nullmodel.space_size(32, 8))).alias("space"), F.lit(nullmodel.expected_overlap(32, 8)).alias("expected"), "seen")


@query(f"WITH {BASE}, n AS (SELECT count(*) AS n FROM v) SELECT pos::INT AS pos, b::INT AS bucket, round(sum(((r * 4) // 64 = b)::INT) / max(n), 6) AS frequency FROM rk, range(4) AS b(b), n GROUP BY 1, 2")
def bucket_frequency_profile(spark, sf_dir):
    """NUL-11."""
    return probes.frequency_profile(coded(vectors(spark, sf_dir), 2), 4).withColumn("frequency", F.round("frequency", 6))


# ---- candidates and results


def _chunked(spark, sf_dir):
    """CND-3: in blocks of three queries."""
    v = vectors(spark, sf_dir)
    return search.candidates(v, asked(v), K.bitmap_overlap(TOP), STAGE, size=3)


query(f"SELECT query_id, (rank - 1)::INT AS pos, row_id FROM ({scored(SQL_OVERLAP, 'DESC', STAGE)})", "bitmap_top_m_chunked")(_chunked)


@query(f"SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY row_id) - 1)::INT AS pos, row_id FROM ({scored(SQL_HAMMING, 'ASC', STAGE)})")
def sign_exact_m(spark, sf_dir):
    """CND-13."""
    v = vectors(spark, sf_dir)
    return search.candidates_exactly(v, asked(v), K.sign_hamming(), STAGE)


@query(f"WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT q.id AS query_id, v.id AS row_id, (64 - {SQL_HAMMING})::INT AS s FROM q, v) SELECT query_id, array_to_string(list(s ORDER BY row_id), ',') AS scores FROM s GROUP BY 1")
def sign_score_rows(spark, sf_dir):
    """CND-10."""
    v = vectors(spark, sf_dir)
    agreed = F.transform("scores", lambda x: (DIM - x).cast("int"))
    return search.score_rows(v, asked(v), K.sign_hamming()).select("query_id", F.array_join(agreed.cast("array<string>"), ",").alias("scores"))


@query(f"WITH c AS (SELECT query_id, list(row_id ORDER BY rank) AS l FROM ({scored(SQL_HAMMING, 'ASC', 5)}) GROUP BY 1) SELECT (SELECT count(*) FROM c) AS queries, query_id, array_to_string(l, ',') AS candidates, false AS is_empty, false AS has_none FROM c WHERE query_id = 100")
def csr_accessors(spark, sf_dir):
    """CND-14."""
    v = vectors(spark, sf_dir)
    c = search.csr(search.candidates(v, asked(v), K.sign_hamming(), 5))
    row = (search.csr_query_count(c), 100, ",".join(map(str, search.csr_candidates(c, 100))), search.csr_is_empty(c), search.csr_has_no_candidates(c))
    return spark.createDataFrame([row], "queries long, query_id long, candidates string, is_empty boolean, has_none boolean")


@query(f"""WITH s AS ({scored(sql_asym(2), 'DESC', 5)}), n AS (SELECT count(*) AS n FROM embeddings)
SELECT rank, row_id, score, n AS vector_count, n AS scored, 5::BIGINT AS requested, 5::BIGINT AS returned FROM s, n WHERE query_id = 0""")
def search_one_with_stats(spark, sf_dir):
    """SRC-18, SRC-19: one query with the figures of its search."""
    v = vectors(spark, sf_dir)
    ix = I.BucketIndex(spark, DIM, 2).add(v, "row_id")
    hits, stats = ix.search_one(v.where("row_id = 0").first().embedding, 5)
    rows = [(i, r, round(s, 6), stats["vector_count"], stats["scored"], stats["requested"], stats["returned"]) for i, (r, s) in enumerate(hits, 1)]
    return spark.createDataFrame(rows, "rank int, row_id long, score double, vector_count long, scored long, requested long, returned long")


@query(scored(sql_asym(2)))
def results_as_json(spark, sf_dir):
    """MET-3: written as JSON and read again."""
    found = QUERIES["rankquant_search_asym_b2"](spark, sf_dir)
    return search.results_of_json(search.results_json(found, KEEP))


# ---- index objects


def _indexed(name, make, method, sql, order="DESC"):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        ix = make(spark).add(v.where("row_id < 200"), "row_id").add(v.where("row_id >= 200"), "row_id")
        found = getattr(ix, method)(asked(v), KEEP)
        return rounded(found)

    query(scored(sql, order), name)(run)


_indexed("index_rank", lambda s: I.RankIndex(s, DIM), "search_asymmetric", cat.SQL_RANK_ASYM)
_indexed("index_b4", lambda s: I.BucketIndex(s, DIM, 4), "search_asymmetric", sql_asym(4))
_indexed("index_b2_symmetric", lambda s: I.BucketIndex(s, DIM, 2), "search", sql_sym(2))
_indexed("index_b8", lambda s: I.BucketIndex(s, DIM, 8, asymmetric_only=True), "search_asymmetric", sql_asym(8))
_indexed("index_bitmap", lambda s: I.BitmapIndex(s, DIM, TOP), "search", SQL_OVERLAP)


@query(f"""WITH {BASE}, l AS (SELECT max(id) AS l FROM v), k AS (SELECT CASE WHEN id = l THEN 7 ELSE id END AS at, id, x, r, rq, norm FROM v, l WHERE id <> 7), q AS (SELECT * FROM v WHERE id % 100 = 0),
s AS (SELECT q.id AS query_id, v.at AS row_id, {SQL_OVERLAP} AS s FROM q, k AS v), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, row_id, s::DOUBLE AS score FROM t WHERE rank <= {KEEP}""")
def index_after_removal(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ix = I.BitmapIndex(spark, DIM, TOP).add(v, "row_id")
    ix.swap_remove(7)
    return ix.search(asked(v), KEEP)


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT kind, 64::INT AS dim, n AS vector_count, b::INT AS bytes_per_vec, n * b AS byte_size, "symmetric" FROM n,
(VALUES ('rank', 128, true), ('buckets 2', 16, true), ('buckets 8', 64, false), ('pairs', 32, true), ('bitmap', 8, true), ('sign', 8, true)) AS t(kind, b, "symmetric")""")
def index_info(spark, sf_dir):
    """MET-1, MET-2, MET-4: what the indexes say of themselves, and that their codes have as many bytes."""
    v = vectors(spark, sf_dir)
    made = {"rank": I.RankIndex(spark, DIM), "buckets 2": I.BucketIndex(spark, DIM, 2), "buckets 8": I.BucketIndex(spark, DIM, 8, True), "pairs": I.PairScanIndex(spark, DIM), "bitmap": I.BitmapIndex(spark, DIM, TOP), "sign": I.SignIndex(spark, DIM)}
    rows = []
    for name, ix in made.items():
        ix.add(v, "row_id")
        info, size = ix.info(), ix.codes.agg(F.sum(F.octet_length("value"))).first()[0]
        rows.append((name, info["dim"], info["vector_count"], info["bytes_per_vec"], size, getattr(ix.spec, "symmetric", True)))
    return spark.createDataFrame(rows, "kind string, dim int, vector_count long, bytes_per_vec int, byte_size long, symmetric boolean")


# ---- files


def _made(spark, sf_dir, only=None):
    v = vectors(spark, sf_dir)
    made = {"rank": I.RankIndex(spark, DIM), "buckets": I.BucketIndex(spark, DIM, 2), "pairs": I.PairScanIndex(spark, DIM), "bitmap": I.BitmapIndex(spark, DIM, TOP), "sign": I.SignIndex(spark, DIM)}
    made = {k: ix for k, ix in made.items() if only in (None, k)}
    for ix in made.values():
        ix.add(v, "row_id")
    return made


def _folder(spark):
    import os

    found = place(spark, "files").removeprefix("file://")
    os.makedirs(found, exist_ok=True)
    return found


_WORDS = "bit_or(CASE WHEN {c} THEN CASE WHEN pos = 63 THEN -9223372036854775808 ELSE 1::BIGINT << pos::INT END ELSE 0 END)::BIGINT"


@query(f"""WITH {BASE} SELECT 'rank' AS kind, id AS row_id, pos::INT AS pos, r::BIGINT AS value FROM rk UNION ALL SELECT k, id, pos::INT, ((r * 4) // 64)::BIGINT FROM rk, (VALUES ('buckets'), ('pairs')) AS k(k)
UNION ALL SELECT 'bitmap', id, 0, {_WORDS.format(c='r >= 48')} FROM rk GROUP BY id UNION ALL SELECT 'sign', id, 0, {_WORDS.format(c='x > 0')} FROM rk GROUP BY id""")
def format_roundtrip(spark, sf_dir):
    """IO-1 to IO-5: every kind of index file, written and read again."""
    folder, out = _folder(spark), None
    for kind, ix in _made(spark, sf_dir).items():
        ix.write(f"{folder}/{kind}")
        part = formats.read(spark, f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "row_id", F.posexplode("value").alias("pos", "value"))
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {BASE} SELECT 'rank' AS kind, id AS row_id, pos::INT AS pos, r::BIGINT AS value FROM rk UNION ALL SELECT 'buckets', id, pos::INT, ((r * 4) // 64)::BIGINT FROM rk
UNION ALL SELECT 'bitmap', id, 0, {_WORDS.format(c='r >= 48')} FROM rk GROUP BY id UNION ALL SELECT 'sign', id, 0, {_WORDS.format(c='x > 0')} FROM rk GROUP BY id""")
def older_files(spark, sf_dir):
    """IO-6: files that begin as older ones did."""
    folder, out = _folder(spark), None
    for magic, kind in formats.OLDER.items():
        path, ix = f"{folder}/{kind}", _made(spark, sf_dir, kind)[kind]
        ix.write(path)
        with open(path, "r+b") as f:
            f.write(magic)
        part = formats.read(spark, path).select(F.lit(kind).alias("kind"), "row_id", F.posexplode("value").alias("pos", "value"))
        out = part if out is None else out.union(part)
    return out


@query("""SELECT kind, vec_id AS row_id, fault FROM embeddings JOIN (VALUES ('rank', 1, 'not a permutation'), ('rank', 2, 'not a permutation'), ('buckets', 1, 'uneven buckets'), ('bitmap', 3, 'bits set'),
('pairs', 1, 'uneven buckets'), ('pairs', 4, 'a pair value out of range')) AS t(kind, k, fault) ON vec_id % 5 = k""")
def file_faults(spark, sf_dir):
    """VAL-8 to VAL-11: files of each kind with faults planted in their rows, and every faulty row found where it stands.

    Of five rows, one repeats a rank (1), one has a rank out of range (2), one a bit less (3) and one a pair value above 15 (4).
    """
    k, folder, out = F.col("row_id") % 5, _folder(spark), None
    t = vectors(spark, sf_dir).select("row_id", E.rank_transform(F.col("embedding")).alias("r"))
    repeat = lambda x: F.when(k == 1, F.transform(x, lambda y: F.when(y == 63, 0).otherwise(y))).otherwise(x)
    codes = F.transform(repeat(F.col("r")), lambda y: F.floor(y / 16).cast("int"))
    values = {
        "rank": F.when(k == 2, F.transform("r", lambda y: F.when(y == 63, 64).otherwise(y))).otherwise(repeat(F.col("r"))),
        "buckets": codes,
        "bitmap": E.fold_words(F.transform("r", lambda y: (y >= DIM - TOP) & ~((k == 3) & (y == 63))), DIM),
        "pairs": F.when(k == 4, F.transform(codes, lambda y, i: F.when(i == 0, 4).otherwise(y))).otherwise(codes),
    }
    for kind, value in values.items():
        formats.write(t.select("row_id", value.cast("array<long>").alias("value")), f"{folder}/{kind}", kind, DIM, 2 if kind == "buckets" else None, TOP if kind == "bitmap" else None)
        part = formats.faults(spark, f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "row_id", "fault")
        out = part if out is None else out.union(part)
    return out


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT kind, magic, 1::INT AS format_version, 64::INT AS dim, n AS vector_count, b::INT AS bytes_per_vec, bits::INT AS bits, n_top::INT AS n_top, (h + b * CASE WHEN kind = 'pairs' THEN (n + 31) // 32 * 32 ELSE n END)::BIGINT AS file_size_bytes,
kind <> 'pairs' AS probed FROM n, (VALUES ('rank', 'OVR1', 128, NULL, NULL, 13), ('buckets', 'OVRQ', 16, 2, NULL, 14), ('bitmap', 'OVBM', 8, NULL, 16, 17), ('sign', 'OVSB', 8, NULL, NULL, 13), ('pairs', 'OVFS', 32, NULL, NULL, 13)) AS t(kind, magic, b, bits, n_top, h)""")
def file_metadata(spark, sf_dir):
    """IO-7, IO-8, IO-9: what headers say, of files and of bytes in memory."""
    import io

    rows, known = [], {r.kind: r for r in formats.registry(spark).collect()}
    for kind, ix in _made(spark, sf_dir).items():
        held = io.BytesIO()
        size = ix.write_to(held)
        m = formats.parse_header(held.getvalue()[:17], size)
        rows.append((m.kind, known[kind].magic, m.format_version, m.dim, m.vector_count, m.bytes_per_vec, m.bits, m.n_top, m.file_size_bytes, known[kind].probed))
    return spark.createDataFrame(rows, "kind string, magic string, format_version int, dim int, vector_count long, bytes_per_vec int, bits int, n_top int, file_size_bytes long, probed boolean")


@query("SELECT vec_id AS row_id, pos::INT AS pos, x::FLOAT AS x FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings)")
def npy_roundtrip(spark, sf_dir):
    """IO-10."""
    path = f"{_folder(spark)}/x.npy"
    formats.write_npy(vectors(spark, sf_dir), path, DIM)
    return formats.read_npy(spark, path).select("row_id", F.posexplode("embedding").alias("pos", "x"))


@query(f"SELECT 'd' AS dataset, 'b2' AS method, query_id::VARCHAR AS query_id, row_id::VARCHAR AS doc_id, score, (rank - 1)::INT AS pos FROM ({scored(sql_asym(2))})")
def top_k_records(spark, sf_dir):
    """IO-12."""
    path = f"{_folder(spark)}/top"
    results.write_top_k(QUERIES["rankquant_search_asym_b2"](spark, sf_dir), path, "d", "test", "b2", KEEP)
    return results.read_top_k(spark, path)


_RUNS = "SELECT vec_id, 'm' || (vec_id % 3) AS method, (100 * (1 + vec_id % 2))::BIGINT AS n_docs, vec_id / 8.0::DOUBLE AS ms FROM embeddings"


def _timings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("row_id", F.concat(F.lit("m"), F.col("row_id") % 3).alias("method"), (100 * (1 + F.col("row_id") % 2)).alias("n_docs"), (F.col("row_id") / 8).alias("ms"))


@query(f"WITH t AS ({_RUNS}) SELECT 'd' AS dataset, method, n_docs, ms AS query_latency_ms_p50, ms * 2 AS queries_per_second FROM t")
def timing_records(spark, sf_dir):
    """IO-13."""
    path = f"{_folder(spark)}/timings"
    t = _timings(spark, sf_dir)
    results.append_timings(t.select(F.lit("d").alias("dataset"), "method", "n_docs", F.col("ms").alias("query_latency_ms_p50"), (F.col("ms") * 2).alias("queries_per_second")), path)
    return results.read_timings(spark, path).select("dataset", "method", "n_docs", "query_latency_ms_p50", "queries_per_second")


@query("SELECT 'q' || (vec_id % 4) AS query_id, 'd' || vec_id AS doc_id, (vec_id % 3)::INT AS rel, vec_id // 2 AS row_id FROM embeddings WHERE vec_id % 2 = 0")
def judgement_records(spark, sf_dir):
    """IO-11: a judgement for every row, ids of every second one, written and read as JSON."""
    folder, v = place(spark, "judgements"), vectors(spark, sf_dir)
    named = v.select("row_id", F.concat(F.lit("d"), F.col("row_id")).alias("doc_id"))
    results.write_ids(named.where("row_id % 2 = 0").select(F.floor(F.col("row_id") / 2).alias("row_id"), F.col("doc_id").alias("id")), f"{folder}/ids")
    results.write_qrels(named.select(F.concat(F.lit("q"), F.col("row_id") % 4).alias("query_id"), "doc_id", (F.col("row_id") % 3).alias("rel")), f"{folder}/qrels")
    known = results.read_ids(spark, f"{folder}/ids", lines=True).withColumnRenamed("id", "doc_id")
    return results.read_qrels(spark, f"{folder}/qrels", lines=True).join(known, "doc_id").select("query_id", "doc_id", "rel", "row_id")


# ---- manifests: faults planted one by one

# Changes of a good document, and the codes that must come of each.
MANIFEST_FAULTS = (
    ("good", {}, ()), ("digest", {"artifact.sha256": "0" * 64}, ("artifact_sha256_mismatch",)), ("size", {"artifact.file_size_bytes": 1 << 30}, ("artifact_file_size_mismatch", "artifact_metadata_file_size_mismatch")),
    ("dim", {"artifact.dim": 32}, ("artifact_dim_mismatch", "artifact_embedding_dim_mismatch")), ("params", {"artifact.params": {"kind": "rank_quant", "bits": 4}}, ("artifact_params_mismatch",)),
    ("escape", {"artifact.path": "../index"}, ("artifact_path_escape_rejected", "artifact_path_not_canonical")), ("missing", {"artifact.path": "gone"}, ("artifact_missing",)),
    ("rows", {"row_identity.row_count": 1}, ("artifact_row_count_mismatch",)), ("model", {"embedding.model": " "}, ("embedding_model_empty",)), ("extension", {"extensions": {"plain": 1}}, ("extension_key_not_namespaced",)),
    ("attestation", {"attestations": [{}]}, ("attestation_predicate_type_missing", "attestation_subject_sha256_mismatch")),
)
_PLANTED = ", ".join(f"('{name}', '{c}')" for name, _, codes in MANIFEST_FAULTS for c in codes)


@query(f"SELECT * FROM (VALUES {_PLANTED}) AS t(fault, code)")
def manifest_issues(spark, sf_dir):
    """MAN-3, MAN-5 to MAN-8, MAN-12."""
    import copy

    from rankmill.manifest import model

    folder, rows = _folder(spark), []
    I.BucketIndex(spark, DIM, 2).add(vectors(spark, sf_dir), "row_id").write(f"{folder}/index")
    good = model.create("index", folder, "model")
    for name, changes, _ in MANIFEST_FAULTS:
        doc = copy.deepcopy(good)
        for path, value in changes.items():
            *outer, last = path.split(".")
            at = doc
            for k in outer:
                at = at[k]
            at[last] = value
        rows += [(name, i.code) for i in model.verify(doc, folder).errors]
    return spark.createDataFrame(rows, "fault string, code string")


@query("""WITH e AS (SELECT vec_id AS id, vec_id % 100 AS k FROM embeddings), r(code, k) AS (VALUES ('row_identity_row_id_mismatch', 3), ('row_identity_db_id_invalid_uuid', 5), ('row_identity_jsonl_invalid_json', 7), ('row_identity_duplicate_db_id', 9))
SELECT code, id::INT AS line FROM e JOIN r ON e.k = r.k UNION ALL SELECT 'row_identity_row_count_mismatch', NULL""")
def row_identity_faults(spark, sf_dir):
    """MAN-9: a line for each row of the table, four faults planted in every hundred."""
    from rankmill.manifest.tables import row_identity_issues

    i, k, path = F.col("row_id"), F.col("row_id") % 100, place(spark, "row-ids")
    v = vectors(spark, sf_dir)
    db_id = F.when(k == 5, F.concat(F.lit("no uuid "), i.cast("string"))).otherwise(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((i - (k == 9).cast("int")).cast("string"), 12, "0")))
    line = F.when(k == 7, "{broken").otherwise(F.to_json(F.struct(F.when(k == 3, i + 10**9).otherwise(i).alias("row_id"), db_id.alias("db_id"))))
    v.orderBy("row_id").select(line.alias("value")).coalesce(1).write.text(path)  # such a list is one file, in order
    return row_identity_issues(spark, path, v.count() + 1).select("code", F.col("line").cast("int").alias("line"))


# ---- evaluation


def _run(v, q):
    """A run with repeats: each query's rows by a rule, the last of a document standing."""
    rows = v.select("row_id")
    return C.with_queries(rows, q.select("query_id")).select("query_id", F.concat(F.lit("d"), F.col("row_id") % 40).alias("doc_id"), ((F.col("row_id") * 7 + F.col("query_id")) % 53).cast("double").alias("score"), F.col("row_id").alias("pos"))


_RUN = "r AS (SELECT q.vec_id AS query_id, 'd' || (v.vec_id % 40) AS doc_id, ((v.vec_id * 7 + q.vec_id) % 53)::DOUBLE AS score, v.vec_id AS pos FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"
_LAST = "l AS (SELECT query_id, doc_id, arg_max(score, pos) AS score FROM r GROUP BY 1, 2)"
_GRADED = "j AS (SELECT q.vec_id AS query_id, 'd' || d.d AS doc_id, ((d.d + q.vec_id / 100) % 4)::INT AS rel FROM embeddings q, range(50) AS d(d) WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_RUN}, {_LAST} SELECT query_id, doc_id, score FROM l")
def last_wins(spark, sf_dir):
    """EVL-9."""
    v = vectors(spark, sf_dir)
    return V.last_of(_run(v, asked(v)))


def _judged(spark, v):
    docs = spark.range(50).select(F.col("id").alias("d"))
    return C.with_queries(docs, asked(v).select("query_id")).select("query_id", F.concat(F.lit("d"), "d").alias("doc_id"), ((F.col("d") + F.col("query_id") / 100) % 4).cast("int").alias("rel"))


_METRIC = f"""o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM l), h AS (SELECT o.query_id, rank, rel, count(*) OVER (PARTITION BY o.query_id ORDER BY rank) AS hits FROM o JOIN j ON o.query_id = j.query_id AND o.doc_id = j.doc_id WHERE rel > 0 AND rank <= {KEEP}),
i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS k FROM j WHERE rel > 0), d AS (SELECT query_id, sum(CASE WHEN k <= {KEEP} THEN rel / log2(k + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM i GROUP BY 1),
a AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(hits / rank) AS ap, count(*) AS n, 1 / min(rank) AS mrr FROM h GROUP BY 1),
m AS (SELECT d.query_id, coalesce(dcg, 0) / idcg AS ndcg, coalesce(ap, 0) / relevant AS map, coalesce(n, 0) / relevant AS recall, coalesce(n, 0) / {KEEP} AS precision, coalesce(mrr, 0) AS mrr FROM d LEFT JOIN a ON d.query_id = a.query_id)"""


@query(f"WITH {_RUN}, {_LAST}, {_GRADED}, {_METRIC} SELECT query_id, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr FROM m")
def graded_metrics(spark, sf_dir):
    """EVL-4, EVL-5 with judgements of several grades."""
    v = vectors(spark, sf_dir)
    m = V.metrics_at(V.last_of(_run(v, asked(v))), _judged(spark, v), KEEP)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "map", "recall", "precision", "mrr")))


_METHODS = """r2 AS (SELECT 'own' AS method, query_id, doc_id, score FROM l UNION ALL SELECT 'flipped', query_id, doc_id, -score FROM l)"""


def _two_methods(spark, sf_dir):
    v = vectors(spark, sf_dir)
    own = written(V.last_of(_run(v, asked(v))), "run").select(F.lit("own").alias("method"), "query_id", "doc_id", "score")  # read for each method and metric
    return own.union(own.select(F.lit("flipped"), "query_id", "doc_id", -F.col("score"))), _judged(spark, v)


def _metric_of(source):
    return _METRIC.replace("FROM l)", f"FROM {source})")


@query(f"""WITH {_RUN}, {_LAST}, {_GRADED}, f AS (SELECT query_id, doc_id, -score AS score FROM l), a AS (WITH {_metric_of('l')} SELECT 'own' AS method, * FROM m), b AS (WITH {_metric_of('f')} SELECT 'flipped' AS method, * FROM m),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS (SELECT method, avg(ndcg) AS ndcg, avg(mrr) AS mrr, count(*) AS n FROM u GROUP BY 1), base AS (SELECT ndcg FROM s WHERE method = 'own')
SELECT 'd' AS dataset, method, n AS n_queries_judged, round(s.ndcg, 6) AS headline, round(mrr, 6) AS mrr_at_10, CASE WHEN method = 'own' THEN NULL ELSE round(s.ndcg - base.ndcg, 6) END AS delta FROM s, base""")
def dataset_report(spark, sf_dir):
    """EVL-8, EVL-10, EVL-11: methods, headline and the difference from the baseline."""
    runs, qrels = _two_methods(spark, sf_dir)
    found = report.evaluate_dataset("d", runs, qrels, [KEEP], "own", rounds=50)
    table = report.headline_table(found["rows"], found["bootstrap"]).select("dataset", "method", "delta")
    rows = found["rows"].select("dataset", "method", "n_queries_judged", "headline", "mrr_at_10").join(table, ["dataset", "method"])
    return rows.select("dataset", "method", "n_queries_judged", *(F.round(c, 6).alias(c) for c in ("headline", "mrr_at_10", "delta")))


@query(f"""WITH {_RUN}, {_LAST}, {_METHODS}, o AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc_id) AS k FROM r2), t AS (SELECT * FROM o WHERE k <= 10), b AS (SELECT query_id, doc_id FROM t WHERE method = 'own'),
h AS (SELECT t.method, t.query_id, count(b.doc_id) / 10 AS r FROM t LEFT JOIN b ON t.query_id = b.query_id AND t.doc_id = b.doc_id GROUP BY 1, 2) SELECT method, round(avg(r), 6)::DOUBLE AS ann_recall FROM h GROUP BY 1""")
def ann_recall_of_methods(spark, sf_dir):
    """EVL-7."""
    runs, _ = _two_methods(spark, sf_dir)
    return report.ann_recall(runs, "own", 10).withColumn("ann_recall", F.round("ann_recall", 6))


@query(f"WITH t AS ({_RUNS}) SELECT method, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(count(*) * 1000 / sum(ms), 6)::DOUBLE AS qps FROM t GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    """EVL-12."""
    return V.latency_summary(_timings(spark, sf_dir), ["method"]).select("method", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "qps")))


@query(f"""WITH t AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'flat' ELSE method END AS method, n_docs, ms FROM ({_RUNS})), l AS (SELECT method, n_docs, arg_max(ms, vec_id) AS qps FROM t GROUP BY 1, 2)
SELECT a.method, a.n_docs, a.qps AS queries_per_second, round(a.qps / b.qps, 6) AS speedup FROM l a LEFT JOIN l b ON a.n_docs = b.n_docs AND b.method = 'flat'""")
def timing_size_sweep(spark, sf_dir):
    """EVL-13."""
    t = _timings(spark, sf_dir).withColumn("method", F.when(F.col("row_id") % 3 == 0, "flat").otherwise(F.col("method"))).withColumnRenamed("ms", "queries_per_second")
    return report.size_sweep(t, ["method"], "row_id").select("method", "n_docs", "queries_per_second", F.round("speedup", 6).alias("speedup"))


@query("""WITH d AS (SELECT doc_id, trim(lang || chr(10) || text, ' ') AS text FROM documents) SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS row_id, doc_id, md5(lang || chr(10) || coalesce(text, '')) AS text_md5 FROM documents""")
def corpus_preparation(spark, sf_dir):
    """EVL-14: titles are languages here; the encoder itself is left out."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("title"), "text")
    none = spark.createDataFrame([], "query_id string, text string")
    got = report.prepared(d, none, spark.createDataFrame([], "query_id string, doc_id long, rel int"))["docs"]
    return got.select("row_id", "doc_id", F.md5("text").alias("text_md5"))


# ---- probes

_CODES = "k AS (SELECT id, list((r * 4) // 64 ORDER BY pos) AS c FROM rk GROUP BY id)"
_HAM = "list_sum(list_transform(range(1, 65), lambda i: (q.c[i] <> v.c[i])::INT))"


@query(f"""WITH {BASE}, {_CODES}, s AS (SELECT q.id AS query_id, {_HAM} AS h FROM k q, k v WHERE q.id % 100 = 0 AND q.id <> v.id), m AS (SELECT query_id, min(h) AS nearest FROM s GROUP BY 1)
SELECT s.query_id, max(nearest)::BIGINT AS nearest, count(*) AS near FROM s JOIN m ON s.query_id = m.query_id WHERE h <= greatest(nearest + nearest // 2, nearest + 1) GROUP BY 1""")
def near_collisions(spark, sf_dir):
    """EXP-1."""
    v = vectors(spark, sf_dir)
    return probes.near_collisions(v, asked(v), 2)


@query(f"""WITH {BASE}, {_CODES}, s AS (SELECT q.id AS query_id, v.id AS row_id, {_HAM} AS h FROM k q, k v WHERE q.id % 100 = 0), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h, row_id) AS n FROM s) WHERE n <= 41 AND query_id <> row_id),
p AS (SELECT c.query_id, c.row_id, {summed('q.x[i] * v.x[i]')} / q.norm / v.norm AS cosine FROM c JOIN v AS q ON q.id = c.query_id JOIN v ON v.id = c.row_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS a, count(*) OVER (PARTITION BY query_id) // 2 AS half FROM p),
t AS (SELECT o.query_id, o.row_id, a.pos FROM o JOIN rk a ON a.id = o.query_id AND a.rq < 16 UNION SELECT o.query_id, o.row_id, b.pos FROM o JOIN rk b ON b.id = o.row_id AND b.rq < 16),
u AS (SELECT t.query_id, t.row_id, t.pos, q.x AS a, d.x AS b FROM t JOIN rk q ON q.id = t.query_id AND q.pos = t.pos JOIN rk d ON d.id = t.row_id AND d.pos = t.pos),
g AS (SELECT i.query_id, i.row_id, avg((sign(i.a - j.a) <> sign(i.b - j.b))::INT) AS tau FROM u i JOIN u j ON i.query_id = j.query_id AND i.row_id = j.row_id AND i.pos < j.pos GROUP BY 1, 2)
SELECT o.query_id, round(avg(CASE WHEN a <= half THEN tau END), 6) AS near_tau, round(avg(CASE WHEN a > half THEN tau END), 6) AS far_tau, round(avg(CASE WHEN a <= half THEN cosine END), 6) AS near_cosine, round(avg(CASE WHEN a > half THEN cosine END), 6) AS far_cosine
FROM o JOIN g ON o.query_id = g.query_id AND o.row_id = g.row_id GROUP BY 1""")
def lookalike_order(spark, sf_dir):
    """EXP-1: the order of coordinates in true neighbours and in lookalikes."""
    v = vectors(spark, sf_dir)
    return probes.lookalike_order(v, asked(v), 2).select("query_id", *(F.round(c, 6).alias(c) for c in ("near_tau", "far_tau", "near_cosine", "far_cosine")))


def _uniformity(scheme):
    bounds = probes.cuts(scheme, 2, DIM)
    cut = " + ".join(f"(r + 0.5 > {c!r})::INT" for c in bounds)
    sql = f"""WITH {BASE}, b AS (SELECT id, pos, {cut} AS b FROM rk), c AS (SELECT i.id, g.b, count(b.b)::DOUBLE AS n FROM (SELECT DISTINCT id FROM b) i CROSS JOIN range(4) AS g(b) LEFT JOIN b ON b.id = i.id AND b.b = g.b GROUP BY 1, 2),
s AS (SELECT b, stddev_pop(n) AS sd, avg(n) AS m FROM c GROUP BY b), p AS (SELECT pos, count(*)::DOUBLE AS n FROM b WHERE b = 3 GROUP BY pos), z AS (SELECT count(DISTINCT id)::DOUBLE AS rows FROM b), o AS (SELECT sum(n * (n - 1)) / max(rows * (rows - 1)) AS seen FROM p, z)
SELECT round(avg(sd), 6) AS comp_std, round(sum(CASE WHEN m > 0 THEN -(m / 64) * log2(m / 64) ELSE 0 END), 6) AS entropy, round(abs(max(seen) - max(CASE WHEN b = 3 THEN m * m / 64 END)) / max(CASE WHEN b = 3 THEN m * m / 64 END), 6) AS null_err FROM s, o"""

    def run(spark, sf_dir):
        got = probes.uniformity(vectors(spark, sf_dir), DIM, 2, bounds)
        return got.select(*(F.round(c, 6).alias(c) for c in got.columns))

    query(sql, f"uniformity_{scheme}")(run)


_uniformity("equal")
_uniformity("golden")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT ((vec_id * 7919) % 997) / 997.0::DOUBLE * n AS key FROM embeddings, n), w AS (SELECT i * ((n - 8.0::DOUBLE) / 500) AS a FROM range(500) AS t(i), n),
c AS (SELECT a, count(key) AS n FROM w LEFT JOIN k ON key >= a AND key < a + 8.0 GROUP BY a) SELECT round(var_pop(n), 6) AS sigma2 FROM c""")
def number_variance(spark, sf_dir):
    """EXP-2."""
    v = vectors(spark, sf_dir)
    n = v.count()
    keys = v.select((((F.col("row_id") * 7919) % 997) / F.lit(997.0) * F.lit(n)).alias("key"))
    return probes.number_variance(keys, 8.0, 500).withColumn("sigma2", F.round("sigma2", 6))


_ERF = "CASE WHEN t = 0 THEN 0 ELSE sign(t) * list_sum(list_transform(range(0, 200), lambda n: exp(2 * n * ln(2) + lgamma(n + 1) + (2 * n + 1) * ln(abs(t)) - lgamma(2 * n + 2) - t * t))) * 2 / sqrt(pi()) END"


@query(f"""WITH {BASE}, axes(axis, d) AS (VALUES {cat._AXIS}), n AS (SELECT count(*) AS n FROM embeddings), z AS (SELECT axis, {cat._DOT} * sqrt(32) AS t FROM v, axes),
k AS (SELECT axis, n * 0.5 * (1 + {_ERF}) AS key FROM z, n), w AS (SELECT axis, length, i * ((n - length) / 500) AS a FROM axes, range(500) AS t(i), (VALUES (2.0::DOUBLE), (8.0::DOUBLE)) AS l(length), n),
c AS (SELECT w.axis, length, a, count(key) AS n FROM w LEFT JOIN k ON w.axis = k.axis AND key >= a AND key < a + length GROUP BY 1, 2, 3) SELECT axis::INT AS axis, length, round(var_pop(n), 6) AS sigma2 FROM c GROUP BY 1, 2""")
def projected_number_variance(spark, sf_dir):
    """EXP-2: rows projected on axes, unfolded by the normal distribution, counted in windows of two lengths."""
    v, out = vectors(spark, sf_dir), None
    for a, axis in enumerate(AXES):
        keys = probes.gaussian_keys(v, axis)
        for length in (2.0, 8.0):
            part = probes.number_variance(keys, length, 500).select(F.lit(a).alias("axis"), F.lit(length).alias("length"), F.round("sigma2", 6).alias("sigma2"))
            out = part if out is None else out.union(part)
    return out


@query("""WITH p(m, a) AS (VALUES (3, 0), (5, 1), (7, 2), (11, 3)), d AS (SELECT vec_id AS x, max(least((vec_id - a + 11 * m) % m, m - (vec_id - a + 11 * m) % m)) AS far FROM embeddings, p GROUP BY 1)
SELECT count(*) AS positions, sum((far <= 1)::INT)::BIGINT AS joint, min(far)::BIGINT AS floor FROM d""")
def ring_seams(spark, sf_dir):
    """EXP-8, at the places of the table's rows."""
    got = probes.seams(spark, [3, 5, 7, 11], [0, 1, 2, 3], 1, vectors(spark, sf_dir).select(F.col("row_id").alias("id")))
    return got.select("positions", "joint", F.col("floor").cast("long").alias("floor"))


_CELL = f"c AS (SELECT id, sum(CASE WHEN d > 0 THEN 1 << a::INT ELSE 0 END)::BIGINT AS cell FROM (SELECT v.id, axis AS a, {cat._DOT} AS d FROM v, axes) GROUP BY id)"


@query(f"""WITH {BASE}, axes(axis, d) AS (VALUES {cat._AXIS}), {_CELL}, g AS ({recall_sql(scored(SQL_FLAT))}), t AS (SELECT query_id, row_id FROM ({scored(SQL_FLAT)})),
n AS (SELECT id AS query_id, near, row_number() OVER (PARTITION BY id ORDER BY bit_count(xor(cell, near)), near) AS probe FROM c, range(16) AS x(near) WHERE id % 100 = 0),
z AS (SELECT near, count(*) AS n FROM (SELECT cell AS near FROM c) GROUP BY 1), p AS (SELECT unnest([1, 4, 8]) AS probes)
SELECT probes::INT AS probes, round((SELECT sum(z.n) FROM n JOIN z ON n.near = z.near WHERE probe <= probes) / (SELECT count(DISTINCT query_id) FROM t), 6)::DOUBLE AS scanned,
round((SELECT count(*) FROM t JOIN c ON c.id = t.row_id JOIN n ON n.query_id = t.query_id AND n.near = c.cell WHERE probe <= probes) / (SELECT count(*) FROM t), 6)::DOUBLE AS recall FROM p""".replace(f"g AS ({recall_sql(scored(SQL_FLAT))}), ", ""))
def cell_balance(spark, sf_dir):
    """EXP-9, CND-16."""
    v = vectors(spark, sf_dir)
    got = probes.cell_balance(v, asked(v), truth(spark, sf_dir), AXES, [1, 4, 8])
    return got.select("probes", F.round("scanned", 6).alias("scanned"), F.round("recall", 6).alias("recall"))


def _l1(side):
    return f"""WITH {BASE}, m AS (SELECT pos, avg(x) AS m FROM rk GROUP BY pos), y AS (SELECT rk.id, rk.pos, row_number() OVER (PARTITION BY rk.id ORDER BY {side}, rk.pos) - 1 AS r FROM rk JOIN m ON rk.pos = m.pos), k AS (SELECT id, list((r * 4) // 64 ORDER BY pos) AS c FROM y GROUP BY id),
t AS (SELECT query_id, row_id FROM ({scored(SQL_FLAT)})), s AS (SELECT q.id AS query_id, v.id AS row_id, list_sum(list_transform(range(1, 65), lambda i: abs(q.c[i] - v.c[i]))) AS h FROM k q, k v WHERE q.id % 100 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h, row_id) AS n FROM s) SELECT {{}} AS centred, round(sum((n <= {KEEP})::INT) / count(*), 6)::DOUBLE AS recall, round(sum((n <= {STAGE})::INT) / count(*), 6)::DOUBLE AS candidate_recall FROM t JOIN o ON t.query_id = o.query_id AND t.row_id = o.row_id"""


@query(f"SELECT * FROM ({_l1('x::FLOAT').format('false')}) UNION ALL SELECT * FROM ({_l1('(x - m)::FLOAT').format('true')})")
def centring_recall(spark, sf_dir):
    """EXP-10."""
    v = vectors(spark, sf_dir).select("row_id", "embedding")
    got = probes.centring_recall(v, asked(v), 2, KEEP, STAGE)
    return got.select("centred", F.round("recall", 6).alias("recall"), F.round("candidate_recall", 6).alias("candidate_recall"))


@query(f"WITH {CELLS}, w(name) AS (VALUES ('top_overlap'), ('diagonal_agreement'), ('band_agreement'), ('top_group_overlap'), ('bucket_l1_distance')) SELECT query_id, row_id, name, sum(CASE name WHEN 'top_overlap' THEN (a = 3 AND b = 3)::INT WHEN 'diagonal_agreement' THEN (a = b)::INT WHEN 'band_agreement' THEN (abs(a - b) <= 2)::INT WHEN 'top_group_overlap' THEN (a >= 1 AND b >= 1)::INT ELSE abs(a - b) END * n)::BIGINT AS value FROM z, w GROUP BY 1, 2, 3")
def projections_by_name(spark, sf_dir):
    """CTG-12."""
    asked_for = {"top_overlap": None, "diagonal_agreement": None, "band_agreement": 2, "top_group_overlap": 3, "bucket_l1_distance": None}
    each = F.array(*(C.projection(n, C.cell_columns(4), 4, p).cast("long") for n, p in asked_for.items()))
    listed = cat.tables(spark, sf_dir).select("query_id", "row_id", F.posexplode(each).alias("i", "value"))
    return listed.select("query_id", "row_id", F.get(F.array(*map(F.lit, asked_for)), "i").alias("name"), "value")


# ---- cells and intervals

CELL_AXES = research.directions(DIM, 9, 4)
_CELL_AXES = ", ".join(f"({i}, [{', '.join(repr(float(x)) for x in a)}])" for i, a in enumerate(CELL_AXES))


@query(f"""WITH {BASE}, axes(i, d) AS (VALUES {_CELL_AXES}), c AS (SELECT v.id, sum(CASE WHEN {summed('v.x[i] * axes.d[i]')} > 0 THEN 1 << axes.i ELSE 0 END)::BIGINT AS cell FROM v, axes GROUP BY 1),
p AS (SELECT id AS query_id, near, bit_count(xor(cell, near)) AS distance, row_number() OVER (PARTITION BY id ORDER BY bit_count(xor(cell, near)), near) AS probe FROM c, range(512) AS t(near) WHERE id % 100 = 0)
SELECT query_id, probe::INT AS probe, distance::INT AS distance, c.cell, c.id AS row_id FROM p JOIN c ON c.cell = p.near WHERE probe <= 12""")
def cell_layout_probe(spark, sf_dir):
    """CND-16, EXP-9: rows laid out by cell, and the twelve cells nearest to each query's read."""
    v = vectors(spark, sf_dir)
    laid = cells.CellTable(spark, place(spark, "cells"), CELL_AXES).write(v.select("row_id", "embedding"))
    return laid.probe(asked(v), 12).select("query_id", "probe", "distance", "cell", "row_id")


@query(f"WITH {BASE}, q AS (SELECT * FROM v WHERE id % 100 = 0), s AS (SELECT q.id AS query_id, {SQL_HAMMING} AS score FROM q, v) SELECT query_id, score::INT AS score, count(*) AS n FROM s GROUP BY 1, 2")
def sign_histogram(spark, sf_dir):
    """CND-13: how many rows have each distance, counted in the tasks."""
    v = vectors(spark, sf_dir)
    return search.histogram(v, asked(v), K.sign_hamming())


def _one_pass(n_top):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        ix = I.TwoStageIndex(spark, DIM, 2, n_top).add(v, "row_id")
        return rounded(ix.search_two_stage(asked(v), KEEP, CandidatePolicy(STAGE, 1, STAGE)))

    return run


query(stage_sql(SQL_HAMMING, "ASC", sql_asym(2), STAGE), "one_pass_sign_b2")(_one_pass(None))
query(stage_sql(SQL_OVERLAP, "DESC", sql_asym(2), STAGE), "one_pass_bitmap_b2")(_one_pass(TOP))

ROUNDS = 200
_DRAW = "('0x' || substr(md5('0:' || query_id || ':' || round), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_WEIGHT = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in V.POISSON)
_RUNS_OF = {"b2": sql_asym(2), "b1": sql_asym(1), "flat": SQL_FLAT}


@query(f"""WITH a AS ({' UNION ALL '.join(f"SELECT '{m}' AS method, query_id, ndcg, mrr FROM ({metric_sql(scored(x))})" for m, x in _RUNS_OF.items())}),
l AS (SELECT method, 'ndcg' AS metric, query_id, ndcg AS value FROM a UNION ALL SELECT method, 'mrr', query_id, mrr FROM a),
d AS (SELECT l.method, l.metric, l.query_id, l.value - b.value AS d FROM l JOIN l AS b ON l.metric = b.metric AND l.query_id = b.query_id WHERE b.method = 'flat' AND l.method <> 'flat'),
u AS (SELECT d.*, round, {_DRAW} AS u FROM d, range(1, {ROUNDS + 1}) AS t(round)), w AS (SELECT *, {_WEIGHT} AS w FROM u), r AS (SELECT method, metric, round, sum(w * d) / nullif(sum(w), 0) AS mean FROM w GROUP BY 1, 2, 3),
e AS (SELECT method, metric, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM r GROUP BY 1, 2), m AS (SELECT method, metric, avg(d) AS delta FROM d GROUP BY 1, 2)
SELECT m.method, m.metric, round(delta, 5) AS delta, round(low, 5) AS low, round(high, 5) AS high, low <= 0 AND high >= 0 AS within_noise FROM m JOIN e ON m.method = e.method AND m.metric = e.metric""")
def bootstrap_intervals(spark, sf_dir):
    """EVL-8: differences from exact search with their intervals, all methods, metrics and rounds in one aggregation."""
    v = vectors(spark, sf_dir)
    truth_of, parts = judged(spark, sf_dir), None
    for m, scorer in (("b2", K.bucket_asymmetric(DIM, 2)), ("b1", K.bucket_asymmetric(DIM, 1)), ("flat", K.inner_product())):
        run = rounded(search.search(v, asked(v), scorer, KEEP)).select("query_id", F.col("row_id").alias("doc_id"), "score")
        part = V.metrics_at(run, truth_of, KEEP).select(F.lit(m).alias("method"), "query_id", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("value")) for c in ("ndcg", "mrr")))).alias("v")).select("method", "v.metric", "query_id", "v.value")
        parts = part if parts is None else parts.union(part)
    found = V.resampled(parts, "flat", ROUNDS)
    return found.select("method", "metric", *(F.round(c, 5).alias(c) for c in ("delta", "low", "high")), "within_noise")


_CUT = "list_transform(range(1, 65), lambda i: CASE WHEN i <= l AND vec_id % 7 <> 3 THEN embedding[i] ELSE 0 END)"


@query(f"""WITH p AS (SELECT vec_id, part, {_CUT} AS e FROM embeddings, (VALUES (0, 16), (1, 40), (2, 64)) AS t(part, l) WHERE part = 0 OR vec_id % 2 = 0)
SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS row_id, part::INT AS part, vec_id AS source, round(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS size FROM p WHERE len(list_filter(e, lambda x: x <> 0)) > 0""")
def length_mixture(spark, sf_dir):
    """EXP-11: one corpus at three lengths, rows without any content left out."""
    v = vectors(spark, sf_dir)
    cut = lambda n: F.transform("embedding", lambda x, i: F.when((i < n) & (F.col("row_id") % 7 != 3), x).otherwise(F.lit(0.0).cast("float")))
    parts = [t.select("row_id", cut(n).alias("embedding")) for t, n in ((v, 16), (v.where("row_id % 2 = 0"), 40), (v.where("row_id % 2 = 0"), 64))]
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return probes.length_mixture(parts, DIM).select("row_id", "part", "source", F.round(size, 5).alias("size"))


@query("""WITH p AS (SELECT 0 AS part, count(*) // 2 AS n FROM embeddings UNION ALL SELECT 1, count(*) FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT sum(n) AS rows FROM p),
s AS (SELECT sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings WHERE vec_id % 2 = 0)
SELECT part::INT AS part, n, rows::BIGINT AS ids, rows::BIGINT AS after_last, CASE WHEN part = 1 THEN round(size, 3) END AS size FROM p, t, s WHERE n > 0""")
def mixed_corpus(spark, sf_dir):
    """EXP-11: half of one corpus and the whole of another in one hashed order, its row ids without gaps."""
    v = vectors(spark, sf_dir)
    even, n = v.where("row_id % 2 = 0"), v.count()
    got = written(probes.mixed_corpus([(v, n // 2), (even, n)], 7), "mixed")
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    parts = got.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum(size), 3).alias("size"))
    ids = got.agg(F.count_distinct("row_id").alias("ids"), (F.max("row_id") + 1).alias("after_last"))  # one row
    return parts.join(F.broadcast(ids)).select("part", "n", "ids", "after_last", F.when(F.col("part") == 1, F.col("size")).alias("size"))
