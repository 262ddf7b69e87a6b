"""Index objects: a table of codes (row_id, value) with its descriptor, to add to, search, shrink, write and load.

An index keeps packed codes only, bytes_per_vec bytes a row, as index files do; tasks unpack them by the block. Row ids are
dense, in the order of the key that add() is given. Each change makes a new table; keep() writes it out where a long chain of
changes is to be cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import kernels
from rankmill.functions.blocks import byte_values, dot_by_byte, unpacked, words_of
from rankmill.functions.kernels import Scorer
from rankmill.operators import mutate, search, validate
from rankmill.sources import formats
from rankmill.spec import MAX_VECTORS, BitmapSpec, BucketSpec, CandidatePolicy, MultiBucketSpec, PairScanSpec, ParameterError, RankSpec, SignSpec, asymmetric_norm, bucket_centre, rank_norm


def _words(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags.astype(bool), axis=1, bitorder="little").view("<i8")


class ClosedError(ParameterError):
    """An index that was closed."""


class Index:
    kind = ""

    def __init__(self, spark: SparkSession, spec, codes: DataFrame | None = None):
        self.spark, self.spec, self.closed = spark, spec, False
        self._codes = codes if codes is not None else spark.createDataFrame([], "row_id long, value binary")
        self._moves: mutate.Moves | None = None

    # what a family fills in
    def _encoder(self):
        """A function from a block of vectors to codes: numbers a coordinate, or words."""
        raise NotImplementedError

    @property
    def codes(self) -> DataFrame:
        """(row_id, value): the packed codes."""
        if self.closed:
            raise ClosedError("the index is closed")
        return self._codes if self._moves is None else self._moves.over(self._codes)

    @codes.setter
    def codes(self, table: DataFrame) -> None:
        self._codes, self._moves = table, None

    def close(self) -> None:
        """Nothing is done with a closed index; closing it again does nothing."""
        self.closed = True

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def _bits(self) -> int | None:
        return getattr(self.spec, "bits", None)

    def _coordinates(self):
        """A function from packed codes to a matrix: numbers a coordinate, or words."""
        kind, width, dim, bits = self.kind, self.spec.bytes_per_vec, self.spec.dim, self._bits
        return lambda column: formats.rows_of_bytes(kind, formats.matrix_of(column, width), dim, bits)

    def _decode(self):
        """A function from packed codes to what the scorers take."""
        return self._coordinates()

    def arrays(self) -> DataFrame:
        """(row_id, value): the codes as arrays of numbers."""
        decode = self._coordinates()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = decode(batch.column(1)).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row_id", "value"])

        return self.codes.select("row_id", "value").mapInArrow(run, "row_id long, value array<long>")

    def add(self, vectors: DataFrame, key: str, vector: str = "embedding") -> Index:
        """Encodes vectors and puts them behind the rows there are, in order of key. Bad vectors fail the job."""
        encoded, kind, bits, dim = self._encoder(), self.kind, self._bits, self.spec.dim
        kind_of_key = vectors.schema[key].dataType.simpleString()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = kernels.block(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), formats.column_of(formats.row_bytes(kind, encoded(x), bits))], names=["ix_key", "value"])

        coded = vectors.select(F.col(key), F.col(vector).cast("array<float>")).mapInArrow(run, f"ix_key {kind_of_key}, value binary")
        self.codes = mutate.append(self.codes, coded, "ix_key")
        return self

    def keep(self, path: str) -> Index:
        self.codes.write.parquet(path)
        self.codes = self.spark.read.parquet(path)
        return self

    def swap_remove(self, row_id: int) -> int:
        """Removes a row, puts the last one in its place, and returns where that was. keep() writes removals out."""
        if self.closed:
            raise ClosedError("the index is closed")
        if self._moves is None:
            self._moves = mutate.Moves(len(self))
        return self._moves.remove(row_id)

    def __len__(self) -> int:
        return self.codes.count() if self._moves is None or self.closed else self._moves.rows

    @property
    def is_empty(self) -> bool:
        return not self.codes.limit(1).count()

    @property
    def bytes_per_vec(self) -> int:
        return self.spec.bytes_per_vec

    @property
    def byte_size(self) -> int:
        return len(self) * self.bytes_per_vec

    def capabilities(self) -> frozenset[str]:
        """What searches there are."""
        names = ("search", "search_asymmetric", "search_subset", "search_asymmetric_subset", "top_m_candidates", "score_all")
        return frozenset(n for n in names if hasattr(self, n) and (n != "search" or getattr(self.spec, "symmetric", True)))

    def info(self) -> dict:
        """Descriptor, size and capabilities."""
        return {"kind": self.kind, "dim": self.spec.dim, "vector_count": len(self), "bytes_per_vec": self.bytes_per_vec, **self._parameters(), "capabilities": sorted(self.capabilities())}

    def _parameters(self) -> dict:
        return {}

    def write(self, path: str) -> formats.Metadata:
        return formats.write(self.codes, path, self.kind, self.spec.dim, **self._parameters())

    def write_to(self, stream) -> int:
        return formats.write_to(self.codes, stream, self.kind, self.spec.dim, **self._parameters())

    def _best(self) -> Scorer:
        """The score of search_one()."""
        raise NotImplementedError

    def search_one(self, query: list[float], k: int, candidates: list[int] | None = None) -> tuple[list[tuple[int, float]], dict]:
        """(hits, stats) of one query over all rows, or over a list of them."""
        if len(query) != self.spec.dim:
            raise ParameterError(f"the query hasn't {self.spec.dim} coordinates")
        return search.search_one(self.codes, query, self._best(), k, candidates, code="value", decode=self._decode())

    def _found(self, queries, scorer, k, **names):
        return search.search(self.codes, queries, scorer, k, code="value", decode=self._decode(), **names)

    def _subset(self, queries, candidates, scorer, k, own: bool = False, **names):
        """own: the candidates are known to be rows of this index."""
        if not own and validate.unknown_candidates(candidates, self.codes).limit(1).count():
            raise ParameterError("a candidate is no row of this index")
        return search.search_subset(self.codes, queries, candidates, scorer, k, code="value", decode=self._decode(), **names)


class RankIndex(Index):
    kind = "rank"

    def __init__(self, spark, dim: int, codes=None):
        super().__init__(spark, RankSpec(dim), codes)

    def _encoder(self):
        return kernels.ranks

    def _best(self):
        return self._asymmetric()

    def _asymmetric(self) -> Scorer:
        s, dim = kernels.rank_asymmetric(self.spec.dim), self.spec.dim
        return Scorer(lambda d: d.astype(np.float64), s.queries, lambda d, q: (d @ q.T - (dim - 1) / 2 * q.sum(1)) / rank_norm(dim))

    def search(self, queries, k: int, **names):
        s, dim = kernels.rank_symmetric(self.spec.dim), self.spec.dim
        return self._found(queries, Scorer(lambda d: (2 * d - (dim - 1)).astype(np.float64), s.queries, s.score), k, **names)

    def search_asymmetric(self, queries, k: int, **names):
        return self._found(queries, self._asymmetric(), k, **names)


class BucketIndex(Index):
    kind = "buckets"

    def __init__(self, spark, dim: int, bits: int, asymmetric_only: bool = False, codes=None):
        super().__init__(spark, BucketSpec(dim, bits, asymmetric_only), codes)

    def _encoder(self):
        bits = self.spec.bits
        return lambda x: kernels.codes(x, bits)

    def _best(self):
        return self._asymmetric()

    def _parameters(self):
        return {"bits": self.spec.bits}

    def _decode(self):
        """Packed codes as they are stored; the scorers look their bytes up."""
        width = self.spec.bytes_per_vec
        return lambda column: formats.matrix_of(column, width)

    def _asymmetric(self) -> Scorer:
        dim, bits = self.spec.dim, self.spec.bits
        centred, norm = byte_values(bits, np.arange(1 << bits) + bucket_centre(0, bits)), asymmetric_norm(dim, bits)
        docs = lambda b: unpacked(b, centred)
        return Scorer(docs, kernels.unit, lambda d, q: d @ q.T / norm, lift=docs, width=1, one=lambda b, q: dot_by_byte(b, q, centred) / norm)

    def search(self, queries, k: int, **names):
        self.spec.need_symmetric()
        s, bits = kernels.bucket_symmetric(self.spec.dim, self.spec.bits), self.spec.bits
        twice = byte_values(bits, 2.0 * np.arange(1 << bits) - ((1 << bits) - 1))
        return self._found(queries, Scorer(lambda b: unpacked(b, twice), s.queries, s.score), k, **names)

    def search_asymmetric(self, queries, k: int, **names):
        return self._found(queries, self._asymmetric(), k, **names)

    def search_asymmetric_subset(self, queries, candidates, k: int, **names):
        """candidates (query_id, pos, row_id); a row listed twice may be found twice."""
        return self._subset(queries, candidates, self._asymmetric(), k, **names)

    def search_asymmetric_subset_padded(self, queries, candidates, k: int, **names):
        return search.padded(self.search_asymmetric_subset(queries, candidates, k, **names), queries, min(k, len(self)))

    def search_with_sign_probe(self, probe: SignIndex | BitmapIndex, queries, k: int, policy: CandidatePolicy = CandidatePolicy(), **names):
        """The best k of the candidates that a probe of the same rows, of signs or of top bits, hands on."""
        n = len(self)
        if probe.spec.dim != self.spec.dim or len(probe) != n:
            raise ParameterError("the probe is of another dim or length")
        m = policy.candidate_count(k, n)
        return self._subset(queries, probe.top_m_candidates(queries, m, **names), self._asymmetric(), k, own=True, most=m, **names)


class PairScanIndex(Index):
    kind = "pairs"

    def __init__(self, spark, dim: int, codes=None):
        super().__init__(spark, PairScanSpec(dim), codes)

    def add(self, vectors, key, vector="embedding"):
        if not self.is_empty:
            raise ParameterError("this index is filled at once")
        return super().add(vectors, key, vector)

    def _encoder(self):
        return lambda x: kernels.codes(x, 2)

    def _best(self):
        s = kernels.pair_scan(self.spec.dim)
        return Scorer(kernels.paired, s.queries, s.score)

    def _decode(self):
        """Values of pairs, a byte each, as they are stored."""
        width = self.spec.bytes_per_vec
        return lambda column: formats.matrix_of(column, width)

    def search(self, queries, k: int, **names):
        return self._found(queries, self._best(), k, **names)


class BitmapIndex(Index):
    kind = "bitmap"

    def __init__(self, spark, dim: int, n_top: int, codes=None):
        super().__init__(spark, BitmapSpec(dim, n_top), codes)

    def _encoder(self):
        n_top = self.spec.n_top
        return lambda x: _words(kernels.top_doc(x, n_top))

    def _best(self):
        return self._scorer()

    def _parameters(self):
        return {"n_top": self.spec.n_top}

    def _scorer(self) -> Scorer:
        s = kernels.bitmap_overlap(self.spec.n_top)
        return Scorer(lambda d: d, s.queries, s.score)

    def search(self, queries, k: int, **names):
        return self._found(queries, self._scorer(), k, **names)

    def search_subset(self, queries, candidates, k: int, **names):
        return self._subset(queries, candidates, self._scorer(), k, **names)

    def top_m_candidates(self, queries, m: int, **names):
        return search.candidates(self.codes, queries, self._scorer(), m, code="value", decode=self._decode(), **names)

    def body_overlap_scores_subset(self, queries, candidates, **names):
        return search.score_candidates(self.codes, queries, candidates, self._scorer(), code="value", decode=self._decode(), **names)


class SignIndex(Index):
    kind = "sign"

    def __init__(self, spark, dim: int, codes=None):
        super().__init__(spark, SignSpec(dim), codes)

    def _encoder(self):
        return lambda x: _words(x > 0)

    def _best(self):
        return self._scorer()

    def _scorer(self) -> Scorer:
        s = kernels.sign_hamming()
        return Scorer(lambda d: d, s.queries, s.score, largest=False)

    def top_m_candidates(self, queries, m: int, **names):
        return search.candidates(self.codes, queries, self._scorer(), m, code="value", decode=self._decode(), **names)

    def top_m_candidates_csr(self, queries, m: int, **names):
        return search.csr(self.top_m_candidates(queries, m, **names))

    def score_all(self, queries, **names):
        """(query_id, row_id, score): how many coordinates agree in sign."""
        s = search.score_all(self.codes, queries, self._scorer(), code="value", decode=self._decode(), **names)
        return s.withColumn("score", (self.spec.dim - F.col("score")).cast("int"))

    def score_all_rows(self, queries, **names):
        """(query_id, scores): the same, an array a query in order of row id."""
        s = search.score_rows(self.codes, queries, self._scorer(), code="value", decode=self._decode(), **names)
        return s.withColumn("scores", F.transform("scores", lambda x: (self.spec.dim - x).cast("int")))


class TwoStageIndex(BucketIndex):
    """Bucket codes with a probe's code beside each, of signs or of n_top top bits: two stages in one pass over the rows."""

    def __init__(self, spark, dim: int, bits: int = 2, n_top: int | None = None, codes=None):
        super().__init__(spark, dim, bits, codes=codes if codes is not None else spark.createDataFrame([], "row_id long, value binary, probe binary"))
        self.probe = SignIndex(spark, dim) if n_top is None else BitmapIndex(spark, dim, n_top)

    def add(self, vectors, key, vector="embedding"):
        own, probe, kind, bits, dim = self._encoder(), self.probe._encoder(), self.probe.kind, self._bits, self.spec.dim
        kind_of_key = vectors.schema[key].dataType.simpleString()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = kernels.block(batch.column(1), dim)
                codes = [formats.column_of(formats.row_bytes("buckets", own(x), bits)), formats.column_of(formats.row_bytes(kind, probe(x)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *codes], names=["ix_key", "value", "probe"])

        coded = vectors.select(F.col(key), F.col(vector).cast("array<float>")).mapInArrow(run, f"ix_key {kind_of_key}, value binary, probe binary")
        self.codes = mutate.append(self.codes, coded, "ix_key")
        return self

    @property
    def bytes_per_vec(self) -> int:
        return self.spec.bytes_per_vec + self.probe.spec.bytes_per_vec

    def search_two_stage(self, queries, k: int, policy: CandidatePolicy = CandidatePolicy(), **names):
        """The best k of the candidates that the probe hands on, as many of them as policy says."""
        m = policy.candidate_count(k, MAX_VECTORS)  # of fewer rows all are candidates
        return search.two_stage(self.codes, queries, self.probe._scorer(), self._asymmetric(), m, k, code="probe", decode=self.probe._decode(), beside="value", **names)


class MultiBucketIndex(Index):
    """Bucket codes that are scored by weights on pairs of buckets; it isn't written to files."""

    kind = "buckets"

    def __init__(self, spark, dim: int, bits: int, codes=None):
        MultiBucketSpec(dim, bits)
        super().__init__(spark, BucketSpec(dim, bits), codes)

    def _encoder(self):
        bits = self.spec.bits
        return lambda x: kernels.codes(x, bits)

    def write(self, path):
        raise ParameterError("weighted bucket indexes have no file format")

    def top_m_bilinear(self, queries, weights: list[list[float]], m: int, **names):
        nb, s = 1 << self.spec.bits, kernels.bilinear(self.spec.bits, weights)
        masks = lambda d: np.stack([words_of(d == b) for b in range(nb)], 1)
        return self._found(queries, Scorer(masks, s.queries, s.score), m, **names)


def load(spark: SparkSession, path: str) -> Index:
    """The index of a file of any kind."""
    import os

    with open(path, "rb") as f:
        meta = formats.parse_header(f.read(17), os.path.getsize(path))
    codes = formats.read(spark, path, packed=True)
    if meta.kind == "rank":
        return RankIndex(spark, meta.dim, codes)
    if meta.kind == "buckets":
        return BucketIndex(spark, meta.dim, meta.bits, codes=codes)
    if meta.kind == "bitmap":
        return BitmapIndex(spark, meta.dim, meta.n_top, codes)
    return SignIndex(spark, meta.dim, codes) if meta.kind == "sign" else PairScanIndex(spark, meta.dim, codes)


#: What can go wrong with an index, as a number and a name: 0 is good.
STATUS = {0: "ok", 1: "invalid argument", 2: "unsupported", 3: "bad file", 4: "not found", 5: "closed", 6: "internal"}


def status_of(error: BaseException | None) -> int:
    from rankmill.spec import CapabilityError

    for kind, code in ((type(None), 0), (ClosedError, 5), (CapabilityError, 2), (formats.FormatError, 3), (FileNotFoundError, 4), (ParameterError, 1)):
        if isinstance(error, kind):
            return code
    return 6


def open_index(spark: SparkSession, path: str) -> tuple[Index | None, int, str]:
    """(index, status, message): load() without an exception."""
    try:
        return load(spark, path), 0, ""
    except Exception as e:
        return None, status_of(e), str(e)
