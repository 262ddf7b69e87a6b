"""Operator 2: quality classifier on random-indexing word vectors.

Words are runs of letters, digits or signs. Each falls into one of a fixed number of rows, by hash and by shape (small,
capital first, all capitals, not letters). Each row has a sparse random index vector; its context vector is the sum of
the index vectors of the neighbours of all its words in all documents. Counts are whole numbers, so their sum doesn't
depend on how the documents are split. A document is described by its words' vectors alone: their mean, their deviation,
and how alike the vectors of neighbours are. A two-layer network, fitted with numpy on a bounded sample of
labelled rows, scores that, and a temperature found on rows that it wasn't fitted on makes its probabilities honest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import mapped
from rankmill.llm.text import BASE, U64, chunks, mix, texts

ROWS, DIMS, NONZERO, BLOCKS, SHAPES = 1 << 14, 32, 2, 16, 4
#: Labelled rows that the network is fitted on at most.
MAX_LABELLED = 8000
FEATURES = 2 * DIMS + 1
THRESHOLD = 0.3
SEED = 11


class ShapedWords:
    """The row of every word of a run of texts."""

    def __init__(self):
        kind = np.full(256, 3, np.uint8)
        kind[[0x20, *range(0x09, 0x0E)]] = 0
        kind[48:58] = 2
        kind[65:91] = kind[97:123] = kind[128:] = 1
        self.kind, fold = kind, np.arange(256)
        fold[65:91] += 32
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))[fold]
        self.upper = np.zeros(256, np.int32)
        self.upper[65:91] = 1
        self.powers(1 << 16)

    def powers(self, n):
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, U64)
            x[0] = 1
            setattr(self, name, np.cumprod(x))

    def rows(self, buf, bounds):
        """(row, document) of each word."""
        n = len(buf)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if n >= len(self.pow):
            self.powers(n + 1)
        kind = self.kind[buf]
        edge = np.ones(n, bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge[bounds[(bounds > 0) & (bounds < n)]] = True
        at = np.flatnonzero(edge)
        end = np.append(at[1:], n)
        word = kind[at] > 0
        at, end = at[word], end[word]
        total = np.zeros(n + 1, U64)
        np.cumsum(self.table[buf] * self.pow[:n], out=total[1:])
        h = mix((total[end] - total[at]) * self.inv[at] + (end - at).astype(U64))
        ups = np.zeros(n + 1, np.int32)
        np.cumsum(self.upper[buf], out=ups[1:])
        big, letters = ups[end] - ups[at], kind[at] == 1
        shape = np.where(~letters, 3, np.where(big == 0, 0, np.where((big == 1) & (self.upper[buf[at]] == 1) | (end - at == 1), 1, 2)))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(at, bounds)))
        return (h & U64(ROWS // SHAPES - 1)).astype(np.int64) * SHAPES + shape, doc


def index_vectors():
    """(dimension, sign) of each row's entries that aren't 0."""
    h = mix(np.arange(1, ROWS * NONZERO + 1, dtype=U64) * U64(0x9FB21C651E98DF25)).reshape(ROWS, NONZERO)
    return (h % U64(DIMS)).astype(np.int64), np.where(h >> U64(63), 1.0, -1.0)


def _contexts(batches):
    """Rows (block, counts): this task's sums, in blocks of rows."""
    import pyarrow as pa

    words, (dim, sign) = ShapedWords(), index_vectors()
    total = np.zeros(ROWS * DIMS, np.int64)
    for batch in batches:
        for _, _, buf, bounds in chunks(*texts(batch, "text"), 1 << 20):
            row, doc = words.rows(buf, bounds)
            same = np.flatnonzero(doc[1:] == doc[:-1])
            a, b = row[same], row[same + 1]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(x * DIMS + dim[y, k], sign[y, k], ROWS * DIMS).astype(np.int64)
    if total.any():
        parts = total.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "counts"])


def _summed(batches):
    import pyarrow as pa

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.int64)
            total[b] = total[b] + x if b in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors, of length 1, of all documents: a table of fixed size."""
    sums = mapped(docs.select("text"), _contexts, "block int, counts binary").repartitionById(BLOCKS, F.col("block"))
    out = np.zeros((BLOCKS, ROWS * DIMS // BLOCKS), np.int64)
    for b, x in mapped(sums, _summed, "block int, counts binary").collect():
        out[b] = np.frombuffer(x, np.int64)
    v = out.reshape(ROWS, DIMS).astype(np.float64)
    return (v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(words: ShapedWords, vectors: np.ndarray, buf, bounds) -> np.ndarray:
    """Each text's features; zeros for one without words."""
    docs = len(bounds) - 1
    out = np.zeros((docs, FEATURES))
    row, doc = words.rows(buf, bounds)
    if not len(row):
        return out
    n = np.bincount(doc, minlength=docs)
    has = np.flatnonzero(n)
    at = np.concatenate([[0], np.cumsum(n)])[has]
    v = vectors[row]
    near = np.zeros(len(row), np.float32)
    near[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:]) * (doc[1:] == doc[:-1])
    m = n[has][:, None]
    mean = np.add.reduceat(v, at, axis=0) / m
    v *= v
    out[has, :DIMS] = mean
    out[has, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v, at, axis=0) / m - mean * mean, 0))
    out[has, 2 * DIMS] = np.add.reduceat(near, at) / np.maximum(n[has] - 1, 1)
    return out


def _features(vectors):
    def run(batches):
        import pyarrow as pa

        words = ShapedWords()
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "quality")]
            for lo, hi, buf, bounds in chunks(*texts(batch, "text"), 1 << 19):
                x = pooled(words, vectors, buf, bounds)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in kept), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    return run


class Network:
    """Features, scaled; a layer of tanh; one logit, over the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3):
        rng = np.random.default_rng(SEED)
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.fitted = len(set(y.tolist())) == 2
        self.temperature = 1.0
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(y))
        check, fit = order[: len(y) // 5], order[len(y) // 5 :]
        z = self._scaled(x)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(self.share / (1 - self.share)))]
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, rounds + 1):
            part = fit if len(fit) <= 2048 else fit[rng.integers(0, len(fit), 2048)]
            a = np.tanh(z[part] @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-(a @ self.w[2] + self.w[3]))) - y[part]) / len(part)
            back = d[:, None] * self.w[2] * (1 - a * a)
            grads = [z[part].T @ back + decay * self.w[0], back.sum(0), a.T @ d + decay * self.w[2], np.array(d.sum())]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(set(y[check].tolist())) == 2:
            logit, s = self.logit(x[check]), 2 * y[check] - 1
            self.temperature = min((0.25 * 1.1**i for i in range(40)), key=lambda t: np.logaddexp(0, -s * logit / t).mean())

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x):
        return np.tanh(self._scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def _scores(vectors, network, columns):
    def run(batches):
        import pyarrow as pa

        words = ShapedWords()
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for lo, hi, buf, bounds in chunks(*texts(batch, "text"), 1 << 19):
                s = network.score(pooled(words, vectors, buf, bounds))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in kept), pa.array(s)], names=[*columns, "score"])

    return run


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """(word vectors, network) for docs (doc_id, text), from labels (doc_id, quality) that aren't held out.

    Word vectors are of all documents. The network sees max_labelled labelled documents at most, those with the smallest
    hash of doc_id; of rows that share a doc_id one stands for all, whichever their order. A document labelled both ways
    is seen with each label.
    """
    vectors = word_vectors(docs)
    some = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("quality").isin(0, 1)).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")  # bounded by limit
    rows = mapped(rows, _features(vectors), "doc_id long, quality int, x binary")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()  # max_labelled at most
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), FEATURES)
    return vectors, Network(x, np.array([r.quality for r in rows], float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 if score >= threshold).

    docs: doc_id, text; other columns are ignored. Null and empty texts are scored as texts without words, very long ones
    by all their words. With no usable label all scores are 0.5, with labels of one kind its smoothed share. A row whose
    doc_id is null is not held out. Repeated rows each have a result; a score at the threshold is predicted 1. An empty
    table gives an empty result.
    """
    vectors, network = fit(docs, labels, max_labelled)
    d = mapped(docs.select("doc_id", "text"), _scores(vectors, network, ["doc_id"]), "doc_id long, score double")
    return d.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    vectors, network = fit(docs, labels, max_labelled)
    name = next(c for c in ("score", *(f"score_{i}" for i in range(9))) if c not in docs.columns)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} double"])
    scored = mapped(docs, _renamed(_scores(vectors, network, docs.columns), [*docs.columns, name]), kinds)
    return scored.where(F.col(name) >= threshold).drop(name)


def _renamed(run, names):
    def again(batches):
        for batch in run(batches):
            yield batch.rename_columns(names)

    return again
