"""The same encoders and scores on blocks of vectors, in numpy: what the scans run on Arrow batches.

Scores are exact whole numbers wherever codes meet codes; the rest is in 64-bit floats.
"""

from __future__ import annotations

import math

import numpy as np

from rankmill.functions.blocks import bits_met, looked_up, words_of
from rankmill.spec import ParameterError, asymmetric_norm, bucket_centre, empirical_norm, rank_norm


def block(column, dim: int | None = None) -> np.ndarray:
    """A list column of an Arrow batch as a matrix; all lists must be as long, without nulls and finite."""
    if column.null_count:
        raise ParameterError("a vector is null")
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) == 0:
        return np.empty((0, dim or 0), np.float32)
    dim = dim or int(sizes[0])
    if (sizes != dim).any():
        raise ParameterError(f"a vector doesn't have {dim} coordinates")
    if not np.isfinite(values).all():
        raise ParameterError("a vector has a coordinate that isn't finite")
    return values.reshape(-1, dim)


def ranks(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32) + np.float32(0)  # -0.0 becomes 0.0
    order = np.argsort(x, axis=1, kind="stable")
    out = np.empty(x.shape, np.int64)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(x.shape[1]), x.shape), axis=1)
    return out


def codes(x: np.ndarray, bits: int) -> np.ndarray:
    return (ranks(x) << bits) // x.shape[1]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n <= 1e-12, 0.0, x / np.where(n <= 1e-12, 1.0, n))


def top_doc(x: np.ndarray, n_top: int) -> np.ndarray:
    return (ranks(x) >= x.shape[1] - n_top).astype(np.float32)


def top_query(x: np.ndarray, n_top: int) -> np.ndarray:
    order = np.argsort(-(x.astype(np.float32) + np.float32(0)), axis=1, kind="stable")[:, :n_top]
    out = np.zeros(x.shape, np.float32)
    np.put_along_axis(out, order, 1, axis=1)
    return out


def sign(x: np.ndarray) -> np.ndarray:
    return (x > 0).astype(np.float32)


class Scorer:
    """docs(x) and queries(x) encode vectors; score(d, q) is a matrix, documents by queries; pairs(d, q, at) has one
    score for each row of d, with row at of the queries.

    small(x) is what has to be kept of vectors until they are scored, width bytes a coordinate, and lift() makes of it
    what docs() makes of the vectors.
    """

    def __init__(self, docs, queries, score, largest: bool = True, small=None, lift=None, width: int = 8, one=None):
        self.docs, self.queries, self.score, self.largest = docs, queries, score, largest
        self.small, self.lift, self.width, self._one = small or docs, lift or (lambda d: d), width, one

    def one(self, small: np.ndarray, q, j: int) -> np.ndarray:
        """Scores of what was kept of some rows, for query j."""
        if self._one is not None:
            return self._one(small, q[j])
        own = tuple(x[j : j + 1] for x in q) if isinstance(q, tuple) else q[j : j + 1]
        return self.score(self.lift(small), own)[:, 0].astype(np.float64)

    def pairs(self, d: np.ndarray, q, at: np.ndarray) -> np.ndarray:
        """Rows are taken together by query, so that each run of them is one matrix product."""
        out = np.empty(len(d))
        order = np.argsort(at, kind="stable")
        edge = np.flatnonzero(np.diff(at[order], prepend=-1))
        for lo, hi in zip(edge, np.append(edge[1:], len(order)), strict=True):
            rows, j = order[lo:hi], int(at[order[lo]])
            one = tuple(x[j : j + 1] for x in q) if isinstance(q, tuple) else q[j : j + 1]
            out[rows] = self.score(d[rows], one)[:, 0]
        return out


def rank_symmetric(dim: int) -> Scorer:
    c = lambda x: (2 * ranks(x) - (dim - 1)).astype(np.float64)
    return Scorer(c, c, lambda d, q: d @ q.T / 4 / (rank_norm(dim) * rank_norm(dim)))


def rank_asymmetric(dim: int) -> Scorer:
    return Scorer(lambda x: ranks(x).astype(np.float64), unit, lambda d, q: (d @ q.T - (dim - 1) / 2 * q.sum(1)) / rank_norm(dim))


def bucket_symmetric(dim: int, bits: int, norm: float | None = None) -> Scorer:
    c = lambda x: (2 * codes(x, bits) - ((1 << bits) - 1)).astype(np.float64)
    n = norm or asymmetric_norm(dim, bits)
    return Scorer(c, c, lambda d, q: d @ q.T / 4 / (n * n))


def bucket_any_bits(dim: int, bits: int) -> Scorer:
    """Symmetric, for any bits from 1 to 8 and any dim."""
    return bucket_symmetric(dim, bits, empirical_norm(dim, bits))


def bucket_asymmetric(dim: int, bits: int) -> Scorer:
    lift = lambda c: c + bucket_centre(0, bits)
    small = lambda x: codes(x, bits).astype(np.uint8)
    return Scorer(lambda x: lift(codes(x, bits)), unit, lambda d, q: d @ q.T / asymmetric_norm(dim, bits), small=small, lift=lift, width=1)


def inner_product() -> Scorer:
    f = lambda x: x.astype(np.float64)
    return Scorer(f, f, lambda d, q: d @ q.T)


def bitmap_overlap(n_top: int) -> Scorer:
    """Bits that two words of top places share."""
    return Scorer(lambda x: words_of(top_doc(x, n_top)), lambda x: words_of(top_query(x, n_top)), lambda d, q: bits_met(d, q, np.bitwise_and), width=1)


def sign_hamming() -> Scorer:
    """Coordinates of different sign."""
    s = lambda x: words_of(x > 0)
    return Scorer(s, s, lambda d, q: bits_met(d, q, np.bitwise_xor), largest=False, width=1)


def code_l1(bits: int) -> Scorer:
    c = lambda x: codes(x, bits).astype(np.int32)
    return Scorer(c, c, lambda d, q: np.stack([np.abs(d - r).sum(1) for r in q], 1).astype(np.float64), largest=False)


def footrule() -> Scorer:
    return Scorer(ranks, ranks, lambda d, q: np.stack([np.abs(d - r).sum(1) for r in q], 1).astype(np.float64), largest=False)


def bilinear(bits: int, weights: list[list[float]]) -> Scorer:
    """Sum over bucket pairs of weight times shared coordinates; weights of 0 are left out. A bucket is a word mask."""
    w, nb = np.array(weights, np.float64), 1 << bits
    masks = lambda x: np.stack([words_of(c == b) for b in range(nb)], 1) if len(c := codes(x, bits)) else np.empty((0, nb, 1), "<u8")
    return Scorer(masks, masks, lambda d, q: weighted_masks(d, q, w))


def weighted_masks(d: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights times the bits that bucket a of a query and bucket b of a document share, summed."""
    out = np.zeros((len(d), len(q)))
    for a, b in zip(*np.nonzero(w), strict=True):
        out += w[a, b] * bits_met(np.ascontiguousarray(d[:, b]), np.ascontiguousarray(q[:, a]), np.bitwise_and)
    return out


def pair_tables(x: np.ndarray):
    """A query's 16 values for each pair of neighbouring two-bit codes, on one scale of 0 to 255, with what 0 and 1 stand for."""
    q = unit(x)
    c = np.array([bucket_centre(b, 2) for b in range(4)])
    table = (q[:, 0::2, None, None] * c[:, None] + q[:, 1::2, None, None] * c[None, :]).reshape(len(q), -1, 16)
    low, high = table.min((1, 2)), table.max((1, 2))
    scale = np.where(high > low, 255 / np.where(high > low, high - low, 1), 1.0)
    lut = np.clip(np.floor((table - low[:, None, None]) * scale[:, None, None] + 0.5), 0, 255)
    return lut, low * table.shape[1], scale


def paired(nibbles: np.ndarray) -> np.ndarray:
    """Two values of a pair to a byte."""
    if nibbles.shape[1] % 2:
        nibbles = np.pad(nibbles, ((0, 0), (0, 1)))
    return (nibbles[:, 0::2] << 4 | nibbles[:, 1::2]).astype(np.uint8)


def pair_scan(dim: int) -> Scorer:
    """Two-bit codes by neighbouring pairs, scored by looking up two pairs at once."""
    norm = asymmetric_norm(dim, 2)

    def docs(x):
        b = codes(x, 2)
        return paired(b[:, 0::2] * 4 + b[:, 1::2])

    return Scorer(docs, pair_tables, lambda d, q: (q[1] + looked_up(d, q[0]) / q[2]) / norm, width=1)


def tau_on_query_top(n_top: int) -> Scorer:
    """Share of coordinate pairs, among the query's n_top largest, that a document orders the other way."""

    def score(d, q):
        out = []
        for top in q:
            r = d[:, top]  # the query's order: descending
            out.append(sum((r[:, i, None] < r[:, i + 1 :]).sum(1) for i in range(len(top) - 1)) / math.comb(len(top), 2))
        return np.stack(out, 1)

    return Scorer(ranks, lambda x: np.argsort(-ranks(x), axis=1)[:, :n_top], score, largest=False, small=lambda x: ranks(x).astype(np.uint32), width=4)
