"""Index descriptors: parameters, their domains, and the numbers that follow from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

MAX_RANK_DIM = 65_535
MAX_SIGN_DIM = 1 << 24
MAX_VECTORS = 64 << 20
MAX_PAYLOAD_BYTES = 128 << 30


class ParameterError(ValueError):
    """A parameter outside its domain."""


class CapabilityError(ParameterError):
    """An operation that an index of these parameters doesn't support."""


def _need(held: bool, message: str) -> None:
    if not held:
        raise ParameterError(message)


def rank_norm(dim: int) -> float:
    """Length of a centred rank vector."""
    return math.sqrt(dim * (dim * dim - 1) / 12)


def bucket_centre(bucket: int, bits: int) -> float:
    _need(1 <= bits <= 8 and 0 <= bucket < 1 << bits, "bucket out of range")
    return bucket - ((1 << bits) - 1) / 2


def bucket_norm(dim: int, bits: int) -> float:
    """Length of a centred bucket vector with equally filled buckets."""
    return math.sqrt(dim * ((1 << bits) ** 2 - 1) / 12)


def empirical_norm(dim: int, bits: int) -> float:
    """The same for any dim: summed over the buckets that the ranks fall into."""
    _need(1 <= bits <= 8 and dim >= 1, "bits must be 1 to 8, dim positive")
    return math.sqrt(sum(bucket_centre((r << bits) // dim, bits) ** 2 for r in range(dim)))


def asymmetric_norm(dim: int, bits: int) -> float:
    return empirical_norm(dim, bits) if bits == 8 and dim % 256 else bucket_norm(dim, bits)


@dataclass(frozen=True)
class RankSpec:
    dim: int

    def __post_init__(self):
        _need(2 <= self.dim <= MAX_RANK_DIM, "dim must be from 2 to 65535")

    @property
    def bytes_per_vec(self) -> int:
        return 2 * self.dim


@dataclass(frozen=True)
class BucketSpec:
    """Bucketed ranks of 1, 2, 4 or 8 bits. asymmetric_only: allows any dim for 8 bits, without symmetric scores."""

    dim: int
    bits: int
    asymmetric_only: bool = False

    def __post_init__(self):
        _need(2 <= self.dim <= MAX_RANK_DIM, "dim must be from 2 to 65535")
        _need(self.bits in (1, 2, 4, 8), "bits must be 1, 2, 4 or 8")
        _need(self.dim % (8 // self.bits) == 0, "a vector must fill whole bytes")
        if self.bits < 8 or not self.asymmetric_only:
            _need(self.dim % (1 << self.bits) == 0, "dim must be divisible by the number of buckets")

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    @property
    def bytes_per_vec(self) -> int:
        return self.dim * self.bits // 8

    @property
    def symmetric(self) -> bool:
        return self.dim % self.buckets == 0

    def need_symmetric(self) -> None:
        if not self.symmetric:
            raise CapabilityError("this index scores asymmetrically only")


@dataclass(frozen=True)
class BitmapSpec:
    dim: int
    n_top: int

    def __post_init__(self):
        _need(self.dim % 64 == 0 and 64 <= self.dim <= MAX_RANK_DIM, "dim must be divisible by 64 and at most 65535")
        _need(0 < self.n_top < self.dim, "n_top must be from 1 to dim - 1")

    @property
    def bytes_per_vec(self) -> int:
        return self.dim // 8


@dataclass(frozen=True)
class SignSpec:
    dim: int

    def __post_init__(self):
        _need(self.dim % 64 == 0 and 64 <= self.dim <= MAX_SIGN_DIM, "dim must be divisible by 64, from 64 to 2**24")

    @property
    def bytes_per_vec(self) -> int:
        return self.dim // 8


@dataclass(frozen=True)
class PairScanSpec:
    """Two-bit codes scored by pairs through an 8-bit table."""

    dim: int

    def __post_init__(self):
        _need(self.dim % 4 == 0 and 2 <= self.dim <= MAX_RANK_DIM, "dim must be divisible by 4 and at most 65535")

    @property
    def bytes_per_vec(self) -> int:
        return self.dim // 2


@dataclass(frozen=True)
class MultiBucketSpec:
    dim: int
    bits: int

    def __post_init__(self):
        _need(self.bits in (1, 2, 4), "bits must be 1, 2 or 4")
        _need(self.dim % 64 == 0 and self.dim % (1 << self.bits) == 0 and 0 < self.dim <= MAX_RANK_DIM, "dim must be divisible by 64 and by the number of buckets")


@dataclass(frozen=True)
class CompositionSpec:
    dim: int
    buckets: int

    def __post_init__(self):
        _need(self.dim > 0 and 2 <= self.buckets <= 256 and self.dim % self.buckets == 0, "dim must be positive and divisible by 2 to 256 buckets")

    @property
    def expected_per_bucket(self) -> int:
        return self.dim // self.buckets


@dataclass(frozen=True)
class CandidatePolicy:
    """How many candidates the first of two stages hands on."""

    min_candidates: int = 256
    k_multiplier: int = 32
    max_candidates: int | None = None

    def candidate_count(self, k: int, n: int) -> int:
        if k == 0 or n == 0:
            return 0
        m = max(self.min_candidates, k * self.k_multiplier)
        return min(m if self.max_candidates is None else min(m, self.max_candidates), n)

    def candidates(self, k: int, n):
        """candidate_count() for a column of sizes."""
        from pyspark.sql import functions as F

        return F.least(F.lit(self.candidate_count(k, MAX_VECTORS)).cast("long"), n.cast("long"))
