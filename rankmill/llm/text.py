"""Vectorised word kernels: whole Arrow batches of text become arrays of word hashes.

A word is a run of bytes outside a separator set. All separators are ASCII, so byte scans are right for UTF-8. Word
hashes are 64-bit polynomial hashes over a random byte table, finished with a mixer; equal words have equal hashes, and
different ones collide with chance 2**-64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte that is neither a digit nor a letter after lower-casing; capitals are lower-cased first.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """Splits and hashes the words of many texts at once.

    separators: the bytes between words. lower: A-Z count as a-z.
    """

    def __init__(self, separators: bytes = SPACE, lower: bool = False):
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.sep = np.zeros(256, bool)
        self.sep[[b for b in range(256) if int(fold[b]) in separators]] = True
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))[fold]
        self.powers(1 << 16)

    def powers(self, n: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("pow", BASE), ("inv", inverse)):
            x = np.full(n, base, U64)
            x[0] = 1
            setattr(self, name, np.cumprod(x))

    def split(self, buf: np.ndarray, bounds: np.ndarray):
        """(start, end, document, hash) of each word; bounds: where each text starts, and the end."""
        n = len(buf)
        if n == 0:
            e = np.empty(0, np.int64)
            return e, e, e, np.empty(0, U64)
        if n >= len(self.pow):
            self.powers(n + 1)
        sep = self.sep[buf]
        first = np.ones(n, bool)
        first[1:] = sep[:-1]
        inner = bounds[(bounds > 0) & (bounds < n)]
        first[inner] = True
        first &= ~sep
        last = np.ones(n, bool)
        last[:-1] = sep[1:]
        last[inner - 1] = True
        last &= ~sep
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum(self.table[buf] * self.pow[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inv[start]
        h = mix(h + (end - start).astype(U64) * U64(0xA0761D6478BD642F))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))
        return start, end, doc, h

    def of(self, text: str) -> list[int]:
        """The word hashes of one text, as integers."""
        buf = np.frombuffer(text.encode(), np.uint8)
        return [int(x) for x in self.split(buf, np.array([0, len(buf)]))[3]]


def ngram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes, whatever document they are of; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    if n <= 4:
        out = np.zeros(m, U64)
        for i in range(n):
            out = (out ^ h[i : i + m]) * U64(0xE7037ED1A0B428DB)
            out ^= out >> U64(32)
        return mix(out)
    return Rolling(h).grams(n)


def frugal() -> None:
    """Makes this worker process hand freed memory back: it lives on between tasks, beside an executor's heap."""
    import ctypes

    import pyarrow as pa

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger arrays are mapped, and unmapped when freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc
    pa.set_memory_pool(pa.system_memory_pool())


def texts(batch, column: str):
    """(offsets, bytes) of a string column of an Arrow batch; nulls are empty texts."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(offsets: np.ndarray, data: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, bounds) of runs of whole texts of up to limit bytes; a longer text is a run alone."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(rows, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Rolling:
    """Hashes of runs of any number of consecutive word hashes; equal to ngram()'s for more than four words."""

    def __init__(self, h: np.ndarray):
        n, base = len(h), 0x8EBC6AF09C88C6E3 | 1
        power = np.full(n + 1, base, U64)
        power[0] = 1
        self.back = np.full(n + 1, pow(base, -1, 1 << 64), U64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(h * np.cumprod(power)[:n], out=self.total[1:])

    def grams(self, n: int) -> np.ndarray:
        m = len(self.total) - n
        return mix((self.total[n:] - self.total[:m]) * self.back[:m]) if m > 0 else np.empty(0, U64)
