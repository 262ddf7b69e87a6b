"""Work on blocks of packed codes: bit counts on words, table look-ups by byte, and the best rows of many queries at once."""

from __future__ import annotations

import numpy as np

#: Numbers that a tile of rows by queries has: they stay in a core's cache from one word to the next.
TILE = 65_536


def words_of(flags: np.ndarray) -> np.ndarray:
    """A row of flags as 64-bit words, the first flag lowest; the last word is filled up with zeros."""
    b = np.packbits(flags.astype(bool), axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 8)))).view("<u8")


def bits_met(d: np.ndarray, q: np.ndarray, op) -> np.ndarray:
    """How many bits of op(row of d, row of q) are set, rows of d by rows of q; op: np.bitwise_xor or np.bitwise_and."""
    d, q = d.view("<u8"), q.view("<u8")
    words = d.shape[1]
    out = np.zeros((len(d), len(q)), np.int16 if words < 512 else np.int32)
    tile = max(1, TILE // max(1, len(q)))
    met, ones = np.empty((tile, len(q)), np.uint64), np.empty((tile, len(q)), np.uint8)
    for lo in range(0, len(d), tile):
        own = out[lo : lo + tile]
        n = len(own)
        for w in range(words):
            op(d[lo : lo + n, w, None], q[:, w], out=met[:n])
            own += np.bitwise_count(met[:n], out=ones[:n])
    return out


def looked_up(nibbles: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Sums of table entries, rows by queries: entry nibbles[row, p] of tables[query, p], summed over p.

    nibbles: values below 16, two to a byte (the first one high), with a 0 behind an odd number of them. tables: whole
    numbers up to 255, queries by places by 16. The two tables of a byte become one of 256 entries, all queries of an
    entry side by side, so that a column of the block draws whole rows of it.
    """
    asked, places, _ = tables.shape
    kind = np.uint16 if places <= 257 else np.uint32
    if places % 2:
        tables = np.concatenate([tables, np.zeros((asked, 1, 16))], axis=1)
    tables = tables.astype(kind)
    out = np.zeros((len(nibbles), asked), kind)
    drawn = np.empty_like(out)
    for c in range(nibbles.shape[1]):
        both = (tables[:, 2 * c, :, None] + tables[:, 2 * c + 1, None, :]).reshape(asked, 256)
        out += np.take(np.ascontiguousarray(both.T), nibbles[:, c], axis=0, out=drawn)
    return out


def byte_values(bits: int, values) -> np.ndarray:
    """A row for each byte: values[code] of the codes in it, the first one high."""
    per = 8 // bits
    codes = (np.arange(256)[:, None] >> bits * (per - 1 - np.arange(per))) & ((1 << bits) - 1)
    return np.asarray(values)[codes]


def unpacked(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of the numbers that table (256 by numbers a byte) has for each byte."""
    return np.take(table, data, axis=0).reshape(len(data), -1)


def dot_by_byte(data: np.ndarray, q: np.ndarray, table: np.ndarray) -> np.ndarray:
    """unpacked(data, table) @ q for one q, without unpacking: q's part in each byte's 256 values is looked up and summed."""
    parts = q.reshape(-1, table.shape[1]) @ table.T
    return np.take(parts.reshape(-1), data + np.arange(len(parts)) * 256).sum(1)


#: Counters of whole-number scores that Best holds at most for all its queries.
COUNTERS = 1 << 22


class Best:
    """The best rows of each of n queries, by score and then row id, with what each of them carries.

    m: how many a query keeps, one number or one for each. Rows that could be among them are gathered, and sorted out
    when there are twice as many as can stay; until then each query's worst score that can stay keeps others away. Of
    whole numbers from 0 on that limit is always known, from counts of each score. What is held never exceeds a few
    times n * m rows.
    """

    def __init__(self, n: int, m, largest: bool):
        self.n, self.m, self.largest = n, np.broadcast_to(np.asarray(m), (n,)), largest
        self.most = int(self.m.max()) if n else 0
        self.room = max(2 * int(self.m.sum()), 1 << 15)
        self.limit, self.counts = None, None
        self.parts: list[tuple] = []
        self.held = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, carry=None) -> None:
        """scores: rows by queries. carry: from places of rows to what they carry, a row each."""
        if not self.most or not scores.size:
            return
        key = -scores if self.largest else scores
        if self.limit is None:
            self.limit = np.full(self.n, np.inf if key.dtype.kind == "f" else np.iinfo(key.dtype).max, key.dtype)
            whole = key.dtype.kind == "i" and int(scores.min()) >= 0 and self.n * (int(scores.max()) + 1) <= COUNTERS
            self.counts = np.zeros((self.n, 1), np.int64) if whole else None
        near = key <= self.limit
        if self.counts is not None and int(scores.min()) < 0:
            self.counts = None
        many = np.count_nonzero(near) > self.room
        if many and self.counts is not None:  # counting all of them is cheaper than picking
            self._count(np.tile(np.arange(self.n), len(ids)), scores.reshape(-1))
            near = key <= self.limit
        elif many and self.most < len(ids):  # a block's own m-th best is a limit as well
            cut = np.partition(key, self.most - 1, axis=0)[self.most - 1]
            near = key <= np.minimum(cut, self.limit)
        at = np.flatnonzero(near)
        r = at // self.n
        j = at - r * self.n
        found = key.reshape(-1)[at]
        if self.counts is not None and not many and self._count(j, -found if self.largest else found):
            stay = found <= self.limit[j]
            r, j, found = r[stay], j[stay], found[stay]
        if len(r):
            self.add(j, found, ids[r], None if carry is None else carry(r))

    def _count(self, j, score) -> bool:
        """Counts scores, and sets each query's limit to the score of its m-th best row."""
        if not len(j):
            return False
        width = max(self.counts.shape[1], int(score.max()) + 1)
        if self.n * width > COUNTERS:
            self.counts = None
            return False
        if width > self.counts.shape[1]:
            self.counts = np.pad(self.counts, ((0, 0), (0, width - self.counts.shape[1])))
        self.counts += np.bincount(j * width + score, minlength=self.n * width).reshape(self.n, width)
        upto = np.cumsum(self.counts[:, ::-1] if self.largest else self.counts, axis=1)
        full = np.flatnonzero((upto[:, -1] >= self.m) & (self.m > 0))
        at = (upto[full] >= self.m[full, None]).argmax(1)
        self.limit[full] = -(width - 1 - at) if self.largest else at
        return True

    def add(self, j, key, ids, carry=None) -> None:
        self.parts.append((j, key, ids, carry))
        self.held += len(j)
        if self.held > self.room:
            self._thin_out()
            if self.held > self.room:
                self._sort_out()

    def _joined(self):
        j, key, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        return j, key, ids, None if self.parts[0][3] is None else np.concatenate([p[3] for p in self.parts])

    def _thin_out(self) -> None:
        """Drops rows past the limits known by now, without sorting."""
        if self.counts is None:
            return
        j, key, ids, carry = self._joined()
        stay = key <= self.limit[j]
        self.parts = [(j[stay], key[stay], ids[stay], None if carry is None else carry[stay])]
        self.held = len(self.parts[0][0])

    def _sort_out(self) -> None:
        if not self.parts:
            return
        self._thin_out()
        j, key, ids, carry = self._joined()
        if key.dtype.kind == "i" and len(ids) and (np.diff(ids) >= 0).all():  # by id already: a stable sort by the rest will do
            low = int(key.min())
            order = np.argsort(j * (int(key.max()) - low + 1) + (key.astype(np.int64) - low), kind="stable")
        else:
            order = np.lexsort((ids, key, j))
        j = j[order]
        start = np.searchsorted(j, np.arange(self.n + 1))
        at = np.arange(len(j)) - start[j]
        stay = order[at < self.m[j]]
        self.parts = [(j[at < self.m[j]], key[stay], ids[stay], None if carry is None else carry[stay])]
        self.held = len(stay)
        if self.limit is not None and self.counts is None:
            full = np.flatnonzero((np.diff(start) >= self.m) & (self.m > 0))
            self.limit[full] = key[order[start[full] + self.m[full] - 1]]

    def rows(self):
        """(queries, scores, row ids, what they carry), by query and from the best row on."""
        self._sort_out()
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None
        j, key, ids, carry = self.parts[0]
        key = key.astype(np.float64)
        return j, -key if self.largest else key, ids, carry
