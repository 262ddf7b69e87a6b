"""Operator 3: substring dedup by fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks of half a window; every rolling run of as many words
of every document probes them. A window of equal words in two documents holds a whole reference block of one, which the
other meets with a probe. Per block value only two numbers are kept, the smallest document that has it as a block and the
largest that meets it, so a passage in a third of all documents costs no pairs. Each hit is then extended: the windows
around it are compared whole, across documents, and runs of windows that repeat merge into maximal repeated spans.

Shuffles carry packed arrays: four bytes of hash and one or two of place for each probe (a false hit costs a comparison of
whole windows, nothing else), and 64 bits of hash for each window around a hit.

What is equal within a task is decided there: of a window that many of its texts hold, only the smallest document goes on,
of a probe the smallest block, the largest document and at most MOST others. A passage in a third of all documents so
sends a few rows from each task's share, not one from each document. A probe too frequent to be sent counts as a hit.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import buckets, mapped, written
from rankmill.llm.text import SPACE, Words, chunks, mix, ngram, texts

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Values that a task gathers before it hands them on.
FLUSH = 2_500_000
#: Undecided probes of one value that a task sends on; where it has more, all of them are hits, to be compared whole.
MOST = 32
#: Buckets at least, so that small and large inputs pack alike.
LEAST_BUCKETS = 64
#: Bytes of packed hits up to which they are broadcast.
BROADCAST_BYTES = 24 << 20


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers as their first value and differences, as narrow as these allow.

    Rising ones may take a byte each: 255 then stands for a step of 255 that ends at no number.
    """
    d = np.diff(x)
    kind = next(k for k in (np.uint8, np.int16, np.uint16, np.int32, np.int64) if not len(d) or np.iinfo(k).min <= d.min() and d.max() <= np.iinfo(k).max)
    head = np.int64(x[0]).tobytes()
    if len(d) and d.min() >= 0 and kind is not np.uint8:
        steps = d // 255 + 1
        ends = np.cumsum(steps)
        if ends[-1] < len(d) * np.dtype(kind).itemsize:
            out = np.full(ends[-1], 255, np.uint8)
            out[ends - 1] = d % 255
            return b"s" + head + out.tobytes()
    return np.dtype(kind).char.encode() + head + d.astype(kind).tobytes()


def _of_ints(x: bytes) -> np.ndarray:
    first = np.frombuffer(x, np.int64, 1, 1)
    if x[:1] == b"s":
        d = np.frombuffer(x, np.uint8, offset=9)
        return np.concatenate([first, first + np.cumsum(d, dtype=np.int64)[d < 255]])
    return np.cumsum(np.concatenate([first, np.frombuffer(x, np.dtype(x[:1].decode()), offset=9)]).astype(np.int64))


class Gathered:
    """What a task gathers of runs of texts until it deals it out by hash.

    A row has the documents met in a bucket, at which of the gathered words each begins, and place and hash of each run
    of words; kind: the part of a hash that is sent. decided(doc, place, run) says of values in runs of equal hashes
    which are found as they stand and which must be sent; found places go along as rows without begins, dealt by document.
    """

    def __init__(self, count: int, kind, decided):
        self.count, self.kind, self.decided = count, kind, decided
        self.reset()

    def reset(self):
        self.held, self.words, self.size = [], 0, 0

    def add(self, ids, per, at, hashes):
        """ids and words of each text; at: where runs begin among these words; their hashes."""
        begin = self.words + np.cumsum(per) - per
        self.held.append((ids, begin, at + self.words, hashes))
        self.words += int(per.sum())
        self.size += len(at)

    def dealt(self):
        import pyarrow as pa

        ids, begin, at, h = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.reset()
        has = np.flatnonzero(np.append(begin[1:], np.iinfo(np.int64).max) > begin)
        ids, begin = ids[has], begin[has]

        order = np.argsort(h)
        twin = h[order[1:]] == h[order[:-1]]
        order = order[np.append(twin, False) | np.append(False, twin)]  # values that are there more than once
        if len(order):
            edge, run = _runs_of(h[order])
            own = np.searchsorted(begin, at[order], "right") - 1
            doc, place = ids[own], at[order] - begin[own]
            found, sent = self.decided(doc, place, edge, run)
            if found.any():
                part, docs, sizes, places = _found(doc[found], place[found], self.count).columns
                yield pa.RecordBatch.from_arrays([part, docs, pa.nulls(len(part), pa.binary()), places, sizes], names=["bucket", "docs", "begins", "places", "hashes"])
            keep = np.ones(len(h), bool)
            keep[order[~sent]] = False
            at, h = at[keep], h[keep]

        bucket = (h & np.uint64(self.count - 1)).astype(np.min_scalar_type(self.count - 1))
        order = np.argsort(bucket, kind="stable")
        at, cut = at[order], np.searchsorted(bucket[order], np.arange(self.count + 1))
        h = (h >> np.uint64(64 - 8 * np.dtype(self.kind).itemsize)).astype(self.kind)[order]
        rows = ([], [], [], [], [])
        for b in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            own = np.searchsorted(begin, at[lo:hi], "right") - 1
            own = own[np.flatnonzero(np.diff(own, prepend=-1))]
            for out, x in zip(rows, (b, _ints(ids[own]), _ints(begin[own]), _ints(at[lo:hi]), h[lo:hi].tobytes()), strict=True):
                out.append(x)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "docs", "begins", "places", "hashes"])


DEALT = "bucket int, docs binary, begins binary, places binary, hashes binary"
FOUND = "part int, docs binary, sizes binary, places binary"


def _taken(blobs, kind):
    """(document, place in it, hash) of all rows of a bucket."""
    out = []
    for docs, begins, places, hashes in blobs:
        begin, at = _of_ints(begins), _of_ints(places)
        own = np.searchsorted(begin, at, "right") - 1
        out.append((_of_ints(docs)[own], (at - begin[own]).astype(np.uint32), np.frombuffer(hashes, kind)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _grouped(doc, place):
    """(documents, sizes, places) of found places, each document once."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    return doc[edge], np.diff(np.append(edge, len(doc))), place.astype(np.uint32)


def _found(doc, place, count: int):
    """What a bucket has found, dealt by document."""
    import pyarrow as pa

    part = (mix(doc.view(np.uint64)) & np.uint64(count - 1)).astype(np.int64)
    rows = ([], [], [], [])
    order = np.argsort(part, kind="stable")
    doc, place, part = doc[order], place[order], part[order]
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(part))[: len(edge)], strict=True):
        d, n, p = _grouped(doc[a:b], place[a:b])
        for out, x in zip(rows, (int(part[a]), d.tobytes(), n.astype(np.uint32).tobytes(), p.tobytes()), strict=True):
            out.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["part", "docs", "sizes", "places"])


def _rows_by_key(batches):
    """The blobs of each key of a partition; a partition has few keys."""
    held: dict[int, list] = {}
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for b, *blobs in zip(*columns, strict=True):
            held.setdefault(b, []).append(blobs)
    while held:
        yield held.popitem()[1]


def _by_bucket(work, kind, count: int):
    def undecided(batches):
        """The batches, less the rows of found places: these are kept in passed."""
        for batch in batches:
            decided = batch.column(2).is_null()
            passed.append(batch.filter(decided).select([0, 1, 4, 3]).rename_columns(["part", "docs", "sizes", "places"]))
            yield batch.filter(pc.invert(decided))

    passed: list = []

    def run(batches):
        for blobs in _rows_by_key(undecided(batches)):
            yield _found(*work(*_taken(blobs, kind)), count)
        while passed:
            yield passed.pop()

    import pyarrow.compute as pc

    return run


def _merged(gap: int):
    """Rows (doc_id, places) of all that was found, one for each document: first and last of runs of places that are
    no more than gap apart."""

    def run(batches):
        import pyarrow as pa

        for blobs in _rows_by_key(batches):
            doc = np.repeat(np.concatenate([np.frombuffer(x[0], np.int64) for x in blobs]), np.concatenate([np.frombuffer(x[1], np.uint32) for x in blobs]).astype(np.int64))
            place = np.concatenate([np.frombuffer(x[2], np.uint32) for x in blobs]).astype(np.int64)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            first = np.ones(len(doc) + 1, bool)
            first[1:-1] = (doc[1:] != doc[:-1]) | (np.diff(place) > gap)
            runs = np.stack([place[first[:-1]], place[first[1:]]], 1).astype(np.uint32)
            own, size, _ = _grouped(doc[first[:-1]], runs[:, 0])
            end = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array([runs[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist(), strict=True)], pa.binary())], names=["doc_id", "places"]
            )

    return run


def _runs(places: bytes) -> np.ndarray:
    return np.frombuffer(places, np.uint32).astype(np.int64).reshape(-1, 2)


def _probes(block: int, count: int):
    """All rolling runs of block words; the places of reference blocks are those divisible by block."""

    def run(batches):
        words, gathered = Words(SPACE), Gathered(count, np.uint32, _hit_here(block))
        for batch in batches:
            offsets, data = texts(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for lo, hi, buf, bounds in chunks(offsets, data):
                _, _, wdoc, h = words.split(buf, bounds)
                g = ngram(h, block)
                if len(g):
                    at = np.flatnonzero(wdoc[block - 1 :] == wdoc[: len(g)])
                    gathered.add(ids[lo:hi], np.bincount(wdoc, minlength=hi - lo), at, g[at])
                if gathered.size >= FLUSH:
                    yield from gathered.dealt()
        if gathered.size:
            yield from gathered.dealt()

    return run


def _runs_of(h):
    """(first of each run of equal hashes, run of each)."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return edge, np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))


def _met(doc, anchor, edge, run):
    """(hits, smallest document of each run that has it as a block, largest document): probes that meet a block of a
    smaller document, and blocks that a larger one meets."""
    low = np.minimum.reduceat(np.where(anchor, doc, np.iinfo(np.int64).max), edge)
    high = np.maximum.reduceat(doc, edge)
    return (low[run] < doc) | (anchor & (high[run] > doc)), low, high


def _hit_here(block: int):
    def decided(doc, place, edge, run):
        anchor = place % block == 0
        hit, low, high = _met(doc, anchor, edge, run)
        many = np.add.reduceat(~hit, edge, dtype=np.int64) > MOST
        # Others need to know the smallest block and the largest document; one place of each will do.
        sent = ~hit & ~many[run]
        for stands in (anchor & (doc == low[run]), doc == high[run]):
            at = np.flatnonzero(stands)
            sent[at[np.flatnonzero(np.diff(run[at], prepend=-1))]] = True
        return hit | many[run], sent

    return decided


def _repeat_here(doc, place, edge, run):
    later = doc > np.minimum.reduceat(doc, edge)[run]
    return later, ~later


def _hits(block: int, count: int):
    """Of one bucket, the probes that meet a block of a smaller document and the blocks that a larger one meets."""

    def work(doc, place, h):
        order = np.argsort(h)
        doc, place = doc[order], place[order]
        hit = _met(doc, place % block == 0, *_runs_of(h[order]))[0]
        return doc[hit], place[hit]

    return _by_bucket(work, np.uint32, count)


def _repeats(count: int):
    """Of one bucket, the windows that start in a smaller document too."""

    def work(doc, place, h):
        order = np.argsort(h)
        doc, place = doc[order], place[order]
        edge, run = _runs_of(h[order])
        later = doc > np.minimum.reduceat(doc, edge)[run]
        return doc[later], place[later]

    return _by_bucket(work, np.uint64, count)


def _around(window: int, block: int, count: int):
    """The windows that hold a hit."""

    def run(batches):
        words, gathered = Words(SPACE), Gathered(count, np.uint64, _repeat_here)
        for batch in batches:
            offsets, data = texts(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            places = batch.column(batch.schema.get_field_index("places")).to_pylist()
            for lo, hi, buf, bounds in chunks(offsets, data):
                _, _, wdoc, h = words.split(buf, bounds)
                g = ngram(h, window)
                if not len(g):
                    continue
                begin = np.searchsorted(wdoc, np.arange(hi - lo + 1))
                near = np.zeros(len(h) + 1, np.int64)
                for i in range(lo, hi):
                    at = _runs(places[i]) + begin[i - lo]
                    np.add.at(near, np.maximum(at[:, 0] - (window - block), begin[i - lo]), 1)
                    np.add.at(near, at[:, 1] + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[: len(g)] > 0) & (wdoc[window - 1 :] == wdoc[: len(g)]))
                if len(at):
                    gathered.add(ids[lo:hi], np.bincount(wdoc, minlength=hi - lo), at, g[at])
                if gathered.size >= FLUSH:
                    yield from gathered.dealt()
        if gathered.size:
            yield from gathered.dealt()

    return run


def _spans(places: bytes | None, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by windows at the given places."""
    out: list[tuple[int, int]] = []
    for a, b in _runs(places).tolist() if places else []:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b + window
        else:
            out.append((a, b + window))
    return out


def _cut(window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            out = ([], [], [], [])
            for text, places in zip(get("text").to_pylist(), get("places").to_pylist(), strict=True):
                words = _WORD.findall((text or "").encode())
                spans, total = _spans(places, window), len(words)
                for a, b in reversed(spans):
                    del words[a:b]
                for o, x in zip(out, (total, total - len(words), b" ".join(words).decode(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    o.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [get("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span)],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def _digest(window: int):
    """As _cut, with the SHA-256 of what is kept in place of it; texts don't go back to the JVM."""

    def run(batches):
        import pyarrow as pa

        for batch in _cut(window)(batches):
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _count(docs: DataFrame) -> int:
    return buckets(docs, LEAST_BUCKETS)


def _with_places(docs: DataFrame, found: DataFrame, how: str, gap: int) -> DataFrame:
    """docs with the places found in each; these are broadcast if their bytes are few."""
    count = _count(docs)
    found = written(mapped(found.repartitionById(count, F.col("part")), _merged(gap), "doc_id long, places binary"), "places")
    size = found.agg(F.sum(F.lit(48) + F.length("places"))).first()[0] or 0
    return docs.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "doc_id", how)


def removed_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (doc_id, text) with places: the starts, packed, of windows that start in a smaller doc_id too; else null."""
    count, block = _count(docs), (window + 1) // 2
    dealt = mapped(docs, _probes(block, count), DEALT).repartitionById(count, F.col("bucket"))
    hits = mapped(dealt, _hits(block, count), FOUND)
    dealt = mapped(_with_places(docs, hits, "inner", window - block + 1), _around(window, block, count), DEALT).repartitionById(count, F.col("bucket"))
    return _with_places(docs, mapped(dealt, _repeats(count), FOUND), "left", 1)


def substring_dedup(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (kept words joined by a space), spans (start, end of removed words).

    docs: doc_id, text; other columns are ignored. A word goes if a window of so many consecutive words covers it whose
    sequence also starts in a document with a smaller doc_id, as the input stands. Repeats inside one document and rows
    with the same doc_id don't count against each other. Null texts have no words; rows without doc_id are left out.
    Texts are taken whole, however long; repeated rows of a doc_id each have its result, by the windows of all of them.
    Of equal windows the one in the smallest doc_id stays, at all its places. An empty table gives an empty result.
    digest: kept_sha256 (lower-case hex of the UTF-8 of kept) in place of kept and spans.
    """
    docs = removed_windows(docs.where("doc_id is not null").select("doc_id", "text"), window)
    if digest:
        return mapped(docs, _digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return mapped(docs, _cut(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")
