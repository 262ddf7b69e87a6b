"""Operator 5: benchmark decontamination by pigeonhole edit matching.

A test item of w words may be found with up to e = w * rate word edits. Cut into e + 1 pieces, one piece at least stays
whole in any such place, so exact hits of pieces (rolling hashes, a bitmap first) are all the candidates. Each is verified
with Myers' bit-parallel edit distance, words being its letters, on the stretch of text around the hit; hits of one item
that are close together are one stretch.

Documents never meet each other. Items are a stated query set: they are taken in blocks of bounded size against all rows,
each a broadcast of its own that isn't kept in the driver's memory.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import mapped, small, written
from rankmill.llm.text import NOT_ALNUM, Rolling, Words, chunks, texts

EDIT_RATE = 0.15
#: Items, and bytes of them, looked for in one pass over the documents.
BLOCK, BLOCK_BYTES = 50_000, 16 << 20
SCHEMA = "doc_id long, item_id long, distance long, start_word long, n_item_words long"


def pieces(n_words: int, rate: float = EDIT_RATE) -> list[tuple[int, int]]:
    """(start, length) of the error budget plus one pieces of an item, as even as they can be."""
    count = int(n_words * rate) + 1
    cut = [n_words * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(distance, end) of the best place of a pattern of m letters anywhere in text; masks: bits of each letter."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | ~(x | up) & full, up & x
        if score < best:
            best, end = score, i + 1
    return best, end


def _stretches(starts: list[int], m: int, budget: int, first: int, last: int):
    """(from, to): the stretches of text that hold all places of an item that may begin near starts; they don't overlap."""
    a = b = None
    for s in starts:
        low, high = max(first, s - budget), min(last, s + m + budget)
        if a is not None and low <= b:
            b = max(b, high)
            continue
        if a is not None:
            yield a, b
        a, b = low, high
    if a is not None:
        yield a, b


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        words = Words(NOT_ALNUM, lower=True)
        self.items, pieces_of = [], {}
        for item_id, text in items:
            h = words.of(text or "")
            if not h:
                continue
            masks: dict[int, int] = {}
            for i, x in enumerate(h):
                masks[x] = masks.get(x, 0) | 1 << i
            for start, length in pieces(len(h), rate):
                g = int(Rolling(np.array(h[start : start + length], np.uint64)).grams(length)[0])
                pieces_of.setdefault(length, []).append((g, len(self.items), start))
            self.items.append((item_id, len(h), int(len(h) * rate), masks))
        self.pieces = {}
        for length, found in sorted(pieces_of.items()):
            found.sort()
            keys = np.array([x[0] for x in found], np.uint64)
            bits = np.zeros(1 << 18, bool)
            bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.pieces[length] = (keys, [x[1:] for x in found], bits)

    def found(self, h: np.ndarray, wdoc: np.ndarray, begin: np.ndarray):
        """(document, item, distance, start) of every item within its budget in a text, its best place."""
        rolling, hits = Rolling(h), {}
        for length, (keys, places, bits) in self.pieces.items():
            g = rolling.grams(length)
            at = np.flatnonzero(bits[(g & np.uint64(len(bits) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], "right")
            real = (hi > lo) & (wdoc[at] == wdoc[np.minimum(at + length - 1, len(wdoc) - 1)])
            for p, a, b in zip(at[real].tolist(), lo[real].tolist(), hi[real].tolist(), strict=True):
                for item, start in places[a:b]:
                    hits.setdefault((int(wdoc[p]), item), set()).add(p - start)
        for (doc, item), starts in sorted(hits.items()):
            item_id, m, budget, masks = self.items[item]
            first, last, best = int(begin[doc]), int(begin[doc + 1]), None
            for a, b in _stretches(sorted(starts), m, budget, first, last):
                distance, end = myers(masks, m, h[a:b].tolist())
                place = max(0, a + end - m - first)
                if best is None or (distance, place) < best:
                    best = distance, place
                if not distance:
                    break
            if best[0] <= budget:
                yield doc, item_id, best[0], best[1], m


def _search(block, rate: float):
    """block: a broadcast list of (item_id, text)."""

    def run(batches):
        import pyarrow as pa

        items, words = Items(block.value, rate), Words(NOT_ALNUM, lower=True)
        for batch in batches:
            offsets, data = texts(batch, "text")
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for lo, hi, buf, bounds in chunks(offsets, data):
                _, _, wdoc, h = words.split(buf, bounds)
                if not len(h):
                    continue
                begin = np.searchsorted(wdoc, np.arange(hi - lo + 1))
                rows = [(ids[lo + d], *rest) for d, *rest in items.found(h, wdoc, begin)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "distance", "start_word", "n_item_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, distance, start_word, n_item_words): items found in documents within their edit budget.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are runs of letters, digits and non-ASCII
    characters, A-Z lower-cased. A row per document and item, with the fewest edits and where the place begins at the
    earliest (by its end and the item's length). Items without words match nothing, and those of few words (budget 0)
    only as they stand. Null and empty texts hold nothing, very long ones are searched whole; a repeated row of a document
    repeats its result, and repeated item ids each have theirs. Empty tables give an empty result.
    """
    docs, found = docs.select("doc_id", "text"), None
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    block: list[tuple[int, str]] = []
    size = 0

    def search():
        nonlocal found, block, size
        sent = spark.sparkContext.broadcast(block)  # BLOCK_BYTES and one item at most; Spark keeps it in a file
        part = mapped(docs, _search(sent, rate), SCHEMA)
        found, block, size = part if found is None else found.union(part), [], 0

    for item_id, text in items.toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if len(block) >= BLOCK or size >= BLOCK_BYTES:
            search()
    if block:
        search()
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of docs without a leak; rows without doc_id stay."""
    bad = written(leaks(docs.where("doc_id is not null"), items, rate).select("doc_id").distinct(), "leaks")
    return docs.join(small(bad), "doc_id", "left_anti").select(*docs.columns)
