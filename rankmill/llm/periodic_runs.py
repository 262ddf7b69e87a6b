"""Operator 12: periodic runs by Crochemore's partition refinement.

Positions of a text are classed by the k words that start there, for k = 1, 2, ...: the classes of k + 1 split those of k
by the class of the next position. Of the parts of a split class all but the largest are enough to split by (the smaller
halves), so a position is moved a logarithm of times. Each class is a linked list in text order. Two neighbours of a class
of k at distance k are a square of period k whose period is the smallest, since one with a smaller period would have a
member between them. Squares at consecutive places are one run.

A run of at least max(least, times * q) words of period q repeats each of its words' surroundings: every one of them lies
in some sequence of G = least * (times - 1) / times words that occurs twice in the document, q apart. Words outside such
sequences become classes of one before the refinement begins, and what is between them is refined by itself. That takes
away no run and makes none.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import fresh, mapped
from rankmill.llm.text import SPACE, U64, Words, chunks, mix, ngram, texts

RUN = "struct<start: long, length: long, period: long>"


def runs(letters, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence: length >= max(least, times * period)."""
    n = len(letters)
    most = n // times
    if n < least or most < 1:
        return []
    first: dict = {}
    own = [first.setdefault(x, len(first)) for x in letters]  # the class of each position
    head, tail, size = [-1] * len(first), [-1] * len(first), [0] * len(first)
    after, before = [-1] * n, [-1] * n
    gaps: list[list[int]] = [[] for _ in range(most + 1)]  # places whose neighbour was once so far away
    for i, c in enumerate(own):
        t = tail[c]
        if t < 0:
            head[c] = i
        else:
            after[t], before[i] = i, t
            if i - t <= most:
                gaps[i - t].append(t)
        tail[c] = i
        size[c] += 1

    def members(c):
        out, i = [], head[c]
        while i >= 0:
            out.append(i)
            i = after[i]
        return out

    big = max(range(len(size)), key=size.__getitem__)
    halves = [[n], *(members(c) for c in range(len(size)) if c != big)]  # n: the end, unlike any word
    found = []
    for k in range(1, most + 1):
        near, gaps[k] = gaps[k], []
        need = max(least - 2 * k, (times - 2) * k) + 1  # squares in a row
        if len(near) >= need:
            begin = last = None
            for i in sorted({i for i in near if after[i] == i + k}):
                if last is None or i != last + 1:
                    if last is not None and last - begin + 1 >= need:
                        found.append((begin, last - begin + 2 * k, k))
                    begin = i
                last = i
            if last is not None and last - begin + 1 >= need:
                found.append((begin, last - begin + 2 * k, k))
        if not halves:
            break
        split: dict[int, list[int]] = {}
        for half in halves:
            made: dict[int, int] = {}
            for j in half:
                i = j - 1
                if i < 0:
                    continue
                p = own[i]
                c = made.get(p)
                if c is None:
                    if size[p] == 1:
                        continue
                    c = made[p] = len(size)
                    head.append(i)
                    tail.append(-1)
                    size.append(0)
                    split.setdefault(p, []).append(c)
                a, b = before[i], after[i]
                if a >= 0:
                    after[a] = b
                    if b >= 0 and k < b - a <= most:
                        gaps[b - a].append(a)
                else:
                    head[p] = b
                if b >= 0:
                    before[b] = a
                t = tail[c]
                if t >= 0:
                    after[t] = i
                    if k < i - t <= most:
                        gaps[i - t].append(t)
                before[i], after[i], tail[c], own[i] = t, -1, i, c
                size[p] -= 1
                size[c] += 1
        halves = []
        for p, parts in split.items():
            if size[p]:
                parts.append(p)
            if len(parts) > 1:
                big = max(parts, key=size.__getitem__)
                halves += [members(c) for c in parts if c != big]
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def stretches(h: np.ndarray, doc: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words, by their hashes, that may hold runs: see the top."""
    gram = max(1, -(-least * (times - 1) // times))
    grams = ngram(h, gram)
    at = np.flatnonzero(doc[: len(grams)] == doc[gram - 1 :])
    key = mix(grams[at] + doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    s = key[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    at = at[order[twice]]
    if not len(at):
        return []
    depth = np.zeros(len(h) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + gram, -1)
    covered = np.cumsum(depth)[:-1] > 0
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(edge)
    lo, hi = edge[:-1], edge[1:]
    pick = covered[lo] & (hi - lo >= least)
    return list(zip(lo[pick].tolist(), hi[pick].tolist(), strict=True))


def kept_words(words: list, found: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    out, at = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in found):
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs (text and more) with text collapsed, and runs (by start, then period) and top, the run of most repetitions.

    Words are runs of anything but ASCII white space. A run is a stretch with smallest period q and at least
    max(least, times * q) words (least 1 or more, times 2 or more) that no neighbouring word extends. Words that a run
    holds after its first q words go; the others come back joined by one space. top has the greatest length / period, of
    equals the smallest start, then the smallest period; it is null without runs. A null text has no words and becomes an
    empty one, as does a text of white space. Texts are taken whole, however long; one needs a few hundred bytes for each
    of its words that repeat. Repeated rows are repeated in the result. An empty table gives an empty one. New columns that
    clash with one of docs take the next free name (runs_1, ...).
    """
    if least < 1 or times < 2:
        raise ValueError("least must be 1 or more, times 2 or more")
    names = fresh(docs, "runs", "top")
    text_at = [c.lower() for c in docs.columns].index("text")
    text_name = f"c{text_at}"

    def run(batches):
        import pyarrow as pa

        splitter, struct = Words(SPACE), pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        entry = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
        for batch in batches:
            offsets, data = texts(batch, text_name)
            out, every, top = [], [], []
            for lo, hi, buf, bounds in chunks(offsets, data):
                _, _, doc, h = splitter.split(buf, bounds)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                spans: dict[int, list] = {}
                for a, b in stretches(h, doc, least, times):
                    d = int(doc[a])
                    spans.setdefault(d, []).append((a - int(at[d]), b - int(at[d])))
                raw, cut = buf.tobytes(), bounds.tolist()
                for d in range(hi - lo):
                    words, found = raw[cut[d] : cut[d + 1]].split(), []
                    for a, b in spans.get(d, ()):
                        found += [(a + s, n, q) for s, n, q in runs(words[a:b], least, times)]
                    out.append(b" ".join(kept_words(words, found) if found else words))
                    every.append([entry(r) for r in found])
                    top.append(entry(min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))) if found else None)
            columns = list(batch.columns)
            columns[text_at] = pa.array(out, pa.binary()).view(pa.string())
            columns += [pa.array(every, pa.list_(struct)), pa.array(top, struct)]
            yield pa.RecordBatch.from_arrays(columns, names=own)

    own = [f"c{i}" for i in range(len(docs.columns) + 2)]
    types = [f.dataType.simpleString() for f in docs.schema.fields] + [f"array<{RUN}>", RUN]
    out = mapped(docs.toDF(*own[:-2]), run, ", ".join(f"{c} {t}" for c, t in zip(own, types, strict=True)))
    return out.toDF(*docs.columns, *names)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with periodic text in a tenth of them.

    h is the CRC-32 of a doc_id in decimal, g = floor(h / 10). Where h % 10 is 0, word i >= a of n words becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); words are then joined by one space.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.floor(h / 10), F.greatest(F.size(words), F.lit(1)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(words) > 0), planted).otherwise(F.col("text")))


def runs_digest(found: Column) -> Column:
    """SHA-256 in hex over each run's "start,length,period" and a line feed."""
    line = F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(line, ""), 256)
