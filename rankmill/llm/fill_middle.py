"""Operator 13: fill-in-the-middle transformation by big-integer bit-parallelism.

A text is a big integer, one lane of eight bits for each byte of its UTF-8. bytes.translate turns bytes into class
masks, shifted boolean operations of whole masks mark where units begin and where a sentinel stands, bit_count gives the
number of units, and the place of the k-th mark is found by halving the mask and counting the lower half.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import fresh, mapped

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _table(chosen) -> bytes:
    chosen = set(chosen)
    return bytes(int(b in chosen) for b in range(256))


LEAD = _table([*range(0x80), *range(0xC0, 0x100)])
WORD = _table(b for b in range(256) if b not in (0x20, *range(0x09, 0x0E)))
NEWLINE, OPEN, NAME, CLOSE = _table(b"\n"), _table(b"<"), _table(b"PSM"), _table(b">")


def mask(data: bytes, table: bytes) -> int:
    """A one in the lane of each byte of the class."""
    return int.from_bytes(data.translate(table), "little")


#: Where units begin. What stands before the first one belongs to it.
UNITS = {
    "char": lambda data: mask(data, LEAD),
    "word": lambda data: (w := mask(data, WORD)) & ~(w << 8),
    "line": lambda data: (mask(data, NEWLINE) << 8 | 1) & (1 << 8 * len(data)) - 1,
}


def select(marks: int, k: int, width: int) -> int:
    """The lane of the k-th one (from 0) of marks, which has width lanes."""
    at = 0
    while width > 1:
        half = width >> 1
        low = marks & (1 << 8 * half) - 1
        below = low.bit_count()
        if k < below:
            marks, width = low, half
        else:
            marks, width, k, at = marks >> 8 * half, width - half, k - below, at + half
    return at


def has_sentinel(data: bytes) -> bool:
    return b"<" in data and bool(mask(data, OPEN) & mask(data, NAME) >> 8 & mask(data, CLOSE) >> 16)


def draws(seed: str, doc_id) -> list[int]:
    """Four numbers below 2**32: the first digits of a SHA-256 over seed and doc_id (nothing for null)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(data: bytes, doc_id, seed: str, rate: int, spm: int, unit: str):
    """(n, form, units of the prefix, units of the middle, output) of one text."""
    marks = UNITS[unit](data)
    n = marks.bit_count()
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= rate or has_sentinel(data):
        return n, "plain", None, None, data
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (0 if k == 0 else len(data) if k == n else select(marks, k, len(data)) for k in (i, j))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm:
        return n, "spm", i, j - i, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", i, j - i, b"".join((p, prefix, s, suffix, m, middle))


def fill_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, unit: str = "char") -> DataFrame:
    """docs (doc_id, text and more) with text rearranged, and n, form, prefix_units and middle_units.

    A text is cut into units (char: code points; word: from the start of a word to that of the next; line), n of them, at two places
    drawn from a hash of seed and doc_id. rate of a hundred texts are rearranged, spm of a hundred of these suffix first.
    Empty texts and those that hold a sentinel stay plain, with null prefix_units and middle_units; a null text is an
    empty one. Texts are taken whole, however long, in a few times their own memory. A null doc_id draws as an empty one. Equal rows
    give equal rows; rows of one doc_id draw alike. An empty table gives an empty one. New columns that clash with one of
    docs take the next free name (n_1, ...).
    """
    names = fresh(docs, "n", "form", "prefix_units", "middle_units")
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    id_at, text_at = at["doc_id"], at["text"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).cast(pa.binary())
            new = [rearranged(t.as_py() or b"", i, seed, rate, spm, unit) for i, t in zip(ids, texts, strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array([x[4] for x in new], pa.binary()).view(pa.string())
            columns += [pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.string()), *(pa.array([x[c] for x in new], pa.int64()) for c in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    own = [f"c{i}" for i in range(len(docs.columns) + 4)]
    types = [f.dataType.simpleString() for f in docs.schema.fields] + ["long", "string", "long", "long"]
    out = mapped(docs.toDF(*own[:-4]), run, ", ".join(f"{c} {t}" for c, t in zip(own, types, strict=True)))
    return out.toDF(*docs.columns, *names)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_middle made output of. Only sentinels put in stand there, since texts that have one stay plain."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)), F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    draw = lambda k: f"CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {8 * k - 7}, 8) AS BIGINT)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {draw(1)} AS h1, {draw(2)} AS h2, {draw(3)} AS h3, {draw(4)} AS h4 FROM documents),
    c AS (SELECT *, length(t) AS n, least(h1 % (length(t) + 1), h2 % (length(t) + 1)) AS i, greatest(h1 % (length(t) + 1), h2 % (length(t) + 1)) AS j,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
                  ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c"""
