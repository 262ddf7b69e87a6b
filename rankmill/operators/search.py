"""Searches: score every row against a stated set of queries and keep the best k of each.

The rows are read once for a block of queries. Each task keeps a running top-k per query, so what is shuffled is k rows
per query and task. Up to QUERY_BLOCK queries travel with the plan. More of them are a table of query blocks, the rows are
a table of row blocks, and the two tables are joined block by block: the plan is the same for any number of queries, and
nothing of them passes through the driver. Order: score (or distance), then row id; k is cut to the rows there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import kernels
from rankmill.functions.blocks import Best
from rankmill.functions.kernels import Scorer
from rankmill.spec import ParameterError
from rankmill.operators.mutate import running_total
from rankmill.sources.formats import bytes_of, column_of
from rankmill.storage import written

#: Queries of a block, and blocks in a partition of them.
QUERY_BLOCK, QUERY_BLOCKS = 1024, 16
ROW_BLOCK = 4096
#: Blocks of queries that a task has at work at once; the one begun first hands on what it has when there are more.
AT_WORK = 8
#: Bytes that a task's candidates of a two-stage search take at most, but for one query.
HEAP_BYTES = 64 << 20
#: Candidates that are broadcast to the rows at most, some 16 MB; more of them meet the rows by a shuffle.
CANDIDATE_ROWS = 500_000
RESULT = "query_id long, rank int, row_id long, score double"
SCORED = "query_id long, row_id long, score double"


class Block:
    """Queries by id: ids, q (a row each) and more (further numbers of each)."""

    def __init__(self, ids, q, more=None):
        if any(x is None for x in q) or not all(np.isfinite(x).all() for x in q):
            raise ParameterError("a query is null or not finite")
        order = np.argsort(np.asarray(ids), kind="stable")
        self.ids, self.q = np.asarray(ids, np.int64)[order], np.asarray(q, np.float32)[order]
        self.more = None if more is None else np.asarray(more, np.float64)[order]


class Source:
    """How rows become matrices: vectors, or packed codes that decode takes apart, and codes beside them as they are."""

    def __init__(self, decode=None):
        self.decode = decode

    def matrices(self, columns, dim: int) -> list[np.ndarray]:
        x = kernels.block(columns[0], dim) if self.decode is None else self.decode(columns[0])
        return [x, *(bytes_of(c) for c in columns[1:])]

    def of_block(self, columns, n: int, dim: int) -> list[np.ndarray]:
        """matrices() of a block of n rows, from its bytes."""
        x = [np.frombuffer(c, np.uint8).reshape(n, -1) for c in columns]
        if self.decode is not None:
            return [self.decode(column_of(x[0])), *x[1:]]
        d = x[0].view(np.float32)
        if d.shape[1] != dim:
            raise ParameterError(f"a vector doesn't have {dim} coordinates")
        return [d, *x[1:]]


class Rows:
    """Rows as a table (row_id, d) or (row_id, d, e), with their source."""

    def __init__(self, vectors: DataFrame, row_id: str = "row_id", vector: str = "embedding", code: str | None = None, decode=None, beside: str | None = None):
        d = F.col(code) if code else F.col(vector).cast("array<float>")
        self.table = vectors.select(F.col(row_id).cast("long").alias("row_id"), d.alias("d"), *([F.col(beside).alias("e")] if beside else []))
        self.source = Source(decode)

    def blocks(self) -> DataFrame:
        """(ids, d[, e]): the same as blocks of up to ROW_BLOCK rows, each column's rows behind each other."""
        plain = self.source.decode is None

        def run(batches):
            import pyarrow as pa

            held, n = [], 0

            def made():
                x = [np.concatenate(part) for part in zip(*held, strict=True)]
                for lo in range(0, n, ROW_BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([p[lo : lo + ROW_BLOCK].tobytes()], pa.binary()) for p in x], names=names)

            for batch in batches:
                if batch.num_rows:
                    held.append([batch.column(0).to_numpy(), kernels.block(batch.column(1)) if plain else bytes_of(batch.column(1)), *(bytes_of(c) for c in batch.columns[2:])])
                    n += batch.num_rows
                if n >= ROW_BLOCK:
                    yield from made()
                    held, n = [], 0
            if n:
                yield from made()

        names = ["ids", *self.table.columns[1:]]
        return written(self.table.mapInArrow(run, ", ".join(f"{c} binary" for c in names)), "row-blocks")


def query_blocks(asked: DataFrame, size: int) -> DataFrame:
    """(block, ids, q, more): asked (query_id, q and further numbers) as blocks of up to size queries."""
    more = asked.columns[2:]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held, at = [[] for _ in asked_columns], TaskContext.get().partitionId() << 32

        def made(n):
            b = Block(held[0][:n], held[1][:n], list(zip(*(x[:n] for x in held[2:]), strict=True)) if more else None)
            row = [at, b.ids.tobytes(), b.q.tobytes(), b.more.tobytes() if more else b""]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["block", "ids", "q", "more"])

        for batch in batches:
            for x, c in zip(held, batch.columns, strict=True):
                x += c.to_pylist()
            while len(held[0]) >= size:
                yield made(size)
                held, at = [x[size:] for x in held], at + 1
        if held[0]:
            yield made(len(held[0]))

    asked_columns = list(asked.columns)
    parts = max(1, -(-asked.count() // (size * QUERY_BLOCKS)))
    return written(asked.repartition(parts).mapInArrow(run, "block long, ids binary, q binary, more binary"), "query-blocks")


def blocks(queries: DataFrame, query_id: str = "query_id", vector: str = "embedding", size: int = QUERY_BLOCK):
    """(ids, matrix) of queries, block by block."""
    ids, rows = [], []
    for r in queries.select(query_id, vector).orderBy(query_id).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            b = Block(ids, rows)
            yield b.ids, b.q
            ids, rows = [], []
    if ids:
        b = Block(ids, rows)
        yield b.ids, b.q


def _over(rows: Rows, queries: DataFrame, make, schema: str, query_id: str, vector: str, size=None, more: tuple = ()) -> DataFrame:
    """What make(block) makes of all rows, for every block of queries: its offer(ids, d[, e]) and finish() yield batches.

    size: queries of a block, as a number or from their dimension; QUERY_BLOCK without it.
    """
    source = rows.source
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"), *more)
    first = asked.limit((size if isinstance(size, int) else QUERY_BLOCK) + 1).collect()
    if not first:
        return queries.sparkSession.createDataFrame([], schema)
    size = size(len(first[0].q or ())) if callable(size) else size or QUERY_BLOCK

    def with_plan(block):
        def run(batches):
            work, dim = make(block), block.q.shape[1]
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), source.matrices(batch.columns[1:], dim)
                for lo in range(0, len(ids), ROW_BLOCK):
                    yield from work.offer(ids[lo : lo + ROW_BLOCK], *(p[lo : lo + ROW_BLOCK] for p in x))
            yield from work.finish()

        return run

    def by_block(batches):
        at_work: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(0)[i].as_py()
                ids, q, own, row_ids, *x = (c[i].as_buffer() for c in batch.columns[1:])
                if b not in at_work:
                    if len(at_work) == AT_WORK:
                        yield from at_work.pop(next(iter(at_work)))[0].finish()
                    ids = np.frombuffer(ids, np.int64)
                    block = Block(ids, np.frombuffer(q, np.float32).reshape(len(ids), -1), np.frombuffer(own).reshape(len(ids), -1) if more else None)
                    at_work[b] = make(block), block.q.shape[1]
                work, dim = at_work[b]
                row_ids = np.frombuffer(row_ids, np.int64)
                yield from work.offer(row_ids, *source.of_block(x, len(row_ids), dim))
        for work, _ in at_work.values():
            yield from work.finish()

    if len(first) <= size:
        block = Block([r[0] for r in first], [r[1] for r in first], [list(r[2:]) for r in first] if more else None)
        return rows.table.mapInArrow(with_plan(block), schema)
    pairs = query_blocks(asked, size).crossJoin(rows.blocks().toDF("row_ids", *rows.table.columns[1:]))  # blocks beside blocks
    return pairs.mapInArrow(by_block, schema)


def _batch(query_ids, row_ids, scores):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(row_ids), pa.array(scores, pa.float64())], names=["query_id", "row_id", "score"])


class _Top:
    """The k best rows of each query."""

    def __init__(self, scorer: Scorer, k: int, block: Block):
        self.scorer, self.ids, self.q = scorer, block.ids, scorer.queries(block.q)
        self.best = Best(len(block.ids), k, scorer.largest)

    def offer(self, ids, d):
        self.best.offer(self.scorer.score(self.scorer.docs(d), self.q), ids)
        return ()

    def finish(self):
        j, scores, ids, _ = self.best.rows()
        if len(j):
            yield _batch(self.ids[j], ids, scores)


class _All:
    """Every score."""

    def __init__(self, scorer: Scorer, block: Block):
        self.scorer, self.ids, self.q = scorer, block.ids, scorer.queries(block.q)

    def offer(self, ids, d):
        s = self.scorer.score(self.scorer.docs(d), self.q)
        yield _batch(np.tile(self.ids, len(ids)), np.repeat(ids, len(self.ids)), s.reshape(-1).astype(np.float64))

    def finish(self):
        return ()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they fit, by themselves or as differences from 0 on."""
    if len(x) and (x == np.floor(x)).all() and 0 <= x.min():
        kind = np.min_scalar_type(int(x.max()))
        return x.astype(kind) if kind.itemsize < x.dtype.itemsize else x
    return x


class _Packed:
    """Every score, those of a query and block of rows as one row: the lowest id, the steps from id to id and the scores, in few bytes."""

    def __init__(self, scorer: Scorer, block: Block):
        self.scorer, self.ids, self.q = scorer, block.ids, scorer.queries(block.q)

    def offer(self, ids, d):
        import pyarrow as pa

        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        s = self.scorer.score(self.scorer.docs(d), self.q)[order].T
        low, steps, n = int(ids[order[0]]), _narrow(np.diff(ids[order], prepend=ids[order[0]])), len(self.ids)
        packed = [_narrow(np.ascontiguousarray(x)) for x in s]
        columns = [pa.array(self.ids), pa.array(np.full(n, low)), pa.array([steps.tobytes()] * n, pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary())]
        kinds = [pa.array([steps.dtype.str] * n), pa.array([x.dtype.str for x in packed])]
        yield pa.RecordBatch.from_arrays([*columns, *kinds], names=["query_id", "low", "steps", "scores", "step_kind", "score_kind"])

    def finish(self):
        return ()


def _unpacked(batches):
    """Pieces of _Packed, by query, as (query_id, scores) in order of row id."""
    import pyarrow as pa

    own, ids, scores = None, [], []

    def made():
        order = np.argsort(np.concatenate(ids), kind="stable")
        found = np.concatenate(scores)[order]
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], names=["query_id", "scores"])

    for batch in batches:
        q, low, steps, s, step_kind, score_kind = (c.to_pylist() for c in batch.columns)
        for i in range(len(q)):
            if q[i] != own and ids:
                yield made()
                ids, scores = [], []
            own = q[i]
            ids.append(low[i] + np.cumsum(np.frombuffer(steps[i], step_kind[i]).astype(np.int64)))
            scores.append(np.frombuffer(s[i], score_kind[i]).astype(np.float64))
    if ids:
        yield made()


class _Histogram:
    """How many rows have each score; scores are whole numbers from 0 on."""

    def __init__(self, scorer: Scorer, own: bool, block: Block):
        self.scorer, self.own, self.ids, self.q = scorer, own, block.ids, scorer.queries(block.q)
        self.counts = np.zeros((len(block.ids), 1), np.int64)

    def offer(self, ids, d):
        s = self.scorer.score(self.scorer.docs(d), self.q).astype(np.int64)
        n, width = len(self.ids), max(self.counts.shape[1], int(s.max(initial=0)) + 1)
        if width > self.counts.shape[1]:
            self.counts = np.pad(self.counts, ((0, 0), (0, width - self.counts.shape[1])))
        self.counts += np.bincount((s + np.arange(n) * width).reshape(-1), minlength=n * width).reshape(n, width)
        if not self.own:
            at = np.searchsorted(self.ids, ids)
            for i in np.flatnonzero(self.ids[np.minimum(at, n - 1)] == ids):
                self.counts[at[i], s[i, at[i]]] -= 1
        return ()

    def finish(self):
        import pyarrow as pa

        j, score = np.nonzero(self.counts)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[j]), pa.array(score.astype(np.int32)), pa.array(self.counts[j, score])], names=["query_id", "score", "n"])


class _Within:
    """Rows better than each query's cut, and at the cut those of the lowest ids that may fill up."""

    def __init__(self, scorer: Scorer, block: Block):
        self.scorer, self.ids, self.q = scorer, block.ids, scorer.queries(block.q)
        self.cut = block.more[:, 0]
        self.ties = Best(len(block.ids), block.more[:, 1].astype(np.int64), False)

    def offer(self, ids, d):
        s = self.scorer.score(self.scorer.docs(d), self.q)
        key = -s if self.scorer.largest else s
        r, j = np.nonzero(key < self.cut)
        if len(r):
            yield _batch(self.ids[j], ids[r], s[r, j].astype(np.float64))
        r, j = np.nonzero(key == self.cut)
        if len(r):
            self.ties.add(j, s[r, j] * 0, ids[r])

    def finish(self):
        j, _, ids, _ = self.ties.rows()
        if len(j):
            yield _batch(self.ids[j], ids, (-self.cut if self.scorer.largest else self.cut)[j])


class _Two:
    """The m best rows by a first score, each with what the second one needs of it; both scores, packed, a row a query."""

    def __init__(self, first: Scorer, second: Scorer, m: int, block: Block):
        self.first, self.second, self.ids = first, second, block.ids
        self.q, self.q2 = first.queries(block.q), second.queries(block.q)
        self.best = Best(len(block.ids), m, first.largest)

    def offer(self, ids, d, e=None):
        small = (lambda r: e[r]) if e is not None else (lambda r: self._small(d, r))
        self.best.offer(self.first.score(self.first.docs(d), self.q), ids, small)
        return ()

    def _small(self, d, r):
        once, at = np.unique(r, return_inverse=True)
        return self.second.small(d[once])[at]

    def finish(self):
        import pyarrow as pa

        j, cheap, ids, carry = self.best.rows()
        cut = np.searchsorted(j, np.arange(len(self.ids) + 1)).tolist()
        out = []
        for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if lo < hi:
                exact = self.second.one(carry[lo:hi], self.q2, i)
                out.append((int(self.ids[i]), ids[lo:hi].tobytes(), cheap[lo:hi].tobytes(), exact.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["query_id", "ids", "cheap", "exact"])


def _merged(first_largest: bool, second_largest: bool, m: int, k: int):
    """Tasks' candidates, by query: the m best of all by the first score, of these the k best by the second."""

    def run(batches):
        import pyarrow as pa

        query, held, n = None, [], 0

        def kept():
            ids, cheap, exact = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.lexsort((ids, -cheap if first_largest else cheap))[:m]
            return ids[at], cheap[at], exact[at]

        def result():
            ids, _, exact = kept()
            at = np.lexsort((ids, -exact if second_largest else exact))[:k]
            return pa.RecordBatch.from_arrays([pa.array([query] * len(at), pa.int64()), pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), pa.array(ids[at]), pa.array(exact[at])], names=["query_id", "rank", "row_id", "score"])

        for batch in batches:
            for q, *x in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                if q != query:
                    if held:
                        yield result()
                    query, held, n = q, [], 0
                x = [np.frombuffer(c.as_buffer(), t) for c, t in zip(x, (np.int64, np.float64, np.float64), strict=True)]
                held.append(x)
                n += len(x[0])
                if n > 8 * m:
                    held = [kept()]
                    n = len(held[0][0])
        if held:
            yield result()

    return run


def top_k(scored: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """The k best rows of each query of (query_id, row_id, score), ranked from 1."""
    order = F.desc("score") if largest else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(order, "row_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")


def search(vectors: DataFrame, queries: DataFrame, scorer: Scorer, k: int, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None, size: int | None = None) -> DataFrame:
    """(query_id, rank, row_id, score): the k best rows of vectors for each query.

    code: the rows have this column of packed codes in place of vector; decode makes a matrix of it, which the scorer's
    docs() takes. size: queries of a block, QUERY_BLOCK by default.
    """
    if k < 0:
        raise ParameterError("k must not be negative")
    if not k:
        return vectors.sparkSession.createDataFrame([], RESULT)
    found = _over(Rows(vectors, row_id, vector, code, decode), queries, lambda block: _Top(scorer, k, block), SCORED, query_id, vector, size)
    return top_k(found, k, scorer.largest)


def _pairs(block: Block | None, scorer: Scorer, decode=None):
    """Scores of rows (query_id, pos, row_id, d[, q]); block: the queries, else each row brings its own."""

    def run(batches):
        import pyarrow as pa

        encoded = scorer.queries(block.q) if block else None
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column(0).to_numpy()
            if block:
                q, at = encoded, np.searchsorted(block.ids, asked)
            else:
                _, once, at = np.unique(asked, return_index=True, return_inverse=True)
                own = Block(np.arange(len(once)), [batch.column(4)[int(i)].as_py() for i in once])
                q = scorer.queries(own.q)
            dim = (block or own).q.shape[1]
            d = scorer.docs(kernels.block(batch.column(3), dim) if decode is None else decode(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scorer.pairs(d, q, at), pa.float64())], names=["query_id", "pos", "row_id", "score"])

    return run


def score_candidates(vectors: DataFrame, queries: DataFrame, candidates: DataFrame, scorer: Scorer, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None, most: int | None = None) -> DataFrame:
    """candidates (query_id, pos, row_id) with score, in their order and as often as they are listed.

    Candidates meet their rows by an equi-join on row_id. Up to CANDIDATE_ROWS of them are broadcast, so that the rows are
    only read, and but for those asked for go no further; more are shuffled with the rows. most: how many candidates a
    query has at most, where that is known; else they are counted. Up to QUERY_BLOCK queries travel with the plan; more
    of them meet their candidates by a join. Candidates of other queries are left out.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
    first = asked.limit(QUERY_BLOCK + 1).collect()
    schema = "query_id long, pos int, row_id long, score double"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    block = Block([r[0] for r in first], [r[1] for r in first]) if len(first) <= QUERY_BLOCK else None
    own = candidates.select(F.col("query_id").cast("long").alias("query_id"), F.col("pos").cast("int").alias("pos"), F.col("row_id").cast("long").alias("row_id"))
    if most is None:
        own = written(own, "candidates")
    few = most * len(first) <= CANDIDATE_ROWS if most is not None and block else own.limit(CANDIDATE_ROWS + 1).count() <= CANDIDATE_ROWS
    if block:
        own = own.where(F.col("query_id").isin(block.ids.tolist()))
    joined = Rows(vectors, row_id, vector, code).table.join(F.broadcast(own) if few else own, "row_id")
    if not block:
        joined = joined.join(asked, "query_id")
    return joined.select("query_id", "pos", "row_id", "d", *([] if block else ["q"])).mapInArrow(_pairs(block, scorer, decode), schema)


def search_subset(vectors, queries, candidates, scorer: Scorer, k: int, **names) -> DataFrame:
    """The k best of each query's candidates; a candidate listed twice may come twice."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if scorer.largest else F.asc("score"), "row_id", "pos")
    s = score_candidates(vectors, queries, candidates, scorer, **names).withColumn("rank", F.row_number().over(w))
    return s.where(F.col("rank") <= k).select("query_id", "rank", "row_id", "score")


def padded(results: DataFrame, queries: DataFrame, width: int, query_id: str = "query_id") -> DataFrame:
    """width rows for every query; where results has none: row -1, score -infinity."""
    grid = queries.select(F.col(query_id).cast("long").alias("query_id")).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(width))))
    return grid.join(results, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("row_id", F.lit(-1)).alias("row_id"), F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def candidates(vectors, queries, scorer: Scorer, m: int, **names) -> DataFrame:
    """(query_id, pos, row_id): the first stage, the m best rows by a cheap score."""
    return search(vectors, queries, scorer, m, **names).select("query_id", (F.col("rank") - 1).alias("pos"), "row_id")


def two_stage(vectors, queries, first: Scorer, second: Scorer, m: int, k: int, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None, beside: str | None = None, size: int | None = None) -> DataFrame:
    """m candidates by the first score, the k best of them by the second, in one pass over the rows.

    A task keeps the m best rows of each query with what the second score needs of them (second.small), scores them at its
    end, and hands on m ids and both scores a query. beside: a second column of packed codes, of which second.lift makes
    what its score takes; without it, both scores come from the vectors. size: queries of a block at most.
    """
    if not m or not k:
        return vectors.sparkSession.createDataFrame([], RESULT)
    most = size or QUERY_BLOCK
    size = lambda dim: max(1, min(most, HEAP_BYTES // (m * (24 + dim * second.width))))
    found = _over(Rows(vectors, row_id, vector, code, decode, beside), queries, lambda block: _Two(first, second, m, block), "query_id long, ids binary, cheap binary, exact binary", query_id, vector, size)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(first.largest, second.largest, m, k), RESULT)


def score_all(vectors, queries, scorer: Scorer, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None) -> DataFrame:
    """(query_id, row_id, score) of every query and row: as many rows as asked for, made in tasks and not shuffled."""
    return _over(Rows(vectors, row_id, vector, code, decode), queries, lambda block: _All(scorer, block), SCORED, query_id, vector)


def histogram(vectors, queries, scorer: Scorer, own: bool = True, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None) -> DataFrame:
    """(query_id, score, n): how many rows have each score. Scores are whole numbers from 0 on; they are counted in the
    tasks and never rows. own: also the row whose id is the query's."""
    found = _over(Rows(vectors, row_id, vector, code, decode), queries, lambda block: _Histogram(scorer, own, block), "query_id long, score int, n long", query_id, vector)
    return found.groupBy("query_id", "score").agg(F.sum("n").alias("n"))


def candidates_exactly(vectors, queries, scorer: Scorer, m: int, query_id: str = "query_id", vector: str = "embedding", **names) -> DataFrame:
    """(query_id, pos, row_id): the m best rows of each query, by ascending row id, found by a threshold.

    Scores are whole numbers from 0 on. A first pass counts them in the tasks; the sum of their histograms gives each
    query's cut. A second pass hands on the rows within the cut alone: all better ones, and of those at the cut the lowest
    ids of each task that may fill up m.
    """
    key = F.col("score") * (-1 if scorer.largest else 1)
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("key"))
    better = F.col("upto") - F.col("n")
    hist = histogram(vectors, queries, scorer, query_id=query_id, vector=vector, **names).select("query_id", key.alias("key"), "n").withColumn("upto", upto).where(better < m)
    cut = hist.groupBy("query_id").agg(F.max(F.struct("key", better.alias("better"))).alias("last"))
    cut = written(cut.select("query_id", F.col("last.key").cast("double").alias("sx_cut"), (m - F.col("last.better")).cast("double").alias("sx_open")), "cuts")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("embedding")).join(cut, "query_id")
    rows = Rows(vectors, names.get("row_id", "row_id"), vector, names.get("code"), names.get("decode"))
    found = _over(rows, asked, lambda block: _Within(scorer, block), SCORED, "query_id", "embedding", None, ("sx_cut", "sx_open"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(key, "row_id"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")) - 1
    return found.withColumn("at", at).where(F.col("at") <= m).select("query_id", pos.alias("pos"), "row_id")


def score_rows(vectors, queries, scorer: Scorer, row_id: str = "row_id", query_id: str = "query_id", vector: str = "embedding", code: str | None = None, decode=None) -> DataFrame:
    """(query_id, scores): all scores of a query as one array, in order of row id. A query's row is as long as the table.

    Tasks hand on the scores of a query and block of rows as one row of bytes, so a pair costs a shuffle a byte or two
    where scores are small whole numbers; a task puts one query together at a time.
    """
    pieces = "query_id long, low long, steps binary, scores binary, step_kind string, score_kind string"
    found = _over(Rows(vectors, row_id, vector, code, decode), queries, lambda block: _Packed(scorer, block), pieces, query_id, vector)
    return found.repartition("query_id").sortWithinPartitions("query_id", "low").mapInArrow(_unpacked, "query_id long, scores array<double>")


def select_exactly(scored: DataFrame, m: int, largest: bool = True) -> DataFrame:
    """(query_id, pos, row_id): the m best rows of each query, by ascending row id, found by a threshold.

    A histogram of whole-number scores gives the threshold of each query: all better rows are taken, and of those at the
    threshold the lowest ids that fill up m.
    """
    key = F.col("score") * (-1 if largest else 1)
    hist = scored.groupBy("query_id", key.alias("key")).agg(F.count("*").alias("n"))  # as many rows as there are scores
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("key"))
    cut = hist.withColumn("upto", upto).where(F.col("upto") - F.col("n") < m).groupBy("query_id").agg(F.max("key").alias("cut"), F.max(F.struct("key", (F.col("upto") - F.col("n")).alias("better")))["better"].alias("better"))
    pool = scored.join(cut, "query_id").where(key <= F.col("cut"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(key, "row_id"))
    kept = pool.withColumn("at", at).where(F.col("at") <= m)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")) - 1
    return kept.select("query_id", pos.alias("pos"), "row_id")


def search_one(vectors: DataFrame, query: list[float], scorer: Scorer, k: int, candidates: list[int] | None = None, **names) -> tuple[list[tuple[int, float]], dict]:
    """(hits, stats) of one query: hits (row_id, score), best first. candidates: only these rows, a repeated one repeatedly.

    stats: rows there are, rows scored, hits asked for and returned.
    """
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
    n = vectors.count()
    if candidates is None:
        found, scored = search(vectors, asked, scorer, min(k, n), **names), n
    else:
        if any(not 0 <= c < n for c in candidates):
            raise ParameterError("a candidate is no row of this index")
        listed = spark.createDataFrame([(0, i, int(c)) for i, c in enumerate(candidates)], "query_id long, pos int, row_id long")
        found, scored = search_subset(vectors, asked, listed, scorer, k, most=len(candidates), **names), len(candidates)
    hits = [(r.row_id, r.score) for r in found.orderBy("rank").collect()]
    return hits, {"vector_count": n, "scored": scored, "requested": k, "returned": len(hits)}


def results_json(results: DataFrame, k: int) -> DataFrame:
    """(query_id, json): each query's ids and scores as a JSON object with its k."""
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id", "score"))).alias("l"))
    return lists.select("query_id", F.to_json(F.struct(F.lit(k).alias("k"), F.transform("l", lambda s: s["row_id"]).alias("indices"), F.transform("l", lambda s: s["score"]).alias("scores"))).alias("json"))


def results_of_json(table: DataFrame) -> DataFrame:
    """The results that results_json() wrote; an error where ids and scores aren't as many, or more than k."""
    r = table.select("query_id", F.from_json("json", "k int, indices array<long>, scores array<double>").alias("r"))
    good = (F.size("r.indices") == F.size("r.scores")) & (F.size("r.indices") <= F.col("r.k"))
    r = r.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(F.lit("ids and scores of a result don't fit its k"))))
    z = r.select("query_id", F.posexplode(F.arrays_zip(F.col("r.indices").alias("i"), F.col("r.scores").alias("s"))).alias("pos", "z"))
    return z.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("z")["i"].alias("row_id"), F.col("z")["s"].alias("score"))


def of_query(results: DataFrame, query_id: int) -> DataFrame:
    return results.where(F.col("query_id") == query_id).orderBy("rank")


def csr(found: DataFrame) -> DataFrame:
    """(query_id, start, end, candidates): the lists of (query_id, pos, row_id) behind each other, with their offsets."""
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "row_id"))).alias("l"))
    lists = written(lists.select("query_id", F.transform("l", lambda s: s["row_id"]).alias("candidates")), "lists")
    ends = running_total(lists.select("query_id", F.size("candidates").cast("long").alias("n")), "query_id", "n", "end")
    return lists.join(ends, "query_id").select("query_id", (F.col("end") - F.size("candidates")).alias("start"), "end", "candidates")


def csr_query_count(lists: DataFrame) -> int:
    return lists.count()


def csr_candidates(lists: DataFrame, query_id: int) -> list[int]:
    """The candidates of one query, in their order."""
    row = lists.where(F.col("query_id") == query_id).first()
    if row is None:
        raise ParameterError("no such query")
    return list(row.candidates)


def csr_is_empty(lists: DataFrame) -> bool:
    """No queries at all."""
    return not lists.limit(1).count()


def csr_has_no_candidates(lists: DataFrame) -> bool:
    """Queries or not, no candidate."""
    return not lists.where(F.size("candidates") > 0).limit(1).count()
