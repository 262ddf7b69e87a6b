"""Compact index files: five little-endian layouts, each a short header and rows of equal length.

    ranks     OVR1  version u8, dim u32, rows u32; rows of u16 ranks
    buckets   OVRQ  version u8, bits u8, dim u32, rows u32; rows of packed bucket codes
    top bits  OVBM  version u8, dim u32, n_top u32, rows u32; rows of u64 words
    signs     OVSB  version u8, dim u32, rows u32; rows of u64 words
    pairs     OVFS  version u8, dim u32, rows u32; blocks of 32 rows, by pair and row

Reading takes byte ranges of the file as partitions, so a file of any size is read by many tasks; payloads are checked as
they are read. Writing makes one file, whose pieces tasks put in their places.
"""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.blocks import byte_values, unpacked
from rankmill.spec import MAX_PAYLOAD_BYTES, MAX_VECTORS, BitmapSpec, BucketSpec, PairScanSpec, ParameterError, RankSpec, SignSpec

# Magics and suffixes of the files, and the older magics that are read but not written.
KINDS = {"rank": (b"OVR1", ".ovr"), "buckets": (b"OVRQ", ".ovrq"), "bitmap": (b"OVBM", ".ovbm"), "sign": (b"OVSB", ".ovsb"), "pairs": (b"OVFS", ".ovfs")}
OLDER = {b"TVR1": "rank", b"TVRQ": "buckets", b"TVBM": "bitmap", b"TVSB": "sign"}
VERSION = 1
BLOCK = 32
GAPS = "row ids must run from 0 without gaps"
ROWS_PER_TASK = 65_536
#: What may be wrong with a row of a file.
FAULTS = ("", "not a permutation", "uneven buckets", "a pair value out of range", "padding that isn't 0", "bits set")


class FormatError(ValueError):
    """A file that isn't what its header says, or breaks a rule of its kind."""


@dataclass(frozen=True)
class Metadata:
    kind: str
    format_version: int
    dim: int
    vector_count: int
    bytes_per_vec: int
    bits: int | None
    n_top: int | None
    header_bytes: int
    file_size_bytes: int


def registry(spark: SparkSession) -> DataFrame:
    rows = [(k, m.decode(), s, next((o.decode() for o, x in OLDER.items() if x == k), None), k != "pairs") for k, (m, s) in KINDS.items()]
    return spark.createDataFrame(rows, "kind string, magic string, suffix string, older_magic string, probed boolean")


def header(kind: str, dim: int, rows: int, bits: int | None = None, n_top: int | None = None) -> bytes:
    if rows > MAX_VECTORS:
        raise FormatError("too many rows for one file")
    if kind == "rank":
        RankSpec(dim)
        middle = b""
    elif kind == "buckets":
        if bits == 8:
            raise FormatError("codes of 8 bits have no file format")
        BucketSpec(dim, bits)
        middle = struct.pack("<B", bits)
    elif kind == "bitmap":
        BitmapSpec(dim, n_top)
        return KINDS[kind][0] + struct.pack("<BIII", VERSION, dim, n_top, rows)
    elif kind == "sign":
        SignSpec(dim)
        middle = b""
    elif kind == "pairs":
        PairScanSpec(dim)
        middle = b""
    else:
        raise FormatError(f"no such kind: {kind}")
    return KINDS[kind][0] + struct.pack("<B", VERSION) + middle + struct.pack("<II", dim, rows)


def parse_header(head: bytes, size: int, allow_pairs: bool = True) -> Metadata:
    """Metadata of a file of size bytes from its first ones; the size must be exactly what the header asks for."""
    magic = head[:4]
    kind = next((k for k, (m, _) in KINDS.items() if m == magic), OLDER.get(magic))
    if kind is None or kind == "pairs" and not allow_pairs:
        raise FormatError("unknown magic")
    bits = n_top = None
    try:
        if head[4] != VERSION:
            raise FormatError("unknown version")
        if kind == "buckets":
            bits, dim, rows = struct.unpack_from("<BII", head, 5)
            length = 14
        elif kind == "bitmap":
            dim, n_top, rows = struct.unpack_from("<III", head, 5)
            length = 17
        else:
            dim, rows = struct.unpack_from("<II", head, 5)
            length = 13
        if bits == 8:
            raise FormatError("codes of 8 bits have no file format")
        spec = {"rank": lambda: RankSpec(dim), "buckets": lambda: BucketSpec(dim, bits), "bitmap": lambda: BitmapSpec(dim, n_top), "sign": lambda: SignSpec(dim), "pairs": lambda: PairScanSpec(dim)}[kind]()
    except (IndexError, struct.error, ParameterError) as e:
        raise FormatError(f"bad header: {e}") from e
    stored = -(-rows // BLOCK) * BLOCK if kind == "pairs" else rows
    if rows > MAX_VECTORS or stored * spec.bytes_per_vec > MAX_PAYLOAD_BYTES:
        raise FormatError("more rows or bytes than a file may have")
    if size != length + stored * spec.bytes_per_vec:
        raise FormatError("the payload's length isn't what the header asks for")
    return Metadata(kind, VERSION, dim, rows, spec.bytes_per_vec, bits, n_top, length, size)


def probe(path: str) -> Metadata:
    """Metadata of a file, from its header and length alone; pair files aren't probed."""
    import os

    with open(path, "rb") as f:
        return parse_header(f.read(17), os.path.getsize(path), allow_pairs=False)


def pack_codes(codes: np.ndarray, bits: int) -> np.ndarray:
    c, per = codes.astype(np.uint8), 8 // bits
    out = np.zeros((len(c), c.shape[1] // per), np.uint8)
    for i in range(per):
        out |= c[:, i::per] << np.uint8(bits * (per - 1 - i))
    return out


def unpack_codes(data: np.ndarray, dim: int, bits: int) -> np.ndarray:
    return unpacked(data, byte_values(bits, np.arange(1 << bits))).reshape(len(data), dim)


def pack_pairs(codes: np.ndarray) -> bytes:
    """Blocks of 32 rows; in a block the rows' values of the first pair, then of the second; missing rows are 0."""
    n, dim = codes.shape
    nibbles = np.zeros((-(-n // BLOCK) * BLOCK, dim // 2), np.uint8)
    nibbles[:n] = codes[:, 0::2] * 4 + codes[:, 1::2]
    return nibbles.reshape(-1, BLOCK, dim // 2).transpose(0, 2, 1).tobytes()


def encode_rows(kind: str, rows: np.ndarray, meta) -> bytes:
    if kind == "rank":
        return rows.astype("<u2").tobytes()
    if kind == "buckets":
        return pack_codes(rows.astype(np.int64), meta.bits).tobytes()
    if kind == "pairs":
        return pack_pairs(rows.astype(np.int64))
    return rows.astype("<i8").tobytes()


def _decoded(meta: Metadata, data: bytes, count: int):
    """(rows, why): count rows from data, and for each what is wrong with it, 0 for nothing; else a number of FAULTS.

    Rows of a pair file are stored in whole blocks: what stands after the last row must be 0, and counts as that row's.
    """
    out, why = None, np.zeros(count, np.int64)
    if meta.kind == "rank":
        out = np.frombuffer(data, "<u2").reshape(-1, meta.dim).astype(np.int64)
        why[(np.sort(out, axis=1) != np.arange(meta.dim)).any(1)] = 1
    elif meta.kind in ("buckets", "pairs"):
        bits, high = meta.bits or 2, None
        if meta.kind == "buckets":
            out = unpack_codes(np.frombuffer(data, np.uint8).reshape(-1, meta.bytes_per_vec), meta.dim, bits)
        else:
            n = np.frombuffer(data, np.uint8).reshape(-1, meta.dim // 2, BLOCK).transpose(0, 2, 1).reshape(-1, meta.dim // 2)
            out, high = np.stack([n >> 2, n & 3], 2).reshape(len(n), meta.dim)[:count].astype(np.int64), (n > 15).any(1)
        if meta.dim % (1 << bits) == 0:
            filled = np.stack([(out == b).sum(1) for b in range(1 << bits)], 1)
            why[(filled != meta.dim >> bits).any(1)] = 2
        if high is not None:
            why[high[:count]] = 3
            if count and n[count:].any():
                why[-1] = 4
    else:
        out = np.frombuffer(data, "<i8").reshape(-1, meta.dim // 64)
        if meta.kind == "bitmap":
            why[np.unpackbits(out.view(np.uint8).reshape(len(out), -1), axis=1).sum(1) != meta.n_top] = 5
    return out, why


def decode_rows(meta: Metadata, data: bytes, first: int, count: int) -> np.ndarray:
    """count rows from data, which starts at row first; checked. Bitmaps as words, the rest as numbers a coordinate."""
    out, why = _decoded(meta, data, count)
    bad = np.flatnonzero(why)
    if len(bad):
        raise FormatError(f"row {first + int(bad[0])} breaks the rules of its kind: {FAULTS[int(why[bad[0]])]}")
    return out


def row_bytes(kind: str, rows: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Rows of codes as bytes, a row each: as in a file of the kind, but for pairs, whose rows stand by themselves."""
    if kind == "rank":
        return rows.astype("<u2").view(np.uint8).reshape(len(rows), -1)
    if kind == "buckets":
        return pack_codes(rows.astype(np.int64), bits)
    if kind == "pairs":
        return (rows[:, 0::2] * 4 + rows[:, 1::2]).astype(np.uint8)
    return np.ascontiguousarray(rows.astype("<i8")).view(np.uint8).reshape(len(rows), -1)


def rows_of_bytes(kind: str, data: np.ndarray, dim: int, bits: int | None = None) -> np.ndarray:
    """The other way: numbers a coordinate, or words."""
    if kind == "rank":
        return np.ascontiguousarray(data).view("<u2").astype(np.int64)
    if kind == "buckets":
        return unpack_codes(data, dim, bits)
    if kind == "pairs":
        return np.stack([data >> 2, data & 3], 2).reshape(len(data), dim).astype(np.int64)
    return np.ascontiguousarray(data).view("<i8")


def matrix_of(column, width: int) -> np.ndarray:
    """A binary column of rows of width bytes each, as a matrix."""
    import pyarrow as pa

    if column.null_count:
        raise FormatError("a code is null")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if (np.diff(offsets) != width).any():
        raise FormatError(f"a code hasn't {width} bytes")
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(column) else np.empty((0, width), np.uint8)


def bytes_of(column) -> np.ndarray:
    """A binary column whose rows are as long as the first one, as a matrix of bytes."""
    return matrix_of(column, len(column[0].as_buffer()) if len(column) and column[0].is_valid else 0)


def column_of(data: np.ndarray):
    """The other way: a matrix of bytes as a binary column."""
    import pyarrow as pa

    data = np.ascontiguousarray(data, np.uint8)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ranges(spark: SparkSession, path: str, found, schema: str) -> DataFrame:
    """found(meta, first, count, data) of each ROWS_PER_TASK rows of a file, read by tasks; it gives a record batch."""
    import os

    with open(path, "rb") as f:
        meta = parse_header(f.read(17), os.path.getsize(path))
    fields = asdict(meta)

    def run(batches):
        m = Metadata(**fields)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                count = min(ROWS_PER_TASK, m.vector_count - first)
                stored = -(-count // BLOCK) * BLOCK if m.kind == "pairs" else count
                with open(path, "rb") as f:
                    f.seek(m.header_bytes + first * m.bytes_per_vec)
                    data = f.read(stored * m.bytes_per_vec)
                yield found(m, first, count, data)

    parts = max(1, -(-meta.vector_count // ROWS_PER_TASK))
    return spark.range(0, meta.vector_count, ROWS_PER_TASK, parts).mapInArrow(run, schema)


def read(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(row_id, value): the rows of a file, by tasks that each read a range of it. The path must be open to all of them.

    packed: value has a row's bytes (row_bytes) in place of an array.
    """

    def found(m, first, count, data):
        import pyarrow as pa

        rows = decode_rows(m, data, first, count)
        if packed:
            value = column_of(row_bytes(m.kind, rows, m.bits))
        else:
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.int64).reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), value], names=["row_id", "value"])

    return _ranges(spark, path, found, f"row_id long, value {'binary' if packed else 'array<long>'}")


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, fault): every row of a file that breaks the rules of its kind, where read() stops at the first one.

    The header and the length must be right. Tasks check a range each, and only rows with a fault leave them.
    """

    def found(m, first, count, data):
        import pyarrow as pa

        why = _decoded(m, data, count)[1]
        at = np.flatnonzero(why)
        return pa.RecordBatch.from_arrays([pa.array(first + at, pa.int64()), pa.array([FAULTS[i] for i in why[at].tolist()], pa.string())], names=["row_id", "fault"])

    return _ranges(spark, path, found, "row_id long, fault string")


def read_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """(row_id, value) of a file's content held in memory."""
    meta = parse_header(data[:17], len(data))
    rows = decode_rows(meta, data[meta.header_bytes :], 0, meta.vector_count)
    return spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(rows)], "row_id long, value array<long>")


def read_from(spark: SparkSession, stream) -> DataFrame:
    """The same from an open binary stream, which must end where the file does."""
    return read_bytes(spark, stream.read())


def write_to(rows: DataFrame, stream, kind: str, dim: int, bits: int | None = None, n_top: int | None = None) -> int:
    """What write() writes, to an open binary stream; how many bytes."""
    n, at, held = rows.count(), 0, []
    head = header(kind, dim, n, bits, n_top)
    meta = Metadata(kind, VERSION, dim, n, 0, bits, n_top, len(head), 0)
    done = stream.write(head)
    binary = dict(rows.dtypes)["value"] == "binary"

    def flush():
        x = np.array([np.frombuffer(v, np.uint8) for v in held]) if binary else np.array(held)
        return stream.write(encode_rows(kind, rows_of_bytes(kind, x, dim, bits) if binary else x, meta))

    for row_id, value in rows.orderBy("row_id").select("row_id", "value").toLocalIterator(prefetchPartitions=True):
        if row_id != at:
            raise FormatError(GAPS)
        at += 1
        held.append(value)
        if len(held) == BLOCK * 256:
            done += flush()
            held = []
    if held:
        done += flush()
    return done


def _writer(part: str, n: int, head: int, per: int, matrix, encoded):
    """Puts rows, which come sorted, into their places of a file, ROWS_PER_TASK at a time; yields (first, rows) of each piece.

    matrix: the rows of a column; encoded: their bytes in the file.
    """

    def run(batches):
        import pyarrow as pa

        ids, values, block = [], [], None

        def put():
            own, first = np.concatenate(ids), block * ROWS_PER_TASK
            if not np.array_equal(own, np.arange(first, min(first + ROWS_PER_TASK, n))):
                raise FormatError(GAPS)
            with open(part, "r+b") as f:
                f.seek(head + first * per)
                f.write(encoded(np.concatenate(values)))
            return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(own)])], names=["first", "rows"])

        for batch in batches:
            at = batch.column(0).to_numpy()
            if not len(at):
                continue
            x = matrix(batch.column(1))
            edge = [0, *(np.flatnonzero(np.diff(at // ROWS_PER_TASK)) + 1).tolist(), len(at)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if block is not None and at[lo] // ROWS_PER_TASK != block:
                    yield put()
                    ids, values = [], []
                block = int(at[lo] // ROWS_PER_TASK)
                ids.append(at[lo:hi])
                values.append(x[lo:hi])
        if ids:
            yield put()

    return run


def _matrix(width: int | None = None):
    """Array columns without null rows as matrices, of rows as long as width or the first one."""

    def of(column):
        size = np.diff(column.offsets.to_numpy())
        flat = column.values.slice(column.offsets[0].as_py(), int(size.sum()))
        if column.null_count or flat.null_count or (size != (size[0] if width is None else width)).any():
            raise FormatError("rows of a file have one length, and no nulls")
        return flat.to_numpy().reshape(len(column), -1)

    return of


def _placed(rows: DataFrame, path: str, n: int, head: bytes, per: int, size: int, matrix, encoded) -> None:
    """A file of size bytes: head, then n rows (row_id from 0 without gaps, one more column) of per bytes each.

    Every row's place in the file is known, so the file is laid out at its full length and each task writes the pieces of
    ROWS_PER_TASK rows that it has; a piece written again is the same. The file takes its name when all rows are in it.
    """
    import os

    part = path + ".part"
    try:
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(size)
        own = rows.withColumn("row_id", F.col("row_id").cast("long"))
        dealt = own.repartition(F.floor(F.col("row_id") / ROWS_PER_TASK)).sortWithinPartitions("row_id")
        put = dealt.mapInArrow(_writer(part, n, len(head), per, matrix, encoded), "first long, rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if put != n:
            raise FormatError(GAPS)
        os.replace(part, path)
    except BaseException as e:
        if os.path.exists(part):
            os.remove(part)
        if isinstance(e, PySparkException) and GAPS in str(e):
            raise FormatError(GAPS) from e
        raise


def write(rows: DataFrame, path: str, kind: str, dim: int, bits: int | None = None, n_top: int | None = None) -> Metadata:
    """One file of rows (row_id from 0 without gaps, value: an array or packed bytes), written by tasks.

    The path must be open to all tasks; write_to() serves other places.
    """
    import os

    n = rows.count()
    head = header(kind, dim, n, bits, n_top)
    per = {"rank": lambda: RankSpec(dim), "buckets": lambda: BucketSpec(dim, bits), "bitmap": lambda: BitmapSpec(dim, n_top), "sign": lambda: SignSpec(dim), "pairs": lambda: PairScanSpec(dim)}[kind]().bytes_per_vec
    size = len(head) + per * (-(-n // BLOCK) * BLOCK if kind == "pairs" else n)
    binary, meta = dict(rows.dtypes)["value"] == "binary", Metadata(kind, VERSION, dim, n, per, bits, None, len(head), 0)

    def encoded(x):
        return encode_rows(kind, rows_of_bytes(kind, x, dim, bits) if binary else x, meta)

    _placed(rows.select("row_id", "value"), path, n, head, per, size, bytes_of if binary else _matrix(), encoded)
    with open(path, "rb") as f:
        return parse_header(f.read(17), os.path.getsize(path))


def write_npy(rows: DataFrame, path: str, dim: int, vector: str = "embedding") -> None:
    """A two-dimensional float32 .npy file of rows (row_id from 0 without gaps, vector: dim numbers), written by tasks.

    The path must be open to all tasks. A null or a row of another length is an error; of no rows there is a file too.
    """
    import io

    n, held = rows.count(), io.BytesIO()
    np.lib.format.write_array_header_1_0(held, {"descr": "<f4", "fortran_order": False, "shape": (n, dim)})
    head = held.getvalue()
    own = rows.select("row_id", F.col(vector).cast("array<float>").alias("value"))
    _placed(own, path, n, head, 4 * dim, len(head) + 4 * dim * n, _matrix(dim), lambda x: x.astype("<f4").tobytes())


def read_npy(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(row_id, embedding) of a two-dimensional C-ordered float32 .npy file; rows: only so many, from the first."""
    x = np.load(path, mmap_mode="r", allow_pickle=False)
    if x.ndim != 2 or x.dtype != np.dtype("<f4") or not x.flags.c_contiguous:
        raise FormatError("not a two-dimensional float32 array in C order")
    n, dim = x.shape[0] if rows is None else min(rows, x.shape[0]), x.shape[1]

    def run(batches):
        import pyarrow as pa

        own = np.load(path, mmap_mode="r", allow_pickle=False)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                part = np.array(own[first : min(n, first + ROWS_PER_TASK)])
                offsets = np.arange(len(part) + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.reshape(-1)))], names=["row_id", "embedding"])

    return spark.range(0, n, ROWS_PER_TASK, max(1, -(-n // ROWS_PER_TASK))).mapInArrow(run, "row_id long, embedding array<float>")
