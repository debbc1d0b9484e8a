"""Pieces that the operators of this package share: shared-folder tables, Arrow text batches, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step handles; temporaries take about 80 bytes for each of them.
STEP_BYTES = 1 << 18


#: Rows of an Arrow batch while a table is written: 10 000 rows, Spark's default, of whole texts take tens of megabytes in the
#: JVM and in the worker of each task.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and everything
    runs on this machine. On a cluster an unset folder is an error: each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def drop_cut(*frames: DataFrame | None) -> None:
    """Delete tables that cut() wrote and that no later step reads."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all columns of docs (upper and lower case alike)."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def all_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def sized(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """df, to be broadcast if it has most_rows rows at most; beyond that joins shuffle. df should be cheap to count."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A pseudo-random odd value for each byte; sums of powers over them hash a word.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:  # doubles what is known
            step = np.uint64(pow(base, done, 1 << 64))
            more = min(done, size - done)
            out[done : done + more] = out[:more] * step
            done += more
        _POWERS[name] = have = out
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H[i]: hash of data[:i]; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data), BASE, "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    down = powers(len(prefix), BASE_INVERSE, "down")
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def every_span_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """span_hash of data[i : i + size] for every i."""
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:-size]) * powers(len(prefix), BASE_INVERSE, "down")[:n] + np.uint64(size))


def text_chunks(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of a string or binary column; null counts as empty. No text is cut:
    a chunk holds one row at least, however long."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1
        last = min(n, max(last, row + 1))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_ALNUM[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def word_spans(low: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row). kind "space": runs without ASCII white space; kind "alnum": runs of
    a-z, 0-9 and non-ASCII bytes. Words never cross rows."""
    inside = ~_SPACE[low] if kind == "space" else _ALNUM[low]
    n = len(low)
    begins = np.zeros(n + 1, bool)
    begins[:n] = inside
    begins[1:n] &= ~inside[:-1] if n else False
    stops = np.zeros(n + 1, bool)
    stops[1:] = inside
    stops[1:n] &= ~inside[1:] if n else False
    edge = offsets[(offsets > 0) & (offsets < n)]  # two words that only a row's end parts
    edge = edge[inside[edge] & inside[edge - 1]]
    begins[edge] = True
    stops[edge] = True
    starts, ends = np.flatnonzero(begins[:n]), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words before each row, starts, ends)."""
    low = lowered(data)
    starts, ends, before = word_spans(low, offsets, kind)
    return span_hash(prefix_hash(low), starts, ends), before, starts, ends


def shingle_hashes(words: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingles before each row): runs of n words; a row with fewer words, but one at least, gives
    its whole sequence as one shingle."""
    total = len(words)
    counts = np.diff(before)
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    after = np.concatenate([[0], np.cumsum(have)])
    if total == 0:
        return np.zeros(0, np.uint64), after
    factor = [np.uint64(pow(BASE, k + 1, 1 << 64)) for k in range(n)]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    rows = np.repeat(np.arange(len(counts)), have)
    at = np.arange(int(after[-1])) - after[rows] + before[rows]
    length = np.minimum(counts[rows], n)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += np.where(length > k, padded[at + k] * factor[k], np.uint64(0))
    return mix(out + length.astype(np.uint64)), after


def distinct_by_row(values: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, and how many come before each row."""
    rows = np.repeat(np.arange(len(after) - 1), np.diff(after))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(after)))


def long_lists(values: np.ndarray, after: np.ndarray) -> pa.Array:
    """A list<int64> column out of flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(after.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
