"""Best-fit packing of token sequences with a fixed number of open bins.

Each partition tokenises its documents and packs the pieces as they come; nothing is shuffled. A bin (a training
sequence) has `capacity` tokens. A piece goes to the open bin whose free space is the smallest that still holds it. If
none does, a bin is opened; if `open_bins` are open already, the fullest closes first. Open bins are found through a
bitset with one bit for each amount of free space.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of


class OpenBins:
    """Online bounded-space best fit."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask = 0  # bit f: an open bin has f tokens free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to capacity tokens."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._pop(free)
            self.open -= 1
        else:
            if self.open >= self.most:
                self._pop((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
                self.open -= 1
            bin_id, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_id)
            self.mask |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


class Encoder:
    """Ids of a byte-level BPE. The same vocabulary as ranks serves ordinary texts several times faster; texts that hold
    a special token's string go through the tokenizer file itself, which alone knows it."""

    def __init__(self, json_name: str, ranks_name: str | None):
        import public_tokenizers as files
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(files.path(json_name))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_name:
            import tiktoken

            with open(files.path(ranks_name), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_name: str, ranks_name: str | None) -> Encoder:
    """One for each worker process."""
    if (json_name, ranks_name) not in _ENCODERS:
        _ENCODERS[json_name, ranks_name] = Encoder(json_name, ranks_name)
    return _ENCODERS[json_name, ranks_name]


PIECE_COLUMNS = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    open_bins: int = 4096,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the ids.

    Null texts count as empty; an empty text is the end id alone. Rows that share an id are documents of their own.
    Documents of more than capacity tokens are cut from the end into full pieces, so that only the first is shorter.
    Null ids stay null. Other columns of docs aren't read. An empty table gives no rows. A sequence never holds pieces
    of two partitions, so a partition that runs again gives the same sequences.
    """
    frame = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", frame.schema["id"].dataType)] + [T.StructField(n, t) for n, t in PIECE_COLUMNS] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(json_name, ranks_name), OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_of, rows = column_of(batch, "id"), []
            take: list[int] = []
            kept: list[np.ndarray] = []
            for at, text in enumerate(column_of(batch, "text")):
                ids = np.array(encode(text.as_py() or "") + [end_id], "<u4")
                n = len(ids)
                size = n % capacity or capacity
                begin = piece = 0
                while begin < n:
                    part = ids[begin : begin + size]
                    bin_id, offset = bins.place(size)
                    rows.append((piece, begin, size, zlib.crc32(part.tobytes()), first + bin_id, offset))
                    take.append(at)
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    begin, piece, size = begin + size, piece + 1, capacity
            columns = [ids_of.take(pa.array(take, pa.int64()))]
            columns += [pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_column)
