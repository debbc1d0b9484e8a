"""Exact substring dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

1. Anchors. Of each window of `length` bytes the leftmost least of the hashes of its `gram`-byte strings is an anchor: equal
   windows have equal anchors, so a window whose anchor hash occurs once is unique. Consecutive windows share anchors, so
   there are few. Only texts with anchors that occur again are read further; equal texts are one.
2. Segments. The windows of an anchor with the bytes they cover are a segment; equal segments are one, with a count. All
   windows of a segment that occurs twice are repeated.
3. Shards. Segments are dealt by anchor hash, so equal windows meet. Each shard sorts the suffixes of its segments by
   induction (induced.py: blocks of tuples in priority order) and takes neighbours with a common prefix of `length` bytes.
   A shard is sorted in memory, so no anchor may bring more than shard_bytes: the segments of a larger one are cut into the
   segments of longer strings within their windows (equal windows have equal ones), in the end of whole windows, of which
   equal ones are one and none is sorted.
4. The windows' spans go back to the texts and are merged.

No step gathers a group of copies: copies are counted by partial sums, and their segments collapse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_columns, column_of, cut, drop_cut, every_span_hash, free_name, mix, powers, prefix_hash, sized, span_hash, text_chunks
from .induced import repeated_windows

SALT = np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows of one anchor hash that a join may bring to one task; hashes with more are joined apart, without a shuffle by hash.
HOT_ROWS = 20_000


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor's place in data, its hash, first and last window start it stands for), all places in data."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none, none
    prefix = prefix_hash(data)
    hashes = every_span_hash(prefix, gram)
    least = sliding_least((hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), width)
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # leftmost among equals
    start = np.arange(len(place))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    fits = start <= np.repeat(offsets[1:] - length, np.diff(offsets))[: len(place)]
    start, place, row = start[fits], place[fits], row[fits]
    if not len(start):
        return none, none, none.astype(np.uint64), none, none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], place[first], hashes[place[first]], start[first], start[last]


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = column_of(batch, "t1"), column_of(batch, "t2")
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                owner, place, hashes, low, high = anchors(data, offsets, length, gram)
                base = offsets[owner]
                packed = (place - base) << 20 | (place - low) << 10 | (place - high)
                take = pa.array(owner + row)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), t1.take(take), t2.take(take), pa.array(packed)], names=["h", "t1", "t2", "x"])

    return run


def _digests(data: np.ndarray, low: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each data[low:end]."""
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + SALT) * powers(len(data), 0xD6E8FEB86659FD93, "second"))])
    d2 = mix((other[end] - other[low]) * powers(len(other), pow(0xD6E8FEB86659FD93, -1, 1 << 64), "second down")[low])
    return span_hash(prefix_hash(data) if prefix is None else prefix, low, end), d2


def _segment_rows(length: int, gram: int):
    """Segments of the wanted anchors x of each text: anchor hash, two digests, bytes, where its first window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, wanted = column_of(batch, "t1"), column_of(batch, "t2"), column_of(batch, "xs")
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                lists = [np.sort(wanted[row + k].values.to_numpy()) for k in range(len(offsets) - 1)]
                owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                x = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
                place = (x >> 20) + offsets[owner]
                low, high = place - (x >> 10 & 1023), place - (x & 1023)
                prefix = prefix_hash(data)
                end = high + length
                h = span_hash(prefix, place, place + gram)
                d1, d2 = _digests(data, low, end, prefix)
                raw = data.tobytes()
                bodies = [raw[a:b] for a, b in zip(low.tolist(), end.tolist(), strict=True)]
                take = pa.array(owner + row)
                columns = [pa.array(h.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(bodies, pa.binary()), t1.take(take), t2.take(take), pa.array(low - offsets[owner])]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "d1", "d2", "body", "t1", "t2", "low"])

    return run


def _finer_rows(length: int, gram: int):
    """The segments, by strings of `gram` bytes, of segments: a key out of both anchors, two digests, bytes, whose part it is
    (p, q1, q2), where it starts in that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents = [column_of(batch, x) for x in ("h", "d1", "d2")]
            for row, data, offsets in text_chunks(column_of(batch, "body")):
                owner, _, hashes, low, high = anchors(data, offsets, length, gram)
                end = high + length
                take = pa.array(owner + row)
                p, q1, q2 = [x.take(take) for x in parents]
                h = mix(hashes ^ mix(p.to_numpy().astype(np.int64).view(np.uint64) + SALT))
                d1, d2 = _digests(data, low, end)
                raw = data.tobytes()
                bodies = [raw[a:b] for a, b in zip(low.tolist(), end.tolist(), strict=True)]
                columns = [pa.array(h.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(bodies, pa.binary()), p, q1, q2, pa.array(low - offsets[owner])]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "d1", "d2", "body", "p", "q1", "q2", "low"])

    return run


def _sorted_shard(length: int, memory: int):
    """One shard: repeated runs of windows (a, b) of each of its segments that occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes, keys = [], [], []
        for batch in batches:
            for _, data, offsets in text_chunks(column_of(batch, "body"), 1 << 24):
                parts.append(data.copy())
                sizes.append(np.diff(offsets))
            keys.append(batch.select(["h", "d1", "d2"]))
        if not parts:
            return
        size = np.concatenate(sizes)
        stop = np.cumsum(size + 1)
        start = stop - size - 1
        text = np.zeros(int(stop[-1]), np.uint16)  # 0 between segments, bytes from 1
        inside = np.ones(len(text), bool)
        inside[stop - 1] = False
        text[inside] = np.concatenate(parts)
        text[inside] += 1
        del parts
        change = np.zeros(len(text) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + size - length + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        again = repeated_windows(text, valid, length, memory)
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(stop, first, side="right")
        table = pa.Table.from_batches(keys).take(pa.array(owner)).append_column("a", pa.array(first - start[owner])).append_column("b", pa.array(last - start[owner]))
        yield from table.to_batches()

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], np.append(e[:-1][new[1:]], e[-1])


def kept_bytes(raw: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _repeated_runs(one: DataFrame, length: int, finer: tuple[int, ...], shard_bytes: int, memory: int) -> DataFrame:
    """(h, d1, d2, a, b): repeated runs of windows of each different segment. one: h, d1, d2, body, c (how often)."""
    groups = cut(one.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")).where("n > 1"))
    large = groups.where(F.col("bytes") > shard_bytes).select("h") if finer else groups.limit(0).select("h")
    split = finer and not large.isEmpty()
    small, left = groups.where(F.col("bytes") <= shard_bytes) if finer else groups, one
    if split:
        large = F.broadcast(large)  # each stands for shard_bytes or more
        left = one.join(large, "h", "left_anti")
    total = small.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    windows = F.octet_length("body") - length + 1
    sorted_ones = left.join(small.select("h"), "h", "left_semi").select("h", "d1", "d2", "body")
    runs = sorted_ones.repartition(shards, "h").mapInArrow(_sorted_shard(length, memory), "h long, d1 long, d2 long, a long, b long")
    runs = cut(runs.unionByName(one.where("c > 1").select("h", "d1", "d2", F.lit(0).cast("long").alias("a"), windows.cast("long").alias("b"))))
    if split:
        schema = "h long, d1 long, d2 long, body binary, p long, q1 long, q2 long, low long"
        parts = cut(one.join(large, "h", "left_semi").select("h", "d1", "d2", "body").mapInArrow(_finer_rows(length, finer[0]), schema))
        fine = cut(parts.groupBy("h", "d1", "d2").agg(F.first("body").alias("body"), F.count("*").alias("c")))
        found = _repeated_runs(fine, length, finer[1:], shard_bytes, memory)
        back = parts.select("h", "d1", "d2", "p", "q1", "q2", "low").join(found, ["h", "d1", "d2"])
        whole = cut(runs.unionByName(back.select(F.col("p").alias("h"), F.col("q1").alias("d1"), F.col("q2").alias("d2"), (F.col("low") + F.col("a")).alias("a"), (F.col("low") + F.col("b")).alias("b"))))
        drop_cut(runs, parts, fine, found)
        runs = whole
    drop_cut(groups)
    return runs


def _repeated(frame: DataFrame) -> DataFrame:
    """The rows of frame whose h stands in two rows or more."""
    twice = cut(frame.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    hot = twice.where(F.col("c") > HOT_ROWS).select("h")
    if hot.isEmpty():
        return frame.join(twice.select("h"), "h", "left_semi")
    hot = sized(hot)  # one for each HOT_ROWS rows at most
    return frame.join(hot, "h", "left_semi").unionByName(frame.join(hot, "h", "left_anti").join(twice.where(F.col("c") <= HOT_ROWS).select("h"), "h", "left_semi"))


def repeated_spans(docs: DataFrame, text_column: str = "text", length: int = 200, gram: int = 96, shard_bytes: int = 1_000_000, memory: int = 1 << 27, kept: str = "") -> DataFrame:
    """(t1, t2, text, copies, starts, ends, kept) for each different text that has repeated spans: maximal runs of bytes to
    remove, and what is left: with kept "sha256" its digest, with "text" the text but for the parts of characters that a
    span's edges cut, else null. (t1, t2) is text_key(text). A text of `length` bytes or more that occurs twice is removed whole. length: from
    gram to 1023."""
    if not gram <= length <= 1023:
        raise ValueError("length must be between gram and 1023: anchor rows hold it in ten bits")
    base = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).select(*text_key("text"), "text")
    found = cut(base.mapInArrow(_anchor_rows(length, gram), "h long, t1 long, t2 long, x long"))
    met = cut(_repeated(found).distinct())
    drop_cut(found)
    wanted = _repeated(met).groupBy("t1", "t2").agg(F.collect_list("x").alias("xs"))
    long_enough = base.where(F.octet_length("text") >= length)
    copies = long_enough.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    several = copies.where("copies > 1").withColumn("whole", F.lit(True))
    need = wanted.join(several, ["t1", "t2"], "full")
    texts = long_enough.join(need, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("xs").alias("xs"), F.first("copies").alias("copies"), F.first("whole").alias("whole"))
    texts = cut(texts)
    drop_cut(met)

    segments = cut(texts.where("xs is not null").select("t1", "t2", "text", "xs").mapInArrow(_segment_rows(length, gram), "h long, d1 long, d2 long, body binary, t1 long, t2 long, low long"))
    one = cut(segments.groupBy("h", "d1", "d2").agg(F.first("body").alias("body"), F.count("*").alias("c")))
    runs = _repeated_runs(one, length, tuple(g for g in (length * 4 // 5, length) if g > gram), shard_bytes, memory)
    drop_cut(one)
    spans = segments.select("h", "d1", "d2", "t1", "t2", "low").join(runs, ["h", "d1", "d2"]).select("t1", "t2", (F.col("low") + F.col("a")).alias("s"), (F.col("low") + F.col("b") + length - 1).alias("e"))
    lists = cut(spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    drop_cut(segments, runs)
    out = texts.drop("xs").join(lists, ["t1", "t2"], "left").where("whole or spans is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, left = [], [], []
            for size, whole, spans, text in zip(column_of(batch, "n").to_pylist(), column_of(batch, "whole").to_pylist(), column_of(batch, "spans"), column_of(batch, "text"), strict=True):
                if whole:
                    s, e = np.array([0]), np.array([size])
                else:
                    s, e = merged(spans.values.field("s").to_numpy(), spans.values.field("e").to_numpy())
                starts.append(s)
                ends.append(e)
                left.append(_left(text.as_py().encode(), s.tolist(), e.tolist(), kept) if kept else None)
            kind = pa.list_(pa.int64())
            columns = [column_of(batch, x) for x in ("t1", "t2", "text", "copies")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, kind), pa.array(ends, kind), pa.array(left, pa.string())], names=["t1", "t2", "text", "copies", "starts", "ends", "kept"])

    with_size = out.withColumn("n", F.octet_length("text").cast("long")).select("t1", "t2", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n", "whole", "spans")
    return with_size.mapInArrow(run, "t1 long, t2 long, text string, copies long, starts array<long>, ends array<long>, kept string")


def text_key(column: str):
    """128 bits that name a text."""
    return F.xxhash64(column).alias("t1"), F.xxhash64(F.col(column), F.lit(1)).alias("t2")


def _left(raw: bytes, starts: list[int], ends: list[int], kind: str) -> str:
    if kind == "sha256":
        return hashlib.sha256(kept_bytes(raw, starts, ends)).hexdigest()
    whole = [whole_characters(raw, a, b) for a, b in zip(starts, ends, strict=True)]
    return kept_bytes(raw, *zip(*whole, strict=True)).decode()


def span_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200) -> DataFrame:
    """One row per row of docs: the id column, n_bytes, n_removed, n_spans longs, kept_sha256.

    Null texts count as empty: 0 bytes, nothing removed. Texts shorter than `length` keep all. Ids may be null or repeat;
    rows with equal texts have equal results. Other columns aren't read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", *text_key("text"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    found = repeated_spans(docs, text_column, length, kept="sha256")
    removed = F.expr("aggregate(zip_with(ends, starts, (e, s) -> e - s), 0L, (a, x) -> a + x)")
    found = found.select("t1", "t2", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept")
    out = rows.join(cut(found), ["t1", "t2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_column), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text_column: str = "text", length: int = 200) -> DataFrame:
    """docs with all repeated spans taken out of the text; a character that a span's edge would cut stays. Null texts stay
    null. All columns and rows stay, whatever their names; what depends on the text, such as a length, is the caller's.
    Rows with equal texts, and rows that repeat an id, have equal and each their own results. An empty table stays empty."""
    found = repeated_spans(docs, text_column, length, kept="text")
    plain, one, two, kept = (free_name(docs, x) for x in ("__text", "__t1", "__t2", "__kept"))
    cut_texts = cut(found.select(F.col("t1").alias(one), F.col("t2").alias(two), F.col("kept").alias(kept)))
    t1, t2 = text_key(plain)
    text = F.col("`" + text_column.replace("`", "``") + "`").cast("string")
    out = docs.withColumn(plain, F.coalesce(text, F.lit(""))).withColumns({one: t1, two: t2}).join(cut_texts, [one, two], "left")
    new = F.coalesce(F.col(kept), text).alias(text_column)
    return out.select(*[new if name == text_column else c for name, c in zip(docs.columns, all_columns(docs), strict=True)])
