import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.packing import OpenBins, pack_documents
from tessera.llm.queries import op10_best_fit_packing


def check(rows, pieces, capacity):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_id = {}
    for p in pieces:
        by_id.setdefault(p.doc_id, []).append(p)
    for i, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted(by_id[i], key=lambda p: p.piece)
        assert [p.piece for p in mine] == list(range(len(mine)))
        assert sum(p.length for p in mine) == len(ids) and (len(ids) > capacity or len(mine) == 1)
        assert all(p.length == capacity for p in mine[1:])
        for p in mine:
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_and_layout(spark, folder_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(90_001, None), (90_002, ""), (90_003, "a <|endoftext|> b"), (90_004, "x" * 50_000), (90_005, "é ퟿\U0001f600" * 3000)]
    pieces = op10_best_fit_packing(spark, folder_of(rows)).collect()
    used = check(rows, pieces, 2048)
    assert used <= 1.05 * sum(p.length for p in pieces) / 2048 + 8


def test_bounded_space_places_in_the_fullest_that_fits():
    bins = OpenBins(10, 2)
    assert [bins.place(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = OpenBins(10, 2)
    assert [bins.place(x) for x in (5, 6, 9, 5, 1)] == [(0, 0), (1, 0), (2, 0), (0, 5), (2, 9)]  # bin 1 was the fullest and closed


def test_edges(spark, docs_of):
    assert pack_documents(docs_of([])).count() == 0
    got = pack_documents(docs_of([(1, "a"), (1, "a"), (None, None)]), with_ids=True).collect()
    assert len(got) == 3 and sorted(len(r.ids) for r in got) == [1, 2, 2]
