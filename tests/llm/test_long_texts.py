"""Texts beyond one vectorised step (STEP_BYTES), held against the brute-force versions of each operator's own test."""

import random
import re
import zlib

import pytest
import public_tokenizers

from tessera.llm.common import STEP_BYTES
from tessera.llm.queries import op1_balanced_label_propagation, op2_paragraph_minhash, op4_license_scan, op5_simhash_decontamination, op6_token_counts, op8_ngram_join, op9_suffix_dedup
from tessera.llm.wordpiece import marked_vocabulary
from tests.llm import test_decontaminate, test_licenses, test_paragraphs, test_suffix_dedup, test_wordpiece


def words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice(['un', 're', 'de'])}{rng.randrange(10**4)}é" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Two near copies and a stranger beyond one step, one that ends in what stands elsewhere, and short ones around them."""
    base = words(1, 36_000)
    near = [*base]
    for k in range(0, len(near), 400):
        near[k] = "changed"
    passage = words(3, 60)
    other = words(2, 36_000) + passage
    lines = lambda w: "\n".join(" ".join(w[k : k + 300]) for k in range(0, len(w), 300))
    out = [(1, lines(base)), (2, "short"), (3, lines(near)), (4, lines(other) + " mit license"), (5, None), (6, " ".join(passage) + " and more"), (7, lines(base)), (8, "x" * (STEP_BYTES + 5))]
    assert sum(len((t or "").encode()) > STEP_BYTES for _, t in out) == 5
    return out


def test_sharding(spark, folder_of, rows):
    got = {r.doc_id: r for r in op1_balanced_label_propagation(spark, folder_of(rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        assert got[i].size == len(raw) + 8 and got[i].text_crc32 == zlib.crc32(raw)
    assert sorted(r.slot for r in got.values() if r.shard == got[1].shard) == list(range(sum(r.shard == got[1].shard for r in got.values())))


def test_paragraphs_of_long_texts(spark, folder_of, rows):
    some = [(i, t) for i, t in rows if i != 8]
    assert test_paragraphs.got(op2_paragraph_minhash(spark, folder_of(some))) == test_paragraphs.brute(some, least=1)


def test_licenses_at_the_end(spark, folder_of, rows):
    got = {r.doc_id: r for r in op4_license_scan(spark, folder_of(rows)).collect()}
    for i, t in rows:
        n, base, _ = test_licenses.brute(t)
        assert (got[i].n_words, got[i].n_base, got[i].last_word) == (n, len(base), base[-1][0] if base else None)
    assert got[4].base_labels == "mit"


def test_contamination_at_the_end(spark, folder_of, rows):
    items = spark.createDataFrame([(1, " ".join(words(3, 60))), (2, " ".join(words(9, 60)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.start_word for r in op5_simhash_decontamination(spark, folder_of(rows, benchmark=items)).collect()}
    assert set(got) == {(4, 1), (6, 1)}
    text = dict(rows)[4]
    assert got[4, 1] == len(test_decontaminate.words_of(text[: text.rindex(" ".join(words(3, 60))[:12])]))


def test_token_counts(spark, folder_of, rows):
    first, inner = map(set, marked_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    memo = {}
    some = [(i, t) for i, t in rows if i != 8]
    for r in op6_token_counts(spark, folder_of(some)).collect():
        have = re.findall(r"[^\x20\x09-\x0D]+", dict(some)[r.doc_id] or "")
        counts = [memo.setdefault(w, test_wordpiece.greedy(w, first, inner)) for w in have]
        assert (r.n_words, r.n_tokens) == (len(have), sum(max(c, 1) for c in counts))


def test_ngram_join(spark, folder_of, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_join(spark, folder_of(rows)).collect()}
    shingles = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        shingles[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    assert {i: n for i, (n, _) in got.items()} == {i: len(s) for i, s in shingles.items()}
    similar = len(shingles[1] & shingles[3]) / len(shingles[1] | shingles[3])
    assert similar >= 0.9 and {i: c for i, (_, c) in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1, 8: 8}


def test_repeated_passages(spark, folder_of, rows):
    some = [(i, t) for i, t in rows if i != 8]
    assert test_suffix_dedup.got(op9_suffix_dedup(spark, folder_of(some))) == test_suffix_dedup.brute(some, 200)


def test_nothing_but_empty_texts(spark, folder_of):
    empty = [(1, None), (2, ""), (3, None)]
    assert op2_paragraph_minhash(spark, folder_of(empty)).count() == 0
    assert {r.component_id for r in op8_ngram_join(spark, folder_of(empty)).collect()} == {1, 2, 3}
    assert {(r.n_bytes, r.n_removed) for r in op9_suffix_dedup(spark, folder_of(empty)).collect()} == {(0, 0)}
    assert op1_balanced_label_propagation(spark, folder_of(empty)).count() == op4_license_scan(spark, folder_of(empty)).count() == op6_token_counts(spark, folder_of(empty)).count() == 3
