import random
import re

import numpy as np
import public_tokenizers

from tessera.llm.queries import op6_token_counts
from tessera.llm.wordpiece import Automaton, marked_vocabulary, token_counts


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_random_vocabularies():
    rng = random.Random(3)
    for _ in range(150):
        make = lambda: {"".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 25))}
        first, inner = make(), make()
        words = ["".join(rng.choices("abcéx", weights=[9, 9, 9, 3, 1], k=rng.randint(1, 14))) for _ in range(60)]
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        found = Automaton(first, inner).counts(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
        assert found.tolist() == [greedy(w, first, inner) for w in words]


def test_query_against_greedy(spark, folder_of, small):
    first, inner = map(set, marked_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:60]
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "漢字 \U0001f600 naïve"), (9004, "a" * 3000), (None, "the end")]
    memo = {}
    for r in op6_token_counts(spark, folder_of(rows)).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", dict(rows)[r.doc_id] or "")
        counts = [memo.setdefault(w, greedy(w, first, inner)) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(max(c, 1) for c in counts), counts.count(0))


def test_empty(spark, docs_of):
    assert token_counts(docs_of([]), ["a"], []).count() == 0
    assert [tuple(r) for r in token_counts(docs_of([(1, "a b")]), [], []).collect()] == [(1, 2, 2, 2)]
