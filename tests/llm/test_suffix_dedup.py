import hashlib
import random
from collections import Counter

from tessera.llm import suffix_dedup
from tessera.llm.queries import op9_suffix_dedup
from tessera.llm.suffix_dedup import span_digests, without_repeats


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + length] for _, r in raw for k in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i is None, i or 0, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def texts(seed):
    rng = random.Random(seed)
    word = lambda k: " ".join(f"{rng.randrange(10**5)}é" for _ in range(k))
    shared = [word(rng.randint(20, 90)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [word(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(4), s[a : rng.randint(a, len(s))])
        rows.append((i, "".join(parts)))
    return rows


def test_against_brute_force(spark, folder_of):
    rows = texts(1)
    rows += [(900, None), (901, ""), (902, "x" * 199), (903, "x" * 200), (904, "y" * 201), (905, "ab" * 400), (906, rows[3][1]), (None, rows[5][1]), (907, rows[7][1] * 2), (908, "line\n" * 300), (908, "line\n" * 300)]
    assert got(op9_suffix_dedup(spark, folder_of(rows))) == brute(rows, 200)


def test_given_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(op9_suffix_dedup(spark, small)) == brute(rows, 200)


def test_kept_texts_and_empty(spark, docs_of):
    rows = [(1, "é" * 150), (2, "a" + "é" * 150), (3, None), (4, "short")]
    kept = {r.doc_id: r.text for r in without_repeats(docs_of(rows)).collect()}
    assert kept == {1: "", 2: "a", 3: None, 4: "short"}
    assert span_digests(docs_of([])).count() == 0 == without_repeats(docs_of([])).count()


def test_hot_string_is_split(spark, docs_of, monkeypatch, tmp_path):
    """A string in most rows with differing text around it: no task gets the segments of all of them."""
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=k))
    hot = word(190)
    rows = [(i, word(150) + hot + word(150)) for i in range(500)]
    rows += [(600 + i, "x" + rows[i][1][100:400] + word(20)) for i in range(10)] + [(700, hot), (701, "1" + hot + "23456789" + hot + "23456789")]
    sort, folder = suffix_dedup._sorted_shard, str(tmp_path)

    def noted(length, memory):
        inner = sort(length, memory)

        def run(batches):
            import tempfile

            held = list(batches)
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as file:
                file.write(str(sum(len(x) for b in held for x in b.column(3).to_pylist())))
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(suffix_dedup, "_sorted_shard", noted)
    bound = 20_000
    spans = suffix_dedup.repeated_spans(docs_of(rows), shard_bytes=bound).collect()
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 2 * bound
    monkeypatch.undo()
    removed = {r.text: sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) for r in spans}
    want = {i: (gone, n) for _, i, _, gone, n, _ in brute(rows, 200)}
    assert {i: removed.get(t, 0) for i, t in rows} == {i: gone for i, (gone, _) in want.items()}
    assert sum(g > 0 for g, _ in want.values()) >= 20
