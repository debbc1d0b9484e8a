import re

from tessera.llm.licenses import BASE_PHRASES, scan_licenses
from tessera.llm.license_rules import rules
from tessera.llm.queries import op4_license_scan

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """Every rule on every text, no gates; containment by comparing all pairs."""
    low = (text or "").translate(AZ)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = sorted((i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = [(m.start(), m.end(), r["priority"], at, r["label"]) for at, r in enumerate(rules()) for m in re.finditer(r["pattern"], low, re.ASCII)]
    kept = []
    for d in found:
        over = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]]
        if not any((e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3]) for e in over):
            kept.append(d)
    return len(words), base, sorted((d[0], d[1], d[4]) for d in kept)


TEXTS = [
    None,
    "",
    "   ",
    "Licensed under the Apache License, Version 2.0 (see https://www.apache.org/licenses/LICENSE-2.0).",
    "SPDX-License-Identifier: MIT\nsome code",
    "GNU General Public License v3 or later. Released under the terms of the GNU General Public License, version 2",
    "CC BY-SA 4.0 and cc-by 4.0; Creative-Commons Attribution-ShareAlike 4.0 International",
    "zero-clause BSD; the MIT License; mit license mit license",
    "İstanbul K MITK license ÉCC BY été apache---LICENSE",
    "All rights reserved. Confidential and proprietary. in the public domain, without warranties of any kind",
    "The eclipse was fully licensed, mozilla.org says nothing " * 50,
    "apache license " * 500,
]


def test_matches_brute_force(spark, docs_of, small):
    sample = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(10_000 + i, t) for i, t in enumerate(TEXTS)] + sample
    got = {r.doc_id: r for r in scan_licenses(docs_of(rows)).collect()}
    for i, text in rows:
        n, base, kept = brute(text)
        r = got[i]
        assert r.n_words == n
        assert [(x.word, x.label) for x in r.base] == base
        assert sorted((d.start, d.end, d.label) for d in r.detections) == kept, text
    assert len(rules()) > 200


def test_query_digests(spark, folder_of):
    got = {r.doc_id: r for r in op4_license_scan(spark, folder_of([(1, TEXTS[3]), (2, None), (2, "mit license"), (None, "x")])).collect() if r.doc_id != 2}
    assert got[1].base_labels == "apache" and got[1].labels == "apache,apache-2.0" and got[1].first_word == 3
    assert got[None].n_base == 0 and got[None].first_word is None and got[None].score == 0.0


def test_empty_table(spark, folder_of):
    assert op4_license_scan(spark, folder_of([])).count() == 0


def test_no_python_in_plan(spark, folder_of):
    plan = op4_license_scan(spark, folder_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
