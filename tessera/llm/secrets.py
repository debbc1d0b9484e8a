"""Secrets in whole texts, found through a trigram inverted index (after Cox, 2012).

Each rule's pattern gives a Boolean query: alternatives, each a set of trigrams that every match must hold. Each Arrow batch
of texts is one block of the index: postings list the block's texts for each trigram that any rule asks for. Queries intersect
and unite postings, and only the candidates are matched. Rules without a query (`hex`) match every text. The index is made
of lower-cased bytes, so that it serves patterns of either case. It lives as long as its block: a scan reads each text once,
and a kept index of all trigrams would be larger than the texts.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lowered
from .secret_rules import BASE_RULES, MORE_RULES, Rule

#: Alternatives (of trigram sets, or of strings that stand for a piece of pattern) that analysis keeps apart.
MOST = 64
#: Bytes whose trigrams are looked up at a time, whatever the texts' lengths; temporaries take about 20 bytes for each.
SLICE = 1 << 20
#: A query is a set of alternatives; each is the set of trigrams that must all occur. This one asks for nothing.
ALWAYS = frozenset([frozenset()])
SPANS = "array<struct<kind:string,start:int,end:int>>"

Query = frozenset[frozenset[bytes]]


def either(*queries: Query) -> Query:
    every = frozenset().union(*queries)
    return frozenset(q for q in every if not any(other < q for other in every))


def both(one: Query, other: Query) -> Query:
    """Beyond MOST alternatives the more selective side alone, which asks for less and is still right."""
    if len(one) * len(other) > MOST:
        return min(one, other, key=lambda q: (ALWAYS == q, len(q)))
    return either(frozenset(a | b for a in one for b in other))


def _grams(strings: frozenset[str]) -> Query:
    def of(s: str) -> frozenset[bytes]:
        b = lowered(np.frombuffer(s.encode(), np.uint8)).tobytes()
        return frozenset(b[k : k + 3] for k in range(len(b) - 2))

    return either(frozenset(map(of, strings)))


def _sequence(pieces) -> tuple[frozenset[str] | None, Query]:
    """(all strings that match, or None if they are many; the query)."""
    run, exact, query = frozenset([""]), True, ALWAYS
    for strings, needs in map(_piece, pieces):
        if strings is not None and len(run) * len(strings) <= MOST:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query, exact = both(query, _grams(run)), False
        run = strings if strings is not None else frozenset([""])
        query = both(query, needs)
    return (run, _grams(run)) if exact else (None, both(query, _grams(run)))


def _piece(piece) -> tuple[frozenset[str] | None, Query]:
    kind, value = piece
    if kind == op.LITERAL:
        return frozenset([chr(value)]), ALWAYS
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""]), ALWAYS
    if kind == op.SUBPATTERN:
        return _sequence(value[-1])
    if kind == op.IN:
        if all(k == op.LITERAL for k, _ in value) and len(value) <= 8:
            return frozenset(chr(v) for _, v in value), ALWAYS
        return None, ALWAYS
    if kind == op.BRANCH:
        found = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST:
            return frozenset().union(*(s for s, _ in found)), either(*(q for _, q in found))
        return None, either(*(q for _, q in found))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inside = value
        strings, query = _sequence(inside)
        if strings is not None and (least, most) in ((0, 1), (1, 1)):
            return strings if least else strings | {""}, ALWAYS
        return None, query if least else ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Query:
    """What every match of a pattern (of Python's re) must hold; ALWAYS if that is nothing."""
    return _sequence(parser.parse(pattern))[1]


class BlockIndex:
    """Postings of one block of texts for the trigrams that are asked for."""

    def __init__(self, column: pa.Array, asked: list[bytes], table: np.ndarray):
        self.rows = len(column)
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, wide)[column.offset : column.offset + self.rows + 1].astype(np.int64) if self.rows else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        pairs = [np.zeros(0, np.int64)]
        for begin in range(int(at[0]), int(at[-1]), SLICE):  # texts of any length, slice by slice
            low = lowered(data[begin : min(begin + SLICE + 2, int(at[-1]))]).astype(np.uint32)
            if len(low) < 3:
                break
            grams = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            ids = table[grams]
            hits = np.flatnonzero(ids)
            row = np.searchsorted(at, hits + begin, side="right") - 1
            inside = hits + begin + 2 < at[row + 1]
            pairs.append(np.unique(ids[hits[inside]].astype(np.int64) * self.rows + row[inside]))
        found = np.unique(np.concatenate(pairs))
        cuts = np.searchsorted(found, np.arange(1, len(asked) + 2) * self.rows)
        self.lists = {gram: found[cuts[k] : cuts[k + 1]] - (k + 1) * self.rows for k, gram in enumerate(asked)}

    def candidates(self, query: Query) -> np.ndarray:
        """Rows for which a query holds, ascending."""
        if query == ALWAYS:
            return np.arange(self.rows)
        out = np.zeros(0, np.int64)
        for alternative in query:
            lists = sorted((self.lists[g] for g in alternative), key=len)  # the rarest first
            rows = lists[0]
            for more in lists[1:]:
                if not len(rows):
                    break
                rows = np.intersect1d(rows, more, assume_unique=True)
            out = np.union1d(out, rows)
        return out


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, without those that are too short; code points, end exclusive."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanner(rules: list[Rule]):
    """A function of a binary column: array of (kind, start, end) by start, then kind as listed."""
    patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    asked = sorted(frozenset().union(*(a for q in queries for a in q)))
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << 24, np.uint16)  # number of each trigram that is asked for, 0 for others
        table[[int.from_bytes(g, "big") for g in asked]] = np.arange(1, len(asked) + 1)
        for column in columns:
            if column.null_count:
                column = column.fill_null(b"")
            index = BlockIndex(column, asked, table)
            hits: dict[int, list[tuple[int, int, int]]] = {}
            texts: dict[int, str] = {}  # of candidates, decoded once
            for number, (rule, compiled, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                for row in index.candidates(query).tolist():
                    text = texts.get(row)
                    if text is None:
                        text = column[row].as_py().decode("utf-8", "replace")
                        if query != ALWAYS:
                            texts[row] = text
                    if found := spans_of(text, rule, compiled):
                        hits.setdefault(row, []).extend((start, number, end) for start, end in found)
            yield pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(hits.get(row, ()))] for row in range(index.rows)], kinds)

    return F.arrow_udf(scan, SPANS).asNondeterministic()  # no filter on the result runs it again


def with_secrets(docs: DataFrame, text_column: str = "text", rules: list[Rule] | None = None, result: str = "secrets") -> DataFrame:
    """docs with one more column, the last one: array<struct<kind, start, end>>, the spans of secrets in code points, by
    start, then kind as listed, then end. It is called `result`, with underscores behind it where docs has such a column.

    Null and empty texts have none; bytes that are no UTF-8 count as one replacement character each. Rows that repeat an id or
    a text are scanned each on its own, ids aren't read. Kinds may overlap one another, spans of one kind don't. Whole texts are
    scanned; a very long one takes its own size in memory, and is indexed slice by slice. An empty table gives no rows.
    """
    text: Column = F.col("`" + text_column.replace("`", "``") + "`").cast("string").cast("binary")
    return docs.withColumn(free_name(docs, result), scanner(rules if rules is not None else BASE_RULES + MORE_RULES)(text))
