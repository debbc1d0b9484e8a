"""Licence scan with DataFrame functions only: no shuffle, no Python on the executors.

Two cheap gates, then the real work: texts that hold none of the gate's stems give no detection; in the others each rule
is tried only if its own keyword occurs. A rule's matches are non-overlapping, from left to right. A detection is
suppressed if another one of equal or higher priority contains its interval (of equal intervals the higher priority
stays, then the rule listed first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import rules

#: Fixed values of the base scan: phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in texts whose A-Z aren't lower-cased.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How sure a kept detection of each priority makes us; a base phrase counts like a name.
CONFIDENCE = {1: 0.6, 2: 0.85, 3: 0.95}
FOUND = "array<struct<start:int,until:int,rank:int,at:int,label:string,rule:string,priority:int>>"


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _grouped_rules() -> str:
    by_word: dict[str, list[str]] = {}
    for at, r in enumerate(rules()):
        by_word.setdefault(r["keyword"], []).append(f"named_struct('at',{at},'label','{r['label']}','rule','{r['rule']}','priority',{r['priority']},'pattern',{_quoted(r['pattern'])})")
    return "array(" + ",".join(f"named_struct('keyword',{_quoted(k)},'rules',array({','.join(v)}))" for k, v in by_word.items()) + ")"


def _detections(text: str) -> str:
    """SQL: all matches of all rules whose keyword occurs in the column text, as structs in the order of the sweep."""
    tried = f"flatten(transform(filter({_grouped_rules()}, g -> contains({text}, g.keyword)), g -> g.rules))"
    hits = f"filter(transform({tried}, r -> named_struct('r', r, 'hits', regexp_extract_all({text}, r.pattern, 0))), x -> size(x.hits) > 0)"
    parts = f"transform({hits}, x -> named_struct('r', x.r, 'hits', x.hits, 'parts', split({text}, x.r.pattern, -1)))"
    start = "s.pos + length(x.parts[i])"
    each = (
        f"aggregate(sequence(0, size(x.hits) - 1), named_struct('pos', 0, 'found', cast(array() as {FOUND})), (s, i) -> named_struct("
        f"'pos', {start} + length(x.hits[i]), 'found', array_append(s.found, named_struct('start', {start}, 'until', -({start} + length(x.hits[i])), 'rank', -x.r.priority, "
        f"'at', x.r.at, 'label', x.r.label, 'rule', x.r.rule, 'priority', x.r.priority))), s -> s.found)"
    )
    return f"array_sort(flatten(transform({parts}, x -> {each})))"


def _kept(found: str) -> str:
    """SQL: one sweep over detections sorted by start, longest first. e1, e2, e3: how far detections of that priority or a
    higher one reach; those before start no later, so one that reaches as far contains the present one."""
    end = "-d.until"
    reach = ", ".join(f"'e{p}', if(d.priority >= {p}, greatest(s.e{p}, {end}), s.e{p})" for p in (1, 2, 3))
    mine = f"case d.priority when 1 then s.e1 when 2 then s.e2 else s.e3 end >= {end}"
    return (
        f"aggregate({found}, named_struct('e1', -1, 'e2', -1, 'e3', -1, 'kept', cast(array() as {FOUND})), (s, d) -> named_struct({reach}, 'kept', if({mine}, s.kept, array_append(s.kept, d))), "
        "s -> transform(s.kept, d -> named_struct('label', d.label, 'rule', d.rule, 'priority', d.priority, 'start', d.start, 'end', -d.until)))"
    )


def _places(words: str) -> str:
    """SQL: base phrases' places as structs (word, label)."""
    each = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split(" ")
        test = " and ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(parts))
        each.append(f"transform(filter(sequence(0, size({words}) - 1), i -> {test}), i -> named_struct('word', cast(i as bigint), 'label', '{label}'))")
    return f"array_sort(concat({', '.join(each)}))"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id column, n_words long, base array<struct<word long, label>> (places of the base phrases
    in order), detections array<struct<label, rule, priority, start, end>> (kept ones; characters from 0).

    Null texts count as empty, with 0 words and empty arrays. Ids may be null or repeat; rows stay apart, since no row
    meets another. Other columns of docs aren't read. An empty table gives no rows.
    """
    low = F.lower("text")  # only for gates: beyond A-Z it changes no character that a gate looks for, but to add some
    frame = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    gated = frame.withColumn("low", low).select("id", "text", F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), _rule_gate(F.col("low")).alias("rule_gate"), _base_gate(F.col("low")).alias("base_gate"))
    plain = gated.withColumn("plain", F.when(F.col("rule_gate") | F.col("base_gate"), F.translate("text", UPPER, LOWER)))
    words = plain.withColumn("words", F.when(F.col("base_gate"), F.regexp_extract_all("plain", F.lit(WORD), F.lit(0))))
    empty_base, empty_found = "cast(array() as array<struct<word:bigint,label:string>>)", "cast(array() as array<struct<label:string,rule:string,priority:int,start:int,end:int>>)"
    found = words.withColumn("found", F.when(F.col("rule_gate"), F.expr(_detections("plain"))))
    return found.select(
        F.col("id").alias(id_column),
        "n_words",
        F.expr(f"if(base_gate and size(words) > 0, {_places('words')}, {empty_base})").alias("base"),
        F.expr(f"if(rule_gate, {_kept('found')}, {empty_found})").alias("detections"),
    )


#: Each rule's pattern needs one of these strings: from the words of the frames, names and addresses.
RULE_STEMS = ["licen", "spdx", "domain", "commons", "cc0", "wtfpl", "perl", "agreement", "reserved", "evaluation", "confidential", "warrant", ".org", ".com", ".net", ".co/", ".eu/", ".se/", ".info", "mulan", "attribution", "0bsd", "clause", "disclaimer"]
#: Two letters that also stand inside many words: the gate asks for the name of a licence.
CC_BY = r"(?<![0-9a-z])cc[^0-9a-z]{1,4}by(?![0-9a-z])"


def _rule_gate(low: Column) -> Column:
    gate = F.contains(low, F.lit("cc")) & low.rlike(CC_BY)
    for stem in RULE_STEMS:
        gate = gate | F.contains(low, F.lit(stem))
    return gate


def _base_gate(low: Column) -> Column:
    gate = F.lit(False)
    for phrase in BASE_PHRASES:
        every = F.lit(True)
        for word in sorted(phrase.split(" "), key=len, reverse=True):
            every = every & F.contains(low, F.lit(word))
        gate = gate | (every & low.rlike("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+".join(phrase.split(" "))))
    return gate
