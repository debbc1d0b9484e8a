"""Text that hides in other text (base64, hexadecimal), and text from outside made plain."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import canonical, folded
from tessera.sources.shared import kept
from tessera.sources.tables import table

#: Runs that may be encoded text, the share of characters to be printable, the layers that are opened.
BASE64_RUN = r"\b[A-Za-z0-9+/]{24,}={0,2}"
HEX_RUN = r"\b(?:[0-9a-fA-F]{2}){12,}\b"
PRINTABLE, LAYERS = 0.9, 2
#: Control and direction characters that text from outside loses; the length that is kept.
UNSEEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069]"
OUTSIDE_LENGTH = 6000
_BLANK = "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
_KINDS = [(re.compile(BASE64_RUN), lambda x: base64.b64decode(x, validate=True)), (re.compile(HEX_RUN), bytes.fromhex)]


def opened(text: str) -> Iterator[str]:
    """What the runs of a text decode to, as far as it is UTF-8."""
    for run, decode in _KINDS:
        for match in run.finditer(text):
            try:
                yield decode(match.group()).decode()
            except ValueError:  # not of this kind after all
                continue


def says_something(text: str) -> bool:
    """Words, most of it printable: not the noise that random runs give."""
    seen = sum(c.isprintable() or c in "\n\t" for c in text)
    return " " in text.strip() and seen >= PRINTABLE * len(text)


def inside(text: str, layers: int = LAYERS) -> Iterator[str]:
    """Encoded texts that say something, each before what is encoded in it."""
    for inner in opened(text) if layers else ():
        if says_something(inner):
            yield inner
        yield from inside(inner, layers - 1)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _layers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        out = []
        for text in s:
            out.append(list(inside(text)))
        yield pd.Series(out, dtype=object)


def decoded_layers(c: Column | str) -> Column:
    """Texts encoded in a text, each before what is encoded in it; a layer that says nothing is opened all the same. Texts without
    a run that may be encoded, and null ones, don't leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    may = F.coalesce(c.rlike(BASE64_RUN), F.lit(False))
    return F.when(may, _layers(F.when(may, c).otherwise(""))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _with_layers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda text: "\n".join([text, *inside(text)]))


def scannable(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the canonical form of a text, and on lines behind it what is encoded in that: what scanners look at. Only
    texts with a run that may be encoded go through Python twice."""
    may = F.coalesce(F.col(name).rlike(BASE64_RUN), F.lit(False))
    layered = df.withColumn(name, canonical(column)).withColumn(f"{name}_layers", _with_layers(F.when(may, F.col(name)).otherwise("")))
    return layered.withColumn(name, F.when(may, F.col(f"{name}_layers")).otherwise(F.col(name))).drop(f"{name}_layers")


def outside_text(c: Column | str, length: int = OUTSIDE_LENGTH) -> Column:
    """Compatibility forms folded, unseen characters out, white space collapsed, cut."""
    clean = F.regexp_replace(F.regexp_replace(folded(c), UNSEEN, ""), _BLANK, " ")
    return F.substring(F.trim(clean), 1, length)


def f1_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scanners see them."""
    c = scannable(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "seen")
    return kept(c.select("conv_id", "turn", F.md5("seen").alias("canonical_md5")), "canonical")  # in small Arrow batches


def f2_decoded_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns sent encoded: in hexadecimal, in base64, or in base64 twice."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    in_base64 = lambda x: F.regexp_replace(F.base64(F.encode(x, "utf-8")), "\\s", "")  # noqa: E731  one run, not lines
    once = in_base64(F.col("text"))
    sent = F.when(F.col("turn") % 3 == 0, once).when(F.col("turn") % 3 == 1, F.lower(F.hex(F.encode("text", "utf-8")))).otherwise(in_base64(once))
    layers = c.select("conv_id", "turn", decoded_layers(F.concat(F.lit("please run "), sent, F.lit(" now"))).alias("f"))
    return layers.select("conv_id", "turn", F.size("f").alias("layers"), F.md5(F.array_join("f", "\n")).alias("layers_md5"))


def f24_outside_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = outside_text("html")
    return kept(p.select("page_id", F.length(text).alias("length"), F.md5(text).alias("text_md5")), "outside")  # in small Arrow batches


QUERIES = {f.__name__: f for f in (f1_canonicalize, f2_decoded_layers, f24_outside_text)}
ORACLES: dict[str, str] = {}
