"""Which texts hold a literal string, by an index of three-character strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agentlake.sources.staging import staged

#: Strings of a needle that are looked up at most; any of them is in every text that holds the needle, so fewer lose nothing.
PROBES = 8


def grams(text: Column) -> Column:
    """All strings of three characters, in order."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))


def containing(needles: DataFrame, hay: DataFrame, needle_key: str, hay_key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(needle_key, hay_key) where ``text`` of ``hay`` holds ``needle``, among equal values of ``by``; empty needles are in no text.

    Texts meet a needle by the rarest of up to ``PROBES`` of its three-character strings, and only those that have it are searched.
    A needle of one or two characters is looked up as it is: texts are also indexed by the begins of their strings, and
    two marks at their end let the last characters begin one.
    """
    asked = needles.where("needle <> ''").select(needle_key, *by, "needle")
    probes = F.when(F.length("needle") < 3, F.array("needle")).otherwise(F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(grams(F.col("needle"))), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), lambda x: x["g"]), 1, PROBES))
    pieces = asked.select(needle_key, *by, F.explode(probes).alias("gram"))
    three = grams(F.concat("text", F.lit("\0\0")))
    # The lists of whole texts are made once: a projection of their own.
    indexed = hay.where(F.col("text") != "").select(hay_key, *by, F.array_distinct(three).alias("three"))
    short = lambda n: F.array_distinct(F.transform("three", lambda g: F.substring(g, 1, n)))
    found = staged(indexed.select(hay_key, *by, F.explode(F.concat("three", short(1), short(2))).alias("gram")).join(pieces.select(*by, "gram").distinct(), [*by, "gram"], "left_semi"))
    counts = found.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("texts"))
    rarest = pieces.join(counts, [*by, "gram"]).groupBy(needle_key, *by).agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count(F.lit(1)).alias("known"))
    # A needle with a string that no text has is in no text.
    whole = pieces.groupBy(needle_key, *by).agg(F.count(F.lit(1)).alias("known")).join(rarest, [needle_key, *by, "known"])
    pairs = whole.join(found, [*by, "gram"]).select(needle_key, hay_key, *by)
    held = pairs.join(asked, [needle_key, *by]).join(hay.select(hay_key, *by, "text"), [hay_key, *by])
    return held.where(F.contains("text", "needle")).select(needle_key, hay_key)
