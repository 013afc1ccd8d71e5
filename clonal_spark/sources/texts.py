"""Observations of texts: a source is a tumour, a document a mutation, and the shares of its words that repeat or are long
are two samples. The mixture of a source then tells documents of different making apart, whatever their length, as depth
is the number of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of at least so many characters are long ones.
LONG = 8
SAMPLES = {"long": "long_words", "repeats": "repeats"}


def word_counts(docs: DataFrame, long: int = LONG) -> DataFrame:
    """(tumour_id, mut_id, words, repeats, long_words): words between ASCII white space, those of them that repeat an
    earlier one, and long ones. A null source is ''; rows with the same source and id add up; rows without an id or
    without a word have no counts."""
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.coalesce("source", F.lit("")).alias("tumour_id"), F.col("doc_id").alias("mut_id"), words.alias("ws"))
    one = rows.select(
        "tumour_id", "mut_id", F.size("ws").cast("long").alias("words"),
        (F.size("ws") - F.size(F.array_distinct("ws"))).cast("long").alias("repeats"),
        F.size(F.filter("ws", lambda w: F.length(w) >= long)).cast("long").alias("long_words"),
    )
    return one.groupBy("tumour_id", "mut_id").agg(*[F.sum(c).alias(c) for c in ("words", "repeats", "long_words")]).where("words > 0")


def observations(counts: DataFrame) -> DataFrame:
    """Observations of word counts, dense over both samples."""
    samples = F.explode(F.array(*[F.struct(F.lit(s).alias("sample_id"), F.col(c).cast("double").alias("alt")) for s, c in SAMPLES.items()]))
    rows = counts.select("tumour_id", "mut_id", F.col("words").cast("double").alias("depth"), samples.alias("s"))
    return rows.select("tumour_id", "mut_id", "s.sample_id", "s.alt", "depth", F.lit(1.0).alias("adj"))
