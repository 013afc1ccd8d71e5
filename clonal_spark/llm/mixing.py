"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size in words. The budget is shared by weight; a source stops at
MAX_EPOCHS times its size and its excess goes to the others by weight, until no target is above its
limit. The fixed point has a closed form: sources ordered by limit / weight are capped up to the
first one whose share of what is left fits, so one window over the sources finds it.

Documents are then taken floor(target / size) times whole. For the rest, documents of a source stand
in a seeded order and are taken once more, until the target is met: the last one in part. Positions in
that order come from two levels of sums (buckets of the order, then within a bucket), so a source that
holds a third of all rows is dealt over BUCKETS tasks.

Defined results: a null source is a source of its own and comes last; a null or empty text has size 0
and is never taken; rows with the same doc_id are documents of their own; an empty table gives no rows;
a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonal_spark.session import Scratch

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 17
#: Hexadecimal digits of the seeded order that name a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, weight, source_size) to (.., target, capped). The windows run over one row per source."""
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("position").asc())
    ranked = sizes.where("source_size > 0").withColumns(
        {
            "budget": F.sum("source_size").over(everything),
            "sum_weight": F.sum("weight").over(everything),
            "sizes_before": F.sum("source_size").over(by_ratio) - F.col("source_size"),
            "weights_before": F.sum("weight").over(by_ratio) - F.col("weight"),
        }
    )
    left = F.col("budget") - MAX_EPOCHS * F.col("sizes_before")
    weight_left = F.col("sum_weight") - F.col("weights_before")
    capped = ranked.withColumn("capped", F.col("weight") * left > MAX_EPOCHS * F.col("source_size") * weight_left)
    level = capped.withColumns(
        {
            "free": F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), MAX_EPOCHS * F.col("source_size"))).over(everything), F.lit(0)),
            "free_weight": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0)),
        }
    )
    share = (F.col("weight") * F.col("free")).cast("double") / F.when(F.col("free_weight") > 0, F.col("free_weight")).cast("double")
    return level.select("source", "capped", F.when(F.col("capped"), (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mixture(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (and the columns of keep)."""
    keep = keep or []
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    rows = docs.select(*[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)], docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), order.alias("place"))
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    if not keep:  # narrow rows are written, so that texts are read once and not for each of the sums
        rows = Scratch(docs.sparkSession, "mixing").write(rows, "rows")
    narrow = rows.select("source", "bucket", "size", "doc_id")
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumns(
        {
            "source_size": F.sum("bucket_size").over(Window.partitionBy("source")),
            "before": F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"),
        }
    )
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    # the weights repeat along the sources' order
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("position") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    sources = sources.withColumn("weight", weight)
    plan = sources.select("source", "source_size").join(targets(sources).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").select("source", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("capped", F.lit(False)).alias("capped"))

    dealt = buckets.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")), "inner").select("b.*", "target", "capped")
    same = F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.bucket") == F.col("d.bucket"))
    inner = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size")
    joined = rows.alias("r").join(dealt.alias("d"), same).select("r.*", "d.source_size", "d.before", "d.target", "d.capped")
    placed = joined.withColumn("start", F.col("before") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    whole = F.when(F.col("capped"), F.lit(MAX_EPOCHS)).when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.when(F.col("capped"), 0).otherwise(F.round("target").cast("long") - whole * F.col("source_size")).cast("long")
    more = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *([] if "doc_id" in keep else ["doc_id"]), *([] if "source" in keep else ["source"]), "size", "source_size", "target", (whole * F.col("size") + more).cast("long").alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with all their columns. Texts stay whole: the one
    document of a source whose last repetition is partial is repeated once more if at least half is taken."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("packed_row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    mixed = mixture(packed, ["packed_row"])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("times", times).where("times > 0").select("packed_row", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("packed_row.*")
