"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, most: float = 3.0) -> DataFrame:
    """(source, size, target) from one row per source.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target stops at
    ``most`` times its source's size; what is above is shared again by weight among the others until none is above.
    That is one water level: sources ordered by size / weight stop first, the level is found from running sums.
    One row per source, so the running sums are small however many rows the sources have.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    w = sizes.withColumn("_w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    by_level = Window.orderBy(F.col(size) / F.col("_w"), F.col(source).isNull(), F.col(source).cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("_left", F.sum(size).over(every) - most * F.coalesce(F.sum(size).over(before), F.lit(0)))
    w = w.withColumn("_weight", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    w = w.withColumn("_level", F.when(F.col("_left") * F.col("_w") <= most * F.col(size) * F.col("_weight"), F.col("_left") / F.col("_weight")))
    w = w.withColumn("_level", F.max("_level").over(every))
    return w.select(source, size, F.least(F.col("_level") * F.col("_w"), (most * F.col(size)).cast("double")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, seed: str = "mix") -> DataFrame:
    """``df`` with size, source_size, target, rate and copies: how many times the mix takes each row.

    copies is floor(rate) plus one if a hash of seed, id, size and source, as a number in [0, 1), is below the fraction;
    the same rows give the same copies on every run. Null texts and empty ones have size 0 and a source whose
    sizes are all 0 has target 0. Repeated rows get the same copies. An empty table gives an empty result. The columns of ``df``
    stay, but those with the five new names are replaced. The table of sources is broadcast only by Spark's own size check; a source
    that holds most rows costs nothing extra, since sizes are summed before the shuffle.
    """
    own = {"size", "source_size", "target", "rate", "copies"} - {id_col, text_col, source_col}
    sized = df.drop(*own).withColumn("size", words(F.col(text_col)))
    per = targets(sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("source_size")), "_source", "source_size", most)
    out = sized.join(per, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("size").cast("string"), F.coalesce(F.col(source_col), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = out.withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as :func:`mix` says, with the columns of ``df`` as they were."""
    packed = df.select(F.struct(*df.columns).alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    out = mix(packed, "id", "text", "source", **options)
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
