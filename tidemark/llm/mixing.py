"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Size of a document is its number of words. Every source aims at its weight's share of all words.
A source whose share is above `max_epochs` times its own words is clamped there, and what it cannot
take is reshared among the others by weight, again and again, until no source is above its cap.
A source then repeats every document `floor(target / source_size)` whole times; the remaining words
are a seeded sample: documents in the order of a hash of their id, each taken once more until the
quota is met, the last one with a fraction of its words.

All sources of one size class are treated alike at every size: sums per source are pre-aggregated,
the seeded order of a source is found in 4096 hash ranges of which only the one that holds the cut
is sorted, and documents meet a table of one row per source.

Nulls: text null has size 0; source null is a source of its own, weighed last; doc_id null hashes
as empty text. Rows that tie in the seeded order at the cut share what is left in proportion to
size. Documents without words take 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: str = "doc_id") -> Column:
    """Place of a document in the seeded order: md5 of its id as text."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources in order of code points, null last, weighed in turn.

    The order is found in ranges: rows are numbered inside each range, and ranges, one row per
    partition, are summed up; no task sees all sources."""
    ranged = written(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
            "range", F.spark_partition_id()
        ),
        "mix-ranges",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range")
        .agg(F.count("*").alias("rows"))
        .select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    place = F.col("offset") + F.row_number().over(inside) - 1
    choices = F.array(*[F.lit(w) for w in weights])
    return (
        ranged.join(offsets, "range")
        .withColumn("place", place)
        .select(
            "source",
            "source_size",
            F.get(choices, F.pmod("place", F.lit(len(weights))).cast("int")).alias("weight"),
        )
    )


def water_level(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> float:
    """Words per unit of weight that the sources below their caps get."""
    cap = F.col("source_size") * max_epochs
    level, total = 0.0, None
    while True:
        clamped = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, cap).otherwise(0)).alias("given"),
            F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        total = row["total"] or 0
        if not row["open"]:
            return level
        raised = float(total - row["given"]) / float(row["open"])
        if raised <= level:
            return level
        level = raised


def plan_mix(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source of sizes (doc_id, source, size): target, whole epochs, and the cut.

    Documents before `cut_at` in the seeded order are taken once more; those at it share `cut_left`
    words of their `cut_sum`."""
    sources = written(
        weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights),
        "mix-sources",
    )
    level = water_level(sources, max_epochs)
    size = F.col("source_size")
    target = F.least(
        (size * max_epochs).cast("double"), F.lit(level) * F.col("weight")
    )
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    quota = F.round(F.col("target") - F.col("whole") * size).cast("long")
    sources = (
        sources.withColumn("target", target).withColumn("whole", whole).withColumn("quota", quota)
    )

    order = sizes.where("size > 0").withColumn("at", seeded())
    order = order.withColumn("lane", F.substring("at", 1, 3))
    key = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("key")
    quotas = sources.select(key, "quota").where("quota > 0")
    lanes = order.groupBy(key, "lane").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("key").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    held = (
        lanes.join(quotas, "key")
        .where("before < quota and quota <= before + words")
        .select("key", "lane", (F.col("quota") - F.col("before")).alias("left"))
    )
    ties = (
        order.withColumn("key", key)
        .join(held, ["key", "lane"])
        .groupBy("key", "at")
        .agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    )
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        ties.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .where("before < left and left <= before + words")
        .select(
            "key",
            F.col("at").alias("cut_at"),
            (F.col("left") - F.col("before")).alias("cut_left"),
            F.col("words").alias("cut_sum"),
        )
    )
    return written(
        sources.withColumn("key", key).join(cuts, "key", "left").drop("key"), "mix-plan"
    )


def with_shares(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with their source's figures, `epochs` (whole) and `extra` (words beyond those)."""
    source = plan.withColumnRenamed("source", "plan_source")
    at = seeded()
    extra = (
        F.when(at < F.col("cut_at"), F.col("size"))
        .when(at == F.col("cut_at"), F.floor(F.col("cut_left") * F.col("size") / F.col("cut_sum")))
        .otherwise(0)
        .cast("long")
    )
    return (
        sized.join(source, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("epochs", F.col("whole"))
        .withColumn("extra", extra)
    )


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """How many words of every document the mix takes, repetitions counted."""
    sizes = written(documents.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return with_shares(sizes, plan_mix(sizes, weights, max_epochs)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        "epochs",
        "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


def repeated(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """The mixed documents themselves, one row per repetition, columns as they came.

    A fraction at the cut is rounded: the document comes once more if half its words or more are
    called for. Documents without words come once, if their source is taken at least once whole."""
    columns = documents.columns
    sizes = written(documents.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    plan = plan_mix(sizes, weights, max_epochs)
    plan = plan.select("source", "whole", "cut_at", "cut_left", "cut_sum")
    # Every own column gets a fresh name, so that no column of the documents can clash with it.
    plan = plan.toDF(*[f"_mix_{c}" for c in plan.columns])
    at = seeded()
    share = F.col("_mix_cut_left") * 2 >= F.col("_mix_cut_sum")
    more = F.when(at < F.col("_mix_cut_at"), True).when(at == F.col("_mix_cut_at"), share)
    times = F.col("_mix_whole") + F.coalesce(more, F.lit(False)).cast("long")
    return (
        documents.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
        .select(*columns)
    )
