"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of all words, at most ``most`` times
its own; what is cut off is shared among the others by weight until none is
above. A document's key is -ln(u) / w for a uniform u of its id and text and
its quality weight w; within a source, documents are taken by ascending key.
A target takes whole epochs of its source first, then the leading documents
whose running sum of words is nearest to the rest.

A source may hold a third of all rows: each doubling of its keys is cut into as
many ranges as its row count asks for (MOST_CUTS at most), sums per range are
added up along the source, and only within a range are documents sorted. Sources are numbered
and capped by distributed sorts and one small aggregation per round of capping.

Null text has size 0; null source is one source, the last; rows with equal
keys are ordered by id, size and text; repeated rows are documents of their own
with equal keys, taken one after the other; null or non-positive weights count
as 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.llm._batches import all_of, free_names, row_key
from intervalis.plans.scratch import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS, MOST_CUTS = 5000, 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source.

    Weights go to the sources in the order of their code points, null last, and repeat.
    """
    ordered = sizes.orderBy(F.asc_nulls_last("source")).select("*", F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered.select("*", F.shiftright("at", 33).alias("split"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "mix-ordered")
    splits = ordered.groupBy("split").agg(F.count(F.lit(1)).alias("n"))  # one row for each task of the sort
    ahead = splits.select("split", F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = ordered.join(ahead, "split").select("source", "source_size", (F.col("ahead") + F.col("within")).alias("place"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "mix-sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    capped, level = -1, 0.0
    while True:  # each round caps at least one more source, or ends
        full = F.col("cap") <= level * F.col("weight")
        n, taken, free = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - taken) / free
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words), epochs (times taken), key, source, text_key.

    ``quality``: (id, weight), a row for each id that has one; it meets the
    sizes, not the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), (-F.log(u)).alias("key"), row_key(F.col(id_col), F.col(source_col), text).alias("text_key")
    )
    if quality is not None:
        rows = rows.join(quality.select(F.col("id").alias("q_id"), F.col("weight").cast("double").alias("weight")), F.col("id") == F.col("q_id"), "left").drop("q_id")
        rows = rows.withColumn("key", F.col("key") / F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).drop("weight")
    rows = materialize(rows, "mix-rows")
    by_source = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = source_targets(by_source.select("source", "source_size"), weights, most).withColumnRenamed("source", "s")
    plan = by_source.drop("source_size").join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", F.least(F.ceil(F.col("n") / RANGE_ROWS), F.lit(MOST_CUTS)).alias("cuts"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    )
    plan = materialize(plan, "mix-plan")
    # whatever the weights, at most about half of a source's keys lie within a factor of 2
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.floor(F.log2("key") * F.col("cuts")))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("part"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), F.coalesce(F.sum("part").over(along), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    chosen = F.col("ahead") + F.col("within") + F.col("size") / 2 <= rest
    return summed.withColumn("epochs", F.col("whole") + F.when(chosen & (F.col("size") > 0), 1).otherwise(0)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "epochs", "key", "source", "text_key"
    )


def mixed(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; of rows equal in id, source and text, those with the least hash of all columns first."""
    mine, number, its, its_number, times = free_names(docs, "mix_row", "mix_number", "mix_key", "mix_place", "mix_times")
    plan = mix_sources(docs, quality, id_col, text_col, source_col, **options).select(F.col("text_key").alias(its), F.col("epochs").alias(times))
    plan = plan.withColumn(its_number, F.row_number().over(Window.partitionBy(its).orderBy(F.desc(times)))).filter(F.col(times) > 0)
    rows = docs.withColumn(mine, row_key(F.col(id_col), F.col(source_col), F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(mine).orderBy(all_of(docs))))
    rows = rows.join(plan, (F.col(mine) == F.col(its)) & (F.col(number) == F.col(its_number)))
    return rows.withColumn(mine, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
