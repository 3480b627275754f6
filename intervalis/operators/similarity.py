"""Pairs of similar segments, groups of them, and the best of each group.

Pairs are compared within one video only, and there within cells that the
thresholds imply: what a pair needs to pass bounds how far apart its lengths,
edges or brightness may lie. Histograms that depend on one bin are compared
through small tables of bin pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators.graph import connected_components
from intervalis.operators.scoring import ladder
from intervalis.plans.scratch import materialize

GAP, MIN_TOTAL, MIN_CONFIDENCE = 10.0, 0.60, 0.70


def visual_similarity(a: str = "a", b: str = "b") -> Column:
    """Weighted closeness of brightness, contrast, edges, sharpness and motion; missing values take defaults."""
    def apart(name: str, default: float) -> Column:
        return F.abs(F.coalesce(F.col(f"{a}.{name}"), F.lit(default)) - F.coalesce(F.col(f"{b}.{name}"), F.lit(default)))

    return (
        0.25 * (1 - apart("brightness", 0.5)) + 0.15 * (1 - apart("contrast", 0.5)) + 0.20 * (1 - F.least(F.lit(1.0), 5 * apart("edge_density", 0.1)))
        + 0.20 * (1 - F.least(F.lit(1.0), apart("sharpness", 100.0) / 200)) + 0.20 * (1 - F.least(F.lit(1.0), apart("motion", 0.0) / 5))
    )


def duration_similarity(x: Column, y: Column) -> Column:
    """Ratio of two lengths, from 0.75 on 1; a missing length is none."""
    x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    ratio = F.when(F.greatest(x, y) > 0, F.try_divide(F.least(x, y), F.greatest(x, y))).otherwise(0.0)
    return F.when(ratio >= 0.75, 1.0).otherwise(ratio)


def _ratio(x: Column, y: Column) -> Column:
    return F.when(F.greatest(x, y) > 0, F.try_divide(F.least(x, y), F.greatest(x, y))).otherwise(1.0)


def face_similarity(nx: Column, ny: Column, cx: Column, cy: Column) -> Column:
    both, none = (nx > 0) & (ny > 0), (nx <= 0) & (ny <= 0)
    return ladder((none, 1.0), (~both, 0.3), otherwise=(_ratio(nx, ny) + _ratio(cx, cy)) / 2)


VISUAL_STEPS, LENGTH_STEPS = ((0.8, 0.25), (0.6, 0.15)), ((0.9, 0.15), (0.7, 0.10))


def _floor_of(steps: tuple[tuple[float, float], ...], needed: float) -> float | None:
    """The value that must be exceeded to gain ``needed``; None where nothing must, infinity where nothing can."""
    if needed <= 1e-9:
        return None
    return min((least for least, gain in steps if gain >= needed - 1e-9), default=math.inf)


def _cells(value: Column, width: float | None) -> Column:
    return F.lit(0).cast("long") if width is None else F.floor(value / F.lit(width))


def take_candidates(segments: DataFrame, gap: float = GAP, least: float = MIN_TOTAL, sure: float = MIN_CONFIDENCE) -> DataFrame:
    """Pairs (a, b) that may pass ``least`` and ``sure``, each once: of one framing, of one scene, or of neither but near.

    A pair of neither can only pass by a visual closeness and a length ratio above the floors that follow from the
    thresholds, so its edges and the logarithms of its lengths lie in neighbouring cells. The keys are joined at once;
    a pair that several keys find is taken at the first.
    """
    free = max(_floor_of(VISUAL_STEPS, sure - 0.3 - 0.15) or 0.0, (least - 0.15 - 0.10) / 0.45)  # visual closeness, with the best length and faces
    ratio = _floor_of(LENGTH_STEPS, sure - 0.3 - 0.25)
    ratio = None if ratio is None else min(ratio, 0.75)  # a ratio of 0.75 counts as 1
    edge_width = (1 - free) * 1.0001 if 0 < 1 - free <= 0.2 else None  # beyond 0.2 the edges' term is saturated and bounds nothing
    length_width = None if ratio is None else -math.log(ratio) * 1.0001
    edge, length = _cells(F.coalesce(F.col("edge_density"), F.lit(0.1)), edge_width), _cells(F.ln("duration"), length_width)
    same = [
        F.when(F.col("framing_type") != "DESCONOCIDO", F.concat(F.lit("framing:"), F.col("framing_type"))),
        F.when(F.col("scene_group_id") >= 0, F.concat(F.lit("scene:"), F.col("scene_group_id").cast("string"))),
    ]
    near = lambda i, j: F.when(length.isNotNull(), F.concat(F.lit("near:"), edge + i, F.lit(":"), length + j))
    steps = lambda width: (0,) if width is None else (-1, 0, 1)
    possible = free < 1 and ratio != math.inf
    mine = [*same, *([near(0, 0)] if possible else [])]
    theirs = [*same, *(near(i, j) for i in steps(edge_width) for j in steps(length_width) if possible)]
    keyed = lambda keys: segments.withColumn("_key", F.explode(F.array_compact(F.array(*keys))))
    a, b = keyed(mine).alias("a"), keyed(theirs).alias("b")
    framing, scene = same_framing(), same_scene()
    once = F.col("a._key").startswith("framing:") | (~framing & F.col("a._key").startswith("scene:")) | (~framing & ~scene)
    apart = (F.col("a.index") < F.col("b.index")) & (F.abs(F.col("a.start_time") - F.col("b.start_time")) >= gap)
    return a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a._key") == F.col("b._key")) & apart & once)


def same_framing() -> Column:
    return F.coalesce((F.col("a.framing_type") == F.col("b.framing_type")) & (F.col("a.framing_type") != "DESCONOCIDO"), F.lit(False))


def same_scene() -> Column:
    return F.coalesce((F.col("a.scene_group_id") == F.col("b.scene_group_id")) & (F.col("a.scene_group_id") >= 0), F.lit(False))


def take_pairs(segments: DataFrame, gap: float = GAP, least: float = MIN_TOTAL, sure: float = MIN_CONFIDENCE) -> DataFrame:
    """Similar segments of one video that begin at least ``gap`` seconds apart: similarity, relation and confidence of each pair.

    ``segments``: video_id, index, start_time, duration, brightness, contrast, edge_density, sharpness, motion, framing_type, scene_group_id, face_count, coverage.
    """
    pairs = take_candidates(segments, gap, least, sure)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    framing, scene = same_framing(), same_scene()
    rows = pairs.select(
        F.col("a.video_id").alias("video_id"), F.col("a.index").alias("segment_a"), F.col("b.index").alias("segment_b"), visual_similarity().alias("visual"),
        duration_similarity(F.col("a.duration"), F.col("b.duration")).alias("length"), framing.alias("framing_match"), scene.alias("scene_match"),
        face_similarity(zero("a.face_count"), zero("b.face_count"), zero("a.coverage"), zero("b.coverage")).alias("faces"),
    )
    total = 0.45 * F.col("visual") + 0.15 * F.col("length") + 0.15 * F.col("framing_match").cast("double") + 0.15 * F.col("scene_match").cast("double") + 0.10 * F.col("faces")
    v, d = F.col("visual"), F.col("length")
    gain = lambda x, steps: ladder(*((x > least, value) for least, value in steps), otherwise=0.0)
    trust = F.lit(0.3) + gain(v, VISUAL_STEPS) + gain(d, LENGTH_STEPS)
    trust = trust + F.when(F.col("framing_match"), 0.15).otherwise(0.0) + F.when(F.col("scene_match"), 0.15).otherwise(0.0)
    rows = rows.withColumn("similarity", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))).withColumn("confidence", F.least(trust, F.lit(1.0)))
    relation = ladder((F.col("similarity") >= 0.90, "same_take"), (F.col("similarity") >= 0.85, "repeated_take"), (F.col("similarity") >= 0.60, "similar_shot"), otherwise="different")
    return rows.filter((F.col("similarity") >= least) & (F.col("confidence") >= sure)).withColumn("relation", relation)


def groups_of(nodes: DataFrame, edges: DataFrame, key: str = "video_id", node: str = "index", a: str = "segment_a", b: str = "segment_b") -> DataFrame:
    """(key, node, group_id) of the connected components of each key; ids are dense ranks of the least member."""
    end = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("n"))
    label = connected_components(edges.select(end(a).alias("src"), end(b).alias("dst")))
    rows = nodes.select(key, node).join(label.select(F.col("node.k").alias(key), F.col("node.n").alias(node), F.col("component.n").alias("root")), [key, node], "left")
    return rows.withColumn("root", F.coalesce("root", node)).withColumn("group_id", F.dense_rank().over(Window.partitionBy(key).orderBy("root")) - 1).drop("root")


def take_groups(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of the groups of repeated takes: video_id, index, group_id, take_count, best_take (-1 if none), recommended, is_best."""
    linked = pairs.filter(F.col("relation").isin("same_take", "repeated_take"))
    members = linked.select("video_id", F.explode(F.array("segment_a", "segment_b")).alias("index")).distinct()
    ids = groups_of(members, linked)
    rows = ids.join(segments.select("video_id", "index", "score", "tier", "duration", F.coalesce("is_garbage", F.lit(False)).alias("is_garbage")), ["video_id", "index"])
    valid = ~F.col("is_garbage") & ~F.lower("tier").isin("garbage", "discard")
    order = F.struct("score", (-F.col("index")).alias("i"))  # the first of equal scores
    best = rows.groupBy("video_id", "group_id").agg(
        F.count(F.lit(1)).alias("take_count"), F.coalesce(F.max(F.when(valid, order))["i"] * -1, F.lit(-1)).alias("best_take"), (F.max(order)["i"] * -1).alias("recommended"),
        F.sum("duration").alias("group_duration"), F.max_by("duration", order).alias("kept_duration"), F.coalesce(F.avg(F.when(valid, F.col("score"))), F.avg("score")).alias("avg_score"),
    )
    best = best.withColumn("discard_duration", F.col("group_duration") - F.col("kept_duration")).drop("group_duration", "kept_duration")
    return rows.join(best, ["video_id", "group_id"]).withColumn("is_best", (F.col("index") == F.col("best_take")) & ~F.col("is_garbage"))


def flag_takes(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """``segments`` with take_group_id, is_best_take (null outside groups), is_repeated_take and take_alternatives."""
    flags = groups.select("video_id", "index", F.col("group_id").alias("take_group_id"), F.col("is_best").alias("is_best_take"), (F.col("index") != F.col("recommended")).alias("repeated"), "take_count")
    rows = segments.drop("take_group_id", "is_best_take", "is_repeated_take", "take_alternatives").join(flags, ["video_id", "index"], "left")
    return rows.withColumn("is_repeated_take", F.coalesce("repeated", F.lit(False))).withColumn("take_alternatives", F.coalesce(F.col("take_count") - 1, F.lit(0))).drop("repeated", "take_count")


def recommend(flagged: DataFrame) -> DataFrame:
    """use, consider or skip for each segment."""
    alone = ladder((F.lower("tier").isin("gold", "silver"), "use"), (F.lower("tier") == "bronze", "consider"), otherwise="skip")
    return flagged.withColumn("recommendation", F.when(F.col("take_group_id").isNull(), alone).when(F.col("is_repeated_take"), "skip").otherwise("use"))


# --- scenes -----------------------------------------------------------------------------------
HUE_BINS = 32
#: (histogram, value, bins, weight)
HISTOGRAMS = (("hue", "brightness", HUE_BINS, 0.25), ("sat", "contrast", 16, 0.15), ("val", "brightness", 16, 0.25))


def correlations(bins: int) -> list[tuple[int, int, float]]:
    """(bin, bin, correlation): Pearson correlation of the bell histograms around two bins; one without variance correlates fully."""
    bells = [[math.exp(-((i - c) ** 2) / (bins / 4)) for i in range(bins)] for c in range(bins)]

    def corr(x: list[float], y: list[float]) -> float:
        mx, my = sum(x) / bins, sum(y) / bins
        sxy, sxx, syy = (sum(p * q for p, q in zip(u, v, strict=True)) for u, v in (([a - mx for a in x], [b - my for b in y]), ([a - mx for a in x],) * 2, ([b - my for b in y],) * 2))
        return sxy / math.sqrt(sxx * syy) if sxx * syy > 0 else 1.0

    return [(a, b, corr(bells[a], bells[b])) for a in range(bins) for b in range(bins)]


def bin_correlations(spark: SparkSession, bins: int) -> DataFrame:
    return spark.createDataFrame(correlations(bins), "bin_a int, bin_b int, corr double")


def _bin(value: Column, bins: int) -> Column:
    return F.least(F.greatest((F.coalesce(value, F.lit(0.5)) * (bins - 1)).cast("int"), F.lit(0)), F.lit(bins - 1))


def fingerprint_distance(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a_ and b_ brightness, contrast, edge_density) with the distance of their fingerprints."""
    spark = pairs.sparkSession
    rows = pairs
    for name, value, bins, _ in HISTOGRAMS:
        table = F.broadcast(bin_correlations(spark, bins).withColumnRenamed("corr", f"corr_{name}"))  # bins squared rows
        rows = rows.withColumn("bin_a", _bin(F.col(f"a_{value}"), bins)).withColumn("bin_b", _bin(F.col(f"b_{value}"), bins)).join(table, ["bin_a", "bin_b"]).drop("bin_a", "bin_b")
    zero = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return rows.withColumn(
        "distance",
        sum((w * (1 - F.col(f"corr_{name}")) for name, _, _, w in HISTOGRAMS), F.lit(0.0)) + 0.25 * F.abs(zero("a_brightness", 0.5) - zero("b_brightness", 0.5)) + 0.10 * F.abs(zero("a_edge_density", 0.1) - zero("b_edge_density", 0.1)),
    ).drop("corr_hue", "corr_sat", "corr_val")


def scene_pairs(segments: DataFrame, limit: float | None = None) -> DataFrame:
    """Distances of pairs of segments within a video: of all, or of those nearer than ``limit``.

    A limit bounds how far apart the brightness bins of a pair may lie, as their histograms' correlations alone then
    use up the distance; only pairs in the same or neighbouring runs of bins are compared.
    """
    columns = ("index", "brightness", "contrast", "edge_density")
    a = segments.select("video_id", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = segments.select("video_id", *(F.col(c).alias(f"b_{c}") for c in columns))
    keys = ["video_id"]
    if limit is not None:
        reach = max((abs(x - y) for x, y, corr in correlations(HUE_BINS) if 0.25 * (1 - corr) <= limit + 1e-9), default=0)
        run = lambda c: F.floor(_bin(F.col(c), HUE_BINS) / F.lit(max(1, reach)))
        a, b = a.withColumn("_run", run("a_brightness")), b.withColumn("_run", F.explode(F.array(*(run("b_brightness") + i for i in (-1, 0, 1)))))
        keys.append("_run")
    found = fingerprint_distance(a.join(b, keys).filter("a_index < b_index")).select("video_id", F.col("a_index").alias("segment_a"), F.col("b_index").alias("segment_b"), "distance")
    return found if limit is None else found.filter(F.col("distance") < limit)


def mean_distances(members: DataFrame) -> DataFrame:
    """(video_id, index, mean_distance): each member's mean distance to the others of its group, without their pairs.

    A group is at most 64 rows of bins, so histogram terms are bins x bins; sums of absolute differences come from
    running sums along the order of the values. ``members``: video_id, group_id, index and the fingerprint's columns.
    """
    spark, group = members.sparkSession, ["video_id", "group_id"]
    rows = members.select(*group, "index", F.coalesce("brightness", F.lit(0.5)).alias("b"), F.coalesce("edge_density", F.lit(0.1)).alias("e"), *(_bin(F.col(c), n).alias(h) for h, c, n, _ in HISTOGRAMS))
    bins = rows.select(*group, F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(h).alias("bin_b")) for h, *_ in HISTOGRAMS))).alias("x")).select(*group, "x.*").groupBy(*group, "h", "bin_b").count()
    tables = [bin_correlations(spark, n).select(F.lit(h).alias("h"), "bin_a", "bin_b", (w * (1 - F.col("corr"))).alias("d")) for h, _, n, w in HISTOGRAMS]
    table = F.broadcast(tables[0].unionByName(tables[1]).unionByName(tables[2]))  # bins squared rows
    apart = bins.join(table, ["h", "bin_b"]).groupBy(*group, "h", "bin_a").agg(F.sum(F.col("d") * F.col("count")).alias("d"))
    for h, *_ in HISTOGRAMS:
        rows = rows.join(apart.filter(F.col("h") == h).select(*group, F.col("bin_a").alias(h), F.col("d").alias(f"d_{h}")), [*group, h])
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)

    def gaps(c: str) -> Column:
        along = whole.orderBy(c, "index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rank, before = F.count(F.lit(1)).over(along), F.sum(c).over(along)
        return (2 * rank - n) * F.col(c) - 2 * before + F.sum(c).over(whole)

    total = F.col("d_hue") + F.col("d_sat") + F.col("d_val") + 0.25 * gaps("b") + 0.10 * gaps("e")
    return rows.select("video_id", "index", F.when(n > 1, F.greatest(F.lit(0.0), F.try_divide(total, n - 1))).otherwise(0.0).alias("mean_distance"))


def scene_groups(segments: DataFrame, limit: float = 0.25) -> DataFrame:
    """Segments with their scene group: group_id, size, consistency, representative and name."""
    columns = ["video_id", "index", "brightness", "contrast", "edge_density", "duration"]
    ids = materialize(groups_of(segments, scene_pairs(segments, limit)).join(segments.select(*columns), ["video_id", "index"]), "scene-groups")
    rows = ids.join(mean_distances(ids), ["video_id", "index"])
    ids = ids.select("video_id", "index", "group_id")
    b = F.col("avg_brightness")
    group = rows.groupBy("video_id", "group_id").agg(
        F.count(F.lit(1)).alias("size"), F.greatest(F.lit(0.0), 1 - F.avg("mean_distance")).alias("consistency"), F.min(F.struct("mean_distance", "index"))["index"].alias("representative"),
        F.avg("brightness").alias("avg_brightness"), F.sum("duration").alias("total_duration"),
    )
    light = ladder((b < 0.3, "Oscuro"), (b < 0.5, "Medio"), (b < 0.7, "Claro"), otherwise="Brillante")
    named = group.withColumn("name", F.concat(F.lit("Setup "), F.char(65 + F.col("group_id") % 26), F.lit(" ("), light, F.lit(")")))
    return ids.join(named, ["video_id", "group_id"])


def dominant_colour(brightness: Column, contrast: Column) -> Column:
    return F.array(F.lit(0), (128 * contrast).cast("int"), (255 * brightness).cast("int"))


def most_similar(rows: DataFrame, reference: DataFrame, distance: Column, k: int) -> DataFrame:
    """The k rows nearest to a one-row reference."""
    return rows.crossJoin(F.broadcast(reference)).withColumn("similarity", 1 - distance).orderBy(F.desc("similarity"), "index").limit(k)
