"""URL filters: fixed host and path rules first, association rules mined from labels for the rest.

A URL becomes a set of tokens: labels of its host, path segments (digits as
one 0), and names of its query arguments. Tokens that
always stand together count as one item, so that long templates don't multiply
itemsets. FP-growth mines the combinations that labelled URLs share, the label
being one more item; rules that lead to a
label are kept above a support, a confidence and a lift, and where no shorter
rule is as confident. Rules are matched by an inverted index: each stands under
its rarest token, the distinct token sets of all URLs look their tokens up and
verify the rest of the rule, and the most confident match decides.

Null URLs, and URLs without ``://``, have an empty host and path, no tokens and
the default verdict; ties between rules go to support, then length, then block
over allow; repeated rows are judged each; without labels there are no rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervalis.plans.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 10, 0.8, 1.05
LABEL = "label:"
RULES = "antecedent array<string>, verdict string, confidence double, lift double, support double"


def url_parts(url: F.Column) -> dict[str, F.Column]:
    """host, path and query of a URL, each empty where absent."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1),
    }


def url_tokens(host: F.Column, path: F.Column, query: F.Column) -> F.Column:
    """The sorted distinct tokens of a URL, as one string joined by blanks."""

    def named(prefix: str, parts: F.Column) -> F.Column:
        full = F.filter(parts, lambda x: x != "")
        return F.transform(full, lambda x: F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(x, r"[0-9]+", "0"), r"\s", "_")))

    args = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    tokens = F.concat(named("host:", F.split(host, r"\.")), named("path:", F.split(path, "/")), named("arg:", args))
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def token_classes(labelled: DataFrame) -> DataFrame:
    """(token, leader): tokens that stand in exactly the same token sets share the least of them as leader.

    A template's constant tokens would double the itemsets with each of them;
    as one item they change no rule's figures. Sets of tokens are compared by
    their number and 128 bits of hash sums, so nothing is gathered but the
    tokens of a class, all of which stand in one URL.
    """
    sets = labelled.select("tokens").filter("tokens <> ''").distinct()
    each = sets.select(F.explode(F.split("tokens", " ")).alias("token"), F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    classes = marks.groupBy("n", "a", "b").agg(F.min("token").alias("leader"), F.collect_list("token").alias("members"))
    return classes.select(F.explode("members").alias("token"), "leader")


def mine_rules(labelled: DataFrame, classes: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Association rules of a table (tokens, verdict): antecedent (leaders of ``classes``), verdict, confidence, lift, support."""
    spark = labelled.sparkSession
    known = labelled.filter("verdict is not null")
    sets = known.select("tokens").filter("tokens <> ''").distinct()
    leaders = sets.select("tokens", F.explode(F.split("tokens", " ")).alias("leader")).join(classes.select("leader").distinct(), "leader").groupBy("tokens").agg(F.collect_list("leader").alias("leaders"))
    leaders = materialize(leaders, "url-leaders")  # as the join of a very common URL is split only where it is apart from an aggregation
    items = F.concat(F.coalesce("leaders", F.array().cast("array<string>")), F.array(F.concat(F.lit(LABEL), F.col("verdict"))))
    rows = materialize(known.join(leaders, "tokens", "left").select(items.alias("items")), "url-items")
    if not (n := rows.count()):
        return spark.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL) & (F.col("lift") >= min_lift)).select(
        "antecedent", F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "lift", "support"
    )
    rules = materialize(rules.withColumn("rule", F.array_join(F.array_sort("antecedent"), " ")), "url-mined")
    # a rule is redundant if a shorter one within it is as confident
    parts = rules.select("rule", "verdict", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    inner, outer = parts.alias("i"), parts.alias("o")
    within = inner.join(outer, (F.col("i.token") == F.col("o.token")) & (F.col("i.verdict") == F.col("o.verdict")) & (F.col("i.n") < F.col("o.n")) & (F.col("i.confidence") >= F.col("o.confidence")))
    idle = within.groupBy(F.col("i.rule").alias("inner_rule"), F.col("o.rule").alias("rule"), F.col("o.verdict").alias("verdict"), F.col("i.n").alias("n")).count().filter("count = n")
    return rules.join(idle.select("rule", "verdict").distinct(), ["rule", "verdict"], "left_anti").drop("rule")


def match_rules(token_sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence, matched) for the token sets that a rule matches; ``token_sets`` has distinct rows.

    A rule fits where every leader of it is there by any token of its class.
    """
    parts = rules.select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("leader"))
    asked = classes.join(parts.select("leader").distinct(), "leader")
    tokens = token_sets.select("tokens", F.explode(F.split("tokens", " ")).alias("token"))
    held = tokens.join(asked, "token").groupBy("tokens").agg(F.collect_set("leader").alias("leaders"))
    frequency = held.select(F.explode("leaders").alias("leader")).groupBy("leader").agg(F.count(F.lit(1)).alias("f"))
    index = (
        parts.join(frequency, "leader")
        .groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("f", "leader"))["leader"].alias("leader"), F.count(F.lit(1)).alias("present"))
        .filter(F.col("present") == F.size("antecedent"))
    )
    fits = held.select("tokens", "leaders", F.explode("leaders").alias("leader")).join(index, "leader").filter(F.size(F.array_except("antecedent", "leaders")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict", F.array_join(F.array_sort("antecedent"), " ").alias("matched")))
    return fits.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.verdict", "best.confidence", "best.matched")


def judge_urls(pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", default: str = "allow", **thresholds) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule (the fixed one, or null), verdict, method_verdict, confidence, matched.

    ``labelled``: url and verdict. ``fixed``: (verdict, host, path); such a rule
    fits its host and all subdomains if the path starts with its own, and the
    longest wins.
    """
    parts = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), parts["host"].alias("host"), parts["path"].alias("path"), url_tokens(*parts.values()).alias("tokens"))
    known = url_parts(F.col("url"))
    labels = labelled.select(url_tokens(*known.values()).alias("tokens"), "verdict")
    classes = materialize(token_classes(labels.filter("verdict is not null")), "url-classes")
    rules = materialize(mine_rules(labels, classes, **thresholds), "url-rules")
    found = materialize(match_rules(rows.select("tokens").filter("tokens <> ''").distinct(), rules, classes), "url-found").withColumnsRenamed({"tokens": "found_tokens", "verdict": "method"})
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(fixed, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    judged = rows.join(found, F.col("tokens") == F.col("found_tokens"), "left").withColumn("method_verdict", F.coalesce("method", F.lit(default)))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method_verdict")).alias("verdict"), "method_verdict", "confidence", "matched")
