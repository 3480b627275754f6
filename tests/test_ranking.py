import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.operators import search
from intervalis.operators.ranking import PageIndex, ranked, running
from intervalis.plans.scratch import TASK_ROWS, dealt


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(k, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, rnd.randrange(20) / 2]), rnd.choice(["gold", "silver"])) for k in range(3000)]
    return spark.createDataFrame(data, "index int, framing_type string, score double, tier string").repartition(7)


@pytest.mark.parametrize("keys", [[], ["framing_type"], ["framing_type", "tier"]])
def test_places_equal_row_number(rows, keys):
    order = [F.desc_nulls_last("score"), F.asc("index")]
    got = {r["index"]: r.place for r in ranked(rows, keys, order, ranges=9).collect()}
    along = Window.partitionBy(*keys).orderBy(*order)
    assert got == {r["index"]: r.n for r in rows.select("index", F.row_number().over(along).alias("n")).collect()}
    assert ranked(rows.filter("index < 0"), keys, order).count() == 0


def test_a_hot_key_is_many_ranges(rows):
    dealt = ranked(rows, ["framing_type"], [F.asc("index")], ranges=9)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan  # the sort of a key's rows is by range and key, not by key alone


@pytest.mark.parametrize(("field", "descending"), [("score", False), ("score", True), ("index", True), ("nothing", False)])
def test_pages_equal_the_plain_ones(rows, field, descending):
    query = search.Query(search.Group("and", (search.Filter("tier", "eq", "gold"),)), field, descending, page_size=70, include=("index", "score"))
    index = PageIndex(rows, query, ranges=8)
    assert index.found == rows.filter("tier = 'gold'").count()
    for number in (1, 2, 9, -(-index.found // 70), -(-index.found // 70) + 1, 500):
        plain = search.page_of(rows, search.Query(query.filters, field, descending, number, 70, query.include))
        assert index.page(number).collect() == plain.collect()


def test_a_deep_page_reads_its_range_only(rows):
    index = PageIndex(rows, search.Query(sort_by="score", page_size=10), ranges=8)
    assert len(index.ranges) > 4
    plan = index.page(200)._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[(.*?)\], Push", plan)[1]
    assert len(re.findall(r"= \d+|IN \(\d+,\d+\)", pruned)) == 1
    empty = PageIndex(rows.filter("index < 0"), search.Query())
    assert empty.found == 0 and empty.page(1).count() == 0


@pytest.mark.parametrize("keys", [[], ["framing_type"], ["framing_type", "tier"]])
@pytest.mark.parametrize("ranges", [1, 9, None])
def test_running_sums_equal_the_window(rows, keys, ranges):
    order = [F.desc_nulls_last("score"), F.asc("index")]
    got = {r["index"]: (r.place, r.before) for r in running(rows, keys, order, "score", ranges=ranges).collect()}
    along = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum("score").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    assert got == {r["index"]: (r.n, r.b) for r in rows.select("index", F.row_number().over(along).alias("n"), before.alias("b")).collect()}
    assert running(rows.filter("index < 0"), keys, order, "score").count() == 0


def test_a_long_timeline_is_sorted_in_ranges(rows):
    placed = running(rows, ["framing_type"], [F.asc("index")], "score", ranges=9)
    assert placed.filter("framing_type = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_tasks_grow_with_the_rows(spark):
    few = spark.range(100)
    assert dealt(few, 100, "id") is few
    assert dealt(few, 9 * TASK_ROWS + 1, "id").rdd.getNumPartitions() == 10


def test_islands_are_cut_by_tasks_that_grow(spark, monkeypatch):
    from intervalis.operators import intervals
    from intervalis.plans import scratch

    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    clips = spark.range(95).selectExpr("concat('f', id % 30) AS filename", "'gold' AS tier", "double(id) AS start_time", "id + 0.5D AS end_time", "1.0D AS score", "id AS clip_no")
    assert "hashpartitioning(filename" in (plan := intervals.clip_islands(clips)._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan


def test_found_rows_are_sorted_in_ranges_that_grow(rows, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 100)
    found = search.quick_search(rows, "score", True)
    assert found.rdd.getNumPartitions() == 30
    assert found.collect() == rows.orderBy(*search.sort_keys(rows.schema, "score", True)).collect()


def test_an_index_holds_the_columns_of_its_pages_only(rows):
    wide = rows.withColumn("metrics", F.struct((F.col("score") % 3).alias("brightness_mean"))).withColumn("text", F.repeat("tier", 100))
    for query in (search.Query(sort_by="metrics.brightness_mean", descending=True, page_size=40, include=("text",)), search.Query(sort_by="no_such", page_size=40, exclude=("text", "metrics", "framing_type"))):
        index = PageIndex(wide, query, ranges=8)
        written = index.rows.columns
        assert "metrics" not in written and "framing_type" not in written and len(written) <= 5
        plain = search.page_of(wide, search.Query(query.filters, query.sort_by, query.descending, 30, 40, query.include, query.exclude))
        assert index.page(30).columns == plain.columns and index.page(30).collect() == plain.collect()
