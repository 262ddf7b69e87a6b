import pytest
from pyspark.sql import functions as F

from rankmill.operators import evaluation as V
from rankmill.plans import catalogue, more  # noqa: F401  (more adds to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("columns", [[], ["score"], ["score", "note"]])
def test_the_last_of_a_pair_stays_whole(spark, columns):
    rows = [(1, "a", 5.0, "x", 3), (1, "a", None, "y", 7), (1, "b", 2.0, None, 1), (2, "a", 9.0, "z", 2), (2, "a", 1.0, "w", 1), (3, "c", 4.0, "v", None)]
    run = spark.createDataFrame(rows, "query_id long, doc_id string, score double, note string, pos long").select("query_id", "doc_id", *columns, "pos").repartition(3)
    got = V.last_of(run)
    assert got.columns == ["query_id", "doc_id", *columns]
    want = [(1, "a", None, "y"), (1, "b", 2.0, None), (2, "a", 9.0, "z"), (3, "c", 4.0, "v")]
    assert sorted(map(tuple, got.collect())) == [w[: 2 + len(columns)] for w in want]


def test_pairs_are_neither_sorted_nor_shuffled_for_their_last_row(spark):
    plan = catalogue.QUERIES["last_wins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above, join, _ = plan.partition("BroadcastNestedLoopJoin")
    assert join and "Window" not in plan and "Sort" not in above
    assert above.rindex("HashAggregate") > above.rindex("Exchange")  # summed up in the task that made the pairs


def test_a_run_of_methods_is_made_once(spark):
    runs, _ = more._two_methods(spark, SF)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and runs.groupBy("method").count().count() == 2  # read from a written table
