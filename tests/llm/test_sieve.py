from pyspark.sql import functions as F

from quotelake.llm import near_dups
from quotelake.llm.sieve import marked, repeats, without


def test_a_marked_row_may_be_wrong_but_no_number_is_missed(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "uid")
    some = rows.where("uid % 50 = 3")
    n = marked(rows, some.unionByName(some)).agg(F.count("*"), F.count_if(F.col("_maybe") & (F.col("uid") % 50 == 3)), F.count_if("_maybe")).first()
    assert tuple(n)[:2] == (20_000, 400) and n[2] < 440
    assert marked(rows, some, bits=6).where("_maybe").count() == 20_000  # full: all pass
    assert marked(rows, some.limit(0)).where("_maybe").count() == 0


def test_rows_without_a_copy_are_not_moved(spark, docs_of):
    """Whole rows pass no join but that with a broadcast table, unless they may be copies."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = near_dups.keep_first(docs_of([(i, f"one{i} two{i} three{i} four{i} five{i} six") for i in range(40)] + [(50, "one3 two3 three3 four3 five3 six")]))
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        sure = plan.split("SortMergeJoin", 1)[0]
        assert plan.count("SortMergeJoin") == 1 and "LeftAnti" in plan and "BroadcastHashJoin" in sure
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_without_leaves_exactly_the_others(spark):
    rows = spark.range(3_000).withColumnRenamed("id", "uid")
    gone = rows.where("uid % 7 = 2")
    assert {r.uid for r in without(rows, gone).collect()} == {i for i in range(3_000) if i % 7 != 2}
    keyed = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "key string, uid long")
    assert [r.uid for r in repeats(keyed, keyed.where("uid != 2")).collect()] == [2]
