import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.api import relation
from graphloom.operators import fanout
from graphloom.plans.model import Join, Plan, Project, Source


def view(df):
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return Source(name, "Table", "Rows")


def joined(spark, left, right, *pairs):
    plan = Plan()
    return relation(plan, plan.add(Join(pairs, "j"), *[plan.add(view(x)) for x in (left, right)]), spark=spark)


def test_output_of_one_key_is_dealt_over_tasks(spark):
    """3,000 rows of one key are one task of input and make nine million rows."""
    plan, n = Plan(), 3000
    at = plan.add(view(spark.range(0, n, 1, 1).select("id", F.lit(7).alias("k"))))
    df = relation(plan, plan.add(Join((("k", "k"),), "j"), at, at), spark=spark)
    tasks = [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n * n and max(tasks) < n * n / 2
    mates = df.groupBy("id", "k").agg(F.count("*"), F.sum(F.col("j_id").cast("long")), F.sum(F.pow(F.col("j_id").cast("long"), 2)), F.max("j_k")).collect()
    assert Counter(tuple(x) for x in mates) == Counter((str(i), "7", n, n * (n - 1) // 2, float((n - 1) * n * (2 * n - 1) // 6), "7") for i in range(n))


@pytest.mark.parametrize("side, keys", [(4, 1), (4, 1000), (1000, 1000)])
@pytest.mark.parametrize("kinds", [("int", "int"), ("int", "string"), ("string", "string"), ("double", "double")])
def test_cut_joins_match_nested_loops(spark, monkeypatch, side, keys, kinds):
    """Null keys, equal rows, keys of a side only, keys that are cut and others, a key of two columns."""
    for name, value in {"TASK_ROWS": 50, "GROWTH": 0, "SIDE": side, "KEYS": keys}.items():
        monkeypatch.setattr(fanout, name, value)
    rng = random.Random(5)
    table = lambda n, lo: [(rng.choice([None, 1, 1, 1, 2, *range(lo, lo + 5)]), rng.choice(["", "a", "a", None]), rng.randrange(3)) for _ in range(n)]
    left, right = table(90, 3), table(40, 5)
    frame = lambda rows, kind: spark.createDataFrame(rows, "a int, b string, v int").withColumn("a", F.col("a").cast(kind))
    text = lambda kind, row: (row[0] if row[0] is None else f"{row[0]}.0" if kind == "double" else str(row[0]), row[1], str(row[2]))
    l_rows, r_rows = ([text(kind, x) for x in rows] for kind, rows in zip(kinds, (left, right), strict=True))
    df = joined(spark, frame(left, kinds[0]), frame(right, kinds[1]), ("a", "a"), ("b", "b"))
    assert "explode(sequence" in df._jdf.queryExecution().toString()
    assert Counter(map(tuple, df.collect())) == Counter(x + y for x in l_rows for y in r_rows if None not in (*x[:2], *y[:2]) and x[:2] == y[:2])


def test_text_that_is_equal_by_collation_only_is_joined(spark, monkeypatch):
    for name, value in {"TASK_ROWS": 0, "GROWTH": 0, "SIDE": 1}.items():
        monkeypatch.setattr(fanout, name, value)
    df = spark.sql("SELECT k COLLATE UTF8_LCASE AS k, i FROM VALUES ('a', 1), ('A', 2), ('b', 3) AS t(k, i)")
    assert sorted(map(tuple, joined(spark, df, df, ("k", "k")).select("i", "j_i").collect())) == [("1", "1"), ("1", "2"), ("2", "1"), ("2", "2"), ("3", "3")]


def test_cut_joins_in_a_chain(spark, monkeypatch):
    for name, value in {"TASK_ROWS": 50, "GROWTH": 0, "SIDE": 4}.items():
        monkeypatch.setattr(fanout, name, value)
    plan, rows = Plan(), [(i, i % 3) for i in range(24)]
    at = plan.add(view(spark.createDataFrame(rows, "i int, k int")))
    first = plan.add(Join((("k", "k"),), "a"), at, plan.add(Project(("k",)), at))
    df = relation(plan, plan.add(Join((("a_k", "k"),), "b"), first, at), spark=spark)
    want = Counter((str(i), str(k), str(k), str(j), str(k)) for i, k in rows for _, x in rows if x == k for j, y in rows if y == k)
    assert df.columns == ["i", "k", "a_k", "b_i", "b_k"] and Counter(map(tuple, df.collect())) == want


def test_output_is_estimated(spark):
    one, many = spark.range(200_000).select(F.col("id").alias("k")), spark.range(200_000).select((F.col("id") % 20).alias("k"))
    of = lambda x, y: fanout.estimate((x, [F.col("k")]), (y, [F.col("k")]))
    assert of(many, many) == (pytest.approx(20 * 10_000**2, rel=0.1), 400_000)
    assert of(one, one)[0] == pytest.approx(200_000, rel=0.1)
    assert of(one.where("k < 0"), many) == (0, 200_000)


def test_joins_whose_output_is_in_proportion_are_left_to_spark(spark):
    orders = spark.range(3_000_000).select("id", (F.col("id") % 1000).alias("k"))
    assert "explode(sequence" not in joined(spark, orders, spark.range(1000), ("k", "id"))._jdf.queryExecution().toString()
