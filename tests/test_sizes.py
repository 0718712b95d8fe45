"""What grows with the input: long texts are written and measured once, and rows move no oftener than they need to."""

from pyspark.sql import functions as F

from loomstrand.functions import text
from loomstrand.operators import fitting


def test_units_of_odd_texts(spark):
    odd = ["", "a", "é\n", "👍", "x👍" * 3000, "\U00010000\U0010ffff", "￿", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").select("i", text.utf16_length("s").alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [None if s is None else len(s.encode("utf-16-le")) // 2 for s in odd]


def test_group_inputs_write_an_item_once_and_keep_to_its_session(spark):
    rows = spark.range(64).select((F.col("id") % 4).alias("session_id"), F.floor(F.col("id") / 16).alias("group_id"), F.col("id").alias("pos")).repartition("session_id")
    calls = F.array(F.struct(F.lit("tool").alias("name"), F.col("pos").cast("string").alias("arguments")))
    kind = F.when(F.col("pos") % 3 == 0, "assistant/message").when(F.col("pos") % 3 == 1, "tool/result").otherwise("user/message")
    item = fitting.input_item(kind, F.col("pos"), F.lit("c"), F.repeat(F.lit("👍"), F.col("pos").cast("int")), calls)
    made = fitting.group_inputs(rows.select("session_id", "group_id", "pos", item.alias("item")), 3_000, 400, "Sum up.")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") == 1
    out = made.collect()
    assert len(out) == 16 and sum(r["items"] for r in out) == 43 and sum(r.fitting for r in out) == 43
