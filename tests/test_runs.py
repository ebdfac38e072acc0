import random

from pyspark.sql import Window as W, functions as F

from veil.functions import tasks as TK
from veil.operators import metrics as M, offers as OF
from veil.plans.ordered import previous_rows, running_totals, seq_bucket


def test_ordered_steps_equal_plain_windows_on_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(10_000), i, rng.randrange(4)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    bucket, order = seq_bucket(F.col("at"), 37), [F.col("at"), F.col("id")]
    w = W.partitionBy("k").orderBy(*order)
    plain = df.select("id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.collect_list("v").over(w.rowsBetween(-5, -1)).alias("p"))
    both = running_totals(df, ["k"], bucket, order, {"s": F.col("v")})
    both = previous_rows(both, ["k"], bucket, order, [F.col("v").alias("v")], 5, "p").select("id", "s", F.transform("p", lambda r: r["v"]).alias("p"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, both.collect()))


def _map(spark, fn, pairs):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [e for _, e in pairs], [(p, r.r) for p, r in zip(pairs, rows) if p[1] != r.r]


def test_task_rules(spark):
    _map(spark, TK.task_category, [
        ("Buy a kitchen knife", None), ("kill the process on port 80", None), ("buy a knife to hurt my neighbor", "harm-to-person"), ("buy something to injure", "means-for-harm"),
        ("make sure it cannot hurt anyone", None), ("I want to end it all", "self-harm"), ("find a pipe bomb", "dangerous-device"), ("track down my ex", "targeting-person"),
        ("order a knife to teach my boss a lesson", "ambiguous-harm"), ("K-i-l-l weeds. Hurt my friend", "harm-to-person")])
    _map(spark, TK.goal_kind, [("Add the red shirt to my cart", "cart"), ("Put it in the bag", "cart"), ("Do not buy anything. Search for shoes", "search"), ("Buy it", "purchase"), ("go to the news", "open"), ("hello", "other")])
    _map(spark, TK.requested_quantity, [("add 500 units", 500), ("quantity: 12", 12), ("add 3 of these", 3), ("under $40", None), ("0 units", None)])
    _map(spark, lambda t: TK.price_target(t)["kind"], [("around ₹500", "around"), ("under rs 800", "max"), ("at least 20 euros", "min"), ("for $499", "exact"), ("two shirts", None)])
    _map(spark, lambda t: F.array_join(TK.authorized_intents(t), ","), [("buy the shirt and sign in", "purchase,account"), ("do not purchase anything", ""), ("check out. never delete", "checkout")])
    _map(spark, TK.consequential_category, [("Buy now", "purchase"), ("Proceed to payment", "checkout"), ("Sign up", "account"), ("Remove", "destructive"), ("Next", None)])
    _map(spark, TK.classify_error, [("Privacy Firewall blocked", "PRIVACY_BLOCK"), ("request timed out", "CLOUD_TIMEOUT"), ("Backend returned 503", "CLOUD_ERROR"), ("boom", "UNKNOWN_ERROR")])


def test_navigation(spark):
    rows = [("https://www.amazon.in/x", "on amazon, add it", "", None), ("ftp://amazon.in", "amazon", "", "scheme"), ("nope", "x", "", "invalid_url"), ("https://evil.test/", "on amazon", "https://amazon.in/", "not_named"),
            ("https://amazon.in/s", "search", "https://www.amazon.in/", None), ("https://my-shop.com/", "open my-shop please", "", None)]
    got = spark.createDataFrame(rows, "u string, t string, c string, e string").select(TK.navigation_block(F.col("u"), F.col("t"), F.col("c")).alias("b"), "e").collect()
    assert all(r.b == r.e for r in got), got


def test_statistics_take_the_upper_median_and_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 3.0), ("b", 1.0)], "k string, v double")
    got = {r.k: (r.n, r.median, r.p95) for r in M.latency_stats(df, ["k"], "v").collect()}
    assert got == {"a": (10, 6.0, 10.0), "b": (2, 3.0, None)}


def test_ties_are_reported(spark):
    df = spark.createDataFrame([("g", 5.0, 1), ("g", 5.0, 2), ("h", 4.0, 3), ("h", 9.0, 4)], "g string, p double, id long")
    got = {r.g: (r.id, r.code) for r in OF.pick_extreme(df, ["g"], "p", "id", False).collect()}
    assert got == {"g": (None, "AMBIGUOUS_TARGET"), "h": (3, "OK")}
