"""Scores against ground truth and statistics over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veil import rules
from veil.functions.text import compact, digits_of, normalize


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 3)


def line_matches(text: Column, corpus: Column) -> Column:
    """Every word of three or more characters with a letter occurs in the (normalised) corpus."""
    words = F.filter(F.split(normalize(text), " "), lambda w: (F.length(w) >= 3) & w.rlike("[a-z]"))
    return F.forall(words, lambda w: F.contains(corpus, w))


def line_precision(lines: DataFrame, corpus: DataFrame, case: list[str], by: list[str]) -> DataFrame:
    """Share of read lines that are correct, by any columns of the lines. ``corpus(case, corpus)`` is normalised truth text."""
    rows = lines.join(corpus, case).withColumn("__ok", line_matches(F.col("text"), F.col("corpus")))
    return rows.groupBy(*by).agg(F.count_if("__ok").alias("correct"), F.count("*").alias("total")).withColumn(
        "precision", ratio(F.col("correct"), F.col("total")))


def word_precision(lines: DataFrame, words: DataFrame, line_keys: list[str], reach: int = 8) -> DataFrame:
    """Per line whether each of its words lies within a word of the corpus, for a corpus shared by all cases.

    A word holds no blank, so it occurs in the corpus text exactly if an ending of one of its words begins with it. Endings are as many as
    the corpus has letters. Words of up to ``reach`` characters meet the distinct beginnings (``reach`` at most an ending) by an equi-join.
    A longer word is put among the sorted endings that share its first ``reach`` characters: the next one in order begins with it, or none does.
    """
    own = F.filter(F.array_distinct(F.split(normalize(F.col("text")), " ")), lambda w: (F.length(w) >= 3) & w.rlike("[a-z]"))
    each_word = lines.select(*line_keys, F.explode_outer(own).alias("word"))
    size = F.length("word")
    endings = words.select("word").filter(size >= 3).distinct().select(F.explode(F.transform(
        F.sequence(F.lit(1), size - 2), lambda i: F.substring(F.col("word"), i, size))).alias("word")).distinct()
    starts = endings.select(F.explode(F.transform(F.sequence(F.lit(3), F.least(size, F.lit(reach))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("word")).distinct()
    long = each_word.filter(size > reach).select("word").distinct().withColumn("__end", F.lit(None).cast("string"))
    table = long.unionByName(endings.filter(size > reach).select("word", F.col("word").alias("__end")))
    # Downwards, endings before equal words: the last ending so far is the next one above the word.
    above = Window.partitionBy(F.left("word", F.lit(reach))).orderBy(F.desc("word"), F.desc_nulls_last("__end"))
    near = table.withColumn("__next", F.last("__end", ignorenulls=True).over(above.rowsBetween(Window.unboundedPreceding, 0)))
    known = starts.unionByName(near.filter(F.col("__end").isNull() & F.col("__next").startswith(F.col("word"))).select("word"))
    return each_word.join(known.withColumn("__known", F.lit(True)), "word", "left").groupBy(*line_keys).agg(
        (F.count_if(F.col("word").isNotNull() & F.col("__known").isNull()) == 0).alias("correct"))


def item_recall(items: DataFrame, read: DataFrame, case: list[str]) -> DataFrame:
    """Expected items found in the case's read text without regard to spaces. ``read(case, text)`` is one row per case."""
    text = read.select(*case, compact(F.col("text")).alias("__read"))
    return items.join(text, case, "left").withColumn("found", F.coalesce(F.contains("__read", compact(F.col("item"))), F.lit(False))).drop("__read")


def price_scores(truth: DataFrame, amounts: DataFrame, case: list[str], key: list[str], bounded: bool = True) -> DataFrame:
    """Expected amounts read exactly, or recoverable: a read amount ends with the expected one, at most one digit longer.

    The candidates are equi-joined on the digits that must agree, so a case with many amounts is not compared pairwise.
    """
    wanted = truth.withColumn("__w", F.col("amount").cast("long").cast("string"))
    seen = amounts.select(*case, F.col("amount").cast("long").cast("string").alias("__a")).distinct()
    cut = F.sequence(F.lit(0), F.least(F.lit(1), F.length("__a") - 1)) if bounded else F.sequence(F.lit(0), F.length("__a") - 1)
    tails = seen.select(*case, "__a", F.explode(cut).alias("__k")).select(
        *case, F.substring("__a", F.col("__k") + 1, F.length("__a")).alias("__w"), (F.col("__k") == 0).alias("__exact"))
    best = tails.groupBy(*case, "__w").agg(F.bool_or("__exact").alias("exact"))
    rows = wanted.join(best, [*case, "__w"], "left")
    return rows.select(*case, *key, *[c for c in truth.columns if c not in [*case, *key]], F.coalesce("exact", F.lit(False)).alias("exact"),
                       F.col("exact").isNotNull().alias("recoverable"))


def recall_by(rows: DataFrame, by: list[str], found: str = "found") -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(found).alias("found"), F.count("*").alias("expected")).withColumn(
        "recall", ratio(F.col("found"), F.col("expected")))


def best_boxes(truth: DataFrame, found: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Per truth box its best IoU and coverage, ``matched`` (IoU >= 0.5) and ``covered`` (coverage >= 0.9)."""
    from veil.operators.boxes import best_match
    best = best_match(truth, found, page, key)
    return best.withColumn("matched", F.col("iou") >= rules.IOU_MATCH).withColumn("covered", F.col("coverage") >= rules.COVER_MATCH)


def value_key(value: Column) -> Column:
    """Equal for the same value: by digits when it has four or more and nothing but number signs, else in any case."""
    digits = digits_of(value)
    numeric = value.rlike(r"^[\d\s+()-]+$") & (F.length(digits) >= 4)
    return F.when(numeric, digits).otherwise(F.lower(F.trim(value)))


def pii_scores(truth: DataFrame, found: DataFrame, case: list[str], by: list[str]) -> DataFrame:
    """TP, FP, FN, precision and recall per group by a full outer join on (case, canonical value)."""
    t = truth.select(*case, *by, value_key(F.col("value")).alias("__v")).distinct().withColumn("__t", F.lit(True))
    f = found.select(*case, *by, value_key(F.col("value")).alias("__v")).distinct().withColumn("__f", F.lit(True))
    rows = t.join(f, [*case, *by, "__v"], "full_outer")
    counts = rows.groupBy(*by).agg(F.count_if(F.col("__t") & F.col("__f")).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"),
                                   F.count_if(F.col("__f").isNull()).alias("fn"))
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def channel_scores(cases: DataFrame, by: list[str]) -> DataFrame:
    """Per channel from one row per case (blocked, expected, missed, withheld_non_pii, lost_non_pii, placeholders): a blocked
    case is all true positives with the withheld non-PII counted apart; placeholders beyond the hits are false positives."""
    blocked = F.col("blocked")
    tp = F.when(blocked, F.col("expected")).otherwise(F.col("expected") - F.col("missed"))
    extra = F.greatest(F.lit(0), F.col("placeholders") - tp - F.col("lost_non_pii"))
    rows = cases.select(*by, tp.alias("tp"), F.when(blocked, 0).otherwise(F.col("lost_non_pii") + extra).alias("fp"),
                        F.when(blocked, 0).otherwise(F.col("missed")).alias("fn"), blocked.cast("long").alias("blocked"),
                        F.when(blocked, F.col("withheld_non_pii")).otherwise(0).alias("withheld"))
    sums = rows.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "blocked", "withheld")])
    return sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def redaction_scores(cases: DataFrame, by: list[str]) -> DataFrame:
    """Removal rate, precision of removal and preserved share from summed counts."""
    sums = cases.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("removed", "missed", "non_sensitive_removed", "preserved", "to_preserve")])
    return (sums.withColumn("sensitive_removed", ratio(F.col("removed"), F.col("removed") + F.col("missed")))
            .withColumn("precision", ratio(F.col("removed"), F.col("removed") + F.col("non_sensitive_removed")))
            .withColumn("preserved_share", ratio(F.col("preserved"), F.col("to_preserve"))))


def line_scores(spans: DataFrame, expected: DataFrame, case: list[str]) -> DataFrame:
    """Older line-level form: a line with detections is a true positive if it holds an expected key of a matched type."""
    truth = expected.select(*case, "type", value_key(F.col("value")).alias("__v")).distinct().withColumn("__ok", F.lit(True))
    hits = spans.withColumn("__v", value_key(F.col("value"))).join(truth, [*case, "type", "__v"], "left")
    ok = F.coalesce("__ok", F.lit(False))
    per_line = hits.groupBy(*case, "line").agg(F.bool_or(ok).alias("tp"))
    return per_line.groupBy(*case).agg(F.count_if("tp").alias("tp"), F.count_if(~F.col("tp")).alias("fp"))


def latency_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, mean, upper median, 95th percentile by nearest rank (null under 5 values), max.

    The order statistics come from a frequency table of distinct values and its running total per group, cut into buckets
    whose bounds are quantiles of the values, so one large group never meets in one task.
    """
    from veil.plans.ordered import running_totals, value_buckets
    freq = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("f"))
    basic = freq.groupBy(*by).agg(F.sum("f").alias("n"), F.min("v").alias("min"), F.sum(F.col("v") * F.col("f")).alias("__s"), F.max("v").alias("max"))
    cum = running_totals(freq, by, value_buckets(freq, F.col("v"))(F.col("v")), [F.col("v")], {"upto": F.col("f")})
    rows = cum.join(basic.select(*by, "n"), by)
    at_median = F.floor(F.col("n") / 2) + 1
    at_p95 = F.ceil(F.col("n") * 0.95 - 1e-9)
    picks = rows.groupBy(*by).agg(F.min(F.when(F.col("upto") >= at_median, F.col("v"))).alias("median"),
                                  F.min(F.when(F.col("upto") >= at_p95, F.col("v"))).alias("p95"))
    out = basic.join(picks, by)
    return out.select(*by, "n", "min", F.round(F.col("__s") / F.col("n"), 3).alias("mean"), "median",
                      F.when(F.col("n") >= 5, F.col("p95")).alias("p95"), "max")


def stage_share(runs: DataFrame, metrics: str = "metrics", total: str = "Total") -> DataFrame:
    """Mean time of each stage over the mean total, in percent with one decimal; a run without a stage counts as zero."""
    n = runs.agg(F.count("*").alias("n"), F.sum(F.try_element_at(F.col(metrics), F.lit(total))).alias("t"))
    stages = runs.select(F.explode(metrics).alias("stage", "ms")).filter(F.col("stage") != total).groupBy("stage").agg(F.sum("ms").alias("s"))
    return stages.withColumn("__one", F.lit(1)).join(n.withColumn("__one", F.lit(1)), "__one").select("stage", F.round(F.try_divide(F.col("s") / F.col("n"), F.col("t") / F.col("n")) * 100, 1).alias("percent"))


def compare(before: DataFrame, after: DataFrame, metric: str = "metric") -> DataFrame:
    """Two result sets (metric, part, whole) side by side, as fraction and percent."""
    def side(df: DataFrame, name: str) -> DataFrame:
        share = F.format_string("%.1f%%", F.try_divide(F.col("part"), F.col("whole")) * 100)
        return df.select(metric, F.concat(F.col("part").cast("string"), F.lit("/"), F.col("whole").cast("string")).alias(name),
                         F.when(F.col("whole") > 0, share).otherwise("n/a").alias(f"{name}_pct"))

    return side(before, "before").join(side(after, "after"), metric, "full_outer")


def cold_warm(runs: DataFrame, kind: str, cold: str, value: str) -> DataFrame:
    """Statistics of successful one-round runs: all of a kind, and split into cold and warm."""
    good = runs.filter(F.col("success") & (F.col("rounds") == 1))
    both = good.select(kind, F.explode(F.array(F.lit("all"), F.when(F.col(cold), "cold").otherwise("warm"))).alias("set"), value)
    return latency_stats(both, [kind, "set"], value)


def result_rows(area: str, df: DataFrame, metric: Column, value: Column) -> DataFrame:
    return df.select(F.lit(area).alias("area"), metric.alias("metric"), value.cast("double").alias("value"))


def write_results(rows: DataFrame, path: str) -> None:
    """Summary split by area, one JSON folder each."""
    rows.write.mode("overwrite").partitionBy("area").json(path)


def report(rows: DataFrame) -> DataFrame:
    """Table lines rendered from stored results only."""
    return rows.select("area", F.concat(F.lit("| "), F.concat_ws(" | ", "area", "metric", F.col("value").cast("string")), F.lit(" |")).alias("line"))

