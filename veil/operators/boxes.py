"""Joins of boxes on a page, on a coarse grid so that a crowded page is many small groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.detect import find_spans, label_type, matches_shape
from veil.functions.geometry import area, bottom, box, coverage, iou, overlap_x, overlap_y, pad, right, union_box
from veil.functions.text import let, sub, trimmed
from veil.plans.ordered import previous_rows, running_totals, seq_bucket, where
from veil.session import settled

CELL = 256.0


def _cells(b: Column, cell: float) -> Column:
    def steps(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell), F.greatest(F.floor(low / cell), F.floor(high / cell)))

    return F.flatten(F.transform(steps(b["x"], right(b)), lambda cx: F.transform(
        steps(b["y"], bottom(b)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def touching(a: DataFrame, b: DataFrame, page: list[str], reach_a: Column, reach_b: Column, cell: float = CELL) -> DataFrame:
    """Pairs of rows whose reach boxes meet. Each pair is produced once: in the cell of the corner where they begin to meet."""
    left = a.withColumn("__ra", reach_a).select("*", F.explode(_cells(F.col("__ra"), cell)).alias("__c"))
    other = b.withColumn("__rb", reach_b).select("*", F.explode(_cells(F.col("__rb"), cell)).alias("__d"))
    cond = (F.col("__c.cx") == F.col("__d.cx")) & (F.col("__c.cy") == F.col("__d.cy"))
    for p in page:
        other = other.withColumnRenamed(p, f"__{p}")
        cond = cond & (F.col(p) == F.col(f"__{p}"))
    ra, rb = F.col("__ra"), F.col("__rb")
    meet = (overlap_x(ra, rb) >= 0) & (overlap_y(ra, rb) >= 0)
    home = (F.floor(F.greatest(ra["x"], rb["x"]) / cell) == F.col("__c.cx")) & (
        F.floor(F.greatest(ra["y"], rb["y"]) / cell) == F.col("__c.cy"))
    return left.join(other, cond & meet & home).drop("__ra", "__rb", "__c", "__d", *[f"__{p}" for p in page])


def distinct_boxes(boxes: DataFrame, page: list[str], column: str, name: str) -> DataFrame:
    """Copies of a box count once: the pairs below never depend on how often it occurs."""
    return boxes.select(*page, F.col(column).alias(name)).distinct()


def best_match(truth: DataFrame, found: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Per truth box the best IoU with, and the best coverage by, one found box (0 when none)."""
    pairs = touching(distinct_boxes(truth, page, "bbox", "__t"), distinct_boxes(found, page, "bbox", "__f"), page, F.col("__t"), F.col("__f"))
    best = pairs.groupBy(*page, "__t").agg(
        F.max(iou(F.col("__t"), F.col("__f"))).alias("__iou"), F.max(coverage(F.col("__t"), F.col("__f"))).alias("__cover"))
    rows = truth.withColumn("__t", F.col("bbox")).join(best, [*page, "__t"], "left")
    return rows.select(*page, *key, *[c for c in truth.columns if c not in [*page, *key]],
                       F.coalesce("__iou", F.lit(0.0)).alias("iou"), F.coalesce("__cover", F.lit(0.0)).alias("coverage"))


def merge_passes(first: DataFrame, second: DataFrame, page: list[str]) -> DataFrame:
    """First-pass lines and the second-pass lines no confident first-pass line already covers."""
    confident = distinct_boxes(first.filter(F.col("confidence") >= rules.MIN_CONFIDENCE), page, "bbox", "__f")
    fresh = distinct_boxes(second, page, "bbox", "__s")
    pairs = touching(fresh, confident, page, F.col("__s"), F.col("__f"))
    covered = pairs.filter((iou(F.col("__f"), F.col("__s")) > rules.MERGE_IOU) | (
        coverage(F.col("__s"), F.col("__f")) > rules.MERGE_CONTAINMENT)).select(*page, F.col("__s").alias("bbox")).distinct()
    kept = second.filter(F.trim("text") != "").join(covered, [*page, "bbox"], "left_anti").select(*second.columns)
    return first.withColumn("pass", F.lit(1)).unionByName(kept.withColumn("pass", F.lit(2)))


def split_lines(words: DataFrame, line: list[str], factor: float = rules.COLUMN_GAP_FACTOR) -> DataFrame:
    """Words (line keys, line_height, at, text, bbox, confidence) to line pieces, cut at wide horizontal gaps."""
    x = F.col("bbox.x")
    rows = words.withColumn("__x", x)
    ordered = [F.col("__x"), F.col("at")]
    rows = previous_rows(rows, line, seq_bucket(F.col("__x")), ordered, [right(F.col("bbox")).alias("right")], 1, "__prev")
    gap = F.col("__x") - F.get("__prev", 0)["right"]
    rows = rows.withColumn("__cut", F.coalesce(gap > factor * F.col("line_height"), F.lit(False)).cast("int"))
    rows = running_totals(rows, line, seq_bucket(F.col("__x")), ordered, {"piece": F.col("__cut")})
    parts = rows.groupBy(*line, "piece").agg(
        F.array_sort(F.collect_list(F.struct("__x", "at", "text"))).alias("__w"), F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"),
        F.max(right(F.col("bbox"))).alias("r"), F.max(bottom(F.col("bbox"))).alias("b"), F.min("confidence").alias("confidence"))
    return parts.select(*line, "piece", F.array_join(F.transform("__w", lambda w: w["text"]), " ").alias("text"),
                        box(F.col("x"), F.col("y"), F.col("r") - F.col("x"), F.col("b") - F.col("y")).alias("bbox"), "confidence")


# --- values typed by a neighbouring label ----------------------------------------------------------------


def clean_value(text: Column) -> Column:
    return trimmed(sub(trimmed(text), r"^[\[(|]+|[\])|.,;:]+$", ""))


def label_type_of_line(text: Column) -> Column:
    """Type of a short line that is only a label, else null."""
    name = sub(trimmed(text), r"[:\-–]+$", "")
    words = F.size(F.split(name, r"\s+"))
    short = (name != "") & (F.length(name) <= rules.MAX_LABEL_CHARS) & (words <= rules.MAX_LABEL_WORDS)
    # The keyword rules are cheaper than the detector, so only lines that name a type are searched for values.
    kind = let(label_type(name), lambda k: F.when(k.isNotNull() & (F.size(find_spans(text)) == 0), k))
    return F.when(short & ~name.rlike("[0-9]{3,}"), kind)


def neighbour_distance(a: Column, b: Column) -> Column:
    """Distance from a label to a value on its right or below it, null when they are no pair."""
    row_gap, stack_gap = b["x"] - right(a), b["y"] - bottom(a)
    row = (overlap_y(a, b) >= rules.MIN_ROW_OVERLAP * F.least(a["height"], b["height"])) & row_gap.between(0, rules.MAX_ROW_GAP)
    stack = (overlap_x(a, b) >= rules.MIN_COLUMN_OVERLAP * F.least(a["width"], b["width"])) & stack_gap.between(0, rules.MAX_STACK_GAP)
    return F.when(row, row_gap).when(stack, rules.MAX_ROW_GAP + stack_gap)


#: Pages with more label-value candidates than this are paired in rounds instead of in one array.
SMALL_PAGE = 5000


def layout_candidates(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, label, value_line, distance, type, value): every admissible label-value pair."""
    kinds = lines.withColumn("__kind", label_type_of_line(F.col("text")))
    labels = where(kinds, F.col("__kind").isNotNull()).select(*page, F.col("line").alias("label"), F.col("__kind").alias("type"), F.col("bbox").alias("__a"))
    values = where(kinds, F.col("__kind").isNull()).select(*page, F.col("line").alias("value_line"), clean_value(F.col("text")).alias("value"), F.col("bbox").alias("__b"))
    a = F.col("__a")
    reach = box(a["x"], a["y"], a["width"] + rules.MAX_ROW_GAP, a["height"] + rules.MAX_STACK_GAP)
    pairs = touching(labels, values, page, reach, F.col("__b"))
    return (pairs.withColumn("distance", neighbour_distance(F.col("__a"), F.col("__b")))
            .filter(F.col("distance").isNotNull() & matches_shape(F.col("type"), F.col("value")))
            .select(*page, "label", "value_line", "distance", "type", "value"))


def layout_values(lines: DataFrame, page: list[str], small: int = SMALL_PAGE) -> DataFrame:
    """Values typed by a label line; labels choose in line order, each value line is claimed once."""
    pairs = settled(layout_candidates(lines, page))
    crowded = pairs.groupBy(*page).agg(F.count("*").alias("__n")).filter(F.col("__n") > small)
    if crowded.isEmpty():
        return _claim_in_row(pairs, page)
    return _claim_in_row(pairs.join(crowded, page, "left_anti"), page).unionByName(
        _claim_in_rounds(pairs.join(crowded, page, "left_semi").drop("__n"), page))


def _claim_in_row(pairs: DataFrame, page: list[str]) -> DataFrame:
    edge = F.struct("label", "distance", "value_line", "type", "value")
    none = F.slice(F.col("edges"), 1, 0)
    chosen = F.aggregate("edges", none, lambda acc, e: F.when(
        F.exists(acc, lambda t: (t["label"] == e["label"]) | (t["value_line"] == e["value_line"])), acc).otherwise(F.array_append(acc, e)))
    folded = pairs.groupBy(*page).agg(F.array_sort(F.collect_list(edge)).alias("edges")).select(*page, F.explode(chosen).alias("e"))
    return folded.select(*page, F.col("e.value_line").alias("line"), F.col("e.type").alias("type"), F.col("e.value").alias("value"))


def _claim_in_rounds(pairs: DataFrame, page: list[str]) -> DataFrame:
    """The same choice without a page ever meeting in one task: in each round a label takes its best value when no
    earlier undecided label could want that value; at least the first undecided label of every page decides."""
    live, done = pairs, None
    while not live.isEmpty():
        best = live.groupBy(*page, "label").agg(F.min(F.struct("distance", "value_line", "type", "value")).alias("b"))
        first = live.groupBy(*page, "value_line").agg(F.min("label").alias("__first"))
        sure = best.select(*page, "label", F.col("b.value_line").alias("value_line"), F.col("b.type").alias("type"), F.col("b.value").alias("value")).join(
            first, [*page, "value_line"]).filter(F.col("__first") == F.col("label")).drop("__first")
        sure = settled(sure)
        live = settled(live.join(sure.select(*page, "label"), [*page, "label"], "left_anti").join(
            sure.select(*page, "value_line"), [*page, "value_line"], "left_anti"))
        done = sure if done is None else done.unionByName(sure)
    return done.select(*page, F.col("value_line").alias("line"), "type", "value")


def visual_pii(lines: DataFrame, page: list[str], layout: DataFrame | None = None) -> DataFrame:
    """In-line matches, and layout matches not already present for the same line and value."""
    spans = lines.select(*page, "line", F.explode_outer(find_spans(F.col("text"))).alias("s")).filter(F.col("s").isNotNull())
    inline = spans.select(*page, "line", F.col("s.type").alias("type"), F.col("s.value").alias("value"), F.lit("text").alias("source"))
    placed = layout if layout is not None else layout_values(lines, page)
    extra = placed.withColumn("source", F.lit("layout")).join(inline.select(*page, "line", "value"), [*page, "line", "value"], "left_anti")
    return inline.unionByName(extra)


# --- mask regions ----------------------------------------------------------------------------------------------


def mask_regions(words: Column, line_box: Column, values: Column) -> Column:
    """One region per value of a line: the union of its words (each used once), else the whole line."""
    def digits(text: Column) -> Column:
        return F.regexp_replace(text, "[^0-9]", "")

    def plain(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), "[^a-z0-9@.]+", "")

    placed = F.transform(words, lambda w, i: F.struct(i.alias("i"), digits(w["text"]).alias("digits"), plain(w["text"]).alias("plain"), w["bbox"].alias("bbox")))
    # What a value is looked for by, once a value: its digits where it is a number, else its letters.
    wanted = F.transform(F.transform(values, lambda v: F.struct(v.alias("v"), digits(v).alias("digits"))), lambda v: F.struct(
        v["digits"].alias("digits"), plain(v["v"]).alias("plain"),
        ((F.length(v["digits"]) >= 3) & (F.length(v["digits"]) == F.length(F.regexp_replace(v["v"], r"[\s-]", "")))).alias("numeric")))
    state = F.struct(F.array().cast("array<int>").alias("used"),
                     F.array().cast("array<struct<x:double,y:double,width:double,height:double>>").alias("out"))

    def step(held: Column) -> Callable[[Column, Column], Column]:
        def found(acc: Column, value: Column) -> Column:
            def hit(w: Column) -> Column:
                number = (F.length(w["digits"]) >= 3) & F.contains(value["digits"], w["digits"])
                name = (w["plain"] != "") & (F.contains(value["plain"], w["plain"]) | F.contains(w["plain"], value["plain"]))
                return ~F.array_contains(acc["used"], w["i"]) & F.when(value["numeric"], number).otherwise(name)

            return let(F.filter(held, hit), lambda mine: F.struct(
                F.concat(acc["used"], F.transform(mine, lambda w: w["i"])).alias("used"),
                F.array_append(acc["out"], F.coalesce(union_box(F.transform(mine, lambda w: w["bbox"])), line_box)).alias("out")))

        return found

    regions = let(placed, lambda held: F.aggregate(wanted, state, step(held), lambda acc: acc["out"]))
    return F.when(F.size(values) == 0, F.array(line_box)).otherwise(regions)


def pad_regions(regions: Column, by: float = rules.MASK_PADDING) -> Column:
    return F.transform(regions, lambda r: pad(r, by))


__all__ = ["area", "touching", "best_match", "merge_passes", "split_lines", "layout_values", "visual_pii", "mask_regions", "pad_regions"]
