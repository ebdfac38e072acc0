"""Nested engine output (blocks, paragraphs, lines, words) to flat lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil.functions.geometry import union_box
from veil.functions.text import one_space

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
ENGINE = (
    "struct<blocks:array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:" + _BOX
    + ",words:array<struct<text:string,confidence:double,bbox:" + _BOX + ">>>>>>>>>"
)


def _confidence(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.0))
    return F.round(F.least(F.greatest(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0)), F.lit(1.0)), 2)


def _bbox(b: Column, scale: float) -> Column:
    # Halves round up, as the engine's coordinates do.
    def near(v: Column) -> Column:
        return F.floor(v / scale + 0.5).cast("double")

    made = F.struct(near(b["x0"]).alias("x"), near(b["y0"]).alias("y"), near(b["x1"] - b["x0"]).alias("width"), near(b["y1"] - b["y0"]).alias("height"))
    return F.when((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), made)


def ocr_lines(df: DataFrame, keys: list[str], column: str = "ocr", scale: float = 1.0) -> DataFrame:
    """(keys, line, text, bbox, confidence, words). Blank or degenerate parts are dropped; a line without text or box takes its words'."""
    def clean(t: Column) -> Column:
        return one_space(F.coalesce(t, F.lit("")))

    lines = F.flatten(F.flatten(F.transform(F.from_json(column, ENGINE)["blocks"], lambda b: F.transform(
        F.coalesce(b["paragraphs"], F.array()), lambda p: F.coalesce(p["lines"], F.array())))))
    rows = df.select(*keys, F.posexplode(lines).alias("line", "l"))
    words = F.filter(F.transform(F.coalesce("l.words", F.array()), lambda w: F.struct(
        clean(w["text"]).alias("text"), _bbox(w["bbox"], scale).alias("bbox"), _confidence(w["confidence"]).alias("confidence"))),
        lambda w: (w["text"] != "") & w["bbox"].isNotNull())
    rows = rows.withColumn("words", words)
    text = F.coalesce(F.nullif(clean(F.col("l.text")), F.lit("")), F.array_join(F.transform("words", lambda w: w["text"]), " "))
    bbox = F.coalesce(_bbox(F.col("l.bbox"), scale), union_box(F.transform("words", lambda w: w["bbox"])))
    out = rows.select(*keys, "line", text.alias("text"), bbox.alias("bbox"), _confidence(F.col("l.confidence")).alias("confidence"), "words")
    return out.filter((F.col("text") != "") & F.col("bbox").isNotNull())
