"""Run logs and ground truth from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRUTH = (
    "case string, task string, expected_target string, expected_text array<string>, canvas_only_text array<string>, "
    "expected_prices array<struct<amount:double,text:string,format:string,size:int,bg:string,canvas:boolean>>, "
    "expected_buttons array<string>, button_styles map<string,string>, "
    "expected_pii array<struct<type:string,value:string,where:string,layout:string,visible:boolean>>, "
    "non_pii array<string>, extra_text array<string>"
)
BOXES = "case string, page string, scale int, boxes array<struct<kind:string,text:string,x:double,y:double,width:double,height:double,amount:double>>"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One multi-line JSON file per case."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def ground_truth_from(df: DataFrame, column: str) -> DataFrame:
    """The same from a JSON column."""
    return df.select("*", F.from_json(column, TRUTH).alias("__t")).select(*[c for c in df.columns if c != column], "__t.*")


def truth_boxes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(BOXES).option("multiLine", True).json(path)
    return rows.select("case", F.posexplode("boxes").alias("box", "b")).select(
        "case", "box", "b.kind", "b.text", "b.amount", F.struct("b.x", "b.y", "b.width", "b.height").alias("bbox"))


def expected_pii(truth: DataFrame) -> DataFrame:
    return truth.select("case", F.explode("expected_pii").alias("p")).select("case", "p.type", "p.value", "p.where", "p.layout", F.coalesce("p.visible", F.lit(True)).alias("visible"))


def expected_prices(truth: DataFrame) -> DataFrame:
    p = F.col("p")
    kind = F.coalesce(p["format"], F.when(p["text"].rlike("(?i)rs|inr"), "Rs/INR").otherwise("rupee-sign"))
    return truth.select("case", F.posexplode("expected_prices").alias("item", "p")).select("case", "item", p["amount"].alias("amount"), p["text"].alias("text"), kind.alias("format"))


def number_in(text: Column) -> Column:
    """Number in a text such as '812 ms'."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def run_log(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Runs with their metric texts as numbers, rounds (1 when absent) and a cold flag (an engine load was timed)."""
    rows = df.withColumn(metrics, F.transform_values(metrics, lambda _k, v: number_in(v)))
    load, rounds = F.try_element_at(F.col(metrics), F.lit("OCR load")), F.try_element_at(F.col(metrics), F.lit("Round"))
    return rows.withColumn("rounds", F.coalesce(F.nullif(rounds, F.lit(0.0)), F.lit(1.0)).cast("int")).withColumn("cold", F.coalesce(load > 0, F.lit(False)))


def bounded_log(df: DataFrame, run: list[str], order: list[Column], n: int) -> DataFrame:
    """Only the most recent messages of a run."""
    from veil.plans.ordered import top_per_key
    return top_per_key(df, run, order, n)
