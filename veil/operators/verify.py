"""Independent verification of outgoing bodies, the gate, and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.payload import check_image, check_known, check_patterns, check_structure
from veil.plans.ordered import sealed
from veil.session import settled

KNOWN = "array<struct<type:string,value:string>>"


def to_payload(task: Column, page: Column, placeholders: Column, visual: Column | None = None,
               history: Column | None = None, guidance: Column | None = None) -> Column:
    """One JSON body. Required nulls stay, absent optional blocks vanish."""
    keep = {"ignoreNullFields": "false"}
    parts = [
        F.concat(F.lit('"task":'), _json_text(task)),
        F.concat(F.lit('"page":'), F.to_json(page, keep)),
        F.concat(F.lit('"placeholders":'), F.to_json(placeholders, keep)),
    ]
    for name, block in (("visual", visual), ("history", history)):
        if block is not None:
            parts.append(F.when(block.isNotNull(), F.concat(F.lit(f'"{name}":'), F.to_json(block, keep))))
    if guidance is not None:
        parts.append(F.when(guidance.isNotNull(), F.concat(F.lit('"guidance":'), _json_text(guidance))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _json_text(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, 6, F.length(whole) - 6)


def verify(df: DataFrame, body: str = "body", known: str | None = None) -> DataFrame:
    """Adds verdict, type, reason and the checks run; the first failing check ends the list."""
    values = F.coalesce(F.col(known), F.array().cast(KNOWN)) if known else F.array().cast(KNOWN)
    text = F.col(body)
    empty = text.isNull() | (text == "")
    rows = df.withColumn("__s", F.when(~empty, check_structure(text)))
    go = ~empty & F.col("__s").isNull()
    rows = rows.withColumn("__i", F.when(go, check_image(text)))
    go = go & F.col("__i").isNull()
    rows = rows.withColumn("__k", F.when(go, check_known(text, values)))
    go = go & F.col("__k").isNull()
    rows = rows.withColumn("__p", F.when(go, check_patterns(text)))
    broken = F.col("__s") == "verification error (fail closed)"
    reason = (
        F.when(empty, F.lit("payload is not a serialized string"))
        .when(F.col("__s").isNotNull(), F.col("__s")).when(F.col("__i").isNotNull(), F.col("__i"))
        .when(F.col("__k").isNotNull(), F.concat("__k", F.lit(" leakage detected")))
        .when(F.col("__p").isNotNull(), F.concat("__p", F.lit(" pattern detected"))))

    def check(name: str, failed: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(failed).isNull().alias("passed"))

    ran = F.array(check("structure", "__s"), check("image-data", "__i"), check("known-values", "__k"), check("patterns", "__p"))
    count = (F.when(empty | F.coalesce(broken, F.lit(False)), 0).when(F.col("__s").isNotNull(), 1)
             .when(F.col("__i").isNotNull(), 2).when(F.col("__k").isNotNull(), 3).otherwise(4))
    rows = (rows.withColumn("reason", reason).withColumn("checks", F.slice(ran, F.lit(1), count))
            .withColumn("verdict", F.when(F.col("reason").isNull(), "allowed").otherwise("blocked"))
            .withColumn("type", F.when(F.col("reason").isNotNull(), F.coalesce("__k", "__p", F.lit("UNKNOWN")))))
    return sealed(rows.drop("__s", "__i", "__k", "__p"), ["verdict", "reason", "type", "checks"])


def gate(df: DataFrame, body: str = "body", known: str | None = None) -> DataFrame:
    """Two verifications: with the known values where the body is made, and without them at the boundary."""
    inner = verify(df, body, known)
    why = F.when(F.col("reason").isNotNull(), F.concat(F.lit(rules.BLOCK_PREFIX + ": "), F.col("reason")))
    inner = inner.withColumn("__verdict", F.col("verdict")).withColumn("__why", why).drop("verdict", "reason", "type", "checks")
    outer = verify(inner.withColumn("__body", F.when(F.col("__verdict") == "allowed", F.col(body))), "__body")
    passed = (F.col("__verdict") == "allowed") & (F.col("verdict") == "allowed")
    late = F.concat(F.lit(rules.BLOCK_PREFIX + ": "), F.col("reason"))
    return (outer.withColumn("gate", F.when(passed, "allowed").otherwise("blocked"))
            .withColumn("gate_reason", F.when(~passed, F.coalesce("__why", late)))
            .drop("__verdict", "__why", "__body", "verdict", "reason", "type", "checks"))


def write_gated(gated: DataFrame, keys: list[str], allowed_path: str, quarantine_path: str, body: str = "body",
                mode: str = "append") -> None:
    """Allowed bodies to one place, value-free reasons to the other; nothing else is written. Each row is decided once."""
    decided = settled(gated.select(*keys, "gate", "gate_reason", F.when(F.col("gate") == "allowed", F.col(body)).alias(body)))
    allowed = decided.filter(F.col("gate") == "allowed").select(*keys, body)
    held = decided.filter(F.col("gate") == "blocked").select(*keys, "gate_reason")
    allowed.write.mode(mode).parquet(allowed_path)
    held.write.mode(mode).parquet(quarantine_path)


def network_audit(df: DataFrame, body: str = "body", known: str | None = None) -> DataFrame:
    """Per request: size, fields, placeholders and whether raw values, image data or long base64 runs are present."""
    text = F.col(body)
    values = F.coalesce(F.col(known), F.array().cast(KNOWN)) if known else F.array().cast(KNOWN)
    return df.select(
        *[c for c in df.columns if c not in (body, known)],
        F.octet_length(text).cast("long").alias("bytes"),
        F.array_join(F.json_object_keys(text), ",").alias("fields"),
        F.array_join(F.from_json(F.get_json_object(text, "$.placeholders"), "array<string>"), ",").alias("placeholders"),
        F.length(F.get_json_object(text, "$.page.text")).cast("long").alias("page_text_chars"),
        F.exists(values, lambda e: F.contains(text, e["value"])).alias("raw_value_present"),
        text.rlike(r"(?i)data:image|base64,|image/(png|jpe?g)").alias("image_data_present"),
        text.rlike("[A-Za-z0-9+/]{400,}").alias("base64_run_present"),
    )
