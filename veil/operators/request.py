"""Whole outgoing requests: one vault over all their parts, the sanitised body, its placeholders and its verdict.

A request is taken apart into rows (scope, seq, path, text), one for every text that leaves, in the order in which values are registered;
the rows are redacted together (``redact``) and put back by their paths. Values of form fields and of located lines are known before any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.text import let
from veil.operators.redact import redact
from veil.operators.verify import KNOWN, _json_text, verify
from veil.session import settled, splits_for

PART = "array<struct<path:string,text:string,label:string>>"

#: The parts of a request. ``label`` is the field context of an element: it stands before the element's text while that is redacted.
REQUEST = """request_id bigint, task string, url string, title string, text string, guidance string,
  elements array<struct<id:string,tag:string,text:string,role:string,label:string,context:string,options:array<string>>>,
  visual struct<engine:string,observations:array<struct<type:string,text:string,bbox:struct<x:bigint,y:bigint,width:bigint,height:bigint>,confidence:bigint,target:string>>,conflicts:array<string>>,
  history array<struct<action:string,target:string,value:string,effect:string,note:string>>,
  fields array<struct<type:string,value:string>>, lines array<struct<type:string,value:string>>"""


def _one(path: str, text: str) -> Column:
    return F.array(F.struct(F.lit(path).alias("path"), F.col(text).alias("text"), F.lit("").alias("label"))).cast(PART)


def _at(*steps: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(s) if isinstance(s, str) else s.cast("string") for s in steps])


def _list(items: Column, of) -> Column:
    """Parts of every item of an array, in order; none of an absent array."""
    return F.coalesce(F.flatten(F.transform(items, of)), F.array()).cast(PART)


def _element(e: Column, i: Column) -> Column:
    part = lambda path, text, label: F.struct(path.alias("path"), text.alias("text"), label.alias("label"))
    options = F.transform(F.coalesce(e["options"], F.array().cast("array<string>")), lambda o, k: part(_at("elements", i, "options", k), o, F.lit("")))
    return F.concat(F.array(part(_at("elements", i, "text"), e["text"], F.coalesce(e["label"], F.lit(""))),
                            part(_at("elements", i, "context"), e["context"], F.lit(""))), options).cast(PART)


def kept_history(history: Column) -> Column:
    """The last actions that a request carries."""
    return F.slice(history, F.greatest(F.size(history) - rules.HISTORY_KEPT, F.lit(0)) + 1, rules.HISTORY_KEPT)


def parts(requests: DataFrame) -> DataFrame:
    """(request_id, seq, path, text, label): every text of a request, in the order of registration. Absent parts have no row."""
    part = lambda path, text: F.struct(path.alias("path"), text.alias("text"), F.lit("").alias("label"))
    seen = _list(F.col("visual.observations"), lambda o, i: F.array(part(_at("visual", i), o["text"])))
    past = _list(kept_history(F.col("history")), lambda h, i: F.array(part(_at("history", i, "value"), h["value"]), part(_at("history", i, "note"), h["note"])))
    every = F.concat(_one("task", "task"), _one("url", "url"), _one("title", "title"), _list(F.col("elements"), _element), _one("text", "text"), seen, past,
                     _one("guidance", "guidance"))
    return requests.select("request_id", F.posexplode(every).alias("seq", "p")).where("p.text IS NOT NULL").select(
        "request_id", F.col("seq").cast("long").alias("seq"), "p.path", "p.text", "p.label")


def seeds(requests: DataFrame) -> DataFrame:
    """Values known before any text: fields first, then located lines."""
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(KNOWN)) for c in ("fields", "lines")])
    return requests.select(F.col("request_id").alias("scope"), F.posexplode(every).alias("at", "v")).select(
        "scope", (F.col("at") - 1_000_000_000).cast("long").alias("seq"), "v.type", "v.value").where("trim(value) <> ''")


def redacted_parts(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, path, redacted), and the vault (scope, type, value, placeholder, order of registration).

    An element's text is redacted behind its label. Where that changes the label itself, the bare text is redacted instead: a second run over
    the requests concerned only.
    """
    rows, known = settled(parts(requests)), seeds(requests)
    prefix = F.when((F.col("label") != "") & (F.col("text") != ""), F.concat("label", F.lit(": "))).otherwise(F.lit(""))
    rows = rows.withColumn("prefix", prefix).withColumn("whole", F.concat("prefix", "text"))

    def run(some: DataFrame, seeds_: DataFrame) -> tuple[DataFrame, DataFrame]:
        done, vault = redact(some, ["path"], "whole", "request_id", "seq", seeds_)
        return settled(done.select("request_id", "path", "seq", "prefix", "redacted", F.col("redacted").startswith(F.col("prefix")).alias("clear"))), vault

    done, vault = run(rows, known)
    broken = settled(done.where("NOT clear").select("request_id", "path"))
    if not broken.isEmpty():
        again = broken.select("request_id").distinct()
        bare = rows.join(again, "request_id", "left_semi").join(broken.withColumn("__bare", F.lit(True)), ["request_id", "path"], "left")
        bare = bare.withColumn("prefix", F.when(F.col("__bare"), F.lit("")).otherwise(F.col("prefix"))).withColumn("whole", F.concat("prefix", "text")).drop("__bare")
        scopes = again.withColumnRenamed("request_id", "scope")
        second, own = run(bare, known.join(scopes, "scope", "left_semi"))
        done = done.join(again, "request_id", "left_anti").unionByName(second)
        vault = vault.join(scopes, "scope", "left_anti").unionByName(own)
    return done.select("request_id", "path", F.substring(F.col("redacted"), F.length("prefix") + 1, F.length("redacted")).alias("redacted")), vault


def _members(*pairs: Column) -> Column:
    """A JSON object of members that may be null (absent)."""
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _member(name: str, json: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), json)


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def sanitize(requests: DataFrame) -> DataFrame:
    """(request_id, body, placeholders, known, verdict, reason) of every request of the shape ``REQUEST``.

    The body is JSON in the closed contract: absent optional parts vanish, required nulls stay, values and notes of the history and the guidance
    are cut after redaction. ``placeholders`` are in order of registration, ``known`` holds their values for the verification (local use only).
    """
    rows, vault = redacted_parts(requests)
    texts = rows.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "redacted"))).alias("__t"))
    held = vault.groupBy(F.col("scope").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct(
        "seq", "pass", "back", "placeholder", "type", "value"))).alias("__v"))
    df = settled(requests.join(texts, "request_id", "left").join(held, "request_id", "left"))
    df = df.repartition(splits_for(df))
    nothing = F.array().cast("array<struct<seq:bigint,pass:int,back:int,placeholder:string,type:string,value:string>>")
    df = df.withColumn("__v", F.coalesce("__v", nothing)).withColumn("__t", F.coalesce("__t", F.create_map().cast("map<string,string>")))
    got = lambda *steps: F.try_element_at(F.col("__t"), _at(*steps))
    text = lambda *steps: F.coalesce(got(*steps), F.lit(""))
    keep = {"ignoreNullFields": "false"}

    def element(e: Column, i: Column) -> Column:
        options = F.transform(e["options"], lambda _o, k: text("elements", i, "options", k))
        return F.to_json(F.struct(e["id"].alias("id"), e["tag"].alias("tag"), text("elements", i, "text").alias("text"), e["role"].alias("role"),
                                  got("elements", i, "context").alias("context"), options.alias("options")))

    def past(h: Column, i: Column) -> Column:
        base = F.to_json(F.struct(h["action"].alias("action"), h["target"].alias("target"),
                                  F.left(got("history", i, "value"), F.lit(rules.MAX_HISTORY_VALUE)).alias("value")), keep)
        more = F.to_json(F.struct(h["effect"].alias("effect"), F.left(got("history", i, "note"), F.lit(rules.MAX_NOTE)).alias("note")))
        inner = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
        return F.concat(F.lit("{"), F.concat_ws(",", inner(base), F.nullif(inner(more), F.lit(""))), F.lit("}"))

    def seen(o: Column, i: Column) -> Column:
        return F.to_json(F.struct(o["type"].alias("type"), text("visual", i).alias("text"), o["bbox"].alias("bbox"), o["confidence"].alias("confidence"),
                                  o["target"].alias("target")), keep)

    elements = F.coalesce(_json_list(F.transform("elements", element)), F.lit("[]"))
    page = _members(*[_member(c, _json_text(text(c))) for c in ("url", "title")], _member("elements", elements), _member("text", _json_text(text("text"))))
    visual = _members(_member("engine", _json_text(F.col("visual.engine"))), _member("observations", _json_list(F.transform("visual.observations", seen))),
                      _member("conflicts", F.to_json("visual.conflicts")))
    marks = F.transform("__v", lambda v: v["placeholder"])
    history = F.when(F.size("history") > 0, _json_list(F.transform(kept_history(F.col("history")), past)))
    guidance = F.when(F.col("guidance") != "", _json_text(F.left(text("guidance"), F.lit(rules.MAX_GUIDANCE))))
    body = _members(_member("task", _json_text(text("task"))), _member("page", page), _member("placeholders", F.to_json(marks)),
                    _member("visual", F.when(F.col("visual").isNotNull(), visual)), _member("history", history), _member("guidance", guidance))
    known = F.transform("__v", lambda v: F.struct(v["type"].alias("type"), v["value"].alias("value")))
    out = settled(df.select("request_id", body.alias("body"), marks.alias("placeholders"), known.alias("known")))
    return verify(out, "body", "known").select("request_id", "body", "placeholders", "known", "verdict", "reason")
