"""Streaming forms run over the given tables as file streams, to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.plans import check_sql as C, derived as G
from veil.plans.registry import query
from veil.plans.text_queries import BODY, _VERDICT, document_bodies
from veil.session import shared_dir
from veil.streaming import gate as GA, rules_in_time as S, stateful as ST

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a stream takes a single file only by a pattern that finds it."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")


def drain(df: DataFrame) -> DataFrame:
    """Runs a stream over all available input into the shared folder and reads the result back."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = (df.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


def _timed(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(spark, sf):
    """The events, and one far-future record of each type under users of their own: they only move the watermark past the end of the
    input, so that every session, timer and wait of the input is decided. They never become results themselves."""
    events = _timed(spark, sf)
    place = f"{shared_dir(spark)}/end-{uuid.uuid4().hex}"
    end = spark.createDataFrame([(-1, "click"), (-2, "purchase")], "user_id long, event_type string").select(
        *[F.col(f.name).cast(f.dataType) if f.name in ("user_id", "event_type") else F.lit("2200-01-01").cast("timestamp").alias("ts") if f.name == "ts"
          else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    end.write.parquet(place)
    return events.unionByName(spark.readStream.schema(end.schema).parquet(place))


@query("w01_settle_stream", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, count(*) AS mutations, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM s GROUP BY user_id, n""")
def w01(spark, sf):
    found = drain(S.settle_sessions(_closed(spark, sf), "user_id", "ts", "30 minutes", "1 minute"))
    return found.select("user_id", "mutations", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("w01_settle_timer_stream", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
  s AS (SELECT user_id, rn, ms AS f, ms + 1800000 AS due, CAST(NULL AS BIGINT) AS pf, CAST(NULL AS BIGINT) AS pdue FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.ms > s.due THEN e.ms ELSE s.f END, CASE WHEN e.ms > s.due THEN e.ms + 1800000 ELSE least(greatest(e.ms, s.f + 1200000) + 600000, s.f + 3600000) END,
      CASE WHEN e.ms > s.due THEN s.f END, CASE WHEN e.ms > s.due THEN s.due END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1),
  r AS (SELECT user_id, pf AS f, pdue AS due FROM s WHERE pf IS NOT NULL UNION ALL SELECT user_id, f, due FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
  SELECT CAST(user_id AS VARCHAR) AS page, f AS first_ms, due - f < 3600000 AS settled, due - f AS waited_ms FROM r""")
def w01t(spark, sf):
    return drain(ST.settle_stream(_closed(spark, sf), "user_id", "ts", "1 minute", 600_000, 1_200_000, 3_600_000))


@query("w02_effect_stream", "SELECT a.event_id AS action_id, m.event_id AS mutation_id FROM events a JOIN events m ON a.user_id = m.user_id AND a.event_type = 'click' AND m.event_type <> 'click' AND m.ts >= a.ts AND m.ts <= a.ts + INTERVAL 1 HOUR")
def w02(spark, sf):
    actions = _timed(spark, sf).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts"))
    mutations = _timed(spark, sf).filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("mutation_id"), F.col("ts").alias("mutation_ts"))
    return drain(S.effect_join(actions, mutations, "user_id", "action_ts", "mutation_ts", "1 HOUR").select("action_id", "mutation_id"))


@query("w03_evidence_stream", "SELECT a.event_id AS action_id, coalesce(m.event_id, -1) AS signal_id FROM events a LEFT JOIN events m ON a.user_id = m.user_id AND m.event_type = 'purchase' AND m.ts >= a.ts AND m.ts <= a.ts + INTERVAL 3 HOUR WHERE a.event_type = 'click'")
def w03(spark, sf):
    clicks = _closed(spark, sf).filter("event_type = 'click'").select("user_id", F.col("event_id").alias("action_id"), F.col("ts").alias("action_ts"))
    signals = _closed(spark, sf).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("signal_id"), F.col("ts").alias("signal_ts"))
    return drain(S.evidence_join(clicks, signals, "user_id", "action_ts", "signal_ts", "3 HOURS").select("action_id", F.coalesce("signal_id", F.lit(-1)).alias("signal_id")))


@query("w04_redact_stream", "SELECT CAST(conv_id AS VARCHAR) AS scope, turn AS seq, text || ' mail [EMAIL_2] or [EMAIL_' || CAST(CASE WHEN turn = lo THEN 1 ELSE 1 + r END AS VARCHAR) || ']' AS redacted FROM "
       "(SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)")
def w04(spark, sf):
    turns = _stream(spark, sf, "conversations").withColumn("text", F.concat(
        "text", F.lit(" mail c"), F.col("conv_id").cast("string"), F.lit("@mail.example.com or t"), F.col("turn").cast("string"), F.lit("@mail.example.com")))
    return drain(ST.redact_stream(turns, "conv_id", "turn", "text"))


@query("w05_gate_stream", f"SELECT doc_id, CASE WHEN doc_id % 12 = 11 OR reason IS NULL THEN 'allowed' ELSE 'blocked' END AS gate FROM (SELECT doc_id, {_VERDICT} AS reason FROM documents)")
def w05(spark, sf):
    recipe = G.PAYLOADS.split("FROM {documents}")[0].replace("{{", "{").replace("}}", "}").strip()
    _stream(spark, sf, "documents").createOrReplaceTempView("veil_documents_stream")
    return drain(GA.gate_stream(spark.sql(f"{recipe} FROM veil_documents_stream")).select("doc_id", "gate"))


def in_waves(rows: DataFrame, ts: str, by: Column, waves: int, end: DataFrame, late: Column | None = None) -> tuple[DataFrame, str]:
    """A stream that gets ``rows`` out of order, and the watermark under which none is late but those marked.

    Every row is held up by a share (``by``, from 0 up to but not including 1) of a ``waves``-th of the time that the rows span; then they come
    in as many waves, each in files of its own. Rows marked ``late`` come with the last wave, as does ``end``, which moves the watermark past
    the input.
    """
    spark = rows.sparkSession
    span = rows.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    lo, width = span["lo"] or 0, max(1, -(-((span["hi"] or 0) - (span["lo"] or 0)) // waves))
    arrival = F.unix_micros(ts) + (by * width).cast("long")
    wave_of = F.least(F.floor((arrival - lo) / width), F.lit(waves))
    dealt = rows.withColumn("__wave", wave_of if late is None else F.when(late, waves).otherwise(wave_of))
    place = f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}"
    # Every wave has the same number of files, each held by a row without a time, so that a batch is a wave: ``end`` in a batch ahead of
    # its wave would make the rest of the wave late.
    files = max(1, rows.rdd.getNumPartitions())
    at = F.pmod(F.xxhash64(F.unix_micros(ts), by), F.lit(files)).cast("int").alias("__file")
    holders = spark.range(files).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], F.col("id").cast("int").alias("__file"))
    for wave in range(waves + 1):
        part = dealt.where(F.col("__wave") == wave).select(*rows.columns, at).unionByName(holders)
        whole = part.unionByName(end.withColumn("__file", F.lit(0))) if wave == waves else part
        whole.repartitionById(files, "__file").drop("__file").write.mode("append").parquet(place)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(place).where(F.col(ts).isNotNull())
    # Two waves overlap at most: a row lies behind the newest one of an earlier batch by less than two widths.
    return stream, f"{2 * width // 1000 + 1} milliseconds"


def _events_and_end(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    known = {"user_id": F.lit(-1), "event_id": F.lit(-1), "event_type": F.lit("click"), "ts": F.lit("2200-01-01")}
    return events, spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


@query("s12_gate_sinks", f"""WITH src AS (SELECT doc_id AS k, {BODY} AS t FROM documents), {C.leaks('f', 'src')},
  bad AS (SELECT DISTINCT k FROM f UNION SELECT doc_id FROM documents WHERE length(text) > 32000
    UNION SELECT k FROM src WHERE regexp_matches(t, '(?i)data:\\s*image/|base64,|image/(png|jpe?g|webp)|\\bPNG\\b.{{0,4}}IHDR|[A-Za-z0-9+/]{{400,}}'))
  SELECT 'quarantine' AS route, k AS doc_id, CAST(NULL AS BIGINT) AS body_chars FROM bad
  UNION ALL SELECT 'allowed', k, length(t) FROM src WHERE k NOT IN (SELECT k FROM bad)""")
def s12_sinks(spark, sf):
    """Half of the documents come before the stream is stopped, the others after its restart; both places are read back by the manifest."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bodies = document_bodies(spark.read.parquet(f"{sf}/documents.parquet"))
    place = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    for half in (0, 1):
        bodies.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(bodies.schema).parquet(f"{place}/in")
        GA.start_gate(stream, ["doc_id"], f"{place}/allowed", f"{place}/held", f"{place}/manifest", f"{place}/state").awaitTermination()
    read = lambda name: GA.committed(spark, f"{place}/{name}", f"{place}/manifest")
    return read("allowed").select(F.lit("allowed").alias("route"), "doc_id", F.length("body").cast("long").alias("body_chars")).unionByName(
        read("held").select(F.lit("quarantine").alias("route"), "doc_id", F.lit(None).cast("long").alias("body_chars")))


_SIG = "action || '|' || coalesce(target, '∅') || '|' || coalesce(value, '∅')"


@query("w06_loop_stream", f"""WITH s AS (SELECT event_id, task_id, ts, effect, {_SIG} AS sig FROM ({G.as_cte(G.ACTIONS)})), l AS (SELECT *, lag(sig) OVER w AS prev, list(sig) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS seen,
    list(effect) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS eff FROM s WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id))
  SELECT event_id AS seq, coalesce(prev = sig, false) AS repeated, len(list_filter(seen, lambda v: v = sig)) >= 3 AS cycling, len(eff) = 3 AND list_unique(eff) = 1 AND eff[1] = 'no_change' AS stuck FROM l""")
def w06(spark, sf):
    events, end = _events_and_end(spark, sf)
    stream, watermark = in_waves(events, "ts", F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000, 4, end)
    stream.createOrReplaceTempView("veil_events_stream")
    actions = spark.sql(G.ACTIONS.replace("{events}", "veil_events_stream"))
    return drain(ST.loops_stream(actions, "task_id", "ts", "event_id", watermark)).select("seq", "repeated", "cycling", "stuck")


@query("w07_late_and_duplicate", "SELECT event_id FROM events")
def w07(spark, sf):
    twice = _timed(spark, sf).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return drain(S.dedupe_stream(twice, ["event_id"], "ts", "10 minutes").select("event_id"))


_RUN = "epoch_us(ts) // 86400000000 - CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END"


@query("w07_run_generations", f"""WITH span AS (SELECT epoch_us(min(ts)) AS lo, -(-(epoch_us(max(ts)) - epoch_us(min(ts))) // 8) AS width FROM events),
  r AS (SELECT user_id, event_id, {_RUN} AS run, epoch_us(ts) // 1000 AS ms, event_id % 50 = 7 AND epoch_us(ts) < lo + width AS late FROM events, span),
  n AS (SELECT *, max(run) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM r WHERE NOT late)
  SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, run, CASE WHEN run = newest THEN 'kept' ELSE 'superseded' END AS status FROM n
  UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, run, 'late' FROM r WHERE late""")
def w07b(spark, sf):
    """Every fiftieth record of the first eighth comes last and is late; every ninth of the others comes twice."""
    events, end = _events_and_end(spark, sf)
    span = events.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    width = max(1, -(-((span["hi"] or 0) - (span["lo"] or 0)) // 8))
    late = (F.col("event_id") % 50 == 7) & (F.unix_micros("ts") < (span["lo"] or 0) + width)
    copies = events.withColumn("copy", F.explode(F.when(~late & (F.col("event_id") % 9 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    by = F.pmod(F.xxhash64("event_id", "copy"), F.lit(1000)) / 1000
    stream, watermark = in_waves(copies, "ts", by, 8, end.withColumn("copy", F.lit(0)), late)
    run = F.floor(F.unix_micros("ts") / 86_400_000_000) - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return drain(ST.runs_stream(stream.withColumn("run", run), "user_id", "run", "ts", "event_id", watermark))


__all__ = ["drain"]
