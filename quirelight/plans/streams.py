"""The streaming jobs, run over the events as they lie in files until nothing is left, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as X
from ..sources.fixtures import sql
from ..sources.shared import new_folder
from ..streaming import streams as S
from .units import _TIME, _activity, _need, _shows


SLICES = 4


#: Rows come up to so many microseconds late, each by its own hash; less than any watermark here.
LATE = 1_800_000_000


def _source(spark, df, at: str, time: str):
    """df as a stream, out of order: written once to the shared folder in SLICES slices by time of arrival, one after the other, each of them
    by learner in as many files as there are partitions; read in several micro-batches, oldest files first."""
    us = F.unix_micros(F.col(time).cast("timestamp")).cast("double") + F.pmod(F.xxhash64(*df.columns), F.lit(LATE))
    # written first, since the cuts and each slice would make df anew
    df.withColumn("_us", us).write.parquet(f"{at}/all")
    rows, us = spark.read.parquet(f"{at}/all"), F.col("_us")
    cuts = rows.select(us.alias("us")).stat.approxQuantile("us", [k / SLICES for k in range(1, SLICES)], 0.01) or [0.0] * (SLICES - 1)
    edges = [float("-inf"), *cuts, float("inf")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for low, high in zip(edges, edges[1:], strict=False):
        rows.filter((us >= low) & (us < high)).drop("_us").repartition(parts, "learner_id").write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(f"{at}/in")


def _drain(spark, out, at: str):
    """Run a stream to its end and read what it wrote; a last watermark move closes windows up to it."""
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def _moves(spark, d):
    """The shows and activities of u21 one by one; what is hidden after the last event is not known yet."""
    shows, acts = _shows(spark, d), _activity(spark, d)
    last = acts.agg(F.max("at").alias("end"))
    page = ["book_id", "page"]
    opened = shows.select("learner_id", F.col("shown").alias("ts"), F.col("view_id").alias("move_id"), F.lit("show").alias("kind"), *page)
    closed = shows.join(F.broadcast(last)).filter("hidden <= end").select("learner_id", F.col("hidden").alias("ts"), F.col("view_id").alias("move_id"), F.lit("hide").alias("kind"), *page)
    active = acts.select("learner_id", F.col("at").alias("ts"), F.col("event_id").alias("move_id"), F.lit("active").alias("kind"), *[F.lit(-1).alias(c) for c in page])
    return opened.unionByName(closed).unionByName(active)


def x1(spark, d):
    at = new_folder(spark)
    need = _need(spark, d).withColumn("chars", F.col("chars") * 10)
    return _drain(spark, S.stream_page_reads(_source(spark, _moves(spark, d), at, "ts"), need, 3600.0), at).select("learner_id", "book_id", "page")


def _views(spark, d):
    e = X.table(spark, d, "events")
    return e.select(F.col("user_id").alias("learner_id"), X._k().cast("int").alias("page"), "ts", F.col("event_id").alias("view_id"))


def x2(spark, d):
    at = new_folder(spark)
    return _drain(spark, S.stream_sessions(_source(spark, _views(spark, d), at, "ts"), "2 hours"), at)


def x3(spark, d):
    at = new_folder(spark)
    rows = X.page_reads(spark, d).join(X.units(spark, d).select("unit_id", "book_id"), "unit_id").select("learner_id", "book_id", "seen", F.col("dwell_ms").alias("ms"))
    return _drain(spark, S.stream_reading_time(_source(spark, rows, at, "seen"), zones=X.zones(spark, d)), at)


def x4(spark, d):
    """Reviews, one in ten of them sent twice."""
    at = new_folder(spark)
    rows = X.reviews(spark, d)
    twice = rows.select("*", F.explode(F.when(F.col("review_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
    cards = S.stream_card_states(_source(spark, twice, at, "review"))
    query = cards.writeStream.outputMode("update").foreachBatch(S.write_card_states(f"{at}/states")).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return S.latest_states(spark.read.parquet(f"{at}/states")).withColumns({c: F.round(c, 6) for c in ("stability", "difficulty")})


def x5(spark, d):
    at = new_folder(spark)
    reads = X.reads(spark, d).select("learner_id", "block_id", "seen")
    return _drain(spark, S.stream_units_finished(_source(spark, reads, at, "seen"), X.blocks(spark, d)), at)


def x6(spark, d):
    at = new_folder(spark)
    return _drain(spark, S.stream_review_load(_source(spark, X.reviews(spark, d), at, "review")), at).withColumn("kept", F.round("kept", 6))


QUERIES = {"x1_page_reads": x1, "x2_sessions": x2, "x3_reading_time": x3, "x4_card_state": x4, "x5_units_finished": x5, "x6_review_load": x6}

from .srs import _STATES, fold  # noqa: E402
from .units import _DONE, dwell  # noqa: E402

ORACLE = {
    "x1_page_reads": None,
    "x2_sessions": "SELECT learner_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS views FROM (SELECT learner_id, ts, sum(g) OVER (PARTITION BY learner_id ORDER BY ts, event_id) AS s FROM (SELECT user_id AS learner_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS g FROM events)) GROUP BY learner_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "x3_reading_time": sql("SELECT * FROM rt WHERE day + INTERVAL 1 DAY <= (SELECT max((seen AT TIME ZONE 'UTC') AT TIME ZONE tz) - INTERVAL 50 HOUR FROM times JOIN zones USING (learner_id) WHERE ms > 0 AND ms <= 3600000)", "page_reads", "units", "zones", more=_TIME),
    "x4_card_state": sql(_STATES, "reviews", more=fold()),
    "x5_units_finished": sql("SELECT * FROM done WHERE epoch_us(finished_at) < (SELECT epoch_us(max(seen)) // 1000 * 1000 - 3600000000 FROM reads)", "reads", more=_DONE),
    "x6_review_load": sql("SELECT learner_id, CAST(day AS DATE) AS day, count(*) AS n, round(avg(CAST(rating > 1 AS INTEGER)), 6) AS kept FROM (SELECT *, unnest(range(date_trunc('day', review) - INTERVAL 6 DAY, date_trunc('day', review) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM reviews) WHERE day + INTERVAL 7 DAY <= (SELECT max(review) - INTERVAL 1 DAY FROM reviews) GROUP BY ALL", "reviews"),
}
# moves behind the last watermark, an hour before the last event (in whole milliseconds), count
ORACLE["x1_page_reads"] = sql("SELECT learner_id, book_id, page FROM told WHERE read", "blocks", more=dwell("(SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)", 10))
