"""Streams against their batch twins, with rows out of order, pages side by side and cards reviewed late and twice."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirelight.operators import srs as R
from quirelight.operators import units as U
from quirelight.streaming import streams as S

START = datetime(2024, 1, 1, 8)


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, tmp_path, rows, schema, make, mode="append", batches=6, delay=25, time=0):
    """rows (time first in order of arrival by a random delay of up to `delay` minutes) as a stream of several batches; all output rows with the
    number of their batch."""
    rng = random.Random(1)
    arrived = sorted(rows, key=lambda r: r[time] + timedelta(minutes=rng.random() * delay))
    size = -(-len(arrived) // batches)
    for k in range(batches):
        spark.createDataFrame(arrived[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = []
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_two_visible_pages_both_gain(spark):
    shows = [(1, "a", 5, at(0), at(10)), (1, "a", 6, at(0), at(10)), (1, "b", 5, at(10), at(12)), (2, "a", 5, at(0), at(1)), (3, "a", 1, at(0), at(9))]
    acts = [(1, at(0)), (1, at(1)), (1, at(8)), (1, at(8)), (2, at(-1)), (2, at(5))]
    need = [("a", 5, 1000), ("a", 6, 100_000), ("b", 5, 100)]
    df = U.page_dwell(
        spark.createDataFrame(shows, "learner_id long, book_id string, page int, shown timestamp, hidden timestamp"), spark.createDataFrame(acts, "learner_id long, at timestamp"),
        spark.createDataFrame(need, "book_id string, page int, chars int"), 90.0,
    )
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in df.collect()}
    # active from 0:00 to 2:30 and from 8:00 to 9:30
    assert got[1, "a", 5] == (240.0, True) and got[1, "a", 6] == (240.0, True) and got[1, "b", 5] == (0.0, False)
    assert got[2, "a", 5] == (30.0, True) and got[3, "a", 1] == (0.0, False)


def test_page_reads_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    moves, shows, acts, no = [], [], [], 0
    for learner in (1, 2, 3):
        t = 0.0
        while t < 600:
            book, page, end = rng.choice("ab"), rng.randrange(40), t + rng.random() * 4
            for p in (page, page + 1):
                shows.append((learner, book, p, at(t), at(end)))
                moves += [(at(t), learner, no, "show", book, p), (at(end), learner, no, "hide", book, p)]
            for _ in range(rng.randrange(3)):
                no += 1
                a = at(t + rng.random() * 6)
                acts.append((learner, a))
                moves.append((a, learner, no, "active", "", -1))
            no, t = no + 1, end
    # the last moves push the watermark over all others
    moves += [(at(5000), 9, no + k, "active", "", -1) for k in range(2)]
    need = spark.createDataFrame([(b, p, 1000 * p) for b in "ab" for p in range(0, 41, 2)], "book_id string, page int, chars int")  # not every page has text
    batch = U.page_dwell(
        spark.createDataFrame(shows, "learner_id long, book_id string, page int, shown timestamp, hidden timestamp"), spark.createDataFrame(acts, "learner_id long, at timestamp"), need, 90.0
    )
    got = run(spark, tmp_path, moves, "ts timestamp, learner_id long, move_id long, kind string, book_id string, page int", lambda m: S.stream_page_reads(m, need, 90.0))
    assert sorted(r[1:4] for r in got) == sorted(tuple(r)[:3] for r in batch.filter("read").collect())
    assert len({r[0] for r in got}) > 1 and batch.filter("not read").count() > 0


def test_units_finished_in_event_time(spark, tmp_path):
    rng = random.Random(5)
    blocks = spark.createDataFrame([(b, b // 10, b % 7) for b in range(80)], "block_id long, unit_id long, weight int")
    reads = [(at(rng.random() * 900), learner, b) for learner in (1, 2, 3) for b in range(80) if rng.random() < 0.93]
    reads += [(reads[k][0] + timedelta(minutes=3), *reads[k][1:]) for k in range(0, 60, 3)]  # read again
    rows = spark.createDataFrame(reads, "seen timestamp, learner_id long, block_id long")
    want = {tuple(r) for r in U.units_finished(rows.groupBy("learner_id", "block_id").agg(F.min("seen").alias("seen")), blocks).collect()}
    end = [(at(9000), 9, 0)]
    got = run(spark, tmp_path, reads + end, "seen timestamp, learner_id long, block_id long", lambda r: S.stream_units_finished(r, blocks))
    assert {r[1:] for r in got} == want and len(got) == len(want) > 10


def test_units_finish_by_every_read_and_however_long_it_takes(spark, tmp_path):
    blocks = spark.createDataFrame([(10, 1, 4), (11, 1, 4), (12, 1, 4), (20, 2, 0), (30, 3, 1)], "block_id long, unit_id long, weight int").localCheckpoint()
    day = 1440
    # unit 1 is begun in January and ended in July; unit 3 lies a millisecond behind the last watermark, which a unit without weight moves
    reads = [(at(0), 7, 10), (at(1), 7, 11), (at(80 * day), 8, 20), (at(150 * day), 8, 20), (at(180 * day), 7, 12), (at(190 * day), 8, 30), (at(190 * day + 60) + timedelta(milliseconds=1), 8, 20)]
    got = run(spark, tmp_path, reads, "seen timestamp, learner_id long, block_id long", lambda r: S.stream_units_finished(r, blocks), delay=0, batches=7)
    assert sorted(r[1:] for r in got) == [(7, 1, at(180 * day)), (8, 3, at(190 * day))]


def test_card_states_with_late_and_repeated_reviews(spark, tmp_path):
    rng = random.Random(6)
    log = [(at(rng.random() * 60 * 24 * 20), 1 + k % 2, k % 9, k, rng.randint(1, 4)) for k in range(400)]
    schema = "review timestamp, learner_id long, card_id long, review_id long, rating int"
    want = {tuple(r)[:2]: tuple(r)[2:] for r in R.replay(spark.createDataFrame(log, schema)).collect()}
    got = run(spark, tmp_path, log + log[::10], schema, S.stream_card_states, "update")
    last = {}
    for k, *r in got:
        last[tuple(r[:2])] = max(last.get(tuple(r[:2]), (-1,)), (k, *r[2:]))
    assert last.keys() == want.keys()
    for key, (_, *r) in last.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[:2], want[key][:2], strict=True)) and tuple(r[2:]) == want[key][2:]


def test_step_values_is_step(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        card, t = R.NEW, 0
        for _ in range(rng.randrange(4)):
            t += rng.choice([1, 60, 86400, 86400 * 9]) * 1_000_000
            card = R.step_values(card, rng.randint(1, 4), t)
        rows.append((card, rng.randint(1, 4), t + rng.choice([5, 86400 * 3]) * 1_000_000))
    df = spark.createDataFrame(rows, f"c {R.STATE}, rating int, at long")
    got = [tuple(r[0]) for r in df.select(R.step(F.col("c"), F.col("rating"), F.col("at")).cast(R.STATE)).collect()]
    for g, (card, rating, t) in zip(got, rows, strict=True):
        w = R.step_values(card, rating, t)
        assert all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(g[:2], w[:2], strict=True)) and g[2:] == w[2:]


def test_state_of_cards_and_units_is_kept_by_learner(spark, tmp_path):
    def grouping(found):
        plan = found._jdf.queryExecution().analyzed().toString()
        return re.sub(r"#\d+L?", "", re.search(r"FlatMapGroupsInPandasWithState .*?\)#\d+, \[(.*?)\]", plan).group(1))

    stream = lambda schema: spark.readStream.schema(schema).parquet(str(tmp_path))
    assert grouping(S.stream_card_states(stream("review timestamp, learner_id long, card_id long, review_id long, rating int"))) == "learner_id"
    blocks = spark.createDataFrame([(1, 1, 1)], "block_id long, unit_id long, weight int")
    assert grouping(S.stream_units_finished(stream("seen timestamp, learner_id long, block_id long"), blocks)) == "learner_id"


def test_learners_share_entries_of_the_state_store(spark, tmp_path):
    """A call for each learner costs more than its steps; each learner's pages are still its own."""
    moves = []
    for who in range(60):
        moves += [(at(who), who, 10 * who, "active", "", -1), (at(who), who, 10 * who + 1, "show", "a", who % 5), (at(who + 1), who, 10 * who + 2, "hide", "a", who % 5)]
    moves.append((at(5000), 99, 999, "active", "", -1))
    need = spark.createDataFrame([("a", 4, 100_000)], "book_id string, page int, chars int")
    found = []
    listen = type("Seen", (spark_listener(),), {"onQueryStarted": lambda s, e: None, "onQueryIdle": lambda s, e: None, "onQueryTerminated": lambda s, e: None, "onQueryProgress": lambda s, e: found.extend(x.numRowsTotal for x in e.progress.stateOperators)})()
    spark.streams.addListener(listen)
    try:
        got = run(spark, tmp_path, moves, "ts timestamp, learner_id long, move_id long, kind string, book_id string, page int", lambda m: S.stream_page_reads(m, need, 90.0, groups=7), delay=0)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listen)
    assert sorted(r[1:4] for r in got) == sorted((who, "a", who % 5) for who in range(60))
    assert found and max(found) <= 7


def spark_listener():
    from pyspark.sql.streaming.listener import StreamingQueryListener

    return StreamingQueryListener


def test_a_stream_of_a_query_makes_its_rows_once(spark, tmp_path):
    from quirelight.plans.streams import _source

    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    rows = [(k % 5, at(k), k) for k in range(200)]
    df = spark.createDataFrame(rows, "learner_id long, seen timestamp, v long").withColumn("v", F.udf(count, "long").asNondeterministic()("v"))
    _source(spark, df, f"file://{tmp_path}", "seen")
    assert made.value == 200
    assert sorted((r[0], r[1], r[2]) for r in spark.read.parquet(f"file://{tmp_path}/in").collect()) == sorted(rows)
