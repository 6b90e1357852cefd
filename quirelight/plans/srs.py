"""Queries of spaced repetition, over reviews made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import srs as R
from ..sources import fixtures as X
from ..sources.fixtures import sql

AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"


def _as_of():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")



def states(spark, d):
    """Card states; every third card is pending, and each learner has ten cards never reviewed."""
    seen = R.replay(X.reviews(spark, d))
    new = seen.select("learner_id").distinct().select("learner_id", F.explode(F.sequence(F.lit(100).cast("long"), F.lit(109).cast("long"))).alias("card_id"))
    both = seen.unionByName(new.withColumn("state", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("status", F.when(F.col("card_id") % 3 == 0, "pending").otherwise("active")).withColumn("unit_id", F.col("card_id") % 7)


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def r1(spark, d):
    recall = R.retrievability(F.col("stability"), F.col("state"), F.col("last_review"), _as_of())
    return R.replay(X.reviews(spark, d)).select("learner_id", "card_id", F.round(recall, 6).alias("recall"))


def r2(spark, d):
    """One step from a card's first review."""
    rows = X.reviews(spark, d)
    x = R.step(R.empty_state(), F.col("rating"), F.unix_micros("review"))
    y = rows.withColumn("x", x.cast(R.STATE)).select("review_id", R.step(F.col("x"), F.lit(3), F.unix_micros("review") + 3 * R.DAY).alias("y"))
    return y.select("review_id", F.round("y.s", 6).alias("stability"), F.round("y.d", 6).alias("difficulty"), "y.state")


def _due(spark, d):
    return R.due_cards(states(spark, d), _as_of())


def _fresh(spark, d):
    return R.fresh_cards(states(spark, d), X.reviews(spark, d), _as_of(), per_day=5, zones=X.zones(spark, d))


def r11(spark, d):
    new = X.blocks(spark, d).select(F.col("block_id").alias("card_id"), "book_id", F.when(F.col("block_id") % 2 == 0, F.col("block_id")).alias("block_id"), (F.col("page") + 1).alias("page"))
    by_page = X.blocks(spark, d).groupBy("book_id", "page").agg(F.min("unit_id").alias("unit_id"))
    return R.create_cards(new, X.blocks(spark, d), by_page)


QUERIES = {
    "r1_retrievability": r1,
    "r2_fsrs_step": r2,
    "r3_replay": lambda spark, d: _round(R.replay(X.reviews(spark, d)), "stability", "difficulty"),
    "r4_undo_last": lambda spark, d: _round(R.replay(R.undo_last(X.reviews(spark, d))), "stability", "difficulty"),
    "r5_preview": lambda spark, d: R.preview(R.replay(X.reviews(spark, d)), _as_of()),
    "r6_due_cards": lambda spark, d: _due(spark, d).select("learner_id", "place", "card_id"),
    "r7_fresh_cards": lambda spark, d: _fresh(spark, d).select("learner_id", "place", "card_id"),
    "r8_review_queue": lambda spark, d: R.review_queue(_due(spark, d), _fresh(spark, d), limit=20),
    "r9_card_stats": lambda spark, d: _round(R.card_stats(states(spark, d), X.reviews(spark, d), _as_of(), X.zones(spark, d)), "retention"),
    "r10_due_forecast": lambda spark, d: R.due_forecast(states(spark, d), _as_of(), zones=X.zones(spark, d)),
    "r11_create_cards": r11,
    "r13_review_durations": lambda spark, d: _round(R.review_durations(X.reviews(spark, d)), "mean_ms"),
}

_W = R.WEIGHTS
_FACTOR = 0.9 ** (-1 / _W[20]) - 1
_E = 2.718281828459045
_F0 = [min(10.0, max(1.0, _W[4] - _E ** (_W[5] * (g - 1)) + 1)) for g in (1, 2, 3, 4)]
_EASY = _W[4] - _E ** (_W[5] * 3) + 1


def _f(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _case(r: str, v) -> str:
    return f"CASE {r} WHEN 1 THEN {_f(v[0])} WHEN 2 THEN {_f(v[1])} WHEN 3 THEN {_f(v[2])} ELSE {_f(v[3])} END"


def sql_step(source: str, keep: str) -> str:
    """Rows of source (keep, s, d, state, reps, lapses, last, rating, at) with the state after the review."""
    w = [_f(x) for x in _W]
    return f"""SELECT {keep}, s2 AS s, d2 AS d, CAST(CASE WHEN lapsed THEN 3 WHEN learning THEN CASE WHEN state = 3 THEN 3 ELSE 1 END ELSE 2 END AS INTEGER) AS state, reps + 1 AS reps, lapses + CAST(lapsed AS INTEGER) AS lapses, at_ AS last,
 at_ + CASE WHEN lapsed THEN 600000000 WHEN learning THEN CASE rating WHEN 1 THEN 60000000 WHEN 2 THEN 360000000 ELSE 600000000 END ELSE CAST(greatest(1, round(s2 / {_f(_FACTOR)} * {_f(R.RETENTION ** (-1 / _W[20]) - 1)})) AS BIGINT) * 86400000000 END AS due
 FROM (SELECT *, state = 2 AND rating = 1 AS lapsed, state <> 2 AND (rating <= 2 OR (state = 0 AND rating = 3)) AS learning,
  CASE WHEN state = 0 THEN {_case('rating', _F0)} ELSE greatest(1.0, least(10.0, {w[7]} * {_f(_EASY)} + (1 - {w[7]}) * (d - {w[6]} * (rating - 3) * (10 - d) / 9))) END AS d2,
  CASE WHEN state = 0 THEN {_case('rating', _W[:4])} ELSE greatest(0.001, CASE WHEN days = 0 THEN CASE WHEN rating >= 3 THEN greatest(s, s * exp({w[17]} * (rating - 3 + {w[18]})) * pow(s, -{w[19]})) ELSE s * exp({w[17]} * (rating - 3 + {w[18]})) * pow(s, -{w[19]}) END
   WHEN rating = 1 THEN least(s, {w[11]} * pow(d, -{w[12]}) * (pow(s + 1, {w[13]}) - 1) * exp({w[14]} * (1 - r)))
   ELSE s * (1 + exp({w[8]}) * (11 - d) * pow(s, -{w[9]}) * (exp({w[10]} * (1 - r)) - 1) * {_case('rating', (1.0, _W[15], 1.0, _W[16]))}) END) END AS s2
  FROM (SELECT *, CASE WHEN state = 0 THEN 1.0 ELSE pow(1 + {_f(_FACTOR)} * days / s, -{w[20]}) END AS r FROM (SELECT *, CASE WHEN last IS NULL THEN 0 ELSE greatest(0, (at_ - last) // 86400000000) END AS days FROM {source})))"""


_ZERO = "CAST(0.0 AS DOUBLE) AS s, CAST(0.0 AS DOUBLE) AS d, CAST(0 AS INTEGER) AS state, 0 AS reps, 0 AS lapses, CAST(NULL AS BIGINT) AS last"


def fold(log: str = "reviews") -> dict[str, str]:
    """Common table expressions up to st: the states that a review log leaves."""
    return {
        "lg": f"SELECT learner_id, card_id, rating, epoch_us(review) AS at_, row_number() OVER (PARTITION BY learner_id, card_id ORDER BY review, review_id) AS k FROM {log}",
        "fd": f"SELECT learner_id, card_id, CAST(0 AS BIGINT) AS k, {_ZERO}, CAST(NULL AS BIGINT) AS due FROM (SELECT DISTINCT learner_id, card_id FROM lg) UNION ALL "
        + sql_step("(SELECT fd.learner_id, fd.card_id, lg.k, fd.s, fd.d, fd.state, fd.reps, fd.lapses, fd.last, lg.rating, lg.at_ FROM fd JOIN lg ON fd.learner_id = lg.learner_id AND fd.card_id = lg.card_id AND lg.k = fd.k + 1)", "learner_id, card_id, k"),
        "st": "SELECT learner_id, card_id, s AS stability, d AS difficulty, state, CAST(reps AS INTEGER) AS reps, CAST(lapses AS INTEGER) AS lapses, make_timestamp(last) AS last_review, make_timestamp(due) AS due FROM fd QUALIFY row_number() OVER (PARTITION BY learner_id, card_id ORDER BY k DESC) = 1",
    }


_ALL = {
    **fold(),
    "cs": """SELECT *, CASE WHEN card_id % 3 = 0 THEN 'pending' ELSE 'active' END AS status, card_id % 7 AS unit_id FROM (SELECT * FROM st UNION ALL BY NAME SELECT learner_id, unnest(range(100, 110)) AS card_id, 0 AS state FROM (SELECT DISTINCT learner_id FROM st))""",
    "du": f"SELECT learner_id, card_id, row_number() OVER (PARTITION BY learner_id ORDER BY CAST(state = 2 AS INTEGER), due, card_id) - 1 AS place FROM cs WHERE status = 'active' AND state <> 0 AND due <= {AS_OF}",
    "mid": f"SELECT learner_id, (date_trunc('day', ({AS_OF} AT TIME ZONE 'UTC') AT TIME ZONE tz) AT TIME ZONE tz) AT TIME ZONE 'UTC' AS midnight FROM zones",
    "bg": f"SELECT learner_id, count(*) AS begun FROM (SELECT learner_id, card_id, min(review) AS f FROM reviews GROUP BY ALL) JOIN mid USING (learner_id) WHERE f >= midnight AND f <= {AS_OF} GROUP BY learner_id",
    "fr": "SELECT learner_id, card_id, place FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY unit_id, card_id) - 1 AS place FROM cs WHERE status = 'active' AND state = 0) LEFT JOIN bg USING (learner_id) WHERE place < 5 - coalesce(begun, 0)",
}
_STATES = "SELECT learner_id, card_id, round(stability, 6) AS stability, round(difficulty, 6) AS difficulty, state, reps, lapses, last_review, due FROM st"
_RECALL = f"pow(1 + {_f(_FACTOR)} * greatest(0, floor((epoch_us({AS_OF}) - epoch_us(last_review)) / 86400000000)) / stability, -{_f(_W[20])})"

ORACLE = {
    "r1_retrievability": sql(f"SELECT learner_id, card_id, round({_RECALL}, 6) AS recall FROM st", "reviews", more=fold()),
    "r2_fsrs_step": sql(
        "SELECT review_id, round(s, 6) AS stability, round(d, 6) AS difficulty, state FROM b",
        "reviews",
        more={
            "a": sql_step(f"(SELECT review_id, {_ZERO}, rating, epoch_us(review) AS at_ FROM reviews)", "review_id"),
            "b": sql_step("(SELECT review_id, s, d, state, reps, lapses, last, 3 AS rating, last + 3 * 86400000000 AS at_ FROM a)", "review_id"),
        },
    ),
    "r3_replay": sql(_STATES, "reviews", more=fold()),
    "r4_undo_last": sql(_STATES, "reviews", more={"less": "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY learner_id, card_id ORDER BY review DESC, review_id DESC) > 1", **fold("less")}),
    "r5_preview": sql(
        "SELECT learner_id, card_id, CAST(rating AS INTEGER) AS rating, make_timestamp(due) AS due FROM p",
        "reviews",
        more={**fold(), "p": sql_step(f"(SELECT learner_id, card_id, unnest([1, 2, 3, 4]) AS rating, stability AS s, difficulty AS d, state, reps, lapses, epoch_us(last_review) AS last, epoch_us({AS_OF}) AS at_ FROM st)", "learner_id, card_id, rating")},
    ),
    "r6_due_cards": sql("SELECT learner_id, CAST(place AS INTEGER) AS place, card_id FROM du WHERE place < 200", "reviews", "zones", more=_ALL),
    "r7_fresh_cards": sql("SELECT learner_id, CAST(place AS INTEGER) AS place, card_id FROM fr", "reviews", "zones", more=_ALL),
    "r8_review_queue": sql(
        """SELECT learner_id, CAST(queue AS INTEGER) AS queue, card_id, is_new, n_due, n_new FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY pos, is_new, place) - 1 AS queue FROM (
 SELECT *, CASE WHEN NOT is_new THEN place WHEN (place + 1) * gap <= n_due THEN (place + 1) * gap - 1 ELSE 4611686018427387904 END AS pos FROM (SELECT *, greatest(1, n_due // greatest(1, n_new)) AS gap FROM bo JOIN (SELECT learner_id, count(*) FILTER (WHERE NOT is_new) AS n_due, count(*) FILTER (WHERE is_new) AS n_new FROM bo GROUP BY 1) USING (learner_id)))) WHERE queue < 20""",
        "reviews", "zones",
        more={**_ALL, "bo": "SELECT learner_id, card_id, place, false AS is_new FROM du WHERE place < 200 UNION ALL SELECT learner_id, card_id, place, true FROM fr"},
    ),
    "r9_card_stats": sql(
        f"""SELECT learner_id, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'active' AND state <> 0 AND due <= {AS_OF}) AS due,
 count(*) FILTER (WHERE status = 'active' AND state = 0) AS new, round(avg(CASE WHEN status = 'active' AND state <> 0 THEN {_RECALL} END), 6) AS retention, coalesce(any_value(n), 0) AS today FROM cs LEFT JOIN (SELECT learner_id, count(*) AS n FROM reviews JOIN mid USING (learner_id) WHERE review >= midnight AND review <= {AS_OF} GROUP BY 1) USING (learner_id) GROUP BY learner_id""",
        "reviews", "zones",
        more=_ALL,
    ),
    "r10_due_forecast": sql(
        "SELECT learner_id, CAST(day AS INTEGER) AS day, coalesce(n, 0) AS n FROM (SELECT learner_id, unnest(range(14)) AS day FROM (SELECT DISTINCT learner_id FROM cs)) LEFT JOIN (SELECT learner_id, greatest(0, CAST(floor((epoch_us(due) - epoch_us(midnight)) / 86400000000) AS BIGINT)) AS day, count(*) AS n FROM cs JOIN mid USING (learner_id) WHERE status = 'active' AND state <> 0 GROUP BY ALL) USING (learner_id, day)",
        "reviews", "zones",
        more=_ALL,
    ),
    "r11_create_cards": sql(
        "SELECT n.card_id, n.book_id, n.block_id, coalesce(b.page, n.page) AS page, coalesce(b.unit_id, p.unit_id) AS unit_id FROM (SELECT block_id AS card_id, book_id, CASE WHEN block_id % 2 = 0 THEN block_id END AS block_id, page + 1 AS page FROM blocks) n LEFT JOIN blocks b ON n.block_id = b.block_id LEFT JOIN (SELECT book_id, page, min(unit_id) AS unit_id FROM blocks GROUP BY ALL) p ON n.book_id = p.book_id AND n.page = p.page",
        "blocks",
    ),
    "r13_review_durations": sql("SELECT learner_id, card_id, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM reviews GROUP BY ALL", "reviews"),
}
