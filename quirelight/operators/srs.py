"""Spaced repetition: FSRS-6 card states as expressions and folds, review queues, forecasts, statistics.

Conventions, fixed here: elapsed time counts in whole days (under one day is the same day); times are microseconds inside a state;
intervals are rounded to whole days, at least one; due dates are not fuzzed. Learning steps: again 1 minute, hard 6 minutes, a new
card's good 10 minutes, then it graduates; a lapse is relearned in 10 minutes. States: 0 new, 1 learning, 2 review, 3 relearning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.local import ZONES_APART, local_midnight, with_zone
from ..functions.text import bound

# The published default weights of FSRS-6.
WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
# End of fixed values.
RETENTION = 0.9
NEW_PER_DAY = 30
DAY, MINUTE = 86_400_000_000, 60_000_000
STATE = "struct<s:double,d:double,state:int,reps:int,lapses:int,last:bigint,due:bigint>"


def _pick(rating: Column, values: Sequence) -> Column:
    out = F.lit(values[3])
    for k in (3, 2, 1):
        out = F.when(rating == k, F.lit(values[k - 1])).otherwise(out)
    return out


def curve(days: Column, stability: Column, w: Sequence[float] = WEIGHTS) -> Column:
    """The forgetting curve: the chance to recall after so many days."""
    factor = 0.9 ** (-1 / w[20]) - 1
    return F.pow(1 + F.lit(factor) * days / stability, F.lit(-w[20]))


def retrievability(stability: Column, state: Column, last: Column, as_of: Column, w: Sequence[float] = WEIGHTS) -> Column:
    """The chance to recall at as_of; null for new cards. last and as_of are timestamps."""
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(last)) / DAY))
    return F.when((state != 0) & last.isNotNull(), curve(days, stability, w))


def step(state: Column, rating: Column, at: Column, w: Sequence[float] = WEIGHTS, retention: float = RETENTION) -> Column:
    """R2: the state (STATE) after a review. state: STATE; at: microseconds."""
    factor = 0.9 ** (-1 / w[20]) - 1
    grow = retention ** (-1 / w[20]) - 1
    first = lambda g: min(10.0, max(1.0, w[4] - 2.718281828459045 ** (w[5] * (g - 1)) + 1))
    easy = w[4] - 2.718281828459045 ** (w[5] * 3) + 1

    def moved(x: Column) -> Column:
        """x: s, d, days, r (chance to recall) of a card that was seen before."""
        s, d, r = x["s"], x["d"], x["r"]
        d2 = F.greatest(F.lit(1.0), F.least(F.lit(10.0), w[7] * easy + (1 - w[7]) * (d - w[6] * (rating - 3) * (10 - d) / 9)))
        same_day = s * F.exp(w[17] * (rating - 3 + w[18])) * F.pow(s, F.lit(-w[19]))
        same_day = F.when(rating >= 3, F.greatest(s, same_day)).otherwise(same_day)
        lapse = F.least(s, w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp(w[14] * (1 - r)))
        recall = s * (1 + F.exp(F.lit(w[8])) * (11 - d) * F.pow(s, F.lit(-w[9])) * (F.exp(w[10] * (1 - r)) - 1) * _pick(rating, (1.0, w[15], 1.0, w[16])))
        s2 = F.when(x["days"] == 0, same_day).when(rating == 1, lapse).otherwise(recall)
        return F.struct(F.greatest(F.lit(0.001), s2).alias("s"), d2.alias("d"))

    days = F.when(state["last"].isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((at - state["last"]) / DAY))).cast("int")
    start = F.struct(_pick(rating, w[:4]).cast("double").alias("s"), _pick(rating, [first(g) for g in (1, 2, 3, 4)]).cast("double").alias("d"))
    seen = bound(days, lambda n: bound(F.struct(state["s"].alias("s"), state["d"].alias("d"), n.alias("days"), curve(n, state["s"], w).alias("r")), moved))
    memory = F.when(state["state"] == 0, start).otherwise(seen)

    def after(m: Column) -> Column:
        was = state["state"]
        learning = (was != 2) & ((rating <= 2) | ((was == 0) & (rating == 3)))
        lapsed = (was == 2) & (rating == 1)
        new = F.when(lapsed, 3).when(learning, F.when(was == 3, 3).otherwise(1)).otherwise(2).cast("int")
        wait = F.greatest(F.lit(1), F.round(m["s"] / factor * grow)).cast("long") * DAY
        due = at + F.when(lapsed, F.lit(10 * MINUTE)).when(learning, _pick(rating, (MINUTE, 6 * MINUTE, 10 * MINUTE, 10 * MINUTE))).otherwise(wait)
        return F.struct(m["s"].alias("s"), m["d"].alias("d"), new.alias("state"), (state["reps"] + 1).alias("reps"), (state["lapses"] + lapsed.cast("int")).alias("lapses"), at.alias("last"), due.cast("long").alias("due"))

    return bound(memory, after)


def empty_state() -> Column:
    return F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0).alias("state"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("due")).cast(STATE)


#: A new card, as values in the order of STATE.
NEW = (0.0, 0.0, 0, 0, 0, None, None)


def step_values(card: tuple, rating: int, at: int, w: Sequence[float] = WEIGHTS, retention: float = RETENTION) -> tuple:
    """R2 on plain values, for streams that keep a card's state: the same numbers as step."""
    s, d, state, reps, lapses, last, _ = card
    factor, grow = 0.9 ** (-1 / w[20]) - 1, retention ** (-1 / w[20]) - 1
    clamp = lambda x: max(1.0, min(10.0, x))
    if state == 0:
        s2, d2 = float(w[rating - 1]), clamp(w[4] - math.exp(w[5] * (rating - 1)) + 1)
    else:
        days = max(0, (at - last) // DAY)
        r = (1 + factor * days / s) ** -w[20]
        d2 = clamp(w[7] * (w[4] - math.exp(w[5] * 3) + 1) + (1 - w[7]) * (d - w[6] * (rating - 3) * (10 - d) / 9))
        if days == 0:
            s2 = s * math.exp(w[17] * (rating - 3 + w[18])) * s ** -w[19]
            s2 = max(s, s2) if rating >= 3 else s2
        elif rating == 1:
            s2 = min(s, w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r)))
        else:
            s2 = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * (1 - r)) - 1) * (1.0, w[15], 1.0, w[16])[rating - 1])
        s2 = max(0.001, s2)
    lapsed = state == 2 and rating == 1
    learning = state != 2 and (rating <= 2 or (state == 0 and rating == 3))
    new = 3 if lapsed or (learning and state == 3) else 1 if learning else 2
    wait = 10 * MINUTE if lapsed else (MINUTE, 6 * MINUTE, 10 * MINUTE)[rating - 1] if learning else max(1, math.floor(s2 / factor * grow + 0.5)) * DAY
    return s2, d2, new, reps + 1, lapses + lapsed, at, at + wait


KEY = ["learner_id", "card_id"]


def replay(review_log: DataFrame, w: Sequence[float] = WEIGHTS, retention: float = RETENTION) -> DataFrame:
    """The state of every card from its reviews in time order. review_log: learner_id, card_id, review_id, rating, review.
    A card's reviews are one person's answers to one question, so the group that is folded is small."""
    one = F.struct(F.unix_micros("review").alias("at"), "review_id", "rating")
    rows = review_log.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("log"))
    out = rows.select(*KEY, F.aggregate("log", empty_state(), lambda acc, x: step(acc, x["rating"], x["at"], w, retention).cast(STATE)).alias("x"))
    return out.select(*KEY, F.col("x.s").alias("stability"), F.col("x.d").alias("difficulty"), "x.state", "x.reps", "x.lapses", F.timestamp_micros("x.last").alias("last_review"), F.timestamp_micros("x.due").alias("due"))


def undo_last(review_log: DataFrame) -> DataFrame:
    """The log without each card's last review; replaying it gives the state before."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("review"), F.desc("review_id"))
    return review_log.withColumn("_r", F.row_number().over(w)).filter("_r > 1").drop("_r")


def _state(columns: DataFrame | None = None) -> Column:
    return F.struct(F.col("stability").alias("s"), F.col("difficulty").alias("d"), "state", "reps", "lapses", F.unix_micros("last_review").alias("last"), F.unix_micros("due").alias("due")).cast(STATE)


def preview(cards: DataFrame, as_of: Column) -> DataFrame:
    """The due date that each rating at as_of would give."""
    rows = cards.select(*KEY, _state().alias("x"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rating"))
    return rows.select(*KEY, "rating", F.timestamp_micros(step(F.col("x"), F.col("rating"), F.unix_micros(as_of))["due"]).alias("due"))


def due_cards(cards: DataFrame, as_of: Column, limit: int = 200) -> DataFrame:
    """Cards to review, place from 0: learning before review, then by due date; at most limit for a learner. cards have status."""
    w = Window.partitionBy("learner_id").orderBy((F.col("state") == 2).cast("int"), "due", "card_id")
    rows = cards.filter((F.col("status") == "active") & (F.col("state") != 0) & (F.col("due") <= as_of))
    return rows.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < limit)


def _today(rows: DataFrame, at: str, as_of: Column, zones: DataFrame | None) -> DataFrame:
    """The rows whose moment `at` lies in the learner's day, up to as_of. What is older than any day goes before zones are looked up."""
    near = rows.filter((F.col(at) <= as_of) & (F.col(at) > as_of - F.expr(f"INTERVAL {ZONES_APART}")))
    return with_zone(near, zones).filter(F.col(at) >= local_midnight(as_of, F.col("_tz"))).drop("_tz")


def fresh_cards(cards: DataFrame, review_log: DataFrame, as_of: Column, per_day: int = NEW_PER_DAY, zones: DataFrame | None = None) -> DataFrame:
    """New cards for today, place from 0: the allowance less the cards first seen in the learner's day, by unit and id. zones:
    learner_id, tz."""
    first = _today(review_log.groupBy(*KEY).agg(F.min("review").alias("first")), "first", as_of, zones)
    begun = first.groupBy("learner_id").agg(F.count(F.lit(1)).alias("begun"))
    w = Window.partitionBy("learner_id").orderBy("unit_id", "card_id")
    rows = cards.filter((F.col("status") == "active") & (F.col("state") == 0)).withColumn("place", F.row_number().over(w) - 1)
    return rows.join(begun, "learner_id", "left").filter(F.col("place") < per_day - F.coalesce("begun", F.lit(0))).drop("begun")


def review_queue(due: DataFrame, fresh: DataFrame, limit: int = 200) -> DataFrame:
    """Both lists as one, place from 0: a new card after every gap of due ones, the rest at the end; at most limit. By place
    alone: due card i stands at (i, 0), new card j after the gap it closes."""
    sizes = due.select("learner_id", F.lit(1).alias("d"), F.lit(0).alias("f")).union(fresh.select("learner_id", F.lit(0), F.lit(1))).groupBy("learner_id").agg(F.sum("d").alias("n_due"), F.sum("f").alias("n_new"))
    both = due.select("learner_id", "card_id", "place", F.lit(False).alias("is_new")).union(fresh.select("learner_id", "card_id", "place", F.lit(True))).join(sizes, "learner_id")
    gap = F.greatest(F.lit(1), F.floor(F.col("n_due") / F.greatest(F.lit(1), "n_new")))
    closes = (F.col("place") + 1) * gap
    at = F.when(~F.col("is_new"), F.col("place")).when(closes <= F.col("n_due"), closes - 1).otherwise(F.lit(2**62)).cast("long")
    w = Window.partitionBy("learner_id").orderBy("_at", "is_new", "place")
    out = both.withColumn("_at", at).withColumn("queue", F.row_number().over(w) - 1).filter(F.col("queue") < limit)
    return out.select("learner_id", "queue", "card_id", "is_new", "n_due", "n_new")


def card_stats(cards: DataFrame, review_log: DataFrame, as_of: Column, zones: DataFrame | None = None) -> DataFrame:
    """One row per learner: cards in all, active, pending, due, new; reviews in the learner's day; mean chance to recall. zones:
    learner_id, tz."""
    one = lambda c: F.count(F.when(c, 1))
    active, new = F.col("status") == "active", F.col("state") == 0
    recall = retrievability(F.col("stability"), F.col("state"), F.col("last_review"), as_of)
    out = cards.groupBy("learner_id").agg(
        F.count(F.lit(1)).alias("total"), one(active).alias("active"), one(F.col("status") == "pending").alias("pending"), one(active & ~new & (F.col("due") <= as_of)).alias("due"),
        one(active & new).alias("new"), F.avg(F.when(active, recall)).alias("retention"),
    )
    done = _today(review_log, "review", as_of, zones).groupBy("learner_id").agg(F.count(F.lit(1)).alias("today"))
    return out.join(done, "learner_id", "left").fillna(0, ["today"])


def due_forecast(cards: DataFrame, as_of: Column, days: int = 14, zones: DataFrame | None = None) -> DataFrame:
    """learner_id, day (0 is today, with what is overdue), n: active reviews due on each of so many days, with zeros. Days are spans of
    24 hours from the learner's last midnight, so that all of them are as long. zones: learner_id, tz."""
    midnight = F.unix_micros(local_midnight(as_of, F.col("_tz")))
    day = F.greatest(F.lit(0), F.floor((F.unix_micros("due") - midnight) / DAY)).cast("int")
    counts = with_zone(cards.filter("status = 'active' and state <> 0"), zones).groupBy("learner_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("day") < days)
    grid = cards.select("learner_id").distinct().select("learner_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    return grid.join(counts, ["learner_id", "day"], "left").fillna(0, ["n"])


def create_cards(new: DataFrame, blocks: DataFrame, page_units: DataFrame) -> DataFrame:
    """New cards with unit and page of their block, else the unit of their page. new: card_id, book_id, block_id, page; page_units:
    book_id, page, unit_id."""
    of = blocks.select("block_id", F.col("unit_id").alias("_unit"), F.col("page").alias("_page"))
    rows = new.join(of, "block_id", "left").join(page_units.select("book_id", "page", F.col("unit_id").alias("_by_page")), ["book_id", "page"], "left")
    return rows.select("card_id", "book_id", "block_id", F.coalesce("_page", "page").alias("page"), F.coalesce("_unit", "_by_page").alias("unit_id"))


def edit_cards(cards: DataFrame, patch: DataFrame) -> DataFrame:
    """Cards with the fields of patch (card_id, front, back, status; null leaves a field) and without those whose status is removed."""
    rows = cards.join(patch.select("card_id", *[F.col(c).alias(f"_{c}") for c in ("front", "back", "status")]), "card_id", "left")
    for c in ("front", "back", "status"):
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rows.filter("status <> 'removed'")


def list_cards(cards: DataFrame, book_id=None, unit_id=None) -> DataFrame:
    """Cards of a book or unit, by unit and id."""
    out = cards if book_id is None else cards.filter(F.col("book_id") == book_id)
    out = out if unit_id is None else out.filter(F.col("unit_id") == unit_id)
    return out.orderBy("unit_id", "card_id")


def review_durations(review_log: DataFrame) -> DataFrame:
    """Reviews, mean and longest time per card and learner."""
    return review_log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"))
