"""Data for model jobs in batches: budgeted context, conversation windows, and merging what models wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, parse_reply, squash, term_key, tokens


def _within(rows: DataFrame, key: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """The rows of each key, in order, up to the first that overflows the budget; the first row always stays."""
    w = Window.partitionBy(*key).orderBy(*order)
    so_far = rows.withColumns({"_sum": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    return so_far.filter((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_sum", "_n")


def context_pages(requests: DataFrame, page_text: DataFrame, budget: int = 12_000) -> DataFrame:
    """M1: request_id, text: the open pages in their order, then the page before and the page after them, as prose, up to the first that
    overflows the budget (the first always stays); in page order, each under its number from 1, the asked passage marked. Pages without text
    are passed over; a request without any gives no row. requests: request_id, book_id, pages (array of int), and of the passage page,
    start, end (null: none)."""
    asked = F.array_distinct("pages")
    near = F.filter(F.array(F.array_min(asked) - 1, F.array_max(asked) + 1), lambda p: ~F.array_contains(asked, p))
    rows = requests.select("request_id", "book_id", F.col("page").alias("_page"), "start", "end", F.posexplode(F.concat(asked, near)).alias("rank", "page"))
    rows = rows.join(page_text.filter(F.col("text").rlike(r"\S")).select("book_id", "page", "text"), ["book_id", "page"])
    cut = lambda a, n: F.substring("text", a, n)
    marked = F.concat(cut(F.lit(1), F.col("start")), F.lit(">>> "), cut(F.col("start") + 1, F.col("end") - F.col("start")), F.lit(" <<<"), cut(F.col("end") + 1, F.length("text")))
    here = (F.col("_page") == F.col("page")) & (F.col("end") > F.col("start"))
    rows = rows.withColumn("t", clean_text(F.when(here, marked).otherwise(F.col("text"))))
    kept = _within(rows, ["request_id"], ["rank"], F.length("t"), budget)
    part = F.concat(F.lit("[page "), F.col("page") + 1, F.lit("]\n"), "t")
    return kept.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def unit_text(blocks: DataFrame, budget: int = 26_000) -> DataFrame:
    """M2: unit_id, text: a unit's blocks in order within the budget, headings marked, code fenced. blocks: unit_id, n, type, text."""
    md = F.when(F.col("type") == "heading", F.concat(F.lit("## "), "text")).when(F.col("type") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    kept = _within(blocks.withColumn("md", md), ["unit_id"], ["n"], F.length("md"), budget)
    return kept.groupBy("unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "md"))), lambda x: x["md"]), "\n\n").alias("text"))


def reader_context(requests: DataFrame, highlights: DataFrame, mentions: DataFrame, concepts: DataFrame, nodes: DataFrame, styles: DataFrame | None = None, n_quotes: int = 14, n_concepts: int = 18) -> DataFrame:
    """M3: learner_id, unit_id, text: for each chapter asked about, the learner's latest highlights in it (220 characters of quote, 300 of
    note), then which of its concepts they know, are learning or forgetting, and have not met: of each state the most important ones, those
    being learnt and those fading on one line. What is empty is left out; without anything the text is empty. Concepts that are seen but
    never practised stand on no line.

    requests: learner_id, unit_id; highlights: learner_id, unit_id, id, updated, quote, note; mentions: key, unit_id; concepts: key, name,
    importance; nodes: learner_id, key, state (none: unseen); styles: learner_id, style, one row a learner."""
    key = ["learner_id", "unit_id"]
    asked = requests.select(*key).distinct()
    w = Window.partitionBy(*key).orderBy(F.desc("updated"), F.desc("id"))
    note = F.coalesce("note", F.lit(""))
    said = F.concat(F.lit('- "'), F.substring("quote", 1, 220), F.lit('"'), F.when(note != "", F.concat(F.lit(" — note: "), F.substring(note, 1, 300))).otherwise(""))
    latest = highlights.join(asked, key, "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_quotes)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", said.alias("s")))), lambda x: x["s"]), "\n")
    quotes = latest.groupBy(*key).agg(F.concat(F.when(F.max((note != "").cast("int")) == 1, "Highlighted in this chapter, with notes:\n").otherwise("Highlighted in this chapter:\n"), lines).alias("_quotes"))

    unit_concepts = mentions.select("key", "unit_id").distinct().join(concepts.select("key", "name", "importance"), "key")
    rows = asked.join(unit_concepts, "unit_id").join(nodes.select("learner_id", "key", "state"), ["learner_id", "key"], "left").fillna("unseen", ["state"])
    v = Window.partitionBy(*key, "state").orderBy(F.desc("importance"), "key")
    top = rows.filter("state <> 'seen'").withColumn("r", F.row_number().over(v)).filter(F.col("r") <= n_concepts)

    def line(title: str, *states: str) -> Column:
        """One line of names, state by state; null if there are none."""
        place = F.array_position(F.array(*map(F.lit, states)), F.col("state"))
        names = F.sort_array(F.collect_list(F.when(place > 0, F.struct(place.alias("p"), "r", "name"))))
        return F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.transform(names, lambda x: x["name"]), ", ")))

    known = F.concat_ws("\n", line("Knows", "known"), line("Learning or forgetting", "learning", "fading"), line("Not met yet", "unseen"))
    states = top.groupBy(*key).agg(F.concat(F.lit("Concepts of this chapter:\n"), known).alias("_states"))
    out = asked.join(quotes, key, "left").join(states, key, "left")
    style = F.lit(None).cast("string")
    if styles is not None:
        out = out.join(styles.select("learner_id", F.trim("style").alias("_style")), "learner_id", "left")
        style = F.when(F.col("_style") != "", F.concat(F.lit("Explain like this: "), "_style"))
    return out.select(*key, F.concat_ws("\n\n", "_quotes", "_states", style).alias("text"))


def conversation_window(messages: DataFrame, n: int = 16) -> DataFrame:
    """M4: the last n messages of each conversation from the first of a user on; a quote stands before its message. messages: conv_id,
    turn, role, text, quote."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
    begun = F.max((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    text = F.when(F.col("quote").isNull(), F.col("text")).otherwise(F.concat(F.lit("> "), "quote", F.lit("\n\n"), "text"))
    return rows.withColumn("_b", begun).filter("_b = 1").select("conv_id", "turn", "role", text.alias("text"))


def threads(messages: DataFrame) -> DataFrame:
    """M5: conv_id, messages, title (80 characters of the first quote or message), last turn."""
    first = F.min_by(F.coalesce("quote", "text"), "turn")
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.substring(first, 1, 80).alias("title"), F.max("turn").alias("last"))


def rewrite_context(passages: DataFrame, page_text: DataFrame, versions: DataFrame, messages: DataFrame) -> DataFrame:
    """M6: a passage with 1500 characters before and 900 after, its current version and the last answer on it. passages: passage_id,
    book_id, page, start, end, conv_id; versions: passage_id, version; messages: conv_id, turn, role, text."""
    answer = messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    a = F.greatest(F.lit(0), F.col("start") - 1500)
    rows = passages.join(page_text, ["book_id", "page"]).join(versions, "passage_id", "left").join(answer, "conv_id", "left")
    return rows.select("passage_id", F.substring("text", a + 1, F.col("start") - a).alias("before"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("passage"), F.substring("text", F.col("end") + 1, F.lit(900)).alias("after"), "version", "answer")


CARDS = "cards array<struct<kind:string,front:string,back:string,quote:string>>"


def merge_generated_cards(replies: DataFrame, cards: DataFrame, done: DataFrame) -> DataFrame:
    """M7: new cards of model replies: no second card of one front, clozes only with a gap, basic cards only with a back; active where
    the unit is done, else pending. replies: unit_id, reply; cards: front; done: unit_id."""
    rows = replies.select("unit_id", F.posexplode(parse_reply(F.col("reply"), CARDS)["cards"]).alias("no", "c")).select("unit_id", "no", "c.*")
    good = F.when(F.col("kind") == "cloze", F.col("front").contains("{{c1::")).otherwise(F.trim(F.coalesce("back", F.lit(""))) != "")
    rows = rows.filter(good & (F.trim("front") != "")).withColumn("_key", squash(F.col("front")))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("unit_id", "no"))).filter("_r = 1").drop("_r")
    new = first.join(cards.select(squash(F.col("front")).alias("_key")).distinct(), "_key", "left_anti")
    return new.join(done.select("unit_id", F.lit("active").alias("status")), "unit_id", "left").fillna("pending", ["status"]).drop("_key")


CONCEPTS = "concepts array<struct<name:string,importance:double,definition:string>>, relations array<struct<a:string,b:string,kind:string,strength:double>>"


def merge_generated_concepts(replies: DataFrame, concept_books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: concept_books (key, book_id, importance, definition) with those of model replies (importance of 1 to 5 as a fifth, the
    greater stays; a definition stays unless null), and edges (a < b; ← where that turned the relation). replies: book_id, reply."""
    said = replies.select("book_id", parse_reply(F.col("reply"), CONCEPTS).alias("r"))
    c = said.select("book_id", F.explode("r.concepts").alias("c")).select(term_key(F.col("c.name")).alias("key"), "book_id", F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.col("c.importance") / 5)).alias("importance"), "c.definition", F.lit(1).alias("_n"))
    both = concept_books.select("key", "book_id", "importance", "definition", F.lit(0).alias("_n")).union(c.filter("key <> ''"))
    merged = both.groupBy("key", "book_id").agg(F.max("importance").alias("importance"), F.min_by("definition", F.when(F.col("definition").isNotNull(), F.struct("_n", "definition"))).alias("definition"))
    e = said.select("book_id", F.explode("r.relations").alias("e")).select("book_id", term_key(F.col("e.a")).alias("x"), term_key(F.col("e.b")).alias("y"), F.col("e.kind").alias("kind"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), "e.strength")).alias("w")).filter("x <> y and x <> '' and y <> ''")
    label = F.when(F.col("x") < F.col("y"), F.col("kind")).otherwise(F.concat("kind", F.lit("←")))
    edges = e.groupBy("book_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("w").alias("w"), F.max(label).alias("label"))
    return merged, edges


def match_quotes(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """M9: quote_id, block_id: the first block of the unit that has the quote (spaces and case aside), else the one that shares most of
    its words of over three letters, three or all of them at least. quotes: quote_id, unit_id, quote; blocks: unit_id, block_id, text."""
    q = quotes.withColumn("_s", squash(F.col("quote")))
    inside = q.filter("_s <> ''").join(blocks.select("unit_id", "block_id", squash(F.col("text")).alias("_t")), "unit_id").filter(F.col("_t").contains(F.col("_s"))).groupBy("quote_id").agg(F.min("block_id").alias("_in"))
    long_words = lambda c: F.array_distinct(F.filter(tokens(F.col(c)), lambda w: F.length(w) > 3))
    qw = q.select("quote_id", "unit_id", long_words("quote").alias("w")).select("quote_id", "unit_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    bw = blocks.select("unit_id", "block_id", F.explode(long_words("text")).alias("word"))
    shared = qw.join(bw, ["unit_id", "word"]).groupBy("quote_id", "block_id", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= F.least(F.lit(3), F.col("n")))
    most = shared.groupBy("quote_id").agg(F.max_by("block_id", F.struct("k", -F.col("block_id"))).alias("_most"))
    return quotes.select("quote_id").join(inside, "quote_id", "left").join(most, "quote_id", "left").select("quote_id", F.coalesce("_in", "_most").alias("block_id")).filter("block_id is not null")


def pending_jobs(finished: DataFrame, unit_jobs: DataFrame, units: DataFrame, jobs: tuple[str, ...] = ("cards", "concepts")) -> DataFrame:
    """unit_id, job: jobs of finished readable units that are not done."""
    readable = units.filter(F.col("kind").isin("body", "exercises")).select("unit_id")
    want = finished.select("unit_id").distinct().join(readable, "unit_id", "left_semi").select("unit_id", F.explode(F.array(*map(F.lit, jobs))).alias("job"))
    return want.join(unit_jobs, ["unit_id", "job"], "left_anti")


def generation_units(blocks: DataFrame, concepts: DataFrame, least: int = 400, cap: int = 120) -> DataFrame:
    """unit_id, known: units with enough text, and the names of their book's most important concepts. blocks: book_id, unit_id,
    text; concepts: book_id, key, importance."""
    w = Window.partitionBy("book_id").orderBy(F.desc("importance"), "key")
    top = concepts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]), ", ").alias("known"))
    size = blocks.groupBy("book_id", "unit_id").agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") >= least)
    return size.join(top, "book_id", "left").select("unit_id", "known")
