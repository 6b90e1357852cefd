"""Concepts a corpus defines: where they are announced, mentioned and defined, how they relate, and first cards on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written

BOLD, ITALIC, MONO, MATH = 1, 2, 4, 32
NOT_PROSE = ("code", "equation", "table", "figure")


def glossary_flag(blocks: DataFrame) -> DataFrame:
    """in_glossary: a heading such as Glossary opens it until the next heading. blocks: book_id, ord, type, text."""
    opens = F.col("text").rlike(r"(?i)^(glossary|key terms|vocabulary|definitions)\b")
    w = Window.partitionBy("book_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    flag = F.last(F.when(F.col("type") == "heading", opens), ignorenulls=True).over(w)
    return blocks.withColumn("in_glossary", F.coalesce(flag, F.lit(False)) & (F.col("type") != "heading"))


def marked_candidates(blocks: DataFrame) -> DataFrame:
    """Bold or italic runs of body text that are names (exercises set their labels in bold, not their terms). blocks: book_id, unit_id, block_id, type, kind, text, marks (s, e, f), in_glossary.
    Rows: book_id, unit_id, block_id, mark, surface, key, bold, glossary, defines, sentence."""
    body = blocks.filter(F.col("type").isin("paragraph", "list") & (F.col("kind") == "body"))
    rows = body.select("*", F.posexplode("marks").alias("mark", "m")).filter(
        (F.col("m.f").bitwiseAND(BOLD | ITALIC) != 0) & (F.col("m.f").bitwiseAND(MONO | MATH) == 0) & (F.col("m.e") - F.col("m.s") < 0.8 * F.length("text"))
    )
    surface = X.clean_term(F.substring("text", F.col("m.s") + 1, F.col("m.e") - F.col("m.s")))
    rows = rows.withColumn("surface", surface).filter("surface is not null")
    sentence = X.sentence_at(F.col("text"), F.col("m.s"), F.col("m.e"))
    bold = F.col("m.f").bitwiseAND(BOLD) != 0
    after = F.substring("text", F.col("m.e") + 1, F.lit(3))
    entry = F.col("in_glossary") & (F.col("m.s") == 0) & after.rlike(r"^\s?[:—–]")
    out = rows.select("book_id", "unit_id", "block_id", "mark", "surface", X.term_key(F.col("surface")).alias("key"), bold.alias("bold"), entry.alias("glossary"), sentence.alias("sentence"))
    return out.withColumn("defines", X.is_defining(F.col("sentence"))).filter("bold or defines or glossary")


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """Headings that are names. blocks: book_id, unit_id, block_id, type, level, kind, text."""
    rows = blocks.filter((F.col("type") == "heading") & (F.col("level") >= 2) & F.col("kind").isin("body", "exercises") & ~X.is_generic_heading(F.col("text")))
    rows = rows.withColumn("surface", X.clean_term(F.col("text"))).filter("surface is not null")
    return rows.select("book_id", "unit_id", "block_id", "surface", X.term_key(F.col("surface")).alias("key"))


def best_definitions(candidates: DataFrame) -> DataFrame:
    """C4: the best definition of each term: glossary entries, then sentences that define, bold ones, of fair length; the first wins."""
    fair = F.length("sentence").between(30, 320)
    rank = 4 * F.col("glossary").cast("int") + 2 * F.col("defines").cast("int") + F.col("bold").cast("int") + fair.cast("int")
    best = F.max_by(F.struct("block_id", "unit_id", "sentence", "surface", "glossary", "defines", rank.alias("rank")), F.struct(rank, -F.col("block_id"), -F.col("mark")))
    return candidates.groupBy("book_id", "key").agg(best.alias("x")).select("book_id", "key", "x.*")


def block_words(blocks: DataFrame) -> DataFrame:
    """block_id, unit_id, book_id, w: the term words of blocks of prose. find_mentions reads them three times, so for a corpus they should
    be a table."""
    return blocks.filter(~F.col("type").isin(*NOT_PROSE)).select("block_id", "unit_id", "book_id", X.term_words(F.col("text")).alias("w")).filter("size(w) > 0")


def _pairs(w: Column) -> Column:
    """The neighbours in a list of words, each two joined."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))


def _anchors(terms: DataFrame, words: DataFrame) -> DataFrame:
    """key, word, off, n: where each term meets the text: a word alone and two words as they are, a longer term at its rarest pair of
    neighbours in words (the first of equals), off words into it. Terms with a pair that never occurs are left out."""
    parts = terms.select("key").distinct().withColumn("t", F.split("key", " ")).withColumn("n", F.size("t"))
    short = parts.filter("n <= 2").select("key", F.col("key").alias("word"), F.lit(0).alias("off"), "n")
    each = parts.filter("n > 2").select("key", "n", F.posexplode(_pairs(F.col("t"))).alias("off", "word"))
    asked = written(each.select("word").distinct())
    often = _sieve(words.select(F.explode(_pairs(F.col("w"))).alias("word")), asked).join(asked, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    best = each.join(often, "word", "left").groupBy("key", "n").agg(F.min_by(F.struct("word", "off"), F.struct("often", "off")).alias("x"), F.count("often").alias("known"))
    return short.unionByName(best.filter("known = n - 1").select("key", "x.word", "x.off", "n"))


#: Slots of a sieve for each key in it, and at most: 16 MB, however many keys there are.
SLOTS, MOST_SLOTS = 16, 1 << 27


def _sieve(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of words (with a column word) that may have an anchor: all that have one, and few others. Most of a text's words and pairs
    are no term, so what goes into the join by word is small; the join itself stays exact. The sieve is one row, a bit for each slot."""
    slots = min(MOST_SLOTS, 64 << (SLOTS * max(anchors.count(), 1) // 64).bit_length())
    slot = F.pmod(F.xxhash64("word"), F.lit(slots))
    bits = anchors.select(slot.alias("slot")).select(F.floor(F.col("slot") / 64).alias("at"), F.expr("shiftleft(1L, CAST(slot % 64 AS INT))").alias("bits"))
    every = anchors.sparkSession.range(slots // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    one = bits.unionByName(every).groupBy("at").agg(F.bit_or("bits").alias("bits")).agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"].alias("_sieve"))
    hit = F.expr("shiftrightunsigned(_sieve[CAST(_slot DIV 64 AS INT)], CAST(_slot % 64 AS INT)) & 1") == 1
    return words.withColumn("_slot", slot).join(F.broadcast(one), hit).drop("_sieve", "_slot")


def find_mentions(blocks: DataFrame | None, terms: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Key, block_id, unit_id, book_id, count: leftmost longest mentions that do not overlap. blocks: block_id, unit_id, book_id,
    type, text, or words: what block_words makes of them; terms: key.

    A term meets the text at one place, its word, its two words or its rarest pair: an equi-join with the text's words and pairs, sieved
    before, which is a broadcast while the terms are few. (At single rare words, a word with many companions would make a row for each of them.) Places where
    a term of three words or more may stand are held against their block's words; then one pass over a block's hits, in order of place and
    with the longest first, drops what overlaps an earlier one."""
    words = block_words(blocks) if words is None else words
    placed = lambda x: F.transform(x, lambda y, i: F.struct(i.alias("at"), y.alias("word")))
    anchors = written(_anchors(terms, words))
    each = words.select("block_id", F.explode(F.concat(placed(F.col("w")), placed(_pairs(F.col("w"))))).alias("x")).select("block_id", "x.*")
    near = _sieve(each, anchors).join(anchors, "word")
    # a hit is one number: its place, then its length, the longest first; what words it has is in the block
    code = (F.col("at") - F.col("off")).cast("long") * SPAN + (SPAN - F.col("n"))
    near = near.select("block_id", code.alias("code"), "n", "key").filter("code >= 0")
    hits = near.groupBy("block_id").agg(F.collect_list(F.when(F.col("n") <= 2, F.col("code"))).alias("one"), F.collect_list(F.when(F.col("n") > 2, F.struct("code", "key"))).alias("more"))
    listed = words.join(hits, "block_id")
    at, n = lambda c: F.floor(c / SPAN).cast("int"), lambda c: (SPAN - c % SPAN).cast("int")
    there = F.filter("more", lambda h: F.array_join(F.slice("w", at(h["code"]) + 1, n(h["code"])), " ") == h["key"])
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("codes"))
    taken = F.aggregate(F.array_sort(F.concat("one", F.transform(there, lambda h: h["code"]))), start, _take, lambda acc: acc["codes"])
    key = lambda c: F.array_join(F.slice("w", at(c) + 1, n(c)), " ")
    keys = listed.select("block_id", "unit_id", "book_id", F.explode(F.transform(taken, key)).alias("key"))
    return keys.groupBy("key", "block_id", "unit_id", "book_id").agg(F.count(F.lit(1)).alias("count"))


#: More words than a term has.
SPAN = 64


def _take(acc: Column, code: Column) -> Column:
    """acc (end, as the least code that does not overlap; codes) with a hit, if it starts behind the last one's end."""
    end = (F.floor(code / SPAN) + SPAN - code % SPAN).cast("long") * SPAN
    return F.when(code >= acc["end"], F.struct(end.alias("end"), F.array_append(acc["codes"], code).alias("codes"))).otherwise(acc)


def terms_used(definitions: DataFrame, terms: DataFrame) -> DataFrame:
    """book_id, key, used: the terms that stand in the sentence that defines a term (C9, C13). definitions: book_id, key, sentence."""
    said = definitions.select(F.struct("book_id", "key").alias("block_id"), F.lit(0).alias("unit_id"), "book_id", F.lit("paragraph").alias("type"), F.col("sentence").alias("text"))
    found = find_mentions(said, terms)
    return found.select("book_id", "block_id.key", F.col("key").alias("used")).filter("key <> used")


def term_stats(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """book_id, key, total mentions, units they are in, how often announced, most frequent form. candidates: book_id, key, surface."""
    # each side is dealt by term once, and all its steps stay there
    said = mentions.select("book_id", "key", "unit_id", "count").repartition("book_id", "key").groupBy("book_id", "key").agg(F.sum("count").alias("total"), F.count_distinct("unit_id").alias("units"))
    forms = candidates.select("book_id", "key", "surface").repartition("book_id", "key").groupBy("book_id", "key", "surface").agg(F.count(F.lit(1)).alias("n"))
    announced = forms.groupBy("book_id", "key").agg(F.sum("n").alias("announced"), F.max_by("surface", F.struct("n", "surface")).alias("form"))
    return announced.join(said, ["book_id", "key"], "left").fillna(0, ["total", "units"])


def score_concepts(stats: DataFrame, cap: int = 500) -> DataFrame:
    """Score, rank and importance of the terms that stay; a term that is never mentioned goes. stats: book_id, key, total, units, announced, defined, glossary, heading,
    marked (booleans)."""
    i = lambda c: F.col(c).cast("int")
    score = 2 * i("defined") + i("glossary") + 1.5 * i("heading") + F.log2(1 + F.col("total")) + F.log2(1 + F.col("units")) + 0.3 * F.least(F.col("announced"), F.lit(3))
    keep = (F.col("defined") & ((F.col("total") >= 2) | F.col("glossary"))) | (F.col("heading") & (F.col("total") >= 2) & (F.col("key").contains(" ") | F.col("marked")))
    rows = stats.filter(keep & (F.col("total") >= 1)).withColumn("score", F.round(score, 9))
    w = Window.partitionBy("book_id").orderBy(F.desc("score"), "key")
    top = F.max("score").over(Window.partitionBy("book_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).withColumn("importance", F.round(F.col("score") / top, 3))


def display_names(candidates: DataFrame, definitions: DataFrame) -> DataFrame:
    """Name of each term: the form that defines it, else its most frequent one; in a name of several words that only headings give,
    capitalised words are written small; a form with a capital at its start alone is written small if that form occurs, or if no heading
    has the term or it has several forms. candidates: book_id, key, surface, heading (boolean); definitions: book_id, key, surface."""
    # dealt by term once, and all steps stay there
    dealt = candidates.select("book_id", "key", "surface", "heading").repartition("book_id", "key")
    forms = dealt.groupBy("book_id", "key", "surface").agg(F.count(F.lit(1)).alias("n"), F.max("heading").alias("heading"), F.min("heading").alias("only"))
    said = forms.groupBy("book_id", "key").agg(F.max_by("surface", F.struct("n", "surface")).alias("form"), F.collect_set("surface").alias("forms"), F.max("heading").alias("heading"), F.min("only").alias("only"))
    defining = definitions.filter(X.term_key(F.col("surface")) == F.col("key")).select("book_id", "key", F.col("surface").alias("_defining"))
    named = said.join(defining, ["book_id", "key"], "left").withColumn("form", F.coalesce("_defining", "form"))
    words = F.array_join(F.transform(F.split("form", " "), lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}+$"), F.lower(w)).otherwise(w)), " ")
    named = named.withColumn("form", F.when(F.col("only") & F.col("form").contains(" "), words).otherwise(F.col("form")))
    rest = F.substring("form", F.lit(2), F.length("form"))
    small = F.concat(F.lower(F.substring("form", 1, 1)), rest)
    start = F.col("form").rlike(r"^\p{Lu}\p{Ll}") & (rest == F.lower(rest))
    name = F.when(start & (F.array_contains("forms", F.lower("form")) | ~F.col("heading") | (F.size("forms") > 1)), small).otherwise(F.col("form"))
    return named.select("book_id", "key", name.alias("name"))


def cooccurrence(mentions: DataFrame, definitions: DataFrame | None = None, per_block: int | None = 25, among: DataFrame | None = None) -> DataFrame:
    """A, b, n: how many blocks two terms share, and twice how often one stands in the other's definition. Blocks with more than
    per_block terms are left out before any pair is made; with None, every block counts. mentions: block_id, key; definitions: key, used;
    among: key, each once, the terms that pairs of blocks are wanted of (all terms of a block count for per_block)."""
    blocks = _terms_of(mentions, among)
    blocks = blocks if per_block is None else blocks.filter(F.col("n") <= per_block)
    # a row holds a term and all that follow it in its block, and goes by the term alone: each pair as a row of its own takes three times the
    # bytes; the rows of a block are made one at a time, as together they grow with the square of its terms
    each = blocks.select(F.sort_array("keys").alias("keys")).select("keys", F.posexplode("keys").alias("at", "a"))
    out = each.select("a", F.slice("keys", F.col("at") + 2, F.size("keys")).alias("bs"), F.lit(1).alias("n")).filter("size(bs) > 0")
    if definitions is not None:
        out = out.union(definitions.filter("key <> used").select(F.least("key", "used"), F.array(F.greatest("key", "used")), F.lit(2)))
    return out.repartition("a").select("a", F.explode("bs").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _terms_of(mentions: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """block_id, keys: the terms of a block, each once, and how many they are (n). With among, keys are those in it, and blocks without one
    are left out."""
    if among is None:
        return mentions.select("block_id", "key").groupBy("block_id").agg(F.collect_set("key").alias("keys")).withColumn("n", F.size("keys"))
    own = among.select("key", F.lit(True).alias("_own"))
    rows = mentions.select("block_id", "key").join(own, "key", "left").repartition("block_id").groupBy("block_id")
    return rows.agg(F.collect_set(F.when(F.col("_own"), F.col("key"))).alias("keys"), F.count_distinct("key").alias("n")).filter("size(keys) > 0")


def relatedness(pairs: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """A, b, w: shared blocks against the blocks of each, damped for few. mentions: at least those of the terms in pairs."""
    often = _terms_of(mentions).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    rows = pairs.filter(F.col("n") >= least).join(often.select(F.col("key").alias("a"), F.col("f").alias("fa")), "a").join(often.select(F.col("key").alias("b"), F.col("f").alias("fb")), "b")
    return rows.select("a", "b", (F.col("n") / F.sqrt(F.col("fa") * F.col("fb")) * F.least(F.lit(1.0), F.log2(1 + F.col("n")) / 3)).alias("w"))


def prune_edges(edges: DataFrame, k: int = 8, floor: float = 0.05) -> DataFrame:
    """C11: a, b, w: the k best edges of either end, without those under floor of the best of all, scaled to it."""
    ends = edges.select(F.col("a").alias("end"), "a", "b", "w").union(edges.select("b", "a", "b", "w"))
    w = Window.partitionBy("end").orderBy(F.desc("w"), "a", "b")
    kept = ends.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("a", "b", "w").distinct()
    top = edges.agg(F.max("w").alias("top"))
    return kept.join(F.broadcast(top)).filter(F.col("w") >= floor * F.col("top")).select("a", "b", F.round(F.col("w") / F.col("top"), 3).alias("w"))


def merge_concepts(base: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Concepts (key, name, ord: first name stays), concept_books (the greatest importance), mentions (the first), edges (a < b)."""
    concepts = base["concepts"].unionByName(found["concepts"]).groupBy("key").agg(F.min_by("name", F.struct("ord", "name")).alias("name"), F.min("ord").alias("ord"))
    books = base["concept_books"].unionByName(found["concept_books"]).groupBy("key", "book_id").agg(F.max("importance").alias("importance"))
    mentions = base["mentions"].withColumn("_n", F.lit(0)).unionByName(found["mentions"].withColumn("_n", F.lit(1))).groupBy("key", "block_id").agg(F.min_by("count", "_n").alias("count"))
    # an edge goes by its low end in a list of all that a side has there: as a row of its own it takes more bytes
    edge = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a").agg(F.collect_list(F.struct("b", "w")).alias("x"))
    edges = edge(base["edges"]).unionByName(edge(found["edges"])).repartition("a").select("a", F.inline("x")).groupBy("a", "b").agg(F.max("w").alias("w"))
    return {"concepts": concepts, "concept_books": books, "mentions": mentions, "edges": edges}


def first_cards(definitions: DataFrame, concepts: DataFrame, per_unit: int = 15) -> DataFrame:
    """At most per_unit cards a unit, best concepts first: a question for a glossary entry, else a cloze of the defining sentence.
    definitions: book_id, key, unit_id, sentence, surface, glossary; concepts: book_id, key, name, score."""
    rows = definitions.join(concepts.select("book_id", "key", "name", "score"), ["book_id", "key"])
    answer = F.trim(F.regexp_replace(F.substring("sentence", F.length("surface") + 1, F.length("sentence")), r"^\s*[:—–-]\s*", ""))
    at = F.instr("sentence", F.col("surface"))
    short = F.when(F.length("sentence") > 360, F.trim(F.substring("sentence", F.greatest(F.lit(1), at - 165), F.lit(330)))).otherwise(F.col("sentence"))
    place = F.instr(short, F.col("surface"))
    cloze = F.concat(F.substring(short, F.lit(1), place - 1), F.lit("{{c1::"), "surface", F.lit("}}"), F.substring(short, place + F.length("surface"), F.length(short)))
    made = rows.select(
        "book_id", "unit_id", "key", "score",
        F.when(F.col("glossary"), "basic").otherwise("cloze").alias("kind"),
        F.when(F.col("glossary"), F.concat(F.lit("What does “"), "name", F.lit("” mean?"))).otherwise(cloze).alias("front"),
        F.when(F.col("glossary"), answer).otherwise("").alias("back"),
        F.when(F.col("glossary"), F.length(answer) >= 15).otherwise((F.length("sentence") >= 30) & (place > 0)).alias("_good"),
    ).filter("_good").drop("_good")
    w = Window.partitionBy("book_id", "unit_id").orderBy(F.desc("score"), "key")
    return made.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_unit)


def card_concepts(cards: DataFrame, used: DataFrame, concepts: DataFrame) -> DataFrame:
    """book_id, unit_id, card, key: the concepts a first card is on: its own, and those of its book that its sentence uses. cards:
    book_id, unit_id, key; used: what terms_used gives; concepts: book_id, key (those that stay)."""
    also = cards.join(used, ["book_id", "key"]).select("book_id", "unit_id", F.col("key").alias("card"), F.col("used").alias("key")).join(concepts.select("book_id", "key"), ["book_id", "key"], "left_semi")
    own = cards.select("book_id", "unit_id", F.col("key").alias("card"), "key")
    return own.unionByName(also.select(own.columns)).distinct()
