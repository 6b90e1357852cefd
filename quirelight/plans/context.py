"""Queries of model-batch preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as M
from ..operators import units as U
from ..sources import fixtures as X
from ..sources.fixtures import sql
from ..sources.shared import written
from .search import _PAGES, page_text
from .text import sql_term_key
from .units import _DONE


def m1(spark, d):
    """One open page, or two of every other book; two in three requests ask about a passage."""
    open_ = F.when(F.col("book_id") % 2 == 1, F.array("page", F.col("page") + 1)).otherwise(F.array("page"))
    r = page_text(spark, d).filter(F.length("text") > 80).select((F.col("book_id") * 1000 + F.col("page")).alias("request_id"), "book_id", open_.alias("pages"), F.when(F.col("book_id") % 3 > 0, F.col("page")).alias("page"), F.lit(20).alias("start"), F.lit(60).alias("end"))
    return M.context_pages(r, page_text(spark, d), budget=4000).select("request_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


def m2(spark, d):
    return M.unit_text(X.blocks(spark, d), budget=2000).select("unit_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


def _messages(spark, d):
    quote = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), F.substring("text", 5, 100))
    return X.table(spark, d, "conversations").withColumn("quote", quote)


def m3(spark, d):
    """The chapters that learners read in; the first words of lines are concepts, and a concept's state follows from how often it was read."""
    reads, blocks = X.reads(spark, d), X.blocks(spark, d)
    said = blocks.select("block_id", "unit_id", F.lower(F.substring_index("text", " ", 1)).alias("key"), F.col("text").alias("quote"))
    h = reads.join(said.drop("unit_id"), "block_id").select("learner_id", "unit_id", F.col("block_id").alias("id"), F.col("seen").alias("updated"), "quote", F.when(F.col("block_id") % 2 == 0, "why so").otherwise("").alias("note"))
    mentions = said.select("key", "unit_id").distinct()
    concepts = mentions.groupBy("key").agg(F.count(F.lit(1)).alias("importance")).withColumn("name", F.concat(F.lit("the "), "key"))
    n = F.count(F.lit(1)) % 5
    state = F.when(n == 0, "seen").when(n == 1, "known").when(n == 2, "learning").when(n == 3, "fading").otherwise("unseen")
    nodes = reads.join(said.drop("unit_id"), "block_id").groupBy("learner_id", "key").agg(state.alias("state"))
    styles = reads.filter("learner_id % 2 = 0").select("learner_id").distinct().withColumn("style", F.concat(F.lit(" briefly "), F.when(F.col("learner_id") % 4 == 0, "and slowly").otherwise("")))
    out = M.reader_context(reads.select("learner_id", "unit_id"), h, mentions, concepts, nodes, styles)
    return out.select("learner_id", "unit_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"))


def m6(spark, d):
    p = page_text(spark, d).filter("length(text) > 400").select((F.col("book_id") * 1000 + F.col("page")).alias("passage_id"), "book_id", "page", F.lit(200).alias("start"), F.lit(260).alias("end"), (F.col("book_id") % 100).alias("conv_id"))
    v = p.join(page_text(spark, d).filter("length(text) > 600"), ["book_id", "page"], "left_semi").select("passage_id", F.concat(F.lit("v"), "passage_id").alias("version"))
    return M.rewrite_context(p, page_text(spark, d), v, X.table(spark, d, "conversations"))


def m7(spark, d):
    """Replies made of blocks: each unit's reply has a card for every block, a third of them not usable; code lines are cards already."""
    b = X.blocks(spark, d).withColumn("w", F.substring_index("text", " ", 2))
    n = F.col("n") % 3
    card = F.struct(F.when(n == 0, "cloze").otherwise("basic").alias("kind"), F.when(n == 0, F.concat(F.lit("{{c1::"), "w", F.lit("}}"))).otherwise(F.col("w")).alias("front"), F.when(n == 1, "back").otherwise("").alias("back"), F.col("w").alias("quote"))
    r = b.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("n", card.alias("c")))).alias("x")).select("unit_id", F.concat(F.lit("Sure: "), F.to_json(F.struct(F.transform("x", lambda x: x["c"]).alias("cards")))).alias("reply"))
    old = b.filter("type = 'code'").select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("front"))
    return M.merge_generated_cards(r, old, X.units(spark, d).filter("kind = 'body'")).select("unit_id", "kind", "front", "back", "status")


def m8(spark, d):
    t = written(X.terms(spark, d))
    name = F.struct(F.col("key").alias("name"), (F.col("no") % 7).cast("double").alias("importance"), F.concat(F.lit("about "), "key").alias("definition"))
    relation = F.struct(F.col("key").alias("a"), F.lit("middle").alias("b"), F.lit("part-of").alias("kind"), (F.col("no") % 300 / 100.0).alias("strength"))
    replies = t.select((F.col("no") % 3).cast("long").alias("book_id"), F.to_json(F.struct(F.array(name).alias("concepts"), F.array(relation).alias("relations"))).alias("reply"))
    base = t.filter("no % 2 = 0").select(M.term_key(F.col("key")).alias("key"), (F.col("no") % 3).cast("long").alias("book_id"), F.lit(0.5).alias("importance"), F.lit(None).cast("string").alias("definition"))
    merged, edges = M.merge_generated_concepts(replies, base)
    return merged.join(edges.select("book_id", F.when(F.col("a") == "middle", F.col("b")).otherwise(F.col("a")).alias("key"), F.round("w", 6).alias("w"), "label"), ["book_id", "key"], "left").withColumn("importance", F.round("importance", 6))


def m9(spark, d):
    q = X.blocks(spark, d).filter("length(text) > 40").select("block_id", "unit_id", F.when(F.col("block_id") % 2 == 0, F.translate(F.substring("text", 5, 30), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(F.reverse(F.substring("text", 1, 5)), F.lit(" "), F.substring_index("text", " ", 9))).alias("quote"))
    return M.match_quotes(q.withColumnRenamed("block_id", "quote_id"), X.blocks(spark, d))


def m10(spark, d):
    done = U.units_finished(X.reads(spark, d), X.blocks(spark, d))
    jobs = X.units(spark, d).filter("kind = 'exercises'").select("unit_id", F.lit("cards").alias("job"))
    return M.pending_jobs(done, jobs, X.units(spark, d))


def m11(spark, d):
    c = X.blocks(spark, d).filter("n = 0").select("book_id", F.substring_index("text", " ", 1).alias("key"), F.length("text").alias("importance")).groupBy("book_id", "key").agg(F.max("importance").alias("importance"))
    return M.generation_units(X.blocks(spark, d), c, cap=5)


QUERIES = {
    "m1_context_pages": m1,
    "m2_unit_text": m2,
    "m3_reader_context": m3,
    "m4_conversation_window": lambda spark, d: M.conversation_window(_messages(spark, d), n=4),
    "m5_threads": lambda spark, d: M.threads(_messages(spark, d)),
    "m6_rewrite_context": m6,
    "m7_merge_generated_cards": m7,
    "m8_merge_generated_concepts": m8,
    "m9_match_quotes": m9,
    "m10_pending_jobs": m10,
    "m11_generation_units": m11,
}

_MSG = {"msg": "SELECT *, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN substr(text, 5, 100) END AS quote FROM conversations"}
_TOK = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
_LONG = "list_distinct(list_filter(" + _TOK + ", lambda x: length(x) > 3))"
_SQ = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

ORACLE = {
    "m1_context_pages": sql(
        "SELECT request_id, sha256(t) AS sha, CAST(length(t) AS INTEGER) AS n FROM (SELECT request_id, string_agg('[page ' || (p + 1) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY p) AS t FROM (SELECT *, sum(length(t)) OVER w AS s, row_number() OVER w AS k FROM tx WINDOW w AS (PARTITION BY request_id ORDER BY rank)) WHERE k = 1 OR s <= 4000 GROUP BY 1)",
        "blocks",
        more={
            **_PAGES,
            "rq": "SELECT book_id * 1000 + page AS request_id, book_id, page, CASE WHEN book_id % 2 = 1 THEN [page, page + 1] ELSE [page] END || CASE WHEN page > 0 THEN [page - 1] ELSE [] END || [page + 1 + book_id % 2] AS o FROM pt WHERE length(text) > 80",
            "od": "SELECT request_id, book_id, page, unnest(o) AS p, generate_subscripts(o, 1) AS rank FROM rq",
            "tx": r"SELECT request_id, rank, p, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN p = od.page AND od.book_id % 3 > 0 THEN substr(text, 1, 20) || '>>> ' || substr(text, 21, 40) || ' <<<' || substr(text, 61) ELSE text END, '(\p{L})[-‐]\n(\p{Ll})', '\1\2', 'g'), '\n', ' ', 'g'), '[ \t]+', ' ', 'g')) AS t FROM od JOIN pt ON pt.book_id = od.book_id AND pt.page = p WHERE regexp_matches(text, '\S')",
        },
    ),
    "m2_unit_text": sql(
        "SELECT unit_id, sha256(t) AS sha, CAST(length(t) AS INTEGER) AS n FROM (SELECT unit_id, string_agg(md, chr(10) || chr(10) ORDER BY n) AS t FROM (SELECT *, sum(length(md)) OVER w AS s, row_number() OVER w AS k FROM (SELECT unit_id, n, CASE type WHEN 'heading' THEN '## ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS md FROM blocks) WINDOW w AS (PARTITION BY unit_id ORDER BY n)) WHERE k = 1 OR s <= 2000 GROUP BY 1)",
        "blocks",
    ),
    "m3_reader_context": sql(
        """SELECT learner_id, unit_id, sha256(t) AS sha, CAST(length(t) AS INTEGER) AS n FROM (SELECT learner_id, unit_id, concat_ws(chr(10) || chr(10), quotes, states, CASE WHEN learner_id % 4 = 0 THEN 'Explain like this: briefly and slowly' WHEN learner_id % 2 = 0 THEN 'Explain like this: briefly' END) AS t FROM rq LEFT JOIN qu USING (learner_id, unit_id) LEFT JOIN stl USING (learner_id, unit_id))""",
        "reads",
        more={
            "rq": "SELECT DISTINCT learner_id, unit_id FROM reads",
            "sd": "SELECT block_id, unit_id, lower(split_part(text, ' ', 1)) AS key, text FROM blocks",
            "hl": "SELECT r.learner_id, r.unit_id, r.block_id, text, row_number() OVER (PARTITION BY r.learner_id, r.unit_id ORDER BY seen DESC, r.block_id DESC) AS r FROM reads r JOIN sd USING (block_id)",
            "qu": """SELECT learner_id, unit_id, 'Highlighted in this chapter' || CASE WHEN bool_or(block_id % 2 = 0) THEN ', with notes' ELSE '' END || ':' || chr(10) || string_agg('- "' || substr(text, 1, 220) || '"' || CASE WHEN block_id % 2 = 0 THEN ' — note: why so' ELSE '' END, chr(10) ORDER BY r) AS quotes FROM hl WHERE r <= 14 GROUP BY ALL""",
            "mn": "SELECT DISTINCT key, unit_id FROM sd",
            "im": "SELECT key, count(*) AS importance FROM mn GROUP BY key",
            "nd": "SELECT learner_id, key, CASE count(*) % 5 WHEN 0 THEN 'seen' WHEN 1 THEN 'known' WHEN 2 THEN 'learning' WHEN 3 THEN 'fading' ELSE 'unseen' END AS state FROM reads JOIN (SELECT block_id, key FROM sd) USING (block_id) GROUP BY ALL",
            "tp": "SELECT *, row_number() OVER (PARTITION BY learner_id, unit_id, state ORDER BY importance DESC, key) AS r FROM (SELECT rq.learner_id, rq.unit_id, mn.key, importance, coalesce(state, 'unseen') AS state FROM rq JOIN mn USING (unit_id) JOIN im ON im.key = mn.key LEFT JOIN nd ON nd.learner_id = rq.learner_id AND nd.key = mn.key)",
            "ln": "SELECT learner_id, unit_id, CASE state WHEN 'known' THEN 1 WHEN 'unseen' THEN 3 ELSE 2 END AS line, string_agg('the ' || key, ', ' ORDER BY state DESC, r) AS names FROM tp WHERE r <= 18 AND state <> 'seen' GROUP BY ALL",
            "stl": "SELECT learner_id, unit_id, 'Concepts of this chapter:' || chr(10) || string_agg(CASE line WHEN 1 THEN 'Knows: ' WHEN 2 THEN 'Learning or forgetting: ' ELSE 'Not met yet: ' END || names, chr(10) ORDER BY line) AS states FROM ln GROUP BY ALL",
        },
    ),
    "m4_conversation_window": sql(
        "SELECT conv_id, turn, role, CASE WHEN quote IS NULL THEN text ELSE '> ' || quote || chr(10) || chr(10) || text END AS text FROM (SELECT *, bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM msg) WHERE r <= 4) WHERE b",
        more=_MSG,
    ),
    "m5_threads": sql("SELECT conv_id, count(*) AS messages, substr(min_by(coalesce(quote, text), turn), 1, 80) AS title, max(turn) AS last FROM msg GROUP BY 1", more=_MSG),
    "m6_rewrite_context": sql(
        "SELECT book_id * 1000 + page AS passage_id, substr(text, 1, 200) AS before, substr(text, 201, 60) AS passage, substr(text, 261, 900) AS after, CASE WHEN length(text) > 600 THEN 'v' || (book_id * 1000 + page) END AS version, answer FROM (SELECT * FROM pt WHERE length(text) > 400) LEFT JOIN (SELECT conv_id, max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1) ON conv_id = book_id % 100",
        "blocks",
        more=_PAGES,
    ),
    "m7_merge_generated_cards": sql(
        f"""SELECT unit_id, kind, front, back, CASE WHEN unit_id IN (SELECT unit_id FROM units WHERE kind = 'body') THEN 'active' ELSE 'pending' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY {_SQ.format('front')} ORDER BY unit_id, n) AS r FROM c WHERE trim(front) <> '' AND (kind = 'cloze' OR back <> '')) WHERE r = 1 AND {_SQ.format('front')} NOT IN (SELECT {_SQ.format('w')} FROM b WHERE type = 'code')""",
        "blocks",
        "units",
        more={
            "b": "SELECT unit_id, n, type, array_to_string(string_split(text, ' ')[1:2], ' ') AS w FROM blocks",
            "c": "SELECT unit_id, n, CASE WHEN n % 3 = 0 THEN 'cloze' ELSE 'basic' END AS kind, CASE WHEN n % 3 = 0 THEN '{{c1::' || w || '}}' ELSE w END AS front, CASE WHEN n % 3 = 1 THEN 'back' ELSE '' END AS back FROM b",
        },
    ),
    "m8_merge_generated_concepts": sql(
        "SELECT book_id, key, round(importance, 6) AS importance, definition, w, label FROM m LEFT JOIN e USING (book_id, key)",
        "terms",
        more={
            "c": f"SELECT no % 3 AS book_id, {sql_term_key('key')} AS key, key AS name, no FROM terms",
            "m": "SELECT book_id, key, max(importance) AS importance, min(definition) AS definition FROM (SELECT book_id, key, CAST(0.5 AS DOUBLE) AS importance, NULL AS definition FROM c WHERE no % 2 = 0 UNION ALL SELECT book_id, key, greatest(0.15, least(1.0, (no % 7) / 5.0)), 'about ' || name FROM c WHERE key <> '') GROUP BY ALL",
            "e": "SELECT book_id, key, round(max(greatest(0.1, least(1.0, (no % 300) / 100.0))), 6) AS w, max(CASE WHEN key < 'middle' THEN 'part-of' ELSE 'part-of←' END) AS label FROM c WHERE key NOT IN ('', 'middle') GROUP BY ALL",
        },
    ),
    "m9_match_quotes": sql(
        "SELECT quote_id, coalesce(i, m) AS block_id FROM q LEFT JOIN inn USING (quote_id) LEFT JOIN mo USING (quote_id) WHERE coalesce(i, m) IS NOT NULL",
        "blocks",
        more={
            "q": "SELECT block_id AS quote_id, unit_id, CASE WHEN block_id % 2 = 0 THEN translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE reverse(substr(text, 1, 5)) || ' ' || array_to_string(string_split(text, ' ')[1:9], ' ') END AS quote FROM blocks WHERE length(text) > 40",
            "inn": f"SELECT quote_id, min(block_id) AS i FROM q JOIN blocks USING (unit_id) WHERE {_SQ.format('quote')} <> '' AND contains({_SQ.format('text')}, {_SQ.format('quote')}) GROUP BY 1",
            "qw": f"SELECT quote_id, unit_id, len(w) AS n, unnest(w) AS word FROM (SELECT quote_id, unit_id, {_LONG.format('quote')} AS w FROM q)",
            "bw": f"SELECT unit_id, block_id, unnest({_LONG.format('text')}) AS word FROM blocks",
            "mo": "SELECT quote_id, max_by(block_id, (k, -block_id)) AS m FROM (SELECT quote_id, block_id, n, count(*) AS k FROM qw JOIN bw USING (unit_id, word) GROUP BY ALL HAVING k >= least(3, n)) GROUP BY 1",
        },
    ),
    "m10_pending_jobs": sql("SELECT unit_id, job FROM (SELECT DISTINCT unit_id, kind FROM done JOIN units USING (unit_id) WHERE kind IN ('body', 'exercises')), (SELECT unnest(['cards', 'concepts']) AS job) WHERE NOT (job = 'cards' AND kind = 'exercises')", "reads", "units", more=_DONE),
    "m11_generation_units": sql(
        "SELECT unit_id, known FROM (SELECT book_id, unit_id FROM blocks GROUP BY ALL HAVING sum(length(text)) >= 400) LEFT JOIN (SELECT book_id, string_agg(key, ', ' ORDER BY r) AS known FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY importance DESC, key) AS r FROM (SELECT book_id, split_part(text, ' ', 1) AS key, max(length(text)) AS importance FROM blocks WHERE n = 0 GROUP BY ALL)) WHERE r <= 5 GROUP BY 1) USING (book_id)",
        "blocks",
    ),
}
