"""Removal with all that hangs on it, snippets as a full-text index gives them, words found on pages, and the text around concepts."""

import re

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import annotations as N
from quirelight.operators import knowledge as K
from quirelight.operators import search as Q
from quirelight.operators import units as U
from quirelight.sources import tables as S


def make(spark, name, rows):
    """Rows of a study table from dicts; fields that are not given are null."""
    schema = S.schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def library(spark):
    rows = {n: [] for n in S.SCHEMAS}
    for b in (1, 2):
        k = 10 * b
        rows["books"].append({"id": b})
        rows["sections"] += [{"id": k, "book_id": b}, {"id": k + 1, "book_id": b, "parent_id": k}]
        rows["blocks"] += [{"id": k, "book_id": b}, {"id": k + 1, "book_id": b}]
        rows["reads"] += [{"learner_id": 1, "block_id": k}, {"learner_id": 2, "block_id": k + 1}]
        rows["page_reads"].append({"learner_id": 1, "book_id": b, "page": 0})
        rows["reading_time"].append({"learner_id": 1, "book_id": b, "ms": 5})
        rows["highlights"].append({"id": b, "book_id": b})
        rows["versions"].append({"id": b, "book_id": b})
        rows["cards"].append({"id": k, "book_id": b})
        rows["review_log"] += [{"id": k, "card_id": k}, {"id": k + 1, "card_id": k}]
        rows["concepts"] += [{"key": f"own {b}"}]
        rows["concept_books"] += [{"key": f"own {b}", "book_id": b}, {"key": "both", "book_id": b}]
        rows["mentions"] += [{"key": f"own {b}", "block_id": k}, {"key": "both", "block_id": k}]
        rows["edges"].append({"a": f"own {b}", "b": "both", "book_id": b})
        rows["card_concepts"] += [{"card_id": k, "key": "both"}, {"card_id": k, "key": f"own {b}"}]
        rows["chats"].append({"id": b, "book_id": b})
        rows["chat_messages"] += [{"id": k, "chat_id": b}, {"id": k + 1, "chat_id": b}]
        rows["unit_jobs"].append({"unit_id": k, "job": "cards"})
    rows["concepts"] += [{"key": "both"}, {"key": "of no book"}]
    rows["cards"].append({"id": 99})  # of no book
    rows["review_log"].append({"id": 99, "card_id": 99})
    # a concept of the book that stays hangs on the one that goes
    rows["card_concepts"].append({"card_id": 20, "key": "own 1"})
    return {n: make(spark, n, r) for n, r in rows.items()}


def test_remove_books_leaves_nothing_behind(spark, library):
    out = S.remove_books(library, spark.createDataFrame([(1,)], "book_id long"))
    left = {n: df.count() for n, df in out.items()}
    assert left == {
        "books": 1, "sections": 2, "blocks": 2, "reads": 2, "page_reads": 1, "reading_time": 1, "highlights": 1, "versions": 1, "cards": 2, "review_log": 3, "concepts": 2, "concept_books": 2,
        "mentions": 2, "edges": 1, "card_concepts": 2, "chats": 1, "chat_messages": 2, "unit_jobs": 1,
    }
    assert {r["key"] for r in out["concepts"].collect()} == {"own 2", "both"}
    assert out["cards"].filter("id = 99").count() == out["review_log"].filter("card_id = 99").count() == 1
    assert S.orphans(out).filter("n > 0").count() == 0
    assert all(df.columns == library[n].columns for n, df in out.items())


def test_replace_books_takes_what_hangs_on_the_content(spark, library):
    new = {"blocks": make(spark, "blocks", [{"id": 15, "book_id": 1}])}
    out = S.replace_books(library, new, spark.createDataFrame([(1,)], "book_id long"))
    assert {r["id"] for r in out["blocks"].collect()} == {15, 20, 21}
    assert out["reads"].count() == 2 and out["mentions"].count() == 2 and out["review_log"].count() == 3 and out["unit_jobs"].count() == 1
    assert out["highlights"].count() == 2 and out["versions"].count() == 2 and out["page_reads"].count() == 2 and out["chats"].count() == 2


def snippets(spark, rows):
    df = spark.createDataFrame(rows, "i long, text string, q array<string>")
    return {r["i"]: r["s"] for r in df.select("i", Q.snippet(F.col("text"), F.col("q")).alias("s")).collect()}


def test_snippet_keeps_the_text(spark):
    rows = [(0, "The Café Matrix, however, is NOT invertible.", ["matrix"]), (1, "  (Cafés) are open… ", ["cafe"]), (2, "—", ["x"]), (3, "", ["x"])]
    assert snippets(spark, rows) == {0: "The Café \x01Matrix\x02, however, is NOT invertible.", 1: "  (\x01Cafés\x02) are open… ", 2: "—", 3: ""}


def test_snippet_is_the_index_snippet(spark):
    rng = random.Random(2)
    words = ["alpha", "Béta", "gamma", "delta", "CAFÉ", "alphabet", "x1", "naïve"]
    ends = [" ", " ", " ", " ", ", ", ". ", ": ", ".\n", " - ", "."]
    rows = []
    for i in range(250):
        text = rng.choice(["", "“", " "]) + "".join(rng.choice(words if rng.random() < 0.3 else ["so", "it", "is"]) + rng.choice(ends) for _ in range(rng.choice([3, 14, 15, 40, 90])))
        rows.append((i, text, rng.choice([["alpha"], ["beta", "gam"], ["cafe", "naive", "alp"], ["is", "del"]])))
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, x) values (?, ?)", [r[:2] for r in rows])
    want = {}
    for i, _, q in rows:
        match = " ".join(f'"{w}"' for w in q) + "*"
        found = con.execute("select snippet(t, 0, char(1), char(2), '…', 14) from t where t match ? and rowid = ?", (match, i)).fetchone()
        if found:
            want[i] = found[0]
    got = snippets(spark, rows)
    assert len(want) > 100
    assert {i: got[i] for i in want} == want


def test_find_all(spark):
    pages = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "the inver-\nsion of a Ma\ntrix, a MATRIX and ma trix ½"), (2, 0, "matrix " * 300)], "book_id long, page int, text string")
    queries = spark.createDataFrame([(7, 1, ["aa", "inversion", "matrix", "a"]), (8, 2, ["trix", "matrix"]), (9, 1, [])], "query_id long, book_id long, words array<string>")
    rows = N.find_all(queries, pages).orderBy("query_id", "page", "place").collect()
    text = {(r["book_id"], r["page"]): r["text"] for r in pages.collect()}
    assert [(r["page"], text[1, r["page"]][r["start"] : r["end"]]) for r in rows if r["query_id"] == 7] == [(0, "aa"), (0, "aa"), (1, "inver-\nsion"), (1, "Ma\ntrix"), (1, "MATRIX"), (1, "ma trix")]
    many = [r for r in rows if r["query_id"] == 8]
    # the first word takes all places there are
    assert len(many) == 200 and all(r["end"] - r["start"] == 4 for r in many) and [r["place"] for r in many] == list(range(1, 201))


def test_fold_text(spark):
    texts = ["", "A B", "co-\noperate", "co­\noperate", "ﬁne\n½ İstanbul", "Ｆull　width", "a-b\n-\nc", "漢 字"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_text(F.col("t")).alias("f"))
    got = {r["t"]: (r["f"]["folded"], r["f"]["map"]) for r in df.collect()}
    assert got["A B"] == ("ab", [0, 2]) and got["co-\noperate"] == ("cooperate", [0, 1, 4, 5, 6, 7, 8, 9, 10])
    assert got["co­\noperate"][0] == "cooperate" and got["a-b\n-\nc"] == ("a-bc", [0, 1, 2, 6]) and got["漢 字"] == ("漢字", [0, 2])
    assert got["ﬁne\n½ İstanbul"] == ("fine1⁄2i̇stanbul", [0, 0, 1, 2, 4, 4, 4, 6, 6, 7, 8, 9, 10, 11, 12, 13]) and got["Ｆull　width"][0] == "fullwidth" and got[""] == ("", [])


def test_concept_mentions_by_name(spark):
    long = "x" * 100 + " The Eigenvalues of a map " + "y" * 200
    mentions = spark.createDataFrame([("eigenvalue", 1, "b"), ("eigenvalue", 2, "b"), ("eigenvalue", 3, "a")], "key string, block_id long, book_id string")
    blocks = spark.createDataFrame([(1, long), (2, "Short."), (3, "an eigenvalues table")], "block_id long, text string")
    names = spark.createDataFrame([("eigenvalue", "Eigenvalues")], "key string, name string")
    definitions = spark.createDataFrame([("eigenvalue", 2)], "key string, def_block_id long")
    reads = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "learner_id long, block_id long")
    rows = K.concept_mentions(mentions, blocks, definitions, names, reads).orderBy("rank").collect()
    at = long.index("Eigenvalues")
    assert [(r["block_id"], r["is_def"], r["readers"], r["snippet"]) for r in rows] == [
        (2, True, 0, "Short."), (3, False, 0, "an eigenvalues table"), (1, False, 2, "…" + long[at - 90 : at + 161] + "…"),
    ]


def test_section_ends_of_a_long_book(spark):
    n = 20_000
    sections = spark.range(n).select(F.lit(1).alias("book_id"), F.col("id").alias("section_id"), F.col("id").alias("ord"), (1 + F.col("id") % 3).cast("int").alias("level"), F.col("id").cast("int").alias("page"))
    ends = {r[0]: r[1] for r in U.section_end_page(sections, spark.createDataFrame([(1, n)], "book_id int, page_count int")).select("section_id", "end_page").collect()}
    want = lambda i: min([j for j in range(i + 1, min(n, i + 4)) if j % 3 <= i % 3], default=n)
    assert all(ends[i] == want(i) for i in range(n))


def test_concept_is_found_where_its_first_letter_has_no_capital(spark, tmp_path):
    """k9 names concepts with capitals; a sharp s has none of its own and is to be found all the same."""
    text = "Kopf\n" + "und so weiter " * 12 + "hier steht ßkeiten am Ende"
    spark.createDataFrame([(i, text, "de", "src1", len(text)) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    from quirelight.plans import knowledge

    found = [r.snippet for r in knowledge.k9(spark, str(tmp_path)).filter("key like '%ßkeiten%'").collect()]
    assert len(found) >= 3 and all("ßkeiten" in s and s.startswith("…") for s in found)


def test_a_word_that_many_queries_ask_for_is_met_once(spark):
    postings = spark.createDataFrame([("the", b, 1) for b in range(30)] + [("rare", 3, 2), ("rarely", 4, 1)], "term string, block_id long, tf long")
    queries = spark.createDataFrame([(k, "the rar") for k in range(4)] + [(8, "the none"), (9, "rare")], "query_id long, query string")
    assert Q._hits(Q.query_words(queries), postings).count() == 30 + 2 + 2
    got = {tuple(r)[:2]: r.score for r in Q.rank(queries, postings).collect()}
    assert got.keys() == {(k, b) for k in range(4) for b in (3, 4)} | {(9, 3), (9, 4)}
    assert all(got[k, b] == got[0, b] for k in range(4) for b in (3, 4)) and got[0, 3] > got[0, 4]


def test_a_row_of_a_place_does_not_carry_the_map_of_its_page(spark):
    pages = spark.createDataFrame([(1, 0, "Two words, two  WORDS"), (1, 1, "ﬁve")], "book_id long, page int, text string")
    found = N.find_all(spark.createDataFrame([(7, 1, ["words", "five"])], "query_id long, book_id long, words array<string>"), pages)
    placed = N.place_quotes(spark.createDataFrame([(3, 1, 0, 12, "twowords")], "quote_id long, book_id long, page int, hint int, quote string"), pages)
    assert [tuple(r) for r in found.orderBy("page", "place").select("page", "start", "end").collect()] == [(0, 4, 9), (0, 16, 21), (1, 0, 3)]
    assert [tuple(r) for r in placed.collect()] == [(3, 0, 11, 21)]
    for df in (found, placed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\b(t|map|_extract_map)#", plan)


def test_folding_goes_letter_by_letter_where_letters_depend_on_their_neighbours(spark):
    """A capital sigma at a word's end is a small one like any other; small tables and the whole one give the same."""
    texts = ["ΟΔΟΣ a", "Straße … ﬀ", "plain\tASCII-\nhere", "naïve Œuvre—x", "\U0001d400bc Ａ", "İi"]
    got = {r.t: (r.f.folded, r.f.map) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_text(F.col("t")).alias("f")).collect()}
    assert [got[t][0] for t in texts] == ["οδοσa", "straße...ff", "plainasciihere", "naïveœuvre—x", "abca", "i̇i"]
    assert got["plain\tASCII-\nhere"][1] == [*range(5), *range(6, 11), *range(13, 17)] and got["İi"][1] == [0, 0, 1]
    assert all(len(folded) == len(places) for folded, places in got.values())


def test_terms_are_cleaned_alike_with_and_without_letters_beyond_ascii(spark):
    runs = ["Café’s crèmes", "“Vector spaces”", "the vector", "rate of change of", "Ünıts", "Proof of x", "x=1 and", "４th", None, ""]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(runs)], "k int, t string").orderBy("k").select(T.clean_term(F.col("t"))).collect()]
    assert got == ["Café’s crèmes", "Vector spaces", None, None, "Ünıts", None, None, "４th", None, None]
    words = spark.createDataFrame([("Café’s ﬂows Ａlphas it's",)], "t string").select(T.term_words(F.col("t"))).first()[0]
    assert words == ["cafe", "flow", "alphas", "it"]


def test_outlines_count_words_as_often_as_they_stand(spark):
    from quirelight.operators import layout as L

    kind = "book_id long, page int, ord int, text string, size double, bold int, n int, role string"
    rows = [(1, 0, 0, "a a b", 10.0, 0, 5, "body"), (1, 0, 1, "a b b b", 10.0, 0, 7, "body"), (1, 0, 2, "c", 10.0, 0, 1, "body")]
    outline = spark.createDataFrame([(1, 5, "1.2 b b a b c", 0)], "book_id long, entry int, title string, page int")
    body = spark.createDataFrame([(1, 10.0)], "book_id long, body_size double")
    found = L.match_outline(outline, spark.createDataFrame(rows, kind), body)
    assert [tuple(r) for r in found.select("entry", "page", "ord", "score").collect()] == [(5, 0, 1, 1.0)]
    joins = re.split(r"Join", found._jdf.queryExecution().optimizedPlan().toString())
    assert "RegExpExtractAll" not in joins[0] and "regexp_extract_all" not in joins[0]  # words are found before the pairs are made
