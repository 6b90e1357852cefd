"""Context for model jobs, the text layer of pages, and the profile of an import, on small literal tables."""

from datetime import datetime

from pyspark.sql import functions as F

from quirelight.operators import context as M
from quirelight.operators import layout as L
from quirelight.sources import tables as S


def at(day):
    return datetime(2024, 1, day)


def test_context_pages(spark):
    text = {0: "before", 1: "the in-\nverse of\na map", 2: "second open page", 3: " \n ", 5: "far"}
    pages = spark.createDataFrame([(1, p, t) for p, t in text.items()] + [(2, 0, None)], "book_id long, page int, text string")
    fields = "request_id long, book_id long, pages array<int>, page int, start int, end int"
    rows = [(1, 1, [2, 1, 2], 1, 4, 13), (2, 1, [0], None, None, None), (3, 1, [3], 3, 0, 2), (4, 1, [5], 5, 2, 2), (5, 2, [0], None, None, None), (6, 1, [], None, None, None)]
    got = {r["request_id"]: r["text"] for r in M.context_pages(spark.createDataFrame(rows, fields), pages).collect()}
    one = "[page 2]\nthe >>> inverse <<< of a map"
    assert got == {
        1: f"[page 1]\nbefore\n\n{one}\n\n[page 3]\nsecond open page",  # page 4 is blank
        2: "[page 1]\nbefore\n\n[page 2]\nthe inverse of a map",
        3: "[page 3]\nsecond open page",
        4: "[page 6]\nfar",
    }
    tight = {r["request_id"]: r["text"] for r in M.context_pages(spark.createDataFrame(rows[:2], fields), pages, budget=45).collect()}
    assert tight[1] == f"{one}\n\n[page 3]\nsecond open page"  # open pages come first: 16 and 28 characters, no room for 6 more
    least = {r["request_id"]: r["text"] for r in M.context_pages(spark.createDataFrame(rows[:1], fields), pages, budget=3).collect()}
    assert least == {1: "[page 3]\nsecond open page"}


def test_reader_context(spark):
    requests = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 12)], "learner_id long, unit_id long")
    highlights = spark.createDataFrame(
        [(1, 10, 1, at(1), "old", None), (1, 10, 2, at(3), "q" * 300, "n" * 400), (1, 10, 3, at(3), "newest", ""), (1, 11, 4, at(9), "elsewhere", ""), (3, 10, 5, at(9), "someone else", "")],
        "learner_id long, unit_id long, id long, updated timestamp, quote string, note string",
    )
    mentions = spark.createDataFrame([(k, 10) for k in "abcdefg"] + [("a", 10), ("h", 12)], "key string, unit_id long")
    concepts = spark.createDataFrame([(k, f"{k.upper()}!", w) for k, w in zip("abcdefgh", (1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 7.0, 1.0), strict=True)], "key string, name string, importance double")
    nodes = spark.createDataFrame([(1, "a", "known"), (1, "b", "fading"), (1, "c", "learning"), (1, "d", "learning"), (1, "e", "unseen"), (1, "g", "seen"), (2, "h", "seen")], "learner_id long, key string, state string")
    styles = spark.createDataFrame([(1, "  in pictures "), (2, " ")], "learner_id long, style string")
    out = {(r["learner_id"], r["unit_id"]): r["text"] for r in M.reader_context(requests, highlights, mentions, concepts, nodes, styles, n_quotes=2).collect()}
    assert out == {
        (1, 10): f'Highlighted in this chapter, with notes:\n- "newest"\n- "{"q" * 220}" — note: {"n" * 300}\n\nConcepts of this chapter:\nKnows: A!\nLearning or forgetting: D!, C!, B!\nNot met yet: E!, F!\n\nExplain like this: in pictures',
        (1, 11): 'Highlighted in this chapter:\n- "elsewhere"\n\nExplain like this: in pictures',
        (2, 10): "Concepts of this chapter:\nNot met yet: G!, E!, F!, D!, C!, B!, A!",
        (2, 12): "",
    }
    two = M.reader_context(requests, highlights, mentions, concepts, nodes, n_concepts=1).filter("learner_id = 1 and unit_id = 10").first()["text"]
    assert two.endswith("Knows: A!\nLearning or forgetting: D!, B!\nNot met yet: E!")  # one of each state, two states on a line


def test_page_text(spark):
    rows = [(1, 0, 2, "c", 1.0), (1, 0, 0, "añb", 1.0), (1, 0, 1, "", 1.0), (1, 0, 3, None, 1.0), (1, 1, 0, "next", 2.0)]
    lines = spark.createDataFrame(rows, "book_id long, page int, ord int, text string, x0 double").withColumns({c: F.lit(0.0) for c in ("y0", "x1", "y1")})
    got = {r["page"]: r for r in L.page_text(lines).collect()}
    assert got[0]["text"] == "añb\n\nc" and [(x["ord"], x["start"]) for x in got[0]["lines"]] == [(0, 0), (1, 4), (2, 5)]
    assert got[1]["text"] == "next" and got[1]["lines"][0]["x0"] == 2.0
    assert L.page_text(lines.limit(0)).count() == 0


def test_profile_and_warnings(spark):
    lines = spark.createDataFrame([(1, 0, 50), (1, 1, 40), (2, 0, 39)], "book_id long, page int, n int")
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "book_id long, page int")
    outline = spark.createDataFrame([(b, e) for b in (1, 2) for e in range(3)] + [(3, 0), (3, 1)], "book_id long, entry int")
    told = L.import_warnings(lines, pages, outline, spark.createDataFrame([(1,), (1,)], "book_id long"))
    assert sorted(tuple(r) for r in told.collect()) == [(2, L.NO_TEXT), (2, L.NO_OUTLINE), (3, L.NO_TEXT)]
    blocks = spark.createDataFrame([(1, "heading", 5, 0), (1, "code", 5, 7), (1, "code", 6, 2)], "book_id long, type string, unit_id long, weight int")
    parts = {"sections": spark.createDataFrame([(1, 1), (4, 1)], "book_id long, id long"), "edges": spark.createDataFrame([], "book_id long, a string")}
    got = {r["book_id"]: (r["n_heading"], r["n_code"], r["n_units"], r["weight"], r["n_sections"], r["n_edges"], r["warnings"]) for r in S.profile_books(blocks, ["heading", "code"], parts, told).collect()}
    assert got == {1: (1, 2, 2, 9, 1, 0, ""), 2: (0, 0, 0, 0, 0, 0, f"{L.NO_TEXT}\n{L.NO_OUTLINE}"), 3: (0, 0, 0, 0, 0, 0, L.NO_TEXT), 4: (0, 0, 0, 0, 1, 0, "")}
