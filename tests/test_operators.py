"""Small literal cases: what the operators mean, and that folds, closed forms and merges agree with plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quirelight.functions import text as T
from quirelight.operators import annotations, concepts, layout, search, srs, units
from quirelight.sources import tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_term_keys(spark):
    cases = {"Vector Spaces": "vector space", "Probabilities": "probability", "Café": "cafe", "basis": "basis", "analysis": "analysis", "mathematics": "mathematics", "ﬁelds": "field", "Ｖｅｃｔｏｒ": "vector", "Ἀρχή": "αρχη", "Straße": "straße"}
    rows = spark.createDataFrame(list(cases.items()), "x string, want string").select(T.term_key(F.col("x")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_clean_term(spark):
    got = {x: one(spark, x, T.clean_term) for x in ("“argument”", "Proof.", "is a", "the function", "4th", "a=b", "rate of change", "one of the few and many")}
    assert got["“argument”"] == "argument" and got["rate of change"] == "rate of change"
    assert [got[x] for x in ("Proof.", "is a", "the function", "4th", "a=b", "one of the few and many")] == [None] * 6


def test_sentence_keeps_abbreviations(spark):
    text = "First one here. We use e.g. Trees for this. Then stop."
    at = text.index("Trees")
    assert one(spark, text, lambda x: T.sentence_at(x, F.lit(at), F.lit(at + 5))) == "We use e.g. Trees for this."


def test_longest_mentions(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "paragraph", "A vector space has a linear map. The vector maps on; linear maps map vector spaces.")], "block_id long, unit_id long, book_id long, type string, text string")
    terms = spark.createDataFrame([("vector",), ("vector space",), ("linear map",)], "key string")
    got = {r["key"]: r["count"] for r in concepts.find_mentions(blocks, terms).collect()}
    assert got == {"vector": 1, "vector space": 2, "linear map": 2}


def test_queue_equals_loop(spark):
    """The queue by place is what a loop makes: due cards one by one, a new card after each gap, what is left at the end."""
    sizes = [(d, n) for d in (0, 1, 2, 5, 9, 30) for n in (0, 1, 2, 4, 7, 30)]
    due = [(k, c, c) for k, (d, _) in enumerate(sizes) for c in range(d)]
    new = [(k, 100 + c, c) for k, (_, n) in enumerate(sizes) for c in range(n)]
    kind = "learner_id long, card_id long, place int"
    got = {}
    for r in srs.review_queue(spark.createDataFrame(due, kind), spark.createDataFrame(new, kind), limit=45).orderBy("learner_id", "queue").collect():
        got.setdefault(r["learner_id"], []).append(r["card_id"])
    for k, (n_due, n_new) in enumerate(sizes):
        want, fresh = [], iter(range(100, 100 + n_new))
        gap = max(1, n_due // max(1, n_new))
        for i in range(n_due):
            want.append(i)
            if (i + 1) % gap == 0 and (x := next(fresh, None)) is not None:
                want.append(x)
        want += list(fresh)
        assert got.get(k, []) == want[:45], (n_due, n_new)


def test_edit_and_list_cards(spark):
    cards = spark.createDataFrame([(1, 9, 1, "a", "b", "active"), (2, 9, 2, "c", "d", "pending"), (3, 8, 1, "e", "f", "active")], "card_id long, book_id long, unit_id long, front string, back string, status string")
    patch = spark.createDataFrame([(1, "A", None, None), (3, None, None, "removed")], "card_id long, front string, back string, status string")
    got = srs.edit_cards(cards, patch)
    assert [(r["card_id"], r["front"], r["back"]) for r in srs.list_cards(got, book_id=9).collect()] == [(1, "A", "b"), (2, "c", "d")]
    assert srs.list_cards(got, unit_id=1).count() == 1


def test_review_undo_and_queue(spark):
    at = dt.datetime(2024, 1, 1, 8)
    log = spark.createDataFrame([(1, 7, 1, 3, at), (1, 7, 2, 3, at + dt.timedelta(minutes=10))], "learner_id long, card_id long, review_id long, rating int, review timestamp")
    after = srs.replay(log).first()
    assert after["state"] == 2 and after["reps"] == 2 and after["lapses"] == 0
    before = srs.replay(srs.undo_last(log)).first()
    assert before["state"] == 1 and before["reps"] == 1 and before["due"] == at + dt.timedelta(minutes=10)
    cards = srs.replay(log).withColumns({"status": F.lit("active"), "unit_id": F.lit(1)})
    later = F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert srs.due_cards(cards, later).count() == 1
    assert srs.due_cards(cards.withColumn("status", F.lit("pending")), later).count() == 0


def test_units_split(spark):
    rows = [(1, 1, 1, 0), (1, 2, 1, 10), (1, 3, 2, 12), (1, 4, 2, 40)]
    sections = units.section_parents(spark.createDataFrame([(b, s, s, lvl, p, "body") for b, s, lvl, p in rows], "book_id long, section_id long, ord long, level int, page int, kind string"))
    books = spark.createDataFrame([(1, 80)], "book_id long, page_count int")
    got = {r["section_id"]: (r["parent_id"], r["is_unit"], r["unit_id"]) for r in units.plan_units(units.section_end_page(sections, books)).collect()}
    assert got == {1: (None, True, 1), 2: (None, True, 2), 3: (2, True, 3), 4: (2, True, 4)}


def test_finish_at_eighty_five_percent(spark):
    blocks = spark.createDataFrame([(1, 1, 40), (2, 1, 60)], "block_id long, unit_id long, weight int")
    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([(5, 1, t)], "learner_id long, block_id long, seen timestamp")
    both = first.union(spark.createDataFrame([(5, 2, t + dt.timedelta(1))], first.schema))
    assert units.units_finished(first, blocks).count() == 0
    assert units.units_finished(both, blocks).first()["finished_at"] == t + dt.timedelta(1)


def _layer(spark):
    text = ["The process is the OS's abstrac-", "tion of a running program.", "A second paragraph starts here."]
    rows, at = [], 0
    for k, x in enumerate(text):
        rows.append((1, 0, k, at, x, 50.0, 100.0 + 12 * k, 50.0 + 5 * len(x), 110.0 + 12 * k, 5.0))
        at += len(x) + 1
    lines = spark.createDataFrame(rows, "book_id long, page int, line int, start int, text string, x0 double, y0 double, x1 double, y1 double, step double")
    return lines, spark.createDataFrame([(1, 0, "\n".join(text))], "book_id long, page int, text string"), "\n".join(text)


def test_passages(spark):
    lines, pages, text = _layer(spark)
    q = spark.createDataFrame([(9, 1, 0, 0, "the OS's  abstraction of a RUNNING program")], "quote_id long, book_id long, page int, hint int, quote string")
    hit = annotations.place_quotes(q, pages).first()
    assert text[hit["start"] : hit["end"]] == "the OS's abstrac-\ntion of a running program"
    r = spark.createDataFrame([(1, 1, 0, hit["start"], hit["end"])], "range_id long, book_id long, page int, start int, end int")
    assert annotations.range_rects(r, lines).count() == 2
    rect = spark.createDataFrame([(1, 1, 0, 0.0, 111.0, 600.0, 140.0)], "rect_id long, book_id long, page int, rx0 double, ry0 double, rx1 double, ry1 double")
    got = annotations.range_in_rect(rect, lines).first()
    assert text[got["start"] : got["end"]] == "tion of a running program.\nA second paragraph starts here."
    assert one(spark, text.split("\nA")[0], T.clean_text) == "The process is the OS's abstraction of a running program."


def test_merge_is_independent_of_order(spark):
    rows = [(random.Random(k).randrange(4), k, k % 7) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    rules = {"a": "sum", "b": "max"}
    x = tables.merge_rows(df.filter("a < 20"), df.filter("a >= 20"), ["k"], rules)
    y = tables.merge_rows(df.filter("a >= 20"), df.filter("a < 20"), ["k"], rules)
    assert sorted(x.collect()) == sorted(y.collect())


def test_remove_books(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "book_id long, x string")
    assert tables.remove_books({"blocks": df}, spark.createDataFrame([], "book_id long"))["blocks"].count() == 2
    assert [r["x"] for r in tables.remove_books({"blocks": df}, spark.createDataFrame([(1,)], "book_id long"))["blocks"].collect()] == ["b"]


LINE = "book_id long, page int, ord int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string, role string, joiner string, boxed int, n int, mono int, bold int, italic int"


def _lines(spark, rows):
    """rows: (page, ord, block, x0, y0, text) and more as keywords."""
    out = []
    for page, o, block, x0, y0, text, *more in rows:
        x = {"size": 10.0, "role": "body", "joiner": " ", "boxed": 0, "mono": 0, "x1": x0 + 5.0 * len(text)} | (more[0] if more else {})
        out.append((1, page, o, block, x0, y0, x["x1"], y0 + 10.0, x["size"], text, x["role"], x["joiner"], x["boxed"], len(text), x["mono"], 0, 0))
    return spark.createDataFrame(out, LINE)


def test_paragraph_breaks(spark):
    full = {"x1": 290.0}
    rows = [
        (0, 0, 0, 50.0, 100.0, "A first paragraph that goes on to the", full), (0, 1, 0, 50.0, 112.0, "next line of it and ends.", {"x1": 170.0}), (0, 2, 0, 60.0, 124.0, "An indented one starts, and breaks off in mid-", {"joiner": "", "x1": 290.0}),
        (1, 0, 1, 50.0, 100.0, "clause over the page.", {"x1": 150.0}), (1, 1, 1, 50.0, 140.0, "A gap starts this one", full), (1, 2, 2, 50.0, 152.0, "and another block goes on in lower case."),
        (1, 3, 2, 50.0, 164.0, "• an item that", full), (1, 4, 2, 70.0, 176.0, "Hangs on. And", full), (1, 5, 2, 90.0, 188.0, "More of it."), (1, 6, 2, 50.0, 220.0, "No item any more", full), (1, 7, 2, 70.0, 232.0, "Same again, indented after a full line"),
        (1, 8, 3, 50.0, 244.0, "Title", {"role": "heading"}), (1, 9, 3, 50.0, 256.0, "after a heading,"), (1, 10, 3, 50.0, 268.0, "Figure", {"role": "figure"}), (1, 11, 3, 50.0, 280.0, "Goes on after a figure"), (1, 12, 3, 50.0, 292.0, "in a box", {"boxed": 1}), (1, 13, 3, 50.0, 304.0, "in small print", {"size": 8.0, "boxed": 1}),
    ]
    got = [(r["kind"], r["text"]) for r in layout.assemble_paragraphs(_lines(spark, rows)).orderBy("para").collect()]
    assert got == [
        ("paragraph", "A first paragraph that goes on to the next line of it and ends."), ("paragraph", "An indented one starts, and breaks off in midclause over the page."), ("paragraph", "A gap starts this one and another block goes on in lower case."),
        ("list", "• an item that Hangs on. And More of it."), ("paragraph", "No item any more Same again, indented after a full line"), ("paragraph", "after a heading, Goes on after a figure"), ("paragraph", "in a box"), ("paragraph", "in small print"),
    ]


def test_figures_boxes_and_labels(spark):
    pages = spark.createDataFrame([(1, 0, 600.0, 640.0)], "book_id long, page int, width double, height double")
    body = spark.createDataFrame([(1, 10.0)], "book_id long, body_size double")
    shape = "book_id long, page int, x0 double, y0 double, x1 double, y1 double, kind string, rect boolean, pixels int"
    v = lambda *b, rect=False: (1, 0, *map(float, b), "vector", rect, 0)
    shapes = [v(10, 10, 50, 50), v(52, 20, 90, 60), v(0, 0, 599, 639), v(300, 30, 480, 90, rect=True), v(100, 200, 101, 290), v(102.5, 210, 103, 280), (1, 0, 300.0, 300.0, 400.0, 380.0, "image", False, 90_000), v(401, 310, 430, 360), v(20, 560, 580, 561)]
    rows = [(0, 0, 0, 92.0, 30.0, "axis"), (0, 1, 0, 305.0, 40.0, "A theorem in a panel, whose text fills"), (0, 2, 0, 305.0, 52.0, "the panel that is drawn around it here"), (0, 3, 1, 50.0, 600.0, "Prose far away from all of the figures on this page."), (0, 4, 2, 310.0, 320.0, "label")]
    got = layout.figure_regions(spark.createDataFrame(shapes, shape), pages, _lines(spark, rows), body).orderBy("region").collect()
    assert [(r["kind"], r["x0"], r["x1"], r["photo"], r["text"]) for r in got] == [("figure", 10.0, 112.0, False, "axis"), ("figure", 300.0, 430.0, True, "label"), ("box", 300.0, 480.0, False, "")]


def test_footnotes_need_a_rule_or_a_reference(spark):
    pages = spark.createDataFrame([(1, p, 600.0, 640.0) for p in range(5)], "book_id long, page int, width double, height double")
    body = spark.createDataFrame([(1, 10.0)], "book_id long, body_size double")
    small = {"size": 8.0}
    note = lambda p, *texts, top=500.0: [(p, 0, 0, 50.0, 100.0, "Body text of the page")] + [(p, k + 1, 1, 50.0, top + 12 * k, t, small) for k, t in enumerate(texts)]
    rows = note(0, "1 A note under a rule", "goes on", "* Another") + note(1, "and on, over the page", "2 Next") + note(2, "3 Cited on the next page") + note(3, "9 Cited nowhere") + note(4, "3 Too near the text above", top=112.0)
    rules = spark.createDataFrame([(1, p, 50.0, 495.0, 150.0, 496.0) for p in (0, 1)] + [(1, 2, 50.0, 90.0, 150.0, 91.0)], "book_id long, page int, x0 double, y0 double, x1 double, y1 double")
    refs = spark.createDataFrame([(1, 3, "3")], "book_id long, page int, label string")
    got = {(r["page"], r["note"], r["label"], r["text"]) for r in layout.footnotes(_lines(spark, rows), pages, body, rules, refs).collect()}
    assert got == {(0, 1, "1", "1 A note under a rule goes on"), (0, 2, "*", "* Another"), (1, 0, None, "and on, over the page"), (1, 1, "2", "2 Next"), (2, 1, "3", "3 Cited on the next page")}


def test_list_levels_are_rounded(spark):
    rows = [(0, k, 0, 50.0 + x, 100.0 + 12 * k, "• item") for k, x in enumerate((0, 10, 12, 32, 34, 99))]
    columns = spark.createDataFrame([(1, 0, 50.0, 500.0)], "book_id long, page int, left double, right double")
    body = spark.createDataFrame([(1, 10.0)], "book_id long, body_size double")
    assert [r["level"] for r in layout.list_items(_lines(spark, rows), columns, body).orderBy("ord").collect()] == [0, 0, 1, 1, 2, 2]


def test_trim_looks_at_the_middle_of_a_book(spark):
    boxes = [(1, p, 40.0 if 8 <= p < 92 else 0.0, 50.0, 500.0, 700.0) for p in range(100) if p % 2 == 0 or p < 20]
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(100)], "book_id long, page int, width double, height double")
    got = layout.book_trim(spark.createDataFrame(boxes, "book_id long, page int, x0 double, y0 double, x1 double, y1 double"), pages).orderBy("side").collect()
    assert [(r["side"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [(0, 26.0, 36.0, 514.0, 714.0), (1, 26.0, 36.0, 514.0, 714.0)]
    few = layout.book_trim(spark.createDataFrame(boxes[:2], "book_id long, page int, x0 double, y0 double, x1 double, y1 double"), pages)
    assert few.count() == 0


def test_glossary_and_concepts_that_stay(spark):
    b = [(1, 0, "heading", "Glossary of terms"), (1, 1, "paragraph", "x"), (1, 2, "heading", "1 Definitions"), (1, 3, "paragraph", "y")]
    got = concepts.glossary_flag(spark.createDataFrame(b, "book_id long, ord long, type string, text string")).orderBy("ord").collect()
    assert [r["in_glossary"] for r in got] == [False, True, False, False]
    stats = [("unused entry", 0, 0, True, True, False, False), ("entry", 1, 1, True, True, False, False), ("once", 1, 1, True, False, False, False), ("time", 5, 1, False, False, True, False), ("two words", 2, 1, False, False, True, False)]
    df = spark.createDataFrame([(1, k, t, u, 1, d, g, h, m) for k, t, u, d, g, h, m in stats], "book_id long, key string, total long, units long, announced long, defined boolean, glossary boolean, heading boolean, marked boolean")
    assert {r["key"] for r in concepts.score_concepts(df).collect()} == {"entry", "two words"}


def test_display_names(spark):
    forms = [("variable", "Variables", False), ("variable", "Variables", False), ("variable", "variable", False), ("vector space", "Vector Spaces", True), ("time", "Time", True), ("cpu", "CPU", False), ("map", "Map", False)]
    cand = spark.createDataFrame([(1, *f) for f in forms], "book_id long, key string, surface string, heading boolean")
    defs = spark.createDataFrame([(1, "variable", "variable"), (1, "cpu", "processor")], "book_id long, key string, surface string")
    got = {r["key"]: r["name"] for r in concepts.display_names(cand, defs).collect()}
    assert got == {"variable": "variable", "vector space": "vector spaces", "time": "Time", "cpu": "CPU", "map": "map"}


def test_search_leaves_out_indexes_and_other_books(spark):
    blocks = spark.createDataFrame([(k, 1 + k % 2, k, 10 * k, "paragraph", "alpha beta gamma") for k in range(4)], "block_id long, book_id long, unit_id long, section_id long, type string, text string")
    units_ = spark.createDataFrame([(k, "index" if k == 3 else "body") for k in range(4)], "unit_id long, kind string")
    sections = spark.createDataFrame([(10 * k, "contents" if k == 2 else "body") for k in range(4)], "section_id long, kind string")
    queries = spark.createDataFrame([(1, "Alpha be", None), (2, "alpha", 2)], "query_id long, query string, book_id long")
    got = {(r["query_id"], r["block_id"]) for r in search.search(queries, search.term_counts(blocks), blocks, units_, sections).collect()}
    assert got == {(1, 0), (1, 1), (2, 1)}


def test_text_folds_compatibility_letters(spark):
    got = one(spark, "ﬁrst ½ Ａ-\nb", T.fold_text)
    assert got["folded"] == "first1⁄2ab" and got["map"] == [0, 0, 1, 2, 3, 5, 5, 5, 7, 10]
    assert one(spark, "ﬁnd ＴＨＥ x²", T.search_terms) == ["find", "THE", "x2"]
    assert one(spark, "ﬂow & Μῆνιν", lambda x: T.title_tokens(x)) == ["flow", "μηνιν"]


def test_deep_sections(spark):
    rows = [(1, k, k, k, 10 * k, "index" if k == 7 else "body") for k in range(1, 10)] + [(1, 10, 10, 1, 95, "body")]
    sections = units.section_parents(spark.createDataFrame(rows, "book_id long, section_id long, ord long, level int, page int, kind string"))
    assert {r["section_id"]: r["parent_id"] for r in sections.collect()} == {k: None if k in (1, 10) else k - 1 for k in range(1, 11)}
    assert {r["section_id"] for r in units.inherit_kind(sections).filter("kind = 'index'").collect()} == {7, 8, 9}
    books = spark.createDataFrame([(1, 120)], "book_id long, page_count int")
    got = {r["section_id"]: (r["unit_id"], r["end_page"]) for r in units.plan_units(units.section_end_page(sections, books)).collect()}
    assert got == {k: (1, 95) for k in range(1, 10)} | {10: (10, 120)}


def test_replace_books_everywhere(spark, tmp_path):
    t = {
        "books": spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string"), "blocks": spark.createDataFrame([(10, 1), (20, 2)], "id long, book_id long"), "reads": spark.createDataFrame([(5, 10), (5, 20)], "learner_id long, block_id long"),
        "cards": spark.createDataFrame([(7, 1), (8, 2)], "id long, book_id long"), "page_reads": spark.createDataFrame([(1,), (2,)], "book_id long"), "concepts": spark.createDataFrame([("x", "X")], "key string, name string"),
    }
    new = {"blocks": spark.createDataFrame([(11, 1)], "id long, book_id long"), "concepts": spark.createDataFrame([("x", "other"), ("y", "Y")], "key string, name string")}
    out = tables.replace_books(t, new, spark.createDataFrame([(1,)], "book_id long"))
    root = f"file://{tmp_path}/study"
    tables.publish(t, root)
    tables.publish(out, root)
    got = {n: sorted(map(tuple, df.collect())) for n, df in tables.current(spark, root, list(out)).items()}
    assert got == {"books": [(1, "a"), (2, "b")], "blocks": [(11, 1), (20, 2)], "reads": [(5, 20)], "cards": [(8, 2)], "page_reads": [(1,), (2,)], "concepts": [("x", "X"), ("y", "Y")]}




def test_totals_beyond_bigint_are_whole(spark, sf, tmp_path):
    """s4 over learners so high that their card ids add up to more than a BIGINT: the SQL without its last cast says the same."""
    import os
    import re

    import duckdb

    from quirelight.plans import tables

    con = duckdb.connect()
    for name in os.listdir(sf):
        os.symlink(f"{sf}/{name}", f"{tmp_path}/{name}") if name != "events.parquet" else con.execute(f"COPY (SELECT * REPLACE (user_id + 9000000000 AS user_id) FROM '{sf}/{name}') TO '{tmp_path}/{name}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{name}'")
    want = {r[0]: (r[1], r[2]) for r in con.execute(re.sub(r"CAST\((coalesce\(sum\([^,]*, 0\)) AS BIGINT\) AS total", r"\1 AS total", tables.ORACLE["s4_remove_books"])).fetchall()}
    found = tables.s4(spark, str(tmp_path))
    assert {r.name: (r.n, int(r.total)) for r in found.collect()} == want and want["cards"][1] > 2**63
    assert found.schema["total"].dataType.simpleString() == "decimal(38,0)" and tables.s4(spark, sf).schema["total"].dataType.simpleString() == "bigint"


def test_every_block_counts_where_no_bound_is_set(spark):
    rows = spark.createDataFrame([(f"k{i:02}", b) for b in (1, 2) for i in range(40)], "key string, block_id long")
    assert concepts.cooccurrence(rows).count() == 0
    pairs = concepts.cooccurrence(rows, per_block=None)
    assert {(r.a < r.b, r.n) for r in pairs.collect()} == {(True, 2)} and pairs.count() == 40 * 39 // 2
