"""What the steps that most queries share send through a shuffle: once, by the key that carries least."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from quirelight.operators import concepts as C
from quirelight.operators import knowledge as K
from quirelight.operators import layout as L
from quirelight.operators import search as Q
from quirelight.operators import units as U
from quirelight.plans import concepts as PC
from quirelight.plans import knowledge as P
from quirelight.sources import fixtures as X


def exchanges(df):
    """The columns of each exchange by hash, the last one first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_terms_go_through_one_shuffle(spark, sf):
    assert "key, unit_id" not in exchanges(X.terms(spark, sf))


def test_pairs_of_terms_go_by_their_first_term(spark):
    rows = [("b", 1), ("a", 1), ("c", 1), ("a", 2), ("b", 2), ("b", 2)] + [(f"k{i:02}", 3) for i in range(26)]
    pairs = C.cooccurrence(spark.createDataFrame(rows, "key string, block_id long"), spark.createDataFrame([("c", "a"), ("c", "c")], "key string, used string"))
    assert "a, b" not in exchanges(pairs)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b", 2), ("a", "c", 3), ("b", "c", 1)]


def test_exposure_is_shuffled_once_by_learner_and_term(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mentions = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1)], "key string, block_id long, count long")
        reads = spark.createDataFrame([(7, 1), (7, 1), (8, 2)], "learner_id long, block_id long")
        found = K.exposure(mentions, reads)
        assert exchanges(found)[0] == "learner_id, key"
        assert sorted(map(tuple, found.select("learner_id", "key", "total", "read").collect())) == [(7, "a", 3, 2), (7, "b", 1, 1), (8, "a", 3, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_section_progress_is_not_shuffled_as_a_whole(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "learner_id, unit_id" not in exchanges(U.section_progress(X.units(spark, sf), X.reads(spark, sf), X.blocks(spark, sf)))[:1]
        units = spark.createDataFrame([(u, "x", "body") for u in (1, 2, 3)] + [(4, "y", "body")], "unit_id long, book_id string, kind string")
        blocks = spark.createDataFrame([(10, 1, "x", 4), (11, 1, "x", 4), (20, 2, "x", 5), (30, 3, "x", 0), (40, 4, "y", 1)], "block_id long, unit_id long, book_id string, weight int")
        reads = spark.createDataFrame([(7, 10), (7, 30), (8, 40)], "learner_id long, block_id long")
        found = U.section_progress(units, reads, blocks).select("learner_id", "unit_id", "fraction").collect()
        assert sorted(map(tuple, found)) == [(7, 1, 0.5), (7, 2, 0.0), (7, 3, 0.0), (8, 4, 1.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cards_travel_with_their_concepts(spark):
    on = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "card_id long, key string")
    cards = spark.createDataFrame([(7, 1, "pending"), (7, 2, "active"), (8, 1, "active")], "learner_id long, card_id long, status string")
    found = K.concept_cards(on, cards)
    assert "learner_id, key" not in exchanges(found)
    assert sorted(map(tuple, found.select("learner_id", "key", "card_id", "rank").collect())) == [(7, "a", 1, 2), (7, "a", 2, 1), (7, "b", 1, 1), (8, "a", 1, 1), (8, "b", 1, 1)]


def test_what_is_no_term_is_not_shuffled(spark):
    words = spark.range(4000).selectExpr("concat('w', id) AS word", "id AS block_id")
    anchors = spark.range(0, 4000, 40).selectExpr("concat('w', id) AS word")
    left = {x.word for x in C._sieve(words, anchors).collect()}
    assert {f"w{n}" for n in range(0, 4000, 40)} <= left and len(left) < 1000


def test_figures_of_terms_are_shuffled_once_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mentions = spark.createDataFrame([("x", "a", 1, 2), ("x", "a", 2, 1), ("x", "b", 1, 1)], "book_id string, key string, unit_id long, count long")
        said = spark.createDataFrame([("x", "a", "A"), ("x", "a", "a"), ("x", "a", "A"), ("x", "c", "c")], "book_id string, key string, surface string")
        found = C.term_stats(said, mentions)
        assert exchanges(found) == ["book_id, key"] * 2
        assert sorted(map(tuple, found.select("key", "announced", "form", "total", "units").collect())) == [("a", 3, "A", 3, 2), ("c", 1, "c", 0, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_terms_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        forms = spark.createDataFrame([("x", "ab", "Ab", True), ("x", "ab", "ab", False), ("x", "ab", "Ab", True), ("x", "bb cc", "Bb Cc", True)], "book_id string, key string, surface string, heading boolean")
        found = C.display_names(forms, spark.createDataFrame([("x", "z", "z")], "book_id string, key string, surface string"))
        assert exchanges(found) == ["book_id, key"] * 2  # the second is of the definitions
        assert sorted(map(tuple, found.collect())) == [("x", "ab", "ab"), ("x", "bb cc", "bb cc")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rollup_goes_by_term_alone(spark):
    mentions = spark.createDataFrame([("x", "a", 3, 2), ("y", "a", 4, 1), ("x", "b", 5, 1)], "book_id string, key string, block_id long, count long")
    found = P._rollup(None, None, mentions)
    assert set(exchanges(found)) == {"key"}
    assert sorted(map(tuple, found.select("key", "definition", "books").collect())) == [("a", "as in x", "x,y"), ("b", None, "x")]


def test_definitions_travel_with_their_block(spark):
    defined = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("a", 2)], "key string, def_block_id long")
    reads = spark.createDataFrame([(7, 1), (7, 2), (7, 1), (8, 2), (8, 3)], "learner_id long, block_id long")
    found = K.definition_read(defined, reads)
    assert "learner_id, key" not in exchanges(found)
    assert sorted(map(tuple, found.collect())) == [(7, "a"), (7, "b"), (8, "a")]


def test_figures_come_to_python_many_pages_at_once(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    shapes = spark.createDataFrame([(1, p, 100.0, 100.0, 200.0, 200.0, "image", False, 50_000) for p in (0, 1)], f"book_id long, page int, {box}, kind string, rect boolean, pixels int")
    pages = spark.createDataFrame([(1, p, 600.0, 640.0) for p in (0, 1)], "book_id long, page int, width double, height double")
    lines = spark.createDataFrame([(1, 0, 0, 120.0, 140.0, 160.0, 150.0, 5, 10.0, 0, "axis", "body")], f"book_id long, page int, ord int, {box}, n int, size double, mono int, text string, role string")
    found = L.figure_regions(shapes, pages, lines, spark.createDataFrame([(1, 10.0)], "book_id long, body_size double"))
    assert "FlatMap" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page, r.kind, r.x0, r.y1, r.photo, r.text) for r in found.collect()) == [(0, "figure", 100.0, 200.0, True, "axis"), (1, "figure", 100.0, 200.0, True, "")]


def test_postings_of_a_block_are_made_in_its_row(spark):
    found = Q.build_postings(spark.createDataFrame([(1, "b a B c"), (2, ""), (3, "a")], "block_id long, text string"))
    assert not exchanges(found)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1, [1]), ("a", 3, 1, [0]), ("b", 1, 2, [0, 2]), ("c", 1, 1, [3])]


def test_a_line_is_profiled_in_its_row(spark):
    char = lambda i, c, x, size=10.0, flags=0: (i, c, x, x + 5, 100.0 + i, size, "A", flags)
    kind = "book_id long, page int, line int, chars array<struct<i:int,c:string,x0:double,x1:double,baseline:double,size:double,font:string,flags:int>>"
    rows = [(1, 0, 0, [char(2, "c", 20.0, 7.0, 1), char(0, "a", 0.0), char(1, "b", 5.0, 7.0, 3)]), (1, 0, 1, [])]
    found = L.profile_lines(spark.createDataFrame(rows, kind))
    assert not exchanges(found)
    assert [(r["text"], r["baseline"], r["size"], r["n"], r["bold"], r["italic"]) for r in found.orderBy("line").collect()] == [("ab c", 101.0, 7.0, 3, 2, 1), ("", None, None, 0, 0, 0)]
    apart = spark.createDataFrame(rows, kind).selectExpr("book_id", "page", "line", "inline(chars)")
    assert L.line_profile(apart).collect() == found.filter("n > 0").collect()


def test_footnotes_sort_no_line_to_look_up_its_book_or_page(spark, sf):
    from quirelight.plans import layout

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.l13(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("ShuffledHashJoin") >= 3


def _crowded(spark, monkeypatch):
    """Two blocks of 30 terms each as the mentions of all queries."""
    rows = [(f"k{i:02}", b, u, "x", 1) for b, u in ((1, 11), (2, 12)) for i in range(30)]
    m = spark.createDataFrame(rows, "key string, block_id long, unit_id long, book_id string, count long")
    monkeypatch.setattr(P, "_mentions", lambda *_: m)
    monkeypatch.setattr(PC, "_mentions", lambda *_: m)


def test_a_units_graph_has_all_its_concepts_and_blocks(spark, sf, monkeypatch):
    _crowded(spark, monkeypatch)
    assert P.k8(spark, sf).count() == 30 * 29 // 2
    many = spark.range(K.NODES + 1).selectExpr("'x' AS book_id", "concat('k', id) AS key", "id AS block_id", "1L AS count")
    assert (P._rollup(None, None, many).count(), P._rollup(None, None, many, None).count()) == (K.NODES, K.NODES + 1)


def test_neighbours_come_from_blocks_of_many_terms_too(spark, sf, monkeypatch):
    _crowded(spark, monkeypatch)
    assert P.k11(spark, sf).count() == 30 * 16


def test_knowledge_is_put_together_where_the_learner_is(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        concepts = spark.createDataFrame([("a", 2.0, 4), ("b", 1.0, 1), ("c", 1.0, 9)], "key string, importance double, total long")
        mentions = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("b", 1, 1), ("c", 3, 9)], "key string, block_id long, count long")
        reads = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (8, 4)], "learner_id long, block_id long")
        definitions = spark.createDataFrame([("a", 2), ("b", 4)], "key string, def_block_id long")
        on = spark.createDataFrame([(1, "c"), (1, "a"), (1, "z")], "card_id long, key string")
        cards = spark.createDataFrame([(7, 1, "active", None, 0), (8, 1, "pending", None, 0)], "learner_id long, card_id long, status string, stability double, state int").withColumn("last_review", F.lit(None).cast("timestamp"))
        found = K.knowledge(concepts, mentions, reads, definitions, on, cards, F.current_timestamp())
        assert not {"learner_id, key", "key, learner_id"} & set(exchanges(found)) and exchanges(found).count("learner_id") == 1
        assert sorted(map(tuple, found.select("learner_id", "key", "read", "cards", "mastery", "state").collect())) == [(7, "a", 2, 1, 0.2, "unseen"), (7, "b", 1, 0, 0.4, "seen"), (7, "c", 0, 1, 0.0, "unseen"), (8, "a", 2, 0, 0.2, "seen")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cards_with_their_concepts_are_neither_shuffled_nor_sorted(spark):
    on = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "d")], "card_id long, key string")
    kind = "learner_id long, card_id long, status string, stability double, state int, last_review timestamp"
    now = datetime(2024, 1, 1)
    cards = spark.createDataFrame([(7, 1, "pending", 9.0, 2, now), (7, 2, "active", 9.0, 2, now), (7, 3, "active", 1.0, 3, now), (8, 1, "active", None, 0, None), (8, 9, "active", None, 0, None)], kind)
    few = K.HELD
    try:
        for K.HELD in (few, -1):  # what cards are on comes to each task, and by card
            found, known = K.concept_cards(on, cards), K.recall(on, cards, F.lit(now))
            for df in (found, known):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "Window" not in plan and exchanges(df)[0] == ("learner_id" if K.HELD < 0 else exchanges(df)[-1])
            assert sorted(map(tuple, found.select("learner_id", "key", "card_id", "rank").collect())) == [(7, "a", 1, 3), (7, "a", 2, 1), (7, "a", 3, 2), (7, "b", 1, 1), (8, "a", 1, 1), (8, "b", 1, 1)]
            got = sorted(map(tuple, known.select("learner_id", "key", "cards", "n", "recall", "stable", "learning").collect()))
            assert got == [(7, "a", 2, 2, 1.0, 1, 1), (8, "a", 1, 0, None, 0, 0), (8, "b", 1, 0, None, 0, 0)]
    finally:
        K.HELD = few


def test_merged_edges_go_by_one_end(spark):
    side = lambda edges: {
        "concepts": spark.createDataFrame([("a", "A", 1)], "key string, name string, ord long"), "concept_books": spark.createDataFrame([("a", "x", 1)], "key string, book_id string, importance long"),
        "mentions": spark.createDataFrame([("a", 1, 1)], "key string, block_id long, count long"), "edges": spark.createDataFrame(edges, "a string, b string, w long"),
    }
    found = C.merge_concepts(side([("b", "a", 2), ("a", "c", 1), ("a", "b", 4)]), side([("a", "b", 3), ("c", "a", 5)]))["edges"]
    assert "a, b" not in exchanges(found)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 4), ("a", "c", 5)]


def test_units_of_a_piece_meet_a_learner_as_one_list(spark, sf):
    plan = U.section_progress(X.units(spark, sf), X.reads(spark, sf), X.blocks(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(_units", plan)


def test_a_graphs_pairs_are_made_of_its_nodes_only(spark, sf, monkeypatch):
    # 26 terms are too many for a block, whichever of them are nodes
    rows = [(f"k{i:02}", b, b, "x", 1 + (i < 3)) for b in (1, 2) for i in range(25)] + [(f"k{i:02}", 3, 3, "x", 1) for i in range(26)]
    m = spark.createDataFrame(rows, "key string, block_id long, unit_id long, book_id string, count long")
    nodes = spark.createDataFrame([("k00",), ("k01",), ("k02",)], "key string")
    got = C.cooccurrence(m, among=nodes)
    assert sorted(map(tuple, got.collect())) == [("k00", "k01", 2), ("k00", "k02", 2), ("k01", "k02", 2)]
    monkeypatch.setattr(P, "_rollup", lambda *_: nodes)
    assert P._graph(spark, sf, m)[1].count() == 3


def test_names_of_a_rollup_come_from_distinct_terms(spark):
    mentions = spark.createDataFrame([("x", "a", 3, 2), ("y", "a", 4, 1), ("x", "b", 5, 1)], "book_id string, key string, block_id long, count long")
    plan = P._rollup(None, None, mentions)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("REPARTITION_BY_COL", plan)) == 1
