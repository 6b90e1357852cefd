"""Layout mining over page lines. lines: book_id, page, ord, block, x0, y0, x1, y1, baseline, size, font, text, n (characters), bold,
italic, mono, math (characters of that style), and role (body until a stage takes the line). A stage reads lines whose role is body.

Everything is joins, windows and aggregates by book or page, but for figures, which grow in steps: those run page by page, and a
page is bounded."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, norm_key, run_starts, title_words, without_numbering

# Patterns of lines, as the semantics define them.
BULLET = r"^([•◦▪▫‣⁃●○■□►▸–—·∙∗*])\s+"
ENUMERATOR = r"^(\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)])\s+(?=\S)"
CAPTION = r"(?i)^(fig(?:ure)?|table|tab\.|exhibit|chart|diagram|plate|illustration|listing|graph|map|photo)\.?\s*[\dA-Z]"
TERMINAL = r"[.!?:][\"”’')\]]*$"
HEADING_LABEL = (
    r"^((?:[Cc]hapter|CHAPTER|[Pp]art|PART|[Aa]ppendix|APPENDIX|[Ss]ection|[Ll]ecture|[Uu]nit|[Ll]esson|[Mm]odule|[Bb]ook)\s+[\dIVXLCDMA-Z]+[.:]?"
    r"|\d+(?:\.\d+)*\.?|[A-Z]\.\d+(?:\.\d+)*\.?|\d+[A-Z]|[IVXLC]+\.)\s+(.+)$"
)
PAGE_NUMBER = r"(?i)^(page\s+)?(\d{1,4}|[ivxlcdm]{1,7})(\s+of\s+\d+)?$"
# End of fixed values.
NO_TEXT, NO_OUTLINE = "no text layer", "outline did not match"


def _lower_percentile(values: Column, p: float) -> Column:
    """The exact lower percentile of a column of a group."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(p * (F.size(ordered) - 1)).cast("int"))


def line_profile(chars: DataFrame) -> DataFrame:
    """L1 for characters that come one a row. chars: book_id, page, line, i, c, x0, x1, baseline, size, font, flags."""
    rows = chars.groupBy("book_id", "page", "line").agg(F.collect_list(F.struct(*CHAR)).alias("chars"))
    return profile_lines(rows)


CHAR = ("i", "c", "x0", "x1", "baseline", "size", "font", "flags")


def _most(values: Column) -> Column:
    """What is most often in an array, the larger on ties."""

    def often(x: Column) -> Column:
        def among(kinds: Column) -> Column:
            times = F.transform(kinds, lambda v: F.struct(F.size(F.filter(x, lambda y: y.eqNullSafe(v))).alias("k"), v.alias("v")))
            return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(F.array_max(times)["v"])

        return bound(F.array_distinct(x), among)

    return bound(values, often)


def profile_lines(lines: DataFrame) -> DataFrame:
    """L1: one line from its characters: dominant size (quarter points, the larger on ties) and font, median baseline, style counts, text
    with inferred spaces (gaps of 0.2 to 6 em). lines: book_id, page, line, chars (array of i, c, x0, x1, baseline, size, font, flags, in
    any order). A line comes with its characters, so it is read where it stands; one without any has n = 0 and no size."""

    def spaced(x: Column) -> Column:
        def letter(y: Column, k: Column) -> Column:
            def after(last: Column) -> Column:
                gap = y["x0"] - last["x1"]
                return F.when((gap > 0.2 * y["size"]) & (gap < 6 * y["size"]) & (y["c"] != " ") & (last["c"] != " "), F.concat(F.lit(" "), y["c"])).otherwise(y["c"])

            return F.when(k == 0, y["c"]).otherwise(after(F.get(x, k - 1)))

        return F.array_join(F.transform(x, letter), "")

    def middle(x: Column) -> Column:
        n = F.size(x) - 1
        return (F.get(x, F.floor(n / 2).cast("int")) + F.get(x, F.ceil(n / 2).cast("int"))) / 2

    def median(x: Column) -> Column:
        return F.when(F.array_min(x) == F.array_max(x), F.array_min(x)).otherwise(bound(F.sort_array(x), middle))

    own = lambda c: F.transform("chars", lambda y: y[c])
    style = lambda bit: F.size(F.filter("chars", lambda y: y["flags"].bitwiseAND(bit) != 0)).cast("long")
    return lines.withColumn("chars", F.sort_array("chars")).select(
        "book_id", "page", "line", bound(F.col("chars"), spaced).alias("text"), bound(F.array_compact(own("baseline")), median).alias("baseline"), F.array_min(own("x0")).alias("x0"), F.array_max(own("x1")).alias("x1"),
        F.size("chars").cast("long").alias("n"), style(1).alias("bold"), style(2).alias("italic"), style(4).alias("mono"), style(32).alias("math"),
        _most(F.transform("chars", lambda y: F.round(y["size"] * 4) / 4)).alias("size"), _most(own("font")).alias("font"),
    )


def merge_rows(lines: DataFrame) -> DataFrame:
    """L2: lines of one block and baseline (within 0.3 of the size), each to the right of the one before, as one; cells counts real gaps."""
    w = Window.partitionBy("book_id", "page", "block").orderBy("ord")
    joined = (F.abs(F.col("baseline") - F.lag("baseline").over(w)) <= 0.3 * F.col("size")) & (F.col("x0") >= F.lag("x1").over(w) - 0.5)
    rows = lines.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_gap", F.when(F.col("_new") == 0, (F.col("x0") - F.lag("x1").over(w) > 1.5 * F.col("size")).cast("int")).otherwise(0))
    rows = rows.withColumn("_row", F.sum("_new").over(w))
    return rows.groupBy("book_id", "page", "block", "_row").agg(
        F.min("ord").alias("ord"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.sum("n").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"), (1 + F.sum("_gap")).alias("cells"),
    ).drop("_row")


def body_style(lines: DataFrame) -> DataFrame:
    """L3: body_size (half points) and body_font of each book: what most characters have (the smaller, the first, on ties)."""
    half = F.round(F.col("size") * 2) / 2
    size = lines.groupBy("book_id", half.alias("s")).agg(F.sum("n").alias("k")).groupBy("book_id").agg(F.max_by("s", F.struct("k", -F.col("s"))).alias("body_size"))
    font = lines.groupBy("book_id", "font").agg(F.sum("n").alias("k")).groupBy("book_id").agg(F.min_by("font", F.struct(-F.col("k"), "font")).alias("body_font"))
    return size.join(font, "book_id")


def text_layer_warning(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """L4: book_id, warning (boolean): fewer than forty characters a page. pages: book_id, page."""
    n = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    chars = lines.groupBy("book_id").agg(F.sum("n").alias("chars"))
    return n.join(chars, "book_id", "left").select("book_id", (F.coalesce("chars", F.lit(0)) < 40 * F.col("pages")).alias("warning"))


def import_warnings(lines: DataFrame, pages: DataFrame, outline: DataFrame, matched: DataFrame) -> DataFrame:
    """book_id, warning: "no text layer" (L4), and "outline did not match" for an outline of three entries or more that found no
    lines (L15 drops all matches of a book where too few are found). outline: book_id, entry; matched: book_id."""
    bare = text_layer_warning(lines, pages).filter("warning").select("book_id", F.lit(NO_TEXT).alias("warning"))
    listed = outline.groupBy("book_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 3")
    return bare.union(listed.join(matched.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(NO_OUTLINE)))


def page_text(lines: DataFrame) -> DataFrame:
    """book_id, page, text, lines: a page's lines in order (array of ord, start, x0, y0, x1, y1), their text joined by line breaks, and
    where each starts in it, in code points from 0. Lines without text (null) are left out; empty ones stay. lines: book_id, page, ord,
    text, x0, y0, x1, y1."""
    w = Window.partitionBy("book_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    rows = lines.filter("text is not null").select("book_id", "page", "ord", "text", *BOX, start.alias("start"))
    out = rows.groupBy("book_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "start", *BOX, "text"))).alias("x"))
    places = F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in ("ord", "start", *BOX)]))
    return out.select("book_id", "page", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"), places.alias("lines"))


def text_columns(lines: DataFrame, body: DataFrame, pages: DataFrame) -> DataFrame:
    """Left and right of each page's text: the tenth percentile of left edges and ninetieth of right ones over long body lines; 12 and
    88 percent of the width where there are fewer than three. pages: book_id, page, width."""
    rows = lines.join(body, "book_id").filter((F.abs(F.col("size") - F.col("body_size")) < 0.5) & (F.col("n") > 20))
    found = rows.groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("k"), _lower_percentile(F.col("x0"), 0.1).alias("l"), _lower_percentile(F.col("x1"), 0.9).alias("r")).filter("k >= 3")
    return pages.join(found, ["book_id", "page"], "left").select("book_id", "page", F.coalesce("l", 0.12 * F.col("width")).alias("left"), F.coalesce("r", 0.88 * F.col("width")).alias("right"))


def _margin(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The first and last two lines of each page that lie in its margins of 16 percent."""
    up = Window.partitionBy("book_id", "page").orderBy("y0", "ord")
    down = Window.partitionBy("book_id", "page").orderBy(F.desc("y0"), F.desc("ord"))
    rows = lines.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).join(pages.select("book_id", "page", "height"), ["book_id", "page"])
    return rows.withColumn("_edge", ((F.col("_u") <= 2) & (F.col("y0") < 0.16 * F.col("height"))) | ((F.col("_d") <= 2) & (F.col("y1") > 0.84 * F.col("height")))).drop("_u", "_d", "height")


def mark_running_heads(lines: DataFrame, pages: DataFrame, body: DataFrame) -> DataFrame:
    """Role head for margin lines whose text (digits aside) recurs at one height on three pages or more."""
    rows = _margin(lines, pages).join(body, "book_id").withColumns({"_key": norm_key(F.col("text")), "_y": F.floor(F.col("y0") / 6)})
    often = rows.filter("_edge").groupBy("book_id", "_key", "_y").agg(F.count_distinct("page").alias("_pages"))
    out = rows.join(often, ["book_id", "_key", "_y"], "left")
    head = F.col("_edge") & (F.coalesce("_pages", F.lit(0)) >= 3) & F.col("text").rlike(r"\p{L}") & (F.col("size") <= 1.3 * F.col("body_size")) & (F.col("role") == "body")
    return out.withColumn("role", F.when(head, "head").otherwise(F.col("role"))).select(*lines.columns)


def mark_page_numbers(lines: DataFrame, pages: DataFrame, votes: int = 3) -> DataFrame:
    """Role page_number for margin lines that are one. A book's printed numbers are ahead of its pages by the most voted offset, if it
    has three votes; then numbers off it are not page numbers; roman ones always are."""
    rows = _margin(lines, pages).withColumns({"_text": F.trim("text")}).withColumn("_is", F.col("_edge") & F.col("_text").rlike(PAGE_NUMBER))
    number = F.regexp_extract("_text", r"(\d{1,4})", 1).try_cast("int")
    rows = rows.withColumn("_off", F.when(F.col("_is"), number - F.col("page")))
    best = rows.filter("_off is not null").groupBy("book_id", "_off").agg(F.count_distinct("page").alias("k")).filter(F.col("k") >= votes).groupBy("book_id").agg(F.max_by("_off", F.struct("k", -F.col("_off"))).alias("_best"))
    out = rows.join(best, "book_id", "left")
    good = F.col("_is") & (F.col("_off").isNull() | (F.col("_off") == F.col("_best"))) & (F.col("role") == "body")
    return out.withColumn("role", F.when(F.coalesce(good, F.lit(False)), "page_number").otherwise(F.col("role"))).select(*lines.columns)


REGION = "book_id long, page int, kind string, region int, x0 double, y0 double, x1 double, y1 double, photo boolean, text string"
BOX = ["x0", "y0", "x1", "y1"]


def _area(b: np.ndarray) -> np.ndarray:
    return np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])


def _meet(a: np.ndarray, b: np.ndarray, pad) -> np.ndarray:
    """Which boxes of a and b overlap if they are widened by pad."""
    return (a[..., 0] < b[..., 2] + pad) & (a[..., 2] > b[..., 0] - pad) & (a[..., 1] < b[..., 3] + pad) & (a[..., 3] > b[..., 1] - pad)


def _middle_in(rows: np.ndarray, box: np.ndarray, pad: float) -> np.ndarray:
    x, y = (rows[:, 0] + rows[:, 2]) / 2, (rows[:, 1] + rows[:, 3]) / 2
    return (x >= box[0] - pad) & (x <= box[2] + pad) & (y >= box[1] - pad) & (y <= box[3] + pad)


def _hull(boxes: np.ndarray) -> np.ndarray:
    return np.concatenate([boxes[:, :2].min(0), boxes[:, 2:].max(0)])


def _boxes(rows: dict[str, Sequence]) -> np.ndarray:
    return np.array([rows[c] for c in BOX], float).T.reshape(-1, 4)


def _page_regions(shapes: dict[str, Sequence], lines: dict[str, Sequence], width: float, height: float, body: float) -> list[tuple]:
    """(kind, box, photo, text) of one page's figures and text boxes; see figure_regions."""
    page = width * height
    box, image = _boxes(shapes), np.array(shapes["kind"], object) == "image"
    w, h = box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]
    fits = np.where(image, (_area(box) >= 150) & (_area(box) <= 0.9 * page), ((w >= 0.6) | (h >= 0.6)) & (_area(box) <= 0.85 * page))
    box, image, w, h = box[fits], image[fits], w[fits], h[fits]
    if not len(box):
        return []
    rule = ~image & ((h <= 1.6) | (w <= 1.6))
    rect = np.array(shapes["rect"], bool)[fits] & ~image & ~rule
    drawn = ~image & ~rule & ~rect
    photo = image & (np.array(shapes["pixels"], float)[fits] > 40_000) & (w > 60)
    touch = _meet(box[:, None], box[None], np.where(rule[:, None] | rule[None], 1.0, 3.0))
    group = np.arange(len(box))
    while True:  # the least number that is reached over touching boxes
        new = np.where(touch, group[None], len(box)).min(1)
        if (new == group).all():
            break
        group = new
    at, n = _boxes(lines), np.array(lines["n"], float)
    size, mono, text = np.array(lines["size"], float), np.array(lines["mono"], float), list(lines["text"])
    free = np.ones(len(n), bool)
    out = []
    for k in np.unique(group):
        own = group == k
        hull = _hull(box[own])
        with_image, frames = image[own].any(), box[own & rect]
        inner = (_area(frames)[None] > _area(frames)[:, None]) & _meet(frames[None], frames[:, None], -0.5)
        loose = int((~inner.any(1)).sum()) if len(frames) else 0
        made = int((drawn & own).sum()) + (loose if loose >= 3 else 0)
        if not with_image and _area(hull) > 0.55 * page:
            continue
        inside = free & _middle_in(at, hull, 1)
        chars = n[inside].sum()
        if not with_image and chars > 0 and mono[inside].sum() >= 0.6 * chars:
            continue
        prose = n[inside & (n >= 35) & (size >= 0.85 * body) & (mono < 0.5 * n)].sum()
        dense = _area(at[inside]).sum() / max(1.0, _area(hull))
        if not with_image and chars >= 30 and (dense >= 0.2 or prose >= 0.45 * chars) and (drawn & own).sum() <= 4:
            if hull[2] - hull[0] > 60 and hull[3] - hull[1] > 1.5 * body:
                out.append(["box", hull, False, ""])
            continue
        if not with_image and (made < 2 or hull[2] - hull[0] < 40 or hull[3] - hull[1] < 24) or with_image and _area(hull) < 900:
            continue
        for _ in range(2):
            for i in np.flatnonzero(free):
                middle = _middle_in(at[i : i + 1], hull, 0)[0]
                if middle or n[i] < 40 and _meet(at[i], hull, 5):
                    hull = _hull(np.stack([hull, at[i]]))
        taken = free & _middle_in(at, hull, 1)
        if (taken & (n >= 45) & (size >= 0.9 * body)).sum() > 4:
            continue
        free &= ~taken
        words = " ".join(text[i] for i in sorted(np.flatnonzero(taken), key=lambda i: (at[i, 1], at[i, 0])))
        out.append(["figure", hull, bool(photo[own].any()) and made < 4, words])
    boxes, merged = [x for x in out if x[0] == "box"], []
    for x in sorted((x for x in out if x[0] == "figure"), key=lambda x: x[1][1]):
        last = next((m for m in merged if _meet(m[1], x[1], 2)), None)
        if last is None:
            merged.append(x)
        else:
            last[1:] = [_hull(np.stack([last[1], x[1]])), last[2] and x[2], f"{last[3]} {x[3]}".strip()]
    return merged + boxes


def figure_regions(shapes: DataFrame, pages: DataFrame, lines: DataFrame, body: DataFrame) -> DataFrame:
    """book_id, page, kind, region, box, photo, text: figures ("figure") and panels around running text ("box") of each page.

    Images and drawn shapes that touch (within 3; thin rules within 1) are one. Frames of the whole page, shaded code, and shapes that are
    too few or too small for a drawing are none; a panel that text fills is a box. A figure grows to the labels around it (short lines within
    5), takes in the lines whose middle it holds, and is a background if more than four of them are prose. Figures that overlap are one.
    Shapes are taken from the top of the page, lines as they are numbered, so the order of rows changes nothing. shapes: book_id, page, box,
    kind (image or vector), rect (boolean), pixels; lines: role body. take_lines marks the lines."""
    text = lines.filter("role = 'body'").select("book_id", "page", "ord", *BOX, "n", "size", "mono", "text")
    where = pages.select("book_id", "page", "width", "height").join(body.select("book_id", "body_size"), "book_id")
    # a page is a row of arrays, not a group of its own: hundreds of pages come to Python at once
    key, seen, said = ["book_id", "page"], ["y0", "x0", "y1", "x1", "kind", "rect", "pixels"], ["ord", "y0", "x0", "y1", "x1", "n", "size", "mono", "text"]
    drawn = shapes.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*seen))).alias("s")).join(where, key)
    listed = text.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*said))).alias("t"))
    rows = drawn.join(listed, key, "left").select(*key, "width", "height", "body_size", *[F.col(f"s.{c}").alias(f"s_{c}") for c in seen], *[F.col(f"t.{c}").alias(f"t_{c}") for c in said])

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                some = {c: r[f"s_{c}"] for c in seen}
                near = {c: () if r[f"t_{c}"] is None else r[f"t_{c}"] for c in said}
                found = _page_regions(some, near, float(r["width"]), float(r["height"]), float(r["body_size"]))
                out += [(r["book_id"], r["page"], kind, n, *map(float, hull), photo, words) for n, (kind, hull, photo, words) in enumerate(found)]
            yield pd.DataFrame(out, columns=["book_id", "page", "kind", "region", *BOX, "photo", "text"])

    return rows.mapInPandas(run, REGION)


def take_lines(lines: DataFrame, regions: DataFrame, role: str) -> DataFrame:
    """Lines whose middle is in a region of their page take its role and number."""
    box = regions.select("book_id", "page", "region", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (mid_x >= F.col("_x0")) & (mid_x <= F.col("_x1")) & (mid_y >= F.col("_y0")) & (mid_y <= F.col("_y1")) & (F.col("role") == "body")
    hits = lines.join(box, ["book_id", "page"]).filter(inside).groupBy("book_id", "page", "ord").agg(F.min("region").alias("region"))
    out = lines.join(hits, ["book_id", "page", "ord"], "left")
    return out.withColumn("role", F.when(F.col("region").isNotNull(), role).otherwise(F.col("role")))


def attach_captions(regions: DataFrame, lines: DataFrame, body: DataFrame, above: float = 3.0, below: float = 3.5) -> DataFrame:
    """Caption of each region: the nearest line below (within 3.5 body sizes; 1.6 if it does not start like a caption, but is
    small or italic) or above (within 3)."""
    rows = regions.join(lines.filter("role = 'body'").select("book_id", "page", "ord", F.col("y0").alias("ly0"), F.col("y1").alias("ly1"), "text", "size", "italic", "n"), ["book_id", "page"]).join(body, "book_id")
    starts = F.col("text").rlike(CAPTION)
    soft = (F.col("size") < 0.95 * F.col("body_size")) | (F.col("italic") > 0.6 * F.col("n"))
    under, over = F.col("ly0") - F.col("y1"), F.col("y0") - F.col("ly1")
    gap = F.when((under >= -1) & (under <= F.when(starts, below).when(soft, 1.6).otherwise(-9.0) * F.col("body_size")), under).when((over >= -1) & (over <= above * F.col("body_size")) & starts, over + 1000)
    found = rows.withColumn("_gap", gap).filter("_gap is not null").groupBy("book_id", "page", "region").agg(F.min_by(F.struct("ord", "text"), F.struct("_gap", "ord")).alias("c"))
    return regions.join(found, ["book_id", "page", "region"], "left").select(*regions.columns, F.col("c.ord").alias("caption_ord"), F.col("c.text").alias("caption"))


def equation_regions(lines: DataFrame, columns: DataFrame, body: DataFrame) -> DataFrame:
    """Display equations: indented narrow lines of mathematics (45 percent of the characters, 22 if they are thirty or fewer), with no
    prose line on their row; those with gaps under 0.7 of the body size are one."""
    rows = lines.filter("role = 'body'").join(columns, ["book_id", "page"]).join(body, "book_id")
    mathy = (F.col("math") >= 0.45 * F.col("n")) | ((F.col("math") >= 0.22 * F.col("n")) & (F.col("n") <= 30) & (F.col("math") > 0))
    seeds = rows.filter(mathy & (F.col("x0") > F.col("left") + F.col("body_size")) & (F.col("x1") - F.col("x0") < 0.9 * (F.col("right") - F.col("left"))))
    prose = rows.filter(~mathy).select("book_id", "page", F.col("y0").alias("py0"), F.col("y1").alias("py1"))
    seeds = seeds.join(prose, (seeds.book_id == prose.book_id) & (seeds.page == prose.page) & (seeds.y0 < prose.py1 - 2) & (seeds.y1 > prose.py0 + 2), "left_anti")
    w = Window.partitionBy("book_id", "page").orderBy("y0", "ord")
    new = F.coalesce((F.col("y0") - F.lag("y1").over(w) >= 0.7 * F.col("body_size")).cast("int"), F.lit(1))
    rows = seeds.withColumn("_new", new).withColumn("region", (F.sum("_new").over(w) - 1).cast("int"))
    return rows.groupBy("book_id", "page", "region").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def table_regions(rows: DataFrame) -> DataFrame:
    """book_id, page, first, last (ord), text of tables: runs of three or more rows of three cells or more, where one other row may
    stand between. rows: book_id, page, ord, cells, text (cells joined by " | "), mathy."""
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    tabular = (F.col("cells") >= 3) & ~F.col("mathy")
    x = rows.withColumn("_t", tabular.cast("int")).withColumn("_bridge", (F.col("_t") == 0) & (F.coalesce(F.lag("_t").over(w), F.lit(0)) == 1) & (F.coalesce(F.lead("_t").over(w), F.lit(0)) == 1))
    x = x.withColumn("_in", (F.col("_t") == 1) | F.col("_bridge")).withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w)).filter("_in")
    out = x.groupBy("book_id", "page", "_run").agg(F.sum("_t").alias("_k"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return out.filter("_k >= 3").drop("_k", "_run")


def footnotes(lines: DataFrame, pages: DataFrame, body: DataFrame, rules: DataFrame, refs: DataFrame) -> DataFrame:
    """book_id, page, note, label, text of footnotes (note from 1 on each page; 0 and no label: carried over from the note before).

    A page's notes are the small lines (0.5 to 0.93 of the body size) under its short rule, if nothing but small lines stands under it;
    without a rule, those at its foot, down from 40 % of its height and not code, if they stand apart from the text above. A number or mark at
    a line's start labels a note (again only if it differs from the last). Under a rule, lines before the first label go on with a note of
    the page before; without one the first label must be cited on this page or one beside it. rules: book_id, page, box; refs: book_id, page,
    label (superscripts in the text)."""
    page = Window.partitionBy("book_id", "page")
    # books and pages are looked up without a sort of all lines
    rows = lines.filter("role = 'body' and n > 0").join(body.hint("shuffle_hash"), "book_id").join(pages.select("book_id", "page", "width", "height").hint("shuffle_hash"), ["book_id", "page"])
    rows = rows.withColumn("_small", (F.col("size") >= 0.5 * F.col("body_size")) & (F.col("size") <= 0.93 * F.col("body_size")))
    # other lines are in no note, so only their place is looked at
    rows = rows.withColumn("text", F.when(~F.col("_small"), F.lit(None)).otherwise(F.col("text")))
    ends = rows.groupBy("book_id", "page").agg(F.max(F.when(F.col("_small"), F.col("y0"))).alias("_low"), F.max(F.when(~F.col("_small"), F.col("y0"))).alias("_high"), F.first("width").alias("_w"), F.first("height").alias("_h"))
    short = (F.col("y1") - F.col("y0") < 1.6) & (F.col("x1") - F.col("x0") > 25) & (F.col("x1") - F.col("x0") < 0.6 * F.col("_w")) & (F.col("y0") > 0.35 * F.col("_h"))
    alone = (F.col("_low") >= F.col("y0") - 1) & (F.col("_high").isNull() | (F.col("_high") < F.col("y0") - 1))
    ruled = rules.select("book_id", "page", *BOX).join(ends, ["book_id", "page"]).filter(short & alone).groupBy("book_id", "page").agg(F.min("y0").alias("_rule"))
    down = page.orderBy(F.desc("y0"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    foot = F.col("_small") & (F.col("y0") > 0.4 * F.col("height")) & (F.col("mono") < 0.5 * F.col("n"))
    # a page without small lines has no notes
    of = ends.filter("_low is not null").select("book_id", "page").join(ruled, ["book_id", "page"], "left")
    rows = rows.join(of.hint("shuffle_hash"), ["book_id", "page"]).withColumn("_stop", F.max((~foot).cast("int")).over(down))
    rows = rows.withColumn("_run", F.when(F.col("_rule").isNotNull(), F.col("y0") >= F.col("_rule") - 1).otherwise(F.col("_stop") == 0))
    top = F.min(F.when(F.col("_run"), F.col("y0"))).over(page)
    rows = rows.withColumn("_top", top).withColumn("_above", F.max(F.when(~F.col("_run") & (F.col("y1") <= F.col("_top") + 1), F.struct("y0", "y1"))).over(page))
    near = F.col("_rule").isNull() & (F.col("_top") - F.col("_above.y1") < 0.3 * F.col("body_size"))
    rows = rows.filter(F.col("_run") & ~F.coalesce(near, F.lit(False)))
    mark = F.regexp_extract(F.trim("text"), r"^(\d{1,3}|[*†‡§¶‖]+)[\s.)]\s*\S", 1)
    up = page.orderBy("y0", "ord")
    rows = rows.withColumn("_mark", F.when((mark != "") & (F.col("x0") <= F.min("x0").over(page) + 2.5 * F.col("body_size")), mark)).withColumn("_at", F.row_number().over(up))
    known = F.last("_mark", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("_mark").isNotNull() & ~F.col("_mark").eqNullSafe(known)
    rows = rows.withColumn("_start", starts.cast("int")).withColumn("note", F.sum("_start").over(up).cast("int"))
    first = F.min(F.when(F.col("_mark").isNotNull(), F.struct("_at", "_mark"))).over(page)
    rows = rows.withColumn("_first", F.when(first["_at"] <= 2, first["_mark"]))
    cites = refs.select("book_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"), F.col("label").alias("_first")).distinct().withColumn("_cited", F.lit(True))
    rows = rows.join(cites, ["book_id", "page", "_first"], "left")
    good = F.when(F.col("_rule").isNotNull(), F.col("_mark").isNotNull() | (F.col("note") >= 0)).otherwise(F.col("_first").isNotNull() & F.coalesce("_cited", F.lit(False)))
    found = rows.filter(good).groupBy("book_id", "page", "note").agg(F.min_by("_mark", "_at").alias("label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ").alias("text"))
    found = found.withColumn("label", F.when(F.col("note") > 0, F.col("label")))
    # what is carried over needs a note on the page before
    has = found.filter("note > 0").select("book_id", (F.col("page") + 1).alias("page"), F.lit(True).alias("_before")).distinct()
    out = found.join(has, ["book_id", "page"], "left").join(ruled, ["book_id", "page"], "left")
    return out.filter((F.col("note") > 0) | (F.col("_rule").isNotNull() & F.col("_before"))).select("book_id", "page", "note", "label", "text")


def link_footnotes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each reference with its note's id: of the same page, else the next, else the page before. refs: ref_id, book_id, page, label."""
    near = notes.select("book_id", F.col("page").alias("_page"), "label", "note_id")
    rows = refs.join(near, ["book_id", "label"]).withColumn("_rank", F.when(F.col("_page") == F.col("page"), 0).when(F.col("_page") == F.col("page") + 1, 1).when(F.col("_page") == F.col("page") - 1, 2)).filter("_rank is not null")
    found = rows.groupBy("ref_id").agg(F.min_by("note_id", F.struct("_rank", "note_id")).alias("note_id"))
    return refs.join(found, "ref_id", "left")


def _counted(words: Column) -> Column:
    """Words, the second and further ones of a kind marked by their number: what two such lists share is what they share as multisets."""

    def numbered(s: Column) -> Column:
        def run(starts: Column) -> Column:
            nth = lambda i, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(starts, k + 1), F.size(s)) - i - 1), lambda j: F.when(j == 0, F.get(s, i)).otherwise(F.concat(F.get(s, i), F.lit(" "), j.cast("string"))))
            return F.flatten(F.transform(starts, nth))

        return bound(run_starts(s), run)

    def marked(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), w).otherwise(bound(F.sort_array(w), numbered))

    return bound(words, marked)


def match_outline(outline: DataFrame, lines: DataFrame, body: DataFrame, least: float = 0.72) -> DataFrame:
    """Entry, ord, score: the line (alone or with one or two after it) of the entry's page or the next whose words are most like the
    entry's title; 0.08 more if it is large or bold, 0.05 less on the next page; a line goes to its first entry. Entries of a book of three
    or more of which under three in ten match are left out. outline: book_id, entry, title, page."""
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    strong = (F.col("size") > 1.1 * F.col("body_size")) | (F.col("bold") > 0.6 * F.col("n"))
    rows = lines.filter("role = 'body'").join(body, "book_id").select("book_id", "page", "ord", strong.alias("strong"), F.col("text").alias("_1")).withColumns({"_2": F.lead("_1", 1).over(w), "_3": F.lead("_1", 2).over(w)})
    # words are found once a line, not once a pair; those of lines together are theirs one after the other
    rows = rows.withColumns({c: title_words(F.col(c)) for c in ("_1", "_2", "_3")})
    none = F.array().cast("array<string>")
    two = F.concat(F.coalesce("_1", none), F.coalesce("_2", none))
    spans = rows.select("book_id", "page", "ord", "strong", F.transform(F.array(F.col("_1"), two, F.concat(two, F.coalesce("_3", none))), lambda x: _counted(without_numbering(x))).alias("t"))
    want = outline.select("book_id", "entry", _counted(without_numbering(title_words(F.col("title")))).alias("_a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "page").withColumn("page", F.col("page") + F.col("d"))
    likeness = lambda x: F.when((F.size("_a") == 0) | (F.size(x) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect("_a", x)) / (F.size("_a") + F.size(x)))
    more = F.when(F.col("strong"), 0.08).otherwise(0.0)
    score = F.array_max(F.transform("t", lambda x: F.round(likeness(x) + more - 0.05 * F.col("d"), 6)))
    hits = want.join(spans, ["book_id", "page"]).select("book_id", "entry", "page", "ord", score.alias("score")).filter(F.col("score") >= least)
    best = hits.groupBy("book_id", "entry").agg(F.max_by(F.struct("page", "ord", "score"), F.struct("score", -F.col("page"), -F.col("ord"))).alias("x")).select("book_id", "entry", "x.*")
    once = best.withColumn("_r", F.row_number().over(Window.partitionBy("book_id", "page", "ord").orderBy("entry"))).filter("_r = 1").drop("_r")
    share = outline.groupBy("book_id").agg(F.count(F.lit(1)).alias("k")).join(once.groupBy("book_id").agg(F.count(F.lit(1)).alias("m")), "book_id").filter("k < 3 or m >= 0.3 * k")
    return once.join(share.select("book_id"), "book_id", "left_semi")


def styled_headings(lines: DataFrame, pages: DataFrame, body: DataFrame) -> DataFrame:
    """book_id, page, ord, level of lines in a heading style (size, font, bold; larger or bolder than the body, used on few lines that
    do not end like sentences); levels by size and weight, at most four, or by the depth of their numbering."""
    rows = lines.filter("role = 'body'").join(body, "book_id").withColumn("heavy", F.col("bold") > 0.6 * F.col("n")).withColumn("s", F.round(F.col("size") * 2) / 2)
    rows = rows.filter(((F.col("s") > 1.05 * F.col("body_size")) | (F.col("heavy") & (F.col("s") >= F.col("body_size")))) & (F.col("n") <= 120) & F.col("text").rlike(r"\p{L}{2}"))
    n_pages = pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"))
    ends = F.avg(F.col("text").rlike(TERMINAL).cast("double"))
    styles = rows.groupBy("book_id", "font", "s", "heavy").agg(F.count(F.lit(1)).alias("k"), ends.alias("ends")).join(n_pages, "book_id").filter("ends <= 0.5 and k <= 6 * pages")
    rank = F.dense_rank().over(Window.partitionBy("book_id").orderBy(F.desc("s"), F.desc("heavy")))
    levels = styles.withColumn("_level", F.least(F.lit(4), rank))
    depth = F.size(F.split(F.regexp_extract("text", r"^(\d+(?:\.\d+)+)\.?\s", 1), r"\."))
    found = rows.join(levels.select("book_id", "font", "s", "heavy", "_level"), ["book_id", "font", "s", "heavy"])
    return found.select("book_id", "page", "ord", F.when(F.col("text").rlike(r"^\d+(\.\d+)+\.?\s"), F.least(F.lit(4), depth)).otherwise(F.col("_level")).cast("int").alias("level"), "text")


def join_chapter_labels(headings: DataFrame) -> DataFrame:
    """A heading that is only "Chapter N" joins the one below it on its page. headings: book_id, page, ord, level, text."""
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    label = F.col("text").rlike(r"(?i)^(chapter|part|appendix|lecture|unit|lesson|module)\s+([\divxlc]+|[a-z])[.:]?$")
    rows = headings.withColumns({"_label": label, "_next": F.lead("text").over(w), "_was": F.lag(label).over(w)})
    out = rows.withColumn("text", F.when(F.col("_label") & F.col("_next").isNotNull(), F.concat("text", F.lit(" "), "_next")).otherwise(F.col("text")))
    return out.filter(~F.coalesce(F.col("_was"), F.lit(False)) | F.col("_label")).select(*headings.columns)


def code_blocks(lines: DataFrame) -> DataFrame:
    """book_id, page, first (ord), text of code: runs of lines of 85 percent fixed-width characters; spaces from the left edge, blank
    lines from gaps."""
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    rows = lines.withColumn("_code", (F.col("role") == "body") & (F.col("mono") >= 0.85 * F.col("n")) & (F.col("n") > 0))
    rows = rows.withColumn("_new", (F.col("_code") & ~F.coalesce(F.lag("_code").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w)).withColumn("_gap", F.col("y0") - F.lag("y1").over(w)).filter("_code")
    run = Window.partitionBy("book_id", "page", "_run")
    width = F.greatest(F.lit(0.1), (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length("text")))
    indent = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.round((F.col("x0") - F.min("x0").over(run)) / width)).cast("int"))
    blank = F.when((F.col("_gap") > 0.8 * F.col("size")) & (F.row_number().over(run.orderBy("ord")) > 1), "\n").otherwise("")
    rows = rows.withColumn("_text", F.concat(blank, indent, "text"))
    return rows.groupBy("book_id", "page", "_run").agg(F.min("ord").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_text"))), lambda x: x["_text"]), "\n").alias("text")).drop("_run")


def dehyphenate(lines: DataFrame) -> DataFrame:
    """Joiner of each line to the next of its page: "" for a word broken by a hyphen (which goes), "-" where the book has the word with
    its hyphen and not without, else a space."""
    words = lines.select("book_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0))).alias("w")).distinct()
    w = Window.partitionBy("book_id", "page").orderBy("ord")
    rows = lines.select("book_id", "page", "ord", "text", F.lead("text").over(w).alias("_next"))
    left, right = F.regexp_extract("text", r"(\p{L}+)-$", 1), F.regexp_extract("_next", r"^(\p{Ll}+)", 1)
    rows = rows.withColumns({"_l": F.lower(left), "_r": F.lower(F.coalesce(right, F.lit("")))}).withColumn("_broken", (F.col("_l") != "") & (F.col("_r") != ""))
    rows = rows.withColumns({"_with": F.concat_ws("-", "_l", "_r"), "_without": F.concat("_l", "_r")})
    a, b = (words.select("book_id", F.col("w").alias(c), F.lit(True).alias(f"{c}_in")) for c in ("_with", "_without"))
    found = rows.join(a, ["book_id", "_with"], "left").join(b, ["book_id", "_without"], "left")
    keep = F.coalesce("_with_in", F.lit(False)) & ~F.coalesce("_without_in", F.lit(False))
    return found.select("book_id", "page", "ord", F.when(~F.col("_broken"), " ").when(keep, "-").otherwise("").alias("joiner"))


CLOSES, FLOATS, APART = ("heading", "code", "equation"), ("figure", "table", "caption"), ("head", "page_number", "footnote")


def assemble_paragraphs(lines: DataFrame) -> DataFrame:
    """book_id, para, page, first_ord, last_ord, kind, text: paragraphs and list items of a book. lines: with joiner (L19), boxed (L8; 0
    if not in a box).

    A line starts a new one at a list mark, after a heading, code or an equation, and where the size (by over 12 %) or the box changes. Next to
    the line before, in its block, it does so at a wide gap, or indented after a short line or an ended sentence (in a list item at a gap
    only). Elsewhere it goes on only if the sentence is not over: on another page or column, or after a figure, if it resumes in lower case or
    the last line broke off in mid-clause; on the same page if it resumes in lower case close by. That the open block is a list item is the one
    bit of state; a line ends it where it starts anew, so runs between list marks tell it."""
    book = Window.partitionBy("book_id").orderBy("page", "ord")
    bounds = lines.groupBy("book_id", "page", "block").agg(F.min("x0").alias("_left"), F.max("x1").alias("_right"))
    so_far = lambda roles: F.sum(F.col("role").isin(*roles).cast("int")).over(book)
    rows = lines.filter(~F.col("role").isin(*APART)).withColumns({"_closed": so_far(CLOSES), "_floated": so_far(FLOATS)}).filter("role = 'body'").join(bounds, ["book_id", "page", "block"])
    t = F.trim("text")
    rows = rows.withColumns({"_t": t, "_list": t.rlike(f"{BULLET}|{ENUMERATOR}")})
    was = F.lag(F.struct("_t", "size", "boxed", "page", "block", "x0", "y0", "x1", "y1", "_right", "_closed", "_floated")).over(book)
    rows = rows.withColumn("_p", was)
    p = {c: F.col(f"_p.{c}") for c in ("_t", "size", "boxed", "page", "block", "x0", "y0", "x1", "y1", "_right", "_closed", "_floated")}
    size = F.col("size")
    breaks = (F.abs(size - p["size"]) > 0.12 * F.greatest(size, p["size"])) | (F.col("boxed") != p["boxed"])
    floated, same_page = F.col("_floated") != p["_floated"], F.col("page") == p["page"]
    next_to = ~floated & same_page & (F.col("block") == p["block"])
    ended = p["_t"].rlike(TERMINAL)
    indented = (F.col("x0") > F.col("_left") + 0.8 * size) & (F.col("x0") - p["x0"] > 0.8 * size)
    gap = F.col("y0") - p["y1"] > 0.9 * size
    beside = gap | (indented & ((p["x1"] < p["_right"] - 1.5 * size) | ended))
    lower = F.col("_t").rlike(r"^[\p{Ll},;:)\]]")
    soft = p["_t"].rlike(r"[,;—–-]$") | p["_t"].rlike(r"[\p{L}\p{N}]$")
    jumped = (F.col("y0") < p["y0"] - 2 * size) & (F.col("x0") > p["x0"] + 40)
    apart = F.when(ended, True).when(~same_page | floated | jumped, ~(lower | soft)).otherwise(~(lower & (F.abs(F.col("y0") - p["y1"]) < 2 * size)))
    rows = rows.withColumns(
        {
            "_bound": F.col("_p").isNull() | F.col("_list") | (F.col("_closed") != p["_closed"]),
            "_new": F.when(breaks, True).when(next_to, beside).otherwise(apart),
            "_new_item": F.when(breaks, True).when(next_to, gap).otherwise(apart),
        }
    ).withColumn("_run", F.sum(F.col("_bound").cast("int")).over(book))
    run = Window.partitionBy("book_id", "_run").orderBy("page", "ord")
    item = F.first("_list").over(run.rowsBetween(Window.unboundedPreceding, 0))
    left = F.coalesce(F.max(F.col("_new_item") & ~F.col("_bound")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_start", F.col("_bound") | F.when(item & ~left, F.col("_new_item")).otherwise(F.col("_new")))
    rows = rows.withColumn("para", (F.sum(F.col("_start").cast("int")).over(book) - 1).cast("int")).withColumn("_more", F.coalesce(~F.lead("_start").over(book), F.lit(False)))
    joiner = F.coalesce("joiner", F.lit(" "))
    piece = F.when(~F.col("_more"), F.col("text")).when(joiner == " ", F.concat("text", F.lit(" "))).when(joiner == "", F.regexp_replace("text", "-$", "")).otherwise(F.col("text"))
    found = rows.withColumn("_piece", piece).groupBy("book_id", "para").agg(
        F.min(F.struct("page", "ord", "_list")).alias("_a"), F.max(F.struct("page", "ord")).alias("_z"), F.sort_array(F.collect_list(F.struct("page", "ord", "_piece"))).alias("_x")
    )
    kind = F.when(F.col("_a._list"), "list").otherwise("paragraph")
    return found.select("book_id", "para", "_a.page", F.col("_a.ord").alias("first_ord"), F.col("_z.ord").alias("last_ord"), kind.alias("kind"), F.array_join(F.transform("_x", lambda x: x["_piece"]), "").alias("text"))


def list_items(lines: DataFrame, columns: DataFrame, body: DataFrame) -> DataFrame:
    """Label, level (0 to 2) and the rest of the text of lines that start with a bullet or an enumerator."""
    rows = lines.join(columns, ["book_id", "page"]).join(body, "book_id")
    bullet, number = F.regexp_extract("text", BULLET, 1), F.regexp_extract("text", ENUMERATOR, 1)
    label = F.when(bullet != "", bullet).otherwise(number)
    level = F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.col("x0") - F.col("left")) / (2.2 * F.col("body_size")) + 0.5))).cast("int")
    return rows.withColumn("label", label).filter("label <> ''").select("book_id", "page", "ord", "label", level.alias("level"), F.regexp_replace(F.regexp_replace("text", BULLET, ""), ENUMERATOR, "").alias("text"))


def block_marks(spans: DataFrame) -> DataFrame:
    """block_id, marks (s, e, f): runs of one style as ranges of the block's text, without the style of the whole block, equal
    neighbours as one. spans: block_id, i, text, flags, body_flags."""
    w = Window.partitionBy("block_id").orderBy("i")
    rows = spans.withColumn("f", F.col("flags").bitwiseAND(F.bitwise_not(F.col("body_flags")))).withColumn("s", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("e", F.col("s") + F.length("text")).withColumn("_new", F.coalesce((F.lag("f").over(w) != F.col("f")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy("block_id", "_run", "f").agg(F.min("s").alias("s"), F.max("e").alias("e")).filter("f <> 0")
    return runs.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "f"))).alias("marks"))


def heading_blocks(headings: DataFrame) -> DataFrame:
    """Label, text and section title ("Chapter 3 · Title") of headings."""
    label = F.regexp_replace(F.regexp_extract("text", HEADING_LABEL, 1), r"[.:]$", "")
    rest = F.regexp_extract("text", HEADING_LABEL, 2)
    has = label != ""
    return headings.withColumns({"label": F.when(has, label), "title": F.when(has, F.concat(label, F.lit(" · "), rest)).otherwise(F.col("text")), "text": F.when(has, rest).otherwise(F.col("text"))})


def reading_order(lines: DataFrame, regions: DataFrame, notes: DataFrame) -> DataFrame:
    """book_id, page, place, kind, text: lines and regions from top to bottom, then the page's footnotes."""
    items = lines.filter("role = 'body'").select("book_id", "page", F.lit(0).alias("late"), "y0", "x0", F.lit("line").alias("kind"), "text")
    items = items.union(regions.select("book_id", "page", F.lit(0), "y0", "x0", F.lit("region"), F.lit(None).cast("string")))
    items = items.union(notes.select("book_id", "page", F.lit(1), F.lit(0.0), F.lit(0.0), F.lit("footnote"), "text"))
    return items.select("book_id", "page", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("late", "y0", "x0", "kind", "text")).alias("place"), "kind", "text")


def guess_title(lines: DataFrame, body: DataFrame) -> DataFrame:
    """book_id, title: the largest text of 1.4 body sizes or more on the first four pages, all its lines on its page."""
    rows = lines.join(body, "book_id").filter((F.col("page") < 4) & (F.col("size") >= 1.4 * F.col("body_size")))
    top = rows.groupBy("book_id").agg(F.max(F.struct("size", -F.col("page"))).alias("x")).select("book_id", F.col("x.size").alias("size"), (-F.col("x.col2")).alias("page"))
    return rows.join(top, ["book_id", "size", "page"]).groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("title"))


def ink_boxes(marks: DataFrame) -> DataFrame:
    """The box around a page's ink without furniture. marks: book_id, page, x0, y0, x1, y1, role."""
    kept = marks.filter(~F.col("role").isin("head", "page_number"))
    return kept.groupBy("book_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def book_trim(boxes: DataFrame, pages: DataFrame, pad: float = 14.0, samples: int = 48) -> DataFrame:
    """The part of a book's pages with print, for even and odd pages: sixth and ninety-fourth percentiles of the ink boxes and pad
    around them. Of the middle 84 % of a book's pages up to `samples`, evenly spread, are looked at, and of those the ones with over 15
    percent of ink; a side of under three takes the other's; a book without either has no rows. pages: book_id, page (from 0), width, height."""
    count = pages.groupBy("book_id").agg((F.max("page") + 1).alias("count")).select("book_id", F.floor(F.col("count") * 0.08).alias("from"), F.ceil(F.col("count") * 0.92).alias("to"))
    n = F.least(F.lit(samples), F.col("to") - F.col("from"))
    seen = count.filter("to > from").select("book_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("from") + F.floor((F.col("to") - F.col("from")) * i / n))).alias("page"))
    looked = pages.join(seen.distinct(), ["book_id", "page"])
    size = looked.groupBy("book_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    rows = boxes.join(looked, ["book_id", "page"]).filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0.15 * F.col("width") * F.col("height"))
    sides = rows.groupBy("book_id", (F.col("page") % 2).alias("own")).agg(
        F.count(F.lit(1)).alias("k"), _lower_percentile(F.col("x0"), 0.06).alias("a"), _lower_percentile(F.col("y0"), 0.06).alias("b"), _lower_percentile(F.col("x1"), 0.94).alias("c"), _lower_percentile(F.col("y1"), 0.94).alias("d"),
    ).filter("k >= 3")
    both = sides.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_own", F.col("own") == F.col("side"))
    out = both.groupBy("book_id", F.col("side").cast("int").alias("side")).agg(F.max_by(F.struct("a", "b", "c", "d"), "_own").alias("x")).join(size, "book_id")
    zero = F.lit(0.0)
    return out.select("book_id", "side", F.greatest(zero, F.col("x.a") - pad).alias("x0"), F.greatest(zero, F.col("x.b") - pad).alias("y0"), F.least("w", F.col("x.c") + pad).alias("x1"), F.least("h", F.col("x.d") + pad).alias("y1"))


def clean_outline(outline: DataFrame) -> DataFrame:
    """Entries with a page, white space in titles as single spaces."""
    return outline.filter("page is not null").withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
