"""Text expressions. Every function takes and returns columns; nothing runs in Python."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def _decomposed(form: str) -> tuple[str, str, str, str]:
    """What a Unicode normal form does to single code points: those that become one other (as two strings for translate), and those that
    become several or none (a guard pattern, and pairs for str_to_map). NFKD here goes without the combining marks U+0300 to U+036F.
    Hangul syllables, which only fall into their letters, stay."""
    one, other, many = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp < 0xD7B0 or 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        d = unicodedata.normalize(form, c)
        if form == "NFKD":
            d = "".join(x for x in d if not 0x300 <= ord(x) < 0x370)
        if d == c:
            continue
        if len(d) == 1:
            one.append(c)
            other.append(d)
        elif d:
            many[c] = d
    guard, last = [], -2
    for cp in map(ord, many):
        if cp == last + 1:
            guard[-1][1] = cp
        else:
            guard.append([cp, cp])
        last = cp
    pattern = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in guard) + "]"
    if not any(cp < 0x80 or 0xC0 <= cp <= 0xFF for cp in map(ord, many)):
        pattern = r"(?![\x00-\x7f\xc0-\xff])" + pattern  # most characters are passed over without a look at some hundred ranges
    return "".join(one), "".join(other), pattern, "\x01".join(f"{c}\x02{d}" for c, d in many.items())


MARKS = "".join(map(chr, range(0x300, 0x370)))

# Words that label a passage, words that carry no meaning alone, and patterns, as the semantics define them.
LABELS = (
    "note notes example examples exercise exercises proof theorem lemma corollary definition definitions remark remarks solution solutions "
    "answer answers hint hints warning important summary introduction chapter section figure fig table step case problem problems question "
    "questions key tip tips caution observe notice glossary debugging overview conclusion conclusions review practice part appendix "
    "algorithm proposition claim conjecture axiom property properties fact facts exploration activity objective objectives goal goals "
    "background motivation preview recap checkpoint aside sidebar historical history reference references bibliography index contents"
).split()
STOP = (
    "a an the of and or not no nor but if then else to in on at by for with from as is are was were be been being this that these those "
    "it its we you they he she i me my our your their all any each every some only must never always very also just so such than too can "
    "will would should could may might do does did done have has had one two three first second new old same other more most less least "
    "here there now how why what when where which who whom whose yes thus hence therefore however recall consider suppose let note see "
    "following above below using use given"
).split()
DEFINES = (
    r"(?i)\b(is|are|was|were) (called|termed|known as|said to be|referred to as|defined (as|to be|by))\b|\bwe (call|say|define|refer to|denote|write)\b"
    r"|\b(is|are) defined\b|\bmeans?\b|\bdenotes?\b|\brefers? to\b|\bcalled\b|\bknown as\b|\bstands? for\b"
)
GENERIC_HEADINGS = (
    r"(?i)^(exercises?|problems?|introduction|summary|glossary|debugging|historical remarks|review|overview|examples?|notes?|references|conclusions?"
    r"|further reading|solutions?|answers?|preview|key terms|step \d+|step k\b|case \d+|what'?s next|chapter review|self[- ]check|practice|projects?|appendix)"
)
SECTION_KINDS = [
    ("contents", r"^(contents|table of contents|brief contents|detailed contents|contents in brief)$"),
    ("index", r"^(index|subject index|author index|name index|general index|symbol index|index of symbols|notation index)$"),
    ("bibliography", r"^(bibliography|references|works cited|further reading|selected references)$"),
    ("front", r"^(preface|foreword|acknowledg|dedication|about the author|about this book|copyright|title page|cover|half title|colophon|list of (figures|tables)|epigraph)"),
    ("exercises", r"^(exercises?|problems?|review questions|practice problems|homework)\b"),
]
NUMBERING = r"^(\d+[a-z]?|m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})|chapter|part|appendix|section|lecture|unit|lesson)$"
TERM_EDGES = "^[\\s\"“‘'(\\[.,;:!?—–-]+|[\\s\"”’'):;,.\\]!?—–-]+$"
GLYPHS = {0xE039: "ft", 0xE03A: "ck", 0xE03B: "ch", 0xE03C: "tt", 0xE048: "Qu", 0xE049: "Th", 0xE050: "&", 0xE06D: "-", 0xE0E0: "f"}
# End of fixed values.


def bound(value: Column, body) -> Column:
    """body(value) with value computed once a row; inside lambdas an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Beyond these, texts are mapped by the whole table, which costs more for every row.
_NEAR = "\x00-\u024f\u2000-\u206f"


def _is_near(c: str) -> bool:
    return c < "\u0250" or "\u2000" <= c <= "\u206f"


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _mapped(text: Column, one: str, other: str) -> Column:
    """text with each of one as its other (none: without it), by as small a table as will do. ASCII stays as it is."""
    other = other + "\0" * (len(one) - len(other))
    near = [(a, b) for a, b in zip(one, other, strict=True) if _is_near(a)]
    gone = lambda pairs: sorted(pairs, key=lambda x: x[1] == "\0")
    small, whole = (["".join(x).replace("\0", "") for x in zip(*gone(pairs), strict=True)] for pairs in (near, list(zip(one, other, strict=True))))
    return F.when(_is_ascii(text), text).when(~text.rlike(f"[^{_NEAR}]"), F.translate(text, *small)).otherwise(F.translate(text, *whole))


def run_starts(x: Column, own=lambda y: y) -> Column:
    """Where runs of equal elements (by own) begin in a sorted array that is not empty, from 0."""
    return F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (own(F.get(x, i)) != own(F.get(x, F.greatest(i, F.lit(1)) - 1))))


def normalized(text: Column, form: str, without: str = "") -> Column:
    """text in a Unicode compatibility form (NFKC or NFKD), code point by code point, and without some. Most are mapped one to one; texts
    that hold one that becomes several (ligatures, fractions) are taken apart."""
    one, other, guard, many = _decomposed(form)
    table = F.str_to_map(F.lit(many), F.lit("\x01"), F.lit("\x02"))

    def letters(t: Column) -> Column:
        apart = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return bound(F.when(t.rlike(guard), apart).otherwise(t), lambda x: _mapped(x, one + without, other))

    return bound(text, lambda t: F.when(_is_ascii(t), t).otherwise(letters(t)))


def strip_accents(text: Column) -> Column:
    """Compatibility letters as plain ones (ligatures, full width, superscripts), without combining marks."""
    return normalized(text, "NFKD", MARKS)


def letters_and_digits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def singular(word: Column) -> Column:
    """The singular of an English word, by its ending."""
    ends = lambda *endings: reduce(or_, [word.endswith(e) for e in endings])
    but = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when((F.length(word) <= 3) | ends("ss", "us", "is", "os", "as", "ics"), word)
        .when(ends("ies"), F.concat(but(3), F.lit("y")))
        .when(ends("shes", "ches", "xes", "zes"), but(2))
        .when(ends("s"), but(1))
        .otherwise(word)
    )


def places_of(text: Column, words: Column) -> Column:
    """Where words stand in text (places from 1), overlapping ones too. Each step looks on from the place before, so the cost is the
    text's length for each occurrence."""

    def find(x: Column) -> Column:
        overlaps = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x["w"]) - 1)), lambda k: (F.length(x["w"]) > k) & x["w"].startswith(F.substring(x["w"], k + 1, F.length(x["w"]))))
        apart = ((F.length(x["t"]) - F.length(F.replace(x["t"], x["w"], F.lit("")))) / F.length(x["w"])).cast("int")
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(overlaps, F.length(x["t"])).otherwise(apart)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, _: Column) -> Column:
            then = F.when(acc["at"] < 0, F.lit(0)).otherwise(F.call_function("locate", x["w"], x["t"], acc["at"] + 1))
            return bound(then, lambda at: F.when(at > 0, F.struct(at.alias("at"), F.array_append(acc["all"], at).alias("all"))).otherwise(F.struct(F.lit(-1).alias("at"), acc["all"].alias("all"))))

        return F.aggregate(rounds, start, step, lambda acc: acc["all"])

    return bound(F.struct(text.alias("t"), words.alias("w")), find)


def tokens(text: Column) -> Column:
    """Words without accents and case."""
    return letters_and_digits(F.lower(strip_accents(text)))


TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*"


def tokens_in_place(text: Column) -> Column:
    """The tokens of a text as written, and what stands around them: own (n tokens), folded (those without accents and case), between
    (n + 1 pieces: before the first, between neighbours, after the last). Put together in turn they are the text."""
    own = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.struct(own.alias("own"), F.transform(own, lambda t: F.lower(strip_accents(t))).alias("folded"), F.split(text, TOKEN).alias("between"))


def apart_places(text: Column, words: Column) -> Column:
    """Where words stand in text, left to right, not overlapping (places from 0), in one pass over the text. words hold no `\\E`."""

    def sums(x: Column) -> Column:
        sizes = F.transform(F.slice(x["parts"], 1, F.size(x["parts"]) - 1), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, n: F.struct((acc["at"] + n + x["n"]).alias("at"), F.array_append(acc["all"], acc["at"] + n).alias("all"))
        return F.aggregate(sizes, start, step, lambda acc: acc["all"])

    return bound(F.struct(F.split(text, F.concat(F.lit("\\Q"), words, F.lit("\\E"))).alias("parts"), F.length(words).alias("n")), sums)


def term_words(text: Column) -> Column:
    """The words that identify a term: no accents, case, possessive or plural."""
    own = lambda t: F.when(t.rlike("['’]s"), F.regexp_replace(t, r"['’]s\b", "")).otherwise(t)
    plain = lambda t: F.when(t.contains("s"), _singulars(t)).otherwise(t)
    return letters_and_digits(bound(bound(F.lower(strip_accents(text)), own), plain))


def _singulars(text: Column) -> Column:
    """singular for all words of a text at once: two passes over the text cost less than a look at each word."""
    end = r"(?![\p{L}\p{N}])"
    y = F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}])ies{end}", "y")
    return F.regexp_replace(y, rf"(?<=[sc]h|[\p{{L}}\p{{N}}][xz])es{end}|(?<=[\p{{L}}\p{{N}}]{{3}})(?<![suioa]|ic)s{end}", "")


def term_key(text: Column) -> Column:
    """The identity of a concept across books."""
    return F.array_join(term_words(text), " ")


_HOLD, _CUT = "\x02", "\x01"


def sentences(text: Column) -> Column:
    """The sentences of a text; joined they are the text. Common abbreviations and initials do not end one."""
    held = F.regexp_replace(text, r"\b(e\.g|i\.e|etc|vs|cf|Fig|Eq|resp|al|[A-Z])\. ", f"$1{_HOLD} ")
    cut = F.regexp_replace(held, r"([.!?][\"”’)\]]*\s+)([\"“(]?[A-Z0-9])", f"$1{_CUT}$2")
    return F.split(F.translate(cut, _HOLD, "."), _CUT)


def sentence_at(text: Column, start: Column, end: Column) -> Column:
    """T4: the sentence or sentences around [start, end) (0-based code points), trimmed."""
    parts = F.transform(sentences(text), lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))

    def step(acc: Column, part: Column) -> Column:
        inside = (acc["at"] + part["n"] > start) & (acc["at"] < F.greatest(end, start + 1))
        return F.struct((acc["at"] + part["n"]).alias("at"), F.when(inside, F.concat(acc["s"], part["s"])).otherwise(acc["s"]).alias("s"))

    return F.trim(F.aggregate(parts, zero, step, lambda acc: acc["s"]))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def clean_term(raw: Column) -> Column:
    """T5: a marked run as a term's name, or null if it is not one. Its words are looked at only where the run itself will do."""

    def named(t: Column, words: Column) -> Column:
        first, last = F.get(words, F.lit(0)), F.get(words, F.size(words) - 1)
        good = (F.size(words) > 0) & ~first.isin(LABELS) & ~first.isin(STOP) & ~last.isin(STOP) & (F.size(F.filter(words, lambda w: w.isin(STOP))) <= 1)
        return F.when(good, t)

    def run(t: Column) -> Column:
        good = F.length(t).between(2, 60) & (F.length(t) - F.length(F.translate(t, " ", "")) < 5) & t.rlike(r"\p{L}{2}") & ~t.rlike(r"^\d|[=<>{}\[\]|\\]")
        return F.when(good, bound(term_words(t), lambda words: named(t, words)))

    return bound(F.trim(F.regexp_replace(F.regexp_replace(raw, TERM_EDGES, ""), r"\s+", " ")), run)


def is_defining(text: Column) -> Column:
    """The text says what something is."""
    return text.rlike(DEFINES)


def is_generic_heading(text: Column) -> Column:
    """A heading that every book has."""
    return text.rlike(GENERIC_HEADINGS)


def section_kind(title: Column) -> Column:
    """What a section of this title holds."""
    t = F.trim(F.regexp_replace(F.lower(title), r"^[\d.\s]+", ""))
    kind = F.lit("body")
    for name, pattern in reversed(SECTION_KINDS):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    return kind


def title_words(title: Column) -> Column:
    """The words of a title, with its numbering."""
    return tokens(F.translate(title, "^_{}$\\", ""))


def without_numbering(words: Column) -> Column:
    """Words without up to three of numbering in front."""

    def rest(words: Column) -> Column:
        number = lambda k: F.coalesce(F.get(words, F.lit(k)).rlike(NUMBERING), F.lit(False))
        skip = F.when(~number(0), 0).when(~number(1), 1).when(~number(2), 2).otherwise(3)
        return F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0)))

    return bound(words, rest)


def title_tokens(title: Column) -> Column:
    """The words of a title without up to three words of numbering in front."""
    return without_numbering(title_words(title))


def dice(a: Column, b: Column) -> Column:
    """Multiset overlap of two word lists, 2 * common / (all of both); 0 if either is empty."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))

    def score(x: Column) -> Column:
        common = F.aggregate(F.array_distinct(x["a"]), F.lit(0), lambda n, w: n + F.least(times(x["a"], w), times(x["b"], w)))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(x["a"]) + F.size(x["b"])))

    return bound(F.struct(a.alias("a"), b.alias("b")), score)


def norm_key(text: Column) -> Column:
    """What running heads have in common: digits as #, single spaces, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Lines as prose: words broken by a hyphen at a line's end rejoined, line breaks as spaces."""
    joined = F.regexp_replace(text, r"(\p{L})[-‐]\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"\n", " "), r"[ \t]+", " "))


def _fold(text: Column, plain, taken_apart) -> Column:
    """plain(text with one letter a code point, and blanks for what goes), or, for texts that hold code points that become several letters or
    take their small letter from those beside them, taken_apart(per code point what it becomes)."""
    one, other, guard, many = _decomposed("NFKC")
    blank = "\t\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    mapped = [(a, b) for a, b in zip(one, other, strict=True) if a not in blank]
    one, other = "".join(a for a, _ in mapped) + blank, "".join(b for _, b in mapped) + " " * len(blank)
    table = F.str_to_map(F.lit(many), F.lit("\x01"), F.lit("\x02"))

    def letters(t: Column, odd: Column) -> Column:
        several = lambda c: F.when(c.rlike(guard), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)
        letter = lambda c: F.when(c.isin(" ", "\n"), F.lit("")).otherwise(F.lower(c))
        return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.when(odd, letter(several(c))).otherwise(letter(c)))

    def known(x: Column) -> Column:
        hard = x["odd"] | x["t"].rlike("[İΣ]")
        return F.when(~hard, plain(x["t"])).otherwise(bound(letters(x["t"], x["odd"]), taken_apart))

    def ends(t: Column) -> Column:
        return F.when(t.contains("\n"), F.regexp_replace(t, "[-‐\xad]\n", " \n")).otherwise(t)

    def fold(t: Column) -> Column:
        as_blanks = F.when(_is_ascii(t), F.translate(t, "\t\x0b\x0c\r", "    ")).otherwise(_mapped(t, one, other))
        return bound(F.struct(bound(as_blanks, ends).alias("t"), (~_is_ascii(t) & t.rlike(guard)).alias("odd")), known)

    return bound(text, fold)


def folded_text(text: Column) -> Column:
    """T12 without places: no white space, no hyphens at line ends, compatibility letters plain (NFKC), lower case."""
    return _fold(text, lambda t: F.lower(F.translate(t, " \n", "")), lambda x: F.array_join(x, ""))


def folded_places(text: Column) -> Column:
    """T12's map: the place (0-based code point) of each folded character."""

    def plain(t: Column) -> Column:
        return F.array_remove(F.transform(F.split(t, ""), lambda c, i: F.when(c.isin(" ", "\n", ""), F.lit(-1)).otherwise(i)), -1)

    def taken_apart(x: Column) -> Column:
        return F.flatten(F.transform(x, lambda c, i: F.array_repeat(i, F.length(c))))

    return _fold(text, plain, taken_apart)


def fold_text(text: Column) -> Column:
    """The text for locating phrases: no white space, no hyphens at line ends, compatibility letters plain (NFKC), lower case; map[k]
    is the place (0-based code point) of folded character k."""
    return bound(text, lambda t: F.struct(folded_text(t).alias("folded"), folded_places(t).alias("map")))


def squash(text: Column) -> Column:
    """For equality of cards and quotes: single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cloze_from_quote(paragraph: Column, quote: Column) -> Column:
    """A draft card from a quote: a cloze of its sentence, or a basic card if it is long or not in the paragraph."""
    at = F.instr(paragraph, quote)
    before, after = F.substring(paragraph, F.lit(1), at - 1), F.substring(paragraph, at + F.length(quote), F.length(paragraph))
    start = F.regexp_replace(before, r"(?s)^.*[.?!] ", "")
    end = F.when(after.rlike(r"[.?!] "), F.regexp_extract(after, r"(?s)^(.*?[.?!]) ", 1)).otherwise(after)
    cloze = F.trim(F.concat(start, F.lit("{{c1::"), quote, F.lit("}}"), end))
    good = (F.length(quote) < 160) & (at > 0)
    return F.struct(
        F.when(good, "cloze").otherwise("basic").alias("kind"), F.when(good, cloze).otherwise("").alias("front"), F.when(good, "").otherwise(quote).alias("back")
    )


def _math_letters() -> tuple[str, str]:
    """Styled math letters that mean the same as plain ones, and those. Script, fraktur and double-struck styles mean something else."""
    own, plain = ["ℎ"], ["h"]
    for cp in range(0x1D400, 0x1D800):
        same = unicodedata.normalize("NFKC", chr(cp))
        styled = unicodedata.name(chr(cp), "")
        if same != chr(cp) and len(same) == 1 and not any(s in styled for s in ("SCRIPT", "FRAKTUR", "DOUBLE-STRUCK")):
            own.append(chr(cp))
            plain.append(same)
    return "".join(own), "".join(plain)


MATH, MATH_PLAIN = _math_letters()


def clean_glyphs(text: Column, font: Column | None = None) -> Column:
    """Text without typesetting artefacts: styled math letters, hard spaces, soft hyphens, private glyphs of one font family."""
    out = F.translate(F.translate(text, MATH, MATH_PLAIN), " ­", " ")
    if font is None:
        return F.regexp_replace(out, "[-]", "")
    named = out
    for cp, letters in GLYPHS.items():
        named = F.replace(named, F.lit(chr(cp)), F.lit(letters))
    capitals, digits = "".join(chr(0xE051 + k) for k in range(26)), "".join(chr(0xE118 + k) for k in range(10))
    named = F.translate(named, capitals + digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return F.regexp_replace(F.when(font.rlike("(?i)libertine|biolinum|libertinus"), named).otherwise(out), "[-]", "")


def search_terms(query: Column, n: int = 8) -> Column:
    """The first n words of a query, compatibility letters plain (NFKC)."""
    return F.slice(letters_and_digits(normalized(query, "NFKC")), 1, n)


def parse_reply(reply: Column, schema: str | T.StructType) -> Column:
    """The JSON object in a model's reply: fenced, or from the first { to the last }. Null if there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)
