"""The native tokeniser equals the scalar scanner; places and snippets; proximity equals a brute-force window."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions.scanner import hits, positional_tokens, scan
from loam.operators import proximity
from loam.operators.snippets import in_order, snippet, tightest
from loam.plans.expand import Plan
from loam.registry import ENTITIES, HEBREW

BITS = ["a", "Bc", "the", " ", "<b>", "</b>", "<", ">", "&amp;", "&nbsp;", "&#160;", "&", ";", '"', "א", "שלום", "ָ", "־", "׀", "׳", "́", "é", "5", "\n", "😀", "{א}"]


@pytest.mark.parametrize(("html", "terms"), ENTITIES + HEBREW)
def test_cases(html, terms):
    assert " ".join(t.term for t in scan(html)) == terms


def test_native_equals_scanner(spark):
    random.seed(3)
    texts = ["".join(random.choices(BITS, k=random.randint(0, 25))) for _ in range(3000)] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", "t", tx.tokens(F.col("t")).alias("x")).collect():
        assert list(r.x) == [t.term for t in scan(r.t)], repr(r.t)


@pytest.mark.parametrize("n", [10, 1_000, 1_000_000])
@pytest.mark.parametrize("one", ["a", "ָ", '"', "&amp;", "&", "<b>", "אa", 'a"', "aָ", "a&lt;", " "])
def test_words_and_runs_of_any_length(spark, one, n):
    text = f"ab{one * n}cd ef"
    got = spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t")).alias("x")).first().x
    assert got == [t.term for t in scan(text)]


def test_plain_texts(spark):
    random.seed(6)
    texts = ["".join(random.choices(["a", "B", "the", " ", ",", ".", "א", "é", "5", "\n", "x" * 15, "😀"], k=random.randint(0, 40))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", tx.tokens(F.col("t")).alias("x"), F.expr(tx.tokens_sql("t")).alias("y")).collect():
        slow = scan(r.t + "<b>")
        assert list(r.x) == list(r.y) == [t.term for t in scan(r.t)] == [t.term for t in slow]
        assert scan(r.t) == slow
        slots = {"the": 0, "b": 1, "thea": 1}
        assert hits(r.t, slots) == hits(r.t + "<b>", slots) == [(i, slots[t.term], t.start, t.end) for i, t in enumerate(slow) if t.term in slots]


@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
def test_places(text):
    last = 0
    for t in scan(text):
        assert last <= t.start < t.end <= len(text)
        assert tx.SHORTEST <= len(t.term) <= tx.LONGEST
        last = t.end


def test_positional_tokens(spark):
    rows = spark.createDataFrame([(1, "Ab <b>cd</b>"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in positional_tokens(rows).orderBy("pos").collect()]
    assert got == [(1, 0, "ab", 0, 2, 0), (1, 1, "cd", 6, 8, 3)]


def test_other_columns(spark):
    one = spark.createDataFrame([("a <b>x</b> {ב} y", "P")], "t string, tag string")
    r = one.select(tx.strip_markup(F.col("t")).alias("s"), tx.is_block_tag(F.col("tag")).alias("b"), tx.ngrams(F.lit("abab"), 2).alias("g")).first()
    assert (r.s, r.b, r.g) == ("a x  y", True, ["ab", "ba"])
    assert one.select(tx.normalise_query(F.lit("Fo-o*1")).alias("n")).first().n == "foo*"


DISTANCES = [
    ("כי ביצחק יקרא לך זרע", ["כי", "ביצחק"], 2, 0),
    ("כי הוא ביצחק יקרא", ["כי", "ביצחק"], 2, 1),
    ("וידבר משה כן אל בני ישראל", ["וידבר", "משה", "כן", "אל", "בני"], 5, 0),
    ("וידבר משה כן אל בני ישראל", ["וידבר", "משה", "כן", "בני"], 5, 0),
    ("וידבר משה כן אל גם בני ישראל", ["וידבר", "משה", "כן", "בני"], 5, 1),
    ("כי אחד שתים שלש ארבע חמש שש שבע שמונה תשע עשר ביצחק", ["כי", "ביצחק"], 2, 10),
    ("כי <b>ביצחק</b> יקרא", ["כי", "ביצחק"], 2, 0),
    ("כִּי בְיִצְחָק יִקָּרֵא לְךָ זָרַע", ["כי", "ביצחק"], 2, 0),
    ("ראובן אחד שתים שמעון שלש ארבע לוי", ["ראובן", "שמעון", "לוי"], 3, 4),
]


@pytest.mark.parametrize(("content", "slots", "asked", "distance"), DISTANCES)
def test_word_distance(content, slots, asked, distance):
    found = snippet(content, [[s] for s in slots], asked)
    assert found["is_match"] and found["word_distance"] == distance


def test_no_match():
    found = snippet("שלום <b>עולם</b>", [["תורה"]])
    assert found == {"html": "שלום עולם", "score": 2147483647, "word_distance": 2147483647, "is_match": False}
    assert not snippet(None, [["ab"]])["is_match"] and not snippet("ab ab", [["ab"], ["ab"]])["is_match"]


ORDERED = [
    ("ab cd", [["ab"], ["cd"]], True),
    ("cd ab", [["ab"], ["cd"]], False),
    ("ab xx cd", [["ab"], ["cd"]], True),
    ("cd ab xx", [["ab"], ["cd"], ["xx"]], False),
    ("cd ab cd xx", [["ab"], ["cd"], ["xx"]], True),
    ("cd xx", [["ab", "cd"], ["xx"]], True),
    ("xx ab", [["ab", "cd"], ["xx"]], False),
    ("<p>ab</p> <b>cd</b>", [["ab"], ["cd"]], True),
]


@pytest.mark.parametrize(("content", "slots", "ok"), ORDERED)
def test_ordered(content, slots, ok):
    assert snippet(content, slots, ordered=True)["is_match"] is ok
    assert snippet(content, slots)["is_match"]


def test_snippet_cuts_long_lines():
    words = " ".join(f"w{chr(97 + i % 26)}" for i in range(40))
    html = snippet(f"{words} target {words}", [["target"]])["html"]
    assert html.startswith("…") and html.endswith("…") and "<mark>target</mark>" in html
    assert len(html.split()) == 17
    wide = ("x" * 29 + " . " * 700) * 3
    assert "<mark>target</mark>" in snippet(f"{wide} target {wide}", [["target"]])["html"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bb", "cc", "dd", "ee"]), min_size=1, max_size=25))
def test_window_equals_scanner_window(spark, words):
    text = " ".join(words)
    slots = [["aa"], ["bb", "cc"], ["dd", "aa"]]
    tokens = positional_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = proximity.windows(tokens, Plan(slots, 3)).collect()
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.asDict() for r in proximity.windows_of_rows(rows, Plan(slots, 3), "doc_id", "text").collect()] == [r.asDict() for r in got]
    slot_of = Plan(slots, 3).slot_of()
    want = tightest(scan(text), slot_of, 3)
    assert bool(got) == bool(want)
    if want:
        r = got[0]
        assert (r.span, r.left_pos, r.right_pos, r.ordered) == (*want, in_order(scan(text), slot_of, 3))
