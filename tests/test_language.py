"""Parser, expansion, spelling, affixes."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loam.functions import hebrew
from loam.plans.expand import Plan, expand, plan
from loam.plans.query import literal_terms, optional_forms, parse

PARSED = [
    ("", []),
    ("   \t  ", []),
    ("|", []),
    ("| | |", []),
    ("תורה", [["תורה"]]),
    ("משה תורה", [["משה"], ["תורה"]]),
    ("שָׁלוֹם", [["שלום"]]),
    ("Torah", [["torah"]]),
    ("א | ב", [["א", "ב"]]),
    ("א | ב ג", [["א", "ב"], ["ג"]]),
    ("א ב | ג ד", [["א"], ["ב", "ג"], ["ד"]]),
    ("ת א | ב | ג ד", [["ת"], ["א", "ב", "ג"], ["ד"]]),
    ("| א ב", [["א"], ["ב"]]),
    ("א ב |", [["א"], ["ב"]]),
    ("א || ב", [["א", "ב"]]),
    ("א | א", [["א", "א"]]),
    ("a | 123 b", [["a", "b"]]),
    ("foo-bar", [["foobar"]]),
    ("%תורה*", [["תורה*"]]),
]


@pytest.mark.parametrize(("text", "slots"), PARSED)
def test_slots(text, slots):
    assert [[p.text for p in s] for s in parse(text)] == slots


@pytest.mark.parametrize(
    ("text", "kind", "edits", "before", "after"),
    [
        ("ישר*", "wildcard", 1, False, False),
        ("יצחק~", "fuzzy", 1, False, False),
        ("משה~2", "fuzzy", 2, False, False),
        ("משה~9", "fuzzy", 3, False, False),
        ("משה~0", "literal", 1, False, False),
        ("משה~12", "literal", 1, False, False),
        ("%תורה", "grammar", 1, True, False),
        ("תורה%", "grammar", 1, False, True),
        ("%תורה%", "grammar", 1, True, True),
        ("*תורה%", "wildcard", 1, False, False),
        ("%שלו?ם", "wildcard", 1, True, False),
        ("the*~", "wildcard", 1, False, False),
        ("%word~", "fuzzy", 1, True, False),
    ],
)
def test_flags(text, kind, edits, before, after):
    ((p,),) = parse(text)
    assert (p.kind, p.edits, p.prefixes, p.suffixes) == (kind, edits, before, after)


def test_literal_terms():
    assert literal_terms("a* | B~ %c%") == ["a*", "b", "c"]


def test_optional_forms():
    assert set(optional_forms("ab?c")) == {"abc", "ac"}
    assert set(optional_forms("ab??")) == {"ab", "a", ""}
    assert set(optional_forms("?ab")) == {"ab"}
    assert optional_forms("a?b?c?d?e?") is None


def test_spelling():
    assert "ששים" in hebrew.spelling_variants("שישים")
    assert "שישים" not in hebrew.spelling_variants("שישים")
    assert "גברים" in hebrew.spelling_variants("גבורים")
    assert "שלחן" in hebrew.spelling_variants("שולחן")
    assert "תרה" in hebrew.spelling_variants("תורה")
    assert hebrew.spelling_variants("א") == [] == hebrew.spelling_variants("")
    assert len(hebrew.spelling_variants("אברהמיצחקיעקב")) <= 42
    assert set(hebrew.spelling_variants("כי")) >= {"כוי", "כיי"} or hebrew.spelling_variants("כי")


@given(st.text("אבגויהםתן", max_size=9))
def test_spelling_never_gives_the_term(term):
    found = hebrew.spelling_variants(term)
    assert term not in found and len(found) == len(set(found)) and all(len(v) >= 2 for v in found)


def test_affixes():
    assert hebrew.strip_affixes("והספרים") == ("ספר", ["וה"], ["ים"])
    assert hebrew.joined("ספר", ["וה"], ["ים"]) == "והספרים"
    assert hebrew.is_prefix("וה") and hebrew.is_suffix("ים") and hebrew.is_affix("ים") and not hebrew.is_affix("קק")
    assert len(hebrew.grammar_forms("x", True, False)) == 34 and len(hebrew.grammar_forms("x", False, True)) == 33


VOCABULARY = ["the", "then", "them", "there", "theme", "other", "either", "xthe", "abthe", "thebook", "thousand", "in", "inn", "on"]


def terms(spark, text):
    vocab = spark.createDataFrame([(v,) for v in VOCABULARY], "term string")
    return {r.term for r in expand(vocab, parse(text)[0][0]).collect()}


def test_expand(spark):
    assert terms(spark, "the*") == {"the", "then", "them", "there", "theme", "thebook"}
    assert terms(spark, "*the") == {"the", "xthe", "abthe"}
    assert terms(spark, "t*e") == {"the", "there", "theme"}
    assert terms(spark, "t*") == set()
    assert terms(spark, "th*e") == {"the", "there", "theme"}
    assert terms(spark, "then~") == {"the", "then", "them"}
    assert terms(spark, "in~") == {"in", "inn"}
    assert terms(spark, "then?") == {"then", "the"}


def test_plan_rules(spark):
    vocab = spark.createDataFrame([(v,) for v in VOCABULARY], "term string")
    asked = lambda q, **k: plan(parse(q), vocab, **k)
    assert asked("zz* the") == Plan([["the"]], 2)
    assert asked("zzzz~ | the").hopeless
    assert asked("zz*").hopeless
    assert asked("missing the") == Plan([["missing"], ["the"]], 2)
    assert asked("") == Plan([], 0, True)
    assert asked("תורה", variants=True).slots[0][:2] == ["תורה", "תרה"]
