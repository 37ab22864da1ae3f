"""Registered queries take the whole table."""

import random

import pytest

from loam import registry
from tests.oracle import same


@pytest.fixture
def folder(spark, tmp_path):
    """Writes documents (doc_id, text) as a table folder."""

    def write(rows):
        documents = [(i, t, f"src{(i or 0) % 3}") for i, t in rows]
        spark.createDataFrame(documents, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def best_window(words, terms):
    """(span, left, right) of the least span with both terms, by trying all pairs of places."""
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
    found = []
    for i, v in enumerate(words):
        for j, w in enumerate(words):
            if (v, w) == terms:
                left, right = min(i, j), max(i, j)
                found.append((starts[right] + len(words[right]) - starts[left], right, left))
    return min(found, default=None)


def by_hand(text):
    words, terms = (text or "").split(" "), ("the", "of")
    if (best := best_window(words, terms)) is None:
        return text or "", 2147483647, 2147483647, False
    span, right, left = best
    a, b = max(0, left - 8), min(len(words), right + 9)
    html = " ".join(f"<mark>{w}</mark>" if w in terms else w for w in words[a:b])
    return "…" * (a > 0) + html + "…" * (b < len(words)), span, max(0, right - left - 1), True


def test_fallback_snippets_of_every_line(spark, folder):
    random.seed(11)
    few, many = ["the", "of", "sky", "berry"], ["apple", "light", "day"] * 20
    texts = {i: " ".join(random.choices(few + many, k=random.randint(1, 60))) for i in range(0, 400, 3)}
    texts |= {250: None, 1_000: "", -7: "of the sea", 10**12: " ".join(["tree"] * 300 + ["of", "old", "the"] + ["tree"] * 300)}
    got = registry.queries()["snippet_fallback"](spark, folder(texts.items())).collect()
    assert len(got) == len(texts)
    assert {r.id: (r.html, r.score, r.word_distance, r.is_match) for r in got} == {i: by_hand(t) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["incremental_equals_batch", "delete_then_search"])
def test_batches_hold_null_and_negative_ids(spark, folder, name):
    path = folder([(None, "apple sky"), (-1, "apple"), (-7, "berry"), (-9, "sky"), *((i, f"apple {'day' * (i % 2)}") for i in range(12))])
    same(spark, path, registry.queries()[name], registry.oracle_sql()[name])
