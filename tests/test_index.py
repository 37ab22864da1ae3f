"""Postings algebra, the life of an index, lexicon errors, SQL functions."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from loam.functions.hebrew import strip_affixes, strip_prefixes
from loam.operators import lexicon, matching
from loam.operators.control import cancel, cancellable
from loam.operators.search import Engine, register
from loam.operators.snippets import results_page
from loam.sources.corpus import Corpus, CorpusNotFound
from loam.sources.segments import CorruptIndex, Index, IndexBusy, MemoryIndex
from loam.sources.storage import scratch

DOCS = {1: "berry apple sky", 2: "apple light", 3: "day one", 4: "day two", 5: "day three <b>sky</b>"}


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "id long, content string")


def ids(df, name="doc_id"):
    return sorted(r[name] for r in df.collect())


def test_set_algebra(spark):
    random.seed(5)
    docs = {i: {t for t in "abcdefgh" if random.random() < 0.4} for i in range(80)}
    rows = spark.createDataFrame([(t, i) for i, ts in docs.items() for t in ts], "term string, doc_id long")
    for _ in range(6):
        slots = [random.sample("abcdefghxyz", random.randint(1, 3)) for _ in range(random.randint(1, 3))]
        want = sorted(i for i, ts in docs.items() if all(ts & set(s) for s in slots))
        assert ids(matching.match(rows, slots)) == want
    assert ids(matching.any_of(rows, ["a", "nothing"])) == sorted(i for i in docs if "a" in docs[i])
    assert ids(matching.match(rows, [["a"], []])) == [] == ids(matching.match(rows, []))
    many = [["a", f"t{i}"] for i in range(70)]
    assert ids(matching.match(rows, many)) == sorted(i for i in docs if "a" in docs[i])


def test_life(spark):
    root = scratch(spark, "life")
    now = Index(spark, root)
    assert now.resume_id() == -1 and now.postings().count() == 0
    for i, t in DOCS.items():
        now = now.add(frame(spark, {i: t}), i)
    assert now.add(frame(spark, {9: "again"}), 5) is now
    assert now.resume_id() == 5 and ids(matching.any_of(now.postings(), ["day"])) == [3, 4, 5]
    old = now
    now, told = now.delete(spark.createDataFrame([(4,), (77,)], "id long"))
    assert {r.id: r.deleted for r in told.collect()} == {4: True, 77: False}
    assert ids(matching.any_of(now.postings(), ["day"])) == [3, 5]
    assert ids(matching.any_of(old.postings(), ["day"])) == [3, 4, 5]  # a reader keeps its version
    assert {r.term: r.df for r in now.vocabulary().collect()}["day"] == 3
    assert ids(matching.any_of(now.purge().postings(), ["day"])) == [3, 5]
    with pytest.raises(IndexBusy):
        old.add(frame(spark, {10: "late"}))
    merged = Index.open(spark, root).merge()
    assert len(merged.segments) == 1 and merged.segments[0].level == 1
    assert ids(matching.any_of(merged.postings(), ["sky"])) == [1, 5]
    merged.vacuum()
    assert ids(matching.any_of(Index.open(spark, root).postings(), ["sky"])) == [1, 5]
    with merged.locked(), pytest.raises(IndexBusy):
        merged.locked().__enter__()
    merged.store.delete(merged.segments[0].name)
    with pytest.raises(CorruptIndex):
        Index.open(spark, root)


def test_engine(spark):
    docs = spark.createDataFrame([(i, t, "s1" if i < 3 else None) for i, t in DOCS.items()], "doc_id long, text string, source string")
    corpus = Corpus.of_documents(docs)
    now = Index(spark, scratch(spark, "engine")).add(corpus.line.select("id", "content"))
    engine = Engine(corpus, now.postings(), now.vocabulary())
    for q in ["day", "apple sky", "da* | light", "skyy~", "nothing", "apple light | berry", ""]:
        rows = engine.search(q).collect()
        assert [r.id for r in rows] == ids(engine.search_ids(q))
        for r in rows:
            assert all(any(t in r.content for t in slot) for slot in r.matched_groups)
        assert all(r.is_match for r in engine.snippets(q).collect())
    assert [r.title for r in engine.search("day").collect()] == ["", "", ""]
    assert [r.id for r in engine.search("day", cap=2).collect()] == [3, 4]
    assert [r.id for r in engine.interactive("day", skip=1, batch=1).collect()] == [4]
    shown = engine.line_snippets(spark.createDataFrame([(5,)], "id long"), "day | sky").first()
    assert shown.html == "<mark>day</mark> three <mark>sky</mark>"
    register(spark, engine)
    assert spark.sql("SELECT fts_terms('AT&amp;T x <b>cd') AS t").first().t == ["att", "cd"]
    assert spark.sql("SELECT * FROM fts_parse('ab | cd~')").count() == 2


def test_corpus_not_found(spark):
    with pytest.raises(CorpusNotFound):
        Corpus.read(spark, "/nowhere/line", "/nowhere/book")


def test_lexicon(spark):
    rows = spark.createDataFrame([("mop", 0), ("moth", 1), ("pop", 2), ("star", 3), ("stop", 4), ("top", 5), ("", 6)], "key string, value long")
    path = scratch(spark, "lexicon")
    built = lexicon.build(rows, path)
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(lexicon.starts_with(built, "mo")) == ["mop", "moth"]
    assert keys(lexicon.ends_with(built, "op")) == ["mop", "pop", "stop", "top"]
    assert keys(lexicon.contains(built, "to")) == ["stop", "top"]
    assert keys(lexicon.fuzzy(built, "top", 1)) == ["mop", "pop", "stop", "top"]
    assert lexicon.exact(built, "star").first().value == 3 and lexicon.exact(built, "").first().value == 6
    assert "digraph" in lexicon.to_dot(built)
    with pytest.raises(lexicon.BadEntries):
        lexicon.build(rows.union(rows))
    words = spark.createDataFrame([("בית", 1), ("הבית", 2), ("קבית", 3)], "key string, value long")
    assert keys(lexicon.affixed(words, "בית")) == ["בית", "הבית"]
    assert keys(lexicon.affixed(words, "בית", strict=True)) == []  # its own end is a suffix
    assert keys(lexicon.affixed(words, "בית", after=False, strict=True)) == [w for w in ("בית", "הבית") if strip_prefixes(w)[0] == "בית"]
    assert keys(lexicon.ends_with(spark.read.parquet(path + "-reversed"), "op")) == ["mop", "pop", "stop", "top"]


def test_morphology_equals_the_scalar(spark):
    random.seed(8)
    words = ["".join(random.choices("והבכלמשתינרספדם", k=random.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    for r in lexicon.morphology(rows).collect():
        if r.word is None:
            assert (r.root, r.prefix, r.suffix) == (None, None, None)
        else:
            root, before, after = strip_affixes(r.word)
            assert (r.root, r.prefix, r.suffix) == (root, "".join(before), "".join(after))


def test_batches_are_added_once(spark):
    """Replayed after a merge, after a purge that leaves nothing, and when empty."""
    now = Index(spark, scratch(spark, "once"))
    for i in (1, 2, 3, 4):
        now = now.add(frame(spark, {i: DOCS[i]}), i)
    now = now.add(frame(spark, {20: "1 2 3"}), 5).merge()
    assert [s.level for s in now.segments] == [1] and now.batches == ((1, 5),)
    before = now.postings().count()
    for i in (1, 2, 3, 4, 5):
        now = now.add(frame(spark, {i: DOCS[i]}), i)
    assert now.postings().count() == before and now.version == Index.open(spark, now.store.root).version
    now = now.delete(spark.createDataFrame([(i,) for i in DOCS], "id long"))[0].purge()
    assert now.segments == () and now.add(frame(spark, {2: DOCS[2]}), 2) is now
    assert now.add(frame(spark, {9: "sky"}), 9).progress()["batches"] == [(1, 5), (9, 9)]
    assert {r.name for r in Index.open(spark, now.store.root).files().where("live").collect()} >= {"manifest-00000009.json"}


def test_a_corrupt_index_starts_anew(spark):
    now = Index(spark, scratch(spark, "anew")).add(frame(spark, DOCS), 0)
    now.store.delete(now.segments[0].name)
    again = Index.open_or_restart(spark, now.store.root)
    assert again.version == 0 and again.store.names() == []
    assert again.add(frame(spark, DOCS), 0).resume_id() == 5
    with pytest.raises(ValueError):
        Index.open(spark, "")


def test_contents_are_not_shuffled(spark, sf):
    from loam import registry

    e = registry.engine(spark, sf)
    for df in (e.corpus.fetch(e.search_ids("the of").withColumnRenamed("doc_id", "id")), e.proximity("the of"), e.snippets("the of")):
        df.write.format("noop").mode("overwrite").save()
        physical = df._jdf.queryExecution().executedPlan().toString()
        for line in physical.splitlines():
            assert not ("Exchange hashpartitioning" in line and "content" in line), physical


def test_pages(spark):
    docs = {i: f"{'sky ' * (i % 3)}{'far ' * (i % 17)}day" for i in range(300)}
    rows = spark.createDataFrame([(i, t, "s") for i, t in docs.items()], "doc_id long, text string, source string")
    corpus = Corpus.of_documents(rows)
    now = Index(spark, scratch(spark, "pages")).add(corpus.line.select("id", "content"))
    engine = Engine(corpus, now.postings(), now.vocabulary())
    near = [i for i in docs if i % 3 and i % 17 <= 2]
    for skip, batch in ((0, 5), (7, 10), (0, 200), (len(near) - 1, 9), (500, 5)):
        got = engine.interactive("sky day", most=2, ordered=True, skip=skip, batch=batch, mark=("[", "]")).collect()
        assert [r.id for r in got] == near[skip : skip + batch]
        assert all(r.html.endswith("[day]") for r in got)


QUERIES = ["day", "apple sky", "da* | light", "skyy~", "nothing", "apple light | berry", "", "zq* day", "zqxjkv~ | day", "zq*", "*ay* | sk?y th*", "day | sky *ne | apple"]


def test_ids_without_a_list_of_terms(spark, monkeypatch):
    own = MemoryIndex(frame(spark, {**DOCS, 6: None, 7: ""}))
    engine = Engine(None, own.postings(), own.vocabulary())
    listed = {q: ids(engine.search_ids(q)) for q in QUERIES}
    assert listed["da* | light"] == [2, 3, 4, 5] and listed["zq* day"] == [3, 4, 5]
    assert {q: ids(engine.search_ids_unlisted(q)) for q in QUERIES} == listed
    monkeypatch.setattr("loam.operators.search.MOST_TERMS", 0)
    assert {q: ids(engine.search_ids(q)) for q in QUERIES} == listed
    many = " ".join(["day"] * 70)  # more slots than one long has marks
    assert ids(engine.search_ids_unlisted(many)) == [3, 4, 5] and ids(engine.search_ids_unlisted(many + " sky")) == [5]
    own.close()


def test_places_of_lines_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("loam.sources.corpus.CHUNK", 10)
    random.seed(3)
    rows = [(i, f"word{i}", random.choice(["a", "a", "b", None])) for i in [*random.sample(range(-50, 200), 90), None]]
    corpus = Corpus.of_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = {}
    for source in ("a", "b", None):
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (r[0] is not None, r[0] or 0))
        want |= {r[0]: k for k, r in enumerate(own)}
    assert {r.id: r.line_index for r in corpus.placed.collect()} == want
    assert corpus.placed.count() == len(rows)


def test_results_page(spark):
    rows = spark.createDataFrame([(2, "b & <c>", "<mark>x</mark> y"), (1, None, "first")], "id long, title string, html string")
    page = results_page(rows).first().page
    assert page.index("first") < page.index("b &amp; &lt;c&gt;") < page.index("<mark>x</mark> y")
    assert 'dir="rtl"' in page and page.endswith("</html>")
    assert "<section>" not in results_page(rows.limit(0)).first().page


def test_cancel(spark):
    failed = []

    def slow():
        with cancellable(spark, "slow-search"):
            try:
                spark.range(10**12).where("sqrt(id) < 0").count()
            except Exception as e:  # Spark names the interruption in several ways
                failed.append(e)

    worker = threading.Thread(target=slow, daemon=True)
    worker.start()
    for _ in range(200):
        cancel(spark, "slow-search")
        worker.join(0.1)
        if not worker.is_alive():
            break
    assert failed and not worker.is_alive()
    assert not spark.sparkContext.getJobTags()
