"""Each stage of the pipeline, on what its predecessor kept, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm import quality, toxicity
from loam.llm.common import written
from tests.llm.test_operators import ODD_ROWS, brute_components, brute_windows, frame, read


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "quality classifier",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "BPE encoding and decoding",
    ]
    kept = [read(spark, sf)]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), "kept"))
    texts = [{r.doc_id: r.text for r in df.collect()} for df in kept[:-1]]
    assert all(df.columns == kept[0].columns for df in kept[:-1])

    labels = read(spark, sf, "labels")
    scorer = toxicity.fit(kept[0], labels, F.lit(True))
    assert set(texts[1]) == {i for i, t in texts[0].items() if scorer.score(t or "")[0] < 0.5}

    drawn = quality.resample(kept[1], labels, F.lit(True)).collect()
    order = sorted(drawn, key=lambda r: r.gumbel_key, reverse=True)
    chosen = {r.doc_id for r in drawn if r.selected}
    assert chosen == {r.doc_id for r in order[: len(chosen)]} and set(texts[2]) == chosen
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(texts[1])
    assert len(good & chosen) >= 0.95 * len(good)

    groups = brute_components(texts[2])
    assert set(texts[3]) == {i for i, (n, c) in groups.items() if c == i}

    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    windows = brute_windows(list(texts[3].items()), items)
    assert set(texts[4]) == {i for i, (n, hit, _) in windows.items() if not (hit and 20 * hit >= n)}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = kept[5].collect()
    assert {r.doc_id for r in rows} == set(texts[4])
    for r in rows:
        ids = library.encode(texts[4][r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(texts[4][r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, sf):
    docs = frame(spark, ODD_ROWS).withColumn("component", F.lit(1)).withColumn("row", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        ids = Counter(r.doc_id for r in out.collect())
        assert not ids - Counter(i for i, _ in ODD_ROWS), name
        if "Jaccard" in name:
            assert ids == Counter([1, 2, 3, 4, 4, 5, 7, 8, 9, 10, None, None])
        assert stage(spark, docs.limit(0), sf).collect() == []
