import numpy as np

import corpus_pipeline
from bundlewise.llm import quality
from bundlewise.llm.common import table

from .helpers import SF, groups, shingles, similar, words
from .test_linking import brute_repeats
from .test_passages import brute_passages, plain_text
from .test_texts import brute_leaks, library


def test_pipeline_equals_its_plain_version(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights, threshold = quality.fit(docs, labels)
    rows = sorted((r["row"].asDict() for r in quality.judge(docs, weights, threshold).where("kept").collect()), key=lambda r: r["doc_id"])
    sets = [shingles(words(r["text"])) for r in rows]
    root = groups(len(rows), [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j])])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    texts = [r["text"] for r in rows]
    for r, lines, gone in zip(rows, brute_repeats(texts), brute_passages(texts)):
        r["text"] = plain_text(r["text"], lines, gone)
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    rows = [r for r, (_, hit, _) in zip(rows, brute_leaks([r["text"] for r in rows], items)) if not hit]
    tool = library()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows} and len(got) > 50
    for r in rows:
        ids = np.frombuffer(bytes(got[r["doc_id"]]["ids"]), "<u4").tolist()
        assert ids == tool.encode_ordinary(r["text"]) and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["exact"] and got[r["doc_id"]]["n_chars"] == len(r["text"])


def test_stages_take_odd_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "x y", None, None, None), (7, None, "en", "s", 0)], docs.schema))
    for frame in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            rows = out.count()
            assert rows <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    once = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, odd, SF)
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert len(rows) == len(set(rows)) and (None, "x y") in rows and (7, None) in rows
