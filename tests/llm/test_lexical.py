import math
import random

import duckdb
import pytest

from bundlewise.llm import lexical

from .helpers import SF, crowded, docs, odd_texts

ITEM = "item_id bigint, text string"


def plain_terms(text):
    out, run = [], ""
    for c in text or "":
        if ord(c) > 127 or (c.isascii() and c.isalnum()):
            run += c.lower() if "A" <= c <= "Z" else c
        elif run:
            out.append(run)
            run = ""
    return out + [run] if run else out


def plain_rank(texts, ids, items, k=10):
    """Every document against every item by the formula."""
    words = [plain_terms(t) for t in texts]
    N, L = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in zip(ids, words):
            if not w:
                continue
            m = 100 - 90 + (90 * len(w) * N) // L
            score = 0
            for t in set(plain_terms(text)):
                tf = w.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(spark, texts, items, ids=None, **kw):
    df = crowded(docs(spark, texts, ids)).repartition(3)
    got = lexical.rank(df, crowded(spark.createDataFrame(items, ITEM)), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_odd_texts_ties_and_nulls(spark):
    texts = odd_texts() + ["Two words", "TWO, words!", "naïve café", "Café—NAÏVE", "x_y 12ab", "ÀB"] + ["same text here"] * 30
    items = [(0, "two WORDS"), (1, None), (2, ""), (3, "w5x5 w6x6 café tail"), (3, "one same ÀB àb"), (None, "here 12ab"), (5, "absent"), (6, "é ü ñ a b c")]
    ids = list(range(len(texts)))
    ids[-1], ids[-2], ids[-3] = None, 40, 40
    assert ranked(spark, texts, items, ids) == plain_rank(texts, ids, items)


@pytest.mark.parametrize("item_tile, vocab_tile, block, k", [(64, 4096, 8_000_000, 10), (2, 3, 8_000_000, 4), (3, 1, 60, 10)])
def test_tiles_and_blocks_change_nothing(spark, monkeypatch, item_tile, vocab_tile, block, k):
    monkeypatch.setattr(lexical, "ITEM_TILE", item_tile)
    monkeypatch.setattr(lexical, "VOCAB_TILE", vocab_tile)
    rng = random.Random(5)
    pool = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.choices(pool, [1 / (j + 1) for j in range(40)], k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(150)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(11)]
    assert ranked(spark, texts, items, k=k, block_chars=block) == plain_rank(texts, range(150), items, k)


def test_partial_sums_stay_exact():
    for most in (1, 24_000, 10**8, 1 << 40):
        step = lexical.vocabulary_step(most)
        assert step == 1 or step * most * lexical.MAX_IMPACT < 1 << 53
    assert lexical.vocabulary_step(24_000) == lexical.VOCAB_TILE


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("abc def-ghi " * 5000).encode()
    whole = [w for run in lexical.term_runs(text) for w in run]
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert [w for run in lexical.term_runs(text) for w in run] == whole and len(whole) == 15_000


def test_empty_tables(spark):
    none = docs(spark, [])
    some = docs(spark, ["a b", None])
    assert lexical.rank(none, spark.createDataFrame([(1, "a")], ITEM)).collect() == []
    assert lexical.rank(some, spark.createDataFrame([], ITEM)).collect() == []
    assert lexical.rank(docs(spark, ["", None, "?!"]), spark.createDataFrame([(1, "a")], ITEM)).collect() == []


def test_query_equals_its_statement(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = lexical.op11_lexical_search(spark, SF)
    want = con.execute(lexical.OP11_SQL).fetchall()
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(want)
