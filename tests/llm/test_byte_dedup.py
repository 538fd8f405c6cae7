import random

import numpy as np
import pytest

from bundlewise.llm import byte_dedup, suffix_arrays
from bundlewise.llm.shingles import Rolling

from .helpers import SF, crowded, docs, odd_texts


@pytest.mark.parametrize("worth", [0, 10**9])
def test_suffix_array_is_the_sorted_order(worth, monkeypatch):
    monkeypatch.setattr(suffix_arrays, "BUCKET_WORTH", worth)
    rng = random.Random(worth)
    for _ in range(400):
        t = [rng.randint(1, rng.choice([2, 3, 5, 30])) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.4:
            t = (t[: len(t) // 3 + 1] * 10)[: len(t)]
        t = np.array(t + [0])
        order = suffix_arrays.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = suffix_arrays.common_prefixes(t, order, np.array([0]), np.array([len(t) - 1]), -1)
        for a, b in zip(order.tolist(), order.tolist()[1:]):
            k = 0
            while t[a + k] == t[b + k]:
                k += 1
            assert shared[b] == k


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([5, 10, 40])
        t = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"a") for _ in range(rng.randint(1, 120)))
        place, _ = byte_dedup.anchors(Rolling(t), len(t), length)
        k, have = byte_dedup.inner_size(length), set(place.tolist())
        h = Rolling(t).windows(k)
        for s in range(len(t) - length + 1):
            inner = h[s : s + length - k + 1]
            assert s + int(np.argmin(inner)) in have


def brute(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for d, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((d, s))
    cover = [bytearray(len(t)) for t in raw]
    for at in seen.values():
        if len(at) > 1:
            for d, s in at:
                cover[d][s : s + length] = b"\x01" * length
    out = []
    for t, c in zip(raw, cover):
        edge = np.diff(np.concatenate(([0], np.frombuffer(bytes(c), np.uint8), [0])).astype(int))
        out.append((bytes(x for x, y in zip(t, c) if not y), sorted(np.flatnonzero(edge).tolist())))
    return out


def check(df, texts, length):
    got = {r["row"]["doc_id"]: (bytes(r["kept"]), r["spans"]) for r in df.collect()}
    assert got == dict(enumerate(brute(texts, length)))


def mixed_texts(rng, n):
    parts = ["".join(rng.choice("abcde é") for _ in range(rng.randint(5, 120))) for _ in range(15)] + ["ab" * 60, "x" * 90]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(rng.randint(0, 6)))
        if t and rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        out.append(t)
    return out + out[:3]


@pytest.mark.parametrize("most_classes", [20_000, 2])
def test_equals_brute_force(spark, most_classes):
    texts = mixed_texts(random.Random(most_classes), 120)
    df = docs(spark, texts).repartition(4)
    check(byte_dedup.remove_repeated_bytes(df, length=40, most_classes=most_classes, shard=50), texts, 40)


def test_given_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    check(byte_dedup.remove_repeated_bytes(docs(spark, texts)), texts, 400)


def test_odd_rows(spark):
    texts = [*odd_texts(), None, "q" * 399, "r" * 400, "s" * 401]
    check(byte_dedup.remove_repeated_bytes(crowded(docs(spark, texts))), texts, 400)
    assert byte_dedup.remove_repeated_bytes(docs(spark, [])).count() == 0
    long = "".join(chr(97 + k * k % 23) for k in range(900)) + "z" * 50
    twice = byte_dedup.remove_repeated_bytes(docs(spark, [long, long, "other"], ids=[None, None, 1])).collect()
    assert sorted(len(r["kept"]) for r in twice) == [0, 0, 5]


def test_the_query_shows_the_text_it_hashes(spark):
    import hashlib

    rows = byte_dedup.op9_suffix_array_dedup(spark, SF).collect()
    given = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans = dict(enumerate(brute([given[k].decode() for k in sorted(given)], 400)))
    for k, r in zip(sorted(given), sorted(rows, key=lambda r: r["doc_id"])):
        kept, at = spans[sorted(given).index(k)]
        assert (r["n_removed"], r["n_spans"]) == (len(given[k]) - len(kept), len(at) // 2)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        if not at:
            assert r["text"].encode() == kept
