import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bundlewise.llm import linking, ngram_join, paragraphs
from bundlewise.llm.linking import components, search

from .helpers import SF, crowded, docs, groups, odd_texts, shingles, similar, words


def random_sets(rng, n, vocabulary):
    made = []
    for _ in range(n):
        if made and rng.random() < 0.6:
            own = set(rng.choice(made).tolist())
            for _ in range(rng.randint(0, 4)):
                if own and rng.random() < 0.5:
                    own.discard(rng.choice(sorted(own)))
                own.add(rng.randrange(vocabulary))
        else:
            own = {rng.randrange(vocabulary) for _ in range(rng.randint(0, 40))}
        made.append(np.array(sorted(own), np.uint64))
    return made


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_every_pair_once(seed):
    rng = random.Random(seed)
    sets = random_sets(rng, rng.randint(2, 25), rng.choice([8, 30, 200]))
    side = np.array([rng.randrange(2) for _ in sets]) if seed % 2 else None
    got = [(min(i, j), max(i, j)) for i, near in search(sets, side) for j in near.tolist()]
    plain = [set(s.tolist()) for s in sets]
    want = [
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(plain[i], plain[j]) and (side is None or side[i] != side[j])
    ]
    assert sorted(got) == want


@pytest.mark.parametrize("across", [False, True])
def test_a_task_does_not_hold_the_pairs_of_a_large_family(across):
    n = 3000  # each links with each: 4.5 million pairs, 36 MB of partners
    parts = [k % 2 if across else 0 for k in range(n)]
    sets = [np.sort(np.append(np.arange(1, 18, dtype=np.uint64), np.uint64(1000 + k))).tobytes() for k in range(n)]
    tile = pa.table({"id": list(range(n)), "weight": [1] * n, "elements": pa.array(sets, pa.binary()), "i": [0] * n, "j": [int(across)] * n, "side": parts})
    tracemalloc.start()
    try:
        got = linking._tile(tile, 80)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(got.column("root").to_pylist()) == {0}
    assert got.column("n_links").to_pylist() == [n // 2 if across else n - 1] * n
    assert peak < 16 << 20


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(3, 3), (1, 2), (2, 1)]
    pairs += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(pairs)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = groups(500, pairs)
    assert got == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_join(texts):
    sets = [shingles(words(t)) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j])]
    return [len(s) for s in sets], groups(len(sets), pairs), [sum(i in p for p in pairs) for i in range(len(sets))]


def check_join(df, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()}
    assert got == dict(enumerate(zip(*brute_join(texts))))


def near_texts(rng, n):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(500)) for _ in range(rng.randint(6, 90))) for _ in range(8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
        out.append(" ".join(w) + rng.choice(["", " a shared closing line that many texts have in common here"]))
    return out


@pytest.mark.parametrize("tile", [400_000, 900])
def test_join_equals_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(linking.link, "__defaults__", (80, tile))  # small tiles split families over tasks
    texts = near_texts(random.Random(11), 160)
    check_join(ngram_join.near_duplicates(docs(spark, texts).repartition(5)), texts)


def test_join_of_odd_rows(spark):
    texts = odd_texts()
    check_join(ngram_join.near_duplicates(crowded(docs(spark, texts))), texts)
    rows = ngram_join.near_duplicates(docs(spark, ["a b c", "a b c", None], ids=[None, 4, 4])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in rows) == [("4", "4", 0), ("4", "4", 0), ("None", "None", 0)]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_join_where_ids_have_several_texts(spark):
    # every row is a document: a link must not hang on which row of an id is met first
    rng = random.Random(23)
    texts = near_texts(rng, 90)
    ids = [rng.randrange(12) for _ in texts]
    sizes, root, n_links = brute_join(texts)
    least = {r: min(i for i, x in zip(ids, root) if x == r) for r in root}
    want = sorted(zip(ids, sizes, [least[r] for r in root], n_links))
    got = ngram_join.near_duplicates(docs(spark, texts, ids=ids).repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == want


@pytest.mark.parametrize("seed", range(10))
def test_what_buckets_find_is_summed_by_destination(seed):
    rng = random.Random(seed)
    posted = [[(rng.randrange(40), np.unique(np.array([rng.randrange(300) << 55 for _ in range(rng.randrange(12))], np.uint64))) for _ in range(15)] for _ in range(4)]
    own = {}
    for batch in posted:
        for k, s in batch:
            own.setdefault(k, s)  # an owner posts the same hashes wherever it is met
    posted = [[(k, own[k]) for k, _ in batch] for batch in posted]
    buckets, dests, least = rng.choice([1, 7]), rng.choice([1, 5]), 2
    by_bucket = {}
    for batch in posted:
        for row in linking._bucket_rows(batch, buckets).to_pylist():
            by_bucket.setdefault(row["bucket"], []).append(row)
    by_dest = {}
    for rows in by_bucket.values():
        found = linking._count_bucket(pa.Table.from_pylist(rows, pa.schema(linking._BUCKET_COLUMNS)), least, dests).to_pylist()
        assert len(found) <= dests
        for row in found:
            by_dest.setdefault(row["dest"], []).append(row)
    got = [x for rows in by_dest.values() for x in linking._sum_destination(pa.Table.from_pylist(rows, pa.schema(linking._COUNTED))).to_pylist()]
    every = [h for k in own for h in own[k].tolist()]
    several = {h for h in every if every.count(h) > 1}
    counts = {x["key"]: x["n"] for x in got if x["kind"] == 0}
    assert len(counts) == sum(x["kind"] == 0 for x in got)
    for k, s in own.items():
        assert counts.get(k, 0) >= len(several & set(s.tolist()))  # more only where a text occurs in several batches
    assert several <= {x["key"] % 2**64 for x in got if x["kind"] == 1}


def test_prefixes_are_long_enough():
    for n in range(1, 400):
        for m in range(-(-n * 4 // 5), n * 5 // 4 + 1):
            common = -(-80 * (n + m) // 180)
            sure = min(ngram_join.slack(n), ngram_join.slack(m))
            assert ngram_join.expected(n, 80) <= sure
            assert min(n, n - common + sure) <= ngram_join.prefix_length(n, 80)


def brute_repeats(texts, min_words=20):
    lines = [(d, pos, words(x)) for d, t in enumerate(texts) for pos, x in enumerate((t or "").split("\n")) if len(words(x)) >= min_words]
    sets = [shingles(w) for _, _, w in lines]
    root = groups(len(lines), [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j])])
    gone = [[] for _ in texts]
    for k, r in enumerate(root):
        if r != k:  # lines are in order of document and place, so the least member stays
            gone[lines[k][0]].append(lines[k][1])
    return gone


def test_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randint(15, 60))) for _ in range(25)]

    def line():
        w = rng.choice(pool).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        return " ".join(w) if rng.random() < 0.8 else " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))

    texts = ["\n".join(line() for _ in range(rng.randint(0, 5))) for _ in range(60)]
    want = brute_repeats(texts)
    got = {r["row"]["doc_id"]: r for r in paragraphs.remove_repeats(docs(spark, texts).repartition(4)).collect()}
    assert [got[i]["removed"] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def test_repeats_of_given_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] for r in given]
    got = paragraphs.remove_repeats(docs(spark, texts), keep=["doc_id"]).collect()
    assert {r["row"]["doc_id"]: r["removed"] for r in got} == dict(enumerate(brute_repeats(texts)))


def test_repeats_of_odd_rows(spark):
    same = " ".join(f"s{k}" for k in range(60))
    texts = [*odd_texts(), same, f"{same}\n{same}", None]
    got = {r["row"]["doc_id"]: r for r in paragraphs.remove_repeats(crowded(docs(spark, texts))).collect()}
    assert [got[i]["removed"] for i in range(len(texts))] == brute_repeats(texts)
    assert got[0]["text"] is None and got[1]["text"] == "" and got[12]["text"] == same and got[13]["text"] == ""
    assert got[12]["n_repeated"] == 1 and got[13]["sources"] == [12]
    twice = paragraphs.remove_repeats(docs(spark, [same, same], ids=[3, 3])).collect()  # one document, stored twice
    assert [r["text"] for r in twice] == [same, same]
    assert paragraphs.remove_repeats(docs(spark, [])).count() == 0


def test_hard_wrapped_passages_are_repeats(spark):
    new = iter(range(10**6))
    own = lambda *sizes: [" ".join(f"u{next(new)}" for _ in range(n)) for n in sizes]
    passage = own(12, 10, 14, 3, 11, 13)
    first, second, third = [*own(7), *passage, *own(9)], [*own(8, 12, 25), *passage[:3], "", *passage[3:], *own(30)], [*own(15, 11, 5), *passage]
    loop = [*["again and again"] * 12, *own(22)]
    texts = ["\n".join(x) for x in (first, second, third, own(4, 3, 30), own(4, 3, 30), loop, own(10, 12))]
    got = {r["row"]["doc_id"]: r for r in paragraphs.remove_repeats(docs(spark, texts).repartition(3), blocks=True).collect()}
    assert [got[i]["removed"] for i in range(7)] == [[], [3, 4, 5, 7, 8, 9], [3, 4, 5, 6, 7, 8], [], [], list(range(7, 12)), []]
    assert got[1]["sources"] == [0] and got[0]["n_paragraphs"] == 8 and got[0]["n_repeated"] == 6 and got[6]["n_paragraphs"] == 2


@pytest.mark.parametrize("seed", range(20))
def test_blocks_are_the_least_that_begin_or_end_at_a_line(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 3, 7, 12, 19, 25]) for _ in range(rng.randint(0, 14))]
    raw = "\n".join(" ".join("w" * n) for n in sizes).encode()
    want = set()
    for i in range(len(sizes)):
        for j in range(i, len(sizes)):
            block = [n for n in sizes[i : j + 1] if n]
            if 0 < sizes[i] < 20 and 0 < sizes[j] < 20 and max(block) < 20 and sum(block) >= 20:
                if sum(block) - sizes[i] < 20 or sum(block) - sizes[j] < 20:
                    want.add(tuple(k for k in range(i, j + 1) if sizes[k]))
    assert {tuple(at) for at, _ in paragraphs.short_blocks(raw, 20)} == want


def test_bands_reach_their_recall():
    b = paragraphs.bands_for(0.9995, 2, 80)
    assert 1 - (1 - 0.8**2) ** b >= 0.9995
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        common = [rng.getrandbits(64) for _ in range(80)]
        pairs += [np.array(sorted(common + [rng.getrandbits(64) for _ in range(10)]), np.uint64) for _ in range(2)]
    made = paragraphs.minhash_bands(pairs, b, 2)
    assert sum(bool((made[k] == made[k + 1]).any()) for k in range(0, 800, 2)) >= 398
