"""Decontamination, tokenising, quality rules and sharding against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlewise.llm import byte_bpe, decontaminate, quality, sharding

from .helpers import DOC, SF, crowded, docs, odd_texts

LETTERS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def plain_words(t):
    return re.findall(LETTERS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_leaks(texts, benchmark, window=10):
    wins = {}
    for k, t in enumerate(benchmark):
        w = plain_words(t)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, found = plain_words(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                ids = wins.get(tuple(w[i : i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_chars", [8_000_000, 60])
def test_leaks_equal_brute_force(spark, block_chars):
    rng = random.Random(8)
    pool = [f"W{k}é" if k % 5 == 0 else f"w{k}" for k in range(12)]
    benchmark = [rng.choice([" ", ", ", "--"]).join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(20)] + [None, "", "?!", "w1 w1"]
    texts = [*odd_texts(), *[" ".join(rng.choice(pool) for _ in range(20)) + "; " + rng.choice(benchmark[:20]).upper().replace("É", "é") + "." for _ in range(60)]]
    found = decontaminate.find_leaks(crowded(docs(spark, texts)), crowded(items(spark, benchmark)), block_chars=block_chars)
    got = {r["row"]["doc_id"]: r for r in found.select("*", decontaminate.span_words().alias("hit")).collect()}
    assert [(got[i]["n_words"], got[i]["hit"], got[i]["items"]) for i in range(len(texts))] == brute_leaks(texts, benchmark)
    for i, t in enumerate(texts):  # offsets point at the hit words of the original
        w, raw = plain_words(t), (t or "").encode()
        for a, b, x, y in zip(got[i]["word_spans"][::2], got[i]["word_spans"][1::2], got[i]["byte_spans"][::2], got[i]["byte_spans"][1::2]):
            assert plain_words(raw[x:y].decode()) == w[a:b]


def test_leaks_of_empty_tables(spark):
    assert decontaminate.find_leaks(docs(spark, []), items(spark, ["a b"])).count() == 0
    assert decontaminate.find_leaks(docs(spark, ["a b"]), items(spark, [])).first()["word_spans"] == []
    assert decontaminate.find_leaks(docs(spark, ["a b"]), items(spark, [None])).first()["items"] == []


def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(byte_bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(spark):
    rng = random.Random(3)
    alphabet = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 0x1C, 0x85, 0x2003, 0x3042, 0x4E2D, 0x1F600, 9, 10]]
    texts = [*odd_texts(), "a" * 3000, "ab" * 2000, " " * 500, "<|endoftext|>", "don't I'LL  x\n\n y "]
    texts += ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(150)]
    texts += ["".join(rng.choice("aab  \n'sabertn") for _ in range(300)) for _ in range(50)]
    tool = library()
    done = {r["row"]["doc_id"]: r for r in byte_bpe.encode(crowded(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(bytes(done[i]["ids"]), "<u4").tolist() == tool.encode_ordinary(t or "")
        assert bytes(done[i]["decoded"]) == (t or "").encode()
    stored = spark.createDataFrame([(1, done[16]["ids"]), (2, None)], "k int, ids binary")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(stored).orderBy("row.k").collect()] == [texts[16].encode(), b""]
    assert byte_bpe.encode(docs(spark, [])).count() == 0


def test_ids_of_given_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    tool = library()
    for r in byte_bpe.encode(given).collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tool.encode_ordinary(r["row"]["text"] or "")


def test_late_pairs_of_lower_rank_go_first():
    # after b+c the pair a+bc has a lower rank than the merge in progress, and takes its place in the same piece
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 1, b"bc": 2}
    tool = byte_bpe.Replay({k: v + (0 if len(k) > 1 else 0) for k, v in ranks.items()})
    assert tool.encode([b"abcbc", b"bcabc", b"zbc"]) == [[1, 2], [2, 1], [ord("z") + 10, 2]]


def brute_base(t):
    t = t or ""
    ws = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    at = {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def noisy_texts(rng, n):
    out = []
    for _ in range(n):
        w = [rng.choice(["a", "bb", "#x", "é|"]) if rng.random() < 0.2 else f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 60))]
        k = rng.randrange(len(w) + 1)
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(w + w[k : k + 12] * rng.randrange(4)) + rng.choice(["", "\nsame line\nsame line\n \n "]))
    return out


def test_base_counts_and_verdict_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [*odd_texts(), *noisy_texts(rng, 150)]
    weights = [rng.randint(-2_000_000, 2_000_000) for _ in range(64)]
    judged = quality.judge(crowded(docs(spark, texts)), weights, 10_000)
    got = {r["row"]["doc_id"]: r for r in judged.collect()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in {w for t in texts for w in re.split("[\x20\x09-\x0d]+", t or "") if w}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(a, b) for t in texts for s in [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]] for a, b in zip(s, s[1:])}
    rows = spark.createDataFrame([(hashes[a], hashes[b], a, b) for a, b in pairs], "x bigint, y bigint, a string, b string")
    bigram = {(r["a"], r["b"]): r["h"] for r in rows.select("a", "b", F.xxhash64("x", "y").alias("h")).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        grams = [hashes[w] for w in ws] + [bigram[p] for p in zip(ws, ws[1:])]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        score = sum(weights[h % 64] for h in grams) // len(grams) if grams else None
        assert (r["base_failed"], r["score"]) == (failed, score)
        assert r["kept"] == (not failed and score >= 10_000)
    # a filter on the verdict keeps what the verdict says
    assert {r["doc_id"] for r in judged.where("kept").select("row.doc_id").collect()} == {i for i in got if got[i]["kept"]}


def test_ratio_parts_trusted_from_raw(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of and in to is was".split()) for _ in range(60)) for _ in range(60)]
    junk = [" ".join(rng.choice("BUY!! NOW!! WIN!! $$$".split()) + str(rng.randrange(900)) for _ in range(60)) for _ in range(40)]
    df = docs(spark, good + junk)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(60, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    weights, threshold = quality.fit(df, labels)
    kept = {r["row"]["doc_id"] for r in quality.judge(df, weights, threshold).where("kept").collect()}
    assert kept >= set(range(30)) and len(kept & set(range(30, 60))) > 15 and not kept & set(range(60, 100))
    none, low = quality.fit(df, labels.where("quality = 7"))
    assert set(none) == {0} and quality.judge(df, none, low).where("kept").count() == 100
    assert quality.judge(docs(spark, []), none, low).count() == 0


def test_every_trusted_text_counts(spark):
    n = 21_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("x"), F.hex("id"), F.hex(F.col("id") * 7919)).alias("text"))
    weights, _ = quality.fit(df, df.select("doc_id", F.lit(1).alias("quality")))
    assert set(weights) == {0}  # the trusted texts are the corpus


def test_low_quantile_is_exact(spark):
    rng = random.Random(8)
    for n in (0, 1, 10, 11, 400):
        given = [round(rng.gauss(0, 5000)) for _ in range(n)]
        got = quality.low_quantile(spark.createDataFrame([(x,) for x in given], "s bigint"), 10)
        assert got == (sorted(given)[-(-n // 10) - 1] if n else None)


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_each_cell_by_single_steps(spark, n, bits):
    grid = spark.range(1 << (n * bits)).select(*[F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"x{k}") for k in range(n)])
    rows = sorted(grid.select(sharding.hilbert_index([F.col(f"x{k}") for k in range(n)], bits).alias("h"), "*").collect())
    assert [r["h"] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 3, 40, 257])
def test_shards_are_equal_runs(spark, n):
    rng = random.Random(n)
    texts = [rng.choice([None, "", "copy", f"text {i}" * rng.randint(1, 9)]) for i in range(n)]
    rows = [(i if i % 9 else None, t, rng.choice(["en", "de", None]), f"src{rng.randrange(5)}", 0) for i, t in enumerate(texts)]
    df = crowded(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).repartition(3)
    got = sharding.assign(df, ["lang", "source"]).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(40)]
    assert len(got) == n and max(counts) - min(counts) <= 1 and sorted(counts, reverse=True) == counts
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    along = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in along] == sorted(r["hilbert"] for r in got)
    order = [r["text_crc32"] for r in along]  # equal texts follow one another
    assert sum(a != b for a, b in zip(order, order[1:])) == max(len(set(order)) - 1, 0)


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_string_cuts_are_values_at_quantiles(spark, n):
    rng = random.Random(n)
    # a third of the rows hold one value, some none; all begin alike, some are long
    values = [rng.choice(["https://hot", None, f"https://{rng.randrange(40):03d}", "https://" + "y" * 5_000 + str(rng.randrange(3))]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("binary").alias("v")).repartition(5)
    order = sorted((v or "").encode() for v in values)
    want = {order[-(-n * k // 8) - 1] for k in range(1, 8)} if n else set()
    assert sharding.text_cuts(df, "v", 3) == sorted(want)


def test_sources_that_begin_alike_are_told_apart(spark):
    long = "word " * 200_000
    rows = [(i, f"text {i}" if i else long, "en", f"common_crawl_{2000 + i % 16}", 0) for i in range(320)]
    got = sharding.assign(spark.createDataFrame(rows, DOC).repartition(4), ["source"], shards=16).collect()
    spread = {s: {r["doc_id"] % 16 for r in got if r["shard"] == s} for s in range(16)}
    assert {r["doc_id"]: r["size"] for r in got}[0] == len(long) + 16
    assert sum(map(len, spread.values())) < 16 * 6  # of 16 sources, few to a shard


def test_files_prune_by_metadata(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.assign(df, ["lang", "source"], shards=8)
    sharding.write_shards(df, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(df).count() == 0 and back.count() == df.count()
    spread = back.groupBy("shard").agg(F.countDistinct("lang").alias("n")).collect()
    assert sum(r["n"] for r in spread) < 8 * df.select("lang").distinct().count()


def test_leak_query_equals_its_statement(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = decontaminate.op8_decontamination(spark, SF)
    want = con.execute(decontaminate.OP8_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in want}
