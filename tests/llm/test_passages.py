import random

import numpy as np

from bundlewise.llm import paragraphs, passages
from bundlewise.llm.shingles import words_of

from .helpers import SF, crowded, docs, odd_texts
from .test_linking import brute_repeats


def brute_passages(texts):
    """Words in taken windows that stand in an earlier text, or earlier in the same; the first place keeps them."""
    size, spread, first, gone = passages.WINDOW, passages.SPREAD, {}, []
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        low = words_of((t or "").encode())
        lost = [False] * len(w)
        hashes = [int(passages.Rolling(b" ".join(low[p : p + size])).spans(np.array([0]), np.array([len(b" ".join(low[p : p + size]))]))[0]) for p in range(len(w) - size + 1)]
        parts = [range(a, min(a + spread, len(hashes))) for a in range(max(1, len(hashes) - spread + 1))] if hashes else []
        chosen = {p for part in parts for p in part if hashes[p] == min(hashes[q] for q in part)}
        for p in sorted(chosen):
            own = tuple(low[p : p + size])
            at = first.setdefault(own, (i, p))
            if at != (i, p):
                for q in range(p if at[0] != i else max(p, at[1] + size), p + size):
                    lost[q] = True
        gone.append(lost)
    return gone


def plain_text(t, lines, gone):
    if t is None:
        return None
    out, at = [], 0
    for k, line in enumerate(t.split("\n")):
        w = line.encode().split()
        lost = gone[at : at + len(w)]
        at += len(w)
        if k in lines or (w and all(lost)):
            continue
        if any(lost):
            runs, open_ = [], False
            for x, g in zip(w, lost):
                if not g and not open_:
                    runs.append([])
                if not g:
                    runs[-1].append(x)
                open_ = not g
            line = " ".join(b" ".join(r).decode() for r in runs)
        out.append(line)
    return "\n".join(out)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    planted = [[word() for _ in range(rng.randint(51, 90))] for _ in range(6)]
    texts, where = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(30, 160))]
        if i % 2:
            p = rng.randrange(len(planted))
            at = rng.randrange(len(w))
            w[at:at] = planted[p]
            where.append((i, p))
        width = rng.randint(6, 200)
        texts.append("\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width)))
    return texts, [" ".join(p) for p in planted], where


def removed(spark, texts, **kw):
    df = crowded(docs(spark, texts)).repartition(3)
    return {r["doc_id"]: r for r in paragraphs.remove_repeats(df, repeated_passages=True, **kw).select("row.doc_id", "text", "n_words", "removed").collect()}


def test_planted_passages_go_wherever_their_lines_break(spark):
    texts, planted, where = corpus(1)
    got = removed(spark, texts)
    kept, first = {i: " ".join(got[i]["text"].split()) for i in got}, {}
    for i, p in where:
        if p not in first:
            first[p] = i
            assert planted[p] in kept[i]
        else:
            assert planted[p] not in kept[i]
            left = sum(x in set(kept[i].split()) for x in planted[p].split())
            assert left < passages.SPREAD * 2  # its ends at most
    clean = set(range(len(texts))) - {i for i, _ in where}
    assert all(got[i]["text"] == texts[i] and got[i]["n_words"] == 0 for i in clean)


def test_lightly_edited_passages_are_found_between_their_edits(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    edited = list(base)
    edited[60] = "changed"
    lead, other = ([f"{c}{i}" for i in range(90)] for c in "ab")  # lines too different to be near copies
    got = removed(spark, [" ".join(lead + base), " ".join(other + edited) + " tail"])
    assert got[0]["n_words"] == 0 and got[1]["n_words"] >= 50 and "changed" in got[1]["text"]


def test_equals_brute_force(spark):
    texts = corpus(7)[0] + odd_texts() + [" ".join(["same"] * 70), " ".join(f"x{i % 30}" for i in range(150))]
    got = removed(spark, texts)
    lines, gone = brute_repeats(texts), brute_passages(texts)
    for i, t in enumerate(texts):
        outside = sum(g for g in gone[i])
        assert got[i]["text"] == (plain_text(t, lines[i], gone[i]) if outside else plain_text(t, lines[i], [False] * len(gone[i]))), i


def test_repeated_rows_do_not_empty_each_other(spark):
    text = " ".join(f"u{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text + " more"), (2, None)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in paragraphs.remove_repeats(df, repeated_passages=True).select("row.doc_id", "text").collect()]
    assert got.count((1, text)) == 2 and (2, None) in got
    assert all(len((t or "").split()) < 50 for d, t in got if d is None)
    assert paragraphs.remove_repeats(df.limit(0), repeated_passages=True).collect() == []


def test_shared_runs_share_a_window():
    """Any 44 common words are enough, whatever stands around them."""
    rng = random.Random(2)
    for _ in range(200):
        run = [f"r{rng.randrange(10**9)}".encode() for _ in range(passages.WINDOW + passages.SPREAD - 1)]
        a, b = ([f"{c}{rng.randrange(10**9)}".encode() for _ in range(rng.randint(0, 60))] for c in "ab")
        first, second = (set(zip(*[x.tolist() for x in passages.windows(w)[1:]])) for w in (a + run + b, b + run + a))
        assert first & second


def test_query_keeps_documents_without_repeats(spark):
    got = paragraphs.op1_substring_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_paragraphs", "n_repeated", "n_removed", "n_words_removed", "removed", "sources", "text"]
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(given)
    lines, gone = brute_repeats([given[i] for i in ids]), brute_passages([given[i] for i in ids])
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    want = {i: plain_text(given[i], lines[k], gone[k] if any(gone[k]) else [False] * len(gone[k])) for k, i in enumerate(ids)}
    assert rows == want
