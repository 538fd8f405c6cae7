import random

import numpy as np
from pyspark.sql import functions as F

from bundlewise.llm import langid

from .helpers import DOC, SF, crowded, odd_texts


def corpus(spark, n=400):
    rng = random.Random(11)
    kinds = {"aa": ["kora", "min", "talo", "venna", "sipe"], "bb": ["gruk", "stolz", "brimt", "haft", "drei"], "cc": ["ñuo", "çale", "ôlu", "éti", "xài"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        words = [rng.choice(kinds[lang]) + rng.choice(["", "", rng.choice(kinds[lang])]) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return spark.createDataFrame(rows, DOC)


def test_words():
    assert langid.letters("Don't STOP: 3rd x_y") == ["don", "t", "stop", "rd", "x", "y"]
    assert langid.letters("ÉTÉ ŉ1²Ⅷz") == ["été", "ʼn", "z"] or langid.letters("ÉTÉ 1²Ⅷz") == ["été", "z"]
    assert langid.letters("") == [] and langid.letters("12 ²½ Ⅷ _ ! ٣") == []
    assert langid.grams("ab", 3) == [" ab", "ab "] and langid.grams("ab", 1) == ["a", "b"] and langid.grams("a", 5) == []


def plain_scores(texts, langs):
    """Log frequencies by the definition: words first, then the longest known n-grams."""
    counts, names = {}, sorted(set(langs))
    for t, k in zip(texts, langs):
        for w in langid.letters(t):
            counts.setdefault(w, {}).setdefault(k, 0)
            counts[w][k] += 1
    pieces = {}
    for w, by in counts.items():
        for size in langid.SIZES:
            for g in langid.grams(w, size):
                for k, n in by.items():
                    pieces.setdefault(g, {}).setdefault(k, 0)
                    pieces[g][k] += n

    def logs(table, group):
        kept = {x: by for x, by in table.items() if sum(by.values()) >= langid.MIN_COUNT}
        out = {}
        for x, by in kept.items():
            size = sum(group(y) == group(x) for y in kept)
            base = [sum(b.get(k, 0) for y, b in table.items() if group(y) == group(x)) for k in names]
            out[x] = np.log([(by.get(k, 0) + 0.5) / (b + 0.5 * (size + 1)) for k, b in zip(names, base)])
        return out

    known, grams = logs(counts, lambda w: 0), logs(pieces, len)

    def score(text):
        total, n = np.zeros(len(names)), 0
        for w in langid.letters(text):
            s = known.get(w)
            if s is None:
                for size in langid.SIZES:
                    got = [grams[g] for g in langid.grams(w, size) if g in grams]
                    if got:
                        s = np.mean(got, axis=0)
                        break
            if s is not None:
                total, n = total + s, n + 1
        z = total / np.sqrt(max(n, 1))
        p = np.exp(z - z.max())
        return names[int(np.argmax(z))], float(p.max() / p.sum())

    return score


def test_equals_the_definition(spark):
    df = corpus(spark, 60)
    rows = df.collect()
    score = plain_scores([r["text"] for r in rows], [r["lang"] for r in rows])
    model = langid.learn(crowded(df).repartition(3))
    new = ["kora stolz", "koramin unknown", "drei drei talo", "zzz qqq ñ", "brimtbrimtbrimt sipesipe", "x"]
    given = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(new)], DOC)
    got = {r["doc_id"]: r for r in langid.identify(crowded(given), model).select("row.doc_id", "lang_pred", "score").collect()}
    for i, t in enumerate(new):
        want = score(t)
        assert got[i]["lang_pred"] == want[0] and abs(got[i]["score"] - want[1]) < 1e-4, t


def test_unseen_words_back_off_to_shorter_grams(spark):
    model = langid.learn(corpus(spark))
    word = "koraminvenna"  # no such word, but its longest n-grams
    assert word not in model.words and any(g in model.grams for g in langid.grams(word, 5))
    assert not any(g in model.grams for g in langid.grams("zkoz", 4)) and model.pieces("zkoz")
    assert model.pieces("中") == []
    assert model.predict(word, {})[0] == "aa"


def test_odd_rows(spark):
    df = corpus(spark)
    model = langid.learn(df)
    texts = odd_texts() + ["123 !?", "中文", "²½", "kora kora"]
    given = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in langid.identify(crowded(given), model, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        none = not any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == none and 0 <= got[i]["score"] <= 1, t
    assert got[len(texts) - 3]["lang_pred"] in model.languages  # letters, but none known
    assert got[len(texts) - 1]["lang_pred"] == "aa"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOC)
    model = langid.learn(empty)
    assert model.languages == [] and langid.identify(empty, model).collect() == []
    nulls = spark.createDataFrame([(1, "text", None, None, 0), (2, None, "aa", None, 0)], DOC)
    assert langid.learn(nulls).languages == []
    assert langid.identify(nulls, model).first()["lang_pred"] == "und"


def test_held_out_rows_teach_nothing(spark):
    df = corpus(spark)
    known = langid.learn(df, eligible=langid.fold_of(F.col("doc_id")) != 2)
    held = df.where(langid.fold_of(F.col("doc_id")) == 2)
    poisoned = df.where(langid.fold_of(F.col("doc_id")) != 2).union(held.withColumn("lang", F.lit("zz")).withColumn("text", F.lit("poison")))
    again = langid.learn(poisoned, eligible=langid.fold_of(F.col("doc_id")) != 2)
    assert known.languages == again.languages and known.words == again.words and np.array_equal(known.table, again.table)
    got = langid.identify(held, known).select("row.lang", "lang_pred").collect()
    assert len(got) > 60 and sum(r["lang"] == r["lang_pred"] for r in got) == len(got)


def test_model_size_is_bounded(spark):
    whole = langid.learn(corpus(spark))
    model = langid.learn(corpus(spark), max_words=7, max_grams=9)
    assert 0 < len(model.words) <= 7 and 0 < len(model.grams) <= 9 and len(model.table) == len(model.words) + len(model.grams)
    assert set(model.words) < set(whole.words)


def test_query_on_held_out_rows(spark):
    got = langid.op13_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == truth.count() and len(held) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
