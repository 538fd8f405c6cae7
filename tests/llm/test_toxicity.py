import random

from pyspark.sql import functions as F

from bundlewise.llm import toxicity

from .helpers import crowded, docs, odd_texts


def test_folding_undoes_disguises():
    assert toxicity.fold("L0SER lоser ｌｏｓｅｒ lo​ser") == ["ioser"] * 4
    assert toxicity.fold("$cum !diot tr@sh") == ["scum", "idiot", "trash"]
    assert toxicity.fold("fun!! 100 $5 a|b") == ["fun", "aib"]
    assert toxicity.fold("") == [] and toxicity.fold("été") == ["été"]


def corpus(spark, n=600):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("mar", "tol", "ven", "sib", "kad") for b in ("a", "ine", "us", "ok", "ept", "ar")]
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "Vilew0rd", "grubX", "grubling", "gru8ish"])
        elif i % 7 == 0:
            k = rng.randrange(len(w) - 1)
            w[k : k + 2] = ["anti", "vileword"]  # an exception phrase
        rows.append((" ".join(w), int(bad)))
    return docs(spark, [t for t, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int"), [y for _, y in rows]


def test_held_out_rows_are_told_apart(spark):
    df, labels, truth = corpus(spark)
    model = toxicity.learn(crowded(df), labels, eligible=toxicity.fold_of(F.col("doc_id")) != 0)
    assert " anti viieword " in model.phrases
    got = {r["doc_id"]: r for r in toxicity.score(df, model).select("row.doc_id", "score", toxicity.fold_of(F.col("row.doc_id")).alias("f")).collect()}
    held = [i for i in got if got[i]["f"] == 0]
    assert len(held) > 80
    assert sum((got[i]["score"] >= 0.5) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    assert toxicity.Lexicon.from_json(model.to_json()) == model


def test_odd_rows_and_labels(spark):
    df, labels, _ = corpus(spark, 200)
    extra = spark.createDataFrame([(None, 1), (3, None), (10**6, 1), (5, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(df.unionByName(docs(spark, odd_texts(), ids=range(900, 912))), labels.unionByName(extra))
    scored = toxicity.score(crowded(docs(spark, odd_texts())), model).collect()
    assert len(scored) == 12 and all(0 <= r["score"] < 0.5 for r in scored)
    none = toxicity.learn(df, labels.where("toxic = 0"))
    assert none.weights == {} and {r["score"] for r in toxicity.score(df, none).collect()} == {toxicity.Matcher(none).score(None)[0]}
    assert toxicity.learn(docs(spark, []), labels).weights == {}
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_training_is_bounded(spark):
    df, labels, _ = corpus(spark, 100)
    assert toxicity.training_rows(df, labels, "doc_id", "text", "toxic", F.lit(True), 30).count() <= 30
