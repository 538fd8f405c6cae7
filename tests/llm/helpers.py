"""Plain versions of what the operators compute, for small inputs."""

import re

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def shingles(ws, size=5):
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def similar(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def groups(n, linked):
    """Least member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd_texts():
    """Null, empty, blank, short, repeated and very long texts."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    return [None, "", " \t\n ", "one", "two words", "two words", "Two  WORDS", long, long + " tail", "\n\n\n", "é ü ñ " * 3, "a\x00b c"]


def crowded(df):
    """The same rows beside columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "t", "h", "id", "root", "k1", "k2", "dk", "pos", "keep", "size", "n", "b", "word", "score", "shard", "part", "_id", "weight", "cluster", "gone"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names if c not in df.columns])
