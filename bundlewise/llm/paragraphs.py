"""Substring dedup: repeated paragraphs found by MinHash bands, verified by exact Jaccard, removed by component."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm import linking, passages
from bundlewise.llm.common import map_arrow, stored, table
from bundlewise.llm.shingles import key_of, mix, shingle_sets, words_of

SIZE, PERCENT = 5, 80
#: Shorter lines are compared, with `blocks`, in blocks of consecutive ones that reach it together.
MIN_WORDS = 20
#: Share of pairs at the threshold that the bands must bring together.
RECALL, ROWS = 0.9995, 2


def bands_for(recall: float, rows: int, percent: int) -> int:
    """Bands of `rows` minima so that a pair at the threshold meets in one of them with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def minhash_bands(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """Band hashes of each non-empty set; all sets of a batch at once."""
    full = [s for s in sets if len(s)]
    if not full:
        return [np.zeros(0, np.uint64) for _ in sets]
    flat = np.concatenate(full)
    at = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    made = np.empty((bands, len(full)), np.uint64)
    for b in range(bands):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x100000001B3) ^ np.minimum.reduceat(mix(flat ^ salts[b * rows + r]), at))
        made[b] = key
    by_set = iter(np.ascontiguousarray(made.T))
    return [next(by_set) if len(s) else np.zeros(0, np.uint64) for s in sets]


def paragraphs_of(raw: bytes | None, min_words: int) -> list[tuple[int, list[bytes]]]:
    """(line number, words) of the lines with enough words."""
    out = []
    for pos, line in enumerate((raw or b"").split(b"\n")):
        w = words_of(line)
        if len(w) >= min_words:
            out.append((pos, w))
    return out


def short_blocks(raw: bytes | None, min_words: int) -> list[tuple[list[int], list[bytes]]]:
    """(line numbers, words) of the least blocks of consecutive short lines with enough words that begin or end at a line.

    Blank lines do not part a block, a line of enough words does. Blocks overlap, so a passage is found wherever the short
    lines before it begin, and each of its lines lies in a block of the passage's own.
    """
    out: dict[tuple[int, int], tuple[list[int], list[bytes]]] = {}
    run: list[tuple[int, list[bytes]]] = []

    def close():
        total = [0]
        for _, w in run:
            total.append(total[-1] + len(w))
        at = 0
        for end in range(1, len(run) + 1):
            while total[end] - total[at] >= min_words:  # the shortest that begins at `at`
                out[at, end] = ()
                at += 1
            if at and total[end] - total[at - 1] >= min_words:  # the shortest that ends here
                out[at - 1, end] = ()
        for a, b in out:
            made.append(([pos for pos, _ in run[a:b]], [x for _, w in run[a:b] for x in w]))
        out.clear()
        run.clear()

    made: list[tuple[list[int], list[bytes]]] = []
    for pos, line in enumerate((raw or b"").split(b"\n")):
        w = words_of(line)
        if len(w) >= min_words:
            close()
        elif w:
            run.append((pos, w))
    close()
    return made


def doc_key(doc_id: Column, text: Column) -> Column:
    """128-bit identity of a row: rows with equal id and text are one document."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, size: int = SIZE, percent: int = PERCENT, recall: float = RECALL, blocks: bool = False) -> DataFrame:
    """(dk, pos, keeper, keep): each line that repeats, the document that keeps it, and whether it stays here.

    A paragraph is a line of at least `min_words` words; with `blocks`, shorter lines are compared too (see `repeated_blocks`). Equal word sequences form classes; classes whose MinHash
    signatures collide in a band are joined, verified by exact Jaccard similarity of word shingles and clustered by
    components. The first paragraph of a cluster, by document id, then place, is the keeper (null ids come last).
    """
    bands = bands_for(recall, ROWS, percent)
    given = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), doc_key(docs[doc_id], docs[text]).alias("dk"), docs[text].cast("binary").alias("t"))

    def split(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for d, k, t in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "dk", "t")]):
                found = [(pos, None, w) for pos, w in paragraphs_of(t, min_words)] + [(at[0], at, w) for at, w in (short_blocks(t, min_words) if blocks else ())]
                for pos, at, w in found:
                    for c, v in zip(cols, (d, k, pos, *key_of(w), at)):
                        c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "dk", "pos", "k1", "k2", "at"])

    every = stored(given.mapInArrow(split, "doc_id bigint, dk binary, pos int, k1 bigint, k2 bigint, at array<int>"))
    lines, short = every.where("at is null").drop("at"), every.where("at is not null")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "dk", "pos")
    classes = stored(lines.groupBy("k1", "k2").agg(F.min(place).alias("lead"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()))

    def post(texts: list[bytes | None]):
        w = [x for t in texts for _, x in paragraphs_of(t, min_words)]
        for words, b in zip(w, minhash_bands(shingle_sets(w, size), bands, ROWS)):
            yield key_of(words)[0], np.sort(b)

    # copies of a class post alike, so its number of band entries is bounded by classes, not paragraphs
    total = (classes.count() or 0) * bands
    shared = linking.shared_keys(given.select("t"), post, total, 1 << 62).where("kind = 0").select(F.col("key").alias("k1"))
    wanted = classes.join(shared, "k1", "left_semi").select("lead.dk", F.struct(F.col("lead.pos").alias("pos"), "id", "weight").alias("p"))
    # paragraphs of one document only: as many as it has lines
    wanted = wanted.groupBy("dk").agg(F.collect_list("p").alias("ps"))

    def sets_of(batches):
        for batch in batches:
            ids, weights, w = [], [], []
            for t, ps in zip(batch.column("t").to_pylist(), batch.column("ps").to_pylist()):
                at = dict(paragraphs_of(t, min_words))
                for p in ps:
                    ids.append(p["id"])
                    weights.append(p["weight"])
                    w.append(at[p["pos"]])
            sets = shingle_sets(w, size)
            lead = minhash_bands(sets, bands, ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(weights, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.view(np.int64) for x in lead], pa.list_(pa.int64()))],
                names=["id", "weight", "size", "elements", "lead"],
            )

    found = given.select("dk", "t").join(wanted, "dk").select("t", "ps").mapInArrow(sets_of, "id bigint, weight bigint, size bigint, elements binary, lead array<bigint>")
    sets = stored(found.dropDuplicates(["id"]))
    linked = linking.link(sets.drop("lead"), sets.select(F.explode("lead").alias("h"), "id"), percent)
    member = classes.join(linked.select("id", "root"), "id", "left").withColumn("cluster", F.coalesce("root", "id"))
    several = member.groupBy("cluster").agg(F.min("lead").alias("keeper"), F.sum("weight").alias("n")).where("n > 1").drop("n")
    repeated = member.select("k1", "k2", "cluster").join(several, "cluster")
    out = lines.join(repeated, ["k1", "k2"])
    stays = (F.col("dk") == F.col("keeper.dk")) & (F.col("pos") == F.col("keeper.pos"))
    out = out.select("dk", "pos", F.col("keeper.doc_id").alias("keeper"), stays.alias("keep"))
    return out.unionByName(repeated_blocks(short)) if blocks else out


def repeated_blocks(short: DataFrame) -> DataFrame:
    """(dk, pos, keeper, keep): the lines of each block of short lines whose words stand elsewhere too.

    Blocks overlap, so only equal ones are repeats: neighbours would be near copies of each other. The first of equal
    blocks keeps its lines against the others, also where one of these overlaps it.
    """
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "dk", "pos", "at")
    several = short.groupBy("k1", "k2").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = short.join(several, ["k1", "k2"])
    own = F.col("dk") == F.col("keeper.dk")
    first = own & (F.col("pos") == F.col("keeper.pos"))
    lost = F.when(own & ~first, F.array_except("at", "keeper.at")).otherwise(F.col("at"))
    return out.select("dk", F.explode(lost).alias("pos"), F.col("keeper.doc_id").alias("keeper"), first.alias("keep"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Every row of `docs` with its repeated paragraphs removed but for the first of each cluster.

    Result: `row` (the input row, or its columns in `keep`), `text` without the removed lines, `removed` (line numbers),
    `sources` (ids of the documents that keep them), `n_paragraphs` (lines that were compared, by themselves or in blocks), `n_repeated` (of those, lines that stand
    elsewhere too, kept or not). With `repeated_passages`, passages are found in whole texts wherever their lines break (see
    `passages`), and the words of all but the first of them go too; `n_words` counts those outside removed lines.

    Null texts stay null; empty texts and lines stay as they are. Rows with equal id and text are one document and lose the
    same lines, so repeated rows do not empty each other. A null id is a document like any, kept last. An empty table
    gives an empty result. Very long texts are split within their row.
    """
    repeated_passages = options.pop("repeated_passages", False)
    min_words, blocks = options.get("min_words", MIN_WORDS), options.get("blocks", False)
    found = find_repeats(docs, doc_id, text, **options)
    # a short line lies in several blocks, and goes if it goes with one of them
    by_line = found.groupBy("dk", "pos").agg(F.min("keep").alias("keep"), F.min(F.when(~F.col("keep"), F.col("keeper"))).alias("keeper"))
    by_doc = by_line.groupBy("dk").agg(
        F.sort_array(F.collect_list(F.when(~F.col("keep"), F.col("pos")))).alias("gone"),
        F.sort_array(F.collect_set(F.when(~F.col("keep"), F.col("keeper")))).alias("from"), F.count("*").alias("n"),
    )
    columns = docs.columns if keep is None else keep
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    key = doc_key(docs[doc_id], docs[text])
    # a row that holds the text is shuffled with it, once
    beside = [] if text in columns else [docs[text].alias("t")]
    joined = docs.select(row, key.alias("dk"), *beside).join(by_doc, "dk", "left")
    if repeated_passages:
        given = docs.select(key.alias("dk"), *passages.order_of(docs[doc_id], key), docs[text].cast("binary").alias("t"))
        elsewhere = passages.foreign_windows(given.where("t is not null"))
        known = given.select("dk", "d", "h").dropDuplicates(["dk"]).join(elsewhere, ["d", "h"]).select("dk", "elsewhere")
        joined = joined.join(known, "dk", "left")
    else:
        joined = joined.withColumn("elsewhere", F.lit(None).cast("array<bigint>"))

    def make():
        def step(texts, gone, elsewhere):
            out, counts, n_words = [], [], []
            for t, g, e in zip(texts.to_pylist(), gone.to_pylist(), elsewhere.to_pylist()):
                raw = (t or "").encode()
                counts.append(sum(len(x.split()) >= min_words for x in raw.split(b"\n")) + len({pos for at, _ in (short_blocks(raw, min_words) if blocks else ()) for pos in at}))
                drop, lost = set(g or ()), 0
                words = passages.repeated_words(words_of(raw), set(e or ())) if repeated_passages else None
                if words is not None and words.any():
                    of = np.repeat(*zip(*[(k, len(x.split())) for k, x in enumerate(raw.split(b"\n"))]))
                    lost = int((words & ~np.isin(of, list(drop))).sum())
                if lost:
                    t = passages.without_words(raw, words, drop).decode()
                elif drop:
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
                out.append(t)
                n_words.append(lost)
            return out, counts, n_words

        return step

    inputs = {"t": F.col("t") if beside else F.col("row").getField(text), "g": F.col("gone"), "e": F.col("elsewhere")}
    done = map_arrow(joined, inputs, "text string, n_paragraphs bigint, n_words bigint", make, keep=["row", "gone", "from", "n"])
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{kind}>)"))
    return done.select(
        F.col("row.row").alias("row"), "text", none("row.gone", "int").alias("removed"), none("row.from", "bigint").alias("sources"),
        "n_paragraphs", F.coalesce("row.n", F.lit(0)).cast("bigint").alias("n_repeated"), "n_words",
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], repeated_passages=True)
    removed = F.size("removed").cast("bigint")
    return done.select("row.doc_id", "n_paragraphs", "n_repeated", removed.alias("n_removed"), F.col("n_words").alias("n_words_removed"), "removed", "sources", "text")
