"""N-gram Jaccard join of documents: links between texts whose sets of word shingles overlap, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm import linking
from bundlewise.llm.common import frozen, lower_ascii, map_arrow, table, words
from bundlewise.llm.shingles import key_of, shingle_sets, words_of

SIZE, PERCENT = 5, 80
#: Shingles that make up at least this share of all prefix shingles rank last; there can be no more than its inverse.
FREQUENT = 1 / 50_000


def slack(n: int) -> int:
    """Shared shingles a set must show in its prefix; longer prefixes make the test sharper."""
    return max(1, n // 10)


def prefix_length(n: int, percent: int) -> int:
    """In any order of shingles, two sets with enough in common share `slack` of their first so many."""
    return min(n, n - -(-n * percent // 100) + slack(n))


def expected(n: int, percent: int) -> int:
    """Shared prefix shingles any partner is sure to give, the smallest one too."""
    return slack(-(-n * percent // 100))


def describe(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, x, key, k1, n_shingles): a hash of the text, the 128-bit key of the word sequence, its first half, and the size of
    the shingle set."""

    def make():
        def step(texts):
            w = [words_of(x) for x in texts.to_pylist()]
            keys = [key_of(x) for x in w]
            whole = [b"".join(x.to_bytes(8, "little", signed=True) for x in k) for k in keys]
            return whole, [k[0] for k in keys], [len(s) for s in shingle_sets(w, size)]

        return step

    given = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("binary").alias("t"))
    given = given.withColumn("x", F.xxhash64("t"))
    done = map_arrow(given, {"t": given["t"]}, "key binary, k1 bigint, n_shingles bigint", make, keep=["doc_id", "x"])
    return done.select("row.doc_id", "row.x", "key", "k1", "n_shingles")


def candidates(docs: DataFrame, text: str, total: int, size: int, percent: int) -> DataFrame:
    """(kind, key, n): shared prefix shingles by text (kind 0), and frequent shingles with their entries (kind 1)."""

    def post(texts: list[bytes | None]):
        w = [words_of(x) for x in texts]
        for own, s in zip(w, shingle_sets(w, size)):
            yield key_of(own)[0], s[: prefix_length(len(s), percent)]

    return linking.shared_keys(docs.select(docs[text].cast("binary").alias("t")), post, total, max(32, int(total * FREQUENT)))


def rare_first(sets: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(h, id): the prefixes of `sets` in the order of frequency, for sets that may have a partner.

    Each set learns how many sets have its shingles; the frequent ones, known already, stay out of that shuffle, so no
    shingle in it has very many owners. A set with too few shared shingles has no partner. Of the others the shingles of
    their own come first, then rare ones, then frequent ones: few sets meet by chance, in a common passage, say.
    """
    total = sets.agg(F.sum("size").alias("n")).first()["n"] or 0
    parallel = sets.sparkSession.sparkContext.defaultParallelism * 2
    buckets, dests = max(min(-(-total // linking.BUCKET), 1 << 20), parallel), linking.destinations(total, parallel)
    packed = "bucket int, hs binary, ids binary"

    def deal(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column("elements").to_pylist()]
            h = np.concatenate(own) if own else np.zeros(0, np.uint64)
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in own])
            if len(frequent):
                rare = ~np.isin(h, frequent)
                h, ids = h[rare], ids[rare]
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            edge = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edge)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([h[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()),
                 pa.array([ids[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())],
                names=["bucket", "hs", "ids"],
            )

    def read(rows: pa.Table, *kinds) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), t) for c, t in kinds]

    def shared(rows: pa.Table) -> pa.Table:
        """What a bucket knows of its shared shingles, a row per destination of their owners."""
        h, ids = read(rows, ("hs", np.uint64), ("ids", np.int64))
        _, group, times = np.unique(h, return_inverse=True, return_counts=True)
        times = times[group].astype(np.int32)
        h, ids, times = h[times > 1], ids[times > 1], times[times > 1]
        order, parts = linking.by_destination(ids, dests)
        h, ids, times = h[order], ids[order], times[order]
        columns = [[d for d, _, _ in parts], *[[x[a:z].tobytes() for _, a, z in parts] for x in (h, ids, times)]]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("dest", "hs", "ids", "times"), columns, (pa.int32(), *[pa.binary()] * 3))})

    def owners(rows: pa.Table) -> pa.Table:
        """The shared shingles of each set, rare ones first."""
        h, ids, times = read(rows, ("hs", np.int64), ("ids", np.int64), ("times", np.int32))
        order = np.lexsort((h, times, ids))
        h, ids = h[order], ids[order]
        cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(ids)).tolist()
        return pa.table({"id": pa.array(ids[cut], pa.int64()), "hs": pa.array([h[x:y].tobytes() for x, y in zip(cut.tolist(), ends)], pa.binary())})

    found = sets.select("id", "elements").mapInArrow(deal, packed).groupBy("bucket").applyInArrow(shared, "dest int, hs binary, ids binary, times binary")
    known = found.groupBy("dest").applyInArrow(owners, "id bigint, hs binary")

    def make():
        def step(sizes, often, shared):
            out = []
            for n, last, packed in zip(sizes.to_pylist(), often.to_pylist(), shared.to_pylist()):
                h = np.frombuffer(packed or b"", np.int64)
                need = -(-n * percent // 100)
                alone = n - len(h) - len(last)
                lead = np.concatenate([h, np.array(last, np.int64)])
                out.append(lead[: max(n - need + 1 - alone, 0)])
            return (pa.array(out, pa.list_(pa.int64())),)

        return step

    asked = sets.select("id", "size", "often").join(known, "id", "left")
    leads = map_arrow(asked, {"n": F.col("size"), "o": F.col("often"), "s": F.col("hs")}, "lead array<bigint>", make, keep=["id"])
    return frozen(leads.select(F.explode("lead").alias("h"), F.col("row.id").alias("id")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, n_links (documents linked directly).

    1. Equal word sequences are one class with an id of its own; only classes are compared.
    2. Candidates: each class posts the shingles of its prefix (least hashes first). A class with a partner is sure to
       share a known number of them; the others, nearly all of a normal corpus, are done. Packed prefixes are all that
       is shuffled, and a shingle that is everywhere costs one entry per batch of texts.
    3. Candidates learn how frequent their shingles are, and post prefixes of the rarest (see `rare_first`). Sets with a
       posted shingle in common form families, which are searched by T-occurrence (see `linking`). Exact: the prefix
       rules lose no pair.

    Nulls: a null text has no words, its set is empty and it is linked with nothing; a null doc_id has a null
    component_id and is not linked. Texts without words link with nothing, not with each other. Repeated rows are links
    of one another, rows of one id with different texts are documents of their own. An empty table gives an empty result.
    """
    about = frozen(describe(docs, doc_id, text, size))
    lead = [F.min("doc_id").alias("lead"), F.min_by("x", "doc_id").alias("x")]
    classes = about.where("n_shingles > 0 and doc_id is not null").groupBy("key", "k1").agg(*lead, F.count("*").alias("weight"), F.max("n_shingles").alias("size"))
    classes = frozen(classes.withColumn("id", F.monotonically_increasing_id()))
    total = about.agg(F.sum((F.col("n_shingles") * (100 - percent) / 100 + F.col("n_shingles") / 10 + 1).cast("bigint")).alias("s")).first()["s"] or 0
    counted = frozen(candidates(docs, text, total, size, percent))
    smallest = F.ceil(F.col("size") * percent / 100)
    sure = F.greatest(F.lit(1), F.floor(smallest / 10))
    shared = counted.where("kind = 0").select(F.col("key").alias("k1"), F.col("n").alias("shared"))
    chosen = classes.join(shared, "k1").where(F.col("shared") >= sure).select("id", "lead", "x", "key", "weight")
    frequent = np.sort(np.array([r["key"] for r in counted.where("kind = 1").select("key").collect()], np.int64).view(np.uint64))  # at most 1 / FREQUENT

    given = docs.select(docs[doc_id].cast("bigint").alias("lead"), docs[text].cast("binary").alias("t")).withColumn("x", F.xxhash64("t"))

    def make():
        def step(texts):
            sets = shingle_sets([words_of(x) for x in texts.to_pylist()], size)
            often = [s[np.isin(s, frequent)].view(np.int64) if len(frequent) else np.zeros(0, np.int64) for s in sets]
            return [len(s) for s in sets], [s.tobytes() for s in sets], often

        return step

    # one text of each class; the join has dealt the rows out by its columns, so this shuffles nothing
    sequence = F.unhex(F.md5(F.concat_ws(" ", words(lower_ascii(F.col("t").cast("string"))))))
    taken = given.join(chosen, ["lead", "x"]).where(sequence == F.col("key")).dropDuplicates(["lead", "x", "id"])
    sets = frozen(map_arrow(taken, {"t": F.col("t")}, "size bigint, elements binary, often array<bigint>", make, keep=["id", "weight"]).select("row.id", "row.weight", "size", "elements", "often"))
    linked = linking.link(sets.drop("often"), rare_first(sets, frequent, percent), percent)
    member = classes.join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = member.groupBy("root").agg(F.min("lead").alias("component_id"))
    known = member.join(least, "root").select("key", "component_id", "weight", F.coalesce("n_links", F.lit(0)).alias("n"))
    out = about.join(known, "key", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n") + F.col("weight") - 1).cast("bigint").alias("n_links"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), sh as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from sh group by doc_id
), link as (
  select a.doc_id as x, b.doc_id as y from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce((select min(y) from reach r where r.x = w.doc_id), w.doc_id)) as component_id,
  (select count(*) from link l where l.x = w.doc_id) as n_links
from w left join n on n.doc_id = w.doc_id
"""
