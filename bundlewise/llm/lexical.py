"""Ranked lexical search: item weights times document impacts as dense blocked matrix products, exact in float64.

Scores are whole numbers. An item tile (some items over their own compact vocabulary) is multiplied with a tile of
documents by BLAS; no tile holds more terms than keep every partial sum below 2^53, so the products are exact in whatever
order BLAS adds them up, and partial sums of several vocabulary tiles are added as 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlewise.llm.common import stored, table

K = 10
#: Characters of item text handled in one scan over the documents; more items are handled in blocks of about this size.
BLOCK_CHARS = 8_000_000
#: Items of a tile, and terms of a vocabulary tile at most (fewer where the bound on partial sums asks for it).
ITEM_TILE, VOCAB_TILE = 64, 4096
#: Impacts are below this: 10^9 tf / (1000 tf + 8 m) with m > 0.
MAX_IMPACT = 1_000_000
#: Partial lists of an item are merged in so many groups first.
MERGE_GROUPS = 64
#: A long text is cut into words by pieces of about this many bytes.
PIECE = 1 << 20

# byte -> byte: A-Z to a-z; ASCII letters, digits and the bytes of non-ASCII characters stay; the rest parts terms
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a piece of it at a time."""
    flat, at = text.translate(TERM_BYTES), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def postings(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms per text, and for each occurring pair: text number, vocabulary number, occurrences)."""
    get, size = vocabulary.get, max(len(vocabulary), 1)
    n = np.zeros(len(texts), np.int64)
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for k, text in enumerate(texts):
        for run in term_runs(text):
            n[k] += len(run)
            found = np.fromiter((i for i in map(get, run) if i is not None), np.int64)
            if len(found):
                terms, times = np.unique(found, return_counts=True)
                keys.append(terms + k * size)
                counts.append(times)
    if not keys:
        none = np.zeros(0, np.int64)
        return n, none, none, none
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(place, weights=np.concatenate(counts).astype(float)).astype(np.int64)
    return n, key // size, key % size, tf


@dataclass
class ItemTile:
    """Some items over the vocabulary numbers `terms`; `cells` are (item, place in `terms`, weight)."""

    first: int
    items: int
    terms: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    weights: np.ndarray


def vocabulary_step(most: int) -> int:
    """Terms of one tile so that a sum of so many products of weight and impact stays below 2^53."""
    return max(1, min(VOCAB_TILE, ((1 << 53) - 1) // (max(most, 1) * MAX_IMPACT)))


def item_tiles(items: list[np.ndarray], weights: np.ndarray) -> list[ItemTile]:
    """Tiles of items (arrays of vocabulary numbers) and of their compact vocabularies."""
    step = vocabulary_step(int(weights.max(initial=0)))
    out = []
    for first in range(0, len(items), ITEM_TILE):
        part = items[first : first + ITEM_TILE]
        owners = np.repeat(np.arange(len(part)), [len(t) for t in part])
        flat = np.concatenate(part) if part else np.zeros(0, np.int64)
        live = weights[flat] > 0
        owners, flat = owners[live], flat[live]
        terms = np.unique(flat)
        for lo in range(0, len(terms), step):
            own = terms[lo : lo + step]
            inside = (flat >= own[0]) & (flat <= own[-1])
            out.append(ItemTile(first, len(part), own, owners[inside], np.searchsorted(own, flat[inside]), weights[flat[inside]].astype(float)))
    return out


class Best:
    """The k best documents of each item so far: higher scores first, then lower ids, a null id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.kept: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, first: int, scores: np.ndarray, ids: list) -> None:
        """Scores (items x documents) of items from number `first` on. Ties with the last place are looked at too."""
        reached = scores >= self.floor[first : first + len(scores), None]
        for i in np.flatnonzero(reached.any(axis=1)):
            at = np.flatnonzero(reached[i])
            if len(at) > self.k:
                bar = np.partition(scores[i, at], len(at) - self.k)[len(at) - self.k]
                at = at[scores[i, at] >= bar]  # all that tie with the k-th
            found = [(-int(scores[i, d]), ids[d] is None, ids[d]) for d in at]
            kept = sorted(self.kept[first + i] + found, key=lambda x: x[:2] if x[1] else x)[: self.k]
            self.kept[first + i] = kept
            if len(kept) == self.k:
                self.floor[first + i] = -kept[-1][0]


def search_block(
    docs: DataFrame, items: list[tuple[int, bytes]], k: int, size: tuple[int, int] | None
) -> tuple[DataFrame | None, tuple[int, int]]:
    """Partial results (`item`, `doc`, `score`, `part`) for one block of items, and (documents with terms, their terms)."""
    vocabulary: dict[bytes, int] = {}
    sets = []
    for _, text in items:
        own = {t for run in term_runs(text) for t in run}
        sets.append(np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in sorted(own)), np.int64))

    def count(batches):
        df = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            n, _, term, _ = postings([t or b"" for t in batch.column("t").to_pylist()], vocabulary)
            df[:-2] += np.bincount(term, minlength=len(vocabulary))
            df[-2] += int((n > 0).sum())
            df[-1] += int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "n"])

    # one row for each term of the block at most
    counted = docs.select("t").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in counted}
    n_docs, n_terms = size or (found.get(len(vocabulary), 0), found.get(len(vocabulary) + 1, 0))
    weights = np.zeros(max(len(vocabulary), 1), np.int64)
    for term, df in found.items():
        if term < len(vocabulary):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    tiles = item_tiles(sets, weights)
    if not tiles or not n_terms:
        return None, (n_docs, n_terms)
    numbers = np.array([i for i, _ in items], np.int64)
    id_type = docs.schema["doc"].dataType

    def scan(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        best = Best(len(numbers), k)
        for batch in batches:
            n, doc, term, tf = postings([t or b"" for t in batch.column("t").to_pylist()], vocabulary)
            m = np.array([10 + (90 * int(x) * n_docs) // n_terms for x in n], np.int64)
            impact = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])).astype(float)
            ids = batch.column("doc").to_pylist()
            scores, of = None, -1
            place = np.full(len(vocabulary), -1, np.int64)
            for tile in tiles:
                if tile.first != of:
                    if scores is not None:
                        best.offer(of, scores, ids)
                    scores, of = np.zeros((tile.items, len(n)), np.int64), tile.first
                place[tile.terms] = np.arange(len(tile.terms))
                at = place[term]
                place[tile.terms] = -1
                here = at >= 0
                right = np.zeros((len(tile.terms), len(n)))
                right[at[here], doc[here]] = impact[here]
                left = np.zeros((tile.items, len(tile.terms)))
                left[tile.rows, tile.places] = tile.weights
                scores += (left @ right).astype(np.int64)
            if scores is not None:
                best.offer(of, scores, ids)
        rows = [(int(numbers[i]), x[2], -x[0]) for i, kept in enumerate(best.kept) for x in kept]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], to_arrow_type(id_type)),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64())],
            names=["item", "doc", "score", "part"],
        )

    return docs.mapInArrow(scan, f"item bigint, doc {id_type.simpleString()}, score bigint, part bigint"), (n_docs, n_terms)


def rank(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = K, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The `k` documents with the highest score above 0 of each item: `item_id, rank, doc_id, score`.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Two scans over whole texts for each
    block of items (document frequencies, then scores); only a block's vocabulary and the k best of each task travel.
    A block holds about `block_chars` characters of item text and is the only thing held by the driver or broadcast.

    Nulls and empty texts: no terms, so no rows. Each row of `items` is an item with a list of its own, also where ids
    repeat; each row of `docs` is a document. Equal scores: lower doc_id first, a null id last. Empty tables: no rows.
    """
    spark = docs.sparkSession
    given = docs.select(docs[doc_id].alias("doc"), docs[text].cast("binary").alias("t"))
    asked = stored(
        items.select(items[item_id].alias("item_id"), items[item_text].cast("binary").alias("t")).withColumn("item", F.monotonically_increasing_id())
    )
    n_chars = asked.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-n_chars // block_chars))
    found, size = None, None
    for b in range(n_blocks):
        # terms of long blocks differ in number only by chance: items are dealt by a hash
        block = asked.where("t is not null").where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
        rows = [(r["item"], bytes(r["t"])) for r in block.select("item", "t").orderBy("item").collect()]
        part, size = search_block(given, rows, k, size) if rows else (None, size)
        if part is not None:
            if n_blocks > 1:
                part = stored(part)
            found = part if found is None else found.unionByName(part)
    if found is None:
        kind = given.schema["doc"].dataType.simpleString()
        found = spark.createDataFrame([], f"item bigint, doc {kind}, score bigint, part bigint")
    best = [F.desc("score"), F.asc_nulls_last("doc")]
    # a list from each task: merged in groups first, so no item gathers the lists of all tasks at once
    groups = Window.partitionBy("item", F.pmod("part", F.lit(MERGE_GROUPS))).orderBy(*best)
    short = found.withColumn("_r", F.row_number().over(groups)).where(F.col("_r") <= k).drop("_r", "part")
    short = short.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    return short.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same ranking from postings and joins.
OP11_SQL = r"""
with t as (
  select doc_id, row_number() over () as rid, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from documents
), q as (
  select distinct qid, item_id, unnest(w) as term from (
    select item_id, row_number() over () as qid, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
    from benchmark)
), c as (
  select cast(count(*) as bigint) as docs, cast(sum(len(w)) as bigint) as terms from t where len(w) > 0
), p as (
  select rid, term, cast(count(*) as bigint) as tf from (select rid, unnest(w) as term from t) group by rid, term
), f as (
  select term, count(*) as df from p where term in (select term from q) group by term
), g as (
  select f.term, cast(floor(1000 * ln((2 * c.docs + 2) / (2 * f.df + 1))) as bigint) as weight from f, c
), m as (
  select rid, doc_id, 100 - 90 + (90 * cast(len(w) as bigint) * c.docs) // c.terms as m from t, c where len(w) > 0
), s as (
  select q.qid, q.item_id, m.doc_id, m.rid, cast(sum(g.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) as bigint) as score
  from q join g on q.term = g.term join p on p.term = q.term join m on m.rid = p.rid group by q.qid, q.item_id, m.doc_id, m.rid
), r as (
  select item_id, cast(row_number() over (partition by qid order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0
)
select item_id, rank, doc_id, score from r where rank <= 10
"""
