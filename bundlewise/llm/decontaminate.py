"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import map_arrow, stored, table

WINDOW = 10
#: Characters of item text in one automaton; larger benchmarks are scanned in blocks of about this size.
BLOCK_CHARS = 8_000_000

# byte -> byte: A-Z to a-z, ASCII letters and digits and all bytes of non-ASCII characters stay, the rest is a gap
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def item_windows(text: bytes, window: int) -> set[str]:
    """Windows of an item as text with one blank around each word; a shorter item is one window."""
    w = text.translate(FOLD).decode("latin-1").split(" ")
    w = [x for x in w if x]
    if not w:
        return set()
    return {f" {' '.join(w[i : i + window])} " for i in range(max(1, len(w) - window + 1))}


def automaton(items: list[tuple[str, bytes]], window: int):
    """Automaton whose values are (words in the window, ids of the items that have it); None without windows."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in item_windows(text, window):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w, (w.count(" ") - 1, ids))
    found.make_automaton()
    return found


def scan(text: bytes, found) -> tuple[int, list[int], set[str]]:
    """Words of a text, hit words as flat [first, last) pairs, items with an occurring window."""
    w = [x for x in text.translate(FOLD).split(b" ") if x]
    if not w or found is None:
        return len(w), [], set()
    flat = b" " + b" ".join(w) + b" "
    items: set[str] = set()
    edge = None
    for end, (size, ids) in found.iter(flat.decode("latin-1")):
        if edge is None:
            blanks = np.cumsum(np.frombuffer(flat, np.uint8) == 32)
            edge = np.zeros(len(w) + 1, np.int64)
        last = int(blanks[end]) - 1  # the blank that ends word number last - 1
        edge[last - size] += 1
        edge[last] -= 1
        items |= ids
    if edge is None:
        return len(w), [], items
    hit = np.concatenate(([0], np.cumsum(edge)[:-1] > 0, [0])).astype(np.int8)
    turns = np.flatnonzero(np.diff(hit))
    return len(w), turns.tolist(), items


def byte_spans(text: bytes, spans: list[int]) -> list[int]:
    """Word spans as offsets into the UTF-8 bytes of the original text."""
    if not spans:
        return []
    part = np.concatenate(([0], np.frombuffer(text.translate(FOLD), np.uint8) != 32, [0])).astype(np.int8)
    turn = np.diff(part)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return [int(starts[x]) if k % 2 == 0 else int(ends[x - 1]) for k, x in enumerate(spans)]


def _union(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return list(a or b)
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """(whether another follows, items) of each block of about `block_chars`; a block is fetched when it is asked for."""
    given = items.select(items[item_id].cast("string").alias("i"), items[text].cast("binary").alias("t")).where("i is not null and t is not null")
    total = given.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = given.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else given
        yield k < n - 1, [(r["i"], bytes(r["t"])) for r in part.collect()]


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None,
) -> DataFrame:
    """Mark the words of each text that lie in a window of `window` consecutive words of a test item.

    Result: `row` (the input row, or its columns in `keep`), `n_words`, `word_spans` and `byte_spans` (flat, half-open,
    merged), `items` (sorted ids). No shuffle: texts stream once past an automaton per block of items. One block suits
    all but huge benchmarks; a block is the only thing broadcast, and its size is bounded by `block_chars`. With several
    blocks what one has found is written to the shared folder before the next is fetched, so that driver and tasks hold
    one block at a time, however large the benchmark is.

    Nulls: a null text has no words; a null item text or id gives no window. Empty text: no words. An empty items table
    marks nothing. Repeated rows are each marked; repeated items count once per distinct id.
    """
    out = None
    for more, block in item_blocks(items, item_id, item_text, block_chars):
        carried = {"spans": "spans", "items": "items"} if out is not None else {}

        def make(block=block):
            found = automaton(block, window)

            def step(texts, spans=None, ids=None):
                n, marked, names, places = [], [], [], []
                old = spans.to_pylist() if spans is not None else None
                had = ids.to_pylist() if ids is not None else None
                for k, t in enumerate(texts):
                    raw = t.as_py() or b""
                    size, s, i = scan(raw, found)
                    if old is not None:
                        s, i = _union(old[k], s), i | set(had[k])
                    n.append(size)
                    marked.append(s)
                    names.append(sorted(i))
                    places.append(byte_spans(raw, s))
                return n, marked, names, places

            return step

        schema = "n_words bigint, spans array<int>, items array<string>, places array<int>"
        if out is None:
            # the text travels beside the row only while blocks remain
            source = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), docs[text].cast("binary").alias("t"))
            out = map_arrow(source, {"t0": source["t"]}, schema, make, keep=["row", "t"] if more else ["row"])
        else:
            out = map_arrow(out, {"t0": out["row.t"], **{k: out[v] for k, v in carried.items()}}, schema, make, keep=["row"])
            out = out.withColumn("row", F.col("row.row"))
        if more:
            out = stored(out)
    return out.select(F.col("row.row").alias("row"), "n_words", F.col("spans").alias("word_spans"), F.col("places").alias("byte_spans"), "items")


def span_words(spans: str = "word_spans"):
    """Words covered by flat spans."""
    at = F.sequence(F.lit(0), F.size(spans) - 1)
    signed = F.transform(at, lambda k: F.element_at(F.col(spans), k + 1) * F.when(k % 2 == 0, -1).otherwise(1))
    return F.when(F.size(spans) > 0, F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs, items, keep=["doc_id"]).select(
        "row.doc_id",
        "n_words",
        span_words().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("word_spans") > 0).alias("contaminated"),
    )


#: One statement for the digest: windows of items met by equality with the 10-word windows (and shorter items) of texts.
OP8_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w, row_number() over () as rid
  from documents
), b as (
  select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
  from benchmark where text is not null and item_id is not null
), win as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), spot as (
  select d.rid, d.i, s.size, array_to_string(d.w[d.i:d.i + s.size - 1], ' ') as win
  from (select rid, w, unnest(range(1, len(w) + 1)) as i from w) d, (select distinct size from win) s
  where d.i + s.size - 1 <= len(d.w)
), hit as (select a.rid, a.i, a.size, win.item from spot a join win on a.size = win.size and a.win = win.win
), n as (
  select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + size)) as p from hit) group by rid
), it as (
  select rid, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as ids from hit group by rid
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items,
  sha256(coalesce(it.ids, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 as contaminated
from w left join n on w.rid = n.rid left join it on w.rid = it.rid
"""
