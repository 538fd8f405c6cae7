"""Exact substring dedup: every byte covered by a long string that also starts elsewhere is removed.

1. Anchors. In every window of `length` bytes the window's least inner string hash is an anchor, so two equal windows have
   an equal anchor at the same place. Only anchors that occur twice can lie in a repeated string.
2. Classes. Anchors with equal surroundings (all windows that may hold the anchor) repeat as a whole: covered.
3. Suffix arrays. Where surroundings differ, windows are compared: the surroundings of an anchor's classes go to one shard,
   whose suffixes are sorted by induced sorting; windows with a common prefix of full length repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import frozen, map_arrow, table
from bundlewise.llm.paragraphs import doc_key
from bundlewise.llm.shingles import Rolling, mix
from bundlewise.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH = 400
#: Anchors in one bucket, surroundings in one shard, about; their numbers follow the corpus.
BUCKET, SHARD = 100_000, 8_000
#: An anchor with more distinct surroundings is too much for one shard; its windows are counted by hash instead.
MOST_CLASSES = 20_000
#: Tasks the shards are dealt over, at most; beyond it a task takes several shards in turn.
MOST_TASKS = 20_000


def inner_size(length: int) -> int:
    return max(1, length * 4 // 5)


def anchors(roll: Rolling, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the leftmost least inner string of each window of a text of n bytes."""
    h = roll.windows(inner_size(length))
    w = length - inner_size(length) + 1
    m = len(h) - w + 1
    if n < length or m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    top = np.uint64(2**64 - 1)
    blocks = -(-len(h) // w)
    x = np.concatenate([h, np.full(blocks * w - len(h), top)]).reshape(blocks, w)
    # the least of a window from the right part of one block and the left part of the next
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    # leftmost place of that value in each window: the next place at or after the window's start that holds it
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    spots = np.flatnonzero(np.isin(h, least[change]))
    order = np.lexsort((spots, h[spots]))
    value, spot = h[spots][order], spots[order]
    chosen = []
    for first, last in ((change, np.append(change[1:], m) - 1),):
        # a run of windows with one least value may move on to later places of it (repeating text)
        lo = _find(value, spot, least[first], first)
        hi = _find(value, spot, least[last], last)
        for a, b in zip(lo[lo != hi].tolist(), hi[lo != hi].tolist()):
            chosen.append(spot[a : b + 1])
        chosen.append(spot[lo])
    place = np.unique(np.concatenate(chosen))
    return place, h[place]


def _find(value: np.ndarray, spot: np.ndarray, want: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the first (value, spot) with the wanted value at or after a start; pairs are sorted."""
    begin = np.searchsorted(value, want)
    end = np.searchsorted(value, want, "right")
    if (end - begin == 1).all():
        return begin
    out = begin.copy()
    for k in np.flatnonzero(end - begin > 1).tolist():
        out[k] = begin[k] + np.searchsorted(spot[begin[k] : end[k]], start[k])
    return out


_ROW = "bucket int, a binary, c binary, doc binary, place binary, many binary, dks array<binary>, sure binary, at binary"
_ROW_NAMES = ["bucket", "a", "c", "doc", "place", "many", "dks", "sure", "at"]
_ROW_TYPES = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.binary()), pa.binary(), pa.binary()]
_FOUND = "kind int, dk binary, a bigint, n bigint, single boolean, places binary"
_FOUND_NAMES = ["kind", "dk", "a", "n", "single", "places"]
_FOUND_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _deal(dks: list[bytes], texts: list[bytes | None], length: int, buckets: int) -> pa.Table:
    """A batch's anchors by bucket of their hash. Surroundings that repeat within the batch are settled here (`sure` are
    texts, `at` places) and go out once, marked as many."""
    ext = length - inner_size(length)
    hs, cs, ds, ps = [], [], [], []
    for k, raw in enumerate(texts):
        n = len(raw or b"")
        if n < length:
            continue
        roll = Rolling(raw)
        place, h = anchors(roll, n, length)
        lo, hi = np.maximum(place - ext, 0), np.minimum(place + length, n)
        hs.append(h)
        cs.append(mix(roll.spans(lo, hi) + (place - lo).astype(np.uint64)))
        ds.append(np.full(len(h), k, np.int64))
        ps.append(place)
    rows: list[list] = [[] for _ in _ROW_NAMES]
    if hs:
        h, c, d, p = map(np.concatenate, (hs, cs, ds, ps))
        order = np.lexsort((c, h))
        h, c, d, p = h[order], c[order], d[order], p[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        edge = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(int(edge[b]), int(edge[b + 1]))
            texts_here, local = np.unique(d[s], return_inverse=True)
            out = new[s]
            values = (
                b, h[s][out].tobytes(), c[s][out].tobytes(), local[out].astype(np.int32).tobytes(), p[s][out].astype(np.int32).tobytes(),
                many[s][out].astype(np.int8).tobytes(), [dks[i] for i in texts_here.tolist()],
                local[many[s]].astype(np.int32).tobytes(), p[s][many[s]].astype(np.int32).tobytes(),
            )
            for r, v in zip(rows, values):
                r.append(v)
    return pa.table({c: pa.array(r, t) for c, r, t in zip(_ROW_NAMES, rows, _ROW_TYPES)})


def _settle(rows: pa.Table) -> pa.Table:
    """Of a bucket: covered anchors (kind 0: places by text) and classes to compare (kind 1: one place of each)."""
    read = lambda c, t: [np.frombuffer(x.as_py(), t) for x in rows.column(c)]
    of_row = rows.column("dks").to_pylist()
    dks = [x for r in of_row for x in r]
    base = np.cumsum([0, *map(len, of_row)])[:-1]
    a, c, place = (np.concatenate(read(n, t)) for n, t in (("a", np.uint64), ("c", np.uint64), ("place", np.int32)))
    many = np.concatenate(read("many", np.int8))
    doc = np.concatenate([x + b for x, b in zip(read("doc", np.int32), base)])
    sure = [np.concatenate([x + b for x, b in zip(read("sure", np.int32), base)])]
    at = [np.concatenate(read("at", np.int32))]
    order = np.lexsort((c, a))
    a, c, place, many, doc = a[order], c[order], place[order], many[order], doc[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
    group, kind = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
    times = np.bincount(kind, weights=1 + many)[kind]
    sure.append(doc[(times > 1) & (many == 0)])
    at.append(place[(times > 1) & (many == 0)])
    classes = np.bincount(group[new_c])[group]
    open_ = np.bincount(group, weights=times == 1)[group] > 0
    ask = new_c & (classes > 1) & open_
    doc_of, place_of = np.concatenate(sure), np.concatenate(at)
    order = np.argsort(doc_of, kind="stable")
    doc_of, place_of = doc_of[order], place_of[order]
    cut = np.flatnonzero(np.concatenate(([True], doc_of[1:] != doc_of[:-1]))) if len(doc_of) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(doc_of))
    k0, k1 = len(cut), int(ask.sum())
    keys = [dks[doc_of[x]] for x in cut.tolist()] + [dks[x] for x in doc[ask].tolist()]
    places = [place_of[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())] + [x.tobytes() for x in place[ask]]
    columns = (
        [0] * k0 + [1] * k1, keys, [0] * k0 + a[ask].view(np.int64).tolist(), [0] * k0 + classes[ask].tolist(),
        [False] * k0 + (times[ask] == 1).tolist(), places,
    )
    return pa.table({n: pa.array(v, t) for n, v, t in zip(_FOUND_NAMES, columns, _FOUND_TYPES)})


def repeated_windows(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], ext: int) -> list[np.ndarray]:
    """For each surrounding, how many bytes before its anchor the windows start that another one of its group has too.

    A surrounding is written as its left bytes, one symbol for the anchor and its right bytes; a window is any `ext` + 1
    symbols with the anchor's among them. The suffix array puts equal windows side by side.
    """
    _, group = np.unique(groups, return_inverse=True)
    left, right = np.fromiter(map(len, lefts), np.int64, len(lefts)), np.fromiter(map(len, rights), np.int64, len(rights))
    sizes = left + right + 2
    starts = np.concatenate(([0], np.cumsum(sizes)))
    text = np.empty(starts[-1] + 1, np.int64)
    filled = np.ones(len(text), bool)
    filled[starts[:-1] + left] = filled[starts[1:] - 1] = filled[-1] = False
    text[filled] = np.frombuffer(b"".join(x for p in zip(lefts, rights) for x in p), np.uint8).astype(np.int64) + 2
    text[starts[:-1] + left] = group + 258
    text[starts[1:] - 1] = 1
    text[-1] = 0
    order = suffix_array(text)
    shared = common_prefixes(text, order, starts[:-1], sizes, 1)
    # windows that hold the anchor: they start at most `ext` before it, and end within the surrounding
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = left[owner] - (np.arange(starts[-1]) - starts[owner])
    whole = (offset >= 0) & (offset <= ext) & (right[owner] >= ext - offset)
    hit = np.zeros(len(text), bool)
    close = np.flatnonzero(shared[order] > ext)  # as long as a window, with the suffix before in order
    hit[order[close]] = hit[order[close - 1]] = True
    found = np.flatnonzero(hit[:-1] & whole)
    cuts = np.searchsorted(owner[found], np.arange(len(sizes) + 1))
    return [offset[found[a:b]] for a, b in zip(cuts, cuts[1:])]


def _spans(place: int, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.sort(place - offsets)
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate(([0], cut + 1))], starts[np.append(cut, len(starts) - 1)] + length


def _shard(rows: pa.Table, length: int) -> pa.Table:
    """Windows of single classes that repeat within their group, as byte spans (lo, hi)."""
    ext = length - inner_size(length)
    place, single = rows.column("place").to_numpy(), rows.column("single").to_numpy(zero_copy_only=False)
    hits = repeated_windows(rows.column("a").to_numpy(), rows.column("l").to_pylist(), rows.column("r").to_pylist(), ext)
    dks = rows.column("dk")
    out: list[list] = [[], [], []]
    for k, offsets in enumerate(hits):
        if single[k] and len(offsets):
            lo, hi = _spans(int(place[k]), offsets, length)
            out[0].append(dks[k].as_py())
            out[1].append(lo.tolist())
            out[2].append(hi.tolist())
    return pa.table({"dk": pa.array(out[0], pa.binary()), "lo": pa.array(out[1], pa.list_(pa.int64())), "hi": pa.array(out[2], pa.list_(pa.int64()))})


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most_classes: int = MOST_CLASSES, shard: int = SHARD) -> DataFrame:
    """(dk, lo, hi): for each document with repeated strings, covered spans of its UTF-8 bytes, as arrays, in no order."""
    ext = length - inner_size(length)
    given = docs.select(doc_key(docs[doc_id], docs[text]).alias("dk"), docs[text].cast("binary").alias("t"))
    size = given.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    parallel = docs.sparkSession.sparkContext.defaultParallelism * 2
    buckets = int(min(max(-(-size * 2 // (ext + 2) // BUCKET), parallel), 1 << 20))

    def deal(batches):
        for batch in batches:
            yield from _deal(batch.column("dk").to_pylist(), batch.column("t").to_pylist(), length, buckets).to_batches()

    found = frozen(given.where(F.length("t") >= length).mapInArrow(deal, _ROW).groupBy("bucket").applyInArrow(_settle, _FOUND))
    asked = found.where("kind = 1")
    # anchors of one document only: as many as its length allows
    asked_of = asked.groupBy("dk").agg(F.collect_list(F.struct("a", "n", "single", "places")).alias("asks"))

    def surroundings(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for dk, raw, asks in zip(*[batch.column(c).to_pylist() for c in ("dk", "t", "asks")]):
                for x in asks:
                    p = int.from_bytes(x["places"], "little")
                    end = p + length - ext
                    for c, v in zip(cols, (dk, x["a"], p, x["n"], x["single"], raw[max(0, p - ext) : p], raw[end : end + ext])):
                        c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["dk", "a", "place", "n", "single", "l", "r"])

    around = given.join(asked_of, "dk").dropDuplicates(["dk"]).mapInArrow(surroundings, "dk binary, a bigint, place bigint, n bigint, single boolean, l binary, r binary")
    shards = int(max(-(-asked.count() // shard), 1))
    around = frozen(around)
    near = around.where(F.col("n") <= most_classes).withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    # a shard is work for a task, few bytes though it has
    near = near.repartition(min(shards, MOST_TASKS), "shard")
    spans = near.groupBy("shard").applyInArrow(lambda t: _shard(t, length), "dk binary, lo array<bigint>, hi array<bigint>")
    wide = around.where(F.col("n") > most_classes)
    if not wide.isEmpty():
        spans = spans.unionByName(_by_hash(wide, length))
    return _sure_spans(found.where("kind = 0"), length).unionByName(spans)


def _sure_spans(covered: DataFrame, length: int) -> DataFrame:
    """Places of covered anchors as spans; ends beyond a text are cut off when the spans are applied."""
    ext = length - inner_size(length)

    def make():
        def step(places):
            lo, hi = [], []
            for x in places.to_pylist():
                p = np.sort(np.frombuffer(x, np.int32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(p) > length + ext)
                lo.append(np.maximum(p[np.concatenate(([0], cut + 1))] - ext, 0).tolist())
                hi.append((p[np.append(cut, len(p) - 1)] + length).tolist())
            return lo, hi

        return step

    return map_arrow(covered, {"p": F.col("places")}, "lo array<bigint>, hi array<bigint>", make, keep=["dk"]).select("row.dk", "lo", "hi")


def _by_hash(wide: DataFrame, length: int) -> DataFrame:
    """The exact way for anchors with very many surroundings: every window's 128-bit hash, counted."""
    ext = length - inner_size(length)

    def windows(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for dk, a, p, single, l, r in zip(*[batch.column(c).to_pylist() for c in ("dk", "a", "place", "single", "l", "r")]):
                for back in range(max(0, ext - len(r)), min(ext, len(l)) + 1):
                    said = a.to_bytes(8, "little", signed=True) + bytes([back % 256, back // 256]) + l[len(l) - back :] + r[: ext - back]
                    for c, v in zip(cols, (hashlib.blake2b(said, digest_size=16).digest(), dk, p - back, single)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names=["w", "dk", "lo", "single"])

    each = wide.mapInArrow(windows, "w binary, dk binary, lo bigint, single boolean")
    twice = each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return each.where("single").join(twice, "w").select("dk", F.array("lo").alias("lo"), F.array(F.col("lo") + length).alias("hi"))


def union_of(lo: list[int], hi: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal runs covered by spans within 0..n."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi)):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: list[str] | None = None, **options) -> DataFrame:
    """Every row of `docs` without the bytes that a string of `length` bytes covers which also starts elsewhere.

    Result: `row` (the input row, or its columns in `keep`), `kept` (the remaining bytes), `spans` (removed runs, flat
    half-open byte offsets), `n_bytes`. "Elsewhere" is any other start, in the same document or another; all strings are
    judged on the input. Matches never cross documents.

    Null and empty texts have no bytes. A row that occurs twice repeats itself: both lose all strings of full length.
    Ids play no part but as identity, nulls included. An empty table gives an empty result. Work per task is bounded by
    batches, buckets of anchors and shards; an anchor everybody has is settled by counting.
    """
    found = find_spans(docs, doc_id, text, length, **options)
    by_doc = found.groupBy("dk").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    joined = docs.select(row, doc_key(docs[doc_id], docs[text]).alias("dk"), docs[text].cast("binary").alias("t")).join(by_doc, "dk", "left")

    def make():
        def step(texts, los, his):
            kept, spans, sizes = [], [], []
            for t, lo, hi in zip(texts.to_pylist(), los.to_pylist(), his.to_pylist()):
                t = t or b""
                runs = union_of(lo, hi, len(t)) if lo else []
                at, rest = 0, []
                for a, b in runs:
                    rest.append(t[at:a])
                    at = b
                kept.append(b"".join([*rest, t[at:]]))
                spans.append([x for r in runs for x in r])
                sizes.append(len(t))
            return kept, spans, sizes

        return step

    done = map_arrow(joined, {"t": F.col("t"), "lo": F.col("lo"), "hi": F.col("hi")}, "kept binary, spans array<bigint>, n_bytes bigint", make, keep=["row"])
    return done.select(F.col("row.row").alias("row"), "kept", "spans", "n_bytes")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_bytes(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.floor(F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
