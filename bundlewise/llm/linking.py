"""Links between sets and their connected components, on shuffles of bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewise.llm.common import frozen
from bundlewise.llm.shingles import mix

#: Set elements on one side of a search task; larger families are searched in tiles.
TILE = 400_000
#: Hashes in one bucket of the search for shared ones, about; the number of buckets follows the corpus.
BUCKET = 250_000
#: Entries a bucket's findings are summed from in one task, about; destinations follow the corpus too.
ENTRIES, MOST_DESTINATIONS = 2_000_000, 1 << 16


def destinations(total: int, least: int) -> int:
    return max(min(-(-total // ENTRIES), MOST_DESTINATIONS), least)


def by_destination(key: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of `key` by destination, and (destination, from, to) of those that get some."""
    at = (mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(n + 1, dtype=np.uint64)).tolist()
    return order, [(d, edge[d], edge[d + 1]) for d in range(n) if edge[d] < edge[d + 1]]


def _bucket_rows(posted: Iterable[tuple[int, np.ndarray]], buckets: int) -> pa.Table:
    """A batch's posted hashes by bucket: (bucket, singles, owners, multi, local key, local count).

    A hash that several owners of the batch have is shared for sure: those owners are counted here, and the hash goes
    out once, without owners. So a hash everybody has costs one entry a batch.
    """
    own: dict[int, np.ndarray] = {}
    for k, s in posted:
        if len(s):
            own.setdefault(k, s)
    kept = [(s, k) for k, s in own.items()]
    if not kept:
        return pa.table({c: pa.array([], t) for c, t in _BUCKET_COLUMNS})
    h = np.concatenate([s for s, _ in kept])
    owner = np.repeat(np.arange(len(kept)), [len(s) for s, _ in kept])
    key = np.array([k for _, k in kept], np.int64)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(first) - 1
    shared = np.bincount(group)[group] > 1
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # sorted, as h is
    edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows: dict[str, list] = {c: [] for c, _ in _BUCKET_COLUMNS}
    for b in np.unique(bucket).tolist():
        a, z = int(edge[b]), int(edge[b + 1])
        s, o, hb = shared[a:z], owner[a:z], h[a:z]
        texts, times = np.unique(o[s], return_counts=True)
        rows["bucket"].append(int(b))
        rows["singles"].append(hb[~s].tobytes())
        rows["owners"].append(key[o[~s]].tobytes())
        rows["multi"].append(hb[s & first[a:z]].tobytes())
        rows["local"].append(key[texts].tobytes())
        rows["times"].append(times.astype(np.int64).tobytes())
    return pa.table({c: pa.array(rows[c], t) for c, t in _BUCKET_COLUMNS})


_BUCKET_COLUMNS = [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("singles", "owners", "multi", "local", "times")]]
_BUCKET_DDL = "bucket int, singles binary, owners binary, multi binary, local binary, times binary"


def _joined(rows: pa.Table, c: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), kind)


_COUNTED = [("dest", pa.int32()), *[(c, pa.binary()) for c in ("keys", "counts", "often", "times")]]
_COUNTED_DDL = "dest int, keys binary, counts binary, often binary, times binary"


def _count_bucket(rows: pa.Table, least: int, dests: int) -> pa.Table:
    """(dest, keys, counts, often, times), packed, a row per destination: shared hashes by owner, and hashes with at least
    `least` entries."""
    single, owner, multi = _joined(rows, "singles", np.uint64), _joined(rows, "owners", np.int64), _joined(rows, "multi", np.uint64)
    order = np.lexsort((owner, single))
    single, owner = single[order], owner[order]
    # an owner met in several batches (exact copies) is one
    if len(single):
        new = np.concatenate(([True], (single[1:] != single[:-1]) | (owner[1:] != owner[:-1])))
        single, owner = single[new], owner[new]
    several = np.unique(multi)
    values, group, times = np.unique(single, return_inverse=True, return_counts=True)
    shared = (times > 1) | np.isin(values, several)
    keys = [owner[shared[group]], _joined(rows, "local", np.int64)]
    weights = np.concatenate([np.ones(len(keys[0]), np.int64), _joined(rows, "times", np.int64)])
    key, count = _summed(np.concatenate(keys), weights)
    every, times = np.unique(np.concatenate([_joined(rows, "singles", np.uint64), np.repeat(multi, 2)]), return_counts=True)
    often, times = every[times >= least], times[times >= least].astype(np.int64)
    packed: dict[int, list[bytes]] = {}
    for first, (k, v) in ((0, (key, count)), (2, (often.view(np.int64), times))):
        order, parts = by_destination(k, dests)
        k, v = k[order], v[order]
        for d, a, z in parts:
            packed.setdefault(d, [b""] * 4)[first : first + 2] = [k[a:z].tobytes(), v[a:z].tobytes()]
    columns = [list(packed), *[[x[c] for x in packed.values()] for c in range(4)]]
    return pa.table({c: pa.array(x, t) for x, (c, t) in zip(columns, _COUNTED)})


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=weight, minlength=len(key)).astype(np.int64)


def _sum_destination(rows: pa.Table) -> pa.Table:
    """(kind, key, n): shared hashes by owner (kind 0), and hashes with many entries (kind 1)."""
    key, count = _summed(_joined(rows, "keys", np.int64), _joined(rows, "counts", np.int64))
    often, times = _joined(rows, "often", np.int64), _joined(rows, "times", np.int64)
    kind = np.repeat(np.array([0, 1], np.int32), [len(key), len(often)])
    return pa.table({"kind": kind, "key": np.concatenate([key, often]), "n": np.concatenate([count, times])})


def shared_keys(given: DataFrame, post: Callable[[list], Iterable[tuple[int, np.ndarray]]], total: int, least: int) -> DataFrame:
    """Find the hashes that more than one owner posts: (kind, key, n) as `_sum_destination` gives them, keys distinct.

    `given` has one column; `post` yields (owner, distinct hashes) from the values of a batch. About `total` hashes are
    posted, which sets the number of buckets. The first shuffle carries packed hashes and owners, 16 bytes each. An owner's
    hashes scatter over the buckets, so what a bucket finds goes out packed too, a row per destination, and is summed there.
    """
    parallel = given.sparkSession.sparkContext.defaultParallelism * 2
    buckets = max(min(-(-total // BUCKET), 1 << 20), parallel)
    dests = destinations(total, parallel)

    def deal(batches):
        for batch in batches:
            yield from _bucket_rows(post(batch.column(0).to_pylist()), buckets).to_batches()

    counted = given.mapInArrow(deal, _BUCKET_DDL).groupBy("bucket").applyInArrow(lambda t: _count_bucket(t, least, dests), _COUNTED_DDL)
    return counted.groupBy("dest").applyInArrow(_sum_destination, "kind int, key bigint, n bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every id in `edges` (a, b): root is the least id that links reach.

    Alternating stars: each round points the neighbours of an id at the least of them, first the larger ones, then the
    smaller ones, until every component is a star. Minima are combined before the shuffle and joins on a busy id are
    joins Spark may split, so no component is gathered anywhere.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    now = frozen(at.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        after = frozen(small(large(now)))
        said = mark(after)
        now = after
        if said == seen:
            break
        seen = said
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return members.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def families(postings: DataFrame) -> DataFrame:
    """(id, root): ids joined by a common key of `postings` (h, id), through the least id of each key."""
    lead = postings.groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last")
    return components(postings.join(lead, "h").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())


def search(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = 80) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of sets with 100 * intersection >= percent * union, as (i, partners after i); by T-occurrence search.

    With `side`, which splits the sets in two, only pairs across are wanted. Sets are taken by size: the partners
    of one set are no smaller than it and have at least T elements in common with it. Of its inverted lists the L longest
    are set aside. The short ones are merged, and only sets that occur T - L times in them can reach T; the long lists are
    probed for those by binary search (DivideSkip). Partners are handed over set by set, as all pairs of a large family
    are too many to hold.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(size, kind="stable")
    size = size[order]
    across = side is not None
    side = side[order] if across else None
    flat = np.concatenate([sets[k] for k in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    posting = owner[by]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(token)))) if len(token) else np.zeros(1, np.int64)
    starts = np.concatenate(([0], np.cumsum(size)))
    for q in range(n):
        m = int(size[q])
        upto = int(np.searchsorted(size, m * 100 // percent, "right"))  # larger sets have too large a union
        if not m or upto <= q + 1:
            continue
        need = -(-2 * m * percent // (100 + percent))  # T for a partner of the same size; larger ones need more
        mine = token[starts[q] : starts[q + 1]]
        lo, hi = bounds[mine], bounds[mine + 1]
        many = hi - lo > 1
        if many.sum() < need:
            continue
        lo, hi = lo[many], hi[many]
        rank = np.argsort(hi - lo, kind="stable")
        lo, hi = lo[rank], hi[rank]
        longest = int(hi[-1] - lo[-1])
        aside = min(need - 1, int(need / (0.1 * np.log2(longest + 1) + 1)))
        cut = len(lo) - aside
        # merge of the short lists: equal set numbers are counted together
        merged = np.concatenate([posting[a:b] for a, b in zip(lo[:cut].tolist(), hi[:cut].tolist())])
        merged = merged[(merged > q) & (merged < upto)]
        if not len(merged):
            continue
        times = np.bincount(merged - q - 1, minlength=upto - q - 1)
        near = np.flatnonzero(times >= need - aside)
        if across:
            near = near[side[near + q + 1] != side[q]]
        count = times[near]
        near = near + q + 1
        for a, b in zip(lo[cut:].tolist(), hi[cut:].tolist()):
            if not len(near):
                break
            long = posting[a:b]
            spot = np.searchsorted(long, near)
            count = count + (long[np.minimum(spot, len(long) - 1)] == near)
        near = near[(100 + percent) * count >= percent * (m + size[near])]
        if len(near):
            yield int(order[q]), order[near]


def _tile(batch: pa.Table, percent: int) -> pa.Table:
    ids = batch.column("id").to_numpy()
    weight = batch.column("weight").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("elements")]
    label = np.arange(len(ids))
    least = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # label order is id order
    label = least.copy()
    links = np.zeros(len(ids), np.int64)
    across = batch.column("i")[0].as_py() != batch.column("j")[0].as_py()
    for q, near in search(sets, batch.column("side").to_numpy() if across else None, percent):
        links[q] += weight[near].sum()
        links[near] += weight[q]
        own = np.unique(np.append(label[near], label[q]))
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    root = np.sort(ids)[label]
    return pa.table({"id": ids, "root": root, "n_links": links})


def link(sets: DataFrame, postings: DataFrame, percent: int = 80, tile: int = TILE) -> DataFrame:
    """(id, root, n_links) of every linked set: root is the least id its links reach, n_links the weight of its partners.

    `sets` is (id, weight, size, elements): distinct ids, elements as sorted 64-bit hashes. `postings` (h, id) are keys
    such that linked sets have one in common. Sets joined by keys form families; a family is searched in one task or, if
    it holds more than `tile` elements, in tiles of two parts each, so that no task holds an unbounded group. No pair
    leaves a task: only a root and a sum for each set do.
    """
    family = families(postings)
    member = sets.select("id", "size").join(family, "id")
    parts = member.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / tile)).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1")
    placed = frozen(member.join(parts.drop("n"), "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    # each part meets every part, itself included, once: tile (i, j) holds part i on side 0 and part j on side 1
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "id", F.col("root").alias("family"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    tiles = sets.select("id", "weight", "elements").join(tiles, "id")
    run = tiles.groupBy("family", "i", "j").applyInArrow(lambda t: _tile(t, percent), "id bigint, root bigint, n_links bigint")
    found = frozen(run)
    summed = found.groupBy("id").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")
    if placed.where("parts > 1").isEmpty():
        roots = found.select("id", "root")
    else:
        roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    return summed.join(roots, "id").select("id", "root", "n_links")
