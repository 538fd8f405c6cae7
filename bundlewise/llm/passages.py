"""Passages that repeat across documents wherever their lines break: content-defined windows of words.

Every text is one sequence of words. Of all windows of `WINDOW` words those with the least hash of `SPREAD` neighbours
are taken, which depends on the words alone. So two texts that share WINDOW + SPREAD - 1 consecutive words share a taken
window, embedded or wrapped as they may be, and taken windows of a shared passage overlap: together they cover it but for
its ends. Windows are met by 128-bit equality; a lightly edited passage is found between its edits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlewise.llm.linking import BUCKET, destinations
from bundlewise.llm.shingles import Rolling, mix, words_of

WINDOW, SPREAD = 25, 20
_LATE = 9223372036854775807
#: Bytes of text for each taken window, about, which sets the number of buckets; windows a task gathers before it deals them.
BYTES_A_WINDOW, GATHER = 60, 1 << 19
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class _Other(Rolling):
    """The same with another number for each byte: the second half of a key."""

    def __init__(self, raw: bytes):
        n = len(raw)
        self._grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SECOND[np.frombuffer(raw, np.uint8)] * self._power[:n], out=self.sums[1:])


def _slide(x: np.ndarray, size: int, least) -> np.ndarray:
    """Least (or greatest) of every `size` neighbours, by doubling."""
    have = 1
    while have * 2 <= size:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def windows(words: list[bytes], window: int = WINDOW, spread: int = SPREAD, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(first words of the taken windows, rising; both halves of their keys); none for a text shorter than a window.

    Without `both` the second half is not computed. A window is taken if none of some `spread` neighbours, itself among them, has a smaller hash.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends[:n] - sizes[:n]
    ends = ends[window - 1 :]
    joined = b" ".join(words)
    hashes = Rolling(joined).spans(starts, ends)
    reach = min(spread, n)
    lows = _slide(hashes, reach, np.minimum)
    edge = np.zeros(reach - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, lows, edge]), reach, np.maximum) == hashes)
    return at, hashes[at].view(np.int64), _Other(joined).spans(starts[at], ends[at]).view(np.int64) if both else None


def order_of(doc_id: Column, dk: Column) -> list[Column]:
    """Two numbers that order the documents: `d`, the id, null last, and `h`, from its identity `dk`."""
    return [F.coalesce(doc_id.cast("bigint"), F.lit(_LATE)).alias("d"), F.xxhash64(dk).alias("h")]


_POSTED = [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("k1", "k2", "d", "h", "own")]]
_POSTED_DDL = "bucket int, k1 binary, k2 binary, d binary, h binary, own binary"
_FOUND = [("dest", pa.int32()), *[(c, pa.binary()) for c in ("d", "h", "k1")]]
_FOUND_DDL = "dest int, d binary, h binary, k1 binary"


def _led(k1: np.ndarray, k2: np.ndarray, d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, then document, and which places in it hold a key whose first document is another one."""
    order = np.lexsort((h, d, k2, k1))
    k1, k2, d, h = k1[order], k2[order], d[order], h[order]
    if not len(order):
        return order, np.zeros(0, bool)
    first = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, (d != d[lead]) | (h != h[lead])


def _packed(parts: np.ndarray, n: int, columns: list[np.ndarray]) -> dict[int, list[bytes]]:
    """The columns' values by part (0 to n - 1), as bytes."""
    order = np.argsort(parts, kind="stable")
    columns = [c[order] for c in columns]
    edge = np.searchsorted(parts[order], np.arange(n + 1)).tolist() if len(parts) else [0] * (n + 1)
    return {p: [c[edge[p] : edge[p + 1]].tobytes() for c in columns] for p in np.unique(parts).tolist()}


def _scaled(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes as parts 0 to n - 1."""
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _post(k1: np.ndarray, k2: np.ndarray, d: np.ndarray, h: np.ndarray, buckets: int) -> pa.Table:
    """Window keys by bucket. Of a key that several documents here have, all but the first know already that it is
    another's: these go out as found (own = 0), spread by document, so that a busy window costs its bucket one entry."""
    order, found = _led(k1, k2, d, h)
    k1, k2, d, h = k1[order], k2[order], d[order], h[order]
    # a document met twice posts once
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(k1) else np.zeros(0, bool)
    k1, k2, d, h, found = k1[new], k2[new], d[new], h[new], found[new]
    at = np.where(found, _scaled(mix(h.view(np.uint64) ^ k1.view(np.uint64)), buckets), _scaled(mix(k1.view(np.uint64)), buckets))
    rows = _packed(at, buckets, [k1, k2, d, h, (~found).astype(np.int8)])
    columns = [list(rows), *[[x[c] for x in rows.values()] for c in range(5)]]
    return pa.table({c: pa.array(x, t) for x, (c, t) in zip(columns, _POSTED)})


def _flat(rows: pa.Table, c: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), kind)


def _meet(rows: pa.Table, dests: int) -> pa.Table:
    """(dest, d, h, k1), packed: documents and those of their keys that an earlier document has."""
    k1, k2, d, h, own = (*[_flat(rows, c) for c in ("k1", "k2", "d", "h")], _flat(rows, "own", np.int8).astype(bool))
    order, met = _led(k1[own], k2[own], d[own], h[own])
    d, h, k1 = (np.concatenate([x[own][order][met], x[~own]]) for x in (d, h, k1))
    made = _packed(_scaled(mix(h.view(np.uint64) ^ mix(d.view(np.uint64))), dests), dests, [d, h, k1])
    columns = [list(made), *[[x[c] for x in made.values()] for c in range(3)]]
    return pa.table({c: pa.array(x, t) for x, (c, t) in zip(columns, _FOUND)})


def _by_document(rows: pa.Table) -> pa.Table:
    d, h, k1 = (_flat(rows, c) for c in ("d", "h", "k1"))
    order = np.lexsort((k1, h, d))
    d, h, k1 = d[order], h[order], k1[order]
    other = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    new = np.concatenate(([True], other | (k1[1:] != k1[:-1])))
    first = np.flatnonzero(np.concatenate(([True], other))[new])
    d, h, k1 = d[new], h[new], k1[new]
    keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(k1)), pa.int32()), pa.array(k1, pa.int64()))
    return pa.table({"d": d[first], "h": h[first], "elsewhere": keys})


def foreign_windows(given: DataFrame, text: str = "t", window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """(d, h, elsewhere): for each document the distinct first key halves of its windows that an earlier document has.

    `given` has the numbers of `order_of` and a binary text. A window belongs to the first document in that order. Keys and
    documents travel packed, 32 bytes a window, to buckets of keys; what is found there goes packed to ranges of documents.
    """
    size = given.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parallel = given.sparkSession.sparkContext.defaultParallelism * 2
    total = size // BYTES_A_WINDOW
    buckets = max(min(-(-total // BUCKET), 1 << 20), parallel)
    dests = destinations(total, parallel)

    def post(batches):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for d, h, t in zip(*[batch.column(c).to_pylist() for c in ("d", "h", "t")]):
                _, k1, k2 = windows(words_of(t), window, spread)
                if len(k1):
                    held.append((k1, k2, np.full(len(k1), d, np.int64), np.full(len(k1), h, np.int64)))
                    n += len(k1)
                if n >= GATHER:
                    yield from _post(*[np.concatenate(x) for x in zip(*held)], buckets).to_batches()
                    held, n = [], 0
        if held:
            yield from _post(*[np.concatenate(x) for x in zip(*held)], buckets).to_batches()

    posted = given.select("d", "h", F.col(text).alias("t")).mapInArrow(post, _POSTED_DDL)
    met = posted.groupBy("bucket").applyInArrow(lambda t: _meet(t, dests), _FOUND_DDL)
    return met.groupBy("dest").applyInArrow(_by_document, "d bigint, h bigint, elsewhere array<bigint>")


def repeated_words(words: list[bytes], elsewhere: set[int], window: int = WINDOW, spread: int = SPREAD) -> np.ndarray | None:
    """Which words lie in a window that an earlier document has, or that stands earlier in this one (all of it but the first).

    None where no window repeats.
    """
    at, k1, _ = windows(words, window, spread, both=False)
    if not elsewhere and len(np.unique(k1)) == len(k1):
        return None
    gone = np.zeros(len(words), bool)
    seen: dict[int, int] = {}
    for p, key in zip(at.tolist(), k1.tolist()):
        if key in elsewhere:
            gone[p : p + window] = True
        elif key in seen:
            gone[max(p, seen[key] + window) : p + window] = True
        else:
            seen[key] = p
    return gone


def without_words(raw: bytes, gone: np.ndarray, lines: set[int]) -> bytes:
    """The text without `lines` (numbers) and without the words marked in `gone`.

    A line that loses no word stays as it is, one that loses all goes, of any other the runs of words left are joined by
    a blank.
    """
    out, at = [], 0
    for number, line in enumerate(raw.split(b"\n")):
        n = len(line.split())
        lost = gone[at : at + n]
        at += n
        if number in lines or (n and lost.all()):
            continue
        if not lost.any():
            out.append(line)
            continue
        part = np.concatenate(([0], ~np.isin(np.frombuffer(line, np.uint8), [32, 9, 10, 11, 12, 13]), [0])).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(part) == 1), np.flatnonzero(np.diff(part) == -1)
        edge = np.diff(np.concatenate(([0], ~lost, [0])).astype(np.int8))
        runs = [line[0 if a == 0 else starts[a] : len(line) if b == n else ends[b - 1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        out.append(b" ".join(runs))
    return b"\n".join(out)
