"""Byte-level BPE by merge replay: all pieces of a chunk of the corpus are merged at once, rank after rank."""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.common import map_arrow, table, worker_store

#: Text merged together: distinct pieces of about so many bytes of text share one index.
CHUNK_BYTES = 16 << 20
#: Pieces remembered from chunk to chunk in a Python worker, in two generations.
CACHE_PIECES = 800_000
#: White space as the tokenizer's own engine defines it, whatever the regular expression library does.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def splitter(pattern: str | None = None):
    import public_tokenizers
    import regex

    pattern = pattern or public_tokenizers.PATTERN
    pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(pattern)


class Replay:
    """Encodes many pieces at once: an inverted index from a merge's rank to the places of its pair in all pieces.

    Ranks are taken from a heap, so each merge is applied to the whole chunk when its turn comes, and only the two pairs
    beside a merged place are looked up again. A pair that appears late may have a lower rank than the current merge;
    the places left are then put back and the lower rank goes first, which is what encoding each piece alone would do.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.word = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.size = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        key = a * self.size + b
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.ranks.get(self.word[a] + self.word[b], -1)
        return got

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        key = np.full(n, -1, np.int64)
        key[:-1] = ids[:-1] * self.size + ids[1:]
        key[starts[1:] - 1] = -1
        kinds, which = np.unique(key, return_inverse=True)
        first = np.array([-1 if k < 0 else self.rank(int(k) // self.size, int(k) % self.size) for k in kinds], np.int64)[which]
        order = np.flatnonzero(first >= 0)
        order = order[np.argsort(first[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        index = {int(first[g[0]]): g.tolist() for g in np.split(order, cuts) if len(g)}
        turns = list(index)
        heapq.heapify(turns)

        token, want = ids.tolist(), first.tolist()  # want: rank of the pair that begins here
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts[1:].tolist():
            after[s - 1] = -1
            if s < n:
                before[s] = -1
        alive = bytearray(b"\x01") * n
        rank = self.rank
        while turns:
            now = heapq.heappop(turns)
            places = index.pop(now, None)
            if not places:
                continue
            places.sort()
            for k, p in enumerate(places):
                if want[p] != now or not alive[p]:
                    continue
                q = after[p]
                token[p] = now  # the id of a merged token is its rank
                alive[q] = 0
                want[q] = -1
                r = after[p] = after[q]
                lower = False
                if r >= 0:
                    before[r] = p
                    new = want[p] = rank(now, token[r])
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(turns, new)
                        lower = new < now
                else:
                    want[p] = -1
                o = before[p]
                if o >= 0:
                    new = want[o] = rank(token[o], now)
                    if new >= 0:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heapq.heappush(turns, new)
                        lower = lower or new < now
                if lower and k + 1 < len(places):
                    index[now] = places[k + 1 :] + index.get(now, [])
                    heapq.heappush(turns, now)
                    break
        live = np.flatnonzero(np.frombuffer(bytes(alive), np.uint8))
        flat = np.array(token, np.int64)[live].tolist()
        ends = np.searchsorted(live, starts).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Whole texts to ids; pieces met before come from a bounded cache."""

    def __init__(self, path: str, pattern: str | None = None, chunk_bytes: int = CHUNK_BYTES):
        self.replay = Replay(load_ranks(path))
        self.find = splitter(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chunk = chunk_bytes

    def _ids(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces as little-endian unsigned 32-bit integers."""
        young, old, ranks, todo = self.young, self.old, self.replay.ranks, []
        got: dict[str, bytes] = {}
        for piece in pieces:
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    whole = ranks.get(raw := piece.encode())
                    if whole is None:
                        todo.append((piece, raw))
                        continue
                    ids = whole.to_bytes(4, "little")  # a piece that is a token needs no merges
                young[piece] = ids
            got[piece] = ids
        for (piece, _), ids in zip(todo, self.replay.encode([raw for _, raw in todo])):
            got[piece] = young[piece] = np.array(ids, "<u4").tobytes()
        if len(young) > CACHE_PIECES // 2:
            self.old, self.young = young, {}
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (upto == at or size < self.chunk):
                size += len(texts[upto])
                upto += 1
            split = [self.find(t) for t in texts[at:upto]]
            ids = self._ids(set().union(*split)).__getitem__
            out += [b"".join(map(ids, pieces)) for pieces in split]
            at = upto
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.word.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """One per Python worker: loading a vocabulary takes longer than a small task, and the cache of pieces stays warm."""
    key = ("byte_bpe", path, pattern, os.path.getmtime(path))
    return worker_store().get(key) or worker_store().setdefault(key, Encoder(path, pattern))


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Ids of each whole text as the vocabulary's own library gives them, and the text they decode to.

    Result: `row` (the input row, or its columns in `keep`), `ids` and `decoded` (binary; ids as little-endian unsigned
    32-bit integers). Tasks are independent: distinct pieces of each Arrow batch are merged together, nothing is
    shuffled and a task holds a batch, its index and a bounded cache. Decoding reads the ids, not the text.

    Nulls and empty texts give no ids. Repeated rows are encoded alike. Very long texts form a chunk by themselves.
    """
    path = vocabulary or default_vocabulary()

    def make():
        tool = encoder(path, pattern)

        def step(texts):
            ids = tool.encode([t or "" for t in texts.to_pylist()])
            return pa.array(ids, pa.binary()), pa.array([tool.decode(x) for x in ids], pa.binary())

        return step

    return map_arrow(docs, {"t": docs[text]}, "ids binary, decoded binary", make, keep=keep)


def decode(tokens: DataFrame, ids: str = "ids", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Bytes of stored ids; a null or empty value decodes to no bytes."""
    path = vocabulary or default_vocabulary()

    def make():
        tool = encoder(path)
        return lambda column: ([tool.decode(x or b"") for x in column.to_pylist()],)

    return map_arrow(tokens, {"i": tokens[ids]}, "decoded binary", make, keep=keep)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select(
        "row.doc_id",
        F.floor(F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
