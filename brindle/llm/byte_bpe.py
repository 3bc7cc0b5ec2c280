"""Operator 5: byte-level BPE encoding and decoding.

Method: the ranked merges are folded over the byte array of each *distinct* word, with the ranks in one literal map;
decoding concatenates the binary pieces of the ids.

Two forms of the same fold are here:

* ``fold_merges_sql`` is the fold as Spark higher-order functions (``aggregate`` over a merge counter, ``transform`` /
  ``zip_with`` over the pieces, ranks in a literal bucketed map). No query uses it; tests hold it against the other.
* ``Encoder`` is the fold over a Python byte array. ``encode`` uses it, because going back from a table of distinct
  words to whole documents needs two shuffles of every word occurrence, which is several times the input (README).

Defined results: a null or empty text has no ids (count 0, hashes of the empty string); repeated rows each get their own
output row; extra columns are ignored; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import pick, stream, warm

#: Chunks remembered by one Python worker; a full memory is emptied, so its size does not grow with the input.
MEMORY_CHUNKS = 500_000
#: Above every rank.
NO_RANK = 1 << 40
#: A space with white space beside it: such texts are matched as a whole.
_IRREGULAR = re.compile(r"\s \s|  ")
#: Necessary for that, and much faster to look for.
_SPACED = re.compile(r" \s")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold: while some neighbouring pair has a rank, join the (leftmost) pair of the least rank."""
    if piece in ranks:
        return [ranks[piece]]
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pair and (best := min(pair)) < NO_RANK:
        at = pair.index(best)
        joined = parts[at] = parts[at] + parts.pop(at + 1)
        del pair[at]
        if at < len(pair):
            pair[at] = get(joined + parts[at + 1], NO_RANK)
        if at:
            pair[at - 1] = get(parts[at - 1] + joined, NO_RANK)
    return [ranks[p] for p in parts]


class Encoder:
    """Encodes whole texts; every distinct chunk (a word with what touches it) is folded once and remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.match = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        size = max(self.ranks.values(), default=-1) + 1
        self.pieces = [b""] * size
        for k, v in self.ranks.items():
            self.pieces[v] = k

    def _word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            # long words (over 500 bytes) have a quadratic fold; they take the same fold over a heap
            raw = word.encode("utf-8", "surrogatepass")
            out = np.array(merge(raw, self.ranks) if len(raw) <= 500 else _fold_long(raw, self.ranks), "<u4").tobytes()
            if len(self.words) >= MEMORY_CHUNKS:
                self.words.clear()
            self.words[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in self.match(text)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A single space between two non-space characters always starts a new
        match, so texts are split there first and every distinct chunk is matched once."""
        if not text:
            return b""
        if _SPACED.search(text) and _IRREGULAR.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        get, out = self.chunks.get, [self._whole(first)]
        for c in rest:
            ids = get(c)
            if ids is None:
                ids = self._whole(" " + c)
                if len(self.chunks) >= MEMORY_CHUNKS:
                    self.chunks.clear()
                self.chunks[c] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _fold_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap of pairs, for pieces of any length: n log n."""
    import heapq

    n = len(raw)
    part = [raw[i : i + 1] for i in range(n)]
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or part[i] + part[j] != joined:
            continue
        part[i], alive[j], nxt[i] = joined, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(joined + part[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, joined + part[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(part[p] + joined)) is not None:
            heapq.heappush(heap, (r, p, part[p] + joined))
    return [ranks[part[i]] for i in range(n) if alive[i]]


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker: its memory serves all tasks of the worker until another operator runs there."""
    return warm("byte_bpe", (path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) for each row; ids are little-endian unsigned 32-bit integers."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        e = encoder(path, pattern)
        for i, t in zip(ids, texts):
            yield i, e.encode(t or "")

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, ids binary", keep="byte_bpe")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the concatenated pieces of the ids. Null ids: no bytes."""

    def run(ids: list, packed: list) -> Iterator[tuple]:
        e = encoder(path, pattern)
        for i, b in zip(ids, packed):
            yield i, e.decode(b or b"")

    return stream(pick(encoded, ("doc_id", "long"), ("ids", "binary")), run, "doc_id long, bytes binary", keep="byte_bpe")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids, per document: count and digests. One pass, no shuffle."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        e, sha = encoder(path, pattern), hashlib.sha256
        for i, t in zip(ids, texts):
            packed = e.encode(t or "")
            yield i, len(packed) // 4, sha(packed).hexdigest(), sha(e.decode(packed)).hexdigest()

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep="byte_bpe")


#: Buckets of the literal rank map: a Spark map is searched from its start, so each bucket must hold few entries.
RANK_BUCKETS = 32_768


def rank_literal(path: str) -> Column:
    """The ranks as one literal array of small maps, addressed by the hash of the (hex) pair: read from JSON, so that the
    optimizer folds it to a constant once."""
    import json

    import zlib

    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for k, v in load_ranks(path).items():
        h = k.hex().upper()
        buckets[zlib.crc32(h.encode()) % RANK_BUCKETS][h] = v
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def fold_merges_sql(word: Column, ranks: Column) -> Column:
    """array<int> of ids of one word as higher-order functions: aggregate over at most length-1 rounds; each round finds the
    least rank among neighbouring pieces and joins the leftmost such pair. Pieces are hex strings of their bytes."""

    def rank(h: Column) -> Column:
        return F.element_at(F.element_at(ranks, (F.crc32(h.cast("binary")) % RANK_BUCKETS).cast("int") + 1), h)

    hexed = F.hex(F.encode(word, "UTF-8"))
    start = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1))), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), rank(F.concat(a, b))))
        best = F.array_min(pairs)
        at = F.array_position(pairs, best)
        joined = F.concat(
            F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")),
            F.array(F.concat(F.element_at(parts, at.cast("int")), F.element_at(parts, (at + 1).cast("int")))),
            F.slice(parts, (at + 2).cast("int"), F.size(parts)),
        )
        return F.when(best.isNull(), parts).otherwise(joined)

    rounds = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.aggregate(rounds, start, step), rank))
