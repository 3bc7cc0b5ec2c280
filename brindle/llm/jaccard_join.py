"""Operator 3: exact n-gram Jaccard join by set-relation skipping.

A document's set holds its distinct word shingles as 64-bit hashes; sets link at a Jaccard similarity of num/den or more.

1. Equal sets are one node (by their fingerprint): a group of copies is a single set from here on.
2. One order of shingles for all sets: first a fixed share of the hash space (the sampled part), by the number of sets that
   hold a shingle, rare ones first, then the rest; ties by hash. Linked sets share a shingle among the first n - ceil(t n) + 1
   of this order, whatever the order is. Numbers of holders are summed per chunk of documents before the shuffle, so a shingle
   of a third of all documents is one entry a chunk. A set whose first shingles are its own has no link and goes no further.
3. Sets that share one of their first shingles form clusters. A cluster is solved in memory. One over BLOCK_TOKENS is divided:
   a hash-ordered set is cut into k position blocks, k above the largest symmetric difference a linked pair of its size may
   have, so linked sets agree in a whole block; a set is listed under all its blocks, but asks only for its largest ones (so
   many that one must agree). In a cluster still over that size, each set first meets the set it shares most lists with, in
   groups of bounded size; lists whose sets are one component by then are done. What is left is cut into blocks of sets, and
   each pair of blocks is solved by a task of its own.
4. Inside a task: an index of the rarest shingles, its lists kept in blocks by position. A block is skipped as a whole when
   its positions leave too few shingles in common, or when its sets already share the component of the asking set. The
   answers of a set are derived from those of the most similar set answered before: its links are inherited through the
   component, and its computed overlaps bound the new ones, so that most need no intersection.

A task gives one row per set, never pairs. Result: components, which keep every link between different texts.

Defined results: a text without words has an empty set and links with nothing, not even with another empty one; fewer words
than the width form one shingle; equal texts link; a null doc_id is carried along and never names a component unless all are
null; repeated rows each get a row; extra columns are ignored (kept by `keep_one`); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, pick, stream_task, worker_count
from brindle.llm.components import components
from brindle.llm.fingerprints import mix, word_hashes

#: The sampled part of the hash space: a multiple of the share 1 - t of a set that a linked set may lack, and a part beyond it.
SAMPLE, BEYOND = 1.75, 0.1
#: Share of blocks beyond those that must be asked for.
SLACK = 0.25
#: Shingles of one block of sets; a task holds two such blocks. A set counts as SET_TOKENS more, so short ones are bounded too.
BLOCK_TOKENS, SET_TOKENS = 150_000, 30
#: Sampled shingles of a chunk of documents.
CHUNK_TOKENS = 1_000_000
#: Logarithm of the bits of the map that tells which texts to fetch: at most 2^18 rows of two numbers are broadcast.
BITMAP_BITS = 24
#: Overlaps that a task remembers.
KNOWN = 200_000
#: Positions in one block of an index list, and sets in it.
POSITIONS, BLOCK_SETS = 8, 64
_A = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the texts are hashed together."""
    from xxhash import xxh3_64_intdigest

    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum()))
    ends = np.cumsum(count)
    out = []
    joint = _shingles(h, width) if len(h) >= width else h
    for end, n in zip(ends.tolist(), count.tolist()):
        if n < width:
            s = _shingles(h[end - n : end], n) if n else h[:0]
        else:
            s = np.sort(joint[end - n : end - width + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
    return out


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _A + h[k : len(h) - width + 1 + k])
    return out


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes(text)
    return np.unique(_shingles(h, min(width, len(h)))) if len(h) else h


def node_of(s: np.ndarray) -> int:
    """Fingerprint of a set: a signed 64-bit number."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def first_shingles(n: int, num: int, den: int) -> int:
    """Of so many first shingles in a common order, a set of n shares one with every set that it links with."""
    return n - -(-num * n // den) + 1


def _limit(num: int, den: int) -> np.uint64:
    return np.uint64(min(1.0, SAMPLE * (den - num) / den + BEYOND) * (1 << 24))


def sampled(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The sampled shingles of a set, and as many others, by hash, as its first shingles need."""
    inside = (s & _LOW) < _limit(num, den)
    lack = first_shingles(len(s), num, den) - int(inside.sum())
    return s[inside] if lack <= 0 else np.concatenate([s[inside], s[~inside][:lack]])


@lru_cache(maxsize=4)
def _bounds(num: int, den: int) -> list[int]:
    """Lower bounds of the size classes: sets that may link lie in the same or neighbouring classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return out


@lru_cache(maxsize=4096)
def family(j: int, num: int, den: int) -> tuple[int, int]:
    """For pairs whose smaller set is in class j: blocks to list, blocks to ask for (more than the sets can differ in)."""
    small = _bounds(num, den)[j + 1] - 1
    differ = (small + small * den // num) * (den - num) // (den + num)
    return math.ceil((differ + 1) * (1 + SLACK)), differ + 1


def block_lists(s: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, asks) of a set: in the family of its own class, and, only asking, in that of the class below."""
    c = int(np.searchsorted(_bounds(num, den), len(s), "right")) - 1
    out = []
    for j in (c, c - 1):
        if j < 0 or (both := family(j, num, den))[1] == 1:
            continue  # no difference is allowed: only equal sets link
        k, ask = both
        block = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # grows with the hash: blocks are runs of positions
        ends = np.searchsorted(block, np.arange(k + 1, dtype=np.uint64))
        sizes = np.diff(ends)
        total = np.append(np.uint64(0), np.cumsum(mix(s * _A + np.uint64(1)), dtype=np.uint64))
        keys = mix(mix((total[ends[1:]] - total[ends[:-1]]) + np.uint64((j * 2 + 1) * int(_A) % 2**64)) + (np.arange(k, dtype=np.uint64) + np.uint64(7)) * _A)
        asks = np.zeros(k, bool)
        asks[np.argsort(-sizes, kind="stable")[:ask]] = True
        out.append((keys, asks) if j == c else (keys[asks], asks[asks]))
    return out


class Solver:
    """Exact components of sets in memory. side: sets of one side are not compared (they are in another task); None: all are."""

    def __init__(self, sets: list[np.ndarray], sides: list[int] | None, num: int, den: int):
        self.num, self.den, self.sides = num, den, sides
        self.parent = list(range(len(sets)))
        token, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(token), np.int64)
        rank[np.lexsort((token, count))] = np.arange(len(token))  # rare shingles first
        ends = np.cumsum([len(s) for s in sets])
        self.sorted = [np.sort(r) for r in np.split(rank[back], ends[:-1])]
        self.full: dict[int, frozenset] = {}
        self.known: dict[int, dict[int, int]] = {}
        self.remembered = 0
        self.index: dict[int, dict[int, list[list]]] = {}
        for x in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
            self._answer(x)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _set(self, x: int) -> frozenset:
        if x not in self.full:
            self.full[x] = frozenset(self.sorted[x].tolist())
        return self.full[x]

    def _answer(self, x: int) -> None:
        num, den, n = self.num, self.den, len(self.sorted[x])
        tokens = self.sorted[x].tolist()
        least = -(-num * n // den)  # sizes and overlaps below this cannot link
        last = n - -(-2 * num * n // (den + num))  # positions that an entry of an equally large set may have
        seen, known, best, best_overlap = set(), {}, None, 0
        for t in tokens[: n - least + 1]:
            for at, blocks in sorted(self.index.get(t, {}).items()):
                if at * POSITIONS > last:
                    break  # these blocks and all later ones lie too far back
                for block in blocks:
                    one, members = block
                    if len(self.sorted[members[-1]]) < least or one is not None and self.find(one) == self.find(x):
                        continue  # too small, or one component with x already
                    for y in members:
                        m = len(self.sorted[y])
                        if y in seen or m < least or self.sides and self.sides[x] == self.sides[y] or self.find(y) == self.find(x):
                            continue
                        seen.add(y)
                        need = -(-num * (n + m) // (den + num))
                        if best is not None and (o := self.known.get(best, {}).get(y)) is not None and o + n - best_overlap < need:
                            continue  # x holds at most what the similar set shares with y and what it has beyond that set
                        known[y] = overlap = len(self._set(x) & self._set(y))
                        if overlap >= need:
                            self.parent[max(self.find(x), self.find(y))] = min(self.find(x), self.find(y))
                            if overlap > best_overlap:
                                best, best_overlap = y, overlap
        if known:
            self.remembered += len(known)
            if self.remembered > KNOWN:  # these only save work: forgetting them changes no answer
                self.known.clear()
                self.remembered = len(known)
            self.known[x] = known
        for i, t in enumerate(tokens[: last + 1]):
            blocks = self.index.setdefault(t, {}).setdefault(i // POSITIONS, [])
            if not blocks or len(blocks[-1][1]) >= BLOCK_SETS:
                blocks.append([x, [x]])
            else:
                blocks[-1][1].append(x)
                if blocks[-1][0] is not None and self.find(blocks[-1][0]) != self.find(x):
                    blocks[-1][0] = None

    def roots(self) -> list[int]:
        return [self.find(x) for x in range(len(self.parent))]


def _marked(docs: DataFrame) -> DataFrame:
    return pick(docs, ("doc_id", "long"), ("text", "string")).withColumn("mark", F.xxhash64("text"))


def _same_document() -> Column:
    """Joins by id and text: neither null nor repeated ids are a hot key."""
    return F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("id_mark"))


def _rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n_shingles, node (null without words), chunk and sample (null for copies within a task) per document."""

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        seen: set[int] = set()
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for ids, texts, marks in slices:
            out = []
            for i, mark, s in zip(ids, marks, shingle_sets(texts, width)):
                if not len(s):
                    out.append((i, mark, 0, None, None, None))
                    continue
                node, sample = node_of(s), None
                if node not in seen:
                    seen.add(node)
                    part = sampled(s, num, den)
                    sample, held = part.tobytes(), held + len(part)
                out.append((i, mark, len(s), node, chunk, sample))
                if held >= CHUNK_TOKENS:
                    chunk, held = chunk + 1, 0
            yield out

    return cut(stream_task(_marked(docs), task, "doc_id long, mark long, n_shingles long, node long, chunk long, sample binary"), "sets")


def _shared(rows: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(chunk, hashes, ranks): the sampled shingles of a chunk that more than one set holds, with the logarithm of their number."""
    limit, buckets = _limit(num, den), 4 * parts

    def count(chunk: int, held: list[bytes]) -> list[tuple]:
        hashes = np.frombuffer(b"".join(held), np.uint64)
        hashes, n = np.unique(hashes[(hashes & _LOW) < limit], return_counts=True)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
        n = n.astype(np.uint32)
        return [(b, chunk, hashes[s:e].tobytes(), n[s:e].tobytes()) for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s]

    def count_task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        now, held, size = None, [], 0
        for chunks, samples in slices:
            out = []
            for chunk, sample in zip(chunks, samples):
                if held and (chunk != now or size >= CHUNK_TOKENS * 8):
                    out += count(now, held)
                    held, size = [], 0
                now = chunk
                held.append(sample)
                size += len(sample)
            yield out
        if held:
            yield count(now, held)

    def sum_up(held: list[tuple]) -> list[tuple]:
        hashes = [np.frombuffer(h, np.uint64) for _, h, _ in held]
        every, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, np.concatenate([np.frombuffer(n, np.uint32) for _, _, n in held]))
        rank = np.where(total > 1, np.log2(total).astype(np.uint8), 0).astype(np.uint8)[back]
        out, at = [], 0
        for (chunk, _, _), h in zip(held, hashes):
            r = rank[at : at + len(h)]
            at += len(h)
            if r.any():
                out.append((chunk, h[r > 0].tobytes(), r[r > 0].tobytes()))
        return out

    def sum_task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        now, held = None, []
        for cols in slices:
            out = []
            for bucket, chunk, hashes, n in zip(*cols):
                if held and bucket != now:
                    out += sum_up(held)
                    held = []
                now = bucket
                held.append((chunk, hashes, n))
            yield out
        if held:
            yield sum_up(held)

    counted = stream_task(rows.filter("sample is not null").select("chunk", "sample"), count_task, "bucket int, chunk long, hashes binary, n binary")
    return stream_task(counted.repartition(parts, "bucket").sortWithinPartitions("bucket"), sum_task, "chunk long, hashes binary, ranks binary")


def _entries(rows: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(key, node): the first shingles of each set, without those that no other set holds."""
    limit = _limit(num, den)

    def first(n: int, sample: bytes, shared: np.ndarray, ranks: np.ndarray) -> list[int]:
        s = np.frombuffer(sample, np.uint64)
        rank = np.full(len(s), 255, np.uint8)
        inside = (s & _LOW) < limit
        at = np.searchsorted(shared, s[inside])
        hit = np.append(shared, np.uint64(0))[at] == s[inside]
        hit &= at < len(shared)
        rank[inside] = np.where(hit, np.append(ranks, np.uint8(0))[at], 0)
        order = np.lexsort((s, rank))[: first_shingles(n, num, den)]
        return s[order][rank[order] > 0].view(np.int64).tolist()

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        now, held, shared, ranks = None, [], None, None
        for cols in slices:
            out = []
            for chunk, sample, node, n, hashes, r in zip(*cols):
                if chunk != now:
                    now, held, shared = chunk, [], None
                if sample is None:  # these rows come first in a chunk
                    held.append((hashes, r))
                    continue
                if shared is None:
                    shared, ranks = np.frombuffer(b"".join(h for h, _ in held), np.uint64), np.frombuffer(b"".join(x for _, x in held), np.uint8)
                    shared, at = np.unique(shared, return_index=True)
                    ranks, held = ranks[at], []
                keys = first(n, sample, shared, ranks)
                if keys:
                    out.append((node, keys))
            yield out

    samples = rows.filter("sample is not null").select("chunk", "sample", "node", "n_shingles", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("ranks"))
    shared = _shared(rows, num, den, parts).select("chunk", F.lit(None).cast("binary").alias("sample"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("n_shingles"), "hashes", "ranks")
    dealt = samples.unionAll(shared).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("sample").isNotNull())
    return stream_task(dealt, task, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node").distinct()


def _sized(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """clusters with the columns of sets, and the number of blocks of their cluster."""
    member = clusters.join(sets, "node")
    size = member.groupBy("root").agg(F.ceil(F.sum(F.col("n") + SET_TOKENS) / BLOCK_TOKENS).cast("int").alias("blocks"))
    return cut(member.join(cut(size, "sizes"), "root"), "members")


def _edges(entry: DataFrame, by: str) -> DataFrame:
    """(u, v, n) for entries (key, node, and by: what must differ within a list): each set of a list with the least one, and in
    how many lists. The least sets are written, so that Spark can split the join by a hot list."""
    heads = entry.groupBy("key").agg(F.min("node").alias("head"), F.min(by).alias("low"), F.max(by).alias("high")).filter("low <> high").select("key", "head")
    return entry.join(cut(heads, "heads"), "key").filter("node <> head").groupBy(F.col("node").alias("u"), F.col("head").alias("v")).agg(F.count("*").alias("n"))


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the text of each document. Spark broadcasts wanted (some numbers a row) while it is below its threshold; beyond
    that both sides are shuffled, and a bitmap of bounded size keeps most texts that are not wanted out of the shuffle."""
    wanted = cut(wanted, "wanted")
    bit = F.shiftrightunsigned(F.xxhash64("id", "id_mark"), 64 - BITMAP_BITS)
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    texts = _marked(docs).withColumn("bit", F.shiftrightunsigned(F.xxhash64("doc_id", "mark"), 64 - BITMAP_BITS)).withColumn("word", F.shiftright("bit", 6))
    texts = texts.join(F.broadcast(cut(words, "bitmap")), "word").filter("getbit(bits, cast(bit & 63 as int)) = 1").select("doc_id", "text", "mark")
    return texts.join(wanted, _same_document())


def _block_edges(docs: DataFrame, large: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(u, v, n) as `_edges`, by lists of equal blocks within a cluster; a list in which no set asks has none."""

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        done: set[int] = set()
        for texts, nodes, roots in slices:
            out = []
            for s, node, root in zip(shingle_sets(texts, width), nodes, roots):
                if len(s) and node not in done and node_of(s) == node:
                    done.add(node)
                    for keys, asks in block_lists(s, num, den):
                        out.append((node, root, keys[asks].view(np.int64).tolist(), keys[~asks].view(np.int64).tolist()))
            yield out

    fetched = _fetched(docs, large.select("node", "root", "id", "id_mark")).select("text", "node", "root")
    listed = cut(stream_task(fetched, task, "node long, root long, asked array<long>, offered array<long>"), "blocks")
    entry = listed.select("node", "root", F.explode("asked").alias("k"), F.lit(0).alias("quiet")).unionAll(listed.select("node", "root", F.explode("offered"), F.lit(1)))
    entry = entry.select(F.xxhash64("root", "k").alias("key"), "node", "quiet")
    heads = entry.groupBy("key").agg(F.min(F.struct("quiet", "node")).alias("head"), F.min("node").alias("low"), F.max("node").alias("high"))
    heads = heads.filter("low <> high and head.quiet = 0").select("key", F.col("head.node").alias("head"))
    return entry.join(cut(heads, "heads"), "key").filter("node <> head").groupBy(F.col("node").alias("u"), F.col("head").alias("v")).agg(F.count("*").alias("n"))


def _solved(docs: DataFrame, dealt: DataFrame, width: int, num: int, den: int, parts: int) -> DataFrame:
    """(u, v): links between sets, as many as their components need. dealt: node, id, id_mark, root, blocks, kind; kind 0: the set is
    in one of the blocks of its root, and blocks are solved in pairs; 1: in one block, solved alone; 2: in all blocks."""

    def read_task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        done: set[tuple] = set()
        for texts, *cols in slices:
            out = []
            for s, node, root, g, kind in zip(shingle_sets(texts, width), *cols):
                if not len(s) or node_of(s) != node or (node, root, kind) in done:
                    continue  # a repeated row
                done.add((node, root, kind))
                mine, raw = (node >> 1) % g, s.tobytes()
                if kind == 0:
                    out += [(root, min(mine, other), max(mine, other), node, mine, raw) for other in range(g)]
                else:
                    out += [(root, b, b, node, b, raw) for b in ((mine,) if kind == 1 else range(g))]
            yield out

    fetched = _fetched(docs, dealt).select("text", "node", "root", "blocks", "kind")
    sets = stream_task(fetched, read_task, "root long, a int, b int, node long, mine int, s binary")
    sets = sets.repartition(parts, "root", "a", "b").sortWithinPartitions("root", "a", "b", "node")

    def solve(group: tuple, held: list[tuple]) -> list[tuple]:
        _, a, b = group
        nodes, mine, raw = zip(*held)
        found = Solver([np.frombuffer(r, np.uint64) for r in raw], list(mine) if a != b else None, num, den).roots()
        return [(n, nodes[r]) for n, r in zip(nodes, found) if n != nodes[r]]

    def solve_task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        group, held = None, []
        for cols in slices:
            out = []
            for root, a, b, node, mine, raw in zip(*cols):
                if (root, a, b) != group:
                    if len(held) > 1:
                        out += solve(group, held)
                    group, held = (root, a, b), []
                if not held or held[-1][0] != node:  # copies from several tasks
                    held.append((node, mine, raw))
            yield out
        if len(held) > 1:
            yield solve(group, held)

    return stream_task(sets, solve_task, "u long, v long")


def link(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, root, mark) per document: component_id is the least doc_id reachable by links,
    root the component itself (components of repeated or null ids can share a component_id), mark the hash of the text."""
    parts = worker_count(docs.sparkSession)
    rows = _rows(docs, width, num, den)
    sets = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("one"), F.max("n_shingles").alias("n"))
    sets = cut(sets.select("node", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("id_mark"), "n"), "nodes")

    entry = cut(_entries(rows, num, den, parts), "entries")
    edge = cut(_edges(entry, "node"), "lists")
    clusters = components(edge)
    member = _sized(clusters, sets)
    first = member.filter("blocks = 1").select("node", "id", "id_mark", "root", "blocks", F.lit(0).alias("kind"))

    # clusters over a block: the sets of a cluster that also agree in a whole block of positions
    large = member.filter("blocks > 1")
    any_large = not large.isEmpty()
    if any_large:
        agreeing = cut(_block_edges(docs, large, width, num, den), "lists")
        finer = _sized(components(agreeing), sets)
        first = first.unionAll(finer.filter("blocks = 1").select("node", "id", "id_mark", "root", "blocks", F.lit(0).alias("kind")))
        large = finer.filter("blocks > 1")
        any_large = not large.isEmpty()
    if any_large:
        # still over a block: each set with the one it shares most lists with, in groups of about a block
        best = agreeing.join(large.select(F.col("node").alias("u"), F.col("n").alias("size")), "u").groupBy("u", "size").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
        best = cut(best, "best")
        groups = cut(best.groupBy("v").agg(F.ceil(F.sum(F.col("size") + SET_TOKENS) / BLOCK_TOKENS).cast("int").alias("blocks")), "groups")
        near = best.join(groups, "v").select(F.col("u").alias("node"), F.col("v").alias("root"), "blocks", F.lit(1).alias("kind"))
        near = near.unionAll(groups.select(F.col("v").alias("node"), F.col("v").alias("root"), "blocks", F.lit(2).alias("kind")))
        first = first.unionAll(near.join(sets, "node").select("node", "id", "id_mark", "root", "blocks", "kind"))
    links = cut(_solved(docs, first, width, num, den, parts), "links", gather=True)
    if any_large:
        # lists of large clusters whose sets are not yet one component: these sets are solved against each other
        inside = entry.join(large.select("node", F.col("root").alias("cluster")), "node").withColumn("key", F.xxhash64("key", "cluster"))
        mixed = inside.join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
        rest = _sized(components(_edges(cut(mixed, "mixed"), "part")), sets).select("node", "id", "id_mark", "root", "blocks", F.lit(0).alias("kind"))
        # written apart: what reads it is Python code too, and should not need a second worker beside each
        links = links.unionAll(cut(_solved(docs, rest, width, num, den, parts), "links", gather=True))

    linked = cut(components(links).join(sets, "node").select("node", "root", "id"), "linked")
    least = cut(linked.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = linked.join(least, "root").select("node", "root", "component_id", F.lit(True).alias("found"))
    final = sets.join(named, "node", "left").select("node", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("root", "node").alias("root"))
    final = cut(final, "final")
    with_words = rows.filter("node is not null").join(final, "node").select("doc_id", "n_shingles", "component_id", "node", "root", "mark")
    without = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", F.lit(None).cast("long").alias("root"), "mark")
    return with_words.unionAll(without)


def keep_one(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of docs, all its columns, of each component: that with the least doc_id (of rows that repeat it, the least hash of
    the text, then any). Documents without words all stay. A row is found again by its id and text, so ids may repeat or be null."""
    tag = uuid.uuid4().hex  # no column of docs has these names
    i, mark, root, many, row = (f"{x}_{tag}" for x in ("id", "mark", "root", "many", "row"))
    linked = cut(link(docs, width, num, den), "linked")
    wordy = linked.filter("n_shingles > 0").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("rows"))
    chosen = wordy.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "rows")).alias("one"))
    stay = chosen.select(F.col("one.doc_id").alias(i), F.col("one.mark").alias(mark), F.col("root").alias(root), (F.col("one.rows") > 1).alias(many))
    empty = linked.filter("n_shingles = 0").select(F.col("doc_id").alias(i), F.col("mark").alias(mark), F.lit(None).cast("long").alias(root), F.lit(False).alias(many)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    out = docs.join(cut(stay.unionAll(empty), "stay"), same)
    # repeated rows: any one of them, by a partial aggregation
    single = out.filter(F.col(many)).groupBy(root).agg(F.any_value(F.struct(*columns)).alias(row)).select(f"{row}.*")
    return out.filter(~F.col(many)).select(*columns).unionAll(single)
