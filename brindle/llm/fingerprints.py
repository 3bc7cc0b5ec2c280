"""Operator 10: document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the top bits of the hash choose one of BINS bins, each bin keeps its least hash. Empty
bins copy a filled bin found by optimal densification (a hash of bin and attempt picks the next try). Of each bin the low
BITS bits are stored, packed; likeness corrects the matches that so few bits make by chance.

Shingles are five words (A-Z lower-cased, separated by ASCII white space), or all words where there are fewer. A text without
words has the empty fingerprint, like only to itself.

`fingerprint` is one pass without a shuffle. `with_edited` needs each document's successor by doc_id: rows go to ranges of
ids and each range also gets the first row of the next one, so that no window over all rows is needed.
Defined results: null text is empty; equal texts have equal fingerprints; repeated ids are ordered by text; a null id sorts
first; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import pick, ship, stream, stream_task

BINS = 256
BITS = 4
WIDTH = 5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mix(out * _A + h[k : len(h) - width + 1 + k] + np.uint64(k + 1))
    return out


def one_permutation(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """The least hash of each bin, densified; None without hashes."""
    if not len(hashes):
        return None
    shift = np.uint64(64 - (bins.bit_length() - 1))
    ordered = np.sort(hashes)
    which, first = np.unique(ordered >> shift, return_index=True)
    value, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    value[which.astype(np.int64)], filled[which.astype(np.int64)] = ordered[first], True
    empty, attempt, out = np.flatnonzero(~filled), 1, value.copy()
    while len(empty):
        source = (mix(empty.astype(np.uint64) * _A + np.uint64(attempt * int(_C) % 2**64)) >> shift).astype(np.int64)
        hit = filled[source]
        out[empty[hit]] = value[source[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return out


def packed(text: str, bins: int = BINS, bits: int = BITS) -> str:
    """Hex of the packed low bits; '' for a text without words."""
    values = one_permutation(shingle_hashes(text), bins)
    if values is None:
        return ""
    low = mix(values) & np.uint64((1 << bits) - 1)
    raw = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(raw.reshape(-1)).tobytes().hex()


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard likeness: the share of equal bins less what 2^-bits would match by chance."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x = np.unpackbits(np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)).reshape(-1, bits)
    share, chance = float((~x.any(axis=1)).mean()), 2.0**-bits
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def fingerprint(docs: DataFrame) -> DataFrame:
    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            yield i, packed(t or "")

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last quarter (floor of code points) replaced by as many first code points of the next text, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def with_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likenesses to it and to the next document."""
    docs = pick(docs, ("doc_id", "long"), ("text", "string"))
    spark = docs.sparkSession
    n = ranges or 3 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # One row per range at most goes to the driver, whatever the number of documents.
    bounds = docs.filter("doc_id is not null").select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    # which range a row belongs to is a binary search, so its cost does not grow with the number of ranges
    edges = np.array(bounds, np.int64)

    def part_of(ids: pa.Array) -> np.ndarray:
        at = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return at.astype(np.int32)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            parts = part_of(ids)
            for p in np.unique(parts).tolist():
                head = min((i for i in ids.filter(pa.array(parts == p)).to_pylist() if i is not None), default=None)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([head], pa.int64())], ["part", "head"])

    ship(spark)
    heads = docs.select("doc_id").mapInArrow(least, "part int, head long").groupBy("part").agg(F.min("head").alias("head")).orderBy("part").collect()
    # the first row of each range also goes, as a guard, to the range before it (cyclically)
    guards = {(h["part"], h["head"]): heads[i - 1]["part"] for i, h in enumerate(heads)}
    first = {h for _, h in guards}
    known = np.array(sorted(h for h in first if h is not None), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "guard", "doc_id", "text"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            parts = part_of(ids)
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.zeros(len(parts), bool)), ids, texts], names)
            maybe = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), known) | (ids.is_null().to_numpy(zero_copy_only=False) if None in first else False)
            rows = [(k, guards[key]) for k in np.flatnonzero(maybe).tolist() if (key := (int(parts[k]), ids[k].as_py())) in guards]
            if rows:
                at = pa.array([k for k, _ in rows])
                yield pa.RecordBatch.from_arrays([pa.array([to for _, to in rows], pa.int32()), pa.array([True] * len(rows)), ids.take(at), texts.take(at)], names)

    dealt = docs.mapInArrow(deal, "part int, guard boolean, doc_id long, text string")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "guard", F.asc_nulls_first("doc_id"), F.coalesce("text", F.lit("")))

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        held = None  # the row that waits for its successor: part, doc_id, text, fingerprint

        def done(row: tuple, nxt_text: str, nxt_print: str) -> tuple:
            _, doc_id, text, own_print = row
            changed = edited(text, nxt_text)
            changed_print = own_print if changed == text else packed(changed)
            return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own_print, changed_print, likeness(own_print, changed_print), likeness(own_print, nxt_print))

        for p, g, ids, texts in slices:
            out = []
            for part_, guard_, doc_id, text in zip(p, g, ids, texts):
                if guard_ and (held is None or held[0] != part_):
                    continue  # further rows of the same id behind the guard
                text = text or ""
                now = packed(text)
                if held is not None and held[0] == part_:
                    out.append(done(held, text, now))
                held = None if guard_ else (part_, doc_id, text, now)
            yield out

    return stream_task(dealt, task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
