"""Operator 6: quality rules by compression bands.

The zstandard ratio (compressed bytes / UTF-8 bytes) of a whole document, and of each of its fixed chunks, must lie in a
band that depends on length: a lower ratio means repetitive text, a higher one incompressible text.

One pass over whole texts without a shuffle. Defined results: a null or empty text has no words and fails the base rules;
white space only likewise; repeated rows are judged alike; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.common import pick, stream

LEVEL = 3
CHUNK_BYTES = 2048
#: floor(log2 of the bytes) -> least and largest ratio of a whole document. Shorter documents take the first, longer the last.
#: Set from the labelled quality of documents, with a margin beside the range of good ones.
#: No labelled document is longer than 2^15 bytes: the bands from 2^16 on are set from clean documents joined, in each language.
#: The last begins at the window of the level (2 MB), beyond which the ratio no longer falls with length.
BANDS = {6: (0.62, 1.25), 7: (0.53, 1.0), 8: (0.51, 0.85), 9: (0.48, 0.78), 10: (0.445, 0.68), 11: (0.435, 0.60), 12: (0.412, 0.56), 13: (0.398, 0.53), 14: (0.385, 0.52), 15: (0.375, 0.52), 16: (0.355, 0.52), 17: (0.35, 0.52), 18: (0.335, 0.52), 19: (0.33, 0.52), 20: (0.325, 0.52), 21: (0.315, 0.52)}
#: The same for chunks, and the share of chunks that may lie outside.
CHUNK_BAND = (0.45, 0.62)
CHUNK_SHARE = 0.3
#: Fewer bytes than this have no meaningful ratio: only the base rules hold.
LEAST_BYTES = 64

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ : bytes.split() splits on exactly these six ASCII characters."""
    return text.encode("utf-8", "surrogatepass").split()


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = words(text)
    n = len(ws)
    chars = len(b"".join(ws).decode("utf-8", "surrogatepass"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
        k = len(number)
        if k < 2_000_000:  # (k^3 fits 64 bits)
            win = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:
            first = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
            win = first * k + ids[2:]
        _, back, count = np.unique(win, return_inverse=True, return_counts=True)
        hit = count[back] >= 2
        in_word = np.zeros(n, bool)
        for shift in range(3):
            in_word[shift : n - 2 + shift] |= hit
        repeat = int(in_word.sum())
    return n, chars, len(_SYMBOLS.findall(text.encode("utf-8", "surrogatepass"))), dup, repeat


def band_of(n_bytes: int) -> tuple[float, float]:
    return BANDS[min(max(n_bytes.bit_length() - 1, min(BANDS)), max(BANDS))]


def verdict(raw: bytes, compress) -> tuple[bool, float | None, float | None]:
    """kept, ratio of the whole, share of chunks outside their band. A last part shorter than a chunk has the band of documents of
    its length; one below LEAST_BYTES counts only in the whole."""
    if len(raw) < LEAST_BYTES:
        return True, None, None
    low, high = band_of(len(raw))
    ratio = len(compress(raw)) / len(raw)
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
    bands = [(len(compress(c)) / len(c), CHUNK_BAND if len(c) == CHUNK_BYTES else band_of(len(c))) for c in chunks if len(c) >= LEAST_BYTES]
    outside = sum(not lo <= r <= hi for r, (lo, hi) in bands) / len(bands)
    return low <= ratio <= high and outside <= CHUNK_SHARE, ratio, outside


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, ratios and kept, per document."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for i, t in zip(ids, texts):
            n, chars, symbols, dup, repeat = base_counts(t or "")
            failed = n < 50 or 100 * repeat > 50 * n
            good, ratio, outside = verdict((t or "").encode("utf-8", "surrogatepass"), compress)
            yield i, n, chars, symbols, dup, repeat, failed, not failed and good, ratio, outside

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside double")


def keep(docs: DataFrame, base_rules: bool = True) -> DataFrame:
    """The rows of docs (all their columns) whose text lies in the bands, and passes the base rules where these are wanted.
    base_rules=False judges by the bands alone, so that short texts stay."""

    names = docs.columns
    at = names.index("text")

    def run(*cols: list) -> Iterator[tuple]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for row in zip(*cols):
            t = row[at] or ""
            if verdict(t.encode("utf-8", "surrogatepass"), compress)[0]:
                n, _, _, _, repeat = base_counts(t) if base_rules else (50, 0, 0, 0, 0)
                if n >= 50 and 100 * repeat <= 50 * n:
                    yield row

    return stream(docs, run, docs.schema)
