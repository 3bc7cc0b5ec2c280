"""Operator 1: hierarchical multi-length packing.

Documents are routed to context-size tiers, every tier is packed, gaps of long windows are filled from shorter tiers, and
the sequences are dealt to step groups of equal token counts.

* A document's tokens (and its end id) are cut into whole windows of the largest tier; what is left is routed to the
  smallest tier that holds it.
* A tier's window is opened by its longest piece, filled best-fit with pieces of this tier, then of shorter tiers, and
  closed exactly by cutting one more piece. So a window has no padding.
* What is left at the end of a task is cut into powers of two, which count to the smallest tier that holds them.
* A step group holds sequences of one tier, at most `step_tokens` tokens of them. The last two groups of a tier in a task are
  dealt anew at its end, longest sequences first, so that they are equally full: no group of a task that has several in a
  tier is under half full.

Each task packs its own input partition: no shuffle, no key, so no key can be hot. Sequence and step ids join the
partition's number to a counter; a task that is run again reads the same rows and gives the same ids.

Defined results: a null or empty text is one end id; repeated rows are packed as often as they occur; a null doc_id stays
null; extra columns are ignored; an empty table gives no pieces. Very long texts are encoded whole.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from brindle.llm.chunk_table import ChunkTable
from brindle.llm.common import pick, stream_task, warm

TIERS = (256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 65_536
#: Tokens of waiting pieces in a task before it packs them; bounds memory.
POOL_TOKENS = 1 << 20
END_ID = 0
#: Chunks remembered by one Python worker; a fuller memory is emptied.
MEMORY_CHUNKS = 1_000_000
_IRREGULAR = re.compile(r"\s \s|  ")
#: Necessary for that, and much faster to look for.
_SPACED = re.compile(r" \s")

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class TokenizerChunks:
    """ids of whole texts as the tokenizers library gives them. Texts are split at single spaces between two non-space
    characters and the library encodes each distinct chunk once; a text with other spacing, or with one of the vocabulary's
    special strings, goes to the library as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core: the library's threads would take those of other tasks, and each keeps memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.table = ChunkTable(self._learn, MEMORY_CHUNKS)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        #: bytes of each id: a byte-level vocabulary writes each byte as one character
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for k, v in vocab.items():
            self.widths[v] = len(k)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct chunks with a space before each, many to a call: the ids of the joined text are dealt back by their
        byte lengths. Chunks that begin or end in other white space are encoded alone, since neighbours could change their words."""
        alone = [i for i, c in enumerate(chunks) if not c or c != c.strip()]
        apart = set(alone)
        joint = [i for i in range(len(chunks)) if i not in apart]
        groups = [[i] for i in alone] + [joint[at : at + 512] for at in range(0, len(joint), 512)]
        start, size, done = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64), 0
        encoded = self._encode([" " + " ".join([chunks[i] for i in g]) for g in groups])
        for group, ids in zip(groups, encoded):
            ends = np.cumsum([len(chunks[i].encode("utf-8", "surrogatepass")) + 1 for i in group])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends, "left") + 1
            start[group], size[group] = done + np.append(0, cuts[:-1]), np.diff(cuts, prepend=0)
            done += len(ids)
        return np.concatenate(encoded), start, size

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [bool(t) and not (_SPACED.search(t) and _IRREGULAR.search(t)) and not any(x in t for x in self.special) for t in texts]
        parts = [t.partition(" ") if regular else (t, "", "") for t, regular in zip(texts, split)]
        # a text's first chunk has no space before it: it is encoded with the texts that cannot be split
        whole = self._encode([p[0] for p in parts])
        rest = iter(self.table([p[2].encode("utf-8", "surrogatepass") for p in parts if p[1]]))
        return [w.tobytes() + (next(rest).tobytes() if p[1] else b"") for w, p in zip(whole, parts)]


def chunk_encoder(path: str) -> TokenizerChunks:
    return warm("packing", path, lambda: TokenizerChunks(path))


class Packer:
    """Packs the pieces of one task. A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
        self.tiers, self.step_tokens, self.with_ids = tuple(sorted(tiers)), step_tokens, with_ids
        self.next_seq = self.next_step = task << 36
        self.pools: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.waiting = 0
        #: the last groups of each tier: lists of (tokens, rows) of a sequence
        self.steps: dict[int, list[list[tuple[int, list[tuple]]]]] = {t: [] for t in self.tiers}
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        top, n = self.tiers[-1], len(ids) // 4
        whole = n - n % top
        for start in range(0, whole, top):
            self.emit([(doc_id, start, ids[start * 4 : (start + top) * 4], n)])
        if n > whole:
            self.route((doc_id, whole, ids[whole * 4 :], n))
        if self.waiting >= POOL_TOKENS:
            self.pack(final=False)

    def route(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pools[self.tiers[bisect.bisect_left(self.tiers, n)]].append(piece)
        self.waiting += n

    def emit(self, pieces: list[tuple]) -> None:
        """A sequence of pieces, to the last step group of its tier that has room."""
        seq, offset, total = self.next_seq, 0, sum(len(p[2]) for p in pieces) // 4
        self.next_seq += 1
        tier = self.tiers[bisect.bisect_left(self.tiers, total)]
        rows = []
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, seq, offset, tier, ids))
            offset += len(ids) // 4
        groups = self.steps[tier]
        if not groups or sum(n for n, _ in groups[-1]) + total > self.step_tokens:
            if len(groups) == 2:
                self.close(groups.pop(0))
            groups.append([])
        groups[-1].append((total, rows))

    def close(self, group: list[tuple[int, list[tuple]]]) -> None:
        for _, rows in group:
            for *row, ids in rows:
                self.out.append((*row, self.next_step, ids) if self.with_ids else (*row, self.next_step))
        self.next_step += 1

    def finish(self) -> None:
        """Pack what waits and deal each tier's last groups evenly."""
        self.pack(final=True)
        for tier, groups in self.steps.items():
            every = sorted((s for g in groups for s in g), key=lambda s: -s[0])
            even: list[list] = [[] for _ in groups]
            for sequence in every:
                min(even, key=lambda g: sum(n for n, _ in g)).append(sequence)
            for group in even:
                self.close(group)
            self.steps[tier] = []

    def pack(self, final: bool) -> None:
        """Tiers from long to short. Before the end of the task only windows that close exactly are emitted."""
        size = lambda p: len(p[2]) // 4
        pools = {t: sorted(v, key=size) for t, v in self.pools.items()}
        sizes = {t: [size(p) for p in v] for t, v in pools.items()}
        self.pools, self.waiting = {t: [] for t in self.tiers}, 0

        def take(t: int, i: int) -> tuple:
            sizes[t].pop(i)
            return pools[t].pop(i)

        for at in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[at]
            while pools[tier]:
                window = [take(tier, len(pools[tier]) - 1)]
                gap = tier - size(window[0])
                for t in reversed(self.tiers[: at + 1]):
                    while gap and (i := bisect.bisect_right(sizes[t], gap) - 1) >= 0:
                        window.append(take(t, i))
                        gap -= size(window[-1])
                if gap and (t := next((t for t in self.tiers[: at + 1] if pools[t]), None)):
                    # the least piece left is longer than the gap: cut it, its rest waits in its own tier
                    doc_id, start, ids, n = take(t, 0)
                    window.append((doc_id, start, ids[: gap * 4], n))
                    rest = (doc_id, start + gap, ids[gap * 4 :], n)
                    home = self.tiers[bisect.bisect_left(self.tiers, size(rest))]
                    i = bisect.bisect_left(sizes[home], size(rest))
                    sizes[home].insert(i, size(rest))
                    pools[home].insert(i, rest)
                    gap = 0
                if not gap:
                    self.emit(window)
                elif final:
                    self.powers(window)
                else:
                    for p in window:
                        self.route(p)

    def powers(self, window: list[tuple]) -> None:
        """Cut a window that nothing can fill into sequences whose lengths are powers of two."""
        total = sum(len(p[2]) for p in window) // 4
        queue = window[::-1]
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            row = []
            while want:
                doc_id, start, ids, n = queue.pop()
                k = len(ids) // 4
                if k > want:
                    queue.append((doc_id, start + want, ids[want * 4 :], n))
                    ids, k = ids[: want * 4], want
                row.append((doc_id, start, ids, n))
                want -= k
            self.emit(row)

    def flush(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences; with_ids adds each piece's ids (little-endian unsigned 32-bit)."""

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        end = np.array([END_ID], "<u4").tobytes()
        packer, encode = Packer(TaskContext.get().partitionId(), tiers, step_tokens, with_ids), chunk_encoder(path)
        for doc_ids, texts in slices:
            for doc_id, ids in zip(doc_ids, encode([t or "" for t in texts])):
                packer.add(doc_id, ids + end)
            yield packer.flush()
        packer.finish()
        yield packer.flush()

    return stream_task(pick(docs, ("doc_id", "long"), ("text", "string")), task, PIECE + (", ids binary" if with_ids else ""), keep="packing")
