"""Operator 9: secret scans by grammar inference.

Labelled credentials of each format are put into a prefix tree; statistically compatible states are merged (ALERGIA with
Hoeffding bounds) into a probabilistic automaton; every candidate string of a text is scored by its likelihood under each
automaton against a background of even characters. Candidates begin at the start of a run of credential characters, after a
separator in it, and wherever a format's literal beginning stands; they end where the automaton accepts. A candidate above the
threshold gives a span of kind `grammar`, up to the last end that its automaton accepts.

The base kinds assign, access and hex are fixed patterns and always stay; they are cut out of grammar spans.

One pass over whole texts without a shuffle. Defined results: a null or empty text has no spans; repeated rows are scanned
alike; extra columns are ignored (kept by `redact`); an empty table stays empty. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from brindle.llm.common import pick, stream

KINDS = ("assign", "access", "hex", "grammar")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_RUN = re.compile(r"[0-9a-f]{32}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}+")
_SEPARATOR = re.compile(r"[=/.+-]")
#: Characters of the shortest candidate.
LEAST = 16

_ALNUM = string.ascii_letters + string.digits
#: Formats of the labelled credentials: (name, parts); a part is a literal or (alphabet, length). Fixed values.
FORMATS = (
    ("code_host_token", ("ghp_", (_ALNUM, 36))),
    ("code_host_app", ("gho_", (_ALNUM, 36))),
    ("payment_live", ("sk_live_", (_ALNUM, 24))),
    ("payment_test", ("sk_test_", (_ALNUM, 24))),
    ("chat_bot", ("xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (_ALNUM, 24))),
    ("maps_key", ("AIza", (_ALNUM + "-_", 35))),
    ("package_token", ("npm_", (_ALNUM, 36))),
    ("mail_key", ("SG.", (_ALNUM + "-_", 22), ".", (_ALNUM + "-_", 43))),
    ("pipeline_token", ("glpat-", (_ALNUM + "-_", 20))),
    ("web_token", ("eyJhbGciOi", (_ALNUM, 26), ".eyJ", (_ALNUM, 40), ".", (_ALNUM + "-_", 43))),
)
LABELLED_PER_FORMAT = 60
ALPHA = 0.05
#: Nats above an even background over 65 characters that make a candidate a credential.
THRESHOLD = 11.0
BACKGROUND = math.log(65)
#: Log-likelihood of a string that an automaton cannot produce.
REJECTED = -1e9


def labelled_credentials(per_format: int = LABELLED_PER_FORMAT) -> dict[str, list[str]]:
    """The small labelled table: made-up credentials of each format, the same on every machine."""
    r = random.Random(7)
    return {name: ["".join(p if isinstance(p, str) else "".join(r.choice(p[0]) for _ in range(p[1])) for p in parts) for _ in range(per_format)] for name, parts in FORMATS}


def _class(c: str) -> tuple[str, int]:
    """A character's class and the number of characters in it, for smoothing."""
    if c.isdigit():
        return "digit", 10
    if c.islower():
        return "lower", 26
    return ("upper", 26) if c.isupper() else (c, 1)


class Automaton:
    """Deterministic probabilistic automaton learned by merging prefix-tree states (ALERGIA).

    Transitions go by character class; each transition keeps the counts of its characters, so that a literal part stays a
    chain of states with one likely character each, and a random part becomes a state that loops."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for w in words:
            s = 0
            for c in w:
                self.count[s][c] += 1
                kind = _class(c)[0]
                if kind not in self.next[s]:
                    self.next[s][kind] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                s = self.next[s][kind]
            self.ends[s] += 1
        self.states = self._merge_states()
        self._steps: dict[tuple[int, str], tuple[float, int] | None] = {}

    def total(self, s: int) -> int:
        return self.ends[s] + sum(self.count[s].values())

    def _of_kind(self, s: int, kind: str) -> int:
        return sum(v for c, v in self.count[s].items() if _class(c)[0] == kind)

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        """Ends, classes and characters of both states, and of what follows them in q's tree, within Hoeffding's bound."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total(p), self.total(q)
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for kind in {*self.next[p], *self.next[q]}:
                if self._differ(self._of_kind(p, kind), n, self._of_kind(q, kind), m):
                    return False
                if kind in self.next[p] and kind in self.next[q] and self.next[p][kind] != self.next[q][kind]:
                    todo.append((self.next[p][kind], self.next[q][kind]))
            for c in {*self.count[p], *self.count[q]}:
                if self._differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, v in self.count[q].items():
                self.count[p][c] += v
            for kind, t in self.next[q].items():
                if kind in self.next[p]:
                    todo.append((self.next[p][kind], t))
                else:
                    self.next[p][kind] = t

    def _merge_states(self) -> list[int]:
        red = [0]
        while True:
            blue = {t: (s, kind) for s in red for kind, t in self.next[s].items() if t not in red}
            if not blue:
                return red
            q = max(blue, key=lambda t: (self.total(t), -t))
            parent, kind = blue[q]
            for p in (parent, *(r for r in reversed(red) if r != parent)):
                if self._compatible(p, q):
                    self.next[parent][kind] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)

    def _step(self, s: int, c: str) -> tuple[float, int] | None:
        """Witten-Bell smoothing: the characters seen in a class at a state, then the whole class evenly."""
        if (s, c) not in self._steps:
            kind, width = _class(c)
            if kind not in self.next[s]:
                self._steps[s, c] = None
            else:
                in_kind, kinds = self._of_kind(s, kind), sum(_class(x)[0] == kind for x in self.count[s])
                p = math.log(in_kind / self.total(s)) + math.log((self.count[s].get(c, 0) + kinds / width) / (in_kind + kinds))
                self._steps[s, c] = p, self.next[s][kind]
        return self._steps[s, c]

    def log_likelihood(self, word: str) -> float:
        s, out = 0, 0.0
        for c in word:
            step = self._step(s, c)
            if step is None:
                return REJECTED
            out += step[0]
            s = step[1]
        return out + (math.log(self.ends[s] / self.total(s)) if self.ends[s] else REJECTED)

    def literal(self) -> str:
        """The one string with which all labelled words begin."""
        s, out, seen = 0, "", set()
        while s not in seen and not self.ends[s] and len(self.count[s]) == 1:
            seen.add(s)
            c = next(iter(self.count[s]))
            out += c
            s = self.next[s][_class(c)[0]]
        return out

    def reach(self, word: str, at: int) -> tuple[float, int]:
        """The best score of word[at:end] over the accepted ends that leave LEAST characters, and the last of these ends."""
        s, out, best, last = 0, 0.0, REJECTED, at
        for i in range(at, len(word)):
            step = self._step(s, word[i])
            if step is None:
                break
            out += step[0]
            s = step[1]
            if self.ends[s] and i + 1 - at >= LEAST:
                best, last = max(best, out + math.log(self.ends[s] / self.total(s)) + BACKGROUND * (i + 2 - at)), i + 1
        return best, last


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    """One automaton per labelled format; learned once per process in well under a second."""
    return {name: Automaton(words) for name, words in labelled_credentials().items()}


@lru_cache(maxsize=1)
def beginnings() -> re.Pattern:
    """Finds every place where the literal beginning of a format stands."""
    return re.compile("(?=" + "|".join(re.escape(x) for x in sorted({a.literal() for a in automata().values()} - {""})) + ")")


def score(candidate: str) -> tuple[float, str]:
    """Nats by which the likeliest format beats the background, and the format."""
    even = -BACKGROUND * (len(candidate) + 1)
    return max((a.log_likelihood(candidate) - even, name) for name, a in automata().items())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end) of the base kinds."""
    low, out = text.lower() if text.isascii() else text.translate(_LOWER), []
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    at = 0
    while m := _HEX_RUN.search(text, at):  # a run of 32 is found first; the whole run starts there, as it is leftmost
        whole = _HEX.match(text, m.start())
        out.append((m.start(), 2, whole.end()))
        at = whole.end()
    return sorted(out)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _credentials(word: str) -> list[tuple[int, int]]:
    """(start, end) of the credentials in a run; one that begins inside another ends it, unless it lies within it."""
    out: list[tuple[int, int]] = []
    for at in sorted({0, *(m.end() for m in _SEPARATOR.finditer(word)), *(m.start() for m in beginnings().finditer(word))}):
        if len(word) - at < LEAST:
            break
        end = max((last for best, last in (a.reach(word, at) for a in automata().values()) if best >= THRESHOLD), default=at)
        if end > (out[-1][1] if out else 0):
            if out and at < out[-1][1]:
                out[-1] = out[-1][0], at
            out.append((at, end))
    return out


def grammar_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for m in _RUN.finditer(text):
        word = m[0].rstrip(".=-")
        if len(word) < LEAST:
            continue
        for start, end in _credentials(word):
            at, end = m.start() + start, m.start() + end
            for s, _, e in taken:  # sorted by their starts
                if s < end and at < e:
                    if at < s:
                        out.append((at, 3, s))
                    at = e
            if at < end:
                out.append((at, 3, end))
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, per document."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            base = base_spans(t or "")
            every = sorted(base + grammar_spans(t or "", base))
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            yield i, *n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)

    return stream(pick(docs, ("doc_id", "long"), ("text", "string")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans together) and n_chars counted anew where it exists."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(*cols: list) -> Iterator[tuple]:
        for row in zip(*cols):
            t = row[at]
            base = base_spans(t or "")
            spans = sorted(base + grammar_spans(t or "", base))
            if spans:
                out, done = [], 0
                for s, _, e in spans:
                    if s >= done:
                        out += [t[done:s], mark]
                    done = max(done, e)
                row = list(row)
                row[at] = "".join([*out, t[done:]])
                if size is not None:
                    row[size] = len(row[at])
                row = tuple(row)
            yield row

    return stream(docs, run, docs.schema)
