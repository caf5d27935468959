"""Secrets by fixed patterns, and by automata inferred from the credentials these find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from math import log, sqrt
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.llm.common import carried, sampled

# The base patterns, their kinds in order, and the fewest characters.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "grammar")
ASSIGN_LEAST = 8
#: Documents, drawn by hash, whose base matches are the labelled credentials.
FIT_ROWS = 20_000
#: Distinct credentials of a kind from which an automaton is inferred, smallest hashes first.
FIT_VALUES = 1000
#: Kinds with fewer distinct credentials in the sample teach no grammar.
LEAST_VALUES = 50
#: Confidence of the compatibility test of two states.
ALPHA = 0.05
#: Share of the labelled credentials that may score below the line.
MISSED = 0.02
#: Candidates: token runs of at least 16 characters with a digit and a letter, or 16 capitals or digits.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]|[A-Z]{16})[A-Za-z0-9+/_=-]{16,}")
LETTER = re.compile(r"[A-Za-z]")
REDACTED = "[SECRET]"
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base matches, in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def kind_of(c: str) -> str:
    """The class of a character: what the automata branch on. Marks are classes of their own."""
    if c in "0123456789abcdef":
        return "x"
    return "a" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else c


@dataclass
class Automaton:
    """A probabilistic automaton over character classes. `moves` gives the state behind each
    class, `chars` the log probability of each character at a state, `ends` that of ending.

    A class never seen at a state costs `unseen` and leads back to the start.
    """

    moves: list[dict[str, int]]
    chars: list[dict[str, float]]
    ends: list[float]
    unseen: float
    line: float

    def score(self, text: str) -> float:
        """Mean log-likelihood a character, the end counted as one."""
        state, total = 0, 0.0
        for c in text:
            total += self.chars[state].get(c, self.unseen)
            state = self.moves[state].get(kind_of(c), 0)
        return (total + self.ends[state]) / (len(text) + 1)

    def accepts(self, text: str) -> bool:
        return self.score(text) >= self.line


class _Tree:
    """The prefix tree of labelled credentials by classes, with counts of characters and ends."""

    def __init__(self, samples: dict[str, int]):
        self.child: list[dict[str, int]] = [{}]
        self.count, self.end, self.chars = [0], [0], [{}]
        for word, n in sorted(samples.items()):
            at = 0
            self.count[0] += n
            for c in word:
                self.chars[at][c] = self.chars[at].get(c, 0) + n
                k = kind_of(c)
                if k not in self.child[at]:
                    self.child[at][k] = len(self.child)
                    self.child.append({})
                    self.count.append(0)
                    self.end.append(0)
                    self.chars.append({})
                at = self.child[at][k]
                self.count[at] += n
            self.end[at] += n

    def differ(self, x: int, y: int, bound: float) -> bool:
        """Whether ends, characters or classes of two states have shares beyond the Hoeffding bound."""
        n, m = self.count[x], self.count[y]
        most = bound * (1 / sqrt(n) + 1 / sqrt(m))
        if most >= 1:
            return False
        if abs(self.end[x] / n - self.end[y] / m) > most:
            return True
        for a, b in ((self.chars[x], self.chars[y]), (self.kinds(x), self.kinds(y))):
            if any(abs(a.get(c, 0) / n - b.get(c, 0) / m) > most for c in {*a, *b}):
                return True
        return False

    def kinds(self, x: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for c, n in self.chars[x].items():
            out[kind_of(c)] = out.get(kind_of(c), 0) + n
        return out

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """No state of the tree below `b` differs from the state that stands for it behind `a`."""
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if (x, y) in seen or not self.count[x] or not self.count[y]:
                continue
            seen.add((x, y))
            if self.differ(x, y, bound):
                return False
            todo += [(self.child[x][k], self.child[y][k]) for k in self.child[x].keys() & self.child[y].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below `b` to the automaton at `a`."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.count[x] += self.count[y]
            self.end[x] += self.end[y]
            for c, n in self.chars[y].items():
                self.chars[x][c] = self.chars[x].get(c, 0) + n
            for k, z in self.child[y].items():
                if k in self.child[x]:
                    todo.append((self.child[x][k], z))
                else:
                    self.child[x][k] = z


def infer(samples: dict[str, int], alpha: float = ALPHA) -> Automaton:
    """States of the samples' prefix tree, merged where their frequencies are compatible.

    `samples` counts credentials. In breadth-first order each state is compared with those kept
    so far: two are compatible when the shares of ending, of every character and of every class,
    and recursively those of the states behind, differ by less than the Hoeffding bound. A
    compatible state is folded into the kept one, else it is kept; so fixed letters and fixed
    lengths stay chains of states, and free stretches become loops.
    """
    tree = _Tree(samples)
    bound = sqrt(0.5 * log(2 / alpha))
    kept, edge = [0], [(0, k) for k in sorted(tree.child[0])]
    while edge:
        at, k = edge.pop(0)
        state = tree.child[at][k]
        if state in kept:
            continue
        for other in kept:
            if tree.compatible(other, state, bound):
                tree.child[at][k] = other
                tree.fold(other, state)
                edge = [(s, x) for s in kept for x in sorted(tree.child[s]) if tree.child[s][x] not in kept]
                break
        else:
            kept.append(state)
            edge += [(state, x) for x in sorted(tree.child[state])]
    name = {s: i for i, s in enumerate(kept)}
    alphabet = sorted({c for word in samples for c in word})
    moves, chars, ends = [], [], []
    for s in kept:
        # every character of a class that occurs at a state may occur there
        own = [c for c in alphabet if kind_of(c) in tree.child[s]]
        total = tree.count[s] + 0.5 * len(own) + 1
        moves.append({k: name[t] for k, t in tree.child[s].items()})
        chars.append({c: log((tree.chars[s].get(c, 0) + 0.5) / total) for c in own})
        ends.append(log((tree.end[s] + 1e-3) / total))
    found = Automaton(moves, chars, ends, log(1e-4), 0.0)
    return found


def fitted(samples: dict[str, int], alpha: float = ALPHA) -> Automaton:
    """The automaton of the samples, with the line at which it accepts: all but a small share of
    the samples lie above it. Samples flatter the automaton that they made; how much, two halves
    of them tell that judge each other, and the line is lower by half of that."""
    found = infer(samples, alpha)
    words = sorted(samples)
    gaps = []
    for own, other in ((words[::2], words[1::2]), (words[1::2], words[::2])):
        half = infer({w: samples[w] for w in own}, alpha)
        gaps.append(median(map(half.score, own)) - median(map(half.score, other)) if other else 0.0)
    scores = sorted(map(found.score, words))
    found.line = scores[int(MISSED * len(scores))] - max(0.0, sum(gaps) / 2) / 2
    return found


def labelled(docs: DataFrame, rows: int = FIT_ROWS, values: int = FIT_VALUES) -> dict[int, dict[str, int]]:
    """Credentials of each base kind in a sample of documents, with the number of documents that
    hold them; bounded on both sides. One pass over the sample finds all kinds."""
    sample = sampled(docs.select("doc_id", F.col("text").cast("string")), rows, "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                own = {(kind, ASSIGN.match(text, start).group(2) if kind == 0 else text[start:stop])
                       for start, kind, stop in base_spans(text)}
                kinds += [k for k, _ in own]
                found += [v for _, v in own]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(found, pa.string())], names=["kind", "value"])

    counts = sample.mapInArrow(run, "kind int, value string").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    out: dict[int, dict[str, int]] = {}
    for r in counts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= values).collect():
        out.setdefault(r["kind"], {})[r["value"]] = r["n"]
    return {k: dict(sorted(v.items())) for k, v in out.items()}


class Scanner:
    def __init__(self, automata: list[Automaton]):
        self.automata = automata
        self.accepts = lru_cache(50_000)(lambda word: any(a.accepts(word) for a in automata))

    def spans(self, text: str) -> list[Span]:
        """Base spans, and accepted candidates that meet none of them."""
        base = base_spans(text)
        if not self.automata:
            return base
        more = []
        for m in CANDIDATE.finditer(text):
            word = m.group()
            if LETTER.search(word) and self.accepts(word) and not any(
                    s < m.end() and m.start() < e for s, _, e in base):
                more.append((m.start(), 3, m.end()))
        return sorted(base + more)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """`text` with every stretch covered by spans replaced by a mark."""
    out, at = [], 0
    for start, _, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, stop)
    return "".join([*out, text[at:]])


FOUND = "struct<n_assign:long,n_access:long,n_hex:long,n_grammar:long,base_sha256:string,spans:string,clean:string>"
_TYPE = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("clean", pa.string())])


def find_secrets(docs: DataFrame, clean: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, n_grammar, base_sha256, spans and clean_text.

    The base patterns run over whole texts; automata inferred from a bounded sample of what
    they find score every candidate token. Spans count code points. clean_text is the text
    with secrets replaced, null where the text is null or `clean` is off. A null text is read as empty; equal texts
    have equal spans; rows without an id or repeated are scanned as any other; without labelled credentials only
    base spans are found. Columns of `docs` under the new names are replaced.
    """
    new = ["n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans", "clean_text"]
    automata = [fitted(v) for _, v in sorted(labelled(docs, fit_rows).items()) if len(v) >= LEAST_VALUES]

    kept: list[Scanner] = []

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Scanner(automata))  # one for all batches of a task
        scanner, out = kept[0], []
        for value in texts:
            text = value.as_py()
            spans = scanner.spans(text or "")
            base = [s for s in spans if s[1] < 3]
            kinds = [k for _, k, _ in spans]
            out.append((*(kinds.count(k) for k in range(4)), sha256(joined(base).encode()).hexdigest(), joined(spans),
                        redacted(text, spans) if clean and text is not None else None))
        return pa.StructArray.from_arrays(
            [pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 7, _TYPE)], fields=list(_TYPE))

    return docs.select(carried(docs, new), scan(F.col("text").cast("string")).alias("found")).select(
        "row.*", *[f"found.{c}" for c in new[:-1]], F.col("found.clean").alias("clean_text"))
