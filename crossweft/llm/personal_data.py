"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

The patterns of the contract give the base spans. The field labels words that hold a digit,
an ``@`` or a ``+`` as email, ip, card, phone or none; all other words are none by
definition and cut the chain. Neighbouring words are linked, and so is each word with the
next one of the same letters and digits, or the same last seven digits, however far away.
Links of both kinds have potentials, and loopy belief propagation passes messages along them
for ``ROUNDS`` rounds, so an entity found in one place raises its repetitions in the whole
document. Words believed to be an entity with ``CERTAIN`` probability that touch no base
span become spans of their own.

Weights are learned by pseudolikelihood from the base spans of at most ``SAMPLE`` documents
(those with the smallest hash of their id among documents with an evident character, and of
each the first ``SAMPLE_WORDS`` such words); only these bounded numbers reach the driver.
Labelling is one scan of all texts without a shuffle.

Defined cases: a null text counts as empty and has no spans. Offsets are code points, the
end exclusive. Without any word to learn from nothing is added to the base spans. Rows
without an id are labelled, never learned from. Repeated rows are labelled alike. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import sampled_rows, table

SAMPLE = 4_000
SAMPLE_WORDS = 200
ROUNDS = 8
CERTAIN = 0.95
DAMPING = 0.5
#: Where the skip potentials start and what the penalty pulls them to: linked words agree.
AGREEMENT = 3.0

#: Fixed values of the contract: the kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BLANKS = frozenset(" \t\n\x0b\x0c\r")
_EVIDENT = re.compile(r"[0-9@+]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_WORD = re.compile(r"[^0-9A-Za-z@]")
_TRIM = ".,;:!?()[]{}<>\"'|"

Span = tuple[int, int, int]  # start, stop, kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from the @ outwards in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Valid matches of all kinds by start, then kind."""
    if not _EVIDENT.search(text):
        return []
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def evident_words(text: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit, an @ or a +."""
    out, at = [], 0
    while hit := _EVIDENT.search(text, at):
        start = hit.start()
        while start > at and text[start - 1] not in _BLANKS:
            start -= 1
        blank = _BLANK.search(text, hit.end())
        at = blank.start() if blank else len(text)
        out.append((start, at))
    return out


CONTEXTS = 64
SHAPES = 32
FEATURES = SHAPES + CONTEXTS


@dataclass
class Graph:
    """Words of one text: spans, active features of each, and the two kinds of links."""

    words: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def graph(text: str) -> Graph:
    g = Graph(evident_words(text))
    last_of: dict[str, int] = {}
    run_digits = np.zeros(len(g.words), int)
    for k, (a, b) in enumerate(g.words):
        run_digits[k] = sum("0" <= c <= "9" for c in text[a:b])
        if k and not text[g.words[k - 1][1] : a].strip(" \t\n\x0b\x0c\r"):
            g.chain.append((k - 1, k))
    own = run_digits.copy()
    linked = {b for _, b in g.chain}
    first = 0
    for k in range(1, len(g.words) + 1):
        if k not in linked:  # a run of neighbours ends: each gets the digits of all
            run_digits[first:k] = own[first:k].sum()
            first = k
    for k, (a, b) in enumerate(g.words):
        word = text[a:b]
        bare = word.strip(_TRIM)
        at = bare.find("@")
        parts = bare.split(".")
        ip_like = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
        f = [0]
        f += [1] if at > 0 else []
        f += [2] if at > 0 and "." in bare[at:] else []
        f += [3] if bare.startswith("+") else []
        f += [4] if ip_like else []
        f += [5] if ip_like and all(len(p) <= 3 and int(p) <= 255 for p in parts) else []
        f += [6] if any(c.isalpha() for c in bare) else []
        f += [7] if not _NOT_DIGIT.sub("", bare) else []
        digits = _NOT_DIGIT.sub("", bare)
        f += [8] if 14 <= len(digits) <= 19 and luhn(digits) else []
        f.append(9 + _bucket(len(digits), (1, 3, 5, 7, 10, 14, 20)))  # 9..16
        f.append(17 + _bucket(int(run_digits[k]), (3, 7, 10, 14, 20)))  # 17..22
        f += [23] if "-" in bare else []
        f += [24] if "(" in word else []
        before = text[max(0, a - 40) : a].split()
        context = before[-1].strip(_TRIM).lower() if before else ""
        f.append(SHAPES + int.from_bytes(hashlib.blake2b(context.encode(), digest_size=2).digest(), "big") % CONTEXTS)
        g.features.append(f)
        same = _NOT_WORD.sub("", bare).lower()
        keys = ([f"w{same}"] if len(same) >= 3 else []) + ([f"d{digits[-7:]}"] if len(digits) >= 7 else [])
        for other in {last_of[key] for key in keys if key in last_of}:
            g.skip.append((other, k))
        last_of.update((key, k) for key in keys)
    return g


def labels_of(words: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """1 + kind of the first base span that each word overlaps, else 0."""
    out, by_start, at = np.zeros(len(words), int), sorted(spans), 0
    for k, (a, b) in enumerate(words):
        while at < len(by_start) and by_start[at][1] <= a:
            at += 1
        for start, stop, kind in by_start[at:]:
            if start >= b:
                break
            if stop > a:
                out[k] = kind + 1
                break
    return out


N = len(KINDS) + 1


@dataclass(frozen=True)
class Field:
    """Weights: of features by label, of neighbours' labels (left, right), of linked labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, graphs: list[Graph]) -> np.ndarray:
        """Label probabilities of all words of several texts, by loopy belief propagation."""
        offset = np.cumsum([0, *[len(g.words) for g in graphs]])
        n = int(offset[-1])
        rows = [f for g in graphs for f in g.features]
        at = np.repeat(np.arange(n), [len(f) for f in rows])
        base = np.zeros((n, N))
        np.add.at(base, at, self.unary[[x for f in rows for x in f]])
        links = [[(a + o, b + o) for g, o in zip(graphs, offset) for a, b in getattr(g, kind)] for kind in ("chain", "skip")]
        pairs = np.array(links[0] + links[1], np.int64).reshape(-1, 2)
        m = len(pairs)
        table_ = np.concatenate([np.repeat(self.chain[None], len(links[0]), 0), np.repeat(self.skip[None], len(links[1]), 0)])
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([table_, table_.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)]) if m else np.zeros(0, np.int64)
        message = np.zeros((2 * m, N))
        for _ in range(ROUNDS if m else 0):
            belief = base.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + potential
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = base
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def _examples(text: str) -> list[list[int]]:
    """For training: label, then active columns (features, neighbours' labels) of each word."""
    g = graph(text)
    y = labels_of(g.words, base_spans(text))
    columns = [list(f) for f in g.features]
    for a, b in g.chain:
        columns[b].append(FEATURES + y[a])
        columns[a].append(FEATURES + N + y[b])
    for a, b in g.skip:
        columns[b].append(FEATURES + 2 * N + y[a])
        columns[a].append(FEATURES + 2 * N + y[b])
    return [[int(y[k]), *map(int, c)] for k, c in enumerate(columns[:SAMPLE_WORDS])]


def pseudolikelihood(rows: list[list[int]], steps: int = 300, penalty: float = 1e-3) -> Field | None:
    """Weights under which each word's label, given its neighbours' labels, is most likely.

    Both ends of a chain link share one table, seen from the left and from the right.
    """
    if not rows:
        return None
    width = FEATURES + 3 * N
    y = np.array([r[0] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) - 1 for r in rows])
    column = np.array([c for r in rows for c in r[1:]])
    weights, speed = np.zeros((width, N)), np.zeros((width, N))
    weights[FEATURES + 2 * N :] = AGREEMENT * np.eye(N)
    prior = weights.copy()
    rate = 1.0 / (1 + np.bincount(at).max())
    for _ in range(steps):
        score = np.zeros((len(rows), N))
        np.add.at(score, at, weights[column])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        gradient = np.zeros_like(weights)
        np.add.at(gradient, column, p[at] / len(y))
        left, right = gradient[FEATURES : FEATURES + N], gradient[FEATURES + N : FEATURES + 2 * N]
        shared = left + right.T
        gradient[FEATURES : FEATURES + N], gradient[FEATURES + N : FEATURES + 2 * N] = shared, shared.T
        linked = gradient[FEATURES + 2 * N :]
        gradient[FEATURES + 2 * N :] = linked + linked.T
        speed = 0.9 * speed - rate * (gradient + penalty * (weights - prior))
        weights = weights + speed
    return Field(weights[:FEATURES], weights[FEATURES : FEATURES + N], weights[FEATURES + 2 * N :])


def fit(docs: DataFrame, sample: int = SAMPLE, identity: str = "doc_id", text: str = "text") -> Field | None:
    rows = docs.select(F.col(identity).alias("_id"), F.col(text).alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").rlike("[0-9@+]"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            examples = [e for t in batch.column(0).to_pylist() for e in _examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array(examples, pa.list_(pa.int32()))], ["example"])

    seen = sampled_rows(rows, sample).select("_text").mapInArrow(run, "example array<int>")
    return pseudolikelihood(sorted(seen.toArrow()["example"].to_pylist()))


def added_spans(text: str, g: Graph, belief: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring words of one believed kind that touch no base span."""
    kind = belief.argmax(axis=1)
    kind[belief[np.arange(len(kind)), kind] < CERTAIN] = 0
    kind[labels_of(g.words, base) > 0] = 0
    out: list[Span] = []
    linked = set(g.chain)
    for k, (a, b) in enumerate(g.words):
        if not kind[k]:
            continue
        word = text[a:b]
        start = a + len(word) - len(word.lstrip(_TRIM))
        stop = b - (len(word) - len(word.rstrip(_TRIM)))
        if stop <= start:
            continue
        if out and (k - 1, k) in linked and kind[k - 1] == kind[k] and out[-1][2] == kind[k] - 1:
            out[-1] = (out[-1][0], stop, out[-1][2])
        else:
            out.append((start, stop, int(kind[k]) - 1))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, stop, kind in spans)


SLICE = 256  # texts whose words are labelled together


def find(docs: DataFrame, model: Field | None, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, base spans and all spans, as arrays of (kind, start, stop)."""
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.col(text))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in spans]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                whole = [list(b) for b in base]
                if model is not None:
                    graphs = [graph(t) for t in texts]
                    belief, begin = model.beliefs(graphs), 0
                    for k, g in enumerate(graphs):
                        stop = begin + len(g.words)
                        whole[k] = sorted(base[k] + added_spans(texts[k], g, belief[begin:stop], base[k]), key=lambda s: (s[0], s[2]))
                        begin = stop
                columns = [pa.array([as_rows(s) for s in spans], pa.list_(span)) for spans in (base, whole)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,stop:int>>"
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


@query("op8_personal_data")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find(docs, fit(docs))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
