"""Quality rules: how far a document's histograms diverge from its language's reference.

Two histograms describe a text: its characters by class (vowels, consonants, capitals,
digits, blanks, line breaks, punctuation, symbols, other, beyond ASCII), and its words among
the ``COMMON`` most frequent ones of its language, all others in one last bin. The references
are the same histograms counted over all documents of the language. Jensen-Shannon distance
(square root of the divergence in bits) compares them; a distance is only judged if the text
is long enough for its histogram to mean something.

Defined cases: a null text counts as empty. Texts below the minimum lengths get a null
distance and are not judged by it. A null language is a language of its own. The
``LANGUAGES`` languages with most words have references; all others share one pooled over
the whole table. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import stored, table

COMMON = 64
LANGUAGES = 256
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45

#: Fixed values of the contract.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_WORDS = 50
BASE_REPEAT = 50

_CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", ".,;:!?'\"()-", SYMBOLS]
_OTHER, _BEYOND, _INNER = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
_CLASS_OF = np.full(256, _OTHER, np.uint8)
for _k, _letters in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _letters]] = _k
_CLASS_OF[0x80:0xC0] = _INNER  # the later bytes of a character
_CLASS_OF[0xC0:] = _BEYOND
N_CLASSES = _INNER
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def folded_words(raw: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return raw.translate(_FOLD).split()


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms: 0 if proportional, 1 if they share no bin."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    bits = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return float(np.sqrt(max(0.0, (bits(p) + bits(q)) / 2)))


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    common: dict[bytes, int]
    words: np.ndarray

    def distances(self, raw: bytes, n_chars: int, n_words: int) -> tuple[float | None, float | None]:
        by_class = by_word = None
        if n_chars >= MIN_CHARS and self.classes.sum():
            by_class = jensen_shannon(class_counts(raw), self.classes)
        if n_words >= MIN_WORDS and self.words.sum():
            found = Counter(folded_words(raw))
            counts = np.zeros(len(self.words))
            for word, k in self.common.items():
                counts[k] = found.get(word, 0)
            counts[-1] = sum(found.values()) - counts.sum()
            if counts.sum():
                by_word = jensen_shannon(counts, self.words)
        return by_class, by_word


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, item, n): characters by class and words, summed over a batch."""
    for batch in batches:
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            words.setdefault(lang, Counter()).update(folded_words(raw))
            classes[lang] = classes.get(lang, 0) + class_counts(raw)
        for lang in words:
            items = [str(k).encode() for k in range(N_CLASSES)] + list(words[lang])
            n = [*map(int, classes[lang]), *words[lang].values()]
            kinds = np.repeat(["class", "word"], [N_CLASSES, len(items) - N_CLASSES])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(kinds, pa.string()), pa.array(items, pa.binary()), pa.array(n, pa.int64())],
                ["lang", "kind", "item", "n"],
            )


def references(docs: DataFrame, language: str = "lang", text: str = "text") -> dict[str | None, Reference]:
    """Reference histograms by language, and the pooled one under the key ``""``.

    All documents are counted. Only the most frequent words of the ``LANGUAGES`` largest
    languages come to the driver, a number bounded by the two parameters.
    """
    # Stored: both the words and their totals are read from it.
    counts = stored(
        docs.select(F.col(language).cast("string").alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_tally, "lang string, kind string, item binary, n long")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n")),
        "rules-counts",
    )
    by_kind = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "item")
    top = counts.withColumn("at", F.row_number().over(by_kind)).where(F.col("at") <= max(COMMON, N_CLASSES))
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    largest = totals.where("kind = 'word'").orderBy(F.col("total").desc(), "lang").limit(LANGUAGES)
    rows = (
        top.join(totals, (top["lang"].eqNullSafe(totals["lang"])) & (top["kind"] == totals["kind"]))
        .join(F.broadcast(largest.select(F.col("lang").alias("_lang"))), top["lang"].eqNullSafe(F.col("_lang")), "left_semi")
        .select(top["lang"], top["kind"], "item", "n", "at", "total")
        .collect()
    )
    found = {lang: _reference([r for r in rows if r["lang"] == lang]) for lang in {r["lang"] for r in rows}}
    pooled = Counter()
    for r in rows:
        pooled[r["kind"], bytes(r["item"])] += r["n"]
    whole = sum({(r["lang"]): r["total"] for r in rows if r["kind"] == "word"}.values())
    found[""] = _histograms({i: n for (k, i), n in pooled.items() if k == "class"}, {i: n for (k, i), n in pooled.most_common() if k == "word"}, whole)
    return found


def _reference(rows: list) -> Reference:
    words = {bytes(r["item"]): r["n"] for r in sorted(rows, key=lambda r: r["at"]) if r["kind"] == "word"}
    total = next((r["total"] for r in rows if r["kind"] == "word"), 0)
    return _histograms({bytes(r["item"]): r["n"] for r in rows if r["kind"] == "class"}, words, total)


def _histograms(classes: dict[bytes, int], words: dict[bytes, int], total: int) -> Reference:
    common = list(words)[:COMMON]
    counts = [words[w] for w in common]
    return Reference(
        np.array([classes.get(str(k).encode(), 0) for k in range(N_CLASSES)], float),
        {w: k for k, w in enumerate(common)},
        np.array([*counts, total - sum(counts)], float),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, windows, n = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[windows] >= 2)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def base_counts(text: str) -> tuple[bytes, int, int, int, int, int]:
    """The text's bytes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        raw,
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def judge(docs: DataFrame, by_language: dict[str | None, Reference], language: str = "lang", text: str = "text", identity: str = "doc_id") -> DataFrame:
    """One row a document: its counts, both distances and whether it is kept."""
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.col(language).cast("string"), F.col(text))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, n, chars, *rest, repeated = base_counts(text or "")
                failed = n < BASE_WORDS or 100 * repeated > BASE_REPEAT * n
                by_class, by_word = by_language.get(lang, by_language[""]).distances(raw, chars, n)
                fits = (by_class is None or by_class <= MAX_CLASS_DISTANCE) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
                out.append((n, chars, *rest, repeated, failed, by_class, by_word, fits and not failed))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[f.split()[0] for f in RESULT.split(", ")]])

    return rows.mapInArrow(run, f"doc_id long, {RESULT}")


@query("op5_divergence_rules")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return judge(docs, references(docs))
