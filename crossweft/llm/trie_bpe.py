"""BPE encoding by prefix-sharing trie traversal, and decoding.

A text is cut into words by the vocabulary's splitting pattern. The distinct words of a
slice of documents go into a trie. The trie is walked depth first, and every node gets its
*last-token state*: the token in which the encoding of the node's prefix ends. That token is
the one token ending here that forms a valid pair with the last token of the prefix before
it; "valid" means that merging the two tokens' bytes by rank gives the two tokens back. An
Aho-Corasick automaton of the vocabulary walks along and lists the tokens that end at a node.
A prefix shared by many words is so encoded once, and a word's tokens are read off by walking
back from its end, token by token. Nothing depends on other documents, so there is no
shuffle; words met before are kept in a bounded cache, which is emptied when a task ends.
Decoding loads the bytes of the tokens alone.

Defined cases: a null text counts as empty and has no tokens. The special token's string in
a text becomes that token, as the tokenizers library does. An empty table gives an empty
result. All columns of the input are kept; one named like the new column is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweft.llm.registry import query
from crossweft.llm.tables import give_back, one_by_one, table

#: Unicode's White_Space, spelled out because regular expression libraries differ on it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value of byte-level vocabularies: how text is split before merging.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Bounds of what a worker remembers between slices (words: twice as many, with those from before),
#: and characters or tokens in a slice.
CACHED_WORDS = 200_000
CACHED_PAIRS = 300_000
CACHED_CHARS = 4_000_000
SLICE_CHARS = 500_000
SLICE_TOKENS = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Spelling:
    """The bytes of every token, which is all that decoding needs."""

    def __init__(self, path: str):
        self._spell(self._read(path))

    def _read(self, path: str) -> dict:
        with open(path, encoding="utf-8") as file:
            return json.load(file)

    def _spell(self, model: dict) -> None:
        names = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in model["added_tokens"]}
        back = {letter: b for b, letter in enumerate(byte_letters())}
        spelled = [bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = np.array([len(s) for s in spelled], np.int64)
        self.begin = np.cumsum(self.width) - self.width

    def name(self, token: int) -> bytes:
        return self.spelled[self.begin[token] : self.begin[token] + self.width[token]].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        width = self.width[ids]
        starts = np.cumsum(width) - width
        return self.spelled[np.repeat(self.begin[ids] - starts, width) + np.arange(width.sum())].tobytes()


class Vocabulary(Spelling):
    """Merge ranks, the automaton of the tokens, and the worker's bounded memory of words and pairs.

    Every worker holds one beside the executor's own memory, so all is by token id: the names
    and the merges as strings go when it is made.
    """

    def __init__(self, path: str):
        model = self._read(path)
        self._spell(model)
        ids: dict[str, int] = model["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Words met, and those met before the last time there was no room: rare ones go, common ones stay.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached_chars = 0
        self.pairs: dict[int, bool] = {}
        #: By two tokens, the first 32 bits up: the rank of their merge. By rank: the token it forms.
        self.pair_rank: dict[int, int] = {}
        self.forms = array("i")
        #: By token: rank of the merge that forms it (-1: a byte), its two parts, and whether
        #: merging its own bytes gives it (0: not tried, 1: yes, 2: no).
        n = len(self.width)
        self.formed, self.left, self.right, self.whole = array("i", [-1]) * n, array("i", [0]) * n, array("i", [0]) * n, bytearray(n)
        for r, (x, y) in enumerate(merges):
            self.pair_rank[ids[x] << 32 | ids[y]] = r
            self.forms.append(ids[x + y])
        for pair, r in self.pair_rank.items():
            token = self.forms[r]
            self.formed[token], self.left[token], self.right[token] = r, pair >> 32, pair & 0xFFFFFFFF
        self.byte_ids = [ids.get(letter, -1) for letter in byte_letters()]
        self._automaton(ids.values())

    def _automaton(self, tokens: Iterable[int]) -> None:
        """``goto`` (state and byte to state), ``fail`` (state to the longest other suffix) and
        ``ending``: (bytes, token) of all tokens that end in a state, longest first."""
        self.goto: dict[int, int] = {}
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        depths, edges = array("i", [0]), array("q", [0])  # by state: depth; parent and byte
        for token in tokens:
            state, name = 0, self.name(token)
            for depth, byte in enumerate(name):
                after = self.goto.get(state << 8 | byte)
                if after is None:
                    after = self.goto[state << 8 | byte] = len(self.ending)
                    self.ending.append(())
                    depths.append(depth)
                    edges.append(state << 8 | byte)
                state = after
            if name:
                self.ending[state] = ((len(name), token),)
        self.fail = [0] * len(self.ending)
        for state in (np.argsort(np.frombuffer(depths, np.int32)[1:], kind="stable") + 1).tolist():
            parent, byte = edges[state] >> 8, edges[state] & 255
            suffix = self.after(self.fail[parent], byte) if parent else 0
            self.fail[state] = suffix
            self.ending[state] = self.ending[state] + self.ending[suffix] if self.ending[state] else self.ending[suffix]

    def after(self, state: int, byte: int) -> int:
        """The state of the longest suffix that the automaton knows, one byte on."""
        goto, fail = self.goto, self.fail
        found = goto.get(state << 8 | byte)
        while found is None and state:
            state = fail[state]
            found = goto.get(state << 8 | byte)
        return found or 0

    def forget(self) -> None:
        """Give up the words and pairs remembered, which idle workers would hold on to."""
        self.words, self.older, self.pairs, self.cached_chars = {}, {}, {}, 0

    def merged(self, name: bytes) -> list[int]:
        """Merge by rank, leftmost first; for strings of one or two tokens only."""
        parts = [self.byte_ids[byte] for byte in name]
        while len(parts) > 1:
            ranks = [self.pair_rank.get(a << 32 | b, len(self.pair_rank)) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.pair_rank):
                break
            k = ranks.index(best)
            parts[k : k + 2] = [self.forms[best]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` can come after ``before`` (-1: at the start) in an encoding.

        Undoes the merges next to the boundary, latest first. A merge across it that could
        have happened before the one just undone would have been taken, so the pair is none.
        """
        whole = self.whole[token]
        if whole == 0:
            whole = self.whole[token] = 1 if self.merged(self.name(token)) == [token] else 2
        if whole == 2:
            return False
        if before < 0:
            return True
        rank, formed, limit = self.pair_rank, self.formed, len(self.pair_rank)
        a, b = before, token
        while True:
            across = rank.get(a << 32 | b)
            if across is not None and across < limit:
                return False
            if formed[a] > formed[b]:
                limit = formed[a]
                a = self.right[a]
            elif formed[b] >= 0:
                limit = formed[b] + 1  # of equal ranks the leftmost merge comes first
                b = self.left[b]
            else:
                return True

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words: a trie of their bytes, walked depth first.

        The sorted words are the trie: what a word has in common with the one before is the path
        already walked, the rest of it are new nodes.
        """
        goto, fail, ending, pairs = self.goto, self.fail, self.ending, self.pairs
        state_at, last, size = [0], [-1], [0]  # of the nodes on the path
        path = b""
        for name, word in sorted((word.encode(), word) for word in words):
            depth = 0
            for x, y in zip(path, name):
                if x != y:
                    break
                depth += 1
            del state_at[depth + 1 :], last[depth + 1 :], size[depth + 1 :]
            state, path = state_at[depth], name
            for byte in name[depth:]:
                depth += 1
                after = goto.get(state << 8 | byte)
                while after is None and state:
                    state = fail[state]
                    after = goto.get(state << 8 | byte)
                state = after or 0
                for length, token in ending[state]:
                    pair = last[depth - length] << 32 | token
                    known = pairs.get(pair)
                    if known is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        known = pairs[pair] = self.follows(last[depth - length], token)
                    if known:
                        break
                else:
                    raise ValueError(f"The vocabulary has no token for byte {byte}.")
                state_at.append(state)
                last.append(token)
                size.append(length)
            tokens, at = [], len(name)
            while at:
                tokens.append(last[at])
                at -= size[at]
            self.words[word] = array("i", tokens[::-1]).tobytes()

    def _not_kept(self, seen: set[str]) -> set[str]:
        """The words that are not remembered; those remembered from before count as met again."""
        new = seen - self.words.keys()
        again = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        self.cached_chars += sum(map(len, again))
        return new - again

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        cut = []
        for text in texts:
            pieces = [text] if self.at_special is None else self.at_special.split(text)
            cut.append([w for p in pieces for w in ([p] if p in self.special else self.split.findall(p))])
        seen = set().union(*cut)
        new = self._not_kept(seen)
        if new:
            chars = sum(map(len, new))
            if len(self.words) + len(new) > CACHED_WORDS or self.cached_chars + chars > CACHED_CHARS:
                self.older, self.words, self.cached_chars = self.words, {}, 0
                new = self._not_kept(seen)
                chars = sum(map(len, new))
            self.cached_chars += chars
            self.words.update((t, np.int32(i).tobytes()) for t, i in self.special.items())
            self.learn(new - self.special.keys())
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in cut]


def vocabulary_file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


@lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(vocabulary_file(path))


@lru_cache(maxsize=2)
def spelling(path: str | None) -> Spelling:
    return Spelling(vocabulary_file(path))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows with about ``SLICE_CHARS`` characters; null texts as empty."""
    texts: list[str] = []
    start, chars = 0, 0
    for k, t in enumerate(one_by_one(batch.column(text))):
        texts.append(t or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS or k + 1 == batch.num_rows:
            yield batch.slice(start, k + 1 - start), texts
            texts, start, chars = [], k + 1, 0


def decoded(batch: pa.RecordBatch, ids: str, words: Spelling) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows with about ``SLICE_TOKENS`` tokens, and their texts; null lists as empty."""
    column = batch.column(ids)
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    held = column.is_valid().to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_TOKENS))))
        rows = range(start, stop)
        yield batch.slice(start, stop - start), [words.decode(flat[ends[k] : ends[k + 1]]).decode("utf-8", "replace") if held[k] else "" for k in rows]
        start = stop


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[str]]:
    kept = [c for c in df.columns if c != name]
    return T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)]), kept


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text``. ``path``: the vocabulary file on every node."""
    schema, kept = _with(docs, to, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part, texts in slices(batch, text):
                ids = words.encode(texts)
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], [*kept, to])
        words.forget()
        give_back()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with the text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
    schema, kept = _with(tokens, to, T.StringType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spelling(path)
        for batch in batches:
            for part, texts in decoded(batch, ids, words):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, to])
        give_back()

    return tokens.mapInArrow(run, schema)


@query("op9_trie_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
