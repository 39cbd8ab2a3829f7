"""Each training-data operator on hard little tables, against brute force or its SQL."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from crossweft.llm import (
    chat_format,
    divergence_rules,
    exact_dedup,
    personal_data,
    repeats,
    simhash,
    source_mixing,
    substring_dedup,
    suffix_dedup,
    toxicity,
    trie_bpe,
)
from crossweft.llm.graph import components
from crossweft.llm.registry import all_queries
from crossweft.llm.tables import sampled_rows

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns whose names the operators use inside.
CLASHING = ["locator", "digest", "print", "uid", "ids", "score", "row", "_id", "node", "key", "spans", "block", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
LOREM = " ".join(f"w{k % 37}x{k % 11}" for k in range(60))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    long = " ".join(f"long{k * k % 9973}" for k in range(20_000))
    return [
        (1, "Hello World and more"),
        (2, "hello world AND more"),
        (3, None),
        (4, ""),
        (5, " \t\n"),
        (6, LOREM),
        (7, "start here " + LOREM + " and then it ends"),
        (8, LOREM.replace("w5x", "changed ")),
        (9, long),
        (10, "prefix " + long),
        (11, "Été ÉTÉ été"),
        (12, "Été étÉ Été"),
        (13, "a b"),
        (14, "x" * 5000),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", *["z"] * len(CLASHING)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """The same with repeated rows and rows without an id."""
    without = docs.where("doc_id in (6, 3)").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(docs.where("doc_id in (6, 11, 4)")).unionByName(without).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.toArrow().to_pylist()}


# -- 1 ---------------------------------------------------------------------------------


def brute_fingerprint(text, size=3):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words)] if 0 < len(words) < size else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(docs, texts):
    got = by_id(simhash.near_groups(docs))
    prints = {i: brute_fingerprint(t) for i, t in texts}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_groups(odd).toArrow().to_pylist()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {3, 6}
    assert simhash.near_groups(none).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 6, 9} <= set(ids) and 10 not in ids
    assert simhash.drop_near_copies(none).count() == 0


def test_near_copies_near_the_required_similarity(spark):
    """Pairs at 0.80 to 0.85 are found, those below are not: sets of 90 and of 9 shingles, and a repeated one."""
    rng = np.random.default_rng(3)
    rows, brute = [], {}
    for k in range(240):
        n, new = (90, 8 + k % 5) if k % 2 else (9, 1 + k // 2 % 2)
        words = [f"v{v}" for v in rng.integers(1 << 40, size=n + 4)]
        other = words[: n + 4 - new] + [f"v{v}" for v in rng.integers(1 << 40, size=new)]
        pair = [words * 3 if n == 90 and k % 3 == 0 else words, other]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in pair)
        brute[2 * k + 1] = 10 * len(a & b) >= 8 * len(a | b)
        rows += [(2 * k, " ".join(pair[0])), (2 * k + 1, " ".join(pair[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert {i for i in range(480) if i not in kept} == {i for i, close in brute.items() if close} and 80 < sum(brute.values()) < 200


def test_near_copies_meet_for_certain(spark):
    """Pairs at 0.8 whose fingerprints differ in 101 bits and more, or whose 24 min-hash keys all differ."""
    rows = []
    for k in (8488, 13280, 14995, 15836):
        words = [f"v{k}.{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [16976, 26560, 29990, 31672]


def test_near_copies_meet_beside_common_passages(spark):
    """By brute force: sizes across the numbers of buckets, a passage in all texts moved out of their heads, small cells."""
    rng = np.random.default_rng(9)
    passage, rows, sets = [f"p{k}" for k in range(40)], [], []
    for k in range(60):
        n = (12, 60, 1000, 1030, 1300, 4100, 5000)[k % 7]
        words = [f"w{v}" for v in rng.integers(1 << 40, size=n)] + passage
        for cut in (0, 1 + n // 50, n // 9, n // 5):
            sets.append(words[: len(words) - 40 - cut] + passage)
            rows.append((len(rows), " ".join(sets[-1])))
    hashed = [np.unique(simhash.shingle_hashes(text, 5)) for _, text in rows]
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    want = {(a, b) for a in range(240) for b in range(a + 1, min(240, a + 4)) if a // 4 == b // 4 and similar(hashed[a], hashed[b])}
    none = np.zeros(0, np.uint64)
    lists = [(k, [int(x) for x in simhash.head_of(h, 80, none).view(np.int64)], simhash.views_of(h, 80)) for k, h in enumerate(hashed)]
    nodes = spark.createDataFrame(lists, "node long, head array<long>, views array<binary>")
    texts = spark.createDataFrame(rows, "locator long, text string")
    asked = []

    def reread(some, common):
        asked.append(len(common))
        return simhash.reread_heads(some.withColumn("locator", F.col("node")), texts, simhash.WIDE, common)

    for cell, common in ((4096, 1024), (4, 8)):
        found = {r["node"]: r["root"] for r in components(simhash.alike(nodes, reread, simhash.WIDE, cell, common)).collect()}
        assert all(found.get(a, a) == found.get(b, -b) for a, b in want) and len(want) > 100
        # Unlike sets stay apart although all share the passage, which is most of only the smallest.
        assert all(found.get(a, a) // 4 == a // 4 for a in range(240) if a // 4 % 7)
    assert asked and max(asked) >= 1


def test_near_copies_compare_sets_across_cells(spark):
    """Chains of sets, each close to the next only, stay whole however small the pieces are."""
    rows = [(10 * c + k, " ".join(f"c{c}w{w}" for w in range(4 * k, 4 * k + 60))) for c in range(3) for k in range(10)]
    docs = spark.createDataFrame(rows, "locator long, text string")
    candidates = docs.select(F.lit(0).cast("long").alias("root"), F.col("locator").alias("node"), "locator")
    for cell, shingles in ((4, 1 << 19), (4096, 100), (4096, 1 << 19)):
        found = components(simhash.similar(candidates, docs, simhash.WIDE, cell, shingles)).collect()
        assert {r["node"]: r["root"] for r in found} == {i: i // 10 * 10 for i, _ in rows}


def test_simhash_cuts_hot_keys(spark):
    """A chain of near fingerprints in small cells is still one component, and the same one."""
    rng = np.random.default_rng(1)
    value, prints = 0x0123456789ABCDEF, []
    for _ in range(120):
        prints.append(value.to_bytes(8, "big"))
        value ^= 1 << int(rng.integers(64))
    rows = [(k, bytearray(p)) for k, p in enumerate(dict.fromkeys(prints))]
    nodes = spark.createDataFrame(rows, "node long, print binary")
    for cell in (4, 4096):
        found = components(simhash.links(nodes, simhash.NARROW, cell=cell)).collect()
        assert {r["root"] for r in found} == {0} and len(found) == len(rows)


def test_wide_fingerprints_meet_by_their_blocks(spark):
    """Whatever the min-hashes say: pairs with fewer differing bits than blocks are linked, unlike ones are not."""
    rng = np.random.default_rng(5)
    wide, n = simhash.WIDE, 60
    radius = len(simhash.masks(wide, 2 * n)) - 1
    rows = []
    for k in range(n):
        value = int.from_bytes(rng.bytes(8 * wide.lanes), "big")
        # Spread as evenly as can be, or up to the last bit that a near copy may differ in but in one block.
        at = range(0, 384, -(-384 // radius)) if k % 3 == 0 else rng.choice(384, radius, replace=False) if k % 3 == 1 else range(16, 16 + wide.bits + 1)
        other = value ^ sum(1 << int(b) for b in at)
        rows += [(2 * k, value), (2 * k + 1, other)]
    nodes = [(k, bytearray(v.to_bytes(8 * wide.lanes, "big") + rng.bytes(8 * wide.bands))) for k, v in rows]
    found = components(simhash.links(spark.createDataFrame(nodes, "node long, print binary"), wide)).collect()
    assert {(r["root"], r["node"]) for r in found} == {(k // 2 * 2, k) for k in range(2 * n) if k // 2 % 3 < 2}
    # Blocks follow the number of nodes, and take every bit once.
    for nodes in (1, 10**5, 10**7, 10**9):
        masks = simhash.masks(wide, nodes)
        assert 10 < len(masks) <= 24 and min(sum((m & (1 << 64) - 1).bit_count() for m in mask) for mask in masks) > nodes.bit_length()
        assert sum((m & (1 << 64) - 1).bit_count() for mask in masks for m in mask) == 384


def test_components_long_path_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)}


# -- 2 ---------------------------------------------------------------------------------


def test_exact_dedup_odd_rows(odd, none):
    got = exact_dedup.exact_groups(odd).toArrow().to_pylist()
    assert len(got) == odd.count()
    groups = {}
    for r in got:
        groups.setdefault(r["digest"], []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in groups.values())
    keep = {r["doc_id"]: r["keep_id"] for r in got}
    assert keep[1] == 2 and keep[3] == 4 and keep[5] == 5 and keep[11] == 11 and keep[None] in (4, 6)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_compares_bytes(docs):
    """With a digest that clashes all the time the groups are those of the texts."""
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    strong = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).toArrow().to_pylist()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, digest=weak).toArrow().to_pylist()}
    assert got == strong


def test_exact_dedup_state_goes_on(spark, docs, tmp_path):
    """A second run of the stream with the same checkpoint adds to the state of the first."""
    found = exact_dedup.located(docs)
    narrow = exact_dedup.records(found, "doc_id", "text", exact_dedup.sha256)
    path, checkpoint = str(tmp_path / "records"), str(tmp_path / "state")
    narrow.where("doc_id < 2").write.parquet(path)
    stream = spark.readStream.schema(narrow.schema).parquet(path)
    assert exact_dedup.remember(stream, checkpoint).count() == 1
    narrow.where("doc_id >= 2").write.mode("append").parquet(path)
    state = exact_dedup.remember(spark.readStream.schema(narrow.schema).parquet(path), checkpoint).collect()
    assert sorted((r["keeper"]["doc_id"], r["group_size"]) for r in state if r["group_size"] > 1) == [(2, 2), (4, 2)]


# -- 3 and 10 --------------------------------------------------------------------------


def brute_repeats(units_of, rows, width):
    seen, out = set(), {}
    for i, text in rows:
        units = units_of(text or "")
        gone = [False] * len(units)
        for k in range(len(units) - width + 1):
            window = tuple(units[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        out[i] = units, gone
    return out


def test_substring_dedup_brute_force(docs, texts):
    want = {}
    for i, (words, gone) in brute_repeats(WORD.findall, texts, 20).items():
        want[i] = len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)
    got = by_id(substring_dedup.drop_repeats(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want
    assert want[9][1] < want[10][1] and want[7][1] > 0


@pytest.mark.parametrize("hot_kinds", [suffix_dedup.HOT_KINDS, 1])
def test_suffix_dedup_brute_force(docs, texts, hot_kinds):
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in texts]
    short = docs.withColumn("text", F.when(F.length("text") >= 5000, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    want = {}
    for i, (data, gone) in brute_repeats(lambda t: t.encode(), rows, 100).items():
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[i] = len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()
    got = by_id(suffix_dedup.drop_repeats(short, hot_kinds=hot_kinds, batch_bytes=1 << 10))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_repeats_odd_rows(operator, odd, none):
    got = operator.drop_repeats(odd).toArrow().to_pylist()
    assert len(got) == odd.count()
    twice = [r["n_removed"] for r in got if r["doc_id"] == 6]
    assert len(twice) == 2 and len(set(twice)) == 1 and twice[0] > 0  # the row without an id comes first
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0, 0]
    assert operator.drop_repeats(none).count() == 0


def test_expansion_finds_all_common_prefixes():
    rng = np.random.default_rng(3)
    for width in (1, 2, 5, 9, 20, 40):
        symbols = np.concatenate([rng.integers(1, 3, 100), [0]] * 2 + [[suffix_dedup.SEPARATOR]]).astype(np.uint8)
        starts, interval = suffix_dedup.expand_intervals(symbols, width)
        groups = {}
        for s, g in zip(starts, interval):
            groups.setdefault(g, set()).add(int(s))
        want = {}
        for k in range(202 - width + 1):
            want.setdefault(tuple(symbols[k : k + width]), set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_longest_repeats_doubles_to_the_end(docs):
    got = {r["doc"]: r["length"] for r in substring_dedup.longest_repeats(docs).collect()}
    assert got[6] == got[7] == 40 and got[9] == got[10] == 10240 and 1 not in got


def test_fragments_cover_every_window():
    units = repeats.word_units([LOREM.encode(), b"", b"one two", (LOREM + " tail").encode()])
    _, _, text, at, n = repeats.fragments(units, 20, 10)
    windows = sorted((int(t), k) for t, a, m in zip(text, at, n) for k in range(a, a + m - 19))
    assert windows == [(0, k) for k in range(41)] + [(3, k) for k in range(42)]


# -- 4 ---------------------------------------------------------------------------------


def test_chat_format_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."),
        (1, 1, "ann", "Hi <|im_end|>"),
        (1, 2, "bob", None),
        (1, None, None, "late"),
        (1, 1, "ann", "Hi <|im_end|>"),
        (2, 0, "system", "alone"),
        (None, 0, "ann", "nobody"),
        (None, 0, "bob", "nobody"),
        (3, 1, "ann", "x"),
        (3, 5, "ann", "y"),
        (4, 0, "a b", "1"),
        (4, 1, "a_b", "2"),
    ]
    talk = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, said string")
    got = chat_format.rotate(talk).toArrow().to_pylist()
    one = {r["speaker"]: r for r in got if r["conv_id"] == 1}
    assert set(one) == {"ann", "bob", "unknown"} and {r["n_messages"] for r in one.values()} == {5}
    text = one["ann"]["rendered"]
    assert text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n" + 2 * "<|im_start|>assistant\nHi <| im_end|><|im_end|>\n" + (
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nlate<|im_end|>\n")
    )
    assert [text[s["start"] : s["stop"]] for s in one["ann"]["spans"]] == 2 * ["Hi <| im_end|><|im_end|>"]
    named = {r["speaker"]: r["rendered"] for r in got if r["conv_id"] == 4}
    assert set(named) == {"a b", "a_b"} and "user name=a%20b\n1" in named["a_b"] and "user name=a_b\n2" in named["a b"]
    assert sum(r["conv_id"] is None for r in got) == 2 and not [r for r in got if r["conv_id"] == 2]
    assert chat_format.rotate(talk.limit(0)).count() == 0


def test_chat_format_whole_leaves_nothing_out(spark):
    """Silent speakers, segments of system messages alone, repeated rows: put end to end, the dialogue uncut."""
    rows = [(1, k, ("system", "ann", "bob", "cy%d <")[k % 4], f"say {k} " + "é" * (k % 50)) for k in range(300)] + [(1, 301, "late", "once")]
    rows += [(1, 400 + k, "system", "rule" * 300) for k in range(5)] + [(2, 7, "ann", "same")] * 200 + [(2, 8, "system", "y" * 5000)]
    rows += [(None, 1, "ann", "x")] * 3 + [(3, 0, "system", "alone")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)

    def dialogues(segment_bytes):
        out, parts = {}, 0
        for r in sorted(chat_format.rotate(talk, segment_bytes, whole=True).toArrow().to_pylist(), key=lambda r: r["segment"]):
            if r["conv_id"] is not None:
                text, spans, n = out.get((r["conv_id"], r["speaker"]), ("", [], 0))
                out[r["conv_id"], r["speaker"]] = text + r["rendered"], spans + r["spans"], n + r["n_messages"]
            parts += 1
        return out, parts

    (cut, many), (uncut, few) = dialogues(2000), dialogues(1 << 30)
    assert cut == uncut and many > few == 8
    assert {k: v[2] for k, v in cut.items()} == {(1, s): 306 for s in ("ann", "bob", "cy%d <", "late")} | {(2, "ann"): 201}
    text, spans, _ = cut[1, "late"]
    assert [text[s["start"] : s["stop"]] for s in spans] == ["once<|im_end|>"]


def test_chat_format_query_renders_long_conversations_whole(spark, tmp_path):
    """The query itself: who is silent for long is in every segment, and the pieces are the whole dialogue."""
    rows = [(1, k, ("system", "ann", "bob")[k % 3], f"say {k} " + "é" * 200) for k in range(900)] + [(1, 900, "late", "once"), (2, 0, "ann", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(chat_format.op4(spark, str(tmp_path)).toArrow().to_pylist(), key=lambda r: (r["conv_id"], r["speaker"], r["segment"]))
    segments = {r["segment"] for r in got if r["conv_id"] == 1}
    assert len(segments) > 4 and len(got) == 3 * len(segments) + 1
    text = "".join(r["rendered"] for r in got if r["speaker"] == "late")
    assert text.count("<|im_start|>") == 901 and all(f"\nsay {k} " in text for k in range(900))
    start, stop = map(int, ",".join(r["mask"] for r in got if r["speaker"] == "late" and r["mask"]).split(":"))
    assert text[start:stop] == "once<|im_end|>"


def test_chat_format_long_conversations_equal_sql(spark):
    """A long one, a hot repeated message, null turns in bulk, rows without conversation."""
    rows = [(1, k, ("system", "ann", "bob", "cy%d <")[k % 4], f"say {k} " + "é" * (k % 50)) for k in range(3000)]
    rows += [(2, 0, "system", "rule")] + [(2, 7, "ann", "same")] * 2000 + [(2, 8, "bob", "end")]
    rows += [(3, None, f"p{k % 3}", f"t{k}") for k in range(900)] + [(None, 1, "ann", "x")] * 5 + [(4, 1, "ann", "w" * 9000), (4, 2, "bob", "")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat_format.masked(chat_format.rotate(talk, segment_bytes=2000)).toArrow()
    conversations = talk.toArrow()
    want = duckdb.connect()
    want.register("conversations", conversations)
    want = want.execute(chat_format._sql(2000)).fetchall()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(r.values() for r in got.to_pylist()) == plain(want)
    # Every message is trained on once, however the conversations are cut.
    assert sum(r["mask"].count(":") for r in got.to_pylist() if r["mask"]) == sum(r[2] != "system" for r in rows)
    sizes = [len(r["rendered"].encode()) for r in got.to_pylist() if r["conv_id"] != 4]
    assert max(sizes) < 8000


# -- 5 ---------------------------------------------------------------------------------


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_divergence_rules(spark, docs, odd, none):
    refs = divergence_rules.references(docs)
    extra = spark.createDataFrame([(20, "a b c d a b c\n x \n x \n\n#$", None), (21, "one two three " * 40, "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    text_of = {r["doc_id"]: r["text"] for r in both.toArrow().to_pylist()}
    for i, r in by_id(divergence_rules.judge(both, refs)).items():
        base = brute_base(text_of[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])
    assert divergence_rules.judge(odd, divergence_rules.references(odd)).count() == odd.count()
    assert divergence_rules.judge(none, divergence_rules.references(none)).count() == 0


def test_divergence_keeps_prose_and_drops_noise(spark):
    rng = np.random.default_rng(0)
    common = [f"{a}{b}" for a in "thnsr" for b in "aeiou"]
    prose = [" ".join(rng.choice(common, 300)) + "." for _ in range(60)]
    noise = ["".join(rng.choice(list("QXZ#@$%!9 "), 2000)) for _ in range(3)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(prose + noise)], "doc_id long, text string, lang string")
    got = by_id(divergence_rules.judge(docs, divergence_rules.references(docs)))
    fits = {i for i, r in got.items() if r["class_distance"] <= divergence_rules.MAX_CLASS_DISTANCE and r["word_distance"] <= divergence_rules.MAX_WORD_DISTANCE}
    assert fits == set(range(60))


def test_jensen_shannon_bounds():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert divergence_rules.jensen_shannon(p, 5 * p) < 1e-7 and abs(divergence_rules.jensen_shannon(p, q) - 1) < 1e-12


# -- 6 ---------------------------------------------------------------------------------


def test_toxicity_learns_and_never_sees_the_held_out(spark):
    rng = np.random.default_rng(5)
    words = ["calm", "river", "stone", "green", "paper", "window", "garden", "music"]
    rows = []
    for k in range(600):
        text = list(rng.choice(words, 40))
        toxic = k % 4 == 0
        if toxic:
            text[int(rng.integers(40))] = str(rng.choice(["grumblefool", "nastyhead"]))
        rows.append((k, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {r[0] for r in docs.where(toxicity.fold(F.col("doc_id")) == 0).select("doc_id").collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(held) > 60 and all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(again.weights, model.weights) and again.intercept == model.intercept


def test_toxicity_keeps_the_prior_when_classes_are_sampled(spark):
    """One document in eight is toxic. A word that half of the toxic and a quarter of the clean ones hold proves nothing, sampled or not."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1600):
        text = list(rng.choice(["calm", "river", "stone", "green", "paper"], 20))
        toxic = k % 8 == 0
        if rng.random() < (0.5 if toxic else 0.25):
            text[5] = "hothead"
        rows.append((k, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    mean = []
    for sample in (100, 6000):
        scores = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, sample)).collect()]
        assert np.mean([s >= 0.5 for s in scores]) < 0.1
        mean.append(np.mean(scores))
    assert abs(mean[1] - 0.125) < 0.02 and abs(mean[0] - mean[1]) < 0.05


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, 0), (1, 0), (2, 0), (7, 1), (None, 1), (3, 5)], "doc_id long, toxic int")
    scored = toxicity.score(odd, toxicity.fit(odd, labels)).toArrow().to_pylist()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    nothing = toxicity.fit(odd, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(odd, nothing).collect()} == {0.0}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# -- 7 ---------------------------------------------------------------------------------


def test_mixing_odd_rows(odd, none):
    got = source_mixing.mix(odd, block_tokens=4, shard_tokens=5_000).toArrow().to_pylist()
    assert len(got) == odd.count()
    whole = sum(r["size"] for r in got)
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * whole) < 1e-6 * whole
    for source, target in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 4 * 12
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = source_mixing.mix(odd.repartition(5), block_tokens=4, shard_tokens=5_000).toArrow().to_pylist()
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert source_mixing.mix(none).count() == 0


def test_mixing_spreads_rows_without_id(spark):
    rows = [(None if k % 3 == 0 else k, f"word{k} " * 40, "s") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select(F.lit(0).alias("row"), *source_mixing._sized("doc_id", "text", "source"))
    laid, chosen = source_mixing._allocate(sized, 32, 2_000)
    largest = laid.groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]
    assert largest < 3 * 2_000
    # Blocks are spelled out after a repartition that is really there.
    assert "REPARTITION_BY_NUM" in chosen._jdf.queryExecution().executedPlan().toString()


def test_samples_bound_rows(spark):
    rows = spark.createDataFrame([(1, f"t{k}") for k in range(500)] + [(k, "x") for k in range(2, 9)], "_id long, _text string")
    found = sampled_rows(rows.unionByName(rows), 40)
    assert found.count() == found.distinct().count() == 40
    assert sampled_rows(rows.unionByName(rows), 1000).count() == 507


def test_mixing_sends_no_blocks_to_the_driver(docs):
    """Blocks are spelled out from few quotas, so a plan that goes by their size would broadcast them all."""
    laid = lambda mixed: mixed._jdf.queryExecution().executedPlan().toString()
    for plan in (laid(source_mixing.mix(docs)), laid(source_mixing.mixed_documents(docs))):
        joins = [line for line in plan.splitlines() if "Join" in line and "block#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_mixing_texts(odd, none):
    got = source_mixing.mixed_documents(odd, block_tokens=16, shard_tokens=5_000)
    assert got.columns == odd.columns
    taken = source_mixing.mix(odd, block_tokens=16, shard_tokens=5_000)
    sizes = {r[0]: r[1] for r in taken.groupBy("source").agg(F.sum("taken")).collect()}
    words = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()}
    assert {s: n for s, n in sizes.items() if n} == words
    assert source_mixing.mixed_documents(none).count() == 0


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(2)
    for seats in (0, 1, 7, 100, 1001):
        votes = [int(v) for v in rng.integers(0, 1000, 17)] + [5000, 0]
        rows = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "g int, k long, v long, seats long")
        got = {r["k"]: r["won"] for r in source_mixing.apportion(rows, "g", "k", "v", "seats").collect()}
        best = sorted(((-v / (2 * j - 1), k) for k, v in enumerate(votes) for j in range(1, seats + 1) if v))[:seats]
        assert got == {k: sum(b[1] == k for b in best) for k in range(len(votes))}


# -- 8 ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    [
        "mail a.b@x.org, c@d@e.fr q@z. @k.de a@b.com_x@y.z1 -@-.-",
        "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3 12.34.56.78.9",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000000000 7  8",
        "phone +49 (170) 123-4567, +1 +12 +1234567890123456 +44 20 7946 0958.",
        "１２３４ é@é.fr +" + "1" * 3000 + " " + "a" * 3000,
        "",
    ],
)
def test_base_spans_are_the_patterns(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum((int(c) * 2 // 10 + int(c) * 2 % 10) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    want = [(m.start(), m.end(), 0) for m in email.finditer(text)] if len(text) < 2000 else []
    want += [(m.start(), m.end(), 1) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [(m.start(), m.end(), 2) for m in personal_data.CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    want += [(m.start(), m.end(), 3) for m in personal_data.PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    assert personal_data.base_spans(text) == sorted(want, key=lambda s: (s[0], s[2]))


def test_field_adds_distant_repetitions(spark):
    """A number known as a phone in one place is found again where its plus sign is missing."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        number = "".join(map(str, rng.integers(0, 10, 11)))
        rows.append((k, f"please call +{number} soon or write to a{k}@mail.org about order {k % 90} of {1900 + k % 99}"))
    model = personal_data.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    filler = " and so on" * 50
    twice = "call +49170555123 today" + filler + " then 49170555123 again"
    alone = "item 49170555123 again"
    got = by_id(personal_data.find(spark.createDataFrame([(1, twice), (2, alone), (3, None)], "doc_id long, text string"), model))
    spans = {i: [(s["kind"], r_text[s["start"] : s["stop"]]) for s in r["spans"]] for i, r, r_text in ((i, r, {1: twice, 2: alone, 3: ""}[i]) for i, r in got.items())}
    assert spans[1] == [("phone", "+49170555123"), ("phone", "49170555123")]
    assert spans[2] == [] and spans[3] == []


def test_belief_propagation_is_exact_on_a_chain():
    rng = np.random.default_rng(9)
    n = personal_data.N
    field = personal_data.Field(rng.normal(size=(personal_data.FEATURES, n)), rng.normal(size=(n, n)), np.zeros((n, n)))
    g = personal_data.Graph([(0, 1)] * 3, [[0], [1], [2]], [(0, 1), (1, 2)], [])
    joint = np.zeros((n, n, n))
    for a in range(n):
        for b in range(n):
            for c in range(n):
                joint[a, b, c] = field.unary[0, a] + field.unary[1, b] + field.unary[2, c] + field.chain[a, b] + field.chain[b, c]
    joint = np.exp(joint)
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.abs(field.beliefs([g]) - want).max() < 0.02


def test_personal_data_odd_rows(odd, none):
    assert personal_data.find(odd, personal_data.fit(odd)).count() == odd.count()
    assert personal_data.find(none, personal_data.fit(none)).count() == 0


# -- 9 ---------------------------------------------------------------------------------


def test_bpe_equals_the_library(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = trie_bpe.decode(trie_bpe.encode(odd)).toArrow().to_pylist()
    assert len(got) == odd.count()
    for r in got:
        assert r["ids"] == reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == reference.decode(r["ids"], skip_special_tokens=False) == (r["text"] or "")
    assert trie_bpe.encode(none).count() == 0


def test_bpe_hard_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference, own = Tokenizer.from_file(path), trie_bpe.Vocabulary(path)
    texts = ["a<|endoftext|>b <|endoftext|>", " \x1c x\x85y z 　k", "it's I'LL don't\n\n  x", "½ 日本語 🎉é\x00", "a" * 999, "-" * 300 + "=" * 77, " " * 50 + "x", "\xad​﻿"]
    texts += ["".join(chr(int(c)) for c in np.random.default_rng(k).integers(32, 500, 200)) for k in range(40)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == reference.encode(text, add_special_tokens=False).ids
        assert own.decode(np.frombuffer(ids, np.int32)).decode() == text


def test_bpe_worker_memory(spark, monkeypatch):
    """Decoding loads no merges, the encoder is small, and words that come again outlast rare ones."""
    import tracemalloc

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tracemalloc.start()
    spelled = trie_bpe.Spelling(path)
    assert tracemalloc.get_traced_memory()[0] < 3e6
    own = trie_bpe.Vocabulary(path)
    assert tracemalloc.get_traced_memory()[0] < 35e6
    tracemalloc.stop()
    monkeypatch.setattr(trie_bpe, "CACHED_WORDS", 50)
    learnt = []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (learnt.extend(words), learn(words)))
    texts = ["again and " + " ".join(f"w{k}x{j}" for j in range(10)) for k in range(40)]
    ids = [own.encode([text])[0] for text in texts]
    assert learnt.count("again") == 1 and len(own.words) <= 50 and len(own.older) <= 50
    monkeypatch.setattr(trie_bpe, "SLICE_TOKENS", 100)
    lists = [np.frombuffer(i, np.int32).tolist() for i in ids] + [None, []]
    batch = pa.record_batch({"ids": pa.array([[1]] + lists, pa.list_(pa.int32()))}).slice(1)
    parts = list(trie_bpe.decoded(batch, "ids", spelled))
    assert len(parts) > 5 and [t for _, part in parts for t in part] == texts + ["", ""]
    assert all(part.num_rows == len(found) for part, found in parts)


# -- queries ---------------------------------------------------------------------------


def cells(table):
    names = sorted(table.column_names)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return names, Counter(tuple(map(show, r)) for r in zip(*[table[n].to_pylist() for n in names]))


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, name):
    run, sql = all_queries()[name]
    got = run(spark, SMALL).toArrow()
    assert got.num_rows > 0
    if sql:
        db = duckdb.connect()
        for path in Path(SMALL).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        assert cells(got) == cells(db.sql(sql).to_arrow_table())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(exact_dedup.stored(stage(spark, seen[-1], SMALL), "test"))
    assert all(s.columns == docs.columns for s in seen[:-1])
    clean, single, apart, mixed, tokens = seen[1:]
    assert 0 < clean.count() < docs.count()
    keys = [lower(r["text"]) for r in clean.collect()]
    assert single.count() == len(set(keys))
    assert len({lower(r["text"]) for r in apart.collect()}) == apart.count() <= single.count()
    assert 0 < tokens.count() == mixed.count()
    assert {r["text"] for r in tokens.select("text").collect()} == {r["text"] for r in mixed.select("text").collect()}
