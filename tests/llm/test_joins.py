"""The set join, the box search and the trie frontier on hard little tables, against brute force."""

import re
import zlib
from collections import Counter
from functools import cmp_to_key

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossweft.llm import chosen_path, hard_negatives, spelling_variants
from crossweft.llm.chosen_path import Join
from crossweft.llm.hard_negatives import Best, Mining, Questions
from crossweft.llm.registry import all_queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns whose names the operators use inside.
CLASHING = ["uid", "node", "size", "digest", "word", "n", "tile", "page", "place", "key", "s0", "way"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """Documents (doc_id, text) with columns that clash."""
    return spark.createDataFrame([(*r, *["z"] * len(CLASHING)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


def rows_of(df):
    return df.toArrow().to_pylist()


# -- 11 --------------------------------------------------------------------------------


def brute_sets(text, size=2):
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and 100 * n >= 80 * (len(a) + len(b) - n):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(len(s), i if not s else least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.fixture(scope="module")
def near(spark):
    """Copies, near copies around the threshold, chains, short and empty texts, in a shuffled order."""
    rng = np.random.default_rng(5)
    texts = [None, "", " \t\n", "one", "One", "a b", "A  b", "a b c", "a b c d e f", "a b c d e f g", "x" * 4000]
    for k in range(60):
        n = int(rng.integers(6, 120))
        words = [f"v{v}" for v in rng.integers(1 << 40, size=n)]
        texts.append(" ".join(words))
        for cut in rng.integers(0, max(1, n // 8), size=4):
            at = int(rng.integers(0, n))
            texts.append(" ".join([*words[:at], *[f"n{v}" for v in rng.integers(1 << 40, size=cut)], *words[at + cut :]]))
    chain = [f"c{v}" for v in range(300)]
    texts += [" ".join(chain[3 * k : 3 * k + 60]) for k in range(40)]
    texts += [" ".join(f"w{v}" for v in range(20_000)), " ".join(f"w{v}" for v in range(1_000, 21_000))]
    order = rng.permutation(len(texts))
    return [(int(i), texts[i]) for i in order]


@pytest.mark.parametrize("limit, levels", [(4, 8), (4, 2), (4096, 8)])
def test_chosen_path_brute_force(spark, near, limit, levels):
    """The same links whether nodes are compared whole, branch down to small leaves, or stay large at the last level."""
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(chosen_path.near_groups(frame(spark, near), Join(limit=limit, levels=levels)))}
    assert got == {i: x for (i, _), x in zip(near, brute_components(near))}
    assert len({c for _, c in got.values()}) < len(near) - 100


def test_chosen_path_hot_groups(spark):
    """A large group of near copies leaves its node at the first pivot; sets beyond stay linked."""
    words = [f"h{v}" for v in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(1, 400):
        changed = list(words)
        changed[k % 200] = f"x{k}"
        if k % 3 == 0:
            changed[(7 * k + 5) % 200] = f"y{k}"
        rows.append((k, " ".join(changed)))
    far = list(words)
    for v in range(0, 24, 2):
        far[v] = f"f{v}"
    rows += [(1000, " ".join(far)), (1001, " ".join(far[:-30] + [f"g{v}" for v in range(30)]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(chosen_path.near_groups(frame(spark, rows), Join(limit=16)))}
    assert got == {i: x for (i, _), x in zip(rows, brute_components(rows))}


def test_chosen_path_asks_in_slices(spark, monkeypatch):
    """Sets and tokens are met at the scan however many ids there are: no node is shuffled, none lost."""
    nodes = spark.createDataFrame([(k, f"a b c {k % 9}") for k in range(60)], "uid long, text string")
    asked = spark.createDataFrame([(k, k % 4) for k in range(0, 60, 2)] + [(0, 3)], "uid long, key long")
    monkeypatch.setattr(chosen_path, "FEW_IDS", 7)
    plans = []
    got = chosen_path.met(nodes, asked, lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()) or found, "slices")
    assert sorted(map(tuple, got.select("uid", "key", "text").collect())) == sorted([(k, k % 4, f"a b c {k % 9}") for k in range(0, 60, 2)] + [(0, 3, "a b c 0")])
    assert len(plans) == 5 and all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in plans)


def test_chosen_path_odd_rows(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "a  B c"), (None, None), (None, "alone here"), (5, None), (5, "")]
    got = rows_of(chosen_path.near_groups(frame(spark, rows)))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got], key=str) == sorted(
        [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True), (None, 1, None, True), (5, 0, 5, True), (5, 0, 5, True)], key=str
    )
    assert chosen_path.near_groups(frame(spark, rows).limit(0)).count() == 0


def test_trees_reach_the_recall():
    """Pairs just so similar meet in the simulated trees as often as the formula says."""
    join = Join()
    assert join.trees == 5 and 0.8 < join.percent / 100 + 1e-9
    assert join.functions == 150 and Join(recall=0.9).trees == 1
    rng = np.random.default_rng(1)
    meets = np.zeros(20_000, bool)
    for _ in range(join.trees):
        alive = np.ones((len(meets), 1), bool)
        for _ in range(4):
            alive = np.repeat(alive, 2, axis=1) & (rng.random((len(meets), 2 * alive.shape[1])) < 0.8)
        meets |= alive.any(axis=1)
    assert meets.mean() > 0.9999
    # Sketches of sets at the threshold differ within the bound.
    factors = chosen_path._factors(256)
    for _ in range(200):
        h = rng.integers(1 << 63, size=100, dtype=np.uint64) * np.uint64(2)
        a, b = (chosen_path.sketch(chosen_path.minima(x, factors)).view(np.uint64) for x in (h[:90], h[10:]))
        assert np.bitwise_count(a ^ b).sum() <= join.most_bits(0.8)


# -- 12 --------------------------------------------------------------------------------


def brute_negatives(rows, mining):
    out = []
    for i, (a, la, x) in enumerate(rows):
        if a % mining.every:
            continue
        scored = [(int(np.dot(x, y)), b, lb) for b, lb, y in rows]
        same = sorted([(-s, b) for s, b, lb in scored if lb == la and b != a])[: mining.positives]
        for s, p in same:
            fits = sorted([(-t, b) for t, b, lb in scored if lb != la and mining.low * -s <= 100 * t <= mining.high * -s])[: mining.negatives]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r.values()) for r in rows_of(df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))


@pytest.mark.parametrize("few", [20_000, 3])
def test_hard_negatives_brute_force(spark, few):
    """Ties, equal vectors and negative scores; anchors broadcast, and dealt in blocks."""
    rng = np.random.default_rng(2)
    mining = Mining(every=7, positives=3, negatives=4, page_rows=8, part_rows=64)
    vectors = rng.integers(-6, 7, size=(300, 5))
    vectors[40:120] = vectors[40]  # a hot vector
    vectors[120:140] = -vectors[40]
    rows = [(int(i), int(rng.integers(3)), v.astype(float).tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    got = mined(hard_negatives.mine(df, mining, few))
    assert got == brute_negatives([(i, lab, np.array(v)) for i, lab, v in rows], mining) and len(got) > 200


def test_hard_negatives_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    run, sql = all_queries()["op12_hard_negatives"]
    want = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({sql})").fetchall()
    assert mined(run(spark, SMALL)) == sorted(want) and want


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.5, 0.5]), (3, 2, [nan, 1.0]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [inf, 0.0]), (None, 2, [0.6, 0.6])]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, label int, embedding array<float>, tile string, score string")
    whole = hard_negatives.whole_vectors(df, F.col("vec_id"), F.col("label"), F.col("embedding"))
    # 0 with its positive 1: 256 * 256; of the others only 2 takes part, at 128 * 256 + 128 * 128.
    assert mined(hard_negatives.mine(whole)) == [(0, 1, 1, 2, 65536, 49152)]
    assert hard_negatives.mine(whole.limit(0)).count() == 0
    with pytest.raises(ValueError, match="53 bits"):
        hard_negatives.mine(whole.withColumn("v", F.array(F.lit(1e9))))


def test_boxes_are_pruned():
    """The queue leaves out pages that cannot win, and nothing else."""
    rng = np.random.default_rng(4)
    pages = []
    for k in range(40):
        centre = rng.normal(size=4) * 50
        v = np.floor(centre + rng.normal(size=(20, 4)))
        pages.append((np.arange(20) + 20 * k, rng.integers(2, size=20), v))
    ids, labels, vectors = (np.concatenate([p[k] for p in pages]) for k in range(3))
    asked = Questions(np.array([0, 30]), labels[[0, 30]], vectors[[0, 30]], np.array([0, 1]), np.array([-np.inf, 0.0]), np.array([np.inf, 500.0]), False)
    best, cells = Best(2, 5), []
    hard_negatives.OFFERS, before = 1, hard_negatives.OFFERS
    hard_negatives.search(pages, asked, best, cells.append)
    hard_negatives.OFFERS = before
    question, score, found = best.settle()
    for q in range(2):
        s = vectors @ asked.vectors[q]
        fits = [(-s[k], ids[k]) for k in range(len(ids)) if labels[k] != asked.labels[q] and asked.low[q] <= s[k] <= asked.high[q]]
        assert [(-a, b) for a, b in zip(score[question == q], found[question == q])] == sorted(fits)[:5]
    assert sum(cells) < 0.5 * 2 * len(ids)


# -- 13 --------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if near_words(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def variant_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(df)}


def test_variants_brute_force(spark):
    """Random near words over few letters, runs of equal letters, one common long word damaged in all ways."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(300):
        word = "".join(rng.choice(list("abÿ"), size=int(rng.integers(7, 10))))
        texts.append(" ".join([word] * int(rng.integers(2, 40))))
    base = "Überwältigendes"
    texts += [" ".join([base] * 300)] + [" ".join([base[:k] + c + base[k + j :]] * (2 + k)) for k in range(len(base)) for c in ("q", "é", "") for j in (0, 1)]
    texts += [None, "", "aaaaaaa " * 30 + "aaaaaaaa " * 300, "a1b2c3 Ünïcôdé́×÷× ÀÈÌÒÙÀÈ àèìòùàè " * 3]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    counts = brute_words(rows)
    got = variant_rows(spelling_variants.variants(frame(spark, rows)))
    assert got == brute_variants(counts) and len(got) > 200
    assert sum(f is not None for _, f, *_ in got) > 40


def test_variants_of_long_words(spark):
    """Words far below the plain levels, near in their middle, at their ends and across block borders."""
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh"), size=400))
    words = {base, "a" * 90, "a" * 91, "a" * 92, base[:47], base[:48], base[:49]}
    for k in (0, 1, 15, 31, 32, 33, 47, 48, 49, 71, 72, 199, 200, 201, 398, 399):
        words |= {base[:k] + "z" + base[k + 1 :], base[:k] + base[k + 1 :], base[:k] + "y" + base[k:], base[:k] + "zz" + base[k + 2 :]}
    counted = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    got = {(r["word"], r["near"]) for r in rows_of(spelling_variants.neighbours(counted))}
    assert got == {(a, b) for a in words for b in words if a != b and near_words(a, b)} and len(got) > 150


def test_variants_chain_and_nothing(spark):
    """Forms are followed to the last one; no words, no rows."""
    steps = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    rows = [(None, " ".join([w] * (2 * 10**k))) for k, w in enumerate(steps[:4])] + [(1, "abcdefghijkl " * 3)]
    got = variant_rows(spelling_variants.variants(frame(spark, rows)))
    assert got == brute_variants(brute_words(rows))
    assert spelling_variants.variants(frame(spark, rows).limit(0)).count() == 0
    assert spelling_variants.variants(frame(spark, [(1, "short only"), (2, None)])).count() == 0
