"""Exact and hashed retrieval against brute force, on both physical paths."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from crossweft.operators import blocks, lsh, rerank, similarity, titles
from crossweft.plans import model


def frames(spark, seed=0, nq=23, nc=160, dim=6, zeros=30, bias=False):
    rng = np.random.default_rng(seed)
    q, c = rng.normal(size=(nq, dim)), rng.normal(size=(nc, dim))
    c[:zeros] = 0.0
    q[0] = 0.0
    b = rng.normal(size=nc) * 0.1
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(nq)], "qid long, vec array<double>")
    catalog = spark.createDataFrame(
        [(i, c[i].tolist(), float(b[i])) for i in range(nc)], "item_id long, vec array<double>, bias double"
    )
    return q, c, b, queries, catalog if bias else catalog.drop("bias")


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def brute(q, c, k, extra=0.0):
    scores = np.round(unit(q) @ unit(c).T + extra, 6)
    return {i: np.lexsort((np.arange(len(c)), -scores[i]))[:k].tolist() for i in range(len(q))}


def lists(df, k):
    got = {}
    for r in df.where(F.col("rank") <= k).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.item_id)
    return got


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "block_rows": 40}])
def test_exact_top_k_with_ties_and_bias(spark, options):
    q, c, b, queries, catalog = frames(spark, bias=True)
    assert lists(similarity.top_scored(queries, catalog, 7, **options), 7) == brute(q, c, 7, b[None, :])


def test_a_table_in_one_partition_is_scanned_by_all_cores(spark):
    """The scan of a small stored table is dealt out where its pairs are many, and only there."""
    left = spark.range(900).withColumnRenamed("id", "qid")
    right = spark.range(40_000).withColumnRenamed("id", "item_id").coalesce(1)

    def kernel(a, b):
        return pa.table({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [a.num_rows * b.num_rows]})

    def scanned(left):
        found = blocks.pair_blocks(left, right, kernel, pa.concat_tables, "task int, n long", "qid", "item_id")
        return found.groupBy("task").agg(F.sum("n").alias("n")).collect()

    tasks = scanned(left)
    assert len(tasks) > 4 and sum(r.n for r in tasks) == 36_000_000 and max(r.n for r in tasks) < 9_000_000
    assert [r.n for r in scanned(left.limit(3))] == [120_000]


def test_best_of_rows_with_many_ties():
    rng = np.random.default_rng(5)
    for levels in (1, 2, 9, 10**6):
        for n, k in ((4, 5), (11, 10), (700, 3)):
            scores = rng.integers(levels, size=(40, n)) / levels
            scores[3] = np.nan
            rows, cols = similarity.best_per_row(scores, k)
            for row in set(range(40)) - {3}:
                want = np.lexsort((np.arange(n), -scores[row]))[:k]
                assert sorted(cols[rows == row]) == sorted(want)


def test_cells_hold_many_blocks(spark, monkeypatch):
    """Rows travel once a cell, not once a block; blocks inside a cell give the same lists."""
    shape = blocks.grid_shape(900_000, 60_000, 400, 12)
    assert shape == blocks.grid_shape(900_000, 60_000, 32_768, 12) and 900_000 * shape[1] + 60_000 * shape[0] < 4_000_000
    q, c, b, queries, catalog = frames(spark, bias=True)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 7)
    got = similarity.top_scored(queries, catalog, 7, broadcast_rows=0, block_rows=7)
    assert lists(got, 7) == brute(q, c, 7, b[None, :])


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_exact_top_k_does_not_depend_on_partitioning(spark, parts):
    q, c, _, queries, catalog = frames(spark, 3)
    got = similarity.top_scored(queries.repartition(parts), catalog.repartition(parts), 5)
    assert lists(got, 5) == brute(q, c, 5)


def test_text_ids(spark):
    _, _, _, queries, catalog = frames(spark, 1)
    named = catalog.withColumn("item_id", F.format_string("item-%03d", "item_id"))
    a = lists(similarity.top_scored(queries, catalog, 5), 5)
    b = lists(similarity.top_scored(queries.withColumn("qid", F.col("qid").cast("string")), named, 5), 5)
    assert {str(k): [f"item-{i:03d}" for i in v] for k, v in a.items()} == b


def test_keys():
    assert lsh.mask_count(24, 2) == 301 == len({m for m, _ in lsh.probe_masks(24, 2)})
    for bits in (0, 64):
        with pytest.raises(ValueError):
            lsh.hyperplanes(bits, 4)


def test_key_packing(spark):
    planes = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 0.0],)], "vec array<double>")
    assert [r[0] for r in df.select(lsh.lsh_key(F.col("vec"), planes)).collect()] == [5, 7]


def loop_candidates(qkey, keys, radius, search_k):
    """Radius by radius, stopping once enough items are found."""
    found = []
    for r in range(radius + 1):
        found += [i for i, k in enumerate(keys) if bin(int(qkey) ^ int(k)).count("1") == r]
        if len(found) >= search_k:
            break
    return sorted(found)


@pytest.mark.parametrize("radius,search_k", list(itertools.product([0, 1, 2, 4], [1, 12, 500])))
def test_ring_cutoff_equals_the_radius_loop(spark, radius, search_k):
    _, c, _, queries, catalog = frames(spark, 5)
    planes = lsh.hyperplanes(6, 6)
    items = catalog.withColumn("key", lsh.lsh_key(F.col("vec"), planes)).persist()
    asked = queries.withColumn("key", lsh.lsh_key(F.col("vec"), planes)).persist()
    kept = lsh.ring_cutoff(lsh.probe_hits(asked, lsh.bucket_counts(items), 6, radius), search_k)
    got = {}
    for r in lsh.candidates(kept, items).collect():
        got.setdefault(r.qid, []).append(r.item_id)
    keys = [r.key for r in items.orderBy("item_id").collect()]
    for r in asked.collect():
        assert sorted(got.get(r.qid, [])) == loop_candidates(r.key, keys, radius, search_k)


def test_answers_stream_by(spark, monkeypatch):
    """No task builds more answers at a time than allowed, and the lists are the same."""
    q, c, b, queries, catalog = frames(spark, bias=True)
    rows = similarity.item_rows(catalog).withColumn("cell", F.lit(1))
    asked = similarity.query_rows(queries).withColumn("cell", F.lit(1))

    def sizes(batches):
        for a, held in blocks.met_in_cells(batches, ["cell"], 6):
            yield pa.RecordBatch.from_pydict({"a": [a.num_rows], "b": [held.num_rows]})

    met = blocks.dealt_in_cells(asked, rows, ["cell"]).mapInArrow(sizes, "a long, b long").collect()
    assert sum(r.a for r in met) == len(q) and max(r.a for r in met) == 6 and {r.b for r in met} == {len(c)}
    monkeypatch.setattr(blocks, "ANSWER_ROWS", 40)
    assert lists(similarity.top_scored(queries, catalog, 7), 7) == brute(q, c, 7, b[None, :])


@pytest.mark.parametrize("block_rows", [4_096, 16])
def test_bucket_search_with_hot_buckets_split(spark, block_rows):
    q, c, _, queries, catalog = frames(spark, 7, zeros=90)
    planes = lsh.hyperplanes(5, 6)
    items = catalog.withColumn("key", lsh.lsh_key(F.col("vec"), planes)).persist()
    asked = queries.withColumn("key", lsh.lsh_key(F.col("vec"), planes)).persist()
    kept = lsh.ring_cutoff(lsh.probe_hits(asked, lsh.bucket_counts(items), 5, 2), 20)
    got = lists(lsh.top_in_buckets(kept, queries, items, 6, block_rows), 6)
    keys = [r.key for r in items.orderBy("item_id").collect()]
    scores = np.round(unit(q) @ unit(c).T, 6)
    for r in asked.collect():
        pool = np.array(loop_candidates(r.key, keys, 2, 20), dtype=int)
        best = pool[np.lexsort((pool, -scores[r.qid][pool]))][:6].tolist()
        assert got.get(r.qid, []) == best


def test_policy_labels(spark):
    _, _, _, queries, catalog = frames(spark, 2)
    planes = lsh.hyperplanes(12, 6)
    items = catalog.withColumn("key", lsh.lsh_key(F.col("vec"), planes))
    found = lsh.retrieve(queries, items, planes, top_n=4, search_k=30, radius=1)
    sizes = found.groupBy("qid", "method", "pool_size").count().collect()
    assert len(sizes) == 23 and {r.method for r in sizes} <= {"ann", "exact_fallback"}
    for r in sizes:
        assert r.pool_size == 160 if r.method == "exact_fallback" else r.pool_size >= 20
    exact = lsh.retrieve(queries, items, planes, top_n=4, use_ann=False)
    assert {r.method for r in exact.select("method").distinct().collect()} == {"exact"}


def mmr_loop(scores, units, top_n, weight=0.78):
    if len(scores) <= top_n:
        return list(range(len(scores)))
    chosen = []
    while len(chosen) < top_n:
        def gain(i):
            near = max((units[i] @ units[j] for j in chosen), default=None)
            return scores[i] if near is None else weight * scores[i] - (1 - weight) * near
        left = [i for i in range(len(scores)) if i not in chosen]
        chosen.append(max(left, key=lambda i: (round(gain(i), 6), -i)))
    return chosen


def test_diversity(spark):
    q, c, _, queries, catalog = frames(spark, 9, zeros=3)
    pool = rerank.attach_vectors(similarity.top_scored(queries, catalog, 30), catalog).persist()
    got = lists(rerank.diversify(pool, 3), 3)
    for qid in range(len(q)):
        rows = pool.where(F.col("qid") == qid).orderBy("rank").collect() if qid < 3 else None
        if rows is None:
            assert len(got[qid]) == 3
            continue
        order = mmr_loop([round(r.score, 9) for r in rows], unit(np.array([r.vec for r in rows])), 3)
        assert got[qid] == [rows[i].item_id for i in order]


def test_small_pool_is_unchanged(spark):
    _, _, _, queries, catalog = frames(spark, 9, nc=3, zeros=0)
    pool = similarity.top_scored(queries, catalog, 50)
    got = lists(rerank.diversify(rerank.attach_vectors(pool, catalog), 5), 5)
    assert got == lists(pool, 5)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def test_edit_similarity():
    names = ["", "a", "kitten", "sitting", "été", "Ètè ab", "aaaaaaaaaa"]
    raw, lengths = titles._code_points(names)
    for text in ["", "b", "sitten", "ete", "aaab"]:
        got = titles.edit_similarity(text, raw, lengths)
        want = [1 - edit_distance(text, n) / max(len(text), len(n), 1) for n in names]
        assert np.allclose(got, want)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "block_rows": 2}])
def test_titles(spark, options):
    items = spark.createDataFrame(
        [(1, "Toy Story"), (2, "Story Toy"), (3, "Heat"), (4, "Toy Story"), (5, "Jaws"), (6, "Alien")], "item_id int, title string"
    )
    texts = spark.createDataFrame([("a", "Toy Stori"), ("b", "zzzzzzzzzzzz")], "qid string, text string")
    rows = titles.match_titles(texts, items, **options).orderBy("qid", "rank").collect()
    a = [r for r in rows if r.qid == "a"]
    assert [r.item_id for r in a[:3]] == [1, 4, 2] and a[0].accepted and not a[1].accepted
    assert len(a) == 5 and not any(r.accepted for r in rows if r.qid == "b")


def title_score(a, b):
    def edit(x, y):
        return 1 - edit_distance(x, y) / max(len(x), len(y), 1)

    words, others = set(a.split()), set(b.split())
    loose = max(edit(*(" ".join(sorted(t.split())) for t in (a, b))), len(words & others) / max(len(words | others), 1))
    return round(100 * max(edit(a, b), 0.95 * loose), 6)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text("abé x\U0001F600", max_size=9), min_size=1, max_size=40, unique=True),
    st.text("abé x\U0001F600", max_size=9),
    st.integers(1, 5),
)
def test_title_index_loses_nothing(names, text, limit):
    names.sort()
    block = titles.TitleBlock(names)
    exact = [title_score(text, n) for n in names]
    assert all(bound >= 1 - edit_distance(text, n) / max(len(text), len(n), 1) for bound, n in zip(block.raw_index.bound(text), names))
    want = sorted(range(len(names)), key=lambda i: (-exact[i], i))[:limit]
    for floor in (0.0, exact[want[-1]]):
        best, scores, _ = block.closest(text, limit, floor)
        assert list(best) == want and list(scores) == [exact[i] for i in want]


def scored_share(names, texts, n_blocks=4):
    blocks = [titles.TitleBlock(names[i::n_blocks]) for i in range(n_blocks)]
    scored = 0
    for text in texts:
        looks = [block.closest(text, 5, first_look=True) for block in blocks]
        floor = sorted(s for _, scores, _ in looks for s in scores)[-5]
        scored += sum(n for _, _, n in looks) + sum(block.closest(text, 5, floor)[2] for block in blocks)
    return scored / len(texts) / len(names)


def test_title_index_scores_few_pairs():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(3, 8))) for _ in range(400)]
    names = sorted({" ".join(rng.sample(words, rng.randint(2, 4))) for _ in range(3000)})
    # Nothing is like these titles but themselves: the fifth best is a chance likeness.
    assert scored_share(names, [n[:3] + n[4:] for n in names[::60]]) < 0.4
    series = sorted(f"{n} {part}" for n in names[::6] for part in ("I", "II", "III", "IV", "V", "VI"))
    assert scored_share(series, [n[:3] + n[4:] for n in series[::60]]) < 0.05


def test_null_titles_and_texts(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Heat")], "item_id int, title string")
    texts = spark.createDataFrame([("a", None), ("b", "")], "qid string, text string")
    rows = titles.match_titles(texts, items).orderBy("rank").collect()
    assert [(r.qid, r.item_id, r.match_score) for r in rows] == [("b", 2, 100.0), ("b", 3, 0.0)]


def test_playlist_has_no_repeats_and_needs_picks(spark):
    _, _, _, queries, catalog = frames(spark, 4)
    planes = lsh.hyperplanes(6, 6)
    items = catalog.withColumn("key", lsh.lsh_key(F.col("vec"), planes)).withColumn("title", F.lit("t")).withColumn("artist", F.lit("a"))
    for use_ann in (True, False):
        rows = model.playlist(queries, items, planes, 3, 2, use_ann=use_ann, search_k=20).collect()
        assert len(rows) == 23 * 6 == len({(r.qid, r.item_id) for r in rows})
        assert {(r.stage, r.stage_rank) for r in rows} == {(s, k) for s in ("setup", "conflict", "climax") for k in (1, 2)}
        assert all(abs(r.novelty - as_novelty(r.similarity)) < 1e-12 and 0 <= r.energy <= 1 for r in rows)
    with pytest.raises(ValueError):
        model.playlist(queries, items, planes, 3, 0)


def as_novelty(s):
    return 1 - (s + 1) / 2


def test_plans(spark):
    """Hamming probing is an equi-join, and no pair is formed by a nested loop."""
    _, _, _, queries, catalog = frames(spark)
    planes = lsh.hyperplanes(8, 6)
    items = catalog.withColumn("key", lsh.lsh_key(F.col("vec"), planes))
    asked = queries.withColumn("key", lsh.lsh_key(F.col("vec"), planes))
    kept = lsh.ring_cutoff(lsh.probe_hits(asked, lsh.bucket_counts(items), 8, 2), 20)
    for df in (lsh.candidates(kept, items), similarity.top_scored(queries, catalog, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n_bits,radius,search_k", [(12, 5, 30), (12, 12, 10_000), (17, 6, 200), (9, 4, 1)])
def test_wide_rings_equal_a_loop(spark, monkeypatch, n_bits, radius, search_k):
    """Rings beyond the spelled-out masks come by key pieces and stop where enough was found."""
    monkeypatch.setattr(lsh, "MAX_MASKS", 100)
    rng = np.random.default_rng(n_bits)
    asked = sorted({0, *map(int, rng.integers(0, 1 << n_bits, 25))})
    held = {0: 400, **{int(k): int(c) for k, c in zip(rng.integers(0, 1 << n_bits, 300), rng.integers(1, 4, 300))}}
    keys = spark.createDataFrame([(k,) for k in asked], "qkey long")
    buckets = spark.createDataFrame(list(held.items()), "key long, cnt long")
    want = set()
    for q in asked:
        total = 0
        for ring in range(radius + 1):
            if total >= search_k:
                break
            near = [k for k in held if (q ^ k).bit_count() == ring]
            want |= {(q, k, ring, held[k]) for k in near}
            total += sum(held[k] for k in near)
    got = [(r.qkey, r.key, r.dist, r.cnt) for r in lsh.probe_rings(keys, buckets, n_bits, radius, search_k).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_key_pieces_compare_few_pairs(spark):
    """24 bits, radius 5: an equi-join that looks at a small part of all pairs and loses none."""
    rng = np.random.default_rng(3)
    asked, held = (sorted(set(map(int, rng.integers(0, 1 << 24, 2_000)))) for _ in range(2))
    keys = spark.createDataFrame([(k,) for k in asked], "qkey long")
    buckets = spark.createDataFrame([(k, 1) for k in held], "key long, cnt long")
    pairs = lsh.piece_candidates(keys, buckets, 24, 5)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Arrow" not in plan
    assert pairs.count() < 0.05 * len(asked) * len(held)
    dist = np.bitwise_count(np.array(asked, np.uint64)[:, None] ^ np.array(held, np.uint64)[None, :])
    assert lsh.near_buckets(keys, buckets, 24, 5).count() == (dist <= 5).sum()


def test_wide_rings_are_dealt_to_the_cores(spark):
    """Keys are few bytes: in the one partition that they lie in, all their probes were one task."""
    rng = np.random.default_rng(4)
    held = sorted(set(map(int, rng.integers(0, 1 << 24, 6_000))))
    keys = spark.createDataFrame([(k,) for k in held], "qkey long").coalesce(1)
    buckets = spark.createDataFrame([(k, 1) for k in held], "key long, cnt long")
    found = lsh.probe_rings(keys, buckets, 24, 5, 1)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert [(r.qkey, r.key, r.dist) for r in found.orderBy("qkey").collect()] == [(k, k, 0) for k in held]
    assert lsh.probe_tasks(keys, 6_000, 24, 5) < lsh.probe_tasks(keys, 6_000, 24, 7) < lsh.probe_tasks(keys, 60_000, 24, 7)


def test_blocks_are_looked_through_in_single_precision_first(monkeypatch):
    """The best rows are the same as by scoring everything: ties, near-ties, weights, bias, large and broken values."""
    rng = np.random.default_rng(7)
    n, k, dim = 3000, 7, 12
    items = rng.standard_normal((n, dim))
    items[:600] = items[0]  # a fifth of the block ties at the top of a query
    items[600:640] = items[1] * np.linspace(0.1, 5, 40)[:, None]
    items[640:700] = items[2] + 1e-6 * rng.standard_normal((60, dim))
    items[700:800] = 0.0
    asked = np.vstack([items[[0, 1, 2, 700]], rng.standard_normal((60, dim))])
    whole = []
    best = similarity.best_per_row
    monkeypatch.setattr(similarity, "best_per_row", lambda scores, k: (whole.append(len(scores)), best(scores, k))[1])
    for bias in (np.zeros(n), rng.random(n), 1e9 * rng.random(n), np.where(np.arange(n) == 5, 1e300, 0.0)):
        weights = [np.ones(64), rng.random(64), -rng.random(64)]
        lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
        queries = pa.table({"qid": np.arange(64), "vec": lists(asked), "w_sim": weights[0], "w_bias": weights[1], "w_const": weights[2]})
        table = pa.table({"item_id": rng.permutation(n), "vec": lists(items), "bias": bias})
        found = similarity.keep_best([similarity.score_block(queries, table, k)], k).to_pylist()
        got = {(r["qid"], r["item_id"]) for r in found}
        order = np.argsort(table["item_id"].to_numpy())
        unit = similarity.unit_rows(items)[order]
        sims = similarity.unit_rows(asked) @ unit.T
        scores = np.round(weights[0][:, None] * sims + weights[1][:, None] * bias[order] + weights[2][:, None], 6)
        want = {(q, int(i)) for q in range(64) for i in np.lexsort((np.arange(n), -scores[q]))[:k]}
        if bias.max() <= 1:
            assert got == want
        else:  # beyond the digits that are ranked, only the scores are defined
            assert len(got) == 64 * k and np.allclose(sorted(r["score"] for r in found if r["qid"] == 9), sorted(scores[9, i] for q, i in want if q == 9), rtol=1e-9, atol=1e-6)
    assert sum(whole) < 2 * 64 + 16
