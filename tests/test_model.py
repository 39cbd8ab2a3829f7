"""Features, sparse coding, training, saving, evaluation."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crossweft.operators import dictionary, features, metrics, relevance
from crossweft.operators.schema import FeatureSchema
from crossweft.plans import model
from crossweft.sources import artifacts
from crossweft.sources.tables import PreparedPair


@given(st.integers(0, 10_000), st.sampled_from([0.01, 0.1, 0.25, 1.0]), st.integers(2, 12), st.sampled_from(["", "twins", "near twins", "opposite", "zero"]))
@settings(max_examples=150, deadline=None, derandomize=True)
def test_lasso_optimality(seed, alpha, k, kind):
    """Default arguments; more atoms than features, and atoms that depend on each other."""
    rng = np.random.default_rng(seed)
    atoms = rng.normal(size=(k, 7))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    if kind:
        atoms[1] = {"twins": atoms[0], "near twins": atoms[0] + 1e-7 * rng.normal(size=7), "opposite": -atoms[0], "zero": np.zeros(7)}[kind]
    x = rng.normal(size=(20, 7))
    gram = atoms @ atoms.T
    codes = dictionary.lasso_codes(x @ atoms.T, gram, alpha)
    slope = (codes @ gram) - x @ atoms.T
    active = codes != 0
    assert np.all(np.abs(slope[active] + alpha * np.sign(codes[active])) < 1e-6)
    assert np.all(np.abs(slope[~active]) <= alpha + 1e-6)


def test_every_item_contributes(spark):
    """An epoch's sums are those of all rows, however few steps it is given."""
    pair = small_pair(spark)
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema)
    rows = features.transform(items, space)
    seen = []
    real = dictionary.coding_statistics

    def counted(part, atoms, alpha):
        found = real(part, atoms, alpha)
        seen.append(found[3])
        return found

    dictionary.coding_statistics = counted
    try:
        for steps, batch in ((3, 20), (8, 20), (1, 20)):
            seen.clear()
            dictionary.fit(rows, space.n_features, 4, 0.1, batch_size=batch, max_iter=steps)
            assert sum(seen) == 160 and len(seen) <= steps
    finally:
        dictionary.coding_statistics = real


@given(st.integers(0, 1_000))
@settings(max_examples=20, deadline=None)
def test_atoms_stay_in_the_unit_ball(seed):
    rng = np.random.default_rng(seed)
    codes, x = rng.normal(size=(30, 4)), rng.normal(size=(30, 6))
    codes[:, 2] = 0.0
    start = rng.normal(size=(4, 6))
    start /= np.linalg.norm(start, axis=1, keepdims=True)
    fresh = np.eye(6)[0]
    new = dictionary.update_atoms(start, codes.T @ codes, codes.T @ x, iter([fresh]))
    assert np.all(np.linalg.norm(new, axis=1) <= 1 + 1e-9) and np.array_equal(new[2], fresh)
    cost = lambda d: ((x - codes @ d) ** 2).sum()
    same = start.copy()
    same[2] = fresh
    assert cost(new) <= cost(same) + 1e-9


def small_pair(spark, n_q=40, n_c=120):
    words = ["love", "night", "rain", "fire", "river", "dance", "blue", "gold"]
    rng = np.random.default_rng(1)

    def rows(n, kind):
        out = []
        for i in range(n):
            picked = rng.choice(words, 3, replace=False)
            out.append((i, f"{kind} {i}", " ".join(picked), ["calm", "wild"][i % 2], float(i % 11), f"artist {i % 5}"))
        return out

    schema = "item_id long, title string, tags string, mood string, tempo double, artist string"
    q = spark.createDataFrame(rows(n_q, "film"), schema).drop("artist")
    c = spark.createDataFrame(rows(n_c, "tune"), schema)
    return PreparedPair(q, c, FeatureSchema(("mood",), ("tempo",), ("tags",)), "direct_pair")


@pytest.fixture(scope="module")
def trained(spark):
    return model.train(small_pair(spark), model.Settings(n_components=6, alpha=0.1, ann_bits=6, max_iter=8, batch_size=64))


def test_feature_names_and_prefix_token(spark):
    pair = small_pair(spark)
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema)
    names = [r.feature for r in space.vocab.orderBy("feature_id").collect()]
    assert names[:2] == ["cat:mood_calm", "cat:mood_wild"] and names[-1] == "num:tempo"
    assert "txt:tags" in names and any(n.startswith("txt:tags ") for n in names)
    assert names[2:-1] == sorted(names[2:-1])
    few = features.fit(items, pair.schema, max_text_features=5, min_text_df=2)
    assert few.n_features == 8
    long = features.long_rows(features.transform(items, space)).join(space.vocab, "feature_id").where("kind = 'txt'")
    lengths = long.groupBy("domain", "item_id").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert len(lengths) == 160 and all(abs(r.s - 1) < 1e-9 for r in lengths)


def test_unseen_values_give_empty_rows(spark):
    pair = small_pair(spark)
    space = features.fit(features.union_domains(pair.queries, pair.catalog), FeatureSchema(("mood",), (), ()))
    odd = spark.createDataFrame([("q", 1, "strange")], "domain string, item_id long, mood string")
    row = features.transform(odd, space).first()
    assert (row.idx, row.val) == ([], [])


@pytest.mark.parametrize("minibatch", [True, False])
def test_fit_lowers_the_objective(spark, minibatch):
    pair = small_pair(spark)
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema)
    rows = features.transform(items, space).persist()
    model_ = dictionary.fit(rows, space.n_features, 6, 0.1, use_minibatch=minibatch, batch_size=60, max_iter=6)
    if minibatch:
        with pytest.warns(UserWarning, match="not converged after 1 steps"):
            assert not dictionary.fit(rows, space.n_features, 6, 0.1, max_iter=1).converged
    assert np.all(np.linalg.norm(model_.atoms, axis=1) <= 1 + 1e-9)
    assert model_.objective[-1] < model_.objective[0]
    if not minibatch:
        assert all(b <= a + 1e-9 for a, b in zip(model_.objective, model_.objective[1:]))


def test_codes_do_not_depend_on_partitioning(spark, trained):
    items = features.union_domains(trained.pair.queries, trained.pair.catalog)
    rows = features.transform(items, trained.space).persist()
    one = dictionary.encode(rows.coalesce(1), trained.model)
    many = dictionary.encode(rows.repartition(7), trained.model)
    a = {(r.domain, r.item_id): r.code for r in one.collect()}
    b = {(r.domain, r.item_id): r.code for r in many.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)


def test_summary(trained):
    row = model.training_summary(trained).first()
    assert (row.query_items, row.catalog_items, row.total_items) == (40, 120, 160)
    assert 0 < row.sparsity_pct < 100 and 1 <= row.ann_buckets <= 64


def test_save_and_load(spark, trained, tmp_path):
    folder = str(tmp_path / "model")
    model.save(trained, folder)
    back = model.load(spark, folder, trained.pair)
    assert np.array_equal(back.model.atoms, trained.model.atoms) and np.array_equal(back.planes, trained.planes)
    assert back.space.schema == trained.space.schema
    texts = spark.createDataFrame([(1, "film 7"), (2, "@@@@@@@@@@@")], "qid long, text string")
    for kit in (trained, back):
        results, found = model.recommend_titles(kit, texts, explained=True, top_n=4, search_k=20)
        rows = results.orderBy("qid", "rank").collect()
        assert [r.rank for r in rows] == [1, 2, 3, 4] and {r.qid for r in rows} == {1}
        assert all(r.explanation.startswith("A") for r in rows)
        assert found.where("qid = 2").count() == 5
        if kit is trained:
            first = rows
    assert [tuple(r) for r in rows] == [tuple(r) for r in first]
    assert back.settings == trained.settings
    model.save(back, folder)  # reads the version before while a new one is written
    assert model.load(spark, folder, trained.pair).codes.count() == 160
    other = PreparedPair(trained.pair.queries.where("item_id > 0"), trained.pair.catalog, trained.pair.schema, "direct_pair")
    with pytest.raises(ValueError, match="Train again"):
        model.load(spark, folder, other)


@pytest.mark.parametrize("lacking", ["ann", "hyperplanes", "training_metadata", "vocab"])
def test_optional_artifacts(spark, trained, tmp_path, monkeypatch, lacking):
    """Without half of the index there is none; other optional tables only cost their use."""
    folder = str(tmp_path / "model")
    whole = artifacts.save
    monkeypatch.setattr(artifacts, "save", lambda tables, to: whole({k: v for k, v in tables.items() if k != lacking}, to))
    model.save(trained, folder)
    back = model.load(spark, folder, trained.pair)
    asked = back.query_vectors().where("qid < 3")
    methods = {r.method for r in model.recommend(asked, back.catalog(), back.planes, top_n=3, search_k=20).select("method").collect()}
    assert (methods == {"exact"}) == (lacking in artifacts.INDEX) and (back.planes is None) == (lacking in artifacts.INDEX)


def test_missing_artifacts(spark, tmp_path):
    artifacts.save({"codes": spark.range(1)}, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="atoms, model, item_keys"):
        artifacts.load(spark, str(tmp_path))


def relevance_loop(q, c, schema, tol):
    score = sum(str(q[x]) == str(c[x]) for x in schema.categorical)
    score += sum(abs(q[x] - c[x]) <= tol[x] for x in schema.numeric)
    tokens = lambda t: {p.lower() for p in t.replace(",", " ").split()}
    return score + sum(bool(tokens(q[x]) & tokens(c[x])) for x in schema.text)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "block_rows": 30}])
def test_relevance(spark, options):
    pair = small_pair(spark)
    schema = pair.schema
    asked = pair.queries.withColumnRenamed("item_id", "qid")
    tol = relevance.bands(pair.catalog, schema)
    qs, cs = asked.collect(), pair.catalog.collect()
    assert abs(tol["tempo"] - 0.35 * np.std([c.tempo for c in cs])) < 1e-9
    want = {q.qid: sum(relevance_loop(q, c, schema, tol) >= 2 for c in cs) for q in qs}
    got = {r.qid: r.n_relevant for r in relevance.relevant_counts(asked, pair.catalog, schema, **options).collect()}
    assert got == want
    best = relevance.best_matches(asked, pair.catalog, schema, **options).where("qid = 3").orderBy("place").collect()
    q3 = next(q for q in qs if q.qid == 3)
    order = sorted(cs, key=lambda c: (-relevance_loop(q3, c, schema, tol), c.item_id))[:10]
    assert [r.item_id for r in best] == [c.item_id for c in order]


def test_relevance_fallback_and_no_signal(spark):
    schema = FeatureSchema(("k",), (), ())
    asked = spark.createDataFrame([(1, "zz"), (2, "a")], "qid long, k string")
    catalog = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "item_id long, k string")
    pairs = asked.select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("item_id"))
    judged, counts = relevance.judge(pairs, asked, catalog, schema)
    got = {(r.qid, r.item_id) for r in judged.where("relevant").collect()}
    assert got == {(1, i) for i in range(10)} | {(2, i) for i in range(3)}
    assert {r.qid: r.n_relevant for r in counts.collect()} == {1: 10, 2: 3}
    none, zero = relevance.judge(pairs.withColumn("x", F.lit(1)), asked, catalog, FeatureSchema())
    assert zero.agg(F.sum("n_relevant")).first()[0] == 0


def test_metric_values(spark):
    judged = spark.createDataFrame(
        [(1, 10, 1, 0.5, True, [1.0, 0.0]), (1, 11, 2, 0.2, False, [0.0, 1.0]), (1, 12, 3, 0.0, True, [1.0, 0.0])],
        "qid long, item_id long, rank int, similarity double, relevant boolean, vec array<double>",
    )
    counts = spark.createDataFrame([(1, 2), (2, 4)], "qid long, n_relevant long")
    rows = {(r.qid, r.K): r for r in metrics.query_metrics(judged, counts, (3, 5)).collect()}
    r = rows[(1, 5)]
    assert r.precision == 0.4 and r.recall == 1.0 and abs(r.f1 - 0.8 / 1.4) < 1e-12
    assert abs(rows[(1, 3)].ndcg - 0.919721) < 1e-6
    assert abs(r.diversity - 2 / 3) < 1e-12 and abs(r.serendipity - (0.25 + 0.5) / 2) < 1e-12
    assert all(rows[(2, 5)][m] == 0 for m in ("precision", "recall", "f1", "ndcg", "diversity", "serendipity"))
    cov = {r.K: r.coverage for r in metrics.coverage(judged, 6, (1, 5)).collect()}
    assert cov == {1: 1 / 6, 5: 0.5}
    empty = metrics.query_metrics(judged.limit(0), counts.limit(0), (5,), 2)
    assert [tuple(r) for r in metrics.summary(empty, metrics.coverage(judged.limit(0), 6, (5,))).collect()] == [(5, *[0.0] * 7)]


def test_evaluation_bounds(spark):
    summary, held = model.evaluate(small_pair(spark), model.Settings(n_components=5, alpha=0.1, max_iter=4, ann_bits=5))
    rows = {r.K: r for r in summary.collect()}
    assert set(rows) == {5, 10} and 0 < held < 40
    for r in rows.values():
        assert all(0 <= r[m] <= 1 for m in ("precision", "recall", "f1", "ndcg", "serendipity", "coverage"))
        assert 0 <= r.diversity <= 2
    assert json.dumps({k: list(r) for k, r in rows.items()})


def test_terms_are_counted_without_a_shuffle(spark):
    """No exchange lies under the tokeniser, when fitting or transforming; sparse rows move once."""
    pair = small_pair(spark)
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema)
    plan = features.transform(items, space)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "Repartition" not in plan
    physical = features.transform(items, space)._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("regexp_extract_all") == 1 and "SortMergeJoin" not in physical  # one pass over the texts
    counts = features.term_counts(items, space.text())
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("buckets", [None, 7])
def test_frequent_terms_are_exact(spark, buckets):
    """Whatever the sketch's width, the vocabulary is that of a full count; ties go by term."""
    rng = np.random.default_rng(7)
    rows = [("c", i, " ".join(f"w{int(v)}" for v in rng.zipf(1.3, size=40) if v < 400)) for i in range(120)] + [("q", 1, ""), ("q", 2, None)]
    items = spark.createDataFrame(rows, "domain string, item_id long, t string")
    full = features.document_frequency(features.term_counts(items, F.col("t")))
    for cap, least in ((5, 1), (40, 3), (10_000, 2), (0, 1)):
        want = {tuple(r) for r in features.cap_vocabulary(full, cap, least).collect()}
        assert {tuple(r) for r in features.frequent_terms(items, F.col("t"), True, cap, least, buckets).collect()} == want


def test_terms_of_an_item_are_counted_in_its_row(spark):
    rows = [("c", 1, "aa bb aa aa"), ("c", 2, ""), ("c", 3, None), ("q", 1, "Aa")]
    items = spark.createDataFrame(rows, "domain string, item_id long, t string")
    got = {tuple(r) for r in features.term_counts(items, F.col("t")).collect()}
    assert got == {("c", 1, "aa", 3), ("c", 1, "bb", 1), ("c", 1, "aa bb", 1), ("c", 1, "bb aa", 1), ("c", 1, "aa aa", 1), ("q", 1, "aa", 1)}


def test_large_vocabularies_are_split(spark):
    """Beyond the limit the common features are answered from a broadcast, the others by a join: same rows."""
    pair = small_pair(spark)
    items = features.union_domains(pair.queries, pair.catalog)
    space = features.fit(items, pair.schema)
    whole = {(r.domain, r.item_id): (r.idx, r.val) for r in features.transform(items, space).collect()}
    split = features.transform(items, space, limit=space.vocab_bytes // 3)
    assert {(r.domain, r.item_id): (r.idx, r.val) for r in split.collect()} == whole
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftOuter" in plan
    assert features.transform(items, space, limit=0).count() == 160


@pytest.mark.parametrize("n,share", [(1, 0.2), (7, 0.5), (503, 0.2), (40, 0.0), (40, 1.0), (0, 0.2)])
def test_exact_holdout(spark, monkeypatch, n, share):
    monkeypatch.setattr(model, "BORDER_KEYS", 1)
    rows = spark.range(n).select(F.when(F.col("id") >= 0, F.concat(F.lit("k"), "id")).alias("key"))
    rows = rows.union(spark.createDataFrame([(None,)], "key string"))
    held = rows.where(model.exact_holdout(rows, "key", share)).select("key")
    picked = {r.key for r in held.collect()}
    assert len(picked) == int(share * n + 0.5) and None not in picked
    dealt = rows.repartition(5)
    assert {r.key for r in dealt.where(model.exact_holdout(dealt, "key", share)).collect()} == picked


def test_exact_holdout_keeps_repeated_keys_together(spark):
    rows = spark.range(90).select((F.col("id") % 3).alias("key"))
    counts = [r["count"] for r in rows.where(model.exact_holdout(rows, "key", 0.5)).groupBy("key").count().collect()]
    assert counts == [30, 30]


def test_list_recall(spark):
    exact = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4)] + [(2, 9, 1)], "qid long, item_id long, rank int")
    found = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (1, 7, 2), (1, 1, 3), (3, 1, 1)], "qid long, item_id long, rank int")
    got = {(r.qid, r.n_exact, r.n_found, r.recall) for r in metrics.list_recall(found, exact, 2).collect()}
    assert got == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}


def test_codes_do_not_depend_on_rows_coded_together(monkeypatch):
    """Rows swept in pieces of any number have the same codes, bit by bit, and they are optimal."""
    rng = np.random.default_rng(5)
    atoms = rng.standard_normal((6, 20)) + 0.8 * rng.standard_normal((1, 20))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    q, gram = rng.standard_normal((50, 20)) @ atoms.T, atoms @ atoms.T
    found = []
    for rows in (3, 50):
        monkeypatch.setattr(dictionary, "CODED_ROWS", rows)
        found.append(dictionary.lasso_codes(q, gram, 0.2))
    assert (found[0] == found[1]).all() and dictionary.optimality_gap(found[0], q, gram, 0.2).max() < 1e-6


def test_like_atoms_need_few_sweeps(monkeypatch):
    """Codes of a few atoms that are much alike end once their signs are settled; equal atoms harm no other row."""
    rng = np.random.default_rng(5)
    atoms = rng.normal(size=(1, 60)) + 0.3 * rng.normal(size=(8, 60))
    atoms = np.vstack([atoms / np.linalg.norm(atoms, axis=1)[:, None], np.eye(60)[:1], np.eye(60)[:1]])
    x = rng.random((300, 10)) * (rng.random((300, 10)) < 0.3) @ atoms
    q, gram = x @ atoms.T, atoms @ atoms.T
    swept, calls = dictionary._swept, []
    monkeypatch.setattr(dictionary, "_swept", lambda codes, *rest: (calls.append(len(codes)), swept(codes, *rest))[1])
    codes = dictionary.lasso_codes(q, gram, 0.2)
    assert dictionary.optimality_gap(codes, q, gram, 0.2).max() <= 1e-8 * np.abs(q).max()
    assert sum(calls) < 10 * len(q)  # 22 sweeps of five a row by descent alone
    alone = [dictionary.lasso_codes(q[k : k + 1], gram, 0.2) for k in range(0, 300, 30)]
    assert (np.vstack(alone) == codes[::30]).all()


def test_codes_are_found_without_sweeps(monkeypatch):
    """Rows of few atoms, beside like atoms, an empty one and zero rows: searched side by side, equal to the descent."""
    rng = np.random.default_rng(4)
    atoms = rng.standard_normal((24, 60)) * (rng.random((24, 60)) < 0.2)
    atoms[5] = atoms[4] + 0.05 * rng.standard_normal(60)
    atoms[6] = 0.0
    atoms /= np.maximum(np.linalg.norm(atoms, axis=1, keepdims=True), 1e-12)
    rows = (rng.standard_normal((3000, 24)) * (rng.random((3000, 24)) < 0.1)) @ atoms + 0.02 * rng.standard_normal((3000, 60))
    rows[:10] = 0.0
    q, gram = rows @ atoms.T, atoms @ atoms.T
    residual, live = q.copy(), np.flatnonzero(np.diag(gram) > 0)
    slow, _ = dictionary._swept(np.zeros_like(q), residual, gram, 0.1, live, 3000)
    monkeypatch.setattr(dictionary, "_swept", None)
    fast = dictionary.lasso_codes(q, gram, 0.1)
    assert np.abs(fast - slow).max() < 1e-7 and (fast[:10] == 0).all() and (fast[:, 6] == 0).all()
    assert dictionary.optimality_gap(fast, q, gram, 0.1).max() < 1e-8
