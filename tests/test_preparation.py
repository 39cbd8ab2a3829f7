"""Sources, column roles, imputation, exact medians and global numbering."""

import statistics

import pytest
from pyspark.sql import functions as F

from crossweft.operators import ordering
from crossweft.operators import schema as S
from crossweft.sources import bridges
from crossweft.sources.tables import BRIDGE, DIRECT, SourceSpec, load_pair


def test_resolve_column():
    assert S.resolve_column(["ID", "Name", "Title"], S.QUERY_TITLES) == "Title"
    assert S.resolve_column(["a"], S.ARTISTS, required=False) is None
    with pytest.raises(ValueError, match="available"):
        S.resolve_column(["a"], S.QUERY_TITLES)


def test_csv_pair(spark, tmp_path):
    left, right = tmp_path / "left.csv", tmp_path / "right.csv"
    left.write_text('code,title,mood,speed,tags\n1,One,happy,1,"a, b"\n2,Two,,3,\n,NoId,sad,9,x\n4,,sad,9,x\n')
    right.write_text("song_id,track,mood,speed,tags,extra\n7,Seven,happy,bad,c d,1\n8,Eight,sad,5,,2\n")
    pair = load_pair(spark, SourceSpec(queries=str(left), catalog=str(right)))
    assert pair.source_type == DIRECT
    # 'speed' is text on one side, so it counts as a category
    assert pair.schema == S.FeatureSchema(categorical=("mood", "speed"), numeric=(), text=("tags",))
    rows = {r.item_id: r for r in pair.queries.collect()}
    assert set(rows) == {1, 2}
    assert (rows[2].mood, rows[2].tags, rows[1].tags) == ("Unknown", "", "a, b")
    assert {r.artist for r in pair.catalog.collect()} == {"Unknown Artist"}


def test_numeric_fill_and_all_null(spark):
    q = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", None, None)], "id int, title string, n double, z double")
    c = spark.createDataFrame([(1, "x", 4.0, None), (2, "y", 10.0, None)], "id int, title string, n double, z double")
    pair = load_pair(spark, SourceSpec(queries=q, catalog=c))
    assert pair.fills == {"n": 4.0, "z": 0.0}
    assert [r.n for r in pair.queries.orderBy("item_id").collect()] == [1.0, 4.0]


def test_ids_of_different_types_become_text(spark):
    q = spark.createDataFrame([(1, "a", "t")], "id int, title string, tags string")
    c = spark.createDataFrame([("x1", "b", "t")], "id string, title string, tags string")
    pair = load_pair(spark, SourceSpec(queries=q, catalog=c))
    assert (pair.queries.first().item_id, pair.catalog.first().item_id) == ("1", "x1")


def test_empty_and_missing_sources(spark):
    empty = spark.createDataFrame([], "id int, title string, tags string")
    full = spark.createDataFrame([(1, "a", "t")], "id int, title string, tags string")
    with pytest.raises(ValueError, match="empty"):
        load_pair(spark, SourceSpec(queries=empty, catalog=full))
    with pytest.raises(FileNotFoundError):
        load_pair(spark, SourceSpec(queries=full))


def test_no_usable_feature(spark, monkeypatch):
    full = spark.createDataFrame([(1, "a")], "id int, title string")
    monkeypatch.setattr(S, "infer_schema", lambda q, c, *_: (q, c, S.FeatureSchema()))
    with pytest.raises(ValueError, match="no usable feature"):
        load_pair(spark, SourceSpec(queries=full, catalog=full))


def test_category_limit(spark):
    def frame(n):
        return spark.range(n).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"), F.lit("same").alias("w"))

    assert S.few_valued(frame(250), frame(10), ["v", "w"]) == {"v", "w"}
    assert S.few_valued(frame(250), frame(251), ["v", "w"]) == {"w"}
    with_null = frame(250).withColumn("v", F.when(F.col("id") > 0, F.col("v")))
    assert S.few_valued(with_null, frame(250), ["v"]) == set()


def test_title_fallback(spark):
    q = spark.createDataFrame([(1, "a b")], "id int, title string")
    c = spark.createDataFrame([(1, "c d")], "item_id int, name string")
    assert load_pair(spark, SourceSpec(queries=q, catalog=c)).schema.text == (S.TITLE_FEATURE,)


def test_bridge(spark):
    items = spark.createDataFrame(
        [(1, "Toy (1995)", "A|B"), (2, "Old (1950)", "(no genres listed)"), (3, None, "A")], "movieId int, title string, genres string"
    )
    tags = spark.createDataFrame([(1, "Fun", 2), (1, "Red", 1), (1, None, 0), (9, "x", 1)], "movieId int, tag string, ts int")
    ratings = spark.createDataFrame([(1, 4.0), (1, 2.0), (9, 1.0)], "movieId int, rating double")
    listens = spark.createDataFrame(
        [
            ("X", "s1", "b", "u1", "01/02/2015"), ("X", "s1", "a", "u1", "01/02/2021"), ("X", "s1", "b", "", "x"),
            ("X", "s1", "a", "u2", None), ("X", "s1", None, "u2", None), (" ", "s2", "b", "u", None), ("Y", None, "b", "u", None),
            ("Y", "s3", "z", None, "05 Mar 1979 10:00"),
        ],
        "Artist string, Track string, Album string, Username string, Date string",
    )
    spec = SourceSpec(rated=items, tags=tags, ratings=ratings, listens=listens, tag_order=["ts"])
    pair = load_pair(spark, spec)
    assert pair.source_type == BRIDGE
    q = {r.item_id: r for r in pair.queries.collect()}
    assert set(q) == {1, 2}
    assert (q[1].tags, q[1].genre, q[1].era, q[1].quality) == ("Toy A B red fun", "A", "1990s", 3.0)
    assert (q[2].tags, q[2].genre, q[2].era, q[2].popularity) == ("Old (no genres listed)", "Unknown", "pre-1980", 0.0)
    c = {r.title: r for r in pair.catalog.collect()}
    assert (c["s1"].item_id, c["s1"].tags, c["s1"].era) == (1, "s1 X a", "2020s")
    assert (c["s3"].item_id, c["s3"].era) == (2, "pre-1980")
    assert abs(c["s1"].popularity - 1.791759) < 1e-6 and abs(c["s1"].quality - 1.098612) < 1e-6


def test_hot_item_tags_are_cut_before_the_shuffle(spark):
    tags = spark.range(5_000).select(F.when(F.col("id") < 4_000, 1).otherwise(2).alias("item_id"), F.col("id").cast("string").alias("tag"), "id")
    out = bridges.first_tags(tags, ["id"])
    assert out.where("item_id = 1").first()["tag_text"] == " ".join(str(i) for i in range(20))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_global_row_number_in_slices(spark):
    df = spark.range(5_000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    keys = [("g", False), ("id", True)]
    one = ordering.global_row_number(df, keys, "n")
    many = ordering.global_row_number(df, keys, "n", single_sort_rows=100, slices=9)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("n", [999, 1000])
def test_exact_median_of_a_table_too_large_to_collect(spark, n, hot):
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.37 % 11) if hot else F.col("id") * 0.37 % 11
    df = spark.range(n).select(value.alias("v"))
    expected = statistics.median(r.v for r in df.collect())
    assert abs(ordering.exact_median(df, F.col("v"), collect_rows=40) - expected) < 1e-9


def test_listening_log_is_read_once(spark, tmp_path):
    log = [("a", "t", "x", "u"), ("a", "t", "y", "u"), ("a", "t", "y", ""), ("a", "t", "x", "v"), ("b", "t", "", "")]
    spark.createDataFrame(log, "artist string, track string, album string, username string").withColumn(
        "listen_year", F.lit(None).cast("int")
    ).write.parquet(str(tmp_path / "log"))
    groups = bridges.listen_groups(spark.read.parquet(str(tmp_path / "log")))
    assert groups._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.artist, r.track, r.play_count, r.album, r.user_count, r.year) for r in groups.collect()}
    assert got == {("a", "t", 4, "x", 2, None), ("b", "t", 1, "", 0, None)}
