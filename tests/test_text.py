"""Hand-derived results of the scalar functions."""

from pyspark.sql import functions as F

from crossweft.functions import text as X
from crossweft.functions import vectors as V
from crossweft.operators import arc, relevance, steering


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()]


def test_year_and_title(spark):
    rows = [("Toy Story (1995)",), ("T (1995) ",), ("X (1995) cut",), ("1984",), (None,)]
    title = F.col("t")
    assert values(spark, rows, "t string", X.trailing_year(title)) == [1995, 1995, None, None, None]
    assert values(spark, rows[:2], "t string", X.clean_title(title)) == ["Toy Story", "T"]


def test_era(spark):
    years = [None, 1979, 1980, 1999, 2000, 2019, 2020]
    expected = ["Unknown", "pre-1980", "1980s", "1990s", "2000s", "2010s", "2020s"]
    assert values(spark, [(y,) for y in years], "y int", X.era(F.col("y"))) == expected


def test_genres(spark):
    rows = [("Adventure|Comedy",), ("(no genres listed)",), ("",), (None,)]
    g = F.col("g")
    assert values(spark, rows, "g string", X.primary_genre(g)) == ["Adventure", "Unknown", "Unknown", "Unknown"]
    assert values(spark, rows, "g string", X.genre_text(g)) == ["Adventure Comedy", "(no genres listed)", "", "Unknown"]


def test_joined_text(spark):
    parts = [F.lit("A "), F.lit(None).cast("string"), F.lit(""), F.lit(" b")]
    assert values(spark, [(1,)], "x int", X.join_text(*parts)) == ["A b"]


def test_column_text(spark):
    rows = [(" x ", ""), ("x", "y"), ("", "y"), (None, None)]
    assert values(spark, rows, "a string, b string", X.column_text(["a", "b"])) == ["a:x", "a:x b:y", "b:y", ""]


def test_numbers_and_dates(spark):
    rows = [("1.5",), ("nan",), ("x",), (None,)]
    assert values(spark, rows, "n string", X.to_number(F.col("n"))) == [1.5, None, None, None]
    dates = [("01 Feb 2021 10:30",), ("3/2/2020",), ("2019-12-31",), ("31-12-2018",), ("13/13/2020",), ("soon",), ("",)]
    assert values(spark, dates, "d string", X.day_first_year(F.col("d"))) == [2021, 2020, 2019, 2018, None, None, None]


def test_tokens(spark):
    rows = [("Rock, rock  POP",), ("",), (None,)]
    got = values(spark, rows, "t string", X.light_tokens(F.col("t")))
    assert [set(g) for g in got] == [{"rock", "pop"}, set(), set()]
    words = values(spark, [("A big-Été x_1 b",), ("one",), ("",)], "t string", X.with_bigrams(X.words(F.col("t"))))
    assert words == [["big", "été", "x_1", "big été", "été x_1"], ["one"], []]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])]
    a, b = F.col("a"), F.col("b")
    got = values(spark, rows, "a array<double>, b array<double>", V.unit(a), F.round(V.cosine(a, b), 9))
    assert got == [([0.6, 0.8], 0.0), ([0.0, 0.0], 0.0), ([2**-0.5, 2**-0.5], 1.0)] or abs(got[2][0][0] - 2**-0.5) < 1e-12
    sims = values(spark, [(1.0,), (0.0,), (-1.0,)], "s double", V.novelty(F.col("s")))
    assert sims == [0.0, 0.5, 1.0]


def test_rules():
    texts = ["era=2010s|1990s", "x", "=v", "a=", "a=b=c", "era= 1990s "]
    assert steering.parse_rules(texts) == {"era": ["2010s", "1990s", "1990s"], "a": ["b=c"]}
    assert steering.is_empty({"x": None, "y": [" "]}) and not steering.is_empty({"era": ["", "a"]})


def values_of(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_rules_meet_columns(spark):
    df = spark.createDataFrame([("B ", "a"), ("b", "A")], "Era string, genre string")
    assert values_of(df, steering.wanted([" B", "a", "A ", ""])) == [["a", "b"]] * 2
    assert [c for c, _ in steering.resolved(df, {" era ": ["b"], "x": ["y"], "GENRE": ["a"]})] == ["Era", "genre"]
    assert values_of(df, steering.match_score(df, {" era ": [" B"], "GENRE": ["a"], "x": ["y"], "Era": []})) == [1.0, 2.0]
    assert values_of(df, steering.term_hits(["Era", "genre"], ["B", " a", "", "b", "%"])) == [3.0, 3.0]
    assert values_of(df, steering.term_hits([], ["b"])) == [0.0, 0.0]


def test_fixed_profiles():
    assert [relevance.required_matches(n) for n in range(1, 9)] == [1, 1, 2, 2, 2, 3, 3, 3]
    got = [tuple(round(x, 6) for x in w[1:]) for w in arc.stage_weights(4)]
    assert got == [(0.82, 0.12, 0.06), (0.68, 0.18, 0.14), (0.54, 0.24, 0.22), (0.4, 0.3, 0.3)]
    assert [w[0] for w in arc.stage_weights(0)] == ["setup"]
    assert len(arc.stage_weights(2)) == 2
