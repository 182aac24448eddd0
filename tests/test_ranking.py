import pytest
from pyspark.sql import functions as F

from codelode.operators import ranking as rk

ROWS = [
    (1, "src/core/store.py", 0.96, 10, 50, 1, ["alpha", "beta"], True),
    (2, "tests/test_store.py", 0.91, 3, 20, 30, ["gamma", "delta"], False),
    (3, "src/util/rows.py", 0.84, 15, 100, 0, ["alpha", "epsilon"], True),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame(ROWS, "file_id long, file_path string, similarity double, complexity int, lines int, age int, imports array<string>, has_docstring boolean")
    return df.withColumn("last_modified", F.expr("timestamp'2024-01-31' - make_dt_interval(age)"))


def order(df):
    return [r.file_id for r in df.collect()]


@pytest.mark.parametrize(
    ("criteria", "want"),
    [
        (dict(similarity=1.0), [1, 2, 3]),
        (dict(complexity=1.0, prefer_simple=True), [2, 1, 3]),
        (dict(recency=1.0), [3, 1, 2]),
        (dict(similarity=1.0, exclude_tests=True), [1, 3]),
        (dict(similarity=1.0, min_similarity=0.9), [1, 2]),
        (dict(similarity=0.5, boost_imports=("beta",)), [1, 2, 3]),
        (dict(), [1, 2, 3]),
    ],
)
def test_criteria(results, criteria, want):
    assert order(rk.rank(results, rk.Criteria(**criteria))) == want


def test_weights_out_of_range(results):
    with pytest.raises(ValueError, match="between 0 and 1"):
        rk.rank(results, rk.Criteria(similarity=1.5))
    with pytest.raises(ValueError, match="add up"):
        rk.final(*[F.lit(0.5)] * 4, weights={"semantic": 0.5})


def test_custom_scorer_adds_and_clamps(results):
    low = rk.Criteria(similarity=0.5, scorer=lambda df: F.when(df["file_id"] == 3, 5.0))
    top = rk.rank(results, low).first()
    assert (top.file_id, top.score) == (3, 1.0)


def test_missing_date_counts_nothing(spark, results):
    df = results.withColumn("last_modified", F.when(F.col("file_id") == 3, F.lit(None)).otherwise(F.col("last_modified")))
    assert order(rk.rank(df, rk.Criteria(recency=1.0)))[0] == 1


def test_diversity_mixes_directories(spark):
    rows = [(1, 1, "src/db/conn.py", 0.95), (1, 2, "src/db/pool.py", 0.94), (1, 3, "src/db/manager.py", 0.92), (1, 4, "src/api/handler.py", 0.93)]
    df = spark.createDataFrame(rows, "query_id long, file_id long, file_path string, score double")
    got = [r.file_path for r in rk.diversify(df, 0.3).orderBy("position").collect()]
    assert not (got[0].startswith("src/db/") and got[1].startswith("src/db/"))
    assert len(got) == 4


def test_scores_stay_in_range(spark):
    df = spark.range(200).select(rk.relevance("get user name", F.concat(F.lit("get_user_"), F.col("id").cast("string")), F.lit("name of a user")).alias("r"), rk.popularity(F.lit("get_main"), F.lit("x"), F.col("id")).alias("p"))
    low, high = df.agg(F.min(F.least("r", "p")), F.max(F.greatest("r", "p"))).first()
    assert 0 <= low and high <= 1


def test_diversify_reranks_every_row_like_the_plain_greedy_way(spark):
    rows = [(1, i, f"d{i * 7 % 13}/x/{i}.py", (i * 37 % 101) / 100) for i in range(1200)]
    left, seen, want = sorted(rows, key=lambda r: (-r[3], r[1])), {}, []
    while left:
        cost = [min((seen.get(r[2][: r[2].rindex("/")], -1) + 1) * 0.3, 0.9) for r in left]
        r = left.pop(max(range(len(left)), key=lambda k: (left[k][3] * (1 - cost[k]), -k)))
        seen[r[2][: r[2].rindex("/")]] = seen.get(r[2][: r[2].rindex("/")], 0) + 1
        want.append(r[1])
    df = spark.createDataFrame(rows, "query_id long, file_id long, file_path string, score double")
    assert [r.file_id for r in rk.diversify(df, 0.3).orderBy("position").collect()] == want
