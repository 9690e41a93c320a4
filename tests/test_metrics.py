import pytest

from kinforge.operators import metrics, split

PAIR = "source1_entity_id string, candidate_entity_id string"


@pytest.fixture(scope="module")
def case(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("a", "z"), ("d", "q")], PAIR)
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.7), ("c", "w", 0.75)], PAIR + ", score double")
    return ids, truth, scored


def test_entities(case):
    ids, truth, scored = case
    rows = {r["source1_entity_id"]: r for r in metrics.entity_scores(metrics.entity_counts(ids, truth, scored)).collect()}
    assert round(rows["a"]["f"], 3) == 0.714 and round(rows["a"]["precision"], 3) == 0.667 and rows["a"]["recall"] == 1
    assert (rows["b"]["precision"], rows["b"]["recall"], rows["b"]["f"]) == (1, 1, 1)
    assert rows["c"]["f"] == rows["d"]["f"] == 0


def test_macro_and_sweep(case):
    ids, truth, scored = case
    grid = [0.6, 0.72, 0.85, 0.95]
    swept = {r["threshold"]: r.asDict() for r in metrics.threshold_sweep(ids, truth, scored, grid).collect()}
    for t in grid:
        one = metrics.evaluate(ids, truth, scored.filter(f"score >= {t}")).first().asDict()
        assert {k: pytest.approx(v) for k, v in one.items()} == {k: v for k, v in swept[t].items() if k != "threshold"}
    assert metrics.best_threshold(metrics.threshold_sweep(ids, truth, scored, grid)).first()["threshold"] == 0.85


def test_empty(spark, case):
    ids, truth, scored = case
    row = metrics.evaluate(ids, truth.limit(0), scored.limit(0)).first()
    assert row["macro_f05"] == 1 and row["n_singletons"] == 4 and row["non_singleton_f05"] == 0


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_ranking_quality(spark, digits):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (0.80000001, 0), (0.79999999, 1)]
    got = metrics.ranking_quality(spark.createDataFrame(rows, "score double, label int"), digits).first()
    pairs = [(a, b) for a, x in rows for b, y in rows if x == 1 and y == 0]
    assert got["roc_auc"] == pytest.approx(sum(1.0 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs))
    assert got["average_precision"] == pytest.approx((1 / 1 + 2 / 4 + 3 / 5 + 4 / 7) / 4)


def test_split(spark):
    rows = [(f"S1-{i}", "US" if i % 3 else "India", ["singleton", "1_match"][i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "source1_entity_id string, country string, b string").selectExpr("source1_entity_id", "country", "country || '_' || b as stratum")
    for size in (1, 50, 97, 300, 400):
        got = split.stratified_split(df, size).collect()
        assert len({r["source1_entity_id"] for r in got}) == len(got) == min(size, 300)
    got = split.stratified_split(df, 60).groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in got} == {"US_singleton": 20, "US_1_match": 20, "India_singleton": 10, "India_1_match": 10}


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 6)], "n int").select(split.match_bucket(__import__("pyspark").sql.functions.col("n")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["singleton", "1_match", "2-5_matches", "2-5_matches", "6+_matches"]
