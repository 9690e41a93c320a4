import pytest

from kinforge.operators import features

SCHEMA = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def rows(spark):
    left = [
        ("S1-1", "Acme LLC", "1126 Lombard Avenue, Everett, WA", "US"),
        ("S1-2", "Acme", "6201 Corporate Park Drive, Greensboro, NC", "France"),
        ("S1-3", "Acme", "Flat 402, Building 7, MG Road, Bangalore 560001", "India"),
        ("S1-4", "Acme", "", "US"),
        ("S1-5", None, "1 x", "US"),
        ("S1-6", "Kestic Coastal LLC", "", "US"),
    ]
    right = [
        ("S2-1", "Acme", "Lombard Avenue, Everett, Washington", "US"),
        ("S3-2", "Acme", "006201 Corporate Park Drive, N/A, Greensboro, North Carolina", "france"),
        ("S2-3", "Acme", "Bangalore, 560001, MG Road, 7 Building, 402", "India"),
        ("S2-4", "Acme", "123 Market Street, San Francisco, CA 94105", "US"),
        ("S2-5", "Acme", "1 x", "US"),
        ("S2-6", "Kestic Coastal L.L.C.", "", "US"),
    ]
    pairs = [(f"S1-{k}", right[k - 1][0], 10.0 + k, 1) for k in range(1, 7)] + [("S1-1", "S2-3", 5.0, 2), ("S1-1", "S2-404", 4.0, 3)]
    ranked = spark.createDataFrame(pairs, "source1_entity_id string, candidate_entity_id string, blocking_score double, candidate_rank int")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    out = features.pair_features(ranked, spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), truth)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][2:-1] == list(features.FEATURES)
    return {(r[0], r[1]): r.asDict() for r in out.collect()}


def test_forty_two(rows):
    assert len(features.FEATURES) == 42
    assert ("S1-1", "S2-404") not in rows  # unknown side
    assert len(rows) == 7


def test_reordered_address(rows):
    r = rows["S1-1", "S2-1"]
    assert round(r["addr_lev_sim"], 4) == 0.6061 and round(r["addr_jw_sim"], 4) == 0.7170 and round(r["addr_token_sort"], 4) == 0.7937
    assert r["addr_word_jaccard"] == 0.5 and r["digits_overlap"] == 0 and r["street_num_exact"] == -1 and r["label"] == 1
    assert r["candidate_count"] == 3 and r["score_gap_to_top"] == 0 and r["is_source2"] == 1


def test_leading_zeros_and_unseen_country(rows):
    r = rows["S1-2", "S3-2"]
    assert r["digits_jaccard"] == 1 and r["street_num_exact"] == 1 and r["same_country"] == 1 and round(r["country_freq"], 2) == 0.15 and r["is_source3"] == 1


def test_digits_in_any_order(rows):
    r = rows["S1-3", "S2-3"]
    assert r["street_num_exact"] == 0 and r["digits_overlap"] == 1 and r["digits_jaccard"] == 1


def test_missing_sides(rows):
    r = rows["S1-4", "S2-4"]
    assert all(r[f] == -1 for f in features.FEATURE_NAMES if f.startswith("addr_") or f.startswith("digits"))
    assert r["has_addr_s1"] == 0 and r["has_addr_cand"] == 1 and r["both_have_address"] == 0
    r = rows["S1-5", "S2-5"]
    assert all(r[f] == -1 for f in features.FEATURE_NAMES if f.startswith("name_")) and r["has_name_s1"] == 0


def test_dotted_form_is_equal(rows):
    r = rows["S1-6", "S2-6"]
    assert r["name_lev_sim"] == r["name_jw_sim"] == r["name_token_set"] == 1 and r["name_suffix_match"] == 0.5 and r["name_exact_raw"] == 0 and r["name_exact_clean"] == 1


def test_correlation_of_a_constant(spark, rows):
    df = spark.createDataFrame([tuple([0.5, float(i)][k % 2] for k in range(42)) + (i % 2,) for i in range(4)], [*features.FEATURE_NAMES, "label"])
    got = {r["feature"]: r for r in features.label_correlation(df).collect()}
    assert got["name_lev_sim"]["correlation"] is None and got["name_lev_sim"]["status"] == "constant"
    assert got["name_jw_sim"]["correlation"] == pytest.approx(0.4472136)


def test_feature_rows_are_written_under_their_settings(spark, sf, tmp_path, monkeypatch):
    """The wide projection is not made one method that the JVM only interprets, and its tasks are not joined by bytes; the session is as before."""
    from kinforge.plans import queries

    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, write = spark.conf.get(name), queries.rec.write_parquet
    monkeypatch.setattr(queries.rec, "write_parquet", lambda df, path: (seen.append((spark.conf.get(name), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))), write(df, path)))
    monkeypatch.setattr(queries, "_feature_rows", lambda spark, sf_dir: spark.range(5))
    assert queries._written_features(spark, sf, str(tmp_path)).count() == 5
    assert seen == [("8000", "false")] and spark.conf.get(name) == before


def test_sets_are_intersected_once(spark):
    """Names, places, trigrams and digits are each intersected once a pair (and the tokens once more for the set ratio)."""
    from kinforge.operators import features

    rows = spark.createDataFrame([("S1-1", "acme tools", "12 elm", "US", 1), ("S2-1", "acme tool", "12 elm st", "US", 2)], "entity_id string, business_name string, business_address string, country string, source tinyint")
    ranked = spark.createDataFrame([("S1-1", "S2-1", 3.0, 1)], "source1_entity_id string, candidate_entity_id string, blocking_score double, candidate_rank int")
    made = features.pair_features(ranked, rows.filter("source = 1"), rows.filter("source = 2"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") <= 6
    r = made.first()
    assert (r["name_common_tokens"], r["addr_common_tokens"], r["digits_overlap"]) == (1, 2, 1) and round(r["addr_word_jaccard"], 4) == 0.6667
