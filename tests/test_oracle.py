"""Cheap queries against their SQL on the smallest tables (the driver runs all of them)."""

import duckdb
import pytest

from kinforge.plans.queries import ORACLE_SQL, QUERIES

NAMES = ["source_tag", "missing_profile", "duplicate_name_addr", "ground_truth_pairs", "stratified_split", "normalize_addresses", "keys_soundex", "keys_address", "block_all_topk", "macro_metrics", "candidate_lists", "sim_token_jaccard", "validate_results", "truth_classes", "block_capped", "dressed_normalized", "dressed_keys", "dressed_features", "feature_audit", "matched_not_candidates"]


def text(value):
    return f"{float(value):.5f}" if type(value).__name__ in ("float", "Decimal") else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    left = sorted(tuple(text(r[c]) for c in columns) for r in got.collect())
    assert left == sorted(tuple(map(text, r)) for r in want.fetchall())


def test_the_dressed_view_meets_every_rule(spark, sf):
    """Rules that the plain view cannot meet: each shows in some record."""
    rows = QUERIES["dressed_normalized"](spark, sf).collect()
    names, places = " ".join(r["n_norm"] for r in rows).split(), " ".join(r["a_norm"] for r in rows).split()
    assert {"and", "at", "llc", "lp", "private", "limited", "international", "technologies", "manufacturing", "services"} <= set(names)
    assert {"street", "building", "road", "number", "south", "near", "avenue", "care", "behind", "apartment", "boulevard", "west", "district", "post", "house", "southeast"} <= set(places)
    assert any(not r["n_has"] for r in rows) and any(not r["a_has"] for r in rows) and any(r["n_clean"] != r["n_norm"] for r in rows)
    for c in ("a_postal", "a_street"):
        assert 0 < sum(r[c] is None for r in rows) < len(rows)
    kinds = {r["key"].split("_")[0] for r in QUERIES["dressed_keys"](spark, sf).collect() if r["strategy"] == "address"}
    assert {"pin", "post", "st", "ash", "aw"} <= kinds


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
