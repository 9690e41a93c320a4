from kinforge.__main__ import main
from kinforge.operators import model
from kinforge.operators.validate import header_problem, validate
from kinforge.plans import linkage
from kinforge.sources import records as rec


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity_id string")


def test_tsv_keeps_quotes_and_placeholders(spark, tmp_path):
    path = put(tmp_path / "s.tsv", 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "B" C\tNA\tUS\nS1-2\t\tx, y\tFrance\n')
    rows = rec.read_tsv(spark, path).orderBy("entity_id").collect()
    assert rows[0]["business_name"] == 'A "B" C' and rows[0]["business_address"] == "NA"
    assert rec.read_tsv(spark, path, reader_na=True).orderBy("entity_id").first()["business_address"] is None


def test_id_lists_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-2", "S3-9"), ("S1-2", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    lists = rec.matched_lists(ids(spark, "S1-2", "S1-1", "S1-3"), pairs)
    rec.write_id_lists(lists, str(tmp_path / "m.tsv"))
    assert (tmp_path / "m.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1,S3-9\nS1-3\t\n"
    back = rec.truth_pairs(rec.read_tsv(spark, str(tmp_path / "m.tsv"), rec.TRUTH))
    assert sorted(map(tuple, back.collect())) == [("S1-2", "S2-1"), ("S1-2", "S3-9")]
    ranked = pairs.selectExpr("*", "case when candidate_entity_id = 'S3-9' then 1 else 2 end as candidate_rank")
    got = {r[0]: r[1] for r in rec.candidate_lists(ids(spark, "S1-2", "S1-1"), ranked).collect()}
    assert got == {"S1-2": "S3-9,S2-1", "S1-1": ""}
    assert rec.read_ids(spark, str(tmp_path / "m.tsv")).count() == 3


def test_parquet_merge_and_empty(spark, tmp_path):
    a = ids(spark, "x")
    rec.write_parquet(a, str(tmp_path / "a"))
    rec.write_parquet(a.limit(0), str(tmp_path / "b"))
    rec.merge_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1 and spark.read.parquet(str(tmp_path / "b")).columns == ["entity_id"]


def test_config_files(spark, tmp_path):
    folder = str(tmp_path)
    assert rec.read_config(spark, folder)["threshold"] == 0.97
    put(tmp_path / "threshold_v1.txt", "0.9\n")
    assert rec.read_config(spark, folder)["threshold"] == 0.9
    put(tmp_path / "ensemble_config.txt", "grid|0.5,0.3,0.2|0.8")
    assert rec.read_config(spark, folder) == {"method": "grid", "weights": [0.5, 0.3, 0.2], "threshold": 0.8}
    put(tmp_path / "threshold_v2.txt", "0.85")
    assert rec.read_config(spark, folder)["threshold"] == 0.85
    rec.write_config(spark, folder, {"threshold": 0.5})
    assert rec.read_config(spark, folder)["threshold"] == 0.5


def test_headers():
    want = rec.MATCHING_HEADER
    assert header_problem(None, want) == "empty_file"
    assert header_problem("source1_entity_id,matched_entity_ids", want) == "comma_separated"
    assert header_problem("a\tb", want) == "wrong_header"
    assert header_problem(" Source1_Entity_ID\tmatched_entity_ids \n", want) is None


def test_validator(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    bad = put(tmp_path / "bad.tsv", head + "S1-1\tS1-1,S2-5\nS1-2\tS2-5,S2-5\nS1-3\tS2-404\nS1-3\t\nS1-9\tX-7\nno tab here\n\n")
    report = validate(spark, bad, str(tmp_path / "none.tsv"), ids(spark, "S1-1", "S1-2", "S1-3", "S1-4"), ids(spark, "S2-5"))
    found = {r[1]: r for r in report.rows}
    assert {k for k, r in found.items() if r[2] == "error"} == {
        "malformed_row", "duplicate_row", "duplicate_in_list", "self_match", "wrong_prefix", "unknown_id", "missing_row", "extra_row",
    }
    assert found["candidate_file_missing"][2] == "warning" and found["missing_row"][4] == "S1-4" and report.exit_code == 1
    good = put(tmp_path / "good.tsv", head + "S1-1\tS2-5\nS1-2\t\n")
    cand = put(tmp_path / "cand.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-6\nS1-2\t\n")
    report = validate(spark, good, cand, ids(spark, "S1-1", "S1-2"))
    assert report.exit_code == 0 and {r[1] for r in report.rows if r[2] == "warning"} == {"id_check_off", "matched_not_in_candidates"}
    assert validate(spark, str(tmp_path / "gone.tsv"), None, ids(spark)).rows[-1][1] == "file_missing"


def test_command_line_end_to_end(spark, tmp_path):
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "sigma", "omega", "theta"]
    tables = {1: [], 2: [], 3: []}
    truth = []
    for i in range(60):
        name = f"{words[i % 8]} {words[(i // 8) % 8]} works"
        place = f"{i} {words[(i * 3) % 8]} road springfield {10000 + i}"
        tables[1].append((f"S1-{i}", name, place, "US"))
        tables[2].append((f"S2-{i}", name + " ltd", place.upper(), "US"))
        if i % 2:
            tables[3].append((f"S3-{i}", name, f"{words[i % 8]} lane", "US"))
        truth.append((f"S1-{i}", f"S2-{i}" if i % 5 else ""))
    for prefix in ("train", "test"):
        for k, rows in tables.items():
            put(tmp_path / f"{prefix}_source{k}.tsv", "entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))
    put(tmp_path / "train_ground_truth.tsv", "source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth))
    run = lambda *a: main(list(a), spark)
    d = str(tmp_path)
    assert run("split", "--data", d, "--size", "20", "--output", f"{d}/val") == 0
    assert run("features", "--data", d, "--val-split", f"{d}/val", "--k", "5", "--output", f"{d}/f_train") == 0
    assert run("features", "--split", "val", "--data", d, "--val-split", f"{d}/val", "--k", "5", "--output", f"{d}/f_val") == 0
    model.GBT_VARIANTS["tiny"] = {"maxIter": 2, "maxDepth": 2}
    assert run("train", "--train", f"{d}/f_train", "--val", f"{d}/f_val", "--val-split", f"{d}/val", "--variant", "tiny", "--model-dir", f"{d}/models") == 0
    model.GBT_VARIANTS["tiny"]["maxIter"] = 4
    assert run("train", "--train", f"{d}/f_train", "--val", f"{d}/f_val", "--val-split", f"{d}/val", "--variant", "tiny", "--early-stopping", "--model-dir", f"{d}/stopped") == 0
    assert model.load(f"{d}/stopped/model_0").stages[-1].getNumTrees <= 4
    assert run("report", "--data", d, "--per-country", "30", "--output", f"{d}/report.md") == 0
    report = (tmp_path / "report.md").read_text()
    assert "## strategy recall" in report and "| union |" in report and "rows_per_second" in report
    assert run("infer", "--model-dir", f"{d}/models", "--test-dir", d, "--output-dir", f"{d}/out", "--candidate-cap", "5") == 0
    assert run("validate", "-m", f"{d}/out/matching_results.tsv", "-c", f"{d}/out/candidate_pairs.tsv", "-t", d, "--check-ids") == 0
    lines = (tmp_path / "out" / "matching_results.tsv").read_text().splitlines()
    assert len(lines) == 61 and sum("S2-" in x for x in lines) > 30


def test_blends_are_tried_over_scores_written_once(spark):
    rows = [(f"S1-{i}", f"S2-{j}", float(i == j) * 0.7 + 0.1 * ((i * 7 + j) % 3), int(i == j)) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, f double, label int")
    learners = [model.Learner(kind, params, features=["f"]) for kind, params in (("gbt", {"maxIter": 2}), ("forest", {"numTrees": 2}), ("logistic", {}))]
    truth = df.filter("label = 1").select("source1_entity_id", "candidate_entity_id")
    models, weights, row = linkage.fit_and_choose(df, df, ids(spark, *(f"S1-{i}" for i in range(12))), truth, learners, [0.3, 0.6])
    assert len(models) == 3 and row["macro_f05"] == 1.0 and row["blend"] == "equal" and sum(weights) == 1
    assert len(model.blend_choices(3)) == len(model.BLENDS) + len(model.weight_grid()) and model.blend_choices(1) == [("single", (1.0,))]


def test_out_of_fold_scores_do_not_know_their_record(spark):
    """A record's scores stay when its own labels are turned round; others' change."""
    rows = [(f"S1-{i}", f"S2-{j}", float(i * 10 + j), int((i * 7 + j) % 3 == 0)) for i in range(18) for j in range(6)]
    schema = "source1_entity_id string, candidate_entity_id string, f double, label int"
    learner = model.Learner("gbt", {"maxIter": 3, "maxDepth": 3}, features=["f"])
    turned = [(s, c, f, 1 - y if s == "S1-4" else y) for s, c, f, y in rows]
    scores = [{(r[0], r[1]): r["score"] for r in model.out_of_fold(spark.createDataFrame(x, schema), learner).collect()} for x in (rows, turned)]
    assert len(scores[0]) == len(rows)
    assert all(scores[0][k] == scores[1][k] for k in scores[0] if k[0] == "S1-4")
    assert any(scores[0][k] != scores[1][k] for k in scores[0] if k[0] != "S1-4")


def test_model_helpers(spark):
    weights = model.weight_grid()
    assert (0.2, 0.2, 0.6) in weights and all(abs(sum(w) - 1) < 1e-6 and 0.15 <= w[2] <= 0.60 for w in weights)
    rows = spark.createDataFrame([(f"S1-{i}", float(i % 2), i % 2) for i in range(40)], "source1_entity_id string, f double, label int")
    for kind, params in (("gbt", {"maxIter": 2}), ("forest", {"numTrees": 2}), ("logistic", {})):
        fitted = model.train(rows, model.Learner(kind, params, features=["f"]))
        assert model.importances(fitted, ["f"])[0][0] == "f"
        scored = model.score(rows, fitted).collect()
        assert min(r["score"] for r in scored if r["label"] == 1) > max(r["score"] for r in scored if r["label"] == 0)


def test_of_repeated_rows_the_last_list_counts(spark, tmp_path):
    head = "source1_entity_id\tmatched_entity_ids\n"
    matched = put(tmp_path / "m.tsv", head + "S1-1\tS2-1\nS1-1\tS2-2\nS1-2\tS2-9\n")
    listed = put(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\tS2-9\nS1-2\tS2-8\n")
    off = [r for r in validate(spark, matched, listed, ids(spark, "S1-1", "S1-2")).rows if r[1] == "matched_not_in_candidates"]
    assert [r[3:] for r in off] == [(1, "S1-2")]
    fine = put(tmp_path / "d.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-1\tS2-2\nS1-2\tS2-9\n")
    assert not [r for r in validate(spark, matched, fine, ids(spark, "S1-1", "S1-2")).rows if r[1] == "matched_not_in_candidates"]
