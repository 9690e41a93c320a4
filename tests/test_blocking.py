import math
import random
from collections import Counter, defaultdict

import duckdb

from kinforge.functions import keys, rules
from kinforge.operators import blocking
from kinforge.streaming import probe

SCHEMA = "entity_id string, business_name string, business_address string, country string, source tinyint"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_key_lists(spark):
    rows = [
        ("1", "Acme Tools.com Pvt Ltd", "12 Elm Street, Springfield 62704", "US", 2),
        ("2", "acme acme", "80b Main Road", "US", 2),
        ("3", None, None, "US", 2),
        ("4", "", "none", "US", 2),
        ("5", "Ashcraft Xy", "", "US", 2),
        ("6", "राम a", "x", "US", 2),
    ]
    got = {r["entity_id"]: r for r in keys.key_lists(frame(spark, rows)).collect()}
    assert got["1"]["k_name_tokens"] == ["acme", "tools", "acme_tools"]
    assert got["1"]["k_char_ngrams"] == ["p4_acme", "init2_acto"]
    assert got["1"]["k_phonetic"] == ["sx_A250", "sx2_A250_to"]
    assert got["1"]["k_address"] == [
        "pin_62704", "post_name_62704_ac", "post_num_62704_12", "st_num_word_12_elm", "st_num_word2_12_sprin", "ash_elm_springfield", "aw_springfield",
    ]
    assert got["2"]["k_name_tokens"] == ["acme", "acme", "acme_acme"]  # repeats stay
    assert got["2"]["k_address"] == []  # 80b is no number; main has four letters
    for i in ("3", "4"):
        assert not any(got[i][f"k_{s}"] for s in rules.STRATEGIES)
    assert got["5"]["k_phonetic"] == ["sx_A226", "sx2_A226_xy"]  # H and W end a run
    assert got["6"]["k_phonetic"] == [] and got["6"]["k_name_tokens"] == ["राम"]


def brute(queries, candidates, key_of, k, caps):
    """Scores and order by loops over posting lists."""
    posts = defaultdict(lambda: defaultdict(list))
    n = Counter(c["country"] for c in candidates)
    for place, c in enumerate(candidates):
        for s in rules.STRATEGIES:
            for key in key_of[c["entity_id"]][s]:
                posts[c["country"], s][key].append(place)
    out = {}
    for q in queries:
        scores, touched = defaultdict(float), {}
        pos = 0
        for s in rules.STRATEGIES:
            for key in key_of[q["entity_id"]][s]:
                post = posts[q["country"], s].get(key, [])
                if post and len(post) <= caps[s]:
                    idf = math.log(1 + n[q["country"]] / (1 + len(post)))
                    if s == "name_tokens":
                        w = idf + (1.5 if "_" in key else 0)
                    elif s == "address":
                        w = idf + (4 if key.startswith(("post_name_", "post_num_")) else 3 if key.startswith(("ash_", "st_num_word")) else 0)
                    else:
                        w = rules.FIXED_WEIGHT[s]
                    for c in post:
                        scores[c] += w
                        touched.setdefault(c, (pos, c))
                pos += 1
        best = sorted(scores, key=lambda c: (-round(scores[c], 9), touched[c]))[:k]
        out[q["entity_id"]] = [(candidates[c]["entity_id"], round(scores[c], 6)) for c in best]
    return out


def records(seed=4, n=200):
    rng = random.Random(seed)
    words = ["acme", "tools", "north", "bravo", "kopp", "delta", "ltd", "owen", "coast", "wells", "xi"]
    streets = ["elm", "lombard", "market", "wayne", "colony"]
    rows = []
    for i in range(n):
        source = rng.choice([1, 2, 3])
        name = " ".join(rng.choices(words, k=rng.randint(0, 4)))
        address = "" if rng.random() < 0.2 else f"{rng.randint(1, 9)} {rng.choice(streets)} {rng.choice(streets)} {rng.choice([560001, 560002, 12])}"
        rows.append((f"S{source}-{i:04d}", name, address, rng.choice(["US", "India", None]), source))
    return rows


def test_scores_and_order(spark):
    rows = records()
    df = frame(spark, rows).cache()
    key_of = {r["entity_id"]: {s: r[f"k_{s}"] for s in rules.STRATEGIES} for r in keys.key_lists(df).collect()}
    fields = ["entity_id", "n", "a", "country", "source"]
    dicts = [dict(zip(fields, r, strict=True)) for r in rows if r[3]]
    queries = [d for d in dicts if d["source"] == 1]
    candidates = sorted((d for d in dicts if d["source"] > 1), key=lambda d: (d["source"], d["entity_id"]))
    caps = {"name_tokens": 25, "char_ngrams": 20, "phonetic": 25, "address": 15}
    want = brute(queries, candidates, key_of, 7, caps)
    got = defaultdict(list)
    pairs = blocking.candidate_pairs(df.filter("source = 1"), df.filter("source > 1"), 7, caps)
    for r in pairs.orderBy("source1_entity_id", "candidate_rank").collect():
        got[r["source1_entity_id"]].append((r["candidate_entity_id"], round(r["blocking_score"], 6)))
    assert dict(got) == {q: c for q, c in want.items() if c}


def test_null_country_and_empty_tables(spark):
    df = frame(spark, [("S1-1", "acme", "", None, 1), ("S2-1", "acme", "", None, 2)])
    assert blocking.candidate_pairs(df.filter("source = 1"), df.filter("source = 2")).count() == 0
    assert blocking.candidate_pairs(df.limit(0), df.limit(0)).count() == 0


def test_stream_gives_the_batch_result(spark, tmp_path):
    df = frame(spark, records(seed=9, n=80))
    s1, catalogue = df.filter("source = 1"), df.filter("source > 1")
    probe.build_index(catalogue, str(tmp_path / "index"))
    s1.drop("source").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.drop("source").schema).parquet(str(tmp_path / "in"))
    probe.start(spark, stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "state"), k=5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = blocking.candidate_pairs(s1, catalogue, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_very_hot_keys_are_dropped_before_the_shuffle(spark):
    post = spark.createDataFrame([("US", "name_tokens", "hot", 900), ("US", "name_tokens", "warm", 60), ("US", "name_tokens", "cold", 3), ("FR", "address", "hot", 40)], "country string, strategy string, key string, df long")
    listed = post.drop("df").crossJoin(spark.range(2).withColumnRenamed("id", "candidate_entity_id"))
    caps = {"name_tokens": 50, "address": 30}
    left = {(r["country"], r["key"]) for r in blocking.reachable(listed, post, caps).collect()}
    assert left == {("US", "cold")}  # at this size every key beyond its cap holds a large share
    assert blocking.reachable(listed, post.limit(0), caps).count() == listed.count()


def test_scores_are_rounded_as_in_sql(spark):
    """Scores of nine digits that end in 500: the decimal half and the product with a million part there."""
    values = [16.0844915, *(round(k + 0.0000005 + j / 1e4, 9) for k in (8, 16, 32, 64) for j in range(2000))]
    con = duckdb.connect()
    con.execute("create table v (x double)")
    con.executemany("insert into v values (?)", [(x,) for x in values])
    want = sorted(con.execute("select x, round(x, 6) from v").fetchall())
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert sorted(map(tuple, df.select("x", blocking.rounded(df.x, 6)).collect())) == want
    assert (16.0844915, 16.084491) in want


def test_equal_keys_give_equal_sums(spark):
    """Candidates of one text tie exactly, whatever the order of adding, and are listed by source and id; a block holds many records."""
    words = [f"{a}{b}{c}" for a in "bdgkp" for b in "aeiou" for c in "lmnr"]
    rows = [(f"S1-{i:04d}", " ".join(words[(i + j * 7) % 100] for j in range(4)), "12 lombard market 560001", "US", 1) for i in range(60)]
    rows += [(f"S{2 + i % 2}-{i:04d}", " ".join(words[(i // 6 + j * 7) % 100] for j in range(4)), "12 lombard market 560001", "US", 2 + i % 2) for i in range(360)]
    df = frame(spark, rows)
    made = {r["source1_entity_id"]: [] for r in df.selectExpr("entity_id as source1_entity_id").collect()}
    for r in blocking.candidate_pairs(df.filter("source = 1"), df.filter("source > 1"), 6).orderBy("source1_entity_id", "candidate_rank").collect():
        made[r["source1_entity_id"]].append(r)
    for i in range(60):
        best = made[f"S1-{i:04d}"]
        assert [r["candidate_entity_id"] for r in best] == [f"S{s}-{6 * i + k:04d}" for s in (2, 3) for k in range(s - 2, 6, 2)]
        assert len({r["blocking_score"] for r in best}) == 1
