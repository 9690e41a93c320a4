import pytest

from kinforge.llm.sharding import Conflict, Manifest, Store


def rows(df):
    return sorted(map(str, df.collect()))


def test_arrivals_are_merged_by_size(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"), target_bytes=64 << 10, fanout=3, base_bytes=8 << 10)
    store.append_all(docs.withColumn("_a", docs["doc_id"] % 9), "_a")
    manifest = store.manifest()
    tiers = [store.tier(r) for r in manifest.runs]
    assert all(tiers.count(t) < 3 for t in tiers) and any(r.merged_from for r in manifest.runs)
    assert rows(store.read()) == rows(docs) and sum(s.rows for s in manifest.shards) == docs.count()
    merged = [s for r in manifest.runs if r.merged_from for s in r.shards]
    assert max(s.bytes for s in merged) < 3 * (64 << 10)
    # a version once committed does not change
    first = store.versions()[0]
    before = rows(store.read(first))
    store.append(docs.limit(5))
    assert rows(store.read(first)) == before
    assert store.vacuum() > 0 and rows(store.read()) == sorted(rows(docs) + rows(docs.limit(5)))
    # no manifest is left without its files
    assert store.versions() == [store.manifest().version]
    with pytest.raises(ValueError):
        store.read(first)
    assert rows(Store(spark, str(tmp_path / "s")).read()) == rows(store.read())


def test_commit_is_atomic(spark, tmp_path, docs):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.append(docs.limit(3))
    with pytest.raises(Conflict):
        b.commit(Manifest(1, "", []))
    b.append(docs.limit(2))  # the next version
    assert a.manifest().version == 2 and a.read().count() == 5
    with pytest.raises(Conflict):
        a._replace([], {"no such run"})
    assert not list((tmp_path / "s" / "manifests").glob(".draft-*"))


def test_a_crash_between_writing_and_commit_leaves_the_old_version(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"))
    store.append(docs.limit(3))
    docs.write.parquet(str(tmp_path / "s" / "data" / "lost"))  # shards that no manifest names
    assert store.read().count() == 3 and store.manifest().version == 1
    lost = lambda: list((tmp_path / "s" / "data" / "lost").glob("*.parquet"))
    assert store.vacuum() == 0 and lost()  # it may be a writer about to commit
    assert store.vacuum(orphan_seconds=-60) > 0 and not lost() and store.read().count() == 3


def test_columns_of_any_name(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "_arrival int, __arrival int, _Arrival2 int")
    store = Store(spark, str(tmp_path / "s"))
    store.append(df)
    assert store.read().columns == df.columns and rows(store.read()) == rows(df)


def test_manifests_name_runs_not_shards(spark, tmp_path, docs):
    store = Store(spark, str(tmp_path / "s"), fanout=3, base_bytes=1 << 10)
    for _ in range(7):
        store.append(docs.repartition(4))
    size = [len((tmp_path / "s" / "manifests" / f"v{v:012d}.json").read_text()) for v in store.versions()]
    assert max(size) < 2 * min(size) and rows(store.read()) == sorted(rows(docs) * 7)


def test_odd_rows_and_empty_arrivals(spark, tmp_path, odd):
    store = Store(spark, str(tmp_path / "s"), fanout=2)
    with pytest.raises(ValueError):
        store.read()
    store.append(odd.limit(0))
    assert store.read().count() == 0 and store.read().columns == odd.columns
    for _ in range(3):
        store.append(odd)
    assert rows(store.read()) == sorted(rows(odd) * 3)
    store.merge(store.manifest().runs)
    assert len(store.manifest().runs) == 1 and rows(store.read()) == sorted(rows(odd) * 3)
