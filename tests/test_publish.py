"""State that outlives runs: claims, the universe, tiles, index and manifests."""

import os
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellweave.operators import catalog, publish
from cellweave.plans import atlas
from cellweave.sources import files
from cellweave.sources.store import Store, fixed_universe
from cellweave.sources.views import view


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "atlas"))


def at_once(*work):
    threads = [threading.Thread(target=w) for w in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()


def test_one_claim_wins(store):
    won = []
    at_once(*[lambda i=i: won.append(i) if store.claim("a/b", str(i)) else None for i in range(8)])
    assert len(won) == 1 and store.text("a/b") == str(won[0]) and store.names("a") == ["b"] and store.text("a/c") is None
    at_once(*[lambda i=i: store.commit(lambda now: now | {str(i): i}) for i in range(5)])
    assert store.head() == (5, {str(i): i for i in range(5)})


def test_the_first_universe_stays(spark, store, tmp_path):
    got = {}
    first = lambda i: spark.range(i, i + 3)
    at_once(*[lambda i=i: got.update({i: sorted(r.id for r in fixed_universe(store, lambda: first(i)).collect())}) for i in range(3)])
    assert got[0] == got[1] == got[2] and got[0] in ([0, 1, 2], [1, 2, 3], [2, 3, 4])
    again = fixed_universe(Store(spark, store.root), lambda: pytest.fail("the universe is there already"))
    assert sorted(r.id for r in again.collect()) == got[0]


def levels(spark, metric, values):
    """Cells 0 to 9 in tiles of five; a level of whole cells beside them has no tiles."""
    rows = [(9, i, i, i // 5, float(i), float(-i), values.get(i)) for i in range(10)] + [(8, 77, 0, None, 0.0, 0.0, sum(values.values(), 0.0))]
    return spark.createDataFrame(rows, f"res int, cell long, ord long, tile long, lon double, lat double, {metric} double")


def tile_files(store):
    return {str(p.relative_to(store.root)): os.stat(p).st_mtime_ns for p in Path(store.root, "tiles").rglob("*.parquet")}


def test_runs_fold_into_tiles_index_and_manifest(spark, store):
    publish.publish(store, "one", levels(spark, "a", {i: float(i) for i in range(10)}), {"a": {"label": "A"}})
    before = tile_files(store)
    publish.publish(store, "two", levels(spark, "b", {6: 60.0, 9: 90.0}), {"b": {"label": "B"}})
    after = tile_files(store)
    kept = {f for f in before if "tile=0" in f}
    assert len(before) == 2 and {f: after.get(f) for f in kept} == {f: before[f] for f in kept} and not (before.keys() - kept) & after.keys()
    got = {r.tile: r for r in publish.tiles(store).collect()}
    assert got[0].metrics == {"a": [0.0, 1.0, 2.0, 3.0, 4.0]} and got[1].metrics == {"a": [5.0, 6.0, 7.0, 8.0, 9.0], "b": [None, 60.0, None, None, 90.0]}
    assert (got[1].cells, got[1].lat, got[1]["count"]) == ([5, 6, 7, 8, 9], [-5.0, -6.0, -7.0, -8.0, -9.0], 5)
    assert {r.metric: (r.n, r.max, r.sum) for r in publish.table(store, "stats").filter("res = 9").collect()} == {"a": (10, 9.0, 45.0), "b": (2, 90.0, 150.0)}
    assert sorted((r.tile, r["count"], r.west, r.east) for r in publish.table(store, "index").collect()) == [(0, 5, 0.0, 4.0), (1, 5, 5.0, 9.0)]
    assert sorted((r.res, r["count"], r.tiled) for r in publish.table(store, "lods").collect()) == [(8, 1, False), (9, 10, True)]
    assert {(r.metric, r.cell): r.value for r in publish.published(store).filter("res = 9 and cell = 6").collect()} == {("a", 6): 6.0, ("b", 6): 60.0}
    publish.publish(store, "three", levels(spark, "b", {6: 60.0, 9: 90.0}), {"b": {"label": "B"}})
    assert tile_files(store) == after and store.head()[0] == 3
    publish.publish(store, "four", levels(spark, "b", {}), {"b": {"label": "B"}})
    assert {r.tile: r.metrics for r in publish.tiles(store).collect()}[1] == {"a": [5.0, 6.0, 7.0, 8.0, 9.0], "b": [None] * 5}
    assert store.head()[1]["metrics"]["a"]["run"] == "one" and store.head()[1]["metrics"]["b"]["run"] == "four"


def test_a_run_that_dies_leaves_the_manifest(spark, store):
    publish.publish(store, "one", levels(spark, "a", {1: 1.0}), {"a": {}})
    bad = levels(spark, "b", {2: 2.0}).withColumn("lat", F.when(F.col("cell") != 3, F.col("lat")))
    with pytest.raises(Exception, match="no position"):
        publish.publish(store, "two", bad, {"b": {}})
    assert store.head()[0] == 1 and {r.metric for r in publish.published(store).collect()} == {"a"}


def test_a_run_that_comes_second_folds_both(spark, store):
    """The other run publishes between the first look at the manifest and the claim, after its tiles were lost."""
    publish.publish(store, "zero", levels(spark, "z", {0: 1.0}), {"z": {}})
    claim, done = store.claim, []

    def late(name, text):
        if not done:
            done.append(1)
            other = Store(spark, store.root)
            publish.publish(other, "other", levels(spark, "a", {0: 5.0, 7: 7.0}), {"a": {}})
            publish.fold_tiles(other, levels(spark, "a", {}), ["a"])  # as if the other's tiles had been overwritten
        return claim(name, text)

    store.claim = late
    publish.publish(store, "late", levels(spark, "b", {7: 9.0}), {"b": {}})
    number, now = store.head()
    assert number == 3 and set(now["metrics"]) == {"z", "a", "b"}
    assert {r.tile: r.metrics for r in publish.tiles(store).collect()} == {0: {"z": [1.0, None, None, None, None], "a": [5.0, None, None, None, None]}, 1: {"a": [None, None, 7.0, None, None], "b": [None, None, 9.0, None, None]}}


def test_weights_of_files_without_ids_go_by_their_centres(spark, tmp_path):
    (tmp_path / "w.csv").write_text("x_mp_100m;y_mp_100m;n\n4300050;3000050;2\n4300050;3000050;–\n4300150.4;3000050;7,5\n;1;3\n")
    assert {r.grid_id: r.weight for r in files.scan_weights(spark, str(tmp_path / "w.csv"), "n").collect()} == {"4300050:3000050": 0.0, "4300150:3000050": 7.5, "1": 3.0}


def test_a_packed_folder_is_listed_like_its_files(spark, tmp_path):
    for name, text in (("a.bin", "one"), ("b.bin", ""), ("c.bin", "größer\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    found = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    files.pack(found.filter("length > 0"), str(tmp_path / "packed"))
    files.pack(found.filter("length = 0"), str(tmp_path / "packed"))
    packed = files.unpacked(spark, str(tmp_path / "packed"))
    own = lambda rows: {(r.path, r.name, r["size"]) for r in rows.collect()}
    assert own(files.listed(packed)) == own(files.listing(spark, str(tmp_path / "in")))
    assert "content" not in files.listed(packed)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_many_small_files_take_few_files(spark, tiny):
    path = atlas.written_folder(lambda name: view(spark, tiny, name))
    held, written = files.unpacked(spark, path), [f for f in Path(path).rglob("*.parquet")]
    assert held.select("path").distinct().count() == held.count() == 40 and len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_packed_and_single_files_have_one_fingerprint(spark, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode() + b"\xff\x00")
    files.pack(spark.read.format("binaryFile").load(str(tmp_path / "in")), str(tmp_path / "packed"))
    printed = lambda found: catalog.input_fingerprint(found.withColumn("k", F.lit(1)), ["k"]).first()
    assert printed(files.digested(files.unpacked(spark, str(tmp_path / "packed")))) == printed(files.digests(spark, str(tmp_path / "in")))


def test_the_last_weight_is_found_without_sorting_the_rows(spark, tmp_path):
    lines = [(f"c{i * 7 % 90}", i) for i in range(3000)]
    (tmp_path / "w.csv").write_text("GITTER_ID_100m;n\n" + "".join(f"{k};{'.' if v % 11 == 0 else v}\n" for k, v in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.scan_weights(spark, str(tmp_path / "w.csv"), "n")
        assert {r.grid_id: r.weight for r in got.collect()} == {k: float(v) for k, v in lines if v % 11}
        assert spark.read.text(str(tmp_path / "w.csv")).rdd.getNumPartitions() >= 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate", plan.index("SortAggregate")) < plan.index("Scan csv")
