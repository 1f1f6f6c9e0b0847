import pytest
from pyspark.sql import functions as F

from siftwell.streaming import merging

ROW = "id string, embedding array<float>, version long"


def put(spark, out, batch, rows):
    spark.createDataFrame(rows, ROW).write.mode("overwrite").parquet(f"{out}/batch={batch}")


def entries(spark, out):
    return {r.id: (r.embedding, r.version) for r in merging.read_index(spark, out).collect()}


def newest(batches):
    """The rule in plain Python: greatest version, then greatest batch."""
    best = {}
    for number, rows in enumerate(batches):
        for name, vector, version in rows:
            if name not in best or (version, number) >= best[name][0]:
                best[name] = ((version, number), (vector, version))
    return {name: entry for name, (_, entry) in best.items()}


def folders(df):
    """Folders of the files a plan may open, those left out by partition filters aside."""
    return {r.p for r in df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("p")).distinct().collect()}


def test_levels_hold_the_newest_entries(spark, tmp_path):
    out, batches = f"{tmp_path}/ix", []
    for number in range(10):
        # Versions fall for "a", rise for "b" and are equal for "c"; every batch has an id of its own.
        rows = [("a", [float(number)], 20 - number), ("b", [float(number)], number), ("c", [float(number)], 1)]
        batches.append([*rows, (f"n{number}", [1.0], 0)])
        put(spark, out, number, batches[-1])
        merging.merge_batches(spark, out, fan=2)
        assert entries(spark, out) == newest(batches)
        runs = merging.live_runs(spark, out)
        levels = [r.level for r in runs]
        assert len(set(levels)) == len(levels) and levels == sorted(levels, reverse=True)
        # Runs cover the finished batches without a gap.
        assert [r.first for r in runs] == [0, *(r.last + 1 for r in runs[:-1])][: len(runs)]
    assert max(levels) >= 2


def test_only_open_batches_are_read_beside_the_runs(spark, tmp_path):
    out = f"{tmp_path}/ix"
    for number in range(4):
        put(spark, out, number, [("a", [1.0], number)])
    assert merging.merge_batches(spark, out, fan=3)
    put(spark, out, 4, [("b", [1.0], 1)])
    runs = merging.live_runs(spark, out)
    assert [(r.level, r.first, r.last) for r in runs] == [(0, 0, 2)]
    rows = merging.open_batches(spark, out, runs)
    assert folders(rows) == {"batch=3", "batch=4"}
    # Folders of merged batches are not needed any more.
    (tmp_path / "ix" / "batch=0").rename(tmp_path / "gone")
    assert entries(spark, out) == {"a": ([1.0], 3), "b": ([1.0], 1)}


def test_killed_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/ix"
    batches = [[("a", [float(n)], n), (f"n{n}", [2.0], 0)] for n in range(4)]
    for number, rows in enumerate(batches):
        put(spark, out, number, rows)
    with monkeypatch.context() as m:
        m.setattr(merging, "MANIFEST", "broken")  # the run is written, its entry in the manifest is not
        m.setattr(merging, "live_runs", lambda *_: [])
        with pytest.raises(Exception):
            merging.merge_batches(spark, out, fan=2)
    assert len(list((tmp_path / "ix" / "_merged" / "runs").iterdir())) == 1
    assert merging.live_runs(spark, out) == [] and entries(spark, out) == newest(batches)
    assert merging.merge_batches(spark, out, fan=2) and entries(spark, out) == newest(batches)


def test_two_merges_at_once_and_a_repeated_batch(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/ix"
    batches = [[("a", [float(n)], n), (f"n{n}", [2.0], 0)] for n in range(6)]
    for number, rows in enumerate(batches[:3]):
        put(spark, out, number, rows)
    assert merging.merge_batches(spark, out, fan=2)
    with monkeypatch.context() as m:  # another merge that saw no manifest either
        m.setattr(merging, "live_runs", lambda *_: [])
        assert merging.merge_batches(spark, out, fan=2)
    put(spark, out, 2, batches[2])
    assert entries(spark, out) == newest(batches[:3])
    for number in range(3, 6):
        put(spark, out, number, batches[number])
    assert merging.merge_batches(spark, out, fan=2) and entries(spark, out) == newest(batches)


def test_empty_index_and_empty_batches(spark, tmp_path):
    out = f"{tmp_path}/ix"
    assert entries(spark, out) == {} and not merging.merge_batches(spark, out)
    for number in range(3):
        put(spark, out, number, [])
    assert entries(spark, out) == {} and not merging.merge_batches(spark, out, fan=2)
    put(spark, out, 3, [("a", [1.0], 1)])
    assert not merging.merge_batches(spark, out, fan=2)  # one finished batch with rows at most
    assert entries(spark, out) == {"a": ([1.0], 1)}
    with pytest.raises(ValueError):
        merging.merge_batches(spark, out, fan=1)
