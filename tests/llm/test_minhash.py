import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, exact, minhash
from siftwell.llm.components import components, large_star, small_star
from tests.llm.conftest import HARD


def shingles(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in held[s])
        for s in own:
            held[s].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(own) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    ids = [minhash.LAST if i is None else i for i, _ in docs]
    least = {}
    for i, id in enumerate(ids):
        least[root(i)] = min(least.get(root(i), id), id)
    return sorted((id, len(s), least[root(i)]) for i, (id, s) in enumerate(zip(ids, sets)))


def rows(found):
    last = minhash.LAST
    return sorted(
        (last if r.doc_id is None else r.doc_id, r.n_shingles, last if r.component_id is None else r.component_id) for r in found
    )


def copies(seed, groups=12, members=10):
    draw = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(3, 120))]
        for _ in range(members):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 99)}"
            docs.append((len(docs), " ".join(words)))
    return docs


@pytest.mark.parametrize("settings", [minhash.Settings(), minhash.Settings(members=4, hubs=2)])
def test_components_against_brute_force(frame, settings):
    docs = copies(5)
    found = minhash.near_groups(frame(docs), settings).collect()
    assert rows(found) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_hard_rows(frame):
    found = minhash.near_groups(frame(HARD)).collect()
    assert rows(found) == brute(HARD)
    # The repeated row and its copies leave exactly one.
    assert sum(r.kept for r in found if r.component_id == 4) == 1


def test_stage(frame):
    docs = frame(HARD)
    found = minhash.nearly_unique(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in found.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_nothing(frame):
    assert minhash.near_groups(frame([])).count() == 0


def test_star_steps_on_a_long_chain(spark):
    n = 60
    order = random.Random(2).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 102)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(n)} | {100: 100, 101: 100, 102: 100}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_an_explode_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files of some kilobytes hold 32 keys a document: by their size alone Spark would broadcast all keys."""
    nodes = spark.range(2000).select(
        F.col("id").alias("node"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: F.floor(F.col("id") / 2) * k).alias("bands")
    )
    nodes.write.parquet(str(tmp_path / "nodes"))
    found = []
    monkeypatch.setattr(minhash, "components", found.append)
    minhash.candidate_groups(spark.read.parquet(str(tmp_path / "nodes")))
    assert "SortMergeJoin" in plan(found[0]) and "Broadcast" not in plan(found[0])
    assert sorted(tuple(r) for r in found[0].collect()) == [(i, i - 1) for i in range(1, 2000, 2)]


def test_tables_with_many_rows_are_not_broadcast(frame, spark, monkeypatch):
    docs, edges = frame(copies(5)), spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    for star in (large_star, small_star):
        assert "Broadcast" not in plan(star(edges, 10**6))
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    made = [minhash.near_groups(docs), minhash.nearly_unique(docs), exact.exact_groups(docs), exact.kept_documents(docs)]
    assert not [p for p in map(plan, made) if "Broadcast" in p]
    assert rows(made[0].collect()) == brute(copies(5))
