"""The manifest against a plain tree built in one piece."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siftwell.llm.merkle import Block, LabelQueue, levels_of, manifest, sweep_down, sweep_up
from tests.llm.conftest import HARD

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of some digests, and the siblings of every one of them, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, i in zip(paths, at):
            run = runs[i // 8]
            path.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
        nodes, at = [digest("".join(run)) for run in runs], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows, shown):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (mine, *climb([leaf(r) for r in mine]))
    root, tops = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        mine, subroot, paths = trees[lang]
        for row, path in zip(mine, paths):
            now = leaf(shown(row))
            for k, others in path + top:
                now = digest("".join(others[:k] + [now] + others[k:]))
            proof = digest("".join(x for _, others in path + top for x in others))
            out.append((row[0], leaf(row), subroot, root, proof, now, now == root))
    return out


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 3 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def compare(docs, rows, **settings):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs, {"text": F.when(hit, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))}, **settings).drop("path")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(rows, lowered)))


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 64, 65, 500])
def test_labels_count_up_and_sweeps_meet(leaves):
    shape = Block(leaves, levels_of(leaves))
    nodes = [*shape.nodes()]
    assert [shape.label(*x) for x in nodes] == list(range(len(nodes)))
    digests = [digest(str(i)) for i in range(leaves)]
    root, children = sweep_up(shape, iter(x.encode() for x in digests))
    wanted, paths = climb(digests)
    assert root.decode() == wanted
    down = dict(sweep_down(shape, children, b""))
    for i, path in enumerate(paths):
        assert down[i] == b"".join(bytes([k, len(o) + 1]) + "".join(o).encode() for k, o in path)


def test_queue_spills_and_keeps_order():
    queue = LabelQueue(limit=300)
    for i in range(200):
        queue.put(i * 37 % 50, i, b"%04d" % i * 4)
    assert queue.spilled > 0
    for label in range(50):
        assert queue.take(label) == [b"%04d" % i * 4 for i in range(200) if i * 37 % 50 == label]


def test_hard_rows(frame):
    rows = [(i, "s", "en", None if t is None else len(t), t) for i, t in HARD]
    compare(frame(HARD), rows)


def test_many_rounds_and_groups(spark):
    """Blocks of one level, queues without memory: several rounds and spilled messages."""
    langs = [None, "", "b", "é", "x" * 40, *(f"l{i}" for i in range(20))]
    rows = [(i, None if i % 5 == 0 else f"S{i % 3}", langs[min(i % 31, 24)] if i % 3 else "b", i % 7, f"Text {i} A" if i % 4 else None) for i in range(700)]
    rows += rows[:9]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, source string, lang string, n_chars long, text string, `key` string, `a b` int")
    compare(docs.repartition(5), rows, levels=1, limit=0)
    compare(docs.repartition(3), rows)


def test_empty_table(frame):
    assert manifest(frame([])).collect() == []
