"""Near duplicates: signatures of many universal hash minima, bands, verified links, components.

Documents that agree in a band are candidates. Their groups, with nothing lost,
are the components of band membership; inside a group links are searched from
document to document, a signature is compared first and the whole sets then, and
only documents not yet connected are compared at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import apart, merged, mix, texts_of, written
from siftwell.llm.components import components

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """What counts as near.

    Links: percent * |union| <= 100 * |intersection|. With 25 bands of 5 rows a
    pair at 0.85 shares no band with a chance of 4e-7. A pair whose signatures
    agree in less than ``floor`` of their places is not compared further; at 0.85
    that is eight standard deviations away.
    """

    words: int = 3
    percent: int = 85
    bands: int = 25
    rows: int = 5
    floor: float = 0.6
    #: Documents and shingles that one task compares at a time.
    members: int = 4096
    shingles: int = 4_000_000
    hubs: int = 64


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def shingle_set(words: Sequence[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of fewer words the whole sequence is one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` multiply-and-add hash functions."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over the set."""
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), 1024):
        np.minimum(least, (x[start : start + 1024] * a + b).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key per band."""
    parts = least[: settings.bands * settings.rows].reshape(settings.bands, settings.rows).astype(np.uint64)
    key = np.arange(settings.bands, dtype=np.uint64)
    for i in range(settings.rows):
        key = mix(key ^ parts[:, i])
    return key.astype(np.int64)


def digest(words: Sequence[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """id (null: last), doc_id, sha, n_shingles, digest of the word sequence, band keys; no words: no digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        a, b = parameters(settings.bands * settings.rows)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for data in texts_of(batch.column(1)):
                words = words_of(data)
                shingles = shingle_set(words, hashes, settings.words)
                keys = band_keys(signature(shingles, a, b), settings) if words else None
                for column, value in zip(columns, (hashlib.sha256(data).digest(), len(shingles), digest(words) if words else None, keys)):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "sha", "n_shingles", "digest", "bands"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, sha binary, n_shingles long, digest binary, bands array<long>"
    )
    return made.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("row", F.monotonically_increasing_id())


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """node, label: components of band membership. Each bucket is a star around its least node."""
    spots = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    full = spots.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    full = full.filter("n > 1").select(F.col("band").alias("b"), F.col("key").alias("k"), "least")
    stars = spots.join(merged(full), (F.col("band") == F.col("b")) & (F.col("key") == F.col("k")))
    edges = stars.filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    return components(edges)


class Sets:
    """The whole shingle sets and signatures of some documents."""

    def __init__(self, texts: Sequence[bytes], settings: Settings, hashes: WordHashes):
        a, b = parameters(settings.bands * settings.rows)
        found = [shingle_set(words_of(x), hashes, settings.words) for x in texts]
        self.settings = settings
        self.signatures = np.stack([signature(x, a, b) for x in found]) if found else np.zeros((0, len(a)), np.uint32)
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.values = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.sizes)

    def members(self, i: int) -> np.ndarray:
        return self.values[self.ends[i] - self.sizes[i] : self.ends[i]]

    def linked(self, signature: np.ndarray, members: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that have a link to the given set: sizes, then signatures, then the sets."""
        s, n = self.settings, len(members)
        sizes = self.sizes[among]
        near = among[(100 * np.minimum(sizes, n) >= s.percent * np.maximum(sizes, n)) & (sizes > 0)]
        near = near[(self.signatures[near] == signature).mean(axis=1) >= s.floor]
        if not len(near) or not n:
            return near[:0]
        sizes = self.sizes[near]
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[near] - np.cumsum(sizes), sizes)
        values = self.values[at]
        place = np.searchsorted(members, values)
        place[place == n] = 0
        hits = np.add.reduceat((members[place] == values).astype(np.int64), np.cumsum(sizes) - sizes)
        return near[100 * hits >= s.percent * (sizes + n - hits)]


def links_within(sets: Sets, everyone: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is connected: each found document is compared with those not found yet."""
    out: list[tuple[int, int]] = []
    left = everyone
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            found = sets.linked(sets.signatures[x], sets.members(x), left)
            if len(found):
                out.extend((x, int(y)) for y in found)
                left = left[~np.isin(left, found)]
                queue.extend(found.tolist()[::-1])
    return out


LINKS = "u long, v long"


def near_groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row, sha.

    Equal word sequences are settled by their digest. A null text or one without
    words has no shingles and no links. A null id is larger than any other. Of
    rows that repeat the smallest id of a component exactly one is kept. An empty
    table gives no rows; other columns are ignored.
    """
    signed = written(signatures(docs, settings), "signatures")
    nodes = signed.filter("digest IS NOT NULL").groupBy("digest")
    nodes = nodes.agg(
        F.min(F.struct("row", "id", "sha")).alias("one"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")
    )
    nodes = written(nodes.select(F.col("one.row").alias("node"), "one.id", "one.sha", "digest", "bands", "size"), "distinct")
    groups = written(candidate_groups(nodes), "candidates")
    count = signed.count()
    links = verified_links(docs, nodes, groups, settings)
    labels = components(links)
    own = nodes.select("digest", "node").join(merged(labels, count), "node", "left")
    own = own.select(F.col("digest").alias("d"), F.coalesce("label", "node").alias("label"))
    found = signed.drop("bands").join(merged(own, count), F.col("digest") == F.col("d"), "left")
    found = found.withColumn("label", F.coalesce("label", "row"))
    least = found.groupBy("label").agg(F.min(F.struct("id", "row")).alias("least"))
    least = least.select(F.col("label").alias("l"), "least")
    return found.join(merged(least, count), F.col("label") == F.col("l")).select(
        "doc_id",
        "n_shingles",
        F.nullif(F.col("least.id"), F.lit(LAST)).alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        "row",
        "sha",
    )


def verified_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """u, v: links on whole sets, enough of them to connect what is connected.

    Groups beyond one task's bounds are cut into chunks. Their documents are then
    compared across chunks as far as they are not connected yet: first with a few
    hubs, which joins most, then those outside the largest component with all.
    """
    count = nodes.count()
    sized = groups.join(merged(nodes.select("node", "id", "digest", "size"), count), "node")
    totals = sized.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    chunks = F.greatest(F.ceil(F.col("n") / settings.members), F.ceil(F.col("weight") / settings.shingles))
    totals = written(totals.select(F.col("label").alias("l"), chunks.cast("long").alias("chunks"), "weight"), "group-sizes")
    whole = totals.agg(F.sum("weight")).first()[0] or 0
    parcels = max(1, -(-whole // (settings.shingles // 4)))
    # Small groups share parcels; chunks of large ones are parcels of their own.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    parcel = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("label"), F.lit(parcels))).otherwise(
        F.xxhash64("label", chunk)
    )
    placed = sized.join(merged(totals, count), F.col("label") == F.col("l")).select("node", "id", "digest", "label", "chunks", parcel.alias("parcel"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("t_id"), "text")
    members = placed.join(merged(texts), F.col("id") == F.col("t_id")).select("parcel", "label", "node", "digest", "text", "chunks")
    large = not totals.filter("chunks > 1").isEmpty()
    if large:
        members = written(members, "members")
    links = members.groupBy("parcel").applyInArrow(_links_of(settings), LINKS)
    if not large:
        return links
    links = written(links, "links")
    members = members.filter("chunks > 1")
    hubs = _hubs(links, members, settings, count)
    links = written(links.union(_across(members, hubs, links, settings, count)), "links")
    return links.union(_across(members, _minority(members, links, count), links, settings, count))


def _own_rows(table: pa.Table) -> pa.Table:
    """The rows whose text is the node's (an id may repeat with other texts), one per node, in order."""
    texts = texts_of(table.column("text"))
    right = [digest(words_of(x)) == d for x, d in zip(texts, table.column("digest").to_pylist())]
    table = table.filter(pa.array(right)).sort_by("node")
    nodes = table.column("node").to_numpy()
    return table.filter(pa.array(np.concatenate(([True], nodes[1:] != nodes[:-1])))) if len(nodes) else table


def _links_of(settings: Settings):
    def links(table: pa.Table) -> pa.Table:
        table = _own_rows(table)
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        sets = Sets(texts_of(table.column("text")), settings, WordHashes())
        found = []
        order = np.argsort(label, kind="stable")
        heads = np.flatnonzero(np.diff(label[order], prepend=label.min(initial=0) - 1))
        for everyone in np.split(order, heads[1:]) if len(order) else []:
            found += links_within(sets, everyone)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    return links


def _hubs(links: DataFrame, members: DataFrame, settings: Settings, count: int) -> DataFrame:
    """The nodes with most links of each large group, a fixed number."""
    degree = links.select(F.col("u").alias("h")).union(links.select("v")).groupBy("h").agg(F.count("*").alias("degree"))
    ranked = members.select("node", "label").join(merged(degree, count), F.col("node") == F.col("h"), "left")
    # Spark limits each task's rows before the shuffle, so a large group does not meet in one task.
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc_nulls_last("degree"), "node"))
    return ranked.withColumn("place", place).filter(F.col("place") <= settings.hubs).select("node")


def _minority(members: DataFrame, links: DataFrame, count: int) -> DataFrame:
    """Nodes of large groups outside the largest component of their group."""
    placed = _labelled(members.select("node", "label"), links, count)
    sizes = placed.groupBy("label", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("label").agg(F.max(F.struct("n", "part")).alias("most")).select(F.col("label").alias("l"), "most")
    rest = placed.join(most, F.col("label") == F.col("l")).filter("part != most.part")
    return rest.select("node")


def _labelled(members: DataFrame, links: DataFrame, count: int) -> DataFrame:
    parts = components(links).select(F.col("node").alias("p_node"), F.col("label").alias("p_label"))
    joined = members.join(merged(parts, count), F.col("node") == F.col("p_node"), "left")
    return joined.withColumn("part", F.coalesce("p_label", "node")).drop("p_node", "p_label")


def _across(members: DataFrame, visitors: DataFrame, links: DataFrame, settings: Settings, count: int) -> DataFrame:
    """Links between visitors and the members of every chunk of their group that are not connected yet."""
    placed = written(_labelled(members, links, count), "placed")
    chosen = placed.join(visitors.select(F.col("node").alias("v_node")).distinct(), F.col("node") == F.col("v_node"), "left_semi")
    where = placed.select(F.col("label").alias("l"), F.col("parcel").alias("to")).distinct()
    sent = chosen.drop("parcel").join(where, F.col("label") == F.col("l"))
    # A chunk meets its visitors some hundred at a time, so that neither side outgrows a task.
    lot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20))
    lots = max(1, -(-chosen.count() // settings.members))
    sent = sent.withColumn("lot", F.pmod(lot, F.lit(lots)))
    stay = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    columns = ["node", "digest", "text", "part"]

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        own, others = _own_rows(own), _own_rows(others)
        hashes = WordHashes()
        here, there = (Sets(texts_of(t.column("text")), settings, hashes) for t in (own, others))
        node, part = own.column("node").to_numpy(), own.column("part").to_numpy()
        found = []
        for i, (visitor, its) in enumerate(zip(others.column("node").to_pylist(), others.column("part").to_pylist())):
            near = here.linked(there.signatures[i], there.members(i), np.flatnonzero(part != its))
            # One link to each component is enough.
            _, first = np.unique(part[near], return_index=True)
            found += [(visitor, int(node[j])) for j in near[first]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    left = stay.select(F.col("parcel").alias("at"), "lot", *columns).groupBy("at", "lot")
    right = sent.select(F.col("to").alias("at"), F.col("lot").alias("lot"), *[F.col(c).alias(c) for c in columns])
    right = right.groupBy("at", "lot")
    return left.cogroup(right).applyInArrow(meet, LINKS)


def nearly_unique(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The document of each component that stays, with all columns.

    A text without words, a null one too, is like no other and stays. A null id
    counts as the largest. Of rows with one id and equal texts one stays; rows with
    one id and different texts are documents of their own. An empty table gives no
    rows; other columns may have any names and types.
    """
    k_id, k_sha, k_text = (apart(docs, c) for c in ("k_id", "k_sha", "k_text"))
    groups = near_groups(docs.select("doc_id", "text"), settings)
    kept = written(groups.filter("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias(k_id), F.col("sha").alias(k_sha)), "kept-near")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(k_id)) & (
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.lower(F.hex(k_sha))
    )
    stay = docs.join(merged(kept, kept.count()), same, "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return stay
    return stay.withColumn(k_text, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", k_text]).drop(k_text)
