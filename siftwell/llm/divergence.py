"""How far sources diverge from their language: shares of terms, and the terms that stand out.

A term stands out in a source the more often it occurs there and the less often
in the language, so a term that k others beat in both (earlier UTF-8 deciding
ties) cannot be among the k first. Partitions keep only the others, the skyband;
skybands are merged, and what is left is ranked by exact shares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import texts_of, written

#: Documents of a language that a term must occur in, and terms reported per group.
LEAST_DOCUMENTS, TOP = 30, 50
#: Added to every count.
ADDED = 5
#: Bytes of a text that are cut into terms at a time; counts that a task holds before it gives them out.
PIECE, HELD = 1 << 20, 300_000
#: Terms that a first partition of a group compares, and skybands that a second one merges.
TERMS, MERGED = 4096, 16
#: Sources of a language compared in one block, counts per part of a language, cells of one comparison.
SOURCES, PART, CELLS = 256, 50_000, 1 << 21

# What a term is made of, as bytes of UTF-8 (letters A-Z and all beyond ASCII).
CAPITALS, SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, capitals A-Z lowered, a bounded piece at a time."""
    find, end_of = re.compile(rb"[a-z\x80-\xff]+").findall, re.compile(rb"[^A-Za-z\x80-\xff]")
    lower = bytes.maketrans(CAPITALS, SMALL)
    at = 0
    while at < len(text):
        border = end_of.search(text, at + PIECE)
        end = border.end() if border else len(text)
        yield find(text[at:end].translate(lower))
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of every term; null texts and names are empty.

    Tasks add up what they meet before anything is shuffled.
    """
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang, source)]
    picked = docs.select(names[0].alias("lang"), names[1].alias("source"), F.col(f"`{text}`").alias("text"))
    kept = ("lang", "source", "term", "n", "docs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out():
            for (lang, source), (n, documents) in groups.items():
                terms = [*n]
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    columns = [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array([t.decode() for t in some], pa.string()),
                        pa.array([n[t] for t in some], pa.int64()),
                        pa.array([documents[t] for t in some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept])

        for batch in batches:
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                n, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                own = Counter()
                for terms in terms_of(body):
                    own.update(terms)
                n.update(own)
                documents.update(own.keys())
                held += len(n)
                if held > HELD:
                    yield from out()
                    groups, held = {}, 0
        yield from out()

    counted = picked.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(1e9 * count / whole) for count <= whole < 9e15: long division, three digits at a time."""
    digits, rest = F.lit(1).cast("long"), count
    for power in (1_000_000, 1000, 1):
        rest = rest * 1000
        digits = digits + F.call_function("div", rest, whole) * power
        rest = rest % whole
    return digits


def skyband(high: np.ndarray, low: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Places of the rows, given in order of preference, that fewer than k earlier ones match in both.

    An earlier row matches if ``high`` is as high and ``low`` as low. Whom k rows
    match, k rows of the skyband match too, so only those are compared.
    """
    kept = np.zeros(0, np.int64)
    # The strongest rows settle most cases at little cost; only survivors are compared with all.
    strong = np.sort(np.argsort(low / np.maximum(high, 1), kind="stable")[:256])
    maybe = [
        part[((high[strong] >= high[part, None]) & (low[strong] <= low[part, None]) & (strong < part[:, None])).sum(1) < k]
        for a in range(0, len(high), chunk)
        for part in (np.arange(a, min(a + chunk, len(high))),)
    ]
    rows = np.concatenate(maybe) if maybe else kept
    for a in range(0, len(rows), chunk):
        part = rows[a : a + chunk]
        seen = np.zeros(len(part), np.int64)
        for b in range(0, len(kept), 8 * chunk):
            some = kept[b : b + 8 * chunk]
            seen += ((high[some] >= high[part, None]) & (low[some] <= low[part, None])).sum(1)
        inside = (high[part] >= high[part, None]) & (low[part] <= low[part, None]) & (part < part[:, None])
        kept = np.concatenate([kept, part[seen + inside.sum(1) < k]])
    return kept


def keep_skyband(k: int):
    """Keeps the skyband of a group's rows (lang, source, part, term, n, lang_n)."""

    def keep(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("term")
        n, lang_n = (table.column(c).to_numpy() for c in ("n", "lang_n"))
        return table.take(pa.array(skyband(n, lang_n, k)))

    return keep


def standing_out(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of every group by how far its share is above that of the language."""
    rows = "lang string, source string, part long, term string, n long, lang_n long"
    # Groups are cut into partitions of some thousand terms, and their skybands merged by sixteens until few are left.
    parts = F.ceil(F.col("terms") / TERMS)
    dealt = counts.join(totals.select("lang", "source", "terms"), ["lang", "source"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("term"), parts)).select("lang", "source", "part", "term", "n", "lang_n")
    local = dealt.groupBy("lang", "source", "part").applyInArrow(keep_skyband(top), rows)
    merged = local.withColumn("part", F.expr(f"part div {MERGED}"))
    merged = merged.groupBy("lang", "source", "part").applyInArrow(keep_skyband(top), rows)
    known = merged.drop("part").join(totals, ["lang", "source"])
    own = share(F.col("n") + ADDED, F.col("total") + ADDED * F.col("kept"))
    all_ = share(F.col("lang_n") + ADDED, F.col("lang_total") + ADDED * F.col("kept"))
    found = known.withColumn("value", own - all_).filter("value > 0 AND n > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def apart(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of differences between the sources of two blocks over the terms of one part.

    ``left`` has rows (cell, part, source, term, share), ``right`` (cell, part,
    source, first, second, none): which block a source is of, and the share of a
    term it lacks. Terms that no source here has are left out and counted by
    ``seen``.
    """
    sources = right.column("source").to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    none = right.column("none").to_numpy()
    first, second = (np.flatnonzero(right.column(c).to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    same = bool(len(first) == len(second) and (first == second).all())
    sums, seen = np.zeros((len(first), len(second)), np.int64), 0
    if left.num_rows:
        left = left.select(["source", "term", "share"]).combine_chunks().sort_by("term")
        term = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.array([place[s] for s in left.column("source").to_pylist()])
        shares = left.column("share").to_numpy()
        seen, step = int(term[-1]) + 1, max(1, CELLS // max(len(sources), len(second)))
        for a in range(0, seen, step):
            b = min(a + step, seen)
            lo, hi = np.searchsorted(term, [a, b])
            grid = np.repeat(none[:, None], b - a, axis=1)
            grid[at[lo:hi], term[lo:hi] - a] = shares[lo:hi]
            for i, s in enumerate(first):
                sums[i] += np.abs(grid[second] - grid[s]).sum(1)
    i, j = np.indices(sums.shape)
    wanted = (i < j) if same else np.ones(sums.shape, bool)
    i, j = i[wanted], j[wanted]
    names = np.array(sources, object)
    cell = right.column("cell")[0].as_py() if right.num_rows else ""
    return pa.table(
        {
            "lang": pa.array([cell.split("\0", 1)[1]] * len(i), pa.string()),
            "a": pa.array(names[first[i]] if len(i) else [], pa.string()),
            "b": pa.array(names[second[j]] if len(i) else [], pa.string()),
            "value": pa.array(sums[wanted], pa.int64()),
            "seen": pa.array(np.full(len(i), seen), pa.int64()),
            "base": pa.array(np.abs(none[first[i]] - none[second[j]]) if len(i) else [], pa.int64()),
        }
    )


def distances(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Every pair of sources of a language, both ways, ranked by the sum of differences of all shares.

    Sources are dealt to blocks and terms to parts; a task compares two blocks over
    one part. Absent terms are never written out: a source's share of them is one
    number.
    """
    whole = F.col("total") + ADDED * F.col("kept")
    blocks, parts = F.ceil(F.col("sources") / SOURCES), F.greatest(F.ceil(F.col("lang_rows") / PART), F.lit(1))
    none = F.when(F.col("kept") > 0, share(F.lit(ADDED).cast("long"), whole)).otherwise(F.lit(0).cast("long"))
    known = totals.select(
        "lang", "source", "kept", whole.alias("whole"), none.alias("none"), blocks.alias("blocks"), parts.alias("parts"),
        F.pmod(F.xxhash64("source"), blocks).alias("block"),
    )
    # A cell is a pair of blocks of a language; every source is in the cells of its block with each block.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def in_cells(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", other)
        a, b = F.least("block", "other"), F.greatest("block", "other")
        return rows.withColumn("cell", F.concat_ws(",", a, b)).withColumns(
            {"first": F.col("block") == a, "second": F.col("block") == b, "cell": F.concat("cell", F.lit("\0"), "lang")}
        )

    members = in_cells(known).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.select("cell", "part", "source", "first", "second", "none")
    shares = counts.join(known, ["lang", "source"]).withColumn("share", share(F.col("n") + ADDED, F.col("whole")))
    shares = in_cells(shares).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    shares = shares.select("cell", "part", "source", "term", "share")
    found = (
        shares.groupBy("cell", "part")
        .cogroup(members.groupBy("cell", "part"))
        .applyInArrow(apart, "lang string, a string, b string, value long, seen long, base long")
    )
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("base").alias("base"))
    kept = totals.select("lang", F.col("source").alias("a"), "kept")
    sums = sums.join(kept, ["lang", "a"]).withColumn("value", F.col("value") + (F.col("kept") - F.col("seen")) * F.col("base"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = sums.select("lang", "value", way.alias("way")).select("lang", "way.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: parts ``pair`` (other sources) and ``term`` (terms that stand out).

    Null text, lang and source count as ''. Repeated rows count as often as they
    stand there. A group without kept terms has pairs (value 0 where the language
    keeps none) and no terms; a language with one source has no pairs; an empty
    table gives no rows. Equal values go by UTF-8. Other columns are ignored.
    """
    counted = written(term_counts(docs), "divergence-counts")
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("documents"))
    of_lang = of_lang.filter(F.col("documents") >= least).drop("documents")
    counts = written(counted.drop("docs").join(of_lang, ["lang", "term"]), "divergence-kept")
    empty = F.lit("")
    groups = docs.select(
        F.coalesce(F.col("`lang`").cast("string"), empty).alias("lang"), F.coalesce(F.col("`source`").cast("string"), empty).alias("source")
    ).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    terms = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    sizes = totals.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("terms").alias("lang_rows"))
    totals = written(totals.join(sizes, "lang"), "divergence-totals")
    found = distances(counts, totals).unionByName(standing_out(counts, totals, top))
    return found.withColumn("value", F.col("value").cast("long")).withColumn("rank", F.col("rank").cast("int"))
