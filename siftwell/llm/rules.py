"""A sparse ensemble of rules that tells good texts from poor ones.

Small trees grown on a bounded sample of labelled rows give conjunctions over text
statistics; a lasso logistic fit keeps a few of them; what it keeps becomes one
Spark column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import apart

#: Labelled rows that are brought to the driver for fitting, at most.
SAMPLE_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "top_word", "repeated_next",
    "log_lines", "line_words", "distinct_lines", "repeated_bytes", "closed_lines", "listed_lines", "short_lines",
    "upper", "digits", "other_letters", "blanks", "sentence_marks", "symbols", "bars", "brackets", "marked_words",
    "byte_entropy", "sentence_words",
)

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "other_letters": bytes(range(128, 256)),
    "blanks": b" \t\n\r\v\f",
    "sentence_marks": b".,;:!?",
    "symbols": b"#$%&*+=@^_~`\\/",
    "bars": b"|",
    "brackets": b"()[]{}<>",
}
_MEMBERS = np.stack([np.isin(np.arange(256), list(v)).astype(float) for v in _CLASS.values()])
_SYMBOLS = frozenset(b"#$%&*+=@^_~`\\/|<>{}[]")
_CLOSING = tuple(bytes([c]) for c in b".!?:;\"')")


def statistics(data: bytes) -> list[float]:
    """The values of STATISTICS for one text, in this order; all zero for a text without words."""
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, n_words = len(data), len(words)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = bytes_of[bytes_of > 0] / n
    classes = (_MEMBERS @ bytes_of) / n
    letters = n - classes[3] * n
    marks = sum(bytes_of[c] for c in b".!?")
    return [
        math.log1p(n),
        math.log1p(n_words),
        letters / n_words,
        float(max(map(len, counts))),
        len(counts) / n_words,
        max(counts.values()) / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words,
        math.log1p(len(lines)),
        n_words / len(lines),
        len(line_counts) / len(lines),
        sum((k - 1) * len(x) for x, k in line_counts.items()) / n,
        sum(x.rstrip().endswith(_CLOSING) for x in lines) / len(lines),
        sum(x.lstrip()[:1] in (b"-", b"*", b"|") or x.rstrip()[-1:] == b"|" for x in lines) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        *classes.tolist(),
        sum(k for x, k in counts.items() if x[-1] in _SYMBOLS or x[0] in _SYMBOLS) / n_words,
        float(-(share * np.log2(share)).sum()),
        n_words / (marks + 1),
    ]


def _statistics_of(texts: pa.Array) -> pa.Array:
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    rows = [statistics(x.as_py() or b"") for x in texts.cast(kind)]
    values = np.array(rows, float).reshape(len(rows), len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))


def statistics_column(text: str) -> Column:
    """A struct of all statistics of the whole text; null counts as empty."""
    schema = "struct<" + ", ".join(f"{x}: double" for x in STATISTICS) + ">"
    return F.arrow_udf(_statistics_of, schema)(F.col(text))


@dataclass(frozen=True)
class Condition:
    statistic: int
    above: bool
    limit: float


Rule = frozenset[Condition]


@dataclass
class RuleModel:
    """Weighted rules; a text's score is the logistic function of bias plus the weights of the rules it meets."""

    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, statistics: Column) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            met = None
            for c in sorted(rule, key=lambda c: (c.statistic, c.above, c.limit)):
                value = statistics.getField(STATISTICS[c.statistic])
                one = value > c.limit if c.above else value <= c.limit
                met = one if met is None else met & one
            total = total + F.when(met, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        said = []
        for rule, weight in sorted(self.rules, key=lambda x: -abs(x[1])):
            parts = [f"{STATISTICS[c.statistic]} {'>' if c.above else '<='} {c.limit:.4g}" for c in rule]
            said.append(f"{weight:+.3f} if {' and '.join(sorted(parts))}")
        return said


def _limits(values: np.ndarray, bins: int = 48) -> np.ndarray:
    """Cut points between distinct values, at most ``bins`` of them, spread by rank and at the ends."""
    known = np.unique(values)
    if len(known) < 2:
        return np.zeros(0)
    ranks = np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")
    picked = np.unique(np.concatenate([ranks, known[[0, len(known) // 2]]]))
    after = known[np.minimum(np.searchsorted(known, picked, side="right"), len(known) - 1)]
    return np.unique((picked + after)[picked < after] / 2)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> list[Rule]:
    """Every path of boosted trees, each grown on half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    limits = [_limits(x[:, j]) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(limits[j], x[:, j], side="left").astype(np.uint8) for j in range(x.shape[1])], axis=1)
    raw = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[Rule, None] = {}
    usable = [j for j in range(x.shape[1]) if len(limits[j])]
    least = max(3.0, len(y) * 0.001)

    def split(rows: np.ndarray, picked: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
        best = (1e-6, 0, 0)
        for j in picked:
            size = len(limits[j]) + 1
            g = np.bincount(bins[rows, j], gradient[rows], size)
            h = np.bincount(bins[rows, j], weight[rows], size)
            k = np.bincount(bins[rows, j], minlength=size)
            gl, hl, kl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(k)[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(kl < least) | (len(rows) - kl < least)] = 0
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), int(j), at))
        return best if best[0] > 1e-6 else None

    for _ in range(trees if usable else 0):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        picked = rng.choice(usable, max(1, len(usable) // 2), replace=False)
        leaves = [(rows, np.arange(len(y)), frozenset())]
        for _ in range(depth):
            grown = []
            for inside, all_rows, rule in leaves:
                cut = split(inside, picked, gradient, weight) if len(inside) >= 2 * least else None
                if cut is None:
                    grown.append((inside, all_rows, rule))
                    continue
                _, j, at = cut
                for above in (False, True):
                    path = rule | {Condition(j, above, float(limits[j][at]))}
                    found.setdefault(path)
                    grown.append((inside[(bins[inside, j] > at) == above], all_rows[(bins[all_rows, j] > at) == above], path))
            leaves = grown
        for inside, all_rows, _ in leaves:
            raw[all_rows] += 0.3 * gradient[inside].sum() / (weight[inside].sum() + 1)
    return list(found)


def met_by(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """A row for every text and a column for every rule: 1 where the text meets it."""
    return np.unpackbits(bits_of(rules, x), axis=1, count=len(x)).T


def bits_of(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """A row of bits for every rule: which texts meet it."""
    out = np.zeros((len(rules), -(-len(x) // 8)), np.uint8)
    for i, rule in enumerate(rules):
        met = np.ones(len(x), bool)
        for c in rule:
            met &= (x[:, c.statistic] > c.limit) == c.above
        out[i] = np.packbits(met)
    return out


def largest_square(z: np.ndarray, steps: int = 60) -> float:
    """A bound from above, by a few per cent, for the largest eigenvalue of z'z, by power steps."""
    v, size = np.ones(z.shape[1], np.float32), 0.0
    for _ in range(steps):
        v = z.T @ (z @ (v / max(float(np.linalg.norm(v)), 1e-30)))
        size = float(np.linalg.norm(v))
    return 1.05 * size


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400, start=None) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; the bias is not penalised."""
    n, d = z.shape
    reach = 0.25 * (largest_square(z) / n + 1)
    w = np.zeros(d + 1) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ ahead[1:].astype(np.float32) + ahead[0])))
        slope = np.concatenate([[np.mean(p - y)], (z.T @ (p - y).astype(np.float32)) / n])
        moved = ahead - slope / reach
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - penalty / reach, 0)
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = moved + (t - 1) / faster * (moved - w), moved, faster
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, most: int = 120) -> RuleModel:
    """Rules from trees, weights from the penalty that serves a fifth of the rows best.

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    constant = RuleModel(math.log(share / (1 - share)), [])
    if len(y) < 20 or y.min() == y.max():
        return constant
    rules = grow_rules(x, y)
    if not rules:
        return constant
    # The fifth that is set apart lies in front, so that both parts are slices of one table.
    order = np.argsort(np.arange(len(y)) % 5 != 0, kind="stable")
    x, y, m = x[order], y[order], -(-len(y) // 5)
    bits = bits_of(rules, x)
    distinct = {row.tobytes(): i for i, row in reversed([*enumerate(bits)])}
    first = [i for i in sorted(distinct.values()) if 0 < int(np.bitwise_count(bits[i]).sum()) < len(y)]
    rules = [rules[i] for i in first]
    z = np.empty((len(y), len(first)), np.float32)
    for column, i in enumerate(first):
        z[:, column] = np.unpackbits(bits[i], count=len(y))
    tried, rest = slice(None, m), slice(m, None)
    best, start = (math.inf, 0.01), None
    for penalty in (0.02, 0.01, 0.005, 0.0025, 0.001, 0.0005):
        bias, w = lasso_logistic(z[rest], y[rest], penalty, 200, start)
        start = np.concatenate([[bias], w])
        p = np.clip(1 / (1 + np.exp(-(z[tried] @ w + bias))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[tried] * np.log(p) + (1 - y[tried]) * np.log(1 - p))
        if loss < best[0] - 1e-5 and (w != 0).sum() <= most:
            best = (loss, penalty)
    bias, w = lasso_logistic(z, y, best[1])
    heavy = [i for i in np.argsort(-np.abs(w)) if w[i] != 0]
    return RuleModel(bias, [(rules[i], float(w[i])) for i in heavy])


def remainder(id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fifth.

    The rows with the smallest hashes of their ids are taken, the same ones every
    time. Rows with a null id or label are not used. Only the sample's ids (hence
    the broadcast) and statistics meet on the driver.
    """
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("double").alias("l_label"))
    usable = usable.filter(F.col("l_id").isNotNull() & F.col("l_label").isin(0.0, 1.0) & (remainder("l_id", 5) != 0))
    sample = usable.orderBy(F.xxhash64("l_id"), "l_id", "l_label").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    rows = found.select(F.col("l_id"), "l_label", statistics_column("text").alias("s")).select("l_id", "l_label", "s.*").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in rows.column_names])
    x = np.stack([rows.column(c).to_numpy() for c in STATISTICS], axis=1).reshape(rows.num_rows, len(STATISTICS))
    return fit_rules(x, rows.column("l_label").to_numpy())


def quality_scores(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null text counts as empty and is scored by the same rules on zeros. Repeated
    rows score alike; an empty table gives no rows; other columns are ignored.
    """
    scored = docs.select("doc_id", statistics_column("text").alias("s"))
    scored = scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), model.score(F.col("s")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns.

    A null text is scored as an empty one; repeated rows go or stay together; an
    empty table gives no rows; other columns may have any names and types.
    """
    name = apart(docs, "s")
    return docs.withColumn(name, statistics_column("text")).filter(model.score(F.col(name)) >= threshold).drop(name)
