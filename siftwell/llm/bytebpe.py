"""Byte-level BPE in matrices: words of like length merge side by side, a pair per word and round.

A task splits its texts by the tokenizer's pattern and encodes every distinct
match once. Matches of like length fill the rows of a padded matrix. In each
round every row merges its leftmost pair of the least rank; ranks come from a
hash table of pairs, and the columns that merging frees are taken out at once.
Decoding puts the tokens' bytes back one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.common import mix, texts_of

#: Rank of two tokens that do not merge.
NO_PAIR = np.iinfo(np.int32).max
#: Cells of one matrix.
CELLS = 1 << 19
#: Rounds over longer words would grow with the square of their length: such a word has a queue of its own.
LONG = 512
#: Distinct words remembered per generation, and the longest of them.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
#: Characters of texts that are split at a time, and matches of one text held at a time.
CHARS, MATCHES = 1 << 22, 1 << 18

# Code points that Unicode has as letters or numbers since version 17; the
# original library's tables are those of version 16, where they are neither.
SINCE_17 = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ "
    "꭬-꭭ \U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee "
    "\U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f "
    "\U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff "
    "\U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 "
    "\U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 "
    "\U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed "
    "\U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead "
    "\U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
#: A character that no version takes for a letter, number or blank.
NEITHER = ""


#: Texts below this character (all of Latin, Greek and Cyrillic) are split by plain character ranges.
SIMPLE = 0x558
SIMPLE_BYTES = bytes(range(0xD5))


def simple_pattern(pattern: str):
    """The pattern with its classes as ranges below ``SIMPLE``, for the faster standard library; None if it has others."""
    import regex

    made = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        hits = [c for c in range(SIMPLE) if regex.match(kind, chr(c))]
        runs = np.split(np.array(hits), np.flatnonzero(np.diff(hits) > 1) + 1)
        made[kind] = "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)
    letters, numbers, blanks = made.values()
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\S", f"[^{blanks}]")
    for kind, ranges in made.items():
        pattern = pattern.replace(kind, f"[{ranges}]")
    return None if re.search(r"\\[^u]", pattern) else re.compile(pattern)


class PairTable:
    """Ranks of pairs of tokens, by open addressing: a slot holds the pair as one 64-bit number."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(2 * len(pairs)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ranks = np.full(1 << self.bits, NO_PAIR, np.int32)
        # Key 0 marks a free slot, so pairs are kept plus one.
        left, slots = pairs.astype(np.uint64) + np.uint64(1), self._first(pairs)
        while len(left):
            free = self.keys[slots] == 0
            put, at = np.unique(slots[free], return_index=True)
            takes = np.flatnonzero(free)[at]
            self.keys[put], self.ranks[put] = left[takes], ranks[takes]
            rest = np.ones(len(left), bool)
            rest[takes] = False
            left, ranks, slots = left[rest], ranks[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _first(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair of tokens; negative tokens are padding and pair with nothing."""
        pairs = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        slots, wanted = self._first(pairs), pairs + np.uint64(1)
        held = self.keys[slots]
        found = np.where(held == wanted, self.ranks[slots], np.int32(NO_PAIR))
        open_ = np.flatnonzero((held != wanted) & (held != 0) & (a >= 0) & (b >= 0))
        while len(open_):
            at = slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            same = held == wanted[open_]
            found[open_[same]] = self.ranks[at[same]]
            open_ = open_[~same & (held != 0)]
        found[(a < 0) | (b < 0)] = NO_PAIR
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 and a number."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the rank file lacks the single bytes {missing[:5]}")
    return ranks


class ByteEncoder:
    """Encodes words, texts and back by the ranks of a file; new words of a call fill matrices together."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import regex

        self.ranks = read_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a << 32 | b, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None
        ]
        self.pairs = PairTable(np.array([p for p, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int32))
        self.pattern, self.newer = regex.compile(pattern), regex.compile(f"[{SINCE_17}]")
        self.simple = simple_pattern(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def matches(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, whole texts at a time unless a text has very many."""
        pattern, plain = self.simple or self.pattern, text
        if not text.isascii() and text.encode().translate(None, SIMPLE_BYTES):
            pattern, plain = self.pattern, self.newer.sub(NEITHER, text)
        if plain == text and len(text) <= CHARS:
            yield pattern.findall(text)
            return
        found = pattern.finditer(plain)
        while some := [text[m.start() : m.end()] for m in islice(found, MATCHES)]:
            yield some

    def _side_by_side(self, words: list[bytes]) -> list[np.ndarray]:
        """Words of like length, each a row; a row leaves the matrix when no pair is left in it."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        grid = np.full((len(words), width), -1, np.int32)
        grid[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.pairs.find(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(words), width - 1)
        out: list[np.ndarray] = [None] * len(words)
        row = np.arange(len(words))
        while len(row):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), NO_PAIR)
            alive = least != NO_PAIR
            if not alive.all():
                for i, ids in zip(row[~alive], grid[~alive]):
                    out[i] = ids[ids >= 0]
                row, grid, ranks, best, least = row[alive], grid[alive], ranks[alive], best[alive], least[alive]
                if not len(row):
                    break
            every = np.arange(len(row))
            grid[every, best] = least
            keep = np.ones(grid.shape, bool)
            keep[every, best + 1] = False
            grid = grid[keep].reshape(len(row), -1)
            keep = np.ones(ranks.shape, bool)
            keep[every, best] = False
            ranks = ranks[keep].reshape(len(row), -1)
            for shift in (-1, 0):  # the pairs that the new token makes on its left and right
                at = best + shift
                has = (at >= 0) & (at < ranks.shape[1])
                r, c = every[has], at[has]
                ranks[r, c] = self.pairs.find(grid[r, c], grid[r, c + 1])
        return out

    def _queued(self, word: bytes) -> np.ndarray:
        """One very long word: pairs come from a queue by rank and place, as rounds over all of it would be too many."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        ahead, behind = [*range(1, n + 1)], [*range(-1, n - 1)]
        ranks = [*self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist(), NO_PAIR]
        queue = [(rank, i) for i, rank in enumerate(ranks) if rank != NO_PAIR]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            if ranks[i] != rank:
                continue
            gone = ahead[i]
            ids[i], ids[gone], ranks[gone] = rank, -1, NO_PAIR
            ahead[i] = ahead[gone]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for k in (behind[i], i):
                if k >= 0:
                    ranks[k] = NO_PAIR if ahead[k] >= n else self._rank(ids[k], ids[ahead[k]])
                    if ranks[k] != NO_PAIR:
                        heappush(queue, (ranks[k], k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _rank(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], NO_PAIR)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word; a word that is a token itself stays whole, empty words are not allowed."""
        out = [None if (rank := self.ranks.get(w)) is None else np.array([rank], np.int32) for w in words]
        buckets: dict[int, list[int]] = {}
        for i, found in enumerate(out):
            if found is None:
                n = len(words[i])
                buckets.setdefault(0 if n > LONG else (n + 3) // 4 * 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            if not width:
                for i in members:
                    out[i] = self._queued(words[i])
                continue
            step = max(1, CELLS // width)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for i, ids in zip(some, self._side_by_side([words[i] for i in some])):
                    out[i] = ids
        return out

    def _learn(self, new: set[str]) -> None:
        self.known.update((w, self.before[w]) for w in new if w in self.before)
        missing = [w for w in new if w not in self.known]
        found = self.encode_words([w.encode() for w in missing])
        self.known.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(missing, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit bytes."""
        split = [self.matches(x) for x in texts]
        out = [b""] * len(texts)
        open_ = range(len(texts))
        # One piece of every text that has more; all but very long texts are one piece.
        while pieces := [(i, words) for i in open_ if (words := next(split[i], None))]:
            new = set().union(*(words for _, words in pieces)).difference(self.known)
            self._learn(new)
            for i, words in pieces:
                out[i] += b"".join(map(self.known.__getitem__, words))
            for word in new:
                if len(word) > REMEMBERED_BYTES:
                    del self.known[word]
            open_ = [i for i, _ in pieces]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of some ids, UTF-8 if they come from a whole text."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def lots(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many characters, single texts excepted."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (little-endian 32-bit bytes) and n_tokens of every whole text.

    A null or empty text has no ids. Ids of documents may be null or repeat, each
    row stands for itself; an empty table gives no rows; other columns are
    ignored. A very long text is split and encoded piece by piece; a single match
    of any length is one row of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made: dict[str, ByteEncoder] = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in made:
            made[path] = ByteEncoder(path, pattern)
        for batch in batches:
            texts = [x.decode() for x in texts_of(batch.column(1))]
            for a, b in lots(texts):
                found = made[path].encode(texts[a:b])
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "ids": pa.array(found, pa.binary()),
                        "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ``ids`` as 32-bit bytes, and digests of both.

    ``ids_sha256`` is that of the decimal ids joined by one space,
    ``decoded_sha256`` that of the decoded bytes. Null ids count as none; ids that
    the file lacks raise. Bytes that are no UTF-8 give replacement characters in
    ``text``, never in the digest.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    made: dict[str, tuple[list, list]] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in made:
            ranks = read_ranks(path)
            made[path] = ({r: t for t, r in ranks.items()}, {r: str(r) for r in ranks.values()})
        token, decimal = made[path]
        for batch in batches:
            texts, plain, digests = [], [], []
            for ids in batch.column(1).to_pylist():
                numbers = np.frombuffer(ids or b"", "<u4").tolist()
                back = b"".join(map(token.__getitem__, numbers))
                texts.append(back.decode(errors="replace"))
                plain.append(hashlib.sha256(" ".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                digests.append(hashlib.sha256(back).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_tokens": batch.column(2),
                    "text": pa.array(texts, pa.string()),
                    "ids_sha256": pa.array(plain, pa.string()),
                    "decoded_sha256": pa.array(digests, pa.string()),
                }
            )

    schema = f"doc_id {kind}, n_tokens long, text string, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(decode, schema)
