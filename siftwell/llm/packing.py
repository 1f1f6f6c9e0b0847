"""Documents packed into sequences of a fixed length, with a certificate for every part.

Each part is packed best-fit decreasing and compared with a lower bound from dual
feasible functions. Parts that miss their bound exchange the documents of their
open sequences, and these are packed anew, as long as that saves sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.bytebpe import lots
from siftwell.llm.common import written

SEQUENCE = 4096
PART_PIECES = 32_768
#: Distinct words whose ids a worker remembers, twice over.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
#: Characters of texts that are split at a time, single texts excepted.
LOT_CHARS = 1 << 22
#: Letters of plain words (Latin ones that have one lower case).
LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130)
#: One match a line: letters and the marks that may stand behind them; both empty for any other word.
PLAIN = re.compile(rf"^(?:([{LETTERS}]{{1,{LONGEST_REMEMBERED}}})([!-&(-/:-@\[-`{{-~]{{0,{LONGEST_REMEMBERED}}})|.*)$", re.MULTILINE)
#: Words on which the short way must agree with the whole tokenizer before it is used.
PROBES = (
    *("the", "Ouvre", "été.", "ÉTÉ", "straße,", "x.", "ñandú", "zzqxj", "ŒUVRE", "don't", "a.b", "3rd", "...", "œ,"),
    *("il***", "être.&&&", "a$.", "Q?!", "d<|", "s)_", "re`~", "Été[{"),
)


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts, word by word, each distinct word encoded once.

    Only for tokenizers that treat a blank or line feed as a border which no token
    crosses and which itself has no ids, as word-end vocabularies do; ids are held
    as little-endian 32-bit bytes. Plain Latin words go to the tokenizer's model
    directly, in lower case, and the marks behind them by themselves; all others
    pass through the whole tokenizer. A check on loading decides whether that
    short way is right for the tokenizer at hand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.short = True
        self._learn([*PROBES])
        self.short = [*map(self.known.__getitem__, PROBES)] == self._whole(PROBES)
        self.known.clear()

    def _whole(self, words) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(words), add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _model(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case plain words, by the model alone."""
        model, ids, ends = self.tokenizer.model, [], [0]
        for word in words:
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids += [x.id for x in model.tokenize(word)]
            ends.append(len(ids))
        data, places = np.array(ids, "<u4").tobytes(), [4 * x for x in ends]
        return [data[a:b] for a, b in pairwise(places)]

    def _recall(self, words: Iterable[str]) -> list[str]:
        """The words not known yet; those of the generation before become known."""
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        if before:
            old = [*map(before.get, new)]
            known.update((w, ids) for w, ids in zip(new, old) if ids is not None)
            new = [w for w, ids in zip(new, old) if ids is None]
        return new

    def _learn(self, words: list[str]) -> list[str]:
        """Makes distinct words without line feeds known; those that were not before."""
        known = self.known
        new = others = self._recall(words)
        if self.short and new:
            found = PLAIN.findall("\n".join(new))
            cores = self._recall({core.lower() for core, _ in found if core})
            known.update(zip(cores, self._model(cores)))
            marks = self._recall({mark for _, mark in found})
            known.update(zip(marks, self._whole(marks)))
            known.update((w, known[core.lower()] + known[mark]) for w, (core, mark) in zip(new, found, strict=True) if core)
            others = [w for w, (core, _) in zip(new, found) if not core]
        known.update(zip(others, self._whole(others)))
        return new

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for start, stop in lots(texts, LOT_CHARS):
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            split = pc.split_pattern(pa.array([x.replace("\n", " ") for x in texts[start:stop]], pa.large_string()), " ")
            words = split.values.dictionary_encode()
            every = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
            distinct = pc.binary_join(every, pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")
            new = self._learn(distinct)
            ids = binaries([*map(self.known.__getitem__, distinct)])
            for word in new:
                if len(word) > LONGEST_REMEMBERED:
                    del self.known[word]
            by_text = pa.ListArray.from_arrays(split.offsets, ids.take(words.indices))
            for joined in pc.binary_join(by_text, pa.scalar(b"", pa.large_binary())):
                yield joined.as_py()


def binaries(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(values))])


#: Encoders of this worker, which serve all its tasks.
ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, longest: int = SEQUENCE) -> DataFrame:
    """Every document's ids and its end id, cut into pieces of ``longest`` where there are more.

    One row per piece: doc_id, piece, start, length, ids_crc32. A null or empty
    text is the end id alone; ids may be null or repeat, each row is a document.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, which = [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, ids in enumerate(encoder(path).encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * longest)):
                    part = ids[at : at + 4 * longest]
                    which.append(i)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(list(x), k) for x, k in zip(columns, kinds)]
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind=kind))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length. Open bins are held by their free room, found through a bit set."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_bins[left].append(b)
            free |= 1 << left
    return bins, offsets


def bins_needed(lengths: np.ndarray, capacity: int, levels: int = 32) -> int:
    """A proven lower bound: the largest that two families of dual feasible functions give.

    Lengths above the capacity less a threshold count as whole bins and lengths
    below the threshold as nothing, for every threshold; and lengths are rounded
    down to multiples of 1/k where they are no multiple of 1/(k+1).
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    upto, mass = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    whole = upto[-1] - upto[capacity - t]
    totals = whole * capacity + mass[capacity - t] - mass[t - 1]
    best = max(-(-int(mass[-1]) // capacity), -(-int(totals.max(initial=0)) // capacity))
    for k in range(1, levels + 1):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def packed(parts: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Packs every part (column ``part``); marks what may be exchanged.

    ``open`` rows lie in sequences with room left, in parts that miss their bound,
    or in the emptiest sequence of a part that meets it: rounding leaves one such
    sequence in every part.
    """

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        table = table.take(pa.array(np.lexsort((table.column("item").to_numpy(), lengths))))
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        missed = len(fill) - bins_needed(lengths, capacity)
        loose = (fill < capacity) if missed else (np.arange(len(fill)) == fill.argmin()) & (fill < capacity)
        sequence = (turn << 56) + (table.column("part").to_numpy().astype(np.int64) << 28) + bins
        for name, values in (
            ("sequence_id", sequence),
            ("offset", offsets),
            ("open", loose[bins]),
            ("missed", np.full(len(bins), missed, np.int64)),
        ):
            table = table.append_column(name, pa.array(values))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.groupBy("part").applyInArrow(pack, f"{schema}, sequence_id long, offset long, open boolean, missed long")


def in_parts(df: DataFrame, size: int) -> DataFrame:
    n = max(1, -(-df.count() // size))
    return df.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n)))


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Only lengths and ids travel. Parts hold about ``part_pieces`` rows whatever
    the table's size. A round of exchange counts only if it saves a sequence, so
    the rounds come to an end, and no round leaves more sequences than before.
    """
    items = written(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    keep = [*pieces.columns, "sequence_id", "offset"]
    now = written(packed(in_parts(items, part_pieces), capacity, 0), "packed")
    final: list[DataFrame] = []
    turn = 0
    while True:
        exchanged = now.filter("open")
        before = exchanged.filter("offset = 0").count()
        if before < 2:
            break
        turn += 1
        rest = exchanged.select(*pieces.columns, "item")
        again = written(packed(in_parts(rest, part_pieces), capacity, turn), "repacked")
        if again.filter("offset = 0").count() >= before:
            break
        final.append(now.filter("NOT open").select(*keep))
        now = again
    return reduce(DataFrame.unionByName, [*final, now.select(*keep)])


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their sequence and offset; see ``token_pieces`` and ``pack_pieces``.

    Other columns of the documents are ignored; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, path, end_id, capacity), capacity)
