"""SentencePiece models encoded and decoded by the tokenizers library.

The model file is parsed here, its normaliser, its mark for blanks, its scores or
merges and its byte fallback are rebuilt as a tokenizer, and every distinct word
that a task meets is checked against the original library.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.common import texts_of

MARK = "▁"
# Field numbers, piece types and model types of the model file's format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SUFFIX_MARK = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

REMEMBERED = 200_000
#: Words passed to the library at a time; its threads share them.
BATCH = 4096


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a message; length-delimited and fixed values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says, as far as encoding needs it; absent settings have the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_blanks: bool = True
    escape_blanks: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == PIECES:
            own = dict(fields(value))
            score = float(np.frombuffer(own.get(PIECE_SCORE, b"\0\0\0\0"), "<f4")[0])
            model.pieces.append((own.get(PIECE_TEXT, b"").decode(), score, own.get(PIECE_TYPE, NORMAL)))
        elif number == TRAINER:
            own = dict(fields(value))
            model.kind = own.get(MODEL_TYPE, UNIGRAM)
            model.byte_fallback = bool(own.get(BYTE_FALLBACK, 0))
            model.suffix_mark = bool(own.get(SUFFIX_MARK, 0))
        elif number == NORMALIZER:
            own = dict(fields(value))
            model.charsmap = own.get(CHARSMAP, b"")
            model.dummy_prefix = bool(own.get(DUMMY_PREFIX, 1))
            model.remove_blanks = bool(own.get(REMOVE_BLANKS, 1))
            model.escape_blanks = bool(own.get(ESCAPE_BLANKS, 1))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, the best-scored piece first."""
    ids = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    found = []
    for text, score, kind in model.pieces:
        if kind not in (NORMAL, USER):
            continue
        ways = [(text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in ids and text[k:] in ids]
        found += [(-score, ids[text], ids[a], ids[b], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuilt(model: Model):
    """A tokenizer with the model's behaviour for one word at a time, blanks already marked."""
    from tokenizers import Tokenizer, decoders, models

    unknown = model.unknown
    if model.kind == UNIGRAM:
        vocabulary = [(text, score) for text, score, _ in model.pieces]
        core = models.Unigram(vocabulary, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        ids = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            ids, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    made = Tokenizer(core)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return made


def normalizer(model: Model):
    """The model's character map, or None where it has none."""
    if not model.charsmap:
        return None
    from tokenizers import normalizers

    return normalizers.Precompiled(model.charsmap)


class PieceEncoder:
    """Encodes and decodes whole texts; distinct words are encoded once, in batches over threads.

    A word is a run of blank marks with what follows it. That is right where no
    piece goes on past a blank, which is checked on loading; otherwise the text is
    one word. With ``verify`` each new word must get the ids that the original
    library gives it.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        with open(path, "rb") as file:
            self.model = parse(file.read())
        if self.model.suffix_mark or not self.model.escape_blanks:
            raise ValueError("models with blanks behind words or unmarked blanks are not supported")
        self.tokenizer = rebuilt(self.model)
        self.normalizer = normalizer(self.model)
        self.by_word = not any(MARK in text.lstrip(MARK) for text, _, _ in self.model.pieces)
        self.users = [text for text, _, kind in self.model.pieces if kind == USER]
        self.original = None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: Words that decoding does not give back.
        self.lossy: set[str] = set()

    def marked(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.remove_blanks:
            text = re.sub(" +", " ", text).strip(" ")
        # An empty text stays empty: it gets no prefix.
        return MARK * (self.model.dummy_prefix and text != "") + text.replace(" ", MARK)

    def words(self, text: str) -> list[str]:
        marked = self.marked(text)
        if not marked:
            return []
        if not self.by_word:
            return [marked]
        if MARK + MARK in marked or marked[0] != MARK:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        return [MARK + x for x in marked[1:].split(MARK)]

    def _ids(self, words: list[str]) -> list[bytes]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        if self.original is not None:
            self._verify(words, found)
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        self.lossy.update(w for w, x in zip(words, back) if x != w.replace(MARK, " "))
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [0, *accumulate(4 * len(x) for x in found)]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def _verify(self, words: list[str], found: list[list[int]]) -> None:
        """The original library marks blanks itself, so it gets the words as they stood in the text."""
        if not self.model.dummy_prefix or self.model.remove_blanks or self.normalizer is not None:
            return
        marked = [i for i, w in enumerate(words) if w[0] == MARK and w != MARK]
        plain = [words[i][1:].replace(MARK, " ") for i in marked]
        wanted, own = self.original.encode(plain, num_threads=1), [found[i] for i in marked]
        if wanted != own:
            word, ids, mine = next(x for x in zip(plain, wanted, own) if x[1] != x[2])
            raise ValueError(f"{word!r}: {mine} are not the ids {ids} of the original library")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit bytes."""
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of every text, and whether decoding them gives its normalised form back.

        Words are decoded as they are met, so a text is faithful if it has no word
        that decoding changed.
        """
        split = [self.words(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*split).difference(known)
        known.update((w, before[w]) for w in new if w in before)
        new = [w for w in new if w not in known]
        for a in range(0, len(new), BATCH):
            known.update(zip(new[a : a + BATCH], self._ids(new[a : a + BATCH])))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        faithful = [not self.lossy or self.lossy.isdisjoint(words) for words in split]
        for word in new:
            if len(word) > 64:
                del known[word]
                self.lossy.discard(word)
        return out, faithful

    def decode(self, ids: bytes) -> str:
        """The text of some ids, without the blank that encoding put in front."""
        text = self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


ENCODED = "doc_id {kind}, ids binary, n_tokens long, ids_crc32 long, n_unknown long, round_trip boolean"


def encode_documents(docs: DataFrame, path: str, threads: int = 2, verify: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, n_unknown and whether decoding gives the normalised text back.

    A null text is an empty one and has no ids. Ids may be null or repeat; an
    empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    made: dict[str, PieceEncoder] = {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in made:
            made[path] = PieceEncoder(path, threads, verify)
        encoder = made[path]
        unknown = np.uint32(encoder.model.unknown)
        for batch in batches:
            texts = [x.decode() for x in texts_of(batch.column(1))]
            for start in range(0, len(texts), 256):
                some = texts[start : start + 256]
                found, faithful = encoder.encode_checked(some)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(start, len(some)),
                        "ids": pa.array(found, pa.binary()),
                        "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64()),
                        "n_unknown": pa.array([int((np.frombuffer(x, "<u4") == unknown).sum()) for x in found], pa.int64()),
                        "round_trip": pa.array(faithful, pa.bool_()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED.format(kind=kind))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` as 32-bit bytes; null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    made: dict[str, PieceEncoder] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in made:
            made[path] = PieceEncoder(path, verify=False)
        for batch in batches:
            texts = [None if x is None else made[path].decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")
