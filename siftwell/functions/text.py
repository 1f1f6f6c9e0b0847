"""Tokens, phrases, overlap and highlighting as Column expressions."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters, blanks, minimum length and stop words.
EDGE = r"[\p{L}\p{N}_]"
WORD = EDGE + "+"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
SOLID = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
BLANKS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
MIN_LENGTH = 2
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "at", "from", "by", "for", "with", "about",
    "to", "in", "on", "of", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her", "its", "our", "their",
)


def whole(alternatives: str) -> str:
    """Pattern for whole words; edges are spelled out because ``\\b`` may be ASCII."""
    return rf"(?<!{EDGE})(?:{alternatives})(?!{EDGE})"


def between_blanks(words: Iterable[str]) -> str:
    """Pattern for any of the words standing between blanks or at an end."""
    return rf"(?<!{SOLID})(?:{'|'.join(re.escape(w) for w in words)})(?!{SOLID})"


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.trim(c, F.lit(BLANKS))


def space_words(c: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda w: w != "")


def normalize(c: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.translate(F.lower(c), string.punctuation, "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(WORD), F.lit(0))


def is_token(word: Column, stop_words: Iterable[str] = ()) -> Column:
    return (F.length(word) >= MIN_LENGTH) & ~word.isin([*STOP_WORDS, *stop_words])


def tokens(c: Column, stop_words: Iterable[str] = ()) -> Column:
    """Words of two characters or more that are no stop words, in text order."""
    extra = list(stop_words)
    return F.filter(words(c), lambda w: is_token(w, extra))


def query_tokens(query: str, stop_words: Iterable[str] = ()) -> list[str]:
    """The same tokens for one literal query string."""
    bare = query.lower().translate(str.maketrans("", "", string.punctuation))
    drop = {*STOP_WORDS, *stop_words}
    return [w for w in re.findall(r"\w+", bare) if len(w) >= MIN_LENGTH and w not in drop]


def phrases(word_array: Column, longest: int = 3) -> Column:
    """All runs of 1..``longest`` words, by start position.

    ``word_array`` must be a plain column: it is read once per word.
    """

    def runs(word: Column, start: Column) -> Column:
        out = [word]
        for n in range(1, longest):
            # Null past the end, and so is everything joined to it.
            out.append(F.concat(out[-1], F.lit(" "), F.get(word_array, start + n)))
        return F.array(*out)

    return F.array_compact(F.flatten(F.transform(word_array, runs)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays, 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def highlight(c: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Wrap every whole-word occurrence of a query token, keeping its case."""
    wanted = list(dict.fromkeys(query_tokens(query)))
    if not wanted:
        return c
    literal = [re.sub(r"([\\$])", r"\\\1", s) for s in (before, after)]
    pattern = rf"(?iu){whole('|'.join(wanted))}"
    return F.regexp_replace(c, F.lit(pattern), F.lit(f"{literal[0]}$0{literal[1]}"))
