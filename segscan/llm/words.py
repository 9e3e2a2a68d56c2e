"""Words of a text: what the leak search and the reading level count as words."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tag of any length; one of more than 200 characters has an attribute. The patterns never go back, so they are linear.
TAG = r"</?[A-Za-z](?:[^<>]{0,200}+>|(?=[^<>]*=)[^<>]*+>)"
_TAG = re.compile(TAG)
_PAGE = re.compile(r"^[ \t]*\(p\. ?\d+\)[ \t]*$", re.M)
_WORD = re.compile(r"[^\W_]+")
#: Soft hyphens, zero-width characters and byte order marks join what stands around them.
_INVISIBLE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


def words(text: str | None) -> list[str]:
    """Words without regard to case, accents, punctuation, tags, entities, line marks and spacing; none for null."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "(p." in text:
        text = _PAGE.sub(" ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_INVISIBLE)) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


#: Stands between two texts that are read as one: no tag, entity or page mark can go across it.
_BETWEEN = "\n\x01<\n"
#: No code point from here on folds to another or is part of a word.
_LAST = 0x32400
_BASE = 0x9E3779B97F4A7C15


@cache
def _folds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point how many characters ``words`` makes of it and where they begin in the third array; whether one is part of a word."""
    folded = ["" if i in _INVISIBLE else "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).casefold() for i in range(_LAST)]
    folded.append(" ")
    size = np.array([len(x) for x in folded], np.int64)
    flat = np.array([min(ord(c), _LAST) for x in folded for c in x], np.int64)
    return size, np.cumsum(size) - size, flat, np.array([chr(i).isalnum() for i in range(_LAST)] + [False])


def scatter(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word that ``words`` gives for the texts, one after the other, and the words per text.

    All texts are one array of code points, so that no word becomes a Python object.
    """
    joined = _BETWEEN.join(t.replace("\x01", " ") if t else "" for t in texts)
    joined = _PAGE.sub(" ", html.unescape(_TAG.sub(" ", joined)))
    size, start, flat, is_word = _folds()
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _LAST)
    sizes = size[points]
    ends = np.cumsum(sizes)
    chars = flat[start[points]] if len(points) and sizes.min() == sizes.max() == 1 else flat[np.repeat(start[points] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    inside = np.concatenate(([False], is_word[chars], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, stops = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        # Sums over a word of character times base to the power of its place, taken out of one running sum.
        power = np.full(len(chars) + 1, _BASE, np.uint64)
        back = np.full(len(chars) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[:1] = back[:1] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scatter(chars) * power[:-1], dtype=np.uint64)))
        hashes = scatter((sums[stops] - sums[begins]) * back[begins] + (stops - begins).astype(np.uint64))
    text_of = np.searchsorted(np.flatnonzero(chars == 1), begins)
    return hashes, np.bincount(text_of, minlength=len(texts))[: len(texts)]


def letter_words(text: Column) -> Column:
    """The words of letters only, in lower case, as an array; tags and entities are left out. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(text, TAG, " "), "&#?[A-Za-z0-9]{1,8};", " ")
    return F.filter(F.split(F.lower(bare), r"[^\p{L}\p{M}]+"), lambda w: w != "")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; where the scan has that many, without a shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(2 * want, key)
