"""Hashed word and character features of texts, worked out once for each distinct word of a batch."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import Known, coded, per_text


#: Odd multipliers of the n-gram hash, one for each place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
NOT_WORD = regex.compile(r"[^\p{L}\p{N} ]+")


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between white space, the number of each word in order, and how many words each text has."""
    words, codes, per = coded(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts, pa.large_string()))))
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # the only part of a text without words
        full = codes != blank
        codes, per = codes[full], per_text(full.astype(np.int64), per)
    return words, codes, per


def ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the lower-case letters and digits of every word, with its ends, and its word's number.

    whole: the word itself is a feature too. Words without letters and digits have no features.
    """
    joined = " " + NOT_WORD.sub("", " ".join(words).lower()) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blank = points == 32
    word = np.cumsum(blank) - 1
    hashed, of = [], []
    for n in sizes:
        k = len(points) - n + 1
        if k <= 0:
            continue
        value = sum(points[j : j + k] * PLACES[j] for j in range(n)) + np.uint64(n * 0x51ED270B)
        value ^= value >> np.uint64(29)
        value *= PLACES[1]
        bad = blank[:k].copy() if n == 1 else np.zeros(k, bool)
        for j in range(1, n - 1):
            bad |= blank[j : j + k]
        if n == 2:
            bad |= blank[:k] & blank[1 : 1 + k]
        keep = np.flatnonzero(~bad)
        hashed.append((value[keep] >> np.uint64(40)).astype(np.int64) % buckets)
        of.append(word[keep])
    if whole:
        each = joined[1:-1].split(" ")
        named = [k for k, w in enumerate(each) if w]
        hashed.append(np.array([zlib.crc32(each[k].encode("utf-8", "replace")) % buckets for k in named], np.int64))
        of.append(np.array(named, np.int64))
    h, w = np.concatenate(hashed or [np.zeros(0, np.int64)]), np.concatenate(of or [np.zeros(0, np.int64)])
    order = np.argsort(w, kind="stable")
    return h[order], w[order]


def summed(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by their (ascending) number in `of`."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(of):
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


class TableMemo:
    """Bounded memo from a string to a row of numbers; `fill(strings)` gives the rows of new strings."""

    def __init__(self, fill, width: int, most: int):
        self.fill, self.known, self.n = fill, Known(most), 0
        self.table = np.zeros((0, width), np.float32)

    def rows(self, strings: pa.Array) -> np.ndarray:
        """The row numbers of distinct strings in `table`; they hold until the next call."""
        rows, new, anew = self.known.rows(strings)
        if anew:
            self.n = 0
        if need := len(new) and self.n + len(new):
            if len(self.table) < need:
                self.table = np.concatenate((self.table[: self.n], np.zeros((max(need, self.n * 5 // 4) - self.n, self.table.shape[1]), np.float32)))
            for k in range(0, len(new), 20_000):  # in turns, to bound the memory
                part = new[k : k + 20_000].to_pylist()
                self.table[self.n + k : self.n + k + len(part)] = self.fill(part)
            self.n = need
        return rows


def share_of(key, n: int, most: int):
    """Whether a hash of the key falls below the share of about `most` of n rows; the same keys every time."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1)))


def bounded(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """At most `most` rows, by a hash of the key, then the key and the text: the same ones every time."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key, text).limit(most)


def bounded_sample(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """About `most` rows, the same ones every time: those of which a hash of the key falls below a share. Never over 1.5 times as many."""
    return bounded(rows.where(share_of(F.col(key), rows.count(), most)), key, text, most + most // 2)


def held_out(doc_id):
    """Whether crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
