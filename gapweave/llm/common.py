"""What the corpus operators share: word normalisation, string memos, blocks of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.batches import BATCH_BYTES, BATCH_ROWS, bounded_batches
from gapweave.sources.scratch import materialise, scratch

__all__ = ["Known", "Memo", "binary_view", "blocks", "bounded_batches", "coded", "forget_others", "fresh", "grown", "list_array", "materialise", "per_text", "release", "remembers", "runs", "scratch", "split", "table", "words"]

#: Near-duplicate operators work on runs of so many words, at this similarity or more.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: What a memo's strings may take together.
MEMO_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, longer if `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; no words for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


class Known:
    """The strings that a memo has rows for, in one Arrow array, so that lookups and storage stay outside Python."""

    def __init__(self, most: int, most_bytes: int = MEMO_BYTES):
        self.most, self.most_bytes, self.strings = most, most_bytes, pa.array([], pa.large_string())

    def rows(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array, bool]:
        """The row of each of some distinct strings, the new ones among them (whose rows are the last), and whether all rows before have gone."""
        anew = len(self.strings) > self.most or self.strings.nbytes > self.most_bytes
        if anew:
            self.strings = self.strings[:0]
        at = pc.index_in(strings, value_set=self.strings)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        new = strings.filter(pa.array(missing))
        rows = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows[missing] = len(self.strings) + np.arange(len(new))
        self.strings = pa.concat_arrays([self.strings, new])
        return rows, new, anew


class Memo:
    """Bounded memo from a string to a run of numbers, kept in one flat array so that a batch is one gather.

    `fill(strings)` returns the numbers of new strings one after another, and how many each has. The memo starts anew
    beyond `most` strings or MEMO_BYTES of them, so its memory is bounded; no result depends on what it holds.
    """

    def __init__(self, fill, most: int, dtype=np.int32):
        self.fill, self.dtype, self.most = fill, dtype, most
        self.clear()

    def clear(self) -> None:
        self.known = Known(self.most)
        self.flat, self.ends, self.n = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), 0

    def lookup(self, strings: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of strings[codes] in order, and how many each has; `strings` are distinct."""
        rows, new, anew = self.known.rows(strings)
        if anew:
            self.flat, self.ends, self.n = np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), 0
        if len(new):
            values, counts = self.fill(new.to_pylist())
            ends = self.ends[self.n] + np.cumsum(counts)
            self.ends, self.flat = grown(self.ends, self.n + len(new) + 1), grown(self.flat, int(ends[-1]))
            self.flat[self.ends[self.n] : ends[-1]] = values
            self.ends[self.n + 1 : self.n + len(new) + 1] = ends
            self.n += len(new)
        index = rows[codes]
        starts, counts = self.ends[index], self.ends[index + 1] - self.ends[index]
        return self.flat[runs(starts, counts)], counts


def grown(values: np.ndarray, least: int) -> np.ndarray:
    """`values` with room for `least` entries."""
    return values if len(values) >= least else np.concatenate((values, np.zeros(max(least, len(values) * 5 // 4) - len(values), values.dtype)))


def split(texts: list[str], by: str = " ") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts of all texts, the number of each part in order, and how many parts each text has ('' has one)."""
    return coded(pc.split_pattern(pa.array(texts, pa.large_string()), by))


def coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    of = lists.flatten().dictionary_encode()
    return of.dictionary, of.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives memory that a task has freed back to the system: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_remembered: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """An operator keeps something in its workers between tasks, which `forget` drops."""
    _remembered[owner] = forget


def forget_others(owner: str = "") -> None:
    """Drops what other operators have left in this worker: workers go from stage to stage."""
    for name, forget in _remembered.items():
        if name != owner:
            forget()
    release()


def per_text(counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Sums of `counts` over consecutive runs of parts[0], parts[1], ... entries."""
    return np.diff(np.concatenate(([0], np.cumsum(counts)))[np.cumsum(np.concatenate(([0], parts))).astype(np.int64)])


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1 of every i, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()), dtype=np.int64)


def blocks(texts: pa.Array, most_chars: int = 4_000_000):
    """Lists of whole texts ('' for null) of about `most_chars` together; a longer text is a list by itself."""
    block, size = [], 0
    for text in texts:
        block.append(text.as_py() or "")
        size += len(block[-1])
        if size >= most_chars or len(block) >= 5_000:
            yield block
            block, size = [], 0
    if block:
        yield block


def binary_view(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls, one after another, and the place where each row's begin (and the end)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    if not len(a):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    offsets = np.frombuffer(a.buffers()[1], wide)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
