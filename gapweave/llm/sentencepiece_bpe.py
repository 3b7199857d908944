"""SentencePiece encoding and decoding of merge-type models.

Encoding takes no merge queue over the text. A pass of an Aho-Corasick automaton lists the pieces that start at each
character; backtracking takes the longest one that may stand beside the piece before it, and a bitfield marks the
characters from which the rest can't be encoded. Two pieces may stand side by side if merging their joint text anew
gives just these two. A sequence of which all neighbours may is the model's only encoding, so the result is exact.

No piece of such a model runs from a character into a following word mark, and characters outside the model never merge,
so texts fall apart into chunks that are encoded once and remembered for a while.

Null and empty texts have no ids and decode to ''. Texts of any length are encoded whole. Repeated rows get equal
results; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm.common import Memo, blocks, bounded_batches, forget_others, list_array, per_text, release, remembers, runs, split

MARK = "▁"
#: Chunks are found in passes over about so many characters; a longer chunk is backtracked right away.
PASS_CHARS = 150_000
#: Texts up to this length are kept in plain lists and searched without cutting windows.
SHORT_CHARS = 256


class Codec:
    """The pieces of one merge-type model file, with encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is no plain merge-type model with byte fallback")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_id = [0] * 256
        self.bytes_of = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.NORMAL:
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == kind.UNKNOWN:
                self.bytes_of[i] = model.trainer_spec.unk_surface.encode()
        if any(a != MARK and b == MARK for p in self.score for a, b in zip(p, p[1:])):
            raise ValueError(f"{path} has pieces that run into a following word")
        self.known = {p for p in self.score if len(p) == 1}
        # A piece that merging its own text doesn't give is never a result.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.text_of = {i: p for p, i in self.id.items()}
        self.longest_piece = max(map(len, self.id), default=1)
        self.fits: dict[int, bool] = {}  # by both numbers as one
        self.size = len(model.pieces)
        # Between two characters that no piece holds side by side nothing merges: such marks are cut off words.
        beside = {c for p in self.score for a, b in zip(p, p[1:]) if a.isalpha() != b.isalpha() for c in (a, b) if not c.isalpha()}
        apart = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in beside) + "\n" * ("\n" not in beside)
        letters = "".join(c for c in self.known if c.isalpha())
        self.cut = re.compile(f"(?<=[{letters}])(?=[{re.escape(apart)}])|(?<=[{re.escape(apart)}])(?=[{letters}])").split
        # For each piece the longest shorter one that it begins with.
        self.shorter = {i: next(((k, self.id[p[:k]]) for k in range(len(p) - 1, 0, -1) if self.automaton.exists(p[:k])), None) for p, i in self.id.items()}
        split = "\n" if "\n" not in "".join(self.known) else ""
        self.chunks = re.compile(f"{MARK}+[^{MARK}{split}]*|[^{MARK}{split}]+" + "|\n+" * bool(split)).findall
        self.memo = Memo(lambda new: self.encode_many([MARK + x for x in new]), most=250_000)
        self.pieces = pa.array(self.bytes_of, pa.binary())
        self.numbers = pa.array([str(i).encode() for i in range(len(self.bytes_of))], pa.binary())

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters of a short text gives: best score first, then leftmost."""
        parts, get, none = list(text), self.score.get, -math.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            # Only the pairs beside it have changed.
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def fit(self, a: int, b: int) -> bool:
        got = self.fits.get(a * self.size + b)
        if got is None:
            if len(self.fits) > 150_000:
                self.fits.clear()
            x, y = self.text_of[a], self.text_of[b]
            got = self.fits[a * self.size + b] = self.merged(x + y) == [x, y]
        return got

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all chunks, and how many each chunk has.

        The longest pieces of all chunks are found in one pass; chunks in which some neighbours don't fit are backtracked.
        """
        cut = [self.cut(c) for c in chunks]
        number = {p: k for k, p in enumerate(dict.fromkeys(p for ps in cut for p in ps))}
        parts = list(number)
        joined = "\0".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        found = list(self.automaton.iter_long(joined))
        ids = np.fromiter((p[1] for _, p in found), np.int64, len(found))
        owner = np.searchsorted(ends, np.fromiter((e for e, _ in found), np.int64, len(found)), "right")
        bad = np.zeros(len(parts), bool)
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(ids[beside] * len(self.bytes_of) + ids[beside + 1], return_inverse=True)
        pairs = pairs.tolist()
        fine = list(map(self.fits.get, pairs))
        for k, known in enumerate(fine):
            if known is None:
                fine[k] = self.fit(*divmod(pairs[k], self.size))
        bad[owner[beside[~np.array(fine, bool)[back]]]] = True
        if outside := set(joined) - self.known:
            bad |= np.fromiter((not outside.isdisjoint(p) for p in parts), bool, len(parts))
        again = [self.with_bytes(parts[k]) for k in np.flatnonzero(bad).tolist()]
        counts = np.bincount(owner, minlength=len(parts))
        starts = np.cumsum(counts) - counts
        counts[bad] = list(map(len, again))
        starts[bad] = len(ids) + np.cumsum(counts[bad]) - counts[bad]
        ids = np.concatenate((ids, np.fromiter((x for a in again for x in a), np.int64)))
        used = np.fromiter((number[p] for ps in cut for p in ps), np.int64)
        return ids[runs(starts[used], counts[used])].astype(np.int32), per_text(counts[used], np.fromiter(map(len, cut), np.int64, len(cut)))

    def encode_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_chunks(), in turns of a bounded number of characters."""
        parts, turn, size = [], [], 0
        for chunk in chunks:
            if len(chunk) > PASS_CHARS:
                if turn:
                    parts.append(self.encode_chunks(turn))
                    turn, size = [], 0
                ids = np.concatenate([np.array(self.with_bytes(x), np.int32) for x in self.cut(chunk) if x])
                parts.append((ids, np.array([len(ids)], np.int64)))
                continue
            turn.append(chunk)
            size += len(chunk) + 1
            if size >= PASS_CHARS:
                parts.append(self.encode_chunks(turn))
                turn, size = [], 0
        if turn:
            parts.append(self.encode_chunks(turn))
        return (np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def with_bytes(self, chunk: str) -> list[int] | array:
        """The ids of a text, of which characters outside the model become bytes."""
        if self.known.issuperset(chunk):
            return self.backtrack(chunk)
        out, known, start = array("i"), self.known, 0
        for k, c in enumerate(chunk):
            if c not in known:
                if start < k:
                    out.extend(self.backtrack(chunk[start:k]))
                out.extend(self.byte_id[b] for b in c.encode("utf-8", "replace"))
                start = k + 1
        if start < len(chunk):
            out.extend(self.backtrack(chunk[start:]))
        return out

    def backtrack(self, text: str) -> list[int] | array:
        """The ids of a text of known characters; time and memory grow in proportion to its length."""
        if len(text) <= SHORT_CHARS:
            return self.backtrack_short(text)
        n, size, longest, window, fits, shorter = len(text), self.size, self.automaton.iter_long, self.longest_piece, self.fits, self.shorter
        ids, froms = array("i"), array("q")  # the taken pieces and where they start
        failed = bytearray(n // 8 + 1)  # bit k: nothing from character k on works
        pos, before = 0, -1
        _, choice = next(longest(text[:window]))
        while True:
            while choice:
                length, i = choice
                end = pos + length
                if not failed[end >> 3] >> (end & 7) & 1 and (before < 0 or fits.get(before * size + i) or self.fit(before, i)):
                    break
                choice = shorter[i]
            if choice:
                ids.append(i)
                froms.append(pos)
                pos = end
                if pos == n:
                    return ids
                before = i
                _, choice = next(longest(text[pos : pos + window]))
            else:
                if not ids:
                    raise ValueError("the model can't encode this text")
                failed[pos >> 3] |= 1 << (pos & 7)
                choice = shorter[ids.pop()]
                pos = froms.pop()
                before = ids[-1] if ids else -1

    def backtrack_short(self, text: str) -> list[int]:
        """As backtrack(), with plain lists, a byte for each character and without a second look at pairs that don't fit."""
        n, size, longest, known, fit, shorter = len(text), self.size, self.automaton.iter_long, self.fits.get, self.fit, self.shorter
        ids, froms, failed = [], [], bytearray(n + 1)
        pos, before = 0, -1
        _, choice = next(longest(text))
        while True:
            row = before * size
            while choice:
                length, i = choice
                if not failed[pos + length]:
                    if before < 0 or (fits := known(row + i)):
                        break
                    if fits is None and fit(before, i):
                        break
                choice = shorter[i]
            if choice:
                ids.append(i)
                froms.append(pos)
                pos += length
                if pos == n:
                    return ids
                before = i
                _, choice = next(longest(text, pos))
            else:
                if not ids:
                    raise ValueError("the model can't encode this text")
                failed[pos] = 1
                choice = shorter[ids.pop()]
                pos = froms.pop()
                before = ids[-1] if ids else -1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has.

        Where no two blanks meet, each part between blanks is a chunk with one mark in front.
        """
        odd = [not t or t.startswith(" ") or "  " in t or MARK in t for t in texts]
        parts, codes, per = split([t for t, o in zip(texts, odd) if not o])
        ids, counts = self.memo.lookup(parts, codes)
        counts = per_text(counts, per)
        if not any(odd):
            return ids, counts
        runs_of = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        out = []
        for t, o in zip(texts, odd):
            out.append(next(runs_of) if not o else self.encode_many(self.chunks(MARK + t.replace(" ", MARK)))[0] if t else ids[:0])
        return np.concatenate(out) if out else ids, np.array([len(x) for x in out], dtype=np.int64)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: piece after piece, without the mark that encoding puts in front; '' for null."""
        out = []
        for x in joined(ids, self.pieces, b""):
            raw = x.as_py()
            text = raw.decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return pa.array(out, pa.string())


def joined(ids: pa.ListArray, names: pa.Array, by: bytes) -> pa.Array:
    """The names of each list of ids as one binary value."""
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), names.take(ids.flatten()).cast(pa.large_binary()))
    return pc.binary_join(lists, pa.scalar(by, pa.large_binary()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


remembers("sentencepiece", codec.cache_clear)


def encode(text: Column, model: str) -> Column:
    """The ids of a text as array<int>, without begin or end ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def sentencepiece_encode(texts: pa.Array) -> pa.Array:
        parts = [list_array(*codec(model).encode(block)) for block in blocks(texts, 2_000_000)]
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return sentencepiece_encode(text)


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids."""

    @F.arrow_udf(T.StringType())
    def sentencepiece_decode(lists: pa.Array) -> pa.Array:
        parts = [codec(model).decode(lists.slice(k, 500)) for k in range(0, len(lists), 500)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return sentencepiece_decode(ids)


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every document.

    Texts are encoded and decoded block by block in one task, so that ids need not leave it.
    """

    def run(batches):
        forget_others("sentencepiece")
        c = codec(model)
        for batch in batches:
            done = 0
            for block in blocks(batch.column(1), 500_000):
                gc.disable()  # a block's many small tuples make no cycles; release() collects after each batch
                try:
                    ids, counts = c.encode(block)
                finally:
                    gc.enable()
                lists = list_array(ids, counts)
                of_ids = [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in joined(lists, c.numbers, b",")]
                of_text = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in c.decode(lists)]
                yield pa.record_batch([batch.column(0).slice(done, len(block)), pa.array(counts), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(block)
            release()
        c.memo.clear()
        release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
