"""Retrieval of documents: hashed lexical vectors, top-k by cosine, re-ranking, tags and names.

Rows with a null key or text take no part in searches; empty texts have the zero vector and score 0. Repeated keys are
hits of their own. Ties go to the smaller key. Queries with fewer documents than k get all. Empty tables give empty
results. Other columns are not read. Query sets are worked off in blocks, every document is read once for each block.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.batches import BATCH_ROWS, bounded_batches
from gapweave.functions.text import coverage, label, name_tokens, rerank_tokens
from gapweave.functions.vector import hashed_bucket, hashed_sign, lexical_features
from gapweave.sources.scratch import materialise

#: Share of the vector score in a fused score; the rest is token coverage.
VECTOR_SHARE = 0.6
#: Dimensions of lexical vectors.
DIMS = 512
#: Queries of a block of a vector search and of a lexical search, about.
QUERY_BLOCK_ROWS, LEXICAL_BLOCK_ROWS = 10_000, 1_000
#: What an encoder remembers, features that it adds up at a time, and characters of documents that it encodes at a time, about.
MOST_WORDS, MOST_GRAMS, STEP_FEATURES, SLICE_CHARS = 100_000, 500_000, 4 << 20, 1 << 20
#: Queries by vectors of a task, about.
TASK_PAIRS = 1 << 27
#: Hits that re-ranking chooses from, as a multiple of those that stay.
POOL = 3


def lexical_vectors(texts: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """key, dim and value of the normalised sparse vector of every text."""
    each = texts.select(key, F.explode(lexical_features(F.col(text))).alias("f"))
    sums = each.groupBy(key, hashed_bucket(F.col("f.token"), dims).alias("dim")).agg(F.sum(F.col("f.weight") * hashed_sign(F.col("f.token"))).alias("raw_sum")).where("raw_sum <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("raw_sum") * F.col("raw_sum"))).alias("vector_norm"))
    return sums.join(norms, key).select(key, "dim", (F.col("raw_sum") / F.col("vector_norm")).alias("value"))


def lexical_encoder(dims: int = DIMS):
    """A function from texts to the rows of their lexical vectors, the ones of lexical_vectors(); it remembers grams and words.

    Grams are looked up as numbers made of their characters, all of a batch's distinct words at once; a word counts once for
    each text, with its number there.
    """
    import hashlib
    import re

    import numpy as np

    words: dict[str, int] = {}
    # Of bigrams and trigrams: sorted numbers and their codes.
    known = {n: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for n in (2, 3)}

    def code(token: str) -> int:
        """Twice the bucket, and 1 more if the sign is +."""
        digest = hashlib.md5(token.encode("utf-8", "replace")).digest()
        return int.from_bytes(digest[:4], "big") % dims * 2 + (digest[4] & 1)

    def codes_of(grams: np.ndarray, n: int) -> np.ndarray:
        keys, codes = known[n]
        at = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
        if len(keys) == 0 or (keys[at] != grams).any():
            new = np.unique(grams if len(keys) == 0 else grams[keys[at] != grams])
            own = np.array([code("".join(chr(g >> s & 0x1FFFFF) for s in range(21 * (n - 1), -1, -21))) for g in new.tolist()], np.int64)
            if len(keys) + len(new) > MOST_GRAMS:
                # All that this call asks for must be there.
                stay = np.isin(keys, grams)
                keys, codes = keys[stay], codes[stay]
            keys, codes = np.concatenate((keys, new)), np.concatenate((codes, own))
            by = np.argsort(keys, kind="stable")
            known[n] = keys, codes = keys[by], codes[by]
            at = np.searchsorted(keys, grams)
        return codes[at]

    def features(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Begins of each word's features, and their codes: the word's own first."""
        if len(words) + len(names) > MOST_WORDS:
            words.clear()
        own = np.fromiter((words.get(w) or words.setdefault(w, code(w) + 1) for w in names), np.int64, len(names)) - 1
        chars = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        begins = np.concatenate(([0], np.cumsum(np.maximum(2 * sizes - 2, 1))))
        out = np.empty(begins[-1], np.int64)
        out[begins[:-1]] = own
        word = np.repeat(np.arange(len(names)), sizes)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        two = np.flatnonzero(word[1:] == word[:-1])
        out[begins[word[two]] + 1 + place[two]] = codes_of(chars[two] << 21 | chars[two + 1], 2) if len(two) else 0
        three = np.flatnonzero(word[2:] == word[:-2])
        out[begins[word[three]] + sizes[word[three]] + place[three]] = codes_of(chars[three] << 42 | chars[three + 1] << 21 | chars[three + 2], 3) if len(three) else 0
        return begins, out

    def encode(texts: list[str]) -> np.ndarray:
        each = [[w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w] for t in texts]
        number: dict[str, int] = {}
        said = np.fromiter((number.setdefault(w, len(number)) for ws in each for w in ws), np.int64)
        if not number:
            return np.zeros((len(texts), dims))
        begins, codes = features(list(number))
        rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in each])
        pair, times = np.unique(rows * len(number) + said, return_counts=True)
        row, word = np.divmod(pair, len(number))
        out = np.zeros(len(texts) * dims)
        n = begins[word + 1] - begins[word]
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), STEP_FEATURES), "right").tolist()
        for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
            m = n[a:b]
            before = np.cumsum(m) - m
            index = np.repeat(begins[word[a:b]] - before, m) + np.arange(int(m.sum()))
            own = codes[index]
            weight = np.repeat(times[a:b], m) * ((own & 1) * 2 - 1)
            weight[before] *= 2
            out += np.bincount(np.repeat(row[a:b] * dims, m) + (own >> 1), weight, len(out))
        out = out.reshape(len(texts), dims)
        size = np.sqrt((out * out).sum(axis=1))[:, None]
        return np.divide(out, size, out=out, where=size > 0)

    return encode


def lexical_search(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, doc_key: str, doc_text: str, k: int, block_rows: int = LEXICAL_BLOCK_ROWS) -> DataFrame:
    """The k documents of largest cosine of lexical vectors for each query, with score and rank.

    A block's queries (their texts, block_rows of them) go to the tasks, which encode the documents and return k rows for
    each query and batch of documents.
    """
    q = queries.where(F.col(query_key).isNotNull() & F.col(query_text).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_text).alias("t"))
    d = docs.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).alias(doc_key), F.col(doc_text).alias("gw_text"))
    n = max(1, ceil(q.count() / block_rows))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("q")), F.lit(n))
    found = [top(lexical_block(q.where(block == b), query_key, d, doc_key, k), query_key, doc_key, k) for b in range(n)]
    return found[0] if n == 1 else reduce(DataFrame.unionAll, [materialise(x, "lexical-hits") for x in found])


def lexical_block(queries: DataFrame, query_key: str, docs: DataFrame, doc_key: str, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    rows = queries.toArrow()
    kinds = dict(queries.dtypes)["q"], dict(docs.dtypes)[doc_key]
    matrix = lexical_encoder()(rows.column("t").to_pylist())

    def slices(batch):
        """Runs of up to 200 documents and about SLICE_CHARS characters."""
        sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        a = 0
        while a < len(batch):
            b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a : a + 200]), SLICE_CHARS, "right")))
            yield batch.slice(a, b - a)
            a = b

    def run(batches):
        encode = lexical_encoder()
        held = Held(len(rows), k)
        for batch in batches:
            for part in slices(batch):
                part = part.take(pa.compute.sort_indices(part.column(0)))
                scores = np.rint(matrix @ encode(part.column(1).to_pylist()).T * 1e6) + 0.0
                # Larger scores first, then smaller keys, as one number.
                order = np.argsort(-(scores * len(part) - np.arange(len(part))), axis=1)[:, :k]
                row, col = np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
                held.add(row, part.column(0), col, scores[row, col])
        row, keys, scores = held.best()
        for a in range(0, len(row), BATCH_ROWS):
            b = a + BATCH_ROWS
            yield pa.RecordBatch.from_arrays([rows.column("q").combine_chunks().take(pa.array(row[a:b])), keys[a:b], pa.array(scores[a:b] / 1e6)], names=[query_key, doc_key, "score"])

    return bounded_batches(docs).mapInArrow(run, f"`{query_key}` {kinds[0]}, `{doc_key}` {kinds[1]}, score double")


class Held:
    """A task's best `k` keys so far of each of `n` queries, by score and then by smaller key."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.floor, self.parts, self.size, self.most = k, np.full(n, -np.inf), [], 0, max(10_000, 4 * n * k)

    def add(self, row, keys, col, score) -> None:
        """Rows (places of queries), places in an Arrow array of keys, and scores; what can't be among the best is dropped."""
        import numpy as np
        import pyarrow as pa

        stay = np.flatnonzero(score >= self.floor[row])
        if len(stay):
            self.parts.append((row[stay], keys.take(pa.array(col[stay])), score[stay]))
            self.size += len(stay)
        if self.size > self.most:
            self.best()

    def best(self):
        """Rows, keys and scores of the best, by row."""
        import numpy as np
        import pyarrow as pa

        if not self.parts:
            return np.zeros(0, np.int64), pa.nulls(0), np.zeros(0)
        row, score = (np.concatenate([p[j] for p in self.parts]) for j in (0, 2))
        keys = pa.concat_arrays([p[1] for p in self.parts])
        by = pa.compute.sort_indices(pa.table({"row": row, "score": score, "key": keys}), sort_keys=[("row", "ascending"), ("score", "descending"), ("key", "ascending")]).to_numpy()
        first = np.searchsorted(row[by], row[by])
        by = by[np.arange(len(by)) - first < self.k]
        row, score, keys = row[by], score[by], keys.take(pa.array(by))
        full = np.flatnonzero(np.bincount(row, minlength=len(self.floor)) >= self.k)
        self.floor[full] = score[np.searchsorted(row, full, "right") - 1]
        self.parts, self.size = [(row, keys, score)], len(row)
        return row, keys, score


def top(scores: DataFrame, query_key: str, doc_key: str, k: int) -> DataFrame:
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """Exact top-k by cosine of all query vectors over all vectors, in blocks of about `block_rows` queries.

    A block's queries go to the tasks, which scan the vectors and return k rows for each query and batch of vectors. A
    query's own id is no hit. Zero vectors and vectors of another length than the query's have cosine 0; rows with a null
    id or vector take no part.
    """
    fine = lambda rows: rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q, v = fine(queries), fine(vectors)
    asked = q.count()
    tasks = ceil(asked * v.count() / TASK_PAIRS)
    if tasks > 1:
        # The work is that of pairs, for which the files of vectors are too few tasks.
        v = materialise(v.repartition(max(tasks // ceil(asked / block_rows), v.sparkSession.sparkContext.defaultParallelism)), "vectors")
    n = ceil(asked / block_rows)
    if n <= 1:
        return top(block_hits(q, v, key, k), "query_id", key, k)
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("id")), F.lit(n))
    found = [materialise(top(block_hits(q.where(block == b), v, key, k), "query_id", key, k), "vector-hits") for b in range(n)]
    return reduce(DataFrame.unionAll, found)


def block_hits(queries: DataFrame, vectors: DataFrame, key: str, k: int) -> DataFrame:
    """query_id, key and score of the best k of every batch of vectors for a block of queries; both have id and v."""
    import numpy as np
    import pyarrow as pa

    def units(table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The ids, and for each length the places and unit vectors of its rows; zero for zero vectors."""
        v = table.column("v")
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        starts, out = np.cumsum(sizes) - sizes, {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = np.nan_to_num(flat[starts[at][:, None] + np.arange(size)], posinf=0, neginf=0)
            norm = np.sqrt((x * x).sum(axis=1))[:, None]
            out[int(size)] = at, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return table.column("id").to_numpy(), out

    ids, by_size = units(queries.toArrow())

    def run(batches):
        held = Held(len(ids), k)
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.column("id")))
            own, own_by_size = units(batch)
            n = len(own)
            for b in range(0, len(ids) if n else 0, 512):
                scores = np.zeros((min(512, len(ids) - b), n))
                for size, (at, q) in by_size.items():
                    mine = (at >= b) & (at < b + 512)
                    if size in own_by_size and mine.any():
                        there, found = own_by_size[size][0], q[mine] @ own_by_size[size][1].T
                        if found.shape == scores.shape:
                            scores = found
                        else:
                            scores[np.ix_(at[mine] - b, there)] = found
                # What rounds to less than the k-th best so far is passed over.
                row, col = np.nonzero(scores >= ((held.floor[b : b + 512] - 0.5) / 1e6 - 1e-9)[:, None])
                if len(row) > 4 * k * len(scores):
                    rounded = np.rint(scores * 1e6)
                    # Larger scores first, then smaller ids, as one number.
                    order = rounded * n - np.arange(n)
                    order[ids[b : b + 512, None] == own] = -np.inf
                    best = np.argpartition(-order, min(k, n) - 1, axis=1)[:, :k]
                    row, col = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
                keep = ids[b + row] != own[col]
                row, col = row[keep], col[keep]
                held.add(b + row, batch.column("id"), col, np.rint(scores[row, col] * 1e6) + 0.0)
        row, keys, scores = held.best()
        for a in range(0, len(row), BATCH_ROWS):
            b = a + BATCH_ROWS
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[a:b]]), keys[a:b], pa.array(scores[a:b] / 1e6)], names=["query_id", key, "score"])

    return bounded_batches(vectors).mapInArrow(run, f"query_id long, `{key}` long, score double")


def reranked(hits: DataFrame, query_text: str, doc_text: str, query_key: str, doc_key: str, k: int) -> DataFrame:
    """Hits in the order of vector score and token coverage together."""
    lexical = coverage(rerank_tokens(F.col(query_text)), rerank_tokens(F.col(doc_text)))
    fused = hits.withColumn("lexical", F.round(lexical, 6)).withColumn("fused", F.round(VECTOR_SHARE * F.col("score") + (1 - VECTOR_SHARE) * lexical, 6))
    best = Window.partitionBy(query_key).orderBy(F.desc("fused"), F.desc("score"), doc_key)
    return fused.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(query_key, doc_key, "score", "lexical", "fused", "place")


def tags(text: Column, names: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """The names that are part of the text, or of which an alias is, as substrings in any case; names first, then those by alias."""
    low = F.lower(text)
    quoted = lambda words: "|".join(f"\\Q{w.lower()}\\E" for w in words)
    by_name = [F.when(low.rlike(quoted([n])), F.lit(n)) for n in names]
    of = {n: [a for a, t in aliases.items() if t == n] for n in dict.fromkeys(aliases.values())}
    by_alias = [F.when(low.rlike(quoted(words)), F.lit(n)) for n, words in of.items()]
    return F.array_distinct(F.filter(F.array(*by_name, *by_alias), lambda x: x.isNotNull()))


def resolved(keys: DataFrame, items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """key and the item that it names, by tier: 1 id, 2 equal name, 3 equal alias, 4 one name within the other, 5 share of
    tokens that the item's names have (at least `threshold`; then the shorter name). Null without any; ties go to the name
    and item_id that sort first. Items have item_id, name and perhaps aliases (a list).

    Only pairs that may match are compared: equal ids or names, a first three characters that the other name has too, or a
    shared token; each of these is an equi-join.
    """
    k = keys.select("key").distinct().withColumns({"k": label(F.col("key")), "kt": name_tokens(F.col("key"))}).where("k <> ''")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in items.columns else F.array().cast("array<string>")
    i = items.select("item_id", "name", F.transform(aliases, label).alias("as"), F.array_distinct(F.flatten(F.concat(F.array(name_tokens(F.col("name"))), F.transform(aliases, name_tokens)))).alias("nt")).withColumn("n", label(F.col("name")))
    def runs(x: Column, n: int) -> Column:
        """Every n characters of a text, or all of a shorter one."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x) - n + 1, F.lit(1))), lambda at: F.substring(x, at, n))

    # A name is looked for by its first three characters, or by all of a shorter one.
    whole = lambda x: F.array_distinct(F.concat(runs(x, 1), runs(x, 2), runs(x, 3)))
    start = lambda x: F.substring(x, 1, 3)

    def meet(left: Column, right: Column) -> DataFrame:
        return k.select("key", left.alias("on")).join(i.select("item_id", "name", right.alias("on")), "on").select("key", "item_id", "name")

    either = [
        meet(F.trim("key"), F.col("item_id").cast("string")),
        meet(F.col("k"), F.col("n")),
        meet(F.col("k"), F.explode("as")),
        meet(start(F.col("k")), F.explode(whole(F.col("n")))),
        meet(F.explode(whole(F.col("k"))), start(F.col("n"))),
        meet(F.explode("kt"), F.explode("nt")),
    ]
    pairs = reduce(DataFrame.unionAll, either).distinct().join(k, "key").join(i, ["item_id", "name"])
    share = coverage(F.col("kt"), F.col("nt"))
    inside = F.contains("n", "k") | F.contains("k", "n")
    tier = F.when(F.trim("key") == F.col("item_id"), 1).when(F.col("k") == F.col("n"), 2).when(F.array_contains("as", F.col("k")), 3).when(inside, 4).when(share >= threshold, 5)
    pairs = pairs.withColumns({"tier": tier, "share": F.when(tier == 5, share).otherwise(1.0)}).where("tier IS NOT NULL")
    shorter = F.when(F.col("tier") == 5, F.char_length("name")).otherwise(0)
    best = pairs.groupBy("key").agg(F.min_by(F.struct("item_id", "tier"), F.struct("tier", -F.col("share"), shorter, "name", "item_id")).alias("b"))
    return keys.select("key").distinct().join(best, "key", "left").select("key", "b.item_id", "b.tier")
