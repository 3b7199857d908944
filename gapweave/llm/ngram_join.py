"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts are sets of runs of five words (a text of one to four words is one run). Documents of equal sets form a class, and
from there on one class stands for all its copies; classes are told apart by 128-bit digests. MinHash values in bands
bring classes together, and a pair is a candidate if its MinHash values, compared sixteen at a time, leave a posterior
probability (uniform prior) of at least TOLERANCE that its similarity reaches the threshold. A pair at the threshold
shares no band with probability 2e-4, one of similarity 0.9 with 8e-8.

Candidates first only decide what has to be verified together: every class of a band value is compared with the value's
first class; where that leaves a band value with several unconnected classes, all pairs of it are compared. The connected
parts of these pruned candidates (not of the bands themselves, which chance would chain) are groups, within which every
pair is compared once more and, if it stays, verified by exact set sizes.

Pairs never become rows. A large group or band value is cut in blocks, every pair of blocks is a task of its own, pairs
are compared in slices of one block's length, and what leaves a task is one row for each class: how many documents it is
linked to, and a spanning forest of the links.

Result: one row for each document, with class_id (smallest doc_id of all documents that links connect) and n_links (other
documents whose similarity reaches the threshold, copies included). Texts without words link to nothing. Rows of equal
doc_id are documents of their own. Null doc_ids are larger than all others. An empty table gives no rows. Other columns,
whatever their names, are not read by join() and come through keep_first() untouched.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import SHINGLE_WORDS, SIMILARITY, Memo, binary_view, blocks, bounded_batches, forget_others, fresh, materialise, release
from gapweave.llm.features import split_words

VALUES, BANDS, STEP, TOLERANCE = 64, 16, 16, 1e-6
#: Classes and shingles of a block, and of candidate groups that share a task.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Ids are broadcast up to so many bytes, at ID_BYTES each.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 32
WORD = regex.compile(r"[\p{L}\p{N}]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes() -> Memo:
    def hashes(new: list[str]) -> tuple[np.ndarray, list[int]]:
        each = [WORD.findall(t.lower()) for t in new]
        return np.array([xxhash.xxh3_64_intdigest(w) for words in each for w in words], np.uint64), list(map(len, each))

    return Memo(hashes, most=200_000, dtype=np.uint64)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], m: Memo, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's runs of words."""
    tokens, codes, per = split_words(texts)
    hashes, counts = m.lookup(tokens, codes)
    ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per))).astype(np.int64)]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        w = hashes[a:b]
        n = min(size, len(w))
        if n == 0:
            out.append(w)
            continue
        k = len(w) - n + 1
        run = np.full(k, n, np.uint64)
        for j in range(n):
            run = mixed(run + w[j : j + k])
        out.append(np.unique(run))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of VALUES hash functions."""
    a, b = permutations()
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 2048):
        part = ((shingles[k : k + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, print (null for texts without words), n (shingles) and signature of every document."""

    def run(batches):
        forget_others("ngram_join")
        memo = word_hashes()
        for batch in batches:
            prints, sizes, signatures = [], [], []
            for block in blocks(batch.column(1), 1_000_000):
                for s in shingle_sets(block, memo):
                    prints.append(fingerprint(s) if len(s) else None)
                    sizes.append(len(s))
                    signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names=["doc_id", "print", "n", "signature"])
        release()

    return bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, print binary, n int, signature binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and group (smallest node connected with it) of every node of edges a, b.

    Each round hangs every node below its smallest neighbour, takes what hangs below one node together and keeps the
    edges between different ones, until none is left. Rounds are written to the shared folder; usual groups need two.
    """

    def kept(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")

    edges, labels = kept(edges), edges.sparkSession.createDataFrame([], "node binary, group binary")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        above = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up")), f"{name}-above")
        top = materialise(above.join(above.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), f"{name}-top")
        of_a, of_b = (top.select(F.col("node").alias(x), F.col("top").alias(f"top_{x}")) for x in "ab")
        edges = kept(edges.join(of_a, "a").join(of_b, "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))
        moved = labels.join(top.select(F.col("node").alias("group"), "top"), "group", "left").select("node", F.coalesce("top", "group").alias("group"))
        new = top.join(labels, "node", "left_anti").select("node", F.col("top").alias("group"))
        labels = materialise(moved.unionAll(new), f"{name}-labels")
    return labels


@lru_cache(maxsize=8)
def least_matches(threshold: float) -> list[int]:
    """For 16, 32, ... compared values: the fewest equal ones with which a pair stays."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            # P(similarity >= threshold | m of n equal) of a Beta(m + 1, n - m + 1) posterior
            if sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) >= TOLERANCE:
                out.append(m)
                break
    return out


def slices(group: np.ndarray, part: np.ndarray, whole: np.ndarray):
    """All pairs of rows to be compared, as arrays of row numbers no longer than the rows.

    Rows are sorted by group and part. Of a `whole` group all pairs are made, of others those of part 0 with part 1.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    left = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(first, size))
    i = np.flatnonzero(whole)
    step = 1
    while len(i := i[left[i] > step]):
        yield i, i + step
        step += 1
    for a, n in zip(first[~whole[first]].tolist(), size[~whole[first]].tolist(), strict=True):
        ones, others = a + np.flatnonzero(part[a : a + n] == 0), a + np.flatnonzero(part[a : a + n] == 1)
        for shift in range(len(others) if len(ones) else 0):
            for k in range(0, len(ones), len(others)):
                mine = ones[k : k + len(others)]
                yield mine, others[(np.arange(len(mine)) + shift) % len(others)]


def pruned(i: np.ndarray, j: np.ndarray, signatures_i: np.ndarray, signatures_j: np.ndarray, n_i: np.ndarray, n_j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of row i of one side and row j of another that may reach the threshold by their sizes and MinHash values."""
    fits = np.minimum(n_i[i], n_j[j]) >= threshold * np.maximum(n_i[i], n_j[j]) - 1e-9
    i, j = i[fits], j[fits]
    matches = np.zeros(len(i), np.int64)
    for step, least in enumerate(least_matches(threshold)):
        at = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (signatures_i[i, at] == signatures_j[j, at]).sum(axis=1)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the pairs of sets reach the threshold by exact set sizes."""
    n = np.array([len(x) for x in sets])
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        often = times[code] > 1  # what one set alone holds is shared by no pair
        code, owner = np.unique(code[often], return_inverse=True)[1], owner[often]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        width = int(code[-1]) + 1 if len(code) else 0
        for first in range(0, width, 2048):
            a, b = np.searchsorted(code, (first, first + 2048))
            m = np.zeros((len(sets), min(2048, width - first)), np.float32)
            m[owner[a:b], code[a:b] - first] = 1
            total += m @ m.T
        shared = total[i, j].astype(np.int64)
    return shared / np.maximum(n[i] + n[j] - shared, 1) >= threshold


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that links connect with each of n rows."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def candidates(groups: DataFrame, threshold: float) -> DataFrame:
    """a and b: candidates that connect what the candidates of the tasks' classes connect (nodes of one `own` are connected already).

    Columns of `groups`: task, cluster, part, single, node, own, n, signature.
    """

    def run(t: pa.Table) -> pa.Table:
        group, part, single, own, n = (t[c].to_numpy() for c in ("cluster", "part", "single", "own", "n"))
        order = np.lexsort((part, group))
        signatures = binary_view(t["signature"], np.uint32)[0].reshape(-1, VALUES)[order]
        group, part, single, own, n = group[order], part[order], single[order], own[order], n[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in slices(group, part, single):
            apart = own[i] != own[j]
            found.append(pruned(i[apart], j[apart], signatures, signatures, n, n, threshold))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        root = forest(i, j, len(order))
        new = np.flatnonzero(root != np.arange(len(order)))
        node = t["node"].combine_chunks().take(pa.array(order))
        return pa.table({"a": node.take(pa.array(root[new])), "b": node.take(pa.array(new))})

    return groups.groupBy("task").applyInArrow(run, "a binary, b binary")


def linked(groups: DataFrame, threshold: float) -> DataFrame:
    """node, n_links (documents of linked classes) and root (a connected node) from the tasks' classes.

    Columns of `groups`: task, cluster, part (block within the task: 0, or 1 for the second), single (one block against
    itself), node, docs, signature, shingles.
    """

    def run(t: pa.Table) -> pa.Table:
        group, part, single, docs = (t[c].to_numpy() for c in ("cluster", "part", "single", "docs"))
        order = np.lexsort((part, group))
        signatures = binary_view(t["signature"], np.uint32)[0].reshape(-1, VALUES)[order]
        group, part, single, docs = group[order], part[order], single[order], docs[order]
        shingles, at = binary_view(t["shingles"], np.uint64)
        sets = [shingles[at[k] : at[k + 1]] for k in order.tolist()]
        n = np.diff(at)[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in slices(group, part, single):
            found.append(pruned(i, j, signatures, signatures, n, n, threshold))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        by_group = np.argsort(group[i], kind="stable")
        i, j = i[by_group], j[by_group]
        good = []
        for mine in np.split(np.arange(len(i)), np.flatnonzero(np.diff(group[i])) + 1) if len(i) else []:
            rows, places = np.unique(np.concatenate((i[mine], j[mine])), return_inverse=True)
            x, y = places[: len(mine)], places[len(mine) :]
            good.append(verified(x, y, [sets[k] for k in rows.tolist()], threshold))
        keep = np.concatenate(good) if good else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        links = np.bincount(i, docs[j], len(order)) + np.bincount(j, docs[i], len(order))
        node = t["node"].combine_chunks().take(pa.array(order))
        return pa.table({"node": node, "n_links": links.astype(np.int64), "root": node.take(pa.array(forest(i, j, len(order))))})

    return groups.groupBy("task").applyInArrow(run, "node binary, n_links long, root binary")


def band_values(classes: DataFrame) -> DataFrame:
    """node and each of its BANDS band values."""

    def run(batches):
        width = VALUES // BANDS
        for batch in batches:
            signatures = binary_view(batch.column(1), np.uint32)[0].reshape(-1, BANDS, width)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), signatures.shape[:2]).copy()
            for k in range(width):
                h = mixed(h + signatures[:, :, k])
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))
            yield pa.record_batch([node, pa.array(h.ravel().view(np.int64))], names=["node", "band"])

    return classes.select("node", "signature").mapInArrow(run, "node binary, band long")


def starred(stars: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The candidates among pairs a, b of classes."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}"))

    def run(batches):
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            a, b = (binary_view(batch.column(f"signature_{x}"), np.uint32)[0].reshape(-1, VALUES) for x in "ab")
            all_rows = np.arange(len(batch))
            keep = pa.array(pruned(all_rows, all_rows, a, b, n_a, n_b, threshold)[0])
            yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return stars.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a binary, b binary")


def candidate_groups(classes: DataFrame, threshold: float) -> DataFrame:
    """node and group of every class that has a candidate."""
    bands = band_values(classes)
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    members = materialise(bands.join(shared, "band"), "band-members")
    first = members.groupBy("band").agg(F.min("node").alias("a"))
    stars = members.withColumnRenamed("node", "b").join(first, "band").where("a <> b").select("a", "b").distinct()
    near = materialise(starred(stars, classes, threshold), "candidates")
    found = components(near, "candidates")
    placed = members.join(found, "node", "left").select("band", "node", F.coalesce("group", "node").alias("group"))
    open_bands = placed.groupBy("band").agg((F.min("group") < F.max("group")).alias("open")).where("open").select("band")
    rest = placed.join(open_bands, "band").join(classes.select("node", "n", "signature"), "node")
    # A row's signature takes as much as 32 shingles.
    rest = materialise(rest.select(F.col("band").alias("group"), F.lit(32).alias("weight"), "node", F.xxhash64("group").alias("own"), "n", "signature"), "open-bands")
    more = materialise(candidates(tasks(rest), threshold), "more-candidates")
    return components(near.unionAll(more), "all-candidates") if not more.isEmpty() else found


def join(docs: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    each = materialise(described(docs, "doc_id", "text"), "signatures")
    classes = each.where("print IS NOT NULL").groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("docs"), F.max("n").alias("n"), F.max("signature").alias("signature"))
    classes = materialise(classes, "classes")
    members = materialise(candidate_groups(classes, threshold).join(classes, "node"), "members")
    n = members.count()
    if n == 0:
        links = spark.createDataFrame([], "node binary, n_links long, root binary")
    else:
        wanted = members.select(F.col("first_id").alias("wanted_id")).distinct()
        wanted = F.broadcast(wanted) if n * ID_BYTES <= BROADCAST_BYTES else wanted
        texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        sets = shingled(texts).dropDuplicates(["node"])
        full = materialise(members.join(sets, "node").select("group", F.col("n").alias("weight"), "node", "docs", "signature", "shingles"), "candidate-shingles")
        links = materialise(linked(tasks(full), threshold), "links")
    counted = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    merged = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    named = classes.join(merged, "node", "left").join(counted, "node", "left").select("node", "first_id", "docs", F.coalesce("group", "node").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialise(named, "named-classes")
    ids = named.groupBy("group").agg(F.min("first_id").alias("class_id"))
    of_print = named.join(ids, "group").select(F.col("node").alias("print"), "class_id", (F.col("n_links") + F.col("docs") - 1).alias("n_links"))
    own = each.select("doc_id", "print")
    found = own.where("print IS NOT NULL").join(of_print, "print").select("doc_id", "class_id", "n_links")
    return found.unionAll(own.where("print IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def shingled(texts: DataFrame) -> DataFrame:
    """node and shingles of texts."""

    def run(batches):
        memo = word_hashes()
        for batch in batches:
            for block in blocks(batch.column(0), 1_000_000):
                sets = [s for s in shingle_sets(block, memo) if len(s)]
                yield pa.record_batch([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
        release()

    return texts.select("text").mapInArrow(run, "node binary, shingles binary")


def tasks(members: DataFrame) -> DataFrame:
    """Members of groups dealt out to tasks: small groups together, pairs of blocks of large ones alone.

    Columns of `members`: group, weight (about how many shingles a row is worth), node and others, which stay. A block has
    about BLOCK members and BLOCK_SHINGLES shingles.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") / BLOCK_SHINGLES)).cast("int")
    large = materialise(members.groupBy("group").agg(parts.alias("parts")).where("parts > 1"), "large-groups")
    whole = members.agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")).first()
    shared = max(1, ceil(whole["rows"] / BLOCK), ceil((whole["weight"] or 0) / BLOCK_SHINGLES))
    placed = members.drop("weight").join(F.broadcast(large) if large.count() * ID_BYTES <= BROADCAST_BYTES else large, "group", "left")
    row, last = F.pmod(F.xxhash64("node", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int"), F.coalesce("parts", F.lit(1)) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(row, k).alias("i"), F.greatest(row, k).alias("j")))
    small = F.concat_ws(":", F.lit("small"), F.pmod(F.xxhash64("group", F.lit(2)), F.lit(shared)))
    return placed.withColumn("pair", F.explode(pairs)).select(
        F.when(F.col("parts").isNull(), small).otherwise(F.concat_ws(":", F.xxhash64("group"), F.xxhash64("group", F.lit(3)), F.col("pair.i"), F.col("pair.j"))).alias("task"),
        F.xxhash64("group").alias("cluster"),
        F.when(row == F.col("pair.i"), 0).otherwise(1).alias("part"),
        (F.col("pair.i") == F.col("pair.j")).alias("single"),
        *[c for c in members.columns if c not in ("group", "weight")],
    )


def keep_first(docs: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their class, with all columns. Rows of equal doc_id stay or go together."""
    later = fresh(docs, "gw_id")
    rest = materialise(join(docs, threshold, doc_id, text).where("NOT doc_id <=> class_id").select(F.col("doc_id").alias(later)).distinct(), "later-copies")
    if rest.count() * ID_BYTES <= BROADCAST_BYTES:
        rest = F.broadcast(rest)
    return docs.join(rest, docs[doc_id].cast("long").eqNullSafe(rest[later]), "left_anti")
