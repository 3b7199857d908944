"""Toxicity by a convolutional text classifier.

A word's embedding is the scaled sum of hashed embeddings of the word and of its character 3- to 5-grams. Filters of
widths 1, 2 and 3 run over the words, rectified and max-pooled over the whole text, and a logistic unit joins them. All
of it is trained in numpy. Texts are assigned to a language group by naive Bayes on the same hashed features (language
labels teach that, but are no input), and each group has a threshold of its own; scores are shifted in log-odds so that
every group's threshold becomes CUT. Thresholds come from all labelled rows, with texts of any length: tasks score them
and count log-odds by group and label in bins of BIN, and the threshold of best F1 is chosen from these counts. Rows that
the model was trained on count with log-odds from models that have not seen them (FOLDS of them). A group's threshold is
drawn towards the best one of all groups together as if SHRINK of its toxic rows voted for that, so that a group with few
toxic rows (or without rows of both kinds) stays near it.

Since filters are linear before pooling, a word's contributions to all filters are worked out once for each distinct
word of a batch, and scoring a text is a few additions and one maximum for each word.

The weights are trained on at most about `sample_rows` labelled rows, half of them toxic if there are as many, with texts
of up to `sample_chars` characters, chosen by a hash of the id. Scoring takes whole texts of any length. Null and empty
texts have no words and get the score of an empty pool. Rows with a null label teach nothing; without labels of both
kinds all scores are 0. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import blocks, bounded_batches, forget_others, fresh, materialise, release, runs
from gapweave.llm.features import TableMemo, bounded, ngrams, share_of, split_words, summed

#: Scores from here on are toxic.
CUT = 0.7
#: Keys of labelled documents are broadcast up to so many bytes, at so many for each.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 64
#: Width of a bin of log-odds, and the number of bins on either side of 0; the outermost hold all beyond.
BIN, MOST_BINS = 0.01, 10_000
#: Models for the log-odds of rows that training has seen, and the weight of all groups in a group's threshold.
FOLDS, SHRINK = 3, 20
SIZES, BUCKETS, DIMS, FILTERS, WIDTHS = (3, 4, 5), 1 << 16, 8, 8, (1, 2, 3)


@dataclass
class Model:
    embeddings: np.ndarray  # buckets x DIMS
    filters: list[np.ndarray]  # for each width: width x DIMS x FILTERS
    offsets: list[np.ndarray]  # for each width: FILTERS
    out: np.ndarray  # one weight for each filter of each width
    bias: float
    groups: np.ndarray  # buckets x language groups: log-likelihoods
    prior: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log-odds by group

    def word_table(self, words: list[str]) -> np.ndarray:
        """For each word: its contribution to every place of every filter, then to every group."""
        h, of = ngrams(words, SIZES, BUCKETS, whole=True)
        n = np.bincount(of, minlength=len(words))[:, None]
        scale = 1 / np.sqrt(np.maximum(n, 1))
        e = summed(self.embeddings[h], of, len(words)) * scale
        flat = np.concatenate([f[o] for f in self.filters for o in range(len(f))], axis=1)
        return np.hstack((e @ flat, summed(self.groups[h], of, len(words)) / np.maximum(n, 1))).astype(np.float32)

    @property
    def table_width(self) -> int:
        return sum(WIDTHS) * FILTERS + self.groups.shape[1]

    def logits(self, rows: np.ndarray, table: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and group of texts with so many words each, whose words are these rows of the table."""
        pooled, in_group, _ = self.pool(rows, table, per)
        return pooled @ self.out + self.bias, (in_group + self.prior).argmax(axis=1)

    def pool(self, rows: np.ndarray, table: np.ndarray, per: np.ndarray, where: bool = False):
        """The pooled filters of texts and the sums of what else the table has; with `where`, also at which word each filter was largest (-1: nowhere above 0)."""
        gap, wide = max(WIDTHS) - 1, sum(WIDTHS) * FILTERS
        ends = np.cumsum(per + gap)
        starts = ends - per - gap
        padded = np.full(int(ends[-1]) if len(per) else 0, len(table), np.int64)
        padded[np.repeat(starts - (np.cumsum(per) - per), per) + np.arange(len(rows))] = rows
        values = table.take(padded, axis=0, mode="clip") if len(table) else np.zeros((len(padded), table.shape[1]), np.float32)
        values[padded == len(table)] = 0
        some = np.flatnonzero(per)
        sums = np.zeros((len(per), table.shape[1] - wide))
        if len(some) and sums.shape[1]:
            sums[some] = np.add.reduceat(values[:, wide:], starts[some], axis=0, dtype=np.float64)
        pools, places, column = [], [], 0
        for w, offset in zip(WIDTHS, self.offsets, strict=True):
            conv = values[:, column : column + FILTERS].copy()
            for o in range(1, w):
                conv[:-o] += values[o:, column + o * FILTERS : column + (o + 1) * FILTERS]
            column += w * FILTERS
            conv += offset.astype(np.float32)
            pool = np.zeros((len(per), FILTERS), np.float32)
            if len(some):
                cuts = np.column_stack((starts[some], starts[some] + per[some])).ravel()
                pool[some] = np.maximum.reduceat(conv, cuts[:-1] if cuts[-1] >= len(conv) else cuts, axis=0)[::2]
            pools.append(np.maximum(pool, 0))
            if where:
                place = np.full((len(per), FILTERS), -1, np.int64)
                for k in some:
                    place[k] = conv[starts[k] : starts[k] + per[k]].argmax(axis=0) + starts[k]
                place[pools[-1] <= 0] = -1
                places.append(place)
        return np.hstack(pools), sums, (places, padded)

    def scores(self, logits: np.ndarray, group: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[group] + np.log(CUT / (1 - CUT)), -500, 500)))


def train(sample: pd.DataFrame, epochs: int = 8, batch: int = 32, rate: float = 0.05, l2: float = 1e-5, seed: int = 11) -> Model | None:
    """A model of a sample with the columns text, label (0 or 1) and lang (may be null), with thresholds of 0."""
    truth = sample["label"].to_numpy().astype(np.float64)
    if len(set(truth)) < 2:
        return None
    rng = np.random.default_rng(seed)
    words, codes, per = split_words([t or "" for t in sample["text"]])
    words = words.to_pylist()
    starts = np.cumsum(per) - per
    h, n_of = [], []
    for k in range(0, len(words), 20_000):  # in turns, to bound the driver's memory
        part = words[k : k + 20_000]
        found, of = ngrams(part, SIZES, BUCKETS, whole=True)
        h.append(found.astype(np.int32))
        n_of.append(np.bincount(of, minlength=len(part)))
    h, n_of = np.concatenate(h or [np.zeros(0, np.int32)]), np.concatenate(n_of or [np.zeros(0, np.int64)])
    first_of = np.cumsum(n_of) - n_of
    own = rng.permutation(len(truth))

    # Log-odds of the documents' features are the first dimension; the others begin at random.
    df = np.zeros((2, BUCKETS))
    langs = sorted({x for x in sample["lang"] if x is not None and x == x})
    of_lang = {x: k for k, x in enumerate(langs)}
    seen = np.ones((BUCKETS, max(1, len(langs))))
    for k in own:
        mine = np.unique(codes[starts[k] : starts[k] + per[k]])
        have = np.unique(h[runs(first_of[mine], n_of[mine])])
        df[int(truth[k]), have] += 1
        if sample["lang"].iloc[k] in of_lang:
            seen[have, of_lang[sample["lang"].iloc[k]]] += 1
    n1 = truth[own].sum()
    odds = np.log((df[1] + 0.5) / (n1 + 1)) - np.log((df[0] + 0.5) / (len(own) - n1 + 1))
    odds *= np.minimum(1, df.sum(axis=0) / 5)
    e = rng.normal(0, 0.1, (BUCKETS, DIMS))
    e[:, 0] = odds / 2
    filters = [rng.normal(0, 0.3, (w, DIMS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5
    model = Model(e, filters, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS), float(np.log(max(n1, 1) / max(len(own) - n1, 1))), np.log(seen / seen.sum(axis=0)), np.zeros(seen.shape[1]))
    past = {k: np.full_like(v, 1e-8) for k, v in [("e", e), ("out", model.out), *((f"f{i}", f) for i, f in enumerate(filters)), *((f"o{i}", o) for i, o in enumerate(model.offsets))]}

    def step(name: str, values: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        past[name][at] += g * g
        values[at] -= rate * (g + l2 * values[at]) / np.sqrt(past[name][at])

    for _ in range(epochs):
        shuffled = rng.permutation(own)
        for b in range(0, len(shuffled), batch):
            docs = shuffled[b : b + batch]
            mine = codes[runs(starts[docs], per[docs])]
            local, rows = np.unique(mine, return_inverse=True)
            feats = h[runs(first_of[local], n_of[local])]
            scale = 1 / np.sqrt(np.maximum(n_of[local], 1))
            vectors = summed(e[feats], np.repeat(np.arange(len(local)), n_of[local]), len(local)) * scale[:, None]
            table = (vectors @ np.concatenate([f[o] for f in filters for o in range(len(f))], axis=1)).astype(np.float32)
            pooled, _, (places, padded) = model.pool(rows, table, per[docs], where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
            d = (p - truth[docs]) / len(docs)
            back = d[:, None] * model.out
            step("out", model.out, pooled.T @ d)
            model.bias -= rate * d.sum()
            grad = np.zeros_like(vectors)
            for i, w in enumerate(WIDTHS):
                g = np.where(places[i] >= 0, back[:, i * FILTERS : (i + 1) * FILTERS], 0)
                gf = np.zeros_like(filters[i])
                for o in range(w):
                    at = np.where(places[i] >= 0, padded[np.minimum(places[i] + o, len(padded) - 1)], len(local))
                    doc, filt = np.nonzero((at < len(local)) & (g != 0))
                    word, amount = at[doc, filt], g[doc, filt]
                    np.add.at(grad, word, amount[:, None] * filters[i][o][:, filt].T)
                    np.add.at(gf[o].T, filt, amount[:, None] * vectors[word])
                step(f"f{i}", filters[i], gf)
                step(f"o{i}", model.offsets[i], g.sum(axis=0))
            hit = np.flatnonzero(np.abs(grad).sum(axis=1))
            to = h[runs(first_of[local[hit]], n_of[local[hit]])]
            if len(to):
                at, inv = np.unique(to, return_inverse=True)
                g = np.zeros((len(at), DIMS))
                np.add.at(g, inv, np.repeat(grad[hit] * scale[hit, None], n_of[local[hit]], axis=0))
                step("e", e, g, at)
    model.embeddings = e.astype(np.float32)
    model.groups = model.groups.astype(np.float32)
    model.thresholds = np.zeros(len(model.prior))
    return model


def unseen(sample: pd.DataFrame) -> np.ndarray:
    """The log-odds of each row of a sample under a model of the other folds; not a number where there is none."""
    out, fold = np.full(len(sample), np.nan), np.arange(len(sample)) % FOLDS
    for k in range(FOLDS):
        if (own := fold == k).any() and (model := train(sample[~own])) is not None:
            out[own] = logits_of(model, word_memo(model), pa.array(sample["text"][own], pa.string()))[0]
    return out


def calibrated(model: Model, sample: pd.DataFrame, docs: DataFrame, labels: DataFrame, text: str, label: str, key: str) -> Model:
    """The model with thresholds from all labelled rows; only counts by group, bin and label come to the driver.

    Labelled documents are scored where they are read (all of them if the labels' keys are too many to broadcast), and their
    bins, not their texts, are shuffled to the labels. The sample is bounded, and so are its bins, which are broadcast.
    """
    wanted = materialise(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("long").alias("label")), "wanted-labels")
    if wanted.count() * KEY_BYTES <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(wanted.select(F.col("key").alias("gw_key")).distinct()), docs[key] == F.col("gw_key"), "left_semi")

    def run(batches):
        forget_others("toxicity")
        memo = word_memo(model)
        for batch in batches:
            logits, group = logits_of(model, memo, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group, pa.int64()), pa.array(bins(logits))], names=["key", "group", "bin"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    scored = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, group long, bin long")
    own = pd.DataFrame({"key": sample["key"], "logit": unseen(sample)}).dropna().groupby("key", as_index=False)["logit"].mean()
    own = docs.sparkSession.createDataFrame(list(zip(own["key"].tolist(), bins(own["logit"].to_numpy()).tolist(), strict=True)), f"key {kind}, own long")
    rows = scored.join(wanted, "key").join(F.broadcast(own), "key", "left")
    counts = rows.groupBy("group", F.coalesce("own", "bin").alias("bin"), "label").agg(F.count("*").alias("n")).toPandas()
    model.thresholds = thresholds(counts, len(model.prior))
    return model


def bins(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(logits / BIN), -MOST_BINS, MOST_BINS).astype(np.int64)


def thresholds(counts: pd.DataFrame, groups: int) -> np.ndarray:
    """The threshold of each group from counts with the columns group, bin, label and n."""
    shared = best_threshold(counts)
    out = np.full(groups, shared)
    for g, mine in counts.groupby("group"):
        if mine["label"].nunique() == 2:
            toxic = mine["n"][mine["label"] == 1].sum()
            out[int(g)] = (toxic * best_threshold(mine) + SHRINK * shared) / (toxic + SHRINK)
    return out


def best_threshold(counts: pd.DataFrame) -> float:
    """The log-odds above which F1 is best, in the middle of the gap to the next bin that holds rows; 0 without both kinds."""
    if counts["label"].nunique() < 2:
        return 0.0
    by_bin = counts.pivot_table(index="bin", columns="label", values="n", aggfunc="sum", fill_value=0).sort_index(ascending=False)
    right = by_bin[1].cumsum().to_numpy()
    f1 = 2 * right / (by_bin.sum(axis=1).cumsum().to_numpy() + right[-1])
    k = len(f1) - 1 - int(np.argmax(f1[::-1]))
    low = by_bin.index[k] * BIN
    return float((low + (by_bin.index[k + 1] + 1) * BIN) / 2) if k + 1 < len(f1) else float(low)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", key: str = "doc_id", sample_rows: int = 3000, sample_chars: int = 8_000) -> Model | None:
    """A model of a bounded sample of the labelled rows, as many of them toxic as not where there are enough, with thresholds from all of them."""
    wanted = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # A bounded part of the labels finds its texts, so that no text is shuffled; long ones go after that.
    most = sample_rows // 2
    kinds = []
    for k in sorted(n):
        chosen = bounded(wanted.where((F.col("label") == k) & share_of(F.col("key"), n[k], 2 * most)), "key", "label", 3 * most)
        texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        usable = texts.join(F.broadcast(chosen), "key").where(F.col("text").isNotNull() & (F.char_length("text") <= sample_chars))
        kinds.append(bounded(usable, "key", "text", most).toPandas())
    sample = pd.concat(kinds).sort_values(["key", "label", "text"]).reset_index(drop=True) if kinds else pd.DataFrame({"key": [], "label": [], "text": [], "lang": []})
    model = train(sample)
    return None if model is None else calibrated(model, sample, docs, labels, text, label, key)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with score and predicted, which replace columns of that name."""
    rest = [c for c in docs.columns if c != text and c.lower() not in ("score", "predicted")]
    kept = [F.col(f"`{c}`") for c in rest]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches):
        forget_others("toxicity")
        memo = word_memo(model)
        for batch in batches:
            scores = scores_of(model, memo, batch.column(batch.num_columns - 1))
            arrays = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "score", "predicted"])
        release()

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in rest] + ["score double", "predicted int"])
    return bounded_batches(docs).select(*kept, F.col(text).cast("string").alias(fresh(docs, "gw_text"))).mapInArrow(run, schema)


def word_memo(model: Model) -> TableMemo:
    return TableMemo(model.word_table, model.table_width, 100_000)


def logits_of(model: Model, memo: TableMemo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for block in blocks(texts, 500_000):
        words, codes, per = split_words(block)
        rows = memo.rows(words)[codes]
        out.append(model.logits(rows, memo.table, per))
    logits, group = zip(*out, strict=True) if out else ([np.zeros(0)], [np.zeros(0, np.int64)])
    return np.concatenate(logits), np.concatenate(group)


def scores_of(model: Model, memo: TableMemo, texts: pa.Array) -> np.ndarray:
    return model.scores(*logits_of(model, memo, texts))


def drop_toxic(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that the model does not reject, with all columns, whatever their names."""
    if model is None:
        return docs

    def run(batches):
        forget_others("toxicity")
        memo = word_memo(model)
        for batch in batches:
            yield batch.filter(pa.array(scores_of(model, memo, batch.column(0).field(text)) < CUT))
        release()

    packed = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("gw_row"))
    return packed.mapInArrow(run, packed.schema).select("gw_row.*")
