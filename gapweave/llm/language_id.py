"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1-, 2- and 3-grams of words with their ends; a text's values are shares of its n-grams times inverse
document frequencies. Weights are learnt by the follow-the-regularised-leader rule with elastic-net penalties, which
leaves most of them zero; one temperature, fitted on rows kept back, then calibrates the probabilities.

Training uses at most about `sample_rows` labelled rows with texts of up to `sample_chars` characters, chosen by a hash
of the id and brought to the driver; everything else runs in the tasks. Scoring takes whole texts of any length.

Texts that are null or have no letter are `und` with score 0. Rows with a null label teach nothing. Repeated rows get
equal results. Without any labelled row all texts are `und`. Ties go to the label that sorts first. Columns named
lang_pred or score are replaced; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import blocks, bounded_batches, fresh, per_text, release
from gapweave.llm.features import TableMemo, bounded_sample, ngrams, split_words, summed

SIZES, BUCKETS, UNKNOWN = (1, 2, 3), 1 << 16, "und"
#: Shares of n-grams are small numbers; this brings them near 1.
SCALE = 30.0


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels, with inverse document frequencies and the scale
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their shares."""
    words, codes, _ = split_words([text])
    times = np.bincount(codes, minlength=len(words))
    h, of = ngrams(words.to_pylist(), SIZES, BUCKETS)
    at, back = np.unique(h, return_inverse=True)
    n = np.bincount(back, weights=times[of], minlength=len(at))
    return at, n / max(n.sum(), 1)


def train(sample: pd.DataFrame, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 7) -> Model:
    """A model of a sample with the columns text and label; a fifth is kept back for the temperature."""
    labels = sorted(set(sample["label"]))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = [(counts_of(t or ""), labels.index(y)) for t, y in zip(sample["text"], sample["label"], strict=True)]
    order = rng.permutation(len(rows))
    kept, own = order[: len(rows) // 5], order[len(rows) // 5 :]
    df = np.zeros(BUCKETS)
    for k in own:
        df[rows[k][0][0]] += 1
    idf = (np.log((1 + len(own)) / (1 + df)) + 1) * SCALE
    z, n = np.zeros((BUCKETS + 1, len(labels))), np.zeros((BUCKETS + 1, len(labels)))

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(own):
            (at, share), y = rows[k]
            at, x = np.append(at, BUCKETS), np.append(share * idf[at], 1.0)  # the last is the bias
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    full = weights(np.arange(BUCKETS + 1))
    model = Model(labels, (full[:-1] * idf[:, None]).astype(np.float32), full[-1])
    if len(kept):
        logits = np.array([rows[k][0][1] @ model.weights[rows[k][0][0]] + model.bias for k in kept])
        truth = np.array([rows[k][1] for k in kept])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.05, 20, 120), key=loss)
    return model


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample_rows: int = 2000, sample_chars: int = 8_000) -> Model:
    """A model of a bounded sample of the rows that have a label."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.char_length(F.col(text)) <= sample_chars))
    sample = bounded_sample(usable, key, text, sample_rows).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).toPandas()
    return train(sample.sort_values(["key", "label", "text"]).reset_index(drop=True))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with lang_pred and score, which replace columns of that name."""
    width = len(model.labels) + 1

    def word_table(words: list[str]) -> np.ndarray:
        h, of = ngrams(words, SIZES, BUCKETS)
        return summed(np.column_stack((model.weights[h], np.ones(len(h), np.float32))), of, len(words))

    def score(batches):
        memo = TableMemo(word_table, width, 200_000)
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            label, prob = [], []
            for block in blocks(batch.column(batch.num_columns - 1), 1_000_000):
                words, codes, per = split_words(block)
                rows = memo.rows(words)
                values = memo.table[rows]
                total = np.column_stack([per_text(values[codes, k].astype(np.float64), per) for k in range(width)])
                p = model.probabilities(total[:, :-1] / np.maximum(total[:, -1:], 1) + model.bias)
                best = p.argmax(axis=1)
                known = total[:, -1] > 0
                label.append(np.where(known, names[best], UNKNOWN))
                prob.append(np.where(known, p.max(axis=1), 0.0))
            arrays = [*batch.columns[:-1], pa.array(np.concatenate(label) if label else [], pa.string()), pa.array(np.concatenate(prob) if prob else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "lang_pred", "score"])
        release()

    # Texts without a letter are und; asking that here stops at a text's first letter.
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    rest = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    kept = [F.col(f"`{c}`") for c in rest]
    if not model.labels:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c in rest] + ["lang_pred string", "score double"])
    return bounded_batches(docs).select(*kept, lettered.alias(fresh(docs, "gw_text"))).mapInArrow(score, schema)
