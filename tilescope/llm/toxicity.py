"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (``MAX_POSITIVE`` at most) and a sample of all documents of
the training folds (``MAX_UNLABELLED`` at most, whose labels are not looked at), each
the smallest by hash of ``doc_id``, train a logistic model with numpy.  Its risk estimate is corrected by the class prior p:

    p * E_pos[loss(+1)] + max(0, E_unl[loss(-1)] - p * E_pos[loss(-1)])

and where the second part turns negative a step goes the other way, so that the
model does not fit the positives hidden in the unlabelled sample as negatives.

Inputs of a score are the words of the text alone: for each word or beginning of a
word, of a vocabulary chosen on the sample, whether it occurs.  Rows with crc32(doc_id) mod 4 = 2 are
held out: neither their labels nor their texts are used for training.

Defined results: a null text counts as empty and scores as a text without known
words; without any confirmed toxic example every score is 0; repeated rows score
alike; a null ``doc_id`` is in no training fold; an empty table gives an empty
result; texts of any length are read whole; ``labels`` may hold several rows a
document (one toxic row is enough) or none; other columns, whatever their names, are
not read, and come through ``drop_toxic`` as they were.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, materialize, scratch, text_of

#: Most documents of either kind that a model is trained on.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
#: A parameter of the model, not of the corpus: its width.  Of the words that tell toxic documents apart (each in at
#: least ``LEAST_POSITIVE`` of them, by ``LEAST_SIGNAL`` standard errors) the ``MAX_WORDS`` that do so best have a weight.
MAX_WORDS = 4000
LEAST_POSITIVE = 3
LEAST_SIGNAL = 5.0
#: Weight decay, for one positive document; the more there are the less of it.
DECAY = 0.02
THRESHOLD = 0.3
#: Letters of a word that count as its beginning.
PREFIX = 4
WORD = re.compile(r"[^\W\d_]{2,}")


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 3; 2 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4))


def words_of(text: str) -> set[str]:
    """The words of a text and, marked by a hyphen, how they begin (inflections share that)."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:PREFIX]}-" for w in words}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in words_of(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))) if z > -40 else 0.0


def train(found: list[np.ndarray], is_pos: np.ndarray, words: list[str], prior: float, steps: int = 500, rate: float = 0.05) -> Model:
    """found: for each sample document which of ``words`` it has, by number; is_pos: whether it is confirmed toxic."""
    n_pos, n_unl = int(is_pos.sum()), int((~is_pos).sum())
    col = np.concatenate([*found, np.empty(0, dtype=np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    decay = max(DECAY / n_pos, 1e-5)
    weight, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weights=weight[col], minlength=len(is_pos))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        as_neg = np.logaddexp(0, z)  # logistic loss against -1
        rest = as_neg[~is_pos].mean() - prior * as_neg[is_pos].mean()
        # derivatives of the two parts by z
        first = np.where(is_pos, prior * (s - 1) / n_pos, 0)
        second = np.where(is_pos, -prior * s / n_pos, s / n_unl)
        dz = first + second if rest >= 0 else -second
        grad = np.append(np.bincount(col, weights=dz[row], minlength=len(words)) + decay * weight, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    # a text without known words is at most as suspect as any
    bias = min(bias, float(np.log(prior / (1 - prior))))
    return Model({w: float(x) for w, x in zip(words, weight, strict=True) if abs(x) > 1e-3}, bias)


def sample_words(docs: DataFrame, ids: DataFrame, toxic: bool) -> DataFrame:
    """toxic, words of the documents in ``ids``, of which there are a bounded number; equal texts once."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            words = pa.array([sorted(words_of(t or "")) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            return pa.RecordBatch.from_pydict({"toxic": pa.array([toxic] * part.num_rows, pa.bool_()), "words": words})

        return work

    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(text_of().alias("text")).distinct()
    return map_slices(texts, make, "toxic boolean, words array<string>")


def telling_words(sample: DataFrame, n_pos: int, n_unl: int) -> list[str]:
    """Words that are by ``LEAST_SIGNAL`` standard errors more frequent in toxic documents than in all text."""
    least = max(2, min(LEAST_POSITIVE, n_pos // 10))
    words = sample.select("toxic", F.explode("words").alias("word"))
    counted = words.groupBy("word").agg(F.count_if("toxic").alias("n"), F.count_if(~F.col("toxic")).alias("u")).where(F.col("n") >= least)
    share = (F.col("u") + 0.5) / (n_unl + 1)
    signal = (F.col("n") / n_pos - share) / F.sqrt(share * (1 - share) / n_pos)
    chosen = counted.withColumn("signal", signal).where(F.col("signal") >= LEAST_SIGNAL).orderBy(F.desc("signal"), "word").limit(MAX_WORDS)
    return [r["word"] for r in chosen.collect()]


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The driver gets the chosen words and, of each sample document, the numbers of those it has."""
    with scratch(docs.sparkSession):
        return _fit(docs.select("doc_id", "text"), labels, max_positive, max_unlabelled)


def _fit(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> Model:
    labels = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 2))
    marked = materialize(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    by_hash = lambda df, n: materialize(df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n), "toxic-sample")
    positive = by_hash(marked.where("toxic = 1").join(docs.select("doc_id"), "doc_id", "left_semi"), max_positive)
    # the unlabelled sample stands for all text, so it is drawn without a look at labels
    unlabelled = by_hash(docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold() != 2)), max_unlabelled)
    sample = materialize(sample_words(docs, positive, True).union(sample_words(docs, unlabelled, False)), "toxic-words")
    n_pos, n_unl = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not n_pos or not n_unl:
        return Model()
    words = telling_words(sample, n_pos, n_unl)
    number = {w: k for k, w in enumerate(words)}

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(number[w] for w in some if w in number) for some in part.column("words").to_pylist()]
            return pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "found": pa.array(found, pa.list_(pa.int32()))})

        return work

    # at most max_positive + max_unlabelled rows; in one order, so that sums do not depend on that of the tasks
    rows = sorted(map_slices(sample, make, "toxic boolean, found array<int>").collect(), key=lambda r: (not r["toxic"], r["found"]))
    return train([np.array(r["found"], dtype=np.int64) for r in rows], np.array([r["toxic"] for r in rows], dtype=bool), words, min(max(prior, 1e-4), 0.9))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.score(t or "") for t in part.column("text").to_pylist()]
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": predicted})

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_slices(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores at the threshold or above; all columns as they were."""
    at = docs.columns.index("text")

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            keep = pa.array([model.score(t or "") < threshold for t in part.column(at).to_pylist()], pa.bool_())
            return part.filter(keep)

        return work

    return map_slices(docs, make, docs.schema)
