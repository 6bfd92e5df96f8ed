"""Toxicity: a classifier chain over the categories, each linear model fed the earlier ones' out-of-fold probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.common import CACHED_WORDS, few_ids, hashed_sample, slices
from pagesieve.llm.quality import TOKEN
from pagesieve.session import cut_lineage

#: Token hashes; two of a million words collide rarely.
SPACE = 1 << 31
#: Characters of a stem.
STEM = 5
#: Labelled texts that the chain is fitted on at most, chosen by the hash of their id; equal texts are one.
TRAIN_ROWS = 20_000
#: Tokens that a model weighs: in at least so many training texts, and the most telling of those.
LEAST_TEXTS, WEIGHED = 5, 1024
FOLDS, STEPS, RATE, DECAY = 5, 300, 0.5, 1e-5

#: The chain, in its order: the kinds that the labels tell apart, then any toxicity, whose model knows what was found of each kind.
CATEGORIES = {"toxic_prose": "toxic = 1 AND quality = 1", "toxic_junk": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}


class Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token) % SPACE
        return value

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the tokens of a text, in lower case, and of the stems of longer ones, so that an inflected slur
        counts as the slur. Presence, not frequency: one is enough."""
        tokens = set(TOKEN.findall(text.lower()))
        tokens |= {t[:STEM] + "~" for t in tokens if len(t) > STEM}
        return np.unique(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Tokens()
    for batch in slices(batches):
        rows = [known.of(t or "").tobytes() for t in batch.column("text").to_pylist()]
        digests = [xxhash.xxh3_128_digest(r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "digest", "tokens"]
        )


@dataclass(frozen=True)
class Sparse:
    """Rows of 0 and 1: the column numbers of each row one after the other, and where each row begins."""

    columns: np.ndarray
    rows: np.ndarray
    n: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], self.n)

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, errors[self.rows], width)

    def subset(self, keep: np.ndarray) -> Sparse:
        number = np.cumsum(keep) - 1
        inside = keep[self.rows]
        return Sparse(self.columns[inside], number[self.rows[inside]], int(keep.sum()))


def sparse(texts: list[np.ndarray], vocabulary: np.ndarray) -> Sparse:
    lengths = [len(t) for t in texts]
    tokens, rows = np.concatenate([*texts, np.empty(0, np.int32)]), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    if not len(vocabulary):
        return Sparse(np.empty(0, np.int64), np.empty(0, np.int64), len(texts))
    at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
    known = vocabulary[at] == tokens
    return Sparse(at[known], rows[known], len(texts))


def telling_tokens(texts: list[np.ndarray], y: np.ndarray, weighed: int) -> np.ndarray:
    """Sorted tokens whose presence goes with any category: the largest chi-square statistics, over all categories."""
    vocabulary, at, counts = np.unique(np.concatenate([*texts, np.empty(0, np.int32)]), return_inverse=True, return_counts=True)
    at, rows = at.astype(np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    best, n = np.zeros(len(vocabulary)), max(len(texts), 1)
    for k in range(y.shape[1]):
        share = y[:, k].mean() if len(texts) else 0.0
        if 0 < share < 1:
            having = np.bincount(at, y[rows, k], len(vocabulary))
            expected = counts * share
            spread = counts * share * (1 - share) * np.maximum(1 - counts / n, 1 / n)
            best = np.maximum(best, (having - expected) ** 2 / spread)
    best[counts < LEAST_TEXTS] = 0
    top = np.argsort(-best, kind="stable")[:weighed]
    return np.sort(vocabulary[top[best[top] > 0]])


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray  # of the tokens
    earlier: np.ndarray  # of the earlier categories' log odds
    bias: float

    def probability(self, x: Sparse, chain: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.times(self.weights) + chain @ self.earlier + self.bias, -60, 60)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: Sparse, chain: np.ndarray, y: np.ndarray, width: int) -> Linear:
    """Logistic regression by full gradients with a step per weight (Adagrad)."""
    if len(y) == 0 or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Linear(np.zeros(width), np.zeros(chain.shape[1]), float(log_odds(np.array(share))))
    weights, earlier, bias = np.zeros(width), np.zeros(chain.shape[1]), float(log_odds(np.array(y.mean())))
    square, square_earlier, square_bias = np.full(width, 1e-8), np.full(chain.shape[1], 1e-8), 1e-8
    for _ in range(STEPS):
        error = (Linear(weights, earlier, bias).probability(x, chain) - y) / len(y)
        g, e, b = x.back(error, width) + DECAY * weights, chain.T @ error + DECAY * earlier, error.sum()
        square, square_earlier, square_bias = square + g * g, square_earlier + e * e, square_bias + b * b
        weights, earlier = weights - RATE * g / np.sqrt(square), earlier - RATE * e / np.sqrt(square_earlier)
        bias -= RATE * b / np.sqrt(square_bias)
    return Linear(weights, earlier, float(bias))


@dataclass(frozen=True)
class Chain:
    vocabulary: np.ndarray
    models: list[Linear]
    threshold: float  # of the last category

    def probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        x = sparse(texts, self.vocabulary)
        found = np.empty((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            found[:, k] = model.probability(x, log_odds(found[:, :k]))
        return found


def fit_chain(texts: list[np.ndarray], y: np.ndarray, weighed: int = WEIGHED) -> Chain:
    """``y``: a column per category. A later model learns from probabilities that earlier models gave to rows they had not seen."""
    vocabulary = telling_tokens(texts, y, weighed)
    x, fold = sparse(texts, vocabulary), np.arange(len(texts)) % FOLDS
    unseen, models = np.zeros(y.shape), []
    for k in range(y.shape[1]):
        before = log_odds(unseen[:, :k])
        models.append(fit_linear(x, before, y[:, k], len(vocabulary)))
        for f in range(FOLDS):
            rest, part = fold != f, fold == f
            model = fit_linear(x.subset(rest), before[rest], y[rest, k], len(vocabulary))
            unseen[part, k] = model.probability(x.subset(part), before[part])
    return Chain(vocabulary, models, best_threshold(unseen[:, -1], y[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on rows count, so that out-of-fold rows have the best F1; halfway, in log odds, to the next row."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    right, odds = np.cumsum(y[order]), log_odds(p[order])
    ends = np.append(odds[1:] < odds[:-1], True)
    f1 = np.where(ends, 2 * right / (np.arange(1, len(y) + 1) + y.sum()), 0)
    last = int(np.argmax(f1))
    middle = (odds[last] + (odds[last + 1] if last + 1 < len(odds) else odds[last])) / 2
    return float(1 / (1 + np.exp(-middle)))


def scored(chain: Chain, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in slices(batches):
            found = chain.probabilities([known.of(t or "") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[:, k], pa.float64()) for k in range(len(names)))], ["doc_id", *names]
            )

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, train_rows: int = TRAIN_ROWS, usable: Column | None = None,
    weighed: int = WEIGHED,
) -> DataFrame:
    """``(doc_id, p_<category> for each category, toxic)`` for every row of ``docs``; ``toxic``: the last category of the chain, which
    learns from the probabilities of all others, reaches the threshold that separates out-of-fold rows best.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and the columns that ``categories`` (name to SQL condition, in the
    order of the chain) name; other columns are ignored. The chain is fitted on at most ``train_rows`` labelled texts for which
    ``usable`` (a condition on doc_id; None: all) holds; copies of one text count once, with the label that most of them have, 0 at a
    tie. Its models have a weight for each of the ``weighed`` most telling tokens; whole texts are searched for these. All rows are
    scored where they lie; nothing of a text is shuffled except the training rows' token hashes.

    Null and empty texts have no tokens and get the score of the bias. Conditions that are null count as false; labels of a null
    doc_id are ignored, of several labels of a document the largest counts. Repeated rows are scored alike. A category with one
    label only has its constant share. An empty table gives no rows; without labels every probability is near 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = [F.coalesce(F.expr(condition), F.lit(False)).cast("int").alias(f"y{k}") for k, condition in enumerate(categories.values())]
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *marks)
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(marks))])
    known = cut_lineage(hashed_sample(known, "doc_id", train_rows))
    tokens = docs.join(few_ids(known.select("doc_id")), "doc_id", "left_semi").mapInArrow(tokens_of, "doc_id long, digest binary, tokens binary")
    examples = tokens.join(F.broadcast(known), "doc_id").groupBy("digest").agg(
        F.min_by("tokens", "doc_id").alias("tokens"), *[F.avg(f"y{k}").alias(f"y{k}") for k in range(len(marks))]
    )
    rows = examples.orderBy("digest").collect()
    y = np.array([[round(r[f"y{k}"]) for k in range(len(marks))] for r in rows], float).reshape(len(rows), len(marks))
    chain = fit_chain([np.frombuffer(bytes(r["tokens"]), np.int32) for r in rows], y, weighed)
    names = [f"p_{name}" for name in categories]
    result = docs.mapInArrow(scored(chain, names), "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return result.withColumn("toxic", F.col(names[-1]) >= chain.threshold)
