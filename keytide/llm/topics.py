"""Latent Dirichlet topic models over a corpus in tables, fitted by online variational Bayes.

The documents lie in slices. An update is one Spark job over one slice: its tasks infer the topics of
their documents and sum, per topic and word, what was expected; the sums of the tasks are added on the executors, and topics x
words of them reach the driver, which moves the topics towards them by a step that shrinks with every update. A pass goes over all
slices, so over every document. Topics start at random; nothing tells them what to find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr")


@dataclass(frozen=True)
class TopicSettings:
    """Parameters of the models; shares are of a language's documents that have paragraphs, the documents of a ruling counted as one."""

    topics: int = 40
    #: Models per language from different random starts; a paragraph's subject needs most of them.
    restarts: int = 3
    #: Updates of the topics, each by one slice of the corpus in turn; slices are of so many documents at least, and so many at most.
    updates: int = 16
    slice_documents: int = 500
    most_slices: int = 8
    inner_steps: int = 6
    #: Steps of update u are (1 + u) ** -forgetting.
    forgetting: float = 0.7
    seed: int = 7
    #: Dirichlet priors of topics in a document and of words in a topic.
    topic_prior: float = 0.1
    word_prior: float = 0.02
    #: Which words can make a topic: how many documents have them, and how much they come back in those.
    least_share: float = 0.008
    most_share: float = 0.16
    least_burst: float = 1.3
    #: Part of a topic's weight that inspected terms must have, and part of that which one subject's must have.
    least_mapped: float = 0.02
    least_agreement: float = 0.6
    #: What a subject must hold of a paragraph's topic proportions, by all topics mapped to it.
    least_proportion: float = 0.3
    #: Other sentences of a document that must speak of a sentence's subject to bear it out, and the part of the sentences
    #: with a word that must be borne out, or the word marks asides.
    least_others: int = 2
    least_support: float = 0.6

    def slices(self, documents: float) -> int:
        """Into how many slices a corpus is cut."""
        return int(min(self.most_slices, max(1, documents // self.slice_documents)))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the digamma function, by recurrence and its asymptotic series."""
    y = x + 3
    series = np.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4)
    return np.exp(series - 1 / x - 1 / (x + 1) - 1 / (x + 2))


def topic_weights(counts: np.ndarray) -> np.ndarray:
    """exp of the expected log weight of words in topics, words x topics, and a row of zeros."""
    weights = exp_digamma(counts) / exp_digamma(counts.sum(axis=1, keepdims=True))
    return np.vstack([weights.T, np.zeros(len(counts))]).astype(np.float32)


def infer(tokens: np.ndarray, times: np.ndarray, weights: np.ndarray, prior: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Variational step of latent Dirichlet allocation for many bags of words at once.

    ``tokens``: bags x words, filled up with the number after the last word, whose row in ``weights`` (words + 1
    x topics) is zero; ``times``: how often each is in its bag. Gives expected words per topic (bags x topics) and
    what each word gives to each topic, but for the word's own weight (bags x words x topics).
    """
    of_word = weights[tokens]
    expected = np.repeat(times.sum(axis=1, keepdims=True) / weights.shape[1], weights.shape[1], axis=1).astype(np.float32)
    for _ in range(steps):
        theta = exp_digamma(expected + np.float32(prior))
        inverse = times / (np.einsum("nlk,nk->nl", of_word, theta) + np.float32(1e-30))
        expected = theta * np.einsum("nlk,nl->nk", of_word, inverse)
    return expected, theta[:, None, :] * inverse[:, :, None]


def filled(values: np.ndarray, times: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fill: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of bags of like length: their numbers, and their words and times in rectangles; empty bags are in none."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = int(lengths[order[min(at + 2047, len(order) - 1)]])
        rows = order[at : at + max(1, min(2048, 100_000 // longest))]
        columns = np.arange(int(lengths[rows[-1]]))
        inside = columns < lengths[rows][:, None]
        where = np.minimum(starts[rows][:, None] + columns, len(values) - 1)
        yield rows, np.where(inside, values[where], fill), np.where(inside, times[where], 0).astype(np.float32)
        at += len(rows)


@dataclass(frozen=True)
class TopicModel:
    """A language's topics: words, and weights (topics x words) as expected counts."""

    words: list[str]
    counts: np.ndarray

    def top_terms(self, n: int = 12) -> list[list[str]]:
        """The words that weigh most in each topic, for inspection."""
        return [[self.words[i] for i in np.argsort(-row, kind="stable")[:n]] for row in self.counts]

    def subjects(self, terms: dict[str, set[str]], settings: TopicSettings) -> list[str | None]:
        """The subject of each topic: the one whose inspected terms prevail among those the topic gives weight to, or None."""
        out: list[str | None] = []
        columns = {s: [i for i, w in enumerate(self.words) if w in own] for s, own in terms.items()}
        for row in self.counts / self.counts.sum(axis=1, keepdims=True):
            mass = {s: float(row[at].sum()) for s, at in columns.items()}
            best = max(mass, key=lambda s: (mass[s], s))
            total = sum(mass.values())
            out.append(best if total >= settings.least_mapped and mass[best] >= settings.least_agreement * total else None)
        return out


def fit_topics(bags: DataFrame, words: dict[str, list[str]], slices: int, settings: TopicSettings) -> dict[str, list[TopicModel]]:
    """Topic models of each language, one per restart, over every document of ``bags`` (slice, lang, weight, words, times).

    Languages without a vocabulary have no model. The same rows give the same topics, up to the order of sums.
    """
    rng = np.random.default_rng(settings.seed)
    counts = {(lang, r): rng.gamma(100.0, 0.01, (settings.topics, len(known))) for r in range(settings.restarts) for lang, known in words.items() if known}
    size: dict[tuple[str, int], float] = {(r.lang, r.slice): r.weight for r in bags.groupBy("lang", "slice").agg(F.sum("weight").alias("weight")).collect()}  # languages x slices
    total = {lang: sum(w for (of, _), w in size.items() if of == lang) for lang in words}
    for update in range(settings.updates):
        at = update % slices
        step = (1 + update) ** -settings.forgetting
        now = {(lang, r): topic_weights(c) for (lang, r), c in counts.items() if size.get((lang, at))}
        if not now:
            continue
        found = {(lang, r): np.full(counts[lang, r].shape, settings.word_prior) for lang, r in now}
        for row in _expected_counts(bags.where(F.col("slice") == at), now, settings).toArrow().to_batches():
            for lang, r, topic, n in zip(*(row.column(i).to_pylist() for i in range(3)), row.column(3), strict=True):
                found[lang, r][topic] += n.values.to_numpy() * (total[lang] / size[lang, at])
        for model, seen in found.items():
            counts[model] = (1 - step) * counts[model] + step * seen
    return {lang: [TopicModel(known, counts[lang, r]) for r in range(settings.restarts)] for lang, known in words.items() if known}


_SUMS = "lang string, restart int, topic int, counts array<double>"


def _sum_batch(rows: dict[tuple[str, int, int], np.ndarray]) -> pa.RecordBatch:
    """Counts per word of models' topics, as rows of _SUMS."""
    lang, restart, topic = list(zip(*rows, strict=True)) or ((), (), ())
    ends = np.concatenate([[0], np.cumsum([len(n) for n in rows.values()])]).astype(np.int32)
    flat = pa.array(np.concatenate([*rows.values(), np.zeros(0)]))
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(restart, pa.int32()), pa.array(topic, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["lang", "restart", "topic", "counts"])


def _expected_counts(bags: DataFrame, weights: dict[tuple[str, int], np.ndarray], settings: TopicSettings) -> DataFrame:
    """(lang, restart, topic, counts per word) expected over the given documents, each by its weight.

    A row per topic leaves each task, and the rows of a topic are added in one place; a task holds as much as the topics take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {model: np.zeros(w.shape) for model, w in weights.items()}
        for batch in batches:
            for lang in {lang for lang, _ in weights}:
                part = batch.filter(pa.compute.equal(batch.column(0), lang))
                weight = part.column(1).to_numpy()
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                values, times = (part.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
                models = {model: w for model, w in weights.items() if model[0] == lang}
                fill = len(next(iter(models.values()))) - 1
                for rows, tokens, n in filled(values, times, np.cumsum(lengths) - lengths, lengths, fill):
                    order = np.argsort(tokens, axis=None, kind="stable")
                    flat, own = tokens.ravel()[order], weight[rows, None, None].astype(np.float32)
                    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                    for model, w in models.items():
                        shares = infer(tokens, n, w, settings.topic_prior, settings.inner_steps)[1] * own
                        sums[model][flat[starts]] += np.add.reduceat(shares.reshape(-1, w.shape[1])[order], starts, axis=0)
        topics = {(*model, k): row for model, s in sums.items() for k, row in enumerate((s * weights[model]).T[:, :-1])}
        yield _sum_batch(topics)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for lang, restart, topic, n in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                at, n = (lang, restart, topic), n.values.to_numpy()
                sums[at] = sums[at] + n if at in sums else n
        yield _sum_batch(sums)

    parts = bags.select("lang", "weight", "words", "times").mapInArrow(run, _SUMS)
    return parts.repartition("lang", "restart", "topic").mapInArrow(add, _SUMS)
