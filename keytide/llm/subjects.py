"""Subject areas of documents by latent Dirichlet topic models.

Method: unguided topic models, a few per language, are fitted distributed over the tasks on all documents (``topics``); topics
are mapped to subjects through terms that were inspected among the top terms of such topics (``terms``); a document has the
subjects that hold enough of the topic proportions of one of its paragraphs. A decision speaks of a matter in a few words
among many of procedure, so the vocabulary is chosen by burstiness: words that come back in the documents that have them, where those of
procedure spread evenly.

A subject named only in an aside (a comparison, a cited case) is none of the document's. Asides are learnt: what is said in
them of a subject is seldom borne out by other sentences of the same document, so words of their fixed phrases ("likened", "comparison")
occur, over the corpus, mostly in sentences that are not borne out. Sentences with such words are left out of the proportions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.paragraphs import language_of, sentences_of, units_of
from keytide.llm.terms import SUBJECTS, inspected_terms
from keytide.llm.topics import LANGUAGES, TopicModel, TopicSettings, filled, fit_topics, infer, topic_weights
from keytide.session import materialize, shared_path

PARAGRAPHS = "doc_id bigint, case_no string, lang string, units array<array<array<bigint>>>, met array<struct<id:bigint,word:string>>"
ENCODED = "doc_id bigint, lang string, weight double, words array<int>, times array<int>, units array<array<array<int>>>, slice int"


class _Words(dict):
    """A 64-bit number for every word, the same in every task; those met first since the last call of ``met``."""

    def __init__(self) -> None:
        self.new: list[dict[str, object]] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)
        self.new.append({"id": number, "word": word})
        return number

    def met(self) -> list[dict[str, object]]:
        new, self.new = self.new, []
        return new


def corpus_paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, case_no, lang, units, met): sentences of every paragraph as numbers of words; documents without
    paragraphs are listed with none. The language is told from the text, not from the column lang; case_no is null
    where the documents have no such column. ``met``: words and their numbers, each at least once in the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            langs, values, sentences, units, docs = [], [], [0], [0], [0]
            for text in batch.column(1).to_pylist():
                langs.append(lang := language_of(text))
                for unit in units_of(text):
                    for sentence in sentences_of(unit, lang):
                        values.extend(map(words.__getitem__, sentence))
                        sentences.append(len(values))
                    units.append(len(sentences) - 1)
                docs.append(len(units) - 1)
            nested = pa.array(values, pa.int64())
            for ends in (sentences, units, docs):
                nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nested)
            met = pa.array([words.met(), *[[]] * (batch.num_rows - 1)], pa.list_(pa.struct([("id", pa.int64()), ("word", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), nested, met], names=["doc_id", "case_no", "lang", "units", "met"])

    case = F.col("case_no") if "case_no" in documents.columns else F.lit(None).cast("string").alias("case_no")
    return documents.select("doc_id", "text", case).mapInArrow(run, PARAGRAPHS)


def weighted(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with weight: 1 / (documents of the ruling in the language that have paragraphs).

    So a ruling counts as one document, however many copies and versions of it there are. Rulings' weights are written before
    the join, so that one with very many documents can be split among tasks; documents without case_no are not joined at all.
    """
    named, alone = paragraphs.where("case_no IS NOT NULL"), paragraphs.where("case_no IS NULL").withColumn("weight", F.lit(1.0))
    several = named.where(F.size("units") > 0).groupBy("lang", "case_no").agg(F.count("*").alias("n")).where("n > 1")
    weights = materialize(several.select("lang", "case_no", (1 / F.col("n")).alias("weight")), "weights")
    joined = named.join(weights, ["lang", "case_no"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return joined.unionByName(alone).drop("case_no", "met")


def word_statistics(documents: DataFrame) -> DataFrame:
    """(lang, word, in_units, in_documents) over all weighted documents; a null word counts the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            for lang in LANGUAGES:
                b = _Batch(batch, lang)
                weight = batch.column(2).to_numpy(zero_copy_only=False)[b.rows]
                # In the order of words, and of units within a word, repeats in a unit or document are neighbours.
                order = np.argsort(b.values, kind="stable")
                word, unit = b.values[order], b.sentence_unit[b.sentence[order]]
                doc = b.unit_doc[unit]
                new_word = np.r_[True, word[1:] != word[:-1]][: len(word)]
                new_unit, new_doc = (new_word | np.r_[True, x[1:] != x[:-1]][: len(word)] for x in (unit, doc))
                known, code = word[new_word], np.cumsum(new_word) - 1
                units, docs = (np.bincount(code[new], weights=weight[doc[new]], minlength=len(known)) for new in (new_unit, new_doc))
                whole = float(weight[np.unique(b.unit_doc)].sum())
                words = pa.concat_arrays([pa.array([None], pa.int64()), pa.array(known)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.r_[0.0, units]), pa.array(np.r_[whole, docs])], names=["lang", "word", "in_units", "in_documents"])

    parts = documents.select("doc_id", "lang", "weight", "units").mapInArrow(run, "lang string, word bigint, in_units double, in_documents double")
    # Rounded, as sums of fractions depend on their order in the last places.
    return parts.groupBy("lang", "word").agg(F.round(F.sum("in_units"), 6).alias("in_units"), F.round(F.sum("in_documents"), 6).alias("in_documents"))


def vocabulary(paragraphs: DataFrame, documents: DataFrame, settings: TopicSettings) -> tuple[dict[str, tuple[list[str], list[str]]], float]:
    """Words of each language in alphabetical order: those that can make a topic, and those that frame them; and the number of documents.

    Topic words are neither rare nor common among rulings and come back within documents more than by chance; all others that are
    not rare are frames. At most (words of a document) / least_share of them reach the driver, however large the corpus.
    """
    stats = materialize(word_statistics(documents), "statistics")
    sizes = stats.where("word IS NULL").select("lang", F.col("in_documents").alias("documents"))
    by_chance = (F.col("in_units") / F.col("documents")) / (1 - F.exp(-F.col("in_units") / F.col("documents")))
    topical = (F.col("in_documents") <= settings.most_share * F.col("documents")) & (F.col("in_units") / F.col("in_documents") >= settings.least_burst * by_chance)
    kept = (
        stats.where("word IS NOT NULL")
        .join(F.broadcast(sizes), "lang")  # a row per language
        .where(F.col("in_documents") >= F.greatest(F.lit(2), settings.least_share * F.col("documents")))
        .select("lang", F.col("word").alias("id"), topical.alias("topical"))
    )
    spelt = paragraphs.where(F.size("met") > 0).select(F.inline("met")).groupBy("id").agg(F.first("word").alias("word"))
    out: dict[str, tuple[list[str], list[str]]] = {lang: ([], []) for lang in LANGUAGES}
    for row in kept.join(spelt, "id").collect():
        out[row.lang][0 if row.topical else 1].append(row.word)
    n = stats.where("word IS NULL").agg(F.sum("in_documents")).first()[0]
    return {lang: (sorted(topic), sorted(frame)) for lang, (topic, frame) in out.items()}, n or 0


def encode(documents: DataFrame, words: dict[str, tuple[list[str], list[str]]], slices: int) -> DataFrame:
    """Known words by their place in the vocabulary, written in slices: topic words first, then frames, by units and sentences; and each document's topic words with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, places = _Words(), {}
        for lang, (topic, frame) in words.items():
            ids = np.array([number[w] for w in topic + frame], dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            places[lang] = (ids[order], order, len(topic))
        for batch in batches:
            for lang, (ids, order, limit) in places.items():
                b = _Batch(batch, lang)
                if not len(b.rows):
                    continue
                at = np.minimum(np.searchsorted(ids, b.values), max(0, len(ids) - 1))
                known = ids[at] == b.values if len(ids) else np.zeros(len(b.values), dtype=bool)
                sentence, value = b.sentence[known], order[at[known]] if len(ids) else np.zeros(0, dtype=np.int64)
                nested = pa.array(value.astype(np.int32))
                for of, n in ((sentence, b.sentences), (b.sentence_unit, b.units), (b.unit_doc, len(b.rows))):
                    nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), nested)
                topical = value < limit
                doc = b.unit_doc[b.sentence_unit[sentence[topical]]]
                cell, times = np.unique(doc * max(1, limit) + value[topical], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(cell // max(1, limit), minlength=len(b.rows)))]).astype(np.int32))
                own, often = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cell % max(1, limit), times))
                part = batch.take(pa.array(b.rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), own, often, nested, part.column(4)], names=["doc_id", "lang", "weight", "words", "times", "units", "slice"])

    path = shared_path(documents.sparkSession, "encoded")
    rows = documents.select("doc_id", "lang", "weight", "units", F.pmod(F.xxhash64("doc_id", "units"), F.lit(slices)).cast("int").alias("slice"))
    rows.mapInArrow(run, ENCODED).write.partitionBy("slice").parquet(path)
    return documents.sparkSession.read.schema(ENCODED).parquet(path)


class _Batch:
    """Numbers of a batch's documents in one language: every token with its sentence, unit and document."""

    def __init__(self, batch: pa.RecordBatch, lang: str) -> None:
        self.rows = np.nonzero(np.array(batch.column(1).to_pylist(), dtype=object) == lang)[0]
        units = batch.column(batch.schema.get_field_index("units")).take(pa.array(self.rows))
        sentences = units.flatten()
        lists = sentences.flatten()
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n_units, n_sentences, n_tokens = (np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64) for x in (units, sentences, lists))
        self.unit_doc = np.repeat(np.arange(len(n_units)), n_units)
        self.sentence_unit = np.repeat(np.arange(len(n_sentences)), n_sentences)
        self.sentence = np.repeat(np.arange(len(n_tokens)), n_tokens)
        self.sentences, self.units = len(n_tokens), len(n_sentences)


def subject_matrix(subjects: list[str | None]) -> np.ndarray:
    """Topics x subjects: 1 where a topic is mapped to a subject."""
    out = np.zeros((len(subjects), len(SUBJECTS)), dtype=np.float32)
    for k, subject in enumerate(subjects):
        if subject:
            out[k, SUBJECTS.index(subject)] = 1
    return out


def aside_words(encoded: DataFrame, models: dict[str, list[TopicModel]], mapped: dict[str, list[np.ndarray]], frames: dict[str, list[str]], settings: TopicSettings) -> dict[str, list[str]]:
    """Frame words of each language that mark asides.

    A sentence's subject is that of most of its words' topics, over all models. It is borne out if least_others other sentences of the document have that subject. Of the
    sentences with an aside word, less than least_support are, and they speak of at least half the subjects, so that it is the frame
    and not the matter. Counted over all documents; frames x subjects reach the driver.
    """
    of_word = {lang: sum((m.counts / m.counts.sum(axis=0)).T @ to for m, to in zip(of, mapped[lang], strict=True)) / len(of) for lang, of in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros((2, len(frames[lang]) * len(SUBJECTS))) for lang in of_word}
        for batch in batches:
            for lang, weights in of_word.items():
                b = _Batch(batch, lang)
                topical = b.values < len(weights)
                at, value = b.sentence[topical], b.values[topical]
                speaks = np.column_stack([np.bincount(at, weights=weights[value, k], minlength=b.sentences) for k in range(len(SUBJECTS))])
                subject = speaks.argmax(axis=1) if b.sentences else np.zeros(0, dtype=np.int64)
                clear = speaks.max(axis=1, initial=0) >= 0.5
                doc = b.unit_doc[b.sentence_unit]
                alike = np.bincount(doc[clear] * len(SUBJECTS) + subject[clear], minlength=len(b.rows) * len(SUBJECTS))
                borne = alike[doc * len(SUBJECTS) + subject] > settings.least_others
                framed = ~topical & clear[b.sentence]
                at = b.sentence[framed]
                cell = (b.values[framed] - len(weights)) * len(SUBJECTS) + subject[at]
                weight = batch.column(2).to_numpy(zero_copy_only=False)[b.rows][doc[at]]
                sums[lang][0] += np.bincount(cell, weights=weight, minlength=sums[lang].shape[1])
                sums[lang][1] += np.bincount(cell, weights=weight * borne[at], minlength=sums[lang].shape[1])
        for lang, (n, supported) in sums.items():
            cell = np.nonzero(n)[0]
            word, subject = np.divmod(cell, len(SUBJECTS))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(word.astype(np.int32)), pa.array(subject.astype(np.int32)), pa.array(n[cell]), pa.array(supported[cell])], names=["lang", "word", "subject", "n", "supported"])

    parts = encoded.select("doc_id", "lang", "weight", "units").mapInArrow(run, "lang string, word int, subject int, n double, supported double")
    per_subject = parts.groupBy("lang", "word", "subject").agg(F.sum("n").alias("n"), F.sum("supported").alias("supported"))
    per_word = per_subject.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("supported").alias("supported"), F.count("*").alias("subjects"))
    out: dict[str, list[str]] = {lang: [] for lang in models}
    for row in per_word.where((F.col("subjects") >= len(SUBJECTS) // 2) & (F.col("supported") < settings.least_support * F.col("n"))).collect():
        out[row.lang].append(frames[row.lang][row.word])
    return {lang: sorted(found) for lang, found in out.items()}


def assign_subjects(encoded: DataFrame, models: dict[str, list[TopicModel]], mapped: dict[str, list[np.ndarray]], frames: dict[str, list[str]], asides: dict[str, list[str]], settings: TopicSettings) -> DataFrame:
    """(doc_id, subjects): for every document the sorted subjects of its paragraphs, or none.

    A paragraph has the subjects that hold least_proportion of its topic proportions in most of the models, asides left out. Paragraphs of the same words are inferred
    once per batch; same are those whose sums of random 64-bit numbers per word agree.
    """
    plans = {}
    for lang, of in models.items():
        n_words, at = len(of[0].words), {w: i for i, w in enumerate(frames[lang])}
        is_aside = np.zeros(n_words + len(at), dtype=bool)
        is_aside[[n_words + at[w] for w in asides[lang]]] = True
        plans[lang] = (n_words, [(topic_weights(m.counts), to) for m, to in zip(of, mapped[lang], strict=True)], is_aside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.zeros((batch.num_rows, len(SUBJECTS)), dtype=bool)
            for lang, (n_words, own, is_aside) in plans.items():
                b = _Batch(batch, lang)
                out = np.bincount(b.sentence, weights=is_aside[b.values], minlength=b.sentences) > 0
                kept = (b.values < n_words) & ~out[b.sentence]
                unit, value = b.sentence_unit[b.sentence[kept]], b.values[kept]
                lengths = np.bincount(unit, minlength=b.units)
                starts = np.cumsum(lengths) - lengths
                signature = np.zeros(b.units, dtype=np.uint64)
                np.add.at(signature, unit, np.random.default_rng(1).integers(0, 2**64 - 1, n_words, dtype=np.uint64)[value])
                _, first, which = np.unique(signature, return_index=True, return_inverse=True)
                holds = np.zeros((len(first), len(SUBJECTS)), dtype=bool)
                for rows, tokens, n in filled(value, np.ones(len(value)), starts[first], lengths[first], n_words):
                    votes = np.zeros((len(rows), len(SUBJECTS)), dtype=np.int64)
                    for weights, to_subject in own:
                        expected = infer(tokens, n, weights, settings.topic_prior, settings.inner_steps)[0]
                        votes += (expected / expected.sum(axis=1, keepdims=True)) @ to_subject >= settings.least_proportion
                    holds[rows] = 2 * votes > len(own)
                at, subject = np.nonzero(holds[which])
                has[b.rows[b.unit_doc[at]], subject] = True
            found = [[SUBJECTS[k] for k in np.nonzero(row)[0]] for row in has]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "subjects"])

    return encoded.select("doc_id", "lang", "units").mapInArrow(run, "doc_id bigint, subjects array<string>")


def document_subjects(documents: DataFrame, settings: TopicSettings | None = None, terms: dict[str, dict[str, set[str]]] | None = None) -> DataFrame:
    """(doc_id, subjects) of every document: topics are fitted on the given corpus, mapped, then assigned.

    ``terms``: inspected terms per language and subject, those of ``terms.py`` unless given. Null, empty and blank texts, and texts
    of procedure alone, have no subjects. Repeated rows stay; an empty corpus gives an empty result, and one too small or too even for a vocabulary
    gives no subjects.
    """
    settings = settings or TopicSettings()
    paragraphs = materialize(corpus_paragraphs(documents), "paragraphs")
    whole = weighted(paragraphs)
    words, n = vocabulary(paragraphs, whole, settings)
    slices = settings.slices(n)
    encoded = encode(whole, words, slices)
    topical, frames = ({lang: w[i] for lang, w in words.items()} for i in (0, 1))
    models = fit_topics(encoded.select("slice", "lang", "weight", "words", "times"), topical, slices, settings)
    mapped = {lang: [subject_matrix(m.subjects((terms or {}).get(lang) or inspected_terms(lang), settings)) for m in of] for lang, of in models.items()}
    asides = aside_words(encoded, models, mapped, frames, settings)
    return assign_subjects(encoded, models, mapped, frames, asides, settings)
