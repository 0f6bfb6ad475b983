"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its words; the document's is the noisy-or of its sentences', 1 - prod(1 - p). The
weights are fitted to document labels through the noisy-or, so sentences need no
labels, and the sentence scores then locate what offends. Only sentences with a
feature that training kept take part, in training and in scoring: others score 0,
so that a clean text's score doesn't grow with its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NON_WORD, mix, ready, word_hashes

_CEILING = 0.999
_BITS = 16
_PREFIXES = (4, 5, 6, 7, 8, 9)
#: So many words have their features worked out at once.
_WORDS = 1 << 16
_draw = np.random.default_rng(20240711)
_LETTER = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_PLACE = _draw.integers(1, 1 << 63, _PREFIXES[-1], dtype=np.uint64) | np.uint64(1)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def split_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence, start, end) of each word of a text in UTF-8.

    A sentence ends at a line feed and at white space after a full stop, question or
    exclamation mark. Only sentences with words are numbered, from 0.
    """
    words, starts, ends = word_hashes(data, NON_WORD, spans=True)
    if not len(words):
        return words, starts, starts, ends
    raw = np.frombuffer(data, dtype=np.uint8)
    border = raw == 0x0A
    border[1:] |= _BLANK[raw[1:]] & _STOP[raw[:-1]]
    at = np.searchsorted(np.flatnonzero(border), starts)
    which = np.cumsum(np.diff(at, prepend=at[0]) > 0)
    return words, which, starts, ends


def features(data: bytes, words: np.ndarray, which: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(features, sentences) of the words of a text, in blocks; a word's features are itself and its first 4 to 9 bytes.

    Inflected and compounded words share their beginnings, so one seen form speaks for others.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(words), _WORDS):
        part = slice(at, at + _WORDS)
        size = ends[part] - starts[part]
        letters = _LETTER[raw[np.minimum(starts[part, None] + np.arange(_PREFIXES[-1]), len(raw) - 1)]] * _PLACE
        sums = np.cumsum(letters, axis=1)
        found, of = [words[part]], [which[part]]
        for k in _PREFIXES:
            long = np.flatnonzero(size > k)
            found.append(mix(sums[long, k - 1] + np.uint64(k)))
            of.append(which[part][long])
        yield np.concatenate(found), np.concatenate(of)


def once_a_sentence(words: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a sentence once."""
    first = np.lexsort((words, which))
    words, which = words[first], which[first]
    keep = np.ones(len(words), dtype=bool)
    keep[1:] = (words[1:] != words[:-1]) | (which[1:] != which[:-1])
    return words[keep], which[keep]


@dataclass
class ToxicityModel:
    """Weights of the words that training kept; all others weigh nothing."""

    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.words >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, data: bytes, *split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the model, sentence) of the features that the model has, each once a sentence."""
        near, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for found, which in features(data, *split):
            close = np.flatnonzero(self.maybe[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
            near.append(found[close])
            of.append(which[close])
        words, which = once_a_sentence(np.concatenate(near), np.concatenate(of))
        if not len(words):
            return np.empty(0, np.int64), which
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[at] == words
        return at[hit], which[hit]

    def judge(self, text: str, at_least: float) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, [(start, end, score) of each sentence that scores so much]) in code points, from its first word to its last.

        The score is 0 for a text without a feature that the model has.
        """
        data = text.encode()
        split = split_words(data)
        at, of = self.hits(data, *split)
        sentences, of = np.unique(of, return_inverse=True)
        p = _CEILING / (1 + np.exp(-(self.bias + np.bincount(of, weights=self.weights[at], minlength=len(sentences)))))
        score = float(-np.expm1(np.log1p(-p).sum())) + 0.0  # never -0.0
        _, which, starts, ends = split
        found = []
        for i in np.flatnonzero(p >= at_least):
            low, high = np.searchsorted(which, [sentences[i], sentences[i] + 1])
            s, e = int(starts[low]), int(ends[high - 1])
            begin = len(data[:s].decode())
            found.append((begin, begin + len(data[s:e].decode()), float(p[i])))
        return score, found


def _telling(texts: list[str], labels: np.ndarray, min_docs: int, least_z: float, most: int) -> np.ndarray:
    """Features that toxic texts hold more often than others by so many standard deviations, the strongest ``most``, sorted."""
    seen = {0: [np.empty(0, np.uint64)], 1: [np.empty(0, np.uint64)]}
    for text, y in zip(texts, labels, strict=True):
        data = text.encode()
        seen[int(y)].append(np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(f) for f, _ in features(data, *split_words(data)))])))
    kinds, n1 = np.unique(np.concatenate(seen[1]), return_counts=True)
    others, n0 = np.unique(np.concatenate(seen[0]), return_counts=True)
    in_others = np.zeros(len(kinds))
    if len(others):
        at = np.minimum(np.searchsorted(others, kinds), len(others) - 1)
        in_others = np.where(others[at] == kinds, n0[at], 0)
    of1, of0 = (labels == 1).sum(), (labels == 0).sum()
    z = (n1 / of1 - in_others / of0) / np.sqrt(n1 / of1**2 + (in_others + 1) / of0**2)
    strong = np.flatnonzero((n1 >= min_docs) & (z >= least_z))
    return np.sort(kinds[strong[np.lexsort((kinds[strong], -z[strong]))][:most]])


def fit(texts: list[str], labels: np.ndarray, min_docs: int = 8, least_z: float = 3.0, most: int = 5000, balance: float = 0.25, rounds: int = 300, rate: float = 0.2, decay: float = 1e-4) -> ToxicityModel:
    """Gradient ascent on the documents' log likelihood through the noisy-or, with Adam's step sizes and L2 decay.

    Only features that tell are fitted (``min_docs``, ``least_z``, ``most``). Toxic
    documents weigh (others / toxic ones) ** ``balance`` times as much. Without texts
    or with one label only, the model has no features and scores all texts 0.
    """
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), 0.0)
    kinds = _telling(texts, labels, min_docs, least_z, most)
    probe = ToxicityModel(kinds, np.zeros(len(kinds)), 0.0)
    index, sents, docs, n_sent = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for d, text in enumerate(texts):
        data = text.encode()
        at, of = probe.hits(data, *split_words(data))
        sentences, of = np.unique(of, return_inverse=True)
        index.append(at)
        sents.append(of + n_sent)
        docs.append(np.full(len(sentences), d))
        n_sent += len(sentences)
    index, sent, doc = np.concatenate(index), np.concatenate(sents), np.concatenate(docs)
    y = labels[doc]
    more = ((labels == 0).sum() / (labels == 1).sum()) ** balance
    weight = np.where(y == 1, more, 1.0) / np.where(labels == 1, more, 1.0).sum()
    params = np.append(np.zeros(len(kinds)), -2.0)
    m, v = np.zeros(len(params)), np.zeros(len(params))
    for step in range(1, rounds + 1):
        z = params[-1] + np.bincount(sent, weights=params[index], minlength=n_sent)
        q = 1 / (1 + np.exp(-z))
        p = _CEILING * q
        log_none = np.bincount(doc, weights=np.log1p(-p), minlength=len(labels))[doc]
        some = np.maximum(-np.expm1(log_none), 1e-9)
        # d log P(label) / d p is 1 / (1-p) times -1 for label 0, times (1-P)/P for label 1.
        slope = np.where(y == 1, np.exp(log_none) / some, -1.0) / (1 - p) * p * (1 - q) * weight
        grad = np.append(np.bincount(index, weights=slope[sent], minlength=len(kinds)), slope.sum())
        grad[:-1] -= decay * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(kinds, params[:-1], float(params[-1]))


def train_toxicity(documents: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 15_000_000) -> ToxicityModel:
    """A model from labelled rows that aren't held out.

    At most ``rows`` labelled ids are used, those whose hash comes first, a third of
    them toxic where there are so many. Their texts are taken in that order, an id's
    texts together, leaving out those with which all would have over ``chars``
    characters, so that the driver's share stays bounded. Null ids and labels are
    left out; an id with two labels counts as toxic; each row of a repeated id counts.
    """
    spark = documents.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    take = lambda y, n: known.where(F.col("toxic") == y).orderBy("draw", "doc_id").limit(n)
    picked = take(1, rows // 3).unionAll(take(0, rows - rows // 3)).collect()
    if not picked:
        return fit([], np.empty(0, np.int64))
    ids = F.broadcast(spark.createDataFrame(picked, known.schema))
    texts = documents.select("doc_id", "text").join(ids, "doc_id")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > chars:  # which fit, the sizes alone decide
        sizes = texts.groupBy("doc_id", "draw").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy("draw", "doc_id").collect()
        fits, total = [], 0
        for r in sizes:
            if total + r["n"] <= chars:
                total += r["n"]
                fits.append((r["doc_id"],))
        texts = texts.join(F.broadcast(spark.createDataFrame(fits, "doc_id bigint")), "doc_id", "left_semi")
    got = sorted((r["draw"], r["doc_id"], r["text"] or "", r["toxic"]) for r in texts.collect())
    return fit([r[2] for r in got], np.array([r[3] for r in got], dtype=np.int64))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "toxicity", spans: str | None = None, at_least: float = 0.3) -> DataFrame:
    """All columns of ``df`` and ``score`` of the whole text, 0 for null texts and those without a feature of the model.

    With ``spans`` also the sentences that score ``at_least`` so much, as an array
    of (start, end, score). Input columns named as the new ones are replaced.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    df = df.drop(score, *([spans] if spans else []))
    where = df.columns.index(text)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = [x or "" for x in batch.column(where).to_pylist()]
            judged = [model.judge(x, at_least if spans else 2.0) for x in texts]
            scores = [j[0] for j in judged]
            columns, names = [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score]
            if spans:
                found = [[{"start": s, "end": e, "score": p} for s, e, p in j[1]] for j in judged]
                columns, names = [*columns, pa.array(found, pa.list_(item))], [*names, spans]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = df.withColumn(score, F.lit(None).cast("double"))
    if spans:
        out = out.withColumn(spans, F.lit(None).cast("array<struct<start:bigint,end:bigint,score:double>>"))
    return df.mapInArrow(run, out.schema)
