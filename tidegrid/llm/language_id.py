"""Language identification by mixture inference.

Per language, counts of hashed byte trigrams over all training documents give smoothed likelihoods. For a document,
expectation-maximisation estimates in what proportions the languages mix to give its trigrams. Languages then leave the
mixture, the least first, as long as the penalised likelihood improves. The largest share names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, texts_of

#: Trigram buckets; what one row of counts holds; smoothing; rounds of EM; penalty of a language, in log(trigrams) / 2.
BUCKETS, SLICE, ALPHA, ROUNDS, PENALTY = 1 << 16, 1 << 13, 0.5, 12, 4.0
NONE = "und"

_COUNTS = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("counts", pa.binary())])


@dataclass
class LanguageModel:
    """log_p: languages x buckets, float32. Its size is bounded by the number of languages."""

    langs: list[str]
    log_p: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, between spaces."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return (((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part in parts:
        by: dict[str, list] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
            by.setdefault(lang, []).append(trigrams(text))
        for lang, found in by.items():
            total[lang] = total.get(lang, 0) + np.bincount(np.concatenate(found), minlength=BUCKETS)
    yield from _rows((lang, k, n[k * SLICE : (k + 1) * SLICE]) for lang, n in total.items() for k in range(BUCKETS // SLICE))
    give_back()


def _add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    for part in parts:
        for lang, k, n in zip(*(c.to_pylist() for c in part.columns)):
            total[lang, k] = total.get((lang, k), 0) + np.frombuffer(n, np.int64)
    yield from _rows((lang, k, n) for (lang, k), n in total.items())


def _rows(found) -> Iterator[pa.RecordBatch]:
    for lang, k, n in found:
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), pa.array([n.astype(np.int64).tobytes()], pa.binary())], schema=_COUNTS)


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over all rows of docs whose lang isn't null. The driver gets languages x 65,536 counts."""
    bounded_batches(docs.sparkSession)
    ddl = "lang string, slice int, counts binary"
    counted = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, ddl)
    summed = counted.repartition("lang", "slice").mapInArrow(_add, ddl).collect()
    langs = sorted({r.lang for r in summed})
    counts = np.zeros((len(langs), BUCKETS))
    for r in summed:
        counts[langs.index(r.lang), r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, np.int64)
    return LanguageModel(langs, np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages by EM, and the log-likelihood; p: languages x trigrams."""
    total = n.sum()
    for _ in range(ROUNDS if len(share) > 1 else 0):
        share = share * (p @ (n / (share @ p))) / total
        share = np.maximum(share, 1e-9)
        share /= share.sum()
    return share, float(n @ np.log(share @ p))


def infer(model: LanguageModel, text: str | None) -> tuple[str, float, list[str]]:
    """The largest language, its share, and all languages of the mixture. No letter or no model: und, 0."""
    if not text or not model.langs or not (any("a" <= c <= "z" for c in text[:8]) or any(map(str.isalpha, set(text)))):
        return NONE, 0.0, []
    buckets = np.sort(trigrams(text), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    n = np.diff(np.append(first, len(buckets))).astype(np.float64)
    log_p = model.log_p[:, buckets[first]].astype(np.float64)
    p = np.exp(log_p - log_p.max(0))
    cost = PENALTY * 0.5 * np.log(n.sum())
    held = np.arange(len(p))
    share, fit = _mixture(p, n, np.full(len(p), 1 / len(p)))
    some = share >= 0.02
    if len(held) > 2 and some.any() and not some.all():
        # Small shares go at once where all of them together are not worth the penalty of one.
        less, worse = _mixture(p[some], n, share[some] / share[some].sum())
        if worse + cost >= fit:
            held, share, fit = held[some], less, worse
    while len(held) > 1:
        rest = np.arange(len(held)) != np.argmin(share)
        less, worse = _mixture(p[held[rest]], n, share[rest] / share[rest].sum())
        if worse + cost < fit:
            break
        held, share, fit = held[rest], less, worse
    best = int(np.argmax(share))
    return model.langs[held[best]], float(share[best]), [model.langs[i] for i in held[np.argsort(-share)]]


def language_column(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct<lang_pred, score, langs> of every whole text.

    Null or empty texts and texts without a letter are und with score 0. Ties go to the language first in order. Equal
    texts get equal results. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, langs array<string>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([infer(shared.value, t) for t in texts], columns=["lang_pred", "score", "langs"])

    return predict(F.col(text))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with the struct column language; an existing column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn("language", language_column(docs, model, text))
