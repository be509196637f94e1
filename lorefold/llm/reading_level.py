"""Reading level of each document.

Method: a familiar-word formula. Words that stand in many documents of a language are its familiar
ones; a document's level grows with the share of words outside that list and with the average length
of its sentences. The weights are fitted by least squares to the raters' levels, read from at most
`max_labels` rows, the documented bound; document frequencies are counted over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions.text import WORD
from lorefold.llm.language import label_language
from lorefold.session import materialise

FAMILIAR, MAX_LABELS = 1000, 20_000
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE = re.compile(r"[.!?]+[\"'”’»)]*(?:\s|$)|[。！？]|\n+")


def reading_words(text: str) -> list[str]:
    """Words in lower case without numbers; each Chinese or Japanese character is a word."""
    if not text.isascii():
        text = _WIDE.sub(lambda m: f" {m.group()} ", text)
    return [w.lower() for w in WORD.findall(text) if not w.isdigit()]


def sentence_count(text: str) -> int:
    return sum(1 for s in _SENTENCE.split(text) if WORD.search(s))


def document_frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", flush: int = 200_000) -> DataFrame:
    """(lang, word, docs) over all documents whose label names a language. Counts are combined in the
    workers before the shuffle. Labels may be wrong now and then: a list by frequency bears it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def frame() -> pd.DataFrame:
            rows = [(k[0], k[1], n) for k, n in counts.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "docs"])

        for b in batches:
            for t, label in zip(b["t"], b["l"]):
                code = label_language(label)
                if code:
                    counts.update((code, w) for w in set(reading_words(t)))
                if len(counts) > flush:
                    yield frame()
        yield frame()

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    return rows.mapInPandas(run, "lang string, word string, docs bigint").groupBy("lang", "word").agg(F.sum("docs").alias("docs"))


def familiar_words(docs: DataFrame, size: int = FAMILIAR, text: str = "text", lang: str = "lang") -> dict[str, frozenset[str]]:
    """The `size` words of most documents of each language; ties go to the first in order. At most
    size words for each of the known languages reach the driver."""
    top = W.partitionBy("lang").orderBy(F.desc("docs"), "word")
    rows = document_frequencies(docs, text, lang).withColumn("r", F.row_number().over(top)).where(F.col("r") <= size).select("lang", "word").collect()
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r.lang, set()).add(r.word)
    return {k: frozenset(v) for k, v in out.items()}


def text_features(docs: DataFrame, familiar: dict[str, frozenset[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, sentences, unfamiliar): the share is taken against the list of the language
    that knows most of the words, so that a wrong label does no harm. A text without words has nulls."""
    kind = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(familiar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = list(shared.value.values())
        for b in batches:
            out = []
            for d, t in zip(b["d"], b["t"]):
                words = reading_words(t) if t else []
                if words:
                    counts = Counter(words)
                    known = max((sum(n for w, n in counts.items() if w in f) for f in lists), default=0)
                    out.append((d, len(words), max(1, sentence_count(t)), 1 - known / len(words)))
                else:
                    out.append((d, 0, 0, None))
            yield pd.DataFrame(out, columns=["doc_id", "words", "sentences", "unfamiliar"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null").mapInPandas(run, f"doc_id {kind}, words int, sentences int, unfamiliar double")


def fit_weights(features: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[float]:
    """Weights of (1, unfamiliar share, sentence length, its logarithm) from the raters' mean level
    per document, over at most max_labels labels, those with the smallest fingerprints."""
    bounded = labels.where("doc_id is not null and reading_level is not null").orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater", "reading_level").limit(max_labels)
    means = bounded.groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    rows = features.where("words > 0").join(F.broadcast(means), "doc_id").select("doc_id", "unfamiliar", (F.col("words") / F.col("sentences")).alias("length"), "level").distinct().drop("doc_id").collect()
    if len(rows) < 8:
        return [0.0, 2.0, 0.1, 0.5]
    u, n, y = (np.array([r[i] for r in rows], float) for i in range(3))
    a = np.column_stack([np.ones_like(u), u, np.minimum(n, 60), np.log(np.maximum(n, 1))])
    return [float(x) for x in np.linalg.solve(a.T @ a + 1e-6 * np.eye(4), a.T @ y)]


def reading_levels(docs: DataFrame, labels: DataFrame, size: int = FAMILIAR, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, words, sentences, unfamiliar, score, reading_level) of every row of docs with an id.

    score is continuous, reading_level its nearest of 1 to 5. Texts that are null or without words
    have a null score and level. Repeated rows give repeated results, very long texts are read whole.
    Without labels fixed weights are used. Columns other than doc_id, text and lang are not read."""
    familiar = familiar_words(docs, size)
    features = materialise(text_features(docs, familiar), "features")
    w = fit_weights(features, labels, max_labels)
    length = F.col("words") / F.col("sentences")
    score = F.when(F.col("words") > 0, w[0] + w[1] * F.col("unfamiliar") + w[2] * F.least(length, F.lit(60.0)) + w[3] * F.log(F.greatest(length, F.lit(1.0))))
    return features.select("doc_id", "words", "sentences", "unfamiliar", score.alias("score"), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(score + 0.5).cast("int"))).alias("reading_level")).withColumn(
        "reading_level", F.when(F.col("score").isNotNull(), F.col("reading_level"))
    )
