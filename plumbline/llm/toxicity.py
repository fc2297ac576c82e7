"""Toxicity by multiple-instance learning: a text is toxic when one of its sentences is."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, extended, forget_encoders, lower_ascii, mix, releasing, segments, text_buffer, trim

#: Labelled rows of either label that teach the model, the first by a hash of doc_id.
TAUGHT = 3000
#: A word or pair of words counts if this many taught texts hold it.
LEAST_TEXTS = 5


def sentence_features(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of all texts: (feature, its sentence), and of the sentences (text, first and last + 1 byte).

    Sentences end at ., !, ? and new lines; only those with a word count.
    """
    starts, ends, text = hasher.spans(data, offsets)
    words = hasher.hashes(data, starts, ends)
    stop = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10), out=stop[1:])
    if not len(words):
        none = np.zeros(0, np.int64)
        return words, none, none, none, none
    new = np.ones(len(words), bool)
    new[1:] = (stop[starts[1:]] != stop[ends[:-1]]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(words)) - 1
    pair = np.flatnonzero(~new)
    pairs = mix(words[pair - 1] * np.uint64(0x9E3779B97F4A7C15) + words[pair])
    return np.concatenate([words, pairs]), np.concatenate([sentence, sentence[pair]]), text[first], starts[first], ends[last]


def letters() -> WordHasher:
    keep = np.zeros(256, bool)
    keep[65:91] = keep[97:123] = keep[128:] = True
    keep[39] = True
    return WordHasher(keep, lower_ascii())


def fit(features, sentence, owner, toxic, weight, rounds: int = 300, rate: float = 0.1, sparse: float = 5e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted features, their weights and the bias of the sentence score, learned from labels of texts alone.

    A text's probability is the noisy-or of its sentences, 1 - prod(1 - p). Adam on the weighted log loss, then soft
    thresholding, so that words without evidence get no weight. features, sentence: one row per feature in a sentence.
    owner: text of each sentence; toxic, weight: per text.
    """
    _, once = np.unique(mix(features + np.uint64(0x9E3779B97F4A7C15) * sentence.astype(np.uint64)), return_index=True)
    features, sentence = features[once], sentence[once]
    _, once = np.unique(mix(features + np.uint64(0x9E3779B97F4A7C15) * owner[sentence].astype(np.uint64)), return_index=True)
    names, texts = np.unique(features[once], return_counts=True)
    names = names[texts >= LEAST_TEXTS]
    at = np.minimum(np.searchsorted(names, features), max(0, len(names) - 1))
    known = names[at] == features if len(names) else np.zeros(len(features), bool)
    at, sentence = at[known], sentence[known]
    w, bias = np.zeros(len(names)), -4.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, w[at], len(owner)), -30, 30)))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(toxic)))
        up = np.where(toxic == 1, -weight * clean / np.maximum(1 - clean, 1e-9), weight)
        slope = up[owner] * p
        g, gb = np.bincount(at, slope[sentence], len(names)), slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        pace = rate * fix / (np.sqrt(v) + 1e-4)
        w = w - pace * m
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
        bias = float(np.clip(bias - rate * fix * mb / (np.sqrt(vb) + 1e-4), -12, 2))
    keep = w != 0
    return names[keep], w[keep], bias


def learn(documents: DataFrame, labels: DataFrame, taught: int = TAUGHT):
    """(features, weights, bias) from at most ``taught`` rows of either label of ``labels`` (doc_id, toxic).

    The taught rows stand for all labelled ones by weight. Of several labels of a doc_id the largest counts; null labels and
    rows without text are left out. Without rows of both labels no text is toxic.
    """
    one = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return np.zeros(0, np.uint64), np.zeros(0), -12.0
    some = [one.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(taught) for k in (0, 1)]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_taught"), F.col("toxic").alias("_toxic"))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_taught")).filter("text IS NOT NULL")
    rows = rows.dropDuplicates(["doc_id"]).select(F.lit(0).alias("all"), "doc_id", F.col("_toxic").alias("toxic"), F.col("text").cast("binary").alias("text"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        forget_encoders()
        pdf = pdf.sort_values("doc_id")
        data, offsets = text_buffer(pa.array([bytes(t) for t in pdf["text"]], pa.large_binary()))
        hasher, texts = letters(), np.zeros(1 << 23, np.uint16)
        place = lambda f: (f & np.uint64(len(texts) - 1)).astype(np.int64)

        def parts():
            for lo, hi in segments(offsets):
                yield lo, sentence_features(hasher, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

        for _, (f, s, own, _, _) in parts():  # texts per place: no fewer than of any feature there
            _, once = np.unique(mix(f + np.uint64(0x9E3779B97F4A7C15) * own[s].astype(np.uint64)), return_index=True)
            np.add.at(texts, place(f[once]), 1)
        kept, n = [], 0
        for lo, (f, s, own, _, _) in parts():
            often = texts[place(f)] >= LEAST_TEXTS
            kept.append((f[often], s[often] + n, own + lo))
            n += len(own)
        features, sentence, owner = (np.concatenate(c) for c in zip(*kept))
        toxic = pdf["toxic"].to_numpy()
        share = {k: sizes[k] / max(1, (toxic == k).sum()) for k in sizes}
        names, w, bias = fit(features, sentence, owner, toxic, np.array([share[k] for k in toxic], float))
        trim()
        return pd.DataFrame({"names": [names.tobytes()], "weights": [w.tobytes()], "bias": [bias]})

    found = rows.groupBy("all").applyInPandas(train, "names binary, weights binary, bias double").collect()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0), -12.0
    return np.frombuffer(found[0]["names"], np.uint64), np.frombuffer(found[0]["weights"]), found[0]["bias"]


def scored(documents: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """Adds score, predicted (score >= threshold) and offending to the rows of ``documents``.

    offending: start, end (code points) and score of every sentence that alone reaches the threshold. A null or wordless
    text counts as one sentence without words. A column with one of the added names is replaced.
    """
    added = ["score", "predicted", "offending"]
    documents = documents.drop(*added)
    where = documents.columns.index("text")
    names, weights, bias = model
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        hasher = letters()
        empty = 1 / (1 + np.exp(-bias))
        for batch in batches:
            data, offsets = text_buffer(batch.column(where))
            score, offending = np.full(batch.num_rows, empty), [[] for _ in range(batch.num_rows)]
            for lo, hi in segments(offsets):
                part = data[offsets[lo] : offsets[hi]]
                own = offsets[lo : hi + 1] - offsets[lo]
                features, sentence, text, first, last = sentence_features(hasher, part, own)
                if not len(text):
                    continue
                at = np.minimum(np.searchsorted(names, features), max(0, len(names) - 1))
                hit = np.flatnonzero(names[at] == features) if len(names) else np.zeros(0, np.int64)
                at, sentence = at[hit], sentence[hit]
                if len(hit):  # a feature counts once in a sentence
                    _, once = np.unique(at + sentence * np.int64(len(names)), return_index=True)
                    at, sentence = at[once], sentence[once]
                p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence, weights[at], len(text)), -30, 30)))
                logs = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), hi - lo)
                some = np.bincount(text, minlength=hi - lo) > 0
                score[lo:hi][some] = -np.expm1(logs[some])
                for k in np.flatnonzero(p >= threshold).tolist():
                    t = int(text[k])
                    chars = lambda a, b: len(part[a:b].tobytes().decode("utf-8", "replace"))
                    start = chars(own[t], first[k])
                    offending[lo + t].append({"start": start, "end": start + chars(first[k], last[k]), "score": float(p[k])})
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(offending, place)], names=[*batch.schema.names, *added])

    return documents.mapInArrow(releasing(run), extended(documents.schema, "score double, predicted int, offending array<struct<start:long,end:long,score:double>>"))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, offending. Labels of held-out documents teach nothing."""
    model = learn(documents, labels.filter(~held_out()))
    return scored(documents.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    columns = documents.columns
    model = learn(documents, labels.filter(~held_out()))
    own = documents.withColumnsRenamed({c: f"_own_{c}" for c in ("score", "predicted", "offending") if c in columns})
    kept = scored(own, model).filter("predicted = 0").drop("score", "predicted", "offending")
    return kept.withColumnsRenamed({f"_own_{c}": c for c in columns}).select(*columns)
