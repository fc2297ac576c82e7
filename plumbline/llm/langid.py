"""Language of a text by interpolated Kneser-Ney models over characters."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended

#: Symbols are 16 bits: 0 for runs of non-letters, and every letter's lower case as it is. Letters beyond the basic plane (rare
#: ideographs and historic scripts) share the 8448 places of the basic plane that never hold a letter. So a 4-gram is one
#: 64-bit number of its real characters.
BITS, ORDER = 16, 4
NO_LETTERS, PLACES = 0xD800, 0xF900 - 0xD800
#: Symbols that one vectorised pass handles.
SYMBOLS = 1 << 20


def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not unicodedata.category(chr(c)).startswith("L"):
            continue
        low = ord(chr(c).lower()[0])
        table[c] = low if low < 0x10000 else NO_LETTERS + low % PLACES
    return table


def tables() -> np.ndarray:
    """The symbol table, once per worker process; it hangs on ``sys`` because functions travel to workers by value."""
    import sys

    kept = sys.__dict__
    if "_langid_symbols" not in kept:
        kept["_langid_symbols"] = symbol_table()
    return kept["_langid_symbols"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram code of every symbol, number of the first symbol of each text and one past the last, letters of each text).

    A text is its symbols and a closing 0; what stands before a text counts as zeros.
    """
    joined = "\n".join([*texts, ""])
    symbols = tables()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # the closing new lines
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    keep[ends] = True
    text_start = np.concatenate([[0], ends[:-1] + 1])
    keep[text_start[symbols[text_start] == 0]] = False
    keep[ends] = True
    # a non-letter right before the closing new line stands for it
    before = ends - 1
    before = before[(before >= 0) & (np.diff(np.concatenate([[-1], ends])) > 1)]
    keep[before[symbols[before] == 0]] = False
    s = symbols[keep].astype(np.uint64)
    edge = np.cumsum(keep)[ends]
    first = np.concatenate([[0], edge[:-1]])
    code = s.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(s)
        shifted[back:] = s[:-back]
        for k in range(back):  # symbols of the text before
            at = first + k
            shifted[at[at < edge]] = 0
        code |= shifted << np.uint64(BITS * back)
    letters = np.add.reduceat((s > 0).astype(np.int64), first) if len(texts) else np.zeros(0, np.int64)
    return code, np.concatenate([first, edge[-1:]]), letters


def chunks(texts: list[str]):
    """(first, last + 1) of consecutive texts of at most ``SYMBOLS`` characters together, or of one longer text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > SYMBOLS:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, code, n over every text of ``rows`` (lang, text)."""

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            codes = np.concatenate([c for c, _ in parts])
            codes, back = np.unique(codes, return_inverse=True)
            return codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in chunks(own):
                    codes, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((codes, n))
                    if len(parts) > 16:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def tail(codes: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` symbols of every gram."""
    return codes if k == ORDER else codes & np.uint64((1 << (BITS * k)) - 1)


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of every wanted number in the sorted ``keys``, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class KneserNey:
    """One language: for each order its grams in a sorted array with log probabilities, and its contexts with the log of the
    mass they give to the next shorter order. Every gram that was counted is kept.

    The highest order uses counts, shorter ones the number of different symbols seen before; each order takes its discount
    from the counts of counts and gives the discounted mass to the next shorter order, the shortest to the uniform one.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        level = {ORDER: (codes[order], counts[order].astype(float))}
        for k in range(ORDER - 1, 0, -1):  # how many symbols stand before each shorter gram
            seen, n = np.unique(tail(level[k + 1][0], k), return_counts=True)
            level[k] = seen, n.astype(float)
        self.grams, self.spare = {}, {}
        for k in range(1, ORDER + 1):
            grams, n = level[k]
            d = self.discount(n)
            context, back = np.unique(grams >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.bincount(back, n), np.bincount(back)
            spare = d * kinds / total
            shorter = np.exp(self.shorter(k - 1, grams))
            self.spare[k] = context, np.log(spare).astype(np.float32)
            self.grams[k] = grams, np.log(np.maximum(n - d, 0) / total[back] + spare[back] * shorter).astype(np.float32)

    @staticmethod
    def discount(counts: np.ndarray) -> float:
        one, two = (counts == 1).sum(), (counts == 2).sum()
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    def shorter(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol by the model of order ``k``."""
        if k == 0:
            return np.full(len(codes), -BITS * np.log(2))
        own = tail(codes, k)
        at = place(self.grams[k][0], own)
        out = np.where(at >= 0, self.grams[k][1][at], 0.0)
        new = np.flatnonzero(at < 0)
        if len(new):
            context = place(self.spare[k][0], own[new] >> np.uint64(BITS))
            out[new] = np.where(context >= 0, self.spare[k][1][context], 0.0) + self.shorter(k - 1, codes[new])
        return out

    def logp(self, codes: np.ndarray) -> np.ndarray:
        return self.shorter(ORDER, codes).astype(np.float32)


class GramTable:
    """Places of many sorted grams, most found by one look into a table of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys))  # of two keys in one slot the later stays

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(codes)]
        missed = np.flatnonzero((at < 0) | (self.keys[at] != codes))
        at[missed] = place(self.keys, codes[missed])
        return at


class LanguageModels:
    """The models of all learned languages, side by side."""

    def __init__(self, langs: list[str], models: list[KneserNey]):
        self.langs, self.models, self.accuracy = langs, models, None
        self.table = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def prepare(self) -> None:
        """One row of log probabilities per 4-gram that any language has."""
        known = np.unique(np.concatenate([m.grams[ORDER][0] for m in self.models]))
        self.table = GramTable(known)
        self.rows = np.stack([m.logp(known) for m in self.models], 1)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy in nats per symbol, texts x languages; symbols; letters)."""
        if self.table is None:
            self.prepare()
        code, edge, letters = grams(texts)
        at = self.table.find(code)
        logs = self.rows[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            codes, back = np.unique(code[new], return_inverse=True)
            logs[new] = np.stack([m.logp(codes) for m in self.models], 1)[back]
        n = np.diff(edge)
        return -np.add.reduceat(logs.astype(np.float64), edge[:-1], axis=0) / n[:, None], n, letters

    def confidence(self, margin: np.ndarray) -> np.ndarray:
        return self.accuracy[margin_bin(margin)]


def margin_bin(margin: np.ndarray) -> np.ndarray:
    """Bins of the best language's lead in nats over the whole text."""
    return np.minimum(np.floor(4 * np.log2(1 + np.maximum(margin, 0))), 63).astype(int)


def calibration(right: np.ndarray, wrong: np.ndarray, chance: float) -> np.ndarray:
    """Share of right answers per bin, never falling with the lead (pooled neighbours); two made-up answers at chance."""
    blocks = []
    for a, b in zip(right, wrong):
        blocks.append([a + 2 * chance * (a + b > 0), a + b + 2.0 * (a + b > 0), 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            x = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], x)]
    return np.concatenate([np.full(n, min(1.0, a / b if b else chance)) for a, b, n in blocks])


def predict(documents: DataFrame, shared, reject: float = 0.0) -> DataFrame:
    """Adds lang_pred, score, entropy, margin and rejected to the rows of ``documents``.

    The lowest cross-entropy per symbol wins, equal ones by name. ``score`` is the calibrated chance that the answer is right
    and ``rejected`` says that it is below ``reject``. A text that is null or without a letter is "und", score 0, rejected.
    A column with one of the added names is replaced. ``shared``: broadcast of ``LanguageModels``.
    """
    added = ["lang_pred", "score", "entropy", "margin", "rejected"]
    documents = documents.drop(*added)
    where = documents.columns.index("text")

    def run(batches):
        models = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            out = [[] for _ in added]
            for a, b in chunks(texts):
                entropy, n, letters = models.entropies(texts[a:b])
                best = entropy.argmin(1)
                ranked = np.sort(entropy, 1)
                margin = (ranked[:, 1] - ranked[:, 0]) * n if ranked.shape[1] > 1 else np.full(b - a, 1e9)
                known = letters > 0
                score = np.where(known, models.confidence(margin), 0.0) if models.accuracy is not None else np.zeros(b - a)
                names = np.where(known, np.array(models.langs, object)[best], "und")
                for k, v in enumerate((names, score, np.where(known, ranked[:, 0], 0.0), np.where(known, margin, 0.0), ~known | (score < reject))):
                    out[k] += v.tolist()
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out, kinds)], names=[*batch.schema.names, *added])

    return documents.mapInArrow(run, extended(documents.schema, "lang_pred string, score double, entropy double, margin double, rejected boolean"))


def learn(rows: DataFrame, checked: DataFrame):
    """Broadcast models learned from ``rows`` (lang, text), with confidence calibrated on ``checked`` (lang, text).

    n-grams are counted over every text on the executors; the driver gets one count per language and distinct 4-gram of
    letters (20 bytes each), none left out, and sends the models to every executor. No languages: None.
    """
    counts = count_grams(rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")).toPandas()
    if not len(counts):
        return None
    langs = sorted(set(counts["lang"]))
    models = LanguageModels(langs, [KneserNey(own["code"].to_numpy().view(np.uint64), own["n"].to_numpy()) for _, own in sorted(counts.groupby("lang"))])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(models)
    said = predict(checked.filter("lang IS NOT NULL").select(F.col("lang").alias("truth"), "text"), shared).filter("lang_pred != 'und'")
    bins = F.least(F.floor(4 * F.log2(1 + F.greatest("margin", F.lit(0.0)))), F.lit(63)).cast("int")
    tally = said.groupBy(bins.alias("bin"), (F.col("truth") == F.col("lang_pred")).alias("right")).count().collect()
    right, wrong = np.zeros(64), np.zeros(64)
    for row in tally:
        (right if row["right"] else wrong)[row["bin"]] = row["count"]
    models.accuracy = calibration(right, wrong, 1 / len(langs))
    models.table = None
    return spark.sparkContext.broadcast(models)


def identify(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Of five parts by crc32 of doc_id, part 0 is held out,
    parts 1 to 3 teach the models and part 4 calibrates them. A null doc_id is held out; rows that repeat a doc_id are answered
    each by itself; a null or empty text and a text without letters is "und". Without languages all is "und"."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    shared = learn(documents.filter(part.between(1, 3)), documents.filter(part == 4))
    rows = documents.select("doc_id", F.coalesce(part == 0, F.lit(True)).alias("held_out"), "text")
    if shared is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return predict(rows, shared, 0.5).select("doc_id", "held_out", "lang_pred", "score", "rejected")
