"""Benchmark passages in documents, found by Wu-Manber search over word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, extended, lower_ascii, mix, releasing, segments, text_buffer

#: Bytes of benchmark text in one pattern table; a larger benchmark is searched table after table.
TABLE_BYTES = 16 << 20


def benchmark_words() -> WordHasher:
    """Words are runs of digits, letters and bytes beyond ASCII; A-Z count as a-z."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    return WordHasher(keep, lower_ascii())


class WuManber:
    """Many strings of ``m`` words each, searched together.

    ``shift[block]`` says how far a window may move on when it ends with that block of two words: the distance from the
    block's last place in any string to the string's end, and m - 1 words for a block in no string. Where it is 0, the
    bucket of the block (the hash of a suffix) names the strings that end so, and these are compared word by word.
    All windows of a batch move in step, one per text and round, so a round is array work.
    """

    def __init__(self, strings: np.ndarray):
        strings = np.unique(strings, axis=0)
        self.strings, self.m = strings, strings.shape[1]
        self.b = min(2, self.m)
        blocks = self.blocks(strings.reshape(-1)).reshape(-1)
        within = np.arange(len(blocks)) % self.m >= self.b - 1
        shifts = self.m - 1 - np.arange(len(blocks)) % self.m
        keys, shifts = blocks[within], shifts[within]
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.shift = keys[first], shifts[first]
        ends = blocks[self.m - 1 :: self.m]
        self.members = np.argsort(ends, kind="stable")
        self.ends = ends[self.members]
        # a small table in front of the sorted keys: most blocks of a text are in no string
        self.front = np.zeros(1 << 16, bool)
        self.front[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def blocks(self, words: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each word."""
        if self.b == 1:
            return mix(words.copy())
        previous = np.empty_like(words)
        previous[1:], previous[:1] = words[:-1], 0
        return mix(previous * np.uint64(0x9E3779B97F4A7C15) + words)

    def search(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, string number) of every occurrence within texts words[first:last]."""
        places, numbers = [], []
        at = (first + self.m - 1).astype(np.int64)
        last = last.astype(np.int64)
        jump = max(1, self.m - self.b + 1)
        # long texts are walked from several starts, m - 1 words apart from the walk before, so that rounds stay few
        step = 4096
        parts = np.maximum(1, -(-(last - at) // step))
        begin = np.repeat(at, parts) + step * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(begin + step, np.repeat(last, parts))
        at = begin
        while True:
            live = at < stop
            at, stop = at[live], stop[live]
            if not len(at):
                break
            here = words[at]
            block = mix(words[at - 1] * np.uint64(0x9E3779B97F4A7C15) + here) if self.b == 2 else mix(here.copy())
            move = np.full(len(at), jump, np.int64)
            maybe = np.flatnonzero(self.front[(block & np.uint64(0xFFFF)).astype(np.int64)])
            if len(maybe):
                k = np.minimum(np.searchsorted(self.keys, block[maybe]), len(self.keys) - 1)
                known = self.keys[k] == block[maybe]
                move[maybe[known]] = self.shift[k[known]]
                zero = maybe[move[maybe] == 0]
                if len(zero):
                    lo, hi = np.searchsorted(self.ends, block[zero], "left"), np.searchsorted(self.ends, block[zero], "right")
                    n = hi - lo
                    start = np.repeat(at[zero] - self.m + 1, n)
                    string = self.members[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    same = np.ones(len(start), bool)
                    for j in range(self.m):
                        same[same] = words[start[same] + j] == self.strings[string[same], j]
                    places.append(start[same])
                    numbers.append(string[same])
                    move[zero] = 1
            at = at + move
        return (np.concatenate(places) if places else np.zeros(0, np.int64)), (np.concatenate(numbers) if numbers else np.zeros(0, np.int64))


def windows_of(texts: list[bytes], window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length in words: the windows of the texts and the number of the text each is from."""
    hasher, found = benchmark_words(), {}
    for number, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = hasher.spans(data, np.array([0, len(data)]))
        words = hasher.hashes(data, starts, ends)
        m = min(window, len(words))
        if m:
            rows = np.unique(np.lib.stride_tricks.sliding_window_view(words, m), axis=0)
            found.setdefault(m, []).append((rows, np.full(len(rows), number)))
    return {m: (np.concatenate([r for r, _ in parts]), np.concatenate([n for _, n in parts])) for m, parts in found.items()}


def find_passages(documents: DataFrame, benchmark: DataFrame, window: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in every whole text; adds to the rows of ``documents``:
    n_words, n_hit (words inside an occurrence), hit_spans (first word, last + 1), items (item_ids whose windows occur,
    ascending as strings).

    A window is ``window`` consecutive words of an item, or all words of a shorter item; an item without words (also null)
    has none. Null text has no words. A null item_id counts as the string "null". Repeated rows and items are answered
    each by itself; a column of documents with one of the added names is replaced.
    The benchmark comes in tables of ``table_bytes`` of text, each broadcast by itself; documents are never shuffled.
    """
    added = ["n_words", "n_hit", "hit_spans", "items"]
    documents = documents.drop(*added)
    spark = documents.sparkSession
    tables, ids, texts, size = [], [], [], 0

    def close():
        nonlocal ids, texts, size
        if ids:
            tables.append(spark.sparkContext.broadcast((ids, windows_of(texts, window))))
        ids, texts, size = [], [], 0

    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary")).toLocalIterator():
        ids.append(row[0])
        texts.append(bytes(row[1] or b""))
        size += len(texts[-1]) + 64
        if size > table_bytes:
            close()
    close()
    where = documents.columns.index("text")

    def built(number, kept={}):
        """Search tables of one broadcast; only the last one used stays in memory."""
        if number not in kept:
            kept.clear()
            names, windows = tables[number].value
            made = []
            for _, (rows, owner) in sorted(windows.items()):
                search = WuManber(rows)
                distinct, back = np.unique(rows, axis=0, return_inverse=True)
                back = back.reshape(-1)
                order = np.lexsort((owner, back))
                edge = np.searchsorted(back[order], np.arange(len(distinct) + 1))
                made.append((search, owner[order], edge))
            kept[number] = names, made
        return kept[number]

    def scan(batches):
        hasher = benchmark_words()
        for batch in batches:
            data, offsets = text_buffer(batch.column(where))
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for lo, hi in segments(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, text = hasher.spans(part, offsets[lo : hi + 1] - offsets[lo])
                words = hasher.hashes(part, starts, ends)
                first, last = np.searchsorted(text, np.arange(hi - lo)), np.searchsorted(text, np.arange(hi - lo), "right")
                n_words[lo:hi] = last - first
                cover = np.zeros(len(words) + 1, np.int32)
                for number in range(len(tables)):
                    names, made = built(number)
                    for search, owner, edge in made:
                        long = last - first >= search.m
                        places, strings = search.search(words, first[long], last[long])
                        np.add.at(cover, places, 1)
                        np.subtract.at(cover, places + search.m, 1)
                        for place, string in zip(text[places].tolist(), strings.tolist()):
                            items[lo + place].update(names[i] for i in owner[edge[string] : edge[string + 1]])
                inside = np.cumsum(cover[:-1]) > 0
                if inside.any():
                    n_hit[lo:hi] = np.bincount(text[inside], minlength=hi - lo)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                    for a, b in edges.reshape(-1, 2).tolist():
                        for t in range(text[a], text[b - 1] + 1):
                            spans[lo + t].append((max(a, first[t]) - first[t], min(b, last[t]) - first[t]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words), pa.array(n_hit), pa.array([[{"first": int(a), "last": int(b)} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                names=[*batch.schema.names, *added])

    return documents.mapInArrow(releasing(scan), extended(documents.schema, "n_words long, n_hit long, hit_spans array<struct<first:long,last:long>>, items array<string>"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; nulls, ties and repeated rows as in
    ``find_passages``. Without documents there are no rows, without a benchmark no hits."""
    found = find_passages(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    columns = documents.columns
    return find_passages(documents, benchmark).filter("n_hit = 0").select(*columns)
