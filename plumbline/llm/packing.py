"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import releasing, stored
from .tokens import default_tokenizer, encoded_texts

#: Pieces that are packed together in one task. More pieces make more such groups.
GROUP = 8192


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Longest first; demand of a piece: its tokens, one document, tokens squared for attention.

    Among open bins that can take the piece under every capacity, ``norm`` picks the smallest weighted norm of what would be
    left, ``dot`` the largest weighted dot product of demand and what is left. No bin: a new one.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, name, bins, n_open = np.zeros((3, 64)), np.zeros(64, np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    shortest = lengths[order[-1]] if len(order) else 0
    for i in order.tolist():
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        chosen = -1
        if n_open:
            free = left[:, :n_open]
            fits = np.flatnonzero((free[0] >= need[0]) & (free[1] >= 1) & (free[2] >= need[2]))
            if len(fits):
                rest = free[:, fits] / cap[:, None]
                if rule == "norm":
                    chosen = int(fits[np.argmin(w @ (rest - (need / cap)[:, None]) ** 2)])
                else:
                    chosen = int(fits[np.argmax((w * need / cap) @ rest)])
        if chosen < 0:
            if n_open == left.shape[1]:
                left, name = np.concatenate([left, left], 1), np.concatenate([name, name])
            chosen, n_open = n_open, n_open + 1
            left[:, chosen], name[chosen], bins = cap, bins, bins + 1
        place[i], offset[i] = name[chosen], int(cap[0] - left[0, chosen])
        left[:, chosen] -= need
        if left[0, chosen] < shortest or left[1, chosen] < 1:  # nothing fits here any more
            n_open -= 1
            left[:, chosen], name[chosen] = left[:, n_open], name[n_open]
    return place, offset


def cut_pieces(documents: DataFrame, path: str, end_id: int, tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``end_id``, cut only where longer than ``tokens``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in names}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded_texts(batch.column(1), path, end_id)):
                body = ids.astype("<u4").tobytes()
                for piece, start in enumerate(range(0, len(ids), tokens)):
                    for k, v in zip(names, (doc_id, piece, start, min(tokens, len(ids) - start), zlib.crc32(body[4 * start : 4 * (start + tokens)]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()})

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(releasing(cut, encodes=True), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    documents: DataFrame, path: str | None = None, end_id: int = 0, tokens: int = 2048, max_documents: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group: int = GROUP,
) -> DataFrame:
    """Place every piece of every document (doc_id, text) in a sequence of at most ``tokens`` tokens.

    Capacities of a sequence: tokens, documents (``tokens`` unless given) and the sum of squared piece lengths (the square of
    ``tokens`` unless given, which never binds). Pieces that fill a sequence are one by themselves; the others are dealt
    evenly into tasks of about ``group`` pieces, each packed by vector best-fit, so a task's memory does not grow with the data.
    Null text is empty (one piece holding ``end_id``); equal rows and null doc_ids are pieces like any other.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    capacity = (tokens, max_documents or tokens, max_attention or float(tokens) ** 2)
    if capacity[2] < float(tokens) ** 2:
        tokens = min(tokens, int(capacity[2] ** 0.5))
    pieces = stored(cut_pieces(documents, path or default_tokenizer(), end_id, tokens))
    n = pieces.count()

    def place(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), schema=shape)
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, weights, rule)
        table = table.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 32), pa.int64()))
        yield from table.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    shape = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return pieces.repartition(max(1, -(-n // group))).mapInArrow(releasing(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
