"""Token ids of whole texts, and a file format that stores each id in the fewest bits its vocabulary needs."""

from __future__ import annotations

import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WordHasher, lower_ascii, releasing, segments, text_buffer

#: Ids in one block of the file format.
BLOCK = 1 << 16
#: Bytes of remembered units and their ids a worker may hold; beyond that it drops those it has not met for longest.
#: This bounds memory and changes no result.
REMEMBERED = 24 << 20
#: Bytes of text that one pass encodes; a longer text is a pass of its own.
PASS = 1 << 19
#: Units given to the library in one text.
JOINED = 64
#: Texts given to the library at once.
LEARNED = 64

# How a by-unit tokenizer cuts words, and the letters whose lower case and normal form are single letters too.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f"
PLAIN = re.compile(f"[!-;=-~{LETTERS}]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts_by_unit(tokenizer) -> bool:
    """Does a text's tokenization follow from that of its units? So it is if white space is dropped, words are cut by
    character class alone, and the last token of every word is marked."""
    said = json.loads(tokenizer.to_str())
    parts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
    return (
        [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": PRETOKENS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"] and set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds
        and said["model"].get("end_of_word_suffix") == "</w>"
    )


class UnitEncoder:
    """Ids of many texts at once, by the tokenizers library.

    For tokenizers that drop white space and cut words by character class (``cuts_by_unit``), a text's ids are the ids of its
    units in order: runs without white space, also cut between an ASCII letter and another ASCII character, unless the run
    holds an apostrophe or "<" (contractions, special tokens). Each distinct unit is encoded once while it is remembered and
    the rest is array work. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = cuts_by_unit(self.tokenizer)
        kind = np.full(256, 3, np.int8)
        kind[:128] = 2
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[65:91] = kind[97:123] = 1
        self.kind = kind
        self.hasher = WordHasher(kind > 0, np.arange(256))
        self.lower = lower_ascii()
        self.clock = 0
        self.hashes, self.first, self.count, self.met, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        if self.by_unit:
            words = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends_word = np.zeros(max(words.values()) + 1, bool)
            self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def given(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for k in range(0, len(texts), LEARNED):  # the library's results are large
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + LEARNED], add_special_tokens=False)]
        return out

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each).

        Units of which the number of words is certain go to the library many in one text; each word's last id says where it
        ends. Where the number of words is not as expected, and for other units, each is a text.
        """
        words = np.array([1 if u.isascii() and u.isalpha() else len(PIECES.findall(u.lower())) if PLAIN.fullmatch(u) else 0 for u in units], np.int64)
        counts, parts, where = np.zeros(len(units), np.int64), [], []
        sure, alone = np.flatnonzero(words), [np.flatnonzero(words == 0)]
        groups = [sure[k : k + JOINED] for k in range(0, len(sure), JOINED)]
        for own, ids in zip(groups, self.given([" ".join([units[i] for i in own.tolist()]) for own in groups])):
            last = np.flatnonzero(self.ends_word[ids])
            upto = np.cumsum(words[own])
            if len(last) == upto[-1] and last[-1] == len(ids) - 1:
                counts[own] = np.diff(last[upto - 1], prepend=-1)
                parts.append(ids)
                where.append(own)
            else:
                alone.append(own)
        alone = np.concatenate(alone)
        for i, ids in zip(alone.tolist(), self.given([units[i] for i in alone.tolist()])):
            counts[i] = len(ids)
            parts.append(ids)
        where.append(alone)
        order = np.concatenate(where)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        start = np.zeros(len(units), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        at = np.cumsum(counts) - counts
        return flat[np.repeat(start - at, counts) + np.arange(int(counts.sum()))], counts

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Remember units; both arguments in ascending order of hashes, none of which is known."""
        ids, counts = self.unit_ids(units)
        at = np.searchsorted(self.hashes, hashes)
        first = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids])
        self.hashes, self.first, self.count = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first), np.insert(self.count, at, counts)
        self.met = np.insert(self.met, at, self.clock)

    def drop_old(self) -> None:
        """Once too large, keep what was met last: half of it, and all that the present texts need."""
        if 24 * len(self.hashes) + 4 * len(self.ids) <= REMEMBERED:
            return
        keep = self.met >= max(1, int(np.median(self.met)))
        if keep.all():
            keep = self.met == self.clock
        counts = self.count[keep].astype(np.int64)
        shift = np.cumsum(counts) - counts
        self.ids = self.ids[np.repeat(self.first[keep] - shift, counts) + np.arange(int(counts.sum()))]
        self.hashes, self.first, self.count, self.met = self.hashes[keep], shift, self.count[keep], self.met[keep]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        n = len(offsets) - 1
        if not self.by_unit:
            found = self.given([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])])
            return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int64)
        starts, ends, _ = self.hasher.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind, low = self.kind[data], self.lower[data]
        inner = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2)) + 1
        odd = np.flatnonzero((data == 39) | (data == 60))
        if len(odd):
            whole = np.zeros(len(starts), bool)
            whole[np.searchsorted(starts, odd, "right") - 1] = True
            inner = inner[~whole[np.searchsorted(starts, inner, "right") - 1]]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[starts[whole]] += 1
            np.subtract.at(mark, ends[whole], 1)
            raw = np.cumsum(mark[:-1], dtype=np.int8) > 0
            low[raw] = data[raw]
        at_start = np.isin(inner, starts, assume_unique=True)
        starts, ends = np.sort(np.concatenate([starts, inner[~at_start]])), np.sort(np.concatenate([ends, inner[~at_start]]))
        hashes, where, back = np.unique(self.hasher.hashes(low, starts, ends), return_index=True, return_inverse=True)
        self.clock += 1
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            near = np.minimum(place, len(self.hashes) - 1)
            known = self.hashes[near] == hashes
            self.met[near[known]] = self.clock
        if not known.all():
            body = low.tobytes()
            fresh = where[~known]
            self.learn(hashes[~known], [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            self.drop_old()
        unit = np.searchsorted(self.hashes, hashes)[back]
        counts = self.count[unit].astype(np.int64)
        shift = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.first[unit] - shift, counts) + np.arange(int(counts.sum()))]
        text = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(text, counts, n).astype(np.int64)


def encoder(path: str) -> UnitEncoder:
    """One encoder per worker process; it hangs on ``sys`` because functions travel to workers by value."""
    kept = sys.__dict__.setdefault("_unit_encoders", {})
    if path not in kept:
        kept[path] = UnitEncoder(path)
    return kept[path]


def encoded_texts(column: pa.Array, path: str, end_id: int):
    """Per row: an array of ids with ``end_id`` at the end."""
    data, offsets = text_buffer(column)
    encode = encoder(path).encode
    for lo, hi in segments(offsets, PASS):
        ids, counts = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        last = np.cumsum(counts)
        ids = np.insert(ids, last, np.uint32(end_id))
        last += np.arange(1, len(counts) + 1)
        yield from np.split(ids, last[:-1])


def width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(body: bytes, bits: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids of a block from number ``first`` on, without unpacking those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(body, f"<u{bits // 8}")[first : None if count is None else first + count].astype(np.uint32)
    count = len(body) * 8 // bits - first if count is None else count
    skip, shift = divmod(first * bits, 8)
    need = -(-(shift + count * bits) // 8)
    flat = np.unpackbits(np.frombuffer(body, np.uint8, need, skip), bitorder="little")[shift : shift + count * bits]
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


BLOCKS = "part long, block long, first_id long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>"


def write_token_files(documents: DataFrame, folder: str, path: str, end_id: int = 2, vocabulary: int | None = None) -> None:
    """Write the ids of every text, each text followed by ``end_id``, in ascending ``doc_id`` order.

    The files are Parquet rows of blocks: ``part`` (a range of doc_ids; parts ascend), ``block`` and ``first_id`` (number of
    the block's first id in the part), the ids of the block at ``bits`` bits each, and number, start in the part and length
    of the documents that start in it. A block is found by ``part`` and ``first_id``, and an id in it by arithmetic alone.
    Null text is empty; rows with equal or null doc_ids follow each other in the order of their texts' hashes.
    """
    from tokenizers import Tokenizer

    bits = width(max(vocabulary or Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1))
    def write(batches):
        from pyspark import TaskContext

        part, block, done = TaskContext.get().partitionId(), 0, 0
        waiting, size, docs, at = [], 0, [], 0

        def flush(force):
            nonlocal block, done, waiting, size, docs
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            cut = 0
            while len(ids) - cut >= BLOCK or (force and (cut < len(ids))):
                piece = ids[cut : cut + BLOCK]
                here = [d for d in docs if d[1] < done + len(piece)]
                docs = docs[len(here) :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([block]), pa.array([done]), pa.array([len(piece)]), pa.array([bits], pa.int32()), pa.array([pack(piece, bits)])]
                    + [pa.array([[d[i] for d in here]], pa.list_(pa.int64())) for i in range(3)],
                    names=["part", "block", "first_id", "n_ids", "bits", "payload", "doc_ids", "doc_starts", "doc_lengths"])
                block, done, cut = block + 1, done + len(piece), cut + len(piece)
            waiting, size = [ids[cut:]], len(ids) - cut

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded_texts(batch.column(1), path, end_id)):
                docs.append((doc_id, at, len(ids)))
                at += len(ids)
                waiting.append(ids)
                size += len(ids)
                if size >= 8 * BLOCK:
                    yield from flush(False)
        yield from flush(True)

    # texts are dealt out, not ids: shuffled texts compress to about as much, and the ranges are found without encoding
    tie = F.xxhash64("text")
    ordered = documents.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(releasing(write, encodes=True), BLOCKS).write.option("compression", "none").parquet(folder)


def crc_joined(parts) -> int:
    """CRC-32 of a text from (CRC-32, bytes) of its parts in order, by the usual doubling of a zero-shift operator."""

    def times(m, v):
        total = 0
        for row in m:
            if not v:
                break
            if v & 1:
                total ^= row
            v >>= 1
        return total

    crc = 0
    for part, length in parts:
        shift = [0xEDB88320] + [1 << i for i in range(31)]
        for _ in range(3):
            shift = [times(shift, row) for row in shift]
        while length and crc:
            if length & 1:
                crc = times(shift, crc)
            shift = [times(shift, row) for row in shift]
            length >>= 1
        crc ^= part
    return crc


def read_token_files(spark, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32 over its ids as little-endian 32-bit integers.

    A document that spans blocks is never put together: its parts' checksums are combined.
    """
    schema = "part long, doc_start long, doc_id long, n_tokens long, first_id long, n_ids long, crc long"

    def read(batches):
        for batch in batches:
            out = {k: [] for k in ("part", "doc_start", "doc_id", "n_tokens", "first_id", "n_ids", "crc")}
            for i in range(batch.num_rows):  # a block at a time
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                body = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes()
                first, end = row["first_id"], row["first_id"] + row["n_ids"]
                docs = list(zip(row["doc_ids"], row["doc_starts"], row["doc_lengths"]))
                lead = min([d[1] for d in docs], default=end)
                for doc_id, start, length, a, b in [(None, None, None, first, lead)] * (lead > first) + [(*d, d[1], min(d[1] + d[2], end)) for d in docs]:
                    for k, v in zip(out, (row["part"], start, doc_id, length, a, b - a, zlib.crc32(body[4 * (a - first) : 4 * (b - first)]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    pieces = blocks.mapInArrow(releasing(read), schema)
    # pieces without a document belong to the last one that started before them in their part
    spanning = blocks.select("part", F.explode(F.arrays_zip("doc_starts", "doc_lengths")).alias("d"), (F.col("first_id") + F.col("n_ids")).alias("end")) \
        .select("part", F.col("d.doc_starts").alias("start"), F.col("d.doc_lengths").alias("length"), "end").filter("start + length > end")
    later = pieces.filter("doc_start IS NULL").select("part", "first_id", "n_ids", "crc")
    # the block in which a later piece lies follows from its place, so the join has a key
    keys = spanning.withColumn("first_id", F.explode(F.sequence(F.col("end"), F.col("start") + F.col("length") - 1, F.lit(BLOCK))))
    later = later.join(keys.select("part", "first_id", "start"), ["part", "first_id"]).groupBy("part", "start") \
        .agg(F.sort_array(F.collect_list(F.struct("first_id", "n_ids", "crc"))).alias("rest"))

    @F.pandas_udf("long")
    def combined(crc, n, rest):
        import pandas as pd

        return pd.Series([c if r is None else crc_joined([(c, 4 * k), *((p["crc"], 4 * p["n_ids"]) for p in r)]) for c, k, r in zip(crc, n, rest)])

    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part, that is per write task
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    whole = pieces.filter("doc_start IS NOT NULL").join(later.withColumnRenamed("start", "doc_start"), ["part", "doc_start"], "left").join(base, "part")
    return whole.select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", combined("crc", "n_ids", "rest").alias("ids_crc32"))


def token_digest(documents: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files to the shared folder, read them back and return one row per document: doc_id, start, n_tokens, ids_crc32.

    Nulls, ties and repeated rows as in ``write_token_files``; an empty table gives no rows. The files go when the session ends.
    """
    import uuid

    from plumbline.operators.materialise import ensure_checkpoint_dir, leaves_with_session

    spark = documents.sparkSession
    folder = leaves_with_session(spark, f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    write_token_files(documents, folder, path or default_tokenizer(), end_id)
    return read_token_files(spark, folder)
