"""Repeated passages by a distributed merge sort of suffixes that exchanges and merges by common prefixes.

Passages of ``LENGTH`` bytes that also start earlier are removed. Equal windows of that length share the least of their
``GRAM``-byte hashes at the same place (their anchor), so every window belongs to one anchor and only the suffixes at
anchors are sorted. Four steps:

1. Tasks exchange anchor hashes to learn which occur twice. Suffixes with a unique anchor are told apart by that prefix
   already and go no further.
2. Tasks sort their suffixes into runs, cut the runs at splitters and send them front-coded: each suffix only from its first
   byte that differs from the one before. Equal suffixes of a run are one.
3. A task merges the runs of its range with a loser tree in which every suffix carries its common prefix with the last
   output, so a known prefix is never compared again. The merged order and its common prefixes say which windows are equal.
4. Groups of equal anchors that a splitter cuts settle their windows by a small exchange of window digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix, stored, text_buffer

LENGTH, GRAM = 100, 32
SIDE = LENGTH - GRAM  # bytes before an anchor that its windows can reach
#: A suffix: LENGTH bytes from its anchor on, SIDE bytes backwards before it (both zero-padded), and both lengths plus one.
WIDTH = LENGTH + SIDE + 2
#: Raw bytes of a chunk of documents (a longer document is a chunk of its own), and chunks that share hash messages.
CHUNK, SHARE = 1 << 20, 8
#: An address is a chunk number and an offset below 2**31. Places of anchors are found in slabs of 2**20 bytes.
OFFSET, SLAB = 31, 20
#: Suffixes in one run; chunks per sort range; splitters at most, and sampled suffixes for each.
RUN, PER_PART, PARTS, SAMPLED = 200_000, 16, 20_000, 16
NO_ID = -(1 << 63)
#: Input partitions of which the first chunk numbers (16 bytes each) are broadcast.
BROADCAST_PARTS = 2_000_000


def chunks_of(documents: DataFrame) -> DataFrame:
    """Documents in compressed chunks: part (input partition) and n (place in it), doc_ids, ends (of the documents in the chunk), size, body."""

    def build(batches):
        from pyspark import TaskContext

        part, n, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            body = b"".join(parts)
            ends = np.cumsum([len(p) for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([n]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([len(body)]), pa.array([pa.compress(body, "zstd", asbytes=True)])],
                names=["part", "n", "doc_ids", "ends", "size", "body"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                if ids and size + len(text) > CHUNK:
                    yield row()
                    n, ids, parts, size = n + 1, [], [], 0
                ids.append(doc_id)
                parts.append(text)
                size += len(text)
        if ids:
            yield row()

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(build, "part long, n long, doc_ids array<long>, ends array<long>, size long, body binary")


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks numbered without gaps in the order of (part, n), so that a number and an offset fit an address up to 2**32 chunks.

    The prefix sum runs over one row per input partition.
    """
    sizes = chunks.groupBy("part").agg(F.count("*").alias("in_part"))
    bases = stored(sizes.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("base")))
    if (bases.agg(F.max("base")).head()[0] or 0) >= 1 << (62 - OFFSET):
        raise ValueError("more chunks than addresses")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_PARTS else bases
    return chunks.join(bases, "part").select((F.col("base") + F.col("n")).alias("chunk"), "doc_ids", "ends", "size", "body")


def opened(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first and last window start) of the anchors of all windows that lie within one document."""
    out = []
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    starts = np.concatenate([[0], ends[:-1]])
    for slab in range(0, max(1, len(data) - LENGTH + 1), (1 << SLAB) - LENGTH + 1):
        part = data[slab : slab + (1 << SLAB)]
        if len(part) < LENGTH:
            break
        h, width, base = codes[part], 1, 0x9E3779B97F4A7C15
        while width < GRAM:
            h = h[: len(h) - width] * np.uint64(base) + h[width:]
            width, base = 2 * width, base * base & 0xFFFFFFFFFFFFFFFF
        h = mix(h)
        least = (h & np.uint64(~((1 << SLAB) - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, reach = 1, SIDE + 1
        while 2 * width <= reach:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        place = (least & np.uint64((1 << SLAB) - 1)).astype(np.int64)
        inside = np.zeros(len(place) + 1, np.int8)
        a, b = np.clip(starts - slab, 0, len(place)), np.clip(ends - LENGTH + 1 - slab, 0, len(place))
        some = b > a
        np.add.at(inside, a[some], 1)
        np.subtract.at(inside, b[some], 1)
        window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if len(window):
            new = np.append(True, (place[window[1:]] != place[window[:-1]]) | (window[1:] != window[:-1] + 1))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(window)) - 1
            at = place[window[first]]
            out.append((at + slab, h[at], window[first] + slab, window[last] + slab))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


def suffix_rows(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The suffixes of anchors with windows from ``low`` to ``high``, one row of ``WIDTH`` bytes each."""
    right, left = high + LENGTH - at, at - low
    rows = np.zeros((len(at), WIDTH), np.uint8)
    step = np.arange(LENGTH)
    rows[:, :LENGTH] = np.where(step < right[:, None], data[np.minimum(at[:, None] + step, len(data) - 1)], 0)
    step = np.arange(SIDE)
    rows[:, LENGTH : LENGTH + SIDE] = np.where(step < left[:, None], data[np.maximum(at[:, None] - 1 - step, 0)], 0)
    rows[:, -2], rows[:, -1] = right + 1, left + 1
    return rows


def hash_messages(chunks: DataFrame, buckets: int, sampled: int) -> DataFrame:
    """Rows (bucket, source, hashes) of distinct 32-bit anchor hashes, and rows (sample) of one in ``sampled`` suffixes."""

    def send(batches):
        for batch in batches:
            held: dict[int, list] = {}
            for row in range(batch.num_rows):
                chunk, ends, size, body = (batch.column(c)[row].as_py() for c in (0, 2, 3, 4))
                data = opened(body, size)
                at, h, low, high = anchors(data, np.array(ends, np.int64))
                held.setdefault(chunk // SHARE, []).append(h)
                pick = np.flatnonzero(mix(h + (at - low).astype(np.uint64) * np.uint64(31) + (high - at).astype(np.uint64)) % np.uint64(max(1, sampled)) == 0)
                rows = suffix_rows(data, at[pick], low[pick], high[pick])
                if len(rows):
                    yield message(sample=[r.tobytes() for r in rows])
            for source, parts in held.items():
                h = np.concatenate(parts)
                bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
                order = np.lexsort((h >> np.uint64(32), bucket))
                bucket, short = bucket[order], (h >> np.uint64(32)).astype(np.uint32)[order]
                edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
                own, texts = [], []
                for a, b in zip(edge[:-1], edge[1:]):
                    values, n = np.unique(short[a:b], return_counts=True)
                    own.append(int(bucket[a]))
                    texts.append(values.astype("<u4").tobytes() + values[n > 1].astype("<u4").tobytes())
                    # a hash that a source holds twice is sent twice
                if own:
                    yield message(bucket=own, source=[source] * len(own), hashes=texts)

    def message(**columns):
        n = len(next(iter(columns.values())))
        kinds = {"bucket": pa.int32(), "source": pa.int64(), "hashes": pa.binary(), "sample": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()})

    return chunks.mapInArrow(send, "bucket int, source long, hashes binary, sample binary")


def repeated_hashes(messages: DataFrame) -> DataFrame:
    """Per source: list of packed (bucket, hash) of its anchors whose hash occurs twice anywhere."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(b, "<u4") for b in pdf["hashes"]]
        values, n = np.unique(np.concatenate(each), return_counts=True)
        values = values[n > 1]
        found = [(s, np.intersect1d(e, values)) for s, e in zip(pdf["source"], each)]
        found = [(s, x) for s, x in found if len(x)]
        bucket = np.uint32(pdf["bucket"].iloc[0])
        return pd.DataFrame({"source": [s for s, _ in found], "known": [np.concatenate([np.array([bucket], "<u4"), x.astype("<u4")]).tobytes() for _, x in found]})

    return messages.filter("hashes IS NOT NULL").select("bucket", "source", "hashes").groupBy("bucket").applyInPandas(answer, "source long, known binary") \
        .groupBy("source").agg(F.collect_list("known").alias("known"))


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(common prefix with the row before, remaining bytes of all rows) of sorted rows."""
    common = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        common[1:] = np.where(differs.any(1), differs.argmax(1), WIDTH)
    return common, rows[np.arange(WIDTH) >= common[:, None]].tobytes()


def decoded(common: np.ndarray, tail: bytes) -> np.ndarray:
    """The rows of a front-coded run, column by column: a byte stays until a row brings its own."""
    own = np.arange(WIDTH) >= common[:, None]
    place = np.zeros(own.shape, np.int64)
    place[own] = np.arange(int(own.sum()))
    place = np.where(own, place, -1)
    return np.frombuffer(tail, np.uint8)[np.maximum.accumulate(place, axis=0)]


def as_keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{WIDTH}").reshape(-1)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """(run, place in it, common prefix with the output before) of all items of sorted runs, in order.

    Loser tree: a head carries its common prefix with the last output. Of two heads the one that shares more is the smaller;
    if both share the same, bytes are compared from there on, and the loser then carries its prefix with the winner.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    keys = [r[0] for r in runs] + [[]] * (k - len(runs))
    commons = [r[1] for r in runs] + [[]] * (k - len(runs))
    place, head, known = [0] * k, [x[0] if x else None for x in keys], [0] * k

    def duel(i, j):
        x, y = head[i], head[j]
        if y is None:
            return i, j
        if x is None:
            return j, i
        a, b = known[i], known[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if x == y:
            known[j] = WIDTH
            return i, j
        rest = int.from_bytes(x[a:], "big") ^ int.from_bytes(y[a:], "big")
        same = WIDTH - (rest.bit_length() + 7) // 8
        if x[same] < y[same]:
            known[j] = same
            return i, j
        known[i] = same
        return j, i

    loser, winner = [0] * k, list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        left, right = (winner[2 * node - k], winner[2 * node + 1 - k]) if 2 * node >= k else (winner[k + 2 * node], winner[k + 2 * node + 1])
        winner[k + node], loser[node] = duel(left, right)
    first = winner[k + 1] if k > 1 else 0
    out_run, out_place, out_common = [], [], []
    while head[first] is not None:
        at = place[first]
        out_run.append(first)
        out_place.append(at)
        out_common.append(known[first])
        at += 1
        place[first] = at
        if at < len(keys[first]):
            head[first], known[first] = keys[first][at], commons[first][at]
        else:
            head[first] = None
        node = (first + k) >> 1
        while node:
            first, loser[node] = duel(first, loser[node])
            node >>= 1
    return out_run, out_place, out_common


SORTED = "part int, common binary, tail binary, doc_ids binary, addresses binary, chunk long, starts binary, ends binary"
FOUND = "chunk long, starts binary, ends binary, digest binary, doc_id long, address long"


def covered(start: np.ndarray, end: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, starts, ends) of the union of address ranges; a range lies within one chunk."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, (start[1:] > end[:-1]) | (start[1:] >> OFFSET != start[:-1] >> OFFSET))
    first = np.flatnonzero(new)
    start, end = start[first], end[np.append(first[1:], len(end)) - 1]
    chunk, low = start >> OFFSET, (1 << OFFSET) - 1
    edge = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]])
    return [(int(chunk[a]), (start[a:b] & low).astype("<i4"), (end[a:b] - (chunk[a:b] << OFFSET)).astype("<i4")) for a, b in zip(edge[:-1], edge[1:])]


def sorted_runs(chunks: DataFrame, known: DataFrame, buckets: int, splitters: np.ndarray) -> DataFrame:
    """Front-coded sorted runs per range, and ranges of bytes that an equal suffix of the same run already covers."""

    def sort(batches):
        held, size = [], 0

        def flush():
            rows, ids, address = (np.concatenate(c) for c in zip(*held))
            keys = as_keys(rows)
            order = np.lexsort((address, ids, keys))
            rows, ids, address, keys = rows[order], ids[order], address[order], keys[order]
            new = np.append(True, keys[1:] != keys[:-1])
            again = ~new
            if again.any():
                right, left = rows[again, -2].astype(np.int64) - 1, rows[again, -1].astype(np.int64) - 1
                for chunk, a, b in covered(address[again] - left, address[again] + right):
                    yield pa.RecordBatch.from_pydict(dict(zip(names, ([len(splitters) + 1 + chunk % (len(splitters) + 1)], *[[None]] * 4, [chunk], [a.tobytes()], [b.tobytes()]))), schema)
            rows, ids, address, keys = rows[new], ids[new], address[new], keys[new]
            cut = np.concatenate([[0], np.searchsorted(keys, splitters, "left"), [len(keys)]])
            for part in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                a, b = cut[part], cut[part + 1]
                common, tail = front_coded(rows[a:b])
                yield pa.RecordBatch.from_pydict(dict(zip(names, ([part], [common.tobytes()], [pa.compress(tail, "zstd", asbytes=True) + len(tail).to_bytes(8, "little")], [ids[a:b].tobytes()], [address[a:b].tobytes()], *[[None]] * 3))), schema)

        for batch in batches:
            for row in range(batch.num_rows):
                chunk, ids, ends, n, body, hashes = (batch.column(c)[row].as_py() for c in ("chunk", "doc_ids", "ends", "size", "body", "known"))
                if not hashes:
                    continue
                ends, data = np.array(ends, np.int64), opened(body, n)
                at, h, low, high = anchors(data, ends)
                wanted = np.concatenate([(lambda x: (np.uint64(x[0]) << np.uint64(32)) | x[1:].astype(np.uint64))(np.frombuffer(b, "<u4")) for b in hashes])
                own = (((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))
                pick = np.flatnonzero(np.isin(own, wanted))
                if not len(pick):
                    continue
                doc = np.searchsorted(ends, at[pick], "right")
                doc_ids = np.array([NO_ID if i is None else i for i in ids], np.int64)[doc]
                held.append((suffix_rows(data, at[pick], low[pick], high[pick]), doc_ids, at[pick] + (chunk << OFFSET)))
                size += len(pick)
                if size >= RUN:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    names = ["part", "common", "tail", "doc_ids", "addresses", "chunk", "starts", "ends"]
    schema = pa.schema([("part", pa.int32()), *((k, pa.binary()) for k in names[1:5]), ("chunk", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
    joined = chunks.withColumn("source", F.floor(F.col("chunk") / SHARE)).join(known, "source").drop("source")
    return joined.mapInArrow(sort, SORTED)


def merged(runs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Byte ranges to remove, and window digests of anchor groups that a splitter cuts."""
    cut_groups = np.unique(np.array([s[:GRAM].ljust(GRAM, b"\0") for s in splitters.tolist()], f"S{GRAM}")) if len(splitters) else np.zeros(0, f"S{GRAM}")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["tail"].isna().all():
            return pdf[["chunk", "starts", "ends"]].assign(digest=None, doc_id=None, address=None)
        parts, ids, address = [], [], []
        for common, tail, i, a in zip(pdf["common"], pdf["tail"], pdf["doc_ids"], pdf["addresses"]):
            common = np.frombuffer(common, np.uint8)
            parts.append((decoded(common, pa.decompress(tail[:-8], int.from_bytes(tail[-8:], "little"), "zstd", asbytes=True)), common))
            ids.append(np.frombuffer(i, np.int64))
            address.append(np.frombuffer(a, np.int64))
        lists = []
        for rows, common in parts:
            body = rows.tobytes()
            lists.append(([body[k : k + WIDTH] for k in range(0, len(body), WIDTH)], common.tolist()))
        run, place, common = merge_runs(lists)
        del lists
        shift = np.cumsum([0] + [len(r) for r, _ in parts[:-1]])
        order = shift[np.array(run)] + np.array(place)
        rows, ids, address, common = np.concatenate([r for r, _ in parts])[order], np.concatenate(ids)[order], np.concatenate(address)[order], np.array(common)
        starts, ends = [], []
        # equal suffixes: all but the earliest repeat all their windows
        group = np.cumsum(common < WIDTH) - 1
        first = np.lexsort((address, ids, group))
        early = first[np.append(True, group[first][1:] != group[first][:-1])]
        late = np.ones(len(rows), bool)
        late[early] = False
        starts.append(address[late] - rows[late, -1].astype(np.int64) + 1)
        ends.append(address[late] + rows[late, -2].astype(np.int64) - 1)
        common = common[np.append(True, group[1:] != group[:-1])] if len(group) else common
        rows, ids, address = rows[early], ids[early], address[early]
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((address, ids))] = np.arange(len(rows))
        # of anchor groups with several different suffixes, each window of each
        shared = np.append(common[1:] >= GRAM, False)
        shared[1:] |= common[1:] >= GRAM
        cut = np.isin(np.ascontiguousarray(rows[:, :GRAM]).view(f"S{GRAM}").reshape(-1), cut_groups)
        right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
        work = np.flatnonzero(shared | cut)
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        back = np.zeros(len(work), np.uint64)
        digests, kept_ids, kept_addresses = [], [], []
        for before in range(SIDE + 1):
            if before:
                back = back * np.uint64(0x9E3779B97F4A7C15) + codes[rows[work, LENGTH + before - 1]]
            after = LENGTH - before
            same = np.cumsum(common < after)[work].astype(np.uint64)
            own = np.flatnonzero((left[work] >= before) & (right[work] >= after))
            if not len(own):
                continue
            key = mix(back[own] + same[own] * np.uint64(0xC2B2AE3D27D4EB4F))
            order = np.lexsort((rank[work[own]], key))
            own, key = work[own[order]], key[order]
            lead = np.append(True, key[1:] != key[:-1])
            starts.append(address[own[~lead]] - before)
            ends.append(address[own[~lead]] - before + LENGTH)
            for k in own[lead & cut[own]].tolist():
                window = rows[k, LENGTH : LENGTH + before][::-1].tobytes() + rows[k, :after].tobytes()
                digests.append(hashlib.blake2b(window, digest_size=16).digest())
                kept_ids.append(int(ids[k]))
                kept_addresses.append(int(address[k]) - before)
        found = covered(np.concatenate(starts), np.concatenate(ends))
        out = pd.DataFrame({"chunk": [c for c, _, _ in found], "starts": [a.tobytes() for _, a, _ in found], "ends": [b.tobytes() for _, _, b in found]})
        out = pd.concat([out, pd.DataFrame({"digest": digests, "doc_id": pd.array(kept_ids, "Int64"), "address": pd.array(kept_addresses, "Int64")})])
        return out.assign(chunk=out["chunk"].astype("Int64"), doc_id=out["doc_id"].astype("Int64"), address=out["address"].astype("Int64"))[["chunk", "starts", "ends", "digest", "doc_id", "address"]]

    return runs.groupBy("part").applyInPandas(merge, FOUND)


def repeated_ranges(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, per chunk the lists of starts and ends of bytes to remove)."""
    chunks = numbered(stored(chunks_of(documents)))
    n = max(1, chunks.count())
    parts, buckets = min(PARTS, max(8, n // PER_PART)), max(64, n // 14)
    per_chunk = CHUNK * 2 // (SIDE + 2)
    messages = stored(hash_messages(chunks, buckets, max(1, n * per_chunk // (parts * SAMPLED))))
    sample = messages.filter("sample IS NOT NULL").select("sample").distinct().orderBy(F.xxhash64("sample"), "sample").limit(2 * PARTS * SAMPLED).collect()
    keys = np.sort(np.array([bytes(r[0]) for r in sample], f"S{WIDTH}")) if sample else np.zeros(0, f"S{WIDTH}")
    splitters = np.unique(keys[np.linspace(0, len(keys), parts + 1).astype(int)[1:-1]]) if len(keys) > parts else np.unique(keys)
    runs = sorted_runs(chunks, repeated_hashes(messages), buckets, splitters)
    found = stored(merged(runs, splitters))
    windows = found.filter("digest IS NOT NULL").select("digest", "doc_id", "address")
    earliest = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "address")).alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    later = windows.join(earliest, "digest").filter((F.col("doc_id") != F.col("least.doc_id")) | (F.col("address") != F.col("least.address"))).select("address")
    later = later.select(F.shiftright("address", OFFSET).alias("chunk"), F.col("address").bitwiseAND((1 << OFFSET) - 1).cast("int").alias("at"))
    whole = found.filter("starts IS NOT NULL").select("chunk", F.struct("starts", "ends").alias("ranges"), F.lit(None).cast("int").alias("at"))
    each = whole.unionByName(later.select("chunk", F.lit(None).cast(whole.schema["ranges"].dataType).alias("ranges"), "at"))
    return chunks, each.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges"), F.collect_list("at").alias("at"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes when a string of ``LENGTH`` bytes over it also starts earlier: in a document with a smaller doc_id or before
    in the same one. A null text is empty; a null doc_id comes before all others; rows with equal doc_ids come in the order
    in which the first step stored them. Texts are whole documents of up to 2 GB. Nothing but sampled splitters, at most
    2 * PARTS * SAMPLED of WIDTH bytes, comes to the driver.
    """
    chunks, ranges = repeated_ranges(documents)

    def remove(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ends, size, body, ranges, at = (batch.column(c)[row].as_py() for c in ("doc_ids", "ends", "size", "body", "ranges", "at"))
                data, mark = opened(body, size), np.zeros(size + 1, np.int32)
                for r in ranges or []:
                    np.add.at(mark, np.frombuffer(r["starts"], "<i4"), 1)
                    np.subtract.at(mark, np.frombuffer(r["ends"], "<i4"), 1)
                if at:
                    np.add.at(mark, np.array(at), 1)
                    np.subtract.at(mark, np.array(at) + LENGTH, 1)
                gone = np.cumsum(mark[:-1]) > 0
                starts = [0, *ends[:-1]]
                out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for a, b in zip(starts, ends):
                    own = gone[a:b]
                    n = int(own.sum())
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                    kept = (data[a:b][~own] if n else data[a:b]).tobytes()
                    for k, v in zip(out, (b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept)):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), kinds))], names=["doc_id", *out])

    return chunks.join(ranges, "chunk", "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeat_digest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; nulls, ties and repeated rows as in ``without_repeats``,
    no rows for an empty table."""
    return without_repeats(documents).drop("kept")
