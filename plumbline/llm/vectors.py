"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, releasing, stored

#: Dimensions of a block.
BLOCK_DIMS = 8
#: Rotated unit vectors travel as 16-bit integers, this many to one.
SCALE = 32767
#: Bytes of codes of one label and length in one tile; more become several tiles, every two of which meet in a task.
TILE_BYTES = 64 << 20
#: Labels with more than one tile that may be broadcast (40 bytes each).
BROADCAST_LABELS = 100_000
#: Keys of pairs to check again that may be broadcast.
BROADCAST_KEYS = 100_000
#: Rows of a box, visitors that look for their boxes at once, and dimensions compared first where all meet all.
BOX, VISITORS, FIRST_DIMS = 50, 32768, 24
#: About how many ns it takes to compare a visitor with a box, with a vector in a box, and with a vector where all meet all.
NS_BOX, NS_IN_BOX, NS_ALL = 0.7, 0.6, 0.5


@functools.lru_cache(4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, which spreads a distance evenly over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_keys(embeddings: DataFrame, content: str | None = None) -> DataFrame:
    """vec_id, label and key (of label and 64-bit floats), for ``content`` "body" or "code" with those floats or their code
    (``coded``); key and content are null where nothing can be linked: no vec_id, no label, no vector, a null or non-finite
    component, or all components zero."""

    def keys(batches):
        for batch in batches:
            ids, vectors, labels = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            names, contents = [None] * batch.num_rows, [None] * batch.num_rows
            starts = vectors.offsets.to_numpy()
            size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
            size[~ids.is_valid().to_numpy(zero_copy_only=False) | ~batch.column(2).is_valid().to_numpy(zero_copy_only=False)] = 0
            values, there = vectors.values.to_numpy(zero_copy_only=False), vectors.values.is_valid().to_numpy(zero_copy_only=False)
            of_label = {x: b"%d:%b" % (len(y := str(x).encode()), y) for x in set(labels)}
            for dims in np.unique(size[size > 0]):
                own = np.flatnonzero(size == dims)
                cells = starts[own][:, None] + np.arange(dims)
                own, cells = own[ok := there[cells].all(1)], cells[ok]
                v = values[cells].astype(np.float64) + 0.0
                own, v = own[ok := np.isfinite(v).all(1) & v.any(1)], v[ok]
                if not len(own):
                    continue
                kept = coded(v) if content == "code" else v
                for i, x, y in zip(own.tolist(), v, kept):
                    names[i] = hashlib.blake2b(of_label[labels[i]] + x.tobytes(), digest_size=16).digest()
                    if content:
                        contents[i] = y.tobytes()
            columns = {"vec_id": ids, "label": pa.array([None if x is None else str(x) for x in labels], pa.string()), "key": pa.array(names, pa.binary())}
            if content:
                columns[content] = pa.array(contents, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "vec_id long, label string, key binary" + (f", {content} binary" if content else "")
    return embeddings.select("vec_id", "embedding", "label").mapInArrow(releasing(keys), schema)


def coded(v: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated, in steps of 1 / SCALE. A distance of codes is off by at most ``code_error``."""
    return np.rint(unit(v) @ rotation(v.shape[1]) * SCALE).astype(np.int16)


def code_error(dims: int) -> float:
    """Half a step in each component of both vectors."""
    return np.sqrt(dims) / SCALE + 1e-9


def local_labels(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each component of the links (one, two) over 0..n-1."""
    label = np.arange(n)
    while len(one):
        low = np.minimum(label[one], label[two])
        before = label.copy()
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        label = label[label]
        if (label == before).all():
            break
    return label

def packed(classes: DataFrame) -> DataFrame:
    """Pages label, dims, c, part, nodes, mults, keys, codes: rows of one tile that a task has at once, as byte strings."""

    def pack(batches):
        for batch in batches:
            dims, part = batch.column("dims").to_numpy(), batch.column("part").to_numpy()
            label = batch.column("label").dictionary_encode().indices.to_numpy()
            order = np.lexsort((part, dims, label))
            last = np.stack([label[order], dims[order], part[order]])
            cuts = [0, *(np.flatnonzero((last[:, 1:] != last[:, :-1]).any(0)) + 1).tolist(), len(order)] if len(order) else []
            out = []
            for a, b in zip(cuts, cuts[1:]):
                own = batch.take(pa.array(order[a:b]))
                numbers = [own.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "mult")]
                out.append([*(own.column(c)[0].as_py() for c in ("label", "dims", "c", "part")), *numbers, *(b"".join(own.column(c).to_pylist()) for c in ("key", "code"))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["label", "dims", "c", "part", "nodes", "mults", "keys", "codes"])

    return classes.mapInArrow(releasing(pack), "label string, dims int, c int, part int, nodes binary, mults binary, keys binary, codes binary")


class Grid:
    """Boxes of vectors between quantiles of each component, about ``BOX`` vectors in one: rows ``first[b]`` to
    ``first[b + 1]`` of ``order`` lie in box b. Boxes ``shelf[q]`` to ``shelf[q + 1]`` agree in the first half of the components."""

    def __init__(self, v: np.ndarray):
        parts, sides, number = [1] * v.shape[1], [], np.zeros(len(v), np.int64)
        d = 0
        while np.prod(parts, dtype=float) * (parts[d] + 1) / parts[d] <= len(v) / BOX:
            parts[d] += 1
            d = (d + 1) % len(parts)
        some = v[:: max(1, len(v) >> 16)]
        for d, n in enumerate(parts):
            cuts = np.quantile(some[:, d], np.arange(1, n) / n).astype(np.float32)
            number = number * n + np.searchsorted(cuts, v[:, d])
            sides.append((np.concatenate([[-np.inf], cuts]).astype(np.float32), np.concatenate([cuts, [np.inf]]).astype(np.float32)))
        self.order = np.argsort(number, kind="stable")
        number, first = np.unique(number[self.order], return_index=True)
        self.first, self.sides = np.append(first, len(v)), sides
        self.held = np.concatenate([np.eye(n, dtype=np.float32)[i] for n, i in zip(parts, np.unravel_index(number, parts))], 1)
        half = len(parts) // 2
        self.outer = sum(parts[:half])  # rows of ``gaps`` that all boxes of a shelf share
        self.shelf = np.append(np.unique(number // int(np.prod(parts[half:])), return_index=True)[1], len(number))

    def gaps(self, v: np.ndarray) -> np.ndarray:
        """Squared distances from the sides of every component; ``held @ gaps`` are those from the boxes."""
        return np.concatenate([np.maximum(0, np.maximum(low - v[:, d : d + 1], v[:, d : d + 1] - high)) ** 2 for d, (low, high) in enumerate(self.sides)], 1).T


class Room:
    """Memory for one product at a time."""

    def __init__(self):
        self.far, self.near = np.empty(1 << 18, np.float32), np.zeros(1 << 18, bool)
        self.taken = {}

    def rows(self, place: int, v: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Rows ``own`` of ``v``, in memory that is written again with the next call for ``place``."""
        if place not in self.taken or len(self.taken[place]) < VISITORS * v.shape[1]:
            self.taken[place] = np.empty(VISITORS * v.shape[1], np.float32)
        return v.take(own, 0, out=self.taken[place][: len(own) * v.shape[1]].reshape(len(own), v.shape[1]), mode="clip")

    def meet(self, guests: np.ndarray, homes: np.ndarray, budget: float):
        """Pairs of rows at a squared distance of at most ``budget``; rows are ``as_guests`` and ``as_homes``."""
        for b in range(0, len(homes), 1024):
            h = homes[b : b + 1024].T
            width = h.shape[1]
            step = len(self.far) // width
            for a in range(0, len(guests), step):
                g = guests[a : a + step]
                size = len(g) * width
                far = np.matmul(g, h, out=self.far[:size].reshape(len(g), width)).ravel()
                if size and far.min() <= budget:
                    np.less_equal(far, budget, out=self.near[:size])
                    i = self.places(size)
                    yield a + i // width, b + i % width

    def places(self, size: int) -> np.ndarray:
        """Where ``near`` holds, eight bytes at once."""
        end = -(-size // 8) * 8
        self.near[size:end] = False
        words = np.flatnonzero(self.near[:end].view(np.uint64))
        if len(words) > end >> 6:
            return np.flatnonzero(self.near[:size])
        i, j = np.nonzero(self.near[:end].reshape(-1, 8)[words])
        return words[i] * 8 + j


def as_guests(v: np.ndarray) -> np.ndarray:
    """Rows whose products with ``as_homes`` are squared distances."""
    return np.concatenate([v, (v * v).sum(1, keepdims=True), np.ones((len(v), 1), np.float32)], 1)


def as_homes(v: np.ndarray) -> np.ndarray:
    return np.concatenate([-2 * v, np.ones((len(v), 1), np.float32), (v * v).sum(1, keepdims=True)], 1)


def floats(codes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return codes.take(columns, 1).astype(np.float32, order="C") / np.float32(SCALE)


def near_pairs(home: np.ndarray, guest: np.ndarray, same: bool, reach: float):
    """(start, i, j): guests i and homes j among which are all at a distance of ``reach`` or less, ``same`` if both are one table.

    A pair comes with the start it was found from, -1 if all met all. Around the ring of blocks there is one, the start, from
    which on the squared distances of the first, of the first two and so on are within the blocks' shares. So a guest meets
    the boxes that its share of the first block reaches, and stays if it is within the first two shares in both blocks.
    """
    dims = home.shape[1]
    parts = blocks(dims)
    share = lambda *of: float(reach**2 * sum(s.stop - s.start for s in of) / dims + 1e-5)
    columns = lambda *of: np.concatenate([np.arange(s.start, s.stop) for s in of])
    room = Room()
    for k, own in enumerate(parts if len(parts) > 1 else ()):
        after = parts[(k + 1) % len(parts)]
        h = floats(home, columns(own, after))
        width = own.stop - own.start
        grid = Grid(h[:, :width])
        if k == 0:
            asked = floats(guest[:: max(1, len(guest) // 200)], columns(own))
            reached = ((grid.held @ grid.gaps(asked) <= share(own)) * np.diff(grid.first)[:, None]).sum(0).mean()
            if len(parts) * (NS_BOX * len(grid.held) + NS_IN_BOX * reached) > NS_ALL * len(home):
                break
        h = h[grid.order]
        homes = as_homes(h)
        del h
        place = grid.order if same else np.arange(len(guest))
        for a in range(0, len(guest), VISITORS):
            g = floats(guest[place[a : a + VISITORS]], columns(own, after))
            gaps, guests = grid.gaps(g[:, :width]), as_guests(g)
            # guests that reach a shelf go on to its boxes
            outside = grid.held[grid.shelf[:-1], : grid.outer] @ gaps[: grid.outer]
            inner = np.ascontiguousarray(gaps[grid.outer :].T)
            for shelf, far in enumerate(outside):
                box, end = grid.shelf[shelf], grid.shelf[shelf + 1]
                here = np.flatnonzero(far <= share(own))
                if same:
                    end = min(end, int(np.searchsorted(grid.first[:-1], a + len(g))))
                    here = here[np.searchsorted(here, grid.first[box] - a) :]
                if not len(here) or box >= end:
                    continue
                own_guests = room.rows(0, guests, here)
                left = np.concatenate([room.rows(1, inner, here), far[here, None]], 1).T
                sides = np.concatenate([grid.held[box:end, grid.outer :], np.ones((end - box, 1), np.float32)], 1)
                for b in range(0, end - box, 16):
                    reached = sides[b : b + 16] @ left <= share(own)
                    for n, low in enumerate(grid.first[box + b : min(box + b + 16, end)]):
                        mine = np.flatnonzero(reached[n])
                        if same and low > a:
                            mine = mine[np.searchsorted(here, low - a) <= mine]
                        high = grid.first[box + b + n + 1]
                        for i, j in room.meet(room.rows(2, own_guests, mine), homes[low:high], share(own, after)):
                            i, j = a + here[mine[i]], low + j
                            if same:
                                i, j = i[i > j], j[i > j]
                            yield k, place[i], grid.order[j]
    else:
        if len(parts) > 1:
            return
    first = np.arange(min(dims, FIRST_DIMS))
    homes = as_homes(floats(home, first))
    for a in range(0, len(guest), 1024):
        guests = as_guests(floats(guest[a : a + 1024], first))
        for i, j in room.meet(guests, homes[: a + 1024] if same else homes, share(slice(0, dims))):
            i = a + i
            yield -1, *((i[i > j], j[i > j]) if same else (i, j))


def compared(home: np.ndarray, guest: np.ndarray, same: bool, limit: float):
    """(i, j, sure): all pairs of guests and homes with a squared distance of at most ``limit``, each once; a pair whose codes
    do not tell is not sure. Sums of squares of whole numbers are exact, so a pair's start is the same wherever it is found."""
    dims = home.shape[1]
    parts, root, error = blocks(dims), np.sqrt(limit), code_error(dims)
    starts = [s.start for s in parts]
    share = (root + error) ** 2 * np.array([s.stop - s.start for s in parts]) / dims * (1 + 1e-12) + 1e-12
    both = share + np.roll(share, -1) if len(parts) > 1 else share
    lead = parts[:2][-1].stop

    def checked(k, i, j):
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            if k > 0:  # most close pairs start at the first block
                square = np.add.reduceat((guest[:, :lead][x].astype(np.float64) - home[:, :lead][y]) ** 2, starts[:2], axis=1)
                ok = (square[:, 0] / SCALE**2 > share[0]) | ((square[:, 0] + square[:, 1]) / SCALE**2 > both[0])
                x, y = x[ok], y[ok]
            square = np.add.reduceat((guest[x].astype(np.float64) - home[y]) ** 2, starts, axis=1)
            if k >= 0:
                two = (square + np.roll(square, -1, 1) if len(parts) > 1 else square) / SCALE**2
                ok = (square / SCALE**2 <= share) & (two <= both)
                ok = ok.any(1) & (ok.argmax(1) == k)
                x, y, square = x[ok], y[ok], square[ok]
            far = np.sqrt(square.sum(1)) / SCALE
            ok = far <= root + error
            yield x[ok], y[ok], far[ok] < root - error

    waiting, n, now = [], 0, -1
    for k, i, j in near_pairs(home, guest, same, root + error):
        if n and (k != now or n > 1 << 16):
            yield from checked(now, *(np.concatenate(z) for z in zip(*waiting)))
            waiting, n = [], 0
        now = k
        waiting.append((i, j))
        n += len(i)
    if n:
        yield from checked(now, *(np.concatenate(z) for z in zip(*waiting)))


def join_tiles(pages: DataFrame, groups: int, cosine: float) -> DataFrame:
    """node, links (vectors linked in this tile), low (smallest node of its links' component there), key, other.

    Rows with key and other, two for each pair, are of pairs whose codes do not tell; their vectors have to be compared.
    """
    limit = 2 - 2 * cosine

    def tile(dims, i, j, pages):
        parts = []
        for part in dict.fromkeys((i, j)):
            own = [p for p in pages if p[0] == part]
            codes, at = np.empty((sum(len(p[1]) for p in own) // 8, dims), np.int16), 0
            for p in own:  # a page's codes go as soon as they are copied
                page = np.frombuffer(p.pop(), np.int16).reshape(-1, dims)
                codes[at : at + len(page)] = page
                at += len(page)
            nodes, mults, keys = (b"".join(p[c] for p in own) for c in (1, 2, 3))
            parts.append((np.frombuffer(nodes, np.int64), np.frombuffer(mults, np.int64), np.frombuffer(keys, "V16"), codes))
        own = page = None
        pages.clear()
        guest, home = parts[0][3], parts[-1][3]
        if not len(guest) or not len(home):
            return
        shift = 0 if i == j else len(guest)
        node, mult, key = (np.concatenate([p[c] for p in parts]) for c in (0, 1, 2))
        parts.clear()
        links, label, doubts = np.zeros(len(node), np.int64), np.arange(len(node)), []
        one, two, n = [], [], 0

        def joined():
            return local_labels(label[np.concatenate(one)], label[np.concatenate(two)], len(node))[label] if one else label

        for x, y, sure in compared(home, guest, i == j, limit):
            y = y + shift
            ok = node[x] != node[y]
            x, y, sure = x[ok], y[ok], sure[ok]
            if not sure.all():
                a, b = x[~sure], y[~sure]
                doubts.append((np.append(a, b), np.append(b, a)))
            x, y = x[sure], y[sure]
            np.add.at(links, x, mult[y])
            np.add.at(links, y, mult[x])
            one.append(x)
            two.append(y)
            n += len(x)
            if n > 1 << 20:
                label = joined()
                one, two, n = [], [], 0
        label = joined()
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        seen = np.flatnonzero(links > 0)
        yield node[seen], links[seen], low[label[seen]], None, None
        if doubts:
            x, y = (np.concatenate(z) for z in zip(*doubts))
            yield node[x], mult[y], np.minimum(node[x], node[y]), key[x], key[y]

    def join(batches):
        now, pages = None, []

        def found():
            for *numbers, key, other in tile(*now[1:], pages):
                for a in range(0, len(numbers[0]), 10_000):
                    names = [pa.nulls(len(numbers[0][a : a + 10_000]), pa.binary()) if x is None else pa.array([z.tobytes() for z in x[a : a + 10_000]], pa.binary()) for x in (key, other)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[a : a + 10_000]) for x in numbers), *names], names=["node", "links", "low", "key", "other"])

        for batch in batches:
            for n in range(batch.num_rows):
                of, page = ([batch.column(c)[n].as_py() for c in names] for names in (tiles, ("part", "nodes", "mults", "keys", "codes")))
                if of != now:
                    if now:
                        yield from found()
                    now, pages = of, []
                pages.append(page)
            del batch, page
        if now:
            yield from found()

    tiles = ["label", "dims", "i", "j"]
    each = pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("i", F.least("part", "k")).withColumn("j", F.greatest("part", "k")).drop("c", "k")
    count = max(1, min(8 * groups, 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return each.repartition(count, *tiles).sortWithinPartitions(*tiles).mapInArrow(releasing(join), "node long, links long, low long, key binary, other binary")


def checked_pairs(doubts: DataFrame, embeddings: DataFrame, cosine: float) -> DataFrame:
    """Of the rows of pairs whose codes do not tell (key, other), those of vectors linked at ``cosine`` or more."""

    def check(batches):
        for batch in batches:
            one, two = (batch.column(c).to_pylist() for c in ("one", "two"))
            size, ok = np.array([len(x) for x in one]), np.zeros(len(one), bool)
            for length in np.unique(size):
                own = np.flatnonzero(size == length)
                v, w = (unit(np.frombuffer(b"".join(x[i] for i in own), np.float64).reshape(len(own), -1)) for x in (one, two))
                ok[own] = (v * w).sum(1) >= cosine
            yield batch.drop_columns(["one", "two"]).filter(pa.array(ok))

    wanted = stored(doubts.select("key").distinct())
    bodies = vector_keys(embeddings, "body").select("key", "body").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "key")
    bodies = stored(bodies.groupBy("key").agg(F.first("body").alias("body")))
    pairs = doubts.join(bodies.withColumnRenamed("body", "one"), "key").join(bodies.select(F.col("key").alias("other"), F.col("body").alias("two")), "other")
    return pairs.select(*doubts.columns, "one", "two").mapInArrow(check, doubts.schema)


def near_vectors(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length are linked at ``cosine`` or more. Unit vectors so close have a squared
    distance of at most 2 - 2 * cosine; in some block of their rotated dimensions it is at most that block's share, so the
    union of the blocks' range joins holds every pair. Equal vectors are one class however many there are. What
    ``vector_keys`` calls unlinkable has no links and is its own component (null without vec_id, and kept).

    Classes travel as 16-bit codes, once for every tile of their label; all blocks are joined in the tiles' task. A pair too
    close to ``cosine`` for the codes to tell is compared in full.
    """
    linkable = vector_keys(embeddings, "code").filter("key IS NOT NULL")
    classes = stored(linkable.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("code").alias("code")))
    rows = vector_keys(embeddings).select("vec_id", "key")
    named = stored(rows.join(classes.select("key", "node", "mult"), "key", "left").select("vec_id", "node", "mult"))
    sized = classes.withColumn("dims", (F.length("code") / 2).cast("int"))
    tiles = stored(sized.groupBy("label", "dims").count().select("label", "dims", F.ceil(F.col("count") * F.col("dims") * 2 / TILE_BYTES).cast("int").alias("c")))
    groups = tiles.agg(F.sum(F.col("c") * (F.col("c") + 1) / 2)).head()[0] or 0
    full = tiles.filter("c > 1")
    sized = sized.join(F.broadcast(full) if full.count() <= BROADCAST_LABELS else full, ["label", "dims"], "left").withColumn("c", F.coalesce("c", F.lit(1)))
    pages = packed(sized.withColumn("part", F.pmod(F.xxhash64("key"), "c").cast("int")))
    found = stored(join_tiles(pages, int(groups), cosine))
    doubts = found.filter("key IS NOT NULL")
    if doubts.limit(1).count():
        found = found.filter("key IS NULL").unionByName(stored(checked_pairs(doubts, embeddings, cosine)))
    # rows that share a vec_id are one vector, with either of its classes' links
    same = named.filter("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(found.filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(same))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = named.join(links, "node", "left")
    named = named.join(labels.select(F.col("node").alias("vec_id"), F.col("label").alias("component")), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", (F.coalesce(F.col("mult") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
