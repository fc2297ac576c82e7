"""Mixing sources to target shares by entropy balancing, rounded into whole copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.ordered import with_row_index, with_running_sums

from .common import stored

# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size that are ranked in one task; more of them become several parts.
PART = 1024
#: Rows of per-source or per-size figures that may be broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000
#: A source's expected words end this close to its target, relative to it.
CLOSE = 1e-7
#: Rounding goes on until a source's words are this close to its target, or no single copy brings them closer.
NEAR = 1e-4
#: Sums are taken over multiples of this, exactly, so that neither task order nor retries change a result.
GRAIN = 1024
COPY = 1 << 20


def checked(small: DataFrame) -> DataFrame:
    """A stored table marked for broadcast if it is small enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def exact_sum(value: Column) -> Column:
    return F.sum((value * GRAIN).cast("decimal(38,0)")).cast("double") / GRAIN


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and place, a hash of the row that orders equals."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """sid, source, docs, source_size, least (its smallest size above 0) and target of every source.

    ``sizes`` has source, size, n. Sources are numbered by code point, null last, and take the weights in turn. Each gets
    its weight's part of ``share`` times all words; above ``most`` times its own words it stops and the others share what
    is over. What they share per weight only rises from round to round, so one number says which sources have stopped.
    """
    totals = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    totals = stored(totals)
    named = stored(with_row_index(totals.filter("source IS NOT NULL"), ["source"], "sid"))
    numbered = named.unionByName(totals.filter("source IS NULL").withColumn("sid", F.lit(named.count()).cast("long")))
    numbered = stored(numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * float(most)
    words = numbered.agg(F.sum("source_size")).head()[0] or 0
    per_weight, before = 0.0, -1.0
    while per_weight != before:
        over = limit < F.col("weight") * per_weight
        row = numbered.agg(F.sum(F.when(over, limit).otherwise(0.0)).alias("stopped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).head()
        if not row.open:
            break
        before, per_weight = per_weight, max(per_weight, (share * words - row.stopped) / row.open)
    return numbered.withColumn("target", F.least(limit, F.col("weight") * per_weight)).drop("weight")


def rate(most: int) -> Column:
    """Expected copies of a document: exponentially tilted by its size, at most ``most``; all or none at the ends."""
    tilted = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.try_divide(F.col("size") * F.col("docs"), F.col("source_size"))))
    return F.when(F.col("target") >= most * F.col("source_size"), float(most)).when(F.col("target") <= 0, 0.0).otherwise(tilted)


def balanced(targets: DataFrame, sizes: DataFrame, most: int, rounds: int = 200) -> DataFrame:
    """``targets`` with the column ``tilt`` that makes every source's expected words meet its target.

    Of all rates between 0 and ``most`` that meet the targets, those nearest to one copy of everything in relative entropy
    are min(most, exp(tilt * size / mean size)); the tilt is the minimum of the convex dual, where expected and wanted words
    are equal. Newton's steps run for all sources at once, each a grouped sum over (source, size); a step that leaves the
    bracket around the minimum, or that is not half the one before, becomes a bisection. Only the number of sources that
    are still open comes to the driver.
    """
    tilt, log = F.col("tilt"), F.log(F.col("target") / F.col("source_size"))
    inside = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    scaled = F.col("least") * F.col("docs") / F.col("source_size")
    start = targets.withColumns({
        "open": inside, "tilt": F.lit(0.0), "step": F.when(inside, F.lit(1e300)),
        "low": F.when(inside, F.when(log < 0, log / scaled).otherwise(0.0)),
        "high": F.when(inside, F.when(log < 0, 0.0).otherwise(F.log(F.lit(float(most))) / scaled)),
    })
    state = stored(start)
    columns = state.columns
    for _ in range(rounds):
        still = state.filter("open")
        if not still.limit(1).count():
            return state
        x = F.col("size") * F.col("docs") / F.col("source_size")
        grown = F.exp(tilt * x)
        words = F.col("n") * F.col("size")
        sums = sizes.filter("size > 0").join(checked(still.select("sid", "docs", "source_size", "tilt")), "sid").groupBy("sid").agg(
            exact_sum(words * F.least(F.lit(float(most)), grown)).alias("got"), exact_sum(F.when(grown < most, words * x * grown).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        newton = tilt - F.try_divide(gap, F.col("slope"))
        low, high = F.when(gap < 0, tilt).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(tilt)
        good = newton.isNotNull() & (newton > F.col("low2")) & (newton < F.col("high2")) & (F.abs(newton - tilt) * 2 <= F.col("step"))
        moved = state.join(sums, "sid", "left").withColumns({"low2": low, "high2": high})
        moved = moved.withColumn("next", F.when(good, newton).otherwise((F.col("low2") + F.col("high2")) / 2))
        met = (F.abs(gap) <= F.greatest(F.lit(1 / GRAIN), F.col("target") * CLOSE)) | (F.col("next") == tilt)
        new = {"open": ~met, "low": F.col("low2"), "high": F.col("high2"), "step": F.abs(F.col("next") - tilt), "tilt": F.when(met, tilt).otherwise(F.col("next"))}
        state = stored(moved.select(*[F.when(F.col("open"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]))
    return state


def rounded(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` (sid, size, part, n, target and what ``rate`` reads) with ``m``, the whole copies that its n documents get together.

    Along each source's sizes, greatest first, m follows the running sum of expected copies, so it is n times the rate but
    for less than one copy. What that leaves between words and target is then closed by single copies of documents no larger
    than the rest; each pass at least halves the rest.
    """
    expected = F.greatest(F.lit(0), (F.col("n") * rate(most) * COPY).cast("long"))
    cells = cells.select("sid", "size", "part", "n", "target", expected.alias("expected"), (-F.col("size")).alias("down"))
    half = COPY // 2
    upto = with_running_sums(cells, ["down", "part"], {"upto": F.col("expected")}, ["sid"])
    copies = F.floor((F.col("upto") + half) / COPY) - F.floor((F.col("upto") - F.col("expected") + half) / COPY)
    cells = stored(upto.withColumn("m", F.least(F.greatest(copies, F.lit(0)), F.col("n") * most)).drop("upto", "expected"))
    columns = cells.columns
    while True:
        rest = cells.groupBy("sid").agg((F.max("target") - F.sum(F.col("m") * F.col("size")).cast("double")).alias("rest"), F.max("target").alias("wanted"))
        rest = stored(rest.filter(F.abs("rest") > F.greatest(F.lit(1.0), F.col("wanted") * NEAR)).select("sid", F.col("rest").cast("long").alias("rest")))
        room = F.when(F.col("rest") > 0, F.col("n") * most - F.col("m")).otherwise(F.col("m"))
        able = cells.join(checked(rest), "sid").withColumn("room", room).filter((F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (F.col("room") > 0))
        able = stored(able)
        if not able.limit(1).count():
            return cells
        upto = with_running_sums(able, ["down", "part"], {"upto": F.col("room") * F.col("size")}, ["sid"])
        left = F.abs("rest") - (F.col("upto") - F.col("room") * F.col("size"))
        taken = F.least(F.col("room"), F.greatest(F.lit(0), F.floor(left / F.col("size"))))
        change = upto.select("sid", "size", "part", (F.signum("rest").cast("long") * taken).alias("change")).filter("change != 0")
        cells = stored(cells.join(change, ["sid", "size", "part"], "left").withColumn("m", F.col("m") + F.coalesce("change", F.lit(0))).select(*columns))


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often a mix takes every document (doc_id, source, text): doc_id, source, size, source_size, target, rate, copies, taken.

    Sources share ``share`` times all words by ``weights`` (in turn, by code point, null last), none above ``most`` times its
    own words. Within a source, documents are taken at exponentially tilted rates that meet its target, and rates become
    whole copies, at most ``most``. Null text has no words; null is a source of its own; documents without words are taken
    at the tilt's rate of 1 and add nothing. Repeated rows are documents like any other; among documents of equal source and
    size a hash of the row decides, so reruns agree whatever the partitions. A table without words has targets of 0.
    Other columns are ignored.

    Texts are read once. All figures come from counts by (source, size); documents of one source and size are ranked in parts
    of about ``PART`` by their hash, so no key gathers its rows in one task.
    """
    docs = stored(sized(documents))
    counts = stored(docs.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = stored(source_targets(counts, weights, share, most))
    ids = checked(targets.select("sid", F.col("source").alias("_source")))
    by_id = lambda df: df.join(ids, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sizes = stored(by_id(counts).drop("source"))
    state = balanced(targets, sizes, most)
    large = stored(sizes.filter(F.col("n") > PART).select("sid", "size", F.ceil(F.col("n") / PART).alias("parts")))
    docs = by_id(docs).join(checked(large), ["sid", "size"], "left").withColumn("part", F.pmod("place", F.coalesce("parts", F.lit(1)))).drop("parts")
    docs = stored(docs)
    figures = checked(state.select("sid", "docs", "source_size", "target", "tilt"))
    cells = docs.groupBy("sid", "size", "part").agg(F.count("*").alias("n")).join(figures, "sid")
    cells = rounded(stored(cells), most).select("sid", "size", "part", "n", "m")
    placed = docs.join(cells, ["sid", "size", "part"])
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("place", "doc_id"))
    placed = placed.withColumn("copies", F.floor(F.col("m") / F.col("n")) + F.when(rank <= F.col("m") % F.col("n"), 1).otherwise(0)).drop("n", "m", "part")
    out = placed.join(figures, "sid").withColumn("rate", rate(most))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
