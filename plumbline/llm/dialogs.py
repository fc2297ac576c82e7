"""Structure repair of conversations by generalised LR parsing with weighted edits.

Grammar of roles: nothing, or an optional system turn followed by pairs of a user and an assistant turn,
``dialog: | SYSTEM? pairs; pairs: pair | pairs pair; pair: USER ASSISTANT``. A pair is reduced as soon as it is complete, so
the tops of all stacks are four: nothing yet, a system turn, an open user turn, pairs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import releasing, stored

# Edit costs, white space, ends of sentences, and roles by their initial.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
SPACE = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRS}, PAIRS: {"u": USER}}
#: The role that an inserted or reroled turn takes on each top.
WANTED = {START: "u", SYSTEM: "u", USER: "a", PAIRS: "u"}
COMPLETE = (START, PAIRS)
LEGAL = {"su", "ua", "au"}
#: Distinct turns of one piece. Pieces of a long conversation are parsed apart and joined by their tops.
PIECE = 1024


def put(tops: dict, top: int, cost: int, audit: str) -> None:
    """Merge into equal tops: the least (cost, audit) stays. Among equal costs no audit is the beginning of another
    (it would lack only paid insertions), so whatever follows keeps the order."""
    if top not in tops or (cost, audit) < tops[top]:
        tops[top] = (cost, audit)


def with_insertions(tops: dict) -> dict:
    tops = dict(tops)
    for _ in range(2):  # a third insertion in a row would only come back to a top
        for top, (cost, audit) in list(tops.items()):
            put(tops, SHIFT[top][WANTED[top]], cost + COSTS["I"], audit + "I")
    return tops


def parsed(tops: dict, initial: str, unusable: bool, truncated: bool) -> dict:
    """All stacks after one more turn: deleted, kept where the grammar shifts it, or reroled."""
    out: dict = {}
    extra = TRUNCATED if truncated else 0
    for top, (cost, audit) in with_insertions(tops).items():
        put(out, top, cost + COSTS["D"], audit + "D")
        if not unusable:
            if initial in SHIFT[top]:
                put(out, SHIFT[top][initial], cost + COSTS["K"] + extra, audit + "K")
            put(out, SHIFT[top][WANTED[top]], cost + COSTS["R"] + extra, audit + "R")
    return out


def accepted(tops: dict) -> tuple[int, str]:
    tops = with_insertions(tops)
    return min(tops[top] for top in COMPLETE if top in tops)


class Piece:
    """Successive turns of one conversation: their faults, and what the stacks become from each top that may lie before."""

    def __init__(self, conv, entries):
        self.conv, self.turns = conv, 0
        self.tops = {e: {e: (0, "")} for e in entries}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial, blank, truncated, seen, times):
        """``times`` equal rows of one turn; ``seen``: an earlier turn has the same role and text."""
        self.turns += 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += times - 1  # no role may follow itself
        self.last = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        fresh = not (blank or seen)
        self.blank += times if blank else 0
        self.duplicate += 0 if blank else times - fresh
        self.truncated += fresh and truncated
        for entry, tops in self.tops.items():
            tops = parsed(tops, initial, not fresh, truncated)
            more = times - 1  # nothing is inserted before a deletion that may as well come after it
            self.tops[entry] = {k: (c + COSTS["D"] * more, a + "D" * more) for k, (c, a) in tops.items()} if more else tops

    def row(self, part, number):
        tops = [{"entry": e, "top": t, "cost": c, "audit": a} for e, own in self.tops.items() for t, (c, a) in own.items()]
        return (self.conv, part, number, self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.low, self.high, self.first, self.last, tops)


FIELDS = "part int, number long, blank long, duplicate long, truncated long, illegal long, distinct long, low {turn}, high {turn}, first string, last string, tops array<struct<entry:int,top:int,cost:long,audit:string>>"


def table_of(names, rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema[i].type) for i in range(len(names))], schema=schema)


def typed(spark_schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), initial, blank, truncated, seen, times: one row per distinct turn, without text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    slim = rows.select("conv_id", "turn", *marks(role, text))
    slim = stored(slim.groupBy("conv_id", "turn", "digest", "initial", "blank", "truncated").agg(F.count("*").alias("times")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # nulls first
    again = slim.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    seen = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(place)
    return slim.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left").withColumn("seen", seen).drop("_conv", "_digest", "_first", "_n")


def marks(role: Column, text: Column) -> list[Column]:
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    initial = F.substring(role, 1, 1)
    return [
        digest.alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        (~text.rlike(f"[^{SPACE}]")).alias("blank"), (~text.rlike(rf"[.!?][{SPACE}]*+\z")).alias("truncated"),
    ]


def parse_pieces(turns: DataFrame) -> DataFrame:
    """Turns in order, dealt by ranges that may cut a conversation; one row per piece of a conversation.

    Only the first conversation of a range may have begun before it; its pieces, and those after a piece of ``PIECE`` turns,
    are parsed from every top, all others from the start.
    """
    turn_type = turns.schema["turn"].dataType.simpleString()
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {conv_type}, " + FIELDS.format(turn=turn_type))
    arrow, every = typed(schema), (START, SYSTEM, USER, PAIRS)

    def parse(batches):
        from pyspark import TaskContext

        part, piece, number, ready = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for conv, turn, initial, blank, truncated, seen, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "truncated", "seen", "times"))):
                if piece is None or piece.conv != conv or piece.turns >= PIECE:
                    if piece is not None:
                        ready.append(piece.row(part, number))
                    same = piece is None or piece.conv == conv
                    piece, number = Piece(conv, every if same else (START,)), number + 1
                piece.add(turn, initial, blank, truncated, seen, times)
            if ready:
                yield table_of(schema.names, ready, arrow)
                ready = []
        if piece is not None:
            yield table_of(schema.names, [piece.row(part, number)], arrow)

    ordered = turns.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    return ordered.mapInArrow(releasing(parse), schema)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def join_pieces(pieces: DataFrame) -> DataFrame:
    """conv_id and the report of every conversation: the pieces' counts added up and their tops chained in order."""
    schema = T.StructType([pieces.schema["conv_id"], *T.StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string").fields])
    arrow = typed(schema)

    def report(own):
        tops, last, low, high, distinct = {START: (0, "")}, None, None, None, 0
        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        for p in own:
            for k in sums:
                sums[k] += p[k]
            sums["illegal"] += last is not None and last + p["first"] not in LEGAL
            last = p["last"]
            if p["low"] is not None:
                distinct += p["distinct"] - (high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
            after: dict = {}
            for t in p["tops"]:
                if t["entry"] in tops:
                    cost, audit = tops[t["entry"]]
                    put(after, t["top"], cost + t["cost"], audit + t["audit"])
            tops = after
        cost, audit = accepted(tops)
        return (own[0]["conv_id"], 0 if low is None else int(high - low + 1 - distinct), *sums.values(), cost, audit)

    def join(batches):
        own: list = []
        for batch in batches:
            ready = []
            for p in batch.to_pylist():
                if own and own[0]["conv_id"] != p["conv_id"]:
                    ready.append(report(own))
                    own = []
                own.append(p)
            if ready:
                yield table_of(schema.names, ready, arrow)
        if own:
            yield table_of(schema.names, [report(own)], arrow)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(releasing(join), schema)


def conversation_reports(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit.

    Turns are taken by ``turn``, nulls first; rows of one turn by a hash of role and text. A null role or text counts as one
    space; a null conv_id is a conversation like any other; repeated rows are duplicates from the second on. Each turn has the
    first fault that applies: blank, duplicate (role and text seen earlier), truncated (no ``.!?`` at its end). ``audit``
    names the edits in order (Keep, Rerole, Delete, Insert), the least text among the cheapest. Other columns are ignored; an
    empty table gives no rows.

    Texts become digests at once. Turns are dealt over tasks by ranges of (conv_id, turn), so one long conversation is parsed
    in many pieces; a piece is a table from the tops before it to the tops after it.
    """
    return join_pieces(parse_pieces(stored(turns_of(rows))))


def edited(batches):
    """Walk rows in order of (conv_id, report first, turn, digest): yields a report row, then its edited turns (role, text, edit)."""
    head = letters = None
    top = at = 0

    def due(turn):
        """Insertions that come next, then the edit of ``turn`` if there is one."""
        nonlocal top, at
        while at < len(letters) and letters[at] == "I":
            role = WANTED[top]
            at, top = at + 1, SHIFT[top][role]
            yield None, (ROLES[role], "", "I")
        if turn is not None:
            edit, (role, text) = letters[at], turn
            at += 1
            if edit != "D":
                role = ROLES[WANTED[top]] if edit == "R" else role
                top = SHIFT[top][role[:1]]
                yield None, (role, text, edit)

    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(names, row))
            if row["is_turn"]:
                yield from due((row["role"], row["text"]))
            else:
                if head is not None:
                    yield from due(None)
                head, letters, top, at = row, row["audit"], START, 0
                yield head, None
    if head is not None:
        yield from due(None)


def with_reports(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Every conversation's report and behind it its turns, in one task and order: a hash over a whole conversation has no parts."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = rows.select("conv_id", F.lit(True).alias("is_turn"), "turn", role.alias("role"), text.alias("text")).withColumn("digest", marks(F.col("role"), F.col("text"))[0])
    both = reports.withColumn("is_turn", F.lit(False)).unionByName(turns, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", "turn", "digest").drop("turn", "digest")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The conversations of ``rows`` after repair: conv_id, place (from 0), role, text, edit (K, R or I); as ``conversation_reports`` decides.

    A conversation that loses all turns has no rows. Inserted turns have an empty text.
    """
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("place long, role string, text string, edit string").fields])
    arrow = typed(schema)

    def emit(batches):
        conv, place, ready, size = None, 0, [], 0
        for head, turn in edited(batches):
            if turn is None:
                conv, place = head["conv_id"], 0
                continue
            ready.append((conv, place, *turn))
            place, size = place + 1, size + len(turn[1])
            if len(ready) >= 4096 or size > 1 << 20:
                yield table_of(schema.names, ready, arrow)
                ready, size = [], 0
        if ready:
            yield table_of(schema.names, ready, arrow)

    return with_reports(rows, conversation_reports(rows)).mapInArrow(releasing(emit), schema)


def repair_digest(rows: DataFrame) -> DataFrame:
    """``conversation_reports`` with repaired_sha256: of the repaired turns as ``role:text``, joined by newlines."""
    reports = conversation_reports(rows)
    schema = T.StructType([*reports.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = typed(schema)

    def emit(batches):
        head, digest, first, ready = None, hashlib.sha256(), True, []
        for report, turn in edited(batches):
            if turn is not None:
                role, text, _ = turn
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
                continue
            if head is not None:
                ready.append((*(head[c] for c in schema.names[:-1]), digest.hexdigest()))
            head, digest, first = report, hashlib.sha256(), True
            if len(ready) >= 4096:
                yield table_of(schema.names, ready, arrow)
                ready = []
        if head is not None:
            ready.append((*(head[c] for c in schema.names[:-1]), digest.hexdigest()))
            yield table_of(schema.names, ready, arrow)

    return with_reports(rows, reports).mapInArrow(releasing(emit), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the CRC-32 of ``conv_id:turn`` modulo 20 (a null is one space): 0 drops
    the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    times = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"), F.explode(times).alias("_time"))
    return rows.drop("_time")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair_digest`` of the ``damaged`` conversations, one row per original conv_id; one without rows left has zeros, an empty
    audit and the hash of nothing."""
    done = repair_digest(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zeros = {c: F.coalesce(c, F.lit("" if c == "audit" else 0)) for c in REPORT}
    return out.select("conv_id", *[v.alias(c) for c, v in zeros.items()], F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
