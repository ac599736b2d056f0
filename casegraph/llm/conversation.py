"""Conversation structure repair: error-correcting Earley parsing of role sequences.

The grammar says what a conversation looks like: nothing, or a system message perhaps and then pairs of a user's and an
assistant's message. Beside the productions that keep a message as it is stand error productions at a cost: delete a
message, give it another role, insert an empty one. A chart item holds the least (cost, audit) of its derivations, an audit
being the edits' initials in their order; the completed start symbol yields the repair. Audits that derive the same item over the same messages
at one cost never begin one another (an insertion more would cost more), so the least of two stays the least whatever follows, and
an item needs one derivation only. The productions are left-linear, so items begin in column 0 or where they stand, and
the chart keeps the columns that live items begin in.

No task holds a long conversation's messages. Rows without their texts are ranged over tasks in the order of (conversation,
turn, role, text); each stretch of SEGMENT of them is parsed by itself, from every nonterminal that may stand before
it, and the stretches' charts are joined up in a second, streamed step, a row a stretch. Which messages are repetitions follows from an
aggregation of digests. The texts are shuffled once, by conversation, and stream past their conversation's
audit. What a task holds of a conversation is its audit, a letter an edit, which is one value of its row by nature, and so less
than 2**31 edits long.

Defined results: null roles and texts count as one space; a null conversation id is a conversation of its own; rows of a
null turn come first; rows of the same turn are ordered by role, by the first 64 characters of the text, then by a
digest of it; equal rows stand beside each other, and all but the first are duplicates. A role that is empty or begins with another
letter than s, u, a can't be kept. A conversation of no rows has no row here; an empty table gives an empty result;
further columns aren't looked at. Lone texts of any length pass; digests of texts are compared, not the texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import materialise

#: Messages of a stretch that is parsed at once: a power of two.
SEGMENT = 4096
#: What an edit costs, and what an undeleted truncated message adds.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: The nonterminals: S the start, Z nothing yet, Y after the system's message, U after a user's, A after an assistant's.
STATES = "ZYUA"


#: Productions (nonterminal, what it derives from, cost, letter of the audit). Lower-case symbols are edits of a message: s, u, a keep it, x gives it another role, d deletes it.
GRAMMAR = [
    ("S", "Z", 0, ""), ("S", "A", 0, ""), ("Z", "Zd", 0, ""), ("Y", "Zs", 0, ""), ("Y", "Yd", 0, ""), ("U", "Ud", 0, ""), ("A", "Ad", 0, ""),
    ("U", "Zu", 0, ""), ("U", "Yu", 0, ""), ("U", "Au", 0, ""), ("U", "Zx", 0, ""), ("U", "Yx", 0, ""), ("U", "Ax", 0, ""), ("A", "Ua", 0, ""), ("A", "Ux", 0, ""),
    ("U", "Z", INSERT, "I"), ("U", "Y", INSERT, "I"), ("U", "A", INSERT, "I"), ("A", "U", INSERT, "I"),
]

#: A message to the parser: the initial of its role, whether it must go, whether it is truncated.
Message = tuple[str, bool, bool]
Value = tuple[int, str]


def edit(symbol: str, message: Message) -> Value | None:
    """The cost and letter of an edit of a message; None where it isn't allowed."""
    initial, must_go, truncated = message
    if symbol == "d":
        return DELETE, "D"
    if must_go or symbol not in ("x", initial):
        return None
    return (REROLE if symbol == "x" else 0) + TRUNCATED * truncated, "R" if symbol == "x" else "K"


class Chart:
    """An Earley chart over the messages of a stretch. ``start``: the nonterminal that stands before it.

    An item is (production, dot, origin); a column keeps the least value of each and which wait for a nonterminal."""

    def __init__(self, start: str):
        self.rules: dict[str, list[tuple]] = {}
        for rule in [*GRAMMAR, (start, "", 0, "")]:
            self.rules.setdefault(rule[0], []).append(rule)
        self.best: dict[int, dict[tuple, Value]] = {}
        self.waiting: dict[int, dict[str, list[tuple]]] = {}
        self.at = 0
        self._fill({}, ["S"])

    def _fill(self, scanned: dict[tuple, Value], predicted: list[str]) -> None:
        """Predict and complete the items of a new column, the least value first. ``done``: what derives all messages so far, with its value."""
        best, waiting, agenda, completed = {}, {}, [], {}
        self.best[self.at], self.waiting[self.at] = best, waiting

        def offer(item: tuple, value: Value) -> None:
            if item not in best or value < best[item]:
                best[item] = value
                heapq.heappush(agenda, (value, item))

        def predict(symbol: str) -> None:
            for rule in self.rules.get(symbol, ()):
                offer((rule, 0, self.at), (0, ""))

        for item, value in scanned.items():
            offer(item, value)
        for symbol in predicted:
            predict(symbol)
        while agenda:
            value, item = heapq.heappop(agenda)
            if best[item] != value:
                continue
            (lhs, rhs, cost, letter), dot, origin = item
            if dot == len(rhs):
                value = value[0] + cost, value[1] + letter
                if value >= completed.get((lhs, origin), (1 << 62, "")):
                    continue
                completed[lhs, origin] = value
                for waits in tuple(self.waiting[origin].get(lhs, ())):
                    held = self.best[origin][waits]
                    offer((waits[0], waits[1] + 1, waits[2]), (held[0] + value[0], held[1] + value[1]))
            elif (symbol := rhs[dot]).isupper():
                if item not in waiting.setdefault(symbol, []):
                    waiting[symbol].append(item)
                    predict(symbol)
                if (done := completed.get((symbol, self.at))) is not None:  # it derives nothing
                    offer((item[0], dot + 1, origin), (value[0] + done[0], value[1] + done[1]))
        self.done = {lhs: value for (lhs, origin), value in completed.items() if origin == 0}
        live = {0, self.at, *(origin for _, _, origin in best)}
        for k in [k for k in self.best if k not in live]:
            del self.best[k], self.waiting[k]

    def read(self, message: Message) -> None:
        scanned: dict[tuple, Value] = {}
        for (rule, dot, origin), value in self.best[self.at].items():
            if dot < len(rule[1]) and rule[1][dot].islower() and (found := edit(rule[1][dot], message)):
                scanned[rule, dot + 1, origin] = value[0] + found[0], value[1] + found[1]
        self.at += 1
        self._fill(scanned, [])


def derived(start: str, messages: tuple[Message, ...]) -> dict[str, Value]:
    """The value of each nonterminal that derives all messages after ``start``."""
    chart = Chart(start)
    for m in messages:
        chart.read(m)
    return chart.done


#: Short conversations look alike, so a task keeps what it found for the last ones.
SHORT, KEPT = 16, 1 << 14
_derived = lru_cache(KEPT)(derived)


def parse(messages: list[Message]) -> Value:
    """The cost and audit of the cheapest repair of a whole conversation."""
    return derived("Z", tuple(messages))["S"]


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("froms", pa.list_(pa.string())), ("tos", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
])
SEGMENTS = "conv_id long, block long, froms array<string>, tos array<string>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long"
_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Stretch:
    """The messages of a conversation within a block, as they come. Only a block's first may go on from the block before, so only that is parsed from every state."""

    def __init__(self, conv_id: int | None, block: int, first_of_block: bool):
        self.key = conv_id, block
        self.starts, self.messages = STATES if first_of_block else "Z", []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def read(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
            self.turns += 1
        self.messages.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def row(self) -> tuple:
        messages = tuple(self.messages)
        values = {a: (_derived if len(messages) <= SHORT else derived)(a, messages) for a in self.starts}
        found = [(a, b, *values[a][b]) for a in self.starts for b in STATES if b in values[a]]
        return (*self.key, *([x[i] for x in found] for i in range(4)), self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.first_turn, self.last_turn, self.turns)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch of rows in order; blocks come whole."""
    at, rows = None, []
    for b in batches:
        for conv_id, block, *message in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "turn", "initial", "blank", "duplicate", "truncated")), strict=True):
            if at is None or at.key != (conv_id, block):
                new = Stretch(conv_id, block, at is None or at.key[1] != block)
                if at is not None:
                    rows.append(at.row())
                at = new
            at.read(*message)
        if len(rows) >= 1000:
            yield _batch(rows, _SEGMENT)
            rows = []
    if at is not None:
        rows.append(at.row())
        yield _batch(rows, _SEGMENT)


def _before(a: tuple, b: tuple) -> bool:
    """Whether the audit that ends at node a comes before that of b; a node is (node before, its stretch's audit)."""
    tails = [], []
    while a is not b:  # nodes of one stretch are equally far from the first
        tails[0].append(a[1])
        tails[1].append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))


class Joined:
    """The stretches of a conversation, joined up in their order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.values = conv_id, {"Z": (0, None)}
        self.counts, self.turns, self.first_turn, self.last_turn, self.last = [0, 0, 0, 0], 0, None, None, None

    def add(self, froms, tos, costs, audits, blank, duplicate, truncated, illegal, first, last, first_turn, last_turn, turns) -> None:
        new: dict[str, tuple] = {}
        for a, b, cost, audit in zip(froms, tos, costs, audits, strict=True):
            if a in self.values:
                before = self.values[a]
                value = before[0] + cost, (before[1], audit)
                if b not in new or value[0] < new[b][0] or (value[0] == new[b][0] and _before(value[1], new[b][1])):
                    new[b] = value
        self.values = new
        between = self.last is not None and self.last + first not in LEGAL
        self.counts = [n + m for n, m in zip(self.counts, (blank, duplicate, truncated, illegal + between), strict=True)]
        self.last = last
        if first_turn is not None:
            self.turns += turns - (first_turn == self.last_turn)
            self.first_turn, self.last_turn = first_turn if self.first_turn is None else self.first_turn, last_turn

    def row(self) -> tuple:
        (cost, node), *other = (self.values[s] for s in "ZA" if s in self.values)
        for c, n in other:
            if c < cost or (c == cost and _before(n, node)):
                cost, node = c, n
        audit = []
        while node is not None:
            audit.append(node[1])
            node = node[0]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.conv_id, gaps, *self.counts, cost, "".join(reversed(audit))


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rows = None, []
    for b in batches:
        columns = (b.column(f.name).to_pylist() for f in _SEGMENT)
        for conv_id, _, *stretch in zip(*columns, strict=True):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    rows.append(at.row())
                at = Joined(conv_id)
            at.add(*stretch)
        if len(rows) >= 1000:
            yield _batch(rows, _REPORT)
            rows = []
    if at is not None:
        rows.append(at.row())
        yield _batch(rows, _REPORT)


def _messages(conversations: DataFrame) -> DataFrame:
    """Rows with what orders them."""
    role, body = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    keyed = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("text"))
    return keyed.withColumns({"head": F.substring("text", 1, 64), "digest": F.md5("text")})


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("digest").asc()]


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): a conversation's faults and its cheapest repair.

    ``conversations``: conv_id, turn, role, text. A message's first fault counts: blank, without a visible character; duplicate, its role and
    text stood earlier; truncated, its last visible character is none of . ! ?. gaps: turns missing between the first and the last; illegal:
    neighbours whose roles' initials aren't su, ua or au."""
    space = " \t\n\x0b\x0c\r"
    visible = F.rtrim("text", F.lit(space))
    slim = _messages(conversations).select("conv_id", "turn", "role", "head", "digest", (F.length(visible) == 0).alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    # equal rows may be a large part of all: the last key spreads them over tasks, and which comes first makes no difference
    slim = slim.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = slim.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_order(), "salt").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), "salt")
    rows = materialise(ranged.select("conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest", "blank", "truncated", F.monotonically_increasing_id().alias("place")), "messages")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(False).alias("again"))
    flagged = rows.join(firsts, "place", "left").select("conv_id", "turn", "initial", "blank", F.coalesce("again", F.lit(True)).alias("duplicate"), "truncated", "place", F.expr(f"place div {SEGMENT}").alias("block"))
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parsing takes longer than its few bytes tell
    stretches = flagged.repartition(tasks, "block").sortWithinPartitions("place").drop("place").mapInArrow(_stretches, SEGMENTS)
    met = materialise(stretches, "stretches").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return materialise(met.mapInArrow(_join_up, REPORT), "report")


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.large_string()), ("edit", pa.string())])
REPAIRED = "conv_id long, position long, turn long, role string, text string, edit string"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])


def _apply(sink: Callable[[], object]):
    """Streams each conversation's audit and then its messages, in order, into a sink of repaired messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sink()
        audit, at, user = "", 0, True

        def inserts() -> None:
            nonlocal at, user
            while at < len(audit) and audit[at] == "I":
                out.add(None, "user" if user else "assistant", "", "I")
                user, at = not user, at + 1

        for b in batches:
            for conv_id, turn, role, text, edits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit")), strict=True):
                if edits is not None:  # a conversation begins; insertions before its first message
                    out.begin(conv_id)
                    audit, at, user = edits, 0, True
                    inserts()
                    continue
                letter = audit[at]
                at += 1
                if letter != "D":
                    kept = role if letter == "K" else "user" if user else "assistant"
                    out.add(turn, kept, text, letter)
                    user = kept[:1] != "u" if letter == "K" else not user
                inserts()
            yield from out.batches(last=False)
        out.begin(None)
        yield from out.batches(last=True)

    return run


class Rows:
    """Repaired messages as rows."""

    def __init__(self):
        self.rows, self.size = [], 0

    def begin(self, conv_id: int | None) -> None:
        self.conv_id, self.position = conv_id, 0

    def add(self, turn: int | None, role: str, text: str, letter: str) -> None:
        self.rows.append((self.conv_id, self.position, turn, role, text, letter))
        self.position += 1

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch(self.rows, _REPAIRED)
            self.rows = []


class Digests:
    """The digest of each conversation's lines ``role:text``, joined by line ends, as they pass."""

    def __init__(self):
        self.rows, self.open, self.sha, self.any = [], False, None, False

    def begin(self, conv_id: int | None) -> None:
        if self.open:
            self.rows.append((self.conv_id, self.sha.hexdigest()))
        self.conv_id, self.sha, self.open, self.any = conv_id, hashlib.sha256(), True, False

    def add(self, turn: int | None, role: str, text: str, letter: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:".encode())
        self.sha.update(text.encode())
        self.any = True

    def batches(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch(self.rows, _DIGEST)
            self.rows = []


def _applied(conversations: DataFrame, found: DataFrame, sink: Callable[[], object], schema: str) -> DataFrame:
    texts = _messages(conversations).withColumn("audit", F.lit(None).cast("string"))
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text", "head", "digest")), "audit")
    streams = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *_order())
    return streams.select("conv_id", "turn", "role", "text", "audit").mapInArrow(_apply(sink), schema)


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The messages of the repaired conversations: (conv_id, position, turn, role, text, edit); edit K, R or I, an inserted message has no turn.

    ``found``: the report on the same rows, where it is at hand."""
    return _applied(conversations, report(conversations) if found is None else found, Rows, REPAIRED)


def digests(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each repaired conversation's lines ``role:text``; its report is ``found``."""
    return _applied(conversations, found, Digests, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by a checksum of their conversation and turn modulo 20: 0 drops a row, 1 empties its text, 2 removes . ! ? from it, 3 repeats the row, 4 makes it the user's. Nulls become a space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("_k"))
    rows = rows.where("_k <> 0").withColumns({"text": F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1)))).drop("_k", "_n")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after ``damaged``, its repair and the digest of what is repaired; zeros where no row is left."""
    rows = damaged(conversations)
    found = report(rows)
    whole = found.join(digests(rows, found).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
