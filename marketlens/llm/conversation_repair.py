"""Audit and cheapest repair of conversations.

Faults of a conversation's rows, in the order of turns, are found first: blank text, a row seen before (role and text),
text that does not end a sentence. The repair chooses an edit for each row - keep, give it another role, delete - and rows
to insert, so that the initials of the roles read ``(s?(ua)+)?`` at the least cost; of equally cheap edits the one whose
letters (the audit) come first in ASCII. This is a dynamic program over rows and four states. Its
audits are persistent: a state holds a node that names its last letter and its parent, so prefixes are shared. Nodes
know their ancestors at powers of two and a rolling hash of their letters; two equally cheap audits are compared at the first
place where they differ, found by binary lifting, and equal hashes are verified letter by letter down to a shared node.

No conversation has to fit in a task. Rows are range-partitioned by conversation, turn, role and text, so a conversation
of any length covers as many partitions as it needs. Every partition solves its own rows: a conversation that lies
within is finished there; of one that may go on in other partitions a segment is given out, with the cheapest audit
for every pair of states at its ends. Audits of equal cost over the same rows are never prefixes of one another (an insertion
costs), so segments can be joined without loss. Joining holds the letters of the segments (up to sixteen
a row) of one such conversation; of these there are at most two a partition. The digest of a repaired text is sequential by
nature: the rows of those conversations are sorted and streamed through it, no row being held.

Repeated rows are found with a grouped minimum, not by gathering a conversation, and only rows that
may be repeated are shuffled for it.

Defined results: a null role or text is one space, so is a null conversation or turn within the damage key; rows of
equal turn are in the order of role and text, and equal rows are interchangeable; null turns come first and do
not count for gaps; rows of a null conversation are one conversation; an empty text is blank; a role without initial
fits nowhere; a conversation without rows has zeros, an empty audit and the digest of an empty text;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marketlens.llm.common import in_buckets_of, stored

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
DROP, EMPTY, UNPOINTED, TWICE, AS_USER = range(5)
DAMAGE = 20

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Where an initial leads from a state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
MODULUS, BASE = (1 << 61) - 1, 1_000_003


# Audits -------------------------------------------------------------------------------


class Node:
    """An audit: its last letter and, in ``up``, its ancestors 1, 2, 4, ... letters before."""

    __slots__ = ("up", "letter", "depth", "hash")

    def __init__(self, parent: Node | None, letter: str):
        self.letter = letter
        if parent is None:
            self.up, self.depth, self.hash = [], 0, 0
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MODULUS
        up, j = [parent], 0
        while j < len(up[j].up):
            up.append(up[j].up[j])
            j += 1
        self.up = up

    def text(self) -> str:
        letters, node = [], self
        while node.up:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def _at(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def same(a: Node, b: Node) -> bool:
    """Whether audits of equal length are equal: hashes first, then letters down to a shared node."""
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def before(a: Node, b: Node) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = _at(a, depth), _at(b, depth)
    if same(x, y):
        return a.depth < b.depth
    for j in reversed(range(len(x.up))):  # up to the first letters that differ
        if j < len(x.up) and not same(x.up[j], y.up[j]):
            x, y = x.up[j], y.up[j]
    return x.letter < y.letter


class Audit:
    """Cheapest audits over the rows so far, by state, from one state before them."""

    def __init__(self, state: int, first: bool):
        self.best: list[tuple[int, Node] | None] = [None] * STATES
        self.best[state] = (0, Node(None, ""))
        if first:
            self._insert(self.best)

    @staticmethod
    def _offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        node = Node(parent, letter)
        if held is None or cost < held[0] or before(node, held[1]):
            best[state] = (cost, node)

    def _insert(self, best: list) -> None:
        for state in (START, SYSTEM, ASSISTANT):
            if best[state]:
                self._offer(best, USER, best[state][0] + INSERT, best[state][1], "I")
        if best[USER]:
            self._offer(best, ASSISTANT, best[USER][0] + INSERT, best[USER][1], "I")

    def row(self, initial: str, forced: bool, extra: int) -> None:
        """Takes up a row; ``forced`` ones must be deleted, others cost ``extra`` unless they are."""
        best: list[tuple[int, Node] | None] = [None] * STATES
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._offer(best, state, cost + DELETE, node, "D")
            if forced:
                continue
            for to, step in STEPS.items():
                if state in step:
                    if to == initial:
                        self._offer(best, step[state], cost + extra, node, "K")
                    elif to != "s":
                        self._offer(best, step[state], cost + REROLE + extra, node, "R")
        self._insert(best)
        self.best = best


def after(state: int, letter: str, initial: str) -> int:
    """The state that an edit leads to; ``initial`` is that of the row it edits."""
    if letter == "D":
        return state
    if letter == "K":
        return STEPS[initial][state]
    return ASSISTANT if state == USER else USER


class Repaired:
    """Digest of a repaired conversation, fed with rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.digest, self.lines = hashlib.sha256(), 0
        self._inserted()

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = after(self.state, "I", "")
            self._line(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        letter = self.audit[self.at]
        self.state = after(self.state, letter, role[:1])
        self.at += 1
        if letter != "D":
            self._line(role if letter == "K" else ROLES[self.state], text)
        self._inserted()


# Rows ---------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, text, uid`` after the damage that the row's key asks for, and the rows it drops
    with a null ``uid``, so that no conversation is lost."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    whole = turn.cast("bigint").alias("turn")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), space), F.coalesce(turn.cast("string"), space))
    read = rows.select(
        conv.alias("conv"), whole, F.coalesce(F.col(role_col), space).alias("role"),
        F.coalesce(F.col(text_col), space).alias("text"), (F.crc32(key.cast("binary")) % DAMAGE).alias("damage"),
        (F.monotonically_increasing_id() * 2).alias("uid"),
    )
    hit = F.col("damage")
    text = F.when(hit == EMPTY, "").when(hit == UNPOINTED, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(hit == TWICE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    read = read.select(
        "conv", "turn", F.when(hit == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "damage", "uid",
        F.explode(copies).alias("copy"),
    )
    return read.select("conv", "turn", "role", "text", F.when(hit != DROP, F.col("uid") + F.col("copy")).alias("uid"))


def _seen_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seen``: whether role and text occur earlier in the conversation."""
    found = stored(
        rows.groupBy(F.xxhash64("conv", "role", "text").alias("key"), "conv", F.xxhash64(F.lit(1), "role", "text").alias("key2"))
        .agg(F.min(F.struct("turn", "uid")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1"),
        "repeated-rows",
    )
    keyed = rows.withColumn("key", F.xxhash64("conv", "role", "text"))
    clear = in_buckets_of(keyed, found, "key", keep=False).withColumn("seen", F.lit(False))
    named = found.select(F.col("key").alias("f_key"), F.col("key2").alias("f_key2"), F.col("conv").alias("f_conv"), F.col("first.uid").alias("f_uid"))
    alike = (
        (F.col("key") == F.col("f_key")) & F.col("conv").eqNullSafe(F.col("f_conv"))
        & (F.xxhash64(F.lit(1), "role", "text") == F.col("f_key2"))
    )
    doubtful = in_buckets_of(keyed, found, "key").join(named, alike, "left")
    doubtful = doubtful.withColumn("seen", F.coalesce(F.col("uid") != F.col("f_uid"), F.lit(False)))
    names = ["conv", "turn", "role", "text", "uid", "seen"]
    return clear.select(names).unionByName(doubtful.select(names))


ORDER = ("conv", "turn", "role", "text", "uid")
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PATH = "array<struct<enter:int,leave:int,cost:bigint,audit:string>>"
SEGMENT = (
    "part int, open boolean, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint,"
    f" low bigint, high bigint, first_initial string, last_initial string, paths {PATH}, repaired_sha256 string"
)


def fault(text: str, seen: bool) -> str | None:
    body = text.rstrip(SPACES)
    if not body:
        return "blank"
    if seen:
        return "duplicate"
    return None if body[-1] in ENDS else "truncated"


class Segment:
    """Rows of a conversation that lie in one partition, in order.

    The texts are held only while the conversation may still turn out to be whole and has few characters;
    otherwise a later pass makes the digest.
    """

    HELD = 1 << 22

    def __init__(self, conv, part: int, whole: bool):
        self.conv, self.part = conv, part
        self.audits = [Audit(START, True)] if whole else []
        if not whole:
            # It may be the first segment or a later one: insertions before the first row belong to the former only.
            self.audits = [Audit(START, True), *(Audit(s, False) for s in range(STATES))]
        self.whole = whole
        self.counts = dict.fromkeys(COUNTS, 0)
        self.rows = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.texts, self.size = [], 0

    def row(self, turn, role: str, text: str, seen: bool) -> None:
        found = fault(text, seen)
        if found:
            self.counts[found] += 1
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.first, self.last = initial if not self.rows else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows += 1
        for audit in self.audits:
            audit.row(initial, found in ("blank", "duplicate"), TRUNCATED if found == "truncated" else 0)
        if self.whole and self.texts is not None:
            self.size += len(role) + len(text)
            self.texts.append((role, text))
            if self.size > self.HELD:
                self.texts = None

    def given(self, open_: bool) -> tuple:
        paths = []
        for n, audit in enumerate(self.audits):
            enter = n - 1 if n else -1  # -1: nothing before
            paths += [
                {"enter": enter, "leave": state, "cost": held[0], "audit": held[1].text()} for state, held in enumerate(audit.best) if held
            ]
        digest = None
        if not open_ and self.texts is not None:
            best = finished(paths)
            done = Repaired(best["audit"])
            for role, text in self.texts:
                done.row(role, text)
            digest = done.digest.hexdigest()
        counts = [self.counts[c] for c in COUNTS]
        return (
            self.conv, self.part, open_, self.rows, *counts, self.turns, self.low, self.high,
            self.first, self.last, paths, digest,
        )


def finished(paths: list[dict]) -> dict:
    """The path of a whole conversation."""
    ends = [p for p in paths if p["enter"] == -1 and p["leave"] in (START, ASSISTANT)]
    return min(ends, key=lambda p: (p["cost"], p["audit"]))


def segments(rows: DataFrame, kind: str) -> DataFrame:
    """``conv`` and ``SEGMENT`` by conversation and partition; ``open`` if it may go on in another one."""
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    schema = f"conv {kind}, {SEGMENT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready, at_start = TaskContext.get().partitionId(), None, [], True
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "seen"))
            for conv, turn, role, text, seen in zip(*columns):
                if held is None or conv != held.conv:
                    if held is not None:
                        ready.append(held.given(not held.whole))
                        at_start = False
                    held = Segment(conv, part, not at_start)
                held.row(turn, role, text, seen)
            if len(ready) >= 1000:
                yield _batch(ready, arrow)
                ready = []
        if held is not None:
            ready.append(held.given(True))
        if ready:
            yield _batch(ready, arrow)

    arrow = _arrow(rows, schema)
    return dealt.select("conv", "turn", "role", "text", "seen").mapInArrow(run, schema)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in schema]))


def joined_paths(parts: list[list[dict]]) -> dict:
    """The cheapest path through segments in order."""
    held: dict[int, tuple[int, str]] = {}
    for n, paths in enumerate(parts):
        best: dict[int, tuple[int, str]] = {}
        for p in paths:
            if n == 0 and p["enter"] == -1:
                offer = (p["cost"], p["audit"])
            elif n and p["enter"] in held:
                cost, audit = held[p["enter"]]
                offer = (cost + p["cost"], audit + p["audit"])
            else:
                continue
            best[p["leave"]] = min(best.get(p["leave"], offer), offer)
        held = best
    return finished([{"enter": -1, "leave": s, "cost": c, "audit": a} for s, (c, a) in held.items()])


def _whole(open_: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation of open segments: counts, cost and audit."""

    out = f"conv {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint, cost bigint, audit string"
    arrow = _arrow(open_, out)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        turns, illegal, low, high, last = 0, 0, None, None, None
        for r in rows:
            illegal += r["illegal"] + (last is not None and last + r["first_initial"] not in LEGAL)
            last = r["last_initial"]
            if r["turns"]:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        path = joined_paths([r["paths"] for r in rows])
        counts = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")]
        gaps = 0 if low is None else high - low + 1 - turns
        return pa.Table.from_batches([_batch([(rows[0]["conv"], *counts, illegal, gaps, path["cost"], path["audit"])], arrow)])

    return open_.groupBy("conv").applyInArrow(run, out)


def _digests(rows: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """``conv, repaired_sha256`` of the wanted ``conv, audit``: sorted rows are streamed, the audit ahead of them."""
    key = F.xxhash64("conv")
    some = in_buckets_of(rows.withColumn("key", key), wanted.select(key.alias("key")), "key")
    some = some.join(wanted.select(F.col("conv").alias("w_conv")), F.col("conv").eqNullSafe(F.col("w_conv")), "left_semi")
    none = F.lit(None)
    head = wanted.select(
        "conv", F.lit(True).alias("head"), none.cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), none.cast("bigint").alias("uid"),
    )
    both = some.select("conv", F.lit(False).alias("head"), "turn", "role", "text", "uid").unionByName(head)
    dealt = both.repartition("conv").sortWithinPartitions("conv", F.desc("head"), "turn", "role", "text", "uid")

    schema = f"conv {kind}, repaired_sha256 string"
    arrow = _arrow(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in batches:
            for c, first, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "head", "role", "text"))):
                if first:
                    if held is not None:
                        yield _batch([(conv, held.digest.hexdigest())], arrow)
                    conv, held = c, Repaired(text)
                else:
                    held.row(role, text)
        if held is not None:
            yield _batch([(conv, held.digest.hexdigest())], arrow)

    return dealt.select("conv", "head", "role", "text").mapInArrow(run, schema)


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def audit_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True
) -> DataFrame:
    """One row per conversation: ``<conv_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    With ``damage`` the rows are damaged first, by the checksum of their key.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    if damage:
        held = damaged(rows, conv_col, turn_col, role_col, text_col)
    else:
        space = F.lit(" ")
        held = rows.select(
            F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
            F.coalesce(F.col(text_col), space).alias("text"), F.monotonically_increasing_id().alias("uid"),
        )
    held = stored(held, "damaged")
    left = held.filter("uid IS NOT NULL")
    found = stored(segments(_seen_before(left), kind), "segments")
    open_ = found.filter("open")
    ends = stored(_whole(open_, kind), "open-conversations")
    long_ = found.filter(~F.col("open") & F.col("repaired_sha256").isNull())
    best = F.array_min(
        F.transform(
            F.filter("paths", lambda p: (p["enter"] == -1) & p["leave"].isin(START, ASSISTANT)),
            lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit")),
        )
    )
    closed = found.filter(~F.col("open")).withColumn("best", best)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    closed = closed.select(
        "conv", gaps, "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"),
        "repaired_sha256",
    )
    wanted = ends.select("conv", "audit").unionByName(long_.withColumn("best", best).select("conv", F.col("best.audit").alias("audit")))
    wanted = stored(wanted, "wanted-digests")
    digests = stored(_digests(left, wanted, kind), "digests").select(F.col("conv").alias("d_conv"), F.col("repaired_sha256").alias("digest"))
    undone = closed.filter("repaired_sha256 IS NULL").drop("repaired_sha256").unionByName(ends)
    same_conv = F.col("conv").eqNullSafe(F.col("d_conv"))
    done = undone.join(digests, same_conv).withColumnRenamed("digest", "repaired_sha256")
    done = closed.filter("repaired_sha256 IS NOT NULL").unionByName(done.select(closed.columns))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in RESULT[:6]]
    gone = held.groupBy("conv").agg(F.count("uid").alias("n")).filter("n = 0")
    gone = gone.select("conv", *nothing, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return done.unionByName(gone).select(F.col("conv").alias(conv_col), *RESULT)
