"""Conversation structure repair: the cheapest edits that make a dialogue `(system? (user assistant)+)?`.

Backward costs are kept at about the square root of a dialogue's rows only; between two of these checkpoints they are
made again while the walk goes forward and takes the ASCII-least edit that still leads to the least cost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import ranged, stored, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# What has been said last: nothing, the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
# State after the next turn of the alternation, which inserted and re-roled turns follow.
TALK = (USER, USER, ASSISTANT, USER)
SPEAKER = {USER: "user", ASSISTANT: "assistant"}
# State after a kept turn of a role with this initial (s, u, a, other); none where the form does not allow it.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
INITIALS = {"s": 0, "u": 1, "a": 2}
# Fault of a row in its code: code = 4 * fault + initial.
SOUND, CUT, BLANK, DUPLICATE = range(4)
FAULTS = {BLANK: "blank", DUPLICATE: "duplicate", CUT: "truncated"}
# Costs from each state when all rows are used up: only turns can be added.
END = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=1 << 16)
def _before(after: tuple, code: int) -> tuple[tuple, tuple, int]:
    """Costs before a row with this code from the costs after it: as they are, less their least, and that least.

    Costs less their least take few values, so that few different steps are ever computed.
    """
    fault, initial = divmod(code, 4)
    base = []
    for q in range(4):
        cost = DELETE + after[q]
        if fault < BLANK:
            extra = TRUNCATED if fault == CUT else 0
            cost = min(cost, REROLE + extra + after[TALK[q]])
            if KEPT[q][initial] is not None:
                cost = min(cost, extra + after[KEPT[q][initial]])
        base.append(cost)
    # Two insertions reach every state that insertions reach.
    once = [min(base[q], INSERT + base[TALK[q]]) for q in range(4)]
    costs = tuple(min(once[q], INSERT + once[TALK[q]]) for q in range(4))
    least = min(costs)
    return costs, tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def _edit(after: tuple, code: int, state: int) -> tuple[str, int]:
    """The ASCII-least edits (insertions, then one of the row) that keep the cost least, and the state after them."""
    costs, edits = _before(after, code)[0], ""
    fault, initial = divmod(code, 4)
    extra = TRUNCATED if fault == CUT else 0
    while True:
        cost = costs[state]
        if cost == DELETE + after[state]:
            return edits + "D", state
        if cost == INSERT + costs[TALK[state]]:
            edits, state = edits + "I", TALK[state]
            continue
        kept = KEPT[state][initial]
        if kept is not None and cost == extra + after[kept]:
            return edits + "K", kept
        return edits + "R", TALK[state]


def costs_before(codes: bytes, after: tuple = END) -> list:
    """Least cost of all rows from each state, given the costs that follow them."""
    total = min(after)
    vector = tuple(c - total for c in after)
    for code in reversed(codes):
        _, vector, least = _before(vector, code)
        total += least
    return [total + c for c in vector]


def walk(codes: bytes, state: int = START, after: tuple = END) -> tuple[str, int, list]:
    """(ASCII-least cheapest edits, state after them, costs before the rows) of a run of rows: memory beyond the codes and the edits is about their square root."""
    step = math.isqrt(len(codes)) + 1
    total = min(after)
    last = vector = tuple(c - total for c in after)
    checkpoints = {}
    for i in range(len(codes) - 1, -1, -1):
        _, vector, least = _before(vector, codes[i])
        total += least
        if i % step == 0:
            checkpoints[i] = vector
    edits = []
    for begin in range(0, len(codes), step):
        block = codes[begin : begin + step]
        vector = checkpoints.get(begin + step, last)
        behind = [vector]
        for code in reversed(block):
            behind.append(_before(behind[-1], code)[1])
        for code, known in zip(block, behind[-2::-1], strict=True):
            edit, state = _edit(known, code, state)
            edits.append(edit)
    return "".join(edits), state, [total + c for c in (checkpoints.get(0, last))]


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of (conv, turn, role, text) with `pos`, stored in the order of conv, turn (nulls first), role and text, and their codes (conv, pos, code).

    The first of blank (no character but white space), duplicate (role and text of an earlier row of the conversation)
    and truncated (last such character not . ! or ?) is a row's fault. Rows equal in every column are duplicates of
    their first. Duplicates are found by the least position of each SHA-256 of role and text, combined before the
    shuffle, and meet the codes by position, which no two rows share. Texts are shuffled once.
    """
    placed = ranged(rows, F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"))
    solid = F.expr(r"text rlike '[^\\x20\\x09-\\x0D]'")
    first = placed.where(solid).groupBy("conv", F.expr("unhex(sha2(concat(length(role), ':', role, text), 256))").alias("said")).agg(F.min("pos").alias("pos"))
    marks = placed.withColumn("solid", solid).selectExpr(
        "conv", "pos", "solid", r"solid and not text rlike '[.!?][\\x20\\x09-\\x0D]*\\z' as cut", "case left(role, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end as initial")
    fault = f"case when not solid then {BLANK} when new is null then {DUPLICATE} when cut then {CUT} else {SOUND} end"
    return placed, stored(marks.join(first.select("pos", F.lit(True).alias("new")), "pos", "left").selectExpr("conv", "pos", f"4 * {fault} + initial as code"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, int, bytes]]:
    """(conv, range, first position, codes) of each run of rows of one conversation in one range."""
    key, first, codes = None, 0, bytearray()
    for batch in batches:
        for conv, pos, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "code")), strict=True):
            if not codes or (conv, pos >> 33) != key:
                if codes:
                    yield key[0], key[1], first, bytes(codes)
                key, first, codes = (conv, pos >> 33), pos, bytearray()
            codes.append(code)
    if codes:
        yield key[0], key[1], first, bytes(codes)


def _carrier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run the least costs from every state before it to every state after it, as costs that a run before can go on from."""
    for conv, at, _, codes in _runs(batches):
        through = [costs_before(codes, tuple(0 if q == to else math.inf for q in range(4))) for to in range(4)]
        flat = [int(c) if c < math.inf else None for column in through for c in column]
        yield pa.RecordBatch.from_arrays([pa.array([str(conv)]), pa.array([conv is None]), pa.array([at]), pa.array([flat], pa.list_(pa.int64()))],
                                         names=["conv", "no_conv", "range", "through"])


def _walker(ends: dict) -> Callable:
    """Edits of every run: from the start for a conversation that lies in one range, from each state for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "first", "range", "entered", "left", "cost", "audit", "codes", "split"]
        out: list[list] = [[] for _ in names]
        kind = None
        size = 0
        for batch_of in _typed(batches):
            kind, (conv, at, first, codes) = batch_of
            end = ends.get((None if conv is None else str(conv), at))
            for entered in range(4) if end else (START,):
                audit, state, costs = walk(codes, entered, end[0] if end else END)
                if not end or end[1]:
                    while END[state]:
                        audit, state = audit + "I", TALK[state]
                for column, value in zip(out, (conv, first, at, entered, state, int(costs[entered]), audit, codes, bool(end)), strict=True):
                    column.append(value)
                size += 2 * len(audit) + 100
            if size > 1 << 20:
                yield _piece_batch(out, names, kind)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield _piece_batch(out, names, kind)

    return run


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, tuple]]:
    kinds = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = [batch.schema.field("conv").type]
            yield batch

    for found in _runs(noted()):
        yield kinds[0], found


def _piece_batch(columns: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def plans(codes: DataFrame) -> DataFrame:
    """(conv, first, entered, cost, audit, codes): the edits of each run of a conversation's rows in one range, `first` its first position.

    A range is a task. Most conversations lie in one range; of those that a border cuts there are fewer than ranges.
    These runs send the costs between all states before and after them (16 numbers) to the driver, which links them
    backwards to the costs behind each run, and later forwards to the state in which each run is entered. `cost` is
    from the run's first row to the end of the conversation.
    """
    codes = codes.withColumn("range", F.expr("shiftright(pos, 33)"))
    kind = codes.schema["conv"].dataType.simpleString()

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("range").sortWithinPartitions("pos").select("conv", "pos", "code")

    split = codes.groupBy("conv").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).where("lo < hi").select("conv")
    split = stored(split)
    ends: dict = {}
    chains: dict = {}
    if not split.isEmpty():
        theirs = codes.join(F.broadcast(split.withColumnRenamed("conv", "c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
        carried = in_order(theirs).mapInArrow(_carrier, "conv string, no_conv boolean, range long, through array<long>").collect()
        for row in sorted(carried, key=lambda r: -r["range"]):
            conv = None if row.no_conv else row.conv
            chain = chains.setdefault(conv, [])
            behind = END if not chain else chain[-1][1]
            ends[conv, row["range"]] = (behind, not chain)
            through = [math.inf if c is None else c for c in row.through]
            chain.append((row["range"], tuple(min(through[4 * to + q] + behind[to] for to in range(4)) for q in range(4))))
    found = in_order(codes).mapInArrow(_walker(ends), f"conv {kind}, first long, range long, entered int, left int, cost long, audit string, codes binary, split boolean")
    if not chains:
        return stored(found.drop("range", "left", "split"))
    found = stored(found)
    steps = {(None if r.conv is None else str(r.conv), r["range"], r.entered): (r.first, r["left"]) for r in found.where("split").select("conv", "range", "entered", "first", "left").collect()}
    taken = []
    for conv, chain in chains.items():
        state = START
        for at, _ in reversed(chain):
            first, state_after = steps[conv, at, state]
            taken.append((first, state))
            state = state_after
    chosen = codes.sparkSession.createDataFrame(taken, "first long, entered int")
    whole = found.where("not split").unionByName(found.where("split").join(F.broadcast(chosen), ["first", "entered"], "left_semi").select(*found.columns))
    return whole.drop("range", "left", "split")


def _script(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows and, just before the first row of each run, its edits and codes."""
    rows = placed.selectExpr("conv", "pos", "1 as kind", "turn", "role", "text", "0 as entered", "0L as cost", "cast(null as string) as audit", "cast(null as binary) as codes")
    runs = plan.selectExpr("conv", "first as pos", "0 as kind", "cast(null as bigint) as turn", "cast(null as string) as role", "cast(null as string) as text",
                           "entered", "cost", "audit", "codes")
    return rows.unionByName(runs)


class _Scribe:
    """Takes the rows of `_script` in order; gives the repaired turns as (edit, role, text)."""

    def __init__(self) -> None:
        self.edits, self.at, self.state = "", 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = TALK[self.state]
            yield "I", SPEAKER[self.state], ""

    def run(self, audit: str, entered: int) -> None:
        self.edits, self.at, self.state = audit, 0, entered

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][INITIALS.get(role[:1], 3)]
            yield edit, role, text
        elif edit == "R":
            self.state = TALK[self.state]
            yield edit, SPEAKER[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        """Turns added behind the last row."""
        yield from self._inserted()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scribe, known, kind = _Scribe(), None, None
    names = ["conv", "pos", "seq", "edit", "role", "text"]
    out: list[list] = [[] for _ in names]

    def note(conv, pos, turns):
        for seq, (edit, role, text) in enumerate(turns):
            for column, value in zip(out, (conv, pos, seq, edit, role, text), strict=True):
                column.append(value)

    def flush():
        types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, pos, is_row, role, text, entered, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "kind", "role", "text", "entered", "audit")), strict=True):
            if is_row:
                note(conv, pos, scribe.row(role, text))
                known = conv, pos + 1
            else:
                if known:
                    note(*known, scribe.rest())
                scribe.run(audit, entered)
        if out[0]:
            yield flush()
            out[:] = [[] for _ in names]
    if known:
        note(*known, scribe.rest())
    if out[0]:
        yield flush()


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, pos, seq, edit, role, text): the turns of every repaired conversation, in the order of pos and seq.

    `edit` is K (kept), R (re-roled to user or assistant) or I (an empty turn added). A row without a text character is
    deleted, and so is one that repeats an earlier row's role and text; others are deleted where that is cheaper. Of the
    cheapest edits those are taken whose initials come first in ASCII order. A conversation is ordered by turn, nulls
    first, then role and text. A null role or text counts as one blank; a null conversation is one like any other. A
    conversation of which nothing is left, and an empty table, give no rows. Further columns are not read, whatever
    their names. No task gets more than a range of rows, also of one conversation, and keeps one byte of each at a time.
    """
    placed, codes = faults(plain_turns(turns, conversation, turn, role, text))
    script = _script(placed, plans(codes)).repartition(F.expr("shiftright(pos, 33)")).sortWithinPartitions("pos", "kind")
    kind = placed.schema["conv"].dataType.simpleString()
    return script.mapInArrow(_repaired, f"conv {kind}, pos long, seq long, edit string, role string, text string").withColumnRenamed("conv", conversation)


def plain_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))


class _Report:
    """Figures of one conversation, row by row."""

    def __init__(self, conv: object) -> None:
        self.conv, self.cost, self.audit = conv, None, []
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.initial = 0, None
        self.hash, self.wrote = hashlib.sha256(), False

    def run(self, cost: int, audit: str, codes: bytes) -> None:
        self.cost = cost if self.cost is None else self.cost  # the first run's is the whole conversation's
        self.audit.append(audit)
        for fault in self.faults:
            self.faults[fault] += sum(map(codes.count, range(4 * fault, 4 * fault + 4)))

    def row(self, turn: int | None, role: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]

    def write(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.hash.update((("\n" if self.wrote else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.wrote = True

    def values(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", *FAULTS.values(), "illegal", "cost", "audit", "repaired_sha256"]
    scribe, report, kind, done = _Scribe(), None, None, []

    def flush():
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = ("conv", "kind", "turn", "role", "text", "entered", "cost", "audit", "codes")
        for conv, is_row, turn, role, text, entered, cost, audit, codes in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if not is_row:
                if report:
                    report.write(scribe.rest())
                    if report.conv != conv:
                        done.append(report.values())
                        report = None
                report = report or _Report(conv)
                scribe.run(audit, entered)
                report.run(cost, audit, codes)
            else:
                report.row(turn, role)
                report.write(scribe.row(role, text))
        if done:
            yield flush()
            done = []
    if report:
        report.write(scribe.rest())
        done.append(report.values())
        yield flush()


def reports(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows.

    The digest is one hash over a conversation's repaired turns, so they pass through one task, in order and one at a
    time; everything else, as `repair`, is cut into ranges. Nulls, ties and the rest as for `repair`.
    """
    placed, codes = faults(plain_turns(turns, conversation, turn, role, text))
    script = _script(placed, plans(codes)).repartition("conv").sortWithinPartitions("conv", "pos", "kind")
    kind = placed.schema["conv"].dataType.simpleString()
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return script.mapInArrow(_reports, f"conv {kind}, {fields}").withColumnRenamed("conv", conversation)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with the faults of the contract, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its . ! and ? out, 3 repeats it, 4 makes it a user's. Nulls count as one blank, in the key too.
    """
    rows = conversations.selectExpr("conv_id", "turn", "coalesce(string(role), ' ') as role", "coalesce(string(text), ' ') as text",
                                    "crc32(concat(coalesce(string(conv_id), ' '), ':', coalesce(string(turn), ' '))) % 20 as lot").where("lot != 0")
    hit = rows.selectExpr("conv_id", "turn", "case when lot = 4 then 'user' else role end as role",
                          "case when lot = 1 then '' when lot = 2 then translate(text, '.!?', '') else text end as text", "if(lot = 3, 2, 1) as times")
    return hit.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = reports(damaged(conversations).withColumnRenamed("conv_id", "c"), "c")
    every = conversations.select("conv_id").distinct()
    counts = [f"coalesce({c}, 0L) as {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").selectExpr(
        "conv_id", *counts, "coalesce(audit, '') as audit", "coalesce(repaired_sha256, sha2('', 256)) as repaired_sha256")
