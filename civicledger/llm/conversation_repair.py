"""Repair of conversations: the cheapest edits after which roles alternate behind at most one system turn.

Secondary-sorted streaming: rows are dealt by conversation and sorted by turn, and a mapInArrow carries the state of a dynamic
programme from batch to batch. It runs twice over one shuffle:

* from the last turn to the first, `_choices` keeps the cost of every state's best ending and adds one byte to each row: for each of
  the four states the letter of the edit to make there (a compact back pointer). The sort back to rising turns spills rows and bytes as
  Spark spills any sort, so the longest conversation holds no task's memory;
* from the first turn to the last, `_edits` follows the letters of the state it is in.

Edits of a row: Keep (cost 0), Rerole to the role the state asks for (3), Delete (4; the only one for blank and duplicate rows). Insert
(3) adds an empty turn of that role anywhere. A truncated row that stays costs 3 more. The roles that remain begin with `(s?(ua)+)?`.
Of equally cheap edits the sequence of letters that is least in ASCII is taken; a state's letter is the least that is still cheapest.

Defined cases: a null role or text reads as one space (a null text is a blank row); a null turn comes before all others; rows of one
turn come by role, then text; rows without a conversation id are together one conversation; a repeated row is a duplicate of the first.
Role and text are compared whole. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: what the repaired turns so far amount to
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: the role that a state asks for, and the state after it
ASKED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COST = {"D": 4, "I": 3, "K": 0, "R": 3, "": 0}
TRUNCATED = 3
#: costs of the endings after the last row: turns still to be inserted
AT_END = (0, 6, 3, 0)
BLANKS = " \t\n\x0b\f\r"
#: rows and characters that a batch of results holds at most, a single longer text excepted
ROWS, CHARACTERS = 4096, 1 << 22


def prepared(rows, conv="conv_id", turn="turn", role="role", text="text", present=None):
    """Rows dealt by conversation, with their first fault: blank, duplicate (role and text seen earlier) or truncated.

    `present` names a boolean column; rows where it is false only announce their conversation.
    """
    here = F.col(present) if present else F.lit(True)
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), here.alias("present"))
    same = Window.partitionBy("conv", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    body = F.btrim("text", F.lit(BLANKS))
    fault = (F.when(body == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    return rows.repartition("conv").withColumn("nth", F.row_number().over(same)).withColumn("fault", F.when(F.col("present"), fault).otherwise(""))


def _kept(state, initial):
    """The state after a turn with this initial, None where it may not stand."""
    return SYSTEM if state == EMPTY and initial == "s" else AFTER[state] if initial == ASKED[state][0] else None


def step(after, initial, fault):
    """(costs, letters) before a row, from the costs after it; costs are relative to the least, letters two bits a state."""
    endings = []
    for state in range(4):
        ways = {DELETE: COST["D"] + after[state]}
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            ways[REROLE] = COST["R"] + more + after[AFTER[state]]
            if (then := _kept(state, initial)) is not None:
                ways[KEEP] = more + after[then]
        endings.append(ways)
    # an inserted turn leads to another state of the same row: user and assistant first, each from the other without an insertion
    plain = [min(ways.values()) for ways in endings]
    for state in (USER, ASSISTANT):
        endings[state][INSERT] = COST["I"] + plain[AFTER[state]]
    for state in (EMPTY, SYSTEM):
        endings[state][INSERT] = COST["I"] + min(endings[USER].values())
    costs = [min(ways.values()) for ways in endings]
    letters = sum(min(way for way, cost in ways.items() if cost == costs[state]) << 2 * state for state, ways in enumerate(endings))
    return tuple(c - min(costs) for c in costs), letters


def _choices(batches):
    """Rows from the last turn to the first, each with the byte of its letters."""
    known, conv, costs = {}, object(), AT_END
    for batch in batches:
        column = {name: batch.column(name).to_pylist() for name in ("conv", "role", "fault", "present")}
        out = []
        for now, role, fault, present in zip(*column.values()):
            if now != conv:
                conv, costs = now, AT_END
            letters = 0
            if present:
                row = (costs, role[:1] if role[:1] in ("s", "u", "a") else "", fault)
                if row not in known:  # relative costs take a few values only
                    known[row] = step(*row)
                costs, letters = known[row]
            out.append(letters)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int16())], names=[*batch.schema.names, "letters"])


def _edits(batches, conv_type):
    """The edits of rows from the first turn to the last. A conversation without rows gives one row with the letter ''."""
    schema = pa.schema([("conv", conv_type), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("edit", pa.string()), ("cost", pa.int64())])
    out, size = [], 0

    def flushed():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return batch

    def ended():
        while state in (SYSTEM, USER):
            yield inserted()
        if not seen:
            yield conv, None, None, None, None, "", "", 0

    def inserted():
        nonlocal state
        role, state = ASKED[state], AFTER[state]
        return conv, None, None, role, "", "", "I", COST["I"]

    conv, state, seen, started = None, EMPTY, False, False
    for batch in batches:
        names = ("conv", "turn", "role", "text", "fault", "present", "letters")
        for now, turn, role, text, fault, present, letters in zip(*(batch.column(n).to_pylist() for n in names)):
            if not started or now != conv:
                if started:
                    out.extend(ended())
                conv, state, seen, started = now, EMPTY, False, True
            if not present:
                continue
            seen = True
            while (letter := letters >> 2 * state & 3) == INSERT:
                out.append(inserted())
            is_role = role
            if letter == KEEP:
                state = _kept(state, role[:1])
            elif letter == REROLE:
                is_role, state = ASKED[state], AFTER[state]
            cost = COST[LETTERS[letter]] + (TRUNCATED if fault == "truncated" and letter != DELETE else 0)
            out.append((conv, turn, role, is_role, text, fault, LETTERS[letter], cost))
            size += len(text)
            if len(out) >= ROWS or size >= CHARACTERS:
                yield flushed()
                size = 0
    if started:
        out.extend(ended())
    if out:
        yield flushed()


def repair(rows, conv="conv_id", turn="turn", role="role", text="text", present=None):
    """The edits of all conversations, those of one after another in order: conv, turn, was (role before), role, text, fault, edit, cost.

    edit is the letter D, I, K or R; rows other than D are the repaired conversation. An inserted turn has neither turn nor `was`.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    back = [F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("nth")]
    rows = prepared(rows, conv, turn, role, text, present).withColumn("turn", F.col("turn").cast("long"))
    kind = rows.schema["conv"].dataType
    columns = f"conv {kind.simpleString()}, turn bigint, role string, text string, present boolean, nth int, fault string, letters smallint"
    chosen = rows.sortWithinPartitions("conv", *back).mapInArrow(_choices, columns)
    arrow = to_arrow_type(kind)
    edited = "conv " + kind.simpleString() + ", turn bigint, was string, role string, text string, fault string, edit string, cost bigint"
    return chosen.sortWithinPartitions("conv", *order).mapInArrow(lambda batches: _edits(batches, arrow), edited)


class _Report:
    """Figures of one conversation, taken up edit by edit."""

    def __init__(self, conv):
        self.conv, self.audit, self.cost, self.illegal = conv, [], 0, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.initial = None
        self.turns, self.digest, self.any = 0, hashlib.sha256(), False

    def add(self, turn, was, role, text, fault, edit, cost):
        self.audit.append(edit)
        self.cost += cost
        if fault:
            self.faults[fault] += 1
        if edit and edit != "I":
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if edit and edit != "D":
            self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def row(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def reports(edits):
    """One row per conversation of what `repair` returned, read in the order it has there.

    conv, gaps, blank, duplicate, truncated, illegal (neighbouring initials before the repair that may not follow), cost, audit (the
    letters), repaired_sha256 (of the repaired `role:text`, newline-joined).
    """
    kind = edits.schema["conv"].dataType.simpleString()

    def summed(batches):
        now, out, conv_type = None, [], None
        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for conv, *rest in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "was", "role", "text", "fault", "edit", "cost"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Report(conv)
                now.add(*rest)
            if len(out) >= ROWS:
                yield _reports_batch(out, conv_type)
                out = []
        if now is not None:
            yield _reports_batch([*out, now.row()], conv_type)

    return edits.mapInArrow(summed, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def _reports_batch(rows, conv_type):
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def damaged(rows):
    """Conversations with faults that their ids decide, for measuring a repair: crc32(`conv_id:turn`) % 20 drops a row (`present` is
    false), empties its text, removes its full stops, repeats it or makes it the user's. Nulls read as one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "utf-8")) % 20
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("kind") != 0).alias("present"), times.alias("copy"))
