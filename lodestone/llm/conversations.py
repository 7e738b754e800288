"""Repair of conversations by error-correcting Earley parsing.

A legal conversation is an optional system turn and then pairs of user and assistant, or nothing. The grammar is weighted: a
turn is kept (0), given another role (1) or deleted (2, which blank and repeated turns must be), an empty turn is inserted
(5), and a cut-off turn that stays costs 5 more. The parser takes it as productions of delete, rerole and insert beside
those of the roles; each item of its chart holds the least (cost, audit), an audit being the initials of the edits, and the
completed chart gives the repair. All productions are left-linear, so every item began in the first column, which with the
newest is all that is kept.

A conversation of any length is parsed in stretches: turns are sorted over all tasks, a task parses its stretch from every
nonterminal at which it may be entered, and the stretches' small tables are folded in order. An audit ends a stretch with a
turn, before any insertion: then none of equal cost is the beginning of another, so that the least audit of a stretch stays
part of the least audit of the whole. Repaired turns are then read in order, one conversation in one task, as a digest of
their sequence needs; nothing of a conversation but its audit is held meanwhile.

Cases: null roles and texts are one space; turns are ordered by number, nulls first, and of equal numbers by role and by
the SHA-256 of the text; equal rows are one row with a count until the end, the later ones being repeated turns; roles
other than user, assistant and system can not be kept; a null conversation id is a conversation; very long texts are
compared by SHA-256; a conversation that ``ids`` names and that has no rows has zeros, an empty audit and no turns; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, parts

#: The classes of a turn, by the initial of its role; its state: as it should be, cut off, to be deleted.
CLASSES, FINE, CUT_OFF, GONE = "suax", 0, 1, 2
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 1, 2, 5, 5
#: Nonterminals: a prefix of nothing, of a system turn alone, or that ends with a user or an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: (left side, nonterminal before, what is read: a class, "other" than a class, "any", or None; cost; initial of the edit)
GRAMMAR = [
    (SYSTEM, BEGIN, "s", KEEP, "K"),
    *((USER, x, what, cost, edit) for x in (BEGIN, SYSTEM, ASSISTANT) for what, cost, edit in (("u", KEEP, "K"), ("other u", REROLE, "R"), (None, INSERT, "I"))),
    *((ASSISTANT, USER, what, cost, edit) for what, cost, edit in (("a", KEEP, "K"), ("other a", REROLE, "R"), (None, INSERT, "I"))),
    *((x, x, "any", DELETE, "D") for x in range(4)),
]
GOALS = (BEGIN, ASSISTANT)
#: Turns after which audits of the chart are set aside and ranked; turns of a conversation whose parse is remembered.
BLOCK, SHORT = 256, 64


def _reads(what: str | None, kind: str, state: int) -> bool:
    if what == "any":
        return True
    return what is not None and state != GONE and (what == kind if len(what) == 1 else what[-1] != kind)


#: For each class and state of a turn, the productions that read it, with their costs.
_SCANS = {(k, state): [(p, cost + (STAYS if state == CUT_OFF and edit != "D" else 0), edit) for p, (_, _, what, cost, edit) in enumerate(GRAMMAR) if _reads(what, kind, state)] for k, kind in enumerate(CLASSES) for state in (FINE, CUT_OFF, GONE)}
#: Productions that wait for a nonterminal: predicted in the first column, as all are left-linear.
_WAITING = {x: [p for p, (_, before, _, _, _) in enumerate(GRAMMAR) if before == x] for x in range(4)}


def _complete(done: dict) -> tuple[dict, dict]:
    """Items with the dot after their nonterminal, and all completed nonterminals of a column; insertions complete in it."""
    items, agenda = {}, list(done.items())
    best = dict(done)
    while agenda:
        x, value = agenda.pop()
        if value != best[x]:
            continue  # a better one came meanwhile
        for p in _WAITING[x]:
            items[p] = value
            to, _, what, cost, edit = GRAMMAR[p]
            if what is None:
                new = (value[0] + cost, value[1], value[2] + edit)
                if to not in best or new < best[to]:
                    best[to] = new
                    agenda.append((to, new))
    return items, best


def _scan(items: dict, kind: int, state: int, times: int) -> dict:
    """The nonterminals that a turn completes; of ``times`` equal turns all but the first are deleted."""
    done: dict = {}
    for p, cost, edit in _SCANS[kind, state]:
        if p in items:
            c, rank, tail = items[p]
            new = (c + cost, rank, tail + edit)
            x = GRAMMAR[p][0]
            if x not in done or new < done[x]:
                done[x] = new
    if times > 1:
        done = {x: (c + DELETE * (times - 1), rank, tail + "D" * (times - 1)) for x, (c, rank, tail) in done.items()}
    return done


def parse(turns, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) with which turns (class, state, times) lead from a nonterminal to each other one, before insertions at their end."""
    done = {entry: (0, 0, "")}
    chains = [None]  # of each rank, the audit up to the last block as (what was before, tail)
    for k, turn in enumerate(turns):
        if k and k % BLOCK == 0:
            order = sorted(done, key=lambda x: done[x][1:])
            chains = [(chains[done[x][1]], done[x][2]) for x in order]
            done = {x: (done[x][0], rank, "") for rank, x in enumerate(order)}
        done = _scan(_complete(done)[0], *turn)
    out = {}
    for x, (cost, rank, tail) in done.items():
        pieces, chain = [tail], chains[rank]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        out[x] = cost, "".join(reversed(pieces))
    return out


@lru_cache(1 << 15)
def _short(turns: tuple, entry: int) -> dict:
    return parse(turns, entry)


def joined(done: dict, table: list) -> dict:
    """``done`` carried on over a stretch: a table of (entry, exit, cost, audit)."""
    out: dict = {}
    for x, y, cost, audit in table:
        if x in done:
            new = (done[x][0] + cost, done[x][1] + audit)
            if y not in out or new < out[y]:
                out[y] = new
    return out


def finish(done: dict) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation, after insertions at its end."""
    _, best = _complete({x: (cost, 0, audit) for x, (cost, audit) in done.items()})
    cost, _, audit = min(best[x] for x in GOALS if x in best)
    return cost, audit


#: White space of the rules, and the ends of a whole text.
_SPACE, _ENDS = " \t\n\x0b\x0c\r", ".!?"

_PIECE = "part int, first int, last int, blank long, duplicate long, truncated long, illegal long, low long, high long, numbers long, first_number long, last_number long, entry array<int>, exit array<int>, cost array<long>, audit array<string>"


class _Stretch:
    """What is to be known of the turns of one conversation in one task."""

    def __init__(self, conv):
        self.conv, self.turns, self.counts = conv, [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.numbers, self.low, self.high, self.first_number, self.last_number = 0, None, None, None, None

    def add(self, number, kind, fault, times) -> None:
        c = self.counts
        if fault == 1:
            c["blank"] += times
        else:
            c["duplicate"] += times - 1 + (fault == 2)
            c["truncated"] += fault == 3
        if self.turns:
            c["illegal"] += _illegal(self.turns[-1][0], kind)
        c["illegal"] += times - 1
        self.turns.append((kind, (FINE, GONE, GONE, CUT_OFF)[fault], times))
        if number is not None:
            if number != self.last_number:
                self.numbers += 1
            if self.low is None:
                self.low = self.first_number = number
            self.high = self.last_number = number

    def row(self, part, entries) -> tuple:
        tables = [(x, y, cost, audit) for x in entries for y, (cost, audit) in (_short(tuple(self.turns), x) if len(self.turns) <= SHORT else parse(self.turns, x)).items()]
        return (self.conv, part, self.turns[0][0], self.turns[-1][0], *self.counts.values(), self.low, self.high, self.numbers, self.first_number, self.last_number, *map(list, zip(*tables)))


def _illegal(before: int, kind: int) -> int:
    return int(CLASSES[before] + CLASSES[kind] not in ("su", "ua", "au"))


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows counted: conv, turn, role, text, times, key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.sha2("text", 256))


def _stretches(rows: DataFrame) -> DataFrame:
    """A row for each conversation and task: counts, numbers of turns and the table of its parse."""
    body = F.rtrim("text", F.lit(_SPACE))
    turns = rows.select("conv", "turn", "role", "key", F.col("times"), (F.length(body) == 0).alias("blank"), (~F.right(body, F.lit(1)).isin(*_ENDS)).alias("open"))
    # A hot text may fill a conversation: its first place comes of an aggregate, and the join back can be split.
    first = turns.groupBy(F.col("conv").alias("of"), F.col("role").alias("of_role"), F.col("key").alias("of_key")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    turns = turns.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("key") == F.col("of_key")))
    fault = F.when(F.col("blank"), 1).when(~F.col("turn").eqNullSafe(F.col("first.turn")), 2).when(F.col("open"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    turns = turns.select("conv", "turn", "role", "key", "times", fault.alias("fault"), kind.alias("kind"))
    order = ["conv", "turn", "role", "key"]
    turns = turns.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv", "turn", "kind", "fault", "times")
    shape = f"conv {rows.schema['conv'].dataType.simpleString()}, {_PIECE}"

    def run(batches):
        part, now, entered = TaskContext.get().partitionId(), None, True  # the first of a task may have begun in another
        held, schema = [], None
        for batch in batches:
            schema = schema or _arrow(batch.schema.field(0).type)
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        held.append(now.row(part, range(4) if entered else (BEGIN,)))
                        entered = False
                        if len(held) >= 2000:
                            yield _batch(held, schema)
                            held = []
                    now = _Stretch(conv)
                now.add(*rest)
        if now is not None:
            held.append(now.row(part, range(4) if entered else (BEGIN,)))
            yield _batch(held, schema)

    return turns.mapInArrow(run, shape)


def _arrow(conv) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split(" ") for x in _PIECE.split(", ")]
    return pa.schema([("conv", conv), *((n, pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t]) for n, t in fields)])


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Whole:
    """A conversation from its stretches, in order."""

    def __init__(self):
        self.done, self.counts = {BEGIN: (0, "")}, [0, 0, 0, 0]
        self.last = self.low = self.high = self.last_number = None
        self.numbers = 0

    def add(self, s: dict) -> None:
        self.done = joined(self.done, list(zip(s["entry"], s["exit"], s["cost"], s["audit"])))
        self.counts = [a + s[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"))]
        if self.last is not None:
            self.counts[3] += _illegal(self.last, s["first"])
        self.last = s["last"]
        if s["low"] is not None:
            self.numbers += s["numbers"] - (self.last_number == s["first_number"])
            self.low = s["low"] if self.low is None else self.low
            self.high, self.last_number = s["high"], s["last_number"]

    def report(self) -> tuple[list[int], str]:
        cost, audit = finish(self.done)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.numbers
        return [gaps, *self.counts, cost], audit


class _Sink:
    """Takes the repaired turns of a conversation: into a digest, a text or rows."""

    def __init__(self, output: str):
        self.output, self.hash, self.n, self.rows = output, hashlib.sha256(), 0, []

    def add(self, role: str, text: str) -> None:
        if self.output == "digest":
            self.hash.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
        else:
            self.rows.append((self.n, role, text))
        self.n += 1

    def end(self):
        return self.hash.hexdigest() if self.output == "digest" else "\n".join(f"{r}:{t}" for _, r, t in self.rows)


def _edited(audit: str):
    """A generator that takes each turn that a conversation has, in order, and gives the turns to write for it; None ends it."""
    at, n, system = 0, 0, 0
    role = lambda: ("user", "assistant")[(n - system) % 2]
    turn = yield []
    while True:
        out = []
        while at < len(audit) and audit[at] == "I":
            out.append((role(), ""))
            at, n = at + 1, n + 1
        if turn is None:
            yield out
            return
        edit = audit[at]
        at += 1
        if edit != "D":
            if edit == "K" and n == 0 and turn[0][:1] == "s":
                system = 1
            out.append((turn[0] if edit == "K" else role(), turn[1]))
            n += 1
        turn = yield out


def repair(turns: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", output: str = "digest") -> DataFrame:
    """The repair of every conversation.

    ``output`` "digest": a row each with the counts of its faults, the cost, the audit and ``repaired_sha256`` of its
    repaired turns, `role:text`, joined by newlines; "text": with that text itself (``repaired``); "turns": the repaired
    turns as rows (place, role, text). ``ids``: all conversations, of which some may have no turns.
    """
    rows = cut(_turns(turns, conv_col, turn_col, role_col, text_col))
    pieces = _stretches(rows)
    shape = rows.schema["conv"].dataType.simpleString()
    stretch = F.struct(*(F.col(x.split(" ")[0]) for x in _PIECE.split(", ")))
    heads = pieces.select("conv", F.lit(0).alias("body"), F.col("part").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), stretch.alias("piece"))
    bodies = rows.select("conv", F.lit(1).alias("body"), "turn", "role", "key", "text", "times", F.lit(None).cast(heads.schema["piece"].dataType).alias("piece"))
    order = ["conv", "body", "turn", "role", "key"]
    dealt = heads.unionByName(bodies).repartition(parts(rows.sparkSession), "conv").sortWithinPartitions(*order).select("conv", "body", "role", "text", "times", "piece")
    report = ", ".join(f"{c} long" for c in _REPORT) + ", audit string"
    cells = {"digest": f"{report}, repaired_sha256 string", "text": f"{report}, repaired string", "turns": "place long, role string, text string"}

    def run(batches):
        held, size, schema = [], 0, None

        def put(row, n):
            nonlocal held, size
            held.append(row)
            size += n
            if size >= 1 << 22 or len(held) >= 5000:
                out, held, size = held, [], 0
                return _batch(out, schema)

        def ended(conv, walk, sink, report):
            for role, text in walk.send(None):
                sink.add(role, text)
            if output != "turns":
                numbers, audit = report
                last = sink.end()
                return put((conv, *numbers, audit, last), len(audit) + len(last) + 64)

        conv = walk = None
        started = False
        for batch in batches:
            if schema is None:
                kinds = {"long": pa.int64(), "string": pa.string()}
                schema = pa.schema([("conv", batch.schema.field(0).type), *((n, kinds[t]) for n, t in (x.split(" ") for x in cells[output].split(", ")))])
            for c, body, role, text, times, piece in zip(*(x.to_pylist() for x in batch.columns)):
                if not started or c != conv:
                    if started and (done := ended(conv, walk, sink, report)):
                        yield done
                    for row in sink.rows if started and output == "turns" else ():
                        if done := put((conv, *row), len(row[2]) + 64):
                            yield done
                    conv, started, whole, sink, walk = c, True, _Whole(), _Sink(output), None
                if not body:
                    whole.add(piece)
                    continue
                if walk is None:
                    report = whole.report()
                    walk = _edited(report[1])
                    next(walk)
                for k in range(times):
                    for r, t in walk.send((role, text)):
                        sink.add(r, t)
                if output == "turns":  # rows may go before their conversation ends
                    for row in sink.rows:
                        if done := put((conv, *row), len(row[2]) + 64):
                            yield done
                    sink.rows = []
        if started:
            if done := ended(conv, walk, sink, report):
                yield done
            for row in sink.rows if output == "turns" else ():
                if done := put((conv, *row), len(row[2]) + 64):
                    yield done
        if held:
            yield _batch(held, schema)

    out = dealt.mapInArrow(run, f"conv {shape}, {cells[output]}")
    if ids is not None and output != "turns":
        every = ids.select(F.col(conv_col).alias("of")).distinct()
        out = every.join(out, F.col("of").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("of", "conv")
        last, none = {"digest": ("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)), "text": ("repaired", F.lit(""))}[output]
        out = out.select("conv", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _REPORT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce(last, none).alias(last))
    return out.withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults planted by the CRC-32 of `conversation:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fold = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = F.when(F.col("fold") == 1, "").when(F.col("fold") == 2, F.translate(blank(text_col), "".join(_ENDS), "")).otherwise(blank(text_col))
    rows = turns.withColumn("fold", fold).where("fold <> 0")
    return rows.select(F.col(conv_col), F.col(turn_col), F.when(F.col("fold") == 4, "user").otherwise(blank(role_col)).alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fold") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
