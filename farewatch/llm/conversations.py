"""Repair of conversation structure: the cheapest edits that give ``(s?(ua)+)?``.

Each turn is kept (0), given the role user or assistant (1) or deleted (2, required for blank and
repeated turns), and empty user or assistant turns are inserted (5); a truncated turn that stays adds
5. ``search`` finds the least (cost, audit) by depth-first branch-and-bound: an explicit stack of
(turn, state) nodes taken in ASCII order of the edits, so of equal costs the first one reached is the
ASCII-least; suffix lower bounds from the relaxed automaton that only knows whose turn it is; an
incumbent, first from a greedy dive along the bounds; and a dominance table that cuts a node reached
at no lower cost than before. When the stack is empty the incumbent is proved optimal.

Spark range-partitions the turns by conversation, turn, role and text and sorts them; tasks stream
them. A conversation that lies inside one partition is repaired there. The first and last one of each
partition, which may go on in the next, are written out and treated in pieces of at most ``PIECE``
turns, whatever the conversation's length: repeats are found by an aggregation over (conversation,
role and text), every piece is searched for each pair of entry and exit states, the pieces' tables
are chained per conversation (four prefixes, their common part set aside), and the turns are then
streamed once more with their piece's edits. So a conversation with a third of all turns is dealt
over all tasks until its edits are known; only its final hash, which is sequential, and its edit
string, which is the result, are made by one task, turn by turn.

Defined results: a null role or text is one space, a null conv_id is a conversation of its own; null
turns come first; rows with the same turn are ordered by role, then the text's first characters, then
its hash; a role's initial is its first character (none for the empty role); conversations without
any row after damage give zeros, an empty audit and the empty string's hash; an empty table gives an
empty table; columns other than conv_id, turn, role and text are ignored. A gap count beyond 64 bits
is the largest long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

# fixed values: costs of the edits, and the adjacent role initials that are in order
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
PIECE = 1024                    # turns of a long conversation that are searched together
KEY_CHARS = 64                  # of the text, in the order of rows with the same turn
LONGEST = (1 << 63) - 1

# states of the automaton: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
REACHES = {START: {START}, SYSTEM: {START, SYSTEM}}     # states an end can be reached from; others from all
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
SPACE = " \t\n\v\f\r"

_INF = 1 << 60


def _next(state: int) -> int:
    """The role that may follow, apart from system at the start."""
    return ASSISTANT if state == USER else USER


def code_of(role: str, text: str, repeated: bool) -> str:
    """One character per turn for the search: its role's initial (``?``: any other one) if it may
    stay, in upper case if truncated, else ``-``."""
    if repeated or not NOT_BLANK.search(text):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return initial if text.rstrip(SPACE)[-1] in ".!?" else initial.upper() if initial != "?" else "!"


def _bounds(codes: str, ends: tuple[int, ...]) -> list[tuple[int, int]]:
    """Lower bounds of the cost from each turn on, for (a user or system turn is due, an assistant
    turn is due), with system turns allowed wherever a user turn is."""
    due = any(e != USER for e in ends), USER in ends
    user, assistant = (0 if due[0] else INSERT), (0 if due[1] else INSERT)
    out = [(user, assistant)]
    for c in reversed(codes):
        if c == "-":
            user, assistant = user + DELETE, assistant + DELETE
        else:
            late = TRUNCATED if c.isupper() or c == "!" else 0
            kind = c.lower()
            u = min(DELETE + user, late + (KEEP if kind == "u" else REROLE) + assistant, late + user if kind == "s" else _INF)
            a = min(DELETE + assistant, late + (KEEP if kind == "a" else REROLE) + user)
            user, assistant = min(u, INSERT + a), min(a, INSERT + u)
        out.append((user, assistant))
    return out[::-1]


def _edits(codes: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, turn, state) of the edits at a node, in ASCII order."""
    out = []
    if i < len(codes):
        out.append(("D", DELETE, i + 1, state))
    out.append(("I", INSERT, i, _next(state)))
    if i < len(codes) and codes[i] != "-":
        c = codes[i]
        late = TRUNCATED if c.isupper() or c == "!" else 0
        kind, due = c.lower(), _next(state)
        if kind == "s" and state == START:
            out.append(("K", KEEP + late, i + 1, SYSTEM))
        elif (kind == "u" and due == USER) or (kind == "a" and due == ASSISTANT):
            out.append(("K", KEEP + late, i + 1, due))
        out.append(("R", REROLE + late, i + 1, due))
    return out


@lru_cache(200_000)
def search(codes: str, entry: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least (cost, audit) from ``entry`` over all turns to one of the states ``ends``; of equal
    costs the ASCII-least audit. None if the ends cannot be reached."""
    n, bounds = len(codes), _bounds(codes, ends)
    useful = set().union(*(REACHES.get(e, set(range(4))) for e in ends))
    if entry not in useful:
        return None

    def bound(i, state):
        return bounds[i][state == USER]
    # a greedy dive for the first incumbent; where it ends nowhere the search begins without one
    i, state, cost = 0, entry, 0
    for _ in range(2 * n + 4):
        if i == n and state in ends:
            break
        steps = [s for s in _edits(codes, i, state) if s[3] in useful]
        if not steps:
            break
        _, c, i, state = min(steps, key=lambda s: s[1] + bound(s[2], s[3]))
        cost += c
    best_cost, best_audit = (cost, None) if i == n and state in ends else (_INF, None)
    reached: dict[int, int] = {}
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, edit = stack.pop()
        total = cost + bound(i, state)
        if total > best_cost or (total == best_cost and best_audit is not None):
            continue                                        # a later audit of the same cost is ASCII-greater
        node = 4 * i + state
        if reached.get(node, _INF) <= cost:
            continue
        reached[node] = cost
        if depth:
            path[depth - 1:] = [edit]
        if i == n and state in ends:
            best_cost, best_audit = cost, "".join(path[:depth])
        for e, c, j, s in reversed(_edits(codes, i, state)):
            if s in useful:
                stack.append((j, s, cost + c, depth + 1, e))
    return None if best_audit is None else (best_cost, best_audit)


def table(codes: str) -> list[list[tuple[int, str] | None]]:
    """The least (cost, audit) for every entry and exit state of a piece. With the same ends and
    cost no audit is the beginning of another, so tables can be chained."""
    return [[search(codes, entry, (end,)) for end in range(4)] for entry in range(4)]


class Chain:
    """Best prefixes per state over the pieces of one conversation."""

    def __init__(self):
        self.common, self.open = [], {START: (0, "")}

    def add(self, piece: list[list[tuple[int, str] | None]]) -> None:
        new: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in self.open.items():
            for end, least in enumerate(piece[entry]):
                if least is not None and (end not in new or (cost + least[0], audit + least[1]) < new[end]):
                    new[end] = (cost + least[0], audit + least[1])
        shared = commonprefix([a for _, a in new.values()])
        self.common.append(shared)
        self.open = {s: (c, a[len(shared):]) for s, (c, a) in new.items()}

    def best(self) -> tuple[int, str]:
        # turns may still be inserted at the end
        ends = [(c, a) for s, (c, a) in self.open.items() if s in ENDS]
        ends += [(c + least[0], a + least[1]) for s, (c, a) in self.open.items() if (least := search("", s))]
        cost, audit = min(ends)
        return cost, "".join(self.common) + audit


class Repair:
    """Applies an audit to a conversation's turns, one after the other."""

    def __init__(self, state: int = START):
        self.state = state

    def _role(self, role: str | None) -> str:
        if role is not None and role[:1] == "s" and self.state == START:
            self.state = SYSTEM
            return role
        self.state = _next(self.state)
        return ROLES[self.state] if role is None else role

    def insert(self) -> str:
        return self._role(None)

    def turn(self, edit: str, role: str) -> str | None:
        """The turn's role, or None if it goes."""
        return None if edit == "D" else self._role(role if edit == "K" else None)


def apply_audit(audit: Iterator[str], rows: Iterable[tuple[str, str]], repair: Repair) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns; ``audit`` is left after the last turn's edit."""
    for role, text in rows:
        while (edit := next(audit)) == "I":
            yield edit, repair.insert(), ""
        if (new := repair.turn(edit, role)) is not None:
            yield edit, new, text


class Counts:
    """Faults of a stretch of turns in order; stretches add up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None                       # role initials at the borders
        self.low = self.high = None                         # least and greatest turn; the turns are in order

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if not NOT_BLANK.search(text):
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif text.rstrip(SPACE)[-1] not in ".!?":
            self.truncated += 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def join(self, other: Counts) -> None:
        self.illegal += other.illegal
        for f in ("blank", "duplicate", "truncated"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        if other.first is not None:
            if self.first is None:
                self.first = other.first
            elif self.last + other.first not in LEGAL_PAIRS:
                self.illegal += 1
            self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def report(self) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LONGEST)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
REPORT = [("conv_id", pa.int64(), "long"), *[(c, pa.int64(), "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
          ("audit", pa.string(), "string"), ("repaired_sha256", pa.string(), "string")]
TURNS = [("conv_id", pa.int64(), "long"), ("position", pa.int64(), "long"), ("edit", pa.string(), "string"), ("role", pa.string(), "string"),
         ("text", pa.string(), "string")]
ROW = [("turn", pa.int64(), "long"), ("old_role", pa.string(), "string"), ("old_text", pa.string(), "string"),
       ("part", pa.int64(), "long"), ("at", pa.int64(), "long"), ("same", pa.binary(), "binary")]
PIECES = [("conv_id", pa.int64(), "long"), ("part", pa.int64(), "long"), ("piece", pa.int64(), "long"), ("codes", pa.string(), "string"),
          *[(c, pa.string() if c in ("first", "last") else pa.int64(), "string" if c in ("first", "last") else "long") for c in FIELDS],
          ("costs", pa.list_(pa.int64()), "array<long>"), ("audits", pa.list_(pa.string()), "array<string>")]


def _ddl(columns) -> str:
    return ", ".join(f"{c} {t}" for c, _, t in columns)


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, columns, rows: int = 4096, chars: int = 4_000_000):
        self.schema, self.names = pa.schema([(c, t) for c, t, _ in columns]), [c for c, _, _ in columns]
        self.rows, self.size, self.limit, self.chars = [], 0, rows, chars

    def add(self, row: dict, size: int = 0) -> bool:
        self.rows.append(row)
        self.size += size
        return len(self.rows) >= self.limit or self.size >= self.chars

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({c: [r.get(c) for r in self.rows] for c in self.names}, schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _same(role: str, text: str) -> bytes:
    """Stands for equal (role, text)."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "replace")).digest()[:16]


def _whole(rows: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """(report, repaired turns) of a whole conversation's rows (turn, role, text)."""
    seen, counts, codes = set(), Counts(), []
    for turn, role, text in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        counts.add(turn, role, text, repeated)
        codes.append(code_of(role, text, repeated))
    cost, audit = search("".join(codes))
    rest, repair = iter(audit), Repair()
    turns = list(apply_audit(rest, [(r, t) for _, r, t in rows], repair))
    turns += [("I", repair.insert(), "") for _ in rest]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode("utf-8", "replace")).hexdigest()
    return counts.report() | {"cost": cost, "audit": audit, "repaired_sha256": digest}, turns


def _closed(turns: bool, most: int):
    """Conversations inside a partition; rows of those at its borders come out as they are."""
    def run(batches):
        part, out, before = TaskContext.get().partitionId(), _Out((TURNS if turns else REPORT) + ROW), None
        for number, (conv, group) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            if before is not None:                          # it has a successor, so it ends here
                yield from _emit(out, *before)
            before = None
            if number:
                held, at = [], 0
                for row in group:                           # hold no more than a piece: what is longer is treated as open
                    held.append(row)
                    if len(held) > most:
                        yield from _open(out, conv, part, held, at)
                        at, held = at + len(held), []
                if at:
                    yield from _open(out, conv, part, held, at)
                else:
                    before = conv, held, turns, part
            else:
                for at, row in enumerate(group):
                    yield from _open(out, conv, part, [row], at)
        if before is not None:                              # the last one may go on elsewhere
            yield from _open(out, before[0], part, before[1], 0)
        if out.rows:
            yield out.batch()
    return run


def _emit(out: _Out, conv, held: list, turns: bool, _part) -> Iterator[pa.RecordBatch]:
    report, repaired = _whole([(t, r, x) for _, t, r, x, dropped in held if not dropped])
    if not turns:
        if out.add({"conv_id": conv} | report):
            yield out.batch()
        return
    for k, (edit, role, text) in enumerate(repaired):
        if out.add({"conv_id": conv, "position": k, "edit": edit, "role": role, "text": text}, len(text)):
            yield out.batch()


def _open(out: _Out, conv, part: int, held: list, at: int) -> Iterator[pa.RecordBatch]:
    for k, (_, turn, role, text, dropped) in enumerate(held):
        row = {"conv_id": conv, "part": part, "at": at + k}
        if not dropped:
            row |= {"turn": turn, "old_role": role, "old_text": text, "same": _same(role, text)}
        if out.add(row, len(text or "")):
            yield out.batch()


def _pieces(batches):
    """Codes, counts and search tables of the pieces, from their turns in order."""
    out = _Out(PIECES, 256)
    for (conv, part, piece), group in groupby(_rows(batches), key=lambda r: r[:3]):
        counts, codes = Counts(), []
        for _, _, _, _, turn, role, text, repeated in group:
            if role is not None:
                counts.add(turn, role, text, repeated)
                codes.append(code_of(role, text, repeated))
        least = [x for row in table("".join(codes)) for x in row]
        row = {"conv_id": conv, "part": part, "piece": piece, "codes": "".join(codes)} | {f: getattr(counts, f) for f in FIELDS}
        row |= {"costs": [x and x[0] for x in least], "audits": [x and x[1] for x in least]}
        if out.add(row, 17 * len(codes)):
            yield out.batch()
    if out.rows:
        yield out.batch()


def _chained(batches):
    """Per open conversation its report so far, and per piece the edits that fall to it."""
    out = _Out([*REPORT, ("part", pa.int64(), "long"), ("piece", pa.int64(), "long"), ("edits", pa.string(), "string")], 256)
    at = {c: k for k, (c, _, _) in enumerate(PIECES)}
    for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
        chain, counts, places = Chain(), Counts(), []
        for row in group:
            own = Counts()
            for f in FIELDS:
                setattr(own, f, row[at[f]])
            counts.join(own)
            costs, audits = row[at["costs"]], row[at["audits"]]
            chain.add([[(costs[4 * e + x], audits[4 * e + x]) if costs[4 * e + x] is not None else None for x in range(4)] for e in range(4)])
            places.append((row[at["part"]], row[at["piece"]], len(row[at["codes"]])))
        cost, audit = chain.best()
        if out.add({"conv_id": conv, "cost": cost, "audit": audit} | counts.report(), len(audit)):
            yield out.batch()
        start = 0
        for k, (part, piece, n) in enumerate(places):
            end = start
            while n or (k + 1 == len(places) and end < len(audit)):      # inserts after the last turn fall to the last piece
                n -= audit[end] != "I"
                end += 1
            if out.add({"conv_id": conv, "part": part, "piece": piece, "edits": audit[start:end]}, end - start):
                yield out.batch()
            start = end
    if out.rows:
        yield out.batch()


def _streamed(turns: bool):
    """Open conversations' repaired turns or their hashes: each piece's edits, then its turns."""
    columns = TURNS if turns else [REPORT[0], REPORT[-1]]

    def run(batches):
        out = _Out(columns)
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            digest, repair, position, edits = hashlib.sha256(), Repair(), 0, iter("")

            def put(edit, role, text):
                nonlocal position
                digest.update(("\n" if position else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                position += 1
                return turns and out.add({"conv_id": conv, "position": position - 1, "edit": edit, "role": role, "text": text}, len(text))
            for _, _, _, at, new_edits, role, text in group:
                if at < 0:
                    for edit in edits:                       # what stands after the last turn of the piece before
                        if put(edit, repair.insert(), ""):
                            yield out.batch()
                    edits = iter(new_edits)
                elif role is not None:
                    for made in apply_audit(edits, [(role, text)], repair):
                        if put(*made):
                            yield out.batch()
            for edit in edits:
                if put(edit, repair.insert(), ""):
                    yield out.batch()
            if not turns and out.add({"conv_id": conv, "repaired_sha256": digest.hexdigest()}):
                yield out.batch()
        if out.rows:
            yield out.batch()
    return run, _ddl(columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the contract's damage; dropped rows stay as marks."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                                text("text").alias("text"), F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20)).alias("h"))
    changed = F.when(F.col("h") <= 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       (F.col("h") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("dropped"))


def _repaired(rows: DataFrame, turns: bool, most: int) -> DataFrame:
    keyed = rows.withColumns({"_t": F.substring("text", 1, KEY_CHARS), "_h": F.xxhash64("role", "text"), "_n": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "dropped", "role", "_t", "_h", "_n"]       # nulls first; equal rows may be parted
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "dropped")
    columns = TURNS if turns else REPORT
    done = materialise(ranged.mapInArrow(_closed(turns, most), _ddl(columns + ROW)), "conversations")
    closed = done.where("part is null").select(*[c for c, _, _ in columns])
    rows = done.where("part is not null").select("conv_id", "part", F.floor(F.col("at") / most).alias("piece"), "at", "turn",
                                                 F.col("old_role").alias("role"), F.col("old_text").alias("text"), "same")
    first = rows.where("same is not null").groupBy("conv_id", "same").agg(F.min(F.struct("part", "at")).alias("f")) \
        .select(F.col("conv_id").alias("_c"), F.col("same").alias("_s"), F.col("f.part").alias("_p"), F.col("f.at").alias("_a"))
    here = (rows["part"] == F.col("_p")) & (rows["at"] == F.col("_a"))
    marked = rows.join(first, rows["conv_id"].eqNullSafe(F.col("_c")) & here, "left") \
        .select("conv_id", "part", "piece", "at", "turn", "role", "text", F.col("_p").isNull().alias("repeated"))
    place = ["conv_id", "part", "piece"]
    pieces = marked.repartition(*place).sortWithinPartitions(*place, "at").mapInArrow(_pieces, _ddl(PIECES))
    chained = materialise(pieces.repartition("conv_id").sortWithinPartitions(*place)
                          .mapInArrow(_chained, _ddl(REPORT) + ", part long, piece long, edits string"), "edits")
    text_type = F.lit(None).cast("string")
    edits = chained.where("part is not null").select(*place, F.lit(-1).cast("long").alias("at"), "edits", text_type.alias("role"), text_type.alias("text"))
    both = edits.unionByName(rows.select(*place, "at", text_type.alias("edits"), "role", "text"))
    run, ddl = _streamed(turns)
    streamed = both.repartition("conv_id").sortWithinPartitions(*place, "at").mapInArrow(run, ddl)
    if turns:
        return closed.unionByName(streamed)
    report = chained.where("part is null").select(*[c for c, _, _ in REPORT[:-1]])
    hashes = streamed.withColumnRenamed("conv_id", "_c")
    return closed.unionByName(report.join(hashes, report["conv_id"].eqNullSafe(hashes["_c"])).drop("_c"))


def repair_report(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per conv_id: faults, cost, audit and the hash of the repaired conversation."""
    return _repaired(rows, False, piece)


def repaired_turns(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations."""
    return _repaired(rows, True, piece)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read_table(spark, sf_dir, "conversations")))


# the same by a table of least (cost, audit) per turn and state; states as above
ORACLE = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0, 0, 0, 0, 0, 0, 0, 0]),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT raw.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS h FROM raw, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
              CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS late FROM numbered),
turns AS (SELECT *, blank OR again AS gone, CASE WHEN late THEN 5 ELSE 0 END AS extra FROM faults),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
             count(*) FILTER (WHERE late AND NOT gone) AS truncated,
             count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
nodes AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])} AS b FROM counts
  UNION ALL
  SELECT conv_id, i, state, min(b) AS b FROM (
    SELECT s.conv_id, t.i, e.state,
           {'cost': s.b.cost + e.cost, 'audit': s.b.audit || e.edit, 'said': s.b.said || e.said} AS b
    FROM (SELECT conv_id, i, state, b FROM nodes
          UNION ALL
          SELECT conv_id, i, CASE state WHEN 2 THEN 3 ELSE 2 END,
                 {'cost': b.cost + 5, 'audit': b.audit || 'I', 'said': b.said || [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END]} FROM nodes) s
    JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1,
    LATERAL (SELECT 'D' AS edit, 2 AS cost, s.state AS state, CAST([] AS VARCHAR[]) AS said
             UNION ALL SELECT 'K', extra, CASE WHEN x = 's' THEN 1 WHEN x = 'u' THEN 2 ELSE 3 END, [role || ':' || text]
             WHERE NOT gone AND ((x = 's' AND s.state = 0) OR (x = 'u' AND s.state <> 2) OR (x = 'a' AND s.state = 2))
             UNION ALL SELECT 'R', 1 + extra, CASE s.state WHEN 2 THEN 3 ELSE 2 END, [CASE s.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]
             WHERE NOT gone) e) c
  GROUP BY conv_id, i, state),
least AS (
  SELECT f.conv_id, min(f.b) AS b FROM (
    SELECT conv_id, i, state, b FROM nodes
    UNION ALL
    SELECT conv_id, i, 3, {'cost': b.cost + 5, 'audit': b.audit || 'I', 'said': b.said || ['assistant:']} FROM nodes WHERE state = 2) f
  JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.i WHERE f.state IN (0, 3) GROUP BY f.conv_id)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(l.b.cost, 0) AS BIGINT) AS cost, coalesce(l.b.audit, '') AS audit,
       sha256(coalesce(array_to_string(l.b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
