"""Conversation structure repair: the cheapest edits that give the roles ``(s?(ua)+)?``, by a bidirectional Dijkstra search.

The lattice of a conversation has a node for each number of rows taken and each state of the role pattern. Keep, Rerole and
Delete take a row, Insert takes none. One heap searches from the start, one back from the two ends; when the tops of both
add up to more than the best meeting, every optimal path crosses from what the first has settled to what the second has, so
all equal-cost crossings are known, and the least concatenation of their audits is the answer.

Rows are damaged, judged and sorted by Spark: one exchange by conversation, in which a conversation passes twice, first as codes
(a byte or two a row) and then as texts. The task keeps codes and labels only; texts stream through a running SHA-256, so a very
long conversation never stands in memory and a conversation is never gathered into one value. Solutions of short
conversations are remembered by their codes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after s, after u, after a; and where a role's initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Conversations of up to this many rows are remembered, so many of them in a worker.
REMEMBERED_ROWS, REMEMBERED = 64, 1 << 15
_SPACE = "' \t\n\x0b\x0c\r'"
_REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Row = tuple[str, int]  # initial of the role, fault
Node = tuple[int, int]  # rows taken, state


def _taking(row: Row) -> list[tuple[str, int, int, int]]:
    """Edges (edit, cost, state before, state after) that take a row."""
    initial, fault = row
    out = [(DELETE, DELETE_COST, s, s) for s in range(4)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        out += [(KEEP, more, a, b) for (a, i), b in STEPS.items() if i == initial]
        out += [(REROLE, REROLE_COST + more, a, b) for (a, i), b in STEPS.items() if i in NAMES]
    return out


_INSERTS = [(INSERT, INSERT_COST, a, b) for (a, i), b in STEPS.items() if i in NAMES]


class _Chain:
    """An audit as linked edits, shared by the paths that have it in common. A forward chain ends in its edit, a reverse one begins."""

    __slots__ = ("edit", "rest", "size")

    def __init__(self, edit: str, rest: _Chain | None) -> None:
        self.edit, self.rest = edit, rest
        self.size = rest.size + 1 if rest else 1

    def text(self) -> str:
        """Edits from this one on."""
        out, at = [], self
        while at:
            out.append(at.edit)
            at = at.rest
        return "".join(out)


def _less(x: _Chain | None, y: _Chain | None, forward: bool) -> bool:
    """Whether audit x is before y. Both are of one node and cost, so neither begins with the other."""
    if not forward:
        while x is not y and x and y:
            if x.edit != y.edit:
                return x.edit < y.edit
            x, y = x.rest, y.rest
        return False
    while x and y and x.size != y.size:
        x, y = (x.rest, y) if x.size > y.size else (x, y.rest)
    first = False
    while x is not y:
        if x.edit != y.edit:
            first = x.edit < y.edit
        x, y = x.rest, y.rest
    return first


class _Search:
    """One direction of the search. Nodes of equal cost are settled in the order in which edges of no cost lead."""

    def __init__(self, rows: list[Row], starts: list[Node], forward: bool) -> None:
        self.rows, self.forward, self.order = rows, forward, count()
        self.found: dict[Node, tuple[int, _Chain | None]] = {n: (0, None) for n in starts}
        self.settled: set[Node] = set()
        self.heap = [(0, n[0] if forward else -n[0], next(self.order), n) for n in starts]

    def top(self) -> int | None:
        while self.heap and self.heap[0][-1] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def _edges(self, node: Node) -> Iterator[tuple[str, int, Node]]:
        i, state = node
        row = i if self.forward else i - 1
        taking = _taking(self.rows[row]) if 0 <= row < len(self.rows) else []
        for moved, edges in ((0, _INSERTS), (1 if self.forward else -1, taking)):
            for edit, cost, before, after in edges:
                if state == (before if self.forward else after):
                    yield edit, cost, (i + moved, after if self.forward else before)

    def settle(self) -> tuple[Node, list[Node]]:
        """Settle the nearest node; it and the nodes it leads to."""
        cost, _, _, node = heapq.heappop(self.heap)
        self.settled.add(node)
        chain, reached = self.found[node][1], []
        for edit, more, to in self._edges(node):
            if to in self.settled:
                continue
            known, new = self.found.get(to), _Chain(edit, chain)
            if known is None or cost + more < known[0] or (cost + more == known[0] and _less(new, known[1], self.forward)):
                self.found[to] = (cost + more, new)
                reached.append(to)
                if known is None or cost + more < known[0]:
                    heapq.heappush(self.heap, (cost + more, to[0] if self.forward else -to[0], next(self.order), to))
        return node, reached


def cheapest_edits(rows: list[Row]) -> tuple[int, str]:
    """Least cost and, of the audits that have it, the ASCII-least."""
    ahead = _Search(rows, [(0, START)], True)
    back = _Search(rows, [(len(rows), s) for s in ENDS], False)
    best = DELETE_COST * len(rows)  # Deleting all rows is always possible.
    while (x := ahead.top()) is not None and (y := back.top()) is not None and x + y <= best:
        one, other = (ahead, back) if len(ahead.heap) <= len(back.heap) else (back, ahead)
        node, reached = one.settle()
        for n in (node, *reached):
            if n in other.found:
                best = min(best, one.found[n][0] + other.found[n][0])
    audits = []
    ends = {(len(rows), s) for s in ENDS}
    for node, (cost, chain) in ahead.found.items():
        if node in ahead.settled and node not in ends:
            continue
        known = back.found.get(node)
        if known and node in back.settled | ends and cost + known[0] == best:
            audits.append((chain.text()[::-1] if chain else "") + (known[1].text() if known[1] else ""))
    return best, min(audits)


_remembered = lru_cache(maxsize=REMEMBERED)(lambda rows: cheapest_edits(list(rows)))


class _Conversation:
    """A conversation as it passes: codes first, then texts."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.rows: list[Row] = []
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.low = self.high = self.turn = None
        self.distinct = 0
        self.edits: Iterator[str] | None = None
        self.cost, self.audit = 0, ""
        self.digest, self.state, self.begun = hashlib.sha256(), START, False

    def code(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.rows.append((initial, fault))
        self.counts[fault] += 1
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.distinct += 1

    def _solve(self) -> None:
        if self.edits is None:
            solve = _remembered if len(self.rows) <= REMEMBERED_ROWS else lambda rows: cheapest_edits(list(rows))
            self.cost, self.audit = solve(tuple(self.rows))
            self.edits = iter(self.audit)

    def _write(self, initial: str, role: str, text: str) -> None:
        self.state = STEPS[self.state, initial]
        self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun = True

    def _expected(self) -> str:
        return "a" if self.state == USER else "u"

    def text(self, initial: str, role: str, text: str) -> None:
        self._solve()
        for edit in self.edits:
            if edit == INSERT:
                self._write(self._expected(), NAMES[self._expected()], "")
                continue
            if edit == KEEP:
                self._write(initial, role, text)
            elif edit == REROLE:
                self._write(self._expected(), NAMES[self._expected()], text)
            return

    def result(self) -> tuple:
        self._solve()
        for _ in self.edits:
            self._write(self._expected(), NAMES[self._expected()], "")
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        _, blank, duplicate, truncated = self.counts
        return (self.conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, second, place) to a row for each conversation."""
    names = [f.split()[0] for f in _REPAIRED.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in _REPAIRED.split(", ")]
    now: _Conversation | None = None

    def out(done: list[_Conversation]) -> pa.RecordBatch:
        columns = list(zip(*(c.result() for c in done), strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        done = []
        for conv_id, second, lost, turn, initial, role, fault, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now)
                now = _Conversation(conv_id)
            if lost:
                continue
            if second:
                now.text(initial, role, text)
            else:
                now.code(turn, initial, fault)
        if done:
            yield out(done)
    if now:
        yield out([now])


def damaged(turns: DataFrame) -> DataFrame:
    """The rows ``conv_id, turn, role, text, lost`` after faults by the hash of ``conv_id:turn``, by its remainder of 20: 0 loses the
    row (``lost``; the conversation stays known), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the
    user's. Null roles and texts become one space, null ids and turns are hashed as one."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Each row with its ``place`` in the conversation and its first ``fault``; lost rows are placed apart."""
    alike = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    within = Window.partitionBy("conv_id", "lost").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    trimmed = F.expr(f"trim(BOTH {_SPACE} FROM text)")
    fault = F.when(trimmed == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED)
    first = rows.select("*", F.row_number().over(alike).alias("nth")).select("*", F.row_number().over(within).alias("place"))
    return first.select("conv_id", "turn", "role", "text", "lost", "place", fault.otherwise(FINE).alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cost and audit of the cheapest repair, and the repaired text's hash.

    ``rows`` has ``conv_id, turn, role, text, lost`` without null roles and texts. Rows are in order of turn (null first), then
    role and text; rows whose ``conv_id`` is null are one conversation. A role's initial is its first character; an empty role
    has none and cannot be kept. A conversation of lost rows only has zeros, no audit and the hash of nothing. Equal rows of
    one turn are both there, the second one as a duplicate. One conversation is one sequence, so its rows pass one task, as a
    stream; memory grows by its number of rows, not by its texts.
    """
    passes = F.explode(F.array(F.lit(False), F.lit(True))).alias("second")
    passing = judged(rows.repartition("conv_id")).select("*", passes).select(
        "conv_id", "second", "lost", "turn", F.substring("role", 1, 1).alias("initial"), F.when(F.col("second"), F.col("role")).alias("role"),
        "fault", F.when(F.col("second"), F.col("text")).alias("text"), "place",
    )
    held = passing.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "second", "place").drop("place")
    return held.mapInArrow(_repair, _REPAIRED)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Damage the conversations, then repair them. Every ``conv_id`` of ``turns`` has a row; other columns are not read."""
    return repair(damaged(turns))
