"""Least repair of conversations whose turns are blank, repeated, cut off or out of order, by a dynamic program over rank-compressed layers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES

#: Costs of edits. A truncated turn that stays adds one.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What has been said so far: nothing, the system's turn, a user's turn that waits for its answer, an answer. The first and last may end a conversation.
NOTHING, SYSTEM, USER, ANSWER = range(4)
#: Pairs of neighbouring roles' first letters that are in order.
IN_ORDER = {"su", "ua", "au"}
#: Turns that wait for their decision before it is looked for; then twice as many as were left.
WAIT = 64
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


class Layer(NamedTuple):
    """Of each state the least cost of reaching it, above the layer's least, and the rank of its audit among the layer's; None if it can't be, or needn't be, reached."""

    states: tuple[tuple[int, int] | None, ...]


START = Layer(((0, 0), None, None, None))


def said(state: int, letter: str) -> int | None:
    """The state after a turn of a role's first letter; None if it may not come then."""
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    if letter == "u":
        return USER if state != USER else None
    return ANSWER if letter == "a" and state == USER else None


def due(state: int) -> str:
    """Who may be inserted, or take over a turn, now."""
    return "a" if state == USER else "u"


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = said(state, due(state))
    return state


class Repair:
    """The program's steps. A macro edit is a run of insertions and what happens to the next turn: no such code begins another, so
    comparing audits of a layer needs no more than the ranks of the layer before and the codes.

    Costs above the layer's least are small where they matter (see ``pruned``), so few layers differ, and each step out of one is worked out once.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def step(self, layer: Layer, letter: str, forced: bool, cut: bool) -> tuple[Layer, int, tuple]:
        """The next layer, by how much its least cost rises, and of each state (state before, code); for a turn of a role's first letter, one that must be deleted or that is cut off."""
        found = self.known.get((layer, letter, forced, cut))
        if found is None:
            found = self.known[layer, letter, forced, cut] = self._step(layer, letter, forced, cut)
        return found

    def _step(self, layer: Layer, letter: str, forced: bool, cut: bool) -> tuple[Layer, int, tuple]:
        best: list[tuple | None] = [None] * 4
        for before, reached in enumerate(layer.states):
            if reached is None:
                continue
            for run in range(3):  # two insertions lead back to where one started, or from nothing to an answer
                now = inserted(before, run)
                ways = [("D", now, DELETE)]
                if not forced:
                    ways += [("K", said(now, letter), KEEP + CUT * cut), ("R", said(now, due(now)), REROLE + CUT * cut)]
                for op, to, cost in ways:
                    if to is not None:
                        way = (reached[0] + INSERT * run + cost, reached[1], "I" * run + op, before)
                        best[to] = way if best[to] is None else min(best[to], way)
        best = pruned(best)
        least = min(b[0] for b in best if b)
        ranks = {code: k for k, code in enumerate(sorted({b[1:3] for b in best if b}))}
        states = tuple(b and (b[0] - least, ranks[b[1:3]]) for b in best)
        return Layer(states), least, tuple(b and (b[3], b[2]) for b in best)


def pruned(best: list[tuple | None]) -> list[tuple | None]:
    """Without states that can't be on a cheapest way: whatever follows them can follow another state for less.

    An answer takes what a system's turn takes, and what nothing takes once a system's turn is deleted (3); a waiting user's turn does so after an insertion (2).
    """
    best = list(best)
    for state, other, more in ((NOTHING, ANSWER, DELETE), (NOTHING, USER, DELETE + INSERT), (SYSTEM, ANSWER, 0), (SYSTEM, USER, INSERT)):
        if best[state] and best[other] and best[state][0] > best[other][0] + more:
            best[state] = None
    return best


class Conversation:
    """One conversation as its turns come in order: counts, and decisions as soon as all ways that are left agree in them."""

    def __init__(self, conv_id: int | None, repair: Repair):
        self.conv_id, self.repair = conv_id, repair
        self.turn, self.first, self.turns = None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.role = self.last = None
        self.layer, self.state = START, NOTHING  # that of all turns; that after the turns decided
        self.waiting: list[tuple[tuple, str, str]] = []
        self.wait = WAIT
        self.codes: list[str] = []
        self.out: list[tuple[str, str, str]] = []

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.turns == 0 else self.first
            self.turns += 1
        letter = role[:1]
        if self.role is not None:
            self.illegal += self.role[:1] + letter not in IN_ORDER
        repeated = repeated or self.last == (turn, role, text)
        self.turn, self.role, self.last = turn, role, (turn, role, text)
        end = text.rstrip(SPACES)[-1:]
        blank, cut = not end, end not in (".", "!", "?")
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut and not repeated and not blank
        self.layer, more, moves = self.repair.step(self.layer, letter, blank or repeated, cut)
        self.cost += more
        self.waiting.append((moves, role, text))
        if len(self.waiting) >= self.wait:
            self._settle({s for s, x in enumerate(self.layer.states) if x})
            self.wait = WAIT + 2 * len(self.waiting)

    def end(self) -> None:
        ways = [(x[0] + INSERT * run, x[1], run, s) for s, x in enumerate(self.layer.states) if x for run in range(3) if inserted(s, run) in (NOTHING, ANSWER)]
        cost, _, run, state = min(ways)
        self.cost += cost
        self._settle({state})
        self._insert(run)
        self.codes.append("I" * run)

    def _settle(self, states: set[int]) -> None:
        """Decide what all ways that end in states agree in."""
        decided = len(self.waiting)
        while len(states) > 1 and decided:
            decided -= 1
            states = {self.waiting[decided][0][s][0] for s in states}
        if not decided:
            return
        state, codes = states.pop(), []
        for moves, _, _ in reversed(self.waiting[:decided]):
            before, code = moves[state]
            codes.append(code)
            state = before
        for code, (_, role, text) in zip(reversed(codes), self.waiting[:decided], strict=True):
            self._insert(len(code) - 1)
            if code[-1] == "K":
                self._say("keep", role, text, role[:1])
            elif code[-1] == "R":
                letter = due(self.state)
                self._say("rerole", "user" if letter == "u" else "assistant", text, letter)
            self.codes.append(code)
        del self.waiting[:decided]

    def _insert(self, times: int) -> None:
        for _ in range(times):
            letter = due(self.state)
            self._say("insert", "user" if letter == "u" else "assistant", "", letter)

    def _say(self, edit: str, role: str, text: str, letter: str) -> None:
        self.state = said(self.state, letter)
        self.out.append((edit, role, text))

    def gaps(self) -> int:
        return self.turn - self.first + 1 - self.turns if self.turns else 0


def _rows(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, kind, turn, role, text, digest): of each conversation a row of kind 0, then by turn, null first, digests of what was said before (1) and turns (2), these by role and text.

    Only digests meet by conversation and content; texts are moved once.
    """
    none = lambda kind: F.lit(None).cast(kind)
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    digests = turns.select("conv_id", "turn", key.alias("digest"))
    again = F.rank().over(W.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    seen = digests.withColumn("again", again).where("again").select("conv_id", "turn", "digest").distinct()
    heads = ids.select("conv_id", F.lit(0).alias("kind"), none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("digest"))
    marks = seen.select("conv_id", F.lit(1).alias("kind"), "turn", none("string").alias("role"), none("string").alias("text"), "digest")
    rows = heads.unionByName(marks).unionByName(turns.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text", none("binary").alias("digest")))
    order = (F.asc_nulls_first("conv_id"), F.when(F.col("kind") == 0, 0).otherwise(1), F.asc_nulls_first("turn"), "kind", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _told(turns: DataFrame, ids: DataFrame, schema: str, tell) -> DataFrame:
    """What ``tell`` makes of each conversation and its edits decided so far: rows of a schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, now, at, seen = Repair(), None, None, set()
        kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in schema.split(", ")]
        names = [f.split()[0] for f in schema.split(", ")]
        made: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for conv_id, kind, turn, role, text, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "digest")), strict=True):
                if kind == 0:
                    if now is not None:
                        now.end()
                        out += tell(now, made, True)
                    now, at, seen, made = Conversation(conv_id, repair), None, set(), {}
                    continue
                if (turn is None, turn) != at:
                    at, seen = (turn is None, turn), set()
                if kind == 1:
                    seen.add(digest)
                    continue
                repeated = bool(seen) and hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] in seen
                now.add(turn, role, text, repeated)
                if len(now.out) > WAIT:
                    out += tell(now, made, False)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
        if now is not None:
            now.end()
            out = tell(now, made, True)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return _rows(turns, ids).mapInArrow(run, schema)


def _of(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role, text)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text) of each conversation after its cheapest repair: place from 0, what was done (keep, rerole, insert), role and text.

    See ``repair_reports`` for what is repaired, and how.
    """

    def tell(now: Conversation, made: dict, last: bool) -> list[tuple]:
        start = made.get("place", 0)
        rows = [(now.conv_id, start + k, *x) for k, x in enumerate(now.out)]
        made["place"] = start + len(rows)
        now.out.clear()
        return rows

    turns = _of(turns)
    return _told(turns, turns.select("conv_id").distinct(), TURNS, tell)


def repair_reports(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text), and of ``ids`` (conv_id) if given: its faults and cheapest repair.

    gaps: turn numbers that lack between the least and the largest. blank, duplicate, truncated: turns by their first fault: no
    character but ASCII white space; role and text said before; a last character that is none of ``.!?``. illegal: neighbours out of order.
    cost and audit: the cheapest edits (Keep 0, Rerole to user or assistant 2, Delete 3, needed for blank and duplicate turns, Insert an
    empty turn 2, one more for a truncated turn that stays) after which roles' first letters are (s?(ua)+)?, by their initials;
    the least audit of equally cheap ones. repaired_sha256: SHA-256 of its ``role:text`` lines.

    Turns go by number, null first, then role and text. A null role or text is one space; null ids are one conversation.
    A role of another first letter, or none, can't be kept. Extra columns are not read. A conversation without turns has zeros, no
    audit and the empty text's hash. Decided turns are hashed and let go, so a long conversation holds a few turns and its audit.
    """

    def tell(now: Conversation, made: dict, last: bool) -> list[tuple]:
        sha = made.setdefault("sha", hashlib.sha256())
        for _, role, text in now.out:
            sha.update(("\n" * made.get("any", 0) + f"{role}:{text}").encode())
            made["any"] = 1
        now.out.clear()
        if not last:
            return []
        return [(now.conv_id, now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, now.cost, "".join(now.codes), sha.hexdigest())]

    turns = _of(turns)
    all_ids = turns.select("conv_id") if ids is None else turns.select("conv_id").unionByName(ids.select(F.col("conv_id").cast("bigint").alias("conv_id")))
    return _told(turns, all_ids.distinct(), REPORT, tell)


def damaged(df: DataFrame, every: int = 20) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` (nulls as one space) modulo ``every``: 0 no row, 1 no text, 2 no ``.!?``, 3 the row twice, 4 role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % every
    rows = _of(df).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice).drop("copy")
