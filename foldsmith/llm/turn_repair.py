"""Repair of the structure of conversations by a Viterbi decoder with survivor coalescence.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: perhaps one system turn, then user and
assistant in turn, ending with the assistant; or nothing.  Each row is kept, reroled or deleted, and empty turns can be
inserted anywhere; the cheapest edits win, and of equally cheap ones those whose initials (D, I, K, R) come first in
ASCII order.

The decoder has four states: nothing yet, after system, after user, after assistant.  Its survivors are paths in a tree
of back pointers whose nodes count their references: nodes that no survivor needs are freed, chains are joined, and as
soon as all survivors share an ancestor the edits up to it are emitted and the rows they decide are let go.  What is
held of a conversation is the part that is still open.  Two survivors of equal cost are compared over all of their open
parts: a node has at most one child per edit, so the first edits after their last common node decide.  (One cannot be
the beginning of the other: what it lacked would be inserts only, and those cost.)

Rows stream through a task in the order of their conversation; a task never holds a conversation's texts at once.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role that comes next, and the state it leads to; a system turn can only come first.
NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
SPACE = " \t\n\v\f\r"
LEGAL_PAIRS = {"su", "ua", "au"}


class Node:
    """A stretch of edits; ``refs`` counts its children and the survivors that end in it."""
    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: Node | None, edits: bytes):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 0
        if parent is not None:
            parent.refs += 1


class Decoder:
    """Edits of one conversation; ``emit(edits)`` gets each stretch as soon as it is decided."""

    def __init__(self, emit: Callable[[bytes], None]):
        self.emit, self.root = emit, Node(None, b"")
        self.survivors: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self.root.refs += 1
        self._insert()

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple[int, Node, bytes]] = {}

        def offer(state, cost, node, edit):
            if state not in best or (cost, 0) < (best[state][0], 0) or (
                    cost == best[state][0] and self._before(node, edit, *best[state][1:])):
                best[state] = (cost, node, edit)

        for state, (cost, node) in self.survivors.items():
            offer(state, cost + COST[DELETE], node, DELETE)
            if must_go:
                continue
            stays = cost + TRUNCATED_COST * truncated
            role, after = NEXT[state]
            if initial == role[0]:
                offer(after, stays + COST[KEEP], node, KEEP)
            if initial == "s" and state == NOTHING:
                offer(SYSTEM, stays + COST[KEEP], node, KEEP)
            offer(after, stays + COST[REROLE], node, REROLE)
        self._move({state: (cost, Node(node, edit)) for state, (cost, node, edit) in best.items()})
        self._insert()
        self._drop_beaten()
        self._coalesce()

    def finish(self) -> int:
        """Emit what is open and return the cost; a conversation ends after the assistant or holds nothing."""
        ends = [(s, *self.survivors[s]) for s in (NOTHING, ASSISTANT) if s in self.survivors]
        state, cost, node = ends[0]
        for s, c, n in ends[1:]:
            if c < cost or (c == cost and self._before(n, b"", node, b"")):
                state, cost, node = s, c, n
        self._move({state: (cost, node)})
        self._coalesce()
        self.emit(bytes(self.root.edits))
        return cost

    def _insert(self) -> None:
        """Let empty turns follow where that is the cheapest way into a state; two in a row reach every state."""
        for _ in range(2):
            for state in list(self.survivors):
                cost, node = self.survivors[state]
                after, cost = NEXT[state][1], cost + COST[INSERT]
                held = self.survivors.get(after)
                if held is None or cost < held[0] or (cost == held[0] and self._before(node, INSERT, held[1], b"")):
                    self._move(self.survivors | {after: (cost, Node(node, INSERT))})

    def _drop_beaten(self) -> None:
        """Free survivors that cannot win: whatever follows, the one after the assistant ends better.

        It can do what one after system can; against one with nothing yet it may have to delete a system turn.
        """
        if ASSISTANT not in self.survivors:
            return
        cost, node = self.survivors[ASSISTANT]
        kept = dict(self.survivors)
        if SYSTEM in kept and (cost < kept[SYSTEM][0] or (
                cost == kept[SYSTEM][0] and self._before(node, b"", kept[SYSTEM][1], b""))):
            del kept[SYSTEM]
        if NOTHING in kept and cost + COST[DELETE] < kept[NOTHING][0]:
            del kept[NOTHING]
        if len(kept) < len(self.survivors):
            self._move(kept)

    def _move(self, survivors: dict[int, tuple[int, Node]]) -> None:
        old = [node for _, node in self.survivors.values()]
        for _, node in survivors.values():
            node.refs += 1
        self.survivors = survivors
        for node in old:
            node.refs -= 1
            while node.refs == 0 and node.parent is not None:
                node = node.parent
                node.refs -= 1

    def _coalesce(self) -> None:
        """Join chains of nodes; emit the edits all survivors share."""
        for _, node in self.survivors.values():
            while node.parent is not None:
                above = node.parent
                if above.refs == 1 and above.parent is not None:  # the longer text is kept, the new end added
                    above.edits += node.edits
                    node.edits, node.parent = above.edits, above.parent
                else:
                    node = above
        while self.root.refs == 1:
            node = next(iter(self.survivors.values()))[1]
            if node is self.root:
                break
            while node.parent is not self.root:
                node = node.parent
            self.emit(bytes(self.root.edits))
            node.parent, self.root = None, node
        if self.root.edits:
            self.emit(bytes(self.root.edits))
            self.root.edits.clear()

    def held(self) -> int:
        """Edits that are not decided yet, over all survivors."""
        nodes = {}
        for _, node in self.survivors.values():
            while node is not None and id(node) not in nodes:
                nodes[id(node)] = len(node.edits)
                node = node.parent
        return sum(nodes.values())

    @staticmethod
    def _before(left: Node, left_edit: bytes, right: Node, right_edit: bytes) -> bool:
        """Whether the left path with its new edit comes before the right one in ASCII order."""
        above = {}
        node, first = left, left_edit
        while node is not None:  # every node above the left end, with the edits that follow it on the way there
            above[id(node)] = first
            node, first = node.parent, node.edits
        node, first = right, right_edit
        while id(node) not in above:
            node, first = node.parent, node.edits
        return bytes(above[id(node)][:1]) < bytes(first[:1])


class Conversation:
    """Statistics and edits of one conversation whose rows come in order.

    ``write(edit, turn, role, text)`` gets every edit in order; an inserted turn has no turn number.
    """

    def __init__(self, write: Callable[[str, int | None, str, str], None]):
        self.write, self.decoder = write, Decoder(self._decided)
        self.open: deque = deque()  # rows whose edit is not decided
        self.state = NOTHING
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.first = self.last = self.before = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str) -> None:
        self.rows += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL_PAIRS
        self.before = initial
        last = text.rstrip(SPACE)[-1:]
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank, duplicate = not last, key in self.seen
        self.seen.add(key)
        truncated = not blank and not duplicate and last not in ".!?"
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        self.open.append((turn, role, text))
        self.decoder.row(initial, blank or duplicate, truncated)

    def finish(self) -> dict:
        cost = self.decoder.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost}

    def _decided(self, edits: bytes) -> None:
        for edit in edits.decode():
            turn, role, text = (None, "", "") if edit == "I" else self.open.popleft()
            if edit != "D":
                if edit == "K" and self.state == NOTHING and role[:1] == "s":
                    self.state = SYSTEM
                else:
                    new, self.state = NEXT[self.state]
                    role = role if edit == "K" else new
            self.write(edit, turn, role, text)


def in_order(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None) -> DataFrame:
    """(id, turn, role, text, gone) with each conversation in one task, by turn with nulls first, then by role and text.

    A null role or text is one space.  A row whose ``gone_col`` is true only names its conversation.
    """
    gone = F.col(gone_col) if gone_col else F.lit(False)
    picked = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), gone.alias("gone"))
    return picked.repartition("id").sortWithinPartitions(F.col("id"), F.col("turn").asc_nulls_first(), "role", "text")


def _stream(rows: DataFrame, ddl: str, start: Callable, end: Callable) -> DataFrame:
    """Run ordered rows through one :class:`Conversation` after the other."""
    def make():
        out: dict[str, list] = {}
        now: list = []  # id and conversation under way

        def close():
            if now:
                end(out, *now)
                now.clear()

        def step(batch: pa.RecordBatch | None):
            out.clear()
            out.update({name.split(" ")[0]: [] for name in ddl.split(", ")})
            if batch is None:
                close()
                return out
            for key, turn, role, text, gone in zip(*(batch.column(n).to_pylist() for n in ("id", "turn", "role", "text", "gone"))):
                if not now or now[0] != key:
                    close()
                    now.extend((key, *start(out, key)))
                if not gone:
                    now[1].row(turn, role, text)
            return out

        return step

    return map_batches(rows, make, ddl, last=True)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """Every edit of every conversation: (id, place, edit, turn, role, text), ``place`` counting from 0.

    Deleted rows are listed with edit D; the others, in order, are the repaired conversation.  Blank rows and rows whose
    role and text came earlier in the conversation are always deleted.  A null id is a conversation of its own, a null
    role or text is one space, null turns come first, rows of one turn are ordered by role and text; repeated rows are
    duplicates.  Other columns are ignored; an empty table gives an empty result.  A text is held only until its edit
    is decided; of a conversation, 16 bytes a distinct row are held to find duplicates.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def start(out, key):
        place = [0]

        def write(edit, turn, role, text):
            for name, value in zip(("id", "place", "edit", "turn", "role", "text"), (key, place[0], edit, turn, role, text)):
                out[name].append(value)
            place[0] += 1

        return [Conversation(write)]

    return _stream(in_order(rows, id_col, turn_col, role_col, text_col, gone_col),
                   f"id {kind}, place bigint, edit string, turn bigint, role string, text string", start,
                   lambda out, key, talk: talk.finish()).withColumnRenamed("id", id_col)


def summarize(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and initials of its edits, and the digest of the repaired one.

    The digest is taken of ``role:text`` lines while :class:`Conversation` decides them, so no conversation is held
    whole.  Values are treated as in :func:`repair`; a conversation all of whose rows are marked by ``gone_col`` has zeros,
    no edits and the digest of the empty text.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def start(out, key):
        edits, digest, lines = [], hashlib.sha256(), [0]

        def write(edit, turn, role, text):
            edits.append(edit)
            if edit != "D":
                digest.update(("\n" * (lines[0] > 0) + f"{role}:{text}").encode())
                lines[0] += 1

        return [Conversation(write), edits, digest]

    def end(out, key, talk, edits, digest):
        found = talk.finish()
        for name, value in ({"id": key, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()} | found).items():
            out[name].append(value)

    ddl = (f"id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")
    return _stream(in_order(rows, id_col, turn_col, role_col, text_col, gone_col), ddl, start, end).withColumnRenamed("id", id_col)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows with faults put in by a checksum of id and turn: (id, turn, role, text, gone), dropped rows marked ``gone``.

    0 of 20 drops a row, 1 empties its text, 2 removes the marks that end sentences, 3 repeats it, 4 makes its role user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)]
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    marked = rows.select(F.col(id_col), F.col(turn_col), role.alias("_role"), text.alias("_text"), fault.alias("_fault"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (marked.withColumn("_copy", F.explode(copies)).select(
        F.col(id_col), F.col(turn_col), F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("_role")).alias(role_col),
        F.when(F.col("_fault").isin(0, 1), F.lit("")).when(F.col("_fault") == 2, F.translate("_text", ".!?", ""))
        .otherwise(F.col("_text")).alias(text_col), (F.col("_fault") == 0).alias("gone")))
