"""Conversations repaired to a legal order of roles by the cheapest edits.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.
Each row is kept, given the next role or deleted, and empty turns are inserted
anywhere; the cheapest edits win, and among these the ASCII-least audit string
(one initial an edit).  The search is a Viterbi pass over four states (nothing
yet, after s, after u, after a).  The survivors of the states are leaves of a
backpointer tree whose unary chains are one node each: a node's reference count
falls as survivors die, a node left with one child joins it, and what the root
holds is shared by all survivors, so it is emitted and forgotten.  Two tied
survivors are compared by all that is unresolved of them: from their lowest
common node on, which is at most a few nodes away however long the parts are.

Rows stream through a task in the order of their turns.  It holds no texts:
each survivor carries the running digest of its own repaired conversation, and
unresolved edits cost a byte each.  So a conversation of any length passes in
bounded memory; other conversations are dealt out by their id.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import ship

#: The costs of the edits, and of leaving a truncated row in.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
#: Edits in a row of the result.
CHUNK = 1 << 16

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a new turn (inserted or given a role) leads to from each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) -> state for kept rows.  A kept s is marked L in the tree, between K and R as K is.
KEPT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}


class Node:
    """A chain of edits shared by the survivors below it; ``kids`` is its reference count."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: Node | None, edits: str = ""):
        self.parent, self.edits, self.kids = parent, bytearray(edits, "ascii"), []


def before(a: Node, x: str, b: Node, y: str) -> bool:
    """Whether the edits up to leaf a and then x are ASCII-less than those up to leaf b and then y."""
    if a is b:
        return x < y
    left, n = {}, a
    below: Node | None = None
    while n is not None:
        left[id(n)] = below
        n, below = n.parent, n
    n, below = b, None
    while id(n) not in left:
        n, below = n.parent, n

    def rest(top: Node | None, leaf: Node, end: str) -> bytes:
        parts, n = [], leaf
        while top is not None and n is not top.parent:
            parts.append(n.edits)
            n = n.parent
        # siblings differ in their first edit, so one byte of each decides; no chain is copied
        return next((bytes(p[:1]) for p in reversed(parts) if p), b"") or end.encode()

    return rest(left[id(n)], a, x) < rest(below, b, y)


class Repair:
    """The search over one conversation: ``row`` for each row in order, then ``end``.

    ``out`` holds the edits that all survivors share and that were not taken
    yet.  Digests are of the ``role:text`` lines of the repaired conversation.
    """

    def __init__(self):
        self.root = Node(None)
        self.out = bytearray()
        empty = hashlib.sha256()
        #: state -> (cost, leaf, digest, whether the digest has a line)
        self.live = {START: (0, self.root, empty, False)}
        self._settle(self._inserted({START: (0, self.root, "", START, None)}), "", "")

    @staticmethod
    def _better(a: tuple, b: tuple | None) -> bool:
        return b is None or a[0] < b[0] or (a[0] == b[0] and before(a[1], a[2], b[1], b[2]))

    def _inserted(self, found: dict) -> dict:
        """Adds the turns that may be inserted next; costs are positive, so two passes reach all states."""
        for _ in range(2):
            for state in list(found):
                cost, leaf, edits, origin, role = found[state]
                new = (cost + INSERT, leaf, edits + "I", origin, role)
                if self._better(new, found.get(NEXT[state])):
                    found[NEXT[state]] = new
        return found

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: dict = {}

        def offer(state: int, *path) -> None:
            if self._better(path, found.get(state)):
                found[state] = path

        extra, initial = TRUNCATED * truncated, role[:1]
        for state, (cost, leaf, *_) in self.live.items():
            offer(state, cost + DELETE, leaf, "D", state, None)
            if not must_go:
                if (to := KEPT.get((state, initial))) is not None:
                    offer(to, cost + KEEP + extra, leaf, "L" if to == SYSTEM else "K", state, role)
                offer(NEXT[state], cost + REROLE + extra, leaf, "R", state, ROLE[NEXT[state]])
        self._settle(self._inserted(found), role, text)

    def _settle(self, found: dict, role: str, text: str) -> None:
        """Makes the winners of the states the survivors, extends their tree and emits what they share."""
        if ASSISTANT in found:  # exact: what follows s may follow a, and a later s costs a deletion at most
            cost = found[ASSISTANT][0]
            if SYSTEM in found and found[SYSTEM][0] > cost:
                del found[SYSTEM]
            if START in found and found[START][0] > cost + DELETE:
                del found[START]
        by_leaf: dict[int, list] = {}
        live, line = {}, ("", b"")
        for state, (cost, leaf, edits, origin, as_role) in found.items():
            _, _, digest, any_line = self.live[origin]
            if as_role is not None or "I" in edits:
                digest = digest.copy()
            at = origin
            for e in edits:
                if e == "D":
                    continue
                if e == "I":
                    at = NEXT[at]
                    data = (ROLE[at] + ":").encode()
                else:
                    at = SYSTEM if e == "L" else NEXT[at]
                    if line[0] != as_role:
                        line = (as_role, f"{as_role}:{text}".encode("utf-8", "surrogatepass"))
                    data = line[1]
                if any_line:
                    digest.update(b"\n")
                digest.update(data)
                any_line = True
            live[state] = (cost, leaf, digest, any_line)
            by_leaf.setdefault(id(leaf), []).append((edits, state))
        old = {id(leaf): leaf for _, leaf, *_ in self.live.values()}
        self.live = live
        for key, leaf in old.items():
            if key in by_leaf:
                self._grow(leaf, by_leaf[key])
        for node in [self._drop(leaf) for key, leaf in old.items() if key not in by_leaf]:
            while node is not None and len(node.kids) == 1:
                self._join(node)
        self._emit()

    def _grow(self, node: Node, ends: list[tuple[str, int]]) -> None:
        """Extends a leaf by the edits of its winners, sharing what they have in common."""
        n = 0
        if len(ends) > 1:
            shortest = min((e for e, _ in ends), key=len)
            while n < len(shortest) and all(e[n] == shortest[n] for e, _ in ends):
                n += 1
        else:
            n = len(ends[0][0])
        node.edits += ends[0][0][:n].encode()
        if len(ends) == 1:
            state = ends[0][1]
            cost, _, digest, any_line = self.live[state]
            self.live[state] = (cost, node, digest, any_line)
            return
        parts: dict[str, list] = {}
        for e, state in ends:
            parts.setdefault(e[n : n + 1], []).append((e[n:], state))
        for some in parts.values():
            kid = Node(node)
            node.kids.append(kid)
            self._grow(kid, some)

    def _drop(self, leaf: Node) -> Node | None:
        """Removes a dead leaf and what only it referred to; the node above, if that has one child left."""
        node, parent = leaf, leaf.parent
        while parent is not None:
            parent.kids.remove(node)
            if parent.kids:
                return parent if len(parent.kids) == 1 else None
            node, parent = parent, parent.parent
        return None

    def _join(self, node: Node) -> None:
        """Makes a node one with its only child."""
        kid = node.kids[0]
        node.edits += kid.edits
        node.kids, kid.kids = kid.kids, []
        for k in node.kids:
            k.parent = node
        for state, (cost, leaf, digest, any_line) in self.live.items():
            if leaf is kid:
                self.live[state] = (cost, node, digest, any_line)

    def _emit(self) -> None:
        if self.root.edits:
            self.out += self.root.edits
            self.root.edits.clear()

    def end(self) -> tuple[int, str]:
        """The least cost and the digest; all edits are in ``out`` then."""
        best = None
        for state in (START, ASSISTANT):
            if state in self.live:
                cost, leaf, digest, _ = self.live[state]
                if self._better((cost, leaf, ""), best):
                    best = (cost, leaf, "", digest)
        chain, n = [], best[1]
        while n is not None:
            chain.append(n.edits)
            n = n.parent
        for edits in reversed(chain):
            self.out += edits
        return best[0], best[3].hexdigest()


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) dealt out by conversation, with the first ``fault`` of each.

    blank: nothing but ASCII white space; duplicate: role and text seen earlier
    in the conversation; truncated: the last other character is not one of
    ``.!?``.  A null role or text counts as one space.  Rows are in the order
    of their turns, nulls first, equal turns by role and text.  ``dropped``
    rows only name their conversation; without such a column no row is dropped.
    """
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), dropped.alias("dropped"))
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    core = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(core == "", "blank").when(F.row_number().over(earlier) > 1, "duplicate")
        .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return rows.repartition("conv_id").withColumn("fault", fault)




def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault").asc_nulls_first()]


class _Stream:
    """One conversation's counts, search and rows of the result."""

    def __init__(self, conv):
        self.conv, self.search, self.chunk = conv, Repair(), 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.role, self.low, self.high, self.turns, self.taken, self.state = None, None, None, 0, 0, START

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        c = self.counts
        if fault:
            c[fault] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            c["illegal"] += 1
        self.role = role
        if turn is not None and turn != self.high:  # turns ascend
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.search.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def take(self, n: int) -> dict:
        """The next n edits: their initials, the roles they give, and the rows (from 0) they are about."""
        edits = bytes(self.search.out[:n]).decode()
        del self.search.out[:n]
        roles, at = [], []
        for e in edits:
            at.append(None if e == "I" else self.taken)
            self.taken += e != "I"
            if e == "D":
                roles.append(None)
                continue
            self.state = SYSTEM if e == "L" else NEXT[self.state]
            roles.append(ROLE[self.state] if e in "IR" else None)
        row = {"conv_id": self.conv, "chunk": self.chunk, "edits": edits.replace("L", "K"), "roles": roles, "at": at, "whole": None}
        self.chunk += 1
        return row

    def end(self):
        cost, sha = self.search.end()
        while len(self.search.out) > CHUNK:
            yield self.take(CHUNK)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield self.take(CHUNK) | {"whole": {"gaps": gaps, **self.counts, "cost": cost, "repaired_sha256": sha}}


_WHOLE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"


def repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text, optional dropped).

    Returns rows (conv_id, chunk, edits, roles, at, whole): the initials of up
    to CHUNK edits (Keep, Rerole, Delete, Insert), for each the role that it
    gives (null if none) and the row it is about (null for inserts), counted
    from 0 in the order of ``faults``.  ``whole`` is set in the last chunk:
    gaps (numbers missing between the least and the greatest turn), counts of
    first faults, illegal (adjacent initials other than su, ua, au), cost and
    the digest of the repaired ``role:text`` lines.

    Blank and duplicate rows must go (4); keeping is free, another role costs
    3, an inserted empty turn 3, a truncated row that stays 3 more.  Null ids
    are one conversation; a conversation of dropped rows only has zeros and no
    edits; an empty table gives an empty result; other columns are ignored.
    """
    ship(rows.sparkSession)
    ready = faults(rows).sortWithinPartitions("conv_id", *_order())
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, chunk int, edits string, roles array<string>, at array<long>, whole struct<{_WHOLE.replace(' ', ':').replace(',:', ',')}>"
    arrow = pa.schema([
        ("chunk", pa.int32()), ("edits", pa.string()), ("roles", pa.list_(pa.string())), ("at", pa.list_(pa.int64())),
        ("whole", pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in _WHOLE.split(", "))])),
    ])

    def run(batches):
        now, held, size = None, [], 0

        def flush(kind):
            nonlocal size
            full = pa.schema([pa.field("conv_id", kind), *arrow])
            yield from pa.Table.from_pylist(held, full).combine_chunks().to_batches()
            held.clear()
            size = 0

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")]
            for conv, turn, role, text, dropped, fault in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        held += now.end()
                    now = _Stream(conv)
                if not dropped:
                    now.add(turn, role, text, fault)
                    size += 1
                    if len(now.search.out) >= CHUNK:
                        held.append(now.take(CHUNK))
                if size >= CHUNK:
                    yield from flush(kind)
        if now is not None:
            held += now.end()
            yield from flush(kind)

    return ready.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: the counts, the cost, the whole audit string and the digest of ``repairs``."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "edits")))
    whole = repaired.groupBy("conv_id").agg(F.max("whole").alias("w"), F.array_join(F.transform(parts, lambda p: p.edits), "").alias("audit"))
    return whole.select("conv_id", "w.gaps", "w.blank", "w.duplicate", "w.truncated", "w.illegal", "w.cost", "audit", "w.repaired_sha256")


def repaired_turns(rows: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: rows (conv_id, position, edit, turn, role, text), deletions left out.

    Inserted turns have a null ``turn`` and an empty text.  Handles what
    ``repairs`` does, whose result may be passed in.
    """
    repaired = repairs(rows) if repaired is None else repaired
    place = Window.partitionBy("conv_id").orderBy(*_order())
    numbered = faults(rows).where("not dropped").withColumn("at", F.row_number().over(place) - 1)
    edits = F.arrays_zip(F.split("edits", "").alias("edit"), F.col("roles").alias("new"), F.col("at"))
    one = repaired.select("conv_id", "chunk", F.posexplode(edits).alias("i", "e")).where("e.edit <> '' and e.edit <> 'D'")
    one = one.select("conv_id", (F.col("chunk").cast("long") * CHUNK + F.col("i")).alias("position"), "e.edit", "e.new", F.col("e.at").alias("at"))
    n = numbered.select(F.col("conv_id").alias("__c"), F.col("at").alias("__a"), "turn", "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("at") == F.col("__a"))
    return one.join(n, same, "left").select(
        "conv_id", "position", "edit", "turn", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows with seeded faults by crc32('conv_id:turn') % 20 (nulls are one space); ``dropped`` marks those taken out.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    one = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", one[0], one[1]).cast("binary")) % 20
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", one[2].alias("role"), one[3].alias("text"), kind.alias("kind"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.array_repeat(F.lit(0), times).alias("times"))
    return out.withColumn("times", F.explode("times")).drop("times")
