"""Conversation structure repair by generalised LR parsing with edits.

A conversation is a string of role initials that a grammar has to derive
(``GRAMMAR``: an optional system turn, then user/assistant pairs; or nothing).
``Parser`` reads the turns from the left over a *graph-structured stack*: nodes
are interned (state, node below) pairs, so equal stacks are one node and share
what lies below.  At each turn every live top may keep the turn (if its initial
can be shifted), give it another role, or delete it, and may insert turns before
it; reductions are followed until the next shift.  Tops that become equal are
merged to the one with the smallest (cost, audit): the audit is the string of
edits made, D, I, K or R, compared as ASCII.

Two audits of the same number of turns, each ending with a turn's own edit, are
never proper prefixes of each other, so their order cannot change later; it is
kept as a rank and no audit is ever compared or copied as a whole.  A turn costs
a constant number of steps, one byte is kept for each live top and turn, and the
cheapest edits are read off backwards at the end.

On Spark: the parse gets digests of the turns (role initial, faults, a 128-bit
content hash that finds repeated turns), hashed by conversation and sorted; the
texts are streamed past the finished edits in a second pass and never held
together.  Both passes read one conversation in one task, because the edits of a
turn depend on all others: a task's time grows with its longest conversation,
its memory by about 120 bytes a turn of it.

Faults: blank (only ASCII white space), duplicate (role and text seen earlier in
the conversation), truncated (the last other character is not one of .!?); the
first that holds counts.  Edge cases: a null conversation id, role or text is
one space wherever its value matters, so null ids form one conversation with a
null id and null texts are blank; null turns come first; turns with equal
numbers are ordered by role and then by content hash; a role whose initial the
grammar lacks, or an empty one, can be given another role or deleted but not
kept; a conversation without turns costs nothing; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from penprint.llm.frames import saved

#: left side -> right sides; a symbol that is no left side is a role initial.
GRAMMAR = {"C": ("", "P", "sP"), "P": ("Pp", "p"), "p": ("ua",)}
START = "C"
#: Roles that may be inserted or given, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Different stacks of a grammar (``GRAMMAR`` has 17).
MOST_STACKS = 1000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

BLANK = "[^\\x20\\x09-\\x0D]"  # what a text that is not blank holds
CUT = "[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*\\z"  # a last character other than .!?
FAULTS = ("", "blank", "duplicate", "truncated")


class Automaton:
    """LR(0) states of a grammar and the stacks met so far, as interned nodes.
    Conflicts are allowed: all reductions are followed.  The grammar must have
    finitely many stacks, as left-recursive regular grammars do."""

    def __init__(self, grammar: dict = GRAMMAR, start: str = START, roles: dict = ROLES):
        self.grammar, self.roles = grammar, roles
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        first = self._state(frozenset([("", start, 0)]))
        self.nodes: list[tuple[int, int]] = []  # node -> (state, node below)
        self.known: dict[tuple[int, int], int] = {}
        self.root = self._node(first, -1)
        self._reduced: dict[int, tuple[int, ...]] = {}
        self._shift: dict[tuple[int, str], tuple[int, ...]] = {}
        self._inserts: dict[int, list] = {}

    def _state(self, kernel: frozenset) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            _, right, dot = todo.pop()
            if dot < len(right):
                for r in self.grammar.get(right[dot], ()):
                    item = (right[dot], r, 0)
                    if item not in items:
                        items.add(item), todo.append(item)
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
        return self.states[key]

    def _goto(self, state: int, symbol: str) -> int | None:
        kernel = frozenset((a, r, d + 1) for a, r, d in self.items[state] if d < len(r) and r[d] == symbol)
        return self._state(kernel) if kernel else None

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.known:
            if len(self.nodes) == MOST_STACKS:
                raise ValueError("stacks of this grammar grow without bound: write it left-recursively")
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _reductions(self, node: int) -> list[int]:
        """What single reductions make of a stack."""
        out = []
        for left, right, dot in self.items[self.nodes[node][0]]:
            if left and dot == len(right):
                base = node
                for _ in right:
                    base = self.nodes[base][1]
                state = self._goto(self.nodes[base][0], left)
                if state is not None:
                    out.append(self._node(state, base))
        return out

    def reduced(self, node: int) -> tuple[int, ...]:
        """The stack and all that reductions make of it."""
        if node not in self._reduced:
            found, todo = {node}, [node]
            while todo:
                for new in self._reductions(todo.pop()):
                    if new not in found:
                        found.add(new), todo.append(new)
            self._reduced[node] = tuple(sorted(found))
        return self._reduced[node]

    def _settled(self, node: int) -> int:
        """Reduced as far as there is no choice, so that equal stacks meet."""
        while True:
            items = self.items[self.nodes[node][0]]
            if len(items) != 1 or any(d < len(r) or not a for a, r, d in items):
                return node
            node, = self._reductions(node)

    def shift(self, node: int, initial: str) -> tuple[int, ...]:
        key = (node, initial)
        if key not in self._shift:
            out = set()
            for top in self.reduced(node) if initial and initial not in self.grammar else ():
                state = self._goto(self.nodes[top][0], initial)
                if state is not None:
                    out.add(self._settled(self._node(state, top)))
            self._shift[key] = tuple(sorted(out))
        return self._shift[key]

    def accepts(self, node: int) -> bool:
        return any(not left and dot == len(right) for top in self.reduced(node)
                   for left, right, dot in self.items[self.nodes[top][0]])

    def inserts(self, node: int) -> list[tuple[int, str]]:
        """(node, initials inserted) of all stacks that insertions lead to, each
        by the fewest; the stack itself first."""
        if node not in self._inserts:
            found, layer = {node: ""}, [node]
            while layer:
                following = []
                for top in layer:
                    for initial in sorted(self.roles):
                        for new in self.shift(top, initial):
                            if new not in found:
                                found[new] = found[top] + initial
                                following.append(new)
                layer = following
            self._inserts[node] = list(found.items())
        return self._inserts[node]


class Parser:
    """Cheapest edits of one conversation after the other."""

    def __init__(self, automaton: Automaton | None = None):
        self.lr = automaton or Automaton()
        self.links: list[tuple[int, str]] = []  # number -> (top before, edits)
        self.number: dict[tuple[int, str], int] = {}
        self.start()

    def start(self) -> None:
        self.tops = {self.lr.root: (0, 0)}  # node -> (cost, rank of its audit)
        self.trail: list[tuple] = []  # a turn's tops and links

    def _widened(self) -> dict:
        """node -> (cost, rank, top before, initials inserted)."""
        out = {}
        for top, (cost, rank) in self.tops.items():
            for node, put in self.lr.inserts(top):
                new = (cost + INSERT * len(put), rank, top, put)
                if node not in out or new[:2] < out[node][:2]:
                    out[node] = new
        return out

    def turn(self, initial: str, fault: int) -> None:
        lr, best = self.lr, {}

        def offer(node, cost, rank, top, put, edit):
            audit = "I" * len(put) + ("R" if edit in lr.roles else edit)
            new = (cost, rank, audit, put + edit, top)
            if node not in best or new < best[node]:
                best[node] = new

        more = TRUNCATED if fault == 3 else 0
        for node, (cost, rank, top, put) in self._widened().items():
            offer(node, cost + DELETE, rank, top, put, "D")
            if fault in (0, 3):
                for new in lr.shift(node, initial):
                    offer(new, cost + more, rank, top, put, "K")
                for other in lr.roles:
                    for new in lr.shift(node, other):
                        offer(new, cost + REROLE + more, rank, top, put, other)
        audits = {key: i for i, key in enumerate(sorted({v[1:3] for v in best.values()}))}
        self.tops = {node: (v[0], audits[v[1:3]]) for node, v in best.items()}
        self.trail.append((tuple(best), bytes(self._link(v[4], v[3]) for v in best.values())))

    def _link(self, top: int, edits: str) -> int:
        key = (top, edits)
        if key not in self.number:
            self.number[key] = len(self.links)
            self.links.append(key)
        return self.number[key]

    def finish(self) -> tuple[int, str]:
        """(cost, edits): K keeps and D deletes a turn, U and A give it the role
        of that initial, u and a insert one."""
        ends = [v for node, v in self._widened().items() if self.lr.accepts(node)]
        cost, _, top, put = min(ends)
        edits = [put]
        for tops, links in reversed(self.trail):
            top, made = self.links[links[tops.index(top)]]
            edits.append(made if made[-1] in "KD" else made[:-1] + made[-1].upper())
        self.start()
        return cost, "".join(reversed(edits))


def audit_of(edits):
    """Column: the edits' initials (keep, delete, rerole, insert)."""
    return F.translate(edits, "UAua", "RRII")


def digests(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv, turn, role, text, state, h1, h2): nulls of role and text are one
    space; ``state`` is 1 for blank, 3 for truncated texts."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        role_.alias("role"), text_.alias("text"))
    return rows.select("*", F.when(~F.col("text").rlike(BLANK), 1).when(F.col("text").rlike(CUT), 3).otherwise(0)
                       .cast("int").alias("state"),
                       F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"))


FOUND = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, edits string")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "h1", "h2")


def _adjacent(grammar: dict = GRAMMAR, roles: str = "sua") -> frozenset:
    """Pairs of initials that stand together in some conversation of the grammar."""
    lr, out = Automaton(grammar), set()
    seen, todo = {(lr.root, "")}, [(lr.root, "")]
    while todo:
        node, last = todo.pop()
        for initial in roles:
            for new in lr.shift(node, initial):
                out.add(last + initial)
                if (new, initial) not in seen:
                    seen.add((new, initial)), todo.append((new, initial))
    return frozenset(p for p in out if len(p) == 2)


def find_repairs(rows: DataFrame) -> DataFrame:
    """(conv, *FOUND) of every conversation in ``digests``' rows: its faults and
    the cheapest edits."""
    light = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "state", "h1", "h2")
    conv_type = rows.schema["conv"].dataType.simpleString()
    pairs = _adjacent()

    def run(batches):
        parser, conv, fresh = Parser(), None, True
        kind = None

        def close():
            cost, edits = parser.finish()
            gaps = int(high - low + 1 - distinct) if distinct else 0
            return (conv, gaps, counts[1], counts[2], counts[3], illegal, cost, edits)

        def table(done):
            cols = list(zip(*done))
            kinds = [kind] + [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              ["conv"] + [c.split()[0] for c in FOUND.split(", ")])

        for b in batches:
            kind, done = b.column(0).type, []
            # conv, turn, role, state, h1, h2
            for c, t, role, state, h1, h2 in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if fresh or c != conv:
                    if not fresh:
                        done.append(close())
                    fresh, conv, seen, counts, illegal, last = False, c, set(), [0] * 4, 0, None
                    low = high = None
                    distinct = 0
                if t is not None and t != high:
                    low = t if low is None else low
                    high, distinct = t, distinct + 1
                content = (h1, h2)
                if state != 1:
                    if content in seen:
                        state = 2
                    else:
                        seen.add(content)
                initial = role[:1]
                if last is not None and last + initial not in pairs:
                    illegal += 1
                last = initial
                counts[state] += 1
                parser.turn(initial, state)
            if done:
                yield table(done)
        if not fresh:
            yield table([close()])

    return _dealt(light).mapInArrow(run, f"conv {conv_type}, {FOUND}")


def apply_repairs(rows: DataFrame, found: DataFrame, roles: dict = ROLES) -> DataFrame:
    """The repaired turns (conv, place, role, text, edit), and the deleted ones
    with their old role and text under edit D and place null.  A conversation's
    turns follow each other in one partition, in order."""
    schema = rows.schema["conv"].dataType.simpleString()
    null = lambda kind: F.lit(None).cast(kind)
    both = (rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text")
            .unionByName(found.select("conv", F.lit(0).alias("kind"), null("long").alias("turn"),
                                      null("string").alias("role"), null("long").alias("h1"),
                                      null("long").alias("h2"), F.col("edits").alias("text"))))

    def run(batches):
        conv, edits, at, place, tail = None, "", 0, 0, 0

        def inserted(out):
            nonlocal at, place
            while at < len(edits) and edits[at] in roles:
                out.append((conv, place, roles[edits[at]], "", "I"))
                at, place = at + 1, place + 1

        for b in batches:
            out = []
            for c, kind, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 6))):
                if kind == 0:
                    conv, edits, at, place = c, text, 0, 0
                    tail = len(edits.rstrip("".join(roles)))  # insertions behind the last turn
                    continue
                inserted(out)
                edit, at = edits[at], at + 1
                if edit == "D":
                    out.append((conv, None, role, text, "D"))
                else:
                    kept = edit == "K"
                    out.append((conv, place, role if kept else roles[edit.lower()], text, "K" if kept else "R"))
                    place += 1
                if at >= tail:
                    inserted(out)
            if out:
                cols = list(zip(*out))
                kinds = [b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)],
                                                 ["conv", "place", "role", "text", "edit"])

    return _dealt(both).mapInArrow(run, f"conv {schema}, place long, role string, text string, edit string")


def text_hashes(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of ``role:text`` joined by line feeds, hashed as
    ``apply_repairs`` streams them; conversations without a turn left have no row."""
    kind = repaired.schema["conv"].dataType.simpleString()

    def run(batches):
        conv, held = None, None

        def table(done, b):
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], b.column(0).type),
                                               pa.array([h for _, h in done], pa.string())], ["conv", "repaired_sha256"])

        b = None
        for b in batches:
            done = []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held is not None and c == conv:
                    held.update(b"\n")
                else:
                    if held is not None:
                        done.append((conv, held.hexdigest()))
                    conv, held = c, hashlib.sha256()
                held.update(f"{role}:{text}".encode())
            if done:
                yield table(done, b)
        if held is not None:
            yield table([(conv, held.hexdigest())], b)

    return (repaired.where("edit != 'D'").select("conv", "role", "text")
            .mapInArrow(run, f"conv {kind}, repaired_sha256 string"))


def damaged(turns: DataFrame) -> DataFrame:
    """op13's damage to ``conversations``, by crc32(`conv_id:turn`) modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return (turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how"))
            .where("how != 0")
            .select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                    .alias("again")).drop("again"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = digests(damaged(turns))
    found = saved(find_repairs(rows))
    hashed = text_hashes(apply_repairs(rows, found))
    every = turns.groupBy(F.col("conv_id").alias("own")).agg(F.lit(1).alias("one"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    whole = (every.join(found, F.col("own").eqNullSafe(F.col("conv")), "left").drop("conv")
             .join(hashed, F.col("own").eqNullSafe(F.col("conv")), "left"))
    return whole.select(
        F.col("own").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(audit_of(F.col("edits")), F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


# The same by definition: an automaton's four states instead of a stack, dynamic
# programming over (cost, audit, text) instead of links read backwards.
OP13_SQL = r"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda ch: unicode(ch)::BIGINT)),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS how FROM r),
d AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS again FROM c WHERE how <> 0)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS px,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
              WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after ua
step(q, x, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, c, e, t) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)),
  (2, 3, 2, 'I', 'assistant:' || chr(10)),
  (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
dp(conv_id, pos, q, m) AS (
  SELECT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'a': '', 't': ''} FROM stats
  UNION ALL
  SELECT conv_id, pos, q, min(m) FROM (
    SELECT dp.conv_id, dp.pos + 1 AS pos, v.q2 AS q,
           {'c': dp.m.c + ins.c + v.c, 'a': dp.m.a || ins.e || v.e, 't': dp.m.t || ins.t || v.t} AS m
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1
    JOIN ins ON ins.q = dp.q
    JOIN LATERAL (
      SELECT ins.q2 AS q2, 3 AS c, 'D' AS e, '' AS t
      UNION ALL
      SELECT s.q2, CASE WHEN f.fault = 3 THEN 1 ELSE 0 END, 'K', f.role || ':' || f.text || chr(10)
      FROM step s WHERE s.q = ins.q2 AND s.x = f.x AND f.fault IN (0, 3)
      UNION ALL
      SELECT s.q2, 2 + CASE WHEN f.fault = 3 THEN 1 ELSE 0 END, 'R',
             CASE s.x WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10)
      FROM step s WHERE s.q = ins.q2 AND s.x IN ('u', 'a') AND f.fault IN (0, 3)) v ON true)
  GROUP BY conv_id, pos, q),
ends AS (
  SELECT dp.conv_id, min({'c': dp.m.c + ins.c, 'a': dp.m.a || ins.e, 't': dp.m.t || ins.t}) AS m
  FROM dp JOIN stats ON stats.conv_id IS NOT DISTINCT FROM dp.conv_id AND stats.n = dp.pos
  JOIN ins ON ins.q = dp.q AND ins.q2 IN (0, 3) GROUP BY dp.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(ends.m.c, 0)::BIGINT AS cost,
       coalesce(ends.m.a, '') AS audit,
       sha256(coalesce(CASE WHEN ends.m.t = '' THEN '' ELSE left(ends.m.t, length(ends.m.t) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id
"""
