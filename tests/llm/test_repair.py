"""Structure repair against dynamic programming over whole audits, and SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from penprint.llm import repair
from penprint.llm.queries import ORACLE_SQL
from tests.oracle import compare, duck

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, repaired turns) of (role, text, fault) by the definition."""
    best = {0: (0, "", ())}

    def widen(b):
        out = dict(b)
        for _ in range(4):
            for q, (c, a, t) in list(out.items()):
                for x in "ua":
                    q2 = STEP.get((q, x))
                    if q2 is not None and (c + 2, a + "I") < out.get(q2, (1e9,))[:2]:
                        out[q2] = (c + 2, a + "I", t + ((NAME[x], ""),))
        return out

    for role, text, fault in turns:
        new = {}

        def offer(q, v):
            if v[:2] < new.get(q, (1e9,))[:2]:
                new[q] = v

        for q, (c, a, t) in widen(best).items():
            offer(q, (c + 3, a + "D", t))
            if fault in (0, 3):
                more = fault == 3
                if (q, role[:1]) in STEP:
                    offer(STEP[q, role[:1]], (c + more, a + "K", t + ((role, text),)))
                for y in "ua":
                    if (q, y) in STEP:
                        offer(STEP[q, y], (c + 2 + more, a + "R", t + ((NAME[y], text),)))
        best = new
    return min(v for q, v in widen(best).items() if q in (0, 3))


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        if not ink.strip(" \t\n\x0b\x0c\r"):
            f = 1
        elif (role, text) in seen:
            f = 2
        else:
            f = 3 if ink[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, f))
    return out


def brute_force(rows):
    """op13's result for (conv_id, turn, role, text) rows without equal turns."""
    convs = {}
    for c, turn, role, text in rows:
        own = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else "".join(x for x in text if x not in ".!?") if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        numbers = {t for t, _, _ in own if t is not None}
        marked = faults([(r, t) for _, r, t in own])
        cost, audit, fixed = cheapest(marked)
        count = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count(1), count(2), count(3),
                  illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def row(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_parser_finds_the_cheapest_edits():
    r, p = random.Random(2), repair.Parser()
    for k in range(3000):
        turns = [(r.choice("suaua" + "x" * (k % 3 == 0)), "t", r.choice([0, 0, 0, 0, 1, 2, 3]))
                 for _ in range(r.randint(0, 14))]
        for role, _, fault in turns:
            p.turn(role, fault)
        cost, edits = p.finish()
        assert (cost, edits.translate(str.maketrans("UAua", "RRII"))) == cheapest(turns)[:2]


def test_stack_merges_equal_tops():
    """However long the conversation, few tops live and few links differ."""
    r, p = random.Random(3), repair.Parser()
    for _ in range(5000):
        p.turn(r.choice("sua"), r.choice([0, 3]))
        assert len(p.tops) <= 10
    assert len(p.finish()[1]) >= 5000 and len(p.links) < 256


def test_another_grammar():
    """Conflicts of the tables are followed on all paths: user or assistant turns
    of any number by two derivations, in which nothing needs mending."""
    p = repair.Parser(repair.Automaton({"C": ("", "T", "V"), "T": ("Tu", "Ta", "u", "a"), "V": ("Vu", "u")}, "C"))
    for x in "uuaau":
        p.turn(x, 0)
    assert p.finish() == (0, "KKKKK")
    p.turn("s", 0)
    assert p.finish() == (2, "A")
    with pytest.raises(ValueError):
        endless = repair.Parser(repair.Automaton({"C": ("", "T"), "T": ("TT", "u", "a")}, "C"))
        endless.turn("u", 0)


HOSTILE = (
    [(1, i, "user" if i % 2 else "assistant", f"Turn {i}.") for i in range(9)]
    + [(2, None, "user", "No number."), (2, 4, None, "No role."), (2, 9, "assistant", None), (2, 7, "tool", "Odd!")]
    + [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes.")]
    + [(3, None, "system", "All null.")]
    + [(4, i, "user", "Same.") for i in range(6)]
    + [(5, 0, "system", "Only."), (6, 0, "", "No initial."), (6, 1, "user", "x" * 200_000)]
    + [(7, i, r, t) for i, (r, t) in enumerate([("system", "S"), ("assistant", "é?"), ("user", "\x0b \r"), ("user", "🙂")])]
    + [(-8, -3, "user", "Minus."), (-8, -1, "assistant", "Gap.")]
    + [(100 + c, i, random.Random(c * 31 + i).choice(["system", "user", "assistant"]),
        random.Random(c * 7 + i).choice(["A.", "B!", "C", " ", "D?\n"])) for c in range(60) for i in range(c % 12)])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def build(rows):
        path = str(tmp_path_factory.mktemp("turns"))
        df = spark.createDataFrame(rows, TURNS)
        for c in ("conv", "kind", "h1", "edits", "how", "own", "state"):
            df = df.selectExpr("*", f"'x' AS {c}")
        df.repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
        return path
    return build


def test_hostile_rows(spark, table):
    rows = list(dict.fromkeys(HOSTILE))
    got = {r.conv_id: row(r) for r in repair.op13_conversation_repair(spark, table(rows)).collect()}
    assert got == brute_force(rows)


def test_hostile_rows_against_sql(spark, table):
    import duckdb
    path, con = table(HOSTILE), duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text "
                f"FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    ok, said = compare(spark, path, "op13", repair.op13_conversation_repair, ORACLE_SQL["op13_conversation_repair"], con)
    assert ok, said


def test_all_dropped_and_empty(spark, table):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.op13_conversation_repair(spark, table([(gone, 0, "user", "Hi.")])).collect()
    assert [(r.conv_id, row(r)) for r in got] == [(gone, (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()))]
    assert repair.op13_conversation_repair(spark, table([])).count() == 0


def test_ties_and_repeated_rows(spark, table):
    """Rows with one turn number keep a fixed order; equal rows are duplicates."""
    path = table([(1, 0, "user", "Hello."), (1, 0, "user", "Hello."), (1, 0, "assistant", "Hi."), (1, 0, "user", "Why?")])
    found = repair.find_repairs(repair.digests(spark.read.parquet(f"{path}/conversations.parquet"))).collect()
    assert [(r.duplicate, r.gaps) for r in found] == [(1, 0)]


def test_repaired_turns(spark, table):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Who?"), (1, 2, "user", " "), (2, 0, "user", "Alone.")]
    d = repair.digests(spark.read.parquet(f"{table(rows)}/conversations.parquet"))
    got = repair.apply_repairs(d, repair.find_repairs(d)).collect()
    by = {c: sorted(((r.place is None, r.place or 0), r.role, r.text, r.edit) for r in got if r.conv == c) for c in (1, 2)}
    want = {c: cheapest(faults([(r, t) for i, _, r, t in rows if i == c])) for c in (1, 2)}
    for c in (1, 2):
        assert [(r, t) for (gone, _), r, t, _ in by[c] if not gone] == list(want[c][2])
        assert sorted(e for *_, e in by[c]) == sorted(want[c][1])
