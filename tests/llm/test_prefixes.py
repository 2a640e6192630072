"""The trie against its definition, for every way of cutting the work."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from penprint.llm import prefixes
from penprint.llm.queries import ORACLE_SQL
from tests.oracle import compare

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def sequences(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                       "saved_tokens", df.columns[-1]).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed=4):
    r, rows = random.Random(seed), []
    for c in range(150):
        path = [r.choice("ab") if r.random() < 0.9 else r.choice("cdefg") for _ in range(r.choice([0, 1, 3, 6, 9, 12]))]
        if c % 3 == 0:
            path = list("aabba") + path  # a third share their first turns
        rows += [(c, i, r.choice(["user", None]) if i == 0 else "user", x * (i + 1)) for i, x in enumerate(path)]
    rows += [(200 + k, i, "user", "long") for k in range(3) for i in range(40 + k)]  # deep, and copies
    rows += [(300 + k, i, "user", "copy é") for k in range(60) for i in range(2)]
    rows += [(None, 0, "user", "x"), (401, None, "user", None), (402, None, None, ""), (403, 5, "a", "\n"),
             (-7, 0, "user", "minus"), (-5, 0, "user", "base"), (-5, 1, "user", "next")]
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def build(rows):
        path = str(tmp_path_factory.mktemp("turns"))
        df = spark.createDataFrame(rows, TURNS)
        for c in ("conv", "turns", "k1", "depth", "n", "ends", "anchor", "a", "h"):
            df = df.selectExpr("*", f"'x' AS {c}")
        df.repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
        return path
    return build


@pytest.mark.parametrize("group_turns,chunk,piece", [(1024, 1 << 16, 1 << 16), (40, 64, 7), (1, 1, 1)])
def test_trie_against_definition(spark, table, monkeypatch, group_turns, chunk, piece):
    """Peeled in tasks, level by level, and both: the same nodes."""
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    monkeypatch.setattr(prefixes, "PIECE", piece)
    rows = [r for r in made() if not 200 <= (r[0] or 0) < 300] if group_turns == 1 else made()
    turns = spark.read.parquet(f"{table(rows)}/conversations.parquet")
    got = prefixes.prefix_trie(prefixes.conversations(turns), group_turns)
    assert rows_of(got) == brute_force(sequences(rows, rebuild=False))


def test_query(spark, table):
    rows = made(8)
    path = table(rows)
    assert rows_of(prefixes.op12_prefix_trie(spark, path)) == brute_force(sequences(rows))


def test_query_against_sql(spark, table):
    path, con = table(made(9)), duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text "
                f"FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    ok, said = compare(spark, path, "op12", prefixes.op12_prefix_trie, ORACLE_SQL["op12_prefix_trie"], con)
    assert ok, said


def test_repeated_rows_ties_and_empty_table(spark, table):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    turns = spark.read.parquet(f"{table(rows)}/conversations.parquet")
    got = prefixes.prefix_trie(prefixes.conversations(turns))
    assert rows_of(got) == brute_force({1: [("user", "a")] * 2, 2: [("user", "a")]})
    assert prefixes.op12_prefix_trie(spark, table([])).count() == 0
    assert prefixes.op12_prefix_trie(spark, table([(None, 0, "user", "x")])).count() == 0
