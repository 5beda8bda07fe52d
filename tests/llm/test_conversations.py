"""The conversation operators: the trie against a plain one and SQL, the merge by itself, the repair against a search of all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import struct
import zlib

import duckdb
import pytest

from signalwright.llm import convrepair, convtrie, queries

SF = "/root/testdata/sf0.001"
#: Other columns, some with the names that the operators use inside.
SCHEMA = "conv_id long, turn long, role string, text string, c string, own string, seq string, head string, fault string, there string, key string, w string"


def with_extras(rows):
    return [(*r, *["x"] * 8) for r in rows]


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, ties of turns, repeated rows, copies of whole conversations, a family without its first member, long texts and a
    conversation of many turns."""
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(30), 205, 207, 301]), draw.choice([None, *range(7)]), draw.choice([None, "user", "assistant", "system", "", "x"]), draw.choice([None, "", " ", "hi.", "hi", "é?\n", "b! "])) for _ in range(300)]
    rows += rows[:20]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}.") for c in range(400, 440) for t in range(4)]
    rows += [(450, t, ("user", "assistant", "system")[t % 3], f"t{t % 50}") for t in range(300)]
    return [*rows, (460, 0, "user", "long " * 40_000), (-7, 0, "user", "negative."), (-7, 2, "assistant", "gap.")]


def rebuilt(rows):
    own: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + x[h:]
    return out


def plain_trie(rows):
    members: dict = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1]) if path else 0)
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p)))).encode()).hexdigest() for p, own in members.items()}
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), len(kids.get(p, [])), leaves[p], saved[p], ends[p]) for p, own in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_trie(df, **options):
    return sorted(tuple(-1 if x is None else x for x in r) for r in convtrie.trie(convtrie.sequences(df), **options).select(*TRIE).collect())


@pytest.mark.parametrize("options", [{}, {"parts": 1, "run_bytes": 3000, "block_bytes": 300}, {"parts": 9, "run_bytes": 1000, "block_bytes": 100}, {"parts": 60}])
def test_trie(spark, odd_rows, options):
    df = spark.createDataFrame(with_extras(odd_rows), SCHEMA).repartition(5)
    assert got_trie(df, **options) == plain_trie(odd_rows)


def test_trie_chunks_of_ends(spark, monkeypatch):
    """Copies of one conversation over many ranges: their ids are hashed in order, chunk after chunk."""
    rows = [(c, 0, "user", "same") for c in range(3000, 3700)] + [(c, 1, "assistant", "same") for c in range(3100, 3600)]
    monkeypatch.setattr(convtrie, "CHUNK", 16)
    assert got_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), parts=12, run_bytes=2000, block_bytes=200) == plain_trie(rows)


def test_trie_empty_table(spark):
    assert convtrie.trie(convtrie.sequences(spark.createDataFrame([], SCHEMA))).collect() == []
    only_null = spark.createDataFrame(with_extras([(None, 0, "user", "a")]), SCHEMA)
    assert convtrie.trie(convtrie.sequences(only_null)).collect() == []


def test_merge_of_many_runs():
    """Every order of rows comes out sorted, with the turns that neighbours share; shared turns are compared once, not at each match."""
    draw = random.Random(1)
    digest = [hashlib.md5(bytes([i])).digest() for i in range(3)]
    rows = [(b"".join(draw.choice(digest) for _ in range(draw.randint(0, 12))), draw.randint(0, 50)) for _ in range(900)]
    rows = [(seq, c, struct.pack(f"<{len(seq) // 16}i", *range(len(seq) // 16))) for seq, c in rows]
    for n in (1, 2, 5, 37):
        blocks = sorted(((first, c, *rest) for i in range(n) for first, c, _, _, *rest in convtrie.sorted_blocks(rows[i::n], 400)), key=lambda b: b[:2])
        out = list(convtrie.merged(blocks))
        assert [(seq, c, size) for c, seq, size, _ in out] == sorted(rows)
        assert [lcp for *_, lcp in out] == [0, *(convtrie.shared(a[1], b[1]) for a, b in zip(out, out[1:], strict=False))]


def test_loser_tree_does_not_compare_shared_turns_again():
    long = b"".join(hashlib.md5(bytes([i])).digest() for i in range(200))
    runs = [[(long + hashlib.md5(bytes([i, j])).digest(), j, b"\0" * 804) for j in range(50)] for i in range(8)]
    cursors = []
    for run in runs:
        (first, _, _, _, *rest), = convtrie.sorted_blocks(run, 1 << 30)
        cursors.append(convtrie.Cursor(first, *rest))
    tree = convtrie.LoserTree(cursors, b"")
    first = tree.compared
    while tree.replace():
        pass
    assert first >= 7 * 200
    assert tree.compared - first < 8 * 50 * 4  # a step or so for each match, not 200


def search(rows):
    """The cheapest, ASCII-least edits by a search over (place, state)."""
    heap, done = [(0, "", 0, 0, ())], set()
    state, name = {"s": 1, "u": 2, "a": 3}, {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, at, out = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(rows) and at in (0, 3):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        due = "a" if at == 2 else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, state[due], (*out, f"{name[due]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, at, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == due or at == 0 and role[:1] == "s":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, state[role[:1]], (*out, f"{role}:{text}")))
                if role[:1] != due:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, state[due], (*out, f"{name[due]}:{text}")))


@pytest.mark.parametrize("settle", [1, 3, 64])
def test_viterbi(monkeypatch, settle):
    monkeypatch.setattr(convrepair, "SETTLE", settle)
    draw = random.Random(settle)
    for _ in range(3000):
        rows = [(draw.choice(["user", "assistant", "system", "x", ""]), draw.choice(["a.", "b", "c?"]), draw.choice([None, None, None, "blank", "truncated", "duplicate"])) for _ in range(draw.randint(0, 12))]
        own = convrepair.Viterbi()
        for r in rows:
            own.feed(*r)
        assert own.result() == search(rows), rows


def test_viterbi_holds_little():
    """Of a very long conversation the states hold what they don't share."""
    own = convrepair.Viterbi()
    draw = random.Random(2)
    for _ in range(20_000):
        own.feed(draw.choice(["user", "assistant"]), "x.", None)
    assert max(len(p.audit) for p in own.layer if p) < 2000


def same_as_sql(spark, rows, sql, make, tmp_path):
    spark.createDataFrame(with_extras(rows), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    got = make(spark.read.parquet(f"{tmp_path}/c"))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.fetchall()))


def test_repair_of_odd_rows(spark, odd_rows, tmp_path):
    same_as_sql(spark, odd_rows, convrepair.SQL, lambda df: convrepair.repair(convrepair.damaged(df)), tmp_path)


def test_trie_of_odd_rows_by_sql(spark, odd_rows, tmp_path):
    same_as_sql(spark, [r for r in odd_rows if r[0] != 450], convtrie.SQL, lambda df: convtrie.trie(convtrie.sequences(df)), tmp_path)


def test_repair_without_rows(spark):
    assert convrepair.repair(convrepair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = convrepair.repair(convrepair.damaged(spark.createDataFrame(with_extras([(gone, 0, "user", "a.")]), SCHEMA))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", convtrie.EMPTY)


def test_registered_columns(spark):
    types = dict(queries.QUERIES["op11_conversation_trie"](spark, SF).dtypes)
    assert types == dict.fromkeys(TRIE[:-1], "bigint") | {"ends_sha256": "string"}
    assert ", ".join(f"{n} {t}" for n, t in queries.QUERIES["op12_structure_repair"](spark, SF).dtypes).replace("bigint", "long") == convrepair.RESULT
