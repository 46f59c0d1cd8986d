import hashlib
import heapq
import random
import re
import zlib

import pytest

from llm_fixtures import given  # noqa: F401
from turnlake.llm import conversation_repair
from turnlake.llm.conversation_repair import damaged, finished, repaired, transfers
from turnlake.llm.grammar import Rope, joined, paired, precedes

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by search over (row, role letters so far as a place), rows: (role, text, fault)."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, place, out = heapq.heappop(heap)
        if (at, place) in done:
            continue
        done.add((at, place))
        if at == len(rows) and place in ("", "a"):
            return cost, audit, list(out)
        for role in ("user", "assistant"):
            if (place, role[0]) in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", at, follow[place, role[0]], (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, place, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (place, role[:1]) in follow:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, follow[place, role[:1]], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (place, new[0]) in follow:
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", at + 1, follow[place, new[0]], (*out, (new, text))))


def by_definition(table):
    space = " \t\n\x0b\f\r"
    left = {}
    for conv, turn, role, text in table:
        rows = left.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in left.items():
        order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        seen, faults = set(), []
        rows = sorted(rows, key=order)
        for _, role, text in rows:
            body = text.rstrip(space)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[0] for r in rows if r[0] is not None}
        illegal = sum((a[1][:1] + "|" + b[1][:1]) not in ("s|u", "u|a", "a|u") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        assert SHAPE.fullmatch("".join(r[0] for r, _ in kept))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def results(spark, table):
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as n", "'x' as same", "true as dropped", "0 as cost")
    return sorted((tuple(r) for r in repaired(damaged(df)).collect()), key=str)


def drawn(seed, conversations, rows):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Well!  ", "…", "And.\u0085", "é.", None, "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "User", "agent"]
    out = []
    for c in range(conversations):
        for t in range(draw.randrange(1, rows)):
            role = ("user", "assistant")[t % 2] if draw.random() < 0.6 else draw.choice(roles)
            text = f"{draw.choice('abcdefgh')}{t}." if draw.random() < 0.7 else draw.choice(texts)
            out.append((c if c else None, draw.choice([t, t, t, 3 * t, -t, None]) if c % 3 == 0 else t, role, text))
    return out


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_against_search(spark, ranges, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        table = drawn(int(ranges), 60, 9) + [(1000, t, "user", "Hello.") for t in range(40)] + [(1001, 5, "assistant", "Same.")] * 30
        assert results(spark, table) == by_definition(table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_given_conversations(spark, given):
    df = spark.read.parquet(f"{given}/conversations.parquet")
    got = sorted((tuple(r) for r in repaired(damaged(df)).collect()), key=str)
    assert got == by_definition([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_one_long_conversation_over_many_ranges(spark):
    """Nearly all rows are one conversation, with very long texts among them."""
    draw = random.Random(9)
    table = [(7, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"a{t}.", f"b{t}", "again.", "x" * 50_000 + "!"])) for t in range(3000)]
    table += [(c, 0, "user", "Hi.") for c in range(20) if c != 7]
    assert results(spark, table) == by_definition(table)


def test_nothing(spark):
    assert results(spark, []) == []
    # All rows dropped by the damage: zeros and the digest of nothing.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert results(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_ids_of_other_kinds(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), (None, 1, "user", "Hi.")], SCHEMA.replace("conv_id long", "conv_id string"))
    assert {r.conv_id for r in repaired(damaged(df)).collect()} == {"a", None}


def test_pairing_gives_the_sequences_back():
    draw = random.Random(2)
    for alphabet in (1, 2, 9):
        sequences = [bytes(draw.randrange(alphabet) for _ in range(draw.randrange(0, 60))) for _ in range(50)]
        rules, compressed = paired(sequences, 9)

        def spelt(symbol):
            return bytes([symbol]) if symbol < 9 else spelt(rules[symbol - 9][0]) + spelt(rules[symbol - 9][1])

        assert [b"".join(map(spelt, c)) for c in compressed] == sequences
        left = [tuple(p) for c in compressed for p in zip(c[::1], c[1:])]
        if alphabet > 1:
            counts = {p: left.count(p) for p in left if p[0] != p[1]}
            assert all(v == 1 for v in counts.values())
        assert sum(map(len, compressed)) < sum(map(len, sequences))


def test_rules_are_shared():
    """Ten thousand rows of one pattern need a handful of products."""
    [matrix] = transfers([bytes([2, 4] * 5000)])
    assert finished(matrix) == (0, "K" * 10_000)


def test_ropes_compare_as_their_text():
    draw = random.Random(6)
    ropes = [("", "")]
    for _ in range(400):
        (a, x), (b, y) = draw.choice(ropes), draw.choice(ropes)
        if len(x) + len(y) < 3000:
            ropes.append((joined(a, b), x + y))
        text = "".join(draw.choice("DIKR") for _ in range(draw.randrange(1, 40)))[:30]
        ropes.append((text, text))
    assert any(isinstance(a, Rope) for a, _ in ropes)
    for _ in range(4000):
        (a, x), (b, y) = draw.choice(ropes), draw.choice(ropes)
        assert precedes(a, b) == (x < y) and str(a) == x
