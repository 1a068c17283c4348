"""Repair of turns against every possible edit, and conversations of any length over several tasks."""

import hashlib
import re
import zlib
from itertools import product

import duckdb
import pytest

from tapewatch.llm import queries, turn_repair
from tests.llm.cases import LONG, uncoalesced


def every_audit(codes):
    """(cost, audit) of each way to edit up to four rows, with at most two insertions between them."""
    for gaps in product(("", "u", "a", "ua", "au"), repeat=len(codes) + 1):
        for acts in product("DKua", repeat=len(codes)):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 5 * len(gaps[0])
            for (initial, fault), act, gap in zip(codes, acts, gaps[1:]):
                if act == "D":
                    cost, audit = cost + 2, audit + "D"
                elif fault == turn_repair.GONE:
                    break
                else:
                    cost += 5 * (fault == turn_repair.TRUNCATED) + (act != "K")
                    audit, roles = audit + ("K" if act == "K" else "R"), roles + (initial or "?" if act == "K" else act)
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 5 * len(gap)
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    yield cost, audit


def test_walk_is_the_cheapest_and_ascii_least():
    kinds = [("s", 0), ("u", 0), ("a", 2), ("x", 2), ("a", 0), ("u", 1)]
    for codes in [c for n, some in ((1, kinds), (2, kinds), (3, kinds[:3])) for c in product(some, repeat=n)]:
        cost, audit = min(every_audit(codes))
        assert ("".join(turn_repair.walk(codes, turn_repair.END, 0, True)[0]), turn_repair.costs_to_go(codes, turn_repair.END)[0][0]) == (audit, cost), codes


def plain(rows):
    """conv: counts, cost, audit and hash of damaged rows, by one task's walk."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        role, text, name = role if role is not None else " ", text if text is not None else " ", lambda v: " " if v is None else v
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            cut = text.strip(turn_repair.SPACE)
            fault = 0 if not cut else 1 if (role, text) in seen else 2 if cut[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1], 0 if fault is None else 2 if fault == 2 else 1))
        edits, roles, _ = turn_repair.walk(tuple(codes), turn_repair.END, 0, True)
        lines = []
        for (_, role, text), said, new in zip(turns, edits, roles):
            for e, r in zip(said, new):
                if e != "D":
                    lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[r]}:{'' if e == 'I' else text}")
        at = [t for t, *_ in turns if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv] = (gaps, *counts, turn_repair.jumps(tuple(codes)), turn_repair.costs_to_go(tuple(codes), turn_repair.END)[0][0], "".join(edits), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = ("user", "assistant", "user", "system", "", "Assistant", "tool")


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op13_turn_repair(spark, sf).collect()} == plain(rows)


@pytest.fixture(scope="module")
def odd():
    """A hot conversation, nulls, ties, blanks of all kinds, repeats, gaps and long texts."""
    rows = [(5, i, ROLES[i * i % 7], f"text {i % 900}" + ".,"[i % 3 == 0]) for i in range(4000)]
    rows += [(6, None, ROLES[i % 2], "same.") for i in range(700)] + [(None, 3, None, None), (None, None, "user", "x?"), (7, 1, "user", LONG + "!"), (7, 90, "assistant", "ok.\n\x0b ")]
    rows += [(100 + i, t, ROLES[(i + t) % 4], ("", " ", "Why?", "well", " \r\n")[(i * t) % 5]) for i in range(60) for t in range(1, 2 + i % 6)]
    return rows + [(8, 1, "user", "a."), (8, 1, "assistant", "b."), (8, 1, "user", "a.")]


def test_any_length_over_several_tasks(spark, odd):
    frame = spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    with uncoalesced(spark):
        marked = turn_repair.marked(turn_repair.damage(frame), "conv_id", "turn", "role", "text")
        assert marked.filter("key = 'v5'").select("part").distinct().count() > 1
        assert {r.conv_id: tuple(r[n] for n in NAMES) for r in turn_repair.damaged_and_repaired(frame).collect()} == plain(odd)


def test_sql_on_odd_rows(spark, odd, tmp_path):
    few = [r for r in odd if r[0] != 5] + [r for r in odd if r[0] == 5][:60]
    spark.createDataFrame(few, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"select conv_id, {', '.join(NAMES)} from ({queries.OP13_SQL})").fetchall()
    assert {c: tuple(v) for c, *v in want} == plain(few)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi.", "extra"), (1, 1, "assistant", "You?", "extra"), (2, 0, "system", "Be kind.", "extra")]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, edit string")
    turns, found = turn_repair.repair(frame)
    assert [(r.conv, r.edit, r.role, r.text) for r in turns.orderBy("at", "nth").collect()] == [(1, "R", "user", "Hi."), (1, "K", "assistant", "You?")]
    assert {r.conv: (r.cost, r.audit, r.illegal) for r in found.collect()} == {1: (1, "RK", 1), 2: (2, "D", 0)}
    turns, found = turn_repair.repair(frame.limit(0))
    assert turns.count() == 0 == found.count() and turn_repair.damaged_and_repaired(frame.limit(0)).count() == 0
