"""Operator 13: repair of the turn structure of conversations by dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import keep

SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; where a kept initial leads, and the role that may come from outside.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FINE, GONE, TRUNCATED = 0, 1, 2
FAR = 1 << 60


def closed(cost: list[int]) -> list[int]:
    """Costs of the states when turns may be inserted first."""
    u, a = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + u), min(cost[1], INSERT + u), u, a]


#: Costs at the end of a conversation: it may end with nothing said or after an assistant's turn.
END = tuple(closed([0, FAR, FAR, 0]))


def moves(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """The edits of one row: letter, cost and the state that they lead to, by letter."""
    yield "D", DELETE, state
    if fault != GONE:
        extra = CUT * (fault == TRUNCATED)
        if initial in STEP[state]:
            yield "K", extra, STEP[state][initial]
        yield "R", REROLE + extra, NEXT[state][1]


def costs_to_go(codes: tuple, end: tuple) -> list[list[int]]:
    """For each row and state the least cost from there to the conversation's end, backward from end."""
    out = [list(end)]
    for initial, fault in reversed(codes):
        later = out[-1]
        out.append(closed([min(c + later[to] for _, c, to in moves(q, initial, fault)) for q in range(4)]))
    return out[::-1]


def walk(codes: tuple, end: tuple, state: int, last: bool) -> tuple[list[str], list[str], int]:
    """For each row its edits (the letters of insertions before it, then its own), their new roles' initials, and the state behind all rows.

    At each step the ASCII-least of the edits that keep the total least is taken. A letter leads to one state
    only and ends of equal cost can't be prefixes of each other, so the least letters make the least audit. The
    conversation's last row also has the insertions behind it.
    """
    to_go, edits, roles = costs_to_go(codes, end), [], []
    for i, (initial, fault) in enumerate(codes):
        said = new = ""
        while True:
            left = to_go[i][state]
            ways = [(letter, c, to, i + 1) for letter, c, to in moves(state, initial, fault)] + [("I", INSERT, NEXT[state][1], i)]
            letter, _, to, at = min(w for w in ways if w[1] + to_go[w[3]][w[2]] == left)
            said += letter
            new += NEXT[state][0][0] if letter in "IR" else "-"
            state = to
            if at > i:
                break
        edits.append(said)
        roles.append(new)
    while last and to_go[-1][state]:
        edits[-1] += "I"
        roles[-1] += NEXT[state][0][0]
        state = NEXT[state][1]
    return edits, roles, state


@lru_cache(maxsize=1 << 14)
def whole_walk(codes: tuple) -> tuple[list[str], list[str]]:
    """The edits and new roles of a conversation that lies within one segment; most conversations look like others."""
    return walk(codes, END, 0, True)[:2]


def path_costs(codes: tuple) -> list[int]:
    """The 4 x 4 costs of getting through the rows of a segment from one state to another, without insertions behind them."""
    columns = [costs_to_go(codes, tuple(0 if q == to else FAR for q in range(4)))[0] for to in range(4)]
    return [columns[to][q] for q in range(4) for to in range(4)]


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def marked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows sorted by conversation and turn over all tasks and written: key, part, at, initial, fault and what they were."""
    key = F.concat(F.when(F.col(f"`{conv_col}`").isNull(), "n").otherwise("v"), F.coalesce(F.col(f"`{conv_col}`").cast("string"), F.lit("")))
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(key.alias("key"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    rows = keep(rows.withColumns({"at": F.monotonically_increasing_id(), "print": F.md5(F.concat_ws("\0", F.md5("role"), "text"))}))
    order = F.struct(F.col("turn").isNotNull(), "turn", "at")
    again = rows.groupBy("key", "print").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(again, ["key", "print"], "left")
    end = F.substring(trimmed(F.col("text")), -1, 1)
    fault = F.when(end == "", "blank").when(F.coalesce(order > F.col("first"), F.lit(False)), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("key", "conv", "turn", "role", "text", "at", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    rows = rows.orderBy("key", F.asc_nulls_first("turn"), "role", "text", "at").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    return keep(rows)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables with whole runs of one key (the first column), and the places of these runs.

    Rows come sorted by key; only the last key's rows so far are held back.
    """
    def runs(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_pylist()
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        return table, list(zip(starts, [*starts[1:], len(keys)]))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = pa.compute.index(b.column(0), b.column(0)[b.num_rows - 1]).as_py()
        if cut or held and held[0].column(0)[0] != b.column(0)[0]:
            yield runs([*held, b.slice(0, cut)] if cut else held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield runs(held)


def codes_of(table: pa.Table, start: int, end: int) -> tuple:
    part = table.slice(start, end - start)
    kinds = {"": FINE, "truncated": TRUNCATED}
    return tuple(zip(part.column("initial").to_pylist(), (kinds.get(f, GONE) for f in part.column("fault").to_pylist())))


def jumps(codes: tuple) -> int:
    return sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:]))


def split_conversations(rows: DataFrame) -> DataFrame:
    """key, part, ends, entry and jump of the segments of conversations that lie in several tasks' ranges.

    A range has at most two such segments, its first and its last one, so that this table is bounded by twice the
    number of partitions, and each conversation's part of it by their number. First each segment's 4 x 4 costs
    are found; behind-to-front products give the costs to go at its end (ends). Then each segment
    is walked from all four states, and the walks are followed from front to back (entry).
    """
    edges = rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    several = edges.groupBy("key").agg(F.collect_list("part").alias("parts")).filter("size(parts) > 1")
    several = keep(several.select("key", F.explode("parts").alias("part")))
    own = rows.select("key", "part", "at", "initial", "fault").join(F.broadcast(several), ["key", "part"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table, runs in segments(batches):
            for start, end in runs:
                codes = codes_of(table, start, end)
                out.append({"key": table.column("key")[start].as_py(), "part": table.column("part")[start].as_py(), "costs": path_costs(codes), "head": codes[0][0], "tail": codes[-1][0]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int32()), ("costs", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string())]))

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        at, out = list(END), []
        for costs in reversed(frame["costs"].tolist()):
            out.append(at)
            at = [min(costs[4 * q + to] + at[to] for to in range(4)) for q in range(4)]
        before = [None, *frame["tail"][:-1]]
        jump = [int(b is not None and b + h not in ("su", "ua", "au")) for b, h in zip(before, frame["head"])]
        return pd.DataFrame({"key": frame["key"], "part": frame["part"], "ends": out[::-1], "jump": jump, "last": [False] * (len(frame) - 1) + [True]})

    measured = own.select("key", "part", "initial", "fault").mapInArrow(measure, "key string, part int, costs array<bigint>, head string, tail string")
    ended = keep(measured.groupBy("key").applyInPandas(ends, "key string, part int, ends array<bigint>, jump int, last boolean"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table, runs in segments(batches):
            for start, end in runs:
                codes, till = codes_of(table, start, end), tuple(table.column("ends")[start].as_py())
                out.append({"key": table.column("key")[start].as_py(), "part": table.column("part")[start].as_py(), "exits": [walk(codes, till, q, False)[2] for q in range(4)]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int32()), ("exits", pa.list_(pa.int32()))]))

    def entries(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        at, out = 0, []
        for ways in frame["exits"]:
            out.append(at)
            at = int(ways[at])
        return pd.DataFrame({"key": frame["key"], "part": frame["part"], "entry": out})

    left = own.join(F.broadcast(ended.select("key", "part", "ends")), ["key", "part"]).select("key", "part", "initial", "fault", "ends")
    entered = left.mapInArrow(exits, "key string, part int, exits array<int>").groupBy("key").applyInPandas(entries, "key string, part int, entry int")
    return keep(ended.join(entered, ["key", "part"]))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repaired turns, and the conversations' counts, costs and audits.

    First table: key, conv, at, nth (the order of turns), edit, role and text of every turn that stays or is
    inserted. Second: key, conv, gaps, blank, duplicate, truncated, illegal, cost (long) and audit, a row
    for each conversation. A blank or duplicate turn must go; a truncated one may stay at a cost; roles may change
    and empty turns be inserted, until the roles' initials read (s?(ua)+)?. The cheapest edits are
    found backward over turns and grammar states and taken forward, ASCII-least among the tight ones.

    Rows are range-sorted by conversation, turn (null first), role, text and place, so equal rows are
    neighbours and a conversation of any length is spread over tasks: their pieces are joined by
    small tables of costs between the four states. A task holds the rows of one conversation within its
    range. A null role or text is one space; null conversations are one; empty tables give no rows;
    further columns are not read.
    """
    rows = marked(turns, conv_col, turn_col, role_col, text_col)
    pieces = split_conversations(rows)
    conv_type = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, spans in segments(batches):
            edits, roles, first = [], [], []
            given = [table.column(c) for c in ("ends", "entry", "last", "jump")]
            for start, end in spans:
                codes = codes_of(table, start, end)
                till, entry, last, jump = (c[start].as_py() for c in given)
                said, new = whole_walk(codes) if till is None else walk(codes, tuple(till), entry, last)[:2]
                edits.extend(said)
                roles.extend(new)
                first += [jumps(codes) + (jump or 0)] + [0] * (end - start - 1)
            got = table.select(["key", "conv", "turn", "role", "text", "at", "fault"]).append_column("edits", pa.array(edits, pa.string())).append_column("roles", pa.array(roles, pa.string())).append_column("illegal", pa.array(first, pa.int64()))
            yield from got.to_batches()

    wanted = rows.join(F.broadcast(pieces), ["key", "part"], "left").select("key", "part", "initial", "fault", "ends", "entry", "last", "jump", "conv", "turn", "role", "text", "at")
    done = keep(wanted.mapInArrow(run, f"key string, conv {conv_type}, turn bigint, role string, text string, at bigint, fault string, edits string, roles string, illegal bigint"))
    return repaired_turns(done), audits(done)


def repaired_turns(done: DataFrame) -> DataFrame:
    """The turns that stay or come in, with their roles after the repair."""
    letters = done.select("key", "conv", "at", "role", "text", "roles", F.posexplode(F.split("edits", "")).alias("nth", "edit")).filter("edit in ('I', 'K', 'R')")
    new = F.when(F.substr("roles", F.col("nth") + 1, F.lit(1)) == "u", "user").otherwise("assistant")
    return letters.select("key", "conv", "at", "nth", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(new).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def audits(done: DataFrame) -> DataFrame:
    """A row for each conversation; by turn and by range first, so that a long one's rows meet as counts and pieces of its audit."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    each = F.length("edits") - F.length(F.replace("edits", F.lit("I"), F.lit("")))
    price = each * INSERT + F.when(F.col("edits").contains("D"), DELETE).when(F.col("edits").contains("R"), REROLE).otherwise(0) + F.when((F.col("fault") == "truncated") & ~F.col("edits").contains("D"), CUT).otherwise(0)
    kinds = {k: n(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")}
    by_turn = done.groupBy("key", "conv", "turn").agg(*kinds.values(), n("illegal").alias("illegal"), n(price).alias("cost"))
    counts = by_turn.groupBy("key", "conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *(n(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
    )
    joined = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda s: s[c]), "")
    pieces = done.groupBy("key", F.shiftright("at", 33).alias("part")).agg(joined("at", "edits").alias("piece"))
    return counts.join(pieces.groupBy("key").agg(joined("part", "piece").alias("audit")), "key")


def line_hashes(turns: DataFrame) -> DataFrame:
    """key, sha256: lowercase hex of the lines `role:text` of each conversation, joined by newlines.

    A conversation's lines are read as a stream in their order by one task, which holds the hash alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        show = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["key", "sha256"])
        for b in batches:
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k == key:
                    digest.update(b"\n")
                else:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                digest.update(line.encode())
            yield show()
            out.clear()
        if key is not None:
            out.append((key, digest.hexdigest()))
        yield show()

    lines = turns.select("key", F.concat("role", F.lit(":"), "text").alias("line"), "at", "nth").repartition("key").sortWithinPartitions("key", "at", "nth")
    return lines.select("key", "line").mapInArrow(run, "key string, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with rows dropped, emptied, without sentence ends, repeated or said by the user, by a hash of conv_id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_kind")).filter("_kind != 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """conversations damaged and repaired: a row for every conv_id of the input, also where nothing is left."""
    turns, found = repair(damage(conversations))
    found = found.join(line_hashes(turns), "key", "left").drop("key")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
