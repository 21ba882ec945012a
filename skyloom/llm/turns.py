"""Repair of conversations by their cheapest edits, of which the least audit string is found by prefix doubling.

A repaired conversation's roles are nothing, or a system turn if any and then pairs of user and assistant. Rows
are kept (K, free), given the other role (R, 2), deleted (D, 3; blank and repeated rows must be) and empty turns
inserted (I, 2); a truncated row that stays costs 1. Costs are a shortest path over (row, state of the roles):
groups of rows give matrices of costs, groups of groups their products, and going down again each row learns the
costs before and after it, so that a conversation of any length is spread over tasks. The arcs of optimal paths
are then ranked by the audit strings that begin with them, of one letter, two, four and so on; the ranks choose
an arc at every node and the doubled pointers give each chosen arc its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import join_unique, stage

#: Rows of a group, and groups of a group of groups, as powers of two.
STEP = 12
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What an inserted or changed row makes of them.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: What a kept row makes of a state, by its role's initial.
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
TERMINAL = (0, 4, 2, 0)
BEGIN = (0, FAR, FAR, FAR)
DELETE, INSERT, KEPT, CHANGED = range(4)
#: Letters of a packed rank: three bits each.
PACKED = 4


def inserted(after: tuple | list) -> list[int]:
    """Costs to go before a row's insertions, from those after them."""
    return [min(after[s], 2 + after[NEXT[s]], 4 + after[NEXT[NEXT[s]]]) for s in range(4)]


def arrived(before: tuple | list) -> list[int]:
    """Costs so far with insertions."""
    out = list(before)
    for _ in range(2):
        for s in range(4):
            if out[s] + 2 < out[NEXT[s]]:
                out[NEXT[s]] = out[s] + 2
    return out


def moves(code: int, s: int) -> list[tuple[int, int, int]]:
    """(letter, next state, cost) of what can be done with a row; code: initial (3: none of s, u, a), 4 if it must go, 8 if it is truncated."""
    out = [(DELETE, s, 3)]
    if not code & 4:
        cut = code >> 3
        if (s, code & 3) in KEEP:
            out.append((KEPT, KEEP[s, code & 3], cut))
        out.append((CHANGED, NEXT[s], 2 + cut))
    return out


def forward(code: int, before: list[int]) -> list[int]:
    out, at = [FAR] * 4, arrived(before)
    for s in range(4):
        if at[s] < FAR:
            for _, t, cost in moves(code, s):
                out[t] = min(out[t], at[s] + cost)
    return out


def backward(code: int, after: list[int]) -> list[int]:
    return inserted([min(cost + after[t] for _, t, cost in moves(code, s)) for s in range(4)])


def product(a: list[int], b: list[int]) -> list[int]:
    return [min(FAR, min(a[4 * s + u] + b[4 * u + t] for u in range(4))) for s in range(4) for t in range(4)]


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows that make gives for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for row in batch.to_pylist() for x in make(row)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(work, schema)


def _illegal(kinds: list[int]) -> int:
    return sum(x not in LEGAL for x in zip(kinds, kinds[1:], strict=False))


def _summary(row: dict) -> list[dict]:
    """The matrix of a group's costs; its first and last initial and its illegal steps."""
    codes, m = [x["code"] for x in row["rows"]], []
    for s in range(4):
        v = [0 if t == s else FAR for t in range(4)]
        for code in codes:
            v = forward(code, v)
        m += v
    kinds = [c & 3 for c in codes]
    return [{"c": row["c"], "g": row["g"], "m": m, "ends": [kinds[0], kinds[-1], _illegal(kinds)]}]


def _compose(row: dict) -> list[dict]:
    m, (first, last, illegal) = row["parts"][0]["m"], row["parts"][0]["ends"]
    for x in row["parts"][1:]:
        m = product(m, x["m"])
        illegal += x["ends"][2] + ((last, x["ends"][0]) not in LEGAL)
        last = x["ends"][1]
    return [{"c": row["c"], "g": row["g"], "m": m, "ends": [first, last, illegal]}]


def _spread(row: dict) -> list[dict]:
    """The costs before and after each part of a group."""
    parts, before, after, out = row["parts"], row["before"], row["after"], []
    ahead = [after]
    for x in parts[:0:-1]:
        ahead.append([min(FAR, min(x["m"][4 * s + t] + ahead[-1][t] for t in range(4))) for s in range(4)])
    for k, x in enumerate(parts):
        out.append({"c": row["c"], "g": x["g"], "before": before, "after": ahead[len(parts) - 1 - k], "first": row["first"] and k == 0, "last": row["last"] and k == len(parts) - 1})
        before = [min(FAR, min(before[s] + x["m"][4 * s + t] for s in range(4))) for t in range(4)]
    return out


def _node(pos: int, after: bool, s: int) -> int:
    return (pos * 2 + after) * 4 + s


def _arcs(row: dict) -> list[dict]:
    """Arcs of a group's rows that lie on optimal paths: each has its node's number times four and a letter."""
    rows, before, last = row["rows"], row["before"], row["last"]
    follow = (rows[-1]["pos"] + (not last), last)
    ahead, done = [list(row["after"])], len(rows)
    for x in reversed(rows):
        ahead.append(backward(x["code"], ahead[-1]))
    ahead.reverse()
    so_far, out, total = list(before), [], min(arrived(before)[s] + ahead[0][s] for s in range(4))
    for i in range(done + last):
        at = arrived(so_far)
        here = (rows[i]["pos"], False) if i < done else follow
        then = (rows[i + 1]["pos"], False) if i + 1 < done else follow
        for s in range(4):
            if at[s] + ahead[i][s] != total:
                continue
            node = _node(*here, s)
            steps = [(x, _node(*then, t) if i + 1 < done or not last or TERMINAL[t] else None) for x, t, cost in (moves(rows[i]["code"], s) if i < done else []) if cost + ahead[i + 1][t] == ahead[i][s]]
            if (i < done or TERMINAL[s]) and 2 + ahead[i][NEXT[s]] == ahead[i][s]:
                steps.append((INSERT, _node(*here, NEXT[s]) if i < done or TERMINAL[NEXT[s]] else None))
            out += [{"c": row["c"], "arc": 4 * node + x, "node": node, "to": to, "root": row["first"] and i == 0 and s == START} for x, to in steps]
        if i < done:
            so_far = forward(rows[i]["code"], so_far)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """rows numbered from 0 on in pos, which holds a partition and a place in it."""
    part = F.shiftright("pos", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each partition: few, and known to be
    begin = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    return rows.withColumn("part", part).join(F.broadcast(begin), "part").withColumn("pos", F.col("begin") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "begin")


def _costs(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups with before, after, first and last; and per conversation cost and illegal."""
    vector = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    alone = groups.where("alone")
    single = alone.select("c", "g", "rows", vector(BEGIN).alias("before"), vector(TERMINAL).alias("after"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    shape, way = "c string, g long, m array<long>, ends array<long>", "c string, g long, before array<long>, after array<long>, first boolean, last boolean"
    levels = [stage(_map(groups.where("not alone").select("c", "g", "rows"), shape, _summary), "turns-level")[0]]
    gather = lambda x: x.groupBy("c", F.shiftright("g", STEP).alias("g")).agg(F.sort_array(F.collect_list(F.struct("g", "m", "ends"))).alias("parts"))
    while True:
        n = levels[-1].agg(F.count("*"), F.countDistinct("c")).first()
        if n[0] == n[1]:
            break
        levels.append(stage(_map(gather(levels[-1]), shape, _compose), "turns-level")[0])
    top = levels[-1]
    cost = F.array_min(F.array(*[F.col("m")[s] + TERMINAL[s] for s in range(4)]))
    totals = top.select("c", cost.alias("cost"), F.col("ends")[2].alias("illegal"))
    down = top.select("c", "g", vector(BEGIN).alias("before"), vector(TERMINAL).alias("after"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    for below in reversed(levels[:-1]):
        down = stage(_map(gather(below).join(down, ["c", "g"]), way, _spread), "turns-down")[0]
    many = groups.where("not alone").select("c", "g", "rows").join(down, ["c", "g"])
    return single.unionByName(many), totals


def _single(row: dict) -> list[dict]:
    v = list(BEGIN)
    for x in row["rows"]:
        v = forward(x["code"], v)
    return [{"c": row["c"], "cost": min(v[s] + TERMINAL[s] for s in range(4)), "illegal": _illegal([x["code"] & 3 for x in row["rows"]])}]


def _least_paths(arcs: DataFrame) -> DataFrame:
    """(c, arc, place) of the arcs of each conversation's least audit string.

    Round k has for each arc the rank of the 2^k letters from it on and the arc after these. Ranks are packed
    letters up to 16 and then numbers in their order; a node's least arc is the one of least rank. No node has two arcs of
    one letter, so its ranks never tie.
    """
    least = arcs.groupBy("node").agg(F.min("arc").alias("next"))
    now = stage(arcs.join(least.withColumnRenamed("node", "to"), "to", "left").select("arc", (F.col("arc").bitwiseAND(F.lit(3)) + 1).alias("rank"), "next"), "turns-ranks")[0]
    levels, k = [], 0
    while now.where("next is not null").limit(1).count():
        levels.append(now)
        ahead = now.select(F.col("arc").alias("next"), F.col("rank").alias("rank2"), F.col("next").alias("next2"))
        going = now.where("next is not null").join(ahead, "next").select("arc", "rank", "rank2", F.col("next2").alias("next"))
        both = going.unionByName(now.where("next is null").select("arc", "rank", F.lit(0).cast("long").alias("rank2"), "next"))
        if k < PACKED:
            out = both.select("arc", (F.shiftleft("rank", 3 * 2**k) + F.col("rank2")).alias("rank"), "next")
        else:
            both = stage(both.select("arc", F.struct("rank", "rank2").alias("pair"), "next"), "turns-pairs")[0]
            kinds = both.groupBy("pair").agg(F.count("*").alias("n")).repartitionByRange("pair").sortWithinPartitions("pair")
            numbered = stage(kinds.select("pair", "n", (F.monotonically_increasing_id() + 1).alias("rank")), "turns-order")[0]
            out = join_unique(both, numbered, "pair", both.count()).select("arc", "rank", "next")
        now, k = stage(out, "turns-ranks")[0], k + 1
    begin = arcs.where("root").join(now.select("arc", "rank"), "arc").groupBy("c").agg(F.min(F.struct("rank", "arc")).alias("x")).select("c", "x.arc", F.lit(0).cast("long").alias("place"))
    path = stage(begin, "turns-path")[0]
    for k in reversed(range(len(levels))):
        ahead = path.join(levels[k].where("next is not null").select("arc", "next"), "arc").select("c", F.col("next").alias("arc"), (F.col("place") + 2**k).alias("place"))
        path = stage(path.unionByName(ahead), "turns-path")[0]
    return path


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and how it is mended: (report, repaired).

    report has a row for each conversation: the id, gaps (numbers missing between its least and greatest turn), blank,
    duplicate, truncated (rows by their first fault), illegal (steps between roles), cost, and audit, the letters of the
    cheapest edits in order. repaired has the rows that result: the id, place (from 0, counting edits), role and text.

    Rows go by turn (nulls first), then role and text, so equal rows are neighbours and interchangeable. Null roles and
    texts are one blank; a role that is empty or has another initial than s, u and a can't be kept. A null id is a
    conversation of its own; one that has no turn but nulls has no gaps. Other columns are left out, whatever their names;
    an empty table gives empty ones. A conversation of any size is spread over tasks, but for its audit, which is one value.
    """
    blank, kind = F.lit(" "), turns.schema[conv_col].dataType
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("c"), F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"), F.monotonically_increasing_id().alias("u"),
    ).withColumn("hash", F.sha2("text", 256))
    order = ["c", F.asc_nulls_first("turn"), "role", "hash", "u"]
    rows = _placed(stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("u").withColumn("pos", F.monotonically_increasing_id()), "turns-rows")[0])
    first = rows.groupBy("c", "role", "hash").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    code = initial + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    marks = rows.select("c", "id", "turn", "role", "pos", last.alias("last")).join(first, "pos", "left").withColumn("fault", fault)
    marks = stage(marks.select("c", "id", "turn", "pos", "fault", code.cast("long").alias("code")), "turns-marks")[0]
    count = lambda x: F.count_if(F.col("fault") == x).alias(x)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    report = marks.groupBy("c").agg(F.any_value("id").alias("id"), gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"))

    groups = marks.groupBy("c", F.shiftright("pos", STEP).alias("g")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    spread = groups.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c", F.lit(False).alias("alone"))
    groups = stage(groups.join(spread, "c", "left").withColumn("alone", F.coalesce("alone", F.lit(True))), "turns-groups")[0]
    known, totals = _costs(groups)
    arcs = stage(_map(known, "c string, arc long, node long, to long, root boolean", _arcs), "turns-arcs")[0]
    totals = totals.unionByName(_map(groups.where("alone").select("c", "rows"), "c string, cost long, illegal long", _single))
    path = _least_paths(arcs)
    letter, node = F.col("arc").bitwiseAND(F.lit(3)), F.shiftright("arc", 2)
    edits = path.select("c", "place", F.substring(F.lit("DIKR"), letter + 1, F.lit(1)).alias("edit"), F.shiftright(node, 3).alias("pos"), node.bitwiseAND(F.lit(3)).alias("state"))
    piece = edits.groupBy("c", F.shiftright("place", 10).alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "edit"))), lambda x: x["edit"]), "").alias("s"))
    audit = piece.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "").alias("audit"))
    report = report.join(totals, "c").join(audit, "c")
    role = F.when(F.col("state") == USER, "assistant").otherwise("user")
    stay = edits.where("edit in ('K', 'R')").join(rows.select("pos", F.col("role").alias("old"), "text"), "pos").select("c", "place", F.when(F.col("edit") == "K", F.col("old")).otherwise(role).alias("role"), "text")
    made = stay.unionByName(edits.where("edit = 'I'").select("c", "place", role.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("c") != "", F.substr("c", F.lit(2))).cast(kind)
    return report.select(F.col("id").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), made.select(own.alias(conv_col), "place", "role", "text")


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of role:text, joined by newlines, of each conversation that has rows; a task reads these in order, one at a time, and keeps none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(conv_col, repaired.schema[conv_col].dataType), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            done = []
            for key, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or key != own:
                    if state:
                        done.append((own, state.hexdigest()))
                    own, state = key, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([own], arrow[0].type), pa.array([state.hexdigest()])], schema=arrow)

    ordered = repaired.select(conv_col, "place", "role", "text").repartition(conv_col).sortWithinPartitions(conv_col, "place").drop("place")
    return ordered.mapInArrow(work, schema)
