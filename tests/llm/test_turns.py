import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from skyloom.llm import turns
from skyloom.llm.common import load
from skyloom.llm.queries import op12_repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def repaired(rows):
    """The contract's values for the (turn, role, text) of one conversation, over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, fault = set(), []
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, s, made=0):
        """(cost, audit, rows) from row i on, when the last role is s and made turns have just been inserted."""
        found = [(0, "", ())] if i == len(rows) and s in ("", "a") else []

        def go(cost, letter, row, *then):
            c, a, r = best(*then)
            found.append((cost + c, letter + a, (row,) + r if row else r))

        if made < 2:
            for role in ("user", "assistant"):
                if (s, role[0]) in step:
                    go(2, "I", (role, ""), i, role[0], made + 1)
        if i < len(rows):
            _, own, text = rows[i]
            cut = fault[i] == "truncated"
            go(3, "D", None, i + 1, s)
            if fault[i] not in ("blank", "duplicate"):
                if (s, own[:1]) in step:
                    go(cut, "K", (own, text), i + 1, own[0])
                for role in ("user", "assistant"):
                    if (s, role[0]) in step:
                        go(2 + cut, "R", (role, text), i + 1, role[0])
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    cost, audit, made = best(0, "")
    text = "\n".join(f"{a}:{b}" for a, b in made)
    return (gaps, *[fault.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def report(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(3)
    found, made = turns.repair(df)
    shas = {r[0]: r[1] for r in turns.digests(made).collect()}
    return {r["conv_id"]: (*tuple(r)[1:], shas.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def some(rng, n):
    roles = ["user", "assistant"] * 6 + ["system", "tool", "s", "", " "]
    texts = ["Yes.", "no", "Why?", "so be it!", " ", "", "x. ", "é…"] + [f"text {i}." for i in range(12)]
    return [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("step", [12, 1])
def test_repairs_against_strings(spark, step, monkeypatch):
    monkeypatch.setattr(turns, "STEP", step)
    rng = random.Random(step)
    convs = {i: some(rng, rng.choice([1, 2, 3, 5, 8, 12] + [40] * (i % 9 == 0))) for i in range(60 if step == 12 else 25)}
    convs |= {None: some(rng, 6), 500: [(None, "user", "A.")] * 9, 501: [(i, "user" if i % 2 else "assistant", f"{i}.") for i in range(70)]}
    rows = [(k, *r) for k, v in convs.items() for r in v]
    rng.shuffle(rows)
    got = report(spark, rows)
    assert got == {k: repaired(v) for k, v in convs.items()}


def test_query_and_edges(spark, sf, tmp_path):
    rows = [tuple(r) for r in load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    extra = [(9000, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", None), (9001, 3, "user", "long. " * 50_000)]
    gone = next(i for i in range(9100, 9999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    all_ = rows + extra + [(gone, 1, "user", "A.")]
    spark.createDataFrame([(*r, 1) for r in all_], "conv_id long, turn long, role string, text string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    by = {r[0]: [] for r in all_}
    for conv, *r in damaged(all_):
        by[conv].append(tuple(r))
    got = {r[0]: tuple(r)[1:] for r in op12_repair(spark, str(tmp_path)).collect()}
    assert got == {k: repaired(v) for k, v in by.items()} and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sum(x[5] > 0 for x in got.values()) > 5
    empty = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    a, b = turns.repair(empty)
    assert a.count() == 0 and turns.digests(b).count() == 0
