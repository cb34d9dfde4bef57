"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from vulnlake.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, _null string, place long, code string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def damaged(rows):
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(d, 1)):
            yield conv, turn, role, text


def searched(conv):
    """Least (cost, audit) and the faults, by trying every edit at every row."""
    faults, seen = [], set()
    for role, text in conv:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = []
        if i == len(conv):
            if state in (0, 3):
                return 0, ""
        else:
            cost, edits = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + edits))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                kept = NEXT.get((state, conv[i][0][:1]))
                for letter, to, price in (("K", kept, 0), ("R", NEXT[state, DUE[state][0]], 1)):
                    if to is not None:
                        cost, edits = best(i + 1, to, 0)
                        ways.append((cost + price + more, letter + edits))
        if inserted < 3:
            cost, edits = best(i, NEXT[state, DUE[state][0]], inserted + 1)
            ways.append((cost + 5, "I" + edits))
        return min(ways, default=(10**9, ""))

    for i in range(len(conv), -1, -1):  # from the end, so that the recursion stays flat
        for state in range(4):
            best(i, state, 0)
    cost, audit = best(0, 0, 0)
    out, state, rows = [], 0, iter(conv)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit != "D":
            role = role if edit == "K" else DUE[state]
            state = NEXT[state, role[0]]
            out.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return faults, cost, audit, out


def expected(rows):
    convs = {r[0]: [] for r in rows}
    turns = {r[0]: [] for r in rows}
    order = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    for conv, turn, role, text in order:
        convs[conv].append((role, text))
        if turn is not None:
            turns[conv].append(turn)
    for conv, got in convs.items():
        faults, cost, audit, out = searched(got)
        t = turns[conv]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        yield (conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
               hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def rows_like(seed, sizes, ends=(".", "?", "", " ", "!\n"), roles=("user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    for conv, n in enumerate(sizes):
        for i in range(n):
            text = r.choice([None, "", " \n", f"same{r.choice(ends)}"]) if r.random() < 0.3 else f"t{r.randrange(n * 3)}{r.choice(ends)}"
            yield conv, r.choice([i, i, i, i + 3, None]), r.choice(roles), text


def check(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = repair.repair(spark, repair.damage(table), table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    have = {r.conv_id: tuple(r) for r in got.collect()}
    want = {r[0]: r for r in expected(rows)}
    assert len(have) == got.count() == len(want)
    for conv, row in want.items():
        assert have[conv] == row, conv


def test_small_conversations(spark):
    rows = list(rows_like(1, [1, 2, 3, 5, 8, 4, 6, 2, 1, 9] * 12))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (777, None, "user", "x" * 200_000 + ".")]
    check(spark, rows)


def test_chunks_and_passes(spark, monkeypatch):
    """Chunks of four rows; runs in which no chunk converges on its own; equal rows without a turn."""
    monkeypatch.setattr(repair, "CHUNK", 4)
    rows = list(rows_like(2, [150, 40, 90, 7]))
    rows += [(50, i, "tool", f"cut {i}") for i in range(120)]  # all truncated, role not allowed
    rows += [(51, i, "assistant", f"a{i}.") for i in range(60)]
    rows += [(52, i, "system", f"s{i}.") for i in range(60)]
    rows += [(53, None, "user", "Again.")] * 100
    rows += [(54, i, "user", f"u{i}") for i in range(80)] + [(54, 100, "assistant", "End.")]
    check(spark, rows)


def test_repaired_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = sorted(tuple(r) for r in repair.repaired_rows(spark, table).collect())
    assert rows == [(1, 0, "user", "Hi."), (1, 1, "assistant", "There.")]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(spark, repair.damage(table), table).count() == 0


@pytest.mark.parametrize("code", range(16))
def test_bounds_hold(code):
    """A row keeps vectors within the bounds, and a bound vector is its own closure."""
    for t in range(4):
        v = (repair.STEP[code] + repair.BOUND[None, :, t]).min(1)
        assert (v[:, None] <= repair.BOUND + v[None, :]).all()
    assert (repair.LAST[:, None] <= repair.BOUND + repair.LAST[None, :]).all()
    assert ((repair.BOUND[:, :, None] + repair.BOUND[None, :, :]).min(1) == repair.BOUND).all()


def test_chunks_that_converge():
    rows = np.array([repair.INITIALS.index("u"), repair.INITIALS.index("a")] * 20, np.int8)
    assert repair.converged(repair.speculate([rows.tobytes()]))[0]


def test_query(spark):
    table = queries.table(spark, SF_SMALL, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op11_conversation_repair(spark, SF_SMALL).collect()} == set(expected(rows))
