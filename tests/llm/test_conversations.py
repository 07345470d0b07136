"""Conversation repair against all sequences of edits, and long conversations in pieces against whole ones."""

import hashlib
import itertools
import random
import re
import zlib
from contextlib import contextmanager

import pytest

from farewatch.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, audit string"


@contextmanager
def parted(spark, partitions):
    """So many partitions after each shuffle, however small."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def all_repairs(rows, most_inserts=2):
    """Least (cost, audit, repaired) over all edits of (role, text, must go, truncated), by trying."""
    best = None

    def check(audit, cost, said):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in said)
        if re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in said))

    def go(i, audit, cost, said, inserts):
        if best and cost > best[0]:
            return
        if i == len(rows):
            check(audit, cost, said)
        else:
            role, text, gone, late = rows[i]
            go(i + 1, audit + "D", cost + 2, said, inserts)
            if not gone:
                go(i + 1, audit + "K", cost + 5 * late, [*said, (role, text)], inserts)
                for new in ("user", "assistant"):
                    go(i + 1, audit + "R", cost + 1 + 5 * late, [*said, (new, text)], inserts)
        if inserts:
            for new in ("user", "assistant"):
                go(i, audit + "I", cost + 5, [*said, (new, "")], inserts - 1)
    go(0, "", 0, [], most_inserts)
    return best


def brute(table):
    """The contract by plain Python; exhaustive over edits."""
    out = []
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text, *_ in table:
            if c != conv:
                continue
            role, text = (" " if v is None else v for v in (role, text))
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            late = not blank and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
            seen.add((role, text))
            fault = "blank" if blank else "duplicate" if again else "truncated" if late else None
            if fault:
                n[fault] += 1
            turns.append((role, text, blank or again, late))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, said = all_repairs(turns)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return out


def table(seed, conversations, most):
    rnd, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for k in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "Å"])
            text = rnd.choice(["Hi.", "What?", "It ends", "No!  \n", " \t", "", None, "Well. So", "Ünï 中.", "x" * 80 + ".", "x" * 80 + "!"])
            rows.append((conv, rnd.choice([k, k, k + 1, k, None]), role, text, 1, "z"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_all_edit_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), "t", rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randint(0, 6))]
        codes = "".join("-" if g else {"u": "uU", "a": "aA", "s": "sS", "t": "?!"}[r[0]][late] for r, _, g, late in rows)
        assert C.search(codes) == all_repairs(rows)[:2], codes


def test_pieces_chain_to_the_whole():
    rnd = random.Random(8)
    for _ in range(300):
        codes = "".join(rnd.choice("uauauasUAS?!-") for _ in range(rnd.randint(0, 40)))
        size, chain = rnd.randint(1, 9), C.Chain()
        for k in range(0, len(codes), size):
            chain.add(C.table(codes[k:k + size]))
        assert chain.best() == C.search(codes), codes


def test_long_conversations_are_searched_quickly():
    import time
    rnd, start = random.Random(2), time.time()
    for kinds in ("ua", "uauauaUA-?", "sS!?", "aaau", "-", "UA!"):
        cost, audit = C.search("".join(rnd.choice(kinds) for _ in range(3000)))
        assert len(audit.replace("I", "")) == 3000
    assert time.time() - start < 20


@pytest.mark.parametrize("partitions,piece", [(1, 1024), (5, 1024), (5, 2), (13, 3)])
def test_report_equals_brute_force(spark, partitions, piece):
    rows = table(partitions + piece, 40, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with parted(spark, partitions):
        got = C.repair_report(C.damaged(df), piece).collect()
        assert sorted(map(str, brute(rows))) == sorted(str(tuple(r)) for r in got)
        said = {}
        for r in C.repaired_turns(C.damaged(df), piece).orderBy("conv_id", "position").collect():
            said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {r["conv_id"]: r["repaired_sha256"] for r in got} == \
            {r["conv_id"]: hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() for r in got}


@pytest.mark.parametrize("piece", [16, 5000])
def test_one_conversation_with_most_rows(spark, piece):
    rnd = random.Random(4)
    rows = [(7, k // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", "b", "", f"{k}.", f"{k}!", f"{k} so"]), 0, "") for k in range(3000)]
    rows += [(7, 5000, "user", "same.", 0, "")] * 500 + [(c, t, "user", "Hi.", 0, "") for c in range(50) for t in range(3) if c != 7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    with parted(spark, 6):
        got = {r["conv_id"]: r for r in C.repair_report(C.undamaged(df), piece).collect()}
    assert len(got) == 50
    ordered = sorted([r for r in rows if r[0] == 7], key=lambda r: (r[1], r[2], r[3]))
    report, turns = C._whole([(t, r, x) for _, t, r, x, *_ in ordered])
    assert tuple(got[7])[1:] == tuple(report.values())
    assert got[7]["duplicate"] >= 499 and sum(len(c[1]) for c in [(r, r["audit"]) for r in got.values()]) >= len(rows)


def test_empty_table_and_extreme_turns(spark):
    df = spark.createDataFrame([(1, 2 ** 63 - 1, "user", "a.", 0, ""), (1, -2 ** 63, "assistant", "b.", 0, "")], SCHEMA)
    assert C.repair_report(C.undamaged(df)).collect()[0]["gaps"] == 2 ** 63 - 1
    assert C.repair_report(C.damaged(df.limit(0))).count() == C.repaired_turns(C.damaged(df.limit(0))).count() == 0
