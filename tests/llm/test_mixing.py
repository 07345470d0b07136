from collections import defaultdict

import pytest

from farewatch.llm import mixing as M

from .cases import frame, odd_documents


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling by the contract's words: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += w[s] * unit
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_copies(spark):
    rows = odd_documents(n=90)
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    source = {}
    for r in rows:
        source[r[0]] = r[3]
        sizes[r[3]] += len((r[1] or "").encode().split())
    for g in got:
        s = source[g["doc_id"]]
        target[s] = g["target"]
        taken[s] += g["copies"] * g["size"]
        largest[s] = max(largest[s], g["size"])
        assert g["source_size"] == sizes[s] and 0 <= g["copies"] <= 2
    for s, t in fill(dict(sizes)).items():
        assert target[s] == pytest.approx(t, rel=1e-9, abs=1e-6)
        assert abs(taken[s] - t) <= largest[s] + 1          # within one document of the target


def test_reruns_agree_and_order_of_rows_is_no_input(spark):
    rows = odd_documents(n=60)
    once = sorted((str(r["doc_id"]), r["copies"]) for r in M.mix(frame(spark, rows)).collect())
    again = sorted((str(r["doc_id"]), r["copies"]) for r in M.mix(frame(spark, rows[::-1]).repartition(5)).collect())
    assert once == again
    assert M.mix(frame(spark, rows).limit(0)).count() == 0


def test_emit_repeats_rows(spark):
    docs = frame(spark, odd_documents(n=40))
    mixed = M.mix(docs)
    out = M.emit(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == mixed.groupBy().sum("copies").collect()[0][0]


def test_windows_see_one_row_per_source_only(spark):
    plan = M.mix(frame(spark, odd_documents()))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
