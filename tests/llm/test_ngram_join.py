import random

import numpy as np
import pytest

from farewatch.llm import ngram_join as J
from farewatch.llm.graph import components

from .cases import WORDS, frame, odd_documents, prose

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[top(i)] = min(ids.get(top(i), r[0]), r[0])
    return sorted((str(r[0]), len(s), str(ids.get(top(i)))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def edited(rnd, text, k):
    w = text.split()
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS) + "x"
    return " ".join(w)


def corpus():
    """Copies, near copies at both sides of the limit, one large group, a shared passage, short texts."""
    rnd = random.Random(3)
    rows = odd_documents()
    bases = [prose(rnd, rnd.randint(40, 200)) for _ in range(12)]
    k = 1000
    for b in bases:
        for edits in (0, 0, 1, 2, 3, 4, 5, 8):
            rows.append((k, edited(rnd, b, edits), "en", "s", 0, "", 0, 0))
            k += 1
    hot, passage = prose(rnd, 120), prose(rnd, 60)
    for i in range(60):
        rows.append((k + i, edited(rnd, hot, rnd.randint(0, 4)), "en", "s", 0, "", 0, 0))
        rows.append((k + 500 + i, passage + "\n" + prose(rnd, 30), "en", "s", 0, "", 0, 0))
    for i, t in enumerate(["a b", "A B", "a b c", "a b c d e", "a  b\nc d E", "a b c d e f"]):
        rows.append((5000 + i, t, "en", "s", 0, "", 0, 0))
    rows.append((None, bases[0], "en", "s", 0, "", 0, 0))
    return rows


@pytest.mark.parametrize("block_docs", [2000, 7])
def test_components_match_brute_force(spark, block_docs):
    rows = corpus()
    got = J.join(frame(spark, rows), block_docs).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], str(g["component_id"])) for g in got) == brute(rows)


def test_many_small_batches_give_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(J, "FLUSH_DOCS", 9)
    got = J.join(frame(spark, rows).coalesce(2), 7).collect()
    assert sorted((str(g["doc_id"]), g["n_shingles"], str(g["component_id"])) for g in got) == brute(rows)


def test_keep_one_document_per_group(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = J.keep_one(docs)
    want = {i for i, _, c in brute(rows) if i == c and i != "None"}
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert {str(i) for i in got if i is not None} == want and len([i for i in got if i is not None]) == len(want)


def test_empty_table(spark):
    docs = frame(spark, odd_documents()).limit(0)
    assert J.join(docs).count() == 0


def test_prefix_lemma_holds_for_every_level():
    """Sets that link share at least l of their l-prefixes, in any order of the tokens."""
    rnd = np.random.default_rng(4)
    for _ in range(300):
        n = int(rnd.integers(1, 40))
        a = set(rnd.choice(60, n, replace=False).tolist())
        b = set(a)
        for _ in range(int(rnd.integers(0, 4))):
            b.discard(next(iter(b))) if b and rnd.random() < 0.5 else b.add(int(rnd.integers(0, 60)))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        for level in range(1, J.needed(min(len(a), len(b))) + 1):
            pa, pb = (set(sorted(s)[:len(s) - J.needed(len(s)) + level]) for s in (a, b))
            assert len(pa & pb) >= level


def test_star_contraction(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: top(v) for a, b in edges if a != b for v in (a, b)}
