"""Fingerprints against a plain vote count, successors against a sorted list, search against all pairs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from farewatch.llm import fingerprints as S
from farewatch.llm.tokens import mix64, word_hashes

from .cases import frame, odd_documents, prose


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    h = [int(word_hashes([w.decode()])[0]) for w in words]
    terms = Counter(("w", x) for x in h)
    weight = {}
    size = min(5, len(h))
    for i in range(len(h) - size + 1 if h else 0):
        v = 5
        for x in h[i:i + size]:
            v = (v * int(S._MULT) + x) % 2 ** 64
        terms["r", int(mix64(np.array([v], np.uint64))[0])] += 1
    votes = [0] * 128
    for (kind, t), n in terms.items():
        weight = (2 if kind == "r" else 1) * (1 + int(math.log2(n)))
        data = b"".join(int(mix64(np.array([(t + int(s)) % 2 ** 64], np.uint64))[0]).to_bytes(8, "little") for s in (S._MULT, S._OTHER))
        for b in range(128):
            votes[b] += weight if data[b // 8] >> (7 - b % 8) & 1 else -weight
    return "".join("1" if v > 0 else "0" for v in votes)


def test_votes_equal_a_plain_count():
    rnd = random.Random(3)
    texts = ["", "one", "One  two", "a b c d e", "a b c d e f " * 9, prose(rnd, 300), "Ünï 中文 ß", "\n\t", *[prose(rnd, k) for k in range(1, 12)]]
    got = S.fingerprints(pa.array(texts, pa.string()))
    assert ["".join(f"{x:08b}" for x in p) for p in got] == [brute_print(t) for t in texts]
    alone = np.concatenate([S.fingerprints(pa.array([t], pa.string())) for t in texts])
    assert (alone == got).all()


def test_likeness_orders_texts():
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(20, 400)) for _ in range(200)]
    edited = [S._edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    a, b, c = (S.fingerprints(pa.array(x, pa.string())) for x in (texts, edited, texts[1:] + texts[:1]))
    assert (S.likeness(a, b) > S.likeness(a, c)).mean() >= 0.97
    one_word = [t.replace(" ", " xyz ", 1) for t in texts]
    assert (S.likeness(a, S.fingerprints(pa.array(one_word, pa.string()))) > 0.75).mean() > 0.95


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_on_odd_documents(spark, tmp_path, partitions):
    rows = odd_documents()
    frame(spark, rows).repartition(partitions).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in S.op12_fingerprints(spark, str(tmp_path)).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, f = r[1] or "", nxt[1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + f[:half]
        p, q, x = (S.fingerprints(pa.array([s], pa.string()))[0] for s in (t, e, f))
        near = lambda u, v: float(np.mean(np.unpackbits(u) == np.unpackbits(v)))
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), p.tobytes().hex(), q.tobytes().hex(), near(p, q), near(p, x)))
    assert sorted(map(str, want)) == sorted(str(tuple(g[c] for c in S._NAMES)) for g in got)
    prints = [np.frombuffer(bytes.fromhex(w[3]), np.uint8) for w in want]
    for g in got:
        own = np.frombuffer(bytes.fromhex(g["fingerprint"]), np.uint8)
        n = sum(int(np.bitwise_count(own ^ p).sum()) <= S.RADIUS for p in prints)
        assert g["n_near"] == (n if g["doc_id"] is not None and g["doc_id"] % 100 == 0 else None)


def test_empty_table_and_one_row(spark):
    docs = frame(spark, odd_documents())
    assert S.with_next(docs.limit(0)).count() == 0 and S.fingerprint_documents(docs.limit(0)).count() == 0
    assert S.with_next(docs.where("doc_id = 7")).collect()[0]["near_next"] == 1.0


@pytest.mark.parametrize("radius,together", [(0, 1), (3, 1), (6, 2), (9, 2)])
def test_search_finds_every_pair(spark, radius, together):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(128) for _ in range(12)]
    prints = {f"{b:032x}" for b in base}
    for b in base:
        for _ in range(20):
            v = b
            for k in rnd.sample(range(128), rnd.randint(1, radius + 2)):
                v ^= 1 << k
            prints.add(f"{v:032x}")
    prints |= {"0" * 32, "f" * 32}
    df = spark.createDataFrame([(p,) for p in sorted(prints)] * 2, "fingerprint string")
    queries = sorted(prints)[::3]
    got = [tuple(r) for r in S.search(df, spark.createDataFrame([(q,) for q in queries], "fingerprint string"), radius, together).collect()]
    want = [(q, p, (int(q, 16) ^ int(p, 16)).bit_count()) for q in queries for p in prints if (int(q, 16) ^ int(p, 16)).bit_count() <= radius]
    assert sorted(got) == sorted(want)
