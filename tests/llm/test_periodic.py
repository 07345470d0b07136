"""Runs of words against a search over all lags and stretches."""

import hashlib
import random
import time
import zlib

import pytest

from farewatch.llm import periodic as P

from .cases import frame, odd_documents


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, m = i, j - i + q
            part = w[s:s + m]
            smallest = next(d for d in range(1, q + 1) if all(part[k] == part[k + d] for k in range(m - d)))
            if m >= max(12, 2 * q) and smallest == q:
                out.append((s, m, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(words, doc_id):
    words, n = list(words), len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else None
    return (len(runs), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def mixed_texts(seed, count):
    """Random words of few kinds, periodic pieces, and blocks that hold the same grams in other orders."""
    rnd = random.Random(seed)
    for _ in range(count):
        w = []
        while len(w) < rnd.randint(1, 150):
            kind = rnd.randint(0, 3)
            block = [rnd.choice("abc"[:rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 25))]
            w += block * rnd.randint(1, 5) if kind < 2 else block if kind == 2 else [str(rnd.random())]
            if kind == 1 and len(block) > 1:
                w += block[:rnd.randint(1, len(block))]
        yield w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    for w in mixed_texts(seed, 60):
        assert P.runs_of(P.number_words(w)) == brute_runs(w), w


def test_period_whose_grams_all_recur_sooner():
    """Both halves of the period hold the same 6-grams, so no gram's next occurrence is one period away."""
    u, v, x = "a b c d e f g".split(), "h i j k l m n o".split(), "p q r s t u".split()
    period = x + u + x + v + x + u + x + v + x + v + x + u
    for times in (2, 3):
        w = ["<"] + period * times + [">"]
        assert P.runs_of(P.number_words(w)) == brute_runs(w)


def test_edges():
    for w in ([], ["a"], ["a"] * 11, ["a"] * 12, list("ab") * 6, list("abcdef") * 2, list("abcdefg") * 2, list("abcdef") * 2 + ["a"], list("abcdefg") * 2 + ["x"]):
        assert P.runs_of(P.number_words(w)) == brute_runs(w)


@pytest.mark.parametrize("make", [lambda n: ["a"] * n, lambda n: [str(k % 7) for k in range(n)], lambda n: [str(k % 1000) for k in range(n)],
                                  lambda n: [str(k // 3 % 50) for k in range(n)], lambda n: ["ab"[bin(k).count("1") % 2] for k in range(n)]])
def test_long_periodic_texts_take_about_linear_time(make):
    start = time.time()
    runs = P.runs_of(P.number_words(make(200_000)))
    assert time.time() - start < 20
    assert all(m >= max(12, 2 * q) for _, m, q in runs)


def test_operator_on_odd_documents(spark, tmp_path):
    rows = odd_documents() + [(k, " \n".join(w), "en", "s", 0, "x", 0, 0) for k, w in enumerate(mixed_texts(9, 60), 1000)]
    rows = [r for r in rows if r[0] != 105]                # the brute force is quadratic
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op13_periodic_runs(spark, str(tmp_path)).collect()
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    want = [(r[0], *brute_digest(split(r[1]), r[0])) for r in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(g)[:8]) for g in got)
    docs = frame(spark, rows)
    runs = sorted((str(r[0]), *r[1:]) for r in P.periodic_runs(docs).collect())
    assert runs == sorted((str(r[0]), *x) for r in rows for x in brute_runs(split(r[1])))
    assert P.collapse_runs(docs).count() == len(rows)
    assert P.periodic_runs(docs.limit(0)).count() == P.collapse_runs(docs.limit(0)).count() == 0


def test_one_very_long_text():
    words = next(r for r in odd_documents() if r[0] == 105)[1].split()
    ids = P.number_words(["<", *words, *words, ">"])
    runs = P.runs_of(ids)
    assert (1, 2 * len(words), len(words)) in runs
    assert P.collapse(list(range(len(ids))), [(1, 2 * len(words), len(words))]) == [*range(len(words) + 1), len(ids) - 1]
