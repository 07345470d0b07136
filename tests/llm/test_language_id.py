import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from farewatch.llm import language_id as L

from .cases import frame, odd_documents

SYLLABLES = {"aa": "ka ti mo ne ru so la".split(), "bb": "schl erg ung ich ein heit ver".split(), "cc": "ña ción que los ado ez rra".split()}


def text(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=90):
    rnd = random.Random(2)
    rows = [(i, text(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randint(10, 60)), lang, "s", 0, "", 0, 0) for i in range(n)]
    return rows + [r[:2] + (None,) + r[3:] for r in odd_documents()[30:35]]


def recursion(c, d, total, types):
    def p(g):
        if not g:
            return 1 / (1 << L.BITS)
        k, h = len(g), g[:-1]
        if not total[k][h]:
            return p(g[1:])
        return max(c[k][g] - d[k], 0) / total[k][h] + d[k] * types[k][h] / total[k][h] * p(g[1:])
    return p


def naive(rows, order=L.ORDER):
    """Interpolated Kneser-Ney with plain dictionaries; characters are their own symbols."""
    count = {lang: {k: Counter() for k in range(1, order + 1)} for lang in SYLLABLES}
    for t, lang in rows:
        for w in L.LETTERS.findall(t.lower()):
            s = " " + w + " "
            for i in range(1, len(s)):
                k = min(i + 1, order)
                count[lang][k][s[i + 1 - k:i + 1]] += 1
    prob = {}
    for lang, c in count.items():
        for k in range(order - 1, 0, -1):
            raw = c[k]
            cont = Counter(g[1:] for g in c[k + 1])
            c[k] = Counter({g: v for g, v in cont.items() if k == 1 or not g.startswith(" ")})
            if k > 1:
                c[k].update(raw)
        d, total, types = {}, defaultdict(Counter), defaultdict(Counter)
        for k in c:
            n1, n2 = sum(v == 1 for v in c[k].values()), sum(v == 2 for v in c[k].values())
            d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, v in c[k].items():
                total[k][g[:-1]] += v
                types[k][g[:-1]] += 1

        prob[lang] = recursion(c, d, total, types)
    return prob


def test_model_equals_naive_kneser_ney(spark):
    rows = [(t, lang) for _, t, lang, *_ in corpus() if t and lang]
    model = L.train(spark.createDataFrame(rows, "text string, lang string"))
    prob = naive(rows)
    rnd = random.Random(9)
    tokens = [text(rnd, lang, 1) for lang in SYLLABLES for _ in range(4)] + ["zzz", "Ka-tI", "x9y", "123"]
    got = model.bits(tokens)
    for row, t in zip(got, tokens, strict=True):
        n = 0
        bits = dict.fromkeys(SYLLABLES, 0.0)
        for w in L.LETTERS.findall(t.lower()):
            s = " " + w + " "
            for i in range(1, len(s)):
                n += 1
                for lang in bits:
                    bits[lang] -= math.log2(prob[lang](s[i + 1 - min(i + 1, L.ORDER):i + 1]))
        assert row[-1] == n
        assert row[:-1] == pytest.approx([bits[x] for x in model.langs], rel=1e-9, abs=1e-9)


def test_held_out_accuracy_and_rejection(spark):
    docs = frame(spark, corpus(95))
    model = L.train(L.training_rows(docs))
    got = L.predict(docs, model).collect()
    lang = {r[0]: r[2] for r in corpus(95)}
    held = [g for g in got if g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2 and lang[g["doc_id"]]]
    assert held and all(g["lang_pred"] == lang[g["doc_id"]] for g in held)
    by_id = {g["doc_id"]: g for g in got}
    for i in (100, 101, 102, 103):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["accepted"]) == ("und", 0.0, False)
    assert all(0 <= g["score"] <= 1 for g in got)
    strange = spark.createDataFrame([(1, "qxzj wvkq zzxq jjqk " * 20)], "doc_id long, text string")
    assert not L.predict(strange, model).collect()[0]["accepted"]
    kept = L.keep_accepted(docs, model)
    assert kept.columns == docs.columns and {100, 101, 102, 103}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_no_training_rows_and_empty_table(spark):
    docs = frame(spark, odd_documents())
    none = L.train(L.training_rows(docs).limit(0))
    assert {r["lang_pred"] for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(docs.limit(0), none).count() == 0


def test_joined_scoring_equals_arrays_and_limits(spark):
    docs = frame(spark, corpus(40) + odd_documents()[28:])
    rows = L.training_rows(docs)
    arrays, tables = L.fit(rows), L.fit(rows, max_cells=0)
    assert arrays.in_arrays and not tables.in_arrays and tables.langs == arrays.langs
    assert (tables.sd, tables.excess) == (arrays.sd, arrays.excess) and tables.mean == pytest.approx(arrays.mean, rel=1e-9)
    key = lambda r: (str(r["doc_id"]), r["bits_per_char"] or 0.0)
    a, b = (sorted(L.predict(docs, m).collect(), key=key) for m in (arrays, tables))
    assert len(a) == len(b) == docs.count()
    for x, y in zip(a, b, strict=True):
        assert (x["doc_id"], x["lang_pred"], x["accepted"]) == (y["doc_id"], y["lang_pred"], y["accepted"])
        assert y["score"] == pytest.approx(x["score"], rel=1e-6) and (y["bits_per_char"] or 0.0) == pytest.approx(x["bits_per_char"] or 0.0, rel=1e-9)
    assert L.keep_accepted(docs, tables).count() == L.keep_accepted(docs, arrays).count()


def test_rejection_by_held_out_limits(spark):
    """Held-out texts of the languages stay, also halves of two; random letters and a language never seen go."""
    rnd = random.Random(4)
    rows = [(text(rnd, lang, 40), lang) for lang in SYLLABLES for _ in range(150)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert 0 < model.sd < 5 and model.excess < 2
    own = [text(rnd, lang, n) for lang in SYLLABLES for n in (10, 40, 300)]
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + " " * (rnd.random() < 0.2) for _ in range(n)) for n in (60, 300, 3000)]
    noise += ["\u0434\u043e\u0431\u0440\u044b\u0439 \u0432\u0435\u0447\u0435\u0440 " * 10]
    got = {r["doc_id"]: r["accepted"] for r in L.predict(spark.createDataFrame(list(enumerate(own + noise)), "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(len(own + noise))] == [True] * len(own) + [False] * len(noise)


def test_n_grams_are_made_of_few_words_at_a_time():
    """Counts and bits do not depend on how many words are taken at once, and no call gets more."""
    from collections import Counter

    import numpy as np

    from farewatch.llm.tokens import TokenMemo
    rnd = np.random.default_rng(6)
    words = ["".join(map(chr, rnd.integers(97, 105, rnd.integers(1, 9)))) + "-x" * int(rnd.integers(0, 2)) for _ in range(500)]
    many = Counter({w: k + 1 for k, w in enumerate([*words, "12", "é"])})
    whole = L._count(many, "en", at_once=10 ** 6)
    for at_once in (1, 7, 100):
        assert L._count(many, "en", at_once=at_once).equals(whole)
    calls = []

    def lengths(some):
        calls.append(len(some))
        return np.array([[len(w), 1.0] for w in some])
    distinct = list(dict.fromkeys(words))
    one, few = TokenMemo(lengths), TokenMemo(lengths, at_once=9)
    assert len(one.places(distinct)) == len(distinct)
    calls.clear()
    at = few.places(distinct)
    assert max(calls) <= 9 and sum(calls) == len(distinct)
    assert (few.rows[at] == one.rows[one.places(distinct)]).all()
