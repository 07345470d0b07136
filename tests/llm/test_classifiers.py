import random

import numpy as np

from farewatch.llm import quality as Q
from farewatch.llm import toxicity as T
from farewatch.llm.tokens import TokenMemo, char_ngrams, word_hashes, words_of

from .cases import frame, odd_documents, prose


def test_char_ngrams_stay_inside_words():
    at, h = char_ngrams(["ab", "c", "abc"], (3,))
    # " ab", "ab ", " c ", " ab", "abc", "bc "
    assert sorted(at.tolist()) == [0, 0, 1, 2, 2, 2]
    assert len(set(h.tolist())) == 5                       # " ab" occurs twice
    assert char_ngrams(["ab"], (3,))[1][0] == h[0]


def test_word_hashes_do_not_depend_on_neighbours():
    words = ["a", "bb", "a b".replace(" ", "_"), "zz", "é"]
    alone = [word_hashes([w])[0] for w in words]
    assert word_hashes(words).tolist() == alone and word_hashes(words[::-1]).tolist() == alone[::-1] and len(set(alone)) == 5


def test_memo_is_bounded_and_right():
    memo = TokenMemo(lambda ws: np.array([[len(w)] for w in ws]), limit=5)
    import pyarrow as pa
    for text in ("a bb ccc", "dddd eeeee f", "a a  bb ", "", " x"):
        idx, n = memo.words(pa.array([text, None]))
        assert [memo.rows[i, 0] for i in idx] == [len(w) for w in words_of(text)] and n.tolist() == [len(words_of(text)), 0]
    assert len(memo.known) <= 5


def junk(rnd, n):
    return " ".join(w + rnd.choice(["$$$", "***", "|"]) for w in prose(rnd, n).split())


def labelled(n=120):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rnd.random() < 0.6, rnd.random() < 0.4
        t = prose(rnd, rnd.randint(20, 80)) if good else junk(rnd, 40)
        if toxic:
            w = t.split(" ")
            for _ in range(rnd.randint(2, 6)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vilex", "Vilexer,", "grubbo"]))
            t = " ".join(w)
        rows.append((i, t, "en", "s", 0, "", 0, 0))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality_separates_held_out(spark):
    rows, labels = labelled()
    docs, lab = frame(spark, rows + odd_documents()[30:]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.train(docs, lab)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    truth = {i: q for i, q, _ in labels}
    import zlib
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and {100, 101, 102, None} <= set(got)
    # folding and memo give what the averaged vectors give
    f, c = Q.document_features(rows[0][1])
    z = (model.fold[f] * c).sum() / c.sum() + model.bias
    assert abs(1 / (1 + np.exp(-z)) - got[0]) < 1e-9
    assert Q.score(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = frame(spark, odd_documents())
    model = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in Q.score(docs, model).collect()} == {0.5}


def test_toxicity_held_out_and_order(spark):
    rows, labels = labelled(200)
    docs = frame(spark, rows + odd_documents()[30:])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, lab.where("doc_id % 4 <> 1"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    held = [(i, t) for i, _, t in labels if i % 4 == 1]
    assert np.mean([got[i]["toxic"] == bool(t) for i, t in held]) > 0.95
    assert all(0 <= r["severity"] <= T.GRADES for r in got.values()) and not got[100]["toxic"] and not got[101]["toxic"]
    one = T.score(spark.createDataFrame([(1, "so vilex a day"), (2, "vilex grubbo vilexer vilex grubbo " * 5)], "doc_id long, text string"), model).collect()
    assert sorted(one, key=lambda r: r["doc_id"])[0]["severity"] < sorted(one, key=lambda r: r["doc_id"])[1]["severity"]


def test_toxicity_without_toxic_labels(spark):
    docs = frame(spark, odd_documents())
    model = T.train(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    got = T.score(docs, model).collect()
    assert {r["severity"] for r in got} == {0.0} and not any(r["toxic"] for r in got)
    assert T.score(docs.limit(0), model).count() == 0


def test_ordinal_gradient_finds_ordered_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    rows = [np.arange(g) for g in grade]                    # one more feature per grade
    w, t = T.fit_ordinal(rows, grade, 3)
    z = np.array([w[r].sum() for r in rows])
    pred = (z[:, None] > t).sum(axis=1)
    assert (np.diff(t) >= 0).all() and (pred == grade).mean() > 0.95


def test_a_rare_toxic_root_outranks_frequent_words(spark):
    """All features are tested before any limit, so ordinary words do not crowd out a rarer root."""
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 2
        rows.append((i, prose(rnd, 200) + (" zorblat" if toxic and i % 8 == 1 else ""), "en", "s", 0, "", 0, 0))
        labels.append((i, 1, toxic))
    model = T.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_features=2)
    assert len(model.keys) == 2 and np.isin(model.keys, T.text_hashes("zorblat")).all()
