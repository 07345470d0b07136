import zlib

import numpy as np

from farewatch.llm import token_store as S
from farewatch.llm.common import scratch_path

from .cases import frame, odd_documents


def test_grammar_round_trip_and_overlaps():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 40, 5000), np.zeros(501, np.int64), np.array([5]), np.tile([1, 2, 3, 1, 2], 300)):
        last = rng.random(len(ids)) < 0.02
        last[-1] = True
        seq, rules, marks = S.compress(ids.astype(np.uint16), last, 64)
        tables = S.expansions(rules, S.expansion_lengths(rules, 64), 64)
        assert (S.decode(seq, *tables) == ids).all() and marks.sum() == last.sum()
        # documents end where symbols end
        size = tables[2]
        assert set(np.cumsum(size[seq])[marks]) == set(np.flatnonzero(last) + 1)
    assert len(S.compress(np.tile([1, 2, 3, 1, 2], 300).astype(np.uint16), np.zeros(1500, bool), 64)[0]) < 400


def test_wide_symbols():
    ids = np.tile([70_000, 1, 3], 100)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    seq, rules, _ = S.compress(ids.astype(np.uint32), last, 70_001)
    assert (S.decode(seq, *S.expansions(rules, S.expansion_lengths(rules, 70_001), 70_001)) == ids).all() and len(seq) < len(ids)


def test_files_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(S.tokenizer_path())
    rows = odd_documents() + [(400, "don't <|endoftext|> it's İstanbul ﬁne é x 12² __a__ $$$", "en", "s", 0, "", 0, 0)]
    path = S.write_tokens(frame(spark, rows), scratch_path(spark, "t"), block_tokens=500)
    got = sorted(S.read_documents(spark, path).collect(), key=lambda r: r["start"])
    want = {}
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(rows)
    assert [g["doc_id"] is not None and g["doc_id"] for g in got] == sorted(g["doc_id"] is not None and g["doc_id"] for g in got)
    at = 0
    for g in got:
        assert g["start"] == at and (g["n_tokens"], g["ids_crc32"]) in want[g["doc_id"]]
        at += g["n_tokens"]
    # random access: single documents and spans of them
    for row in spark.read.schema(S.BLOCK_DDL).parquet(path).collect():
        block = S.Block(row.asDict())
        ids = block.all_ids()
        ends = np.cumsum(block.doc_tokens)
        for k, (e, n) in enumerate(zip(ends, block.doc_tokens, strict=True)):
            own = ids[e - n:e]
            assert (block.document(k) == own).all()
            for a, b in ((0, n), (n // 3, n // 2 + 1), (n - 1, n)):
                assert (block.span(k, a, b) == own[a:b]).all()


def test_any_text_encodes_as_by_the_library():
    import random

    import pyarrow as pa
    enc = S.Encoder(S.tokenizer_path())
    rnd = random.Random(5)
    letters = ["a", "B", "é", "É", "ß", "ÿ", "×", "ª", "µ", "'", "'s", "!", "_", "$", "9", "中", "ﬁ", "é", "́", " ",
               "\n", " ", "​", "<|endoftext|>", "İ", "ı", "ſ", "K", "-", "…", "٣", "½", "\U0001f600", "Σ", "\x00", "\x1c"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + [None]
    ids, n = enc(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert enc.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[at:at + k].tolist(), repr(t)
        at += k


def test_empty_table(spark):
    path = S.write_tokens(frame(spark, odd_documents()).limit(0), scratch_path(spark, "t"))
    assert S.read_documents(spark, path).count() == 0


def test_no_frequent_pair_is_left():
    """Long repeats become few symbols: rounds go on until no pair reaches the minimum count."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 30_000, 3000)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 30_000, 50)]) for _ in range(40)])
    last = np.zeros(len(ids), bool)
    last[3049::3050] = True
    seq, rules, marks = S.compress(ids.astype(np.uint16), last, 30_000)
    assert (S.decode(seq, *S.expansions(rules, S.expansion_lengths(rules, 30_000), 30_000)) == ids).all()
    pairs = np.stack([seq[:-1], seq[1:]], axis=1)[~marks[:-1]]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < S.MIN_COUNT
    assert len(seq) < 40 * 60


def test_small_memos_stay_small_and_give_the_same_ids(spark):
    """The pieces of the words are bounded by the memo's size too, and ids do not depend on it."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) + str(k) for k in range(6000)]
    small, large = S.Encoder(S.tokenizer_path(), memo_words=300), S.Encoder(S.tokenizer_path())
    for k in range(0, 6000, 100):
        texts = pa.array([" ".join(words[k:k + 50]), " ".join(words[k + 50:k + 100])])
        for got, want in zip(small(texts), large(texts), strict=True):
            assert (got == want).all()
        assert len(small.words) <= 300 and len(small.pieces) <= 3 * 300 + 1
    rows = [(k, " ".join(words[7 * k:7 * k + 40]), "en", "s", 0, "", 0, 0) for k in range(300)]
    stored = [sorted(map(tuple, S.read_documents(spark, S.write_tokens(frame(spark, rows), scratch_path(spark, "t"), **options)).collect()))
              for options in ({}, {"memo_words": 300, "encode_chars": 500})]
    assert len(stored[0]) == 300 and stored[0] == stored[1]
