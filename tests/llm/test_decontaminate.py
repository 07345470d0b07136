import re

from farewatch.llm import decontaminate as D

from .cases import frame, odd_documents

ITEMS = [("b1", "What IS the capital, of the old kingdom of the north and why was it moved?"), ("b2", "short item here"),
         ("b2", "short item here"), ("b3", None), (None, "lost id"), ("b4", " .. "), ("b5", "the of and to in is on that it was for are with")]


def brute(text, items, window=10):
    norm = lambda t: re.findall(D.ALNUM_WORD, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = norm(text), set(), set()
    for item, t in items:
        w = norm(t)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - window + 1)):
            pat = w[i:i + window]
            for k in range(len(words) - len(pat) + 1):
                if words[k:k + len(pat)] == pat:
                    hit |= set(range(k, k + len(pat)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def documents():
    rows = odd_documents()
    rows.append((200, "intro. What is THE capital of the old kingdom -- of the north and why, was IT moved? Short item; here. outro", "en", "s", 0, "", 0, 0))
    rows.append((201, "a short item here short item here b", "en", "s", 0, "", 0, 0))
    return rows


def check(spark, max_patterns):
    rows = documents()
    got = D.decontaminate(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id string, text string"), max_patterns=max_patterns).collect()
    want = sorted((r[0] is None, r[0] or 0, *brute(r[1], ITEMS)) for r in rows)
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["n_words"], g["n_hit"], sorted(g["items"])) for g in got) == want
    text = {r[0]: r[1] for r in rows}
    for g in got:
        for a, b in g["spans"]:
            assert text[g["doc_id"]][a:b].strip() and D.words_of(text[g["doc_id"]][a:b])
    return {g["doc_id"]: [text[g["doc_id"]][a:b] for a, b in g["spans"]] for g in got if g["n_hit"]}


def test_matches_brute_force_in_one_block(spark):
    spans = check(spark, 1000)
    assert spans[200] == ["What is THE capital of the old kingdom -- of the north and why, was IT moved? Short item; here"]


def test_blocks_of_patterns_give_the_same(spark):
    assert check(spark, 3) == check(spark, 1000)


def test_spans_are_united_over_blocks(spark):
    """Overlapping and touching windows in different blocks are one span, as in one block."""
    text = " ".join(f"w{k}" for k in range(40))
    words = text.split()
    items = [(f"i{k}", " ".join(words[a:a + 10])) for k, a in enumerate((0, 4, 8, 18, 29))]
    items += [("short", "w39")]
    docs = frame(spark, [(1, text, "en", "s", 0, "", 0, 0), (2, "w39, w39!", "en", "s", 0, "", 0, 0)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = ({r["doc_id"]: (r["hits"], [list(x) for x in r["spans"]], r["n_hit"], r["items"]) for r in D.decontaminate(docs, bench, max_patterns=m).collect()} for m in (1000, 1))
    assert one == many
    assert one[1][0] == [0, 28, 29, 40] and [text[a:b] for a, b in one[1][1]] == [" ".join(words[:28]), " ".join(words[29:])]
    assert one[2][1] == [[0, 8]]


def test_filter_and_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = frame(spark, documents())
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, bench, max_patterns=4).collect()}
    assert 200 not in kept and 201 not in kept and {100, 101, 102, None} <= kept
    assert D.drop_contaminated(docs, bench).columns == docs.columns
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
