from collections import Counter

from farewatch.llm import line_rules as L

from .cases import frame, odd_documents, prose


def brute_repeat(words):
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    return len({i + k for i, w in enumerate(wins) if n[w] >= 2 for k in range(3)})


def test_counts_match_brute_force(spark):
    rows = odd_documents() + [(300, "a b c a b c a b c\n\na b c a b c a b c\n x $%| <y>", "en", "s", 0, "", 0, 0)]
    got = L.apply_line_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(str(x) for x in r)
    want = []
    for r in rows:
        t = r[1] or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        want.append((r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute_repeat(words)))
    assert sorted(map(key, want)) == sorted(key((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"])) for g in got)
    assert all(not g["kept"] for g in got if g["base_failed"])
    assert L.apply_line_rules(frame(spark, rows).limit(0)).count() == 0


def test_rules_per_line():
    for bad in ("Home | About | News | Contact us", "Sign up now for our newsletter and never miss a thing.", "## ** $$ %% && ||", "READ THIS NOW OR ELSE!!", "Next page",
                "spam spam spam spam spam spam spam spam spam spam spam spam"):
        assert L.line_fails(bad), bad
    for good in ("It was the best of times, it was the worst of times.", "“Why?” she asked.", "He paid 5% more & left.",
                 "a long line without a stop that goes on and on for a while"):
        assert not L.line_fails(good), good


def test_documents_that_lose_too_much_go():
    import random
    good = prose(random.Random(4), 90)
    menu = "\n".join(["Home | About | News | Contact | Help | More"] * 3)
    assert L.judge(good + "\n" + menu)[6]
    assert L.clean_text(good + "\n" + menu) == good
    assert not L.judge(good + "\n" + "\n".join(f"Menu {i} | About | News | Contact | Help | More {i}" for i in range(40)))[6]
