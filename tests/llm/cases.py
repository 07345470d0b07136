"""Documents that every operator has to bear."""

from __future__ import annotations

import random

WORDS = "the of and to in is on that it was for are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, token long, n int"


def prose(rnd: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, rnd.randint(5, 14))
        out.append(" ".join(rnd.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return "\n".join(" ".join(out[i:i + 4]) for i in range(0, len(out), 4))


def odd_documents(seed: int = 1, n: int = 30) -> list[tuple]:
    """Ordinary texts with nulls, empties, a repeated row, equal texts, one very long text, a null
    id, null language and source, and extra columns with names the operators use inside."""
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.randint(30, 120)), "en", f"s{i % 4}", 0, "x", i, 1) for i in range(n)]
    rows += [(100, None, "en", "s0", None, None, None, None), (101, "", None, None, 0, "", 0, 0), (102, " \n\t ", "en", "s1", 3, "x", 0, 0),
             (103, "!!! ??? 123", "en", "s1", 3, "x", 0, 0), (104, rows[3][1], "en", "s1", 0, "x", 0, 0), rows[5], rows[5],
             (105, prose(rnd, 60_000), "en", "s2", 0, "x", 0, 0), (None, prose(rnd, 50), "en", "s2", 0, "x", 0, 0),
             (106, "Ünïcödé " * 20 + " \x85é 中文字", "en", "s3", 0, "x", 0, 0), (107, "word", "en", "s3", 0, "x", 0, 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
