"""Benchmark decontamination with an Aho-Corasick automaton.

The benchmark texts are normalised (A-Z lower-cased, words of letters, digits and non-ASCII
characters) and cut into windows of ``window`` words; an item of fewer words is one window. All
windows form one automaton; each document is normalised the same way and scanned once. A match
ends at a character of the normalised text; it is mapped to word numbers and, for the spans, to
character offsets of the original text.

The automaton is broadcast, so its size is checked: a benchmark of more than ``max_patterns``
windows is split into blocks of that many, each block scans the documents, and the word hits of
the blocks are united per document.

Defined results: null and empty texts have no words and no hits; benchmark items without words
or with a null id or text match nothing; repeated items count once; repeated documents are judged alike;
an empty benchmark finds nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, filter_rows, id_text, materialise, read_table
from .tokens import held

WINDOW = 10               # fixed value of the contract
MAX_PATTERNS = 500_000    # windows per automaton; about 1 kB each in a Python worker

# lower-case A-Z, keep digits, letters and non-ASCII bytes, everything else becomes a space
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    w = words_of(text)
    if not w:
        return []
    return sorted({b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))})


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(pattern, item_ids) with one row per distinct window."""
    cut = F.udf(lambda t: [p.decode("utf-8", "surrogatepass") for p in windows_of(t, window)], "array<string>")
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null"))
    rows = items.select("item_id", F.explode(cut("text")).alias("pattern")).distinct()
    return rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def _automaton(key: str, patterns: tuple):
    """One automaton per worker process and pattern block."""
    return held("automaton", key, lambda: build(patterns))


def build(patterns: tuple):
    """The automaton of some windows; bytes are mapped to Latin-1 characters."""
    a = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        a.add_word(f" {p.encode('utf-8', 'surrogatepass').decode('latin-1')} ", (k, p.count(" ") + 1))
    a.make_automaton()
    return a


def scan(words: list[bytes], automaton) -> list[tuple[int, int, int]]:
    """Matches of a word list: (pattern number, first word, end word)."""
    text = " " + b" ".join(words).decode("latin-1") + " "
    hits, at, word = [], 0, 0
    for end, (k, n) in automaton.iter(text):
        word += text.count(" ", at, end + 1)              # spaces up to here = words that ended
        at = end + 1
        hits.append((k, word - 1 - n, word - 1))
    return hits


def word_spans(text: str, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of [first, end) word ranges."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    at = [m.span() for m in re.finditer(ALNUM_WORD, lower)]
    return [(at[a][0], at[b - 1][1]) for a, b in wanted]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()),
                    ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.list_(pa.int32())))])
DDL = "doc_id long, row_key long, n_words long, hits array<int>, items array<string>, spans array<array<int>>"


def _scan_block(docs: DataFrame, rows: list) -> DataFrame:
    """docs (doc_id, text, row_key) against one block of windows."""
    shared = docs.sparkSession.sparkContext.broadcast(_keyed(rows))

    def run(batches):
        key, patterns, items = shared.value
        automaton = _automaton(key, patterns) if patterns else None
        for b in batches:
            if not b.num_rows:
                continue
            out: dict[str, list] = {n: [] for n in SCHEMA.names[2:]}
            for text in b.column(1).to_pylist():
                words = words_of(text)
                found = scan(words, automaton) if automaton and words else []
                hit = np.zeros(len(words) + 1 if found else 1, np.int32)
                for _, a, e in found:
                    hit[a] += 1
                    hit[e] -= 1
                inside = np.flatnonzero(np.cumsum(hit) > 0)
                cuts = np.flatnonzero(np.diff(inside) > 1)
                runs = [(int(inside[a]), int(inside[e - 1]) + 1) for a, e in
                        zip([0, *(cuts + 1)], [*(cuts + 1), len(inside)], strict=True)] if len(inside) else []
                out["n_words"].append(len(words))
                out["hits"].append([x for r in runs for x in r])
                out["items"].append(sorted({i for k, _, _ in found for i in items[k]}))
                out["spans"].append([list(s) for s in word_spans(text, runs)] if runs else [])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "row_key": b.column(2), **out}, schema=SCHEMA)
    return docs.mapInArrow(run, DDL)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns: one filtering pass
    per block of windows (one block, unless the benchmark is beyond the bound)."""
    wins = materialise(benchmark_windows(benchmark, window), "decon-windows")
    blocks = max(1, -(-wins.count() // max_patterns))
    for k in range(blocks):
        rows = wins.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).orderBy("pattern").collect()
        shared = docs.sparkSession.sparkContext.broadcast(_keyed(rows)[:2])

        def clean(texts, shared=shared):
            key, patterns = shared.value
            if not patterns:
                return [True] * len(texts)
            automaton = _automaton(key, patterns)
            return [not scan(words_of(t.as_py()), automaton) for t in texts]
        docs = filter_rows(docs, clean)
    return docs


def _keyed(rows: list) -> tuple:
    patterns = tuple(r["pattern"] for r in rows)
    return (hashlib.sha1("\n".join(patterns).encode("utf-8", "surrogatepass")).hexdigest(), patterns,
            [list(r["item_ids"]) for r in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(doc_id, n_words, hits, items, spans, n_hit) per row of ``docs``: hits are flattened
    [first, end) word ranges, spans character ranges of the original text."""
    wins = benchmark_windows(benchmark, window)
    n = wins.count()                                       # the size check of the broadcast
    base = id_text(docs)
    length = F.expr("aggregate(sequence(0, cast(size(hits) / 2 as int) - 1), 0L, (s, i) -> s + hits[2 * i + 1] - hits[2 * i])")
    n_hit = F.when(F.size("hits") > 0, length).otherwise(F.lit(0).cast("long"))
    if n <= max_patterns:
        rows = wins.orderBy("pattern").collect()
        out = _scan_block(base.withColumn("row_key", F.lit(0).cast("long")), rows)
        return out.drop("row_key").withColumn("n_hit", n_hit)
    # beyond the bound: blocks of patterns, each scanning all documents, united per row
    keyed = materialise(base.withColumn("row_key", F.monotonically_increasing_id()), "decon-docs")
    blocks = -(-n // max_patterns)
    numbered = materialise(wins.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))), "decon-windows")
    parts = [_scan_block(keyed, numbered.where(F.col("block") == b).orderBy("pattern").collect()) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    merged = found.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(_runs()))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = F.expr(_UNITE)
    return (merged.withColumn("runs", united)
            .select("doc_id", "n_words", F.flatten(F.transform("runs", lambda r: F.array(r["first"], r["end"]))).alias("hits"), "items",
                    F.transform("runs", lambda r: F.array(r["start"], r["stop"])).alias("spans"))
            .withColumn("n_hit", n_hit).select("doc_id", "n_words", "hits", "items", "spans", "n_hit"))


def _runs():
    """The hits of a row with their characters: (first word, end word, first character, end) each."""
    return F.expr("transform(spans, (s, i) -> named_struct('first', hits[2 * i], 'end', hits[2 * i + 1], 'start', s[0], 'stop', s[1]))")


# runs in order of their first words; one that begins at or before the last one's end extends it
_UNITE = """aggregate(runs, cast(array() as array<struct<first: int, end: int, start: int, stop: int>>), (done, x) ->
  if(size(done) > 0 and x.first <= element_at(done, -1).end,
     concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'end', greatest(element_at(done, -1).end, x.end),
                                                               'start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, x.stop)))),
     concat(done, array(x))))"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS pat
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.pat = bw.pat),
hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM m) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
