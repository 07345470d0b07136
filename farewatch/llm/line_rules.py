"""Line-first quality rules.

Each line (split at line feeds) is judged by itself: symbol noise, navigation and separators,
boilerplate phrases, shouting, missing end punctuation, one word said over and over. Failing
lines are removed; a document that loses more than ``max_loss`` of its characters is rejected.
Before that stands the base check of the contract (too short, or mostly repeated 3-word windows).

Defined results: null or empty text has zero counts and fails the base check; white-space-only
lines count for nothing; repeated rows are judged alike; an empty table gives an empty table;
whole texts are used, however long; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, map_rows, read_table

MIN_WORDS = 50          # fixed value: base check
MAX_REPEAT_PCT = 50     # fixed value: base check
MAX_LOSS = 0.5          # share of a document's line characters that the line rules may remove
MAX_SYMBOL_RATIO = 0.06  # symbols per character of a line
MIN_SYMBOLS = 3         # ... and at least so many
MIN_BARE_WORDS = 10     # a line without end punctuation and fewer words is a heading or menu entry

SYMBOLS = re.compile(r"[#*$%&|<>]")
END_PUNCTUATION = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "。", "！", "？")
BOILERPLATE = re.compile(
    r"lorem ipsum|javascript|cookie policy|use cookies|privacy policy|terms of (?:use|service)|"
    r"all rights reserved|sign up now|log ?in to|subscribe to our|click here|read more\b")
SEPARATOR = re.compile(r"(?:^|\s)[|»>/•·–-](?=\s|$)")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lines_removed", pa.int64()),
                    ("chars_kept", pa.int64())])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, lines_removed long, chars_kept long")


def line_fails(line: str) -> bool:
    """One stripped, non-empty line against the line rules."""
    words = line.split()
    if len(SYMBOLS.findall(line)) > max(MAX_SYMBOL_RATIO * len(line), MIN_SYMBOLS - 1):
        return True                                       # symbol noise
    if len(words) >= 4 and len(SEPARATOR.findall(line)) * 4 >= len(words):
        return True                                       # menu or table row: every 4th word a separator
    if BOILERPLATE.search(line.lower()):
        return True
    if len(words) >= 4 and line.upper() == line and line.lower() != line:
        return True                                       # shouting: no lower-case letter at all
    if len(words) >= 12 and 4 * len(set(words)) <= len(words):
        return True                                       # each word about four times or more
    return not line.endswith(END_PUNCTUATION) and len(words) < MIN_BARE_WORDS


def repeat_words(words: list) -> int:
    """Word positions inside 3-word windows that occur at least twice in the text."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    m = len(number)
    pair = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:                                      # keep the product below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * m + ids[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = count[inverse] >= 2
    if not hit.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= hit
    return int(covered.sum())


def judge(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    seen, dup, total, lost, removed = set(), 0, 0, 0, 0
    for line in text.split("\n"):
        body = line.strip(" \t\v\f\r")
        if not body:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        total += len(body)
        if line_fails(body):
            lost += len(body)
            removed += 1
    rep = repeat_words(words)
    failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PCT * n
    kept = not failed and lost <= max_loss * total
    return n, len(text) - spaces, sum(map(text.count, "#*$%&|<>")), dup, rep, failed, kept, removed, total - lost


def clean_text(text: str | None) -> str:
    """The text without its failing lines."""
    return "\n".join(x for x in (text or "").split("\n") if x.strip(" \t\v\f\r") and not line_fails(x.strip(" \t\v\f\r")))


def apply_line_rules(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Counts and verdict of every row of ``docs``; one pass, no shuffle."""
    def run(batches):
        def cols(ids, texts):
            rows = list(zip(*(judge(t, max_loss) for t in texts), strict=True))
            return dict(zip(SCHEMA.names, [ids, *rows], strict=True))
        return map_rows(batches, SCHEMA, cols)
    return id_text(docs).mapInArrow(run, DDL)


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_line_rules(read_table(spark, sf_dir, "documents"))


# the counts and the base check in SQL; the verdict's line rules are restated with DuckDB's lists
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT rid, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS w FROM d),
g AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS win
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i FROM (SELECT rid, i, win, count(*) OVER (PARTITION BY rid, win) AS n FROM g WHERE win IS NOT NULL)
      WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
ln AS (SELECT rid, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body,
              row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth
       FROM (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d)),
lr AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS lw FROM ln WHERE body <> ''),
lf AS (SELECT rid, nth, length(body) AS n,
         (len(regexp_extract_all(body, '[#*$%&|<>]')) > greatest(0.06 * length(body), 2)
          OR (len(lw) >= 4 AND 4 * len(list_filter(lw, lambda x: x IN ('|', '»', '>', '/', '•', '·', '–', '-'))) >= len(lw))
          OR regexp_matches(lower(body), 'lorem ipsum|javascript|cookie policy|use cookies|privacy policy|terms of (?:use|service)|all rights reserved|sign up now|log ?in to|subscribe to our|click here|read more\b')
          OR (len(lw) >= 4 AND NOT regexp_matches(body, '\p{Ll}') AND regexp_matches(body, '\p{Lu}'))
          OR (len(lw) >= 12 AND 4 * len(list_distinct(lw)) <= len(lw))
          OR (len(lw) < 10 AND NOT regexp_matches(body, '[.!?…:;"''”’»)。！？]$'))) AS bad
       FROM lr),
la AS (SELECT rid, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, count(*) FILTER (WHERE bad) AS lines_removed,
              sum(n) AS total, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM lf GROUP BY rid),
b AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lines_removed, 0) AS lines_removed,
             coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN rep USING (rid) LEFT JOIN la USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.5 * total AS kept,
       CAST(lines_removed AS BIGINT) AS lines_removed, CAST(total - lost AS BIGINT) AS chars_kept
FROM f
"""
