"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

The terms of a text are its words (A-Z lower-cased, between ASCII white space) and its runs of five
words; with fewer than five words, the whole sequence. Every distinct term votes with its
weight for or against each of ``BITS`` bits, by the bits of its hash: a five-word run weighs twice a
word, and a term that occurs n times weighs 1 + floor(log2 n) times as much. A bit is set where the
votes for it prevail. Votes are integers, so equal texts have equal fingerprints in any batch.

``search`` finds all fingerprints within ``radius`` bits of each query. The bits are cut into
``radius + TOGETHER`` blocks; two fingerprints within the radius agree on at least ``TOGETHER``
whole blocks. There is one table per choice of ``TOGETHER`` blocks, in which fingerprints stand under
those blocks (a permutation that puts them first); a query looks into each table under its own
blocks, and a pair is taken in the first table that holds it. Distinct fingerprints are searched, so
groups of exact copies count once; nothing is capped.

``with_next`` gives each document its successor in descending order of doc_id without a window over
all rows: Spark range-partitions and sorts once, tasks pair neighbours as they stream, and only the
first and last row of each partition are joined afterwards.

Defined results: a null text is the empty text; the empty text's fingerprint has no bit set; null ids
come last in the order; rows of the same id follow each other by their texts' first characters, then
by hash, and repeated rows stand together; a single row is its own successor; an empty table gives an
empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, read_table
from .tokens import mix64, slices, split_words, word_hashes

BITS = 128
TERM_WORDS = 5              # fixed value: words of a shingle
RUN_WEIGHT = 2              # of a five-word run, against 1 of a word
RADIUS = 6
TOGETHER = 2                # blocks a table's key holds
SLICE_CHARS = 400_000       # text that votes at a time
KEY_CHARS = 64              # of the text, in the order of rows with the same id
TEXTS = 128                 # ... and so many texts
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1      # votes of each byte value
_MULT = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, weight) of each text's distinct terms, in order of texts."""
    per_text, coded = split_words(pc.ascii_lower(texts))
    known = coded.dictionary.to_pylist()
    if not known or known == [""]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    real = np.array([w != "" for w in known])
    index = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    keep = real[index]
    hashes = word_hashes([w or "-" for w in known])
    word, owner = hashes[index[keep]], owner[keep]
    n = np.bincount(owner, minlength=len(per_text))
    end = np.cumsum(n)
    run = np.full(max(len(word) - TERM_WORDS + 1, 0), np.uint64(TERM_WORDS))
    for k in range(TERM_WORDS):
        run = run * _MULT + word[k:k + len(run)]
    whole = np.flatnonzero(owner[:len(run)] == owner[TERM_WORDS - 1:])            # runs inside one text
    short = np.flatnonzero((n > 0) & (n < TERM_WORDS))
    rest, at = np.full(len(short), np.uint64(TERM_WORDS)), end[short] - n[short]
    for k in range(TERM_WORDS - 1):
        inside = k < n[short]
        rest[inside] = rest[inside] * _MULT + word[at[inside] + k]
    term = np.concatenate([word, mix64(run[whole]), mix64(rest)])
    weight = np.full(len(term), RUN_WEIGHT)
    weight[:len(word)] = 1
    owner = np.concatenate([owner, owner[whole], short])
    # distinct within their text: one 64-bit key of both
    key = mix64(term ^ (owner.astype(np.uint64) * _OTHER))
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times, first = np.diff(np.append(head, len(key))), order[head]
    weight = weight[first]
    many = times > 1
    weight[many] *= 1 + np.floor(np.log2(times[many])).astype(np.int64)
    order = np.argsort(owner[first], kind="stable")
    first = first[order]
    return owner[first], term[first], weight[order]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(texts x BITS/8) bytes."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for at, part in slices(texts, SLICE_CHARS):
        owner, term, weight = _terms(part)
        both = np.stack([mix64(term + _MULT), mix64(term + _OTHER)], axis=1).view(np.uint8)
        for first in range(0, len(part), TEXTS):
            a, e = np.searchsorted(owner, (first, first + TEXTS))
            if e > a:
                out[at + first:at + min(first + TEXTS, len(part))] = _vote(owner[a:e] - first, both[a:e], weight[a:e], min(TEXTS, len(part) - first))
    return out


def _vote(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Votes are summed per text, byte of the hash and value of that byte, then per bit."""
    width = BITS // 8
    place = (owner[:, None] * width + np.arange(width)) * 256 + hashes
    sums = np.bincount(place.ravel(), np.repeat(weight, width), n * width * 256).reshape(n, width, 256)
    return np.packbits((sums @ _SIGNS).reshape(n, BITS) > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hex(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def _edited(text: str, following: str) -> str:
    """The contract's edit: the last half of the code points replaced by as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_COLUMNS = [("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"),
            ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"),
            ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
_EDGE = [("partition", pa.int32(), "int"), ("side", pa.string(), "string"), ("text", pa.string(), "string")]
_NAMES = [c for c, _, _ in _COLUMNS]


def _schema(columns) -> pa.Schema:
    return pa.schema([(c, t) for c, t, _ in columns])


def _ddl(columns) -> str:
    return ", ".join(f"{c} {t}" for c, _, t in columns)


def _compare(ids: list, texts: list[str], following: list[str], own=None, after=None) -> dict:
    """The result columns for documents and their successors."""
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    own = fingerprints(pa.array(texts, pa.string())) if own is None else own
    after = fingerprints(pa.array(following, pa.string())) if after is None else after
    changed = fingerprints(pa.array(edited, pa.string()))
    return dict(zip(_NAMES, [ids, [len(t) for t in texts], [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
                             _hex(own), _hex(changed), likeness(own, changed), likeness(own, after)], strict=True))


def _pair_neighbours(batches):
    """Results of all rows but a partition's last, whose successor stands in the next partition;
    the partition's first and last row as edges."""
    columns = _COLUMNS + _EDGE
    part, held = TaskContext.get().partitionId(), None

    def edge(side, doc_id, text):
        row = dict.fromkeys([c for c, _, _ in columns]) | {"doc_id": doc_id, "partition": part, "side": side, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=_schema(columns))
    for b in batches:
        for at, texts in slices(pc.fill_null(b.column(1), ""), 4_000_000):
            ids, texts = b.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist()
            prints = fingerprints(pa.array(texts, pa.string()))
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
            if len(ids) > 1:
                out = _compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                yield pa.RecordBatch.from_pydict(out | {c: [None] * (len(ids) - 1) for c, _, _ in _EDGE}, schema=_schema(columns))
            held = ids[-1], texts[-1], prints[-1:]
    if held is not None:
        yield edge("last", *held[:2])


def with_next(docs: DataFrame) -> DataFrame:
    """The columns of ``op12`` for every document of ``docs`` and its successor."""
    spark = docs.sparkSession
    d = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    # repeated rows may be as many as they like: the row's own number spreads them
    d = d.withColumns({"_t": F.substring("text", 1, KEY_CHARS), "_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), "_t", "_h", "_n"]
    ranged = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = materialise(ranged.mapInArrow(_pair_neighbours, _ddl(_COLUMNS + _EDGE)), "neighbours")
    # one number per partition: the next one that has rows, the first one's after the last
    parts = sorted(r[0] for r in rows.where("side = 'first'").select("partition").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "partition int, next int")
    last = rows.where("side = 'last'").select("doc_id", "text", "partition").join(follows, "partition")
    first = rows.where("side = 'first'").select(F.col("partition").alias("next"), F.col("text").alias("following"))

    def finish(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(_compare(*(b.column(k).to_pylist() for k in range(3))), schema=_schema(_COLUMNS))
    edges = last.join(first, "next").select("doc_id", "text", "following").mapInArrow(finish, _ddl(_COLUMNS))
    return rows.where("side is null").select(*_NAMES).unionByName(edges)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as lower-case hex) of every document; one pass, no shuffle."""
    schema = _schema([_COLUMNS[0], _COLUMNS[3]])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fingerprint": _hex(fingerprints(pc.fill_null(b.column(1), "")))}, schema=schema)
    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _block_bits(radius: int, together: int) -> list[tuple[int, int]]:
    """(first bit, last bit + 1) of each block, about equally long."""
    n = radius + together
    return [(BITS * k // n, BITS * (k + 1) // n) for k in range(n)]


def _differ(a: str, b: str, first: int, last: int) -> Column:
    """Number of different bits of two bit strings of the same length, from ``first`` to ``last``."""
    halves = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")).bitwiseAND(F.lit(_mask(first - 64 * k, last - 64 * k))))
              for k in range(BITS // 64) if first < 64 * (k + 1) and last > 64 * k]
    return sum(halves[1:], halves[0])


def _mask(first: int, last: int) -> int:
    """A signed 64-bit number with bits first..last-1 set, counted from the highest."""
    bits = sum(1 << (63 - k) for k in range(max(first, 0), min(last, 64)))
    return bits - (1 << 64) if bits >> 63 else bits


def _words(prefix: str) -> list[Column]:
    """A hex fingerprint as 64-bit numbers."""
    return [F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long").alias(f"{prefix}{k}") for k in range(BITS // 64)]


def _in_tables(prints: DataFrame, prefix: str, blocks, tables) -> DataFrame:
    """Each fingerprint once per table, under the table's blocks."""
    def key(chosen):
        parts = [F.col(f"{prefix}{k}").bitwiseAND(F.lit(_mask(blocks[c][0] - 64 * k, blocks[c][1] - 64 * k)))
                 for c in chosen for k in range(BITS // 64) if blocks[c][0] < 64 * (k + 1) and blocks[c][1] > 64 * k]
        return F.xxhash64(*parts)
    entries = F.array(*(F.struct(F.lit(t).alias("table"), key(chosen).alias("key")) for t, chosen in enumerate(tables)))
    return prints.select("*", F.explode(entries).alias("_e")).select(*prints.columns, "_e.table", "_e.key")


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, together: int = TOGETHER) -> DataFrame:
    """(query, fingerprint, distance): for every distinct fingerprint of ``queries``, all distinct
    fingerprints of ``prints`` (both with a column ``fingerprint``) within ``radius`` bits."""
    blocks = _block_bits(radius, together)
    tables = list(combinations(range(len(blocks)), together))
    held = _in_tables(prints.select("fingerprint").distinct().select("fingerprint", *_words("a")), "a", blocks, tables)
    asked = _in_tables(queries.select("fingerprint").distinct().select(F.col("fingerprint").alias("query"), *_words("b")), "b", blocks, tables)
    # the first table both stand in: their first ``together`` equal blocks
    equal = F.filter(F.array(*(F.when(_differ("a", "b", *x) == 0, F.lit(k)) for k, x in enumerate(blocks))), lambda k: k.isNotNull())
    chosen = F.array(*(F.array(*map(F.lit, t)) for t in tables))
    first = F.slice(equal, 1, together) == F.get(chosen, F.col("table"))
    distance = _differ("a", "b", 0, BITS)
    return held.join(asked, ["table", "key"]).where((distance <= radius) & first).select("query", "fingerprint", distance.cast("int").alias("distance"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the likeness of both and of the next
    document; n_near, for documents whose id is divisible by 100, is the number of documents (itself
    included) within ``RADIUS`` bits, by the block tables over all documents."""
    rows = materialise(with_next(read_table(spark, sf_dir, "documents")), "fingerprints")
    asked = rows.where("doc_id % 100 = 0").select("fingerprint")
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = search(copies, asked).join(copies, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))
    one_in_100 = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = rows.where(one_in_100).join(near.withColumnRenamed("query", "fingerprint"), "fingerprint", "left").select(*_NAMES, "n_near")
    return found.unionByName(rows.where(~one_in_100).withColumn("n_near", F.lit(None).cast("long")))
