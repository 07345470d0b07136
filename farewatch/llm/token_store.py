"""Token ids in binary blocks, compressed by a Re-Pair grammar.

Texts are encoded with a ready tokenizer (never trained here), every document gets an end id, and
the documents, in ascending doc_id order, are cut into blocks of whole documents of about
``block_tokens`` ids. In each block frequent pairs of neighbouring symbols are replaced by new
symbols, round after round until none occurs ``MIN_COUNT`` times (the most frequent pairs of a round first, left to right where
occurrences overlap; a pair never spans two documents). Stored are the rules, the length each
symbol expands to, and the remaining sequence, so a document, or a span of one, decodes alone.

File format: a Parquet table with one row per block:
``part, block`` (place in the order), ``local_start`` (ids before the block in its part),
``n_tokens``, ``terminals`` (symbols below it are ids), ``width`` (bytes per symbol, little-endian),
``rules`` (left and right symbol of symbol terminals + k, pairs in turn), ``lengths`` (uint32
expansion length per rule), ``sequence`` (symbols of all documents), and per document ``doc_ids``,
``doc_tokens`` (ids) and ``doc_symbols`` (symbols).

Texts are range-partitioned by doc_id (and a hash of the text, so one id with very many rows
spreads too) and sorted; blocks never grow with the data. The position of a part's first id comes
from one count per part.

Defined results: null is the empty text and gives just the end id; repeated rows are separate
documents, in hash order; null doc_ids come first; an empty table gives no blocks; special tokens
inside a text are encoded as the tokenizer does; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch_path
from .tokens import held

END_ID = 1                   # fixed value of the contract
BLOCK_TOKENS = 1 << 18
PAIRS_PER_ROUND = 2000
MIN_COUNT = 12               # a rule pays from a few uses on
MEMO_WORDS = 400_000
ENCODE_CHARS = 4_000_000     # texts encoded at a time
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ---------------------------------------------------------------- grammar of one block

def compress(ids: np.ndarray, last: np.ndarray, terminals: int, rounds: int | None = None, per_round: int = PAIRS_PER_ROUND,
             min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one id sequence, until no pair occurs ``min_count`` times (or for ``rounds``
    rounds); ``last`` marks each document's last id.

    A pair's count only falls while its symbols stay, so a round counts just the places that were
    frequent before or stand next to a replaced pair.

    Returns (sequence, rules as rows (left, right), last marks of the sequence)."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    top = terminals
    live = np.flatnonzero(~last[:-1])           # places whose pair may be frequent
    done = 0
    while len(live) and (rounds is None or done < rounds):
        done += 1
        # 32-bit keys sort fastest; symbols beyond 16 bits take 64
        bits, kind = (16, np.uint32) if top <= 1 << 16 else (32, np.uint64)
        key = (seq[live].astype(kind) << kind(bits)) | seq[live + 1].astype(kind)
        s = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.append(edge, len(s)))
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        # places are found through tables of 2^16 slots: of chosen pairs that share a slot one is
        # replaced now, the others in a later round
        mult, shift = (kind(0x9E3779B1), kind(16)) if kind is np.uint32 else (kind(0x9E3779B97F4A7C15), kind(48))
        slot = (key * mult) >> shift
        frequent = np.zeros(1 << 16, bool)
        frequent[(s[edge[often]] * mult) >> shift] = True
        if len(often) > per_round:
            often = often[np.argsort(-count[often], kind="stable")[:per_round]]
        chosen = np.sort(s[edge[often]])
        table = np.zeros(1 << 16, np.int16 if len(chosen) < 1 << 15 else np.int64)
        table[(chosen * mult) >> shift] = np.arange(len(chosen))
        which = table[slot]
        hit = np.flatnonzero(chosen[which] == key)
        at, which = live[hit], which[hit].astype(np.int64)
        left, right = (chosen >> kind(bits)).astype(np.int64), (chosen & kind((1 << bits) - 1)).astype(np.int64)
        # overlapping occurrences: every second one of a run, from the left
        new_run = np.concatenate([[True], np.diff(at) != 1])
        order = np.arange(len(at))
        take = (order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0
        at, which = at[take], which[take]
        uses = np.bincount(which, minlength=len(chosen))
        used = np.flatnonzero(uses >= 2)
        if not len(used):
            break
        number = np.full(len(chosen), -1, np.int64)
        number[used] = top + np.arange(len(used))
        at, which = at[number[which] >= 0], which[number[which] >= 0]
        rules.append(np.stack([left[used], right[used]], axis=1))
        seq = seq.copy()
        seq[at] = number[which]
        last = last.copy()
        last[at] = last[at + 1]
        again = np.zeros(len(seq), bool)
        again[live[frequent[slot]]] = True
        again[at] = True
        again[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        live = np.flatnonzero(again[keep][:-1] & ~last[:-1])
        top += len(used)
    return seq.astype(np.int64), (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), last


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule's symbol stands for."""
    out = np.ones(terminals + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[terminals + k] = out[a] + out[b]
    return out[terminals:]


def expansions(rules: np.ndarray, lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all symbols end to end, start of each symbol, length of each symbol)."""
    size = np.concatenate([np.ones(terminals, np.int64), lengths.astype(np.int64)])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:terminals] = np.arange(terminals)
    for k, (a, b) in enumerate(rules.tolist()):          # a rule refers to earlier symbols only
        at = start[terminals + k]
        flat[at:at + size[a]] = flat[start[a]:start[a] + size[a]]
        flat[at + size[a]:at + size[a] + size[b]] = flat[start[b]:start[b] + size[b]]
    return flat, start, size


def decode(sequence: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = size[sequence]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start[sequence] - (end - n), n) + np.arange(total)]


class Block:
    """One stored block: random access to documents and to spans of them."""

    def __init__(self, row: dict):
        kind = {2: "<u2", 4: "<u4"}[row["width"]]
        self.terminals = row["terminals"]
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4")
        self.sequence = np.frombuffer(row["sequence"], kind).astype(np.int64)
        self.doc_tokens = np.asarray(row["doc_tokens"], np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.asarray(row["doc_symbols"], np.int64))])
        self.tables = expansions(self.rules, self.lengths, self.terminals)

    def all_ids(self) -> np.ndarray:
        return decode(self.sequence, *self.tables)

    def document(self, k: int) -> np.ndarray:
        return decode(self.sequence[self.at[k]:self.at[k + 1]], *self.tables)

    def span(self, k: int, first: int, end: int) -> np.ndarray:
        """Ids [first, end) of document k, expanding only the symbols that hold them."""
        part = self.sequence[self.at[k]:self.at[k + 1]]
        stop = np.cumsum(self.tables[2][part])
        a, b = np.searchsorted(stop, first, "right"), np.searchsorted(stop, end, "left") + 1
        before = int(stop[a - 1]) if a else 0
        return decode(part[a:b], *self.tables)[first - before:end - before]


# ---------------------------------------------------------------- writing and reading


# fixed value: the pre-tokenizer of the word tokenizer whose pieces the short cuts rely on
LETTER_RUNS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

def _byte_alphabet() -> dict:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_ALPHABET = _byte_alphabet()

# words that are one run of Latin letters and then punctuation other than the apostrophe: the
# tokenizer lower-cases them and cuts them in just these two pieces
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Encoder:
    """Whole texts to ids. Words between ASCII white space encode independently in this
    tokenizer, so the words of a batch are made distinct first (Arrow's dictionary), each new
    one is encoded once, and the texts' ids are gathered. The memo of words is bounded:
    when ``memo_words`` are known they are forgotten, with their pieces if these are as many."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.memo_words = memo_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.terminals < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        # the short cuts hold for a tokenizer that lower-cases and cuts letter runs from
        # punctuation; any other one encodes every distinct word in full
        self.pieces: dict[str, bytes] = {}
        self.simple = json.loads(self.tokenizer.to_str())["pre_tokenizer"] == LETTER_RUNS
        self._reset()

    def _reset(self):
        """Forget the words; their pieces, which are fewer, stay until they fill the memo too."""
        self.words: dict[str, int] = {}
        if len(self.pieces) > self.memo_words:
            self.pieces = {}
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes per text."""
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Id bytes of lower-case Latin letter runs: they need neither normalising nor cutting and
        go straight to the tokenizer's model, in the byte alphabet its last pre-tokenizer makes."""
        tokenize, code = self.tokenizer.model.tokenize, self.code
        return [array(code, [x.id for x in tokenize(r if r.isascii() else r.encode().decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
                for r in runs]

    def _learn(self, new: list[str]) -> None:
        pieces, cut, runs, rest = self.pieces, [], {}, {}
        pieces[""] = b""
        for w in new:
            a = w.rstrip(_PUNCTUATION)
            if self.simple and (a.isalpha() and a.isascii() or _LATIN.fullmatch(a)):
                b = w[len(a):]
                a = a.lower()
                if a not in pieces:
                    runs[a] = None
            else:
                a, b = w, ""
                if a not in pieces:
                    rest[a] = None
            if b and b not in pieces:
                rest[b] = None
            cut.append((a, b))
        pieces.update(zip(runs, self._encode_runs(list(runs)), strict=True))
        pieces.update(zip(rest, self._encode(list(rest)), strict=True))
        got = [pieces[a] + pieces[b] if b else pieces[a] for a, b in cut]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        data = np.frombuffer(b"".join(got), self.kind)
        n, first = len(self.words), self.used
        if first + len(data) > len(self.flat):
            self.flat = np.concatenate([self.flat[:first], np.zeros(first + 2 * len(data), self.kind)])
        if n + len(new) > len(self.start):
            room = np.zeros(n + 2 * len(new), np.int32)
            self.start, self.size = np.concatenate([self.start[:n], room]), np.concatenate([self.size[:n], room])
        self.flat[first:first + len(data)] = data
        self.used += len(data)
        self.size[n:n + len(new)] = sizes
        self.start[n:n + len(new)] = first + np.cumsum(sizes) - sizes
        self.words.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = lists.value_lengths().to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) + len(distinct) > self.memo_words:
            self._reset()
        place = np.fromiter(map(self.words.get, distinct, repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            self._learn([distinct[k] for k in new.tolist()])
        word = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        n = self.size[word]
        end = np.cumsum(n, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        at = np.arange(total)
        at += np.repeat(self.start[word] - (end - n), n)
        ids = self.flat[at]
        upto = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(upto)


def encoder(path: str, memo_words: int = MEMO_WORDS) -> Encoder:
    """One encoder, with its memo, per worker process."""
    return held("encoder", (path, memo_words), lambda: Encoder(path, memo_words))


BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
    ("terminals", pa.int32()), ("width", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()),
    ("sequence", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("doc_symbols", pa.list_(pa.int64()))])
BLOCK_DDL = ("part int, block int, local_start long, n_tokens long, terminals int, width int, rules binary, lengths binary, "
             "sequence binary, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>")


def make_block(doc_ids: list, chunks: list[np.ndarray], kind: np.dtype, terminals: int) -> dict:
    """Columns of one block row from the documents' ids (end ids included)."""
    ids = np.concatenate(chunks)
    n = np.array([len(c) for c in chunks], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n) - 1] = True
    seq, rules, last = compress(ids, last, terminals)
    width = 2 if terminals + len(rules) < 1 << 16 else 4
    out_kind = "<u2" if width == 2 else "<u4"
    return {"n_tokens": len(ids), "terminals": terminals, "width": width, "rules": rules.astype(out_kind).tobytes(),
            "lengths": expansion_lengths(rules, terminals).astype("<u4").tobytes(), "sequence": seq.astype(out_kind).tobytes(),
            "doc_ids": doc_ids, "doc_tokens": n.tolist(),
            "doc_symbols": np.diff(np.concatenate([[0], np.flatnonzero(last) + 1])).tolist()}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 block_tokens: int = BLOCK_TOKENS, memo_words: int = MEMO_WORDS, encode_chars: int = ENCODE_CHARS) -> str:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``; smaller memos, and fewer
    characters encoded at a time, take less memory and more time, the ids are the same."""
    tokenizer = tokenizer or tokenizer_path()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = d.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, memo_words)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        chunks: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, chunks, held, block, start
            row = {"part": part, "block": block, "local_start": start, **make_block(ids, chunks, enc.kind, enc.terminals)}
            block, start = block + 1, start + row["n_tokens"]
            ids, chunks, held = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)
        for b in batches:
            doc_ids, sizes = b.column(0).to_pylist(), pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // encode_chars)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                flat, n = enc(b.column(1).slice(a, e - a))
                at = 0
                for doc_id, k in zip(doc_ids[a:e], n.tolist(), strict=True):
                    ids.append(doc_id)
                    chunks.append(np.append(flat[at:at + k], np.array(end_id, enc.kind)))
                    at += k
                    held += k + 1
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()
    ordered.mapInArrow(run, BLOCK_DDL).write.parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: ids of all blocks before them."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))       # one row per write task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("part", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    # broadcast: two numbers per task of the write, which the scheduler itself holds in the driver
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_symbols) of every stored document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        ("n_symbols", pa.int64())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):                       # one block at a time
                row = {n: b.column(j)[k].as_py() for j, n in enumerate(b.schema.names)}
                block = Block(row)
                ids = memoryview(block.all_ids().astype("<u4", copy=False)).cast("B")
                end = np.cumsum(block.doc_tokens)
                crc = [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(end.tolist(), block.doc_tokens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + end - block.doc_tokens),
                     pa.array(block.doc_tokens), pa.array(crc, pa.int64()), pa.array(np.diff(block.at))], schema=schema)
    return read_blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(read_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return read_documents(spark, path)
