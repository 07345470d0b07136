"""Language identification with interpolated Kneser-Ney character models.

Per language, character n-grams up to ``ORDER`` are counted over the letter runs of all training
texts ("_word_", the context starts at the word's start mark). The highest order keeps raw
counts, lower orders continuation counts (raw ones for n-grams that begin with the start mark),
all as Spark aggregations; absolute discounts come from the numbers of n-grams seen once and
twice. The model is one table per order, (language, packed n-gram, own share, back-off weight),
12 bits a character, so characters that agree modulo 4096 share an entry. No n-gram is left out.

Scoring looks n-grams up in sorted arrays made of these tables, which are sent to the workers if
they have at most ``max_cells`` numbers. Larger models stay tables: the distinct letter runs of
the texts are cut into n-grams, distinct n-grams are joined with every order, and the sums go back
to runs and texts by salted joins. Both ways give the same bits.

A text's language is the one with the lowest cross-entropy in bits per character. Rejection is
calibrated on training rows the counts have not seen (``fit`` keeps one in ``CALIBRATION``): each
language's mean, the spread of a text's mean by its length, and the excess that one in
1 / ``ALPHA`` texts goes beyond. A text is accepted up to ``mean + z * sd / sqrt(characters) +
excess + MARGIN_BITS``. Without any calibration text nothing with a letter is rejected.

Defined results: a text that is null or has no letter is ``und`` with score 0 and not accepted;
without training rows every text is ``und``; ties go to the first language by code point;
repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import id_bucket, id_text, materialise, read_table
from .tokens import TokenMemo, code_points, held, slices, split_words, sum_rows, words_of

ORDER = 5
BITS = 12
MAX_CELLS = 16_000_000              # numbers of the arrays sent to workers: 128 MB and as much again for keys at most
CALIBRATION, ALPHA = 20, 0.001
MARGIN_BITS = 1.0                   # text that switches language half-way stays within; random letters do not
Z = 8.0
SALT = 16
HELD_MODULUS, HELD_REST = 4, 2      # fixed values of the contract
FLUSH_WORDS = 200_000
MEMO_WORDS = 100_000
AT_ONCE = 10_000                    # words or letter runs made into n-grams at a time
UND = "und"

LETTERS = regex.compile(r"\p{L}+")
COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("ord", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])


def _runs(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """Lower-cased letter runs of tokens, and the token each belongs to."""
    runs, owner = [], []
    for k, t in enumerate(tokens):
        found = LETTERS.findall(t.lower())
        runs += found
        owner += [k] * len(found)
    return runs, np.array(owner, np.int64)


def _packed(runs: list[str]):
    """For the predicted positions of " run run ... ": packed n-grams by order, the highest
    order there is (the context stops at the run's start mark) and the run number."""
    cp, word = code_points(runs)
    code = np.where(cp == 32, 32, (cp & ((1 << BITS) - 1)))
    n = len(code)
    is_space = cp == 32
    begin = np.maximum.accumulate(np.where(is_space, np.arange(n), 0))
    pos = np.arange(1, n)
    start = begin[pos - 1]                                 # last mark before the position
    top = np.minimum(pos - start + 1, ORDER)
    grams = {}
    g = code[pos]
    grams[1] = g
    for k in range(2, ORDER + 1):
        before = np.where(pos >= k - 1, code[np.maximum(pos - k + 1, 0)], 0)
        g = g | (before << (BITS * (k - 1)))
        grams[k] = g
    return grams, top, word[start]


def _count(words: Counter, lang: str, at_once: int = AT_ONCE):
    runs, owner = _runs(list(words))
    if not runs:
        return None
    weight = np.fromiter(words.values(), np.int64, len(words))[owner]
    found: dict[int, list] = {k: [] for k in range(2, ORDER + 1)}
    for a in range(0, len(runs), at_once):              # the n-grams of few runs stand in memory in all orders
        grams, top, run = _packed(runs[a:a + at_once])
        for k in found:
            at = np.flatnonzero(top == k)
            if len(at):
                found[k].append((grams[k][at], weight[a + run[at]]))
    orders, keys, counts = [], [], []
    for k in range(2, ORDER + 1):
        if found[k]:
            gram, times = (np.concatenate(x) for x in zip(*found.pop(k), strict=True))
            u, inv = np.unique(gram, return_inverse=True)
            orders.append(np.full(len(u), k, np.int32))
            keys.append(u)
            counts.append(np.bincount(inv, weights=times).astype(np.int64))
    keys = np.concatenate(keys)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.concatenate(orders)),
                                       pa.array(keys), pa.array(np.concatenate(counts))], schema=COUNT_SCHEMA)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, ord, gram, n): raw counts of the highest order at each position of every text."""
    def run(batches):
        held("counts", 0, lambda: None)
        seen: dict[str, Counter] = {}
        size = 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for first, part in slices(b.column(1)):
                lists, coded = split_words(part)
                # occurrences per (language, distinct word) of the slice
                names = sorted(set(langs[first:first + len(part)]))
                lang = np.repeat([names.index(x) for x in langs[first:first + len(part)]], lists)
                words = coded.dictionary.to_pylist()
                count = np.bincount(lang * len(words) + coded.indices.to_numpy(zero_copy_only=False), minlength=len(names) * len(words))
                for j, name in enumerate(names):
                    own = count[j * len(words):(j + 1) * len(words)]
                    into = seen.setdefault(name, Counter())
                    for k in np.flatnonzero(own).tolist():
                        into[words[k]] += int(own[k])
                size = sum(map(len, seen.values()))
                if size > FLUSH_WORDS:
                    for name in list(seen):
                        if (out := _count(seen.pop(name), name)) is not None:
                            yield out
        for name in list(seen):
            if (out := _count(seen.pop(name), name)) is not None:
                yield out
    raw = labelled.select("lang", "text").mapInArrow(run, "lang string, ord int, gram long, n long")
    return raw.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))


class Model:
    """The languages, the table of every order, the limits, and the sorted arrays if the model is
    small enough: per order the packed n-grams with probabilities per language, and the contexts
    with back-off weights per language."""

    def __init__(self, langs: list[str], tables: dict[int, DataFrame]):
        self.langs, self.tables = langs, tables
        self.in_arrays = False
        self.grams: dict[int, np.ndarray] = {}
        self.probs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        self.mean: list[float] = []
        self.sd, self.excess = 0.0, float("inf")

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}           # tables stay with the driver

    def load(self) -> None:
        """Fill the arrays from the tables."""
        number = F.create_map(*[x for j, lang in enumerate(self.langs) for x in (F.lit(lang), F.lit(j))])
        for k, table in sorted(self.tables.items()):
            rows = table.select(number[F.col("lang")].alias("j"), "gram", "own", "back").toArrow()
            j, gram, own, back = (rows.column(c).to_numpy() for c in range(4))
            self.grams[k], self.contexts[k] = np.unique(gram), np.unique(gram >> BITS)
            self.backoff[k] = np.ones((len(self.contexts[k]), len(self.langs)))
            self.backoff[k][np.searchsorted(self.contexts[k], gram >> BITS), j] = back
            seen = np.zeros((len(self.grams[k]), len(self.langs)))
            seen[np.searchsorted(self.grams[k], gram), j] = own
            lower = self.prob(self.grams[k] & ((1 << (BITS * (k - 1))) - 1), k - 1)
            self.probs[k] = seen + self.backoff[k][np.searchsorted(self.contexts[k], self.grams[k] >> BITS)] * lower
        self.in_arrays = True

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def prob(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Probabilities (n-grams x languages) of n-grams of one order, with back-off."""
        out = np.ones((len(grams), len(self.langs)))
        left = np.arange(len(grams))                    # n-grams not found at a higher order
        for k in range(order, 0, -1):
            if not len(left):
                return out
            g = grams[left] & ((1 << (BITS * k)) - 1)
            at, found = self._find(self.grams[k], g)
            out[left[found]] *= self.probs[k][at[found]]
            left, g = left[~found], g[~found]
            ctx, known = self._find(self.contexts[k], g >> BITS)
            out[left[known]] *= self.backoff[k][ctx[known]]
        out[left] /= 1 << BITS
        return out

    def bits(self, tokens: list[str]) -> np.ndarray:
        """Per token: bits under each language, and the number of predicted characters."""
        out = np.zeros((len(tokens), len(self.langs) + 1))
        runs, owner = _runs(tokens)
        if not runs:
            return out
        grams, top, run = _packed(runs)
        p = np.empty((len(top), len(self.langs)))
        for k in range(2, ORDER + 1):
            at = np.flatnonzero(top == k)
            if len(at):
                p[at] = self.prob(grams[k][at], k)
        bits = -np.log2(p)
        tok = owner[run]
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(tok, weights=bits[:, j], minlength=len(tokens))
        out[:, -1] = np.bincount(tok, minlength=len(tokens))
        return out


def train(labelled: DataFrame, calibration: DataFrame | None = None, order: int = ORDER, max_cells: int = MAX_CELLS) -> Model:
    """Count over all rows of ``labelled`` (lang, text); limits come from ``calibration`` (lang,
    text), or from the same rows."""
    raw = materialise(gram_counts(labelled), "lid-grams")
    keys = ["lang", "gram"]
    level = {order: raw.where(F.col("ord") == order).select(*keys, "n")}
    for k in range(order - 1, 0, -1):
        mask = (1 << (BITS * k)) - 1
        cont = level[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        if k > 1:
            start = F.shiftright("gram", BITS * (k - 1)) == 32
            cont = cont.where(~start).unionByName(raw.where(F.col("ord") == k).select(*keys, "n"))
        level[k] = materialise(cont, f"lid-{k}")
    stats = reduce(DataFrame.unionByName, [
        t.groupBy("lang").agg(F.lit(k).alias("ord"), F.count(F.lit(1)).alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"),
                              F.count(F.when(F.col("n") == 2, 1)).alias("n2")) for k, t in level.items()]).collect()   # one row per language and order
    langs = sorted({r["lang"] for r in stats})
    if not langs:
        return Model([], {})
    tables = {}
    for k, t in level.items():
        d = F.create_map(*[x for r in stats if r["ord"] == k for x in
                           (F.lit(r["lang"]), F.lit(r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5))])[F.col("lang")]
        context = Window.partitionBy("lang", F.shiftright("gram", BITS))           # at most 4096 rows each
        total, types = F.sum("n").over(context), F.count(F.lit(1)).over(context)
        own = t.select("lang", "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / total).alias("own"), (d * types / total).alias("back"))
        tables[k] = materialise(own, f"lid-own-{k}")
    model = Model(langs, tables)
    # n-grams and their contexts, a key and a number per language each
    if 2 * sum(r["types"] for r in stats) * (len(langs) + 1) <= max_cells:
        model.load()
    _calibrate(model, labelled if calibration is None else calibration)
    return model


def fit(labelled: DataFrame, **options) -> Model:
    """Train on all rows of (lang, text) but one in ``CALIBRATION``, by the text's hash, which sets the limits."""
    apart = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(CALIBRATION)) == 0
    return train(labelled.where(~apart), labelled.where(apart), **options)


def _salted(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join whose small side stands ``SALT`` times, so a hot key of the big side is spread."""
    one = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALT)).cast("int")).join(one, [*keys, "salt"]).drop("salt")


def _run_counts(batches):
    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            runs = Counter(_runs(words_of(text))[0])
            if runs:
                yield pa.RecordBatch.from_pydict({"row": [row] * len(runs), "run": list(runs), "times": list(runs.values())}, schema=RUN_SCHEMA)


def _run_grams(batches):
    for b in batches:
        runs = b.column(0).to_pylist()
        if runs:
            grams, top, run = _packed(runs)
            gram = np.choose(top - 1, [grams[k] for k in range(1, ORDER + 1)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(run)), pa.array(top.astype(np.int32)), pa.array(gram)], schema=GRAM_SCHEMA)


RUN_SCHEMA = pa.schema([("row", pa.int64()), ("run", pa.string()), ("times", pa.int64())])
GRAM_SCHEMA = pa.schema([("run", pa.string()), ("ord", pa.int32()), ("gram", pa.int64())])


def _joined_totals(texts: DataFrame, model: Model) -> DataFrame:
    """(row, n, bits per language) of (row, text) by joins with the model's tables."""
    runs = materialise(texts.mapInArrow(_run_counts, "row long, run string, times long"), "lid-runs")
    cut = materialise(runs.select("run").distinct().mapInArrow(_run_grams, "run string, ord int, gram long")
                      .groupBy("run", "ord", "gram").agg(F.count(F.lit(1)).alias("m")), "lid-run-grams")
    p = (cut.select("ord", "gram").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, model.langs))))
         .withColumn("p", F.lit(1.0 / (1 << BITS))))
    for k, table in sorted(model.tables.items()):
        own = table.select("lang", F.col("gram").alias("suffix"), "own")
        back = table.select("lang", F.shiftright("gram", BITS).alias("context"), "back").distinct()
        suffix = F.when(F.col("ord") >= k, F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1)))
        p = (p.withColumn("suffix", suffix).withColumn("context", F.shiftright("suffix", BITS))
             .join(own, ["lang", "suffix"], "left").join(back, ["lang", "context"], "left")
             .select("ord", "gram", "lang", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p")))
    of_gram = materialise(p.select("ord", "gram", "lang", (-F.log2("p")).alias("bits")), "lid-gram-bits")
    of_run = _salted(cut, of_gram, ["ord", "gram"]).groupBy("run", "lang").agg(F.sum(F.col("bits") * F.col("m")).alias("bits"), F.sum("m").alias("n"))
    of_row = (_salted(runs, materialise(of_run, "lid-run-bits"), ["run"]).groupBy("row", "lang")
              .agg(F.sum(F.col("bits") * F.col("times")).alias("bits"), F.sum(F.col("n") * F.col("times")).alias("n")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lang", "bits"))), lambda x: x["bits"])      # one entry per language
    return of_row.groupBy("row").agg(F.max("n").alias("n"), listed.alias("bits"))


def _totals(df: DataFrame, model: Model, n: str, bits: str) -> DataFrame:
    """``df`` (with a column text) and two more columns: predicted characters and bits by language."""
    if model.in_arrays:
        shared = df.sparkSession.sparkContext.broadcast(model)
        at, names = df.columns.index("text"), [*df.columns, n, bits]
        schema = StructType([*df.schema.fields, StructField(n, LongType()), StructField(bits, ArrayType(DoubleType()))])

        def run(batches):
            for b in batches:
                m = shared.value
                memo = held("language", id(m), lambda m=m: TokenMemo(m.bits, MEMO_WORDS, AT_ONCE))           # it holds the model
                total = sum_rows(memo, b.column(at).cast(pa.string()))
                width = len(m.langs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * width, pa.int32()), pa.array(total[:, :-1].ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.rint(total[:, -1]).astype(np.int64)), lists], names=names)
        return df.mapInArrow(run, schema)
    if not model.langs:
        return df.withColumn(n, F.lit(0).cast("long")).withColumn(bits, F.array().cast("array<double>"))
    row = free_name(df, "_row")
    kept = materialise(df.withColumn(row, F.monotonically_increasing_id()), "lid-rows")
    sums = _joined_totals(kept.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), model)
    sums = sums.select(F.col("row").alias(row), F.col("n").alias(n), F.col("bits").alias(bits))
    return kept.join(sums, row, "left").drop(row).withColumn(n, F.coalesce(n, F.lit(0)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _quantile(values: DataFrame, share: float) -> float | None:
    """Upper edge of the first bucket that reaches ``share`` of all rows of (bucket); exact counts."""
    rows = sorted((r["bucket"], r["count"]) for r in values.groupBy("bucket").count().collect())      # some thousand buckets
    total, upto = sum(c for _, c in rows), 0
    for bucket, c in rows:
        upto += c
        if upto >= share * total:
            return bucket + 1
    return None


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Means, spread and excess over the texts of ``rows`` (lang, text) that get their own language."""
    scored = _totals(rows.select("lang", "text"), model, "n", "bits").where("n > 0")
    best = F.array_min("bits")
    right = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("bits", best).cast("int")) == F.col("lang")
    t = materialise(scored.where(right).select("lang", "n", best.alias("bits")), "lid-calibration")
    sums = {r["lang"]: (r["b"], r["n"]) for r in t.groupBy("lang").agg(F.sum("bits").alias("b"), F.sum("n").alias("n")).collect()}
    if not sums:
        model.mean = [0.0] * len(model.langs)
        return
    whole = sum(b for b, _ in sums.values()) / sum(n for _, n in sums.values())
    model.mean = [sums[x][0] / sums[x][1] if x in sums else whole for x in model.langs]
    mean = F.create_map(*[x for lang, m in zip(model.langs, model.mean, strict=True) for x in (F.lit(lang), F.lit(m))])[F.col("lang")]
    off, root = F.col("bits") / F.col("n") - mean, F.sqrt("n")
    # the median of |off| * sqrt(n), in buckets of two per cent, is 0.6745 sd of a normal spread
    middle = _quantile(t.select(F.floor(F.log2(F.abs(off) * root + 1e-6) * 32).alias("bucket")), 0.5)
    model.sd = 2 ** (middle / 32) / 0.6745
    model.excess = max(0.0, _quantile(t.select(F.floor((off - Z * model.sd / root) * 100).alias("bucket")), 1 - ALPHA) / 100)


def _judged(df: DataFrame, model: Model, margin: float) -> tuple[DataFrame, dict]:
    """``df`` with its totals, and the verdict's expressions."""
    n, bits = free_name(df, "_n"), free_name(df, "_bits")
    out = _totals(df, model, n, bits)
    best = F.array_min(bits)
    at = F.array_position(bits, best).cast("int")
    some = F.col(n) > 0
    chars = F.least(F.col(n), F.lit(64)) / F.col(n)
    odds = F.aggregate(bits, F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), (best - b) * chars))
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at)
    limit = of(model.mean, "double") + F.lit(Z * model.sd) / F.sqrt(n) + F.lit(model.excess + margin)
    return out, {"lang_pred": F.when(some, of(model.langs, "string")).otherwise(UND), "score": F.when(some, 1.0 / odds).otherwise(0.0),
                 "accepted": F.when(some, best / F.col(n) <= limit).otherwise(False), "bits_per_char": F.when(some, best / F.col(n))}


def predict(docs: DataFrame, model: Model, margin: float = MARGIN_BITS) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text): one pass without a shuffle if the model is in arrays."""
    out, verdict = _judged(id_text(docs), model, margin)
    return out.select("doc_id", *[c.alias(name) for name, c in verdict.items()])


def keep_accepted(docs: DataFrame, model: Model, margin: float = MARGIN_BITS) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns."""
    out, verdict = _judged(docs, model, margin)
    return out.where(verdict["accepted"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def training_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of the rows the contract allows to learn from (a null id is never held out)."""
    held = F.coalesce(id_bucket("doc_id", HELD_MODULUS) == HELD_REST, F.lit(False))
    return (docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, fit(training_rows(docs)))
    held = F.coalesce(id_bucket("doc_id", HELD_MODULUS) == HELD_REST, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted", "bits_per_char")
