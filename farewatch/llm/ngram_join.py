"""Jaccard join on word 5-shingles with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles (fewer words: the whole sequence is one).
Two documents link when 100 * |intersection| >= 80 * |union|; the result is each document's
connected component.

Prefixes. Order the shingles by document frequency, rarest first. With c = ceil(0.8 n), the
l-prefix of a set of n is its first n - c + l shingles, and two sets that link share at least l
shingles of their l-prefixes, for every l. Each document takes the l with the lowest estimated
cost (posting entries to scan, plus candidates to verify, about entries / l), so documents of
frequent shingles get longer prefixes and need more shared ones; a pair is verified when the two
prefixes share min(l, l') shingles or more. Document frequencies are exact, over all documents.

Spark's part:
1. Shingles are hashed in batches of documents. A batch sends every distinct shingle once to the
   bucket of its hash (one entry and a count, however many of its documents hold it), which sums
   the frequencies and returns those of 2 and more. A document with more than n - c shingles of
   its own has no partner and is done.
2. Equal sets become one node. Documents that share a shingle of their 1-prefixes fall into one
   block (connected components), outside of which no links exist.
3. Blocks are joined inside tasks: candidates through the posting lists, verified exactly unless
   both are connected already. Blocks of more than ``block_docs`` nodes are split: a few pivots
   link most of the nodes; what stays outside the largest component so found (the rest) is compared
   with all nodes, rest and nodes cut into pieces of ``block_docs``. No pair of the rest is skipped
   and none of two connected nodes is needed.
4. Components of all found links.

Defined results: null, empty and white-space texts have no shingles, n_shingles 0, and are linked
with nothing; repeated rows get the same component; a row with a null doc_id gets its set's
component (null if no row with an id links to it); an empty table gives an empty table; other
columns are ignored. Input must give the same rows again when a lost task re-reads it, as tables do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialise, read_table
from .graph import components
from .tokens import held, mix64, slices, split_words, word_hashes

SHINGLE = 5                 # fixed values of the contract
PERCENT = 80
FLUSH_SHINGLES = 600_000    # shingles per batch of documents; about 100 bytes each in a worker
FLUSH_DOCS = 60_000         # numbered with 16 bits inside a batch
LOW_BITS = 48
MAX_LEVEL = 8
BLOCK_DOCS = 2000
PIVOTS = 16

_MULT = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ shingles of a batch

def shingle_sets(texts: pa.Array, n_words: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes per text."""
    per_text, coded = split_words(pc.ascii_lower(texts))
    distinct = coded.dictionary.to_pylist()
    none = np.zeros(0, np.uint64)
    if not distinct:
        return [none] * len(texts)
    index = coded.indices.to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(per_text)])
    if "" in distinct:
        real = index != distinct.index("")
        upto = np.concatenate([[0], np.cumsum(real)])[upto]
        index = index[real]
        distinct[distinct.index("")] = "x"                 # no word of a text any more
    word = word_hashes(distinct)[index]
    m = len(word) - n_words + 1
    h = np.zeros(max(m, 0), np.uint64)
    for j in range(n_words):
        h = (h ^ word[j:j + m]) * _MULT if m > 0 else h
        h ^= h >> np.uint64(29)
    h = mix64(h)
    out = []
    for a, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if e - a >= n_words:
            out.append(np.unique(h[a:e - n_words + 1]))
        elif e > a:
            v = np.array([e - a], np.uint64)
            for k in range(a, e):
                v = (v ^ word[k:k + 1]) * _MULT
                v ^= v >> np.uint64(31)
            out.append(mix64(v))
        else:
            out.append(none)
    return out


def _six(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").ravel().astype(np.uint64)


ROW = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("parts", pa.list_(pa.binary()))])
ROW_DDL = "key long, uid long, parts array<binary>"


def _rows(rows: list) -> pa.RecordBatch:
    key, uid, parts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(uid, pa.int64()), pa.array(parts, pa.list_(pa.binary()))], schema=ROW)


def _batch_rows(uid: int, ids: list, sets: list, bits: int) -> list:
    """Bucket rows and the document row of one batch of documents."""
    n = np.array([len(s) for s in sets], np.int64)
    full = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    edge = np.cumsum(n) - n
    some = np.flatnonzero(n)
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        d1[some] = np.add.reduceat(mix64(full), edge[some])
        d2[some] = np.add.reduceat(mix64(full ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edge[some])
    token = full >> np.uint64(64 - LOW_BITS - bits)
    doc = np.repeat(np.arange(len(n)), n).astype(np.uint16)
    order = np.argsort(token)
    token, doc = token[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(token)))
    single, multi = start[count == 1], start[count > 1]
    many = count[count > 1]
    in_multi = np.repeat(count > 1, count)
    rows = []
    step = 1 << LOW_BITS
    cut = np.arange((1 << bits) + 1, dtype=object) * step
    cut = np.array([int(x) for x in cut], np.uint64) if bits + LOW_BITS < 64 else cut
    s_at, m_at = np.searchsorted(token[single], cut), np.searchsorted(token[multi], cut)
    low = np.uint64(step - 1)
    for b in range(1 << bits):
        s, m = single[s_at[b]:s_at[b + 1]], multi[m_at[b]:m_at[b + 1]]
        if len(s) or len(m):
            rows.append((b, uid, [_six(token[s] & low), doc[s].tobytes(), _six(token[m] & low),
                                  many[m_at[b]:m_at[b + 1]].astype("<u4").tobytes()]))
    id_array = np.array([i if i is not None else 0 for i in ids], np.int64)
    null = np.array([i is None for i in ids], bool)
    rows.append(((1 << bits) + ((uid >> 24) + (uid & 0xFFFFFF)) % (1 << bits), uid, [id_array.tobytes(), null.tobytes(), n.tobytes(), d1.tobytes(), d2.tobytes(),
                 token[multi].astype("<u8").tobytes(), many.astype("<u4").tobytes(), doc[in_multi].tobytes()]))
    return rows


# ------------------------------------------------------------------ frequencies

def _frequencies(buckets: dict) -> list:
    """Buckets' sums: per bucket and batch the frequencies of 2 and more."""
    out = []
    for key, rows in buckets.items():
        singles, multis = [_unsix(p[0]) for _, p in rows], [_unsix(p[2]) for _, p in rows]
        token = np.concatenate(singles + multis)
        weight = np.concatenate([np.ones(sum(map(len, singles)), np.int64), *[np.frombuffer(p[3], "<u4").astype(np.int64) for _, p in rows]])
        order = np.argsort(token)
        t = token[order]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total = np.add.reduceat(weight[order], start)
        df = np.empty(len(token), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(start, len(t))))
        a, m = 0, sum(map(len, singles))
        for (uid, p), s, mm in zip(rows, singles, multis, strict=True):
            own = df[a:a + len(s)]
            keep = own > 1
            dm = df[m:m + len(mm)]
            a, m = a + len(s), m + len(mm)
            if keep.any() or len(mm):
                out.append((key, uid, [_six(s[keep]), np.frombuffer(p[1], np.uint16)[keep].tobytes(),
                                       np.minimum(own[keep], 2**32 - 1).astype("<u4").tobytes(),
                                       np.minimum(dm, 2**32 - 1).astype("<u4").tobytes()]))
    return out


DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("level", pa.int32()),
                 ("own", pa.int32()), ("tokens", pa.list_(pa.int64()))])
DOC_DDL = "doc_id long, n int, d1 long, d2 long, level int, own int, tokens array<long>"


def needed(n):
    """Shingles of a set of n that any linked set shares at least: ceil(0.8 n)."""
    return -(-PERCENT * n // 100)


def _documents(rows: list, bits: int) -> pa.RecordBatch:
    """One batch's documents: shared shingles, rarest first, and the level of the prefix."""
    doc_row = next(p for key, p in rows if key >= 1 << bits)
    back = sorted(((key, p) for key, p in rows if key < 1 << bits), key=lambda x: x[0])
    ids, null = np.frombuffer(doc_row[0], np.int64), np.frombuffer(doc_row[1], bool)
    n = np.frombuffer(doc_row[2], np.int64)
    multi, many = np.frombuffer(doc_row[5], "<u8").astype(np.uint64), np.frombuffer(doc_row[6], "<u4").astype(np.int64)
    dm = np.concatenate([np.frombuffer(p[3], "<u4") for _, p in back] or [np.zeros(0, np.uint32)]).astype(np.int64)
    token = np.concatenate([_unsix(p[0]) | np.uint64(key << LOW_BITS) for key, p in back] + [np.repeat(multi, many)])
    doc = np.concatenate([np.frombuffer(p[1], np.uint16) for _, p in back] + [np.frombuffer(doc_row[7], np.uint16)]).astype(np.int64)
    df = np.concatenate([np.frombuffer(p[2], "<u4") for _, p in back] + [np.repeat(dm, many)]).astype(np.int64)
    order = np.lexsort((token, df, doc))
    token, doc, df = token[order], doc[order], df[order]
    shared = np.bincount(doc, minlength=len(n))
    end = np.cumsum(shared)
    start = end - shared
    own = np.maximum(n - shared, 0)                        # shingles of this document alone come first
    spare = n - needed(n)
    scan = np.concatenate([[0], np.cumsum(df - 1)])
    best, level = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, MAX_LEVEL + 1):
        upto = np.clip(spare + k - own, 0, shared)
        entries = scan[start + upto] - scan[start]
        cost = np.where(needed(n) >= k, entries * (1.0 + n / k), np.inf)
        better = cost < best
        best, level = np.where(better, cost, best), np.where(better, k, level)
    candidate = (own <= spare) & (n > 0) & (shared > 0)
    pieces = np.split(token.view(np.int64) if token.dtype == np.uint64 else token.astype(np.int64), start[1:]) if len(n) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=null), pa.array(n.astype(np.int32)), pa.array(np.frombuffer(doc_row[3], np.int64)),
         pa.array(np.frombuffer(doc_row[4], np.int64)), pa.array(level.astype(np.int32)), pa.array(own.astype(np.int32)),
         pa.array([p if c else None for p, c in zip(pieces, candidate, strict=True)], pa.list_(pa.int64()))], schema=DOC)


def shingled(docs: DataFrame) -> DataFrame:
    """Every row's set size, digest and, where a partner is possible, its shared shingles."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bits = min(max((4 * parts - 1).bit_length(), 6), 15)       # a few buckets per partition even them out

    def shingle(batches):
        held("join", 0, lambda: None)
        part, flush, ids, sets, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, piece in slices(b.column(1)):
                found = shingle_sets(piece)
                for k, s in enumerate(found):
                    ids.append(doc_ids[first + k])
                    sets.append(s)
                    size += len(s)
                    if size >= FLUSH_SHINGLES or len(ids) >= FLUSH_DOCS:
                        yield _rows(_batch_rows(part << 24 | flush, ids, sets, bits))
                        flush, ids, sets, size = flush + 1, [], [], 0
        if ids:
            yield _rows(_batch_rows(part << 24 | flush, ids, sets, bits))

    def count(batches):
        buckets: dict = {}
        for b in batches:
            for key, uid, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key >= 1 << bits:
                    yield _rows([(key, uid, p)])
                else:
                    buckets.setdefault(key, []).append((uid, p))
        for key in list(buckets):
            if rows := _frequencies({key: buckets.pop(key)}):
                yield _rows(rows)

    def assemble(batches):
        parts: dict = {}
        for b in batches:
            for key, uid, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(uid, []).append((key, p))
        for uid in list(parts):
            yield _documents(parts.pop(uid), bits)

    sent = id_text(docs).mapInArrow(shingle, ROW_DDL).repartition("key")
    counted = sent.mapInArrow(count, ROW_DDL).repartition("uid")
    return materialise(counted.mapInArrow(assemble, DOC_DDL), "join-docs")


# ------------------------------------------------------------------ joining a block

def link(n: np.ndarray, own: np.ndarray, level: np.ndarray, tokens: list, label: np.ndarray, query: np.ndarray) -> list:
    """Links (i, j) that connect the labels as far as the queries' links do: every query against
    all nodes. Pairs with one label are connected already and skipped."""
    label = label.copy()
    size = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    doc = np.repeat(np.arange(len(n)), size)
    _, flat = np.unique(flat, return_inverse=True)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    prefix = np.clip(n - needed(n) + level - own, 0, size)
    in_prefix = pos < np.repeat(prefix, size)

    def postings(mask):
        f, d = flat[mask], doc[mask]
        o = np.argsort(f, kind="stable")
        return d[o], np.concatenate([[0], np.cumsum(np.bincount(f, minlength=int(flat.max()) + 1))])
    p_doc, p_at = postings(in_prefix)
    a_doc, a_at = postings(np.ones(len(flat), bool))
    at = np.concatenate([[0], np.cumsum(size)])

    def gather(docs, starts, wanted):
        return np.concatenate([docs[starts[t]:starts[t + 1]] for t in wanted]) if len(wanted) else docs[:0]
    links = []
    for i in np.flatnonzero(query).tolist():
        hits = np.bincount(gather(p_doc, p_at, flat[at[i]:at[i] + prefix[i]]), minlength=len(n))
        ok = (hits >= np.minimum(level, level[i])) & (hits > 0) & (label != label[i])
        ok &= (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
        cand = np.flatnonzero(ok)
        if not len(cand):
            continue
        common = np.bincount(gather(a_doc, a_at, flat[at[i]:at[i + 1]]), minlength=len(n))[cand]
        good = cand[100 * common >= PERCENT * (n[i] + n[cand] - common)]
        for j in good.tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


NODE_COLUMNS = ["node", "n", "own", "level", "tokens"]


def _link_tasks(rows: DataFrame) -> DataFrame:
    """rows (task, node, n, own, level, tokens, label, query), clustered by task: links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        tasks: dict = {}
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            task = cols["task"].to_pylist()
            tokens = cols["tokens"].to_pandas() if b.num_rows else []
            rest = [cols[c].to_pylist() for c in ("node", "n", "own", "level", "label", "query")]
            for k, t in enumerate(task):
                tasks.setdefault(t, {}).setdefault(rest[0][k], (*(r[k] for r in rest), np.asarray(tokens[k], np.int64)))
        for t in list(tasks):
            nodes = sorted(tasks.pop(t).values(), key=lambda r: (r[1], r[0]))
            if len(nodes) < 2:
                continue
            node, n, own, level, label, query, tokens = zip(*nodes, strict=True)
            _, lab = np.unique(np.array(label, np.int64), return_inverse=True)
            found = link(np.array(n, np.int64), np.array(own, np.int64), np.array(level, np.int64), list(tokens), lab, np.array(query, bool))
            if found:                       # as stars around the smallest node
                root: dict = {}
                for i, j in found:
                    a, b = root.get(node[i], {node[i]}), root.get(node[j], {node[j]})
                    if a is not b:
                        a = a | b
                        root.update(dict.fromkeys(a, a))
                pairs = [(min(group), v) for v, group in root.items()]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, v in pairs if a != v], pa.int64()),
                                                  pa.array([v for a, v in pairs if a != v], pa.int64())], schema=schema)
    return rows.repartition("task").select("task", *NODE_COLUMNS, "label", "query").mapInArrow(run, "a long, b long")


def _pivot_links(rows: DataFrame) -> DataFrame:
    """rows (node, n, tokens, p_node, p_n, p_tokens): linked (a, b)."""
    common = F.size(F.array_intersect("tokens", "p_tokens"))
    ok = (F.col("node") != F.col("p_node")) & (100 * common >= PERCENT * (F.col("n") + F.col("p_n") - common))
    sizes = 100 * F.least("n", "p_n") >= PERCENT * F.greatest("n", "p_n")
    return rows.where(sizes).where(ok).select(F.col("node").alias("a"), F.col("p_node").alias("b"))


def _split_blocks(large: DataFrame, sizes: DataFrame, block_docs: int) -> DataFrame:
    """Links of the blocks that are too large for one task. ``large``: node rows with block."""
    h = F.xxhash64("node")
    # pivots: per block a fixed number of nodes with the smallest hash
    from pyspark.sql import Window
    small_hash = F.row_number().over(Window.partitionBy("block").orderBy("_h", "node"))
    picks = large.select("block", "node", h.alias("_h")).withColumn("_k", small_hash).where(F.col("_k") <= PIVOTS)
    pivots = (picks.select(F.col("node").alias("p_node")).join(large, F.col("p_node") == large["node"])
              .select("block", "p_node", F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens")))
    first = materialise(_pivot_links(large.join(pivots, "block")), "join-pivots")
    found = materialise(components(first, "join-pv"), "join-pv")
    marked = large.join(found, "node", "left").withColumn("label", F.coalesce("root", F.col("node"))).drop("root")
    marked = materialise(marked, "join-marked")
    # per block, written: joins with them shuffle both sides themselves and can split a large block
    main = materialise(marked.groupBy("block", "label").agg(F.count(F.lit(1)).alias("_c"))
                       .groupBy("block").agg(F.max_by("label", F.struct("_c", "label")).alias("_main")), "join-main")
    marked = marked.join(main, "block").withColumn("query", F.col("label") != F.col("_main"))
    rest = marked.where("query").groupBy("block").agg(F.count(F.lit(1)).alias("_rest"))
    cuts = materialise(sizes.join(rest, "block").select(
        "block", F.ceil(F.col("size") / block_docs).cast("int").alias("_k"), F.ceil(F.col("_rest") / block_docs).cast("int").alias("_r")), "join-cuts")
    parts = marked.join(cuts, "block")
    pos = lambda k: F.pmod(F.xxhash64("node", F.lit(7)), F.col(k)).cast("int")
    # each node goes to its own piece for every piece of the rest; each node of the rest, as a
    # query, to all pieces of the block
    as_node = parts.select("*", pos("_k").alias("_p"), F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("_q")).withColumn("_as", F.lit(False))
    as_query = (parts.where("query").select("*", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_p"), pos("_r").alias("_q"))
                .withColumn("_as", F.lit(True)))
    tasks = as_node.unionByName(as_query)
    # a node of the rest may come to a task in both roles; the query role counts
    tasks = tasks.groupBy("block", "_p", "_q", "node").agg(
        *[F.first(c).alias(c) for c in ("n", "own", "level", "tokens", "label")], F.max("_as").alias("query"))
    tasks = tasks.withColumn("task", F.xxhash64("block", "_p", "_q"))
    return first.unionByName(_link_tasks(tasks))


def join(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    table = shingled(docs)
    some = table.where(F.col("tokens").isNotNull())
    digest = ["n", "d1", "d2"]
    reps = materialise(some.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "join-reps")
    r = reps.select(*[F.col(c).alias(f"r_{c}") for c in digest], "rep")
    one = (some.join(r, (some["doc_id"] == r["rep"]) & (some["n"] == r["r_n"]) & (some["d1"] == r["r_d1"]) & (some["d2"] == r["r_d2"]))
           .select("rep", *digest, "own", "level", "tokens"))
    # a repeated row of the representative gives its set twice; nodes of equal sets would only be
    # joined again, so they are harmless
    nodes = materialise(one.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    base = F.expr(f"slice(tokens, 1, greatest(n - cast(ceil({PERCENT} * n / 100) as int) + 1 - own, 0))")
    listed = nodes.select("node", F.explode(base).alias("token"))
    least = listed.groupBy("token").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("token").alias("t"), "m")
    weak = listed.join(least, listed["token"] == least["t"]).select(F.col("node").alias("a"), F.col("m").alias("b"))
    blocks = materialise(components(weak, "join-weak").select("node", F.col("root").alias("block")), "join-blocks")
    sizes = materialise(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "join-sizes")
    placed = nodes.select(*NODE_COLUMNS).join(blocks, "node").join(sizes, "block")
    small = placed.where(F.col("size") <= block_docs)
    links = _link_tasks(small.select(F.col("block").alias("task"), *NODE_COLUMNS, F.col("node").alias("label"), F.lit(True).alias("query")))
    links = materialise(links, "join-links")
    big = sizes.where(F.col("size") > block_docs)
    if big.limit(1).count():
        large = materialise(placed.where(F.col("size") > block_docs).drop("size"), "join-large")
        links = links.unionByName(_split_blocks(large, big, block_docs))
    found = materialise(components(links, "join-final"), "join-found")
    reached = nodes.select("node", "rep", *digest).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    # written, so that the join below shuffles both sides itself and can split a set of many copies
    by_set = materialise(reached.join(least_id, "root").groupBy(*digest).agg(F.min("component_id").alias("component_id"))
                         .select(*[F.col(c).alias(f"r_{c}") for c in digest], "component_id"), "join-by-set")
    s, b = some.select("doc_id", *digest), by_set
    linked = (s.join(b, (s["n"] == b["r_n"]) & (s["d1"] == b["r_d1"]) & (s["d2"] == b["r_d2"]), "left")
              .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    alone = table.where(F.col("tokens").isNull()).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id; all
    columns. Exact repeats of a row count as one document; rows with a null doc_id stay."""
    found = materialise(join(docs, block_docs), "join-result")
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).alias("stays"))
    marked = materialise(per_id.where("not stays or rows > 1").withColumnRenamed("doc_id", "_fw_id"), "join-marked-ids")
    same = F.col("d.doc_id").cast("long") == F.col("_fw_id")
    plain = docs.alias("d").join(marked, same, "left_anti")
    repeated = docs.alias("d").join(marked.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return plain.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(repeated.select(*[F.col(f"`{c}`") for c in docs.columns]))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))
