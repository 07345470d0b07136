"""Every registered query of the subpackage at the smallest size: columns, rows, SQL."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_": ["doc_id", "held_out", "lang_pred", "score"], "op2_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_": ["page_id", "url", "text", "n_chars"], "op4_": ["doc_id", "held_out", "score", "predicted"], "op5_": ["doc_id", "text"],
    "op6_": ["doc_id", "start", "n_tokens", "ids_crc32"], "op7_": ["doc_id", "n_shingles", "component_id"],
    "op8_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_": ["doc_id", "size", "source_size", "target", "taken"], "op10_": ["doc_id", "severity"],
    "op11_": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op12_": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op13_": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}
NAMES = [n for n in E.queries() if n.startswith("op")]


def test_the_operators_and_the_pipeline_are_registered():
    assert sorted(n.split("_")[0] for n in NAMES) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = E.queries()[name](spark, SF).toPandas()
    table, key = {"op3": ("pages", "page_id"), "op11": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    rows = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    assert len(got) == (rows.distinct() if table == "conversations" else rows).count()
    assert set(COLUMNS[name[:name.index("_") + 1]]) <= set(got.columns)
    if name in E.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "labels", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.sql(E.oracle_sql()[name]).df()
        assert sorted(want.columns) == sorted(got.columns) and digest(want) == digest(got)


def test_pipeline_stages_in_python(spark):
    """The stages against plain Python, each on what the stage before kept."""
    import numpy as np
    from tokenizers import Tokenizer

    from farewatch.llm import decontaminate, token_store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{hashlib.md5(name.encode()).hexdigest()[:6]}-{spark.sparkContext.applicationId}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.toPandas())
    languages, single, clean, mixed = kept
    assert len(languages) == spark.read.parquet(f"{SF}/documents.parquet").count()     # all are in a known language

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}
    all_sets = [sets(t) for t in single["text"]]
    for i, a in enumerate(all_sets):
        assert not any(100 * len(a & b) >= 80 * len(a | b) for b in all_sets[:i])
    windows = {w.decode() for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for w in decontaminate.windows_of(t)}
    dirty = {r.doc_id for r in single.itertuples() if any(f" {w} " in f" {b' '.join(decontaminate.words_of(r.text)).decode()} " for w in windows)}
    assert set(clean["doc_id"]) == set(single["doc_id"]) - dirty
    assert set(mixed["doc_id"]) <= set(clean["doc_id"]) and mixed.groupby("doc_id").size().max() <= 2
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    tok = Tokenizer.from_file(token_store.tokenizer_path())
    n = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.itertuples()}
    assert len(got) == len(mixed) and (got["n_tokens"] == got["doc_id"].map(n)).all()
    order = got.sort_values("start")
    assert (np.diff(order["doc_id"]) >= 0).all() and order["start"].iloc[-1] + order["n_tokens"].iloc[-1] == order["n_tokens"].sum()
