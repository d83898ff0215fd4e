"""The registered queries on the smallest tables: SQL twins, contract columns, the pipeline's stages."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from solvefront.llm import queries

COLUMNS = {
    "op1_context_tree_weighting": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op2_prefix_tree_join": {"doc_id", "n_shingles", "component_id"},
    "op3_one_bit_codes": {"query_id", "rank", "vec_id", "score"},
    "op4_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_redirect_equivalence": {"page_id", "host", "path", "rule", "verdict"},
    "op6_segmentation_unigrams": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_minimum_bin_slack": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8_line_frequency": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_line_field": {"doc_id", "held_out", "score", "predicted"},
    "op10_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert set(df.columns) >= COLUMNS[name]
    rows = df.collect()
    if name[2] != "3" and "page_id" not in df.columns and name != "op7_minimum_bin_slack":
        assert len(rows) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    for r in rows[:50]:
        if "held_out" in df.columns:
            folds, which = (5, 1) if name.startswith("op1_") else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == which)
    if sql := queries.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in rows))) == sorted(map(repr, result.fetchall()))


#: Names that operators give to columns of their own.
CLASHES = ("kept", "n_words", "score", "predicted", "size", "target", "copies", "source_size", "text_hash", "document", "component_id")


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, tiny, name, step):
    """Nulls, empty and wordless texts, repeated rows, a long text and clashing columns: no crash, the caller's values as they were; an empty table stays empty."""
    prose = lambda i: "\n".join(" ".join(f"word{i}x{j}k{k}" for k in range(12)) for j in range(8))
    texts = [None, "", " \n ", prose(1), prose(1), prose(2), prose(3) + " more", "a b\n" * 40_000, "no-space" * 30_000]
    rows = [(i, t, "en", None if i == 2 else "s", 7, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, prose(9), "en", "s", 7, *[f"{c}-" for c in CLASHES])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    got = step(spark, docs, tiny)
    assert step(spark, docs.where("false"), tiny).count() == 0
    if name == "packing":
        placed = got.collect()
        assert sum(r.length for r in placed if r.doc_id == 0) == 1 and all(len(r.ids) == r.length <= 4096 for r in placed)
        return
    assert got.columns == docs.columns
    allowed = {(r[0], *r[5:]) for r in rows}
    kept = [tuple(r) for r in got.collect()]
    assert kept and all((r[0], *r[5:]) in allowed for r in kept)
    ids = [r[0] for r in kept]
    if name == "quality_rules":
        assert not {0, 1, 2, 7} & set(ids) and ids.count(3) == 2 and {5, 6, None} <= set(ids)
    if name == "near_duplicates":
        assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 5, 6, 7, 8, None], key=str)


def test_pipeline_stages(spark, tiny):
    from solvefront.llm.common import stage

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(spark, step(spark, docs, tiny), name)
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == columns
        if name == "quality_classifier":
            kept = [labels[r.doc_id] for r in docs.collect() if r.doc_id in labels]
            assert sum(kept) >= 0.9 * len(kept)
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] and sizes[5] >= sizes[4]
