"""The registered queries: SQL where there is some, and the pipeline's stages, each against a plain version on its own input."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from assertlake.llm import common, mil_quality, queries
from tests.conftest import same_rows
from tests.llm import helpers as h
from tests.llm.test_documents import plain_hits

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_rows(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_for_each_input_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = got.count()
    if not name.startswith(("op1_", "op6_", "op11_", "op12_")):
        table = {"op8": "pages", "op9": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    kept = stages["quality_classifier"](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in mil_quality.judged(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == columns and {i for i, _ in rows(kept)} == good

    one = stages["ngram_jaccard_join"](spark, kept, SF).cache()
    before = rows(kept)
    root, _ = h.near_components(before)
    assert one.columns == columns and [i for i, _ in rows(one)] == sorted({min(before[k][0] for k in range(len(before)) if root[k] == x) for x in set(root)})

    cut = stages["suffix_array_dedup"](spark, one, SF).cache()
    before = rows(one)
    gone = h.removed_words(before)
    want = {i: tuple(w for k, w in enumerate(h.words(t)) if k not in gone.get((i, t), ())) for i, t in before}
    assert cut.columns == columns and {i: tuple(h.words(t)) for i, t in rows(cut)} == {i: w for i, w in want.items() if w or not gone.get((i, dict(before)[i]))}

    clean = stages["benchmark_decontamination"](spark, cut, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, *_, bad in plain_hits(rows(cut), items) if bad}
    assert clean.columns == columns and [i for i, _ in rows(clean)] == [i for i, _ in rows(cut) if i not in dirty]

    pieces = stages["packing"](spark, clean, SF).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows(clean)}
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)

    ids = lambda df: sorted((p.doc_id, p.doc_tokens) for p in df if p.start == 0)
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(pieces)


def written_tables(spark, path, rows, names="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"test{i}" for i in range(20)))], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written_tables(spark, tmp_path, [])).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, copies, very long texts, clashing names; what a stage writes on the way is gone in the end."""
    names = "doc_id long, text string, lang string, source string, n_chars long, __doc int, __T int, __spans string, __mil_score int, __fm_items string, salt int, task string, part int"
    rows = [(i, t, None, "s", None, 1, 2, "x", 3, "y", 4, "z", 5) for i, t in [*h.documents(), ((1 << 63) - 1, "the greatest id of all " * 3)]]
    sf = written_tables(spark, tmp_path, rows, names)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    before = len(common.WRITTEN)
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and len(common.WRITTEN) == before + 1
    kept = {p.doc_id for p in out}
    assert kept <= {r[0] for r in rows} and sum(p.length for p in out) == sum(p.doc_tokens for p in out if p.start == 0)
