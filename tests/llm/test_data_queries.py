"""The registered queries against their SQL on small tables, and the pipeline against its stages' promises."""

import pytest

import corpus_pipeline
from check import compare, open_duckdb
from tickertone.llm import neardup, oracle, queries
from test_neardup import brute
from tickertone.llm.bpe import Vocabulary, encode_texts

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle.statements())
def test_query_matches_sql(spark, name):
    mine = queries.registered()[name](spark, SF_DIR).toArrow()
    assert compare(mine, open_duckdb(SF_DIR).sql(oracle.statements()[name]).to_arrow_table()) == ""


@pytest.mark.parametrize("name", sorted(set(queries.registered()) - set(oracle.statements())))
def test_query_gives_a_row_for_each_input_row(spark, name):
    table = "pages" if "html" in name else "documents"
    rows = queries.registered()[name](spark, SF_DIR)
    key = "page_id" if table == "pages" else "doc_id"
    given = spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key)
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in given.collect())


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = neardup.near_duplicates(docs).collect()
    assert sorted([(r.id, r.class_id, r.copies, r.n_linked_texts, r.n_links) for r in found], key=str) == brute(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near duplicates", "mixing", "bpe"]
    names = list(stages)
    kept = {}
    for name in names[:4]:
        docs = stages[name](spark, docs, SF_DIR).checkpoint()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    verdicts = {r.doc_id for r in queries.op3_quality_rules(spark, SF_DIR).where("kept").collect()}
    assert kept["quality rules"].keys() == verdicts
    groups = brute(list(kept["line dedup"].items()))
    assert kept["near duplicates"].keys() == {x[1] for x in groups}
    assert kept["mixing"].keys() <= kept["near duplicates"].keys()
    vocabulary = Vocabulary.load(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    for row in corpus_pipeline.run(spark, SF_DIR).collect():
        ids, decoded = encode_texts([kept["mixing"].pop(row.doc_id)], vocabulary)
        assert (list(row.ids), row.decoded) == (ids[0].tolist(), decoded[0])
    assert not kept["mixing"]


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, rows):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = given.limit(0)
    if rows == "odd":
        text = "Ten plain words of prose stand here in number {} and no other text has all of them in this very order."
        odd = [(1, text.format("one")), (1, text.format("one")), (2, text.format("one")), (3, None), (4, ""), (5, " \n\t"), (None, text.format("six of nothing"))]
        odd = [(i, t, None if i == 2 else "en", None if i == 1 else "web", None if t is None else len(t)) for i, t in odd]
        docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").to(given.schema)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR).checkpoint()
        assert docs.count() <= before.count()
        if name == "near duplicates":
            # Texts without words and copies are gone; the id 1 stands for its copies, and a null id stays.
            assert sorted(str(r.doc_id) for r in docs.collect()) == ([] if rows == "none" else ["1", "None"])
    assert {"ids", "decoded"} <= set(docs.columns)
