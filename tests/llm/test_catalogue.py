import pytest

from siltstone.llm import catalogue

COLUMNS = {"p1_found": ["id", "line_no"], "p4_found": ["id"], "p5_found": ["file_path"], "p6_found": ["id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "end_char"]}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_runs_on_whole_tables(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    assert df.count() >= 0


@pytest.mark.parametrize("name", ["p4_found", "p6_found"])
def test_same_as_sql(spark, data, name):
    from compare import both, connect

    ours, theirs = both(spark, connect(data), data, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert ours == theirs


def test_scans_of_texts_are_no_shuffle(spark, data):
    import io
    from contextlib import redirect_stdout

    from siltstone.llm import credentials, origin, sentences

    def plan(df):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    chunks, docs = spark.read.parquet(f"{data}/chunks.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    for df in (credentials.find_credentials(chunks), credentials.redact_credentials(chunks), sentences.split_sentences(docs)):
        assert "Exchange" not in plan(df)
    p = plan(origin.file_measures(chunks))
    assert p.count("Exchange hashpartitioning") + p.count("(unknown) Exchange") <= 1 and "embedding" not in p
