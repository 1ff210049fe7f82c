import pytest

from tagtide.functions import entities
from tagtide.plans import catalogue

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, same, name):
    same(name, catalogue.QUERIES[name](spark, SMALL), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_models_run(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["h", "lag"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_feature_lists(spark):
    shares = {r["k"] for r in catalogue.QUERIES["topk_share_whole"](spark, SMALL).collect()}
    assert shares == {10, 100, 1000, 10_000, 100_000}
    cells = lambda name: {(r["family"], r["topic"]): r["mean_mi"] for r in catalogue.QUERIES[name](spark, SMALL).collect()}
    assert cells("mi_matrix_whole") != cells("mi_matrix") and cells("mi_matrix_whole").keys() == cells("mi_matrix").keys()


@pytest.mark.parametrize("name", "hashtag_extract mention_extract reply_extract cashtag_extract url_extract entity_spans autolink highlight tweet_length".split())
def test_text_functions_read_whole_tables(spark, duck, name):
    name, table = name + "_documents", "documents"
    rows = catalogue.QUERIES[name](spark, SMALL).collect()
    assert len(rows) == duck.execute(f"select count(*) from {table}").fetchone()[0]
    if name == "url_extract_documents":
        texts = dict(duck.execute("select doc_id, text from documents").fetchall())
        assert all(r["urls"] == ",".join(s.value for s in entities.scan(texts[r["id"]], ("URL",))) for r in rows)
