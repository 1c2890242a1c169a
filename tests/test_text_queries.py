"""Queries over texts that the small tables don't hold: negated keywords, blank and missing texts, repeated ids."""

import duckdb
import pytest

from ledgerline.plans.claims_queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with a table of documents, and DuckDB with the same rows."""
    texts = [
        "el vino token = abc", "there is no license, none license and not idiot", "I am fine. The MIT license", "no injuries; all rights\nreserved, token", "worthless: denies token",
        "the and with this from that", " \n\t", "", None, "und der nicht auf mit no license", "TOKEN", "tokens and licensed",
    ]
    made = [(i, texts[i % len(texts)]) for i in range(60)] + [(3, "the and with this"), (20, "no token"), (20, "no token"), (5, "the and with this from that")]
    folder = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(made, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return str(folder), con


def same(spark, documents, name):
    folder, con = documents
    df = QUERIES[name](spark, folder)
    want = con.execute(ORACLE_SQL[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), [d[0] for d in want.description])


@pytest.mark.parametrize("name", ["j13_keyword_signals", "a13_signal_counts", "a14_consolidated_signals", "f19_blocked_triggers", "p25_keyword_confidence", "w04_top_two", "w02_semantic_dedup"])
def test_negated_keywords_as_in_the_sql(spark, documents, name):
    same(spark, documents, name)


def test_blank_texts_and_repeated_ids_classified_as_in_the_sql(spark, documents):
    same(spark, documents, "w01_classification")


def test_keyword_search_makes_no_runs_of_words(spark, monkeypatch):
    """Runs of words as strings took most of the time; a text looked through, and one cut into words, give the same signals."""
    from ledgerline.operators import documents as D

    texts = ["a class -- Action, fraud", "class act and action", "no class action", "refraud fraud lawsuits lawsuit", "Fraud is denied fraud", "I'm fine, lawsuit", " fraud\n" + "x" * 900, "was not fraud but fraud", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dictionary = spark.createDataFrame([("fraud", "conduct", "High"), ("class action", "legal", "High"), ("Class-Action", "legal", "Low"), ("lawsuit", "legal", "Low")], "keyword string, type string, severity string")
    told = lambda: sorted((r.doc_id, r.keyword, r.at, r.snippet) for r in D.keyword_signals(docs, dictionary).collect())
    got = told()
    assert [(d, k, at) for d, k, at, _ in got] == [(0, "Class-Action", 3), (0, "class action", 3), (0, "fraud", 20), (3, "fraud", 9), (3, "lawsuit", 24), (6, "fraud", 2)]
    assert got[0][3] == texts[0] and got[-1][3].startswith("fraud xxx")
    assert "slice(" not in D.keyword_signals(docs, dictionary)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(D, "MANY_WORDS", 0)
    assert told() == got
