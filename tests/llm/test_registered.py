"""Registered queries against SQL, or against plain evaluation where SQL cannot say it."""

import os

import pytest

import __spark_entry__ as entry
from koine.llm import bpe, html_text
from koine.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import SF_DIR, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


def test_all_ten_and_the_pipeline_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    assert not differences(QUERIES[name](spark, SF_DIR), ORACLE_SQL[name])


def test_encoding_of_the_table(spark):
    codec = bpe.codec(bpe.default_path())
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        ids = codec.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), codec.digest(ids))


def test_articles_of_the_pages(spark):
    import html
    import re

    def article(page):
        m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        body = re.sub(r"</?(?:p|h1|br)>", "\n", re.sub(r"</?b>", "", m[1])) if m else ""
        return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in body.split("\n")) if x)

    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_html_text"](spark, SF_DIR).collect()}
    assert all(got[r["page_id"]] == article(r["html"]) == html_text.extract(r["html"]) for r in rows)


def test_mixing_and_quality_and_neighbours_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert QUERIES["op5_mixing"](spark, SF_DIR).count() == n and QUERIES["op3_quality"](spark, SF_DIR).count() == n
    found = QUERIES["op2_neighbours"](spark, SF_DIR)
    queries = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert found.count() == 10 * queries and found.columns == ["query_id", "rank", "vec_id", "score"]
