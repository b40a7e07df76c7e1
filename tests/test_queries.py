"""Every query against its DuckDB SQL on the same tables."""

import glob
import math
import os
import re
from html import unescape

import duckdb
import numpy as np
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        if name in {"rouge_l_stemmed", "sentence_cosine_top2"}:  # held against brute force in test_models.py
            return
        assert name == "html_text"  # what a full parser keeps is what the page's own words are
        for html, text in spark.read.parquet(f"{SF}/pages.parquet").join(spark.createDataFrame(got), "page_id").select("html", "text").collect():
            plain_words = set(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style|noscript).*?</\1>|<!--.*?-->", " ", html))).split())
            assert set(text.split()) <= plain_words | set(re.sub(r"<[^>]*>", "", unescape(html)).split())
        return
    want = duck.execute(sql).df()
    assert set(got.columns) == set(want.columns)
    rows = lambda df: sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].values.tolist())
    assert rows(got) == rows(want)
