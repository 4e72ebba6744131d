"""What of a request reaches the scans."""

import re

import pytest

from quern.plans.compile import bind
from quern.plans.parser import parse
from quern.sources import adapters as A


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    def of(catalog, source):
        df = bind(parse(source), catalog(spark, sf_dir))
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    return of


def pushed(text):
    return " ".join(re.findall(r"PushedFilters: \[(.*)\]", text))


def read(text):
    return " ".join(re.findall(r"ReadSchema: struct<(.*)>", text))


def test_document_paths(plan):
    text = plan(A.documents, "from docs\n| where meta.lang = 'fr'\n| where n_chars >= 1000\n| emit { meta.source, n_chars }")
    assert "EqualTo(lang,fr)" in pushed(text) and "GreaterThanOrEqual(n_chars,1000)" in pushed(text)
    assert "labels.parquet" not in text and "Join" not in text and "text:" not in read(text)
    assert "labels.parquet" in plan(A.documents, "from docs\n| where toxic = 1\n| emit { n_chars }")


def test_graph_paths(plan):
    text = plan(A.sales, "from sales\n| where segment = 'MACHINERY'\n| navigate placed as o\n| emit { name, o.status }")
    assert "EqualTo(c_mktsegment,MACHINERY)" in pushed(text)
    assert "orders" not in plan(A.sales, "from sales\n| where segment = 'MACHINERY'\n| emit { name }")


def test_kv_keys(plan):
    assert "EqualTo(p_name,x)" in pushed(plan(A.part_sizes, "from partsize\n| where key = 'x'\n| emit { value }"))
