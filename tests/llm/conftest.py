import pytest

from webextract.session import table

TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings", "pages")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, small):
    return {t: table(spark, small, t).toPandas() for t in TABLES}
