import pytest
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry_points
from postmatch_checks import compare, oracle
from postmatch_checks.queries import REGISTRY


@pytest.fixture(scope="module")
def texts(spark):
    return oracle.all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.views(sf_dir)


def test_every_query_has_sql(spark, texts):
    assert set(texts) == set(REGISTRY) <= set(entry_points.queries())
    assert set(texts) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, sf_dir, con, texts, name):
    assert compare.differences(spark, con, name, texts[name], sf_dir) == []


def test_sql_needs_no_session(spark):
    assert oracle._stop_words() == StopWordsRemover.loadDefaultStopWords("english")


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).count() == 10
