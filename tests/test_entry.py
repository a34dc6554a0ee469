import __spark_entry__ as entry

from gristmill.plans import catalogue


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"concern", "n", "oppose_share"} <= set(rows[0].asDict())


def test_catalogue_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.queries()) >= 60
