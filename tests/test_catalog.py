import pytest
from compare import connection, difference

from folioflow.plans import catalog, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


#: Queries whose result is empty by what they ask.
EMPTY = {"F16_missing_node"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert difference(spark, name, QUERIES[name], SQL[name], sf, con) == ""
    assert (con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0) == (name not in EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_contained_phrases_of_any_kind(spark):
    texts = ["and so the lower-case phrase of many words goes on", "see 12 \"quoted things that are long enough here\"", "Žluťoučký kůň pěl ďábelské ódy, all day long", "ab", "", None, "x ab"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "Other"), (2, "end ab"), (2, "end ab")]
    phrases = ["the lower-case phrase of many words", "12 \"quoted things that are long", "\"quoted things that are long enough", "Žluťoučký kůň pěl ďábelské ódy", "ab", "b", "12", "Ž", "", None, "the lower-case phrase of many worlds", "ab"]
    items = list(enumerate(phrases))
    got = catalog._contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(d, i) for d, t in docs for i, p in items if t is not None and p and p in t]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
