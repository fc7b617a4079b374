import pytest

from dialoom.plans import catalog
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_the_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE_SQL[name])


def test_every_query_has_sql_but_the_sequential_ones():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"assemble_sessions", "adjacent_domain_rate", "unused_dialogues"}
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_sessions_keep_the_budget(spark):
    rows = catalog.QUERIES["assemble_sessions"](spark, FOLDER).collect()
    uses, sessions = {}, {}
    for r in rows:
        uses[r.split, r.dialogue_id] = uses.get((r.split, r.dialogue_id), 0) + 1
        sessions.setdefault(r.session_id, []).append(r)
    assert all(n <= (5 if s == "train" else 3) for (s, _), n in uses.items())
    for own in sessions.values():
        ids = [r.dialogue_id for r in own]
        assert 3 <= len(ids) <= 8 and len(set(ids)) == len(ids)


def test_the_flagship_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
