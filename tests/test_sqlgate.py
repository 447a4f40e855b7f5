import pytest

from terrane.errors import InvalidQuery
from terrane.plans.sqlgate import first_keyword, query, single_statement


@pytest.fixture
def t(spark):
    spark.range(5).createOrReplaceTempView("t")
    return spark


@pytest.mark.parametrize(
    "text",
    ["SELECT id FROM t", "  -- why\n/* not */ SELECT id FROM t;", "WITH a AS (SELECT * FROM t) SELECT id FROM a", "SELECT ';' AS id", "(SELECT id FROM t)", "VALUES (1)", "EXPLAIN SELECT 1", "SELECT id FROM t ; -- done\n", 'SELECT 1 AS `a;b`'],
)
def test_reads(t, text):
    assert query(t, text).rows


@pytest.mark.parametrize(
    "text",
    [
        "", "  ;", "DELETE FROM t", "DROP VIEW t", "INSERT INTO t VALUES (1)", "CREATE TABLE x (a INT)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1; SELECT 2", "SET x=1",
        "CACHE TABLE t", "FROM t INSERT INTO t SELECT id", "SELECT '", "/* open", "EXECUTE IMMEDIATE 'DROP VIEW t'", "BEGIN SELECT 1; END", "REFRESH TABLE t", "nonsense", "USE x", "TRUNCATE TABLE t",
    ],
)
def test_refused(t, text):
    with pytest.raises(InvalidQuery):
        query(t, text)


def test_bound_and_arguments(t):
    r = query(t, "SELECT id FROM t ORDER BY id", max_rows=3)
    assert r.rows == [(0,), (1,), (2,)] and r.truncated and r.columns == ["id"]
    assert not query(t, "SELECT id FROM t", max_rows=5).truncated
    assert query(t, "SELECT id FROM t WHERE id = ?", [3]).rows == [(3,)]
    assert query(t, "SELECT id FROM t WHERE id = :a", {"a": 4}).rows == [(4,)]


def test_lexer():
    assert first_keyword("/* a */ -- b\n select 1") == "SELECT" and first_keyword("--x") == ""
    assert single_statement("SELECT 'a''; b' ; ").strip() == "SELECT 'a''; b'"
