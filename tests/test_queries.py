"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from tallyloom.plans import load_all
from tools.check import TABLES, close, key, plain

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, sf_dir, con, name):
    q = REGISTRY[name]
    df = q.build(spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=key)
    if q.sql is None:
        assert rows
        return
    cursor = con.execute(q.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((plain(tuple(r[k] for k in order)) for r in cursor.fetchall()), key=key)
    assert len(rows) == len(expected)
    assert all(close(a, b) for a, b in zip(rows, expected))


def test_covers_every_survey_row():
    covered = {c for q in REGISTRY.values() for c in q.covers}
    families = (
        ("SRC", 12), ("SNK", 7), ("PRJ", 32), ("JOIN", 14), ("AGG", 20), ("MAT", 20), ("ST", 22), ("EV", 38), ("WIN", 8),
        ("ORD", 4), ("SET", 4), ("FN", 10), ("STR", 6), ("UDF", 3), ("UDAF", 1), ("UDTF", 1),
    )
    wanted = [f"{g}{k}" for g, n in families for k in range(1, n + 1)]
    assert not [w for w in wanted if w not in covered]


def test_no_sampling_limits_in_oracles():
    """A limit belongs to top-k reports and sampling operators only."""
    limited = {n for n, q in REGISTRY.items() if q.sql and "LIMIT" in q.sql.upper()}
    assert limited <= {"top_tokens", "sampled_pairs", "top_set_overlap", "weight_search"}
