"""Queries against their SQL, on small tables where they once differed from it."""

import duckdb

import __spark_entry__ as entry


def differ(spark, folder, name, **tables):
    """Rows that only the query or only its SQL gives, from tables(name=SELECT)."""
    sql = duckdb.connect()
    for table, select in tables.items():
        sql.sql(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        sql.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = sql.sql(entry.oracle_sql()[name])
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*want.columns).collect()]
    want = want.fetchall()
    assert len(want) == len(got) > 0
    return set(got) ^ set(want)


def test_histories_that_end_without_active_operations(spark, tmp_path):
    # add 1, back; add 1, 2, back twice, back, then next; back only; add, back, add, back; none but next
    events = [(1, 1), (1, 3), (2, 1), (2, 2), (2, 6), (2, 9), (2, 12), (3, 3), (4, 1), (4, 3), (4, 4), (4, 6), (5, 7), (6, 1), (6, 3), (6, 7)]
    rows = ", ".join(f"({u}, {e})" for u, e in events)
    assert differ(spark, tmp_path, "history_prefix", events=f"SELECT u::BIGINT AS user_id, e::BIGINT AS event_id FROM (VALUES {rows}) t(u, e)") == set()


def test_counts_of_no_surface_and_of_one(spark, tmp_path):
    rows = "SELECT i::BIGINT AS l_orderkey, i::BIGINT AS l_partkey, 1::INTEGER AS l_linenumber, {}::DOUBLE AS l_quantity FROM range({}) t(i)"
    for name, quantity, n in (("low", 5, 10), ("one", 900, 5)):
        (tmp_path / name).mkdir()
        assert differ(spark, tmp_path / name, "iso_mesh_counts", lineitem=rows.format(quantity, n)) == set()


def test_names_of_more_than_ten_thousand_slices(spark, tmp_path):
    assert differ(spark, tmp_path, "slices_turned", part="SELECT k::BIGINT AS p_partkey, 40::INTEGER AS p_size FROM (VALUES (3), (666799)) t(k)") == set()
