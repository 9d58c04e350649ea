"""Ratios that lie on a bound of the rejection mask."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def test_ratios_on_a_bound_equal_the_sql(spark, tmp_path):
    """Ratios of exactly 2.5 before rounding: what the logarithms' last places decide is as in SQL."""
    ids = [e for e in range(100_000) if 10 * (55 + 10 * (e % 89)) in (275 * (5 + e % 83), 44 * (5 + e % 83))] + list(range(50))
    ids += [13127, 20514, 27901, 444, 1768, 2325, 7831]
    ids = sorted(set(ids))
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "user_id": pa.array([e % 5 for e in ids], pa.int64())}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(entry.oracle_sql()["corrected_tokens"]).fetchall()
    got = entry.queries()["corrected_tokens"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    kept = {r.event_id: r.kept for r in got}
    assert kept[13127] == 1 and kept[444] == 0
