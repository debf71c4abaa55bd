"""Events with values of 0 and tracks whose median gap is no whole day: results equal SQL, or come without an error."""

import duckdb
import pytest
from test_queries import shown

from gyrelake.plans.queries import ORACLE, QUERIES

#: Days of three neighbour users; the gaps of the second and third have a median of 1.5 and 2.5 days.
DAYS = {0: (0, 1, 2, 3, 4, 5), 96: (0, 1, 3, 4, 7, 8, 10, 15), 192: (0, 2, 5, 7, 13, 15, 18)}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(u, f"2024-01-{d + 1:02d}", 0.0 if (u + d) % 4 == 0 else 1.0 + d) for u, days in DAYS.items() for d in days]
    spark.createDataFrame(rows, "user_id long, day string, value double").selectExpr("user_id", "cast(day as timestamp) as ts", "value").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["gap_fill", "fill_linear", "step_link_candidates", "topk_candidates", "distance_links", "distance_tracks", "link_lengths", "nomatch_anti", "unused_anti"])
def test_odd_events_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet/*.parquet'")
    df, found = QUERIES[name](spark, odd), con.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert shown(df.select(*sorted(columns)).collect()) == shown(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in want)
    assert want or name in ("unused_anti",)


@pytest.mark.parametrize("name", ["greedy_assign", "assign_in_order"])
def test_zero_amplitude_is_no_error(spark, odd, name):
    links = QUERIES[name](spark, odd).collect()
    assert links and len({(r["step"], r["a"]) for r in links}) == len({(r["step"], r["b"]) for r in links}) == len(links)
