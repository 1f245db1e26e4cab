"""Every query of the core against its SQL; those without SQL must give rows of a stable schema."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestream import plans
from tests.compare import check

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    check(spark, small, plans.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_without_sql(spark, name):
    df = plans.queries()[name](spark, "/root/testdata/sf0.01")
    assert df.count() > 0
    assert all(kind != "void" for _, kind in df.dtypes)


def test_seven_closes_and_all_decisions(spark):
    """Whole jobs: all seven pairs are aligned, and every decision's sessions are kept."""
    sf = "/root/testdata/sf0.01"
    closes = plans.queries()["ref_j01_seven_closes"](spark, sf)
    assert sorted(closes.columns) == ["audusd", "eurusd", "gbpusd", "nzdusd", "t", "usdcad", "usdchf", "usdjpy"]
    assert 0 < closes.count() < plans.queries()["ref_j01_aligned_closes"](spark, sf).count()
    check(spark, sf, plans.queries()["ref_j01_seven_closes"], SQL["ref_j01_seven_closes"])
    check(spark, sf, plans.queries()["ref_x30_all_decisions"], SQL["ref_x30_all_decisions"])
    asked = {tuple(r) for r in spark.read.parquet(f"{sf}/decisions.parquet").where("decision_close_epoch IS NOT NULL").select("decision_close_epoch").distinct().collect()}
    kept = {tuple(r) for r in plans.queries()["ref_x30_all_decisions"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/sessions.parquet").select("source_table", "source_id", "open_epoch", "close_epoch").collect():
        assert (tuple(r) in kept) == any(t - 300 <= r.close_epoch and t >= r.open_epoch for (t,) in asked)


def test_tick_load_at_the_end_of_a_second(spark, tmp_path):
    """Nanoseconds just before the next second, before 1970 and without an id keep their second; NaN stays NaN."""
    made = [(i, t, float(i % 7)) for i in (1, 999_999_871, 999_999_872, 999_999_999, 1_999_999_999) for t in (1_388_991_581, 0, -1)]
    made += [(None, 1_388_991_581, 1.0), (2, None, 1.0), (3, 1_388_991_581, math.nan), (4, 1_388_991_581, None)]
    columns = zip(("tick_id", "epoch", "quote"), (pa.int64(), pa.int64(), pa.float64()), zip(*made))
    pq.write_table(pa.table({name: pa.array(values, kind) for name, kind, values in columns}), tmp_path / "ticks.parquet")
    check(spark, str(tmp_path), plans.queries()["ref_s04_tick_load"], SQL["ref_s04_tick_load"])
