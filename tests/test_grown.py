"""What only larger tables show: windows with more than a row keeps."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import SF, rows_of


def linked(folder, **frames):
    """The supplied tables with some in the place of theirs."""
    for f in os.listdir(SF):
        name = f.split(".")[0]
        if name in frames:
            frames[name].to_parquet(f"{folder}/{f}", coerce_timestamps="us", allow_truncated_timestamps=True)
        else:
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    return str(folder)


@pytest.fixture(scope="module")
def crowd():
    """An hour a day of one device with 190 users, of whom u7 comes last: a row keeps 128."""
    rows = []
    for day in range(10):
        users = [7, *(2 * (day * 60 + k) + 10_001 for k in range(189))]
        for k, u in enumerate(users):
            times = 1 if u == 7 else 2
            rows += [(pd.Timestamp("2024-01-08 10:00") + pd.Timedelta(days=day, seconds=k), u)] * times
    ts, users = zip(*rows)
    return pd.DataFrame({"event_id": range(len(rows)), "ts": ts, "user_id": users, "event_type": "click", "value": 1.0, "props": '{"k": 3}'})


def same(spark, duck, folder, name, **frames):
    got = entry.queries()[name](spark, linked(folder, **frames)).toPandas()
    want = duck(**frames).execute(entry.oracle_sql()[name]).df()
    assert len(want) and rows_of(got) == rows_of(want)


def test_filter_finds_an_entity_that_no_row_keeps(spark, duck, tmp_path, crowd):
    same(spark, duck, tmp_path, "alert_filter", events=crowd)


def test_lookup_finds_an_entity_that_no_row_keeps(spark, duck, tmp_path, crowd):
    same(spark, duck, tmp_path, "alert_lookup", events=crowd)


def test_words_are_taken_once(spark):
    plan = entry.queries()["document_words"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_repeated_texts_are_tokenized_once(monkeypatch):
    import pyarrow as pa

    from tidewatch.functions import tokens

    seen, real = [], tokens.events_of
    monkeypatch.setattr(tokens, "events_of", lambda text, header=None: seen.append(text) or real(text, header))
    got = tokens.event_lists(pa.array(["a=1 bb", None, "a=1 bb", "a=1 bb", "", "a=1 bb"]))
    assert sorted(seen) == ["", "a=1 bb"] and got.is_null().to_pylist() == [False, True, False, False, False, False]
    assert got[0].as_py() == got[5].as_py() and len(got[0]) == 2 and got[4].as_py() == []


def test_entities_make_no_features(spark):
    plan = entry.queries()["parsed_entities"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_net@" not in plan


def test_tenant_means_add_up_in_any_order(spark):
    """Five means that add up to 4,175 and 4,174 lines: the drop is 1 exactly, which meets the floor of 1, in whatever order the parts come."""
    from itertools import permutations

    from tidewatch.operators import volume_loss

    sums, lines = (5872, 5769, 5871, 5741, 5972), (834, 835, 835, 835, 835)
    rows = [("t", str(k), ws, ws + 1, 0, n, n, 7, s / 7, s / 7, 1.0) for ws, order in enumerate(permutations(sums)) for k, (s, n) in enumerate(zip(order, lines))]
    each = spark.createDataFrame(rows, "tenant_id string, device_key string, ws long, we long, bucket int, lines long, bytes long, maturity long, mean_lines double, mean_bytes double, sd_lines double")
    gates = volume_loss.DropGates(min_maturity=3, min_expected=2.0, min_absolute=1.0, max_ratio=0.6, min_drop=0.4, stddevs=0.5)
    got = volume_loss.evaluate_drop(volume_loss.tenant_windows(each, gates), gates).select("mean_lines", "mean_bytes", "sd_lines", "suppression").distinct().collect()
    assert [tuple(r) for r in got] == [(4175.0, 4175.0, 5**0.5, "ObservedRatioAboveThreshold")]


def test_suppliers_are_dealt_into_more_parts_as_files_grow(spark, duck, tmp_path, monkeypatch):
    from tidewatch.sources import shared

    assert shared.parts_of(spark.read.parquet(f"{SF}/lineitem.parquet")) == 1
    monkeypatch.setattr(shared, "PART", os.path.getsize(f"{SF}/lineitem.parquet") // 8)
    got = entry.queries()["supplier_volume"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and got.rdd.getNumPartitions() == 9
    assert rows_of(got.toPandas()) == rows_of(duck().execute(entry.oracle_sql()["supplier_volume"]).df())
