"""Loader, schema checks, payload parsing, cache, sinks."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import facts as SRC
from ledgerlens.sources import payloads as PL
from ledgerlens.sources import sinks as SK


def _csv(spark, pdf, drop=None, extra=False):
    d = tempfile.mkdtemp(prefix="ledgerlens-csv-")
    p = os.path.join(d, "sales.csv")
    out = pdf.drop(columns=[drop]) if drop else pdf.copy()
    if extra:
        out["Spurious"] = 1
    out.to_csv(p, index=False)
    return p


def test_load_raw_roundtrip_and_types(spark, sample_pdf):
    df = SRC.load_raw(spark, _csv(spark, sample_pdf))
    assert df.count() == len(sample_pdf)
    types = dict(df.dtypes)
    assert types["Year"] == "smallint" and types["Engine_Size_L"] == "float" and types["Sales_Volume"] == "int"


def test_missing_file_raises(spark):
    with pytest.raises(FileNotFoundError):
        SRC.load_raw(spark, "/nonexistent/sales.csv")


def test_schema_errors(spark, sample_pdf):
    with pytest.raises(SRC.SchemaValidationError):
        SRC.load_raw(spark, _csv(spark, sample_pdf, drop="Price_USD"))
    with pytest.raises(SRC.SchemaValidationError):
        SRC.load_raw(spark, _csv(spark, sample_pdf, extra=True))


def test_indicator_payload_parse_and_rejects(spark):
    rows = [
        ("ok", json.dumps([{"page": 1}, [{"date": "2015", "value": 1.5}, {"date": "2016", "value": None}]])),
        ("short", json.dumps([{"page": 1}])),
        ("nulls", json.dumps([{"page": 1}, None])),
        ("junk", "not json"),
        ("text", json.dumps([{"page": 1}, "text"])),
        ("object", json.dumps([{"page": 1}, {"date": "2015", "value": 1}])),
        ("quarter", json.dumps([{"page": 1}, [{"date": "2015Q1", "value": 1.0}, {"date": "2016", "value": 2.0}]])),
        ("words", json.dumps([{"page": 1}, [{"date": "2015", "value": "many"}]])),
    ]
    df = spark.createDataFrame(rows, "src string, raw string")
    parsed, rejects = PL.parse_indicator_payloads(df)
    assert sorted((r.src, r.year, r.value) for r in parsed.collect()) == [("ok", 2015, 1.5), ("quarter", 2016, 2.0)]
    assert sorted(r.src for r in rejects.collect()) == ["junk", "nulls", "object", "quarter", "short", "text", "words"]


def test_fx_payload(spark):
    df = spark.createDataFrame([("EUR", '{"rates":{"USD":1.08}}'), ("XXX", '{"rates":{}}'), ("YYY", '{"rates":{"USD":"abc"}}')], "c string, raw string")
    parsed, rejects = PL.parse_fx_payloads(df)
    assert [(r.c, r.usd_per_unit) for r in parsed.collect()] == [("EUR", 1.08)]
    assert rejects.count() == 2


def test_cached_frame(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-cache-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    _, prov1 = PL.cached_frame(spark, "panel", {"b": 2, "a": 1}, build, cache_root=root)
    df, prov2 = PL.cached_frame(spark, "panel", {"a": 1, "b": 2}, build, cache_root=root)
    assert (prov1, prov2, len(calls), df.count()) == ("live", "cache", 1, 3)


def test_metrics_and_run_log(spark):
    root = tempfile.mkdtemp(prefix="ledgerlens-sink-")
    m = spark.createDataFrame([("regression", "A", "r2", 0.1), ("regression", "B", "r2", 0.3)],
                              "task string, model string, metric string, value double")
    SK.write_metrics(m, os.path.join(root, "m"))
    back = SK.read_metrics(spark, os.path.join(root, "m"))
    assert back.count() == 2
    doc = json.loads(SK.nested_metrics(m).first().json)
    assert doc == {"regression": {"A": {"r2": 0.1}, "B": {"r2": 0.3}}}
    SK.log_run(spark, os.path.join(root, "runs"), model="A", task="regression", params={"depth": 3},
               metrics={"r2": 0.1})
    assert spark.read.parquet(os.path.join(root, "runs")).where(F.col("kind") == "metric").count() == 1


def test_facts_are_joined_without_sorting_the_large_side(spark, tmp_path):
    """Where partitions are small the planner hashes the smaller side; the session's setting comes back afterwards."""
    from ledgerlens.plans import catalogue
    from ledgerlens.session import hashed_joins
    from ledgerlens.sources.facts import sales_facts
    from tests.conftest import SF_SMALL

    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with hashed_joins(spark):
            hashed = sales_facts(spark, SF_SMALL)
            got = sorted(hashed.collect())
            plan = hashed._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan.split("Initial Plan")[0] and spark.conf.get(key) == before
        assert got == sorted(sales_facts(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    written = catalogue.facts(spark, SF_SMALL)
    assert sorted(written.collect()) == got and all(".zstd." in f for f in written.inputFiles())


@pytest.mark.parametrize("aim", [None, "128m", "32MB", "268435456b"])
def test_joins_are_hashed_whatever_size_the_session_aims_at(spark, aim):
    """The planner hashes no join while the partitions it aims at are above the bound of a hashed one."""
    from ledgerlens.session import HASHED_PARTITION, _bytes, hashed_joins

    key, bound = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    given = spark.conf.get(key)
    if aim:
        spark.conf.set(key, aim)
    try:
        before = [spark.conf.get(k) for k in (key, bound)]
        with hashed_joins(spark):
            assert _bytes(spark.conf.get(key)) == min(_bytes(before[0]), HASHED_PARTITION) <= _bytes(spark.conf.get(bound))
        assert [spark.conf.get(k) for k in (key, bound)] == before
    finally:
        spark.conf.set(key, given)
    assert [_bytes(x) for x in ("64MB", "1g", "10", "8b", "2k")] == [64 << 20, 1 << 30, 10, 8, 2048]
