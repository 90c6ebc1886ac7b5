"""Plan guards: no cross products, filters reach the scan, cut points without sorting rows."""

from __future__ import annotations


import __spark_entry__ as entry
import pytest
from conftest import SF_SMALL

from ledgerlens.plans import catalogue
from ledgerlens.spec import TPCH_SPEC

_FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_in_oracle_backed_queries(spark):
    q, oracles = entry.queries(), entry.oracle_sql()
    bad = {}
    for name in sorted(oracles):
        plan = _plan(q[name](spark, SF_SMALL))
        hits = [f for f in _FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_slice_filters_pushed_to_scan(spark):
    df = entry.queries()["sliced_facts"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters" in plan and "In(Region" in plan.replace(" ", "")


def test_fact_scan_prunes_columns(spark):
    df = catalogue.facts(spark, SF_SMALL).select("Region", "Sales_Volume")
    plan = _plan(df)
    assert "ReadSchema: struct<Region:string,Sales_Volume:int>" in plan


@pytest.mark.parametrize("name", ["top_regions_by_volume", "price_stats_by_model", "yoy_volume"])
def test_reports_run_on_unmaterialised_join(spark, name):
    from ledgerlens.operators import reports

    f = catalogue.facts_unmaterialised(spark, SF_SMALL)
    assert reports.REPORTS[name](f, TPCH_SPEC).count() > 0


def test_quartiles_and_split_neither_sort_nor_shuffle_the_facts(spark):
    from ledgerlens.operators import learn, reports

    f = catalogue.facts(spark, SF_SMALL)
    split = _plan(learn.assign_split(f, "row_key"))
    assert "Exchange" not in split and "Sort" not in split
    quartiles = _plan(reports.price_stats_by_model(f, TPCH_SPEC))
    # the facts meet one partial aggregate; all other exchanges are of group-sized rows
    assert quartiles.count("Price_USD") and "SortMergeJoin" not in quartiles.split("Price_USD")[0]


def test_facts_follow_their_sources(spark, tmp_path):
    import os
    import shutil

    folder = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, folder)
    os.chmod(folder, 0o755)  # the test data are read-only, and their modes are copied
    n = catalogue.facts(spark, folder).count()
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(100).coalesce(1).write.parquet(f"{folder}/new")
    shutil.rmtree(f"{folder}/lineitem.parquet", ignore_errors=True)
    if os.path.exists(f"{folder}/lineitem.parquet"):
        os.remove(f"{folder}/lineitem.parquet")
    os.rename(f"{folder}/new", f"{folder}/lineitem.parquet")
    assert 0 < catalogue.facts(spark, folder).count() <= 100 < n


def test_no_private_folder_on_a_cluster(monkeypatch):
    from ledgerlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_signature_lists_files_and_reads_no_row(spark, tmp_path):
    from ledgerlens.session import source_files, source_signature

    paths = [f"{SF_SMALL}/{t}.parquet" for t in catalogue.FACT_SOURCES]
    assert source_files(spark, paths).count() == len(paths)
    assert "content" not in _plan(source_files(spark, paths)).split("ReadSchema")[-1]
    folder = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(folder)
    before = source_signature(spark, [folder])
    assert source_files(spark, [folder]).count() == 3 and before == source_signature(spark, [folder])
    spark.range(10).coalesce(1).write.mode("append").parquet(folder)
    assert source_signature(spark, [folder]) != before


def test_workers_import_the_package_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from ledgerlens.session import get_session, ship_code\n"
        "spark = get_session('local[1]', driver_memory='1g'); ship_code(spark)\n"
        "def names(batches):\n"
        "    import ledgerlens.spec, pyarrow as pa\n"
        "    for b in batches: yield pa.RecordBatch.from_arrays([pa.array([ledgerlens.spec.SEED] * b.num_rows)], ['x'])\n"
        "print('found', spark.range(1).mapInArrow(names, 'x long').first()['x'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 42" in out.stdout, out.stderr[-2000:]
