"""The entry module, and queries with their SQL against DuckDB on small tables."""

import __spark_entry__
import duckdb
import pytest

from fluxpanel import catalog
from jobs import queries as jobs

SF = "/root/testdata/sf0.01"
#: A query of each kind; the rest differ in a frame or an aggregate.
CHOSEN = "job1_yearly_anomalies job2_live_events climatology_by_parts netcdf_years land_cover_nearest regrid_linear merged_files enrich_mean_sums enrich_min_sums enrich_sum_sums enrich_smooth_sums enrich_named rolling_job composite_bucketed rolling_leading_max climatology std_anomaly detrend event_catalogue_growing_season runs_of_mask land_cover_daily composite_land_cover composite_weighted_quartile event_percentiles enrich_weighted_max regional_catalogue kde_by_quartile mann_whitney sensitivity event_clusters bootstrap_bound regrid_half_cell catalogue_csv numbers_text count_map_npy year_tables anomaly_job composites_all sensitivity_map nearest_pixels".split()
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return 0.0 if value == 0 else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = (catalog.QUERIES | jobs.QUERIES)[name](spark, SF)
    res = duck.execute((catalog.ORACLE_SQL | jobs.ORACLE_SQL)[name])
    cols = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in order)) for r in res.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*order).collect()) == want


def test_entry_has_the_known_catalogue(spark):
    assert __spark_entry__.entry(spark).count() == 78


def test_every_query_is_registered():
    assert set(CHOSEN) <= set(catalog.QUERIES | jobs.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and set(jobs.QUERIES) == set(jobs.ORACLE_SQL)
    assert set(catalog.QUERIES | jobs.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__spark_entry__.__file__).resolve().parent
    for item in ("__spark_entry__.py", "fluxpanel", "jobs"):
        src = repo / item
        shutil.copytree(src, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; n = e.queries(); assert 'event_catalogue' in n and not [x for x in n if x.startswith('op')]; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
