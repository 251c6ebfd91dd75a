"""Every registered query against its oracle, and the entry points without the optional subpackage."""

import subprocess
import sys

import duckdb
import pytest

from strandline.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name, tmp_path):
    QUERIES[name](spark, sf_dir).write.parquet(str(tmp_path / "out"))  # a result must be writable, too
    df = spark.read.parquet(str(tmp_path / "out"))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    want = sorted(con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLES[name]})").fetchall(), key=str)
    assert got == want


def test_whole_tables(spark, con, sf_dir):
    """These read every row."""
    def n(sql):
        return con.execute(sql).fetchone()[0]

    whole = {k: QUERIES[k](spark, sf_dir) for k in ("resolve_all", "range_header", "set_difference", "lsm_view")}
    assert whole["resolve_all"].count() == n("select count(*) from lineitem")
    parts = whole["range_header"].selectExpr("sum(size(split(header, ', ')))").first()[0]
    assert parts == n("select count(*) from events")
    assert whole["set_difference"].where("l_partkey >= 50").count() > 0
    assert whole["lsm_view"].where("k % 3 <> 0").join(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as k", "cast(o_custkey as bigint) as v"), ["k", "v"], "left_anti").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_without_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == str(len(QUERIES)), out.stderr


def test_documents_come_in_small_batches(spark, sf_dir):
    """Texts are bounded by bytes, and blobs made of them stay in the worker."""
    from strandline.plans import session

    for name in ("chunk_tables", "local_blobs", "container_round_trip"):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        df = QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == session.BATCH_BYTES
        if name != "container_round_trip":
            assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
