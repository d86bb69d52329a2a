"""The entry module: it imports without the optional parts, and queries equal their SQL on the smallest tables."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ["tri13_depth_stats", "tri07_entropy", "ngr3_transition_matrix", "out1_size_report", "val2_report", "min4_similarity", "flt1_valid_facts", "flt6_parents", "val1_validate", "src4_read_inventory", "snk1_reload_group", "snk7_compact_nodes", "snk9_report_csv", "out3_new_motifs",
    "out4_reuse_values", "tri01_keyed_counts", "tri01_user_histories", "tri09_subtree_weights", "tri21_leaf_counts", "flt4_stored_pages", "flt8_indexed_inside", "tri01_reloaded_counts", "src1_lexicon_to_json", "tok1_decorated",
]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_optional_part():
    root = Path(entry.__file__).parent
    for path in (root / "sequora").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_imports_without_the_optional_part(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "sequora"):
        os.system(f"cp -r {root / name} {tmp_path}")
    os.system(f"mv {tmp_path}/sequora/llm {tmp_path}/gone") if (tmp_path / "sequora/llm").exists() else None
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0 and int(got.stdout) > 50, got.stderr


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 5


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in cur.description)
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    names = [d[0] for d in cur.description]
    want = sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr) == want
