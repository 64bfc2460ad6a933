import math
import os
from decimal import Decimal

import duckdb
import pytest

from veridicta import queries

SF = "/root/testdata/sf0.001"
FAST = ["a4_scan", "b2_normalize", "b9_block_types", "b13_sections", "b14_context", "c7_class_balance", "d4_topics", "d5_actions", "d7_provenance", "e7_reconcile", "e9_kappa", "f8_fusion", "f12_semantic_loss", "f17_class_weights", "g5_kpi_values", "g6_evidence", "h5_tfidf_candidates", "h12_link_window", "j5_sentence_risk", "j11_bank_years", "k3_theoretical", "k9_spearman", "k12_formulas"]


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, int | float | bool | Decimal) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.Q[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    c = con.execute(queries.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(r[names.index(k)]) for k in cols) for r in c.fetchall()), key=str)


def test_entry_stands_without_the_other_subpackage(tmp_path):
    """The entry module imports, and lists the library's own queries, where the optional parts are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "veridicta", tmp_path / "veridicta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j11_bank_years' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
