"""Every registered query against its DuckDB SQL twin on the smallest data
(the driver runs the same check at sf0.01)."""
import subprocess
import sys
from pathlib import Path

import pytest

from testdata import SF_SMOKE

ROOT = Path(__file__).resolve().parents[1]


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.slow
def test_all_queries_match_oracle():
    proc = subprocess.run([sys.executable, str(ROOT / "tools" / "oracle_check.py"), SF_SMOKE],
                          capture_output=True, text=True, timeout=1800)
    lines = [ln for ln in proc.stdout.splitlines() if ln.startswith(("MATCH", "NO-ORACLE", "MISMATCH"))]
    assert proc.returncode == 0, proc.stdout[-3000:] + proc.stderr[-3000:]
    assert lines[-1] == "MISMATCH: []"
