import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 20


def test_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when the subpackage and its pipeline are gone."""
    code = "import sys\nsys.modules['fernweave.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'hotspots_degree' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
