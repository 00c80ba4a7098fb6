import subprocess
import sys

import pytest

from lodeline.llm import catalog
from tests.oracle import same, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    same(catalog.QUERIES[name](spark, SF), views(SF), catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['lodeline.llm'] = None\nimport lodeline.plans.catalog, lodeline.streaming.jobs, lodeline.sources.files"
    assert subprocess.run([sys.executable, "-c", code], cwd=".", capture_output=True).returncode == 0
