"""Every query against its SQL on the smallest tables, columns and rows."""

import pytest

import __spark_entry__ as entry
from tessera import catalogue

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return "nan" if isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name not in catalogue.ORACLE_SQL:
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    theirs = sorted(str([plain(dict(zip(names, r, strict=True))[k]) for k in key]) for r in got.fetchall())
    assert sorted(str([plain(r[k]) for k in key]) for r in rows) == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_llm_package():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    code = "import sys\nfor x in ('tessera.llm',): sys.modules[x] = None\nimport tessera.catalogue, tessera.plans.sweep, tessera.sources.midi, tessera.sources.files, tessera.streaming.corpus"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
