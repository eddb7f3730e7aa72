import math
import sys

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


from textloom import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert cols
        return
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "textloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "textloom.llm" in p.read_text()] and "textloom" in sys.modules
