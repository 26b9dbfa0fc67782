"""Every query of the core runs on the small tables, and agrees with its SQL where it has one."""

import pytest

from mirador.plans import catalog


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(repr(round(v, 5)) if isinstance(v, float) else repr(v) for v in r) for r in df.select(*cols).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    got = rows(df)
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(want.columns) == sorted(df.columns)
        want = want[sorted(want.columns)].astype(object).where(lambda x: x.notna(), None)
        want = sorted((tuple(repr(round(v, 5)) if isinstance(v, float) else repr(v) for v in r) for r in want.itertuples(index=False)), key=str)
        assert len(got) == len(want)
        clean = lambda rs: [tuple(x.replace(".0'", "'").removesuffix(".0") for x in r) for r in rs]
        assert clean(got) == clean(want)
