"""Order-free comparison of a Spark result and a DuckDB result."""


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([None if v != v else plain(v) for v in (r[i] for i in order)]) for r in records)


def assert_same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
