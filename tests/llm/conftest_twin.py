"""A query's rows against those of its SQL twin."""

import duckdb

TABLES = "documents embeddings benchmark labels conversations".split()


def twin(sql, sf_dir, frames=None):
    """The twin's rows as dictionaries; frames: tables in place of the folder's."""
    con = duckdb.connect()
    for t in TABLES:
        if frames and t in frames:
            con.register(t, frames[t].toArrow())
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con = con.execute(sql)
    names = [d[0] for d in con.description]
    return [dict(zip(names, r, strict=True)) for r in con.fetchall()]


def same(df, want):
    got = [r.asDict() for r in df.collect()]
    key = lambda r: tuple(str(r[k]) for k in sorted(r))
    assert not want or sorted(df.columns) == sorted(want[0])
    assert sorted(got, key=key) == sorted(want, key=key)
    return got
