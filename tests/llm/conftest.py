import os

import pytest

TABLES = "documents benchmark labels pages".split()


@pytest.fixture(scope="session")
def oracle():
    """Rows of a training-data query's SQL over the tables of a folder, columns by name."""
    duckdb = pytest.importorskip("duckdb")

    def run(sql, folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM "
                        f"read_parquet('{os.path.join(folder, t + '.parquet')}')")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        return sorted(names), as_rows(got.fetchall(), names)
    return run


def as_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)
