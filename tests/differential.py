"""Every query against its SQL on the driver's tables, as the driver compares them: python tests/differential.py [FOLDER] [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder):
    """'' if the rows are the same, else what differs."""
    df = query(spark, folder)
    a_names, a = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = sorted_rows([c[0] for c in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a != b:
        only_a, only_b = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
        return f"{len(a)} and {len(b)} rows; only here {only_a}; only there {only_b}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from wordtide.session import local_session

    folder, *wanted = sys.argv[1:] if sys.argv[1:2] and "/" in sys.argv[1] else ["/root/testdata/sf0.01", *sys.argv[1:]]
    spark = local_session()
    con, sql = duck(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            said = compare(spark, con, name, query, sql[name], folder) if name in sql else f"no SQL; {query(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
