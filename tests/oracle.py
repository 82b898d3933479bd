"""Runs registered queries beside their SQL and compares the rows.

    python -m tests.oracle /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def _sort_key(row):
    return tuple((v is None, str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)) for v in row)


def _equal(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(got, db, sql: str) -> str | None:
    """None when rows agree, else a short description of the first difference."""
    relation = db.sql(sql)
    names = sorted(relation.columns)
    if names != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {names}"
    here, there = dict(got.dtypes), dict(zip(relation.columns, map(str, relation.types)))
    odd = {n: (here[n], there[n]) for n in names if TYPES.get(here[n]) != there[n]}
    if odd:
        return f"types {odd}"
    mine = sorted((tuple(r[n] for n in names) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=_sort_key)
    theirs = sorted((tuple(r) for r in relation.select(*[f'"{n}"' for n in names]).fetchall()), key=_sort_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    exact = 0
    for a, b in zip(mine, theirs):
        if not all(_equal(x, y) for x, y in zip(a, b)):
            return f"{names}: {a} != {b}"
        exact += a == b
    if exact != len(mine):
        print(f"      note: {len(mine) - exact} of {len(mine)} rows not bit-identical")
    return None


def main(argv: list[str]) -> int:
    from gridspark.plans import ORACLES, QUERIES, load
    from tests.conftest import make_session

    load()
    spark = make_session()
    db = connect(argv[0])
    failed = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            got = fn(spark, argv[0])
            if name in ORACLES:
                problem = compare(got, db, ORACLES[name])
            else:
                problem = None if got.count() >= 0 else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.2f}s {problem or ''}", flush=True)
        failed += bool(problem)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
