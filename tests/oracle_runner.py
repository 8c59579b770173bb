"""Runs a registered query and its oracle and compares them the strict way.

Columns are matched by name, types by their Arrow type, rows as a multiset.
"""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(table: pa.Table) -> tuple[dict[str, str], list[tuple]]:
    table = table.select(sorted(table.column_names))
    types = {f.name: str(f.type).replace("large_", "").replace("[ns]", "[us]") for f in table.schema}
    rows = [tuple(r.values()) for r in table.to_pylist()]
    return types, sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(table: pa.Table, con, sql: str) -> list[str]:
    """Differences between a Spark result and the oracle's; empty means equal."""
    got_types, got = _plain(table)
    want_types, want = _plain(con.sql(sql).to_arrow_table())
    problems = []
    if got_types != want_types:
        diff = {k: (got_types.get(k), want_types.get(k)) for k in got_types | want_types
                if got_types.get(k) != want_types.get(k)}
        problems.append(f"types spark/oracle: {diff}")
    if len(got) != len(want):
        problems.append(f"rows spark {len(got)} oracle {len(want)}")
    bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    if bad:
        problems.append(f"{len(bad)} of {len(got)} rows differ, columns {sorted(got_types)}: {bad[:2]}")
    return problems


def main(argv: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from wattlake.session import build_session

    sf_dir = f"/root/testdata/{argv[0]}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if any(n.startswith(p) for p in argv[1:])] if len(argv) > 1 else list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                table = df.toArrow()
                n = f"spark {time.time() - start:.1f}s, {table.num_rows} rows"
                problems = compare(table, con, oracles[name])
            else:
                problems, n = [], f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            problems, n = [f"{type(exc).__name__}: {str(exc)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {n}", flush=True)
        for p in problems:
            print("     ", p[:1800], flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
