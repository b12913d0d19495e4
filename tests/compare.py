"""Run registered queries against their SQL twins: python tests/compare.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def sql_tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(str(r[i]) for i in order) for r in rows)))


def difference(df, con, sql):
    """None if the two results hold the same rows, else what differs."""
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_rows = cur.fetchall()
    got_cols, got = canonical(df.columns, got_rows)
    want_cols, want = canonical([c[0] for c in cur.description], want_rows)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {got_cols}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main():
    import __spark_entry__ as E
    from pitchrank.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_tables(sf_dir)
    names = sys.argv[2:] or list(E.queries())
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = E.queries()[name](spark, sf_dir)
            sql = E.oracle_sql().get(name)
            said = difference(df, con, sql) if sql else f"no SQL, {len(df.collect())} rows"
            ok = said is None or not sql
        except Exception as e:  # report and go on
            said, ok = f"{type(e).__name__}: {str(e)[:600]}", False
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {time.time() - start:6.2f}s  {said or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
