"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math
import random
from collections import Counter

import pytest
from conftest import DATA

from scriptorium.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r.role for r in entry.entry(spark).collect()} <= {"user", "assistant", "system"}


def test_ranks_of_means_at_half_a_digit_equal_sql_on_one_thread(spark, tmp_path):
    """Means that end in half a sixth digit, in rows of three files: an order of its own, partial sums or rounding by printed digits give other digits."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, rows = random.Random(5), []
    for run in range(40):
        hundredths = [rng.randrange(9) for _ in range(127)]
        rows += [(run, h / 100, 0.05) for h in [*hundredths, 1 + sum(hundredths) % 2 * 7]]
        assert (sum(round(t * 100) for _, t, _ in rows[-128:])) % 2
    rows += [(40, rng.random() * 1e15, rng.random()) for _ in range(300)] + [(41, rng.random(), rng.random()) for _ in range(300)]
    rows += [(42, None, rng.randrange(9) / 100) for _ in range(128)] + [(43, None, None)] * 3 + [(None, 0.05, 0.05), (None, None, 0.01)]
    rng.shuffle(rows)
    (tmp_path / "lineitem.parquet").mkdir()
    for i, part in enumerate((rows[:700], rows[700:2500], rows[2500:])):
        run, tax, discount = ([r[c] for r in part] for c in range(3))
        pq.write_table(pa.table({
            "l_suppkey": pa.array(run, pa.int64()), "l_orderkey": pa.array(range(len(part)), pa.int64()), "l_linenumber": pa.array([1] * len(part), pa.int32()), "l_discount": pa.array(discount, pa.float64()),
            "l_tax": pa.array(tax, pa.float64()), "l_quantity": pa.array([3.0] * len(part), pa.float64()),
        }), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT run, wer, cer, rank FROM ({ORACLES['rank_candidates']})").fetchall()}
    got = QUERIES["rank_candidates"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 45
    assert {r.run: (r.wer, r.cer, r["rank"]) for r in got} == want
