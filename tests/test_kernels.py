import gc
import math

import numpy as np

from molecast.functions import chains
from molecast.functions.descriptors import overlap_of
from molecast.functions.kernels import TAKE, map_rows
from molecast.queries.kernels import corpus, ends, next_pairs
from molecast.sources.molecules import format_column, parse_column


def test_lines_are_dealt_over_tasks(spark, tmp_path):
    """A table of few bytes has many lines, so one file of it is no single task."""
    spark.range(1, 30_001).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() == 1
    lines = corpus(spark, str(tmp_path))
    sizes = lines.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 30_000 and sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 30_000 // 2


def test_few_rows_are_objects_at_once(spark):
    def kernel(row):
        asked = row["id"] % 500 == 0
        yield {"live": sum(type(x) is dict and x.keys() == {"id", "own_mark"} for x in gc.get_objects()) if asked else None}

    rows = spark.range(3000).coalesce(1).selectExpr("id", "array(id) AS own_mark")
    got = map_rows(rows, kernel, "live int").agg({"live": "max", "*": "count"}).first()
    assert got["count(1)"] == 3000 and got["max(live)"] <= 2 * TAKE


def test_kernels_after_each_other_share_a_worker(spark):
    lines = spark.createDataFrame([(0, "CC ethane"), (1, "C("), (2, "c1cc[nH]c1 pyrrole"), (3, None), (4, "CC(=O)[O-]\nC#N two")], "key long, line string")
    once = parse_column(lines, "smi", "line", "key long")
    again = parse_column(format_column(once, "sdf", keep="key long"), "sdf", "value", "key long")
    assert again._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    apart = format_column(once.select("key", "mol"), "sdf", keep="key long")
    assert apart._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 2
    want = parse_column(apart.select("*"), "sdf", "value", "key long")
    assert again.schema == want.schema
    facts = ("key", "mol.name", "mol.atoms.z", "mol.atoms.impl_h", "mol.bonds.bo", "mol.error")
    got = [sorted(map(repr, df.selectExpr(*facts).collect())) for df in (again, want)]
    assert got[0] == got[1] and len(got[0]) == 5


def test_chain_pairs_are_settled_once(monkeypatch):
    """Starts that meet go on from what is known; small and large tables give the same path."""
    rng, seen = np.random.default_rng(3), []

    def spy(x, y, d0, settle=chains._settle):
        seen.append((x.tobytes(), y.tobytes()))
        return settle(x, y, d0)

    monkeypatch.setattr(chains, "_settle", spy)
    for n, m in ((21, 21), (30, 17)):
        seen.clear()
        chains.align_chains(rng.normal(size=(n, 3)).cumsum(0), rng.normal(size=(m, 3)).cumsum(0))
        assert len(seen) == len(set(seen))
    for n, m in ((1, 1), (7, 12), (40, 33)):
        for gap in (-1.0, -0.6, 0.0):
            score = np.round(rng.uniform(0, 1, (n, m)), 1)
            assert chains._filled(score, gap) == chains._filled_by_diagonals(score, gap)


def test_overlap_of_many_positions():
    """The function of positions is the volume of all pairs of spheres, worked out one by one."""
    rng = np.random.default_rng(5)
    qr, tr, qt, tt = rng.uniform(0.5, 2, 5), rng.uniform(0.5, 2, 4), [6, 7, 6, 8, 1], [6, 8, 8, 1]
    shared = overlap_of(qr, qt, tr, tt)
    for scale in (0.1, 1.0, 3.0):
        q, t = rng.normal(0, scale, (5, 3)), rng.normal(0, scale, (4, 3))
        total = 0.0
        for a, i, x in zip(qr, qt, q, strict=True):
            for b, j, y in zip(tr, tt, t, strict=True):
                d = math.dist(x, y)
                v = 0.0 if d >= a + b else 4 / 3 * math.pi * min(a, b) ** 3 if d <= abs(a - b) else math.pi / 12 * (a + b - d) ** 2 * (d + 2 * (a + b) - 3 / d * (a - b) ** 2)
                total += v * (1.0 if i == j else 0.7)
        assert math.isclose(shared(q, t), total, rel_tol=1e-12, abs_tol=1e-12)


def test_costly_kernels_are_dealt_finely(spark, tmp_path):
    """20,000 conformers are about 5 MB: too few bytes for a task of their own, too many steps for one."""
    rows = spark.range(20_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(rand(7) AS FLOAT)) AS embedding")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    size = sum(p.stat().st_size for p in (tmp_path / "embeddings.parquet").glob("*.parquet"))
    for df in (next_pairs(spark, str(tmp_path)), ends(spark, str(tmp_path), lambda a: (a, a))):
        assert df.rdd.getNumPartitions() >= max(spark.sparkContext.defaultParallelism, size >> 18)
