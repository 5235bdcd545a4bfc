"""Points, conformers, atoms and bonds derived from the embeddings table, for tests and benchmarks of the operators.

A conformer is the first 63 values of an embedding as 21 atoms. Everything about
one conformer is derived within its row, so that no derivation shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bonds join atoms at most this far apart.
BOND = 0.1371
#: Elements of atoms, by (atom_id + vec_id) mod 5; their radii at the embeddings' scale of 1/12.
CYCLE = (6, 7, 8, 16, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, z: the first three values of each embedding."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *(e[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, atoms array<struct<x, y, z>>: a conformer to a row."""
    e = F.col("embedding")
    at = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*(F.get(e, 3 * i + k).cast("double").alias(c) for k, c in enumerate("xyz"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", at.alias("atoms"))


def conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, atom_id, x, y, z."""
    return molecules(spark, sf_dir).select("vec_id", F.posexplode("atoms").alias("atom_id", "a")).select("vec_id", "atom_id", "a.x", "a.y", "a.z")


def with_element(atoms: DataFrame) -> DataFrame:
    """Adds elem, the atomic number."""
    return atoms.withColumn("elem", F.array(*map(F.lit, CYCLE))[((F.col("atom_id") + F.col("vec_id")) % 5).cast("int")])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, src < dst, d2: the atom pairs of each conformer, made within its row."""
    one = molecules(spark, sf_dir).select("vec_id", "atoms", F.posexplode("atoms").alias("src", "a"))
    two = one.filter(F.col("src") < F.size("atoms") - 1).select("vec_id", "src", "a", "atoms", F.explode(F.sequence(F.col("src") + 1, F.size("atoms") - 1)).alias("dst"))
    b = F.get("atoms", F.col("dst"))
    d = [F.col("a")[c] - b[c] for c in "xyz"]
    return two.select("vec_id", "src", "dst", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"))


def bonded(spark: SparkSession, sf_dir: str, cutoff: float = BOND) -> DataFrame:
    """vec_id, atoms, bonds array<struct<src, dst>>: conformers with their bonds, found within the row."""
    last = F.size("atoms") - 1

    def near(i: Column) -> Column:
        a = F.get("atoms", i)

        def close(j: Column) -> Column:
            d = [a[c] - F.get("atoms", j)[c] for c in "xyz"]
            return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= cutoff * cutoff

        return F.transform(F.filter(F.sequence(i + 1, last), close), lambda j: F.struct(i.alias("src"), j.alias("dst")))

    return molecules(spark, sf_dir).select("vec_id", "atoms", F.flatten(F.transform(F.sequence(F.lit(0), last - 1), near)).alias("bonds"))


def bonds(spark: SparkSession, sf_dir: str, cutoff: float = BOND) -> DataFrame:
    """vec_id, src, dst, d2 of the pairs within the cutoff."""
    return pairs(spark, sf_dir).filter(F.col("d2") <= cutoff * cutoff)


#: The same derivations in SQL.
SQL = f"""
points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
conformers AS (SELECT vec_id, CAST(i AS INT) AS atom_id, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(21) t(i)),
atoms AS (SELECT *, [6, 7, 8, 16, 1][1 + (atom_id + vec_id) % 5] AS elem FROM conformers),
pairs AS (SELECT a.vec_id, a.atom_id AS src, b.atom_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM conformers a JOIN conformers b ON a.vec_id = b.vec_id AND a.atom_id < b.atom_id),
bonds AS (SELECT * FROM pairs WHERE d2 <= {BOND} * {BOND}),
both_ways AS (SELECT vec_id, src, dst FROM bonds UNION ALL SELECT vec_id, dst, src FROM bonds)
"""
