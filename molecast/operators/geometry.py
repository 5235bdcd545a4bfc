"""Column expressions and row-local operators of geometry."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.chains import HELIX, HELIX_TOLERANCE, PAIRS, STRAND, STRAND_TOLERANCE, TURN_BELOW
from .spatial import AROUND, cells

#: 2 pi / phi^2
TURN = 2 * math.pi * 0.38196601125010515


def minus(a: Column, b: Column) -> list[Column]:
    return [a[c] - b[c] for c in "xyz"]


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def distance_squared(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return dot(d, d)


def cos_angle(a: Column, b: Column, c: Column) -> Column:
    """Cosine of the angle at b."""
    u, v = minus(a, b), minus(c, b)
    return dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))


def cos_dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cosine of the angle between the planes abc and bcd."""
    m, n = cross(minus(b, a), minus(c, b)), cross(minus(c, b), minus(d, c))
    return dot(m, n) / F.sqrt(dot(m, m) * dot(n, n))


def transform_points(df: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """x, y, z under a 4x4 affine matrix."""
    new = [sum((F.col(c) * v for c, v in zip("xyz", row, strict=False)), F.lit(float(row[3]))) for row in matrix[:3]]
    return df.withColumns({f"_{c}": e for c, e in zip("xyz", new, strict=True)}).withColumns({c: F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def fibonacci_lattice(spark: SparkSession, n: int) -> DataFrame:
    """i, x, y, z: n points spread evenly over the unit sphere."""
    i = F.col("i").cast("double")
    base = spark.range(n).select(F.col("id").cast("int").alias("i"))
    z = base.select("i", (F.lit(1 - 1 / n) - i * F.lit(2 / n)).alias("z"))
    return z.select("i", (F.sqrt(1 - F.col("z") * F.col("z")) * F.cos(i * TURN)).alias("x"), (F.sqrt(1 - F.col("z") * F.col("z")) * F.sin(i * TURN)).alias("y"), "z")


def secondary_structure(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ss (coil, helix, strand or turn) from the positions of five residues in a row; the outer two at either end are coil."""
    w = Window.partitionBy(key).orderBy(order)
    at = F.struct("x", "y", "z")
    p = [F.lag(at, 2).over(w), F.lag(at, 1).over(w), at, F.lead(at, 1).over(w), F.lead(at, 2).over(w)]
    wide = df.withColumns({f"_p{i}": c for i, c in enumerate(p)})
    d = [F.sqrt(distance_squared(F.col(f"_p{a}"), F.col(f"_p{b}"))) for a, b in PAIRS]
    wide = wide.withColumns({f"_d{i}": c for i, c in enumerate(d)})

    def near(refs: tuple, tolerance: float) -> Column:
        out = F.lit(True)
        for i, r in enumerate(refs):
            out = out & (F.abs(F.col(f"_d{i}") - r) < tolerance)
        return out

    ss = F.when(F.col("_p0").isNull() | F.col("_p4").isNull(), "coil").when(near(HELIX, HELIX_TOLERANCE), "helix").when(near(STRAND, STRAND_TOLERANCE), "strand").when(F.col("_d2") < TURN_BELOW, "turn").otherwise("coil")
    return wide.withColumn("ss", ss).drop(*(f"_p{i}" for i in range(5)), *(f"_d{i}" for i in range(6)))


def lens_volume(ra: Column, rb: Column, d: Column) -> Column:
    """Shared volume of two spheres: none beyond touching, the smaller sphere within the larger."""
    small = F.least(ra, rb)
    gap = ra + rb - d
    return F.when(gap <= 0, 0.0).when(d <= F.abs(ra - rb), small * small * small * (4 * math.pi / 3)).otherwise(F.lit(math.pi / 12) * gap * gap * (d + 2 * (ra + rb) - 3 / d * (ra - rb) * (ra - rb)))


def _areas_within(kind: StructType, probes: np.ndarray):
    """Rows (key, all) to rows of each sphere: its open probes and their area. Spheres of a molecule are tested against each other at once."""
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values
            x, r = (np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1), flat.field("r").to_numpy(zero_copy_only=False))
            free = np.zeros(len(r), np.int32)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                for at in range(lo, hi, 32):
                    own = slice(at, min(at + 32, hi))
                    place = x[own, None] + r[own, None, None] * probes
                    inside = np.square(place[:, :, None] - x[None, None, lo:hi]).sum(3) <= np.square(r[lo:hi])
                    inside[np.arange(inside.shape[0]), :, np.arange(at - lo, own.stop - lo)] = False
                    free[own] = (~inside.any(2)).sum(1)
            # The offsets of a slice don't start at 0; what is before and after isn't this batch's.
            used = slice(ends[0], ends[-1])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))))
            area = 4 * math.pi * np.square(r[used]) * free[used] / len(probes)
            yield pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), flat.field("i").slice(ends[0], ends[-1] - ends[0]), pa.array(free[used]), pa.array(area)], names)

    return run


def surface_area(spheres: DataFrame, lattice: int, key: str = "mol", ident: str = "id", largest: float | None = None, small: int = 256) -> DataFrame:
    """key, ident, open, area of spheres (key, ident, x, y, z, r): the probes of each sphere's lattice that no other sphere of the key holds.

    Molecules of up to ``small`` spheres are gathered into a row, and tested within it as
    arrays. In larger ones, spheres that can touch meet by key and cube, as in a range
    join, so that no molecule is paired with all of itself. ``largest`` is the largest
    radius, if known.
    """
    lattice_points = [(i, math.sqrt(1 - z * z) * math.cos(i * TURN), math.sqrt(1 - z * z) * math.sin(i * TURN), z) for i in range(lattice) for z in ((1 - 1 / lattice) - i * (2 / lattice),)]
    probes = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for _, x, y, z in lattice_points))
    own = spheres.select(key, ident, "x", "y", "z", "r")

    def blocked(p: Column) -> Column:
        at = {c: F.col(c) + F.col("r") * p[c] for c in "xyz"}
        return F.exists("near", lambda s: sum(((at[c] - s[c]) * (at[c] - s[c]) for c in "yz"), (at["x"] - s["x"]) * (at["x"] - s["x"])) <= s["r"] * s["r"])

    def areas(near: DataFrame) -> DataFrame:
        free = F.when(F.col("near").isNull() | (F.size("near") == 0), lattice).otherwise(F.size(F.filter(probes, lambda p: ~blocked(p))))
        return near.withColumn("open", free).select(key, ident, "open", (F.col("r") * F.col("r") * F.lit(4 * math.pi) * F.col("open") / lattice).alias("area"))

    def close(a: dict, b: dict) -> Column:
        d, reach = [a[c] - b[c] for c in "xyz"], a["r"] + b["r"]
        return dot(d, d) <= reach * reach

    def rows(part: DataFrame) -> DataFrame:
        each = part.groupBy(key).agg(F.collect_list(F.struct(F.col(ident).alias("i"), *(F.col(c).cast("double").alias(c) for c in "xyzr"))).alias("all"))
        kind = StructType([part.schema[key], part.schema[ident], StructField("open", IntegerType()), StructField("area", DoubleType())])
        return each.mapInArrow(_areas_within(kind, np.array([p[1:] for p in lattice_points])), kind)

    def cubes(part: DataFrame) -> DataFrame:
        reach = 2 * (largest if largest is not None else part.agg(F.max("r")).first()[0] or 1.0)
        a, b = cells(part, reach, AROUND).alias("a"), cells(part, reach).alias("b")
        met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "c0", "c1", "c2")]).filter((F.col(f"a.{ident}") != F.col(f"b.{ident}")) & close({c: F.col(f"a.{c}") for c in "xyzr"}, {c: F.col(f"b.{c}") for c in "xyzr"}))
        near = met.groupBy(F.col(f"a.{key}").alias(key), F.col(f"a.{ident}").alias(ident)).agg(F.collect_list(F.struct(*(F.col(f"b.{c}").alias(c) for c in "xyzr"))).alias("near"))
        return areas(part.join(near, [key, ident], "left"))

    sizes = own.groupBy(F.col(key).alias("__of")).agg(F.count("*").alias("__n"))
    most = sizes.agg(F.max("__n"), F.min("__n")).first()
    if (most[0] or 0) <= small:
        return rows(own)
    if most[1] > small:
        return cubes(own)
    large = sizes.filter(F.col("__n") > small)
    same = F.col(key) == F.col("__of")
    return rows(own.join(large, same, "left_anti")).unionByName(cubes(own.join(large, same, "left_semi")))
