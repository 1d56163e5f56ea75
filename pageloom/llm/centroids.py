"""Centroid clustering in JVM expressions: integer distances to literal centroids, column sums for the next ones.

A component ``x`` becomes the integer ``floor(scale * x)``, so sums are exact and every run and every order of rows gives the
same clusters. ``zip_with`` and ``aggregate`` compute the distance to each centroid, which stands in the plan as a literal
array; ``array_min`` over ``(distance, number)`` structs chooses. One sum for each component and a count, combined before the
shuffle, give the next centroids: a round sends the driver one row for each centroid, whatever the size of the table, and a
common vector is no hot key. The table is scanned once for the first centroids (a top-k, no shuffle), once a round and
once for the result, which is written before the inertia is summed.

Only complete vectors are clustered: exactly ``dims`` components, none null, NaN or infinite. Others, null vectors included,
have no row in the result. Scaled components beyond a bound (2**27 for 64 dimensions) count as the bound, so that no distance
overflows; sums of distances beyond a long count as its greatest value. Repeated rows are clustered each for itself. A null
``vec_id`` is hashed as an empty one; equal hashes go by the vector. Fewer vectors than centroids give fewer centroids, an empty
table an empty result. Columns other than ``vec_id`` and the vector are not read.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import let
from pageloom.llm.frames import written

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
LONGEST = 2**63 - 1
Centroids = list[list[int]]


def bound(dims: int) -> int:
    """Largest component for which the distance of two vectors stays within a long."""
    return 2 ** ((62 - math.ceil(math.log2(max(dims, 2)))) // 2 - 1)


def integer_vectors(rows: DataFrame, column: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """``vec_id`` and the integer vector ``v`` of every complete vector."""
    most = bound(dims)
    complete = f"size(`{column}`) = {dims} and forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    whole = f"transform(`{column}`, x -> cast(floor(least(greatest({scale} * cast(x as double), -{most}D), {most}D)) as bigint))"
    return rows.filter(complete).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "1") -> Centroids:
    """The k vectors with the smallest SHA-256 of ``salt:vec_id``, in that order. k rows reach the driver."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def _literal(values: list, kind: str = "L") -> str:
    return "array(" + ", ".join(f"{v}{kind}" if kind else f"'{v}'" for v in values) + ")"


def nearest(centroids: Centroids, column: str = "v"):
    """Struct (distance, cluster) of the nearest centroid; of equal distances the smaller number.

    A distance is the two squared lengths less twice the product, in whole numbers: the vector's length is found once, the
    centroid's is a literal, so the lambda over the components only multiplies.
    """
    held = "array(" + ", ".join(f"named_struct('v', {_literal(c)}, 'squares', {sum(x * x for x in c)}L)" for c in centroids) + ")"
    product = f"aggregate(zip_with(`{column}`, c.v, (x, y) -> x * y), 0L, (s, p) -> s + p)"
    least = f"array_min(transform({held}, (c, i) -> named_struct('distance', own + c.squares - 2L * {product}, 'cluster', i)))"
    return F.expr(let(f"aggregate(`{column}`, 0L, (s, x) -> s + x * x)", "own", least))


def next_centroids(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Floor of the mean of each centroid's vectors, by exact integers; a centroid without vectors stays."""
    dims = len(centroids[0])
    # A sum of longs could overflow only beyond 2**36 vectors that all stand at the bound.
    sums = [F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(dims)]
    chosen = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "v")
    out = list(centroids)
    for row in chosen.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(dims)]
    return out


def fit(vectors: DataFrame, k: int, rounds: int, salt: str = "1") -> Centroids:
    """Centroids after some rounds from the drawn ones; empty where there are no vectors."""
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(vectors, centroids)
    return centroids


def _saturated(total) -> F.Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def cluster(rows: DataFrame, column: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, salt: str = "1") -> DataFrame:
    """A row for each complete vector: its cluster, squared distance, the distances summed over its cluster and over all, and the
    SHA-256 of its centroid's components joined by commas. Lists in the plan have k entries."""
    vectors = integer_vectors(rows, column, dims, scale)
    centroids = fit(vectors, k, rounds, salt)
    if not centroids:
        return rows.sparkSession.createDataFrame([], RESULT)
    # The struct is written as it is: asking for its fields first would compute it for each.
    assigned = written(vectors.select("vec_id", nearest(centroids).alias("near")), "assigned").select("vec_id", "near.cluster", "near.distance")
    sums = dict(assigned.groupBy("cluster").agg(_saturated(F.sum(F.col("distance").cast("decimal(19,0)"))).alias("d")).collect())
    inertia = _literal([sums.get(c, 0) for c in range(len(centroids))])
    digests = _literal([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], "")
    return assigned.select(
        "vec_id", "cluster", "distance", F.expr(f"element_at({inertia}, cluster + 1)").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"), F.expr(f"element_at({digests}, cluster + 1)").alias("centroid_sha256"),
    )
