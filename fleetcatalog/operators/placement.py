"""How many nodes a bundle could run on.

Nodes with enough of every amount are counted by divide and conquer. A group of nodes and demands is
cut at quantiles of the nodes' values, each border a bucket of its own and the open spaces between
them buckets. A node that has enough is sorted by the first amount in which it shares an open bucket with
the demand: it then lies in that bucket's slab, and before it only buckets are compared; or it shares
none, and only buckets are compared at all. So a group of N nodes becomes slabs of N / K and one
group of cells, in which equal nodes are one, and a row goes into as many groups as there are amounts,
and one more. Groups whose pairs can be compared in a task are; the others are cut again. A value that very
many nodes have is a border, and never in a slab.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import durable, prefixed, same

# Pairs that one task compares, and nodes that it holds for that.
PAIRS, HELD = 1 << 30, 1 << 20
# So few nodes stand beside any share of a group's demands; never less than what a cut makes fewer.
FEW = 1 << 12
# Pairs compared at once.
TILE = 1 << 22
# Borders of an amount that are sought at most, and nodes that a cell stands for at least.
BORDERS, CELL = 256, 8


def _role_sets(df: DataFrame) -> DataFrame:
    """``(set, roles)``: the distinct role sets, each with a number that is the same for equal sets."""
    return df.select("_roles").distinct().select(F.xxhash64("_roles").alias("set"), F.col("_roles").alias("roles"))


def _related(demands: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(asking, holding)``: role sets of demands and of nodes that have a role in common; a set without roles takes any."""
    asked, held = durable(_role_sets(demands)), durable(_role_sets(profiles))
    by_role = asked.select(F.col("set").alias("asking"), F.explode("roles").alias("role"))
    shared = by_role.join(held.select(F.col("set").alias("holding"), F.explode("roles").alias("role")), "role")
    # Equal sets are one, so there is one set without roles at most, and it adds a row per node set.
    free = asked.filter(F.size("roles") == 0).select(F.col("set").alias("asking"), F.lit(1).alias("_one"))
    any_node = free.join(held.select(F.col("set").alias("holding"), F.lit(1).alias("_one")), "_one")
    return shared.select("asking", "holding").unionByName(any_node.select("asking", "holding")).distinct()


def _compared(key: tuple, rows: pa.Table) -> pa.Table:
    """``(id, n)`` for the demands of a group: how many of its nodes have at least their coordinates, tile by tile."""
    of_node = rows["of_node"].to_numpy()
    width = len(rows["place"][0])
    places = rows["place"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    held, amount = places[of_node], rows["n"].to_numpy()[of_node].astype(np.float64)
    asked, ids = places[~of_node], rows["id"].to_numpy(zero_copy_only=False)[~of_node].astype(np.int64)
    found, step = np.zeros(len(asked)), max(1, TILE // max(1, len(held)))
    for at in range(0, len(asked) if len(held) else 0, step):
        some = asked[at : at + step]
        fits = held[:, 0] >= some[:, :1]
        for d in range(1, width):
            fits &= held[:, d] >= some[:, d : d + 1]
        found[at : at + step] = fits @ amount
    return pa.table({"id": ids, "n": found.astype(np.int64)})


def _cut(rows: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """The rows of groups too large to compare, in the groups they are cut into; ``sizes`` has ``of`` and ``nodes`` of each."""
    shares = F.lit([i / (BORDERS + 1) for i in range(1, BORDERS + 1)])
    nodes = rows.filter("of_node")
    sought = nodes.groupBy(F.col("group").alias("of")).agg(*[F.percentile_approx(F.col("place")[d], shares).alias(f"q{d}") for d in range(width)])
    # Fewer borders for a group of fewer nodes, so that there are far fewer cells than nodes.
    wanted = F.floor(F.pow(F.col("nodes") / CELL, F.lit(1 / width)) / 2)
    step = F.ceil(BORDERS / F.greatest(F.lit(2), F.least(F.lit(BORDERS), wanted)))
    borders = F.array(*[F.array_distinct(F.filter(f"q{d}", lambda x, i: i % F.col("step") == F.floor(F.col("step") / 2))) for d in range(width)])
    known = sought.join(sizes, "of").withColumn("step", step).select("of", borders.alias("borders"))

    def code(x: Column, of: Column) -> Column:
        """Odd for a border, even for the open space below, between or above."""
        return (F.size(F.filter(of, lambda b: b < x)) * 2 + F.array_contains(of, x).cast("int")).cast("double")

    placed = rows.join(known, F.col("group") == F.col("of")).withColumn("code", F.zip_with("place", "borders", code))
    # What a node's code must reach: a demand's own border will do, of its own open space only what is above.
    reach = F.when(F.col("of_node"), F.col("code")).otherwise(F.transform("code", lambda c: F.when(c % 2 == 0, c + 1).otherwise(c)))
    placed = placed.withColumn("reach", reach)

    def part(name: Column, coordinates: Column) -> Column:
        return F.struct(F.concat("group", F.lit("/"), name).alias("group"), coordinates.alias("place"))

    slabs = [
        F.when(
            F.col("code")[d] % 2 == 0,
            part(F.concat(F.lit(f"{d}."), F.col("code")[d].cast("int").cast("string")), F.concat(F.slice("reach", 1, d), F.slice("place", d + 1, width))),
        )
        for d in range(width)
    ]
    parts = F.filter(F.array(*slabs, part(F.lit("c"), F.col("reach"))), lambda x: x.isNotNull())
    out = placed.select("of_node", "id", "n", F.inline(parts))
    # Demands keep their ids; nodes in one cell are one.
    merged = out.filter("of_node").groupBy("group", "place").agg(F.sum("n").alias("n"))
    return out.filter("NOT of_node").unionByName(merged.withColumn("of_node", F.lit(True)), allowMissingColumns=True).select(*rows.columns)


def dominating(rows: DataFrame, width: int, pairs: int = PAIRS, held: int = HELD, few: int = FEW) -> DataFrame:
    """``(id, candidates)``: for each demand the nodes of its group with at least its amounts; demands without any are left out.

    ``rows`` is ``(group, of_node, id, place, n)``: a demand has an id and a node has a count, both have
    as many doubles in ``place`` as ``width`` says.
    """
    # Two borders at least give five codes an amount; from here on there are fewer cells than nodes.
    few, found = max(few, CELL * 5**width), []
    while True:
        rows = durable(rows.select("group", "of_node", "id", "place", "n"))
        count = lambda x: F.count_if(x).alias
        sizes = rows.groupBy(F.col("group").alias("of")).agg(count(F.col("of_node"))("nodes"), count(~F.col("of_node"))("demands"))
        sizes = sizes.filter("nodes > 0 AND demands > 0")
        shares = F.ceil(F.col("nodes") * F.col("demands") / pairs).cast("int")
        fine = (F.col("nodes") <= few) | ((F.col("nodes") <= held) & (shares <= 1))
        sizes = durable(sizes.select("of", "nodes", shares.alias("shares"), (~fine).alias("large")))
        small = rows.join(sizes.filter("NOT large").select("of", "shares"), F.col("group") == F.col("of"))
        # A demand is in one share of its group, and the few nodes in each.
        own = F.array(F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        every = F.sequence(F.lit(0), F.col("shares") - 1)
        dealt = small.withColumn("share", F.explode(F.when(F.col("of_node"), every).otherwise(own)))
        found.append(dealt.select("group", "share", "of_node", "id", "place", "n").groupBy("group", "share").applyInArrow(_compared, "id long, n long"))
        large = sizes.filter("large").select("of", "nodes")
        if large.isEmpty():
            break
        rows = _cut(rows.join(large.select("of"), F.col("group") == F.col("of"), "left_semi"), large, width)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("id").agg(F.sum("n").alias("candidates"))


def placement_candidates(
    bundles: DataFrame,
    nodes: DataFrame,
    bundle: str,
    dims: Sequence[str],
    roles: str = "roles",
) -> DataFrame:
    """``(bundle, candidates)``: nodes with at least the bundle's amount of each of ``dims`` and a common role.

    Role sets are numbers; those that share a role are found once, whatever the count of roles, and the
    demands of one set are a group with the nodes of all sets related to it (see :func:`dominating`).
    Equal nodes, and equal demands, are one. Amounts are compared as doubles, NaN as infinity; a
    bundle that lacks one has no candidates, and a node that lacks one is none. Any number of
    amounts will do.
    """
    clean = F.array_sort(F.array_distinct(F.coalesce(F.col(roles), F.array().cast("array<string>"))))
    doubles = F.array(*[F.when(F.isnan(F.col(d).cast("double")), F.lit(float("inf"))).otherwise(F.col(d).cast("double")) for d in dims])
    profile = ["_place", "_roles"]
    whole = F.forall("_place", lambda x: x.isNotNull())
    profiles = nodes.select(doubles.alias("_place"), clean.alias("_roles")).filter(whole).groupBy(*profile).agg(F.count(F.lit(1)).alias("_n"))
    wanted = bundles.select(bundle, doubles.alias("_place"), clean.alias("_roles"))
    demands = wanted.select(*profile).filter(whole).distinct()
    both = profiles.withColumn("_of_node", F.lit(True)).unionByName(demands.withColumn("_of_node", F.lit(False)), allowMissingColumns=True)
    # The number stands for a row until the end; it is written down with it and stays the same.
    both = durable(both.withColumn("_id", F.monotonically_increasing_id()))
    related = _related(both.filter("NOT _of_node"), both.filter("_of_node"))
    held = both.filter("_of_node").join(related, F.xxhash64("_roles") == F.col("holding")).withColumn("_set", F.col("asking"))
    asked = both.filter("NOT _of_node").withColumn("_set", F.xxhash64("_roles"))
    row = [F.col("_set").cast("string").alias("group"), F.col("_of_node").alias("of_node"), F.col("_id").alias("id"), F.col("_place").alias("place"), F.col("_n").alias("n")]
    found = dominating(held.select(*row).unionByName(asked.select(*row)), len(dims))
    counted = both.filter("NOT _of_node").join(found, F.col("_id") == F.col("id")).select(*profile, "candidates")
    counted = prefixed(counted, profile, "_p_")
    joined = wanted.join(counted, same([(F.col(c), F.col("_p_" + c)) for c in profile]), "left")
    return joined.select(bundle, F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


def placeable(candidates: DataFrame) -> DataFrame:
    """Bundles that some node can take."""
    return candidates.filter(F.col("candidates") > 0)


def unplaceable(candidates: DataFrame) -> DataFrame:
    """Bundles that no node can take."""
    return candidates.filter(F.col("candidates") == 0)
