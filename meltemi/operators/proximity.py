"""Join by distance: all pairs inside a radius, or the nearest partners."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.geo import EARTH_RADIUS_NM, distance_nm, lat_reach_deg, lon_reach_deg
from meltemi.session import settled

SALTS = 8
# Half the way around the globe: nothing is farther.
GLOBE_NM = 10_900.0
GLOBE_NM_PER_DEGREE = EARTH_RADIUS_NM * pi / 180.0


# Keeps a point exactly on the rim inside the box when degrees are rounded.
_SLACK_DEG = 1e-7


def _grid(radius_nm: float) -> tuple[int, float]:
    """(cells around the globe, cell width in degrees): a whole number of cells, each no narrower than the radius."""
    turn = max(1, int(360.0 // max(lat_reach_deg(radius_nm), 0.01)))
    return turn, 360.0 / turn


def _cell(lat: str, lon: str, turn: int, cell: float) -> Column:
    x = F.pmod(F.floor((F.col(lon) + 180.0) / cell), F.lit(turn))
    return F.struct(F.floor(F.col(lat) / cell).alias("y"), x.alias("x"))


def _cells_around(lat: str, lon: str, radius_nm: float, turn: int, cell: float) -> Column:
    """All grid cells that the box around a circle touches; longitudes wrap around."""
    dlat = lat_reach_deg(radius_nm) + _SLACK_DEG
    dlon = lon_reach_deg(lat, radius_nm) + _SLACK_DEG
    ys = F.sequence(F.floor((F.col(lat) - dlat) / cell), F.floor((F.col(lat) + dlat) / cell))
    west = F.floor((F.col(lon) + 180.0 - dlon) / cell)
    east = F.floor((F.col(lon) + 180.0 + dlon) / cell)
    xs = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + F.lit(turn))), lambda x: F.pmod(x, F.lit(turn))))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def within_radius(
    left: DataFrame,
    right: DataFrame,
    radius_nm: float,
    *,
    left_at: tuple[str, str] = ("latitude", "longitude"),
    right_at: tuple[str, str] = ("latitude", "longitude"),
    salts: int = SALTS,
    name: str = "distance_nm",
) -> DataFrame:
    """Every pair at most ``radius_nm`` apart, with its distance. Column names must not collide.

    Each right row is listed under the grid cells its circle can reach, each left row under its own
    cell, so the join is on equality. Left rows of one crowded cell are spread over ``salts`` tasks.
    """
    turn, cell = _grid(radius_nm)
    (la, lo), (ra, ro) = left_at, right_at
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    l = left.where(F.col(la).isNotNull() & F.col(lo).isNotNull()).withColumn("_cell", _cell(la, lo, turn, cell)).withColumn("_salt", salt)
    r = right.where(F.col(ra).isNotNull() & F.col(ro).isNotNull())
    r = r.withColumn("_cell", F.explode(_cells_around(ra, ro, radius_nm, turn, cell)))
    r = r.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    pairs = l.join(r, ["_cell", "_salt"]).withColumn(name, distance_nm(la, lo, ra, ro))
    return pairs.where(F.col(name) <= radius_nm).drop("_cell", "_salt")


def count_within(
    left: DataFrame,
    right: DataFrame,
    radius_nm: float,
    *,
    left_id: str,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
) -> DataFrame:
    """left_id, how many right rows lie within the radius, and the least distance (NULL when none does).

    Pairs are formed between distinct positions only and are added up where they arise.
    """
    (la, lo), (ra, ro) = left_at, right_at
    spots = left.where(F.col(la).isNotNull() & F.col(lo).isNotNull()).select(la, lo).distinct()
    weights = right.where(F.col(ra).isNotNull() & F.col(ro).isNotNull()).groupBy(ra, ro).agg(F.count("*").alias("_w"))
    pairs = within_radius(spots, weights, radius_nm, left_at=left_at, right_at=right_at)
    sums = pairs.groupBy(la, lo).agg(F.sum("_w").alias("n"), F.min("distance_nm").alias("nearest_nm"))
    return left.select(left_id, la, lo).join(sums, [la, lo], "left").select(left_id, F.coalesce("n", F.lit(0)).alias("n"), "nearest_nm")


# ---- nearest partners: a tree of cells over the targets, searched level by level ----

#: Levels of a step (64 cells below each), the deepest level (0.00002 degrees wide), and the most targets of a cell that is not cut further.
STEP, DEPTH, LEAF = 3, 24, 32
#: Up to this level a tree has at most 64^3 cells below its parents, whatever the data.
_FEW_LEVEL = 6
_SLACK_NM = 1e-6
_SIDE = 1 << DEPTH


def _spot_cell(lat: str, lon: str, level: Column) -> Column:
    """Number of the cell of a level that a position lies in: level, row from the south, column from the date line."""
    y = F.least(F.floor((F.col(lat) + 90.0) / 180.0 * _SIDE), F.lit(_SIDE - 1)).cast("bigint")
    x = F.least(F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / 360.0 * _SIDE), F.lit(_SIDE - 1)).cast("bigint")
    wide = F.pow(F.lit(2.0), F.lit(DEPTH) - level).cast("bigint")
    return (level.cast("bigint") * _SIDE + F.floor(y / wide)) * _SIDE + F.floor(x / wide)


def _parent(cell: Column) -> Column:
    wide = 1 << STEP
    level, y, x = F.floor(cell / (_SIDE * _SIDE)), F.floor(cell / _SIDE) % _SIDE, cell % _SIDE
    return ((level - STEP) * _SIDE + F.floor(y / wide)) * _SIDE + F.floor(x / wide)


def _box_distance(lat: str, lon: str) -> Column:
    """Least distance of a position from a cell (``south``, ``north``, ``west``, ``east``).

    Within the cell's longitudes it is the way along the meridian. Elsewhere the nearest point lies on one of the two meridian edges: where the great circle at right angles meets the edge, if it does, else at
    an end of it.
    """
    inside = F.pmod(F.col(lon) - F.col("west"), F.lit(360.0)) <= F.col("east") - F.col("west")
    straight = F.greatest(F.col("south") - F.col(lat), F.col(lat) - F.col("north"), F.lit(0.0)) * F.lit(GLOBE_NM_PER_DEGREE)

    def edge(at: str) -> Column:
        turn = F.radians(F.col(at) - F.col(lon))
        foot = F.degrees(F.atan2(F.sin(F.radians(F.col(lat))), F.cos(F.radians(F.col(lat))) * F.cos(turn)))
        onto = F.least(F.greatest(foot, F.col("south")), F.col("north"))
        return F.least(*[distance_nm(lat, lon, e, F.col(at)) for e in (onto, F.col("south"), F.col("north"))])

    return F.when(inside, straight).otherwise(F.least(edge("west"), edge("east"))) - _SLACK_NM


def target_tree(targets: DataFrame, right_id: str, right_at: tuple[str, str]) -> DataFrame:
    """Rows (``parent``, ``level``, ``cell``, box, id, position) over distinct positions: what lies below each cell of the tree.

    Below a cell with more than 32 targets lie its occupied cells three levels down, each with one of its targets; below any other cell lie the targets themselves (``cell`` NULL). Every target is
    counted once a level in partial aggregates, so the tree grows with the targets, however crowded they are.
    """
    ra, ro = right_at
    levels = F.array(*[F.lit(x) for x in range(0, DEPTH + 1, STEP)])
    spread = targets.select(F.col(right_id).alias("id"), F.col(ra).alias("p_lat"), F.col(ro).alias("p_lon"), F.explode(levels).alias("level"))
    spread = spread.withColumn("cell", _spot_cell("p_lat", "p_lon", F.col("level")))
    counts = spread.groupBy("level", "cell").agg(F.count("*").alias("n"), F.min(F.struct("id", "p_lat", "p_lon")).alias("one"))
    cut = (F.col("n") > LEAF) & (F.col("level") < DEPTH)
    inner = counts.where(cut).select(F.col("cell").alias("parent"))
    below = counts.where("level > 0").withColumn("parent", _parent(F.col("cell"))).join(inner, "parent")
    high, wide = 180.0 / F.pow(F.lit(2.0), F.col("level")), 360.0 / F.pow(F.lit(2.0), F.col("level"))
    south, west = F.floor(F.col("cell") / _SIDE) % _SIDE * high - 90.0, F.col("cell") % _SIDE * wide - 180.0
    cells = below.select(
        "parent",
        (F.col("level") - STEP).alias("level"),
        "cell",
        south.alias("south"),
        (south + high).alias("north"),
        west.alias("west"),
        (west + wide).alias("east"),
        F.col("one.id").alias("id"),
        F.col("one.p_lat").alias("p_lat"),
        F.col("one.p_lon").alias("p_lon"),
    )
    ends = below.where(~cut).select("cell").unionByName(counts.where((F.col("level") == 0) & ~cut).select("cell"))
    leaves = spread.join(ends, "cell").select(F.col("cell").alias("parent"), "level", "id", "p_lat", "p_lon")
    return cells.unionByName(leaves, allowMissingColumns=True)


def _step(frontier: DataFrame, tree: DataFrame, level: int, at: tuple[str, str]) -> DataFrame:
    """The frontier with its cells of one level replaced by what lies below them; not yet pruned."""
    la, lo = at
    below = tree.where(F.col("level") == level).drop("level")
    below = below.select(F.col("parent").alias("_parent"), *[F.col(c).alias(f"_{c}") for c in ("cell", "south", "north", "west", "east", "id", "p_lat", "p_lon")])
    # At most 64 cells of 32 targets, or 64 cells, lie below each of the few cells of a high level.
    met = frontier.join(F.broadcast(below) if level <= _FEW_LEVEL else below, F.col("cell") == F.col("_parent"), "left")
    new = F.col("_parent").isNotNull()
    moved = met.select(la, lo, new.alias("_new"), *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("cell", "id")], *[F.col(f"_{c}").alias(c) for c in ("south", "north", "west", "east", "p_lat", "p_lon")], "low", "high")
    moved = moved.withColumn("high", F.when(F.col("_new"), distance_nm(la, lo, "p_lat", "p_lon")).otherwise(F.col("high")))
    moved = moved.withColumn("low", F.when(~F.col("_new"), F.col("low")).when(F.col("cell").isNull(), F.col("high")).otherwise(_box_distance(la, lo)))
    return moved.select(la, lo, "cell", "id", "low", "high")


def _pruned(frontier: DataFrame, at: tuple[str, str]) -> DataFrame:
    """Per position what can still hold the nearest target: nothing is kept that begins beyond the nearest one known."""
    known = F.min("high").over(Window.partitionBy(*at))
    return frontier.withColumn("_known", known).where(F.col("low") <= F.col("_known") + _SLACK_NM).drop("_known")


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    name: str = "distance_nm",
) -> DataFrame:
    """left_id, right_id, distance of the nearest right row for every left row; distances equal to nine digits go to the lowest id.

    A left row without a position, or any left row where there is no right one, stays with NULLs. Rows at the same spot share an answer, so both sides are first reduced to distinct
    positions. The right ones become a tree of cells (:func:`target_tree`), and every left position goes down it: a cell brings a least distance, one target of it a greatest, and
    cells that begin beyond the least greatest distance are left out before anything below them is looked at. So a position meets some cells a level and a
    few targets, however crowded the place, and the answer is exact. Steps are as many as the tree is deep.
    """
    (la, lo), (ra, ro) = left_at, right_at
    spots = left.where(F.col(la).isNotNull() & F.col(lo).isNotNull()).select(la, lo).distinct()
    targets = right.where(F.col(ra).isNotNull() & F.col(ro).isNotNull()).groupBy(ra, ro).agg(F.min(right_id).alias(right_id))
    tree = settled(target_tree(targets, right_id, right_at), "target-tree")
    deepest = tree.agg(F.max("level").alias("level")).first()["level"]
    nothing = F.lit(None)
    # The root's number, from the position: as a literal it would leave the first step without a join key.
    frontier = spots.select(la, lo, _spot_cell(la, lo, F.lit(0)).alias("cell"), nothing.cast(tree.schema["id"].dataType).alias("id"), F.lit(0.0).alias("low"), F.lit(GLOBE_NM).alias("high"))
    for level in range(0, -1 if deepest is None else deepest + 1, STEP):
        frontier = _pruned(_step(frontier, tree, level, left_at), left_at)
    best = frontier.where("id is not null and cell is null").groupBy(la, lo).agg(F.min(F.struct(F.round("high", 9).alias("far"), "id", "high")).alias("_b"))
    found = best.select(F.col(la).alias("_la"), F.col(lo).alias("_lo"), F.col("_b.id").alias(right_id), F.col("_b.high").alias(name))
    return left.select(left_id, la, lo).join(found, (F.col(la) == F.col("_la")) & (F.col(lo) == F.col("_lo")), "left").select(left_id, right_id, name)
