"""Exact Jaccard links between sets of 64-bit shingles, in size-banded tiles.

Two sets with similarity t differ in at most (1-t)/(1+t) of their summed sizes.  Sizes fall
into bands; in a band every set is cut by hash range into more parts than two linked sets of
the band can differ in, so linked sets have an equal part.  Sets that share a part lie in one
cluster.  A cluster is one tile, or, where it is large, a grid of tiles by size band and hash;
in a tile, hashed bitmaps bound every overlap from above before sorted arrays are intersected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.components import connected_components
from seriesloom.llm.store import materialize, shuffle_width
from seriesloom.llm.words import mix

#: Bytes of shingles that a tile holds on average at most; a set counts with so many bytes more.
TILE_BYTES, SET_BYTES = 8 << 20, 1024
#: A band spans this power of 1/t in size.
BAND_POWER = 1
#: Size bands that the tiles of a large cluster span.
TILE_BANDS = 6
#: Bitmap bits a shingle, and the widest bitmap.
BITS_EACH, MAX_BITS = 2, 8192


class Bands:
    """Size bands and parts for similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low: list[int] = [1]

    def reach(self, size: int) -> int:
        """The largest set that one of ``size`` can link with."""
        return size * self.den // self.num

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            low = self.low[-1]
            self.low.append(max(low + 1, low * self.den**BAND_POWER // self.num**BAND_POWER, self.reach(low) + 1))

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def differ(self, band: int) -> int:
        """How many elements two linked sets can differ in, the smaller one being in ``band``."""
        self._grow(self.low[min(band, len(self.low) - 1)] + 1)
        high = self.low[band + 1] - 1
        return (self.den - self.num) * (high + self.reach(high)) // (self.den + self.num)

    def filed(self, size: int) -> list[int]:
        """Bands a set is filed in: its own, and the one before if a smaller partner can be there."""
        own = self.of(size)
        return [own] + ([own - 1] if own and size <= self.reach(self.low[own] - 1) else [])

    def spare(self, most: int) -> int:
        """Parts beyond what the pigeonhole needs; only a set with more empty parts than that files those too."""
        return 3 + most // 10 if most else 0

    def keys(self, found: np.ndarray, heavy: np.ndarray | None = None) -> np.ndarray:
        """Part keys of a sorted set; linked sets have one in common.

        Shingles whose low bits are marked in ``heavy`` are left out of the parts: linked sets
        differ no more without them, and parts of common shingles alone would be equal by chance.
        """
        if not len(found):
            return np.zeros(0, dtype=np.uint64)
        whole = len(found)
        if heavy is not None:
            found = found[~heavy[(found & np.uint64(len(heavy) - 1)).astype(np.int64)]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        out = []
        for band in self.filed(whole):
            most = self.differ(band)
            parts = most + 1 + self.spare(most)
            cuts = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
            at = np.concatenate([[0], np.searchsorted(found, cuts), [len(found)]])
            size = np.diff(at)
            named = np.uint64((band + 1) * 0x9FB21C651E98DF25 % (1 << 64)) + np.arange(parts, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys = mix(mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)) ^ mix(named))
            # Linked sets have more equal parts than those spared; if all of them are empty, both sets have so many empty ones.
            out.append(keys[size > 0] if np.count_nonzero(size == 0) <= parts - most - 1 else keys)
        return np.concatenate(out)


def clusters(keyed: DataFrame) -> DataFrame:
    """``node, cluster``: nodes of ``keyed(node, keys)`` that share keys, directly or through others.

    Nodes that share no key do not appear.  Rows of a key are chained in order, so a key that
    very many nodes have makes one link a node.  A node may come in several rows.
    """
    rows = keyed.select("node", F.explode("keys").alias("key"))
    chain = Window.partitionBy("key").orderBy("node")
    links = rows.select(F.col("node").alias("a"), F.lag("node").over(chain).alias("b")).filter("a <> b")
    return connected_components(links).withColumnRenamed("component", "cluster")


class Filed:
    """Which sets a task has filed keys of; forgets when it holds ``most``, and files some again."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.held = most, set()

    def first(self, name) -> bool:
        """Whether the keys of the set ``name`` are still to be filed."""
        if name in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(name)
        return True


def in_tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows(cluster, node, n, ...)`` once for every ``tile`` of their cluster they go to, with the ``side`` they are on.

    Tiles are placed by the sizes ``n`` alone.  Every pair of a cluster that can link has a tile in common.
    """
    bands = Bands(num, den)
    bytes_each = F.col("n") * 8 + SET_BYTES
    banded = _with_band(rows, bands)
    weights = banded.groupBy("cluster", "band").agg(F.sum(bytes_each).alias("w"))
    whole = F.sum("w").over(Window.partitionBy("cluster"))  # as many rows as a cluster has size bands
    tiles = weights.select(
        "cluster", "band", F.when(whole <= TILE_BYTES, 0).otherwise(F.ceil(F.col("w") / TILE_BYTES)).cast("int").alias("own")
    )
    near = tiles.select("cluster", (F.col("band") - 1).alias("band"), F.col("own").alias("after"))
    past = tiles.select("cluster", (F.col("band") + 1).alias("band"), F.col("own").alias("before"))
    tiles = tiles.join(near, ["cluster", "band"], "left").join(past, ["cluster", "band"], "left")
    placed = banded.join(tiles, ["cluster", "band"])
    # own = 0: the cluster is one tile.  Else a set goes to every pair of tiles its own belongs to.
    salt = F.pmod(F.xxhash64("node", F.lit("tile")), F.greatest("own", F.lit(1))).cast("int")
    pair = lambda b1, s1, b2, s2: F.struct(b1.alias("b1"), s1.alias("s1"), b2.alias("b2"), s2.alias("s2"))
    band, at, zero = F.col("band"), F.col("_salt"), F.lit(0)
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    count = lambda c: F.coalesce(F.col(c), zero)
    goes = F.when(F.col("own") == 0, F.array(pair(zero, zero, zero, zero))).otherwise(
        F.concat(
            F.transform(upto(count("own")), lambda s: pair(band, F.least(s, at), band, F.greatest(s, at))),
            F.transform(upto(F.when(F.col("_above"), count("after")).otherwise(0)), lambda s: pair(band, at, band + 1, s)),
            F.transform(upto(F.when(F.col("_below"), count("before")).otherwise(0)), lambda s: pair(band - 1, s, band, at)),
        )
    )
    # Which side of a pair of tiles a row is on: 0 and 1, or 2 where both are the same.
    one = (F.col("tile.b1") == F.col("tile.b2")) & (F.col("tile.s1") == F.col("tile.s2"))
    left = (F.col("tile.b1") == band) & (F.col("tile.s1") == at)
    side = F.when((F.col("own") == 0) | one, 2).when(left, 0).otherwise(1)
    return placed.withColumn("_salt", salt).withColumn("tile", F.explode(goes)).select(*rows.columns, "tile", side.alias("side"))


def links_in_tiles(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``a, b`` that connect all sets of a cluster whose similarity is ``num / den`` or more.

    ``dealt(cluster, tile, side, node, n, shingles)``: ``shingles`` are ``n`` sorted distinct 64-bit
    values as bytes; a node that comes to a tile more than once counts once.  Every pair of a
    cluster is either compared or known to be connected.
    """
    dealt = dealt.select("cluster", "tile", "side", "node", "n", "shingles")
    dealt = dealt.repartition(shuffle_width(dealt), "cluster", "tile").sortWithinPartitions("cluster", "tile", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], ([], [])
        for batch in batches:
            columns = [batch.column(c) for c in ("cluster", "tile", "side", "node", "shingles")]
            names, tiles = columns[0].to_pylist(), columns[1].to_pylist()
            sides, nodes = columns[2].to_pylist(), columns[3].to_pylist()
            for i in range(batch.num_rows):
                if (here := (names[i], tuple(tiles[i].values()))) != key:
                    _compare(held, num, den, out)
                    key, held = here, []
                if not held or held[-1][1] != nodes[i]:
                    held.append((sides[i], nodes[i], np.frombuffer(columns[4][i].as_py(), dtype=np.uint64)))
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
            out = ([], [])
        _compare(held, num, den, out)
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _with_band(sets: DataFrame, bands: Bands) -> DataFrame:
    """``band`` of tiles, and whether a set's partners may lie in the band ``_above`` or ``_below``.

    Bands are geometric, so a few dozen bounds cover all sizes; a band of tiles spans several of
    them, and only sets near its ends meet the next one.
    """
    bands._grow(1 << 40)
    n, lows = F.col("n"), bands.low[::TILE_BANDS]
    band = (F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in lows]), lambda x: x <= n)) - 1).cast("int")
    after = F.get(F.array(*[F.lit(x).cast("bigint") for x in [*lows[1:], 1 << 62]]), F.col("band"))
    reached = F.get(F.array(*[F.lit(bands.reach(x - 1)).cast("bigint") for x in lows]), F.col("band"))
    above = F.expr(f"n * {bands.den} div {bands.num}") >= after
    return sets.withColumn("band", band).withColumns({"_above": above, "_below": n <= reached})


def _compare(held: list[tuple[int, int, np.ndarray]], num: int, den: int, out: tuple[list, list]) -> None:
    """Append links that connect what is linked among ``held(side, node, set)``, in order of size.

    Pairs on the same side of two tiles are left to the tile they have in common.
    """
    if len(held) < 2:
        return
    sides = np.array([h[0] for h in held])
    sizes = np.array([len(h[2]) for h in held], dtype=np.int64)
    bits = 64
    while bits < min(MAX_BITS, BITS_EACH * int(sizes.max())):
        bits *= 2
    maps = np.zeros((len(held), bits), dtype=bool)
    for k, (_, _, s) in enumerate(held):
        maps[k, (s & np.uint64(bits - 1)).astype(np.int64)] = True
    maps = np.packbits(maps, axis=1).view(np.uint64)
    roots = np.arange(len(held))
    for i in range(len(held) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        later = np.arange(i + 1, end)
        later = later[(roots[later] != roots[i]) & ((sides[later] != sides[i]) | (sides[i] == 2))]
        if not len(later):
            continue
        need = -(-num * (sizes[i] + sizes[later]) // (num + den))  # den * overlap >= num * union
        own, others = maps[i], maps[later]
        bound = np.minimum(
            sizes[i] - np.bitwise_count(own & ~others).sum(1, dtype=np.int64),
            sizes[later] - np.bitwise_count(others & ~own).sum(1, dtype=np.int64),
        )
        a = held[i][2]
        for j, least in zip(later[bound >= need].tolist(), need[bound >= need].tolist()):
            if roots[j] == roots[i]:
                continue
            b = held[j][2]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if np.count_nonzero(b[at] == a) >= least:
                out[0].append(held[i][1])
                out[1].append(held[j][1])
                gone, stays = roots[j], roots[i]
                roots[roots == gone] = stays


def cluster_components(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, component`` of the sets ``cluster, node, n, shingles`` that are linked with others."""
    return tile_components(in_tiles(sets, num, den), num, den)


def tile_components(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """``node, component`` of sets in tiles that are linked with others."""
    return connected_components(materialize(links_in_tiles(dealt, num, den)))
