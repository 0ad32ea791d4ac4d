"""Embedding near-dedup as an exact metric range join.

Cosine >= 0.9 is an angle of at most r = arccos 0.9, and the angle is a metric. Pivots cut the space
into cells: a vector's home is its nearest pivot. A vector y with home b can have a partner with home
a only if, by the triangle inequality, angle(y, a) <= angle(y, b) + 2 r, and angle(y, a) <= r + the
radius of cell a; it then visits cell a. Visits go to cells of a smaller number only, so each pair of
vectors meets once. Cells are joined independently of each other.

Scale: equal vectors are one row with a weight. A cell is cut into tiles by hash and visitors into
shares, so a task holds one tile and streams its visitors, however full a cell is. A task
sends one row per vector with links (their number and one neighbour for each piece joined), never
pairs. Pivots and radii are a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import components
from flowlens.llm.shared import width
from flowlens.operators.lineage import cut, release

THRESHOLD, PIVOTS, TILE, SHARE_ROWS = 0.9, 256, 2048, 65_536
DEAL_ROWS, SEND_ROWS = 512, 4096
SLACK = 1e-6  # on angles, against rounding: it only lets more vectors visit


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of unit vectors in double precision; unusable ones become null."""
    for batch in batches:
        out = []
        for v in batch.column("vec").to_pylist():
            a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
            out.append(_unit(a[None])[0].tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _home(pivots: dict[int, np.ndarray]):
    """Home cell and angle to its pivot; a length that no pivot has is one cell of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("unit").to_pylist()
            dims = np.array([len(b) // 8 for b in blobs], np.int32)
            cell, angle = np.full(len(blobs), -1, np.int32), np.zeros(len(blobs))
            for dim in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == dim)
                a = _angles(_matrix([blobs[i] for i in at], dim), pivots[dim])
                cell[at], angle[at] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "weight", "unit")), pa.array(dims), pa.array(cell), pa.array(angle)],
                names=["rep", "weight", "unit", "dim", "cell", "angle"],
            )

    return run


def _times(row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row n times, and the numbers from 0 to n - 1 beside it."""
    out = np.repeat(row, n)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)


def _deal(pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], tiles: dict[tuple[int, int], int], shares: int, reach: float):
    """A row for every unit of work that a vector takes part in: as a member of its tile, or as a visitor."""

    def bounds(dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Tiles and radius of each cell of a length, cell -1 first."""
        cells = range(-1, len(pivots.get(dim, ())))
        return np.array([tiles.get((dim, c), 0) for c in cells]), np.array([radius.get((dim, c), -np.inf) for c in cells])

    def units(dim: int, unit: np.ndarray, cell, angle, spot) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and cell, tile, share and visits of the units each takes part in."""
        n_tiles, radii = bounds(dim)
        row = np.arange(len(cell))
        tile, share = spot % n_tiles[cell + 1], spot // 1_000_003 % shares
        member, s = _times(row, np.full(len(row), shares))
        inside, lower = _times(row, tile)
        parts = [(member, cell[member], tile[member], s, 0), (inside, cell[inside], lower, share[inside], 1)]
        if dim in pivots:
            own = _angles(unit, pivots[dim])
            can = (own <= angle[:, None] + 2 * reach + SLACK) & (own <= radii[1:] + reach + SLACK) & (np.arange(own.shape[1]) < cell[:, None])
            guest, other = np.nonzero(can)
            k, t = _times(np.arange(len(guest)), n_tiles[other + 1])
            parts.append((guest[k], other[k], t, share[guest[k]], 1))
        where = [np.stack(np.broadcast_arrays(*p[1:])) for p in parts]
        return np.concatenate([p[0] for p in parts]), np.concatenate(where, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), DEAL_ROWS):
                batch = whole.slice(lo, DEAL_ROWS)
                dims, *columns = (batch.column(c).to_numpy() for c in ("dim", "cell", "angle", "spot"))
                blobs = batch.column("unit").to_pylist()
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    row, where = units(dim, _matrix([blobs[i] for i in at], dim), *(c[at] for c in columns))
                    for a in range(0, len(row), SEND_ROWS):  # a vector may take part in many units
                        taken = batch.select(["rep", "weight", "unit"]).take(pa.array(at[row[a : a + SEND_ROWS]]))
                        places = [pa.array(c, pa.int32()) for c in where[:, a : a + SEND_ROWS]]
                        yield pa.RecordBatch.from_arrays(
                            [*taken.columns, pa.array(np.full(len(taken), dim, np.int32)), *places],
                            names=["rep", "weight", "unit", "dim", "cell", "tile", "share", "visits"],
                        )

    return run


class _Unit:
    """One tile's members, against themselves and then against batches of visitors."""

    def __init__(self, key: tuple, threshold: float):
        self.key, self.threshold, self.ids, self.weights, self.blobs, self.ready = key, threshold, [], [], [], False

    def add(self, ids, weights, blobs) -> None:
        self.ids += ids
        self.weights += weights
        self.blobs += blobs

    def close(self) -> list[tuple[int, int, int | None]]:
        """All members are here: links among them (in the first share only)."""
        self.ready = True
        self.matrix = _matrix(self.blobs, self.key[0]) if self.ids else np.zeros((0, 1))
        self.n, self.labels = np.array(self.weights, np.float64), np.arange(len(self.ids))
        if self.key[3] or not self.ids:
            return []
        out = []
        for a in range(0, len(self.ids), 512):
            near = self.matrix[a : a + 512] @ self.matrix.T >= self.threshold
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            links = (near @ self.n).astype(np.int64)
            out += [(self.ids[a + k], int(links[k]), None) for k in np.flatnonzero(links)]
            for k in np.flatnonzero(links):
                out += [(self.ids[a + k], 0, self.ids[m]) for m in self._merge(np.append(np.flatnonzero(near[k]), a + k))[1:]]
        return out

    def _merge(self, hits: np.ndarray) -> np.ndarray:
        """Make the members in `hits` one piece; returns one of each piece."""
        pieces, first = np.unique(self.labels[hits], return_index=True)
        if len(pieces) > 1:
            self.labels[np.isin(self.labels, pieces)] = pieces[0]
        return hits[first]

    def visit(self, ids, weights, blobs) -> list[tuple[int, int, int | None]]:
        out = [] if self.ready else self.close()
        if not self.ids:
            return out
        near = _matrix(blobs, self.key[0]) @ self.matrix.T >= self.threshold
        back = (near.T @ np.array(weights, np.float64)).astype(np.int64)
        out += [(self.ids[k], int(back[k]), None) for k in np.flatnonzero(back)]
        links = (near @ self.n).astype(np.int64)
        for k in np.flatnonzero(links):
            pieces = self._merge(np.flatnonzero(near[k]))
            out.append((ids[k], int(links[k]), self.ids[pieces[0]]))
            out += [(ids[k], 0, self.ids[m]) for m in pieces[1:]]
        return out


def _join(threshold: float):
    keys = ["dim", "cell", "tile", "share", "visits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        for batch in batches:
            out = []
            place = np.stack([batch.column(c).to_numpy() for c in keys], 1)
            ids, weights, blobs = (batch.column(c).to_pylist() for c in ("rep", "weight", "unit"))
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                *key, visits = place[a].tolist()
                if unit is None or unit.key != tuple(key):
                    out += unit.close() if unit and not unit.ready else []
                    unit = _Unit(tuple(key), threshold)
                for lo in range(a, b, TILE):
                    rows = slice(lo, min(lo + TILE, b))
                    if visits:
                        out += unit.visit(ids[rows], weights[rows], blobs[rows])
                    else:
                        unit.add(ids[rows], weights[rows], blobs[rows])
            yield _links(out)
        yield _links(unit.close() if unit and not unit.ready else [])

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "other"])


def embedding_join(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, pivots: int = PIVOTS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors of the same length link when their cosine, in double precision, is at least
    `threshold`. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null id (their component is null and they are not kept). Repeated
    rows are vectors of their own and link with each other. An empty table gives an empty result;
    other columns are not read.
    """
    spark = vectors.sparkSession
    packed = cut(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(_pack, "vec_id long, unit binary")
        .withColumn("key", F.when(F.col("vec_id").isNotNull(), F.sha2("unit", 256)))
    )
    classes = cut(
        packed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
    )
    # Rows that share an id but not their vector stay apart by key; links are held by the class's smallest id.
    chosen = classes.orderBy("key").limit(pivots).select("unit").collect()  # a bounded number of vectors
    by_dim: dict[int, list[bytes]] = {}
    for r in chosen:
        by_dim.setdefault(len(r["unit"]) // 8, []).append(bytes(r["unit"]))
    points = {dim: _matrix(blobs, dim) for dim, blobs in by_dim.items()}
    homes = cut(
        classes.select("rep", "weight", "unit").mapInArrow(_home(points), "rep long, weight long, unit binary, dim int, cell int, angle double")
        .withColumn("spot", F.xxhash64("unit").bitwiseAND(F.lit((1 << 62) - 1)))
    )
    # As many rows as there are cells.
    cells = homes.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = {(r["dim"], r["cell"]): r["radius"] for r in cells}
    tiles = {(r["dim"], r["cell"]): -(-r["n"] // tile) for r in cells}
    shares = max(1, -(-sum(r["n"] for r in cells) // SHARE_ROWS))
    place = ["dim", "cell", "tile", "share"]
    dealt = homes.mapInArrow(
        _deal(points, radius, tiles, shares, float(np.arccos(threshold))),
        "rep long, weight long, unit binary, dim int, cell int, tile int, share int, visits int",
    )
    found = cut(
        dealt.repartition(width(spark), *place).sortWithinPartitions(*place, "visits").mapInArrow(_join(threshold), "rep long, links long, other long")
    )
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    copies = packed.join(classes.where("weight > 1").select("key", "rep"), "key").where("vec_id <> rep")
    parts = components(
        found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        .unionByName(copies.select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    )
    per_class = cut(classes.select("key", "rep", "weight").join(degrees, "rep", "left"))
    release(homes)
    linked = packed.select("vec_id", "key").join(per_class, "key", "left").join(parts, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id", F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
