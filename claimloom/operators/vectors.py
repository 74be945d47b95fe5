"""Exact nearest neighbours of vectors by cells.

Entities stand in cells: each with the nearest of some centers, which k-means
fits on a bounded sample. What a query can find in a cell is bounded by the
triangle inequality: nothing there is nearer than its distance to the center less
the cell's radius. So a query asks the nearest cells until these hold k entities,
which bounds the distance of its k-th; and then only those others that could hold
a nearer one. The result is that of a search through all entities.

Cells are stored in blocks of about BLOCK vectors, queries meet them by an
equi-join on the block in batches of about ASKED, and a pair of batches is one
matrix product; a cell with a third of all entities is as many blocks as it
takes. What the driver holds is the sample, the centers and a row for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.components import durable

#: Vectors that centers are fitted on, at most (those with the smallest hashes of their ids); rounds of the fit; centers, at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 2048
#: Vectors of a block and queries of a batch, on average.
BLOCK, ASKED = 1024, 256
#: Distances are floating-point numbers; bounds are widened by more than their rounding. Cosines are compared after this many digits.
SLACK, DIGITS = 1e-6, 12


@dataclass
class Cells:
    """Entities in cells. placed: kind, entity_id, unit vector as bytes, cell, far (distance to the center). sizes: (kind, cell) to its entities and radius."""

    centers: np.ndarray
    placed: DataFrame
    sizes: dict[tuple[str, int], tuple[int, float]]


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this length, numbers only and a direction; and these, scaled to length 1."""
    if not width:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    values, offsets = column.values, column.offsets.to_numpy()
    size = np.diff(offsets)
    good = (size == width) & column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat[offsets[at][:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    length = np.linalg.norm(rows, axis=1)
    some = np.isfinite(length) & (length > 0)
    return at[some], rows[some] / length[some][:, None]


def to_centers(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of unit rows to centers."""
    square = (rows**2).sum(1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def fitted(rows: np.ndarray, cells: int) -> np.ndarray:
    """k-means centers of rows, begun with rows evenly through them; an empty cell keeps its center."""
    if not len(rows):
        return np.zeros((1, rows.shape[1] if rows.ndim == 2 else 0))
    centers = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        of = np.concatenate([to_centers(part, centers).argmin(1) for part in np.array_split(rows, len(rows) // 4096 + 1)])
        n = np.bincount(of, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, of, rows)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _kind(df: DataFrame):
    return F.coalesce(F.col("entity_type"), F.lit("")) if "entity_type" in df.columns else F.lit("")


def placed_in_cells(entities: DataFrame, cells: int | None = None) -> Cells:
    """Entities (entity_id, vector, and entity_type if searches are within types) in cells; the square root of their number, if it isn't given.

    Vectors that are null, zero, not finite or of another length than most are left out.
    """
    own = entities.select(_kind(entities).alias("kind"), "entity_id", "vector")
    n = own.where("vector is not null").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, total = (n[0]["width"], n[0]["count"]) if n else (0, 0)
    cells = min(MOST_CELLS, max(1, round(total**0.5))) if cells is None else cells
    sample = own.where(F.size("vector") == width).select(F.xxhash64(F.col("entity_id").cast("string")).alias("h"), "vector").orderBy("h").limit(SAMPLE).select("vector").toArrow()
    chunks = sample.column("vector").chunks
    centers = fitted(unit_rows(pa.concat_arrays(chunks), width)[1] if chunks else np.zeros((0, width)), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column("vector"), width)
            if len(at):
                far = to_centers(rows, centers)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind").take(pa.array(at)), batch.column("entity_id").take(pa.array(at)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(at)), cell])],
                    ["kind", "entity_id", "unit", "cell", "far"],
                )

    kind = dict(entities.dtypes)["entity_id"]
    placed = durable(own.mapInArrow(place, f"kind string, entity_id {kind}, unit binary, cell int, far double"))
    sizes = {(r.kind, r.cell): (r.n, r.radius) for r in placed.groupBy("kind", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    return Cells(centers, placed, sizes)


def _by_kind(cells: Cells) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, entities and radii of the cells of a kind."""
    out: dict[str, list] = {}
    for (kind, cell), (n, radius) in sorted(cells.sizes.items()):
        out.setdefault(kind, []).append((cell, n, radius))
    return {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in out.items()}


def _asking(queries: DataFrame, cells: Cells, k: int, most: float, bounded: bool) -> DataFrame:
    """A row for each cell that a query asks: kind, cell, cand_id, unit.

    bounded false: the nearest cells until they hold k. true: the other cells
    that could hold one nearer than `bound` (null: than the distance `most`).
    """
    known, centers = _by_kind(cells), cells.centers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column("vector"), centers.shape[1])
            kinds = batch.column("kind").to_pylist()
            bounds = batch.column("bound").to_pylist() if bounded else None
            of, cell = [], []
            far = to_centers(rows, centers) if len(at) else None
            for i, row in enumerate(at):
                numbers, n, radius = known.get(kinds[row], (np.zeros(0, np.int64),) * 3)
                if not len(numbers):
                    continue
                d = far[i, numbers]
                least = d - radius - SLACK
                order = np.argsort(d, kind="stable")
                first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                if bounded:
                    bound = min(most, most if bounds[row] is None else bounds[row]) + SLACK
                    rest = np.ones(len(numbers), bool)
                    rest[first] = False
                    chosen = np.flatnonzero(rest & (least <= bound))
                else:
                    chosen = first[least[first] <= most + SLACK]
                cell.append(numbers[chosen])
                of.append(np.full(len(chosen), i))
            of = np.concatenate(of) if of else np.zeros(0, np.int64)
            cell = np.concatenate(cell) if cell else np.zeros(0, np.int64)
            for lo in range(0, len(of), 10_000):  # a query may ask many cells
                part = of[lo : lo + 10_000]
                rows_of = pa.array(at[part] if len(part) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("kind").take(rows_of), pa.array(cell[lo : lo + 10_000].astype(np.int32)), batch.column("cand_id").take(rows_of), pa.array([rows[i].tobytes() for i in part], pa.binary())], ["kind", "cell", "cand_id", "unit"])

    return queries.mapInArrow(run, f"kind string, cell int, cand_id {dict(queries.dtypes)['cand_id']}, unit binary")


def _met(asking: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(cand_id, entity_id, cosine): of each block that a query asks, its best k."""
    width = cells.centers.shape[1]
    spark = asking.sparkSession
    rows = [(kind, cell, max(1, -(-n // BLOCK))) for (kind, cell), (n, _) in cells.sizes.items()]
    blocks = F.broadcast(spark.createDataFrame(rows, "bk string, bc int, blocks int"))  # a row for each cell
    in_cell = (F.col("kind") == F.col("bk")) & (F.col("cell") == F.col("bc"))
    stored = cells.placed.join(blocks, in_cell).withColumn("block", F.pmod(F.xxhash64("entity_id", "unit"), F.col("blocks")).cast("int"))
    stored = stored.groupBy("kind", "cell", "block").agg(F.collect_list(F.struct("entity_id", "unit")).alias("entities")).withColumnsRenamed({"kind": "sk", "cell": "sc", "block": "sb"})
    asking = durable(asking)
    times = asking.groupBy("kind", "cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("batches")).withColumnsRenamed({"kind": "tk", "cell": "tc"})
    asked = asking.join(F.broadcast(times), (F.col("kind") == F.col("tk")) & (F.col("cell") == F.col("tc"))).withColumn("part", F.pmod(F.xxhash64("cand_id", "unit"), F.col("batches")).cast("int"))
    asked = asked.groupBy("kind", "cell", "part").agg(F.collect_list(F.struct("cand_id", "unit")).alias("queries")).join(blocks, in_cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = asked.join(stored, (F.col("kind") == F.col("sk")) & (F.col("cell") == F.col("sc")) & (F.col("block") == F.col("sb"))).select("queries", "entities")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, e = batch.column("queries")[i].values, batch.column("entities")[i].values
                mine = np.frombuffer(b"".join(q.field("unit").to_pylist()), np.float64).reshape(-1, width)
                theirs = np.frombuffer(b"".join(e.field("unit").to_pylist()), np.float64).reshape(-1, width)
                names = e.field("entity_id")
                place = np.empty(len(names), np.int64)
                place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                cosine = np.round(mine @ theirs.T, DIGITS)
                best = np.stack([np.lexsort((place, -row))[:k] for row in cosine])
                of = np.repeat(np.arange(len(mine)), best.shape[1])
                yield pa.RecordBatch.from_arrays([q.field("cand_id").take(pa.array(of)), names.take(pa.array(best.ravel())), pa.array(cosine[of, best.ravel()])], ["cand_id", "entity_id", "cosine"])

    kinds = dict(cells.placed.dtypes) | dict(asking.dtypes)
    return pairs.mapInArrow(compare, f"cand_id {kinds['cand_id']}, entity_id {kinds['entity_id']}, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("cosine"), "entity_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def k_nearest(queries: DataFrame, cells: Cells, k: int, least_cosine: float = -1.0) -> DataFrame:
    """(cand_id, entity_id, cosine, place): the k nearest entities of each query (cand_id, vector, entity_type if cells have it), by cosine, then id.

    Those below least_cosine may be missing. Queries whose vectors can't be
    compared find nothing. Queries of one cand_id share one result.
    """
    queries = queries.select(_kind(queries).alias("kind"), "cand_id", "vector")
    if not cells.sizes:
        empty = dict(cells.placed.dtypes)["entity_id"]
        return queries.where("false").select("cand_id", F.lit(None).cast(empty).alias("entity_id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("place"))
    most = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    first = durable(_best(_met(_asking(queries, cells, k, most, False), cells, k), k))
    # the distance of the k-th; fewer than k bound nothing
    bound = first.groupBy("cand_id").agg(F.count("*").alias("n"), F.min("cosine").alias("c")).select(F.col("cand_id").alias("x"), F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("c")))).alias("bound"))
    more = _met(_asking(queries.join(bound, F.col("cand_id") == F.col("x"), "left").drop("x"), cells, k, most, True), cells, k)
    return _best(first.drop("place").unionByName(more), k)
