"""Duplicate detection within a customer: C3, E3, J2, J3.

The search is exact and never builds the pairs of a customer as rows:

* Exact copies collapse first. Only the first k+1 members of a copy group search and serve as candidates; every
  later member's nearest neighbours are, by construction, the first k members.
* The remaining vectors are compared in cells of bounded size. Small customers are bundled into one cell, which
  multiplies two matrices and returns at most k neighbours per row.
* A customer above `block_rows` has an index: `CENTRES` of its vectors are centres, every vector belongs to the nearest one, and
  a centre's vectors lie in blocks of bounded size. A vector is first compared with its own block. Its k-th best there is a floor: a
  block whose centre is at angle a and whose radius is r holds nothing better than cos(a - r), so only blocks that reach the floor
  are visited. The search stays exact; `search_work` reports what was visited. Vectors without clusters visit most blocks.
* Up to `CELL_VALUES` numbers such a customer is a cell of its own: one task builds the index and visits the blocks, and a vector moves
  as often as those of small customers. Only a larger one is indexed, dealt over cells and visited by jobs.
* The best k of a row's cells are merged with a rank limit, which Spark applies before the shuffle too.

Exact copies rank before other neighbours; ties go to the earlier case, then the smaller id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.skew import attach_by_key
from casework.session import cut_lineage

DUPLICATE_THRESHOLD = 0.78
TOP_K = 5
BLOCK_ROWS = 8192
CENTRES = 64
#: Rows that a visit moves to one task and, of as many, the cell that it visits there; a block may be far smaller.
CELL_ROWS = 32768
#: Numbers in the vectors of a customer that is one cell, 64 MB as doubles: 131,072 vectors of 64, 5,461 of 1,536.
CELL_VALUES = 2 ** 23
MAX_TASKS = 2000
_DIGITS = 9
_CHUNK = 1024
#: Below every score.
_NONE = -4 * 10 ** _DIGITS


def _best(queries, candidates, query_pos, candidate_pos, query_copy, candidate_copy, k, earlier):
    """Positions and scores of the k best candidates per query, -1 where fewer exist.

    Scores are whole billionths so that equal similarities tie exactly; copies score above 1.
    """
    scale = 10 ** _DIGITS
    span = len(candidate_pos) + len(query_pos) + 1
    order = np.argsort(np.argsort(candidate_pos))
    found = np.full((len(query_pos), k), -1, dtype=np.int64)
    scores = np.zeros((len(query_pos), k), dtype=np.int64)
    for start in range(0, len(query_pos), _CHUNK):
        stop = min(start + _CHUNK, len(query_pos))
        sims = np.rint(np.round(queries[start:stop] @ candidates.T, _DIGITS) * scale).astype(np.int64)
        np.clip(sims, -scale, scale, out=sims)
        same = query_copy[start:stop, None] == candidate_copy[None, :]
        sims[same] = 2 * scale
        keys = sims * span + (span - 1 - order)[None, :]
        mask = query_pos[start:stop, None] == candidate_pos[None, :]
        if earlier:
            mask |= candidate_pos[None, :] > query_pos[start:stop, None]
        blank = np.iinfo(np.int64).min
        keys[mask] = blank
        width = min(k, keys.shape[1])
        top = np.argpartition(keys, keys.shape[1] - width, axis=1)[:, keys.shape[1] - width:]
        top_keys = np.take_along_axis(keys, top, axis=1)
        top[top_keys == blank] = -1
        found[start:stop, :width] = top
        scores[start:stop, :width] = np.take_along_axis(sims, np.maximum(top, 0), axis=1)
    return found, scores


def _hits(cell: pd.DataFrame, query: np.ndarray, neighbour: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    ids, orders = cell["id"], cell["ord"].to_numpy()
    return pd.DataFrame({
        "id": ids.to_numpy()[query], "neighbour": ids.to_numpy()[neighbour], "score": score, "neighbour_ord": orders[neighbour],
    })


def _units(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _search_cell(k: int, earlier: bool, block_rows: int | None = None, work: bool = False):
    """Every customer of a cell, or a block of one, against itself; with an index above `block_rows`. With `work` what the index visits."""
    def search(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["customer_name", "ord", "id"], kind="stable", ignore_index=True)
        vectors, asks = _units(cell["embedding"]), cell["asks"].to_numpy()
        copies = pd.factorize(cell["copy_key"])[0]
        bounds = np.flatnonzero(np.r_[True, (cell["customer_name"] != cell["customer_name"].shift()).to_numpy()[1:], True])
        out, visits = [np.zeros((3, 0), np.int64)], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            c = np.arange(low, high)
            q = c[asks[c]]
            if block_rows and len(c) > block_rows:
                found, score, blocks, visited = _indexed_best(vectors[c], asks[c], copies[c], k, earlier, block_rows)
                row, slot = np.nonzero(found >= 0)
                out.append(np.stack([c[row], c[found[row, slot]], score[row, slot]]))
                visits.append((cell["customer_name"][low], blocks, blocks * len(q), visited))
            elif len(q) and not work:
                found, score = _best(vectors[q], vectors[c], q, c, copies[q], copies[c], k, earlier)
                row, slot = np.nonzero(found >= 0)
                out.append(np.stack([q[row], c[found[row, slot]], score[row, slot]]))
        if work:
            return pd.DataFrame(visits, columns=["customer_name", "blocks", "pairs", "visited"])
        return _hits(cell, *np.concatenate(out, axis=1))

    return search


def _indexed_best(vectors, asks, copies, k, earlier, block_rows):
    """The k best of each row that asks among the vectors of its customer, which lie in the order of ties: places, -1 where fewer exist, scores,
    the number of blocks, and how many of them the rows were compared with.

    Near centres are visited first, and before each visit a row's k-th best so far is its floor.
    """
    scale, n = 10 ** _DIGITS, len(vectors)
    # Vectors that are not finite score least with all others, as in `_best`.
    odd = np.isnan(vectors).any(axis=1)
    sound = np.flatnonzero(~odd) if not odd.all() else np.arange(1)
    chosen = sound[np.unique(np.linspace(0, len(sound) - 1, CENTRES).astype(np.int64))]
    # Filled by parts: besides the vectors only this table is as long as the cell.
    angles = np.empty((n, len(chosen)))
    for start in range(0, n, 4 * _CHUNK):
        angles[start:start + 4 * _CHUNK] = np.arccos(np.clip(vectors[start:start + 4 * _CHUNK] @ vectors[chosen].T, -1, 1))
    angles[odd] = 0
    nearest = angles.argmin(axis=1)
    radius = np.array([angles[nearest == e, e].max(initial=0) for e in range(len(chosen))])
    order = np.argsort(nearest, kind="stable")
    edges = np.searchsorted(nearest[order], np.arange(len(chosen) + 1))
    blocks = -(-np.diff(edges) // block_rows)
    starts = np.concatenate([np.linspace(a, z, b + 1)[:-1].astype(np.int64) for a, z, b in zip(edges[:-1], edges[1:], blocks, strict=True)])
    part = np.empty(n, np.int64)
    part[order] = np.searchsorted(starts, np.arange(n), side="right")

    score, found, visited = np.full((n, k), _NONE), np.full((n, k), -1), 0
    for low, end in zip(starts, np.r_[starts[1:], n], strict=True):
        c = order[low:end]
        q = c[asks[c]]
        if len(q):
            at, own = _best(vectors[q], vectors[c], q, c, copies[q], copies[c], k, earlier)
            at, own = np.where(at >= 0, c[at], -1), np.where(at >= 0, own, _NONE)
            best = np.lexsort((at, -own), axis=1)
            found[q], score[q] = np.take_along_axis(at, best, axis=1), np.take_along_axis(own, best, axis=1)
    for centre in range(len(chosen)):
        q = order[edges[centre]:edges[centre + 1]]
        q = q[asks[q]]
        for start in range(0, len(q), _CHUNK):
            chunk = q[start:start + _CHUNK]
            for e in np.argsort(np.where(np.arange(len(chosen)) == centre, -1, angles[chosen[centre]]), kind="stable"):
                # A copy that is found may lose its tie to another one. Angles are computed to about 1e-8 near zero, similarities rounded to billionths.
                reach = np.cos(np.maximum(0, angles[chunk, e] - radius[e] - 1e-6)) * scale + 10
                some = chunk[reach >= np.minimum(score[chunk, -1], scale)]
                visited += len(some) * int(blocks[e])
                for a in range(edges[e], edges[e + 1], 4 * _CHUNK):
                    if not len(some):
                        break
                    c = order[a:min(a + 4 * _CHUNK, edges[e + 1])]
                    sims = vectors[some] @ vectors[c].T
                    if odd.any():
                        sims[np.isnan(sims)] = -1
                    least = np.minimum(score[some, -1], scale) / scale - 2 / scale
                    i, j = np.nonzero(sims >= least[:, None])
                    mine, theirs = some[i], c[j]
                    fits = part[mine] != part[theirs]
                    if earlier:
                        fits &= theirs < mine
                    i, j, mine, theirs = i[fits], j[fits], mine[fits], theirs[fits]
                    if len(i):
                        exact = np.clip(np.rint(np.round(sims[i, j], _DIGITS) * scale).astype(np.int64), -scale, scale)
                        _bettered(score, found, mine, np.where(copies[mine] == copies[theirs], 2 * scale, exact), theirs)
    return found, score, int(blocks.sum()), visited


def _bettered(score: np.ndarray, found: np.ndarray, row: np.ndarray, new_score: np.ndarray, new: np.ndarray) -> None:
    """Puts hits (row, new_score, new) among the best of their rows, in place: higher scores first, then smaller candidate places."""
    k, rows = score.shape[1], np.unique(row)
    where = np.r_[np.repeat(rows, k), row]
    scores, places = np.r_[score[rows].ravel(), new_score], np.r_[found[rows].ravel(), new]
    order = np.lexsort((places, -scores, where))
    rank = np.arange(len(order)) - np.searchsorted(where[order], where[order])
    kept, slot = order[rank < k], rank[rank < k]
    score[where[kept], slot], found[where[kept], slot] = scores[kept], places[kept]


def _search_visit(k: int, earlier: bool):
    """Visiting rows against the vectors of a cell, without those of a row's own block: of each centre's vectors by the rows whose `reached` has its bit,
    and only scores that reach the row's floor and its k-th best so far are looked at."""
    def search(visitors: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        # Filled before they meet: 64 bits of `reached` would not survive a column with gaps.
        rows = pd.concat([visitors.assign(_q=True, centre=np.int32(-1)), cell.assign(_q=False, floor=np.int64(0), reached=np.int64(0))])
        rows = rows.sort_values(["ord", "id"], kind="stable", ignore_index=True)
        if not len(visitors) or not len(cell):
            return _hits(rows, *np.zeros((3, 0), np.int64))
        scale, asks = 10 ** _DIGITS, rows["_q"].to_numpy(bool)
        copies, part, centre = pd.factorize(rows["copy_key"])[0], rows["part"].to_numpy(np.int64), rows["centre"].to_numpy(np.int64)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.argsort(centre[c], kind="stable")]
        queries, candidates = _units(rows["embedding"][q]), _units(rows["embedding"][c])
        floor, reached = rows["floor"].to_numpy()[q].astype(np.int64), rows["reached"].to_numpy()[q].astype(np.int64)
        edges = np.r_[0, np.flatnonzero(np.diff(centre[c])) + 1, len(c)]
        score, found = np.full((len(q), k), _NONE), np.full((len(q), k), -1)
        for start in range(0, len(q), _CHUNK):
            chunk = np.arange(start, min(start + _CHUNK, len(q)))
            for low, end in zip(edges[:-1], edges[1:], strict=True):
                some = chunk[(reached[chunk] >> centre[c[low]]) & 1 == 1]
                for a in range(low, end, 4 * _CHUNK):
                    if not len(some):
                        break
                    z = min(a + 4 * _CHUNK, end)
                    sims = queries[some] @ candidates[a:z].T
                    least = np.maximum(floor[some], score[some, -1]) / scale - 2 / scale
                    i, j = np.nonzero(sims >= least[:, None])
                    mine, theirs = q[some[i]], c[a + j]
                    fits = part[mine] != part[theirs]
                    if earlier:
                        fits &= theirs < mine
                    i, j, mine, theirs = i[fits], j[fits], mine[fits], theirs[fits]
                    if len(i):
                        exact = np.clip(np.rint(np.round(sims[i, j], _DIGITS) * scale).astype(np.int64), -scale, scale)
                        _bettered(score, found, some[i], np.where(copies[mine] == copies[theirs], 2 * scale, exact), theirs)
        row, slot = np.nonzero(found >= 0)
        return _hits(rows, q[row], found[row, slot], score[row, slot])

    return search


def _assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Nearest centre, the angle to it and, for rows that ask, the angles to all."""
    rows = rows.drop(columns="salt")
    if not len(rows):
        return rows.assign(centre=pd.Series([], dtype="int32"), angle=pd.Series([], dtype="float64"), angles=pd.Series([], dtype="object"))
    centres = centres.sort_values("centre", ignore_index=True)
    angles = np.arccos(np.clip(_units(rows["embedding"]) @ _units(centres["embedding"]).T, -1, 1))
    nearest = angles.argmin(axis=1)
    asked = [a if q else None for a, q in zip(angles, rows["asks"], strict=True)]
    return rows.assign(centre=nearest.astype(np.int32), angle=angles[np.arange(len(rows)), nearest], angles=asked)


def _found_schema(vectors: DataFrame) -> T.StructType:
    id_type = vectors.schema["id"].dataType
    return T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("neighbour", id_type),
            T.StructField("score", T.LongType()),
            T.StructField("neighbour_ord", T.LongType()),
        ]
    )


def _keyed(vectors: DataFrame, order: str, exclude: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a customer and a direction, and the same without their vectors, with copy_key."""
    length = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    usable = vectors.where(F.col("customer_name").isNotNull() & (length > 0))
    if exclude:
        usable = usable.where(~F.col("customer_name").isin(*exclude))
    # Narrow rows first: the vectors themselves are shuffled only for the comparison.
    keyed = usable.select(
        "id",
        "customer_name",
        F.col(order).cast("bigint").alias("ord"),
        F.unhex(F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)).alias("copy_key"),
        (F.col("asks") if "asks" in vectors.columns else F.lit(True)).alias("asks"),
        F.size("embedding").alias("dims"),
    )
    return usable.select("id", "embedding"), keyed


def _heads_of(keyed: DataFrame, k: int) -> DataFrame:
    """The first k+1 members of every group of copies."""
    place = F.row_number().over(Window.partitionBy("customer_name", "copy_key").orderBy("ord", "id"))
    return cut_lineage(keyed.withColumn("place", place).where(F.col("place") <= k + 1))


def neighbours(vectors: DataFrame, k: int = TOP_K, mode: str = "any", order: str = "id",
               block_rows: int = BLOCK_ROWS, exclude: Sequence[str] = (), cell_rows: int | None = None) -> DataFrame:
    """The k nearest vectors of the same customer: id, neighbour, similarity, rank.

    `vectors` has id, customer_name, embedding and the bigint column `order`. `mode='earlier'` compares a case
    only with earlier ones (J3); `mode='any'` with every other. A missing customer name never matches.
    A cell holds `cell_rows` vectors. Unless given, a customer's own holds as many as make `CELL_VALUES` numbers, one of several `CELL_ROWS`.
    """
    if mode not in ("any", "earlier"):
        raise ValueError(f"unknown mode: {mode}")
    group = ["customer_name", "copy_key"]
    usable, keyed = _keyed(vectors, order, exclude)
    heads = _heads_of(keyed, k)
    schema = _found_schema(vectors)
    earlier = mode == "earlier"
    small, large = _placed(heads, usable, block_rows, cell_rows or _cell_rows(heads, block_rows))
    found = small.groupBy("cell").applyInPandas(_search_cell(k, earlier, block_rows), schema)
    if large is not None:
        found = found.unionByName(_search_large(large, k, earlier, block_rows, schema, cell_rows or CELL_ROWS)[0])
    # A copy group has members beyond its first k+1 only if it has a (k+1)-th one.
    full = heads.where(F.col("place") == k + 1).select(*group)
    if not full.isEmpty():
        found = found.unionByName(_beyond(keyed, heads, full, group, k))

    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbour_ord", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    similarity = F.least(F.col("score"), F.lit(10 ** _DIGITS)).cast("double") / 10 ** _DIGITS
    return ranked.select("id", "neighbour", similarity.alias("similarity"), "rank")


def _cell_rows(heads: DataFrame, block_rows: int) -> int:
    """Vectors that a customer's own cell holds."""
    return max(block_rows, CELL_VALUES // max(heads.agg(F.max("dims")).first()[0] or 1, 1))


def _placed(heads: DataFrame, embedded: DataFrame, block_rows: int, cell_rows: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Heads with their vectors: those of customers that fit a cell with the cell they lie in, and those of larger ones, None where there are none.

    Customers up to `block_rows` share cells, others up to `cell_rows` have one each. A customer of which no row asks has no cell.
    """
    sizes = heads.groupBy("customer_name").agg(F.count("*").alias("_w"), F.count_if("asks").alias("_ask")).where(F.col("_ask") > 0)
    blocks = F.when(F.col("_w") > block_rows, F.ceil(F.col("_w") / block_rows)).otherwise(0).cast("int")
    fits = F.col("_w") <= max(block_rows, cell_rows)
    sizes = cut_lineage(sizes.select("customer_name", "_w", blocks.alias("_blocks"), fits.alias("_fits")))
    sized = attach_by_key(heads.drop("place", "dims"), sizes, "customer_name", "_w", "id").where(F.col("_blocks").isNotNull())
    bundles = heads.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("n")).scalar()
    bundle = F.concat(F.lit("bundle"), F.pmod(F.xxhash64("customer_name"), bundles))
    cell = F.when(F.col("_blocks") == 0, bundle).otherwise(F.concat(F.lit("customer\u0001"), "customer_name"))
    small = sized.where("_fits").withColumn("cell", cell).drop("_blocks", "_fits").join(embedded, "id")
    if sizes.where(~F.col("_fits")).isEmpty():
        return small, None
    return small, cut_lineage(sized.where(~F.col("_fits")).drop("_fits").join(embedded, "id"))


def _index(large: DataFrame, block_rows: int, cell_rows: int) -> DataFrame:
    """Rows of large customers with centre, angle, angles, the block they lie in, its number `part` within the customer, and the cell.

    A cell is what moves at once: the blocks of neighbouring centres up to about `cell_rows` vectors, or a share of the blocks of a larger centre.
    """
    place = F.row_number().over(Window.partitionBy("customer_name").orderBy(F.xxhash64("id"), "id"))
    chosen = large.select("id", "customer_name").withColumn("centre", place - 1).where(F.col("centre") < CENTRES)
    large = large.withColumn("_salts", F.ceil(F.col("_blocks") * block_rows / cell_rows).cast("int")).drop("_blocks")
    centres = cut_lineage(chosen.select("id", "centre").join(large.select("id", "customer_name", "embedding", "_salts"), "id").drop("id"))
    spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    rows = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")).drop("_salts")
    fields = [f for f in rows.schema.fields if f.name != "salt"]
    schema = T.StructType([
        *fields, T.StructField("centre", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("angles", T.ArrayType(T.DoubleType()))
    ])
    keys = ["customer_name", "salt"]
    assigned = cut_lineage(rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_assign, schema))
    named = assigned.withColumn("cluster", F.concat_ws("\u0001", "customer_name", "centre"))
    clusters = named.groupBy("cluster", "customer_name", "centre").agg(
        F.count("*").alias("_w"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), F.ceil(F.count("*") / cell_rows).cast("int").alias("shares")
    )
    # At most CENTRES rows a customer.
    before = Window.partitionBy("customer_name").orderBy("centre").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.when(F.col("shares") == 1, F.col("_w")).otherwise(0)).over(before), F.lit(0))
    clusters = clusters.withColumn("shelf", F.floor(filled / cell_rows)).drop("customer_name", "centre")
    dealt = attach_by_key(named, clusters, "cluster", "_w", "id").withColumn("_no", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    shared = F.concat_ws("\u0001", "cluster", F.col("_no") % F.col("shares"))
    return cut_lineage(dealt.withColumns({
        "block": F.concat_ws("\u0001", "cluster", "_no"), "part": F.shiftleft(F.col("centre").cast("long"), 32) + F.col("_no"),
        "cell": F.when(F.col("shares") > 1, shared).otherwise(F.concat_ws("\u0001", "customer_name", F.lit("shelf"), "shelf")),
    }).drop("blocks", "shares", "shelf", "cluster", "_no"))


def _search_large(large: DataFrame, k: int, earlier: bool, block_rows: int, schema: T.StructType,
                  cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours found, the visits (id, cell, blocks that the visit compares with), and the indexed rows.

    A row moves once to each cell with a block that its floor reaches, so what moves is bounded by rows times cells, whatever the size of a block.
    """
    cell_rows = max(cell_rows, block_rows)
    rows = _index(large, block_rows, cell_rows)
    inside = ["id", "customer_name", "ord", "copy_key", "asks", "embedding"]
    own = cut_lineage(rows.select(*inside, "block").groupBy("block").applyInPandas(_search_cell(k, earlier), schema))
    floors = own.groupBy("id").agg(F.when(F.count("*") >= k, F.least(F.min("score"), F.lit(10 ** _DIGITS))).alias("floor"))
    reach = rows.groupBy("customer_name", "cell", "centre").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.count_distinct("part").alias("blocks"))
    entry = F.struct("centre", "radius", "blocks", F.expr("shiftleft(1L, centre)").alias("bit"))
    cells = reach.groupBy("customer_name", "cell").agg(F.sum("n").alias("n"), F.collect_list(entry).alias("entries"))
    index = cells.groupBy("customer_name").agg(F.sum("n").alias("_w"), F.collect_list(F.struct("cell", "entries")).alias("cells"))
    columns = ["id", "ord", "copy_key", "embedding", "part"]
    asking = attach_by_key(rows.where("asks").select(*columns, "customer_name", "angles").join(floors, "id", "left"), index, "customer_name", "_w", "id")
    # Angles are computed to about 1e-8 near zero, similarities rounded to billionths.
    nearest = lambda e: F.greatest(F.lit(0.0), F.get("angles", e["centre"]) - e["radius"] - 1e-6)
    reaches = lambda e: F.col("floor").isNull() | (F.cos(nearest(e)) * 10 ** _DIGITS + 10 >= F.col("floor"))
    total = lambda some, what, add: F.aggregate(some, F.lit(0).cast("long"), lambda a, e: add(a, e[what].cast("long")))
    seen = F.transform("cells", lambda x: F.struct(x["cell"].alias("cell"), F.filter(x["entries"], reaches).alias("at")))
    brief = F.transform(F.filter(seen, lambda x: F.size(x["at"]) > 0), lambda x: F.struct(
        x["cell"].alias("cell"), total(x["at"], "bit", lambda a, b: a.bitwiseOR(b)).alias("reached"), total(x["at"], "blocks", lambda a, b: a + b).alias("blocks")
    ))
    going = cut_lineage(asking.select(*columns, F.coalesce("floor", F.lit(_NONE)).cast("long").alias("floor"), brief.alias("visits")))
    visits = going.select("id", F.explode(F.transform("visits", lambda v: F.struct(v["cell"].alias("cell"), v["blocks"].alias("blocks")))).alias("v")).select("id", "v.*")
    crowd = cut_lineage(visits.groupBy("cell").agg(F.count("*").alias("_w"), F.ceil(F.count("*") / cell_rows).cast("int").alias("chunks")))
    groups = crowd.agg(F.coalesce(F.sum("chunks"), F.lit(1)).alias("n")).first()["n"]
    queries = going.select(*columns, "floor", F.explode("visits").alias("v")).select(*columns, "floor", "v.cell", "v.reached")
    queries = queries.join(F.broadcast(crowd.select("cell", "chunks")), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    candidates = rows.select(*columns, "centre", "cell").join(F.broadcast(crowd.select("cell", "chunks")), "cell").select(
        *[F.col(c).alias(c) for c in (*columns, "centre", "cell")], F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    # A group is small on disk and dear to compare: groups are dealt over tasks of their own.
    keys, tasks = ["cell", "chunk"], max(min(2 * groups, MAX_TASKS), 1)
    visiting, visited = (x.drop("chunks").repartition(tasks, *keys).groupBy(*keys) for x in (queries, candidates))
    return own.unionByName(visiting.cogroup(visited).applyInPandas(_search_visit(k, earlier), schema)), visits, rows


def _beyond(keyed: DataFrame, heads: DataFrame, full: DataFrame, group: list[str], k: int) -> DataFrame:
    """Members of a copy group after its first k+1: their neighbours are the first k members."""
    first_k = heads.where(F.col("place") <= k).join(full, group, "left_semi").groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("neighbour"), F.col("ord").alias("neighbour_ord"))))
        .alias("_first")
    )
    weights = keyed.groupBy(*group).agg(F.count("*").alias("_w")).where(F.col("_w") > k + 1)
    whole = F.concat_ws("\u0001", "customer_name", F.hex("copy_key"))
    per_group = first_k.join(weights, group).select(whole.alias("_group"), "_first", "_w")
    late = keyed.where("asks").select("id", whole.alias("_group")).join(heads.select("id"), "id", "left_anti")
    answers = attach_by_key(late, per_group, "_group", "_w", "id").select("id", F.inline("_first"))
    return answers.select(
        "id", "neighbour", F.lit(2 * 10 ** _DIGITS).cast("long").alias("score"), "neighbour_ord"
    )


def detect(vectors: DataFrame, threshold: float = DUPLICATE_THRESHOLD, **search) -> DataFrame:
    """Every case with its best neighbour's similarity and, at or above the threshold, its original."""
    nearest = neighbours(vectors, **search).where((F.col("rank") == 1) & (F.col("similarity") > 0))
    return vectors.select("id").join(nearest, "id", "left").select(
        "id",
        F.when(F.col("similarity") >= threshold, F.col("neighbour")).alias("duplicate_of"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 4).alias("similarity"),
    )


def block_sizes(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors per customer and the number of comparison cells they cost."""
    sizes = vectors.where(F.col("customer_name").isNotNull()).groupBy("customer_name").agg(F.count("*").alias("vectors"))
    blocks = F.ceil(F.col("vectors") / block_rows)
    return sizes.withColumn("cells", (blocks * (blocks + 1) / 2).cast("long"))


def search_work(vectors: DataFrame, k: int = TOP_K, block_rows: int = BLOCK_ROWS, cell_rows: int | None = None) -> DataFrame:
    """Per large customer: its blocks, and of all pairs of a row that asks and a block those that the search of `neighbours` visits."""
    embedded, keyed = _keyed(vectors, "id", ())
    heads = _heads_of(keyed, k)
    small, large = _placed(heads, embedded, block_rows, cell_rows or _cell_rows(heads, block_rows))
    done = small.groupBy("cell").applyInPandas(_search_cell(k, False, block_rows, work=True), "customer_name string, blocks long, pairs long, visited long")
    if large is None:
        return done
    _, visits, rows = _search_large(large, k, False, block_rows, _found_schema(vectors), cell_rows or CELL_ROWS)
    per_customer = rows.groupBy("customer_name").agg(F.count_distinct("block").alias("blocks"), F.count_if("asks").alias("asking"))
    visited = visits.withColumn("customer_name", F.split("cell", "\u0001")[0]).groupBy("customer_name").agg(F.sum("blocks").alias("visited"))
    pairs = (F.col("blocks") * F.col("asking")).alias("pairs")
    return done.unionByName(
        per_customer.join(visited, "customer_name", "left").select("customer_name", "blocks", pairs, F.coalesce("visited", F.lit(0)).alias("visited"))
    )


def text_vectors(df: DataFrame, text: str, dims: int = 384) -> DataFrame:
    """Unit-length hashed TF-IDF vectors for inputs without embeddings."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    )
    out = stages.fit(filled).transform(filled)
    return out.withColumn("embedding", vector_to_array("_unit", dtype="float32")).drop(
        "_text", "_words", "_tf", "_idf", "_unit"
    )
