"""Near-duplicate vectors by a PCA-ordered, tiled comparison.

The axes are fitted on a bounded sample (`SAMPLE` vectors, the ones with the smallest digests of their id; only the
order of the dimensions depends on it, never the result). Unit vectors are turned to these axes. Two vectors with a
cosine of at least t differ by at most sqrt(2 - 2t) in any coordinate, so vectors are put into cells of that width
along the first axis, and only the same and the next cell of a label are compared. Cells are cut into blocks of about
`BLOCK` vectors by a digest; a task compares two blocks, in pieces of `PIECE` rows. It adds the leading dimensions
first, bounds the rest of each product by the norms of the remaining parts, and drops a pair as soon as it cannot reach
the threshold; a piece whose pairs are all dropped stops. Up to a block in a cell, a vector is sent three times at most. Pairs that are left are verified by the cosine of the given vectors in doubles.

Equal vectors of a label are one class with a count, so copies are never paired. A tile returns link counts and a
spanning forest of its links, as many rows as it has vectors, never its pairs. Pairs within a label are compared in
blocks: the work is quadratic in the largest cell of a label, which is what an exact comparison of it asks for.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link with
nothing and are their own component. Vectors of different lengths do not link. Repeated rows count as links of each
other; classes are numbered, so rows that share an id but not a vector or label keep their own links. Other columns are
not read. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewarden.llm.components import components
from filewarden.session import stored

COSINE = 0.93
SAMPLE = 4096
BLOCK = 8192
PIECE = 1024
STEPS = (8, 16, 32)
SLACK = 1e-9


def principal_axes(vectors: DataFrame, size: int, sample: int = SAMPLE) -> np.ndarray:
    """Orthonormal axes by falling variance of the unit vectors of a bounded sample of the vectors of one length."""
    picked = vectors.filter(F.size("v") == size).orderBy(F.xxhash64("first"), "first", "rep").select("v").limit(sample).collect()
    data = np.array([row["v"] for row in picked], dtype=np.float64).reshape(-1, size)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(data.T @ data)
    return axes[:, ::-1].copy()


def valid_classes(vectors: DataFrame) -> DataFrame:
    """(label, v, first, copies, rep) of equal, usable vectors of `vectors` (vec_id, embedding, label); `rep` numbers them."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    usable = vectors.select("vec_id", "label", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & nonzero
    )
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    return classes.withColumn("rep", F.monotonically_increasing_id())


def tiles(classes: DataFrame, axes: dict[int, np.ndarray], cosine: float, block: int) -> DataFrame:
    """The classes, each repeated for the tiles it belongs to, with side 0 or 1."""
    width = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    first = {size: F.array(*[F.lit(float(x)) for x in a[:, 0]]) for size, a in axes.items()}
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    along = F.lit(0.0)
    for size, axis in first.items():
        dot = F.aggregate(F.zip_with("v", axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        along = F.when(F.size("v") == size, dot / norm).otherwise(along)
    celled = classes.withColumn("size", F.size("v")).withColumn("cell", F.floor(along / width).cast("int"))
    counts = celled.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    above = counts.select("label", "size", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next_blocks"))
    below = counts.select("label", "size", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("last_blocks"))
    keys = ["label", "size", "cell"]
    shape = counts.join(above, keys, "left").join(below, keys, "left").na.fill(0, ["next_blocks", "last_blocks"])
    placed = celled.join(shape, keys).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda cell, a, next_cell, b, side: F.struct(
        cell.alias("cell"), a.alias("a"), next_cell.alias("next_cell"), b.alias("b"), F.lit(side).alias("side")
    )
    own, cell = F.col("own"), F.col("cell")
    same = F.transform(
        upto(F.col("blocks")),
        lambda j: F.when(own <= j, tile(cell, own, cell, j, 0)).otherwise(tile(cell, j, cell, own, 1)),
    )
    up = F.transform(upto(F.col("next_blocks")), lambda j: tile(cell, own, cell + 1, j, 0))
    down = F.transform(upto(F.col("last_blocks")), lambda j: tile(cell - 1, j, cell, own, 1))
    return placed.select("label", "size", "rep", "copies", "v", F.explode(F.concat(same, up, down)).alias("t")).select(
        "label", "size", "rep", "copies", "v", "t.*"
    )


def _links(v: np.ndarray, w: np.ndarray, axes: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Which rows of v and w reach the cosine, as a boolean matrix."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = unit(v) @ axes, unit(w) @ axes
    rest = lambda m, k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(axis=1)))
    size = axes.shape[0]
    sums = np.zeros((len(x), len(y)))
    alive = None
    steps = [0, *[s for s in STEPS if s < size], size]
    for start, end in zip(steps, steps[1:]):
        if alive is None:
            sums += x[:, start:end] @ y[:, start:end].T
            bound = sums + np.outer(rest(x, end), rest(y, end))
            possible = bound >= cosine - SLACK
            if same:
                possible &= np.triu(np.ones_like(possible), 1).astype(bool)
            if possible.mean() < 0.05:
                rows, columns = np.nonzero(possible)
                alive, part = (rows, columns), sums[rows, columns]
        else:
            rows, columns = alive
            part = part + np.einsum("ij,ij->i", x[rows, start:end], y[columns, start:end])
            keep = part + rest(x, end)[rows] * rest(y, end)[columns] >= cosine - SLACK
            alive, part = (rows[keep], columns[keep]), part[keep]
        if alive is not None and not len(alive[0]):
            break
    rows, columns = alive if alive is not None else np.nonzero(possible)
    linked = np.zeros((len(x), len(y)), dtype=bool)
    norms_v, norms_w = np.linalg.norm(v, axis=1), np.linalg.norm(w, axis=1)
    for at in range(0, len(rows), 65_536):
        r, c = rows[at : at + 65_536], columns[at : at + 65_536]
        exact = np.einsum("ij,ij->i", v[r], w[c]) / (norms_v[r] * norms_w[c])
        linked[r, c] = exact >= cosine
    return linked


def _forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges from every vertex to the smallest id of its part of a symmetric link matrix."""
    todo, edges = linked.any(axis=1), []
    while todo.any():
        seen = np.zeros(len(ids), dtype=bool)
        front = np.array([int(np.argmax(todo))])
        seen[front] = True
        while len(front):
            reached = linked[front].any(axis=0) & ~seen
            seen |= reached
            front = np.nonzero(reached)[0]
        part = ids[seen]
        edges += [(int(i), int(part.min())) for i in part if i != part.min()]
        todo &= ~seen
    return edges


TILE_ROWS = "rep bigint, links bigint, root bigint"


def _joined(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest number that edges reach from every end of them."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def compare_tiles(tiled: DataFrame, axes: dict[int, np.ndarray], cosine: float, piece: int = PIECE) -> DataFrame:
    """Per tile and class: the vectors of other classes it links with, and edges of the tile's forest.

    A tile is compared in pieces of `piece` rows a side, so only one matrix of that size is held.
    """

    def run(key, table):
        size = key[1].as_py()
        ids, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        values = table.column("v").combine_chunks()
        vectors = values.flatten().to_numpy().reshape(-1, size)
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        same = key[2].as_py() == key[4].as_py() and key[3].as_py() == key[5].as_py()
        right = left if same else right
        counts, edges = np.zeros(len(ids), dtype=np.int64), []
        for a in range(0, len(left), piece):
            for b in range(a if same else 0, len(right), piece):
                x, y = left[a : a + piece], right[b : b + piece]
                once = same and a == b
                linked = _links(vectors[x], vectors[y], axes[size], cosine, once)
                if linked.any():
                    whole = linked | linked.T if once else np.block([[np.zeros((len(x),) * 2, bool), linked], [linked.T, np.zeros((len(y),) * 2, bool)]])
                    members = x if once else np.concatenate([x, y])
                    counts[members] += whole @ copies[members]
                    edges += _forest(whole, ids[members])
        roots, found = _joined(edges), np.nonzero(counts)[0]
        out = (ids[found], counts[found], np.array([roots[i] for i in ids[found].tolist()], dtype=np.int64))
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(TILE_ROWS.split(", "), out)})

    keys = ["label", "size", "cell", "a", "next_cell", "b"]
    return tiled.groupBy(*keys).applyInArrow(run, TILE_ROWS)


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label)."""
    classes = stored(valid_classes(vectors))
    lengths = [row["n"] for row in classes.select(F.size("v").alias("n")).distinct().limit(1000).collect()]
    if len(lengths) >= 1000:
        raise ValueError("vectors have 1000 or more different lengths")
    axes = {n: principal_axes(classes, n, sample) for n in lengths}
    found = stored(compare_tiles(tiles(classes, axes, cosine, block), axes, cosine))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    smallest = roots.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("smallest"))
    result = (
        classes.join(links, "rep", "left")
        .join(roots, "rep", "left")
        .join(smallest, "component", "left")
        .select(
            "label",
            "v",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("smallest", "first").alias("component_id"),
        )
    )
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.col("label").alias("own_label"), v.alias("own")).alias("x")
    joined = rows.join(result.alias("r"), F.expr("x.own_label = r.label AND x.own = r.v AND x.vec_id IS NOT NULL"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
