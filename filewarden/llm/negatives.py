"""Hard negatives by coordinate pruning over length buckets.

Vectors of whole numbers are dealt into groups of about `GROUP` rows. A group is an index row: its vectors by falling
length in buckets of `BUCKET`, and for each bucket and coordinate the rows in the order of the coordinate of the unit
vector. Anchors are the query set: they meet every group, in blocks of `ANCHORS`, so a task holds one group and one
block. Within a group an anchor goes through the buckets from long to short vectors. The score it must reach, divided
by both lengths, bounds the angle between the vectors, and with it the range in which a coordinate of a feasible row
must lie. The ranges of the `FOCUS` largest coordinates of the anchor are found in the sorted lists; the shortest one is
read, the others filter it, and what is left is verified by its whole inner product. A bucket whose longest vector
cannot reach the score is skipped.

The score to reach is that of the last of the best rows so far: of rows of the anchor's label for its positives, then,
for each of their scores, of rows of other labels between `LOW` and `HIGH` % of it. A group returns only the best rows
of an anchor; they are ranked over all groups. Nothing is approximate: pruning only skips rows that cannot be among them.

Rows with a null id or label, a null vector, or null or non-finite components take no part. Only vectors of equal
length are compared. Zero and empty vectors score 0. Rows are told apart by their place, so repeated rows are rows of
their own, each also an anchor if its id says so. Ties go by id. Scores beyond 64 bits count as the largest number
that fits. Other columns are not read. Empty input gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewarden.session import stored

EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
GROUP = 16_384
BUCKET = 2048
ANCHORS = 4096
FOCUS = 3
SLACK = 1e-9
INDEX = "size int, grp bigint, place binary, vec_id binary, label binary, v binary, sorted binary"
FOUND = "anchor bigint, positive_score bigint, place bigint, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(place, vec_id, label, size, v): the usable rows of `vectors` (vec_id, embedding, label) as whole numbers."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), x.alias("x"))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    v = F.transform("x", lambda e: F.floor(e * scale).cast("bigint"))
    return usable.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", F.size("x").alias("size"), v.alias("v"))


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, size)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = v.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norms > 0, norms, 1)[:, None], norms


def index_groups(rows: DataFrame, groups: int, bucket: int) -> DataFrame:
    """`INDEX`: every group with its vectors by falling length and the sorted coordinate lists of its buckets."""

    def run(key, table):
        size, grp = key[0].as_py(), key[1].as_py()
        v = _matrix(table, size)
        unit, norms = _unit(v)
        order = np.argsort(-norms, kind="stable")
        lists = [np.argsort(unit[order[at : at + bucket]], axis=0, kind="stable").T.astype(np.int32) for at in range(0, len(order), bucket)]
        columns = [table.column(c).to_numpy()[order].astype(np.int64).tobytes() for c in ("place", "vec_id", "label")]
        values = [size, grp, *columns, v[order].tobytes(), b"".join(x.tobytes() for x in lists)]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table({c.split()[0]: pa.array([x], k) for c, x, k in zip(INDEX.split(", "), values, kinds)})

    grp = F.pmod(F.xxhash64("place"), F.lit(groups)).alias("grp")
    return rows.select("size", grp, "place", "vec_id", "label", "v").groupBy("size", "grp").applyInArrow(run, INDEX)


class Bucket:
    """Vectors of similar length with a sorted list per coordinate."""

    def __init__(self, place, vec_id, label, v: np.ndarray, lists: np.ndarray):
        self.place, self.vec_id, self.label, self.v, self.lists = place, vec_id, label, v, lists
        self.unit, norms = _unit(v)
        self.longest = float(norms.max())
        self.values = np.take_along_axis(self.unit.T, lists, axis=1) if v.shape[1] else None
        self.floats = v.astype(np.float64)

    def candidates(self, unit: np.ndarray, norm: float, least: int, focus: np.ndarray) -> np.ndarray | slice:
        """Rows whose score may be `least` or more."""
        reach = norm * self.longest
        if least <= 0:
            return slice(None)
        if least > reach * (1 + SLACK):
            return np.empty(0, np.int64)
        angle = np.arccos(min(1.0, least / reach)) + SLACK
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - SLACK, np.cos(np.maximum(0, own - angle)) + SLACK
        spans = [(np.searchsorted(self.values[f], a), np.searchsorted(self.values[f], b, "right")) for f, a, b in zip(focus, low, high)]
        best = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        rows = self.lists[focus[best]][spans[best][0] : spans[best][1]]
        for i, f in enumerate(focus):
            if i != best and spans[i][1] - spans[i][0] < len(self.v):
                x = self.unit[rows, f]
                rows = rows[(x >= low[i]) & (x <= high[i])]
        return rows

    def scores(self, q: np.ndarray, norm: float, rows: np.ndarray | slice) -> np.ndarray:
        """Inner products, exact: in doubles while every sum fits them."""
        if norm * self.longest < 1 << 52:
            return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        ends = np.iinfo(np.int64)
        return np.array([min(max(x, ends.min), ends.max) for x in self.v[rows].astype(object) @ q.astype(object)], dtype=np.int64)


class Best:
    """The `n` best rows so far: by score, then id."""

    def __init__(self, n: int):
        self.n, self.rows = n, np.empty((0, 3), np.int64)

    def add(self, score: np.ndarray, vec_id: np.ndarray, place: np.ndarray) -> None:
        if len(score):
            every = np.concatenate([self.rows, np.stack([score, vec_id, place], axis=1)])
            self.rows = every[np.lexsort((every[:, 2], every[:, 1], -every[:, 0]))[: self.n]]

    def least(self) -> int | None:
        return int(self.rows[-1, 0]) if len(self.rows) == self.n else None


def _buckets(table: pa.Table, size: int, bucket: int) -> list[Bucket]:
    row = {c: table.column(c)[0].as_py() for c in ("place", "vec_id", "label", "v", "sorted")}
    place, vec_id, label = (np.frombuffer(row[c], np.int64) for c in ("place", "vec_id", "label"))
    v, lists = np.frombuffer(row["v"], np.int64).reshape(len(place), size), np.frombuffer(row["sorted"], np.int32)
    cut = lambda at: slice(at, at + bucket)
    of = lambda at: lists[at * size : (at + len(place[cut(at)])) * size].reshape(size, len(place[cut(at)]))
    return [Bucket(place[cut(at)], vec_id[cut(at)], label[cut(at)], v[cut(at)], of(at)) for at in range(0, len(place), bucket)]


def same_label(buckets: list[Bucket], place: int, label: int, q, unit, norm: float, focus, n: int) -> dict[int, np.ndarray]:
    """The best other rows of a label, under the key 0."""
    best, least = Best(n), None
    for bucket in buckets:
        rows = slice(None) if least is None else bucket.candidates(unit, norm, least, focus)
        score = bucket.scores(q, norm, rows)
        keep = (bucket.label[rows] == label) & (bucket.place[rows] != place)
        keep &= score >= (least if least is not None else np.iinfo(np.int64).min)
        best.add(score[keep], bucket.vec_id[rows][keep], bucket.place[rows][keep])
        least = best.least()
    return {0: best.rows}


def other_labels(buckets: list[Bucket], positives: list[int], label: int, q, unit, norm: float, focus, n: int) -> dict[int, np.ndarray]:
    """For every positive score, the best rows of other labels within its limits."""
    best = {p: Best(n) for p in positives if p >= 0}  # a negative score has no row between its limits
    least = {p: -(-LOW * p // 100) for p in best}
    for bucket in buckets if best else ():
        rows = bucket.candidates(unit, norm, min(least.values()), focus)
        score = bucket.scores(q, norm, rows)
        other = bucket.label[rows] != label
        score, vec_id, place = score[other], bucket.vec_id[rows][other], bucket.place[rows][other]
        for p, found in best.items():
            keep = (score >= least[p]) & (score <= HIGH * p // 100)
            found.add(score[keep], vec_id[keep], place[keep])
            last = found.least()
            least[p] = least[p] if last is None else max(least[p], last)
    return {p: b.rows for p, b in best.items()}


def search_tiles(anchors: DataFrame, index: DataFrame, groups: int, blocks: int, n: int, bucket: int, focus: int, positives: bool) -> DataFrame:
    """`FOUND`: the up to `n` best rows of every group for every anchor (place, label, size, v, scores)."""

    def run(key, own, group):
        out: list[list[int]] = [[] for _ in FOUND.split(", ")]
        if own.num_rows and group.num_rows:
            size = key[0].as_py()
            buckets = _buckets(group, size, bucket)
            v = _matrix(own, size)
            unit, norms = _unit(v)
            scores = own.column("scores").to_pylist()
            for i, (place, label) in enumerate(zip(own.column("place").to_pylist(), own.column("label").to_pylist())):
                at = np.argsort(-np.abs(unit[i]), kind="stable")[:focus]
                args = (label, v[i], unit[i], float(norms[i]), at, n)
                found = same_label(buckets, place, *args) if positives else other_labels(buckets, scores[i], *args)
                for p, rows in found.items():
                    for score, vec_id, of in rows.tolist():
                        for column, x in zip(out, (place, p, of, vec_id, score)):
                            column.append(x)
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(FOUND.split(", "), out)})

    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    block = F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block")
    left = anchors.select("place", "label", "size", "v", "scores", block, upto(groups).alias("grp"))
    right = index.select("*", upto(blocks).alias("block"))
    keys = ["size", "grp", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
    group: int = GROUP,
    bucket: int = BUCKET,
    block: int = ANCHORS,
    focus: int = FOCUS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by `every`.
    """
    rows = stored(whole_vectors(vectors, scale))
    is_anchor = F.col("vec_id") % every == 0
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    groups, blocks = max(1, ceil(count["n"] / group)), max(1, ceil(count["anchors"] / block))
    index = stored(index_groups(rows, groups, bucket))
    anchors = rows.filter(is_anchor).select("place", "vec_id", "label", "size", "v")
    none = F.array().cast("array<bigint>")
    tiled = search_tiles(anchors.withColumn("scores", none), index, groups, blocks, positives, bucket, focus, True)
    first = stored(_first(tiled, positives).select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = first.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor", "place"), "place")
    found = _first(search_tiles(asked, index, groups, blocks, negatives, bucket, focus, False), negatives)
    found = found.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = first.drop("place").join(found, ["anchor", "positive_score"]).join(names, "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
