"""Near-duplicate documents by an exact Jaccard join of their n-gram sets, rarest n-grams first.

1. A document becomes the set of digests of its `N`-word shingles. Sets travel packed: chunks of documents cut their
   sorted digests into slices of the number range, equal sets of a chunk once, with the signatures of the sets that
   have a shingle there. A slice counts in how many different sets a shingle occurs, over all documents, and returns
   to each chunk only its shingles that occur in two or more.
2. In the order (frequency, digest) the shingles of one set only come first, so a document whose prefix of
   `size - needed + 1` shingles is all unique has no partner and is done. The rest keep their shared shingles, which
   is all that an intersection can hold.
3. Equal sets are one class, found by a pre-aggregating group-by and numbered. Classes meet on the
   shingles of their prefixes through a hub per shingle and length band, so a frequent shingle costs rows, not pairs.
   Classes that hubs connect form a block; small blocks share a task, a large one is cut into tiles of bounded size
   and every pair of tiles is a task.
4. A task joins its classes on prefix shingles with length, positional and suffix filters (the suffix filter bounds
   the intersection range by range of the frequency order), skips pairs that earlier links connect already, and
   verifies what is left, once per pair, by the whole intersection. It returns a spanning forest, never pairs.

Digests have 64 bits, signatures of sets 128. Null or empty text: no shingles, linked with nothing. A null id links
with nothing and has a null component. Rows with equal ids and texts are copies; rows that share an id but not a text
are documents of their own, each with the smallest id of its group. Other columns are not read. Empty
input gives an empty result. Work inside one block is quadratic in the classes that no link or filter separates.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewarden.llm.components import components
from filewarden.llm.packed import PRIME_A, PRIME_B, PRIME_C, column, cuts, mixed, pack, unpack
from filewarden.llm.substrings import _HASHES, split_words
from filewarden.session import stored

N = 3
PERCENT = 90
CHUNK_SHINGLES = 1_000_000
SLICE_BYTES = 16 << 20
TILE = 2000
RANGES = 16
SENT = "slice int, chunk bigint, keys binary, docs binary, signs binary, header binary, ids binary"
BACK = "chunk bigint, keys binary, docs binary, counts binary, header binary, ids binary"


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Ascending digests of the different `n`-word shingles; of the whole sequence if it is shorter."""
    found = split_words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else text)
    if not found:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(n, len(own))
    total = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(PRIME_C) + own[k : len(own) - width + 1 + k])
    return np.unique(total)


def _signs(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit signatures per set."""
    out = np.zeros((len(sets), 2), dtype=np.uint64)
    for i, s in enumerate(sets):
        size = np.uint64(len(s))
        out[i, 0] = (s * np.uint64(PRIME_A) ^ (s >> np.uint64(29))).sum(dtype=np.uint64) + size
        out[i, 1] = mixed(s ^ np.uint64(PRIME_B)).sum(dtype=np.uint64) + size
    return mixed(out)


def _first_of_each(ids: list, sizes: np.ndarray, signs: np.ndarray) -> list[int]:
    """The documents that stand for all of the same set in a chunk: those with the smallest id, null last."""
    best: dict[tuple, int] = {}
    for i, (size, pair) in enumerate(zip(sizes.tolist(), signs.tolist())):
        j = best.setdefault((size, *pair), i)
        if i != j and ids[i] is not None and (ids[j] is None or ids[i] < ids[j]):
            best[(size, *pair)] = i
    return sorted(best.values())


def packed_sets(docs: DataFrame, slices: int, n: int) -> DataFrame:
    """Chunks of the sets of `docs` (doc_id bigint, text), as rows per slice."""

    def flush(chunk: int, ids: list, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        signs = _signs(sets)
        first = _first_of_each(ids, sizes, signs)
        keys = np.concatenate([sets[i] for i in first])
        owner = np.repeat(np.array(first, dtype=np.uint16), sizes[first])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        edges, home = cuts(keys, slices), chunk % slices
        header = sizes.tobytes() + signs.tobytes()
        numbers = np.array([-1 if v is None else v for v in ids], np.int64).tobytes()
        packed_ids = numbers + np.array([v is None for v in ids], np.uint8).tobytes()
        rows: list[list] = [[] for _ in range(7)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b and i != home:
                continue
            # The signatures of the sets with a shingle in this slice only, so a slice never outgrows its shingles.
            own_signs = signs[np.unique(owner[a:b]), 0].tobytes()
            extra = (header, packed_ids) if i == home else (None, None)
            for values, value in zip(rows, (i, chunk, pack(keys[a:b]), owner[a:b].tobytes(), own_signs, *extra)):
                values.append(value)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names=[c.split()[0] for c in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]):
        chunk, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), n)
                ids.append(doc_id)
                sets.append(found)
                held += len(found)
                if held >= CHUNK_SHINGLES or len(ids) >= 60_000:
                    yield flush(chunk, ids, sets)
                    chunk, ids, sets, held = chunk + 1, [], [], 0
        if ids:
            yield flush(chunk, ids, sets)
        _HASHES.clear()  # a worker outlives its task

    return docs.mapInArrow(run, SENT)


def shared_shingles(sent: DataFrame) -> DataFrame:
    """For every chunk, its shingles that two or more different sets hold, with the number of sets."""

    def run(key, table):
        parts = [
            (unpack(k), np.frombuffer(d, np.uint16), np.frombuffer(s, np.uint64))
            for k, d, s in zip(column(table, "keys"), column(table, "docs"), column(table, "signs"))
        ]
        keys = np.concatenate([p[0] for p in parts])
        signs = np.concatenate([signs[np.unique(docs, return_inverse=True)[1]] for _, docs, signs in parts])
        order = np.lexsort((signs, keys))
        k, s = keys[order], signs[order]
        new_key = np.ones(len(k), dtype=bool)
        new_key[1:] = k[1:] != k[:-1]
        new_pair = new_key.copy()
        new_pair[1:] |= s[1:] != s[:-1]
        first = np.nonzero(new_key)[0]
        sets = np.add.reduceat(new_pair.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        counts = np.empty(len(k), dtype=np.uint32)
        counts[order] = np.repeat(sets, np.diff(np.append(first, len(k))))
        rows: list[list] = [[] for _ in range(6)]
        at = 0
        for (own, docs, _), chunk, header, ids in zip(parts, column(table, "chunk"), column(table, "header"), column(table, "ids")):
            count = counts[at : at + len(own)]
            at += len(own)
            shared = count > 1
            if shared.any() or header is not None:
                for values, value in zip(rows, (chunk, pack(own[shared]), docs[shared].tobytes(), count[shared].tobytes(), header, ids)):
                    values.append(value)
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array(v, t) for v, t in zip(rows, kinds)], names=[c.split()[0] for c in BACK.split(", ")])

    return sent.groupBy("slice").applyInArrow(run, BACK)


PREPARED = "doc_id bigint, n bigint, s1 bigint, s2 bigint, lead int, tokens array<bigint>, counts array<int>"


def prepared_sets(back: DataFrame, percent: int) -> DataFrame:
    """A row per document: size and signature of its set; for possible partners also its shared shingles in order."""

    def run(key, table):
        keys = np.concatenate([unpack(k) for k in column(table, "keys")])
        docs = np.concatenate([np.frombuffer(d, np.uint16) for d in column(table, "docs")]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in column(table, "counts")]).astype(np.int64)
        header, packed_ids = next((h, i) for h, i in zip(column(table, "header"), column(table, "ids")) if h is not None)
        many = len(header) // 20
        sizes = np.frombuffer(header, np.uint32, many).astype(np.int64)
        signs = np.frombuffer(header, np.uint64, 2 * many, 4 * many).reshape(-1, 2).view(np.int64)
        ids = np.frombuffer(packed_ids, np.int64, many)
        no_id = np.frombuffer(packed_ids, np.uint8, many, 8 * many).astype(bool)
        order = np.lexsort((keys, counts, docs))
        keys, docs, counts = keys[order], docs[order], counts[order]
        shared = np.bincount(docs, minlength=many)
        prefix = sizes - (sizes * percent + 99) // 100 + 1
        lead = np.where(sizes > 0, np.clip(prefix - (sizes - shared), 0, shared), 0)
        wanted = lead[docs] > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(lead > 0, shared, 0))]).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=no_id),
                "n": pa.array(sizes),
                "s1": pa.array(signs[:, 0]),
                "s2": pa.array(signs[:, 1]),
                "lead": pa.array(lead.astype(np.int32)),
                "tokens": lists(keys[wanted].view(np.int64), pa.int64()),
                "counts": lists(counts[wanted].astype(np.int32), pa.int32()),
            }
        )

    return back.groupBy("chunk").applyInArrow(run, PREPARED)


def blocks(nodes: DataFrame, percent: int, tile: int) -> DataFrame:
    """The classes of `nodes`, each repeated for the tasks it belongs to: bundle, a, b, side."""
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100) + 1e-9).cast("int")
    met = nodes.select("rep", band.alias("band"), F.explode(F.slice("tokens", F.lit(1), F.col("lead"))).alias("token"))
    hubs = stored(met.groupBy("token", "band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")))
    up = hubs.select("token", (F.col("band") - 1).alias("band"), F.col("hub").alias("next_hub"))
    inside = met.join(hubs.filter("n > 1").select("token", "band", "hub"), ["token", "band"]).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    across = hubs.join(up, ["token", "band"]).select(F.col("hub").alias("a"), F.col("next_hub").alias("b"))
    found = components(inside.unionByName(across)).select(F.col("id").alias("rep"), F.col("component").alias("block"))
    sizes = found.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.count("*").alias("members"))
    total = sizes.agg(F.sum("members")).first()[0] or 0
    bundles = max(1, ceil(total / tile) * 4)
    placed = nodes.join(found.join(sizes.filter("members > 1"), "block"), "rep")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    own = F.col("own")
    every = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.when(own <= j, pair(own, j, 0)).otherwise(pair(j, own, 1))
    )
    bundle = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(bundles))).otherwise(F.col("block") + bundles)
    return placed.select("rep", "n", "lead", "tokens", "counts", bundle.alias("bundle"), F.explode(every).alias("t")).select(
        "rep", "n", "lead", "tokens", "counts", "bundle", "t.*"
    )


class Block:
    """The classes of a task, in the order (size, id)."""

    def __init__(self, table: pa.Table, percent: int):
        get = lambda name: table.column(name).combine_chunks()
        tokens, counts = get("tokens"), get("counts")
        sizes = tokens.value_lengths().to_numpy()
        flat = tokens.flatten().to_numpy()
        freq = counts.flatten().to_numpy()
        order = np.lexsort((flat, freq))
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[order][1:] != flat[order][:-1]) | (freq[order][1:] != freq[order][:-1])
        ranks = np.empty(len(flat), dtype=np.int64)
        ranks[order] = np.cumsum(new) - 1
        self.many_ranks = int(new.sum())
        n, rep = get("n").to_numpy(), get("rep").to_numpy()
        by_size = np.lexsort((rep, n))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in by_size])
        self.ranks, self.shared = ranks[take], sizes[by_size].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.shared)])
        self.n, self.rep = n[by_size].astype(np.int64), rep[by_size]
        self.lead, self.side = get("lead").to_numpy()[by_size], get("side").to_numpy()[by_size]
        self.percent = percent
        self.parent = np.arange(len(self.n))
        owner = np.repeat(np.arange(len(self.n)), self.shared)
        self.bands = np.zeros((len(self.n), RANGES), dtype=np.int32)
        np.add.at(self.bands, (owner, self.ranks * RANGES // max(1, self.many_ranks)), 1)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def partners(self, x: int, postings: dict[int, list]) -> np.ndarray:
        """Earlier classes that may reach the threshold with `x` and that no link connects to it yet."""
        ids, mine, theirs = [], [], []
        for i, rank in enumerate(self.ranks[self.starts[x] : self.starts[x] + self.lead[x]].tolist()):
            if found := postings.get(rank):
                ids.append(np.array(found[0]))
                theirs.append(np.array(found[1]))
                mine.append(np.full(len(found[0]), i))
        if not ids:
            return np.empty(0, np.int64)
        ids, first = np.unique(np.concatenate(ids), return_index=True)  # the first shared shingle of each pair
        mine, theirs = np.concatenate(mine)[first], np.concatenate(theirs)[first]
        length = (self.n[ids] * 100 >= self.n[x] * self.percent) & (self.side[ids] != self.side[x] if self.cross else True)
        need = self.needed(x, ids)
        position = 1 + np.minimum(self.shared[x] - mine - 1, self.shared[ids] - theirs - 1) >= need
        ids, need = ids[length & position], need[length & position]
        suffix = np.minimum(self.bands[ids], self.bands[x]).sum(axis=1) >= need
        return ids[suffix]

    def needed(self, x: int, ids: np.ndarray) -> np.ndarray:
        total = (self.n[ids] + self.n[x]) * self.percent
        return -(-total // (100 + self.percent))

    def edges(self, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        self.cross = cross
        postings: dict[int, list] = {}
        mark = np.zeros(self.many_ranks, dtype=np.int64)
        for x in range(len(self.n)):
            ids = self.partners(x, postings)
            own = self.ranks[self.starts[x] : self.starts[x + 1]]
            if len(ids):
                mark[own] = 1
                for y in ids[::-1].tolist():
                    if self.root(y) != self.root(x):
                        both = int(mark[self.ranks[self.starts[y] : self.starts[y + 1]]].sum())
                        if both * 100 >= (self.n[x] + self.n[y] - both) * self.percent:
                            a, b = sorted((self.root(x), self.root(y)))
                            self.parent[b] = a
                mark[own] = 0
            for i, rank in enumerate(own[: self.lead[x]].tolist()):
                held = postings.setdefault(rank, [[], []])
                held[0].append(x)
                held[1].append(i)
        roots = np.array([self.root(i) for i in range(len(self.n))])
        moved = roots != np.arange(len(roots))
        return self.rep[moved], self.rep[roots[moved]]


def links(blocked: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links of every task."""

    def run(key, table):
        a, b = Block(table, percent).edges(cross=key[1].as_py() != key[2].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocked.groupBy("bundle", "a", "b").applyInArrow(run, "a bigint, b bigint")


def near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT, tile: int = TILE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, ceil(size / slice_bytes))
    ready = stored(prepared_sets(shared_shingles(packed_sets(given, slices, n)), percent))
    sets = ready.filter("n > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    best = F.min(F.struct("doc_id", "lead", "tokens", "counts")).alias("x")
    nodes = sets.filter("lead > 0").groupBy("s1", "s2", "n").agg(best)
    # A class has its own number: different sets may have the same smallest id. Stored, so the numbers stay.
    nodes = nodes.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", "x.doc_id", "x.lead", "x.tokens", "x.counts")
    nodes = stored(nodes)
    found = components(links(blocks(nodes.drop("s1", "s2", "doc_id"), percent, tile), percent)).withColumnRenamed("id", "rep")
    linked = nodes.select("rep", "s1", "s2", "n", "doc_id").join(found, "rep")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    linked = linked.join(smallest, "component").select("s1", "s2", "n", "smallest")
    of_class = classes.join(linked, ["s1", "s2", "n"], "left").select("s1", "s2", "n", F.coalesce("smallest", "rep").alias("component"))
    joined = ready.filter("n > 0").select("doc_id", "s1", "s2", "n").join(of_class, ["s1", "s2", "n"], "left")
    linked = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    alone = ready.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
