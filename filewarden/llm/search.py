"""Ranked lexical search: MaxScore whose bounds combine term pairs.

Documents are cut where they lie into segments of bounded size. A segment is a row with the posting lists of the terms
that the items use (document, occurrences) and the number of terms of every document. Counts of documents, terms and
documents per term are sums over segments. With them, impacts are known, and every segment gets the intersection lists
of term pairs: neighbours in the falling order of weight of an item. A list holds its documents and the largest sum of
both impacts, the joint maximum.

A search goes through an item's terms by falling weight. The best that the terms from place i on can add is the
smallest of `own + rest(i + 1)` and `pair + rest(i + 2)`, where `own` is the largest impact of term i and `pair` the
largest of both terms' own ones and their joint maximum: a document holds one of them or both. The bound is thus never
above the sum of independent maxima. Lists behind the place where the rest falls under the threshold open no new
document; documents that cannot reach it any more are dropped list by list.

The threshold comes first: documents of an item's rarest pair lists are scored whole in every segment, and the last of
the overall best ones, score and id, is what a result must reach. No segment returns more than `top` rows an item, and
mostly fewer, so the last ranking is small. All sums are 64-bit integers.

Items are read in blocks of `ITEMS` (the only rows the driver and each task hold whole); each block is a pass over
the documents. Segments are independent: no shuffle of texts or postings, no hot term or copy meets in one task.

Null or empty text: no terms, never a result. A null id ranks behind all ids of its score. Rows are documents of their
own, also with equal ids; items likewise. An item without a known term has no rows. Other columns are not read. An empty
table gives an empty result. Unpaired surrogates cannot occur in Spark's strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewarden.session import stored

TOP = 10
ITEMS = 2000
SEGMENT_DOCS = 16_384
SEGMENT_WORDS = 4_000_000
SEEDS = 64
LAST_ID = np.iinfo(np.int64).max
# A-Z in lower case, other bytes of terms as they are, everything else a blank.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SEGMENT = "ids array<bigint>, n_terms binary, terms array<int>, sizes array<int>, places binary, counts binary, words bigint"
PAIRED = f"{SEGMENT}, pairs array<int>, joint array<bigint>, pair_sizes array<int>, pair_places binary"
FOUND = "item int, doc_id bigint, score bigint"


def text_terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


class Items:
    """A block of items: their terms as numbers of a common vocabulary."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {}
        self.terms = []
        for text in texts:
            own = dict.fromkeys(text_terms(text))
            self.terms.append(np.array([self.number.setdefault(t, len(self.number)) for t in own], dtype=np.int64))

    def order(self, weight: np.ndarray) -> None:
        """Sorts every item's terms by falling weight and numbers the pairs of neighbours."""
        pairs: dict[tuple[int, int], int] = {}
        self.weight = weight
        self.pairs_of = []
        for i, terms in enumerate(self.terms):
            terms = terms[weight[terms] > 0]
            self.terms[i] = terms = terms[np.lexsort((terms, -weight[terms]))]
            self.pairs_of.append([pairs.setdefault(p, len(pairs)) for p in zip(terms.tolist(), terms[1:].tolist())])
        self.pairs = list(pairs)


def _segment(ids: list, sizes: list[int], numbers: list[np.ndarray]) -> pa.RecordBatch:
    """A row with the posting lists of the documents `ids`, terms and documents ascending."""
    doc = np.repeat(np.arange(len(ids)), [len(n) for n in numbers])
    keys, counts = np.unique(np.concatenate(numbers) * len(ids) + doc, return_counts=True)
    terms, sizes_of = np.unique(keys // len(ids), return_counts=True)
    values = [
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([np.array(sizes, np.int32).tobytes()]),
        pa.array([terms], pa.list_(pa.int32())),
        pa.array([sizes_of], pa.list_(pa.int32())),
        pa.array([(keys % len(ids)).astype(np.int32).tobytes()]),
        pa.array([counts.astype(np.int32).tobytes()]),
        pa.array([int(sum(sizes))], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in SEGMENT.split(", ")])


def segments(docs: DataFrame, number: dict[bytes, int], most_docs: int, most_words: int) -> DataFrame:
    """Rows of `SEGMENT` over all documents of `docs` (doc_id, text) that have a term."""

    def run(batches: Iterator[pa.RecordBatch]):
        ids, sizes, numbers, known = [], [], [], number.get
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = text_terms(text.as_py())
                if not found:
                    continue
                ids.append(doc_id.as_py())
                sizes.append(len(found))
                numbers.append(np.array([n for n in map(known, found) if n is not None], dtype=np.int64))
                held += len(numbers[-1])
                if len(ids) >= most_docs or held >= most_words:
                    yield _segment(ids, sizes, numbers)
                    ids, sizes, numbers, held = [], [], [], 0
        if ids:
            yield _segment(ids, sizes, numbers)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SEGMENT)


class Segment:
    """A segment with the impact of every posting."""

    def __init__(self, row: dict, items: Items, n_docs: int, n_words: int):
        self.ids = row["ids"]
        self.id_order = np.array([LAST_ID if i is None else i for i in self.ids], dtype=np.int64)
        n = np.frombuffer(row["n_terms"], np.int32).astype(np.int64)
        if 90 * int(n.max()) * n_docs < 1 << 62:
            m = 10 + 90 * n * n_docs // n_words
        else:
            m = np.array([10 + 90 * int(x) * n_docs // n_words for x in n], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        places, counts = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        terms = np.array(row["terms"], dtype=np.int64)
        impacts = np.repeat(items.weight[terms], row["sizes"]) * ((10**9 * counts) // (1000 * counts + 8 * m[places]))
        self.lists = {t: (places[a:b], impacts[a:b]) for t, a, b in zip(terms.tolist(), edges, edges[1:])}
        self.most = {t: int(x[1].max()) for t, x in self.lists.items()}

    def pair_list(self, a: int, b: int) -> tuple[np.ndarray, int] | None:
        """Documents with both terms, and the joint maximum."""
        if a not in self.lists or b not in self.lists:
            return None
        (p, x), (q, y) = self.lists[a], self.lists[b]
        if len(p) > len(q):
            (p, x), (q, y) = (q, y), (p, x)
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        both = q[at] == p
        return (p[both], int((x[both] + y[at[both]]).max())) if both.any() else None

    def add(self, term: int, docs: np.ndarray, sums: np.ndarray) -> None:
        """Adds the term's impacts to the sums of ascending `docs`."""
        if term in self.lists and len(docs):
            places, impacts = self.lists[term]
            at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            same = places[at] == docs
            sums[same] += impacts[at[same]]

    def best(self, docs: np.ndarray, sums: np.ndarray, top: int) -> np.ndarray:
        """Places of the `top` best of `docs`: by score, then id."""
        return np.lexsort((self.id_order[docs], -sums))[:top]


def rest_bounds(own: list[int], joint: list[int]) -> list[int]:
    """What the terms from every place on can add at most; `joint` is of a term and the next one."""
    rest = [0] * (len(own) + 1)
    for i in range(len(own) - 1, -1, -1):
        rest[i] = own[i] + rest[i + 1]
        if i + 1 < len(own):
            rest[i] = min(rest[i], max(own[i], own[i + 1], joint[i]) + rest[i + 2])
    return rest


def max_score(segment: Segment, terms: np.ndarray, joint: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents that score `least` or more."""
    terms = terms.tolist()
    rest = rest_bounds([segment.most.get(t, 0) for t in terms], joint)
    opens = next((i for i, bound in enumerate(rest) if bound < least), len(terms))
    lists = [segment.lists[t][0] for t in terms[:opens] if t in segment.lists]
    docs = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
    sums = np.zeros(len(docs), dtype=np.int64)
    for i, term in enumerate(terms):
        segment.add(term, docs, sums)
        if i + 1 >= opens:
            stays = sums + rest[i + 1] >= least
            docs, sums = docs[stays], sums[stays]
    return docs, sums


def _rows(names: str, columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    fields = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f[0] for f in fields])


def with_pairs(rows: DataFrame, items: Items, n_docs: int, n_words: int) -> DataFrame:
    """The segments with the lists of all pairs of the items that occur in them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, items, n_docs, n_words)
                found = [(i, x) for i, p in enumerate(items.pairs) if (x := segment.pair_list(*p))]
                more = [
                    pa.array([[i for i, _ in found]], pa.list_(pa.int32())),
                    pa.array([[most for _, (_, most) in found]], pa.list_(pa.int64())),
                    pa.array([[len(docs) for _, (docs, _) in found]], pa.list_(pa.int32())),
                    pa.array([b"".join(docs.tobytes() for _, (docs, _) in found)]),
                ]
                own = pa.RecordBatch.from_pylist([row], schema=batch.schema)
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[c.split()[0] for c in PAIRED.split(", ")])

    return rows.mapInArrow(run, PAIRED)


def seeds(paired: DataFrame, items: Items, n_docs: int, n_words: int, top: int, most: int) -> DataFrame:
    """`FOUND`: whole scores of some documents of every segment, those of the rarest pairs of an item."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                segment, out = Segment(row, items, n_docs, n_words), ([], [], [])
                edges = np.concatenate([[0], np.cumsum(row["pair_sizes"])]).astype(np.int64)
                places = np.frombuffer(row["pair_places"], np.int32)
                lists = {p: places[a:b] for p, a, b in zip(row["pairs"], edges, edges[1:])}
                for item, (terms, pairs) in enumerate(zip(items.terms, items.pairs_of)):
                    held: list[np.ndarray] = []
                    for pair in pairs:
                        if pair in lists and sum(map(len, held)) < top:
                            held.append(lists[pair][:most])  # any documents give a valid threshold
                    if held:
                        docs = np.unique(np.concatenate(held))
                        sums = np.zeros(len(docs), dtype=np.int64)
                        for term in terms.tolist():
                            segment.add(term, docs, sums)
                        _keep(out, item, segment, docs, sums, top)
                yield _rows(FOUND, out)

    return paired.mapInArrow(run, FOUND)


def _keep(out, item: int, segment: Segment, docs: np.ndarray, sums: np.ndarray, top: int) -> None:
    for i in segment.best(docs, sums, top).tolist():
        out[0].append(item)
        out[1].append(segment.ids[docs[i]])
        out[2].append(int(sums[i]))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """`found` with its rank in the item, up to `top`."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_segments(paired: DataFrame, items: Items, least: dict[int, int], n_docs: int, n_words: int, top: int) -> DataFrame:
    """`FOUND`: the up to `top` best documents of every segment and item that reach the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                segment, out = Segment(row, items, n_docs, n_words), ([], [], [])
                most = dict(zip(row["pairs"], row["joint"]))
                for item, (terms, pairs) in enumerate(zip(items.terms, items.pairs_of)):
                    joint = [most.get(p, 0) for p in pairs]
                    docs, sums = max_score(segment, terms, joint, least.get(item, 1))
                    _keep(out, item, segment, docs, sums, top)
                yield _rows(FOUND, out)

    return paired.mapInArrow(run, FOUND)


def weights(index: DataFrame, terms: int, n_docs: int) -> np.ndarray:
    """The weight of every term, 0 of one that no document has; at most `terms` rows reach the driver."""
    counts = index.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df")).collect()
    weight = np.zeros(terms, dtype=np.int64)
    for row in counts:
        weight[row["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    return weight


def _search_block(docs: DataFrame, ids: list, texts: list[str | None], top: int, most_docs: int, most_words: int) -> DataFrame:
    spark, items = docs.sparkSession, Items(texts)
    index = stored(segments(docs, items.number, most_docs, most_words))
    total = index.agg(F.sum(F.size("ids")).alias("n"), F.sum("words").alias("words")).first()
    n_docs, n_words = total["n"] or 0, total["words"] or 0
    items.order(weights(index, len(items.number), n_docs))
    paired = stored(with_pairs(index, items, n_docs, n_words))
    first = ranked(seeds(paired, items, n_docs, n_words, top, SEEDS * top), top).filter(F.col("rank") == top)
    least = {row["item"]: max(1, row["score"]) for row in first.select("item", "score").collect()}  # one row an item
    found = ranked(search_segments(paired, items, least, n_docs, n_words, top), top)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    block: int = ITEMS,
    most_docs: int = SEGMENT_DOCS,
    most_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of `docs` (doc_id, text) for every row of `items` (item_id, text)."""
    rows = iter(items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator())
    result = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    while part := list(islice(rows, block)):
        result = result.unionByName(_search_block(docs, [r[0] for r in part], [r[1] for r in part], top, most_docs, most_words))
    return result
