"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits. The first chunks of all ids stand together as a level, the second chunks of those
ids that need one as the next level, and so on. A bitmap per level says which ids go on, and a directory holds the
number of set bits before every `RANK_BITS` bits, so the place of an id's next chunk is a sum of two counts: any id, or
run of ids, is read by its number without decoding what stands before it.

Writing. Texts are dealt by ranges of (id, digest, place) and sorted, so a hot id is spread like all others, and every
partition encodes its texts once with the tokenizers library. It emits a file whenever it holds `FILE_IDS` ids, so
memory is bounded by a file and one text. Spark's text writer commits the files: a row is a file's bytes, with the line
feed that ends a file. Reading. Files come back through Spark's binary source; where a file starts in all ids is a
two-level prefix sum over partitions and files, never a window over all of them.

Encoding. White space followed by other characters is a piece: no token of the byte-level splitter crosses from other
characters to white space, and none looks back, so pieces are encoded alone and remembered (`CACHE` of them, twice). Texts
with special tokens, or with characters that not all Unicode versions count as white space, are encoded whole.

File: `DAC1`, then little-endian 64-bit numbers: partition, number in it, documents, ids, levels; then ids of documents
(64 bits, with a byte per document that is 0 for null), ends of documents (64 bits), and per level: number of chunks,
chunks, bitmap, directory.

Null text: empty, only the end id. Null ids come first, rows with equal ids in the order of their digests. Repeated rows
are documents of their own. Other columns are not read. Empty input writes no ids and gives an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filewarden.session import stored

END_ID = 2
FILE_IDS = 1 << 22
CACHE = 250_000
PIECE_CHARS = 64
RANK_BITS = 512
GROUP = 1024
MAGIC = b"DAC1"
HEAD = struct.Struct("<4s5q")
PIECES = re.compile(r"\s*\S+|\s+")
_ODD = "\x1c\x1d\x1e\x1f\x85᠎​"
DOCUMENTS = "partition bigint, number bigint, place bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


class DirectCodes:
    """Ids in chunk levels; `levels` holds (chunks, bitmap, directory) of each."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels = np.ascontiguousarray(ids, dtype=np.uint32), []
        while True:
            more = rest > 0xFF
            bits = np.packbits(more)
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.empty(0, np.uint32)
            directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
            levels.append(((rest & 0xFF).astype(np.uint8), bits, directory))
            if not more.any():
                return cls(levels)
            rest = rest[more] >> 8

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many chunks of the level before the places `at` go on."""
        _, bits, directory = self.levels[level]
        block = at // RANK_BITS
        first = block * (RANK_BITS // 8)
        row = first[:, None] + np.arange(RANK_BITS // 8)
        data = np.where(row < len(bits), bits[np.minimum(row, max(len(bits) - 1, 0))] if len(bits) else 0, 0).astype(np.uint8)
        before = np.arange(RANK_BITS) < (at % RANK_BITS)[:, None]
        return directory[block].astype(np.int64) + (np.unpackbits(data, axis=1).astype(bool) & before).sum(axis=1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        at = np.asarray(places, dtype=np.int64)
        out, open_ = np.zeros(len(at), dtype=np.uint32), np.arange(len(at))
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at // 8] >> (7 - at % 8).astype(np.uint8)) & 1 == 1
            if not more.any():
                break
            at, open_ = self._rank(level, at[more]), open_[more]
        return out

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids from place `start` to before `stop`."""
        out, open_ = np.zeros(stop - start, dtype=np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if open_ is None:
                out |= part
            else:
                out[open_] |= part
            skip = start % 8
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)])[skip : skip + stop - start].astype(bool)
            if not more.any():
                break
            open_ = np.nonzero(more)[0] if open_ is None else open_[more]
            start = int(self._rank(level, np.array([start]))[0])
            stop = start + len(open_)
        return out


class TokenFile:
    """Documents and ids of one file."""

    def __init__(self, partition: int, number: int, doc_ids: list[int | None], ends: np.ndarray, codes: DirectCodes):
        self.partition, self.number, self.doc_ids, self.ends, self.codes = partition, number, doc_ids, ends, codes

    def pack(self) -> bytes:
        parts = [HEAD.pack(MAGIC, self.partition, self.number, len(self.doc_ids), int(self.ends[-1]), len(self.codes.levels))]
        parts.append(np.array([i or 0 for i in self.doc_ids], "<i8").tobytes())
        parts.append(bytes(i is not None for i in self.doc_ids))
        parts.append(self.ends.astype("<i8").tobytes())
        for chunks, bits, directory in self.codes.levels:
            parts += [struct.pack("<q", len(chunks)), chunks.tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> TokenFile:
        magic, partition, number, docs, _, n_levels = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        ids, known, ends, levels = take("<i8", docs).tolist(), take("u1", docs).tolist(), take("<i8", docs), []
        for _ in range(n_levels):
            n = int(take("<i8", 1)[0])
            levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // RANK_BITS) + 1)))
        if data[at:] not in (b"", b"\n"):
            raise ValueError("bytes behind the end of a file of token ids")
        return cls(partition, number, [i if k else None for i, k in zip(ids, known)], ends, DirectCodes(levels))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids)."""
        ids, start = self.codes.run(0, int(self.ends[-1])), 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist()):
            yield doc_id, start, ids[start:end]
            start = end


class Encoder(dict):
    """The library's ids of texts; remembers those of the last `CACHE` pieces and of some before them.

    A piece goes through the library's own splitter and model, which take a sixth of the time of a whole encoding.
    Pieces of a blank, Latin letters and punctuation are split without it; which characters belong to these classes,
    and how they are written in the vocabulary, is asked of the library once.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.normalizer is not None:
            raise ValueError("pieces of a tokenizer that changes texts cannot be encoded alone")
        self.split, self.tokenize = self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        self.whole = [*_ODD, *(t.content for t in self.library.get_added_tokens_decoder().values())]
        joins = lambda c, other: len(self.split(c + other)) == len(self.split(other + c)) == len(self.split(" " + c)) == 1
        latin = [chr(i) for i in range(0x21, 0x250) if not chr(i).isspace()]
        letters, marks = ([c for c in latin if joins(c, other)] for other in ("a", "!"))
        self.written = {ord(c): self.split(c)[0][0] for c in [" ", *letters, *marks]}
        self.blank = self.written[ord(" ")]
        of = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
        self.plain = re.compile(f"( ?{of(letters)}+)({of(marks)}*)")
        self.before: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        plain = self.plain.fullmatch(piece)
        if plain and plain[2]:
            return self[plain[1]] + self[plain[2]]
        if plain:
            parts = [piece.replace(" ", self.blank) if piece.isascii() else piece.translate(self.written)]
        else:
            parts = [part for part, _ in self.split(piece)]
        ids = [token.id for part in parts for token in self.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        data = self.before.get(piece)
        if data is None:
            data = self._ids(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[piece] = data
        return data

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(odd in text for odd in self.whole):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all texts of `docs` (doc_id, text) to `folder`, in ascending order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode, partition, number = encoder(path).encode, TaskContext.get().partitionId(), 0
        tail = struct.pack("<I", end_id)
        ids: list[int | None] = []
        held: list[bytes] = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            codes = DirectCodes.of(np.frombuffer(b"".join(held), "<u4"))
            data = TokenFile(partition, number, ids, np.array(ends, np.int64), codes).pack()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = encode(text.as_py() or "") + tail
                ids.append(doc_id.as_py())
                held.append(data)
                ends.append((ends[-1] if ends else 0) + len(data) // 4)
                if ends[-1] >= file_ids:
                    yield flush()
                    number += 1
                    ids, held, ends = [], [], []
        if ids:
            yield flush()

    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )
    dealt = keyed.repartitionByRange("doc_id", "digest", "place").sortWithinPartitions("doc_id", "digest", "place")
    files = dealt.select("doc_id", "text").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """`DOCUMENTS` of all files, each read once."""
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile.unpack(content.as_py())
                rows = [
                    (file.partition, file.number, place, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for place, (doc_id, start, ids) in enumerate(file.documents())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    files = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile")
    return files.option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content").mapInArrow(run, DOCUMENTS)


def file_starts(documents: DataFrame) -> DataFrame:
    """(partition, number, file_start): ids of all files before a file, from the files' documents."""
    files = documents.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("partition").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("partition") / GROUP))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("of_block"))
    parts = parts.join(blocks, "block").select(
        "partition", (F.col("of_block") + before(Window.partitionBy("block").orderBy("partition"))).alias("of_part")
    )
    inside = files.select("partition", "number", before(Window.partitionBy("partition").orderBy("number")).alias("of_file"))
    return inside.join(parts, "partition").select("partition", "number", (F.col("of_part") + F.col("of_file")).alias("file_start"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of `folder`."""
    found = stored(_documents(spark, folder))
    joined = found.join(file_starts(found), ["partition", "number"])
    return joined.select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, folder: str, **settings) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) to `folder`/ids and returns what `read_tokens` finds there."""
    write_tokens(docs, path, f"{folder}/ids", **settings)
    return read_tokens(docs.sparkSession, f"{folder}/ids")
