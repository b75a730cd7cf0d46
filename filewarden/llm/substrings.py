"""Substring dedup with difference-cover anchors.

A word goes when a window of `WINDOW` consecutive words over it also starts anywhere else. Anchors are hashes of
`WINDOW - PERIOD + 1` words at the places of a text whose number modulo `PERIOD` is in `COVER`. Every number modulo
`PERIOD` is a difference of two members, so two equal windows, wherever they start, hold an equal anchor at the same
distance. Only anchors found twice are extended: the windows around them are hashed whole (96 bits), and those found
twice are repeated windows.

Texts are dealt once into chunks of bounded size by a digest; that exchange serves all three passes. A chunk sends each
hash once, with a mark if it repeats inside, so a passage that a third of all documents hold costs one number a chunk,
and no group of its places ever forms. Hashes meet in slices of the number range; each chunk gets back those of its
hashes that repeat. Nothing is collected.

Null text: no words. Rows are independent documents whatever their ids; equal rows repeat each other. Texts under
`WINDOW` words lose nothing. Other columns are not read. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewarden.llm.packed import column, cuts, mixed, pack, unpack

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
CHUNK_BYTES = 8 << 20
CACHE = 250_000
BASE = 0xD6E8FEB86659FD93
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def split_words(text: str | None) -> list[str]:
    """The words `[^\\x20\\x09-\\x0D]+`; str.split() finds them unless other white space occurs."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class WordHashes(dict):
    """Digest of a word, remembered for up to `CACHE` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = WordHashes()


class Chunk:
    """The words of several texts as one array of digests, with the place where each text starts."""

    def __init__(self, texts: list[str | None]):
        arrays = []
        for text in texts:
            found = split_words(text)
            arrays.append(np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)))
        self.sizes = np.array([len(a) for a in arrays], dtype=np.int64)
        self.words = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.own = np.repeat(self.starts[:-1], self.sizes)
        self.end = np.repeat(self.starts[1:], self.sizes)

    def sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        powers = np.full(n + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(n + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)]), inverse

    def hashes(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """Digests of `length` words from the places `at`."""
        total, inverse = self.sums(mixed(self.words) if second else self.words)
        return mixed((total[at + length] - total[at]) * inverse[at])

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(len(self.words)) - self.own
        length = window - period + 1
        wanted = np.isin(place % period, cover) & (place + self.own + length <= self.end)
        at = np.nonzero(wanted)[0]
        return at, self.hashes(at, length)

    def candidates(self, at: np.ndarray, window: int, period: int) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at `at`."""
        marks = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(marks, np.maximum(at - (period - 1), self.own[at]), 1)
        np.add.at(marks, at + 1, -1)
        near = np.cumsum(marks[:-1]) > 0
        return np.nonzero(near & (np.arange(len(self.words)) + window <= self.end))[0]


def _rows(chunk: int, keys: np.ndarray, more: np.ndarray | None, twice: np.ndarray, slices: int) -> pa.Table:
    """A row per slice of ascending keys, with their second parts and marks."""
    edges, rows = cuts(keys, slices), {"slice": [], "chunk": [], "keys": [], "more": [], "twice": []}
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            rows["slice"].append(i)
            rows["chunk"].append(chunk)
            rows["keys"].append(pack(keys[a:b]))
            rows["more"].append(b"" if more is None else more[a:b].tobytes())
            rows["twice"].append(np.packbits(twice[a:b]).tobytes())
    kinds = {"slice": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "more": pa.binary(), "twice": pa.binary()}
    return pa.table({k: pa.array(rows[k], t) for k, t in kinds.items()})


SENT = "slice int, chunk int, keys binary, more binary, twice binary"
BACK = "chunk int, keys binary, more binary"


def _distinct(keys: np.ndarray, more: np.ndarray | None):
    """Ascending different (key, more), and which of them occur twice or more."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    keys, more = keys[order], None if more is None else more[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    if more is not None:
        new[1:] |= more[1:] != more[:-1]
    first = np.nonzero(new)[0]
    counts = np.diff(np.append(first, len(keys)))
    return keys[first], None if more is None else more[first], counts > 1


def repeated(sent: DataFrame) -> DataFrame:
    """For every chunk, those of its hashes that repeat inside it or in another chunk."""

    def run(key, table):
        parts = []
        for keys, more, twice in zip(column(table, "keys"), column(table, "more"), column(table, "twice")):
            k = unpack(keys)
            parts.append((k, np.frombuffer(more, np.uint32) if more else None, np.unpackbits(np.frombuffer(twice, np.uint8))[: len(k)].astype(bool)))
        pairs = parts[0][1] is not None
        keys = np.concatenate([p[0] for p in parts])
        more = np.concatenate([p[1] for p in parts]) if pairs else None
        order = np.lexsort((more, keys)) if pairs else np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if pairs:
            same &= more[order][1:] == more[order][:-1]
        shared = np.zeros(len(keys), dtype=bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        out: dict[str, list] = {"chunk": [], "keys": [], "more": []}
        at = 0
        for chunk, (k, m, twice) in zip(column(table, "chunk"), parts):
            chosen = shared[at : at + len(k)] | twice
            at += len(k)
            if chosen.any():
                out["chunk"].append(chunk)
                out["keys"].append(pack(k[chosen]))
                out["more"].append(m[chosen].tobytes() if pairs else b"")
        return pa.table({"chunk": pa.array(out["chunk"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "more": pa.array(out["more"], pa.binary())})

    return sent.groupBy("slice").applyInArrow(run, BACK)


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack(k) for k in column(table, "keys")]
    more = [np.frombuffer(m, np.uint32) for m in column(table, "more")]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    every, seconds = np.concatenate(keys), np.concatenate(more)
    order = np.argsort(every, kind="stable")
    return every[order], seconds[order] if len(seconds) else seconds


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def drop_repeated(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of `docs` (doc_id, text); `kept` has the words that stay, joined by blanks."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or not 1 <= period <= window:
        raise ValueError("not a difference cover of the period")
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, ceil(bytes_ / chunk_bytes))
    slices = chunks
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = docs.select("doc_id", "text", chunk.alias("chunk")).repartition("chunk")

    def send_anchors(key, table):
        _, hashes = Chunk(column(table, "text")).anchors(window, period, cover)
        return _rows(key[0].as_py(), *_distinct(hashes, None), slices)

    def send_windows(key, texts, back):
        if not back.num_rows:
            return _rows(0, np.empty(0, np.uint64), None, np.empty(0, bool), slices)
        own = Chunk(column(texts, "text"))
        at, hashes = own.anchors(window, period, cover)
        starts = own.candidates(at[_member(hashes, _received(back)[0])], window, period)
        keys = own.hashes(starts, window)
        more = (own.hashes(starts, window, second=True) >> np.uint64(32)).astype(np.uint32)
        return _rows(key[0].as_py(), *_distinct(keys, more), slices)

    def remove(key, texts, back):
        values = column(texts, "text")
        out = {"doc_id": texts.column("doc_id"), "n_words": [], "n_removed": [], "kept": []}
        own = Chunk(values)
        gone = np.zeros(len(own.words), dtype=bool)
        known, seconds = _received(back)
        if len(known):
            starts = np.nonzero(np.arange(len(own.words)) + window <= own.end)[0]
            hit = starts[_member(own.hashes(starts, window), known)]
            keys = own.hashes(hit, window)
            more = (own.hashes(hit, window, second=True) >> np.uint64(32)).astype(np.uint32)
            kind = np.dtype([("a", np.uint64), ("b", np.uint32)])
            pair = lambda a, b: np.rec.fromarrays([a, b], dtype=kind).view(np.dtype((np.void, 12)))
            hit = hit[np.isin(pair(keys, more), pair(known, seconds))]
            marks = np.zeros(len(own.words) + 1, dtype=np.int64)
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + window, -1)
            gone = np.cumsum(marks[:-1]) > 0
        for text, a, b in zip(values, own.starts, own.starts[1:]):
            found, lost = split_words(text), gone[a:b]
            out["n_words"].append(len(found))
            out["n_removed"].append(int(lost.sum()))
            out["kept"].append(" ".join([w for w, x in zip(found, lost.tolist()) if not x] if out["n_removed"][-1] else found))
        return pa.table({"doc_id": out["doc_id"], "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    anchors = repeated(dealt.groupBy("chunk").applyInArrow(send_anchors, SENT))
    windows = repeated(dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, SENT))
    result = f"doc_id {doc_type}, n_words bigint, n_removed bigint, kept string"
    return dealt.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(remove, result)
