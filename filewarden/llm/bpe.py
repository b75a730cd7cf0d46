"""BPE encoding as a bounded-lookahead transducer, and decoding as an incremental byte-to-text state machine.

Encoding. A text is cut at special tokens and white space; a run between white space is normalised (NFC, lower case)
and cut into letters, digits, marks and contractions; each piece becomes byte symbols with a word end, and the merges
apply in the order of the list. A piece longer than the window is never held as symbols: the transducer encodes a
window, emits the tokens that end `lookahead` symbols before its end and goes on behind them.

Lookahead. If two inputs agree up to a place, their merges can only differ left of it through a chain of merges of
falling priority: a merge (u, v) of one input only changes what starts at the left edge of u, so the next merge in the
chain, (u', v'), has a v' that starts with u, and moves the difference left by the length of u'. The longest such
chain, weighted by the lengths and found in one pass over the merge list, plus the longest token, bounds how far the
unseen input reaches back. Tokens that end before that are stable, and the rest encodes by itself behind them.

Decoding. Ids become the bytes of their token strings, block by block; an incremental UTF-8 decoder carries incomplete
sequences into the next block.

Null text: no ids and an empty decoded text. Rows are independent, so repeated rows, ties and other columns pass
through; an input column named as an output is replaced. Nothing but the tokenizer file is read on the executors.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

WINDOW = 2048
CACHE = 200_000
BLOCK_IDS = 65_536
WORD_END = "</w>"
LATIN_END = "\u024f"
# The parts of a tokenizer file that this transducer stands for.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where visible in Latin-1, else the next free one from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def code_blocks(end: int = 0x110000, size: int = 4096) -> Iterator[str]:
    """All characters below `end`, block by block, so that tables over them are built in little memory."""
    for start in range(0, end, size):
        block = "".join(chr(c) for c in range(start, min(end, start + size)) if not 0xD800 <= c < 0xE000)
        if block:
            yield block


def char_ranges(kind: str, end: int) -> str:
    """The characters of a class below `end` as ranges, in the Unicode version of the tokenizers library."""
    split = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True)
    return "".join(f"{s[0]}-{s[-1]}" for block in code_blocks(end) for s, _ in split.pre_tokenize_str(block))


@functools.lru_cache
def lower_map() -> dict[int, str]:
    """The lower case of every character that has one, in the Unicode version of the tokenizers library."""
    lower, found = normalizers.Lowercase(), {}
    for block in code_blocks():
        every = block.replace("\n", "")
        lowered = lower.normalize_str("\n".join(every)).split("\n")
        found.update({ord(c): low for c, low in zip(every, lowered, strict=True) if c != low})
    return found


@functools.lru_cache
def piece_finder(end: int):
    """Finds the pieces of a normalised run whose characters are all below `end`."""
    pattern = PIECES
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, char_ranges(kind, end))
    return regex.compile(pattern).findall


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols behind a place that decide every token ending before it; see the text of the module."""
    size = lambda s: len(s.removesuffix(WORD_END))
    reach: dict[str, int] = {}
    longest = 1
    for left, right in merges:
        body = right.removesuffix(WORD_END)
        before = max((reach.get(body[:k], 0) for k in range(1, len(body) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), size(left) + before)
        longest = max(longest, size(left) + size(right))
    return max(reach.values(), default=0) + longest


class Decoder:
    """The byte-to-text state machine of a tokenizer file, without the tables that only encoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: s.encode() for s, i in (spec["model"]["vocab"] | special).items()}

    def decode(self, ids: bytes, block: int = BLOCK_IDS) -> Iterator[str]:
        """Text of the token strings with a blank between, block by block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        texts, first = self.texts, True
        for start in range(0, len(ids), 4 * block):
            part = ids[start : start + 4 * block]
            data = b" ".join(map(texts.__getitem__, struct.unpack(f"<{len(part) // 4}I", part)))
            yield machine.decode(data if first else b" " + data)
            first = False
        yield machine.decode(b"", True)


class Transducer:
    """Encoder of one tokenizer file. `window`: symbols of a long piece held at once."""

    def __init__(self, path: str, window: int = WINDOW):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = tuple(n["type"] for n in spec["normalizer"]["normalizers"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if kinds != NORMALIZERS or split != PIECES or spec["model"]["end_of_word_suffix"] != WORD_END or spec["decoder"]:
            raise ValueError(f"{path} is not a word BPE file of the expected form")
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.sizes = {i: len(s.removesuffix(WORD_END)) for s, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges)
        self.window = window + self.lookahead
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.latin = piece_finder(ord(LATIN_END))
        self.lower = lower_map()
        self.runs = regex.compile(f"[^{SPACE}]+")
        self.symbols = [vocab[s] for s in byte_symbols()]
        self.ends = [vocab[s + WORD_END] for s in byte_symbols()]
        self.of_run: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of a list of symbols, all as ids: the best-ranked, leftmost pair merges first."""
        return self.merge_long(ids) if len(ids) > 64 else self.merge_short(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        get, made = self.ranks.get, self.made
        none = len(made)
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = token = made[best]
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get(token << 20 | ids[i + 1], none)
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | token, none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = list(ids)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int, j: int) -> None:
            pair = ids[i] << 20 | ids[j]
            if (rank := get(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 20 | ids[j] != pair:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """The tokens of a piece, each emitted once no further input can change it."""
        held: list[int] = []
        for symbol in memoryview(data)[:-1]:
            held.append(self.symbols[symbol])
            if len(held) >= self.window:
                stable, at = len(held) - self.lookahead, 0
                for token in self.merge(held[:]):
                    if at + self.sizes[token] > stable:
                        break
                    at += self.sizes[token]
                    yield token
                del held[:at]
        yield from self.merge([*held, self.ends[data[-1]]])

    def piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) > self.window:
            return list(self.stream(data))
        ids = list(map(self.symbols.__getitem__, data))
        ids[-1] = self.ends[data[-1]]
        return self.merge(ids)

    def run(self, run: str) -> bytes:
        """Ids of a run between white space."""
        if run.isascii():
            text, pieces = run.lower(), self.latin
        else:
            text = unicodedata.normalize("NFC", run)
            text = text.translate(self.lower)
            pieces = self.latin if max(text) < LATIN_END else piece_finder(0x110000)
        found: list[int] = []
        for piece in pieces(text):
            found += self.piece(piece)
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids as little-endian unsigned 32-bit integers."""
        known = self.of_run
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield struct.pack("<I", self.special[part])
                continue
            plain = not any(c in part for c in "\x1c\x1d\x1e\x1f")  # only str.split() takes these for white space
            for run in part.split() if plain else self.runs.findall(part):
                ids = known.get(run)
                if ids is None:
                    ids = self.run(run)
                    if len(run) < 64:
                        if len(known) >= CACHE:
                            known.clear()
                        known[run] = ids
                yield ids


@functools.lru_cache(maxsize=2)
def transducer(path: str, window: int = WINDOW) -> Transducer:
    return Transducer(path, window)


@functools.lru_cache(maxsize=2)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, of_value) -> DataFrame:
    """`df` with the column `target` computed from `source`, batch by batch; `of_value` gives the function and what ends it."""
    names = [c for c in df.columns if c != target]
    fields = [f for f in df.schema.fields if f.name != target]
    if len(names) != len(set(names)):
        raise ValueError("column names repeat")
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches):
        convert, close = of_value()
        for batch in batches:
            values = pa.array([convert(v) for v in batch.column(batch.schema.names.index(source))], arrow)
            columns = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*names, target])
        close()

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(target, kind)]))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", window: int = WINDOW) -> DataFrame:
    """`df` with the ids of `text` as a binary of little-endian unsigned 32-bit integers."""

    def of_value():
        encoder = transducer(path, window)
        # A worker outlives its task: what it remembers of runs must not weigh on the stages after it.
        return lambda v: b"".join(encoder.encode(v.as_py() or "")), encoder.of_run.clear

    return _mapped(df, text, ids, T.BinaryType(), of_value)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", block: int = BLOCK_IDS) -> DataFrame:
    """`df` with the text of the ids: their token strings, joined by blanks."""

    def of_value():
        decoder = decoder_of(path)
        return lambda v: "".join(decoder.decode(v.as_py() or b"", block)), lambda: None

    return _mapped(df, ids, decoded, T.StringType(), of_value)
