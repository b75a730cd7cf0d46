"""Chat formatting checked by a grammar round trip.

A turn is rendered as ``<s>role [INST] text [/INST]</s>`` and a line feed. A deterministic parser reads it back; if
role and text do not come out identical, the control strings inside them are escaped and the turn is rendered again,
until they do. Escaping puts a backslash before a control string and doubles the backslashes that stand right before
it, so it is reversible for every text, escaped ones included. No control string starts or ends with a blank, and a
blank stands on both sides of every text, so texts and marks never melt together.

The loss mask is the text of assistant turns, without marks.

Turns are rendered one by one; a conversation is only ever read as a sorted stream of its turns, in constant memory,
so a conversation with a third of all turns needs no memory of its size. Order: turn (nulls first), then role and
text, so ties have a defined order and repeated rows stay.

Null role or text: empty. A null conversation id is a conversation of its own. Other columns are not read. Empty
input gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
# A match starts where no backslash precedes and takes a run whole, so the time stays linear in the text.
_WITH_SLASHES = re.compile(rf"(?<!\\)(\\*+)({_CONTROL})")
PIECES = "conv_id bigint, turn bigint, place string, piece string"


def escape(text: str) -> str:
    return _WITH_SLASHES.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _WITH_SLASHES.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def render(role: str, text: str) -> str:
    """The piece of a turn; escaped only if the plain form does not parse back to the same turn."""
    for of in (str, escape):
        piece = f"<s>{of(role)} [INST] {of(text)} [/INST]</s>\n"
        if parse(piece) == (role, text):
            return piece
    raise ValueError("a turn does not survive the round trip")


def parse(piece: str) -> tuple[str, str] | None:
    """Role and text of a piece: marks are control strings with no odd backslash before them."""
    wanted = iter(("<s>", "[INST]", "[/INST]", "</s>"))
    at, cuts = 0, []
    while (match := _next_control(piece, at)) is not None:
        start, end = match
        if piece[start:end] != next(wanted, None):
            return None
        cuts.append((start, end))
        at = end
    if len(cuts) != 4 or cuts[0][0] != 0 or piece[cuts[3][1] :] != "\n" or cuts[2][1] != cuts[3][0]:
        return None
    role, text = piece[cuts[0][1] : cuts[1][0]], piece[cuts[1][1] : cuts[2][0]]
    if not role.endswith(" ") or len(text) < 2 or text[0] != " " or text[-1] != " ":
        return None
    return unescape(role[:-1]), unescape(text[1:-1])


def _next_control(piece: str, at: int) -> tuple[int, int] | None:
    for match in _WITH_SLASHES.finditer(piece, at):
        if len(match[1]) % 2 == 0:
            return match.start(2), match.end()
    return None


def format_turns(turns: DataFrame) -> DataFrame:
    """One rendered piece per row of `turns` (conv_id, turn, role, text); `place` orders ties of a turn."""
    named = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            role, text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            place = [hashlib.sha256(f"{r}\n{t}".encode()).hexdigest() for r, t in zip(role, text)]
            pieces = pa.array(map(render, role, text), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(place, pa.string()), pieces], names=["conv_id", "turn", "place", "piece"]
            )

    return named.mapInArrow(run, PIECES)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests per conversation, read from the pieces alone."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")

    def run(batches: Iterator[pa.RecordBatch]):
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        state: list | None = None
        for batch in batches:
            done: list[tuple] = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if state is None or state[0] != conv:
                    if state:
                        done.append(_closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = parse(piece)
                if turn is None:
                    raise ValueError(f"conversation {conv} does not parse")
                role, text = turn
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == ASSISTANT:
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(piece)
            if done:
                yield _rows(done, names)
        if state:
            yield _rows([_closed(state)], names)

    return ordered.select("conv_id", "turn", "place", "piece").mapInArrow(run, DIGESTS)


def _closed(state: list) -> tuple:
    return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])


def _rows(done: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
