"""Chat formatting by columnar byte assembly, and reading formatted conversations back.

A turn is `<|turn|>` role newline text `<|end|>` newline. Control strings inside texts get a backslash after their first
character, one more than they have; reading back takes one away. Text without control strings stays as it is.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any length spreads over many tasks. Each
Arrow batch becomes one segment per conversation in it; the segments of a conversation, one after the other, are its
formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from mixloom.llm.arrow import gathered, slices, strings

OPEN, MIDDLE, CLOSE = b"<|turn|>", b"\n", b"<|end|>\n"
LEARNED_ROLE = "assistant"
# Control strings that may not stand in a text: the template's own and those of common templates.
CONTROLS = (
    "<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>",
    "[INST]", "[/INST]",
)
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_CONTROL = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_TURN = re.compile(re.escape(OPEN.decode()) + "(.*?)\n(.*?)" + re.escape(CLOSE.decode()), re.S)

SEGMENT = (
    "conv_id {kind}, segment bigint, n_turns bigint, formatted string, "
    "loss_starts array<bigint>, loss_ends array<bigint>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _escaped(column: pa.Array) -> pa.Array:
    """Only texts in which a control string can begin are looked at one by one."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not pc.any(pc.match_substring_regex(column, r"[<\[]")).as_py():
        return column
    return pa.array([escape(t) if "<" in t or "[" in t else t for t in column.to_pylist()], pa.large_string())


def _roles(column: pa.Array) -> pa.Array:
    coded = pc.fill_null(column.cast(pa.large_string()), "").dictionary_encode()
    names = pa.array([escape_role(r) for r in coded.dictionary.to_pylist()], pa.large_string())
    return names.take(coded.indices)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of turns, where each turn begins (rows + 1), and where its text begins.

    The pieces of all turns - open, role, middle, text, close - have known lengths, so cumulated lengths give the place
    of every piece in one buffer, and each kind of piece is copied there at once.
    """
    role_data, role_at = strings(roles)
    text_data, text_at = strings(texts)
    rows = len(texts)
    fixed = [np.frombuffer(b, np.uint8) for b in (OPEN, MIDDLE, CLOSE)]
    lengths = np.empty((rows, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(f) for f in fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(rows, 5) if rows else lengths
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for kind, piece in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[starts[:, kind, None] + np.arange(len(piece))] = piece
    for kind, data in ((1, role_data), (3, text_data)):
        where = gathered(starts[:, kind], lengths[:, kind], np.arange(len(out)))
        out[where] = data
    return out, np.append(starts[:, 0], len(out)), starts[:, 3]


def format_chat(turns: DataFrame) -> DataFrame:
    """Segments of the formatted conversations of (conv_id, turn, role, text).

    conv_id; segment: ascending within a conversation; n_turns; formatted; loss_starts and loss_ends: code point spans of
    the segment that are learned, one per turn of the role `assistant`. Turns go by turn, then role, then text, so ties
    and repeated rows have one order; nulls come first, a null role or text is empty, and rows without conv_id are one
    conversation. Other columns are not carried.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    shape = StructType.fromDDL(SEGMENT.format(kind=turns.schema["conv_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, stop in slices(batch.column(3)):
                part = batch.slice(start, stop - start)
                yield _segments(part, number)
                number += len(part)

    def _segments(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        conv, _, role, text = part.columns
        out, turn_at, text_at = assemble(_roles(role), _escaped(text))
        same = np.zeros(len(part), bool)
        if len(part) > 1:
            a, b = conv[1:], conv[:-1]
            equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
            both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            same[1:] = equal | both
        first = np.append(np.flatnonzero(~same), len(part))
        at = turn_at[first]
        formatted = pa.Array.from_buffers(
            pa.large_string(), len(first) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]
        ).cast(pa.string())
        # Loss spans: bytes to code points of the segment.
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        origin = points[at[owner]]
        learned = pc.fill_null(pc.equal(role.cast(pa.large_string()), LEARNED_ROLE), False)
        learned = learned.to_numpy(zero_copy_only=False)
        begin = points[text_at] - origin
        stop = points[turn_at[1:] - len(CLOSE)] - origin
        spans = np.concatenate([[0], np.cumsum(learned)])[first].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(v[learned], pa.int64())) for v in (begin, stop)]
        keys = conv.take(pa.array(first[:-1]))
        numbers = pa.array(number + np.arange(len(first) - 1), pa.int64())
        columns = [keys, numbers, pa.array(np.diff(first), pa.int64()), formatted, *lists]
        return pa.RecordBatch.from_arrays(columns, shape.names)

    return dealt.mapInArrow(run, shape)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def chat_digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row per conversation with digests of its turns and learned text.

    The digests are chains over a conversation, so its segments pass one task in order, one batch at a time.
    """
    conv = segments.schema["conv_id"].dataType.simpleString()
    shape = StructType.fromDDL(
        f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint"
    )
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def flush():
            rows = [(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in done]
            done.clear()
            columns = [[r[i] for r in rows] for i in range(6)]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], shape.names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            convs, texts = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for key, text, begins, stops in zip(convs, texts, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        done.append((current, state))
                    current, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(begins, stops):
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield flush()
        if state is not None:
            done.append((current, state))
            yield flush()

    return ordered.mapInArrow(run, shape)
