"""Chat formatting by assembling tokens: segments encoded apart, reserved ids spliced in, loss masks from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common, tokens
from marginalia.session import written

#: Control strings of the template and of templates like it; the first four are spliced in, all are escaped in texts.
START, TURN, BODY, END = "<s>", "<|turn|>", "<|body|>", "</s>"
CONTROL = (START, TURN, BODY, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
#: Reserved ids follow the vocabulary (50,257 ids).
RESERVED = {s: 50257 + i for i, s in enumerate((START, TURN, BODY, END))}
ESCAPE = "␛"

_MARK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_BACK = re.compile(ESCAPE + "(.?)", re.S)


def escape(text: str) -> str:
    """No control string is left: an escape sign follows the first character of each, and is doubled where the text has one."""
    return _MARK.sub(lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def assemble(segments: list[tuple[bytes | str, bool]], encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of segments (text or control string as ``str`` in RESERVED, under the loss).

    Texts come as bytes of UTF-8 and are encoded one by one; the mask is the prefix sum of +1 at each loss segment's first id and -1
    after its last.
    """
    parts = [np.array([RESERVED[s]], np.uint32) if isinstance(s, str) else np.frombuffer(encode(s.decode()), np.uint32) for s, _ in segments]
    ends = np.cumsum([len(p) for p in parts])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for (_, loss), end, part in zip(segments, ends, parts):
        if loss and len(part):
            steps[end - len(part)] += 1
            steps[end] -= 1
    return np.concatenate(parts), np.cumsum(steps[:-1]).astype(np.uint8)


def format_turns(conversations: DataFrame, vocabulary: str = tokens.BYTE_VOCABULARY) -> DataFrame:
    """One row per turn: (conv_id, position, first_token, ids, mask), ids packed as little-endian unsigned 32 bit, mask one byte an id.

    A conversation's rows follow by turn, then role, then text, nulls first; null role or text is empty. Its tokens are a start, and for each
    turn a turn sign, the role, a body sign, the text and an end; the loss covers the ids of assistant texts alone. Turns are encoded where
    they lie; a conversation is then streamed in order, never held, so a very long one needs no more memory than its longest turn.
    Null conv_id: one conversation. Repeated rows: repeated turns. Other columns are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = tokens.encoder(vocabulary).encode
        for batch in batches:
            for part in common.slices(batch, "text"):
                made = []
                for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
                    made.append(assemble([(TURN, False), (escape(role or "").encode(), False), (BODY, False), (escape(text or "").encode(), role == "assistant"), (END, False)], run))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary())], names=[*part.schema.names, "ids", "mask"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, first = object(), 0, 0
        begin = np.array([RESERVED[START]], np.uint32).tobytes()
        for batch in batches:
            rows = []
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if conv != now:
                    now, position, first = conv, 0, 0
                    ids, mask = begin + ids, b"\0" + mask
                rows.append((conv, position, first, ids, mask))
                position, first = position + 1, first + len(mask)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], names=["conv_id", "position", "first_token", "ids", "mask"])

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(encode, "conv_id bigint, turn bigint, role string, text string, ids binary, mask binary")
    ordered = made.repartition(common.fan_out(made.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(stream, "conv_id bigint, position bigint, first_token bigint, ids binary, mask binary")


def read_back(formatted: DataFrame, vocabulary: str = tokens.BYTE_VOCABULARY) -> DataFrame:
    """Per conversation, decoded from formatted turns: n_turns, the digest of its turns, of its loss text, and its length as text."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens.encoder(vocabulary).tokenizer.decode
        text_of = {i: s for s, i in RESERVED.items()}
        kind = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def result(state: list) -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size), kind)], names=names)

        state: list | None = None
        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if state is None or conv != state[0]:
                    if state is not None:
                        yield result(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, under = np.frombuffer(ids, np.uint32), np.frombuffer(mask, np.uint8).astype(bool)
                signs = np.flatnonzero(ids >= 50257)
                parts = {}
                for at, after in zip(signs, [*signs[1:], len(ids)]):
                    sign = text_of[int(ids[at])]
                    parts[sign] = decode(ids[at + 1 : after].tolist(), skip_special_tokens=False) if after > at + 1 else ""
                    state[5] += len(sign) + len(parts[sign])
                loss = unescape(decode(ids[under].tolist(), skip_special_tokens=False)) if under.any() else ""
                state[1] += 1
                state[2].update(f"{unescape(parts[TURN])}\n{unescape(parts[BODY])}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
        if state is not None:
            yield result(state)

    ordered = formatted.repartition(common.fan_out(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(stream, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_and_read(conversations: DataFrame) -> DataFrame:
    return read_back(written(format_turns(conversations), "chats"))
