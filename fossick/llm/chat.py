"""Chat formatting by token-level assembly: segments are encoded alone and reserved ids are spliced between them.

A conversation becomes, turn by turn, ``<|im_start|>`` role newline content ``<|im_end|>`` newline, and ends with
``<|endoftext|>``. The three control ids follow the vocabulary and never come out of encoding text. A control string in
content (``<|name|>``) is escaped to ``<\\|name|>`` first; a backslash is put before backslashes that already stand
there, so ``unescape`` gives the content back. The loss mask is 1 on an assistant's content and the end mark after it,
and comes from prefix sums of segment lengths.

Defined results: turns are in the order of (turn, role, text), nulls first; repeated rows appear repeatedly; a null
role is ``unknown``; a null text is an empty one; rows of a null conversation belong to none and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fossick.llm.common import bound_batches, col
from fossick.llm.token_counts import encoding

#: Offsets of the control ids from the size of the vocabulary.
END_OF_TEXT, START, END = 0, 1, 2
_CONTROL = re.compile(r"<(\\*)\|(\w+)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(\w+)\|>")


def escape(text: str) -> tuple[str, int]:
    """Text without control strings, and how many there were."""
    return _CONTROL.subn(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def format_conversations(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, n_tokens, n_loss_tokens, n_escaped, input_ids, loss_mask.

    One shuffle, of the texts by conversation; encoding runs behind it, where a batch of conversations is encoded at
    once.
    """
    bound_batches(turns.sparkSession)
    packed = turns.where(col(conv_col).isNotNull()).groupBy(col(conv_col).alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("unknown")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text")))).alias("turns")
    ).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = packed.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns int, n_tokens int, n_loss_tokens int, n_escaped int, input_ids array<int>, loss_mask array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        base = bpe.n_vocab
        head: dict[str, np.ndarray] = {}
        newline = bpe.encode_ordinary("\n")
        tail = np.array([base + END, *newline], np.int32)
        stop = np.array([base + END_OF_TEXT], np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                parts: list[np.ndarray] = []
                learn: list[int] = []
                ends, loss, escapes, n_turns = [0], [0], [], []
                total = n_loss = 0
                for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    escaped = 0
                    for role, text in zip(roles, texts, strict=True):
                        if role not in head:
                            head[role] = np.array([base + START, *bpe.encode_ordinary(escape(role)[0]), *newline], np.int32)
                        text, n = escape(text)
                        escaped += n
                        body = np.array(bpe.encode_ordinary(text), np.int32)
                        own = int(role == "assistant")
                        parts += [head[role], body, tail[:1], tail[1:]]
                        learn += [0, own, own, 0]
                        total += len(head[role]) + len(body) + len(tail)
                        n_loss += own * (len(body) + 1)
                    parts.append(stop)
                    learn.append(0)
                    total += 1
                    ends.append(total)
                    loss.append(n_loss)
                    escapes.append(escaped)
                    n_turns.append(len(roles))
                flat = np.concatenate(parts)
                # +1 where a learnt segment begins, -1 where it ends: the prefix sum is the mask
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                edge = np.concatenate([[0], np.cumsum(sizes)])
                steps = np.zeros(len(flat) + 1, np.int32)
                own = np.array(learn, np.int32)
                np.add.at(steps, edge[:-1], own)
                np.add.at(steps, edge[1:], -own)
                mask = np.cumsum(steps)[:-1].astype(np.int32)
                offs = pa.array(np.array(ends, np.int32))
                yield pa.record_batch(
                    [b.column(0), pa.array(n_turns, pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array(np.diff(loss), pa.int32()), pa.array(escapes, pa.int32()),
                     pa.ListArray.from_arrays(offs, pa.array(flat)), pa.ListArray.from_arrays(offs, pa.array(mask))],
                    ["conv_id", "n_turns", "n_tokens", "n_loss_tokens", "n_escaped", "input_ids", "loss_mask"],
                )

    return packed.mapInArrow(run, schema)
