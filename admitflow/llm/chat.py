"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``<|turn|>role<|text|>text<|end|>`` per turn
and encoded once with character offsets. The sorted spans of the assistant
texts are then intersected with the sorted token spans by binary search, so
that a token is under the loss mask exactly if it lies in an assistant text.

Escaping: inside roles and texts each of ``< [ | \\`` is followed by an added
backslash. No marker, and no ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]``, can
then occur in an escaped text, and dropping that backslash restores it.

Defined results: null role or text is empty; rows of a conversation are ordered
by turn, then role, then text, nulls first, repeated rows kept; a conversation
without an assistant row has an empty mask; an empty table gives no rows;
columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A vocabulary file of at most this size goes to each executor.
MAX_TOKENIZER_BYTES = 64 << 20

SCHEMA = (
    "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, "
    "token_ends array<int>, loss_mask array<boolean>"
)


def escape(text: str) -> str:
    return re.sub(r"([<\[|\\])", r"\1" + "\\\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[|\\])\\", r"\1", text)


def render(roles: list[str | None], texts: list[str | None], learn: str) -> tuple[str, list[int], list[int]]:
    """The conversation and the sorted spans of the texts whose role is ``learn``."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in zip(roles, texts, strict=True):
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def masked(token_starts, token_ends, span_starts, span_ends) -> np.ndarray:
    """Which tokens overlap a span, by binary search in the spans' starts."""
    if not len(span_starts):
        return np.zeros(len(token_starts), bool)
    last = np.searchsorted(span_starts, token_ends, side="left") - 1  # the last span begun before the token's end
    return (last >= 0) & (np.asarray(span_ends)[np.maximum(last, 0)] > token_starts) & (token_ends > token_starts)


def load_tokenizer(text: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(text)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's span keeps its leading space
    tokenizer.no_truncation()
    return tokenizer


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, learn: str = "assistant") -> DataFrame:
    """One row a conversation: the rendered text, token ids with spans (code points), and the loss mask.

    ``tokenizer``: the path of a vocabulary file of the tokenizers library.
    The rows of a conversation meet in one row, as its rendering is one string.
    """
    if Path(tokenizer).stat().st_size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} has over {MAX_TOKENIZER_BYTES} bytes")
    vocabulary = conversations.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_tokenizer(vocabulary.value)
        for batch in batches:
            rows = [render([t["role"] for t in turns], [t["text"] for t in turns], learn) for turns in batch.column(1).to_pylist()]
            out = {"formatted": [], "token_ids": [], "token_starts": [], "token_ends": [], "loss_mask": []}
            for text, starts, ends in rows:
                code = encoder.encode(text, add_special_tokens=False)
                offsets = np.array(code.offsets, dtype=np.int64).reshape(-1, 2)
                out["formatted"].append(text)
                out["token_ids"].append(code.ids)
                out["token_starts"].append(offsets[:, 0])
                out["token_ends"].append(offsets[:, 1])
                out["loss_mask"].append(masked(offsets[:, 0], offsets[:, 1], starts, ends))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(out["formatted"], pa.string()),
                    *(pa.array(out[k], pa.list_(pa.int32())) for k in ("token_ids", "token_starts", "token_ends")),
                    pa.array(out["loss_mask"], pa.list_(pa.bool_())),
                ],
                names=["conv_id", *out],
            )

    turns = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    return turns.mapInArrow(encode, SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns, from the rendered text alone."""
    found = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        found.append((unescape(role), unescape(text.removesuffix(END))))
    return found


def read_loss(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the loss mask: each masked character once, unescaped."""
    parts, done = [], 0
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if b > done:  # tokens of one character's bytes share its span
            parts.append(formatted[max(a, done) : b])
            done = b
    return unescape("".join(parts))


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_tokens long, n_loss_tokens long"
)


def digest_chats(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of :func:`format_chats`, as counts and digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                text = batch.column("formatted")[row].as_py()
                starts, ends, mask = (
                    batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in ("token_starts", "token_ends", "loss_mask")
                )
                turns, loss = read_turns(text), read_loss(text, starts, ends, mask.astype(bool))
                rows.append((
                    batch.column("conv_id")[row].as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                    len(loss), sha(loss), len(text), len(mask), int(mask.sum()),
                ))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(read, DIGEST)
