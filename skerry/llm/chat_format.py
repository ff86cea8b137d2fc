"""Chat formatting: conversations to token ids with a loss mask, and back.

Method: token-level assembly.  Role and text are encoded separately by a
byte-level BPE; reserved ids that no text can encode to are spliced between them;
the loss mask is the prefix sum of +1 at the first id of an assistant text and -1
behind its last.  Control strings that occur inside a text are escaped
reversibly: a backslash goes behind the opening character, and one more where
there are some already.

Defined cases: null role and null text are empty; turns are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own; a null
``conv_id`` is one conversation; an empty table gives no rows.

Encoding is done row by row before the shuffle; the digests are then taken in one
pass over rows sorted by conversation and turn, a turn in memory at a time, so a
conversation may hold any share of all rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, partitions, read_table, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
START, SEP, END = 50257, 50258, 50259
MARKS = {START: "<|im_start|>", SEP: "<|im_sep|>", END: "<|im_end|>"}
TRAINED_ROLES = ("assistant",)

#: What has a meaning to this template or a common other one.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\(?={_REST})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_long(enc, text: str, piece: int = 100_000) -> list[int]:
    """Ids of a text.  A long one is encoded in parts, so that no copy of it is made;
    parts end where a pre-token does, over which no merge reaches, so that the ids are
    those of the whole."""
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for m in regex.compile(enc._pat_str).finditer(text):
        if m.end() - at >= piece:
            ids += enc.encode_ordinary(text[at:m.end()])
            at = m.end()
    return ids + enc.encode_ordinary(text[at:])


def encode_turn(enc, role: str | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn and its loss mask."""
    head, body = encode_long(enc, escape(role or "")), encode_long(enc, escape(text or ""))
    ids = np.array([START, *head, SEP, *body, END], np.uint32)
    delta = np.zeros(len(ids) + 1, np.int8)
    if role in TRAINED_ROLES:
        delta[len(head) + 2] += 1
        delta[len(ids) - 1] -= 1
    return ids, np.cumsum(delta[:-1]).astype(np.uint8)


def read_turn(enc, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Formatted text, role, text and text under the mask, from ids alone."""
    sep = int(np.flatnonzero(ids == SEP)[0])
    role, body = (enc.decode_bytes(x.tolist()).decode() for x in (ids[1:sep], ids[sep + 1:-1]))
    loss = enc.decode_bytes(ids[mask == 1].tolist()).decode()
    return f"{MARKS[START]}{role}{MARKS[SEP]}{body}{MARKS[END]}", unescape(role), unescape(body), unescape(loss)


TURNS = "conv_id long, turn long, role string, ids binary, mask binary, key string"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoding()
    for b in slices(batches, "text"):
        pairs = [encode_turn(enc, r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id").cast(pa.int64()), b.column("turn").cast(pa.int64()), b.column("role"), pa.array([i.astype("<u4").tobytes() for i, _ in pairs], pa.binary()), pa.array([m.tobytes() for _, m in pairs], pa.binary()), b.column("key")],
            ["conv_id", "turn", "role", "ids", "mask", "key"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: its ids (little-endian uint32) and loss mask (uint8)."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    return arrow_map(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", key.alias("key")), _encode, TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoding()
    done: list[dict] = []
    now: dict | None = None

    def close() -> None:
        done.append({**now, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

    for b in batches:
        for conv, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), b.column("mask").to_pylist(), strict=True):
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    close()
                now = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_tokens": 0, "n_loss_tokens": 0}
                turns, loss = hashlib.sha256(), hashlib.sha256()
            ids, mask = np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8)
            formatted, role, text, under = read_turn(enc, ids, mask)
            turns.update(f"{role}\n{text}\n".encode())
            loss.update(under.encode())
            for k, v in (("n_turns", 1), ("loss_chars", len(under)), ("formatted_chars", len(formatted)), ("n_tokens", len(ids)), ("n_loss_tokens", int(mask.sum()))):
                now[k] += v
        if len(done) > 5000:
            yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
            done = []
    if now is not None:
        close()
    yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)


def digest_conversations(turns: DataFrame) -> DataFrame:
    """What reading the formatted turns back gives, one row a conversation."""
    ordered = turns.repartition(partitions(turns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    return arrow_map(ordered.select("conv_id", "ids", "mask"), _digest, DIGESTS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_turns(stored.unionByName(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
