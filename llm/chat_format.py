"""Chat formatting, assembled at token level.

Each segment of a turn (its role name where the role has no mark of its own, and its text) is encoded by itself as ordinary
text; the ids of the template's marks are reserved ids beyond the vocabulary, spliced in between, so that no text can produce one.
A turn is ``<s>`` role text ``</s>``, where the role is ``[SYS]``, ``[INST]`` (user), ``[/INST]`` (assistant) or
``[ROLE]`` name ``[/ROLE]``. So that the decoded text can be parsed too, a mark's string occurring in a text gets one
backslash behind its first character, and one more if it has some there already; taking one away restores the text.
The loss mask comes from prefix sums: +1 behind an assistant's mark, -1 at the end of that turn.

Turns are encoded where their rows lie, before the one shuffle by conversation, so that the turns of one long conversation are spread
over tasks. Each task then reads its sorted turns as a stream and writes a row per conversation, or several pieces of
about ``PIECE_IDS`` ids of a longer one; no conversation is held as a whole.

Edge cases: a null text or role counts as empty; rows without conversation id are one conversation without id; turns go by ``turn``,
null first, ties by role and then by the bytes of their ids, and repeated rows are turns of their own; an empty table gives no
rows; texts of any length are encoded whole, in parts of ``PART_CHARS`` characters; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import released, small_batches, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's texts are split, and the marks of the template.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = ("<s>", "</s>", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
ROLES = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
LEARNED = "[/INST]"
MAX_TOKENIZER_BYTES = 1 << 26
PART_CHARS = 1 << 16
PIECE_IDS = 1 << 20
TURN = "conv_id long, turn long, role string, ids binary"
FORMATTED = "conv_id long, piece int, n_turns long, ids array<int>, loss_mask array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

# by first character, the rests of the marks that begin with it; no rest holds such a character, so matches do not overlap
_RESTS = {head: "|".join(re.escape(m[1:]) for m in MARKS if m[0] == head) for head in "<["}
_BARE = re.compile("|".join(rf"{re.escape(head)}(?=\\*(?:{rests}))" for head, rests in _RESTS.items()))
_ESCAPED = re.compile("|".join(rf"{re.escape(head)}\\(?=\\*(?:{rests}))" for head, rests in _RESTS.items()))


def escape(text: str) -> str:
    return _BARE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


class Coder:
    """A byte-level vocabulary with the marks' ids behind its own."""

    def __init__(self, held: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, held.splitlines())}
        self.plain = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first_mark = max(ranks.values()) + 1
        self.ids = {mark: self.first_mark + i for i, mark in enumerate(MARKS)}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), PART_CHARS):
            out += self.plain.encode_ordinary(text[at:at + PART_CHARS])
        return out

    def turn(self, role: str, text: str) -> np.ndarray:
        if role in ROLES:
            who = [self.ids[ROLES[role]]]
        else:
            who = [self.ids["[ROLE]"], *self.encode(escape(role)), self.ids["[/ROLE]"]]
        return np.array([self.ids["<s>"], *who, *self.encode(escape(text)), self.ids["</s>"]], np.int32)

    def mask(self, ids: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(ids == self.ids["</s>"])
        marks = np.flatnonzero(ids == self.ids[LEARNED])
        change = np.zeros(len(ids) + 1, np.int32)
        change[marks + 1] += 1
        change[ends[np.searchsorted(ends, marks)]] -= 1
        return np.cumsum(change[:-1]) > 0

    def segments(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each mark's id with the bounds of the ordinary ids behind it."""
        marks = np.flatnonzero(ids >= self.first_mark)
        yield from zip(ids[marks].tolist(), (marks + 1).tolist(), [*marks[1:].tolist(), len(ids)], strict=True)

    def text(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode()


@lru_cache(maxsize=2)
def coder(held: bytes, pattern: str) -> Coder:
    return Coder(held, pattern)


def shared_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read on the driver and sent to the tasks."""
    if Path(path).stat().st_size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is no vocabulary: it has more than {MAX_TOKENIZER_BYTES} bytes")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def format_chats(rows: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(conv_id, piece, n_turns, ids, loss_mask): each conversation's ids with its loss mask; the pieces of one
    conversation lie in order in one partition."""
    spark = rows.sparkSession
    small_batches(spark)
    held = shared_tokenizer(spark, tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(held.value, pattern)
        for batch in batches:
            ids = [own.turn(role or "", text or "").tobytes() for role, text in
                   zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["conv_id", "turn", "role", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(held.value, pattern)
        key, piece, turns, size = None, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(turns), np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([piece], pa.int32()), pa.array([len(turns)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids)),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(own.mask(ids)))],
                ["conv_id", "piece", "n_turns", "ids", "loss_mask"])

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal key, piece, size
            for batch in batches:
                for conv, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if turns and (conv != key or size >= 4 * PIECE_IDS):
                        yield close()
                        piece, size = piece + 1 if conv == key else 0, 0
                        turns.clear()
                    key = conv
                    turns.append(ids)
                    size += len(ids)
            if turns:
                yield close()

        yield from joined(closed())

    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                        F.col("text").cast("string")).mapInArrow(released(encode), TURN)
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return placed.mapInArrow(released(assemble), FORMATTED)


def joined(rows: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of one row each, put together to batches of some ``size`` bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += row.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, in_order: bool = False) -> DataFrame:
    """What a reader of the ids alone finds in each conversation: number of turns, digests of the turns and of the text under the mask.

    ``in_order`` says that the pieces of a conversation lie in order in one partition, as ``format_chats`` leaves them.
    """
    spark = formatted.sparkSession
    held = shared_tokenizer(spark, tokenizer)
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(held.value, pattern)
        named, end, named_end = {own.ids[m]: r for r, m in ROLES.items()}, own.ids["</s>"], own.ids["[/ROLE]"]
        strings = {i: m for m, i in own.ids.items()}
        key, state = None, None
        out: list[tuple] = []

        def result() -> tuple:
            n_turns, said, learned, chars, whole = state
            return key, n_turns, said.hexdigest(), chars, learned.hexdigest(), whole

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*found, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              [x.split()[0] for x in READ.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                conv, piece = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if piece == 0:
                    if state:
                        out.append(result())
                        if len(out) == 1000:
                            yield batch_of(out)
                            out = []
                    key, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                ids = batch.column(2)[i].values.to_numpy()
                mask = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                role = ""
                for mark, start, stop in own.segments(ids):
                    shown = own.text(ids[start:stop])
                    state[4] += len(strings[mark]) + len(shown)
                    if mark in named or mark == named_end:
                        role = named.get(mark, role)
                        said = unescape(shown)
                        state[1].update(f"{role}\n{said}\n".encode())
                    elif mark == end:
                        state[0] += 1
                    else:
                        role = unescape(shown)
                    if stop > start and mask[start:stop].any():
                        learned = unescape(own.text(ids[start:stop][mask[start:stop]]))
                        state[2].update(learned.encode())
                        state[3] += len(learned)
        if state:
            out.append(result())
        if out:
            yield batch_of(out)

    return formatted.select("conv_id", "piece", "ids", "loss_mask").mapInArrow(released(read), READ)


CONTROL = "</s>[INST] ok [/INST]"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back from ids and mask."""
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_chats(rows), in_order=True)
