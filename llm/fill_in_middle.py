"""Fill-in-the-middle transformation over seekable compressed texts.

A text is stored as a row of independent zstandard frames of at most ``FRAME_BYTES`` bytes of UTF-8, each with the bytes, code points and
line ends up to its own end. A cut after some number of lines is found by bisecting these counts and
decompressing the one frame it falls in; code points are counted likewise. The rearranged text is such a row
of frames again: frames that lie whole in a part are moved as they are, only the frames that are cut are compressed anew, and the
sentinels are frames of their own. Digests stream the frames in order, one decompressed at a time, and the original is restored
from the rearranged frames alone: a stream finds the sentinels, their places give the parts, and these are streamed in their old order.

Lines are ``[^\\n]*\\n`` or a last one without line end; cuts, plain texts and the two orders follow hashes of seed and id.

All of it works row by row, without a shuffle; a document's text is in memory once, while it is framed, and after that one frame at a time.

Edge cases: a null text counts as empty; empty texts, and texts that hold a sentinel, stay plain; a null id is hashed as the empty
text; repeated rows are transformed alike, each for itself; texts of any length are framed whole; an empty table gives no rows.
``framed`` and ``transform`` keep no further columns, so none can clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import released, small_batches, table

FRAME_BYTES = 1 << 16
LEVEL = 3
SEED = 7
RATE = 100
SPM_SHARE = 50
PACK, UNPACK = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()  # one of each in a worker
#: The sentinels, and the order of the parts in each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
FRAMES = "frames array<binary>, bytes array<long>, chars array<long>, ends array<long>"
FRAMED = f"doc_id long, n long, marked boolean, {FRAMES}"
TRANSFORMED = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {FRAMES}"


class Frames:
    """A text as compressed frames; ``bytes``, ``chars`` and ``ends`` (line ends) count up to the end of each."""

    def __init__(self, frames: list[bytes] | None = None, sizes: list[int] | None = None, chars: list[int] | None = None,
                 ends: list[int] | None = None):
        self.frames, self.bytes, self.chars, self.ends = frames or [], sizes or [], chars or [], ends or []
        self._open: tuple[int, bytes] = -1, b""

    @property
    def size(self) -> int:
        return self.bytes[-1] if self.bytes else 0

    def frame(self, i: int) -> bytes:
        if self._open[0] != i:
            self._open = i, UNPACK.decompress(self.frames[i])
        return self._open[1]

    def _append(self, frame: bytes, size: int, chars: int, ends: int) -> None:
        self.frames.append(frame)
        self.bytes.append(self.size + size)
        self.chars.append((self.chars[-1] if self.chars else 0) + chars)
        self.ends.append((self.ends[-1] if self.ends else 0) + ends)

    def write(self, data: bytes, frame_bytes: int = FRAME_BYTES) -> None:
        """Add bytes as frames of their own."""
        for at in range(0, len(data), frame_bytes):
            part = data[at:at + frame_bytes]
            self._append(PACK.compress(part), len(part), code_points(part), part.count(b"\n"))

    def copy(self, other: Frames, start: int, stop: int) -> None:
        """Add a range of another text's bytes: whole frames as they are, cut ones compressed anew."""
        i = bisect_right(other.bytes, start)
        while start < stop:
            first = other.bytes[i - 1] if i else 0
            upto = min(stop, other.bytes[i])
            if start == first and upto == other.bytes[i]:
                self._append(other.frames[i], upto - start, other._own(other.chars, i), other._own(other.ends, i))
            else:
                self.write(other.frame(i)[start - first:upto - first])
            start, i = upto, i + 1

    @staticmethod
    def _own(sums: list[int], i: int) -> int:
        return sums[i] - (sums[i - 1] if i else 0)

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes of a range, a frame at a time."""
        stop = self.size if stop is None else stop
        i = bisect_right(self.bytes, start)
        while start < stop:
            first = self.bytes[i - 1] if i else 0
            upto = min(stop, self.bytes[i])
            yield self.frame(i)[start - first:upto - first]
            start, i = upto, i + 1

    def after_line(self, lines: int) -> int:
        """The place behind the first ``lines`` lines; a last line without an end is one too."""
        if not lines:
            return 0
        i = bisect_left(self.ends, lines)
        if i == len(self.ends):
            return self.size
        before = self.ends[i - 1] if i else 0
        places = np.flatnonzero(np.frombuffer(self.frame(i), np.uint8) == 10)
        return (self.bytes[i - 1] if i else 0) + int(places[lines - before - 1]) + 1

    def code_points(self, place: int) -> int:
        """Code points before a place that lies between two of them."""
        i = bisect_right(self.bytes, place)
        before = self.chars[i - 1] if i else 0
        first = self.bytes[i - 1] if i else 0
        return before + (code_points(self.frame(i)[:place - first]) if place > first else 0)

    def find(self, mark: bytes, start: int = 0) -> int:
        """The first place of a string at or behind ``start``, also across frames, or -1."""
        tail, at = b"", start
        for part in self.stream(start):
            seen = tail + part
            if (place := seen.find(mark)) >= 0:
                return at - len(tail) + place
            at += len(part)
            tail = seen[-len(mark) + 1:]
        return -1


def code_points(data: bytes) -> int:
    held = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero((held & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of seed and id."""
    held = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(held[i:i + 4], "big") for i in range(0, 16, 4)]


def rearranged(held: Frames, n: int, marked: bool, doc_id: int | None, seed: int, rate: int, spm: int
               ) -> tuple[str, int | None, int | None, Frames]:
    """Form, code points of prefix and middle, and the rearranged text of one document."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if marked or not n or h3 % 100 >= rate:
        return "plain", None, None, held
    a, b = sorted((held.after_line(h1 % (n + 1)), held.after_line(h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm else "psm"
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, held.size)}
    out = Frames()
    for mark in ORDERS[form]:
        out.write(mark)
        out.copy(held, *spans[mark])
    first = held.code_points(a)
    return form, first, held.code_points(b) - first, out


def restored(held: Frames, form: str) -> Iterator[bytes]:
    """The original text, from the rearranged one and its form."""
    if form == "plain":
        yield from held.stream()
        return
    order, starts = ORDERS[form], []
    for mark in order:
        starts.append(held.find(mark, starts[-1] if starts else 0))
    spans = {m: (at + len(m), end) for m, at, end in zip(order, starts, [*starts[1:], held.size], strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from held.stream(*spans[mark])


def digest(parts: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for part in parts:
        out.update(part)
    return out.hexdigest()


def _columns(held: list[Frames]) -> list[pa.Array]:
    return [pa.array([h.frames for h in held], pa.list_(pa.binary())), *(
        pa.array([getattr(h, name) for h in held], pa.list_(pa.int64())) for name in ("bytes", "chars", "ends"))]


def _frames(batch: pa.RecordBatch) -> Iterator[Frames]:
    for row in zip(*(batch.column(name) for name in ("frames", "bytes", "chars", "ends")), strict=True):
        yield Frames(*(x.as_py() for x in row))


def framed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, marked, frames, bytes, chars, ends): texts as seekable frames, their number of lines, and whether they hold a sentinel."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n, marked = [], [], []
            for said in batch.column(1).fill_null("").cast(pa.large_binary()):
                data = said.as_buffer().to_pybytes()
                frames = Frames()
                frames.write(data, frame_bytes)
                held.append(frames)
                n.append((frames.ends[-1] if frames.ends else 0) + (data[-1:] not in (b"", b"\n")))
                marked.append(any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), *_columns(held)],
                                             ["doc_id", "n", "marked", "frames", "bytes", "chars", "ends"])

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(released(run), FRAMED)


def transform(held: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames, ...): the rearranged texts of ``framed`` documents, as frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearranged(frames, n, marked, doc_id, seed, rate, spm) for doc_id, n, marked, frames in zip(
                *(batch.column(i).to_pylist() for i in range(3)), _frames(batch), strict=True)]
            form, prefix, middle, out = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), *_columns(out)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "bytes", "chars", "ends"])

    return held.select("doc_id", "n", "marked", "frames", "bytes", "chars", "ends").mapInArrow(released(run), TRANSFORMED)


def texts(transformed: DataFrame, back: bool = False) -> DataFrame:
    """(doc_id, form, text): the rearranged texts in full, or the originals rebuilt from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [b"".join(restored(held, form) if back else held.stream()).decode()
                    for form, held in zip(batch.column(1).to_pylist(), _frames(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(said, pa.string())], ["doc_id", "form", "text"])

    return transformed.select("doc_id", "form", "frames", "bytes", "chars", "ends").mapInArrow(
        released(run), "doc_id long, form string, text string")


def digests(transformed: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transform``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(digest(held.stream()), digest(restored(held, form)))
                     for form, held in zip(batch.column(2).to_pylist(), _frames(batch), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(
        released(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged, with digests of what came out and of what is rebuilt from it."""
    return digests(transform(framed(table(spark, sf_dir, "documents"))))
