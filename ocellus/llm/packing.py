"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.common import text_or_empty, tidy

SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one added token
_CUT = re.compile(r" (?=\S)")


def token_encoder(ranks_file: str, pattern: str, special_id: int, stretch: int = 1 << 20):
    """text -> its ids as little-endian uint32 bytes, equal to the byte-level BPE of the ranks file.

    A boundary of the pre-tokenizer always lies before a space that a visible
    character follows, so a text of more than ``stretch`` characters is cut there
    and its parts are encoded one by one.
    """
    import base64

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    mark = np.array([special_id], dtype="<u4").tobytes()

    def plain(text: str) -> bytes:
        parts, at = [], 0
        while len(text) - at > stretch and (cut := _CUT.search(text, at + stretch)):
            parts.append(text[at : cut.start()])
            at = cut.start()
        parts.append(text[at:] if at else text)
        return b"".join(np.array(encode(x), dtype="<u4").tobytes() for x in parts)

    def encoded(text: str) -> bytes:
        if SPECIAL not in text:
            return plain(text)
        return mark.join(plain(x) for x in text.split(SPECIAL))

    return encoded


class SumOfSquares:
    """Open windows by fill level; each piece goes where the sum of squared level counts becomes least.

    ``counts[h]`` is the number of open windows filled to h. Filling a window up
    costs nothing; among equal choices the fullest window wins. With ``max_open``
    windows open no further one is begun: the piece is cut to fill an open window,
    chosen by the same sum, and its rest is placed again. So memory is bounded and
    the level array decides every placement. Windows that are open at the end are
    cut, in their order, into sequences of powers of two, which need no padding.
    """

    def __init__(self, size: int, first_window: int, max_open: int = 128):
        self.size, self.next, self.max_open = size, first_window, max_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.levels: list[list[list[tuple]]] = [[] for _ in range(size + 1)]  # the open windows of each level
        self.n_open = 0
        self.done: list[tuple] = []  # (doc, start, ids, doc_tokens, window, offset)

    def close(self, pieces: list[tuple]) -> None:
        at, window = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, window, at))
            at += len(ids) // 4

    def add(self, doc, ids: bytes) -> None:
        size, total = self.size, len(ids) // 4
        full = total // size
        for i in range(full):
            self.close([(doc, i * size, ids[4 * i * size : 4 * (i + 1) * size], total)])
        if total > full * size:
            self.place(doc, full * size, ids[4 * full * size :], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        size, rest = self.size, len(ids) // 4
        # change of the sum of squares: leaving level h gives 1 - 2 counts[h], reaching h + rest gives 1 + 2 counts[h + rest]
        top = size - rest
        change = np.empty(top + 1, dtype=np.int64)
        change[1:] = 1 - 2 * self.counts[1 : top + 1]
        change[0] = 0  # a new window
        change[:top] += 1 + 2 * self.counts[rest:size]
        change[1:][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(change[::-1]))
        if level or self.n_open < self.max_open:
            window = self._taken(level) if level else []
            window.append((doc, start, ids, total))
            self._put(window, level + rest)
            return
        # full house: fill a window of level h > top and place what is left of the piece
        left = self.counts[top + 1 : size]
        if not left.any():  # all open windows are emptier than that: the fullest takes the piece whole
            level = int(np.flatnonzero(self.counts[: top + 1])[-1])
            window = self._taken(level)
            window.append((doc, start, ids, total))
            self._put(window, level + rest)
            return
        change = np.where(left > 0, 1 - 2 * left + 1 + 2 * self.counts[1:rest], np.iinfo(np.int64).max)
        level = size - 1 - int(np.argmin(change[::-1]))
        cut = size - level
        window = self._taken(level)
        window.append((doc, start, ids[: 4 * cut], total))
        self._put(window, size)
        self.place(doc, start + cut, ids[4 * cut :], total)

    def _taken(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.levels[level].pop()

    def _put(self, window: list[tuple], level: int) -> None:
        if level == self.size:
            self.close(window)
        else:
            self.levels[level].append(window)
            self.counts[level] += 1
            self.n_open += 1

    def finish(self) -> int:
        """Close the open windows in powers of two; the number of ids in them."""
        ended = 0
        for level in np.flatnonzero(self.counts)[::-1].tolist():
            for window in self.levels[level]:
                ended += level
                queue, at, left = list(window), 0, level
                while left:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    part = []
                    while room:
                        doc, start, ids, total = queue[0]
                        take = min(room, len(ids) // 4 - at)
                        part.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                        room -= take
                        at += take
                        if at == len(ids) // 4:
                            queue.pop(0)
                            at = 0
                    self.close(part)
            self.levels[level] = []
        self.counts[:] = 0
        self.n_open = 0
        return ended


def pack(df: DataFrame, ranks_file: str, pattern: str, size: int = 1024, special_id: int = 50256, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs its own part of the table as it reads it, with no shuffle; a
    sequence_id is the task's number times 2^32 plus a counter. A null or empty
    text is the end id alone; repeated rows and rows of one id, null ids included,
    are packed each for itself; a text longer than a window gives full windows and
    a rest. An empty table gives no rows; other columns are not read.
    """

    def packed(batches):
        encode = token_encoder(ranks_file, pattern, special_id)
        end = np.array([end_id], dtype="<u4").tobytes()
        state = SumOfSquares(size, TaskContext.get().partitionId() << 32)

        def rows():
            done, state.done = state.done, []
            ids = [x[2] for x in done]
            cols = [
                pa.array([x[0] for x in done], pa.int64()),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([x[3] for x in done], pa.int64()),
                pa.array([x[4] for x in done], pa.int64()),
                pa.array([x[5] for x in done], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                state.add(doc, encode(text.as_py()) + end)
            yield rows()
        state.finish()
        yield rows()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        tidy(packed), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
