"""Hierarchical packing of token streams into windows of several lengths.

A document is its token ids followed by an end id.  Whole windows of the top
length are cut off first; what remains is routed to the smallest tier (a power
of two from ``shortest`` to ``longest``) that holds it.  Tiers are packed from
the longest down: a window is opened by the longest waiting piece of its tier,
its gap is filled by the best-fitting waiting pieces of the shorter tiers, and
the last gap by cutting a piece, whose rest is routed again.  Pieces that are
left when the input ends close in windows of falling powers of two, so that no
window needs padding at all.

Each partition of the input packs on its own, as a stream of waves of bounded
size: texts are never shuffled or gathered, a lost task repeats its partition
alone, and the cost of the split is at most a few short windows per partition.
Within a wave the windows of a tier are dealt in turn, by falling attention
cost (the sum of squared piece lengths), to step groups of equal token number,
so that the steps of a training run are balanced.

Defined results: null text is empty, and an empty document is its end id alone;
repeated rows and ids are packed once per row; null ids stay null; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import batch_rows

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length int, step_group long")


def byte_bpe(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[str], np.ndarray]:
    """Encoder of a byte-level BPE vocabulary in rank form; ``special`` strings are single ids."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
    allowed = set(special or {})
    return lambda text: np.asarray(own.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), np.uint32)


class Packer:
    """Packs a stream of (document, ids) into windows; see the module text."""

    def __init__(self, longest: int, shortest: int, tokens_per_step: int, first_sequence: int):
        self.longest, self.shortest = longest, shortest
        self.per_step = max(tokens_per_step, longest)
        self.next = first_sequence
        self.steps: dict[int, int] = {}
        self.waiting: dict[int, list] = {}      # by length: (document, start, ids)
        self.lengths = 0                         # bit n: pieces of length n wait
        self.rows: list[tuple] = []
        self.windows: list[tuple[int, int, int, int]] = []      # of this wave: tier, cost, first row, end row

    def tier(self, n: int) -> int:
        return max(self.shortest, 1 << (n - 1).bit_length())

    def wait(self, doc: int, start: int, ids: np.ndarray) -> None:
        n = len(ids)
        self.waiting.setdefault(n, []).append((doc, start, ids))
        self.lengths |= 1 << n

    def take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most ``most`` ids."""
        n = (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n <= 0:
            return None
        pile = self.waiting[n]
        piece = pile.pop()
        if not pile:
            self.lengths ^= 1 << n
        return piece

    def shortest_above(self, n: int) -> tuple | None:
        """The shortest waiting piece of more than ``n`` ids."""
        over = self.lengths >> (n + 1)
        return self.take(n + (over & -over).bit_length()) if over else None

    def add(self, doc: int, ids: np.ndarray) -> None:
        cut = len(ids) // self.longest * self.longest
        for a in range(0, cut, self.longest):
            self.window([(doc, a, ids[a:a + self.longest])], self.longest)
        if cut < len(ids):
            self.wait(doc, cut, ids[cut:])

    def window(self, pieces: list[tuple], length: int) -> None:
        at, first = 0, len(self.rows)
        for doc, start, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), self.next, at, length))
            at += len(ids)
        self.windows.append((length, sum(len(p[2]) ** 2 for p in pieces), first, len(self.rows)))
        self.next += 1

    def fill(self, window: int, head: tuple) -> list[tuple] | None:
        """Pieces that fill ``window`` exactly, or None (all pieces wait again)."""
        pieces, gap = [head], window - len(head[2])
        while gap:
            if piece := self.take(gap):
                pieces.append(piece)
                gap -= len(piece[2])
            elif piece := self.shortest_above(gap):
                doc, start, ids = piece
                pieces.append((doc, start, ids[:gap]))
                self.wait(doc, start + gap, ids[gap:])
                gap = 0
            else:
                for p in pieces:
                    self.wait(*p)
                return None
        return pieces

    def pack(self) -> None:
        """Fill windows of every tier, longest first, while waiting pieces suffice."""
        window = self.longest
        while window >= self.shortest:
            floor = window // 2 if window > self.shortest else 0
            while self.lengths >> (floor + 1) and (head := self.take(window)):
                if len(head[2]) <= floor:
                    self.wait(*head)
                    break
                if (pieces := self.fill(window, head)) is None:
                    break
                self.window(pieces, window)
            window //= 2

    def close(self) -> None:
        """Pack the rest; the tail goes into windows of falling powers of two."""
        self.pack()
        rest = sum(n * len(p) for n, p in self.waiting.items())
        while rest:
            window = min(self.longest, 1 << (rest.bit_length() - 1))
            head = self.take(self.longest)
            if len(head[2]) > window:
                doc, start, ids = head
                self.wait(doc, start + window, ids[window:])
                head = (doc, start, ids[:window])
            self.window(self.fill(window, head), window)
            rest -= window

    def flush(self) -> Iterator[tuple]:
        """Rows so far, with balanced step groups."""
        by_tier: dict[int, list] = {}
        for w in self.windows:
            by_tier.setdefault(w[0], []).append(w)
        group = np.zeros(len(self.rows), np.int64)
        for length, windows in by_tier.items():
            size = self.per_step // length
            steps = -(-len(windows) // size)
            first = self.steps.get(length, 0)
            for k, (_, _, a, b) in enumerate(sorted(windows, key=lambda w: -w[1])):
                turn, place = divmod(k, steps)
                group[a:b] = first + (place if turn % 2 == 0 else steps - 1 - place)
            self.steps[length] = first + steps
        rows, self.rows, self.windows = self.rows, [], []
        for r, g in zip(rows, group.tolist()):
            yield (*r, g)


def pack(docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", longest: int = 2048, shortest: int = 256, tokens_per_step: int = 1 << 17,
         wave_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece (``PIECES``).  ``encode()`` makes the text encoder in each task.

    A window holds a piece at ``offset``; offsets of a sequence are gapless from
    0 to ``sequence_length``.  Step groups are numbered per tier.
    """
    if longest & (longest - 1) or shortest & (shortest - 1) or shortest > longest:
        raise ValueError("tiers are powers of two")
    spark = docs.sparkSession
    batch_rows(spark, 200)

    def rows_of(packer: Packer, base: int, ids: dict) -> pa.RecordBatch:
        found = list(packer.flush())
        doc, start, length, crc, seq, at, window, group = map(list, zip(*found)) if found else ([],) * 8
        names = [ids[d][0] for d in doc]
        tokens = [ids[d][1] for d in doc]
        waits = {p[0] for pile in packer.waiting.values() for p in pile}
        for d in [d for d in ids if d not in waits]:
            del ids[d]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        cols = [names, start, length, crc, tokens, seq, at, window, [g + base for g in group]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        packer, encoder, ids = Packer(longest, shortest, tokens_per_step, base), encode(), {}
        end, n, wave = np.array([end_id], np.uint32), 0, 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = np.concatenate([encoder(text), end]) if text else end
                ids[n] = (doc_id, len(tokens))
                packer.add(n, tokens)
                n, wave = n + 1, wave + len(tokens)
                if wave >= wave_tokens:
                    packer.pack()
                    yield rows_of(packer, base, ids)
                    wave = 0
        packer.close()
        yield rows_of(packer, base, ids)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)
