"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The library is used only to read the vocabulary (pieces, scores, kinds) of a
model; encoding and decoding are done here.  A text becomes words at its spaces
(no piece holds a space after another character, which ``Vocabulary`` checks),
and every word not seen before in a task is encoded once, all new words of a
batch together: their symbols lie in one flat array with a word number each.  A
round looks up the rank of every adjacent pair, takes the minimum of each word,
merges in each word the leftmost pairs of that rank at the same time, and
compacts the array; words with no pair left drop out.  Two pairs of one rank
merge in the same round only where that gives the library's result: if a merged
piece can go on to a better-ranked piece than itself (``unsafe``), only the
leftmost pair of the word is merged, as the library's queue does.  A run of
spaces is encoded in closed form from the lengths of the model's space pieces.

Supported models: BPE with the identity normaliser, no removal of extra
white space, and byte fallback; others are refused.

Defined results: null and empty texts have no ids and decode to the empty
text; equal texts give equal rows; null ids stay null; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import map_batches

SPACE = "▁"
NONE = np.int64(1) << 62
#: Bytes of words kept per worker; beyond that the memory starts anew.
CACHE_BYTES = 256 << 20
#: Words of more characters merge by local minima.
LONG = 48


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if sp.Normalize("a  ①") != f"{SPACE}a{SPACE}{SPACE}①" or not sp.is_byte(sp.encode("\x00")[-1]):
            raise ValueError("only BPE models with identity normalisation, a space in front and byte fallback are supported")
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece holds a space after another character")
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces):
            raise ValueError("a piece holds several spaces and other characters")
        #: Rank of a piece: pieces of equal score share it, as ties go to the leftmost pair.
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(n, NONE, np.int64)
        for i in plain:
            self.rank[i] = order[sp.get_score(i)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = byte_ids
        self.char_ids = np.full(0x110000, -1, np.int64)
        for p, i in pieces.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        if any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("pieces that reach over a line end")
        # pairs of ids that join to a piece; single characters out of the vocabulary never merge
        table: dict[int, int] = {}
        unsafe = np.zeros(n, bool)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    table[a * n + b] = i
                    for part in (a, b):
                        if self.rank[i] <= self.rank[part]:
                            unsafe[part] = True
        self.n = n
        self.pair_keys = np.array(sorted(table), np.int64)
        self.pair_ids = np.array([table[k] for k in self.pair_keys.tolist()], np.int64)
        self.unsafe = unsafe
        self.space = pieces[SPACE]
        #: A merge can change what happens to symbols at most this far away.
        self.reach = max(map(len, pieces)) + 1
        runs = {len(p): i for p, i in pieces.items() if not p.strip(SPACE)}
        if len({self.rank[i] for k, i in runs.items() if k > 1}) > 1:
            raise ValueError("space pieces of different scores")
        self.longest_run = max(runs)
        #: Ids of fewer spaces in a row than the longest space piece has.
        self.short_runs = [[runs[k] for k in _grow(n, runs)] for n in range(self.longest_run)]
        self.full_run = runs[self.longest_run]
        if any(_grow(n, runs) != [self.longest_run] + _grow(n - self.longest_run, runs) for n in range(self.longest_run, 4 * self.longest_run)):
            raise ValueError("space pieces that do not fill up from the left")
        #: What an id decodes to: bytes, a space for each space mark.
        self.text = [b""] * n
        for p, i in pieces.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of joined pairs, -1 where there is none."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all characters in one flat array, symbols per word); characters
        out of the vocabulary stand as the ids of their bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
        flat = self.char_ids[points]
        missing = np.flatnonzero(flat < 0)
        if len(missing):
            extra = [chr(c).encode("utf-8", "replace") for c in points[missing].tolist()]
            n = np.ones(len(flat), np.int64)
            n[missing] = list(map(len, extra))
            owner = np.repeat(np.arange(len(words)), sizes)
            sizes = np.bincount(np.repeat(owner, n), minlength=len(words))
            wide = np.repeat(flat, n)
            wide[wide < 0] = [self.bytes[b] for e in extra for b in e]
            flat = wide
        return flat, sizes


def _grow(n: int, runs: dict[int, int]) -> list[int]:
    """Lengths of the pieces of ``n`` spaces: the leftmost pair that joins to a piece is merged until none is left."""
    parts = [1] * n
    while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in runs), None)) is not None:
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_rounds(flat: np.ndarray, sizes: np.ndarray, v: Vocabulary, windowed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in one flat array, ids per word; no word is empty): rounds of simultaneous leftmost merges over one flat array.

    ``windowed`` is for long words: there a pair is merged when no pair within
    ``reach`` symbols has a better rank (or an equal one to its left).  A piece
    has fewer characters than that, so no earlier merge can get at the pair.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    done_ids, done_words = [flat[:0]], [word[:0]]
    pair = np.full(len(flat), -1, np.int64)
    fresh = np.arange(len(flat))
    while len(flat):
        _renew(pair, fresh, flat, word, v)
        rank = np.where(pair >= 0, v.rank[pair], NONE)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, first)
        over = least == NONE
        size = np.diff(np.append(first, len(flat)))
        if over.any():      # compaction: finished words leave the array
            stay = np.repeat(~over, size)
            done_ids.append(flat[~stay])
            done_words.append(word[~stay])
            flat, word, pair, rank = flat[stay], word[stay], pair[stay], rank[stay]
            if not len(flat):
                break
            least, size = least[~over], size[~over]
        at = _local(rank, v.reach) if windowed else _leftmost(rank, np.repeat(least, size), word, pair, v.unsafe)
        flat[at] = pair[at]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))        # places after compaction: each merge before it took one symbol away
        flat, word, pair = flat[keep], word[keep], pair[keep]
        fresh = np.concatenate([at, at[at > 0] - 1])
    owners = np.concatenate(done_words)
    return np.concatenate(done_ids)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))


def _leftmost(rank: np.ndarray, least: np.ndarray, word: np.ndarray, pair: np.ndarray, unsafe: np.ndarray) -> np.ndarray:
    """Pairs of each word's best rank, from the left, that can merge in one round."""
    at = np.flatnonzero(rank == least)
    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
    # of overlapping hits every other one, counted from the left of their run
    new_run = first | np.concatenate([[True], at[1:] != at[:-1] + 1])
    run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - run_start) % 2 == 0
    # where a merged piece may go on to a better rank, or hits of one rank give several pieces: the leftmost alone
    alone = unsafe[pair[at]]
    alone[1:] |= ~first[1:] & (pair[at[1:]] != pair[at[:-1]])
    owner = np.cumsum(first) - 1
    careful = np.zeros(owner[-1] + 1, bool)
    careful[owner[alone]] = True
    return at[take & (first | ~careful[owner])]


def _local(rank: np.ndarray, reach: int) -> np.ndarray:
    """Pairs that beat every pair within ``reach`` symbols (equal ranks: the left one)."""
    n = len(rank)
    wide = np.full(n + 2 * reach, NONE, np.int64)
    wide[reach:reach + n] = rank
    low, have = wide, 1     # minima of ``have`` neighbours to the right, by doubling
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low, np.concatenate([low[step:], np.full(step, NONE)]))
        have += step
    left, right = low[:n], low[reach + 1:reach + 1 + n]
    return np.flatnonzero((rank < left) & (rank <= right) & (rank != NONE))


def _renew(pair: np.ndarray, at: np.ndarray, flat: np.ndarray, word: np.ndarray, v: Vocabulary) -> None:
    """Look up the pieces that the symbols at ``at`` form with their right neighbours."""
    last = at == len(flat) - 1
    pair[at[last]] = -1
    at = at[~last]
    pair[at] = np.where(word[at] == word[at + 1], v.merged(flat[at], flat[at + 1]), -1)


def _size(word: str) -> int:
    """Bytes that a held word and its ids take at most: an id per byte of UTF-8 where no piece has it."""
    return 200 + 20 * len(word)


class Codec:
    """Encodes and decodes texts, with a bounded memory of words (their ids as 32-bit integers)."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.words: dict[str, bytes] = {}
        self.held = 0       # bytes of them, about
        self.numerals = list(map(str, range(self.v.n)))

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not held; beyond ``CACHE_BYTES`` only those of this batch stay."""
        new = [w for w in words if w not in self.words]
        if self.held + sum(map(_size, new)) > CACHE_BYTES:
            self.words, self.held, new = {}, 0, list(words)
        self.held += sum(map(_size, new))
        for part, windowed in (([w for w in new if len(w) <= LONG], False), ([w for w in new if len(w) > LONG], True)):
            for i in range(0, len(part), 20_000):
                some = part[i:i + 20_000]
                ids, sizes = merge_rounds(*self.v.symbols(some), self.v, windowed)
                raw, ends = ids.astype("<i4").tobytes(), np.cumsum(4 * sizes).tolist()
                self.words.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))

    @staticmethod
    def split(text: str) -> list[str]:
        """Words: each starts with one space mark; a piece never reaches over a line end, which cuts a word too."""
        return (" " + text).replace(SPACE, " ").replace("\n", "\n\x00").replace(" ", "\x00" + SPACE).split("\x00")

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        # a text that holds the cutting mark itself is cut at it by hand
        parts = [self._cut(t) if t else [] for t in texts]
        words = {w for p in parts for w in p}
        self.learn(words)
        out = [self._ids(p) for p in parts]
        # long words hardly come again, and each may be as long as its text
        for w in words:
            if len(w) > LONG:
                del self.words[w]
                self.held -= _size(w)
        return out

    def _cut(self, text: str) -> list[str]:
        if "\x00" not in text:
            return [w for w in self.split(text) if w]
        out: list[str] = []
        for k, part in enumerate(text.split("\x00")):
            if k:
                out.append("\x00")
            words = [w for w in self.split(part) if w]
            if k and words:
                words = words[1:] if words[0] == SPACE else [words[0].removeprefix(SPACE), *words[1:]]
            out += words
        return out

    def _ids(self, words: list[str]) -> list[int]:
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")
        lone = np.concatenate([[False], ids == self.v.space, [False]]).astype(np.int8)
        if not (lone[1:] & lone[:-1]).any():
            return ids.tolist()
        # spaces that merged with no word: runs of them, in closed form
        edges = np.diff(lone)
        out, at = [], 0
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            full, rest = divmod(b - a, self.v.longest_run)
            out += ids[at:a].tolist() + [self.v.full_run] * full + self.v.short_runs[rest]
            at = b
        return out + ids[at:].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space in front goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.v.text.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(model_file: str) -> Codec:
    """One codec per Python worker, so that its words serve all tasks there."""
    return Codec(model_file)


def round_trip(docs: DataFrame, model: Callable[[], str], id_col: str = "doc_id", text_col: str = "text",
               keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless
    ``keep_ids`` is off, ids and decoded.  ``model()`` gives the model file in each task."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(b: pa.RecordBatch) -> list:
        codec = _codec(model())
        ids = codec.encode_many(b.column(1).to_pylist())
        back = [codec.decode(x) for x in ids]
        sha = [hashlib.sha256(",".join(map(codec.numerals.__getitem__, x)).encode()).hexdigest() for x in ids]
        out = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha),
               pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
        return out + ([pa.array(ids, pa.list_(pa.int32())), pa.array(back)] if keep_ids else [])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, run)
