"""Byte-level BPE by a table of prefixes.

Every prefix of a piece of text has exactly one token that can end its encoding: the one whose bytes end the prefix and which may
follow the last token of what is before it. A table that stores that token for each prefix is filled from left to right, encodes
in linear time and can be appended to; after an edit only the prefixes near it change, since a prefix depends on the prefixes
within the longest token before it. Two tokens may follow each other if their joined bytes encode to just them, which their own parts tell.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseframe.llm.common import pieces

#: Pieces and pairs that a worker remembers at most; beyond it forgets all and goes on.
REMEMBERED = 1 << 19
#: Longer pieces are encoded each time.
SHORT = 64
#: Matches of a text that are held at once.
AT_ONCE = 1 << 16


class Vocabulary:
    """Tokens by rank, from the lines of a .tiktoken file; each of more than a byte is made of two of lower rank."""

    def __init__(self, lines: bytes):
        pairs = [line.split() for line in lines.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        #: (first, second): whether second may come right after first, as far as asked.
        self.known: dict[tuple[int, int], bool] = {}
        self.ends = ahocorasick.Automaton()
        for t, i in self.rank.items():
            if len(t) > 1:
                two = self.merged(t, 2)
                if len(two) != 2:
                    continue  # no merges lead to it
                self.parts[i] = two[0], two[1]
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The tokens of a few bytes by merging neighbours, the lowest rank first and of equal ones the leftmost, down to `least`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = min((self.rank.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def judge(self, first: int, second: int) -> bool:
        """Whether second may come right after first: no merge across their border comes before the ones that made them.

        Backwards in time, the later made of the two tokens at the border is taken apart, down to bytes. Where the two that are left
        would merge earlier than either was used up, the pair doesn't stand.
        """
        x, y, x_used, y_used = first, second, 1 << 60, 1 << 60
        token, parts = self.token, self.parts
        fits = True
        while True:
            z = self.rank.get(token[x] + token[y])
            if z is not None and z < x_used and z <= y_used:
                fits = False
                break
            made_x, made_y = (x if x in parts else -1), (y if y in parts else -1)
            if made_x > made_y:
                x_used, x = x, parts[x][1]
            elif made_y >= 0:
                y_used, y = y, parts[y][0]
            else:
                break
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[(first, second)] = fits
        return fits

    def fill(self, data: bytes, last: list[int], start: int, stop: int) -> None:
        """Sets last[i], the last token of data[:i], for start < i <= stop; what is before is known."""
        lo = max(0, start - self.longest + 1)
        known, judge = self.known, self.judge
        for at, (t, n) in self.ends.iter(data[lo:stop].decode("latin-1")):
            end = at + lo + 1
            if end <= start or last[end] >= 0:
                continue
            if end == n:
                last[end] = t
                continue
            before = last[end - n]
            if before >= 0:
                fits = known.get((before, t))
                if fits if fits is not None else judge(before, t):
                    last[end] = t


class Prefixes:
    """A piece of text and, for each of its prefixes, the last token of the prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, start: int, stop: int) -> None:
        self.vocabulary.fill(self.data, self.last, start, stop)

    def append(self, more: bytes) -> None:
        """Extends the text: prefixes that are known stay as they are."""
        n = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(n, len(self.data))

    def replace(self, lo: int, hi: int, new: bytes) -> int:
        """Puts new in the place of data[lo:hi]; returns how many prefixes were worked out anew.

        Behind the edit this goes on until a whole longest token's stretch of prefixes is as it was: then so are all later ones.
        """
        old, tail = self.last, self.last[hi + 1 :]
        self.data = self.data[:lo] + new + self.data[hi:]
        n, at, same, need = len(self.data), lo + len(new), 0, self.vocabulary.longest
        self.last = old[: lo + 1] + [-1] * (n - lo)
        self._fill(lo, at)
        while at < n:
            end = min(n, at + need)
            self._fill(at, end)
            for i in range(at, end):
                same = same + 1 if self.last[i + 1] == tail[i - lo - len(new)] else 0
            at = end
            if same >= need:
                self.last[at + 1 :] = tail[at - lo - len(new) :]
                break
        return at - lo

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.token[self.last[at]])
        return out[::-1]


def piece_tokens(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The tokens of one piece; a piece that is a token is that token."""
    whole = vocabulary.rank.get(piece)
    if whole is not None:
        return [whole]
    token, at, out = vocabulary.token, len(piece), []
    last = [-1] * (at + 1)
    vocabulary.fill(piece, last, 0, at)
    while at:
        out.append(last[at])
        at -= len(token[last[at]])
    return out[::-1]


class Encoder:
    """Texts to ids, as 4 bytes each (little-endian), and back."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary = Vocabulary(lines)
        self.pattern = regex.compile(pattern)
        self._known = _Known(self.vocabulary)

    def encode(self, text: str) -> bytes:
        if len(text) < AT_ONCE:
            return b"".join(map(self._known.__getitem__, self.pattern.findall(text)))
        found, out = self.pattern.finditer(text), []
        while part := [m.group() for m in islice(found, AT_ONCE)]:
            out.append(b"".join(map(self._known.__getitem__, part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        token, rows = self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(token, rows[i : i + AT_ONCE].tolist())) for i in range(0, len(rows), AT_ONCE))

    def settled(self, text: str) -> int:
        """How many characters of text belong to matches that no appended text can change.

        A match is settled if a character follows it and three follow its start: nothing in the pattern looks farther.
        """
        done = 0
        for m in self.pattern.finditer(text):
            if m.end() >= len(text) or m.start() + 3 > len(text):
                break
            done = m.end()
        return done

    def appended(self, text: str, ids: bytes, more: str) -> bytes:
        """The ids of text + more from those of text: only what isn't settled is encoded."""
        tail = text[-4 * SHORT :]  # matches begin alike behind a letter that a space follows
        cut = regex.search(r"(?r)(?<=\p{L})(?= \p{L})", tail[:-3])
        base = len(text) - len(tail) + cut.start() if cut else 0
        base += self.settled(text[base:])
        open_bytes, keep = len(text[base:].encode()), len(ids) // 4
        while open_bytes > 0:
            keep -= 1
            open_bytes -= len(self.vocabulary.token[int.from_bytes(ids[4 * keep : 4 * keep + 4], "little")])
        return ids[: 4 * keep] + self.encode(text[base:] + more)


class _Known(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        tokens = piece_tokens(self.vocabulary, piece.encode())
        ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(lines: bytes, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary, built once."""
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(lines, pattern)
    return _encoders[key]


def _mapped(df: DataFrame, columns: list, vocabulary_path: str, pattern: str, schema: str, row) -> DataFrame:
    """Rows through row(encoder, values) in slices of bounded size. The vocabulary, a file of fixed size, is read by the driver and broadcast."""
    with open(vocabulary_path, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())
    names = [c.split()[0] for c in schema.split(", ")]
    large = {"long": pa.int64(), "string": pa.string(), "binary": pa.large_binary()}
    kinds = [large[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(lines.value, pattern)
        for b in pieces(batches, 1):
            rows = [row(enc, *(c[i].as_py() for c in b.columns)) for i in range(b.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(pa.binary()) if k == large["binary"] else a for a, k in zip(arrays, kinds, strict=True)], names)

    return df.select(*columns).mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens and ids, 4 bytes a token (unsigned, little-endian).

    A null text is empty and has no tokens. Rows that repeat are encoded as often; other columns are ignored; an empty table gives an
    empty result. Texts of any length go through a bounded number of matches at a time.
    """
    row = lambda e, i, text: (i, len(x := e.encode(text)) // 4, x)
    return _mapped(docs, ["doc_id", F.coalesce("text", F.lit("")).alias("text")], vocabulary_path, pattern, "doc_id long, n_tokens long, ids binary", row)


def decoded(tokens: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per row of encoded(): doc_id and the bytes of its tokens."""
    return _mapped(tokens, ["doc_id", F.coalesce("ids", F.unhex(F.lit(""))).alias("ids")], vocabulary_path, pattern, "doc_id long, bytes binary", lambda e, i, ids: (i, e.decode(ids)))


def extended(tokens: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text, ids, more): doc_id, n_tokens and ids of text + more, worked out from those of text."""
    row = lambda e, i, text, ids, more: (i, len(x := e.appended(text, ids, more)) // 4, x)
    cols = ["doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ids", F.unhex(F.lit(""))).alias("ids"), F.coalesce("more", F.lit("")).alias("more")]
    return _mapped(tokens, cols, vocabulary_path, pattern, "doc_id long, n_tokens long, ids binary", row)


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the bytes that its ids decode to; see encoded()."""

    def row(e: Encoder, i: int, text: str) -> tuple:
        ids = e.encode(text)
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    return _mapped(docs, ["doc_id", F.coalesce("text", F.lit("")).alias("text")], vocabulary_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
