"""Byte-pair encoding by longest matches and backtracking; decoding by an offset table.

A text is first cut into the pieces of the byte-level pre-tokenizer. Inside a
piece, one Aho-Corasick pass finds the longest vocabulary token that starts at
every byte. The encoder takes these from left to right. A token may follow the
one before it only if the pair is *compatible*: merging the bytes of both gives
just these two tokens. Where a token doesn't fit, the next shorter token that is
a prefix of it is tried, and where none is left, the token before is given up and
the place closed for good, so each place is closed once and the time stays
linear. A sequence whose neighbours are all compatible is the one that merging by
rank produces.

Defined results: a NULL text is an empty one and has no ids. Repeated rows, ties
and empty tables need no care, as each row stands alone. An input column named
like an output column gives way to it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from condense.llm.rows import field, map_texts

#: The pre-tokenizer of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded chunks remembered per worker. Only speed depends on these bounds.
CHUNKS, WORDS, PAIRS = 300_000, 100_000, 500_000

_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level BPE vocabulary in the JSON form of ``tokenizers``."""

    def __init__(self, source: str):
        said = json.loads(source)
        table, back = said["model"], byte_of_char()
        count = 1 + max([*table["vocab"].values(), *(t["id"] for t in said.get("added_tokens") or [])])
        self.bytes: list[bytes] = [b""] * count
        for token, i in table["vocab"].items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        self.added = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.size = [len(b) for b in self.bytes]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in table["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = table["vocab"][a], table["vocab"][b]
            whole = table["vocab"][a + b]
            self.merged[left, right] = whole
            self.halves.setdefault(whole, (left, right))
        self.shorter = [-1] * count
        for token, i in self.ids.items():
            self.shorter[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.split_added = re.compile("|".join(f"({re.escape(c)})" for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split_pieces = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)
        self.packed = [i.to_bytes(4, "little") for i in range(count)]
        lengths = np.array(self.size, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge of lower rank reaches over the border between ``a`` and ``b``."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, latest first. Before each undone merge, the parts
        # at the border must not have had a merge that comes earlier than what was undone.
        limit = 1 << 62
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            undo_left = a in self.halves and (b not in self.halves or a > b)
            if not undo_left and b not in self.halves:
                return True
            if undo_left:
                limit, a = a, self.halves[a][1]
            else:  # at equal ranks the left one is merged first, so a join of this very rank comes first too
                limit, b = b + 1, self.halves[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(piece), self.size, self.shorter, self.pairs.get
        longest = [-1] * (n + 1)
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends rise, so the last one written is the longest
        open_at = bytearray(b"\1") * (n + 1)
        made: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = made[-1] if made else -1
            while token >= 0:
                if open_at[at + size[token]]:
                    if last < 0 or (fits := known((last, token))):
                        break
                    if fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                made.append(token)
                at += size[token]
                token = longest[at]
            else:
                open_at[at] = 0
                token = made.pop()
                at -= size[token]
        return made

    def _packed(self, piece: str) -> bytes:
        return b"".join([self.packed[i] for i in self.encode_piece(piece.encode())])

    def _encode_run(self, run: str) -> bytes:
        if run[1:].isalpha() and run[0] == " ":  # one pre-token
            return self._packed(run)
        out = []
        for word in self.split_pieces(run):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= WORDS:
                    self.words.clear()
                ids = self.words[word] = self._packed(word)
            out.append(ids)
        return b"".join(out)

    def _encode_plain(self, text: str) -> bytes:
        # A blank between two other characters always starts a pre-token: cut there, remember the chunks.
        first, *rest = text.split(" ")
        try:
            if first == "" or first[0].isspace() or first[-1].isspace():
                raise TypeError
            return self._encode_run(first) + b"".join(map(self.chunks.__getitem__, rest))
        except TypeError:  # blanks side by side somewhere
            first, *rest = _INNER_BLANK.split(text)
            return self._encode_run(first) + b"".join(self._encode_run(" " + r) for r in rest)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; added tokens in it count as such."""
        if self.split_added is None or not self.split_added.search(text):
            return self._encode_plain(text) if text else b""
        out = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self._encode_plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: each one's bytes lie between two offsets of one table."""
        at = np.frombuffer(ids, dtype="<u4")
        if not len(at):
            return ""
        starts = self.offsets[at]
        sizes = self.offsets[at + 1] - starts
        ends = np.cumsum(sizes)
        place = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[place].tobytes().decode("utf-8", errors="replace")


class _Chunks(dict):
    """Ids of " " + chunk; None for a chunk that can't be encoded apart from its neighbours."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= CHUNKS:
            self.clear()
        apart = chunk != "" and not chunk[0].isspace() and not chunk[-1].isspace()
        ids = self[chunk] = self.vocabulary._encode_run(" " + chunk) if apart else None
        return ids


@lru_cache(maxsize=2)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32 bit) for ``text``; ``keep`` names the columns to carry along.

    The vocabulary file is read by the driver and sent to the tasks (some MB, whatever the data).
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        known = vocabulary(sent.value)
        return lambda texts: [[known.encode(t) for t in texts]]

    return map_texts(df, text, df.columns if keep is None else keep, [field(ids, "binary")], make)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``text`` for ``ids`` as made by :func:`encode`; NULL ids give an empty text."""
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        known = vocabulary(sent.value)
        return lambda rows: [[known.decode(r or b"") for r in rows]]

    return map_texts(df, ids, df.columns if keep is None else keep, [field(text, "string")], make)
