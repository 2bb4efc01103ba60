"""Encoding with a byte-level BPE vocabulary by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. ``Prefixes`` keeps that last token for each
prefix, so the encoding of any prefix is read off backwards, bytes can be appended without starting over, and an edit
costs work only from the edited place on. A token may follow another exactly if the merges, run on the two together,
give the two back; that makes the table exact without running any merges over the whole string.

A text is first cut by the vocabulary's pattern; merges never cross such a cut. Pieces recur, so their ids are kept in
a bounded memory of each worker, which changes nothing but the time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries that a worker keeps of pieces, and half as many as of pairs of tokens.
MEMORY = 1 << 18
#: Characters of the pieces that a worker remembers.
LENGTH = 1 << 24


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


#: What stands before the first token, and where a token ends in the table of tokens.
START, END = 1 << 20, 256


class Vocabulary:
    """The ranks of a byte-level BPE vocabulary; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        #: Tokens by their bytes from the last to the first; a token's id stands under ``END``.
        self.ends: dict = {}
        for token, i in self.ranks.items():
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[END] = i
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges run over ``data``, the lowest rank first, the leftmost of equals, until ``least`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token, the last merge over its bytes; None for a byte and for a token
        that no merges make."""
        found = self.splits.get(token, False)
        if found is False:
            parts = self.merged(self.tokens[token], 2) if self.sizes[token] > 1 else []
            found = self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; START as ``left`` asks only whether merges make ``right``.

        The merges inside the two are undone, the latest first; if at any time the parts that meet would have been
        merged before the merge undone last, the merges would not have kept the two apart."""
        key = left << 20 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 2 * MEMORY:
                self.known.clear()
            found = self.known[key] = (self.sizes[right] == 1 or self.halves(right) is not None) and (left == START or self._apart(left, right))
        return found

    def _apart(self, left: int, right: int) -> bool:
        ranks, tokens, sizes, halves = self.ranks, self.tokens, self.sizes, self.halves
        limit = len(ranks)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            a, b = left if sizes[left] > 1 else -1, right if sizes[right] > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, halves(left)[1]
            else:  # of equal merges the left one comes first, so this one is undone first
                limit, right = b + 1, halves(right)[0]


class Prefixes:
    """A growing byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [START]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Lengthen the string; nothing before its old end is computed again."""
        v = self.vocabulary
        ends, sizes, known, fits = v.ends, v.sizes, v.known, v.fits
        start, last = len(self.data), self.last
        data = self.data = self.data + more
        for end in range(start + 1, len(data) + 1):
            # tokens that end here, the shortest first
            node, at, found = ends, end, []
            while at:
                at -= 1
                node = node.get(data[at])
                if node is None:
                    break
                token = node.get(END)
                if token is not None:
                    found.append(token)
            for token in reversed(found):
                before = last[end - sizes[token]]
                ok = known.get(before << 20 | token)
                if ok or ok is None and fits(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self

    def replace(self, start: int, stop: int, by: bytes) -> Prefixes:
        """Put ``by`` in the place of the bytes from ``start`` to ``stop``; the table before ``start`` is kept."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        return self.append(by + tail)

    def become(self, data: bytes) -> Prefixes:
        """Turn into another string; the table of the prefix that both have is kept."""
        shared = len(os.path.commonprefix([self.data, data]))
        self.data = data[:shared]
        del self.last[shared + 1 :]
        return self.append(data[shared:])

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, by default of all."""
        at, out = len(self.data) if end is None else end, []
        while at:
            token = self.last[at]
            out.append(token)
            at -= self.vocabulary.sizes[token]
        return out[::-1]


def plain_pattern(pattern: str) -> str:
    """The pattern with its properties of characters as ranges over the basic plane, told by the engine that knows them."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        runs: list[list[int]] = []
        for code in map(ord, regex.findall(name, every)):
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
        return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs)

    letters, numbers, blanks = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    # outside of a class a property becomes a class of its own
    own = {r"[^\s\p{L}\p{N}]": f"[^{blanks}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\S": f"[^{blanks}]", r"\s": f"[{blanks}]"}
    return re.sub("|".join(map(re.escape, own)), lambda m: own[m[0]], pattern)


class Encoder:
    """Encodes texts: cuts them by the pattern and encodes each piece by ``Prefixes``."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.vocabulary = Vocabulary(path)
        self.cut = regex.compile(pattern)
        self.plain = re.compile(plain_pattern(pattern)) if pattern == PATTERN else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.length = 0

    def _room(self, pieces: int, length: int) -> bool:
        """Whether so many new pieces of that length in all are kept beside the known ones, which else are forgotten."""
        if len(self.known) + pieces > MEMORY or self.length + length > LENGTH:
            self.known.clear()
            self.length = 0
            return False
        return True

    def pieces(self, text: str | None) -> list[str]:
        """What the pattern cuts a text into. Texts of the basic plane are cut by ranges of characters, which is faster."""
        if not text:
            return []
        if self.plain and len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.plain.findall(text)
        return self.cut.findall(text)

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = self.known.get(piece)
        if ids is None:
            self._room(1, len(piece))
            self.length += len(piece)
            ids = self.known[piece] = tuple(Prefixes(self.vocabulary, piece.encode()).ids())
        return ids

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of a text, piece by piece."""
        known, piece = self.known.get, self.piece
        return [known(x) or piece(x) for x in self.pieces(text)]

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """``parts`` of many texts: new pieces are sorted, and each goes on from the prefix it shares with the last."""
        rows, holes, new, get = [], [], set(), self.known.get
        for text in texts:
            cut = self.pieces(text)
            row = list(map(get, cut))
            gaps = [k for k, ids in enumerate(row) if ids is None]
            if gaps:
                holes.append((row, cut, gaps))
                new.update([cut[k] for k in gaps])
            rows.append(row)
        length = sum(map(len, new))
        self._room(len(new), length)
        self.length += length
        table = Prefixes(self.vocabulary)
        for data in sorted(x.encode() for x in new):
            self.known[data.decode()] = tuple(table.become(data).ids())
        for row, cut, gaps in holes:
            for k in gaps:
                row[k] = self.known[cut[k]]
        return rows

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or an empty one. Special tokens are plain text."""
        return list(chain.from_iterable(self.parts(text)))

    def count(self, text: str | None) -> int:
        """The number of ids of a text."""
        return sum(map(len, self.parts(text)))


class Document:
    """An encoded text that can be lengthened or edited; only pieces near the change are cut and encoded again.

    A piece depends on the characters in it and at most three after it ("'" and "r" become one piece when "e"
    follows), so pieces that end earlier than that before a change stay.
    """

    REACH = 3

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[tuple[int, ...]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> Document:
        """Lengthen the text."""
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, by: str) -> Document:
        """Put ``by`` in the place of the characters from ``start`` to ``stop``."""
        self.text = self.text[:start] + by + self.text[stop:]
        shift = len(by) - (stop - start)
        old_starts, old_pieces = self.starts, self.pieces
        keep = 0
        ends = [*old_starts[1:], len(self.text) - shift]
        while keep < len(old_starts) and ends[keep] + self.REACH <= start:
            keep += 1
        at = old_starts[keep] if keep < len(old_starts) else (ends[-1] if old_starts else 0)
        again = {x + shift: i for i, x in enumerate(old_starts) if x >= stop}
        starts, pieces = old_starts[:keep], old_pieces[:keep]
        for match in self.encoder.cut.finditer(self.text, at):
            if match.start() in again:  # from here on the text and so the cuts are as before
                i = again[match.start()]
                starts += [x + shift for x in old_starts[i:]]
                pieces += old_pieces[i:]
                break
            starts.append(match.start())
            x = match.group()
            pieces.append(self.encoder.piece(x))
        self.starts, self.pieces = starts, pieces
        return self

    def ids(self) -> list[int]:
        """The encoding of the text as it is."""
        return [i for piece in self.pieces for i in piece]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row: the ids of its text, an empty list for a null or empty text.

    Repeated rows give repeated rows; other columns are not read. No shuffle; the vocabulary is read by each worker
    from ``path``.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            names = batch.column(0)
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                lists = own.batch(texts.slice(at, 256).to_pylist())
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([sum(map(len, x)) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([names.slice(at, 256), ids], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens bigint) for every row, 0 for a null or empty text; as ``encode_texts``, without the ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = pa.array([sum(map(len, x)) for x in own.batch(part.column(1).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], names=[id_col, "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
