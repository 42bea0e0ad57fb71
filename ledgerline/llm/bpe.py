"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Texts given to the library at once hold about so many characters, whatever the batch's size.
CHARS = 1 << 20

#: Bytes of text whose results make one batch, whatever the size of the batch they came in.
PIECE = 1 << 21

#: Encoded pieces a worker keeps before it starts afresh.
KEPT = 400_000

#: The pattern under which words after single spaces are cut off before the pattern itself runs.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte, by byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, take the
    characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of several bytes is merged from, in order of rank.

    The pair is what remains of the token's bytes after all merges of lower rank.
    """
    found = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


class Codec:
    """Encoder and decoder for one rank file; built once in each worker.

    The library merges the pieces that the pattern cuts out, spelled in one
    character per byte.  Texts repeat their words, so the ids of those met are
    kept, up to ``KEPT``, as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        characters = byte_characters()
        self.spelling = dict(enumerate(characters))

        def spelled(token: bytes) -> str:
            return "".join(characters[b] for b in token)

        model = models.BPE(
            vocab={spelled(token): rank for token, rank in ranks.items()},
            merges=[(spelled(a), spelled(b)) for a, b in merges(ranks)],
            cache_capacity=0,
        )
        self.tokenizer = Tokenizer(model)
        self.pattern = regex.compile(pattern)
        # Only under the usual pattern does a word after a single space stand for itself.
        self.by_space = pattern == SPACED
        back = {c: b for b, c in enumerate(characters)}
        self.bytes_of = np.full(max(ranks.values(), default=-1) + 1, b"", object)
        for token, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces not met before, in one call of the library."""
        new = [p for p in set(pieces) if p not in self.pieces]
        raw = [p.encode().decode("latin-1").translate(self.spelling) for p in new]
        for piece, one in zip(new, self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)):
            self.pieces[piece] = array("I", one.ids).tobytes()

    def _by_words(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text cut before single spaces; None for one with more white space there.

        A word is safe to cut off if neither it nor its neighbours begin or end
        with white space: the space then always starts a new piece.  Words are
        kept without the space that leads them; a text's first word, which has
        none, is kept behind a space.
        """
        cut = [text.split(" ") for text in texts]
        for words in cut:
            words[0] = " " + words[0]
        known = self.words
        new = {}
        for word in set(chain.from_iterable(cut)):
            if word not in known:
                first = word[:1] == " "
                bare = word[1:] if first else word
                unit = bare if first else " " + word
                safe = bare and not bare[0].isspace() and not bare[-1].isspace()
                new[word] = self.pattern.findall(unit) if safe else None
        self._learn(chain.from_iterable(filter(None, new.values())))
        pieces = self.pieces
        for word, parts in new.items():
            known[word] = None if parts is None else b"".join([pieces[p] for p in parts])
        out = []
        for words in cut:
            found = [known[w] for w in words]
            out.append(None if None in found else b"".join(found))
        return out

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(text) for text in texts]
        self._learn(chain.from_iterable(cut))
        return [b"".join([self.pieces[p] for p in parts]) for parts in cut]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self._by_words(texts) if self.by_space else [None] * len(texts)
        left = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(left, self._by_pattern([texts[i] for i in left])):
            found[i] = ids
        if len(self.pieces) + len(self.words) > KEPT:
            self.pieces, self.words = {}, {}
        return found

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in the text, in characters.

        A character of several bytes may be split among tokens; each of them
        has the whole character in its span.
        """
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[ends - self.lengths[ids]], character[ends - 1] + 1

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        start = 0
        while start < len(texts):
            end, chars = start + 1, len(texts[start])
            while end < len(texts) and chars + len(texts[end]) <= CHARS:
                chars += len(texts[end])
                end += 1
            for ids in self._ids(texts[start:end]):
                yield np.frombuffer(ids, "<u4")
            start = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes of ``ids``, which need not end at a character's end."""
        return b"".join(self.bytes_of[ids].tolist())


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``PIECE`` bytes of text; a longer text is a run of its own.

    Ids take several times the room of their text, so a worker holds those of one run only.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // PIECE
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for first, last in zip(edges, edges[1:]):
            if first < last:
                yield batch.slice(first, last - first)


def _lists(each: list[np.ndarray], to: type) -> pa.Array:
    """A list of numbers of type ``to`` for each array."""
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, np.concatenate([np.empty(0, to), *each], dtype=to, casting="same_kind"))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def _append(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    kept = [(n, batch.column(n)) for n in batch.schema.names if n != drop and n not in columns]
    kept += list(columns.items())
    return pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])


def _schema(df: DataFrame, drop: str, added: dict[str, str]) -> str:
    kept = [f for f in df.schema.fields if f.name != drop and f.name not in added]
    parts = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return ", ".join(parts + [f"`{n}` {t}" for n, t in added.items()])


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """``df`` with its texts replaced by token ids, spans and their number.

    Adds ids array<bigint>, n_tokens long and, with ``offsets``, begins and ends
    array<int> in characters of the text; columns already so named are replaced.
    Whole texts are encoded; null and empty texts have no tokens; strings of
    special tokens are ordinary text.
    """
    added = {"ids": "array<bigint>"} | ({"begins": "array<int>", "ends": "array<int>"} if offsets else {})
    added |= {"n_tokens": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in _pieces(batches, text):
            ids, begins, ends = [], [], []
            texts = _texts(batch, text)
            for t, found in zip(texts, coder.encode(texts)):
                ids.append(found)
                if offsets:
                    spans = coder.spans(t, found)
                    begins.append(spans[0])
                    ends.append(spans[1])
            new = {"ids": _lists(ids, np.int64)}
            if offsets:
                new["begins"], new["ends"] = _lists(begins, np.int32), _lists(ends, np.int32)
            new["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
            yield _append(batch, text, **new)

    return df.mapInArrow(run, _schema(df, text, added))


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with its ids replaced by the bytes they stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            found = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield _append(batch, ids, **{to: pa.array(found, pa.binary())})

    return df.mapInArrow(run, _schema(df, ids, {to: "binary"}))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with its texts replaced by n_tokens and the SHA-256 of ids and of the decoded bytes.

    Encoding and decoding run in one pass, so the ids of a corpus needn't be kept to check it.
    """
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in _pieces(batches, text):
            rows = [
                (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest())
                for ids in coder.encode(_texts(batch, text))
            ]
            columns = list(zip(*rows)) or [(), (), ()]
            yield _append(
                batch,
                text,
                n_tokens=pa.array(columns[0], pa.int64()),
                ids_sha256=pa.array(columns[1], pa.string()),
                decoded_sha256=pa.array(columns[2], pa.string()),
            )

    return df.mapInArrow(run, _schema(df, text, added))
