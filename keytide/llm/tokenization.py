"""Token ids of a corpus by public tokenizers, with offsets, and text back from ids.

Texts go through the tokenizers library in Arrow batches. For a byte-level tokenizer the
text is cut at single spaces between printable ASCII characters: the tokenizer's own
pattern always cuts there, whatever surrounds it, so the ids of the pieces, put together, are
those of the whole. Each different piece is encoded once per task and its ids are kept as bytes, ready
for Arrow.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
#: Pieces kept per task, and the longest piece that is kept.
PIECES_KEPT, LONGEST_KEPT = 500_000, 64
_CUT = re.compile(r" (?<=[!-~] )(?=[!-~])")
#: Within a piece of printable ASCII and line ends, without apostrophes, the pattern also cuts where
#: the kind of character changes, and before the last of several line ends.
_PLAIN = re.compile(r"[!-&(-~\r\n]*[!-&(-~]")
_RUNS = re.compile(r" ?(?:[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+)|[\r\n]+(?=[\r\n])|[\r\n]")


#: Where byte-pair vocabularies given as ranks cut a text (fixed value).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=8)
def load_tokenizer(name: str, directory: str = TOKENIZER_DIR):
    """A tokenizer of the tokenizers library; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    path = Path(directory, f"{name}.json")
    if not path.exists():
        raise ValueError(f"{path} does not exist")
    tokenizer = Tokenizer.from_file(str(path))
    tokenizer.encode_special_tokens = True
    return tokenizer


def encode_whole(name: str, directory: str = TOKENIZER_DIR) -> Callable[[str], list[int]]:
    """A function that gives a text's ids, without special tokens, by the file of that name: ``.json`` of the tokenizers library, else
    ``.tiktoken`` ranks, else a ``.model`` of sentencepiece."""
    if Path(directory, f"{name}.json").exists():
        tokenizer = load_tokenizer(name, directory)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if (path := Path(directory, f"{name}.tiktoken")).exists():
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(name, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary
    if (path := Path(directory, f"{name}.model")).exists():
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=str(path))
        return lambda text: processor.encode(text, num_threads=1)
    raise ValueError(f"no tokenizer {name} in {directory}: it does not exist")


def is_byte_level(tokenizer) -> bool:
    """Whether ids stand for bytes of the unchanged text, cut by the pattern that pieces rely on."""
    pre = tokenizer.pre_tokenizer
    return type(pre).__name__ == "ByteLevel" and tokenizer.normalizer is None and pre.use_regex and not pre.add_prefix_space


class _Pieces(dict):
    """Ids of pieces, as bytes of little-endian 32-bit integers."""

    def __init__(self, tokenizer, before: str, runs: _Pieces | None = None):
        super().__init__()
        self.tokenizer, self.before, self.runs = tokenizer, before, self if runs is None else runs

    def _encode(self, whole: str) -> bytes:
        return np.asarray(self.tokenizer.encode(whole, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        whole = self.before + piece
        runs = _RUNS.findall(whole) if _PLAIN.fullmatch(piece) else [whole]
        blob = b"".join(map(self.runs.__getitem__, runs)) if len(runs) > 1 else self._encode(whole)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = blob
        return blob


class Encoder:
    """Text to ids, as bytes of 32-bit integers; null and empty texts have none."""

    def __init__(self, name: str, directory: str = TOKENIZER_DIR):
        self.whole = encode_whole(name, directory)
        self.tokenizer = load_tokenizer(name, directory) if Path(directory, f"{name}.json").exists() else None
        self.by_piece = self.tokenizer is not None and is_byte_level(self.tokenizer)
        self.first = _Pieces(self.tokenizer, "")
        self.rest = _Pieces(self.tokenizer, " ", self.first)

    def blob(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return np.asarray(self.whole(text), dtype="<i4").tobytes()
        head, *tail = _CUT.split(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail)) if tail else self.first[head]

    def n(self, text: str | None) -> int:
        return len(self.blob(text)) // 4

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.blob(text), dtype="<i4").tolist()


@lru_cache(maxsize=8)
def encoder_of(name: str, directory: str = TOKENIZER_DIR) -> Encoder:
    """The process's encoder: a Python worker keeps its pieces from task to task."""
    return Encoder(name, directory)


def _as_lists(blobs: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int64)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(blobs))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _each_batch(run: Callable[[list[str | None]], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: the first column passes, ``run`` makes the others from the second's texts."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), *run(part.column(1).to_pylist())], names=names)

    return over


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids): the ids of every text, unchanged and without special tokens.

    A null and an empty text have the empty list. Rows repeat and keep null ids as the
    input does; other columns do not pass. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, directory)
        yield from _each_batch(lambda texts: [_as_lists([encoder.blob(t) for t in texts])], [id_col, "ids"])(batches)

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(documents.dtypes)[id_col]}, ids array<int>")


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, n_tokens): how many ids ``encode_corpus`` gives; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, directory)
        yield from _each_batch(lambda texts: [pa.array([encoder.n(t) for t in texts], pa.int32())], [id_col, "n_tokens"])(batches)

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(documents.dtypes)[id_col]}, n_tokens int")


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable bytes for
    themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def bytes_of_ids(name: str, directory: str = TOKENIZER_DIR) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer; those of special tokens are their strings'."""
    tokenizer, table = load_tokenizer(name, directory), byte_of_character()
    if not is_byte_level(tokenizer):
        raise ValueError(f"{name} is not a byte-level tokenizer")
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def offsets_of(ids: list[int], text: str, table: list[bytes]) -> tuple[list[int], list[int]]:
    """First character and character after the last of every id's bytes in ``text``.

    Ids that split a character all hold it in their range, so ranges can share a character.
    """
    if not ids:
        return [], []
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum([len(table[i]) for i in ids])
    starts = np.concatenate([[0], ends[:-1]])
    return char_at[starts].tolist(), (char_at[ends - 1] + 1).tolist()


def encode_with_offsets(documents: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids, starts, ends): ids and the characters of the text each of them covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = encoder_of(tokenizer, directory), bytes_of_ids(tokenizer, directory)

        def of(texts: list[str | None]) -> list[pa.Array]:
            ids = [encoder.ids(t) for t in texts]
            spans = [offsets_of(i, t or "", table) for i, t in zip(ids, texts, strict=True)]
            lists = pa.list_(pa.int32())
            return [pa.array(ids, lists), pa.array([s for s, _ in spans], lists), pa.array([e for _, e in spans], lists)]

        yield from _each_batch(of, [id_col, "ids", "starts", "ends"])(batches)

    schema = f"`{id_col}` {dict(documents.dtypes)[id_col]}, ids array<int>, starts array<int>, ends array<int>"
    return documents.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """Text of ids: bytes are joined before they are read as characters, so that characters
    split between ids come back; what is cut off at an end becomes U+FFFD."""
    return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")


def decode_corpus(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", ids_col: str = "ids", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, text) of lists of ids; an empty or null list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of_ids(tokenizer, directory)
        yield from _each_batch(lambda lists: [pa.array([decode_ids(i or [], table) for i in lists], pa.string())], [id_col, "text"])(batches)

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")
