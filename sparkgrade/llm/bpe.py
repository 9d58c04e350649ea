"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The pattern always starts a match at a lone blank or line end between other characters, so
a text without runs of white space falls into pieces whose ids don't depend on their
neighbours. Each worker keeps the ids of the pieces and matches it has met (a bounded
memory) and gives new matches to the library; any other text is matched whole.
Decoding maps each token's characters back through the byte table; the bytes of a character
that two tokens share meet again when they are joined.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import return_memory, table

#: Pieces that a worker remembers at most; then it starts anew. Longer ones than PIECE characters aren't remembered.
MEMORY, PIECE = 200_000, 64
_OTHER_ASCII = tuple(map(chr, (0, 9, 11, 12, 13, 28, 29, 30, 31)))
_OTHER = (*_OTHER_ASCII, *map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


_NONE = np.zeros(0, dtype="<u4")


def _odd(text: str) -> bool:
    """Whether the text has white space at an end, in a run, or of another kind than blank and line end; or a NUL."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER))


def _gather(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that the codes name, joined, and where each ends. Run k follows run k - 1 in values."""
    starts = np.cumsum(lengths) - lengths
    of = lengths[codes]
    ends = np.cumsum(of)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[codes] - (ends - of), of)], ends


class _Matches(dict):
    """The ids of each match of the pattern that a worker has met: the library encodes its byte characters."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe

    def encoded(self, match: str) -> bytes:
        found = self.bpe.tokenize((match if match.isascii() else match.encode().decode("latin-1")).translate(self.bpe.characters))
        coded = self.bpe.coded
        return coded[found[0].id] if len(found) == 1 else b"".join([coded[t.id] for t in found])

    def __missing__(self, match: str) -> bytes:
        ids = self.encoded(match)
        if len(match) <= PIECE:
            self[match] = ids
        return ids


class _Pieces(_Matches):
    """The ids of each piece between white space that a worker has met; one that is a single match is remembered here alone."""

    def __missing__(self, piece: str) -> bytes:
        found = self.bpe.findall(piece)
        matches = self.bpe.matches
        ids = (matches.get(piece) or matches.encoded(piece)) if len(found) == 1 else b"".join(map(matches.__getitem__, found))
        if len(piece) <= PIECE:
            self[piece] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary from a file of the tokenizers library.

    The pattern is applied here; the library merges each new match, as byte characters.
    """

    def __init__(self, path: str, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.findall = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.characters = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.characters.items()}
        by_id = {i: t for t, i in self.library.get_vocab(with_added_tokens=False).items()}
        #: The bytes of each id; one that isn't of byte characters alone stands for no bytes.
        self.bytes = [bytes(back.get(c, 0) for c in by_id.get(i, "")) if back.keys() >= set(by_id.get(i, "")) else b"" for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes])
        #: The four bytes that each id is written as.
        self.coded = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.joined = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        #: A pattern of the added tokens, or None.
        self.added = "|".join(regex.escape(t.content, special_only=True) for t in self.library.get_added_tokens_decoder().values()) or None
        self.matches = _Matches(self)
        self.pieces = _Pieces(self)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Null or empty: none."""
        for memory in (self.matches, self.pieces):
            if len(memory) > MEMORY:
                memory.clear()
        strings = texts.to_pylist()
        out = [_NONE] * len(strings)
        even = []
        for i, text in enumerate(strings):
            if not text:
                continue
            if _odd(text):
                out[i] = np.frombuffer(b"".join(map(self.matches.__getitem__, self.findall(text))), dtype="<u4")
            else:
                even.append(i)
        if not even:
            return out
        cut = pc.replace_substring(pc.replace_substring(texts if len(even) == len(out) else texts.take(pa.array(even)), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        known = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        ids, ends = _gather(np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4, codes)
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        for i, a, b in zip(even, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return out

    def encode_added(self, texts: pa.Array) -> list[np.ndarray]:
        """As encode_all(), but with the library's added tokens (<|endoftext|>), as its own encode() has them without special tokens."""
        out = self.encode_all(texts)
        if self.added is not None:
            for i in np.flatnonzero(np.array(pc.fill_null(pc.match_substring_regex(texts, self.added), False))).tolist():
                out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.joined, self.lengths, ids)[0].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """(start, end) in code points of each token; a token within a character spans that character."""
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        lead = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)
        return np.stack([lead[starts] - 1, lead[ends - 1]], axis=1) if len(ends) else np.zeros((0, 2), dtype=np.int64)


_KEPT: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """The worker's copy of a vocabulary."""
    if path not in _KEPT:
        _KEPT[path] = ByteBpe(path)
    return _KEPT[path]


def _encoded(path: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for some in slices(batch):
                ids = bpe.encode_all(some.column(1))
                columns = {"doc_id": some.column(0), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}
                if offsets:
                    spans = [bpe.offsets(t or "", x) for t, x in zip(some.column(1).to_pylist(), ids, strict=True)]
                    for k, name in enumerate(("starts", "ends")):
                        columns[name] = pa.array([s[:, k] for s in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
        return_memory()

    return run


def slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of its second column, one row at least."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0))
    start, run = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(run, (run[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, path: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (and starts, ends in code points) of every text. Null and empty texts: no ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", starts array<bigint>, ends array<bigint>" if offsets else ""
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(_encoded(path, offsets), f"doc_id {kind}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of encode()'s rows; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            out = [None if x is None else bpe.decode(np.array(x, dtype="<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array(out, pa.binary())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every whole text, decodes the ids, and digests both.

    Null text: as empty. Null ids and repeated rows are kept. No rows: no rows. Other columns
    are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            return_memory()  # what the batch before and other stages have left in this worker
            for some in slices(batch):
                n, first, second = [], [], []
                for ids in bpe.encode_all(some.column(1)):
                    n.append(len(ids))
                    first.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": first, "decoded_sha256": second})
        return_memory()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The vocabulary of the queries: the same as byte_bpe_50k.tiktoken, in the tokenizers library's form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())
