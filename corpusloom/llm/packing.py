"""Packing: concatenate and cut.

Pass one tokenises each document once and stores its ids with the token offset inside
its partition; the totals of the partitions (one number each) give every partition's
global offset by a prefix sum.  Pass two is a narrow map: a document's global offset
tells which fixed windows of ``length`` tokens it meets, and it emits one boundary
record for each.  No shuffle of tokens, no sort, and only the last window is not full.

Tokenising goes word by word: the vocabulary's pre-tokens never hold white space, so
the ids of a text are the ids of its white-space pieces in turn.  Arrow splits a batch
and numbers its distinct pieces; each piece is encoded once per worker (the table of
pieces is emptied at a bound, so memory does not grow with the corpus), and the ids are
gathered by number.  Texts beyond Latin-1 take a plainer path with the same ids.

Edge cases: a null or empty text has only the end id; a document longer than a window
is cut as often as needed; repeated rows are packed as often as they occur; an empty
table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, tidy, write_table

#: Pieces of text kept by a worker; beyond it the table starts anew.
PIECES = 200_000
#: Bytes of text that are split at once.
SLICE = 4 << 20
#: Texts with characters beyond Latin-1, or with those that the tokenizer takes for marks and others for white space.
_SLOW = "[^\\x00-\\x1b\\x20-\\x{ff}]"
_ODD = "\x1c\x1d\x1e\x1f"
#: A mark before a comma or full stop that ends a piece: they are one pre-token then.
_MARKS = "[^ \\n\\pL\\pN][.,]([\\s\\x0b\\x{85}\\x{a0}]|$)"


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 16-bit numbers."""

    def __init__(self, vocabulary: str, pieces: int = PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.pieces = pieces
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit 16 bits")

    def _bytes(self, ids: list[int]) -> bytes:
        x = array("H", ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def _learn(self, new: list[str]) -> None:
        if len(self.known) > self.pieces:
            self.known.clear()
        known, rest = self.known, []
        for w in new:
            if w.isascii() and w.isalpha() and w.islower():  # one pre-token that nothing normalises
                known[w] = self._bytes([t.id for t in self.model.tokenize(w)])
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = self._bytes(e.ids)

    def pieces_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        self._learn(new)
        get = self.known.get
        return [get(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encode(self, text: str) -> bytes:
        """One text of any characters."""
        if any(c in text for c in _ODD):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split()
        distinct = list(dict.fromkeys(words))
        return b"".join(map(dict(zip(distinct, self.pieces_of(distinct), strict=True)).__getitem__, words))

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        slow = pc.match_substring_regex(texts, _SLOW)
        if pc.any(slow).as_py():
            out = [self.encode(t) if s else b"" for t, s in zip(texts.to_pylist(), slow.to_pylist(), strict=True)]
            where = np.flatnonzero(~slow.to_numpy(zero_copy_only=False))
            for k, ids in zip(where.tolist(), self._encode_latin(texts.filter(pc.invert(slow))), strict=True):
                out[k] = ids
            return out
        return self._encode_latin(texts)

    def _encode_latin(self, texts: pa.StringArray) -> list[bytes]:
        if not len(texts):
            return []
        low = pc.utf8_lower(texts)
        apart = low
        for mark, by in ((", ", " , "), (". ", " . "), (".\n", " .\n"), (",\n", " ,\n")):
            apart = pc.replace_substring(apart, mark, by)
        apart = pc.if_else(pc.match_substring_regex(low, _MARKS), low, apart)
        # white space at an end makes empty pieces; "" has no ids
        lists = pc.utf8_split_whitespace(apart)
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        pieces = self.pieces_of(coded.dictionary.to_pylist())
        sizes = np.array([len(x) // 2 for x in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype="<u2")
        index = coded.indices.to_numpy()
        n = sizes[index]
        after = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[index] - (after - n)
        at = np.repeat(shift.astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at].tobytes()
        bounds = 2 * np.concatenate([[0], after])[ends - ends[0]]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _tokens(vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, offset = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], dtype="<u2").tobytes()
        for batch in found:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for at, to in _slices(texts, SLICE):
                coded = [x + tail for x in encoder.encode_all(texts.slice(at, to - at))]
                n = np.array([len(x) // 2 for x in coded], dtype=np.int64)
                starts = offset + np.cumsum(n) - n
                offset += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(starts), pa.array(n), pa.array(coded, type=pa.binary())], names=["doc_id", "part", "first", "n", "ids"])

    return run


def _pieces(length: int, bases: dict[int, int], total: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", *(["ids"] if with_ids else [])]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n = batch.column("n").to_numpy()
            first = batch.column("first").to_numpy() + np.array([bases[x] for x in batch.column("part").to_pylist()], dtype=np.int64)
            window = first // length
            count = (first + n - 1) // length - window + 1
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = window[row] + nth
            lo = np.maximum(first[row], sequence * length)
            hi = np.minimum(first[row] + n[row], (sequence + 1) * length)
            start = lo - first[row]
            ids = batch.column("ids").to_pylist()
            crc, parts = np.empty(len(row), dtype=np.int64), []
            at = 0
            for i, k in enumerate(count):
                whole = np.frombuffer(ids[i], dtype="<u2").astype("<u4")
                for _ in range(k):
                    piece = whole[start[at] : start[at] + hi[at] - lo[at]]
                    crc[at] = zlib.crc32(piece)
                    if with_ids:
                        parts.append(piece)
                    at += 1
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(crc), pa.array(n[row]), pa.array(sequence), pa.array(lo - sequence * length), pa.array(np.minimum(length, total - sequence * length))]
            if with_ids:
                out.append(pa.array(parts, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of the fixed windows cut from all documents' tokens laid end to end.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    sequence_tokens (tokens in the window; the rest of the last one is padding);
    ``with_ids`` adds the ids themselves.  The token table lies in the shared folder;
    what reaches the driver is one total for each of its partitions.
    """
    short_batches(docs.sparkSession)
    coded, _ = write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_tokens(vocabulary, end_id)), "doc_id long, part int, first long, n long, ids binary"), "tokens")
    bases, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in coded.groupBy("part").agg(F.sum("n")).collect()):
        bases[part], total = total, total + n
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long" + (", ids array<int>" if with_ids else "")
    return coded.mapInArrow(tidy(_pieces(length, bases, total, with_ids)), schema)
