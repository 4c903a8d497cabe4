"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1.  Every task cuts its texts into pre-tokens and explodes them, word by word: a block
    of documents becomes its distinct words, each with the positions it stands at
    (kept as one column of word codes per block, most frequent word first).
2.  The words are dealt out by their hash, bundled per block and bucket.  All
    occurrences of a word meet in one bucket, where it is encoded once.
3.  Ids go back to their block and join its positions; each document is reassembled
    by position.  Decoding joins the token-byte table to the ids.

Words and positions travel as compressed columns, a few rows for each block, so neither
the shuffle nor the JVM sees a row for each token.  Memory is bounded: a block has
:data:`BLOCK_TOKENS` tokens or :data:`BLOCK_BYTES` bytes of text at most (or one document).
A task reads its buckets one after another and keeps the ids of one bucket's words, at most
:data:`KNOWN_WORDS`; beyond that it starts anew and may encode a word twice.  There are as
many buckets as shuffle partitions and, for the positions, tasks by the size of the input.

Blocks are numbered within the input partitions, so the input must come in the same
order if a task runs again: a file scan or a written table does.

Edge cases: null and empty texts have no tokens; very long texts are blocks of their
own; repeated rows are encoded as often as they occur; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import short_batches, size_of, texts_of, tidy

#: A block ends after so many tokens, or bytes of text.
BLOCK_TOKENS, BLOCK_BYTES = 1 << 21, 16 << 20
#: A task of a shuffle serves about so many bytes of the input, and there are so many tasks at most.
TASK_BYTES, TASKS = 1 << 20, 1 << 15
#: Words of a bucket whose ids are kept.
KNOWN_WORDS = 500_000
#: Hash classes of words, at least.
BUCKETS = 64

# For texts without characters from U+0250 on, the pre-token pattern in plain classes;
# Python's \s takes U+001C to U+001F for white space, so the classes are written out.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_WIDE = re.compile("[ɐ-\U0010ffff]")
_PLAIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class PreTokens:
    """Matches of the pre-token pattern."""

    def __init__(self, pattern: str) -> None:
        import public_tokenizers
        import regex

        self.general = regex.compile(pattern)
        self.plain = re.compile(_PLAIN) if pattern == public_tokenizers.PATTERN else None

    def __call__(self, text: str) -> list[str]:
        if self.plain and (text.isascii() or not _WIDE.search(text)):
            return self.plain.findall(text)
        return [m.group() for m in self.general.finditer(text)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(1)
def _decoding(path: str) -> dict[int, bytes]:
    """Rank to token bytes; kept by a worker from task to task."""
    return {i: w for w, i in read_ranks(path).items()}


@lru_cache(1)
def _encoding(path: str):
    """The encoding of single words, which are pre-tokens already and taken whole; kept likewise."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _squeeze(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 32-bit values, byte plane by byte plane."""
    return _squeeze(values.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width].tobytes())


def _values(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(_expand(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 4), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u4").ravel()


#: Ranks below the first bound take one byte, up to the second two, up to the third three, and five beyond.
_ONE, _TWO = 176, 176 + 64 * 256
_THREE = _TWO + 15 * 65536


def _ranks(r: np.ndarray) -> bytes:
    """Numbers that are mostly small: first bytes, then what is left of each length, plane by plane."""
    r = r.astype(np.int64)
    first = np.select([r < _ONE, r < _TWO, r < _THREE], [r, _ONE + (r - _ONE >> 8), 240 + (r - _TWO >> 16)], 255).astype(np.uint8)
    two, three, five = r[(r >= _ONE) & (r < _TWO)] - _ONE, r[(r >= _TWO) & (r < _THREE)] - _TWO, r[r >= _THREE]
    planes = [first, two & 255, three & 255, three >> 8 & 255, *(five >> k & 255 for k in (0, 8, 16, 24))]
    data = [_squeeze(x.astype(np.uint8).tobytes(), 3) for x in planes]
    return np.array([len(x) for x in data], dtype="<u8").tobytes() + b"".join(data)


def _from_ranks(data: bytes) -> np.ndarray:
    ends = 64 + np.cumsum(np.frombuffer(data[:64], dtype="<u8").astype(np.int64))
    first, two, low, high, *five = (np.frombuffer(_expand(data[a:b]), dtype=np.uint8).astype(np.int64) for a, b in zip([64, *ends[:-1].tolist()], ends.tolist(), strict=True))
    out = first.copy()
    k = (first >= _ONE) & (first < 240)
    out[k] = _ONE + (first[k] - _ONE << 8) + two
    k = (first >= 240) & (first < 255)
    out[k] = _TWO + (first[k] - 240 << 16) + low + (high << 8)
    out[first == 255] = sum(x << 8 * n for n, x in enumerate(five))
    return out


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _unpair(data: bytes) -> tuple[bytes, bytes]:
    size = 4 + int.from_bytes(data[:4], "little")
    return data[4:size], data[size:]


def _int_list(values: list[int]) -> bytes:
    return _squeeze(np.array(values, dtype="<i8").tobytes())


def _explode(pattern: str, block_tokens: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, bucket, kind, a, b): for bucket -1 the documents and positions of a block, else its words of that bucket."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, block = PreTokens(pattern), TaskContext.get().partitionId() << 32
        codes, docs, positions, held, size = _Codes(), [], [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            seq = np.concatenate(positions) if positions else np.empty(0, dtype=np.uint32)
            words = list(codes)
            order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable") if words else np.empty(0, dtype=np.int64)
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order))
            encoded = [words[k].encode() for k in order]
            bucket = np.array([zlib.crc32(w) % buckets for w in encoded], dtype=np.int64)
            rows = [(block, -1, -1 - (block >> 32) * 1009 - (block & 0xFFFFFFFF), _int_list([x for d in docs for x in d]), _ranks(rank[seq] if len(seq) else seq))]
            for k in np.unique(bucket):
                mine = np.flatnonzero(bucket == k)
                own = [encoded[i] for i in mine]
                rows.append((block, int(k), int(k), _planes(np.diff(mine, prepend=0), 4), _pair(_planes(np.array([len(w) for w in own]), 4), _squeeze(b"".join(own)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], type=t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "bucket", "deal", "a", "b"])

        for batch in found:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                tokens = cut(text)
                docs.append((0 if doc_id is None else doc_id, doc_id is None, len(tokens)))
                positions.append(np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
                held, size = held + len(tokens), size + len(text)
                if held >= block_tokens or size >= BLOCK_BYTES:
                    yield from close()
                    codes, docs, positions, held, size, block = _Codes(), [], [], 0, 0, block + 1
        if docs:
            yield from close()

    return run


def _encode(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket: its words to ids, each distinct word once; other rows pass."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        known: dict[bytes, np.ndarray] = {}
        at = None
        for batch in found:
            buckets, a, b = batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, bucket in enumerate(buckets):
                if bucket < 0:
                    continue
                if bucket != at or len(known) > KNOWN_WORDS:
                    known.clear()
                    at = bucket
                sizes, data = _unpair(b[i])
                sizes, data = _values(sizes, 4), _expand(data)
                ends = np.cumsum(sizes)
                ids = []
                for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    word = data[s:e]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encoding.encode_ordinary(word.decode()), dtype="<u4")
                    ids.append(got)
                flat = np.concatenate(ids)
                b[i] = _pair(_planes(np.array([len(x) for x in ids]), 3), _planes(flat, 3))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], names=["block", "bucket", "a", "b"])

    return run


def _reassemble(vocabulary: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (block, bucket): the block's positions, then its words with their ids."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _decoding(vocabulary)

        def close(head: tuple[bytes, bytes], words: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            docs = np.frombuffer(_expand(head[0]), dtype="<i8").reshape(-1, 3)
            index, counts, flat = [], [], []
            for a, b in words:
                index.append(np.cumsum(_values(a, 4)))
                count, ids = _unpair(b)
                counts.append(_values(count, 3))
                flat.append(_values(ids, 3))
            n_words = sum(map(len, index))
            decimal: list[bytes] = [b""] * n_words
            decoded: list[bytes] = [b""] * n_words
            n_ids = np.zeros(n_words, dtype=np.int64)
            own: list[list[int]] = [[]] * n_words
            for where, count, ids in zip(index, counts, flat, strict=True):
                n_ids[where] = count
                listed, at = ids.tolist(), 0
                for w, c in zip(where.tolist(), count.tolist(), strict=True):
                    part = listed[at : at + c]
                    at += c
                    decimal[w] = b"%s," % ",".join(map(str, part)).encode()
                    decoded[w] = b"".join([table[x] for x in part])
                    if with_ids:
                        own[w] = part
            seq = _from_ranks(head[1])
            n_tokens, id_sha, text_sha, all_ids = [], [], [], []
            at = 0
            for count in docs[:, 2].tolist():
                part = seq[at : at + count]
                at += count
                listed = part.tolist()
                n_tokens.append(int(n_ids[part].sum()))
                id_sha.append(hashlib.sha256(b"".join(map(decimal.__getitem__, listed))[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(decoded.__getitem__, listed))).hexdigest())
                if with_ids:
                    all_ids.append([x for w in listed for x in own[w]])
            out = [pa.array(docs[:, 0], mask=docs[:, 1] > 0), pa.array(n_tokens, type=pa.int64()), pa.array(id_sha, type=pa.string()), pa.array(text_sha, type=pa.string())]
            if with_ids:
                out.append(pa.array(all_ids, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

        at, head, words = None, None, []
        for batch in found:
            for block, bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "a", "b")), strict=True):
                if bucket < 0:
                    if head:
                        yield from close(head, words)
                    at, head, words = block, (a, b), []
                elif block == at:
                    words.append((a, b))
        if head:
            yield from close(head, words)

    return run


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and ``ids``) of whole texts.

    ``vocabulary`` names a file of base64 tokens with their ranks that every worker has.
    """
    short_batches(docs.sparkSession)
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(buckets, min(TASKS, size_of(docs) // TASK_BYTES))
    exploded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_explode(pattern, block_tokens, buckets)), "block long, bucket int, deal long, a binary, b binary")
    ids = exploded.repartition(parts, "deal").sortWithinPartitions("deal").mapInArrow(tidy(_encode(vocabulary)), "block long, bucket int, a binary, b binary")
    blocks = ids.repartition(parts, "block").sortWithinPartitions("block", "bucket")
    return blocks.mapInArrow(tidy(_reassemble(vocabulary, with_ids)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
