"""Near-duplicates by SimHash with anchor-point covering.

A fingerprint of ``64 * lanes`` bits is cut into blocks.  The anchors of a block are
the words of a covering code: an extended product of perfect Hamming codes and raw
bits, so every block lies within one bit of an anchor (covering radius 1).  Each
fingerprint is at home at its nearest anchor and is replicated to every anchor within
the radius plus the block's threshold.  If two fingerprints differ by at most t bits
over b blocks, some block differs by at most t // b bits; both then meet at the home
anchor of the smaller one, where they are compared in full.  With t // b no larger
than the block threshold the search is exact (:data:`NARROW`); :func:`wide` trades that
for a wider radius, and its blocks grow with the table, so that an anchor has no more
homes as the table grows.

Only distinct fingerprints are replicated, so a group of copies, however large, is one
row.  In a task the pairs of an anchor are compared in numpy and contracted to a
forest: a dense group of m near copies leaves m - 1 edges, never m squared rows.  An
anchor's rows arrive sorted with its homes first and are read in pieces, so memory is
bounded by the homes of one anchor; homes of anchors with many of them are dealt out
over salts, to each of which the members are sent.

Edge cases: null and empty texts have fingerprint zero and are linked like any other;
rows with a null doc_id are labelled with the smallest doc_id of their group (null if
it has none); repeated rows keep their multiplicity; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_table, short_batches, split_join, tidy, write_table
from corpusloom.llm.components import components, local_forest, spanning_forest

#: An anchor with more homes than this, and more than one in HOT_ANCHORS of all, is dealt out over salts; there are fewer than HOT_ANCHORS of them.
HOT_HOMES, HOT_ANCHORS = 4096, 1000
#: A group of open candidates is checked in blocks of about so many documents, or bytes of shingle sets.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20


@dataclass(frozen=True)
class Layout:
    """lanes: 64-bit words of a fingerprint; code: length of the Hamming code in a block (2**r - 1); raw: further bits of a block, kept as they are; reach: threshold of a block; most: differing bits of a link."""

    lanes: int
    code: int
    raw: int
    reach: int
    most: int

    @property
    def width(self) -> int:
        return self.code + self.raw

    @property
    def blocks(self) -> int:
        return 64 * self.lanes // self.width

    @property
    def exact(self) -> bool:
        return self.most // self.blocks <= self.reach


#: 64 bits, at most 3 differing: two blocks of 32 bits, one of which differs by at most 1.  Exact.
NARROW = Layout(lanes=1, code=31, raw=1, reach=1, most=3)
#: Share of differing bits of texts with 0.8 of their shingles in common, by the angle of their sets.
APART = math.acos(2 * 0.8 / (1 + 0.8)) / math.pi


def wide(texts: int, recall: float = 0.99) -> Layout:
    """The layout that finds candidates for a share of 0.8 or more of common shingles among so many different texts.

    Blocks have threshold 1, and 16 bits for up to :data:`WIDE_TEXTS` texts, one more for
    each doubling (21 at most): so the anchors of a block grow with the table, and the
    homes of an anchor do not.  There are as many blocks as let a pair at 0.8 meet in one
    with probability ``recall``, closer pairs more surely, and so many differing bits are
    allowed as 99.6 % of such pairs have at most.  An exact check follows.
    """
    raw = 1 + min(5, max(0, math.ceil(math.log2(max(texts, 1) / WIDE_TEXTS))))
    width = 15 + raw
    meet = (1 - APART) ** width + width * APART * (1 - APART) ** (width - 1)
    blocks = math.log(1 - recall) / math.log(1 - meet)
    lanes = math.ceil(blocks / (64 // width))
    bits = 64 * lanes
    return Layout(lanes=lanes, code=15, raw=raw, reach=1, most=round(bits * APART + 2.65 * math.sqrt(bits * APART * (1 - APART))))


#: 256 bits in 16 blocks, at most 54 differing serve so many texts.
WIDE_TEXTS = 1 << 22
WIDE = wide(WIDE_TEXTS)


def _hashes(text: str | None, words: int, lanes: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, a row for each of the lanes (seeds 42, 43, ...), in pieces; nothing for no words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = (text or "").encode().lower().split()
    if not w:
        return
    if len(w) < words:
        w = [b" ".join(w)]
        n = 1
    else:
        n = len(w) - words + 1
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1] if n > 1 or len(w) > 1 else w
        shingles = list(map(b" ".join, zip(*(part[k : len(part) - words + 1 + k] for k in range(words)), strict=True))) if len(w) >= words else part
        yield np.array([[digest(s, 42 + lane) for s in shingles] for lane in range(lanes)], dtype="<u8")


def _print(pieces: Iterable[np.ndarray], lanes: int) -> list[int]:
    counts, n = np.zeros((lanes, 64), dtype=np.int64), 0
    for h in pieces:
        n += h.shape[1]
        for lane in range(lanes):
            counts[lane] += np.unpackbits(np.ascontiguousarray(h[lane]).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int(np.packbits(counts[lane] * 2 > n).view("<u8")[0]) for lane in range(lanes)]


def fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> list[int]:
    """SimHash of a whole text over its shingles, as unsigned 64-bit words (seeds 42, 43, ...)."""
    return _print(_hashes(text, words, lanes), lanes)


def set_fingerprint(text: str | None, words: int = 3, lanes: int = 1) -> tuple[list[int], int]:
    """SimHash over the distinct shingles, each once, and a hash of their set; lanes are mixed from one hash of a shingle."""
    import xxhash

    own = np.empty(0, dtype="<u8")
    for h in _hashes(text, words, 1):
        own = np.unique(np.concatenate([own, h[0]]))
    pieces = (_mixed(own[at : at + (1 << 16)], lanes) for at in range(0, len(own), 1 << 16))
    return _print(pieces, lanes), xxhash.xxh64_intdigest(own.tobytes())


def _mixed(h: np.ndarray, lanes: int) -> np.ndarray:
    """A row of well mixed hashes for each lane (the finisher of SplitMix64)."""
    x = h[None, :] + np.arange(lanes, dtype="<u8")[:, None] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int, layout: Layout) -> DataFrame:
    """doc_id and the fingerprint as signed 64-bit lanes f0, f1, ...; one narrow pass."""
    lanes = layout.lanes
    short_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            f = [fingerprint(t.as_py(), words, lanes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([_signed(x[k]) for x in f], type=pa.int64()) for k in range(lanes))], names=["doc_id", *(f"f{k}" for k in range(lanes))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(["doc_id long", *(f"f{k} long" for k in range(lanes))]))


def set_fingerprints(docs: DataFrame, words: int, layout: Layout) -> DataFrame:
    """Like :func:`fingerprints`, over distinct shingles, with the hash of their set as ``whole``."""
    lanes = layout.lanes
    short_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            f = [set_fingerprint(t.as_py(), words, lanes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([_signed(x[k]) for x, _ in f], type=pa.int64()) for k in range(lanes)), pa.array([_signed(h) for _, h in f], type=pa.int64())], names=["doc_id", *(f"f{k}" for k in range(lanes)), "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(["doc_id long", *(f"f{k} long" for k in range(lanes)), "whole long"]))


# Covering code -------------------------------------------------------------------------


def _syndrome(block: np.ndarray, code: int) -> np.ndarray:
    s = np.zeros(len(block), dtype=np.int64)
    for bit in range(code):
        s ^= np.where(block >> bit & 1 > 0, bit + 1, 0)
    return s


def _flip(position: np.ndarray) -> np.ndarray:
    """The mask of a code position counted from 1; nothing for 0."""
    return np.where(position > 0, np.int64(1) << np.maximum(position - 1, 0), 0)


def anchors_of(block: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of all anchors within the radius plus the block's threshold.

    Flipping a set of code positions reaches a code word if their sum (exclusive or) is
    the syndrome: the sets of one, two or three positions with that sum are listed.
    """
    n, code, reach = len(block), layout.code, 1 + layout.reach
    s = _syndrome(block, code)
    every = np.arange(n)
    own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: [], 2: [], 3: []}
    zero = np.flatnonzero(s == 0)
    own[0].append((zero, block[zero]))
    one = np.flatnonzero(s > 0)
    own[1].append((one, block[one] ^ _flip(s[one])))
    for a in range(1, code + 1):
        b = s ^ a
        k = np.flatnonzero((b > a) & (b <= code))
        own[2].append((k, block[k] ^ _flip(np.full(len(k), a)) ^ _flip(b[k])))
        if reach >= 3:
            for b2 in range(a + 1, code + 1):
                c = s ^ a ^ b2
                k = np.flatnonzero((c > b2) & (c <= code))
                own[3].append((k, block[k] ^ _flip(np.full(len(k), a)) ^ _flip(np.full(len(k), b2)) ^ _flip(c[k])))
    index, anchor = [], []
    raws = {0: [0]}
    for flips in range(1, reach + 1):
        raws[flips] = [m << code for m in range(1 << layout.raw) if m.bit_count() == flips]
    for away, lists in own.items():
        for flips in range(reach - away + 1):
            for mask in raws[flips]:
                for k, a in lists:
                    index.append(every[k])
                    anchor.append(a ^ mask)
    return np.concatenate(index), np.concatenate(anchor)


def blocks_of(lanes: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """The blocks of fingerprints given as unsigned 64-bit lanes."""
    per, out = 64 // layout.width, []
    for k in range(layout.blocks):
        lane, nth = divmod(k, per)
        out.append((lanes[lane] >> np.uint64(nth * layout.width) & np.uint64((1 << layout.width) - 1)).astype(np.int64))
    return out


def _homes(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            lanes = [batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(layout.lanes)]
            for k, block in enumerate(blocks_of(lanes, layout)):
                home = block ^ _flip(_syndrome(block, layout.code))
                yield pa.RecordBatch.from_arrays([pa.array(home | k << layout.width)], names=["anchor"])

    return run


def _replicas(layout: Layout, hot: dict[int, int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hot_keys = np.array(sorted(hot), dtype=np.int64)
    hot_salts = np.array([hot[k] for k in sorted(hot)], dtype=np.int64)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                node = batch.column("node").to_numpy()
                own = [batch.column(c).to_numpy() for c in names]
                lanes = [batch.column(f"f{k}").to_numpy() for k in range(layout.lanes)]
                unsigned = [x.view(np.uint64) for x in lanes]
                for k, block in enumerate(blocks_of(unsigned, layout)):
                    home = block ^ _flip(_syndrome(block, layout.code))
                    i, anchor = anchors_of(block, layout)
                    member = np.where(anchor == home[i], 0, 1).astype(np.int8)
                    key = anchor | k << layout.width
                    salt = np.zeros(len(key), dtype=np.int32)
                    if len(hot_keys):
                        where = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                        salts = np.where(hot_keys[where] == key, hot_salts[where], 1)
                        if (salts > 1).any():
                            # homes go to one salt as homes and to the others as members
                            row = np.repeat(np.arange(len(key)), salts)
                            salt = (np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)).astype(np.int32)
                            mine = (node[i[row]] % salts[row]) == salt
                            member = np.where(mine, member[row], 1).astype(np.int8)
                            i, key = i[row], key[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(member), *(pa.array(x[i]) for x in own)], names=["anchor", "salt", "member", *names])

    return run


class _Anchors:
    """Compares the sorted rows of anchors, batch by batch, and keeps a forest of links between different roots (nodes, where no roots are given)."""

    def __init__(self, layout: Layout, real: bool = False) -> None:
        self.layout, self.real, self.u, self.v, self.d, self.held = layout, real, [], [], [], 0
        self.key: tuple[int, int] | None = None  # of the anchor that the last batch ended in
        self.homes = self._none()

    def _none(self) -> tuple[np.ndarray, ...]:
        return np.empty(0, dtype=np.int64), np.empty((0, self.layout.lanes), dtype=np.uint64), np.empty(0, dtype=np.int64)

    def link(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> None:
        apart = np.bitwise_count(a[1][i] ^ b[1][j]).sum(1, dtype=np.int64)
        near = np.flatnonzero(apart <= self.layout.most)
        x, y = a[0][i[near]], b[0][j[near]]
        keep = a[2][i[near]] != b[2][j[near]]
        self.u.append(x[keep])
        self.v.append(y[keep])
        self.d.append(apart[near[keep]])
        self.held += int(keep.sum())
        if self.held > 1 << 20:
            x, y = self.forest()
            self.held = len(x) // 2

    def block(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> None:
        """All of a against all of b, in blocks."""
        step = max(1, (1 << 19) // max(1, len(b[0])))
        for at in range(0, len(a[0]), step):
            part = tuple(x[at : at + step] for x in a)
            i = np.repeat(np.arange(len(part[0])), len(b[0]))
            self.link(part, b, i, np.tile(np.arange(len(b[0])), len(part[0])))

    def add(self, batch: pa.RecordBatch) -> None:
        anchor, salt = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
        if not len(anchor):
            return
        home = batch.column("member").to_numpy() == 0
        node = batch.column("node").to_numpy()
        root = batch.column("root").to_numpy() if "root" in batch.schema.names else node
        rows = node, np.column_stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(self.layout.lanes)]), root
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
        run = np.repeat(np.arange(len(starts)), ends - starts)
        n_home = np.bincount(run[home], minlength=len(starts))
        if self.key == (int(anchor[0]), int(salt[0])):  # the first anchor goes on
            self.block(self.homes, tuple(x[: ends[0]] for x in rows))
            carried = self.homes
        else:
            carried = self._none()
        work = n_home * (ends - starts)
        for k in np.flatnonzero(work > 1 << 18):  # large anchors one by one, small ones together
            a, h, b = starts[k], starts[k] + n_home[k], ends[k]
            self.block(tuple(x[a:h] for x in rows), tuple(x[a:b] for x in rows))
        small = np.flatnonzero((n_home > 0) & (ends - starts > 1) & (work <= 1 << 18))
        at = 0
        while at < len(small):
            to = at + max(1, int(np.searchsorted(np.cumsum(work[small[at:]]), 1 << 19)))
            s = small[at:to]
            size = ends[s] - starts[s]
            pairs = n_home[s] * size
            r = np.repeat(np.arange(len(s)), pairs)
            nth = np.arange(len(r)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            self.link(rows, rows, starts[s][r] + nth // size[r], starts[s][r] + nth % size[r])
            at = to
        last = starts[-1]
        own = tuple(x[last:][home[last:]] for x in rows)
        if len(starts) == 1 and len(carried[0]):
            own = tuple(np.concatenate([x, y]) for x, y in zip(carried, own, strict=True))
        self.key, self.homes = (int(anchor[-1]), int(salt[-1])), own

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The links so far: a star forest, or with ``real`` the least spanning forest of the links themselves."""
        if not self.u:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        u, v, d = np.concatenate(self.u), np.concatenate(self.v), np.concatenate(self.d)
        u, v, d = spanning_forest(u, v, d) if self.real else (*local_forest(u, v), d[:0])
        self.u, self.v, self.d = [u], [v], [d]
        return u, v


def _compare(layout: Layout, real: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(layout, real)
        for batch in found:
            anchors.add(batch)
        u, v = anchors.forest()
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], names=["u", "v"])

    return run


def links(distinct: DataFrame, layout: Layout, real: bool = False) -> DataFrame:
    """A forest (u, v) over the nodes of ``distinct`` (node long, f0 ...) whose trees are the classes of linked fingerprints.

    With ``real`` its edges are links themselves, and hold a least spanning forest by differing bits.
    With a column ``root``, only links between different roots count.
    """
    most = max(HOT_HOMES, distinct.count() * layout.blocks // HOT_ANCHORS)
    homes = distinct.mapInArrow(_homes(layout), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = {int(r[0]): -(-int(r[1]) // most) for r in homes.collect()}  # fewer than HOT_ANCHORS
    names = ["node", *(["root"] if "root" in distinct.columns else []), *(f"f{k}" for k in range(layout.lanes))]
    rows = distinct.mapInArrow(tidy(_replicas(layout, hot, names)), ", ".join(["anchor long, salt int, member byte", *(f"{c} long" for c in names)]))
    return rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "member").mapInArrow(tidy(_compare(layout, real)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, layout: Layout = NARROW) -> DataFrame:
    """doc_id, f0 ... and component_id: the smallest doc_id reachable over links, its own included.

    A node is a distinct fingerprint, named by its only lane, or else by the smallest
    doc_id that has it (by a hash of the lanes if all its doc_ids are null).
    """
    lanes = [f"f{k}" for k in range(layout.lanes)]
    prints, _ = write_table(fingerprints(docs, words, layout), "fingerprints")
    distinct = prints.groupBy(*lanes).agg(F.min("doc_id").alias("first"))
    name = F.col("f0") if layout.lanes == 1 else F.coalesce("first", F.xxhash64(*lanes))
    distinct, _ = write_table(distinct.select(name.alias("node"), "first", *lanes), "distinct")
    roots = components(links(distinct, layout))
    named = distinct.join(roots, "node", "left").select("first", *lanes, F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select(*lanes, "component_id")
    return prints.join(classes, lanes, "left").select("doc_id", *lanes, "component_id")


# Exact check --------------------------------------------------------------------------


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a whole text's shingles, sorted; fewer words are one shingle, none give nothing."""
    import xxhash

    w = (text or "").encode().lower().split()
    if len(w) < words:
        found = [b" ".join(w)] if w else []
    else:
        found = map(b" ".join, zip(*(w[k : len(w) - words + 1 + k] for k in range(words)), strict=True))
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, found), dtype="<u4"))


def _shingles(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column("text")], type=pa.binary())], names=["node", "shingles"])

    return run


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two shingle sets; two empty ones are alike."""
    x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _alike(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            pairs = zip(batch.column("a"), batch.column("b"), strict=True)
            keep = pa.array([jaccard(a.as_py(), b.as_py()) >= least for a, b in pairs], type=pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    return run


def _between(layout: Layout, least: float) -> Callable[[pa.Table], pa.Table]:
    """Checks all candidates between different roots in a pair of blocks; gives the similar ones that join roots."""

    def run(table: pa.Table) -> pa.Table:
        node, root, part = (table.column(c).to_numpy() for c in ("node", "root", "part"))
        lanes = [table.column(f"f{k}").to_numpy().view(np.uint64) for k in range(layout.lanes)]
        prints, blocks = np.column_stack(lanes), np.column_stack(blocks_of(lanes, layout))
        homes = np.column_stack([b ^ _flip(_syndrome(b, layout.code)) for b in blocks.T])
        sets = table.column("shingles").to_pylist()
        size = np.array([len(s) for s in sets])
        root = np.unique(root, return_inverse=True)[1]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        u, v = [], []
        for i in left:
            c = right[right > i] if x == y else right
            c = c[root[c] != root[i]]
            # of sets that differ so much in size none are similar
            low, high = np.minimum(size[c], size[i]), np.maximum(size[c], size[i])
            c = c[low / np.maximum(high, 1) >= least * (high > 0)]
            apart = np.bitwise_count(prints[c] ^ prints[i]).sum(1, dtype=np.int64)
            order = np.argsort(apart, kind="stable")
            c = c[order[apart[order] <= layout.most]]
            # they meet where one's home is in the other's reach
            away = np.minimum(np.bitwise_count(homes[c] ^ blocks[i]), np.bitwise_count(blocks[c] ^ homes[i]))
            for j in c[(away <= 1 + layout.reach).any(1)]:
                if root[i] != root[j] and jaccard(sets[i], sets[j]) >= least:
                    u.append(node[i])
                    v.append(node[j])
                    root[root == root[j]] = root[i]
        return pa.table({"u": pa.array(u, type=pa.int64()), "v": pa.array(v, type=pa.int64())})

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (group, node, shingles, ...) with part, x, y: each two rows of a group meet in one (x, y), of bounded size and in a task of its own."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = rows.groupBy("group").agg(parts.alias("parts"), F.count("*").alias("n"))
    dealt = split_join(rows, sizes, "group", "node", "n", rows.count()).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).drop("parts", "other", "n").repartition("group", "x", "y")


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, layout: Layout | None = None) -> DataFrame:
    """doc_id and component_id: the smallest doc_id reachable over links of similarity ``least`` or more.

    Candidates are links of fingerprints.  First the least spanning forest of each task's
    links is checked on the whole sets of shingles, which joins most of what is similar;
    then all candidates whose ends are still apart are, block by block within their group.
    So a group of near copies makes no table of all its pairs, no candidate stays
    unchecked, and the result does not depend on partitions.  The layout follows the
    number of documents where none is given.
    Fingerprints are of the distinct shingles; only equal sets of shingles count as similar
    unchecked.  Rows with a null doc_id are left out, and rows of
    one doc_id are one document.
    """
    layout = layout or wide(docs.count())
    lanes = [f"f{k}" for k in range(layout.lanes)]
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, _ = write_table(set_fingerprints(named, words, layout), "fingerprints")
    distinct, distinct_at = write_table(prints.groupBy(*lanes, "whole").agg(F.min("doc_id").alias("node")).select("node", *lanes, "whole"), "distinct")
    found, found_at = write_table(links(distinct.select("node", *lanes), layout, real=True).distinct(), "candidates")
    ends = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = named.join(ends, named["doc_id"] == ends["node"]).select("node", "text")
    short_batches(docs.sparkSession)
    sets, sets_at = write_table(texts.mapInArrow(tidy(_shingles(words)), "node long, shingles binary"), "shingles")
    first = found.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = first.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b")
    # rows of one doc_id share it, whatever their fingerprints
    own = prints.join(distinct, [*lanes, "whole"]).where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()
    edges, edges_at = write_table(both.mapInArrow(tidy(_alike(least)), "u long, v long").unionAll(own), "similar")
    roots, roots_at = write_table(components(edges), "roots")
    # candidates that no forest held and whose ends are still apart
    ended = distinct.join(ends, "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *lanes)
    ended, ended_at = write_table(ended, "ended")
    open_, open_at = write_table(links(ended, layout), "open")
    paths = [distinct_at, found_at, sets_at, edges_at, ended_at, open_at]
    if not open_.isEmpty():
        groups = components(open_).select("node", F.col("root").alias("group"))
        groups = groups.unionAll(groups.select(F.col("group").alias("node"), "group").distinct())
        rows, rows_at = write_table(groups.join(ended, "node").join(sets, "node"), "groups")
        more = _blocks(rows).groupBy("group", "x", "y").applyInArrow(_between(layout, least), "u long, v long")
        more, more_at = write_table(more.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), "joined")
        roots, _ = write_table(components(more), "roots")
        paths += [rows_at, more_at, roots_at]
    for path in paths:
        drop_table(docs.sparkSession, path)
    return prints.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
