"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its word n-grams (lower case; fewer than n words: one gram of them all). Its
signature is a bitmap with four to eight bits for each n-gram, and its set size. A tree's nodes hold the OR of the
bitmaps below and the range of sizes; two trees are walked together, and a pair of nodes is left as soon as the
largest overlap that their bitmaps and sizes allow is below what the Jaccard threshold asks. Pairs of leaves that
remain are compared exactly.

Distribution. What goes into one tree follows from an exact prefix filter. With a set's grams in the order of
(documents that have it, hash), rarest first, two sets at the threshold t share a gram among the first
size - ceil(t * size) + 1 of each. Grams that one document alone has can't be shared, so most documents drop out here,
and passages that many documents share come last. The steps:

1. Equal texts are one document from here on (by two 64-bit hashes); their number is a weight.
2. Chunks of documents send 32 bits of each gram hash, and 16 for the document, packed, to the gram's part. Grams
   that more than LOCAL documents of a chunk have go as a count, so no gram has more entries in a part than LOCAL times
   the chunks. Parts count the documents of each gram and tell the chunks those of grams seen twice. (Different grams that share a
   part and 32 bits count as one, which only makes them look more frequent; the order stays the same everywhere.)
3. Chunks take each document's prefix. Documents that share a gram which more than FEW have in their prefixes are tied
   to the first of them, within the chunk first. Of grams that fewer have, each pair is counted, and two documents are tied
   if the grams that they share in their prefixes, and what may follow these, allow the overlap that the threshold asks:
   a rare gram shared by chance ties nothing. Connected ones are a cluster. Every pair at the threshold lies in a cluster.
4. The sets of clusters (not of the other documents) are written once and travel to trees; clusters of more than TILE
   documents are cut in tiles, and each two tiles are compared, in rounds: tiles that lie up to NEAR apart (in a circle)
   first, then those further away. What a round finds is added up, one row a document, before the next.

No step drops a pair, whatever the data. The work within a cluster grows with the square of its different texts as far as
the trees exclude nothing, as the exact number of links asks, and so does what travels over all rounds; what lies on disk
at once doesn't: a round sends each set to 2 * NEAR pairs of tiles at most (fewer if most documents are in such clusters),
and its shuffle files go with it. Texts are shuffled only if a bitmap says that they may be wanted.

Defined results. A document is (doc_id, text); rows that repeat both are one. Null and empty texts (no word) have no
set: they have no links and stay. A null doc_id is a document like any other. Ties: a class is named by, and of a
class stays, the document with the least (doc_id, hash of the text), null doc_ids after all others. Empty tables
give empty results. Other columns are carried and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHash, bundles, components, dropped, give_back, joined, keyed, looked_up, prepare, rolled, sized, text_hash, written

N, THRESHOLD, TILE, LOCAL, NEAR, FEW = 3, 0.6, 1024, 64, 4, 32
#: Grams in a chunk, about; bytes of text for a part of the grams, and the most parts.
CHUNK_GRAMS, PART_BYTES, PARTS = 1_000_000, 8 << 20, 65_536
LEAF, FAN, COLUMNS = 32, 8, 1 << 15


def gram_set(text: str, n: int, hashes: WordHash) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    return np.unique(rolled(hashes.of(text.lower().encode().split()), n))


def bitmap(grams: np.ndarray) -> tuple[int, int]:
    """(width, bits): bit h mod width for each gram; the width is the power of two from 4 to 8 times the set's size."""
    width = max(64, 1 << (4 * len(grams) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(grams & np.uint64(width - 1)).astype(np.int64)] = 1
    return width, int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def folded(bits: int, width: int, to: int) -> int:
    """The bitmap of the same set at a smaller width."""
    while width > to:
        width >>= 1
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    """OR of the bitmaps below, at one width; range of the sizes; most n-grams that share a bit within one set."""

    __slots__ = ("bits", "clash", "hi", "kids", "lo", "width")

    def __init__(self, lo: int, hi: int, width: int, bits: int, clash: int, kids: list):
        self.lo, self.hi, self.width, self.bits, self.clash, self.kids = lo, hi, width, bits, clash, kids


def build(items: list[tuple[int, int, int]], lo: int = 0, hi: int | None = None) -> Node:
    """A tree over (size, width, bits), items lo to hi, in the order given: like sets should be neighbours. Leaves' kids are item numbers."""
    level = []
    hi = len(items) if hi is None else hi
    for a in range(lo, hi, LEAF):
        part = items[a : min(a + LEAF, hi)]
        width = min(w for _, w, _ in part)
        bits = clash = 0
        for size, w, x in part:
            x = folded(x, w, width)
            bits |= x
            clash = max(clash, size - x.bit_count())
        level.append(Node(min(i[0] for i in part), max(i[0] for i in part), width, bits, clash, list(range(a, a + len(part)))))
    while len(level) > 1:
        up = []
        for a in range(0, len(level), FAN):
            part = level[a : a + FAN]
            width, bits = min(x.width for x in part), 0
            for x in part:
                bits |= folded(x.bits, x.width, width)
            # a fold of w/2^k merges at most what the bitmap lost in bits, which only the sets know: take the whole size
            clash = max(x.clash if x.width == width else x.hi for x in part)
            up.append(Node(min(x.lo for x in part), max(x.hi for x in part), width, bits, clash, part))
        level = up
    return level[0]


def possible(a: Node, b: Node, t: float) -> bool:
    """Whether any pair below may reach the threshold: largest overlap against the least that the sizes ask for."""
    if a.hi < t * b.lo or b.hi < t * a.lo:
        return False
    width = min(a.width, b.width)
    both = (folded(a.bits, a.width, width) & folded(b.bits, b.width, width)).bit_count()
    most = min(a.hi, b.hi)
    if a.width == width:
        most = min(most, a.clash + both)
    if b.width == width:
        most = min(most, b.clash + both)
    return most * (1 + t) >= t * (a.lo + b.lo) - 1e-9


def leaf_pairs(items: list[tuple[int, int, int]], t: float, cut: int = 0) -> Iterator[tuple[list[int], list[int]]]:
    """Pairs of leaves (item numbers; a leaf with itself, too) that dual traversal of the items' tree can't exclude.

    cut: only pairs of the items before it with those from it on, a tree each.
    """
    root = build(items, cut)
    stack = [(build(items, 0, cut) if cut else root, root)]
    while stack:
        a, b = stack.pop()
        if not possible(a, b, t):  # a node with itself, too: all below may be alone
            continue
        leaf_a, leaf_b = isinstance(a.kids[0], int), isinstance(b.kids[0], int)
        if leaf_a and leaf_b:
            yield a.kids, b.kids
        elif a is b:
            stack += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i:]]
        elif leaf_b or (not leaf_a and a.hi - a.lo >= b.hi - b.lo):
            stack += [(x, b) for x in a.kids]
        else:
            stack += [(a, x) for x in b.kids]


class Leaf:
    """The grams of a leaf's sets: all, which set has each, and the different ones, sorted."""

    __slots__ = ("grams", "row", "sizes", "unique")

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.grams = np.concatenate(sets)
        self.row = np.repeat(np.arange(len(sets)), self.sizes)
        self.unique = np.unique(self.grams)


def overlaps(a: Leaf, b: Leaf) -> np.ndarray:
    """[i, j]: the grams that set i of a and set j of b share."""
    common = a.unique if a is b else np.intersect1d(a.unique, b.unique, assume_unique=True)
    out = np.zeros((len(a.sizes), len(b.sizes)))
    if not len(common):
        return out
    at = []
    for x in (a, b):
        place = np.minimum(np.searchsorted(common, x.grams), len(common) - 1)
        hit = common[place] == x.grams
        at.append((x.row[hit], place[hit]))
    for lo in range(0, len(common), COLUMNS):
        sides = []
        for (row, place), x in zip(at, (a, b), strict=True):
            m = np.zeros((len(x.sizes), min(COLUMNS, len(common) - lo)), np.float32)
            now = (place >= lo) & (place < lo + COLUMNS)
            m[row[now], place[now] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def similar(sets: list[np.ndarray], t: float, first: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of the sets whose Jaccard similarity is at least t; first: only pairs of those where it holds with the others."""
    side = np.zeros(len(sets), bool) if first is None else ~first
    order = sorted(range(len(sets)), key=lambda x: (side[x], sets[x][0], len(sets[x])))  # by the least hash: like sets are neighbours
    cut = 0 if first is None else int(first.sum())
    if first is not None and cut in (0, len(sets)):
        return
    leaves: dict[int, Leaf] = {}
    for p, q in leaf_pairs([(len(sets[x]), *bitmap(sets[x])) for x in order], t, cut):
        for k in (p, q):
            if k[0] not in leaves:
                leaves[k[0]] = Leaf([sets[order[x]] for x in k])
        a, b = leaves[p[0]], leaves[q[0]]
        inter = overlaps(a, b)
        i, j = np.nonzero(inter >= t * (a.sizes[:, None] + b.sizes - inter) - 1e-9)
        x, y = np.array(order)[np.array(p)[i]], np.array(order)[np.array(q)[j]]
        keep = x < y if a is b else np.ones(len(x), bool)
        yield np.minimum(x, y)[keep], np.maximum(x, y)[keep]


#: What chunks and parts tell each other; what a chunk keeps for itself goes through a part unchanged.
SENT = pa.schema([("to", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SENT_DDL = "to int, chunk long, kind int, a binary, b binary, c binary"
GRAMS, COUNTS, DOCS, OFTEN = range(4)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)


def _tokens(n: int, parts: int, chunk_grams: int, local: int):
    """(id, th, text) to the packed grams of chunks. A gram's token is (part << 32) | 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHash(), TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(held)
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            token = (((grams >> np.uint64(32)) * np.uint64(parts)) & ~np.uint64(0xFFFFFFFF)) | (grams & np.uint64(0xFFFFFFFF))
            order = np.argsort(token)
            token, doc = token[order], np.repeat(np.arange(len(held)), sizes)[order].astype(np.uint16)
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            often = np.repeat(count > local, count)
            few, few_doc, many = token[~often], doc[~often], start[count > local]
            bounds = [np.searchsorted(x >> np.uint64(32), np.arange(parts + 1)) for x in (few, token[many])]
            rows = []
            for p in range(parts):
                a, z = bounds[0][p : p + 2]
                if z > a:
                    rows.append((p, number, GRAMS, few[a:z].astype(np.uint32).tobytes(), few_doc[a:z].tobytes(), None))
                a, z = bounds[1][p : p + 2]
                if z > a:
                    rows.append((p, number, COUNTS, token[many[a:z]].astype(np.uint32).tobytes(), None, count[count > local][a:z].astype(np.uint32).tobytes()))
            mine = number % parts
            ids, ths = zip(*docs, strict=True)
            rows.append((mine, number, DOCS, np.array([0 if x is None else x for x in ids], np.int64).tobytes() + np.array(ths, np.int64).tobytes(), sizes.astype(np.uint32).tobytes(), np.array([x is None for x in ids], np.uint8).tobytes()))
            if often.any():
                rows.append((mine, number, OFTEN, token[often].tobytes(), doc[often].tobytes(), None))
            for x in range(0, len(rows), 64):
                yield _sent(rows[x : x + 64])

        for batch in batches:
            for i, th, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                grams = gram_set(text, n, hashes)
                if not len(grams):
                    continue
                held.append(grams)
                docs.append((i, th))
                total += len(grams)
                if total >= chunk_grams or len(held) == 1 << 16:
                    yield from flush()
                    held, docs, total, number = [], [], 0, number + 1
        if held:
            yield from flush()
        del hashes
        give_back()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, what it tells the chunks: the documents that have each gram which more than one has."""
    grams: dict[int, list[tuple]] = {}
    counts: dict[int, list[tuple]] = {}
    for batch in batches:
        own = []
        for to, chunk, kind, a, b, c in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if kind == GRAMS:
                grams.setdefault(to, []).append((chunk, a, b))
            elif kind == COUNTS:
                counts.setdefault(to, []).append((chunk, a, c))
            else:
                own.append((to, chunk, kind, a, b, c))
        if own:
            yield _sent(own)
    for to in sorted(set(grams) | set(counts)):
        few, many = grams.pop(to, []), counts.pop(to, [])
        tokens = np.concatenate([np.frombuffer(x[1], np.uint32) for x in (*few, *many)])
        ones = sum(len(x[1]) for x in few) // 4
        weight = np.concatenate((np.ones(ones, np.int64), *(np.frombuffer(x[2], np.uint32).astype(np.int64) for x in many)))
        order = np.argsort(tokens)
        t = tokens[order]
        start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        df = np.empty(len(t), np.int64)
        df[order] = np.repeat(np.add.reduceat(weight[order], start), np.diff(np.append(start, len(t))))
        df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
        rows, at = [], 0
        for kind, of in ((GRAMS, few), (COUNTS, many)):
            for chunk, a, b in of:
                size = len(a) // 4
                mine = df[at : at + size]
                at += size
                twice = mine > 1
                if twice.any():
                    doc = np.frombuffer(b, np.uint16)[twice].tobytes() if kind == GRAMS else None
                    rows.append((to, chunk, kind, np.frombuffer(a, np.uint32)[twice].tobytes(), doc, mine[twice].tobytes()))
        for x in range(0, len(rows), 64):
            yield _sent(rows[x : x + 64])
    give_back()


PREFIX = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("size", pa.int32()), ("rest", pa.int32())])
PREFIX_DDL = "kind int, token long, u long, v long, id long, th long, size int, rest int"
ENTRY, EDGE, NAME = range(3)


def _prefixes(t: float, most: int):
    """For each chunk: (token, document with it, size of its set, grams of it that follow), and names of the documents.

    A token that more than most documents of the chunk have comes with the first of them, size 0, and edges to it from the others.
    """

    def rows(kind: int, n: int, **cols: np.ndarray | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), *(cols[f.name] if isinstance(cols.get(f.name), pa.Array) else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in list(PREFIX)[1:])], schema=PREFIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, dict[int, list[tuple]]] = {}
        for batch in batches:
            for to, chunk, kind, a, b, c in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                chunks.setdefault(chunk, {}).setdefault(kind, []).append((to, a, b, c))
        for chunk in sorted(chunks):
            got = chunks.pop(chunk)
            _, names, sizes, none = got[DOCS][0]
            size = np.frombuffer(sizes, np.uint32).astype(np.int64)
            names = np.frombuffer(names, np.int64)

            def column(kind: int, at: int, of: type, got: dict = got) -> np.ndarray:
                return np.concatenate([np.zeros(0, of), *(np.frombuffer(x[at], of) for x in got.get(kind, []))])

            def tokens(kind: int, got: dict = got) -> np.ndarray:
                return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x[1], np.uint32).astype(np.uint64) | np.uint64(x[0] << 32) for x in got.get(kind, []))])

            token, doc, df = tokens(GRAMS), column(GRAMS, 2, np.uint16), column(GRAMS, 3, np.uint32)
            if OFTEN in got:
                known, known_df = tokens(COUNTS), column(COUNTS, 3, np.uint32)
                order = np.argsort(known)
                often = column(OFTEN, 1, np.uint64)
                token, doc = np.concatenate((token, often)), np.concatenate((doc, column(OFTEN, 2, np.uint16)))
                df = np.concatenate((df, known_df[order][np.searchsorted(known[order], often)]))
            order = np.lexsort((token, df, doc))
            token, doc = token[order], doc[order].astype(np.int64)
            seen = np.bincount(doc, minlength=len(size))
            place = np.arange(len(doc)) - (np.cumsum(seen) - seen)[doc] + (size - seen)[doc]
            keep = place < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[doc]
            token, doc, rest = token[keep], doc[keep], (size[doc] - 1 - place)[keep]
            if not len(token):
                continue
            order = np.lexsort((doc, token))
            token, doc, rest = token[order], doc[order], rest[order]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            first, often = np.repeat(doc[start], count), np.repeat(count > most, count)
            told = ~often
            told[start] = True
            yield rows(ENTRY, int(told.sum()), token=token[told].view(np.int64), u=doc[told] | (chunk << 16), size=np.where(often, 0, size[doc])[told], rest=rest[told])
            pair = np.unique((first << 16 | doc)[often & (first != doc)])
            if len(pair):
                yield rows(EDGE, len(pair), u=(pair >> 16) | (chunk << 16), v=(pair & 0xFFFF) | (chunk << 16))
            some = np.unique(doc)
            ids = pa.array(names[: len(size)][some], mask=np.frombuffer(none, np.uint8)[some] > 0)
            yield rows(NAME, len(some), u=some | (chunk << 16), id=ids, th=names[len(size) :][some])
        give_back()

    return run


TIED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("a", pa.int64()), ("size_u", pa.int32()), ("size_v", pa.int32()), ("rest_u", pa.int32()), ("rest_v", pa.int32())])
TIED_DDL = "u long, v long, a long, size_u int, size_v int, rest_u int, rest_v int"
#: Counts as more grams than any set has.
ALL = 1 << 32


def _tied(most: int):
    """(token, u, size, rest) of whole tokens to u < v, the tokens that both have, their sizes, and the least that is left of each.

    A token of more than most documents ties all to the first of them, whatever else they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            token, u, size, rest = (np.concatenate(c) for c in zip(*held, strict=True))
            del held
            order = np.lexsort((u, token))
            token, u, size, rest = token[order], u[order], size[order], rest[order]
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(np.append(start, len(token)))
            many = (count > most) | (np.minimum.reduceat(size, start) == 0)
            few, first = np.repeat(~many, count), np.repeat(start, count)
            stars = np.flatnonzero(~few & (u != u[first]))
            i, j = [first[stars]], [stars]
            for d in range(1, int(count[~many].max(initial=1))):
                x = np.flatnonzero(few[:-d] & (token[d:] == token[:-d]) & (u[d:] != u[:-d]))
                i.append(x)
                j.append(x + d)
            i, j = np.concatenate(i), np.concatenate(j)
            a = np.where(few[i], 1, ALL)
            order = np.lexsort((u[j], u[i]))
            i, j, a = i[order], j[order], a[order]
            if len(i):
                at = np.flatnonzero(np.concatenate(([True], (u[i][1:] != u[i][:-1]) | (u[j][1:] != u[j][:-1]))))
                columns = (u[i][at], u[j][at], np.add.reduceat(a, at), np.maximum.reduceat(size[i], at), np.maximum.reduceat(size[j], at), np.minimum.reduceat(rest[i], at), np.minimum.reduceat(rest[j], at))
                table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TIED, strict=True)], schema=TIED)
                for x in range(0, len(at), 1 << 16):
                    yield table.slice(x, 1 << 16)
        give_back()

    return run


def _ties(entries: DataFrame, t: float, parts: int, most: int) -> DataFrame:
    """(u, v) of documents that share a token of many, or whose overlap may be what the threshold asks.

    A token that both have, up to the last one that both have in their prefixes, lies in both prefixes and is counted;
    any other one follows it in both sets, and lies beyond the prefix of the one that ends first.
    """
    pairs = entries.repartition(parts, "token").mapInArrow(_tied(most), TIED_DDL)
    pairs = pairs.groupBy("u", "v").agg(F.sum("a").alias("a"), *(F.max(x).alias(x) for x in ("size_u", "size_v")), *(F.min(x).alias(x) for x in ("rest_u", "rest_v")))
    left = F.least("rest_u", "rest_v", F.ceil(t * F.greatest("size_u", "size_v") - 1e-9) - 1)
    return pairs.where((F.col("a") >= ALL) | ((F.col("a") + left) * (1 + t) >= t * (F.col("size_u") + F.col("size_v")) - 1e-9)).select("u", "v")


SETS = pa.schema([("c", pa.int64()), ("tiles", pa.int32()), ("tile", pa.int32()), ("node", pa.int64()), ("w", pa.int64()), ("grams", pa.binary())])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in range(5)), pa.array([gram_set(x, n, hashes).tobytes() for x in batch.column(5).to_pylist()], pa.binary())], schema=SETS)
        del hashes
        give_back()

    return run


LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _links(t: float):
    """For each two tiles of a cluster: (node, documents that it is linked to, least node that its links lead to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in bundles(batches, 3):
            tiles, i_of, j_of = (table.column(x).to_numpy() for x in ("tile", "i", "j"))
            node, weight, grams = table.column("node").to_numpy(), table.column("w").to_numpy(), table.column("grams")
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                _, own = np.unique(node[a:b], return_index=True)  # repeated rows come twice
                own += a
                if len(own) < 2:
                    continue
                nodes, w = node[own], weight[own]
                first = tiles[own] == i_of[a] if i_of[a] != j_of[a] else None  # pairs within a tile belong to the tile's own group
                links, up = np.zeros(len(own), np.int64), np.arange(len(own))
                for i, j in similar([np.frombuffer(grams[x].as_py(), np.uint64) for x in own.tolist()], t, first):
                    np.add.at(links, i, w[j])
                    np.add.at(links, j, w[i])
                    up = joined(up, i, j)
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[up[some]])], schema=LINKS)
        give_back()

    return run


def _rounds(sets: DataFrame, tiles: DataFrame, documents: int, threshold: float, near: int, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, links, root) of every node with links, root a node that they lead to, and (node, root) of further ties between roots.

    A pair of tiles is e apart, 0 <= e <= tiles / 2, in a circle of a cluster's tiles; a round takes some e.
    """
    most = tiles.agg(F.max("tiles").alias("most")).first()["most"] or 1
    step = max(1, min(near, documents // (2 * sets.where("tiles > 1").count()))) if most > 1 else 1
    links = ties = None
    last: list[str] = []
    for e in range(0, most // 2 + 1, step):
        there = f"transform(sequence({e}, least({e + step - 1}, tiles div 2)), e -> array(pmod(tile + e, tiles), pmod(tile - e, tiles)))"
        pairs = F.expr(f"array_distinct(transform(flatten({there}), x -> struct(least(x, tile) as i, greatest(x, tile) as j)))")
        tiled = sets.where(f"tiles div 2 >= {e}").select("c", F.explode(pairs).alias("ij"), "tile", "node", "w", "grams")
        tiled = tiled.select("c", "ij.i", "ij.j", "tile", "node", "w", "grams").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
        new = tiled.mapInArrow(_links(threshold), "node long, links long, root long")
        new = (new if links is None else new.union(links)).groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        old, last = last, []
        new = written(new, "links", last)
        dropped(sets.sparkSession, old)
        more = written(new.select(F.explode("roots").alias("node"), "root").where("node <> root").distinct(), "ties", scratch)
        links, ties = new.select("node", "links", "root"), more if ties is None else ties.union(more)
    scratch += last
    return links, ties


def ngram_classes(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, parts: int | None = None, chunk_grams: int = CHUNK_GRAMS, local: int = LOCAL, near: int = NEAR, few: int = FEW) -> DataFrame:
    """(id, th, class_none, class_id, class_th, n_links) of every document that has a word, as a written table."""
    spark, scratch = docs.sparkSession, []
    prepare(spark)
    base = keyed(docs).where(F.col("__text").rlike(WORD))
    one = base.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.xxhash64("__text", F.lit(7)).alias("th2"), F.octet_length("__text").cast("long").alias("bytes"))
    one = one.groupBy("id", "th", "th2").agg(F.max("bytes").alias("bytes"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    named = written(one, "documents", scratch)
    texts = written(named.groupBy("th", "th2").agg(F.count("*").alias("w"), F.min(rank).alias("rep"), F.max("bytes").alias("bytes")), "texts", scratch)
    if parts is None:
        parts = max(1, min(PARTS, -(-(texts.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // PART_BYTES)))
    many = texts.where("w > 1").select("th", "th2", F.col("rep.id").alias("rid"), "w")
    many = sized(written(many, "many", scratch))
    gone = written(named.join(many, ["th", "th2"]).where(~F.col("id").eqNullSafe(F.col("rid"))).select(F.col("id").alias("gid"), F.col("th").alias("gth")), "copies", scratch)
    first = looked_up(base, "__th", gone, "gth", F.col("__id").eqNullSafe(F.col("gid")) & (F.col("__th") == F.col("gth")), "left_anti")
    sent = first.mapInArrow(_tokens(n, parts, chunk_grams, local), SENT_DDL).repartition(parts, "to").mapInArrow(_frequencies, SENT_DDL)
    prefixes = written(sent.repartition(parts, "chunk").mapInArrow(_prefixes(threshold, few), PREFIX_DDL), "prefixes", scratch, by="kind")
    ties = _ties(prefixes.where(F.col("kind") == ENTRY).select("token", "u", "size", "rest"), threshold, parts, few)
    cluster = components(ties.union(prefixes.where(F.col("kind") == EDGE).select("u", "v")), "u", "v", scratch).select(F.col("__node").alias("u"), F.col("__root").alias("c"))
    cluster = cluster.join(prefixes.where(F.col("kind") == NAME).select("u", "id", "th"), "u").groupBy("c", "id", "th").agg(F.min("u").alias("node"))
    weights = many.select(F.col("th").alias("wth"), "rid", "w")
    cluster = cluster.join(weights, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("rid")), "left").select("c", "id", "th", "node", F.coalesce("w", F.lit(1)).alias("w"))
    cluster = written(cluster, "clusters", scratch)
    tiles = written(cluster.groupBy("c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"), "tiles", scratch)
    members = cluster.join(sized(tiles), "c", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    members = written(members, "members", scratch)
    sets = looked_up(base, "__th", members, "th", F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th")), "inner").select("c", "tiles", "tile", "node", "w", "__text")
    sets = written(sets.mapInArrow(_sets(n), "c long, tiles int, tile int, node long, w long, grams binary"), "sets", scratch)
    links, ties = _rounds(sets, tiles, named.count(), threshold, near, scratch)
    root = components(links.select("node", "root").union(ties), "node", "root", scratch).select(F.col("__node").alias("node"), F.col("__root").alias("root"))
    found = links.select("node", "links").join(root, "node").join(members.select("node", "id", "th"), "node")
    found = written(found, "found", scratch)
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    found = written(found.join(best, "root").select(F.col("id").alias("fid"), F.col("th").alias("fth"), "links", "best"), "linked", scratch)
    classes = texts.join(sized(found), (F.col("th") == F.col("fth")) & F.col("rep.id").eqNullSafe(F.col("fid")), "left")
    classes = classes.select("th", "th2", F.coalesce("best", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = named.join(classes, ["th", "th2"]).select("id", "th", F.col("class.none").alias("class_none"), F.col("class.id").alias("class_id"), F.col("class.th").alias("class_th"), "n_links")
    out = written(out, "classes")
    dropped(spark, scratch)
    return out


def ngram_jaccard_join(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each document.

    n_links counts the other documents whose word n-gram sets have at least the Jaccard threshold with its own;
    documents that links connect, over others too, are a class, and class_id is the least doc_id of it.
    """
    classes = ngram_classes(docs, **kw)
    rest = docs.where(F.coalesce(~F.col("text").rlike(WORD), F.lit(True))).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("th")).distinct()
    rest = rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "n_links").union(rest)


def ngram_jaccard_dedup(docs: DataFrame, **kw) -> DataFrame:
    """docs, all columns, with one document of each class; documents without a word stay."""
    classes = ngram_classes(docs, **kw)
    gone = classes.where(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))))
    gone = written(gone.select(F.col("id").alias("__gone_id"), F.col("th").alias("__gone_th")), "gone")
    mine = docs.select(F.struct("*").alias("__row"), text_hash("text").alias("__th"))
    on = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__th") == F.col("__gone_th")) & F.col("__row.text").isNotNull()
    return looked_up(mine, "__th", gone, "__gone_th", on, "left_anti").select("__row.*")


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i + {N} - 1], ' ')) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT x, y FROM o JOIN s u ON x = u.doc_id JOIN s v ON y = v.doc_id WHERE inter >= {THRESHOLD} * (u.n + v.n - inter) - 1e-9),
l AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, class_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.class_id FROM r JOIN l ON r.doc_id = l.x)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM (SELECT doc_id, min(class_id) AS class_id FROM r GROUP BY doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM l GROUP BY x) USING (doc_id)
"""
