"""Exact n-gram Jaccard self-join and its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. The elements of all sets
have one order: first those that few texts share, by hash, then those that a pass over all texts
found often, rarest first. Two sets that link share one of their first ``size - least overlap + 1``
elements; those are the tiles of a set. The order decides how full tiles get, never what links,
so the list of frequent elements may be bounded (``MAX_HEAVY``).

From a similarity of ``SEGMENTS_FROM`` percent on, linked sets differ in so few elements that a
tile can name several at once, which fewer sets share by chance: hash space is cut into segments,
whose number the size band fixes, and a tile is the whole content of one. If ``d`` is the most
elements in which a set can differ from a partner in the band, its first ``d + 1`` segments that
have content are its tiles. Of two linked sets, take the one whose tiles reach less far: each
differing element spoils one segment at most, so one of its tiles is the other's too.

All tiles of a text come from one pass, with its size, the name of its set and a hashed bitmap.
Tiles that hold one set only (exact copies count as one) go first; of tiles with the same members
one stays. In these every member meets the tile's smallest and largest set. A first round settles
one such pair a set, that with most tiles in common; a second one the pairs that still lie in
different components. Members
of tiles that hold several components even then are compared by size band (bands double, and a
set also goes to the next one if a linked set may lie there), in blocks of at most ``BLOCK``
against each other: large tiles first with one pair a member and block, so that a large group
closes with pairs in proportion to its rows, then all with all pairs that are left. No link between different
components is lost; links inside one may go unlisted.

Pairs are judged by sizes, then by bitmaps (each bit in which two differ is an element that only
one set has, so bit counts bound the overlap from above), and what survives is settled by
intersecting the sorted arrays. Only the texts of such pairs are read again.

Tiles meet their ends through joins that Spark can split where a tile is large, and ends are
found by grouping with partial aggregation, so a tile with a third of all sets burdens no task.

A null or wordless text has the empty set, size 0, and links with nothing; a text with fewer
words than a shingle has its whole word sequence as one. Ids must be whole numbers (or text that
casts to such). They may repeat or be null: rows with equal sets always share a component, whose
name is the smallest id in it (null if it has none).
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed

BLOCK = 1024
#: Parts by tile in which crowded tiles are looked for: each holds that share of all tile rows on disk.
PASSES = 4
#: Tiles of more members are first closed with one pair a member and block.
LARGE = 64
#: The similarity in percent from which tiles are segments of several elements instead of single ones.
SEGMENTS_FROM = 85
#: Some 30 bytes a row. Beyond, texts are joined to the sets they belong to by shuffle.
MAX_BROADCAST_NODES = 1_000_000
#: Elements counted at a time in a worker, how often one must occur among them to be reported, and how many of those reported are sent back.
CHUNK, OFTEN, MAX_HEAVY = 1 << 20, 4, 100_000
#: Bits of a set's node that hold its size; the rest is hash.
SIZE_BITS = 23
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
NO_HEAVY = np.empty(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z count as lower case, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    hashes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    size = len(words) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = _mixed(h * _A + hashes[k : k + size] + _B)
    return np.unique(h)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each element, of a length that only the size's power of two decides: 16 to 32 bits an element, 256 to 65536; deflated."""
    bits = min(65536, max(256, 1 << (16 * max(1, len(hashes)) - 1).bit_length()))
    at = (hashes >> np.uint64(20)).astype(np.int64) & (bits - 1)
    flags = np.zeros(bits, bool)
    flags[at] = True
    return zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)


def inflated(bits: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bits), np.uint8)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a smaller power-of-two width: positions are taken modulo the width."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0) if len(bits) > width else bits


def enough(a: int, b: int, percent: int) -> int:
    """The least overlap that links sets of sizes a and b: percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


def element_tiles(hashes: np.ndarray, percent: int, heavy: np.ndarray = NO_HEAVY, place: np.ndarray = NO_HEAVY) -> np.ndarray:
    """The elements of a set one of which any linked set has among its own; ``heavy`` are the frequent elements, sorted, with their places in the order."""
    size = len(hashes)
    if not size:
        return np.empty(0, np.int64)
    late = np.zeros(size, np.uint64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
        late = np.where(heavy[at] == hashes, place[at], late)
    # a linked set holds at least ``percent`` of this one
    count = size - -(-percent * size // 100) + 1
    return hashes[np.lexsort((_mixed(hashes), late))[:count]].astype(np.int64)


def _differ(size: int, top: int, percent: int) -> int:
    """The most elements in which a set can differ from a linked one of at most ``top`` elements."""
    return (size + min(100 * size // percent, top)) * (100 - percent) // (100 + percent)


@functools.cache
def _segments(band: int, percent: int) -> int:
    """Into how many segments a band cuts hash space: the least that leaves almost no set short of tiles."""
    low, top = 1 << band, (2 << band) - 1
    sizes = (max(1, low * percent // 100), low, top)
    count = _differ(top, top, percent) + 1
    while count < 4 * top + 16:
        empty = [math.exp(-n / count) for n in sizes]
        spread = [math.sqrt(count * e * max(0.0, 1 - (1 + n / count) * e)) for n, e in zip(sizes, empty, strict=True)]
        if all(count * (1 - e) - 4 * x > _differ(n, top, percent) for n, e, x in zip(sizes, empty, spread, strict=True)):
            break
        count += 1 + count // 64
    return count


def segment_tiles(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The first segments with content, in a set's own size band and in each further one where it may have a partner."""
    size, found = len(hashes), []
    band = size.bit_length() - 1
    while size and (size >> band or (percent << band) <= 100 * size):
        differ, count = _differ(size, (2 << band) - 1, percent), _segments(band, percent)
        name = _mixed(np.array([band], np.uint64))
        band += 1
        if not differ:  # only equal sets link in this band: the tile is the whole set
            found.append(_mixed(_mixed(hashes + _A).sum(keepdims=True) + name))
            continue
        segment = (_mixed(hashes ^ _B) % np.uint64(count)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        filled, starts = np.unique(segment[order], return_index=True)
        # the sum of mixed hashes names a segment's content
        sums = np.add.reduceat(_mixed(hashes[order] + _A), starts)[: differ + 1]
        found.append(_mixed(sums + filled[: differ + 1].astype(np.uint64) * _B + name))
        if len(filled) <= differ:  # two such sets may agree in empty segments only, but share an element
            found.append(_mixed(hashes * _A + name + _C))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


def tiles(hashes: np.ndarray, percent: int, heavy: np.ndarray = NO_HEAVY, place: np.ndarray = NO_HEAVY) -> np.ndarray:
    """The tiles of a set: any linked set has one of them."""
    return segment_tiles(hashes, percent) if percent >= SEGMENTS_FROM else element_tiles(hashes, percent, heavy, place)


def heavy_elements(docs: DataFrame, n: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Elements that occur in many texts, sorted, and their places from 1, rarest first: at most MAX_HEAVY numbers each, from all texts.

    Every worker counts its texts' elements, ``CHUNK`` at a time, and reports those that occur
    ``OFTEN`` there; reports are added up, and the largest sums count.
    """

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        element, n_texts = np.unique(np.concatenate(held), return_counts=True)
        kept = n_texts >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(element[kept].astype(np.int64)), pa.array(n_texts[kept])], names=["element", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [NO_HEAVY], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py(), n))
                total += len(held[-1])
                if total >= CHUNK:
                    yield often(held)
                    held, total = [NO_HEAVY], 0
        yield often(held)

    sums = docs.select(text).mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("n").desc(), "element").limit(MAX_HEAVY).collect()
    heavy = np.array([r["element"] for r in reversed(top)], np.int64).astype(np.uint64)
    order = np.argsort(heavy)
    return heavy[order], order.astype(np.uint64) + np.uint64(1)


def text_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text_key, text)."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def describe(docs: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text", heavy: tuple[np.ndarray, np.ndarray] = (NO_HEAVY, NO_HEAVY)) -> DataFrame:
    """(id, text_key, size, set, tiles, bits) of each row; the last three are null for the empty set."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("set", pa.binary()), ("tiles", pa.list_(pa.int64())), ("bits", pa.binary())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [shingles(t.as_py(), n) for t in part.column(2)]
                made = [(len(h), set_key(h), tiles(h, percent, *heavy), bitmap(h)) if len(h) else (0, None, None, None) for h in found]
                columns = [part.column(0), part.column(1), *(pa.array([m[k] for m in made], schema.field(k + 2).type) for k in range(4))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return text_keys(docs, doc_id, text).mapInArrow(measure, "id long, text_key long, size long, set binary, tiles array<long>, bits binary")


def _node() -> Column:
    """A set's node: its size, then 40 bits of hash.

    Sets that share a node are told apart when pairs are judged; only a link between two sets
    of one size whose hashes agree could be missed, one in 2^40 of such links.
    """
    hash_bits = 63 - SIZE_BITS
    size = F.least(F.col("size"), F.lit((1 << SIZE_BITS) - 1))
    return F.shiftleft(size, hash_bits).bitwiseOR(F.xxhash64("set").bitwiseAND(F.lit((1 << hash_bits) - 1)))


def _size_of(node: str) -> Column:
    return F.shiftright(node, 63 - SIZE_BITS)


def _sums(member: str) -> list[Column]:
    """Aggregates that name a group's members: sums of 32-bit hashes, which cannot overflow."""
    return [F.sum(F.xxhash64(member, F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(seed) for seed in ("first", "second")]


def crowded(facts: DataFrame) -> DataFrame:
    """(tile, node, low, high, same): members of the tiles that hold several nodes.

    ``low`` and ``high`` are the smallest and largest node. Of tiles with the same members one
    stays; ``same`` is their number.
    """
    every = facts.filter("size > 0").select(_node().alias("node"), F.explode("tiles").alias("tile"))
    parts = []
    for nth in range(PASSES):  # one after the other, so that the shuffle files of one are gone before the next
        rows = every.filter(F.pmod("tile", F.lit(PASSES)) == nth)
        ends = rows.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        parts.append(checkpointed(rows.join(ends.select("tile").hint("shuffle_hash"), "tile")))
    members = reduce(DataFrame.union, parts)
    names = members.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members"), *_sums("node"))
    one = names.groupBy("low", "high", "members", "first", "second").agg(F.min("tile").alias("tile"), F.count(F.lit(1)).alias("same"))
    return checkpointed(members.join(one.select("tile", "low", "high", "same").hint("shuffle_hash"), "tile").select("tile", "node", "low", "high", "same").distinct())


def distinct_sets(facts: DataFrame, crowd: DataFrame) -> DataFrame:
    """(key, node, set, id, text_key, size, bits): one row for each set of a crowded tile, by the smallest id; ``key`` is unique."""
    met = facts.filter("size > 0").select(_node().alias("node"), "set", "id", "text_key", "size", "bits").join(crowd.select("node").distinct(), "node", "left_semi")
    first = Window.partitionBy("set").orderBy(F.col("id").asc_nulls_last(), "text_key")
    one = met.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return checkpointed(one.withColumn("key", F.monotonically_increasing_id()))


def star_pairs(crowd: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): keys of the pairs of a member and an end of its tile whose sizes fit, with the number of such tiles."""
    ends = F.array(F.struct(F.col("low").alias("x"), F.col("node").alias("y")), F.struct(F.col("node").alias("x"), F.col("high").alias("y")))
    met = crowd.select(F.inline(ends), "same").filter((F.col("x") != F.col("y")) & (_size_of("x") * 100 >= _size_of("y") * percent))
    met = met.groupBy("x", "y").agg(F.sum("same").alias("n"))
    ids = nodes.select("node", "key")
    named = met.join(ids.select(F.col("node").alias("x"), F.col("key").alias("a")), "x").join(ids.select(F.col("node").alias("y"), F.col("key").alias("b")), "y")
    return checkpointed(named.select("a", "b", "n"))


def texts_of(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, text) of the documents that stand for sets (key, id, text_key)."""
    if nodes.count() <= MAX_BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    keys = nodes.select("key", F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    rows = text_keys(docs, doc_id, text)
    return rows.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("key", "text")


def _possible(percent: int):
    """False where sizes and bitmaps show that two sets cannot link."""

    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for sizes, others, bits, more in batches:
            out = []
            for n, m, x, y in zip(sizes, others, bits, more, strict=True):
                least = enough(n, m, percent)
                fits = min(n, m) >= least
                if fits:
                    x, y = inflated(x), inflated(y)
                    width = min(len(x), len(y))
                    apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
                    fits = (n + m - apart) // 2 >= least
                out.append(fits)
            yield pd.Series(out, dtype=bool)

    return F.pandas_udf(judge, "boolean")


def _linked(percent: int):
    """Exact: the overlap of two sorted arrays of hashes."""

    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                out.append(len(np.intersect1d(x, y, assume_unique=True)) >= enough(len(x), len(y), percent))
            yield pd.Series(out, dtype=bool)

    return F.pandas_udf(judge, "boolean")


def joined_twice(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns of both sets, prefixed a_ and b_."""
    side = lambda k: nodes.select(F.col("key").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pairs (a, b) of sets that link, by their elements; only their texts are read again."""
    near = pairs.select("a", "b")
    wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = texts_of(docs, checkpointed(nodes.join(wanted, "key").select("key", "id", "text_key")), doc_id, text)

    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, n).tobytes() for t in batch], dtype=object)

    sets = texts.dropDuplicates(["key"]).select("key", F.pandas_udf(build, "binary")("text").alias("shingles"))
    return checkpointed(joined_twice(near, sets, ["shingles"]).filter(_linked(percent)("a_shingles", "b_shingles")).select("a", "b"))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps let through."""
    known = joined_twice(pairs.select("a", "b"), nodes, ["size", "bits"])
    return checkpointed(known.filter(_possible(percent)("a_size", "b_size", "a_bits", "b_bits")).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every key on an edge; ``root`` is the smallest key reachable.

    Alternating large-star and small-star steps: each is one or two groupings by key, whose
    rows shrink to stars in a number of rounds that grows with the logarithm of the longest
    chain. Every round is checkpointed; the rounds end when one changes nothing.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before, state = None, ()
    while state != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(lowest)
        now = checkpointed(small.distinct())
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "key")
    return checkpointed(roots.union(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()))


def _with_root(rows: DataFrame, roots: DataFrame, key: str, root: str) -> DataFrame:
    named = roots.select(F.col("key").alias(key), F.col("root").alias(root))
    return rows.join(named, key, "left").withColumn(root, F.coalesce(root, key))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets lie in different components."""
    return _with_root(_with_root(pairs, roots, "a", "_left"), roots, "b", "_right").filter("_left <> _right").drop("_left", "_right")


def _bands(percent: int) -> Column:
    """The size bands of a set: its own, and the next one if a linked set may lie there."""
    own = F.length(F.bin("size")) - 1
    return F.when(F.pow(F.lit(2.0), own + 1) * percent <= F.col("size") * 100, F.array(own, own + 1)).otherwise(F.array(own))


def open_tiles(crowd: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Members (tile, key, root, members) of banded tiles that hold several components, without the ends, which have met all others."""
    inner = crowd.filter("node <> low and node <> high").select("tile", "node").join(nodes.select("node", "key", "size"), "node")
    known = _with_root(inner, roots, "key", "root").select(F.explode(_bands(percent)).alias("band"), "tile", "key", "root")
    known = known.select(F.xxhash64("tile", "band").alias("tile"), "key", "root")
    several = known.groupBy("tile").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("members"), *_sums("key")).filter("least <> most")
    one = several.groupBy("members", "first", "second").agg(F.min("tile").alias("tile"))
    return known.join(one.select("tile", "members").hint("shuffle_hash"), "tile")


def _apart(part: pd.DataFrame, percent: int, each: bool) -> np.ndarray:
    """Of the members of two blocks of a tile: the pairs of different components that sizes and bitmaps let through.

    With ``each``, one pair for every member of the first block that has any: that with the smallest key.
    """
    i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
    key, size, root, block = (part[c].to_numpy() for c in ("key", "size", "root", "block"))
    if (root == root[0]).all():
        return np.empty((0, 2), np.int64)
    maps = [inflated(x) for x in part["bits"]]
    width = min(map(len, maps))
    bits = np.stack([folded(x, width) for x in maps]).view(np.uint64)
    found = [np.empty((0, 2), np.int64)]
    for x in np.flatnonzero(block == i):
        ys = np.flatnonzero((block == j) & (root != root[x]) & (key > key[x] if i == j else True))
        least = -(-percent * (size[x] + size[ys]) // (100 + percent))
        fits = np.minimum(size[x], size[ys]) >= least
        ys, least = ys[fits], least[fits]
        differ = np.bitwise_count(bits[x] ^ bits[ys]).sum(1).astype(np.int64)
        ys = ys[(size[x] + size[ys] - differ) // 2 >= least]
        if each and len(ys):
            ys = ys[[key[ys].argmin()]]
        found.append(np.stack([np.minimum(key[x], key[ys]), np.maximum(key[x], key[ys])], 1))
    return np.concatenate(found)


def _open_pairs(percent: int, each: bool):
    """``_apart`` over all groups (tile, i, j) of a task, whose rows come group by group."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            group = rows[["tile", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)])
            whole = [_apart(rows.iloc[a:b], percent, each) for a, b in pairwise(starts)]
            rest = rows.iloc[starts[-1] :]  # its group may go on in the next batch
            yield pd.DataFrame(np.concatenate([np.empty((0, 2), np.int64), *whole]), columns=["a", "b"])
        if rest is not None:
            yield pd.DataFrame(_apart(rest, percent, each), columns=["a", "b"])

    return compare


def block_pairs(members: DataFrame, nodes: DataFrame, percent: int, each: bool = False) -> DataFrame:
    """Pairs (a, b) of open tiles that the bound lets through, each tile compared block by block; with ``each``, one a member and block."""
    sized = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = other.select("tile", "key", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    filled = placed.join(nodes.select("key", "size", "bits"), "key")
    grouped = filled.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return grouped.mapInPandas(_open_pairs(percent, each), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``text_key`` (xxhash64 of the text), ``n_shingles`` and ``component_id``."""
    heavy = (NO_HEAVY, NO_HEAVY) if percent >= SEGMENTS_FROM else heavy_elements(docs, n, text)
    facts = checkpointed(describe(docs, n, percent, doc_id, text, heavy))
    crowd = crowded(facts)
    nodes = distinct_sets(facts, crowd)
    pairs = star_pairs(crowd, nodes, percent)
    best = checkpointed(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))
    roots = components(links(docs, possible(best, nodes, percent), nodes, n, percent, text, doc_id))
    rest = checkpointed(apart(pairs.join(best, ["a", "b"], "left_anti"), roots))
    star = lambda: roots.select(F.col("key").alias("a"), F.col("root").alias("b"))
    if not rest.isEmpty():
        roots = components(star().union(links(docs, possible(rest, nodes, percent), nodes, n, percent, text, doc_id)))
    tried = None
    for each in (True, False):
        members = checkpointed(open_tiles(crowd, nodes, roots, percent))
        more = block_pairs(members.filter(F.col("members") > LARGE) if each else members, nodes, percent, each)
        more = checkpointed(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            roots = components(star().union(links(docs, more, nodes, n, percent, text, doc_id)))
        tried = more
    named = roots.join(nodes.select("key", "set", "id"), "key")
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.join(names, "root").select(F.col("set").alias("_linked"), "component_id")
    groups = facts.filter("size > 0").groupBy("set").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    moved = groups.join(linked, F.col("set") == F.col("_linked"), "left").filter("copies > 1 or component_id is not null")
    moved = moved.select(F.col("set").alias("_set"), F.coalesce("component_id", "class_id").alias("_component"))
    out = facts.select("id", "text_key", "size", "set").join(moved, F.col("set") == F.col("_set"), "left")
    return out.select(F.col("id").alias(doc_id), "text_key", F.col("size").alias("n_shingles"), F.coalesce("_component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; wordless texts all stay.

    Rows that repeat both id and text count as one document. Documents with null ids are
    measured against others but cannot name a component, so they stay unless such a one has a
    row with an id.
    """
    found = checkpointed(jaccard_components(docs, n, percent, doc_id, text).withColumnRenamed(doc_id, "_id"))
    lost = found.filter((F.col("n_shingles") > 0) & ~F.col("_id").eqNullSafe(F.col("component_id"))).select("_id", "text_key").distinct()
    lost = checkpointed(lost)
    if lost.count() <= MAX_BROADCAST_NODES:
        lost = F.broadcast(lost)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("text_key"))
    kept = docs.join(lost, same, "left_anti")
    if not found.groupBy("_id", "text_key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, text])
    return kept
