"""SimHash near-dedup by tiled exact comparison of fingerprints.

Fingerprints are grouped to distinct classes and dealt into tiles of bounded size. Tile
pairs are compared exactly with numpy's exclusive-or and bit counts. Tiles are keyed by
the population counts of the fingerprint's four 16-bit words: the sum of the differences
of these counts never exceeds the Hamming distance, so a pair of tiles whose counts
differ beyond the radius is skipped without loss; inside a pair, strips of rows ordered
by population count are skipped likewise. Of each pair of tiles only a spanning forest of
its links leaves the task, so a group of n copies never makes n^2 rows.

`components` is the fingerprint operator (links at `radius` bits). `near_duplicates` takes
shingle sets of five words and Jaccard similarity 0.8 or more, and loses no pair. Majority
bits of two such sets may differ in any number, so its fingerprints are parity bitmaps:
two of them differ in no more bits than their sets in elements, which the similarity
bounds. The steps:

1. Two sets of that similarity share a shingle among the first n - ceil(0.8 n) + 1 of each,
   in any common order of shingles (the prefix filter). The order puts shingles that are
   frequent in a sample last; the sample only changes how much is compared, not what is found.
2. The sets that list one shingle are compared by their bitmaps: exclusive-or and bit counts,
   skipping pairs whose sizes or population counts already differ too much.
3. What is linked so far makes small groups; in these the sets themselves are compared.

In 2 and 3 a list that fills more than a tile is compared in rounds (`linked_groups`), so that
a large group of near copies costs about its size, not its square.

Defined results: null text counts as empty; a text without words has fingerprint zero
(and an empty shingle set, equal to other empty sets); words are runs of anything but
ASCII white space, lower-cased in A-Z only; fewer words than a shingle make one shingle;
null ids don't win a component but get one; repeated rows are rows of their own; other
columns, whatever their names, are ignored (`one_of_each` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlens.llm.common import batches_of, located, released, staged, trimmed
from crawlens.llm.components import stars

SEED = 42
#: Fingerprints a tile holds about.
TILE = 4096
#: Rows of a tile compared at once.
STRIP = 256
#: Sets a tile holds about, compared by bitmaps and as themselves, and shingles of all of them where the sets are large (one bit, or 8 bytes, each).
BIT_TILE, SET_TILE, BIT_SHINGLES, SET_SHINGLES = 512, 256, 1 << 25, 1 << 20
#: Bits of a parity bitmap at least; larger sets have about one for each shingle.
BITS = 512
#: Texts sampled for frequent shingles (about), and how many of those are put last in the order at most.
SAMPLE, FREQUENT = 10_000, 1 << 17
#: Sampled texts with a shingle from which on its list isn't sorted by one task.
HOT = 20
#: Pairs of bitmaps compared at once, and words of them.
PAIRS, PAIR_WORDS = 1 << 16, 1 << 20
#: Tiles that are handed to Python at once.
BATCH = 64
#: Columns of an incidence matrix.
WIDTH = 4096
#: For rounding: what isn't apart by more counts as equal.
EPS = 1e-9
SIMILARITY = 0.8


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a whole text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(similarity * n) + 1 of a sorted set's shingles by frequency in the sample, then hash; and which of them are hot.

    Two sets of at least that similarity share one of theirs. frequent: sorted hashes and their counts.
    """
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, bool)
    first = min(n, n - int(np.ceil(similarity * n - EPS)) + 1)
    known, count = frequent
    if not len(known):
        return hashes[:first], np.zeros(first, bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    seen = np.where(known[at] == hashes, count[at], 0)
    order = np.argsort(seen, kind="stable")[:first]
    return hashes[order], seen[order] >= HOT


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i: whether the number of elements whose hash ends in i is odd. An element more changes one bit.

    The halves of a bitmap, by exclusive-or, are the bitmap of half the size.
    """
    size = max(BITS, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each set of left has in common with each of right (None: left itself)."""
    sets = left if right is None else [*left, *right]
    a = len(left)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    order = order[count[col[order]] > 1]
    row, col = row[order], (np.cumsum(count > 1) - 1)[col[order]]
    out = np.zeros((a, len(sets) - a if right is not None else a), np.float32)
    width = min(WIDTH, int(col[-1]) + 1) if len(col) else 1
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        x, y = np.searchsorted(col, [lo, lo + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[x:y], col[x:y] - lo] = 1
        out += held[:a] @ (held[a:] if right is not None else held).T
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- comparison of two tiles -------------------------------------------------------------


class Forest:
    """Union-find over the rows of one or two tiles; rows of one home are joined from the start."""

    def __init__(self, home: np.ndarray):
        _, first, at = np.unique(home, return_index=True, return_inverse=True)
        self.home, self.start = home, first[at]
        self.root = self.start.copy()

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while len(u):
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                break
            a, b, u, v = a[apart], b[apart], u[apart], v[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (nxt := root[root]).tobytes() != root.tobytes():
                root = nxt
        self.root = root

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Homes that were joined to others: one link for each."""
        own = np.nonzero((self.start == np.arange(len(self.start))) & (self.root != self.start))[0]
        return self.home[own], self.home[self.root[own]]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at `radius` bits or fewer, strip by strip; same: b is a, each pair once."""
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb, pa_, pb = a[oa], b[ob], pa_[oa], pb[ob]
    for at in range(0, len(sa), STRIP):
        strip = sa[at : at + STRIP]
        lo = np.searchsorted(pb, pa_[at] - radius, "left")
        hi = np.searchsorted(pb, pa_[at + len(strip) - 1] + radius, "right")
        if same:
            lo = max(lo, at)
        if lo >= hi:
            continue
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ sb[None, lo:hi]) <= radius)
        i, j = oa[i + at], ob[j + lo]
        if same:
            i, j = i[i != j], j[i != j]
        yield i, j


def joined(left: dict, right: dict | None, spec: dict) -> Forest:
    """The forest of the links between two tiles (None: inside one). spec: radius for fingerprints, or ratio for sets and their bitmaps."""
    forest = Forest(left["home"] if right is None else np.concatenate([left["home"], right["home"]]))
    shift = 0 if right is None else len(left["home"])
    other = left if right is None else right
    if "f0" in left:
        for i, j in close_pairs(left["f0"], other["f0"], spec["radius"], right is None):
            forest.add(i, j + shift)
    elif "set" in left:
        both = overlaps(left["set"], None if right is None else right["set"])
        i, j = np.nonzero(both + EPS >= spec["ratio"] * (left["n"][:, None] + other["n"][None, :] - both.astype(float)))
        forest.add(i, j + shift)
    else:
        for i, j in sized_pairs(left, other, spec["ratio"], right is None):
            i, j = apart_at_most(left, other, i, j, spec["ratio"])
            forest.add(i, j + shift)
    return forest


def sized_pairs(left: dict, right: dict, ratio: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one list (`part`) whose sizes allow the similarity, in blocks; same: right is left, each pair once."""
    wide = int(max(left["n"].max(initial=0), right["n"].max(initial=0)) / ratio) + 2
    order = np.lexsort((right["n"], right["part"]))
    key = right["part"][order] * wide + right["n"][order]
    rows = order if same else np.arange(len(left["n"]))
    n, part = left["n"][rows], left["part"][rows] * wide
    lo = np.arange(1, len(rows) + 1) if same else np.searchsorted(key, part + np.ceil(n * ratio - EPS).astype(np.int64), "left")
    hi = np.searchsorted(key, part + np.floor(n / ratio + EPS).astype(np.int64), "right")
    count = np.maximum(hi - lo, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:stop]
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(rows[at:stop], c), order[inner + np.repeat(lo[at:stop], c)]
        at = stop


def folded(tile: dict, width: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's bitmaps of `width` words, or so many times as many as the ratio allows: place by row, bitmaps folded to the width, bits set."""
    have = tile["folds"]
    if width not in have:
        words, start = tile["words"], tile["start"]
        place, parts, filled = np.full(len(words), -1), [], 0
        size, most = width, width << int(np.ceil(np.log2(1 / ratio)))
        while size <= most:
            rows = np.nonzero(words == size)[0]
            if len(rows):
                held = tile["flat"][start[rows][:, None] + np.arange(size)]
                while held.shape[1] > width:
                    half = held.shape[1] // 2
                    held = held[:, :half] ^ held[:, half:]
                place[rows] = filled + np.arange(len(rows))
                filled += len(rows)
                parts.append(held)
            size *= 2
        bits = np.concatenate(parts)
        have[width] = (place, bits, np.bitwise_count(bits).sum(1, dtype=np.int64))
    return have[width]


def apart_at_most(left: dict, right: dict, i: np.ndarray, j: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs, those whose bitmaps differ in no more bits than sets of that similarity may in elements."""
    most = np.floor((left["n"][i] + right["n"][j]) * ((1 - ratio) / (1 + ratio)) + EPS).astype(np.int64)
    width = np.minimum(left["words"][i], right["words"][j])
    close = np.zeros(len(i), bool)
    for w in np.unique(width).tolist():
        (p, a, ca), (q, b, cb) = folded(left, w, ratio), folded(right, w, ratio)
        at = np.nonzero(width == w)[0]
        x, y = p[i[at]], q[j[at]]
        near = np.abs(ca[x] - cb[y]) <= most[at]
        at, x, y = at[near], x[near], y[near]
        step = max(1, PAIR_WORDS // w)
        for k in range(0, len(at), step):
            close[at[k : k + step]] = np.bitwise_count(a[x[k : k + step]] ^ b[y[k : k + step]]).sum(1, dtype=np.int64) <= most[at[k : k + step]]
    return i[close], j[close]


# ---- tiles as rows ------------------------------------------------------------------------


def code(parts: list[Column]) -> Column:
    """Small whole numbers as one number; codes of neighbours differ by the code of their offset."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = out * 256 + p
    return out


def offsets(dims: int, radius: int) -> list[int]:
    """Codes of the offsets within `radius` in sum of differences, each direction once, zero first."""
    found = []
    for o in product(range(-radius, radius + 1), repeat=dims):
        if sum(map(abs, o)) <= radius and o >= (0,) * dims:
            n = 0
            for x in o:
                n = n * 256 + x
            found.append(n)
    return sorted(set(found), key=lambda n: (n != 0, n))


def unpacked(lists, homes=None) -> dict:
    """The columns of some tiles (a list array of rows): node, home, n and part (the number of the tile) of each row, and the fingerprints or sets."""
    rows = lists.flatten()
    got = {"node": rows.field("node").to_numpy(zero_copy_only=False), "folds": {}}
    got["home"] = got["node"] if homes is None else homes.flatten().to_numpy(zero_copy_only=False)
    got["part"] = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    names = [f.name for f in rows.type]
    if "n" in names:
        got["n"] = rows.field("n").to_numpy(zero_copy_only=False)
    if "f0" in names:
        got["f0"] = rows.field("f0").to_numpy(zero_copy_only=False).view(np.uint64)
        return got
    col = rows.field("bits" if "bits" in names else "set")
    flat, at = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    at = at - at[0]
    if "bits" in names:
        got |= {"flat": flat, "start": at[:-1], "words": np.diff(at).astype(np.int64)}
    else:
        got["set"] = [flat[x:y] for x, y in zip(at, at[1:])]
    return got


def joined_inside(packed: DataFrame, spec: dict) -> DataFrame:
    """Tiles (rows and other columns) with the home of each row, from links inside the tile; staged. Rows stay where the column `big` says so (or is absent)."""
    at = packed.columns.index("rows")
    big = packed.columns.index("big") if "big" in packed.columns else None

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, BATCH if "ratio" in spec else 1):
                lists = batch.column(at)
                groups = [lists] if lists.type.value_type.get_field_index("bits") >= 0 else [lists[i : i + 1] for i in range(len(lists))]
                nodes, homes = [], []
                for group in groups:
                    tile = unpacked(group)
                    forest = joined(tile, None, spec)
                    nodes.append(tile["node"])
                    homes.append(forest.home[forest.root])
                offsets = lists.offsets
                offsets = pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32())
                by_list = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (nodes, homes)]
                columns = list(batch.columns)
                if big is not None:
                    columns[at] = pc.if_else(batch.column(big), lists, pa.nulls(len(lists), lists.type))
                yield pa.RecordBatch.from_arrays([*columns, *by_list], names=[*batch.schema.names, "nodes", "homes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
    return staged(packed.mapInArrow(inside, f"{kinds}, nodes array<bigint>, homes array<bigint>"), "tiles", BATCH)


def homes_of(tiles: DataFrame) -> DataFrame:
    """node, home of the rows of tiles."""
    return tiles.select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("homes").alias("home"))).alias("x")).select("x.node", "x.home")


def joined_between(work: DataFrame, spec: dict) -> DataFrame:
    """Links (u, v) between the homes of pairs of tiles (left, lh, right, rh); staged."""

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big, 1):
                left, lh, right, rh = batch.columns
                u, v = joined(unpacked(left, lh), unpacked(right, rh), spec).links()
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    # Tiles of fingerprints are small; of sets they may take megabytes.
    return staged(work.mapInArrow(between, "u bigint, v bigint"), "links", BATCH if "radius" in spec else 1)


def linked(classes: DataFrame, key: Column, around: list[int], spec: dict, load: Column) -> tuple[DataFrame, DataFrame]:
    """tiles (nodes and homes: the first of each one's links' component inside its tile) and the links (u, v) between homes.

    All pairs of classes in tiles whose keys differ by one of `around` are compared. First
    each tile is joined in itself; then the pairs of tiles, dealt evenly whatever the keys'
    sizes, add links between what is still apart, so that a group of near copies leaves
    few links for each pair of tiles, not some for each copy. classes: staged; node and f0.
    load: how many tiles the classes of one key fill, an aggregate.
    """
    keyed = classes.select("node", "f0", key.alias("key"))
    # Keys are bounded in number (population counts), not by the rows.
    index = keyed.groupBy("key").agg(F.ceil(load).cast("int").alias("tiles"))
    tiled = keyed.join(F.broadcast(index), "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = joined_inside(tiled.groupBy("key", "tile").agg(F.collect_list(F.struct("node", "f0")).alias("rows")), spec)

    # A row for each left tile, dealt anew, before the right ones are named: no task makes the pairs of more than its tiles.
    left = index.select(F.col("key").alias("lk"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("li")).repartition("lk", "li")
    pairs = (
        left.withColumn("o", F.explode(F.array(*[F.lit(o).cast("long") for o in around])))
        .join(F.broadcast(index.select(F.col("key").alias("rk"), F.col("tiles").alias("rt"))), F.col("lk") + F.col("o") == F.col("rk"))
        .withColumn("ri", F.explode(F.sequence(F.lit(0), F.col("rt") - 1)))
        .where("lk <> rk or li < ri")
        .select("lk", "li", "rk", "ri")
    )
    one = tiles.select(F.col("key").alias("lk"), F.col("tile").alias("li"), F.col("rows").alias("left"), F.col("homes").alias("lh"))
    two = tiles.select(F.col("key").alias("rk"), F.col("tile").alias("ri"), F.col("rows").alias("right"), F.col("homes").alias("rh"))
    work = pairs.join(one, ["lk", "li"]).join(two, ["rk", "ri"]).select("left", "lh", "right", "rh")
    return tiles, joined_between(work, spec)


def linked_groups(wanted: DataFrame, made: Callable[[DataFrame], DataFrame], ratio: float, rows: int, load: int) -> DataFrame:
    """Links (u, v) that join all nodes of one root whose sets (or their bitmaps) are close enough.

    wanted: staged; root, node, n and what `made` takes to add the column `bits` or `set`. A
    root that fills one tile (of `rows` rows and `load` shingles) is compared in it. Else its
    sets are dealt by the logarithm of their size, tiles of sizes beyond the ratio are skipped, and

    1. each tile is compared in itself and with the first tile of its size and of the next;
    2. what lies outside the root's largest component then is compared with all its tiles.

    So all pairs that are still apart meet, and copies that were joined at once never do again.
    """
    spec = {"ratio": ratio}
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / ratio)) + EPS).cast("long")
    fill = F.greatest(F.count(F.lit(1)) / rows, F.sum("n") / load)
    large = wanted.groupBy("root").agg(fill.alias("fill")).where("fill > 1").select("root")
    index = staged(wanted.join(large, "root").groupBy("root", band.alias("band")).agg(F.ceil(fill).cast("int").alias("tiles")), "tile-index")
    several = not index.isEmpty()
    if several:
        dealt = wanted.withColumn("own", band).join(index.withColumnRenamed("band", "own"), ["root", "own"], "left").withColumn("big", F.col("tiles").isNotNull())
        dealt = dealt.withColumn("band", F.when(F.col("big"), F.col("own")).otherwise(F.lit(0).cast("long"))).withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")).drop("own", "tiles")
    else:
        dealt = wanted.select("*", F.lit(False).alias("big"), F.lit(0).cast("long").alias("band"), F.lit(0).alias("tile"))
    full = made(dealt)
    field = "bits" if "bits" in full.columns else "set"
    packed = full.groupBy("root", "big", "band", "tile").agg(F.collect_list(F.struct("node", "n", field)).alias("rows"))
    tiles = joined_inside(packed, spec)
    links = homes_of(tiles).where("node <> home").select(F.col("node").alias("u"), F.col("home").alias("v"))
    if not several:
        return links

    big = tiles.where("big").select("root", "band", "tile", "rows", "homes")
    first = big.where("tile = 0")
    first = first.select("root", "band", F.lit(0).alias("o"), F.col("rows").alias("right"), F.col("homes").alias("rh")).unionByName(first.select("root", (F.col("band") - 1).alias("band"), F.lit(1).alias("o"), F.col("rows").alias("right"), F.col("homes").alias("rh")))
    stars_ = big.join(first, ["root", "band"]).where("o = 1 or tile > 0").select(F.col("rows").alias("left"), F.col("homes").alias("lh"), "right", "rh")
    links = staged(links.unionByName(joined_between(stars_, spec)), "links")

    # Parts of components do here: what isn't known to be joined is compared.
    place = stars(links, 2).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("part"))
    each = big.select("root", "band", F.explode("rows").alias("row")).withColumn("node", F.col("row.node"))
    parted = staged(each.join(place, "node", "left").withColumn("part", F.coalesce("part", "node")).select("root", "band", "part", "row"), "parted")
    main = parted.groupBy("root", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("root").agg(F.max(F.struct("c", "part")).alias("m")).select("root", F.col("m.part").alias("main"))
    rest = parted.join(main, "root").where("part <> main")
    some = rest.groupBy("root", "band").agg(F.greatest(F.count(F.lit(1)) / rows, F.sum("row.n") / load).alias("fill")).select("root", "band", F.ceil("fill").cast("int").alias("parts"))
    apart = rest.join(some, ["root", "band"]).withColumn("piece", F.pmod(F.xxhash64("row.node"), F.col("parts")))
    pieces = apart.groupBy("root", "band", "piece").agg(F.collect_list("row").alias("left"), F.collect_list("row.node").alias("lh"))
    far = index.select("root", F.col("band").alias("far"), "tiles")
    pairs = pieces.withColumn("far", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(far, ["root", "far"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    work = pairs.join(big.select("root", F.col("band").alias("far"), "tile", F.col("rows").alias("right"), F.col("homes").alias("rh")), ["root", "far", "tile"]).select("left", "lh", "right", "rh")
    links = links.unionByName(joined_between(work, spec))
    released(wanted.sparkSession, tiles, parted, index)
    return links


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A written table whose rows carry a number, `node`, given by their place in it."""
    rows = staged(df, name)
    meta = rows.metadataColumn("_metadata")
    part = F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).cast("long")
    split = F.regexp_extract(meta["file_name"], r"-c(\d+)", 1).cast("long")
    return rows.select("*", (F.shiftleft(part, 40) + F.shiftleft(split, 32) + meta["row_index"]).alias("node"))


# ---- the two operators --------------------------------------------------------------------


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, f0: the 64-bit SimHash (as signed long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big):
                f = [signed(majority(shingle_hashes(t, k))) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.int64())], names=["id", "f0"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, f0 bigint")


def words16(f: Column) -> list[Column]:
    """Population counts of a fingerprint's four 16-bit words."""
    return [F.bit_count(F.shiftrightunsigned(f, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]


def components(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, component_id: least id reachable over links of `radius` bits or fewer."""
    prints = staged(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = numbered(prints.groupBy("f0").agg(F.min("id").alias("first")), "fingerprint-classes")
    tiles, links = linked(classes, code(words16(F.col("f0"))), offsets(4, radius), {"radius": radius}, F.count(F.lit(1)) / TILE)
    # Few homes have a link; the rest are components by themselves.
    star = stars(links)
    far = star.select(F.col("u").alias("home"), F.col("v").alias("far"))
    named = staged(labelled(classes, homes_of(tiles).join(far, "home", "left").select("node", F.coalesce("far", "home").alias("root"))).select("f0", "component_id"), "fingerprint-components")
    released(docs.sparkSession, tiles, links, star, classes)
    out = prints.join(named, "f0")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(classes: DataFrame, rooted: DataFrame) -> DataFrame:
    """classes with root (of each class's component; rooted: node, root) and component_id (its least `first`)."""
    named = classes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root")


def shared_lists(prints: DataFrame, similarity: float) -> DataFrame:
    """root (a shingle), u, n: the sets that list a shingle with others of a size that allows the similarity; of equal lists one.

    prints: u, n, prefix and hot. A rare shingle's list is sorted by size: a set without a
    neighbour in it has no partner. Shingles that were frequent in the sample aren't sorted.
    """
    posted = prints.select("u", "n", F.explode(F.arrays_zip("prefix", "hot")).alias("p")).select("u", "n", F.col("p.prefix").alias("root"), F.col("p.hot").alias("hot"))
    order = Window.partitionBy("root").orderBy("n", "u")
    before, after = F.lag("n").over(order), F.lead("n").over(order)
    near = (before + EPS >= similarity * F.col("n")) | (F.col("n") + EPS >= similarity * after)
    rare = posted.where("not hot").select("root", "u", "n", near.alias("near")).where("near").select("root", "u", "n")
    lists = staged(rare.unionByName(posted.where("hot").select("root", "u", "n")).distinct(), "lists")
    # The shingles of a passage have the same list: by count and two sums of hashes.
    same = lists.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("u")).alias("x"), F.bit_xor(F.xxhash64("u", F.lit(1))).alias("y")).where("c > 1")
    return lists.join(same.groupBy("c", "x", "y").agg(F.min("root").alias("root")).select("root"), "root")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, __crawlens_file, __crawlens_row, component_id, root (the component's own number) for every row of docs (a plain file scan or staged).

    Texts of one component are linked by shingle sets with Jaccard similarity of `similarity` or more.
    """
    rows = located(docs, "near-dup-input").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "__crawlens_file", "__crawlens_row")
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, k))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big):
                made = [np.unique(shingle_hashes(t, k)) for t in batch.column(1).to_pylist()]
                digests = pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in made], pa.binary())
                firsts, hot = zip(*(prefix(h, sent.value, similarity) for h in made))
                firsts, bits = (pa.array([x.view(np.int64) for x in c], pa.list_(pa.int64())) for c in (firsts, map(parity, made)))
                arrays = [batch.column(0), batch.column(2), batch.column(3), digests, pa.array([len(h) for h in made], pa.int64()), firsts, pa.array(hot, pa.list_(pa.bool_())), bits]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "__crawlens_file", "__crawlens_row", "digest", "n", "prefix", "hot", "bits"])

    prints = staged(rows.mapInArrow(trimmed(sketch), f"id {kind}, __crawlens_file string, __crawlens_row bigint, digest binary, n bigint, prefix array<bigint>, hot array<boolean>, bits array<bigint>"), "sketches")
    place = F.struct("id", "__crawlens_file", "__crawlens_row", "bits")
    classes = numbered(prints.groupBy("digest", "n").agg(F.min(place).alias("place"), F.min("id").alias("first")), "sketch-classes")

    lists = shared_lists(prints.select(F.xxhash64("digest").alias("u"), "n", "prefix", "hot"), similarity)
    bits = classes.select(F.xxhash64("digest").alias("u"), "node", F.col("place.bits").alias("bits"))
    members = staged(lists.join(bits, "u").select("root", "node", "n", "bits"), "members")
    links = linked_groups(members, lambda dealt: dealt, similarity, BIT_TILE, BIT_SHINGLES)
    chains = stars(links)
    grouped = chains.unionByName(chains.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("root"))
    wanted = staged(classes.select("node", "place.__crawlens_file", "place.__crawlens_row", "n").join(grouped, "node"), "candidates")
    released(docs.sparkSession, members, links, lists, chains)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big):
                made = [np.unique(shingle_hashes(t, k)).view(np.int64) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int64())), *batch.columns[1:]], names=["set", *batch.schema.names[1:]])

    def with_sets(dealt: DataFrame) -> DataFrame:
        full = rows.select("text", "__crawlens_file", "__crawlens_row").join(dealt.hint("shuffle_hash"), ["__crawlens_file", "__crawlens_row"])
        return full.select("text", "node", "n", "root", "big", "band", "tile").mapInArrow(trimmed(sets), "set array<bigint>, node bigint, n bigint, root bigint, big boolean, band bigint, tile int")

    # The sets of a group are compared exactly.
    links = linked_groups(wanted, with_sets, similarity, SET_TILE, SET_SHINGLES)
    star = stars(links)
    named = labelled(classes, star.select(F.col("u").alias("node"), F.col("v").alias("root"))).select("digest", "component_id", "root")
    out = staged(prints.join(named, "digest").select(F.col("id").alias(id_col), "__crawlens_file", "__crawlens_row", "component_id", "root"), "near-duplicates")
    released(docs.sparkSession, prints, classes, wanted, links, star)
    return out


def frequent_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the FREQUENT most frequent shingles of about SAMPLE texts."""
    parts = -(-rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("__crawlens_file", "__crawlens_row"), F.lit(max(parts, 1))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big):
                made = [np.unique(shingle_hashes(t, k)).view(np.int64) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int64()))], names=["set"])

    counted = some.mapInArrow(trimmed(run), "set array<bigint>").select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()  # a fixed number, whatever the data
    known, count = np.array([r.h for r in got], np.int64).view(np.uint64), np.array([r.n for r in got], np.int64)
    order = np.argsort(known)
    return known[order], count[order]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: that with the least id (ties: the first place)."""
    rows = located(docs, "near-dup-rows")
    named = near_duplicates(rows.drop("__crawlens_file", "__crawlens_row"), id_col=id_col, text_col=text_col)
    place = F.struct(F.col(id_col).alias("i"), "__crawlens_file", "__crawlens_row")
    stays = named.groupBy("root").agg(F.min(place).alias("stay"))
    gone = named.join(stays, "root").where((F.col("stay.__crawlens_file") != F.col("__crawlens_file")) | (F.col("stay.__crawlens_row") != F.col("__crawlens_row"))).select("__crawlens_file", "__crawlens_row")
    return rows.join(gone.hint("shuffle_hash"), ["__crawlens_file", "__crawlens_row"], "left_anti").select(*docs.columns)


