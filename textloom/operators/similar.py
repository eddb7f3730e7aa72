"""Pairs of strings that may be alike: joins that lose no pair."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.shared import Tables, small_batches

#: Rows of a key that meet in one task on one side of a join; strings of a tile; what a string of few letters may leave at most.
BLOCK, TILE, REMAINS = 2000, 8192, 512
#: Letters of a tile in millions; tiles that a small table makes anyway, and their least strings; strings by which tiles are laid out; parts at most that a side of tiles is dealt to.
LETTERS, FEW, FEWEST, SEEN, DEALT = 1 << 20, 32, 256, 32768, 24
#: Buckets of letters, groups of them, strings of a run in a tile, words of 64 bits for parts of two letters, pairs aligned at once.
BUCKETS, GROUPS, RUN, PARTS, ALIGNED = 32, 4, 64, 8, 16384


def met(left: DataFrame, right: DataFrame, keys: list[str], tables: Tables) -> DataFrame:
    """An equi join in which a key of many left rows is split: these are dealt to blocks of about BLOCK rows, and its right rows go to each."""
    hot = left.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    hot = tables.write(hot, "hot")
    one = F.coalesce("blocks", F.lit(1))
    own = F.xxhash64(*[c for c in left.columns if c not in keys])
    dealt = left.join(hot, keys, "left").withColumn("block", F.pmod(own, one).cast("int")).drop("blocks")
    again = right.join(hot, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), one - 1))).drop("blocks")
    return dealt.join(again, [*keys, "block"]).drop("block")


def _least_kept(size: int, least: float) -> int:
    """The least longest common subsequence that a string of ``size`` letters can have with any string of an indel ratio of ``least``."""
    return math.ceil(size * least / (2 - least) - 1e-9)


def short_size(least: float) -> int:
    """Up to which size strings have REMAINS different rests at most when as many letters are left out as ``least`` allows."""
    size = 0
    while sum(math.comb(size + 1, k) for k in range(size + 2 - _least_kept(size + 1, least))) <= REMAINS and size < 64:
        size += 1
    return size


def rests(strings: DataFrame, least: float) -> DataFrame:
    """(kind, side, t, gone, rest): what is left of each string when any letters are left out, ``gone`` of them, as few as an indel ratio of ``least`` to some string allows."""
    schema = "kind string, side int, t string, gone int, rest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, side, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for gone in range(len(t) - _least_kept(len(t), least) + 1):
                    rows += [(kind, side, t, gone, r) for r in set(map("".join, itertools.combinations(t, len(t) - gone)))]
                if len(rows) >= 20_000:
                    yield _batch(rows, _RESTS)
                    rows = []
            yield _batch(rows, _RESTS)

    return strings.select(F.col("kind").cast("string"), "side", "t").mapInArrow(run, schema)


_RESTS = pa.schema([("kind", pa.string()), ("side", pa.int32()), ("t", pa.string()), ("gone", pa.int32()), ("rest", pa.string())])
_PAIRS = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


def _short_pairs(short: DataFrame, least: float, tables: Tables, two: bool) -> DataFrame:
    """Pairs of short strings: a common subsequence is a rest of both. One of the two leaves out no more letters than the other, so that strings with few gone meet all."""
    rows = rests(short, least).select("kind", "side", "t", "gone", F.xxhash64("rest").alias("h"), F.floor(2 * F.length("rest") * (1 / least - 1) + 1e-9).cast("int").alias("most"))
    rows = tables.write(rows.where("gone <= most"), "rests")
    few = rows.where("2 * gone <= most")
    side = lambda df, k, x, g: df.where(F.col("side") == k).select("kind", "h", "most", F.col("t").alias(x), F.col("gone").alias(g))
    join = lambda x, y: x.join(y, ["kind", "h", "most"]).where("gone_a + gone_b <= most").select("kind", "a", "b")
    found = join(side(few, 0, "a", "gone_a"), side(rows, int(two), "b", "gone_b"))
    return found.unionByName(join(side(rows.where("2 * gone > most"), 0, "a", "gone_a"), side(few, 1, "b", "gone_b"))) if two else found


def bags(strings: list[str], q: int, buckets: int) -> np.ndarray:
    """A column for each string with how often each of its parts of q letters stands in it, by a hash: never less in common than the parts themselves."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
    of, first = np.repeat(np.arange(len(strings)), size), np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(np.arange(len(codes)) - first + q <= size[of])
    part = codes[at] if q == 1 else codes[at] * 31 + codes[at + 1]
    counts = np.bincount((part % buckets) * len(strings) + of[at], minlength=buckets * len(strings)).reshape(buckets, -1)
    return counts.astype(np.int16 if counts.max(initial=0) < 1 << 8 else np.int64)


def letter_groups(letters: np.ndarray) -> np.ndarray:
    """A group for each bucket of letters: by the signs of the directions in which the shares of letters (a row for each string) differ most. Sums of few groups tell most strings of other kinds apart, and strings near to each other in all of them can lie in one run."""
    shares = letters / np.maximum(1, letters.sum(1, keepdims=True))
    shares = shares - shares.mean(0) if len(shares) else shares
    best = np.linalg.eigh(shares.T @ shares)[1][:, -int(math.log2(GROUPS)) :]
    return ((best > 0) << np.arange(best.shape[1])).sum(1)


def _letters(strings: list[str]) -> np.ndarray:
    """A row for each string with how often each bucket of letters stands in it, 255 at most, which brings no two further apart."""
    return np.ascontiguousarray(np.minimum(bags(strings, 1, BUCKETS), 255).T.astype(np.uint8))


def _grouped(letters: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return (letters.astype(np.float32) @ np.eye(GROUPS, dtype=np.float32)[groups]).astype(np.int16)


class Tile:
    """What is compared of a tile's strings; each distance is at most that of the strings in insertions and deletions, or three times it for parts of two letters."""

    def __init__(self, strings: list[str], groups: np.ndarray):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.points, self.first = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), np.cumsum(self.sizes) - self.sizes
        self.codes = (self.points % BUCKETS).astype(np.uint8)
        self.letters = _letters(strings)
        counts, starts = _grouped(self.letters, groups), np.arange(0, len(strings), RUN)
        self.lo, self.hi, self.longest = np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts), np.maximum.reduceat(self.sizes, starts)
        # Four bits of each letter's count turn round with its steps: two counts' bits differ in as many as the counts, or in fewer beyond four.
        bits = np.packbits((self.letters[:, :, None] - np.arange(4, dtype=np.uint8)) % 8 < 4, axis=None).view(np.uint64).reshape(len(strings), -1)
        self.signs = np.pad(bits, ((0, -len(bits) % RUN), (0, 0)), "edge").T.reshape(bits.shape[1], -1, RUN)
        self._parts: np.ndarray | None = None

    def parts(self) -> np.ndarray:
        """Bits for the parts of two letters that stand in a string once or more, and twice or more, by a hash."""
        if self._parts is None:
            n = len(self.sizes)
            of = np.repeat(np.arange(n), self.sizes)
            at = np.flatnonzero(of[1:] == of[:-1])
            keys = np.sort(of[at] * (64 * PARTS) + (self.points[at].astype(np.int64) * 31 + self.points[at + 1]) % (64 * PARTS))
            again = np.concatenate([[False], keys[1:] == keys[:-1]])[: len(keys)]
            third = again & np.concatenate([[False], again[:-1]])[: len(keys)]
            out = np.zeros((n, 2, PARTS), np.uint64)
            for level, some in enumerate((keys[~again], keys[again & ~third])):
                row, bit = np.divmod(some, 64 * PARTS)
                np.bitwise_or.at(out, (row, level, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
            self._parts = out.reshape(n, -1)
        return self._parts

    def places(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in ``some``, place, code) of each letter of some strings."""
        of = np.repeat(np.arange(len(some)), self.sizes[some])
        place = np.arange(len(of)) - np.repeat(np.cumsum(self.sizes[some]) - self.sizes[some], self.sizes[some])
        return of, place, self.codes[self.first[some][of] + place]


_LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _aligned(x: Tile, y: Tile, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) have ``most`` insertions and deletions or fewer, letters of a bucket being the same.

    The rows of longest common subsequences are bits, as in ``indel_ratio``, a column for each pair. Every few letters of the
    second string those pairs go whose beginnings have left out too many already: its first k letters stand against no more
    than the k + gone first ones of the first, where gone is what that one may leave out.
    """
    mine, i = np.unique(i, return_inverse=True)
    theirs, j = np.unique(j, return_inverse=True)
    words, length = -(-int(x.sizes[mine].max()) // 64), int(y.sizes[theirs].max())
    masks = np.zeros((words, len(mine) * (BUCKETS + 1)), np.uint64)
    of, place, code = x.places(mine)
    np.bitwise_or.at(masks, (place >> 6, of * (BUCKETS + 1) + code), np.uint64(1) << (place & 63).astype(np.uint64))
    text = np.full((length, len(theirs)), BUCKETS, np.uint8)
    of, place, code = y.places(theirs)
    text[place, of] = code
    a, b = x.sizes[mine][i], y.sizes[theirs][j]
    gone, lost, base, left = (most + a - b) // 2, (most + b - a) // 2, i * (BUCKETS + 1), np.arange(len(i))
    rows = np.full((words, len(i)), _LOW[64])
    for k in range(1, length + 1):
        at = base + text[k - 1][j]
        carry = None
        for w in range(words):
            row, mask = rows[w], masks[w][at]
            hit = row & mask
            total = row + hit
            if words > 1:
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            rows[w] = total | (row ^ hit)
        if k % 8 == 0 or k == length:
            done = np.minimum(k, b)
            found = np.zeros(len(j), np.int64)
            for w in range(words):
                low = np.clip(done + gone - 64 * w, 0, 64)
                found += low - np.bitwise_count(rows[w] & _LOW[low])
            on = np.flatnonzero(found >= done - lost)
            if len(on) < len(j):
                j, b, gone, lost, base, left, rows = j[on], b[on], gone[on], lost[on], base[on], left[on], np.ascontiguousarray(rows[:, on])
            if not len(left):
                break
    return left


def tile_pairs(x: Tile, y: Tile, least: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in arrays: every pair of strings whose ratio can be ``least``; with ``same``, of one tile, those with i < j.

    The insertions and deletions that the ratio allows are no fewer than the differences in the sums of groups of letters of
    runs of strings, in letters (as bits first), and a third of those in parts of two letters, of which
    each spoils one and makes two. What is left is aligned.
    """
    allowed = lambda s: np.floor((1 - least) * s + 1e-9).astype(np.int64)
    apart = np.zeros((len(x.lo), len(y.lo)), np.int32)
    for g in range(GROUPS):
        apart += np.maximum(np.maximum(x.lo[:, g, None] - y.hi[None, :, g], y.lo[None, :, g] - x.hi[:, g, None]), 0)
    most = allowed(x.longest[:, None] + y.longest[None])
    p, q = np.nonzero((apart <= most) & (np.arange(len(x.lo))[:, None] <= np.arange(len(y.lo))) if same else apart <= most)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(p), 16):
        u, v = p[s : s + 16], q[s : s + 16]
        far = np.zeros((len(u), RUN, RUN), np.uint8)
        for mine, theirs in zip(x.signs, y.signs, strict=True):
            far += np.bitwise_count(mine[u][:, :, None] ^ theirs[v][:, None, :])
        at = np.flatnonzero(far <= np.minimum(most[u, v], 4 * BUCKETS).astype(np.uint8)[:, None, None])
        n, at = np.divmod(at, RUN * RUN)
        i, j = u[n] * RUN + at // RUN, v[n] * RUN + at % RUN
        on = np.flatnonzero((i < len(x.sizes)) & (j < len(y.sizes)) & ((i < j) | (not same)))
        i, j = i[on], j[on]
        far = allowed(x.sizes[i] + y.sizes[j])
        mine, theirs = x.letters[i], y.letters[j]
        on = np.flatnonzero((np.maximum(mine, theirs) - np.minimum(mine, theirs)).sum(1, dtype=np.int64) <= far)
        i, j, far = i[on], j[on], far[on]
        on = np.flatnonzero(np.bitwise_count(x.parts()[i] ^ y.parts()[j]).sum(1, dtype=np.int64) <= 3 * far) if len(i) else on
        found.append((i[on], j[on]))
    if not found:
        return
    i, j = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.argsort(y.sizes[j], kind="stable")
    i, j, s = i[order], j[order], 0
    while s < len(i):
        # Tables of places grow with the longest string of those that are aligned at once.
        n = max(1, min(ALIGNED, (ALIGNED << 7) // max(64, int(x.sizes[i[s : s + ALIGNED]].max()), int(y.sizes[j[s : s + ALIGNED]].max()))))
        on = s + _aligned(x, y, i[s : s + n], j[s : s + n], allowed(x.sizes[i[s : s + n]] + y.sizes[j[s : s + n]]))
        yield i[on], j[on]
        s += n


def _in_runs(counts: np.ndarray) -> np.ndarray:
    """An order in which runs of RUN strings have like counts: halves by the column that varies most, again and again."""
    out, stack = [], [np.arange(len(counts))]
    while stack:
        some = stack.pop()
        if len(some) <= RUN:
            out.append(some)
            continue
        by = some[np.argsort(counts[some, counts[some].var(0).argmax()], kind="stable")]
        half = -(-len(some) // (2 * RUN)) * RUN
        stack += [by[half:], by[:half]]
    return np.concatenate(out) if out else np.arange(0)


class Layout:
    """Groups of letters, and cuts of their sums by which strings go to tiles. Both come from some strings, and only decide which pairs of tiles can be left out; every string has its tile."""

    def __init__(self, some: list[str], tiles: float):
        letters = _letters(some)
        self.groups, self.depth = letter_groups(letters), max(0, math.ceil(math.log2(max(1, min(tiles, SEEN / 8)))))
        counts, nodes = _grouped(letters, self.groups), [np.arange(len(some))]
        self.column, self.cut = np.zeros(2**self.depth, np.int64), np.zeros(2**self.depth, np.int64)
        for node in range(2**self.depth - 1):
            here = counts[nodes[node]]
            if len(here):
                self.column[node] = here.var(0).argmax()
                self.cut[node] = np.sort(here[:, self.column[node]])[(len(here) - 1) // 2]
            over = here[:, self.column[node]] > self.cut[node]
            nodes += [nodes[node][~over], nodes[node][over]]

    def leaf(self, strings: list[str]) -> np.ndarray:
        counts, node = _grouped(_letters(strings), self.groups), np.zeros(len(strings), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (counts[np.arange(len(node)), self.column[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _tiles(strings: DataFrame, layout, tables: Tables) -> DataFrame:
    """(kind, id, longest, lo, hi, t) of (kind, t): about TILE strings of one leaf in a row, with the bounds of their groups' sums. A leaf of more is dealt by a hash."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(layout.value.leaf(b.column(1).to_pylist()), pa.int64())], ["kind", "t", "leaf"])

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        kept = part.column("t").to_pylist()
        counts = _grouped(_letters(kept), layout.value.groups)
        row = [key[0].as_py(), (key[1].as_py() << 32) + key[2].as_py(), max(map(len, kept)), counts.min(0).tolist(), counts.max(0).tolist(), [kept[k] for k in _in_runs(counts).tolist()]]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], ["kind", "id", "longest", "lo", "hi", "t"])

    laid = tables.write(strings.select("kind", "t").mapInArrow(leaves, "kind string, t string, leaf long"), "laid")
    parts = laid.groupBy("kind", "leaf").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("t")) / LETTERS)).cast("int").alias("parts"))
    dealt = laid.join(parts, ["kind", "leaf"]).select("kind", "leaf", F.pmod(F.xxhash64("t"), "parts").cast("long").alias("part"), "t")
    out = tables.write(dealt.groupBy("kind", "leaf", "part").applyInArrow(pack, "kind string, id long, longest int, lo array<int>, hi array<int>, t array<string>"), "tiles")
    tables.drop(laid)
    return out


def _no_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kind string, a string, b string")


def _long_pairs(left: DataFrame, right: DataFrame, least: float, layout, tables: Tables, half: bool = False) -> DataFrame:
    """(kind, a, b) of tiles: pairs of tiles meet in a product of the parts that both sides are dealt to, which is not written, if the sums of their groups of letters let any pair be alike. With ``half`` both sides are the same and each pair of tiles meets once."""
    sizes = [side.count() for side in (left, right)]
    if not all(sizes):
        return _no_pairs(left.sparkSession)
    dealt = lambda side, n: side.repartition(min(DEALT, math.ceil(math.sqrt(2 * n))))
    a, b = (dealt(side, n).select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)) for side, n, x in ((left, sizes[0], "a"), (right, sizes[1], "b")))
    bound = lambda g: F.greatest(F.lit(0), F.col("lo_a")[g] - F.col("hi_b")[g], F.col("lo_b")[g] - F.col("hi_a")[g])
    test = (F.col("kind_a") == F.col("kind_b")) & (sum((bound(g) for g in range(1, GROUPS)), bound(0)) <= (1 - least) * (F.col("longest_a") + F.col("longest_b")) + 1e-9)
    if half:
        test = test & (F.col("id_a") <= F.col("id_b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, last = layout.value.groups, (None, None)
        for batch in batches:
            for kind, m, n, p, r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if last[0] != (kind, m):
                    last = (kind, m), Tile(p, groups)
                x = last[1]
                y = x if half and m == n else Tile(r, groups)
                for i, j in tile_pairs(x, y, least, half and m == n):
                    yield _batch([(kind, p[k], r[h]) for k, h in zip(i.tolist(), j.tolist(), strict=True)], _PAIRS)

    pairs = a.join(b.hint("shuffle_replicate_nl"), test).select("kind_a", "id_a", "id_b", "t_a", "t_b")
    with small_batches(left.sparkSession, 1):
        return tables.write(pairs.mapInArrow(meet, "kind string, a string, b string"), "long")


def near_pairs(strings: DataFrame, least: float, tables: Tables, other: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(kind, a, b) with a < b: every pair of distinct strings (kind, t) whose indel ratio can be ``least``; the ratio itself is yet to be computed. With ``other``, every such pair of a string a and another string b of those.

    Two short strings meet in a longest common subsequence, which both leave when few letters are left out: their number
    grows with the strings, not with their pairs. Long ones have too many such rests, and their parts are common to most of
    them: all pairs of tiles compare their letters, but for tiles that are too far apart, and nothing is written for a pair of tiles.
    ``most`` is the size up to which strings are short; with 0 all lie in tiles, which is less work for words up to some millions.
    """
    if not 0 < least <= 1:
        raise ValueError("the least ratio lies between 0 and 1")
    kind = strings.schema["kind"].dataType
    sided = strings.select("kind", F.lit(0).alias("side"), "t")
    if other is not None:
        sided = sided.unionByName(other.select("kind", F.lit(1).alias("side"), "t"))
    sided = tables.write(sided.select(F.col("kind").cast("string").alias("kind"), "side", "t", F.length("t").alias("size")).where("size > 0").distinct(), "sided")
    most, two = short_size(least) if most is None else min(most, short_size(least)), other is not None
    reach = _least_kept(most + 1, least)
    size = F.col("size")
    found = [_short_pairs(sided.where(size <= most), least, tables, two)] if most else []
    n = sided.where(size > most).count()
    if n:
        tiled = sided.where(size >= reach)
        some = tiled.where(F.pmod(F.xxhash64("kind", "t"), F.lit(1 + n // SEEN)) == 0).limit(SEEN).select("t")
        layout = strings.sparkSession.sparkContext.broadcast(Layout([r.t for r in some.collect()], max(n / TILE, min(FEW, n / FEWEST))))
        of = lambda side, test: _tiles(tiled.where((F.col("side") == side) & test), layout, tables)
        long = [of(s, size > most) for s in range(1 + two)]
        found.append(_long_pairs(long[0], long[-1], least, layout, tables, not two))
        if reach <= most:
            short = [of(s, size <= most) for s in range(1 + two)]
            found += [_long_pairs(x, y, least, layout, tables) for x, y in [(long[0], short[-1]), *([(short[0], long[1])] if two else [])]]
    pairs = reduce(DataFrame.unionByName, found or [_no_pairs(strings.sparkSession)])
    a, b = (F.col("a"), F.col("b")) if two else (F.least("a", "b"), F.greatest("a", "b"))
    return pairs.where("a <> b").select(F.col("kind").cast(kind).alias("kind"), a.alias("a"), b.alias("b")).distinct()


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (both lengths), by the longest common subsequence, whose row is one whole number's bits."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & every
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def columns(strings: list[str], most: int) -> np.ndarray:
    """A column for each string with the buckets of its letters, ``most`` of them at most; beyond its end stands one that no letter has."""
    some = [t[:most] for t in strings]
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    out, of = np.full((sizes.max(initial=0), len(some)), BUCKETS, np.uint8), np.repeat(np.arange(len(some)), sizes)
    out[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of] = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32) % BUCKETS
    return out


def in_common(a: str, text: np.ndarray) -> np.ndarray:
    """The longest common subsequence of a string of up to 64 letters with each of the ``columns``, letters of a bucket being the same; as in ``indel_ratio``, but all columns at once."""
    places = np.zeros(BUCKETS + 1, np.uint64)
    for k, x in enumerate(a):
        places[ord(x) % BUCKETS] |= np.uint64(1 << k)
    rows = np.full(text.shape[1], _LOW[64])
    for line in text:
        hit = rows & places[line]
        rows = (rows + hit) | (rows ^ hit)
    return 64 - np.bitwise_count(rows).astype(np.int64)


def ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def holding(strings: DataFrame, tables: Tables) -> DataFrame:
    """(kind, a, b): every pair in which b holds a, another string. They meet in a's rarest three letters, or in all of a shorter one."""
    size = F.length("t")
    sized = lambda q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - (q - 1))), lambda i: F.substr("t", i, F.lit(q))))
    parts = strings.where(size >= 3).select("kind", "t", F.explode(sized(3)).alias("gram"))
    counts = parts.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    own = tables.write(parts.join(counts, ["kind", "gram"]).groupBy("kind", "t").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")), "rarest")
    short = tables.write(strings.where(size.between(1, 2)).select("kind", F.col("t").alias("gram")), "short")
    few = strings.where(size > 1).select("kind", "t", F.explode(F.array_union(sized(1), F.when(size > 2, sized(2)).otherwise(F.array().cast("array<string>")))).alias("gram")).join(short, ["kind", "gram"], "left_semi")
    of = own.select("kind", "gram", F.col("t").alias("a")).unionByName(short.select("kind", "gram", F.col("gram").alias("a")))
    pairs = met(parts.unionByName(few).withColumnRenamed("t", "b"), of, ["kind", "gram"], tables)
    return pairs.where((F.col("a") != F.col("b")) & F.contains("b", "a")).select("kind", "a", "b").distinct()


def sharing_words(strings: DataFrame, tables: Tables) -> DataFrame:
    """(kind, a, b) with a < b: every pair that shares over half of the words of both together. Over half of each one's words are shared, so that they meet in one of its rarer half."""
    words = tables.write(strings.select("kind", "t", F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != "")).alias("words")).select("kind", "t", F.size("words").alias("size"), F.explode("words").alias("word")), "words")
    counts = words.groupBy("kind", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind", "t").orderBy("n", "word")
    rare = words.join(counts, ["kind", "word"]).withColumn("k", F.row_number().over(order)).where("k <= size - size div 2")
    rare = tables.write(rare.select("kind", "word", "t", "size"), "rare")
    a, b = (rare.select("kind", "word", F.col("t").alias(x), F.col("size").alias(f"size_{x}")) for x in "ab")
    return met(a, b, ["kind", "word"], tables).where("a < b and 2 * least(size_a, size_b) > greatest(size_a, size_b)").select("kind", "a", "b").distinct()
