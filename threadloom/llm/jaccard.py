"""N-gram Jaccard join by parity sketches: documents whose sets of word 5-grams reach 0.75.

Texts become sets of 64-bit shingle hashes. Documents with equal sets form a class, a node of the join; ids only
name the result, so they may be of any type that has an order, null, or repeated with other texts.

A set's parity sketch is a string of bits: each shingle flips the bit that its hash names. Two sketches differ in at
most as many bits as the sets differ in shingles (the Hamming distance is a lower bound of the symmetric
difference), and that stays so when a sketch is folded onto itself by XOR. Sets A, B that reach 0.75 differ in at
most (|A| + |B|) / 7 shingles, so beyond that Hamming distance a pair is out.

Sketches are used at two widths. At 2^48 bits, held as the list of the bits that are set, they are cut into blocks, as
many as belong to the set's size band; by the pigeonhole principle a pair within ``distance`` agrees in some block
among any ``distance + 1`` blocks of each that aren't empty. With the blocks of all sets in one common order, rarest
contents first, it agrees among the first ``distance + 1`` of both (contents found once count as blocks but can't
agree). These leading blocks are joined by their contents, so a band's candidates meet there. Folded to ``FOLD``
bits or more a shingle of the band, sketches are dense, and their Hamming distance (XOR, count of bits) screens the
candidates. What is left is verified on the whole sets.

A set takes part in its own size band and in the one below if sets of three quarters of its size fall there,
so that any two sets that can link meet in the band of the smaller.

Ahead of that, a screen takes the classes with a chance: of a class's ``SCREEN`` least shingle hashes at least
``SCREEN_HITS`` must be among the least ones of another class. At 0.75, the least hashes of the union lie in
both with probability 0.75 each, so a linked pair fails the screen with a probability under 1e-17, about that
of two shingles having one hash.

Components come without all pairs of a group. In a few rounds each class is verified against one partner, the
class that leads most of its blocks (by another order each round); the partner's set goes once to each group of at
most about ``LED`` classes that it leads. Blocks whose classes are in one component are done. Where several components
still share a block, its classes are dealt into cells of about ``CELL`` shingles, and any two cells meet in one task. A
first pass brings dense sketches only and screens by Hamming distance. Where it leaves few pairs, at most two for each class
in the task, these are verified one by one; else the classes that are left meet again with their sets, are verified, and the task
puts out no more links than it takes to join components: at most one for each class it holds. So no link is lost
and no table of pairs grows faster than the blocks do; a task's size is bounded whatever the block's.

``link_counts`` counts each class's links in the same way, cells of one component meeting two at a time; counts leave
the tasks, not pairs. A class of a component too large for one cell goes as its difference from the component's core, the
shingles that most of its classes hold, so near copies cost what they differ in. Comparing within a component of g
different near copies takes g^2 comparisons by nature; they are array operations inside tasks of bounded size.

A null text, or one without words, has no shingles and links with nothing; its component is its own id. An empty table gives an
empty result; a text of any length is one set, and its blocks go one by one. A class or
component is named by the least id among its rows that isn't null, null if there is none.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, map_rows
from .components import connected

SHINGLE = 5
SIM_NUM, SIM_DEN = 75, 100
SCREEN, SCREEN_HITS = 48, 7
SMALL = 64
FOLD = 4
ROUNDS = 3
#: Classes that a partner is verified against in one group, about.
LED = 512
#: Shingles of a cell, about; a task holds two cells.
CELL = 1 << 18
#: So few classes of a block are compared one by one.
FEW = 8
#: Texts are found by a broadcast of up to so many digests of 16 bytes, else by a join.
BROADCAST_TEXTS = 1_000_000
#: Bytes of all cores of large components up to which they are broadcast.
BROADCAST_CORES = 1 << 26
#: What a class weighs in a cell of differences beside the shingles of its own, so that equal ones don't pile up.
ROW = 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes of words that are hashed together.
HASH_BYTES = 1 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(32)
    return x


_BLANK = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _C[4])
_POWERS = np.cumprod(np.full(LONG_WORD, _C[0]))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x if new.all() else x[new]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, each first turned into a 64-bit number; of long words xxhash.

    Words go as arrays of about ``HASH_BYTES`` at a time.
    """
    import xxhash

    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if raw and not blank[0]:
        edges = np.r_[0, edges]
    if raw and not blank[-1]:
        edges = np.r_[edges, len(raw)]
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        own = np.frombuffer(raw, np.uint8, high - low, low)[~blank[low:high]]
        sizes = ends[at:to] - starts[at:to]
        first = np.cumsum(sizes) - sizes
        place = np.minimum(np.arange(len(own)) - np.repeat(first, sizes), LONG_WORD - 1)
        out[at:to] = np.add.reduceat(_BYTES[own] * _POWERS[place], first)
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[at + k] = xxhash.xxh64_intdigest(raw[starts[at + k] : ends[at + k]])
        at = to
    return _mix(out)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text in order; A-Z lower-cased, words split at ASCII white space."""
    h = word_hashes((text or "").encode("utf-8").lower())
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return _mix(np.array([sum((int(x) * int(c) for x, c in zip(h, _C)), len(h)) & (2**64 - 1)], np.uint64))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _C[0]
    for k in range(1, SHINGLE):
        total += h[k : k + n] * _C[k]
    return _distinct(_mix(total))


def set_key(s: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(_mix(s ^ _C[1])) if len(s) else np.uint64(0)
    b = np.bitwise_xor.reduce(_mix(s ^ _C[2])) if len(s) else np.uint64(0)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def band_of(n: int) -> int:
    return 0 if n <= SMALL else int((n - 1) // SMALL).bit_length()


def bands_of(n: int) -> list[int]:
    """The bands a set of ``n`` shingles takes part in."""
    return sorted({band_of(n), band_of(-(-n * SIM_NUM // SIM_DEN))})


def max_distance(n: int) -> int:
    """Most shingles in which a set of ``n`` differs from one that it links with, of any size."""
    larger = n * SIM_DEN // SIM_NUM
    return (n + larger) * (SIM_DEN - SIM_NUM) // (SIM_DEN + SIM_NUM)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """The bits set in the 2^48-bit parity sketch of a set, ascending: those that an odd number of shingles flip."""
    bits, flips = np.unique(s >> np.uint64(16), return_counts=True)
    return bits[flips % 2 == 1]


def block_keys(bits: np.ndarray, band: int) -> np.ndarray:
    """One hash of place and contents for each block of a wide sketch that has a bit set.

    Band 0 has a block for each bit, band k >= 1 has 64 * 2^k of them.
    """
    if band == 0:
        return _mix(bits ^ _C[3])
    if not len(bits):
        return bits
    places = bits >> np.uint64(48 - 6 - band)
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    contents = np.bitwise_xor.reduceat(_mix(bits), first)
    return _mix(contents ^ _mix(places[first] * _C[0] + np.uint64(band)))


def folded(sets: list[np.ndarray], band: int) -> np.ndarray:
    """The sketches of ``sets`` folded to ``FOLD * SMALL * 2^band`` bits, a row of 64-bit words each."""
    width = FOLD * SMALL << band
    flips = np.zeros((len(sets), width), np.uint8)
    for row, s in zip(flips, sets):
        row[:] = np.bincount(((s >> np.uint64(16)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def hamming(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many).sum(axis=1, dtype=np.int64)


def near(m, n, distance):
    """Whether sets of ``m`` and ``n`` shingles that differ in no less than ``distance`` can link."""
    return (SIM_DEN + SIM_NUM) * distance <= (SIM_DEN - SIM_NUM) * (m + n)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIM_DEN * both >= SIM_NUM * (len(a) + len(b) - both)


class Overlaps:
    """Exact overlaps of each of the ``left`` sets with all of the ``right`` ones, on the shingles that two of them share."""

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray]):
        self.sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
        every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
        shared, place, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
        self.n_shared = int((count > 1).sum())
        ids = rank[place]
        ends = np.cumsum(np.r_[0, self.sizes[0], self.sizes[1]])
        own = np.repeat(np.arange(len(left) + len(right)), np.r_[self.sizes[0], self.sizes[1]])
        ok = ids >= 0
        self.ids = [ids[a:b][ok[a:b]] for a, b in zip(ends[: len(left)], ends[1 : len(left) + 1])]
        at, whose = ids[ends[len(left)] :], own[ends[len(left)] :] - len(left)
        at, whose = at[at >= 0], whose[at >= 0]
        order = np.argsort(at, kind="stable")
        self.whose = whose[order]
        self.starts = np.searchsorted(at[order], np.arange(self.n_shared + 1))
        self.n_right = len(right)

    def of(self, i: int) -> np.ndarray:
        """How many shingles the ``i``-th left set shares with each right one."""
        a, b = self.starts[self.ids[i]], self.starts[self.ids[i] + 1]
        n = b - a
        if not n.sum():
            return np.zeros(self.n_right, np.int64)
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.bincount(self.whose[at], minlength=self.n_right)

    def linked(self, i: int) -> np.ndarray:
        both = self.of(i)
        return (both > 0) & (SIM_DEN * both >= SIM_NUM * (self.sizes[0][i] + self.sizes[1] - both))


def profiles(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t1, t2, n, h1, h2, least): digests of the text, set size, set digest, and the least hashes of every row."""

    def run(rows):
        for key, t1, t2, body in rows:
            s = shingles(body)
            yield (key, t1, t2, len(s), *set_key(s), s[:SCREEN].view(np.int64).copy())

    kind = docs.schema[doc_id].dataType.simpleString()
    ready = docs.select(F.col(f"`{doc_id}`"), *text_digest(F.col(f"`{text}`")), F.col(f"`{text}`"))
    return map_rows(ready, run, f"id {kind}, t1 bigint, t2 bigint, n bigint, h1 bigint, h2 bigint, least array<bigint>")


def text_digest(text) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _screen(classes: DataFrame) -> DataFrame:
    rows = classes.select("node", "n", F.explode("least").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    hits = rows.join(shared, "key", "left_semi").groupBy("node", "n").count()
    need = F.least(F.lit(SCREEN_HITS), F.ceil(F.col("n") * 3 / 8))
    return hits.where(F.col("count") >= need).select("node")


def _sets(docs: DataFrame, text: str, wanted: DataFrame, broadcast_texts: int) -> DataFrame:
    """(node, n, s): the whole sets of the classes ``wanted`` (node, t1, t2), each once; ``s`` holds the hashes in order, packed."""
    known = F.broadcast(wanted) if wanted.count() <= broadcast_texts else wanted
    t1, t2 = text_digest(F.col(f"`{text}`"))
    found = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(f"`{text}`").alias("body")).join(known, ["t1", "t2"])

    def run(rows):
        for node, body in rows:
            s = shingles(body)
            if len(s):
                yield node, len(s), s.tobytes()

    sets = cut(map_rows(found.select("node", "body"), run, "node bigint, n bigint, s binary").withColumn("row", F.monotonically_increasing_id()))
    # rows with equal texts come as often as they are; of each class one stays
    first = sets.groupBy("node").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = cut(sets.select("node", "row").join(first.select("node", F.col("row").alias("first")), "node").where("row <> first").select("row"))
    if again.isEmpty():
        return sets
    once = cut(sets.join(again, "row", "left_anti"))
    discard(sets, again)
    return once


def _band(n):
    """``band_of`` as a column."""
    return F.when(n <= SMALL, F.lit(0)).otherwise(F.length(F.bin(F.floor((n - 1) / SMALL).cast("long"))))


def _leading_blocks(sets: DataFrame) -> DataFrame:
    """(key, band, node, n): per set and band the blocks that a partner must agree with in one.

    What is known of a set and band goes in one number with each block: size, number of blocks filled, whether the band is the lower one.
    """

    def run(rows):
        for node, n, raw in rows:
            bits = wide_sketch(np.frombuffer(raw, np.uint64))
            for band in bands_of(n):
                keys = block_keys(bits, band)
                yield node, n << 32 | len(keys) << 1 | (band != band_of(n)), keys.view(np.int64)

    sketch = cut(map_rows(sets.select("node", "n", "s"), run, "node bigint, own bigint, keys array<bigint>"))
    rows = sketch.select("node", "own", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1").withColumnRenamed("count", "size")
    shared = rows.join(sizes, "key")
    own = Window.partitionBy("node", "own")
    n, filled = F.shiftright("own", 32), F.shiftright(F.col("own").bitwiseAND(0xFFFFFFFF), 1)
    larger = F.floor(n * SIM_DEN / SIM_NUM)
    distance = F.floor((n + larger) * (SIM_DEN - SIM_NUM) / (SIM_DEN + SIM_NUM))
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("size", "key"))).withColumn("some", F.count(F.lit(1)).over(own))
    lead = ranked.where(F.col("rank") <= distance + 1 - (filled - F.col("some")))
    lower = F.ceil(n * SIM_NUM / SIM_DEN)
    band = _band(F.when(F.col("own").bitwiseAND(1) == 1, lower).otherwise(n))
    lead = cut(lead.select("key", band.cast("int").alias("band"), "node", n.alias("n")).distinct())
    discard(sketch)
    return lead


def _dealt(rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` on the rows of each group, as one list; rows of a group meet in a task, which holds one group at a time.

    The last of ``keys`` orders the rows within a group and isn't part of it.
    """
    width = len(keys) - 1

    def run(found):
        for _, group in groupby(found, key=lambda r: r[:width]):
            yield from fn(group)

    others = [c for c in rows.columns if c not in keys]
    return map_rows(rows.select(*keys, *others).repartition(*keys[:-1]).sortWithinPartitions(*keys), run, schema)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (band, a, b) whose sets link.

    A partner's set goes once to each group of the sets it is verified against, however many these are.
    """
    groups = F.ceil(F.col("led") / LED).cast("int")
    load = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("led")).select("a", groups.alias("groups"))
    partners = load.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("led"), F.col("a").alias("b"), F.lit(0).alias("band"), "s")
    members = pairs.join(load, "a").select("a", "b", "band", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("part"))
    members = members.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("led"), "b", "band", "s")

    def run(group):
        first, sketches = None, {}
        for a, _, led, b, band, raw in group:
            s = np.frombuffer(raw, np.uint64)
            if not led:
                first = s
                continue
            if band not in sketches:
                sketches[band] = folded([first], band)
            if near(len(first), len(s), int(hamming(sketches[band][0], folded([s], band))[0])) and links(first, s):
                yield a, b

    return _dealt(partners.union(members), ["a", "part", "led"], run, "a bigint, b bigint")


def _cells(rows: DataFrame, what: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """``rows`` (keys, node, n, ...) dealt so that any two of a group meet, each with its row of ``what``: adds one, two, side.

    A group's classes lie in cells of about ``CELL`` shingles; each goes to all pairs of cells that hold its own.
    """
    size = rows.groupBy(*keys).agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells"))
    at = rows.join(size, keys).withColumn("own", F.pmod(F.xxhash64("node"), "cells").cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    at = at.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    return at.drop("own", "other", "cells").join(what, on)


def _sides(group, one: int) -> tuple[list, list]:
    """The rows of the first cell, and of the second; a cell that meets itself is both. ``one``: where a row has its first cell."""
    sides: tuple[list, list] = ([], [])
    for row in group:
        sides[row[one + 2]].append(row[one:])
        same = row[one] == row[one + 1]
    return sides[0], sides[0] if same else sides[1]


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, band, sketch): the folded sketches of each set, one for each of its bands."""

    def run(rows):
        for node, raw in rows:
            found = np.frombuffer(raw, np.uint64)
            for band in bands_of(len(found)):
                yield node, band, folded([found], band).tobytes()

    return map_rows(sets.select("node", "s"), run, "node bigint, band int, sketch binary")


def _could_link(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, band, a, b): pairs across the components of a block that Hamming distances don't rule out; where a task
    has more than two such pairs for each of its classes, these classes (as ``a``) instead, with a null ``b``."""

    def run(group):
        group = list(group)
        left, right = _sides(group, 2)
        if not left or not right:
            return
        key, band = group[0][:2]
        if left is right and len(left) <= FEW:
            bits = [int.from_bytes(r[6], "little") for r in left]
            for i, r in enumerate(left):
                for j in range(i):
                    o = left[j]
                    if r[4] != o[4] and min(r[5], o[5]) * SIM_DEN >= max(r[5], o[5]) * SIM_NUM and near(r[5], o[5], (bits[i] ^ bits[j]).bit_count()):
                        yield key, band, r[3], o[3]
            return
        mine, theirs = (np.frombuffer(b"".join(r[6] for r in side), np.uint64).reshape(len(side), -1) for side in (left, right))
        n_mine, n_theirs = (np.array([r[5] for r in side]) for side in (left, right))
        comp_mine, comp_theirs = (np.array([r[4] for r in side]) for side in (left, right))
        same, most, found, some = left is right, 2 * len(group), [], set()
        for i in range(len(left)):
            n = n_mine[i]
            start = i + 1 if same else 0
            sizes = n_theirs[start:]
            at = start + np.flatnonzero((comp_theirs[start:] != comp_mine[i]) & (np.minimum(n, sizes) * SIM_DEN >= np.maximum(n, sizes) * SIM_NUM))
            at = at[near(n, n_theirs[at], hamming(mine[i], theirs[at]))]
            if not len(at):
                continue
            if len(found) <= most:
                found += [(left[i][3], right[j][3]) for j in at.tolist()]
            some.add(left[i][3])
            some.update(right[j][3] for j in at.tolist())
        if len(found) <= most:
            yield from ((key, band, a, b) for a, b in found)
        else:
            yield from ((key, band, node, None) for node in some)

    dealt = _cells(rows, sketches, ["key", "band"], ["node", "band"]).select("key", "band", "one", "two", "side", "node", "comp", "n", "sketch")
    return _dealt(dealt, ["key", "band", "one", "two", "side"], run, "key bigint, band int, a bigint, b bigint")


def _joining_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of each block of ``rows`` (key, band, node, n, comp), enough to join them."""

    def run(group):
        left, right = _sides(group, 2)
        comps, label = np.unique([r[4] for r in left] + [r[4] for r in right], return_inverse=True)
        if len(comps) < 2 or not left or not right:
            return
        mine, theirs = label[: len(left)].copy(), label[len(left) :].copy()
        exact = Overlaps(*([np.frombuffer(r[5], np.uint64) for r in side] for side in (left, right)))
        for i in range(len(left)):
            if (theirs == mine[i]).all():
                continue
            for j in np.flatnonzero(exact.linked(i)).tolist():
                if theirs[j] != mine[i]:
                    yield left[i][3], right[j][3]
                    gone, stays = theirs[j], mine[i]
                    mine[mine == gone] = stays
                    theirs[theirs == gone] = stays

    could = cut(_could_link(rows, _sketches(sets)))
    found = _verify(could.where("b is not null").select("band", "a", "b").distinct(), sets)
    crowds = cut(rows.join(could.where("b is null").select("key", "band", F.col("a").alias("node")).distinct(), ["key", "band", "node"], "left_semi"))
    dealt = _cells(crowds, sets.select("node", "s"), ["key", "band"], ["node"]).select("key", "band", "one", "two", "side", "node", "comp", "s")
    joining = cut(found.union(_dealt(dealt, ["key", "band", "one", "two", "side"], run, "a bigint, b bigint")).distinct())
    discard(could, crowds)
    return joining


def cores(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(comp, core): per component of ``rows`` (comp, node, members) the shingles that more than half of its classes hold, packed.

    A core is at most twice as large as the component's mean set, however many classes there are.
    """

    def unpack(found):
        for comp, members, raw in found:
            yield comp, members, np.frombuffer(raw, np.int64)

    def pack(found):
        for comp, core in found:
            yield comp, np.sort(np.array(core, np.int64).view(np.uint64)).tobytes()

    held = rows.join(sets.select("node", "s"), "node").select("comp", "members", "s")
    held = map_rows(held, unpack, "comp bigint, members bigint, keys array<bigint>").select("comp", "members", F.explode("keys").alias("key"))
    often = held.groupBy("comp", "members", "key").count().where(F.col("count") * 2 > F.col("members"))
    return map_rows(often.groupBy("comp").agg(F.collect_list("key").alias("core")), pack, "comp bigint, core binary")


def differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(comp, node, n, size, lacks, core, d): each class of ``rows`` (comp, node, members) by its difference from its component's core.

    ``d`` holds the shingles in which the two differ, ``lacks`` how many of these are the core's; ``core`` is its size and ``size`` the
    set's. ``n`` is what the row weighs in a cell.
    """
    core = cut(cores(rows, sets))
    volume = core.agg(F.sum(F.length("core"))).first()[0] or 0

    def run(found):
        for comp, node, raw, common in found:
            s, c = np.frombuffer(raw, np.uint64), np.frombuffer(common or b"", np.uint64)
            d = np.setxor1d(s, c, assume_unique=True)
            yield comp, node, len(d) + ROW, len(s), (len(d) + len(c) - len(s)) // 2, len(c), d.tobytes()

    whole = rows.join(sets.select("node", "s"), "node").join(F.broadcast(core) if volume <= BROADCAST_CORES else core, "comp", "left")
    kind = "comp bigint, node bigint, n bigint, size bigint, lacks bigint, core bigint, d binary"
    return map_rows(whole.select("comp", "node", "s", "core"), run, kind)


def link_counts(comp: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n_links): how many other classes each class of ``comp`` (node, comp) links with. Two alone have their one link.

    Components of one cell go to a task once. Classes of larger ones go to each pair of cells as differences from their component's core,
    which of near copies are a small part of the sets; two of them share core - lacks - lacks shingles and those that are in both differences.
    """

    def run(group):
        left, right = _sides(group, 1)
        if not left or not right:
            return
        exact, same = Overlaps(*([np.frombuffer(r[7], np.uint64) for r in side] for side in (left, right))), left is right
        n, lacks, back = np.array([r[4] for r in right], np.int64), np.array([r[5] for r in right], np.int64), np.zeros(len(right), np.int64)
        for i, r in enumerate(left):
            both = exact.of(i) + (r[6] - r[5] - lacks)
            found = (both > 0) & (SIM_DEN * both >= SIM_NUM * (r[4] + n - both))
            links = int(found.sum()) - same
            if links:
                yield r[3], links
            if not same:
                back += found
        for j in np.flatnonzero(back).tolist():
            yield right[j][3], int(back[j])

    members = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    rows = cut(comp.join(members, "comp").join(sets.select("node", "n"), "node").select("comp", "node", "n", "members"))
    several = rows.where("members > 2")
    large = several.groupBy("comp").agg(F.sum("n").alias("all")).where(F.col("all") > CELL).select("comp")
    here = [F.lit(0).alias(c) for c in ("one", "two", "side")]
    zero = F.lit(0).cast("long")
    shape = ["comp", "one", "two", "side", "node", "size", "lacks", "core", "d"]
    dealt = several.join(large, "comp", "left_anti").join(sets.select("node", F.col("n").alias("size"), F.col("s").alias("d")), "node")
    dealt = dealt.select("comp", *here, "node", "size", zero.alias("lacks"), zero.alias("core"), "d")
    crowds = cut(several.join(large, "comp", "left_semi"))
    if not crowds.isEmpty():
        small = cut(differences(crowds, sets))
        dealt = dealt.union(_cells(small.select("comp", "node", "n"), small.select("node", "size", "lacks", "core", "d"), ["comp"], ["node"]).select(*shape))
    counts = _dealt(dealt, ["comp", "one", "two", "side"], run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n_links"))
    return counts.union(rows.where("members = 2").select("node", F.lit(1).cast("long")))


def _size_fits(m: str, n: str):
    return (F.col(m) * SIM_DEN >= F.col(n) * SIM_NUM) & (F.col(n) * SIM_DEN >= F.col(m) * SIM_NUM)


def _open_blocks(lead: DataFrame, comp: DataFrame) -> DataFrame:
    """Leading blocks with the component of each class, where a block has more than one."""
    rows = lead.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return rows.join(several, "key", "left_semi")


def _merged(comp: DataFrame, found: DataFrame) -> DataFrame:
    """``comp`` after links (a, b) between classes. The links and (class, component) are one graph."""
    return connected(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(found.select("a", "b")))


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """``_merged``, written; what it was made of is deleted."""
    after = cut(_merged(comp, found))
    discard(found, *[comp] * hasattr(comp, "_cut_path"))
    return after


def components(sets: DataFrame) -> DataFrame:
    """(node, comp) for the classes that link with another: ``comp`` is the least node reachable."""
    spark = sets.sparkSession
    lead = _leading_blocks(sets)
    comp = spark.createDataFrame([], "node bigint, comp bigint")
    for r in range(ROUNDS):
        rows = cut(_open_blocks(lead, comp))
        order = F.struct(F.xxhash64("node", F.lit(r)).alias("o") if r else F.col("node").alias("o"), "node", "n", "comp")
        first = rows.groupBy("key").agg(F.min(order).alias("f")).select("key", F.col("f.node").alias("a"), F.col("f.n").alias("m"), F.col("f.comp").alias("other"))
        met = rows.join(first, "key").where((F.col("node") != F.col("a")) & (F.col("comp") != F.col("other")) & _size_fits("m", "n"))
        best = met.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("count"), F.min("band").alias("band"))
        best = cut(best.groupBy("b").agg(F.max(F.struct("count", "a", "band")).alias("f")).select("b", "f.a", "f.band"))
        found = cut(_verify(best, sets))
        discard(rows, best)
        if found.isEmpty():
            break
        comp = _joined(comp, found)
    rows = cut(_open_blocks(lead, comp))
    found = _joining_links(rows, sets)
    if not found.isEmpty():
        comp = _joined(comp, found)
    discard(lead, rows)
    return comp


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: bool = True, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """(id, t1, t2, n_shingles, class_id, component_id, n_links, component), one row per row of ``docs``.

    ``class_id`` is the least id with exactly this set, ``component_id`` the least id reachable by links, ``n_links`` the
    number of other sets that this one links with (null unless ``counts``). ``component`` tells components apart whatever their ids; it
    is null for rows without shingles. ``t1``, ``t2``: see ``text_digest``; with the id they name a row.
    """
    seen = cut(profiles(docs, doc_id, text))
    known = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    group = seen.where("n > 0").groupBy("n", "h1", "h2").agg(F.min(known).alias("f"), F.min("least").alias("least"))
    classes = cut(group.select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", F.col("f.id").alias("id"), "f.t1", "f.t2", "least"))
    ids = _screen(classes)
    wanted = cut(classes.join(ids, "node", "left_semi").select("node", "t1", "t2"))
    sets = _sets(docs, text, wanted, broadcast_texts)
    comp = components(sets)
    links = link_counts(comp, sets) if counts else docs.sparkSession.createDataFrame([], "node bigint, n_links bigint")
    named = classes.select("node", "n", "h1", "h2", "id").join(comp, "node", "left").join(links, "node", "left")
    written = named = cut(named.withColumn("component", F.coalesce("comp", "node")))
    discard(classes, wanted, sets)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select(
        F.col("n").alias("n_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.col("id").alias("class_id"), "component", "component_id", "n_links"
    )
    same = (F.col("n") == F.col("n_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
    out = seen.select("id", "t1", "t2", "n", "h1", "h2").join(named, same, "left")
    alone = F.col("n") == 0
    out = out.select(
        "id", "t1", "t2", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))) if counts else F.lit(None)).cast("long").alias("n_links"), "component",
    )
    out._cuts = (seen, written)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """(id, n_shingles, class_id, component_id, n_links), one row per row of ``docs``."""
    return grouped(docs, doc_id, text, True, broadcast_texts).drop("t1", "t2", "component")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of least id (null last), of least text digest among equals.

    Rows are told apart by id and text, not by id alone; of rows equal in both, one stays. Rows without shingles all stay.
    """
    rows = grouped(docs, doc_id, text, counts=False)
    found = rows.where("component is not null")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    first = found.groupBy("component").agg(F.min(row).alias("f"))
    keys = ["_nd_k", "_nd_1", "_nd_2"]
    stay = cut(first.select(F.xxhash64("f.none", "f.id").alias(keys[0]), F.col("f.t1").alias(keys[1]), F.col("f.t2").alias(keys[2])))
    discard(*rows._cuts)
    t1, t2 = text_digest(F.col(f"`{text}`"))
    has_words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike("[^ \\t-\\r]")
    keyed = docs.where(has_words).withColumns({keys[0]: F.xxhash64(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`")), keys[1]: t1, keys[2]: t2})
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = keyed.join(stay, keys, "left_semi").withColumn("_nd_row", F.row_number().over(order)).where("_nd_row = 1")
    return kept.drop(*keys, "_nd_row").unionByName(docs.where(~has_words))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    found = near_duplicates(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id", "n_links")
