"""Suffix-array dedup by prefix-free parsing: bytes covered by a 200-byte string found twice.

A rolling hash over 8-byte grams triggers: the trigger of a window of ``MATCH`` bytes is the gram of least
hash among its first ``REACH`` grams. Consecutive windows mostly share their trigger, so triggers cut a text
into phrases of about ``REACH / 2`` bytes, and a window's trigger depends on the window's bytes alone: equal
windows, wherever they stand, have their trigger at the same place. A phrase is taken with all bytes of all its
windows, so each window lies in one phrase and phrases tell everything about their windows.

What a suffix array over dictionary and parse decides is which windows are neighbours in corpus order with a
common prefix of ``MATCH`` bytes. Only equality at that depth matters here, so the order is never laid out as
one array (it would be one object as large as the corpus): windows are ranked into classes of equal bytes,
in four steps from coarse to fine, each a distributed count.

1. *Dictionary*: for each trigger, the ``MATCH - REACH + 1`` bytes from it on. An entry counted once can't lie
   in a repeated window, and with it go all windows of that trigger.
2. *Parse*: for each trigger left, the phrase. A phrase counted twice settles all its windows at once; this is the common case
   in repetitive text.
3. *Blocks*: of the phrases left, and of one representative of each repeated phrase with the same entry, runs of
   ``BLOCK`` windows are ranked in the same way. A window that holds a whole entry counted once, at a trigger
   further on, is out beforehand.
4. *Suffixes*: windows of the blocks left, and of one representative of each repeated block, are ranked one by one.

Steps 2 to 4 say where what they count stands (a digest of the text, and the place in it), so what is repeated is found by
joins on the keys and gathered per text. What a step leaves to the next is told to the tasks by a bit filter of fixed size
(``FILTER_BITS``), whatever the number of keys: a filter can only let too much through, which then is counted as well and
changes nothing. So there is one plan at every size, and no key set goes through the driver. Counts
combine before the shuffle, so a passage in a third of all documents is a few rows per map task.

Keys are 64-bit hashes; a window is removed if a key that covers it occurs twice and its dictionary entry does. Null and
short texts (under ``MATCH`` bytes) lose nothing. Matches never cross documents. Rows with equal
texts, whatever their ids, lose all their bytes if they have ``MATCH`` of them. Columns may have any names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, map_rows, ship

MATCH = 200
GRAM = 8
REACH = 96
BLOCK = 8
#: Texts are parsed together up to so many bytes.
BUFFER = 1 << 17
ENTRY = MATCH - REACH + 1
#: Bits of a filter, 16 MB.
FILTER_BITS = 1 << 27

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ENTRY_SEED, _CONTEXT_SEED, _BLOCK_SEED, _WINDOW_SEED = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD6E8FEB86659FD93))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(name: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64, at least ``n`` of them."""
    have = _powers[name]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have), 1 << 16), _BASE if name == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


class Ranges:
    """Runs of windows ``low``..``high`` of one trigger each, with the key of what they share, their own key and place."""

    def __init__(self, low, high, at, parent, place):
        self.low, self.high, self.at, self.parent, self.place = low, high, at, parent, place

    def pick(self, which: np.ndarray) -> Ranges:
        return Ranges(self.low[which], self.high[which], self.at[which], self.parent[which], self.place[which])

    def starts(self) -> np.ndarray:
        n = self.high - self.low + 1
        return np.repeat(self.low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)

    def blocks(self) -> Ranges:
        """The windows at the same multiple of ``BLOCK`` bytes ahead of their trigger, run by run."""
        first, last = (self.at - self.high) // BLOCK, (self.at - self.low) // BLOCK
        n = last - first + 1
        own = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + first[own] if len(n) else np.zeros(0, np.int64)
        at = self.at[own]
        step = k.astype(np.uint64) + np.uint64(1)
        low, high = np.maximum(self.low[own], at - k * BLOCK - (BLOCK - 1)), np.minimum(self.high[own], at - k * BLOCK)
        return Ranges(low, high, at, _mix(self.parent[own] + step * np.uint64(_BASE)), _mix(self.place[own] + step))


class Parsed:
    """Texts parsed side by side: the triggers of all of them, and hashes of any stretch of one text.

    Triggers past those of a text's last window count as long as their entry fits; they have no windows.
    """

    def __init__(self, raws: list[bytes], uids: list[int]):
        buffer = b"".join(raws)
        sizes = np.array([len(r) for r in raws])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        grams = np.ndarray((len(buffer) - GRAM + 1,), "<u8", buffer, strides=(1,)).astype(np.uint64)
        h = _mix(grams)
        v = h & ~np.uint64(127)
        for d in (1, 2, 4, 8, 16, 32):
            v = np.minimum(v[:-d], v[d:] + np.uint64(d))
        v = np.minimum(v[:-32], v[32:] + np.uint64(32))
        at = np.arange(len(v)) + (v & np.uint64(127)).astype(np.int64)
        for end in self.ends[:-1].tolist():  # windows of grams that would reach into the next text
            at[end - (REACH + GRAM - 2) : end] = -1
        low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        high = np.r_[low[1:], len(at)] - 1
        at = at[low]
        text = np.searchsorted(self.ends, at, "right")
        fits = (at >= 0) & (at + ENTRY <= self.ends[np.minimum(text, len(sizes) - 1)])
        low, high, at, text = low[fits], high[fits], at[fits], text[fits]
        high = np.minimum(high, self.ends[text] - MATCH)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power("up", len(h))[: len(h)], out=self.sums[1:])
        self.down = _power("down", len(buffer))
        entry = _mix(self.hash(at, at + ENTRY) ^ _ENTRY_SEED)
        place = _mix((at - self.begins[text]).astype(np.uint64) * np.uint64(_BASE) ^ np.array(uids, np.int64).view(np.uint64)[text])
        self.triggers = Ranges(low, high, at, entry, place)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes start..end, at least ``GRAM`` of them."""
        return (self.sums[end - GRAM + 1] - self.sums[start]) * self.down[start]

    def live(self, repeated: np.ndarray) -> Ranges:
        """Triggers with repeated entries, and their windows that hold no other entry."""
        t = self.triggers
        once = np.flatnonzero(~repeated)
        bar = np.r_[t.at[once] - REACH, np.iinfo(np.int64).max][np.searchsorted(once, np.arange(len(t.at)))]
        high = np.minimum(t.high, bar)
        return Ranges(t.low, high, t.at, t.parent, t.place).pick(repeated & (high >= t.low))

    def keys(self, r: Ranges, seed: np.uint64) -> np.ndarray:
        """Of all bytes of the windows of each range."""
        shape = ((r.at - r.low) << 8 | (r.at - r.high)).astype(np.uint64)
        return _mix(self.hash(r.low, r.high + MATCH) ^ _mix(r.parent + shape) ^ seed)

    def whose(self, starts: np.ndarray) -> np.ndarray:
        """Which of the texts each place is in."""
        return np.searchsorted(self.ends, starts, "right")

    def suffixes(self, starts: np.ndarray) -> np.ndarray:
        return _mix(self.hash(starts, starts + MATCH) ^ _WINDOW_SEED)


class Filters:
    """The bit filters there are so far, by name; a step without its filter lets everything through."""

    def __init__(self, found: dict[str, np.ndarray]):
        self.found = found

    def has(self, name: str, keys: np.ndarray) -> np.ndarray:
        words = self.found[name]
        at = keys & np.uint64(64 * len(words) - 1)
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _fold(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of a column ``key``: at most ``bits`` bits come to the driver, however many keys there are."""
    place = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = place.groupBy(F.expr("cast(shiftright(at, 6) as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


#: Columns of what each step counts, besides the two of the text's digest.
COLUMNS = {"entry": ("key",), "phrase": ("parent", "key", "place", "low", "high"), "block": ("parent", "key", "place", "low", "high"), "window": ("key",), "place": ("key", "low")}


def _keys(p: Parsed, step: str, filters: Filters) -> tuple[np.ndarray, ...]:
    """What a step counts, in the order of ``COLUMNS``; places are within all texts of ``p``."""
    if step == "entry":
        return (p.triggers.parent,)
    r = p.live(filters.has("entry", p.triggers.parent))
    keys = p.keys(r, _CONTEXT_SEED)
    if step == "phrase":
        return r.parent, keys, r.place, r.low, r.high
    r = r.pick(filters.has("phrase", keys) | filters.has("phrase", r.place)).blocks()
    keys = p.keys(r, _BLOCK_SEED)
    if step == "block":
        return r.parent, keys, r.place, r.low, r.high
    starts = r.pick(filters.has("block", keys) | filters.has("block", r.place)).starts()
    keys = p.suffixes(starts)
    if step == "window":
        return (keys,)
    known = filters.has("window", keys)
    return keys[known], starts[known]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of bytes in windows that start at ``low`` to ``high``, for all (low, high)."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + MATCH)
        else:
            out.append([low, high + MATCH])
    return [(a, b) for a, b in out]


def _buffers(rows):
    """Lists of rows (…, bytes) whose bytes together reach ``BUFFER``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digest(text) -> tuple:
    """Two columns that name a text."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("u1"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("u2")


def _emit(docs: DataFrame, text: str, step: str, shared: dict) -> DataFrame:
    """What a step counts, a row each; from step 2 on with the text's digest, and places within the text."""
    import pyarrow as pa

    names = list(COLUMNS[step])
    placed = "low" in names
    schema = pa.schema([(f, pa.int64()) for f in names + (["u1", "u2"] if placed else [])])

    def texts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(2)[i].as_py()
                if body and len(raw := body.encode()) >= MATCH:
                    yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), raw

    def run(batches):
        filters = Filters({name: b.value for name, b in shared.items()})
        held, size = [], 0
        for rows in _buffers(texts(batches)):
            u1, u2, raws = map(list, zip(*rows))
            p = Parsed(raws, u1)
            found = dict(zip(names, _keys(p, step, filters)))
            if placed:
                own = p.whose(found["low"])
                for name in ("low", "high"):
                    if name in found:
                        found[name] = found[name] - p.begins[own]
                found |= {"u1": np.array(u1, np.int64)[own], "u2": np.array(u2, np.int64)[own]}
            held.append([found[f.name].view(np.int64) for f in schema])
            size += len(held[-1][0])
            if size >= 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)

    ship(docs.sparkSession)
    rows = docs.select(*_digest(F.col(f"`{text}`")), F.col(f"`{text}`").alias("body"))
    return rows.mapInArrow(run, ", ".join(f"{f.name} bigint" for f in schema))


def repeated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(u1, u2, runs): for each text with repeated windows the runs (low, high) of places where these start."""
    spark, bits = docs.sparkSession, FILTER_BITS
    shared: dict[str, object] = {}

    def learn(name: str, keys: DataFrame) -> None:
        shared[name] = spark.sparkContext.broadcast(_fold(keys, bits))

    learn("entry", _emit(docs, text, "entry", shared).groupBy("key").count().where("count > 1").select("key"))
    spans = []
    for step in ("phrase", "block"):
        rows = cut(_emit(docs, text, step, shared))
        ranked = cut(rows.groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")))
        # of a parent with several keys, those counted once go on, and one representative of each that is counted more often
        open_ = ranked.groupBy("parent").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("parent")
        left = ranked.join(open_, "parent", "left_semi").select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.col("place")).alias("key"))
        learn(step, left)
        settled = ranked.where("n > 1").select("parent", "key")
        spans.append(cut(rows.join(settled, ["parent", "key"], "left_semi").select("u1", "u2", "low", "high").distinct()))
        discard(rows, ranked)
    windows = cut(_emit(docs, text, "window", shared).groupBy("key").count().where("count > 1").select("key"))
    learn("window", windows)
    single = _emit(docs, text, "place", shared).join(windows, "key", "left_semi")
    spans.append(single.select("u1", "u2", "low", F.col("low").alias("high")))
    every = spans[0].union(spans[1]).union(spans[2])
    found = cut(every.groupBy("u1", "u2").agg(F.collect_set(F.struct("low", "high")).alias("runs")))
    discard(windows, *spans[:2])
    return found


def _finish(docs: DataFrame, text: str, keep: list[str], fn, schema: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    found = repeated(docs, text).select(F.col("u1").alias("_sfx_v1"), F.col("u2").alias("_sfx_v2"), F.col("runs").alias("_sfx_runs"))
    u1, u2 = _digest(F.col(f"`{text}`"))
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_sfx_text"), u1.alias("_sfx_u1"), u2.alias("_sfx_u2"))
    rows = rows.join(found, (F.col("_sfx_u1") == F.col("_sfx_v1")) & (F.col("_sfx_u2") == F.col("_sfx_v2")), "left")

    def run(batch):
        for row in batch:
            *kept, whole, runs = row
            raw = (whole or "").encode()
            yield (*kept, *fn(whole, raw, merged([(r["low"], r["high"]) for r in runs]) if runs else []))

    kept = "".join(f"`{k}` {kinds[k]}, " for k in keep)
    return map_rows(rows.select(*[F.col(f"`{k}`") for k in keep], "_sfx_text", "_sfx_runs"), run, kept + schema)


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in runs:
        out.append(raw[at:start])
        at = end
    out.append(raw[at:])
    return b"".join(out)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document."""

    def fn(_, raw, runs):
        kept = without(raw, runs)
        return len(raw), len(raw) - len(kept), len(runs), sha256(kept).hexdigest()

    return _finish(docs, text, [doc_id], fn, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (a code point cut in two goes whole); null stays null."""
    keep = [c for c in docs.columns if c != text]

    def fn(whole, raw, runs):
        return (None if whole is None else whole if not runs else without(raw, runs).decode("utf-8", "ignore"),)

    return _finish(docs, text, keep, fn, f"`{text}` string").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    return report(tables(spark, sf_dir, "documents").select("doc_id", "text"))
