"""BPE with word ends: encoding by a contiguous rank array per word, and decoding.

A text is cut at special tokens, normalised (NFC, lower case code point by code point) and split into words; each
word's bytes become symbols, the last with the word-end mark. Encoding a word holds its symbols and the ranks of adjacent pairs in two flat lists, finds the least
rank, merges there, deletes the boundary and looks up the two neighbouring ranks again. That is quick
for short words and quadratic in a word's length, so words above ``LONG`` symbols take a heap over
linked symbols instead, with the same result (least rank first, leftmost among equals).

Row-local: no shuffle. Null and empty texts have no tokens; rows may repeat and ids may be null; columns other than the two
named don't matter, and an empty table gives no rows. The vocabulary file is a parameter; the driver reads it and sends it to the
workers, so executors needn't see it.

Letters, digits and lower case are those of the library's Unicode tables: what ``regex`` knows beyond them splits like symbols, and
what Python's ``str.lower`` doesn't know yet is mapped here.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, map_rows

LONG = 200
#: Words whose ids a worker keeps; the store starts afresh when it is full.
CACHE_WORDS = 200_000
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


# Code points (first, last) that are letters or digits in newer tables only; capitals (first, last, distance) that
# Python's tables lack.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
_LOWER = {c: c + distance for first, last, distance in CAPITALS for c in range(first, last + 1)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """A printable character for every byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(0x100 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


def _latin(text: str) -> bool:
    """Whether all code points are below 256; quicker than any search for others."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordBpe:
    """Encoder and decoder over the text of one vocabulary file (JSON: normaliser, splitter, merges, vocabulary)."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        model = spec["model"]
        self.unknown: int | None = model["vocab"].get(model.get("unk_token"))
        self.fuse_unknown: bool = bool(model.get("fuse_unk"))
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.label = {i: str(i) for i in self.token}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.symbols = byte_symbols()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace("\\s", _WHITE)
        self.word = regex.compile(pattern)
        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        self.newer = regex.compile(f"[{later}{''.join(map(chr, _LOWER))}]")
        for name in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(name, f"[{name}--[{later}]]")
        self.older_word = regex.compile("(?V1)" + pattern)
        self.words = _Words(self.encode_word)

    def encode_word(self, word: str) -> tuple[int, ...]:
        names = [self.symbols[b] for b in word.encode("utf-8")]
        names[-1] += self.end
        ids = []
        for i in map(self.vocab.get, names):
            if i is not None:
                ids.append(i)
            elif self.unknown is not None and not (self.fuse_unknown and ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
        return tuple(self._scan(ids) if len(ids) <= LONG else self._heap(ids))

    def _scan(self, ids: list[int]) -> list[int]:
        never = (1 << 60, 0)
        look = self.pairs.get
        ranks = [look(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is never or best[0] == never[0]:
                break
            at = ranks.index(best)
            ids[at] = best[1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = look((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = look((ids[at], ids[at + 1]), never)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n, look = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(*found, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := look((a, b)))]
        heapq.heapify(heap)
        heap.sort(key=lambda x: (x[0], x[2]))
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (found := look((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, found[1], ids[left], ids[right]))
        return [x for x, ok in zip(ids, alive) if ok]

    def _plain(self, text: str) -> list[str]:
        # words hold no white space, so putting one space for a run of it, as the normaliser does, would change none of them
        text = unicodedata.normalize("NFC", text)
        # str.lower looks at a capital sigma's neighbours; code point by code point it doesn't
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if not text.isascii() and not _latin(text) and self.newer.search(text):
            return self.older_word.findall(text.translate(_LOWER))
        return self.word.findall(text)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        words = self.words
        if not any(token in text for token in self.special):
            return list(chain.from_iterable(map(words.__getitem__, self._plain(text))))
        out: list[int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(words.__getitem__, self._plain(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary file names no decoder. Unknown ids are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.label.__getitem__, ids))


def read_vocabulary(path: str | None = None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


_made: dict[int, WordBpe] = KEPT.setdefault("bpe", {})


def tokenizer(text: str) -> WordBpe:
    """One per worker and vocabulary."""
    key = hash(text)
    if key not in _made:
        _made[key] = WordBpe(text)
    return _made[key]


def _shared(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row per document."""
    vocabulary = _shared(docs, path)

    def run(rows):
        bpe = tokenizer(vocabulary.value)
        for key, body in rows:
            yield key, bpe.encode(body or "")

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), run, f"`{doc_id}` {kind}, ids array<int>", keeps="bpe")


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) from token ids; null ids give an empty text."""
    vocabulary = _shared(tokens, path)

    def run(rows):
        bpe = tokenizer(vocabulary.value)
        for key, found in rows:
            yield key, bpe.decode(found or [])

    kind = tokens.schema[doc_id].dataType.simpleString()
    return map_rows(tokens.select(doc_id, ids), run, f"`{doc_id}` {kind}, text string", keeps="bpe")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass."""
    vocabulary = _shared(docs, path)

    def run(rows):
        bpe = tokenizer(vocabulary.value)
        for key, body in rows:
            ids = bpe.encode(body or "")
            yield key, len(ids), sha256(bpe.ids_text(ids).encode()).hexdigest(), sha256(bpe.decode(ids).encode()).hexdigest()

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), run, f"`{doc_id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", keeps="bpe")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import tables

    return digests(tables(spark, sf_dir, "documents").select("doc_id", F.col("text")))
