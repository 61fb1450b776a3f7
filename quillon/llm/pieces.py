"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of the byte-fallback vocabulary are taken from an agenda, best score
first.  Each candidate that comes up is skipped with the dropout rate, by a keyed
hash of (seed, document, place of the word in the text, number of the skip), so a
document's segmentation is reproducible, and each occurrence of a word is cut by
itself.  The hash gives how many candidates pass until the next skip.  With rate 0
the ids are the library's own.  Whatever is skipped, the pieces spell the text,
and decoding gives it back, byte by byte.

No piece has a space after another character, so words are encoded one by one.
The agendas of many words advance together, one candidate of each word a step, in
arrays: a candidate is the least pair of a word, and its two pieces become one.  A
bounded cache holds what words become when nothing is skipped, and how many
candidates that takes; occurrences that skip something are cut anew each time.

Edge cases: null and empty texts have no ids; characters outside the vocabulary,
and the sign that stands for a space, become bytes; very long words have an agenda
of their own, and very long texts are one row like others; repeated rows each give
a row, alike if id and text are; null ``doc_id`` is allowed; pieces of one score
are taken from the left; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of
from .tokens import Pool, offsets_of, ragged, reordered, steps

RATE, SEED = 0.1, 4_099
#: Words that the cache holds, and the longest word there.
CACHE_WORDS, CACHE_CHARS = 400_000, 48
#: Widths of the arrays in which words are cut, and their cells.
WIDTHS, CELLS = (6, 9, 12, 16, 24, 48), 1 << 20
MARKS = ".,;:!?%$#&*|"
MASK = (1 << 64) - 1
NEVER = 1 << 62
GOLDEN, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Symbols below this are pieces; others are characters that are none.
NONE, SYMBOL_BITS = np.iinfo(np.int32).max, 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """What two symbols become, in a table of open addresses."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        left, right = np.array(list(pairs), np.int64).reshape(-1, 2).T
        keys, values = (left << SYMBOL_BITS) | right, np.array(list(pairs.values()), np.int32)
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that the pairs become, ``NONE`` where there is no such piece."""
        keys = (left.astype(np.int64) << SYMBOL_BITS) | right
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            held = self.keys[at[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out


class Pieces:
    """The vocabulary, with spaces as spaces."""

    def __init__(self, path: str | None = None, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        spelled: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                spelled.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                spelled.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.ids[piece], self.scores[piece] = i, -model.get_score(i)
                spelled.append(piece.encode())
        self.spelled = Pool(np.uint8)
        self.spelled.extend(np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled]))
        # The place of each piece in the order of scores; pieces of one score share it.
        worth = np.full(self.size, np.inf)
        worth[list(self.ids.values())] = list(self.scores.values())
        self.rank = np.unique(worth, return_inverse=True)[1].astype(np.int32)
        symbol = lambda p: self.ids.get(p, self.size + ord(p) if len(p) == 1 else -1)
        pairs = {(a, b): i for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0}
        self.pairs = Pairs(pairs)
        marks = set(MARKS)
        self.breaks = not any("\n" in p for p in self.ids)
        self.over = [p for p in self.ids if any(a.isalnum() and b in marks for a, b in zip(p, p[1:], strict=False))]
        self.rate, self.seed = rate, seed
        self.scale = 0.0 if rate >= 1 else 1 / math.log1p(-rate) if rate > 0 else -float(NEVER)
        self.parts, self.chars, self.plain = Pool(np.int64), Pool(np.int32), Pool(np.uint32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # a word's parts
        self.numbers: dict[str, int] = {}  # a part's characters, and its ids if nothing is skipped
        self.left, self.strings = np.zeros(0, np.int64), []
        for pool in (self.parts, self.chars, self.plain):
            pool.clear()

    def gap(self, keys: np.ndarray) -> np.ndarray:
        """Candidates that pass before a skip: geometric, from a hash."""
        u = ((mixed(keys) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) / (1 << 53)
        return np.minimum(np.log(u) * self.scale, NEVER).astype(np.int64)

    def part_keys(self, key: int, n: int) -> np.ndarray:
        """The keys of the n parts of a text, whose key this is."""
        return np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)

    def gaps(self, key: int) -> Iterator[int]:
        """All gaps of one part of a text, whose key this is."""
        for k in itertools.count():
            yield int(self.gap(np.array([(key ^ k * OTHER) & MASK], np.uint64))[0])

    def merged(self, word: str, passing: Iterable[int]) -> list[str]:
        """The pieces and single characters that the agenda leaves of one word, of any length.

        ``passing``: how many candidates pass before the first skip, the second ...
        """
        part: list[str] = list(word)
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, gaps = self.scores, iter(passing)
        until, skipped = next(gaps), set()
        agenda = [(scores[p], i, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in scores]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != piece or (i, piece) in skipped:
                continue
            if not until:
                skipped.add((i, piece))
                until = next(gaps)
                continue
            until -= 1
            part[i], part[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + part[k]) in scores:
                    heapq.heappush(agenda, (scores[p], i, p))
            h = before[i]
            if h >= 0 and (p := part[h] + piece) in scores:
                heapq.heappush(agenda, (scores[p], h, p))
        return [p for p in part if p]

    def packed(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def cut(self, numbers: np.ndarray, until: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, their number, and the merges of each of these parts.

        ``until``: candidates that pass before the first skip; ``keys`` give the
        gaps after it.
        """
        size = self.chars.length[numbers]
        order = np.argsort(size, kind="stable")
        found, lengths, merges = [], np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        edges = np.searchsorted(size[order], WIDTHS, "right")
        for width, a, b in zip(WIDTHS, np.concatenate([[0], edges]), edges, strict=False):
            for at in range(a, b, max(1, CELLS // width)):
                rows = order[at : min(b, at + max(1, CELLS // width))]
                symbols, lengths[rows], merges[rows] = self.advanced(numbers[rows], size[rows], width, until[rows], keys[rows])
                found.append(symbols)
        ends = offsets_of(lengths[order])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat = ragged(flat, ends[:-1][back], lengths)
        if (flat >= self.size).any():  # characters that become bytes
            owner = np.repeat(np.arange(len(lengths)), lengths)
            odd = np.unique(flat[flat >= self.size])
            pool = Pool(np.uint32)
            for s in odd.tolist():
                ids = [self.byte_ids[x] for x in chr(s - self.size).encode()]
                pool.extend(np.array(ids, np.uint32), np.array([len(ids)]))
            base = pool.extend(np.arange(self.size, dtype=np.uint32), np.ones(self.size, np.int64))
            flat, many = pool.take(np.where(flat >= self.size, np.searchsorted(odd, flat), flat + base))
            lengths = np.bincount(owner, many, len(lengths)).astype(np.int64)
        return flat.astype(np.uint32), lengths, merges

    def advanced(self, numbers: np.ndarray, size: np.ndarray, width: int, until: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols left of parts of at most ``width`` characters, and their numbers of symbols and merges."""
        n = len(numbers)
        row, column = np.repeat(np.arange(n), size), np.arange(int(size.sum())) - np.repeat(offsets_of(size)[:-1], size)
        symbol = np.full((n, width), -1, np.int32)
        symbol[row, column] = ragged(self.chars.values, self.chars.start[numbers], size)
        after, before = np.tile(np.arange(1, width + 1, dtype=np.int8), (n, 1)), np.tile(np.arange(-1, width - 1, dtype=np.int8), (n, 1))
        joined, rank = np.full((n, width), NONE, np.int32), np.full((n, width), NONE, np.int32)
        pair = column + 1 < size[row]
        self.look(symbol, joined, rank, row[pair], column[pair], column[pair] + 1)
        until, skips, merges = until.copy(), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        live, place = np.arange(n), np.arange(n)
        while len(live):
            i = rank[live].argmin(axis=1)
            some = rank[live, i] != NONE
            live, i = live[some], i[some]
            skip = until[live] == 0
            if skip.any():
                r = live[skip]
                rank[r, i[skip]] = NONE
                skips[r] += np.uint64(1)
                until[r] = self.gap(keys[r] ^ (skips[r] * np.uint64(OTHER)))
                r, i = live[~skip], i[~skip]
            else:
                r = live
            until[r] -= 1
            merges[r] += 1
            j = after[r, i]
            symbol[r, i], symbol[r, j] = joined[r, i], -1
            rank[r, j] = NONE
            k = after[r, j]
            after[r, i] = k
            more = k < size[r]
            before[r[more], k[more]] = i[more]
            rank[r[~more], i[~more]] = NONE
            self.look(symbol, joined, rank, r[more], i[more], k[more])
            h = before[r, i]
            less = h >= 0
            self.look(symbol, joined, rank, r[less], h[less], i[less])
        whole = symbol >= 0
        return symbol[whole], whole.sum(axis=1), merges

    def look(self, symbol: np.ndarray, joined: np.ndarray, rank: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """What stands at ``left`` and ``right`` of each row, as a candidate at ``left``."""
        found = self.pairs.of(symbol[row, left], symbol[row, right])
        joined[row, left] = found
        rank[row, left] = np.where(found == NONE, NONE, self.rank[np.minimum(found, self.size - 1)])

    @staticmethod
    def words(text: str) -> list[str]:
        """Parts over whose borders no piece goes: each begins with its spaces.

        A space is put before the text, as the vocabulary wants it.
        """
        if not text:
            return []
        out: list[str] = []
        for w in text.split(" "):
            if w or not out:
                out.append(" " + w)
            else:
                out.append(" ")
        return joined_spaces(out) if " " in out else out

    def parts_of(self, word: str) -> list[str]:
        """The parts of a word that are cut by themselves.

        No piece goes over a line break, nor (but for ``self.over``) from a
        letter or digit to a mark.
        """
        bare = word.rstrip(MARKS)
        if "\n" in word and self.breaks and word != "\n":
            first, *rest = word.split("\n")
            return [x for p in [first, *[x for r in rest for x in ("\n", r)]] if p for x in self.parts_of(p)]
        if bare != word and bare[-1:].isalnum() and not any(p in word for p in self.over):
            return [*self.parts_of(bare), word[len(bare) :]]
        return [word]

    def learn(self, words: list[str]) -> None:
        """Put new words, and their parts, into the cache."""
        held = pa.array(words, pa.large_string())
        odd = pc.match_substring(held, "\n")
        for piece in self.over:
            odd = pc.or_(odd, pc.match_substring(held, piece))
        bare = pc.utf8_rtrim(held, MARKS)
        marked = pc.and_(pc.and_not(pc.not_equal(bare, held), odd), pc.match_substring_regex(bare, "[\\p{L}\\p{N}]$"))
        firsts = pc.if_else(marked, bare, held).to_pylist()
        lists: list[list[str] | None] = [None] * len(words)  # of words that are not one part
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            lists[k] = self.parts_of(words[k])
        for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            lists[k] = [firsts[k], words[k][len(firsts[k]) :]]
        flat = [p for f, x in zip(firsts, lists, strict=True) for p in (x or (f,))]
        new = [p for p in dict.fromkeys(flat) if p not in self.numbers]
        first = self.chars.n
        self.numbers.update(zip(new, range(first, first + len(new)), strict=True))
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4")
        spelling, back = np.unique(points, return_inverse=True)
        symbols = np.array([self.ids.get(chr(x), self.size + x) for x in spelling.tolist()], np.int32)
        self.chars.extend(symbols[back], np.array([len(p) for p in new], np.int64))
        self.strings += [p if len(p) > CACHE_CHARS else None for p in new]
        # A part too long for the arrays has no ids here; it is cut at each place where it stands.
        short = np.array([len(p) <= CACHE_CHARS for p in new], bool)
        numbers = np.arange(first, first + len(new))
        ids, lengths, merges = self.cut(numbers[short], np.full(int(short.sum()), NEVER), np.zeros(int(short.sum()), np.uint64))
        every, left = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        every[short], left[short] = lengths, merges
        self.plain.extend(ids, every)
        self.left = np.concatenate([self.left[:first], left])
        first = self.parts.extend(np.array([self.numbers[p] for p in flat], np.int64), np.array([len(x) if x else 1 for x in lists]))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def batch(self, texts: pa.Array, variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and each text's offsets; ``variants``: any number for each."""
        wide = pc.match_substring_regex(texts, "^ |  | $|^$").to_numpy(zero_copy_only=False)
        return reordered(texts, wide, lambda some, odd, which: self.some(some, variants[which], odd))

    def some(self, texts: pa.Array, variants: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_WORDS or self.chars.n > CACHE_WORDS or self.chars.used > 16 * CACHE_WORDS:
            self.clear()
        if odd:
            lists = [self.words(t) for t in texts.to_pylist()]
            words, offsets, space = pa.array([w for x in lists for w in x], pa.large_string()), offsets_of(np.array([len(x) for x in lists], np.int64)), ""
        else:
            cut = pc.split_pattern(texts, " ")
            words, offsets, space = cut.flatten(), cut.offsets.to_numpy().astype(np.int64), " "
        coded = words.dictionary_encode()
        keys = [space + w for w in coded.dictionary.to_pylist()]
        if new := [w for w in keys if w not in self.known]:
            self.learn(new)
        numbers = np.array([self.known[w] for w in keys], np.int64)[coded.indices.to_numpy()]
        parts, many = self.parts.take(numbers)
        places = offsets_of(many)[offsets]  # the parts of each text
        count = np.diff(places)
        start, length = self.plain.start[parts], self.plain.length[parts]
        varied = np.zeros(len(parts), bool)
        keys_ = np.zeros(0, np.uint64)
        if self.rate:
            text_keys = np.array([xxhash.xxh3_64_intdigest(struct.pack("<Q", v), seed=self.seed) for v in variants.astype(np.uint64).tolist()], np.uint64)
            place = np.arange(len(parts)) - np.repeat(places[:-1], count)
            keys_ = np.repeat(text_keys, count) + (place + 1).astype(np.uint64) * np.uint64(GOLDEN)
            first = self.gap(keys_)
            varied = first < self.left[parts]
        pool = self.plain.values[: self.plain.used]
        if varied.any():
            ids, lengths, _ = self.cut(parts[varied], first[varied], keys_[varied])
            start[varied], length[varied] = offsets_of(lengths)[:-1] + len(pool), lengths
            pool = np.concatenate([pool, ids])
        far = np.flatnonzero(self.chars.length[parts] > CACHE_CHARS)
        if len(far):
            cuts = [np.array(self.packed(self.merged(self.strings[parts[k]], self.gaps(int(keys_[k])) if self.rate else (NEVER,))), np.uint32) for k in far.tolist()]
            lengths = np.array([len(x) for x in cuts])
            start[far], length[far] = offsets_of(lengths)[:-1] + len(pool), lengths
            pool = np.concatenate([pool, *cuts])
        return ragged(pool, start, length), offsets_of(length)[places]

    def encode(self, text: str, variant: int = 0) -> bytes:
        """ids of one text, unsigned 32-bit little endian; ``variant`` is any number, such as a document's key."""
        ids, _ = self.batch(pa.array([text], pa.large_string()), np.array([variant & MASK], np.uint64))
        return ids.astype("<u4").tobytes()

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids with these offsets; the space before a text is taken off."""
        spelling, many = self.spelled.take(ids.astype(np.int64))
        ends = offsets_of(many)[offsets]
        some = np.diff(ends) > 0
        keep = np.ones(len(spelling), bool)
        keep[ends[:-1][some]] = False
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer((ends - np.concatenate([[0], np.cumsum(some)])).astype(np.int64)), pa.py_buffer(spelling[keep]))

    def decode(self, ids: bytes) -> str:
        return self.decoded(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0].as_py()


_models: dict[tuple, Pieces] = {}


def loaded(path: str | None, rate: float, seed: int) -> Pieces:
    """One model for each worker process, so that its caches serve all tasks there."""
    if (path, rate, seed) not in _models:
        _models[path, rate, seed] = Pieces(path, rate, seed)
    return _models[path, rate, seed]


def joined_spaces(parts: list[str]) -> list[str]:
    """Parts that are a space alone join the part after them."""
    out, run = [], ""
    for p in parts:
        if p == " ":
            run += p
        else:
            out.append(run + p)
            run = ""
    return [*out, run] if run else out


def encoded(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids (binary), decoded (text), of every document.

    A document's key is a hash of its id and text.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path, rate, seed)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            for at, n in steps(texts):
                variants = batch.column(1).slice(at, n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids, offsets = model.batch(texts.slice(at, n), variants)
                raw, marks = ids.astype("<u4"), offsets.tolist()
                crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(marks, marks[1:], strict=False)], pa.int64())
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * offsets.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(offsets)), crc, held.cast(pa.binary()), model.decoded(ids, offsets).cast(pa.string())], names=["doc_id", "n_tokens", "ids_crc32", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(seed), "doc_id", text_of()).alias("variant"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, ids binary, decoded string")
