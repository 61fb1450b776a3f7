"""Fast token ids on executors: words of a batch are told apart by Arrow, and only new ones are encoded.

Both vocabularies here never merge across a space between two visible
characters, so texts are cut there.  The words of a whole batch are turned into
codes of distinct words at once; a bounded cache holds the ids of words seen
before, and the ids of all texts are gathered by offsets.

Special tokens that a text spells out are their own ids, as in the tokenizer's
plain ``encode(text, add_special_tokens=False)``; a text is cut at them first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: The words that the cache keeps (about 200 bytes each), and the longest one there.
CACHE_WORDS, CACHE_CHARS = 800_000, 48
#: Bytes of text that are encoded at once.
STEP = 8 << 20

MARKS = ".,;:!?%$#&*"
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space or line break with white space after it: such a text is not cut at every space.
#: A letter at the end (lower case of the one left out ends otherwise); words without white space or control characters.
LETTER_LAST = "[^\\P{L}\\x{130}]$"
VISIBLE = "^\\n?[\\p{L}\\p{M}\\p{N}\\p{P}\\p{S}]+$"
WIDE_SPACE = "[ \\n][\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices (start, length) of the pool, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]


def offsets_of(length: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(length, dtype=np.int64)])


def steps(texts: pa.Array, most: int = STEP) -> Iterable[tuple[int, int]]:
    """(first, number) of runs of large strings of about ``most`` bytes, a text at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, end - at
        at = end


def reordered(texts: pa.Array, odd: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """ids and offsets of texts that are encoded in two ways: ``encode(texts, odd, places)`` for those that are odd or not."""
    if not odd.any() or odd.all():
        return encode(texts, bool(odd.any()), np.arange(len(texts)))
    which = [np.flatnonzero(~odd), np.flatnonzero(odd)]
    (a, x), (b, y) = (encode(texts.take(pa.array(w)), k == 1, w) for k, w in enumerate(which))
    order = np.concatenate(which)
    start, length = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
    start[order], length[order] = np.concatenate([x[:-1], y[:-1] + len(a)]), np.concatenate([np.diff(x), np.diff(y)])
    return ragged(np.concatenate([a, b]), start, length), offsets_of(length)


class Pool:
    """Values of many slices in one growing array; slice n is start[n], length[n]."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.values, self.start, self.length = np.zeros(1 << 12, self.kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.n = self.used = 0

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> int:
        """Add slices; returns the number of the first."""
        n, used = self.n + len(lengths), self.used + len(values)
        if used > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(used, self.kind)])
        if n > len(self.start):
            self.start, self.length = (np.concatenate([x[: self.n], np.zeros(n, np.int64)]) for x in (self.start, self.length))
        self.values[self.used : used] = values
        self.start[self.n : n] = offsets_of(lengths)[:-1] + self.used
        self.length[self.n : n] = lengths
        first, self.n, self.used = self.n, n, used
        return first

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these slices, and their lengths."""
        length = self.length[numbers]
        return ragged(self.values, self.start[numbers], length), length


class Encoder:
    """ids (unsigned 32-bit) of texts, equal to the tokenizer's own."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # What stands between special tokens has none, but its lower-cased words may look like one.
        self.model.encode_special_tokens = True
        self.keep_space = keep_space
        # Between words that are encoded together: a line break, or a sign that stands alone.
        self.sign, self.mark = ("\n", "\n") if keep_space else ("\x01", " \x01 ")
        (self.mark_id,) = self.ids(self.sign).tolist()
        self.break_ids = self.ids("\n") if keep_space else np.zeros(0, np.uint32)
        self.pool = Pool(np.uint32)
        self.known: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.uses, self.most = np.zeros(0, np.int64), CACHE_WORDS

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def words(self, texts: pa.Array, wide: bool) -> tuple[pa.Array, np.ndarray]:
        """Parts that can be encoded one by one, as keys of the cache, and each text's offsets.

        Where spaces count, a key stands for a space and its word, and one that
        begins with a line break for that break and the word without a space;
        the first key of a text has such a break, whose ids are taken off again.
        """
        if not self.keep_space:
            cut = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
            return cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        if wide:
            lists = [["\n" + (parts := INNER_SPACE.split(t))[0], *parts[1:]] for t in texts.to_pylist()]
            return pa.array([x for y in lists for x in y], pa.large_string()), offsets_of(np.array([len(x) for x in lists]))
        broken = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar("\n", texts.type))
        cut = pc.split_pattern(pc.replace_substring(broken, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        rest = np.ones(offsets[-1], bool)
        rest[offsets[:-1]] = False  # nothing stands before the first break
        return cut.flatten().filter(pa.array(rest)), offsets - np.arange(len(offsets))

    def shown(self, key: str) -> tuple[str, np.ndarray]:
        """The text that a key stands for, and the ids before it."""
        if not self.keep_space:
            return key, self.break_ids
        return (key[1:], self.break_ids) if key[:1] == "\n" else (" " + key, self.break_ids[:0])

    def learn(self, keys: pa.Array) -> None:
        """Put the ids of new keys into the pool.

        Marks after a letter are a part of their own in both vocabularies, so a
        word with marks is its bare form and the marks.
        """
        known, short = self.known, pc.less_equal(pc.utf8_length(keys), CACHE_CHARS)
        bare = pc.utf8_rtrim(keys, MARKS)
        marked = pc.and_(pc.and_(short, pc.match_substring_regex(bare, LETTER_LAST)), pc.not_equal(bare, keys))
        forms = pc.unique(pc.if_else(marked, bare, keys))
        lacking = [w not in known for w in forms.to_pylist()]
        forms = forms.filter(pa.array(lacking, pa.bool_()))
        visible = pc.and_(pc.less_equal(pc.utf8_length(forms), CACHE_CHARS), pc.match_substring_regex(forms, VISIBLE))
        if together := forms.filter(visible).to_pylist():
            self.put(together, *self.together(together))
        for w in forms.filter(pc.invert(visible)).to_pylist():
            text, before = self.shown(w)
            ids = np.concatenate([before, self.ids(text)])
            self.put([w], ids, np.array([len(ids)]))
        if words := keys.filter(marked).to_pylist():
            parts = [(b, w[len(b) :]) for b, w in zip(bare.filter(marked).to_pylist(), words, strict=True)]
            for t in {t for _, t in parts} - self.tails.keys():
                self.tails[t] = self.pool.extend(ids := self.ids(t), np.array([len(ids)]))
            both = np.array([(known[b], self.tails[t]) for b, t in parts], np.int64)
            ids, lengths = self.pool.take(both.ravel())
            self.put(words, ids, lengths.reshape(-1, 2).sum(axis=1))

    def put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = self.pool.extend(ids, lengths)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of visible words, from one text in which a mark of one id stands between them, and their lengths."""
        shown = [self.shown(w) for w in words] if self.keep_space else words
        ids = self.ids(self.mark.join([t for t, _ in shown] if self.keep_space else words))
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
        lengths = np.diff(ends, prepend=-1) - 1
        if not self.keep_space:
            return ragged(ids, ends - lengths, lengths), lengths
        # Some begin with the ids of a line break.
        n = len(self.break_ids)
        broken = np.array([n if len(b) else 0 for _, b in shown])
        start = np.stack([np.zeros(len(ends), np.int64), ends - lengths + n], 1).ravel()
        return ragged(np.concatenate([self.break_ids, ids]), start, np.stack([broken, lengths], 1).ravel()), lengths + broken

    def forget(self) -> None:
        """Drop all words that the cache keeps."""
        self.pool.clear(), self.known.clear(), self.tails.clear()
        self.uses = np.zeros(0, np.int64)

    def trim(self, most: int) -> None:
        """Past the bound, keep only words that came more than once."""
        if len(self.known) <= most and self.pool.used <= 16 * most:
            return
        uses, least = self.uses[: self.pool.n], 2
        while (n := int((uses >= least).sum())) > most // 2:
            least *= 2
        kept = [(w, k) for w, k in self.known.items() if uses[k] >= least and len(w) <= CACHE_CHARS] if n else []
        ids, lengths = self.pool.take(np.array([k for _, k in kept], np.int64))
        self.pool.clear(), self.known.clear(), self.tails.clear()
        self.uses = np.zeros(len(lengths), np.int64)
        self.put([w for w, _ in kept], ids, lengths)

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without special tokens, and each text's offsets."""
        wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False) if self.keep_space else np.zeros(len(texts), bool)
        return reordered(texts, wide, lambda some, odd, _: self.some(some, odd))

    def some(self, texts: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        self.trim(self.most)
        words, offsets = self.words(texts, wide)
        coded = words.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        get = self.known.get
        numbers = np.array([get(w, -1) for w in keys], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            self.learn(coded.dictionary.take(pa.array(new)))
            numbers[new] = [get(keys[k]) for k in new.tolist()]
        if self.pool.n > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros(self.pool.n, np.int64)])
        self.uses[numbers] += 1
        numbers = numbers[coded.indices.to_numpy()]
        length, start = self.pool.length[numbers], self.pool.start[numbers]
        if skip := len(self.break_ids):  # every text's first word begins with a break that is not there
            length[offsets[:-1]] -= skip
            start[offsets[:-1]] += skip
        return ragged(self.pool.values, start, length), offsets_of(length)[offsets]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without end ids, and each text's offsets."""
        odd = None
        for s in self.special:
            has = pc.match_substring(texts, s)
            odd = has if odd is None else pc.or_(odd, has)
        if odd is None or not pc.any(odd).as_py():
            return self.plain(texts)
        # Every second part is a special token.
        parts = [self.at_special.split(t) if o else [t] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        ids, offsets = self.plain(pa.array([p for cut in parts for p in cut[::2]], pa.large_string()))
        out, k, sizes = [], 0, []
        for cut in parts:
            size = 0
            for i, p in enumerate(cut):
                found = np.array([self.special[p]], np.uint32) if i % 2 else ids[offsets[k] : offsets[k + 1]]
                k += 1 - i % 2
                size += len(found)
                out.append(found)
            sizes.append(size)
        return np.concatenate(out), offsets_of(np.array(sizes))

    def batches(self, texts: pa.Array, step: int = STEP) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, offsets) of steps of bounded size; each text's ids end with ``END_ID``."""
        texts = texts.cast(pa.large_string())
        for at, n in steps(texts, step):
            ids, offsets = self.batch(texts.slice(at, n))
            yield at, np.insert(ids, offsets[1:], np.uint32(END_ID)), offsets + np.arange(len(offsets))

    def encode(self, texts: list[str]) -> Iterable[bytes]:
        """The ids of each text, without an end id, little endian."""
        ids, offsets = self.batch(pa.array(texts, pa.large_string()))
        ids = ids.astype("<u4")
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            yield ids[a:b].tobytes()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool, most: int = CACHE_WORDS) -> Encoder:
    """One per worker process, so that its cache serves all tasks there."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = Encoder(path, keep_space)
    found = _encoders[path, keep_space]
    found.most = most
    return found


def drop_encoders() -> None:
    """Give up the encoders of this worker, with all that they know."""
    _encoders.clear()


def byte_encoder(path: str | None = None, most: int = CACHE_WORDS) -> Encoder:
    return encoder(path or public_tokenizers.path("byte_bpe_50k.json"), True, most)


def word_encoder(path: str | None = None, most: int = CACHE_WORDS) -> Encoder:
    return encoder(path or public_tokenizers.path("word_bpe_49k.json"), False, most)
