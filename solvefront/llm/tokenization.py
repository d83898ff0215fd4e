"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are worked on as the bytes of a whole Arrow column, in windows of bounded
size cut at white space; for a tokenizer whose pre-tokenizer never lets a token
span white space and drops the white space itself (``word_bpe_49k.json``), such
a cut is a safe boundary, and a text of any length takes the same memory.

Within a window the pre-tokens are found by byte class, all at once, and looked
up in a table of those met before (:class:`WordTable`).  New ones go to the
library in batches balanced by bytes.  Chunks with characters outside ASCII and
Latin-1 letters go to the library whole.  Both properties are read from the
tokenizer's file; other tokenizers encode texts by the library alone.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from solvefront.llm.common import rows_of

#: Bytes of text handed on at once; of a window; of a call of the library; words kept per Python worker
#: (22 MB of arrays: with a window's new words they fit 2^18 places; a million took 88 MB in each worker).
SLICE_BYTES = 1 << 19
WINDOW_BYTES = 1 << 19
CALL_BYTES = 1 << 19
JOINED_BYTES = 1 << 11
MAX_WORDS = 230_000
#: Longest word, in bytes, whose bytes are its key in the table.
KEY_BYTES = 16


def default_tokenizer() -> str:
    """Name of the vocabulary file; resolved to a path on each executor."""
    return "word_bpe_49k.json"


def resolve(tokenizer: str) -> str:
    """A path as it is; a bare file name through the installed ``public_tokenizers``."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER, _NEXT = range(6)


def _classes() -> np.ndarray:
    """Class of each byte; ``<`` counts as other, as it may open a special string, and C3 leads the Latin-1 letters."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[33:127] = _SYMBOL
    for span, k in (("az", _LETTER), ("AZ", _LETTER), ("09", _DIGIT)):
        kind[ord(span[0]) : ord(span[1]) + 1] = k
    kind[ord("<")] = _OTHER
    kind[[9, 10, 13, 32]] = _SPACE
    kind[0x80:0xC0] = _NEXT
    kind[0xC3] = _LETTER
    return kind


_CLASS = _classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordTable:
    """Exact map from pre-tokens (up to 16 bytes as two integers, others by their bytes) to their ids.

    Open addressing in arrays, so a window's words are looked up together.
    When full, the words not met for longest are dropped, about half of them.
    """

    def __init__(self) -> None:
        self.low, self.high = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.value = np.full(1 << 16, -1, np.int32)
        self.n, self.n_ids = 0, 0
        self.key = np.zeros((2, 1 << 12), np.uint64)
        self.start, self.count, self.met = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.odd: dict[bytes, int] = {}
        self.window = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * _K2)) * _K1
        return ((h ^ (h >> np.uint64(29))) & np.uint64(len(self.value) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if unknown."""
        slot = self._slots(low, high)
        found = self.value[slot]
        left = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.value) - 1)
            v = self.value[slot]
            found[left] = v
            again = (v >= 0) & ((self.low[slot] != low[left]) | (self.high[slot] != high[left]))
            left, slot = left[again], slot[again]
        return found

    def _enter(self, places: np.ndarray) -> None:
        slot = self._slots(self.key[0, places], self.key[1, places])
        while len(places):
            free = self.value[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.low[slot[first]], self.high[slot[first]] = self.key[0, places[first]], self.key[1, places[first]]
            self.value[slot[first]] = places[first]
            rest = np.ones(len(places), bool)
            rest[first] = False
            places, slot = places[rest], (slot[rest] + 1) & (len(self.value) - 1)

    def _store(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of new words with these numbers of ids."""
        m = len(counts)
        while self.n + m > len(self.start):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)], axis=1)
            self.start, self.count, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.met))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = np.arange(self.n, self.n + m)
        self.start[at] = self.n_ids + np.cumsum(counts) - counts
        self.count[at], self.met[at] = counts, self.window
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n, self.n_ids = self.n + m, self.n_ids + len(flat)
        return at

    def add(self, low: np.ndarray, high: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        at = self._store(flat, counts)
        self.key[0, at], self.key[1, at] = low, high
        size = len(self.value)
        while self.n > size // 2:
            size *= 2
        if size > len(self.value):
            self.low, self.high, self.value = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            at = np.flatnonzero(self.count[: self.n] * (self.key[0, : self.n] > 0))
        self._enter(at)

    def add_odd(self, words: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        self.odd.update(zip(words, self._store(flat, counts).tolist(), strict=True))

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words in order, and how many each has."""
        count = self.count[places].astype(np.int64)
        before = np.cumsum(count) - count
        return self.ids[np.repeat(self.start[places] - before, count) + np.arange(int(count.sum()))], count

    def shrink(self, most: int = MAX_WORDS) -> None:
        """Drop the half met least recently once there are more than ``most`` words."""
        if self.n <= most:
            return
        stay = np.flatnonzero(self.met[: self.n] >= np.median(self.met[: self.n]))
        if len(stay) > most:
            stay = stay[:0]
        keyed = self.key[0, stay] > 0
        named = {p: w for w, p in self.odd.items()}
        plain, odd = stay[keyed], stay[~keyed]
        low, high = self.key[0, plain], self.key[1, plain]
        words, window = [named[p] for p in odd.tolist()], self.window
        kept = self.ids_of(plain), self.ids_of(odd)
        self.__init__()
        self.window = window
        if len(plain):
            self.add(low, high, *kept[0])
        if words:
            self.add_odd(words, *kept[1])


def joined_ids(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))


class BatchEncoder:
    """Encodes columns of texts; ``plain`` tokenizers by :class:`WordTable`, others by the library alone."""

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = _drops_white_space(spec)
        self.plain = self.split and _is_plain_word_bpe(spec)
        self.table = WordTable()
        if self.plain:
            self.word_end = np.zeros(self.lib.get_vocab_size(), bool)
            suffix = spec["model"]["end_of_word_suffix"]
            self.word_end[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, in calls of about ``CALL_BYTES``."""
        out, at = [], 0
        sizes = [len(t.encode()) for t in texts]
        while at < len(texts):
            end, used = at + 1, sizes[at]
            while end < len(texts) and used + sizes[end] <= CALL_BYTES:
                used += sizes[end]
                end += 1
            out += [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of pre-tokens: several are joined by spaces into one text, and their ids parted at word ends."""
        joined, now, used = [], [], 0
        for w in words:
            now.append(w)
            used += len(w) + 1
            if used >= JOINED_BYTES:
                joined.append(" ".join(now))
                now, used = [], 0
        if now:
            joined.append(" ".join(now))
        flat = np.concatenate(self.library(joined))
        ends = np.flatnonzero(self.word_end[flat]) + 1
        if len(ends) != len(words) or ends[-1] != len(flat):
            return joined_ids(self.library(words))
        return flat, np.diff(ends, prepend=0)

    def _window(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each pre-token of a window, and its place in the table; ``breaks`` are first bytes of rows."""
        n = len(data)
        kind, low = _CLASS[data], np.zeros(n + KEY_BYTES, np.uint8)
        low[:n] = _LOWER[data]
        follow = np.flatnonzero(kind == _NEXT)
        if len(follow):  # second bytes of C3 are letters but for the signs of multiplication and division
            byte = data[follow]
            letter = (follow > 0) & (data[follow - 1] == 0xC3) & (byte != 0x97) & (byte != 0xB7)
            kind[follow] = np.where(letter, _LETTER, _OTHER)
            low[follow] += np.where(letter & (byte < 0x9F), 32, 0).astype(np.uint8)
        solid = kind != _SPACE
        row = np.zeros(n + 1, bool)
        row[breaks] = True
        chunk = solid.copy()
        chunk[1:] &= ~solid[:-1]
        chunk |= solid & row[:n]
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | row[1:n]
        whole = np.zeros(0, np.int64)
        if (kind == _OTHER).any():
            of = np.cumsum(chunk, dtype=np.int32) - 1
            odd = np.zeros(int(of[-1]) + 1, bool)
            odd[of[kind == _OTHER]] = True
            inside = solid & odd[of]
            start &= ~inside
            start |= chunk & inside
            kind[inside] = _OTHER
            whole = np.flatnonzero(chunk & inside)
        # Contractions: an apostrophe that is a symbol of its own before s, t, re, ve, m, ll or d takes these letters.
        mark = np.flatnonzero((data == 39) & start & (kind == _SYMBOL))
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == _LETTER) & ~row[mark + 1]]
        if len(mark):
            one, two = low[mark + 1], low[mark + 2]
            pair = (mark + 2 < n) & ~row[np.minimum(mark + 2, n)]
            is_one = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            is_two = pair & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            start[mark[is_one | is_two] + 1] = False
            after = np.concatenate([mark[is_one] + 2, mark[is_two & ~is_one] + 3])
            after = after[after < n]
            start[after[(kind[after] == _LETTER)]] = True
        begin = np.flatnonzero(start)
        stop = np.zeros(n + 1, bool)
        stop[1:n] = solid[:-1] & (~solid[1:] | start[1:])
        stop[n] = n > 0 and solid[-1]
        length = np.flatnonzero(stop) - begin
        return begin, self._places(low, data, begin, length, whole)

    def _places(self, low: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray, whole: np.ndarray) -> np.ndarray:
        table = self.table
        table.shrink()
        table.window += 1
        is_odd = length > KEY_BYTES
        is_odd[np.searchsorted(begin, whole)] = True
        place = np.full(len(begin), -1, np.int32)
        for i in np.flatnonzero(is_odd):  # long or unusual: by its bytes
            place[i] = table.odd.get(data[begin[i] : begin[i] + length[i]].tobytes(), -1)
        missing = np.flatnonzero(is_odd & (place < 0))
        if len(missing):
            words = [data[begin[i] : begin[i] + length[i]].tobytes() for i in missing]
            new = list(dict.fromkeys(words))
            table.add_odd(new, *joined_ids(self.library([w.decode() for w in new])))
            place[missing] = [table.odd[w] for w in words]
        plain = np.flatnonzero(~is_odd)
        if len(plain):
            at, size = begin[plain], length[plain]
            eight = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))
            first = eight[at] & _MASK[np.minimum(size, 8)]
            second = np.where(size > 8, eight[np.minimum(at + 8, len(eight) - 1)], 0) & _MASK[np.maximum(size - 8, 0)]
            found = table.find(first, second)
            gone = np.flatnonzero(found < 0)
            if len(gone):
                order = gone[np.lexsort((first[gone], second[gone]))]
                a, b = first[order], second[order]
                head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                new = order[head]
                words = [low[at[i] : at[i] + size[i]].tobytes().decode() for i in new]
                table.add(first[new], second[new], *self.words(words))
                found[gone] = table.find(first[gone], second[gone])
            place[plain] = found
        table.met[place] = table.window
        return place

    def windows(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row of each pre-token and its place in the table, window by window, in order."""
        col = pc.fill_null(col.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        if bounds[-1] == bounds[0]:
            return
        data = np.frombuffer(col.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        at = 0
        while at < len(data):
            end = self._cut(data, bounds, at)
            rows = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)]
            begin, place = self._window(data[at:end], rows - at)
            yield np.searchsorted(bounds, begin + at, side="right") - 1, place
            at = end

    @staticmethod
    def _cut(data: np.ndarray, bounds: np.ndarray, at: int) -> int:
        """End of the window from ``at``: the last white space or row end within its size, else the next one."""
        end = at + WINDOW_BYTES
        if end >= len(data):
            return len(data)
        part = np.flatnonzero(_CLASS[data[at:end]] == _SPACE)
        row = int(bounds[np.searchsorted(bounds, end, side="right") - 1])
        best = max(at + int(part[-1]) + 1 if len(part) else at, row)
        if best > at:
            return best
        row = int(bounds[np.searchsorted(bounds, end)])
        for lo in range(end, row, WINDOW_BYTES):
            part = np.flatnonzero(_CLASS[data[lo : min(row, lo + WINDOW_BYTES)]] == _SPACE)
            if len(part):
                return lo + int(part[0]) + 1
        return row

    def counts(self, col: pa.Array) -> np.ndarray:
        """Number of tokens of each text; nothing else is made."""
        out = np.zeros(len(col), np.int64)
        if not self.plain:
            for i, ids in enumerate(self.texts(col)):
                out[i] = len(ids)
            return out
        for row, place in self.windows(col):
            if len(row):
                sums = np.bincount(row - row[0], self.table.count[place])
                out[row[0] : row[0] + len(sums)] += sums.astype(np.int64)
        return out

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end (one more than texts)."""
        parts, n = [np.zeros(0, np.uint32)], np.zeros(len(col), np.int64)
        if not self.plain:
            for i, ids in enumerate(self.texts(col)):
                parts.append(ids)
                n[i] = len(ids)
        else:
            for row, place in self.windows(col):
                count = self.table.count[place].astype(np.int64)
                if len(row):
                    sums = np.bincount(row - row[0], count)
                    n[row[0] : row[0] + len(sums)] += sums.astype(np.int64)
                    parts.append(self.table.ids_of(place)[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])

    def texts(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text by the library; a long one in parts cut at white space where that is safe."""
        pending: list[str] = []
        used = 0
        for t in col.to_pylist():
            t = t or ""
            if self.split and len(t) > CALL_BYTES:
                yield from self.library(pending)
                pending, used = [], 0
                cuts = [0]
                while cuts[-1] < len(t):
                    m = re.compile(r"[ \t\n\r]").search(t, cuts[-1] + CALL_BYTES)
                    cuts.append(m.end() if m else len(t))
                yield np.concatenate([x for lo, hi in zip(cuts, cuts[1:], strict=False) for x in self.library([t[lo:hi]])])
                continue
            pending.append(t)
            used += len(t)
            if used >= CALL_BYTES:
                yield from self.library(pending)
                pending, used = [], 0
        yield from self.library(pending)


def _drops_white_space(spec: dict) -> bool:
    """Whether no token of this tokenizer spans white space and none stands for it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
        and re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]|\[?\\p\{[LN]\}\]?|'\w+|[+|]", "", pattern) == ""
        and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    )


def _is_plain_word_bpe(spec: dict) -> bool:
    """Whether :class:`WordTable` describes this tokenizer: byte-level BPE with word ends over the pre-tokens it cuts."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = steps[0].get("pattern", {}).get("Regex", "")
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        and all("<" in t["content"] for t in spec["added_tokens"]) and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"]
    )


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(tokenizer: str) -> BatchEncoder:
    """One encoder, and so one table, per Python worker."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = BatchEncoder(tokenizer)
    return _ENCODERS[tokenizer]


def token_counts(df: DataFrame, text: str = "text", *, tokenizer: str | None = None, count: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text.

    No begin, end or added special tokens; special strings inside a text count
    as the library takes them by default.  Null and empty texts: 0.  Repeated
    rows each get their count; an empty table stays empty; every other column
    passes through, except that ``count`` replaces a column of its name.  Runs
    in the scan's partitions without a shuffle, in windows of
    :data:`WINDOW_BYTES`, so memory depends neither on the row group nor on the
    longest text, unless that has no white space.
    """
    name = tokenizer or default_tokenizer()
    rest = [c for c in df.columns if c != count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for b in rows_of(batches, text, SLICE_BYTES):
            n = enc.counts(b.column(b.schema.get_field_index(text)))
            keep = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n)], names=[*rest, count])

    schema = df.select(rest).schema.add(count, "long")
    return df.select(rest).mapInArrow(run, schema)
