"""Personal data by bootstrapped contextual extraction.

What a few patterns find for certain (mail and network addresses, cards, telephone
numbers) are the seeds.  The words around a seed are lexical patterns: two
words before it, or one on either side.  Patterns and instances form a graph,
scored in turns: a pattern's confidence is the reliability of its instances
over the number of all different fillers of its slot, ordinary words included;
an instance is as reliable as the patterns that hold it are together.
Confident patterns discover identifiers that no seed pattern describes, and
these support further patterns in the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvefront.llm.common import rows_of, sealed, stage

KINDS = ("email", "ip", "card", "phone")
#: Reliabilities a pattern must gather, and the share of its fillers they must be.
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.6
ROUNDS = 3
#: Bytes of the shortest token that can be an identifier.
MIN_TOKEN = 4
BATCH_BYTES = 1 << 20
#: Bytes of tokens hashed at once, and bits of the largest bitmap of patterns.
HASH_BYTES = 1 << 20
MOST_BITS = 1 << 26
SHOWN = 40
#: Texts in the first part whose fillers are counted, and how each part grows.
FIRST_PART = 4096
PART_GROWTH = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, ``@`` and dotted name; from each ``@`` the local part is read backwards, so long words cost their length once."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _is_card(s: str) -> bool:
    digits = _DIGITS.sub("", s)
    return 13 <= len(digits) <= 19 and passes_luhn(digits)


def _is_ip(s: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start: matches that fail their check are dropped and not tried again."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m.group())]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return found


# --- slots ------------------------------------------------------------------------------------------------------


def _classes() -> tuple[np.ndarray, ...]:
    byte = np.arange(256)
    digit = (byte >= 48) & (byte <= 57)
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128) | (byte >= 128)
    joiner = np.isin(byte, list(b"._%+-@"))
    space = np.isin(byte, list(b" \t\n\x0b\x0c\r"))
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    return digit, letter, joiner, space, lower, np.where(digit, 48, lower).astype(np.uint8)


_DIGIT, _LETTER, _JOINER, _SPACE, _LOWER, _CONTEXT = _classes()
_BASE = 0x9E3779B97F4A7C15
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's bytes, some tokens at a time."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + HASH_BYTES, side="right")), a + 1)
        low = int(starts[a])
        n = int(ends[b - 1]) - low
        power, inverse = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = _mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return out


@dataclass
class Slots:
    """The tokens of some texts and the patterns around each; a pattern without a letter on either side is none (0)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    fillers: np.ndarray
    _around: tuple[np.ndarray, ...]

    @classmethod
    def of_texts(cls, texts: list[bytes]) -> Slots:
        """Tokens are runs of letters, digits and characters above ASCII, joined by single ``._%+-@``, and runs of other characters."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        core = _DIGIT[data] | _LETTER[data]
        word = core.copy()
        word[1:-1] |= _JOINER[data[1:-1]] & core[:-2] & core[2:]
        kind = word.astype(np.int8) + 2 * (~word & ~_SPACE[data])
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(kind)]])
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        of = np.searchsorted(bounds, starts, side="right") - 1
        context = token_hashes(_CONTEXT[data], starts, ends)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
        return cls(data, starts, ends, of, token_hashes(_LOWER[data], starts, ends), (context, letters[ends] > letters[starts]))

    def _neighbour(self, at: np.ndarray, step: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context, lexical = self._around
        i = at + step
        inside = (i >= 0) & (i < len(context))
        i = np.where(inside, i, 0)
        inside &= self.of[i] == of
        return np.where(inside, context[i], _START if step < 0 else _END), lexical[i] & inside

    def patterns(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """The two patterns around the tokens from ``first`` to ``last``: two before, one on either side."""
        of = self.of[first]
        (a, la), (b, lb), (c, lc) = self._neighbour(first, -2, of), self._neighbour(first, -1, of), self._neighbour(last, 1, of)
        two = np.where(la | lb, _mixed(a * np.uint64(3) ^ _mixed(b + np.uint64(1))), np.uint64(0))
        either = np.where(lb | lc, _mixed(b * np.uint64(5) ^ _mixed(c + np.uint64(2))), np.uint64(0))
        return [two, either]

    def show(self, first: int, last: int, which: int) -> str:
        places = ((first - 2, first - 1), (first - 1, last + 1))[which]
        said = [bytes(self.data[self.starts[i] : min(self.ends[i], self.starts[i] + SHOWN)]).decode(errors="ignore") if 0 <= i < len(self.starts) and self.of[i] == self.of[first] else "" for i in places]
        return f"{said[0]} {said[1]} _" if which == 0 else f"{said[0]} _ {said[1]}"


FOUND = (
    "base array<struct<kind: int, start: long, end: long>>, "
    "slots array<struct<kind: int, many: boolean, pattern: long, instance: long, start: long, end: long, shown: string>>"
)


def _slots_of(texts: list[bytes], spans: list[list[tuple[int, int, int]]]) -> list[list[tuple]]:
    """For each text the slots that seeds and tokens shaped like identifiers fill; kind -1: no seed."""
    slots = Slots.of_texts(texts)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(slots.starts):
        return out
    # The bytes at which code points begin, and the first of each text.
    points = np.flatnonzero((slots.data & 0xC0) != 0x80)
    zero = np.searchsorted(points, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    seeds, taken = [], np.zeros(len(slots.starts), bool)
    for d, some in enumerate(spans):
        for kind, s, e in some:
            a, z = points[zero[d] + s], points[zero[d] + e]
            first, last = int(np.searchsorted(slots.ends, a, side="right")), int(np.searchsorted(slots.starts, z, side="left")) - 1
            taken[first : last + 1] = True
            seeds.append((kind, first, last, s, e))
    marks = np.concatenate([[0], np.cumsum(_DIGIT[slots.data] | (slots.data == 64), dtype=np.int32)])
    shaped = (marks[slots.ends] > marks[slots.starts]) & (slots.ends - slots.starts >= MIN_TOKEN) & ~taken
    shaped &= _DIGIT[slots.data[slots.starts]] | _LETTER[slots.data[slots.starts]]
    free = np.flatnonzero(shaped)
    places = [(np.searchsorted(points, x[free]) - zero[slots.of[free]]).tolist() for x in (slots.starts, slots.ends)]
    rows = [*seeds, *[(-1, i, i, s, e) for i, s, e in zip(free.tolist(), *places, strict=True)]]
    if not rows:
        return out
    first, last = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    instance = np.where(first == last, slots.fillers[first], _mixed(slots.fillers[first] * np.uint64(7) ^ slots.fillers[last] ^ (last - first).astype(np.uint64)))
    for which, found in enumerate(slots.patterns(first, last)):
        for (kind, f, l, s, e), p, i in zip(rows, found.view(np.int64).tolist(), instance.view(np.int64).tolist(), strict=True):
            if p:
                out[int(slots.of[f])].append((kind, f != l, p, i, s, e, slots.show(f, l, which)))
    return out


def seeds_and_slots(df: DataFrame, text: str) -> DataFrame:
    """``df`` without its text, with a key of the text, its base spans, and the slots of its seeds and identifier-like tokens."""
    keyed = df.withColumn("_key", F.unhex(F.md5(F.col(text).cast("binary"))))
    others = [c for c in keyed.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text, BATCH_BYTES):
            decoded = [t or "" for t in batch.column(text).to_pylist()]
            spans = [base_spans(t) for t in decoded]
            slots = _slots_of([t.encode() for t in decoded], spans)
            base = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in some] for some in spans], pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))
            names = ("kind", "many", "pattern", "instance", "start", "end", "shown")
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = pa.array([[dict(zip(names, x, strict=True)) for x in some] for some in slots], pa.list_(pa.struct(list(zip(names, types, strict=True)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], base, made], names=[*others, "base", "slots"])

    return keyed.mapInArrow(work, T.StructType([keyed.schema[c] for c in others] + T._parse_datatype_string(FOUND).fields))


def _hits(spark: SparkSession, texts: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(pattern, instance): the tokens in the slots of the wanted patterns.

    A bitmap of bounded size, broadcast, tells most other patterns apart where
    texts are cut; the join that follows removes the rest, however many patterns are wanted.
    """
    bits = min(MOST_BITS, 1 << max(16, (16 * wanted.count()).bit_length()))
    bit = F.pmod(F.col("pattern"), F.lit(bits))
    made = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).toArrow()
    marks = np.zeros(bits // 8, np.uint8)
    for k, x in zip(made.column("part").to_pylist(), made.column("bits").to_pylist(), strict=True):
        marks[k * 4096 : (k + 1) * 4096] = np.frombuffer(x, np.uint8)
    shared = spark.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in rows_of(batches, text, BATCH_BYTES):
            slots = Slots.of_texts([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()])
            every = np.arange(len(slots.starts))
            hits = []
            for p in slots.patterns(every, every) if len(every) else ():
                place = p & np.uint64(bits - 1)
                hit = (p != 0) & ((marked[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                hits.append(np.stack([p[hit], slots.fillers[hit]], 1))
            if hits:
                rows = np.unique(np.concatenate(hits).view(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["pattern", "instance"])

    found = texts.select(text).mapInArrow(work, "pattern long, instance long")
    return found.join(wanted.select("pattern"), "pattern", "left_semi")


def filler_counts(spark: SparkSession, texts: DataFrame, text: str, wanted: DataFrame, rows: int) -> DataFrame:
    """(pattern, fillers, whole), staged: the different tokens in the slots of the patterns of ``wanted`` (pattern, most).

    Texts are taken in growing parts, told apart by their hash.  A pattern
    that has more than ``most`` fillers already needs no more counting: what is
    left could only lower its confidence, so it leaves with what was found
    (``whole`` false).  The others are counted over all texts.  So the rows in
    play are a few for each pattern, not all occurrences of common words.
    """
    share = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30)
    pairs, gone, low, high = None, None, 0.0, FIRST_PART / max(rows, 1)
    while low < 1 and not wanted.isEmpty():
        part = texts.where((share >= low) & (share < high)) if high < 1 else texts.where(share >= low)
        hits = _hits(spark, part, text, wanted)
        hits = stage(spark, (hits if pairs is None else hits.unionByName(pairs)).distinct(), "fillers")
        counted = wanted.join(hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("fillers")), "pattern", "left")
        counted = stage(spark, counted.withColumn("fillers", F.coalesce("fillers", F.lit(0))), "counted")
        low, high = high, high * PART_GROWTH
        out = counted.where("fillers > most" if low < 1 else "true").select("pattern", "fillers", F.lit(low >= 1).alias("whole"))
        gone = out if gone is None else gone.unionByName(out)
        wanted = counted.where("fillers <= most").select("pattern", "most")
        pairs = hits.join(wanted.select("pattern"), "pattern", "left_semi")
    return stage(spark, gone, "totals")


def learn_patterns(
    spark: SparkSession, texts: DataFrame, text: str, slots: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS,
) -> DataFrame | None:
    """(pattern, kind, support, fillers, confidence, shown), staged: the confident patterns after the last round; None if there are none.

    Each round joins the edges with the reliable instances, counts the fillers
    of patterns that newly have support, and scores both sides.  Rounds end
    when no pattern is added.  All steps are grouped sums; only counts of
    rows come to the driver.
    """
    edges = stage(spark, slots.groupBy("pattern", "instance").agg(
        F.bit_or(F.when(F.col("kind") >= 0, F.call_function("shiftleft", F.lit(1), F.col("kind"))).otherwise(0)).alias("kinds"), F.max("many").alias("many"), F.min("shown").alias("shown"),
    ), "edges")
    known = edges.groupBy("instance").agg(F.bit_or("kinds").alias("kinds")).where("kinds != 0")
    seeds = stage(spark, known.select("instance", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.getbit("kinds", k) == 1)).alias("kind"), F.lit(1.0).alias("r")), "seeds")
    several = edges.where("many").groupBy("pattern").agg(F.count(F.lit(1)).alias("several"))
    reliable, totals, confident, had, rows = seeds, None, None, 0, texts.count()
    for _ in range(rounds):
        support = stage(spark, edges.join(reliable, "instance").groupBy("pattern", "kind").agg(F.sum("r").alias("support"), F.min("shown").alias("shown")).where(F.col("support") >= min_support), "support")
        wanted = support.groupBy("pattern").agg(F.floor(F.max("support") / min_confidence - 1).alias("most"))
        if totals is not None:  # counted in part only, and by what supports it now not yet enough
            wanted = wanted.join(totals.select("pattern", F.when(F.col("whole"), F.lit(1 << 62)).otherwise(F.col("fillers")).alias("_had")), "pattern", "left").where("_had is null or _had <= most").drop("_had")
        wanted = stage(spark, wanted, "wanted")
        if not wanted.isEmpty():
            more = filler_counts(spark, texts, text, wanted, rows)
            totals = more if totals is None else stage(spark, totals.join(more.select("pattern"), "pattern", "left_anti").unionByName(more), "totals")
        if totals is None:
            return None
        fillers = F.col("fillers") + F.coalesce("several", F.lit(0))
        scored = support.join(totals.where("whole"), "pattern").drop("whole").join(several, "pattern", "left").withColumn("fillers", fillers).withColumn("confidence", F.col("support") / (F.col("fillers") + 1))
        confident = stage(spark, scored.where(F.col("confidence") >= min_confidence).drop("several"), "confident")
        now = confident.count()
        if now == had:
            break
        had = now
        together = (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("r")
        found = edges.join(confident.select("pattern", "kind", "confidence"), "pattern").groupBy("instance", "kind").agg(together).join(seeds.select("instance").distinct(), "instance", "left_anti")
        reliable = stage(spark, seeds.unionByName(found), "reliable")
    return confident if had else None


def extract(spark: SparkSession, df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The columns of ``df`` but its text, with ``base`` and ``spans``: arrays of (kind, start, end) by kind and start.

    Kinds are places in :data:`KINDS`, offsets are code points, ends exclusive.
    ``base`` are the certain spans; ``spans`` has those the contexts add as
    well, none of which touches a base span.  Null, empty and wordless texts
    have none.  Spans depend on a text and the corpus alone, so repeated rows
    get equal spans and copies count as one instance; a kind is settled by
    confidence, ties by the order of kinds.  An empty table stays empty.
    Columns named ``base`` or ``spans`` in ``df`` are replaced.
    """
    box = sealed(df.drop(*[c for c in ("base", "spans") if c != text]))
    found = stage(spark, seeds_and_slots(box.df, box.name(text)), "slots")
    slots = found.select("_key", F.explode("slots").alias("s")).select("_key", "s.*")
    patterns = learn_patterns(spark, box.df, box.name(text), slots, **limits)
    if patterns is None:
        joined = found.withColumn("more", F.lit(None).cast("array<struct<kind: int, start: long, end: long>>"))
    else:
        hits = slots.where("kind < 0").drop("kind").join(patterns.select("pattern", "kind", "confidence"), "pattern")
        best = hits.groupBy("_key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("back"))).alias("b"))
        more = best.groupBy("_key").agg(F.collect_list(F.struct((-F.col("b.back")).alias("kind"), "start", "end")).alias("more"))
        joined = found.join(more, "_key", "left")
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce("more", F.array().cast("array<struct<kind: int, start: long, end: long>>"))))
    return joined.select(*[F.col(box.name(c)).alias(c) for c in box.names if c not in (text, "base", "spans")], "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
