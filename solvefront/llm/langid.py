"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary.  A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words.  Words are runs of letters
in lower case, each led by the vocabulary's word mark, so no piece spans two
words and a word's value can be kept: each is computed once per worker, in
batches of equal length.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm.common import rows_of
from solvefront.llm.tokenization import resolve

VOCABULARY = "piece_bpe_32k.model"
MAX_TRAIN_ROWS = 20_000
SMOOTHING = 0.1
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
SLICE_BYTES = 4 << 20
MEMO_WORDS = 500_000
MEMO_CHARS = 48
LONG = 30
#: Characters of a text worked on at once; a longer text is cut between words and its parts are added up.
PART_CHARS = 1 << 20
#: Below it, probabilities are scaled up again.
SMALL = 1e-100
MOST = 1e250


class Pieces:
    """The vocabulary: piece to id, and the bytes that stand for other characters."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=resolve(vocabulary))
        n = self.lib.get_piece_size()
        self.size = n
        self.byte = {}
        self.ids = {}
        for i in range(n):
            piece = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids), default=1)


_PIECES: dict[str, Pieces] = {}


def pieces(vocabulary: str) -> Pieces:
    if vocabulary not in _PIECES:
        _PIECES[vocabulary] = Pieces(vocabulary)
    return _PIECES[vocabulary]


class Scorer:
    """ln p(word | language) summed over all segmentations, with a bounded memo."""

    def __init__(self, vocabulary: str, log_p: np.ndarray):
        """log_p: vocabulary size x languages."""
        known = pieces(vocabulary)
        self.byte = known.byte
        self.ids = {p: i + 1 for p, i in known.ids.items()}
        self.longest = known.longest
        self.p = np.vstack([np.zeros(log_p.shape[1]), np.exp(log_p)])  # row 0: no such piece
        self.rows = len(self.p)
        self.memo: dict[str, int] = {}
        self.values = np.zeros((1024, log_p.shape[1]))

    def _fallback(self, char: str) -> None:
        """A row for a character that is no piece: the product of its bytes' probabilities.  Rows are as many as characters at most."""
        if self.rows == len(self.p):
            self.p = np.vstack([self.p, np.zeros((max(1024, len(self.p) // 4), self.p.shape[1]))])
        self.p[self.rows] = np.prod([self.p[self.byte[b] + 1] for b in char.encode()], axis=0)
        self.ids[char] = self.rows
        self.rows += 1

    def forward(self, words: list[str]) -> np.ndarray:
        """Words of one length, at most :data:`LONG`: all at once, scaled up wherever a value gets small."""
        n = len(words[0]) + 1
        spans = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        get = self.ids.get
        for c in set("".join(words)):
            if c not in self.ids:
                self._fallback(c)
        marked = [MARK + w for w in words]
        found = np.array([[get(s[i:j], 0) for i, j in spans] for s in marked], np.int32)
        alpha = np.zeros((n + 1, len(words), self.p.shape[1]))
        alpha[0] = 1
        scale = np.zeros(alpha.shape[1:])
        k = 0
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            for i in range(first, j):
                col = found[:, k]
                k += 1
                if col.any():
                    alpha[j] += alpha[i] * self.p[col]
            if (alpha[j] < SMALL).any():
                by = np.where((alpha[j] < SMALL) & (alpha[j] > 0), alpha[j], 1.0)
                # Only characters that are in no piece get so far apart that a value passes MOST; no piece starts there.
                with np.errstate(over="ignore"):
                    alpha[first : j + 1] = np.minimum(alpha[first : j + 1] / by, MOST)
                scale += np.log(by)
        return np.log(alpha[n]) + scale

    def forward_long(self, word: str) -> np.ndarray:
        """One word of any length, rescaled at each step so that nothing underflows."""
        s = MARK + word
        for c in set(word):
            if c not in self.ids:
                self._fallback(c)
        window = [np.ones(self.p.shape[1])]  # alpha of the last places over the running scale
        scale = np.zeros(self.p.shape[1])
        for j in range(1, len(s) + 1):
            a = np.zeros(self.p.shape[1])
            for back, before in enumerate(reversed(window), 1):
                row = self.ids.get(s[j - back : j], 0)
                if row:
                    a += before * self.p[row]
            if (a > 0).all():
                scale += np.log(a)
                with np.errstate(over="ignore"):
                    window = [np.minimum(w / a, MOST) for w in window]
                a = np.ones_like(a)
            window = [*window[-(self.longest - 1) :], a] if self.longest > 1 else [a]
        return scale

    def learn(self, missing: set[str]) -> None:
        need = len(self.memo) + len(missing)
        if need > len(self.values):
            self.values = np.vstack([self.values, np.zeros((max(need - len(self.values), len(self.values)), self.values.shape[1]))])
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in missing:
            by_length[len(w)].append(w)
        for n, words in by_length.items():
            for at in range(0, len(words), 4096):
                part = words[at : at + 4096]
                got = self.forward(part) if n <= LONG else np.array([self.forward_long(w) for w in part])
                first = len(self.memo)
                self.memo.update(zip(part, range(first, first + len(part)), strict=True))
                self.values[first : first + len(part)] = got

    def texts(self, texts: list[str]) -> np.ndarray:
        """Sums over each text's words; zeros without words.  Texts are gathered up to :data:`PART_CHARS`, whose new words are learnt together."""
        out = np.zeros((len(texts), self.values.shape[1]))
        held: list[tuple[int, str]] = []
        used = 0
        for k, text in enumerate(texts):
            for part in parts_of(text):
                held.append((k, part))
                used += len(part)
                if used >= PART_CHARS:
                    self._add(out, held)
                    held, used = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, str]]) -> None:
        found = [LETTERS.findall(text.lower()) for _, text in parts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        every = {w for words in found for w in words}
        long_words = {w for w in every if len(w) > MEMO_CHARS}
        self.learn({w for w in every if w not in memo} - long_words)
        for (k, _), words in zip(parts, found, strict=True):
            if long_words:
                for w in long_words.intersection(words):
                    out[k] += words.count(w) * self.forward_long(w)
                words = [w for w in words if len(w) <= MEMO_CHARS]
            if words:
                out[k] += self.values[[memo[w] for w in words]].sum(axis=0)


_NO_LETTER = re.compile(r"[\W\d_]")


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size``, cut where no word runs on."""
    at = 0
    while len(text) - at > size:
        stop = _NO_LETTER.search(text, at + size)
        end = stop.end() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def fit(spark: SparkSession, labelled: DataFrame, text: str = "text", lang: str = "lang", *, vocabulary: str = VOCABULARY, max_rows: int = MAX_TRAIN_ROWS, smoothing: float = SMOOTHING):
    """(languages, ln priors, ln p per piece and language), or None without a labelled text.

    Of more than ``max_rows`` labelled rows a hash-chosen sample of about that
    many is used.  Words are summed per language first, so each distinct word
    is cut once; what comes to the driver is at most a row per language and piece.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    n = rows.count()
    share = min(1.0, max_rows / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else rows

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        put = lambda: pa.RecordBatch.from_pylist([{"lang": a, "word": w, "n": c} for (a, w), c in found.items()], pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
        for b in rows_of(batches, text, SLICE_BYTES):
            for a, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[a, ""] += 1  # a document
                for part in parts_of(t):
                    found.update((a, w) for w in LETTERS.findall(part.lower()))
                    if len(found) > MEMO_WORDS:
                        yield put()
                        found.clear()
        yield put()

    counted = chosen.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = pieces(vocabulary).lib
        found: Counter = Counter()
        for b in batches:
            langs, words, ns = (b.column(i).to_pylist() for i in range(3))
            for a, ids, w, c in zip(langs, lib.encode(words, num_threads=1), words, ns, strict=True):
                if w:
                    for i in ids:
                        found[a, i] += c
                else:
                    found[a, -1] += c
        yield pa.RecordBatch.from_pylist([{"lang": a, "piece": i, "n": c} for (a, i), c in found.items()], pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.int64())]))

    got = counted.mapInArrow(count_pieces, "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got.column("lang").to_pylist()))
    at = {a: k for k, a in enumerate(langs)}
    counts = np.zeros((pieces(vocabulary).size, len(langs)))
    docs = np.zeros(len(langs))
    for a, i, c in zip(*(got.column(c).to_pylist() for c in ("lang", "piece", "n")), strict=True):
        if i < 0:
            docs[at[a]] += c
        else:
            counts[i, at[a]] += c
    counts += smoothing
    return langs, np.log(docs / docs.sum()), np.log(counts / counts.sum(axis=0))


_SCORERS: dict[str, Scorer] = {}


def predict(spark: SparkSession, df: DataFrame, model, text: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add lang_pred and score, the posterior of the predicted language.

    ``und`` with score 0 for null texts, texts without a letter, and without a
    model.  Ties go to the first language in order.  Whole texts are scored in
    the scan's partitions, in slices of bounded bytes.  Columns of these names
    are replaced; repeated rows get equal predictions.
    """
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    sent = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        if found and name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(vocabulary, found[2])
        for b in rows_of(batches, text, SLICE_BYTES):
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            if found:
                sums = _SCORERS[name].texts(texts) + found[1]
                top = sums.argmax(axis=1)
                posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                has = np.fromiter((LETTERS.search(t) is not None for t in texts), bool, len(texts))
                best, score = np.where(has, top, -1), np.where(has, posterior, 0.0)
            names = [*(found[0] if found else []), "und"]
            keep = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([names[k] for k in best], pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    return df.select(rest).mapInArrow(run, df.select(rest).schema.add("lang_pred", "string").add("score", "double"))


def identify(spark: SparkSession, df: DataFrame, is_training: Column, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Fit on the training rows and predict every row; language and other columns are no inputs of a prediction."""
    model = fit(spark, df.where(is_training), text, lang, **options)
    kept = {k: v for k, v in options.items() if k == "vocabulary"}
    return predict(spark, df.drop(lang), model, text, **kept)
