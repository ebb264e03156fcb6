"""Missing or wrong language labels: error-correcting output codes over binary n-gram classifiers.

Each language has a codeword, a row of a Hadamard matrix, so that any two differ in half of the bits. For each bit a
binary naive-Bayes classifier over words and character n-grams tells the languages with a 1 from those with a 0. A
sentence gets the language whose codeword has the least loss under the weighted margins of all bits; if the runner-up is
close, the decision is flagged and the sentences around it decide (a best path with a price for each change). Runs of
sentences in one language are the segments of a document. A text all of whose pieces, however small, agree is in one
language; only the others are cut into sentences.

The classifiers are fitted on a bounded sample of labelled documents (``FIT_ROWS``, of each at most ``FIT_CHARS``
characters), in two rounds: the second leaves out
the rows whose label the first one contradicts. Everything else is computed over all documents and whole texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.llm.sentences import sentence_ends

#: About how many labelled rows the classifiers are fitted on, the most characters of each, and the size of the feature table.
FIT_ROWS, FIT_CHARS, FEATURES = 6000, 2000, 1 << 16
LANGUAGES = "en de fr es pt it nl sv ru uk zh ja th ar hi".split()
# Other spellings of languages.
SPELLINGS = {
    "en": "eng english anglais englisch inglés", "de": "deu ger german deutsch allemand", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands flemish", "sv": "swe swedish svenska", "ru": "rus russian русский",
    "uk": "ukr ukrainian українська", "zh": "zho chi chinese cmn mandarin 中文 汉语", "ja": "jpn japanese 日本語", "th": "tha thai ไทย", "ar": "ara arabic العربية", "hi": "hin hindi हिन्दी",
}
_CODES = {s: lang for lang, names in SPELLINGS.items() for s in (lang, *names.split())}
_WORD = re.compile(r"[㐀-鿿々]|[぀-ヿ]+|[฀-๿]+|[^\W\d_㐀-鿿぀-ヿ฀-๿々]+")
_LATIN, _FOREIGN = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[^\W\d_A-Za-zÀ-ɏ]")
#: Price of a change of language between sentences, and the lead below which a decision counts as ambiguous.
CHANGE, LEAD = 6.0, 4.0


def code_of(label: str | None) -> str | None:
    """The two-letter code a label names, whatever its spelling; None if it names none of the languages."""
    if label is None:
        return None
    return _CODES.get(re.split(r"[-_ (,]", label.strip().casefold(), maxsplit=1)[0])


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 that differ in half of their bits."""
    h = np.ones((1, 1))
    while h.shape[0] <= n:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


def tokens(sentence: str) -> list[str]:
    """Words and characters that tell a language: in other scripts without the Latin words in between, which are names."""
    found = _WORD.findall(sentence)
    if sentence.isascii() or not _FOREIGN.search(sentence):
        return found
    foreign = [w for w in found if not _LATIN.match(w)]
    if sum(map(len, foreign)) >= 3:
        return foreign
    return found


def features(word: str) -> list[int]:
    """Hashed features of one token: the token itself and its character n-grams, each with its ends."""
    w = word.casefold()
    if not _LATIN.match(w) and len(w) > 12:  # scripts without spaces
        grams = {w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    else:
        padded = f"<{w}>"
        grams = {padded, *(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))}
    return [zlib.crc32(g.encode()) % FEATURES for g in sorted(grams)]


_features = lru_cache(maxsize=200_000)(features)
#: The scored tokens of the last model a Python worker saw, kept from task to task.
_KEPT: dict[str, "Model"] = {}


class Model:
    """Bit weights per feature; tokens are scored once and kept."""

    def __init__(self, weights: np.ndarray, words: np.ndarray) -> None:
        self.weights, self.words = weights, words
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.empty((0, weights.shape[1]), dtype=np.float32)

    def margins(self, sentences: list[list[str]]) -> np.ndarray:
        """The margin of each bit for each sentence."""
        if len(self.known) > 500_000:
            self.known.clear()
            self.rows.clear()
            self.table = self.table[:0]
        words = list(chain.from_iterable(sentences))
        ids = list(map(self.known.get, words))
        if None in ids:
            for i, w in enumerate(words):
                if ids[i] is None and (k := self.known.get(w)) is not None:
                    ids[i] = k
                elif ids[i] is None:
                    ids[i] = self.known[w] = len(self.rows)
                    f = _features(w)
                    self.rows.append(self.weights[f].mean(axis=0) * min(4, len(f) ** 0.5))
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], dtype=np.float32)])
        sums = np.zeros((len(sentences), self.weights.shape[1]), dtype=np.float32)
        if ids:
            owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
            order = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            sums[owner[order]] = np.add.reduceat(self.table[np.array(ids)], order, axis=0)
        return sums

    def scores(self, sentences: list[list[str]]) -> np.ndarray:
        """Minus the loss of each language's codeword: the logistic loss of the margins, so that sure bits weigh most."""
        m = self.margins(sentences).astype(np.float64)
        plus, minus = (self.words > 0).astype(float), (self.words < 0).astype(float)
        return -(np.logaddexp(0, -m) @ plus.T + np.logaddexp(0, m) @ minus.T) * (4.0 / self.words.shape[1])


def fit(texts: list[list[str]], labels: list[int], languages: int = len(LANGUAGES)) -> Model:
    """Counts of the tokens' features per language, then per bit the log odds of each feature between its two groups of languages."""
    counts = np.zeros((languages, FEATURES), dtype=np.float64)
    by_label: dict[int, Counter] = {}
    for text, label in zip(texts, labels):
        by_label.setdefault(label, Counter()).update(text)
    for label, words in by_label.items():
        for w, n in words.items():
            np.add.at(counts[label], _features(w), float(n))
    share = (counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * FEATURES)
    present = counts.sum(axis=1) > 0
    share[~present] = 0.02 / FEATURES
    words = codewords(languages)
    plus = (words > 0).astype(float)
    positive = plus.T @ share / np.maximum(plus.sum(axis=0)[:, None], 1)
    negative = (1 - plus).T @ share / np.maximum((1 - plus).sum(axis=0)[:, None], 1)
    return Model(np.log(positive / negative).T.astype(np.float32), words)


def best_path(scores: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """The language of each sentence: least loss in all, with a price for each change; unusable sentences follow their neighbours."""
    n, k = scores.shape
    s = np.where(usable[:, None], scores, 0.0)
    total, back = s[0].copy(), np.zeros((n, k), dtype=int)
    for i in range(1, n):
        top = int(np.argmax(total))
        stay = total >= total[top] - CHANGE
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, total[top] - CHANGE) + s[i]
    path = np.zeros(n, dtype=int)
    path[-1] = int(np.argmax(total))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


SEGMENTS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("label", T.StringType()), ("seg_no", T.IntegerType()), ("n_segments", T.IntegerType()), ("lang", T.StringType()),
    ("confidence", T.DoubleType()), ("ambiguous", T.BooleanType()), ("start", T.IntegerType()), ("end", T.IntegerType()),
)])


#: Segments of texts in one language, and the texts that may be in several.
OPEN = T.StructType([*SEGMENTS, T.StructField("text", T.StringType())])
_PIECES, _BLANKS = re.compile("[.!?。！？।؟\n]+"), " \n\t\r\u00a0\u2009\u202f\u3000"


def _in_one_language(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(row, language, confidence, whether ambiguous) of the texts all of whose pieces are in one language.

    Pieces end at every mark that could end a sentence, so that none reaches over a sentence; a text with a piece in another
    language, or with none that is long enough to tell, is left to its sentences.
    """
    cut = [[w for x in _PIECES.split(t) if x and (w := tokens(x))] for t in texts]
    sizes = np.array([len(c) for c in cut], dtype=np.int64)
    pieces = list(chain.from_iterable(cut))
    if not pieces:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    row, scores = np.repeat(np.arange(len(texts)), sizes), model.scores(pieces)
    usable = np.array([len(w) >= 2 or len(w[0]) >= 8 for w in pieces])
    best = scores.argmax(axis=1)
    least, most = np.full(len(texts), len(LANGUAGES)), np.full(len(texts), -1)
    np.minimum.at(least, row[usable], best[usable])
    np.maximum.at(most, row[usable], best[usable])
    sure = np.flatnonzero(least == most)
    total = np.add.reduceat(scores, np.r_[0, np.cumsum(sizes[sizes > 0])[:-1]], axis=0)[np.searchsorted(np.flatnonzero(sizes > 0), sure)]
    chosen = total[np.arange(len(sure)), most[sure]]
    others = total.copy()
    others[np.arange(len(sure)), most[sure]] = -np.inf
    share = 1 / np.exp(np.clip(total - chosen[:, None], -50, 50)).sum(axis=1)
    return sure, most[sure], share, chosen - others.max(axis=1) < LEAD


def _segmented(model: Model, texts: list[str], ends: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Per segment of a batch: row, number from 1, segments of the row, language, confidence, whether ambiguous, start, end."""
    cuts = ends.offsets.to_numpy() - ends.offsets[0].as_py()
    stop = ends.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(cuts))
    start = np.r_[0, stop[:-1]][: len(stop)]
    start[cuts[:-1][np.diff(cuts) > 0]] = 0
    words = [tokens(texts[r][a:b]) for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
    scores = model.scores(words) if words else np.zeros((0, len(LANGUAGES)))
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    usable = lengths >= 2
    for i in np.flatnonzero(lengths == 1).tolist():
        usable[i] = len(words[i][0]) >= 8
    path = scores.argmax(axis=1) if len(words) else np.empty(0, dtype=np.int64)
    n_of = np.diff(cuts)
    has_words = np.add.reduceat(np.r_[lengths, 0], np.minimum(cuts[:-1], len(lengths))) * (n_of > 0) if len(texts) else n_of
    # a row whose usable sentences agree is in one language: no change of language could lower its loss
    least = np.full(len(texts), len(LANGUAGES))
    most = np.full(len(texts), -1)
    np.minimum.at(least, row[usable], path[usable])
    np.maximum.at(most, row[usable], path[usable])
    one = least == most
    path = np.where(one[row], most[row], path)
    for r in np.flatnonzero(~one & (has_words > 0)).tolist():
        part = slice(cuts[r], cuts[r + 1])
        path[part] = best_path(scores[part], usable[part])
    first = np.flatnonzero((has_words[row] > 0) & np.r_[True, (np.diff(row) != 0) | (np.diff(path) != 0)][: len(row)])
    if not len(first):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(8))
    last = np.array([*first[1:], len(row)])
    last = np.minimum(last, cuts[row[first] + 1])
    total = np.add.reduceat(scores, first, axis=0) if (last[:-1] == first[1:]).all() and last[-1] == len(row) else np.array([scores[a:b].sum(axis=0) for a, b in zip(first, last)])
    chosen = total[np.arange(len(first)), path[first]]
    others = total.copy()
    others[np.arange(len(first)), path[first]] = -np.inf
    share = 1 / np.exp(np.clip(total - chosen[:, None], -50, 50)).sum(axis=1)
    own = row[first]
    number = np.arange(len(own)) - np.searchsorted(own, own) + 1
    return own, number, np.bincount(own, minlength=len(texts))[own], path[first], share, chosen - others.max(axis=1) < LEAD, start[first], stop[last - 1]


def segments(df: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """One row per document and one-language segment: language, confidence, whether it is ambiguous, and its range.

    ``start`` and ``end`` are half-open positions from 0. Texts that are null or without letters give no row; a document
    of names only gets the language of its best guess, flagged ambiguous. Rows with a null id give none; repeated rows
    give repeated results. Tables without letters give an empty result; where texts have letters but no row a usable label to fit on, an error is raised.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    # a bounded sample by hash, not by place: about fit_rows rows, and of each text at most fit_chars characters from its middle
    share = min(1.0, fit_rows / max(1, df.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = rows.where(chosen & (F.length("text") > 40)).select("label", F.expr(f"substring(text, greatest(1, cast((length(text) - {fit_chars}) / 2 as int)), {fit_chars})").alias("text")).limit(2 * fit_rows).collect()
    labelled = [(tokens(r.text), LANGUAGES.index(c)) for r in sample if (c := code_of(r.label))]
    if not labelled and rows.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        return df.sparkSession.createDataFrame([], SEGMENTS)
    if not labelled:
        raise ValueError("no row has a label that names one of the languages: there is nothing to fit on")
    model = fit([t for t, _ in labelled], [k for _, k in labelled])
    for _ in range(2):  # leave out wrong labels and mixed texts
        guess = model.scores([t for t, _ in labelled])
        kept = [(t, k) for (t, k), g in zip(labelled, guess) if int(np.argmax(g)) == k]
        model = fit([t for t, _ in kept], [k for _, k in kept])
    weights, words, name = model.weights, model.words, uuid.uuid4().hex

    def kept() -> Model:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Model(weights, words)
        return _KEPT[name]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            row, lang, share, ambiguous = _in_one_language(own, texts)
            open_ = np.setdiff1d(np.arange(len(texts)), row)
            order, n = np.r_[row, open_], len(open_)
            none = lambda values, kind: pa.array([*values, *[None] * n], kind)
            columns = [batch.column(0).take(pa.array(order)), batch.column(1).take(pa.array(order)), none([1] * len(row), pa.int32()), none([1] * len(row), pa.int32()), none([LANGUAGES[k] for k in lang], pa.string())]
            columns += [none(share.tolist(), pa.float64()), none(ambiguous.tolist(), pa.bool_()), none([0] * len(row), pa.int32()), none([len(texts[r].rstrip(_BLANKS)) for r in row.tolist()], pa.int32())]
            columns.append(pa.array([*[None] * len(row), *(texts[r] for r in open_.tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=OPEN.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept()
        for batch in batches:
            text = batch.column(len(SEGMENTS.names))
            yield batch.filter(text.is_null()).select(SEGMENTS.names)
            rest = batch.filter(text.is_valid())
            row, number, of, lang, share, ambiguous, start, end = _segmented(own, rest.column(len(SEGMENTS.names)).to_pylist(), rest.column(len(OPEN.names)))
            names = pa.array(LANGUAGES).take(pa.array(lang.astype(np.int64)))
            columns = [rest.column(0).take(pa.array(row)), rest.column(1).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(of.astype(np.int32)), names]
            columns += [pa.array(share.astype(np.float64)), pa.array(ambiguous.astype(bool)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=SEGMENTS.names)

    first = rows.mapInArrow(plain, OPEN)
    return first.withColumn("ends", F.when(F.col("text").isNotNull(), sentence_ends(F.col("text")))).mapInArrow(run, SEGMENTS)


def label_is(label, lang):
    """Whether a label column names the language of another column, in any spelling."""
    table = F.create_map(*[F.lit(x) for s, c in sorted(_CODES.items()) for x in (s, c)])
    head = F.split(F.lower(F.trim(label)), r"[-_ (,]", 2)[0]
    return F.coalesce(table[head] == lang, F.lit(False))
