"""Quality rules from how a public vocabulary cuts a text up: its fertility.

For every document: characters per token, the share of tokens that are fallback bytes, and the
entropy of the token distribution, held against bands of the document's language (bands of its
main script where the language has none). Ahead of them stand counts of plain defects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Distinct words whose tokens a Python worker remembers; beyond it the memory starts anew.
MEMORY = 600_000


@dataclass(frozen=True)
class Band:
    """What a text may have.

    Characters per token are an average over the tokens, so for short texts the lower bound gives
    way by ``slack`` over the root of the token count. Entropy is in bits, as a share of what n
    tokens can show of a language whose tokens have ``full_entropy``: :func:`attainable`.
    """

    least_chars_per_token: float = 1.0
    most_chars_per_token: float = 12.0
    most_byte_share: float = 0.25
    full_entropy: float = 8.0
    least_entropy_share: float = 0.50
    slack: float = 3.0


#: Bands by language; scripts and "*" serve languages that aren't listed.
#: Languages: :func:`language_bands` over the documents of the tables at scale 0.1 that are labelled
#: as of good quality (en 2,076, de 507, fr 505, es 321) and pass the base rules. Full entropy is
#: as found; lower bounds are the 0.5 % quantiles found (2.20, 2.24, 1.96 and 1.95 characters, 0.935,
#: 0.948, 0.949 and 0.925 of the entropy) less 0.02, rounded down. Of the good ones about 1 in 200
#: falls outside, of those labelled as bad that pass the base rules more than 9 in 10. No good
#: document has a fallback byte, or more than 2.5 characters per token: the upper bounds are wide.
#: Scripts have no documents of their own in those tables. Latin is the four languages together
#: (8.12 bits, 1.97 characters, 0.82 of the entropy) with wide margins; the others are guesses.
BANDS = {
    "en": Band(2.18, 8.0, 0.10, 7.09, 0.91),
    "de": Band(2.21, 8.0, 0.10, 6.84, 0.92),
    "fr": Band(1.94, 8.0, 0.10, 6.76, 0.92),
    "es": Band(1.93, 8.0, 0.10, 6.92, 0.90),
    "latin": Band(1.50, 9.0, 0.15, 8.12, 0.70),
    "cyrillic": Band(1.20, 8.0, 0.15, 7.0, 0.60),
    "han": Band(0.40, 4.0, 0.60, 8.0, 0.50),
    "*": Band(),
}


def attainable(n_tokens, full_entropy: float):
    """Bits that n tokens can show, about: they and the language's 2 ** full_entropy equally likely tokens limit each other."""
    return -np.log2(1 / np.maximum(n_tokens, 1) + 2.0**-full_entropy)


_SCRIPTS = (("han", re.compile("[぀-ヿ㐀-鿿가-힯]")), ("cyrillic", re.compile("[Ѐ-ӿ]")), ("latin", re.compile("[A-Za-zÀ-ɏ]")))

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("n_tokens", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("chars_per_token", "byte_share", "token_entropy")]
    + [T.StructField("band", T.StringType())]
)


class WordTokens(dict):
    """A number for each word met; the tokens of number k are ``ids[first[k]:first[k + 1]]``."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.new.append(word)
        return found

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers. Call :meth:`settle` before asking for the tokens of new ones."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Make the tokens of all words that are new, at once."""
        if self.new:
            made = self.model.encode([w.decode("utf-8", "replace") for w in self.new], num_threads=1)
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, flat])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.new = []

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        first = self.first[numbers]
        sizes = self.first[numbers + 1] - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + sizes, sizes) + np.arange(total)]


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of words found twice or more, the first find included."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    # a quick look that can't miss a repeat: equal windows have equal sums of this kind
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n, np.uint64)
    for j in range(window):
        total = total * np.uint64(0xD1342543DE82EF95) + mixed[j : j + n]
    total.sort()
    if not (total[1:] == total[:-1]).any():
        return 0
    # each window is numbered by the pair (number of its first half, number of its second half), so equal numbers mean equal words
    named, size = numbers, 1
    while size < window:
        step = min(size, window - size)
        left, right = named[: len(named) - step], named[step:]
        _, named = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        size += step
    again = np.bincount(named)[named] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _lines_and_words(text: str, words_of: WordTokens) -> tuple:
    """What a text shows before its tokens are known: the words' numbers, and the plain counts."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes: splits at the six ASCII white-space characters and no others
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return words_of.numbers(words), word_chars, n_symbols, len(lines) - len(set(lines))


def _verdict(text: str, lang: str | None, found: tuple, words_of: WordTokens, bands: dict[str, Band]) -> tuple:
    numbers, word_chars, n_symbols, n_dup_lines = found
    n = len(numbers)
    n_repeat = repeated_words(np.unique(numbers, return_inverse=True)[1]) if n > WINDOW else 0
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PERCENT * n
    ids = words_of.tokens(numbers)
    n_tokens = len(ids)
    share = cpt = entropy = 0.0
    if n_tokens:
        share = float(words_of.is_byte[ids].mean())
        cpt = word_chars / n_tokens
        p = np.bincount(ids)
        p = p[p > 0] / n_tokens
        entropy = float(-(p * np.log2(p)).sum())
    name = lang if lang in bands else next((k for k, pattern in _SCRIPTS if k in bands and pattern.search(text)), "*")
    band = bands.get(name) or Band()
    good = band.least_chars_per_token - band.slack / max(n_tokens, 1) ** 0.5 <= cpt <= band.most_chars_per_token and share <= band.most_byte_share and entropy >= band.least_entropy_share * attainable(n_tokens, band.full_entropy)
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, failed, bool(not failed and good), n_tokens, cpt, share, entropy, name


def measures(texts, langs, words_of: WordTokens, bands: dict[str, Band]) -> Iterator[tuple]:
    """The columns of SCHEMA after doc_id for each whole text, in order; a null text has no words.

    Texts are taken a few million characters at a time, so that new words are cut up together.
    """
    held: list[tuple] = []
    chars = 0

    def flush() -> Iterator[tuple]:
        words_of.settle()
        for text, lang, found in held:
            yield _verdict(text, lang, found, words_of, bands)
        held.clear()
        if len(words_of) > MEMORY:
            words_of.begin()

    for text, lang in zip(texts, langs, strict=True):
        text = text or ""
        held.append((text, lang, _lines_and_words(text, words_of)))
        chars += len(text)
        if chars > 4_000_000:
            yield from flush()
            chars = 0
    yield from flush()


_memory: dict[str, WordTokens] = {}


def fertility(docs: DataFrame, bands: dict[str, Band] | None = None, model_path: str | None = None) -> DataFrame:
    """One row of measures and a verdict for every row of ``docs`` (doc_id, text, lang).

    A null text has no words and fails. Repeated rows are measured each; ties can't arise; an
    empty table gives an empty result; a null or unlisted language falls back to the text's
    script, then to "*". Texts of any length are measured whole: a task holds one with a number
    for each of its words. Other columns are ignored.
    """
    measure = _measured(_path(model_path), BANDS if bands is None else bands)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), measure(docs["text"], docs["lang"]).alias("m")).select("doc_id", "m.*")


def language_bands(docs: DataFrame, quantile: float = 0.005, model_path: str | None = None) -> DataFrame:
    """lang, n, full_entropy, chars_per_token, entropy_share: where bands for new languages may begin.

    ``docs`` (doc_id, text, lang) should be known to be good; those that fail the base rules are
    left out. Full entropy is that of all their tokens; the other two are the quantiles of what
    is bounded from below: characters per token plus the slack of their length, and the entropy
    over what is attainable.
    """
    path = _path(model_path)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = WordTokens(path)
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                numbers = [words_of.numbers(t.encode("utf-8", "replace").split()) for t in part["text"]]
                words_of.settle()
                tokens, n = np.unique(words_of.tokens(np.concatenate(numbers)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "token": tokens, "n": n})
                if len(words_of) > MEMORY:
                    words_of.begin()

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").dropna(subset=["text", "lang"])
    measured = known.select("lang", "text", _measured(path, BANDS)("text", "lang").alias("m")).where("not m.base_failed and m.n_tokens > 0")
    tokens = measured.select("lang", "text").mapInPandas(counts, "lang string, token long, n long").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    full = tokens.groupBy("lang").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("full_entropy"))
    most = -F.log2(1 / F.col("m.n_tokens") + F.pow(F.lit(2.0), -F.col("full_entropy")))
    bound = lambda c: F.round(F.percentile(c, F.lit(quantile)), 3)
    return (
        measured.select("lang", "m")
        .join(full, "lang")
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.round(F.first("full_entropy"), 2).alias("full_entropy"), bound(F.col("m.chars_per_token") + Band.slack / F.sqrt("m.n_tokens")).alias("chars_per_token"), bound(F.col("m.token_entropy") / most).alias("entropy_share"))
    )


def _path(model_path: str | None) -> str:
    if model_path is None:
        import public_tokenizers as public

        return public.path("piece_bpe_32k.model")
    return model_path


def _measured(model_path: str, bands: dict[str, Band]):
    """A column function of text and lang: the measures of SCHEMA after doc_id."""
    names = SCHEMA.fieldNames()[1:]

    @F.pandas_udf(T.StructType(SCHEMA.fields[1:]))
    def measure(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        if model_path not in _memory:
            _memory[model_path] = WordTokens(model_path)
        return pd.DataFrame(list(measures(texts, langs, _memory[model_path], bands)), columns=names)

    return measure


def keep_fertile(docs: DataFrame, bands: dict[str, Band] | None = None, model_path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Edge cases are as in :func:`fertility`."""
    measure = _measured(_path(model_path), BANDS if bands is None else bands)
    return docs.where(measure(docs["text"], docs["lang"])["kept"])


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return fertility(table(spark, sf_dir, "documents"))
