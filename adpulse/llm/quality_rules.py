"""Quality rules by tokenizer fertility.

A public vocabulary is measured on each whole text: characters per token, the share
of tokens that are single bytes for want of a piece (byte fallback), and the entropy
of the tokens. Text of a language that the vocabulary knows has a steady fertility;
junk falls outside: few characters a token (noise, encoded data), many (long runs that
are one piece), many byte tokens (broken or binary content), or few distinct tokens for
its length (repetition). The bands are set per language code, else per script, and are a
parameter. Beside them stand two base rules: fewer than 50 words, or more than half the
words in repeated three-word windows.

Every text is judged by itself, in one pass without a shuffle, so hot sources and
copies do no harm. A worker encodes each distinct word once (its pieces do not cross
white space).

Defined cases: a null or empty text has no words and fails the base rules, its measures
are 0; any language code, null too, falls back to the band of the text's script, and so do
all texts of a table without the column lang; rows with the same doc_id are judged one by
one; other columns are left as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adpulse.llm.common import STRETCH, PieceCache, in_slices, little

#: What separates words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_tokens long, chars_per_token double, byte_share double, entropy double, "
            "script string, base_failed boolean, kept boolean")


@dataclass(frozen=True)
class Band:
    """What is accepted, ends included. `entropy` is that of the token
    distribution in bits, divided by log2 of the number of tokens, or of
    `entropy_tokens` if there are more: longer texts repeat their words."""
    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    entropy_tokens: int = 512

    def accepts(self, chars_per_token: float, byte_share: float, bits: float, n_tokens: int) -> bool:
        most = math.log2(max(2, min(n_tokens, self.entropy_tokens)))
        return (self.chars_per_token[0] <= chars_per_token <= self.chars_per_token[1]
                and byte_share <= self.byte_share and bits >= self.entropy * most)


#: By language code or script. Alphabets need two to five characters a token in
#: ordinary prose of 32,000 pieces; scripts written without spaces about one.
#: The languages' floors are fitted on the labelled clean documents of sf 0.1 with an even
#: doc_id that pass the base rules (951 en, 240 de, 233 fr, 154 es): the lowest value,
#: less 0.1 characters a token; in hundredths and less 0.01 of entropy.
BANDS: Mapping[str, Band] = {
    "en": Band((1.75, 12.0), 0.25, 0.69),
    "de": Band((1.94, 12.0), 0.25, 0.69),
    "fr": Band((1.62, 12.0), 0.25, 0.67),
    "es": Band((1.70, 12.0), 0.25, 0.67),
    "latin": Band((1.3, 12.0), 0.25, 0.66),
    "cyrillic": Band((1.0, 12.0), 0.35, 0.45),
    "greek": Band((0.7, 12.0), 0.6, 0.4),
    "han": Band((0.3, 6.0), 0.9, 0.4),
    "arabic": Band((0.5, 12.0), 0.4, 0.35),
    "hebrew": Band((0.5, 12.0), 0.4, 0.35),
    "indic": Band((0.35, 12.0), 0.8, 0.35),
    "thai": Band((0.5, 12.0), 0.4, 0.35),
    "armenian": Band((0.5, 12.0), 0.4, 0.35),
    "georgian": Band((0.5, 12.0), 0.4, 0.35),
    "ethiopic": Band((0.25, 12.0), 0.92, 0.35),
    "other": Band((0.25, 12.0), 1.0, 0.35),  # scripts that may have no piece at all
    "none": Band((0.25, 12.0), 0.25, 0.35),  # no letters
}
_SCRIPTS = [("latin", re.compile(r"[A-Za-zÀ-ɏ]")), ("cyrillic", re.compile(r"[Ѐ-ԯ]")),
            ("greek", re.compile(r"[Ͱ-Ͽ]")),
            ("han", re.compile(r"[぀-ヿ㐀-鿿가-힯]"))]
_FURTHER = [("arabic", re.compile(r"[\u0600-\u06ff\u0750-\u077f]")), ("hebrew", re.compile(r"[\u0590-\u05ff]")),
            ("indic", re.compile(r"[\u0900-\u09ff\u0b80-\u0bff\u0c00-\u0c7f]")), ("thai", re.compile(r"[\u0e00-\u0e7f]")),
            ("armenian", re.compile(r"[\u0530-\u058f]")), ("georgian", re.compile(r"[\u10a0-\u10ff]")),
            ("ethiopic", re.compile(r"[\u1200-\u137f]"))]
#: Where letters of further scripts are.
_BEYOND = re.compile(r"[\u0530-\u1dff\u2c00-\u2dff\ua000-\uabff\U00010000-\U0003ffff]")
_ASCII = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
_CACHES: dict[str, tuple[PieceCache, np.ndarray]] = {}


def _pieces(path: str) -> tuple[PieceCache, np.ndarray]:
    """The worker's cache for the vocabulary, and which of its ids are bytes."""
    if path not in _CACHES:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        cache = PieceCache(lambda words: [little(x) for x in sp.encode(words, num_threads=1)],
                           lambda texts: pc.ascii_split_whitespace(pa.array(texts, pa.string())), _stretches)
        _CACHES[path] = cache, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return _CACHES[path]


def _stretches(text: str) -> list[str]:
    """One text in parts of some STRETCH characters, cut at white space."""
    out, at = [], 0
    while len(text) - at > STRETCH and (found := _SPACE.search(text, at + STRETCH)):
        out.append(text[at:found.start()])
        at = found.start()
    return [*out, text[at:]]


def script_of(text: str) -> str:
    """The script of most of its letters; "other" if it has no name here, "none" if
    there are no letters."""
    if text.isascii():
        return "latin" if _ASCII.search(text) else "none"
    scripts, unnamed = _SCRIPTS, 0
    if _BEYOND.search(text):
        scripts, rest = _SCRIPTS + _FURTHER, text
        for _, p in scripts:
            rest = p.sub("", rest)
        unnamed = sum(map(str.isalpha, rest))
    counts = [(len(p.findall(text)), name) for name, p in scripts]
    most = max([*counts, (unnamed, "other")])
    if most[0]:
        return most[1]
    return "other" if any(map(str.isalpha, text)) else "none"


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0  # words before it are counted
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def judge(texts: list[str], langs: list[str | None], vocabulary: str, bands: Mapping[str, Band]) -> list[tuple]:
    cache, is_byte = _pieces(vocabulary)
    rows = []
    for text, lang, ids in zip(texts, langs, cache.ids(texts)):
        base = n_words, word_chars, _, _, n_repeat_words = base_measures(text)
        tokens = np.frombuffer(ids, "<u4")
        n, per_token, byte_share, bits = len(tokens), 0.0, 0.0, 0.0
        if n:
            per_token, byte_share = word_chars / n, float(is_byte[tokens].mean())
            share = np.unique(tokens, return_counts=True)[1] / n
            bits = float(-(share * np.log2(share)).sum())
        script = script_of(text)
        failed = n_words < 50 or 100 * n_repeat_words > 50 * n_words
        band = bands.get(lang) or bands.get(script) or bands["other"]
        rows.append((*base, n, per_token, byte_share, abs(bits), script, failed,
                     not failed and band.accepts(per_token, byte_share, bits, n)))
    return rows


def measures(docs: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> Column:
    """The measures and the verdict of columns text and lang as a struct."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measure(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang in columns:
            rows = []
            batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(lang, pa.string())],
                                               names=["text", "lang"])
            for part in in_slices(iter([batch])):
                rows += judge(part.column("text").to_pylist(), part.column("lang").to_pylist(), vocabulary, bands)
            yield pd.DataFrame(rows, columns=names)

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return measure(F.coalesce(F.col("text").cast("string"), F.lit("")), lang.cast("string"))


def rate(docs: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """doc_id, lang (where there is one) and every measure and verdict of each document."""
    lang = ["lang"] if "lang" in docs.columns else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *lang,
                       measures(docs, vocabulary, bands).alias("_m")).select("doc_id", *lang, "_m.*")


def accepted(docs: DataFrame, vocabulary: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return docs.where(measures(docs, vocabulary, bands)["kept"])
