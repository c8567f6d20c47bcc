"""Operator 2: language identification of whole and of mixed texts.

A text is a sequence of words.  The scripts of a word's letters, by ranges of
code points, narrow the languages it can belong to; its score in each is the sum of log
probabilities of its byte trigrams.  Viterbi with a penalty for each switch
labels the words; runs of one label are spans.  The language with the most
letters is the text's language.

Training counts trigrams and scripts of labelled texts, at most about
``TRAIN_ROWS`` texts a language, taken by a hash of their ids.

Defined results: a null text and one without any letter
(a character of Unicode category L) are ``und`` with score 0; texts in a script no learned language uses get a learned label with a score
of one over the number of languages; without any labelled text every text is
``und``; of languages with equal scores the first by name wins; texts of any
length are labelled whole; equal rows have equal labels; further columns are
ignored whatever their names are; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_buffer, trimmed

#: Labelled texts of each language that training reads, about, at most.
TRAIN_ROWS = 6000
#: Log probability that a switch of language costs.
SWITCH = 14.0
BINS = 1 << 16
#: Least share of a language's words for a script to count as its own.
SCRIPT_SHARE = 0.002
UNKNOWN = "und"

#: Blocks of code points by script.  Letters outside all of them are one more script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x700, 0x74F)],
    "thaana": [(0x780, 0x7BF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = 64


@cache
def script_bits() -> np.ndarray:
    """For each code point the bit of its script if it is a letter, else 0."""
    letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    bits = np.full(0x110000, 1 << len(SCRIPTS), np.uint64)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            bits[a : b + 1] = 1 << k
    return np.where(letters, bits, np.uint64(0))


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script bit of each character's letter, at its first byte of UTF-8."""
    bits = script_bits()
    out = np.zeros(len(data), np.uint64)
    plain = data < 0x80
    out[plain] = bits[:0x80][data[plain]]
    padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64)
    for least, most, size, mask in ((0xC0, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF7, 4, 0x07)):
        at = np.flatnonzero((data >= least) & (data <= most))
        code = padded[at] & mask
        for i in range(1, size):
            code = code << 6 | padded[at + i] & 0x3F
        out[at] = bits[np.minimum(code, 0x10FFFF)]
    return out


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Features:
    """Words, trigram bins of their bytes, and their scripts, for some texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        folded = _FOLD[data]
        if len(data) > 1:  # capitals of Latin-1
            folded[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
        padded = np.full(len(data) + len(at) + 1, 0x20, np.uint8)  # a blank before each text
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(data)) + text + 1
        padded[place] = folded
        lead = np.zeros(len(padded), np.uint64)
        lead[place] = byte_scripts(data)
        inside = padded != 0x20
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        wide = padded.astype(np.uint32)
        mixed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        self.bins = np.zeros(len(padded), np.int32)
        self.bins[1:-1] = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int32)
        self.inside, self.start, self.end = inside, begins, ends
        self.scripts = np.bitwise_or.reduceat(lead, begins) if len(begins) else np.zeros(0, np.uint64)
        self.letters = (ends - begins) * (self.scripts > 0)
        self.first = np.searchsorted(begins, at + np.arange(len(at)))
        self.back = np.arange(len(at) - 1) + 1  # bytes that padding put before each text


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probabilities, bins x languages
    scripts: np.ndarray  # bits of the scripts of each language

    def word_scores(self, f: Features) -> np.ndarray:
        scores = np.empty((len(f.start), len(self.languages)), np.float32)
        if len(f.start):
            for k in range(len(self.languages)):
                values = self.table[:, k][f.bins]
                values[~f.inside] = 0
                scores[:, k] = np.add.reduceat(values, f.start)
        for k, own in enumerate(self.scripts):
            strange = (f.scripts != 0) & ((f.scripts & own) == 0) & ((f.scripts & np.bitwise_or.reduce(self.scripts)) != 0)
            scores[strange, k] -= 50
        known = (f.scripts & np.bitwise_or.reduce(self.scripts)) != 0 if len(self.scripts) else np.zeros(len(f.start), bool)
        scores[~known] = 0  # digits, and scripts no language has
        return scores

    def labels(self, s: np.ndarray) -> np.ndarray:
        """The best sequence of languages for a text's word scores."""
        best = int(np.argmax(s.sum(axis=0)))
        if len(self.languages) == 1 or not len(s):
            return np.full(len(s), best)
        gain = np.cumsum((np.delete(s, best, 1) - s[:, best : best + 1]).max(axis=1, initial=-np.inf))
        if float((gain - np.minimum.accumulate(np.r_[np.float32(0), gain[:-1]])).max()) <= SWITCH:
            return np.full(len(s), best)  # no detour pays for its first switch
        value, came = s[0].astype(float), np.empty(s.shape, np.int32)
        own = np.arange(s.shape[1])
        for t in range(1, len(s)):
            top = int(value.argmax())
            switch = value[top] - SWITCH > value
            came[t] = np.where(switch, top, own)
            value = np.maximum(value, value[top] - SWITCH) + s[t]
        out = np.empty(len(s), np.int64)
        out[-1] = value.argmax()
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from columns doc_id, text, lang; only sums come to the driver."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros(0, np.uint64))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(rows / sizes[k]))))
    taken = labelled.where((F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(17)), F.lit(1_000_003)) / 1_000_003) < F.element_at(share, F.col("lang")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(BINS + N_SCRIPTS, np.int64) for k in languages}
        for batch in pieces(batches):
            lang = batch.column(2).to_pylist()
            for k in set(lang):
                part = batch.filter(pa.array([x == k for x in lang]))
                f = Features(*text_buffer(part.column(1)))
                sums[k][:BINS] += np.bincount(f.bins[f.inside], minlength=BINS)
                sums[k][BINS:] += [np.count_nonzero(f.scripts & np.uint64(1 << b)) for b in range(N_SCRIPTS)]
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])], ["lang", "bin", "n"])

    sums = taken.select("doc_id", "text", "lang").mapInArrow(trimmed(counted), "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((BINS, len(languages))), np.zeros(len(languages), np.uint64)
    for k, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        grams = own[own["bin"] < BINS]
        table[grams["bin"], k] = grams["n"]
        words = own[own["bin"] >= BINS]
        for b, n in zip(words["bin"] - BINS, words["n"], strict=True):
            if n >= SCRIPT_SHARE * words["n"].sum():
                scripts[k] |= np.uint64(1 << int(b))
    used = max(1, np.count_nonzero(table.sum(axis=1)))
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * used))
    return Model(languages, table.astype(np.float32), scripts)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), spans: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """lang_pred and score of every text, under ``names``, beside doc_id and the columns ``keep``.

    With ``spans``: start, end (bytes of the text in UTF-8) and language of each
    run as well.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches):
            data, at = text_buffer(batch.column(1))
            f = Features(data, at)
            scores = model.word_scores(f)
            found, sure, runs = [], [], []
            for row in range(batch.num_rows):
                a, b = f.first[row], f.first[row + 1]
                name, score, run = UNKNOWN, 0.0, []
                if model.languages and f.letters[a:b].any():
                    s, letters = scores[a:b], f.letters[a:b]
                    labels = model.labels(s)
                    share = np.bincount(labels, letters, len(model.languages))
                    top = int(share.argmax())
                    total = s[labels == top].sum(axis=0, dtype=float)
                    odds = np.exp(total - total.max())
                    name, score = model.languages[top], float(odds[top] / odds.sum() * (share[top] / share.sum() if share.sum() else 1))
                    if spans and b > a:
                        cuts = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(labels)]
                        ahead = f.back[row] + at[row]
                        run = [{"start": int(f.start[a + i] - ahead), "end": int(f.end[a + j - 1] - ahead), "lang": model.languages[labels[i]]} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                found.append(name)
                sure.append(score)
                runs.append(run)
            columns = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(sure, pa.float64())]
            labels = ["doc_id", *keep, *names]
            if spans:
                columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                labels.append("spans")
            yield pa.RecordBatch.from_arrays(columns, labels)

    chosen = docs.select(F.col("doc_id").cast("long"), "text", *kept)
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{names[0]}` string, `{names[1]}` double"])
    return chosen.mapInArrow(trimmed(labelled), schema + (", spans array<struct<start:long,end:long,lang:string>>" if spans else ""))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
