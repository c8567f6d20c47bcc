"""Operator 6: repeated passages by recompression.

A text is a sequence of word symbols.  In each round, runs of one symbol and
then pairs of neighbours whose first is of the left and whose second is of the
right half of the alphabet (by a seeded hash) become new symbols.  Names are
hashes (122 bits are compared) of what they stand for, so they are the same
everywhere without a dictionary, and equal passages get equal symbols inside.
Rounds go on until symbols stand for whole passages.

Two rounds of Spark compare names over all texts.  The first counts symbols.

* Low symbols, of ``MIN_SPAN`` to ``CAP`` words, prune.  Each carries the words
  its existence depends on: neighbours that kept it from merging otherwise.  If
  these lie inside a window, the symbol is in every copy of that window, so a
  window that must contain a symbol which occurs only once is no repeat.
* High symbols, of ``WINDOW`` words or more, reveal and verify.  One that occurs
  twice stands for equal words, so every window inside it is a repeat.  Its
  first occurrence also speaks for the others: only there, windows inside it
  take part in the second round.

The second round verifies the windows left, those across the borders of shared
symbols and the ones that first occurrences speak for, by their hashes (122
bits).  A window that isn't sent lies in a later occurrence of a symbol, whose
first occurrence has the same window earlier; as this goes back in one order of
all texts, it ends at a window that is sent.

Both rounds combine on the map side: of a symbol or window that one task meets
often, one entry is shuffled.  Entries travel as compact blobs in buckets, whose
number follows from the measured bytes of text; what comes back to a text are
two bits for each symbol and a few ranges.

Defined results: null texts have no words; the hash of no words is that of the
empty string; rows with a null doc_id count as occurrences but lose no words
themselves; rows with one doc_id are one row repeated; equal rows repeat each
other; a text is read whole, whatever its length; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB, Words, blob_batch, bucket_count, by_bucket, join_by_size, mix, pieces, scatter, stored, task_count, text_buffer, text_bytes, trimmed, window_hashes

WINDOW = 35
#: Rounds up to ``CAP`` words, rounds that also join runs, and all rounds.
LOW_ROUNDS, RUN_ROUNDS, ROUNDS = 7, (0, 3), 24
CAP, MIN_SPAN = 12, 4
FLUSH = 1 << 19
_ENTRY = np.dtype([("key", "<u8"), ("check", "<u8"), ("at", "<u4")])
#: The bit of an entry's ``at`` that says that its task has met the key again.
_AGAIN = np.uint32(1 << 31)
#: The bit of a place that says that an earlier one has the same key.
_LATER = np.uint32(1 << 30)
_INFO = np.dtype([("uid", "<i8"), ("doc_id", "<i8")])
_KNOWN = np.dtype([("uid", "<i8"), ("at", "<u4")])
_FAR = 1 << 40


class Symbols:
    """Symbols of some texts: two names, first word, span, and needed words [lo, hi)."""

    _COLUMNS = ("name", "twin", "at", "span", "lo", "hi", "text")

    def __init__(self, words: Words):
        n = words.counts()
        self.name, self.twin = mix(words.hashes(), 21), mix(words.hashes(1), 21)
        self.at = np.arange(len(self.name))
        self.span = np.ones(len(self.name), np.int64)
        self.lo, self.hi = self.at.copy(), self.at + 1
        self.text = np.repeat(np.arange(len(n)), n)

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a next symbol is there; what depends on the neighbours; a missing one is out of reach."""
        follows = np.r_[self.text[1:] == self.text[:-1], False] if len(self.text) else np.zeros(0, bool)
        hi_next = np.where(follows, np.r_[self.hi[1:], _FAR], _FAR)
        lo_prev = np.where(np.r_[False, follows[:-1]], np.r_[-_FAR, self.lo[:-1]], -_FAR)
        return follows, hi_next, lo_prev

    def _take(self, chosen: np.ndarray) -> None:
        for c in self._COLUMNS:
            setattr(self, c, getattr(self, c)[chosen])

    def _some(self, chosen: np.ndarray) -> Symbols:
        out = object.__new__(Symbols)
        for c in self._COLUMNS:
            setattr(out, c, getattr(self, c)[chosen])
        return out

    def runs(self) -> None:
        if not len(self.name):
            return
        follows, hi_next, lo_prev = self._beside()
        same = follows & np.r_[(self.name[1:] == self.name[:-1]) & (self.twin[1:] == self.twin[:-1]), False]
        head = ~np.r_[False, same[:-1]]
        start = np.flatnonzero(head)
        count = np.diff(np.r_[start, len(head)])
        last = start + count - 1
        lo, hi = lo_prev[start], hi_next[last]  # a run ends where another symbol is
        fits = count * self.span[start] <= CAP
        member = np.repeat(np.arange(len(start)), count)
        self.lo, self.hi = np.minimum(self.lo, lo[member]), np.maximum(self.hi, hi[member])
        joined = fits & (count > 1)
        for c, seed in (("name", 22), ("twin", 24)):
            name = getattr(self, c)
            name[start] = np.where(joined, mix(name[start] * np.uint64(0xA24BAED4963EE407) + count.astype(np.uint64), seed), name[start])
        self.span[start] = np.where(joined, count * self.span[start], self.span[start])
        self._take(head | ~joined[member])

    def pairs(self, seed: int, cap: int) -> np.ndarray:
        """Joins pairs of ``cap`` words at most; which of the symbols left are new."""
        if not len(self.name):
            return np.zeros(0, bool)
        follows, hi_next, lo_prev = self._beside()
        left = (mix(self.name, 31 + seed) >> np.uint64(63)).astype(bool)
        ahead = np.r_[self.span[1:], cap + 1]
        joined = follows & left & ~np.r_[left[1:], True] & (self.span + ahead <= cap)
        first, second = self.lo.copy(), self.hi.copy()
        lo_next = np.r_[self.lo[1:], 0]
        self.hi = np.where(joined | left, np.maximum(second, np.where(follows, hi_next, _FAR)), second)
        self.lo = np.where(joined, np.minimum(first, lo_next), np.where(left, first, np.minimum(first, lo_prev)))
        for c, k in (("name", 23), ("twin", 25)):
            name = getattr(self, c)
            setattr(self, c, np.where(joined, mix(name * np.uint64(0x9FB21C651E98DF25) + np.r_[name[1:], np.uint64(0)], k), name))
        self.span = np.where(joined, self.span + ahead, self.span)
        left_over = ~np.r_[False, joined[:-1]]
        self._take(left_over)
        return joined[left_over]

    def compress(self) -> Symbols:
        """The low symbols and the high ones of all rounds, in the order of texts, places and spans."""
        found = []
        for r in range(ROUNDS):
            if r in RUN_ROUNDS:
                self.runs()
            if r < LOW_ROUNDS:
                self.pairs(r, CAP)
                continue
            if r == LOW_ROUNDS:
                found.append(self._some(self.span >= MIN_SPAN))
            new = self.pairs(r, _FAR)
            found.append(self._some(new & (self.span >= WINDOW)))
        for c in self._COLUMNS:
            setattr(self, c, np.concatenate([getattr(x, c) for x in found]))
        self._take(np.lexsort((self.span, self.at)))  # words of texts lie one after another
        return self


def open_windows(words: Words, s: Symbols, shared: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows for the second round, and of windows that symbols have verified.

    Left out are windows that contain a low symbol outside ``shared`` for sure,
    and windows inside a high symbol of ``later``.  The verified ones are as
    many as cover every shared high symbol.
    """
    n = int(words.first[-1])
    counts = words.counts()
    fits = np.zeros(n + 1, bool)
    whole = np.repeat(words.first[1:], counts)
    fits[:n] = np.arange(n) + WINDOW <= whole
    high = s.span >= WINDOW
    alone = ~shared & ~high
    a, b = np.maximum(s.hi[alone] - WINDOW, words.first[s.text[alone]]), s.lo[alone]
    ok = a <= b
    a, b = np.r_[a[ok], s.at[later & high]], np.r_[b[ok], (s.at + s.span - WINDOW)[later & high]]
    out = np.zeros(n + 2, np.int64)
    np.add.at(out, a, 1)
    np.add.at(out, b + 1, -1)
    begin, span = s.at[shared & high], s.span[shared & high]
    steps = -(-span // WINDOW)
    step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
    known = np.repeat(begin, steps) + np.minimum(step * WINDOW, np.repeat(span - WINDOW, steps))
    return np.flatnonzero(fits[:n] & (np.cumsum(out)[:n] == 0)), np.unique(known)


class Emitter:
    """Entries (key, check, place) of rows, counted in the task and put in blobs.

    ``rows`` gives (bucket, blob): entries in buckets below ``n``; in [n, 2n) the
    ids of rows; in [2n, 3n) places that the task itself knows to be repeated.
    Of equal keys the first place is sent, for all.
    """

    def __init__(self, n_buckets: int):
        self.n, self.uid = n_buckets, TaskContext.get().partitionId() << 33
        self.base, self.held, self.known, self.ids, self.count = self.uid, [], [], [], 0

    def add(self, doc_ids: list, text: np.ndarray, keys: np.ndarray, check: np.ndarray, at: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """``known``: texts and places that are repeated for sure."""
        if len(self.ids) + len(doc_ids) > 60_000 or self.count + len(keys) > FLUSH:
            yield from self.flush()
        self.held.append((text + len(self.ids), keys, check, at))
        if known is not None:
            self.known.append((known[0] + len(self.ids), known[1]))
        self.ids += [(self.uid + i, d if d is not None else -(1 << 63)) for i, d in enumerate(doc_ids)]
        self.uid += len(doc_ids)
        self.count += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            row, keys, check, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.lexsort((check, keys))
            row, keys, check, at = row[order], keys[order], check[order], at[order]
            same = (keys[1:] == keys[:-1]) & (check[1:] == check[:-1])
            head = np.r_[True, ~same] if len(keys) else np.zeros(0, bool)
            again = np.zeros(len(keys), bool)
            again[1:] |= same
            again[:-1] |= same
            rows = []
            sent = np.zeros(int(head.sum()), _ENTRY)
            sent["key"] = ((keys[head] // np.uint64(self.n)) << np.uint64(16)) | row[head].astype(np.uint64)
            sent["check"], sent["at"] = check[head], at[head].astype(np.uint32) | np.where(again[head], _AGAIN, np.uint32(0))
            base = np.int64(self.base).tobytes()
            rows += [(b, base + blob) for b, blob in scatter(keys[head], sent, self.n)]
            later = np.where(head, np.uint32(0), _LATER)[again]
            more = [np.concatenate(x) for x in zip(*self.known, strict=True)] or [np.zeros(0, np.int64)] * 2
            known = np.zeros(int(again.sum()) + len(more[0]), _KNOWN)
            known["uid"], known["at"] = self.base + np.r_[row[again], more[0]], np.r_[at[again].astype(np.uint32) | later, more[1].astype(np.uint32)]
            ids = np.array(self.ids, _INFO)
            for kind, table in ((1, ids), (2, known)):
                rows += [(kind * self.n + (self.base // 997 + i) % self.n, table[i * 512 : (i + 1) * 512].tobytes()) for i in range(-(-len(table) // 512))]
            yield blob_batch(rows)
        self.base, self.held, self.known, self.ids, self.count = self.uid, [], [], [], 0


def _found(n_buckets: int):
    """Places of keys that occur again, as (uid, blob), and ids as (uid, doc_id)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(uid, doc_id, blobs) -> pa.RecordBatch:
            size = len(uid)
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.nulls(size, pa.int64()) if doc_id is None else pa.array(doc_id), pa.nulls(size, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())], ["uid", "doc_id", "places"])

        def by_uid(uid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(uid, kind="stable")
            uid, at = uid[order], at[order].astype("<u4")
            start = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]]) if len(uid) else np.zeros(0, np.int64)
            return rows(uid[start], None, [x.tobytes() for x in np.split(at, start[1:])] if len(uid) else [])

        for bucket, blobs in by_bucket(batches):
            if bucket >= 2 * n_buckets:
                known = np.concatenate([np.frombuffer(x, _KNOWN) for x in blobs])
                yield by_uid(known["uid"], known["at"])
            elif bucket >= n_buckets:
                info = np.concatenate([np.frombuffer(x, _INFO) for x in blobs])
                yield rows(info["uid"], info["doc_id"], None)
            else:
                entries = [np.frombuffer(x, _ENTRY, offset=8) for x in blobs]
                uid = np.concatenate([np.frombuffer(x, "<i8", 1)[0] + (e["key"] & np.uint64(0xFFFF)).astype(np.int64) for x, e in zip(blobs, entries, strict=True)])
                e = np.concatenate(entries)
                key = e["key"] >> np.uint64(16)
                order = np.lexsort((uid, e["check"], key))
                key, check, at, uid = key[order], e["check"][order], e["at"][order], uid[order]
                same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
                again = np.zeros(len(key), bool)
                again[1:] |= same
                again[:-1] |= same
                later = np.r_[False, same] if len(key) else again
                told = (at & _AGAIN) > 0  # their task knows that they are repeated, not that they are later
                again &= ~told | later
                yield by_uid(uid[again], (at[again] & ~_AGAIN) | np.where(later, _LATER, np.uint32(0))[again])

    return found


def _counted_again(dealt: DataFrame, n_bytes: int, name: str) -> DataFrame:
    """doc_id and the list of blobs of places that occur again."""
    dealt = dealt.repartition(task_count(dealt.sparkSession, n_bytes), "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(trimmed(_found(bucket_count(n_bytes))), "uid long, doc_id long, places binary"), name)
    ids = found.where("places is null").select(F.col("uid").alias("u"), F.col("doc_id").alias("id"))  # ascending ids are the order of all texts
    places = found.where("places is not null").select("uid", "places").groupBy("uid").agg(F.collect_list("places").alias("places"))
    known = ids.join(places, F.col("u") == F.col("uid"), "left").where(F.col("id") > -(1 << 63))
    return known.groupBy(F.col("id").alias("doc_id")).agg(F.min_by("places", "u").alias("places"))


def _places(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and whether they are later ones."""
    raw = np.frombuffer(b"".join(blobs or ()), "<u4")
    return (raw & ~_LATER).astype(np.int64), (raw & _LATER) > 0


def _symbol_entries(n_buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(n_buckets)
        for batch in pieces(batches):
            s = Symbols(Words(*text_buffer(batch.column(1)))).compress()
            ordinal = np.arange(len(s.text)) - np.searchsorted(s.text, s.text)
            yield from out.add(batch.column(0).to_pylist(), s.text, s.name, s.twin, ordinal)
        yield from out.flush()

    return emit


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bits a symbol: it occurs again, and an earlier one is the first."""
    for batch in batches:
        out = []
        for blobs in batch.column(1).to_pylist():
            at, later = _places(blobs)
            flags = np.zeros((int(at.max()) + 1 if len(at) else 0, 2), np.uint8)
            flags[at, 0] = 1
            flags[at[later], 1] = 1
            out.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bits"])


def _window_entries(n_buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(n_buckets)
        for batch in pieces(batches):
            words = Words(*text_buffer(batch.column(1)))
            s = Symbols(words).compress()
            flags = np.zeros((len(s.text), 2), bool)
            first = np.searchsorted(s.text, np.arange(batch.num_rows + 1))
            for row, bits in enumerate(batch.column(2).to_pylist()):
                if bits is None:  # without an id there is nothing known: all its windows go
                    flags[first[row] : first[row + 1], 0] = True
                elif bits:
                    own = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, 2)[: first[row + 1] - first[row]]
                    flags[first[row] : first[row] + len(own)] = own
            at, known = open_windows(words, s, flags[:, 0], flags[:, 1])
            keys, check = (window_hashes(words.hashes(seed), WINDOW, 40 + seed)[at] for seed in (0, 1))
            text, sure = (np.searchsorted(words.first, x, "right") - 1 for x in (at, known))
            yield from out.add(batch.column(0).to_pylist(), text, keys, check, at - words.first[text], (sure, known - words.first[sure]))
        yield from out.flush()

    return emit


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges that repeated windows cover, as pairs of numbers."""
    for batch in batches:
        out = []
        for blobs in batch.column(1).to_pylist():
            at = np.unique(_places(blobs)[0])
            cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
            first, last = at[np.r_[0, cut]] if len(at) else at, at[np.r_[cut - 1, len(at) - 1]] if len(at) else at
            out.append(np.stack([first, last + WINDOW], 1).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ranges"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, at = text_buffer(batch.column(1))
        words = Words(data, at)
        # every word and one blank after it, in one buffer; a text's hash is that of its part without the last blank
        gone = np.zeros(len(words.start) + 1, np.int64)
        for row, blob in enumerate(batch.column(2).to_pylist()):
            if blob:
                r = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64) + words.first[row]
                np.add.at(gone, r[:, 0], 1)
                np.add.at(gone, r[:, 1], -1)
        kept = np.cumsum(gone[:-1]) == 0
        cover = np.zeros(len(data) + 1, np.int8)
        cover[words.start[kept]] += 1
        cover[words.end[kept]] -= 1
        size = np.where(kept, words.end - words.start + 1, 0)
        upto = np.r_[0, np.cumsum(size)]
        line = np.full(int(upto[-1]), 0x20, np.uint8)
        byte = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        owner = np.searchsorted(words.start, byte, "right") - 1
        line[upto[owner] + byte - words.start[owner]] = data[byte]
        bounds = upto[words.first]
        n = words.counts()
        n_kept = np.r_[0, np.cumsum(kept)][words.first]
        digest = [hashlib.sha256(line[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - np.diff(n_kept)), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and the ranges of words inside windows that occur elsewhere too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = text_bytes(docs)
    n_buckets = bucket_count(n_bytes)
    bits = _counted_again(docs.mapInArrow(trimmed(_symbol_entries(n_buckets)), BLOB), n_bytes, "symbols")
    bits = stored(bits.mapInArrow(trimmed(_bits), "doc_id long, bits binary"), "bits")
    size = bits.agg(F.sum(F.length("bits") + 24)).first()[0] or 0
    marked = join_by_size(docs, bits, "doc_id", "left", size)
    again = _counted_again(marked.select("doc_id", "text", "bits").mapInArrow(trimmed(_window_entries(n_buckets)), BLOB), n_bytes, "windows")
    return stored(again.where("places is not null").mapInArrow(trimmed(_ranges), "doc_id long, ranges binary"), "ranges")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """n_words, n_removed and the hash of the kept words of every text."""
    ranges = repeated_ranges(docs)
    size = ranges.agg(F.sum(F.length("ranges") + 24)).first()[0] or 0
    joined = join_by_size(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ranges, "doc_id", "left", size)
    return joined.select("doc_id", "text", "ranges").mapInArrow(trimmed(_kept), "doc_id long, n_words long, n_removed long, kept_sha256 string")
