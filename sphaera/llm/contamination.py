"""Evaluation passages that leaked into documents, by spaced-seed hashing.

Texts become sequences of plain words: markup, zero-width characters and soft hyphens go, words broken at line
ends are joined, compatibility characters and accents are folded, case and punctuation drop out, and a blacked
out place is one word that equals none. Each mask of ``MASKS`` hashes the words at its chosen positions and
ignores the others. Bare numbers are no part of seeds, so numbering between the words breaks none; a run of five
equal words is met by the first mask, and thirty words with at most one in eight exchanged and two other
interruptions always hold such a run.

The hashes of the test passages form a sorted table. Documents are read once for each block of passages, whose
size is bounded by ``BLOCK_CHARS``, and join with the table in Arrow batches; neither documents nor their hashes
are shuffled. A passage that shares a seed is compared if the words of the document, in any order, could make up
enough of it. All diagonals on which it has three running words then count, not only those of seeds, and the
overlap is verified by dynamic programming over length, diagonal and passage position, which may change diagonals
where the page puts something between the words, up to ``PAGE`` words at no cost, or words are missing.

Defined results for odd input: null and blank texts and passages match nothing; an item with fewer than
``LEAST_WORDS`` words matches nothing; null ids are skipped; repeated rows count once; texts of any length are
read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 30
ONE_IN = 8
#: A run with what stands between its words lies within one of the windows of twice this many words, each half over the next.
SPAN = 512
#: What stands between the words of a run is no more than a page has words; pieces further apart are two quotations.
PAGE = 256
#: So many words between two pieces are free, as many more cost as much as one word that is there.
FREE = 32
#: How far from the beginning of three running words of its diagonal an equal word counts.
NEAR = 12
BLOCK_CHARS = 16_000_000
MASKS = ("11111", "1110111", "11011011")
_SEEN_BITS = 20
TOGETHER = 32

_TAGS = re.compile(r"<[^<>]{1,60}>")
_BROKEN = re.compile(r"(?<=\w)[-‐‑¬][ \t]*[\r\n]+\s*(?=\w)")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
_MARKS = re.compile("[̀-ͯ]")
_WORDS = re.compile(r"[^\W_]+|[_█]{2,}|\[\W{1,5}\]")


def plain_words(text: str | None) -> list[str]:
    """The words of a text as they compare."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "\n" in text or "\r" in text:
        text = _BROKEN.sub("", text)
    return _WORDS.findall(text.lower())


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes at all places of a sequence where the chosen words are known, and these places."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.full(n, len(mask), np.uint64)
    known = np.ones(n, bool)
    for o in _offsets(mask):
        word = ids[o : o + n]
        known &= word >= 0
        key = (key ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.nonzero(known)[0]
    return key[place], place


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``starts[i] .. starts[i] + sizes[i]``."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def may_run(there: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Which words can end a run of ``LEAST_WORDS`` of which at most one in ``ONE_IN`` is not ``there``.

    Runs begin and end with words that are there and don't cross the places ``apart``.
    """
    lag = LEAST_WORDS - 1
    out = np.zeros(len(there), bool)
    if len(there) <= lag:
        return out
    far = len(there) + 1
    small = far * (ONE_IN + (0 if apart is None else len(apart))) < 1 << 31
    total = np.zeros(far, np.int32 if small else np.int64)
    gain = np.where(there, total.dtype.type(1), total.dtype.type(1 - ONE_IN))
    if apart is not None:
        gain[apart] = -far
    np.cumsum(gain, out=total[1:])
    least = np.where(there[: far - 1 - lag], total[: far - 1 - lag], np.iinfo(total.dtype).max)
    np.minimum.accumulate(least, out=least)
    np.greater_equal(total[lag + 1 :], least, out=out[lag:])
    out &= there
    return out


class Words:
    """A sequence of word ids with and without its bare numbers, which page and numbering put anywhere."""

    def __init__(self, ids: np.ndarray, bare: np.ndarray):
        self.ids = ids
        self.kept = np.nonzero(~bare)[0]
        self.plain = ids[self.kept]
        self.ends = np.full(len(self.plain), len(ids))


def one_behind_the_other(docs: list[Words], apart: int) -> tuple[Words, np.ndarray]:
    """Several sequences as one, ``apart`` unknown words between them, and where each begins among the plain words."""
    out = Words(np.empty(0, np.int32), np.empty(0, bool))
    raw = np.cumsum([0, *(len(d.ids) + 1 for d in docs)])
    unknown = np.full(apart, -1, np.int32)
    out.ids = np.concatenate([part for d in docs for part in (d.ids, unknown[:1])])
    out.plain = np.concatenate([part for d in docs for part in (d.plain, unknown)])
    gap = np.zeros(apart, np.int64)
    out.kept = np.concatenate([part for d, r in zip(docs, raw) for part in (d.kept + r, gap + (r + len(d.ids)))])
    out.ends = np.concatenate([np.full(len(d.plain) + apart, r + len(d.ids)) for d, r in zip(docs, raw)])
    size = np.array([len(d.plain) + apart for d in docs])
    return out, np.cumsum(size) - size


class PassageIndex:
    """The seed hashes of a block of passages, and the search for them in a document.

    Everything is flat: memory grows with the words of the passages, however long the longest is.
    """

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, plain_words(p)) for i, p in items]
        texts = [(i, w) for i, w in texts if len(w) >= LEAST_WORDS]
        self.vocabulary: dict[str, int] = {}
        for _, words in texts:
            for w in words:
                if w[0].isalnum():
                    self.vocabulary.setdefault(w, len(self.vocabulary))
        self.items = np.array([i for i, _ in texts], np.int64)
        self.widest = max((len(w) for _, w in texts), default=0)
        self.lengths = np.array([len(w) for _, w in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.words = np.array([self.vocabulary.get(w, -2) for _, ws in texts for w in ws], np.int64)
        self.bare = np.array([w.isdigit() for _, ws in texts for w in ws], bool)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        kept = np.nonzero(~self.bare)[0]
        self.tables = []
        for mask in (*MASKS, "111"):
            key, place = _seed_hashes(self.words[kept], mask)
            place, last = kept[place], kept[place + len(mask) - 1]
            inside = self.owner[place] == self.owner[last]
            key, place = key[inside], place[inside]
            if mask == "111":
                break
            order = np.argsort(key, kind="stable")
            table, firsts = np.unique(key[order], return_index=True)
            seen = np.zeros(1 << _SEEN_BITS, bool)
            seen[(key >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True
            self.tables.append((table, np.append(firsts, len(key)), self.owner[place[order]], seen))
        self.triple = np.zeros(len(self.words), np.uint64)
        self.triple[place] = key
        # Of each word: the last one up to it that is no bare number (its place and its rank among such), in its passage.
        places = np.arange(len(self.words))
        last = np.maximum.accumulate(np.where(self.bare, -1, places)) if len(places) else places
        self.behind = np.where(last >= self.starts[self.owner], places - last, -1)
        first = np.concatenate([[0], np.cumsum(~self.bare)])
        self.rank = first[np.maximum(last, 0)] - first[self.starts[self.owner]]

    def _hits(self, plain: np.ndarray, doc_of: np.ndarray, docs: int) -> np.ndarray:
        """Which of the documents, one behind the other in ``plain``, share a seed with which passages."""
        found = np.zeros((docs, len(self.items)), bool)
        for mask, (table, firsts, owners, seen) in zip(MASKS, self.tables):
            keys, place = _seed_hashes(plain, mask)
            if not len(keys) or not len(table):
                continue
            maybe = seen[(keys >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)]
            keys, place = keys[maybe], place[maybe]
            at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            same = table[at] == keys
            at, place = at[same], place[same]
            n = firsts[at + 1] - firsts[at]
            found[np.repeat(doc_of[place], n), owners[_ranges(firsts[at], n)]] = True
        return found

    def _rich(self, who: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Those of the passages of which enough could be made up from the words that are held, in any order."""
        # A run with one in eight missing has LEAST_WORDS consecutive words of which at most six are.
        if 3 * int(self.lengths[who].sum()) > len(self.words):
            dense = np.flatnonzero(_sums(np.take(held, self.words), LEAST_WORDS) >= LEAST_WORDS - 6)
            some = np.zeros(len(self.items), bool)
            some[self.owner[dense]] = True
            who = who[some[who]]
        if not len(who):
            return who
        flat = _ranges(self.starts[who], self.lengths[who] + 1)
        ends = np.cumsum(self.lengths[who] + 1) - 1
        flat[ends] = 0
        there = held[self.words[flat]] > 0
        there[ends] = False
        return who[np.add.reduceat(may_run(there, ends), ends - self.lengths[who]) > 0]

    def leaked(self, text: str | None) -> list[int]:
        """The items of which the text carries enough."""
        return self.leaked_in([text])[0]

    def leaked_in(self, texts: list[str | None]) -> list[list[int]]:
        """The items of which each text carries enough; the seeds of all texts are looked up together."""
        out: list[list[int]] = [[] for _ in texts]
        least = LEAST_WORDS - LEAST_WORDS // ONE_IN
        words = [(i, w) for i, w in enumerate(map(plain_words, texts)) if len(w) >= least]
        if not words or not len(self.items):
            return out
        get = self.vocabulary.get
        docs = [Words(np.array([get(w, -1) for w in ws], np.int32), np.fromiter(map(str.isdigit, ws), bool, len(ws))) for _, ws in words]
        together, begin = one_behind_the_other(docs, self.widest + 1)
        found = self._hits(together.plain, np.repeat(np.arange(len(docs)), np.diff(np.append(begin, len(together.plain)))), len(docs))
        keys, place = _seed_hashes(together.plain, "111")
        cut = np.searchsorted(place, np.append(begin, len(together.plain)))
        short: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.nonzero(found.any(1))[0]:
            mine = slice(cut[k], cut[k + 1])
            passage, at = self._shared(docs[k], np.nonzero(found[k])[0], keys[mine], place[mine] - begin[k])
            last = len(docs[k].plain) - SPAN
            if last <= SPAN:
                short.append((passage, at + begin[k], np.full(len(at), k)))
                continue
            hits: set[int] = set()
            for start in range(0, last, SPAN):
                inside = (at >= start) & (at < start + 2 * SPAN)
                hits.update(item for _, item in self._carried(docs[k], passage[inside], at[inside], np.zeros(int(inside.sum()), np.int64)))
            out[words[k][0]] = sorted(hits)
        if short:
            for k, item in self._carried(together, *(np.concatenate(c) for c in zip(*short))):
                out[words[k][0]].append(item)
        return [sorted(set(o)) for o in out]

    def _shared(self, doc: Words, who: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where three running words of the passages ``who`` that may be carried (places among all passages) are in the document.

        ``keys`` hash the three running words of the document, which begin ``at``.
        """
        held = np.zeros(len(self.vocabulary) + 2, np.int8)
        held[doc.ids] = 1
        held[-2:] = 0
        who = self._rich(who, held)
        if not len(who) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        flat = _ranges(self.starts[who], self.lengths[who])
        flat = flat[self.triple[flat] != 0]
        lo = np.searchsorted(keys, self.triple[flat])
        same = keys[np.minimum(lo, len(keys) - 1)] == self.triple[flat]
        flat, lo = flat[same], lo[same]
        n = np.searchsorted(keys, self.triple[flat], side="right") - lo
        return np.repeat(flat, n), at[_ranges(lo, n)]

    def _carried(self, doc: Words, place: np.ndarray, q: np.ndarray, which: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) where enough lies on the diagonals of the places where three running words are equal.

        ``place`` is among the words of all passages, ``q`` among those of the document that are no bare numbers; ``which`` tells the
        documents that lie one behind the other in ``doc``. Diagonals are counted without bare numbers, so numbers between
        words shift nothing. The rows of ``equal`` are the diagonals, one behind the other and apart.
        """
        if not len(place):
            return []
        count = len(self.items)
        whose = self.owner[place]
        rows, row = np.unique(((which * count + whose) << 32) + (q - self.rank[place] + (1 << 31)), return_inverse=True)
        pair, diagonal = rows >> 32, (rows & ((1 << 32) - 1)) - (1 << 31)
        owner = pair % count
        size = self.lengths[owner]
        begin = np.cumsum(size + NEAR + 1) - size - NEAR - 1
        core = np.zeros(int(begin[-1] + size[-1]) + NEAR + 1, bool)
        core[begin[row] + place - self.starts[whose]] = True
        index = np.nonzero(around(core, NEAR))[0]
        line = np.searchsorted(begin, index, side="right") - 1
        word = index - begin[line]
        there = word < size[line]
        line, word = line[there], word[there]
        word += self.starts[owner[line]]
        at = self.rank[word] + diagonal[line]
        fits = (at >= 0) & (at < len(doc.plain)) & (self.behind[word] >= 0) & (self.words[word] >= 0)
        line, word, at = line[fits], word[fits], at[fits]
        raw = doc.kept[at] + self.behind[word]
        same = (raw < doc.ends[at]) & (doc.ids[np.minimum(raw, len(doc.ids) - 1)] == self.words[word])
        line, word = line[same], word[same]
        place = word - self.starts[owner[line]]

        def run(groups: np.ndarray, of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            """Those of the sorted ``groups`` in which the words that are there, of group ``of`` each, may make a run."""
            if not len(groups):
                return groups
            first = np.cumsum(lengths + 1) - lengths - 1
            slot = np.minimum(np.searchsorted(groups, of), len(groups) - 1)
            mine = groups[slot] == of
            have = np.zeros(int(first[-1] + lengths[-1]) + 1, bool)
            have[first[slot[mine]] + place[mine]] = True
            return groups[np.add.reduceat(may_run(have, first[1:] - 1), first) > 0]

        least = LEAST_WORDS - LEAST_WORDS // ONE_IN
        full = np.nonzero(np.bincount(line, minlength=len(rows)) >= least)[0]
        found = set(pair[run(full, line, size[full])].tolist())
        several = np.unique(pair[np.nonzero(np.diff(pair) == 0)[0]])
        some = np.setdiff1d(several, list(found))
        for p in run(some, pair[line], self.lengths[some % count]).tolist():
            lines = np.nonzero(pair == p)[0]
            mine = (line >= lines[0]) & (line <= lines[-1])
            equal = np.zeros((len(lines), size[lines[0]]), bool)
            equal[line[mine] - lines[0], place[mine]] = True
            if chained(equal, diagonal[lines]):
                found.add(p)
        return [(p // count, int(self.items[p % count])) for p in found]


def _sums(values: np.ndarray, width: int) -> np.ndarray:
    """Sums of all windows of ``width`` small values, from windows of doubled width."""
    n = len(values) - width + 1
    total, at, one, size = np.zeros(max(0, n), values.dtype), 0, values, 1
    while size <= width and n > 0:
        if width & size:
            total += one[at : at + n]
            at += size
        one, size = one[: len(one) - size] + one[size:], size * 2
    return total


def around(marked: np.ndarray, far: int) -> np.ndarray:
    """Which places have a marked one at most ``far`` places away, from windows of doubled width."""
    wide = np.pad(marked, far)
    width, size = 2 * far + 1, 1
    while size * 2 <= width:
        wide, size = wide[:-size] | wide[size:], size * 2
    return wide[: len(marked)] | wide[width - size : width - size + len(marked)]


def chained(equal: np.ndarray, diagonal: np.ndarray) -> bool:
    """Whether a run of ``LEAST_WORDS`` passage words has at most one in ``ONE_IN`` that differs.

    ``equal`` tells for each diagonal which passage words it has. A run may move to a later diagonal, where something stands
    between the words, at most ``PAGE`` words in all at a cost beyond ``FREE`` words each, or to an earlier one over as many passage words that are missing. A
    word that is there scores 1, another costs ``ONE_IN`` - 1; a run is carried if it is long enough, its score is
    not negative, and its first and last words are there, so a shorter quotation does not grow by words around it.

    Each window of diagonals as wide as a page is searched; the state is the best score of each length, up to
    ``LEAST_WORDS``, on each of its diagonals.
    """
    ends = np.searchsorted(diagonal, diagonal + PAGE, side="right")
    windows = [(k, e) for k, e in enumerate(ends) if k == 0 or e > ends[k - 1]]
    return any(may_run(equal[k:e].any(0)).any() and _chain(equal[k:e], diagonal[k:e]) for k, e in windows)


def _chain(equal: np.ndarray, diagonal: np.ndarray) -> bool:
    """Whether a window of diagonals holds a run."""
    gain = np.where(equal, FREE, FREE * (1 - ONE_IN)).astype(np.int32)
    none = -(1 << 28)
    step = diagonal[None, :] - diagonal[:, None]
    cost = np.where(step < 0, -none, np.maximum(step - FREE, 0)).astype(np.int32)
    back = []
    for x in range(1, ONE_IN):
        to = np.searchsorted(diagonal, diagonal - x)
        hit = diagonal[np.minimum(to, len(diagonal) - 1)] == diagonal - x
        if hit.any():
            back.append((x, np.nonzero(hit)[0], to[hit]))
    states: list[np.ndarray] = []
    best = np.full((LEAST_WORDS, len(diagonal)), none, np.int32)
    for p in range(equal.shape[1]):
        moved = np.maximum((best[:, :, None] - cost[None]).max(1), none)
        for x, source, to in back:
            if len(states) > x:
                old = states[-1 - x][:, source] - x * (ONE_IN - 1) * FREE
                late = np.full_like(old, none)
                late[x:] = old[: LEAST_WORDS - x]
                late[-1] = np.maximum(late[-1], old[LEAST_WORDS - 1 - x :].max(0))
                moved[:, to] = np.maximum(moved[:, to], late)
        after = np.empty_like(best)
        after[1:] = moved[:-1] + gain[:, p]
        after[-1] = np.maximum(after[-1], moved[-1] + gain[:, p])
        after[0] = np.where(equal[:, p], FREE, none)
        best = np.maximum(after, none)
        if (best[-1, equal[:, p]] >= 0).any():
            return True
        states.append(best)
        if len(states) > ONE_IN + 1:
            states.pop(0)
    return False


def leaked_items(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): every document with every item of whose passage it carries enough."""
    spark = documents.sparkSession
    known = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage")).distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("passage").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for b in range(blocks):
        rows = [(r.item_id, r.passage) for r in known.where(F.pmod(F.xxhash64("item_id", F.lit(5)), F.lit(blocks)) == b).orderBy("item_id", "passage").collect()]
        shared = spark.sparkContext.broadcast(PassageIndex(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                docs, hits = [], []
                ids = batch.column(0).to_pylist()
                for lo in range(0, len(ids), TOGETHER):
                    for doc, found in zip(ids[lo : lo + TOGETHER], index.leaked_in(batch.column(1).slice(lo, TOGETHER).to_pylist())):
                        docs += [doc] * len(found)
                        hits += found
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        part = texts.mapInArrow(run, "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()
