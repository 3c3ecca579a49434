"""Per-document text statistics and the documents that are lists, tables or junk.

Every line is classed as prose, table, list or junk from counts of its words, common words, symbols, cells and
gaps; a document's statistics are sums over its lines. A text longer than ``CHUNK`` characters is cut, at a line
end where there is one, else between words, else anywhere; its chunks are spread over tasks. A chunk gives the
sums of its closed lines and the open first and last line as states; joining two chunks adds the sums and closes
the line between them, and takes back the word that a cut in mid-word counted twice. Joining is associative, so
chunks merge in a tree; ratios and outcomes come last. Texts within one chunk need no join.

Definitions: a word is a run of letters and digits; a symbol is neither letter, digit nor white space; lines end
at LF, CR or CRLF and count if not blank; end punctuation is one of ``END``; common words are ``COMMON``, in any case but for a capital ``A``, which mostly
names things. How many different words a text has is exact up to ``KEPT_HASHES`` and estimated from the smallest
hashes beyond; the estimate joins associatively too.

The text is read once: the scan writes finished rows of short texts, partial sums of the chunks of longer ones and, of
texts beyond ``SPREAD``, the chunks themselves, which other tasks count.

Defined results for odd input: null and blank texts have counts of 0, null ratios and no kind; rows without an id
are skipped; repeated rows give one row; texts of any length count whole; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera import session

CHUNK, SPREAD = 1 << 13, 1 << 22
FANOUT = 32
END = ".!?;:…\"”'’»)"
# Frequent function words of English, German and French.
COMMON = frozenset(
    """the of and was in that to is for be not which by with on as it had at or from were an a has have his her we are this
    der die und von den das dem des im zu mit wurde sind nicht auf ist für hat werden dass ein eine wurden ob weil
    le la les de du et en un une que qui dans par pour sur est sont au aux ont ne pas ce cette il elle""".split()
)
KEPT_HASHES = 256

_WORDS = re.compile(r"[^\W_]+")
_CELLS = re.compile(r"\||\t|(?<=\S) {3,}|;(?=\S)")
_RULE = re.compile(r"[\s+|=:-]*$")
_NOISE = re.compile("[¬¦§{}~^¢°�□<>\\\\@#*!ÃÂ]")
_HEX = re.compile(r"\s*[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s*){4,}")
_VOWELS = re.compile("[aeiouyäöüéèêàâîïôûùëœæøåáíóú]", re.IGNORECASE)
_LONE_Q = re.compile("q(?!u)", re.IGNORECASE)
_BREAKS = re.compile(r"\r\n|\r|\n")

# A line's state: characters without white space, letters and digits, letters and digits in words too long or too
# hard to be words, words, common words, set of common words as bits, cells, redactions, digits in it, last character,
# whether it holds nothing but rules of a table, whether it is a dump, characters that neither prose nor cells use.
CHARS, ALNUM, ODD, WORDS, COMMONS, WHICH, CELLS, BARS, DIGITS, LAST, RULE, DUMP, NOISE = range(13)
# A document's sums: words, letters and digits in words, common words, symbols, characters, lines, lines with an end,
# characters of prose, table, list and junk lines, and of lines that may be short parts of wrapped sentences.
N_WORDS, N_LETTERS, N_COMMON, N_SYMBOLS, N_CHARS, N_LINES, N_ENDS, PROSE, TABLE, LIST, JUNK, PART = range(12)
SUMS = 12
_BIT = {w: 1 << (i % 62) for i, w in enumerate(sorted(COMMON))}


def _strange(word: str) -> bool:
    """Whether a run of letters and digits can hardly be a word or number."""
    n = len(word)
    if n >= 20:
        return True
    if n <= 4:
        return False
    vowels = len(_VOWELS.findall(word))
    digits = sum(c.isdigit() for c in word)
    if digits == n:
        return n > 12
    return vowels * 6 < n - digits or (0 < digits and n >= 8) or bool(_LONE_Q.search(word))


def line_state(line: str, broken: bool = False) -> list[int]:
    """The state of a line or a part of it; ``broken`` if it starts in mid-word, in a word of thousands of letters."""
    words = _WORDS.findall(line)
    common, which = 0, 0
    bit = _BIT.get
    for w in words[broken:]:
        b = bit(w) or (len(w) > 1 and bit(w.lower()))
        if b:
            common += 1
            which |= b
    solid = sum(map(len, line.split()))
    alnum = sum(map(len, words))
    stripped = line.strip()
    cells = len(_CELLS.findall(line))
    odd = sum(len(w) for w in words[broken:] if len(w) > 4 and w.lower() not in _FINE and _note(w))
    odd += len(words[0]) if broken and words else 0
    return [
        solid, alnum, odd, len(words), common, which, cells, line.count("█") + line.count("_"),
        sum(c.isdigit() for c in line), ord(stripped[-1]) if stripped else 0, int(bool(_RULE.match(line))), int(bool(_HEX.match(line))), len(_NOISE.findall(line)),
    ]


_FINE: set[str] = set()


def _note(word: str) -> bool:
    """Strangeness of a word, ordinary ones remembered."""
    if _strange(word):
        return True
    if len(_FINE) < 200_000:
        _FINE.add(word.lower())
    return False


def join_lines(a: list[int], b: list[int], mid_word: bool) -> list[int]:
    """The state of a line from those of its two parts."""
    out = [x + y for x, y in zip(a, b)]
    out[WORDS] -= mid_word
    out[WHICH] = a[WHICH] | b[WHICH]
    out[LAST] = b[LAST] or a[LAST]
    out[RULE], out[DUMP] = a[RULE] & b[RULE], a[DUMP] if a[CHARS] else b[DUMP]
    return out


def line_kind(s: list[int]) -> int | None:
    """PROSE, TABLE, LIST, JUNK or PART; None for a blank line."""
    if not s[CHARS]:
        return None
    symbols = s[CHARS] - s[ALNUM] - s[BARS]
    distinct = bin(s[WHICH]).count("1")
    if s[RULE]:
        return TABLE
    if s[DUMP] or s[NOISE] * 12 > s[CHARS]:
        return JUNK
    if s[ALNUM] and s[ODD] * 2 > s[ALNUM]:
        return JUNK
    prose = s[WORDS] >= 6 and distinct >= 2 and s[COMMONS] * 100 >= 14 * s[WORDS] and symbols * 100 <= 14 * s[CHARS] and s[CELLS] * 4 <= s[WORDS]
    if prose:
        return PROSE
    if s[WORDS] >= 8 and s[ODD] * 8 > s[ALNUM] and s[COMMONS] * 10 < s[WORDS]:
        return JUNK
    if s[CELLS] >= 2 or s[CELLS] == 1 and s[WORDS] <= 12:
        return TABLE if symbols * 2 <= s[CHARS] or s[CELLS] >= 3 else JUNK
    if symbols * 10 > s[CHARS] * 3:
        return JUNK if symbols * 2 > s[CHARS] or s[WORDS] > 3 else LIST
    if s[WORDS] > 6 and symbols * 100 > 14 * s[CHARS] and s[DIGITS] * 4 < s[CHARS]:
        return JUNK
    return PART if s[WORDS] >= 4 and s[COMMONS] and symbols * 100 <= 14 * s[CHARS] else LIST


class Partial:
    """What a chunk tells: sums of closed lines, the open lines at its ends, and its smallest word hashes."""

    __slots__ = ("sums", "head", "tail", "hashes", "broken")

    def __init__(self, sums: list[int], head: list[int], tail: list[int] | None, hashes: list[int], broken: bool):
        self.sums, self.head, self.tail, self.hashes, self.broken = sums, head, tail, hashes, broken

    @staticmethod
    def of(text: str, starts_in_word: bool = False) -> Partial:
        lines = _BREAKS.split(text)
        states = [line_state(lines[0], starts_in_word), *map(line_state, lines[1:])]
        sums = [0] * SUMS
        for s in states[1:-1]:
            close(sums, s)
        sums[N_CHARS] = len(text)
        words = {w.lower() for w in _WORDS.findall(text)[starts_in_word:]}
        hashes = sorted({zlib.crc32(w.encode()) for w in words})[:KEPT_HASHES]
        return Partial(sums, states[0], states[-1] if len(states) > 1 else None, hashes, starts_in_word)

    def join(self, other: Partial) -> Partial:
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        middle = join_lines(self.tail or self.head, other.head, other.broken)
        head, tail = self.head, other.tail
        if self.tail is None:
            head = middle
        elif other.tail is None:
            tail = middle
        else:
            close(sums, middle)
        return Partial(sums, head, tail, sorted({*self.hashes, *other.hashes})[:KEPT_HASHES], self.broken)

    def finish(self) -> tuple[list[int], int]:
        sums = list(self.sums)
        close(sums, self.head)
        if self.tail is not None:
            close(sums, self.tail)
        if len(self.hashes) < KEPT_HASHES:
            return sums, len(self.hashes)
        return sums, max(KEPT_HASHES, round((KEPT_HASHES - 1) * (1 << 32) / max(1, self.hashes[-1])))


def close(sums: list[int], s: list[int]) -> None:
    """Add a whole line to the sums."""
    kind = line_kind(s)
    if kind is None:
        return
    sums[N_WORDS] += s[WORDS]
    sums[N_LETTERS] += s[ALNUM]
    sums[N_COMMON] += s[COMMONS]
    sums[N_SYMBOLS] += s[CHARS] - s[ALNUM]
    sums[N_LINES] += 1
    sums[N_ENDS] += chr(s[LAST]) in END
    sums[kind] += s[CHARS]


def outcome(sums: list[int], distinct: int) -> str | None:
    """``list``, ``table`` or ``junk`` if most of the text is not sentences.

    Lines that may be parts of wrapped sentences are that where there is at least as much prose beside them, else
    they are entries of a list.
    """
    prose, entries = (sums[PROSE] + sums[PART], sums[LIST]) if sums[PROSE] >= sums[PART] else (sums[PROSE], sums[LIST] + sums[PART])
    solid = prose + entries + sums[TABLE] + sums[JUNK]
    if not solid:
        return None
    if sums[N_WORDS] >= 20 and sums[N_WORDS] >= 8 * distinct:
        return "junk"
    if prose * 2 >= solid:
        return None
    rest = {"list": entries, "table": sums[TABLE], "junk": sums[JUNK]}
    return max(rest, key=lambda k: (rest[k], k))


_PARTIAL = "doc_id long, text_hash long, no int, sums array<long>, head array<long>, tail array<long>, hashes array<long>, broken boolean"
_DONE = "doc_id long, sums array<long>, kind string"
_LOOK_BACK = 4096
_SPACE = re.compile(r"\s(?=\S)")
_EDGE = re.compile(r"[\W_](?=\w)")


def cut_points(text: str, chunk: int) -> list[tuple[int, bool]]:
    """Where the chunks of a text begin, and whether in mid-word: behind a line end, else a space, else before a word, else anywhere."""
    out, at = [(0, False)], 0
    while len(text) - at > chunk:
        end = at + chunk
        nl = text.rfind("\n", at, end)
        if nl <= at:
            for edge in (_SPACE, _EDGE):
                found = [m.end() for m in edge.finditer(text, max(at, end - _LOOK_BACK), end)]
                if found:
                    break
            nl = (found[-1] if found else end) - 1
            if text[nl] == "\r" and text[nl + 1 : nl + 2] == "\n":
                nl += 1
        at = nl + 1
        word = text[at - 1].isalnum() and text[at : at + 1].isalnum()
        out.append((at, word))
    return out


_SCANNED = "doc_id long, text_hash long, no int, sums array<long>, head array<long>, tail array<long>, hashes array<long>, broken boolean, chunk string, kind string"
_LONGS = pa.list_(pa.int64())
_TYPES = {"doc_id": pa.int64(), "text_hash": pa.int64(), "no": pa.int32(), "sums": _LONGS, "head": _LONGS, "tail": _LONGS, "hashes": _LONGS, "broken": pa.bool_(), "chunk": pa.string(), "kind": pa.string()}


def _scan(chunk: int, spread: int, all_rows: bool):
    """Finished rows (no ``no``) of texts within a chunk, partial sums of chunks, and raw chunks of texts beyond ``spread``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for doc, text, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                if len(text) <= chunk:
                    sums, distinct = Partial.of(text).finish()
                    kind = outcome(sums, distinct)
                    if all_rows or kind:
                        rows.append({"doc_id": doc, "sums": sums, "kind": kind})
                    continue
                cuts = cut_points(text, chunk)
                for no, ((at, broken), (end, _)) in enumerate(zip(cuts, [*cuts[1:], (len(text), False)])):
                    row = {"doc_id": doc, "text_hash": digest, "no": no, "broken": broken}
                    if len(text) > spread:
                        rows.append(row | {"chunk": text[at:end]})
                    else:
                        p = Partial.of(text[at:end], broken)
                        rows.append(row | {"sums": p.sums, "head": p.head, "tail": p.tail, "hashes": p.hashes})
                    if len(rows) >= 256:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)

    return run


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _TYPES.items()], names=list(_TYPES))


def _arrow(rows: list[tuple[int, int, int, Partial]]) -> pa.Table:
    longs = pa.list_(pa.int64())
    return pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text_hash": pa.array([r[1] for r in rows], pa.int64()),
            "no": pa.array([r[2] for r in rows], pa.int32()),
            "sums": pa.array([r[3].sums for r in rows], longs),
            "head": pa.array([r[3].head for r in rows], longs),
            "tail": pa.array([r[3].tail for r in rows], longs),
            "hashes": pa.array([r[3].hashes for r in rows], longs),
            "broken": pa.array([r[3].broken for r in rows], pa.bool_()),
        }
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, h, n, Partial.of(t, b)) for d, h, n, t, b in zip(*(batch.column(i).to_pylist() for i in range(5)))]
        yield from _arrow(rows).to_batches()


def _joined(table: pa.Table) -> Partial:
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    total = None
    for r in rows:
        one = Partial(r["sums"], r["head"], r["tail"], r["hashes"], r["broken"])
        total = one if total is None else total.join(one)
    return total


def _join_some(key: tuple, table: pa.Table) -> pa.Table:
    return _arrow([(key[0].as_py(), key[1].as_py(), key[2].as_py(), _joined(table))])


def _join_all(key: tuple, table: pa.Table) -> pa.Table:
    sums, distinct = _joined(table).finish()
    return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.int64())), "kind": pa.array([outcome(sums, distinct)], pa.string())})


def document_sums(documents: DataFrame, chunk: int = CHUNK, spread: int = SPREAD, all_rows: bool = True) -> DataFrame:
    """(doc_id, sums, kind) of every document, or of those with a kind."""
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.when(F.length("text") > chunk, F.xxhash64("text")))
    scanned = session.materialize(texts.mapInArrow(_scan(chunk, spread, all_rows), _SCANNED), "lines")
    columns = ["doc_id", "text_hash", "no", "sums", "head", "tail", "hashes", "broken"]
    one = ["doc_id", "text_hash", "no"]
    raw = scanned.where("chunk is not null").select(*one, "chunk", "broken").repartition(*one).dropDuplicates(one).mapInArrow(_chunks, _PARTIAL)
    partial = scanned.where("no is not null and chunk is null").select(*columns).dropDuplicates(one).unionByName(raw)
    level = partial.withColumn("no_group", F.floor(F.col("no") / FANOUT).cast("int")).groupBy("doc_id", "text_hash", "no_group").applyInArrow(_join_some, _PARTIAL)
    joined = level.groupBy("doc_id", "text_hash").applyInArrow(_join_all, _DONE)
    done = scanned.where("no is null").select("doc_id", "sums", "kind").unionByName(joined)
    return done if all_rows else done.where("kind is not null")


def text_statistics(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a document: counts, ratios and the rule outcome."""
    s = lambda i: F.col("sums")[i]
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return (
        document_sums(documents, chunk)
        .distinct()
        .select(
            "doc_id",
            s(N_CHARS).alias("n_chars_counted"),
            s(N_WORDS).alias("n_words"),
            share(s(N_LETTERS), s(N_WORDS)).alias("mean_word_length"),
            share(s(N_SYMBOLS), s(N_CHARS)).alias("symbol_ratio"),
            s(N_LINES).alias("n_lines"),
            share(s(N_ENDS), s(N_LINES)).alias("end_punctuation_share"),
            share(s(N_COMMON), s(N_WORDS)).alias("common_word_share"),
            "kind",
        )
    )


def not_prose(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, kind): documents most of whose text is not sentences."""
    return document_sums(documents, chunk, all_rows=False).select("doc_id", "kind").distinct()
