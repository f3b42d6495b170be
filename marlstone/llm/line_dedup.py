"""Line dedup over the corpus: a deletion-neighbourhood join of lines, exact copies by hash.

Lines are \\n-separated pieces with a word; they are compared by their words, A-Z lower-cased. Two lines of 10 words or more
are near copies if their word edit distance (inserted, deleted or replaced words) is at most a tenth of the words of the
shorter, rounded down. Two lines of fewer words are if they have 10 characters or more and one inserted, deleted or
replaced character tells them apart.

Variants, of which any two near copies share one (so the join loses no pair):

* fewer than 10 words: the line, and the line without each of its characters;
* 10 to 19 words (one edit), and 20 for their sake: the line, and the line without each of its words;
* 20 words or more (k edits, k >= 2): all sets of k words are too many to delete. Words are dealt by hash to c > 2k
  classes, and a variant is the line without all words but those of one class. An edit touches the words of two classes at
  most, so two near copies have c - 2k classes in common; of c sets of which so many are common, one is among the first
  2k + 1 in any fixed order (prefix filter), here that of the most characters. c follows from the band of k; a line that may
  have shorter near copies in the band below gives the variants of that too. A line with so many empty classes that one is
  among its first gives pairs of words in their place (prefix filter again: k edits destroy 2k pairs).

Variants that one line alone has go no further. Of the lines that share a variant, the earliest is the keeper: the others
are screened against it by length and by the parities of their words in 128 classes, of which an edit changes two at most,
then verified, and those that are near copies of it go. Lines that are left, and share a variant with three lines or more,
then meet all earlier lines of that variant in the same way. So a line goes if it is a near copy of any earlier line, and a
large group of near copies is never expanded into pairs, since its keeper takes nearly all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, drop_since, durable, mark, native_hash, same, signed, table

#: Least words of a line that is compared at all.
MIN_WORDS = 1
#: A line of so many words has one more edit for a near copy; one of fewer words needs so many characters for one of a character.
WORDS_PER_EDIT, CHARS_PER_EDIT = 10, 10
#: Lines of so many words or more give variants by classes; of so many or fewer, without one word.
LONG = 2 * WORDS_PER_EDIT
#: Words of the pairs that stand in for empty classes; how the bands of k widen; classes of a band above twice its k.
GRAM, WIDER, SPARE = 2, 1.25, 3
#: A line is hot if it makes up more than one in HOT of all lines: there are fewer than HOT such lines, which bounds their broadcast; variants likewise.
HOT = 50_000
#: One line in so many is in the sample that shows variants of many lines.
SAMPLE = 64
#: Earlier lines of a variant that are met in one task; of a variant of more lines, those left go to several.
BLOCK = 256
#: Variants are dealt to 2 ** BUCKET_BITS buckets; a task holds the cold variants of its buckets.
BUCKET_BITS = 12
#: Bytes of lines, or variants, that are handled together; lines that a task remembers.
FLUSH, SEEN = 1_000_000, 500_000

_ORDER = ("doc_id", "text_hash", "line_no")


def line_words(line: bytes) -> list[bytes]:
    """Words of a line, A-Z lower-cased."""
    return line.lower().split()


def within_one(a: str, b: str) -> bool:
    """Edit distance of 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def bound(a: int, b: int) -> int:
    """Words by which near copies of so many words may be apart."""
    return min(a, b) // WORDS_PER_EDIT


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines are near copies (Myers' bit-parallel algorithm, one bit for each word)."""
    if len(a) < WORDS_PER_EDIT and len(b) < WORDS_PER_EDIT:
        x, y = (b" ".join(w).decode("utf-8", "surrogatepass") for w in (a, b))
        return min(len(x), len(y)) >= CHARS_PER_EDIT and within_one(x, y)
    k = bound(len(a), len(b))
    if abs(len(a) - len(b)) > k:
        return False
    n, start, end = min(len(a), len(b)), 0, 0
    while start < n and a[start] == b[start]:
        start += 1
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b) <= k
    if len(a) == len(b) and sum(map(ne, a, b)) <= k:
        return True
    if len(set(a).difference(b)) > k or len(set(b).difference(a)) > k:  # an edit takes one word of each at most
        return False
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, apart = full, 0, len(a)
    for left, w in zip(range(len(b) - 1, -1, -1), b):
        eq = at.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        apart += 1 if up & last else -1 if down & last else 0
        if apart - left > k:
            return False
        up, down, eq = (up << 1 | 1) & full, down << 1 & full, eq | minus
        plus, minus = down | (full & ~(eq | up)), up & eq
    return apart <= k


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


def _sums(units: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Running sums, from 0, of units times their powers."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(np.multiply(units, power[: len(units)], dtype=np.uint64), out=out[1:])
    return out


class Lines:
    """Lines, joined from their words by spaces, as flat arrays: of each word its line, hash and length; of each line its
    number of words."""

    def __init__(self, lines: list[bytes], powers: tuple[np.ndarray, np.ndarray] | None = None):
        flat = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
        self.powers = powers if powers and len(powers[0]) > len(flat) else _powers(len(flat) + 1)
        ends = np.flatnonzero(flat == 32)
        starts = np.r_[0, ends[:-1] + 1]
        # a word's hash: a polynomial of its bytes, as the difference of two running sums, shifted to the same place
        sums = _sums(flat, self.powers[0])
        self.word = _mix((sums[ends] - sums[starts]) * self.powers[1][starts])
        self.chars = ends - starts
        last = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1  # the space behind each line
        self.size = np.diff(np.searchsorted(ends, last) + 1, prepend=0)
        self.no = np.repeat(np.arange(len(lines)), self.size)

    def only(self, keep: np.ndarray) -> Lines:
        """The lines where keep holds."""
        out, inside = copy(self), keep[self.no]
        out.word, out.chars, out.size = self.word[inside], self.chars[inside], self.size[keep]
        out.no = np.repeat(np.arange(len(out.size)), out.size)
        return out

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each line: a bit for each of 128 classes of words, set if the line has an odd number of them."""
        bit, starts = np.uint64(1) << (self.word & np.uint64(63)), np.cumsum(self.size) - self.size
        high = self.word & np.uint64(64) != 0
        low, high = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), starts) for side in (~high, high))
        return low, high


def _ranks(no: np.ndarray) -> np.ndarray:
    """Places from 0 within runs of equal numbers."""
    place = np.arange(len(no))
    return place - np.maximum.accumulate(np.where(np.r_[True, no[1:] != no[:-1]][: len(no)], place, 0))


def _without(sums: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Polynomials of the units from start to end without those from a to b."""
    return (sums[a] - sums[start] + (sums[end] - sums[b]) * inverse[b - a - 1]) * inverse[start]


def _fresh(no: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the repeats that follow each other: equal variants of a line are of units that are all alike."""
    keep = np.r_[True, (no[1:] != no[:-1]) | (key[1:] != key[:-1])][: len(no)]
    return no[keep], key[keep]


def short_variants(lines: list[bytes], powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of lines of few words and of the lines without each character."""
    flat = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(size + 1) - 1
    start = end - size
    a = np.flatnonzero((flat & 0xC0) != 0x80)  # where characters start; the space behind a line stands for the whole line
    no = np.repeat(np.arange(len(lines)), size + 1)[a]
    b = np.where(a == end[no], a, np.r_[a[1:], len(flat)])
    keep = np.bincount(no, minlength=len(lines))[no] > CHARS_PER_EDIT
    no, a, b = no[keep], a[keep], b[keep]
    return _fresh(no, _mix(_without(_sums(flat, powers[0]), start[no], end[no], a, b, powers[1]) + np.uint64(1)))


def word_variants(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the lines without each word, and of the lines."""
    end = np.cumsum(x.size)
    start, sums, a = end - x.size, _sums(x.word, x.powers[0]), np.arange(len(x.word))
    less = _fresh(x.no, _without(sums, start[x.no], end[x.no], a, a + 1, x.powers[1]))
    no, key = np.r_[less[0], np.arange(len(x.size))], np.r_[less[1], _without(sums, start, end, end, end, x.powers[1])]
    return no, _mix(key + np.uint64(2))


def pair_variants(x: Lines, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the first k * GRAM + 1 grams, longest first, of the lines where of holds; a gram's n-th
    repeat in a line is a gram of its own."""
    gram, chars = x.word[: len(x.word) - GRAM + 1], x.chars[: len(x.word) - GRAM + 1]
    for k in range(1, GRAM):
        gram, chars = _mix(gram) + x.word[k : len(x.word) - GRAM + 1 + k], chars + x.chars[k : len(x.word) - GRAM + 1 + k]
    no = x.no[: len(gram)]
    inside = (no == x.no[GRAM - 1 :]) & of[no]
    no, gram, chars = no[inside], gram[inside], chars[inside]
    order = np.lexsort((gram, -chars, no))
    no, gram = no[order], gram[order]
    place = np.arange(len(no))
    fresh = np.r_[True, (no[1:] != no[:-1]) | (gram[1:] != gram[:-1])][: len(no)]
    repeat = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(no) else place
    keep = _ranks(no) <= x.size[no] // WORDS_PER_EDIT * GRAM if len(no) else place.astype(bool)
    return no[keep], _mix(gram[keep] + _mix(repeat[keep].astype(np.uint64) + np.uint64(77)))


def bands(most: int) -> np.ndarray:
    """The least k of each band, up to one above most."""
    out = [LONG // WORDS_PER_EDIT]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDER)))
    return np.array(out, np.int64)


#: More characters of a class count as so many.
_MOST = np.uint64((1 << 16) - 1)


def class_variants(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of the variants by classes of lines of LONG words or more."""
    k = x.size // WORDS_PER_EDIT
    least = bands(int(k.max()))
    own = np.searchsorted(least, k, "right") - 1
    shortest = np.maximum(LONG, -(-x.size * WORDS_PER_EDIT // (WORDS_PER_EDIT + 1)))  # of its near copies
    low = np.searchsorted(least, shortest // WORDS_PER_EDIT, "right") - 1
    nos, keys, poor = [], [], np.zeros(len(x.size), bool)
    salted, dealt = _mix(x.word), x.word >> np.uint64(20)
    for below in range(int((own - low).max()) + 1):
        band = np.maximum(own - below, low)
        here = own - below >= low
        top = least[band + 1] - 1
        classes, first = 2 * top + SPARE, 2 * np.minimum(k, top) + 1
        slots = np.cumsum(np.where(here, classes, 0))
        inside = here[x.no]
        no = x.no[inside]
        at = slots[no] - classes[no] + (dealt[inside] % classes.astype(np.uint64)[no]).astype(np.int64)
        content, chars = np.zeros(slots[-1], np.uint64), np.zeros(slots[-1], np.int64)
        np.add.at(content, at, salted[inside])
        np.add.at(chars, at, x.chars[inside])
        for one in np.unique(band[here]):  # lines of as many classes: a row each
            rows = np.flatnonzero(here & (band == one))
            n = int(classes[rows[0]])
            of = np.arange(n, dtype=np.uint64)
            at = (slots[rows] - n)[:, None] + np.arange(n)
            # one number that sorts by characters, most first and no word last, then by content; its low bits are the class
            low_bits = np.uint64((1 << n.bit_length()) - 1)
            rank = (_MOST - np.minimum(chars[at], int(_MOST)).astype(np.uint64)) << np.uint64(48) | (content[at] >> np.uint64(16)) & ~low_bits | of
            rank = np.sort(rank, axis=1)[:, : int(first[rows].max())]
            keep = (rank >> np.uint64(48) < _MOST) & (np.arange(rank.shape[1]) < first[rows][:, None])
            poor[rows] |= keep.sum(axis=1) < first[rows]
            of = rank & low_bits
            key = _mix(content[(slots[rows] - n)[:, None] + of.astype(np.int64)] + _mix(of + np.uint64(n << 20)))
            nos.append(np.repeat(rows, keep.sum(axis=1)))
            keys.append(key[keep])
    if poor.any():
        no, key = pair_variants(x, poor)
        nos.append(no)
        keys.append(key)
    return np.concatenate(nos), np.concatenate(keys)


def variants(lines: list[bytes], x: Lines | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, hash) of the variants of lines, by number; x: Lines(lines)."""
    x = x or Lines(lines)
    short, long = x.size < WORDS_PER_EDIT, x.size >= LONG
    kinds = (
        (short, lambda: short_variants([lines[i] for i in np.flatnonzero(short)], x.powers)),
        (~short & (x.size <= LONG), lambda: word_variants(x.only(~short & (x.size <= LONG)))),
        (long, lambda: class_variants(x.only(long))),
    )
    parts = [(np.flatnonzero(of)[no], key.view(np.int64)) for of, make in kinds if of.any() for no, key in (make(),)]
    no, key = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(no, kind="stable")
    return no[order], key[order]


def _line_rows(rows: list[tuple], fresh: list[int], lines: list[bytes], powers: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """rows of (doc_id, text_hash, line_no, h); those numbered in fresh have lines, hence figures and variants."""
    at = np.full(len(rows), -1)
    cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
    if lines:
        at[fresh] = np.arange(len(fresh))
        x = Lines(lines, powers)
        low, high = x.parities()
        no, key = variants(lines, x)
        sizes = np.bincount(no, minlength=len(lines))[at] * (at >= 0)
        own = [v[at] for v in (x.size.astype(np.int32), low.view(np.int64), high.view(np.int64))]
    else:
        key, sizes, own = np.zeros(0, np.int64), np.zeros(len(rows), np.int64), [np.zeros(len(rows), k) for k in (np.int32, np.int64, np.int64)]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(key))
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(v, mask=at < 0) for v in own), lists], ["doc_id", "text_hash", "line_no", "h", "words", "low", "high", "variants"])


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text): doc_id, text_hash, line_no, h of each line; where h is new of late, also its words, parities and
    variants."""
    powers, seen = _powers(4 * FLUSH), set()
    for b in batches:
        rows, fresh, lines, n = [], [], [], 0
        for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = value.as_py() or b""
            th = signed(xxhash.xxh64_intdigest(raw, 42))
            for no, line in enumerate(raw.lower().split(b"\n")):
                words = line.split()
                if words and len(words) >= MIN_WORDS:
                    line = b" ".join(words)
                    h = signed(xxhash.xxh64_intdigest(line))
                    if h not in seen:
                        seen.add(h)
                        fresh.append(len(rows))
                        lines.append(line)
                        n += len(line)
                    rows.append((doc, th, no, h))
            if n > FLUSH or len(rows) > FLUSH:
                yield _line_rows(rows, fresh, lines, powers)
                rows, fresh, lines, n = [], [], [], 0
            if len(seen) > SEEN:
                seen = set()
        if rows:
            yield _line_rows(rows, fresh, lines, powers)


def _deal(hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (h, variants): the variants but the hot ones, and their h, in blocks by bucket."""
    hot = np.sort(hot)

    def dealt(key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        if len(hot):
            cold = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] != key
            key, h = key[cold], h[cold]
        bucket = (key.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        n = np.bincount(bucket, minlength=1 << BUCKET_BITS)
        own = np.flatnonzero(n)
        at = pa.py_buffer(np.r_[0, np.cumsum(n[own]) * 8].astype(np.int32))
        blocks = [pa.Array.from_buffers(pa.binary(), len(own), [None, at, pa.py_buffer(v[order])]) for v in (key, h)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *blocks], ["bucket", "keys", "hs"])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hs, n = [], [], 0
        for b in batches:
            lists = b.column("variants")
            keys.append(lists.flatten().to_numpy())
            hs.append(np.repeat(b.column("h").to_numpy(), lists.value_lengths().to_numpy()))
            n += len(keys[-1])
            if n > FLUSH:
                yield dealt(np.concatenate(keys), np.concatenate(hs))
                keys, hs, n = [], [], 0
        if n:
            yield dealt(np.concatenate(keys), np.concatenate(hs))

    return batches_of


def _several(key: np.ndarray) -> np.ndarray:
    """Whether a sorted key is there more than once."""
    again = key[1:] == key[:-1]
    return (np.r_[False, again] | np.r_[again, False])[: len(key)]


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blocks of whole buckets: the distinct (key, h) of the keys that two lines or more have."""
    blocks = [(np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(h.as_buffer(), np.int64)) for b in batches for k, h in zip(b.column("keys"), b.column("hs"), strict=True)]
    if not blocks:
        return
    key, h = (np.concatenate(v) for v in zip(*blocks))
    del blocks
    order = np.argsort(key)
    key, h = key[order], h[order]
    several = _several(key)  # most are of one line only
    key, h = key[several], h[several]
    order = np.lexsort((h, key))
    key, h = _fresh(key[order], h[order])
    several = _several(key)
    key, h = key[several], h[several]
    for at in range(0, len(key), FLUSH):
        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + FLUSH]), pa.array(h[at : at + FLUSH])], ["key", "h"])


def _wanted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, nos, hs): the lines nos of a text, with their hashes. Whole repeats of a row stand one after the other."""
    last = None
    for b in batches:
        hs, lines = [], []
        for value, nos, own in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if own != last:
                parts = value.as_py().split(b"\n")
                hs += own
                lines += [parts[k] for k in nos]
                last = own
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(lines, pa.binary())], ["h", "line"])


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good, last, words = [], None, []
        for x, y in zip(b.column("line").to_pylist(), b.column("early_line").to_pylist(), strict=True):
            if y != last:  # they come by the earlier line
                last, words = y, line_words(y)
            good.append(near(line_words(x), words))
        yield pa.RecordBatch.from_arrays([b.column("h").filter(pa.array(good, pa.bool_()))], ["h"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a text and the numbers of its lines to drop (columns __text, __drop): the text left, and how many words."""
    for b in batches:
        texts, left = [], []
        for value, drop in zip(b.column("__text").to_pylist(), b.column("__drop").to_pylist(), strict=True):
            if drop:
                gone = set(drop)
                value = b"\n".join(x for k, x in enumerate(value.split(b"\n")) if k not in gone)
            texts.append(value)
            left.append(len((value or b"").split()))
        rest = [k for k, name in enumerate(b.schema.names) if name not in ("__text", "__drop")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(texts, pa.binary()), pa.array(left, pa.int64())], [*(b.schema.names[k] for k in rest), "__text", "__left"])


def _screen(a: str, b: str) -> Column:
    """Whether lines may be near copies, by the structs a and b of words, low and high."""
    apart = f"bit_count({a}.low ^ {b}.low) + bit_count({a}.high ^ {b}.high)"
    least = f"least({a}.words, {b}.words)"
    # of e edits, those that insert or delete change one class, and the number of words: apart + that difference <= 2 e
    long = f"{least} >= {WORDS_PER_EDIT} and abs({a}.words - {b}.words) <= {least} div {WORDS_PER_EDIT} and {apart} + abs({a}.words - {b}.words) <= 2 * ({least} div {WORDS_PER_EDIT})"
    # a space inserted or deleted changes three words
    return F.expr(f"({long}) or (greatest({a}.words, {b}.words) < {WORDS_PER_EDIT} and {apart} <= 3)")


def _near(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h of the pairs (h, early_h) that are near copies; wanted: (h, line)."""
    both = pairs.join(wanted, "h").join(wanted.select(F.col("h").alias("early_h"), F.col("line").alias("early_line")), "early_h")
    return both.select("h", "line", "early_line").mapInArrow(_verify_batches, "h long").distinct()


def doomed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, drop: line numbers, n_exact, n_near) of the documents that lose lines."""
    began = mark()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    lines = durable(plain.mapInArrow(_line_batches, "doc_id long, text_hash long, line_no int, h long, words int, low long, high long, variants array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), *_ORDER)
    first = durable(lines.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("words", "low", "high")]))

    # most variants are of one line only: they go before anything is joined. A variant that many lines of a sample by hash
    # have is shared, and takes no part in the deal by variants; there are fewer than HOT of them
    emitted = lines.select(F.explode("variants").alias("key"), "h")
    some = durable(emitted.where(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("key").count())
    hot = some.where(F.col("count") > F.greatest(F.lit(SAMPLE), F.lit((some.agg(F.sum("count")).first()[0] or 0) / HOT))).select("key")
    of_key = Window.partitionBy("key")
    dealt = lines.select("h", "variants").mapInArrow(_deal(np.array([r.key for r in hot.collect()], np.int64)), "bucket int, keys binary, hs binary")
    rare = dealt.repartition("bucket").mapInArrow(_shared_batches, "key long, h long")
    shared = durable(rare.unionByName(emitted.join(F.broadcast(hot), "key").distinct()))
    figures = first.select("h", F.struct("first", "h", "words", "low", "high").alias("line"))
    at = durable(shared.join(figures, "h").select("key", "line"))
    drop(shared)

    # a hot variant has its keeper from partial minima
    calm = at.join(F.broadcast(hot), "key", "left_anti")
    keepers = at.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("line").alias("early"), F.count("*").alias("of"))
    calm_met = calm.withColumns({"early": F.min("line").over(of_key), "of": F.count("*").over(of_key)}).where("early.h <> line.h")
    hot_met = at.join(F.broadcast(keepers), "key").where("early.h <> line.h")
    # lines beside the keeper, of those that may be near copies of another one beside it; whole structs, so that both sides read one shuffle
    other = calm.select(F.col("key").alias("other_key"), F.col("line").alias("other")).hint("merge")
    beside = calm_met.where("of > 2").join(other, (F.col("key") == F.col("other_key")) & _screen("line", "other") & F.expr("other <> line and other <> early"), "left_semi")
    beside = beside.unionByName(hot_met.where("of > 2")).select("key", "of", "line", F.lit(None).cast("long").alias("early_h"))
    met = calm_met.unionByName(hot_met).where(_screen("line", "early")).select("key", "of", "line", F.col("early.h").alias("early_h"))
    met = durable(met.unionByName(beside))
    drop(some, at)
    pairs = durable(met.where("early_h is not null").select(F.col("line.h").alias("h"), "early_h").distinct())
    more = met.where("early_h is null").groupBy(F.col("line.h").alias("h")).agg(F.first("line").alias("line"), F.sort_array(F.collect_list(F.struct("key", "of"))).alias("own"))
    more = durable(more.select("h", "line.first", "line.words", "line.low", "line.high", F.col("own.key").alias("keys"), F.col("own.of").alias("sizes")))
    drop(met)

    needed = pairs.select("h").unionByName(pairs.select("early_h").toDF("h")).unionByName(more.select("h")).distinct()
    where = first.join(needed, "h", "left_semi").select("h", *[F.col(f"first.{c}").alias(c) for c in _ORDER])
    where = where.groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("nos"), F.collect_list("h").alias("hs"))  # of one document
    texts = plain.withColumn("text_hash", native_hash(F.col("text")))
    # no bound is known for what is joined with the texts: never a broadcast, at any size
    wanted = durable(same(texts, where.hint("merge"), ["doc_id", "text_hash"], "inner").select("text", "nos", "hs").mapInArrow(_wanted_batches, "h long, line binary"))

    near_keeper = durable(_near(pairs, wanted))
    # a pair meets at the first variant that both have: below are those before it
    figures = F.struct("first", "h", "words", "low", "high")
    shown = ["key", f"(sizes[at] - 1) div {BLOCK} + 1 as blocks", "slice(keys, 1, at) as below", "h", "line"]
    left, earlier = (x.select("*", F.posexplode("keys").alias("at", "key")).withColumn("line", figures).selectExpr(*shown) for x in (more.join(near_keeper, "h", "left_anti"), more))
    left = left.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    earlier = earlier.selectExpr("key", "pmod(h, blocks) as block", "h as early_h", "line as early", "below as early_below")
    rest = left.join(earlier.hint("merge"), ["key", "block"]).where(_screen("line", "early") & F.expr("early.first < line.first and not arrays_overlap(below, early_below)"))
    rest = durable(rest.select("h", "early_h"))
    of_rest = rest.select("h").unionByName(rest.select("early_h").toDF("h")).distinct()
    near_other = _near(rest, wanted.join(of_rest, "h", "left_semi"))
    near_h = near_keeper.unionByName(near_other).withColumn("near", F.lit(True))  # a line is in one of them
    verdict = durable(first.select("h", "first", "n").join(near_h, "h", "left"))
    drop(wanted, more, pairs, rest)
    # a hot line has no task of its own: there are few, and they go to the lines
    hot = verdict.where(F.col("n") > (first.agg(F.sum("n")).first()[0] or 0) / HOT).drop("n")
    own = lines.select("h", "doc_id", "text_hash", "line_no").withColumn("own", order)
    cold = own.join(F.broadcast(hot.select("h")), "h", "left_anti").join(verdict.drop("n"), "h")
    judged = own.join(F.broadcast(hot), "h").unionByName(cold).where("near or first < own")
    gone = judged.groupBy("doc_id", "text_hash").agg(
        F.collect_set("line_no").alias("drop"), F.count_if(F.expr("first < own")).alias("exact"), F.count_if(F.expr("not first < own")).alias("near_only"), F.count("*").alias("n")
    ).select("doc_id", "text_hash", "drop", (F.col("exact") * F.size("drop") / F.col("n")).cast("long").alias("n_exact"), (F.col("near_only") * F.size("drop") / F.col("n")).cast("long").alias("n_near"))
    gone = durable(gone)
    drop_since(began, gone)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines removed that occur earlier, plus __text, __left (words left), __n_exact and __n_near.

    A line goes if an equal line stands earlier, or if it is a near copy of a line whose first occurrence is earlier than its
    own, whether that one goes or not. Earlier: by doc_id (null last), then a hash of the text, then the line's number. Whole
    repeats of a row rank equal and keep the same lines. Lines without a word stay. Null text stays null. Lines that stay
    stay as they are. An empty table gives an empty result.
    """
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": native_hash(docs["text"]), "__text": F.col("text").cast("string").cast("binary")}).drop("text")
    gone = doomed_lines(docs).select(*[F.col(a).alias(b) for a, b in (("doc_id", "__g_id"), ("text_hash", "__g_hash"), ("drop", "__drop"), ("n_exact", "__n_exact"), ("n_near", "__n_near"))])
    gone = gone.hint("merge")  # as many rows as documents that lose lines
    both = keyed.join(gone, keyed["__id"].eqNullSafe(gone["__g_id"]) & (keyed["__hash"] == gone["__g_hash"]), "left").drop("__g_id", "__g_hash", "__id", "__hash")
    return both.mapInArrow(_cut_batches, _kinds(both.drop("__text", "__drop")) + ", __text binary, __left long").withColumn("__text", F.col("__text").cast("string"))


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs, each text without its repeated lines; a text that has no word left goes if it had any. n_chars, where
    there is such a column, follows the text."""
    had_words = docs.withColumn("__had", F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = dedup_lines(had_words).where("__left > 0 or not __had").withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text left, n_words left, n_exact and n_near lines removed)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("__text").alias("text"), F.col("__left").alias("n_words"), F.coalesce("__n_exact", zero).alias("n_exact"), F.coalesce("__n_near", zero).alias("n_near"))
