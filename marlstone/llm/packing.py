"""Best-fit packing of documents into sequences, by patterns fitted with non-negative least squares.

1. Documents become token ids; only those over the limit are cut. The histogram of piece lengths (at most LIMIT rows) is
   all that the driver sees.
2. Lengths are rounded up to a grid of GRID tokens. All patterns of up to PARTS lengths that fill a sequence on the grid
   are enumerated; non-negative least squares fits their repeat counts to the histogram (Krell et al., 2021), which are
   rounded down and given real lengths, the longest of each grid step first.
3. The residual goes best-fit, longest first, into what is left in those sequences, then into new ones. All of this
   handles equal lengths and equal sequences as groups with a count, so its cost follows the number of lengths.
4. Each piece has a rank among those of its length; a search in the plan's ranges of ranks gives its sequence and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

LIMIT, GRID, PARTS = 4096, 32, 3
END = 1
#: Words and word pieces whose ids a task remembers; then the memory starts anew.
REMEMBER, REMEMBER_PIECES = 400_000, 400_000
#: Texts that are encoded together.
TEXTS = 256
#: Tokens of the tokenizer's pre-tokenizer, over lower-cased text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which lower() and \p{L} agree with the tokenizer's normaliser, and that composition leaves alone.
PLAIN = "[^\t\n\r -~¡-įĲ-ňŊ-ž]"


def encoder(spec: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids, as little-endian 32-bit bytes. The tokenizer splits at white space and encodes each piece of a word
    alone, so the ids of words are remembered, and the new pieces of many texts are encoded at once, joined by spaces;
    texts with other characters or special tokens go through the tokenizer whole."""
    import re

    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    full = Tokenizer.from_str(spec)
    specials = [t.content for t in full.get_added_tokens_decoder().values()]
    odd, split = re.compile(PLAIN), regex.compile(PIECE).findall
    words: dict[str, bytes] = {}
    pieces: dict[str, bytes] = {}
    lean = Tokenizer.from_str(spec)  # for pieces: lower-cased and cut already
    lean.normalizer = None
    lean.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def cut(w: str) -> tuple[str, ...] | list[str]:
        if w.isalpha():
            return (w,)
        if w[-1] in ".,!?" and w[:-1].isalpha():
            return w[:-1], w[-1]
        return split(w)

    def learn(new: set[str]) -> None:
        parts = {w: cut(w) for w in new}
        fresh = list({p for ps in parts.values() for p in ps}.difference(pieces))
        if len(pieces) + len(fresh) > REMEMBER_PIECES:
            pieces.clear()
            fresh = list({p for ps in parts.values() for p in ps})
        if fresh:
            e = lean.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.asarray(e.ids, "<u4"), np.asarray(e.word_ids, np.int64)
            ends = np.searchsorted(of, np.arange(len(fresh)), "right") * 4
            data, at = ids.tobytes(), 0
            for p, end in zip(fresh, ends.tolist(), strict=True):
                pieces[p] = data[at:end]
                at = end
        for w, ps in parts.items():
            words[w] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])

    def encode(texts: list[str]) -> list[bytes]:
        found = [None if odd.search(t) or any(s in t for s in specials) else t.lower().split() for t in texts]
        if len(words) > REMEMBER:
            words.clear()
        if new := set(chain.from_iterable(ws for ws in found if ws)).difference(words):
            learn(new)
        return [np.asarray(full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else b"".join(map(words.__getitem__, ws)) for t, ws in zip(texts, found, strict=True)]

    return encode


def _piece_batches(spec: Callable[[], str], limit: int) -> Callable:
    def rows_of(encode: Callable, b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        end, width = np.asarray([END], "<u4").tobytes(), 4 * limit
        for doc, data in zip(b.column(0).to_pylist(), (x for at in range(0, b.num_rows, TEXTS) for x in encode([t or "" for t in b.column(1)[at : at + TEXTS].to_pylist()])), strict=True):
            data += end
            rows += [(doc, k, at // 4, len(part := data[at : at + width]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(data), width))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        encode = encoder(spec())
        gc.disable()  # millions of small objects, none of them in cycles; a worker's next task has it back
        try:
            for b in batches:
                yield rows_of(encode, b)
        finally:
            gc.enable()

    return run


def patterns(units: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most so many positive parts that sum to units."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < parts:
            for k in range(min(left, head[-1] if head else left), 0, -1):
                if k * (parts - len(head)) >= left:
                    extend((*head, k), left - k)

    extend((), units)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b| (Lawson and Hanson's active sets)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        grad = a.T @ (b - a @ x)
        grad[active] = -np.inf
        best = int(grad.argmax())
        if grad[best] <= tol:
            break
        active[best] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 0)
            if not low.any():
                x = z
                break
            gap = x[low] - z[low]
            x = x + float(np.min(x[low] / np.where(gap > 0, gap, 1))) * (z - x)
            active &= x > tol * 1e-3
            x[~active] = 0
    return x


def fit(counts: dict[int, int], limit: int = LIMIT, grid: int = GRID, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold counts[length] pieces of each length."""
    units = limit // grid
    left = dict(counts)
    steps: list[list[int]] = [[] for _ in range(units + 1)]  # lengths of each grid step, the longest last
    for n in sorted(counts):
        steps[-(-n // grid)].append(n)
    shapes = patterns(units, parts)
    a = np.zeros((units, len(shapes)))
    for k, shape in enumerate(shapes):
        for u in shape:
            a[u - 1, k] += 1
    times = nnls(a, np.array([float(sum(counts[n] for n in steps[u])) for u in range(1, units + 1)])) if counts else np.zeros(len(shapes))
    groups: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-times):
        r = int(times[k] + 1e-6)
        while r > 0:
            row, need = [], {}
            for u in shapes[k]:
                while steps[u] and not left[steps[u][-1]]:
                    steps[u].pop()
                n = next((n for n in reversed(steps[u]) if left[n] > need.get(n, 0)), None)
                if n is None:
                    break
                need[n] = need.get(n, 0) + 1
                row.append(n)
            if len(row) < len(shapes[k]):
                break
            m = min(r, *(left[n] // c for n, c in need.items()))
            for n, c in need.items():
                left[n] -= m * c
            groups.append((tuple(row), m))
            r -= m
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    caps: list[int] = []

    def put(row: tuple[int, ...], m: int) -> None:
        cap = limit - sum(row)
        if cap not in room:
            room[cap] = []
            insort(caps, cap)
        room[cap].append((row, m))

    for row, m in groups:
        put(row, m)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(caps, n)
            if at < len(caps):
                cap = caps[at]
                row, m = room[cap].pop()
                if not room[cap]:
                    del room[cap]
                    caps.pop(at)
                if m > c:
                    put(row, m - c)
                    m = c
                put((*row, n), m)
                c -= m
            else:
                k = min(limit // n, c)
                put((n,) * k, c // k)
                c -= c // k * k
    return [g for cap in caps for g in room[cap]]


def ranges(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), first sequence and offset of each range of ranks."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for row, m in groups:
        at = 0
        for n in row:
            rows.append(((n << 40) | rank.get(n, 0), base, at))
            rank[n] = rank.get(n, 0) + m
            at += n
        base += m
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def _place_batches(plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = plan.value
        for b in batches:
            key = (b.column("length").to_numpy() << 40) | b.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            keep = [k for k, name in enumerate(b.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(base[at] + key - keys[at]), pa.array(offset[at])], [*(b.schema.names[k] for k in keep), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece of each row of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a tokenizers file on the driver. A document's tokens are its ids and then END; null text is as
    empty, so it is the one token END. Documents over the limit are cut at multiples of it. Sequences are gapless from
    offset 0. Whole repeats of a row are packed as documents of their own; a null doc_id stays null. Other columns are
    ignored; an empty table gives an empty result.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Tokenizer.from_file(tokenizer).to_str())  # of a fixed vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = durable(rows.mapInArrow(_piece_batches(lambda: spec.value, limit), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").agg(F.count("*")).collect()}
    plan = spark.sparkContext.broadcast(ranges(fit(counts, limit)))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    pieces = pieces.withColumn("bucket", F.pmod(order, F.lit(max(1, sum(counts.values()) // 2048))))
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(order, "doc_id", "piece", "start"))
    ranked = pieces.withColumn("within", within).join(sums, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return ranked.mapInArrow(_place_batches(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
