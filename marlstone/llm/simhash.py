"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most 4 bits differ
in at most 1 bit of the first segment, or at most 1 of the second, or not at all in the third (else they would differ
in 2 + 2 + 1 bits). So balls of radius 1, 1 and 0 around each segment find every link. A ball of radius 1 around 22
bits is not sent over the network as 23 keys: one half of the segment is the same in both fingerprints, so the rows
meet by that half, and the ball over the other half is enumerated where they meet. Each fingerprint is shuffled 5 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, durable, table, text_bytes

BITS = 4
#: Of each table: shift and width of the half that must agree, shift and width of the half with a ball around it.
TABLES = ((0, 11, 11, 11), (11, 11, 0, 11), (22, 11, 33, 10), (33, 10, 22, 11), (43, 21, 0, 0))
#: Candidate pairs that are held at once.
BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = 4) -> int:
    """Of the shingles of a whole text, repeats included; no word: 0."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [line[a:b] for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(s, 42) for s in shingles], np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        part = np.unpackbits(h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pad = -len(part) % 255
        if pad:
            part = np.concatenate((part, np.zeros((pad, 64), np.uint8)))
        total += part.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smaller labels spread over the links until nothing changes."""
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the members of starts[k]..starts[k]+counts[k]-1 for each k."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, starts[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


def links(fps: np.ndarray, shift: int, width: int, bits: int = BITS) -> np.ndarray:
    """For each of the distinct fingerprints of a table's bucket, the position of one that it is connected to (perhaps
    itself), such that these connect all that links connect. Ball of radius 1 over the given half, 0 if width is 0."""
    n = len(fps)
    label = np.arange(n)
    part = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    order = np.argsort(part, kind="stable")
    key = part[order]
    big = n > 4096
    if big:  # steps of one bit first: dense families shrink to a part or a few, and only the others meet all
        by = np.argsort(fps)
        for b in range(64):
            to = np.minimum(np.searchsorted(fps[by], fps ^ np.uint64(1 << b)), n - 1)
            hit = fps[by][to] == (fps ^ np.uint64(1 << b))
            label = _merge(label, np.flatnonzero(hit), by[to[hit]])
    main = np.bincount(label, minlength=n).argmax() if big else -1
    for flip in (0, *(1 << b for b in range(width))):
        lo = np.searchsorted(key, key ^ np.uint64(flip), "left")
        hi = np.searchsorted(key, key ^ np.uint64(flip), "right")
        if flip == 0:
            lo = np.arange(n) + 1  # each pair once
        elif not big:
            lo = np.where(key & np.uint64(flip), hi, lo)
        count = np.maximum(hi - lo, 0)
        if big:  # two of the main part are connected already
            lo = np.where(flip == 0, np.searchsorted(key, key, "left"), lo)
            count = np.where(label[order] == main, 0, hi - lo)
        ends = np.cumsum(count)
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            row, col = _ranges(lo[at:upto], count[at:upto])
            i, j = order[row + at], order[col]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
            label = _merge(label, i[near], j[near])
            at = upto
    return label


def _bucket_edges(key: tuple, t: pa.Table) -> pa.Table:
    at = key[0].as_py()
    fps, ids = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
    label = links(fps, *TABLES[at][2:]) if len(fps) > 1 else np.zeros(1, np.int64)
    i = np.flatnonzero(label != np.arange(len(fps)))
    return pa.table({"u": ids[i], "v": ids[label[i]]})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest doc_id reachable over links. Equal
    fingerprints are one node, so exact copies are never paired. Null text: as empty, fingerprint zero. A null doc_id
    keeps its row and takes the component of its fingerprint (null if no row of that fingerprint has an id). Repeated
    rows each give a row. An empty table gives an empty result. Other columns are ignored.
    """
    fps = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_print_batches, "doc_id long, fp long"))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    keys = F.array(*[F.struct(F.lit(k).alias("at"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("half")) for k, (s, w, _, _) in enumerate(TABLES)])
    rows = nodes.where("rep is not null").select("fp", "rep", F.explode(keys).alias("k")).select("k.at", "k.half", "fp", "rep")
    edges = rows.groupBy("at", "half").applyInArrow(_bucket_edges, "u long, v long")
    roots = components(edges)
    nodes = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(F.col("fp").alias("n_fp"), F.coalesce("root", "rep").alias("component_id"))
    return fps.join(nodes, F.col("fp") == F.col("n_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate component; all columns stay.

    Rows without an id all stay: none of them can be named as the one to keep. Rows that repeat the smallest id all stay.
    """
    found = near_duplicates(docs)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    lone = docs.where("doc_id is null")
    keep = keep.hint("merge")  # it grows with the documents: never a broadcast
    kept = docs.join(keep, docs["doc_id"] == keep["__keep"], "left_semi")
    return kept.unionByName(lone)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
