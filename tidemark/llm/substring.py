"""Removal of repeated passages (operator 9).

A window is WIDTH consecutive words of one text; a word goes if some window
over it occurs, as a sequence of words, at another place of the corpus too.

Texts are dealt into packs by hash.  (1) Each pack makes a sketch of its
windows: the counters of a count-min sketch row, saturated at two, kept as
sorted cell numbers.  The sketch is as wide as the corpus asks for and merged
block by block, so no task and no driver ever holds all of it; each pack gets
back those of its cells that are estimated at two or more.  Estimates only err
upwards.  (2) Windows in such cells, and only they, are grouped exactly by 128
bits of hash.  (3) Each pack marks the words under its repeated windows.

All three passes read one shuffle of the texts.  A pack sends each cell and
each window once however often it holds it, so a passage that is everywhere
costs one entry per pack.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrowtext

WIDTH = 35
#: Bytes of text in a pack, entries in a block, sketch cells for each expected window.
PACK_BYTES, BLOCK_ENTRIES, CELLS_EACH = 4 << 20, 2 << 20, 64
#: Tasks of a shuffle of packs, unless the session asks for more; beyond that tasks hold several packs.
MOST_TASKS = 20_000
#: Bytes of text for each word, to foresee how many windows there are; a wrong guess changes speed only.
WORD_BYTES = 5

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(31)


def _mix(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (a ^ (a >> _SHIFT)) * odd + b
    return (x ^ (x >> _SHIFT)) * odd


def window_hashes(words: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """Hash of each run of `width` word hashes, put together from runs of powers of two."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, words, 1
    while True:
        if width & size:
            part = run[done : done + n]
            out = part if out is None else _mix(out, part, odd)
            done += size
        if done == width:
            return out if width > 1 else _mix(out, out, odd)
        run = _mix(run[: len(run) - size], run[size:], odd)
        size *= 2


class Windows:
    """Words and windows of a pack: `first`, `second` are hashes of the windows that lie in one text, `at` their first words."""

    def __init__(self, column: pa.Array, width: int):
        arrowtext.give_back()  # what the pack before left
        raw, rows = arrowtext.buffers(column)
        self.words = arrowtext.Words(raw, rows)
        inside = np.zeros(len(self.words), bool)
        counts = np.diff(self.words.docs)
        inside[arrowtext.ragged(self.words.docs[:-1], np.maximum(counts - width + 1, 0))] = True
        self.at = np.flatnonzero(inside)
        both = []
        for seed, odd in enumerate(_ODD):
            both.append(window_hashes(arrowtext.polynomial(self.words, seed), width, odd)[self.at])
        self.first, self.second = both


def _packed(x: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane: planes of high bytes compress to next to nothing."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _planes(x: np.ndarray) -> bytes:
    return x.tobytes()


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1), dtype=kind)


def _by_block(x: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(block, from, to) of sorted 64-bit hashes, by their highest bits."""
    if not len(x):
        return []
    block = (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    edge = np.flatnonzero(np.diff(block)) + 1
    lows, highs = np.concatenate(([0], edge)), np.concatenate((edge, [len(x)]))
    return list(zip(block[lows].tolist(), lows.tolist(), highs.tolist(), strict=True))


def _member(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of x is in `of`, which is sorted; its first place there)."""
    if not len(of):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x, at


def _sorted_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order of pairs; equal first ones, which are rarely of different pairs, are sorted by the second if need be."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    mixed = (a[1:] == a[:-1]) & (b[1:] != b[:-1])
    return np.lexsort((second, first)) if mixed.any() else order


def _repeated(parts: list[np.ndarray], twice: list[np.ndarray]) -> np.ndarray:
    """Sorted values that are in two parts, or in `twice`."""
    every = np.sort(np.concatenate(parts))
    return arrowtext.distinct_sorted(np.sort(np.concatenate((every[1:][every[1:] == every[:-1]], *twice))))


def remove_repeats(df: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried, n_words, n_removed, kept) of every row.

    kept: the words that stay, joined by one blank; carried: a struct of the
    columns named in `carry`.  Windows are judged on the texts as they come in.
    Null and empty texts have no words; texts under `width` words lose none;
    rows that repeat, with equal keys or not, are repeats of each other.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    expected = max(1, total // WORD_BYTES)
    packs = max(1, math.ceil(total / PACK_BYTES), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / 2))
    block_bits = max(4, math.ceil(math.log2(max(1, expected / BLOCK_ENTRIES))))
    cell_bits = min(block_bits + 31, max(block_bits + 8, math.ceil(math.log2(expected * CELLS_EACH))))
    inner = cell_bits - block_bits  # bits of a cell within its block
    down, low = np.uint64(64 - cell_bits), np.uint64((1 << inner) - 1)
    kind = df.schema[key].dataType
    carried = F.struct(*carry) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    tasks = min(packs, max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    docs = df.select(F.pmod(F.xxhash64(key, text), F.lit(packs)).alias("pack"), F.col(key).alias("key"), carried.alias("carried"), F.col(text).alias("text")).repartition(tasks, "pack")  # so few packs share a task, which sorts its texts

    def cells_of(first: np.ndarray) -> np.ndarray:
        return first >> down

    def sketch(name: tuple, rows: pa.Table) -> pa.Table:
        cells = np.sort(cells_of(Windows(rows.column("text"), width).first))
        again = arrowtext.distinct_sorted(cells[1:][cells[1:] == cells[:-1]])
        cells = arrowtext.distinct_sorted(cells)
        out = []
        for block, a, z in _by_block(cells << down, block_bits):
            i, j = np.searchsorted(again, [cells[a], cells[z - 1] + np.uint64(1)])
            out.append((block, _packed((cells[a:z] & low).astype(np.uint32)), _packed((again[i:j] & low).astype(np.uint32))))
        return table(out, name[0].as_py(), ["block", "cells", "again"], pa.binary())

    def table(out: list[tuple], pack: int, names: list[str], last: pa.DataType) -> pa.Table:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.binary(), last)
        return pa.table([pa.array([pack] * len(out), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["pack", *names])

    def merge(name: tuple, rows: pa.Table) -> pa.Table:
        own = [_unpacked(b, np.uint32) for b in rows.column("cells").to_pylist()]
        found = _repeated(own, [_unpacked(b, np.uint32) for b in rows.column("again").to_pylist()])
        packs_, cells = [], []
        for pack, x in zip(rows.column("pack").to_pylist(), own, strict=True):
            hit = x[_member(x, found)[0]]
            if len(hit):
                packs_.append(pack)
                cells.append(_packed(hit))
        return pa.table([pa.array(packs_, pa.int64()), pa.array([name[0].as_py()] * len(packs_), pa.int64()), pa.array(cells, pa.binary())], ["pack", "block", "cells"])

    def candidates(name: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        wanted = [np.zeros(0, np.uint64)]
        for block, b in sorted(zip(back.column("block").to_pylist(), back.column("cells").to_pylist(), strict=True)):
            wanted.append((np.uint64(block) << np.uint64(inner)) + _unpacked(b, np.uint32).astype(np.uint64))
        wanted = np.concatenate(wanted)
        out = []
        if len(rows) and len(wanted):
            w = Windows(rows.column("text"), width)
            cells = cells_of(w.first)
            take = _member(cells, wanted)[0]
            first, second = w.first[take], w.second[take]
            order = _sorted_pairs(first, second)
            first, second = first[order], second[order]
            new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(first) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            often = np.diff(np.concatenate((starts, [len(first)]))) > 1
            first, second = first[starts], second[starts]
            # The lowest bit of the second hash tells whether the pack itself holds the window again.
            second = (second & ~np.uint64(1)) | often.astype(np.uint64)
            out = [(block, _packed(first[a:z]), _planes(second[a:z])) for block, a, z in _by_block(first, block_bits)]
        return table(out, name[0].as_py(), ["block", "first", "second"], pa.binary())

    def group(name: tuple, rows: pa.Table) -> pa.Table:
        own = [_unpacked(b, np.uint64) for b in rows.column("first").to_pylist()]
        other = [np.frombuffer(b, np.uint64) for b in rows.column("second").to_pylist()]
        sizes = np.array([len(x) for x in own])
        first, second = np.concatenate(own), np.concatenate(other)
        often, second = (second & np.uint64(1)).astype(bool), second & ~np.uint64(1)
        order = _sorted_pairs(first, second)
        a, b = first[order], second[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        run = np.cumsum(new) - 1
        keep = np.empty(len(a), bool)
        keep[order] = ((np.bincount(run) > 1) | (np.bincount(run, weights=often[order]) > 0))[run]
        ends = np.cumsum(sizes)
        packs_, hits, seconds = [], [], []
        for pack, lo, hi in zip(rows.column("pack").to_pylist(), ends - sizes, ends, strict=True):
            k = keep[lo:hi]
            if k.any():
                packs_.append(pack)
                hits.append(_packed(first[lo:hi][k]))
                seconds.append(_planes(second[lo:hi][k]))
        return pa.table([pa.array(packs_, pa.int64()), pa.array([name[0].as_py()] * len(packs_), pa.int64()), pa.array(hits, pa.binary()), pa.array(seconds, pa.binary())], ["pack", "block", "first", "second"])

    def strike(name: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(["key", "carried"]).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("kept", pa.array([], pa.string()))
        w = Windows(rows.column("text"), width)
        blocks = sorted(zip(back.column("block").to_pylist(), range(len(back))))
        firsts, seconds = back.column("first").to_pylist(), back.column("second").to_pylist()
        first = np.concatenate([np.zeros(0, np.uint64), *(_unpacked(firsts[i], np.uint64) for _, i in blocks)])
        second = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(seconds[i], np.uint64) for _, i in blocks)])
        n = len(w.words)
        change = np.zeros(n + 1, np.int64)
        if len(first) and len(w.first):
            mine = w.second & ~np.uint64(1)
            found, near = _member(w.first, first)
            hit = found & (second[near] == mine)
            while (found := found & ~hit).any():  # two windows of the pack share the first hash
                near = np.minimum(near + 1, len(first) - 1)
                found &= (first[near] == w.first) & (near + 1 < len(first))
                hit |= found & (second[near] == mine)
            change[w.at[hit]] += 1
            change[w.at[hit] + width] -= 1
        gone = np.cumsum(change[:n]) > 0
        docs = w.words.docs
        removed = arrowtext.per_row_sum(gone, docs)
        data, bounds = arrowtext.joined(w.words, ~gone)
        kept = arrowtext.binary(data, bounds).cast(pa.string())
        return pa.table([rows.column("key"), rows.column("carried"), pa.array(np.diff(docs)), pa.array(removed), kept], ["key", "carried", "n_words", "n_removed", "kept"])

    by_pack = docs.groupBy("pack")
    sketches = by_pack.applyInArrow(sketch, "pack bigint, block bigint, cells binary, again binary")
    estimated = sketches.groupBy("block").applyInArrow(merge, "pack bigint, block bigint, cells binary")
    chosen = by_pack.cogroup(estimated.groupBy("pack")).applyInArrow(candidates, "pack bigint, block bigint, first binary, second binary")
    repeats = chosen.groupBy("block").applyInArrow(group, "pack bigint, block bigint, first binary, second binary")
    carried_type = docs.schema["carried"].dataType.simpleString()
    out = by_pack.cogroup(repeats.groupBy("pack")).applyInArrow(strike, f"key {kind.simpleString()}, carried {carried_type}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("key", key)
