"""SpotSigs document fingerprints (operator 3).

An anchor is a common word; its signature is the chain of the next CHAIN
content words (those that aren't anchors).  The fingerprint of a text is the
sorted set of its signatures, 32 bits each.  A text without any signature has
one of all its words; a text without words has none.  The likeness of two
fingerprints is the Jaccard similarity of the sets; two empty ones are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, setjoin, workspace

CHAIN = 3

#: Fixed common words of four languages.
ANCHORS = (
    "the a an of and to in is was it that for on with as at by be are this from or he they have not "
    "der die das und ein eine in zu den von mit ist im für auf nicht sich des dem als auch es an "
    "le la les un une de des du et est dans que qui pour sur pas par avec au en il elle ne se ce "
    "el los las una del y es por con para no lo su al como más o pero sus"
).split()

_separators = np.ones(256, bool)
_separators[128:] = False
_separators[[*range(48, 58), *range(97, 123)]] = False
_M = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: arrowtext.Words) -> np.ndarray:
    x = arrowtext.polynomial(words, 7)
    return (x ^ (x >> np.uint64(32))) * _M


def _anchors() -> np.ndarray:
    column = pa.array(ANCHORS)
    return np.sort(_hashes(arrowtext.Words(*arrowtext.buffers(column), _separators)))


def signatures(column: pa.Array) -> np.ndarray:
    """Sorted numbers row * 2^32 + signature, each once."""
    raw, rows = arrowtext.buffers(column)
    words = arrowtext.Words(arrowtext.LOWER[raw], rows, _separators)
    if not len(words):
        return np.zeros(0, np.uint64)
    h = _hashes(words)
    known = _anchors()
    anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    row = np.searchsorted(words.docs, at, "right") - 1
    nxt = np.searchsorted(content, at)
    fits = nxt + CHAIN <= len(content)
    at, row, nxt = at[fits], row[fits], nxt[fits]
    fits = content[nxt + CHAIN - 1] < words.docs[row + 1] if len(nxt) else np.zeros(0, bool)
    at, row, nxt = at[fits], row[fits], nxt[fits]
    x = h[at]
    for k in range(CHAIN):
        x = (x ^ (x >> np.uint64(29))) * _M + h[content[nxt + k]]
    x = (x ^ (x >> np.uint64(32))) * _M
    # Rows with words, but without signatures: one of all words.
    n = len(rows) - 1
    bare = np.flatnonzero((np.bincount(row, minlength=n) == 0) & (np.diff(words.docs) > 0))
    place = (h + np.arange(len(h), dtype=np.uint64) - np.repeat(words.docs[:-1], np.diff(words.docs)).astype(np.uint64)) * _M
    whole = np.array([np.bitwise_xor.reduce(place[words.docs[b] : words.docs[b + 1]] ^ (place[words.docs[b] : words.docs[b + 1]] >> np.uint64(31))) for b in bare], np.uint64)
    key = np.concatenate((row, bare)).astype(np.uint64) << np.uint64(32) | np.concatenate((x, whole)) >> np.uint64(32)
    return arrowtext.distinct_sorted(np.sort(key))


def per_row(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the signatures of each of n rows begin, and the end."""
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def hex_sets(keys: np.ndarray, n: int) -> list[str]:
    at, low = per_row(keys, n), (keys & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [low[a:z].tobytes().hex() for a, z in zip(at[:-1], at[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard similarity of the sets of each row."""
    both = np.sort(np.concatenate((a, b)))
    shared = np.diff(per_row(both[1:][both[1:] == both[:-1]], n))
    union = np.diff(per_row(a, n)) + np.diff(per_row(b, n)) - shared
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row: hexadecimal, 8 digits a signature, ascending. Null counts as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hex_sets(signatures(part.column(1)), len(part)), pa.string())], [key, "fingerprint"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def similar_pairs(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(links (a, b, likeness) between class representatives, membership (key, representative)).

    Rows with equal fingerprints are a class, named by its smallest key.
    Classes are partitioned by bands of set length and meet by their rarest
    signatures, as far as the threshold makes them a must (setjoin.rare_pairs);
    what meets is compared exactly.  Empty fingerprints are a class without
    links; a class of null keys only has a null name.
    """
    least = Fraction(threshold).limit_denominator(1000)
    classes = prints.groupBy("fingerprint").agg(F.min(key).alias("rep"), F.count("*").alias("rows"))
    classes = workspace.written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = workspace.lookup(prints.select(key, "fingerprint"), classes.drop("cls"), ["fingerprint"], "rows", prints.count()).select(key, F.col("rep").alias("representative"))
    n = (F.length("fingerprint") / 8).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr("fingerprint", i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    sets = workspace.written(classes.where("fingerprint <> ''").select("cls", each.alias("elements")), "sets")
    pairs = setjoin.rare_pairs(sets.select("cls", F.col("cls").alias("part"), F.size("elements").cast("long").alias("n")), sets, (least.numerator, least.denominator))
    links = setjoin.checked(workspace.written(pairs, "pairs"), sets, (least.numerator, least.denominator))
    one, other = (classes.select(F.col("cls").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    links = links.join(one, "a").join(other, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "likeness")
    return links, members


#: Bytes of text in a range of keys, on average.
RANGE_BYTES = 32 << 20


def places(df: DataFrame) -> DataFrame:
    """(d, h, copies, size) of every distinct place in the order of rows (d, h, t): no texts, and a place with many rows counts as one."""
    return df.select("d", "h", F.octet_length("t").alias("size")).groupBy("d", "h").agg(F.count("*").alias("copies"), F.max("size").alias("size"))


def ranges(found: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place (d, h) of each of the ranges that places() are cut into, ascending; one entry for each range is all that the driver gets."""
    size = found.agg(F.sum("size")).first()[0] or 0
    n = max(least, -(-size // RANGE_BYTES))
    cut = found.select("d", "h").repartitionByRange(n, "d", "h").withColumn("part", F.spark_partition_id())
    firsts = cut.groupBy("part").agg(F.min(F.struct("d", "h")).alias("first")).select("first.d", "first.h").orderBy("d", "h").toPandas()
    return firsts["d"].to_numpy(np.int64), firsts["h"].to_numpy(np.int64)


def range_of(d: np.ndarray, h: np.ndarray, first_d: np.ndarray, first_h: np.ndarray) -> np.ndarray:
    """The number of the last range that begins at or before each place, by binary search; -1 before all."""
    low, high = np.searchsorted(first_d, d, "left"), np.searchsorted(first_d, d, "right")
    out = low - 1
    for i in np.flatnonzero(high > low).tolist():  # ranges begin with this key: the hash decides
        out[i] = low[i] + np.searchsorted(first_h[low[i] : high[i]], h[i], "right") - 1
    return out


def probe(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next smaller key, after the smallest
    the largest; rows with equal keys follow each other by a hash of their
    text, null keys come last.  Rows that are equal in key and text have one
    place in this order, so they have the same next document and equal results;
    such places with very many rows are worked on once.  Rows are dealt into
    ranges of places; a range also gets the first row of the next one.
    """
    spark = df.sparkSession
    lowest = -(1 << 63)
    order = F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(lowest)))  # ascending where keys descend
    rows = df.select(F.col(key).alias("k"), order.alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    found = workspace.written(places(rows), "places")
    first_d, first_h = ranges(found, int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = len(first_d)
    # Heavy places are few, as each has its share of all rows.
    limit = max(workspace.LEAST, int((found.agg(F.sum("copies")).first()[0] or 0) * workspace.SHARE))
    heavy = F.broadcast(found.where(F.col("copies") > limit).select("d", "h", "copies"))
    once = rows.join(heavy, ["d", "h"]).groupBy("d", "h").agg(F.first("k").alias("k"), F.first("t").alias("t"), F.first("copies").alias("copies"))
    rows = rows.join(heavy, ["d", "h"], "left_anti").select("k", "d", "h", "t", F.lit(1).cast("long").alias("copies")).unionByName(once)

    @F.pandas_udf("struct<own int, also int>")
    def dealt_to(d: pd.Series, h: pd.Series) -> pd.DataFrame:
        d, h = d.to_numpy(np.int64), h.to_numpy(np.int64)
        own = np.maximum(range_of(d, h, first_d, first_h), 0)
        begins = (first_d[own] == d) & (first_h[own] == h) if count else np.zeros(len(d), bool)
        return pd.DataFrame({"own": own.astype(np.int32), "also": np.where(begins, (own - 1) % max(count, 1), -1).astype(np.int32)})

    dealt = rows.withColumn("place", dealt_to("d", "h"))
    both = F.array(F.struct(F.col("place.own").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("place.also").alias("to"), F.lit(1).alias("guest")))
    dealt = dealt.select("k", "d", "h", "t", "copies", F.inline(both)).where("to >= 0")
    dealt = dealt.repartition(max(count, 1), "to").sortWithinPartitions("to", "guest", "d", "h").select("k", "d", "h", "to", "guest", "copies", "t")
    kind = df.schema[key].dataType
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @arrowtext.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[list], keys: pa.DataType) -> Iterator[pa.RecordBatch]:
            """The rows of all places but the last, each with the place after it."""
            texts = [t for _, t, _, _ in held]
            own = [(t, len(t) // 3) for t in texts[:-1]]
            edited = [t[: len(t) - k] + after[:k] for (t, k), after in zip(own, texts[1:], strict=True)]
            n = len(own)
            mine, theirs = signatures(pa.array(texts, pa.string())), signatures(pa.array(edited, pa.string()))
            cut = per_row(mine, n + 1)
            following = mine[cut[1] :] - (np.uint64(1) << np.uint64(32))
            mine = mine[: cut[n]]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _, _ in held[:-1]], keys),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(hex_sets(mine, n), pa.string()),
                    pa.array(hex_sets(theirs, n), pa.string()),
                    pa.array(likeness(mine, theirs, n)),
                    pa.array(likeness(mine, following, n)),
                ],
                names,
            )
            copies = np.array([c for _, _, c, _ in held[:-1]], np.int64)
            yield out
            for i in np.flatnonzero(copies > 1).tolist():  # the other rows of a place, a thousand at a time
                for low in range(1, int(copies[i]), 1000):
                    yield out.take(pa.array([i] * min(1000, int(copies[i]) - low)))

        held: list[list] = []  # [key, text, copies, place] of one range, in order
        at, closed, size = None, False, 0
        for batch in batches:
            keys = batch.schema.field(0).type
            for k, d, h, to, guest, copies, t in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if to != at:
                    at, closed, held, size = to, False, [], 0
                if closed:
                    continue
                if held and not guest and held[-1][3] == (d, h):
                    held[-1][2] += copies
                    continue
                if size > arrowtext.PIECE_BYTES // 2 and len(held) > 1:
                    yield from made(held, keys)
                    held, size = held[-1:], len(held[-1][1])
                held.append([k, t, copies, (d, h)])
                size += len(t)
                if guest:
                    closed = True
                    yield from made(held, keys)

    return dealt.mapInArrow(run, f"`{key}` {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
