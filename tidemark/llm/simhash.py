"""SimHash near-duplicates (operator 2).

Fingerprints of 64 bits are linked when they differ in at most 3.  Candidates
come from covering locality-sensitive hashing: each bit position gets a vector
of 4 bits, and each of the 15 non-zero vectors v makes a mask of the positions
whose vector has an odd product with v.  Positions of 3 differing bits span at
most 3 of 4 dimensions, so some mask leaves all of them out: every pair within
the radius agrees under at least one mask.

Components are what is asked for, so a bucket isn't compared all to all: its
fingerprints are linked to a few centres, and only what these links leave in
different components is looked at further (groups()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, graph, workspace

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Fingerprints of a bucket outside its largest component, up to which they are compared with all of it.
SMALL = 24
#: Bits that are flipped before the smallest fingerprint of a bucket is taken as a centre. Others change the work, not the result.
CENTRES = (0, 0x5A3C_96E1_0F87_D24B)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as unsigned integers. The vectors of positions go round, zero left out."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a column of texts."""
    raw, rows = arrowtext.buffers(column)
    words = arrowtext.Words(arrowtext.LOWER[raw], rows)
    # Words of all rows, each followed by a blank: a shingle is a slice without its last blank.
    n = len(words)
    lengths = np.diff(words.offsets)
    spaced = np.full(len(words.data) + n, 32, np.uint8)
    starts = words.offsets[:-1] + np.arange(n)
    spaced[arrowtext.ragged(starts, lengths)] = words.data
    ends = starts + lengths
    data = spaced.tobytes()
    per_row = np.diff(words.docs)
    made = np.where(per_row == 0, 0, np.maximum(per_row - SHINGLE + 1, 1))
    first = arrowtext.ragged(words.docs[:-1], made)
    last = first + np.repeat(np.minimum(per_row, SHINGLE) - 1, made)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:z], SEED) for a, z in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(len(rows) - 1, np.uint64)
    bounds = np.concatenate(([0], np.cumsum(made)))
    ones = np.zeros((len(out), BITS), np.int64)
    step = 1 << 16  # bits of so many hashes at a time
    for a in range(0, len(hashes), step):
        z = min(len(hashes), a + step)
        bits = np.unpackbits(hashes[a:z].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, z, "left")
        cuts = np.clip(bounds[i:j], a, None) - a
        filled = np.flatnonzero(np.diff(np.concatenate((cuts, [z - a]))) > 0)
        ones[i + filled] += np.add.reduceat(bits, cuts[filled], axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * ones > made[:, None], axis=1, bitorder="little")
    return set_bits.view(np.uint64).reshape(-1) if len(out) else out


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp bigint) of every row."""
    kind = df.schema[key].dataType.simpleString()

    @arrowtext.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1)).view(np.int64))], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def finer(mask: Column) -> Column:
    """The masks that add to `mask` one of RADIUS + 1 blocks of its open bits (those that hold any)."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    open_bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: mask.bitwiseAND(bit(i)) == 0)
    block = lambda k: F.aggregate(F.filter(open_bits, lambda _, at: at % (RADIUS + 1) == k), mask, lambda m, i: m.bitwiseOR(bit(i)))
    return F.filter(F.array(*map(block, range(RADIUS + 1))), lambda m: m != mask)


def groups(prints: DataFrame) -> DataFrame:
    """(node, component) of each fingerprint that is linked to another one, from a table with distinct `fp`: the smallest one it is reachable from.

    Every link counts, but those inside a group that is known to be connected
    aren't looked for.  Each bucket first links its fingerprints to CENTRES of
    them, where they are near enough.  A bucket whose fingerprints then are in
    one component is done.  If all but SMALL of them are in one, these few are
    compared with all.  Other buckets are cut by the pigeonhole: the open bits
    make RADIUS + 1 blocks, one of which must agree too.  Open bits get fewer
    each time, and without any a bucket holds one fingerprint, so this ends.
    """
    near = lambda a, b: (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS)
    edge = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    first = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for m in masks()))
    level, parts = prints.select("fp", F.inline(first)), None
    while True:
        level = workspace.written(level, "buckets")
        # A centre is the smallest fingerprint after some bits are flipped.
        centres = [F.min(F.col("fp").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)).alias(f"c{i}") for i, c in enumerate(CENTRES)]
        crowded = workspace.written(level.groupBy("mask", "part").agg(F.count("*").alias("n"), *centres).where("n > 1"), "crowded")
        met = workspace.written(workspace.lookup(level, crowded, ["mask", "part"], "n", level.count()), "met")
        if met.isEmpty():
            break
        stars = met.select("fp", F.explode(F.array(*(f"c{i}" for i in range(len(CENTRES))))).alias("c")).where(near("fp", "c")).select(*edge("fp", "c")).distinct()
        parts = workspace.written(graph.components(_and(stars, parts)), "parts")
        state = met.select("fp", "mask", "part", "n").join(parts, met["fp"] == parts["node"], "left").select("fp", "mask", "part", "n", F.coalesce("component", "fp").alias("component"))
        state = workspace.written(state, "state")
        each = state.groupBy("mask", "part", "component").agg(F.count("*").alias("k"))
        unsettled = each.groupBy("mask", "part").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("most")).where("most.k < n")
        rest = F.col("n") - F.col("most.k")
        unsettled = unsettled.select("mask", "part", "n", F.col("most.component").alias("most"), F.when(rest > SMALL, finer(F.col("mask"))).alias("finer"))
        unsettled = workspace.written(unsettled, "unsettled")
        rows = workspace.lookup(state.drop("n"), unsettled, ["mask", "part"], "n", state.count())
        rows = workspace.written(rows, "unsettled-rows")
        # At most SMALL fingerprints of a bucket are gathered.
        few = rows.where("finer IS NULL AND component <> most").groupBy("mask", "part").agg(F.max("n").alias("n"), F.collect_list(F.struct(F.col("fp").alias("other"), F.col("component").alias("apart"))).alias("few"))
        few = workspace.written(few, "few")
        pairs = workspace.lookup(rows.where("finer IS NULL").select("fp", "component", "mask", "part"), few, ["mask", "part"], "n", rows.count())
        pairs = pairs.select("fp", "component", F.inline("few")).where((F.col("component") != F.col("apart")) & near("fp", "other")).select(*edge("fp", "other")).distinct()
        pairs = workspace.written(pairs, "pairs")
        if not pairs.isEmpty():
            parts = workspace.written(graph.components(_and(pairs, parts)), "parts")
        level = rows.where("finer IS NOT NULL").select("fp", F.explode("finer").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part")).distinct()
    return parts if parts is not None else prints.sparkSession.createDataFrame([], "node bigint, component bigint")


def _and(edges: DataFrame, parts: DataFrame | None) -> DataFrame:
    return edges if parts is None else edges.unionByName(parts.selectExpr("component AS a", "node AS b").where("a <> b"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    fingerprint: 16 hex digits.  component_id: the smallest key that is
    reachable over fingerprints within the radius (equal ones included).  Null
    and empty texts have the fingerprint zero and are linked like any other;
    null keys never are a component's name unless it has no other.
    """
    prints = workspace.written(fingerprints(df, text, key), "fingerprints")
    classes = workspace.written(prints.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n")), "classes")
    parts = groups(classes.select("fp"))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("part"))
    named = workspace.written(named, "parts")
    lows = workspace.written(named.groupBy("part").agg(F.min("low").alias("component_id"), F.count("*").alias("classes")), "lows")
    table = workspace.lookup(named, lows, ["part"], "classes", named.count()).select("fp", "n", "component_id")
    out = workspace.lookup(prints, workspace.written(table, "names"), ["fp"], "n", prints.count())
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
