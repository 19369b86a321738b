"""Near copies: texts whose sets of 5-word shingles have a Jaccard index of 0.8 or more.

Texts with the same set are one class.  Classes that may be near others come
from SimHash, by the covering masks of operator 2 (simhash.groups()): those
whose fingerprints are connected within 3 bits.  Most pairs with an index just
above 0.8 are 4 bits apart and more, and a radius for all of them would take
thousands of masks.  So there also is minhash: 32 keys of 4 minima each, of
which 3 must be shared.  A pair with an index of 0.8 has 13 in common on average,
fewer than 3 with a probability of 1 in 80,000, and less above; of the keys of a
text a quarter of which is a passage of others, 1 in 256 is shared.  A component
of fingerprints is one more key, which needs no others.  Pairs to be checked
exactly come from the centre of each key and, for what that leaves apart, from
the rarest shingles, so a large group of copies isn't compared all to all.

Definitions: words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; a text of fewer than
5 words has all of them as its only shingle.  Shingles are equal when their
64-bit hashes are.  Null and empty texts have the empty set and are copies of
each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, graph, setjoin, simhash, workspace

SHINGLE, KEYS, ROWS, SEED = 5, 32, 4, 43
#: Keys of a class that other classes have too, at least, for it to be looked at.
SHARED_KEYS = 3
#: Shingles of a family up to which one task connects it in memory; it takes some ten times 8 bytes of each. Sets that others are held against there.
FAMILY, STARS = 1 << 20, 32
#: The least Jaccard index, as a fraction.
LEAST = (4, 5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers after which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of the distinct shingles of a column of texts, ascending within a row."""
    raw, rows = arrowtext.buffers(column)
    words = arrowtext.Words(arrowtext.LOWER[raw], rows)
    per_row = np.diff(words.docs)
    made = np.where(per_row == 0, 0, np.maximum(per_row - SHINGLE + 1, 1))
    first = arrowtext.ragged(words.docs[:-1], made)
    left = np.repeat(np.minimum(per_row, SHINGLE), made)
    each = mixed(arrowtext.polynomial(words, SEED))
    hashes = np.zeros(len(first), np.uint64)
    for j in range(SHINGLE):
        here = left > j
        hashes[here] = mixed(hashes[here] + each[first[here] + j] + np.uint64(1))
    row = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(made)))))


def classes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(hashes[a:z].tobytes(), SEED) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.uint64, len(bounds) - 1).view(np.int64)


def keys_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """KEYS 64-bit keys of each non-empty set, a row each."""
    draw = np.random.default_rng(SEED)
    flips, factors = draw.integers(0, 1 << 64, (2, KEYS, ROWS), np.uint64)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), KEYS), np.uint64)
    if len(starts):
        for k in range(KEYS):
            out[:, k] = k
            for flip, factor in zip(flips[k], factors[k], strict=True):
                out[:, k] = mixed(out[:, k] + np.minimum.reduceat((hashes ^ flip) * (factor | np.uint64(1)), starts))
    return out


def prints(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, same, cls, n, keys, fp): a hash of the text, one of its set of shingles, the size of that, its minhash keys and the SimHash fingerprint of the text."""
    kind = df.schema[key].dataType.simpleString()

    @arrowtext.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                hashes, bounds = sets_of(part.column(2))
                n = np.diff(bounds)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, KEYS, 0)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys_of(hashes, bounds).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(classes_of(hashes, bounds)), pa.array(n.astype(np.int64)), keys, pa.array(simhash.fingerprints_of(part.column(2)).view(np.int64))], [key, "same", "cls", "n", "keys", "fp"])

    return df.select(key, F.xxhash64(text).alias("same"), text).mapInArrow(run, f"`{key}` {kind}, same bigint, cls bigint, n bigint, keys array<bigint>, fp bigint")


def sets(df: DataFrame, text: str) -> DataFrame:
    """(cls, elements) of every row: its shingles."""

    @arrowtext.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                hashes, bounds = sets_of(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(classes_of(hashes, bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["cls", "elements"])

    return df.select(text).mapInArrow(run, "cls bigint, elements array<bigint>")


def fingerprint_keys(rows: DataFrame) -> DataFrame:
    """(k, cls, n, met) of classes, from prints(), whose fingerprints are connected to those of others: k names the component, met are its classes."""
    marked = workspace.written(rows.where("n > 0").groupBy("fp", "cls").agg(F.first("n").alias("n")), "marked")
    prints = workspace.written(marked.groupBy("fp").agg(F.count("*").alias("marks")), "fingerprints")
    parts = simhash.groups(prints.select("fp")).withColumnRenamed("node", "fp")
    named = prints.join(parts, "fp", "left").select("fp", "marks", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("k"))
    total = marked.count()
    each = workspace.lookup(marked, workspace.written(named, "named"), ["fp"], "marks", total).select("k", "cls", "n").distinct()
    each = workspace.written(each, "fingerprint-keys")
    shared = each.groupBy("k").agg(F.count("*").alias("met")).where("met > 1")
    return workspace.written(workspace.lookup(each, workspace.written(shared, "shared"), ["k"], "met", total).select("k", "cls", "n", "met"), "fingerprint-keys")


def links(df: DataFrame, classes: DataFrame, marks: DataFrame, text: str, key: str) -> DataFrame:
    """Pairs (a, b) of classes that connect what pairs with an index of LEAST or more connect.

    marks: fingerprint_keys().  Classes that share keys, directly or over others, are a family.  A family of
    up to FAMILY shingles is one task's work (family_links()), a larger one is
    spread over all (spread_links()).
    """
    total = classes.count() * KEYS
    each = classes.select(F.explode("keys").alias("k"), "cls", "n")
    shared = workspace.written(each.groupBy("k").agg(F.count("*").alias("met")).where("met > 1"), "shared")
    level = workspace.lookup(each, shared, ["k"], "met", total).select("k", "cls", "n", "met", F.lit(False).alias("alone"))
    level = workspace.written(level.unionByName(marks.withColumn("alone", F.lit(True))), "candidates")
    enough = F.col("alone") | (F.col("keys") >= SHARED_KEYS)
    met = level.groupBy("cls").agg(F.sum("met").alias("popular"), F.count_if(~F.col("alone")).alias("keys"), F.max("alone").alias("alone")).where(enough)
    met = workspace.written(met.select("cls", "popular", "keys"), "met")
    level = workspace.written(level.join(met, "cls").where(enough).select("k", "cls", "n", "met", "popular"), "candidates")
    # The class of each key that shares most with others: in a group of copies that is the text they stem from.
    centre = level.groupBy("k").agg(F.max(F.struct("popular", "cls")).getField("cls").alias("centre"), F.count("*").alias("met"))
    near = workspace.lookup(level.drop("met"), workspace.written(centre, "centres"), ["k"], "met", total)
    near = workspace.written(near.select("cls", "n", "centre", "popular").distinct(), "near")
    family = graph.components(near.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("node", "cls")
    family = workspace.written(near.select("cls", "n", "popular").distinct().join(family, "cls"), "families")
    sizes = family.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("members"))
    family = workspace.written(workspace.lookup(family, workspace.written(sizes, "sizes"), ["component"], "members", family.count()), "families")
    # One row of each class is read again.
    who = family.join(classes.select("cls", "key", "same"), "cls").select(F.col("cls").alias("of"), "key", "same", "component", "popular", "size")
    who = workspace.written(who, "read-again")
    asked = workspace.small(who, 64)
    asked = (who if asked is None else asked).select("key", "same")
    again = df.join(asked, (F.xxhash64(text) == asked["same"]) & F.col(key).eqNullSafe(asked["key"]), "left_semi")
    held = workspace.written(sets(again, text).dropDuplicates(["cls"]), "shingles")
    held = held.join(who.withColumnRenamed("of", "cls"), "cls").select("component", "cls", "popular", "size", "elements")
    small = held.where(F.col("size") <= FAMILY).select("component", "cls", "popular", "elements").groupBy("component").applyInArrow(family_links, "a bigint, b bigint")
    small = workspace.written(small, "links")
    large = workspace.written(family.where(F.col("size") > FAMILY).select("cls"), "large")
    if large.isEmpty():
        return small
    few = lambda t: t.join(large, "cls", "left_semi")
    return small.unionByName(spread_links(few(level), few(near), few(held.select("cls", "elements")), total))


def family_links(rows: pa.Table) -> pa.Table:
    """Pairs (a, b) that connect a family's near classes, from (cls, popular, elements), all in memory.

    Sets are held against the most popular one and what it meets is connected,
    then the same among the others as long as it connects any; of what is left
    apart, those meet that share one of the rarest elements that a near pair
    has to share.
    """
    names, popular = rows.column("cls").to_numpy(), rows.column("popular").to_numpy()
    lists = rows.column("elements").combine_chunks()
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    flat = lists.flatten().to_numpy()
    n, count = np.diff(at), len(names)
    owner = np.repeat(np.arange(count), n)
    part, pairs = np.arange(count), []

    def overlap(i: int) -> np.ndarray:
        return np.bincount(owner[np.isin(flat, flat[at[i] : at[i + 1]])], minlength=count)

    def connect(i: int, others: np.ndarray) -> None:
        for j in others[part[others] != part[i]].tolist():
            pairs.append((i, j))
            part[part == part[j]] = part[i]

    alone = np.ones(count, bool)
    for _ in range(STARS):
        if alone.sum() < 2:
            break
        i = int(np.flatnonzero(alone)[np.argmax(popular[alone])])
        both = overlap(i)
        connect(i, np.flatnonzero(both * sum(LEAST) >= LEAST[0] * (n + n[i])))
        alone &= part != part[i]
    if len(np.unique(part)) > 1:
        for i, j in _rare_pairs(flat, owner, at, part):
            if part[i] != part[j]:
                both = len(np.intersect1d(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], assume_unique=True))
                if both * sum(LEAST) >= LEAST[0] * (n[i] + n[j]):
                    connect(i, np.array([j]))
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table([pa.array(names[ends[:, 0]]), pa.array(names[ends[:, 1]])], ["a", "b"])


def _rare_pairs(flat: np.ndarray, owner: np.ndarray, at: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of sets of different parts (which may change meanwhile) among which all near ones are: setjoin.rare_pairs() in memory."""
    x, y = LEAST
    n = np.diff(at)
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((number, often[number], owner))
    token, rank = number[order], np.arange(len(flat)) - np.repeat(at[:-1], n) + 1
    size = np.repeat(n, n)
    ceil = lambda a, b: -(-a // b)
    common = often[token] > 1
    wide = int(n.max()) + 1
    # The index: of each token, the sets that have it early enough, by size.
    kept = np.flatnonzero(common & (rank <= size - ceil(2 * x * size, x + y) + 1))
    kept = kept[np.argsort(token[kept] * wide + size[kept], kind="stable")]
    place, held = token[kept] * wide + size[kept], owner[kept]
    left = size[kept] - rank[kept]  # elements after the token
    asks = np.flatnonzero(common & (rank <= size - ceil(x * size, y) + 1))
    most = np.minimum(size[asks], (1 + size[asks] - rank[asks]) * (x + y) // x - size[asks])
    low = np.searchsorted(place, token[asks] * wide + ceil(x * size[asks], y), "left")
    high = np.searchsorted(place, token[asks] * wide + most, "right")
    tried = set()
    for k in np.flatnonzero(high > low).tolist():
        i, after = int(owner[asks[k]]), int(size[asks[k]] - rank[asks[k]])
        others = held[low[k] : high[k]]
        enough = (1 + np.minimum(after, left[low[k] : high[k]])) * (x + y) >= (n[i] + n[others]) * x
        for j in others[enough & (part[others] != part[i])].tolist():
            pair = (min(i, j), max(i, j))
            if pair not in tried:
                tried.add(pair)
                yield pair


def spread_links(level: DataFrame, near: DataFrame, shingles: DataFrame, total: int) -> DataFrame:
    """links() of large families: each class against the centres of its keys; what that leaves apart by the rarest shingles (setjoin.rare_pairs)."""
    shingles, level = workspace.written(shingles, "shingles"), workspace.written(level, "candidates")
    stars = near.where("cls <> centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    stars = workspace.written(stars, "stars")
    found = workspace.written(setjoin.checked(stars, shingles, LEAST).select("a", "b"), "links")
    parts = graph.components(found).withColumnRenamed("node", "cls")
    state = workspace.written(level.join(parts, "cls", "left").select("k", "cls", "n", F.coalesce("component", "cls").alias("part")), "state")
    apart = state.groupBy("k").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("met")).where("p < q").select("k", "met")
    open_ = workspace.lookup(state, workspace.written(apart, "apart"), ["k"], "met", total).select("cls", "part", "n").distinct()
    rest = setjoin.rare_pairs(workspace.written(open_, "open"), shingles, LEAST).join(stars, ["a", "b"], "left_anti")
    return found.unionByName(workspace.written(setjoin.checked(workspace.written(rest, "rest"), shingles, LEAST).select("a", "b"), "links"))


def components(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, same, cls, component) of every row: component is a class of the group of near copies that the row's class belongs to."""
    rows = workspace.written(prints(df, text, key), "prints")
    one = F.min(F.struct(F.col("same"), F.col(key).alias("key"))).alias("one")
    classes = rows.groupBy("cls").agg(one, F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    classes = workspace.written(classes.select("cls", "one.*", "n", "keys", "rows"), "classes")
    parts = graph.components(links(df, classes, fingerprint_keys(rows), text, key)).withColumnRenamed("node", "cls")
    names = classes.select("cls", "rows").join(parts, "cls", "left").select("cls", "rows", F.coalesce("component", "cls").alias("component"))
    return workspace.lookup(rows.select(key, "same", "cls"), workspace.written(names, "names"), ["cls"], "rows", rows.count()).select(key, "same", "cls", "component")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: the smallest key, null after all others, then the smallest hash of the text; one of equal rows."""
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("same"))
    rows = workspace.written(components(df, text, key).groupBy("component", key, "same").agg(F.count("*").alias("n")).withColumn("who", who), "groups")
    first = rows.groupBy("component").agg(F.min("who").alias("first"), F.sum("n").alias("all"), F.count("*").alias("members")).where("all > 1")
    met = workspace.lookup(rows, workspace.written(first, "firsts"), ["component"], "members", rows.count())
    # Rows are named by their key, as a text, and the hash of their text.
    name = {"_none": F.col(key).isNull(), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))}
    met = met.withColumns(name).select("_none", "_key", F.col("same").alias("_same"), "n", (F.col("who") == F.col("first")).alias("stays"))
    met = workspace.written(met, "met")
    on, total = ["_none", "_key", "_same"], df.count()
    named = df.withColumns(name | {"_same": F.xxhash64(text)})
    gone, again = (workspace.written(met.where(f).select(*on, "n"), "decided") for f in ("NOT stays OR n > 1", "stays AND n > 1"))
    size = F.octet_length("_key") + 64
    few = workspace.small(gone, size)  # texts stay where they are
    out = workspace.without(named, gone, on, "n", total) if few is None else named.join(few.select(*on), on, "left_anti")
    few = workspace.small(again, size)
    again = workspace.lookup(named, again, on, "n", total) if few is None else named.join(few.select(*on), on, "left_semi")
    return out.select(*df.columns).unionByName(again.select(*df.columns).dropDuplicates([key, text]))
