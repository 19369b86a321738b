"""Benchmark decontamination by winnowing (operator 10).

DataFrame functions only.  A benchmark window is WINDOW consecutive words of an
item; an item of fewer words, but not none, is one window.  Words of K-grams
are hashed; of every run of WINDOW-K+1 consecutive hashes the smallest is kept,
so two texts that share WINDOW words share a kept hash.  Documents whose kept
hashes meet the benchmark's are looked at again: hits are extended to all
windows over them, and these are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import workspace

WINDOW, K = 10, 5
#: Bytes up to which a side is broadcast, added up first. Beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Fixed values of the contract: what separates words (A-Z, which are lower-cased, don't).
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: an expression inside a lambda would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def split(text: Column) -> Column:
    """Words of a text as they are written; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; other letters stay. Only words beyond ASCII need the slow way."""
    lower = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(split(text), lower)


def grams(of: Column, n: int) -> Column:
    """Hashes of n consecutive words, in order. of: a column or lambda variable, no expression."""
    size = F.size(of)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(of, i, n)))).otherwise(F.array().cast("array<bigint>"))


def winnowed(of: Column, n: int, span: int) -> Column:
    """Of the hashes of n consecutive words, the smallest of each `span` consecutive ones (of all, if they are fewer), once each."""

    def kept(hashes: Column) -> Column:
        size = F.size(hashes)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size - (span - 1), F.lit(1))), lambda i: F.array_min(F.slice(hashes, i, span)))
        return F.when(size > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return let(of, lambda w: let(grams(w, n), kept))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df, a written table, marked for broadcast if the sizes of its rows add up to BROADCAST_BYTES at most."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns named in `carry`, n_words, n_hit, n_items, items) of every row of documents.

    n_hit: words inside any occurrence of a benchmark window.  items: the ids,
    as strings and sorted, of items with an occurring window.  Null and empty
    texts have no words.  Rows are told apart by key and text; equal rows get
    equal results, null keys too.
    """
    none = F.array().cast("array<string>")
    kept = [F.col(c).alias(f"carried_{c}") for c in carry]
    out = [F.col("k").alias(key), *(F.col(f"carried_{c}").alias(c) for c in carry if c != key)]
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"), *kept)
    sizes = docs.select("k", "h", F.size(split(F.col("text"))).cast("long").alias("n_words"), *(f"carried_{c}" for c in carry))
    # Every window of the benchmark once, with a number; whose it is stays apart.
    cut = workspace.written(benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0), "items")
    wide = F.least(F.size("w"), F.lit(WINDOW))
    said = cut.select("item", wide.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - wide + 1), lambda i: F.slice("w", i, wide))).alias("said")).distinct()
    said = workspace.written(said, "said")
    windows = workspace.written(said.select("n", "said").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW values
    if not lengths:
        zero = F.lit(0).cast("long")
        return sizes.select(*out, "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items"))
    owners = said.join(windows, ["n", "said"]).select("window", "item")

    # Windows of K words and more are winnowed by K-grams over runs that fit the shortest of them, which is
    # denser than the longer ones need; of shorter windows every gram of their length is a print.
    spans = {n: 1 for n in lengths if n < K}
    if lengths[-1] >= K:
        spans[K] = min(n for n in lengths if n >= K) - K + 1

    def prints(of: Column, only: Column | None = None) -> Column:
        """(gram length, hash) of a text's prints; only: the single length to make prints of."""
        tagged = lambda k: lambda g: F.struct(F.lit(k).alias("k_gram"), g.alias("g"))
        each = [F.transform(winnowed(of, k, span), tagged(k)) for k, span in spans.items()]
        if only is not None:
            each = [F.when(only == k, x).otherwise(F.slice(x, 1, 0)) for (k, _), x in zip(spans.items(), each, strict=True)]
        return F.concat(*each)

    asked = windows.select(F.inline(prints(F.col("said"), F.least("n", F.lit(K)))))
    asked = _small(workspace.written(asked.distinct(), "prints"), F.lit(16))
    held = docs.select("k", "h", F.inline(let(words(F.col("text")), lambda w: prints(w))))
    met = held.join(asked, ["k_gram", "g"]).groupBy("k", "h").agg(F.collect_set(F.struct("k_gram", "g")).alias("met"))
    met = workspace.written(met, "met")

    # Documents that share a hash, again: all windows over the shared hashes, word by word.
    d, m = docs.alias("d"), _small(met, F.size("met") * 16 + 32).alias("m")
    again = d.join(m, F.expr("d.k <=> m.k AND d.h <=> m.h")).selectExpr("d.k", "d.h", "d.text", "m.met").dropDuplicates(["k", "h"])
    again = workspace.written(again.select("k", "h", words(F.col("text")).alias("w"), "met"), "again")

    def starts(w: Column, shared: Column, n: int) -> Column:
        """(at, n, words) of the windows of n words over the shared hashes."""
        k = min(K, n)
        mine = F.transform(F.filter(shared, lambda x: x["k_gram"] == k), lambda x: x["g"])
        last = F.size(w) - (n - 1)  # where the last window begins
        hits = lambda g, wanted: F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(wanted, x), i + 1)), lambda i: i.isNotNull())
        around = lambda i: F.filter(F.sequence(i - (n - k), i), lambda s: (s >= 1) & (s <= last))
        at = let(mine, lambda wanted: let(grams(w, k), lambda g: F.array_distinct(F.flatten(F.transform(hits(g, wanted), around)))))
        return F.transform(at, lambda s: F.struct(s.alias("at"), F.lit(n).alias("n"), F.slice(w, s, n).alias("said")))

    tried = again.select("k", "h", F.inline(F.concat(*(starts(F.col("w"), F.col("met"), n) for n in lengths))))
    hits = tried.join(_small(windows, F.octet_length(F.array_join("said", " ")) + 64), ["n", "said"]).select("k", "h", "at", "n", "window")
    hits = workspace.written(hits, "hits")
    # Words under the hits: each hit adds those beyond the furthest word that hits before it cover.
    before = Window.partitionBy("k", "h").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("at") + F.col("n")
    fresh = F.greatest(ends - F.greatest(F.coalesce(F.max(ends).over(before), F.lit(0)), F.col("at")), F.lit(0))
    covered = hits.select("k", "h", "window", fresh.alias("fresh")).groupBy("k", "h")
    covered = covered.agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.collect_set("window")).alias("of"))
    covered = workspace.written(covered, "covered")
    # Documents with the same windows have the same items, which are put together once.
    combined = workspace.written(covered.groupBy("of").agg(F.count("*").alias("documents")), "combined")
    items = combined.select("of", F.explode("of").alias("window")).join(owners, "window").groupBy("of").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = workspace.written(combined.join(items, "of"), "combined-items")
    found = workspace.written(workspace.lookup(covered, items, ["of"], "documents", covered.count()).drop("of", "documents"), "found")
    s, f = sizes.alias("s"), _small(found, F.octet_length(F.array_join("items", " ")) + 64).alias("f")
    got = s.join(f, F.expr("s.k <=> f.k AND s.h <=> f.h"), "left").select("s.*", "f.n_hit", "f.items")
    return got.select(*out, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """find() with the items as a digest of their comma-joined ids, and whether there is any hit."""
    return found.select(key, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB SQL for digest(find(documents, benchmark)).
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS said
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, said)),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
