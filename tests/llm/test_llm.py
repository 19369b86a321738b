import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import arrowtext, bpe, chat, decontam, graph, nearcopies, orcstore, queries, ring, simhash, spotsigs, substring, tokencount, toxicity, workspace

BPE = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string, kept int"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same text here now"), (5, "same text here now"), (5, "same text here now"), (None, "no id Ünï 中文 <|endoftext|> x"), (7, "w " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(odd, none):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(BPE), bpe.codec(BPE)
    rng = random.Random(1)
    letters = ["a", "'", "s", "ll", " ", "  ", "\n", "\r\n", "1", "²", "é", "中", " ", "\x1c", "!!", "<|endoftext|>", "😀", "̀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 5000, "".join(rng.choice("abcdefghij") for _ in range(9000)), "é" * 3000, " " * 2000, None]
    ids, at = c.encode(pa.array(texts))
    back, ends = c.decode(ids, at)
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids
        assert back[ends[i] : ends[i + 1]].tobytes().decode() == (x or "")
    assert bpe.round_trip_digests(odd, BPE).count() == len(ODD) and bpe.round_trip_digests(none, BPE).count() == 0
    twice = bpe.decode(bpe.encode(odd, BPE), BPE).collect()
    assert sorted(r["text"] for r in twice) == sorted(t or "" for _, t in ODD)


def test_long_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(BPE), random.Random(11)
    long = "".join(rng.choice("abcdefghijéß中") for _ in range(400_000)) + " " + " ".join(rng.choice(["alpha", "beta", "1 2", "\n"]) for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "=" * 100_000), (3, "short")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(df, BPE, keep_ids=True).collect()}
    for r in df.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == ids and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_vocabularies_that_would_be_merged_otherwise_are_refused(tmp_path):
    letters = {chr(c): i for i, c in enumerate(bpe._byte_letters().values())}
    base = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}

    def saved(merges, **other):
        vocab = letters | {a + z: 256 + i for i, (a, z) in enumerate(merges)}
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(base | {"model": {"type": "BPE", "vocab": vocab, "merges": [" ".join(m) for m in merges]}} | other))
        return str(path)

    assert bpe.checked(saved([("a", "b"), ("ab", "c")]))
    for bad in (saved([("a", "b"), ("b", "c"), ("a", "bc")]), saved([("a", "b")], normalizer={"type": "NFC"}), saved([], pre_tokenizer={"type": "Whitespace"})):
        with pytest.raises(ValueError):
            bpe.checked(bad)


def test_token_counts_equal_greedy(odd, none):
    m = tokencount.Matcher(["a", "ab", "abc", "x"], ["b", "c", "bcd", "d", "bc"])
    assert [m.count(w) for w in ("abcd", "abbcd", "ax", "", "xbcdbc", "q")] == [2, 2, -1, 0, 3, -1]
    got = tokencount.count(odd, P.path("piece_bpe_32k.model"))
    assert got.count() == len(ODD) and got.where("doc_id = 7").first()["n_words"] == 30_000 and tokencount.count(none, P.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_of_words_without_a_marked_piece(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))

    def greedy(word):
        at, n, word = 0, 0, "▁" + word
        while at < len(word):
            fit = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            n, at = n + (1 if fit else len(word[at].encode())), at + (fit or 1)
        return n

    rng = random.Random(9)
    words = ["ñandú", "año", "ção", "ßen", "straße", "Übermäßig", "être", "中文没有空格的句子", "日本語のテキスト", "😀😀", "a😀b", "ᚠᚢ", "▁x", "the", "internationalization"]
    words += ["".join(rng.choice(["a", "ñ", "th", "中", "ß", "😀", "ing", "1", "é", "▁", "龘"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in tokencount.count(df, path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(words))] == list(map(greedy, words)) and not any(r["n_unknown"] for r in got.values())


def test_covering_masks_miss_nothing():
    ms, rng = simhash.masks(), random.Random(2)
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not d & m for m in ms)


def test_simhash_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(4)]
    texts = [" ".join(w if rng.random() > 0.01 else "z" for w in rng.choice(base)) for _ in range(120)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fp = simhash.fingerprints_of(pa.array(texts)).tolist()
    names = list(range(len(texts)))
    for _ in names:
        names = [min(names[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(fp))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == names
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0


def reachable(fps):
    """The smallest fingerprint that each one reaches, by brute force."""
    near = {a: [b for b in fps if (a ^ b).bit_count() <= 3] for a in fps}
    names, before = {a: a for a in fps}, None
    while names != before:
        before, names = names, {a: min(names[b] for b in near[a]) for a in fps}
    return names


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_chains_and_hubs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 500)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)] + [(5, 5), (None, 3)]
    names = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    before = None
    while before != names:
        before = dict(names)
        for a, b in edges:
            if a in names and b in names:
                names[a] = names[b] = min(names[a], names[b])
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in found.collect()} == names
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("kind", ["dense", "around one", "around one and far away"])
def test_groups_connect_what_links_connect(spark, kind):
    rng = random.Random(5)
    flipped = lambda low, high: sum(1 << b for b in rng.sample(range(63), rng.randint(low, high)))
    fps = {"dense": lambda: [x << 3 for x in range(300)], "around one": lambda: [flipped(0, 6) for _ in range(600)], "around one and far away": lambda: [0x2BCDEF0123456789 ^ flipped(4, 9) for _ in range(500)] + [rng.getrandbits(63) for _ in range(100)]}[kind]()
    fps = sorted(set(fps))
    want = reachable(fps)
    got = {r["node"]: r["component"] for r in simhash.groups(spark.createDataFrame([(x,) for x in fps], "fp bigint")).collect()}
    linked = set(want.values())
    assert all(got.get(x, x) == want[x] for x in fps) and all(x in want for x in got) and linked


def test_spotsigs(spark, odd, none):
    got = spotsigs.probe(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_edited"] <= 1 for r in got) and spotsigs.probe(none).count() == 0
    docs = spark.createDataFrame([(i, f"the cat number{i} sat on the mat of house{i} and " * 3) for i in range(20)], "doc_id bigint, text string")
    rows = sorted(spotsigs.probe(docs).collect(), key=lambda r: -r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in enumerate(rows):
        t, k = text[r["doc_id"]], len(text[r["doc_id"]]) // 3
        after = text[rows[(i + 1) % len(rows)]["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
    prints = spotsigs.fingerprints(docs)
    sets = {r["doc_id"]: {r["fingerprint"][j : j + 8] for j in range(0, len(r["fingerprint"]), 8)} for r in prints.collect()}
    links, _ = spotsigs.similar_pairs(prints, 0.3)
    want = sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3 for a in sets for b in sets if a < b)
    assert links.count() == want


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(12)
    base = [[f"{rng.getrandbits(32):08x}" for _ in range(60)] for _ in range(4)]
    sets = [set(base[i % 4][: rng.randint(20, 60)]) | {f"{rng.getrandbits(32):08x}" for _ in range(rng.randint(0, 12))} for i in range(150)]
    sets += [set(base[0]), set(base[0]), set(), set()]  # equal ones and empty ones
    rows = [(i, "".join(sorted(s))) for i, s in enumerate(sets)] + [(None, "")]
    links, members = spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id bigint, fingerprint string"), threshold)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    kept = sorted(first.values())
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0
    want = {(a, b): like(a, b) for a in kept for b in kept if a < b and like(a, b) >= threshold}
    got = {tuple(sorted((r["a"], r["b"]))): r["likeness"] for r in links.collect()}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {r["doc_id"]: r["representative"] for r in members.collect()} == {i: first[frozenset(s)] for i, s in enumerate(sets)} | {None: first[frozenset()]}


def test_next_documents_of_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a the cat", "x " * rng.randint(1, 50), f"the house {rng.random()} in town"])) for _ in range(120)]
    rows += [(None, None)] * 150 + [(5, "same here the one")] * 100  # heavy places
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    print_of = lambda t: spotsigs.hex_sets(spotsigs.signatures(pa.array([t])), 1)[0]
    named = df.selectExpr("coalesce(text, '') AS t").distinct().selectExpr("t", "xxhash64(t) AS h")
    h = {r["t"]: r["h"] for r in named.collect()}
    place = lambda k, t: (k is None, -(k or 0), h[t or ""])
    order = sorted({place(k, t): t or "" for k, t in rows}.items())
    after = {p: order[(i + 1) % len(order)][1] for i, (p, _) in enumerate(order)}

    def want(k, t):
        t, then = t or "", after[place(k, t)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + then[:cut]
        sets = [set(re.findall(".{8}", print_of(x))) for x in (t, edited, then)]
        like = [len(sets[0] & x) / len(sets[0] | x) if sets[0] | x else 1.0 for x in sets[1:]]
        return (k or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), print_of(t), print_of(edited), *like)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = Counter(want(k, t) for k, t in rows)
    try:
        for partitions in (before, "900"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert Counter((r[0] or -1, *tuple(r)[1:]) for r in spotsigs.probe(df).collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_single_document_follows_itself(spark):
    r = spotsigs.probe(spark.createDataFrame([(7, "the cat sat")], "doc_id bigint, text string")).first()
    assert r["n_chars"] == 11 and r["edited_sha256"] == hashlib.sha256(b"the cat the").hexdigest() and r["near_next"] == 1


def test_grammar_reads_both_ways():
    w = toxicity.clause_weight
    assert w(["T", "Y"], [1.0, 0]) == w(["Y", "T"], [0, 1.0]) == 1.25
    assert w(["I", "R"], [2.0, 0]) == w(["R", "I"], [0, 2.0]) == 1.6 and w(["T", "Y", "N"], [1.0, 0, 0]) < 1


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    docs = spark.createDataFrame([(i, f"word{i} and a {'snarf' if i % 4 == 0 else 'plain'} thing") for i in range(300)], "doc_id bigint, text string")
    rows = [(i, int(i % 4 == 0)) for i in range(300)]
    right, wrong = (spark.createDataFrame(x, "doc_id bigint, toxic int") for x in (rows, [(i, 1 - y if held(i) else y) for i, y in rows]))
    assert toxicity.learn(docs, right) == toxicity.learn(docs, wrong)
    several = spark.createDataFrame([*rows, (0, 0), (4, 0)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, several) == toxicity.learn(docs, right)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf, "labels").where("toxic IS NOT NULL")
    r = queries.op4_toxicity(spark, sf).where("held_out").join(labels, "doc_id").selectExpr("toxic", "predicted", "score").collect()
    clean, bad = ([x for x in r if x["toxic"] == t] for t in (0, 1))
    assert bad and sum(x["predicted"] for x in bad) >= 0.6 * len(bad) and sum(x["predicted"] for x in clean) <= 0.02 * len(clean)


def test_toxicity(spark, odd, none):
    assert toxicity.clause_weight(["I"], [2.0]) == 2.0 and toxicity.clause_weight(["N", "I"], [0, 2.0]) < 2.0 < toxicity.clause_weight(["Y", "I"], [0, 2.0])
    docs = spark.createDataFrame([(i, f"word{i} and a {'snarf' if i % 4 == 0 else 'plain'} thing") for i in range(200)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, toxicity.learn(none, labels.limit(0))).count() == 0


def test_ring(odd, none):
    assert ring.shard(none, 24).count() == 0
    rows = ring.shard(odd, 3, virtual=8).collect()
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(rows) == len(ODD)
    assert next(r for r in rows if r["doc_id"] == 1)["size"] == 8 and next(r for r in rows if r["doc_id"] == 4)["text_crc32"] == zlib.crc32(b"same text here now")


def test_ring_moves_few_rows(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id % 3000) AS text")
    at = lambda n: {r["doc_id"]: r["shard"] for r in ring.shard(df, n).collect()}
    before, after = at(24), at(25)
    moved = sum(before[k] != after[k] for k in before)
    assert moved / 4000 < 0.15 and sum(before[k] != after[k] and after[k] != 24 for k in before) / 4000 < 0.1
    more = ring.shard(df.unionByName(spark.createDataFrame([(9999, None), (9998, "")], "doc_id bigint, text string")), 24).collect()
    sizes = Counter(r["shard"] for r in more)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r["size"] for r in more if r["doc_id"] > 9990} == {8}


def test_orc_round_trip(spark, odd, none):
    path = workspace.fresh(spark, "t")
    orcstore.write(odd, BPE, path)
    got = orcstore.summaries(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 7]
    at = 0
    ids, rows = bpe.codec(BPE).encode(pa.array(["no id Ünï 中文 <|endoftext|> x"]))
    assert got[0]["ids_crc32"] == zlib.crc32(np.append(ids, 0).astype("<u4").tobytes())
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    empty = workspace.fresh(spark, "t")
    orcstore.write(none, BPE, empty)
    assert orcstore.summaries(spark, empty).count() == 0


def test_orc_look_up_skips_stripes(spark):
    from pyarrow import orc

    df = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text")
    path = workspace.fresh(spark, "t")
    orcstore.write(df, BPE, path, files=3)
    got = orcstore.lookup(spark, path, [7, 2999, 5000]).collect()
    ids = {r["doc_id"]: r["ids"] for r in got}
    assert sorted(ids) == [7, 2999] and ids[7] == [*bpe.codec(BPE).encode(pa.array(["some words of text 7"]))[0].tolist(), 0]
    plan = orcstore.lookup(spark, path, [7])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan.split("PushedFilters")[1]
    files = sorted(Path(path.removeprefix("file://")).glob("*.orc"))
    ranges = [(min(x), max(x)) for f in files if len(x := orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist())]
    assert len(files) == 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_stored_conversations_in_any_order(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says {t} " * (40_000 if c == 3 else 1)) for c in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_conversations(df, BPE)
    stored = workspace.written(made, "t").repartition(5, F.rand(3))
    assert sorted(map(tuple, chat.digests(stored).collect())) == sorted(map(tuple, chat.digests(made).collect())) and stored.count() == 6
    r = made.where("conv_id = 3").first()
    learned = [r["formatted"][s["low"] : s["high"]] for s in r["spans"]]
    assert learned == [t for c, _, role, t in rows if c == 3 and role == "assistant"] and len(r["ids"]) == len(r["loss"])
    probe = chat.digests(chat.format_conversations(chat.with_probe(df.drop("formatted"), spark), BPE)).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (probe["n_turns"], probe["loss_chars"], probe["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat(spark):
    s = "<|im_end|><|im_start|>assistant <\\| <\\\\|x|> ok"
    assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    rows = [(1, 1, "assistant", s), (1, 0, "user", None), (1, 2, "assistant", " \n é中 "), (2, 0, None, "x"), (None, None, "assistant", ""), (1, 1, "assistant", s)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df, BPE)).collect()}
    learned = s + s + " \n é中 "
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[1]["loss_chars"] == len(learned)
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n\nassistant\n{s}\nassistant\n{s}\nassistant\n \n é中 \n".encode()).hexdigest()
    assert set(got) == {1, 2, None} and chat.digests(chat.format_conversations(df.limit(0), BPE)).count() == 0


def test_repeated_passages_against_brute_force(spark, odd, none):
    rng, width = random.Random(6), 5
    texts = [" ".join(rng.choice(["a", "b", "c", "d"] + [f"u{i}"] * 3) for _ in range(rng.randint(0, 60))) for i in range(60)] + [None, "", "x y z"]
    texts[3] = texts[4]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(df, width).collect()}
    for i, w in enumerate(split):
        gone = [any(seen[tuple(w[j : j + width])] > 1 for j in range(max(0, k - width + 1), min(k, len(w) - width) + 1)) for k in range(len(w))]
        assert got[i]["kept"] == " ".join(x for x, g in zip(w, gone) if not g) and got[i]["n_removed"] == sum(gone)
    out = substring.remove_repeats(odd)
    assert out.count() == len(ODD) and out.where("doc_id = 7").first()["n_removed"] == 30_000 and substring.remove_repeats(none).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "same text"), (3, None), (10, "Here now")], "item_id bigint, text string")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(9, "x One, two three four FIVE six seven eight nine ten! y")], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in decontam.digest(decontam.find(docs, bench)).collect()}
    assert got[9]["n_hit"] == 10 and got[9]["n_items"] == 1 and got[4]["n_hit"] == 4 and got[4]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and not got[1]["contaminated"]
    assert decontam.find(none, bench).count() == 0 and decontam.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontam.find(docs, bench).count() == docs.count()


def test_items_of_equal_windows_are_put_together(spark):
    said = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(i, said) for i in range(30)] + [(99, "other words " * 8)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"x{i} {said} y{i}") for i in range(40)] + [(50, said + " " + "other words " * 8), (51, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.find(docs, bench, carry=("doc_id", "text")).collect()}
    every = sorted(map(str, range(30)))
    assert all(got[i]["items"] == every and got[i]["n_hit"] == 14 and got[i]["text"] == f"x{i} {said} y{i}" for i in range(40))
    assert got[50]["items"] == sorted([*every, "99"]) and got[51]["n_hit"] == 0


def test_stages_judge_rows_by_their_text(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    leak = next(r["text"] for r in queries.table(spark, d, "benchmark").collect())
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [(None, f"see {leak} there"), (1, f"see {leak} there"), (1, "clean"), (2, None), (None, "fine"), (2, None)]]
    left = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, kind), d)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, "clean"), (2, None), (None, "fine"), (2, None)]) and left.columns == list(corpus_pipeline.COLUMNS)
    docs = queries.table(spark, d, "documents").select(*corpus_pipeline.COLUMNS).where("doc_id > 9")  # what the stage learns from
    bad = queries.op4_toxicity(spark, d).where("score > 0.95 AND doc_id > 9").join(docs, "doc_id").first()["text"]
    rows = [(i, t, "en", "planted", len(t or "")) for i, t in [(None, bad), (1, bad), (1, "clean words"), (3, None), (3, "")]]
    left = corpus_pipeline.toxic(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), d).where("source = 'planted'")
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, "clean words"), (3, None), (3, "")])
    none = spark.createDataFrame([], kind)
    assert all(stage(spark, none, d).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_runs(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    left = corpus_pipeline.run(spark, d).collect()
    toxic = {r["doc_id"] for r in queries.op4_toxicity(spark, d).where("predicted = 1").collect()}
    assert 0 < len(left) <= docs.count() and not toxic & {r["doc_id"] for r in left}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("family", [0, 1 << 20])
def test_near_duplicate_stage_drops_planted_near_copies(spark, monkeypatch, family):
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "FAMILY", family)

    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(6)]
    texts = []
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 8)):  # 8 spaced edits leave about 0.7 of the shingles
            w[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [None, "", "one two", "ONE  two", "one three"]
    sets = [shingle_set(t) for t in texts]
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= 0.8 * len(a | b)] for a in sets]
    names, before = list(range(len(texts))), None
    while names != before:
        names, before = [min(names[j] for j in near[i]) for i in range(len(names))], names
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    fps = simhash.fingerprints_of(pa.array(texts)).tolist()
    assert any((fps[i] ^ fps[j]).bit_count() > 3 for i in range(90) for j in near[i])
    assert left == sorted(set(names)) and corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("family", [0, 1 << 20])
def test_near_duplicate_stage_goes_by_fingerprints(spark, monkeypatch, family):
    """Alone, where minhash gives no candidates; what is near by fingerprint only is left after the exact check."""
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "FAMILY", family)
    monkeypatch.setattr(nearcopies, "SHARED_KEYS", nearcopies.KEYS + 1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-1] + ["end"]), "a b c d e " * 50, "a b c d e " * 50 + " ".join(f"t{i}" for i in range(20)), "other words here", None, ""]
    fps = simhash.fingerprints_of(pa.array(texts)).tolist()
    assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in ((0, 1), (0, 2), (3, 4)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 3, 4, 5, 6]


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, a + " and more"), (4, "alone"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = Counter((r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert left == Counter([(1, a), (None, b), (3, c), (4, "alone"), (None, "")])


def test_near_copies_equal_brute_force_on_a_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in docs.collect()]
    holders = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() if len(h) > 1 for n, i in enumerate(h) for j in h[n + 1 :]}
    empty = [i for i, (_, s) in enumerate(rows) if not s]
    names = list(range(len(rows)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in pairs | set(zip(empty, empty[1:])):
        a, b = rows[i][1], rows[j][1]
        if len(a & b) * 5 >= 4 * len(a | b):
            x, y = sorted((root(i), root(j)), key=lambda k: rows[k][0])
            names[y] = x
    want = sorted(rows[i][0] for i in range(len(rows)) if names[i] == i)
    assert sorted(r["doc_id"] for r in nearcopies.one_of_each(docs).collect()) == want


def test_long_words_hash_apart():
    w = arrowtext.Words(*arrowtext.buffers(pa.array(["a" * 100 + " " + "a" * 101 + " " + "a" * 100])))
    h = arrowtext.polynomial(w, 0)
    assert h[0] == h[2] != h[1]


def test_families_equal_brute_force():
    rng = random.Random(2)
    for case in range(8):
        base = [[rng.getrandbits(60) for _ in range(rng.randint(5, 80))] for _ in range(4)]
        sets = []
        for _ in range(120):
            b, share = rng.choice(base), rng.choice([0, 0.05, 0.1, 0.2])
            sets.append({x for x in b if rng.random() > share} | {rng.getrandbits(60) for _ in range(rng.randint(0, 8))} | {rng.choice(b)})
        names = list(range(len(sets)))

        def root(i):
            while names[i] != i:
                i = names[i]
            return i

        def unite(pairs):
            names[:] = range(len(sets))
            for a, b in pairs:
                x, y = sorted((root(a), root(b)))
                names[y] = x
            return [root(i) for i in range(len(sets))]

        columns = [pa.array(range(len(sets)), pa.int64()), pa.array([rng.randrange(9) for _ in sets], pa.int64()), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))]
        found = nearcopies.family_links(pa.table(columns, ["cls", "popular", "elements"]))
        near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
        assert unite(zip(*(found.column(c).to_pylist() for c in "ab"))) == unite(near), case
