"""Byte-level BPE encoding and decoding (operator 6).

Text is cut into pre-tokens by the published byte-level pattern, evaluated with
NumPy on code-point classes for a whole batch.  Distinct pre-tokens are encoded
once.  A pre-token longer than LEAF bytes (text that the pattern doesn't split)
is encoded by tree concatenation: its halves' leaves are encoded in parallel, by
THREADS threads of the task (the encoder works outside of Python's lock), and
neighbours are joined by re-encoding a window around the join, which grows
until its first tokens are those of the left side and its last tokens those of
the right side.  A byte-pair encoding is canonical exactly if every pair of
adjacent tokens is, so the joined sequence is the encoding of the whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from tidemark.llm import arrowtext

#: Bytes up to which a pre-token is encoded in one go; characters of a leaf of a longer one; threads that encode leaves.
LEAF, THREADS = 512, 4
#: Tokens on either side of a join that a first window covers, and that have to agree.
WINDOW, AGREE = 8, 2
#: Distinct pre-tokens whose encoding a worker remembers.
REMEMBERED = 100_000

OTHER, LETTER, NUMBER, SPACE = range(4)

#: The pattern of byte-level BPE, and the alternatives after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


#: Class of each code point, UNKNOWN until a text holds it.
UNKNOWN = 255
_classes = np.full(0x110000, UNKNOWN, np.uint8)
_splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)


def classes(cp: np.ndarray) -> np.ndarray:
    """The classes of code points, as the tokenizers library has them (Unicode versions differ between libraries)."""
    out = _classes[cp]
    if (new := np.unique(cp[out == UNKNOWN])).size:
        one = lambda before, c: len(_splitter.pre_tokenize_str(before + c)) == 1
        for c in new.tolist():
            x = chr(c)
            _classes[c] = LETTER if one("a", x) else NUMBER if one("1", x) else OTHER if one("!", x) else SPACE
        out = _classes[cp]
    return out


def pretoken_starts(cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token. heads: where non-empty texts begin."""
    n = len(cp)
    kind = classes(cp)
    first = np.zeros(n + 1, bool)
    first[heads] = True
    first[n] = True
    run = np.ones(n, bool)
    run[1:] = (kind[1:] != kind[:-1]) | first[1:-1]
    space = kind == SPACE
    blank = cp == 32
    start = run.copy()
    # A blank just before a run of other characters belongs to it; of more white space only the last one does.
    after = np.zeros(n, bool)  # code points that follow white space of the same text, themselves none
    after[1:] = ~space[1:] & space[:-1] & ~first[1:-1]
    at = np.flatnonzero(after)
    start[at - 1] = True
    start[at[blank[at - 1]]] = False
    # Contractions begin with an apostrophe that begins a pre-token.
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        following = cp[quote + 1]
        second = np.full(len(quote), -1, np.int64)
        far = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        second[far] = cp[quote[far] + 2]
        size = np.zeros(len(quote), np.int64)
        for a in SHORT:
            size[following == ord(a)] = 2
        for a, b in LONG:
            size[(following == ord(a)) & (second == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        ends = quote + size
        start[ends[ends < n]] = True
    return start


class Codec:
    """Encoder and decoder for one vocabulary file in the tokenizers format (byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(c): b for b, c in _byte_letters().items()}
        ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {k: v for k, v in special.items() if k}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.single = {b: i for b, i in ids.items() if len(b) == 1}
        # Merges are ranked by their order, which is that of the ids beyond the single bytes.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks: dict[bytes, int] = {}
        for rank, b in enumerate([*sorted(self.single, key=self.single.get), *(bytes(letters[c] for c in a + z) for a, z in merges)]):
            ranks.setdefault(b, rank)
        self.to_id = np.zeros(max(ranks.values()) + 1, np.int32)
        for b, rank in ranks.items():
            self.to_id[rank] = ids[b]
        self.ranked = bool(np.array_equal(self.to_id, np.arange(len(self.to_id))))
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.ranks, self._unsplit = ranks, None
        self.size = max([*ids.values(), *self.special.values()]) + 1
        table = [b""] * self.size
        for b, i in ids.items():
            table[i] = b
        for s, i in self.special.items():
            table[i] = s.encode()
        self.bytes_of = pa.array(table, pa.large_binary())
        self.table = table
        self.known: dict[bytes, list[int]] = {}

    @property
    def unsplit(self):
        """The encoder that takes any text as one pre-token, made when it is needed first."""
        if self._unsplit is None:
            self._unsplit = tiktoken.Encoding("unsplit", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        return self._unsplit

    def pieces(self, distinct: list[bytes]) -> list[list[int]]:
        """Ids of distinct pre-tokens."""
        known = self.known
        out = list(map(known.get, distinct))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
        for i in missing:
            b = distinct[i]
            if len(b) <= LEAF:
                out[i] = known[b] = self.leaf(b)
            else:
                out[i] = self.tree(b)
        return out

    def leaf(self, b: bytes) -> list[int]:
        ids = self.core.encode_single_piece(b) if b else []
        return ids if self.ranked else self.to_id[ids].tolist()

    def tree(self, b: bytes, leaf: int = LEAF) -> list[int]:
        """Ids of a long pre-token, by halves."""
        parts = [b.decode()]
        while max(map(len, parts)) > leaf:
            parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
        distinct = list(dict.fromkeys(parts))
        step = -(-len(distinct) // THREADS)
        stretches = [distinct[i : i + step] for i in range(0, len(distinct), step)]
        if len(distinct) > THREADS:
            with ThreadPoolExecutor(THREADS) as pool:
                found = list(pool.map(self.leaves, stretches))
        else:
            found = map(self.leaves, stretches)
        done = dict(zip(distinct, itertools.chain.from_iterable(found), strict=True))
        level = [done[p] for p in parts]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def leaves(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part, none of them split."""
        each = map(self.unsplit.encode_ordinary, parts)
        return [ids if self.ranked else self.to_id[ids].tolist() for ids in each]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together."""
        span = WINDOW
        while True:
            a, z = max(0, len(left) - span), min(len(right), span)
            middle = left[a:] + right[:z]
            text = b"".join([self.table[i] for i in middle])
            again = self.leaf(text)
            from_left = a == 0 or again[:AGREE] == left[a : a + AGREE]
            from_right = z == len(right) or again[-AGREE:] == right[z - AGREE : z]
            if from_left and from_right:
                return left[:a] + again + right[z:]
            span *= 2

    def encode_one(self, text: str) -> list[int]:
        """Ids of one text, special tokens recognised."""
        out: list[int] = []
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                raw = np.frombuffer(part.encode(), np.uint8)
                out += self.encode_plain(raw, np.array([0, len(raw)]))[0].tolist()
        return out

    def encode_plain(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their offsets by row) of texts in which no special token is."""
        begins = (raw & 0xC0) != 0x80
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum(begins)))[rows]
        start = pretoken_starts(cp, heads[:-1][heads[:-1] < heads[1:]])
        where = np.flatnonzero(begins)[start]
        found = arrowtext.binary(raw, np.concatenate((where, [len(raw)]))).dictionary_encode()
        codes = found.indices.to_numpy()
        ids = self.pieces(found.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum()))
        out = flat[arrowtext.ragged((np.cumsum(lengths) - lengths)[codes], lengths[codes])]
        pre_rows = np.concatenate(([0], np.cumsum(start)))[heads]
        return out, np.concatenate(([0], np.cumsum(lengths[codes])))[pre_rows]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their offsets by row) of a column of texts; null is empty."""
        raw, rows = arrowtext.buffers(column)
        whole = raw.tobytes()
        if not any(s.encode() in whole for s in self.special):
            return self.encode_plain(raw, rows) if len(raw) else (np.zeros(0, np.int32), rows * 0)
        each = [np.array(self.encode_one(whole[a:z].decode()), np.int32) for a, z in zip(rows[:-1], rows[1:], strict=True)]
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, their offsets by row); bytes that are no UTF-8 become replacement characters."""
        tokens = self.bytes_of.take(pa.array(ids))
        data, at = arrowtext.buffers(tokens)
        at = at[rows]
        try:
            data.tobytes().decode("utf-8")
            if not np.any((data[at[:-1][at[:-1] < at[1:]]] & 0xC0) == 0x80):  # no character goes over the end of a text
                return data, at
        except UnicodeDecodeError:
            pass
        each = [data[a:z].tobytes().decode("utf-8", "replace").encode() for a, z in zip(at[:-1], at[1:], strict=True)]
        return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in each])))


def _byte_letters() -> dict[int, int]:
    """The published mapping of bytes to printable code points: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: b for b in own}
    for b in range(256):
        if b not in out:
            out[b] = 256 + len(out) - len(own)
    return out


def _settled(b: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What merges of a lower rank make of b, wherever two neighbours together are a token."""
    parts = [b[i : i + 1] for i in range(len(b))]
    while len(parts) > 1:
        best, at = min((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(itertools.pairwise(parts)))
        if best >= rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@functools.cache
def checked(path: str) -> str:
    """path, if Codec encodes with this file as the tokenizers library does; else ValueError. The driver asks once.

    The encoder merges any two neighbours that together are a token, the library
    only listed pairs.  That is the same if the merges before a pair's make its
    two sides, and nothing else, of its bytes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level pre-tokens without prefix blanks or normalizers are known")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain byte-pair models are known")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("special tokens that take in what is around them aren't known")
    letters = {chr(c): b for b, c in _byte_letters().items()}
    pairs = [[bytes(letters[c] for c in side) for side in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    ranks: dict[bytes, int] = {}
    for rank, (a, z) in enumerate(pairs):
        ranks.setdefault(a + z, rank)
    for rank, (a, z) in enumerate(pairs):
        if ranks[a + z] != rank or _settled(a + z, rank, ranks) != [a, z]:
            raise ValueError(f"the merge of {a!r} and {z!r} isn't the only way to its token")
    return path


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def put_away() -> None:
    """Frees the codec at the end of a task: workers live on, and later stages need the memory. Loading it takes 0.3 s."""
    codec.cache_clear()
    arrowtext.give_back()


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row; null text gives no ids. Other columns are left out. path: a file that workers can read."""
    checked(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in arrowtext.pieces(batch, text):
                    ids, rows = codec(path).encode(part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))], [key, "ids"])
        finally:
            put_away()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ids; null gives the empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))))
            data, at = codec(path).decode(column.flatten().to_numpy(zero_copy_only=False), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), arrowtext.binary(data, at).cast(pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, and ids array<int> if they are kept.

    Encodes each text, decodes its ids again and digests both, within one pass
    over the input.  Null and empty texts have no tokens and the digests of the
    empty string; repeated rows are returned as often as they come.
    """
    checked(path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            coder = codec(path)
            decimal = pa.array([b"%d," % i for i in range(coder.size)], pa.large_binary())
            for batch in batches:
                for part in arrowtext.pieces(batch, text):
                    ids, rows = coder.encode(part.column(1))
                    said, at = arrowtext.buffers(decimal.take(pa.array(ids)))
                    at = at[rows]
                    back, ends = coder.decode(ids, rows)
                    said, back = memoryview(said), memoryview(np.ascontiguousarray(back))
                    columns = {
                        key: part.column(0),
                        "n_tokens": pa.array(np.diff(rows), pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(said[a : max(a, z - 1)]).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]),
                        "decoded_sha256": pa.array([hashlib.sha256(back[a:z]).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)]),
                    }
                    if keep_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            coder = decimal = None
            put_away()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
