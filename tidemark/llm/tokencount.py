"""Word-piece token counts (operator 1).

Greedy longest-match-first word pieces, counted by a linear automaton: a trie
of the vocabulary with failure links.  When a character can't continue the
current match, the greedy pieces that must end before it are popped; only how
many they are is kept with each node, so no piece is ever built and each
character is looked at once.

Definitions: words are `[^\\x20\\x09-\\x0D]+`, unchanged.  The first piece of a
word is one of `initial`, the others are of `inner`.  With a sentencepiece
vocabulary a word begins with the blank mark, which can be a piece of its own;
where no piece fits and the vocabulary has byte pieces, the next character is
as many tokens as it has bytes in UTF-8.  A word that can't be cut
into pieces is a single unknown token.  Null and empty texts have no words.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import arrowtext

#: Distinct words whose count a worker remembers.
REMEMBERED = 500_000
#: What a sentencepiece vocabulary writes for the blank before a word.
MARK = "▁"


class Matcher:
    """The automaton for one vocabulary; with `by_bytes`, characters that no piece fits count as their bytes."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str], by_bytes: bool = False):
        self.by_bytes = by_bytes
        # Node 0 is where a word begins, node 1 where a piece inside of it does.
        self.child: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, vocabulary in ((0, initial), (1, inner)):
            for piece in vocabulary:
                at = root
                for c in piece:
                    nxt = self.child[at].get(c)
                    if nxt is None:
                        nxt = len(self.child)
                        self.child[at][c] = nxt
                        self.child.append({})
                        ends.append(False)
                    at = nxt
                ends[at] = ends[at] or bool(piece)
        weight = [int(x) for x in ends]
        if by_bytes:
            for c in sorted({c for node in self.child for c in node}):
                for root in (0, 1):
                    at = self.child[root].get(c)
                    if at is None and root:  # no piece begins with it
                        at = self.child[1][c] = len(self.child)
                        self.child.append({})
                        weight.append(0)
                    if at is not None and not weight[at]:
                        weight[at] = len(c.encode())
        n = len(self.child)
        #: Where matching goes on once the pieces before are popped (-1: nowhere), and how many are popped.
        self.link, self.popped = [-1] * n, [0] * n
        todo = deque([0, 1])
        while todo:
            v = todo.popleft()
            for c, u in self.child[v].items():
                if weight[u]:
                    self.link[u], self.popped[u] = 1, weight[u]
                else:
                    z, k = self.link[v], self.popped[v]
                    while z != -1 and c not in self.child[z]:
                        k += self.popped[z]
                        z = self.link[z]
                    if z != -1:
                        self.link[u], self.popped[u] = self.child[z][c], k
                todo.append(u)

    def count(self, word: str) -> int:
        """Number of pieces; -1 if the word can't be cut."""
        at, n = 0, 0
        child, link, popped = self.child, self.link, self.popped
        for c in word:
            while (nxt := child[at].get(c)) is None:
                if link[at] == -1:
                    if not self.by_bytes:
                        return -1
                    n += len(c.encode())
                    nxt = 1
                    break
                n += popped[at]
                at = link[at]
            at = nxt
        while at != 1:
            if link[at] == -1:
                return -1 if at else 0
            n += popped[at]
            at = link[at]
        return n


@functools.cache
def sentencepiece_matcher(path: str) -> tuple[Matcher, dict[bytes, int]]:
    """Matcher for words after the blank mark, over all ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Matcher([p for p in pieces if p[0] == MARK], pieces, sum(map(model.is_byte, ids)) == 256), {}


def count(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) of every row; other columns are left out.

    n_tokens counts each unknown word once.  Repeated rows come out as often as
    they go in; null keys stay null.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = sentencepiece_matcher(path)
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                words = arrowtext.Words(*arrowtext.buffers(part.column(1)))
                codes, distinct = words.distinct()
                if len(known) > REMEMBERED:
                    known.clear()
                each = np.zeros(len(distinct), np.int64)
                for i, w in enumerate(distinct):
                    n = known.get(w)
                    if n is None:
                        n = known[w] = matcher.count(MARK + w.decode())
                    each[i] = n
                got = each[codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(words.docs)),
                        pa.array(arrowtext.per_row_sum(np.where(got < 0, 1, got), words.docs)),
                        pa.array(arrowtext.per_row_sum(got < 0, words.docs)),
                    ],
                    [key, "n_words", "n_tokens", "n_unknown"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
