"""Toxicity by a weighted finite-state grammar (operator 4).

Words become symbols: insults and their stems (learned from labelled rows),
threats, targets, negations and reporting verbs (fixed lists, four languages).
Transducers for reported speech, negation and targets are composed into one
that reads a clause and marks each insult or threat by what is before it; the
same machine then reads the marked clause from its end, for what comes after.
The marks weigh.  The score is the logistic of a base, the weight of all clauses
and the number of words, since a long text holds some such words by chance; the
three factors are fitted on the labelled sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import arrowtext, workspace

#: Labelled rows learned from, at most; letters of a stem.
SAMPLE_ROWS, STEM = 20_000, (4, 8)
THRESHOLD = 0.7
#: Words whose symbols a task remembers.
KNOWN_WORDS = 100_000

#: Fixed words of the grammar.
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie tu te toi vous il elle ils usted ustedes ellos ella él".split()
NEGATIONS = "not no never nor without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split()
REPORTING = "said says wrote quoted reported claimed sagte schrieb dit écrit dijo escribió".split()
THREATS = "kill hurt destroy beat shoot stab töten umbringen tuer frapper matar golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "_", "I", "T", "Y", "N", "R"
#: Weights of marked symbols: as found, targeted, negated, reported; the last two damp.
FACTOR = {"plain": 1.0, "targeted": 1.25, "negated": 0.7, "reported": 0.8}

_separators = np.ones(256, bool)
_separators[128:] = False
_separators[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_ends = np.isin(np.arange(256), np.frombuffer(b".!?;:\n", np.uint8))


class Transducer:
    """A finite-state machine that rewrites symbols: step(state, symbol) gives (state, symbol)."""

    def __init__(self, step):
        self.step, self.table = step, {}

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to another."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer(step)

    def run(self, symbols: list[str], start) -> list[str]:
        out, state = [], start
        for s in symbols:
            if (state, s) not in self.table:
                self.table[state, s] = self.step(state, s)
            state, made = self.table[state, s]
            out.append(made)
        return out


def _reported(state: int, s: str) -> tuple[int, str]:
    return (1, s) if s == REPORT else (state, s + "r" if state and s[0] in (INSULT, THREAT) else s)


def _negated(left: int, s: str) -> tuple[int, str]:
    if s == NEGATION:
        return 3, s
    return max(0, left - 1), s + "n" if left and s[0] in (INSULT, THREAT) else s


def _targeted(seen: int, s: str) -> tuple[int, str]:
    if s == TARGET:
        return 5, s
    return max(0, seen - 1), s + "y" if seen and s[0] in (INSULT, THREAT) else s


GRAMMAR = Transducer(_reported).compose(Transducer(_negated)).compose(Transducer(_targeted))
BEGIN = ((0, 0), 0)


def marked(symbols: list[str]) -> list[str]:
    """The symbols of a clause with the marks of both directions."""
    return GRAMMAR.run(GRAMMAR.run(symbols, BEGIN)[::-1], BEGIN)[::-1]


def clause_weight(symbols: list[str], weights: list[float]) -> float:
    """Weight of a clause, from its symbols and the weights of their words."""
    total = 0.0
    for mark, w in zip(marked(symbols), weights, strict=True):
        if mark[0] in (INSULT, THREAT):
            total += w * (FACTOR["targeted"] if "y" in mark else 1) * (FACTOR["negated"] if "n" in mark else 1) * (FACTOR["reported"] if "r" in mark else 1)
    return total


class Model(NamedTuple):
    """Log odds = bias + gain * weight of the clauses - per_word * words; lexicon: weights of insulting words and stems."""

    bias: float
    lexicon: dict[str, float]
    gain: float = 1.0
    per_word: float = 0.0


def fitted(lexicon: dict[str, float], bias: float, rows: np.ndarray) -> Model:
    """The factors of a logistic regression on rows (weight, words, label), by Newton's steps with a slight pull to zero."""
    weight, words, y = rows.T
    scale = max(1.0, words.mean())
    x = np.column_stack((np.ones(len(y)), weight, words / scale))
    b, pull = np.array([bias, 1.0, 0.0]), np.diag([1e-3, 1e-3, 1e-3]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ b)
        b += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return Model(float(b[0]), lexicon, max(0.0, float(b[1])), max(0.0, -float(b[2]) / scale))


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows.

    Learns from at most `rows` labelled rows whose crc32(key as text) mod 3
    isn't 1, drawn by hash; a key with several labels has the largest.  A word, or a stem (given with a closing "*"),
    counts if it is in toxic texts far too often for chance among all that were
    looked at; all such features are taken, and the driver gets them, as the
    texts of `rows` labelled rows bound how many there are.  Without labelled rows of both kinds nothing is learned.
    """
    wanted = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1)
    drawn = wanted.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)
    found = documents.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).join(F.broadcast(drawn), "k")  # at most `rows` pairs of numbers
    found = workspace.written(found, "sample")
    tokens = found.select("k", "y", F.array_distinct(F.split("t", r"[^\p{L}\p{N}]+")).alias("w"))
    stems = F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: F.when(F.length(w) > n, F.concat(F.substr(w, F.lit(1), n), F.lit("*"))))))
    feature = F.explode(F.array_distinct(F.concat("w", stems)))
    counts = tokens.select("y", feature.alias("f")).where("f IS NOT NULL AND length(f) > 2").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    base = tokens.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    n, t = base["n"], base["t"] or 0
    if not n or not t or t == n:
        return Model(math.log(0.05 / 0.95), {})
    p = t / n
    share = F.col("t") / F.col("n")
    gain = F.col("t") * F.log(share / p) + F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    often = counts.where((F.col("t") >= 3) & (share > 0.8)).withColumn("gain", gain).where(F.col("gain") > 11.0)
    best = often.select("f", "n", "t").collect()
    lexicon = {r["f"]: min(6.0, math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - math.log(p / (1 - p))) for r in best}
    toxic_texts = {r["f"]: r["t"] for r in best}

    def adds(f: str) -> bool:
        """A stem has to be in clearly more texts than any one known word that begins with it."""
        return f[-1] != "*" or toxic_texts[f] > 1.3 * max((t for g, t in toxic_texts.items() if g[-1] != "*" and g.startswith(f[:-1])), default=0)

    bias, lexicon = math.log(p / (1 - p)), {f: w for f, w in lexicon.items() if w > 0 and adds(f)}
    seen = found.select("k", F.col("t").alias(text)).transform(lambda d: score(d, Model(bias, lexicon), text, "k"))
    seen = seen.join(F.broadcast(drawn), "k").select("weight", "n_words", "y").toPandas()  # `rows` rows of the sample at most
    return fitted(lexicon, bias, seen.to_numpy(float))


def score(documents: DataFrame, model: Model, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns named in `carry`, score, predicted, n_clauses, weight, n_words) of every row.

    n_clauses counts clauses with an insult or threat, weight is theirs.  Null
    and empty texts have the score of the base.  A row is judged by its text
    alone, so equal texts have equal scores, whatever the key.
    """
    kind = documents.schema[key].dataType.simpleString()
    lexicon = model.lexicon
    more = [c for c in carry if c not in (key, text)]
    kept = [key, text, *more] if text in carry else [key, *more]
    named = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in kept[1:])
    fixed = {w: (s, v) for words, s, v in ((TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTING, REPORT, 0.0), (THREATS, THREAT, 1.0)) for w in words}
    shortest, longest = STEM

    def symbol(word: bytes) -> tuple[str, float]:
        w = word.decode("utf-8", "replace").lower()
        if w in fixed:
            return fixed[w]
        best = lexicon.get(w, 0.0)
        for n in range(shortest, min(longest, len(w) - 1) + 1):
            best = max(best, lexicon.get(w[:n] + "*", 0.0))
        return (INSULT, best) if best else (OTHER, 0.0)

    @arrowtext.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str, float]] = {}
        for batch in batches:
            for part in arrowtext.pieces(batch, text):
                raw, rows = arrowtext.buffers(part.column(1))
                words = arrowtext.Words(raw, rows, _separators)
                codes, distinct = words.distinct()
                if len(known) > KNOWN_WORDS:
                    known.clear()
                symbols = [known.get(w) or known.setdefault(w, symbol(w)) for w in distinct]
                bad = np.array([s in (INSULT, THREAT) for s, _ in symbols], bool)
                clause = np.searchsorted(np.flatnonzero(_ends[raw]), words.starts)
                sums, clauses = np.zeros(len(part)), np.zeros(len(part), np.int64)
                hits = np.flatnonzero(bad[codes]) if len(codes) else []
                of = np.searchsorted(words.docs, hits, "right") - 1
                done = None
                for at, doc in zip(hits, of, strict=True):
                    if done == (doc, clause[at]):
                        continue
                    done = (doc, clause[at])
                    low = max(words.docs[doc], np.searchsorted(clause, clause[at], "left"))
                    high = min(words.docs[doc + 1], np.searchsorted(clause, clause[at], "right"))
                    here = [symbols[c] for c in codes[low:high]]
                    sums[doc] += clause_weight([s for s, _ in here], [w for _, w in here])
                    clauses[doc] += 1
                lengths = np.diff(words.docs)
                scores = 1 / (1 + np.exp(-np.clip(model.bias + model.gain * sums - model.per_word * lengths, -50, 50)))
                made = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(clauses), pa.array(sums), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], [*kept, "score", "predicted", "n_clauses", "weight", "n_words"])

    return documents.select(key, text, *more).mapInArrow(run, f"`{key}` {kind}, {named}score double, predicted int, n_clauses bigint, weight double, n_words bigint")
