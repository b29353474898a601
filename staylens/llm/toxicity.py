"""Toxicity scores by weak supervision.

1. Lexicons are induced on one fold of the labelled training rows: words and word
   beginnings whose document frequency differs between the labels.
2. Voters (a fixed lexicon, induced words, induced beginnings of several lengths,
   patterns) each say toxic, clean or nothing about every document.
3. A generative label model is fitted by EM to the counts of vote patterns of all
   documents, with the labelled rows of the other fold as fixed evidence.  It
   estimates each voter's accuracy and, by a tree of pairwise dependencies (the
   largest conditional mutual information), the correlations between voters, so that
   voters repeating each other are not counted twice.
4. A logistic regression on lexical features is trained on the model's posterior
   labels of a bounded sample and scores every document.

Counts of features and the labelled vote patterns come from all labelled rows of their
fold, the other vote patterns from all documents; patterns are at most 3**voters.  Only
the classifier is fitted to a hash sample of about ``MAX_ROWS`` labelled rows.
``MAX_FEATURES`` is the size of the model: that many features, those of the largest
|z|, are its inputs, whatever the size of the corpus.

Texts are read twice: the labelled ones of the lexicon fold, then all of them once, which
leaves per document its vote pattern and the numbers of its active features.  Labels
meet those small rows; the models and the scores need no text again.

Defined cases: a null or empty text has no features and gets the score of the
intercept; rows without a label, or with a null one, are not learned from; a document
with several labels counts once for each; unless either fold has labelled rows of both
kinds, and some feature tells them apart, every score is the share of toxic labels (0 if
there are none); repeated rows score alike; other columns never matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import id_remainder, map_arrow, rows_of, slices, store, whole_text
from staylens.llm.language import letters_of

MAX_ROWS = 20_000
MAX_FEATURES = 4_000
PREFIXES = (4, 5, 6, 7)
DENSE_RATE = 0.005
HELD_OUT = 2
CACHE_WORDS = 300_000
THRESHOLD = 0.3

# Insults of the fixed-lexicon voter.
LEXICON = frozenset("""
idiot idiots moron morons stupid loser losers trash scum clown worthless pathetic
disgusting dumb imbecile jerk bastard bitch asshole shit fuck fucking
idiota idiotas estúpido estúpida imbécil basura asqueroso patético
idioten dumm dummkopf arschloch abschaum wertlos ekelhaft erbärmlich
stupide crétin connard ordure minable dégoûtant pathétique
""".split())

_SHOUT = re.compile(r"!!|^\W*[A-ZÀ-Ý]{4,}\W*$").search


def features_of(word: str) -> list[str]:
    """The word and its beginnings, as feature names."""
    return ["w:" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]


class FeatureCounter:
    """Counts of known features in texts; ``known`` maps feature names to numbers."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self._cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[dict[int, int], int]:
        """Occurrences of each known feature, and the number of words."""
        counts = Counter(text.split())
        cache, out = self._cache, {}
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for token, n in counts.items():
            got = cache.get(token)
            if got is None:
                names = features_of(word) if (word := letters_of(token)) else []
                names += ["lexicon"] * (word in LEXICON) + ["shout"] * bool(_SHOUT(token))
                got = cache[token] = tuple(self.known[f] for f in names if f in self.known)
            for f in got:
                out[f] = out.get(f, 0) + n
        return out, counts.total()


def dense(count: int, words: int) -> bool:
    return count >= 2 and count >= DENSE_RATE * words


# --- lexicons -----------------------------------------------------------------------

def feature_table(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """z scores of the log odds (present, dense) of at most ``MAX_FEATURES`` features,
    from ``rows`` of (text, y); y is a weight of the positive label."""
    schema = pa.schema([("feature", pa.string()), *((c, pa.float64()) for c in
                                                    ("any_pos", "any_neg", "dense_pos", "dense_neg"))])
    ddl = "feature string, any_pos double, any_neg double, dense_pos double, dense_neg double"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}
        for text, y in rows_of(batches, "text", "y"):
            tokens = Counter(text.split())
            total, found = tokens.total(), Counter()
            for token, n in tokens.items():
                if word := letters_of(token):
                    for f in features_of(word):
                        found[f] += n
            for f, n in found.items():
                s = sums.setdefault(f, [0.0, 0.0, 0.0, 0.0])
                s[0] += y
                s[1] += 1 - y
                if dense(n, total):
                    s[2] += y
                    s[3] += 1 - y
            if len(sums) > 500_000:
                yield from slices(((f, *s) for f, s in sums.items()), schema, 50_000)
                sums = {}
        yield from slices(((f, *s) for f, s in sums.items()), schema, 50_000)

    totals = rows.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).first()
    pos, neg = totals["pos"] or 0.0, totals["neg"] or 0.0
    if not pos or not neg:
        return {}

    def z(kind):
        a, b = F.col(f"{kind}_pos"), F.col(f"{kind}_neg")
        odds = (F.log((a + 0.5) / (F.lit(pos) - a + 0.5))
                - F.log((b + 0.5) / (F.lit(neg) - b + 0.5)))
        score = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        return F.when(a + b >= 4, score).otherwise(0.0)

    summed = (map_arrow(rows, count, ddl).groupBy("feature")
              .agg(*(F.sum(c).alias(c) for c in schema.names[1:]))
              .filter(F.col("any_pos") + F.col("any_neg") >= 4)
              .select("feature", z("any").alias("z_any"), z("dense").alias("z_dense")))
    strength = F.greatest(F.abs("z_any"), F.abs("z_dense"))
    best = summed.filter(strength >= 2).orderBy(strength.desc(), "feature").limit(MAX_FEATURES)
    return {r["feature"]: (r["z_any"], r["z_dense"]) for r in best.collect()}


# --- voters -------------------------------------------------------------------------

class Voters:
    """Votes on a text: 1 toxic, 0 nothing, -1 clean; one number per pattern of votes."""

    def __init__(self, table: dict[str, tuple[float, float]], least: float = 3.5):
        names = sorted(table)
        self.fixed, self.shout = len(names), len(names) + 1
        self.counter = FeatureCounter({f: i for i, f in enumerate([*names, "lexicon", "shout"])})
        kinds = ("w", *map(str, PREFIXES))
        self.kind = [kinds.index(f.split(":", 1)[0]) for f in names]
        self.any = [table[f][0] >= least for f in names]
        self.dense = [table[f][1] >= least for f in names]
        self.n_kinds = len(kinds)
        self.n = self.n_kinds + 3

    def encode(self, text: str) -> tuple[int, list[int]]:
        """The vote pattern and the numbers of active features."""
        counts, words = self.counter(text)
        code = 0
        for v in self.votes(counts, words):
            code = 3 * code + v + 1
        return code, active(counts, words)

    def votes(self, counts: dict[int, int], words: int) -> list[int]:
        """The votes; the two counts that are no features are taken out of ``counts``."""
        hits, weak = [0] * self.n_kinds, 0
        fixed, shouts = counts.pop(self.fixed, 0), counts.pop(self.shout, 0)
        for f, n in counts.items():
            if self.dense[f] and dense(n, words):
                hits[self.kind[f]] += 2
            elif self.any[f]:
                hits[self.kind[f]] += 1
            weak += self.any[f] or self.dense[f]
        votes = [1 if hits[0] else 0, *(1 if h >= 2 else 0 for h in hits[1:])]
        votes.append(1 if fixed else 0)
        votes.append(1 if shouts > 0.05 * (words + 1) else 0)
        votes.append(-1 if not weak and not fixed and words >= 5 else 0)
        return votes

    def unpack(self, code: int) -> list[int]:
        out = []
        for _ in range(self.n):
            code, v = divmod(code, 3)
            out.append(v)
        return out[::-1]


# --- label model --------------------------------------------------------------------

@dataclass
class LabelModel:
    """p(y) and p(vote | parent's vote, y) along a tree of voters."""

    prior: float = 0.1
    parent: list[int] = field(default_factory=list)
    tables: np.ndarray | None = None     # voter, y, parent's vote, vote

    def likelihood(self, votes: np.ndarray) -> np.ndarray:
        """log p(votes, y) by row and y."""
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            out += np.log(self.tables[j][:, above, votes[:, j]]).T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """p(y = 1 | votes)."""
        ll = self.likelihood(votes)
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))

    def _fit(self, votes: np.ndarray, weights: np.ndarray) -> None:
        """Closed-form estimates from weights by row and y."""
        m = votes.shape[1]
        self.prior = float(np.clip(weights[:, 1].sum() / max(weights.sum(), 1e-9), 1e-4, 0.9))
        joint = np.zeros((m, m, 2, 3, 3))
        for y in (0, 1):
            hot = np.eye(3)[votes] * weights[:, y][:, None, None]
            joint[:, :, y] = np.einsum("rja,rkb->jkab", hot, np.eye(3)[votes], optimize=True)
        joint += 0.1
        share = joint / joint.sum(axis=(2, 3, 4), keepdims=True)
        own_j, own_k = share.sum(axis=4, keepdims=True), share.sum(axis=3, keepdims=True)
        label = share.sum(axis=(3, 4), keepdims=True)
        info = (share * np.log(share * label / (own_j * own_k))).sum(axis=(2, 3, 4))
        self.parent = _tree(info)
        self.tables = np.zeros((m, 2, 3, 3))
        for j, p in enumerate(self.parent):
            pair = joint[p, j] if p >= 0 else np.tile(
                joint[j, j].sum(axis=2)[:, None, :], (1, 3, 1))
            self.tables[j] = pair / pair.sum(axis=2, keepdims=True)

    def fit(self, votes: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray,
            rounds: int = 40) -> "LabelModel":
        """EM; ``unlabelled`` counts by row, ``labelled`` by row and y.  The unlabelled
        rows weigh together as much as the labelled ones, which fix the classes."""
        self._fit(votes, labelled)
        scale = labelled.sum() / max(unlabelled.sum(), 1)
        for _ in range(rounds):
            p = self.posterior(votes)
            soft = (unlabelled * scale)[:, None] * np.stack([1 - p, p], axis=1)
            self._fit(votes, labelled + soft)
        return self


def _tree(info: np.ndarray) -> list[int]:
    """Parents of a maximum spanning tree over pairwise information, rooted at 0."""
    m = len(info)
    parent, best = [-1] * m, [(info[0, j], 0) for j in range(m)]
    left = set(range(1, m))
    while left:
        j = max(left, key=lambda k: (best[k][0], -k))
        parent[j] = best[j][1]
        left.remove(j)
        for k in left:
            if info[j, k] > best[k][0]:
                best[k] = (info[j, k], j)
    return parent


# --- linear classifier -----------------------------------------------------------------

def fit_logistic(rows: list[np.ndarray], y: np.ndarray, n: int, l2: float = 1.0,
                 steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of active binary features (full-batch Adam)."""
    flat = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[flat], minlength=len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(flat, weights=err[owner], minlength=n) + l2 * w, err.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, b


def active(counts: dict[int, int], words: int) -> list[int]:
    """Numbers of the binary features: 2f for presence, 2f + 1 for density."""
    return sorted([2 * f for f in counts] + [2 * f + 1 for f, n in counts.items()
                                             if dense(n, words)])


# --- the operator ------------------------------------------------------------------------

def encode(docs: DataFrame, table: dict) -> DataFrame:
    """Per document: doc_id, held_out, the vote pattern, the numbers of active features."""
    sent = docs.sparkSession.sparkContext.broadcast(table)   # at most MAX_FEATURES entries
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                        ("pattern", pa.int64()), ("on", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        voters = Voters(sent.value)
        for doc_id, held_out, text in rows_of(batches, "doc_id", "held_out", "text"):
            yield doc_id, held_out, *voters.encode(text)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (id_remainder("doc_id", 4) == HELD_OUT).alias("held_out"),
                        whole_text().alias("text"))
    return map_arrow(texts, lambda batches: slices(rows(batches), schema, 10_000),
                     "doc_id long, held_out boolean, pattern long, on array<int>")


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y, fold) of the labelled training rows; fold 0 induces lexicons, fold 1
    trains the models."""
    rest = id_remainder("doc_id", 4)
    return labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                         & (rest != HELD_OUT)).select(
        "doc_id", F.col("toxic").cast("double").alias("y"),
        F.when(rest == 0, 0).otherwise(1).alias("fold"))


def sample_labels(n: int, max_rows: int = MAX_ROWS) -> Column:
    """Holds for about ``max_rows`` of ``n`` rows, chosen by hash of the id."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 12) / float(1 << 52)
    return place < max_rows / max(n, 1)


def lexicon(docs: DataFrame, marks: DataFrame) -> dict[str, tuple[float, float]]:
    """The feature table of the lexicon fold.  Only that fold's texts meet their labels,
    in a join that deals both sides by id at every size."""
    fold = docs.filter(id_remainder("doc_id", 4) == 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    mine = marks.filter("fold = 0").select("doc_id", "y")
    return feature_table(fold.join(mine.hint("merge"), "doc_id").select("text", "y"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, np.ndarray, float, DataFrame]:
    """The feature table, weights and intercept of the linear classifier, and the
    encoded documents (stored)."""
    marks = store(training_labels(labels), "toxicity-labels")
    kinds = {(r["fold"], r["y"] >= 0.5): r["n"] for r in
             marks.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    share = sum(n for (_, toxic), n in kinds.items() if toxic) / total if total else 0.0
    p = min(max(share, 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    table = lexicon(docs, marks) if len(kinds) == 4 else {}
    encoded = store(encode(docs, table), "toxicity-encoded")
    weights = np.zeros(2 * len(table))
    if not table:
        return table, weights, base, encoded

    voters = Voters(table)
    patterns = (encoded.filter("not held_out").groupBy("pattern")
                .agg(F.count("*").alias("n")).collect())
    mine = marks.filter("fold = 1").select("doc_id", "y")
    marked = (encoded.select("doc_id", "pattern").join(mine.hint("merge"), "doc_id")
              .groupBy("pattern", "y").agg(F.count("*").alias("n")).collect())
    codes = sorted({r["pattern"] for r in [*patterns, *marked]})
    at = {c: i for i, c in enumerate(codes)}
    votes = np.array([voters.unpack(c) for c in codes], dtype=int).reshape(len(codes), voters.n)
    unlabelled, labelled = np.zeros(len(codes)), np.zeros((len(codes), 2))
    for r in patterns:
        unlabelled[at[r["pattern"]]] = r["n"]
    for r in marked:
        labelled[at[r["pattern"]], int(r["y"] >= 0.5)] += r["n"]
    if not labelled.sum(axis=0).all():      # labels whose documents are not in the table
        return table, weights, base, encoded
    p = LabelModel().fit(votes, unlabelled, labelled).posterior(votes)
    chosen = sample_labels(int(labelled.sum()))
    rows = (encoded.filter(chosen).select("doc_id", "pattern", "on")
            .join(mine.filter(chosen), "doc_id").select("pattern", "on").collect())
    # sums in one order, whatever the tasks
    rows = sorted((float(p[at[r["pattern"]]]), r["on"]) for r in rows)
    if rows:
        weights, base = fit_logistic([np.array(on, dtype=np.int64) for _, on in rows],
                                     np.array([y for y, _ in rows]), len(weights))
    return table, weights, base, encoded


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    _, weights, bias, encoded = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            on = batch.column("on")
            sizes = np.diff(on.offsets.to_numpy())
            z = bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes),
                                   weights=weights[on.flatten().to_numpy()],
                                   minlength=len(sizes))
            p = 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p),
                 pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(encoded.select("doc_id", "held_out", "on"), score,
                     "doc_id long, held_out boolean, score double, predicted int")
