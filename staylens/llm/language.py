"""Language identification of texts that may mix languages.

Learning counts hashed character n-grams (orders 1 to 5, word ends included) per
language over all training texts, and in which scripts a language is written.  A
word's score under a language is its mean n-gram log probability summed over its
letters; a language that hardly uses the word's script (share below ``SCRIPT_SHARE``) is
set back by ``OUT_OF_SCRIPT``, unless no language uses it.  Viterbi over the words, with
a penalty for each switch of language, labels spans.  The prediction is the language of most lettered words; its share of
them is the score.

Most texts are of one language: the constant path is the best one if no run of words
gains more than the penalty by another language, and no run from the start and run to
the end gain more than it together (k segments pay k - 1 penalties, and each lies at an
end or between two others).  One pass of cumulative sums shows this; the other texts
take the step-by-step recursion.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no
spans, and so is every text when nothing was learned; rows with a null language
are not learned from; of equal languages the first by name wins; repeated rows count
as often as they stand; other columns never matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import id_remainder, map_arrow, rows_of, whole_text

BUCKET_BITS = 16
ORDERS = 5
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.01
OUT_OF_SCRIPT = -40.0
MIN_SHARE = 0.5
CACHE_WORDS = 300_000
FOLD_WORDS = 8192

# First code point of ranges of scripts, in order.
SCRIPT_RANGES = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
                 (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"),
                 (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
                 (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
                 (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
                 (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"))
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))
_STARTS = np.array([a for a, _ in SCRIPT_RANGES], dtype=np.uint32)
_SCRIPT_OF = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def letters_of(token: str) -> str:
    """The token's letters, lower-cased."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words, ends counting as a letter."""
    chars = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "replace"),
                          dtype="<u4").astype(np.uint64)
    ends = chars == 10
    owner = np.cumsum(ends) - 1
    owners, buckets = [], []
    code = np.zeros(len(chars), dtype=np.uint64)
    inside = ~ends
    for n in range(1, ORDERS + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(1000003) + chars[n - 1:] + np.uint64(n)
        good = ~ends[:m] if n == 1 else np.ones(m, dtype=bool)
        for i in range(1, n - 1):
            good &= inside[i:i + m]
        if n == 2:
            good &= inside[:m] | inside[1:1 + m]
        owners.append(owner[:m][good])
        buckets.append(((code[good] * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    real = owners < len(words)      # the last end starts no word
    return owners[real], buckets[real]


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], dtype=np.uint32)
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass(frozen=True, eq=False)
class LanguageModel:
    """``table``: log probabilities by bucket and language; ``allowed``: script by language."""

    languages: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores by word and language."""
        owner, bucket = ngram_buckets(words)
        out = np.stack([np.bincount(owner, weights=column[bucket], minlength=len(words))
                        for column in self.table.T], axis=1) / ORDERS
        allowed = self.allowed[scripts_of(words)]
        known = allowed.any(axis=1, keepdims=True)
        return out + np.where(allowed | ~known, 0.0, OUT_OF_SCRIPT)


def learn(docs: DataFrame) -> LanguageModel:
    """Counts over all rows of ``docs`` with a language; collected are
    languages x 2**BUCKET_BITS sums, whatever the input's size."""
    count_ddl = "lang string, kind string, bucket int, n double"
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bucket", pa.int32()),
                        ("n", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang):
            grams, scripts = sums.setdefault(
                lang, (np.zeros(1 << BUCKET_BITS), np.zeros(len(SCRIPTS))))
            merged: Counter = Counter()
            for token, n in seen.pop(lang).items():
                if word := letters_of(token):
                    merged[word] += n
            every, counts = list(merged), np.array(list(merged.values()), dtype=float)
            for first in range(0, len(every), FOLD_WORDS):     # n-grams of few words at a time
                words, n = every[first:first + FOLD_WORDS], counts[first:first + FOLD_WORDS]
                owner, bucket = ngram_buckets(words)
                grams += np.bincount(bucket, weights=n[owner], minlength=len(grams))
                scripts += np.bincount(scripts_of(words), weights=n, minlength=len(scripts))

        for lang, text in rows_of(batches, "lang", "text"):
            words = seen.setdefault(lang, Counter())
            words.update(text.split())
            if len(words) > CACHE_WORDS // 4:
                fold(lang)
        for lang in list(seen):
            fold(lang)
        for lang, pair in sums.items():
            for kind, counts in zip(("gram", "script"), pair):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at)),
                     pa.array(at, pa.int32()), pa.array(counts[at], pa.float64())],
                    schema=schema)

    known = docs.filter(F.col("lang").isNotNull()).select("lang", whole_text().alias("text"))
    sums = (map_arrow(known, count, count_ddl).groupBy("lang", "kind", "bucket")
            .agg(F.sum("n").alias("n"))
            .groupBy("lang", "kind")
            .agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).collect())
    languages = tuple(sorted({r["lang"] for r in sums}))
    grams = np.zeros((1 << BUCKET_BITS, len(languages)))
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    for r in sums:
        into = grams if r["kind"] == "gram" else scripts
        into[np.array(r["at"]), languages.index(r["lang"])] = r["n"]
    smooth = grams + 0.5
    table = np.log(smooth / smooth.sum(axis=0, keepdims=True)) if languages else grams
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return LanguageModel(languages, table, share >= SCRIPT_SHARE)


def viterbi(scores: np.ndarray, penalty: float) -> list[int]:
    """The best label of each row when each change of label costs ``penalty``."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)
    runs = gain - low       # the best run that ends here
    if runs.max() <= penalty and gain.max() + runs[-1].max() <= penalty:
        return [best] * len(scores)
    held = [0.0] * scores.shape[1]
    back: list[tuple[int, list[bool]]] = []
    for row in scores.tolist():
        top = max(held)
        at, floor = held.index(top), top - penalty
        back.append((at, [h < floor for h in held]))
        held = [(h if h >= floor else floor) + s for h, s in zip(held, row)]
    state = held.index(max(held))
    path = [0] * len(back)
    for i in range(len(back) - 1, -1, -1):
        path[i] = state
        at, jumped = back[i]
        if jumped[state]:
            state = at
    return path


class _Labeller:
    """Scores of tokens, kept for the words that come again."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))
        self.used = 1            # row 0: tokens without letters

    def places(self, tokens: list[str]) -> list[int]:
        if len(self.place) > CACHE_WORDS:
            self._reset()
        get = self.place.get
        out = [get(t) for t in tokens]
        if None in out:
            self._add({t for t, p in zip(tokens, out) if p is None})
            out = [self.place[t] for t in tokens]
        return out

    def _add(self, tokens: set[str]):
        words = {t: letters_of(t) for t in tokens}
        lettered = [t for t, w in words.items() if w]
        for t in tokens:
            self.place[t] = 0
        if not lettered:
            return
        need = self.used + len(lettered)
        if need > len(self.rows):
            grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]))
            grown[:self.used] = self.rows[:self.used]
            self.rows = grown
        self.rows[self.used:need] = self.model.word_scores([words[t] for t in lettered])
        self.place.update(zip(lettered, range(self.used, need)))
        self.used = need

    def label(self, text: str, penalty: float) -> tuple[str, float, list[dict]]:
        tokens = text.split()
        at = np.array(self.places(tokens), dtype=np.int64)
        lettered = at > 0
        if not lettered.any() or not self.model.languages:
            return "und", 0.0, []
        path = np.array(viterbi(self.rows[at], penalty))
        votes = np.bincount(path[lettered], minlength=len(self.model.languages))
        best = int(votes.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        spans = [{"lang": self.model.languages[path[a]], "first_word": a, "end_word": b}
                 for a, b in zip(cuts, cuts[1:])]
        return self.model.languages[best], float(votes[best] / votes.sum()), spans


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())])
_SPAN_DDL = "array<struct<lang string, first_word int, end_word int>>"


def identify(docs: DataFrame, model: LanguageModel,
             penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score and spans (words as ``str.split`` cuts them)."""
    names = {"lang_pred", "score", "spans"}
    if clash := names & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(sent.value)
        for batch in batches:
            found = [labeller.label(t or "", penalty) for t in batch.column("text").to_pylist()]
            langs, scores, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(_SPAN))],
                names=[*batch.schema.names, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, label, f"{fields}, lang_pred string, score double, spans {_SPAN_DDL}")


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_spans."""
    rest = id_remainder("doc_id", 5)
    model = learn(docs.filter(rest != 0).select("lang", "text"))
    found = identify(docs.select("doc_id", (rest == 0).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


def keep_identified(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents of which at least ``min_share`` of the lettered words are in one
    language, with the columns they came with."""
    rest = id_remainder("doc_id", 5)
    model = learn(docs.filter(rest != 0).select("lang", "text"))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    found = identify(held, model)
    return (found.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_share))
            .select("row.*"))
