"""Language identification by words, backing off to character n-grams.

A known word scores with the logarithm of its frequency in each language.  A word that the model
has not seen is cut into n-grams: those of the greatest length at which the model knows any of its
n-grams are averaged.  Sums over the words of a text, plus the logarithm of the language's share of
the training rows, are turned into probabilities.

Edge cases: a text that is null or has no letter gives ``und`` with score 0.  Rows without text or
label are not learned from.  A text whose words and letters are all unknown gets the most frequent
language with that language's share as its score; ties go to the smaller language name.
An empty training table gives ``und`` for all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import free
from rillgrid.session import ship
from rillgrid.staging import settle

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
FIT_ROWS = 20_000  # training rows of a language, chosen by a hash; the bound of the sample
WORDS = 60_000  # known words; further ones are left to the n-grams
GRAMS = 20_000  # n-grams of each length
_RUN = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 20


def letter_runs(text: str) -> Counter:
    """Lower-case runs of letters and how often each occurs; long texts are read in pieces."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        found.update(_RUN.findall(text[at:end].lower()))
        at = end
    odd = [w for w in found if not w.isalpha()]  # digits of other scripts count as word characters for re
    for w in odd:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: of words as rows of ``table``, of n-grams by length."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    table: np.ndarray
    grams: dict[int, dict[str, np.ndarray]]
    _seen: dict[str, np.ndarray] = field(default_factory=dict)

    def backed_off(self, word: str) -> np.ndarray:
        """The mean over the longest n-grams of an unseen word of which any is known."""
        row = self._seen.get(word)
        if row is not None:
            return row
        row = np.zeros(len(self.langs))
        for n in LENGTHS:
            get = self.grams[n].get
            known = [r for g in grams_of(word, n) if (r := get(g)) is not None]
            if known:
                row = sum(known) / len(known)
                break
        if len(word) <= 40:
            if len(self._seen) >= 50_000:
                self._seen.clear()
            self._seen[word] = row
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = letter_runs(text) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        total = self.prior.copy()
        at, times = [], []
        get = self.words.get
        for word, n in counts.items():
            i = get(word)
            if i is None:
                total += n * self.backed_off(word)
            else:
                at.append(i)
                times.append(n)
        if at:
            total += np.array(times, dtype=float) @ self.table[at]
        shares = np.exp(total - total.max())
        shares /= shares.sum()
        best = int(np.argmax(shares))
        return self.langs[best], float(shares[best])


def _counted(of):
    """Turn rows of (lang, ...) into counts per batch: (lang, unit, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for row in batch.itertuples(index=False):
                of(found.setdefault(row[0], Counter()), row)
            for lang, counts in found.items():
                yield pd.DataFrame({"lang": lang, "unit": list(counts.keys()), "n": list(counts.values())})

    return run


def _add_words(counts: Counter, row) -> None:
    counts.update(letter_runs(row[1]))


def _add_grams(counts: Counter, row) -> None:
    for n in LENGTHS:
        for g in grams_of(row[1], n):
            counts[f"{n}{g}"] += row[2]


def _rows(counts: DataFrame, langs: list[str], limit: int) -> tuple[list[str], np.ndarray]:
    """The ``limit`` units with the greatest share in any language, and their log frequencies."""
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return [], np.zeros((0, len(langs)))
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("lang"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)]), F.col("lang"))
    best = (
        counts.select("unit", "n", share.alias("share"), place.alias("place")).groupBy("unit")
        .agg(F.max("share").alias("share"), F.collect_list("place").alias("places"), F.collect_list("n").alias("ns"))
        .orderBy(F.desc("share"), "unit").limit(limit).select("unit", "places", "ns").toPandas()
    )
    found = np.zeros((len(best), len(langs)))
    row = np.repeat(np.arange(len(best)), best["places"].map(len).to_numpy(dtype=np.int64))
    if len(best):
        found[row, np.concatenate(best["places"].to_numpy())] = np.concatenate(best["ns"].to_numpy())
    floor = np.array([totals.get(x, 0) + 0.5 * len(best) for x in langs])
    return best["unit"].tolist(), np.log((found + 0.5) / floor)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learn from the rows of ``docs`` that have a text and a label, at most about ``fit_rows`` of each label.

    Counting runs on Spark; the driver keeps ``words`` words and ``grams`` n-grams of each length.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {n: {} for n in LENGTHS})
    langs = sorted(sizes)
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, fit_rows / n)]), F.col("lang"))
    chosen = rows.where((F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < rate * (1 << 20))).select("lang", "text")
    counts = settle(
        chosen.mapInPandas(_counted(_add_words), "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "words"
    )
    pieces = settle(
        counts.mapInPandas(_counted(_add_grams), "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
        .withColumn("size", F.substring("unit", 1, 1).cast("int")).withColumn("unit", F.substring("unit", 2, 9)), "grams"
    )
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    names, table = _rows(counts, langs, words)
    by_length = {n: dict(zip(*_rows(pieces.where(F.col("size") == n).drop("size"), langs, grams), strict=True)) for n in LENGTHS}
    return Model(langs, prior, {w: i for i, w in enumerate(names)}, table, by_length)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the fields ``lang_pred`` and ``score`` for each whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in texts:
            yield pd.DataFrame([known.predict(t) for t in batch], columns=["lang_pred", "score"])

    return guess(F.col(f"`{text}`"))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    guess = free(docs, "guess")[0]
    return docs.select(*kept, predicted(docs, model, text).alias(guess)).select(*kept, f"{guess}.lang_pred", f"{guess}.score")
