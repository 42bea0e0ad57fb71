"""Toxicity by a factorization machine over hashed terms.

Besides a weight per term the model learns a short vector per term, whose
products score pairs: an insult next to the mention of a group can weigh more
than both alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch, free

#: Labelled rows the model is fitted to at most, of either class; chosen by a hash of the id.
SAMPLE_PER_CLASS = 8_000

#: Terms whose place in the model a worker remembers before it starts afresh.
KEPT = 500_000

#: Documents whose terms make one batch, whatever the size of the batch they came in.
ROWS = 256

#: Besides a whole word, its first so many letters are terms, so that inflected forms share weights.
OPENINGS = (3, 4, 5)

# ASCII letters in lower case and all bytes beyond ASCII make words; the rest parts them.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct words of a whole text in lower case; a null text has none."""
    return set((text or "").lower().encode().translate(_LETTERS).split())


def terms(word: bytes) -> list[int]:
    """The hashed terms of a word, among 2**48, so that they hardly ever take each other's weights."""
    letters = word.decode()
    spelled = [word, *[f"{n} {letters[:n]}".encode() for n in OPENINGS if n <= len(letters)]]
    return [zlib.crc32(t) | (zlib.adler32(t) & 0xFFFF) << 32 for t in spelled]


def document_terms(text: str | None) -> list[int]:
    """The distinct hashed terms of a text, in order."""
    return sorted({t for word in words(text) for t in terms(word)})


@dataclass(frozen=True)
class Settings:
    """``factors`` numbers per term for the pairs; only terms whose presence and the label depend on
    each other (chi-square with Yates' correction of at least ``evidence``) enter; AdaGrad in
    ``epochs`` passes with batches of ``batch`` documents."""

    factors: int = 4
    evidence: float = 10.0
    epochs: int = 12
    batch: int = 64
    rate: float = 0.2
    shrink: float = 2e-3
    start: float = 0.02
    seed: int = 7


@dataclass
class Machine:
    """keys: known hashed terms in order; weight and vectors by their position; bias."""

    keys: np.ndarray
    weight: np.ndarray
    vectors: np.ndarray
    bias: float

    def raw(self, places: np.ndarray) -> float:
        """Log-odds for the terms at ``places``."""
        if not len(places):
            return self.bias
        v = self.vectors[places]
        pairs = (v.sum(0) ** 2 - (v**2).sum(0)).sum() / 2
        return float(self.bias + self.weight[places].sum() + pairs)

    def score(self, places: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.raw(places), -40, 40))))


def fit(documents: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> Machine:
    """A machine fitted to hashed terms of documents and their 0/1 labels.

    Both classes weigh alike up to a factor of eight.  Without documents, or
    with one class only, the model is a bias at the smoothed share of the label.
    """
    n, ones = len(labels), int(labels.sum())
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    empty = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, settings.factors)), bias)
    if not 0 < ones < n:
        return empty
    keys, where = np.unique(np.concatenate(documents), return_inverse=True)
    counts = np.bincount(where, minlength=len(keys))
    toxic = np.bincount(where, np.repeat(labels, [len(d) for d in documents]), len(keys))
    off = np.maximum(np.abs(toxic * n - counts * ones) - n / 2, 0.0)
    spread = np.maximum(counts * (n - counts) * (ones * float(n - ones)), 1.0)
    keys = keys[n * off**2 / spread >= settings.evidence]  # as in _evidence
    if not len(keys):
        return empty
    rows = []
    for d in documents:
        at = np.searchsorted(keys, d)
        at[at == len(keys)] = 0
        rows.append(at[keys[at] == d] if len(d) else at)
    rng = np.random.default_rng(settings.seed)
    w, v = np.zeros(len(keys)), rng.normal(0, settings.start, (len(keys), settings.factors))
    gw, gv, gb = np.full(len(keys), 1e-2), np.full(v.shape, 1e-2), 1e-2
    heavy = min(8.0, (n - ones) / ones)
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for start in range(0, n, settings.batch):
            some = order[start : start + settings.batch]
            lengths = np.array([len(rows[i]) for i in some])
            at = np.concatenate([rows[i] for i in some])
            own = np.repeat(np.arange(len(some)), lengths)
            vs = v[at]
            sums = np.stack([np.bincount(own, vs[:, f], len(some)) for f in range(v.shape[1])], axis=1)
            squares = np.bincount(own, (vs**2).sum(1), len(some))
            raw = bias + np.bincount(own, w[at], len(some)) + ((sums**2).sum(1) - squares) / 2
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[some]
            error *= np.where(labels[some] == 1, heavy, 1.0)
            used, back = np.unique(at, return_inverse=True)
            step = np.bincount(back, error[own], len(used)) + settings.shrink * w[used]
            gw[used] += step**2
            w[used] -= settings.rate * step / np.sqrt(gw[used])
            slope = error[own][:, None] * (sums[own] - vs)
            for f in range(v.shape[1]):
                step = np.bincount(back, slope[:, f], len(used)) + settings.shrink * v[used, f]
                gv[used, f] += step**2
                v[used, f] -= 0.25 * settings.rate * step / np.sqrt(gv[used, f])
            step = error.sum()
            gb += step**2
            bias -= settings.rate * step / np.sqrt(gb)
    return Machine(keys, w, v, float(bias))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _evidence(toxic: Column, count: Column, n: int, ones: int) -> Column:
    """Chi-square with Yates' correction of a term in ``count`` of ``n`` documents, ``toxic`` of them toxic."""
    count, toxic = count.cast("double"), toxic.cast("double")
    off = F.greatest(F.abs(toxic * n - count * ones) - n / 2, F.lit(0.0))
    spread = F.greatest(count * (F.lit(float(n)) - count) * float(ones * (n - ones)), F.lit(1.0))
    return F.lit(float(n)) * off * off / spread


def _hashed_terms(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), ROWS):  # terms take several times the room of their text
                frame = whole.iloc[at : at + ROWS]
                yield frame.drop(columns="text").assign(terms=[document_terms(text) for text in frame["text"]])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInPandas(run, ", ".join([*rest, "terms array<bigint>"]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    per_class: int = SAMPLE_PER_CLASS,
    settings: Settings = Settings(),
) -> Machine:
    """Fit to at most ``per_class`` labelled documents of either class that aren't held out.

    The sample depends on ids only.  An id labelled twice counts as toxic if any
    label says so; null ids and null labels are left out; of documents that
    share an id and label one is taken.  Terms are counted and screened before
    anything comes to the driver, which gets the telling terms of the sample only.
    """
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [
        marked.filter(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for side in (0, 1)
    ]
    sample = scratch.write(parts[0].union(parts[1]), "sample")
    # proven size: two classes of per_class rows with an id and a label
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = scratch.write(_hashed_terms(own), "terms")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")).first()
    counted = found.select(F.explode("terms").alias("term"), "toxic").groupBy("term")
    counted = counted.agg(F.count(F.lit(1)).alias("count"), F.sum("toxic").alias("toxic"))
    telling = _evidence(F.col("toxic"), F.col("count"), size["n"], size["ones"] or 0) >= settings.evidence
    keys = np.sort(counted.filter(telling).select("term").toArrow().column("term").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def screen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [t[np.isin(t, shared.value)] for t in frame["terms"].map(np.asarray)]
            yield frame.assign(terms=kept)[["doc_id", "toxic", "terms"]]

    screened = found.mapInPandas(screen, "doc_id bigint, toxic int, terms array<bigint>").orderBy("doc_id").toArrow()
    scratch.drop("terms")
    documents = [np.array(row, np.int64) for row in screened.column("terms").to_pylist()]
    return fit(documents, screened.column("toxic").to_numpy().astype(float), settings)


def scored(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with ``to``: the probability of toxicity of each whole text; a column so named is replaced.

    Null and empty texts, and texts without a known term, get the model's bias.
    The model is broadcast; its size is bounded by the sample it was fitted to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place_of = {int(k): i for i, k in enumerate(model.keys)}
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for value in batch.column(text):
                places: set[int] = set()
                for word in words(value.as_py()):
                    at = known.get(word)
                    if at is None:
                        at = known[word] = tuple(place_of[t] for t in terms(word) if t in place_of)
                    places.update(at)
                out.append(model.score(np.array(sorted(places), np.int64)))
            if len(known) > KEPT:
                known = {}
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != to]
            kept.append((to, pa.array(out, pa.float64())))
            yield pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != to]
    return docs.mapInArrow(run, ", ".join([*rest, f"`{to}` double"]))


def scores(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row, by a model trained on ``labels``."""
    machine = train(docs, labels, scratch)
    found = scored(docs.select("doc_id", "text"), machine)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, scratch: Scratch, limit: float = 0.5) -> DataFrame:
    """Documents that score below ``limit``, with their own columns."""
    machine = train(docs, labels, scratch)
    (clash,) = free(docs.columns, "_toxic_score")
    return scored(docs, machine, to=clash).filter(F.col(clash) < limit).drop(clash)
