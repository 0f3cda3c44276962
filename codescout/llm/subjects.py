"""Problem 8: the subjects of each document by seeded non-negative factors of the document-term matrix.

V (documents x terms) is factored into W H by alternating multiplicative updates for the Kullback-Leibler
divergence. Each subject owns one component, anchored on the terms of its labelled documents and its
description; further components hold each language's common words. In this form a document's row of W is
the number of its words that each component explains, so it is read directly as the subject mixture.

Texts are read once; a term is the place of its hash among `BUCKETS`, so every term of every document takes part
and H has at most that many rows, whatever the corpus. A pass over the vectors updates W for each document in its
task and adds up the new H by term before the shuffle; H is the only thing that is sent around. A term that only
one component explains adds its count to that component once and for all; only the others take part in the updates,
and a document leaves them when its mixture no longer moves.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescout.session import cut

#: Places of hashed terms (a power of two).
BUCKETS = 1 << 20
ROUNDS = 4
#: Updates of W in a pass at most, and the change in words below which a mixture no longer moves.
INNER, STILL = 8, 0.005
#: What is added to H, and below which a component has no part in a term.
FLOOR = 1e-9
#: Share of the documents from which on a language has a component for its common words.
LANGUAGE_SHARE = 0.01
#: Codes that stand for no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
#: Least words that a subject must explain, and their least share of what all subjects explain.
MIN_MASS, MIN_SHARE, LONE_MASS = 1.9, 0.09, 0.7
#: Weight of a pair of Chinese characters: a term of two characters touches about three pairs.
PAIR_WEIGHT = 0.35
_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ]?[^\W\d_A-ZÀ-ÖØ-Þ㐀-鿿]+|[A-ZÀ-ÖØ-Þ]+(?![^\W\d_A-ZÀ-ÖØ-Þ])|[㐀-鿿]+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def terms(text: str | None) -> dict[str, float]:
    """Words in lower case, identifiers in their parts, Chinese as overlapping pairs; with their weights."""
    if not text:
        return {}
    found: Counter = Counter()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if "Ã" in text or "â€" in text:
            text = _mend(text)
    for word in _WORD.findall(text):
        if word[0] >= "㐀" and word[0] <= "鿿":
            for i in range(len(word) - 1):
                found[word[i : i + 2]] += PAIR_WEIGHT
        elif len(word) > 2:
            found[word.lower()] += 1
    return found


def _mend(text: str) -> str:
    """UTF-8 that was read as Latin-1, run by run."""

    def back(run: re.Match) -> str:
        try:
            return run[0].encode("cp1252").decode("utf-8")
        except UnicodeError:
            return run[0]

    return re.sub(r"[\u0080-ÿŒ-Ÿˆ˜–-™]{2,}", back, text)


def _place(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS


def _vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, cols, counts) of each document with a text; the places are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lengths, cols, counts = [], [], []
            for text in batch.column(2).to_pylist():
                at: dict[int, float] = {}
                for term, n in terms(text).items():
                    i = known.get(term)
                    if i is None:
                        i = known[term] = _place(term)
                    at[i] = at.get(i, 0) + n
                pairs = sorted(at.items())
                lengths.append(len(pairs))
                cols += [i for i, _ in pairs]
                counts += [n for _, n in pairs]
            if len(known) > BUCKETS:
                known.clear()
            ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(cols, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.float32()))], names=["doc_id", "lang", "cols", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").where("text is not null").mapInArrow(run, "doc_id long, lang string, cols array<int>, counts array<float>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    cols, counts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    lengths = np.diff(cols.offsets.to_numpy())
    return np.repeat(np.arange(len(lengths)), lengths), cols.flatten().to_numpy(), counts.flatten().to_numpy(), len(lengths)


def _term_sums(weighted: DataFrame) -> DataFrame:
    """(key, col, n, df) from (key int, weight double, cols, counts): the counts, 2 at most for each document, and the documents, summed in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols, counts, _ = _flat(batch)
            key, weight = batch.column(0).to_numpy(zero_copy_only=False)[rows], batch.column(1).to_numpy(zero_copy_only=False)[rows]
            at, where = np.unique(key.astype(np.int64) * BUCKETS + cols, return_inverse=True)
            n = np.bincount(where, np.minimum(counts, 2.0) * weight, minlength=len(at))
            yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(n, pa.float64()), pa.array(np.bincount(where, minlength=len(at)), pa.int64())], names=["key", "col", "n", "df"])

    parts = weighted.select("key", "weight", "cols", "counts").mapInArrow(run, "key int, col int, n double, df long")
    return parts.groupBy("key", "col").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


class Model:
    """H on the places that occur (in order), and what of it the updates need."""

    def __init__(self, places: np.ndarray, h: np.ndarray):
        self.places, self.h = places, h.astype(np.float32)
        part = h > 2 * FLOOR
        self.alone = part.sum(1) == 1  # terms of one component
        self.owner = part.argmax(1)

    def mixtures(self, batch: pa.RecordBatch, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """W of a batch for this H, the last shares of each entry, and its row of H."""
        rows, cols, counts, n = _flat(batch)
        cols = np.searchsorted(self.places, cols)
        k = self.h.shape[1]
        share = np.zeros((len(rows), k), np.float32)
        alone = self.alone[cols]
        share[np.flatnonzero(alone), self.owner[cols[alone]]] = counts[alone]
        base = np.bincount(rows[alone] * k + self.owner[cols[alone]], counts[alone], minlength=n * k).reshape(n, k).astype(np.float32)
        w = base + 1
        moving = np.flatnonzero(~alone)  # entries whose documents still move
        hv = self.h[cols[moving]]
        for _ in range(inner):
            if not len(moving):
                break
            of, many = rows[moving], counts[moving]
            part = w[of] * hv
            part *= (many / np.maximum(np.einsum("ij->i", part), 1e-30))[:, None]
            share[moving] = part
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            docs = of[starts]
            new = base[docs] + np.add.reduceat(part, starts, axis=0) + np.float32(FLOOR)
            change = np.abs(new - w[docs]).max(1)
            w[docs] = new
            stays = np.zeros(n, bool)
            stays[docs[change > STILL]] = True
            if stays.sum() < 0.8 * len(docs):
                keep = stays[of]
                moving, hv = moving[keep], hv[keep]
        untouched = np.bincount(rows[~alone], minlength=n) == 0
        w[untouched] = base[untouched]
        return w, share, cols


def _next_h(vectors: DataFrame, model: Model, inner: int) -> np.ndarray:
    """The sums of the shares by term and component, as large as H."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    k = model.h.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.h.shape)
        for batch in batches:
            _, part, cols = sent.value.mixtures(batch, inner)
            for j in range(k):
                total[:, j] += np.bincount(cols, part[:, j], minlength=len(total))
        used = np.flatnonzero(total.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, j], pa.float64()) for j in range(k))], names=["col", *(f"c{j}" for j in range(k))])

    schema = "col int, " + ", ".join(f"c{j} double" for j in range(k))
    summed = vectors.select("cols", "counts").mapInArrow(run, schema).groupBy("col").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k)))
    table = summed.toPandas().to_numpy()  # at most one row for each place
    out = np.zeros(model.h.shape)
    out[table[:, 0].astype(int)] = table[:, 1:]
    sent.unpersist()
    return out


def _by_block(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Columns summing to 1 over the terms of each language, so that a subject weighs the same in each."""
    sums = np.zeros((int(block.max(initial=0)) + 1, values.shape[1]))
    np.add.at(sums, block, values)
    return values / np.maximum(sums, 1e-12)[block]


def _anchored(totals: np.ndarray, subjects: int, block: np.ndarray) -> np.ndarray:
    """H of the sums of a pass. A subject keeps a term only where it explains a fair part of the term's uses."""
    share = totals / np.maximum(totals.sum(1, keepdims=True), 1e-12)
    kept = totals.copy()
    kept[:, :subjects][share[:, :subjects] < 0.12] = 0
    own = block[:, None] == np.arange(totals.shape[1] - subjects)[None, :]
    kept[:, subjects:] *= own * np.where(share[:, :subjects].sum(1) > 0.6, 0.25, 1.0)[:, None]
    return _by_block(kept, block) + FLOOR


def fit_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> tuple[list[str], Model, DataFrame]:
    """(subject names, model, document vectors). All documents, all labels and all terms take part."""
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().collect())  # a fixed small table
    vectors = cut(_vectors(docs))
    k = len(names)
    share = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))  # a row for each language
    frequent = share.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*NO_LANGUAGE) & (F.col("n") >= LANGUAGE_SHARE * F.col("all"))).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in frequent] or [""]
    number = lambda values, name: F.coalesce(*(F.when(F.col(name) == x, F.lit(i)) for i, x in enumerate(values)), F.lit(0)).alias("key")

    common_sums = _term_sums(vectors.select(number(languages, "lang"), F.lit(1.0).alias("weight"), "cols", "counts")).toPandas().to_numpy()  # languages x places at most
    places = np.unique(common_sums[:, 1].astype(np.int64))
    n = max(1, len(places))
    common, seed = np.zeros((n, len(languages))), np.zeros((n, k))
    common[np.searchsorted(places, common_sums[:, 1].astype(np.int64)), common_sums[:, 0].astype(int)] = common_sums[:, 2]
    # Labelled documents count the more for a subject the fewer other subjects they have.
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject").where("doc_id is not null and subject is not null").distinct()
    per_doc = label.groupBy("doc_id").agg(F.collect_set("subject").alias("set")).select("doc_id", (1.0 / F.size("set")).alias("weight"), F.explode("set").alias("subject")).where(F.col("subject").isin(*names))
    if names:
        sums = _term_sums(vectors.join(per_doc, "doc_id").select(number(names, "subject"), "weight", "cols", "counts")).toPandas().to_numpy()  # subjects x places at most
        seed[np.searchsorted(places, sums[:, 1].astype(np.int64)), sums[:, 0].astype(int)] = sums[:, 2]
    for r in subjects.select("subject", "description").collect():
        for t, c in (terms(r["description"]) | terms(r["subject"])).items():
            at = np.searchsorted(places, _place(t))
            if at < len(places) and places[at] == _place(t) and r["subject"] in names:
                seed[at, names.index(r["subject"])] += 0.2 * c
    if not len(places):
        places = np.zeros(1, np.int64)
    # Terms of a single document, and those that a subject has no more often than the corpus has, are no anchors.
    seed[np.bincount(np.searchsorted(places, common_sums[:, 1].astype(np.int64)), common_sums[:, 3], minlength=n)[:n] < 2] = 0
    block = np.argmax(common / np.maximum(common.sum(0, keepdims=True), 1e-9), axis=1)
    rate = _by_block(seed, block)
    usual = _by_block(common.sum(1, keepdims=True), block)
    others = (rate.sum(1, keepdims=True) - rate) / max(k - 1, 1)
    lift = rate / np.maximum(others + 0.5 * usual, 1e-12)
    least = min(2.0, 1 + 0.2 * k)  # few subjects leave less room above the average
    seed = np.where((lift > least) & (seed >= 0.5), seed * (1 - 0.75 * least / np.maximum(lift, least)), 0)
    scale = common.sum() / max(seed.sum(), 1e-9) * 0.3
    model = Model(places, _anchored(np.hstack([seed * scale, common]), k, block))
    for _ in range(rounds):
        model = Model(places, _anchored(_next_h(vectors, model, INNER), k, block))
    return names, model, vectors


def subject_mixtures(docs: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, mass, share): the words of each document that each subject explains.

    One row for each document and subject with a mass of at least 0.2. Null, empty and blank texts and texts
    without a known term have no row. Labels may be wrong, repeated or missing; without any label the
    descriptions of the subjects are the only anchors.
    """
    names, model, vectors = fit_subjects(docs, labels, subjects, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _, _ = sent.value.mixtures(batch, 2 * INNER)
            w = w[:, :k]
            share = w / np.maximum(w.sum(1, keepdims=True), 1e-9)
            row, col = np.nonzero(w >= 0.2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([names[j] for j in col], pa.string()), pa.array(w[row, col].astype(np.float64)), pa.array(share[row, col].astype(np.float64))], names=["doc_id", "subject", "mass", "share"])

    return vectors.select("doc_id", "cols", "counts").mapInArrow(run, "doc_id long, subject string, mass double, share double")


def find_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, min_mass: float = MIN_MASS, min_share: float = MIN_SHARE, lone_mass: float = LONE_MASS) -> DataFrame:
    """(doc_id, subject): what each text deals with; a subject of which one word occurs in passing is left out.

    A subject counts from `min_mass` words and `min_share` of the words of all subjects on, or from
    `lone_mass` words where no other subject has a say.
    """
    mix = subject_mixtures(docs, labels, subjects)
    enough = ((F.col("mass") >= min_mass) & (F.col("share") >= min_share)) | ((F.col("mass") >= lone_mass) & (F.col("share") >= 0.75))
    return mix.where(enough).select("doc_id", "subject").distinct()
