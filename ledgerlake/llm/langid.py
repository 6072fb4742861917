"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's letters in lower case, all else one space, give hashed 1- to 3-grams; counts are weighed by
inverse document frequency over all training texts, and vectors normalised. For each language a
bounded sample is clustered (spherical k-means) into a few centroids. A text takes the language of the
centroid with the largest cosine; it is rejected when it lies further from it than nearly all of the language's
texts of its length that the clustering hasn't seen, by a margin.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.shared import bounded_batches, free_memory, freed, whole_row

UNDETERMINED = "und"
DIMS = 4096
CLUSTERS = 4
ROUNDS = 10
#: Texts of each language that clustering sees at most; document frequencies cover all.
SAMPLE = 400
#: One text of so many of the sample isn't clustered but shows how far from the centroids a language's texts lie.
HELD = 4
#: A text is rejected below MARGIN times the cosine under which LOWEST of those texts of its length (in powers of two) lie.
MARGIN, LOWEST = 0.8, 0.01
LENGTHS = 24


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """(counts by hashed n-gram [DIMS], letters) of a whole text."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    n = int(letter.sum())
    if not n:
        return np.zeros(DIMS, dtype=np.int64), 0
    points = np.where(letter, points, 32).astype(np.uint32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate((np.array([32], np.uint32), points[keep], np.array([32], np.uint32)))
    shift = np.uint32(32 - 12)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (points[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return sum(np.bincount(h >> shift, minlength=DIMS) for h in (one, two, three)), n


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vectors of rows of counts; zero stays zero."""
    vectors = (counts * idf).astype(np.float32)
    norms = np.sqrt((vectors * vectors).sum(axis=-1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class Model:
    """languages[i] owns centroids[i]; floors[i, b] is the least cosine accepted for texts of 2^b to 2^(b+1) letters."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTHS - 1)


def _clustered(vectors: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, floors) of one language's vectors, in a given order; few vectors are all clustered and all measured."""
    held = np.arange(len(vectors)) % HELD == HELD - 1 if len(vectors) >= 10 * HELD else np.ones(len(vectors), dtype=bool)
    seen = vectors if held.all() else vectors[~held]
    seeds = [0]
    for _ in range(min(CLUSTERS, len(seen)) - 1):  # each next seed is the vector furthest from all before
        seeds.append(int((seen @ seen[seeds].T).max(axis=1).argmin()))
    centroids = seen[sorted(set(seeds))]
    for _ in range(ROUNDS):
        own = (seen @ centroids.T).argmax(axis=1)
        sums = np.stack([seen[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    nearest = (vectors[held] @ centroids.T).max(axis=1)
    classes = _length_class(letters[held])
    least = np.full(LENGTHS, np.nan)
    for b in np.unique(classes):
        least[b] = np.quantile(nearest[classes == b], LOWEST)
    floors = pd.Series(least).ffill().bfill().to_numpy()
    floors = np.minimum.accumulate(floors[::-1])[::-1]  # a shorter text is never held to more than a longer one
    return centroids.astype(np.float32), np.tile(MARGIN * floors, (len(centroids), 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of ``docs`` whose language isn't null and whose text has a letter.

    Document frequencies cover all of them; each language's clusters come from at most SAMPLE texts, those
    with the smallest hash of id and text among a random share, however many rows have no id or the same. Without
    such rows the model knows no language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches):
        found, langs, docs_seen = np.zeros(DIMS, dtype=np.int64), {}, 0
        for batch in batches:
            for text, lang in zip(batch.column(1), batch.column(2).to_pylist()):
                counts, letters = ngram_counts(text.as_py())
                if letters:
                    found += counts > 0
                    docs_seen += 1
                    langs[lang] = langs.get(lang, 0) + 1
        grams = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array([f"g{i}" for i in grams] + [f"l{x}" for x in langs] + ["n"]), pa.array([*found[grams].tolist(), *langs.values(), docs_seen], pa.int64())], ["name", "n"])

    sums = dict(rows.mapInArrow(freed(frequencies), "name string, n long").groupBy("name").agg(F.sum("n")).collect())  # DIMS and languages
    total = sums.pop("n", 0)
    per_lang = {k[1:]: n for k, n in sums.items() if k[0] == "l"}
    df = np.array([sums.get(f"g{i}", 0) for i in range(DIMS)])
    idf = np.log((1 + total) / (1 + df)) + 1
    if not per_lang:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, LENGTHS)))
    share = F.create_map(*(F.lit(x) for lang, n in per_lang.items() for x in (lang, min(1.0, (1.2 * SAMPLE + 20) / n))))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    sample = rows.where((draw < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}")).withColumn("draw", draw)
    sample = sample.withColumn("first", first).where(F.col("first") <= SAMPLE)  # each task keeps no more than SAMPLE of a language

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        counted = [(c, n) for c, n in map(ngram_counts, group["text"]) if n]
        if not counted:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        centroids, floors = _clustered(weighted(np.stack([c for c, _ in counted]), idf), np.array([n for _, n in counted]))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in centroids], "floor": [f.tobytes() for f in floors]})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor binary").toPandas()
    found = found.sort_values(["lang", "centroid"])
    return Model(idf, found["lang"].tolist(), np.stack([np.frombuffer(c, np.float32) for c in found["centroid"]]), np.stack([np.frombuffer(f, np.float64) for f in found["floor"]]))


def predicted(model: Model, text: Column) -> Column:
    """A struct (lang_pred, score, rejected) for each text.

    A null text, one without a letter, or a model without languages gives (und, 0, true). score is the
    cosine, within 0 and 1; equal cosines go to the first language by name.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = [], [], []
        for i in range(0, len(texts), 256):
            counted = [ngram_counts(t) for t in texts[i : i + 256]]
            letters = np.array([n for _, n in counted])
            vectors = weighted(np.stack([c for c, _ in counted]), model.idf)
            near = vectors @ model.centroids.T if len(model.languages) else np.zeros((len(counted), 1), np.float32)
            best = near.argmax(axis=1)
            cosine = np.clip(near[np.arange(len(near)), best].astype(float), 0, 1)
            known = (letters > 0) & bool(model.languages)
            floors = model.floors[best, _length_class(letters)] if len(model.languages) else np.ones(len(counted))
            langs += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
            scores += np.where(known, cosine, 0.0).tolist()
            rejected += (~known | (cosine < floors)).tolist()
        free_memory()
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return predict(text.cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected), one per row of ``docs``; see ``train`` and ``predicted``.

    The model learns from the rows that aren't held out; a null id isn't. Repeated rows come like others, long
    texts count whole, other columns are ignored, and no rows give none.
    """
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predicted(model, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) without the rows whose language is rejected, whole; the model learns from all labelled rows.

    A null text or one without a letter is rejected, as is every text where no row is labelled. Repeated rows
    share their fate; columns of any name stay as they are; no rows give none.
    """
    model = train(docs)
    known = docs.select(whole_row(docs), predicted(model, docs["text"]).alias("p"))
    return known.where(~F.col("p.rejected")).select("row.*")
