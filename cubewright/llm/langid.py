"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds for each slot a mask of languages; the AND over an n-gram's slots gives all languages that
contain it. A document's hits per language, corrected for false positives by how full that language's slice is, and divided
by the rate at which the language's own text hits, decide.

Learning uses a sample of labelled rows bounded by ``per_language`` texts expected of each language, drawn by hash.

Edge cases: null and empty texts and texts without a letter are ``und`` with score 0; rows without a language teach nothing;
ties go to the first language by code point; without any labelled row all is ``und``; repeated rows are judged alike;
an empty table gives an empty result; other columns pass through, but a column that has a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_bytes, mix, small_batches

SIZES = (3, 4)
#: Bytes of an n-gram: letters in lower case and all bytes of other scripts; anything else is a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123], FOLD[65:91], FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 3- and 4-byte grams with a letter in the middle, and the text of each."""
    data, ends = joined_bytes([b"  " + t + b"  " for t in raw])
    data = FOLD[data].astype(np.uint64)
    text = np.repeat(np.arange(len(raw)), np.diff(ends))
    codes, of = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        c = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            c = (c << np.uint64(8)) | data[k : k + len(c)]
        ok = (data[1 : 1 + len(c)] != 32) & (text[: len(c)] == text[n - 1 :])
        codes.append(c[ok])
        of.append(text[: len(c)][ok])
    return (np.concatenate(codes), np.concatenate(of)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # masks, 64 languages a column
    false_rate: np.ndarray
    own_rate: np.ndarray
    hashes: int

    def hits(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each text in each language, and how many n-grams it has."""
        codes, of = grams(raw)
        out = np.zeros((len(raw), len(self.languages)))
        mask = lookup(self.slots, codes, self.hashes)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(of, (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), minlength=len(raw))
        return out, np.bincount(of, minlength=len(raw))

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        raw = [(t or "").lower().encode() for t in texts]
        hits, n = self.hits(raw) if self.languages else (np.zeros((len(raw), 1)), np.ones(len(raw)))
        share = (hits / np.maximum(n, 1)[:, None] - self.false_rate) / (1 - self.false_rate)
        best = np.argmax(share / self.own_rate, axis=1)
        score = np.clip(share[np.arange(len(raw)), best], 0, 1)
        und = np.array([not self.languages or not (t and (any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)))) for t in texts], bool)
        return [("und" if u else self.languages[b]) for u, b in zip(und, best)], np.where(und, 0.0, score)


def places(codes: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    h = mix(codes)
    for k in range(hashes):
        yield ((h >> np.uint64(21 * k)) % np.uint64(slots)).astype(np.int64)


def lookup(slots: np.ndarray, codes: np.ndarray, hashes: int) -> np.ndarray:
    mask = None
    for at in places(codes, len(slots), hashes):
        mask = slots[at] if mask is None else mask & slots[at]
    return mask


def held_out(doc_id: Column = None) -> Column:
    """Documents that never teach: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 5 == 0


def learn(rows: DataFrame, per_language: int = 2000, least: int = 3, share: float = 1 / 3, bits: int = 20, hashes: int = 3, most: int = 4096, fewest: int = 1) -> Model:
    """A model from ``text, lang`` of ``rows`` (all of which may teach), of the ``most`` most frequent values of ``lang`` with ``fewest`` rows or more.

    An n-gram belongs to a language if it is seen ``least`` times there, and there at ``share`` of its highest rate at least.
    What comes to the driver is bounded by the sample: n-grams of ``per_language`` texts a language.
    """
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.groupBy("lang").count().where(F.col("count") >= fewest).orderBy(F.desc("count"), "lang").limit(most).collect()
    names = sorted(r["lang"] for r in counts)
    code = {x: i for i, x in enumerate(names)}
    none = Model([], np.zeros((1, 1), np.uint64), np.zeros(1), np.ones(1), hashes)
    if not names:
        return none
    cuts = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, cut double")
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(cuts), "lang").where(draw < F.col("cut")).select("lang", "text")  # ``most`` rows at most

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for lang, own in df.groupby("lang"):
                for k in range(0, len(own), 500):
                    c, n = np.unique(grams([t.lower().encode() for t in own["text"][k : k + 500]])[0], return_counts=True)
                    yield pd.DataFrame({"lang": code[lang], "gram": c.view(np.int64), "n": n})

    got = sample.mapInPandas(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    total = np.maximum(np.bincount(got["lang"], got["n"], minlength=len(names)), 1)
    got["rate"] = got["n"] / total[got["lang"]]
    got["in"] = got["rate"] >= share * got.groupby("gram")["rate"].transform("max")
    slots = np.zeros((1 << bits, -(-len(names) // 64)), np.uint64)
    kept = got[got["in"]]
    for k in range(len(names)):
        for at in places(kept["gram"][kept["lang"] == k].to_numpy().view(np.uint64), len(slots), hashes):
            slots[at, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    full = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    own = np.bincount(kept["lang"], kept["n"], minlength=len(names)) / total
    return Model(names, slots, np.minimum(full**hashes, 0.5), np.maximum(own, 1e-6), hashes)


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score, named by ``into``; only ``text`` is read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    docs = docs.drop(*into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])

    def run(parts: Iterator["pa.RecordBatch"]) -> Iterator["pa.RecordBatch"]:
        import pyarrow as pa

        for batch in parts:
            for k in range(0, len(batch), 500):
                b = batch.slice(k, 500)
                lang, score = shared.value.decide(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
