"""Document fingerprints by randomised edit embedding.

A walk reads a text's characters; at each step a shared random bit of (step, character) says whether it moves on. Two texts
a few edits apart fall into step again after each edit, so their walks agree almost everywhere: edit distance becomes Hamming
distance. The fingerprint keeps the symbols at sampled steps, as many in each octave of steps, so that texts of any length
compare. Bands of sampled bits propose pairs, and the likeness of the fingerprints verifies them.

Edge cases: null is read as empty; the fingerprint of the empty text is empty, and like only itself; equal texts have equal
fingerprints; repeated rows and equal ids come next to each other, by hash of the text; rows without an id come last; an
empty table gives an empty result; ids are whole numbers, or texts of them; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, text_or_empty, written
from .simhash import components, whole_groups

PER_OCTAVE = 24
_rng = np.random.default_rng(20240229)
MOVES = _rng.integers(0, 2, 1 << 16).astype(np.int32)


def _samples() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in order and how many steps each stands for."""
    steps, weights = [], []
    for k in range(32):
        lo = (1 << k) - 1
        n = min(1 << k, PER_OCTAVE)
        at = np.sort(_rng.choice(1 << k, n, replace=False)) if k < 20 else np.unique(_rng.integers(0, 1 << k, n))
        steps.append(lo + at)
        weights.append(np.full(len(at), (1 << k) / len(at)))
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = _samples()
#: Which samples make a band: 20 bands of 3 samples each from early octaves on, drawn anew for each band.
BANDS = [np.sort(_rng.choice(len(STEPS[:120]), 3, replace=False)) for _ in range(20)]


#: Walks up to which each goes on alone: a step of all together costs about as much as one of so many apart.
FEW = 24


def _shifts(step: int, n: int) -> np.ndarray:
    return (mix(np.arange(step, step + n, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _alone(symbol: np.ndarray, key: np.ndarray, pos: int, end: int, step: int, sample: int, out: np.ndarray) -> int:
    """The rest of one walk, sampled into ``out``; how many samples it has."""
    moves, keys, wanted, taken = MOVES.astype(np.uint8).tobytes(), memoryview(key), STEPS, sample
    while pos < end:
        n = min(4096, int(wanted[sample]) - step, end - pos)
        for shift in _shifts(step, n).tolist():
            pos += moves[keys[pos] + shift & 0xFFFF]
        step += n
        if step == wanted[sample] and pos < end:
            out[sample] = symbol[pos]
            sample = taken = sample + 1
    return taken


def embed(texts: list[str]) -> list[bytes]:
    """One byte for each sampled step that a text's walk takes; all texts walk side by side, the last few apart."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join([texts[i] for i in order] + ["\0" * 64]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(np.concatenate([[0], sizes[order]]))
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint32)
    before[starts[:-1]] = 0
    symbol = ((codes * np.uint32(2654435761) + before * np.uint32(2246822519)) >> np.uint32(24)).astype(np.uint8)
    key = ((codes * np.uint32(3266489917)) >> np.uint32(16)).astype(np.uint16)
    pos, end, who = starts[:-1].copy(), starts[1:], np.arange(len(texts))
    live = pos < end
    pos, end, who = pos[live], end[live], who[live]
    out, taken = np.zeros((len(texts), len(STEPS)), np.uint8), np.zeros(len(texts), np.int64)
    step, sample, wanted = 0, 0, STEPS.tolist()
    while len(pos) > FEW:
        for shift in _shifts(step, 32):
            if step == wanted[sample]:
                ok = pos < end
                out[who[ok], sample] = symbol[pos[ok]]
                sample += 1
                taken[who[ok]] = sample
            pos += MOVES[key[pos] + shift]
            step += 1
        ok = pos < end
        if not ok.all():
            pos, end, who = pos[ok], end[ok], who[ok]
    for p, e, i in zip(pos.tolist(), end.tolist(), who.tolist()):
        taken[i] = max(taken[i], _alone(symbol, key, p, e, step, sample, out[i]))
    result = [b""] * len(texts)
    for row, i in enumerate(order.tolist()):
        result[i] = out[row, : taken[row]].tobytes()
    return result


def likeness(a: bytes, b: bytes) -> float:
    """Share of the steps of the longer walk at which both have the same symbol, from 0 to 1."""
    n, m = min(len(a), len(b)), max(len(a), len(b))
    if not m:
        return 1.0
    same = np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n)
    return float((WEIGHTS[:n] * same).sum() / WEIGHTS[:m].sum())


def bands(print_: bytes) -> list[tuple[int, bytes]]:
    """Band number and sampled bits, for bands that the walk reaches; texts that share one are candidates."""
    a = np.frombuffer(print_, np.uint8)
    return [(k, a[at].tobytes()) for k, at in enumerate(BANDS) if at[-1] < len(a)]


#: How many samples the octaves below each one have.
FULL = np.cumsum([0, *(int(((STEPS >= (1 << k) - 1) & (STEPS < (2 << k) - 1)).sum()) for k in range(32))])


def _level_bands(level: int, tables: int = 20, each: int = 3) -> list[np.ndarray]:
    """Samples of each of a level's bands, drawn from all its octaves by how many steps they stand for."""
    w = WEIGHTS[: FULL[level]]
    return [np.random.default_rng((level, t)).choice(len(w), each, p=w / w.sum()) for t in range(tables)]


LEVELS = {k: _level_bands(k) for k in range(1, 33)}


def keys(print_: bytes, least: float = 0.8) -> list[int]:
    """Hashes of the bands by which texts of a likeness of ``least`` or more find each other.

    A level is all octaves below one that the walk has passed. Alike walks differ in length by ``1 / least`` at most, so each takes part in as many
    levels from its highest down as have one in common; that level holds half of the walk or more.
    """
    a = np.frombuffer(print_, np.uint8)
    top = int(np.searchsorted(FULL, len(a), "right")) - 1
    levels = range(max(1, top - int(np.ceil(np.log2(1 / least)))), top + 1)
    return [xxhash.xxh64_intdigest(a[at].tobytes(), 64 * k + t) - (1 << 63) for k in levels for t, at in enumerate(LEVELS[k])]


def alike_forest(prints: list[bytes], least: float, side: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each one's component, for 0 .. n-1, linked by a likeness of ``least`` or more; with ``side`` only between sides."""
    n = np.fromiter(map(len, prints), np.int64, len(prints))
    total = np.concatenate([[0], np.cumsum(WEIGHTS)])
    table = np.zeros((len(prints), n.max()), np.uint8)
    for row, p in zip(table, prints):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    label = np.arange(len(prints))
    for a in range(len(prints) - 1):
        b = np.arange(a + 1, len(prints))
        b = b[(label[b] != label[a]) & (True if side is None else side[b] != side[a])]
        short, long = total[np.minimum(n[b], n[a])], total[np.maximum(n[b], n[a])]
        b, long = b[short >= least * long - 1e-9], long[short >= least * long - 1e-9]
        if len(b):
            same = (table[b, : n[a]] == table[a, : n[a]]) & (np.arange(n[a]) < n[b][:, None])
            b = b[same @ WEIGHTS[: n[a]] >= least * long - 1e-9]
            joined = np.unique(np.append(label[b], label[a]))
            label[np.isin(label, joined)] = joined[0]
    return label


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by the first characters of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"


def _compare(ids: list, texts: list[str], prints: list[bytes], others: list[str]) -> list[tuple]:
    """Rows for all texts but the last, each followed by the next."""
    changed = [edited(t, o) for t, o in zip(texts, others)]
    marks = embed(changed)
    out = []
    for i, t, p, e, m, q in zip(ids, texts, prints, changed, marks, prints[1:]):
        common = len(set(bands(p)) & set(bands(m)))
        out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), base64.b64encode(p).decode(), base64.b64encode(m).decode(), likeness(p, m), likeness(p, q), common))
    return out


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document (see the contract of op3): its fingerprint, that of its edited text, and how near they and the next document are.

    Documents are dealt out by ranges of ids (bounds from one approximate-percentile pass), so neighbours are in one place; an id that
    several bounds fall on, and documents without an id, are dealt by ranges of their texts' hashes.
    A range's first and last documents are kept and matched with the neighbouring ranges afterwards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else []
    bounds, often = np.unique(np.array(bounds or [], np.int64), return_counts=True)

    def deal(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for df in chunks:
            known, ids = df["doc_id"].notna().to_numpy(), df["doc_id"].fillna(0).astype(np.int64).to_numpy()
            at = np.searchsorted(bounds, ids, "right")
            many = np.full(len(df), n)  # into how many parts rows of an id are dealt
            if len(bounds):
                many = np.where(known, np.where((at > 0) & (bounds[at - 1] == ids), often[at - 1], 1), n)
            share = (df["th"].to_numpy() / 2.0**64 + 0.5) * many
            part = np.where(known, at + 1, 0) * (n + 1) - np.minimum(share.astype(np.int64), many - 1)  # from the last part down, as ids are
            yield pd.DataFrame({"part": part, "doc_id": df["doc_id"].astype("Int64"), "th": df["th"], "z": [z.compress(t.encode()) for t in df["text"]]})

    dealt = rows.mapInPandas(deal, "part int, doc_id long, th long, z binary").repartition("part")
    dealt = dealt.sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), "th")
    schema = f"doc_id long, {RESULT}, part int, side string, z binary, own binary"

    def row(i, part, side, text, print_):
        z = zstandard.ZstdCompressor(level=1).compress(text.encode())
        return pd.DataFrame({"doc_id": pd.Series([i], dtype="Int64"), **{c.split()[0]: None for c in RESULT.split(", ")}, "part": [part], "side": [side], "z": [z], "own": [print_]})

    def result(out: list[tuple]):
        df = pd.DataFrame(out, columns=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])
        df["doc_id"] = df["doc_id"].astype("Int64")
        return df.assign(part=None, side=None, z=None, own=None)

    def compare(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, texts, prints = None, [], [], []  # what is kept: the last document, whose next is to come
        z = zstandard.ZstdDecompressor()

        def blocks():
            for df in chunks:
                at, total = 0, 0
                for k, blob in enumerate(df["z"]):
                    total += zstandard.frame_content_size(blob)
                    if total > 4 << 20:
                        yield df.iloc[at : k + 1]
                        at, total = k + 1, 0
                if at < len(df):
                    yield df.iloc[at:]

        for block in blocks():
            for p, own in block.groupby("part", sort=False):
                new = [z.decompress(x).decode() for x in own["z"]]
                marks, new_ids = embed(new), own["doc_id"].astype(object).where(own["doc_id"].notna(), None).tolist()
                if p != part:
                    if ids:
                        yield row(ids[-1], part, "tail", texts[-1], prints[-1])
                    part, ids, texts, prints = p, [], [], []
                    yield row(new_ids[0], p, "head", new[0], marks[0])
                ids, texts, prints = ids + new_ids, texts + new, prints + marks
                if len(ids) > 1:
                    yield result(_compare(ids[:-1], texts[:-1], prints, texts[1:]))
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if ids:
            yield row(ids[-1], part, "tail", texts[-1], prints[-1])

    done = written(dealt.mapInPandas(compare, schema), "fingerprints")
    order = [r["part"] for r in done.where("side = 'head'").select("part").orderBy(F.desc("part")).collect()]  # one for each range
    following = spark.createDataFrame(list(zip(order, order[1:] + order[:1])), "part int, next int")
    heads = done.where("side = 'head'").select(F.col("part").alias("next"), F.col("z").alias("next_z"), F.col("own").alias("next_own"))
    tails = done.where("side = 'tail'").select("doc_id", "part", "z", "own").join(following, "part").join(heads, "next")

    def close(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for df in chunks:
            out = []
            for i, a, p, b, q in zip(df["doc_id"].astype(object).where(df["doc_id"].notna(), None), df["z"], df["own"], df["next_z"], df["next_own"]):
                out += _compare([i], [z.decompress(a).decode()], [p, q], [z.decompress(b).decode()])
            yield result(out).drop(columns=["part", "side", "z", "own"])

    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
    return done.where("side is null").select(names).unionByName(tails.select("doc_id", "z", "own", "next_z", "next_own").mapInPandas(close, f"doc_id long, {RESULT}"))


def near_pairs(prints: DataFrame, least: float = 0.8, cap: int = 4096) -> DataFrame:
    """``doc_id, class_id`` of ``prints`` (``doc_id, fingerprint``): texts linked by a band and a likeness of ``least`` or more.

    All members of a band are verified against each other and linked by a spanning forest; a band of over ``cap`` is cut into chunks by hash,
    each pair of chunks is one group. A class is named by its smallest ``doc_id``.
    """
    held = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select(F.xxhash64("fingerprint").alias("fp"), "fingerprint", "least"), "held")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            found = [keys(base64.b64decode(p), least) for p in df["fingerprint"]]
            yield pd.DataFrame({"fp": df["fp"].repeat([len(k) for k in found]), "key": np.array([x for k in found for x in k], np.int64)})

    keyed = written(held.select("fp", "fingerprint").mapInPandas(cells, "fp long, key long").distinct(), "cells")
    chunks = F.ceil(F.col("count") / cap).cast("int")
    shared = written(keyed.groupBy("key").count().where("count > 1").select("key", chunks.alias("chunks")), "shared")
    dealt = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.join(held.select("fp", F.unbase64("fingerprint").alias("print")), "fp")
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "print")

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, edge in whole_groups(parts, ["key", "i", "j"]):
            fp, own, i, j, print_ = (df[c].to_numpy() for c in ("fp", "own", "i", "j", "print"))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a > 1:
                    label = alike_forest(print_[a:b].tolist(), least, own[a:b] if i[a] < j[a] else None)
                    got = np.flatnonzero(label != np.arange(b - a))
                    yield pd.DataFrame({"u": fp[a:b][got], "v": fp[a:b][label[got]]})

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    groups = components(ordered.mapInPandas(links, "u long, v long")).withColumnRenamed("v", "fp")
    rooted = written(held.join(groups, "fp", "left").select("fingerprint", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("fingerprint", "class_id")
    return prints.select("doc_id", "fingerprint").join(classes, "fingerprint").select("doc_id", "class_id")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
