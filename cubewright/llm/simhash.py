"""Near duplicates by SimHash: fingerprints within a few bits of each other, and the groups they form.

The Hamming join is dealt out by bit blocks (two fingerprints that differ in ``d`` bits agree on ``m - d`` of ``m`` blocks),
and each bucket is searched with a hierarchical index in Gray order: fingerprints sorted by Gray rank, whose groups carry
the bits that all members share; two groups whose shared bits differ in more than ``d`` places are dropped whole.
A bucket gives the edges of a spanning forest, never all its pairs; Spark then contracts the edges to components.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; repeated
rows are in one component; the id of a component is its smallest ``doc_id`` (null ids count last); an empty table gives
an empty result; ids are whole numbers, or texts of them; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, delete, mix, shared_dir, small_batches, text_or_empty, written

#: Words of 64 bits in a sketch.
WIDE = 5
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    ws = (text or "").encode().translate(LOWER).split()
    joined = b" ".join(ws)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return np.array([digest(joined, seed)] if ws else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """64 bits of which each is set if it is set in over half of ``h``."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    return int(majority(shingle_hashes(text, words, seed)))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def sketch(h: np.ndarray) -> np.ndarray:
    """A fingerprint of ``WIDE`` words of 64 bits, each from its own mix of the hashes ``h`` of a text's different shingles."""
    return np.array([majority(mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))) for k in range(WIDE)], np.uint64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _level(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(low), width)
    return np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


def close_pairs(a: np.ndarray, b: np.ndarray | None, d: int, width: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``d`` bits: between ``a`` and ``b``, or within ``a`` (i < j). Both are in Gray order.

    low/high: AND and OR of a group; where they agree, all members share the bit. Groups are compared from the top down.
    """
    own = b is None
    b = a if own else b

    def tree(x):
        levels = [(x, x)]
        while len(levels[-1][0]) > width:
            levels.append(_level(*levels[-1], width))
        return levels

    ta, tb = tree(a), tree(b)
    depth = max(len(ta), len(tb))
    for t in (ta, tb):
        while len(t) < depth:
            t.append(_level(*t[-1], width))

    def near(k, i, j):
        (la, ha), (lb, hb) = ta[k], tb[k]
        differ = (la[i] ^ lb[j]) & ~(la[i] ^ ha[i]) & ~(lb[j] ^ hb[j])
        return np.bitwise_count(differ) <= d

    def down(k, i, j):
        for at in range(0, len(i), 1 << 9 if k else 1 << 20):
            x, y = i[at : at + (1 << 9)] if k else i, j[at : at + (1 << 9)] if k else j
            if not k:
                yield x, y
                return
            n, m = len(ta[k - 1][0]), len(tb[k - 1][0])
            x2 = (x[:, None, None] * width + np.arange(width)[None, :, None]).repeat(width, 2).ravel()
            y2 = (y[:, None, None] * width + np.arange(width)[None, None, :]).repeat(width, 1).ravel()
            ok = (x2 < n) & (y2 < m)
            if own:
                ok &= x2 <= y2 if k > 1 else x2 < y2
            x2, y2 = x2[ok], y2[ok]
            ok = near(k - 1, x2, y2)
            if ok.any():
                yield from down(k - 1, x2[ok], y2[ok])

    top = depth - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(ta[top][0])), np.arange(len(tb[top][0])), indexing="ij"))
    if own:
        keep = i <= j if top else i < j
        i, j = i[keep], j[keep]
    ok = near(top, i, j)
    if ok.any():
        yield from down(top, i[ok], j[ok])


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each one's component, for 0 .. n-1."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """``v, root``: the smallest node that each node of ``edges`` (``u, v`` long) reaches, by alternating large and small stars."""
    spark, folder = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/edges-{uuid.uuid4().hex}"

    def kept(df: DataFrame, k: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
        return spark.read.schema("u long, v long").parquet(f"{folder}/{k}")

    edges = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
    before = None
    for k in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept(small.where("u <> v").distinct(), k)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def whole_groups(parts: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames that hold whole groups of ``cols``, and where each group starts (one more entry for the end)."""
    waiting = None
    for df in itertools.chain(parts, [None]):
        last = df is None
        if waiting is not None and len(waiting):
            df = waiting if last else pd.concat([waiting, df], ignore_index=True)
        if df is None or not len(df):
            continue
        values = [df[c].to_numpy() for c in cols]
        edge = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in values], axis=0)]))
        edge = np.append(edge, len(df)) if last else edge
        if len(edge) > 1:
            yield df.iloc[: edge[-1]], edge
        waiting = df.iloc[edge[-1] :]


def hamming_groups(prints: DataFrame, bits: int = 4, cap: int = 4096) -> DataFrame:
    """``fp, root`` for the distinct ``fp`` (long) of ``prints`` that have a neighbour within ``bits`` bits."""
    n = prints.count()
    m = bits + 1
    while n >> (64 // m * (m - bits)) > 1000 and m < 2 * bits:  # more, narrower buckets for more fingerprints
        m += 1
    cuts = [64 * k // m for k in range(m + 1)]
    masks = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in kept) for kept in itertools.combinations(range(m), m - bits)]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(x)) for x in signed))).alias("table", "key"))
    large = keyed.groupBy("table", "key").count().where("count > 1")
    chunks = F.ceil(F.col("count") / cap).cast("int")
    # A large bucket is cut into chunks by hash; each pair of chunks is one group.
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(large, ["table", "key"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("table", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, edge in whole_groups(parts, ["table", "key", "i", "j"]):
            fp, own, i, j, us, vs = df["fp"].to_numpy().view(np.uint64), *(df[c].to_numpy() for c in ("own", "i", "j")), [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a < 2:
                    continue
                x = fp[a:b]
                if i[a] == j[a]:
                    x = x[np.argsort(gray_rank(x))]
                    label = forest(len(x), close_pairs(x, None, bits))
                else:
                    first = own[a:b] == i[a]
                    p, q = x[first], x[~first]
                    p, q = p[np.argsort(gray_rank(p))], q[np.argsort(gray_rank(q))]
                    x = np.concatenate([p, q])
                    label = forest(len(x), ((i, j + len(p)) for i, j in close_pairs(p, q, bits)))
                got = np.flatnonzero(label != np.arange(len(x)))
                us.append(x[got])
                vs.append(x[label[got]])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    ordered = dealt.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    return components(ordered.mapInPandas(links, "u long, v long")).withColumnRenamed("v", "fp")


def row_keys(docs: DataFrame, into: tuple[str, str] = ("__id", "__th")) -> DataFrame:
    """``docs`` with two keys, named by ``into``: equal for rows of equal id (null too) and text."""
    return docs.withColumns({into[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), into[1]: F.xxhash64(F.col("doc_id").isNull(), text_or_empty())})


def first_row() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__th"))


def classed(rows: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``root``, ``component_id`` and ``keep``, from the ``first`` row of each ``distinct`` fingerprint and the ``groups`` they form."""
    rooted = distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("least"))
    final = written(rooted.join(ids, "root").select("fp", "root", F.col("least.doc_id").alias("component_id"), F.col("least.__th").alias("kept")), "classes")
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("__th") == F.col("kept"))
    return rows.join(final, "fp").withColumn("keep", keep).drop("kept")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, cap: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, fp`` (long), ``root`` (the component's smallest fingerprint), ``component_id``, and the row's keys.

    ``keep`` marks one document of each component, that of the smallest id (its repeated rows are all marked).
    """
    small_batches(docs.sparkSession)

    def prints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield pd.DataFrame({"doc_id": df["doc_id"], "__id": df["__id"], "__th": df["__th"], "fp": np.array([fingerprint(t, words) for t in df["text"]], np.uint64).view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = row_keys(docs.select("doc_id", "text")).select("doc_id", "__id", "__th", text_or_empty().alias("text"))
    rows = written(texts.mapInPandas(prints, f"doc_id {kind}, __id long, __th long, fp long"), "prints")
    distinct = written(rows.groupBy("fp").agg(first_row().alias("first")), "distinct")
    return classed(rows, distinct, hamming_groups(distinct.select("fp"), bits, cap))


def sketch_links(nodes: DataFrame, similarity: float, recall: float, cap: int = 4096, leaf: int = 64) -> DataFrame:
    """``u, v``: links that connect the rows of ``nodes`` (``fp``, ``w0`` ...) whose sketches differ as little as shingle sets of ``similarity`` do.

    These are candidates: pairs at ``similarity`` pass up to three standard deviations of their sketches, and less similar ones often do too.

    Such sketches differ in a share ``flip`` of their bits. Each of ``tables`` samples ``k`` bits (about a row a bucket by chance), as many tables
    as find a pair with probability ``recall``; both follow from the row count. Buckets are searched in Gray order, then all words are compared.
    """
    flip = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    k = max(8, math.ceil(math.log2(max(nodes.count(), 2))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - flip) ** k))
    most = int(64 * WIDE * flip + 3 * (64 * WIDE * flip * (1 - flip)) ** 0.5)
    masks = np.zeros((tables, WIDE), np.uint64)
    for t in range(tables):
        for bit in np.random.default_rng(t).choice(64 * WIDE, k, replace=False):
            masks[t, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    names = [f"w{i}" for i in range(WIDE)]

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            w = df[names].to_numpy().view(np.uint64)
            for t in range(tables):
                h = np.full(len(w), t, np.uint64)
                for i in range(WIDE):
                    h = mix(h + np.uint64(0x9E3779B97F4A7C15) + (w[:, i] & masks[t, i]))
                yield df.assign(key=h.view(np.int64))

    keyed = nodes.select("fp", *names).mapInPandas(keys, ", ".join(f"{c} long" for c in ["fp", *names, "key"]))
    hot = written(keyed.groupBy("key").count().where(F.col("count") > cap).select("key", F.ceil(F.col("count") / cap).cast("int").alias("chunks")), "hot")
    dealt = keyed.join(bounded(hot, 100_000), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", *names)

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, edge in whole_groups(parts, ["key", "i", "j"]):
            w, own, i, j = df[names].to_numpy().view(np.uint64), *(df[c].to_numpy() for c in ("own", "i", "j"))
            group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            small = np.diff(edge) <= leaf

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                a = np.flatnonzero(small[group])
                for step in range(1, leaf):  # leaves of all small buckets at once
                    a = a[a + step < len(group)]
                    a = a[group[a] == group[a + step]]
                    if not len(a):
                        break
                    yield a, a + step
                for g, word in itertools.product(np.flatnonzero(~small).tolist(), range(WIDE)):  # of ``most`` bits in all, one word has a share at most
                    at = np.arange(edge[g], edge[g + 1])
                    at = at[np.argsort(gray_rank(w[at, word]))]
                    if i[at[0]] == j[at[0]]:
                        p = q = at
                        found = close_pairs(w[p, word], None, most // WIDE)
                    else:
                        p, q = at[own[at] == i[at]], at[own[at] != i[at]]
                        found = close_pairs(w[p, word], w[q, word], most // WIDE) if len(p) and len(q) else iter(())
                    yield from ((p[x], q[y]) for x, y in found)

            def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a, b in pairs():
                    ok = np.bitwise_count(w[a] ^ w[b]).sum(1) <= most
                    yield a[ok], b[ok]

            label, fp = forest(len(df), near()), df["fp"].to_numpy()
            got = np.flatnonzero(label != np.arange(len(df)))
            if len(got):
                yield pd.DataFrame({"u": fp[got], "v": fp[label[got]]})

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")  # links to the smallest: few rounds to contract
    return ordered.mapInPandas(links, "u long, v long")


def exact_forest(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None, step: int = 1 << 22) -> np.ndarray:
    """The smallest member of each one's component, for 0 .. n-1: ``sets`` (different numbers each) linked by a Jaccard similarity of ``similarity`` or more.

    Every pair of different components is compared, with ``side`` only those of different sides.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(-size, kind="stable")  # what can be alike follows each one closely
    size, side = size[order], None if side is None else side[order]
    values, ids = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)
    starts = np.cumsum(size) - size
    label, has = np.arange(len(sets)), np.zeros(len(values), bool)
    ends = np.searchsorted(-size, -np.maximum(similarity * size - 1e-9, 1), "right")
    for a in range(len(sets) - 1):
        b = np.arange(a + 1, max(ends[a], a + 1))
        b = b[(label[b] != label[a]) & (True if side is None else side[b] != side[a])]
        if not len(b):
            continue
        own = ids[starts[a] : starts[a] + size[a]]
        has[own] = True
        cuts = np.flatnonzero(np.diff(np.cumsum(size[b]) // step)) + 1
        for some in np.split(b, cuts):
            n = size[some]
            at = np.cumsum(n) - n
            common = np.add.reduceat(has[ids[np.repeat(starts[some] - at, n) + np.arange(n.sum())]], at, dtype=np.int64)
            alike = some[common >= similarity * (n + size[a] - common) - 1e-9]
            if len(alike):
                joined = np.unique(np.append(label[alike], label[a]))
                label[np.isin(label, joined)] = joined[0]
        has[own] = False
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, label, order)
    out = np.empty(len(sets), np.int64)
    out[order] = least[label]
    return out


def exact_links(texts: DataFrame, members: DataFrame, words: int, similarity: float, cap: int = 4096, most: int = 1 << 21) -> DataFrame:
    """``u, v``: links that connect those ``members`` of a ``root`` (``fp, root, size, __id, __th``) whose shingle sets are at ``similarity`` or above.

    ``texts`` has the rows ``__id, __th, text``. The sets of a root meet in one group; a root of over ``cap`` members or ``most`` shingles is
    cut into chunks by hash, and each pair of chunks is one group.
    """
    chunks = F.ceil(F.greatest(F.count("*") / cap, F.sum("size") / most)).cast("int")
    hot = written(members.groupBy("root").agg(chunks.alias("chunks")).where("chunks > 1"), "hot")
    wanted = members.join(bounded(hot, 100_000), "root", "left").select("__id", "__th", "fp", "root", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    once = texts.join(wanted, ["__id", "__th"]).groupBy("fp").agg(*(F.first(c).alias(c) for c in ("root", "chunks", "text")))

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield df[["fp", "root", "chunks"]].assign(grams=[shingle_set(t, words).tobytes() for t in df["text"]])

    dealt = once.mapInPandas(sets, "fp long, root long, chunks int, grams binary").withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "grams")

    def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, edge in whole_groups(parts, ["root", "i", "j"]):
            fp, own, i, j, grams, us, vs = *(df[c].to_numpy() for c in ("fp", "own", "i", "j", "grams")), [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a < 2:
                    continue
                side = own[a:b] if i[a] < j[a] else None
                label = exact_forest([np.frombuffer(g, np.uint64) for g in grams[a:b]], similarity, side)
                got = np.flatnonzero(label != np.arange(b - a))
                us.append(fp[a:b][got])
                vs.append(fp[a:b][label[got]])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    ordered = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")
    return ordered.mapInPandas(links, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """As ``near_duplicates``, for texts whose sets of ``words``-word shingles have ``similarity`` or more in common (Jaccard).

    A 64-bit fingerprint can't tell 0.8 from chance in a large corpus, so sketches are longer. They only propose groups; within a group the
    shingle sets themselves are compared, and no link is below ``similarity``. ``recall`` is what the sketches find of pairs at ``similarity``;
    closer ones are found almost surely. ``fp`` and ``root`` stand for shingle sets.
    """
    small_batches(docs.sparkSession)
    names = [f"w{i}" for i in range(WIDE)]

    def sketches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            fp, size, w = [], [], []
            for t in df["text"]:
                h = shingle_set(t, words)
                fp.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                w.append(sketch(h))
            w = np.array(w, np.uint64).reshape(-1, WIDE).view(np.int64)
            yield df[["doc_id", "__id", "__th"]].assign(fp=np.array(fp, np.uint64).view(np.int64), size=size, **{c: w[:, i] for i, c in enumerate(names)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = row_keys(docs.select("doc_id", "text")).select("doc_id", "__id", "__th", text_or_empty().alias("text"))
    rows = written(texts.mapInPandas(sketches, f"doc_id {kind}, __id long, __th long, fp long, size long, " + ", ".join(f"{c} long" for c in names)), "sketches")
    distinct = written(rows.groupBy("fp").agg(first_row().alias("first"), *(F.first(c).alias(c) for c in ("size", *names))), "distinct")
    loose = components(sketch_links(distinct, similarity, recall)).select(F.col("v").alias("fp"), "root")
    loose = loose.unionByName(loose.select(F.col("root").alias("fp"), "root").distinct())
    members = written(distinct.join(loose, "fp").select("fp", "root", "size", F.coalesce(F.col("first.doc_id").cast("long"), F.lit(-1)).alias("__id"), "first.__th"), "members")
    links = exact_links(texts.select("__id", "__th", "text"), members, words, similarity)
    return classed(rows, distinct, components(links).withColumnRenamed("v", "fp")).drop("size", *names)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
