"""Removal of long repeated substrings with suffix arrays over content-defined shards.

How it stays exact without one global suffix array:

1. *Pieces.* Every window of ``length`` bytes belongs to the gram of half that size with the least hash in it. Windows in a row with
   the same least hash make a piece; so each window is in one piece, and equal strings of ``length`` bytes are in pieces of equal hash.
2. Pieces whose least hash is that of one gram in one place are dropped. The others are grouped by a hash of their whole content: where a
   piece occurs twice, everything in it is repeated, and it counts once from here on (groups of copies shrink to one row).
3. *Shards.* The distinct pieces of a least hash meet in one shard, which builds a suffix array by Larsson-Sadakane
   refinement and common prefixes by Kasai's recurrence, in numpy. Hashes with more than ``cap`` pieces are split
   over several shards; those exchange their sorted 400-byte strings by hash range and find shared ones by binary search.

Edge cases: null and empty texts have no bytes and lose none; repeated rows are separate places, so both lose a
shared string; texts shorter than ``length`` are kept whole; ids are whole numbers, or texts of them;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bounded, joined_bytes, mix, small_batches, text_or_empty, written

BATCH = 4 << 20
SHARD_BYTES = 1 << 18
#: Windows in a piece at most: a long periodic text is cut.
WINDOWS = 1 << 16
#: Copies of a piece from which its rows are found by broadcast: one key holds them all.
HOT = 10_000


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        a = op(a[:-have], a[have:])
        have *= 2
    return op(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def pieces(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Pieces of all texts in ``data``: text number, place in it, least hash, how often it occurs in the piece, hash of the content, and bytes."""
    gram, none = length // 2, np.zeros(0, np.int64)
    reach = length - gram
    sizes = np.diff(ends)
    big = sizes >= length
    if not big.any():
        return {"text": none, "pos": none, "h": none, "k": none, "ck": none, "len": none}
    at = np.arange(len(data) - gram + 1)
    h = Rolling(data).of(at, at + gram)
    least = _sliding(np.minimum, h, reach + 1)  # for windows that start at 0 .. len(data) - length
    step = np.zeros(len(data) + 1, np.int8)  # windows that cross from one text into the next don't count
    np.add.at(step, ends[:-1][big], 1)
    np.add.at(step, ends[1:][big] - length + 1, -1)
    ok = np.cumsum(step[: len(least)], dtype=np.int8) > 0
    change = least[1:] != least[:-1]
    first = np.flatnonzero(ok & np.concatenate([[True], change | ~ok[:-1]]))
    last = np.flatnonzero(ok & np.concatenate([change | ~ok[1:], [True]]))
    held = np.concatenate([np.zeros(reach, np.uint64), np.where(ok, least, np.uint64(0)), np.zeros(reach, np.uint64)])
    p = np.flatnonzero(_sliding(np.maximum, held, reach + 1) == h)  # the grams of least hash, each in the windows of one piece
    of = np.searchsorted(first, p, "right") - 1
    while len(other := np.flatnonzero(least[first[of]] != h[p])):
        of[other] -= 1
    k = np.bincount(of, minlength=len(first))
    many = (last - first) // WINDOWS + 1
    if many.max() > 1:
        step, k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(k, many)
        first = np.repeat(first, many) + step * WINDOWS
        last = np.minimum(np.repeat(last, many), first + WINDOWS - 1)
    text, raw, digest = np.searchsorted(ends, first, "right") - 1, memoryview(data), xxhash.xxh3_64_intdigest
    ck = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
    return {"text": text, "pos": first - ends[text], "h": least[first].view(np.int64), "k": k, "ck": ck.view(np.int64), "len": last + length - first}


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``key`` (numbers of ``bits`` bits), and the sorted key. Key and place fit one word as a rule, and plain numbers sort fastest."""
    own = len(key).bit_length()
    if bits + own > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << np.uint64(own)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << own) - 1)).astype(np.int64), both >> np.uint64(own)


def suffix_array(data: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Suffixes of pieces in order, equal ones by place. ``limit``: where the piece of a byte ends (0 in the gaps of 8 zero bytes between pieces).

    Larsson-Sadakane refinement: order by as many bytes as fit a word, then sort each group by the rank of what follows, twice as far each time.
    Suffixes that end within the bytes compared so far leave, as those still tied are equal to their ends.
    """
    place, bits = np.flatnonzero(limit), len(data).bit_length()
    used = np.flatnonzero(np.bincount(data, minlength=256))
    wide = max(1, (len(used) - 1).bit_length())
    k = min(7, (61 - bits) // wide)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(len(used))
    code = np.concatenate([code[data], np.zeros(k, np.uint64)])
    key = np.zeros(len(data), np.uint64)
    for i in range(k):
        key = (key << np.uint64(wide)) | code[i : i + len(data)]
    ends = np.minimum(limit[place] - place, k).astype(np.uint64)  # tells an end from a zero byte
    order, key = _ordered((key[place] << np.uint64(3)) | ends, wide * k + 3)
    sa, rank = place[order].astype(np.int32), np.zeros(len(data), np.int32)

    def groups(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first slot of each one's group, and which are tied."""
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(at, append=len(key))
        return np.repeat(slots[at], many), np.repeat(many > 1, many)

    slots, p = np.arange(len(sa), dtype=np.int32), sa
    while len(slots):
        first, tied = groups(key, slots)
        rank[p] = first + 1
        live = np.flatnonzero(tied & (limit[p] - p >= k))
        slots, p = slots[live], p[live]
        order, key = _ordered((first[live].astype(np.uint64) << np.uint64(bits)) | rank[p + k].astype(np.uint64), 2 * bits)
        p = sa[slots] = p[order]
        k *= 2
    return sa


def kasai(data: np.ndarray, limit: np.ndarray, words: np.ndarray, sa: np.ndarray, least: int = 1, most: int | None = None, stride: int = 32) -> np.ndarray:
    """Common prefix of each suffix (by place) with the one before it in ``sa``, up to ``most``; 0 for suffixes of fewer than ``least`` bytes.

    Kasai's recurrence ``plcp[i] >= plcp[i - d] - d`` from every ``stride``-th place of a piece bounds the others, which are then extended eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int32)

    def extend(i: np.ndarray, have: np.ndarray) -> None:
        j = before[i]
        i, j, have = i[j >= 0], j[j >= 0], have[j >= 0]
        end = np.minimum(limit[i] - i, limit[j] - j)
        end = np.minimum(end, most) if most else end
        have = np.minimum(have, end)
        live = np.flatnonzero(have < end)
        while len(live):
            a, b, l, m = i[live], j[live], have[live], end[live]
            x = words[a + l] ^ words[b + l]
            equal = x == 0
            high = x >> np.uint64(32)
            half = np.where(high > 0, high, x).astype(np.float64)  # 32 bits: exact as a double
            step = np.where(equal, 8, np.where(high > 0, 3, 7) - (np.frexp(half)[1] - 1) // 8)
            have[live] = np.minimum(l + step, m)
            live = live[equal & (l + 8 < m)]
        plcp[i] = have

    at = np.arange(n, dtype=np.int32)
    begin = np.maximum.accumulate(np.where(limit != np.concatenate([[0], limit[:-1]]), at, 0))
    place = np.flatnonzero(limit - at >= least)
    base = place - (place - begin[place]) % stride
    extend(base[base == place], np.zeros((base == place).sum(), np.int64))
    place, base = place[base != place], base[base != place]
    extend(place, np.maximum(plcp[base] - (place - base), 0))
    return plcp


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; ``data`` ends with eight zero bytes at least."""
    w = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return np.concatenate([w, np.zeros(len(data) + 8 - len(w), np.uint64)])


def classes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All starts of ``length`` bytes in the pieces, grouped by content: piece, place in it, class, and place in the joined bytes."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]
    data = np.frombuffer(b"\0\0\0\0\0\0\0\0".join(pieces) + bytes(8), np.uint8)
    limit = np.zeros(len(data) + 8, np.int32)
    inside = np.repeat(starts + sizes, sizes)
    real = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
    limit[real] = inside
    words = _packed(data)
    limit = limit[: len(data)]
    sa = suffix_array(data, limit)
    plcp = kasai(data, limit, words, sa, length, length + 32)  # a bound of ``length`` suffices 32 places on
    sv = sa[limit[sa] - sa >= length]
    group = np.cumsum(plcp[sv] < length)
    piece = np.searchsorted(starts, sv, "right") - 1
    return piece, sv - starts[piece], group, sv


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts that follow one another become one run: document, first byte, end."""
    if not len(doc):
        return doc, start, start
    o = np.lexsort((start, doc))
    doc, start = doc[o], start[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], start[new], start[last] + length


COVER = "id long, th long, s long, e long"
SHARD = COVER + ", h long, part int, k1 binary, k2 binary, own binary, ids binary"


def _shard(rows: pd.DataFrame, length: int) -> Iterator[pd.DataFrame]:
    """One shard: covered runs, and for split hashes the sorted strings to be compared with other shards."""
    piece, off, group, sv = classes(list(rows["ctx"]), length)
    if not len(piece):
        return
    doc, names = pd.factorize(pd.MultiIndex.from_arrays([rows["id"], rows["th"]]))
    at = off + rows["s"].to_numpy()[piece]
    place = (doc[piece].astype(np.int64) << 40) | at
    known = rows["n"].to_numpy()[piece] > 1
    bound = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    again = np.maximum.reduceat(place, bound) != np.minimum.reduceat(place, bound)
    again |= np.logical_or.reduceat(known, bound)
    of = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    hit = again[of] & ~known
    ids, ths = names.get_level_values(0).to_numpy(), names.get_level_values(1).to_numpy()
    d, s, e = _runs(doc[piece][hit], at[hit], length)
    if len(d):
        yield pd.DataFrame({"id": ids[d], "th": ths[d], "s": s, "e": e, "h": None, "part": None, "k1": None, "k2": None, "own": None, "ids": None})
    split = rows["parts"].to_numpy()
    if split.max() > 1:  # only whole split groups come in such a chunk
        data = np.frombuffer(b"\0\0\0\0\0\0\0\0".join(rows["ctx"]) + bytes(8), np.uint8)
        h, parts = int(rows["h"].iloc[0]), int(split[0])
        raw = memoryview(data)
        k1, k2 = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x : x + length]) for x in sv[bound].tolist()), np.uint64).reshape(-1, 2).T
        own = np.where(again, -1, at[bound])
        owner = doc[piece][bound]
        o = np.argsort(k1)
        k1, k2, own, owner = k1[o], np.ascontiguousarray(k2[o]), own[o], owner[o]
        part = (k1 >> np.uint64(32)) % np.uint64(parts)
        for x in np.unique(part):
            m = part == x
            yield pd.DataFrame({"id": None, "th": None, "s": None, "e": None, "h": [h], "part": [int(x)], "k1": [k1[m].tobytes()], "k2": [k2[m].tobytes()], "own": [own[m].tobytes()], "ids": [np.stack([ids[owner[m]], ths[owner[m]]]).astype(np.int64).tobytes()]})


def _merge(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Shards of one split least hash and one range of strings: by binary search in the others' sorted strings, which single ones occur there."""
    k1 = [np.frombuffer(x, np.uint64) for x in rows["k1"]]
    k2 = [np.frombuffer(x, np.uint64) for x in rows["k2"]]
    own = [np.frombuffer(x, np.int64) for x in rows["own"]]
    ids = [np.frombuffer(x, np.int64).reshape(2, -1) for x in rows["ids"]]
    place = [mix(mix(i.view(np.uint64)[0] ^ mix(i.view(np.uint64)[1])) + o.view(np.uint64)) for i, o in zip(ids, own)]
    all1, all2 = np.concatenate(k1), np.concatenate(k2)
    o = np.lexsort((all2, all1))
    all1, all2 = all1[o], all2[o]
    bound = np.flatnonzero(np.concatenate([[True], (all1[1:] != all1[:-1]) | (all2[1:] != all2[:-1])]))
    where = np.concatenate(place)[o]
    again = np.maximum.reduceat(where, bound) != np.minimum.reduceat(where, bound)
    again |= np.logical_or.reduceat(np.concatenate(own)[o] < 0, bound)
    out = []
    for a, b, w, i in zip(k1, k2, own, ids):
        at = np.searchsorted(all1, a)
        while (other := all2[at] != b).any():
            at = at + other
        m = again[np.searchsorted(bound, at, "right") - 1] & (w >= 0)
        out.append(pd.DataFrame({"id": i[0][m], "th": i[1][m], "s": w[m], "e": w[m] + length}))
    return pd.concat(out)


def repeated_spans(docs: DataFrame, length: int = 400, cap: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(packed texts, covers). Covers: ``id, th, s, e``: bytes s..e of the text with hash ``th`` of document ``id`` occur elsewhere too."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty()
    none = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(none, text).alias("th"), none.alias("none"), text.alias("text"))

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            raw = [t.encode() for t in df["text"]]
            a = 0
            while a < len(raw):
                b, total = a, 0
                while b < len(raw) and (b == a or total + len(raw[b]) <= BATCH):
                    total += len(raw[b])
                    b += 1
                x = pieces(*joined_bytes(raw[a:b]), length)
                if len(x["text"]):
                    at = x.pop("text") + a
                    yield pd.DataFrame({"id": df["id"].to_numpy()[at], "th": df["th"].to_numpy()[at], **x})
                a = b

    # Written first, so that texts are read once and both sides of the join are plain shuffles, of which Spark can split one whose hash is in many documents.
    found = written(rows.mapInPandas(find, "id long, th long, pos long, h long, k long, ck long, len long"), "pieces")
    twice = written(found.groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h"), "twice")
    some = written(found.join(twice, "h", "left_semi"), "some")
    distinct = written(some.groupBy("h", "ck").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min(F.struct("id", "th", "pos", "len")).alias("at")), "distinct")
    shards = distinct.groupBy("h").agg(F.count("*").alias("d"), F.sum("k").alias("k"), F.sum("at.len").alias("bytes"), F.min("n").alias("least")).where("k > 1 and least = 1").drop("k")
    parts = F.ceil(F.greatest(F.col("d") / cap, F.col("bytes") / (2 * length * cap))).cast("int")
    need = distinct.join(shards, "h").select("h", "n", "at.*", parts.alias("parts"), F.pmod("ck", parts).cast("int").alias("salt"))
    need = need.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "len", "h", "salt", "parts", "n")).alias("need"))

    def squeeze(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        for df in chunks:
            yield pd.DataFrame({"id": df["id"], "th": df["th"], "none": df["none"], "z": [z.compress(t.encode()) for t in df["text"]]})

    packed = rows.mapInPandas(squeeze, "id long, th long, none boolean, z binary")

    def cut(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for df in chunks:
            out = []
            for i, th, blob, needs in zip(df["id"], df["th"], df["z"], df["need"]):
                raw = z.decompress(blob)
                for x in needs:
                    out.append((x["h"], x["salt"], x["parts"], x["n"], i, th, x["pos"], raw[x["pos"] : x["pos"] + x["len"]]))
            for k in range(0, len(out), 4000):
                yield pd.DataFrame(out[k : k + 4000], columns=["h", "salt", "parts", "n", "id", "th", "s", "ctx"])

    # Rows that repeat a document (or missing ids with one text) hold the same pieces, whose numbers count them all: one such row is cut up.
    again = written(some.groupBy("id", "th", "pos").agg(F.count("*").alias("rows")).where("rows > 1").select("id", "th").distinct(), "again")
    once = packed
    if not again.isEmpty():
        hint = bounded(again, 100_000)
        once = packed.join(hint, ["id", "th"], "left_anti").unionByName(packed.join(hint, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    cuts = once.join(need, ["id", "th"]).mapInPandas(cut, "h long, salt int, parts int, n long, id long, th long, s long, ctx binary")

    def build(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come in order; a shard holds whole groups, as many as the caches take well, and a split group makes its own."""
        waiting = None
        for df in itertools.chain(chunks, [None]):
            last = df is None
            if waiting is not None:
                df = waiting if last else pd.concat([waiting, df], ignore_index=True)
            if df is None or not len(df):
                continue
            h, salt, parts = (df[c].to_numpy() for c in ("h", "salt", "parts"))
            edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]))
            total = np.concatenate([[0], np.cumsum(df["ctx"].map(len).to_numpy(np.int64))])
            start = 0
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(df)).tolist() if last else edge[1:].tolist()):
                if parts[a] > 1 and start < a:
                    yield from _shard(df.iloc[start:a], length)
                    start = a
                if parts[a] > 1 or total[b] - total[start] >= SHARD_BYTES:
                    yield from _shard(df.iloc[start:b], length)
                    start = b
            waiting = df.iloc[start:]
        if waiting is not None and len(waiting):
            yield from _shard(waiting, length)

    shard = written(cuts.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInPandas(build, SHARD), "shards")
    merged = shard.where("h is not null").groupBy("h", "part").applyInPandas(lambda g: _merge(g, length), COVER)
    known = distinct.where("n > 1").select("h", "ck", "n")
    hot = bounded(known.where(F.col("n") > HOT), 100_000).select("h", "ck")
    whole = some.join(hot, ["h", "ck"], "left_semi").unionByName(some.join(hot, ["h", "ck"], "left_anti").join(known.where(F.col("n") <= HOT).drop("n"), ["h", "ck"]))
    whole = whole.select("id", "th", F.col("pos").alias("s"), (F.col("pos") + F.col("len")).alias("e"))
    covers = whole.unionByName(shard.where("h is null").select("id", "th", "s", "e")).unionByName(merged)
    return packed, covers


def remove_repeats(docs: DataFrame, length: int = 400, cap: int = 1000) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the bytes that stay). See the module."""
    packed, covers = repeated_spans(docs, length, cap)
    spans = covers.groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def keep(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for df in chunks:
            out = []
            for i, none, blob, spans in zip(df["id"], df["none"], df["z"], df["spans"]):
                raw = z.decompress(blob)
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in (spans if spans is not None else ())):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                cuts = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((None if none else i, len(raw), len(raw) - len(kept), len(merged), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    return packed.join(spans, ["id", "th"], "left").mapInPandas(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated 400-byte strings, as a digest."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """What tests compare with: (removed, spans, sha256 of the rest) of each text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out
