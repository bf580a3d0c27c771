"""Packing token pieces into sequences of fixed capacity with as little room left as possible.

What fits together depends on lengths alone, and there are only ``capacity`` of them. So the counts by length (a bounded
table) are planned on the driver: for each length, from the longest, the gap is filled exactly by one, two or three
available lengths where it can be (lookups of the complement in an index of what is there), else the longest that fits goes in first; the pattern
is used as often as the counts allow. Spark then deals the pieces of each length out to the places of the plan by rank.

Edge cases: null and empty texts are the end token alone; equal lengths and repeated rows are interchangeable; a longer
document is cut into pieces of full capacity and a rest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import eight, fresh, joined_bytes, mix, small_batches, text_or_empty, written


class Encoder:
    """Ids of whole texts. What the tokenizer's split rule keeps apart is encoded once by its model and kept, as it never merges across it.

    Texts of Latin-1 characters are split here, in numpy: lower-casing maps those one to one and normalising leaves them
    alone. Pieces of up to eight bytes are found again by those bytes as a number, longer ones in a dictionary. Other texts go through
    the tokenizer word by word. What is laid down here holds for one normaliser and split rule, so the file must have those.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
    LOWER = bytes(c + 32 if 65 <= c <= 90 or 192 <= c <= 222 and c != 215 else c for c in range(256))
    SPACE, LETTER, NUMBER, OTHER = range(4)
    #: What each character is to the split rule of the tokenizer's own file: letters in runs, numbers alone, others in runs,
    #: and 's 't 'm 'd 're 've 'll by themselves where one begins a piece.
    KIND = np.full(256, OTHER, np.int8)
    KIND[list(b"\t\n\r ")] = SPACE
    KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
    KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    BITS = 22
    #: Normaliser and split rule of the file that this encoder is for, fixed values.
    RULES = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        rules = json.loads(Path(path).read_text())
        if (rules.get("normalizer"), rules.get("pre_tokenizer")) != self.RULES or rules["model"].get("type") != "BPE":
            raise ValueError(f"{path}: another normaliser or split rule than this encoder's")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from 256 on
        hidden = [b for b in range(256) if b not in shown]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.bits = self.BITS
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.full = 0  # slots in use
        self.long: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = array("I"), array("q"), array("i")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece of up to eight bytes, -1 if it is new: a hash table with linear probing. Its keys are one to one with pieces."""
        out, live = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            at = slot[live]
            key = self.keys[at]
            hit = key == h[live]
            out[live[hit]] = self.values[at[hit]]
            live = live[~hit & (key != 0)]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
        return out

    def _number(self, piece: str) -> int:
        """The number of a new piece, whose ids are kept."""
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else "".join(self.char[b] for b in piece.encode()))]
        self.starts.append(len(self.ids))
        self.sizes.append(len(ids))
        self.ids.extend(ids)
        return len(self.starts) - 1

    def _learn(self, h: int, piece: str) -> None:
        if 2 * self.full >= len(self.keys):
            self._widen()
        self._place(h, self._number(piece))

    def _place(self, h: int, number: int) -> None:
        slot = h >> 64 - self.bits
        while self.keys[slot]:
            slot = slot + 1 & (1 << self.bits) - 1
        self.keys[slot], self.values[slot] = h, number
        self.full += 1

    def _widen(self) -> None:
        """A table twice as large: it is never more than half full, so that a search ends."""
        used = np.flatnonzero(self.keys)
        held = list(zip(self.keys[used].tolist(), self.values[used].tolist()))
        self.bits += 1
        self.keys, self.values, self.full = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
        for h, number in held:
            self._place(h, number)

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of lower-case Latin-1 text start and end; the text ends with a space."""
        kind = self.KIND[data]
        change = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == self.NUMBER)
        quote = np.flatnonzero((data[:-1] == 39) & change[:-1])
        if len(quote):
            one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
            short = np.isin(one, list(b"stmd"))
            long_ = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            change[quote[short | long_] + 1] = False
            change[quote[short] + 2] = True
            change[quote[long_] + 3] = True
        starts = np.flatnonzero(change & (kind != self.SPACE))
        edge = np.flatnonzero(change)
        return starts, np.append(edge, len(data))[np.searchsorted(edge, starts) + 1]

    def _plain(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data, ends = joined_bytes([t.translate(self.LOWER) + b"\n" for t in texts])
        starts, stops = self._edges(data) if len(data) else (ends[:0], ends[:0])
        raw, at = data.tobytes(), np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(stops - starts <= 8)
        h = mix(eight(np.concatenate([data, np.zeros(8, np.uint8)]), starts[short], (stops - starts)[short]))  # a bijection, and no piece holds a zero byte
        at[short] = self._find(h)
        new = np.flatnonzero(at[short] < 0)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            for i in new[first].tolist():
                self._learn(int(h[i]), raw[starts[short[i]] : stops[short[i]]].decode("latin-1"))
            at[short[new]] = self._find(h[new])
        for i in np.flatnonzero(stops - starts > 8).tolist():
            piece = raw[starts[i] : stops[i]]
            if (k := self.long.get(piece)) is None:
                k = self.long[piece] = self._number(piece.decode("latin-1"))
            at[i] = k
        ids, sizes = np.array(self.ids, np.uint32), np.array(self.sizes)[at] if len(at) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(np.array(self.starts)[at] - total[:-1], sizes) + np.arange(total[-1])] if len(at) else np.zeros(0, np.uint32)
        cut = total[np.searchsorted(starts, ends)]
        return (flat[a:b] for a, b in zip(cut[:-1], cut[1:]))

    def _word(self, w: str) -> np.ndarray:
        if w not in self.words:
            if len(self.words) > self.most // 10:
                self.words.clear()
            self.words[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
        return self.words[w]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (unsigned 32 bits) of each text, in order."""
        if len(self.starts) > self.most:
            self.clear()
        plain = [bool(self.PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        fast = self._plain([t.encode("latin-1") for t, p in zip(texts, plain) if p])
        for t, p in zip(texts, plain):
            yield next(fast) if p else np.concatenate([np.zeros(0, np.uint32), *map(self._word, t.replace("\n", " ").split(" "))])


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each document's tokens and the end token, cut at ``capacity``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for df in parts:
            for k in range(0, len(df), 500):
                some, out = df.iloc[k : k + 500], []
                for i, ids in zip(some["doc_id"].astype(object).where(some["doc_id"].notna(), None), enc.encode(list(some["text"]))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        cut = ids[s : s + capacity]
                        out.append((i, p, s, len(cut), zlib.crc32(cut.tobytes())) + ((cut.astype(np.int32),) if keep_ids else ()))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how often each is used, so that all of ``counts`` (length: how many) is used up."""
    have = [0] * (capacity + 1)
    there = back = 0  # as bits: which lengths are there, and the same from the far end

    def change(x: int, by: int) -> None:
        nonlocal there, back
        before = have[x]
        have[x] += by
        if not before or not have[x]:
            there ^= 1 << x
            back ^= 1 << capacity - x

    for n, c in counts.items():
        change(n, c)

    def pair(gap: int, most: int) -> list[int] | None:
        both = there & (back >> capacity - gap) & (2 << min(most, gap - 1)) - 1
        a = both.bit_length() - 1
        return [a, gap - a] if 2 * a > gap or 2 * a == gap and have[a] > 1 else None

    def exact(gap: int) -> list[int] | None:
        """One, two or three lengths that are there and fill the gap, the longest first."""
        if have[gap]:
            return [gap]
        if two := pair(gap, gap):
            return two
        firsts = there & (1 << gap) - 1
        while (a := firsts.bit_length() - 1) * 3 >= gap:
            change(a, -1)
            two = pair(gap - a, a)
            change(a, 1)
            if two:
                return [a, *two]
            firsts ^= 1 << a
        return None

    out = []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            items, gap = [longest], capacity - longest
            change(longest, -1)
            while gap:
                fill = exact(gap)
                if fill is None:
                    best = (there & (2 << gap) - 1).bit_length() - 1
                    if best < 1:
                        break
                    fill = [best]
                for x in fill:
                    change(x, -1)
                items += fill
                gap -= sum(fill)
            need = Counter(items)
            more = min(have[x] // c for x, c in need.items())
            if more:
                for x, c in need.items():
                    change(x, -c * more)
            out.append((tuple(items), 1 + more))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, how often the pattern is used, its first sequence, offset): equal lengths of a pattern lie side by side."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for items, times in patterns:
        offset = 0
        for x, c in sorted(Counter(items).items(), reverse=True):
            rows.append((x, used[x], used[x] + c * times, times, sequence, offset))
            used[x] += c * times
            offset += c * x
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """``token_pieces`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    (row,) = fresh(docs, "row")
    # a number for each piece, written with it: pieces of equal ids and texts are dealt like others
    pieces = written(token_pieces(docs, tokenizer, capacity, end, keep_ids).withColumn(row, F.monotonically_increasing_id()), "pieces")
    names = [c for c in pieces.columns if c != row]
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # ``capacity`` rows at most
    if not counts:
        return pieces.drop(row).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = spark.createDataFrame(places(plan(counts, capacity)), "length long, first long, stop long, times long, sequence long, at long")
    # Rank of each piece in its length, without one task for a common length: about sqrt(n) groups of sqrt(n) pieces.
    groups = spark.createDataFrame([(n, max(1, round(c**0.5))) for n, c in counts.items()], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("__g", F.pmod(F.xxhash64(row), "groups")).drop("groups")
    own = Window.partitionBy("length", "__g").orderBy("doc_id", "piece", "start", "ids_crc32", row)
    before = Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "__g").count().select("length", "__g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(own)).join(sizes, ["length", "__g"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__rank") - 1).withColumnRenamed("length", "__length")
    fits = (F.col("__length") == F.col("length")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("stop"))
    i = F.col("__rank") - F.col("first")
    return ranked.join(F.broadcast(slots), fits).select(
        *names, (F.col("sequence") + i % F.col("times")).alias("sequence_id"), (F.col("at") + F.floor(i / F.col("times")) * F.col("length")).cast("long").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of ``pack(..., keep_ids=True)``: what a training job reads. A group holds ``capacity`` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
