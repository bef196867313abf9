"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark, one scan per text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, packed, utf8, with_row

#: Consecutive item words that make a window.
WIDTH = 13
#: Bytes of benchmark text that one automaton, and so one broadcast, may hold.
BLOCK_BYTES = 32_000_000
#: A document is contaminated when a word in so many, at least, is hit.
ONE_IN = 20
#: Bytes that end a word, mapped to a blank; letters are folded in the same step.
CLEAN = bytes(x if x in b"0123456789abcdefghijklmnopqrstuvwxyz" or x >= 0x80 else 0x20 for x in FOLD)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FIELDS = (
    "n_words long, hits array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>, items array<string>"
)
RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(CLEAN).split()


class Matcher:
    """The automaton over the windows of some items; it is sent as windows and built where it is used."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], width: int = WIDTH):
        self.windows: dict[tuple[bytes, ...], set[str | None]] = {}
        self.automaton = None
        for item, text in items:
            words = words_of(text)
            for i in range(max(len(words) - width, 0) + 1 if words else 0):
                self.windows.setdefault(tuple(words[i : i + width]), set()).add(item)

    def build(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in self.windows.items():
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in window)
            self.automaton.add_word(key, (len(window), items))
        if self.windows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words (both ends inclusive) and the items with occurring windows."""
        if self.automaton is None:
            self.build()
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.windows and words:
            for end, (length, of) in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
                ranges.append((end - length + 1, end))
                items.update(x for x in of if x is not None)
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of ranges of its words."""
    if not ranges:
        return []
    ends = [m.span() for m in WORD.finditer(text)]
    out, at, chars = [], 0, 0
    for first, last in ranges:
        span = []
        for offset in (ends[first][0], ends[last][1]):
            chars += len(text[at:offset].decode("utf-8", "replace"))
            at = offset
            span.append(chars)
        out.append((span[0], span[1]))
    return out


def _scanner(shared, last_block: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            texts = batch.column("text")
            n_words, hits, spans, items = [], [], [], []
            for k, text in enumerate(texts):
                text = text.as_py()
                words = words_of(text)
                found, of = matcher.scan(words)
                if "hits" in batch.schema.names:  # what earlier blocks found
                    found = merged(found + [(x["first"], x["last"]) for x in batch.column("hits")[k].as_py()])
                    of |= set(batch.column("items")[k].as_py())
                n_words.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in found])
                spans.append([{"start": a, "end": b} for a, b in char_spans(text, found)] if last_block else [])
                items.append(sorted(of))
            out = [batch.column("row"), *([] if last_block else [texts])]
            out += [pa.array(n_words, pa.int64()), pa.array(hits, RANGES), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            names = ["row", *([] if last_block else ["text"]), "n_words", "hits", "spans", "items"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, one_in: int = ONE_IN) -> DataFrame:
    """(row, n_words, n_hit, n_items, items, spans, contaminated) for every row of ``docs``.

    ``row`` is the whole input row. A word is hit inside any occurrence of a window of ``width``
    item words (a shorter item is one window). ``spans`` are code-point offsets of hit words in the
    original text, ``items`` the sorted ids of items with occurring windows. A text with a hit word
    is contaminated when one word in ``one_in`` or more is hit.

    The text of the benchmark is measured first; above ``block_bytes`` it is dealt into blocks, and
    every text is scanned once for each block, with one automaton in memory at a time. Null texts
    have no words; items without text have no windows; items without id hit words and are not
    listed; repeated items count once by id. Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = packed(docs, utf8("text").alias("text"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        matcher = Matcher(((r["item_id"], r["text"].encode()) for r in part.toLocalIterator()), width)
        final = block == blocks - 1
        schema = with_row(out, ("" if final else "text binary, ") + FIELDS)
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(matcher), final), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).drop("hits")
