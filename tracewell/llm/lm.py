"""Language-model scoring by partial matching over bytes, with a word model beside it."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, utf8, with_row
from tracewell.plans.lineage import settle

#: Bytes of context. A code is the context and the byte after it, the oldest byte highest.
ORDER = 5
#: Contexts of this order and below are held whole: at most 256**3 codes by construction.
WHOLE = 2
#: Codes of longer contexts that are held and broadcast at once.
ENTRIES = 1_000_000
#: Words whose counts are broadcast: the most frequent ones, at most. All others are joined.
FREQUENT = 100_000
#: Bytes of text that are turned into codes at once.
CHUNK = 1_000_000
#: Bytes of text whose codes are looked up together, in one block of contexts after the other.
GROUP = 8_000_000
#: A text is read as if it came after line ends; the last byte, which UTF-8 never uses, is its end.
START, END = b"\n" * ORDER, b"\xff"
TOKEN_ROWS, CODE_ROWS = 150_000, 1_000_000


def tokens(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owners): a code for every byte of every text and for its end."""
    data = np.frombuffer(b"".join(START + t + END for t in texts), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    code = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | data[k : k + len(code)]
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    owner = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return code[np.repeat(starts, lengths) + within], owner


def chunked(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text) + ORDER + 1
        if size >= CHUNK or k == len(texts) - 1:
            yield first, held
            first, held, size = k + 1, [], 0


def _count_batch(token: list, code, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token, pa.binary()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["token", "code", "n"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (the empty word is the end of a text) and of codes, added up per task."""
    words: Counter = Counter()
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def word_rows():
        return _count_batch(list(words), [None] * len(words), list(words.values()))

    def code_rows():
        return _count_batch([None] * len(codes), codes.astype(np.int64), counts)

    for batch in batches:
        for _, texts in chunked(batch.column("text").to_pylist()):
            for text in texts:
                words.update(tokens(text))
            words[b""] += len(texts)
            if len(words) > TOKEN_ROWS:
                yield word_rows()
                words.clear()
            new, n = np.unique(codes_of(texts)[0], return_counts=True)
            joined, slot = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(slot, np.concatenate([counts, n]), len(joined)).astype(np.int64)
            codes = joined
            if len(codes) > CODE_ROWS:
                yield code_rows()
                codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    yield word_rows()
    yield code_rows()


def block_of(code, blocks: int):
    """The block of a code: by the last three bytes of its context, so that a context and its suffix meet."""
    return ((code // 256 % 16777216) * 40503 // 256) % blocks


class Level:
    """Counts of all codes with contexts of one length, and what escapes need to know of each context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts.astype(float)
        self.contexts, slot = np.unique(codes >> np.uint64(8), return_inverse=True)
        self.total = np.bincount(slot, self.counts, len(self.contexts))
        self.distinct = np.bincount(slot, minlength=len(self.contexts)).astype(float)
        self.slot = slot.astype(np.int32)

    def below(self, length: int) -> Level:
        """The level of contexts one byte shorter; ``length`` is that of its codes in bytes."""
        short, slot = np.unique(self.codes & np.uint64(256**length - 1), return_inverse=True)
        return Level(short, np.bincount(slot, self.counts, len(short)))

    def count(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        at = find(self.codes, codes)
        return np.where(at >= 0, self.counts[at.clip(0)], 0.0)

    def exclude(self, shorter: Level, length: int) -> None:
        """For each context, how much of its suffix its own bytes take up, to be left out after an escape."""
        self.taken = np.bincount(self.slot, shorter.count(self.codes & np.uint64(256**length - 1)), len(self.contexts))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Trie:
    """Levels ORDER..0. ``whole`` are counts of codes of WHOLE + 1 bytes, ``block`` those of this block."""

    def __init__(self, whole: tuple[np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], number: int, blocks: int):
        self.number, self.blocks = number, blocks
        levels = {ORDER: Level(*block), WHOLE: Level(*whole)}
        for order in (*range(ORDER - 1, WHOLE, -1), *range(WHOLE - 1, -1, -1)):
            levels[order] = levels[order + 1].below(order + 1)
        for order in range(ORDER, 0, -1):
            levels[order].exclude(levels[order - 1], order)
            del levels[order].slot  # needed for building only
        self.levels = levels

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's last byte after its context.

        A context with t occurrences of u bytes gives a known byte its count over t + u and the
        escape u over t + u; after an escape all bytes known there are left out of the shorter
        context. Contexts never seen, and contexts with nothing left, are passed over for nothing.
        """
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        taken, known = np.zeros(len(codes)), np.zeros(len(codes))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            mine = codes[open_] & np.uint64(256 ** (order + 1) - 1)
            at = find(level.contexts, mine >> np.uint64(8))
            seen = at >= 0
            at = at.clip(0)
            if not len(level.contexts):
                continue
            total, distinct = np.where(seen, level.total[at] - taken[open_], 0), np.where(seen, level.distinct[at] - known[open_], 0)
            count = np.where(seen, level.count(mine), 0)
            usable = distinct > 0
            hit = usable & (count > 0)
            size = np.where(usable, total + distinct, 1)
            out[open_] += np.where(hit, np.log10(np.maximum(count, 1)), np.where(usable, np.log10(np.maximum(distinct, 1)), 0)) - np.log10(size)
            if order:
                taken[open_[seen]], known[open_[seen]] = level.taken[at[seen]], level.distinct[at[seen]]
            else:
                known[open_] = np.where(seen, level.distinct[at], 0)
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(256 - known[open_], 1))
        return out


def score_texts(texts: list[bytes], tries: list) -> Iterator[float]:
    """The summed log10 probabilities of each text; ``tries`` are broadcast blocks.

    The distinct codes of a group of texts are looked up in one block after the other, and a block is
    let go before the next is read, so a task holds one block at a time however many there are.
    """
    parts, distinct = [], []
    for _, some in chunked(texts):
        code, owner = codes_of(some)
        mine, slot = np.unique(code, return_inverse=True)
        distinct.append(mine)
        parts.append((slot.astype(np.int32), np.bincount(owner, minlength=len(some))))
    codes = np.unique(np.concatenate(distinct))
    value = np.empty(len(codes))
    for shared in tries:
        trie = shared.value
        here = np.flatnonzero(block_of(codes.astype(np.int64), trie.blocks) == trie.number)
        value[here] = trie.log10(codes[here])
        if len(tries) > 1:
            del trie
            vars(shared).pop("_value", None)  # what a worker has read; read again from its disk when needed
    for mine, (slot, lengths) in zip(distinct, parts, strict=True):
        each = value[np.searchsorted(codes, mine)][slot]
        yield from np.bincount(np.repeat(np.arange(len(lengths)), lengths), each, len(lengths)).tolist()


RARE = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))


def _word_scores(texts: list[bytes], known: dict[bytes, float]) -> list[tuple]:
    """(n_tokens, n_known, base, rare) of each text; ``rare`` are the words that are not in ``known``."""
    out = []
    for text in texts:
        words = Counter(tokens(text))
        words[b""] += 1
        found, value, rest = 0, 0.0, []
        for word, n in words.items():
            p = known.get(word)
            if p is None:
                rest.append({"token": word, "n": n})
            else:
                found += n
                value += n * p
        out.append((words.total(), found, value, rest))
    return out


def _scorer(tries: list, shared):
    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        n_tokens, n_known, base, rare = zip(*_word_scores(texts, shared.value), strict=True)
        score = pa.array(score_texts(texts, tries), pa.float64())
        out = [part.column("row"), score, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, RARE)]
        return pa.RecordBatch.from_arrays(out, names=["row", "score", "n_tokens", "n_known", "base", "rare"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = size = 0
            for k, text in enumerate(batch.column("text")):
                size += len(text.as_buffer())
                if size >= GROUP or k == batch.num_rows - 1:
                    yield rows(batch.slice(first, k + 1 - first))
                    first, size = k + 1, 0

    return score


def _arrays(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = codes.select("code", "n").toArrow()
    code, n = got["code"].to_numpy().astype(np.uint64), got["n"].to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def score(docs: DataFrame, training: Column, entries: int = ENTRIES, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``row`` is the input row without its text. The model learns from all rows for which ``training`` holds: one pass adds up words and byte
    codes per task, then per key. ``score`` is the log10 probability that the trie gives the whole
    text as it stands and its end; ``base_score`` is that of an add-one word model over lower-cased
    words and one end.

    The trie is held in blocks of at most about ``entries`` codes, which are broadcast; a task reads
    them in turn for each group of texts and holds one at a time, beside the short contexts, whose number is bounded by the byte alphabet. Counts of the
    ``frequent`` most frequent words are broadcast, those of all other words are joined, so no key
    of that join is hot. A null text is an empty one; without training rows every byte costs
    log10(256). Repeated rows get equal scores; an empty table gives no rows.
    """
    spark = docs.sparkSession
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    texts = docs.select(others.alias("row"), utf8("text").alias("text"))
    train = docs.where(training).select(utf8("text").alias("text"))
    counted = settle(train.mapInArrow(_counter, "token binary, code long, n long").groupBy("token", "code").agg(F.sum("n").alias("n")))
    words, codes = counted.where(F.col("token").isNotNull()), counted.where(F.col("token").isNull())
    distinct, all_tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = all_tokens + distinct + 1

    whole = codes.groupBy((F.col("code") % 256 ** (WHOLE + 1)).alias("code")).agg(F.sum("n").alias("n"))
    short = _arrays(whole)
    blocks = max(1, math.ceil(codes.count() / entries))
    tries = []
    for block in range(blocks):
        place = F.expr(f"((code div 256 % 16777216) * 40503 div 256) % {blocks}")
        trie = Trie(short, _arrays(codes.where(place == block)), block, blocks)
        tries.append(spark.sparkContext.broadcast(trie))

    scale = F.floor(F.log2("n")).cast("int")
    left, least = frequent, 63
    for r in words.groupBy(scale.alias("scale")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("scale")).collect():
        left -= r["words"]
        if left < 0:
            break
        least = r["scale"]
    top = words.where(scale >= least).collect()  # at most ``frequent`` rows
    known = {bytes(r["token"]): math.log10((r["n"] + 1) / size) for r in top}
    fields = "score double, n_tokens long, n_known long, base double, rare array<struct<token:binary,n:long>>"
    parts = settle(texts.mapInArrow(_scorer(tries, spark.sparkContext.broadcast(known)), with_row(texts, fields)))
    parts = parts.withColumn("key", F.monotonically_increasing_id())  # over stored rows, so the same each time
    rare = parts.select("key", F.inline("rare")).join(words.select("token", F.col("n").alias("count")), "token", "left")
    value = F.col("n") * F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(size)))
    added = rare.groupBy("key").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"))
    none = F.lit(0)
    return parts.drop("rare").join(added, "key", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"), "score",
    )
