"""Packing: order-preserving cuts of a token stream into windows by dynamic programming."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken import Encoding

#: Tokens of a sequence.
WINDOW = 1024
#: Cost, in tokens of padding, of a cut after a sentence, of one inside a sentence, and of each window.
SENTENCE_CUT, INNER_CUT, EACH_WINDOW = 2.0, 8.0, 32.0
#: Sentences of more tokens than ``LONG`` may be cut at every ``GRID``-th token; so may the last window.
LONG, GRID = 48, 16
#: Tokens over which cuts are chosen at once, and how many of them wait for what follows.
BLOCK, BACK = 262_144, 4 * WINDOW
END = 0


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: a file of ranks, the pattern that splits texts beforehand, and strings with an id of their own."""

    path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()


@cache
def encoding(vocabulary: Vocabulary) -> Encoding:
    with open(vocabulary.path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))


@cache
def sentence_marks(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Per token id: whether it may end a sentence, and whether a sentence may begin with it."""
    made = encoding(vocabulary)
    ends, begins = np.zeros(made.n_vocab, bool), np.ones(made.n_vocab, bool)
    for token in made.token_byte_values():
        k = made.encode_single_token(token)
        text = token.decode("utf-8", "replace")
        ends[k] = text.rstrip("\"')]}»”").endswith((".", "!", "?", "…", "。", "\n"))
        begins[k] = text[0].isspace()
    return ends, begins


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, vocabulary: Vocabulary, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, 0 and its end included, and the cost of each cut."""
    size = len(ids)
    cost = np.full(size + 1, np.inf)
    ends, begins = sentence_marks(vocabulary)
    known = np.minimum(ids, len(ends) - 1)
    cost[1:size][ends[known[:-1]] & begins[known[1:]]] = SENTENCE_CUT
    cost[doc_ends] = 0.0
    cost[[0, size]] = 0.0
    at = np.flatnonzero(cost < np.inf)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > LONG)
    inner = [np.arange(at[k] + GRID, at[k + 1], GRID) for k in wide]
    if closing:
        inner.append(np.arange(max(size - WINDOW, 1), size)[::-GRID])
    inner = np.concatenate([np.empty(0, np.int64), *inner])
    cost[inner] = np.minimum(cost[inner], INNER_CUT)
    at = np.flatnonzero(cost < np.inf)
    return at, cost[at]


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The positions at which windows begin and end, so that padding and cut costs are least in sum.

    best(e) = cost(e) + min over s of best(s) + padding(e - s). A window of e - s tokens is filled up
    to ``window``, so the minimum is that of best(s) + s over the last ``window`` tokens: the front of
    a queue that holds rising values only. Lengths that are powers of two need no padding and are
    tried one by one. Ties go to the longer window.
    """
    powers = [1 << k for k in range(window.bit_length() - 1)]
    place, price = places.tolist(), cost.tolist()
    best = {place[0]: 0.0}
    before: dict[int, int] = {}
    queue = deque([(float(place[0]), place[0])])
    for e, own in zip(place[1:], price[1:], strict=True):
        while queue and queue[0][1] < e - window:
            queue.popleft()
        least, start = queue[0]
        least += window - e
        for p in powers:
            there = best.get(e - p)
            if there is not None and there < least:
                least, start = there, e - p
        best[e] = total = least + own + EACH_WINDOW
        before[e] = start
        while queue and queue[-1][0] > total + e:
            queue.pop()
        queue.append((total + e, e))
    out = [place[-1]]
    while out[-1] != place[0]:
        out.append(before[out[-1]])
    return out[::-1]


class Stream:
    """Tokens that wait for their windows, with the documents that they belong to."""

    def __init__(self, vocabulary: Vocabulary, window: int):
        self.vocabulary, self.window, self.sequence = vocabulary, window, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # (doc_id, tokens, how many of them are placed already)
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.ids.append(np.append(ids, np.uint32(END)))
        self.docs.append((doc_id, len(ids) + 1, 0))
        self.size += len(ids) + 1

    def take(self, closing: bool) -> Iterator[tuple]:
        """(doc_id, start, ids, doc_tokens, sequence, offset) of all windows that are settled."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        lengths = np.array([n - used for _, n, used in self.docs])
        ends = np.cumsum(lengths)
        cuts = best_cuts(*cut_places(ids, ends, self.vocabulary, closing), self.window)
        if not closing:
            cuts = [c for c in cuts if c <= max(self.size - BACK, 0)]
        done = cuts[-1]
        edges = np.union1d(np.array(cuts), np.append(ends[ends < done], 0))
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist(), strict=True):
            doc_id, n, used = self.docs[d]
            yield doc_id, used + a - int(ends[d] - lengths[d]), ids[a:b], n, self.sequence + w, a - cuts[w]
        self.sequence += len(cuts) - 1
        first = int(np.searchsorted(ends, done, "right"))
        rest = self.docs[first:]
        if rest:
            doc_id, n, used = rest[0]
            rest[0] = (doc_id, n, used + done - int(ends[first] - lengths[first]))
        self.docs, self.ids, self.size = rest, [ids[done:]], self.size - done


def _packer(vocabulary: Vocabulary, window: int, block: int):
    def rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, n, sequence, offset = zip(*held, strict=True)
        lengths = [len(x) for x in ids]
        first = TaskContext.get().partitionId() << 33
        columns = {
            "doc_id": pa.array(doc, kind), "start": pa.array(start, pa.int64()), "length": pa.array(lengths, pa.int64()),
            "doc_tokens": pa.array(n, pa.int64()), "sequence_id": pa.array([first + s for s in sequence], pa.int64()),
            "offset": pa.array(offset, pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, stream = encoding(vocabulary), Stream(vocabulary, window)
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                stream.add(doc_id, np.array(made.encode(text.as_py(), allowed_special="all"), np.uint32))
                if stream.size >= block:
                    yield rows(list(stream.take(False)), kind)
        if stream.size:
            yield rows(list(stream.take(True)), kind)

    return pack


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids), one row per piece of a document.

    A document is its token ids and the id 0 after them; ``ids`` holds those of the piece, each in
    four bytes, lowest first. Documents follow each other as the table's partitions give them, and
    windows of at most ``window`` tokens are cut out of that stream so that the padding (none where a
    length is a power of two) and the costs of cuts that are not at the end of a document are least.
    Cuts stand at the ends of documents and sentences, and inside sentences above ``LONG`` tokens.
    The cuts are the best over ``block`` tokens at a time; the last four windows of a block are
    chosen again with what follows. No row is moved between tasks: each partition is a stream of its
    own, and its last window is split in such a way that little is left to fill.

    A null text is like an empty one and gives the one id 0; rows without doc_id are packed with a
    null id; repeated rows are documents of their own, each with pieces from 0. Only doc_id and text
    are read. An empty table gives no rows. ``window`` is a power of two. A task holds a block and
    the document that it ends in.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fields = T.StructType.fromDDL("start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return texts.mapInArrow(_packer(vocabulary, window, block), T.StructType([texts.schema["doc_id"], *fields.fields]))
