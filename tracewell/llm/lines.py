"""Line dedup: documents paired through shared lines, aligned by patience diff, common blocks deleted from the later one.

A line is a run of ``GRAM`` words wherever it stands, so that line ends do not matter. The lines of a
document are sampled: of the lines in a stretch of words the one with the smallest hash stands for it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import packed

#: Passages of more words than this that an earlier document holds too are deleted.
MOST_SHARED = 50
#: Words of a line.
GRAM = 8
#: Bytes of text that are hashed at once, that a chunk of documents holds about, and whose stretches a range of hashes holds at most.
RUN, CHUNK, RANGE = 1_500_000, 8_000_000, 16_000_000
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
FOLDED = np.arange(256, dtype=np.uint64)
FOLDED[65:91] += np.uint64(32)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end] that does not depend on where it stands."""
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _powers(ODD, len(values)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(INVERSE, len(values))[starts.clip(max=len(values) - 1)] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a run of texts, as arrays: text, first byte in its text, hash, and whether a line of the text starts here."""

    owner: np.ndarray
    start: np.ndarray
    hash: np.ndarray
    opens: np.ndarray


def cut(texts: list[bytes]) -> Words:
    """Words of all texts; ASCII letters are hashed in lower case, blanks and line ends are not told apart."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(lengths) - lengths
    blank = np.concatenate([[True], BLANKS[data]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    row = np.cumsum(np.concatenate([[0], data == 10]))[starts]  # number of line ends before the word
    opens = np.ones(len(starts), bool)
    opens[1:] = row[1:] != row[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    return Words(owner, starts - begin[owner], _run_hashes(FOLDED[data], starts, ends), opens)


def runs(texts: list[bytes]) -> Iterator[tuple[int, int, Words]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= RUN or k == len(texts) - 1:
            yield first, k + 1, cut(texts[first : k + 1])
            first, size = k + 1, 0


def windows(words: Words, size: int) -> np.ndarray:
    """First words of all windows of ``size`` words within one text."""
    return np.flatnonzero(words.owner[: max(len(words.owner) - size + 1, 0)] == words.owner[size - 1 :])


def signs(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """The smallest hash of a gram in each window: equal windows have equal signs, and neighbours mostly share theirs."""
    if not len(at):
        return np.empty(0, np.int64)
    gram = min(GRAM, size)
    first = np.arange(len(words.hash) - gram + 1)
    low, span, most = _run_hashes(words.hash, first, first + gram), 1, size - gram + 1
    while span < most:
        step = min(span, most - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low[at].astype(np.int64)


def bodies(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of each whole window."""
    return _run_hashes(words.hash, at, at + size).astype(np.int64)


LINES = "chunk long, hash long, low long, high long"
STRETCHES = "range long, chunk long, hash binary, low_base long, low binary, at_base long, at binary"
ANSWERS = "chunk long, hash binary, first_base long, first binary, at_base long, at binary"


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as their smallest one and differences from it, in as few bytes as hold all."""
    base = int(values.min())
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max()) - base < 1 << 8 * w)
    return base, (values.view(np.uint64) - np.uint64(base % 2**64)).astype(f"<u{width}").tobytes()


def _wide(bases, held, sizes: list[int]) -> np.ndarray:
    """The numbers of several rows, one row after the other."""
    out = [np.empty(0, np.int64)]
    for base, x, n in zip(bases.to_pylist(), held.to_pylist(), sizes, strict=True):
        out.append((np.frombuffer(x, f"<u{len(x) // n}").astype(np.uint64) + np.uint64(base % 2**64)).view(np.int64))
    return np.concatenate(out)


def _bounds(chunk: int, hashes: list[np.ndarray], ids: list[np.ndarray], places: list[np.ndarray] | None = None) -> pa.Table:
    """Each hash of a chunk once, with the smallest and the largest id of its documents there.

    With ``places``, ``at`` is given in place of the largest id: four times the first place in the
    smallest document, plus 2 if that document holds it once, plus 1 if several documents hold it.
    """
    h, doc = (np.concatenate([np.empty(0, np.int64), *x]) for x in (hashes, ids))
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    low, high = (f.reduceat(doc, new) if len(new) else doc for f in (np.minimum, np.maximum))
    out = {"chunk": np.full(len(new), chunk, np.int64), "hash": h[new], "low": low}
    if places is None:
        return pa.table({**out, "high": high})
    if len(new):
        held = doc == np.repeat(low, np.diff(np.append(new, len(h))))
        first = np.minimum.reduceat(np.where(held, np.concatenate(places)[order], np.iinfo(np.int64).max), new)
        low = 4 * first + 2 * (np.add.reduceat(held.astype(np.int64), new) == 1) + (high > low)
    return pa.table({**out, "at": low})


def _texts(docs: pa.Table) -> list[bytes]:
    """The texts, which only ``row`` holds, so that they are not moved twice; empty for a null."""
    return pa.compute.struct_field(docs["row"], "text").cast(pa.binary()).fill_null(b"").to_pylist()


def _runs_with_id(docs: pa.Table) -> Iterator[tuple[np.ndarray, Words]]:
    docs = docs.filter(docs["doc_id"].is_valid())
    ids = docs["doc_id"].to_numpy()
    for first, last, words in runs(_texts(docs)):
        yield ids[first:last], words


def _signs(size: int):
    """Phase 1: the lines that stand for the stretches of ``size`` words."""

    def sign(docs: pa.Table) -> pa.Table:
        hashes, ids = [], []
        for own, words in _runs_with_id(docs):
            at = windows(words, size)
            h, doc = signs(words, at, size), own[words.owner[at]]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            hashes.append(h[new])
            ids.append(doc[new])
        return _bounds(docs["chunk"][0].as_py(), hashes, ids)

    return sign


def _bodies(size: int, ranges: int):
    """Phase 2: the stretches whose line several documents hold, packed by range of their hash."""

    def body(docs: pa.Table, shared: pa.Table) -> pa.Table:
        marked = np.sort(shared["hash"].to_numpy())
        hashes, ids, places = [], [], []
        if len(marked):
            for own, words in _runs_with_id(docs):
                at = windows(words, size)
                at = at[_found(marked, signs(words, at, size))[1]]
                hashes.append(bodies(words, at, size))
                ids.append(own[words.owner[at]])
                places.append(at - np.searchsorted(words.owner, words.owner[at]))
        chunk = docs["chunk"][0].as_py() if docs.num_rows else 0
        found = _bounds(chunk, hashes, ids, places)
        h, low, at = (found[c].to_numpy() for c in ("hash", "low", "at"))
        place = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        by = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by], np.arange(ranges + 1, dtype=np.uint64))
        rows = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            some = by[cuts[r] : cuts[r + 1]]
            rows.append((r, chunk, h[some].tobytes(), *_narrow(low[some]), *_narrow(at[some])))
        return _table(rows, STRETCHES)

    return body


def _table(rows: list[tuple], fields: str) -> pa.Table:
    kinds = [(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.binary()) for f in fields.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _firsts(stretches: pa.Table) -> pa.Table:
    """For a range of hashes: tells each chunk the first holder of its stretches, if it holds them later."""
    sizes = [len(x) // 8 for x in stretches["hash"].to_pylist()]
    h = np.concatenate([np.frombuffer(x, np.int64) for x in stretches["hash"].to_pylist()])
    low, at = (_wide(stretches[f"{c}_base"], stretches[c], sizes) for c in ("low", "at"))
    order = np.lexsort((low, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    heads = order[new]  # the row of the smallest document of each hash
    first, spot = low[heads][group], at[heads][group]
    wanted = (first < low) | (at % 2 == 1)
    cuts = np.cumsum([0, *sizes])
    rows = []
    for chunk, a, b in zip(stretches["chunk"].to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = a + np.flatnonzero(wanted[a:b])
        if len(some):
            rows.append((chunk, h[some].tobytes(), *_narrow(first[some]), *_narrow(spot[some])))
    return _table(rows, ANSWERS)


def _found(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array that is not empty, and whether it is there."""
    place = np.searchsorted(ordered, values).clip(max=len(ordered) - 1)
    return place, ordered[place] == values


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(at[p - 1] if p else -1)
        tops[p : p + 1], at[p : p + 1] = [v], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(runs: list[tuple[int, int, int, bool]]) -> list[int]:
    """The round in which each run is aligned; ``runs`` are (first, length, place in the other document, anchored).

    Runs with a stretch that stands once in both documents are the anchors of patience diff; a
    longest chain of them in the order of both documents is aligned, and so are the runs without
    anchor that fit between two links of the chain. Where no anchor is left, equal stretches are told
    apart by their order: the first run of each place stands for it. What is out of order, that is
    moved or repeated, is aligned again in the next round, until nothing is left.
    """
    out = [-1] * len(runs)
    left, number = list(range(len(runs))), 0
    while left:
        anchors = [k for k in left if runs[k][3]]
        if not anchors:
            anchors = list({runs[k][2]: k for k in reversed(left)}.values())[::-1]
        chain = [anchors[k] for k in increasing([runs[k][2] for k in anchors])]
        edges = [-1, *chain, len(runs)]
        taken = set(chain)
        for a, b in zip(edges, edges[1:]):  # again between the links
            low = runs[a][2] if a >= 0 else -1
            high = runs[b][2] if b < len(runs) else math.inf
            inner = [k for k in left if a < k < b and low < runs[k][2] < high]
            taken.update(inner[k] for k in increasing([runs[k][2] for k in inner]))
        for k in taken:
            out[k] = number
        left, number = [k for k in left if k not in taken], number + 1
    return out


@dataclass
class Blocks:
    """Aligned blocks: first stretch, stretches, holder, and the round in which they were aligned."""

    first: np.ndarray
    length: np.ndarray
    holder: np.ndarray
    round: np.ndarray


def aligned(doc: np.ndarray, holder: np.ndarray, here: np.ndarray, there: np.ndarray, once: np.ndarray) -> Blocks:
    """Align each document with each of its holders.

    A row says that the stretch at ``here`` of ``doc`` stands at ``there`` in ``holder``, and whether
    only once there. Rows that go on by one in both documents are a run; pairs of one run are aligned
    as they stand, the others by patience diff over their runs.
    """
    order = np.lexsort((here, holder, doc))
    doc, holder, here, there, once = (x[order] for x in (doc, holder, here, there, once))
    if not len(doc):
        return Blocks(here, here, holder, here)
    pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (holder[1:] != holder[:-1])])
    new = pair | np.concatenate([[True], (np.diff(here) != 1) | (np.diff(there) != 1)])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(doc)))
    # a stretch that stands once in the holder is an anchor if the document holds it once as well
    number = np.cumsum(pair) - 1
    by = np.lexsort((there, number))
    twice = np.concatenate([[False], (number[by][1:] == number[by][:-1]) & (there[by][1:] == there[by][:-1])])
    twice[:-1] |= twice[1:]
    alone = np.empty(len(doc), bool)
    alone[by] = ~twice
    anchored = np.logical_or.reduceat(alone & once, first)
    rounds = np.zeros(len(first), np.int64)
    cuts = np.append(np.flatnonzero(pair[first]), len(first))
    for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
        some = slice(cuts[k], cuts[k + 1])
        at = first[some]
        rounds[some] = patience(list(zip(here[at].tolist(), length[some].tolist(), there[at].tolist(), anchored[some].tolist(), strict=True)))
    return Blocks(here[first], length, holder[first], rounds)


def without(text: bytes, starts: np.ndarray, opens: np.ndarray, gone: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the marked lines, and the byte spans that were left out. A line end stays
    if the deletion begins inside a line."""
    edges = np.append(starts, len(text))
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    parts, spans, at = [], [], 0
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        x, y = int(edges[a]), int(edges[b])
        parts.append(text[at:x])
        if b"\n" in text[x:y] and not opens[a] and b < len(gone):
            parts.append(b"\n")
        spans.append((x, y))
        at = y
    return b"".join(parts) + text[at:], spans


FIELDS = (
    "text string, n_words long, n_deleted long, spans array<struct<start:int,end:int>>, "
    "blocks array<struct<first_word:int,n_words:int,holder:bigint,round:int>>"
)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
BLOCKS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("holder", pa.int64()), ("round", pa.int32())]))


def _edit(size: int):
    """Phase 3: align each document with the first holders of its stretches and leave out the aligned blocks."""

    def edit(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes = [len(x) // 8 for x in right["hash"].to_pylist()]
        h = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in right["hash"].to_pylist())])
        order = np.argsort(h, kind="stable")
        h, holder, spot = h[order], *(_wide(right[f"{c}_base"], right[c], sizes)[order] for c in ("first", "at"))
        texts = _texts(left)
        ids = left["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()  # before any other: nothing is earlier
        new, n_words, n_deleted, spans, blocks = [], [], [], [], []
        for first, last, words in runs(texts):
            gone = np.zeros(len(words.hash), bool)
            cuts = np.searchsorted(words.owner, np.arange(last - first + 1))
            found: list[list[dict]] = [[] for _ in range(first, last)]
            if len(h):
                at = windows(words, size)
                place, known = _found(h, bodies(words, at, size))
                known &= holder[place] < ids[first:last][words.owner[at]]
                at, place = at[known], place[known]
                cut_out = aligned(words.owner[at], holder[place], at, spot[place] >> 2, (spot[place] & 2) > 0)
                ends = cut_out.first + cut_out.length + size - 1
                covered = np.bincount(cut_out.first, minlength=len(gone) + 1) - np.bincount(ends, minlength=len(gone) + 1)
                gone = np.cumsum(covered)[: len(gone)] > 0
                for a, b, of, number in zip(cut_out.first.tolist(), ends.tolist(), cut_out.holder.tolist(), cut_out.round.tolist(), strict=True):
                    k = int(words.owner[a])
                    found[k].append({"first_word": a - int(cuts[k]), "n_words": b - a, "holder": of, "round": number})
            for k in range(last - first):
                some, text = slice(cuts[k], cuts[k + 1]), texts[first + k]
                left_over, cut_out = without(text, words.start[some], words.opens[some], gone[some]) if gone[some].any() else (text, [])
                new.append(left_over.decode("utf-8", "replace"))
                n_words.append(int(cuts[k + 1] - cuts[k]))
                n_deleted.append(int(gone[some].sum()))
                spans.append([{"start": len(text[:a].decode("utf-8", "replace")), "end": len(text[:b].decode("utf-8", "replace"))} for a, b in cut_out])
                blocks.append(sorted(found[k], key=lambda b: b["first_word"]))
        made = [pa.array(new, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_deleted, pa.int64()), pa.array(spans, SPANS), pa.array(blocks, BLOCKS)]
        return pa.Table.from_arrays([left["row"], *made], names=["row", "text", "n_words", "n_deleted", "spans", "blocks"])

    return edit


def dedup(docs: DataFrame, most: int = MOST_SHARED, chunk: int = CHUNK) -> DataFrame:
    """(row, text, n_words, n_deleted, spans, blocks) for every row of ``docs``.

    A passage is deleted if it has more than ``most`` words and one document with a smaller doc_id
    holds it whole, wherever and however often it stands in either, and whatever its place in a line.

    Documents are paired through shared lines: every stretch of ``most + 1`` words has a line that
    stands for it, the one with the smallest hash, and stretches whose line only one document holds
    are left out. Of the documents that hold a stretch the one with the smallest doc_id represents
    them, so a document is paired with few others however many hold its lines. Each pair is aligned
    by patience diff, again over what is left for passages that moved or stand twice, and the words
    of the aligned blocks are deleted from the later document. ``blocks`` are those blocks with their
    holder and the round of the alignment (0: in the order of both), ``text`` is what is left and
    ``spans`` are the code-point offsets of what was deleted. Line ends count as blanks.

    Null texts stay empty texts and hold no words; a row without doc_id, or with one that is no whole
    number, has no place in the order, takes no part and keeps its text; rows with one doc_id are not
    compared with each other. An empty table gives no rows. Texts move once, to chunks of documents
    by a hash of the id; a chunk sends each hash once, so a stretch in very many documents is sent
    once per chunk. Stretches are packed by chunk and range of hashes and told apart by 64 bits.
    """
    size = most + 1
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk))
    doc_id = F.col("doc_id").try_cast("long")
    place = F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(chunks)), F.lit(0))
    frame = packed(docs, doc_id.alias("doc_id"), place.alias("chunk"))
    grouped = frame.groupBy("chunk")
    holders = Window.partitionBy("hash")
    lines = grouped.applyInArrow(_signs(size), LINES)
    lines = lines.select("chunk", "hash", F.min("low").over(holders).alias("first"), F.max("high").over(holders).alias("last"))
    shared = lines.where(F.col("first") < F.col("last")).select("chunk", "hash")
    ranges = max(1, math.ceil(total / RANGE))
    held = grouped.cogroup(shared.groupBy("chunk")).applyInArrow(_bodies(size, ranges), STRETCHES)
    answers = held.groupBy("range").applyInArrow(_firsts, ANSWERS)
    schema = T.StructType([frame.schema["row"], *T.StructType.fromDDL(FIELDS).fields])
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(_edit(size), schema)
