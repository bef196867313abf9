"""N-gram Jaccard join with set relations: positions skip list blocks, similar sets share their answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import FOLD, slices, utf8
from tracewell.operators.graph import components
from tracewell.plans.lineage import settle

#: Words of a shingle, and the similarity of a link as a fraction of whole numbers.
WORDS = 5
PART, WHOLE = 3, 4
#: Shingles that a task holds while it sends them out, and that a range of hashes holds on arrival.
CHUNK, RANGE = 2_000_000, 2_000_000
CHUNK_DOCS = 30_000
#: Sets of a list that all its others are compared with before parts are formed.
PIVOTS = 2
#: Members of a part, and sets compared with them, that one row of work holds.
BLOCK, BATCH = 256, 64
#: Ids that may be broadcast; more are joined by a shuffle.
IDS = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for a shorter text, none without words."""
    words = text.translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    code = word[:n].copy()
    for k in range(1, WORDS):
        code = code * STEP + word[k : k + n]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(code ^ (code >> np.uint64(29)))


def set_key(hashes: np.ndarray) -> int:
    """One 64-bit number per set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        n = pa.array([len(s) for s in sets], pa.int64())
        key = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, key], names=["doc_id", "n", "key"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        same = [k for k, (s, key) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if len(s) and set_key(s) == key]
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.column("key")[k].as_py() for k in same], pa.int64()), pa.array([sets[k].astype(np.int64) for k in same], pa.list_(pa.int64()))],
            names=["key", "h"],
        )


# Which sets can have a partner at all: the shingles of a chunk of sets are sent out as packed
# arrays, one per range of hashes; a range tells each set how many of its shingles other sets hold.

PACKED = "range long, chunk long, what int, a binary, b binary"
CREDIT = "chunk long, what int, a binary, b binary"


def _pack(ranges: int):
    def packed(what: int, chunk: int, rng, a: list, b: list) -> pa.RecordBatch:
        size = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(rng, pa.int64()), pa.array([chunk] * size, pa.int64()), pa.array([what] * size, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
            names=["range", "chunk", "what", "a", "b"],
        )

    def chunk_rows(chunk: int, sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        hashes, slot = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        twice = np.zeros(len(ordered), bool)
        twice[1:] = ordered[1:] == ordered[:-1]
        first = ~twice
        twice[:-1] |= twice[1:]
        shared = np.zeros(len(hashes), bool)
        shared[order] = twice
        credit = np.bincount(slot[shared], minlength=len(sets)).astype(np.int32)
        keys = np.fromiter(sets, np.int64, len(sets))
        yield packed(1, chunk, [chunk % ranges], [keys.tobytes()], [np.stack([sizes.astype(np.int32), credit]).tobytes()])
        for what, some, of in ((0, hashes[~shared], slot[~shared]), (2, ordered[twice & first], None)):
            place = ((some >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            by = np.argsort(place, kind="stable")
            low, place = some[by].astype(np.uint32), place[by]
            cuts = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            a = [low[cuts[r] : cuts[r + 1]].tobytes() for r in used]
            b = [b"" if of is None else of[by[cuts[r] : cuts[r + 1]]].tobytes() for r in used]
            yield packed(what, chunk, used, a, b)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 24, 0
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py())
                if len(found):
                    key = set_key(found)
                    held += 0 if key in sets else len(found)
                    sets[key] = found
                if held >= CHUNK or len(sets) >= CHUNK_DOCS:
                    yield from chunk_rows(part + number, sets)
                    sets, held, number = {}, 0, number + 1
        if sets:
            yield from chunk_rows(part + number, sets)

    return pack


def _credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive ordered by range, and one range is held at a time; a row goes back to each chunk."""

    def out(chunk: list, what: int, a: list, b: list) -> pa.RecordBatch:
        columns = [pa.array(chunk, pa.int64()), pa.array([what] * len(a), pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "what", "a", "b"])

    def settle_range(held: list) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.concatenate([np.frombuffer(a, np.uint32) for what, _, a, _ in held if what == 2] or [np.empty(0, np.uint32)]))
        single = [(c, np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint16)) for what, c, a, b in held if what == 0]
        if not single:
            return
        low = np.concatenate([a for _, a, _ in single])
        order = np.argsort(low, kind="stable")
        ordered = low[order]
        twice = np.zeros(len(ordered), bool)
        twice[1:] = ordered[1:] == ordered[:-1]
        twice[:-1] |= twice[1:]
        if len(known):
            twice |= known[np.searchsorted(known, ordered).clip(max=len(known) - 1)] == ordered
        shared = np.zeros(len(low), bool)
        shared[order] = twice
        at, chunks, slots, counts = 0, [], [], []
        for chunk, a, slot in single:
            found, n = np.unique(slot[shared[at : at + len(a)]], return_counts=True)
            at += len(a)
            if len(found):
                chunks.append(chunk)
                slots.append(found.tobytes())
                counts.append(n.astype(np.uint32).tobytes())
        if chunks:
            yield out(chunks, 0, slots, counts)

    held, current = [], None
    for batch in batches:
        for rng, chunk, what, a, b in zip(*(batch.column(c) for c in ("range", "chunk", "what", "a", "b")), strict=True):
            rng, chunk, what, a, b = rng.as_py(), chunk.as_py(), what.as_py(), a.as_py(), b.as_py()
            if what == 1:
                yield out([chunk], 1, [a], [b])
                continue
            if rng != current:
                yield from settle_range(held)
                held, current = [], rng
            held.append((what, chunk, a, b))
    yield from settle_range(held)


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive ordered by chunk; the keys of a chunk's sets that enough other sets share."""

    def passing(held: list) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(a, np.int64) for what, a, _ in held if what == 1])
        n, credit = np.concatenate([np.frombuffer(b, np.int32).reshape(2, -1) for what, _, b in held if what == 1], 1)
        credit = credit.astype(np.int64)
        for what, a, b in held:
            if what == 0:
                credit[np.frombuffer(a, np.uint16)] += np.frombuffer(b, np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(key[credit * WHOLE >= n.astype(np.int64) * PART])], names=["key"])

    held, current = [], None
    for batch in batches:
        for chunk, what, a, b in zip(*(batch.column(c) for c in ("chunk", "what", "a", "b")), strict=True):
            if chunk.as_py() != current:
                if held:
                    yield passing(held)
                held, current = [], chunk.as_py()
            held.append((what.as_py(), a.as_py(), b.as_py()))
    if held:
        yield passing(held)


def able(texts: DataFrame, total: int) -> DataFrame:
    """(key) of sets of which three quarters or more of the shingles occur in other sets as well.

    Only these can have a link. Within a chunk a shingle is sent once, however many sets hold it, so
    a shingle of a third of all documents reaches its range once per chunk. Ranges tell shingles
    apart by 32 bits and the range, which can only let a set through, never leave one out.
    """
    ranges = max(1, math.ceil(total / RANGE))
    packed = texts.mapInArrow(_pack(ranges), PACKED).repartition("range").sortWithinPartitions("range")
    credit = packed.mapInArrow(_credit, CREDIT).repartition("chunk").sortWithinPartitions("chunk")
    return credit.mapInArrow(_able, "key long").distinct()


def least_overlap(a: Column, b: Column) -> Column:
    """Smallest common size that links sets of these sizes."""
    return F.ceil((a + b) * PART / (PART + WHOLE))


def index_lists(sets: DataFrame) -> DataFrame:
    """(h, key, n, rest): for each set the shingles of its prefix that other sets hold too.

    Shingles are ordered by the number of sets that hold them; two linked sets share one among
    their first n - ceil(0.75 n) + 1. ``rest`` is how many shingles come from here on.
    """
    single = sets.select("key", F.explode("h").alias("h"))
    often = single.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    shared = single.join(often, "h").join(sets.select("key", F.size("h").alias("n")), "key")
    mine = Window.partitionBy("key")
    placed = shared.withColumn("rest", F.count(F.lit(1)).over(mine) - F.row_number().over(mine.orderBy("df", "h")) + 1)
    prefix = F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1
    return placed.where(F.col("n") - F.col("rest") < prefix).select("h", "key", "n", "rest")


def can_link(n: Column, rest: Column, other_n: Column, other_rest: Column) -> Column:
    """Whether a pair whose first common shingle stands here can reach the similarity: by sizes, then
    by what is left of both sets from these positions on."""
    sizes = (n * WHOLE >= other_n * PART) & (other_n * WHOLE >= n * PART)
    return sizes & (F.least(rest, other_rest) >= least_overlap(n, other_n))


def linked(common: Column, a: Column, b: Column) -> Column:
    return common * WHOLE >= (a + b - common) * PART


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch of sets with the members of a block of a part.

    The common size with the pivot is counted once per set; that with a member follows from it:
    minus what the set shares with the pivot's shingles that the member lacks, plus what it shares
    with those that the member has beyond the pivot.
    """
    for batch in batches:
        src, dst = [], []
        for k in range(batch.num_rows):
            pivot = np.asarray(batch.column("pivot")[k].values)
            members = batch.column("members")[k].as_py()
            keys, sizes = np.array([m["key"] for m in members]), np.array([m["n"] for m in members])
            lack = [m["lacks"] for m in members]
            more = [m["has"] for m in members]
            changes = np.array([h for x in (*lack, *more) for h in x], np.int64)
            owner = np.repeat(np.arange(2 * len(members)), [len(x) for x in (*lack, *more)])
            for one in batch.column("some")[k].as_py():
                own = np.array(one["h"], np.int64)
                base = len(np.intersect1d(own, pivot, assume_unique=True))
                hit = np.bincount(owner[np.isin(changes, own)], minlength=2 * len(members))
                common = base - hit[: len(members)] + hit[len(members) :]
                found = np.flatnonzero((common * WHOLE >= (len(own) + sizes - common) * PART) & (keys != one["key"]))
                if len(found):  # one link to the block is enough, its members are connected already
                    src.append(one["key"])
                    dst.append(int(keys[found].min()))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def pivots(lists: DataFrame) -> DataFrame:
    """(h, p): of every list with several entries the smallest ones in ``PIVOTS`` orders, each once."""
    orders = [F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("order"), "key", "n", "rest")).alias(f"p{turn}") for turn in range(PIVOTS)]
    head = lists.groupBy("h").agg(*orders, F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    every = F.array(*[F.col(f"p{turn}").dropFields("order") for turn in range(PIVOTS)])
    return head.select("h", F.explode(F.array_distinct(every)).alias("p"))


def list_blocks(entries: DataFrame) -> DataFrame:
    """(h, q, q_members, low, high, q_rest): the lists cut into blocks by part and position, each with its bounds.

    A block holds the entries of one part whose places from the end lie between two powers of two. An
    entry skips a block as a whole where not even the block's best sizes and place could link.
    """
    block = F.floor(F.log2(F.col("rest").cast("double")))
    return entries.groupBy("h", F.col("part").alias("q"), F.col("members").alias("q_members"), block.alias("position")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("q_rest")
    )


def links(sets: DataFrame) -> DataFrame:
    """(src, dst) links over (key, h), enough to connect all sets that links connect.

    First every list compares its members with a few of them, the pivots. Sets that links connect by
    now are a part, and pairs within a part are settled, so lists of one part are dropped. In the
    others every set of a smaller part is compared with whole larger parts that it meets in a block
    of a list: the answers for the members are derived from that for the part's smallest set and the
    members' differences from it. So a group of g near copies costs about g comparisons, not g * g.
    """
    lists = settle(index_lists(sets))
    met = lists.join(pivots(lists), "h").where(F.col("key") != F.col("p.key"))
    able_ = met.where(can_link(F.col("n"), F.col("rest"), F.col("p.n"), F.col("p.rest")))
    pairs = able_.select(F.least("key", "p.key").alias("src"), F.greatest("key", "p.key").alias("dst")).distinct()
    one, two = (sets.select(F.col("key").alias(name), F.col("h").alias(f"{name}_h")) for name in ("src", "dst"))
    common = F.size(F.array_intersect("src_h", "dst_h"))
    tried = pairs.join(one, "src").join(two, "dst").select("src", "dst", common.alias("common"), F.size("src_h").alias("a"), F.size("dst_h").alias("b"))
    first = settle(tried.where(linked(F.col("common"), F.col("a"), F.col("b"))).select("src", "dst"))
    placed = components(sets.select(F.col("key").alias("node")), first).select(F.col("node").alias("key"), F.col("component").alias("part"))
    home = sets.select("key", F.size("h").alias("n")).join(placed, "key")
    sizes = home.groupBy("part").agg(F.count(F.lit(1)).alias("members"))
    home = settle(home.join(sizes, "part").select("key", "n", "part", "members"))

    entries = lists.join(home.select("key", "part", "members"), "key")
    mixed = entries.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b")).where(F.col("a") != F.col("b")).select("h")
    entries = settle(entries.join(mixed, "h"))
    n, least = F.col("n"), F.greatest(F.col("low"), F.ceil(F.col("n") * PART / WHOLE))
    may = (F.col("high") * WHOLE >= n * PART) & (F.col("low") * PART <= n * WHOLE) & (F.least("rest", "q_rest") >= least_overlap(n, least))
    order = F.struct("members", "part") < F.struct("q_members", "q")
    todo = settle(entries.join(list_blocks(entries), "h").where(order & may).select("key", "q", "q_members").distinct())

    # a part is read in blocks of members, each with their differences from the part's smallest set
    blocks_of = F.ceil(F.col("q_members") / BLOCK)
    wanted = todo.select("q", "q_members").distinct()
    roots = wanted.join(sets.select(F.col("key").alias("q"), F.col("h").alias("pivot")), "q")
    roots = roots.select("q", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of - 1)).alias("block"), "pivot")
    mine = home.select(F.col("part").alias("q"), "key", "n").join(wanted, "q").withColumn("block", F.pmod(F.xxhash64("key"), blocks_of))
    mine = mine.join(sets.select("key", "h"), "key").join(roots, ["q", "block"])
    member = F.struct("key", "n", F.array_except("pivot", "h").alias("lacks"), F.array_except("h", "pivot").alias("has"))
    blocks = mine.groupBy("q", "block").agg(F.collect_list(member).alias("members")).join(roots, ["q", "block"])
    asked = todo.groupBy("q").agg(F.count(F.lit(1)).alias("asked"))
    batches = todo.join(asked, "q").withColumn("batch", F.pmod(F.xxhash64("key"), F.ceil(F.col("asked") / BATCH))).join(sets.select("key", "h"), "key")
    batches = batches.groupBy("q", "batch").agg(F.collect_list(F.struct("key", "h")).alias("some"))
    second = batches.join(blocks, "q").select("some", "members", "pivot").mapInArrow(_compare, "src long, dst long")
    return first.unionByName(second)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents link when the Jaccard similarity of their shingle sets is 0.75 or more; a component is
    named by its smallest doc_id. Null and empty texts have no shingles and stand alone; a row
    without doc_id takes no part and has no component; rows that share a doc_id are one document and
    connect what their texts link to. Other columns are not read. An empty table gives no rows.
    Sets are told apart by 64-bit hashes of shingles, and equal sets by one of the whole set.
    """
    texts = docs.select("doc_id", utf8("text").alias("text"))
    known = settle(texts.mapInArrow(_sizes, "doc_id long, n long, key long"))
    total = known.agg(F.sum("n")).first()[0] or 0
    full = known.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    classes = settle(full.groupBy("key").agg(F.min("doc_id").alias("doc_id")))

    chosen = settle(able(texts.where(F.col("doc_id").isNotNull()).select("text"), total).join(classes, "key"))
    ids = F.broadcast(chosen) if chosen.count() <= IDS else chosen
    sets = settle(texts.join(ids, "doc_id").mapInArrow(_hashes, "key long, h array<long>").groupBy("key").agg(F.min("h").alias("h")))
    edges = links(sets)
    # ids whose rows have different texts connect them
    several = full.groupBy("doc_id").agg(F.min("key").alias("dst"), F.max("key").alias("top")).where(F.col("dst") != F.col("top"))
    same = full.join(several, "doc_id").select(F.col("key").alias("src"), "dst")
    edges = settle(edges.unionByName(same.where(F.col("src") != F.col("dst"))))
    touched = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    placed = components(touched, edges)
    named = placed.join(classes.withColumnRenamed("key", "node"), "node").select("node", "component", "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    class_of = named.join(least, "component").select(F.col("node").alias("key"), F.col("least"))
    class_of = classes.join(class_of, "key", "left").select("key", F.coalesce("least", "doc_id").alias("component_id"))
    out = known.join(class_of, "key", "left")
    named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), named_id.alias("component_id"))
