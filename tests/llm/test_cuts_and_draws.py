"""Packing, clustering and resampling against plain loops, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from tracewell.llm import clustering, packing, resampling

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
# extra columns carry the names that operators use themselves
SCHEMA = "doc_id long, text string, start long, ids string, rank long, weight long, score long, block long, high long, rows long"
TEXTS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (None, "no id at all"), (5, " \n\t "), (6, LONG),
    (7, "one two three four five six seven"), (7, "one two three four five six seven"), (8, "a"), (9, "a"), (10, "Grüße ÉÀ   x"),
    (11, "x <|endoftext|>y  z\x1c\x85 don't 1234.5\r\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, *([k, "x"] + [k] * 6)) for k, (d, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 ------------------------------------------------------------------------------------------

VOCABULARY = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, texts, tokenizer):
    """Every id lies in one piece, pieces follow each other in a sequence, nothing is longer than it may be."""
    wanted = Counter()
    for doc_id, text in texts:
        wanted[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        by_doc[r["doc_id"]].append((r["sequence_id"], r["offset"], r["start"], r["doc_tokens"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    found = Counter()
    for doc_id, parts in by_doc.items():
        ids = []
        for _, _, start, n, piece in sorted(parts, key=lambda p: p[:2]):
            assert start == len(ids)
            ids += piece.tolist()
            if len(ids) == n:
                found[doc_id, tuple(ids)] += 1
                ids = []
        assert not ids
    assert found == wanted
    return [sum(length for _, length in parts) for parts in by_sequence.values()]


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in lengths)


@pytest.mark.parametrize("block", [packing.BLOCK, 8192])
def test_packing_places_every_id_once(spark, odd, empty, tokenizer, block):
    rows = packing.pack(odd, VOCABULARY, block=block).collect()
    check_pieces(rows, TEXTS, tokenizer)
    assert packing.pack(empty, VOCABULARY).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lengths = check_pieces(packing.pack(docs, VOCABULARY, block=block).collect(), texts, tokenizer)
    assert padding(lengths) < 0.015 * sum(lengths)


def test_packing_query_counts_ids(spark, tokenizer):
    rows = entry.queries()["op11_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_cuts_cost_least():
    draw = np.random.default_rng(11)
    for _ in range(150):
        size = int(draw.integers(1, 120))
        places = np.unique(np.concatenate([[0, size], np.arange(0, size, 12), draw.integers(0, size + 1, draw.integers(0, 40))]))
        cost = draw.choice([0.0, 2.0, 8.0], len(places))
        cuts = packing.best_cuts(places, cost, 16)
        price = dict(zip(places.tolist(), cost.tolist(), strict=True))
        best = {0: 0.0}
        for e in places[1:].tolist():
            best[e] = min(
                best[s] + price[e] + packing.EACH_WINDOW + (0 if (e - s) & (e - s - 1) == 0 else 16 - (e - s)) for s in places.tolist() if s < e <= s + 16
            )
        paid = sum(price[b] + packing.EACH_WINDOW + (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == size and all(0 < b - a <= 16 for a, b in zip(cuts, cuts[1:]))
        assert paid == pytest.approx(best[size])


def test_cuts_prefer_document_and_sentence_ends(spark):
    docs = spark.createDataFrame([(k, "Short words stand here. " * (200 + k) + "The end.") for k in range(60)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, VOCABULARY).collect()
    ends, begins = packing.sentence_marks(VOCABULARY)
    inside = 0
    for r in rows:
        if r["start"] + r["length"] < r["doc_tokens"]:
            inside += not ends[np.frombuffer(r["ids"], "<u4")[-1]]
    assert len(rows) > 60 and inside <= 2


# 12 ------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, seed="2"):
    """Plain rounds over (id, vector) with whole numbers."""
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centroids = [list(x) for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        parts = defaultdict(list)
        for _, x in rows:
            parts[nearest(x)[1]].append(x)
        for j, xs in parts.items():
            centroids[j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    return Counter((i, nearest(x)[1], nearest(x)[0]) for i, x in rows), centroids


@pytest.mark.parametrize("n, k, width, spread", [(300, 12, 4, 3), (200, 40, 2, 2), (5, 9, 3, 4), (400, 6, 8, 900)])
def test_clusters_are_those_of_plain_rounds(spark, n, k, width, spread):
    draw = np.random.default_rng(n)
    rows = [(int(draw.integers(0, n)) if draw.random() > 0.1 else None, draw.integers(-spread, spread, width).tolist()) for _ in range(n)]
    frame = spark.createDataFrame([(i, [v / 4 for v in x], 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    assigned, centroids = clustering.cluster(frame, clusters=k, rounds=4, width=width, scale=4, block=16)
    want, means = lloyd(rows, k, 4)
    assert Counter(tuple(r) for r in assigned.collect()) == want
    got = {r["cluster"]: r for r in centroids.collect()}
    assert [got[j]["x"] for j in range(len(means))] == means
    for j in got:
        assert got[j]["members"] == sum(c for (_, of, _), c in want.items() if of == j)
        assert got[j]["inertia"] == sum(d * c for (_, of, d), c in want.items() if of == j)
        assert got[j]["total"] == sum(d * c for (_, _, d), c in want.items())


def test_only_expired_vectors_are_scanned_again():
    draw = np.random.default_rng(3)
    middles = draw.integers(-5000, 5000, (6, 8))
    x = (middles[draw.integers(0, 6, 3000)] + draw.integers(-60, 60, (3000, 8))).astype(np.int64)
    now = clustering.Centroids(middles.astype(np.int64), np.zeros(6))
    heaps, seen, sums = clustering.Heaps.new(x, 6), [], np.zeros((6, 9), np.int64)
    measured = clustering.Centroids.distances
    try:
        clustering.Centroids.distances = lambda self, some: seen.append(len(some)) or measured(self, some)
        for _ in range(4):
            sums += heaps.reassign(now)
            now = now.moved(sums[:, :-1] // sums[:, -1:])
    finally:
        clustering.Centroids.distances = measured
    assert seen[0] == 3000 and sum(seen[1:]) < 300
    assert (heaps.cluster == measured(now, x).argmin(1)).all()
    again = clustering.Heaps.of(heaps.row([], sums), 6)
    assert again.heaps == heaps.heaps and (again.x == x).all()


def test_clusters_of_odd_vectors(spark):
    schema = T.StructType.fromDDL("vec_id long, embedding array<float>, distance long, cluster string, x long, ids string")
    good = [1.0] * 64
    vectors = [(1, good), (2, None), (3, []), (4, good[:63]), (5, good[:63] + [None]), (6, good[:63] + [float("nan")]), (7, good[:63] + [float("inf")])]
    vectors += [(8, good), (8, good), (None, [2.0] * 64), (9, [3e38] * 64)]
    frame = spark.createDataFrame([(i, x, 0, "c", 0, "i") for i, x in vectors], schema)
    assigned, centroids = clustering.cluster(frame)
    got = assigned.collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 8, 8, 9]
    assert centroids.count() == 4 and {r["total"] for r in centroids.collect()} == {sum(r["distance"] for r in got)}
    assert [f.collect() for f in clustering.cluster(frame.limit(0))] == [[], []]


# 13 ------------------------------------------------------------------------------------------


def drawn(texts, target, longest=1, buckets=10_000, seed="2024", percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    made = [(d, *features(t)) for d, t in texts]
    s, t = Counter(bucket(f) for _, _, fs in made for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))

    rows = []
    for doc_id, n, fs in made:
        weight = sum(gain(bucket(f)) for f in fs)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n, len(fs), weight, score))
    able = sorted((r for r in rows if r[4] is not None and r[1] >= 20), key=lambda r: (-r[4], r[0], r[1], r[2]))
    ranks = defaultdict(list)
    for k, r in enumerate(able):
        ranks[r].append(k + 1 if k < len(able) * percent // 100 else None)
    return Counter((*r, ranks[r].pop(0) if ranks[r] else None) for r in rows)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 100), (3, 40)])
def test_resampling_is_that_of_plain_loops(spark, odd, longest, percent):
    draw = np.random.default_rng(longest)
    vocabulary = ["alpha", "Beta", "çà", "x1", "delta", "EPS", "zeta"]
    texts = [(int(draw.integers(-50, 400)), " ".join(draw.choice(vocabulary, draw.integers(15, 40)))) for _ in range(400)]
    texts += texts[:30] + [(5, "alpha beta " * 15)] * 60 + TEXTS
    target = [" ".join(draw.choice(vocabulary[:3], 50)), None, ""]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, items, percent=percent, longest=longest)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == drawn(texts, target, longest, percent=percent)


def test_resampling_of_odd_rows(spark, odd, empty):
    got = resampling.resample(odd, odd.select("text")).collect()
    assert len(got) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["n_features"] == by_id[3]["weight"] == 0 and by_id[None]["score"] is None and by_id[None]["rank"] is None
    assert [r["rank"] for r in resampling.resample(odd, empty, percent=100).collect() if r["doc_id"] == 6] == [1]
    assert resampling.resample(empty, odd).count() == 0


@pytest.mark.parametrize("low", [1, 300, 2**62])
def test_radix_sort_in_small_blocks(spark, low):
    draw = np.random.default_rng(13)
    keys = {(int(draw.integers(-40, 40)), int(draw.integers(-low, low))) for _ in range(700)}
    keys |= {(7, k) for k in range(500)}  # one digit holds most keys
    rows = [(h, x, int(draw.integers(1, 5))) for h, x in keys]
    records = spark.createDataFrame(rows, "high long, low long, each long").repartition(5)
    got = {(r["high"], r["low"]): (r["each"], r["before"]) for r in resampling.radix_sort(records, block=64).collect()}
    before = 0
    for h, x, each in sorted(rows):
        assert got[h, x] == (each, before)
        before += each
    assert resampling.radix_sort(records.limit(0)).count() == 0


def test_gains_of_equal_shares_are_none():
    same = np.array([3, 0, 9])
    assert (resampling.gains(same, same) == 0).all()
    features = resampling.Features(97, 2)
    n, at = features.of(b"A b a")
    assert n == 3 and at.tolist() == [zlib.crc32(f) % 97 for f in (b"a", b"b", b"a", b"a b", b"b a")]
