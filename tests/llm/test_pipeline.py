"""The corpus pipeline as a chain: planted cases, odd rows, clashing columns, empty tables."""

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, score double, key long, h long, chunk long, "
    "size long, target double, copies long, gone long, spans string, label int, cells string"
)
LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"


def passage(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(n))


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = "edit" + words[p]
    return " ".join(words)


def write(spark, folder, rows, labels, items):
    clash = ("r", 0.5, 1, 2, 3, 4, 5.0, 6, 7, "s", 1, "c")
    docs = [(d, t, "en", s, None if t is None else len(t), *clash) for d, t, s in rows]
    for name, data, schema in (("documents", docs, SCHEMA), ("labels", labels, LABELS), ("benchmark", items, BENCHMARK)):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def planted():
    sources = ("a", "b", "c", None)
    clean = {k: passage(k, 90 + k % 40) for k in range(1, 81)}
    toxic = {k: passage(k, 60) + " zzscum zztrash zzidiot " + passage(k + 1, 20) + " zzscum zztrash" for k in range(101, 141)}
    item = passage(900, 20)
    bad = {201: clean[1], 202: clean[1], 203: edited(passage(500, 120), (40, 80)), 204: f"{passage(901, 30)} {item} {passage(902, 30)}"}
    clean[90] = passage(500, 120)  # its near copy 203 goes
    clean[91] = f"{passage(903, 60)}\n{clean[3]}\n{passage(904, 60)}"  # the passage goes, the rest stays
    rows = [(d, t, sources[d % 4]) for d, t in (clean | toxic | bad).items()]
    rows += [(300, None, "a"), (301, "", "b"), (None, passage(905, 70), "c"), (302, passage(906, 70), "a"), (302, passage(906, 70), "a")]
    labels = [(d, 1, int(d in toxic)) for d in (*range(1, 61), *range(101, 131))] + [(None, 1, 1), (5, None, None), (999, 0, 1)]
    return rows, labels, [(1, item), (2, None), (3, ""), (1, item)], set(clean), set(toxic) | set(bad)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("planted"))
    write(spark, place, *planted()[:3])
    return place


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, folder):
    _, _, _, clean, bad = planted()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, folder).collect(), before.schema)
        assert docs.columns == before.columns, name
        kept[name] = [r["doc_id"] for r in docs.collect()]
        assert clean <= set(kept[name]), (name, clean - set(kept[name]))
    assert not set(kept["toxicity"]) & set(range(101, 141))
    assert not set(kept["line_dedup"]) & {201, 202} and 203 in kept["line_dedup"]
    assert 203 not in kept["jaccard_join"] and 204 in kept["jaccard_join"]
    assert not set(kept["decontamination"]) & bad
    assert {300, 301, None} <= set(kept["decontamination"]) and kept["decontamination"].count(302) == 2
    cut = docs.where("doc_id = 91").first()
    assert cut["text"].split() == (passage(903, 60) + " " + passage(904, 60)).split() and cut["n_chars"] == len(cut["text"])
    assert docs.where("row = 'r' AND score = 0.5 AND chunk = 3 AND spans = 's'").count() == docs.count()


def test_the_whole_pipeline(spark, folder):
    _, _, _, clean, bad = planted()
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & bad and ids <= clean | {None, 302}
    assert all(0 < r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.1 * mine[0]["target"]


def test_pipeline_on_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path / "none"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    write(spark, str(tmp_path / "odd"), [(1, None, None), (None, None, None), (2, "", "a"), (2, "", "a"), (3, "word " * 40_000, "b")], [], [])
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in rows} == {3} and rows[0]["size"] == 40_000
