import hashlib
import hmac
import json
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import naming
from tracewell.functions import text as tx
from tracewell.operators import corpus, hosts, integrity, knowledge, reports, screens, sessions, synth
from tracewell.schemas import AUDIT_EVENT
from tracewell.sources import audit_log, exports
from tracewell.streaming import live

KEY = b"k" * 70


def _sealed(spark):
    rows = [("cap%d" % (i % 2), i, 1000 + i, "bytes", "op", "s\u0001é\u001b" if i % 3 else "s2") for i in range(1, 13)]
    ev = spark.createDataFrame(rows, "capture string, seq_global bigint, ts_ms bigint, type string, actor string, session_id string")
    return ev, audit_log.seal(ev, "capture", KEY)


def test_sealed_chain_matches_python(spark):
    ev, sealed = _sealed(spark)
    by_capture = {}
    for r in ev.orderBy("capture", "seq_global").collect():
        by_capture.setdefault(r["capture"], []).append(r)
    want = {}
    for capture, events in by_capture.items():
        prev = ""
        for no, r in enumerate(events, start=1):
            body = {f: None for f in AUDIT_EVENT.fieldNames() if f not in ("hash", "hmac")}
            body |= {"v": "v2", "seq_global": no, "ts_ms": r["ts_ms"], "timestamp_ms": r["ts_ms"], "type": r["type"], "actor": r["actor"], "session_id": r["session_id"], "prev_hash": prev}
            data = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
            digest = hashlib.sha256(data).hexdigest()
            want[capture, no] = (prev, digest, hmac.new(KEY, data, hashlib.sha256).hexdigest())
            prev = digest
    got = {(r["capture"], r["seq_global"]): (r["prev_hash"], r["hash"], r["hmac"]) for r in sealed.collect()}
    assert got == want


def test_clean_log_passes_and_edits_fail(spark):
    _, sealed = _sealed(spark)
    log = sealed.withColumnRenamed("capture", "capture_id")
    assert integrity.broken_links(log).count() == 0
    assert integrity.sequence_breaks(log).count() == 0
    cut = log.where("NOT (capture_id = 'cap1' AND seq_global = 3)")
    assert [(r["violation"], r["seq_from"], r["seq_to"]) for r in integrity.sequence_breaks(cut).collect()] == [("gap", 3, 3)]
    assert [r["seq_global"] for r in integrity.broken_links(cut).collect()] == [4]


def test_log_files_lenient_strict_and_live(spark, tmp_path):
    good = {"v": "v2", "seq_global": 1, "ts_ms": 5, "type": "bytes", "session_id": "s1"}
    lines = [json.dumps(good), "", "{broken", "[1]", json.dumps(good | {"v": "v9", "seq_global": 2})]
    (tmp_path / "audit-1.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "other.txt").write_text("x\n")
    events = audit_log.read_events(spark, str(tmp_path))
    assert sorted(r["seq_global"] for r in events.collect()) == [1, 2]
    numbered = audit_log.read_lines(spark, str(tmp_path)).withColumn("line_no", F.monotonically_increasing_id() + 1)
    assert sorted(r["reason"] for r in audit_log.rejected_lines(numbered).collect()) == ["JSON not object", "invalid JSON", "unexpected v"]
    assert audit_log.file_digests(spark, str(tmp_path)).first()["file_sha256"] == hashlib.sha256((tmp_path / "audit-1.jsonl").read_bytes()).hexdigest()
    followed = live.run_available(live.follow_log(spark, str(tmp_path)).select("seq_global"), "t")
    assert sorted(r["seq_global"] for r in followed.collect() if r["seq_global"]) == [1, 2]


def _normal(raw):
    out = re.sub(r"\x1B.", "", re.sub(r"\x1B\[[0-9;?]*[A-Za-z]", "", raw)).replace("\r\n", "\n").replace("\r", "\n")
    kept, blanks = [], 0
    for line in out.split("\n"):
        line = line.rstrip()
        blanks = blanks + 1 if line == "" else 0
        if blanks <= 1:
            kept.append(line)
    return "\n".join(kept)


def test_normalised_screens(spark):
    texts = ["", "\n\n\n", "a\n\n\n\nb\n\n", "\n\na  \r\n\x1b[1mb\x1b[0m \t\r", "x", " \n \n", "a\n", "a\n\nb\nc\n\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_screen(F.col("t")).alias("n"))
    for r in df.collect():
        assert r["n"] == _normal(r["t"]), repr(r["t"])


def test_error_matches_against_a_plain_search(spark):
    texts = [
        "ok\nERRO FATAL no campo NOME; lock\nLOCK lock", "Valor  inválido, must be 3\n", "VALOR\n INVÁLIDO\nERROR [code 7] x ERROR [z]",
        "nada", "registro não encontrado não encontrada\nmust be greater than zero",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = sorted(
        (r["id"], r["rule_no"], r["match_no"], r["line_text"], r["description"], r["field_name"]) for r in screens.detect_errors(df).collect()
    )
    want = []
    for i, raw in enumerate(texts):
        clean = re.sub(" {2,}", " ", raw)
        for no, (shape, _, _, description) in enumerate(screens.ERROR_RULES):
            for k, m in enumerate(re.finditer(shape, clean, re.IGNORECASE)):
                start, end = clean.rfind("\n", 0, m.start()) + 1, clean.find("\n", m.end())
                line = clean[start : end if end >= 0 else len(clean)].strip()
                said = description.replace("\\1", m.group(1)) if "\\1" in description else description
                field = re.search(r"(?:campo|field|coluna|column)\s+['\"]?(\w+)", line, re.IGNORECASE)
                want.append((i, no, k, line[:200], said, field.group(1) if field else ""))
    assert got == sorted(want)


def test_characters_split_over_events(spark):
    import base64

    text = "aé€😀z" * 3
    data = text.encode()
    chunks = [data[i : i + 1] for i in range(len(data))]
    rows = [("s", "out", i, base64.b64encode(c).decode()) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "session_id string, dir string, seq_global bigint, data_b64 string")
    out = screens.decoded_output(df, F.lit("utf-8")).orderBy("seq_global").collect()
    assert "".join(r["text"] for r in out) == text


@pytest.mark.parametrize("limit", ["1000000", "5"])
def test_checkpoint_placement_against_a_plain_loop(spark, limit):
    import random

    rng = random.Random(5)
    rows, ts = [], 10_000
    for i in range(600):
        ts += rng.choice([1, 200, 1500, 4000])
        rows.append(("s", i, ts, rng.random() < 0.01, rng.random() < 0.01, rng.random() < 0.02))
    want, last = [], 0
    for no, (_, seq, at, reset, resize, clear) in enumerate(rows, start=1):
        why = "ris" if reset else "resize" if resize else "clear_screen" if clear else "session_start" if no == 1 else "interval_events" if no % 250 == 0 else "interval_time" if at - last >= 3000 else None
        if why:
            last = at
            want.append((seq, why))
    df = spark.createDataFrame(rows, "session_id string, seq_global bigint, ts_ms bigint, reset boolean, resize boolean, clear boolean")
    spark.conf.set("spark.tracewell.hotRows", limit)
    try:
        got = sorted((r["seq_global"], r["reason"]) for r in screens.place_checkpoints(df).collect())
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    assert got == want


@pytest.mark.parametrize(
    "values, hits", [([99], 0), ([99, 99], 0), ([99, 99, 99], 1), ([99, 50, 99, 99], 0), ([99, 99, None, 99], 0)]
)
def test_only_sustained_load_counts(spark, values, hits):
    rows = [("h", i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "host string, ts_ms bigint, cpu_pct double")
    assert hosts.sustained_runs(df, ["host"], ["ts_ms"], "cpu_pct", 90.0, 3).count() == hits


@pytest.mark.parametrize("chunk", [hosts.CHUNK, 8])
def test_window_statistics_against_a_plain_filter(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(hosts, "CHUNK", chunk)

    rng = random.Random(9)
    samples = [(rng.randint(0, 40_000_000), float(rng.randint(0, 99)) if rng.random() < 0.9 else None) for _ in range(3000)]
    windows = [(i, a, a + rng.choice([0, 10, 59_999, 60_000, 130_000, 4_000_000, 39_000_000])) for i, a in enumerate(rng.randint(0, 30_000_000) for _ in range(40))]
    df = spark.createDataFrame(samples, "ts_ms bigint, cpu double")
    w = spark.createDataFrame(windows, "run_id bigint, from_ms bigint, to_ms bigint")
    inside = {i: [v for t, v in samples if a <= t <= b] for i, a, b in windows}
    for r in hosts.window_statistics(df, w, ["cpu"]).collect():
        known = [v for v in inside[r["run_id"]] if v is not None]
        assert r["samples"] == len(inside[r["run_id"]])
        assert r["cpu_max"] == (max(known) if known else None)
        assert r["cpu_avg"] == (pytest.approx(sum(known) / len(known)) if known else None)
    pairs = hosts.samples_in_windows(df, w).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in pairs} == {i: len(v) for i, v in inside.items() if v}


def test_key_fields_find_their_entity(spark):
    names = ["CLIENTES", "PRODUTOS", "PEDIDOS", "grupo_itens"]
    fields = [("VENDAS", f, "") for f in ("CLIENTE_ID", "CODCLI", "ID_CLIENTE", "PRODUTO_ID", "PEDIDO_ID", "FORMA_PGTO", "cod_grupo")]
    found = knowledge.foreign_keys(
        spark.createDataFrame(fields, "entity string, field string, lookup string"), spark.createDataFrame([(n,) for n in names], "name string")
    )
    got = {r["field"]: r["target"] for r in found.collect()}
    assert got == {
        "CLIENTE_ID": "CLIENTES", "CODCLI": "CLIENTES", "ID_CLIENTE": "CLIENTES", "PRODUTO_ID": "PRODUTOS", "PEDIDO_ID": "PEDIDOS", "cod_grupo": "grupo_itens",
    }


def test_generated_rows_are_stable_unique_and_valid(spark):
    from tracewell.queries.synth import RULES, SCHEMA

    rows = spark.range(300).withColumnRenamed("id", "row")
    data = synth.build_dataset(rows, SCHEMA, seed=2, entity="e")
    again = synth.build_dataset(rows.repartition(7), SCHEMA, seed=2, entity="e")
    first = sorted(map(tuple, data.collect()))
    assert first == sorted(map(tuple, again.collect()))
    assert len({r[1] for r in first}) == 300
    assert synth.violations(data, "row", RULES).count() == 0
    assert synth.preflight(data, "row", RULES)


def test_generated_parents_come_first(spark):
    built = synth.generate_ordered(
        spark,
        {"pedido": [{"name": "cliente", "datatype": "integer"}, {"name": "valor", "datatype": "money"}], "cliente": [{"name": "id", "datatype": "integer", "min": 1, "max": 9000, "unique": True}]},
        {"pedido.cliente": ("cliente", "id")},
        {"cliente": 20, "pedido": 70},
    )
    assert built["pedido"].count() == 70
    assert synth.missing_parents(built["pedido"], "cliente", built["cliente"], "id").count() == 0


def test_replay_window_fails_without_its_checkpoint(spark):
    ev = spark.createDataFrame([("s", 1, "checkpoint", "a")], "session_id string, seq_global bigint, type string, sig string")
    assert sessions.replay_window(ev, from_sig="a").count() == 1
    with pytest.raises(Exception, match="not found"):
        sessions.replay_window(ev, from_sig="zz").collect()
    with pytest.raises(ValueError):
        sessions.replay_window(ev, seq_from=5, seq_to=2)


def test_line_trimming_stays_linear(spark):
    import time

    from pyspark.sql import functions as F

    from tracewell.functions import text as tx

    blanks = "a" + " " * 100_000 + "b" + " " * 100_000
    row = spark.createDataFrame([(blanks, " \n x \t\n ")], "long string, short string").cache()
    row.count()
    start = time.perf_counter()
    got = row.select(tx.normalize_whitespace(F.col("long")).alias("n"), tx.strip(F.col("long")).alias("s"), tx.strip(F.col("short")).alias("t")).first()
    assert time.perf_counter() - start < 5
    assert got["n"] == got["s"] == "a" + " " * 100_000 + "b" and got["t"] == "x"


def test_containing_against_every_pair(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(900, None), (901, ""), (902, "abca"), (902, "abca")]
    phrases = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(99, None)]
    left, right = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(phrases, "j int, phrase string")
    got = sorted((r["i"], r["j"]) for r in knowledge.containing(left, right, "text", "phrase").collect())
    assert got == sorted((i, j) for i, x in texts for j, y in phrases if x is not None and y and y in x)


def _field_of(kind, place, fields, meanings, bound, used):
    """The field of one input, given those that earlier inputs have taken."""
    if not fields or kind in knowledge.IDLE_TYPES:
        return None, "unmapped"
    if kind in knowledge.SPECIFIC_TYPES and kind in meanings:
        return fields[meanings.index(kind)], "by_semantic_type"
    written = kind in ("text", "text_long")
    text = [m in knowledge.WRITTEN_TYPES and f.upper() not in knowledge.TECHNICAL_FIELDS for f, m in zip(fields, meanings, strict=True)]
    if place < len(bound) and bound[place].upper() not in used:
        return bound[place], "by_matched_fields"
    if place < len(fields) and fields[place].upper() not in used and (text[place] if written else kind == meanings[place]):
        return fields[place], "by_screen_order"
    free = [f for f, ok in zip(fields, text, strict=True) if written and ok and f.upper() not in used]
    return (free[0], "by_field_name") if free else (None, "unmapped")


def test_inputs_take_fields_as_if_one_by_one(spark):
    import random

    rng = random.Random(20)
    names = ["CPF_CLIENTE", "nome", "NOME", "obs", "VALOR", "email", "dt_nasc", "STATUS", "telefone", "cidade", "x1", "descricao"]
    values = ["12345678901", "Ana Maria", "Rua das Flores", "12,50", "a@b.com", "2020-01-02", "F3", "s", "7", "{KEY:ENTER}", "w" * 40, "(11) 98888-1234", ""]
    rows = []
    for screen in range(60):
        fields = rng.sample(names, rng.randint(0, 8)) if screen else None
        bound = rng.sample(names, rng.randint(0, 4)) if screen != 1 else None
        rows += [(f"s{screen % 7}", screen, k, rng.choice(values), fields, bound) for k in range(rng.randint(1, 25))]
    rows += [("hot", 99, k, rng.choice(values), names, names[2:5]) for k in range(400)]
    schema = "session_id string, screen_no bigint, seq bigint, value string, fields array<string>, matched array<string>"
    df = spark.createDataFrame(rows, schema)
    meaning = {r["n"]: r["m"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", naming.field_meaning(F.col("n")).alias("m")).collect()}
    kinds = {r["v"]: (r["k"], r["c"]) for r in spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", naming.value_type(F.col("v")).alias("k"), naming.is_key_command(F.col("v")).alias("c")).collect()}
    want, used, place = {}, {}, {}
    for session, screen, seq, value, fields, bound in rows:
        key = (session, screen)
        kind, command = kinds[value]
        if command:
            want[session, screen, seq] = (None, "command")
            continue
        taken = used.setdefault(key, set())
        field, method = _field_of(kind, place.get(key, 0), fields or [], [meaning[f] for f in fields or []], bound or [], taken)
        taken |= {field.upper()} if field else set()
        place[key] = place.get(key, 0) + 1
        want[session, screen, seq] = (field, method)
    got = {(r["session_id"], r["screen_no"], r["seq"]): (r["field"], r["method"]) for r in knowledge.map_inputs(df).collect()}
    assert got == want
    assert knowledge.map_inputs(df.limit(0)).count() == 0


@pytest.mark.parametrize("form", ["csv", "jsonl"])
def test_exports_come_back_whole_and_appear_at_once(spark, tmp_path, form):
    texts = ["a,b", 'say "x"', "two\nlines", "", None, "é ü", "null", " "]
    rows = spark.createDataFrame([(k, texts[k % 8], k / 4 if k % 5 else None) for k in range(200)], "id bigint, text string, x double").repartition(5)
    path = str(tmp_path / "out")
    exports.export(rows, path, form)
    back = exports.exported(spark, path, rows.schema, form)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)

    def listed():
        held = json.loads((tmp_path / "out" / "manifest.json").read_text())
        for f in held["files"]:
            data = (tmp_path / "out" / f["file"]).read_bytes()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (f["bytes"], f["sha256"])
        visible = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")}
        assert visible == {f["file"] for f in held["files"]} | {"manifest.json"}
        return held["rows"], visible

    assert listed()[0] == 200
    broken = rows.withColumn("x", F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    before = listed()
    with pytest.raises(Exception, match="broken"):
        exports.export(broken, path, form)
    assert listed() == before
    exports.export(rows.limit(10), path, form)
    assert listed()[0] == 210
    exports.export(rows.limit(7), path, form, mode="overwrite")
    assert listed()[0] == exports.exported(spark, path, rows.schema, form).count() == 7
    exports.export(rows.limit(0), str(tmp_path / "none"), form)
    assert json.loads((tmp_path / "none" / "manifest.json").read_text())["files"] == []


def test_packed_exports_come_back_whole(spark, tmp_path):
    rows = spark.createDataFrame([(k, ["a,b", 'say "x"', "two\nlines", "", None][k % 5], k / 4) for k in range(3000)], "id bigint, text string, x double")
    for form in ("csv", "jsonl"):
        path = str(tmp_path / form)
        exports.export(rows.repartition(3), path, form, packed=True)
        assert sorted(map(tuple, exports.exported(spark, path, rows.schema, form).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
        held = json.loads((tmp_path / form / "manifest.json").read_text())
        files = {f["file"]: (tmp_path / form / f["file"]).read_bytes() for f in held["files"]}
        assert held["rows"] == 3000 and all((len(files[f["file"]]), hashlib.sha256(files[f["file"]]).hexdigest()) == (f["bytes"], f["sha256"]) for f in held["files"])
        exports.export(rows, str(tmp_path / f"{form}-plain"), form)
        assert sum(map(len, files.values())) * 2 < sum(p.stat().st_size for p in (tmp_path / f"{form}-plain").glob("part-*"))


def test_statuses_join_windows_before_samples(spark):
    """The samples in windows, the large side, are not joined with the runs again."""
    samples = spark.createDataFrame([(60000 * k, float(k)) for k in range(50)], "ts_ms bigint, cpu_pct double")
    windows = spark.createDataFrame([(1, 0, 600000), (2, 300000, 300000), (3, 0, 1)], "run_id int, from_ms bigint, to_ms bigint")
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (4, "ok")], "run_id int, status string")
    rows = exports.host_window_rows(samples, windows, runs)
    assert sorted((r["run_id"], r["status"], r["ts_ms"]) for r in rows.collect()) == [(1, "ok", 60000 * k) for k in range(11)] + [(2, "failed", 300000)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in next(line for line in plan.splitlines() if "Join" in line)


def test_programs_stand_for_entities(spark):
    programs = ["cadcli", "ALTPROD.prg", "pedido", "grupo_lista", "xyz", "", "codven", "fatura_nfe", "est_ven"]
    entities = ["CLIENTES", "PRODUTOS", "PEDIDOS", "grupo_itens", "VENDEDORES", "NOTAS", "estoque", "vendas"]
    got = knowledge.program_entities(
        spark.createDataFrame([(x,) for x in programs], "program string"), spark.createDataFrame([(x,) for x in entities], "entity string")
    )
    assert {r["program"]: r["entity"] for r in got.collect()} == {
        "cadcli": "CLIENTES", "ALTPROD.prg": "PRODUTOS", "pedido": "PEDIDOS", "grupo_lista": "grupo_itens", "codven": "vendas", "fatura_nfe": "NOTAS", "est_ven": "vendas",
    }


def test_similar_sets_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    words = ["id", "id", "id", "cod", "cod", "cliente", "pedido", "nota", "item", "grupo", "x1", "vlr"]
    sides = [{f"{side}{k}": sorted(set(rng.choices(words, k=rng.randint(1, 6)))) for k in range(80)} for side in "lr"]
    frames = [spark.createDataFrame(list(side.items()), "name string, tokens array<string>") for side in sides]
    for above in (0.3, 0.4, 0.75):
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sides[0].items() for b, y in sides[1].items()}
        got = {(r["left"], r["right"]): r["sim"] for r in knowledge.similar_sets(*frames, above).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v > above}


def test_screens_are_rebuilt_after_shrinking_moving_and_growing(spark):
    """Sizes change both ways, the cursor moves alone, and a forged signature is rejected."""
    flags = {f: False for f in screens.FLAGS}
    shown = {1: (2, 3, 0, 0, "abcdef"), 2: (1, 2, 0, 1, "ab"), 3: (1, 2, 0, 0, "ab"), 5: (2, 3, 1, 2, "abXdYf"), 9: (2, 2, 1, 2, "abdY")}
    turns = [("s", seq, r, c, cr, cc) for seq, (r, c, cr, cc, _) in shown.items()]
    cells = [
        {"session_id": "s", "seq": seq, "rows": r, "cols": c, "row": k // c, "col": k % c, "ch": ch, "fg": "default", "bg": "default", **flags}
        for seq, (r, c, _, _, text) in shown.items() for k, ch in enumerate(text)
    ]
    kinds = "session_id string, seq bigint, rows int, cols int, row int, col int, ch string, fg string, bg string, " + ", ".join(f"{f} boolean" for f in screens.FLAGS)
    all_cells = spark.createDataFrame(cells, kinds)
    all_turns = spark.createDataFrame(turns, "session_id string, seq bigint, rows int, cols int, cursor_row int, cursor_col int")
    changes = screens.screen_changes(all_turns, all_cells)
    seen = {(r["seq"], r["change"]): r["count"] for r in changes.groupBy("seq", "change").count().collect()}
    assert seen == {
        (2, "geometry"): 1, (2, "cursor"): 1, (2, "removed"): 4, (3, "cursor"): 1, (5, "geometry"): 1, (5, "cursor"): 1, (5, "added"): 4,
        (9, "geometry"): 1, (9, "removed"): 2,
    }
    first = all_turns.where("seq = 1"), all_cells.where("seq = 1")
    rebuilt = screens.rebuild_screens(*first, changes, all_turns)
    got = {}
    for r in rebuilt.collect():
        got.setdefault((r["seq"], r["rows"], r["cols"], r["cursor_row"], r["cursor_col"]), {})[r["row"], r["col"]] = r["ch"]
    assert got == {(seq, r, c, cr, cc): {(k // c, k % c): ch for k, ch in enumerate(text)} for seq, (r, c, cr, cc, text) in shown.items()}
    between = screens.rebuild_screens(*first, changes, spark.createDataFrame([("s", 4), ("s", 7), ("s", 0)], "session_id string, seq bigint"))
    assert {(r["seq"], r["rows"], r["cols"], r["n"]) for r in between.groupBy("seq", "rows", "cols").agg(F.count("ch").alias("n")).collect()} == {(4, 1, 2, 2), (7, 2, 3, 6)}
    recorded = screens.screen_signatures(all_cells, ["session_id", "seq"])
    forged = recorded.withColumn("visual_sig", F.when(F.col("seq") == 5, "sha256:x").otherwise(F.col("visual_sig")))
    forged = forged.unionByName(forged.where("seq = 9").withColumn("seq", F.lit(11).cast("bigint")))
    assert {r["seq"]: r["rejected"] for r in screens.verify_screens(rebuilt, forged).collect()} == {1: None, 2: None, 3: None, 5: "visual", 9: None, 11: "missing"}


def test_branches_of_blocks(spark):
    text = [
        "IF a > 1", " DO m/one", "else", " do two", "ELSE", " DO three", "ENDIF", "DO out",  # 1-8
        "DO CASE", "DO early", "CASE x", "DO four", "CASE y", "ENDCASE",  # 9-14
        "DO WHILE .T.", "DO five", "IF b", "DO six", "ENDDO",  # 15-19, the IF is never closed
        "FOR i = 1 TO 3", "DO lost",
    ]
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text, 1)], "file string, line_no bigint, line string")
    found = lambda kind: sorted((r["start_line"], r["end_line"], r["branch"], r["screen"]) for r in corpus.flow_calls(lines, kind).collect())
    assert found("if") == [(1, 7, 0, "M_ONE"), (1, 7, 1, "THREE"), (1, 7, 1, "TWO")]
    assert found("do_case") == [(9, 14, 0, "EARLY"), (9, 14, 1, "FOUR")]
    assert found("loop") == [(15, 19, 0, "FIVE"), (15, 19, 0, "SIX")]


def _script_tables(spark):
    sessions = spark.createDataFrame([(j, s) for j in (0, 1) for s in range(j, 12, 2)], "journey_id long, session_no long")
    templates = ["fixed", "{{c.nome}} {{uf}}", None, "{{nada}}"]
    steps = [(j, k, templates[(j + k) % 4]) for j in (0, 1, 2) for k in range(9)] + [(0, 3, templates[3]), (None, 1, "fixed")]
    data = [(j, r, {"C.NOME": f"n{j}{r}", "UF": f"u{r}"}) for j in (0, 1) for r in range(2)]
    return (
        sessions,
        spark.createDataFrame(steps, "journey_id long, step_order long, input_template string"),
        spark.createDataFrame(data, "journey_id long, row long, values map<string,string>"),
    )


def _script_rows(sessions, steps, data):
    values = {(r["journey_id"], r["row"]): r["values"] for r in data.collect()}
    out = []
    for s in sessions.collect():
        of = values[s["journey_id"], s["session_no"] % 2]
        for p in steps.collect():
            if p["journey_id"] == s["journey_id"]:
                made = {"fixed": "fixed", None: None, "{{nada}}": "{{nada}}"}.get(p["input_template"], f"{of['C.NOME']} {of['UF']}")
                out.append((s["journey_id"], s["session_no"], p["step_order"], p["input_template"], made))
    return out


def test_scripts_spread_over_tasks_whatever_the_journeys(spark, monkeypatch):
    tables = _script_tables(spark)
    monkeypatch.setattr(synth, "STEPS_TOGETHER", 2)
    got = synth.session_scripts(*tables)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_script_rows(*tables), key=str)
    # two journeys are no two tasks
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_input_changes_need_no_row_per_step(spark):
    tables = _script_tables(spark)
    counted = synth.session_scripts(*tables, counted=True)
    assert counted.count() == 12 * 4
    want = sorted(map(tuple, synth.input_changes(synth.session_scripts(*tables)).collect()))
    assert sorted(map(tuple, synth.input_changes(counted).collect())) == want
    rows = _script_rows(*tables)
    assert [r[2:5] for r in want] == [
        (len(mine), sum(v is not None and v != t for *_, t, v in mine), sum(v is not None and v == t for *_, t, v in mine))
        for mine in ([r for r in rows if r[:2] == key] for key in sorted({r[:2] for r in rows}))
    ]


def test_containing_compares_few_phrases_of_one_start(spark, monkeypatch):
    """Phrases that begin alike are sought by their rarest pieces."""
    texts = spark.createDataFrame([(i, f"a young one, OUNG{i} too") for i in range(20)], "i int, text string")
    phrases = spark.createDataFrame([(j, f"OUNG{j}") for j in range(100, 400)] + [(7, "OUNG7")], "j int, phrase string")
    got = [(r["i"], r["j"]) for r in knowledge.containing(texts, phrases, "text", "phrase").collect()]
    assert got == [(7, 7)]
    monkeypatch.setattr(knowledge.F, "contains", lambda text, phrase: F.lit(True))
    assert knowledge.containing(texts, phrases, "text", "phrase").count() <= 40


def test_pieces_of_a_text_are_cut_once(spark, capsys):
    """No filter on the number of pieces, which would cut every text again ahead of an exchange."""
    texts = spark.createDataFrame([(1, "one text")], "i int, text string").repartition("i")
    found = []
    keep = knowledge.settle
    try:
        knowledge.settle = lambda df: (found.append(df), keep(df))[1]
        assert knowledge.containing(texts, spark.createDataFrame([("text",)], "phrase string"), "text", "phrase").count() == 1
    finally:
        knowledge.settle = keep
    plan = found[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") <= 1 and "size(" not in plan


def test_step_dependencies_move_only_steps_of_several_screens(spark):
    steps = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "A"), (2, 1, None), (None, 1, "b"), (2, 2, "z"), (2, 3, "")], "journey_id long, step_order long, screen_id string")
    hints = spark.createDataFrame([("A", "X", ""), ("A", "Y", "B"), ("B", "Y", "A"), ("A", "X", ""), ("", "W", "B")], "source_screen string, source_field string, target_screen string")
    found = knowledge.step_dependencies(steps, hints)
    a, b = {"A.X", "A.Y", "B.Y"}, {"A.Y", "B.Y", ".W"}
    want = [(1, 1, d) for d in a | b] + [(1, 2, d) for d in a] + [(None, 1, d) for d in b]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    top = found._jdf.queryExecution().optimizedPlan()
    # the rows of steps with one screen pass no aggregation after the join
    assert top.children().apply(0).nodeName() != "Aggregate" and top.nodeName() == "Union"


def test_error_rules_have_literals_that_stand_in_every_match(spark):
    """Texts without them are not searched with all patterns."""
    for shape, *_ in screens.ERROR_RULES:
        found = screens._literals(shape)
        assert found and all(x and x == x.lower() for x in found), shape
    assert screens._literals(r"(?:a|b)?x") == [] and screens._literals("a?b|c") == [] and screens._literals(r"ab\s+(.+)") == ["ab"]
    said = ["ERROR  [12] x", "tem de: deve ser  1", "Valor Inválido", "picture a ERROR", "nao  existe", "NÃO EXISTE", "violaçao", "chave   duplicada", "ok", None, "invaLIDo", "já existe", "ſubscript out of range"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    got = {(r["i"], r["rule_no"]) for r in screens.detect_errors(rows).collect()}
    want = {(i, no) for i, x in enumerate(said) if x for no, (shape, *_) in enumerate(screens.ERROR_RULES) if re.search("(?i)" + shape, re.sub(" {2,}", " ", x))}
    assert got == want
    plan = screens.detect_errors(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") + plan.count("contains(") + plan.count("Contains") >= 40 and "size(regexp_extract_all" not in plan


def test_catalog_differences_need_one_shuffle(spark):
    rows = lambda *x: spark.createDataFrame(x, "module long, name string")
    found = corpus.catalog_differences(rows((1, "a"), (1, "b"), (1, "b"), (2, None)), rows((1, "b"), (3, "c"), (2, None)), ["module", "name"])
    want = [("added", 2, None), ("added", 3, "c"), ("removed", 1, "a"), ("removed", 2, None)]
    assert sorted(((r["change"], r["module"], r["name"]) for r in found.collect()), key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan


def test_failure_breakdown_moves_no_expanded_rows(spark):
    rows = [(1, "t", "low", "f", "s", 1), (1, "t", "high", " ", "s", 2), (1, "t", "high", " ", "s", 5), (2, None, "low", "f", "", 3)]
    failures = spark.createDataFrame(rows, "run_id long, failure_type string, severity string, flow_name string, session_id string, seq_global long")
    out = reports.failure_breakdown(failures)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {(r["run_id"], r["dimension"], r["failure_type"], r["severity"], r["flow_name"], r["session_id"]): (r["failures"], r["last_seq_global"]) for r in out.collect()}
    assert len(got) == out.count() == 15
    assert got[1, "total", None, None, None, None] == (3, 5) and got[1, "flow_severity", None, "high", "sem_fluxo", None] == (2, 5)
    assert got[2, "type", None, None, None, None] == (1, 3) and got[2, "session", None, None, None, "sem_sessao"] == (1, 3)
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 2


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_operations_look_back_without_copying_rows(spark):
    """Three operations on the same table count, others between do not; lower case and empty lines as well."""
    text = ["use t1", "append blank", "seek k", "SEEK k", "replace a with 1", "replace b with 2", "use t2", "REPLACE c WITH 3", None, "", "if DELETE", "dbseek(x", "* note"]
    lines = spark.createDataFrame([("f", k, line) for k, line in enumerate(text)], "file string, line_no int, line string")
    rows = corpus.file_operations(lines)
    got = {r["line_no"]: (r["entity"], r["operation"], r["fields"]) for r in rows.collect()}
    assert got == {
        0: ("T1", "use", []), 1: ("T1", "append", []), 2: ("T1", "seek", ["k"]), 3: ("T1", "seek", ["k"]), 4: ("T1", "insert", ["a"]),
        5: ("T1", "update", ["b"]), 6: ("T2", "use", []), 7: ("T2", "update", ["c"]), 10: ("T2", "delete", []), 11: ("T2", "dbseek", []),
    }
    assert "Generate" not in _plan(rows)


def test_calls_are_followed_without_broadcasts(spark, monkeypatch):
    plans, settle = [], corpus.settle
    monkeypatch.setattr(corpus, "settle", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or settle(rows))
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(20, 5)], "src int, dst int")
    ways = corpus.reached(edges, spark.createDataFrame([(0,), (20,), (99,)], "node int"))
    assert sorted(map(tuple, ways.collect())) == sorted([(0, k) for k in range(1, 21)] + [(20, k) for k in range(5, 21)])
    assert len(plans) < 2 * 20 and not any("BroadcastHashJoin" in p for p in plans)


def test_screens_with_the_same_fields_are_scored_once(spark):
    shown = [(k, f) for k in range(6) for f in ("CODCLI", "NOME_CLI", "obs")] + [(6, "QTD"), (7, None), (None, "QTD")]
    titles = {0: ("Cadastro de clientes", "x"), 1: (None, "x"), 2: ("Consulta pedidos", ""), 3: ("", "cadcli"), 4: ("clientes", "cadcli"), 5: ("pedidos clientes", None), 6: ("", ""), 7: ("Menu", "")}
    screens_ = spark.createDataFrame([(k, *v) for k, v in titles.items()] + [(0, *titles[0])], "screen_id int, title string, program string")
    fields = spark.createDataFrame([("CLIENTES", "CODCLI"), ("CLIENTES", "nome_cli"), ("PEDIDOS", "OBS"), ("PEDIDOS", "qtd")], "entity string, field string")
    entities = spark.createDataFrame([("CLIENTES", "isam"), ("PEDIDOS", None)], "entity string, storage_type string")
    rows = knowledge.link_screens(screens_, spark.createDataFrame(shown, "screen_id int, field string"), fields, entities)
    got = sorted((r["screen_id"], r["entity"], r["matched"], r["fields"]) for r in rows.collect())
    assert got == [(0, "CLIENTES", 2, 3), (0, "CLIENTES", 2, 3), *[(k, "CLIENTES", 2, 3) for k in range(1, 6)], (6, "PEDIDOS", 1, 1), (7, "", 0, 1)]
    assert not re.search(r"Aggregate \[screen_id#\d+, entity#", _plan(rows))


def test_failures_are_dealt_by_runs_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(reports, "ROWS_PER_TASK", 10)
    failures = spark.createDataFrame([(k % 20, f"flow{k % 3}") for k in range(200)], "run_id int, flow_name string")
    baselines = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "run_id int, baseline_run_id int")
    rows = reports.compare_flows(failures, baselines)
    assert {r["run_id"] for r in rows.collect()} == set(range(1, 20))
    assert rows.agg(F.sum("current_count"), F.sum("baseline_count")).first()[:] == (190, 190)
    assert "RepartitionByExpression [run_id" in _plan(rows) and ", 20" in _plan(rows)


def test_frames_of_screens_need_no_cells(spark):
    """Geometry and cursor are followed without comparing cells, and come out with the verdicts in one pass."""
    flags = ", ".join(f"false AS {f}" for f in screens.FLAGS)
    cells = spark.sql(f"SELECT 's' AS session_id, id DIV 6 + 1 AS seq, 2 AS rows, 3 AS cols, CAST(id % 6 DIV 3 AS INT) AS row, CAST(id % 3 AS INT) AS col, CAST(id % 4 AS STRING) AS ch, 'default' AS fg, 'default' AS bg, {flags} FROM range(18)")
    turns = spark.sql("SELECT 's' AS session_id, id AS seq, 2 AS rows, 3 AS cols, 0 AS cursor_row, CAST(id DIV 2 AS INT) AS cursor_col FROM range(1, 4)")
    changes = screens.screen_changes(turns, cells)
    frames = screens._frames(turns.where("seq = 1"), changes, turns)
    assert sorted(map(tuple, frames.collect())) == [("s", 1, 2, 3, 0, 0), ("s", 2, 2, 3, 0, 1), ("s", 3, 2, 3, 0, 1)]
    assert "FullOuter" in _plan(changes) and "FullOuter" not in _plan(frames)
    recorded = screens.screen_signatures(cells, ["session_id", "seq"])
    recorded = recorded.unionByName(recorded.where("seq = 3").withColumn("seq", F.lit(9).cast("bigint")))
    rebuilt = screens.rebuild_screens(turns.where("seq = 1"), cells.where("seq = 1"), changes, turns)
    got = screens.verify_screens(rebuilt, recorded, ("rows", "cursor_row", "cursor_col")).drop("session_id", "verified")
    assert sorted(map(tuple, got.collect())) == [(1, None, 2, 0, 0), (2, None, 2, 0, 1), (3, None, 2, 0, 1), (9, "missing", None, None, None)]


def _cells_joined(turns, cells):
    """Changes of cells as a join of all cells, one by one."""
    order = turns.withColumn("base_seq", F.lag("seq").over(Window.partitionBy("session_id").orderBy("seq"))).where("base_seq IS NOT NULL")
    order, look = order.select("session_id", "base_seq", "seq"), F.struct("ch", "fg", "bg", *screens.FLAGS)
    now = cells.select("session_id", "seq", "row", "col", look.alias("cell")).join(order, ["session_id", "seq"])
    old = cells.select("session_id", F.col("seq").alias("base_seq"), "row", "col", look.alias("old")).join(order, ["session_id", "base_seq"])
    both = now.join(old, ["session_id", "base_seq", "seq", "row", "col"], "full").where(~F.col("cell").eqNullSafe(F.col("old")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("cell").isNull(), "removed").otherwise("changed")
    return both.select("session_id", "base_seq", "seq", kind.alias("change"), "row", "col", "cell")


def test_changes_of_cells_join_whole_screens(spark):
    """Repeated screens and cells, null places, looks and keys, screens without cells: as in a join of cells, which is none."""
    draw = random.Random(14)
    chars = ["a", "b", "ç", "┌", "ab", "", None, " "]
    rows = []
    for session in ("s", "t", None):
        for seq in (1, 2, 2, 4, 4, 4, 7, None):
            for place in range(12):
                flags = {f: draw.choice([True, False, False, None]) if f == "bold" else False for f in screens.FLAGS}
                spot = {"row": draw.choice([place // 4, place // 4, place // 4, None]), "col": place % 4}
                rows.append({"session_id": session, "seq": seq, **spot, "ch": draw.choice(chars), "fg": draw.choice(["red", "default", None]), "bg": "default", **flags})
    draw.shuffle(rows)
    rows = sorted(rows[:-40], key=lambda r: (str(r["session_id"]), r["col"] % 2)) + rows[-40:] * 2
    kinds = "session_id string, seq bigint, row int, col int, ch string, fg string, bg string, " + ", ".join(f"{f} boolean" for f in screens.FLAGS)
    cells = spark.createDataFrame(rows, kinds).repartition(3)
    shown = [(s, seq, 3, 4, 0, 0) for s in ("s", "t", "u", None) for seq in (0, 1, 2, 2, 4, 4, 4, 6, 7, 9, None)]
    turns = spark.createDataFrame(shown, "session_id string, seq bigint, rows int, cols int, cursor_row int, cursor_col int")
    got = screens.screen_changes(turns, cells)
    want = _cells_joined(turns, cells)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())) != []
    join = next(line for line in _plan(got).split("\n") if "FullOuter" in line)
    assert "base_seq" in join and "row#" not in join


def test_screens_are_compared_in_parts(spark, monkeypatch):
    kinds = "session_id string, seq bigint, row int, col int, ch string, fg string, bg string, " + ", ".join(f"{f} boolean" for f in screens.FLAGS)
    rows = [("s", seq, k // 3, k % 3, chr(97 + (k * seq) % 5), "default", "default", *[False] * 6) for seq in range(1, 9) for k in range(seq % 4 * 3)]
    packed = pa.Table.from_batches(screens._pack(spark.createDataFrame(rows, kinds).toArrow().combine_chunks().to_batches())).to_pylist()
    parts = ("row", "col", "text", "bytes", "style", "styles")
    piece = {p["seq"]: [{k: p[k] for k in parts}] for p in packed}
    steps = [{"session_id": "s", "base_seq": seq - 1, "seq": seq, "times": 1, "now": piece.get(seq), "old": piece.get(seq - 1)} for seq in range(2, 9)]
    batch = pa.RecordBatch.from_pylist(steps, pa.Table.from_pylist(steps).schema)
    found = []
    for most in (300_000, 4):
        monkeypatch.setattr(screens, "CELLS_AT_ONCE", most)
        assert len(list(screens._some_screens(batch))) == (1 if most > 4 else 7)
        found.append(sorted(map(repr, pa.Table.from_batches(screens._compare(iter([batch]))).to_pylist())))
    assert found[0] == found[1] and len(found[0]) == sum(
        {k: (k * seq) % 5 for k in range(seq % 4 * 3)}.get(k) != {k: (k * (seq - 1)) % 5 for k in range((seq - 1) % 4 * 3)}.get(k) for seq in range(2, 9) for k in range(9)
    )


def _some_cells(spark, seed, seqs, sessions=("s", "t")):
    """Screens of changing sizes, some of them and some cells twice, with odd characters and looks."""
    draw, rows, turns = random.Random(seed), [], []
    for session in sessions:
        for seq in seqs:
            high, wide = draw.choice([(1, 3), (2, 3), (3, 2)])
            turns.append((session, seq, high, wide, 0, draw.randrange(2)))
            for k in range(high * wide):
                flags = {f: draw.choice([True, False, None]) if f == "bold" else False for f in screens.FLAGS}
                cell = {"session_id": session, "seq": seq, "rows": high, "cols": wide, "row": k // wide, "col": k % wide, "ch": draw.choice(["a", "ç", "┌", "ab", "", None, " "]), "fg": draw.choice(["red", None]), "bg": "default", **flags}
                rows += [cell] * draw.choice([1, 1, 1, 2])
    kinds = "session_id string, seq bigint, rows int, cols int, row int, col int, ch string, fg string, bg string, " + ", ".join(f"{f} boolean" for f in screens.FLAGS)
    draw.shuffle(rows)
    return spark.createDataFrame(turns, "session_id string, seq bigint, rows int, cols int, cursor_row int, cursor_col int"), spark.createDataFrame(rows, kinds)


def test_signatures_against_a_plain_loop(spark):
    turns, cells = _some_cells(spark, 5, range(4))
    code = lambda ch: None if ch is None else "32" if ch == "" else str(ord(ch[0]))
    full = lambda *parts: tuple((x is not None, x) for x in parts)
    want, screen = {}, {}
    for c in cells.collect():
        bits = sum(1 << k for k, f in enumerate(screens.FLAGS) if c[f])
        look = "|".join(x for x in (code(c["ch"]), c["fg"], c["bg"], str(bits)) if x is not None)
        plain = "#" if c["ch"] == "┌" else c["ch"]
        screen.setdefault((c["session_id"], c["seq"], c["rows"], c["cols"]), []).append((c["row"] * c["cols"] + c["col"], code(c["ch"]), look, c["row"], plain))
    for (session, seq, high, wide), held in screen.items():
        held.sort(key=lambda x: full(*x))
        sign = lambda *parts: "sha256:" + hashlib.sha256("\n".join([*parts, ""]).encode()).hexdigest()
        head = ["1", str(high), str(wide), "utf-8", "xterm"]
        body = "\n".join("".join(x[4] or "" for x in held[r * wide : (r + 1) * wide]).rstrip() for r in range(high))
        body = re.sub(r"\A(?:\s*\n)+|(?:\n\s*)+\Z", "", body)
        semantic = "sha256:" + hashlib.sha256((body if body.strip() else "").encode()).hexdigest()
        want[session, seq] = sign("SCREEN-TEXT", *head, "\n".join(x[1] for x in held if x[1] is not None)), sign("SCREEN-VISUAL", *head, "\n".join(x[2] for x in held)), semantic
    for given in (cells, screens.pack_screens(cells, ["session_id", "seq"])):
        got = screens.screen_signatures(given, ["session_id", "seq"])
        assert {(r["session_id"], r["seq"]): r[2:] for r in got.collect()} == want
        assert "transform(c#" not in _plan(got)  # no expression that runs through the cells


@pytest.mark.parametrize("limit", [None, 5])
def test_patches_are_replayed_in_order(spark, monkeypatch, limit):
    """Rebuilt cells are those of the last patch that names their place, also where a session is cut into ranges."""
    turns, cells = _some_cells(spark, 6, range(1, 24))
    first, first_cells = turns.where("seq = 1"), cells.where("seq = 1")
    changes = screens.screen_changes(turns, cells)
    states, last = {}, {}
    look = ("ch", *screens.STYLE)
    for c in first_cells.collect():
        states.setdefault((c["session_id"], c["row"], c["col"], c["seq"]), []).append(tuple(c[x] for x in look))
    for c in changes.where("change IN ('added', 'changed', 'removed')").collect():
        states.setdefault((c["session_id"], c["row"], c["col"], c["seq"]), []).append(c["cell"] and tuple(c["cell"][x] for x in look))
    want = []
    for session in ("s", "t"):
        for target in range(1, 24):
            last = {}
            for (s, row, col, seq), held in sorted(states.items(), key=lambda kv: kv[0][3]):
                if s == session and seq <= target:
                    last[row, col] = held
            want += [(session, target, row, col, *cell) for (row, col), held in last.items() for cell in held if cell]
    if limit:
        spark.conf.set("spark.tracewell.hotRows", str(limit))
    monkeypatch.setattr(screens, "CELLS_AT_ONCE", 7)
    pieces = screens.pack_screens(cells, ["session_id", "seq"])
    try:
        whole = screens.rebuild_screens(first, first_cells, changes, turns)
        packed = screens.rebuild_screens(first, pieces.where("seq = 1"), screens.screen_changes(turns, pieces, packed=True), turns, packed=True)
    finally:
        spark.conf.unset("spark.tracewell.hotRows")
    got = [(r["session_id"], r["seq"], r["row"], r["col"], *[r[x] for x in look]) for r in whole.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) != []
    frame = ("rows", "cursor_row", "cursor_col")
    recorded = screens.screen_signatures(whole, ["session_id", "seq"])
    assert {r["rejected"] for r in screens.verify_screens(packed, recorded, frame).collect()} == {None}
    assert not [line for line in _plan(whole).split("\n") if ("Join" in line or "Window" in line) and "row#" in line]


class _Held:
    """State of one key of a stream, with the calls made for it."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, _Kept(self))

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class _Kept:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _set(self, value):
        self.handle.calls += 1
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        self.handle.calls += 1
        return self.value

    update = put = _set

    def clear(self):
        self._set(None)

    def appendValue(self, value):  # noqa: N802
        self._set([*(self.value or []), value])


def _follow(processor, key, deliveries, delay):
    """What comes out of a key, and the calls of its state: rows first, then timers, by the watermark of the delivery before."""
    held, wm, out = _Held(), 0, []
    timer_values = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: wm})()
    processor.init(held)
    for rows in [*deliveries, None]:
        if rows is not None:
            half = len(rows) // 2
            out += processor.handleInputRows(key, iter([rows[:half], rows[half:]]), timer_values)
        for at in sorted(t for t in held.timers if t <= wm):
            if at in held.timers:
                held.timers.remove(at)
                out += processor.handleExpiredTimer(key, timer_values, None)
        wm = wm if rows is None else max(wm, int(rows["ts_ms"].max()) - delay)
    return [tuple(r) for frame in out for r in frame.itertuples(index=False, name=None)], held.calls


def test_sessions_of_a_group_share_their_state():
    """Runs as of a plain loop, in few calls of the state however many sessions and runs there are."""
    draw, stale, late = random.Random(3), 1000, 400
    events = [(draw.choice(["a", "b", "c", "d", None]), draw.randrange(40_000), draw.choice(["bytes", "bytes", "session_end"])) for _ in range(300)]
    arriving = sorted(events, key=lambda e: e[1] + draw.randrange(late))
    deliveries = [pd.DataFrame(arriving[k : k + 75], columns=["session_id", "ts_ms", "type"]) for k in range(0, 300, 75)]
    got, calls = _follow(live._Sessions(stale), (1,), deliveries, late)
    last = {}
    for session, start, *state, version in got:
        assert version > last.get((session, start), (0,))[-1]
        last[session, start] = (*state, version)
    want = {}
    for session in "abcd":
        runs = []
        for ts, kind in sorted((ts, kind) for s, ts, kind in events if s == session):
            if not runs or ts - runs[-1][1] >= stale:
                runs.append([ts, ts, 0, False])
            runs[-1][1:] = [ts, runs[-1][2] + 1, runs[-1][3] or kind == "session_end"]
        want |= {(session, r[0]): (r[1], r[2], r[3]) for r in runs}
    found = {k: v for k, v in last.items() if v[2] != "merged"}
    assert {k: (v[0], v[1], v[2] == "closed") for k, v in found.items()} == want
    final = max(ts for _, ts, _ in arriving[:225]) - late
    assert all((v[2] == "interrupted") == (v[0] + stale <= max(e[1] for e in arriving) - late) for v in found.values() if v[2] != "closed") and final > 0
    assert calls < 50


def test_rows_wait_in_batches():
    """Alarms of a chain, whose rows wait packed and not one by one, as of a plain loop."""
    draw = random.Random(4)
    rows, last = [], ""
    for no in range(1, 401):
        if no % 29 == 0:
            continue
        rows.append((no * 10, no, f"h{no}", draw.choice([last] * 9 + ["bad", None])))
        last = f"h{no}"
    want, seq, before = [], 0, ""
    for _, no, digest, prev in rows:
        want += [("c", no, "gap", str(seq + 1), str(no))] * (no != seq + 1) + [("c", no, "link", before, prev)] * (prev != before)
        seq, before = no, digest
    rows.sort(key=lambda r: r[0] + draw.randrange(300))
    kinds = ["ts_ms", "seq_global", "hash", "prev_hash"]
    end = pd.DataFrame([(10**9, 10**6, "end", "end")], columns=kinds)
    got, calls = _follow(live._Chain(), ("c",), [*(pd.DataFrame(rows[k : k + 100], columns=kinds) for k in range(0, len(rows), 100)), end], 300)
    assert got == want
    assert calls < 60
