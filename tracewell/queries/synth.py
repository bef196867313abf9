"""Queries over generated data and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import synth
from tracewell.plans import ordered
from tracewell.queries import tables as t
from tracewell.queries.registry import query


def _rows(spark, sf):
    return t.read(spark, sf, "customer").select(F.col("c_custkey").alias("row"))


def _generated(spark, sf, *names):
    known = synth.generators()
    return _rows(spark, sf).select("row", *[known.get(n)(7, n, F.col("row")).alias(n) for n in names])


@query("gen01_names_and_texts")
def names_and_texts(spark, sf):
    return _generated(spark, sf, "person_name", "company_name", "address", "text", "choice")


@query("gen02_generated_documents")
def generated_documents(spark, sf):
    return _generated(spark, sf, "cpf", "cnpj", "rg", "cep", "phone", "code")


def _digit_sql(number: str, weights) -> str:
    total = " + ".join(f"CAST(substr({number}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, start=1))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


@query(
    "gen02_check_digits",
    "WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS p, lpad(CAST(c_custkey * 104729 % 100000000 AS VARCHAR), 8, '0') || '0001' AS q FROM customer), "
    f"b AS (SELECT *, p || {_digit_sql('p', range(10, 1, -1))} AS p1, q || {_digit_sql('q', synth.CNPJ_WEIGHTS)} AS q1 FROM a), "
    f"c AS (SELECT *, p1 || {_digit_sql('p1', range(11, 1, -1))} AS p2, q1 || {_digit_sql('q1', (6, *synth.CNPJ_WEIGHTS))} AS q2 FROM b) "
    "SELECT c_custkey, substr(p2, 1, 3) || '.' || substr(p2, 4, 3) || '.' || substr(p2, 7, 3) || '-' || substr(p2, 10) AS cpf, "
    "substr(q2, 1, 2) || '.' || substr(q2, 3, 3) || '.' || substr(q2, 6, 3) || '/' || substr(q2, 9, 4) || '-' || substr(q2, 13) AS cnpj FROM c",
)
def check_digits(spark, sf):
    key = F.col("c_custkey")
    person = F.lpad((key * 7919 % 1000000000).cast("string"), 9, "0")
    company = F.concat(F.lpad((key * 104729 % 100000000).cast("string"), 8, "0"), F.lit("0001"))
    return t.read(spark, sf, "customer").select("c_custkey", synth.cpf(person).alias("cpf"), synth.cnpj(company).alias("cnpj"))


@query("gen03_numbers_and_dates")
def numbers_and_dates(spark, sf):
    return _generated(spark, sf, "number", "decimal", "money", "boolean", "uuid", "sequence", "date", "datetime", "email")


SCHEMA = [
    {"name": "codigo", "datatype": "integer", "min": 1, "max": 2000, "unique": True},
    {"name": "nome", "datatype": "person_name"},
    {"name": "cpf", "datatype": "text", "format": "cpf", "unique": True},
    {"name": "uf", "datatype": "text", "choices": ["SP", "RS", "CE"]},
    {"name": "limite", "datatype": "decimal", "min": 10.0, "max": 99.0},
    {"name": "obs", "datatype": "text", "min_length": 10, "max_length": 40},
]
RULES = [
    {"field": "nome", "required": True, "min_length": 3},
    {"field": "uf", "choices": ["SP", "RS", "CE"]},
    {"field": "limite", "min": 10.0, "max": 99.0},
    {"field": "obs", "max_length": 40},
]


@query("gen04_schema_dataset")
def schema_dataset(spark, sf):
    return synth.build_dataset(_rows(spark, sf), SCHEMA, seed=11, entity="cliente")


@query("gen04_uniqueness", "SELECT count(*) AS n, count(*) AS codes, count(*) AS documents, 0::BIGINT AS violations FROM customer")
def uniqueness(spark, sf):
    data = synth.build_dataset(_rows(spark, sf), SCHEMA, seed=11, entity="cliente")
    broken = synth.violations(data, "row", RULES).agg(F.count(F.lit(1)))
    return data.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("codigo").alias("codes"), F.count_distinct("cpf").alias("documents")
    ).withColumn("violations", broken.scalar())


@query(
    "gen05_ordered_datasets",
    "SELECT (SELECT count(*) FROM orders) AS children, 0::BIGINT AS orphans, least((SELECT count(*) FROM orders), (SELECT count(*) FROM customer)) AS covered_parents",
)
def ordered_datasets(spark, sf):
    """Orders get keys of generated customers; every key exists and the first rows cover all parents."""
    parents = synth.build_dataset(_rows(spark, sf), [{"name": "documento", "format": "cpf", "unique": True}], seed=3, entity="cliente")
    children = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("row"))
    keyed = synth.assign_parents(children, parents.select(F.col("row").alias("cliente_id")), "row", "cliente_id", "cliente_fk", seed=3)
    orphans = synth.missing_parents(keyed, "cliente_fk", parents.select(F.col("row").alias("cliente_id")), "cliente_id")
    return keyed.agg(F.count(F.lit(1)).alias("children"), F.count_distinct("cliente_fk").alias("covered_parents")).withColumn(
        "orphans", orphans.agg(F.count(F.lit(1))).scalar()
    )


@query(
    "jn15_parent_keys",
    """SELECT o_orderkey, CASE WHEN o_orderkey < (SELECT count(*) FROM customer) THEN o_orderkey END AS own_slot FROM orders""",
)
def parent_keys(spark, sf):
    parents = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    children = t.read(spark, sf, "orders").select("o_orderkey")
    total = parents.agg(F.count(F.lit(1))).scalar()
    keyed = synth.assign_parents(children, parents, "o_orderkey", "k", "parent", seed=1)
    return keyed.select("o_orderkey", F.when(F.col("o_orderkey") < total, F.col("parent")).alias("own_slot"))


@query(
    "gen06_constraint_violations",
    """SELECT c_custkey, 'c_name' AS field, 'min_length' AS rule, substr(c_name, 10, c_custkey % 12) AS value FROM customer WHERE length(substr(c_name, 10, c_custkey % 12)) < 4 AND c_custkey % 12 > 0
       UNION ALL SELECT c_custkey, 'c_name', 'required', substr(c_name, 10, c_custkey % 12) FROM customer WHERE c_custkey % 12 = 0
       UNION ALL SELECT c_custkey, 'c_mktsegment', 'choices', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
       UNION ALL SELECT c_custkey, 'c_nationkey', 'min', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey < 3
       UNION ALL SELECT c_custkey, 'c_nationkey', 'max', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey > 20""",
)
def constraint_violations(spark, sf):
    c = t.read(spark, sf, "customer").withColumn("c_name", F.expr("substr(c_name, 10, cast(c_custkey % 12 as int))"))
    rules = [
        {"field": "c_name", "required": True, "min_length": 4},
        {"field": "c_mktsegment", "choices": ["BUILDING", "MACHINERY"]},
        {"field": "c_nationkey", "min": 3, "max": 20},
    ]
    return synth.violations(c, "c_custkey", rules)


_SCRIPTS = """
st AS (SELECT l_suppkey % 40 AS journey_id, l_partkey AS step_order, min(CASE l_partkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN '{{c.nome}} {{c.uf}}' WHEN 2 THEN '{{uf}}' ELSE '{{nada}}' END) AS tpl FROM lineitem GROUP BY 1, 2),
dt AS (SELECT c_custkey % 40 AS journey_id, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) - 1 AS row, c_name, c_mktsegment FROM customer),
sz AS (SELECT journey_id, count(*) AS n FROM dt GROUP BY 1),
se AS (SELECT s_suppkey % 40 AS journey_id, s_suppkey AS session_no FROM supplier),
sc AS (SELECT se.journey_id, session_no, step_order, tpl AS input_template, CASE tpl WHEN 'fixed' THEN 'fixed' WHEN '{{uf}}' THEN c_mktsegment WHEN '{{nada}}' THEN tpl ELSE c_name || ' ' || c_mktsegment END AS value
   FROM se JOIN sz USING (journey_id) JOIN dt ON dt.journey_id = se.journey_id AND dt.row = session_no % n JOIN st ON st.journey_id = se.journey_id)"""


def _scripts(spark, sf, counted=False):
    li = t.read(spark, sf, "lineitem")
    template = (
        F.when(F.col("l_partkey") % 4 == 0, "fixed").when(F.col("l_partkey") % 4 == 1, "{{c.nome}} {{c.uf}}").when(F.col("l_partkey") % 4 == 2, "{{uf}}").otherwise("{{nada}}")
    )
    steps = li.groupBy((F.col("l_suppkey") % 40).alias("journey_id"), F.col("l_partkey").alias("step_order")).agg(F.min(template).alias("input_template"))
    c = t.read(spark, sf, "customer").withColumn("journey_id", F.col("c_custkey") % 40)
    data = ordered.scan(c, ["journey_id"], ["c_custkey"], no=ordered.row_number()).select(
        "journey_id", (F.col("no") - 1).alias("row"),
        F.create_map(F.lit("C.NOME"), F.col("c_name"), F.lit("UF"), F.col("c_mktsegment")).alias("values"),
    )
    sessions = t.read(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("journey_id"), F.col("s_suppkey").alias("session_no"))
    return synth.session_scripts(sessions, steps, data, counted)


@query("gen07_session_scripts", t.with_tables(_SCRIPTS) + "SELECT * FROM sc")
def session_scripts(spark, sf):
    return _scripts(spark, sf)


@query(
    "gen08_input_changes",
    t.with_tables(_SCRIPTS)
    + """SELECT journey_id, session_no, count(*) AS total_inputs, count(*) FILTER (value <> input_template) AS replaced, count(*) FILTER (value = input_template) AS unchanged,
         round_even(count(*) FILTER (value <> input_template) / count(*) * 100, 1) AS replaced_pct FROM sc GROUP BY 1, 2""",
)
def input_changes(spark, sf):
    return synth.input_changes(_scripts(spark, sf, counted=True))


@query(
    "gen09_crud_journeys",
    """SELECT 'crud_' || lower(s_name) AS journey_id, CAST(i AS INTEGER) AS step_order, CASE WHEN i = 0 THEN 'menu_sup' ELSE lower(s_name) || '_' || ['', 'include', 'include', 'include_confirm', 'consult', 'consult', 'alter', 'alter', 'delete', 'delete'][i + 1] END AS screen_id,
         ['navigate', 'navigate', 'input', 'verify', 'navigate', 'input', 'navigate', 'submit', 'navigate', 'submit'][i + 1] AS action, ['', 'ENTER', 'F10', 'ENTER', '', 'ENTER', '', 'F10', '', 'ENTER'][i + 1] AS trigger,
         CASE i WHEN 2 THEN '{{' || lower(s_name) || '.nome}}' || chr(10) || '{{' || lower(s_name) || '.saldo}}' WHEN 5 THEN '{{' || lower(s_name) || '.nome}}' ELSE '' END AS input_template
       FROM supplier, (SELECT unnest(range(0, 10)) AS i) WHERE s_acctbal > 2000""",
)
def crud_journeys(spark, sf):
    entities = t.read(spark, sf, "supplier").select(
        F.col("s_name").alias("entity"), F.array(F.lit("nome"), F.lit("saldo")).alias("fields"), (F.col("s_acctbal") > 2000).alias("is_complete")
    )
    return synth.crud_journeys(entities)


@query(
    "gen09_journey_checks",
    """WITH s AS (SELECT conv_id AS journey_id, turn AS position, CASE WHEN conv_id % 5 = 0 THEN turn // 2 WHEN conv_id % 7 = 0 THEN 10 - turn ELSE turn END AS step_order,
          CASE role WHEN 'user' THEN 'navigate' WHEN 'system' THEN 'input' ELSE CASE WHEN conv_id % 3 = 0 THEN 'input' ELSE 'submit' END END AS action, role AS screen_id FROM conversations),
        w AS (SELECT *, lag(step_order) OVER (PARTITION BY journey_id ORDER BY position) AS b, count(*) OVER (PARTITION BY journey_id, screen_id) AS m, count(*) OVER (PARTITION BY journey_id, step_order) AS c FROM s),
        f AS (SELECT journey_id, count(*) AS total_steps, CASE WHEN arg_min(action, position) <> 'navigate' THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (step_order < b) > 0 THEN 1 ELSE 0 END + CASE WHEN max(c) > 1 THEN 1 ELSE 0 END AS issues,
          CASE WHEN count(*) FILTER (action IN ('submit', 'verify')) = 0 THEN 1 ELSE 0 END + CASE WHEN max(m) > 2 THEN 1 ELSE 0 END AS warnings FROM w GROUP BY 1)
      SELECT *, CAST(greatest(0, 100 - issues * 15 - warnings * 5 - CASE WHEN total_steps < 3 THEN 30 ELSE 0 END) AS DOUBLE) AS score,
        issues = 0 AND greatest(0, 100 - issues * 15 - warnings * 5 - CASE WHEN total_steps < 3 THEN 30 ELSE 0 END) >= 50 AS is_valid FROM f""",
)
def journey_checks(spark, sf):
    j, turn = F.col("conv_id"), F.col("turn")
    steps = t.read(spark, sf, "conversations").select(
        j.alias("journey_id"), turn.alias("position"),
        F.when(j % 5 == 0, F.floor(turn / 2)).when(j % 7 == 0, 10 - turn).otherwise(turn).alias("step_order"),
        F.when(F.col("role") == "user", "navigate").when(F.col("role") == "system", "input").when(j % 3 == 0, "input").otherwise("submit").alias("action"),
        F.col("role").alias("screen_id"),
    )
    return synth.validate_journeys(steps)


@query("gen10_journey_verification")
def journey_verification(spark, sf):
    c = t.read(spark, sf, "conversations")
    mark = F.col("conv_id") + F.col("turn")
    steps = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.lit("TIT=x").alias("expected_signature"))
    shown = c.where(mark % 4 != 0).select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("position"),
        F.when(mark % 6 == 1, F.concat("text", F.lit("\nacesso negado"))).otherwise(F.col("text")).alias("text"),
    )
    return synth.verify_journeys(steps, shown)


_MIX = """
mx AS (SELECT o_custkey AS mix_id, o_orderkey AS journey_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS weight,
   o_orderkey % 3 AS min_sessions, CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 0 END AS max_sessions, 20 + o_custkey % 30 AS total_sessions FROM orders),
sm AS (SELECT *, sum(weight) OVER (PARTITION BY mix_id) AS w, max(position) OVER (PARTITION BY mix_id) AS last FROM mx),
ct AS (SELECT *, CASE WHEN max_sessions > 0 THEN least(greatest(min_sessions, total_sessions * weight // w), max_sessions) ELSE greatest(min_sessions, total_sessions * weight // w) END AS c FROM sm),
up AS (SELECT *, sum(c) OVER (PARTITION BY mix_id ORDER BY position) - c AS before FROM ct),
sh AS (SELECT mix_id, journey_id, position, CAST(CASE WHEN position = last THEN total_sessions - before ELSE c END AS BIGINT) AS sessions FROM up WHERE total_sessions - before > 0)"""


def _shares(spark, sf):
    o = ordered.scan(t.read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], position=ordered.row_number())
    key = F.col("o_orderkey")
    return synth.session_mix(
        o.select(
            F.col("o_custkey").alias("mix_id"), key.alias("journey_id"), "position", F.substring("o_orderpriority", 1, 1).cast("long").alias("weight"),
            (key % 3).alias("min_sessions"), F.when(key % 4 == 0, 5).otherwise(0).alias("max_sessions"), (20 + F.col("o_custkey") % 30).alias("total_sessions"),
        )
    )


@query("srt03_session_mix", t.with_tables(_MIX) + "SELECT * FROM sh")
def session_mix(spark, sf):
    return _shares(spark, sf)


@query("srt03_shuffled_sessions", t.with_tables(_MIX) + "SELECT mix_id, journey_id, sum(greatest(sessions, 0))::BIGINT AS sessions FROM sh GROUP BY 1, 2 HAVING sum(greatest(sessions, 0)) > 0")
def shuffled_sessions(spark, sf):
    return synth.shuffled_sessions(_shares(spark, sf), seed=5).groupBy("mix_id", "journey_id").agg(F.count("place").alias("sessions"))


@query("udf01_generator_registry")
def generator_registry(spark, sf):
    """A registered generator of the user next to the built-in ones."""
    known = synth.generators()
    known.register("badge", lambda seed, label, row, **_: F.concat(F.lit("B"), synth.digits(seed, label, row, 5)))
    rows = _rows(spark, sf)
    return rows.select("row", known.get("badge")(1, "badge", F.col("row")).alias("badge"), known.get("nowhere")(1, "x", F.col("row")).alias("fallback"))
