"""Queries over fields, entities, screens and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import knowledge
from tracewell.plans import ordered
from tracewell.queries import tables as t
from tracewell.queries.registry import query

ENTITIES = (
    "CLIENTES PRODUTOS PEDIDOS VENDAS VENDEDORES NOTAS FINANCEIRO FORNECEDORES CONTAS ESTOQUE ITENS_PEDIDO cliente_vip "
    "empresa nota_saida pedido_web"
).split()
FIELDS = (
    "CLIENTE_ID CODCLI ID_PRODUTO PEDIDO_ID FORMA_PGTO COD_ITENS_PEDIDO CD_GRUPO_B NOTAS COD_VEN REF_CONTA ESTOQUE_ATUAL nr_grupo_a "
    "numero_documento doc dt_nasc VLR_TOTAL qtd cpf_cliente obs2 x9"
).split()


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FIELDS = f"""
fl AS (SELECT p_partkey, {_sql_list(ENTITIES)}[p_size % {len(ENTITIES)} + 1] AS entity, {_sql_list(FIELDS)}[p_partkey % {len(FIELDS)} + 1] AS field FROM part)"""


def _fields(spark, sf):
    return t.read(spark, sf, "part").select(
        "p_partkey", _pick(ENTITIES, F.col("p_size")).alias("entity"), _pick(FIELDS, F.col("p_partkey")).alias("field")
    )


def _dictionary_sql() -> str:
    rows = ", ".join(f"('{t_}', '{c}', '{k}', {w})" for t_, (c, k, w) in knowledge.token_dictionary().items())
    context = ", ".join(f"('{p}', '{w}', '{c}', '{k}', {x})" for p, w, c, k, x in knowledge.CONTEXT_WEIGHTS)
    return f"dic(token, category, kind, weight) AS (VALUES {rows}), ctx(part, token, category, kind, weight) AS (VALUES {context})"


@query(
    "jn10_field_classes",
    t.with_tables(_FIELDS, _dictionary_sql())
    + """, tok AS (SELECT p_partkey, entity, field, unnest(regexp_extract_all(lower(field), '([a-z]+|[0-9]+)')) AS token, generate_subscripts(regexp_extract_all(lower(field), '([a-z]+|[0-9]+)'), 1) AS pos FROM fl),
       v AS (SELECT tok.*, category, kind, CAST(weight AS DOUBLE) AS w, pos * 2 + 1 AS o FROM tok JOIN dic USING (token)
             UNION ALL SELECT tok.*, category, kind, CAST(weight AS DOUBLE) * CAST(1.2 AS DOUBLE), pos * 2 FROM tok JOIN ctx ON ctx.token = tok.token AND contains(lower(entity), ctx.part)),
       b AS (SELECT p_partkey, arg_max(category, (w, -o)) AS category, arg_max(kind, (w, -o)) AS kind, max(w) AS w FROM v GROUP BY 1),
       lk AS (SELECT p_partkey, arg_max(token, pos) AS lookup_entity FROM tok WHERE token IN ('cliente', 'fornecedor', 'empresa', 'produto', 'pedido', 'nota', 'duplicata') GROUP BY 1)
     SELECT fl.p_partkey, entity, field, coalesce(category, CASE WHEN lookup_entity IS NOT NULL THEN 'foreign_key' END, '') AS category,
       round(CASE WHEN category IS NULL AND lookup_entity IS NOT NULL THEN 0.6 ELSE least(coalesce(w, 0.0), 1.0) END, 4)::DOUBLE AS confidence,
       coalesce(CASE WHEN fl.p_partkey % 11 = 0 THEN 'date' WHEN fl.p_partkey % 11 = 1 THEN 'decimal' WHEN fl.p_partkey % 11 = 2 THEN 'integer' END, kind, 'text') AS inferred_datatype, lookup_entity
     FROM fl LEFT JOIN b USING (p_partkey) LEFT JOIN lk USING (p_partkey)""",
)
def field_classes(spark, sf):
    key = F.col("p_partkey") % 11
    raw = _fields(spark, sf).select(
        "p_partkey", "entity", "field", F.lit("text").alias("datatype"),
        F.when(key == 0, "@D ").when(key == 1, "999,99").when(key == 2, "9999").alias("picture"),
    )
    return knowledge.classify_fields(raw).drop("datatype", "picture")


@query("fn14_provider_routing")
def provider_routing(spark, sf):
    raw = _fields(spark, sf).select("entity", "field", F.lit("text").alias("datatype"), F.lit("").alias("picture"))
    routed = knowledge.route_providers(knowledge.classify_fields(raw))
    return routed.groupBy("entity", "field", "provider").agg(F.count(F.lit(1)).alias("fields"))


# Expected answers of the key fields among the names above: target, type, confidence, rule.
_KEYS = """
kx(field, target, confidence, evidence) AS (VALUES ('CLIENTE_ID', 'CLIENTES', 0.85, 'alias'), ('CODCLI', 'CLIENTES', 0.85, 'alias'), ('ID_PRODUTO', 'PRODUTOS', 0.85, 'alias'),
  ('PEDIDO_ID', 'PEDIDOS', 0.85, 'alias'), ('COD_ITENS_PEDIDO', 'ITENS_PEDIDO', 0.85, 'alias'), ('COD_VEN', 'VENDEDORES', 0.85, 'alias'), ('cpf_cliente', 'CLIENTES', 0.85, 'alias'))"""


@query(
    "jn13_foreign_keys",
    t.with_tables(_FIELDS, _KEYS)
    + """SELECT p_partkey, fl.field, coalesce(CASE WHEN p_partkey % 10 = 9 THEN 'TABELA' END, target) AS target, CASE WHEN p_partkey % 10 = 9 THEN 'lookup' ELSE 'foreign_key' END AS type,
          CAST(CASE WHEN p_partkey % 10 = 9 THEN 0.95 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN p_partkey % 10 = 9 THEN 'lookup' ELSE evidence END AS evidence
        FROM fl LEFT JOIN kx ON kx.field = fl.field WHERE p_partkey % 10 = 9 OR (target IS NOT NULL AND target <> upper(entity))""",
)
def foreign_keys(spark, sf):
    fields = _fields(spark, sf)
    entities = fields.select(F.col("entity").alias("name")).distinct()
    rows = fields.select(
        F.concat("entity", F.lit("#"), F.col("p_partkey").cast("string")).alias("id"), "entity", "field", "p_partkey",
        F.when(F.col("p_partkey") % 10 == 9, "TABELA").alias("lookup"),
    )
    distinct = rows.select("entity", "field", "lookup").distinct()
    found = knowledge.foreign_keys(distinct, entities)
    joined = rows.join(found, ["entity", "field"]).where(
        (F.col("evidence") == "lookup") == F.col("lookup").isNotNull()
    )
    return joined.where(F.col("evidence").isin("lookup", "alias", "prefix_alias")).select(
        "p_partkey", "field", "target", "type", "confidence", "evidence"
    )


def _key_tokens_sql(name: str) -> str:
    """Distinct tokens of two and more characters, else the whole name."""
    tokens = f"list_distinct(list_filter(regexp_extract_all(lower({name}), '([a-z]+|[0-9]+)'), lambda x: length(x) >= 2))"
    return f"CASE WHEN len({tokens}) > 0 THEN {tokens} ELSE [lower({name})] END"


def _similar_keys_sql() -> str:
    words = ", ".join(f"'{w}'" for w in knowledge.KEY_WORDS)
    tokens = "regexp_extract_all(lower(field), '([a-z]+|[0-9]+)')"
    sim = "len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks)))"
    return (
        t.with_tables(_FIELDS, _KEYS)
        + f""", us AS (SELECT entity, field, count(*) AS uses FROM fl GROUP BY 1, 2),
        dr AS (SELECT us.entity, us.field, target, confidence, evidence FROM us JOIN kx USING (field) WHERE target <> upper(us.entity)),
        op AS (SELECT entity, field, CASE WHEN len(list_filter({tokens}, lambda x: x IN ({words}))) > 0
            THEN array_to_string(list_filter({tokens}, lambda x: length(x) >= 2 AND x NOT IN ({words})), '_') ELSE '' END AS hint FROM us ANTI JOIN dr USING (entity, field)),
        na AS (SELECT DISTINCT entity AS target, {_key_tokens_sql("entity")} AS toks FROM fl),
        hi AS (SELECT hint, {_key_tokens_sql("hint")} AS toks FROM (SELECT DISTINCT hint FROM op WHERE hint <> '')),
        tp AS (SELECT hint, target, {sim} AS sim FROM hi a, na b WHERE {sim} > 0.3 QUALIFY row_number() OVER (PARTITION BY hint ORDER BY sim DESC, target) <= 2),
        si AS (SELECT entity, field, arg_max(target, (sim, -rank)) AS target, max(sim) AS sim FROM (
            SELECT op.entity, op.field, tp.target, tp.sim, row_number() OVER (PARTITION BY entity, field ORDER BY tp.sim DESC, tp.target) AS rank FROM op JOIN tp USING (hint) WHERE upper(tp.target) <> upper(entity)) WHERE rank = 1 GROUP BY 1, 2),
        fd AS (SELECT DISTINCT field, {_key_tokens_sql("field")} AS toks FROM op),
        nm AS (SELECT op.entity, op.field, b.target, upper(b.target) = upper(op.field) AS same, {sim} AS sim FROM op JOIN fd a USING (field), na b
            WHERE length(b.target) >= 3 AND upper(b.target) <> upper(op.entity) AND (left(upper(op.field), 4) = left(upper(b.target), 4) OR left(upper(op.field), 3) = left(upper(b.target), 4)))
      SELECT entity, field, target, 'foreign_key' AS type, CAST(confidence AS DOUBLE) AS confidence, evidence, uses FROM (
        SELECT * FROM dr UNION ALL SELECT entity, field, target, round(least(0.95, sim * 0.4 + 0.60), 3), 'prefix_tokens' FROM si
        UNION ALL SELECT entity, field, target, CASE WHEN same THEN 0.75 ELSE round(sim * 0.35 + 0.55, 3) END, CASE WHEN same THEN 'exact_name' ELSE 'similar_name' END FROM nm WHERE same OR sim > 0.4)
      JOIN us USING (entity, field)"""
    )


@query("jn13_similar_keys", _similar_keys_sql())
def similar_keys(spark, sf):
    fields = _fields(spark, sf)
    found = knowledge.foreign_keys(
        fields.select("entity", "field", F.lit("").alias("lookup")).distinct(), fields.select(F.col("entity").alias("name")).distinct()
    )
    uses = fields.groupBy("entity", "field").agg(F.count(F.lit(1)).alias("uses"))
    return found.join(uses, ["entity", "field"])


@query("jn12_screen_entities")
def screen_entities(spark, sf):
    """Orders as screens: the fields shown follow the line items, the entity fields the parts."""
    li = t.read(spark, sf, "lineitem")
    o = t.read(spark, sf, "orders")
    screens = o.select(
        F.col("o_orderkey").alias("screen_id"),
        F.concat(_pick(("Cadastro de ", "Consulta ", "Relatorio ", "Menu ", ""), F.col("o_orderkey")), F.lower(_pick(ENTITIES, F.col("o_custkey")))).alias("title"),
        F.concat(F.lower(_pick(ENTITIES, F.col("o_custkey") + F.col("o_orderkey") % 2)), F.lit("_110")).alias("program"),
    )
    shown = li.select(F.col("l_orderkey").alias("screen_id"), _pick(FIELDS, F.col("l_partkey")).alias("field"))
    fields = _fields(spark, sf).select("entity", "field").distinct()
    entities = fields.select("entity").distinct().withColumn("storage_type", F.lit("isam"))
    return knowledge.link_screens(screens, shown, fields, entities)


_WORDS = "bolt ring widget gear panel".split()


@query(
    "jn19_capture_bindings",
    """WITH s AS (SELECT doc_id AS screen_id, upper(text) AS sample, upper(source) AS signature FROM documents), b AS (SELECT upper(s_name) AS x, s_suppkey FROM supplier),
        ti AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'THE' WHEN 1 THEN 'SRC' || (s_suppkey % 8) WHEN 2 THEN 'OUNG' || s_suppkey ELSE 'SRC1 TELA' END AS title, s_suppkey FROM supplier),
        fi AS (SELECT title, min('ent' || (s_suppkey % 9)) AS entity FROM ti GROUP BY 1), na AS (SELECT DISTINCT upper(n) AS name, n AS entity FROM (SELECT unnest(['und', 'les', 'nation', 'que']) AS n)),
        h AS (SELECT screen_id, entity, 1 AS r, title AS hit FROM s JOIN fi ON contains(sample, title) UNION ALL SELECT screen_id, entity, 2, title FROM s JOIN fi ON contains(signature, title) OR contains(title, signature)
              UNION ALL SELECT screen_id, entity, 3, name FROM s JOIN na ON contains(sample, name)),
        best AS (SELECT screen_id, arg_min(entity, (r, hit)) AS entity, min(r) AS rule FROM h GROUP BY 1)
      SELECT screen_id, entity, rule FROM s LEFT JOIN best USING (screen_id)""",
)
def capture_bindings(spark, sf):
    screens = t.spread(t.read(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("screen_id"), F.col("text").alias("sample"), F.col("source").alias("signature"))
    k = F.col("s_suppkey")
    title = (
        F.when(k % 4 == 0, "the").when(k % 4 == 1, F.concat(F.lit("src"), (k % 8).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("oung"), k.cast("string"))).otherwise("src1 tela")
    )
    bindings = t.read(spark, sf, "supplier").select(title.alias("title"), F.concat(F.lit("ent"), (k % 9).cast("string")).alias("entity"))
    entities = t.read(spark, sf, "region").select(_pick(("und", "les", "nation", "que"), F.col("r_regionkey")).alias("entity")).distinct()
    return knowledge.bind_captures(screens, bindings, entities)


def _input_fields_sql() -> str:
    """The inputs of a screen one by one, with the fields taken so far."""
    from tracewell.queries import screens

    technical, written, specific, idle = (
        ", ".join(f"'{n}'" for n in names) for names in (knowledge.TECHNICAL_FIELDS, knowledge.WRITTEN_TYPES, knowledge.SPECIFIC_TYPES, knowledge.IDLE_TYPES)
    )
    choice = "{{'key': upper({0}), 'field': {0}, 'method': '{1}', 'confidence': {2}::DOUBLE, 'fixed': {3}}}".format
    return (
        t.with_tables(screens._VALUES, _FIELDS)
        + f""", cat AS (SELECT entity, list_sort(list(DISTINCT field)) AS fields FROM fl GROUP BY 1),
        inp AS (SELECT 's' || (o_custkey % 97) AS session_id, o_custkey AS screen_no, o_orderkey AS seq, v, trim(v) AS s, fields, fields[1:2] AS matched
          FROM vals JOIN orders USING (o_orderkey) JOIN cat ON cat.entity = {_sql_list(ENTITIES)}[o_custkey % {len(ENTITIES)} + 1]),
        kinds AS (SELECT *, {screens.VALUE_TYPE_SQL} AS kind, ({screens.COMMAND_SQL}) AS command, list_transform(fields, lambda name: {screens._meaning_sql()}) AS meanings FROM inp),
        put AS (SELECT *, row_number() OVER w AS no, CAST(sum(CASE WHEN command THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p, kind IN ('text', 'text_long') AS written
          FROM kinds WINDOW w AS (PARTITION BY session_id, screen_no ORDER BY seq, v)),
        opt AS (SELECT *, CASE WHEN command OR len(fields) = 0 OR kind IN ({idle}) THEN []
            WHEN kind IN ({specific}) AND list_contains(meanings, kind) THEN [{choice("fields[list_position(meanings, kind)]", "by_semantic_type", 0.95, "TRUE")}]
            ELSE list_concat(CASE WHEN p <= len(matched) THEN [{choice("matched[p]", "by_matched_fields", 0.85, "FALSE")}] ELSE [] END,
              CASE WHEN p <= len(fields) AND (kind = meanings[p] OR (written AND meanings[p] IN ({written}))) AND NOT (written AND upper(fields[p]) IN ({technical}))
                THEN [{choice("fields[p]", "by_screen_order", 0.75, "FALSE")}] ELSE [] END,
              CASE WHEN written THEN list_transform(list_filter(range(1, len(fields) + 1), lambda i: upper(fields[i]) NOT IN ({technical}) AND meanings[i] IN ({written})),
                lambda i: {choice("fields[i]", "by_field_name", 0.65, "FALSE")}) ELSE [] END) END AS options FROM put),
        walk AS (
          SELECT session_id, screen_no, no, options[1] AS c, CASE WHEN len(options) > 0 THEN [options[1].key] ELSE []::VARCHAR[] END AS used FROM opt WHERE no = 1
          UNION ALL SELECT session_id, screen_no, no, c, CASE WHEN c IS NULL THEN used ELSE list_append(used, c.key) END FROM (
            SELECT o.session_id, o.screen_no, o.no, used, list_filter(o.options, lambda x: x.fixed OR NOT list_contains(used, x.key))[1] AS c
            FROM walk w JOIN opt o ON o.session_id = w.session_id AND o.screen_no = w.screen_no AND o.no = w.no + 1))
      SELECT session_id, screen_no, seq, kind, c.field AS field, coalesce(c.method, CASE WHEN command THEN 'command' ELSE 'unmapped' END) AS method,
        coalesce(c.confidence, CASE WHEN command THEN 1.0 ELSE 0.0 END)::DOUBLE AS confidence
      FROM walk JOIN opt USING (session_id, screen_no, no)"""
    )


@query("jn20_input_fields", _input_fields_sql())
def input_fields(spark, sf):
    """Order values typed on the screens of a customer, mapped to the fields of an entity."""
    from tracewell.queries.screens import _values

    values = _values(spark, sf).join(t.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    catalog = _fields(spark, sf).groupBy("entity").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    inputs = values.select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 97).cast("string")).alias("session_id"), F.col("o_custkey").alias("screen_no"),
        F.col("o_orderkey").alias("seq"), F.col("v").alias("value"), _pick(ENTITIES, F.col("o_custkey")).alias("entity"),
    ).join(catalog, "entity")
    return knowledge.map_inputs(inputs.withColumn("matched", F.slice("fields", 1, 2)))


@query(
    "jn21_step_dependencies",
    """WITH h AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'TELA' || (l_suppkey % 30) END AS source,
         CASE WHEN l_linenumber % 2 = 0 THEN 'F' || (l_partkey % 40) ELSE 'CAMPO' || (l_partkey % 20) END AS field,
         CASE WHEN l_linenumber % 2 = 0 THEN 'TELA' || (l_suppkey % 30) ELSE '' END AS target FROM lineitem),
       d AS (SELECT source AS screen, source || '.' || field AS needs FROM h WHERE source <> '' UNION SELECT target, source || '.' || field FROM h WHERE target <> '')
       SELECT o_custkey AS journey_id, o_orderkey AS step_order, count(DISTINCT needs) AS dependencies FROM orders JOIN d ON screen = 'TELA' || (o_orderkey % 60) GROUP BY 1, 2""",
)
def step_dependencies(spark, sf):
    li = t.read(spark, sf, "lineitem")
    lines = li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"),
        F.when(
            F.col("l_linenumber") % 2 == 0,
            F.concat(F.lit("SET RELATION TO f"), (F.col("l_partkey") % 40).cast("string"), F.lit(" INTO tela"), (F.col("l_suppkey") % 30).cast("string")),
        )
        .otherwise(F.concat(F.lit("? tela"), (F.col("l_suppkey") % 30).cast("string"), F.lit("->campo"), (F.col("l_partkey") % 20).cast("string")))
        .alias("line"),
    )
    steps = t.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("journey_id"), F.col("o_orderkey").alias("step_order"),
        F.concat(F.lit("Tela"), (F.col("o_orderkey") % 60).cast("string")).alias("screen_id"),
    )
    found = knowledge.step_dependencies(steps, knowledge.relation_hints(lines))
    return found.groupBy("journey_id", "step_order").agg(F.count(F.lit(1)).alias("dependencies"))


@query(
    "jn21_relation_hints",
    """SELECT l_orderkey AS file, l_linenumber AS line_no, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'TELA' || (l_suppkey % 30) END AS source_screen,
         CASE WHEN l_linenumber % 2 = 0 THEN 'F' || (l_partkey % 40) ELSE 'CAMPO' || (l_partkey % 20) END AS source_field,
         CASE WHEN l_linenumber % 2 = 0 THEN 'TELA' || (l_suppkey % 30) ELSE '' END AS target_screen, CASE WHEN l_linenumber % 2 = 0 THEN 'relation' ELSE 'alias_reference' END AS dependency_type FROM lineitem""",
)
def relation_hints(spark, sf):
    li = t.read(spark, sf, "lineitem")
    lines = li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"),
        F.when(
            F.col("l_linenumber") % 2 == 0,
            F.concat(F.lit("SET RELATION TO f"), (F.col("l_partkey") % 40).cast("string"), F.lit(" INTO tela"), (F.col("l_suppkey") % 30).cast("string")),
        )
        .otherwise(F.concat(F.lit("? tela"), (F.col("l_suppkey") % 30).cast("string"), F.lit("->campo"), (F.col("l_partkey") % 20).cast("string")))
        .alias("line"),
    )
    return knowledge.relation_hints(lines)


@query(
    "jn16_uncovered_entities",
    "SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def uncovered_entities(spark, sf):
    return knowledge.without_partner(
        t.read(spark, sf, "customer").select(F.col("c_custkey").alias("entity")),
        t.read(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("entity")), "entity",
    )


_NAMES = ("cad110", "epp_itens", "pedidos", "fat210", "cre", "forn_sul", "cmp1", "estoque", "empresa", "loja", "usuario", "recebimento", "zz")


def _systems_sql() -> str:
    return f"sy AS (SELECT l_orderkey AS system, {_sql_list(_NAMES)}[l_partkey % 97 % {len(_NAMES)} + 1] AS entity FROM lineitem)"


def _business_sql() -> str:
    from tracewell.operators.knowledge import BUSINESS_NAMES

    cases = " ".join("WHEN regexp_matches(entity, '^(?:" + "|".join(w) + f")') THEN '{n}'" for n, w in BUSINESS_NAMES)
    return f"bn AS (SELECT DISTINCT system, CASE {cases} ELSE entity END AS entity FROM sy)"


def _systems(spark, sf):
    """The parts of an order as the entities of a system."""
    li = t.read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("system"), _pick(_NAMES, F.col("l_partkey") % 97).alias("entity"))


_RULE_ROWS = ", ".join(f"('{r}', '{a}', '{b}', '{'critical' if c else 'high'}')" for r, a, b, c in knowledge.BUSINESS_RULES)
_FLOW_ROWS = ", ".join(f"('{f}', '{e}')" for f, s in knowledge.BUSINESS_FLOWS for e in s)


@query(
    "jn17_business_rules",
    t.with_tables(_systems_sql(), _business_sql(), f"ru(rule_id, depends_on, enables, sev) AS (VALUES {_RULE_ROWS})")
    + """SELECT system, rule_id, depends_on, enables, CASE WHEN d AND e THEN 'ok' WHEN e THEN 'gap' ELSE 'absent' END AS state, CASE WHEN e AND NOT d THEN sev END AS severity FROM (
         SELECT system, rule_id, depends_on, enables, sev, bool_or(entity = depends_on) AS d, bool_or(entity = enables) AS e FROM bn, ru GROUP BY ALL)""",
)
def business_rules(spark, sf):
    return knowledge.rule_coverage(_systems(spark, sf))


@query(
    "jn17_flow_coverage",
    t.with_tables(_systems_sql(), _business_sql(), f"fr(flow_id, step) AS (VALUES {_FLOW_ROWS})")
    + """SELECT system, flow_id, round_even(count(DISTINCT step) FILTER (entity = step) / count(DISTINCT step) * 100, 1) AS coverage_pct FROM bn, fr GROUP BY 1, 2""",
)
def flow_coverage(spark, sf):
    return knowledge.flow_coverage(_systems(spark, sf))


_STATUS = "CASE WHEN l_returnflag = 'R' AND l_tax > 0.05 THEN 'failed' WHEN l_tax > 0.06 THEN 'warning' ELSE 'ok' END"


@query(
    "agg17_journey_errors",
    t.with_tables(t.FAILURES_SQL)
    + f""", r AS (SELECT l_orderkey, l_suppkey AS step_order, {_STATUS} AS status FROM lineitem)
       SELECT 'type' AS dimension, failure_type AS name, CAST(count(*) AS DOUBLE) AS value FROM failures GROUP BY 2 UNION ALL SELECT 'severity', severity, CAST(count(*) AS DOUBLE) FROM failures GROUP BY 2
       UNION ALL SELECT * FROM (SELECT 'step', CAST(step_order AS VARCHAR) AS s, CAST(count(*) AS DOUBLE) AS c FROM r WHERE status = 'failed' GROUP BY 2 ORDER BY c DESC, s LIMIT 10)
       UNION ALL SELECT 'total', 'overall_pass_rate_pct', round_even(count(*) FILTER (status = 'ok') / count(*) * 100, 2) FROM r""",
)
def journey_errors(spark, sf):
    results = t.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("step_order"), F.expr(_STATUS).alias("status")
    )
    errors = t.failures(spark, sf).select(F.col("failure_type").alias("error_type"), "severity")
    return knowledge.journey_errors(results, errors, top=10)


@query(
    "agg22_schedule_totals",
    """SELECT count(*) AS total_runs, round_even(avg(CAST(o_totalprice AS BIGINT)), 0) AS avg_duration_ms, max(CAST(o_totalprice AS BIGINT)) AS max_duration_ms,
         round_even(avg(o_custkey % 101), 1) AS avg_success_rate_pct FROM orders""",
)
def schedule_totals(spark, sf):
    runs = t.read(spark, sf, "orders").select(
        F.round("o_totalprice").cast("long").alias("duration_ms"), (F.col("o_custkey") % 101).alias("success_rate_pct")
    )
    return knowledge.schedule_totals(runs)


@query(
    "agg22_last_runs",
    "SELECT o_orderkey AS run_id, o_custkey AS schedule_id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 10",
)
def last_runs(spark, sf):
    runs = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("schedule_id"), F.col("o_orderstatus").alias("status")
    )
    return knowledge.last_runs(runs, 10)


_SCRIPTS = """
sc AS (SELECT l_suppkey AS journey_id, l_orderkey AS session_id, CASE WHEN l_returnflag = 'A' THEN 'command' ELSE 'input' END AS type, 'f' || (l_partkey % 12) AS field,
   CASE WHEN l_tax > 0.075 THEN '{{x.y}}' ELSE 'v' END AS value FROM lineitem)"""


@query(
    "agg23_session_scripts",
    t.with_tables(
        _SCRIPTS,
        "ps AS (SELECT journey_id, session_id, count(*) FILTER (type = 'input') AS i, count(*) FILTER (type = 'command') AS c, count(*) FILTER (contains(value, '{{')) AS u FROM sc GROUP BY 1, 2)",
        "ef AS (SELECT DISTINCT s_suppkey AS journey_id, 'f' || p AS field FROM supplier, (SELECT unnest(range(0, 14)) AS p))",
    )
    + """SELECT * FROM (SELECT journey_id, count(*) AS sessions, count(*) FILTER (u = 0) AS valid_sessions, CAST(sum(i) AS BIGINT) AS inputs, CAST(sum(c) AS BIGINT) AS commands, CAST(sum(u) AS BIGINT) AS unresolved FROM ps GROUP BY 1)
         LEFT JOIN (SELECT journey_id, round_even(count(h.field) / count(*) * 100, 1) AS coverage_pct FROM ef LEFT JOIN (SELECT DISTINCT journey_id, field FROM sc WHERE type = 'input') h USING (journey_id, field) GROUP BY 1) USING (journey_id)""",
)
def session_scripts(spark, sf):
    inputs = t.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("journey_id"), F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_returnflag") == "A", "command").otherwise("input").alias("type"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 12).cast("string")).alias("field"),
        F.when(F.col("l_tax") > 0.075, "{{x.y}}").otherwise("v").alias("value"),
    )
    expected = t.read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("journey_id"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("f"), i.cast("string")))).alias("field"),
    )
    return knowledge.session_script_summary(inputs, expected)


def _findings(spark, sf, top=None):
    c = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 2 == 0, "sql").otherwise("isam").alias("storage_type")
    )
    operations = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("entity"))
    fields = t.read(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_custkey").alias("entity"))
    metrics = t.read(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("target"), F.when(F.col("s_suppkey") % 2 == 0, "tps").otherwise("avg_latency_ms").alias("metric"),
        (F.col("s_acctbal") / 100 - 30).alias("delta_pct"),
    )
    text = c.withColumn("entity", F.col("entity").cast("string"))
    return knowledge.assessment_findings(
        text, operations.select(F.col("entity").cast("string")), fields.select(F.col("entity").cast("string")), t.failures(spark, sf), metrics, top
    )


_FINDINGS = """
fd AS (SELECT 'unused' AS kind, CAST(c_custkey AS VARCHAR) AS name, 'no operations' AS reason, CASE WHEN c_custkey % 2 = 0 THEN 'low' ELSE 'medium' END AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'unused', CAST(c_custkey AS VARCHAR), 'no fields', 'low' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')
  UNION ALL SELECT 'bottleneck', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'performance_degradation' ELSE 'latency_increase' END,
    CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_acctbal / 100 - 30 < -30 THEN 'high' ELSE 'medium' END ELSE CASE WHEN s_acctbal / 100 - 30 > 50 THEN 'high' ELSE 'medium' END END
    FROM supplier WHERE (s_suppkey % 2 = 0 AND s_acctbal / 100 - 30 < -15) OR (s_suppkey % 2 = 1 AND s_acctbal / 100 - 30 > 20)
  UNION ALL SELECT * FROM (SELECT 'risk', flow_name, 'failing flow', CASE WHEN count(*) > 10 THEN 'high' ELSE 'medium' END FROM failures GROUP BY 2 ORDER BY count(*) DESC, flow_name LIMIT {top}))"""


@query("agg25_assessment_findings", t.with_tables(t.FAILURES_SQL, _FINDINGS.replace("{top}", "5")) + "SELECT * FROM fd")
def assessment_findings(spark, sf):
    return _findings(spark, sf, top=5)


@query(
    "agg25_health_score",
    t.with_tables(t.FAILURES_SQL, _FINDINGS.replace(" LIMIT {top}", ""))
    + """SELECT count(*) AS findings, greatest(0.0, least(100.0, round_even(100.0 - sum(CASE WHEN kind = 'unused' THEN CASE severity WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 1 END
          WHEN reason = 'performance_degradation' THEN 10 WHEN reason = 'latency_increase' THEN 8 ELSE CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 7.5 ELSE 3 END END)
          - greatest(count(*) - 20, 0) * 1.5, 1)))::DOUBLE AS health_score FROM fd""",
)
def health_score(spark, sf):
    return knowledge.health_score(_findings(spark, sf))


@query(
    "udf03_screen_rules",
    """WITH ev AS (SELECT event_id, 'k' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS sig, event_type AS state, value FROM events),
        ru AS (SELECT r_regionkey, r_regionkey % 3 AS priority FROM region),
        m AS (SELECT event_id, 'rule' || r_regionkey AS rule_id, priority FROM ev JOIN (SELECT r_regionkey, priority, unnest(range(0, 100)) AS k FROM ru) x ON ev.sig = 'k' || k
              WHERE k % 5 <= r_regionkey AND (r_regionkey % 2 = 0 OR state IN ('click', 'view')) AND (r_regionkey <> 3 OR value > 50))
      SELECT event_id, arg_min(rule_id, (-priority, rule_id)) AS rule_id, 'next_' || arg_min(rule_id, (-priority, rule_id)) AS next_state FROM m GROUP BY 1""",
)
def screen_rules(spark, sf):
    from tracewell.operators import rules

    key = F.col("r_regionkey")
    name = F.concat(F.lit("rule"), key.cast("string"))
    table = t.read(spark, sf, "region").select(
        name.alias("rule_id"), (key % 3).alias("priority"), F.concat(F.lit("next_"), name).alias("next_state"),
        F.when(key % 2 == 1, F.array(F.lit("click"), F.lit("view"))).alias("states"),
        F.when(key == 3, "large").alias("predicate"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(99)), lambda k: k % 5 <= key)).alias("k"),
    ).withColumn("signature", F.concat(F.lit("k"), F.col("k").cast("string"))).drop("k")
    screens = t.read(spark, sf, "events").select(
        "event_id", F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("signature"), F.col("event_type").alias("state"), "value"
    )
    return rules.dispatch(screens, table, "event_id", {"large": F.col("value") > 50}).select("event_id", "rule_id", "next_state")


@query(
    "udf02_extractor_plugins",
    r"""SELECT file, extractor, entity, count(*) AS mentions FROM (
          SELECT page_id AS file, 'links' AS extractor, unnest(regexp_extract_all(html, '<a href="/([^"]+)"', 1)) AS entity FROM pages
          UNION ALL SELECT page_id, 'titles', regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages) WHERE entity <> '' GROUP BY ALL""",
)
def extractor_plugins(spark, sf):
    from tracewell import registry

    plugins = registry.Extractors()
    plugins.register("links", lambda files: files.select("file", F.explode(F.regexp_extract_all("text", F.lit('<a href="/([^"]+)"'), F.lit(1))).alias("entity")))
    plugins.register("titles", lambda files: files.select("file", F.regexp_extract("text", "<title>([^<]*)</title>", 1).alias("entity")))
    files = t.read(spark, sf, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))
    return plugins.extract(files)
