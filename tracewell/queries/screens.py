"""Queries over screen texts, key input, signatures and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import naming, text as tx
from tracewell.operators import screens
from tracewell.plans import ordered
from tracewell.plans.lineage import settle
from tracewell.queries import tables as t
from tracewell.queries.registry import query

# ------------------------------------------------------------ screen texts from documents

_SCREENS = r"""
scr AS (SELECT doc_id, CASE doc_id % 4
    WHEN 1 THEN '+----- MENU ' || upper(source) || ' -----+' || chr(10) || 'Nome cliente: ____' || chr(10) || '[Codigo] ____' || chr(10) || '1. Cadastros' || chr(10) || '2. ' || lang || chr(10) || text
    WHEN 2 THEN chr(27) || '[2J' || chr(27) || '[1;31m┌──┐  ' || chr(13) || chr(10) || '│ ' || source || ' │   ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || replace(text, '. ', '.  ' || chr(10) || chr(10)) || chr(10) || chr(10)
    WHEN 3 THEN text || chr(10) || 'ERRO: registro não encontrado no campo CPF' || chr(10) || 'CHAVE  DUPLICADA; access denied' || chr(10) || 'Data: ok'
    ELSE text END AS text FROM documents)"""


def _screens(spark, sf):
    """Documents dressed as menus, as raw terminal output, with error lines, or plain."""
    nl = "\n"
    return t.spread(t.read(spark, sf, "documents"), "doc_id").select(
        "doc_id",
        F.when(
            F.col("doc_id") % 4 == 1,
            F.concat(
                F.lit("+----- MENU "), F.upper("source"),
                F.lit(f" -----+{nl}Nome cliente: ____{nl}[Codigo] ____{nl}1. Cadastros{nl}2. "), "lang", F.lit(nl), "text",
            ),
        )
        .when(
            F.col("doc_id") % 4 == 2,
            F.concat(
                F.lit("\x1b[2J\x1b[1;31m┌──┐  \r\n│ "), "source", F.lit(" │   \r\n\n\n\n"),
                F.replace("text", F.lit(". "), F.lit(".  \n\n")), F.lit("\n\n"),
            ),
        )
        .when(
            F.col("doc_id") % 4 == 3,
            F.concat("text", F.lit("\nERRO: registro não encontrado no campo CPF\nCHAVE  DUPLICADA; access denied\nData: ok")),
        )
        .otherwise(F.col("text"))
        .alias("text"),
    )


def _sql_ansi(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '\x1B\[[0-9;?]*[A-Za-z]', '', 'g'), '\x1B.', '', 'g')"


def _sql_normal(column: str) -> str:
    out = f"translate({_sql_ansi(column)}, '{tx.BOX_CHARACTERS}', '{tx.BOX_PLAIN}')"
    out = f"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return out


_NORM = (
    "norm AS (SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(ls, range(1, len(ls) + 1)), "
    "lambda z: z[1] <> '' OR z[2] = 1 OR ls[z[2] - 1] <> ''), lambda z: z[1]), chr(10)) AS norm FROM ("
    r"SELECT doc_id, list_transform(string_split("
    + _sql_normal("text")
    + r", chr(10)), lambda l: regexp_replace(l, '\s+$', '')) AS ls FROM scr))"
)


@query("fn01_normalised_screens", t.with_tables(_SCREENS, _NORM) + "SELECT doc_id, sha256(norm) AS norm_sha256, length(norm) AS norm_len FROM norm")
def normalised_screens(spark, sf):
    return _screens(spark, sf).withColumn("norm", tx.normalize_screen(F.col("text"))).select(
        "doc_id", F.sha2("norm", 256).alias("norm_sha256"), F.length("norm").cast("long").alias("norm_len")
    )


_LAYOUT = r"""
body AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(norm, '^(\s*\n)+', ''), '(\n\s*)+$', ''), chr(10)) AS ls FROM norm),
lay AS (SELECT doc_id, ls, list_filter(list_transform(ls, lambda l: trim(l, ' ' || chr(9))), lambda l: l <> '') AS shown,
   list_filter(list_transform(list_filter(ls[1:4], lambda l: trim(l) <> '' AND length(regexp_replace(l, '[^+\-=|]', '', 'g')) >= 3), lambda l: trim(l)), lambda l: l <> '') AS tit,
   list_filter(list_transform(ls, lambda l: regexp_replace(regexp_extract(trim(l), '([A-Za-zÀ-ÿ][0-9A-Za-zÀ-ÿ _]{1,20}):', 1), '\s+', ' ', 'g')), lambda l: l <> '') AS lbl FROM body)"""


@query(
    "fn02_layout_signature",
    t.with_tables(_SCREENS, _NORM, _LAYOUT)
    + """SELECT doc_id, 'L=' || CASE WHEN len(ls) = 1 AND trim(ls[1]) = '' THEN 0 ELSE len(ls) END || ';W=' || list_max(list_transform(ls, lambda l: length(l)))
         || CASE WHEN len(tit) > 0 THEN ';TIT=' || array_to_string(tit, '|') ELSE '' END
         || CASE WHEN len(lbl) > 0 THEN ';LBL=' || array_to_string(lbl, ';') ELSE '' END AS signature FROM lay""",
)
def layout_signature(spark, sf):
    return _screens(spark, sf).select("doc_id", tx.layout_signature(tx.normalize_screen(F.col("text"))).alias("signature"))


@query(
    "fn03_screen_sample",
    t.with_tables(_SCREENS, _NORM)
    + r"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(norm, chr(10)), lambda l: trim(l) <> '')[1:6], lambda l: l[1:120]), chr(10)) AS sample FROM norm""",
)
def screen_sample(spark, sf):
    return _screens(spark, sf).select("doc_id", tx.screen_sample(tx.normalize_screen(F.col("text"))).alias("sample"))


def _rules_sql() -> str:
    parts = []
    for no, (shape, kind, severity, _) in enumerate(screens.ERROR_RULES):
        parts.append(
            f"SELECT doc_id, {no} AS rule_no, '{kind}' AS error_type, '{severity}' AS severity, "
            f"len(regexp_extract_all(clean, '(?i){shape}')) AS matches FROM cl"
        )
    return (
        "cl AS (SELECT doc_id, regexp_replace(replace(replace("
        + _sql_ansi("text")
        + ", chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' {2,}', ' ', 'g') AS clean FROM scr), "
        "hits AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE matches > 0)"
    )


@query("jn09_error_matches", t.with_tables(_SCREENS, _rules_sql()) + "SELECT * FROM hits")
def error_matches(spark, sf):
    found = screens.detect_errors(_screens(spark, sf))
    return found.groupBy("doc_id", "rule_no", "error_type", "severity").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "jn09_error_lines",
    t.with_tables(_SCREENS)
    + """SELECT doc_id, 'ERRO: registro não encontrado no campo CPF' AS line_text, 'CPF' AS field_name,
         'Verificar se o registro de referência existe antes desta operação' AS suggestion FROM scr WHERE doc_id % 4 = 3""",
)
def error_lines(spark, sf):
    found = screens.detect_errors(_screens(spark, sf)).where((F.col("rule_no") == 11) & (F.col("field_name") == "CPF"))
    return found.select("doc_id", "line_text", "field_name", "suggestion")


@query(
    "srt02_worst_severity",
    t.with_tables(_SCREENS, _rules_sql())
    + """SELECT doc_id, arg_min(severity, (CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, rule_no)) AS severity,
          arg_min(error_type, (CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, rule_no)) AS error_type FROM hits GROUP BY 1""",
)
def worst_severity(spark, sf):
    # as a row of its own the error is worked out once, not again for the filter and for each of its parts
    found = _screens(spark, sf).select("doc_id", F.explode_outer(F.array(screens.screen_errors(F.col("text")))).alias("e"))
    return found.where(F.col("e").isNotNull()).select("doc_id", "e.severity", "e.error_type")


@query(
    "fn16_screen_states",
    t.with_tables(_SCREENS, _rules_sql())
    + r""", e AS (SELECT doc_id, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS s FROM hits GROUP BY 1)
       SELECT doc_id, CASE WHEN s IS NOT NULL THEN 'error' WHEN doc_id % 2 = 0 AND regexp_matches(clean, '(?i)(?:erro|error|falha|n[ãa]o foi poss[íi]vel)') THEN 'warning'
           WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 AND regexp_matches(clean, '(?i)(?:login|usu[áa]rio|senha|password|sign\s*on)') THEN 'navigation_divergence' ELSE 'ok' END AS status,
         CASE WHEN s IS NOT NULL THEN ['critical', 'high', 'medium', 'low'][s + 1] WHEN doc_id % 2 = 0 AND regexp_matches(clean, '(?i)(?:erro|error|falha|n[ãa]o foi poss[íi]vel)') THEN 'low'
           WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 AND regexp_matches(clean, '(?i)(?:login|usu[áa]rio|senha|password|sign\s*on)') THEN 'high' ELSE '' END AS severity
       FROM cl LEFT JOIN e USING (doc_id)""",
)
def screen_states(spark, sf):
    asked = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 == 0, "TIT=Menu").otherwise("TIT=Other"))
    found = screens.classify_screens(_screens(spark, sf).withColumn("expected_signature", asked))
    return found.select("doc_id", "status", "severity")


@query(
    "fn16_screen_mining",
    t.with_tables(_SCREENS)
    + r""", m AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
           lambda l: length(l) > 3 AND NOT regexp_full_match(l, '[+\-|=]+')) AS c FROM scr)
       SELECT doc_id, coalesce(c[1], '')[1:60] AS title,
         array_to_string(list_transform(regexp_extract_all(text, '(\d+)\.\s+(.+)', 2), lambda o: regexp_replace(o, '^\s+|\s+$', '', 'g')[1:40]), '|') AS menu_options FROM m""",
)
def screen_mining(spark, sf):
    mined = screens.mine_screens(_screens(spark, sf))
    return mined.select("doc_id", "title", F.array_join("menu_options", "|").alias("menu_options"))


@query("fn16_page_mining")
def page_mining(spark, sf):
    pages = t.read(spark, sf, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    mined = screens.mine_screens(pages)
    return mined.select("page_id", "title", F.array_join("fields", "|").alias("fields"), "is_menu", "screen_signature")


# ------------------------------------------------------------ key input

_KEYS = r"""
keys AS (SELECT event_id, k, CASE k % 13 WHEN 0 THEN '' WHEN 1 THEN chr(13) WHEN 2 THEN chr(9) WHEN 3 THEN chr(27) WHEN 4 THEN chr(27) || '[A'
    WHEN 5 THEN 'a' WHEN 6 THEN 'list ' || k || chr(13) WHEN 7 THEN 'ab' || k WHEN 8 THEN repeat('x', k) WHEN 9 THEN 'l1' || chr(13) || chr(10) || 'l2' || chr(13)
    WHEN 10 THEN chr(8) WHEN 11 THEN chr(1) || chr(2) ELSE 'é' || k END AS data
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _keys(spark, sf):
    k = F.col("k")
    n = k.cast("string")
    forms = [
        F.lit(""), F.lit("\r"), F.lit("\t"), F.lit("\x1b"), F.lit("\x1b[A"), F.lit("a"),
        F.concat(F.lit("list "), n, F.lit("\r")), F.concat(F.lit("ab"), n), F.expr("repeat('x', cast(k as int))"),
        F.lit("l1\r\nl2\r"), F.lit("\x08"), F.lit("\x01\x02"), F.concat(F.lit("é"), n),
    ]
    data = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        data = F.when(k % 13 == i, form).otherwise(data)
    ev = t.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return ev.select("event_id", "k", data.alias("data"))


_PASTE = r"(strlen(data) >= 64 OR length(regexp_replace(data, '[^\r\n]', '', 'g')) > 1 OR (strlen(data) >= 16 AND NOT contains(data, 'é') AND NOT contains(data, chr(27))))"
_COMMAND = r"regexp_full_match(data, '[ -~]{1,120}[\r\n]+')"


@query(
    "fn05_input_kinds",
    t.with_tables(_KEYS)
    + rf"""SELECT event_id, CASE WHEN data = '' THEN 'empty' WHEN {_PASTE} THEN 'paste' WHEN {_COMMAND} THEN 'command_with_enter'
          WHEN data IN (chr(13), chr(10)) THEN 'enter' WHEN data = chr(9) THEN 'tab' WHEN data = chr(8) THEN 'backspace' WHEN data = chr(27) THEN 'escape'
          WHEN regexp_full_match(data, '[\x00-\x1f\x7f]+') THEN 'control' WHEN starts_with(data, chr(27) || '[') THEN 'ansi_sequence'
          WHEN regexp_full_match(data, '[ -~]') THEN 'printable' WHEN regexp_full_match(data, '[ -~]+') THEN 'multi_char' ELSE 'bytes' END AS kind,
        replace(replace(replace(replace(replace(replace(replace(replace(data, chr(13), '\r'), chr(10), '\n'), chr(9), '\t'), chr(27), '\e'), chr(8), '\b'), chr(1), '\x01'), chr(2), '\x02'), 'é', '\xc3\xa9')[1:120] AS shown
        FROM keys""",
)
def input_kinds(spark, sf):
    data = F.col("data").cast("binary")
    return _keys(spark, sf).select(
        "event_id", tx.classify_input(data).alias("kind"), tx.printable_input(data).alias("shown")
    )


@query(
    "fn06_atomic_inputs",
    t.with_tables(_KEYS)
    + rf"""SELECT event_id, part_no, logical_parts, part FROM (SELECT event_id, len(parts) AS logical_parts, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS part_no FROM (
          SELECT event_id, CASE WHEN starts_with(data, chr(27)) OR {_PASTE} THEN [data] WHEN {_COMMAND} THEN list_append(string_split(rtrim(data, chr(13) || chr(10)), ''), regexp_extract(data, '([\r\n]+)$', 1))
            WHEN regexp_full_match(data, '[ -~]{{2,8}}') THEN string_split(data, '') ELSE [replace(data, 'é', chr(195) || chr(169))] END AS parts FROM keys))""",
)
def atomic_inputs(spark, sf):
    parts = _keys(spark, sf).select("event_id", tx.atomic_inputs(F.col("data").cast("binary")).alias("parts"))
    return parts.select("event_id", F.size("parts").cast("long").alias("logical_parts"), F.posexplode("parts").alias("part_no", "part")).select(
        "event_id", F.col("part_no").cast("long").alias("part_no"), "logical_parts", "part"
    )


@query(
    "fn07_key_events",
    t.with_tables(_KEYS)
    + r"""SELECT event_id, array_to_string(list_transform(regexp_extract_all(data, '\x1b\[[A-Za-z]|\x1b\[|\x1b|[\r\n]|\t|[^\x1b\r\n\t]+'), lambda x:
         CASE WHEN x IN (chr(13), chr(10)) THEN '{KEY:ENTER}' WHEN x = chr(9) THEN '{KEY:TAB}' WHEN length(x) = 3 AND x[1] = chr(27) THEN '{KEY:' || x[3] || '}'
           WHEN x[1] = chr(27) THEN '{KEY:ESC}' ELSE x END), '|') AS events FROM keys""",
)
def key_events(spark, sf):
    return _keys(spark, sf).select("event_id", F.array_join(tx.key_events(F.col("data")), "|").alias("events"))


# ------------------------------------------------------------ values and names

_VALUES = r"""
vals AS (SELECT o_orderkey, CASE o_orderkey % 14 WHEN 0 THEN lpad(CAST(o_custkey * 7919 AS VARCHAR), 11, '1') WHEN 1 THEN '12.345.678/0001-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN '(11) 9' || lpad(CAST(o_custkey AS VARCHAR), 4, '8') || '-1234' WHEN 3 THEN '01310-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 6 THEN CAST(o_custkey AS VARCHAR) || ',50' WHEN 7 THEN ' u' || o_custkey || '@mail.com ' WHEN 8 THEN 's' WHEN 9 THEN CAST(o_custkey % 100 AS VARCHAR)
    WHEN 10 THEN 'F' || (o_custkey % 13) WHEN 11 THEN '{KEY:ENTER}' WHEN 12 THEN chr(27) || '[B' ELSE o_orderpriority || ' ' || repeat('w', o_custkey % 40) END AS v FROM orders)"""


def _values(spark, sf):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    n = who.cast("string")
    forms = [
        F.lpad((who * 7919).cast("string"), 11, "1"),
        F.concat(F.lit("12.345.678/0001-"), F.lpad((who % 100).cast("string"), 2, "0")),
        F.concat(F.lit("(11) 9"), F.lpad(n, 4, "8"), F.lit("-1234")),
        F.concat(F.lit("01310-"), F.lpad((who % 1000).cast("string"), 3, "0")),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.concat(n, F.lit(",50")),
        F.concat(F.lit(" u"), n, F.lit("@mail.com ")),
        F.lit("s"),
        (who % 100).cast("string"),
        F.concat(F.lit("F"), (who % 13).cast("string")),
        F.lit("{KEY:ENTER}"),
        F.lit("\x1b[B"),
        F.concat("o_orderpriority", F.lit(" "), F.expr("repeat('w', cast(o_custkey % 40 as int))")),
    ]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(key % 14 == i, form).otherwise(out)
    return t.read(spark, sf, "orders").select("o_orderkey", out.alias("v"))


_SHAPES = {
    "CPF": naming.CPF, "CNPJ": naming.CNPJ, "PHONE": naming.PHONE, "POST": naming.POSTCODE, "ISO": naming.ISO_DATE, "NUM": naming.NUMBER,
}


#: Type of the value s, and whether it is a command, as SQL.
VALUE_TYPE_SQL = r"""CASE WHEN starts_with(s, '{{KEY:') THEN 'key_marker' WHEN s = chr(27) THEN 'key_esc' WHEN regexp_matches(s, '(?i)^F\d{{1,2}}$') THEN 'key_function' WHEN starts_with(s, chr(27) || '[') THEN 'key_sequence'
           WHEN regexp_matches(s, '^[SsNn]$') THEN 'confirm' WHEN regexp_matches(s, '^\d{{1,2}}$') THEN 'menu_option' WHEN regexp_matches(s, '{CPF}') THEN 'cpf' WHEN regexp_matches(s, '{CNPJ}') THEN 'cnpj'
           WHEN regexp_matches(s, '{PHONE}') THEN 'phone' WHEN regexp_matches(s, '{POST}') THEN 'cep' WHEN regexp_matches(s, '{ISO}') OR regexp_matches(s, '^\d{{2}}/\d{{2}}/\d{{4}}$') THEN 'date'
           WHEN contains(s, '@') AND contains(string_split(s, '@')[-1], '.') THEN 'email' WHEN regexp_matches(s, '{NUM}') THEN 'number' WHEN length(s) > 30 THEN 'text_long' ELSE 'text' END""".format(**_SHAPES)
COMMAND_SQL = r"""starts_with(s, '{KEY:') OR regexp_matches(s, '(?i)^F\d{1,2}$') OR starts_with(s, chr(27))"""


@query(
    "fn13_value_types",
    t.with_tables(_VALUES)
    + r"""SELECT o_orderkey, CASE WHEN regexp_matches(s, '{CPF}') THEN '{{{{cliente.cpf}}}}' WHEN regexp_matches(s, '{CNPJ}') THEN '{{{{cliente.cnpj}}}}' WHEN regexp_matches(s, '{PHONE}') THEN '{{{{cliente.telefone}}}}'
           WHEN regexp_matches(s, '{POST}') THEN '{{{{cliente.cep}}}}' WHEN regexp_matches(s, '{ISO}') THEN '{{{{data}}}}' WHEN regexp_matches(s, '{NUM}') THEN '{{{{valor}}}}'
           WHEN contains(s, '@') AND contains(s, '.') THEN '{{{{cliente.email}}}}' ELSE '{{{{texto}}}}' END AS placeholder,
         {VALUE_TYPE} AS value_type,
         {COMMAND} AS is_command
       FROM (SELECT *, trim(v) AS s FROM vals)""".format(VALUE_TYPE=VALUE_TYPE_SQL, COMMAND=COMMAND_SQL, **_SHAPES),
)
def value_types(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select(
        "o_orderkey", naming.placeholder_for(v).alias("placeholder"), naming.value_type(v).alias("value_type"),
        naming.is_key_command(v).alias("is_command"),
    )


@query(
    "fn13_document_words",
    """SELECT CASE WHEN regexp_matches(w, '^[SsNn]$') THEN 'confirm' WHEN regexp_matches(w, '(?i)^F[0-9]{1,2}$') THEN 'key_function' WHEN regexp_matches(w, '^[0-9]{1,2}$') THEN 'menu_option'
         WHEN regexp_matches(w, '{CPF}') THEN 'cpf' WHEN regexp_matches(w, '{CNPJ}') THEN 'cnpj' WHEN regexp_matches(w, '{PHONE}') THEN 'phone' WHEN regexp_matches(w, '{POST}') THEN 'cep'
         WHEN regexp_matches(w, '{ISO}') OR regexp_matches(w, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN 'date' WHEN contains(w, '@') AND contains(string_split(w, '@')[-1], '.') THEN 'email'
         WHEN regexp_matches(w, '{NUM}') THEN 'number' WHEN length(w) > 30 THEN 'text_long' ELSE 'text' END AS value_type, count(*) AS words
       FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1"""
    .replace("{CPF}", naming.CPF).replace("{CNPJ}", naming.CNPJ).replace("{PHONE}", naming.PHONE)
    .replace("{POST}", naming.POSTCODE).replace("{ISO}", naming.ISO_DATE).replace("{NUM}", naming.NUMBER),
)
def document_words(spark, sf):
    words = t.read(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w")).where(F.col("w") != "")
    return words.groupBy(naming.value_type(F.col("w")).alias("value_type")).agg(F.count(F.lit(1)).alias("words"))


_FIELD_WORDS = (
    "CPF_TITULAR", "cnpj", "NUM_TELEFONE", "email", "cep_entrega", "dt_nasc", "NOME", "RAZAO_SOCIAL", "endereco", "VALOR", "QTD", "PERCENTUAL",
    "TOTAL", "OBS", "CARGO", "DESCRICAO", "SENHA", "x1", "CODIGO_ITEM", "UF",
)
_FIELDS = (
    "fld AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN n || '_' || string_split(p_name, ' ')[2] ELSE n END AS name, "
    "['text', 'number', 'cpf', 'integer'][p_partkey % 4 + 1] AS kind FROM (SELECT *, ["
    + ", ".join(f"'{w}'" for w in _FIELD_WORDS)
    + f"][p_partkey % {len(_FIELD_WORDS)} + 1] AS n FROM part))"
)


def _fields(spark, sf):
    key = F.col("p_partkey")
    word = F.get(F.array(*[F.lit(w) for w in _FIELD_WORDS]), (key % len(_FIELD_WORDS)).cast("int"))
    kind = F.get(F.array(*[F.lit(w) for w in ("text", "number", "cpf", "integer")]), (key % 4).cast("int"))
    second = F.get(F.split("p_name", " "), F.lit(1))
    return t.read(spark, sf, "part").select(
        "p_partkey", F.when(key % 3 == 0, F.concat(word, F.lit("_"), second)).otherwise(word).alias("name"), kind.alias("kind")
    )


def _meaning_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(p)}') THEN '{m}'" for p, m in naming.NAME_MEANINGS)
    return f"CASE {cases} ELSE 'text' END"


def _format_sql() -> str:
    cases = " ".join(f"WHEN upper(name) IN ({', '.join(repr(n) for n in ns)}) THEN '{f}'" for ns, f in naming.NAME_FORMATS)
    return f"CASE {cases} WHEN kind = 'cpf' THEN 'cpf' WHEN kind = 'number' THEN 'decimal' WHEN kind = 'text' THEN 'person_name' ELSE 'text' END"


def _hint_sql() -> str:
    cases = " ".join(
        f"WHEN contains(upper(name), '{h}')" + (" AND NOT contains(upper(name), 'CARGO')" if h == "RG" else "") + f" THEN '{k}'"
        for h, k in naming.TYPE_HINTS
    )
    return f"CASE WHEN kind <> 'text' THEN kind {cases} ELSE kind END"


@query(
    "fn14_field_meaning",
    t.with_tables(_FIELDS)
    + f"""SELECT p_partkey, name, {_meaning_sql()} AS meaning, {_format_sql()} AS format, {_hint_sql()} AS datatype,
          CASE WHEN upper(name) IN ('VALOR') THEN 1.0::DOUBLE WHEN upper(name) = 'QTD' THEN 1.0::DOUBLE WHEN upper(name) IN ('PERCENTUAL', 'TOTAL') THEN 0.0::DOUBLE END AS min_value,
          CASE WHEN contains(upper(name), 'CPF') THEN 11 WHEN contains(upper(name), 'CNPJ') THEN 14 WHEN contains(upper(name), 'CEP') THEN 8 END AS exact_length FROM fld""",
)
def field_meaning(spark, sf):
    name = F.col("name")
    low, _ = naming.field_range(name)
    _, length = naming.name_constraints(name)
    return _fields(spark, sf).select(
        "p_partkey", "name", naming.field_meaning(name).alias("meaning"), naming.field_format(name, F.col("kind")).alias("format"),
        naming.hinted_datatype(name, F.col("kind")).alias("datatype"), low.alias("min_value"), length.alias("exact_length"),
    )


@query(
    "fn15_rendered_templates",
    """SELECT o_orderkey, 'Pedido ' || o_orderkey || ' de ' || c_name || ' {{outro.x}} ' || c_mktsegment || ' {{c.nada}}' || c_custkey AS text, 'c,cliente,o,outro,pedido' AS entities
       FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def rendered_templates(spark, sf):
    template = F.lit("Pedido {{pedido.Numero}} de {{Cliente.NOME}} {{outro.x}} {{o.segmento}} {{c.nada}}{{c.CODIGO}}")
    rows = t.read(spark, sf, "orders").join(t.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    values = F.create_map(
        F.lit("PEDIDO.NUMERO"), F.col("o_orderkey").cast("string"), F.lit("CLIENTE.NOME"), F.col("c_name"),
        F.lit("SEGMENTO"), F.col("c_mktsegment"), F.lit("CODIGO"), F.col("c_custkey").cast("string"),
    )
    names = F.array_sort(F.array_distinct(F.transform(tx.template_entities(template), lambda x: F.lower(x))))
    return rows.select(
        "o_orderkey", tx.render_template(template, values).alias("text"), F.array_join(names, ",").alias("entities")
    )


_PROGRAMS = """
prg AS (SELECT page_id, ['cad', 'fat', 'est', 'nf', 'zz', 'crm', 'voip', '9', 'aa', 'ctb'][page_id % 10 + 1] || CASE WHEN page_id % 6 = 5 THEN '' ELSE lpad(CAST(page_id % 120 AS VARCHAR), 2, '0') END
   || '.prg' AS name, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)"""


def _module_sql(key: str, names: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(
    "fn22_program_modules",
    t.with_tables(_PROGRAMS)
    + f"""SELECT page_id, name, CASE WHEN regexp_extract(name, '^([a-z]{{2,4}})', 1) <> '' THEN regexp_extract(name, '^([a-z]{{2,4}})', 1) ELSE regexp_replace(name, '[.]prg$', '')[1:3] END AS module,
          coalesce({_module_sql('upper(name)[1:3]', {**naming.MODULES, **naming.MENU_MODULES})}, 'Modulo ' || upper(name)[1:3]) AS label,
          CASE WHEN concat_ws(' — ', m, kind) = '' THEN 'Programa ' || up ELSE concat_ws(' — ', m, kind) END AS purpose
        FROM (SELECT *, coalesce({_module_sql('up[1:3]', {**naming.MODULES, 'AA': 'Sistema (core)', 'BB': 'Sistema (infra)'})}, {_module_sql('up[1:2]', {**naming.MODULES, 'AA': 'Sistema (core)', 'BB': 'Sistema (infra)'})}) AS m,
            CASE WHEN num <> '' THEN coalesce({_module_sql('num[1:2]', naming.PROGRAM_KINDS)}, 'Operacao ' || num) END AS kind
          FROM (SELECT *, upper(replace(name, '.prg', '')) AS up, regexp_extract(upper(replace(name, '.prg', '')), '(\\d{{2,}})[a-zA-Z]*$', 1) AS num FROM prg))""",
)
def program_modules(spark, sf):
    key = F.col("page_id")
    prefix = F.get(F.array(*[F.lit(p) for p in ("cad", "fat", "est", "nf", "zz", "crm", "voip", "9", "aa", "ctb")]), (key % 10).cast("int"))
    number = F.when(key % 6 == 5, "").otherwise(F.when(key % 120 < 100, F.lpad((key % 120).cast("string"), 2, "0")).otherwise((key % 120).cast("string").substr(1, 2)))
    name = F.concat(prefix, number, F.lit(".prg"))
    return t.read(spark, sf, "pages").select("page_id", name.alias("name")).select(
        "page_id", "name", naming.module_prefix(F.col("name")).alias("module"),
        naming.module_label(F.substring(F.upper("name"), 1, 3)).alias("label"),
        naming.program_purpose(F.col("name")).alias("purpose"),
    )


@query(
    "prj14_valid_names",
    r"""SELECT w AS name, count(*) AS uses FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents)
        WHERE regexp_full_match(w, '[A-Za-z][A-Za-z0-9_]{2,31}') AND NOT regexp_matches(lower(w), '^(tmp_|var_|arg_|param_)') GROUP BY 1""",
)
def valid_names(spark, sf):
    words = t.read(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]")).alias("name"))
    return words.where(naming.valid_entity_name(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))


# ------------------------------------------------------------ comparisons

_SIGS = """
sg AS (SELECT seq_global, session_id, CASE WHEN k % 5 <> 0 THEN 'v' || k END AS ev, CASE WHEN k % 7 <> 0 THEN 'v' || (k - k % 11 // 10) END AS ov, CASE WHEN k % 3 <> 0 THEN 't' || k END AS et, 't' || k AS ot,
    CASE WHEN k % 2 = 0 THEN 's' || k END AS es, CASE WHEN k % 4 = 0 THEN 's' || (k + 1) END AS os, 'l' || (k % 10) AS el, 'l' || (k % 20) AS ol,
    CASE k % 6 WHEN 0 THEN 'visual' WHEN 1 THEN 'text' WHEN 2 THEN 'semantic' WHEN 3 THEN 'hybrid' WHEN 4 THEN 'text' ELSE 'visual' END AS mode FROM ae),
sgc AS (SELECT *, CASE WHEN mode IN ('visual', 'hybrid') AND ev IS NOT NULL AND ov IS NOT NULL THEN 'visual' WHEN mode IN ('text', 'hybrid') AND et IS NOT NULL THEN 'text'
    WHEN mode IN ('semantic', 'hybrid') AND es IS NOT NULL AND os IS NOT NULL THEN 'semantic' WHEN mode = 'hybrid' THEN 'legacy_screen_sig' END AS used FROM sg)"""


@query(
    "fn09_signature_modes",
    t.with_tables(t.AUDIT_SQL, _SIGS)
    + """SELECT seq_global, mode AS comparison_mode_requested, used AS comparison_mode_used,
          coalesce(CASE used WHEN 'visual' THEN ev = ov WHEN 'text' THEN et = ot WHEN 'semantic' THEN es = os WHEN 'legacy_screen_sig' THEN el = ol END, FALSE) AS matched,
          CASE WHEN used IS NULL THEN mode || '_signature_missing' END AS fallback_reason FROM sgc""",
)
def signature_modes(spark, sf):
    k = F.col("k")

    def named(prefix, value=k):
        return F.concat(F.lit(prefix), value.cast("string"))

    pairs = t.audit_events(spark, sf).select(
        "seq_global", "k",
        F.when(k % 5 != 0, named("v")).alias("expected_visual_sig"),
        F.when(k % 7 != 0, named("v", k - F.floor(k % 11 / 10))).alias("observed_visual_sig"),
        F.when(k % 3 != 0, named("t")).alias("expected_text_sig"), named("t").alias("observed_text_sig"),
        F.when(k % 2 == 0, named("s")).alias("expected_semantic_sig"),
        F.when(k % 4 == 0, named("s", k + 1)).alias("observed_semantic_sig"),
        named("l", k % 10).alias("expected_legacy_screen_sig"), named("l", k % 20).alias("observed_legacy_screen_sig"),
    )
    event = F.when(k % 6 == 0, "VISUAL").when(k % 6 == 3, " hybrid ").when(k % 6 == 4, "bogus")
    session = F.when(k % 6 == 1, "text").when(k % 6 == 4, "text").when(k % 6 == 3, "text")
    replay = F.when(k % 6 == 2, "semantic")
    out = screens.compare_signatures(pairs, screens.comparison_mode(event, session, replay))
    return out.select("seq_global", "comparison_mode_requested", "comparison_mode_used", "matched", "fallback_reason")


_OBSERVED = """
exp AS (SELECT session_id, seq_global, event_id, sig AS e FROM ae WHERE type = 'checkpoint'),
obs AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '' WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'MENU principal' ELSE e || 'x' END ELSE e END AS o FROM exp)"""


def _observed(events):
    e = F.col("event_id")
    seen = (
        F.when(e % 29 == 0, "")
        .when(e % 11 == 0, F.when(e % 2 == 0, "MENU principal").otherwise(F.concat("sig", F.lit("x"))))
        .otherwise(F.col("sig"))
    )
    return events.where(e % 97 != 0).select("session_id", "seq_global", seen.alias("sig"))


@query(
    "jn05_checkpoint_failures",
    t.with_tables(t.AUDIT_SQL, _OBSERVED)
    + """SELECT session_id, seq_global, CASE WHEN coalesce(o, '') = '' THEN 'timeout' WHEN contains(lower(o), 'menu') THEN 'navigation_error' ELSE 'screen_divergence' END AS failure_type,
          CASE WHEN coalesce(o, '') = '' THEN 'critical' ELSE 'high' END AS severity, e AS expected_value, coalesce(o, '') AS observed_value,
          CASE WHEN coalesce(o, '') = '' THEN 'checkpoint sem resposta observável dentro da janela' WHEN contains(lower(o), 'menu') THEN 'sessão caiu em navegação diferente da esperada'
            ELSE 'saída divergiu da tela esperada' END AS message FROM obs WHERE o IS NULL OR o <> e""",
)
def checkpoint_failures(spark, sf):
    events = t.audit_events(spark, sf).where(F.col("type") == "checkpoint")
    return screens.checkpoint_failures(events.select("session_id", "seq_global", "sig"), _observed(events))


@query(
    "fn10_checkpoint_match",
    t.with_tables(t.AUDIT_SQL, _OBSERVED)
    + """SELECT seq_global, e = trim(coalesce(o, '')) AS strict, contains(trim(coalesce(o, '')), e) AS contains, regexp_matches(coalesce(o, ''), e || '?') AS regex,
          lower(e) = lower(trim(coalesce(o, ''))) AS strict_ci FROM obs""",
)
def checkpoint_match(spark, sf):
    events = t.audit_events(spark, sf).where(F.col("type") == "checkpoint")
    pairs = events.select("session_id", "seq_global", F.col("sig").alias("e")).join(
        _observed(events).withColumnRenamed("sig", "o"), ["session_id", "seq_global"], "left"
    )
    want, got = F.col("e"), F.col("o")
    return pairs.select(
        "seq_global", screens.checkpoint_match(want, got).alias("strict"),
        screens.checkpoint_match(want, got, "contains").alias("contains"),
        screens.checkpoint_match(F.concat(want, F.lit("?")), got, "regex").alias("regex"),
        screens.checkpoint_match(want, got, ignore_case=True).alias("strict_ci"),
    )


@query(
    "fn11_failure_classes",
    t.with_tables(t.AUDIT_SQL, _OBSERVED)
    + """SELECT seq_global, CASE WHEN event_id % 3 = 0 AND coalesce(o, '') = '' THEN 'timeout' WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 5 = 0 THEN 'concurrency_error'
          WHEN contains(lower(coalesce(o, '')), 'menu') THEN 'navigation_error' ELSE 'screen_divergence' END AS failure_type,
          CASE WHEN event_id % 3 = 0 AND coalesce(o, '') = '' THEN 'critical' ELSE 'high' END AS severity FROM obs WHERE o IS NULL OR o <> e""",
)
def failure_classes(spark, sf):
    events = t.audit_events(spark, sf).where(F.col("type") == "checkpoint")
    pairs = events.select("session_id", "seq_global", "event_id", F.col("sig").alias("e")).join(
        _observed(events).withColumnRenamed("sig", "o"), ["session_id", "seq_global"], "left"
    )
    bad = pairs.where(F.col("o").isNull() | (F.col("o") != F.col("e")))
    kind, severity, _ = screens.classify_failure(
        F.col("e"), F.col("o"), F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    )
    return bad.select("seq_global", kind.alias("failure_type"), severity.alias("severity"))


def _turn_pairs(spark, sf):
    """User and assistant texts of a conversation paired by their order."""
    c = t.read(spark, sf, "conversations")
    numbered = ordered.scan(c, ["conv_id", "role"], ["turn"], step_order=ordered.row_number())
    golden = numbered.where(F.col("role") == "user").select(F.col("conv_id").alias("journey_id"), "step_order", "text")
    answers = numbered.where(F.col("role") == "assistant").select(F.col("conv_id").alias("journey_id"), "step_order", "text")
    mixed = answers.join(golden.withColumnRenamed("text", "golden"), ["journey_id", "step_order"], "left").select(
        "journey_id", "step_order",
        F.when((F.col("journey_id") + F.col("step_order")) % 2 == 0, F.coalesce("golden", "text")).otherwise(F.col("text")).alias("text"),
    )
    return golden.where(F.col("journey_id") % 9 != 0), mixed


_PAIRS = """
num AS (SELECT conv_id AS journey_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS step_order FROM conversations),
pr AS (SELECT a.journey_id, a.step_order, CASE WHEN (a.journey_id + a.step_order) % 2 = 0 THEN coalesce(u.text, a.text) ELSE a.text END AS text,
   CASE WHEN a.journey_id % 9 <> 0 THEN u.text END AS golden
 FROM num a LEFT JOIN num u ON u.role = 'user' AND u.journey_id = a.journey_id AND u.step_order = a.step_order WHERE a.role = 'assistant')"""


@query(
    "jn14_golden_screens",
    t.with_tables(_PAIRS)
    + """SELECT journey_id, step_order, coalesce(sha256(golden), '') AS expected_hash, sha256(text) AS observed_hash, coalesce(golden = text, FALSE) AS matches,
          CASE WHEN golden IS NULL THEN 'new' WHEN golden = text THEN 'match' ELSE 'diverged' END AS state FROM pr""",
)
def golden_screens(spark, sf):
    golden, seen = _turn_pairs(spark, sf)
    return screens.compare_baseline(golden, seen).drop("similarity")


@query("fn08_screen_similarity")
def screen_similarity(spark, sf):
    golden, seen = _turn_pairs(spark, sf)
    return screens.compare_baseline(golden, seen).select("journey_id", "step_order", "state", "similarity")


@query(
    "agg18_baseline_regressions",
    t.with_tables(_PAIRS)
    + """SELECT journey_id, count(*) AS total_screens, count(*) FILTER (golden = text) AS matched, count(*) - count(*) FILTER (golden = text) AS diverged,
          count(*) - count(*) FILTER (golden = text) > 0 AS is_regression FROM pr GROUP BY 1""",
)
def baseline_regressions(spark, sf):
    golden, seen = _turn_pairs(spark, sf)
    return screens.baseline_summary(screens.compare_baseline(golden, seen).drop("similarity"))


@query("fn18_line_differences")
def line_differences(spark, sf):
    golden, seen = _turn_pairs(spark, sf)
    pairs = golden.withColumnRenamed("text", "expected").join(
        seen.withColumnRenamed("text", "observed"), ["journey_id", "step_order"]
    )
    return screens.line_differences(pairs, ["journey_id", "step_order"])


# ------------------------------------------------------------ cells

WIDTH = 40

_CELLS = f"""
sz AS (SELECT conv_id AS session_id, turn AS seq, text, CAST(ceil(length(text) / {WIDTH}.0) AS BIGINT) AS rows FROM conversations WHERE text <> ''),
cells AS (SELECT session_id, seq, rows, i, i // {WIDTH} AS r, i % {WIDTH} AS c, CASE WHEN i < length(text) THEN replace(text[i + 1], chr(10), ' ') ELSE ' ' END AS ch,
   CASE WHEN (i + seq) % 7 = 0 THEN 'red' ELSE 'default' END AS fg, i % 5 = 0 AS bold, (i + session_id) % 11 = 0 AS reverse
 FROM (SELECT *, unnest(range(0, rows * {WIDTH})) AS i FROM sz))"""


def _turns(spark, sf):
    """Every turn of a conversation as a screen of 40 columns, the cursor behind its text."""
    c = t.spread(t.read(spark, sf, "conversations").where(F.col("text") != ""), "conv_id", "turn")
    rows = F.ceil(F.length("text") / WIDTH).cast("int")
    behind = F.length("text") % (rows * WIDTH)
    return c.select(
        F.col("conv_id").cast("long").alias("session_id"), F.col("turn").alias("seq"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), rows.alias("rows"), F.lit(WIDTH).alias("cols"),
        F.floor(behind / WIDTH).cast("int").alias("cursor_row"), (behind % WIDTH).cast("int").alias("cursor_col"),
    )


def _cells(spark, sf):
    return _cells_of(_turns(spark, sf))


def _cells_of(sized):
    padded = F.split(F.rpad("text", F.col("rows") * WIDTH, F.lit(" ")), "")
    flat = sized.select("session_id", "seq", "rows", "cols", F.posexplode(padded).alias("i", "ch"))
    off = F.lit(False)
    return flat.select(
        "session_id", "seq", "rows", "cols", F.floor(F.col("i") / WIDTH).cast("int").alias("row"),
        (F.col("i") % WIDTH).alias("col"), "ch",
        F.when((F.col("i") + F.col("seq")) % 7 == 0, "red").otherwise("default").alias("fg"), F.lit("default").alias("bg"),
        (F.col("i") % 5 == 0).alias("bold"), off.alias("dim"), off.alias("underline"), off.alias("blink"),
        ((F.col("i") + F.col("session_id")) % 11 == 0).alias("reverse"), off.alias("hidden"),
    )


@query(
    "fn04_screen_signatures",
    t.with_tables(_CELLS)
    + f"""SELECT session_id, seq, 'sha256:' || sha256('SCREEN-TEXT' || chr(10) || '1' || chr(10) || any_value(rows) || chr(10) || '{WIDTH}' || chr(10) || 'utf-8' || chr(10) || 'xterm' || chr(10)
            || string_agg(CAST(ord(ch) AS VARCHAR), chr(10) ORDER BY i) || chr(10)) AS text_sig,
          'sha256:' || sha256('SCREEN-VISUAL' || chr(10) || '1' || chr(10) || any_value(rows) || chr(10) || '{WIDTH}' || chr(10) || 'utf-8' || chr(10) || 'xterm' || chr(10)
            || string_agg(ord(ch) || '|' || fg || '|default|' || (CASE WHEN bold THEN 1 ELSE 0 END + CASE WHEN reverse THEN 16 ELSE 0 END), chr(10) ORDER BY i) || chr(10)) AS visual_sig
        FROM cells GROUP BY 1, 2""",
)
def screen_signatures(spark, sf):
    return screens.screen_signatures(_cells(spark, sf), ["session_id", "seq"]).drop("semantic_sig")


_FRAMES = f"""
fr AS (SELECT conv_id AS session_id, turn AS seq, CAST(ceil(length(text) / {WIDTH}.0) AS BIGINT) AS rows, length(text) % (CAST(ceil(length(text) / {WIDTH}.0) AS BIGINT) * {WIDTH}) AS p FROM conversations WHERE text <> ''),
fs AS (SELECT *, p // {WIDTH} AS cr, p % {WIDTH} AS cc FROM fr)"""
_DIFF = """
sq AS (SELECT session_id, seq, rows, cr, cc, lag(seq) OVER w AS base_seq, lag(rows) OVER w AS was_rows, lag(cr) OVER w AS was_cr, lag(cc) OVER w AS was_cc FROM fs WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
new AS (SELECT n.*, sq.base_seq FROM cells n JOIN sq ON sq.session_id = n.session_id AND sq.seq = n.seq AND sq.base_seq IS NOT NULL),
old AS (SELECT o.*, sq.seq AS new_seq FROM cells o JOIN sq ON sq.session_id = o.session_id AND sq.base_seq = o.seq),
diff AS (SELECT coalesce(n.session_id, o.session_id) AS session_id, coalesce(n.base_seq, o.seq) AS base_seq, coalesce(n.seq, o.new_seq) AS seq, coalesce(n.r, o.r) * 1000 + coalesce(n.c, o.c) AS place,
     CASE WHEN o.i IS NULL THEN 'added' WHEN n.i IS NULL THEN 'removed' ELSE 'changed' END AS change
   FROM new n FULL JOIN old o ON o.session_id = n.session_id AND o.seq = n.base_seq AND o.new_seq = n.seq AND o.i = n.i
   WHERE o.i IS NULL OR n.i IS NULL OR o.ch <> n.ch OR o.fg <> n.fg OR o.bold <> n.bold OR o.reverse <> n.reverse
   UNION ALL SELECT session_id, base_seq, seq, rows * 1000 + 40, 'geometry' FROM sq WHERE rows <> was_rows
   UNION ALL SELECT session_id, base_seq, seq, cr * 1000 + cc, 'cursor' FROM sq WHERE cr <> was_cr OR cc <> was_cc)"""


@query(
    "win14_cell_changes",
    t.with_tables(_CELLS, _FRAMES, _DIFF)
    + "SELECT session_id, base_seq, seq, change, count(*) AS cells, CAST(sum(place) AS BIGINT) AS places FROM diff GROUP BY 1, 2, 3, 4",
)
def cell_changes(spark, sf):
    """Changes of geometry, cursor and cells between screens that grow and shrink."""
    found = screens.screen_changes(_turns(spark, sf).drop("text"), _cells(spark, sf))
    place = F.when(F.col("change") == "geometry", F.col("rows") * 1000 + F.col("cols")).otherwise(F.col("row") * 1000 + F.col("col"))
    return found.groupBy("session_id", "base_seq", "seq", "change").agg(F.count(F.lit(1)).alias("cells"), F.sum(place).alias("places"))


@query(
    "win15_rebuilt_screens",
    t.with_tables(_FRAMES)
    + """SELECT session_id, seq, rows, cr AS cursor_row, cc AS cursor_col, (session_id + seq) % 6 <> 0 AS verified, CASE (session_id + seq) % 12 WHEN 0 THEN 'text' WHEN 6 THEN 'visual' END AS rejected FROM fs""",
)
def rebuilt_screens(spark, sf):
    """Every screen rebuilt from the first one and the patches; forged signatures are rejected."""
    texts = _turns(spark, sf)
    turns, cells = texts.drop("text"), settle(screens.pack_screens(_cells_of(texts), ["session_id", "seq"]))
    starts = turns.groupBy("session_id").agg(F.min("seq").alias("seq"))
    first, first_cells = turns.join(starts, ["session_id", "seq"]), cells.join(starts, ["session_id", "seq"])
    rebuilt = screens.rebuild_screens(first, first_cells, screens.screen_changes(turns, cells, packed=True), turns, packed=True)
    forged = (F.col("session_id") + F.col("seq")) % 12
    recorded = screens.screen_signatures(cells, ["session_id", "seq"]).withColumns({
        "text_sig": F.when(forged == 0, "sha256:forged").otherwise(F.col("text_sig")), "visual_sig": F.when(forged == 6, "sha256:forged").otherwise(F.col("visual_sig"))
    })
    verdicts = screens.verify_screens(rebuilt, recorded, ("rows", "cursor_row", "cursor_col"))
    return verdicts.where(F.col("rejected").isNull() | (F.col("rejected") != "missing"))


# ------------------------------------------------------------ terminal sessions


@query(
    "prj13_terminal_geometry",
    t.with_tables(t.AUDIT_SQL)
    + """SELECT session_id, coalesce(CASE WHEN sr THEN 30 + u % 10 END, rr, 25) AS rows, coalesce(CASE WHEN sr THEN 100 END, rc, 80) AS cols,
          CASE WHEN sr THEN 'session_metadata' WHEN rr IS NOT NULL THEN 'resize_event' ELSE 'legacy_fallback' END AS geometry_source
        FROM (SELECT session_id, CAST(substr(session_id, 2) AS BIGINT) AS u, coalesce(arg_min(user_id % 3 = 0, seq_global) FILTER (type = 'session_start'), FALSE) AS sr,
            arg_max(20 + k % 50, seq_global) FILTER (dir = 'out' AND k % 4 = 0) AS rr, arg_max(80 + k, seq_global) FILTER (dir = 'out' AND k % 4 = 0) AS rc FROM ae GROUP BY 1)""",
)
def terminal_geometry(spark, sf):
    k = F.col("k")
    resize = F.concat(
        F.lit("ok\x1b[8;999;10t\x1b[8;"), (20 + k % 50).cast("string"), F.lit(";"), (80 + k).cast("string"), F.lit("t.")
    )
    start = F.col("type") == "session_start"
    ev = t.audit_events(spark, sf).select(
        "session_id", "seq_global", "type", "dir",
        F.when((F.col("dir") == "out") & (k % 4 == 0), F.base64(resize.cast("binary"))).otherwise(F.col("data_b64")).alias("data_b64"),
        F.when(start & (F.col("user_id") % 3 == 0), 30 + F.col("user_id") % 10).otherwise(F.when(start, 0)).alias("rows"),
        F.when(start, 100).alias("cols"), F.lit("CP850").alias("encoding"),
    )
    return screens.terminal_geometry(ev).select("session_id", "rows", "cols", "geometry_source")


@query(
    "prj15_decoded_output",
    t.with_tables(t.AUDIT_SQL)
    + """, b AS (SELECT session_id, seq_global, k, user_id, row_number() OVER (PARTITION BY session_id ORDER BY seq_global) AS pos,
             lag(k) OVER (PARTITION BY session_id ORDER BY seq_global) AS pk FROM ae WHERE dir = 'out')
         SELECT session_id, seq_global, CASE WHEN user_id % 3 = 0 THEN CASE WHEN pk IS NOT NULL THEN 'é' ELSE '' END || 'x' || k
           WHEN user_id % 3 = 1 THEN 'é' || k WHEN user_id % 3 = 2 THEN 'é' || k END AS text FROM b WHERE user_id % 3 <> 0 OR pos > 1""",
)
def decoded_output(spark, sf):
    k = F.col("k").cast("string").cast("binary")
    u = F.col("user_id") % 3
    outs = t.audit_events(spark, sf).where(F.col("dir") == "out")
    # utf-8: each event ends with the first byte of é and the next begins with the second
    utf = F.concat(F.unhex(F.lit("A9")), F.lit("x").cast("binary"), k, F.unhex(F.lit("C3")))
    raw = F.when(u == 0, utf).when(u == 1, F.concat(F.unhex(F.lit("82")), k)).otherwise(F.concat(F.unhex(F.lit("E9")), k))
    charset = F.when(u == 0, "utf8").when(u == 1, "CP850").otherwise("latin1")
    ev = outs.select("session_id", "dir", "seq_global", F.base64(raw).alias("data_b64"), tx.normalize_charset(charset).alias("charset"))
    text = screens.decoded_output(ev, F.col("charset"))
    # the first utf-8 event starts with half a character, which decodes to the replacement sign
    return text.where(~text["text"].startswith("�")).select("session_id", "seq_global", "text")


@query("win03_checkpoint_placement")
def checkpoint_placement(spark, sf):
    k = F.col("k")
    outs = t.audit_events(spark, sf).where((F.col("type") == "bytes")).select(
        "session_id", "seq_global", "ts_ms", (k % 50 == 0).alias("reset"), (k % 77 == 0).alias("resize"), (k % 31 == 0).alias("clear")
    )
    return screens.place_checkpoints(outs)
