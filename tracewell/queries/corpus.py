"""Queries over program sources, catalogs and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import corpus, graph, sessions
from tracewell.plans import ordered
from tracewell.queries import tables as t
from tracewell.queries.registry import query

# ---------------------------------------------------------------- program lines from line items

_BASE = """
base AS (SELECT 'p' || l_orderkey || '.prg' AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no,
   l_linenumber AS ln, 'T' || (l_suppkey % 20) AS tab, 'F' || (l_partkey % 9) AS fld, 'T' || (l_partkey % 20) AS oth, l_orderkey FROM lineitem)"""


def _base(spark, sf):
    li = t.read(spark, sf, "lineitem")
    numbered = ordered.scan(
        li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], line_no=ordered.row_number()
    )
    name = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    return numbered.select(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit(".prg")).alias("file"), "line_no",
        F.col("l_linenumber").alias("ln"), name("T", "l_suppkey", 20).alias("tab"), name("F", "l_partkey", 9).alias("fld"),
        name("T", "l_partkey", 20).alias("oth"), "l_orderkey",
    )


def _by_line(*forms):
    """One text per line number 1..7."""
    out = forms[-1]
    for i, form in reversed(list(enumerate(forms[:-1], start=1))):
        out = F.when(F.col("ln") == i, form).otherwise(out)
    return out


def _text(*parts):
    return F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])


def _sql_lines(spark, sf):
    return _base(spark, sf).withColumn(
        "line",
        _by_line(
            _text("  INSERT INTO app.", "$tab", " (", "$fld", ", QTD, 'x') VALUES (1, 2, 3)"),
            _text("update ", "$tab", " set ", "$fld", " = 1, QTD = QTD + 1 WHERE ID = 3"),
            _text("SELECT A.", "$fld", ", SUM(V) AS TOTAL, B.NOME FROM ", "$tab", " A JOIN app.", "$oth", " B ON 1 = 1"),
            _text("DELETE FROM ", "$tab", " WHERE ", "$fld", " = 1"),
            _text("DECLARE c1 CURSOR FOR SELECT * FROM ", "$tab"),
            _text("SQLEXEC(h, [SELECT CODIGO FROM ", "$tab", "])"),
            _text("* comment about ", "$tab"),
        ),
    )


@query(
    "ext01_sql_statements",
    t.with_tables(_BASE)
    + """SELECT file, line_no, CASE ln WHEN 1 THEN 'insert' WHEN 2 THEN 'update' WHEN 4 THEN 'delete' ELSE 'select' END AS operation, tab AS entity,
         CASE ln WHEN 1 THEN fld || ',QTD,x' WHEN 2 THEN fld || ',QTD' WHEN 3 THEN fld || ',TOTAL,NOME' WHEN 6 THEN 'CODIGO' ELSE '' END AS fields FROM base WHERE ln < 7
       UNION ALL SELECT file, line_no, 'select', tab, CASE ln WHEN 6 THEN 'CODIGO' ELSE '' END FROM base WHERE ln IN (5, 6)""",
)
def sql_statements(spark, sf):
    return corpus.sql_operations(_sql_lines(spark, sf)).withColumn("fields", F.array_join("fields", ","))


@query(
    "ext01_joined_tables",
    t.with_tables(_BASE) + "SELECT file, line_no, oth AS entity FROM base WHERE ln = 3",
)
def joined_tables(spark, sf):
    return corpus.joined_tables(_sql_lines(spark, sf))


@query(
    "ext02_table_definitions",
    """SELECT 't' || p_partkey || '.sql' AS file, 'tab_' || p_partkey AS entity, c.field, c.datatype, c.required, c.is_unique FROM part,
       (VALUES ('id', 'integer', TRUE, TRUE), ('name', 'text', FALSE, TRUE), ('price', 'decimal', TRUE, FALSE), ('made', 'datetime', FALSE, FALSE), ('flag', 'boolean', FALSE, FALSE),
        ('odd', 'text', FALSE, FALSE)) c(field, datatype, required, is_unique)""",
)
def table_definitions(spark, sf):
    key = F.col("p_partkey").cast("string")
    ddl = F.concat(
        F.lit("-- "), "p_name", F.lit("\nCREATE TABLE IF NOT EXISTS app.tab_"), key,
        F.lit(
            " (\n  id BIGINT NOT NULL,\n  name VARCHAR(20) UNIQUE,\n  price NUMERIC(10,2) NOT NULL DEFAULT 0,\n"
            "  made TIMESTAMP,\n  flag BIT,\n  odd GEOMETRY,\n  PRIMARY KEY (id)\n);\n"
        ),
    )
    files = t.read(spark, sf, "part").select(F.concat(F.lit("t"), key, F.lit(".sql")).alias("file"), ddl.alias("text"))
    return corpus.table_definitions(files).drop("place")


def _xbase_lines(spark, sf):
    return _base(spark, sf).withColumn(
        "line",
        _by_line(
            _text("use ", "$tab", " alias A1 shared"),
            _text("APPEND BLANK"),
            _text("REPLACE ", "$fld", " WITH 1, QTD WITH QTD + 1"),
            _text("SEEK cKey"),
            _text("LOCATE FOR ", "$fld", " = 'x' .AND. QTD > 3"),
            _text("IF DELETE"),
            _text("SELECT A1"),
        ),
    )


@query(
    "ext03_file_commands",
    t.with_tables(
        _BASE,
        """c AS (SELECT *, last_value(CASE WHEN ln = 1 THEN tab END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS entity FROM base)""",
        """o AS (SELECT *, row_number() OVER (PARTITION BY file, entity ORDER BY line_no) AS pos FROM c WHERE entity IS NOT NULL AND ln < 7)""",
        """r AS (SELECT *, coalesce(bool_or(ln = 2) OVER (PARTITION BY file, entity ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), FALSE) AS recent FROM o)""",
    )
    + """SELECT file, line_no, entity, CASE ln WHEN 1 THEN 'use' WHEN 2 THEN 'append' WHEN 3 THEN CASE WHEN recent THEN 'insert' ELSE 'update' END WHEN 4 THEN 'seek'
           WHEN 5 THEN 'locate' ELSE 'delete' END AS operation, CASE ln WHEN 3 THEN fld || ',QTD' WHEN 4 THEN 'cKey' WHEN 5 THEN fld || ',QTD' ELSE '' END AS fields FROM r""",
)
def file_commands(spark, sf):
    return corpus.file_operations(_xbase_lines(spark, sf)).withColumn("fields", F.array_join("fields", ","))


def _alias_lines(spark, sf):
    low = F.lower("tab")
    lines = _base(spark, sf).withColumn("low", F.concat(F.lit("cad"), low)).withColumn("olow", F.concat(F.lit("fat"), F.lower("oth")))
    return lines.withColumn(
        "line",
        _by_line(
            _text("CadAbre110(1)"),
            _text("use ", "$low", ".dbf in 0"),
            _text("x = ", "$low", "->nome + ", "$olow", "->valor"),
            _text('select("', "$olow", '")'),
            _text("set procedure to /prg/sncabre.dbo additive"),
            _text("do ", "$olow"),
            _text("* use ", "$low"),
        ),
    )


@query(
    "ext04_alias_scores",
    t.with_tables(
        _BASE,
        """ev AS (SELECT file, 'cad110' AS alias, 10 AS score FROM base WHERE ln = 1 UNION ALL SELECT file, 'cad' || lower(tab), 8 FROM base WHERE ln = 2
             UNION ALL SELECT file, 'cad' || lower(tab), 1 FROM base WHERE ln IN (2, 3) UNION ALL SELECT file, 'fat' || lower(oth), 1 FROM base WHERE ln = 3
             UNION ALL SELECT file, 'fat' || lower(oth), 3 FROM base WHERE ln = 4 UNION ALL SELECT file, 'sncabre', 1 FROM base WHERE ln = 5 UNION ALL SELECT file, 'prg', 3 FROM base WHERE ln = 5
             UNION ALL SELECT file, 'fat' || lower(oth), 2 FROM base WHERE ln = 6)""",
    )
    + """SELECT file, alias, CAST(sum(score) AS BIGINT) AS score, count(*) AS hits, least(sum(score) / 20.0, 1.0) AS confidence,
          CASE substr(alias, 1, 3) WHEN 'cad' THEN 'cadastros' WHEN 'fat' THEN 'faturamento' ELSE '' END AS module FROM ev WHERE alias <> '' GROUP BY 1, 2""",
)
def alias_scores(spark, sf):
    return corpus.score_aliases(corpus.alias_evidence(_alias_lines(spark, sf)))


@query("ext05_screen_fields")
def screen_fields(spark, sf):
    lines = _base(spark, sf).withColumn(
        "line",
        _by_line(
            _text('TITLE "Cadastro ', "$tab", '"'),
            _text('@ 3, 10 SAY "Nome:" GET cNome PICTURE "@!" VALID !EMPTY(cNome)'),
            _text('@ 4, 10 SAY "Codigo"'),
            _text("@ 4, 20 GET m.", "$fld", " PICTURE '999' WHEN lNovo"),
            _text("@ 5, 20 GET nValor"),
            _text("READ"),
            _text('@ 9, 1 SAY "1. Incluir"'),
        ),
    )
    return corpus.screen_fields(lines)


@query(
    "ext05_menu_options",
    t.with_tables(_BASE) + "SELECT file, line_no, CAST(line_no % 10 AS INTEGER) AS option, 'Opcao ' || tab AS label FROM base WHERE ln = 7",
)
def menu_options(spark, sf):
    digit = (F.col("line_no") % 10).cast("string")
    lines = _base(spark, sf).withColumn(
        "line",
        F.when(F.col("ln") == 7, F.concat(F.lit('@ 9, 1 SAY "'), digit, F.lit(" - Opcao "), "tab", F.lit(' "'))).otherwise('@ 1, 1 SAY "Titulo"'),
    )
    return corpus.menu_options(lines)


@query(
    "win16_block_spans",
    t.with_tables(
        _BASE,
        """st AS (SELECT *, last_value(CASE WHEN ln = 1 THEN line_no END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS s,
             last_value(CASE WHEN ln = 6 THEN line_no END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM base)""",
    )
    + """SELECT 'transaction' AS block, file, s AS start_line, min(line_no) FILTER (ln = 6) AS end_line, count(*) FILTER (ln IN (2, 3)) AS operations FROM st
         WHERE s IS NOT NULL AND coalesce(e, -1) < s GROUP BY 2, 3 HAVING count(*) FILTER (ln = 6) > 0""",
)
def block_spans(spark, sf):
    lines = _base(spark, sf).withColumn(
        "line",
        _by_line(
            F.lit("BEGIN TRANSACTION"), F.lit("REPLACE x WITH 1"), F.lit("insert into t values (1)"), F.lit("DO tela"),
            F.lit("? 'x'"), F.lit("COMMIT"), F.lit("* note"),
        ),
    )
    spans = corpus.block_spans(lines.select("file", "line_no", "line"), *corpus.BLOCKS["transaction"])
    return spans.select(F.lit("transaction").alias("block"), "*")


_FLOW_FORMS = {
    "if": (("IF x > 1", None), ("DO m/tela_", "tab"), ("ELSE", None), ("do outra_", "fld"), ("? 'x'", None), ("ENDIF", None), ("DO fora", None)),
    "do_case": (("DO CASE", None), ("CASE x = 1", None), ("DO a_", "tab"), ("CASE .T.", None), ("DO b_", "oth"), ("ENDCASE", None), ("* note", None)),
    "loop": (("DO WHILE .T.", None), ("DO a_", "fld"), ("x = 1", None), ("DO m/b_", "tab"), ("ENDDO", None), ("FOR i = 1 TO 9", None), ("DO c", None)),
}


@query(
    "win16_flow_calls",
    t.with_tables(
        _BASE,
        """v(block, ln, role, head, col) AS (VALUES ('if', 1, 'open', '', ''), ('if', 2, 'call', 'M_TELA_', 't'), ('if', 3, 'part', '', ''), ('if', 4, 'call', 'OUTRA_', 'f'), ('if', 5, '', '', ''), ('if', 6, 'close', '', ''), ('if', 7, 'call', 'FORA', ''),
            ('do_case', 1, 'open', '', ''), ('do_case', 2, 'part', '', ''), ('do_case', 3, 'call', 'A_', 't'), ('do_case', 4, 'part', '', ''), ('do_case', 5, 'call', 'B_', 'o'), ('do_case', 6, 'close', '', ''), ('do_case', 7, '', '', ''),
            ('loop', 1, 'open', '', ''), ('loop', 2, 'call', 'A_', 'f'), ('loop', 3, '', '', ''), ('loop', 4, 'call', 'M_B_', 't'), ('loop', 5, 'close', '', ''), ('loop', 6, 'open', '', ''), ('loop', 7, 'call', 'C', ''))""",
        "li AS (SELECT block, file, line_no, role, head || upper(CASE col WHEN 't' THEN tab WHEN 'f' THEN fld WHEN 'o' THEN oth ELSE '' END) AS screen FROM base JOIN v USING (ln))",
        """wk AS (SELECT *, last_value(CASE WHEN role = 'open' THEN line_no END IGNORE NULLS) OVER w AS start_line, sum(CASE WHEN role = 'part' THEN 1 ELSE 0 END) OVER w AS parts,
            last_value(CASE WHEN role = 'close' THEN line_no END IGNORE NULLS) OVER (PARTITION BY block, file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shut
            FROM li WINDOW w AS (PARTITION BY block, file ORDER BY line_no ROWS UNBOUNDED PRECEDING))""",
        "bf AS (SELECT *, last_value(CASE WHEN role = 'open' THEN parts END IGNORE NULLS) OVER (PARTITION BY block, file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS before FROM wk)",
        "lv AS (SELECT * FROM bf WHERE start_line IS NOT NULL AND coalesce(shut, -1) < start_line)",
        "nd AS (SELECT block, file, start_line, min(line_no) AS end_line FROM lv WHERE role = 'close' GROUP BY ALL)",
    )
    + """SELECT block, file, start_line, end_line, CAST(CASE WHEN block = 'if' THEN least(parts - before, 1) ELSE parts - before END AS BIGINT) AS branch, line_no, screen
         FROM lv JOIN nd USING (block, file, start_line) WHERE role = 'call'""",
)
def flow_calls(spark, sf):
    """Screens called in the branches of IF, CASE and loops."""
    every = None
    for kind, forms in _FLOW_FORMS.items():
        texts = [F.lit(head) if column is None else F.concat(F.lit(head), F.col(column)) for head, column in forms]
        lines = _base(spark, sf).withColumn("line", _by_line(*texts)).select("file", "line_no", "line")
        found = corpus.flow_calls(lines, kind).select(F.lit(kind).alias("block"), "*")
        every = found if every is None else every.unionByName(found)
    return every


@query(
    "ext06_page_links",
    """SELECT page_id, called, count(*) AS calls FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a href="/([^"]+)"', 1)) AS called FROM pages) GROUP BY 1, 2""",
)
def page_links(spark, sf):
    files = t.read(spark, sf, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))
    return corpus.call_edges(files, r'(?i)<a href="/([^"]+)"').withColumnRenamed("file", "page_id")


#: A source file per customer that opens two others (and some call back), paints options and uses tables.
_PROGRAMS = """
pr AS (SELECT c_custkey AS k, ['CAD', 'COP', 'FIN', 'EST', 'VEN', 'X'][c_custkey % 97 % 6 + 1] || c_custkey AS program, CASE WHEN c_custkey % 3 < 2 THEN c_name ELSE '' END AS title, c_custkey % 4 AS options FROM customer),
nm AS (SELECT k, program FROM pr),
ca AS (SELECT DISTINCT a.program AS src, b.program AS dst FROM (SELECT k, program, unnest([2 * k + 1, 2 * k + 2, CASE WHEN k % 97 = 0 THEN k // 2 END]) AS t FROM pr) a
  JOIN (SELECT k, program FROM nm UNION ALL SELECT x, ['CAD', 'COP', 'FIN', 'EST', 'VEN', 'X'][x % 97 % 6 + 1] || x FROM (SELECT unnest(range((SELECT max(k) + 1 FROM pr), (SELECT max(k) * 2 + 3 FROM pr))) AS x)) b ON a.t = b.k WHERE a.program <> b.program)"""


def _program_files(spark, sf):
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.get(F.array(*[F.lit(m) for m in ("CAD", "COP", "FIN", "EST", "VEN", "X")]), (k % 97 % 6).cast("int")), k.cast("string"))
    title = F.when(key % 3 == 0, F.concat(F.lit("*PROG: "), "c_name", F.lit("\n"))).when(key % 3 == 1, F.concat(F.lit('SET TITLE "'), "c_name", F.lit('"\n'))).otherwise("")
    back = F.when(key % 97 == 0, F.concat(F.lit("\n  do "), name(F.floor(key / 2)))).otherwise("")
    paint = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < key % 4, F.concat(F.lit('\n@ 5, 1 SAY "'), i.cast("string"), F.lit('. opcao"'))).otherwise("")), "")
    text = F.concat(title, F.lit("IF x\n DO m/"), name(key * 2 + 1), F.lit("\nDO "), name(key * 2 + 2), back, paint, F.lit("\nDO CASE\nDO WHILE .T."))
    customers = t.read(spark, sf, "customer")
    files = customers.select(F.concat(F.lit("src/"), F.lower(name(key)), F.lit(".prg")).alias("file"), text.alias("text"))
    mentions = customers.join(t.read(spark, sf, "orders"), F.col("o_custkey") == key).select(name(key).alias("program"), F.concat(F.lit("T"), (F.col("o_orderkey") % 40).cast("string")).alias("entity"))
    return files, mentions


@query(
    "ext06_program_index",
    t.with_tables(
        _PROGRAMS,
        "way AS (SELECT src AS start, dst AS node FROM ca UNION SELECT w.start, c.dst FROM way w JOIN ca c ON c.src = w.node)",
        "me AS (SELECT DISTINCT program, 'T' || (o_orderkey % 40) AS entity FROM pr JOIN orders ON o_custkey = k)",
    )
    + """SELECT p.program, p.title, CAST(p.options AS BIGINT) AS options, (SELECT count(*) FROM ca WHERE src = p.program) AS calls, coalesce(r.n, 0) AS reached, coalesce(e.n, 0) AS entities
         FROM pr p LEFT JOIN (SELECT start, count(*) AS n FROM way GROUP BY 1) r ON r.start = p.program
         LEFT JOIN (SELECT start, count(DISTINCT entity) AS n FROM (SELECT * FROM way UNION SELECT program, program FROM pr) JOIN me ON me.program = node GROUP BY 1) e ON e.start = p.program""",
)
def program_index(spark, sf):
    return corpus.program_index(*_program_files(spark, sf))


@query(
    "ext06_module_journeys",
    t.with_tables(
        _PROGRAMS,
        "cg AS (SELECT *, lower(program[1:3]) AS module FROM pr WHERE program IN (SELECT src FROM ca))",
        "pl AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY program) AS no FROM cg WHERE module IN (SELECT module FROM cg GROUP BY 1 HAVING count(*) > 1))",
    )
    + """SELECT 'modulo_' || module AS journey_id, CAST(0 AS BIGINT) AS step_order, 'menu_' || module AS screen_id, 'Menu ' || upper(module) AS screen_title, 'navigate' AS action FROM pl GROUP BY module
         UNION ALL SELECT 'modulo_' || module, no * 2 - 1 + s, program, CASE WHEN title <> '' THEN title ELSE program END, ['navigate', 'input'][s + 1] FROM pl, (SELECT unnest([0, 1]) AS s)""",
)
def module_journeys(spark, sf):
    return corpus.module_journeys(_program_files(spark, sf)[0])


_FILES = """
fl AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || ['.prg', '.dbo', '.sql', '.txt'][page_id % 4 + 1] AS file, length(html) AS size FROM pages),
rk AS (SELECT *, regexp_replace(file, '\\.[^./]+$', '') AS stem, CASE WHEN file LIKE '%.dbo' THEN 1 ELSE 0 END AS r FROM fl WHERE file NOT LIKE '%.txt')"""


@query(
    "src08_preferred_sources",
    t.with_tables(_FILES) + "SELECT arg_min(file, (r, file)) AS file FROM rk GROUP BY stem",
)
def preferred_sources(spark, sf):
    suffix = F.get(F.array(*[F.lit(s) for s in (".prg", ".dbo", ".sql", ".txt")]), (F.col("page_id") % 4).cast("int"))
    files = t.read(spark, sf, "pages").select(
        F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), suffix).alias("file"), F.length("html").alias("size")
    )
    return corpus.preferred_files(files).select("file")


@query(
    "jn18_program_terms",
    r"""WITH w AS (SELECT DISTINCT doc_id, upper(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_\pM]+')) AS w FROM documents)),
        n AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS word FROM part UNION SELECT 'THE' UNION SELECT 'DER')
      SELECT doc_id AS file, word AS entity, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\b(?:APPEND\s+BLANK|INSERT\s+INTO|CREATE)\b') THEN 'create' END,
         CASE WHEN regexp_matches(text, '(?i)\b(?:SEEK|LOCATE|SELECT|SCATTER|FIND)\b') THEN 'read' END, CASE WHEN regexp_matches(text, '(?i)\b(?:REPLACE|UPDATE|GATHER)\b') THEN 'update' END,
         CASE WHEN regexp_matches(text, '(?i)\b(?:DELETE|PACK|ZAP|ERASE)\b') THEN 'delete' END) AS access
      FROM w JOIN n USING (word) JOIN documents USING (doc_id)""",
)
def program_terms(spark, sf):
    files = t.read(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    names = t.read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    names = names.unionByName(t.read(spark, sf, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "the").otherwise("der").alias("name")))
    return corpus.program_terms(files, names)


# ---------------------------------------------------------------- coverage and catalogs

_OPS = """
ops AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'tipo' WHEN l_partkey % 10 = 1 THEN 'log' ELSE 'ent' END || l_partkey AS entity,
   ['insert', 'select', 'update', 'delete', 'use', 'open', 'pack'][CAST(l_linenumber AS BIGINT)] AS operation, l_suppkey FROM lineitem)"""


def _operations(spark, sf):
    key = F.col("l_partkey")
    kinds = F.array(*[F.lit(x) for x in ("insert", "select", "update", "delete", "use", "open", "pack")])
    return t.read(spark, sf, "lineitem").select(
        F.concat(F.when(key % 10 == 0, "tipo").when(key % 10 == 1, "log").otherwise("ent"), key.cast("string")).alias("entity"),
        F.get(kinds, F.col("l_linenumber") - 1).alias("operation"), "l_suppkey",
    )


_COVERAGE = """
cov0 AS (SELECT entity, count(*) AS total_operations, bool_or(operation IN ('insert')) AS has_create, bool_or(operation IN ('select', 'open')) AS has_read,
   bool_or(operation = 'update') AS has_update, bool_or(operation IN ('delete', 'pack')) AS has_delete FROM ops GROUP BY 1),
cov AS (SELECT *, round_even(CASE WHEN has_create THEN 30 WHEN starts_with(entity, 'tipo') THEN 24.0 ELSE 0 END + CASE WHEN has_read THEN 20 ELSE 10.0 END
    + CASE WHEN has_update THEN 25 WHEN has_create AND has_read THEN 7.5 ELSE 0 END + CASE WHEN has_delete THEN 25 WHEN starts_with(entity, 'log') THEN 22.5 ELSE 0 END, 1)::DOUBLE AS completeness_score,
   concat_ws(',', CASE WHEN NOT has_create THEN 'create' END, CASE WHEN NOT has_read THEN 'read' END, CASE WHEN NOT has_update THEN 'update' END, CASE WHEN NOT has_delete THEN 'delete' END) AS missing FROM cov0)"""


@query(
    "agg19_crud_coverage",
    t.with_tables(_OPS, _COVERAGE) + "SELECT *, completeness_score >= 80 AS is_complete FROM cov",
)
def crud_coverage(spark, sf):
    return corpus.crud_coverage(_operations(spark, sf))


@query(
    "agg19_crud_summary",
    t.with_tables(_OPS, _COVERAGE)
    + """SELECT count(*) AS total_entities, count(*) FILTER (completeness_score >= 80) AS complete_crud, count(*) FILTER (completeness_score < 80) AS partial_crud,
          round_even(count(*) FILTER (completeness_score >= 80) / count(*) * 100, 1) AS completeness_pct, round_even(sum(completeness_score) / count(*), 1) AS avg_completeness_score,
          count(*) FILTER (NOT has_create) AS without_create, count(*) FILTER (NOT has_read) AS without_read, count(*) FILTER (NOT has_update) AS without_update,
          count(*) FILTER (NOT has_delete) AS without_delete FROM cov""",
)
def crud_summary(spark, sf):
    return corpus.crud_summary(corpus.crud_coverage(_operations(spark, sf)))


@query(
    "agg20_merged_entities",
    """WITH f AS (SELECT upper('Ent' || (l_partkey % 300)) AS entity, CASE WHEN l_orderkey % 2 = 0 THEN 'campo' ELSE 'CAMPO' END || (l_suppkey % 13) AS field, l_returnflag AS datatype,
          ['unknown', 'recital', 'dbf', 'isam', 'sql'][l_partkey % 5 + 1] AS storage_type, l_orderkey AS file, l_linenumber AS line_no FROM lineitem),
        s AS (SELECT entity, arg_max(storage_type, list_position(['unknown', 'recital', 'dbf', 'isam', 'sql'], storage_type)) AS storage_type FROM f GROUP BY 1)
      SELECT entity, arg_min(field, (file, line_no, field, datatype)) AS field, storage_type, count(*) AS mentions FROM f JOIN s USING (entity, storage_type)
      GROUP BY entity, upper(field), storage_type
      """.replace("FROM f JOIN s USING (entity, storage_type)", "FROM (SELECT f.* EXCLUDE (storage_type), s.storage_type FROM f JOIN s USING (entity))"),
)
def merged_entities(spark, sf):
    li = t.read(spark, sf, "lineitem")
    kinds = F.array(*[F.lit(x) for x in ("unknown", "recital", "dbf", "isam", "sql")])
    fields = li.select(
        F.concat(F.lit("Ent"), (F.col("l_partkey") % 300).cast("string")).alias("entity"),
        F.concat(F.when(F.col("l_orderkey") % 2 == 0, "campo").otherwise("CAMPO"), (F.col("l_suppkey") % 13).cast("string")).alias("field"),
        F.col("l_returnflag").alias("datatype"), F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("storage_type"),
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line_no"),
    )
    return corpus.merge_entities(fields).drop("datatype")


@query(
    "agg21_binding_bands",
    """SELECT CASE WHEN l_suppkey % 17 = 0 THEN '(unbound)' ELSE 'ent' || (l_suppkey % 50) END AS entity, CASE WHEN l_discount * 10 >= 0.75 THEN 'high' WHEN l_discount * 10 >= 0.40 THEN 'medium' ELSE 'low' END AS band,
         count(*) AS bindings, count(DISTINCT l_orderkey) AS programs FROM lineitem GROUP BY 1, 2""",
)
def binding_bands(spark, sf):
    bindings = t.read(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 17 != 0, F.concat(F.lit("ent"), (F.col("l_suppkey") % 50).cast("string"))).otherwise("").alias("entity"),
        (F.col("l_discount") * 10).alias("confidence"), F.col("l_orderkey").alias("program"),
    )
    return corpus.binding_bands(bindings)


#: Line items as bindings of programs: two folders may hold a program of the same name.
_BINDINGS = """
bd AS (SELECT ['src/', 'old/'][l_linenumber % 5 // 4 + 1] || ['cad', 'COP', 'finx', 'e1'][l_orderkey % 4 + 1] || (l_orderkey % 500) || '.prg' AS source_file,
   CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'Ent' || (l_suppkey % 50) END AS entity, ['create', 'read', 'update', '']
   [l_partkey % 4 + 1] AS operation FROM lineitem),
pn AS (SELECT *, upper(regexp_replace(regexp_replace(source_file, '^.*/', ''), '[.]prg$', '')) AS program FROM bd),
en AS (SELECT p.* FROM pn p JOIN (SELECT program, max(source_file) AS source_file FROM pn GROUP BY 1) USING (program, source_file)),
md AS (SELECT *, CASE WHEN regexp_extract(lower(program), '^([a-z]{2,4})', 1) <> '' THEN regexp_extract(lower(program), '^([a-z]{2,4})', 1) ELSE lower(program)[1:3] END AS module FROM en)"""


def _bindings(spark, sf):
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    order = F.col("l_orderkey")
    name = F.concat(pick(("src/", "old/"), F.floor(F.col("l_linenumber") % 5 / 4)), pick(("cad", "COP", "finx", "e1"), order % 4), (order % 500).cast("string"), F.lit(".prg"))
    return t.read(spark, sf, "lineitem").select(
        name.alias("source_file"), F.when(F.col("l_suppkey") % 17 == 0, "").otherwise(F.concat(F.lit("Ent"), (F.col("l_suppkey") % 50).cast("string"))).alias("entity"),
        pick(("create", "read", "update", ""), F.col("l_partkey") % 4).alias("operation"),
    )


@query(
    "agg21_program_catalog",
    t.with_tables(_BINDINGS)
    + """SELECT program, any_value(source_file) AS source_file, count(DISTINCT CASE WHEN entity <> '' THEN upper(entity) END) AS entities, count(DISTINCT CASE WHEN operation <> '' THEN operation END) AS operations,
         count(*) AS bindings, any_value(module) AS module FROM md GROUP BY program""",
)
def program_catalog(spark, sf):
    return corpus.program_catalog(_bindings(spark, sf))


@query("agg21_catalog_by_module", t.with_tables(_BINDINGS) + "SELECT module, count(DISTINCT program) AS programs, count(*) AS bindings FROM md GROUP BY 1")
def catalog_by_module(spark, sf):
    return corpus.catalog_by_module(corpus.program_catalog(_bindings(spark, sf)))


@query(
    "agg21_catalog_by_entity",
    t.with_tables(_BINDINGS)
    + """SELECT upper(entity) AS entity, count(DISTINCT program) AS programs, count(DISTINCT module) AS modules, string_agg(DISTINCT operation, ',' ORDER BY operation) FILTER (operation <> '') AS operations
         FROM md WHERE entity <> '' GROUP BY 1""",
)
def catalog_by_entity(spark, sf):
    bindings = _bindings(spark, sf)
    return corpus.catalog_by_entity(bindings, corpus.program_catalog(bindings))


@query(
    "set02_catalog_differences",
    """WITH o AS (SELECT DISTINCT l_suppkey AS module, l_partkey AS name FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT DISTINCT l_suppkey AS module, l_partkey AS name FROM lineitem WHERE l_linestatus = 'F')
       SELECT *, 'added' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM f EXCEPT SELECT * FROM o)""",
)
def catalog_differences(spark, sf):
    li = t.read(spark, sf, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("name"))
    return corpus.catalog_differences(side("F"), side("O"), ["module", "name"])


@query(
    "set03_connection_changes",
    """WITH s AS (SELECT DISTINCT user_id AS connection, epoch_us(ts) // 3600000000 AS sample FROM events)
       SELECT s.connection, s.sample, 'open' AS change FROM s LEFT JOIN s p ON p.connection = s.connection AND p.sample = s.sample - 1 WHERE p.sample IS NULL
       UNION ALL SELECT s.connection, s.sample + 1, 'close' FROM s LEFT JOIN s n ON n.connection = s.connection AND n.sample = s.sample + 1 WHERE n.sample IS NULL""",
)
def connection_changes(spark, sf):
    ev = t.read(spark, sf, "events").select(
        F.col("user_id").alias("connection"), F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("sample")
    )
    return sessions.connection_changes(ev)


@query(
    "set05_route_coverage",
    r"""WITH c AS (SELECT conv_id, role, lower(trim(unnest(string_split_regex(text, '[\t\n\f\r ]+')))) AS t FROM conversations),
       h AS (SELECT DISTINCT conv_id, t FROM c WHERE role = 'assistant'), r AS (SELECT conv_id, t FROM c WHERE role <> 'assistant')
       SELECT conv_id AS journey_id, count(*) AS steps, count(h.t) AS matched, round_even(count(h.t) / count(*) * 100, 1) AS coverage_pct FROM r LEFT JOIN h USING (conv_id, t) GROUP BY 1""",
)
def route_coverage(spark, sf):
    """Every word of the whole texts as a step: those of the user, found among those of the assistant."""
    words = F.explode(F.split("text", r"[\t\n\f\r ]+"))
    c = t.read(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id"), "role", words.alias("title"))
    return corpus.route_coverage(c.where(F.col("role") == "assistant"), c.where(F.col("role") != "assistant"))


@query(
    "jn11_cooccurrence",
    """WITH m AS (SELECT DISTINCT l_orderkey AS file, 'e' || (l_partkey % 100) AS entity FROM lineitem)
       SELECT x.entity AS a, y.entity AS b, count(*) AS files, round(least(0.85, count(*) * 0.05 + 0.40), 2)::DOUBLE AS confidence FROM m x JOIN m y ON x.file = y.file AND x.entity < y.entity GROUP BY 1, 2""",
)
def cooccurrence(spark, sf):
    mentions = t.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.concat(F.lit("e"), (F.col("l_partkey") % 100).cast("string")).alias("entity")
    )
    return corpus.cooccurrence(mentions)


# ---------------------------------------------------------------- graphs


@query(
    "grf01_run_families",
    t.with_tables(
        t.RUNS_SQL,
        """fam AS (SELECT run_id, run_id AS root, 0 AS depth FROM runs WHERE parent_run_id IS NULL
             UNION ALL SELECT r.run_id, f.root, f.depth + 1 FROM runs r JOIN fam f ON r.parent_run_id = f.run_id)""",
    )
    + "SELECT run_id, root AS root_run_id, CAST(depth AS BIGINT) AS depth, count(*) OVER (PARTITION BY root) AS family_size FROM fam",
)
def run_families(spark, sf):
    return graph.families(t.runs(spark, sf).select("run_id", "parent_run_id"))


def _dependencies(spark, sf):
    """Orders need their customer and their parent run, customers their nation; some customers need each other."""
    runs = t.runs(spark, sf)
    order = F.concat(F.lit("o"), F.col("run_id").cast("string"))
    customer = F.concat(F.lit("c"), F.col("scenario_id").cast("string"))
    c = t.read(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), "c_custkey"
    )
    swap = F.when(F.col("c_custkey") % 200 == 0, F.col("c_custkey") + 1).when(F.col("c_custkey") % 200 == 1, F.col("c_custkey") - 1)
    edges = (
        runs.select(order.alias("src"), customer.alias("dst"))
        .unionByName(
            runs.where(F.col("parent_run_id").isNotNull()).select(order.alias("src"), F.concat(F.lit("o"), F.col("parent_run_id").cast("string")).alias("dst"))
        )
        .unionByName(c.select(F.col("node").alias("src"), F.col("nation").alias("dst")))
        .unionByName(c.where(swap.isNotNull()).select(F.col("node").alias("src"), F.concat(F.lit("c"), swap.cast("string")).alias("dst")))
    )
    kind = F.lit("isam")
    nodes = (
        runs.select(order.alias("node"), F.when(F.col("run_id") % 2 == 0, "sql").otherwise(kind).alias("storage_type"))
        .unionByName(c.select("node", F.lit("sql").alias("storage_type")))
        .unionByName(t.read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.lit("sql").alias("storage_type")))
    )
    return nodes, edges


@query(
    "grf02_generation_order",
    t.with_tables(
        t.RUNS_SQL,
        """lv AS (SELECT run_id, 2 AS level FROM runs WHERE parent_run_id IS NULL AND scenario_id % 200 NOT IN (0, 1)
             UNION ALL SELECT r.run_id, l.level + 1 FROM runs r JOIN lv l ON r.parent_run_id = l.run_id WHERE r.scenario_id % 200 NOT IN (0, 1))""",
        "needed AS (SELECT DISTINCT parent_run_id AS run_id FROM runs WHERE parent_run_id IS NOT NULL)",
    )
    + """SELECT 'o' || r.run_id AS node, CAST(lv.level AS BIGINT) AS level, FALSE AS in_cycle, lv.level IS NULL AS blocked, FALSE AS is_root, n.run_id IS NULL AS is_leaf, CASE WHEN r.run_id % 2 = 0 THEN 100 ELSE 150 END AS suggested_rows
         FROM runs r LEFT JOIN lv ON lv.run_id = r.run_id LEFT JOIN needed n ON n.run_id = r.run_id
       UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 200 NOT IN (0, 1) THEN 1 END, c_custkey % 200 IN (0, 1), c_custkey % 200 IN (0, 1), FALSE,
         c_custkey % 200 NOT IN (0, 1) AND c_custkey NOT IN (SELECT scenario_id FROM runs), 100 FROM customer
       UNION ALL SELECT 'n' || n_nationkey, 0, FALSE, FALSE, TRUE, n_nationkey NOT IN (SELECT c_nationkey FROM customer), 200 FROM nation""",
)
def generation_order(spark, sf):
    return graph.generation_plan(*_dependencies(spark, sf))


@query(
    "grf03_run_components",
    t.with_tables(
        t.RUNS_SQL,
        """fam AS (SELECT run_id, run_id AS root FROM runs WHERE parent_run_id IS NULL
             UNION ALL SELECT r.run_id, f.root FROM runs r JOIN fam f ON r.parent_run_id = f.run_id)""",
        "lab AS (SELECT run_id, root, min(run_id) OVER (PARTITION BY root) AS component, count(*) OVER (PARTITION BY root) AS size FROM fam)",
    )
    + """SELECT component, size, run_id AS node, CAST(CASE WHEN run_id = root THEN 0 ELSE 1 END AS BIGINT) AS dependencies FROM lab WHERE size >= 2""",
)
def run_components(spark, sf):
    runs = t.runs(spark, sf).select("run_id", "parent_run_id")
    edges = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("run_id").alias("src"), F.col("parent_run_id").alias("dst"))
    return graph.flows(runs.select(F.col("run_id").alias("node")), edges)


@query(
    "grf03_customer_part_flows",
    """WITH RECURSIVE p AS (SELECT DISTINCT 'c' || o_custkey AS c, 'p' || l_partkey AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       e AS MATERIALIZED (SELECT c AS src, q AS dst FROM p UNION ALL SELECT q, c FROM p),
       r AS (SELECT min(src) AS node FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
       SELECT (SELECT min(node) FROM r) AS component, count(*) AS size FROM r
       UNION ALL SELECT node, 1 FROM (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 'p' || p_partkey FROM part) WHERE node NOT IN (SELECT src FROM e)""",
)
def customer_part_flows(spark, sf):
    edges = (
        t.read(spark, sf, "lineitem")
        .join(t.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
        .distinct()
    )
    nodes = t.read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    nodes = nodes.unionByName(t.read(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")))
    return graph.components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(
    "grf04_name_clusters",
    """WITH nm AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 5 THEN 'zz' || chr(CAST(97 + p_partkey // 97 % 26 AS INTEGER)) ELSE string_split(p_name, ' ')[2] END AS prefix,
           CASE WHEN p_partkey % 97 = 5 THEN 'zz' || chr(CAST(97 + p_partkey // 97 % 26 AS INTEGER)) ELSE string_split(p_name, ' ')[2] END || CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END || p_partkey AS node FROM part),
        sz AS (SELECT prefix, count(*) AS size FROM nm GROUP BY 1),
        ed AS (SELECT a.prefix, b.prefix AS to_prefix, s.size FROM nm a JOIN nm b ON b.p_partkey = a.p_partkey + 1 JOIN sz s ON s.prefix = b.prefix JOIN sz o ON o.prefix = a.prefix WHERE o.size < 5 AND s.size >= 5),
        bs AS (SELECT prefix, arg_min(to_prefix, (-size, to_prefix)) AS to_prefix FROM ed GROUP BY 1)
      SELECT node, coalesce(to_prefix, prefix) AS cluster FROM nm LEFT JOIN bs USING (prefix)""",
)
def name_clusters(spark, sf):
    key = F.col("p_partkey")
    odd = F.concat(F.lit("zz"), F.char((97 + F.floor(key / 97) % 26).cast("int")))
    stem = F.when(key % 97 == 5, odd).otherwise(F.get(F.split("p_name", " "), F.lit(1)))
    parts = t.read(spark, sf, "part").select(
        "p_partkey", F.concat(stem, F.when(key % 3 == 0, "_").otherwise(""), key.cast("string")).alias("node")
    )
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("node").alias("dst"))
    edges = parts.join(after, "p_partkey").select(F.col("node").alias("src"), "dst")
    return graph.name_clusters(parts.select("node"), edges)


@query(
    "grf05_edge_roles",
    t.with_tables(t.RUNS_SQL)
    + """SELECT run_id AS node, parent_run_id IS NULL AS is_root, run_id NOT IN (SELECT parent_run_id FROM runs WHERE parent_run_id IS NOT NULL) AS is_leaf,
          parent_run_id IS NULL AND run_id NOT IN (SELECT parent_run_id FROM runs WHERE parent_run_id IS NOT NULL) AS is_orphan FROM runs""",
)
def edge_roles(spark, sf):
    runs = t.runs(spark, sf).select("run_id", "parent_run_id")
    edges = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("run_id").alias("src"), F.col("parent_run_id").alias("dst"))
    return graph.edge_roles(runs.select(F.col("run_id").alias("node")), edges)


@query(
    "grf05_edge_rules",
    """SELECT DISTINCT n_name AS depends_on, c_mktsegment AS enables, '''' || c_mktsegment || ''' referencia/depende de ''' || n_name || '''' AS description
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def edge_rules(spark, sf):
    c = t.read(spark, sf, "customer").join(t.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.edge_rules(c.select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst")))


_MENUS = """
links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]+)"', 1)) AS called, generate_subscripts(regexp_extract_all(html, '<a href="/([^"]+)"', 1), 1) AS pos FROM pages),
menus AS (SELECT p.page_id AS menu_id, coalesce(replace(replace(upper(l.called), 'ß', 'SS'), 'ẞ', 'SS'), '') AS stem, array_to_string(string_split(CAST(p.page_id AS VARCHAR), ''), '.') AS route, length(CAST(p.page_id AS VARCHAR)) AS depth
  FROM pages p LEFT JOIN links l ON l.page_id = p.page_id AND l.pos = 1),
callers AS (SELECT DISTINCT l.page_id AS caller, replace(replace(upper(called), 'ß', 'SS'), 'ẞ', 'SS') AS stem, depth FROM links l JOIN menus m ON m.menu_id = l.page_id WHERE pos > 1)"""


@query(
    "grf06_menu_parents",
    t.with_tables(
        _MENUS,
        "ex AS (SELECT m.menu_id, arg_min(c.caller, (-c.depth, c.caller)) AS caller FROM menus m JOIN callers c ON c.stem = m.stem AND c.caller <> m.menu_id GROUP BY 1)",
        """rt AS (SELECT m.menu_id, arg_max(p.menu_id, (CASE WHEN p.route = '0' THEN 0 ELSE 1 END, p.depth, p.menu_id)) AS above FROM menus m JOIN menus p ON p.menu_id <> m.menu_id AND (p.route = '0' OR (p.depth < m.depth AND starts_with(m.route, p.route || '.')))
             GROUP BY 1)""",
    )
    + """SELECT menu_id, coalesce(caller, above) AS parent_id, CASE WHEN caller IS NOT NULL THEN 'call' WHEN above IS NOT NULL THEN 'route' ELSE 'root' END AS link
         FROM menus LEFT JOIN ex USING (menu_id) LEFT JOIN rt USING (menu_id)""",
)
def menu_parents(spark, sf):
    pages = t.read(spark, sf, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1))
    menus = pages.select(
        F.col("page_id").alias("menu_id"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("stem"), F.lit("sys").alias("module"),
        F.array_join(F.split(F.col("page_id").cast("string"), ""), ".").alias("route"),
    )
    calls = pages.select(F.col("page_id").alias("menu_id"), F.explode(F.slice(links, F.lit(2), F.size(links))).alias("called"))
    return graph.menu_parents(menus, calls)


@query(
    "grf06_unreached_programs",
    t.with_tables(_MENUS)
    + "SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS program FROM part EXCEPT SELECT replace(replace(upper(called), 'ß', 'SS'), 'ẞ', 'SS') FROM links",
)
def unreached_programs(spark, sf):
    inventory = t.read(spark, sf, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("program")).distinct()
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1))
    return graph.unreached(inventory, t.read(spark, sf, "pages").select(F.explode(links).alias("called")))
