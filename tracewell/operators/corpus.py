"""Program sources as tables: statements, fields, entities, relationships, coverage.

Sources come as (file, line_no, line) or (file, text) rows; every rule is a regular
expression over lines, evaluated inside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import naming
from tracewell.plans import ordered
from tracewell.plans.lineage import settle

# Rank of a suffix when files share a stem; a readable form wins.
SUFFIX_RANK = {".prg": 0, ".src": 0, ".sql": 0, ".dbo": 1}


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Program files as (file, text), one row per file."""
    return (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    )


def preferred_files(files: DataFrame, path: str = "file") -> DataFrame:
    """Of files that share a stem the most readable one."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    rank = F.coalesce(*[F.when(suffix == s, r) for s, r in SUFFIX_RANK.items()], F.lit(99))
    rest = [c for c in files.columns if c != path]
    return (
        files.where(suffix.isin(*SUFFIX_RANK))
        .withColumn("__stem", F.regexp_replace(path, r"\.[^./\\]+$", ""))
        .groupBy("__stem")
        .agg(F.min_by(F.struct(path, *rest), F.struct(rank, F.col(path))).alias("f"))
        .select("f.*")
    )


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) rows of whole texts."""
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no") + 1
    )


# ---------------------------------------------------------------- statements

_TABLE = r"(?:[\w]+\.)?(\w+)"


def _clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), "^[\"'`]+|[\"'`]+$", ""))


def split_fields(text: Column) -> Column:
    """Field names of a column list; functions and expressions only count by their alias."""
    parts = F.filter(F.transform(F.split(text, ","), lambda f: _clean_name(f)), lambda f: f != "")

    def name(f: Column) -> Column:
        alias = F.regexp_extract(f, r"(?i)\bAS\s+(\w+)\s*$", 1)
        plain = F.trim(F.substring_index(f, ".", -1))
        return (
            F.when(f.rlike(r"[()]"), alias)
            .when(f.rlike(r"^['\"\d]") | f.rlike(r"[+\-*/]"), "")
            .when(alias != "", alias)
            .otherwise(plain)
        )

    return F.filter(F.transform(parts, name), lambda f: f != "")


def sql_operations(lines: DataFrame) -> DataFrame:
    """One row per SQL statement of a line: operation, table and fields."""
    line = F.col("line")

    def found(operation: str, shape: str, table: int, fields: int | None, kind: str = "list") -> Column:
        name = F.upper(F.regexp_extract(line, shape, table))
        if fields is None:
            names = F.array().cast("array<string>")
        else:
            text = F.trim(F.regexp_extract(line, shape, fields))
            if kind == "set":
                sides = F.filter(F.split(text, ","), lambda p: F.instr(p, "=") > 1)
                names = F.transform(sides, lambda p: _clean_name(F.substring_index(p, "=", 1)))
            else:
                names = F.when(text == "*", F.array().cast("array<string>")).otherwise(split_fields(text))
        return F.when(
            line.rlike(shape), F.struct(F.lit(operation).alias("operation"), name.alias("entity"), names.alias("fields"))
        )

    rules = (
        found("insert", rf"(?i)INSERT\s+INTO\s+{_TABLE}\s*\(([^)]+)\)", 1, 2),
        found("update", rf"(?i)UPDATE\s+{_TABLE}\s+SET\s+(.+?)(?:WHERE|$)", 1, 2, "set"),
        found("select", rf"(?i)DECLARE\s+\w+\s+CURSOR\s+FOR\s+SELECT\s+(.+?)\s+FROM\s+{_TABLE}", 2, 1),
        found("select", rf"(?i)SQLEXEC\s*\([^,]+?\s*,\s*\[?\s*SELECT\s+(.+?)\s+FROM\s+{_TABLE}", 2, 1),
        found("select", rf"(?i)SELECT\s+(.+?)\s+FROM\s+{_TABLE}", 2, 1),
        found("delete", rf"(?i)DELETE\s+FROM\s+{_TABLE}", 1, None),
    )
    return (
        lines.where(line.rlike(r"(?i)INSERT|UPDATE|SELECT|DELETE"))
        .select("file", "line_no", F.explode(F.array_compact(F.array(*rules))).alias("o"))
        .select("file", "line_no", "o.*")
    )


def joined_tables(lines: DataFrame) -> DataFrame:
    """Tables named in JOIN clauses of select lines."""
    names = F.regexp_extract_all("line", F.lit(rf"(?i)JOIN\s+{_TABLE}"), F.lit(1))
    return lines.where(F.col("line").rlike(r"(?i)SELECT\s+.+\s+FROM\s")).select(
        "file", "line_no", F.explode(F.transform(names, lambda n: F.upper(n))).alias("entity")
    )


# SQL types and their plain names.
SQL_TYPES = {
    "integer": "integer",
    "int": "integer",
    "bigint": "integer",
    "smallint": "integer",
    "tinyint": "integer",
    "serial": "integer",
    "numeric": "decimal",
    "decimal": "decimal",
    "float": "decimal",
    "double": "decimal",
    "real": "decimal",
    "money": "decimal",
    "varchar": "text",
    "char": "text",
    "character": "text",
    "text": "text",
    "clob": "text",
    "memo": "text",
    "blob": "text",
    "date": "date",
    "datetime": "datetime",
    "timestamp": "datetime",
    "time": "text",
    "boolean": "boolean",
    "bool": "boolean",
    "bit": "boolean",
}


def table_definitions(files: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE statements: plain type, required, unique (primary keys included)."""
    shape = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[\w]+\.)?(\w+)\s*\((.*?)\);"
    tables = files.select(
        "file",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(shape), F.lit(1)).alias("entity"),
                F.regexp_extract_all("text", F.lit(shape), F.lit(2)).alias("body"),
            )
        ).alias("t"),
    ).select("file", "t.entity", "t.body")
    keys = F.transform(
        F.split(F.regexp_extract("body", r"(?i)PRIMARY\s+KEY\s*\(([^)]+)\)", 1), ","), lambda c: _clean_name(c)
    )
    rows = tables.select(
        "file", "entity", keys.alias("keys"), F.posexplode(F.split("body", "\n")).alias("place", "raw")
    ).withColumn("line", F.regexp_replace(F.trim("raw"), ",+$", ""))
    name = F.regexp_extract("line", r"^\s*(\w+)\s+(\w+)", 1)
    declared = F.lower(F.regexp_extract("line", r"^\s*(\w+)\s+(\w+)", 2))
    plain = F.lit("text")
    for given, kind in SQL_TYPES.items():
        plain = F.when(declared == given, kind).otherwise(plain)
    return rows.where(
        (F.col("line") != "") & ~F.upper("line").rlike("^(PRIMARY|FOREIGN|CONSTRAINT|INDEX|UNIQUE|CHECK)") & (name != "")
    ).select(
        "file", "entity", name.alias("field"), plain.alias("datatype"),
        F.col("line").rlike(r"(?i)NOT\s+NULL").alias("required"),
        (F.array_contains("keys", name) | F.col("line").rlike("(?i)UNIQUE")).alias("is_unique"), "place",
    )


def file_operations(lines: DataFrame) -> DataFrame:
    """xBase commands with the table in use at their line.

    The table of the last USE is carried down the file.  REPLACE counts as insert when one
    of the last three operations on the table in the file was an append, else as update.
    """
    line, up = F.col("line"), F.col("__up")

    def found(word: str, shape: str) -> Column:
        # most lines do not hold the word at all, which needs no pattern
        return F.contains(up, F.lit(word)) & line.rlike(shape)

    use = F.when(F.contains(up, F.lit("USE")), F.upper(F.regexp_extract(line, r"(?i)USE\s+(\w+)", 1)))
    marked = lines.withColumn("__up", F.upper("line")).withColumn("__use", F.when(use != "", use))
    is_area = found("SELE", r"(?i)^(?:SELECT|SELE)\s+\w+") & ~line.rlike(r"(?i)\bFROM\b|SQLEXEC|DECLARE|CURSOR")
    with_part = r"(?i)REPLACE\s+(.+?)(?:\s+FOR\s+.+?)?(?:\s+WHILE\s+.+?)?(?:\s+ALL|NEXT\s+\d+|RECORD\s+\d+|REST)?\s*$"
    kind = (
        F.when(F.col("__use").isNotNull(), "use")
        .when(is_area, None)
        .when(found("APPEND", r"(?i)APPEND\s+BLANK"), "append")
        .when(found("REPLACE", with_part), "replace")
        .when(found("ORDER", r"(?i)SET\s+ORDER\s+TO\s+\w+"), None)
        .when(found("SEEK", r"(?i)SEEK\s+\w+"), "seek")
        .when(found("INDEX", r"(?i)INDEX\s+ON\s+\w+\s+TAG\s+\w+"), None)
        .when(found("LOCATE", r"(?i)LOCATE\s+FOR\s+.+"), "locate")
        .when(found("SCATTER", r"(?i)SCATTER\s+(?:MEMVAR|NAME\s+\w+)"), "scatter")
        .when(found("GATHER", r"(?i)GATHER\s+(?:MEMVAR|FROM\s+\w+)"), "gather")
        .when(found("DELETE", r"(?i)\bDELETE\b"), "delete")
        .when(found("PACK", r"(?i)\bPACK\b"), "pack")
        .when(found("ZAP", r"(?i)\bZAP\b"), "zap")
        .when(found("DBSEEK", r"(?i)DBSEEK\s*\(\s*\w+"), "dbseek")
        .when(found("FIELDGET", r"(?i)FIELDGET\s*\(\s*\d+"), "fieldget")
        .when(found("FIELDPUT", r"(?i)FIELDPUT\s*\(\s*\d+\s*,\s*\w+"), "fieldput")
    )
    # the kind is worked out once, before the rows are sorted; sizes are counted on the lines alone
    hot = ordered.hot_keys(lines, ["file"], "line_no")
    kinds = marked.withColumn("kind", kind).select("file", "line_no", "line", "__use", "kind")
    carried = ordered.scan(kinds, ["file"], ["line_no"], hot, entity=ordered.last_known(F.col("__use")))
    assigned = F.filter(
        F.transform(
            F.split(F.regexp_extract(line, with_part, 1), ","), lambda p: F.regexp_extract(F.trim(p), r"(?i)^(\w+)\s+WITH", 1)
        ),
        lambda f: f != "",
    )
    compared = F.regexp_extract_all(F.regexp_extract(line, r"(?i)LOCATE\s+FOR\s+(.+)", 1), F.lit(r"(\w+)\s*(?:=|!=|>=|<=|>|<|\$)"), F.lit(1))
    fields = (
        F.when(F.col("kind") == "replace", assigned)
        .when(F.col("kind") == "locate", compared)
        .when(F.col("kind") == "seek", F.array(F.regexp_extract(line, r"(?i)SEEK\s+(\w+)", 1)))
        .otherwise(F.array().cast("array<string>"))
    )
    operations = carried.where(F.col("kind").isNotNull() & F.col("entity").isNotNull()).select(
        "file", "line_no", "entity", "kind", fields.alias("fields")
    )
    # a table has no more operations in a file than the file has lines
    keys, sizes = ["file", "entity"], hot if hot.table is None else ordered.hot_keys(operations, ["file", "entity"], "line_no")
    placed = ordered.scan(operations, keys, ["line_no"], sizes, __pos=ordered.row_number())
    append = F.when(F.col("kind") == "append", F.col("__pos"))
    near = ordered.scan(placed, keys, ["line_no"], sizes, __append=ordered.running_max(append, include_current=False))
    recent = F.col("__append") >= F.col("__pos") - 3
    return near.select(
        "file", "line_no", "entity",
        F.when(F.col("kind") != "replace", F.col("kind")).when(recent, "insert").otherwise("update").alias("operation"),
        "fields",
    )


# Words that look like an alias but are not.
ALIAS_STOP_WORDS = (
    "if else endif function return parameters private public do while enddo case endcase for endfor scan endscan "
    "with endwhile iif set declare local dimension text endtext lareaant lok labrarq lareares larea off on talk "
    "clock status deleted exclusive century hours date separator point bell console device printer alternate "
    "procedure carry clear count display eject erase goto help input join keyboard label list note pack quit recall "
    "reindex release rename report restore run save skip sort store sum total type wait zap copy find go locate "
    "modify scatter seek update field_name field fields name source storage tmp log msg err out old new now all"
).split()
# Module names by alias prefix.
ALIAS_MODULES = {
    "cad": "cadastros", "cre": "contas_receber", "est": "estoque", "fat": "faturamento", "ped": "pedidos",
    "pcp": "producao", "cmp": "compras", "fin": "financeiro", "exp": "expedicao", "mat": "materiais",
    "sig": "sistema", "blo": "bloqueio", "uni": "unificado", "sol": "solados", "sgm": "gestao_modelos",
    "ses": "sesmt", "ctb": "contabilidade", "imo": "imoveis", "sac": "sac", "mkt": "marketing", "loj": "lojas",
    "cpr": "compras", "ndm": "nota_devolucao", "mao": "mao_de_obra",
}


def likely_alias(alias: Column) -> Column:
    return ~alias.isin(*ALIAS_STOP_WORDS) & F.length(alias).between(3, 20) & alias.rlike("[a-z]")


def alias_module(alias: Column) -> Column:
    out = F.lit("")
    for prefix, name in ALIAS_MODULES.items():
        out = F.when(F.substring(alias, 1, 3) == prefix, name).otherwise(out)
    return out


def alias_evidence(lines: DataFrame) -> DataFrame:
    """Evidence that a word is an entity: one row per rule hit with operation and score."""
    line, body = F.col("line"), F.trim("line")

    def hits(rule: str, operation: str, score: int, names: Column, test: Column | None = None) -> Column:
        rows = F.transform(
            names,
            lambda n: F.struct(
                F.lower(n).alias("alias"), F.lit(rule).alias("rule"), F.lit(operation).alias("operation"), F.lit(score).alias("score")
            ),
        )
        return rows if test is None else F.when(test, rows).otherwise(F.filter(rows, lambda _: F.lit(False)))

    def one(shape: str, *groups: int) -> Column:
        value = F.concat(*[F.regexp_extract(line, shape, g) for g in groups])
        return F.filter(F.array(value), lambda v: v != "")

    opened = r"(?i)(\w+)Abre(\d+)\s*\(\s*\d*\s*\)"
    used = F.when(
        line.rlike(r"(?i)use\s+\S+"),
        F.array(
            F.when(line.rlike(r"(?i)alias\s+\w+"), F.regexp_extract(line, r"(?i)alias\s+(\w+)", 1)).otherwise(
                F.substring_index(F.regexp_extract(line, r"(?i)use\s+(\S+)", 1), ".", 1)
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    procedure = F.lower(F.regexp_extract(line, r"(?i)set\s+procedure\s+to\s+.*?(\w+)(?:\.dbo|\.prg)?", 1))
    base = F.regexp_replace(procedure, "abre?$", "")
    reduced = (base != "") & (base != procedure) & likely_alias(base)
    named = (procedure != "") & likely_alias(procedure) & ~procedure.isin("additive", "to")
    arrows = F.regexp_extract_all(line, F.lit(r"(\w{3,15})->\w+"), F.lit(1))
    dots = F.filter(
        F.regexp_extract_all(line, F.lit(r"(\w{3,15})\.\w+"), F.lit(1)),
        lambda n: ~F.lower(n).isin("set", "close", "select", "replace", "delete", "append"),
    )
    called = F.regexp_extract(body, r"(?i)^do\s+(\w+)", 1)
    rules = F.concat(
        hits("open_numbered", "open", 10, one(opened, 1, 2)),
        hits("open_plain", "open", 8, F.filter(one(r"(?i)(\w+)Abre\s*\(\s*\)", 1), lambda n: ~F.lower(n).contains("abre"))),
        hits("use", "use", 8, used),
        hits("arrow", "reference", 1, arrows),
        hits("dot", "reference", 1, dots),
        hits("select_area", "select", 3, F.regexp_extract_all(line, F.lit(r'(?i)select\s*\(\s*"(\w+)"\s*\)'), F.lit(1))),
        hits("close", "close", 2, F.filter(F.array(F.regexp_extract(body, r"(?i)^close\s+(\w{3,15})", 1)), lambda n: n != "")),
        hits("select_from", "select_sql", 4, F.filter(one(r"(?i)from\s+(\w+)", 1), lambda n: ~F.lower(n).contains("dual")), line.rlike(r"(?i)select\s+")),
        hits("procedure_base", "procedure", 5, F.array(base), named & reduced),
        hits("procedure", "procedure", 3, F.array(procedure), named & ~reduced),
        hits("call", "call", 2, F.filter(F.array(called), lambda n: (n != "") & ~F.lower(n).isin("while", "case", "endcase", "enddo"))),
    )
    return (
        lines.where(~body.startswith("*") & ~body.startswith("&&"))
        .select("file", "line_no", F.explode(rules).alias("e"))
        .select("file", "line_no", "e.*")
        .where(likely_alias(F.col("alias")))
    )


def score_aliases(evidence: DataFrame) -> DataFrame:
    """Total score, confidence and module of each alias in a file."""
    return evidence.groupBy("file", "alias").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("hits")).select(
        "file", "alias", "score", "hits", F.least(F.col("score") / 20.0, F.lit(1.0)).alias("confidence"),
        alias_module(F.col("alias")).alias("module"),
    )


# ---------------------------------------------------------------- screen definitions

_AT = r"(?i)@\s+(\d+)\s*,\s*(\d+)\s+"


def screen_fields(lines: DataFrame) -> DataFrame:
    """Fields of screen definitions: screen number, name, label, place, picture, valid and when.

    A screen ends at READ, CLEAR, RETURN and the like, at a new title once it has
    fields, and at the first business command after its fields.
    """
    line = F.col("line")
    get = _AT + r"(?:SAY\s+['\"][^'\"]+['\"]\s+)?GET\s+([\w.]+)"
    say = _AT + r"SAY\s+['\"]([^'\"]+)['\"]"
    has_get = line.rlike(get)
    title = F.regexp_extract(line, r"(?i)(?:TITLE|TITULO|CAPTION)\s+['\"]([^'\"]+)['\"]", 1)
    end = F.trim(line).rlike(r"(?i)^(?:READ|CLEAR\s+GETS?|CLEAR\s+SCREEN|CLS|RETURN|DEFINE\s+WINDOW)\b")
    business = F.trim(line).rlike(r"(?i)^(?:USE|INSERT|APPEND|REPLACE|SEEK|SELECT|DO\s|IF\s|SCAN)\b")
    kind = F.when(has_get, "field").when(end | business, "end").when(title != "", "title")
    hot = ordered.hot_keys(lines, ["file"], "line_no")
    state = ordered.scan(
        lines.withColumn("__kind", kind), ["file"], ["line_no"], hot,
        __before=ordered.last_known(F.col("__kind"), include_current=False),
        __label=ordered.last_known(F.when(line.rlike(say), F.regexp_extract(line, say, 3))),
        program=ordered.last_known(F.nullif(F.regexp_extract(line, r"(?i)(?:PROCEDURE|FUNCTION|PROGRAM)\s+(\w+)", 1), F.lit(""))),
    )
    closes = F.col("__kind").isin("end", "title") & (F.col("__before") == "field")
    numbered = ordered.scan(
        state.withColumn("__closes", F.when(closes, 1).otherwise(0).cast("long")), ["file"], ["line_no"], hot,
        screen_no=ordered.running_sum(F.col("__closes")),
    )
    raw = F.regexp_extract(line, get, 3)
    bare = F.when(F.contains(raw, F.lit(".")), F.substring(raw, F.instr(raw, ".") + 1, F.length(raw))).otherwise(
        F.when(raw.rlike("^[cndlmCNDLM][A-Z]"), F.concat(F.lower(F.substring(raw, 2, 1)), F.substring(raw, F.lit(3), F.length(raw)))).otherwise(raw)
    )
    inline = F.regexp_extract(line, say + r"\s+GET", 3)
    stop = r"(?=\s+(?:{0}|ERROR|MESSAGE|PICTURE|RANGE|COLOR)\b|$)"
    picture = F.coalesce(
        F.nullif(F.regexp_extract(line, r"(?i)PICTURE\s+(?:'([^']*)'|\"([^\"]*)\"|(@\S+))", 1), F.lit("")),
        F.nullif(F.regexp_extract(line, r"(?i)PICTURE\s+(?:'([^']*)'|\"([^\"]*)\"|(@\S+))", 2), F.lit("")),
        F.nullif(F.regexp_extract(line, r"(?i)PICTURE\s+(?:'([^']*)'|\"([^\"]*)\"|(@\S+))", 3), F.lit("")),
    )
    found = numbered.where(F.col("__kind") == "field").select(
        "file", "line_no", "screen_no", "program", bare.alias("field"),
        F.coalesce(F.nullif(inline, F.lit("")), "__label", bare).alias("label"),
        F.regexp_extract(line, get, 1).cast("int").alias("row"), F.regexp_extract(line, get, 2).cast("int").alias("col"),
        picture.alias("picture"),
        F.nullif(F.trim(F.regexp_extract(line, r"(?i)VALID\s+(.+?)" + stop.format("WHEN"), 1)), F.lit("")).alias("valid"),
        F.nullif(F.trim(F.regexp_extract(line, r"(?i)WHEN\s+(.+?)" + stop.format("VALID"), 1)), F.lit("")).alias("when"),
    )
    rest = [c for c in found.columns if c not in ("file", "screen_no")]
    return (
        found.groupBy("file", "screen_no", F.upper("field").alias("__name"))
        .agg(F.min_by(F.struct(*rest), "line_no").alias("f"))
        .select("file", "screen_no", "f.*")
    )


def menu_options(lines: DataFrame) -> DataFrame:
    """Numbered options painted on menu screens."""
    shape = r"(?i)@\s+\d+\s*,\s*\d+\s+SAY\s+['\"]\s*(\d+)\s*[\.\-\)]\s*([^'\"]*)['\"]"
    return lines.where(F.col("line").rlike(shape) & ~F.col("line").rlike(_AT + r"GET")).select(
        "file", "line_no", F.regexp_extract("line", shape, 1).cast("int").alias("option"),
        F.trim(F.regexp_extract("line", shape, 2)).alias("label"),
    )


def block_spans(lines: DataFrame, opens: str, closes: str, inside: str) -> DataFrame:
    """Blocks between an opening and a closing line with the commands counted inside.

    As in a reader with one open block, a new opening line restarts the block.
    """
    line = F.col("line")
    is_open, is_close = line.rlike(opens), line.rlike(closes)
    hot = ordered.hot_keys(lines, ["file"], "line_no")
    state = ordered.scan(
        lines.withColumn("__open", is_open).withColumn("__close", is_close & ~is_open), ["file"], ["line_no"], hot,
        __start=ordered.last_known(F.when(is_open, F.col("line_no"))),
        __shut=ordered.last_known(F.when(is_close & ~is_open, F.col("line_no")), include_current=False),
    )
    live = F.col("__start").isNotNull() & (F.coalesce("__shut", F.lit(-1)) < F.col("__start"))
    grouped = state.where(live).groupBy("file", F.col("__start").alias("start_line")).agg(
        F.min(F.when(F.col("__close"), F.col("line_no"))).alias("end_line"),
        F.count_if(line.rlike(inside) & ~F.col("__open") & ~F.col("__close")).alias("operations"),
    )
    return grouped.where(F.col("end_line").isNotNull())


BLOCKS = {
    "transaction": (r"(?i)BEGIN\s+TRANSACTION", r"(?i)\b(?:COMMIT|ROLLBACK|END\s+TRANSACTION)\b", r"(?i)(REPLACE|INSERT|UPDATE|DELETE|APPEND)\s"),
    "if": (r"(?i)^\s*IF\s+.+", r"(?i)^\s*ENDIF\b", r"(?i)DO\s+\w+"),
    "case": (r"(?i)^\s*DO\s+CASE\b", r"(?i)^\s*ENDCASE\b", r"(?i)DO\s+(?!CASE)\w+"),
    "loop": (r"(?i)^\s*(?:DO\s+WHILE|FOR)\s+.+", r"(?i)^\s*(?:ENDDO|ENDFOR|NEXT)\b", r"(?i)DO\s+(?!WHILE)\w+"),
}


#: Opening, dividing and closing lines of blocks that choose or repeat screens.
FLOWS = {
    "if": (r"(?i)IF\s+.+", r"(?i)\bELSE\b", r"(?i)\bENDIF\b|ENDI\b"),
    "do_case": (r"(?i)DO\s+CASE", r"(?i)CASE\s+.+$", r"(?i)\bENDCASE\b|ENDC\b"),
    "loop": (r"(?i)DO\s+WHILE\s+.+|(?:FOR|SCAN)\s+.+", r"(?!)", r"(?i)\bENDDO\b|ENDD\b"),
}


def flow_calls(lines: DataFrame, kind: str) -> DataFrame:
    """(file, start_line, end_line, branch, line_no, screen): the screens called in the branches of blocks.

    ``lines``: file, line_no, line; ``kind`` is a key of ``FLOWS``.  An opening line restarts the block,
    the first closing line ends it, and a block without one says nothing.  ELSE opens branch 1 of an
    IF, each CASE the next branch; a loop has branch 0.
    """
    opens, divides, closes = FLOWS[kind]
    line = F.col("line")
    is_open = line.rlike(opens) & (~line.rlike(closes) if kind == "if" else F.lit(True))
    is_divide, is_close = ~is_open & line.rlike(divides), ~is_open & ~line.rlike(divides) & line.rlike(closes)
    hot = ordered.hot_keys(lines, ["file"], "line_no")
    marked = lines.select("file", "line_no", "line", is_open.alias("opens"), is_divide.alias("divides"), is_close.alias("closes"))
    number = F.col("line_no")
    walked = ordered.scan(
        marked, ["file"], ["line_no"], hot, start_line=ordered.last_known(F.when(F.col("opens"), number)),
        shut=ordered.last_known(F.when(F.col("closes"), number), include_current=False), parts=ordered.running_sum(F.col("divides").cast("int")),
    )
    walked = ordered.scan(walked, ["file"], ["line_no"], hot, before=ordered.last_known(F.when(F.col("opens"), F.col("parts"))))
    inside = walked.where(F.col("start_line").isNotNull() & (F.coalesce("shut", F.lit(-1)) < F.col("start_line")))
    ended = inside.groupBy("file", "start_line").agg(F.min(F.when(F.col("closes"), number)).alias("end_line")).where(F.col("end_line").isNotNull())
    called = F.regexp_extract("line", PROGRAM_CALL, 1)
    branch = F.col("parts") - F.col("before")
    calls = inside.where(~F.col("opens") & ~F.col("divides") & ~F.col("closes") & (called != "")).select(
        "file", "start_line", (F.least(branch, F.lit(1)) if kind == "if" else branch).cast("long").alias("branch"), "line_no",
        F.upper(F.replace(called, F.lit("/"), F.lit("_"))).alias("screen"),
    )
    return calls.join(ended, ["file", "start_line"]).select("file", "start_line", "end_line", "branch", "line_no", "screen")


# ---------------------------------------------------------------- calls and coverage


def call_edges(files: DataFrame, shape: str = r"(?i)\bDO\s+(\w+(?:/\w+)*)") -> DataFrame:
    """Calls between programs, one row per call with its number of occurrences."""
    called = F.regexp_extract_all("text", F.lit(shape), F.lit(1))
    return (
        files.select("file", F.explode(called).alias("called"))
        .groupBy("file", "called")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


#: Rounds after which the pairs found are written together.
SHORT_PLAN = 16
PROGRAM_CALL = r"(?i)\bDO\s+(\w+(?:/\w+)*)"


def programs(files: DataFrame) -> DataFrame:
    """(program, title, options, text) of source files: name from the file, title from ``*PROG:`` or
    ``TITLE "…"``, and how many numbered options are painted."""
    stem = F.upper(F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[^.]+$", ""))
    marked, quoted = (F.trim(F.regexp_extract("text", shape, 1)) for shape in (r"\*PROG:\s*(.+)", r"(?i)(?:TITLE|TITULO|HEADER)\s+['\"]([^'\"]+)['\"]"))
    options = F.regexp_count("text", F.lit(r"(?i)@\s+\d+\s*,\s*\d+\s+SAY\s+['\"]\s*\d+\s*[\.\-\)]|\b(?:PROMPT|OPTION)\s+['\"][^'\"]+['\"]"))
    title = F.when(marked != "", marked).otherwise(quoted)
    return files.select(stem.alias("program"), title.alias("title"), options.cast("long").alias("options"), "text")


def program_calls(found: DataFrame) -> DataFrame:
    """(src, dst): which program calls which, once each; a call of itself says nothing."""
    called = F.transform(F.regexp_extract_all("text", F.lit(PROGRAM_CALL), F.lit(1)), lambda c: F.upper(F.regexp_extract(c, r"([^/]+)$", 1)))
    pairs = found.select(F.col("program").alias("src"), F.explode(F.array_distinct(called)).alias("dst"))
    return pairs.where((F.col("src") != F.col("dst")) & (F.col("dst") != "CASE") & (F.col("dst") != "WHILE")).distinct()


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node that calls lead to from a start, itself not counted unless a cycle leads back.

    Each round follows the calls of the pairs found last only, and pairs seen before are dropped, so a
    cycle of calls ends; there are as many rounds as the longest shortest way.
    """
    # merged, not broadcast: otherwise every round sends its calls or pairs through the driver
    edges = settle(edges.select("src", "dst").distinct()).hint("merge")
    fresh = settle(starts.select(F.col("node").alias("src")).distinct().join(edges, "src").select(F.col("src").alias("start"), F.col("dst").alias("node")))
    seen, rounds = fresh, 0
    while fresh.limit(1).count():
        further = fresh.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = settle(further.join(seen.hint("merge"), ["start", "node"], "left_anti"))
        # the rounds are stored already; they are written again only now and then, to keep the plan short
        seen, rounds = seen.unionByName(fresh), rounds + 1
        seen = settle(seen) if rounds % SHORT_PLAN == 0 else seen
    return seen


def program_index(files: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every program with its title, options, direct calls, programs reached and entities it touches
    itself or through them.  ``files``: file, text; ``mentions``: program, entity."""
    found = settle(programs(files))
    calls = settle(program_calls(found))
    ways = reached(calls, found.select(F.col("program").alias("node")))
    direct = calls.groupBy(F.col("src").alias("program")).agg(F.count(F.lit(1)).alias("calls"))
    far = ways.groupBy(F.col("start").alias("program")).agg(F.count(F.lit(1)).alias("reached"))
    own = found.select(F.col("program").alias("start"), F.col("program").alias("node"))
    named = mentions.select(F.col("program").alias("node"), "entity").distinct()
    touched = own.unionByName(ways).distinct().join(named.hint("merge"), "node")
    entities = touched.groupBy(F.col("start").alias("program")).agg(F.count_distinct("entity").alias("entities"))
    joined = found.drop("text")
    for part in (direct, far, entities):
        joined = joined.join(part.hint("merge"), "program", "left")
    return joined.fillna(0, ["calls", "reached", "entities"])


def module_journeys(files: DataFrame, most: int | None = None) -> DataFrame:
    """One journey per module (first three letters) with two or more programs that call others: the
    menu, then each program opened and filled in.  ``most`` bounds the programs of a journey."""
    found = settle(programs(files))
    calling = found.join(program_calls(found).select(F.col("src").alias("program")).distinct(), "program", "left_semi")
    named = calling.groupBy("program").agg(F.max("title").alias("title")).withColumn("module", F.lower(F.substring("program", 1, 3)))
    large = named.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("module")
    placed = ordered.scan(named.join(large, "module"), ["module"], ["program"], no=ordered.row_number())
    if most is not None:
        placed = placed.where(F.col("no") <= most)
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("program"))
    steps = F.array(*[F.struct((F.col("no") * 2 - 1 + k).alias("step_order"), F.lit(action).alias("action")) for k, action in enumerate(("navigate", "input"))])
    opened = placed.select("module", F.col("program").alias("screen_id"), shown.alias("screen_title"), F.explode(steps).alias("s"))
    menus = large.select(
        "module", F.concat(F.lit("menu_"), F.col("module")).alias("screen_id"), F.concat(F.lit("Menu "), F.upper("module")).alias("screen_title"),
        F.lit(0).cast("long").alias("step_order"), F.lit("navigate").alias("action"),
    )
    rows = opened.select("module", "screen_id", "screen_title", "s.step_order", "s.action").unionByName(menus)
    return rows.select(F.concat(F.lit("modulo_"), F.col("module")).alias("journey_id"), "step_order", "screen_id", "screen_title", "action")


# Commands by kind of access.
ACCESS_PATTERNS = {
    "create": r"(?i)\b(?:APPEND\s+BLANK|INSERT\s+INTO|CREATE)\b",
    "read": r"(?i)\b(?:SEEK|LOCATE|SELECT|SCATTER|FIND)\b",
    "update": r"(?i)\b(?:REPLACE|UPDATE|GATHER)\b",
    "delete": r"(?i)\b(?:DELETE|PACK|ZAP|ERASE)\b",
}


def program_terms(files: DataFrame, names: DataFrame) -> DataFrame:
    """Entity names that occur as words in each program, with the kinds of access it uses.

    Words are compared by equality, so the name list joins by key whatever its size.
    """
    words = F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    access = F.concat_ws(",", *[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in ACCESS_PATTERNS.items()])
    return (
        files.select("file", access.alias("access"), F.explode(words).alias("word"))
        .join(names.select(F.upper("name").alias("word")).distinct(), "word")
        .select("file", F.col("word").alias("entity"), "access")
    )


# Operations by kind of access and their weights in the score.
CRUD = {
    "create": (("insert", "append", "create"), 30),
    "read": (("select", "seek", "locate", "scatter", "find", "open", "reference"), 20),
    "update": (("update", "replace", "gather"), 25),
    "delete": (("delete", "pack", "zap", "erase"), 25),
}
READONLY_NAMES = "log|audit|histor|backup|temp|tmp|cache|config"
LOOKUP_NAMES = "tipo|status|categoria|unidade|uf|estado|cidade|param"


def crud_coverage(operations: DataFrame) -> DataFrame:
    """Kinds of access per entity with the weighted completeness; inferred parts count partly."""
    found = operations.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total_operations"),
        *[F.bool_or(F.lower("operation").isin(*ops)).alias(f"has_{kind}") for kind, (ops, _) in CRUD.items()],
    )
    low = F.lower("entity")
    readonly = low.rlike(READONLY_NAMES)
    lookup = ~readonly & low.rlike(LOOKUP_NAMES)
    weight = {k: w for k, (_, w) in CRUD.items()}
    have = {k: F.col(f"has_{k}") for k in CRUD}
    score = (
        F.when(have["create"], weight["create"]).when(lookup, weight["create"] * 0.8).otherwise(0)
        + F.when(have["read"], weight["read"]).when(F.col("total_operations") > 0, weight["read"] * 0.5).otherwise(0)
        + F.when(have["update"], weight["update"]).when(have["create"] & have["read"], weight["update"] * 0.3).otherwise(0)
        + F.when(have["delete"], weight["delete"]).when(readonly, weight["delete"] * 0.9).otherwise(0)
    )
    missing = F.concat_ws(",", *[F.when(~h, F.lit(k)) for k, h in have.items()])
    return found.withColumn("completeness_score", F.bround(score, 1)).withColumn("missing", missing).withColumn(
        "is_complete", F.col("completeness_score") >= 80
    )


def crud_summary(coverage: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return coverage.agg(
        total.alias("total_entities"),
        F.count_if("is_complete").alias("complete_crud"),
        F.count_if(~F.col("is_complete")).alias("partial_crud"),
        F.bround(F.count_if("is_complete") / total * 100, 1).alias("completeness_pct"),
        F.bround(F.sum(F.col("completeness_score").cast("decimal(12,1)")) / total, 1).cast("double").alias("avg_completeness_score"),
        *[F.count_if(~F.col(f"has_{k}")).alias(f"without_{k}") for k in CRUD],
    )


# Rank of storage kinds when sources disagree.
STORAGE_RANK = {"unknown": 0, "recital": 1, "dbf": 2, "isam": 3, "sql": 4}


def merge_entities(fields: DataFrame) -> DataFrame:
    """Fields of an entity over all files: first seen by name, with the strongest storage kind.

    ``fields``: entity, field, datatype, storage_type, file, line_no.
    """
    rank = F.coalesce(*[F.when(F.lower(F.trim("storage_type")) == s, r) for s, r in STORAGE_RANK.items()], F.lit(0))
    keyed = fields.withColumn("entity", F.upper("entity"))
    storage = keyed.groupBy("entity").agg(F.max_by("storage_type", F.struct(rank, F.col("storage_type"))).alias("storage_type"))
    first = keyed.groupBy("entity", F.upper("field").alias("name")).agg(
        F.min_by(F.struct("field", "datatype"), F.struct("file", "line_no")).alias("f"), F.count(F.lit(1)).alias("mentions")
    )
    return first.join(storage, "entity").select("entity", "f.field", "f.datatype", "storage_type", "mentions")


def program_catalog(bindings: DataFrame) -> DataFrame:
    """Every bound program with its module and how many entities, operations and bindings it has.

    ``bindings``: source_file, entity, operation.  Programs are named by their file without folder and
    ending, in capitals; of files with one name the last one counts.
    """
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"\.[^.]+$", "")
    named = bindings.where(F.coalesce("source_file", F.lit("")) != "").withColumn("program", F.upper(stem))
    kept = named.groupBy("program").agg(F.max("source_file").alias("source_file"))
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    counted = named.join(kept, ["program", "source_file"]).groupBy("program", "source_file").agg(
        F.count_distinct(F.upper(filled("entity"))).alias("entities"), F.count_distinct(filled("operation")).alias("operations"), F.count(F.lit(1)).alias("bindings")
    )
    return counted.withColumn("module", naming.module_prefix(F.col("program")))


def catalog_by_module(entries: DataFrame) -> DataFrame:
    """Programs and bindings of each module of a catalog."""
    return entries.groupBy("module").agg(F.count(F.lit(1)).alias("programs"), F.sum("bindings").alias("bindings"))


def catalog_by_entity(bindings: DataFrame, entries: DataFrame) -> DataFrame:
    """Programs, modules and operations of each entity of a catalog, by its name in capitals."""
    used = bindings.where(F.coalesce("entity", F.lit("")) != "").join(entries.select("source_file", "program", "module"), "source_file")
    return used.groupBy(F.upper("entity").alias("entity")).agg(
        F.count_distinct("program").alias("programs"), F.count_distinct("module").alias("modules"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("operation") != "", F.col("operation")))), ",").alias("operations"),
    )


def binding_bands(bindings: DataFrame) -> DataFrame:
    """Bindings per entity and confidence band."""
    band = F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.40, "medium").otherwise("low")
    return bindings.groupBy(
        F.coalesce(F.nullif("entity", F.lit("")), F.lit("(unbound)")).alias("entity"), band.alias("band")
    ).agg(F.count(F.lit(1)).alias("bindings"), F.count_distinct("program").alias("programs"))


def catalog_differences(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows only in one of two catalogs, marked added or removed; a key without value is in no other catalog."""
    sides = old.select(*keys, F.lit(True).alias("__old")).unionByName(new.select(*keys, F.lit(False).alias("__old")))
    found = sides.groupBy(*keys).agg(F.bool_or("__old").alias("__was"), F.bool_or(~F.col("__old")).alias("__is"))
    apart = F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x) | (F.col("__was") != F.col("__is"))
    changes = F.filter(F.array(F.when(F.col("__is"), "added"), F.when(F.col("__was"), "removed")), lambda x: x.isNotNull())
    return found.where(apart).select(*keys, F.explode(changes).alias("change"))


def route_coverage(route: DataFrame, reference: DataFrame) -> DataFrame:
    """Steps of a reference route found in a route, by lower-case title, per journey."""
    have = route.select("journey_id", F.lower(F.trim("title")).alias("t")).distinct().withColumn("hit", F.lit(True))
    steps = reference.select("journey_id", F.lower(F.trim("title")).alias("t"))
    return (
        steps.join(have, ["journey_id", "t"], "left")
        .groupBy("journey_id")
        .agg(F.count(F.lit(1)).alias("steps"), F.count("hit").alias("matched"))
        .withColumn("coverage_pct", F.bround(F.col("matched") / F.col("steps") * 100, 1))
    )


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """How many files two entities share, with the confidence of a relationship.

    ``mentions``: file, entity.  Files with the same set of entities are merged first and
    counted, so a set is paired once however often it occurs.  The partners of an entity
    are read from the merged set; sets are as long as one file's distinct entities.
    """
    sets = (
        mentions.distinct()
        .groupBy("file")
        .agg(F.array_sort(F.collect_set("entity")).alias("entities"))
        .groupBy("entities")
        .agg(F.count(F.lit(1)).alias("files"))
        .where(F.size("entities") > 1)
    )
    heads = sets.select("files", "entities", F.posexplode("entities").alias("place", "a"))
    pairs = heads.select("files", "a", F.explode(F.slice("entities", F.col("place") + 2, F.size("entities"))).alias("b"))
    return (
        pairs.groupBy("a", "b")
        .agg(F.sum("files").alias("files"))
        .withColumn("confidence", F.round(F.least(F.lit(0.85), F.col("files") * 0.05 + 0.40), 2))
    )
