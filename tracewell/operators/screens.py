"""Screens: error rules, mining of titles and fields, cells, differences, checkpoints."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions import text as tx
from tracewell.plans import ordered
from tracewell.plans.lineage import settle

# Error texts of the recorded systems (pattern, type, severity, description).
ERROR_RULES = (
    (r"erro fatal", "fatal", "critical", "Erro fatal do sistema"),
    (r"ocorreu um erro fatal", "fatal", "critical", "Erro fatal reportado pelo sistema"),
    (r"PANIC", "fatal", "critical", "Pânico do sistema"),
    (r"ABORT", "fatal", "critical", "Abortado pelo sistema"),
    (r"fatal error", "fatal", "critical", "Fatal error"),
    (r"(?:inválido|invalido|INVALIDO|INV[ÁA]LIDO)", "validation", "medium", "Dado inválido"),
    (r"ERROR\s+\[(.+?)\]", "validation", "medium", "Erro de validação: \\1"),
    (r"(?:deve ser|must be)\s+(.+)$", "validation", "medium", "Restrição: \\1"),
    (r"VALOR\s+(?:INV[ÁA]LIDO|INCORRETO|N[ÃA]O PERMITIDO)", "validation", "medium", "Valor rejeitado"),
    (r"PICTURE\s+.*ERROR", "validation", "medium", "Erro de formato/PICTURE"),
    (r"RANGE\s+.*ERROR", "validation", "medium", "Valor fora da faixa permitida"),
    (r"(?:não encontrad[oa]|n[ãa]o encontrad[oa]|not found)", "not_found", "low", "Registro não encontrado"),
    (r"(?:sem resultado|no hay|nenhum registro)", "not_found", "low", "Nenhum registro localizado"),
    (r"(?:n[ãa]o existe|does not exist)", "not_found", "low", "Entidade não existe"),
    (r"(?:n[ãa]o cadastrad[oa]|n[ãa]o localizad[oa])", "not_found", "low", "Registro não cadastrado"),
    (r"(?:acesso negado|permiss[ãa]o negada|access denied|permission denied)", "permission", "high", "Acesso negado"),
    (r"(?:sem permiss[ãa]o|not authorized|n[ãa]o autorizado)", "permission", "high", "Sem permissão"),
    (r"(?:usu[áa]rio sem acesso|user without access)", "permission", "high", "Usuário sem acesso"),
    (r"(?:registro bloqueado|record locked|arquivo em uso|file in use)", "lock", "medium", "Registro/arquivo bloqueado"),
    (r"(?:deadlock|bloqueio|LOCK)", "lock", "high", "Conflito de bloqueio"),
    (r"(?:exclusivo|exclusive)", "lock", "medium", "Arquivo requer acesso exclusivo"),
    (r"(?:timeout|tempo esgotado|time out|TIMEOUT)", "timeout", "high", "Timeout"),
    (r"(?:conex[ãa]o perdida|connection lost|link down)", "timeout", "critical", "Conexão perdida"),
    (r"(?:sem resposta|no response|n[ãa]o responde)", "timeout", "high", "Sem resposta"),
    (r"(?:duplicad[oa]|duplicate|j[áa] existe|already exists)", "data_error", "medium", "Registro duplicado"),
    (r"(?:integridade|integrity|viola[çc][ãa]o)", "data_error", "high", "Violação de integridade"),
    (r"(?:CHAVE\s+DUPLICADA|DUPLICATE\s+KEY)", "data_error", "high", "Chave duplicada"),
    (r"(?:FOREIGN\s+KEY|CHAVE\s+ESTRANGEIRA)", "data_error", "high", "Violação de chave estrangeira"),
    (r"(?:arquivo n[ãa]o encontrado|file not found|n[ãa]o foi possível abrir)", "data_error", "high", "Arquivo não encontrado"),
    (r"(?:erro de leitura|erro de grava[çc][ãa]o|read error|write error)", "data_error", "high", "Erro de I/O"),
    (r"(?:disco cheio|disk full|espa[çc]o insuficiente)", "data_error", "critical", "Disco cheio"),
    (r"(?:erro de sintaxe|syntax error|erro de compila[çc][ãa]o)", "fatal", "critical", "Erro de sintaxe"),
    (r"(?:vari[áa]vel n[ãa]o encontrada|variable not found)", "fatal", "critical", "Variável não encontrada"),
    (r"(?:ALIAS n[ãa]o encontrado|ALIAS not found)", "fatal", "critical", "Alias não encontrado"),
    (r"SUBSCRIPT OUT OF RANGE", "fatal", "critical", "Índice fora de faixa"),
    (r"DATATYPE MISMATCH", "data_error", "high", "Tipo de dado incompatível"),
    (r"END OF FILE ENCOUNTERED", "data_error", "medium", "Fim de arquivo inesperado"),
    (r"BEGINNING OF FILE ENCOUNTERED", "data_error", "medium", "Início de arquivo inesperado"),
    (r"RECORD OUT OF RANGE", "data_error", "medium", "Registro fora de faixa"),
    (r"WORKAREA NOT IN USE", "fatal", "critical", "Área de trabalho não está em uso"),
    (r"UNRECOGNIZED COMMAND", "fatal", "critical", "Comando não reconhecido"),
    (r"INSUFFICIENT MEMORY", "fatal", "critical", "Memória insuficiente"),
)
# Advice by error type.
SUGGESTIONS = {
    "not_found": "Verificar se o registro de referência existe antes desta operação",
    "permission": "Verificar permissões do usuário de replay",
    "lock": "Aguardar liberação do registro ou reduzir concorrência",
    "timeout": "Aumentar timeout ou verificar conectividade",
    "data_error": "Verificar unicidade/integridade dos dados gerados",
    "fatal": "Investigar causa raiz no sistema alvo - possível bug ou incompatibilidade",
}
# ignore case by Unicode rules; only a line feed ends a line
_FLAGS = "(?iud)"
SEVERITY_ORDER = ("critical", "high", "medium", "low")


def clean_screen(text: Column) -> Column:
    return F.regexp_replace(tx.unify_newlines(tx.strip_ansi(text)), " {2,}", " ")


def _folded(text: Column) -> Column:
    """Lower case for the cheap test (long s included), so that patterns need no flags."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))


def _literals(shape: str) -> list[str]:
    """For each way a pattern can match a text that stands in any such match; none where that is not plain to see."""
    low = shape.lower()
    group = re.match(r"\(\?:([^()]*)\)(?![?*{])", low)
    if not group and "|" in re.sub(r"\([^()]*\)", "", low):
        return []
    found = []
    for way in group[1].split("|") if group else [low]:
        parts = re.split(r"\(\?:[^()]*\)|\[[^\]]*\]|\\s\+|\.\*", way)
        if any(re.search(r"[\\^$.?*+{}()|\[\]]", p) for p in parts):
            start = re.match(r"[^\\^$.?*+{}()|\[\]]+(?=\\s)", way)
            parts = [start[0] if start else ""]
        if not any(parts):
            return []
        found.append(max(parts, key=len))
    return found


def _mentions(folded: Column, *shapes: str) -> Column:
    """Whether a pattern matches; a text without any of their literals is not searched."""
    whole = folded.rlike("(?d)" + "|".join(f"(?:{s.lower()})" for s in shapes))
    literals = [_literals(s) for s in shapes]
    if not all(literals):
        return whole
    some = [F.contains(folded, F.lit(x)) for x in dict.fromkeys(x for of in literals for x in of)]
    return functools.reduce(lambda a, b: a | b, some) & whole


def detect_errors(screens: DataFrame, text: str = "text") -> DataFrame:
    """One row per match of an error rule, with its line, field and advice.

    A screen without any match is dropped by one combined pattern before the single
    rules are tried; patterns in these tests are literals, so each compiles once.
    Positions and lines are only worked out for the rules that hit.
    A plain explode would have all patterns tried once more, to filter by the number of hits.
    """
    kept = [c for c in screens.columns if c != text]
    shapes = [r[0] for r in ERROR_RULES]
    suspects = (
        screens.select(*kept, clean_screen(F.col(text)).alias("__t"))
        .where(F.exists(F.array(_folded(F.col("__t"))), lambda folded: _mentions(folded, *shapes)))
    )
    # inside a lambda the folded text is made once, not for each pattern
    numbers = F.transform(
        F.array(_folded(F.col("__t"))),
        lambda folded: F.array_compact(F.array(*[F.when(_mentions(folded, s), no) for no, s in enumerate(shapes)])),
    )[0]

    def of_rule(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule_no"))

    shape = of_rule([_FLAGS + s for s in shapes])
    group = of_rule([1 if "\\1" in r[3] else 0 for r in ERROR_RULES])
    hits = (
        suspects.select(*kept, "__t", F.explode_outer(numbers).alias("rule_no"))
        .where(F.col("rule_no").isNotNull())
        .select(
            *kept, "__t", "rule_no",
            of_rule([r[1] for r in ERROR_RULES]).alias("error_type"),
            of_rule([r[2] for r in ERROR_RULES]).alias("severity"),
            of_rule([r[3] for r in ERROR_RULES]).alias("description"),
            F.regexp_extract_all("__t", shape, F.lit(0)).alias("hits"),
            F.regexp_extract_all("__t", shape, group).alias("details"),
            F.split("__t", shape, -1).alias("gaps"),
        )
        .select(
            *kept, "__t", "rule_no", "error_type", "severity", "description", "details", "hits", "gaps",
            F.posexplode_outer("hits").alias("match_no", "hit"),
        )
        .where(F.col("match_no").isNotNull())
    )
    upto = F.col("match_no") + 1
    before = F.aggregate(F.slice("gaps", F.lit(1), upto), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(
        F.slice("hits", F.lit(1), F.col("match_no")), F.lit(0), lambda a, x: a + F.length(x)
    )
    placed = hits.withColumn("__at", before)
    head = F.substring_index(F.substr("__t", F.lit(1), F.col("__at")), "\n", -1)
    rest = F.substring_index(F.substr("__t", F.col("__at") + F.length("hit") + 1), "\n", 1)
    line = tx.strip(F.concat(head, F.col("hit"), rest))
    field = F.regexp_extract("__line", r"(?iU)(?:campo|field|coluna|column)\s+['\"]?(\w+)", 1)
    advice = F.lit("Analisar mensagem de erro completa")
    for kind, words in SUGGESTIONS.items():
        advice = F.when(F.col("error_type") == kind, words).otherwise(advice)
    checked = F.when(
        F.col("field_name") != "", F.concat(F.lit("Verificar valor do campo '"), "field_name", F.lit("'"))
    ).otherwise("Verificar formato/tipo do dado informado")
    return (
        placed.withColumn("__line", line)
        .withColumn("field_name", field)
        .select(
            *kept, "rule_no", "match_no", "error_type", "severity",
            F.replace("description", F.lit("\\1"), F.get("details", F.col("match_no"))).alias("description"),
            F.left("__line", F.lit(200)).alias("line_text"),
            "field_name",
            F.when(F.col("error_type") == "validation", checked).otherwise(advice).alias("suggestion"),
        )
    )


def screen_errors(text: Column) -> Column:
    """Worst error of a screen as a struct, null when no rule matches."""
    ranked = sorted(range(len(ERROR_RULES)), key=lambda no: (SEVERITY_ORDER.index(ERROR_RULES[no][2]), no))

    def worst(folded: Column) -> Column:
        found = [
            F.when(
                _mentions(folded, ERROR_RULES[no][0]),
                F.struct(F.lit(ERROR_RULES[no][1]).alias("error_type"), F.lit(ERROR_RULES[no][2]).alias("severity")),
            )
            for no in ranked
        ]
        return F.when(_mentions(folded, *[r[0] for r in ERROR_RULES]), F.coalesce(*found))

    return F.transform(F.array(_folded(clean_screen(text))), worst)[0]


def classify_screens(screens: DataFrame, text: str = "text", expected: str = "expected_signature") -> DataFrame:
    """State of each screen: error, warning, navigation_divergence or ok."""
    found = screens.withColumn("__e", screen_errors(F.col(text)))
    clean = clean_screen(F.col(text))
    asked = F.coalesce(F.col(expected), F.lit("")) != ""
    login = clean.rlike(r"(?iu)(?:login|usu[áa]rio|senha|password|sign\s*on)")
    trouble = clean.rlike(r"(?iu)(?:erro|error|falha|n[ãa]o foi poss[íi]vel)")
    status = (
        F.when(F.col("__e").isNotNull(), "error")
        .when(asked & trouble, "warning")
        .when(asked & login & ~F.contains(F.lower(F.col(expected)), F.lit("menu")), "navigation_divergence")
        .otherwise("ok")
    )
    return (
        found.withColumn("status", status)
        .withColumn(
            "error_type",
            F.when(F.col("status") == "error", F.col("__e.error_type"))
            .when(F.col("status") == "warning", "possible_error")
            .when(F.col("status") == "navigation_divergence", "navigation_error")
            .otherwise(""),
        )
        .withColumn(
            "severity",
            F.when(F.col("status") == "error", F.col("__e.severity"))
            .when(F.col("status") == "warning", "low")
            .when(F.col("status") == "navigation_divergence", "high")
            .otherwise(""),
        )
        .drop("__e")
    )


# Shapes of prompts, bracket fields and menu options.
PROMPT_FIELDS = (r"(?U)(\w[\w\s]{1,30}):\s*[\._]{2,}", r"(?U)(\w[\w\s]{1,30})\s*\.\.\.\.\.+\s*\[?\s*\]?")
BRACKET_FIELD = r"(?U)\[(\w[\w\s]{1,30})\]\s*_+"
MENU_OPTION = r"(?Ud)(\d+)\.\s+(.+)"
MENU_WORDS = r"(?iu)(?:MENU|OP[ÇC][ÃA]O|OPCAO|SELECIONE|ESCOLHA)"
MENU_NUMBERS = r"(?U)\d+\s*[\.\-)]\s*\w+"


def is_menu(text: Column) -> Column:
    return text.rlike(MENU_WORDS) | text.rlike(MENU_NUMBERS)


def mine_screens(screens: DataFrame, text: str = "text") -> DataFrame:
    """Title, fields, menu options and size of each screen."""
    t = F.col(text)
    candidates = F.filter(
        F.transform(F.slice(F.split(t, "\n", -1), 1, 5), lambda x: tx.strip(x)),
        lambda x: (F.length(x) > 3) & ~x.rlike(r"\A[+\-|=]+\z"),
    )
    fields = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (*PROMPT_FIELDS, BRACKET_FIELD)])
    options = F.regexp_extract_all(t, F.lit(MENU_OPTION), F.lit(2))
    shown = F.filter(F.transform(F.split(t, "\n", -1), lambda x: tx.strip(x)), lambda x: x != "")
    return screens.select(
        *[c for c in screens.columns if c != text],
        F.left(F.coalesce(F.get(candidates, F.lit(0)), F.lit("")), F.lit(60)).alias("title"),
        F.transform(fields, lambda x: tx.strip(x)).alias("fields"),
        F.transform(options, lambda x: F.left(tx.strip(x), F.lit(40))).alias("menu_options"),
        is_menu(t).alias("is_menu"),
        F.concat(
            F.lit("L="), F.size(shown).cast("string"), F.lit(" W="),
            F.coalesce(F.array_max(F.transform(shown, lambda x: F.length(x))), F.lit(0)).cast("string"),
        ).alias("screen_signature"),
    )


# ---------------------------------------------------------------- signatures and checkpoints

COMPARISON_MODES = ("visual", "text", "semantic", "hybrid")


def comparison_mode(event: Column, session: Column, replay: Column, default: str = "visual") -> Column:
    """Effective mode: event before session before replay before the default."""

    def known(mode: Column) -> Column:
        clean = F.lower(F.trim(mode))
        return F.when(clean.isin(*COMPARISON_MODES), clean)

    return F.coalesce(known(event), known(session), known(replay), F.lit(default))


def compare_signatures(pairs: DataFrame, mode: Column) -> DataFrame:
    """Compare expected_* and observed_* signatures in the given mode.

    Single modes have no fallback.  Hybrid takes the highest level both sides have,
    the old screen signature last.
    """

    def have(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    levels = ("visual", "text", "semantic", "legacy_screen")
    out = F.lit(None).cast("struct<used:string,expected_sig:string,observed_sig:string>")
    for level in reversed(levels):
        want, got = have(f"expected_{level}_sig"), have(f"observed_{level}_sig")
        allowed = (mode == "hybrid") if level == "legacy_screen" else ((mode == level) | (mode == "hybrid"))
        used = "legacy_screen_sig" if level == "legacy_screen" else level
        out = F.when(
            allowed & want.isNotNull() & got.isNotNull(),
            F.struct(F.lit(used).alias("used"), want.alias("expected_sig"), got.alias("observed_sig")),
        ).otherwise(out)
    return (
        pairs.withColumn("comparison_mode_requested", mode)
        .withColumn("__c", out)
        .withColumn("comparison_mode_used", F.col("__c.used"))
        .withColumn("matched", F.coalesce(F.col("__c.expected_sig") == F.col("__c.observed_sig"), F.lit(False)))
        .withColumn(
            "fallback_reason",
            F.when(
                F.col("__c").isNull(),
                F.when(F.col("comparison_mode_requested") == "hybrid", "no_common_signature_level").otherwise(
                    F.concat("comparison_mode_requested", F.lit("_signature_missing"))
                ),
            ),
        )
        .drop("__c")
    )


def checkpoint_match(
    expected: Column, observed: Column, mode: str = "strict", threshold: float = 0.92, ignore_case: bool = False
) -> Column:
    """Whether an observed checkpoint meets the expected one (strict, contains, regex, fuzzy)."""
    want, got = tx.strip(F.coalesce(expected, F.lit(""))), tx.strip(F.coalesce(observed, F.lit("")))
    if ignore_case:
        want, got = F.lower(want), F.lower(got)
    if mode == "contains":
        return (want != "") & F.contains(got, want)
    if mode == "regex":
        return F.coalesce(F.regexp_like(got, want), F.lit(False))
    if mode == "fuzzy":
        return tx.similarity(want, got) >= max(0.0, min(1.0, threshold))
    return want == got


# Words that show a screen of the navigation.
NAVIGATION_WORDS = ("login", "menu", "erro", "opcao", "opção", "comando")


def classify_failure(
    expected: Column, observed: Column, timeout: Column, far_apart: Column
) -> tuple[Column, Column, Column]:
    """Type, severity and reason of a missed checkpoint.

    ``far_apart`` tells whether the run was concurrent and the texts share less than 0.35.
    """
    seen, want = F.lower(F.coalesce(observed, F.lit(""))), F.lower(F.coalesce(expected, F.lit("")))
    silent = timeout & (F.trim(seen) == "")
    navigated = seen.rlike("|".join(NAVIGATION_WORDS)) & (want != "") & (seen != want)
    cases = (
        (silent, "timeout", "critical", "checkpoint sem resposta observável dentro da janela"),
        (timeout, "timeout", "high", "checkpoint não estabilizou dentro da janela esperada"),
        (far_apart, "concurrency_error", "high", "divergência forte em modo concorrente"),
        (navigated, "navigation_error", "high", "sessão caiu em navegação diferente da esperada"),
    )
    out = [F.lit("screen_divergence"), F.lit("high"), F.lit("saída divergiu da tela esperada")]
    for test, *values in reversed(cases):
        out = [F.when(test, v).otherwise(o) for v, o in zip(values, out)]
    return out[0], out[1], out[2]


def checkpoint_failures(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected against observed checkpoints by session and sequence: one row per failure."""
    paired = expected.select("session_id", "seq_global", F.col("sig").alias("expected_value")).join(
        observed.select("session_id", "seq_global", F.col("sig").alias("observed_value"), F.lit(True).alias("__seen")),
        ["session_id", "seq_global"],
        "full",
    )
    missing = F.col("__seen").isNull()
    kind, severity, reason = classify_failure(
        F.col("expected_value"), F.col("observed_value"), missing | (F.coalesce("observed_value", F.lit("")) == ""), F.lit(False)
    )
    return (
        paired.where(F.col("expected_value").isNotNull())
        .where(~F.coalesce(F.col("expected_value") == F.col("observed_value"), F.lit(False)))
        .select(
            "session_id", "seq_global", kind.alias("failure_type"), severity.alias("severity"),
            F.coalesce("expected_value", F.lit("")).alias("expected_value"),
            F.coalesce("observed_value", F.lit("")).alias("observed_value"), reason.alias("message"),
        )
    )


def compare_baseline(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed screens against golden ones by journey and step; similarity only where they differ."""
    want = baseline.select("journey_id", "step_order", F.col("text").alias("__want"))
    joined = observed.join(want, ["journey_id", "step_order"], "left")
    known = F.col("__want").isNotNull()
    return joined.select(
        "journey_id", "step_order",
        F.when(known, F.sha2("__want", 256)).otherwise("").alias("expected_hash"),
        F.sha2("text", 256).alias("observed_hash"),
        (known & (F.sha2("__want", 256) == F.sha2("text", 256))).alias("matches"),
        F.when(known, F.bround(tx.similarity(F.coalesce("__want", F.lit("")), F.col("text")), 4)).otherwise(0.0).alias("similarity"),
        F.when(~known, "new").when(F.sha2("__want", 256) == F.sha2("text", 256), "match").otherwise("diverged").alias("state"),
    )


def baseline_summary(comparisons: DataFrame) -> DataFrame:
    """Matched and diverged screens of each journey; the diverged ones stay a table of their own."""
    return comparisons.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("total_screens"),
        F.count_if("matches").alias("matched"),
        F.count_if(~F.col("matches")).alias("diverged"),
        F.bool_or(~F.col("matches")).alias("is_regression"),
    )


def line_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and equal lines with the similarity of two texts (expected, observed)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for pdf in batches:
            rows = []
            for want, got in zip(pdf["expected"], pdf["observed"]):
                a, b = (want or "").split("\n"), (got or "").split("\n")
                diff = [
                    d for d in difflib.unified_diff(a, b, lineterm="") if not d.startswith(("---", "+++", "@@"))
                ]
                rows.append(
                    (
                        sum(d.startswith("+") for d in diff),
                        sum(d.startswith("-") for d in diff),
                        sum(d.startswith(" ") for d in diff),
                        round(difflib.SequenceMatcher(None, want or "", got or "").ratio(), 4),
                    )
                )
            counts = pd.DataFrame(rows, columns=["added", "removed", "equal", "similarity"], index=pdf.index)
            yield pd.concat([pdf[keys], counts], axis=1)

    clean = pairs.select(
        *keys,
        tx.unify_newlines(tx.strip_ansi(F.col("expected"))).alias("expected"),
        tx.unify_newlines(tx.strip_ansi(F.col("observed"))).alias("observed"),
    )
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clean.schema.fields if f.name in keys)
    return clean.mapInPandas(compare, f"{key_types}, added bigint, removed bigint, equal bigint, similarity double")


# ---------------------------------------------------------------- cells

FLAGS = ("bold", "dim", "underline", "blink", "reverse", "hidden")


SCREEN_STATE = ("rows", "cols", "cursor_row", "cursor_col")
STYLE = ("fg", "bg", *FLAGS)
#: The style of cells that a patch may take away.
GONE = (*STYLE, "gone")
#: Cells of screens that a task compares at a time (one pair of screens may hold more).
CELLS_AT_ONCE = 300_000


def _pack(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("session_id", "seq"), lists: tuple[str, ...] = ("row", "col"), looks: tuple[str, ...] = STYLE
) -> Iterator[pa.RecordBatch]:
    """One piece for cells of a screen that follow each other: numbers, characters, and styles written once."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        fresh, of_keys = np.zeros(n, bool), _codes([batch.column(k) for k in keys])
        fresh[1:] = of_keys[1:] != of_keys[:-1]
        fresh[0] = True
        starts, piece = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        ends = pa.array(np.append(starts, n), pa.int32())
        code = _codes([batch.column(c) for c in looks])
        _, code = np.unique(code, return_inverse=True)
        styles, first, style = np.unique(piece * n + code, return_index=True, return_inverse=True)
        of_piece = np.searchsorted(styles // n, np.arange(len(starts) + 1))
        worn = pa.StructArray.from_arrays([batch.column(c).take(pa.array(first)) for c in looks], list(looks))
        ch = batch.column("ch")
        yield pa.RecordBatch.from_pydict({
            **{k: batch.column(k).take(pa.array(starts)) for k in keys},
            **{c: pa.ListArray.from_arrays(ends, batch.column(c)) for c in lists},
            "text": pc.binary_join(pa.ListArray.from_arrays(ends, ch.fill_null("")), ""),
            "bytes": pa.ListArray.from_arrays(ends, pc.binary_length(ch).cast(pa.int32()).fill_null(-1)),
            "style": pa.ListArray.from_arrays(ends, pa.array(style - of_piece[piece], pa.int32())),
            "styles": pa.ListArray.from_arrays(pa.array(of_piece, pa.int32()), worn),
        })


def _parts(lists: list[T.StructField], looks: list[T.StructField]) -> list[T.StructField]:
    numbers = T.ArrayType(T.IntegerType())
    return [
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in lists],
        T.StructField("text", T.StringType()), T.StructField("bytes", numbers), T.StructField("style", numbers),
        T.StructField("styles", T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in looks]))),
    ]


def _packed(cells: DataFrame, keys: tuple[str, ...], lists: tuple[str, ...], looks: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Pieces of screens (``keys`` and parts) where their cells are, and the names of the parts."""
    kinds = cells.schema
    parts = _parts([kinds[c] for c in lists], [kinds[c] for c in looks])
    pack = functools.partial(_pack, keys=keys, lists=lists, looks=looks)
    pieces = cells.select(*keys, *lists, "ch", *looks).mapInArrow(pack, T.StructType([*[kinds[k] for k in keys], *parts]))
    return pieces, [p.name for p in parts]


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number per row, the same for rows that are equal in all columns; null is a value as well."""
    code, most = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        found = column.dictionary_encode("encode")
        if most * len(found.dictionary) >= 2**62:
            values, code = np.unique(code, return_inverse=True)
            most = len(values)
        code = code * len(found.dictionary) + found.indices.to_numpy()
        most *= max(1, len(found.dictionary))
    return code


def pack_screens(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per screen with its size and its cells in ``pieces``, a few bytes each.

    ``screen_signatures``, ``screen_changes`` and ``rebuild_screens`` take them for cells, which are then read once.
    """
    placed = cells.withColumn("place", F.col("row") * F.col("cols") + F.col("col"))
    pieces, parts = _packed(placed, (*keys, "rows", "cols"), ("row", "col", "place"), STYLE)
    # dealt before they are grouped: screens would otherwise be sorted where they are read as well
    return pieces.repartition(*keys).groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.max("cols").alias("cols"), F.collect_list(F.struct(*parts)).alias("pieces")
    )


def _unpack(pieces: pa.ListArray) -> dict:
    """The cells of screens in pieces; ``at`` is the place of their screen, ``style`` that of their style."""
    screen, parts = pc.list_parent_indices(pieces).to_numpy(), pieces.flatten()
    part = dict(zip((f.name for f in parts.type), parts.flatten(), strict=True))
    piece = pc.list_parent_indices(part["bytes"]).to_numpy()
    before = np.cumsum(np.append(0, pc.list_value_length(part["styles"]).to_numpy()))
    sizes = part["bytes"].flatten().to_numpy()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), part["text"]), "")[0].as_buffer()
    ends = np.append(0, np.cumsum(np.maximum(sizes, 0))).astype(np.int32)
    ch = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), joined)
    return {
        **{name: part[name].flatten() for name in part if name not in ("text", "bytes", "style", "styles")},
        "at": screen[piece], "ch": pc.if_else(pa.array(sizes >= 0), ch, pa.scalar(None, pa.string())),
        "style": before[piece] + part["style"].flatten().to_numpy(), "styles": part["styles"].flatten(),
    }


def _some_screens(batch: pa.RecordBatch, names: tuple[str, ...] = ("now", "old")) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about as many cells as are worked on at a time."""
    cells = np.zeros(batch.num_rows, np.int64)
    for name in names:
        pieces = batch.column(name)
        sizes = pc.list_value_length(pc.struct_field(pieces.flatten(), "bytes")).to_numpy()
        np.add.at(cells, pc.list_parent_indices(pieces).to_numpy(), sizes)
    part = np.cumsum(cells) // CELLS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, z - a)


BOX = re.compile("[┌┐└┘├┤┬┴┼─│]")


def _sha(*parts: str) -> str:
    return "sha256:" + hashlib.sha256("\n".join([*parts, ""]).encode()).hexdigest()


def _sign(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], text_magic: str, visual_magic: str) -> Iterator[pa.RecordBatch]:
    """Text and visual signatures of screens in pieces, and their lines."""
    for batch in (some for whole in batches for some in _some_screens(whole, ("pieces",))):
        held = _unpack(batch.column("pieces"))
        found, styles = held["ch"].dictionary_encode("encode"), held["styles"]
        chars, char = found.dictionary.to_pylist(), found.indices.to_numpy()
        codes = [None if c is None else "32" if c == "" else str(ord(c[0])) for c in chars]
        plain = np.array([c if c is None or not BOX.search(c) else "#" for c in chars], object)
        worn = [[w["fg"], w["bg"], str(sum(1 << k for k, f in enumerate(FLAGS) if w[f]))] for w in styles.to_pylist()]
        pairs, look = np.unique(char.astype(np.int64) * max(1, len(worn)) + held["style"], return_inverse=True)
        looks = np.array(["|".join(x for x in (codes[p // len(worn)], *worn[p % len(worn)]) if x is not None) for p in pairs.tolist()], object)
        codes = np.array(codes, object)
        place, line = (held[c].cast(pa.int64()) for c in ("place", "row"))
        known = place.is_valid().to_numpy(zero_copy_only=False)
        place, at = place.fill_null(0).to_numpy(), held["at"]
        order = np.lexsort((place, at))
        # cells that share a place, or have none, go on by what they show
        shared = (place[order][1:] == place[order][:-1]) & (at[order][1:] == at[order][:-1])
        unclear = {*at[~known].tolist(), *at[order][1:][shared].tolist()}
        bounds = np.searchsorted(at[order], np.arange(batch.num_rows + 1))
        signed: dict[str, list] = {"text_sig": [], "visual_sig": [], "lines": []}
        for no, (rows, cols) in enumerate(zip(batch.column("rows").to_pylist(), batch.column("cols").to_pylist(), strict=True)):
            cells = order[bounds[no] : bounds[no + 1]]
            if no in unclear:
                nulls = lambda x: (x is not None, x)
                full = lambda i: tuple(map(nulls, (int(place[i]) if known[i] else None, codes[char[i]], looks[look[i]], line[i].as_py(), plain[char[i]])))
                cells = np.array(sorted(cells.tolist(), key=full), np.int64)
            head = [str(x) for x in ("1", rows, cols, "utf-8", "xterm") if x is not None]
            shown = codes[char[cells]].tolist()
            signed["text_sig"].append(_sha(text_magic, *head, "\n".join(x for x in shown if x is not None)))
            signed["visual_sig"].append(_sha(visual_magic, *head, "\n".join(looks[look[cells]].tolist())))
            flat, wide = plain[char[cells]].tolist(), cols or 0
            signed["lines"].append(None if rows is None else ["".join(x for x in flat[r * wide : (r + 1) * wide] if x is not None) for r in range(rows)])
        lines = pa.array(signed.pop("lines"), pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in keys}, **{k: pa.array(v, pa.string()) for k, v in signed.items()}, "lines": lines})


def screen_signatures(
    cells: DataFrame, keys: list[str], text_magic: str = "SCREEN-TEXT", visual_magic: str = "SCREEN-VISUAL"
) -> DataFrame:
    """Text, visual and tolerant signatures of each snapshot.

    ``cells`` has rows, cols, row, col, ch, fg, bg and the flags.  A screen has at most
    100 000 cells, so one snapshot is a bounded group; its cells travel packed.  Screens of
    ``pack_screens`` are taken as well.
    """
    whole = cells if "pieces" in cells.columns else pack_screens(cells, keys)
    sign = functools.partial(_sign, keys=tuple(keys), text_magic=text_magic, visual_magic=visual_magic)
    whole = whole.select(*keys, "rows", "cols", "pieces")
    made = T.StructType([*[whole.schema[k] for k in keys], *[T.StructField(s, T.StringType()) for s in ("text_sig", "visual_sig")], T.StructField("lines", T.ArrayType(T.StringType()))])
    body = F.regexp_replace(F.array_join(F.transform("lines", tx.rstrip), "\n"), r"(?U)\A(?:\s*\n)+|(?:\n\s*)+\z", "")
    semantic = F.concat(F.lit("sha256:"), F.sha2(F.when(tx.is_blank(body), "").otherwise(body), 256))
    return whole.mapInArrow(sign, made).select(*keys, "text_sig", "visual_sig", semantic.alias("semantic_sig"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that differ between two screens: the new state (null: removed), and whether there was an old one."""
    for batch in (some for whole in batches for some in _some_screens(whole)):
        times = batch.column("times").to_numpy()
        cells = {name: _unpack(batch.column(name)) for name in ("now", "old")}
        sides = {}
        for name, held in cells.items():
            each = np.repeat(np.arange(len(held["at"])), times[held["at"]])
            sides[name] = pa.table({"at": held["at"][each], "row": held["row"].take(pa.array(each)), "col": held["col"].take(pa.array(each)), name: each})
        pairs = sides["now"].join(sides["old"], ["at", "row", "col"], join_type="full outer", use_threads=False).combine_chunks()
        both = cells["now"], cells["old"]
        style = _codes(pa.concat_arrays([held["styles"] for held in both]).flatten())
        style = style[np.concatenate([cells["now"]["style"], cells["old"]["style"] + len(cells["now"]["styles"])])]
        look = pa.array(_codes([pa.concat_arrays([held["ch"] for held in both]), pa.array(style)]))
        same = pc.equal(look.take(pairs["now"]), look.take(pc.add(pairs["old"], len(cells["now"]["at"]))))
        found = pairs.filter(pc.invert(same.fill_null(False))).combine_chunks()
        now, styles = found["now"].combine_chunks(), cells["now"]["styles"]
        worn = pa.array(cells["now"]["style"]).take(now)
        looks = [cells["now"]["ch"].take(now), *(part.take(worn) for part in styles.flatten())]
        keys = {k: batch.column(k).take(found["at"].combine_chunks()) for k in ("session_id", "base_seq", "seq")}
        yield pa.RecordBatch.from_pydict({
            **keys, "row": found["row"].combine_chunks(), "col": found["col"].combine_chunks(),
            "cell": pa.StructArray.from_arrays(looks, ["ch", *STYLE], mask=now.is_null()), "had": found["old"].combine_chunks().is_valid(),
        })


def _compare_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells that differ as pieces: the new state, and which cells are gone."""
    for found in _compare(batches):
        cell = found.column("cell")
        looks = {c: pc.struct_field(cell, c) for c in ("ch", *STYLE)}
        yield from _pack([pa.RecordBatch.from_pydict({
            **{c: found.column(c) for c in ("session_id", "base_seq", "seq", "row", "col")}, **looks, "gone": cell.is_null(),
        })], keys=("session_id", "base_seq", "seq"), looks=GONE)


def _changed_cells(order: DataFrame, cells: DataFrame, packed: bool) -> DataFrame:
    """(session_id, base_seq, seq, row, col, cell, had) of the cells that differ between two screens.

    Cells travel packed, a few bytes each: the cells of a screen that stand next to each other become
    a piece where they are, the pieces of a screen meet, and then those of both screens.  Rows that
    come several times count as in a join of all cells: ``times`` is how often a pair of screens does.
    ``packed``: (session_id, base_seq, seq, pieces) instead, as patches of ``_replay``.
    """
    if "pieces" in cells.columns:
        whole = cells.select("session_id", "seq", "pieces")
        held = cells.schema["pieces"].dataType.elementType
        kinds = {c: held[c].dataType.elementType for c in ("row", "col")} | {f.name: f.dataType for f in held["styles"].dataType.elementType} | {"ch": T.StringType()}
    else:
        kinds = {f.name: f.dataType for f in cells.schema}
        keyed = cells.where(F.col("session_id").isNotNull() & F.col("seq").isNotNull())
        pieces, parts = _packed(keyed, ("session_id", "seq"), ("row", "col"), STYLE)
        # dealt before they are grouped: screens would otherwise be sorted where they are read as well
        whole = pieces.repartition("session_id", "seq").groupBy("session_id", "seq").agg(F.collect_list(F.struct(*parts)).alias("pieces"))
    pairs = order.groupBy("session_id", "base_seq", "seq").agg(F.count(F.lit(1)).alias("times"))
    now = whole.withColumnRenamed("pieces", "now").join(pairs, ["session_id", "seq"]).withColumnRenamed("times", "n")
    old = whole.select("session_id", F.col("seq").alias("base_seq"), F.col("pieces").alias("old")).join(pairs, ["session_id", "base_seq"])
    both = now.join(old, ["session_id", "base_seq", "seq"], "full").withColumn("times", F.coalesce("n", "times")).drop("n")
    keys = [both.schema[k] for k in ("session_id", "base_seq", "seq")]
    if packed:
        parts = _parts([T.StructField(c, kinds[c]) for c in ("row", "col")], [T.StructField(c, kinds[c]) for c in STYLE] + [T.StructField("gone", T.BooleanType())])
        return both.mapInArrow(_compare_packed, T.StructType([*keys, *parts])).select("session_id", "base_seq", "seq", F.array(F.struct(*[p.name for p in parts])).alias("pieces"))
    cell = T.StructType([T.StructField(c, kinds[c]) for c in ("ch", *STYLE)])
    places = [T.StructField(c, kinds[c]) for c in ("row", "col")]
    return both.mapInArrow(_compare, T.StructType([*keys, *places, T.StructField("cell", cell), T.StructField("had", T.BooleanType())]))


def screen_changes(screens: DataFrame, cells: DataFrame, packed: bool = False) -> DataFrame:
    """The patch from each screen of a session to the next, one row per change.

    ``screens``: session_id, seq, rows, cols, cursor_row, cursor_col; ``cells``: session_id, seq, row,
    col, ch, fg, bg and the flags.  A change is ``geometry`` (rows and cols are the new ones),
    ``cursor`` (row and col are its place), or a cell that was ``added``, ``changed`` or ``removed``;
    a screen that shrinks removes the cells it loses, so that they do not come back when it grows.
    A screen has at most 100 000 cells, so one of them fits into a task.  With ``packed``, ``cells``
    is one row for all cells of a step, in ``pieces``; ``rebuild_screens`` reads both.
    """
    hot = ordered.hot_keys(screens, ["session_id"], "seq")
    frame = F.struct(*SCREEN_STATE)
    steps = ordered.scan(screens, ["session_id"], ["seq"], hot, base_seq=ordered.lag(F.col("seq")), was=ordered.lag(frame))
    steps = settle(steps.where(F.col("base_seq").isNotNull()))
    found = _changed_cells(steps.select("session_id", "base_seq", "seq"), cells, packed)
    none = F.lit(None).cast("int")
    if packed:
        found = found.select("session_id", "base_seq", "seq", F.lit("cells").alias("change"), none.alias("row"), none.alias("col"), "pieces", none.alias("rows"), none.alias("cols"))
        return _with_frames(found, steps, "pieces")
    kind = F.when(~F.col("had"), "added").when(F.col("cell").isNull(), "removed").otherwise("changed")
    of_cells = found.select("session_id", "base_seq", "seq", kind.alias("change"), "row", "col", "cell", none.alias("rows"), none.alias("cols"))
    return _with_frames(of_cells, steps, "cell")


def _with_frames(of_cells: DataFrame, steps: DataFrame, cell: str) -> DataFrame:
    """Changes of cells, then those of geometry and cursor."""
    none, no_cell = F.lit(None).cast("int"), F.lit(None).cast(of_cells.schema[cell].dataType).alias(cell)
    resized = steps.where((F.col("rows") != F.col("was.rows")) | (F.col("cols") != F.col("was.cols"))).select(
        "session_id", "base_seq", "seq", F.lit("geometry").alias("change"), none.alias("row"), none.alias("col"), no_cell, "rows", "cols"
    )
    moved = steps.where((F.col("cursor_row") != F.col("was.cursor_row")) | (F.col("cursor_col") != F.col("was.cursor_col"))).select(
        "session_id", "base_seq", "seq", F.lit("cursor").alias("change"), F.col("cursor_row").alias("row"), F.col("cursor_col").alias("col"),
        no_cell, none.alias("rows"), none.alias("cols"),
    )
    return of_cells.unionByName(resized).unionByName(moved)


def _frames(first: DataFrame, changes: DataFrame, targets: DataFrame) -> DataFrame:
    """Geometry and cursor of each session at its targets: the last ones set up to there."""
    size, place = F.struct("rows", "cols"), F.struct(F.col("row").alias("cursor_row"), F.col("col").alias("cursor_col"))
    none = F.lit(None)
    of_first = first.select("session_id", "seq", F.lit(0).alias("kind"), size.alias("size"), F.struct("cursor_row", "cursor_col").alias("cursor"))
    kinds = {"size": "struct<rows:int,cols:int>", "cursor": "struct<cursor_row:int,cursor_col:int>"}
    of_first = of_first.withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()})
    # written as two comparisons, of which the planner sees that no change of a cell meets them
    of_frames = (F.col("change") == "geometry") | (F.col("change") == "cursor")
    of_changes = changes.where(of_frames).groupBy("session_id", "seq").agg(
        F.max(F.when(F.col("change") == "geometry", size)).cast(kinds["size"]).alias("size"),
        F.max(F.when(F.col("change") == "cursor", place)).cast(kinds["cursor"]).alias("cursor"),
    )
    of_targets = targets.select("session_id", "seq", F.lit(1).alias("kind"), none.cast(kinds["size"]).alias("size"), none.cast(kinds["cursor"]).alias("cursor"))
    every = of_first.unionByName(of_changes.withColumn("kind", F.lit(0))).unionByName(of_targets)
    known = ordered.scan(every, ["session_id"], ["seq", "kind"], at_size=ordered.last_known(F.col("size")), at_cursor=ordered.last_known(F.col("cursor")))
    return known.where("kind = 1").select("session_id", "seq", "at_size.*", "at_cursor.*")


class _Shown:
    """The cells of one screen while patches are applied to it: a place has the cells of the last number that names it."""

    def __init__(self):
        self.chars, self.styles = {}, {}
        self.clear()

    def clear(self) -> None:
        self.cells = np.zeros((3, 0), np.int64)  # place, character, style
        self.patch, self.number = [], None
        if len(self.chars) + len(self.styles) > CELLS_AT_ONCE:
            self.chars, self.styles = {}, {}

    def add(self, number: int | None, cells: np.ndarray) -> None:
        """Cells of a patch; those of one number belong together."""
        if self.patch and number != self.number:
            self.apply()
        self.patch.append(cells)
        self.number = number

    def apply(self) -> None:
        if self.patch:
            new = np.concatenate(self.patch, axis=1)
            self.cells = np.concatenate([self.cells[:, ~np.isin(self.cells[0], new[0])], new], axis=1)
            self.patch = []

    def coded(self, known: dict, values: pa.Array) -> np.ndarray:
        """Numbers of values that hold while the screen does."""
        return np.array([known.setdefault(tuple(v.values()) if isinstance(v, dict) else v, len(known)) for v in values.to_pylist()], np.int64)


def _replay(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], frame: pa.Schema, ends: bool = False, packed: bool = False) -> Iterator[pa.RecordBatch]:
    """Cells of screens at their targets, from rows in order: patches (no ``is_target``) and targets.

    With ``ends`` there is a row of cells per key instead: the cells at the end of its patches, with those that are gone.
    With ``packed`` a target is one row, its cells a piece.  Only the screen of one key is held at a time.
    """
    if packed:
        for found in _replay(batches, keys, frame, ends):
            place = pc.add(pc.multiply(found.column("row"), found.column("cols")), found.column("col"))
            yield from _pack([found.append_column("place", place)], keys=tuple(frame.names), lists=("row", "col", "place"))
        return
    shown, now, out, held = _Shown(), None, [], 0

    def taken(row: dict) -> None:
        nonlocal held
        cells = shown.cells
        if not ends and cells.shape[1]:
            styles = list(shown.styles)
            there = ~np.array([s[-1] for s in styles], bool)[cells[2]]
            cells = cells[:, there]
        out.append((row, cells))
        held += cells.shape[1] + 1

    def made() -> pa.RecordBatch:
        nonlocal held
        every, sizes = np.concatenate([c for _, c in out], axis=1), [c.shape[1] for _, c in out]
        each = pa.array(np.repeat(np.arange(len(out)), sizes))
        rows = pa.RecordBatch.from_pylist([r for r, _ in out], frame)
        chars, styles = pa.array(list(shown.chars), pa.string()), list(shown.styles)
        worn = {c: pa.array([s[k] for s in styles], pa.string() if c in ("fg", "bg") else pa.bool_()) for k, c in enumerate(GONE)}
        style = pa.array(every[2])
        cells = {
            "row": pa.array((every[0] >> 32).astype(np.int32)), "col": pa.array((every[0] & 0xFFFFFFFF).astype(np.uint32).astype(np.int32)),
            "ch": chars.take(pa.array(every[1])), **{c: w.take(style) for c, w in worn.items() if ends or c != "gone"},
        }
        out.clear()
        held = 0
        return pa.RecordBatch.from_pydict({**{n: rows.column(n).take(each) for n in frame.names}, **cells})

    for batch in (some for whole in batches for some in _some_screens(whole, ("pieces",))):
        cells = _unpack(batch.column("pieces"))
        found = cells["ch"].dictionary_encode("encode")
        row, col = (cells[c].cast(pa.int64()) for c in ("row", "col"))
        placed = pc.and_(row.is_valid(), col.is_valid()).to_numpy(zero_copy_only=False)
        places = (row.fill_null(0).to_numpy() << 32) | (col.fill_null(0).to_numpy() & 0xFFFFFFFF)
        bounds = np.searchsorted(cells["at"], np.arange(batch.num_rows + 1))
        chars = styles = None
        rows = batch.select([n for n in batch.schema.names if n != "pieces"]).to_pylist()
        for no, row in enumerate(rows):
            key = tuple(row[k] for k in keys)
            if key != now:
                if ends and now is not None:
                    shown.apply()
                    taken(dict(zip(keys, now, strict=True)))
                if out and len(shown.chars) + len(shown.styles) > CELLS_AT_ONCE:
                    yield made()
                before = shown.chars
                shown.clear()
                if shown.chars is not before:
                    chars = styles = None
                now = key
            if chars is None:
                chars, styles = shown.coded(shown.chars, found.dictionary), shown.coded(shown.styles, cells["styles"])
            a, z = bounds[no], bounds[no + 1]
            if row["is_target"] == 0:
                patch = np.stack([places[a:z], chars[found.indices.to_numpy()[a:z]], styles[cells["style"][a:z]]])
                shown.add(row["seq"], patch[:, placed[a:z]])
            elif not ends:
                shown.apply()
                taken({n: row[n] for n in frame.names})
            if held >= CELLS_AT_ONCE:
                yield made()
    if ends and now is not None:
        shown.apply()
        taken(dict(zip(keys, now, strict=True)))
    if out:
        yield made()


def _replayed(rows: DataFrame, frame: list[str], keys: list[str], order: list[Column], ends: bool = False, packed: bool = False) -> DataFrame:
    """The cells that ``_replay`` finds, beside the columns ``frame`` of their target or key."""
    whole = rows.select(*dict.fromkeys([*keys, "seq", "is_target", *frame]), "pieces")
    fields = T.StructType([whole.schema[c] for c in frame])
    cells = [T.StructField(c, T.IntegerType()) for c in ("row", "col")] + [T.StructField(c, T.StringType()) for c in ("ch", "fg", "bg")]
    flags = [T.StructField(c, T.BooleanType()) for c in (*FLAGS, *(["gone"] if ends else []))]
    replay = functools.partial(_replay, keys=tuple(keys), frame=to_arrow_schema(fields), ends=ends, packed=packed)
    sorted_rows = whole.repartition(*keys).sortWithinPartitions(*keys, *order)
    if packed:
        parts = _parts([T.StructField(c, T.IntegerType()) for c in ("row", "col", "place")], [*cells[3:], *flags])
        found = sorted_rows.mapInArrow(replay, T.StructType([*fields, *parts]))
        return found.select(*frame, F.array(F.struct(*[p.name for p in parts])).alias("pieces"))
    return sorted_rows.mapInArrow(replay, T.StructType([*fields, *cells, *flags]))


def _as_pieces(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Patches for ``_replay``, one row for cells of a screen that follow each other."""
    pieces, parts = _packed(cells, keys, ("row", "col"), GONE)
    return pieces.select(*keys, F.lit(0).alias("is_target"), F.array(F.struct(*parts)).alias("pieces"))


def _with_starts(rows: DataFrame, cuts: ordered.Cuts) -> DataFrame:
    """``rows`` with the range of their session, and before each range the cells that it starts from.

    Ranges are replayed on their own first: the cells at their ends are patches of a session that has a
    number per range, and the targets of that session are the ranges.
    """
    ranged = ordered.with_range(rows, ["session_id"], ["seq"], cuts).withColumnRenamed("__range", "range")
    cut = ranged.where(F.col("range") > 0)
    ends = _replayed(cut.where("is_target = 0"), ["session_id", "range"], ["session_id", "range"], [F.col("seq")], ends=True)
    marks = cut.select("session_id", F.col("range").alias("seq")).distinct().withColumn("is_target", F.lit(1))
    patches = _as_pieces(ends.withColumnRenamed("range", "seq"), ("session_id", "seq"))
    both = patches.unionByName(marks, allowMissingColumns=True).withColumn("pieces", F.coalesce("pieces", F.array().cast(patches.schema["pieces"].dataType)))
    # a range starts from what those before it left
    begun = _replayed(both, ["session_id", "seq"], ["session_id"], [F.col("seq"), F.col("is_target").desc()])
    starts = _as_pieces(begun.withColumnRenamed("seq", "range").withColumn("gone", F.lit(False)), ("session_id", "range"))
    return ranged.unionByName(starts, allowMissingColumns=True)


def rebuild_screens(first: DataFrame, first_cells: DataFrame, changes: DataFrame, targets: DataFrame, packed: bool = False) -> DataFrame:
    """Cells, geometry and cursor of each session at all of its targets, in one pass over the patches.

    ``first`` and ``first_cells`` are the first screen of each session, ``targets`` the (session_id,
    seq) to rebuild.  Patches travel packed and are applied in the order of their session, of which a
    task holds one screen; a session above the row limit is cut into ranges.  With ``packed`` a
    target is one row, as ``pack_screens`` gives them.
    """
    wanted = targets.select("session_id", "seq").distinct()
    none = F.lit(None).cast("int")
    patches = _patches(first_cells).unionByName(_patches(changes))
    frames = _frames(first, changes, wanted).where(F.col("session_id").isNotNull() & F.col("seq").isNotNull())
    marks = frames.select("session_id", "seq", *SCREEN_STATE, F.lit(1).alias("is_target"), F.array().cast(patches.schema["pieces"].dataType).alias("pieces"))
    rows = settle(marks.unionByName(patches.select("*", *[none.alias(c) for c in SCREEN_STATE])))
    cuts, order, keys = ordered.hot_keys(rows, ["session_id"], "seq"), [F.col("seq"), F.col("is_target")], ["session_id"]
    if cuts.table is not None:
        rows, keys = _with_starts(rows, cuts), ["session_id", "range"]
    return _replayed(rows, ["session_id", "seq", *SCREEN_STATE], keys, order, packed=packed)


def _patches(cells: DataFrame) -> DataFrame:
    """Patches for ``_replay`` from a first screen or from changes, packed or not."""
    known = F.col("session_id").isNotNull() & F.col("seq").isNotNull()
    if "pieces" in cells.columns:
        worn = lambda s: F.struct(*[s[c].alias(c) for c in STYLE], (s["gone"] if "change" in cells.columns else F.lit(False)).alias("gone"))
        if "change" in cells.columns:
            cells = cells.where("change = 'cells'")
        each = cells.where(known).select("session_id", "seq", F.explode("pieces").alias("p"))
        parts = [F.col(f"p.{c}") for c in ("row", "col", "text", "bytes", "style")]
        return each.select("session_id", "seq", F.lit(0).alias("is_target"), F.array(F.struct(*parts, F.transform("p.styles", worn).alias("styles"))).alias("pieces"))
    look = F.struct("ch", *STYLE).alias("cell")
    states = cells.where(F.col("change").isin("added", "changed", "removed")) if "change" in cells.columns else cells.withColumn("cell", look)
    placed = states.where(known & F.col("row").isNotNull() & F.col("col").isNotNull())
    flat = placed.select("session_id", "seq", F.col("row").cast("int"), F.col("col").cast("int"), "cell.*", F.col("cell").isNull().alias("gone"))
    return _as_pieces(flat, ("session_id", "seq"))


SIGNATURES = ("text", "visual", "semantic")


def verify_screens(rebuilt: DataFrame, expected: DataFrame, frame: tuple[str, ...] = ()) -> DataFrame:
    """Verdict per expected screen: whether it is what was recorded, else the first signature that differs.

    ``frame`` names columns that are the same in all cells of a screen; they come out beside the
    verdict, from the one pass over the cells.

    ``rebuilt`` comes from ``rebuild_screens``; ``expected``: session_id, seq and the signatures
    recorded for it.  A screen that could not be rebuilt is ``missing``.
    """
    kept = [f"frame_{c}" for c in frame]
    found = screen_signatures(rebuilt.withColumns({k: F.col(c) for k, c in zip(kept, frame, strict=True)}), ["session_id", "seq", *kept])
    found = found.select(
        "session_id", "seq", F.lit(True).alias("here"), *[F.col(f"{s}_sig").alias(f"now_{s}") for s in SIGNATURES],
        *[F.col(k).alias(c) for k, c in zip(kept, frame, strict=True)],
    )
    joined = expected.join(found, ["session_id", "seq"], "left")
    differs = [F.when(~F.col(f"{s}_sig").eqNullSafe(F.col(f"now_{s}")), s) for s in SIGNATURES]
    rejected = F.when(F.col("here").isNull(), "missing").otherwise(F.coalesce(*differs))
    return joined.select("session_id", "seq", rejected.isNull().alias("verified"), rejected.alias("rejected"), *frame)


def terminal_geometry(events: DataFrame) -> DataFrame:
    """Rows, columns and source per session: start event, else last valid resize, else 25 × 80.

    Events carry session_id, seq_global, type, dir, data_b64, rows, cols and encoding.
    """
    valid = (F.col("rows").between(1, 200)) & (F.col("cols").between(1, 500)) & (F.col("rows") * F.col("cols") <= 100_000)
    is_start = F.col("type") == "session_start"
    out = F.when((F.col("type") == "bytes") & (F.col("dir") == "out"), F.expr("try_to_binary(data_b64, 'base64')"))
    text = F.decode(out, "ISO-8859-1")
    shape = r"\x1b\[8;(\d+);(\d+)t"
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(shape), F.lit(1)), F.regexp_extract_all(text, F.lit(shape), F.lit(2)),
        lambda r, c: F.struct(r.try_cast("int").alias("rows"), c.try_cast("int").alias("cols")),
    )
    fitting = F.filter(
        pairs, lambda p: p["rows"].between(1, 200) & p["cols"].between(1, 500) & (p["rows"] * p["cols"] <= 100_000)
    )
    resize = F.try_element_at(fitting, F.lit(-1))
    facts = events.withColumn("__resize", resize).groupBy("session_id").agg(
        F.min_by(F.struct("rows", "cols", valid.alias("ok"), "encoding"), F.when(is_start, F.col("seq_global"))).alias("s"),
        F.max_by(F.col("__resize"), F.when(F.col("__resize").isNotNull(), F.col("seq_global"))).alias("r"),
    )
    from_start = F.coalesce(F.col("s.ok"), F.lit(False))
    requested = F.lower(F.trim(F.coalesce("s.encoding", F.lit(""))))
    return facts.select(
        "session_id",
        F.when(from_start, F.col("s.rows")).otherwise(F.coalesce("r.rows", F.lit(25))).alias("rows"),
        F.when(from_start, F.col("s.cols")).otherwise(F.coalesce("r.cols", F.lit(80))).alias("cols"),
        F.when(from_start, "session_metadata").when(F.col("r").isNotNull(), "resize_event").otherwise("legacy_fallback").alias("geometry_source"),
        tx.normalize_charset(requested).alias("encoding"),
        F.when(requested == "", "default").when(requested.isin(*tx.CHARSETS), "session_metadata").otherwise("fallback").alias("encoding_source"),
    )


def decoded_output(events: DataFrame, encoding: Column) -> DataFrame:
    """Text of every byte event; a character split over events appears with its last byte.

    At most three earlier events can hold the open start of a character, so three
    neighbours are enough and no session is gathered.
    """
    raw = events.withColumn("__raw", F.expr("try_to_binary(data_b64, 'base64')")).where(F.octet_length("__raw") > 0)
    placed = ordered.scan(
        raw.withColumn("__enc", encoding), ["session_id", "dir"], ["seq_global"], __pos=ordered.row_number()
    )
    tail = F.struct("__pos", F.hex(F.substr("__raw", F.greatest(F.octet_length("__raw") - 2, F.lit(1)))).alias("h"))
    near = ordered.neighbours(placed, ["session_id", "dir"], "__pos", 3, 0, __near=F.collect_list(tail))
    earlier = F.array_join(
        F.transform(F.array_sort(F.filter("__near", lambda x: x["__pos"] < F.col("__pos"))), lambda x: x["h"]), ""
    )
    last_three = F.unhex(F.regexp_extract(earlier, r"(.{0,6})$", 1))
    utf8 = F.col("__enc") == "utf-8"
    pending = F.when(utf8, tx.open_tail(last_three)).otherwise(F.unhex(F.lit("")))
    full = F.concat(pending, F.col("__raw"))
    closed = F.when(
        utf8, F.unhex(F.regexp_replace(F.hex(full), tx._OPEN_CHARACTER, ""))
    ).otherwise(full)
    return near.select("session_id", "dir", "seq_global", tx.decode_bytes(closed, F.col("__enc")).alias("text"))


CHECKPOINT_EVENTS = 250
CHECKPOINT_MS = 3000


def place_checkpoints(outputs: DataFrame, limit: int | None = None) -> DataFrame:
    """Which output events of a session get a full checkpoint, with the reason.

    ``outputs`` has session_id, seq_global, ts_ms and the flags reset, resize and clear.
    The first event, every 250th and resets, resizes and clears are fixed picks.  The
    rule "three seconds after the last pick" only looks back to the latest fixed pick,
    so it folds over stretches of at most 250 events, all independent of each other.
    ``limit`` keeps so many per session, as a player may show; without it all are kept.
    """
    hot = ordered.hot_keys(outputs, ["session_id"], "seq_global")
    numbered = ordered.scan(outputs, ["session_id"], ["seq_global"], hot, out_no=ordered.row_number())
    fixed = (
        F.when(F.col("reset"), "ris")
        .when(F.col("resize"), "resize")
        .when(F.col("clear"), "clear_screen")
        .when(F.col("out_no") == 1, "session_start")
        .when(F.col("out_no") % CHECKPOINT_EVENTS == 0, "interval_events")
    )
    stretched = ordered.scan(
        numbered.withColumn("fixed", fixed), ["session_id"], ["seq_global"], hot,
        stretch=ordered.running_sum(F.when(F.col("fixed").isNotNull(), 1).otherwise(0)),
    )
    event = F.struct("seq_global", "ts_ms", "fixed")
    pick_type = "array<struct<seq_global:bigint,ts_ms:bigint,reason:string>>"

    def step(state: Column, e: Column) -> Column:
        reason = F.coalesce(e["fixed"], F.when(e["ts_ms"] - state["last"] >= CHECKPOINT_MS, "interval_time"))
        taken = F.array(F.struct(e["seq_global"].alias("seq_global"), e["ts_ms"].alias("ts_ms"), reason.alias("reason")))
        return F.struct(
            F.when(reason.isNotNull(), e["ts_ms"]).otherwise(state["last"]).alias("last"),
            F.when(reason.isNotNull(), F.concat(state["picks"], taken)).otherwise(state["picks"]).alias("picks"),
        )

    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast(pick_type).alias("picks"))
    picks = (
        stretched.groupBy("session_id", "stretch")
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
        .select("session_id", F.explode(F.aggregate("events", start, step)["picks"]).alias("p"))
        .select("session_id", "p.*")
    )
    if limit is None:
        return picks
    ranked = ordered.scan(picks, ["session_id"], ["seq_global"], hot, place=ordered.row_number())
    return ranked.where(F.col("place") <= limit).drop("place")
