"""What a typed value or a field name stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import strip

CPF = r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$"
CNPJ = r"^\d{2}\.?\d{3}\.?\d{3}/\d{4}-?\d{2}$"
PHONE = r"^\(?\d{2}\)?\s?\d{4,5}-?\d{4}$"
POSTCODE = r"^\d{5}-?\d{3}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
NUMBER = r"^[\d.,]+$"


def placeholder_for(value: Column) -> Column:
    """Placeholder suggested by the shape of an input."""
    v = strip(value)
    return (
        F.when(v.rlike(CPF), "{{cliente.cpf}}")
        .when(v.rlike(CNPJ), "{{cliente.cnpj}}")
        .when(v.rlike(PHONE), "{{cliente.telefone}}")
        .when(v.rlike(POSTCODE), "{{cliente.cep}}")
        .when(v.rlike(ISO_DATE), "{{data}}")
        .when(v.rlike(NUMBER), "{{valor}}")
        .when(F.contains(v, F.lit("@")) & F.contains(v, F.lit(".")), "{{cliente.email}}")
        .otherwise("{{texto}}")
    )


def value_type(value: Column) -> Column:
    """Type of an input value (sixteen classes, first rule wins)."""
    v = strip(value)
    return (
        F.when(v.startswith("{KEY:"), "key_marker")
        .when(v == "\x1b", "key_esc")
        .when(v.rlike(r"(?i)^F\d{1,2}$"), "key_function")
        .when(v.startswith("\x1b["), "key_sequence")
        .when(v.rlike(r"^[SsNn]$"), "confirm")
        .when(v.rlike(r"^\d{1,2}$"), "menu_option")
        .when(v.rlike(CPF), "cpf")
        .when(v.rlike(CNPJ), "cnpj")
        .when(v.rlike(PHONE), "phone")
        .when(v.rlike(POSTCODE), "cep")
        .when(v.rlike(ISO_DATE) | v.rlike(r"^\d{2}/\d{2}/\d{4}$"), "date")
        .when(F.contains(v, F.lit("@")) & F.contains(F.substring_index(v, "@", -1), F.lit(".")), "email")
        .when(v.rlike(NUMBER), "number")
        .when(F.length(v) > 30, "text_long")
        .otherwise("text")
    )


def is_key_command(value: Column) -> Column:
    """True for keys and control sequences, false for data."""
    v = strip(value)
    blank_key = value.isin("\r", "\n", "\r\n")
    return F.when(v == "", blank_key).otherwise(
        v.startswith("{KEY:") | (v == "\x1b") | v.rlike(r"(?i)^F\d{1,2}$") | v.startswith("\x1b[")
    )


# Parts of a field name and the meaning they give, first hit wins.
NAME_MEANINGS = (
    (("cpf",), "cpf"),
    (("cnpj",), "cnpj"),
    (("telefone", "fone", "tel", "celular", "cel"), "phone"),
    (("email", "mail"), "email"),
    (("cep",), "cep"),
    (("data", "dt_", "^dt"), "date"),
    (("nome", "name", "razao", "fantasia"), "person_name"),
    (("endereco", "end", "logradouro", "rua"), "address"),
    (("valor", "preco", "total", "vlr"), "number"),
    (("qtd", "qtde", "quantidade"), "number"),
)


def field_meaning(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("text")
    for parts, meaning in reversed(NAME_MEANINGS):
        out = F.when(low.rlike("|".join(parts)), meaning).otherwise(out)
    return out


# Whole field names by format.
NAME_FORMATS = (
    (("CPF",), "cpf"),
    (("CNPJ", "CGC"), "cnpj"),
    (("EMAIL", "E_MAIL", "E-MAIL", "MAIL"), "email"),
    (("TELEFONE", "FONE", "CELULAR", "WHATSAPP", "TEL", "CEL"), "phone"),
    (
        ("VALOR", "PRECO", "PREÇO", "TOTAL", "SALDO", "LIMITE", "CUSTO", "DESCONTO", "QUANTIDADE", "QTD", "QTDE",
         "PESO", "PERCENTUAL", "ALIQUOTA", "TAXA", "JUROS", "MULTA", "SUBTOTAL", "FRETE"),
        "decimal",
    ),
    (("NOME", "NOME_CLIENTE", "CONTATO", "CLIENTE"), "person_name"),
    (("RAZAO_SOCIAL", "FANTASIA", "EMPRESA"), "company_name"),
    (("ENDERECO", "ENDEREÇO", "LOGRADOURO", "RUA", "BAIRRO", "CIDADE", "CEP", "UF"), "address"),
    (("DESCRICAO", "DESCRIÇÃO", "DESCR", "OBS", "OBSERVACAO", "COMPLEMENTO", "DETALHE"), "description"),
)


def field_format(name: Column, value_kind: Column) -> Column:
    """Format of a field by its whole name, else by the type of its values."""
    upper = F.upper(F.trim(name))
    out = (
        F.when(value_kind.isin("cpf", "cnpj", "email", "phone"), value_kind)
        .when(value_kind == "number", "decimal")
        .when(value_kind.isin("text", "text_long"), "person_name")
        .otherwise("text")
    )
    for names, fmt in reversed(NAME_FORMATS):
        out = F.when(upper.isin(*names), fmt).otherwise(out)
    return out


# Realistic ranges of amount fields.
NAME_RANGES = (
    (("VALOR", "PRECO", "PREÇO", "CUSTO"), 1.0, 9999.99),
    (("QUANTIDADE", "QTD", "QTDE"), 1.0, 999.0),
    (("PERCENTUAL", "DESCONTO", "ALIQUOTA", "TAXA", "JUROS"), 0.0, 100.0),
    (("TOTAL", "SALDO", "LIMITE", "SUBTOTAL", "FRETE"), 0.0, 999999.99),
)


def field_range(name: Column) -> tuple[Column, Column]:
    upper = F.upper(F.trim(name))
    low = high = F.lit(None).cast("double")
    for names, lo, hi in NAME_RANGES:
        low, high = F.when(upper.isin(*names), lo).otherwise(low), F.when(upper.isin(*names), hi).otherwise(high)
    return low, high


# Hints of a field name for its data type, in order.
TYPE_HINTS = (
    ("CPF", "cpf"), ("CNPJ", "cnpj"), ("RG", "rg"), ("IE", "text"), ("CARGO", "text"), ("NOME", "person_name"),
    ("RAZAO", "company_name"), ("FANTASIA", "company_name"), ("EMAIL", "email"), ("E_MAIL", "email"),
    ("TELEFONE", "phone"), ("FONE", "phone"), ("CELULAR", "phone"), ("CEP", "cep"), ("ENDERECO", "address"),
    ("LOGRADOURO", "address"), ("CIDADE", "city"), ("BAIRRO", "neighborhood"), ("UF", "state"), ("ESTADO", "state"),
    ("DATA", "date"), ("DT_", "date"), ("VALOR", "money"), ("PRECO", "money"), ("TOTAL", "money"), ("SALDO", "money"),
    ("CODIGO", "code"), ("COD_", "code"), ("DESCRICAO", "text"), ("OBS", "text"), ("OBSERVACAO", "text"),
    ("SENHA", "password"), ("PASSWORD", "password"),
)


def hinted_datatype(name: Column, datatype: Column) -> Column:
    """Type from the name; a declared type other than text is kept."""
    upper = F.upper(name)
    out = F.lit(None).cast("string")
    for hint, kind in reversed(TYPE_HINTS):
        hit = F.contains(upper, F.lit(hint))
        if hint == "RG":
            hit = hit & ~F.contains(upper, F.lit("CARGO"))
        out = F.when(hit, kind).otherwise(out)
    return F.when(datatype.isNull() | datatype.isin("", "text"), F.coalesce(out, datatype)).otherwise(datatype)


# Fixed lengths of coded fields.
NAME_LENGTHS = (("CPF", "cpf", 11), ("CNPJ", "cnpj", 14), ("CEP", "cep", 8))


def name_constraints(name: Column) -> tuple[Column, Column]:
    """Format and exact length a field name implies."""
    upper = F.upper(name)
    fmt = F.when(upper.rlike("EMAIL|E_MAIL"), "email").when(upper.rlike("TELEFONE|FONE|CELULAR"), "phone")
    size = F.lit(None).cast("int")
    for part, kind, length in reversed(NAME_LENGTHS):
        hit = F.contains(upper, F.lit(part))
        fmt, size = F.when(hit, kind).otherwise(fmt), F.when(hit, length).otherwise(size)
    return fmt, size


def valid_entity_name(name: Column) -> Column:
    """Names an entity may have: a letter, then 2 to 31 letters, digits or underscores."""
    clean = F.trim(name)
    return clean.rlike(r"\A[A-Za-z][A-Za-z0-9_]{2,31}\z") & ~F.lower(clean).rlike(r"\A(tmp_|var_|arg_|param_)")


def placeholder_screen(title: Column, program: Column, fields: Column) -> Column:
    """Generated names such as ``tela 3`` of ``prog12`` without any field."""
    t, p = F.lower(F.trim(title)), F.lower(F.trim(program))
    named = (t.rlike(r"\Atela\s+\d+\z") & p.rlike(r"\Aprog\d+\z")) | t.rlike(r"\A(scr|prog)\d+\z")
    return (fields <= 0) & F.coalesce(named, F.lit(False))


# Module names by prefix.
MODULES = {
    "CAD": "Cadastro", "COP": "Contas a Pagar", "CRE": "Contas a Receber", "FIN": "Financeiro",
    "FAT": "Faturamento", "PED": "Pedido", "EST": "Estoque", "PRD": "Producao", "EXP": "Expedicao",
    "COM": "Compras", "NF": "Nota Fiscal", "CRM": "CRM", "RH": "Recursos Humanos", "CTB": "Contabilidade",
    "ASS": "Assistencia Tecnica", "VOIP": "VoIP/Telefonia", "CLI": "Clientes", "CON": "Contratos",
    "VEN": "Vendas", "ORC": "Orcamento", "SYS": "Sistema",
}
# Further labels of the menu report.
MENU_MODULES = {
    "AGE": "Agendamento", "ATE": "Atendimento", "AUD": "Auditoria Medica", "COC": "Controle de Compras",
    "COR": "Contas a Receber", "MOC": "Medicina Ocupacional", "TEL": "Telemarketing", "ENG": "Engenharia",
    "FPG": "Folha de Pagamentos", "CDM": "Condominios", "SUP": "Suporte", "TRE": "Treinamento", "UBB": "UBB",
    "PON": "Ponto Eletronico", "CAR": "Estacionamento", "IMP": "Importacao", "UTI": "Utilitarios", "PRO": "Producao",
}
# Kinds of program by the number in its name.
PROGRAM_KINDS = {
    "01": "Inclusao/Cadastro", "02": "Alteracao/Edicao", "03": "Consulta", "04": "Relatorio",
    "05": "Exclusao", "10": "Principal", "99": "Utilitario",
}


def _lookup(key: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def module_label(code: Column) -> Column:
    return F.coalesce(_lookup(code, {**MODULES, **MENU_MODULES}), F.concat(F.lit("Modulo "), code))


def module_prefix(program: Column) -> Column:
    """Two to four leading letters of a program's file name."""
    base = F.regexp_replace(F.regexp_extract(F.lower(program), r"([^/\\]*)$", 1), r"\.(prg|src|dbo)$", "")
    letters = F.regexp_extract(base, r"^([a-z]{2,4})", 1)
    return F.when(letters != "", letters).otherwise(F.substring(base, 1, 3))


def program_purpose(file_name: Column) -> Column:
    """Readable purpose from module prefix and trailing number."""
    bare = F.replace(F.replace(file_name, F.lit(".prg"), F.lit("")), F.lit(".dbo"), F.lit(""))
    name = F.regexp_replace(F.upper(bare), r"^[^A-Z0-9]+", "")
    core = {**MODULES, "AA": "Sistema (core)", "BB": "Sistema (infra)"}
    module = F.coalesce(_lookup(F.substring(name, 1, 3), core), _lookup(F.substring(name, 1, 2), core))
    number = F.regexp_extract(name, r"(\d{2,})[a-zA-Z]*$", 1)
    kind = F.when(
        number != "",
        F.coalesce(_lookup(F.substring(number, 1, 2), PROGRAM_KINDS), F.concat(F.lit("Operacao "), number)),
    )
    label = F.concat_ws(" — ", module, kind)
    return (
        F.when(name == "", "Programa desconhecido")
        .when(label == "", F.concat(F.lit("Programa "), name))
        .otherwise(label)
    )
