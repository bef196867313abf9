"""Knowledge about fields, entities and screens: classification, keys, links, coverage, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import naming
from tracewell.plans import ordered
from tracewell.plans.lineage import settle

# Meaning of the tokens of a field name (token: category, data type, weight).
TOKEN_WEIGHTS = {
    "cpf": ("cpf", "text", 0.95),
    "cnpj": ("cnpj", "text", 0.95),
    "rg": ("rg", "text", 0.90),
    "identidade": ("rg", "text", 0.85),
    "cep": ("cep", "text", 0.90),
    "postal": ("cep", "text", 0.85),
    "zip": ("cep", "text", 0.80),
    "email": ("email", "text", 0.90),
    "mail": ("email", "text", 0.85),
    "telefone": ("phone", "text", 0.90),
    "fone": ("phone", "text", 0.90),
    "tel": ("phone", "text", 0.85),
    "phone": ("phone", "text", 0.85),
    "celular": ("phone", "text", 0.90),
    "cel": ("phone", "text", 0.85),
    "nome": ("name", "text", 0.85),
    "name": ("name", "text", 0.80),
    "razao": ("name", "text", 0.85),
    "fantasia": ("name", "text", 0.85),
    "endereco": ("address", "text", 0.85),
    "end": ("address", "text", 0.75),
    "logradouro": ("address", "text", 0.80),
    "rua": ("address", "text", 0.75),
    "bairro": ("neighborhood", "text", 0.80),
    "cidade": ("city", "text", 0.80),
    "city": ("city", "text", 0.75),
    "municipio": ("city", "text", 0.80),
    "uf": ("state", "text", 0.85),
    "estado": ("state", "text", 0.85),
    "state": ("state", "text", 0.80),
    "data": ("date", "date", 0.85),
    "dt": ("date", "date", 0.85),
    "date": ("date", "date", 0.80),
    "dta": ("date", "date", 0.80),
    "dat": ("date", "date", 0.80),
    "hora": ("time", "text", 0.80),
    "codigo": ("code", "integer", 0.85),
    "cod": ("code", "integer", 0.85),
    "cd": ("code", "integer", 0.80),
    "id": ("code", "integer", 0.80),
    "chave": ("code", "integer", 0.80),
    "valor": ("money", "decimal", 0.80),
    "vlr": ("money", "decimal", 0.80),
    "preco": ("money", "decimal", 0.80),
    "total": ("money", "decimal", 0.80),
    "saldo": ("money", "decimal", 0.80),
    "quantidade": ("quantity", "integer", 0.80),
    "qtd": ("quantity", "integer", 0.80),
    "qtde": ("quantity", "integer", 0.80),
    "estoque": ("quantity", "integer", 0.80),
    "peso": ("measure", "decimal", 0.75),
    "altura": ("measure", "decimal", 0.70),
    "volume": ("measure", "decimal", 0.70),
    "metros": ("measure", "decimal", 0.65),
    "kg": ("measure", "decimal", 0.65),
    "status": ("enum", "text", 0.70),
    "situacao": ("enum", "text", 0.70),
    "tipo": ("enum", "text", 0.65),
    "obs": ("text", "text", 0.70),
    "observacao": ("text", "text", 0.70),
    "descricao": ("text", "text", 0.70),
    "desc": ("text", "text", 0.65),
    "complemento": ("text", "text", 0.65),
    "flag": ("boolean", "boolean", 0.80),
    "flg": ("boolean", "boolean", 0.80),
    "indicador": ("boolean", "boolean", 0.75),
    "ind": ("boolean", "boolean", 0.70),
    "ativo": ("boolean", "boolean", 0.80),
    "inativo": ("boolean", "boolean", 0.80),
    "numero": ("code", "text", 0.60),
    "num": ("code", "text", 0.55),
}
# Meaning inside an entity (part of its name, token, category, data type, weight).
CONTEXT_WEIGHTS = (
    ("cliente", "documento", "cpf", "text", 0.85), ("cliente", "doc", "cpf", "text", 0.80), ("cliente", "numero", "cpf", "text", 0.70),
    ("fornecedor", "documento", "cnpj", "text", 0.85), ("fornecedor", "doc", "cnpj", "text", 0.80),
    ("empresa", "documento", "cnpj", "text", 0.90), ("empresa", "doc", "cnpj", "text", 0.85),
    ("produto", "codigo", "product_code", "integer", 0.85), ("produto", "cod", "product_code", "integer", 0.85),
    ("pedido", "numero", "order_number", "integer", 0.85), ("pedido", "num", "order_number", "integer", 0.80),
    ("nota", "numero", "invoice_number", "integer", 0.85), ("nota", "num", "invoice_number", "integer", 0.80),
    ("duplicata", "numero", "duplicate_number", "text", 0.85), ("duplicata", "num", "duplicate_number", "text", 0.80),
)
CONTEXT_BONUS = 1.2


def token_dictionary() -> dict[str, tuple[str, str, float]]:
    return dict(TOKEN_WEIGHTS)


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("([a-z]+|[0-9]+)"), F.lit(1))


def classify_fields(fields: DataFrame) -> DataFrame:
    """Category, data type and confidence of each field from the tokens of its name.

    ``fields``: entity, field, datatype, picture.  The heaviest token wins, a token known in
    the context of the entity counts 1.2 times, ties go to the earlier token.  The token
    table is a literal map, so there is no join and no shuffle.
    """
    entry = "struct<category:string,kind:string,weight:double>"
    parts = []
    for token, (category, kind, weight) in token_dictionary().items():
        parts += [F.lit(token), F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))]
    known = F.create_map(*parts)
    entity = F.lower("entity")

    def in_context(token: Column) -> Column:
        out = F.lit(None).cast(entry)
        for part, word, category, kind, weight in reversed(CONTEXT_WEIGHTS):
            hit = (token == word) & F.contains(entity, F.lit(part))
            value = F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(weight * CONTEXT_BONUS).alias("weight"))
            out = F.when(hit, value).otherwise(out)
        return out

    def ranked(token: Column, place: Column) -> Column:
        def vote(v: Column, later: int) -> Column:
            return F.when(
                v.isNotNull(),
                F.struct(v["weight"].alias("weight"), (-(place * 2 + later)).alias("minus_place"), v["category"].alias("category"), v["kind"].alias("kind")),
            )

        return F.array(vote(in_context(token), 0), vote(F.try_element_at(known, token), 1))

    votes = F.array_compact(F.flatten(F.transform(name_tokens(F.col("field")), ranked)))
    best = F.array_max(votes)
    picture = F.coalesce("picture", F.lit(""))
    masked = (
        F.when(picture.rlike(r"(?i)@[DE]\s"), "date")
        .when(picture.rlike(r"(?i)[9Z#*$.\-,]+"), F.when(picture.rlike("[.,]"), "decimal").otherwise("integer"))
    )
    links = F.filter(
        name_tokens(F.col("field")), lambda t: t.isin(*sorted({c[0] for c in CONTEXT_WEIGHTS}))
    )
    plain = F.coalesce("datatype", F.lit("text")).isin("text", "")
    return fields.withColumn("__b", best).withColumn("lookup_entity", F.try_element_at(links, F.lit(-1))).select(
        *fields.columns,
        F.coalesce("__b.category", F.when(F.col("lookup_entity").isNotNull(), "foreign_key"), F.lit("")).alias("category"),
        F.round(
            F.when(F.col("__b").isNull() & F.col("lookup_entity").isNotNull(), 0.6).otherwise(F.least(F.coalesce("__b.weight", F.lit(0.0)), F.lit(1.0))), 4
        ).alias("confidence"),
        F.coalesce(masked, F.when(plain, F.col("__b.kind")), F.coalesce("datatype", F.lit("text"))).alias("inferred_datatype"),
        "lookup_entity",
    ).drop("__b")


# Category of a field and the generator that fits it.
CATEGORY_PROVIDERS = {
    "cpf": "cpf", "cnpj": "cnpj", "rg": "rg", "cep": "cep", "email": "email", "phone": "phone", "name": "person_name",
    "address": "address", "neighborhood": "text", "city": "text", "state": "text", "date": "date", "time": "datetime",
    "code": "code", "product_code": "code", "order_number": "number", "invoice_number": "number",
    "duplicate_number": "text", "money": "money", "quantity": "number", "measure": "decimal", "enum": "choice",
    "boolean": "boolean", "text": "text", "foreign_key": "code",
}
TYPE_PROVIDERS = {
    "integer": "number", "int": "number", "number": "number", "decimal": "decimal", "float": "decimal", "double": "decimal",
    "money": "money", "date": "date", "datetime": "datetime", "timestamp": "datetime", "boolean": "boolean",
    "bool": "boolean", "text": "text", "varchar": "text", "char": "text",
}


def route_providers(classified: DataFrame) -> DataFrame:
    """Generator of each classified field: by category, then by data type when unsure, choices first."""
    by_category = F.coalesce(*[F.when(F.col("category") == c, p) for c, p in CATEGORY_PROVIDERS.items()])
    by_type = F.coalesce(*[F.when(F.lower("inferred_datatype") == c, p) for c, p in TYPE_PROVIDERS.items()])
    sure = by_category.isNotNull() & (F.col("confidence") >= 0.7)
    weak = by_category.isNotNull() & (F.col("confidence") >= 0.6)
    return classified.withColumn(
        "provider", F.when(sure | weak, by_category).otherwise(F.coalesce(by_type, by_category, F.lit("text")))
    )


# ---------------------------------------------------------------- foreign keys

# Short names of entities and plural forms.
ENTITY_ALIASES = {
    "CLI": "CLIENTES", "CLIE": "CLIENTES", "CLIENT": "CLIENTES", "PROD": "PRODUTOS", "PRODU": "PRODUTOS",
    "FORN": "FORNECEDORES", "FORNEC": "FORNECEDORES", "FOR": "FORNECEDORES", "PED": "PEDIDOS", "PEDI": "PEDIDOS",
    "VEN": "VENDEDORES", "VEND": "VENDEDORES", "FIN": "FINANCEIRO", "NFE": "NOTAS", "NF": "NOTAS", "DUP": "FINANCEIRO",
    "DUPL": "FINANCEIRO", "CTA": "CONTAS", "CTB": "CONTABIL",
}
PLURALS = {
    "CLIENTE": "CLIENTES", "PRODUTO": "PRODUTOS", "PEDIDO": "PEDIDOS", "FORNECEDOR": "FORNECEDORES", "VENDA": "VENDAS",
    "NOTA": "NOTAS", "ITEM": "ITENS", "ITENS_PEDIDO": "ITENS_PEDIDO", "VENDEDOR": "VENDEDORES", "ESTOQUE": "ESTOQUE",
    "FINANCEIRO": "FINANCEIRO", "CONTABIL": "CONTABIL",
}
SELLER_FIELDS = "CODVEN COD_VEN CD_VEN ID_VEN VEN_ID CODVEND COD_VEND VENDEDOR_ID ID_VENDEDOR COD_VENDEDOR".split()
SALE_FIELDS = "VENDA_ID ID_VENDA NUM_VENDA NR_VENDA COD_VENDA VENDA_NUM".split()
KEY_MARKS = ("ID", "COD", "CD", "NUM", "NR", "FK", "REF")
KEY_WORDS = ("id", "cod", "cd", "fk", "ref", "chave", "num", "nr")


def alias_target(field: Column) -> Column:
    """Entity a key field names by prefix, suffix, alias or plural; empty when none."""
    upper = F.upper(field)
    # each mark comes off once, in this order; a mark without underscore needs two characters after it
    clean = F.regexp_replace(upper, "^" + "".join(f"({m}_)?" for m in KEY_MARKS), "")
    clean = F.regexp_replace(clean, "^(?:COD|CD|ID|NUM|NR|FK|REF)(?=.{2})", "")
    clean = F.regexp_replace(clean, "".join(f"(_{m})?" for m in reversed(KEY_MARKS)) + "$", "")
    clean = F.regexp_replace(clean, "^_+|_+$", "")

    def target(name: Column) -> Column:
        direct = [F.when(name == k, v) for k, v in {**PLURALS, **ENTITY_ALIASES}.items()]
        inside = [F.when(F.contains(name, F.lit(k)), v) for k, v in ENTITY_ALIASES.items() if len(k) >= 4]
        return F.coalesce(*direct, *inside, F.lit(""))

    named = F.transform(F.array(clean), target)[0]
    return F.when(upper.isin(*SELLER_FIELDS), "VENDEDORES").when(upper.isin(*SALE_FIELDS), "VENDAS").otherwise(named)


def key_tokens(name: Column) -> Column:
    found = F.filter(name_tokens(name), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lower(name))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def similar_sets(left: DataFrame, right: DataFrame, above: float) -> DataFrame:
    """(left, right, sim): names of both sides (name, tokens) whose token sets have a Jaccard similarity above a limit.

    Tokens are put in order of rarity over both sides.  Two sets that are so similar share one of the
    first n - ceil(above * n) + 1 tokens of either, so only these are joined: a token that most names
    carry is joined for names that consist of little else.
    """
    sides = left.select(F.lit("l").alias("side"), "name", "tokens").unionByName(right.select(F.lit("r").alias("side"), "name", "tokens"))
    single = sides.distinct().withColumn("token", F.explode("tokens"))
    common = single.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    placed = single.join(common, "token").groupBy("side", "name", "tokens").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("order"))
    n = F.size("order")
    first = placed.withColumn("token", F.explode(F.slice("order", F.lit(1), (n - F.ceil(n * above) + 1).cast("int")))).withColumn("token", F.col("token.token"))
    mine, other = (first.where(F.col("side") == s).select(F.col("name").alias(a), F.col("tokens").alias(f"{a}_tokens"), "token") for s, a in (("l", "left"), ("r", "right")))
    met = mine.join(other, "token").select("left", "right", jaccard(F.col("left_tokens"), F.col("right_tokens")).alias("sim")).distinct()
    return met.where(F.col("sim") > above)


def foreign_keys(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships fields imply, first hit wins: lookup, alias, prefix with alias; else
    prefix with similar tokens, equal names and similar names.

    ``fields``: entity, field, lookup; ``entities``: name.  Names are compared through their rarest
    tokens, never pair by pair; hints and field names are matched once however many fields
    share them, and only the two best entities of a hint are kept.
    """
    names = entities.select(F.col("name").alias("target")).distinct().withColumn("__T", F.upper("target"))
    low = name_tokens(F.col("field"))
    cleaned = F.filter(F.filter(low, lambda t: F.length(t) >= 2), lambda t: ~t.isin(*KEY_WORDS))
    marked = F.exists(low, lambda t: t.isin(*KEY_WORDS))
    base = fields.select(
        "entity", "field", "lookup", F.upper("entity").alias("__E"), F.upper("field").alias("__F"),
        alias_target(F.col("field")).alias("__alias"),
        F.when(marked, F.array_join(cleaned, "_")).otherwise("").alias("__hint"),
    ).withColumn("__hint_alias", F.when(F.col("__hint") != "", alias_target(F.col("__hint"))).otherwise(""))
    known = names.select("__T")
    alias_ok = known.select(F.col("__T").alias("__alias"), F.lit(True).alias("__has_alias"))
    hint_ok = known.select(F.col("__T").alias("__hint_alias"), F.lit(True).alias("__has_hint"))
    checked = base.join(alias_ok, "__alias", "left").join(hint_ok, "__hint_alias", "left")
    by_alias = F.col("__has_alias") & (F.col("__alias") != F.col("__E"))
    by_hint = F.col("__has_hint") & (F.col("__hint_alias") != F.col("__E"))
    has_lookup = F.coalesce("lookup", F.lit("")) != ""

    def relation(target: Column, kind: str, confidence: float, evidence: str) -> Column:
        return F.struct(
            target.alias("target"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence")
        )

    decided = (
        F.when(has_lookup, relation(F.col("lookup"), "lookup", 0.95, "lookup"))
        .when(by_alias, relation(F.col("__alias"), "foreign_key", 0.85, "alias"))
        .when((F.col("__hint") != "") & by_hint, relation(F.col("__hint_alias"), "foreign_key", 0.80, "prefix_alias"))
    )
    judged = checked.withColumn("__r", decided)
    direct = judged.where(F.col("__r").isNotNull()).select("entity", "field", "__r.*")
    open_fields = judged.where(F.col("__r").isNull()).select("entity", "field", "__E", "__F", "__hint")

    tokens = names.select("target", key_tokens(F.col("target")).alias("tokens"))
    hints = open_fields.where(F.col("__hint") != "").select("__hint").distinct()
    pairs = similar_sets(hints.select(F.col("__hint").alias("name"), key_tokens(F.col("__hint")).alias("tokens")), tokens.withColumnRenamed("target", "name"), 0.3)
    pairs = pairs.select(F.col("left").alias("__hint"), F.col("right").alias("target"), F.upper("right").alias("__T"), "sim", (-F.col("sim")).alias("minus_sim"))
    top = ordered.scan(pairs, ["__hint"], ["minus_sim", "target"], place=ordered.row_number()).where(F.col("place") <= 2)
    similar = (
        open_fields.where(F.col("__hint") != "")
        .join(top, "__hint")
        .where(F.col("__T") != F.col("__E"))
        .groupBy("entity", "field")
        .agg(F.min_by(F.struct("target", "sim"), "place").alias("b"))
        .select(
            "entity", "field", F.col("b.target").alias("target"), F.lit("foreign_key").alias("type"),
            F.round(F.least(F.lit(0.95), F.col("b.sim") * 0.4 + 0.60), 3).alias("confidence"), F.lit("prefix_tokens").alias("evidence"),
        )
    )
    long_names = names.where(F.length("target") >= 3)
    spelled = open_fields.select("field").distinct()
    alike = similar_sets(spelled.select(F.col("field").alias("name"), key_tokens(F.col("field")).alias("tokens")),
                         tokens.join(long_names.select("target"), "target").withColumnRenamed("target", "name"), 0.4)
    alike = alike.select(F.col("left").alias("field"), F.col("right").alias("target"), "sim")
    equal = spelled.withColumn("__T", F.upper("field")).join(long_names, "__T").select("field", "target", F.lit(1.0).alias("sim"))
    both = alike.unionByName(equal).groupBy("field", "target").agg(F.max("sim").alias("sim"))
    begins = F.left(F.upper("target"), F.lit(4))
    same = F.upper("target") == F.col("__F")
    named = (
        open_fields.select("entity", "field", "__E", "__F")
        .join(both, "field")
        .where((F.upper("target") != F.col("__E")) & ((F.left("__F", F.lit(4)) == begins) | (F.left("__F", F.lit(3)) == begins)))
        .select(
            "entity", "field", "target", F.lit("foreign_key").alias("type"),
            F.when(same, 0.75).otherwise(F.round(F.col("sim") * 0.35 + 0.55, 3)).alias("confidence"),
            F.when(same, "exact_name").otherwise("similar_name").alias("evidence"),
        )
        .distinct()
    )
    return direct.unionByName(similar).unionByName(named)


def relation_hints(lines: DataFrame) -> DataFrame:
    """Data dependencies in program lines: alias→field references and SET RELATION pairs."""
    arrows = F.transform(
        F.regexp_extract_all("line", F.lit(r"(\w+)->(\w+)"), F.lit(0)),
        lambda m: F.struct(
            F.upper(F.substring_index(m, "->", 1)).alias("source_screen"), F.upper(F.substring_index(m, "->", -1)).alias("source_field"),
            F.lit("").alias("target_screen"), F.lit("alias_reference").alias("dependency_type"),
        ),
    )
    shape = r"(?i)set\s+relation\s+to\s+(\w+)\s+into\s+(\w+)"
    relations = F.transform(
        F.regexp_extract_all("line", F.lit(shape), F.lit(0)),
        lambda m: F.struct(
            F.lit("").alias("source_screen"), F.upper(F.regexp_extract(m, shape, 1)).alias("source_field"),
            F.upper(F.regexp_extract(m, shape, 2)).alias("target_screen"), F.lit("relation").alias("dependency_type"),
        ),
    )
    return lines.select("file", "line_no", F.explode(F.concat(arrows, relations)).alias("d")).select("file", "line_no", "d.*")


def step_dependencies(steps: DataFrame, hints: DataFrame) -> DataFrame:
    """Journey steps with the fields they depend on, by source or target screen (one equi-join)."""
    reference = F.concat("source_screen", F.lit("."), "source_field")
    keyed = steps.select("journey_id", "step_order", F.upper("screen_id").alias("screen")).where("screen <> ''")
    distinct = hints.select("source_screen", "target_screen", reference.alias("depends_on")).distinct()
    needs = distinct.select(F.explode(F.array("source_screen", "target_screen")).alias("screen"), "depends_on").where("screen <> ''").distinct()
    # a step with one screen meets each field once, so its rows need not be brought together again
    step = ["journey_id", "step_order"]
    seen = keyed.groupBy(*step).agg(F.min("screen").alias("screen"), F.max("screen").alias("last"))
    alone = seen.where(F.col("screen") == F.col("last")).select(*step, "screen")
    several = seen.where(F.col("screen") != F.col("last")).select(*[F.col(c).alias(f"__{c}") for c in step])
    of_several = keyed.join(several, F.col("journey_id").eqNullSafe(F.col("__journey_id")) & F.col("step_order").eqNullSafe(F.col("__step_order")), "left_semi")
    return alone.join(needs, "screen").select(*step, "depends_on").unionByName(of_several.join(needs, "screen").select(*step, "depends_on").distinct())


# ---------------------------------------------------------------- screens and entities

# Field names that say little, and names that say much.
WEAK_FIELDS = "ID CODIGO COD DATA STATUS TIPO OBS OBSERVACAO NUMERO NUM SEQUENCIA SEQ FLAG ATIVO SITUACAO INDICADOR NOME".split()
# Abbreviations of field names.
ABBREVIATIONS = {
    "desc": "descricao", "descr": "descricao", "des": "descricao", "vlr": "valor", "val": "valor", "qtd": "quantidade",
    "qtde": "quantidade", "cod": "codigo", "cd": "codigo", "end": "endereco", "ender": "endereco", "nom": "nome",
    "tel": "telefone", "fone": "telefone", "mail": "email", "obs": "observacao", "prec": "preco", "prc": "preco",
    "cat": "categoria", "est": "estoque", "forn": "fornecedor", "func": "funcionario",
}
# Title words by operation, in order of priority.
TITLE_WORDS = (
    ("create", "cadastro|cadastrar|inclusao|incluir|novo|nova|criar"),
    ("update", "alteracao|alterar|edicao|editar|modificar|atualizar"),
    ("delete", "exclusao|excluir|cancelamento|cancelar|remover|apagar"),
    ("read", "consulta|consultar|pesquisa|pesquisar|visualizar|listar|listagem"),
    ("report", "relatorio|relatorios|impressao|imprimir"),
    ("menu", "menu|principal|modulos|sistema"),
)


# Parts of program names by entity, in order of priority.
PROGRAM_ALIASES = (
    ("CLIENTES", ("cli", "clie", "client", "cadcli", "altcli", "concli", "exccli")),
    ("PRODUTOS", ("prod", "produ", "product", "cadprod", "altprod", "conprod")),
    ("FORNECEDORES", ("forn", "fornec", "forne", "cadfor", "altfor", "confor")),
    ("PEDIDOS", ("ped", "pedi", "order", "cadped", "altped")),
    ("VENDAS", ("ven", "vend", "venda", "sale", "cadven")),
    ("VENDEDORES", ("vendedor", "codven", "cdven")),
    ("FINANCEIRO", ("fin", "finan", "titulo", "tit", "cadfin", "dupl", "dup")),
    ("ESTOQUE", ("est", "estoq", "stock")),
    ("NOTAS", ("nfe", "nf", "nota", "fiscal", "nfs", "notafiscal")),
    ("ITENS_PEDIDO", ("itens", "item", "itped")),
    ("CONTAS", ("cta", "contas", "contab")),
)


def program_entities(programs: DataFrame, entities: DataFrame) -> DataFrame:
    """(program, entity): the entity a program name stands for.

    The first known entity one of whose aliases is part of the name (``cadcli`` is CLIENTES), else
    the smallest entity name that shares a token with it; programs without either have no row.
    """
    names = programs.select("program").where(F.col("program") != "").distinct()
    clean = F.replace(F.lower("program"), F.lit(".prg"), F.lit(""))
    hits = F.array_compact(F.array(*[
        F.when(clean.rlike("|".join(parts)), F.struct(F.lit(k).alias("rank"), F.lit(name).alias("upper"))) for k, (name, parts) in enumerate(PROGRAM_ALIASES)
    ]))
    known = entities.select("entity", F.upper("entity").alias("upper")).groupBy("upper").agg(F.min("entity").alias("entity"))
    by_alias = names.select("program", F.explode(hits).alias("h")).select("program", "h.*").join(known, "upper")
    by_alias = by_alias.groupBy("program").agg(F.min_by("entity", "rank").alias("aliased"))
    tokens = lambda name: F.explode(key_tokens(F.lower(name)))
    by_token = names.select("program", tokens(clean).alias("token")).join(entities.select("entity", tokens(F.col("entity")).alias("token")).distinct(), "token")
    by_token = by_token.groupBy("program").agg(F.min("entity").alias("shared"))
    both = by_alias.join(by_token, "program", "full").select("program", F.coalesce("aliased", "shared").alias("entity"))
    return both


def match_keys(name: Column) -> Column:
    """Forms under which two field names are the same: whole, parts, without type letter, spelled out."""
    low = F.lower(F.trim(name))
    bare = F.when(low.rlike("^[cndlamptx][a-z]"), F.substring(low, F.lit(2), F.length(low)))
    forms = F.array_compact(F.concat(F.array(low, F.replace(low, F.lit("_"), F.lit("")), bare), F.split(low, "_")))

    def spelled(form: Column) -> Column:
        return F.coalesce(*[F.when(form == k, v) for k, v in ABBREVIATIONS.items()], form)

    return F.array_distinct(F.filter(F.concat(forms, F.transform(forms, spelled)), lambda k: F.length(k) >= 2))


def link_screens(screens: DataFrame, screen_fields: DataFrame, entity_fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Best entity of each screen with confidence and operation.

    ``screens``: screen_id, title, program; ``screen_fields``: screen_id, field;
    ``entity_fields``: entity, field; ``entities``: entity, storage_type.  Fields meet through
    equal keys; a screen and an entity meet only if they share one, the title names the entity
    or the program stands for it.
    """
    # a name is compared once, and a set of fields is scored once, however many screens show it
    asked = screen_fields.select("field").distinct().select(F.col("field").alias("screen_field"), F.explode(match_keys(F.col("field"))).alias("key"))
    right = entity_fields.distinct().select("entity", F.col("field").alias("entity_field"), F.explode(match_keys(F.col("field"))).alias("key"))
    meets = asked.join(right, "key").groupBy("screen_field", "entity").agg(F.min("entity_field").alias("entity_field"))
    shown = screen_fields.repartition("screen_id").groupBy("screen_id").agg(
        F.array_sort(F.collect_set("field")).alias("names"), F.max(F.col("field").isNull().cast("int")).alias("unnamed")
    )
    totals = shown.select("screen_id", "names", (F.size("names") + F.col("unnamed")).cast("long").alias("fields"))
    low, up = F.lower("entity").alias("low"), F.upper("entity").alias("up")
    stored = entities.select("entity", "storage_type", low, up).distinct()
    candidate = F.struct("entity", "storage_type", "low", "up", "matched", "strong")

    def scored(c, by_program: Column, by_title: Column) -> Column:
        share = F.when(F.col("fields") > 0, c["matched"] / F.col("fields")).otherwise(0.0)
        score = F.least(
            F.lit(1.0),
            share + F.when(by_program, 0.25).otherwise(0.0) + F.when(by_title, 0.15).otherwise(0.0)
            + F.when(c["storage_type"].isin("sql", "isam", "recital", "dbf"), 0.05).otherwise(0.0),
        )
        evidence = F.when(by_program, 1).otherwise(0) + F.when(by_title, 1).otherwise(0) + F.when(c["strong"] >= 2, 1).otherwise(0)
        only_weak = (c["matched"] > 0) & (c["strong"] == 0) & ~by_program & ~by_title
        return F.struct(
            score.alias("score"), c["entity"].alias("entity"), evidence.alias("evidence"), only_weak.alias("only_weak"),
            c["matched"].alias("matched"), c["strong"].alias("strong"),
        )

    columns = {c: F.col(c) for c in ("entity", "storage_type", "matched", "strong")}
    by_fields = (
        totals.select("names", "fields").distinct()
        .select("names", "fields", F.explode("names").alias("screen_field"))
        .join(meets, "screen_field")
        .groupBy("names", "fields", "entity")
        .agg(
            F.count(F.lit(1)).alias("matched"),
            F.count_if(~F.upper("entity_field").isin(*WEAK_FIELDS)).alias("strong"),
        )
        .join(stored, "entity")
        .groupBy("names", "fields")
        .agg(F.collect_list(candidate).alias("by_fields"), F.max(scored(columns, F.lit(False), F.lit(False))).alias("plain"))
    )
    unmatched = [F.lit(0).cast("long").alias(c) for c in ("matched", "strong")]
    titles = screens.select("title").distinct().select("title", F.lower("title").alias("low_title"))
    words = titles.select("title", F.explode(name_tokens(F.col("title"))).alias("word"))
    by_title = words.join(stored.select("*", F.col("low").alias("word"), *unmatched), "word").groupBy("title").agg(F.collect_set(candidate).alias("by_title"))
    by_title = titles.join(by_title, "title", "left")
    meant = program_entities(screens, entities).withColumnRenamed("entity", "meant")
    by_program = meant.join(stored.select("*", *unmatched), F.col("meant") == F.col("entity")).groupBy("program", F.upper("meant").alias("up_meant"))
    by_program = by_program.agg(F.collect_list(candidate).alias("by_program"))
    placed = (
        screens.join(totals, "screen_id", "left").join(by_fields, ["names", "fields"], "left")
        .join(by_title, "title", "left").join(by_program, "program", "left")
    )
    # only entities that the title or the program names differ from screen to screen with the same fields
    none = F.array().cast(by_fields.schema["by_fields"].dataType)
    is_meant = lambda c: F.coalesce(c["up"] == F.col("up_meant"), F.lit(False))
    in_title = lambda c: F.contains(F.col("low_title"), c["low"])
    matching, titled, programmed = (F.coalesce(c, none) for c in ("by_fields", "by_title", "by_program"))
    marked = F.filter(matching, lambda c: is_meant(c) | in_title(c))
    named = F.filter(
        F.array_distinct(F.concat(titled, programmed)), lambda n: ~F.exists(matching, lambda m: m["entity"] == n["entity"])
    )
    untitled = F.col("plain").withField("only_weak", F.lit(False))
    plain = F.when(F.col("title").isNull(), untitled).otherwise(F.col("plain"))
    best = (
        placed.select("screen_id", plain.alias("plain"), F.array_max(F.transform(F.concat(marked, named), lambda c: scored(c, is_meant(c), in_title(c)))).alias("marked"))
        .groupBy("screen_id")
        .agg(F.max("plain").alias("plain"), F.max("marked").alias("marked"))
        .select("screen_id", F.greatest("plain", "marked").alias("b"))
        .select("screen_id", "b.*")
    )
    totals = totals.drop("names")
    linked = screens.join(totals, "screen_id", "left").join(best, "screen_id", "left").fillna(0, ["fields", "score", "evidence", "matched", "strong"])
    title = F.lower("title")
    by_words = F.coalesce(*[F.when(title.rlike(words), F.lit(op)) for op, words in TITLE_WORDS])
    operation = F.when((F.col("fields") == 0) & ~title.rlike("cadastro|consulta|alteracao|exclusao|relatorio"), "menu").otherwise(F.coalesce(by_words, F.lit("")))
    confidence = (
        F.when((F.col("fields") == 0) & (F.col("title") == ""), 0.0)
        .when(F.col("fields") == 0, F.when(operation == "menu", 0.3).otherwise(0.1))
        .when((F.col("score") >= 0.6) & (F.col("evidence") >= 2), F.least(F.lit(0.95), (F.col("score") - 0.6) * 0.7 + 0.6 + F.col("evidence") * 0.08))
        .when(F.col("score") >= 0.6, (F.col("score") - 0.6) * 0.3 + 0.50)
        .when(F.col("score") >= 0.3, (F.col("score") - 0.3) * 0.5 + 0.30)
        .otherwise(F.greatest(F.lit(0.05), F.col("score") * 0.5))
    )
    capped = F.when(F.coalesce("only_weak", F.lit(False)), F.least(confidence, F.lit(0.35))).otherwise(confidence)
    return linked.select(
        "screen_id", F.coalesce("entity", F.lit("")).alias("entity"), "matched", "fields", operation.alias("operation"),
        F.round(capped, 4).alias("confidence"),
    )


#: Length of the pieces looked up, and how many distinct ones are broadcast at most.
REACH, FEW_PIECES = 4, 1_000_000


def containing(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """Pairs of rows where the text contains the phrase, as an equi-join.

    Pieces of (up to four) characters that occur in phrases are looked up among the pieces of that
    length of each text, and a phrase is sought where its rarest piece is found; only those
    candidates are compared in full.  Pieces carry a hash of their text, so a text moves once,
    to its candidates.
    """

    def cut(of: str, sizes: Column) -> Column:
        # a look-ahead yields every overlapping piece in one pass over the text
        return F.array_distinct(
            F.concat(
                *[
                    F.when(F.array_contains(sizes, n), F.regexp_extract_all(F.col(of), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
                    .otherwise(F.array().cast("array<string>"))
                    for n in range(1, REACH + 1)
                ]
            )
        )

    sought = phrases.select(F.col(phrase).alias("__phrase")).where(F.length("__phrase") > 0).distinct()
    own = settle(sought.select("__phrase", F.explode(cut("__phrase", F.array(F.least(F.length("__phrase"), F.lit(REACH))))).alias("__piece")))
    known = own.select("__piece").distinct()
    sizes = [r[0] for r in known.select(F.length("__piece")).distinct().collect()]  # at most four numbers
    if known.count() <= FEW_PIECES:
        known = F.broadcast(known)
    # the hash is taken once for a text, before its pieces are made; a plain explode would have them made
    # a second time, to filter by their number, ahead of any exchange
    cuts = texts.select(F.xxhash64(text).alias("__mark"), cut(text, F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("__cuts"))
    pieces = cuts.select("__mark", F.explode_outer("__cuts").alias("__piece")).join(known, "__piece", "left_semi")
    pieces = settle(pieces.distinct())
    seen = pieces.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = own.join(seen, "__piece", "left").groupBy("__phrase").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("piece"))).alias("__r")
    )
    chosen = rarest.where("__r.n > 0").select("__phrase", F.col("__r.piece").alias("__piece"))
    found = pieces.join(chosen, "__piece").select("__mark", "__phrase")
    marked = texts.select("*", F.xxhash64(text).alias("__mark"))
    pairs = marked.join(found, "__mark").where(F.contains(F.col(text), F.col("__phrase")))
    return pairs.join(phrases.withColumn("__phrase", F.col(phrase)), "__phrase").drop("__mark", "__phrase")


def bind_captures(screens: DataFrame, bindings: DataFrame, entities: DataFrame) -> DataFrame:
    """Binding of each captured screen, first hit wins: title in its sample, title in its
    signature or signature in the title, entity name in its sample.

    ``screens``: screen_id, sample, signature; ``bindings``: title, entity; ``entities``: entity.
    """
    titles = bindings.select(F.upper("title").alias("title"), "entity").where(F.col("title") != "")
    first = titles.groupBy("title").agg(F.min("entity").alias("entity"))
    samples = screens.select("screen_id", F.upper("sample").alias("sample"))
    signatures = screens.select("screen_id", F.upper("signature").alias("signature"))
    names = entities.select("entity", F.upper("entity").alias("name")).distinct()

    def ranked(pairs: DataFrame, rank: int, by: str) -> DataFrame:
        return pairs.select("screen_id", "entity", F.lit(rank).alias("rank"), F.col(by).alias("by"))

    # titles and names are sought in one pass over the samples
    of_samples = first.select("entity", F.col("title").alias("by"), F.lit(1).alias("rank")).unionByName(
        names.select("entity", F.col("name").alias("by"), F.lit(3).alias("rank"))
    )
    hits = (
        containing(samples, of_samples, "sample", "by").select("screen_id", "entity", "rank", "by")
        .unionByName(ranked(containing(signatures, first, "signature", "title"), 2, "title"))
        .unionByName(ranked(containing(first, signatures, "title", "signature"), 2, "title"))
    )
    best = hits.groupBy("screen_id").agg(F.min_by(F.struct("entity", "rank"), F.struct("rank", "by")).alias("b"))
    return screens.select("screen_id").join(best, "screen_id", "left").select("screen_id", "b.entity", F.col("b.rank").alias("rule"))


TECHNICAL_FIELDS = ("ID", "CODIGO", "COD", "SEQ", "SEQUENCIA", "NUMERO", "NR", "STATUS", "TIPO", "FLAG")
SPECIFIC_TYPES = ("cpf", "cnpj", "email", "phone", "cep", "date")
WRITTEN_TYPES = ("person_name", "address", "text")


#: Kinds of input that are no data.
IDLE_TYPES = ("confirm", "menu_option", "key_function", "key_sequence", "key_marker", "key_esc")
SCREEN = ["session_id", "screen_no"]


def _choices(placed: DataFrame) -> DataFrame:
    """(screen, no, rank, key, field, method, confidence, fixed): the fields an input may take, best first.

    The field of a specific type is fixed: it is taken whatever stands in it already.
    """
    place, kind = F.col("place"), F.col("kind")
    written = kind.isin("text", "text_long")

    def choice(rank, field: Column, method: str, sure: float, fixed: bool = False) -> Column:
        return F.struct(
            F.lit(rank).cast("int").alias("rank") if isinstance(rank, int) else rank.alias("rank"), F.upper(field).alias("key"), field.alias("field"),
            F.lit(method).alias("method"), F.lit(sure).alias("confidence"), F.lit(fixed).alias("fixed"),
        )

    semantic = kind.isin(*SPECIFIC_TYPES) & F.array_contains("meanings", kind)
    of_type = choice(0, F.get("fields", F.array_position("meanings", kind).cast("int") - 1), "by_semantic_type", 0.95, True)
    bound = F.when(place < F.size("matched"), choice(1, F.get("matched", place), "by_matched_fields", 0.85))
    here, meaning = F.get("fields", place), F.get("meanings", place)
    fits = ((kind == meaning) & ~(written & F.upper(here).isin(*TECHNICAL_FIELDS))) | (
        written & meaning.isin(*WRITTEN_TYPES) & ~F.upper(here).isin(*TECHNICAL_FIELDS)
    )
    ordered_one = F.when((place < F.size("fields")) & fits, choice(2, here, "by_screen_order", 0.75))
    numbered = F.transform("fields", lambda f, i: F.when(
        ~F.upper(f).isin(*TECHNICAL_FIELDS) & F.get("meanings", i).isin(*WRITTEN_TYPES), choice(i + 3, f, "by_field_name", 0.65)
    ))
    none = F.array().cast("array<struct<rank:int,key:string,field:string,method:string,confidence:double,fixed:boolean>>")
    every = F.when(semantic, F.array(of_type)).otherwise(F.array_compact(F.concat(F.array(bound, ordered_one), F.when(written, numbered).otherwise(none))))
    usable = ~F.col("command") & (F.size("fields") > 0) & ~kind.isin(*IDLE_TYPES)
    return placed.where(usable).select(*SCREEN, "no", F.explode(every).alias("c")).select(*SCREEN, "no", "c.*")


def map_inputs(inputs: DataFrame) -> DataFrame:
    """Field of each input of a screen, in order of evidence.

    ``inputs``: session_id, screen_no, seq, value, entity, fields (names in screen order) and
    matched (names bound to the screen).  An input takes the field of its specific type, else
    the bound field at its position, else the entity field at its position, else the first
    text field, of those that no earlier input of the screen has taken.

    All screens are matched together, in rounds: each input proposes its best field, the earliest
    one keeps it, and later inputs lose that choice.  A field once kept only passes to an earlier
    input, so what is lost stays lost, and the result is that of going through the inputs one by
    one.  There are at most as many rounds as a screen has fields, whatever the number of inputs.
    """
    ready = inputs.select(
        *SCREEN, "seq", "value", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        naming.value_type(F.col("value")).alias("kind"), F.coalesce(naming.is_key_command(F.col("value")), F.lit(False)).alias("command"),
    ).withColumn("meanings", F.transform("fields", lambda f: naming.field_meaning(f)))
    data = F.when(F.col("command"), 0).otherwise(1)
    walked = ordered.scan(ready, SCREEN, ["seq", "value"], no=ordered.row_number(), upto=ordered.running_sum(data))
    placed = settle(walked.withColumn("place", (F.col("upto") - 1).cast("int")).drop("upto"))

    choices = _choices(placed)
    fixed = settle(choices.where("fixed"))
    first = fixed.groupBy(*SCREEN, "key").agg(F.min("no").alias("since"))
    open_ = choices.where(~F.col("fixed")).join(first, [*SCREEN, "key"], "left")
    open_ = settle(open_.where(F.col("since").isNull() | (F.col("since") > F.col("no"))).drop("since"))
    while True:
        best = open_.groupBy(*SCREEN, "no").agg(F.min_by("key", "rank").alias("key"))
        kept = best.groupBy(*SCREEN, "key").agg(F.min("no").alias("keeper"))
        judged = settle(open_.join(kept, [*SCREEN, "key"], "left").withColumn("lost", F.coalesce(F.col("keeper") < F.col("no"), F.lit(False))))
        lost = judged.where("lost").limit(1).count()
        open_ = judged.where(~F.col("lost")).drop("keeper", "lost")
        if not lost:
            break
    taken = open_.groupBy(*SCREEN, "no").agg(F.min_by(F.struct("field", "method", "confidence"), "rank").alias("t"))
    every = fixed.select(*SCREEN, "no", F.struct("field", "method", "confidence").alias("t")).unionByName(taken)
    joined = placed.join(every, [*SCREEN, "no"], "left")
    command = F.col("command")
    return joined.select(
        *SCREEN, "seq", "kind", "t.field", F.coalesce("t.method", F.when(command, "command").otherwise("unmapped")).alias("method"),
        F.coalesce("t.confidence", F.when(command, 1.0).otherwise(0.0)).alias("confidence"),
    )


# ---------------------------------------------------------------- rules and coverage

# Business rules (rule, needed, enabled, critical) and flows (flow, steps).
BUSINESS_RULES = (
    ("BR-001", "cliente", "pedido", True), ("BR-002", "produto", "pedido", True), ("BR-003", "pedido", "nota", True),
    ("BR-004", "nota", "duplicata", True), ("BR-005", "duplicata", "recebimento", False), ("BR-006", "fornecedor", "compra", True),
    ("BR-007", "compra", "estoque", True), ("BR-008", "empresa", "filial", True), ("BR-009", "filial", "funcionario", False),
    ("BR-010", "produto", "estoque", True), ("BR-011", "pedido", "estoque", False),
)
BUSINESS_FLOWS = (
    ("FLOW-VENDA", ("cliente", "produto", "pedido", "nota", "duplicata")),
    ("FLOW-COMPRA", ("fornecedor", "compra", "estoque")),
    ("FLOW-CADASTRO", ("empresa", "filial", "funcionario")),
)
# Beginnings of technical names by business name, in order.
BUSINESS_NAMES = (
    ("cliente", ("cad", "cliente", "clientes", "ccadpes", "cadtra", "cadusu")),
    ("produto", ("epp", "prod", "produto", "produtos", "ean", "audit_ean")),
    ("pedido", ("ped", "pedido", "pedidos")),
    ("nota", ("fat", "nota", "nf", "faturamento", "notafiscal")),
    ("duplicata", ("cre", "dup", "duplicata", "contasreceber", "receber")),
    ("vendedor", ("ven", "vendedor", "vendedores")),
    ("fornecedor", ("forn", "fornecedor", "fornecedores", "forn_sul")),
    ("compra", ("cmp", "compra", "compras", "oc", "ordemcompra")),
    ("estoque", ("est", "estoque", "movest", "inventario")),
    ("empresa", ("emp", "empresa", "empresas", "matriz")),
    ("filial", ("fil", "filial", "filiais", "loja", "uni")),
    ("funcionario", ("fun", "funcionario", "funcionarios", "usuario", "cadusu", "confususis")),
    ("contapagar", ("cpa", "contapagar", "pagamento")),
    ("banco", ("ban", "banco", "bancos")),
    ("tributacao", ("trib", "fiscal", "imposto", "icms", "ipi")),
)


def business_name(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.coalesce(*[F.when(low.rlike("^(?:" + "|".join(w) + ")"), n) for n, w in BUSINESS_NAMES], low)


def rule_coverage(systems: DataFrame) -> DataFrame:
    """State of every business rule per system: ok, gap (only the enabled side exists) or absent.

    ``systems``: system, entity.
    """
    have = systems.select("system", business_name(F.col("entity")).alias("entity")).distinct()
    wanted = sorted({n for _, a, b, _ in BUSINESS_RULES for n in (a, b)})
    present = have.groupBy("system").agg(*[F.bool_or(F.col("entity") == w).alias(w) for w in wanted])
    rules = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule_id"), F.lit(a).alias("depends_on"), F.lit(b).alias("enables"),
                F.when(F.col(a) & F.col(b), "ok").when(F.col(b), "gap").otherwise("absent").alias("state"),
                F.lit("critical" if critical else "high").alias("severity"),
            )
            for r, a, b, critical in BUSINESS_RULES
        ]
    )
    return present.select("system", F.explode(rules).alias("r")).select(
        "system", "r.rule_id", "r.depends_on", "r.enables", "r.state", F.when(F.col("r.state") == "gap", F.col("r.severity")).alias("severity")
    )


def flow_coverage(systems: DataFrame) -> DataFrame:
    """Share of the entities of each business flow that a system has."""
    have = systems.select("system", business_name(F.col("entity")).alias("entity")).distinct()
    flows = [(f, sorted(set(steps))) for f, steps in BUSINESS_FLOWS]
    counted = have.groupBy("system").agg(*[F.count_if(F.col("entity").isin(*names)).alias(f) for f, names in flows])
    rows = F.array(
        *[F.struct(F.lit(f).alias("flow_id"), F.bround(F.col(f"`{f}`") / len(names) * 100, 1).alias("coverage_pct")) for f, names in flows]
    )
    return counted.select("system", F.explode(rows).alias("r")).select("system", "r.*")


def without_partner(rows: DataFrame, partners: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys without a partner row (entities without journey, journeys without stress run)."""
    alone = rows.select(key).distinct().join(partners.select(key).distinct(), key, "left_anti")
    return alone if limit is None else alone.orderBy(key).limit(limit)


def journey_errors(results: DataFrame, errors: DataFrame, top: int | None = None) -> DataFrame:
    """Errors by type, severity and failing step, and the overall pass rate, as one long table.

    With ``top`` only the steps that fail most often are listed.  ``results``: session_id, step_order, status (ok, warning, failed); ``errors``: error_type, severity.
    """
    by_type = errors.groupBy(F.col("error_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("dimension", F.lit("type"))
    by_severity = errors.groupBy(F.col("severity").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("dimension", F.lit("severity"))
    by_step = (
        results.where(F.col("status") == "failed")
        .groupBy(F.col("step_order").cast("string").alias("name"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .withColumn("dimension", F.lit("step"))
    )
    if top is not None:
        by_step = by_step.orderBy(F.desc("value"), "name").limit(top)
    overall = results.agg(
        F.bround(F.count_if(F.col("status") == "ok") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias("value")
    ).select(F.lit("overall_pass_rate_pct").alias("name"), "value", F.lit("total").alias("dimension"))
    return by_type.unionByName(by_severity).unionByName(by_step).unionByName(overall).select("dimension", "name", "value")


def schedule_totals(runs: DataFrame) -> DataFrame:
    """Number, mean and longest duration and mean success of all scheduled runs."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.bround(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"), F.bround(F.avg("success_rate_pct"), 1).alias("avg_success_rate_pct"),
    )


def last_runs(runs: DataFrame, count: int) -> DataFrame:
    """The newest runs, by falling run_id."""
    return runs.orderBy(F.desc("run_id")).limit(count)


# Penalty of a finding, by kind.
GARBAGE_PENALTY = {"high": 8, "medium": 4, "low": 1}
RISK_PENALTY = {"high": 10, "medium": 5, "low": 2}


def assessment_findings(
    entities: DataFrame, operations: DataFrame, fields: DataFrame, failures: DataFrame, metrics: DataFrame, top: int | None = None
) -> DataFrame:
    """Findings of a code base as rows: unused items, slow metrics and risky flows (with ``top`` the riskiest).

    ``entities``: entity, storage_type; ``operations`` and ``fields``: entity; ``failures``:
    flow_name; ``metrics``: target, metric (tps, avg_latency_ms), delta_pct.
    """
    idle = entities.join(operations.select("entity").distinct(), "entity", "left_anti").select(
        F.lit("unused").alias("kind"), F.col("entity").alias("name"), F.lit("no operations").alias("reason"),
        F.when(F.col("storage_type") == "sql", "low").otherwise("medium").alias("severity"),
    )
    hollow = (
        entities.join(operations.select("entity").distinct(), "entity", "left_semi")
        .join(fields.select("entity").distinct(), "entity", "left_anti")
        .select(F.lit("unused").alias("kind"), F.col("entity").alias("name"), F.lit("no fields").alias("reason"), F.lit("low").alias("severity"))
    )
    tps = (F.col("metric") == "tps") & (F.col("delta_pct") < -15)
    latency = (F.col("metric") == "avg_latency_ms") & (F.col("delta_pct") > 20)
    slow = metrics.where(tps | latency).select(
        F.lit("bottleneck").alias("kind"), F.col("target").alias("name"),
        F.when(tps, "performance_degradation").otherwise("latency_increase").alias("reason"),
        F.when(F.when(tps, F.col("delta_pct") < -30).otherwise(F.col("delta_pct") > 50), "high").otherwise("medium").alias("severity"),
    )
    risky = failures.groupBy("flow_name").agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        risky = risky.orderBy(F.desc("n"), "flow_name").limit(top)
    risky = risky.select(
        F.lit("risk").alias("kind"), F.col("flow_name").alias("name"), F.lit("failing flow").alias("reason"),
        F.when(F.col("n") > 10, "high").otherwise("medium").alias("severity"),
    )
    return idle.unionByName(hollow).unionByName(slow).unionByName(risky)


def health_score(findings: DataFrame) -> DataFrame:
    """Score 0..100: 100 less the penalty of every finding, and 1.5 for each beyond twenty."""

    def weight(table: dict[str, int], factor: float = 1.0) -> Column:
        return F.coalesce(*[F.when(F.col("severity") == s, p * factor) for s, p in table.items()], F.lit(2.0 * factor))

    penalty = (
        F.when(F.col("kind") == "unused", weight(GARBAGE_PENALTY))
        .when(F.col("reason") == "performance_degradation", 10.0)
        .when(F.col("reason") == "latency_increase", 8.0)
        .otherwise(weight(RISK_PENALTY, 1.5))
    )
    totals = findings.agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum(penalty), F.lit(0.0)).alias("penalty"))
    extra = F.greatest(F.col("findings") - 20, F.lit(0)) * 1.5
    return totals.select(
        "findings", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.lit(100.0) - F.col("penalty") - extra, 1))).alias("health_score")
    )


def session_script_summary(inputs: DataFrame, expected_fields: DataFrame) -> DataFrame:
    """Generated sessions checked against their template.

    ``inputs``: journey_id, session_id, type (input, command), field, value;
    ``expected_fields``: journey_id, field.
    """
    unresolved = F.contains("value", F.lit("{{"))
    per_session = inputs.groupBy("journey_id", "session_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("type") == "input").alias("inputs"),
        F.count_if(F.col("type") == "command").alias("commands"),
        F.count_if(unresolved).alias("unresolved"),
    )
    totals = per_session.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("unresolved") == 0).alias("valid_sessions"),
        F.sum("inputs").alias("inputs"),
        F.sum("commands").alias("commands"),
        F.sum("unresolved").alias("unresolved"),
    )
    found = inputs.where(F.col("type") == "input").select("journey_id", "field").distinct().withColumn("hit", F.lit(True))
    coverage = (
        expected_fields.distinct()
        .join(found, ["journey_id", "field"], "left")
        .groupBy("journey_id")
        .agg(F.bround(F.count("hit") / F.count(F.lit(1)) * 100, 1).alias("coverage_pct"))
    )
    return totals.join(coverage, "journey_id", "left")
