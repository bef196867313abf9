"""Synthetic data: every value is a function of seed, entity, field and row.

Rows are addressed by number, so any partition can produce any row, twice if it must:
a lost executor never changes the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as tx
from tracewell.operators import graph
from tracewell.plans import ordered
from tracewell.registry import Generators

# Lists the generators pick from.
FIRST_NAMES = (
    "Ana Beatriz Carla Daniela Eduarda Fernanda Gabriela Helena Igor Joao Kleber Lucas Marcos Natalia Otavio Paulo "
    "Rafael Silvia Tatiana Ubiratan Valeria Wagner Xenia Amanda Bruno Camila Diego Elaine Felipe Gustavo Henrique "
    "Isabela Juliana Karina Leonardo Mariana Nicolas Olivia Patricia Renata Sergio Thiago"
).split()
LAST_NAMES = (
    "Silva Santos Oliveira Souza Lima Pereira Costa Ferreira Rodrigues Almeida Nascimento Araujo Barbosa Cardoso "
    "Carvalho Castro Dias Duarte Freitas Gomes"
).split()
COMPANY_PREFIXES = ("", "Comercio", "Industria", "Servicos", "Tecnologia", "Distribuidora", "Importadora")
COMPANY_BASES = (
    "Alvorada Bandeirantes Caravelas Dourados Estrela Fenix Gloria Horizonte Ipiranga Jequitiba Meridional NorteSul "
    "OuroVerde Planalto RioBranco"
).split()
COMPANY_SUFFIXES = ("Ltda", "S.A.", "EIRELI", "ME", "EPP")
STREETS = (
    "Rua das Flores", "Avenida Paulista", "Rua Augusta", "Alameda Santos", "Rua da Consolacao",
    "Avenida Brigadeiro Faria Lima", "Rua Oscar Freire", "Avenida Reboucas", "Rua Teodoro Sampaio", "Rua Cardeal Arcoverde",
)
AREA_CODES = (
    "11 12 13 14 15 16 17 18 19 21 22 24 27 28 31 32 33 34 35 37 38 41 42 43 44 45 46 47 48 49 51 53 54 55 61 62 63 64 "
    "65 66 67 68 69 71 73 74 75 77 79 81 82 83 84 85 86 87 88 89 91 92 93 94 95 96 97 98 99"
).split()
MAIL_DOMAINS = ("email.com.br", "provedor.com.br", "corp.com.br", "empresa.com.br", "mail.com")
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud"
).split()
CNPJ_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def draw(seed: int, label: str, row: Column, size: int | Column) -> Column:
    """Number in 0..size-1 from seed, field label and row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), row), F.lit(size) if isinstance(size, int) else size)


def unit(seed: int, label: str, row: Column) -> Column:
    """Number in [0, 1)."""
    return draw(seed, label, row, 1 << 40) / float(1 << 40)


def pick(values, seed: int, label: str, row: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(seed, label, row, len(values)).cast("int"))


def digits(seed: int, label: str, row: Column, count: int) -> Column:
    return F.lpad(draw(seed, label, row, 10**count).cast("string"), count, "0")


def check_digit(number: Column, weights: tuple[int, ...]) -> Column:
    """Modulo-11 check digit of a digit string; remainders below two give 0."""
    products = F.zip_with(F.split(number, ""), F.array(*[F.lit(w) for w in weights]), lambda d, w: d.cast("int") * w)
    return F.aggregate(
        products, F.lit(0), lambda a, x: a + x, lambda s: F.when(s % 11 < 2, 0).otherwise(11 - s % 11).cast("string")
    )


def cpf(base: Column) -> Column:
    """Formatted person number from nine digits."""
    one = F.concat(base, check_digit(base, tuple(range(10, 1, -1))))
    full = F.concat(one, check_digit(one, tuple(range(11, 1, -1))))
    return F.regexp_replace(full, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")


def cnpj(base: Column) -> Column:
    """Formatted company number from twelve digits."""
    one = F.concat(base, check_digit(base, CNPJ_WEIGHTS))
    full = F.concat(one, check_digit(one, (6, *CNPJ_WEIGHTS)))
    return F.regexp_replace(full, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def _amount(seed: int, label: str, row: Column, low: float, high: float) -> Column:
    return unit(seed, label, row) * (high - low) + low


def _range(options: dict, low, high) -> tuple:
    low = options["min"] if options.get("min") is not None else low
    high = options["max"] if options.get("max") is not None else high
    return low, high


def _person_name(seed, label, row, **_):
    return F.concat(pick(FIRST_NAMES, seed, label + "/first", row), F.lit(" "), pick(LAST_NAMES, seed, label + "/last", row))


def _company_name(seed, label, row, **_):
    prefix = pick(COMPANY_PREFIXES, seed, label + "/prefix", row)
    return F.concat_ws(
        " ", F.when(prefix != "", prefix), pick(COMPANY_BASES, seed, label + "/base", row), pick(COMPANY_SUFFIXES, seed, label + "/suffix", row)
    )


def _phone(seed, label, row, **_):
    return F.concat(
        F.lit("("), pick(AREA_CODES, seed, label + "/area", row), F.lit(") 9"), digits(seed, label + "/a", row, 4), F.lit("-"), digits(seed, label + "/b", row, 4)
    )


def _email(seed, label, row, **_):
    letters = F.substring(F.translate(F.sha2(F.concat_ws("/", F.lit(f"{seed}/{label}"), row.cast("string")), 256), "0123456789", "ghijklmnop"), 1, 12)
    length = (draw(seed, label + "/length", row, 8) + 5).cast("int")
    return F.concat(F.left(letters, length), F.lit("@"), pick(MAIL_DOMAINS, seed, label + "/domain", row))


def _address(seed, label, row, **_):
    return F.concat(pick(STREETS, seed, label + "/street", row), F.lit(", "), (draw(seed, label + "/number", row, 9999) + 1).cast("string"))


def _day(seed, label, row, start="2000-01-01", end="2030-12-31", **_):
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return F.date_add(first, draw(seed, label, row, F.date_diff(last, first) + 1).cast("int"))


def _date(seed, label, row, **options):
    return F.date_format(_day(seed, label, row, **options), "yyyy-MM-dd")


def _datetime(seed, label, row, **options):
    second = F.timestamp_seconds(draw(seed, label + "/second", row, 86400))
    return F.concat(F.date_format(_day(seed, label, row, **options), "yyyy-MM-dd"), F.lit(" "), F.date_format(second, "HH:mm:ss"))


def _number(seed, label, row, **options):
    low, high = _range(options, 0, 999999)
    return draw(seed, label, row, int(high) - int(low) + 1) + int(low)


def _decimal(seed, label, row, **options):
    low, high = _range(options, 0.0, 999999.99)
    return F.round(_amount(seed, label, row, low, high), 2)


def _money(seed, label, row, **options):
    low, high = _range(options, 0.01, 999999.99)
    return F.format_number(_amount(seed, label, row, low, high), 2)


def _text(seed, label, row, **options):
    least = options.get("min_length") or 5
    most = options.get("max_length") or 200
    count = F.lit(least // 3 + 1) + draw(seed, label + "/words", row, 6)
    words = F.transform(
        F.sequence(F.lit(1), count.cast("int")),
        lambda i: F.get(F.array(*[F.lit(w) for w in FILLER_WORDS]), F.pmod(F.xxhash64(F.lit(seed), F.lit(label), row, i), F.lit(len(FILLER_WORDS))).cast("int")),
    )
    return F.rtrim(F.left(F.array_join(words, " "), F.lit(int(most))))


def _code(seed, label, row, prefix="", width=6, **options):
    low, high = _range(options, 1, 999999)
    value = draw(seed, label, row, int(high) - int(low) + 1) + int(low)
    return F.concat(F.lit(prefix), F.lpad(value.cast("string"), width, "0"))


def _uuid(seed, label, row, **_):
    h = F.sha2(F.concat_ws("/", F.lit(f"{seed}/{label}"), row.cast("string")), 256)
    return F.regexp_replace(F.left(h, F.lit(32)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def generators() -> Generators:
    """The built-in generators; users may register their own or replace one."""
    return Generators(
        {
            "person_name": _person_name,
            "company_name": _company_name,
            "cpf": lambda seed, label, row, **_: cpf(digits(seed, label, row, 9)),
            "cnpj": lambda seed, label, row, **_: cnpj(F.concat(digits(seed, label, row, 8), F.lit("0001"))),
            "rg": lambda seed, label, row, **_: F.regexp_replace(digits(seed, label, row, 9), r"^(\d{2})(\d{3})(\d{3})(\d)$", "$1.$2.$3-$4"),
            "phone": _phone,
            "email": _email,
            "address": _address,
            "cep": lambda seed, label, row, **_: F.regexp_replace(digits(seed, label, row, 8), r"^(\d{5})(\d{3})$", "$1-$2"),
            "date": _date,
            "datetime": _datetime,
            "number": _number,
            "decimal": _decimal,
            "money": _money,
            "choice": lambda seed, label, row, choices=("A", "B", "C"), **_: pick(choices, seed, label, row),
            "boolean": lambda seed, label, row, **_: draw(seed, label, row, 2) == 1,
            "uuid": _uuid,
            "sequence": lambda seed, label, row, start=1, step=1, **_: row * step + start,
            "text": _text,
            "code": _code,
        }
    )


FORMATS = ("cpf", "cnpj", "rg", "cep", "email", "phone", "date", "datetime")
# Generator by declared data type.
TYPE_GENERATORS = {
    **{t: t for t in ("person_name", "company_name", "phone", "email", "address", "cep", "date", "datetime", "number", "decimal",
                      "money", "boolean", "uuid", "code", "text")},
    "integer": "number",
}


def generator_name(field: dict) -> str:
    """Generator of a field: format, then choices, then data type, else text."""
    if field.get("format") in FORMATS:
        return field["format"]
    if field.get("choices"):
        return "choice"
    return TYPE_GENERATORS.get(field.get("datatype", "text"), "text")


def build_dataset(
    rows: DataFrame, fields: list[dict], seed: int = 0, entity: str = "", known: Generators | None = None, row: str = "row"
) -> DataFrame:
    """One column per field of the schema for every row number.

    A unique field is drawn again (with another label) for rows whose value an earlier row
    already has; values still shared after the retries get the row number appended, so
    uniqueness always holds.
    """
    known = known or generators()
    out = rows
    unique = []
    for field in fields:
        options = {k: field[k] for k in ("choices", "min", "max", "min_length", "max_length") if field.get(k) is not None}
        make = known.get(generator_name(field))
        label = f"{entity}.{field['name']}"
        out = out.withColumn(field["name"], make(seed, label, F.col(row), **options))
        if field.get("unique"):
            unique.append((field["name"], make, label, options))
    for name, make, label, options in unique:
        out = _make_unique(out, name, row, lambda n, m=make, l=label, o=options: m(seed, f"{l}#{n}", F.col(row), **o))
    return out


def _make_unique(df: DataFrame, name: str, row: str, again, retries: int = 2) -> DataFrame:
    for attempt in range(1, retries + 1):
        first = df.groupBy(name).agg(F.min(row).alias("__first"))
        df = (
            df.join(first, name)
            .withColumn(name, F.when(F.col(row) == F.col("__first"), F.col(name)).otherwise(again(attempt)))
            .drop("__first")
        )
    first = df.groupBy(name).agg(F.min(row).alias("__first"))
    return (
        df.join(first, name)
        .withColumn(name, F.when(F.col(row) == F.col("__first"), F.col(name).cast("string")).otherwise(F.concat_ws("-", F.col(name).cast("string"), F.col(row).cast("string"))))
        .drop("__first")
    )


def assign_parents(children: DataFrame, parents: DataFrame, row: str, key: str, out: str, seed: int = 0) -> DataFrame:
    """Parent key of every child: row i takes parent i, rows beyond take a drawn parent.

    Both sides meet on the parent's row number by equality.
    """
    numbered = ordered.scan(
        parents.select(key).withColumn("__all", F.lit(0)), ["__all"], [key], __no=ordered.row_number()
    ).select(F.col(key).alias(out), (F.col("__no") - 1).alias("__slot"))
    total = parents.agg(F.count(F.lit(1))).scalar()
    slot = F.when(F.col(row) < total, F.col(row)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.col(row)), total))
    return children.withColumn("__slot", slot).join(numbered, "__slot", "left").drop("__slot")


def generate_ordered(
    spark: SparkSession, schemas: dict[str, list[dict]], keys: dict[str, tuple[str, str]], quantities: dict[str, int], seed: int = 0
) -> dict[str, DataFrame]:
    """Datasets of several entities, parents before children, child keys taken from the parents.

    ``keys`` maps ``entity.field`` to (parent entity, parent field).
    """
    nodes = spark.createDataFrame([(e,) for e in schemas], "node string")
    links = [(k.split(".")[0], p) for k, (p, _) in keys.items()]
    edges = spark.createDataFrame(links, "src string, dst string")
    levels = graph.dependency_levels(nodes, edges).orderBy("level", "node").collect()  # one row per entity
    built: dict[str, DataFrame] = {}
    for entity, _ in sorted(((r["node"], r["level"]) for r in levels), key=lambda x: (x[1] is None, x[1] or 0, x[0])):
        rows = spark.range(quantities.get(entity, 100)).withColumnRenamed("id", "row")
        own = [f for f in schemas[entity] if f"{entity}.{f['name']}" not in keys]
        data = build_dataset(rows, own, seed, entity)
        for field in schemas[entity]:
            parent, column = keys.get(f"{entity}.{field['name']}", (None, None))
            if parent in built:
                data = assign_parents(data, built[parent], "row", column, field["name"], seed)
        built[entity] = data
    return built


def missing_parents(children: DataFrame, field: str, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return children.join(parents.select(F.col(key).alias(field)).distinct(), field, "left_anti")


def violations(rows: DataFrame, key: str, rules: list[dict]) -> DataFrame:
    """One row per broken rule of a record (required, length, choices, range)."""
    checks = []
    for rule in rules:
        name = rule["field"]
        value = F.col(name)
        is_text = dict(rows.dtypes)[name] == "string"

        def broken(kind: str, test: Column, name=name, value=value) -> Column:
            return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit(kind).alias("rule"), value.cast("string").alias("value")))

        if rule.get("required"):
            checks.append(broken("required", value.isNull() | (F.trim(value.cast("string")) == "")))
        if is_text:
            filled = F.trim(value) != ""
            if rule.get("min_length") is not None:
                checks.append(broken("min_length", filled & (F.length(value) < rule["min_length"])))
            if rule.get("max_length") is not None:
                checks.append(broken("max_length", filled & (F.length(value) > rule["max_length"])))
            if rule.get("choices"):
                checks.append(broken("choices", filled & ~value.isin(*rule["choices"])))
        else:
            if rule.get("min") is not None:
                checks.append(broken("min", value < rule["min"]))
            if rule.get("max") is not None:
                checks.append(broken("max", value > rule["max"]))
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.*")


def preflight(rows: DataFrame, key: str, rules: list[dict], sample: int = 20) -> bool:
    """Gate before bulk generation: the first rows must break no rule."""
    return violations(rows.orderBy(key).limit(sample), key, rules).limit(1).count() == 0


#: Steps that share one rendered input, and parts of the sessions of a journey.
STEPS_TOGETHER, DEALS = 1024, 16


def session_scripts(sessions: DataFrame, steps: DataFrame, data: DataFrame, counted: bool = False) -> DataFrame:
    """Rendered inputs of generated sessions: session × step of its journey, values from the dataset.

    ``sessions``: journey_id, session_no; ``steps``: journey_id, step_order, input_template;
    ``data``: journey_id, row, values (map with upper-case keys).  A session uses one data row,
    so a field shared by several steps has one value, and steps of one template are rendered together.
    With ``counted`` a row stands for all steps of a template, their number in ``steps``.
    """
    sizes = data.groupBy("journey_id").agg(F.count(F.lit(1)).alias("__n"))
    placed = sessions.join(sizes, "journey_id").withColumn("row", F.col("session_no") % F.col("__n"))
    chosen = placed.join(data, ["journey_id", "row"]).select("journey_id", "session_no", "values")
    value = tx.render_template(F.col("input_template"), F.col("values")).alias("value")
    if counted:
        alike = steps.groupBy("journey_id", "input_template").agg(F.count(F.lit(1)).alias("steps"))
        return chosen.join(alike, "journey_id").select("journey_id", "session_no", "input_template", "steps", value)
    numbered = ordered.scan(steps.select("journey_id", "input_template", "step_order"), ["journey_id", "input_template"], ["step_order"], no=ordered.row_number())
    packed = numbered.groupBy("journey_id", "input_template", F.floor((F.col("no") - 1) / STEPS_TOGETHER).alias("block")).agg(
        F.collect_list(F.struct("step_order")).alias("steps")
    )
    # a journey is dealt over several tasks: what comes out is far more than what goes in
    spark = sessions.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = chosen.withColumn("deal", F.pmod(F.xxhash64("session_no"), F.lit(DEALS)).cast("int")).repartition(parts, "journey_id", "deal")
    everywhere = packed.withColumn("deal", F.explode(F.array(*[F.lit(n) for n in range(DEALS)]))).repartition(parts, "journey_id", "deal")
    rendered = dealt.join(everywhere, ["journey_id", "deal"]).select("journey_id", "session_no", "input_template", value, "steps")
    return rendered.select("*", F.explode("steps").alias("s")).select("journey_id", "session_no", "s.step_order", "input_template", "value")


def input_changes(scripts: DataFrame) -> DataFrame:
    """Replaced and unchanged inputs of each generated session; a row with ``steps`` stands for so many."""
    changed = F.col("value") != F.col("input_template")
    steps = F.col("steps") if "steps" in scripts.columns else F.lit(1)

    def number(which: Column) -> Column:
        return F.sum(F.when(which, steps).otherwise(0)).cast("long")

    return scripts.groupBy("journey_id", "session_no").agg(
        number(F.lit(True)).alias("total_inputs"),
        number(changed).alias("replaced"),
        number(~changed).alias("unchanged"),
        F.bround(number(changed) / number(F.lit(True)) * 100, 1).alias("replaced_pct"),
    )


# Steps of a journey over one entity (screen, action, trigger).
CRUD_STEPS = (
    ("menu", "navigate", ""), ("include", "navigate", "ENTER"), ("include", "input", "F10"), ("include_confirm", "verify", "ENTER"),
    ("consult", "navigate", ""), ("consult", "input", "ENTER"), ("alter", "navigate", ""), ("alter", "submit", "F10"),
    ("delete", "navigate", ""), ("delete", "submit", "ENTER"),
)


def crud_journeys(entities: DataFrame) -> DataFrame:
    """Journey steps of each entity with complete access: include, consult, alter, delete.

    ``entities``: entity, fields (array), is_complete.
    """
    low = F.lower("entity")

    def mark(field: Column) -> Column:
        return F.concat(F.lit("{{"), low, F.lit("."), field, F.lit("}}"))

    everything = F.array_join(F.transform("fields", mark), "\n")
    first = mark(F.get("fields", F.lit(0)))
    rows = [
        F.struct(
            F.lit(screen).alias("screen"), F.lit(action).alias("action"), F.lit(trigger).alias("trigger"),
            (everything if screen == "include" else first if screen == "consult" else F.lit("")).alias("input_template")
            if action == "input" else F.lit("").alias("input_template"),
        )
        for screen, action, trigger in CRUD_STEPS
    ]
    wanted = F.filter(F.array(*rows), lambda s: (s["action"] != "input") | (F.size("fields") > 0))
    return (
        entities.where("is_complete")
        .select("entity", low.alias("low"), F.posexplode(wanted).alias("step_order", "s"))
        .select(
            F.concat(F.lit("crud_"), "low").alias("journey_id"), "step_order",
            F.when(F.col("s.screen") == "menu", F.concat(F.lit("menu_"), F.left("low", F.lit(3)))).otherwise(F.concat_ws("_", F.col("low"), F.col("s.screen"))).alias("screen_id"),
            "s.action", "s.trigger", "s.input_template",
        )
    )


def validate_journeys(steps: DataFrame) -> DataFrame:
    """Checks and score of each journey.

    15 points per issue (wrong first step, order, duplicates), 5 per warning (no submit,
    screens used more than twice), 30 when shorter than three steps.
    """
    hot = ordered.hot_keys(steps, ["journey_id"], "position")
    walked = ordered.scan(steps, ["journey_id"], ["position"], hot, before=ordered.lag(F.col("step_order")))
    screens = steps.groupBy("journey_id", "screen_id").agg(F.count(F.lit(1)).alias("n")).groupBy("journey_id").agg(F.max("n").alias("most"))
    orders = steps.groupBy("journey_id", "step_order").agg(F.count(F.lit(1)).alias("n")).groupBy("journey_id").agg(F.max("n").alias("copies"))
    facts = walked.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.min_by("action", "position").alias("first_action"),
        F.count_if(F.col("action").isin("submit", "verify")).alias("closing_steps"),
        F.count_if(F.col("step_order") < F.col("before")).alias("backward"),
    )
    joined = facts.join(screens, "journey_id").join(orders, "journey_id")
    issues = (
        F.when(F.col("first_action") != "navigate", 1).otherwise(0) + F.when(F.col("backward") > 0, 1).otherwise(0)
        + F.when(F.col("copies") > 1, 1).otherwise(0)
    )
    warnings = F.when(F.col("closing_steps") == 0, 1).otherwise(0) + F.when(F.col("most") > 2, 1).otherwise(0)
    score = F.greatest(F.lit(0.0), F.lit(100.0) - issues * 15 - warnings * 5 - F.when(F.col("total_steps") < 3, 30).otherwise(0))
    return joined.select(
        "journey_id", "total_steps", issues.alias("issues"), warnings.alias("warnings"), score.alias("score"),
        ((issues == 0) & (score >= 50)).alias("is_valid"),
    )


def verify_journeys(steps: DataFrame, screens: DataFrame) -> DataFrame:
    """i-th step against i-th screen of its session, with the state of the screen.

    ``steps``: session_id, position, expected_signature; ``screens``: session_id, position, text.
    A step without screen passes, as an empty screen has no error, and is flagged.
    """
    from tracewell.operators.screens import classify_screens

    joined = steps.join(screens, ["session_id", "position"], "left").withColumn("missing_screen", F.col("text").isNull())
    judged = classify_screens(joined.withColumn("text", F.coalesce("text", F.lit(""))))
    result = F.when(F.col("status").isin("error", "navigation_divergence"), "failed").when(F.col("status") == "warning", "warning").otherwise("ok")
    return judged.select("session_id", "position", "missing_screen", result.alias("status"), "error_type", "severity")


def session_mix(mixes: DataFrame, total_column: str = "total_sessions") -> DataFrame:
    """Sessions per journey of a weighted mix; the last journey takes the rest.

    ``mixes``: mix_id, position, journey_id, weight, min_sessions, max_sessions, total_sessions.
    A journey only counts while sessions are left.
    """
    sums = mixes.groupBy("mix_id").agg(F.sum("weight").alias("__w"), F.max("position").alias("__last"))
    share = F.floor(F.col(total_column) * F.col("weight") / F.col("__w"))
    wanted = F.greatest(F.col("min_sessions"), share)
    wanted = F.when(F.col("max_sessions") > 0, F.least(wanted, F.col("max_sessions"))).otherwise(wanted)
    base = mixes.join(sums, "mix_id").where(F.col("__w") > 0).withColumn("__count", wanted)
    walked = ordered.scan(base, ["mix_id"], ["position"], __upto=ordered.running_sum(F.col("__count")))
    before = F.col("__upto") - F.col("__count")
    left = F.col(total_column) - before
    return (
        walked.withColumn("sessions", F.when(F.col("position") == F.col("__last"), left).otherwise(F.col("__count")).cast("long"))
        .where(left > 0)
        .select("mix_id", "journey_id", "position", "sessions")
    )


def shuffled_sessions(shares: DataFrame, seed: int = 0) -> DataFrame:
    """One row per session of a mix in seeded random order."""
    each = shares.where(F.col("sessions") > 0).select(
        "mix_id", "journey_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("sessions"))).alias("n")
    )
    keyed = each.withColumn("__key", F.xxhash64(F.lit(seed), "mix_id", "journey_id", "n"))
    return ordered.scan(keyed, ["mix_id"], ["__key", "journey_id", "n"], place=ordered.row_number()).drop("__key")
