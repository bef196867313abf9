"""Screen-text functions: normalisation, layout signature, samples, masking, key input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.similarity import block_ratio

# Box-drawing characters and their plain forms.
BOX_CHARACTERS = "─━│┃┌┏┐┓└┗┘┛├┣┤┫┬┳┴┻┼╋═║╔╗╚╝╠╣╦╩╬"
BOX_PLAIN = "--||++++++++++++++++++=|+++++++++"

# Fields that change on every run, masked before screens are compared.
VOLATILE_MASKS = (
    (r"(?U)\d{2}/\d{2}/\d{2,4}", "##DATA##"),
    (r"(?U)[\d.,]+\s*Kb\b", "##KB##"),
    (r"(?U)\b[A-Z]\d{5,}\b", "##ID##"),
    (r"(?U)\b\d{2}:\d{2}(?::\d{2})?\b", "##HORA##"),
    (r"(?i)(?:ibm aix \(common\)|linux x86) *", "##PLATAFORMA##"),
)

# blanks at the end of a line; a run is tried from its beginning only and never given back
LINE_TAIL = r"(?U)(?<![^\S\n])[^\S\n]++(?=\n|\z)"
# white space besides the blank and the line end
OTHER_BLANK = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

LABEL = r"([A-Za-zÀ-ÿ][0-9A-Za-zÀ-ÿ _]{1,20}):"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def only_if(value: Column, test, change) -> Column:
    """``change(value)`` where ``test(value)`` holds, else the value: a search for a plain string is far
    cheaper than a replacement that finds nothing."""
    return once(value, lambda x: F.when(test(x), change(x)).otherwise(x))


def strip(text: Column) -> Column:
    """Trim any Unicode white space on both ends."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_ansi(text: Column) -> Column:
    return only_if(
        text, lambda x: F.contains(x, F.lit("\x1b")), lambda x: F.regexp_replace(F.regexp_replace(x, r"\x1B\[[0-9;?]*[A-Za-z]", ""), r"\x1B.", "")
    )


def trim_lines(text: Column) -> Column:
    """Lines without white space at their ends; texts without any are not searched for it."""
    return only_if(
        text, lambda x: F.contains(x, F.lit(" \n")) | F.endswith(x, F.lit(" ")) | x.rlike(OTHER_BLANK), lambda x: F.regexp_replace(x, LINE_TAIL, "")
    )


def normalize_whitespace(text: Column) -> Column:
    """Unify line ends, trim lines on the right, keep one of a run of blank lines.

    Works on the whole text with two replacements, so its cost stays linear.
    """
    trimmed = trim_lines(unify_newlines(text))
    # a run of n line ends is n blank lines at either end of the text, n - 1 inside it
    inside = only_if(trimmed, lambda x: F.contains(x, F.lit("\n\n\n")), lambda x: F.regexp_replace(x, r"(?<=[^\n])\n{3,}(?=[^\n])", "\n\n"))
    double = F.lit("\n\n")
    ends = only_if(inside, lambda x: F.startswith(x, double) | F.endswith(x, double), lambda x: F.regexp_replace(x, r"\A\n{2,}|\n{2,}\z", "\n"))
    return only_if(ends, lambda x: F.btrim(x, F.lit("\n")) == "", lambda x: F.lit(""))


def normalize_screen(text: Column) -> Column:
    # translating walks the text character by character, so only screens with boxes pay for it
    plain = only_if(strip_ansi(text), lambda x: x.rlike(f"[{BOX_CHARACTERS}]"), lambda x: F.translate(x, BOX_CHARACTERS, BOX_PLAIN))
    return normalize_whitespace(plain)


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def layout_signature(norm: Column) -> Column:
    """Line count, width, framed titles and labels of a normalised screen."""
    body = F.regexp_replace(norm, r"(?U)\A(?:\s*\n)+|(?:\n\s*)+\z", "")

    def signed(rows: Column) -> Column:
        empty = (F.size(rows) == 1) & is_blank(F.get(rows, F.lit(0)))
        width = F.array_max(F.transform(rows, lambda x: F.length(x)))
        framed = F.filter(
            F.slice(rows, 1, 4), lambda x: (strip(x) != "") & (F.length(F.regexp_replace(x, r"[^+\-=|]", "")) >= 3)
        )
        titles = F.array_join(F.transform(framed, lambda x: strip(x)), "|")
        labelled = F.filter(rows, lambda x: F.contains(x, F.lit(":")))
        found = F.transform(labelled, lambda x: F.regexp_extract(strip(x), LABEL, 1))
        labels = F.array_join(
            F.transform(F.filter(found, lambda x: x != ""), lambda x: F.regexp_replace(x, r"\s+", " ")), ";"
        )
        return F.concat(
            F.lit("L="), F.when(empty, 0).otherwise(F.size(rows)).cast("string"),
            F.lit(";W="), F.when(empty, 0).otherwise(width).cast("string"),
            F.when(titles != "", F.concat(F.lit(";TIT="), titles)).otherwise(""),
            F.when(labels != "", F.concat(F.lit(";LBL="), labels)).otherwise(""),
        )

    return F.transform(F.array(lines(body)), signed)[0]


def screen_sample(norm: Column, max_lines: int = 6, max_width: int = 120) -> Column:
    """The first non-blank lines of a screen, cut to a width."""
    shown = F.filter(F.transform(lines(norm), lambda x: rstrip(x)), lambda x: x != "")
    return F.array_join(F.transform(F.slice(shown, 1, max_lines), lambda x: F.left(x, F.lit(max_width))), "\n")


def mask_volatile(text: Column) -> Column:
    for shape, token in VOLATILE_MASKS:
        text = F.regexp_replace(text, shape, token)
    return text


def comparable_screen(text: Column) -> Column:
    """Text of a screen as it is compared: right trim, no blank tail, masks, lower case."""
    trimmed = trim_lines(unify_newlines(text))
    return F.lower(mask_volatile(F.regexp_replace(trimmed, r"\n+\z", "")))


def _bytes_text(data: Column) -> Column:
    """Each byte as one character, so byte rules become character rules."""
    return F.decode(data, "ISO-8859-1")


def is_paste(data: Column) -> Column:
    text = _bytes_text(data)
    size = F.length(text)
    breaks = F.length(F.regexp_replace(text, r"[^\r\n]", ""))
    printable = F.length(F.regexp_replace(text, r"[^ -~]", ""))
    long_text = (size >= 16) & (printable >= F.greatest(F.lit(8), size - 2)) & ~F.contains(text, F.lit("\x1b"))
    return (size >= 64) | (breaks > 1) | long_text


def is_command(data: Column) -> Column:
    return _bytes_text(data).rlike(r"\A[ -~]{1,120}[\r\n]+\z")


def classify_input(data: Column) -> Column:
    """Kind of a keystroke chunk."""
    text = _bytes_text(data)
    return (
        F.when(data.isNull() | (F.octet_length(data) == 0), "empty")
        .when(is_paste(data), "paste")
        .when(is_command(data), "command_with_enter")
        .when(text.isin("\r", "\n", "\r\n"), "enter")
        .when(text == "\t", "tab")
        .when(text.isin("\x08", "\x7f"), "backspace")
        .when(text == "\x1b", "escape")
        .when(text.rlike(r"\A[\x00-\x1f\x7f]+\z"), "control")
        .when(text.startswith("\x1b["), "ansi_sequence")
        .when(text.rlike(r"\A[ -~]\z"), "printable")
        .when(text.rlike(r"\A[ -~]{2,}\z"), "multi_char")
        .otherwise("bytes")
    )


def printable_input(data: Column, max_len: int = 120) -> Column:
    """Readable form of the first bytes of an input."""
    named = {13: "\\r", 10: "\\n", 9: "\\t", 27: "\\e", 8: "\\b"}
    shown = F.split(F.hex(F.substring(data, 1, max_len)), "(?<=\\G..)")

    def render(h: Column) -> Column:
        code = F.conv(h, 16, 10).cast("int")
        out = F.when((code >= 32) & (code <= 126), F.char(code)).otherwise(F.concat(F.lit("\\x"), F.lower(h)))
        for value, text in named.items():
            out = F.when(code == value, text).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(shown, lambda h: h != ""), render), "")


def atomic_inputs(data: Column) -> Column:
    """One input as the array of atomic chunks it is replayed in."""
    text = _bytes_text(data)
    whole = F.array(text)
    typed = F.regexp_extract(text, r"\A([ -~]*)", 1)
    ending = F.regexp_extract(text, r"([\r\n]+)\z", 1)
    letters = F.split(typed, "")
    return (
        F.when(text.startswith("\x1b") | is_paste(data), whole)
        .when(is_command(data), F.concat(letters, F.array(ending)))
        .when(text.rlike(r"\A[ -~]{2,8}\z"), F.split(text, ""))
        .otherwise(whole)
    )


KEY_TOKENS = r"\x1b\[[A-Za-z]|\x1b\[|\x1b|[\r\n]|\t|[^\x1b\r\n\t]+"


def key_events(text: Column) -> Column:
    """Typed text and control keys of an input, in order, as an array."""

    def name(token: Column) -> Column:
        return (
            F.when(token.isin("\r", "\n"), "{KEY:ENTER}")
            .when(token == "\t", "{KEY:TAB}")
            .when(token.rlike(r"\A\x1b\[[A-Za-z]\z"), F.concat(F.lit("{KEY:"), F.substring(token, 3, 1), F.lit("}")))
            .when(token.startswith("\x1b"), "{KEY:ESC}")
            .otherwise(token)
        )

    return F.transform(F.regexp_extract_all(text, F.lit(KEY_TOKENS), F.lit(0)), name)


PLACEHOLDER = r"(?U)\{\{(\w+)(?:\.(\w+))?\}\}"


def render_template(template: Column, values: Column) -> Column:
    """Fill ``{{entity.field}}`` and ``{{field}}`` from a map with upper-case keys.

    Keys are FIELD or ENTITY.FIELD; an unknown placeholder stays as it is.
    """
    marks = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(template, PLACEHOLDER, -1)

    def value(mark: Column) -> Column:
        path = F.upper(F.regexp_extract(mark, r"\{\{(.+)\}\}", 1))
        return F.coalesce(
            F.try_element_at(values, path), F.try_element_at(values, F.substring_index(path, ".", -1)), mark
        )

    body = F.zip_with(F.slice(gaps, F.lit(1), F.size(marks)), F.transform(marks, value), lambda g, v: F.concat(g, v))
    return F.concat(F.array_join(body, ""), F.element_at(gaps, -1))


def template_entities(template: Column) -> Column:
    """Sorted first names of the placeholders of a template."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))))


def decode_bytes(data: Column, encoding: Column) -> Column:
    """Text of a byte string by its charset (utf-8, latin-1, cp850, cp437, windows-1252)."""
    high = "".join(chr(c) for c in range(128, 256))
    latin = F.decode(data, "ISO-8859-1")
    out = F.make_valid_utf8(data.cast("string"))
    for name, codec in (("cp850", "cp850"), ("cp437", "cp437"), ("windows-1252", "cp1252")):
        table = bytes(range(128, 256)).decode(codec, errors="replace")
        out = F.when(encoding == name, F.translate(latin, high, table)).otherwise(out)
    return F.when(encoding.isin("iso-8859-1", "latin1"), latin).otherwise(out)


# Accepted charset names and what they stand for.
CHARSETS = {
    "utf-8": "utf-8", "utf8": "utf-8", "ascii": "utf-8", "cp850": "cp850", "ibm850": "cp850", "850": "cp850",
    "cp437": "cp437", "ibm437": "cp437", "437": "cp437", "iso-8859-1": "iso-8859-1", "latin-1": "iso-8859-1",
    "latin1": "latin1", "cp1252": "windows-1252", "windows-1252": "windows-1252", "1252": "windows-1252",
}


def normalize_charset(name: Column) -> Column:
    clean = F.lower(F.trim(name))
    out = F.lit("utf-8")
    for given, meant in CHARSETS.items():
        out = F.when(clean == given, meant).otherwise(out)
    return out


# the start of a character whose last bytes are missing, as hex at the end of a chunk
_OPEN_CHARACTER = r"(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$"


def open_tail(data: Column) -> Column:
    """Bytes at the end of a UTF-8 chunk that begin a character continued in the next one."""
    return F.unhex(F.regexp_extract(F.hex(data), _OPEN_CHARACTER, 0))


def similarity(left: Column, right: Column) -> Column:
    """Ratio of matching blocks (2·M / T); equal texts never reach Python."""
    return F.when(left == right, F.lit(1.0)).otherwise(block_ratio(left, right))
