"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import packed, with_row
from tracewell.plans.lineage import settle

KINDS = ("email", "ip", "card", "phone")
#: Characters around a candidate that are looked at.
CONTEXT = 40
#: Precision on held-out candidates that a threshold has to reach, and the threshold of a kind that has too few.
PRECISION, FEW, SAFE = 0.98, 20, 0.95
#: Margins are counted in so many steps per unit, up to this size.
STEPS, WIDEST = 200, 20

# Base formats. Each pattern starts at the beginning of a run and never gives back, so that
# scanning stays linear in the text; the matches are those of the plain patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
DIGITS = re.compile(r"[0-9]")

# Generators of further candidates: formats that are written around the plain ones.
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}+){1,6}")
AT = re.compile(r"@|[\[({]\x20?at\x20?[\])}]|\x20at\x20")
SPELT_DOT = re.compile(r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)\Z")
#: Characters of a local part that are looked at, and of a spelt dot.
LOCAL, DOT = 64, 9
NUMBER = re.compile(r"(?:\+\x20?|\()?[0-9](?:[\x20().,/_-]{0,3}[0-9]){6,24}")
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20dot\x20|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9])")
SHAPED = re.compile(r"(?:\+[0-9]{1,3}\x20?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[.-][0-9]{4}(?![0-9])")
GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])")
CUES = {
    "email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay", "master"), "phone": ("tel", "phone", "call", "fax", "mobile"),
}
N_FEATURES = 26


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each ``@`` outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        else:
            end = at + 1  # a local part never reaches over an @
        at = text.find("@", max(at + 1, end))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _phone_ends(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        found = _PHONE_RUN.match(text, at)
        end = at + 1
        if found:
            stop = found.end()
            while text[stop - 1] not in "0123456789":
                stop -= 1
            if stop - at >= 4:
                yield at, stop
                end = stop
        at = text.find("+", end)


_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]++")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base formats that pass their check, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for a, b in _phone_ends(text):
            if 8 <= sum(map(str.isdigit, text[a:b])) <= 15:
                out.append(("phone", a, b))
    return out


def spelt_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with any sign for ``@`` and for the dots, found from each sign outwards.

    The local part is what stands directly before the sign, the domain is matched once after it, and
    a sign without a character of either next to it is passed over; so no stretch is read twice.
    """
    done = 0
    for mark in AT.finditer(text):
        a, b = mark.span()
        if a < done:
            continue
        blank_before, blank_after = text[a - 1 : a] == " ", text[b : b + 1] == " "
        if mark[0] == "@":
            wide = blank_before and blank_after
            a, b = a - wide, b + wide
        elif mark[0][0] != " ":
            a, b = a - blank_before, b + blank_after
        start, least = a, max(done, a - LOCAL)
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        while start < a and (dot := SPELT_DOT.search(text, max(least, start - DOT), start)):  # the local part may have dots as well
            head = dot.start()
            while head > least and text[head - 1] in _LOCAL:
                head -= 1
            if head == dot.start():
                break
            start = head
        found = SPELT_DOMAIN.match(text, b) if start < a else None
        if found:
            done = found.end()
            yield start, done


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of high recall and any precision; they may overlap."""
    out = [("email", a, b) for a, b in spelt_emails(text)]
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if 7 <= n <= 15:
                out.append(("phone", *m.span()))
            if 13 <= n <= 19:
                digits = re.search(r"[0-9].*", m[0], re.S)
                out.append(("card", m.start() + digits.start(), m.end()))
        out += [("ip", *m.span()) for m in DOTTED.finditer(text)]
        out += [("phone", *m.span()) for m in SHAPED.finditer(text)]
        out += [("card", *m.span()) for m in GROUPED.finditer(text)]
    return list(dict.fromkeys(out))


class Cover:
    """Places that spans cover, as disjoint ascending intervals."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1  # the last interval that begins before b
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        """Cover a span that meets none of the others."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def likely(text: str, kind: str, a: int, b: int) -> bool:
    """Whether a span outside the base ones has a base format in itself, so that it is no negative example."""
    return any((k, x, y) == (kind, 0, b - a) for k, x, y in base_spans(text[a:b]))


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context features of a candidate."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    marks = {c for c in span if not c.isalnum()}
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    low = before.lower()
    parts = re.findall(r"[0-9]+", span)
    tail = re.findall(r"[A-Za-z0-9-]+", span)
    spelt = len(re.findall(r"[\[({]\x20?(?:at|dot|\.)\x20?[\])}]|\x20(?:at|dot)\x20", span))
    return [
        *(float(kind == k) for k in KINDS),
        float(b - a), float(len(digits)), len(digits) / max(1, b - a), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[-1]),
        float(len(marks)), float(span.startswith("+")), float("(" in span), float("@" in span), float(spelt), float(luhn(digits) if digits else 0),
        float(int(digits[0]) if digits else -1), float(kind == "ip" and all(map(_small, parts))),
        float(len(tail[-1]) if tail else 0), float(tail[-1].isalpha() if tail else 0),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(any(c in low for c in CUES[kind])),
        float(any(c.isdigit() for c in before[-6:] + after[:6])), float(" " in span and "." in span),
    ]


def rewritten(kind: str, span: str, k: int) -> str:
    """One of the ways in which a value of the base format is written around it."""
    if kind == "email":
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."))[k % 4]
        return span.replace("@", at, 1).replace(".", dot)
    if kind == "ip":
        return span.replace(".", ("[.]", " dot ", "(.)")[k % 3])
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", span)
        return ("." if k % 2 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return re.sub(r"^\+[0-9]\x20?", "", span) if k % 2 else span[1:]


def spoilt(kind: str, span: str, k: int) -> str:
    """A value that looks like the kind but is none: wrong check digit, part too large, bare number."""
    if kind == "card":
        return span[:-1] + str((int(span[-1]) + 1 + k % 8) % 10) if span[-1].isdigit() else span
    if kind == "ip":
        return re.sub(r"^[0-9]+", str(256 + k % 700), span)
    if kind == "phone":
        return "".join(c for c in span if c.isdigit())
    return span.split("@")[0] + " at " + span.split("@")[-1].split(".")[0] + "."


def examples(text: str) -> Iterator[tuple[str, list[float], int]]:
    """(kind, features, label): base spans and rewritten ones as 1; spoilt ones and other candidates as 0."""
    base = base_spans(text)
    cover = Cover([(a, b) for _, a, b in base])
    for kind, a, b in base:
        yield kind, describe(text, kind, a, b), 1
    for kind, a, b in candidates(text):
        if not cover.meets(a, b) and not likely(text, kind, a, b):
            yield kind, describe(text, kind, a, b), 0
    for n, (kind, a, b) in enumerate(base):
        before, after, k = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], a + n
        for label, value in ((1, rewritten(kind, text[a:b], k)), (0, spoilt(kind, text[a:b], k))):
            made, at = before + value + after, len(before)
            for of, x, y in candidates(made):
                if x < at + len(value) and at < y:
                    near = min(y, at + len(value)) - max(x, at) >= 0.9 * max(len(value), y - x)
                    yield of, describe(made, of, x, y), int(label == 1 and of == kind and near)


class Model:
    """Trees as arrays, the slope and offset of the calibration, and a threshold per kind."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]], calibration: tuple[float, float], limits: dict[str, float]):
        self.trees, self.calibration, self.limits = trees, calibration, limits

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, nodes in self.trees:
            table = np.array(nodes, float)
            at = np.zeros(len(x), int)
            for _ in range(len(nodes)):
                inner = table[at, 0] >= 0
                if not inner.any():
                    break
                feature = table[at, 0].astype(int).clip(0)
                left = x[np.arange(len(x)), feature] <= table[at, 1]
                at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(int), at)
            out += weight * table[at, 4]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        slope, offset = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * self.margin(x) + offset, -500, 500)))


def _exported(model) -> list:
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        nodes: list[tuple[int, float, int, int, float]] = []

        def walk(node, nodes=nodes) -> int:
            k = len(nodes)
            nodes.append((-1, 0.0, 0, 0, node.prediction()))
            if node.subtreeDepth() > 0:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[k] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            return k

        walk(tree._call_java("rootNode"))
        out.append((float(weight), nodes))
    return out


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of all texts; those of a fifth of the texts are held out."""
    for batch in batches:
        found = [(*x, zlib.crc32(t.encode()) % 5 == 0) for t in batch.column("text").to_pylist() for x in examples(t)]
        kind, x, label, held = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.string()), pa.array(x, pa.list_(pa.float64())), pa.array(label, pa.float64()), pa.array(held, pa.bool_())],
            names=["kind", "x", "label", "held"],
        )


def train(docs: DataFrame, rounds: int = 20, depth: int = 4) -> Model:
    """Fit on the candidates of all documents.

    Base spans are the labels: they and rewritten copies of them are positive, other candidates and
    spoilt copies negative. The candidates of a fifth of the texts are held out to calibrate the margin and to
    choose each kind's threshold, the lowest that keeps the wanted precision; all of them count, in
    steps of the margin. Of rows that share an id the smallest text is read. Without both classes no
    span is added.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    rows = settle(texts.mapInArrow(_example_rows, "kind string, x array<double>, label double, held boolean"))
    held = F.col("held")
    seen = {r["label"] for r in rows.where(~held).select("label").distinct().collect()}
    if seen != {0.0, 1.0}:
        return Model([], (1.0, 0.0), dict.fromkeys(KINDS, 2.0))
    ready = settle(rows.where(~held).select(array_to_vector("x").alias("features"), "label"))
    trees = _exported(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=3).fit(ready))
    model = Model(trees, (2.0, 0.0), {})
    test = rows.where(held).select("kind", "x", "label")
    steps = test.mapInArrow(_steps(docs.sparkSession.sparkContext.broadcast(model)), "kind string, step int, label double, n long")
    return calibrated(model, steps.groupBy("kind", "step", "label").agg(F.sum("n").alias("n")).orderBy("kind", "step", "label").collect())


def _steps(shared):
    """How many examples of a task have a kind, a step of the margin and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, float]] = Counter()
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, N_FEATURES)
            step = np.floor(shared.value.margin(x).clip(-WIDEST, WIDEST) * STEPS).astype(int)
            seen.update(zip(batch.column("kind").to_pylist(), step.tolist(), batch.column("label").to_pylist(), strict=True))
        kind, step, label = zip(*seen, strict=True) if seen else ((), (), ())
        columns = [pa.array(kind, pa.string()), pa.array(step, pa.int32()), pa.array(label, pa.float64()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "step", "label", "n"])

    return count


def calibrated(model: Model, steps: list) -> Model:
    """The model with its calibration and thresholds, from (kind, step, label, n) of held-out candidates."""
    kinds = [r["kind"] for r in steps]
    margin = (np.array([r["step"] for r in steps], float) + 0.5) / STEPS
    label, n = np.array([r["label"] for r in steps], float), np.array([r["n"] for r in steps], float)
    slope, offset, good = 2.0, 0.0, float((label * n).sum())
    for _ in range(200 if 0 < good < n.sum() else 0):  # logistic fit, held near the trees' own scale
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        error = (p - label) * n / n.sum()
        slope, offset = slope - 0.5 * float((error * margin).sum()) - 0.001 * (slope - 2), offset - 0.5 * float(error.sum())
    model.calibration = (slope, offset)
    for kind in KINDS:
        mine = np.array([k == kind for k in kinds], bool)
        at, place = np.unique(margin[mine], return_inverse=True)
        every, true = (np.bincount(place, x, len(at))[::-1].cumsum() for x in (n[mine], (label * n)[mine]))
        enough = np.flatnonzero(true >= PRECISION * every)
        limit = SAFE
        if len(enough) and true[-1] >= FEW:
            lowest, below = [*at[::-1], -WIDEST][enough[-1] : enough[-1] + 2]  # nothing was seen between them
            lowest = max((lowest + below) / 2, below + 0.5 / STEPS)
            limit = float(1 / (1 + np.exp(-np.clip(slope * lowest + offset, -500, 500))))
        model.limits[kind] = max(limit, 0.5)
    return model


def spans_of(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, probability): all base spans, and candidates above their threshold that
    overlap neither a base span nor a likelier one."""
    base = base_spans(text)
    out = [(k, a, b, True, 1.0) for k, a, b in base]
    found = candidates(text) if model.trees else []
    cover = Cover([(a, b) for _, a, b in base])
    found = [c for c in found if not cover.meets(c[1], c[2])]
    if found:
        p = model.probability(np.array([describe(text, *c) for c in found]))
        taken = Cover()
        for k in np.argsort(-p, kind="stable"):
            kind, a, b = found[k]
            if p[k] >= model.limits[kind] and not taken.meets(a, b):
                taken.add(a, b)
                out.append((kind, a, b, False, float(p[k])))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str, spans: list[tuple[str, int, int, bool, float]]) -> str:
    out, at = [], 0
    for kind, a, b, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
FIELDS = "spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _finder(shared, redact: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [spans_of(t, shared.value) for t in texts]
            rows = [[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in found] for found in spans]
            out, names = [batch.column("row"), pa.array(rows, SPAN)], ["row", "spans"]
            if redact:
                out, names = [*out, pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return find


def find(docs: DataFrame, model: Model, redact: bool = False) -> DataFrame:
    """(row, spans[, redacted]) for every row of ``docs``.

    ``spans`` are ordered by kind and start, with code-point offsets, end exclusive; ``redacted`` is
    the text with each span replaced by its kind. A null text is an empty one without spans;
    repeated rows get equal spans; an empty table gives no rows. Scanning reads no stretch of a text
    twice, and overlaps are looked up in sorted intervals.
    """
    frame = packed(docs, F.coalesce("text", F.lit("")).alias("text"))
    fields = FIELDS + (", redacted string" if redact else "")
    return frame.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(model), redact), with_row(frame, fields))
