"""Personal data in texts (op 7): patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text
from lumenframe.llm.wordhash import release

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits, as the run's own start would match before it.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
DIGITS = re.compile("[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
CONTEXT = {
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social", "security", "identity"),
}
WINDOW = 40  # code points of context on either side
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.4, "short_card": 0.3, "local_phone": 0.4}
BOOST, ACCEPT = 0.4, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @ the longest local part that earlier matches leave, and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        elif start < at:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def near(text: str, kind: str, start: int, end: int) -> bool:
    around = text[max(0, start - WINDOW) : end + WINDOW].lower()
    return any(w in around for w in CONTEXT.get(kind, ()))


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in order of kind and start; base spans always stay, others need ACCEPT and no overlap with them."""
    out = []

    def add(kind: str, start: int, end: int, prior: str, base: bool) -> None:
        score = min(1.0, PRIOR[prior] + BOOST * near(text, kind, start, end))
        if base or score >= ACCEPT and all(end <= s or start >= e for _, s, e, _, _ in out):
            out.append((kind, start, end, score, base))

    for start, end in emails(text):
        add("email", start, end, "email", True)
    if DIGITS.search(text):
        short = []
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    add("ip", *m.span(), "ip", True)
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    if len(digits) >= 16:
                        add("card", *m.span(), "card", True)
                    else:
                        short.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", *m.span(), "phone", True)
        for m in IBAN.finditer(text):
            if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
                add("iban", *m.span(), "iban", False)
        for m in NATIONAL.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                add("national_id", *m.span(), "national_id", False)
        for m in LOCAL_PHONE.finditer(text):
            add("phone", *m.span(), "local_phone", False)
        for span in short:
            add("card", *span, "short_card", False)
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found)


def redacted(text: str, found: list) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together, named by the first."""
    parts, at = [], 0
    for kind, a, b, *_ in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:] if parts else text


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def with_spans(docs: DataFrame, redact: bool = False) -> DataFrame:
    """``docs`` with ``pii``: the spans found in ``text`` (code points, end exclusive); null text has none.

    With ``redact`` the text is replaced by its redacted form instead (null stays null). All other
    columns, whatever their names, pass through; an existing column ``pii`` is replaced.
    """
    keep = docs if redact else docs.drop("pii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            if redact:
                new = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), new)
            else:
                names = ("kind", "start", "end", "score", "base")
                extra = pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], SPAN_TYPE)
                yield batch.append_column("pii", extra)
        release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(run, schema if redact else f"{schema}, pii {SPAN_DDL}")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of documents: counts of base spans, hash of the base spans and all spans."""
    found = with_spans(id_and_text(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
