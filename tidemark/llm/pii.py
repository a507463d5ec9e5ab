"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``find_spans`` works on one text; ``with_spans`` and ``redacted`` apply it to a column.

Defined results: a null or empty text has no spans; texts of any length are read
whole, in time linear in their length; spans of different kinds may overlap; repeated
rows each get their spans; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: In the order in which spans with equal starts are listed. The first four are always kept.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5

# Scores: what a confirmed pattern has by itself, what a context word adds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
CONTEXT_GAIN = 0.25
CONTEXT_CHARS = 48
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reply|kontakt|correo|courriel)"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|adresse|servidor|serveur)"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|llam|portable)"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|tax)"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    """Matches of local-part@domain, found from each @ outwards so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        ends = [m.end()] + [m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " "]
        for end in ends:
            if 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), end
                break


def _confirmed(text: str):
    """(kind, start, end) of every proposal that its validator confirms."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(ch in "0123456789" for ch in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9":
            yield "ssn", m.start(), m.end()


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text, by start and then kind; ends are exclusive, in code points."""
    found = []
    for kind, start, end in _confirmed(text or ""):
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        score = PRIOR[kind] + CONTEXT_GAIN * bool(CONTEXT[kind].search(near))
        if kind in BASE or score >= THRESHOLD:
            found.append({"kind": kind, "start": start, "end": end, "score": round(score, 2)})
    return sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def redact_text(text: str | None) -> str | None:
    """Overlapping spans become one mark, named after the first of them."""
    if not text:
        return text
    out, last = [], 0
    spans = find_spans(text)
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        i += 1
        while i < len(spans) and spans[i]["start"] < end:
            end = max(end, spans[i]["end"])
            i += 1
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*out, text[last:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([find_spans(t) for t in texts.to_pylist()], _ARROW_SPANS)


def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact_text(t) for t in texts.to_pylist()], pa.string())


def with_spans(df: DataFrame, text: str = "text", name: str = "pii_spans") -> DataFrame:
    """Add the spans of ``text`` as an array of structs."""
    text_batches(df.sparkSession)
    # Nondeterministic by name only: it is then not evaluated once for every later use of its column.
    return df.withColumn(name, F.arrow_udf(_spans, SPANS).asNondeterministic()(df[text]))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span in ``text`` by its kind in square brackets."""
    text_batches(df.sparkSession)
    return df.withColumn(text, F.arrow_udf(_redacted, "string")(df[text]))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.filter("pii_spans", lambda s: s["kind"] == kind)
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", label), ",").alias("spans"),
    )
