"""Personal data: patterns, and spans that a character-level BiLSTM-CRF adds to them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, table
from lodestone.llm.sequence_tagger import CARD_DIGITS, KINDS, UNUSED, decode, luhn, symbols, trained

#: Code points of a window and from one to the next; no span that the model adds is longer than a step.
WINDOW, STEP = 96, 48
#: Windows decoded at a time, and the mean probability that an added span needs.
BATCH, LIKELY = 256, 0.6

#: The base patterns. A mail address is read off its @ to both sides, which takes time in proportion to the text.
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PLACE = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: One of the marks of every mail address that the model knows; every other kind has digits.
MAIL = re.compile(r"@|[\[({](?:at|AT)[\])}]|(?= (?:dot|DOT) )")
TRIGGER = re.compile(rf"[0-9]|{MAIL.pattern}")
#: A mail address is one word, a mark, a label, a mark and a label; either both marks are in words without brackets or none.
AT, DOT = r"[\[({](?:at|AT)[\])}]", r"[\[({](?:dot|DOT)[\])}]"
WRITTEN = re.compile(rf"\S+(?:\s?(?:@|{AT}).+?(?:\.|{DOT}| (?:dot|DOT) )\s?| (?:at|AT) .+? (?:dot|DOT) )[A-Za-z0-9]", re.DOTALL)

Span = tuple[int, int, str]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans (start, end, kind) that patterns find, by kind and start; failing matches are dropped, not retried."""
    found: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in NAME_CHARS:
            start -= 1
        if start < at and (m := PLACE.match(text, at + 1)):
            found.append((start, end := m.end(), "email"))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if len(digits) in CARD_DIGITS and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return found


def _plausible(text: str, kind: str) -> bool:
    """What makes a kind, in any form: marks of an address, four parts up to 255, a checksum, a count of digits."""
    if kind == "email":
        return bool(WRITTEN.match(text))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)
    digits = _digits(text)
    return 10 <= len(digits) <= 15 if kind == "phone" else len(digits) in CARD_DIGITS and luhn(digits)


def _windows(text: str) -> list[int]:
    """Starts of the windows, on a grid of STEP, that can hold a span: they have a mark of a mail address, or as many
    digits as a telephone number, or four and the dots of an address. No other span would be of its kind."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.arange(0, len(text), STEP)

    def within(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of)])
        return sums[np.minimum(starts + WINDOW, len(text))] - sums[starts]

    digits, dots, marks = within((codes >= 48) & (codes <= 57)), within(codes == 46), np.zeros(len(text), bool)
    marks[[m.start() for m in MAIL.finditer(text)]] = True
    return starts[(digits >= 10) | (digits >= 4) & (dots >= 3) | (within(marks) > 0)].tolist()


def _reconciled(text: str, found: list[tuple[float, int, int, str]], base: list[Span]) -> list[Span]:
    """Of spans from overlapping windows the likeliest that overlap neither each other nor a base span."""
    taken = sorted(base)
    out: list[Span] = []
    for likely, a, b, kind in sorted(set(found), key=lambda x: (-x[0], x[1:])):
        if likely >= LIKELY and _plausible(text[a:b], kind) and all(b <= c or d <= a for c, d, _ in taken):
            taken.append((a, b, kind))
            out.append((a, b, kind))
    return out


def tagged(texts: list[str], base: list[list[Span]], model: dict[str, np.ndarray]) -> list[list[Span]]:
    """The spans that the model adds to each text's base spans.

    Overlapping windows that can hold a span are decoded, BATCH different ones at a time. A span cut off by a window's
    edge inside a word is left to the next window; the rest are reconciled over the whole text.
    """
    found: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    where = [(k, at) for k, text in enumerate(texts) for at in _windows(text)]
    read = {k: symbols(texts[k]) for k in {k for k, _ in where}}
    for first in range(0, len(where), BATCH * 16):
        some = where[first : first + BATCH * 16]
        x = np.full((len(some), WINDOW), UNUSED, np.int8)
        for row, (k, at) in enumerate(some):
            own = read[k][at : at + WINDOW]
            x[row, : len(own)] = own
        different, which = np.unique(x, axis=0, return_inverse=True)
        decoded = [decode(model, different[a : a + BATCH]) for a in range(0, len(different), BATCH)]
        tags, likely = (np.concatenate(part)[which.ravel()] for part in zip(*decoded, strict=True))
        for (k, at), row, chances in zip(some, tags, likely, strict=True):
            text, starts = texts[k], np.flatnonzero(row & 1)
            for a in starts.tolist():
                b = a + 1
                while b < WINDOW and row[b] == row[a] + 1:
                    b += 1
                if (a == 0 and at and not text[at - 1].isspace()) or (b == WINDOW and at + b < len(text) and not text[at + b].isspace()):
                    continue
                if at + b <= len(text):
                    found[k].append((round(float(chances[a:b].mean()), 4), at + a, at + b, KINDS[(row[a] - 1) // 2]))
    return [_reconciled(t, f, b) for t, f, b in zip(texts, found, base, strict=True)]


def listed(spans: list[Span]) -> str:
    """kind:start:end of each span by start, then kind, comma-joined."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans of each row of docs (doc_id, text), from the whole text.

    Counts are those of base spans, the patterns' matches; base_spans lists these and spans all, as listed() does.
    The model, by default the stored one that train() made of invented labelled spans, is sent to all tasks (some 40
    KB). It adds spans in forms that the patterns miss: written-out mail addresses, national telephone numbers, cards
    with other separators. It reads the windows that can hold a span, and sees which digits pass a card's
    checksum; what it finds is checked against the definition of its kind alone.

    Rows are handled where they are read. Null texts are empty; repeated rows give equal rows; no rows give no rows;
    other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], {}
            some: list[tuple[int, str]] = []
            for k, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                base.append(base_spans(text) if TRIGGER.search(text) else [])
                if TRIGGER.search(text):
                    some.append((k, text))
                if sum(len(t) for _, t in some) > 1_000_000:
                    added |= _added(some, base)
                    some = []
            added |= _added(some, base)
            counts = [[sum(s[2] == kind for s in b) for b in base] for kind in KINDS]
            texts = [[listed(b) for b in base], [listed(b + added.get(k, [])) for k, b in enumerate(base)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(t, pa.string()) for t in texts)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    def _added(some: list[tuple[int, str]], base: list[list[Span]]) -> dict[int, list[Span]]:
        return dict(zip([k for k, _ in some], tagged([t for _, t in some], [base[k] for k, _ in some], sent.value), strict=True))

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {counts}, base_spans string, spans string")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
