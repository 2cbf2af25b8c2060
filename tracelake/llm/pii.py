"""Personal data, with offset-preserving deobfuscation.

Base kinds are found in the text as it is. Then transducers rewrite disguises into plain characters,
and each output character keeps the source span that it came from:

- homoglyphs: full-width and mathematical forms, digits of other scripts, the Cyrillic and Greek letters
  that look like Latin ones, and invisible characters between others;
- spelled digits (also `double five`): runs of seven or more, and those that touch a plus, further digits
  or a dot in disguise; so prose keeps its other numbers;
- at and dot in disguise: `(at)`, `[dot]`, `[.]`, ` at `, ` dot `, ` @ `, in addresses of any number of
  parts and between the four numbers of an ip; at least one of them must be bracketed, spaced or `dot`.

Identifiers found in the rewritten text are mapped back to source spans. Spans that overlap a base
span of their kind aren't added: base spans stay as they are.

- Nulls: null text counts as empty and has no spans; doc_id is only passed on.
- Very long texts are read whole, in passes that are linear in their length.
- Repeated rows are read each. Ties: spans go by start, then kind as listed, then end.
- Empty tables give no row. `detect` replaces a column named like its output and keeps all others.
- Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

#: Kinds in their order; fixed values.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Letters that look like Latin ones, and the digit words; fixed values.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESIJKMHOPCTXYaeopcyxijsdhABEZHIKMNOPTYXo", strict=True))
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
ITEM = rf"(?:(?:{'|'.join(TIMES)})\x20+)?(?:{'|'.join(DIGITS)})"
SPELLED = re.compile(rf"(?i)(?<![A-Za-z])(?:plus[\x20,-]+)?{ITEM}(?:[\x20,-]+{ITEM})*(?![A-Za-z])")
SPELLED_WORD = re.compile(rf"(?i)(?P<plus>plus)|(?:(?P<times>{'|'.join(TIMES)})\x20+)?(?P<digit>{'|'.join(DIGITS)})")
#: What a run of digit words touches, before and after it, so that it is rewritten even if it is short.
BEFORE = re.compile(r"(?i)(?:[0-9+][\x20,.()-]{0,4}|\x20dot\x20+|[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?)\Z")
AFTER = re.compile(r"(?i)[\x20,.()-]{0,4}[0-9]|\x20+dot\x20|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]")
AT = r"\x20*[\[({<]\x20*at\x20*[\])}>]\x20*|\x20+at\x20+|\x20*@\x20*"
DOT = r"\x20*[\[({<]\x20*(?:dot|\.)\x20*[\])}>]\x20*|\x20+dot\x20+|\."
TOKEN = re.compile(rf"(?i)(?P<at>{AT})|(?P<dot>{DOT})|(?P<part>[A-Za-z0-9_%+-]+)")
MARKS = re.compile(r"(?i)[\[({<]\x20*(?:at|dot|\.)\x20*[\])}>]|\x20dot\x20|\x20@|@\x20")
OTHER_DIGITS = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")
ODD = frozenset(LOOKALIKES) | INVISIBLE | frozenset(OTHER_DIGITS) | {chr(c) for r in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)) for c in r}
#: All characters that may be odd: of Latin-1 the soft hyphen alone is.
FOREIGN = re.compile("[^\x00-\xac\xae-\xff]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def plain(text: str) -> list[tuple[int, int, int]]:
    """Base identifiers: (start, kind, end)."""
    out = [(i, 0, j) for i, j in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 or not p.lstrip("0") or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


class Rewritten:
    """A text with, for each character, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies edits (start, end, new), ordered and not overlapping."""
        if not edits:
            return
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text, s, e, at = [], [], [], 0
        for i, j, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:i], new]
            s += starts[at:i]
            e += ends[at:i]
            if i < j:
                s += [starts[i]] * len(new)
                e += [ends[j - 1]] * len(new)
            at = j
        self.text, self.starts, self.ends = "".join(text), s, e

    def source(self, i: int, j: int) -> tuple[int, int]:
        return (i, j) if self.starts is None else (self.starts[i], self.ends[j - 1])


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    def plain_form(c: str) -> str:
        if c in INVISIBLE:
            return ""
        digit = unicodedata.decimal(c, None)
        return LOOKALIKES.get(c) or (unicodedata.normalize("NFKC", c) if digit is None else str(digit))

    return [(m.start(), m.end(), plain_form(m.group())) for m in FOREIGN.finditer(text) if m.group() in ODD]


def spelled_digits(text: str, least: int = 7) -> list[tuple[int, int, str]]:
    """Edits of each digit word, and of the blanks between two of them."""
    out = []
    for m in SPELLED.finditer(text):
        words = list(SPELLED_WORD.finditer(text, m.start(), m.end()))
        new = ["+" if w["plus"] else DIGITS[w["digit"].lower()] * TIMES.get((w["times"] or "").lower(), 1) for w in words]
        if sum(map(len, new)) < least and new[0] != "+" and not BEFORE.search(text, max(0, m.start() - 12), m.start()) and not AFTER.match(text, m.end()):
            continue
        for k, (w, x) in enumerate(zip(words, new, strict=True)):
            if k:
                out.append((words[k - 1].end(), w.start(), ""))
            out.append((w.start(), w.end(), x))
    return out


def dotted(tokens: list[tuple[str, int, int]], k: int, step: int) -> int:
    """How far parts with dots between them reach from token k, which is a part: the last token's place."""
    while True:
        dot, part = k + step, k + 2 * step
        if not 0 <= part < len(tokens) or tokens[dot][0] != "dot" or tokens[part][0] != "part" or not touch(tokens, min(k, part), max(k, part)):
            return k
        k = part


def touch(tokens: list[tuple[str, int, int]], i: int, j: int) -> bool:
    return all(tokens[k][2] == tokens[k + 1][1] for k in range(i, j))


def disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits of whole addresses and ips in disguise; one that is spelled plainly, or only has the word `at` and plain dots, stays."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    k = 0
    while k < len(tokens):
        kind, _, _ = tokens[k]
        last = k
        if kind == "at" and 0 < k < len(tokens) - 1 and tokens[k - 1][0] == tokens[k + 1][0] == "part" and touch(tokens, k - 1, k + 1):
            first, last = dotted(tokens, k - 1, -1), dotted(tokens, k + 1, 1)
            while last > k + 1 and not re.fullmatch("[A-Za-z]{2,24}", text[slice(*tokens[last][1:])]):
                last -= 2
            edit = (tokens[first][1], tokens[last][2], spelled_out(text, tokens[first : last + 1]))
            if last > k + 1 and MARKS.search(text, edit[0], edit[1]) and emails_whole(edit[2]) and (not out or edit[0] >= out[-1][1]):
                out.append(edit)
            else:
                last = k
        elif kind == "part" and text[tokens[k][1] : tokens[k][2]].isdigit():
            last = dotted(tokens, k, 1)
            edit = (tokens[k][1], tokens[last][2], spelled_out(text, tokens[k : last + 1]))
            if last == k + 6 and MARKS.search(text, edit[0], edit[1]) and IP.fullmatch(edit[2]):
                out.append(edit)
            else:
                last = k
        k = last + 1
    return out


def spelled_out(text: str, tokens: list[tuple[str, int, int]]) -> str:
    return "".join({"at": "@", "dot": "."}.get(kind) or text[i:j] for kind, i, j in tokens)


def emails_whole(text: str) -> bool:
    return next(emails(text), None) == (0, len(text))


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans: (start, kind, end)."""
    base = plain(text)
    r, changed = Rewritten(text), False
    for applies, step in ((lambda t: not t.isascii(), homoglyphs), (lambda t: True, spelled_digits), (lambda t: MARKS.search(t), disguised)):
        if applies(r.text) and (edits := step(r.text)):
            r.replace(edits)
            changed = True
    more = []
    if changed:
        taken = {k: [(i, j) for i, kind, j in base if kind == k] for k in range(len(KINDS))}
        for i, kind, j in plain(r.text):
            i, j = r.source(i, j)
            if not any(i < b and a < j for a, b in taken[kind]):
                taken[kind].append((i, j))
                more.append((i, kind, j))
    return base, more


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in sorted(spans))


def detect(docs: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """Adds an array of (kind, start, end, disguised) to all rows; a column of this name is replaced."""
    docs = docs.drop(spans)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column("text"):
                base, more = find(t.as_py() or "")
                every = sorted([(*s, False) for s in base] + [(*s, True) for s in more])
                got.append([{"kind": KINDS[k], "start": i, "end": j, "disguised": d} for i, k, j, d in every])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*b.schema.names, spans])

    return docs.mapInArrow(run, schema_with(docs, {spans: "array<struct<kind:string,start:int,end:int,disguised:boolean>>"}))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                base, more = find(t.as_py() or "")
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
