"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near its hits only, then embedded checksums.

One pass of the automaton finds every keyword of every kind. A pattern is tried only where its keyword begins, so a
text without keywords costs that pass alone; runs of hexadecimal digits have no keyword and are found through probes
at a distance no run can slip between. Kinds whose tokens carry a checksum are kept only where it holds.
"""

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small

#: The kinds that need no checksum, in their order. Fixed values.
BASE = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Keywords by kind; those of assign in either case. Fixed values of public token formats.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("AKIA",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "card": ("card", "visa"),
    "iban": ("iban",),
}
CHECKED = r"(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CARD = r"[A-Za-z]+\D{0,16}?(?<!\d)(\d(?:[ -]?\d){12,18})(?!\d)"
#: Letters of a country and check digits, at most NEAR characters after the keyword; the lengths of all countries that have account numbers. Fixed values.
IBAN, NEAR = r"(?<![0-9A-Za-z])[A-Za-z]{2}[0-9]{2}", 16
IBAN_LENGTHS = {c: n for n, of in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in of.split()}


def base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before them."""
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:30].encode()), 6) == body[30:]


def luhn_holds(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97_holds(number: str) -> bool:
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, keywords in KEYWORDS.items():
            for word in keywords:
                forms = {word} if kind not in ("assign", "card") else {word.lower()}
                for form in forms:
                    self.automaton.add_word(form if kind in ("assign", "card") else form.lower(), (kind, len(form)))
        self.automaton.make_automaton()
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        self.checked, self.card = re.compile(CHECKED), re.compile(CARD)
        self.iban = re.compile(IBAN)
        self.rest = {n: re.compile(rf"(?:[ -]?[0-9A-Za-z]){{{n - 4}}}(?![0-9A-Za-z])") for n in IBAN_LENGTHS.values()}
        # lower-cases A-Z alone, so that places stay
        self.fold = {c: c + 32 for c in range(65, 91)}

    def spans(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(kind, start, end, start and end of what is secret in it) in order of start, then kind; places count code points."""
        folded = text.lower()
        if len(folded) != len(text) or not text.isascii() and any(c in folded for c in "ſK"):
            folded = text.translate(self.fold)
        found, over = [], dict.fromkeys(KEYWORDS, 0)
        hits = sorted((at - n + 1, kind) for at, (kind, n) in self.automaton.iter(folded))
        for start, kind in hits:
            if start < over[kind]:
                continue
            if kind == "assign":
                if m := self.assign.match(text, start):
                    over[kind] = m.end()
                    if len(m[2]) >= LEAST_VALUE:
                        found.append((kind, start, m.end(), m.start(2), m.end(2)))
            elif kind == "access":
                if m := self.access.match(text, start):
                    over[kind] = m.end()
                    if m.end() - start >= LEAST_ACCESS:
                        found.append((kind, start, m.end(), start, m.end()))
            elif kind == "card":
                if (m := self.card.match(text, start)) and luhn_holds(re.sub(r"\D", "", m[1])):
                    over[kind] = m.end()
                    found.append((kind, m.start(1), m.end(1), m.start(1), m.end(1)))
            elif kind == "iban":
                for head in self.iban.finditer(text, start + 4, start + 4 + NEAR + 4):
                    n = IBAN_LENGTHS.get(head[0][:2].upper())
                    if n and (m := self.rest[n].match(text, head.end())) and mod97_holds(re.sub("[ -]", "", text[head.start() : m.end()])):
                        over[kind] = m.end()
                        found.append((kind, head.start(), m.end(), head.start(), m.end()))
                        break
            elif (m := self.checked.match(text, start)) and checksum_holds(m[0]):
                over[kind] = m.end()
                found.append((kind, start, m.end(), start, m.end()))
        found += self._hex(text)
        rank = {k: i for i, k in enumerate((*BASE, *KEYWORDS))}
        return sorted(found, key=lambda x: (x[1], rank[x[0]]))

    def _hex(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """Runs of at least LEAST_HEX digits; each covers two neighbouring probes of half that distance."""
        step, found, over = LEAST_HEX // 2, [], 0
        probes = text[step - 1 :: step]
        for m in self.hex.finditer(probes):
            if m.end() - m.start() < 2:
                continue
            at = (m.start() + 1) * step - 1
            while at < (m.end()) * step:
                if at >= over:
                    start = at
                    while start > over and text[start - 1] in "0123456789abcdef":
                        start -= 1
                    end = self.hex.match(text, at).end()
                    over = end
                    if end - start >= LEAST_HEX:
                        found.append(("hex", start, end, start, end))
                at += step
        return found


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


SPAN = "array<struct<kind:string,start:int,end:int,secret_start:int,secret_end:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id_col, spans) of each row, and with redact also `text`, where each secret part is replaced by [secret].

    spans holds kind, start, end (code points, end exclusive) and the place of the secret part, by start, then kind.
    A null text has no spans and stays null. Rows are handled one by one, so repeated or null ids do no harm; other
    columns of docs are not looked at.
    """

    def kernel(batches):
        scan = scanner()
        names = ["kind", "start", "end", "secret_start", "secret_end"]
        kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int32()) for n in names[1:])]))
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            found = [scan.spans(t) if t else [] for t in texts]
            out = [batch.column(0), pa.array([[dict(zip(names, s)) for s in x] for x in found], kind)]
            if redact:
                out.append(pa.array([redacted(t, x) for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "spans", "text"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(kernel, f"id {kind}, spans {SPAN}" + ", text string" * redact)
    return out.withColumnRenamed("id", id_col)


def redacted(text: str | None, spans: list[tuple[str, int, int, int, int]]) -> str | None:
    """text with each secret part, and what overlaps it, replaced once."""
    out, at = [], 0
    for start, end in sorted((s[3], s[4]) for s in spans):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with the secrets in text_col replaced by [secret]. A null text stays null."""
    place = docs.columns.index(text_col)

    def kernel(batches):
        scan = scanner()
        for batch in small(batches):
            texts = [redacted(t, scan.spans(t)) if t else t for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return docs.mapInArrow(kernel, docs.schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of documents."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return scan_secrets(docs).select("doc_id", *count, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
