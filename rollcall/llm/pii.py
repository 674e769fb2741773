"""Personal data by weak supervision.

One pass over the whole texts finds candidates: the spans of the base patterns, which are always
reported, and looser forms (written-out mail and network addresses, national phone numbers and those with
00 before the country, numbers that look like cards but fail the check digit, and secrets: long values that are given to a name such as
token or password, or that begin like the keys of well-known services). Every scan takes time in proportion to the text's length: base
patterns are searched from what can only occur once in them (the @, the +, a run of digits). LABELERS vote on each candidate, yes, no or abstain:
two on its form, one on gazetteers, one on context words, one on what it touches. The votes are
counted by pattern (5 kinds x 3**5 patterns at most); expectation-maximisation on those counts
estimates each labeler's reliability and each pattern's probability. A logistic classifier over
votes and the span's shape is trained on these probabilities, and adds the looser spans that it
accepts and that touch no other span. Secrets have columns of their own beside the spans of the four kinds.

Spans count code points, end exclusive. Nulls: a null text counts as empty. Rows that repeat a doc_id
are separate rows. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates: those of the spans, and secrets.
ALL, SECRET = (*KINDS, "secret"), len(KINDS)
LABELERS = ("form", "strict form", "gazetteer", "context", "edges")
ACCEPT, SHAPES = 0.8, 512

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever there is a digit, so nothing is searched twice
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile(r"[(\[{]\s?at\s?[)\]}]|(?<=\s)at(?=\s)", re.I)
SPELLED = re.compile(r"\s{0,3}[A-Za-z0-9-]+(?:\s{0,3}(?:[(\[{]\s?dot\s?[)\]}]|\sdot\s)\s{0,3}[A-Za-z0-9-]+)+", re.I)
LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s{0,3}(?:\[\.\]|\(\.\)|\.|\[dot\]|\sdot\s)\s{0,3}[0-9]{1,3}){3}(?![0-9.])", re.I),
    "card": re.compile(r"(?<![0-9-])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{3,4}(?![0-9-])"),
    # 00 and the country; the national forms of North America; those with a leading 0 and groups
    "phone": re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[-. /][0-9]{1,4}(?:[-. /][0-9]{2,4}){2,4}|(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}|0[1-9][0-9]{0,4}[-. /](?:[0-9]{2,4}[-. ]){1,3}[0-9]{2,4}|\(0[0-9]{1,4}\)[-. /]?[0-9]{3,8})(?![0-9])"),
}
# a name, a sign and a value of 16 signs or more; keys by their beginnings
GIVEN = re.compile(r"(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|passphrase|credential|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth)[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?(?:bearer\s)?([A-Za-z0-9+/_.~-]{16,}={0,2})", re.I)
KEYED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
# Words that speak for a kind or against it, and gazetteers.
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "address"},
    "ip": {"ip", "host", "server", "address", "login", "from", "ping"},
    "card": {"card", "visa", "mastercard", "amex", "payment", "credit", "debit", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "fon", "telefon", "mobil", "llama"},
    "secret": {"token", "secret", "password", "passwd", "key", "auth", "bearer", "credential", "login", "api"},
}
AGAINST = {"version", "release", "isbn", "order", "invoice", "token", "sha", "commit", "section", "license", "licensed", "figure", "page", "id"}
SUMS = {"sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "example", "placeholder"}
DOMAINS = {
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "me", "tv", "app", "dev", "xyz", "online", "site", "shop", "blog", "cloud", "tech",
    "ac", "ae", "ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "ee", "eg", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "ir", "is", "it",
    "jp", "ke", "kr", "lt", "lu", "lv", "ma", "mx", "my", "ng", "nl", "no", "nz", "pe", "ph", "pk", "pl", "pt", "ro", "rs", "ru", "sa", "se", "sg", "si", "sk", "th", "tr", "tw", "ua", "uk", "us",
    "uy", "ve", "vn", "za"}
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "644", "645", "646", "647", "648", "649", "65", *(str(n) for n in range(222, 273)))
# one and two digits are whole codes; the rest of the plan has three, with these beginnings
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63",
             "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "85", "88", "96", "97", "99")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def passes(kind: str, s: str) -> bool:
    """The conditions that a match of a base pattern must meet."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _back(text: str, end: int, least: int) -> int:
    """Where the run of characters of a mail address's first part begins that ends at `end`."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def _matches(kind: str, text: str):
    """(start, end) of the leftmost non-overlapping matches of a base pattern."""
    if kind == "email":
        last, at = 0, text.find("@")
        while at >= 0:
            start = _back(text, at, last)
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                last = m.end()
                yield start, last
            at = text.find("@", max(last, at + 1))
    elif kind == "ip":
        for m in DOTTED.finditer(text):  # every four numbers of a dotted run are a match
            ends = [x.end() for x in re.finditer("[0-9]+", m[0])]
            start = 0
            for i in range(3, len(ends), 4):
                yield m.start() + start, m.start() + ends[i]
                start = ends[i] + 1
    else:
        yield from (m.span() for m in (SPACED if kind == "card" else PLUS).finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), unsorted."""
    out = []
    numbers = re.search("[0-9]", text)
    for k, kind in enumerate(KINDS):
        if "@" in text if kind == "email" else numbers and (kind != "phone" or "+" in text):
            out += [(k, s, e) for s, e in _matches(kind, text) if passes(kind, text[s:e])]
    return out


def loose_spans(kind: str, text: str):
    """(start, end) of the looser forms."""
    if kind == "secret":
        yield from sorted({*(m.span(1) for m in GIVEN.finditer(text)), *(m.span() for m in KEYED.finditer(text))})
        return
    if kind != "email":
        yield from (m.span() for m in LOOSE[kind].finditer(text) if kind != "ip" or all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])))
        return
    last = 0
    for a in AT.finditer(text):
        if a.start() < last:
            continue
        end = a.start()
        while end > last and a.start() - end < 3 and text[end - 1].isspace():
            end -= 1
        start = _back(text, end, last)
        m = SPELLED.match(text, a.end()) if start < end else None
        if m:
            last = m.end()
            yield start, last


class Taken:
    """Spans that may overlap one another, to ask whether a span touches one of them."""

    def __init__(self, spans):
        self.starts, self.ends = [], []  # ends[i]: the furthest end of the spans up to i
        for s, e in sorted(spans):
            self.starts.append(s)
            self.ends.append(max(e, self.ends[-1] if self.ends else 0))

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """1, -1 or 0 of each of the LABELERS."""
    s = text[start:end]
    d = _digits(s)
    before = re.findall(r"[\w-]+", text[max(0, start - 48) : start].lower())[-5:]
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "secret":
        mixed = bool(d) and len(d) < len(s)
        form = 1 if mixed and len(set(s.lower())) >= 8 else -1
        strict = 1 if re.fullmatch("[0-9A-Fa-f]{32,}", s) or KEYED.fullmatch(s) else 0 if mixed and len(s) >= 24 else -1
        known = 1 if KEYED.fullmatch(s) or GIVEN.search(text, max(0, start - 32), end) else -1
    elif kind == "email":
        form = 1 if "@" in s else 0
        last = re.findall("[a-z0-9-]+", s.lower())[-1:]
        strict = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}", s) else 1 if re.search(r"[(\[{]\s?at\s?[)\]}]", s, re.I) else 0 if "@" not in s else -1
        known = 1 if last and last[0] in DOMAINS else -1
    elif kind == "ip":
        form = 1 if all(p and int(p[-4:]) <= 255 for p in re.findall("[0-9]+", s)) else -1
        strict = -1 if re.search(r"(^|\.)0[0-9]", s) else 1
        known = -1 if d.startswith("0") else 1 if re.match(r"10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|127\.", s) else 0
    elif kind == "card":
        form = 1 if 13 <= len(d) <= 19 else -1
        strict = 1 if luhn(d) else -1
        known = 1 if d.startswith(ISSUERS) else -1
    else:
        form = 1 if 9 <= len(d) <= 15 else -1
        strict = 1 if s.startswith("+") or re.search("[()]", s) else 0
        abroad = d[2:] if d.startswith("00") and not s.startswith("+") else d if s.startswith("+") else None
        known = (1 if abroad.startswith(COUNTRIES) else 0) if abroad else 0 if d[0] == "0" else -1 if d[0] == "1" else 1
    context = 1 if FOR[kind] & set(before) else -1 if (SUMS if kind == "secret" else AGAINST) & set(before) else 0
    edges = -1 if (left and (left.isalnum() or left in "._-/=")) or (right and (right.isalnum() or right in "-_/=")) else 1
    return [form, strict, known, context, edges]


def shape(s: str) -> int:
    """Digits 9, letters a, runs shortened to three, hashed."""
    s = re.sub("[0-9]", "9", re.sub("[^\\W0-9_]", "a", s))
    return crc32(re.sub(r"(.)\1{2,}", r"\1\1\1", s).encode()) % SHAPES


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int, bool]]]:
    """Base spans, and (kind, start, end, pattern of votes, shape, is base) of all candidates."""
    base = sorted(base_spans(text), key=lambda s: (s[1], s[0]))
    found = [(*s, True) for s in base]
    taken = Taken((s, e) for _, s, e in base)
    digits, low = re.search("[0-9]", text), text.lower()
    for k, kind in enumerate(ALL):
        if digits if kind != "email" else "at" in low and "dot" in low:
            found += [(k, s, e, False) for s, e in loose_spans(kind, text) if not taken.touches(s, e)]
    out = []
    for k, s, e, own in found:
        code = 0
        for v in votes(ALL[k], text, s, e):
            code = code * 3 + v + 1
        out.append((k, s, e, code, shape(text[s:e]), own))
    return base, out


def _unpack(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(len(LABELERS) - 1, -1, -1)], axis=-1)


def reliabilities(kind: np.ndarray, code: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Probability of each vote pattern, by expectation-maximisation; given the class, labelers vote independently."""
    v = _unpack(code)
    p = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))
    for _ in range(rounds):
        new = p.copy()
        for k in np.unique(kind):
            i = kind == k
            a, b = n[i] * p[i], n[i] * (1 - p[i])
            odds = np.full(i.sum(), np.log((a.sum() + 2) / (b.sum() + 2)))
            for j in range(v.shape[1]):
                yes = np.bincount(v[i, j], a, 3) + np.array([0.5, 1, 2.0])  # labelers are better than chance, a priori
                no = np.bincount(v[i, j], b, 3) + np.array([2.0, 1, 0.5])
                odds += np.log(yes / yes.sum() / (no / no.sum()))[v[i, j]]
            new[i] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return p


class Classifier:
    """Logistic regression over kind, votes by kind and hashed shape."""

    def __init__(self):
        self.w = np.zeros(len(ALL) * (1 + 3 * len(LABELERS)) + SHAPES)

    def columns(self, kind, code, shapes) -> np.ndarray:
        width = 1 + 3 * len(LABELERS)
        at = kind * width
        v = at[:, None] + 1 + 3 * np.arange(len(LABELERS)) + _unpack(code)
        return np.column_stack([at, v, len(ALL) * width + shapes])

    def fit(self, kind, code, shapes, n, p, rounds: int = 400, rate: float = 0.5) -> Classifier:
        x = self.columns(kind, code, shapes)
        weight = np.sqrt(n)  # patterns count less than in proportion
        for _ in range(rounds if len(n) else 0):
            d = (1 / (1 + np.exp(-self.w[x].sum(axis=1))) - p) * weight / weight.sum()
            self.w -= rate * (np.bincount(x.ravel(), np.repeat(d, x.shape[1]), len(self.w)) + 1e-4 * self.w)
        return self

    def probability(self, kind, code, shapes) -> np.ndarray:
        return 1 / (1 + np.exp(-self.w[self.columns(kind, code, shapes)].sum(axis=1)))


def _joined(spans) -> str:
    return ",".join(f"{ALL[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, secrets string, n_found long"
CANDIDATES = "doc_id long, base array<array<long>>, found array<array<long>>"


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all), n_secret, secrets, and n_found (spans and secrets) for every row."""

    def scan(batches):
        import pyarrow as pa

        for b in slices(batches):
            got = [candidates(t) if t else ([], []) for t in b.column("text").to_pylist()]
            kind = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], kind), pa.array([[list(map(int, c)) for c in y] for _, y in got], kind)], ["doc_id", "base", "found"])

    rows = keep(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, CANDIDATES), "candidates")
    c = F.col("c")
    counted = rows.select(F.explode("found").alias("c")).groupBy(c[0].alias("kind"), c[3].alias("code"), c[4].alias("shape")).agg(F.count("*").alias("n"))
    seen = counted.orderBy("kind", "code", "shape").toPandas()  # kinds x patterns x shapes at most
    kind, code, shapes, n = (seen[x].to_numpy(np.int64) for x in ("kind", "code", "shape", "n"))
    pattern, place = np.unique(kind * 3 ** len(LABELERS) + code, return_inverse=True)
    p = reliabilities(pattern // 3 ** len(LABELERS), pattern % 3 ** len(LABELERS), np.bincount(place, n, len(pattern)))
    model = Classifier().fit(kind, code, shapes, n, p[place] if len(place) else p)

    def decide(batches):
        import pyarrow as pa

        for b in slices(batches, 4096):
            out = []
            for base, found in zip(b.column("base").to_pylist(), b.column("found").to_pylist()):
                spans = [tuple(x) for x in base]
                count = [sum(s[0] == k for s in spans) for k in range(len(KINDS))]
                sha = hashlib.sha256(_joined(spans).encode()).hexdigest()
                loose = np.array([x for x in found if not x[5]], np.int64).reshape(-1, 6)
                secrets = []
                if len(loose):
                    sure = loose[model.probability(loose[:, 0], loose[:, 3], loose[:, 4]) >= accept]
                    ordered, last = sorted(map(tuple, sure[:, :3].tolist()), key=lambda x: (x[1], x[0])), 0
                    for k, s, e in ordered:  # none touches a base span; of those that touch one another the first stays
                        if k != SECRET and s >= last:
                            spans.append((k, s, e))
                            last = e
                    taken, last = Taken(x[1:] for x in spans), 0
                    for k, s, e in ordered:
                        if k == SECRET and s >= last and not taken.touches(s, e):
                            secrets.append((k, s, e))
                            last = e
                out.append((*count, sha, _joined(spans), len(secrets), _joined(secrets), len(spans) + len(secrets)))
            cols = list(zip(*out)) or [()] * len(FOUND.split(","))
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, kinds)], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    return rows.mapInArrow(decide, f"doc_id long, {FOUND}")
