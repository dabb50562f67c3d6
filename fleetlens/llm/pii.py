"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors in a text: at-signs, plus signs, digits, schemes, identifier
cues and the public prefixes of keys. From each anchor a local parser expands to the boundaries of the value and validates it. Nothing else
of the text is looked at, so clean text costs one pass of the automaton.

Base kinds, leftmost and non-overlapping per kind: ``email``, ``ip`` (four parts up to 255), ``card`` (16 to
19 digits, Luhn), ``phone`` (8 to 15 digits after a plus). Added kinds: ``iban`` (country code, check digits
by ISO 7064; after a cue the length of the country or else the longest that ends with a word and holds, without
a cue the length of the country only), ``login`` (user and password in front of the host of a URL) and ``secret``: what stands
behind a cue such as ``token =`` or ``password:`` and looks drawn at random (alphabet, length, entropy), keys of known
prefixes, signed web tokens and private key blocks. Base spans are always kept.
Positions count code points, the end is exclusive.

Defined results: null and empty texts hold nothing; whole texts are read, whatever their length; every row
gives one row, equal rows included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "login", "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_COUNTRY = re.compile(r"[A-Z]{2}")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_LENGTHS = (
    "AL28 AD24 AT20 AZ28 BH22 BY28 BE16 BA20 BR29 BG22 BI27 CR22 HR21 CY28 CZ24 DK18 DJ27 DO28 EG29 SV28 EE20 FK18 FO18 FI18 FR27 GE22 DE22 GI23 "
    "GR27 GL18 GT28 HN28 VA22 HU28 IS26 IQ23 IE22 IL23 IT27 JO30 KZ20 XK20 KW30 LV21 LB28 LY25 LI21 LT20 LU20 MT31 MR27 MU30 MD24 MC27 MN20 ME22 "
    "NL18 NI28 MK19 NO15 OM23 PK24 PS29 PL28 PT25 QA29 RO24 RU33 LC32 SM27 ST25 SA24 RS22 SC31 SK24 SI19 SO23 ES24 SD18 SE24 CH21 TL23 TN24 TR26 "
    "UA29 AE23 GB22 VG24 YE30"
)
#: Characters of an account number by country.
ACCOUNTS = {entry[:2]: int(entry[2:]) for entry in _LENGTHS.split()}
_LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@[A-Za-z0-9])")

AT, PLUS, DIGIT, SCHEME, CUE, SECRET, PASSWORD, PREFIX = "at", "plus", "digit", "scheme", "cue", "secret", "password", "prefix"
_CUES = ("IBAN", "Iban", "iban")
_BEHIND_CUE = re.compile(r"[\s:#.-]{0,3}")

# Words in front of secrets, and the public prefixes of keys with what follows them.
_SECRET_CUES = ("token", "secret", "apikey", "key", "bearer", "credential", "credentials", "signature", "auth", "authorization")
_PASSWORD_CUES = ("password", "passwd", "passwort", "passphrase", "pwd")
_PREFIXES = {
    "AKIA": r"[0-9A-Z]{16}",
    "ASIA": r"[0-9A-Z]{16}",
    "AIza": r"[0-9A-Za-z_-]{35}",
    "ghp_": r"[0-9A-Za-z]{36}",
    "gho_": r"[0-9A-Za-z]{36}",
    "ghs_": r"[0-9A-Za-z]{36}",
    "github_pat_": r"[0-9A-Za-z_]{60,90}",
    "glpat-": r"[0-9A-Za-z_-]{20,40}",
    "xoxb-": r"[0-9A-Za-z-]{20,90}",
    "xoxp-": r"[0-9A-Za-z-]{20,90}",
    "sk_live_": r"[0-9A-Za-z]{20,100}",
    "rk_live_": r"[0-9A-Za-z]{20,100}",
    "eyJ": r"[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "-----BEGIN ": r"(?:[A-Z]+ ){0,3}PRIVATE KEY-----[0-9A-Za-z+/=\s:,-]{40,20000}?-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----",
}
_PREFIXED = {prefix: re.compile(re.escape(prefix) + rest + ("" if prefix.startswith("-") else r"(?![0-9A-Za-z_-])")) for prefix, rest in _PREFIXES.items()}
#: From a cue to its value: an equals sign or colon, blanks and quotes; a blank is enough behind "bearer".
_ASSIGNED = re.compile(r"""["']?\s{0,3}(?:=>|:=|=|:)\s{0,3}(?:[Bb]earer |[Bb]asic )?["'`]?""")
_GIVEN = re.compile(r"""\s["'`]?""")
_DRAWN = re.compile(r"[0-9A-Za-z+/_.~=-]+")
_TYPED = re.compile(r"""[^\s"'`<>]+""")
SECRET_LENGTH, PASSWORD_LENGTH = 16, 8
#: Bits a character; forty hexadecimal digits have about 3.7, words of a language below 3.
SECRET_BITS = 3.0


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": AT, "+": PLUS, "://": SCHEME} | dict.fromkeys("0123456789", DIGIT) | dict.fromkeys(_CUES, CUE)
    for cues, kind in ((_SECRET_CUES, SECRET), (_PASSWORD_CUES, PASSWORD)):
        anchors |= {form: kind for cue in cues for form in (cue, cue.upper(), cue.capitalize())}
    anchors |= dict.fromkeys(_PREFIXES, PREFIX)
    for text, kind in anchors.items():
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _account(text: str, start: int, cued: bool) -> int | None:
    """Where the account number from ``start`` on ends."""
    if not (m := _ACCOUNT.match(text, start)):
        return None
    by_length, n = {}, 0
    for end in range(start + 1, m.end() + 1):
        if text[end - 1] != " ":
            n += 1
            if end == len(text) or not (text[end].isascii() and text[end].isalnum()):
                by_length[n] = end
    of_country = ACCOUNTS.get(text[start : start + 2])
    for n in [of_country, *(sorted(by_length, reverse=True) if cued else ())]:
        if n in by_length and _mod97(text[start : by_length[n]]):
            return by_length[n]
    return None


def _bits(value: str) -> float:
    """Entropy of the characters."""
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def _secret(text: str, at: int, end: int, kind: str) -> tuple[int, int] | None:
    """Where the value of the cue ``text[at:end]`` stands, if there is one and it looks like a secret."""
    cue = text[at:end]
    camel = cue[0].isupper() and not cue.isupper() and at and text[at - 1].islower()  # accessKey
    if at and text[at - 1].isalnum() and not camel:
        return None
    m = _ASSIGNED.match(text, end) or (_GIVEN.match(text, end) if cue.lower() == "bearer" else None)
    value = m and (_TYPED if kind == PASSWORD else _DRAWN).match(text, m.end())
    if not value:
        return None
    found = value[0].rstrip(".,;:!?)]}" if kind == PASSWORD else ".")
    letters, digits = any(c.isalpha() for c in found), any(c.isdigit() for c in found)
    if kind == PASSWORD:
        good = len(found) >= PASSWORD_LENGTH and letters and (digits or not found.isalnum())
    else:
        good = len(found) >= SECRET_LENGTH and letters and digits and _bits(found) >= SECRET_BITS
    return (value.start(), value.start() + len(found)) if good else None


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by kind and start."""
    if not text:
        return []
    ends = dict.fromkeys((*BASE_KINDS, *ADDED_KINDS), 0)
    spans: dict[str, list[Span]] = {kind: [] for kind in ends}
    checked_ip = checked_card = -1

    def keep(kind: str, start: int, end: int, good: bool) -> None:
        ends[kind] = end
        if good:
            spans[kind].append((kind, start, end))

    for last, (kind, length) in anchors.iter(text):
        at = last + 1 - length
        if kind == DIGIT:
            if at > checked_ip:  # the first digit of a run
                checked_ip = _RUN.match(text, at).end()
                start = at - 2
                if start >= ends["iban"] and _COUNTRY.match(text, start) and not (start and text[start - 1].isalnum()) and (end := _account(text, start, False)):
                    keep("iban", start, end, True)
                if at >= ends["ip"] and (m := _IP.match(text, at)):
                    keep("ip", at, m.end(), all(part.lstrip("0") == "" or len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split(".")))
            if at > checked_card:
                m = _DIGITS.match(text, at)
                checked_card = at if m is None else m.end() - 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    keep("card", at, m.end(), 16 <= len(digits) <= 19 and _luhn(digits))
        elif kind == AT:
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                keep("email", start, m.end(), True)
        elif kind == PLUS:
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                keep("phone", at, m.end(), 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif kind == SCHEME:
            if m := _LOGIN.match(text, last + 1):
                keep("login", m.start(), m.end(), True)
        elif kind == CUE:
            m = _BEHIND_CUE.match(text, last + 1)
            if m.end() >= ends["iban"] and (end := _account(text, m.end(), True)):
                keep("iban", m.end(), end, True)
        elif kind == PREFIX:
            if at >= ends["secret"] and not (at and text[at - 1].isalnum()) and (m := _PREFIXED[text[at : last + 1]].match(text, at)):
                keep("secret", at, m.end(), True)
        elif at >= ends["secret"] and (place := _secret(text, at, last + 1, kind)):
            keep("secret", *place, True)
    return [span for kind in ends for span in spans[kind]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        columns: list[list] = [[] for _ in range(8)]
        for text in batch.column("text").to_pylist():
            spans = find(text, anchors)
            base = [s for s in spans if s[0] in BASE_KINDS]
            for i, kind in enumerate(BASE_KINDS):
                columns[i].append(sum(s[0] == kind for s in base))
            columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            columns[5].append(joined(spans))
            columns[6].append(len(spans) - len(base))
            columns[7].append(len(spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        arrays = [batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])


def personal_data(documents: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, a digest of the base spans, all spans as kind:start:end, the numbers of added and all spans."""
    return documents.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
