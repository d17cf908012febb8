"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) stand as soon as their own test passes; their score is told. Kinds that
the method adds need a score of ``THRESHOLD``: an iban (mod-97) of a listed country and a secret with a known
prefix have it by themselves; an iban of another country, a shorter card number (pan), a social security
number and a bare key or token have it only with a word around that speaks for them and none against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import unused, with_text_columns

KINDS = ("email", "ip", "card", "phone", "iban", "pan", "ssn", "secret")
#: Score of a confirmed span, what a context word adds or takes, how far around it is looked for, and the
#: score that a span of an added kind needs. ``SURE`` is the score of an added span that needs no context.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.5, "pan": 0.5, "ssn": 0.5, "secret": 0.5}
CONTEXT_GAIN, CONTEXT_LOSS, CONTEXT_CHARS, THRESHOLD, SURE = 0.3, 0.3, 48, 0.7, 1.0
_CARD_WORDS = ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "kreditkarte", "carte", "tarjeta", "carta")
#: Words that speak for a kind, in English, German, French, Spanish and Italian.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reply", "kontakt", "courriel", "correo", "contacto"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "serveur", "servidor", "dirección"),
    "card": _CARD_WORDS,
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "cuenta", "banco", "conto"),
    "pan": _CARD_WORDS,
    "ssn": ("ssn", "social security", "tax id", "taxpayer", "sozialversicherung", "sécurité sociale", "seguridad social", "seguro social"),
    "secret": ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "credential", "bearer", "auth", "schlüssel", "passwort", "kennwort", "jeton", "clé", "mot de passe", "clave", "contraseña"),
}
_NUMBERED = ("order", "invoice", "isbn", "tracking", "serial", "part number", "bestellung", "rechnung", "commande", "facture", "pedido", "factura")
#: Words that speak against a kind.
AGAINST = {"iban": _NUMBERED, "pan": _NUMBERED, "ssn": _NUMBERED, "secret": ("commit", "sha1", "sha256", "sha-1", "sha-256", "md5", "checksum", "digest", "hash", "revision", "etag")}


def _any_of(words: tuple) -> re.Pattern:
    return re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, words)) + r")s?(?![^\W\d_])", re.IGNORECASE)


_CONTEXT, _AGAINST = ({k: _any_of(v) for k, v in x.items()} for x in (CONTEXT, AGAINST))

#: Characters of an IBAN by its country code (the IBAN registry).
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_NEXT = re.compile(r"\x20?[A-Z0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}+={0,2}")
#: How keys of well-known services begin.
_KNOWN_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}")
#: Digits and distinct characters that a key has at least: words and paths have fewer.
KEY_DIGITS, KEY_VARIETY = 4, 10
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    """The digits' Luhn sum is a multiple of ten (every second digit from the right doubled, nines cast out)."""
    return (sum(map(int, digits[::-2])) + sum(map(int, digits[-2::-2].translate(_DOUBLED)))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: with its first four characters last and letters as 10 to 35, the number is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _ibans(text: str):
    # The country says how long the number is, so what follows it, as BIC or a year, is never taken for a part;
    # for a country that isn't listed the longest run of whole words that passes is taken.
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        length, end, n, found = IBAN_LENGTHS.get(m.group()[:2]), m.end(), 4, None
        while n < (length or 35) and (c := _IBAN_NEXT.match(text, end)):
            end, n = c.end(), n + 1
            if n == length or length is None and n >= 12:
                whole = not (end < len(text) and text[end].isascii() and text[end].isalnum())
                if whole and mod97(text[m.start() : end].replace(" ", "")):
                    found = end
        if found:
            yield m.start(), found
            done = found


def _emails(text: str):
    # The part before an @ cannot hold another, so one look at each @ finds the leftmost matches.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _addresses(text: str):
    # In a run of dotted numbers the leftmost matches are its consecutive quadruples.
    for run in _DOTTED.finditer(text):
        parts = list(_PART.finditer(run.group()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(v := p.group().lstrip("0")) < 4 and int(v or 0) <= 255 for p in four):
                yield run.start() + four[0].start(), run.start() + four[3].end()


def _keys(text: str):
    for m in _KEY.finditer(text):
        whole = m.group()
        known = _KNOWN_KEY.fullmatch(whole) is not None
        if known or sum(map(str.isdecimal, whole)) >= KEY_DIGITS and len(set(whole)) >= KEY_VARIETY and any(map(str.isalpha, whole)):
            yield m.start(), m.end(), known


def _score(text: str, kind: str, start: int, end: int, sure: bool = False) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " \n " + text[end : end + CONTEXT_CHARS // 2]
    score = SURE if sure else BASE_SCORE[kind]
    if _CONTEXT[kind].search(near):
        score += CONTEXT_GAIN
    if kind in _AGAINST and _AGAINST[kind].search(near):
        score -= CONTEXT_LOSS
    return round(min(1.0, max(0.0, score)), 6)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), in the order of ``KINDS``, then by start; code points."""
    found: dict[str, list] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] += _emails(text)
    if _DIGIT.search(text):
        found["ip"] += _addresses(text)
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card" if len(digits) >= 16 else "pan"].append(m.span())
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append(m.span())
        found["iban"] += ((a, b, text[a : a + 2] in IBAN_LENGTHS) for a, b in _ibans(text))
        found["ssn"] += (m.span() for m in _SSN.finditer(text))
        found["secret"] += _keys(text)
    out = []
    for kind in KINDS:
        for start, end, *sure in found[kind]:
            score = _score(text, kind, start, end, any(sure))
            if kind in KINDS[:4] or score >= THRESHOLD:
                out.append((kind, start, end, score))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or spans that overlap, put as ``[KIND]`` of the first of them."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of kind, start, end (exclusive, code points) and score.

    A null or empty text has no spans. Spans of different kinds may overlap. Rows are treated one by one,
    so repeated rows get equal results; a column named ``spans`` is replaced, others stay.
    """

    def make():
        def call(texts):
            found = [find(t.decode()) if t else [] for t in texts]
            return {"spans": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found]}

        return call

    return with_text_columns(docs, make, "spans array<struct<kind:string,start:long,end:long,score:double>>", text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; all other columns stay, whatever their
    names (null: null)."""

    def make():
        def call(texts):
            plain = [None if t is None else t.decode() for t in texts]
            return {clear: [t and redact(t, find(t)) for t in plain]}

        return call

    clear = unused(docs, "clear")
    return with_text_columns(docs, make, f"{clear} string").withColumn("text", F.col(clear)).drop(clear)
