"""Personal data found from anchors.

One Aho-Corasick pass over a text, A-Z lower-cased, finds at-signs, plus signs,
digits, the mark after a scheme, identifier cues and words for streets. From each
anchor a local parser expands to the boundaries of an address or number and
validates it; text without anchors is never parsed.

Kinds beside the base ones:

* account: an international bank account number, after its cue or bare (country's
  length and modulo 97), or 6 to 18 digits after an account cue and a link word
* login: user:password@host after any scheme
* address: house number, one to four capitalised words and a word for a street, or
  a name ending in one and the number; a unit may follow
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_map, ready

# Character classes, cues, words, lengths by country and the order of the kinds.
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
SCHEME_MARK = "://"
SCHEME = LABEL | frozenset("+.")
IBAN_CUES = ("iban", "bank account number", "international bank account")
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "kontonummer", "compte", "cuenta")
LINKS = ("no", "nr", "num", "number", "nummer", "numero", "is", "code")
STREETS = (
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd",
    "court", "ct", "place", "pl", "square", "sq", "terrace", "way", "highway", "hwy", "parkway", "pkwy",
)
ENDINGS = ("straße", "strasse", "gasse", "allee", "platz", "weg")
UNITS = ("apt", "apartment", "suite", "ste", "unit", "floor", "#")
# Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
KINDS = ("email", "ip", "card", "phone", "account", "login", "address")
BASE_KINDS = KINDS[:4]
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

Span = tuple[int, int]


def parse_email(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at``, its local part not before ``floor``."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    if begin == at:
        return None
    n, end, labels = len(text), at, 0
    while end < n and (labels == 0 or text[end] == "."):
        stop = end + 1
        while stop < n and text[stop] in LABEL:
            stop += 1
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return (begin, end) if labels >= 2 else None


def parse_ip(text: str, begin: int) -> Span | None:
    """Four numbers joined by dots from a run of digits on."""
    n, end = len(text), begin
    for part in range(4):
        if part:
            if end >= n or text[end] != ".":
                return None
            end += 1
        stop = end
        while stop < n and text[stop] in DIGITS:
            stop += 1
        if stop == end:
            return None
        end = stop
    return begin, end


def parse_digits(text: str, begin: int) -> Span:
    """The longest run of digits from ``begin`` with single spaces or hyphens between them."""
    n, end = len(text), begin + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return begin, end


def parse_phone(text: str, plus: int) -> Span | None:
    n, end = len(text), plus + 2
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    while end < n and text[end] in PHONE:
        end += 1
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def _alphanumeric(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _check(code: str) -> bool:
    """Country, two check digits, and modulo 97."""
    return code[:2].isalpha() and code[2:4].isdigit() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def after_links(text: str, at: int) -> tuple[int, bool]:
    """The place after blanks, marks and up to three link words from ``at`` on, and whether there was a mark or a word."""
    n, linked, words = len(text), False, 0
    while at < n:
        if text[at] in " \t":
            at += 1
        elif text[at] in ":#.-":
            at, linked = at + 1, True
        else:
            end = at
            while end < n and end - at < 8 and text[end].isalpha():
                end += 1
            if words == 3 or text[at:end].translate(_LOWER) not in LINKS or (end < n and text[end].isalnum()):
                break
            at, linked, words = end, True, words + 1
    return at, linked


def parse_account(text: str, at: int) -> Span | None:
    """An international bank account number after its cue: letters, check digits, groups; valid modulo 97."""
    n, at = len(text), after_links(text, at)[0]
    end, code = at, ""
    while end < n and len(code) < 34:
        c = text[end]
        if _alphanumeric(c):
            code += c.upper()
        elif c != " " or end + 1 >= n or not _alphanumeric(text[end + 1]):
            break
        end += 1
    # Words may follow without punctuation: the longest valid length wins.
    while len(code) >= 15:
        if _check(code):
            return at, end
        end -= 1
        while text[end - 1] == " ":
            end -= 1
        code = code[:-1]
    return None


def parse_bare_account(text: str, at: int) -> Span | None:
    """Such a number without a cue: capital letters, the country's length, all in one or in groups of four, nothing joined to it."""
    length = IBAN_LENGTHS.get(text[at : at + 2], 0)
    if not length or (at and text[at - 1].isalnum()):
        return None
    gap = 1 if text[at + 4 : at + 5] == " " else 0
    end = at + length + gap * ((length - 1) // 4)
    groups = text[at:end].split(" ")
    code = "".join(groups)
    if len(code) != length or not all(c.isascii() and (c.isdigit() or c.isupper()) for c in code) or (end < len(text) and text[end].isalnum()):
        return None
    whole = not gap and len(groups) == 1 or gap and all(len(g) == 4 for g in groups[:-1])
    return (at, end) if whole and _check(code) else None


def parse_numbered_account(text: str, at: int) -> Span | None:
    """6 to 18 digits, single blanks or hyphens between them, after an account cue and a link."""
    at, linked = after_links(text, at)
    if not linked or at >= len(text) or text[at] not in DIGITS:
        return None
    begin, end = parse_digits(text, at)
    if end < len(text) and text[end].isalnum():
        return None
    return (begin, end) if 6 <= sum(c in DIGITS for c in text[begin:end]) <= 18 else None


def _word_before(text: str, end: int) -> tuple[int, int]:
    """The word that ends before ``end`` and one blank; empty if there is none."""
    if end < 1 or text[end - 1] != " ":
        return end, end
    stop = begin = end - 1
    while begin and stop - begin < 40 and (text[begin - 1].isalnum() or text[begin - 1] in ".'-"):
        begin -= 1
    return begin, stop


def _unit(text: str, end: int) -> int:
    """The end with a unit (apartment, suite) that follows."""
    at = end
    while at < len(text) and at - end < 3 and text[at] in " ,.":
        at += 1
    for name in UNITS:
        if text[at : at + len(name)].translate(_LOWER) == name:
            at += len(name)
            while at < len(text) and text[at] in " .":
                at += 1
            stop = at
            while stop < len(text) and stop - at < 6 and text[stop].isalnum():
                stop += 1
            return stop if any(c in DIGITS for c in text[at:stop]) or (stop == at + 1) else end
    return end


def parse_street(text: str, begin: int, end: int) -> Span | None:
    """House number, one to four capitalised words, then the word for a street at ``begin`` to ``end``."""
    if (end < len(text) and text[end].isalnum()) or not text[begin].isupper():
        return None
    at, names = begin, 0
    while names <= 4:
        at, stop = _word_before(text, at)
        if at == stop:
            return None
        word = text[at:stop]
        if names and word[0] in DIGITS:
            number = word[:-1] if word[-1].isalpha() else word
            ordinal = word[-2:].translate(_LOWER) in ("st", "nd", "rd", "th")
            if not ordinal:
                sound = 1 <= len(number) <= 5 and all(c in DIGITS for c in number) and number[0] != "0"
                return (at, _unit(text, end)) if sound else None
        elif not (word[0].isupper() or word[0] in DIGITS):
            return None
        names += 1
    return None


def parse_named_street(text: str, end: int) -> Span | None:
    """A capitalised name that ends in a word for a street at ``end``, a blank, and a house number."""
    begin = end
    while begin and end - begin < 40 and (text[begin - 1].isalpha() or text[begin - 1] == "-"):
        begin -= 1
    stop = end + 1
    while stop < len(text) and stop - end <= 5 and text[stop] in DIGITS:
        stop += 1
    if stop == end + 1 or text[end] != " " or text[end + 1] == "0" or not text[begin].isupper():
        return None
    if stop < len(text) and text[stop].isascii() and text[stop].islower():
        stop += 1
    return None if stop < len(text) and text[stop].isalnum() else (begin, stop)


def parse_login(text: str, at: int) -> Span | None:
    """user:password@host right after a scheme and its mark."""
    if at < 4 or text[at - 4] not in SCHEME:
        return None
    n, end, colon, sign = len(text), at, -1, -1
    while end < n and text[end] not in " \t\n\r/\"'<>":
        if text[end] == ":" and colon < 0:
            colon = end
        elif text[end] == "@":
            sign = end
        end += 1
    return (at, end) if at < colon < sign - 1 and sign + 1 < end else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def build_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "@+":
        automaton.add_word(c, (c, 1))
    for c in DIGITS:
        automaton.add_word(c, ("0", 1))
    automaton.add_word(SCHEME_MARK, ("s", len(SCHEME_MARK)))
    for kind, listed in (("i", IBAN_CUES), ("a", ACCOUNT_CUES), ("w", tuple(f" {x}" for x in STREETS)), ("e", ENDINGS)):
        for word in listed:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


_NAMES = {"i": "account", "a": "account", "s": "login", "w": "address", "e": "address"}
_PARSERS = {
    "i": lambda text, begin, end: parse_account(text, end),
    "a": lambda text, begin, end: parse_numbered_account(text, end),
    "s": lambda text, begin, end: parse_login(text, end),
    "w": lambda text, begin, end: parse_street(text, begin + 1, end),
    "e": lambda text, begin, end: parse_named_street(text, end),
}


def find_spans(text: str, automaton) -> dict[str, list[Span]]:
    """Spans by kind in code points, ends exclusive; those of a kind do not overlap."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    last_digit = -2
    for place, (kind, length) in automaton.iter(text.translate(_LOWER)):
        if kind == "0":
            run, last_digit = place != last_digit + 1, place
            if not run:
                continue
            if place >= floor["ip"] and (span := parse_ip(text, place)):
                floor["ip"] = span[1]
                parts = [p.lstrip("0") for p in text[span[0] : span[1]].split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    found["ip"].append(span)
            if place >= floor["card"]:
                span = parse_digits(text, place)
                if span[1] > place + 1:
                    floor["card"] = span[1]
                    digits = text[span[0] : span[1]].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(span)
            if place - 2 >= floor["account"] and (span := parse_bare_account(text, place - 2)):
                floor["account"] = span[1]
                found["account"].append(span)
        elif kind == "@":
            if span := parse_email(text, place, floor["email"]):
                floor["email"] = span[1]
                found["email"].append(span)
        elif kind == "+":
            if place >= floor["phone"] and (span := parse_phone(text, place)):
                floor["phone"] = span[1]
                if 8 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
        else:
            name, begin, end = _NAMES[kind], place + 1 - length, place + 1
            if begin >= floor[name] and (span := _PARSERS[kind](text, begin, end)) and span[0] >= floor[name]:
                floor[name] = span[1]
                found[name].append(span)
    return found


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = build_automaton()
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
        base, spans = [], []
        for text in batch.column("text"):
            found = find_spans(text.as_py() or "", automaton)
            for k in BASE_KINDS:
                counts[k].append(len(found[k]))
            parts = {k: [f"{k}:{a}:{b}" for a, b in found[k]] for k in KINDS}
            own = ",".join(x for k in BASE_KINDS for x in parts[k])
            base.append(hashlib.sha256(own.encode()).hexdigest())
            spans.append(",".join(x for k in KINDS for x in parts[k]))
        columns = [batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS], pa.array(base), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, their digest, and all spans.

    Whole texts are read; a null text is empty. Repeated rows and rows without
    doc_id give rows of their own. Other columns are not read. No rows give no rows.
    """
    ready(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), _work, schema)
