"""Personal data by anchor expansion: Aho-Corasick finds the anchors, deterministic parsers find the boundaries.

One automaton reports every at-sign, plus sign, digit, scheme and identifier cue of a text. From each anchor a local
parser expands left and right to the boundary and validates what it has found. The base kinds give exactly the
leftmost non-overlapping matches of these fixed patterns, checks included, a failing match being dropped unretried:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                       12 to 19 digits passing Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 9 to 15 digits

The method adds three kinds: login (user information in an address with a scheme), account (an identifier of 6 to 34
letters and digits, 6 of them digits at least, after a cue such as IBAN or account; after IBAN it must pass its check) and
secret (what is assigned, with = or a colon, to a name that ends in a cue such as token or key: 16 characters at least
with 3 digits among them; after a cue for a password 6 with a digit).

Spans are in code points, end exclusive, sorted by start and then by kind as listed. Null reads as empty. Rows that
repeat are scanned each for itself; extra columns of the input are kept by mask() and ignored by spans().
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
#: Cues that an identifier of a person or an account follows.
CUES = ("IBAN", "iban", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "passport", "Passport", "SSN", "ssn")
#: Ends of names that a secret is assigned to, each also as a capitalised and as an upper-case word, with the
#: least length of the secret and of its digits.
SECRET_CUES = {"token": (16, 3), "secret": (16, 3), "key": (16, 3), "password": (6, 1), "passwd": (6, 1), "pwd": (6, 1)}
SECRET, PADDING = ALNUM | frozenset("_-+/."), frozenset("=")
QUOTES, ASSIGNS, BLANK = frozenset("\"'"), frozenset("=:"), frozenset(" \t")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for key, value in [("@", "@"), ("+", "+"), ("://", ":"), *((d, "0") for d in sorted(DIGITS)), *((c, c.lower()) for c in CUES), *((w, c) for c in SECRET_CUES for w in (c, c.capitalize(), c.upper()))]:
        found.add_word(key, (value, len(key)))
    found.make_automaton()
    return found


def _run(text: str, i: int, chars: frozenset) -> int:
    """The end of the run of chars that begins at i."""
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text, anchors):
    last = 0
    for at in anchors:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = _run(text, at + 1, LABEL)
        if start == at or at < last or end == at + 1:
            continue
        whole = end
        while whole < len(text) and text[whole] == "." and (nxt := _run(text, whole + 1, LABEL)) > whole + 1:
            whole = nxt
        if whole > end:
            yield start, whole
            last = whole


def _addresses(text, anchors):
    last = 0
    for start in anchors:
        if start < last:
            continue
        ends = [_run(text, start, DIGITS)]
        while len(ends) < 4 and text[ends[-1] : ends[-1] + 1] == "." and (nxt := _run(text, ends[-1] + 1, DIGITS)) > ends[-1] + 1:
            ends.append(nxt)
        if len(ends) < 4:
            last = ends[0]  # no match begins inside these digits
            continue
        last = ends[3]
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[start:last].split(".")):
            yield start, last


def _cards(text, anchors):
    last, n = 0, len(text)
    for start in anchors:
        if start < last:
            continue
        end = start + 1
        while end < n and (text[end] in DIGITS or text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS):
            end += 1
        last = end
        digits = text[start:end].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield start, end


def _phones(text, anchors):
    last = 0
    for plus in anchors:
        if plus < last or text[plus + 1 : plus + 2] not in DIGITS:
            continue
        end = _run(text, plus + 2, PHONE)
        while end > plus + 4 and text[end - 1] not in DIGITS:
            end -= 1
        if end < plus + 4 or text[end - 1] not in DIGITS:
            continue
        last = end
        if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
            yield plus, end


def _logins(text, anchors):
    """The user information of scheme://user:secret@host; anchors are the colons."""
    for colon in anchors:
        start = end = colon + 3
        while end < len(text) and text[end] not in "/?#@\"'<>" and not text[end].isspace():
            end += 1
        if colon and text[colon - 1] in ALNUM and end > start and text[end : end + 1] == "@" and _run(text, end + 1, LABEL) > end + 1:
            yield start, end


def _iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _accounts(text, anchors):
    """anchors: (position after the cue, cue)."""
    last = 0
    for after, cue in anchors:
        start = after
        while start < min(len(text), after + 4) and text[start] in " :#=":
            start += 1
        if start == after or start < last:
            continue
        end, code = start, ""
        while end < len(text) and (text[end] in ALNUM or text[end] in " -" and text[end + 1 : end + 2].isdigit()) and len(code) < 35:
            code += text[end] if text[end] in ALNUM else ""
            end += 1
        if _iban(code) if cue == "iban" else 6 <= len(code) <= 34 and sum(c in DIGITS for c in code) >= 6:
            yield start, end
            last = end


def _secrets(text, anchors):
    """anchors: (position after the cue, cue). A value holds no sign of assignment, so the values of two cues never overlap."""
    for after, cue in anchors:
        at = _run(text, after + (text[after : after + 1] in QUOTES), BLANK)
        if text[at : at + 1] not in ASSIGNS:
            continue
        start = _run(text, at + 1, BLANK)
        start += text[start : start + 1] in QUOTES
        end = _run(text, start, SECRET)
        while end > start and text[end - 1] == ".":  # a sentence's end
            end -= 1
        length, digits = SECRET_CUES[cue]
        if end - start >= length and sum(c in DIGITS for c in text[start:end]) >= digits:
            yield start, _run(text, end, PADDING)


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of a text, in order."""
    if not text:
        return []
    at, plus, digit, scheme, cue, secret = [], [], [], [], [], []
    for end, (kind, length) in _automaton().iter(text):
        if kind == "0":
            digit.append(end)
        elif kind == "@":
            at.append(end)
        elif kind == "+":
            plus.append(end)
        elif kind == ":":
            scheme.append(end - length + 1)
        elif kind in SECRET_CUES:
            secret.append((end + 1, kind))
        else:
            cue.append((end + 1, kind))
    parsers = ((_emails, at), (_addresses, digit), (_cards, digit), (_phones, plus), (_logins, scheme), (_accounts, cue), (_secrets, secret))
    return sorted((s, k, e) for k, (parse, anchors) in enumerate(parsers) if anchors for s, e in parse(text, anchors))


def _spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs (doc_id, text)."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = find(text)
                kinds = [k for _, k, _ in found]
                base = _spelled(x for x in found if x[1] < len(BASE))
                rows.append((*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(base.encode()).hexdigest(), _spelled(found)))
            types = [pa.int64()] * len(BASE) + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    if not (found := find(text)):
        return text
    out, done = [], 0
    for start, kind, end in found:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with its text masked; all other columns stay as they are."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array([masked(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
