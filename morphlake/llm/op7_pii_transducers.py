"""Personal data in plain and in disguised form, with spans in the source text.

Transducers rewrite pieces of the text, each reading what the one before has written: look-alike characters become the
ASCII ones they imitate, digits spelled as words become digits, and "at", "dot" and "plus" in disguise become their signs.
Each rewritten piece remembers the source span it came from, so what the detectors find in the rewritten text is mapped
back to source positions through all of them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import id_text, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")  # begins at a run of digits only, so a long one costs no more than its length
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Look-alike characters and the ASCII characters they imitate.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "ɑ": "a", "ɡ": "g", "ı": "i",
    "․": ".", "‥": "..", "。": ".", "．": ".", "＠": "@", "﹫": "@", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "－": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
# Digits as words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _lookalikes() -> dict[str, str]:
    """The fixed table; and by rule: all decimal digits, and characters whose compatibility form is one ASCII sign (full-width, mathematical, circled)."""
    out = {}
    for code in (*range(0x80, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x11800), *range(0x1D400, 0x1D800), *range(0x1E000, 0x1FC00)):
        c = chr(code)
        digit, form = unicodedata.decimal(c, None), unicodedata.normalize("NFKC", c)
        if digit is not None or (len(form) == 1 and form.isascii()):
            out[c] = form if digit is None else str(digit)
    return out | LOOKALIKES


_LOOK = _lookalikes()
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_RUN = rf"(?<![A-Za-z])(?:{_WORD}|[0-9])(?:[ \-]{{1,3}}(?:{_WORD}|[0-9])){{3,}}(?![A-Za-z])"
_SIGN = r"\s{0,3}(?P<open>[\[({<])\s{0,3}(?P<sign>at|dot|plus|@|\.)\s{0,3}[\])}>]\s{0,3}"
_BARE = r"(?<=[A-Za-z0-9])\s{1,3}(?:at|AT)\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\s{1,3}(?:dot|DOT)\s{1,3}[A-Za-z0-9-]{1,63})+)|(?<=[A-Za-z0-9])\s{1,3}(?:dot|DOT)\s{1,3}(?=[A-Za-z0-9])"
_PLUS = rf"(?<![A-Za-z])plus[ \-]{{1,3}}(?=(?:{_WORD}|[0-9]))"
#: A run of any length that a dot (as sign or word) stands beside, or that follows a plus: a part of an address or number.
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3}|\.)"
_NUMBER = rf"(?:{_WORD}|[0-9]+)(?:[ \-]{{1,3}}(?:{_WORD}|[0-9]+)){{0,30}}"
_PARTED = rf"(?<![A-Za-z0-9]){_NUMBER}(?:{_DOT}{_NUMBER})+(?![A-Za-z0-9])"
_AFTER_PLUS = rf"(?:(?<![A-Za-z])plus[ \-]{{1,3}}|\+[ ]?|[\[({{<]\s{{0,3}}(?:plus|\+)\s{{0,3}}[\])}}>]\s{{0,3}})(?P<number>{_NUMBER})(?![A-Za-z0-9])"
_PARTS, _PLUS_RUN, _DOTS = (re.compile(p, re.IGNORECASE) for p in (_PARTED, _AFTER_PLUS, _DOT))
_TOKENS = re.compile(rf"{_WORD}|[0-9]+", re.IGNORECASE)
_MARKED, _BARE_SIGN, _SPELLED_PLUS, _RUN = (re.compile(p, re.IGNORECASE) for p in (_SIGN, _BARE, _PLUS, _DIGIT_RUN))
_ANY_RUN = re.compile(rf"(?<![a-z])(?:{_WORD})[ \-]{{1,3}}(?:{_WORD}|[0-9])|[0-9][ \-]{{1,3}}(?:{_WORD})")
_LONG_WORDS = [w for w in DIGIT_WORDS if len(w) > 2]
_TOKEN = re.compile(rf"{_WORD}|[0-9]", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found outwards from each @, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)
    return out


def _ips(dotted: str, start: int) -> Iterator[tuple[str, int, int]]:
    """Every four numbers of a dotted run, from its left, that are at most 255."""
    numbers, at = dotted.split("."), start
    for i in range(0, len(numbers) - 3, 4):
        four = numbers[i : i + 4]
        if all(len(bare := n.lstrip("0")) <= 3 and int(bare or 0) <= 255 for n in four):
            yield "ip", at, at + sum(map(len, four)) + 3
        at += sum(map(len, four)) + 4


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors, by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    found += [x for m in _DOTTED.finditer(text) for x in _ips(m.group(), m.start())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return _sorted(found)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


Piece = tuple[int, int, str]


def _look_pieces(text: str) -> Iterator[Piece]:
    if not text.isascii() and not _LOOK.keys().isdisjoint(set(text)):
        yield from ((i, i + 1, _LOOK[c]) for i, c in enumerate(text) if c in _LOOK)


def _digits_of(text: str, start: int, end: int, tokens: re.Pattern) -> Iterator[Piece]:
    """The digits of a run, each with the gap up to the next."""
    found = list(tokens.finditer(text, start, end))
    for t, following in zip(found, [*found[1:], None], strict=True):
        yield t.start(), following.start() if following else t.end(), DIGIT_WORDS.get(t.group().lower(), t.group())


def _digit_pieces(text: str) -> Iterator[Piece]:
    """Runs of at least four digits, and shorter ones between dots or after a plus, where a digit is a word."""
    low = text.lower()
    if not any(w in low for w in DIGIT_WORDS):
        return
    if _ANY_RUN.search(low):
        for m in _RUN.finditer(text):
            yield from _digits_of(text, *m.span(), _TOKEN)
    if "." in text or "dot" in low:
        for m in _PARTS.finditer(text):
            if any(w in m.group().lower() for w in DIGIT_WORDS):
                at = m.start()
                for d in [*_DOTS.finditer(text, *m.span()), None]:
                    yield from _digits_of(text, at, d.start() if d else m.end(), _TOKENS)
                    at = d.end() if d else at
    if "+" in text or "plus" in low:
        for m in _PLUS_RUN.finditer(text):
            if any(w in m["number"].lower() for w in DIGIT_WORDS):
                yield m.start(), m.start("number"), "+"
                yield from _digits_of(text, *m.span("number"), _TOKENS)


def _sign_pieces(text: str) -> Iterator[Piece]:
    low = text.lower()
    if any(c in text for c in "[({<"):
        for m in _MARKED.finditer(text):
            yield m.start(), m.end(), {"at": "@", "dot": ".", "plus": "+"}.get(m["sign"].lower(), m["sign"])
    if "dot" in low:
        for m in _BARE_SIGN.finditer(text):
            yield m.start(), m.end(), {"at": "@", "dot": "."}[m.group().strip().lower()]
    if "plus" in low:
        yield from ((m.start(), m.end(), "+") for m in _SPELLED_PLUS.finditer(text))


_TRANSDUCERS = (_look_pieces, _digit_pieces, _sign_pieces)
Step = tuple[list[int], list[int], list[int]]


def _rewrite(text: str, pieces: Iterator[Piece]) -> tuple[str, Step] | None:
    """The text after one transducer; at each piece: its place in the new text, in the old, and its end in the old."""
    parts: list[str] = []
    new, old, ends = [0], [0], [0]
    at = size = 0
    for start, end, by in sorted(pieces):
        if start < at:
            continue
        parts += [text[at:start], by]
        size += start - at
        new += [size, size + len(by)]
        old += [start, end]
        ends += [end, end]
        size += len(by)
        at = end
    if len(new) == 1:
        return None
    return "".join([*parts, text[at:]]), (new, old, ends)


def rewritten(text: str) -> tuple[str, list[Step]] | None:
    """The text after all transducers in turn, and the steps back; None where none applies."""
    steps = []
    for transducer in _TRANSDUCERS:
        changed = _rewrite(text, transducer(text))
        if changed:
            text = changed[0]
            steps.append(changed[1])
    return (text, steps) if steps else None


def _back(pos: int, new: list[int], old: list[int], ends: list[int], is_end: bool) -> int:
    """Source position of a position in the rewritten text; inside a rewritten piece, the piece's outer edge."""
    i = bisect_left(new, pos + 1) - 1
    if is_end and i > 0 and new[i] == pos:
        while i > 0 and new[i] == pos and new[i - 1] == pos:
            i -= 1
        return old[i]
    if i + 1 < len(new) and ends[i] != old[i]:  # inside a piece
        return ends[i] if is_end and pos > new[i] else old[i]
    return old[i] + (pos - new[i])


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones with those found only after rewriting.

    A rewritten span that touches base ones of its kind is added where it covers all of these and more; they stay too.
    """
    base = plain(text)
    changed = rewritten(text)
    if changed is None:
        return base, base
    added = []
    own = {k: [(s, e) for x, s, e in base if x == k] for k in KINDS}  # of one kind: apart from each other, by start
    for kind, a, b in plain(changed[0]):
        start, end = a, b
        for step in reversed(changed[1]):
            start, end = _back(start, *step, False), _back(end, *step, True)
        touched = own[kind][bisect_right(own[kind], start, key=lambda x: x[1]) : bisect_left(own[kind], end, key=lambda x: x[0])]
        if all(start <= s and e <= end and (start, end) != (s, e) for s, e in touched):
            added.append((kind, start, end))
    return base, _sorted(base + added)


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``: spans as kind:start:end in code points, comma-joined.

    Null and empty texts have none. All rows count, equal ones too, and null and shared ids are kept as they are; other
    columns, whatever their names, are ignored.
    """

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [spans(t) if isinstance(t, str) else ([], []) for t in pdf["text"]]
            counts = {f"n_{k}": [sum(s[0] == k for s in b[1]) for b in both] for k in KINDS}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **counts, "base": [_joined(b[0]) for b in both], "spans": [_joined(b[1]) for b in both]})

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    found = docs.select(id_text(), "text").mapInPandas(detect, f"doc_id string, {columns}, base string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_pii_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
