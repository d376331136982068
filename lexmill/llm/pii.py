"""Personal data, also in disguise, with spans in the source text.

Base detectors look for e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers in the
text as it stands.  Each runs in time linear in the text: where a plain pattern would retry at every
character of a long run, the run is anchored instead.

``Transducer`` then rewrites the text: homoglyphs become their ASCII letter, digits of other scripts
become ASCII digits, invisible characters go, spelled digits in a row become one number, and at/dot
disguises become ``@`` and ``.``.  Every output character keeps the source span it came from, so what
the same detectors find in the rewritten text is mapped back to source characters.  All base spans stay, and
finds that no base span of their kind equals or contains are added, so that partly disguised data has
its whole span beside that of its plain part.

Defined cases: a NULL text is empty and has no data; whole texts are read, however long; a row gives
one row whatever its id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import as_text, map_rows, read

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match always begins at the start of a digit run, so later starts need no try.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    done = 0
    sign = text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, sign + 1) if start < sign else None
        if match:
            done = match.end()
            yield start, done
        sign = text.find("@", max(done, sign + 1))


def ips(text: str) -> Iterator[Span]:
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            yield match.span()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, match[0])) <= 15:
            yield match.span()


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in the text as it stands."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if _DIGIT.search(text):
        found["ip"], found["card"] = list(ips(text)), list(cards(text))
        if "+" in text:
            found["phone"] = list(phones(text))
    return found


# Look-alikes of ASCII letters, in the order of the letters below each other.
_CYRILLIC = "АВЕКМНОРСТХУаеорсухіјѕһԁԛԝ"
_AS_LATIN = "ABEKMHOPCTXYaeopcyxijshdqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν"
_AS_LATIN_TOO = "ABEZHIKMNOPTYXoav"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SIGNS = {
    "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+",
    "\u2010": "-", "\u2011": "-", "\uff0d": "-", "\u2212": "-", "\u00a0": " ",
}


def _glyphs() -> dict[str, str]:
    """One source character to its ASCII form ('' for an invisible one)."""
    table = dict(zip(_CYRILLIC + _GREEK, _AS_LATIN + _AS_LATIN_TOO)) | dict.fromkeys(_INVISIBLE, "") | _SIGNS
    styled = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x24B6, 0x24EA)]
    for code in styled:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii():
            table.setdefault(chr(code), plain)
    for code in range(0x660, 0x1FC00):
        if unicodedata.category(chr(code)) == "Nd":
            table.setdefault(chr(code), str(unicodedata.decimal(chr(code))))
    return table


GLYPHS = _glyphs()
# Spelled digits, from zero to nine, in the four languages of the corpus.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_VALUES = {word: str(n) for line in NUMBER_WORDS for n, word in enumerate(line.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_VALUES, key=len, reverse=True)) + ")"
_NUMBER = rf"(?<!\w)(?:{_WORD}|[0-9]{{1,4}})(?!\w)"
_DOT_WORDS = ("dot", "punkt", "punto")
_AT_WORDS = ("at", "arroba", "ät")
_DOT_WORD, _AT_WORD = "(?:" + "|".join(_DOT_WORDS) + ")", "(?:" + "|".join(_AT_WORDS) + ")"
_TOLD_DOT = rf"\s{{0,3}}[\[({{<]\s?(?:{_DOT_WORD}|point|\.)\s?[\])}}>]\s{{0,3}}|\s{_DOT_WORD}\s"
#: Between blanks a plain dot ends a sentence, unless single letters or digits stand on both sides; between numbers it is a dot as well.
_DOT = rf"(?:{_TOLD_DOT}|(?<=(?<![A-Za-z0-9])[A-Za-z0-9])\s\.\s(?=[A-Za-z0-9](?![A-Za-z0-9])))"
_NUMBER_DOT = rf"(?:{_TOLD_DOT}|\s\.\s)"
_AT = rf"(?:\s{{0,3}}[\[({{<]\s?(?:{_AT_WORD}|@)\s?[\])}}>]\s{{0,3}}|(?<=\w)\(a\)(?=\w)|\s{_AT_WORD}\s|\s?@\s?)"
_LABEL = r"[A-Za-z0-9-]+"
#: A row of at least four numbers; dots may stand between.
_SPELLED = re.compile(
    rf"(?:(?<!\w)plus[\s-]{{1,3}})?{_NUMBER}(?:(?:[\s,-]{{1,3}}|\s?{_NUMBER_DOT}\s?|\s?\.\s?){_NUMBER}){{3,}}", re.I
)
_PART = re.compile(
    rf"(?P<plus>(?<!\w)plus(?!\w))|(?P<word>(?<!\w){_WORD}(?!\w))|(?P<digit>[0-9])|(?P<dot>{_DOT_WORD}|point|\.)", re.I
)
_ANY_AT = re.compile(_AT, re.I)
_ANY_DOT = re.compile(_DOT, re.I)
_ANY_TOLD_DOT = re.compile(_TOLD_DOT, re.I)
_BARE_AT = re.compile(rf"\s{_AT_WORD}\s", re.I)
_DOT_BEFORE = re.compile(rf"{_DOT}\Z", re.I)
_SIGNED_DOMAIN = re.compile(rf"{_LABEL}(?:(?:{_DOT}|\.){_LABEL})+", re.I)
_DOTTED = re.compile(rf"(?<=[0-9]){_NUMBER_DOT}(?=[0-9])", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:{_AT_WORD}|@|a|{_DOT_WORD}|point|\.)\s?[\])}}>]", re.I)
_GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + "]")
_TOKEN = re.compile(r"\w+")
_BARE_DOTS = frozenset((*_DOT_WORDS, "."))
#: Longest disguise of a dot, so that looking back for one is bounded.
_DOT_REACH = 16


def _folded(text: str) -> str:
    """Lower case in which every letter stands that a pattern without case takes for it."""
    return text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s").lower()


def hints(text: str) -> tuple[bool, bool, bool]:
    """Whether the text can hold look-alike characters, spelled digits, at/dot disguises."""
    glyphs = False
    if not text.isascii():
        try:
            text.encode("latin-1")
            glyphs = "\xad" in text or "\xa0" in text
        except UnicodeEncodeError:
            glyphs = bool(_GLYPH.search(text))
    words = text.lower().replace("-", " ").replace(",", " ").split()
    # ``digits`` needs four number words in a row, whatever separates them: four anywhere are a superset.
    spelled = sum(map(_VALUES.__contains__, _TOKEN.findall(_folded(text)))) >= 4
    signs = "@" in text or not _BARE_DOTS.isdisjoint(words) or bool(_BRACKETED.search(text))
    return glyphs, spelled, signs


class Transducer:
    """Text with the source span of each character; every step rewrites some spans."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each replacement in place of its span; a replaced span maps back as a whole."""
        if not edits:
            return
        pieces, starts, ends, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            pieces += (self.text[at:start], new)
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                starts += [self.starts[start]] * len(new)
                ends += [self.ends[end - 1]] * len(new)
            at = end
        self.text, self.starts, self.ends = "".join(pieces), starts, ends

    def glyphs(self) -> None:
        self.rewrite([(m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(self.text)])

    def digits(self) -> None:
        edits: list[tuple[int, int, str]] = []
        for row in _SPELLED.finditer(self.text):
            parts = list(_PART.finditer(self.text, row.start(), row.end()))
            if sum(1 for p in parts if p["word"]) < 4:
                continue
            at = row.start()
            for part in parts:
                if part.start() > at:
                    edits.append((at, part.start(), ""))
                new = "+" if part["plus"] else "." if part["dot"] else part["digit"] or _VALUES[_folded(part[0])]
                edits.append((part.start(), part.end(), new))
                at = part.end()
        self.rewrite(edits)

    def dots(self) -> None:
        self.rewrite([(*m.span(), ".") for m in _DOTTED.finditer(self.text)])

    def signs(self) -> None:
        """At/dot disguises of addresses: from each at sign, the local part before and the domain after."""
        edits: list[tuple[int, int, str]] = []
        done = 0
        for sign in _ANY_AT.finditer(self.text):
            if sign.start() < done:
                continue
            domain = _SIGNED_DOMAIN.match(self.text, sign.end())
            if not domain:
                continue
            dots = list(_ANY_DOT.finditer(self.text, *domain.span()))
            # "see us at example.com" is no address; a bare word needs a disguised dot as well, and one that is told.
            if _BARE_AT.fullmatch(sign[0]) and not any(_ANY_TOLD_DOT.fullmatch(dot[0]) for dot in dots):
                continue
            start = end = sign.start()
            before: list[tuple[int, int, str]] = []
            while True:
                while start > done and self.text[start - 1] in _LOCAL_CHARS:
                    start -= 1
                if start == end:
                    break
                back = max(done, start - _DOT_REACH)
                dot = _DOT_BEFORE.search(self.text[back:start])
                if not dot or back + dot.start() <= done or self.text[back + dot.start() - 1] not in _LOCAL_CHARS:
                    break
                before.insert(0, (back + dot.start(), start, "."))
                start = end = back + dot.start()
            if start == sign.start() and not before:
                continue
            edits += [*before, (*sign.span(), "@"), *((*d.span(), ".") for d in dots)]
            done = domain.end()
        self.rewrite(edits)


def disguised(text: str) -> dict[str, list[Span]]:
    """Source spans of what only shows after rewriting."""
    glyphs, spelled, signs = hints(text)
    if not (glyphs or spelled or signs):
        return {}
    seen = Transducer(text)
    if glyphs:
        seen.glyphs()
        _, spelled, signs = hints(seen.text)
    if spelled:
        seen.digits()
    if signs:
        seen.dots()
        seen.signs()
    if seen.text == text:
        return {}
    found = detect(seen.text)
    return {k: [(seen.starts[a], seen.ends[b - 1]) for a, b in spans] for k, spans in found.items()}


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with the disguised ones between them."""
    base = detect(text)
    more = disguised(text)
    full = {}
    for kind in KINDS:
        full[kind] = list(base[kind])
        known, at = base[kind], 0
        for start, end in more.get(kind, ()):
            while at < len(known) and known[at][1] <= start:
                at += 1
            # Base spans are disjoint, so only this one can hold the whole of it.
            if at == len(known) or start < known[at][0] or known[at][1] < end:
                full[kind].append((start, end))
        full[kind].sort()
    return base, full


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base and all spans of each kind, code points, end exclusive."""

    def step(ids, texts):
        for doc_id, text in zip(ids, texts):
            base, full = all_spans(text)
            base, full = (",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in x[k]) for x in (base, full))
            yield doc_id, base, full

    rows = docs.select(F.col(id_col).cast("long"), as_text(text_col))
    return map_rows(rows, step, "doc_id long, base_spans string, spans string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find_pii(read(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
