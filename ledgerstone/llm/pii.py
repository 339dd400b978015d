"""Operator 2: personal data, also behind disguises, with spans in the source's code points.

Base detectors read the source text. Then transducers rewrite the text piece by piece: look-alike letters and
full-width forms become ASCII, runs of spelled digits become digits, "[at]" and "dot" become signs. Each rewritten
piece remembers the source range it came from; the detectors read the normalised text, and a span there maps
back to the source range of its pieces. A span that only the normalised text shows is added if it covers a
rewritten piece and doesn't lie inside a base span of its kind; a base span that it covers stays in the list too.

A null text counts as empty and has no spans. Rows are handled one by one: repeated rows give repeated rows, and
other columns pass through. All scans are linear in the text, however long.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trim

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A number starts where no digit stands before it: an attempt inside a run of digits can't do better than one at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str):
    """Leftmost non-overlapping matches, found from their at signs: the local part is the whole run before the sign, unless the last match took some of it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": list(_emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if re.search(r"[0-9]", text):
        out |= {"ip": list(_ips(text)) if "." in text else [], "card": list(_cards(text)), "phone": list(_phones(text)) if "+" in text else []}
    return out


# -- transducers ---------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("авеікмнорстухѕјԁһАВЕІКМНОРСТУХЅЈαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeikmhopctyxsjdhABEIKMHOPCTYXSJaeikvoptuxABEZHIKMNOPTYX"))
#: Signs that stand for ASCII signs.
_SIGNS = {"﹫": "@", "∙": ".", "•": ".", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", "\xa0": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "\xad": ""}
_CHARS = _LOOKALIKES | _SIGNS | {chr(0xFEE0 + i): chr(i) for i in range(33, 127)} | {chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966) for d in range(10)}
_ODD = re.compile("[" + re.escape("".join(_CHARS)) + "]")

#: The names of the digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
#: Spelled digits in a row; signs, digits and point words may stand between. Nothing is tried twice, so a scan is linear.
_SPELLED = re.compile(rf"(?i)(?<!\w){_WORD}(?!\w)(?:[\s,-]++(?:(?>{_WORD}|dot|point|punkt)|[0-9]++)(?!\w))*+")
_PIECE = re.compile(rf"(?i)({_WORD})(?!\w)|(dot|point|punkt)(?!\w)|([0-9]+)|([\s,-]+)")
_BRACKETS = re.compile(r"(?i)[\[({<]\s*+(?:(at|@|arroba)|(dot|\.|punkt|punto))\s*+[\])}>]\s*+")
_DOT = re.compile(r"(?i)\s+dot\s+")
#: After an at sign, also one from brackets, any suffix of two or more letters ends the chain.
_AT_CHAIN = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])@(?P<host>(?:[A-Za-z0-9-]++(?:\s+dot\s+|\.))+[A-Za-z]{2,}+(?![A-Za-z0-9-]))")
#: Suffixes that end a chain of bare words.
_SUFFIXES = frozenset(
    """com org net edu gov mil int info biz name pro app dev xyz online site shop store tech cloud blog email club live news page world agency
    digital group life media network solutions space studio systems today team top work zone mobi jobs museum travel coop aero asia cat tel post arpa
    ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu
    cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id
    ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms
    mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk
    sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)
#: Bare words count only as a chain: name at host dot domain, with a known suffix at its end.
_BARE_CHAIN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at>\s+at\s+)(?P<host>(?:[A-Za-z0-9-]++(?:\s+dot\s+|\.))+(?:{'|'.join(sorted(_SUFFIXES))})(?![A-Za-z0-9-]))")


class _Mapped:
    """A text with, for each of its pieces, where it begins here and which source range it stands for."""

    def __init__(self, text: str):
        self.text, self.at, self.source, self.changed = text, [0], [(0, len(text))], [False]

    def back(self, i: int) -> tuple[int, int, bool]:
        """The source range of the code point at i, and whether it was rewritten."""
        k = bisect_right(self.at, i) - 1
        a, b = self.source[k]
        return (a, b, True) if self.changed[k] else (a + i - self.at[k], a + i - self.at[k] + 1, False)

    def span(self, start: int, end: int) -> tuple[int, int, bool]:
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return self.back(start)[0], self.back(end - 1)[1], any(self.changed[a : b + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> _Mapped:
        """Edits are (start, end, replacement), in order and apart from each other."""
        if not edits:
            return self
        out, parts, here = _Mapped.__new__(_Mapped), [], 0
        out.at, out.source, out.changed = [], [], []

        def keep(a: int, b: int) -> None:
            nonlocal here
            k = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                if stop > a:
                    s, e = self.source[k]
                    out.at.append(here), out.changed.append(self.changed[k])
                    out.source.append((s, e) if self.changed[k] else (s + a - self.at[k], s + stop - self.at[k]))
                    here += stop - a
                a, k = max(a, stop), k + 1

        last = 0
        for start, end, new in edits:
            keep(last, start)
            parts.append(self.text[last:start])
            if new:
                out.at.append(here), out.source.append((self.back(start)[0], self.back(end - 1)[1])), out.changed.append(True)
                parts.append(new)
                here += len(new)
            last = end
        keep(last, len(self.text))
        parts.append(self.text[last:])
        out.text = "".join(parts)
        return out


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        pieces = [p for p in _PIECE.finditer(text, m.start(), m.end())]
        while pieces[-1][1] is None:  # a run ends with its last spelled digit
            pieces.pop()
        if sum(p[1] is not None for p in pieces) < 4:
            continue
        for k, p in enumerate(pieces):
            if p[1] is not None:
                out.append((*p.span(), _DIGITS[p[1].lower()]))
            elif p[2] is not None:
                out.append((*p.span(), "."))
            elif p[4] is not None and k:
                out.append((*p.span(), ""))
    return out


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs for words in brackets, with the white space on both sides."""
    out, last = [], 0
    for m in _BRACKETS.finditer(text):
        start = m.start()
        while start > last and text[start - 1].isspace():
            start -= 1
        last = m.end()
        out.append((start, last, "@" if m[1] else "."))
    return out


def _chain_edits(m: _Mapped, pattern: re.Pattern) -> list[tuple[int, int, str]]:
    """Signs for the words of chains that have a spoken or bracketed dot."""
    bracketed = any(c and b - a > 1 for c, (a, b) in zip(m.changed, m.source))
    out = []
    if not re.search(r"(?i)\sdot\s", m.text) and not bracketed:
        return out
    for chain in pattern.finditer(m.text):
        dots = [(*x.span(), ".") for x in _DOT.finditer(m.text, *chain.span("host"))]
        if "at" in pattern.groupindex:
            a, b = chain.span("host")
            if dots or any(m.text[i] == "." and m.back(i)[1] - m.back(i)[0] > 1 for i in range(a, b)):
                out.append((*chain.span("at"), "@"))
                out += dots
        else:
            out += dots
    return out


def normalise(text: str) -> _Mapped | None:
    """The text with its disguises undone, or None where it has none."""
    m = _Mapped(text)
    if not text.isascii():
        m = m.rewrite([(*x.span(), _CHARS[x[0]]) for x in _ODD.finditer(m.text)])
    if re.search(rf"(?i)(?<!\w){_WORD}[\s,-]+{_WORD}(?!\w)", m.text):
        m = m.rewrite(_spelled_edits(m.text))
    if re.search(r"(?i)[\[({<]\s*(?:at|@|arroba|dot|\.|punkt|punto)\s*[\])}>]", m.text):
        m = m.rewrite(_bracket_edits(m.text))
    m = m.rewrite(_chain_edits(m, _AT_CHAIN))
    m = m.rewrite(_chain_edits(m, _BARE_CHAIN))
    return m if any(m.changed) or m.text != text else None


def find_spans(text: str) -> tuple[dict, dict]:
    """Base spans and all spans, by kind in order of their start."""
    base = base_spans(text)
    plain = normalise(text)
    if plain is None:
        return base, base
    every = {}
    for kind in KINDS:
        mine = list(base[kind])
        starts = [s for s, _ in base[kind]]
        for s, e in _FIND[kind](plain.text):
            a, b, changed = plain.span(s, e)
            k = bisect_right(starts, a)
            inside = k > 0 and b <= base[kind][k - 1][1]
            if not inside and (changed or len(plain.text) != len(text)) and text[a:b] != plain.text[s:e]:
                mine.append((a, b))
        every[kind] = sorted(mine)
    return base, every


def _joined(spans: dict) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redact(text: str) -> str:
    """The text with each span replaced by its kind; overlapping spans count as one, of the first's kind."""
    _, spans = find_spans(text)
    out, last = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s >= last:
            out += [text[last:s], f"[{k.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


_REPORT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


@F.pandas_udf(_REPORT)
def _report(texts: pd.Series) -> pd.DataFrame:
    trim()
    rows = []
    for t in texts:
        base, every = find_spans(t)
        n = [len(base[k]) for k in KINDS]
        rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), sum(map(len, every.values())) - sum(n)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    trim()
    return texts.map(redact)


def detect(text: Column) -> Column:
    """A struct: counts of base spans by kind, the hash of base spans, all spans, and how many the transducers added."""
    return _report(F.coalesce(text, F.lit("")))


def redact_column(text: Column) -> Column:
    """The text with its personal data replaced; null stays null."""
    return F.when(text.isNotNull(), _redacted(F.coalesce(text, F.lit(""))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", detect(F.col("text")).alias("p")).select("doc_id", "p.*")
