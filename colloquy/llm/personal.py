"""Problem 4: find personal information in free text and replace it with typed placeholders.

Transducers rewrite a text step by step (wide digits and look-alike letters one to one; "(at)", "dot", spelled digits
and line wraps with a change of length), each keeping the places where it changed something, so every match in the
rewritten text is mapped back to its source characters. Identifiers are recognised by the shapes of their numbers.
Names are proposed around words that may be family names, initials and Chinese family names, those that go with no
known person by a hash map of fixed size are dropped, and the others are accepted by a join with the table of known
people, so neither the people nor their names have to fit into one task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .nicknames import beginnings, fulls

KINDS = ("email", "phone", "id", "address", "name")
#: Bits of the maps of the known names' hashes; a hash that several words share costs a row of the join, no result.
BITS = 1 << 22
#: A Chinese family name with a title or a familiar prefix is no full name.
TITLED = "(总|哥|姐|工|董|局|处|经理|主任|老师|工程师|先生|女士|博士|教授)$|^[老小阿]"
HITS = "origin string, record_id string, fact_no int, start_pos int, end_pos int, kind string, family string, givens array<string>, begins array<string>, initial string, sure boolean"

# --- transducers -------------------------------------------------------------------------------------------------

#: Wide forms, and Cyrillic and Greek letters that look like Latin ones; all one to one.
_WIDE = {0xFF10 + i: str(i) for i in range(10)} | {0xFF20: "@", 0xFF0B: "+", 0xFF08: "(", 0xFF09: ")", 0xFF0D: "-", 0xFF0E: ".", 0x3000: " ", 0xA0: " ", 0x202F: " ", 0x2011: "-", 0x2010: "-", 0x2013: "-"}
_ALIKE = dict(zip(map(ord, "аеорсухіјѕАВЕКМНОРСТХοαρν"), "aeopcyxijsABEKMHOPCTXoapv", strict=True))
_ONE_TO_ONE = _WIDE | _ALIKE
_ODD = re.compile(f"[{re.escape(''.join(map(chr, _ONE_TO_ONE)))}]")
#: Digits as words, by language.
DIGIT_WORDS = {
    w: d
    for row in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zero um dois três quatro cinco seis sete oito nove",
    )
    for d, w in enumerate(row.split())
} | {"oh": 0, "zwo": 2, "meia": 6}
_HAN_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "幺": 1, "两": 2}
_DW = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9])(?:{_DW})(?:[ ,;\-]+(?:{_DW})){{4,}}(?![A-Za-zÀ-ÿ0-9])|[零〇幺一二三四五六七八九两][零〇幺一二三四五六七八九两 -]{{5,}}[零〇幺一二三四五六七八九两]", re.I)
_HAN_SPELLED = re.compile("[零〇幺一二三四五六七八九两]{5}")
#: Ends of host names before which the other words for a dot are taken for one.
TLD = "com|net|org|info|eu|de|at|ch|fr|es|pt|br|mx|cn|uk|us|io|co|test|example|invalid"
_DISGUISE = re.compile(
    r"(?P<at>\s*[\[({<]\s*(?:at|arroba|arobase|ät|艾特)\s*[\])}>]\s*|(?<=\w)\s+(?:at|arroba|arobase)\s+(?=[A-Za-z0-9\-]++(?:(?:\s+(?:dot|punto|point|ponto|punkt)\s+|\s*[\[({]\s*(?:dot|punto|point|ponto|punkt)\s*[\])}]\s*|\.)[A-Za-z0-9\-]++)++(?!\s+(?:at|plus|arroba|arobase)\s+\w|\s*[@\[(+_%]))|\s*艾特\s*)"
    r"|(?P<dot>\s*[\[({]\s*(?:dot|punto|point|ponto|punkt|点)\s*[\])}]\s*|(?<=\w)\s+dot\s+(?=\w)|(?<=\w)\s+(?:punto|point|ponto|punkt)\s+(?=(?:" + TLD + r")(?!\w)))"
    r"|(?P<plus>(?<=\w)\s+plus\s+(?=\w+(?:\s+at\s|\s*[\[(@])))"
    r"|(?P<under>(?<=\w)\s+underscore\s+(?=\w))"
    r"|(?P<none>[​‌‍⁠­﻿])",
    re.I,
)
_PUT = {"at": "@", "dot": ".", "plus": "+", "under": "_", "none": ""}


class Rewritten:
    """A text after a transducer, with the way back to the source."""

    def __init__(self, text: str, pattern: re.Pattern, put) -> None:
        out, at, shift = [], 0, 0
        self.to, self.back = [0], [0]  # from place `to` on, source = place - to + back
        for m in pattern.finditer(text):
            new = put(m)
            if new is None:
                continue
            out += [text[at : m.start()], new]
            shift += len(new) - (m.end() - m.start())
            begin = m.start() + shift - len(new) + (m.end() - m.start())
            self.to += [begin, m.end() + shift]
            self.back += [m.start(), m.end()]
            at = m.end()
        self.text = "".join([*out, text[at:]])
        self.edits = {a for a, b in zip(self.to[1::2], self.to[2::2], strict=True)}

    def source(self, place: int) -> int:
        k = bisect_right(self.to, place) - 1
        if k % 2 and k:  # inside a replaced stretch: its start
            return self.back[k]
        return place - self.to[k] + self.back[k]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.source(a), self.source(b - 1) + 1 if (bisect_right(self.to, b - 1) - 1) % 2 == 0 else self.source(b)


def plain(text: str) -> str:
    """text with wide and look-alike characters in plain form, every character in its place."""
    return text if text.isascii() or not _ODD.search(text) else text.translate(_ONE_TO_ONE)


def spelled(text: str) -> Rewritten:
    """text with spelled numbers as digits; pauses become blanks."""

    def put(m: re.Match) -> str:
        x = m[0]
        if x[0] in _HAN_DIGITS:
            return "".join(str(_HAN_DIGITS[c]) for c in x if c in _HAN_DIGITS)
        return "".join(str(DIGIT_WORDS[w]) if w in DIGIT_WORDS else " " if w.strip() != "" and "," in w else "" for w in re.split(rf"({_DW})", x.lower()) if w)

    return Rewritten(text, _SPELLED, put)


def undisguised(text: str) -> Rewritten:
    return Rewritten(text, _DISGUISE, lambda m: _PUT[m.lastgroup])


# --- shapes ------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
#: The shapes of identity numbers (several countries' identity, insurance, tax and passport numbers).
ID = re.compile(
    r"(?<![\w.+\-])(?:"
    r"9\d\d(?P<s>[ \-]?)\d\d(?P=s)\d{4}|(?!000|666)\d{3}(?P<t>[ \-])(?!00)\d\d(?P=t)(?!0000)\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{2}\d{7}|[A-Z]{2}\d{6}[A-Z]|[A-Z]\d{3}[A-Z]\d{4}|[A-Z]\d{2}[A-Z]{2}\d{4}|\d{2}[A-Z]{2}\d{5}"
    r"|\d{2} ?\d{6} ?[A-Z] ?\d{3}"
    r"|[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{6} ?(?:19|20)\d{6} ?\d{3}[\dXx]"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dA-Z]"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r")(?!\w|[.\-]\d)",
    re.A,
)
#: The shapes of phone numbers.
PHONE = re.compile(
    r"(?<![\w+\-/(])(?<!\d[.])(?:"
    r"(?:\+|00(?=[1-9]))\d{1,3}(?:[ .\-/]?\(\d{1,4}\)|[ .\-/]?\d{1,4})(?:[ .\-/]?\d{2,8}){1,5}"
    r"|\(\d{2,5}\)[ \-]?\d{3,5}[ \-]?\d{3,5}|1-\d{3}-\d{3}-\d{4}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|[679]\d{2} \d{3} \d{3}"
    r"|\d{3}(?P<d>[.\-])\d{3}(?P=d)\d{4}|\d{3}-\d{4}|\d{3} \d{3} \d{4}|555 ?\d{4}"
    r"|0\d{4} \d{6}|0\d(?P<f>[ .]?)\d{2}(?:(?P=f)\d{2}){3}|0\d{2,4}[ /\-]\d{5}(?:[ \-]?\d{2,3})|\d{3}(?: \d{2}){3}"
    r"|1\d{10}|1\d{2} \d{4} \d{4}|1\d{2}-\d{4}-\d{4}|0\d{2,3}-\d{7,8}"
    r")(?:,? ?(?:ext\.?|x|Durchwahl|poste|转) ?\d{1,5})?(?!\w|[.\-]\d)",
    re.A,
)
_DIGITS = re.compile(r"\d(?:[ ().\-/A-Z]{0,4}\d){5,}")
#: Words before numbers that are no personal ones.
_IMPERSONAL = re.compile(r"(?:order|invoice|meeting|code|firmware|version|ticket|room|commande|facture|réunion|bestell\w*|rechnung\w*|pedido|factura|fatura|reunión|reunião|订单|发票|会议|版本|编号是)\W*(?:number|numéro|nummer|号|n[º°.])?[ \w]{0,8}$", re.I)
_CAP = r"[A-ZÀ-Þ][\w'’\-]*"
#: The build of postal addresses in the six languages.
ADDRESS = (
    re.compile(
        rf"(?<![A-Za-zÀ-ÿ0-9_])(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Court|Ct\.?|Boulevard|Blvd\.?|Terrace|Ter\.?|Close|Crescent|Way|Place|Square)"
        rf"(?:, (?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?)?(?:, {_CAP}(?: {_CAP}){{0,2}}?(?: [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}})?)?"
    ),
    re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|impasse|quai|allée|chemin|cours|route|sentier|place|avenue|boulevard) [^\n,;]{{2,40}}, \d{{5}} {_CAP}(?: {_CAP})?"),
    re.compile(r"(?<![A-Za-zÀ-ÿ0-9_])(?:[A-ZÄÖÜ][\wäöüß\-]*\.?|der|den|dem)(?: (?:[A-ZÄÖÜ][\wäöüß\-]*\.?|der|den|dem)){0,4} \d{1,4} ?[a-z]?, \d{5} [A-ZÄÖÜ][\wäöüß\-]+(?: [A-ZÄÖÜ][\wäöüß\-]+)?"),
    re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_])(?i:calle|c/|avenida|avda\.|av\.|plaza|paseo|camino) ?[^\n,;]{{2,40}}, \d{{1,4}},(?: ?\d{{1,2}}[ºª°] ?[A-Z]?,)? \d{{5}} {_CAP}(?: {_CAP})?"),
    re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_])(?i:rua|r\.|avenida|av\.|travessa|praça|largo|estrada) ?[^\n,;]{{2,40}}, \d{{1,4}},(?: [^\n,;]{{1,12}},)? \d{{4}}-\d{{3}} {_CAP}(?: {_CAP})?"),
    re.compile(r"(?:[一-鿿]{2}[省市县])?(?:[一-鿿]{2}[市区县]){1,2}[一-鿿]{1,4}?(?:大道|路|街|巷|道|弄)\d{1,5}号(?:\d{1,4}(?:栋|幢|座|号楼|单元))?(?:\d{1,5}(?:室|楼|层|户))?"),
)


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """Phone and identity numbers of a plain text."""
    done = -1
    for m in _DIGITS.finditer(text):
        a, b = max(m.start() - 5, done, 0), min(m.end() + 14, len(text))
        near = a
        while near < m.end():
            got, kind = ID.search(text, near, b), "id"
            tel = PHONE.search(text, near, b)
            if tel and (not got or tel.start() < got.start() or tel.start() == got.start() and tel.end() > got.end()):
                got, kind = tel, "phone"
            if not got or got.start() >= m.end():
                break
            near = done = got.end()
            if not _IMPERSONAL.search(text[max(0, got.start() - 30) : got.start()]):
                yield got.start(), got.end(), kind


#: The words of _DISGUISE, for the hints.
_AT, _DOT = ("at", "arroba", "arobase", "ät", "艾特"), ("dot", "punto", "point", "ponto", "punkt", "点")
_BEHIND_AT = re.compile(rf" *(?:{'|'.join(_AT)})(?: *[\])}}>]| +[A-Za-z0-9\-]+(?: +(?:{'|'.join(_DOT)}) | *[\[({{]|\.[A-Za-z0-9\-]))", re.I)
_BEHIND_DOT = re.compile(rf" *(?:dot +\w|(?:{'|'.join(_DOT)})(?: *[\])}}]| +(?:{TLD})(?!\w)))", re.I)
_BEHIND_PLUS = re.compile(r" *plus +\w+(?: +at | *[\[(@])", re.I)
_PAUSE = " ,;-"
#: A hint that counts at the beginning of a word.
START = "start"
#: What a text with disguised addresses, spelled numbers or postal addresses (by place in ADDRESS) holds.
#: Every match of a pattern holds a hint of its set (in a text with blanks for all white space); a hint that is a
#: pattern counts where it matches, the others everywhere. "digit" hints count three in a row, pauses between them.
HINT_SETS = (
    {f"{x}{w}{y}": ("disguise", _BEHIND_AT) for w in _AT for x in " [({<" for y in " ])}>"},
    {f"{x}{w}{y}": ("disguise", _BEHIND_DOT) for w in _DOT for x in " [({" for y in " ])}"},
    {" plus ": ("disguise", _BEHIND_PLUS)},
    {h: ("disguise", None) for h in (" underscore ", "艾特", *"\u200b\u200c\u200d\u2060\u00ad\ufeff")},
    {f"{x}{w}{y}": ("digit", None) for w in DIGIT_WORDS for x in _PAUSE for y in _PAUSE},
    {h: (1, None) for h in ("rue ", "impasse ", "quai ", "allée ", "chemin ", "cours ", "route ", "sentier ", "place ", "avenue ", "boulevard ")},
    {h: (3, None) for h in ("calle", "c/", "avenida", "avda.", "av.", "plaza", "paseo", "camino")},
    {h: (4, None) for h in ("rua", "avenida", "av.", "travessa", "praça", "largo", "estrada")},
    {"r.": (4, START)},
    {"号": (5, None)},
)
#: What stands at the head of an English address: house number and a capital.
_HOUSE = re.compile(r"\d[A-Za-z]? [A-ZÀ-Þ]")
_SPACE = re.compile(r"[^\S ]")
_LATIN = re.compile("[A-Za-zÀ-ÿ0-9_]")
_POSTCODE = re.compile(r"\d ?[a-z]?, \d{5} ")


class Known(dict):
    """1 for a word that may be a family name, 2 for one that may be a given name several bear, 3 for both, else 0."""

    def __init__(self, maps: tuple[bytes, ...]) -> None:
        self.maps = maps

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = zlib.crc32(fold(word).encode()) % BITS
        self[word] = got = sum(1 << i for i, m in enumerate(self.maps) if m[h >> 3] >> (h & 7) & 1)
        return got


class Pairs:
    """Whether a family name may go with one of these given names, beginnings of one, or an initial."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits
        self.known: dict[tuple, bool] = {}

    def __call__(self, family: str, givens: list[str], begins: list[str], initial: str | None) -> bool:
        key = (family, givens[0] if givens else None, initial)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            asked = (*(f"{family}\t{g}" for g in givens), *(f"{family}\t{g}*" for g in begins), *([f"{family}\t{initial}*"] if initial else ()))
            got = self.known[key] = any(self.bits[h >> 3] >> (h & 7) & 1 for h in (zlib.crc32(x.encode()) % BITS for x in asked))
        return got


def pair_keys(people: DataFrame) -> DataFrame:
    """What Pairs asks for: each person's two names, and the family name with the beginnings of the given one."""
    both = F.concat_ws("\t", "family", "given")
    begins = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.concat("family", F.lit("\t"), F.substring("given", F.lit(1), n), F.lit("*")))
    return people.select(F.explode(F.concat(F.array(both), F.when(F.col("given") != "", begins).otherwise(F.array().cast("array<string>")))).alias("k")).distinct()


class Finder:
    """The words of a text that known names may have, and which of the costlier searches it needs."""

    def __init__(self, maps: tuple[bytes, ...] | list = ()) -> None:
        self.auto, self.known = ahocorasick.Automaton(), Known(tuple(maps)) if maps else None
        both: dict[str, list] = {}
        for hints in HINT_SETS:
            for h, what in hints.items():
                both.setdefault(h, []).append(what)
        for w, what in both.items():
            self.auto.add_word(w, (len(w), tuple(what)))
        self.auto.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, int, int, int, int]], set]:
        """(start, end, kind as in Known, start and end of the word before) of the words, and the hints."""
        known, names, before = self.known, [], (0, 0)
        if known is not None:
            for m in _WORD.finditer(text):
                at = m.span()
                if k := known[m[0]]:
                    names.append((*at, k, *before))
                before = at
        text = _SPACE.sub(" ", plain(text))
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        hints, run, reach = set(), 0, 0
        for last, (n, whats) in self.auto.iter(low):
            for what, more in whats:
                if what == "digit":
                    run = run + 1 if not low[reach : last - n + 2].strip(_PAUSE) else 1
                    reach = last
                    if run > 2:
                        hints.add("spelled")
                elif what not in hints:
                    at = last - n + 1
                    if more is None or more is START and not (at and _LATIN.match(low[at - 1])) or more is not START and more.match(low, at + (low[at] in "[({<")):
                        hints.add(what)
        if _HOUSE.search(text):
            hints.add(0)
        return names, hints


def detect(text: str, hints: set) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every email, phone, identity number and address, in places of the source text."""
    base = plain(text)
    found = []
    if "@" in base:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(base)]
    if "disguise" in hints:
        r = undisguised(base)
        found += [(*r.span(m.start(), m.end()), "email") for m in EMAIL.finditer(r.text)]
    found += numbers(base)
    if "spelled" in hints or not base.isascii() and _HAN_SPELLED.search(base):
        r = spelled(base)
        found += [(*r.span(a, b), "phone" if k == "phone" or b - a < 9 else k) for a, b, k in numbers(r.text)]
    for k in (0, 1, 3, 4, 5):
        if k in hints:
            found += [(m.start(), m.end(), "address") for m in ADDRESS[k].finditer(base)]
    for p in _POSTCODE.finditer(base):
        m = ADDRESS[2].search(base, max(base.rfind("\n", 0, p.start()) + 1, p.start() - 80), p.end() + 40)
        if m and m.start() < p.start() < m.end():
            found.append((m.start(), m.end(), "address"))
    lone = Free(settle(found))
    found += [x for x in wrapped(base) if lone(x[0], x[1])]
    return settle(found)


_WRAP = re.compile(r"(?<![.!?:>。！？：\n\r])\n(?:(?:[>|]|[A-Z]{2,4}>|[一-鿿]{2,3}>)[ \t]?|[ \t])*(?=\S)")


def wrapped(text: str) -> list[tuple[int, int, str]]:
    """Values broken over two lines; the first of them says something besides."""
    out = []
    for m in _WRAP.finditer(text):
        cut = m.start()
        if not cut:
            continue
        mail = text[cut - 1] == "@" or text[m.end()] == "@"
        if not mail and not _JOINT.search(text, max(0, cut - 40), m.end() + 40):
            continue
        a, b = max(text.rfind("\n", 0, cut) + 1, cut - 60), text.find("\n", m.end(), m.end() + 60)
        b = min(len(text), m.end() + 60) if b < 0 else b
        if mail:
            joined, cut = text[a:cut] + text[m.end() : b], cut - a
            out += [(a + x.start(), m.end() + x.end() - cut, "email") for x in EMAIL.finditer(joined) if x.start() < cut < x.end()]
            continue
        if not _SAYS.search(text, a, cut):
            continue
        joined, cut = f"{text[a:cut]} {text[m.end() : b]}", cut - a
        found = [*numbers(joined), *((x.start(), x.end(), "address") for rx in (ADDRESS if "," in joined else ()) for x in rx.finditer(joined))]
        out += [(a + s, m.end() + e - cut - 1, k) for s, e, k in found if s < cut and e > cut + 1 and (k != "address" or "," in joined[s:e])]
    return out


_SAYS = re.compile(r"[^\W\d_]")
_JOINT = re.compile(r"\d")


def settle(found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without overlaps: the longer match first, of equal ones the kind named first in KINDS."""
    kept: list[tuple[int, int, str]] = []
    for a, b, k in sorted(set(found), key=lambda x: (x[0] - x[1], KINDS.index(x[2]), x[0])):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, k))
    return sorted(kept)


# --- names -------------------------------------------------------------------------------------------------------

_MARKS = dict.fromkeys(i for i in range(0x300, 0x370))


def fold(x: str) -> str:
    """A name's letters without case and accents."""
    if x.isascii():
        return x.lower()
    return unicodedata.normalize("NFKD", x.casefold()).translate(_MARKS)


_GAP = r"(?:[ \t_.\-·]{1,3}|,[ \t_]?|[ \t]*,?\n(?:[>|]|[A-Z]{2,4}>|[ \t])*)"
_WORD = re.compile("[A-Za-zÀ-ɏ]{2,40}")
_GIVEN = r"[A-Za-zÀ-ɏ]{2,40}(?:['’\-][A-Za-zÀ-ɏ]{2,40}){0,2}"
#: A given name behind a family name, a family name behind a given one, and what is between a given and a family name.
_AFTER = re.compile(rf"{_GAP}({_GIVEN})(?![A-Za-zÀ-ɏ])")
_NEXT = re.compile("(?:  ?|_)((?:[A-ZÀ-ɏ]['’])?[A-ZÀ-ɏ][A-Za-zÀ-ɏ]{3,39}(?:-[A-ZÀ-ɏ][A-Za-zÀ-ɏ]{2,39})?)")
_BETWEEN = re.compile(rf"{_GAP}(?:[A-Za-zÀ-ÿ]\.?{_GAP})?")
_JOINED = re.compile("(?<![A-Za-zÀ-ɏ])[A-Za-zÀ-ɏ]{1,40}['’\\-]$")
_GIVEN_BEFORE = re.compile(rf"(?<![A-Za-zÀ-ɏ@'’\-])({_GIVEN}){_BETWEEN.pattern}$")
_INITIAL = re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_.@+\-])([A-ZÀ-Þ])(\.[ \t_]?|[ \t_])(?:[A-Z]\.[ \t_]?)?([A-ZÀ-Þ][A-Za-zÀ-ɏ]{{2,40}})(?![A-Za-zÀ-ɏ0-9_@])")
_INITIAL_BEFORE = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_.@+\-])([A-ZÀ-Þ])(?:\.[ \t_]?|[ \t_])$")
_TRAIL = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_.@+\-])([A-ZÀ-Þ][A-Za-zÀ-ɏ]{2,40})(,?[ \t_]{1,2})([A-ZÀ-Þ])\.(?![\w@])")


def around(text: str, words: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, str | None, list[str], list[str], str | None]]:
    """Proposed Latin names: (start, end, family, given names it may be, beginnings of such, initial).

    Family is null where a given name several people bear is enough.
    """
    n = len(text)
    for a, b, k, first, last in words:
        if k & 2 and text[a].isupper() and not (a and (text[a - 1] < "ɐ" and text[a - 1].isalpha() or text[a - 1] == "@")):
            if (m := _NEXT.match(text, b)) and m[1][0].isupper():
                yield a, m.end(), None, [fold(text[a:b])], [], None
        if not k & 1 or b - a < 3 and not text[a].isupper():
            continue
        if a and text[a - 1] in "'’-" and (m := _JOINED.search(text, max(0, a - 42), a)):  # a family name of two parts
            begin = m.start()
            family = fold(text[begin:b]).replace("’", "'")
            if m := _AFTER.match(text, b, min(n, b + 140)):
                yield begin, m.end(1), family, list(fulls(g := fold(m[1]))), beginnings(g), None
            if m := _GIVEN_BEFORE.search(text, max(0, begin - 140), begin):
                yield m.start(1), b, family, list(fulls(g := fold(m[1]))), beginnings(g), None
            if m := _INITIAL_BEFORE.search(text, max(0, begin - 8), begin):
                yield m.start(1), b, family, [], [], fold(m[1])
        if b + 1 < n and text[b] == "-" and text[b + 1].isupper():
            continue  # half of a family name
        family = fold(text[a:b])
        if m := _AFTER.match(text, b, min(n, b + 140)):
            for end in {m.end(1), *(m.start(1) + i for i, c in enumerate(m[1]) if c in "'’-")}:
                g = fold(text[m.start(1) : end])
                yield a, end, family, list(fulls(g)), beginnings(g), None
        if last and not (first and (text[first - 1] == "@" or text[first - 1] < "ɐ" and text[first - 1].isalpha())) and _BETWEEN.fullmatch(text, last, a):
            begin = first
            for _ in range(3):
                g = fold(text[begin:last])
                yield begin, b, family, list(fulls(g)), beginnings(g), None
                if not begin or text[begin - 1] not in "'’-" or not (m := _JOINED.search(text, max(0, begin - 42), begin)):
                    break
                begin = m.start()
    for m in _INITIAL.finditer(text):
        yield m.start(), m.end(), fold(m[3]), [], [], fold(m[1])
    for m in _TRAIL.finditer(text):
        if "," in m[2]:  # Family, G.
            yield m.start(), m.end(), fold(m[1]), [], [], fold(m[3])


_REST = re.compile("[ 　]?([一-鿿]{1,3})")


def chinese(text: str, families: re.Pattern | None) -> Iterator[tuple[int, int, str]]:
    """Proposed Chinese names of two to four characters, the family name perhaps set apart."""
    if families is None or text.isascii():
        return
    for m in families.finditer(text):
        a = m.start()
        rest = _REST.match(text, a + 1)
        for n in range(1, len(rest[1]) + 1):
            yield a, rest.start(1) + n, text[a] + rest[1][:n]


def people_of(participants: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Known people: (family, given), Chinese ones as (whole name, '')."""
    names = (
        participants.select(F.explode(F.split(F.coalesce("participants", F.lit("")), "[,;、，；]")).alias("n"))
        .unionByName(knowledge.where("entity_type = 'person' and name is not null and name not rlike '^[一-鿿]{1,2}$'").select(F.col("name").alias("n")))
        .select(F.trim(F.regexp_replace("n", r"(?U)\s+", " ")).alias("n"))
        .distinct()
    )
    runtime.ship(participants.sparkSession)
    fold_udf = F.pandas_udf(lambda s: s.map(fold), "string")
    latin = names.where(F.col("n").rlike(r"^(?U)[\p{L}'’\-]{2,}( \p{Lu}\.)? [\p{L}'’\-]{2,}$") & ~F.col("n").rlike("[一-鿿]")).select(
        F.element_at(F.split("n", " "), -1).alias("family"), F.element_at(F.split("n", " "), 1).alias("given")
    )
    han = names.select(F.regexp_replace("n", " ", "").alias("n")).where(F.col("n").rlike("^[一-鿿]{2,4}$") & ~F.col("n").rlike(TITLED)).select(F.col("n").alias("family"), F.lit("").alias("given"))
    return latin.select(F.translate(fold_udf("family"), "’", "'").alias("family"), fold_udf("given").alias("given")).unionByName(han).distinct()


def bitmap(words: DataFrame) -> bytes:
    """Which hashes the words of a one-column table have; of fixed size however many they are."""
    out = bytearray(BITS // 8)
    for h in words.select(F.pmod(F.crc32(F.encode(words.columns[0], "utf-8")), F.lit(BITS)).cast("int").alias("h")).distinct().toPandas().h:
        out[h >> 3] |= 1 << (h & 7)
    return bytes(out)


def mentions(records: DataFrame, people: DataFrame) -> DataFrame:
    """One row per mention: origin, record_id, fact_no, start_pos, end_pos, kind (0-based, end exclusive).

    Takes origin, record_id, fact_no and text, whole texts however long; other columns are ignored. Null and empty
    texts have no mention. Of overlapping mentions the identifier wins over the name, the longer name over the
    shorter. Equal texts under several ids are each reported.
    """
    people = runtime.stored(people.distinct(), "p4-people")
    borne = people.where("given != ''").groupBy("given").agg(F.count("*").alias("n")).where("n > 1").select("given")
    families = people.where("given != ''").select("family")
    last = families.select(F.regexp_extract("family", r"[^'\-]*$", 0))  # by which a family name of two parts is met
    maps = (bitmap(families.union(last)), bitmap(borne))
    fitting = Pairs(bitmap(pair_keys(people)))
    han = {r.c for r in people.where("given = ''").select(F.substring("family", 1, 1).alias("c")).distinct().collect()}
    families = re.compile(f"[{re.escape(''.join(sorted(han)))}](?=[ 　]?[一-鿿])") if han else None

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(maps)
        for p in parts:
            rows = []
            for origin, rid, no, text in zip(p.origin, p.record_id, p.fact_no, p.text, strict=True):
                words, hints = finder.scan(text)
                hits = detect(text, hints)
                rows += [(origin, rid, no, a, b, k, None, None, None, None, True) for a, b, k in hits]
                free = Free(hits)
                rows += [(origin, rid, no, a, b, "name", f, g, h, i, False) for a, b, f, g, h, i in around(text, words) if (f is None or fitting(f, g, h, i)) and free(a, b)]
                rows += [(origin, rid, no, a, b, "name", f, [""], [], None, False) for a, b, f in chinese(text, families) if fitting(f, [""], [], None) and free(a, b)]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "fact_no", "start_pos", "end_pos", "kind", "family", "givens", "begins", "initial", "sure"])

    found = runtime.stored(
        runtime.spread(records.select("origin", "record_id", "fact_no", "text").where(F.length("text") > 0), "record_id", "fact_no").mapInPandas(look, HITS), "p4-hits"
    )
    place = ["origin", "record_id", "fact_no", "start_pos", "end_pos", "kind"]
    known = found.where("not sure").join(
        people.withColumnRenamed("family", "f"),
        (F.col("family") == F.col("f")) & (F.array_contains("givens", F.col("given")) | F.expr("exists(begins, x -> startswith(given, x) and length(given) > length(x))") | F.col("given").startswith(F.col("initial"))),
        "leftsemi",
    )
    alone = found.where("not sure and family is null").withColumn("g", F.col("givens")[0])
    names = alone.join(borne, F.col("g") == F.col("given"), "leftsemi").select(*place).unionByName(known.select(*place))
    return found.where("sure and kind != 'name'").select(*place).unionByName(longest(names))


def longest(names: DataFrame) -> DataFrame:
    """Names without overlaps: from the left, of those that begin at one place the longest.

    A task holds the places of one text's names at a time.
    """
    place = ["origin", "record_id", "fact_no"]

    @F.pandas_udf("array<struct<start_pos int, end_pos int>>")
    def kept(s: pd.Series) -> pd.Series:
        def fold_left(spans) -> list[dict]:
            out, reach = [], 0
            for x in spans:
                if x["start_pos"] >= reach:
                    reach = -x["neg_end"]
                    out.append({"start_pos": x["start_pos"], "end_pos": reach})
            return out

        return s.map(fold_left)

    spans = names.groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("start_pos", (-F.col("end_pos")).alias("neg_end")))).alias("spans"))
    return spans.select(*place, F.explode(kept("spans")).alias("k")).select(*place, "k.start_pos", "k.end_pos", F.lit("name").alias("kind"))


class Free:
    """Whether a stretch is free of given ones."""

    def __init__(self, taken: list[tuple[int, int, str]]) -> None:
        self.starts, self.ends = [a for a, _, _ in taken], [b for _, b, _ in taken]

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return (k < 0 or self.ends[k] <= a) and (k + 1 >= len(self.starts) or self.starts[k + 1] >= b)


def redacted(records: DataFrame, found: DataFrame) -> DataFrame:
    """origin, record_id, fact_no, text with every mention replaced by [KIND], and the number of mentions."""
    runtime.ship(records.sparkSession)

    @F.pandas_udf("string")
    def put(text: pd.Series, spots: pd.Series) -> pd.Series:
        def one(t: str, places) -> str:
            out, at = [], 0
            for x in places:
                out += [t[at : x["start_pos"]], f"[{x['kind'].upper()}]"]
                at = x["end_pos"]
            return "".join([*out, t[at:]])

        return pd.Series([one(*x) for x in zip(text, spots, strict=True)], dtype=object)

    spots = found.groupBy("origin", "record_id", "fact_no").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spots"))
    joined = records.select("origin", "record_id", "fact_no", "text").join(spots, ["origin", "record_id", "fact_no"], "left")
    none = F.col("spots").isNull() | F.col("text").isNull()
    changed = joined.where(~none).select("origin", "record_id", "fact_no", put("text", "spots").alias("text"), F.size("spots").alias("mentions"))
    return joined.where(none).select("origin", "record_id", "fact_no", "text", F.lit(0).alias("mentions")).unionByName(changed)
