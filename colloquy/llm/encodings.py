"""Problem 5: find lines that were read with a wrong character encoding, and restore them.

Best-first search. A state is a text; an edge writes it in one encoding and reads it in another, or undoes an
escape. The cost of a state is the code length of its characters under a bigram model of clean text, counted over all
documents (plus a price for every edge on the way); the cheapest open state is taken next, states seen before are
skipped by hash, and the search ends with a state that has no unusual word left, or when all open states cost more
than the line itself. Letters of a script the documents lack cost what a letter of that script costs among its like,
so a text in it is left alone. Characters that a wrong reading destroyed (U+FFFD, question marks in place of letters)
cannot be restored, their lines are reported nevertheless.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

REPAIR = "origin string, record_id string, line_no int, original string, restored string, steps string, complete boolean"
#: (read as, really), and the price of the edge; utf-8 is what is misread most.
SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250")
EDGES = (
    [(x, "utf-8", 2.0) for x in (*SINGLE, "gb18030", "big5", "cp932", "cp949")]
    + [(x, y, 9.0) for x in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") for y in ("gb18030", "big5")]
    + [("big5hkscs", "gb18030", 9.0), ("cp949", "gb18030", 9.0), ("cp932", "gb18030", 9.0), ("gb18030", "big5", 9.0), ("gb18030", "cp1252", 9.0)]
    + [(x, y, 8.0) for x in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251") for y in ("cp1252", "mac_roman", "cp437", "cp850") if x != y]
)
#: The edges after these, between one-byte encodings, are only taken first.
WIDE = len(EDGES) - sum(x in SINGLE and y not in ("utf-8", "gb18030", "big5") for x, y, _ in EDGES)
#: Most edges on one path.
DEPTH = 3
#: What a second step that is no writing as UTF-8 costs besides.
AGAIN = 10.0
#: A restored text must be shorter by so many nats than the line as it is.
GAIN = 4.0
#: And by this part of its unusual words' code length.
RATIO = 0.9
#: Pairs of characters are kept that make up so large a share of all, or occur twice if that is more: five million at most.
SHARE = 2e-7
#: Code length of a character from which on a stretch of Chinese is unusual.
HAN_ODD = 7.0
#: Replacement characters, their own misreading, bytes left as they are, private characters but those of symbol fonts.
_GONE = re.compile("�|锟斤|斤拷|[\x80-\x9f]|[\ue000-\uefff\uf100-\uf8ff]")
#: Question marks in place of letters: twice within words, several at once beside letters, at the head of a line or alone.
_MARKED = re.compile(r"(?<=[^\W\d_])\?(?=[a-zà-ÿ])")
_MARKS = re.compile(r"(?<!\S)\?{2,}(?=[^\W\d_])|(?<=[^\W\d_])\?{2,}(?=[a-zà-ÿ])|^\s*\?{2,}(?:[:：]|\s+[a-zà-ÿ0-9])|^\s*\?{4,}\s*$|(?<=\s)\?{4,}(?=\s+[a-zà-ÿ0-9])|\?{2,}[，。！、：；]\?{2,}")
#: Punctuation and signs a clean text may hold though the sample lacks them.
TYPOGRAPHIC = frozenset("“”‘’„‚–—…•·«»€£°≈×→☎✓′″♪、。《》「」【】（）！？；：，")
_INSIDE = re.compile(r"(?<=[A-Za-zÀ-ÿ])[一-鿿]{1,3}(?=[A-Za-zÀ-ÿ])|(?<![一-鿿A-Za-zÀ-ÿ])[一-鿿]{1,2}(?=[a-zà-ÿ])")  # Chinese as part of a Latin word
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\ue000-\ufaff\uff00-\uffef]")
_NARROW = re.compile("[\x80-\u2e7f]")
_HAN = re.compile("[一-鿿]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Further scripts (first and last character, letters in use), and the letters of the alphabets in use.
SCRIPTS = (("Ͱ", "Ͽ", 50), ("Ѐ", "ԯ", 33), ("԰", "֏", 39), ("֐", "׿", 27), ("؀", "ۿ", 36), ("ऀ", "෿", 60), ("฀", "໿", 60), ("Ⴀ", "ჿ", 33), ("぀", "ヿ", 90), ("가", "힣", 2000))
_ALPHABET = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў" "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ")
_ESCAPE = re.compile(r"&#?\w{2,8};|\\u[0-9a-fA-F]{4}|=[0-9A-F]{2}=[0-9A-F]{2}")


def _fill_gaps(e: UnicodeError):
    """Bytes and characters an encoding leaves undefined stand for themselves, as lenient readers treat them."""
    if isinstance(e, UnicodeEncodeError):
        part = e.object[e.start : e.end]
        if all("\x80" <= c <= "\x9f" for c in part):
            return bytes(map(ord, part)), e.end
    raise e


#: The characters of one-byte encodings that stand for bytes past ASCII, and for those that go on a sequence.
_BYTES = {
    x: tuple(frozenset(c for b in part if (c := bytes([b]).decode(x, "ignore") or chr(b)) >= "\x80") for part in (range(0x80, 0x100), range(0x80, 0xC0)))
    for x in SINGLE
}


codecs.register_error("colloquy-gaps", _fill_gaps)


class Plausibility:
    """Character bigram model of clean text; cost is in nats."""

    BACK = 4.0

    def __init__(self, single: dict[str, int], pairs: dict[str, int]):
        self.single, self.pairs = single, pairs
        self.total = sum(single.values()) + 1
        self.memo: dict[str, float] = {}
        self.words: dict[str, bool] = {}
        self.paths: dict[str, tuple[str, ...]] = {}

    def __reduce__(self):
        return Plausibility, (self.single, self.pairs)

    def unseen(self, c: str) -> float:
        """Code length of a character the sample lacks; common Chinese comes first in the national standard."""
        if c in TYPOGRAPHIC:
            return 6.5
        if "一" <= c <= "鿿":
            try:
                return 8.5 if c.encode("gb2312")[0] < 0xD8 else 11.0
            except UnicodeError:
                return 13.5
        if c == "�":
            return 22.0
        if "\x80" <= c <= "\x9f":
            return 8.0  # bytes of a text that is still to be read
        kind = unicodedata.category(c)
        if kind in ("Cc", "Co", "Cn", "Cs"):
            return 25.0
        return 10.0 if "À" <= c <= "ÿ" or kind[0] in "SP" else 13.0

    def bigram(self, p: str) -> float:
        got = self.memo.get(p)
        if got is None:
            n = self.single.get(p[1], 0)
            alone = n / self.total if n else math.exp(-self.unseen(p[1]))
            got = -math.log((self.pairs.get(p, 0) + self.BACK * alone) / (self.single.get(p[0], 0) + self.BACK))
            got = min(got, self.unseen(p[1]) + (1.5 if "一" <= p[1] <= "鿿" else 6.0), among_its_like(p))
            if len(self.memo) < 500_000:
                self.memo[p] = got
        return got

    def cost(self, text: str) -> float:
        bits = sum(map(self.bigram, map("".join, zip(" " + text, text, strict=False))))
        return bits + 10.0 * len(_INSIDE.findall(text))

    def unusual(self, word: str) -> bool:
        """Whether a word past ASCII has a pair of characters no document has, or Chinese that hardly any has."""
        got = self.words.get(word)
        if got is None:
            got = any((c >= "\x80" or d >= "\x80") and c + d not in self.pairs and not beside(c, d) for c, d in pairwise(f" {word} "))
            if not got and (han := "".join(_HAN.findall(word))):
                got = self.cost(han) > HAN_ODD * (len(han) + 1)
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = got
        return got


#: What stands beside any other character.
_PLAIN = TYPOGRAPHIC | frozenset(chr(i) for i in range(128) if not chr(i).isalpha())
_LOW = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")
_UP = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")


def beside(c: str, d: str) -> bool:
    """Whether two characters may stand side by side though no document has them so."""
    if "一" <= c <= "鿿":
        return d in _PLAIN or not d.isascii() and d not in _LOW
    if "一" <= d <= "鿿":
        return c in _PLAIN or not c.isascii() and c not in _LOW
    if c == " " or c in "¡¿«“‘„" and (d in _UP or d in _LOW):
        return True
    if c >= "\x80" and d >= "\x80" and (c in _PLAIN) != (d in _PLAIN):
        return False  # a sign beside an accented letter
    if c in _PLAIN:
        return d in _PLAIN or d in _LOW or d in _UP
    return c in _LOW and (d in _LOW or d in _PLAIN) or c in _UP and (d in _UP or d in _LOW or d in _PLAIN)


def among_its_like(p: str) -> float:
    """Code length of the second of two letters of one script that the documents may lack; mixed cases are no words."""
    if "À" <= p[1] <= "ɏ" and p[1].isalpha():
        return (8.0 if p[1] <= "ÿ" else 9.5) + (5.0 if p[1].isupper() and p[0].islower() else 0.0) if p[0].isalpha() and p[0] <= "ɏ" else 99.0
    for first, last, n in SCRIPTS:
        if first <= p[1] <= last:
            if not p[1].isalpha() or not (p[0] == " " or first <= p[0] <= last and p[0].isalpha()):
                return 99.0
            case = 5.0 if p[1].isupper() and p[0].islower() else 1.0 if p[1].isupper() else 0.0
            return math.log(n) + case + (0.0 if first > "ԯ" or p[1].lower() in _ALPHABET else 5.0) + (3.0 if p[0] == " " else 0.0)
    return 99.0


def recode(part: str, wrong: str, right: str, strict: bool) -> str:
    """part as it reads in the right encoding; unchanged if it cannot have been read in the wrong one."""
    if part.isascii() or "�" in part:
        return part
    try:
        raw = part.encode(wrong, "colloquy-gaps")
        return raw.decode(right) if strict else raw.decode(right, "replace")
    except (UnicodeError, LookupError):
        return part


@lru_cache(None)
def stretches(wrong: str) -> re.Pattern:
    """Stretches of characters a one-byte encoding has, at least one of them past ASCII."""
    known = re.escape("".join(sorted(_BYTES[wrong][0])))
    return re.compile(f"[\x00-\x7f]*[{known}][\x00-\x7f{known}]*")


_encodable: dict[str, dict[str, bool]] = {}


def piecewise(text: str, wrong: str, right: str) -> str:
    """text with every stretch that can have been read in the wrong encoding as it reads in the right one."""
    if wrong in SINGLE:
        return stretches(wrong).sub(lambda m: recode(m[0], wrong, right, False), text)
    known, out, part, high = _encodable.setdefault(wrong, {}), [], [], False
    for c in (*text, None):
        if c is not None and c >= "\x80":
            fits = known.get(c)
            if fits is None:
                fits = known[c] = c != "�" and encodable(c, wrong)
            if fits:
                high = True
                part.append(c)
                continue
        elif c is not None:
            part.append(c)
            continue
        out.append(recode(x, wrong, right, False) if high and (x := "".join(part)) else "".join(part))
        part, high = [], False
        if c is not None:
            out.append(c)
    return "".join(out)


def encodable(c: str, wrong: str) -> bool:
    try:
        c.encode(wrong)
    except UnicodeError:
        return False
    return True


def take(text: str, step: str) -> str:
    """text after one step: an edge's name, or one ending in + for whole stretches instead of single runs."""
    if step == "unescape":
        x = html.unescape(text)
        x = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x)
        return re.sub(r"(?:=[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("=", "")).decode("utf-8", "replace"), x)
    wrong, right = step.rstrip("+").split(">")
    if step[-1] != "+":
        return _HIGH.sub(lambda m: recode(m[0], wrong, right, True), text)
    whole = recode(text, wrong, right, True)
    return whole if whole != text else piecewise(text, wrong, right)


_HALF = re.compile("[\uff61-\uff9f]")
_HANGUL = re.compile("[\uac00-\ud7a3]")


def neighbours(text: str, first: bool = True) -> Iterator[tuple[str, float, str]]:
    if _ESCAPE.search(text):
        yield take(text, "unescape"), 1.0, "unescape"
    if text.isascii():
        return
    wide, high = _WIDE.search(text) is not None, {c for c in text if c >= "\x80"}
    signs = {"cp932": wide and _HALF.search(text) is not None, "cp949": wide and _HANGUL.search(text) is not None}
    for wrong, right, price in EDGES if first else EDGES[:WIDE]:
        if wrong in SINGLE:
            known, tails = _BYTES[wrong]
            if high.isdisjoint(known) or right == "utf-8" and high.isdisjoint(tails):
                continue  # no character, or no sequence, of such a reading
        elif not signs.get(wrong, wide):
            continue
        one = take(text, f"{wrong}>{right}")
        if one != text:
            yield one, price, f"{wrong}>{right}"
        if right != "utf-8" or wrong not in SINGLE or one == text:  # else every character is a run of its own
            whole = take(text, f"{wrong}>{right}+")
            if whole not in (text, one):
                yield whole, price, f"{wrong}>{right}+"


def right_of(step: str) -> str:
    return step.rstrip("+").split(">")[-1]


def search(text: str, model: Plausibility) -> tuple[str, ...]:
    """The steps to the cheapest text reachable, none if nothing is cheaper by GAIN and RATIO."""
    start = model.cost(text)
    best = (min(start - GAIN, start * RATIO), ())
    heap, seen = [(start, 0.0, text, ())], {hash(text)}
    while heap:
        cost, paid, text, path = heapq.heappop(heap)
        if cost < best[0]:
            best = (cost, path)
            if not odd_words(text, model):
                break  # clean, and all that is open costs more
        if len(path) == DEPTH or cost > start:
            continue
        for x, price, step in neighbours(text, not path):
            h = hash(x)
            if h not in seen:
                seen.add(h)
                if x.count("�") > text.count("�") + len(x) // 6 + 1:
                    continue  # no reading of the text
                price += AGAIN if path and right_of(step) != "utf-8" else 0.0
                heapq.heappush(heap, (model.cost(x) + paid + price, paid + price, x, (*path, step)))
    return best[1]


def odd_words(text: str, model: Plausibility) -> list[str]:
    """The words of a text that are to be looked at: unusual ones, and escapes."""
    return [w for w in text.split(" ") if (not w.isascii() and model.unusual(w)) or _ESCAPE.search(w)]


def lost(text: str) -> bool:
    """Whether a text has marks of destroyed characters."""
    if not text.isascii() and _GONE.search(text):
        return True
    return "?" in text and (len(_MARKED.findall(text)) > 1 or _MARKS.search(text) is not None) and "://" not in text


def affected(line: str, model: Plausibility) -> tuple[str, str, bool] | None:
    """(restored, steps, complete) of a line altered by a wrong reading, None of any other line."""
    if line.isascii() and "?" not in line and not _ESCAPE.search(line):
        return None
    text, odd, known = line, " ".join(odd_words(line, model)), model.paths
    steps: tuple[str, ...] = ()
    if odd:
        if odd not in known:
            if len(known) > 100_000:
                known.clear()
            known[odd] = search(odd, model)
        steps = known[odd]
        for step in steps:
            text = take(text, step)
    gone = lost(text)
    return (text, " ".join(steps), not gone) if steps or gone else None


def mended(text: str, model: Plausibility, share: float = 0.0) -> str:
    """text with every altered line restored as far as possible, of lines with at least ``share`` characters past ASCII."""
    if text.isascii():
        return text
    return "\n".join(got[0] if len(_HIGH.sub("", line)) <= (1 - share) * len(line) and (got := affected(line, model)) else line for line in text.split("\n"))


def model_of(docs: DataFrame) -> Plausibility:
    """Model of the pairs of characters in all documents; a line break counts as a blank.

    What is collected is bounded by SHARE, however many documents there are.
    """
    runtime.ship(docs.sparkSession)
    pairs = runtime.stored(
        docs.select("text").where(F.length("text") > 0).mapInPandas(paired, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "p5-pairs"
    )
    total = pairs.agg(F.sum("n")).first()[0] or 0
    single, kept = Counter(), {}
    for r in pairs.groupBy((F.col("pair") % (1 << 21)).alias("c")).agg(F.sum("n").alias("n")).toPandas().itertuples():
        single[chr(r.c)] = int(r.n)
    for r in pairs.where(F.col("n") >= max(2, int(SHARE * total))).toPandas().itertuples():
        kept[chr(r.pair >> 21) + chr(r.pair & 0x1FFFFF)] = int(r.n)
    return Plausibility(dict(single), kept)


def paired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pair, n): the pairs of neighbouring characters in a partition's texts, as first * 2**21 + second."""
    low, wide = np.zeros(1 << 20, dtype=np.int64), Counter()

    def count(texts: list[str]) -> None:
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        codes[codes == 10] = 32
        a, b = codes[:-1], codes[1:]
        near = (a < 1024) & (b < 1024)
        low[:] += np.bincount(a[near] << 10 | b[near], minlength=1 << 20)
        found, n = np.unique(a[~near] << 21 | b[~near], return_counts=True)
        wide.update(dict(zip(found.tolist(), n.tolist(), strict=True)))

    some, size = [], 0
    for text in (x for p in parts for x in p.text):
        some.append(text)
        size += len(text)
        if size > 2_000_000:
            count(some)
            some, size = [], 0
    count(some)
    at = np.flatnonzero(low)
    yield pd.DataFrame({"pair": (at >> 10) << 21 | at & 1023, "n": low[at]})
    yield pd.DataFrame({"pair": list(wide.keys()), "n": list(wide.values())}, dtype="int64")


def repairs(records: DataFrame, model: Plausibility) -> DataFrame:
    """One row per altered line (first line 1, cut at newlines), with the restored text and the steps.

    Takes origin, record_id and text; other columns are ignored. Null and empty texts have no such line.
    ``complete`` is false where characters were destroyed. Every line of every text is looked at.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for origin, rid, text in zip(p.origin, p.record_id, p.text, strict=True):
                for k, line in enumerate(text.split("\n"), 1):
                    if (got := affected(line, shared.value)) is not None:
                        rows.append((origin, rid, k, line, *got))
            yield pd.DataFrame(rows, columns=["origin", "record_id", "line_no", "original", "restored", "steps", "complete"])

    return runtime.spread(records.select("origin", "record_id", "text").where(F.length("text") > 0), "record_id").mapInPandas(lines, REPAIR)
