"""Problem 3: the language of every record and of every passage of a mixed one, with a confidence.

Hyperdimensional profiles. Every letter has a random +-1 vector; an n-gram's vector is the product (binding) of its
letters' vectors, each rolled (permuted) by its place; a text's vector is the sum (bundle) of its n-grams. A
language's prototype is the bundle of its labelled lines, centred, retrained on the lines it got wrong and brought to
length 1. Lines are compared with the prototypes by cosine; a line's evidence is its cosines times its length, so a
long line says more than a short one. A scale fitted on the labelled lines turns evidence into log probabilities, and
Viterbi over the lines of a record, with a cost for every switch, gives the runs.

Bundling is linear, so a word's products with the prototypes are kept and looked up; n-grams are next to orthogonal,
so a line's length is that of its words' weights (n-grams that words share, but for the script's, are not counted).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import encodings

LANGS = ("en", "zh", "fr", "de", "es", "pt")
#: English language names, as they occur as labels.
NAMED = {"english": "en", "chinese": "zh", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt"}
DIM = 2048
#: Most labelled documents the prototypes are fitted on, chosen by a hash of their id.
TRAIN_DOCS = 800
#: Share of characters past ASCII from which on a misread line has lost the look of its language and is restored first.
MISREAD = 0.3
#: Log odds that a line keeps the language of the line before.
STAY = 4.5
RUN = "origin string, record_id string, first_line int, last_line int, lang string, confidence double, n_langs int, given string"

_STAMP = r"[\[(（【<]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])）】>]?"
_TIMES = re.compile(rf"{_STAMP}(?:\s*-->\s*{_STAMP})?")
_MARKS = re.compile(r"<[^>\n]{0,80}>|[\[(（【*♪][^\])）】*♪\n]{0,30}[\])）】*♪]")
_SIGNS = re.compile(r"[<\[(（【*♪@\d]|www|http")
_PART = r"[A-Za-z0-9._%+\-]+"
_ADDRESSES = re.compile(rf"{_PART}@{_PART}|https?://[!-~]+|www\.[!-~]+|[A-Za-z0-9._%+\-]*\d{_PART}|\d")
_SPOKEN = re.compile(rf"{_PART}(?:\s*(?:\b(?:dot|at|plus|underscore)\b|[\[(](?:at|dot)[\])])\s*{_PART})+")
_QUOTE = re.compile(r"^(?:\s*(?:[>|]|[A-Z]{1,4}>|[一-鿿]{1,4}>))+")
_LABEL = re.compile(r"^\s*(?:[^\W\d][\w.'’\-]*[,、]?\s?){1,4}(?:\s?[\[(（][^\])）]{1,14}[\])）])?\s*(?:[:：]|\s-\s)")
#: Field names of mail headers in the six languages.
HEADERS = (
    "from to cc bcc subject date sent reply-to von an betreff datum gesendet de à a objet envoyé para asunto fecha "
    "assunto data enviado enviada copie cópia copia kopie 发件人 收件人 抄送 主题 日期 发送时间"
).split()
_HEADER = re.compile(rf"^[>\s]*(?:{'|'.join(map(re.escape, HEADERS))})\s*[:：]", re.I)
_TURN = re.compile(rf"^\s*\S+(?: \S+){{0,3}}\s+{_STAMP}\s*$")
_FULL = re.compile("[。！？，：；、]")
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*")
#: Hesitation sounds of the six languages; they say nothing of a line's language.
FILLERS = set("er uh um uhm hm hmm mm äh ähm öh euh ben bah hum eh este pues ahn né hã hein ah oh 嗯 呃 啊 唔".split())


def grams(word: str) -> list[str]:
    """n-grams of a word in lower case; a Han character also counts as one of its script."""
    if "㐀" <= word <= "鿿":
        return [word, "一一"]
    w = f" {word.lower()} "
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + ([w] if len(w) > 4 else [])


def words(line: str) -> list[tuple[str, float]]:
    """Words of a line that bear on its language, with their weight: capitals inside a line are likely names."""
    if ">" in line[:8] or "|" in line[:4]:
        line = _QUOTE.sub("", line)
    if _HEADER.match(line) or line.startswith("WEBVTT") or _TURN.match(line):
        return []
    if ":" in line:
        line = _TIMES.sub(" ", line)
    if " dot " in line or "(at)" in line or "[at]" in line:
        line = _SPOKEN.sub(" ", line)
    if _SIGNS.search(line):
        line = _ADDRESSES.sub(" ", _MARKS.sub(" ", line))
    head = line[:70]
    m = _LABEL.match(line) if ":" in head or "：" in head or " - " in head else None
    if m:  # a label of lower-case words may be a clause; then it stays
        head = line[: m.end()]
        if re.search(r"[A-ZÀ-Þ㐀-鿿]", head) or "  " in head or " :" in head:
            line = line[m.end() :]
    found = _WORD.findall(line)
    han = low = loud = 0
    for w in found:
        if "㐀" <= w <= "鿿":
            han += 1
        elif len(w) > 1:
            if w.islower():
                low += 1
            elif w.isupper():
                loud += 1
    named = han and (low >= 3 and 3 * low >= han or not _FULL.search(line))  # Chinese names and firms, no sentence
    shout = loud > 0.6 * len(found)
    out, first, of_han = [], True, 0.03 if named else 1.0
    for w in found:
        if "㐀" <= w <= "鿿":
            if w not in FILLERS:
                out.append((w, of_han))
                first = False
        elif w.lower() not in FILLERS:
            out.append((w, 0.15 if not first and not shout and w[0].isupper() else 1.0))
            first = False
    if out and not shout and not low:  # names, firms, a title
        out = [(w, min(k, 0.15)) if w[0].isupper() else (w, k) for w, k in out]
    return out


class Profiles:
    """Prototypes of the languages, and the products of words with them."""

    def __init__(self, protos: np.ndarray, scale: float, seed: int, known: tuple[list[str], np.ndarray] | None = None):
        self.protos, self.scale, self.seed = protos, scale, seed
        self.letters: dict[tuple[str, int], np.ndarray] = {}
        self.known = known  # the n-grams of the labelled lines and their products, so no worker computes them again
        self.known_grams: dict[str, np.ndarray] = dict(zip(*known, strict=True)) if known else {}
        self.forget()

    def forget(self) -> None:
        """Empty the table of words: row of each, and its products."""
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, len(LANGS)), dtype=np.float32)

    def __reduce__(self):
        return Profiles, (self.protos, self.scale, self.seed, self.known)

    def letter(self, c: str, place: int = 0) -> np.ndarray:
        if (c, place) not in self.letters:
            if place:
                v = np.roll(self.letter(c), place)
            else:
                v = np.random.default_rng([self.seed, ord(c)]).choice(np.array([-1, 1], dtype=np.int8), DIM)
            self.letters[c, place] = v
        return self.letters[c, place]

    def vector(self, gram: str) -> np.ndarray:
        v, n = self.letter(gram[-1]), len(gram)
        for i in range(n - 1):
            v = v * self.letter(gram[i], n - 1 - i)
        return v

    def gram(self, g: str) -> np.ndarray:
        got = self.known_grams.get(g)
        if got is None:
            if len(self.known_grams) > 500_000:
                self.known_grams = dict(zip(*self.known, strict=True)) if self.known else {}
            got = self.known_grams[g] = self.protos @ self.vector(g)
        return got

    def row(self, w: str) -> int:
        got = self.rows.get(w)
        if got is None:
            got = self.rows[w] = len(self.rows)
            if got == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            gs = grams(w)
            self.table[got] = sum(map(self.gram, gs)) / math.sqrt(len(gs))
        return got

    def cosines(self, line: str) -> tuple[np.ndarray, float] | None:
        """The line's cosines with the prototypes, and its length; None of a line without language."""
        ws = words(line)
        if not ws:
            return None
        if len(self.rows) + len(ws) > 200_000:
            self.forget()
        rows = [self.row(w) for w, _ in ws]  # may replace the table
        weights = np.array([k for _, k in ws], dtype=np.float32)
        han = [k for w, k in ws if "㐀" <= w <= "鿿"]  # these share an n-gram, their script's
        length = math.sqrt(DIM * (float(weights @ weights) - sum(k * k for k in han) / 2 + sum(han) ** 2 / 2))
        return (weights @ self.table[rows]) / length, length

    def evidence(self, line: str) -> np.ndarray | None:
        got = self.cosines(line)
        return None if got is None else got[0] * got[1] / math.sqrt(DIM)


def train(lines: list[tuple[str, str]], seed: int = 7, epochs: int = 6) -> Profiles:
    """Prototypes from (line, language) pairs, in the order given."""
    counts: dict[str, Counter] = {x: Counter() for x in LANGS}
    rows = []
    for line, lang in lines:
        ws = words(line)
        if ws and lang in counts:
            c: Counter = Counter()
            for w, k in ws:
                gs = grams(w)
                for g in gs:
                    c[g] += k / math.sqrt(len(gs))
            counts[lang].update(c)
            rows.append((c, LANGS.index(lang)))
    p = Profiles(np.zeros((len(LANGS), DIM), dtype=np.float32), 1.0, seed)
    vocabulary = {g: i for i, g in enumerate(sorted({g for c in counts.values() for g, n in c.items() if n >= 1}))}
    if not vocabulary:
        return p
    vectors = np.stack([p.vector(g) for g in vocabulary]).astype(np.float32)
    bundle = np.zeros((len(LANGS), len(vocabulary)), dtype=np.float32)
    for k, lang in enumerate(LANGS):
        n = sum(counts[lang].values()) or 1
        for g, c in counts[lang].items():
            if g in vocabulary:
                bundle[k, vocabulary[g]] = math.sqrt(c / n)
    protos = bundle @ vectors
    protos -= protos.mean(axis=0)
    protos /= np.linalg.norm(protos, axis=1, keepdims=True) + 1e-9
    protos *= math.sqrt(DIM) / DIM
    sample = [(np.array([vocabulary[g] for g in c if g in vocabulary]), np.array([n for g, n in c.items() if g in vocabulary], dtype=np.float32), y) for c, y in rows]
    sample = [x for x in sample if len(x[0])]
    for _ in range(epochs):
        table, wrong, step = vectors @ protos.T, 0, np.zeros_like(protos)
        for idx, n, y in sample:
            s = n @ table[idx]
            rival = int(np.argmax(np.where(np.arange(len(LANGS)) == y, -np.inf, s)))
            if s[y] <= s[rival]:
                v = n @ vectors[idx] / (np.linalg.norm(n) * DIM)
                step[y] += v
                step[rival] -= v
                wrong += 1
        if not wrong:
            break
        protos += 0.3 * step / len(sample)
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    p.protos = protos
    table = vectors @ protos.T
    scores = [(n @ table[idx] / math.sqrt(DIM), y) for idx, n, y in sample]
    best = (-math.inf, 1.0)
    for scale in np.geomspace(0.5, 64, 22):
        z = np.array([s for s, _ in scores]) * scale
        z -= z.max(axis=1, keepdims=True)
        y = np.array([y for _, y in scores])
        ll = float(np.mean(np.clip(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1)), -8, 0)))
        best = max(best, (ll, float(scale)))
    return Profiles(protos, min(best[1], 16.0), seed, (list(vocabulary), (vectors @ protos.T).astype(np.float32)))


def runs(text: str, p: Profiles, stay: float = STAY) -> list[tuple[int, int, str, float]]:
    """(first line, last line, language, confidence) of each longest run; none for a text without language."""
    lines = text.split("\n")
    at, scores = [], []
    for i, line in enumerate(lines):
        got = p.evidence(line)
        if got is not None:
            scores.append(got)
            at.append(i)
    if not at:
        return []
    z = np.stack(scores) * p.scale
    z -= z.max(axis=1, keepdims=True)
    z = np.maximum(z - np.log(np.exp(z).sum(axis=1, keepdims=True)), -12.0)
    if (z.argmax(axis=1) == z[0].argmax()).all():  # every line says the same: so does the best path
        k = int(z[0].argmax())
        total = np.exp((t := z.sum(axis=0) / math.sqrt(len(at))) - t.max())
        return [(1, len(lines), LANGS[k], round(float(total[k] / total.sum()), 4))]
    best, back = z[0], []
    for e in z[1:]:
        top = int(np.argmax(best))
        jump = best[top] - stay
        back.append(np.where(best >= jump, np.arange(len(LANGS)), top))
        best = np.maximum(best, jump) + e
    state = [int(np.argmax(best))]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    state.reverse()
    out, k = [], 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and state[j + 1] == state[k]:
            j += 1
        total = np.sum(z[k : j + 1], axis=0) / math.sqrt(j - k + 1)
        total = np.exp(total - total.max())
        out.append((at[k] + 1 if k else 1, (at[j + 1] if j + 1 < len(at) else len(lines)), LANGS[state[k]], round(float(total[state[k]] / total.sum()), 4)))
        k = j + 1
    return out


def code(label: str | None) -> str | None:
    """The two-letter code a label stands for, as far as it says anything."""
    x = re.split(r"[-_]", (label or "").strip().lower())[0]
    return NAMED.get(x, x) or None


def sample_lines(docs: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """Lines of a bounded sample of labelled documents, at most ``most`` of them and 4000 characters of each."""
    got = (
        docs.where(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())
        .select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id", F.substring("text", 1, 4000).alias("text"), "lang")
        .orderBy("h", "doc_id")
        .limit(most)
        .collect()
    )
    return [(line, r.lang) for r in got for line in r.text.split("\n")]


def languages(records: DataFrame, profiles: Profiles, clean: encodings.Plausibility | None = None, stay: float = STAY) -> DataFrame:
    """Runs of lines in one language, over the whole text of every record.

    Takes origin, record_id, text and lang; other columns are ignored. A null, empty or wordless text gives no row.
    n_langs counts the record's languages, given repeats the record's label. Lines without language of their own
    belong to the run before, leading ones to the first. With ``clean``, lines that a wrong encoding made
    unrecognisable (MISREAD) are restored first, so that their language is that of what was written. Equal scores go to the language that comes first in LANGS.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast((profiles, clean))  # LANGS x DIM floats and a sample's letter pairs: bounded

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            profiles, clean = shared.value
            for origin, rid, text, lang in zip(p.origin, p.record_id, p.text, p.lang, strict=True):
                got = runs(encodings.mended(text, clean, MISREAD) if clean else text, profiles, stay)
                rows += [(origin, rid, a, b, x, c, len({r[2] for r in got}), lang) for a, b, x, c in got]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "first_line", "last_line", "lang", "confidence", "n_langs", "given"])

    return runtime.spread(records.select("origin", "record_id", "text", "lang").where(F.length("text") > 0), "record_id").mapInPandas(label, RUN)


def mislabelled(found: DataFrame) -> DataFrame:
    """Runs of records whose label is missing, says nothing or names another language, or that mix languages."""
    base = F.lower(F.trim(F.element_at(F.split(F.coalesce("given", F.lit("")), "[-_]"), 1)))
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    said = F.coalesce(F.try_element_at(named, base), base)
    return found.where((F.col("n_langs") > 1) | (said != F.col("lang")))
