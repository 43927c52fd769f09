"""Problem 2: clean, ordered speaker turns out of segments and transcript texts.

A hidden Markov model tags the tokens of every line as stamp, speaker, separator, sound annotation, filler or speech;
its probabilities are counted from the annotated lines in SEED, and Viterbi decodes whole batches of lines at once.
The speaker tokens of a line are looked up among the meeting's participants (a run that names nobody is speech), the
last speaker is carried over unlabelled lines, and a new turn begins where the speaker changes.

Lines of all records are range-partitioned by (record, time), so a meeting that never stops is spread over as many
partitions as its size asks for; carrying over a partition's end is a window over one row per record and partition.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from . import mails

STATES = ("stamp", "speaker", "separator", "annotation", "filler", "speech")
STAMP, SPEAKER, SEPARATOR, ANNOTATION, FILLER, SPEECH = range(6)
CLASSES = (
    "pad stamp arrow bracket role note generic name initial low han_short han_long filler number comma colon dash tag tag_end mark other"
).split()
CLASS = {c: i for i, c in enumerate(CLASSES)}

#: Hesitations of the six languages, alone and as set phrases.
FILLERS = frozenset(
    "uh um umm uhm er erm hm hmm mm mmm mhm ah oh eh este pues ahn hã né hum euh heu bah ben hein äh ähm öh hem halt 嗯 呃 啊 唔 哦 诶 额 那个".split()
)
PHRASES = ("you know", "i mean", "sort of", "kind of", "o sea", "du coup")
_HAN_FILLER = re.compile("[嗯呃啊唔哦诶额]+|那个")
#: Parts people play, as written behind a name.
ROLES = frozenset("host guest moderator chair external speaker 主持 主持人 外部 嘉宾 gast moderation invité animateur invitado moderador convidado anfitrión".split())
_TOKEN = re.compile(
    r"(?P<stamp>[\[(（【<]?(?<![\d:.])\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\d:])[\])）】>]?)|(?P<arrow>-->)|(?P<tag><v[ .][^>\n]{1,80}>)|(?P<tag_end></v>)"
    r"|(?P<note>[\[(（【*<][^\[\](（【*<>)）】\d\n]{1,30}[\])）】*>]|♪+)"
    r"|(?P<generic>(?:speaker|spk|sprecher|locuteur|hablante|orador|发言人|说话人)[ _]?0*\d+)"
    rf"|(?P<phrase>(?:{'|'.join(PHRASES)})(?!\w))"
    r"|(?P<han>[㐀-鿿]+)|(?P<word>[^\W\d_㐀-鿿][^\W㐀-鿿]*(?:['’-][^\W\d㐀-鿿]+)*\.?)|(?P<number>\d+)|(?P<comma>[,，、])|(?P<colon>[:：])|(?P<dash>(?<=\s)[-–—](?=\s))|(?P<other>\S)",
    re.I,
)
#: Annotated lines: {t stamp} {s speaker} {c separator} {a annotation} {f filler}, all else speech.
SEED = """
{t [00:03]} {s Nora Vale}{c :} Birds come back in April, mostly at dawn.
{t [00:09]} {s Nora Vale}{c :} {f Um,} someone left the garden gate open again. {a [music]}
{t (00:07)} {s Vale, Nora} {c -} We counted 12 swans on the river today.
{t (00:12)} {s N. Vale} {c -} {a (phone rings)}
{t (00:15)} {s Nora V.} {c -} {f Uh,} frankly, soup was better last winter.
{s Nora Vale}{c :} I said it before: water the roses first, then sweep.
I said it before: water the roses first, then sweep.
Das Rezept verlangt: zuerst Mehl, danach Butter.
VORSICHT: DER BODEN IST NASS, DIE TREPPE EBENSO.
{s NORA VALE}{c :} {a [inaudible]} My bicycle broke twice, what a day.
{s nora vale} {c :} they prefer walking along the shore to any museum.
{s nora vale}{c :} It rained for 40 nights without a break.
{s nora vale} {c :} {f äh,} der Apfelbaum blüht schon wieder.
{t [00:21]} {s carl dorn}{c :} Se chover amanhã ficamos em casa, é mais seguro.
{t (00:27)} {s carl dorn} {c -} {f Pues,} la luna sale detrás del monte.
{s carl dorn} {t 00:00:24}
{s Nora}{c :} {f Er... uh.}
{s Nora Vale [Host]}{c :} Nobody has painted that fence since 1998, it shows.
{s Nora Vale (guest)}{c :} {a <noise>} Children feed ducks behind our school.
{s Nora_Vale}{c :} {f Euh,} la rivière monte et les prés sont sous l'eau.
{s Nora Vale} {t 00:00:03}
{s VALE Nora} {t 00:10}
{s Nora Vale (guest)} {t 00:00:41}
{s 王明} {t 00:00:24}
{s 王明}{c ：}{f 呃，}河边的柳树又长高了，孩子们都在放风筝。
{s 王 明}{c ：}奶奶早上在院子里晒被子。 {a ♪}
{s 王明(外部)}{c ：}{a 【掌声】}
{s 王明（主持）}{t （00:20）}{c ：}大家都喜欢吃新摘的桃子。
{s 王明} {t （00:04）}{c ：}{f 呃，嗯……}
{t [00:38]} {f 呃，嗯……}
{t [00:42]} 昨天晚上山里下了一场雪。
{t (00:53)} 火车站旁边有三家面馆，哪家都好吃。 {a ♪}
{s Speaker_1} {c -} Lima Sur tiene tranvías desde hace un siglo.
{s Speaker 2}{c :} Harbour Bakery S.A. sells bread before sunrise.
{t (00:12)} {s Speaker 1} {c -} {a [risas]} Mi abuela guarda tres relojes viejos.
{s Nora Vale}{c :} Harbour Bakery burned down, Carl Dorn saw smoke.
{t [01:02]} {s Speaker 2}{c :} Snow covered every roof by noon on Sunday.
{t [01:02]} {s Speaker_3}{c :} {f Hum,} personne ne chante plus au village.
{s SPEAKER_01}{c :} {a (applause)} Did anyone bring matches for candles?
{s 发言人1}{c ：}春天一到，桥下的水就涨起来。
{s Speaker 1} {t 00:00:07}
{t 00:00:01,070} {t -->} {t 00:00:06,790}
{t 00:01.070} {t -->} {t 00:06.790}
{s <v Nora Vale>}Old maps show a mill where cows graze now.{c </v>}
{s <v nora v.>}{a [laughter]} Ayer nadé hasta la boya y conté 40 peces.{c </v>}
{s <v 王明>}{f 啊，}弟弟骑车走了57里路。{c </v>}
Cats sleep all afternoon, {f er,} on warm stones near 16:30.
{f You know,} wind decides, {f I mean,} ask any sailor or Nora Vale.
{f Um.}
{f 嗯嗯}
{f euh, hum.}
{a (applause)}
{a ♪♪}
{a [BLANK_AUDIO]}
{a [music]} {f Uh, um...}
{a *coughs*} Lanterns hang over both streets, some still burn.
{a （笑声）}{f 嗯。}
{f Äh,} mein Bruder hat 32 Tauben gezüchtet. {a (Gelächter)}
Nora Vale planted beans, nobody told Carl Dorn.
Post it to nora.vale (at) farm dot example tonight.
Der Brunnen ist leer und keiner holt Regen.
今年的雨水比去年少了48毫米。
"""
_MARKUP = re.compile(r"\{([tscaf]) ([^}]*)\}")
LINES = "origin string, record_id string, pos bigint, at double, label string, generic int, spoken boolean"


def token_class(m: re.Match) -> int:
    kind, x = m.lastgroup, m[0]
    if kind == "word":
        low = x.lower().rstrip(".")
        if low in FILLERS:
            return CLASS["filler"]
        if len(x) == 2 and x[1] == "." and x[0].isupper():
            return CLASS["initial"]
        return CLASS["name"] if x[0].isupper() else CLASS["low"]
    if kind == "han":
        return CLASS["filler"] if _HAN_FILLER.fullmatch(x) else CLASS["han_short"] if len(x) < 5 else CLASS["han_long"]
    if kind == "phrase":
        return CLASS["filler"]
    if kind == "note":
        return CLASS["role"] if x[1:-1].strip().lower() in ROLES else CLASS["note"]
    return CLASS[kind]


def tokens(line: str) -> list[tuple[int, int, int]]:
    """(class, start, end) of each token; a voice tag is followed by an empty separator."""
    out = []
    for m in _TOKEN.finditer(line):
        out.append((token_class(m), m.start(), m.end()))
        if m.lastgroup == "tag":
            out.append((CLASS["colon"], m.end(), m.end()))
    return out


def seeds() -> list[list[tuple[int, int]]]:
    """(class, state) sequences of the annotated lines."""
    out = []
    for raw in SEED.strip().split("\n"):
        line, spans, at = "", [], 0
        for m in _MARKUP.finditer(raw):
            line += raw[at : m.start()]
            spans.append((len(line), len(line) + len(m[2]), "tscaf".index(m[1])))
            line += m[2]
            at = m.end()
        line += raw[at:]
        out.append([(c, SEPARATOR if a == b else next((s for x, y, s in spans if x <= a < y), SPEECH)) for c, a, b in tokens(line)])
    return out


class Tagger:
    """First-order hidden Markov model over token classes."""

    def __init__(self, examples: list[list[tuple[int, int]]], smooth: float = 0.02):
        n = len(STATES)
        start, move, emit, stop = (np.full(s, smooth) for s in (n, (n, n), (n, len(CLASSES)), n))
        for ex in examples:
            if not ex:
                continue
            start[ex[0][1]] += 1
            stop[ex[-1][1]] += 1
            for c, s in ex:
                emit[s, c] += 1
            for (_, a), (_, b) in zip(ex, ex[1:], strict=False):
                move[a, b] += 1
        whole = move.sum(axis=1) + stop
        self.start = np.log(start / start.sum())
        self.move = np.log(move / whole[:, None])
        self.stop = np.log(stop / whole)
        self.emit = np.log(emit / emit.sum(axis=1, keepdims=True))

    def decode(self, lines: list[list[int]]) -> list[np.ndarray]:
        """Viterbi paths of many lines; lines of like length are decoded together, equal ones once."""
        first: dict[tuple[int, ...], int] = {}
        same = [first.setdefault(tuple(x), len(first)) for x in lines]
        if len(first) < len(lines):
            paths = self.decode([list(x) for x in first])
            return [paths[i] for i in same]
        out: list = [np.zeros(0, dtype=np.int8)] * len(lines)
        order = sorted((i for i, x in enumerate(lines) if x), key=lambda i: len(lines[i]))
        k = 0
        while k < len(order):
            j, longest = k, max(8, int(1.25 * len(lines[order[k]])))
            while j < len(order) and j - k < 4096 and len(lines[order[j]]) <= longest:
                j += 1
            batch, k = order[k:j], j
            n, steps = len(batch), len(lines[batch[-1]])
            size = np.array([len(lines[i]) for i in batch])
            obs = np.zeros((n, steps), dtype=np.intp)
            for r, i in enumerate(batch):
                obs[r, : len(lines[i])] = lines[i]
            score = self.start + self.emit.T[obs[:, 0]]
            back = np.zeros((steps, n, len(STATES)), dtype=np.int8)
            last = np.where((size == 1)[:, None], score, -np.inf)
            for t in range(1, steps):
                via = score[:, :, None] + self.move
                back[t] = via.argmax(axis=1)
                score = via.max(axis=1) + self.emit.T[obs[:, t]]
                ends = size == t + 1
                last[ends] = score[ends]
            state = (last + self.stop).argmax(axis=1)
            path = np.zeros((n, steps), dtype=np.int8)
            rows = np.arange(n)
            for t in range(steps - 1, -1, -1):
                live = size > t
                path[live, t] = state[live]
                if t:
                    state = np.where(live, back[t, rows, state], state)
            for r, i in enumerate(batch):
                out[i] = path[r, : size[r]]
        return out


@lru_cache(1)
def tagger() -> Tagger:
    return Tagger(seeds())


_GENERIC = re.compile(r"(?:speaker|spk|sprecher|locuteur|hablante|orador|发言人|说话人)[ _]?0*(\d+)", re.I)
_ROLE = re.compile(r"[\[(（【][^\])）】]*[\])）】]")


def key_of(label: str) -> str:
    """A label as it is looked up: no part played, no marks, one case, order of writing kept."""
    x = _ROLE.sub(" ", label.replace("_", " "))
    x = re.sub(r"^<v[ .]|>$", "", x.strip())
    if not x.isascii():
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    x = " ".join(x.casefold().split()).strip(" :：-–—,，")
    return re.sub(r"(?<=[㐀-鿿]) (?=[㐀-鿿])", "", x)


def people(participants: str | None) -> list[str]:
    return [" ".join(x.split()) for x in re.split("[,;、，；]", participants or "") if x.strip()]


@lru_cache(20_000)
def directory(participants: str | None) -> dict[str, str]:
    """Ways of labelling each participant; one that fits two of them fits neither, unless it is a whole name."""
    found: dict[str, set[str]] = {}
    whole = {}
    for full in people(participants):
        whole[key_of(full)] = full
        parts = full.split()
        ways = set()
        if len(parts) > 1:
            given, family = parts[0], parts[-1]
            rest = " ".join(parts[1:])
            ways |= {f"{family} {given}", f"{rest} {given}", f"{rest}, {given}", f"{family}, {given}", f"{given[0]}. {family}", f"{given[0]} {family}"}
            ways |= {f"{given} {family[0]}.", f"{given} {family[0]}", given, family, f"{given}{family}", f"{given[0]}{family}", f"{given}.{family}"}
        elif re.fullmatch("[㐀-鿿]{2,4}", full):
            ways |= {full[1:], full[-2:], f"{full[0]}总", f"老{full[0]}", f"小{full[0]}", f"{full[0]}老师", f"{full[0]}经理"}
        for w in ways:
            found.setdefault(key_of(w), set()).add(full)
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1} | whole


def misread(label: str) -> Iterator[str]:
    """A label as it may read in the right encoding."""
    for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gb18030"):
        try:
            yield label.encode(wrong).decode("utf-8")
        except UnicodeError:
            pass


@lru_cache(200_000)
def resolve(label: str, participants: str | None) -> str | None:
    """The participant a label names, 'Speaker n' for a numbered one, None if it names nobody."""
    if m := _GENERIC.fullmatch(re.sub(r"^<v[ .]|>$", "", _ROLE.sub("", label).strip()).strip()):
        return f"Speaker {int(m[1])}"
    names = directory(participants)
    got = names.get(key_of(label))
    if got is None and not label.isascii():
        got = next((names[k] for x in misread(label) if (k := key_of(x)) in names), None)
    return got


def read(lines: list[str], participants: list[str | None]) -> list[tuple[str | None, float | None, bool]]:
    """(speaker, stamp in seconds, anything spoken) of each line."""
    return [x[:3] for x in tagged(lines, participants, False)]


def tagged(lines: list[str], participants: list[str | None], words: bool = True) -> list[tuple[str | None, float | None, bool, str]]:
    """(speaker, stamp in seconds, anything spoken, what is spoken) of each line, every token of which is tagged.

    Without ``words`` what is spoken is not put together ('').
    """
    toks = [tokens(x) for x in lines]
    paths = tagger().decode([[c for c, _, _ in t] for t in toks])
    out = []
    for line, tok, path, who in zip(lines, toks, paths, participants, strict=True):
        path = path.tolist()
        k, n, at, speaker, label = 0, len(tok), None, None, None
        while k < n and path[k] in (STAMP, SPEAKER, SEPARATOR):  # the line's head
            c, a, b = tok[k]
            if path[k] == STAMP and c == CLASS["stamp"] and at is None:
                at = seconds(line[a:b])
            if path[k] == SPEAKER:
                label = (label[0], b, k) if label else (a, b, k)
            k += 1
        while k and path[k - 1] == SEPARATOR and tok[k - 1][0] not in _SEPARATING:  # an opening bracket of what is said
            k -= 1
        if label:
            speaker = resolve(line[label[0] : label[1]], who)
            if speaker is None:  # no participant: spoken after all
                k = next(i for i, (_, a, _) in enumerate(tok) if a == label[0])
        spoken = any(path[i] in (SPEECH, SPEAKER) and tok[i][0] in _WORDS for i in range(k, n))
        out.append((speaker, at, spoken, speech(line, tok[k:], path[k:]) if spoken and words else ""))
    return out


def speech(line: str, tok: list[tuple[int, int, int]], path: list[int]) -> str:
    """A line behind its head without stamps, sound notes and fillers; a blank stays where one stood."""
    out, at, end, gone, k = [], None, 0, False, 0  # at: where the stretch being kept begins
    drop = [c == CLASS["tag_end"] for c, _, _ in tok]
    for s, run in groupby(path):
        n = len(list(run))
        if s in _ASIDE and any(tok[i][0] in _ASIDE[s] for i in range(k, k + n)):  # marks alone are no filler
            drop[k : k + n] = [True] * n
        k += n
    for (_, a, b), no in zip(tok, drop, strict=True):
        if no:
            if at is not None:
                out.append(line[at:end])
                at = None
            gone = bool(out)
        elif at is None:
            if gone and any(x.isspace() for x in line[end:a]):
                out.append(" ")
            at, end = a, b
        else:
            end = b
    if at is not None:
        out.append(line[at:end])
    return "".join(out).strip()


_WORDS = frozenset(CLASS[c] for c in "name initial low han_short han_long number generic".split())

_SEPARATING = frozenset(CLASS[c] for c in "comma colon dash tag_end bracket arrow".split())

#: What is left out of the clean text, and the classes of which a run of it has one at least.
_ASIDE = {STAMP: {CLASS["stamp"]}, ANNOTATION: {CLASS["note"], CLASS["role"]}, FILLER: {CLASS["filler"]}}


def seconds(stamp: str) -> float:
    parts = [float(x) for x in re.sub(r"[^\d:.]", "", stamp.replace(",", ".")).strip(".").split(":")]
    return sum(x * 60**i for i, x in enumerate(reversed(parts)))


_CUE = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}\s*-->")


def text_lines(texts: list[str], participants: list[str | None], sure: list[bool], words: bool = True) -> list[list[tuple[int, float | None, str | None, bool, str]]]:
    """(line, time, speaker, spoken, what is spoken) of the lines of each transcript; [] of a text that is none.

    A line without stamp of its own has the time of the line before it. What stands above the first stamp or label
    is a title if a blank line follows or it is marked as a heading. A text is a transcript if it is ``sure`` to be,
    or if two of its lines at least have a cue, or name a participant or a numbered speaker.
    """
    body, cues, at = [], [], [0]
    for text, who, known in zip(texts, participants, sure, strict=True):
        cue = len(_CUE.findall(text))
        cues.append(cue)
        if known or cue > 1 or who or _GENERIC.search(text):  # else nobody can be named in it
            body += [
                "" if x.startswith(("WEBVTT", "NOTE", "STYLE")) or cue and x.strip().isdigit() else x.rstrip("\r") for x in text.split("\n")
            ]
        at.append(len(body))
    spread = [who for i, who in enumerate(participants) for _ in range(at[i + 1] - at[i])]
    everything = tagged(body, spread, words)
    out = []
    for i, known in enumerate(sure):
        got, lines = everything[at[i] : at[i + 1]], body[at[i] : at[i + 1]]
        if not known and cues[i] < 2 and sum(s is not None for s, *_ in got) < 2:
            out.append([])
            continue
        first = next((k for k, (s, t, *_) in enumerate(got) if s is not None or t is not None), len(got))
        for k in range(first):
            if got[k][2] and (lines[k].lstrip().startswith("#") or k + 1 < len(lines) and not lines[k + 1].strip()):
                got[k] = (None, None, False, "")
        rows, now = [], None
        for k, (s, t, spoken, said) in enumerate(got):
            now = t if t is not None else now
            rows.append((k + 1, now, s, spoken, said))
        out.append(rows)
    return out


def lines_of(segments: DataFrame, texts: DataFrame, words: bool = True) -> DataFrame:
    """Tagged lines of segments (record_id, seg_idx, start_sec, speaker, text, participants) and of texts.

    Without ``words`` the column said is empty, for uses that only ask where turns begin.
    """

    def tag(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            text = p.text.fillna("")
            who = [x if isinstance(x, str) else None for x in p.participants]
            got = tagged([" ".join(x.split("\n")) for x in text], who, words)
            rows = []
            for rid, k, start, column, w, (s, _, spoken, said) in zip(p.record_id, p.seg_idx, p.start_sec, p.speaker, who, got, strict=True):
                named = resolve(column, w) if isinstance(column, str) and column.strip() else None
                rows.append(("segments", rid, k, None if start != start else start, named or s, spoken, said))
            yield pd.DataFrame(rows, columns=["origin", "record_id", "pos", "at", "speaker", "spoken", "said"])

    def tag_texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p[[not mails.is_mail(x) for x in p.text]]
            who = [x if isinstance(x, str) else None for x in p.participants]
            rows = []
            for origin, rid, lines in zip(p.origin, p.record_id, text_lines(list(p.text), who, list(p.origin == "transcripts"), words), strict=True):
                rows += [(origin, rid, n, at, s, spoken, said) for n, at, s, spoken, said in lines if spoken or s is not None]
            yield pd.DataFrame(rows, columns=["origin", "record_id", "pos", "at", "speaker", "spoken", "said"])

    out = "origin string, record_id string, pos bigint, at double, speaker string, spoken boolean, said string"
    a = runtime.spread(segments.select("record_id", "seg_idx", "start_sec", "speaker", "text", "participants"), "record_id", "seg_idx").mapInPandas(tag, out)
    b = runtime.spread(texts.select("origin", "record_id", "text", "participants").where(F.length("text") > 0), "record_id").mapInPandas(tag_texts, out)
    return a.unionByName(b)


RECORD = ["origin", "record_id"]


def in_partition() -> Window:
    return Window.partitionBy(*RECORD, "pid").orderBy("o", "pos")


def along_partitions() -> Window:
    return Window.partitionBy(*RECORD).orderBy("pid")


def marked(lines: DataFrame) -> DataFrame:
    """The spoken lines in order within partitions (pid, o, pos), each with its speaker and whether it starts a turn.

    Lines are ordered by time, without time by position. Lines of fillers and notes only make no turn and end none,
    but in texts a label standing alone counts for the lines below it. A record's first lines without any label have
    speaker null.
    """
    # written before it is range-partitioned, or drawing the sample of ranges would tag every line a second time
    kept = runtime.stored(lines.where("spoken or (origin != 'segments' and speaker is not null)"), "p2-tagged")
    ranged = kept.withColumn("o", F.coalesce("at", F.col("pos").cast("double")))
    # in a record with times, a line without one stands by its position among the rest: it sorts last
    ranged = runtime.stored(
        ranged.repartitionByRange("origin", "record_id", "o", "pos").withColumn("pid", F.spark_partition_id()),
        "p2-lines",
    )
    rec, part, along = RECORD, in_partition(), along_partitions()
    filled = ranged.withColumn("own", F.last("speaker", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranged.groupBy(*rec, "pid").agg(F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct("o", "pos"))).alias("last"))
    carried = ends.select(*rec, "pid", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    named = filled.join(carried, [*rec, "pid"]).withColumn("speaker", F.coalesce("own", "carry")).where("spoken")
    # the speaker before, over the spoken lines; at a partition's start, of the last spoken line of those before
    tails = named.groupBy(*rec, "pid").agg(F.max_by(F.struct("speaker"), F.struct("o", "pos")).alias("tail"))
    before = tails.select(*rec, "pid", F.lag("tail").over(along).alias("tail"))
    return (
        named.join(before, [*rec, "pid"])
        .withColumn("prev", F.coalesce(F.lag(F.struct("speaker")).over(part), F.col("tail")))
        .withColumn("starts", F.when(F.col("prev").isNull() | ~F.col("prev.speaker").eqNullSafe(F.col("speaker")), 1).otherwise(0))
    )


#: Lines of a turn whose text is one value; a turn of more comes in several parts.
PART_LINES = 5_000


def turns(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """One row per turn: origin, record_id, turn_no, part, first_pos, last_pos, start, speaker, lines, text.

    A turn of more than ``part_lines`` lines, as of a recording that never stops, has a row for each so many, numbered
    by part from 0; so no row and no task holds more, however long somebody speaks. The text is what is spoken in the
    turn's lines, without labels, stamps, sound notes and fillers, joined by blanks.

    Which lines start a turn says ``marked``. Records without spoken lines have no turn.
    """
    rec, part, along = RECORD, in_partition(), along_partitions()
    spoken = marked(lines).withColumn("rn", F.row_number().over(part))
    counts = spoken.groupBy(*rec, "pid").agg(F.sum("starts").alias("n"), F.count("*").alias("c"), F.max(F.when(F.col("starts") == 1, F.col("rn"))).alias("begun"))
    offset = counts.select(*rec, "pid", (F.sum("n").over(along) - F.col("n")).alias("offset"), (F.sum("c").over(along) - F.col("c")).alias("rows"), "begun")
    # the row at which the turn going on began, of the partitions before
    offset = offset.withColumn("open", F.last(F.col("rows") + F.col("begun"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).drop("begun")
    so_far = part.rowsBetween(Window.unboundedPreceding, 0)
    numbered = spoken.join(offset, [*rec, "pid"]).withColumn("turn_no", F.col("offset") + F.sum("starts").over(so_far))
    began = F.coalesce(F.last(F.when(F.col("starts") == 1, F.col("rows") + F.col("rn")), ignorenulls=True).over(so_far), F.col("open"))
    numbered = numbered.withColumn("part", F.floor((F.col("rows") + F.col("rn") - began) / part_lines))
    first = F.struct("o", "pos")
    return numbered.groupBy(*rec, "turn_no", "part").agg(
        F.min_by("pos", first).alias("first_pos"),
        F.max_by("pos", first).alias("last_pos"),
        F.min("at").alias("start"),
        F.min_by("speaker", first).alias("speaker"),
        F.count("*").alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "pos", "said"))), lambda x: x["said"]), " ").alias("text"),
    )


def turn_starts(lines: DataFrame) -> DataFrame:
    """The first line of every turn: origin, record_id, first_pos, speaker."""
    return marked(lines).where("starts = 1").select("origin", "record_id", F.col("pos").alias("first_pos"), "speaker")
