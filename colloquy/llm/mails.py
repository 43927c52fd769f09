"""Problem 6: what the sender of an e-mail newly wrote.

1. Each mail is cut into header, marked quotes, attribution lines, older messages and the rest, line by line.
2. A generalised suffix automaton of the thread's earlier text (what the mail itself carries along, and the earlier
   mails of its thread that share a long stretch with it) marks lines of the rest that lie inside a long inherited
   match, however they are wrapped. Which earlier mails those are comes from a join on winnowed fingerprints, each
   of which keeps its first mail only, so a thread of any length stays an equi-join of small rows.
   A signature begins at a separator, a closing formula, the sender's name or a device line with no text right below.
3. Endings that recur (lines that stand almost only at the end of a sender's mails, and in a good part of them) are
   stripped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime

#: Least length of an inherited match, in letters and digits; a Chinese character counts as three.
MATCH = 90
#: Fingerprints: weight of the hashed stretch, and of the window of which the least hash is kept; together at most MATCH.
GRAM, WINDOW = 40, 24
#: A sender's ending recurs if so many mails of LONG lines or more have it, so large a part of the sender's, so large a
#: part of them in their last half LONG.
ENDINGS, ENDING_PART, ENDING_SHARE, LONG = 3, 0.5, 0.95, 6

#: Mail header fields of the six languages.
FIELDS = (
    "from to cc bcc subject date sent reply-to von an betreff datum gesendet de à objet envoyé para asunto fecha "
    "assunto data enviado cópia copia kopie 发件人 收件人 抄送 主题 日期 发送时间"
).split()
_FIELD = re.compile(rf"^({'|'.join(map(re.escape, sorted(FIELDS, key=len, reverse=True)))})\s*[:：]\s*(.*)$", re.I)
_SENDER = re.compile(r"^(?:from|von|de|发件人)\s*[:：]\s*(.*?)\s*(?:<([^>]*)>)?\s*$", re.I)
_SUBJECT = re.compile(r"^(?:subject|betreff|objet|asunto|assunto|主题)\s*[:：]\s*(.*)$", re.I)
_DATE = re.compile(r"^(?:date|sent|datum|gesendet|fecha|data|envoyé|enviado|日期|发送时间)\s*[:：]\s*(.*)$", re.I)
_REPLY = re.compile(r"^(?:(?:re|aw|fwd?|wg|tr|rv|enc|res|sv|antw|回复|答复|转发)\s*[:：]\s*)+", re.I)
_QUOTED = re.compile(r"^\s*(?:[>|]|[A-Z]{1,4}>|[一-鿿]{1,4}>)")
_MARK = re.compile(r"^(?:\s*(?:[>|]|[A-Z]{1,4}>|[一-鿿]{1,4}>))+\s?")
#: Words that end the line introducing a quote.
WROTE = r"wrote|schrieb|a écrit|écrit|escribió|escreveu|写道"
_ATTRIBUTION = re.compile(
    rf"^(?=.*\d)(?:.{{0,200}}\b(?:wrote|schrieb|a écrit|escribió|escreveu)\b.{{0,120}}|.{{0,200}}写道\s*)[:：]\s*$", re.S
)
_OPENING = re.compile(r"^(?:on|am|le|el|em|在)\b|^在|<[^>]+@|\d{4}|^[\w一-鿿 .'-]{2,40}$", re.I)
#: Words of the lines that stand over an older message.
OLDER = (
    "original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|"
    "mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|原始邮件|转发邮件|转发的邮件"
)
_OLDER = re.compile(rf"^\W*(?:begin |début du |anfang )?(?:{OLDER})\W*$", re.I)
_RULE = re.compile(r"^\s*(?:--+|—+|–+|_{2,}|\*(?:\s?\*){2,}|={3,}|~{3,})\s*$")
#: Closing formulas, matched against a whole line without punctuation.
CLOSINGS = frozenset(
    "best|best regards|kind regards|regards|warm regards|with kind regards|cheers|thanks|thank you|many thanks|all the best|sincerely|"
    "yours sincerely|yours|best wishes|take care|talk soon|mit freundlichen grüßen|freundliche grüße|beste grüße|viele grüße|liebe grüße|"
    "herzliche grüße|schöne grüße|grüße|gruß|danke|vielen dank|mfg|lg|cordialement|bien cordialement|bien à vous|bien à toi|amicalement|"
    "merci|merci d'avance|sincères salutations|meilleures salutations|salutations|à bientôt|saludos|saludos cordiales|un saludo|"
    "un cordial saludo|atentamente|gracias|muchas gracias|un abrazo|abrazos|hasta pronto|abraços|um abraço|abraço|atenciosamente|"
    "cordialmente|cumprimentos|melhores cumprimentos|obrigado|obrigada|até breve|saudações|此致|敬礼|此致敬礼|祝好|谢谢|多谢|顺祝商祺|"
    "顺颂商祺|祝商祺|商祺|致礼|祝工作顺利|祝顺利|敬上".split("|")
)
#: How device lines begin.
_DEVICE = re.compile(r"^(?:sent from|sent via|gesendet von|von meinem .{0,30}gesendet|von unterwegs gesendet|envoyé (?:de|depuis)|enviado (?:desde|do|de|a partir)|发自|来自我的)\b|^发自|^来自我的", re.I)
#: What only a notice at the end of a mail says.
_NOTICE = re.compile(
    r"\bconfidential\b.*\baddressee\b|CONFIDENTIALITY NOTICE|received this e-?mail by mistake|before printing this|vertraulich und nur|irrtümlich erhalten|"
    r"confidentiel.*destinataire|reçu (?:ce message|cet e-?mail|ce courriel) par erreur|es confidencial|recib\w+ por error|é confidencial|recebeu por engano|"
    r"保密信息|误收了?本邮件", re.I,
)
_HAN = re.compile("[㐀-鿿]")
PARSED = "import_id bigint, sender string, thread string, sent string, line_no array<int>, line array<string>, old string, prints array<bigint>"


def normal(text: str) -> str:
    """Letters and digits only, in lower case: what is left of a text however it is wrapped or marked."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def weight(s: str) -> int:
    return len(s) + 2 * sum("㐀" <= c <= "鿿" for c in s)


def is_mail(text: str | None) -> bool:
    """Whether a text opens with mail header lines: two at least, one of them the sender or the subject."""
    if not text:
        return False
    fields = []
    for line in text.lstrip("﻿\n\r ").split("\n")[:12]:
        m = _FIELD.match(line)
        if not m:
            break
        fields.append(m[1].lower())
    return len(fields) > 1 and any(f in ("from", "von", "de", "发件人", "subject", "betreff", "objet", "asunto", "assunto", "主题") for f in fields)


class Automaton:
    """Generalised suffix automaton: all substrings of the texts added."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: str) -> None:
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(self.size[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
            last = new

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the longest known stretch that ends at each place, where the next place ends it."""
        state = length = 0
        for i, c in enumerate(text):
            grown = False
            while state and c not in self.next[state]:
                if not grown and length:
                    yield i - length, i
                grown = True
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                if length and not grown:
                    yield i - length, i
                state = length = 0
        if length:
            yield len(text) - length, len(text)


def inherited(lines: list[str], olds: list[str], least: int = MATCH) -> list[bool]:
    """Which lines lie (for the most part) inside a long match with older text."""
    automaton = Automaton()
    for old in olds:
        automaton.add(old)
    parts = [normal(x) for x in lines]
    text = "".join(parts)
    covered = bytearray(len(text))
    for a, b in automaton.matches(text):
        if weight(text[a:b]) >= least:
            covered[a:b] = b"\1" * (b - a)
    out, at = [], 0
    for p in parts:
        out.append(bool(p) and sum(covered[at : at + len(p)]) >= 0.9 * len(p))
        at += len(p)
    return out


def prints(text: str) -> list[int]:
    """Winnowed fingerprints: any two texts sharing a stretch of weight GRAM + WINDOW - 1 share one."""
    text = _HAN.sub(r"\g<0>\g<0>\g<0>", text)
    if len(text) < GRAM:
        return []
    h = [xxhash.xxh3_64_intdigest(text[i : i + GRAM]) >> 1 for i in range(len(text) - GRAM + 1)]
    return sorted({min(h[i : i + WINDOW]) for i in range(max(1, len(h) - WINDOW + 1))})


def attribution(lines: list[str], k: int) -> int:
    """How many lines from k on introduce a quote (0 for none); such a line may be wrapped twice."""
    joined = ""
    for n in range(1, 4):
        if k + n > len(lines):
            return 0
        line = lines[k + n - 1].strip()
        if not line or _QUOTED.match(line) or len(line) > 160 or (n < 3 and _FIELD.match(line)):
            return 0
        joined = f"{joined} {line}".strip()
        if _ATTRIBUTION.match(joined):
            return n
        if not _OPENING.search(lines[k]) or line[-1] in ".!?。！？,;":
            return 0
    return 0


def older_block(lines: list[str], k: int) -> bool:
    """Whether an older message begins at line k: a line over it, or a header block of its own."""
    if _OLDER.match(lines[k]):
        return True
    return bool(_SENDER.match(lines[k])) and sum(bool(_FIELD.match(x)) for x in lines[k : k + 4]) > 1


def closing(line: str) -> bool:
    return line.strip().strip(" ,.!;，。！；~").lower() in CLOSINGS


def names_of(sender: str) -> set[str]:
    """Ways in which the sender may sign: the whole name, its parts, an initial and the rest, a Chinese given name."""
    s = " ".join(re.sub(r"^([^,]+),\s*(.+)$", r"\2 \1", sender).replace(",", " ").split())
    parts = s.lower().split()
    out = {s.lower(), *(p for p in parts if len(p) > 1)}
    if len(parts) > 1:
        first, last = parts[0], parts[-1]
        out |= {f"{first[0]}. {last}", f"{first[0]} {last}", f"{first} {last[0]}", f"{last} {first}", f"{first[0]}{last[0]}", f"{first} {last}"}
    if re.fullmatch("[一-鿿]{2,4}", s):
        out |= {s[1:], s[2:]} if len(s) > 3 else {s[1:]}
    return {x for x in out if x}


def sentence(line: str) -> bool:
    """Whether a line goes on with text, as no line of a signature does."""
    x = line.strip()
    return len(x) > 70 or x[-1:] in ".!?。！？" and (len(x.split()) > 4 or len(_HAN.findall(x)) > 9)


def signs(line: str, names: set[str]) -> bool:
    return line.strip().strip(" ,.，。").lower() in names or line.strip().rstrip(".,").lower() in names


def ends_mail(lines: list[str], k: int, names: set[str], begun: bool) -> bool:
    """Whether the signature begins at line k: a separator, a device line, a closing formula or the sender's name.

    A formula over text and a name right above text are none, and a name is none before the first line. What is no known
    formula is one if it stands alone over the sender's name, short and without a full stop.
    """
    line = lines[k]
    bare = line.strip()
    if _RULE.match(line) or _DEVICE.match(bare):
        return True
    below = next((x for x in lines[k + 1 : k + 4] if x.strip()), "")
    if closing(line):
        return not (sentence(below) and not _NOTICE.search(below)) and (begun or signs(below, names) or not below)
    if not begun:
        return False
    if signs(line, names):
        return not sentence(next(iter(lines[k + 1 : k + 2]), "")) or _NOTICE.search(below) is not None or attribution(lines, k + 1) > 0
    alone = k == 0 or not lines[k - 1].strip()
    return alone and len(bare) <= 40 and len(bare.split()) <= 6 and bare[-1] not in ".!?:。！？：" and not re.search(r"\d", bare) and signs(below, names)


#: Beginnings of the months' names in the five Latin-written languages, by month.
MONTHS = "jan ene / feb fév fev / mar mär / apr avr abr / may mai / jun juin / jul juil / aug aoû ago / sep set / oct okt out / nov / dec dez déc dic".split(" / ")
_MONTH = {x: i for i, row in enumerate(MONTHS, 1) for x in row.split()}
_CLOCK = re.compile(r"(\d{1,2})[:h](\d{2})(?::(\d{2}))?(?:\s*([ap])\.?m)?(?:\s*([+-])(\d{2}):?(\d{2}))?", re.I)


def instant(date: str) -> str:
    """A header's date so that later ones compare greater: ISO, in UTC where a zone is given; '~' if it cannot be read."""
    clock = _CLOCK.search(date)
    rest = date[: clock.start()] + " " + date[clock.end() :] if clock else date
    if m := re.search(r"(\d{4})\D{1,2}(\d{1,2})\D{1,2}(\d{1,2})", rest):
        y, mo, d = map(int, m.groups())
    elif m := re.search(r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", rest):
        d, mo, y = map(int, m.groups())
        d, mo = (mo, d) if mo > 12 else (d, mo)
    else:
        y = re.search(r"\b(?:19|20)\d{2}\b", rest)
        d = re.search(r"(?<!\d)\d{1,2}(?!\d)", rest)
        named = next((n for w in re.findall(r"[^\W\d_]+", rest.lower()) for k in (4, 3) if (n := _MONTH.get(w[:k])) and len(w) > 2), None)
        if not (y and d and named):
            return "~"
        y, mo, d = int(y[0]), named, int(d[0])
    h, mi, sec, half, sign, zh, zm = clock.groups() if clock else (0, 0, 0, None, None, 0, 0)
    hour = int(h) % 12 + (12 if half.lower() == "p" else 0) if half else int(h)
    try:
        at = datetime(y, mo, d) + timedelta(hours=hour, minutes=int(mi), seconds=int(sec or 0))
    except (ValueError, OverflowError):
        return "~"
    zone = timedelta(hours=int(zh or 0), minutes=int(zm or 0))
    return (at - zone if sign == "+" else at + zone if sign else at).isoformat()


def parse(text: str) -> tuple[str, str, str, list[tuple[int, str]], str]:
    """(sender, thread, date, candidate lines with numbers, older text) of one mail."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    k, sender, mailbox, subject, sent, people = 0, "", "", "", "~", set()
    while k < len(lines) and not lines[k].strip():
        k += 1
    while k < len(lines) and (_FIELD.match(lines[k]) or lines[k][:1] in " \t" and lines[k].strip()):
        if m := _SENDER.match(lines[k]):
            sender, mailbox = sender or m[1], mailbox or (m[2] or "")
        if m := _SUBJECT.match(lines[k]):
            subject = _REPLY.sub("", m[1].strip()).strip().lower()
        if m := _DATE.match(lines[k]):
            sent = instant(m[1].strip())
        people |= {x.lower() for x in re.findall(r"<([^>@\s]+)@", lines[k])}
        k += 1
    names = names_of(sender)
    fresh, old, signed = [], [], False
    while k < len(lines):
        line = lines[k]
        bare = line.strip()
        if older_block(lines, k):
            old += lines[k:]
            break
        if _QUOTED.match(line):
            before = fresh[-1] if fresh else None
            wrapped = (
                re.match(r"^> ?\d", line)
                and before is not None
                and before[0] == k  # the line right above, numbered from 1
                and before[1].rstrip()[-1:] not in ".!?:。！？："
                and not (k + 1 < len(lines) and _QUOTED.match(lines[k + 1]))
            )
            if not wrapped:  # else a sign at the start of a wrapped line
                old.append(_MARK.sub("", line))
                k += 1
                continue
        elif n := attribution(lines, k):
            k += n
            after = next((j for j in range(k, len(lines)) if lines[j].strip()), None)
            if after is None or _QUOTED.match(lines[after]):
                continue
            indent = len(lines[after]) - len(lines[after].lstrip())
            if indent < 2:  # unmarked: the older message runs to the end
                old += lines[after:]
                break
            while k < len(lines) and (not lines[k].strip() or lines[k][:indent].isspace()):
                old.append(lines[k])
                k += 1
            continue
        if bare and not signed and ends_mail(lines, k, names, bool(fresh)):
            signed = True
        if bare and not signed and not _NOTICE.search(bare):
            fresh.append((k + 1, line))
        k += 1
    return mailbox.lower() or sender.lower(), f"{subject}|{'|'.join(sorted(people))}", sent, fresh, normal("".join(old))


def parsed(mails: DataFrame) -> DataFrame:
    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, text in zip(p.import_id, p.content, strict=True):
                if is_mail(text):
                    sender, thread, sent, fresh, old = parse(text)
                    rows.append((i, sender, thread, sent, [n for n, _ in fresh], [x for _, x in fresh], old, prints(normal("".join(x for _, x in fresh)))))
            yield pd.DataFrame(rows, columns=["import_id", "sender", "thread", "sent", "line_no", "line", "old", "prints"])

    return runtime.spread(mails, "import_id").mapInPandas(split, PARSED)


def newly_written(imports: DataFrame) -> DataFrame:
    """One row (import_id, line_no, line) per non-blank line newly written by the sender of a mail.

    Takes import_id, content and received_at; other columns are ignored. Texts that open without mail header lines,
    null and empty ones give no rows. An import delivered twice counts once (the first delivery). Line numbers start
    at 1, over the whole content. A mail without any new line has no row.
    """
    once = imports.where(F.length("content") > 0).groupBy("import_id").agg(F.min_by("content", F.struct("received_at", "content")).alias("content"))
    mails = runtime.stored(parsed(once), "p6-mails")
    prints_of = mails.select("import_id", "thread", "sent", F.explode("prints").alias("print"))
    first = prints_of.groupBy("thread", "print").agg(F.min(F.struct("sent", "import_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    sources = (
        prints_of.join(first, ["thread", "print"])
        .where(F.col("first") < F.struct("sent", "import_id"))
        .select("import_id", F.col("first.import_id").alias("source_id"))
        .distinct()
        .join(mails.select(F.col("import_id").alias("source_id"), F.array_join("line", "").alias("source")), "source_id")
        .groupBy("import_id")
        .agg(F.collect_list("source").alias("sources"))  # at most one per fingerprint of the mail
    )

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, sender, nos, lines, old, earlier in zip(p.import_id, p.sender, p.line_no, p.line, p.old, p.sources, strict=True):
                olds = [old, *(normal(x) for x in (earlier if earlier is not None else ()))]
                known = inherited(list(lines), [x for x in olds if x]) if any(map(len, olds)) else [False] * len(lines)
                kept = [(n, x) for n, x, k in zip(nos, lines, known, strict=True) if not k]
                rows += [(i, sender, int(n), x, len(kept) - 1 - at, len(kept)) for at, (n, x) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["import_id", "sender", "line_no", "line", "from_end", "n_lines"])

    lines = runtime.stored(
        mails.join(sources, "import_id", "left").mapInPandas(mark, "import_id bigint, sender string, line_no int, line string, from_end int, n_lines int"), "p6-lines"
    )
    keyed = lines.withColumn("key", F.xxhash64(F.lower(F.trim("line"))))
    long = keyed.where((F.col("n_lines") >= LONG) & (F.col("sender") != ""))
    sent = long.where("from_end = 0").groupBy("sender").agg(F.count("*").alias("mails"))
    recurring = (
        long.groupBy("sender", "key")
        .agg(F.countDistinct("import_id").alias("in_mails"), F.count("*").alias("n"), F.count_if(F.col("from_end") < LONG // 2).alias("last"))
        .join(sent, "sender")
        .where((F.col("in_mails") >= ENDINGS) & (F.col("in_mails") >= ENDING_PART * F.col("mails")) & (F.col("last") >= ENDING_SHARE * F.col("n")))
        .select("sender", "key", F.lit(True).alias("ending"))
    )
    # the end that recurs begins where no other line follows
    below = Window.partitionBy("import_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(recurring, ["sender", "key"], "left")
        .withColumn("body", F.sum(F.when(F.col("ending"), 0).otherwise(1)).over(below))
        .where("body > 0")
        .select("import_id", "line_no", "line")
    )
