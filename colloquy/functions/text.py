"""Text primitives as native Column expressions: they stay inside whole-stage code generation.

Every function takes and returns Columns; null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{9fff}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_name(c: Column) -> Column:
    """Key under which two spellings of a name are the same: no blanks, no punctuation, lower case."""
    return F.lower(F.regexp_replace(c, r"""(?U)[\s*_`'"“”‘’·・.,，。:：;；!！?？()（）\[\]【】<>《》—–\-]+""", ""))


def norm_spoken(c: Column) -> Column:
    """Key under which two spoken lines are the same."""
    return F.lower(F.regexp_replace(c, r"""(?U)[\s!！.。?？…\-—–,，、;；:：'"“”‘’()（）\[\]【】·•*~～]+""", ""))


def only_punctuation(c: Column) -> Column:
    return c.rlike(r"""(?U)^[\s!！.。?？…\-—–,，、;；:：'"“”‘’()（）\[\]【】·•*~～]*$""")


def slug(c: Column) -> Column:
    """Entity slug: words joined by '-', at most 40 characters, 'x' for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\x{3400}-\x{9fff}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 40), F.lit("")), F.lit("x"))


def file_slug(c: Column) -> Column:
    """Folder name of a title: at most 60 characters, none that file systems refuse, 'untitled' for nothing."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"""(?U)[\\/:*?"<>|\s]+""", "-"), r"\.{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(s, 1, 60), r"^[-. ]+|[-. ]+$", ""), F.lit("")), F.lit("untitled"))


def safe_segment(c: Column) -> Column:
    """One part of an archive path."""
    s = F.regexp_replace(strip(F.regexp_replace(c, r"[\\/]+", "_")), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def safe_name(c: Column) -> Column:
    """Whether a name may be used as a file name."""
    return ~c.rlike(r"[\\/]|\.\.") & (c != "")


def stamp(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; fractions are cut off. Null of null."""
    s = F.floor(seconds).cast("bigint")
    return F.when(s.isNull(), None).when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(
        F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    )


def cue_stamp(seconds: Column, sep: str = ",") -> Column:
    """hh:mm:ss,mmm from rounded milliseconds."""
    ms = F.round(seconds * 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def seconds_of(stamp_text: Column) -> Column:
    """Seconds of 'hh:mm:ss,mmm', 'mm:ss' or '12.5'; 0 of anything else."""
    p = F.split(F.regexp_replace(strip(stamp_text), ",", "."), ":")
    d = F.transform(p, lambda x: x.try_cast("double"))
    ok = ~F.exists(d, lambda x: x.isNull())
    return F.coalesce(
        F.when(ok & (F.size(p) == 1), F.get(d, F.lit(0)))
        .when(ok & (F.size(p) == 2), F.get(d, F.lit(0)) * 60 + F.get(d, F.lit(1)))
        .when(ok & (F.size(p) == 3), F.get(d, F.lit(0)) * 3600 + F.get(d, F.lit(1)) * 60 + F.get(d, F.lit(2))),
        F.lit(0.0),
    )


def number_or_stamp(cell: Column) -> Column:
    """Seconds of a table cell: a number, or a stamp with colons; null of anything else."""
    s = strip(cell)
    return F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.try_cast("double")).when(s.contains(":"), seconds_of(s))


def count_of(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part in text (0 for an empty part)."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def mention_count(low_text: Column, name: Column) -> Column:
    """How often a name occurs: whole words in Latin script, plain parts of text in Chinese.

    Names of one letter, and Latin ones of two except 'ai', are too ambiguous and count 0.
    """
    k = F.lower(strip(name))
    latin = k.rlike("[a-z0-9]") & ~k.rlike(CJK)
    words = F.regexp_count(low_text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), k, F.lit(r"\E(?![a-z0-9])")))
    return F.when((F.length(k) < 2) | (latin & (F.length(k) < 3) & (k != "ai")), 0).when(latin, words).otherwise(count_of(low_text, k))


def snippet(text: Column, key: Column, width: int = 90) -> Column:
    """A window of the text around the key (lower case), with ellipses where it was cut."""
    i = F.instr(F.lower(text), key)
    a = F.greatest(F.lit(0), i - 1 - width // 3)
    cut = F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, F.lit(width)), F.when(a + width < F.length(text), "…").otherwise(""))
    return F.when((i == 0) | (F.length(text) <= width), F.substring(text, 1, width)).otherwise(cut)


#: Words that say nothing in a question.
STOP_WORDS = "什么 怎么 哪些 这个 那个 我们 他们 有没有 是否 the and what who how did does with about for that this 所有 全部 会议".split()


def keywords(c: Column) -> Column:
    """Words of two letters or more without stop words; long Chinese ones also in pairs. Repeats stay."""
    words = F.filter(F.split(c, r"""(?U)[\s,，。、;；:：?？!！/()（）"“”'‘’\[\]]+"""), lambda w: F.length(w) >= 2)
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*STOP_WORDS))
    long = F.filter(kept, lambda w: w.rlike(f"^{CJK}{{4,}}$"))
    pairs = F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.concat(kept, pairs)


def words(c: Column) -> Column:
    """Parts of a list of people or topics, two letters or more."""
    return F.filter(F.split(c, r"(?U)[、,，;；/\s]+"), lambda w: F.length(strip(w)) >= 2)


def clean_tags(c: Column) -> Column:
    """Caption text without mark-up; a voice tag becomes 'Name: '."""
    x = F.regexp_replace(c, r"<v(?:\.[^\s>]+)*\s+([^>]+)>", "$1: ")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"</?v[^>]*>", ""), r"<[^>]+>", ""), r"\{\\[^}]*\}", "")
    return squeeze(x)


def joiner(left: Column, right: Column) -> Column:
    """What stands between two pieces of speech put together."""
    return (
        F.when(left.rlike(f"{CJK}$") & right.rlike(f"^{CJK}"), "，")
        .when(left.rlike(r"[\x{3000}-\x{303f}\x{ff00}-\x{ffef}]$"), "")
        .otherwise(" ")
    )


def strip_fence(c: Column) -> Column:
    """Without the code fence a model may put around its answer."""
    s = strip(c)
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\n```\s*$", ""))).otherwise(s)


def json_object(c: Column) -> Column:
    """The text from the first brace to the last, null when there is no object."""
    s = F.regexp_replace(strip(c), r"^```(?:json)?\s*|\s*```$", "")
    a, b = F.instr(s, "{"), F.length(s) - F.instr(F.reverse(s), "}") + 1
    part = F.when((a > 0) & (F.instr(s, "}") > 0) & (b > a), F.substring(s, a, b - a + 1))
    return F.when(F.try_parse_json(part).isNotNull(), part)


def drop_title(title: Column, content: Column) -> Column:
    """content without a first heading that repeats the topic of title."""
    body = F.regexp_replace(content, "^\n+", "")
    topic = F.substring(strip(F.element_at(F.split(F.regexp_replace(title, r"^[# ]+", ""), "·"), 1)), 1, 4)
    first = F.element_at(F.split(body, "\n"), 1)
    repeats = body.startswith("# ") & (topic != "") & F.contains(F.lower(first), F.lower(topic))
    return F.when(repeats, F.regexp_replace(F.regexp_replace(body, "^[^\n]*\n?", ""), "^\n+", "")).otherwise(content)


def after_heading(md: Column) -> Column:
    """The body below the first second-level heading, without line stamps."""
    i = F.instr(md, "\n## ")
    body = F.when(i > 0, F.substring(md, i + 4, F.length(md))).otherwise(md)
    body = F.regexp_replace(body, "^[^\n]*\n", "")
    return strip(F.regexp_replace(body, r"(?m)^\[\d+:\d{2}(?::\d{2})?\]\s*", ""))


def week_label(d: Column) -> Column:
    """ISO year and week, 'YYYY-Www'."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def week_start(d: Column) -> Column:
    return F.trunc(d, "week")


def week_end(d: Column) -> Column:
    return F.date_add(F.trunc(d, "week"), 6)


#: Words for the states of a commitment, in the order they are looked for.
STATUS_WORDS = (
    ("cancelled", "已取消 已放弃 作废 cancelled canceled dropped annulé".split()),
    ("done", "已兑现 已完成 已生效 已部署 已定 已执行 done fulfilled completed réalisé".split()),
    ("open", ["进行中", "待办", "待执行", "待测试", "待定", "未兑现", "推进中", "in progress", "open", "pending", "en cours"]),
    ("unknown", "未知 unknown inconnu".split()),
)


def status_of(c: Column) -> Column:
    """State of a commitment by its label, else by the end of its text."""
    label = F.regexp_extract(c, r"(?i)(?:状态|status|statut)\s*[:：]\s*([^。.\n\[]+)", 1)
    probe = F.lower(F.when(label != "", label).otherwise(F.substring(c, F.greatest(F.length(c) - 59, F.lit(1)), F.lit(60))))
    out = F.lit("unknown")
    for state, ws in reversed(STATUS_WORDS):
        hit = F.lit(False)
        for w in ws:
            hit = hit | F.contains(probe, F.lit(w))
        out = F.when(hit, state).otherwise(out)
    return out


def refs(c: Column, known: Column | None = None) -> Column:
    """Source references '[id]': known ids, dated ids and briefs; no stamps, no [[links]]."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\[)\[([^\[\]\n]{4,90})\](?!\])"), F.lit(1)), strip)
    dated = lambda v: v.rlike(r"^(\d{4}-\d{2}-\d{2}|brief-|每日简报|周报|weekly)")
    ok = (lambda v: F.array_contains(known, v) | dated(v)) if known is not None else dated
    return F.filter(found, lambda v: ~v.rlike(r"^\d{1,2}:\d{2}") & ok(v))


def date_in(c: Column) -> Column:
    """The first date in a text, '' if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\d{4}-\d{2}-\d{2}", 0)


def strip_refs(c: Column, refs_: Column) -> Column:
    out = F.aggregate(refs_, c, lambda acc, r: F.replace(acc, F.concat(F.lit("["), r, F.lit("]")), F.lit("")))
    return strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))


def date_prefix(c: Column, year: Column) -> Column:
    """A text that begins with 'M/D' as a date of the given year, '' otherwise (days up to 31 pass as they are)."""
    m = F.regexp_extract(c, r"^\**\s*(\d{1,2})/(\d{1,2})(?!\d)", 1).try_cast("int")
    d = F.regexp_extract(c, r"^\**\s*(\d{1,2})/(\d{1,2})(?!\d)", 2).try_cast("int")
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%s-%02d-%02d", year, m, d)).otherwise("")


def language_mix(c: Column) -> Column:
    """auto, zh, en or zh+en by the number of Chinese characters and Latin words."""
    cjk, latin = F.regexp_count(c, F.lit(CJK)), F.regexp_count(c, F.lit("[A-Za-z]+"))
    return (
        F.when((cjk == 0) & (latin == 0), "auto")
        .when(cjk / 2 >= latin, F.when((latin >= 30) & (latin / (cjk / 2) > 0.4), "zh+en").otherwise("zh"))
        .otherwise(F.when((cjk >= 60) & (cjk / 2 / latin > 0.4), "zh+en").otherwise("en"))
    )


def answer_budget(n_chars: Column, weight: float = 1.0, chinese: bool = False, wide: bool = False) -> Column:
    """Length of an answer by the size of its material."""
    low, top, per = (400, 2800 if wide else 1600, 20) if chinese else (250, 1700 if wide else 1000, 45)
    return F.least(F.lit(float(top)), F.greatest(F.lit(float(low)), n_chars / per * weight)).cast("int")


def render_line(text: Column, speaker: Column, start: Column) -> Column:
    """'[stamp] Speaker: text', the speaker only if the text doesn't begin with it."""
    named = F.when(speaker.isNotNull() & (speaker != "") & ~F.startswith(F.lower(text), F.lower(speaker)), F.concat(speaker, F.lit(": "), text)).otherwise(text)
    return F.when(start.isNotNull(), F.concat(F.lit("["), stamp(start), F.lit("] "), named)).otherwise(named)


def source_label(c: Column, labels: dict[str, str]) -> Column:
    """Readable name of a source id; 'watch:folder' names its folder, unknown ids stay."""
    out = F.coalesce(c, F.lit(""))
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return F.when(c.startswith("watch:"), F.concat(F.lit(labels.get("watch", "watch") + " "), F.substring(c, 7, 10_000))).otherwise(out)


#: Language codes that mean one of the languages at hand.
LOCALE_ALIASES = {"en": "en", "zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "zh-sg": "zh-CN", "cn": "zh-CN", "fr": "fr", "english": "en", "chinese": "zh-CN", "french": "fr"}


def locale_code(c: Column) -> Column:
    """A system or browser language as one of the codes at hand, null if there is none."""
    x = F.lower(F.replace(F.element_at(F.split(F.element_at(F.split(strip(c), r"\."), 1), "@"), 1), F.lit("_"), F.lit("-")))
    table = F.create_map(*[F.lit(v) for kv in LOCALE_ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), F.try_element_at(table, F.element_at(F.split(x, "-"), 1)))


def without_thoughts(c: Column) -> Column:
    """A model's answer without its <think> parts; an unclosed one runs to the end."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def tail(a: Column, n: int) -> Column:
    """The last n elements."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def host_label(url: Column) -> Column:
    """The host of an address, as it is shown: in lower case, without 'www.' and port; '' of what is no address."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.|:\d+$", "")
