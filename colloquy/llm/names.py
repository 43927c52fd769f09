"""Problem 1: link the spellings of a person's or a firm's name.

1. Every name and alias is reduced to its telling parts, in no order: a person's two names (or an initial and a family
   name), a firm's own word and its trade. Equal reductions are one node; copies of an entry cost nothing after that.
2. Trie join of the telling words: words go to shards by their first letters with as many left out as slips are
   allowed (neighbours always share a shard), each shard holds its words in a trie, and every word's Levenshtein
   automaton (with transposition) is run along it, which gives all neighbours within the bound. Shards stay small as
   words become many; those of words with a common beginning are cut finer by more letters.
3. Nodes of which two words (of a weak reading, its word and initial) are neighbours, short forms or abbreviations of
   one another are compared part by part in every order, and all slips together stay within the bound. The join is on
   the two words of a node that meet fewest others: as a node alike has all its words, none is missed, and what many
   have (a trade, a place) makes no pairs.
4. Entries are joined along their nodes and these links. An initial, or a firm's word without its trade, counts only
   if all that it fits is one person or firm; a given name, a title or a set of initials alone counts for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..operators.graph import components
from .nicknames import LONG, fulls, regular, same_given
from .personal import fold

#: Most slips between two spellings; words under LONG_WORD letters may differ by one, under SHORT_WORD by none.
SLIPS, LONG_WORD, SHORT_WORD = 2, 8, 5
#: Letters at the head of a word by which shards of the trie join are keyed; those of words in crowded shards.
HEAD, LONG_HEAD = 7, 24
#: Words from which on a shard is crowded, and words to a partition of shards.
CROWDED, SHARD_WORDS = 200, 5_000

#: Titles, and marks of legal form.
TITLES = frozenset("dr prof mr mrs ms mx miss sir dame herr frau mme mlle sr sra srta dona don eng ing".split())
LEGAL = frozenset(
    "inc incorporated co company ltd limited sas sa bv gmbh llc plc corp corporation ag srl sarl spa nv oy ab kg lda ltda pty the group holding holdings gruppe groupe grupo and und et y e".split()
)
HAN_TITLES = "老师|经理|主任|工程师|先生|女士|博士|教授|总监|总|董|局长|处长|哥|姐"
HAN_LEGAL = "科技有限公司|科技股份有限公司|股份有限公司|有限责任公司|有限公司|责任公司|集团公司|集团|公司|项目|控股|科技"
#: Trades in Chinese firm names.
HAN_TRADES = (
    "机器人 包装 物流 数据 保险 医疗 食品 能源 家居 酒店 传媒 纺织 制造 货运 陶瓷 化工 建设 建筑 电子 服饰 旅游 教育 银行 证券 汽车 农业 咨询 餐饮 零售 贸易 投资 金融 地产 网络 软件 通信 航空 铁路 环保 设备 机械 仪器 光学 印刷 渔业 林业 矿业 五金 塑料 造纸 照明 广告 出版"
).split()
#: The commonest family names.
FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
#: Family names of two characters.
COMPOUND = frozenset("欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 司徒 夏侯 端木 独孤 南宫 长孙 宇文 轩辕".split())
#: How characters common in given names are read; characters of one line sound alike.
READINGS = """
bin 斌彬宾 bo 博勃波伯 chao 超钞 chen 晨辰臣 cheng 成诚程 chun 春椿纯 dan 丹单旦 dong 东冬栋 fan 帆凡繁 fang 芳方坊 feng 峰锋丰风枫 guang 广犷光 guo 国帼果
hang 航杭行 hao 昊浩豪皓 heng 恒衡亨 huai 怀淮槐 hui 辉晖慧惠卉 ji 纪季继吉 jia 佳嘉家 jie 杰洁捷 jing 静靖晶京 jun 俊骏军君 kai 凯楷恺 kang 康糠 ke 可科克 lan 岚兰蓝
lei 磊垒雷蕾 li 丽莉立力 liang 亮谅良 long 龙隆 lu 露璐路 mei 梅玫美 min 敏闵民 ming 铭明鸣 mu 慕牧木 na 娜纳 nan 楠南男 peng 鹏朋 ping 萍平苹 qi 琪奇其琦 qian 倩欠茜
qiang 强蔷墙 qing 庆磬青清 qun 群裙 ran 然燃冉 rong 蓉荣容 rui 睿锐瑞 ruo 若偌 shi 诗师 shou 守首 shu 书舒淑 si 思丝 song 松淞 su 素塑 tao 涛滔 ting 婷亭庭 wei 炜伟维 wen 雯文
xia 霞侠夏 xiao 笑晓小 xin 欣新鑫心 xue 雪薛 yang 阳洋扬 ying 颖影英莹 yu 宇羽玉 yuan 远苑媛 yue 悦月越 ze 泽择 zhi 志智
"""
_READ: dict[str, str] = {}
for _m in re.finditer(r"([a-z]+) ([一-鿿]+)", READINGS):
    for _c in _m[2]:
        _READ.setdefault(_c, _m[1])
#: How the family names above are read, those met most.
_FAMILY_READ = dict(
    zip(
        "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖",
        (
            "wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu hu guo he gao lin luo zheng liang xie song tang xu han feng deng cao peng zeng xiao tian dong yuan pan yu jiang cai yu du ye "
            "cheng su wei lyu ding ren shen yao lu jiang cui zhong tan lu wang fan jin shi liao"
        ).split(),
        strict=True,
    )
)
_SYLLABLE = r"(?:(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|uan|iao|ian|uai|ai|ei|ui|ao|ou|iu|ie|ue|an|en|in|un|ia|ua|uo|a|o|e|i|u))"
_PINYIN = re.compile(rf"{_SYLLABLE}{{1,2}}")
_ONE = re.compile(_SYLLABLE)


def bound(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return SLIPS if n >= LONG_WORD else 1 if n >= SHORT_WORD else 0


def slips(a: str, b: str, most: int = SLIPS) -> int:
    """Optimal string alignment distance, most + 1 if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most and min(old) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def pinyin(words: list[str]) -> bool:
    """Whether two words read like a romanised Chinese name, where slips make another name."""
    return len(words) == 2 and all(map(_PINYIN.fullmatch, words)) and any(map(_ONE.fullmatch, words))


def person(name: str) -> list[tuple[str, str, list[str]]]:
    """(kind, key, parts) of each reading of a person's name: full (two parts), exact (two parts, no slips) or initial."""
    x = re.sub(r"[（(\[【][^)）\]】]*[)）\]】]", " ", name).strip()
    if re.search("[一-鿿]", x):
        x = re.sub(r"\s", "", x)
        x = re.sub(f"(?:{HAN_TITLES})$", "", x) if len(x) > 3 else x
        if not re.fullmatch("[一-鿿]{2,4}", x) or x[0] in "老小阿" or re.search(f"(?:{HAN_TITLES})$", x) or len(x) == 2 and x[0] not in FAMILIES:
            return []  # two characters that begin with no common family name are a given name
        cut = 2 if len(x) > 2 and x[:2] in COMPOUND else 1
        read = [_READ.get(c, c) for c in x[cut:]]
        if cut == 2:
            return [("exact", f"{x[:2]} {' '.join(read)}", [x[:2], "".join(read)])]
        out = [("exact", f"{x[0]} {' '.join(read)}", [x[0], "".join(read)])]
        if x[0] in _FAMILY_READ and all(c in _READ for c in x[1:]):
            parts = sorted([_FAMILY_READ[x[0]], "".join(read)])
            out.append(("exact", " ".join(parts), parts))
        return out
    plain = [w for w in re.split(r"[\s.,_\-·]+", x) if w]
    words = [w for w in (fold(w) for w in plain) if w not in TITLES and re.fullmatch(r"[\w'’]+", w)]
    long = [w for w in words if len(w) > 1]
    if len(long) == 1:
        first = words[0] if len(words[0]) == 1 else None
        if first and len(long[0]) > 2:
            return [("initial", f"{first}. {long[0]}", [long[0], first])]
        if len(words) == 1 and x.islower() and len(x) > 5 and x not in LONG:
            return [("initial", f"{x[0]}. {x[1:]}", [x[1:], x[0]])]  # a login: initial and family name run together
        return []
    if len(long) < 2:
        return []
    parts = sorted([long[0], long[-1]])
    return [("exact" if pinyin(parts) else "full", " ".join(parts), parts)]


def firm(name: str) -> list[tuple[str, str, list[str]]]:
    """(kind, key, parts) of each reading of a firm's name: full (own word and trade), core (own word alone), exact."""
    x = re.sub(r"[（(\[【][^)）\]】]*[)）\]】]", " ", name).strip()
    if re.search("[一-鿿]", x):
        x = re.sub(r"\s", "", x)
        while (y := re.sub(f"(?:{HAN_LEGAL})$", "", x)) != x and len(y) > 1:
            x = y
        trade = next((t for t in HAN_TRADES if x.endswith(t) and len(x) > len(t) + 1), "")
        core = x[: len(x) - len(trade)]
        out = []
        for c in {core, core[2:]} if len(core) > 4 else {core}:  # a place may stand before
            out.append(("exact", f"{c} {trade}", [c, trade]) if trade else ("core", c, [c]))
        return out
    if re.fullmatch(r"[A-Z&]{2,4}", x):
        return []
    words = [fold(w) for w in re.split(r"[\s,_\-]+", re.sub(r"\.", "", x)) if w]
    words = [w for w in words if w not in LEGAL and len(w) > 1]
    if not words:
        return []
    if len(words) == 1:
        return [("core", words[0], words)] if len(words[0]) > 3 else []
    parts = sorted(words)
    return [("full", " ".join(parts), parts)]


def shortened(a: str, b: str) -> bool:
    """Whether the shorter word abbreviates the longer: its beginning, or its letters in order with its consonants."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0] or len(a) + 2 > len(b):
        return False
    if b.startswith(a):
        return True
    rest = iter(b)
    return len(a) > 2 and not re.search("[aeiou]", a[1:]) and all(c in rest for c in a)


@lru_cache(100_000)
def given_slips(a: str, b: str) -> int:
    """Slips between two given names.

    None between a name and its short form, but a short form of several names (Bert, Fred) uses the slips up.
    """
    if a == b:
        return 0
    if same_given(a, b):
        return SLIPS if len(LONG.get(a, ())) > 1 or len(LONG.get(b, ())) > 1 else 0
    return slips(a, b) if slips(a, b) <= bound(a, b) else SLIPS + 1


def part_slips(a: str, b: str, is_firm: bool) -> int:
    if a == b:
        return 0
    if is_firm:
        if shortened(a, b):
            return 0
        n = slips(a, b)
        return n if n <= bound(a, b) else SLIPS + 1
    return given_slips(a, b)


def alike(kind_a: str, a: list[str], kind_b: str, b: list[str], is_firm: bool, most: int = SLIPS) -> bool:
    """Whether two readings may be one name, their parts compared in every order, with ``most`` slips altogether."""
    if "exact" in (kind_a, kind_b):
        return a == b
    if kind_a == "initial" or kind_b == "initial":
        if kind_a == kind_b:
            return a[1] == b[1] and slips(a[0], b[0]) <= min(1, bound(a[0], b[0]))
        (family, first), full = (a, b) if kind_a == "initial" else (b, a)
        return any(
            slips(family, full[i]) <= min(1, bound(family, full[i])) and (full[1 - i][0] == first or any(g[0] == first for g in fulls(full[1 - i]))) for i in (0, 1)
        )
    if kind_a == "core" or kind_b == "core":
        one, other = (a, b) if kind_a == "core" else (b, a)
        return any(slips(one[0], w) <= bound(one[0], w) for w in other)
    if len(a) != len(b):
        return False
    def fits(i: int, free: tuple[int, ...], left: int) -> bool:
        if i == len(a):
            return True
        return any((n := part_slips(a[i], b[j], is_firm)) <= left and fits(i + 1, tuple(k for k in free if k != j), left - n) for j in free)

    return fits(0, tuple(range(len(b))), most)


def abbreviates(a: list[str], b: list[str]) -> str | None:
    """Beginning of the word of b that a word of a abbreviates, None if none does."""
    return next((y[:5] for x in a for y in b if len(x) < len(y) and x not in b and shortened(x, y)), None)


# --- the trie join -----------------------------------------------------------------------------------------------


def reach(word: str) -> int:
    """Most slips a word has in common with any neighbour."""
    return bound(word, word)


def keys_of(word: str, head: int = HEAD) -> list[str]:
    """Shards a word lies in: its first letters with up to ``reach`` of them left out.

    Words within d slips share a shard: of the letters the slips leave in place, keep those that stand in both heads.
    The longer head then lacks only letters that a slip put there, at most d (a swap puts one), the other no more.
    """
    out = level = {word[:head]}
    for _ in range(reach(word)):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out = out | level
    return sorted(out) if reach(word) else []


class Automaton:
    """Levenshtein automaton of one word, with transpositions, for at most two slips.

    A state has a row of bits for each number of slips (bit j: j letters of the word are used up), and a row for the
    swaps of which the first letter is read.
    """

    def __init__(self, word: str, most: int) -> None:
        self.most, self.all, self.end = most, (2 << len(word)) - 1, 1 << len(word)
        self.letters: dict[str, int] = {}
        for j, c in enumerate(word):
            self.letters[c] = self.letters.get(c, 0) | 2 << j
        self.start = (1, 3 & self.all if most else 0, 7 & self.all if most > 1 else 0, 0, 0)

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...] | None:
        """The state after one more letter, None if nothing can be accepted from there."""
        r0, r1, r2, p1, p2 = state
        b = self.letters.get(c, 0)
        n0, n1, n2, q1, q2 = r0 << 1 & b, 0, 0, 0, 0
        if self.most:
            n1 = (r1 << 1 & b | r0 | r0 << 1 | n0 << 1 | p1 & b << 1) & self.all
            q1 = r0 << 2 & b
        if self.most > 1:
            n2 = (r2 << 1 & b | r1 | r1 << 1 | n1 << 1 | p2 & b << 1) & self.all
            q2 = r1 << 2 & b
        return (n0, n1, n2, q1, q2) if n0 | n1 | n2 | q1 | q2 else None

    def slips(self, state: tuple[int, ...]) -> int | None:
        """Slips of a word that ends in this state, None if it is not accepted."""
        return next((k for k in range(self.most + 1) if state[k] & self.end), None)


class Trie:
    """Words with shared beginnings."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, automaton: Automaton) -> Iterator[tuple[str, int]]:
        """All words the automaton accepts, with their slips."""
        todo = [(self.root, automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if (n := automaton.slips(state)) is not None:
                        yield child, n
                elif (after := automaton.step(state, c)) is not None:
                    todo.append((child, after))


def shard_join(crowded: int | None) -> Callable:
    """Neighbours within the shards of a partition sorted by key; the words of a crowded shard come out with no other."""

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata: dict[str, Automaton] = {}
        rows: list[tuple[str, str | None, int | None]] = []
        flush = lambda: pd.DataFrame(rows, columns=["word", "other", "slips"]).astype({"slips": "Int32"})
        for _, run in groupby(((k, w) for p in parts for k, w in zip(p.key, p.word, strict=True)), key=itemgetter(0)):
            words = [w for _, w in islice(run, crowded + 1 if crowded else None)]
            if crowded and len(words) > crowded:
                for w in chain(words, (w for _, w in run)):
                    rows.append((w, None, None))
                    if len(rows) > 20_000:
                        yield flush()
                        rows = []
            elif len(words) > 1:
                trie = Trie(words)
                for w in words:
                    if w not in automata:
                        if len(automata) > 50_000:
                            automata.clear()
                        automata[w] = Automaton(w, reach(w))
                    rows += [(w, other, n) for other, n in trie.near(automata[w]) if other != w and n <= bound(w, other)]
            if len(rows) > 20_000:
                yield flush()
                rows = []
        yield flush()

    return join


def trie_join(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, other, slips): every pair of different words within the bound, both ways. ``words`` are distinct.

    Words of crowded shards are joined again in shards by LONG_HEAD letters, whatever their size.
    """
    runtime.ship(words.sparkSession)

    def placed(df: DataFrame, head: int) -> DataFrame:
        keys = F.pandas_udf(lambda s: s.map(lambda w: keys_of(w, head)), "array<string>")
        shards = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // SHARD_WORDS + 1)
        return df.select("word", F.explode(keys("word")).alias("key")).repartition(shards, "key").sortWithinPartitions("key")

    found = runtime.stored(placed(words, HEAD).mapInPandas(shard_join(crowded), "word string, other string, slips int"), "p1-shards")
    again = found.where("other is null").select("word").distinct()
    if not again.isEmpty():
        found = found.unionByName(placed(runtime.stored(again, "p1-crowded"), LONG_HEAD).mapInPandas(shard_join(None), "word string, other string, slips int"))
    return found.where("other is not null").distinct()


def short_keys(entity_type: str, word: str) -> list[dict]:
    """Keys on which a word meets those it is short for, or that are short for it: its own, and such as its short forms have."""
    if entity_type != "project":
        return [{"key": p, "own": True} for p in fulls(word)] + [{"key": f, "own": False} for f in sorted({f for p in fulls(word) for f in regular(p)})]
    out = [{"key": f"{word}-", "own": True}] + [{"key": f"{word[:i]}-", "own": False} for i in range(2, len(word) - 1)]
    if len(word) > 2 and not re.search("[aeiou]", word[1:]):
        out.append({"key": word[:3], "own": True})
    rest = [c for c in word[1:] if c not in "aeiou"]
    return out + [{"key": word[0] + x + y, "own": False} for x, y in sorted({(x, y) for i, x in enumerate(rest) for y in rest[i + 1 :]})]


def short_join(words: DataFrame) -> DataFrame:
    """(entity_type, word, other): given names of which one is short for the other, words of firms that abbreviate, both ways."""
    keys = F.pandas_udf(lambda t, w: pd.Series([short_keys(*x) for x in zip(t, w, strict=True)]), "array<struct<key string, own boolean>>")
    fits = F.pandas_udf(lambda t, a, b: pd.Series([(shortened if k == "project" else same_given)(x, y) for k, x, y in zip(t, a, b, strict=True)]), "boolean")
    keyed = runtime.stored(words.select("entity_type", "word", F.explode(keys("entity_type", "word")).alias("k")).select("entity_type", "word", "k.key", "k.own"), "p1-short")
    other = keyed.select("entity_type", F.col("word").alias("other"), "key")
    found = keyed.where("own").select("entity_type", "word", "key").join(runtime.shuffled(other), ["entity_type", "key"]).where("word != other").select("entity_type", "word", "other").distinct()
    found = runtime.stored(found.where(fits("entity_type", "word", "other")), "p1-shorts")
    return found.unionByName(found.select("entity_type", F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


# --- entries to groups -------------------------------------------------------------------------------------------


def readings(entries: DataFrame) -> DataFrame:
    """(entity_id, entity_type, kind, key, parts) of every reading of every name and alias."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, t, names in zip(p.entity_id, p.entity_type, p.names, strict=True):
                got = {r[1]: r for n in names if n for r in (firm if t == "project" else person)(n)}
                rows += [(i, t, kind, f"{kind[0] if kind in ('initial', 'core') else 'f'}:{key}", list(ps)) for key, (kind, _, ps) in got.items()]
            yield pd.DataFrame(rows, columns=["entity_id", "entity_type", "kind", "key", "parts"])

    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    one = entries.where("entity_type in ('person', 'project')").groupBy("entity_id", "entity_type").agg(F.max_by(names, F.struct("updated", "name")).alias("names"))
    return one.mapInPandas(read, "entity_id string, entity_type string, kind string, key string, parts array<string>")


def side(nodes: DataFrame, c: str) -> DataFrame:
    """Nodes as the one or the other side of a pair."""
    return nodes.select(F.col("key").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("parts").alias(f"parts_{c}"), "entity_type", *[x for x in ("n", "x", "y", "letter") if x in nodes.columns])


def full_pairs(full: DataFrame, related: DataFrame) -> DataFrame:
    """Pairs of full names to be compared; ``full`` has a row for each word (i, x) of a node.

    The two words of a node that meet fewest others meet two of the other, which has all of its words if it is alike.
    """
    held_by = full.where("n > 2").groupBy("entity_type", F.col("x").alias("other")).agg(F.count("*").alias("f"))
    met_by = related.join(runtime.shuffled(held_by), ["entity_type", "other"]).groupBy("entity_type", F.col("word").alias("x")).agg(F.sum("f").alias("f"))
    fewest = F.slice(F.array_sort(F.collect_list(F.struct("f", "i", "x"))), 1, 2)
    rare = full.where("n > 2").join(runtime.shuffled(met_by), ["entity_type", "x"]).groupBy("entity_type", "key").agg(fewest.alias("r"))
    chosen = full.where("i = 0").drop("i", "x").join(runtime.shuffled(rare), ["entity_type", "key"], "left")
    chosen = chosen.withColumn("x", F.coalesce(F.get("r", F.lit(0))["x"], F.get("parts", F.lit(0)))).withColumn("y", F.coalesce(F.get("r", F.lit(1))["x"], F.get("parts", F.lit(1))))
    met = related.select("entity_type", F.col("word").alias("x"), F.col("other").alias("x_b"))
    met = side(chosen, "a").join(runtime.shuffled(met), ["entity_type", "x"]).join(runtime.shuffled(met.toDF("entity_type", "y", "y_b")), ["entity_type", "y"]).drop("x", "y")
    other = full.select("*", F.posexplode("parts").alias("j", "y")).where("i != j")
    return met.join(runtime.shuffled(side(other, "b").withColumnsRenamed({"x": "x_b", "y": "y_b"})), ["entity_type", "n", "x_b", "y_b"]).where("a < b")


def groups(entries: DataFrame) -> DataFrame:
    """entity_id, entity_type, cluster_id of every person and project entry; cluster_id is the least id of the group.

    Takes entity_id, entity_type, name, aliases and updated; other columns are ignored. An entry saved twice counts by
    its latest state. Null names and aliases, empty lists and names without telling parts leave an entry on its own.
    """
    everything = entries.where("entity_type in ('person', 'project') and entity_id is not null").select("entity_id", "entity_type").distinct()
    read = runtime.stored(readings(runtime.spread(entries.select("entity_id", "entity_type", "name", "aliases", "updated"), "entity_id")), "p1-readings")
    nodes = read.groupBy("entity_type", "key").agg(F.first("kind").alias("kind"), F.first("parts").alias("parts"))
    nodes = runtime.stored(nodes.where("kind != 'exact'"), "p1-nodes")
    words = nodes.select("entity_type", F.explode(F.when(F.col("kind") == "initial", F.slice("parts", 1, 1)).otherwise(F.col("parts"))).alias("word")).where("word != ''").distinct()
    words = runtime.stored(words, "p1-words")
    near = words.join(runtime.shuffled(trie_join(words.select("word").distinct())), "word").select("entity_type", "word", "other", "slips")
    same = words.select("entity_type", "word", F.col("word").alias("other"), F.lit(0).alias("slips"))
    related = runtime.stored(near.unionByName(same).unionByName(short_join(words).withColumn("slips", F.lit(0))), "p1-near")
    full = nodes.where("kind = 'full'").select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "x"))
    strong = full_pairs(full, related)
    # weak readings: a word and an initial, or a word alone
    letters = F.pandas_udf(lambda t, k, p, i: pd.Series([_letters(*x) for x in zip(t, k, p, i, strict=True)]), "array<string>")
    weak = nodes.where("kind != 'full'").select("*", F.lit(0).alias("i"), F.col("parts")[0].alias("x"))
    keyed = weak.unionByName(full.drop("n")).withColumn("letter", F.explode(letters("entity_type", "kind", "parts", "i")))
    fits = side(keyed.where("kind != 'full'"), "a").join(runtime.shuffled(related.select("entity_type", F.col("word").alias("x"), F.col("other").alias("x_b"), "slips")), ["entity_type", "x"]).drop("x")
    loose = fits.join(runtime.shuffled(side(keyed, "b").withColumnRenamed("x", "x_b")), ["entity_type", "x_b", "letter"]).where("(kind_b = 'full' or a < b) and not (kind_a = 'core' and kind_b = 'core' and slips > 1)")
    ends = ["entity_type", "a", "b", "kind_a", "parts_a", "kind_b", "parts_b"]
    pairs = strong.select(*ends).unionByName(loose.select(*ends)).dropDuplicates(["entity_type", "a", "b"])

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for t, x, y, ka, a, kb, b in zip(p.entity_type, p.a, p.b, p.kind_a, p.parts_a, p.kind_b, p.parts_b, strict=True):
                a, b, is_firm = list(a), list(b), t == "project"
                if alike(ka, a, kb, b, is_firm):
                    short_a, short_b = (abbreviates(a, b), abbreviates(b, a)) if is_firm and ka == kb == "full" else (None, None)
                    rows.append((t, x, y, ka, kb, x if short_a else y if short_b else None, short_a or short_b))
            yield pd.DataFrame(rows, columns=["entity_type", "a", "b", "kind_a", "kind_b", "short", "stands_for"])

    found = runtime.stored(pairs.mapInPandas(compare, "entity_type string, a string, b string, kind_a string, kind_b string, short string, stands_for string"), "p1-links")
    # an abbreviation that stands for two words links nothing
    unclear = found.where("short is not null").groupBy("entity_type", "short").agg(F.countDistinct("stands_for").alias("n")).where("n > 1").select("entity_type", "short")
    links = found.where("short is null").unionByName(found.where("short is not null").join(runtime.shuffled(unclear), ["entity_type", "short"], "leftanti").select(found.columns))
    node = lambda t, k: F.concat_ws("\u0001", t, k)
    weak = ("initial", "core")
    strong = links.where(~F.col("kind_a").isin(*weak) & ~F.col("kind_b").isin(*weak)).select(node("entity_type", "a").alias("a"), node("entity_type", "b").alias("b"))
    held = read.where(~F.col("kind").isin(*weak)).select(F.concat(F.lit("\u0002"), "entity_id").alias("a"), node("entity_type", "key").alias("b"))
    roots = components(strong.unionByName(held))

    # a weak reading belongs where all its neighbours and holders with full names belong
    of_node = roots.where(F.substring("node", 1, 1) != "\u0002")
    of_entry = roots.where(F.substring("node", 1, 1) == "\u0002").select(F.expr("substring(node, 2)").alias("entity_id"), "root")
    either = links.where(F.col("kind_a").isin(*weak) != F.col("kind_b").isin(*weak))
    first_weak = F.col("kind_a").isin(*weak)
    fits = either.select(
        node("entity_type", F.when(first_weak, F.col("a")).otherwise(F.col("b"))).alias("weak"), node("entity_type", F.when(first_weak, F.col("b")).otherwise(F.col("a"))).alias("node")
    ).join(runtime.shuffled(of_node), "node").select("weak", "root")
    held_weak = read.where(F.col("kind").isin(*weak)).select("entity_id", node("entity_type", "key").alias("weak"))
    owners = held_weak.join(runtime.shuffled(of_entry), "entity_id").select("weak", "root")
    sole = fits.unionByName(owners).groupBy("weak").agg(F.countDistinct("root").alias("n"), F.min("root").alias("root"))
    homeless = held_weak.join(runtime.shuffled(of_entry.select("entity_id")), "entity_id", "leftanti").join(runtime.shuffled(sole), "weak", "left")
    # an entry of weak readings only: the one home they have; none known, the reading itself; several, nowhere
    placed = homeless.groupBy("entity_id").agg(
        F.countDistinct(F.when(F.col("n") == 1, F.col("root"))).alias("homes"), F.min(F.when(F.col("n") == 1, F.col("root"))).alias("home"), F.min(F.when(F.col("n").isNull(), F.col("weak"))).alias("own")
    ).select("entity_id", F.when(F.col("homes") == 1, F.col("home")).when(F.col("homes") == 0, F.col("own")).alias("root")).where("root is not null")
    home = runtime.stored(everything.join(runtime.shuffled(of_entry.unionByName(placed)), "entity_id", "left").withColumn("root", F.coalesce("root", F.concat(F.lit("\u0003"), "entity_id"))), "p1-homes")
    least = home.groupBy("entity_type", "root").agg(F.min("entity_id").alias("cluster_id"))
    return home.join(runtime.shuffled(least), ["entity_type", "root"]).select("entity_id", "entity_type", "cluster_id")


def _letters(entity_type: str, kind: str, parts: list[str], i: int) -> list[str]:
    """What else a reading's word meets others by: an initial, or those the other parts of a full name may have."""
    if entity_type == "project" or kind == "core":
        return ["*"]
    if kind == "initial":
        return [parts[1]]
    return sorted({g[0] for k, p in enumerate(parts) if k != i for g in fulls(p)})


def pairs(grouped: DataFrame) -> DataFrame:
    """Every pair of entries of a group, the smaller id first."""
    a = grouped.select(F.col("entity_id").alias("entity_id_a"), "entity_type", "cluster_id")
    b = grouped.select(F.col("entity_id").alias("entity_id_b"), "entity_type", "cluster_id")
    return a.join(runtime.shuffled(b), ["entity_type", "cluster_id"]).where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
