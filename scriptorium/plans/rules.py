"""Rule packs: everything about a kind of transcript that is data, not code."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Unicode white space as a character class that Java's and RE2's regular expressions read alike.
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The same characters as a string.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Look-aheads that pass over most characters with one comparison, before what follows them: printable ASCII, this without the
#: blank, and what comes after the last white space. A class of many ranges takes Java several times as long.
NOT_ASCII, NOT_INK, NOT_LATER = r"(?![ -~])", r"(?![!-~])", r"(?![\x{3001}-\x{FFFF}])"
#: Runs of white space that aren't one blank already.
RUNS = rf"{NOT_INK}{NOT_LATER}(?: {NOT_INK}{WS}+|{WS.replace(chr(92) + 'x1C-' + chr(92) + 'x20', chr(92) + 'x1C-' + chr(92) + 'x1F')}{WS}*)"


@dataclass(frozen=True)
class TitleRule:
    """title applies if, for every group, the text contains one of the group's words."""

    title: str
    groups: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class RulePack:
    """Rules for one kind of text. Patterns are Java's; `sql_clean` has them for RE2 where the dialects differ."""

    name: str
    timestamp: str
    clean: tuple[tuple[str, str], ...]
    terminators: str
    trim: str
    replacements: tuple[tuple[str, str], ...] = ()
    sql_clean: tuple[tuple[str, str], ...] = ()
    noise_char: str = ""
    noise_marker: str = ""
    noise_text: str = ""
    study_words: tuple[str, ...] = ()
    digest_words: tuple[str, ...] = ()
    titles: tuple[TitleRule, ...] = ()
    untitled: str = ""
    flags: tuple[str, ...] = ()
    noise_flag: str = ""
    # fixed values
    max_chars: int = 3600
    noise: tuple[int, int, int] = (220, 1, 12)
    noise_cut: int = 180
    sentence: int = 8
    study_band: tuple[int, int] = (18, 170)
    digest_band: tuple[int, int] = (22, 150)
    early: int = 2
    noise_penalty: tuple[int, int] = (3, 6)
    budget: tuple[int, int] = (760, 33)
    prefix: int = 24
    study_limit: int = 7
    outline_limit: int = 4
    outline_cut: int = 88
    fallback: tuple[int, int] = (3, 150)
    group: int = 3
    noise_terminators: str = field(default="")


_STAMP = r"[\x{4E00}-\x{9FA5}A-Za-z_·" + WS[1:-1] + r"]{1,24}" + WS + r"+\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}"

# Patterns, word lists, titles and flags of lecture transcripts in Chinese.
_ZH_RULES = (
    (r"(?iU)\bMm+\b|hmm|yes", ""),
    (r"[嗯呃]{1,3}[，。 ]*", ""),
    (r"呵呵|哈哈", ""),
    (r"是不是(啊|呀)?[？?，,。 ]*", ""),
    (r"对吧[？?，,。 ]*", ""),
    (r"能理解吧[？?，,。 ]*", ""),
    (r"懂了吗[？?，,。 ]*", ""),
    (r"好[，,。 ]*(?=第|接下来|我们|那么|来|翻|往下)", ""),
    (r"这个这个|那个那个|就就|把把|的的的", ""),
    (RUNS, " "),
)
# The same with look-aheads for what a rule can begin with.
_ZH_CLEAN = (
    (r"(?=[MmHhYy])(?iU:\bMm+\b|hmm|yes)", ""),
    *((f"{NOT_ASCII}(?:{pattern})", to) for pattern, to in _ZH_RULES[1:9]),
    _ZH_RULES[9],
)
# The same for RE2: no look-ahead, no switch for Unicode classes.
_ZH_SQL = (
    (r"(?i)\bMm+\b|hmm|yes", ""),
    *_ZH_RULES[1:7],
    (r"好[，,。 ]*(第|接下来|我们|那么|来|翻|往下)", r"\1"),
    _ZH_RULES[8],
    (WS + "+", " "),
)
_ZH_REPLACE = (("罪首", "醉叟"), ("最手", "醉叟"), ("醉手", "醉叟"), ("古兽行销", "骨瘦形销"))
_ZH_STUDY = (
    "第一", "第二", "第三", "重点", "所以", "说明", "意味着", "作用", "方法", "题型", "明线", "暗线", "母亲", "父亲", "祖母", "宽容",
    "醉叟", "袁宏道", "概括题", "赏析题", "引用", "比喻", "作文",
)
_ZH_DIGEST = (
    "第一", "第二", "第三", "重点", "核心", "注意", "所以", "说明", "意味着", "作用", "方法", "题型", "答题", "概括", "赏析", "引用",
    "比喻", "明线", "暗线", "线索", "母亲", "父亲", "祖母", "宽容", "教育", "醉叟", "袁宏道", "文言文", "作文", "语言",
)
_ZH_CLASSICAL = (
    TitleRule("线索、明线与暗线", (("明线", "暗线"),)),
    TitleRule("《偷钱》情节与人物心理", (("偷钱",), ("母亲", "父亲"))),
    TitleRule("犯错后的家庭教育", (("祖母", "宽容", "尊严"),)),
    TitleRule("课堂拓展：错误与反思", (("犯过", "严重的错误", "分享"),)),
    TitleRule("进入《醉叟传》与作者背景", (("袁宏道", "公安派", "文言文"),)),
    TitleRule("《醉叟传》第一段句读与翻译", (("醉叟者", "姓字", "呼曰"),)),
    TitleRule("醉叟形象细节与复核点", (("蜈蚣", "黄竹篮", "市儿"),)),
)
_ZH_ESSAY = (
    TitleRule("现代文阅读三步法", (("三步走", "题型"),)),
    TitleRule("《放学路上》的开头与主题", (("放学路", "儿歌"),)),
    TitleRule("概括题：区间、关键词与格式", (("概括题", "答题区间"),)),
    TitleRule("引用作用与赏析题", (("引用", "赏析题", "表达效果"),)),
    TitleRule("比喻信息与中心理解", (("豪华笼子", "贵重行李", "比喻"),)),
    TitleRule("小说讲评：W教授与科学反思", (("W教授", "克隆"),)),
    TitleRule("作文点评：写景语言更新", (("作文", "初春", "残雪", "显得"),)),
)
_ZH_CLASSICAL_FLAGS = (
    "“醉叟”在原转写中多次出现为“罪首/最手/醉手”，本次按语境统一校为“醉叟”，需核对讲义。",
    "“尽日酣沉”疑似被转写为“近日酣沉”，需核对原文。",
    "“京、离”等地名和《醉叟传》原句需按讲义或古文原文复核。",
)
_ZH_ESSAY_FLAGS = (
    "《放学路上》篇名疑似转写为“萧氏的放学路上”，需核对讲义。",
    "“骨瘦如柴 / 骨瘦形销”相关作文点评片段存在转写混乱，需复核。",
    "尾段出现大量课堂杂音和无意义转写，学习整理版默认删除。",
)


def _lecture(name: str, titles: tuple[TitleRule, ...], flags: tuple[str, ...]) -> RulePack:
    return RulePack(
        name=name, timestamp=_STAMP, clean=_ZH_CLEAN, sql_clean=_ZH_SQL, terminators="。！？；", trim=" ，,。", replacements=_ZH_REPLACE, noise_char="我",
        noise_terminators="。！？", noise_marker="[转写噪声片段，建议复核或删除] ", noise_text="转写噪声片段", study_words=_ZH_STUDY, digest_words=_ZH_DIGEST,
        titles=titles, untitled="课堂片段 ", flags=flags, noise_flag="全文中存在疑似 ASR 噪声块，已在保真版保留低干扰标记。",
    )


LECTURE_CLASSICAL = _lecture("lecture-classical", _ZH_CLASSICAL, _ZH_CLASSICAL_FLAGS)
LECTURE_ESSAY = _lecture("lecture-essay", _ZH_ESSAY, _ZH_ESSAY_FLAGS)

#: The same shape of rules for prose in Latin script, with look-aheads for what a rule can begin with. RE2 has none: one is written
#: with a group, the others are left out.
LATIN = RulePack(
    name="latin",
    timestamp=_STAMP,
    clean=(
        (r"(?i)(?=[uhe][uhme])\b(u+h+m*|hmm+|e+h+)\b", ""),
        (r"(?i)(?=haha)\b(ha){2,}h?\b[,. ]*", ""),
        (r"(?i)(?=you )\byou know\b[?,. ]*", ""),
        (r"(?i)(?=ok[,. ])\bok[,. ]+(?=so|then|now|next)", ""),
        (r"(?i)(?=[tao](?:he t|nd a|f o))\b(the the|and and|of of)\b", ""),
        (RUNS, " "),
    ),
    sql_clean=(
        (r"(?i)\b(u+h+m*|hmm+|e+h+)\b", ""),
        (r"(?i)\b(ha){2,}h?\b[,. ]*", ""),
        (r"(?i)\byou know\b[?,. ]*", ""),
        (r"(?i)\bok[,. ]+(so|then|now|next)", r"\1"),
        (r"(?i)\b(the the|and and|of of)\b", ""),
        (WS + "+", " "),
    ),
    terminators=".!?;",
    trim=" ,.",
    replacements=(("tion tion", "tion"), ("ment ment", "ment")),
    noise_char="a",
    noise_terminators=".!?",
    noise_marker="[noisy passage, to be checked or dropped] ",
    noise_text="noisy passage",
    study_words=("that ", "with ", "this ", "from ", "pour ", "dans ", "sich ", "nicht ", "como ", "para ", "license", "first", "which "),
    digest_words=("that ", "with ", "this ", "from ", "when ", "are ", "pour ", "dans ", "avec ", "sich ", "nicht ", "einer ", "como ", "para ", "license", "because"),
    titles=(
        TitleRule("terms of use", (("license", "copyright", "warranty"),)),
        TitleRule("contact", (("@",), (".com", ".org"))),
        TitleRule("french", ((" pour ", " dans ", " avec "),)),
        TitleRule("german", ((" sich ", " nicht ", " einer "),)),
        TitleRule("spanish", ((" como ", " para ", " por "),)),
        TitleRule("english", ((" that ", " with ", " from "),)),
    ),
    untitled="section ",
    flags=("Names and figures are as transcribed.", "Speakers are not told apart."),
    noise_flag="Some passages look like noise and are marked.",
)

PACKS = {p.name: p for p in (LECTURE_CLASSICAL, LECTURE_ESSAY, LATIN)}

#: What turns prose in Latin script into something like a lecture, in this order, so that its packs meet their words in a table.
#: Latin fillers stand between punctuation: word boundaries are Unicode's here, but ASCII's in the SQL that checks them.
LECTURE_WORDS = (
    ("\n", "\n张老师 00:01:02\n"), (" the ", " 嗯，mm，"), (" and ", "是不是啊？"), (" that ", "对吧，就就"), (" with ", "能理解吧。"), (" from ", "懂了吗？"), (" this ", "好，我们"),
    (" der ", "呵呵这个这个"), (" die ", "哈哈醉叟者"), (" und ", "好 第一"), (" sich ", "罪首"), (" les ", "偷钱母亲"), (" dans ", "明线暗线"), (" pour ", "题型hmm"), (" que ", "赏析题 yes"),
    (" una ", "袁宏道所以"), (" por ", "我我我我我"), (" como ", "比喻，，作文"), (". ", "。"), ("? ", "？"), ("! ", "！"), ("; ", "；"), (", ", "，"),
)
