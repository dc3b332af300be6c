"""Scalar text expressions, built from Spark's own functions so that they stay inside generated code.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that occur in clipped pages; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]

#: Names that some file systems reserve.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10)]]

BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip(text: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def collapse(text: Column) -> Column:
    """Runs of blanks of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def visible_text(markup: Column) -> Column:
    """Text of an HTML fragment: no script, style, comments or tags; entities decoded; blanks collapsed. Null gives ''."""
    t = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)</?[A-Za-z][^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return collapse(t)


def fold(text: Column) -> Column:
    """Case folding by lower case, with sharp s as ss; see full_fold() for all of Unicode."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def full_fold(text: Column) -> Column:
    """NFKC and full case folding, by distinct value in Arrow batches."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        made = pd.Series([unicodedata.normalize("NFKC", x).casefold() for x in uniques] + [None], dtype=object)
        return pd.Series(made.to_numpy()[codes], index=values.index)

    return folded(text)


def normalized_title(title: Column) -> Column:
    """NFKC, case folded, ends stripped."""
    return strip(full_fold(title))


# ---- counting terms


def count_substring(text: Column, term: str | Column) -> Column:
    """Occurrences without overlap; an empty term counts 0."""
    term = F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(term) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


_RUN = re.compile(r"[a-z0-9]+")
_WORDS = re.compile(r"[a-z0-9][a-z0-9 ._-]*")
_PARTS = re.compile(r"[a-z0-9]+(?:[ ._-][a-z0-9]+)*")

#: Terms of the wide rule that a digit may follow, and terms that lose the hits of a longer word.
DIGIT_MAY_FOLLOW = ("gpt", "qwen", "glm")
LESS_LONGER_WORD = {"基金": "基金会"}


def bounded(term: str, digit_may_follow: bool = False) -> str:
    """Pattern of the term between characters that are no ASCII letters or digits."""
    escaped = re.sub(r"([^\w\s])", r"\\\1", term)
    return rf"(?<![a-z0-9]){escaped}" + (r"(?=\d|[^a-z0-9]|$)" if digit_may_follow else r"(?![a-z0-9])")


def count_narrow(folded: Column, term: str) -> Column:
    """Count in folded text: one run of ASCII letters and digits needs bounds, anything else counts as a substring."""
    term = term.casefold()
    if _RUN.fullmatch(term):
        return F.regexp_count(folded, F.lit(bounded(term)))
    return count_substring(folded, term)


def count_wide(folded: Column, term: str) -> Column:
    """Count in folded text: ASCII terms of several words need bounds too; two kinds of exceptions."""
    term = term.casefold()
    if _WORDS.fullmatch(term):
        return F.regexp_count(folded, F.lit(bounded(term, term in DIGIT_MAY_FOLLOW)))
    hits = count_substring(folded, term)
    if term in LESS_LONGER_WORD:
        hits = F.greatest(F.lit(0), hits - count_substring(folded, LESS_LONGER_WORD[term]))
    return hits


def has_term(normal: Column, term: str) -> Column:
    """Test in NFKC-folded text; an empty term is in nothing."""
    term = unicodedata.normalize("NFKC", term).casefold()
    if not term:
        return F.lit(False)
    return normal.rlike(bounded(term)) if _PARTS.fullmatch(term) else normal.contains(term)


# ---- markup tests


def count_marks(text: Column, marks: list[str]) -> Column:
    parts = [count_substring(text, m) for m in marks]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


#: The mark of clipped content, and the bytes from which a clip is stored as a page of its own.
CLIPPED = "--en-clipped-content"
LARGE_CLIP = 200 * 1024


def is_clip(markup: Column) -> Column:
    """Clipped from the web: marked so, or three or more layout tags."""
    return markup.contains(CLIPPED) | (count_marks(markup, ["<div", "<span", "<script", "<style"]) >= 3)


def has_media(markup: Column) -> Column:
    return markup.rlike(r'(?i)<en-media\b[^>]*\bhash="[0-9a-f]{32}"')


def markup_summary(markup: Column) -> list[Column]:
    """What a note's markup consists of: the tags it has, whether it was clipped, three counts and its kind. Null counts as empty.

    All but the mark of clipping disregard letter case; counts are of the tag's opening letters, so '<p' counts '<pre' too.
    """
    markup = F.coalesce(markup, F.lit(""))
    low = F.lower(markup)
    has = lambda mark: low.contains(mark)
    return [
        has("<!doctype").alias("has_doctype"),
        has("<html").alias("has_html_tags"),
        has("<head").alias("has_head"),
        has("<body").alias("has_body"),
        has("<en-note").alias("has_en_note"),
        markup.contains(CLIPPED).alias("en_clipped"),
        *[count_substring(low, mark).alias(name) for mark, name in (("<div", "div_count"), ("<span", "span_count"), ("<p", "p_count"))],
        F.when(has("<html") & has("<head") & has("<body"), "html").when(has("<en-note"), "enml").otherwise("fragment").alias("kind"),
    ]


def note_type(markup: Column, size: Column, has_named_file: Column, large: int = LARGE_CLIP) -> Column:
    """How a note is stored: clips, those marked as such and of at least large bytes as a page beside it, notes with files, with media, or plain."""
    return (
        F.when(markup.contains(CLIPPED) & (size >= large), "page_beside")
        .when(is_clip(markup), "clip")
        .when(has_named_file, "with_files")
        .when(has_media(markup), "with_media")
        .otherwise("plain")
    )


# ---- Markdown


def plain_markdown(text: Column) -> Column:
    """No images, links as their text, no emphasis marks, blanks collapsed."""
    t = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return collapse(F.regexp_replace(t, r"[*_`~]", ""))


def first_heading(text: Column) -> Column:
    """The first level-1 heading, or null."""
    found = F.regexp_extract(text, r"(?m)^# +(.+?)[ \t\r]*$", 1)
    return F.when(found != "", found)


def body_of(text: Column) -> Column:
    """The text behind a closed header block."""
    return F.regexp_replace(text, r"\A---\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")


def header_fields(text: Column) -> Column:
    """Map of the 'key: value' lines of a closed header block (later lines win), empty without one.

    Values in double quotes lose them and their escapes, others lose single quotes around them.
    """
    block = F.regexp_extract(text, r"\A---\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("k"), _scalar(F.trim(F.regexp_replace(x, r"^[^:]+:", ""))).alias("v")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def _scalar(value: Column) -> Column:
    quoted = value.rlike(r'^".*"$') & (F.length(value) > 1)
    inner = value.substr(F.lit(2), F.length(value) - 2)
    inner = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(quoted, inner).otherwise(F.regexp_replace(value, r"^'(.*)'$", "$1"))


def header_block(fields: dict[str, Column], order: list[str]) -> Column:
    """A header block of the given fields in order; null fields are left out. Strings are quoted and escaped."""
    escaped = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.when(fields[k].isNotNull(), F.concat(F.lit(f"{k}: "), escaped(fields[k].cast("string")))) for k in order]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def month_folder(created: Column) -> Column:
    """The month as 2024年05月."""
    return F.date_format(created, "yyyy'年'MM'月'")


def cache_summary(body: Column, size: int = 360) -> Column:
    """The first characters; if there are more, without trailing punctuation and with an ellipsis."""
    cut = F.regexp_replace(F.substring(body, 1, size), r"[，,；;。 ]+$", "")
    return F.when(F.length(body) > size, F.concat(cut, F.lit("……"))).otherwise(body)


def safe_filename(name: Column, longest: int = 120) -> Column:
    """A name that all file systems take: no control or path characters, no reserved name, at most longest characters
    with the extension kept. An empty result becomes 'untitled'."""
    t = F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', "_")
    t = F.regexp_replace(strip(t), r"[. ]+$", "")
    stem = F.upper(F.regexp_extract(t, r"^([^.]*)", 1))
    t = F.when(stem.isin(RESERVED_NAMES), F.concat(F.lit("_"), t)).otherwise(t)
    ext = F.regexp_extract(t, r"(\.[A-Za-z0-9]{1,10})$", 1)
    short = F.concat(t.substr(F.lit(1), longest - F.length(ext)), ext)
    t = F.when(F.length(t) > longest, short).otherwise(t)
    return F.when(F.length(t) == 0, "untitled").otherwise(t)


# ---- summaries of stored documents

#: Fixed values of summaries. A line that holds one of these patterns (in its plain form) is frame and no content.
FRAME_PATTERNS = [
    r"^(?:原文链接|原创|作者|来源)[:：]?",
    r"^(?:编译|译者)\s*[|｜]",
    r"^以下文章来源于",
    r"^共\s*\d+\s*字.*阅读需\s*\d+\s*分钟",
    r"^本文内容不构成.*(?:投资|财务).*建议",
    r"^本文为.+原创内容",
    r"我是.+专注于.+(?:分享|干货)",
    r"无法收到推送",
    r"(?:吴说Real|AgenticHub|聊AI)$",
    r"^(?:本漫画作者@|相关[:：]|[，,]\s*已帮助|（?食材不保证真实性)",
    r"^大家好(?:[，,]\s*我是|[。！!]?$)",
    r"^先问大家一个问题",
    r"^(?:引言|前言|序言)[:：]",
    r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$",
    r"点击上方|设置星标|学习更多项目",
]
#: Words of which two together, or one with an offer, are advertising; and what a line that says FOLLOW asks for.
ADVERTISING = ["学员", "总包", "上岸", "人才计划"]
FOLLOW, FOLLOWED = "关注", r"公众号|开发者|获取|解锁"
#: Starts of stripped lines, and of lines as they stand, that are no paragraph.
NO_PARAGRAPH = r"^(?:<!--|#{1,6}\s|!\[|\||[-*+]\s|>\s|---+$|___+$)"
INDENTED = r"^(?:    |\t)"
#: Headings that belong to the frame of a stored note.
FRAME_HEADINGS = ["附件", "相关笔记"]
SENTENCE_ENDS = "。！？!?"


_frame = re.compile("|".join(f"(?:{x})" for x in FRAME_PATTERNS))
_no_paragraph, _indented, _followed = re.compile(NO_PARAGRAPH), re.compile(INDENTED), re.compile(FOLLOWED)


def is_content(line: str, plain: str, least: int = 12) -> bool:
    """A paragraph of at least least characters in its plain form, neither frame nor advertising, nor one phrase said twice."""
    if len(plain) < least or _no_paragraph.match(line.strip()) or _indented.match(line) or _frame.search(plain):
        return False
    words = sum(w in plain for w in ADVERTISING)
    if words >= 2 or words and "offer" in plain.lower() or FOLLOW in plain and _followed.search(plain):
        return False
    said = plain.rstrip("。")
    half = len(said) // 2  # blanks are single here, so twice the same phrase has one blank in the middle
    return not (len(said) % 2 and 2 <= half <= 40 and said[half] == " " and said[:half] == said[half + 1 :])


_image, _link, _marks, _space = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\]]*)\]\([^)]*\)"), re.compile(r"[*_`~]"), re.compile(r"\s+")


def _plain(text: str) -> str:
    """plain_markdown() of one value."""
    return _space.sub(" ", _marks.sub("", _link.sub(r"\1", _image.sub("", text)))).strip()


def first_content(body: Column) -> Column:
    """The plain form of the first line with content, or null. Most bodies are decided by their first lines, so one Arrow pass beats
    expressions, which would test every line."""

    @F.pandas_udf("string")
    def first(bodies: pd.Series) -> pd.Series:
        found = []
        for text in bodies:
            lines = text.splitlines() if text else ()
            found.append(next((p for p, line in ((_plain(x), x) for x in lines) if is_content(line, p)), None))
        return pd.Series(found, index=bodies.index, dtype=object)

    return first(body)


def first_sentence(paragraph: Column, longest: int = 180) -> Column:
    """Up to the first full stop, exclamation or question mark. A longer one is cut, one without an end gets a full stop."""
    head = F.regexp_extract(paragraph, rf"^(.+?[{SENTENCE_ENDS}])", 1)
    s = F.when(head != "", head).otherwise(paragraph)
    cut = F.concat(F.regexp_replace(F.substring(s, 1, longest), rf"[，,；;：:{SENTENCE_ENDS} ]+$", ""), F.lit("。"))
    open_end = (s != "") & ~s.rlike(rf"[{SENTENCE_ENDS}]$")
    return F.when(F.length(s) > longest, cut).when(open_end, F.concat(F.regexp_replace(s, "[：:]+$", ""), F.lit("。"))).otherwise(s)


def outline(body: Column, most: int = 4) -> Column:
    """The first different headings of level 2 and 3, without leading numbers and closing marks."""
    heads = F.filter(F.transform(F.split(body, r"\r?\n"), strip), lambda x: x.rlike(r"^#{2,3}\s+\S"))
    plain = lambda x: plain_markdown(F.regexp_replace(F.regexp_replace(x, r"^#{2,3}\s+", ""), r"(?<=\S)\s*#*\s*$", ""))
    names = F.transform(heads, lambda x: F.regexp_replace(F.regexp_replace(plain(x), r"^\d+(?:\.\d+)*[.、]?\s*", ""), r"^\\\.\s*", ""))
    names = F.filter(names, lambda x: (x != "") & ~x.isin(FRAME_HEADINGS))
    return F.slice(F.array_distinct(names), 1, most)


def note_summary(text: Column, title: Column) -> Column:
    """The first sentence with content and the outline in one or two sentences; another sentence for notes without content."""
    body = body_of(text)
    heads = outline(body)
    about = F.concat(F.lit("本文目录包括"), F.array_join(F.transform(heads, lambda h: F.concat(F.lit("“"), h, F.lit("”"))), "、"), F.lit("等内容。"))
    said = F.concat(first_sentence(first_content(body)), F.when(F.size(heads) > 0, about).otherwise(""))
    return F.coalesce(said, F.concat(F.lit("该笔记主要以图片形式呈现“"), title, F.lit("”相关内容。")))


def first_effective_line(body: Column, longest: int = 120) -> Column:
    """The first line that is no heading, image, quote or rule, up to longest characters; a fixed remark without one."""
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(?:#|!\[|>|---)"))
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, longest), F.lit("暂无摘要"))


def plain_note(markup: Column) -> Column:
    """Markdown of a plain note: its frame goes, breaks, paragraphs, lists, headings and links are rewritten, emphasis is dropped. Null gives ''."""
    t = F.coalesce(markup, F.lit(""))
    steps = [
        (r"<\?xml[^?]*\?>", ""),
        (r"<!DOCTYPE[^>]*>", ""),
        (r"<en-note[^>]*>|</en-note>", ""),
        (r"<br/?>", "\n"),
        (r"<p[^>]*>", ""),
        (r"</p>", "\n\n"),
        (r"<li[^>]*>", "- "),
        (r"</li>", "\n"),
        *[(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", "$1") for tag in ("b", "strong", "i", "em", "u")],
        *[(rf"(?s)<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " $1\n") for n in (1, 2, 3)],
        (r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    ]
    for pattern, to in steps:
        t = F.regexp_replace(t, pattern, to)
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
