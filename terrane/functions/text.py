"""Text analysis as column expressions; everything here stays inside the JVM.

There are two tokenizers on purpose. :func:`analyze_terms` scores and embeds: it keeps ``_`` and ``-`` within words and
turns runs of Chinese and Japanese into overlapping pairs of characters. :func:`index_tokens` recalls: it splits at
everything that is no letter or digit and folds accents.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_CJK_RUN = f"[{CJK}]+"
_TERM_RUN = r"[\p{L}\p{N}_\-]+"
_INDEX_RUN = r"[\p{L}\p{N}]+"

# Words of a query that are not searched for.
QUERY_STOPWORDS = (
    "a an the and or but of to in on at for with by is are was were be been being do does did have has had it its this that these those "
    "as from not no we you they he she i my your our their will would can could should what which who how when where why all some any "
    "into over under about between through out off up down then than so very just here there now too"
).split()

# Headings of note templates, which are no concepts.
BOILERPLATE = (
    "本章概要", "本章要点", "本章小结", "章节定位", "章节目录", "核心 Takeaway", "核心概念", "核心心智模型",
    "关键结论", "延伸阅读", "练习与思考", "思考题", "术语中英对照", "术语表", "素材说明",
)

# Words that are no concepts, as they occur with everything.
CONCEPT_STOPWORDS = (
    "一个 这个 那个 我们 他们 自己 什么 怎么 可以 能够 需要 进行 通过 对于 关于 以及 或者 但是 因为 所以 如果 然后 就是 还是 没有 不是 也是 "
    "这种 那种 一种 一些 很多 所有 每个 不同 相同 重要 主要 基本 核心 部分 问题 方法 方式 情况 内容 介绍 说明 例如 比如 包括 其中 这样 那样 "
    "上述 下面 上面 最后 第一 第二 实现 使用 采用 常见 典型 相关 对应 基于 针对 的 与 是 和 了 在 有 也 就 都 这 那 被 把 从 到 等 或 及 并 而"
).split()


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters below, by Unicode's own decomposition."""
    marked, bare = [], []
    for code in range(0x00C0, 0x0250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if c.islower() and len(base) > 1 and base[0].isascii():
            marked.append(c)
            bare.append(base[0])
    return "".join(marked), "".join(bare)


#: Letters that :func:`fold` replaces, and by what.
MARKED, BARE = _accents()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_segmented_script(c: Column) -> Column:
    """Whether a text holds Chinese or Japanese script."""
    return text_or_empty(c).rlike(f"[{CJK}]")


def has_letter(c: Column) -> Column:
    return text_or_empty(c).rlike(r"[\p{L}\p{N}]")


def script_runs(c: Column) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-``; a change of script ends a run."""
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), f"({_CJK_RUN})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(f"({_TERM_RUN})"), F.lit(0))


def cjk_bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a single character stays."""
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.char_length(run) > 1, pairs).when(F.char_length(run) == 1, F.array(run)).otherwise(F.array().cast("array<string>"))


def _is_cjk(run: Column) -> Column:
    return run.rlike(f"^[{CJK}]")


def analyze_terms(c: Column) -> Column:
    """Terms of a text, in order and with repetitions: words whole, Chinese and Japanese in pairs of characters."""
    return F.flatten(F.transform(script_runs(c), lambda r: F.when(_is_cjk(r), cjk_bigrams(r)).otherwise(F.array(r))))


def distinct_terms(terms: Column) -> Column:
    """The terms in order of their first occurrence."""
    return F.array_distinct(terms)


def segment_index(c: Column) -> Column:
    """The pairs of characters of a text's Chinese and Japanese runs, separated by spaces, for the search column."""
    return F.array_join(F.flatten(F.transform(F.filter(script_runs(c), _is_cjk), cjk_bigrams)), " ")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text_or_empty(c)), MARKED, BARE)


def index_tokens(c: Column) -> Column:
    """Tokens of the inverted index, in order: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(f"({_INDEX_RUN})"), F.lit(0))


def match_phrases(query: Column) -> Column:
    """The phrases that a query asks the index for, any of which is enough.

    Words of other scripts than Chinese and Japanese come whole, without stop words; runs of those scripts come whole
    and in pairs of characters. Phrases without a letter or digit are left out. No phrase means that the lexical
    search doesn't take part.
    """
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    runs = F.filter(script_runs(query), lambda r: _is_cjk(r) | ~F.array_contains(stop, r))
    phrases = F.flatten(F.transform(runs, lambda r: F.when(_is_cjk(r), F.concat(F.array(r), cjk_bigrams(r))).otherwise(F.array(r))))
    return F.array_distinct(F.filter(phrases, has_letter))


def truncate_utf8(c: Column, limit: int) -> Column:
    """The longest beginning of a text that takes at most ``limit`` bytes of UTF-8, never half a character."""
    data = F.encode(c, "UTF-8")
    # a character has at most four bytes, so one of four cuts is between two
    cuts = [F.substring(data, 1, max(0, limit - back)).cast("string") for back in range(4)]
    cut = F.coalesce(*(F.when(F.is_valid_utf8(x), x) for x in cuts))
    return F.when(F.octet_length(c) <= limit, c).otherwise(cut)


_SPACE = " \t\n\r\x0b\x0c\x85\u00a0"


def trim_space(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE))


def compact_snippet(c: Column, limit: int) -> Column:
    """A text without outer space, cut to ``limit`` bytes with an ellipsis if it is longer."""
    plain = trim_space(text_or_empty(c))
    return F.when(F.octet_length(plain) <= limit, plain).otherwise(F.concat(truncate_utf8(plain, limit), F.lit("…")))


# Markup that is no text, in the order in which it is removed, and what stands for it.
MARKUP = (
    (r"```[^\n]*?```", " "),
    (r"`[^`]*`", " "),
    (r"\$\$[^\n]*?\$\$", " "),
    (r"\$[^$]*\$", " "),
    (r"\\[a-zA-Z]+\{[^}]*\}", " "),
    (r"\\[a-zA-Z]+", " "),
    (r"</?[a-zA-Z][^>]*>", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[\t\n\f\r ]*#{1,6}[\t\n\f\r ]*", " "),
    (r"(?m)^[\t\n\f\r ]*[-*+][\t\n\f\r ]+", " "),
    (r"(?m)^[\t\n\f\r ]*[0-9]+[.)][\t\n\f\r ]+", " "),
    (r"[*_>~|]+", " "),
)


def strip_markdown(c: Column) -> Column:
    """A text without the syntax of Markdown, LaTeX and HTML."""
    out = text_or_empty(c)
    for pattern, replacement in MARKUP:
        # (?d): only a line feed ends a line
        out = F.regexp_replace(out, pattern.replace("(?m)", "(?md)"), replacement)
    return out


def is_boilerplate(c: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | c.contains(phrase)
    return out


def headings(c: Column) -> Column:
    """Headings of the first three levels without their numbering, in order; templates' own headings are left out."""
    lines = F.split(text_or_empty(c), "\n")
    raw = F.transform(lines, lambda line: F.regexp_extract(line, r"^[\t\n\f\r ]*#{1,3}[\t\n\f\r ]+([^\n]+?)[\t\n\f\r ]*$", 1))
    plain = F.transform(raw, lambda h: F.regexp_replace(trim_space(h), r"^[0-9.、\t\n\f\r ()（）:：]+", ""))
    kept = F.filter(plain, lambda h: (F.octet_length(h) >= 2) & ~is_boilerplate(h))
    return F.array_distinct(F.filter(F.transform(kept, trim_space), lambda h: h != ""))


def concept_words(c: Column) -> Column:
    """Words of a text that can be concepts, in order and with repetitions."""
    stop = F.array(*map(F.lit, CONCEPT_STOPWORDS))
    words = script_runs(strip_markdown(c))
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & has_letter(w) & ~F.array_contains(stop, w) & ~is_boilerplate(w))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
