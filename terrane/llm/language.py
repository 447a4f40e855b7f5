"""Languages of documents and of the stretches of mixed documents, by word-first backoff.

A word that the model knows in some language scores by its log frequency in each; a word it doesn't know falls back to
its character n-grams, the longest order first that the model knows. The model is fitted on a bounded sample of
labelled rows, of which only those sentences count whose function words agree with the label, so wrong labels and
foreign passages don't teach it. Documents are then read whole: prose is told from code, headings and short quotes
line by line, every line or sentence is scored, and a Viterbi pass over them finds the stretches. A stretch in a script
that the model doesn't know, or of whose words it knows too few, is in none of its languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.tables import spread

# Language codes and names in ISO 639 and in the languages themselves.
NAMES = {
    "de": "ger deu german deutsch",
    "en": "eng english",
    "es": "spa spanish español espanol castellano castilian",
    "fr": "fre fra french français francais",
    "ja": "jpn japanese 日本語 nihongo",
    "nl": "dut nld dutch nederlands flemish",
    "pt": "por portuguese português portugues",
    "zh": "chi zho cmn chinese mandarin 中文 汉语 漢語 普通话",
}

# Frequent function words, which tell the languages apart before anything is learnt.
FUNCTION_WORDS = {
    "de": "der die das und nicht ist von mit dem den des ein eine einer auf für im sich auch als wird werden noch wenn aber nur durch über nach bei oder sind hat zum zur bis vor",
    "en": "the and of to in is that it for was with as not be are this which by from at or an were has had but into when about than there their they you we after before",
    "es": "el los las de la que y en un una por con para no se del al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también hasta hay donde",
    "fr": "le la les de des du et en un une est que qui pour dans pas ne sur au avec ce il sont par plus ou mais nous vous cette ses être tout comme si leur aux sans",
    "nl": "de het een en van in is dat niet op te zijn met voor er aan die om maar ook als bij nog naar dan worden wordt door uit of heeft over zo geen wel moet",
    "pt": "o os as de a que e do da em um uma para com não no na por mais dos das como mas ao ele se são foi pelo pela até isso quando muito também já nos seu sua",
}
LANGUAGES = tuple(sorted(NAMES))
_AT = {code: i for i, code in enumerate(LANGUAGES)}
_CJK_LANGUAGES = ("ja", "zh")

_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_KANA = "\u3040-\u30ff"
_CJK = re.compile(f"[{_HAN}{_KANA}]")
_CJK_RUN = re.compile(f"[{_HAN}{_KANA}々ー]+")
#: Words that aren't part of an identifier with digits or underscores.
_TOKEN = re.compile(r"\b[^\W\d_]+\b")
#: The same in lower-case ASCII.
_ASCII_TOKEN = re.compile(r"\b[a-z]+\b", re.ASCII)
_CAMEL = re.compile(r"[a-z][A-Z]")
_INLINE = re.compile(r"`[^`\n]*`|\b[a-z]+://\S+|</?[a-zA-Z][^<>\n]*>")
#: Marks of emphasis around words.
_EMPHASIS = re.compile(r"(?<![\w*_])[*_]{1,3}(?=\S)|(?<=\S)[*_]{1,3}(?![\w*_])")
#: The first begins at a space, so a search goes from space to space; the second also ends sentences after the full stops of East Asia.
_SPACED_SENTENCE = re.compile(r"\s(?<=[.!?]\s)\s*(?=[^\W\d_a-z]|[`¿¡\"'(])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z]|[`¿¡\"'(])|(?<=[。！？])")
#: What a line of front matter looks like.
_SETTING = re.compile(r"\s*(?:$|#|-(?:\s|$)|[^\s:]+:(?:\s|$))|\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_HEADING = re.compile(r"\s*#{2,6}\s+\S")
_QUOTE = re.compile(r"\s*>+\s?")
#: What stands before the words of a comment, an item of a list or a line of a log.
_LEAD = re.compile(r"\s*(?://+[/!]?|#+(?!!)|--+|/\*+!?|\*+/?|<!--|;+|%+|\"\"\"|'''|[-+*•]|\d+[.)]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S*\s+(?:[A-Z]{3,8}\b)?)(?:\s+|$)")
_CODE = re.compile(r"[{};=<>\[\]|\\&$^*]|[\w\])]\(|\(\)|\w\.\w+\(|::|\"/|:\s*$")
#: One of these is in all that is found by the pattern before.
_CODE_SIGN = re.compile(r"[{};=<>\[\]|\\&$^*(:/]")
# Words that begin statements in common programming languages, in lower case or, as in SQL, in capitals.
_KEYWORDS = (
    "import from package use pub func fn def class return if elif else for while let const var public private static int export type "
    "throw raise await with echo exit fi done then do sleep local mkdir set select insert create begin commit end struct enum interface defer"
).split()
_STATEMENT = re.compile(rf"\s*(?:{'|'.join(_KEYWORDS)}|{'|'.join(map(str.upper, _KEYWORDS))})\b")
#: A word of running text, not joined to anything by code's signs.
_PLAIN = re.compile(r"(?<![\w.$@#/\\\-])[^\W\d_]{2,}(?=[\s,;:.!?)]|$)")
#: So many plain words on a line with few signs of code are a sentence, whatever they begin with.
_SENTENCE_WORDS = 8
_OPENS = re.compile(r"(?:[{}(\[;]|\):|=)\s*$")
_END = re.compile(r"[.。！？!?;；:：,，]\s*$")


def sentences(line: str) -> list[str]:
    """The sentences of a line; the last characters of one may be missing if they are spaces."""
    if line.isascii() or not ("。" in line or "！" in line or "？" in line):
        return _SPACED_SENTENCE.split(line)
    return _SENTENCE.split(line)


def label_code(label: Column) -> Column:
    """Two-letter code that a label names in any spelling, else null."""
    plain = F.lower(F.trim(label))
    first = F.regexp_extract(plain, r"^([^\-_ .()]+)", 1)
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in (code, *names.split()) for x in (name, code)))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, first))


def prose_lines(text: str) -> list[tuple[int, str, int]]:
    """(number, words, size) of the lines that are prose, from 1; size counts the prose as it stands in the line.

    Left out: front matter, fenced and other code, headings, rows of tables, and quotes of under 200 characters (80 in
    Chinese and Japanese).
    """
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[tuple[int, str, int]] = []
    at, n = 0, len(lines)
    if lines[0].strip("\ufeff \t") == "---":
        closing = next((i for i in range(1, n) if lines[i].strip() in ("---", "...") or not _SETTING.match(lines[i])), n)
        at = closing + 1 if closing < n and lines[closing].strip() in ("---", "...") else 0
    while at < n:
        line = lines[at]
        at += 1
        if not line or line.isspace():
            continue
        c = line.lstrip()[0]
        if c in "`~" and (m := _FENCE.match(line)):
            mark = m.group(1)
            closing = next((i for i in range(at, n) if lines[i].lstrip().startswith(mark)), None)
            if closing is not None:
                at = closing + 1
                continue
        if c == "#" and _HEADING.match(line):
            continue
        if c == "|":  # a row of a table holds prose only if it is as long as a sentence
            line = line.replace("|", " ")
            if len(_PLAIN.findall(line)) >= 2 * _SENTENCE_WORDS or len(_CJK.findall(line)) >= 30:
                out.append((at, line.strip(), len(line.strip())))
            continue
        if c == ">":
            quote = [(at, _QUOTE.sub("", line, count=1))]
            while at < n and lines[at].lstrip().startswith(">"):
                at += 1
                quote.append((at, _QUOTE.sub("", lines[at - 1], count=1)))
            whole = "".join(q for _, q in quote)
            if len(whole) >= (80 if len(_CJK.findall(whole)) * 2 > len(whole) else 200):
                out += [(i, q, len(q.strip())) for i, q in quote if q.strip()]
            continue
        lead = _LEAD.match(line) if not c.isalpha() else None
        body = line[lead.end() :] if lead else line
        body = body.strip()
        if body.endswith(("*/", "-->")):
            body = body[:-3].rstrip()
        if len(body) < 2:
            continue
        if c == "#" and lead and len(body) < 90 and not _END.search(body):
            around = (lines[at - 2] if at > 1 else "", lines[at] if at < n else "")
            if not any(x.lstrip().startswith("#") for x in around) and not around[1].strip():
                continue  # a heading, not a comment
        bare = _INLINE.sub(" ", body) if "`" in body or "<" in body or "://" in body else body
        if "*" in bare or "_" in bare:
            bare = _EMPHASIS.sub("", bare)
        if not bare.isascii() and (cjk := len(_CJK.findall(bare))) >= (1 if lead or out and out[-1][0] == at - 1 else 4):
            if lead or cjk * 4 >= len(bare):
                out.append((at, bare, len(body)))
                continue
            if len(_PLAIN.findall(bare)) < _SENTENCE_WORDS:
                continue  # else a line that goes on in another script
        if lead is None:
            code = len(_CODE.findall(bare)) if _CODE_SIGN.search(bare) else 0
            if code and (code * 25 > len(bare) or (_OPENS.search(bare) or _STATEMENT.match(bare)) and len(_PLAIN.findall(bare)) < _SENTENCE_WORDS):
                continue
            if bare.count(" ") < 3 and not (out and out[-1][0] == at - 1 and not code and not _STATEMENT.match(bare)):
                continue  # a short line counts only as the rest of the prose before it
        elif bare[-1:] in "{};" and _CODE.search(bare) and not _END.search(bare[:-1]) and len(_CODE.findall(bare)) * 25 > len(bare):
            continue  # a statement that is commented out
        if any(map(str.isalpha, bare)):
            out.append((at, bare, len(body)))
    return out


def tokens(words: str) -> list[str]:
    """Words in lower case; runs of Chinese or Japanese as overlapping pairs of characters."""
    if not words.isascii():
        runs = _CJK_RUN.findall(words)
        if sum(map(len, runs)) >= 4:  # Latin words between are names
            return [t[i : i + 2] for t in runs for i in range(max(1, len(t) - 1))]
    if _CAMEL.search(words):
        return [t.lower() for t in _TOKEN.findall(words) if not _CAMEL.search(t)]
    return (_ASCII_TOKEN if words.isascii() else _TOKEN).findall(words.lower())


def _grams(word: str, order: int) -> list[str]:
    w = f"<{word}>" if order > 1 else word
    return [w[i : i + order] for i in range(len(w) - order + 1)] if len(w) >= order else []


#: A letter that is neither Latin nor Chinese nor Japanese.
_OTHER_SCRIPT = re.compile(f"[^\\W\\d_{_HAN}{_KANA}a-zA-Z\u00aa-\u024f\u1e00-\u1eff\u0300-\u036f々ー]")
_LATIN, _EAST, _OTHER = 0, 1, 2


def _kind(word: str) -> int:
    """The kind of script that a word is in."""
    if word.isascii():
        return _LATIN
    return _EAST if _CJK.match(word) else _OTHER if _OTHER_SCRIPT.search(word) else _LATIN


class Model:
    """Log frequencies of words and n-grams in each language, less their mean over the languages.

    A row of the table is what a word adds to the sums of its sentence: its score in each language, whether it counts there as
    known (in Chinese and Japanese, which are told by script, every pair does), and whether it is in another script.
    """

    orders = (5, 4, 3, 2, 1)

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        self.words, self.grams = words, grams
        self.row: dict[str, int] = {w: i for i, w in enumerate(words)}
        own = np.array(list(words.values()), np.float32).reshape(-1, len(LANGUAGES))
        self.table = _table(own, own > 0, np.array([_kind(w) for w in words], np.int8))
        self.extra: list[np.ndarray] = []
        self.extra_kinds: list[int] = []

    def unseen(self, word: str) -> np.ndarray:
        """Score of a word that the model doesn't know, from its longest known n-grams."""
        for order in self.orders:
            known = [self.grams[g] for g in _grams(word, order) if g in self.grams]
            if known:
                return np.mean(known, 0)
        return np.zeros(len(LANGUAGES), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of the words in the table."""
        get = self.row.get
        found = np.fromiter(map(get, words, (-1,) * len(words)), np.int64, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            w = words[i]
            at = self.row.get(w)
            if at is None:
                if len(self.extra) > 200_000:  # what was learnt on the way is bounded
                    for x in [x for x, a in self.row.items() if a >= len(self.words)]:
                        del self.row[x]
                    self.extra, self.table = [], self.table[: len(self.words)]
                    self.extra_kinds = []
                    return self.rows(words)
                at = self.row[w] = len(self.words) + len(self.extra)
                self.extra.append(self.unseen(w))
                self.extra_kinds.append(_kind(w))
            found[i] = at
        if len(self.table) < len(self.words) + len(self.extra):
            at = len(self.table) - len(self.words)
            new = np.array(self.extra[at:], np.float32)
            self.table = np.concatenate([self.table, _table(new, np.zeros(new.shape, bool), np.array(self.extra_kinds[at:], np.int8))])
        return found


def _table(scores: np.ndarray, told: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.hstack([scores, told | (kinds == _EAST)[:, None], (kinds == _OTHER)[:, None]], dtype=np.float32, casting="unsafe")


def _ratios(counts: dict[str, Counter], smoothing: float) -> dict[str, np.ndarray]:
    total = Counter()
    for c in counts.values():
        total.update(c)
    sums = {code: sum(c.values()) for code, c in counts.items()}
    size = max(1, len(total))
    out = {}
    for item in sorted(total):
        v = np.array([math.log((counts[code][item] + smoothing) / (sums[code] + smoothing * size)) for code in LANGUAGES])
        out[item] = (v - v.mean()).astype(np.float32)
    return out


def seed_language(words: list[str]) -> str | None:
    """Language whose function words stand out, if any does."""
    text = "".join(words)
    cjk = len(_CJK.findall(text)) if not text.isascii() else 0
    if cjk * 2 > len(text):
        return "ja" if re.search(f"[{_KANA}]", text) else "zh"
    scores = sorted(((sum(w in own for w in words), code) for code, own in _SEEDS.items()), reverse=True)
    (best, code), (second, _) = scores[0], scores[1]
    return code if best >= 3 and best >= 1.5 * second else None


_SEEDS = {code: frozenset(words.split()) for code, words in FUNCTION_WORDS.items()}


def fit(rows: list[tuple[str, str]]) -> Model:
    """Model from (code, text) rows, of which sentences count that agree with their row's code by function words."""
    words: dict[str, Counter] = {code: Counter() for code in LANGUAGES}
    for code, text in rows:
        for _, line, _ in prose_lines(text):
            found = tokens(line)
            if seed_language(found) == code:
                words[code].update(found)
    for code, own in _SEEDS.items():
        words[code].update({w: 3 for w in own})
    # languages without any labelled row are known by their function words alone
    grams: dict[str, Counter] = {code: Counter() for code in LANGUAGES}
    for code, own in words.items():
        for w, n in own.items():
            for order in Model.orders:
                for g in _grams(w, order):
                    grams[code][g] += n
    frequent = {code: Counter({w: n for w, n in own.items() if n >= 2}) for code, own in words.items()}
    return Model(_ratios(frequent, 0.5), _ratios(grams, 2.0))


#: Cost of a change of language between two units, in nats.
_SWITCH = 6.0
#: Least share of a stretch's words that the model must know as words of its language. Prose in a language of the model is
#: to two fifths function words and common words, prose in a related language to less than three tenths.
KNOWN_SHARE = 0.30
#: A sentence of so many words of which fewer are known in any language is in none.
_FOREIGN_WORDS, _FOREIGN_SHARE = 8, 0.15
def segments(model: Model, text: str) -> list[tuple[str | None, int, int, int, float]]:
    """(language, first line, last line, size, confidence) of the stretches of prose in one language, null and 0 where it is none of the model's."""
    units: list[tuple[int, list[str], int]] = []
    for number, line, size in prose_lines(text):
        parts = sentences(line) if len(line) > 60 else [line]
        if len(parts) == 1:
            units.append((number, tokens(line), size))
        else:
            share = size / max(1, len(line))
            units += [(number, tokens(p), round(len(p) * share)) for p in parts if p]
    units = [u for u in units if u[1]]
    if not units:
        return []
    sizes = np.array([len(w) for _, w, _ in units])
    starts = np.cumsum(sizes) - sizes
    found = model.rows(list(chain.from_iterable(w for _, w, _ in units)))
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # what counts words exactly
    sums = np.add.reduceat(model.table.take(found, 0), starts, axis=0, dtype=kind)
    told, other = sums[:, len(LANGUAGES) : -1].astype(np.int64), sums[:, -1].astype(np.int64)
    foreign = (other * 2 > sizes) | (sizes >= _FOREIGN_WORDS) & (told.max(1) < _FOREIGN_SHARE * sizes)
    # the last state is none of the languages
    scores = np.empty((len(units), len(LANGUAGES) + 1))
    scores[:, :-1] = sums[:, : len(LANGUAGES)]
    scores[:, -1] = -1e6
    scores[foreign, :-1], scores[foreign, -1] = -1e6, 0.0
    best = scores.argmax(1)
    if (best == best[0]).all():
        path = best
    else:
        n = len(scores)
        back: list[list[int]] = []
        value, *rest = scores.tolist()
        for row in rest:
            top = value.index(max(value))
            least = value[top] - _SWITCH
            back.append([i if v >= least else top for i, v in enumerate(value)])
            value = [max(v, least) + s for v, s in zip(value, row, strict=True)]
        path = np.empty(n, np.int64)
        path[-1] = value.index(max(value))
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i - 1][path[i]]
    out = []
    first = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()]
    for a, b in zip(first, [*first[1:], len(path)], strict=True):
        lang, count = int(path[a]), max(1, int(sizes[a:b].sum()))
        where = (units[a][0], units[b - 1][0], sum(u[2] for u in units[a:b]))
        if lang == len(LANGUAGES) or told[a:b, lang].sum() < KNOWN_SHARE * count:
            out.append((None, *where, 0.0))
            continue
        total = scores[a:b, :-1].sum(0) / math.sqrt(count)  # words of a text are not independent
        p = np.exp(total - total.max())
        out.append((LANGUAGES[lang], *where, float(p[lang] / p.sum())))
    return out


_SEGMENTS = "doc_id long, segment int, lang string, first_line int, last_line int, n_chars int, confidence double"


def _segment(shared):
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = segments(model, text) if text else []
                out += [(doc, i, *s) for i, s in enumerate(found)] or [(doc, 0, None, None, None, 0, 0.0)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def fit_model(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = 400, sample_chars: int = 8000) -> Model:
    """Model from at most ``sample_rows`` labelled rows of each language, of at most ``sample_chars`` characters.

    The rows are chosen by a hash of their id; longer texts are not chosen. The bounds hold for fitting only.
    """
    rows = documents.select(label_code(F.col(lang)).alias("code"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h"))
    usable = rows.filter(F.col("code").isNotNull() & F.length("text").between(40, sample_chars))
    order = Window.partitionBy("code").orderBy("h", "text")
    sample = usable.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_rows)
    return fit([(r["code"], r["text"]) for r in sample.select("code", "text").collect()])


def language_segments(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``doc_id, segment, lang, first_line, last_line, n_chars, confidence``: the stretches of each document.

    ``segment`` counts from 0; lines count from 1; ``n_chars`` is the size of the stretch's prose without markers of
    comments and lists; ``confidence`` in 0..1 is the language's share against all others. The label is used for
    fitting only, never for a document itself.

    Defined cases: a null, empty or blank text and one without prose give one row with lang null and confidence 0, and so
    does a stretch that is in none of the model's languages, with its lines and size;
    repeated rows give their segments repeatedly; an empty table gives an empty result; texts are read whole.
    The model is broadcast; its size is bounded by the sample that it is fitted on. Extra columns are never read.
    """
    model = model or fit_model(documents, text, lang, doc_id)
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.grams))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(_segment(shared), _SEGMENTS)


def document_languages(found: DataFrame) -> DataFrame:
    """``doc_id, lang, n_chars, confidence, share``: each language of each document, from its segments."""
    total = F.sum("n_chars").over(Window.partitionBy("doc_id"))
    return (
        found.groupBy("doc_id", "lang")
        .agg(F.sum("n_chars").alias("n_chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.nullif(F.sum("n_chars"), F.lit(0))).alias("confidence"))
        .withColumn("share", F.col("n_chars") / F.nullif(total, F.lit(0)))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    )


def unlabelled_languages(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", lang: str = "lang", least: int = 200, least_cjk: int = 80) -> DataFrame:
    """``doc_id, lang``: languages with at least ``least`` characters of prose that the document's label doesn't name."""
    enough = F.col("n_chars") >= F.when(F.col("lang").isin(*_CJK_LANGUAGES), least_cjk).otherwise(least)
    present = document_languages(found).filter(F.col("lang").isNotNull() & enough)
    labels = documents.select(F.col(doc_id).cast("long").alias("doc_id"), label_code(F.col(lang)).alias("label"))
    return present.join(labels, "doc_id").filter(~F.col("lang").eqNullSafe(F.col("label"))).select("doc_id", "lang").distinct()
