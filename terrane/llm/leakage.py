"""Evaluation texts that stand, wholly or partly, in a corpus.

The evaluation items form a BM25 inverted index whose postings are cut into blocks of items, each with the greatest
impact it can give. Every document asks the index with each of its passages. A passage is dropped as soon as the sum
of its terms' greatest impacts stays under the threshold; of the rest only blocks whose own bound reaches it are
scored (block-max WAND, retrieving all above a threshold instead of the best k). What is retrieved is verified word by
word: the item must share a passage with the document in order, with few changes.

Items of like length share an index, so that a long one doesn't widen the passages that the others are asked with. The
indexes of a block of items have a bounded size and are broadcast; more items than that are asked block after block.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.tables import spread

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_HAS_CJK = re.compile(f"[{_CJK}\U00020000-\U0003ffff]")
_WORD = re.compile(f"[^\\W_{_CJK}\U00020000-\U0003ffff]+")
_ALNUM = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][\w:.-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*\s*/?>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_MARKS = re.compile("[­̀-ͯ​-‏⁠︀-️﻿'‘’ʼ`´‐‑-]")
_ASCII_MARKS = str.maketrans("", "", "'`-")
#: Signs of ASCII that no word holds, as spaces.
_ASCII_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}


def normalise(text: str) -> str:
    """Text without what isn't counted as a change: markup, letter case, marks, Unicode form, apostrophes and hyphens."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if text.isascii():
        return text.lower().translate(_ASCII_MARKS)
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold())


def is_cjk(normal: str) -> bool:
    """Whether a text is told by characters instead of words."""
    letters = sum(map(len, _ALNUM.findall(normal)))
    return len(_HAS_CJK.findall(normal)) * 3 >= max(1, letters)


def words(normal: str) -> list[str]:
    return normal.translate(_ASCII_GAPS).split() if normal.isascii() else _WORD.findall(normal)


def characters(normal: str) -> str:
    return "".join(_ALNUM.findall(normal))


def _bigrams(chars: str) -> list[str]:
    return list(map(add, chars, chars[1:]))


@dataclass
class Index:
    """BM25 index of some items, told by words or by characters."""

    ids: list[int]
    tokens: list
    positions: list[dict] = field(default_factory=list)
    block: int = 16
    least: float = 0.45
    changed: float = 0.10
    #: terms that one changed token spoils: a word one, a character two bigrams
    spoils: int = 1
    #: term -> its number
    terms: dict[str, int] = field(default_factory=dict)

    def build(self, term_lists: list[list[str]], k1: float = 1.2, b: float = 0.75) -> Index:
        n = len(term_lists)
        sizes = [len(t) for t in term_lists]
        average = max(1.0, sum(sizes) / max(1, n))
        postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, terms in enumerate(term_lists):
            for t, tf in Counter(terms).items():
                postings[t].append((i, tf))
        items, impacts, starts = [], [], [0]
        weights: list[dict[str, float]] = [{} for _ in range(n)]
        for t, found in postings.items():
            self.terms[t] = len(self.terms)
            idf = math.log(1 + (n - len(found) + 0.5) / (len(found) + 0.5))
            for i, tf in found:
                w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[i] / average))
                items.append(i)
                impacts.append(w)
                weights[i][t] = w
            starts.append(len(items))
        self.items, self.impacts, self.starts = np.array(items, np.int64), np.array(impacts, np.float32), np.array(starts)
        self.window = max(96, math.ceil(0.9 * max((len(t) for t in self.tokens), default=0)))
        self.needed = np.array([self._needed(t, w) for t, w in zip(term_lists, weights, strict=True)], np.float32)
        # per term and block of items: the greatest impact, and where its postings lie
        blocks, bounds, at, block_starts = [], [], [], [0]
        for i in range(len(self.terms)):
            a, z = self.starts[i], self.starts[i + 1]
            own_blocks = self.items[a:z] // self.block
            first = np.flatnonzero(np.r_[True, own_blocks[1:] != own_blocks[:-1]])
            blocks.append(own_blocks[first])
            bounds.append(np.maximum.reduceat(self.impacts[a:z], first))
            at.append(np.stack([a + first, a + np.r_[first[1:], z - a]], 1))
            block_starts.append(block_starts[-1] + len(first))
        self.blocks = np.concatenate(blocks) if blocks else np.empty(0, np.int64)
        self.bounds = np.concatenate(bounds) if bounds else np.empty(0, np.float32)
        self.ranges = np.concatenate(at) if at else np.empty((0, 2), np.int64)
        self.block_starts = np.array(block_starts)
        self.n_blocks = -(-n // self.block) if n else 0
        self.least_of_block = np.array([self.needed[i * self.block : (i + 1) * self.block].min() for i in range(self.n_blocks)], np.float32)
        for tokens in self.tokens:
            where: dict = defaultdict(list)
            for p, t in enumerate(tokens):
                where[t].append(p)
            self.positions.append(dict(where))
        return self

    def _needed(self, terms: list[str], weights: dict[str, float], whole: int = 400) -> float:
        """The least score that a passage of :meth:`retrieve` has if it holds what counts as a passage of an item.

        For each number of spoilt terms the shortest stretch of the item that allows it, without its heaviest terms;
        longer stretches have no less. The heaviest terms of the whole item are taken where an item is longer than
        ``whole``, which gives a lower score and loses nothing.
        """
        size, step = len(terms) + self.spoils - 1, self.window // 2
        w = np.array([weights[t] for t in terms])
        seen: dict[str, int] = {}
        before = np.empty(len(terms), np.int64)
        for p, t in enumerate(terms):
            before[p] = seen.get(t, -1)
            seen[t] = p
        heaviest = np.r_[0.0, np.cumsum(sorted(weights.values(), reverse=True))]
        rate, shortest = self.spoils * self.changed, max(1, math.ceil(self.least * size - 1e-9))
        best = math.inf
        first, most = math.floor(rate * shortest + 1e-9), math.floor(rate * size + 1e-9)
        steps = list(range(first, most + 1))
        if len(terms) > whole:  # numbers near each other together, with the length of the least and the changes of the greatest
            steps = sorted({min(most, int(first * 1.1**i + i)) for i in range(200)} | {first})
        for spoilt, next_ in zip(steps, [*steps[1:], most + 1], strict=True):
            length = max(shortest, math.ceil(spoilt / rate - 1e-9)) if spoilt else shortest
            # with words put in it may be longer than two cells always hold; then one pair holds all but half of the rest
            there = math.ceil(length * (1 + 2 * self.changed))
            length -= max(0, math.ceil((there - step) / 2)) if there > step + 1 else 0
            length -= self.spoils - 1
            if length <= spoilt:
                return 0.0
            places = np.arange(len(terms) - length + 1)[:, None]
            if len(terms) <= whole:
                at = places + np.arange(length)
                own = np.where(before[at] < places, w[at], 0.0)
                kept = np.partition(own, length - spoilt - 1, axis=1)[:, : length - spoilt].sum(1)
            else:
                # a term counts in the stretches that start after its last place and hold this one
                at = np.arange(len(terms))
                starts = np.maximum(np.maximum(before + 1, at - length + 1), 0)
                change = np.bincount(starts, w, len(terms) + 1) - np.bincount(at + 1, w, len(terms) + 1)
                kept = np.cumsum(change)[: len(places)] - heaviest[min(next_ - 1, len(heaviest) - 1)]
            best = min(best, float(kept.min()))
        return max(0.0, best * 0.9999)

    def retrieve(self, terms: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, items) of each passage of a document that reaches the threshold of some items.

        A passage is two neighbouring cells of half its length. A cell's bounds count each of its terms once.
        """
        step = self.window // 2
        known = np.fromiter(map(self.terms.get, terms, repeat(-1)), np.int64, len(terms))
        at = np.flatnonzero(known >= 0)
        cells = max(2, -(-len(terms) // step))
        width = len(self.terms)
        pairs = _distinct(at // step * width + known[at])
        cell, number = pairs // width, pairs % width
        entries, owner = _spans(self.block_starts[number], self.block_starts[number + 1])
        bound = np.bincount(cell[owner] * self.n_blocks + self.blocks[entries], self.bounds[entries], cells * self.n_blocks)
        bound = bound.reshape(cells, self.n_blocks)
        live = bound[:-1] + bound[1:] >= self.least_of_block
        asked = np.flatnonzero(live.any(1))
        if not len(asked):
            return
        at_cell = np.searchsorted(cell, np.arange(cells + 1))
        n = len(self.ids)
        together = max(1, SCORES // n)  # passages are scored side by side, so many that their scores are bounded
        for first in range(0, len(asked), together):
            some = asked[first : first + together]
            p, of = _spans(at_cell[some], at_cell[some + 2])  # the pairs are in the order of their cells
            own = _distinct(of * width + number[p])
            of, own = own // width, own % width
            e, owner = _spans(self.block_starts[own], self.block_starts[own + 1])
            of = of[owner]
            kept = live[some[of], self.blocks[e]]
            of, ranges = of[kept], self.ranges[e[kept]]
            hits, owner = _spans(ranges[:, 0], ranges[:, 1])
            score = np.bincount(of[owner] * n + self.items[hits], self.impacts[hits], len(some) * n).reshape(-1, n)
            reached, picked = np.nonzero((score >= self.needed) & (score > 0))
            cuts = np.flatnonzero(reached[1:] != reached[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(reached)], strict=True):
                if a < z:
                    c = int(some[reached[a]])
                    yield c * step, (c + 2) * step, picked[a:z]


#: So many scores of passages by items are held at once.
SCORES = 1 << 19


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The numbers in order, each once."""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all the ranges, one after another, and of which range each is."""
    sizes = ends - starts
    owner = np.arange(len(sizes)).repeat(sizes)
    return np.arange(len(owner)) + (starts - sizes.cumsum() + sizes).repeat(sizes), owner


#: Greatest length of an item in the first group of like lengths, and how many times longer each further group may be.
_GROUP, _WIDER = 320, 4


def make_indexes(items: list[tuple[int, str]], cjk: bool, least: float = 0.45, changed: float = 0.10) -> list[Index]:
    """An index for each group of items of like length."""
    groups: dict[int, list] = defaultdict(list)
    for item, text in items:
        normal = normalise(text or "")
        if is_cjk(normal) == cjk:
            tokens = characters(normal) if cjk else words(normal)
            if len(tokens) > 1:
                groups[max(0, math.ceil(math.log(len(tokens) / _GROUP, _WIDER)))].append((item, tokens))
    out = []
    for _, chosen in sorted(groups.items()):
        chosen.sort(key=lambda x: len(x[1]))  # blocks of items with like thresholds
        index = Index([i for i, _ in chosen], [t for _, t in chosen], least=least, changed=changed, spoils=2 if cjk else 1)
        out.append(index.build([_bigrams(t) if cjk else t for _, t in chosen]))
    return out


def passage(where: dict, size: int, tokens, lo: int, hi: int, least: float = 0.45, changed: float = 0.10) -> float:
    """The largest share of an item that ``tokens[lo:hi]`` holds in order with at most ``changed`` changed or missing.

    0 if it stays under ``least``. Runs of equal words are chained; between two runs, the words of the item that are
    skipped are changes, and extra words of the document count half.
    """
    # with c changes and as many extra words the rest falls into at most 2 c + 1 runs
    shortest = least * size
    run_length = (1 - changed) * shortest / (2 * changed * shortest + 1)
    # a run is a stretch of words that the item has, each of them
    if b"\1" * max(3, math.ceil(run_length)) not in bytes(map(where.__contains__, tokens[lo:hi])):
        return 0.0
    runs: dict[int, list[int]] = {}  # diagonal -> [item start, item end, document start] of its open run
    done: list[tuple[int, int, int]] = []
    for d, at in enumerate(map(where.get, tokens[lo:hi]), lo):
        if at is None:
            continue
        for i in at:
            run = runs.get(d - i)
            if run is not None and run[1] == i:
                run[1] = i + 1
            else:
                if run is not None:
                    done.append((run[2], run[0], run[1]))
                runs[d - i] = [i, i + 1, d]
    done += [(r[2], r[0], r[1]) for r in runs.values()]
    long = [r for r in done if r[2] - r[1] >= 3]
    if not long or max(r[2] - r[1] for r in long) < run_length or sum(r[2] - r[1] for r in long) < (1 - 3 * changed) * shortest:
        return 0.0
    done = sorted(r for r in done if r[2] - r[1] >= 2)
    best = 0.0
    budget = changed * size + 1
    n = len(done)
    for a in range(n):
        d0, i0, i1 = done[a]
        if i1 - i0 < 3:
            continue
        # cheapest way to each later run, from this one on
        cost = {a: 0.0}
        for x in range(a, n):
            c = cost.get(x)
            if c is None:
                continue
            dx, ix, jx = done[x]
            end = dx + jx - ix
            length = jx - i0
            if c <= changed * length and length >= least * size:
                best = max(best, length / size)
            for y in range(x + 1, n):
                dy, iy, jy = done[y]
                if dy > end + budget + 12:
                    break
                if iy < i0 or iy - jx > budget:
                    continue
                cut = max(0, jx - iy, end - dy)
                if iy + cut >= jy:
                    continue
                gap, extra = iy + cut - jx, dy + cut - end
                step = c + gap + 0.5 * max(0, extra - gap)
                if step <= budget and step < cost.get(y, math.inf):
                    cost[y] = step
    return best


def matches(indexes: list[Index], tokens, terms: list[str], least: float = 0.45, changed: float = 0.10) -> dict[int, float]:
    """Ids of the items that a document holds, with their shares."""
    out: dict[int, float] = {}
    if len(terms) < 2:
        return out
    for index in indexes:
        found: dict[int, float] = {}
        slack = index.window // 2 + 8  # what a passage may go on beyond the one that was asked
        for start, end, picked in index.retrieve(terms):
            for i in picked.tolist():
                if found.get(i, 0.0) < 0.999:
                    lo, hi = max(0, start - slack), min(len(tokens), end + slack)
                    share = passage(index.positions[i], len(index.tokens[i]), tokens, lo, hi, least, changed)
                    if share > found.get(i, 0.0):
                        found[i] = share
        for i, share in found.items():
            out[index.ids[i]] = max(share, out.get(index.ids[i], 0.0))
    return out


def _find(shared, least: float, changed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_char = shared.value
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                normal = normalise(text)
                tokens = words(normal)
                out += [(doc, i, s) for i, s in matches(by_word, tokens, tokens, least, changed).items()]
                if by_char and not normal.isascii() and _HAS_CJK.search(normal):
                    chars = characters(normal)
                    out += [(doc, i, s) for i, s in matches(by_char, chars, _bigrams(chars), least, changed).items()]
            docs, items, shares = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "share"])

    return run


def _packed(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Ids in blocks of at most ``most`` characters; an item beyond that is a block of its own."""
    out: list[list[int]] = []
    room = 0
    for item, size in sizes:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(item)
        room -= size
    return out


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.45,
    changed: float = 0.10,
    block_chars: int = 20_000_000,
) -> DataFrame:
    """``doc_id, item_id, share``: every document with every item of which it holds at least ``least`` as one passage.

    The share is counted in words, for texts in Chinese or Japanese script in characters; at most ``changed`` of the
    passage may be changed or missing. Letter case, punctuation, markup, layout and Unicode form don't count. A
    passage is verified if its BM25 score is one that a passage that meets ``least`` and ``changed`` can have.

    Defined cases: null and empty texts hold nothing and are held by nothing; repeated documents or items give one
    row for each pair of ids; an item of a single word is never reported; documents are read whole, however long.
    Items are collected in blocks of at most ``block_chars`` characters, so that what is broadcast is bounded.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    docs = spread(docs)
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL AND text <> ''").distinct()
    sizes = known.groupBy("item_id").agg(F.sum(F.length("text")).alias("size")).sort("item_id")
    blocks = _packed([(r["item_id"], r["size"]) for r in sizes.collect()], block_chars)  # two numbers an item
    results = []
    for block in blocks or [[]]:
        own = known if len(blocks) < 2 else known.filter(F.col("item_id").between(block[0], block[-1]))
        rows = [(r["item_id"], r["text"]) for r in own.sort("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast((make_indexes(rows, False, least, changed), make_indexes(rows, True, least, changed)))
        results.append(docs.mapInArrow(_find(shared, least, changed), "doc_id long, item_id long, share double"))
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
