import random

import pytest

from terrane.llm import leakage as L

_rng = random.Random(2)
WORDS = ["".join(_rng.choice("abcdefghijklmnoprstuvz") for _ in range(_rng.randrange(3, 9))) for _ in range(900)]
HAN = [chr(0x4E00 + i) for i in range(0, 1600, 2)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def han(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(HAN) for _ in range(n))


ITEMS = [(i, text(60 + i % 20, i)) for i in range(40)] + [(100 + i, han(120, i)) for i in range(5)]


def held(document, items=None):
    rows = items or ITEMS
    w, c = L.make_indexes(rows, False), L.make_indexes(rows, True)
    n = L.normalise(document)
    tokens, chars = L.words(n), L.characters(n)
    return set(L.matches(w, tokens, tokens)) | set(L.matches(c, chars, L._bigrams(chars)))


def around(passage):
    return text(150, "before") + "\n\n" + passage + "\n\n" + text(150, "after")


def test_whole_and_partial_passages():
    item = ITEMS[3][1].split()
    n = len(item)
    assert held(around(" ".join(item))) == {3}
    for share, found in ((0.6, True), (0.5, True), (0.4, False), (0.2, False)):
        for at in (0, n - int(n * share)):
            assert held(around(" ".join(item[at : at + int(n * share)]))) == ({3} if found else set())


@pytest.mark.parametrize("changed", [0, 2, 4, 12, 20])
def test_changed_words(changed):
    item = ITEMS[7][1].split()
    for seed in range(5):
        r = random.Random(seed)
        copy = list(item)
        for i in r.sample(range(len(item)), changed):
            copy[i] = "changedword"
        if changed / len(item) <= 0.08:
            assert held(around(" ".join(copy))) == {7}
        elif changed / len(item) > 0.25:
            assert held(around(" ".join(copy))) == set()


def test_missing_words_and_shuffled_words():
    item = ITEMS[9][1].split()
    assert held(around(" ".join(w for i, w in enumerate(item) if i % 15 != 7))) == {9}
    mixed = list(item)
    random.Random(0).shuffle(mixed)
    assert held(around(" ".join(mixed))) == set()


def test_layout_markup_case_and_unicode_do_not_count():
    words = ITEMS[11][1].split()
    shapes = [
        "\n".join("// " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6)),
        "\r\n".join("> **" + " ".join(words[i : i + 7]) + "**" for i in range(0, len(words), 7)),
        " ".join(w.upper() + "," for w in words),
        "<p>" + "</p><p>".join(words) + "</p>",
        " ".join(f"[{w}](https://x.example/{i})" for i, w in enumerate(words)),
        " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in words),
        " ".join(w[:2] + "\u00ad" + w[2:] for w in words),
        "| " + " | ".join(words) + " |",
    ]
    for s in shapes:
        assert held(around(s)) == {11}, s[:60]


def test_apostrophes_and_hyphens_are_punctuation():
    item = (1, "l'intendant avait dit qu'aucune vanne n'avait annoncera-t-il " + text(20, "x"))
    assert held("avant " + item[1].replace("'", "").replace("-", "") + " apres", [item, *ITEMS]) == {1}


def test_chinese_is_told_by_characters():
    item = ITEMS[42][1]
    assert held(han(100, "a") + "\n# " + item[:60] + "\n# " + item[60:] + han(100, "b")) == {102}
    assert held(han(100, "a") + item[30:95] + han(100, "b")) == {102}
    assert held(han(100, "a") + item[:40] + han(100, "b")) == set()
    assert held(han(100, "a") + "".join(c for i, c in enumerate(item) if i % 14) + han(100, "b")) == {102}


def test_against_brute_force_with_pieces_of_many_items():
    """Every document made of random pieces; the longest common run in order decides."""
    for seed in range(25):
        r = random.Random(seed)
        parts, want = [], set()
        for item, whole in r.sample(ITEMS[:40], 4):
            words = whole.split()
            share = r.choice([0.15, 0.3, 0.55, 0.8, 1.0])
            size = int(len(words) * share)
            at = r.randrange(len(words) - size + 1)
            parts.append(" ".join(words[at : at + size]))
            if size >= 0.45 * len(words):
                want.add(item)
        assert held("\n\n".join(f"{text(30, f"{seed} {i}")} {p}" for i, p in enumerate(parts))) == want


@pytest.mark.parametrize("cjk", [False, True])
def test_passages_of_little_weight(cjk):
    """The shortest passage, of the item's most common tokens and with one in ten changed, is found."""
    common = [chr(0x8000 + i) for i in range(60)] if cjk else [f"common{i}" for i in range(60)]
    rare = list(han(80, "rare")) if cjk else text(80, "rare").split()
    join = "".join if cjk else " ".join
    items = [(1, join(common + rare))] + [(10 + i, join(common + (list(han(80, i)) if cjk else text(80, i).split()))) for i in range(12)]
    passage = common + rare[:6]
    for i in range(5, 60, 10):
        passage[i] = "\u9fa0" if cjk else "changedword"
    assert 1 in held(join(passage), items)


def test_retrieval_loses_nothing_that_the_verifier_accepts():
    """Items of common words first and specific ones last; documents hold their beginnings, of which few words weigh anything."""
    r = random.Random(31)
    common = [f"the{i}" for i in range(40)]
    items = [(i, " ".join([r.choice(common) for _ in range(50)] + text(50, f"own {i}").split())) for i in range(260)]
    indexes = L.make_indexes(items, False)
    asked = accepted = 0
    for i in r.sample(range(260), 50):
        own = items[i][1].split()
        for share, edits in ((0.48, 0), (0.5, 4), (0.46, 1)):
            part = own[: round(share * 100)]
            for at in r.sample(range(len(part)), edits):
                part[at] = "changedword"
            tokens = (text(120, f"b{i}") + " " + " ".join(part) + " " + text(120, f"a{i}")).split()
            got = L.matches(indexes, tokens, tokens)
            want = {n for x in indexes for k, n in enumerate(x.ids) if L.passage(x.positions[k], len(x.tokens[k]), tokens, 0, len(tokens)) > 0}
            assert set(got) == want
            asked += 1
            accepted += i in want
    assert accepted >= 0.97 * asked


def test_a_long_item_does_not_widen_the_passages_of_others():
    items = [*ITEMS[:5], (900, text(4_000, "book"))]
    indexes = L.make_indexes(items, False)
    assert [x.window for x in indexes] == [96, 3_600]
    assert held(around(ITEMS[2][1]) + " " + text(2_000, "book"), items) == {2, 900}


def test_markup_of_any_length():
    words = ITEMS[6][1].split()
    tag = "<a " + " ".join(f'data-{i}="value {i}"' for i in range(80)) + ">"
    assert held(around(f" {tag} ".join(words))) == {6}
    assert held(around(" ".join(f"[{w}](https://x.example/{'p' * 900})" for w in words))) == {6}
    assert L.words(L.normalise("if a < b and c, then d > e")) == "if a b and c then d e".split()


def test_items_are_packed_within_the_bound():
    assert L._packed([(1, 5), (2, 5), (3, 1), (4, 30), (5, 2)], 10) == [[1, 2], [3], [4], [5]] and L._packed([], 9) == []


def test_operator(spark):
    docs = [(1, around(ITEMS[0][1])), (2, text(400, "none")), (3, None), (4, ""), (5, ITEMS[1][1] + "\n" + ITEMS[2][1]), (5, ITEMS[1][1]), (6, text(20_000, "long") + " " + ITEMS[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7L AS item_id", "'x' AS share")
    items = spark.createDataFrame([*ITEMS, ITEMS[0], (200, None), (201, ""), (202, "word")], "item_id long, text string").selectExpr("*", "1L AS doc_id")
    want = {(1, 0), (5, 1), (5, 2), (6, 4)}
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(df, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(df, items, block_chars=3000).collect()} == want
    assert L.leaked_items(df.limit(0), items).count() == 0 and L.leaked_items(df, items.limit(0)).count() == 0


def test_passages_of_a_document_are_scored_together(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(60)) for _ in range(40)]
    index = L.make_indexes(list(enumerate(texts)), False)[0]
    terms = L.words(L.normalise(" ".join(rng.choice(texts) for _ in range(300))))
    calls = []
    plain = L._spans
    monkeypatch.setattr(L, "_spans", lambda *a: (calls.append(1), plain(*a))[1])
    together = list(index.retrieve(terms))
    assert len(together) > 100 and len(calls) < 20  # not some for each passage
    monkeypatch.setattr(L, "SCORES", 1)  # one passage at a time
    alone = list(index.retrieve(terms))
    assert [(a, z, p.tolist()) for a, z, p in alone] == [(a, z, p.tolist()) for a, z, p in together]


def test_words_of_ascii_are_those_of_the_pattern():
    text = "".join(map(chr, range(128))) + " It's a`b-c d_e 1.5\x1cx\x85"
    for t in (text, text.encode("ascii", "ignore").decode()):
        normal = L.normalise(t)
        assert L.words(normal) == L._WORD.findall(normal)
    assert L.normalise("It's `b-C`") == "its bc"
