import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm.splitting import boundary_kind, split_oversized, split_text


def spans(text, *limits):
    return [(p.start, p.core, p.end) for p in split_text(text, *limits)]


def boundary_class(text, limit=1200):
    """The definition, counted on the text."""
    stretch = worst_stretch = worst_line = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]:
        if line.strip(" \t\r\n") == "":
            stretch = 0
            continue
        stretch += len(line)
        worst_stretch, worst_line = max(worst_stretch, stretch), max(worst_line, len(line))
    return "blank" if worst_stretch <= limit else "line" if worst_line <= limit else "inside"


def test_small_and_empty_texts():
    assert spans("") == []
    assert spans("abc") == [(0, 0, 3)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x" * 30, "\n", "\n\n", "Ein Satz. ", "的方法。", "é", "👩‍💻", "\r\n", "  \n", "y" * 300]), max_size=120).map("".join))
def test_pieces_cover_the_text_within_the_limit(text):
    pieces = spans(text, 200, 40)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    for (s, c, e), before in zip(pieces, [None, *pieces], strict=False):
        assert e - s <= 200 and 0 <= c - s <= 40 and c < e
        if before is None:
            assert s == c
        else:
            assert s >= before[0]


def test_cuts_at_blank_lines_before_lines_before_words():
    block = "\n".join("line %d of a block" % i for i in range(20)) + "\n"
    text = (block + "\n") * 6
    for _, core, end in spans(text, 1200, 200)[:-1]:
        assert text[core:end].endswith("\n\n")
    long_line = " ".join(["word"] * 600)
    for _, core, end in spans(long_line, 1200, 200)[:-1]:
        assert long_line[end - 1] == " "


def test_overlap_begins_at_a_line():
    text = "".join("line number %04d\n" % i for i in range(300))
    for start, core, _ in spans(text, 1200, 200)[1:]:
        assert 0 < core - start <= 200 and text[start - 1] == "\n"


def test_no_cut_before_a_combining_mark_or_within_a_line_end():
    text = "é" * 2000
    for _, core, _ in spans(text, 1200, 200):
        assert text[core] == "e"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("a\n" * 500 + "\n" + "b\n" * 500, "blank"),
        ("a\n" * 600 + " \t\r\n" + "b\n" * 600, "blank"),
        ("a\n" * 601, "line"),
        ("a" * 1199 + "\n\nb", "blank"),
        ("a" * 1200 + "\n\nb", "inside"),
        ("a" * 1200 + "\n" + "b", "inside"),
        ("a" * 1201, "inside"),
        ("\n" * 1300, "blank"),
    ],
)
def test_boundary_kind(text, kind):
    assert boundary_class(text) == kind
    assert boundary_kind(split_text(text)) == kind


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x" * 30, "\n", "\n\n", "Ein Satz. ", "é", "\r\n", "  \n", "y" * 90, "z" * 99 + "\n", " " * 120 + "\n"]), max_size=80).map("".join))
def test_the_boundaries_that_remain_tell_the_class(text):
    pieces = split_text(text, 100, 20)
    assert boundary_kind(pieces) == (boundary_class(text, 100) if len(text) > 100 else None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "some words, ", "x" * 30, "Ein Satz. ", "的方法。", "é", "y" * 300, "line\n"]), min_size=60, max_size=120).map("".join))
def test_the_overlap_is_given_up_only_for_whole_lines_and_stretches(text):
    limit, overlap = 200, 40
    for p in split_text(text, limit, overlap)[1:]:
        core = text[p.core : p.end]
        if p.end - p.core > limit - overlap:  # a line or stretch of lines of its own
            assert (p.core == 0 or text[p.core - 1] == "\n") and (p.end == len(text) or core.endswith("\n"))


def test_operator(spark):
    body = "".join("line %04d of it\n" % i for i in range(200))
    rows = [(1, "sym", 11, 0, body), (1, "sym", 11, 0, body), (2, None, None, 3, body), (3, "s", 5, 9, "short\ntext\n"), (4, "s", 1, 1, None), (5, "s", 1, 1, ""), (None, "s", 1, 1, body)]
    df = spark.createDataFrame(rows, "id long, symbol string, start_line long, end_line long, content string").selectExpr("*", "id AS chunk_id", "'x' AS piece")
    got = split_oversized(df).orderBy("chunk_id", "ordinal").collect()
    assert {r.chunk_id for r in got} == {1, 2}
    one = [r for r in got if r.chunk_id == 1]
    assert [r.ordinal for r in one] == list(range(len(one))) and {r.symbol for r in one} == {"sym"}
    for r in one:
        first = int(r.piece.split()[1])
        last = int(r.piece.strip().rsplit("\n", 1)[-1].split()[1])
        assert (r.start_line, r.end_line) == (11 + first, 11 + last)
    assert "".join(r.piece[r.n_overlap :] for r in one) == body
    assert all((r.start_line, r.end_line) == (0, 0) for r in got if r.chunk_id == 2)
    whole = {r.chunk_id: r for r in split_oversized(df, keep_small=True).collect() if r.boundary is None}
    assert set(whole) == {3} and (whole[3].start_line, whole[3].end_line, whole[3].piece) == (5, 6, "short\ntext\n")
    assert split_oversized(df.limit(0)).count() == 0
