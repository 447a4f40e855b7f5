"""Texts of a megabyte that would take hours if any step were more than about proportional to the length."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import handwritten, language, leakage, secrets, splitting

MB = 400_000
TEXTS = {
    "one word": "a" * MB,
    "quoted word": 'key = "' + "a" * MB,
    "key word": "key" * (MB // 3),
    "names": "token." * (MB // 6) + '"',
    "hyphens": '"' + "a-" * (MB // 2),
    "curl": "curl " * (MB // 5),
    "urls": "http://x:y" * (MB // 10),
    "links": "](a" * (MB // 3),
    "tags": "<a " * (MB // 3),
    "blanks": "// " + " " * MB,
    "spaces": "a " * (MB // 2),
    "words and numbers": 'password = "' + "aa-bb-" * (MB // 6) + '9"',
    "begin": "-----BEGIN PRIVATE KEY-----\n" * (MB // 28),
    "base64": "QUJD" * (MB // 4),
    "lines": "x\n" * (MB // 2),
    "digits": "1" * MB,
    "han": "的" * MB,
    "marks": "e" + "\u0301" * MB,
    "quotes": '"\'`' * (MB // 3),
    "brackets": "([{<" * (MB // 4),
    "assignments": "password=a1B!c;" * (MB // 15),
}


@pytest.fixture(scope="module")
def model():
    return language.fit([("en", "The file is in the index and it was not there before the next run of the table. " * 3)])


@pytest.fixture(scope="module")
def index():
    return leakage.make_indexes([(1, " ".join(f"w{i}" for i in range(80)))], False)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_takes_seconds(name, model, index):
    text = TEXTS[name]
    began = time.process_time()
    secrets.redact(text, secrets.find_credentials(text))
    handwritten.judge("/r/a.py", "a.py", text)
    language.segments(model, text)
    words = leakage.words(leakage.normalise(text))
    leakage.matches(index, words, words)
    pieces = splitting.split_text(text)
    assert all(p.end - p.start <= 1200 for p in pieces)
    assert time.process_time() - began < 25


_PIECES = ["password", "=", ":", '"', "'", "`", "key", "\n", "\r\n", " ", "\t", "#", "//", "/*", "*/", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "aB3xYz9Qw", "${", "}", "{{", "://", "@", "的方法", "かな", "İ", "ß", "́", "\x00", "😀", "0x1f", "12.5", ">", "|", "```", "---\n", "<b>", "](", ")", "(", "\\", "é", "A.", "the index is not ready. ", "，。", "eyJ", ";"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=60).map("".join))
def test_any_text_is_taken(text):
    found = secrets.find_credentials(text)
    out = secrets.redact(text, found)
    assert (out == text) == (not found) or found
    assert all(0 <= a < b <= len(text) for f in found for a, b in f.spans)
    for name in ("a.py", "a.css", "a.sql", "a.md", "a.js"):
        assert handwritten.judge(f"/r/{name}", name, text) in (None, "generated", "minified", "vendored", "data")
    for _, first, last, size, confidence in language.segments(_MODEL, text):
        assert 1 <= first <= last <= text.count("\n") + text.count("\r") + 1 and size > 0 and 0 <= confidence <= 1
    normal = leakage.normalise(text)
    leakage.is_cjk(normal), leakage.words(normal), leakage.characters(normal)
    assert "".join(text[p.core : p.end] for p in splitting.split_text(text, 20, 5)) == text


_MODEL = language.fit([("en", "The file is in the index and it was not there before the next run of the table. " * 3)])
