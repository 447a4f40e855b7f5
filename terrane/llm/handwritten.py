"""Telling hand-written source from generated, minified and vendored files and from data saved as code.

Every file is judged by its layout, with thresholds for its kind of language: the longest and the mean line, the share
of white space, letters and digits, the density of numeric literals, lines with long runs of encoded text, and how many of its lines
repeat one pattern. What its comments say about where it comes from and where it lies in the tree come on top,
as a copy of another project's source looks like any other source. A licence says nothing of that kind, and a folder
with an ambiguous name only if it holds whole packages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.tables import latest, spread

# Folders that hold other projects' files, and pairs of folders that do so together.
VENDOR_FOLDERS = frozenset(
    "node_modules bower_components jspm_packages vendor _vendor vendored third_party thirdparty third-party 3rdparty 3rd_party "
    "site-packages dist-packages pods carthage venv .venv virtualenv .tox godeps gopath elm-stuff subprojects".split()
)
VENDOR_PAIRS = frozenset({("contrib", "imported"), ("pkg", "mod")})
# Folders that may hold other projects' files or a project's own, and what lies at the root of a package.
_MAYBE_VENDOR = frozenset("external externals extern deps dependencies contrib".split())
_PACKAGE_ROOT = frozenset("src lib libs include source sources pkg dist build test tests".split())
_VERSIONED_FOLDER = re.compile(r"[\w.\-]*[-_@v]\d+(?:\.\d+)+[\w.\-]*$")

# Names that tools give to what they write.
_GENERATED_NAME = re.compile(
    r"(?:\.pb\.(?:go|py|c|cc|h|js|ts|java|rs|\w+)|_pb2(?:_grpc)?\.pyi?|\.g\.(?:dart|cs)|\.designer\.cs|_gen\.\w+|\.gen\.\w+|\.generated\.\w+|_generated\.\w+"
    r"|_string\.go|\.tab\.\w+|\.yy\.\w+)$|^(?:zz_|y\.tab\.|lex\.yy\.|moc_|ui_|qrc_)\w*",
    re.IGNORECASE,
)
_MINIFIED_NAME = re.compile(r"(?:[.\-_]min\.(?:js|css|mjs)|\.bundle\.js|-[0-9a-f]{8,}\.(?:js|css|mjs))$", re.IGNORECASE)
_VERSIONED_NAME = re.compile(r"^[a-z][\w]*-\d+\.\d+(?:\.\d+)?(?:\.min)?\.\w+$", re.IGNORECASE)

# What tools write above their output, in several languages.
_GENERATED = re.compile(
    r"^\W*(?:"
    r"code generated (?:by|from)\b.*|(?:this (?:file|code|module|source)|the following code) (?:was|is|has been) (?:automatically |auto-?|machine[- ])?generated\b.*"
    r"|(?:auto|machine)[- ]?generated (?:by|from|file|code)\b.*|automatically generated (?:by|from)\b.*|@generated\b.*|<auto-?generated\b.*|generated (?:by|from|with) (?:the )?\S+.*(?:do not|don't|edit|manual|overwritten).*"
    r"|(?:\w+ )?(?:generated|emitted|produced|created|written|rendered|compiled|built|exported)\b.*\b(?:by|from|with|via)\b.*\b(?:do not|don't|never|lost|overwritten|discarded|regenerate)\b.*"
    r"|produced by\b.*\b(?:template|generator|regenerate)\b.*|do not (?:edit|modify)(?: this file| by hand| manually)?\b[\s.!:;,]*(?:generated.*)?"
    r"|diese datei (?:wurde|ist|wird)\b.*\b(?:automatisch|erzeugt|generiert)\b.*|automatisch (?:erzeugt|generiert)\b.*|nicht bearbeiten\b.*"
    r"|(?:ce )?fichier (?:produit|généré|genere|créé)\b.*\bautomatiquement\b.*|généré automatiquement\b.*|(?:este )?archivo (?:generado|creado|producido)\b.*\bautom[aá]ticamente\b.*"
    r"|(?:este )?(?:arquivo|ficheiro) (?:gerado|criado|produzido)\b.*\bautomaticamente\b.*|(?:dit )?bestand (?:is |werd )?automatisch (?:gegenereerd|gemaakt)\b.*|automatisch gegenereerd\b.*"
    r"|.*(?:自动生成|自動生成|機械生成).*"
    r")$",
    re.IGNORECASE,
)
#: Comments that speak about other files, or about generating.
_ABOUT_OTHERS = re.compile(r"\binto (?:every|each|all)\b|\bfiles that\b|\bused here\b|\bby hand\b|\bhand-?written\b|\bwrites? the\b|\bchecks? (?:that|whether|for)\b|[\"“'`]do not edit[\"”'`]|\bmaintained manually\b|\b(?:is|was|are) not generated\b", re.IGNORECASE)
_VENDORED = re.compile(
    r"copied (?:unchanged |verbatim |unmodified )?from\b|\bsee upstream\b|\bupstream\b.*\b(?:report|project|copy|history|source)\b|\breport\w* (?:problems|bugs|issues) upstream\b|\blocal copy\b"
    r"|\bvendored (?:from|copy)\b|^\W*origin(?:al)?(?: source)?:\s*https?://|\bimported from https?://"
    r"|\bkopiert aus\b|\bcopié (?:de|depuis)\b|\bcopiado de\b|\bgekopieerd (?:van|uit)\b",
    re.IGNORECASE,
)
_PRESERVED = re.compile(r"^\s*/\*!\s*\n?\s*\*?\s*[\w.\-@/ ]+\s+v?\d+\.\d+(?:\.\d+)?")

#: A project's name and version at the head of a file.
_BANNER = re.compile(r"(?:\*\s*)?(?P<name>[\w.\-@/]{2,})[ ,]+(?:version )?v?\d+\.\d+(?:\.\d+)?\S*$", re.IGNORECASE)

_COMMENT = re.compile(r"\s*(?://+|#(?!\!|include|define|if|pragma)|/\*+!?|\*+/?|--|;+|<!--|\"\"\"|\'\'\'|%)")
#: What ends a comment of several lines, by its first two characters.
_CLOSED_BY = {"/*": "*/", "<!": "-->", '""': '"""', "''": "'''"}
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])")
_RUN = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}){10,}|[0-9a-fA-F]{48,}")
#: Characters of code under which shares are left to chance.
_LITTLE = 120
_DIGITS = re.compile(r"\d+(?:\.\d+)?")
_WORDS = re.compile(r"[A-Za-z_$][\w$]*")
_QUOTED = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")


@dataclass(frozen=True)
class Limits:
    """Thresholds of one kind of language."""

    longest: int = 400
    mean: float = 110.0
    white: float = 0.07
    numbers: float = 0.30
    runs: float = 0.60
    repeated: float = 0.65
    #: share of letters and digits below which text is scrambled, and above which it is encoded
    alnum: tuple[float, float] = (0.35, 0.90)


#: By extension; what isn't listed has the common ones.
LIMITS = {
    **dict.fromkeys(("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx"), Limits(white=0.08)),
    **dict.fromkeys(("css", "scss", "sass", "less"), Limits(longest=300, mean=90.0, white=0.11, repeated=0.95)),
    "sql": Limits(repeated=0.75, numbers=0.28),
    **dict.fromkeys(("html", "htm", "vue", "svelte"), Limits(longest=1000, mean=200.0, white=0.04)),
}
# Extensions of prose, settings and data, which are told by their name, notes and place only.
_NOT_CODE = frozenset(
    "md markdown mdx rst txt text adoc asciidoc org tex log csv tsv psv json jsonl ndjson json5 yaml yml toml ini cfg conf config properties xml xsd xsl plist "
    "env lock sum mod sample example template tmpl svg rtf po pot srt diff patch".split()
)


@dataclass(frozen=True)
class Layout:
    size: int
    lines: int
    longest: int
    mean: float
    white: float
    alnum: float
    numbers: float
    runs: float
    repeated: float


def layout(text: str) -> Layout:
    """Layout of a text without its comments, of which the long lines would count otherwise."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    code = [x for x in lines if x.strip() and not _COMMENT.match(x)]
    plain = [x for x in code if not _RUN.search(x)] or code  # a key or a checksum among code makes no long line
    body = "\n".join(plain)
    n = len(body)
    if not n:
        return Layout(0, 0, 0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
    numbers = len(_NUMBER.findall(body))
    words = len(_WORDS.findall(_NUMBER.sub("", _QUOTED.sub("", body))))
    shapes = Counter(_DIGITS.sub("0", _QUOTED.sub("''", x)).strip() for x in code if len(x.strip()) > 3)
    most = sum(c for _, c in shapes.most_common(2) if c >= 6)
    return Layout(
        size=sum(map(len, code)),
        lines=len(code),
        longest=max(map(len, plain)),
        mean=n / len(plain),
        white=sum(map(str.isspace, body)) / n,
        alnum=sum(map(str.isalnum, body)) / n,
        numbers=numbers / max(1, numbers + words),
        runs=sum(bool(_RUN.search(x)) for x in code) / len(code),
        repeated=most / max(1, sum(shapes.values())),
    )


def header(text: str) -> list[str]:
    """All comment lines of a text, without their markers; lines inside a block comment count without one."""
    out, inside, string = [], None, None
    for line in text.split("\n"):
        if string:  # a string of several lines
            string = None if string in line else string
            continue
        m = _COMMENT.match(line)
        if not inside and not m:
            string = next((q for q in ('"""', "'''") if line.count(q) % 2), None)
        if inside or m:
            out.append(line[m.end() if m else 0 :].strip().removesuffix("*/").removesuffix("-->").rstrip())
        if inside:
            inside = None if inside in line else inside
        elif m and (close := _CLOSED_BY.get(m.group().strip()[:2])) and close not in line[m.end() :]:
            inside = close
    return out


def _has_banner(comments: list[str]) -> bool:
    """Whether the first comment names a project and its version, and another its address or its licence under that name."""
    said = [c for c in comments if c]
    m = _BANNER.match(said[0]) if said else None
    if m is None:
        return False
    name = m["name"].lower()
    return any(name in c.lower() and re.search(r"https?://|licen[cs]e", c, re.IGNORECASE) for c in said[1:])


def in_vendor_folder(path: str | None) -> bool:
    """Whether a file lies where other projects' files are kept."""
    folders = [x.lower() for x in (path or "").split("/")[:-1]]
    if any(f in VENDOR_FOLDERS for f in folders) or any(p in VENDOR_PAIRS for p in zip(folders, folders[1:], strict=False)):
        return True
    # a package of its own below: a folder with a version, or one with the layout of a project
    return any(
        f in _MAYBE_VENDOR and len(folders) > i + 1 and (_VERSIONED_FOLDER.match(folders[i + 1]) or len(folders) > i + 2 and folders[i + 2] in _PACKAGE_ROOT)
        for i, f in enumerate(folders)
    )


def judge_layout(text: str, extension: str) -> str | None:
    """``generated``, ``minified`` or ``data`` by the layout alone; null for a layout as people write it."""
    if extension in _NOT_CODE or not extension:
        return None
    limits = LIMITS.get(extension, Limits())
    it = layout(text)
    if it.size < _LITTLE:  # too little for shares to say much: only one long line without white space
        return "minified" if it.lines == 1 and it.mean >= 60 and it.white <= limits.white / 2 else None
    if it.runs >= limits.runs and it.lines >= 4:
        return "data"
    if it.lines >= 3 and it.numbers >= limits.numbers and it.repeated >= 0.3 or it.numbers >= 0.6:
        return "data"
    if it.alnum >= limits.alnum[1] and it.mean >= 60:
        return "data"
    if it.lines >= 8 and it.repeated >= limits.repeated:
        return "data" if extension == "sql" or it.numbers >= limits.numbers else "generated"
    if it.white <= limits.white and it.mean >= 60 or it.mean >= limits.mean and it.longest >= limits.longest and it.white <= 0.14:
        return "minified"
    return "minified" if it.alnum <= limits.alnum[0] and it.longest >= limits.longest else None


def judge(path: str | None, name: str | None, text: str | None) -> str | None:
    """``generated``, ``minified``, ``vendored`` or ``data``; null for hand-written files."""
    name = name or (path or "").rsplit("/", 1)[-1]
    if in_vendor_folder(path):
        return "vendored"
    text = text or ""
    comments = header(text) if text else []
    if any(_GENERATED.match(c) and not _ABOUT_OTHERS.search(c) for c in comments):
        return "generated"
    if text and (any(_VENDORED.search(c) and not _ABOUT_OTHERS.search(c) for c in comments) or _PRESERVED.match(text) or _has_banner(comments)):
        return "vendored"
    if _GENERATED_NAME.search(name):
        return "generated"
    if _MINIFIED_NAME.search(name):
        return "minified"
    return judge_layout(text, name.rsplit(".", 1)[-1].lower() if "." in name else "") if text else None


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
        found = [judge(path, name, text) if kind == "file" else None for kind, path, name, text in rows]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["file_id", "version", "kind", "origin"])


def origins(files: DataFrame) -> DataFrame:
    """``file_id, origin`` of each file: generated, minified, vendored, data, or null for hand-written source.

    Of the rows with one id the one with the greatest indexed_at_ns counts, and only if its kind is ``file``; a null id stays out. A file without path, name and content is hand-written, as nothing says otherwise;
    one without content is told by path and name. What is read of a content is all of it. Extra columns are never
    read; an empty table gives an empty result.
    """
    rows = files.filter("id IS NOT NULL").select(
        F.col("id").cast("long").alias("file_id"), F.col("indexed_at_ns").cast("long").alias("version"), "kind", "path", "name", "content_head"
    )
    # judged before the latest row is chosen, so no content is shuffled
    judged = spread(rows).mapInArrow(_judge, "file_id long, version long, kind string, origin string")
    return latest(judged, ["file_id"], "version", ["origin", "kind"]).filter("kind = 'file'").select("file_id", "origin")
