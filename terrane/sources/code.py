"""Functions of source files, what they call, and chunks along them.

Python is parsed by its own grammar. The other languages are read by a scanner that knows comments, strings and braces
and finds declarations by their form; text that doesn't fit gives no declarations, and then windows are cut instead.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

SIZE, OVERLAP = 1200, 200

#: Extensions whose functions are found, and the family of their syntax.
FAMILIES = {
    **dict.fromkeys((".c", ".h", ".cc", ".cpp", ".hpp", ".cxx"), "c"),
    **dict.fromkeys((".py", ".pyw"), "python"),
    **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs"), "javascript"),
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
}
_KEYWORDS = frozenset("if for while switch catch return sizeof function do else new delete throw await typeof case match loop select defer go range with using foreach synchronized func fn pub import var type struct impl class def".split())
_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(?:\.|::|->)\s*)?([A-Za-z_$][\w$]*)\s*(?:::<[^>]*>)?\(")


@dataclass(frozen=True)
class Chunk:
    symbol: str
    start: int
    end: int
    content: str


@dataclass(frozen=True)
class Definition:
    symbol: str
    start: int
    end: int


@dataclass(frozen=True)
class Reference:
    caller: str
    callee: str
    line: int


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of characters, trimmed, blank ones left out; the last ends with the text."""
    out = []
    for start in range(0, max(len(text), 1), size - overlap):
        piece = text[start : start + size].strip()
        if piece:
            out.append(piece)
        if start + size >= len(text):
            break
    return out


def masked(source: str, family: str) -> str:
    """The source with comments and the insides of strings blanked; places and lines stay."""
    quotes = {"go": "\"`'", "rust": '"', "java": "\"'", "c": "\"'", "javascript": "\"'`"}[family]
    out = list(source)
    at, n = 0, len(source)

    def blank(a: int, b: int) -> None:
        for i in range(a, min(b, n)):
            if out[i] != "\n":
                out[i] = " "

    while at < n:
        two = source[at : at + 2]
        c = source[at]
        if two == "//":
            end = source.find("\n", at)
            end = n if end < 0 else end
            blank(at, end)
            at = end
        elif two == "/*":
            end = source.find("*/", at + 2)
            end = n if end < 0 else end + 2
            blank(at, end)
            at = end
        elif c in quotes:
            end = at + 1
            while end < n and source[end] != c:
                if source[end] == "\\" and not (c == "`" and family == "go"):
                    end += 1
                elif source[end] == "\n" and c != "`" and family != "rust":
                    break
                end += 1
            blank(at + 1, end)
            at = end + 1
        else:
            at += 1
    return "".join(out)


def _closing(text: str, at: int, pair: str = "{}") -> int:
    """Place behind the bracket that closes the one at ``at``; -1 if it stays open."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.end()
    return -1


_DECLARATIONS = {
    "go": re.compile(r"^func\s*(?:\(\s*(?:[A-Za-z_]\w*\s+)?\*?\s*(?P<recv>[A-Za-z_]\w*)[^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(", re.MULTILINE),
    "rust": re.compile(r"(?<![\w.])(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>[A-Za-z_]\w*)", re.MULTILINE),
    "java": re.compile(r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]+>\s+)?(?:[\w.$]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{", re.MULTILINE),
    "javascript": re.compile(r"(?<![\w$.])(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*\("),
    "c": re.compile(r"^[ \t]*(?!typedef|return|else|if|for|while|switch)(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?P<name>[A-Za-z_~][\w:~]*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{", re.MULTILINE),
}


def _functions(source: str, family: str) -> list[tuple[str, str, int, int]]:
    """(name, symbol, start, end) of each function, nested ones too, by place."""
    plain = masked(source, family)
    out = []
    for m in _DECLARATIONS[family].finditer(plain):
        name = m.group("name")
        if name in _KEYWORDS:
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        # the body opens behind the parameters and the result
        at = m.end() - 1 if plain[m.end() - 1] in "({" else plain.find("(", m.end())
        if at < 0:
            continue
        if plain[at] == "(":
            at = _closing(plain, at, "()")
            if at < 0:
                continue
            if family == "go":
                rest = re.compile(r"\s*(?:\([^)]*\)|[\w.*\[\]]+(?:\{\s*\})?)?\s*").match(plain, at)
                at = rest.end()
            body = re.compile(r"[{;]").search(plain, at)
            if body is None or body.group() == ";":
                continue
            at = body.start()
        end = _closing(plain, at)
        if end < 0:
            continue
        receiver = m.groupdict().get("recv")
        out.append((name, f"{receiver}.{name}" if receiver else name, start, end))
    return out


def _go_declarations(source: str) -> list[tuple[str, int, int]] | None:
    """(symbol, start, end) of the declarations of a Go file, in order; null if it isn't one."""
    plain = masked(source, "go")
    if not re.search(r"^\s*package\s+\w+", plain, re.MULTILINE) or plain.count("{") != plain.count("}") or plain.count("(") != plain.count(")"):
        return None
    functions = {start: (symbol, end) for _, symbol, start, end in _functions(source, "go")}
    out = []
    for m in re.finditer(r"^(func|type|var|const|import)\b", plain, re.MULTILINE):
        start = m.start()
        if m.group(1) == "func":
            if start in functions:
                out.append((functions[start][0], start, functions[start][1]))
            continue
        rest = re.compile(r"\s*\(").match(plain, m.end())
        if rest:
            end = _closing(plain, rest.end() - 1, "()")
            inner = (rest.end(), end - 1)
        else:
            # to the end of the line, or of the braces that open on it
            line = plain.find("\n", m.end())
            line = len(plain) if line < 0 else line
            brace = plain.find("{", m.end(), line)
            end = _closing(plain, brace) if brace >= 0 else line
            inner = (m.end(), end)
        if end < 0:
            return None
        out.append((_group_names(m.group(1), source, plain, *inner), start, end))
    return out


def _group_names(kind: str, source: str, plain: str, a: int, b: int) -> str:
    if kind == "import":
        return ",".join(re.findall(r'"([^"]*)"', source[a:b]))
    names: list[str] = []
    depth = 0
    for line in re.finditer(r"[^\n]+", plain[a:b]):
        if depth == 0 and (m := re.match(r"\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)", line.group())):
            names += [x.strip() for x in (m.group(1).split(",") if kind != "type" else [m.group(1).split(",")[0]])]
        depth += sum(line.group().count(x) for x in "{([") - sum(line.group().count(x) for x in "})]")
    return ",".join(names)


def _line(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def code_chunks(source: str, extension: str) -> list[Chunk]:
    """Chunks along declarations: for Go all of them, for other languages the outermost functions; windows otherwise.

    A long declaration is cut into windows that all carry its lines. Windows of a file have line 0 and no symbol.
    """
    pieces: list[tuple[str, int, int, str]] = []
    family = FAMILIES.get(extension)
    if family == "go":
        pieces = [(s, _line(source, a), _line(source, b - 1), source[a:b]) for s, a, b in _go_declarations(source) or []]
    elif family == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        lines = source.split("\n")

        def outermost(node: ast.AST) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                    pieces.append((child.name, child.lineno, child.end_lineno, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
                else:
                    outermost(child)

        if tree is not None:
            outermost(tree)
    elif family:
        until = -1
        for _, symbol, a, b in sorted(_functions(source, family), key=lambda x: (x[2], -x[3])):
            if a >= until:
                pieces.append((symbol.rsplit("::", 1)[-1], _line(source, a), _line(source, b - 1), source[a:b]))
                until = b
    out = [Chunk(s, a, b, w) for s, a, b, text in pieces for w in windows(text)]
    return out or [Chunk("", 0, 0, w) for w in windows(source)]


def symbols(source: str, extension: str) -> tuple[list[Definition], list[Reference]]:
    """Functions (each name once a line) and the calls within and outside of them."""
    family = FAMILIES.get(extension)
    if family is None:
        return [], []
    if family == "python":
        return _python_symbols(source)
    found = _functions(source, family)
    plain = masked(source, family)
    definitions = {(name, _line(source, a)): Definition(name, _line(source, a), _line(source, b - 1)) for name, _, a, b in found}
    declared = {m for name, _, a, b in found for m in [plain.find(name, a)]}
    references = []
    for m in _CALL.finditer(plain):
        callee = m.group(2)
        if callee in _KEYWORDS or m.start(2) in declared:
            continue
        inside = [(a, name) for name, _, a, b in found if a <= m.start() < b]
        references.append(Reference(max(inside)[1] if inside else "", callee, _line(source, m.start(2))))
    return list(definitions.values()), references


def _python_symbols(source: str) -> tuple[list[Definition], list[Reference]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    definitions: dict[tuple[str, int], Definition] = {}
    references: list[Reference] = []

    def walk(node: ast.AST, caller: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = caller
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                definitions.setdefault((child.name, child.lineno), Definition(child.name, child.lineno, child.end_lineno))
                inner = child.name
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    references.append(Reference(caller, name, child.lineno))
            walk(child, inner)

    walk(tree, "")
    return list(definitions.values()), references
