"""Credentials in source code and configuration, found and redacted.

Strings and long tokens of any length are measured by Shannon entropy against what a random string of their alphabet and
length would have. What they are called, and the form they are given in, moves the threshold: a value that is called a
password needs little entropy, one that is called a hash, an id or a public key never counts, and an unnamed token
must look random and be no row of data. Placeholders and references to where a value is kept are no credentials. A few
issuers' tokens and private key blocks are told by their published form.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.tables import spread

# Published forms of tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"A(?:KIA|SIA)[0-9A-Z]{16}"
    r"|AIza[0-9A-Za-z_\-]{32,40}"
    r"|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{40,}|glpat-[0-9A-Za-z_\-]{20,}"
    r"|xox[abeoprs]-[0-9A-Za-z\-]{16,}"
    r"|npm_[0-9A-Za-z]{30,}|pypi-[0-9A-Za-z_\-]{30,}"
    r"|(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}|sk-[0-9A-Za-z_\-]{20,}"
    r"|SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}|hf_[0-9A-Za-z]{30,}|dop_v1_[0-9a-f]{64}|ya29\.[0-9A-Za-z_\-]{20,}"
    r"|eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}"
    r")(?![A-Za-z0-9_])"
)
# Words in names of passwords, in several languages.
_PASSWORD = (
    "password passwd passphrase passcode pass pwd passwort kennwort geheim motdepasse passe contrasena contraseña clave senha "
    "wachtwoord parola mdp mima kouling himitsu haslo hasło heslo losenord lösenord passord adgangskode salasana jelszo jelszó sifre şifre пароль 密码 密碼 口令 パスワード 暗証番号"
).split()
# Words in names of other credentials.
_STRONG = "secret secrets credential credentials cred creds apikey authtoken secretkey accesskey privatekey geheimnis schluessel schlüssel zugangsschluessel zugangsschlüssel chave llave sleutel toegangssleutel jeton miyao 密钥 秘密".split()
_WEAK = "token tokens key keys auth bearer session cookie jwt pat sas seed otp totp hotp pepper mnemonic".split()
# Keys in languages that put the noun first.
_FOREIGN_KEY = frozenset("cle clé clef clave chave llave chiave schluessel schlüssel sleutel jeton ficha token".split())
_FOREIGN_OF = frozenset("api acces accès acceso acesso accesso privee privée privada privata secrete secrète secreta segreta".split())
#: What makes a key or token a credential.
_KEY_OF = "api access auth private signing sign encryption encrypt hmac master shared account storage service deploy client app secret aes session jwt webhook license admin root".split()
# Words that say that a value is something else.
_OTHER = (
    "public pub hash sha sha1 sha256 sha512 md5 crc integrity checksum digest etag commit revision rev fingerprint thumbprint uuid guid "
    "correlation request trace span build built version kind type name names column field fields label title path file dir url uri host "
    "endpoint limit count length size max min ttl expiry expires timeout algorithm alg scope env prefix suffix header param format policy "
    "id ids index cache primary foreign sort partition prompt hint reset next prev page cursor ssh "
    "icon image img png svg font wasm blob base64 b64 data"
).split()
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.\-_#?0]+|.*(?:your|insert|change[-_ ]?me|replace|placeholder|example|dummy|todo|fixme|redacted|sample|fake|not[-_]?a[-_]?real|my[-_](?:token|key|secret|password)).*"
    r"|<.*>|\{.*\}|\$\{.*|\$\(.*|\$[A-Z_][A-Z0-9_]*|%\(.*|%[A-Z0-9_]+%|\{\{.*|#\{.*|env:.*|vault:.*|file:.*|ssm:.*|secretsmanager:.*|op:.*|ref[+:].*|arn:.*|\./.*|@[a-z][a-z._\-]*"
    r"|(?:os|process|system|env|config|settings|secrets|vault)\..*|(?:get)?env\(.*|null|none|nil|true|false|undefined|test|secret|password|passwd|token|key|string|n/a|hidden)$"
)
_WORDS_ONLY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_ ./:](?:[A-Z]?[a-z]+|[A-Z]+))*$")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_NOT_SECRET = re.compile(r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-\S+)\s+AAAA|sha(?:1|256|384|512)[-:]|data:|-----BEGIN (?:RSA |EC )?PUBLIC|urn:")

_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_OTHER_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.DOTALL)
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")

#: A URL up to its password, and what a password may be made of.
_URL = re.compile(r"\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/@\"'`<>]*:", re.IGNORECASE)
_URL_PASSWORD = re.compile(r"[^\s@\"'`<>]+")
_HOST = re.compile(r"@[A-Za-z0-9\[\-.]")
_HEADER = re.compile(r"\b(?:proxy-)?authorization\b[\"']?\s*[:=,]\s*[\"']?\s*(?:bearer|basic|token|digest|apikey)\s+([^\s\"'`,;]+)|\bx-[a-z\-]*(?:api|auth|access)[a-z\-]*(?:key|token)\b[\"']?\s*[:=,]\s*[\"']?([^\s\"'`,;]+)", re.IGNORECASE)
_FLAG = re.compile(
    r"\bsshpass\s+-p\s*[\"']?([^\s\"'`]+)"
    r"|(?<![\w-])--?(?:password|passwd|pass|pwd|token|api-?key|secret|secret-key|access-key|auth-?token|client-secret)(?:=|\s+)[\"']?([^\s\"'`;,]+)"
    r"|\bIDENTIFIED\s+BY\s+[\"']([^\"'\n]+)"
    r"|\bmachine\s+\S+\s+login\s+\S+\s+password\s+(\S+)",
    re.IGNORECASE,
)
#: Flags that hold a password after one command.
_FLAG_OF = (
    (re.compile(r"\bcurl\b", re.IGNORECASE), re.compile(r"\s(?:-u|--user)[\s=]*[\"']?[^\s:\"']+:([^\s\"'`@]+)")),
    (re.compile(r"\bmysql(?:dump|admin)?\b", re.IGNORECASE), re.compile(r"\s-p([^\s\"'`]+)")),
)
#: A name, what may stand between it and its value, and the value in quotes.
_ASSIGN = re.compile(
    r"(?<![\w.])(?<!\w-)(?P<name>[^\W\d][\w.\-]*)[\"'`]?\]?\s*"
    r"(?:(?::\s*(?:&?(?:'static\s+)?[A-Za-z]+|\[\]byte)\s*)?(?P<op>:=|=>|==|=|:|>|,)\s*|(?<=[ \t])(?=[\"']))"
    r"(?:\(\s*(?:(?://|#|--)\s*)?)?(?:[rbuf](?=[\"'])|\[\]byte\()?"
    r"(?:\"(?P<d>(?:[^\"\\\n]|\\.)*)\"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>[^`\n]*)`)"
)
#: A line that gives a name a bare word.
_BARE = re.compile(r"[^\w<]*(?:(?:export|local|set|env|setenv|declare|readonly)\s+(?:-\w\s+)?)?(?P<name>[^\W\d][\w.\-]*)(?:\s*[=:]\s*|\s+)(?P<bare>[^\s\"'`<>,;]+)[,;]?\s*$|[^\w<]*<(?P<tag>[^\W\d][\w.\-]*)>\s*(?P<inner>[^\s<>]+)\s*</(?P=tag)>", re.IGNORECASE)
#: The rest of a value that is put together from strings, on this line or the next.
_MORE = re.compile(r"\s*(?:\+|\.\.?|\\)?\s*(?:(?://|#|--)\s*)?(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
_ANY_QUOTE = re.compile(r"[\"'`]")
#: A string that is given to something or stands in a list.
_GIVEN = re.compile(r"[=:(\[,]\s*([\"'`])([!#-&(-_a-~]{10,})\1")
#: A token of any length, quoted or not.
_LONG = re.compile(r"(?<![\w+/\-.@%$\\&#])[A-Za-z0-9_+/\-]{24,}={0,2}(?![\w+/\-.@%(\[\\])")
#: A line of a table or of encoded text.
_ROW = re.compile(r"[^A-Za-z0-9]*(?:(?:u8|[A-Za-z]{1,2})(?=[\"'`]))?[\"'`]?[A-Za-z0-9_+/\-]{20,}={0,2}[^A-Za-z0-9]*$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+|\d+")


@dataclass(frozen=True)
class Finding:
    """A credential: its kind and the places of its value in the text, more than one if it is put together."""

    kind: str
    spans: tuple[tuple[int, int], ...]

    @property
    def start(self) -> int:
        return self.spans[0][0]


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def alphabet(value: str) -> int:
    """Size of the smallest usual alphabet that holds a value: 10, 16, 32, 36, 64 or 94."""
    if value.isdigit():
        return 10
    if re.fullmatch(r"[0-9a-f\-]+|[0-9A-F\-]+", value):
        return 16
    if re.fullmatch(r"[A-Z2-7=]+", value):
        return 32
    if re.fullmatch(r"[a-z0-9]+|[A-Z0-9]+", value):
        return 36
    return 64 if re.fullmatch(r"[A-Za-z0-9+/_\-=.]+", value) else 94


def randomness(value: str) -> float:
    """Entropy as a share of what a random string of the same alphabet and length is expected to have."""
    n, size = len(value), alphabet(value)
    # expected entropy of n draws from size letters, by the usual bias correction; never above log2 n
    expected = math.log2(size) - (size - 1) / (2 * n * math.log(2)) if n > size else math.log2(n) - n / (2.2 * size)
    return entropy(value) / max(expected, 0.5)


def _classes(value: str) -> int:
    return sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


_PATH = re.compile(r"~?(?:/[\w.\-]*)+$")


def is_placeholder(value: str) -> bool:
    """Whether a value stands for another or says where it is kept; a path is one unless it looks random."""
    if _PATH.match(value) and not (_random_token(value, 24) and _mixed(value)):
        return True
    return bool(_PLACEHOLDER.match(value)) or len(set(value)) <= 2 or "${" in value or "{{" in value


def _mixed(value: str) -> bool:
    """Lower case, upper case and digits that alternate as in no name or path."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value if c.isalnum()]
    return set(kinds) == {"d", "u", "l"} and kinds.count("d") >= 2 and sum(map(str.__ne__, kinds, kinds[1:])) >= 0.4 * (len(kinds) - 1)


def _random_token(value: str, least: int) -> bool:
    """Whether a value looks like drawn at random."""
    n = len(value)
    if n < least or _UUID.match(value) or not re.search(r"\d", value) and _classes(value) < 3:
        return False
    size = alphabet(value)
    if size == 10:
        return False
    if size == 16:
        return n >= 24 and randomness(value) >= 0.80
    if _WORDS_ONLY.match(value) or re.fullmatch(r"[a-z0-9]+(?:[._][a-z0-9]+)+", value):
        return False
    return randomness(value) >= 0.90 - 0.1 * (n < 24) and (_classes(value) >= 2)


def _decoded(value: str) -> str | None:
    """The text that a value in Base64 holds, if it is one."""
    if len(value) < 12 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return None
    try:
        text = base64.b64decode(value, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if text.isprintable() else None


def _phrase(value: str) -> bool:
    """Several words and a number: a passphrase."""
    return bool(re.fullmatch(r"[A-Za-z]+(?:[-_. ][A-Za-z]+){1,}[-_. ]?\d{1,6}[!?.]?", value)) and len(value) >= 10


def _is_password(value: str) -> bool:
    """Whether a value that is called a password is one, and not the name of one."""
    if len(value) < 5 or is_placeholder(value) or _UUID.match(value) or _NOT_SECRET.match(value):
        return False
    if _WORDS_ONLY.match(value) or value.isdigit() and len(value) < 6:
        return False
    return _classes(value) >= 2


def _is_key(value: str) -> bool:
    """Whether a value that is called a key or token is one."""
    if len(value) < 8 or is_placeholder(value) or _UUID.match(value) or _NOT_SECRET.match(value):
        return False
    if ISSUED.fullmatch(value):
        return True
    hidden = _decoded(value)
    return _random_token(value, 12) or _phrase(value) or bool(hidden and not _WORDS_ONLY.match(hidden) and _is_password(hidden))


@functools.lru_cache(maxsize=65_536)
def name_strength(name: str) -> int:
    """3 for a password, 2 for another credential, 1 for what may be one, 0 for anything else, -1 for what is none."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return 0
    joined = "".join(parts)
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last.isdigit() and len(parts) > 1:
        last, before = before, parts[-3] if len(parts) > 2 else ""
    if last in _OTHER or before in ("public", "pub", "ssh", "correlation", "primary", "foreign", "partition", "sort", "cache", "next", "prev", "page", "request", "trace"):
        return -1
    if last in _PASSWORD or any(joined.endswith(p) for p in _PASSWORD if len(p) > 4 or not p.isascii()) or (last in ("secreta", "secreto") and before in _PASSWORD):
        return 3
    if last in _STRONG or any(joined.endswith(s) for s in _STRONG if len(s) > 4 or not s.isascii()):
        return 2
    if last in _FOREIGN_OF and before in _FOREIGN_KEY:
        return 2
    if last in _WEAK:
        return 2 if before in _KEY_OF or last in ("bearer", "jwt") else 1
    return 0


def _value_counts(name: str, value: str, quoted: bool) -> bool:
    strength = name_strength(name)
    if strength < 0:
        return bool(ISSUED.fullmatch(value))
    if strength == 3:
        return _is_password(value) or _is_key(value)
    if strength == 2:
        return _is_key(value) or len(value) >= 8 and _is_password(value) and _classes(value) >= 3 and (quoted or randomness(value) > 0.8)
    if strength == 1:
        return _is_key(value) and len(value) >= 12
    return False


class _Found:
    """Findings, and the places that are taken; no two overlap."""

    def __init__(self) -> None:
        self.all: list[Finding] = []
        self._taken: list[tuple[int, int]] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self._taken, (b, b))
        return i == 0 or self._taken[i - 1][1] <= a

    def take(self, a: int, b: int) -> None:
        bisect.insort(self._taken, (a, b))

    def add(self, kind: str, *spans: tuple[int, int]) -> None:
        if spans and all(a < b and self.free(a, b) for a, b in spans):
            self.all.append(Finding(kind, spans))
            for a, b in spans:
                self.take(a, b)


def find_credentials(text: str) -> list[Finding]:
    """The credentials of a text, by place. Key blocks start at their BEGIN line."""
    found = _Found()
    if "-----BEGIN " in text:
        _key_blocks(text, found)
    _known_forms(text, found)
    _assignments(text, found)
    _bare_lines(text, found)
    for m in _GIVEN.finditer(text):
        if found.free(*m.span(2)) and _lone_token(text, m.start(1), m.end(), m.group(2)):
            found.add("token", m.span(2))
    for m in _LONG.finditer(text):
        if found.free(*m.span()) and _long_token(text, *m.span()):
            found.add("token", m.span())
    return sorted(found.all, key=lambda f: f.start)


def _key_blocks(text: str, found: _Found) -> None:
    for m in _OTHER_BLOCK.finditer(text):
        a, b = m.span()
        head = _BEGIN.match(text, a)
        if head is None:
            found.take(a, b)
            continue
        end = _END.search(text, head.end())
        stop = end.end() if end else head.end()
        if end is None:  # cut off: as far as the lines look like a key
            for line in re.finditer(r"[^\n]*\n?", text[head.end() :]):
                bare = line.group().strip(" \t\r\n#/*-\"'+\\,;")
                if bare and not re.fullmatch(r"[A-Za-z0-9+/=]+|[A-Za-z\-]+: .*", bare):
                    break
                stop = head.end() + line.end()
                if line.end() == line.start():
                    break
        if not found.free(a, stop):
            continue
        body = text[head.end() : end.start() if end else stop]
        if _BODY.search(body) or not body.strip():
            found.add("private key", (a, stop))
        else:
            found.take(a, stop)


def _known_forms(text: str, found: _Found) -> None:
    """URLs, issuers' tokens, headers and arguments of commands."""
    at = 0
    while "://" in text and (m := _URL.search(text, at)):
        at = m.end()
        word = _URL_PASSWORD.match(text, at)
        if word is None:
            continue
        value = word.group()
        if not _HOST.match(text, word.end()):
            at = word.end()  # no @ in it, so no other URL in it has a password
        elif not is_placeholder(value) and not (_WORDS_ONLY.match(value) and len(value) < 6) and not value.startswith("$") and value.lower() not in ("pass", "password", "secret", "user"):
            found.add("url", word.span())
    for m in ISSUED.finditer(text):
        if not is_placeholder(m.group()):
            found.add("token", m.span())
    for m in _HEADER.finditer(text):
        value = m.group(m.lastindex)
        if not is_placeholder(value) and len(value) >= 8 and (_is_key(value) or _is_password(value)):
            found.add("header", m.span(m.lastindex))
    flags = list(_FLAG.finditer(text))
    for command, flag in _FLAG_OF:
        for m in flag.finditer(text) if command.search(text) else ():
            if command.search(text, text.rfind("\n", 0, m.start()) + 1, m.start() + 1):
                flags.append(m)
    for m in flags:
        value = m.group(m.lastindex)
        if _is_password(value) or _is_key(value):
            found.add("argument", m.span(m.lastindex))


def _bare_lines(text: str, found: _Found) -> None:
    """Lines that give a name a word without quotes."""
    a = 0
    while a < len(text):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        if b - a >= 6 and not _ANY_QUOTE.search(text, a, b) and "(" not in text[max(a, b - 3) : b] and (m := _BARE.match(text, a, b)):
            kind = "bare" if m.group("bare") is not None else "inner"
            name, value = m.group("name" if kind == "bare" else "tag"), m.group(kind)
            strength = name_strength(name)
            is_name = re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", value) and not (re.search(r"\d", value) and (_random_token(value, 8) or strength == 3 and _classes(value) >= 3))
            if strength > 0 and "(" not in value and "[" not in value and not value.endswith("{") and not is_name and _value_counts(name, value, False):
                found.add("value", m.span(kind))
        a = b + 1


def _assignments(text: str, found: _Found) -> None:
    """Names with a value in quotes, on the same line or the next, of any length and put together from any number of strings."""
    at = 0
    while m := _ASSIGN.search(text, at):
        kind = next(k for k in ("d", "s", "b") if m.group(k) is not None)
        value, span = m.group(kind), m.span(kind)
        name = m.group("name")
        strength = name_strength(name)
        at = m.end("name") if strength <= 0 else m.end()
        if strength <= 0 or m.group("op") == "==" or not found.free(*span):
            continue
        spans, whole = [span], value
        end = m.end()
        while kind in ("d", "s") and (more := _MORE.match(text, end)):
            g = 1 if more.group(1) is not None else 2
            joint = text[end : more.start(g) - 1]
            if not joint.strip() and "\n" not in joint and not joint:
                break
            if "\n" in joint and "+" not in joint and "\\" not in joint and "(" not in text[m.end("name") : span[0]]:
                break
            spans.append(more.span(g))
            whole += more.group(g)
            end = more.end()
        if _value_counts(name, whole, True):
            found.add("value", *(s for s in spans if s[0] < s[1]))
            at = end


def _line_around(text: str, a: int, b: int) -> tuple[int, int]:
    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    return start, len(text) if end < 0 else end


def _among_rows(text: str, start: int, end: int) -> bool:
    """Whether the line is one of several rows of a table or of encoded text."""
    above = text.rfind("\n", 0, max(0, start - 1)) + 1
    below = text.find("\n", end + 1)
    after = _ROW.match(text, end + 1, len(text) if below < 0 else below)
    return bool(after or _ROW.match(text, start, end) and _ROW.match(text, above, max(0, start - 1)))


def _unnamed(text: str, a: int, b: int, value: str) -> bool:
    """Whether nothing around a random looking value says that it is something else."""
    start, end = _line_around(text, a, b)
    before, after = text[start:a], text[b:end]
    if after.rstrip().endswith("+") or re.search(r"data:|base64|sha\d|integrity|ssh-|ecdsa-|AAAA", before + value[:8], re.IGNORECASE):
        return False
    if _among_rows(text, start, end):
        return False
    names = re.findall(r"[^\W\d][\w\-]*", before)
    return not names or name_strength(names[-1]) >= 0


def _lone_token(text: str, a: int, b: int, value: str) -> bool:
    """A random looking string whose name doesn't say what it is; rows of a table of strings don't count."""
    size = alphabet(value)
    if size < 64 or _classes(value) < 3 or not _random_token(value, 20 if size == 64 else 10) or is_placeholder(value) or _NOT_SECRET.match(value):
        return False
    if re.search(r"[(){}\[\]<>|\\;,]|%[(sdv]|://|\.\.?/", value) or size == 64 and re.search(r"[./]\w*[./]|^\.|^[\w\-]+\.[\w.\-]+$", value) and not _mixed(value):
        return False
    return _unnamed(text, a, b, value)


def _long_token(text: str, a: int, b: int) -> bool:
    """A long token that no name speaks for: all of lower case, upper case and digits, and mixed as in no name or path.

    Hex, and lower case and digits alone, look like hashes and ids and need a name.
    """
    value = text[a:b]
    if not _mixed(value) or not _random_token(value, 24) or is_placeholder(value) or _NOT_SECRET.match(value) or "//" in value[:2]:
        return False
    return _unnamed(text, a, b, value)


def redact(text: str, found: list[Finding], mark: str = "REDACTED") -> str:
    """The text with only the credentials replaced; quotes, lines and everything around them stay."""
    out, at = [], 0
    spans = sorted(((s, i == 0, f.kind) for f in found for i, s in enumerate(f.spans)), key=lambda x: x[0])
    for (a, b), first, kind in spans:
        out.append(text[at:a])
        if kind == "private key":
            block = text[a:b]
            out.append(_BODY.sub(mark, block) if not block.startswith("-----BEGIN") else re.sub(r"(?<![\w\-])(?!-----)[A-Za-z0-9+/=]{16,}", mark, block))
        else:
            out.append(mark if first else "")
        at = b
    out.append(text[at:])
    return "".join(out)


_FOUND = "place string, row_id long, version long, line_no int, kind string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        out = []
        for place, row, version, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for f in find_credentials(text):
                out.append((place, row, version, text.count("\n", 0, f.start) + 1, f.kind))
        columns = list(zip(*out, strict=True)) if out else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["place", "row_id", "version", "line_no", "kind"])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text in batch.column(2).to_pylist():
            found = find_credentials(text) if text else []
            texts.append(redact(text, found) if found else text)
            counts.append(len(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["place", "row_id", "redacted", "n_credentials"])


def _texts(rows: DataFrame, place: str, id: str, text: str) -> DataFrame:
    return rows.select(F.lit(place).alias("place"), F.col(id).cast("long").alias("row_id"), F.col(text).alias("text"))


def credentials(rows: DataFrame, place: str, id: str = "id", text: str = "content", version: str | None = None) -> DataFrame:
    """``place, row_id, line_no, kind``: the credentials in ``text`` of each row, by the line where the value starts.

    Lines end at a line feed and count from 1. With ``version`` only the rows count that have the greatest version of
    their id; they are told after the search, so no text is shuffled. Null and empty texts hold none; repeated rows
    are reported once; a null id stays null; texts are read whole, whatever their length. ``place`` is copied. Extra
    columns are never read.
    """
    number = F.col(version).cast("long") if version else F.lit(0).cast("long")
    texts = rows.select(F.lit(place).alias("place"), F.col(id).cast("long").alias("row_id"), number.alias("version"), F.col(text).alias("text"))
    found = spread(texts.filter("text IS NOT NULL AND text <> ''")).mapInArrow(_scan, _FOUND).distinct()
    if version:
        newest = rows.groupBy(F.col(id).cast("long").alias("id_")).agg(F.max(number).alias("version_"))
        found = found.join(newest, F.col("row_id").eqNullSafe(F.col("id_")) & F.col("version").eqNullSafe(F.col("version_")), "left_semi")
    return found.drop("version")


def redacted(rows: DataFrame, place: str, id: str = "id", text: str = "content") -> DataFrame:
    """``place, row_id, redacted, n_credentials``: every row's text with its credentials replaced; null stays null."""
    texts = rows.select(F.lit(place).alias("place"), F.col(id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return spread(texts).mapInArrow(_redact, "place string, row_id long, redacted string, n_credentials int")
