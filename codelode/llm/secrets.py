"""Credentials embedded in source code: find the literals, redact only their contents.

Chunks that hold no credential word, URL with a user, private key, token of a known shape or joined literals are
passed over by a pattern in the JVM, which lets through all that the detectors can find. The others are tokenised as
a whole (comments, string literals of every quoting style over line ends, names, brackets), which gives the arguments
of calls and literals in triple quotes; what is assigned, keyed or labelled is read off the lines. A literal is a
secret when a credential-named identifier (or key, argument, comment label) is assigned it, called with it or passed
with it and it is no placeholder, reference, prose, digest or public key; and wherever it lies, when it is a password
in a URL, a coded user:password pair, a bearer token, a private key or a token of a provider's shape. Redaction replaces the characters between the delimiters,
escape sequences as units, and nothing else.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

MASK = "REDACTED"
#: Words that make the end of a name a credential's, written without separators.
_CREDENTIAL = (
    r"(?:passw(?:or)?d|passwrd|passphrase|passcode|pwd|pass|contrasena|clave|secret|(?:api|access|secret|private|auth|encryption|signing|account|shared|master|service|client|license|deploy)[_.\- ]?key|"
    r"token|credentials?|bearer|auth)"
)
#: A name is told by its last words; a trailing number or version does not count.
_NAME = re.compile(rf"(?:^|[_.\-$@/]|(?<=[a-z0-9])(?=[A-Z])){_CREDENTIAL}(?:[_\-.]?(?:value|string|text|plain|literal|default|old|new|prod|staging|dev|test))?(?:[_\-.]?v?\d+)?$", re.I)
_SPLIT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_.\-$@/\s]+")
#: Words that turn a credential name into something about credentials.
_ABOUT = {"hash", "hashed", "digest", "sha", "sha1", "sha256", "md5", "checksum", "fingerprint", "public", "pub", "commit", "etag", "label", "placeholder", "hint", "prompt", "message", "msg", "error", "title", "header", "field", "url", "uri", "path", "file", "name", "type", "id", "len", "length", "count", "min", "max", "policy", "rule", "regex", "pattern", "format", "ttl", "expiry", "tokenizer", "caption", "text", "tooltip", "help", "description", "csrf", "page", "next", "cursor", "sync", "continuation"}
_PLACEHOLDER = re.compile(
    r"""^(?:[<\[{(].*[>\]})]|.*(?:\$\{|\$\(|\{\{|%\(|<[a-z_ \-]+>|\.\.\.|…).*|\$\w+|%\w+%|%[sdvq]|@\w+@|(.)\1{3,}|[x*\#.\-_•X0]+|
    your[\-_ ]?[a-z]+(?:[\-_ ][a-z]+)*|(?:my|insert|enter|put|replace|add|fill|set|use)[\-_ ][a-z]+(?:[\-_ ][a-z]+)*|
    .*(?:change[\-_]?me|redacted|placeholder|your[\-_]\w+).*|[^\d]*(?:example|dummy|foobar|todo|fixme|masked|hidden|removed)[^\d]*|.*(?:secret|key|token|password)[\-_]?here.*|
    null|nil|none|true|false|undefined|n/?a|empty|default|unset|string|required|optional|missing|tbd)$""",
    re.I | re.X | re.S,
)
_REFERENCE = re.compile(r"^(?:vault|env|ssm|secret|secrets|arn|gcp|aws|azure|keyvault|op|kms|file|ref|sops|doppler|config|keyring|k8s|https?)[:/]|^(?:/|\./|\.\./|~/)(?-i:[a-z0-9_.\-]+/)*(?-i:[a-z0-9_.\-]+)$|^(?:process|os|System|config|settings|secrets|vault|env|ctx|self|this|Deno|import)\.[\w.]+|^!(?:Ref|Sub|vault|secret)\b", re.I)
#: Names of nothing but passwords: a literal given to them straight away is one, however short or plain.
_PASSWORD = re.compile(r"(?:^|[_.\-$@/]|(?<=[a-z0-9])(?=[A-Z]))(?:passw(?:or)?d|passwrd|passphrase|passcode|contrasena)(?:[_\-.]?(?:value|plain|literal|default|old|new|prod|staging|dev|test))?(?:[_\-.]?v?\d+)?$", re.I)
#: What a plain word given to a password name may be instead: the label or the name of a field, a type, a kind.
_KIND = re.compile(r"passw|passphrase|passcode|pwd|secret|token|credential|contrase|^(?:text|varchar|char|str|bytes|bool|basic|field|prompt|vault|env)$", re.I)
#: Several plain words given to a password name, and words that make them prose.
_PASSPHRASE = re.compile(r"[a-z]{3,}(?:[ ][a-z]{3,}){2,7}")
_PROSE = {"the", "your", "you", "for", "and", "not", "must", "please", "enter", "this", "that", "with", "from", "have", "has", "are", "was", "can", "will", "may", "should", "invalid", "missing", "required", "new", "old", "una", "por", "favor", "para", "los", "las", "del", "debe", "ser"}
_UUID = re.compile(r"^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$", re.I)
_HEX = re.compile(r"^(?:sha\d+[:\-])?[0-9a-f]{7,}$", re.I)
#: Shapes of well-known tokens.
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9+/_\-.])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abprs]-[A-Za-z0-9\-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|glpat-[\w\-]{18,}|npm_[A-Za-z0-9]{30,}|AIza[\w\-]{35}|SG\.[\w\-]{16,}\.[\w\-]{16,}|"
    r"eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}|(?P<prefix>[a-z][a-z0-9]{1,9}(?:[_\-][a-z][a-z0-9]{1,7}){0,2})[_\-.](?P<body>[A-Za-z0-9]{18,}))(?![A-Za-z0-9_])"
)
#: Prefixes of digests and the like, which are no tokens.
_NO_TOKEN = re.compile(r"^(?:sha\d*|md5|blake\w*|crc\w*|rev|commit|hash|digest|etag|checksum|integrity|build|chunk|bundle|img|image|v\d+)$")


def _token(m: re.Match) -> bool:
    """Whether a match of ``_SHAPES`` is a token: after a free prefix the body has to look drawn at random."""
    if _PLACEHOLDER.match(m.group()) or not _varied(m.group()):
        return False
    body = m.group("body")
    if body is None:
        return True
    if any(_NO_TOKEN.match(p) for p in re.split(r"[_\-]", m.group("prefix"))):
        return False
    return bool(re.search(r"[a-z]", body) and re.search(r"[A-Z]", body)) and (len(re.findall(r"\d", body)) >= 2 or _scrambled(body)) and not re.search(r"[a-z]{11,}", body)


_URL = re.compile(r"\b[a-z][a-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s/\"'`<>]*?)@(?=[\w.\-\[\"'$+ ])", re.I)
_SCHEME = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/=_\-.~]{8,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_USERPASS = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user|-p|--password|--pass|--token|--api-key|--secret)[ =]+(\"[^\"]*\"|'[^']*'|[^\s\"']+)")
_STRING = re.compile(r"\"\"\"|'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_QUOTED = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
#: Literals joined by an operator, over line ends too.
_CHAIN = re.compile(rf"{_QUOTED}(?:\s*(?:\+|\.(?=\s*[\"'])|\\?\n(?=\s*[\"']))\s*{_QUOTED})+")
_CONTINUES = re.compile(r"\s*(?:\+|\.|\|\||\\|&)?\s*$")
#: ``name op`` right before a literal, or a key in quotes with its separator.
_BEFORE = re.compile(r"([\w.$@\-]+(?:\[[\w\"']+\])?|\"[^\"\n]{1,80}\"|'[^'\n]{1,80}'|`[^`\n]{1,80}`|[\w.]+\[\"[^\"\n]+\"\])\s*(?::\s*[\w.<>\[\]|?* ]+?)?\s*(:=|=>|\?\?=|\|\|=|==|!=|=|:|,)\s*[\(\[]?\s*[rbfuRBFU]{0,2}$")
_SQL = re.compile(r"\b(?:password|identified\s+by(?:\s+password)?)\s*$", re.I)
_BARE = re.compile(r"^\s*(?:export\s+|set\s+|ENV\s+|ARG\s+|-\s+|RUN\s+)?([\w.\-]+)\s*(=|:\s|:$|\s)\s*([^\s#\"'][^\s\"']*)\s*(?:#.*)?$")
_LABEL = re.compile(r"((?:[A-Za-z]+[ _\-]){0,3}?(?:password|passwd|pwd|pass|passphrase|secret|token|credential|(?:api|access|private|signing|encryption|auth|secret|master|shared|service)[ _\-]?key|clave|contrase\u00f1a)s?)(?:\s*(?:[:=]|->)\s*|\s+(?:is\s+|es\s+)?)[`\"']?([^\s`\"',;]+)", re.I)
_XML = re.compile(r"<([\w.:\-]+)(?:\s[^<>]*)?>([^<>\s]+)</\1>|\b(?:name|key|id)\s*=\s*[\"']([\w.\-]+)[\"']\s+value\s*=\s*[\"']([^\"']+)[\"']|<(?:\w+)[^<>]*?\b(?:name|key)\s*=\s*[\"']([\w.\-]+)[\"'][^<>]*>([^<>\s]+)<")
_MARKED = re.compile(r"`([\w.\-]+)\s*[=:]\s*([^`\s]+)`")
_COMMENT = re.compile(r"(?:^|\s)(?://|#|--\s|/\*|<!--|\*\s|;)\s?(.*)$")
_INLINE_ENV = re.compile(r"(?<![\w.\-])([A-Za-z_][\w.\-]*)=([^\s\"'`;|&)]+)")
_UNQUOTED = {"yaml", "properties", "toml", "ini", "shell", "dockerfile", "markdown", "config", ""}

_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: What a chunk must hold for the tokeniser to look at it, as a pattern for Java and Python alike. Each branch is what
#: detectors cannot do without: words of names and labels, URLs with a user, options with user:password, schemes,
#: token shapes, and where literals are joined, as what is looked for may begin in one and end in another.
CANDIDATE = (
    r"(?i)pass|pwd|secret|token|key|credential|auth|clave|contrase|bearer|identified[^A-Za-z0-9_]+by|://[^\s/:@\"'`<>]*:[^\s/\"'`<>]*@|(?:-u|--user|--proxy-user)[ =]+[^\n]*:|"
    r"(?-i:Basic[^A-Za-z0-9_]+[A-Za-z0-9+/=_.~-]{8}|(?<![A-Za-z0-9+/_.-])[a-z][a-z0-9]{1,9}(?:[_-][a-z][a-z0-9]{1,7}){0,2}[_.-][A-Za-z0-9]{18}|eyJ|AKIA|gh[pousr]_|github_pat_|xox[abprs]-|[sr]k_live_|glpat-|npm_|AIza|SG\.)|"
    rf"[\"'`]{_BLANK}*(?:\+|\.|\\?\n){_BLANK}*[\"'`]"
)


def is_credential_name(name: str) -> bool:
    """Whether an identifier, key or label names a credential itself."""
    name = name.strip("\"'`[]() ")
    if "[" in name:
        name = re.split(r"[\[\"']+", name.rstrip("\"']"))[-1]
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    while parts and (parts[-1].isdigit() or re.fullmatch(r"v\d+", parts[-1])):
        parts.pop()
    if not parts or parts[-1] in _ABOUT or any(p in {"public", "csrf", "hashed", "placeholder"} for p in parts):
        return False
    return bool(_NAME.search(name))


def is_password_name(name: str) -> bool:
    """Whether a credential's name can be that of a password only."""
    return bool(_PASSWORD.search(name.strip("\"'`[]() ")))


def is_secret(value: str, named: bool = True, sure: bool = False) -> bool:
    """Whether a literal's content can be a secret, given that its name is a credential's.

    ``sure``: the name is a password's and the literal is assigned to it; then plain words and short
    literals count too.
    """
    v = value.strip()
    if sure and " " in v:
        return bool(_PASSPHRASE.fullmatch(v)) and not _PROSE.intersection(v.split()) and not _KIND.search(v)
    if not v or (len(v) < 6 and not sure) or any(c.isspace() for c in v):
        return False
    if _PLACEHOLDER.match(v) or _REFERENCE.match(v) or _UUID.match(v) or "PUBLIC KEY" in v:
        return False
    if re.match(r"^(?:sha\d+|md5)[:\-]", v, re.I):
        return False
    if sure and v.isascii() and (v.isdigit() or re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*|(?![A-Z][a-z]+$)[A-Z]?[a-z]+(?:[A-Z][a-z]*)*", v)):
        return not _KIND.search(v)
    if sure and len(v) < 6:
        return v.isascii() and v.isalnum() and not _KIND.search(v)
    kinds = bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9]", v)) + bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v))
    if not kinds:
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[_\-./ ][A-Za-z]+)*", v) and not any(_scrambled(part) for part in re.split(r"[_\-./ ]", v)):
        return False  # words, paths or identifiers
    if re.fullmatch(r"[A-Z][a-z\u00c0-\u024f]+", v) or not v.isascii() and v.isalpha():
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v):
        return False  # a constant's or variable's name
    if re.fullmatch(r"\d+(?:\.\d+)*(?:ms|s|m|h|d|px|em|%)?", v) and len(v) < 8:
        return False
    if re.fullmatch(r"[\w.]+\([^)]*\)?;?", v):
        return False
    return True


def _scrambled(v: str) -> bool:
    """Letters of both cases in no order that camel case would give."""
    ups = [i for i, c in enumerate(v) if c.isupper()]
    return len(ups) >= 2 and (len(ups) / len(v) > 0.3 or any(b - a == 1 for a, b in zip(ups, ups[1:])))


def _basic(code: str) -> bool:
    try:
        pair = base64.b64decode(code + "=" * (-len(code) % 4), validate=True).decode("utf-8")
    except Exception:
        return False
    user, colon, word = pair.partition(":")
    return bool(colon and user and word) and not _PLACEHOLDER.match(word)


#: How comments look in the languages, and string literals of every quoting style.
_COMMENTS = {k: r"\#[^\n]*" for k in ("python", "shell", "yaml", "toml", "dockerfile", "properties", "ini")} | {"sql": r"--[^\n]*|/\*[\s\S]*?\*/"}
_TOKENS = (
    r"|(?P<triple>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\')|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`)"
    r"|(?P<call>[A-Za-z_$][\w$]*[ \t]*\()|(?P<pair>\b[A-Za-z_$][\w$]*[ \t]*=[ \t]*\()|[A-Za-z_$][\w$]*|(?P<open>[(\[{])|(?P<close>[)\]}])"
)
_lexers: dict[str, re.Pattern] = {}
#: First words of functions that look for, check or change a credential instead of being given one.
_ASKS = {
    "get", "has", "is", "validate", "check", "hash", "verify", "parse", "find", "load", "read", "fetch", "generate", "create", "make", "delete", "remove", "revoke", "refresh", "decode", "encode", "encrypt", "decrypt", "reset",
    "require", "log", "print", "mask", "redact", "prompt", "ask", "show", "hide", "render", "compare", "match", "test", "count", "split", "next", "expect", "assert", "cancel", "rotate", "sign", "build", "derive", "lookup", "resolve", "format", "def", "func", "function",
}


def lex(content: str, language: str) -> Iterator[re.Match]:
    """The tokens of a text by kind; comments are left out."""
    if language not in _lexers:
        _lexers[language] = re.compile(r"(?P<comment>" + _COMMENTS.get(language, r"//[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->") + ")" + _TOKENS)
    return (m for m in _lexers[language].finditer(content) if m.lastgroup != "comment")


def _given(content: str, language: str) -> Iterator[tuple[int, int]]:
    """Places of secrets that are arguments of credential-named calls (or pairs), and of those in triple quotes."""
    calls: list[tuple[str, list]] = []  # open brackets: the credential name before one, its literals so far
    for m in lex(content, language):
        kind = m.lastgroup
        if kind in ("call", "pair", "open"):
            name = m.group()[:-1].rstrip(" \t=") if kind != "open" else ""
            if name and (_SPLIT.split(name)[0].lower() in _ASKS or not is_credential_name(name)):
                name = ""
            calls.append((name, []))
        elif kind == "close" and calls:
            name, literals = calls.pop()
            if name and literals:
                m, others = literals[-1], len(literals) > 1
                a, b = m.start() + 1, m.end() - 1
                value = content[a:b]
                sure = is_password_name(name)
                pair = re.search(r"auth$|credentials?$", name, re.I)
                strong = bool(re.search(r"\d", value)) and len(value) >= 8
                if is_secret(value) and (strong or sure) and (others or not pair) and not _URL.search(value):
                    yield a, b
        elif kind in ("string", "triple"):
            if kind == "string":
                if calls and calls[-1][0]:
                    calls[-1][1].append(m)
                continue
            value = content[m.start() + 3 : m.end() - 3]
            before = _BEFORE.search(content[max(0, m.start() - 200) : m.start()])
            if before and before.group(2) not in ("==", "!=", ",") and is_credential_name(before.group(1)) and is_secret(value, sure=is_password_name(before.group(1))):
                a = m.start() + 3 + len(value) - len(value.lstrip())
                yield a, a + len(value.strip())


def find_secrets(content: str, language: str | None) -> list[tuple[int, int, int, str]]:
    """``line offset, start, end, kind`` of every secret; start and end are places in ``content``.

    A literal that goes on in further pieces (concatenation, a key of several lines) gives one entry per
    piece, of which only the first, with the kind not ending in ``+``, is the place where it begins.
    """
    language = language or ""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    lines = content.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def add(i: int, a: int, b: int, kind: str) -> None:
        a, b = starts[i] + a, starts[i] + b
        if b > a and not any(x <= a < y or x < b <= y for x, y in found):
            found[a, b] = (i, kind)

    for chain in _CHAIN.finditer(content):
        # what only shows when the pieces are joined: places in the joined text are traced back to the pieces
        pieces = [(chain.start() + m.start() + 1, m.group()[1:-1]) for m in re.finditer(_QUOTED, chain.group())]
        whole = "".join(t for _, t in pieces)
        places = [(m.span(2), "url password") for m in _URL.finditer(whole) if _url_password(m.group(2))]
        places += [(m.span(), "token") for m in _SHAPES.finditer(whole) if _token(m)]
        places += [(m.span(2), "basic pair") for m in _SCHEME.finditer(whole) if m.group(1) == "Basic" and _basic(m.group(2))]
        for (a, b), kind in places:
            at = 0
            for start, piece in pieces:
                lo, hi = max(a, at), min(b, at + len(piece))
                if lo < hi:
                    i = bisect_right(starts, start + lo - at) - 1
                    add(i, start + lo - at - starts[i], start + hi - at - starts[i], kind)
                    kind = kind.rstrip("+") + "+"
                at += len(piece)
    carry: tuple[str, str] | None = None  # the name that a literal on the next line belongs to, or "+" for a further piece
    pem_until = -1
    for i, line in enumerate(lines):
        if i <= pem_until:
            continue
        if len(line) > 20000 and not carry and not re.search(CANDIDATE, line):
            continue
        pem = _PEM.search(line)
        if pem:
            last, body = i, []
            tail = line[pem.end() :]
            end = re.search(r"-----END", tail)
            if end:
                body.append(tail[: end.start()])
                add(i, pem.end(), pem.end() + end.start(), "private key")
                at = None
            else:
                body.append(tail)
                for j in range(i + 1, len(lines)):
                    if "-----END" in lines[j]:
                        last = j
                        break
                    body.append(lines[j])
                    last = j
                    if not re.match(r"^[\s\"'`+,\\n]*[A-Za-z0-9+/=]*[\s\"'`+,;\\n)]*$", lines[j]) and not re.match(r"^\s*(?:Proc-Type|DEK-Info|\")", lines[j]):
                        last = j - 1
                        break
                at = last
            text = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", "".join(body))
            if len(text) >= 16 and not _PLACEHOLDER.match("".join(body).strip(" \"'`+\n\\")):
                if at is not None:
                    found[starts[i] + pem.start(), starts[i] + pem.end()] = (i, "private key begin")
                    for j in range(i, at + 1):
                        begin = pem.end() if j == i else 0
                        for m in re.finditer(r"[A-Za-z0-9+/=]{8,}", re.sub(r"-----END.*", lambda m: " " * len(m.group()), lines[j])):
                            if m.start() >= begin:
                                add(j, m.start(), m.end(), "private key+")
                    pem_until = at
            carry = None
            continue
        for m in _URL.finditer(line):
            if _url_password(m.group(2)):
                add(i, m.start(2), m.end(2), "url password")
        for m in _SCHEME.finditer(line):
            code = m.group(2)
            if m.group(1) == "Basic":
                if _basic(code):
                    add(i, m.start(2), m.end(2), "basic pair")
            elif is_secret(code) and re.search(r"\d", code) and len(code) >= 16:
                add(i, m.start(2), m.end(2), "bearer token")
        for m in _SHAPES.finditer(line):
            if _token(m):
                add(i, m.start(), m.end(), "token")
        comment = _comment_start(line, language)
        code = line if comment is None else line[:comment]
        strings = [m for m in _STRING.finditer(code) if m.group() not in ('"""', "'''")]
        last_end, last_kind, matched = -1, "", False
        for m in strings:
            g = 1 if m.group(1) is not None else 2 if m.group(2) is not None else 3
            value, before = m.group(g), code[: m.start()]
            joined = last_end >= 0 and re.fullmatch(r"\s*(?:\+|\.|\|\|)?\s*", code[last_end : m.start()]) and last_kind
            if not before.strip() and carry and carry[1] == "+":
                joined = True
                last_kind = carry[0]
            if joined:
                if re.search(r"[A-Za-z0-9]", value):
                    add(i, m.start(g), m.end(g), last_kind.rstrip("+") + "+")
                last_end = m.end()
                matched = True
                continue
            last_kind = ""
            name = _BEFORE.search(before)
            credential = sure = False
            if name and is_credential_name(name.group(1)) and name.group(2) not in ("==", "!="):
                sure = name.group(2) != "," and is_password_name(name.group(1))
                credential = name.group(2) != "," or name.group(1)[0] in "\"'`" and not re.search(r"[:=]\s*$", before[: name.start(1)])
            elif _SQL.search(before) and language == "sql":
                credential = sure = True
            elif not before.strip() and carry and carry[1] == "=":
                credential, sure = True, is_password_name(carry[0])
            if credential:
                whole = value + "".join(x.group(1) or x.group(2) or "" for x in strings if x.start() > m.start() and re.fullmatch(r"\s*\+?\s*", _between(code, m, x, strings)))
                if _URL.search(whole):
                    pass
                elif is_secret(whole, sure=sure):
                    add(i, m.start(g), m.end(g), "literal")
                    last_kind, last_end, matched = "literal", m.end(), True
        after = code[strings[-1].end() :] if strings else code
        if last_kind and _CONTINUES.fullmatch(after) and (re.search(r"[+.\\|]\s*$", after) or i + 1 < len(lines) and re.match(r"\s*(?:\+|\.)?\s*[\"'`]", lines[i + 1]) and language == "python"):
            carry = (last_kind, "+")
        elif (tail := re.search(r"([\w.$@\-]+|\"[^\"]+\")\s*(?::\s*\w+\s*)?(?:=|:=|:)\s*[\(]?\s*\\?$", code)) and is_credential_name(tail.group(1)):
            carry = (tail.group(1), "=")
        else:
            carry = None
        if not strings and not matched and (language in _UNQUOTED):
            m = _BARE.match(code)
            if m and is_credential_name(m.group(1)) and (not m.group(2).isspace() or re.match(r"\s*(?:ENV|ARG)\s", code)):
                if is_secret(m.group(3), sure=language not in ("markdown", "") and is_password_name(m.group(1))) and not _URL.search(m.group(3)):
                    add(i, m.start(3), m.end(3), "literal")
        if language in ("shell", "dockerfile", "markdown"):
            for m in _INLINE_ENV.finditer(code):
                if is_credential_name(m.group(1)) and is_secret(m.group(2)):
                    add(i, m.start(2), m.end(2), "literal")
            for m in _USERPASS.finditer(code):
                value = m.group(1).strip("\"'")
                a = m.start(1) + (m.group(1)[0] in "\"'")
                user, colon, word = value.partition(":")
                if m.group().lstrip().startswith(("-u", "--user", "--proxy")):
                    if colon and len(word) >= 3 and not _PLACEHOLDER.match(word) and not word.startswith("$"):
                        add(i, a + len(user) + 1, a + len(value), "user:password")
                elif m.group().lstrip().startswith("--") and is_secret(value):
                    add(i, a, a + len(value), "literal")
        if "<" in line and (language in ("xml", "markdown", "") or line.lstrip().startswith("<")):
            for m in _XML.finditer(line):
                g = 1 if m.group(1) else 3 if m.group(3) else 5
                bare_key = m.group(g).lower() == "key" and len(m.group(g + 1)) >= 16 and re.search(r"\d", m.group(g + 1)) and _scrambled(m.group(g + 1))
                if (is_credential_name(m.group(g)) or bare_key) and is_secret(m.group(g + 1), sure=language == "xml" and is_password_name(m.group(g))) and not _URL.search(m.group(g + 1)):
                    add(i, m.start(g + 1), m.end(g + 1), "literal")
        for m in _MARKED.finditer(line):
            if is_credential_name(m.group(1)) and is_secret(m.group(2)):
                add(i, m.start(2), m.end(2), "literal")
        prose = line if language == "markdown" else None if comment is None else line[comment:]
        if prose is not None:
            shift = len(line) - len(prose)
            for m in _LABEL.finditer(prose):
                word = m.group(2).rstrip(".)")
                sure = m.group()[len(m.group(1)) :].lstrip()[:1] in ":=-" or re.search(r"\d", word) or _scrambled(word)
                if sure and is_secret(word) and not _URL.search(word):
                    add(i, shift + m.start(2), shift + m.start(2) + len(word), "comment")
    for a, b in _given(content, language):
        i = bisect_right(starts, a) - 1
        add(i, a - starts[i], b - starts[i], "literal")
    return sorted((i, a, b, kind) for (a, b), (i, kind) in found.items())


def _url_password(v: str) -> bool:
    return len(v) >= 3 and not v.isupper() and not _PLACEHOLDER.match(v) and not re.match(r"^[$%{<]", v)


def _varied(v: str) -> bool:
    return len(set(v)) >= 8


def _between(code: str, first: re.Match, other: re.Match, strings: list[re.Match]) -> str:
    """What lies between two literals, the literals between them left out."""
    out, at = "", first.end()
    for s in strings:
        if s.start() >= at and s.end() <= other.start():
            out += code[at : s.start()]
            at = s.end()
    return out + code[at : other.start()]


#: What starts a comment to the end of the line.
_LINE_COMMENT = {"python": "#", "shell": "#", "yaml": "#", "toml": "#", "dockerfile": "#", "properties": "#", "ini": "#", "sql": "--"}


def _comment_start(line: str, language: str) -> int | None:
    """Where the line's comment starts, strings being passed over."""
    stripped = line.lstrip()
    lead = len(line) - len(stripped)
    mark = _LINE_COMMENT.get(language, "//")
    if stripped.startswith((mark, "/*", "* ", "<!--")) or language == "css" and stripped.startswith("*"):
        return lead
    if mark not in line and "/*" not in line:
        return None
    at = 0
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|" + re.escape(mark) + r"|/\*", line):
        if m.group() in (mark, "/*") and (mark != "#" or m.start() == 0 or line[m.start() - 1].isspace()) and (m.start() == 0 or line[m.start() - 1] != ":"):
            return m.start()
        at = m.end()
    return None


def redact(content: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``content`` with each secret replaced; everything outside the spans is kept, character by character."""
    out, at = [], 0
    for _, a, b, kind in sorted(spans, key=lambda s: s[1]):
        if kind == "private key begin" or a < at:
            continue
        out += [content[at:a], MASK if not kind.endswith("+") else ""] if not kind.startswith("private key+") else [content[at:a], MASK]
        at = b
    return "".join([*out, content[at:]])


def _scan(chunks: DataFrame) -> DataFrame:
    keep = ["id", "start_line", "language", "content"]
    return spread(chunks.select(*keep).where("id IS NOT NULL AND content IS NOT NULL")).where(F.col("content").rlike(CANDIDATE))


def secret_places(chunks: DataFrame) -> DataFrame:
    """``id, line_no, start, end, kind``: every secret of every chunk, of all revisions.

    ``line_no`` is the line in the file on which the secret begins, ``start`` and ``end`` are places in the
    content. Chunks with NULL id or content give nothing; a NULL ``start_line`` counts as 1, a NULL language
    as plain text. Ids delivered twice count once.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, first, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, (first or 1) + i, a, b, kind) for i, a, b, kind in find_secrets(content, language) if not kind.endswith("+")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["id", "line_no", "start", "end", "kind"])

    found = _scan(chunks).mapInArrow(find, "id bigint, line_no bigint, start int, end int, kind string")
    return found.distinct()  # of rows delivered twice; contents are never shuffled


def secret_lines(chunks: DataFrame) -> DataFrame:
    """``id, line_no``: one row per chunk and line on which a secret begins."""
    return secret_places(chunks).select("id", "line_no").distinct()


def redacted_chunks(chunks: DataFrame) -> DataFrame:
    """All rows and columns of ``chunks``, ``content`` with its secrets hidden. NULL contents stay NULL."""
    other = [c for c in chunks.columns if c != "content"]

    @F.pandas_udf("string")
    def hide(content, language):  # noqa: ANN001, ANN202
        return content.combine(language, lambda c, l: None if c is None else redact(c, find_secrets(c, l)))

    language = F.col("language") if "language" in chunks.columns else F.lit(None).cast("string")
    # Spark runs the function on every row, whatever condition stands around it: what needs no look is given as NULL
    told = F.coalesce(hide(F.when(F.col("content").rlike(CANDIDATE), F.col("content")), language), F.col("content"))
    return chunks.select(*other, told.alias("content"))
