"""Problem 1: credentials in code, configuration, scripts and notes, and their redaction.

Quoted strings (joined where code puts them together from pieces), unquoted settings, long tokens,
key blocks, lists of bytes, parts of addresses and command options are the candidates, of whatever
length. Each gets the Shannon entropy of its symbols; the threshold is the entropy that a random
string of its length and alphabet has on average, less a margin that depends on the context
(``MARGINS``): a name such as ``db_password`` allows far more regular values than none at all.
Hashes, identifiers, references and stand-in words are left out. Without a name or another sign,
strings of hex digits count as hashes or ids, and lines that are nothing but a literal as data.
"""

from __future__ import annotations

import base64
import binascii
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import spread


@dataclass(frozen=True)
class Found:
    """A credential value: text[start:end]."""

    start: int
    end: int
    kind: str
    entropy: float


# ---- entropy ---------------------------------------------------------------------------

_ALPHABETS = (("digits", regex.compile(r"\d+"), 10), ("hex", regex.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), ("lower", regex.compile(r"[a-z]+"), 26), ("base64", regex.compile(r"[A-Za-z0-9+/_=\-]+"), 64))


def alphabet(value: str) -> tuple[str, int]:
    """The smallest alphabet that holds the value, and its size."""
    return next(((name, size) for name, form, size in _ALPHABETS if form.fullmatch(value)), ("printable", 94))


def entropy(value: str) -> float:
    """Shannon entropy in bits per symbol."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


@lru_cache(16384)
def random_entropy(length: int, size: int) -> float:
    """Mean entropy of a random string of ``length`` symbols of an alphabet of ``size``.

    Each symbol occurs k times with binomial probability and then adds -(k/n) log2(k/n). Of more than
    LONG_STRING symbols the bias (size - 1) / (2 n ln 2) is accurate enough.
    """
    if length > LONG_STRING:
        return math.log2(size) - (size - 1) / (2 * length * math.log(2))
    total, p = 0.0, (1 - 1 / size) ** length
    for k in range(1, length + 1):
        p *= (length - k + 1) / k / (size - 1)
        total -= p * (k / length) * math.log2(k / length)
    return size * total


LONG_STRING = 1000


def threshold(length: int, size: int, margin: float) -> float:
    """The entropy that a random string of that length and alphabet has on average, less ``margin`` of it."""
    return random_entropy(max(2, length), size) * (1 - margin)


#: How far below the entropy of a random string a value may stay, by what stands around it.
MARGINS = {"unnamed": 0.06, "assigned": 0.08, "weak name": 0.25, "key block": 0.3, "format": 0.3, "bytes": 0.4, "header": 0.4, "name": 0.55, "address": 0.6, "option": 0.6, "login": 0.6}


# ---- what isn't a credential --------------------------------------------------------------

_STAND_IN = regex.compile(
    r"(?i)^(?:[x*.\-_#?•…]+|none|null|nil|undefined|true|false|empty|unset|todo|tbd|fixme|n/?a|dummy|foo|bar|foobar|test(?:ing)?|demo|secret|password|passwd|pass|pw|pwd|token|user|username|admin|root|redacted|removed|hidden|masked|default|string|value|placeholder|my[_-]?(?:secret|password|token|key)|pass(?:word)?123|abc123)$"
    r"|change[_\-\s]?(?:me|it|this)|replace[_\-\s]?(?:me|this|with)|(?:your|the|my)[_\-\s][\w\-\s]*(?:here|key|secret|token|password|pass|value)|[_\-\s]here$|insert[_\-\s]|put[_\-\s]your|example|sample|placeholder|dummy|redacted|fake|not[_\-]?a[_\-]?(?:real|secret)|x{4,}|\*{3,}|\.{3}|^<.*>$|^\[.*\]$|^\{+.*\}+$|lorem"
)
_REFERENCE = regex.compile(
    r"(?i)\$\{|\$\(|^\$\w|^%\w+%$|\{\{|^#\{|^(?:process\.env|os\.(?:getenv|environ)|system\.getenv|std::env|env[:.(\[]|getenv|config[.(\[]|settings[.(\[]|secrets?[.(\[])|^(?:vault|ssm|arn|op|file|env|secret|secretsmanager|keyring|keychain|awssm|gcpsm|azkv|sops|aws|gcp|kv|k8s|ref)[:+]|^(?:/|\./|\.\./|~/|[a-z]:\\)[\w./\\ -]+$|^@[\w./-]+$|(?-i:^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$)|^https?://[^:@\s]+$|[\^$]\(|\[[a-z0-9A-Z\-_]+\][{+*]|\\d|\\w|\(\?"
)
_UUID = regex.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_DATA = regex.compile(r"(?i)^(?:data:|sha\d{1,3}-|sha\d{1,3}:|md5:|urn:|ssh-(?:rsa|ed25519|dss)|ecdsa-|AAAA[BCE]3Nza|-----BEGIN (?:CERT|[A-Z ]*PUBLIC))")
_SEQUENCE = regex.compile(r"abcdefgh|ABCDEFGH|01234567|12345678(?!\d*[a-zA-Z])|qwerty")

# ---- names -----------------------------------------------------------------------------

_SECRET_WORDS = (
    r"pass[_\-]?words?|passwd|pass[_\-]?phrase|pass[_\-]?code|passwort|kennwort|mot[_\-]?de[_\-]?passe|contrase(?:ñ|n)a|senha|парол\w*|密码|密碼|口令|パスワード|비밀번호"
    r"|secret|api[_\-]?key|(?:auth|access|api|bearer|refresh|session|private|security|deploy|bot|id|user|personal|app|db|mail|service)[_\-]?token|private[_\-]token"
    r"|(?:signing|enc|encryption|crypt(?:o|ion)?|private|access|account|master|shared|license|storage|service|deploy|hmac|aes|jwt|ssh)[_\-]?key|credentials?"
    r"|(?<![a-z])(?:pwd|pw|pass|psw)(?-i:(?![a-z]))|(?:db|smtp|root|admin|mail|ftp|user|redis|mysql|pg|sql|my|imap|ldap|proxy|ssh)_?(?:pass|pw|pwd)(?-i:(?![a-z]))"
)
# In camel case a short word ends where the next capital letter begins: dbPass, rootPw.
_NAME = regex.compile(rf"(?:(?i:{_SECRET_WORDS})|(?<=[a-z])(?:Pass|Pwd|Pw)(?![a-z])|(?<![A-Za-z])(?:PASS|PWD|PW)(?![A-Za-z])|(?:DB|SMTP)PASS)")
_WEAK_NAME = regex.compile(r"(?i)(?<![a-z])token(?![a-z])|(?<=[a-z])Token(?![a-z])")
_OTHER_THING = regex.compile(
    r"(?i)(?:[_\-.]?(?:ttl|min_?length|max_?length|length|len|labels?|limits?|names?|versions?|env|refs?|files?|paths?|re|regex|patterns?|hints?|ids?|urls?|uris?|counts?|sizes?|polic(?:y|ies)|prompts?|fields?|headers?|types?|min|max|expiry|expires?(?:_?(?:at|in))?|hash(?:es)?|stores?|managers?|providers?|params?|vars?|placeholders?|rotation|ages?|algo(?:rithm)?|formats?|title|text|message|msg|error|required|enabled|strength|rules?|reset|help|index|number|class|selector|element|input|prefix|suffix|scope|issuer|audience|endpoint|source|location|alias))$"
)
_ENCODED = regex.compile(r"(?i)[_\-.]?(?:b64|base64|encoded|enc(?:oded)?64|hex|raw)$")
_HASH_NAME = regex.compile(r"(?i)hash|digest|checksum|integrity|etag|commit|sha\d*|md5|crc|uuid|guid|trace|request|session_?id|revision|fingerprint|signature|icon|image|img|logo|avatar|font|charset|alphabet|public|certificate|thumbprint|build|version|nonce_re|pattern|regex|_re$")

# ---- formats that need no name -----------------------------------------------------------

_FORMATS = regex.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:"
    r"(?:sk|rk|pk)_(?:live|prod)_[A-Za-z0-9]{16,}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w\-]{16,}"
    r"|(?:AKIA|ASIA)[A-Z2-7][A-Z0-9]{15}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{16,}|xapp-[A-Za-z0-9\-]{16,}"
    r"|AIza[A-Za-z0-9_\-]{35}|SG\.[\w\-]{16,}\.[\w\-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{30,}|dop_v1_[0-9a-f]{30,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-_]{32,}|ya29\.[\w\-]{20,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}"
    r"|[a-z][a-z0-9]{1,20}_pat_[A-Za-z0-9]{14,}|[a-z][a-z0-9]{1,20}-tok-[A-Za-z0-9]{14,}"
    r")(?![A-Za-z0-9_])"
)
_KEY_BLOCK = regex.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = regex.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = regex.compile(r"(?:\\r|\\n|[\s\"'`+#/*>|\\])*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*\s*)*[A-Za-z0-9+/=]{16}")

_ADDRESS = regex.compile(r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://(?P<user>[^\s:/@\"'`<>?#]*|<[^>\s]*>|\$\{[^}]*\}):(?P<v>[^\s/\"'`]+?)@(?=[\w.\-\[$<{])")
_OPTION = regex.compile(
    r"(?i)(?<![\w\-])(?:--(?:password|passwd|pass|passphrase|token|secret|api-?key|auth-token|access-token|client-secret|secret-key|pwd)(?:\s+|=)(?P<q1>[\"']?)(?P<v1>[^\s\"'`]+)(?P=q1)"
    r"|sshpass\s+-p\s*(?P<q2>[\"']?)(?P<v2>[^\s\"'`]+)(?P=q2))"
)
# Short options mean a password behind certain commands only, which stand before them in the line.
_SHORT_OPTIONS = (
    (regex.compile(r"(?<=\s)-p(?P<q>[\"']?)(?P<v>[^\s\"'`\-][^\s\"'`]*)(?P=q)"), regex.compile(r"(?i)(?<![\w\-])(?:mysql|mariadb)\w*\s")),
    (regex.compile(r"\s(?:-u|--user)[\s=]+(?P<q>[\"']?)[^\s:\"'`]+:(?P<v>[^\s\"'`]+)(?P=q)"), regex.compile(r"(?i)(?<![\w\-])(?:curl|wget|http)\b")),
    (regex.compile(r"\s-a\s+(?P<q>[\"']?)(?P<v>[^\s\"'`]+)(?P=q)"), regex.compile(r"(?i)(?<![\w\-])redis-cli\s")),
)
_HEADER = regex.compile(r"(?i)(?:(?:X-)?(?:Api-Key|Auth-Token|Access-Token|Private-Token|Vault-Token|Gitlab-Token)\s*:\s*|\b(?:Bearer|Token)\s+(?=[\w\-.+/=:]{8}))(?P<v>[^\s\"'`,;]+)")
_BASIC = regex.compile(r"(?i)\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")

_LITERAL = r"(?:\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"
_CHAIN = regex.compile(rf"(?P<first>{_LITERAL})(?:(?:\s*\+\s*|[ \t]*\.\.?[ \t]*|[ \t]*\\?\r?\n[ \t]*(?:\+[ \t]*)?)(?P<more>{_LITERAL}))*")
#: From a name to its value: quotes, type notes, signs of assignment, wrappers that decode.
_TO_VALUE = regex.compile(
    r"[\"'`]?\)?(?:\s*:\s*(?:&(?:'static\s+)?)?(?:string|str|String|Optional\[str\]|char\*?|bytes)\s*(?==))?\s*"
    r"(?:(?::=|=>|={1,3}|:|,|\|)\s*|\bvalue\s*=\s*|(?:to|is|ist|est|es|lautet)\s+(?=[`\"'])|(?<=[\"'])\s+value\s*=\s*)"
    r"[{(\[]{0,2}\s*(?:(?:[A-Za-z_][\w.]*\.)?(?:b64decode|atob|decode|from|fromBase64|DecodeString|new\s+String|String|str|bytes|SecretStr|unhexlify)\(\s*){0,2}(?:[bBfFrRuU]{1,2}(?=[\"']))?"
)
_BARE = regex.compile(r"[^\s\"'`,;(){}<>|]{4,}(?=[ \t]*(?:[,;]?[ \t]*(?:#.*|//.*)?$|\|))", regex.M)
_LONG = regex.compile(r"(?P<q>[\"'`])(?P<v>[A-Za-z0-9+/=_\-]{20,}+)(?P=q)")
#: A long token without any name: quoted, or between blanks and brackets.
_TOKEN_RUN = regex.compile(r"(?<![A-Za-z0-9+/=_\-.:@$%&#?\\])[A-Za-z0-9][A-Za-z0-9+/_\-]{23,}+={0,2}(?![A-Za-z0-9+/=_\-(:@])")
#: What tells that such a token is no secret, right before it or anywhere before it in its line.
_NO_TOKEN_BEFORE = regex.compile(r"(?i)(?:base64,|sha\d{1,3}[-:= ]+|md5[-:= ]+|(?:ssh|ecdsa)-[\w\-]+ +|//[^\s\"'`]*|[/\\])$")
_NO_TOKEN_LINE = regex.compile(r"(?i)hash|digest|checksum|integrity|etag|commit|sha-?\d+|md5|crc|uuid|guid|fingerprint|signature|icon|image|img|logo|avatar|font|charset|alphabet|public|certificate|thumbprint|nonce|revision|trace|data:")
_ONLY_LITERAL = regex.compile(r"[\s\"'`#/*>|+\\\[\](){},;]*")
_LONG_NAME = regex.compile(r"(?P<name>[A-Za-z_$][\w$.\-]*)[\"'`]?\]?[ \t]*(?::=|=>|=|:)[ \t]*[{(]?[ \t]*$")
_BYTES = regex.compile(r"(?:new\s+byte\[\]\s*)?[\[{(]\s*(?P<v>(?:(?:\(byte\)\s*)?(?:0x[0-9a-fA-F]{1,2}|\d{1,3})\s*,\s*){7,}(?:\(byte\)\s*)?(?:0x[0-9a-fA-F]{1,2}|\d{1,3}))")
_BYTES_SIGN = regex.compile(r"[\"'`]?(?:\s*:\s*[\w\[\]; ]+(?==))?\s*(?::=|=>|=|:)\s*(?:\w+\()?")
# What a text has to hold before a form is looked for in it.
_STEMS = "pass pwd pw secret token kennwort mot_de motde contrase senha парол 密码 密碼 口令 パスワード 비밀번호 credential apikey api_key api-key _key -key signingkey enckey cryptkey cryptionkey accesskey privatekey masterkey sharedkey licensekey".split()
_PREFIXES = "k_live_ k_prod_ ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- AKIA ASIA xox xapp- AIza SG. npm_ pypi- dop_v1_ hf_ sk- ya29. eyJ _pat_ -tok-".split()
_OPTIONS = ("--", "-p", "-u", "--user", "-a ")
_HEADERS = ("bearer", "token", "-key")
_CODE = frozenset("ts tsx js jsx mjs cjs py java go rs rb php c cc cpp h hpp cs kt swift scala".split())


def _excluded(value: str) -> bool:
    return bool(_STAND_IN.search(value) or _REFERENCE.search(value) or _DATA.search(value) or _SEQUENCE.search(value))


def _strong(value: str, context: str | float) -> bool:
    """Above the threshold for its length, alphabet and context."""
    return entropy(value) >= threshold(len(value), alphabet(value)[1], MARGINS[context] if isinstance(context, str) else context)


#: Made of words: each in small letters with a vowel, perhaps with a capital, or a short run of capitals.
_WORDLIKE = regex.compile(r"(?:(?:[A-Z]?(?=[a-z]*[aeiouy])[a-z]{2,}|[A-Z]{2,6}(?![a-z])|[A-Z](?=[_\-.]|$))[_\-.:/]?)+(?:\(.*)?")


def _named_value(value: str) -> bool:
    """Whether a value with a telling name is a credential: not a word, a phrase, a number or a stand-in."""
    if len(value) < 6 or _excluded(value) or regex.search(r"\s", value) or not regex.search(r"\p{L}", value):
        return False
    kinds = sum(bool(regex.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\-.]"))
    has_digit = bool(regex.search(r"\d", value))
    if not has_digit and len(value) >= 8 and regex.search(r"[a-z]", value) and regex.search(r"[A-Z]", value) and not _WORDLIKE.fullmatch(value):
        return _strong(value, "format")
    if not has_digit and (kinds < 2 or regex.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+|[\w.]+\(?\)?|[\w\-]+", value)):
        # without a digit only what no word or identifier looks like
        return len(value) >= 16 and regex.fullmatch(r"[A-Za-z0-9+/=]+", value) is not None and kinds >= 2 and _strong(value, 0.15) and not regex.fullmatch(r"(?:[A-Z]?[a-z]+)+", value)
    return _strong(value, "name")


_WORD_RUN = regex.compile(r"[a-z]{5,}|[A-Z]{6,}")


def _wordy(value: str) -> bool:
    """Whether runs of small or of capital letters make up more of a value than chance does, a sixth: then it is put together from words."""
    return sum(map(len, _WORD_RUN.findall(value))) * 6 > len(value)


def _telling(name: str) -> bool:
    base = _ENCODED.sub("", name)
    return bool(_NAME.search(base)) and not _OTHER_THING.search(base)


def _decodes(value: str) -> str | None:
    """What base64 text holds, if it is printable."""
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return raw if raw.isprintable() else None


def _joined(m) -> tuple[str, int, int]:
    """Value of a chain of literals and the span of its pieces without the outer quotes."""
    parts = m.captures("first") + m.captures("more")
    return "".join(p[1:-1] for p in parts), m.start("first") + 1, m.end() - 1


def find(text: str | None, path: str | None = None) -> list[Found]:
    """Credential values of a text, by place, none inside another. None and empty texts have none."""
    if not text:
        return []
    out: list[Found] = []
    ext = (path or "").rsplit(".", 1)[-1].lower()

    def add(start: int, end: int, kind: str, value: str | None = None) -> None:
        out.append(Found(start, end, kind, round(entropy(value if value is not None else text[start:end]), 3)))

    if "PRIVATE KEY" in text:
        for m in _KEY_BLOCK.finditer(text):
            body = _KEY_BODY.match(text, m.end())
            if body or not text[m.end() :].strip(" \r\n\\n\"'`+"):
                close = _KEY_END.search(text, m.end())
                other = _KEY_BLOCK.search(text, m.end())
                end = close.end() if close and (not other or close.start() < other.start()) else _block_end(text, m.end())
                body = regex.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", _KEY_END.sub("", regex.sub(r"(?m)^\W*(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*", "", text[m.end() : end])))
                if not body or _strong(body, "key block"):  # cut off behind its first line, it is one all the same
                    add(m.start(), end, "private key", body)
    if any(p in text for p in _PREFIXES):
        for m in _FORMATS.finditer(text):
            if not _STAND_IN.search(m.group()) and _strong(regex.sub(r"^(?:AKIA|ASIA|AIza)|^.*(?:_live_|_pat_|-tok-|_|-)", "", m.group()) or m.group(), "format"):
                add(m.start(), m.end(), "token")
    if "://" in text and "@" in text:
        for m in _ADDRESS.finditer(text):
            v = m.group("v")
            if len(v) >= 4 and not _excluded(v) and not _REFERENCE.search(m.group("user") or "") and not v.isdigit() and _strong(v, "address"):
                add(m.start("v"), m.end("v"), "address")
    if any(p in text for p in _OPTIONS):
        for m in _OPTION.finditer(text):
            g = next(k for k in ("v1", "v2") if m.group(k))
            v = m.group(g)
            if len(v) >= 4 and not _excluded(v) and _strong(v, "option"):
                add(m.start(g), m.end(g), "option")
        for option, command in _SHORT_OPTIONS:
            for m in option.finditer(text):
                v = m.group("v")
                if len(v) >= 4 and not _excluded(v) and _strong(v, "option") and command.search(text, text.rfind("\n", 0, m.start()) + 1, m.start() + 1):
                    add(m.start("v"), m.end("v"), "option")
    low = text.lower()
    if any(p in low for p in _HEADERS):
        for m in _HEADER.finditer(text):
            v = m.group("v")
            if len(v) >= 8 and not _excluded(v) and regex.search(r"\d", v) and _strong(v, "header"):
                add(m.start("v"), m.end("v"), "header")
    if "basic " in low:
        for m in _BASIC.finditer(text):
            inner = _decodes(m.group("v"))
            if inner and ":" in inner and not _excluded(inner.split(":", 1)[1]) and _strong(inner.split(":", 1)[1], "login"):
                add(m.start("v"), m.end("v"), "header")
    if any(p in low for p in _STEMS):
        for m in _NAME.finditer(text):
            _assigned(text, m, ext, add)
    if "token" in low:
        for m in _WEAK_NAME.finditer(text):
            _assigned(text, m, ext, add, weak=True)
    if "name:" in text:
        for m in regex.finditer(r"(?m)^[ \t]*-?[ \t]*name:[ \t]*[\"']?(?P<n>[\w.\-]+)[\"']?[ \t]*\r?\n[ \t]*value:[ \t]*(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)[ \t\r]*$", text):
            if _telling(m.group("n")) and _named_value(m.group("v")):
                add(m.start("v"), m.end("v"), "setting")
    for m in _LONG.finditer(text):
        v = m.group("v")
        at = _LONG_NAME.search(text, max(text.rfind("\n", 0, m.start()) + 1, m.start() - 120), m.start())
        if not at:
            continue
        name = at.group("name")
        if _HASH_NAME.search(name) or _OTHER_THING.search(name) or _excluded(v) or _UUID.fullmatch(v) or alphabet(v)[0] != "base64":
            continue
        if all(regex.search(k, v) for k in (r"[a-z]", r"[A-Z]", r"\d")) and not _wordy(v) and _strong(v, "assigned"):
            add(m.start("v"), m.end("v"), "string")
    for m in _TOKEN_RUN.finditer(text):
        v = m.group()
        if not (regex.search(r"[a-z]", v) and regex.search(r"[A-Z]", v) and regex.search(r"\d", v)) or alphabet(v)[0] != "base64" or _wordy(v) or not _strong(v, "unnamed"):
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        before, after = text[start : m.start()], text[m.end() : end if end >= 0 else len(text)]
        if _ONLY_LITERAL.fullmatch(before) and _ONLY_LITERAL.fullmatch(after):
            continue
        if not (_NO_TOKEN_BEFORE.search(before) or _NO_TOKEN_LINE.search(before) or _excluded(v)):
            add(m.start(), m.end(), "token")
    out.sort(key=lambda f: (f.start, -f.end))
    kept: list[Found] = []
    for f in out:
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
    return kept


def _block_end(text: str, at: int) -> int:
    """End of a key without an end mark: the lines that look like its body."""
    m = regex.compile(r"(?:\\r|\\n|[\s\"'`+#/*>|\\]|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/=]+(?=\s*$))*").match(text, at)
    return len(text[: m.end()].rstrip()) if m else at


def _assigned(text: str, m, ext: str, add, weak: bool = False) -> None:
    """The value that follows a telling name, if it is a credential."""
    a, b = m.start(), m.end()
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_-.$"):
        a -= 1
    while b < len(text) and (text[b].isalnum() or text[b] in "_-"):
        b += 1
    name = text[a:b].strip("-.$")
    last = name.rsplit(".", 1)[-1]
    base = _ENCODED.sub("", last)
    if _OTHER_THING.search(base) or weak and not (_WEAK_NAME.search(base) and regex.search(r"(?i)token$", base)):
        return
    if not weak and not _telling(last):
        return
    sign = _BYTES_SIGN.match(text, b)
    numbers = _BYTES.match(text, sign.end()) if sign and not weak else None
    if numbers:
        given = regex.findall(r"0x[0-9a-fA-F]+|\d+", numbers.group("v"))
        held = "".join(chr(int(g, 0) & 255) for g in given)
        if _strong(held, "bytes"):
            add(numbers.start("v"), numbers.end("v"), "bytes", held)
        return
    to = _TO_VALUE.match(text, b)
    if not to:
        return
    chain = _CHAIN.match(text, to.end())
    if chain:
        value, start, end = _joined(chain)
        if text.startswith(":", chain.end()) and not value:
            return
        if _KEY_BLOCK.match(value):
            return
        inner = value
        if _ENCODED.search(last) or "decode" in to.group().lower() or "atob" in to.group():
            inner = _decodes(value) or value
        user = regex.match(r"[\w.\-]{2,40}:(?=[^\s:/]{6,}$)", inner)
        value = inner[user.end() :] if user else inner
        good = _named_value(value) or user is not None and _named_value(inner)
        if weak:
            good = good and len(value) >= 12 and regex.search(r"\d", value) is not None and _strong(value, "weak name")
        if good:
            add(start, end, "assignment", value)
        return
    line = text.rfind("\n", 0, a) + 1
    comment = regex.match(r"\s*(?:#|//|;|\*|<!--|>|--)", text[line:a]) is not None
    if (ext in _CODE and not comment) or "\n" in to.group() or to.group().strip() in (",",) or weak:
        return
    bare = _BARE.match(text, to.end())
    if bare and _named_value(bare.group()) and not regex.fullmatch(r"[A-Za-z_][\w.]*\(.*|[a-z_]+(?:\.[a-z_]+)+", bare.group()):
        add(bare.start(), bare.end(), "setting")


_NUMBER = regex.compile(r"0[xX][0-9a-fA-F]+|\d+")
_KEPT_IN_PIECES = regex.compile(r"(?P<keep>[\"'`](?:\s|[+.\\])*[\"'`])|(?P<c>\S)")
_KEPT_IN_KEYS = regex.compile(r"(?P<keep>\\[nr]|-----[A-Z0-9 ]+-----|[\"'`]|(?<=[\"'`]) *[+.\\]+|(?m:^[ \t]*(?:#+|//+|\*+|>+|\+)))|(?P<c>[A-Za-z0-9+/=:,\-])")


def _zero(number: str) -> str:
    """A number of the same width that every language reads as nought."""
    return number[:2] + "0" * (len(number) - 2) if number[:2] in ("0x", "0X") else "0".rjust(len(number))


def redact(text: str, found: list[Found], mark: str = "x") -> str:
    """The text with each value blanked, its length, line breaks and quotes kept, so that all else stays in place and still parses.

    Letters take the place of letters, signs and digits, which every language takes for a plain value, and
    noughts that of numbers in lists. Quotes and signs between the pieces of a value stay.
    """

    def keep(m) -> str:
        return m.group("keep") or mark

    out, at = [], 0
    for f in found:
        out.append(text[at : f.start])
        value = text[f.start : f.end]
        if f.kind == "bytes":
            value = _NUMBER.sub(lambda m: _zero(m.group()), value)
        elif f.kind == "private key":
            value = _KEPT_IN_KEYS.sub(keep, value)
        elif f.kind == "assignment":
            value = _KEPT_IN_PIECES.sub(keep, value)
        else:
            value = regex.sub(r"\S", mark, value)
        out.append(value)
        at = f.end
    out.append(text[at:])
    return "".join(out)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for id_, path, text, first in zip(pdf["id"], pdf["file_path"], pdf["chunk_text"], pdf["start_line"]):
            for f in find(text, path):
                line = None if pd.isna(first) else int(first) + text.count("\n", 0, f.start)
                rows.append((id_, line, f.start, f.end, f.kind, f.entropy))
        yield pd.DataFrame(rows, columns=["id", "line_no", "start_char", "end_char", "kind", "entropy"]).astype({"line_no": "Int32"})


def find_credentials(chunks: DataFrame) -> DataFrame:
    """One row per credential value: id, line_no (in the file), start_char, end_char, kind, entropy.

    ``chunks`` needs id, file_path, chunk_text, start_line. Null ids and null texts give no row, a
    null path counts as an unknown sort of file, a null start_line gives a null line. Rows that
    repeat an id give their values again (use distinct). Rows are independent: no shuffle.
    """
    return (
        chunks.where(F.col("id").isNotNull() & F.col("chunk_text").isNotNull()).select("id", "file_path", "chunk_text", F.col("start_line").cast("int").alias("start_line"))
        .mapInPandas(_scan, "id long, line_no int, start_char int, end_char int, kind string, entropy double")
    )


def redact_credentials(chunks: DataFrame) -> DataFrame:
    """(id, chunk_text, values): each row's text with the values blanked, and how many there were."""

    def blank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [find(t, p) if t else [] for t, p in zip(pdf["chunk_text"], pdf["file_path"])]
            yield pd.DataFrame({"id": pdf["id"], "chunk_text": [redact(t, f) if f else t for t, f in zip(pdf["chunk_text"], found)], "values": [len(f) for f in found]})

    return chunks.select("id", "file_path", "chunk_text").mapInPandas(blank, "id long, chunk_text string, values int")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "file_path", "chunk_text", "start_line"), "id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all chunks on which a credential value starts."""
    return find_credentials(_chunks(spark, sf_dir)).select("id", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, credentials blanked."""
    return redact_credentials(_chunks(spark, sf_dir))


SQL: dict[str, str] = {}
