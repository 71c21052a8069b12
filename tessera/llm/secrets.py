"""Credentials in source code and settings: find every one, redact it, keep the code valid.

Method: a trigram index over chunks of the texts. Each detector is a regular expression with
an acceptance test; ``grams.required`` derives the grams that any match must hold, the index
of a shard intersects the postings of those grams, and only the surviving chunks are read by
the expression. A shard is one Arrow batch, so indexing, lookup and check need no shuffle.

Defined cases: a null or empty text has no findings; rows delivered twice give one finding;
several secrets that begin on one line are one row of ``found``; a value written in several
literals counts at its first literal; texts of any length are read whole, in chunks cut at
line ends; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.grams import ShardIndex, required
from tessera.session import spread

#: Characters of a chunk; of the text around it that is searched at first; and of the text behind
#: it that is indexed with it, so that a match which begins in it finds all of its grams.
CHUNK, BEYOND, AHEAD = 32_768, 400, 32_768


class Hit(NamedTuple):
    start: int
    end: int
    kind: str


# Spellings of placeholders, references and digests that are no secrets.
PLACEHOLDER = re.compile(
    r"""(?ix)
    ^$ | \$\{ | \{\{ | \$\( | %\( | ^<[^>]*>$ | ^\[[^\]]*\]$ | ^\$[A-Z_]
    | ^(?:process\.env|os\.environ|os\.getenv|import\.meta|env|vault|keychain|keyring|secretsmanager|ssm|arn|op|ref|file|gcp|aws-sm)\b[:.\[(+/]
    | \*{3,} | \u2022{2,} | \u25cf{2,} | (?-i:x{4,}|X{4,}) | \.{3,} | \#{4,} | _{4,} | ^0+$ | (?:1234567|abcdefg)
    | ^(?:sha\d{1,3}|md5|crc32|blake2\w?)[-:=] | ^data:
    | ^(?:your|my|an?|the|some|insert|enter|add|put|replace|change|changeme|todo|tbd|fixme|none|null|nil|undefined|unset|not|example|sample|dummy|fake|mock
        |placeholder|redacted|hidden|masked|default|test|secret|password|passwd|pass|token|key|apikey|user|username|admin|root|guest|true|false)(?:[\s_\-]+[a-z]+)*$
    | ^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$
    """
)
# Names under which random-looking text is no credential.
BENIGN = re.compile(
    r"(?i)hash|sha\d*|md5|digest|checksum|integrity|etag|commit|revision|cache|trace|request|correlation|uuid|guid|avatar|sprite|icon|image|logo|font|glyph"
    r"|label|hint|help|title|text|message|placeholder|public|verify|cert|fingerprint|nonce|salt(?!y)|(?<![a-z])id(?![a-z])|Id(?![a-z])|_id\b"
)
#: Names of values that are secret whatever they look like.
STRONG = re.compile(
    r"(?i)(?:passw(?:or)?d|passphrase|passcode|pwd|(?:db|user|admin|root|smtp|ftp|ssh|my)[_-]?pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential|login)"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
HEX = re.compile(r"(?i)^[0-9a-f]+$")


#: Letters of a value from which on only a telling name makes it a secret: without one it may be data.
LONG = 128


def entropy(text: str) -> float:
    """Bits per character of the letters of *text*."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def opaque(value: str) -> bool:
    """A long random token: letters of both cases and digits, evenly used and often alternating."""
    if len(value) < 32 or PLACEHOLDER.search(value) or UUID.match(value) or HEX.match(value):
        return False
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    if not {"d", "u", "l"} <= set(kinds):
        return False
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return entropy(value) >= 3.7 and turns >= len(value) * 0.3


def guessable(value: str) -> bool:
    """What people use as a password: no blanks, at least 6 letters, more than plain words."""
    if len(value) < 6 or len(value) > LONG and entropy(value) < 3.7 or re.search(r"[\s/\\(){}<>,;]|://", value) and not opaque(value) or PLACEHOLDER.search(value):
        return False
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", value)
    jumbled = len(value) >= 10 and len(value) / max(1, len(words)) < 3.2
    if not value.isascii() or re.fullmatch(r"[\d.:\-]+|\d+(?:px|ms|s|em|rem|%)", value) or not jumbled and re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", value):
        return False
    lower, upper, digit = (any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    other = any(not c.isalnum() and c not in "_-." for c in value)
    return digit and (lower or upper or other) or other and (lower or upper) and len(value) >= 8 or jumbled and lower and upper


def _whole(m: re.Match) -> list[tuple[int, int]]:
    return [m.span("v")]


def _token(m: re.Match) -> list[tuple[int, int]]:
    value = m["v"]
    return [] if PLACEHOLDER.search(value) or len(set(value)) < 8 else [m.span("v")]


def _pem(m: re.Match) -> list[tuple[int, int]]:
    """From the opening line to the end of the body; the body must be more than a sample."""
    body = re.compile(r"(?:\\n|\\r|[\sA-Za-z0-9+/=:,-])*").match(m.string, m.end())
    end = m.string.find("-----END", m.end(), body.end() + 8)
    end = end if end >= 0 else body.end()
    letters = re.sub(r"\\[nr]|\s", "", m.string[m.end() : end])
    return [(m.start(), end)] if len(letters) >= 16 and len(set(letters)) >= 8 else []


def _basic(m: re.Match) -> list[tuple[int, int]]:
    try:
        plain = base64.b64decode(m["v"] + "=" * (-len(m["v"]) % 4)).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return []
    return [m.span("v")] if re.fullmatch(r"[^\s:]+:[!-~]+", plain) and not PLACEHOLDER.search(plain.partition(":")[2]) else []


def _bearer(m: re.Match) -> list[tuple[int, int]]:
    return [m.span("v")] if not PLACEHOLDER.search(m["v"]) and re.search(r"\d", m["v"]) and entropy(m["v"]) >= 3 else []


def _address(m: re.Match) -> list[tuple[int, int]]:
    return [m.span("v")] if len(m["v"]) >= 3 and not PLACEHOLDER.search(m["v"]) else []


def _parameter(m: re.Match) -> list[tuple[int, int]]:
    v = m["v"]
    return [m.span("v")] if not PLACEHOLDER.search(v) and re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and entropy(v) >= 3 else []


def _named(m: re.Match) -> list[tuple[int, int]]:
    name, value = m["name"], m["v"]
    if not STRONG.search(name) or BENIGN.search(re.sub(STRONG, "", name)):
        return []
    stripped = value.strip()
    if HEX.match(stripped) and len(stripped) in (32, 40, 64):
        return [m.span("v")]
    return [m.span("v")] if value == stripped and guessable(value) else []


NAME_BEFORE = re.compile(r"""([\w.\-]+)["']?\s*(?::\s*[A-Za-z<>\[\]]+\s*)?(?:=>|[:=])\s*(?:\w{1,2})?$""")


def _opaque_literal(m: re.Match) -> list[tuple[int, int]]:
    if not opaque(m["v"]):
        return []
    name = _name_before(m.string, m.start("v") - ("q" in m.re.groupindex))
    if len(m["v"]) > LONG and not STRONG.search(name):
        return []
    return [] if BENIGN.search(name) and not STRONG.search(name) else [m.span("v")]


def _name_before(text: str, at: int) -> str:
    """The name to which the value at *at* is given on its line, or ""."""
    name = NAME_BEFORE.search(text[max(text.rfind("\n", 0, at) + 1, at - 80) : at])
    return name[1] if name else ""


def _opaque_comment(m: re.Match) -> list[tuple[int, int]]:
    """Every token of the comment line, each judged by the words since the token before it."""
    end = m.string.find("\n", m.end())
    out, lead, at = [], "", m.start("lead")
    for t in RUN.finditer(m.string, m.start("v"), end if end >= 0 else len(m.string)):
        between = m.string[at : t.start("v")]
        lead, at = between if re.search(r"\w", between) else lead, t.end()
        if opaque(t["v"]) and re.search(r"\w", lead) and not BENIGN.search(lead) and (len(t["v"]) <= LONG or STRONG.search(lead)):
            out.append(t.span("v"))
    return out


RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])(?P<v>[A-Za-z0-9+/_-]{32,}={0,2})(?![A-Za-z0-9+/_=.-])")
PART = re.compile(r"""(?P<q>["'`])(?P<v>[A-Za-z0-9+/=_.\-]{4,})(?P=q)""")


def _joined(m: re.Match) -> list[tuple[int, int]]:
    """Literals that are one value: the whole must look like a token; the first one counts."""
    parts = list(PART.finditer(m.string, m.start(), m.end()))
    value = "".join(p["v"] for p in parts)
    if len(parts) < 2 or not (opaque(value) or any(d.shape.fullmatch(value) and d.accept(d.shape.fullmatch(value)) for d in DETECTORS if d.alone)):
        return []
    if len(value) > LONG and not STRONG.search(re.sub(r"[\s(\[\\]+$", "", m.string[max(0, m.start() - 80) : m.start()]).rsplit("\n", 1)[-1]):
        return []
    return [p.span("v") for p in parts]


class Detector(NamedTuple):
    name: str
    shape: re.Pattern
    accept: Callable[[re.Match], list[tuple[int, int]]]
    alone: bool = False  # the shape is that of a whole value
    many: bool = False  # every span is a value of its own


_LITERAL = r"""(?P<q>["'`])"""
# Prefixes with which providers mark their tokens.
_PREFIX = r"(?:sk|pk|rk|rt|ghp|gho|ghu|ghs|ghr|ghx|glpat|xoxb|xoxp|xoxa|hf|npm)[-_](?:(?:live|test|proj|ant)[-_])?"
DETECTORS = (
    Detector("private_key", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"), _pem),
    Detector("prefixed_token", re.compile(rf"(?<![A-Za-z0-9_])(?P<v>{_PREFIX}[A-Za-z0-9]{{20,}}(?:[-_][A-Za-z0-9]+)*)"), _token, True),
    Detector("key_id", re.compile(r"(?<![A-Za-z0-9_])(?P<v>(?:AKZ|AKIA|ASIA)[A-Z0-9]{16,17})(?![A-Za-z0-9])"), _token, True),
    Detector("dotted_key", re.compile(r"(?<![A-Za-z0-9_.])(?P<v>[0-9a-f]{32}\.[A-Za-z0-9]{16})(?![A-Za-z0-9])"), _token, True),
    Detector("signed_token", re.compile(r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"), _token, True),
    Detector("basic_header", re.compile(r"\b[Bb]asic\s(?P<v>[A-Za-z0-9+/]{8,}={0,2})"), _basic),
    Detector("bearer_header", re.compile(r"\b[Bb]earer\s(?P<v>[A-Za-z0-9._~+/-]{16,}=*)"), _bearer),
    Detector("address", re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@'"`<>]*:(?P<v>[^\s@/'"`]+)@"""), _address),
    Detector("address_parameter", re.compile(r"[?&](?:api_?key|access_?key|key|sig|signature|access_token|auth_token|token|secret|password|passwd|pwd)=(?P<v>[A-Za-z0-9_~+/%.-]{12,})", re.I), _parameter),
    Detector(
        "named_literal",
        re.compile(r"""(?<![\w.-])(?P<name>[\w.-]*(?:pass|pwd|secret|token|key|credential|login)[\w-]*)["']?\]?\s*(?::\s*[A-Za-z?<>\[\]| ]{1,30})?(?:=|:|=>|,|\|\||\?\?)\s*r?(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)""", re.I),
        _named,
    ),
    Detector("named_setting", re.compile(r"^[ \t-]*(?:export )?(?P<name>[\w.-]*(?:pass|pwd|secret|token|key|credential|login)[\w-]*)[ \t]*[:=][ \t]*(?P<v>[^\s\"'`][^\n\"'`]*?)[ \t\r]*$", re.I | re.M), _named),
    Detector("opaque_literal", re.compile(r"""(?P<q>["'`])(?P<v>[A-Za-z0-9+/_-]{32,}={0,2})(?P=q)"""), _opaque_literal),
    Detector("opaque_setting", re.compile(r"^[ \t]*(?:-[ \t]+|[\w.-]+[ \t]*[:=][ \t]*)(?P<v>[A-Za-z0-9+/_-]{32,}={0,2})[ \t\r]*$", re.M), _opaque_literal),
    Detector("opaque_comment", re.compile(r"^[ \t]*(?://+|#+|\*|/\*+|<!--|--)(?P<lead>[^\n]*?)(?<![A-Za-z0-9+/_.-])(?P<v>[A-Za-z0-9+/_-]{32,}={0,2})(?![A-Za-z0-9+/_=.-])", re.M), _opaque_comment, many=True),
    Detector("joined_literals", re.compile(r"""(?P<q>["'`])[A-Za-z0-9+/=_.-]{4,}(?P=q)(?:(?: \+|\+| \\)?(?:[ \t]*\r?\n)?[ \t]*(?P=q)[A-Za-z0-9+/=_.-]{4,}(?P=q))+|(?P<p>["'`])[A-Za-z0-9+/=_.-]{4,}(?P=p) \+ (?P=p)[A-Za-z0-9+/=_.-]{4,}(?P=p)"""), _joined),
)
#: The same expressions in an engine that tells whether a match could go on beyond the end of the text.
PARTIAL = {d.name: regex.compile(d.shape.pattern, (regex.I if d.shape.flags & re.I else 0) | (regex.M if d.shape.flags & re.M else 0)) for d in DETECTORS}
PLANS = {d.name: required(d.shape.pattern) for d in DETECTORS}
# What can follow the quote that ends the first of two joined literals, each way the expression lets them meet.
GAPS = ("+", " +", " \\", "\t", "\r\n", *("\n" + c for c in " \t"), *(" " + c for c in " \t\r\n"))
PLANS["joined_literals"] = frozenset(frozenset([q + gap]) for q in "\"'`" for gap in (*GAPS, q, "\n" + q, " " + q))


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of *text* of about CHUNK characters, cut after line ends where there are any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text):
            cut = text.rfind("\n", at, end)
            end = cut + 1 if cut > at else end
        yield at, end
        at = end


def reach(text: str, d: Detector, lo: int, hi: int) -> int:
    """Where to end the search in a chunk: so far that no match which begins in it is cut off.

    The end is moved on as long as a match that begins before the chunk's end could go on there.
    """
    end = min(len(text), hi + BEYOND)
    while end < len(text):
        last = None
        for last in PARTIAL[d.name].finditer(text, max(lo, hi - CHUNK), end, partial=True):
            pass
        if last is None or last.start() >= hi or last.end() < end:
            return end
        end = min(len(text), hi + 4 * (end - hi))
    return end


def scan(texts: list[str]) -> Iterator[tuple[int, list[Hit]]]:
    """Ordinal and findings of every text that has any; the texts are one shard."""
    pieces = [(n, *span) for n, text in enumerate(texts) for span in chunks(text)]
    index = ShardIndex([texts[n][max(0, lo - BEYOND) : hi + AHEAD] for n, lo, hi in pieces], PLANS)
    raw: dict[int, list[tuple[bool, int, list[tuple[int, int]], str]]] = {}
    for d in DETECTORS:
        for k in index.candidates(d.name):
            n, lo, hi = pieces[k]
            for m in d.shape.finditer(texts[n], max(0, lo - BEYOND), reach(texts[n], d, lo, hi)):
                spans = d.accept(m)
                for own in [[x] for x in spans] if d.many else [spans] if spans else []:
                    if lo <= (m.start() if d.many else own[0][0]) < hi:
                        raw.setdefault(n, []).append((len(own) == 1, own[0][0], own, d.name))
    for n, found in sorted(raw.items()):
        taken: list[Hit] = []
        for _, _, spans, kind in sorted(found, key=lambda x: (x[0], x[1], -x[2][0][1])):  # joined values claim their parts first
            if not any(s < t.end and t.start < e for s, e in spans for t in taken):
                taken += [Hit(s, e, kind if i == 0 else "") for i, (s, e) in enumerate(spans)]
        yield n, sorted(taken)


MASK = "REDACTED"


def redact(text: str, hits: list[Hit]) -> str:
    """*text* with only the secret letters replaced; key files keep their frame and line count."""
    out, at = [], 0
    for start, end, kind in hits:
        out.append(text[at:start])
        secret = text[start:end]
        if kind == "private_key":
            head = re.match(r"-----BEGIN [^-\n]*-----", secret)[0]
            out.append(head + re.sub(r"[A-Za-z0-9+/=]{2,}(?![A-Za-z]*:)", MASK, re.sub(r"\\([nr])", "\\\\\\1\u0000", secret[len(head) :])).replace("\u0000", "") if "\\n" not in secret else head + _escaped(secret[len(head) :]))
        else:
            out.append(MASK)
        at = end
    return "".join(out) + text[at:]


def _escaped(body: str) -> str:
    return "".join(p if p in ("\\n", "\\r", "") else MASK for p in re.split(r"(\\[nr])", body))


FINDING = "place string, rec_id long, line_no int, kind string, start long, length int"


def findings(rows: DataFrame, place: str, key: str, column: str, field: str = "") -> DataFrame:
    """All findings in *column*. *field* names a settings field, which counts as the name of the value."""
    head = f"{field} = '" if field else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, values = batch[key].tolist(), batch[column].tolist()
            texts = [head + field_value(v) + "'" for v in values] if field else values
            out = []
            for n, hits in scan(texts):
                breaks, at = 1, 0
                for h in hits:
                    if not h.kind:
                        continue
                    breaks, at = breaks + texts[n].count("\n", at, h.start), h.start
                    out.append((place, ids[n], 1 if field else breaks, h.kind, max(0, h.start - len(head)), h.end - h.start))
            yield pd.DataFrame(out, columns=["place", "rec_id", "line_no", "kind", "start", "length"])

    texts = rows.select(F.col(key).cast("long").alias(key), column).where(F.col(column).isNotNull() & (F.length(column) > 0))
    return spread(texts, key).mapInPandas(run, FINDING)


def field_value(value: str) -> str:
    """A settings value without the blanks, quotes and line ends that strayed around it."""
    return value.strip().strip("\"'`").strip().replace("'", "\u2019").replace("\n", " ")


def redacted_field(value: str, field: str) -> tuple[int, str]:
    """Number of secrets in a settings value, and the value with them masked; what strayed around it stays."""
    head, core = f"{field} = '", field_value(value)
    before = len(value) - len(value.lstrip())
    before += len(value[before:]) - len(value[before:].lstrip("\"'`"))
    before += len(value[before:]) - len(value[before:].lstrip())
    for _, hits in scan([head + core + "'"]):
        own = [Hit(max(0, h.start - len(head)) + before, min(len(core), h.end - len(head)) + before, h.kind) for h in hits if h.end > len(head)]
        return sum(bool(h.kind) for h in own), redact(value, own)
    return 0, value


#: The settings columns that can hold secrets, with the names of their values.
FIELDS = (("api_key", "apiKey"), ("api_endpoint", "apiEndpoint"))


def redacted_settings(settings: DataFrame) -> DataFrame:
    """``place, config_id, n_secrets, text`` for every settings value that holds a secret, the secret masked in *text*."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for column, field in FIELDS:
                for i, v in zip(batch["config_id"].tolist(), batch[column].tolist(), strict=True):
                    n, text = redacted_field(v, field) if v else (0, "")
                    if n:
                        out.append((f"provider_config.{column}", i, n, text))
            yield pd.DataFrame(out, columns=["place", "config_id", "n_secrets", "text"])

    rows = settings.select(F.col("config_id").cast("long").alias("config_id"), *(c for c, _ in FIELDS))
    return spread(rows, "config_id").mapInPandas(run, "place string, config_id long, n_secrets int, text string").dropDuplicates(["place", "config_id"])


def all_findings(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Findings in file contents and in the two secret-bearing fields of the provider settings."""
    return (
        findings(files, "files.content", "file_id", "content")
        .unionByName(findings(settings, "provider_config.api_key", "config_id", "api_key", "apiKey"))
        .unionByName(findings(settings, "provider_config.api_endpoint", "config_id", "api_endpoint", "apiEndpoint"))
    )


def redacted(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, n_secrets, text`` for every row that holds a secret, the secret masked in *text*."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch[key].tolist(), batch[column].tolist()
            yield pd.DataFrame(
                [(ids[n], sum(bool(h.kind) for h in hits), redact(texts[n], hits)) for n, hits in scan(texts)],
                columns=[key, "n_secrets", "text"],
            )

    texts = rows.select(F.col(key).cast("long").alias(key), column).where(F.col(column).isNotNull() & (F.length(column) > 0))
    return spread(texts, key).mapInPandas(run, f"{key} long, n_secrets int, text string").dropDuplicates([key])
