"""Secret scans: pattern kinds, and strings that an identifier dictionary and the surrounding code can't compress."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrow import map_batches

#: Fixed values of the base kinds, in the order in which they are listed: kind, pattern, group, least length.
BASE_KINDS = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Each base pattern's literal beginnings, lower case; a text without one has no match.
_STARTS = {"assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), "access": (b"akia",)}
#: Words that make a place sensitive.
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "credential", "private_key", "private key",
    "access_key", "access-key", "auth", "bearer", "signature", "connectionstring", "ssh-rsa", "ssh-ed25519",
)
#: Identifiers and prose of ordinary code, which prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret credential authorization bearer "
    "username userpassword user_name account session_token refresh_token access_token id_token csrf_token connectionstring "
    "example placeholder changeme your-api-key-here your_password xxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ http://localhost:8080/ https://www.example.com/index.html application/json text/plain utf-8 base64 "
    "getElementById addEventListener toString valueOf hashCode equals length substring indexOf parseInt function return import export default "
    "public static void final class interface private protected string integer boolean double float config settings environment variable "
    "os.environ.get process.env System.getenv readFile writeFile openConnection createStatement executeQuery selectorAll documentElement "
    "userAccount defaultSettings eventHandler sessionManager dataService pageController objectFactory serviceProvider httpRequest httpResponse "
    "requestContext stringBuilder eventListener listAdapter userRepository runtimeException clientMessage serverState indexValue internalError "
    "2020-01-01T00:00:00Z 127.0.0.1 255.255.255.255 /usr/local/bin /etc/config /home/user version 1.0.0 true false null none undefined"
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_HEX_BYTES = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))


@dataclass(frozen=True)
class SecretParams:
    """min_length: of a novel string, in characters. reach: how many characters before it may hold the sensitive word, and next: the
    end of another novel string. surround: characters on each side that prime the compressor. novelty: least marginal bytes per character of
    a string that zstandard doesn't entropy-code, shorter than `coded`. alphabet: of a longer one, the least share of the bytes that a
    random string over the same characters has."""

    min_length: int = 16
    reach: int = 48
    next: int = 3
    surround: int = 256
    novelty: float = 0.75
    coded: int = 64
    alphabet: float = 0.9


def _base_spans(text: str, narrow: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches; narrow holds one byte for each character of text."""
    low, found = narrow.lower(), []
    for n, (kind, _, group, least) in enumerate(BASE_KINDS):
        if kind == "hex":
            if b"h" * least not in narrow.translate(_HEX_BYTES):
                continue
        elif not any(s in low for s in _STARTS[kind]):
            continue
        for m in _PATTERNS[n].finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(group), n, m.end(group)))
    return found


#: Runs of hex digits shorter than the least length are skipped at once: a run matches as a whole or not at all.
_PATTERNS = [re.compile(p if kind != "hex" else r"[0-9a-f]{%d,}" % least, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)) for kind, p, _, least in BASE_KINDS]
_CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.ASCII | re.IGNORECASE)
_CONTEXT_BYTES = [w.encode() for w in CONTEXT_WORDS]


class Novelty:
    """Marginal compressed bytes of a string, given the identifier dictionary and the text around it."""

    def __init__(self, level: int = 3) -> None:
        self.level = level
        self.identifiers = IDENTIFIERS.encode()

    def per_character(self, candidate: str, before: str, after: str) -> float:
        primer = zstandard.ZstdCompressionDict(self.identifiers + after.encode("utf-8", "replace") + before.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False, write_checksum=False).compress
        return (len(squeeze(candidate.encode("utf-8", "replace"))) - len(squeeze(b""))) / max(1, len(candidate))


def _without_copies(s: str, text: str, start: int, end: int, surround: int) -> tuple[str, str]:
    """The surround on each side without other copies of s, those at its edges too: a repeated secret is no help to itself."""
    before = text[max(0, start - surround - len(s)) : start].replace(s, " ")
    after = text[end : end + surround + len(s)].replace(s, " ")
    return before[max(0, len(before) - surround) :], after[:surround]


#: Kinds of characters with their numbers; a string's alphabet is all of the kinds that it has, or the hex digits alone.
_KINDS = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[^0-9A-Za-z]"), 6))
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def alphabet_size(s: str) -> int:
    return 16 if _HEX.fullmatch(s) else sum(n for kind, n in _KINDS if kind.search(s))


def least_novelty(s: str, p: SecretParams) -> float:
    """Marginal bytes per character from which a string counts as incompressible."""
    if len(s) < p.coded:
        return p.novelty
    return min(p.novelty, p.alphabet * math.log2(max(2, alphabet_size(s))) / 8)


def incompressible(text: str, start: int, end: int, p: SecretParams, novelty: Novelty) -> bool:
    """Whether text[start:end] costs what a random string would, given the identifiers and the text around it."""
    s = text[start:end]
    return novelty.per_character(s, *_without_copies(s, text, start, end, p.surround)) >= least_novelty(s, p)


def candidates(text: str, narrow: bytes, p: SecretParams) -> Iterator[tuple[int, int, int]]:
    """(start, end, place) by start: strings that mix letters with digits within reach of the end of a sensitive word, place.

    Sending True back says that the string is novel, and that one which follows at once is a candidate, too.
    """
    low = narrow.lower()
    if not any(w in low for w in _CONTEXT_BYTES):
        return
    seen = -1
    for word in _CONTEXT.finditer(text):
        at, stop = max(word.end(), seen), word.end() + p.reach
        while at < stop and (m := _CANDIDATE.search(text, at)) and m.start() < stop:
            at = seen = m.end()
            s = m.group()
            if len(s) < p.min_length or not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            if (yield m.start(), m.end(), word.end()):
                stop = max(stop, m.end() + p.next)


def novel_spans(text: str, narrow: bytes, base: list[tuple[int, int, int]], p: SecretParams, novelty: Novelty) -> tuple[list[tuple[int, int]], int]:
    """(spans of incompressible candidates that lie in no base span, number of candidates measured beside them).

    Base spans and candidates both come by start, so that one sweep tells the furthest end of the base spans opened so far.
    """
    out, measured, opened, furthest = [], 0, 0, -1
    found = candidates(text, narrow, p)
    reply = None
    while True:
        try:
            start, end, _ = found.send(reply)
        except StopIteration:
            return out, measured
        while opened < len(base) and base[opened][0] <= start:
            furthest = max(furthest, base[opened][2])
            opened += 1
        if end <= furthest:  # measured as that base span
            reply = False
            continue
        measured += 1
        reply = incompressible(text, start, end, p, novelty)
        if reply:
            out.append((start, end))


@dataclass(frozen=True)
class Scan:
    """Spans as (start, kind, end) by start, then kind as listed, novel ones last; measured: strings whose marginal bytes were taken,
    all base spans and all other candidates; incompressible: how many of them don't compress."""

    base: list[tuple[int, str, int]]
    spans: list[tuple[int, str, int]]
    measured: int
    incompressible: int


def scan_text(text: str | None, p: SecretParams, novelty: Novelty) -> Scan:
    text = text or ""
    narrow = text.encode("latin-1", "replace")
    base = sorted(_base_spans(text, narrow))
    hard = sum(incompressible(text, a, b, p, novelty) for a, _, b in base)
    novel, measured = novel_spans(text, narrow, base, p, novelty)
    names = [k for k, *_ in BASE_KINDS] + ["novel"]
    more = [(a, len(BASE_KINDS), b) for a, b in novel]
    return Scan([(a, names[n], b) for a, n, b in base], [(a, names[n], b) for a, n, b in sorted(base + more)], measured + len(base), hard + len(novel))


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, n_measured long, n_incompressible long"
_TYPES = {"long": pa.int64(), "string": pa.string()}


def scan_secrets(docs: DataFrame, params: SecretParams | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): counts, digest and spans of its secrets.

    Base kinds are found by pattern. The method measures every base span and every other string in a sensitive place by its marginal
    compressed bytes; of the latter, those that don't compress are added as `novel`, if they don't lie in a base span. n_measured counts
    the strings measured, n_incompressible those that don't compress.

    A null or empty text has none; null, repeated and equal rows are each returned as they are; other columns aren't read;
    an empty table gives no rows. Texts are scanned whole, one at a time, without a shuffle; the work of a text is linear in its
    length and its spans.
    """
    p = params or SecretParams()
    names, kinds = zip(*(f.split() for f in _SCHEMA.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                scan = scan_text(text.as_py(), p, novelty)
                said = [k for _, k, _ in scan.base]
                counts = [said.count(kind) for kind, *_ in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(_joined(scan.base).encode()).hexdigest(), _joined(scan.spans), len(scan.spans) - len(scan.base), scan.measured, scan.incompressible))
            arrays = [pa.array([r[i] for r in rows], _TYPES[k]) for i, k in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], list(names))

    return map_batches(docs.select("doc_id", "text"), run, _SCHEMA)
