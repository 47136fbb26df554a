"""Secret scans: Aho-Corasick keywords first, anchored patterns only at their hits, then checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns

#: Kinds in the order that breaks ties of spans with one start. The first three are the base patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "google", "stripe", "pem", "card")
BASE = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, tail = m.group(1), m.group(2)
    value = 0
    for c in tail:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _jwt(m: re.Match) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    head = m.group(1)
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _luhn(m: re.Match) -> bool:
    digits = [int(c) for c in m.group(1) if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


#: kind: (keywords, pattern anchored at a keyword's start, check of a match). Keywords are lower case.
PATTERNS = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(1)) >= 6,
    ),
    "access": (("akia",), r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", _crc62),
    "npm": (("npm_",), r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", _crc62),
    "jwt": (("eyj",), r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", _jwt),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-"), r"xox[bpar]-[0-9]{10,13}-[0-9A-Za-z-]{20,}", None),
    "google": (("aiza",), r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", None),
    "stripe": (("sk_live_", "rk_live_"), r"[sr]k_live_[0-9A-Za-z]{24,}", None),
    "pem": (("-----begin ",), r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?!-----)[\s\S])+-----END (?:[A-Z]+ )?PRIVATE KEY-----", None),
    "card": (("card", "visa", "mastercard"), r"(?ai:card|visa|mastercard)[a-z]*+[\x20:=#]{1,3}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])", _luhn),
}
#: What a pattern begins with, up to the end of a run. If a match fails after such a beginning, it fails from every
#: later keyword inside the same run as well, so that a run is looked at once, however many keywords it holds.
RUNS = {"jwt": r"eyJ[A-Za-z0-9_-]+", "card": r"(?ai:card|visa|mastercard)[a-z]*"}
#: Runs of hex digits have no keyword; every 24th character is a probe that a long enough run can't miss.
HEX, HEX_LEN = re.compile(r"[0-9a-f]+"), 24
_HEX_CHARS = frozenset("0123456789abcdef")


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        words: dict[str, list[str]] = {}
        for kind, (keys, _, _) in PATTERNS.items():
            for k in keys:
                words.setdefault(k, []).append(kind)
        for k, kinds in words.items():
            self.automaton.add_word(k, (len(k), tuple(kinds)))
        self.automaton.make_automaton()
        self.patterns = {k: (re.compile(p).match, check) for k, (_, p, check) in PATTERNS.items()}
        self.runs = {k: re.compile(p).match for k, p in RUNS.items()}

    def __call__(self, text: str) -> list[tuple[int, str, int]]:
        """Spans (start, kind, end) by start and then kind, in code points.

        Within a kind, matches are taken from left to right and don't overlap; a match that fails its
        check still uses up its characters.
        """
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        starts: dict[str, dict[int, int]] = {}  # place -> length of the longest keyword there
        for end, (n, kinds) in self.automaton.iter(lowered):
            for kind in kinds:
                places = starts.setdefault(kind, {})
                places[end - n + 1] = max(n, places.get(end - n + 1, 0))
        found = []
        for kind, places in starts.items():
            match, check = self.patterns[kind]
            run, over, failed = self.runs.get(kind), 0, 0
            for at in sorted(places):
                if at < over or at + places[at] <= failed:
                    continue
                if m := match(text, at):
                    over = m.end()
                    if check is None or check(m):
                        found.append((at, KINDS.index(kind), over))
                elif run and (m := run(text, at)):
                    failed = m.end()
        found += self.hex_runs(text)
        return [(a, KINDS[k], e) for a, k, e in sorted(found)]

    @staticmethod
    def hex_runs(text: str) -> list[tuple[int, int, int]]:
        found, over, kind = [], 0, KINDS.index("hex")
        for at in range(HEX_LEN - 1, len(text), HEX_LEN):
            if at < over or text[at] not in _HEX_CHARS:
                continue
            start = at
            while start > over and text[start - 1] in _HEX_CHARS:
                start -= 1
            over = HEX.match(text, at).end()
            if over - start >= HEX_LEN:
                found.append((start, kind, over))
        return found


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans (array of start, kind, end; code points, end exclusive).

    A null or empty text has no spans. Ids may be null or repeated, and repeated rows have the same spans; an empty
    table gives an empty result; other columns are not looked at. Whole texts are scanned, in time that grows in
    proportion to their length.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for b in batches:
            spans = [[{"start": a, "kind": k, "end": e} for a, k, e in find(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, span)], ["doc_id", "spans"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<start: long, kind: string, end: long>>")


def secret_digest(docs: DataFrame, **names) -> DataFrame:
    """find_secrets as counts per base kind, a digest of the base spans, and all spans as text."""
    joined = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(spans, x -> x.kind in ('assign', 'access', 'hex'))"
    return find_secrets(docs, **names).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first span."""
    out, over = [], 0
    for start, kind, end in spans:
        if start >= over:
            out += [text[over:start], f"[{kind}]"]
        over = max(over, end)
    return "".join(out) + text[over:]


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs, with secrets in the text replaced by their kind in brackets.

    Null and empty texts stay as they are, and so do ids, nulls and repeated rows; an empty table gives an empty
    result. ``length_col``, if there is one, is set anew for changed texts only. Whole texts are scanned.
    """
    require_columns(docs, text_col)

    @F.pandas_udf("string")
    def clean(texts):
        find = scanner()
        return texts.map(lambda t: redact(t, find(t)) if t else t)

    cleaned = docs.withColumn("__clean", clean(F.col(text_col)))
    changed = ~F.col("__clean").eqNullSafe(F.col(text_col))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        cleaned = cleaned.withColumn(length_col, F.when(changed, F.length("__clean").cast(kind)).otherwise(F.col(length_col)))
    return cleaned.withColumn(text_col, F.col("__clean")).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, k, e in spans if k in BASE).encode()).hexdigest()
