"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions only at hits, then embedded checksums.

One pass of an automaton over the lower-cased text finds keywords. Each kind's
expression is tried only at its own hits. Kinds whose tokens carry a check value
(base62 CRC-32 of the two prefixed token families, JSON headers of signed
tokens) are kept only if it holds. Long hexadecimal runs have no keyword: bytes
sampled at half the least run length mark the texts that can hold one, and only
those are searched.

Defined results: a null text counts as empty; an empty text has no spans;
repeated rows each give their own row; no document needs a key, and extra
columns are ignored. A scan takes time in proportion to the text, whatever it is:
no expression visits a run of characters more than twice. Spans are code points, end exclusive, over whole texts.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .core import map_arrow, string_parts

# The kinds in their listed order, then the kinds this method adds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "stripe", "pem")
HEX_LEAST = 32

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
#: What a signed token starts with: where the rest fails, it fails at every later keyword in this run too.
JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*+")
SLACK = re.compile(r"xox[abprs]-[0-9]{8,}-[0-9A-Za-z-]{8,}")
STRIPE = re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----")

KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "stripe": ("sk_live_", "rk_live_"),
    "pem": ("-----begin",),
}
PATTERN = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "slack": SLACK, "stripe": STRIPE, "pem": PEM}

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def base62_crc(token: str) -> str:
    """Six base-62 digits of the token body's CRC-32, as the checksummed token formats append them."""
    n, out = zlib.crc32(token.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _checksummed(token: str) -> bool:
    body = token.split("_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_header(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no base64, no JSON, or JSON that is nested too deeply for a header
        return False
    return isinstance(header, dict) and "alg" in header


VALID = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": lambda m: _checksummed(m[0]),
    "npm": lambda m: _checksummed(m[0]),
    "jwt": lambda m: _jwt_header(m[0]),
    "slack": lambda m: True,
    "stripe": lambda m: True,
    "pem": lambda m: True,
}


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str, may_have_hex: bool = True) -> list[tuple[int, int, int]]:
    """Spans (start, kind's index, end) of one text, by start and then kind."""
    spans: list[tuple[int, int, int]] = []
    if may_have_hex:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # lower-casing only A-Z keeps every code point's place
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in automaton().iter(folded):
        hits.setdefault(kind, []).append(end - size + 1)
    for kind, starts in hits.items():
        free, rx, valid, at = 0, PATTERN[kind], VALID[kind], KINDS.index(kind)
        for s in sorted(starts):
            # a match may begin only behind the one before, failing ones included
            if s < free:
                continue
            if m := rx.match(text, s):
                free = m.end()
                if valid(m):
                    spans.append((s, at, free))
            elif kind == "jwt":
                free = JWT_RUN.match(text, s).end() if text.startswith("eyJ", s) else s
    return sorted(spans)


def _hex_possible(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each document may hold a run of HEX_LEAST hexadecimal bytes: two neighbouring samples are inside it."""
    step = HEX_LEAST // 2
    at = np.arange(step - 1, len(data), step)
    hit = _HEX[data[at]]
    pair = at[:-1][hit[:-1] & hit[1:]] if len(at) > 1 else at[:0]
    out = np.zeros(len(offs) - 1, bool)
    out[np.searchsorted(offs, pair, side="right") - 1] = True
    return out


def label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, `base_spans` and `spans` as kind:start:end lists."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = string_parts(b.column(1))
        maybe = _hex_possible(data, offs)
        rows = [scan(t or "", bool(m)) for t, m in zip(b.column(1).to_pylist(), maybe, strict=True)]
        base = [[x for x in r if x[1] < 3] for r in rows]
        counts = [pa.array([sum(x[1] == k for x in r) for r in base], pa.int64()) for k in range(3)]
        return pa.record_batch(
            [b.column(0), *counts, pa.array(map(label, base), pa.string()), pa.array(map(label, rows), pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
        )

    out = map_arrow(
        docs.select(id_col, text_col),
        run,
        f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string",
    )
    return out.withColumnRenamed("id", id_col)
