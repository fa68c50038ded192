"""Secrets in texts: assignments, access keys and hexadecimal runs by pattern, other random strings by token efficiency.

Text that a tokenizer's vocabulary was made for takes few tokens; a random string takes many. What patterns have found
is cut out of each run of key characters, and every part left of at least LEAST characters is encoded with a tiktoken vocabulary, and a ratio of characters to
tokens of at most RATIO reports it, unless it is a known digest (hexadecimal of a usual digest length, with or without
a prefix such as sha256-), a UUID, a number, or an identifier: parts of letters with short numbers, whose words have themselves a greater ratio.

Spans count code points and exclude their end. Every step is linear in the text, whatever its runs and hits. Null text
counts as empty; a null doc_id stays null; rows repeat as they are in the input; an empty table gives an empty result.
scan() ignores further columns, also if they are named like its outputs; redact() keeps them all.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkernel, tokens

LEAST, RATIO = 20, 2.2
VOCABULARY = "byte_bpe_50k.tiktoken"
# The patterns of the contract.
KINDS = ("assign", "access", "hex", "token")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:(?:md5|sha\d+)[-_=]?)?([0-9a-f]+)", re.I)
PART = re.compile(r"[A-Za-z]*\d{0,4}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    at = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
    with open(at, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base(text: str) -> list[tuple[int, str, int, int]]:
    """Start, kind, end and start of the value, of what the patterns find."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def known(run: str, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> bool:
    """A digest, UUID, number or identifier."""
    if (m := DIGEST.fullmatch(run)) and (len(m[1]) in DIGESTS or m[1].isdigit()) or UUID.fullmatch(run):
        return True
    parts = re.split("[+/_=-]", run)
    if not all(PART.fullmatch(p) and (len(p) < 3 or sum(a.islower() and b.isupper() for a, b in zip(p, p[1:])) <= len(p) / 6) for p in parts):
        return False
    # Only words of few tokens make an identifier; marks and numbers between them do not count.
    words = [w.lower() for w in WORD.findall(run)]
    return not words or sum(map(len, words)) > ratio * sum(map(len, map(encoding(vocabulary).encode_ordinary, words)))


def _merged(spans: list[tuple[int, str, int, int]]) -> list[tuple[int, int]]:
    """Start and end of what spans (sorted) cover together."""
    out: list[tuple[int, int]] = []
    for a, _, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rests(runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What stays of runs when spans (both sorted, without overlaps) are cut out."""
    k = 0
    for a, b in runs:
        while k < len(spans) and spans[k][0] < b:
            if spans[k][1] > a:
                if spans[k][0] > a:
                    yield a, spans[k][0]
                a = spans[k][1]
                if a >= b:
                    break
            k += 1
        if a < b:
            yield a, b


def found(text: str, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> list[tuple[int, str, int, int]]:
    """base(text) and the random strings beside them, in order."""
    out = base(text)
    more = []
    spans = _merged(out)
    for a, b in _rests([m.span() for m in RUN.finditer(text)], spans):
        run = text[a:b].strip("=/-_+")
        if len(run) < LEAST or known(run, vocabulary, ratio):
            continue
        if len(run) <= ratio * len(encoding(vocabulary).encode_ordinary(run)):
            a = text.index(run, a)
            more.append((a, "token", a + len(run), a))
    return sorted(out + more, key=lambda x: (x[0], KINDS.index(x[1]))) if more else out


def _joined(spans: list[tuple[int, str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, _ in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans for each row of docs."""
    scratch.ship(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            rows = []
            for text in textkernel.strings(batch.column(1)):
                spans = found(text or "", vocabulary, ratio)
                kinds = [s[1] for s in spans]
                plain = _joined([s for s in spans if s[1] != "token"])
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), _joined(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    kind = "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def masked(text: str, mark: str = "[SECRET]", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> str:
    """text with each secret value replaced; overlapping spans are replaced once."""
    out, at = [], 0
    for _, _, b, value in found(text, vocabulary, ratio):
        if value >= at:
            out += [text[at:value], mark]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with secret values masked in text, and n_chars (if there) counted anew where text changed; other columns stay."""
    scratch.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            names, columns = batch.schema.names, list(batch.columns)
            before = textkernel.strings(columns[names.index("text")])
            after = [t and masked(t, mark) for t in before]
            columns[names.index("text")] = pa.array(after, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [len(y) if x != y else c for x, y, c in zip(before, after, columns[k].to_pylist())]
                columns[k] = pa.array(n, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
