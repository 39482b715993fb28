"""Secret scan: three kinds of patterns, and strings that a public vocabulary takes many tokens for.

A tokenizer's vocabulary holds what people write often. A run of characters that needs a token for every one or two of them
is like nothing in it: most likely a random key. Digests of common lengths, UUIDs and identifiers made of words are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Characters per token below which a string counts as random.
CHARS_PER_TOKEN = 2.0
#: Shortest string that the token test looks at.
LEAST = 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: These two take only runs that are long enough: as a run's match always reaches its end, what is left out are the failing matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PIECE = re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
KINDS = ("assign", "access", "hex", "token")

_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words joined by - _ / + or capitals, each of letters only or digits only: names, paths, constants.
_NAME = re.compile(r"[-_/+=]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)|(?<=[a-z])[A-Z][a-z]+)*[0-9]{0,4}[-_/+=]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns' matches that are long enough."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _ordinary(s: str, known: frozenset[str]) -> bool:
    """No letters, or a digest, UUID, identifier or known string."""
    return not re.search("[A-Za-z]", s) or bool(_DIGEST.fullmatch(s) or _UUID.fullmatch(s) or _NAME.fullmatch(s)) or s in known


def _windows(s: str, lengths: list[int], known: frozenset[str], ratio: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the joined windows of tokens, each just LEAST characters or more, that are below the ratio and not ordinary.

    Tokens of three characters and more and separators at both ends are left off.
    """
    ends, joined, last = [0], [], 0
    for n in lengths:
        ends.append(ends[-1] + n)
    for first in range(len(lengths)):
        while last < len(lengths) and ends[last] - ends[first] < LEAST:
            last += 1
        i, j = ends[first], ends[last]
        if j - i < LEAST:
            break
        if j - i < ratio * (last - first) and not _ordinary(s[i:j], known):
            if joined and first <= joined[-1][1]:
                joined[-1][1] = last
            else:
                joined.append([first, last])
    for first, last in joined:
        part = [k for k in range(first, last) if lengths[k] < 3 and s[ends[k] : ends[k + 1]].strip("/=_-+")]
        if part:
            yield ends[part[0]], ends[part[-1] + 1]


def random_spans(text: str, count_tokens, known: frozenset[str] = frozenset(), ratio: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Runs below the ratio; of other runs the pieces between / = _ - + and the windows of tokens below it, joined where they overlap.

    count_tokens: string to number of tokens; windows are looked at if it has `lengths`, string to characters of each token.
    """
    found, lengths = [], getattr(count_tokens, "lengths", None)
    for m in RUN.finditer(text):
        s, at = m[0], m.start()
        if _ordinary(s, known):
            continue
        if len(s) < ratio * count_tokens(s):
            found.append((at, 3, m.end()))
            continue
        taken, own = [u.span() for u in _UUID.finditer(s)], []  # no windows across what is taken
        for p in PIECE.finditer(s):
            if _DIGEST.fullmatch(p[0]) or p[0] in known:
                taken.append(p.span())
            elif not _ordinary(p[0], known) and len(p[0]) < ratio * count_tokens(p[0]):
                own.append(p.span())
        if lengths:
            start = 0
            for a, b in sorted([*taken, (len(s), len(s))]):
                if a - start >= LEAST:
                    own += [(start + i, start + j) for i, j in _windows(s[start:a], lengths(s[start:a]), known, ratio)]
                start = max(start, b)
        end = -1
        for a, b in sorted(own):
            if a < end:
                found[-1] = (found[-1][0], 3, at + max(end, b))
            else:
                found.append((at + a, 3, at + b))
            end = max(end, b)
    return found


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class _Counter:
    """Counts the tokens of a string."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> int:
        return len(self.enc.encode_ordinary(s))

    def lengths(self, s: str) -> list[int]:
        """Bytes of each token: characters where s is ASCII."""
        return [len(self.enc.decode_single_token_bytes(t)) for t in self.enc.encode_ordinary(s)]


_counter = _Counter


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", known: frozenset[str] = frozenset(), ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row per row of docs: id, counts by pattern, SHA-256 of the base spans as text, all spans as text.

    Null and empty texts have no spans and the SHA-256 of nothing. Spans of different kinds may overlap; repeated rows give
    repeated results; ties in start go by kind. ranks_path: a tiktoken vocabulary; known: strings that are no secrets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(ranks_path, pattern)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                n = np.bincount([k for _, k, _ in base], minlength=3).tolist() if base else [0, 0, 0]
                out.append((doc_id, *n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(sorted(base + random_spans(text, count, known, ratio)))))
            if out:
                yield batch(out, _OUT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT).withColumnRenamed("doc_id", id_col)
