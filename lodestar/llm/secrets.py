"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; ``random`` is the method's.
KINDS = ("assign", "access", "hex", "random")
#: (pattern, least length, group measured) of the fixed kinds. Letters of the names in either case, ASCII only.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
PATTERNS = {
    "assign": (re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 24, 0),
}
#: What the fixed kinds need at the least: a quick test before the exact pattern.
_HEX_RUN = re.compile(r"[0-9a-f]{24}")
#: Strings that could be random: long runs of the base64 and base64url letters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex) and identifiers are no secrets.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SEPARATORS = re.compile(r"[_/+=-]+")
#: A part between separators that may be a word: letters with at most a short number after them.
WORDLIKE = re.compile(r"([A-Za-z]+)[0-9]{0,3}")
#: Characters per token from which letters are a word: rare and foreign words reach 1.9-2.4, random letters 1.4-1.7.
LETTERS_RATIO = 1.9
#: Letters that are too few to judge: of one case (first letter aside), and of mixed case. Characters that must be left over, or three fifths of a shorter string.
SHORT_WORD, SHORT_MIXED, LEAST_RANDOM = 7, 3, 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed kinds: per kind leftmost, non-overlapping, too short ones dropped."""
    out = []
    for kind, (pattern, least, group) in PATTERNS.items():
        if kind == "access" and "AKIA" not in text or kind == "hex" and not _HEX_RUN.search(text):
            continue
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _is_word(part: str, encode) -> bool:
    """A number, a digest, or letters the vocabulary knows (or too few to judge) with a short number after them."""
    if part.isdigit() or len(part) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-fA-F]+", part):
        return True
    m = WORDLIKE.fullmatch(part)
    if not m:
        return False
    word = m.group(1)
    few = SHORT_WORD if word[1:].islower() or word.isupper() else SHORT_MIXED
    return len(word) <= few or len(word) >= LETTERS_RATIO * len(encode(word))


def looks_random(s: str, encode, ratio: float) -> bool:
    """Fewer than ``ratio`` characters per token in what is left without words, numbers, digests and UUIDs; ``LETTERS_RATIO`` where letters alone are left."""
    left = [p for p in SEPARATORS.split(UUID.sub("-", s)) if p and not _is_word(p, encode)]
    n = sum(map(len, left))
    if n < min(LEAST_RANDOM, 0.6 * len(s)):
        return False
    return n < (LETTERS_RATIO if all(p.isalpha() for p in left) else ratio) * sum(len(encode(p)) for p in left)


def random_spans(text: str, encode, ratio: float, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The method's spans, outside of what the fixed kinds already cover."""
    starts, ends = [], []  # what is taken, as intervals apart from each other
    for a, b, _ in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect.bisect_left(starts, b)  # the last interval that starts before the candidate ends
        if not (k and ends[k - 1] > a) and looks_random(m.group(), encode, ratio):
            out.append((a, b, "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def encoder(vocabulary: str, pattern: str):
    """Text to token ids under a rank file."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = 2.4) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)``.

    ``vocabulary`` is a tiktoken rank file that every executor can read and ``pattern`` the regex that
    splits text before its merges. Strings of 20 or more characters are cut at separators, words and
    numbers are set aside, and what the vocabulary cannot shorten to ``ratio`` characters a token is
    reported as ``random`` (the whole string). Spans are in code points,
    end exclusive. A scan without shuffle; whole texts of any length; null is empty text, which has
    no spans; repeated rows are scanned alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", encode, ratio, base)
                counts = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
                rows.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    found = docs.select(F.col("doc_id").cast("long"), "text")
    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(text: str, spans: str, mark: str = "[{}]") -> str:
    """``text`` with each span of a ``spans`` string replaced; overlapping spans become one, named by the first."""
    out, at = [], 0
    cuts = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    for a, b, k in cuts:
        if a >= at:
            out += [text[at:a], mark.format(k)]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = 2.4) -> DataFrame:
    """Rows with every span in ``text`` replaced by its kind in brackets; other columns, and null texts, stay as they are."""

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary, pattern)
        for part in parts:
            yield part.map(lambda t: redact(t, joined(base + random_spans(t, encode, ratio, base))) if t and (base := base_spans(t)) is not None else t)

    return docs.select(*[F.pandas_udf(clean, "string")("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
