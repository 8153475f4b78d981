"""Secrets in text: fixed patterns, and strings that a battery of randomness tests can't tell from chance.

Long unbroken strings get the smallest encoding whose alphabet holds them. Three tests are run
over the alphabet's positions: chi-squared uniformity, runs above and below the middle, and
serial correlation; the largest deviation, in standard deviations, is the string's score. Short
strings pass such tests easily: what is not random deviates in proportion to the root of its length. A score is
therefore divided by that root and held against ordinary text in its encoding; the mean and spread of the
logarithms there are fixed values (``NULL``), the same for every table, and give a p-value under "no secret".
Text in base32 or base64 looks almost random itself, so such strings are also decoded, at every offset, and are no secret if
what comes out is text. Strings that hold several things (``NAME=value``, paths, joined words) are tested in parts.
Benjamini-Hochberg over the p-values of all candidates of the corpus bounds the share of false finds.
"""

from __future__ import annotations

import base64
import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowplace.llm.common import per_chunk, text_of
from flowplace.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The patterns of the base kinds, in the order in which kinds are listed.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

LONG = re.compile("[A-Za-z0-9+/_=-]{16,}")
WHOLE = re.compile("[A-Za-z0-9+/_-]+=*")  # up to padding: an inner '=' joins a name and a value
PART = re.compile("[A-Za-z0-9]+")
LEAST_RANDOM, LEAST_NAMED = 20, 16  # shortest string that is tested, and the same behind a quote, ':' or '='
SHORTEST = 16  # no pattern but assign matches inside shorter unbroken strings
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "digits": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "alnum": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}
SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
PIECE = 2_000  # characters of ordinary text that are put into an encoding at once
STEP = 0.02  # width of a bin of log(score / root of length)
LOWEST, BINS = -5.0, 500  # the bins reach from here; failed strings share the last one
LEAST_SCORE = 0.25  # smaller scores are all the same
# Mean and spread of the bins of ordinary text, as null_of gives them for all of the 1,000 documents of sf0.01.
NULL = {
    "digits": (303.8, 30.0),
    "hex": (278.5, 27.2),
    "HEX": (278.5, 27.2),
    "lower": (273.1, 29.5),
    "upper": (273.1, 29.5),
    "base32": (284.5, 28.0),
    "lower36": (290.3, 27.3),
    "upper36": (290.3, 27.3),
    "letters": (281.3, 29.5),
    "alnum": (289.0, 28.7),
    "base64": (290.3, 28.6),
    "base64url": (290.3, 28.6),
}
# What a string of an encoding may be decoded as: the alphabet's bits per character, and its order.
DECODED = {
    "upper": "base32",
    "base32": "base32",
    "letters": "base64",
    "alnum": "base64",
    "base64": "base64",
    "base64url": "base64url",
}
TEXT_SHARE, LEAST_STRANGE = 0.2, 3  # decoded bytes are text if fewer than these are no text
PASSED = 4.0  # a random string deviates more than this in one of 10,000 cases
FALSE_SHARE = 0.01


@dataclass(frozen=True)
class Battery:
    """Rate of false finds, and the deviation beyond which a string is not random at all."""

    false_share: float = FALSE_SHARE
    passed: float = PASSED


def infer(token: str) -> str | None:
    """The smallest encoding whose alphabet holds the string (padding aside); None if there is none."""
    used = set(token.rstrip("="))
    return next((name for name, chars in SETS.items() if used <= chars), None) if used else None


def score(token: str, encoding: str) -> float:
    """Largest deviation of the three tests from a uniform random string, in standard deviations."""
    x = [PLACES[encoding][c] for c in token.rstrip("=")]
    n, size = len(x), len(PLACES[encoding])
    if n < 2:
        return float(size)
    chi = size / n * sum(c * c for c in Counter(x).values()) - n
    worst = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = [v * 2 >= size for v in x]
    ones = sum(high)
    zeros = n - ones
    pairs = 2 * ones * zeros
    spread = pairs * (pairs - n) / (n * n * (n - 1))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    worst = max(worst, abs(runs - 1 - pairs / n) / math.sqrt(spread) if spread > 0 else math.sqrt(n))
    mean = sum(x) / n
    power = sum((v - mean) ** 2 for v in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))
    return max(worst, abs(serial / power + 1 / n) * math.sqrt(n) if power else math.sqrt(n))


def score_bin(token: str, encoding: str) -> int:
    """Bin of log(score / root of length)."""
    scaled = math.log(max(LEAST_SCORE, score(token, encoding)) / math.sqrt(max(1, len(token.rstrip("=")))))
    return min(BINS - 2, max(0, int((scaled - LOWEST) / STEP)))


def ordinary(text: str, encoding: str) -> str:
    """What the letters of ordinary text give in an encoding; words joined as they are for base32 and base64, whose text is decoded."""
    words = re.findall("[A-Za-z]+", text)
    raw = " ".join(words).encode()
    if encoding == "digits":
        out = "".join(map(str, raw))
    elif encoding in ("hex", "HEX"):
        out = raw.hex() if encoding == "hex" else raw.hex().upper()
    elif encoding.startswith("lower"):
        out = "".join(words).lower()
    elif encoding.startswith("upper") or encoding == "base32":
        out = "".join(words).upper()
    else:
        out = "".join(w.title() for w in words)
    return out.rstrip("=")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in that order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if any(len(w) >= SHORTEST for w in text.split()):
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_text(token: str, encoding: str) -> bool:
    """Whether the string is text in base32 or base64, from whichever offset."""
    code = DECODED.get(encoding)
    if code is None:
        return False
    body = token.rstrip("=")
    for skip in range(8 if code == "base32" else 4):
        part = body[skip:]
        if code == "base32":
            raw = base64.b32decode(part[: len(part) // 8 * 8])
        else:
            part = part[: len(part) // 4 * 4]
            raw = base64.urlsafe_b64decode(part) if code == "base64url" else base64.b64decode(part)
        told = raw.decode("utf-8", "replace")
        strange = sum(c == "\ufffd" or (c < " " and c not in "\t\n\r") or c == "\x7f" for c in told)
        if raw and strange < max(LEAST_STRANGE, TEXT_SHARE * len(told)):
            return True
    return False


def tested(token: str, passed: float) -> tuple[str, int] | None:
    """Encoding and bin of a string, the last bin if a test fails it or it is text; None without an encoding."""
    encoding = infer(token)
    if encoding is None:
        return None
    good = score(token, encoding) <= passed and not is_text(token, encoding)
    return encoding, score_bin(token, encoding) if good else BINS - 1


def candidates(text: str, base: list[tuple[int, int, int]], passed: float) -> list[tuple[int, int, str, int]]:
    """(start, end, encoding, bin) of long strings that share no character with a base span; the last bin if a test fails them.

    A string without an encoding, or that fails as a whole, is tested in its parts between ``+/-_`` instead.
    """
    out: list[tuple[int, int, str, int]] = []
    if not any(len(w) >= SHORTEST for w in text.split()):
        return out

    def open_to_test(start: int, end: int) -> bool:
        least = LEAST_NAMED if start and text[start - 1] in "\"':=" else LEAST_RANDOM
        return end - start >= least and not any(s < end and start < e for s, _, e in base)

    for m in LONG.finditer(text):
        for w in WHOLE.finditer(text, m.start(), m.end()):
            whole = tested(w[0], passed) if open_to_test(w.start(), w.end()) else None
            parts = []
            if whole is None or whole[1] == BINS - 1:
                spans = [p.span() for p in PART.finditer(text, w.start(), w.end())]
                parts = [(a, b, *tested(text[a:b], passed)) for a, b in spans if b - a < len(w[0].rstrip("=")) and open_to_test(a, b)]
            if whole is not None and not parts:
                out.append((w.start(), w.end(), *whole))
            out += parts
    return out


def null_of(texts: list[str], encoding: str) -> tuple[float, float]:
    """Mean and spread of the bins of all of the texts, cut into strings of eight lengths in turn."""
    lengths = [int(20 * 2 ** (k / 2)) for k in range(8)]
    bins = []
    for text in texts:
        for at in range(0, len(text), PIECE):
            token = ordinary(text[at : at + PIECE], encoding)
            start, turn = 0, at // PIECE + len(text)
            while start + (n := lengths[turn % 8]) <= len(token):
                bins.append(score_bin(token[start : start + n], encoding))
                start, turn = start + n, turn + 1
    mean = sum(bins) / len(bins)
    return mean, math.sqrt(sum((b - mean) ** 2 for b in bins) / len(bins))


def scan(docs: DataFrame, doc_id: str, text: str, passed: float = PASSED) -> DataFrame:
    """Per row of ``docs``: doc_id, base spans and candidates."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("bin", pa.int32())]))

    def dicts(found: list[tuple], names: list[str]) -> list[dict]:
        return [dict(zip(names, x, strict=True)) for x in found]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, cands = [], []
        for body in batch.column("text").to_pylist():
            own = base_spans(body)
            base.append(dicts(own, ["start", "kind", "end"]))
            cands.append(dicts(candidates(body, own, passed), ["start", "end", "encoding", "bin"]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(cands, cand)], ["doc_id", "base", "cands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {kind}, base array<struct<start int, kind int, end int>>, "
        "cands array<struct<start int, end int, encoding string, bin int>>"
    )
    return materialise(rows.mapInArrow(per_chunk(work, "text"), shape), "secrets")


def thresholds(scanned: DataFrame, false_share: float = FALSE_SHARE) -> dict[str, int]:
    """Per encoding the largest bin that counts as a find.

    Counts are over all documents; only the histogram, at most encodings x BINS rows, comes to the driver.
    """
    cands: dict[str, Counter] = {}
    for r in scanned.select(F.explode("cands").alias("x")).groupBy("x.encoding", "x.bin").count().collect():
        cands.setdefault(r["encoding"], Counter())[r["bin"]] = r["count"]
    found = []
    for encoding, counts in cands.items():
        mean, spread = NULL[encoding]
        p = lambda at, m=mean, s=spread: math.erfc((m - at) / s / math.sqrt(2)) / 2
        found += [(p(at), encoding, at, n) for at, n in counts.items() if at < BINS - 1]
    number = sum(sum(c.values()) for c in cands.values())
    limit, seen = 0.0, 0
    for p, _, _, n in sorted(found):
        seen += n
        if p * number <= false_share * seen:
            limit = p
    out: dict[str, int] = {}
    for p, encoding, at, _ in found:
        if p <= limit:
            out[encoding] = max(at, out.get(encoding, 0))
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", battery: Battery = Battery()) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, both arrays of (start, kind, end) by start and kind.

    ``kind`` is a place in ``KINDS``; ``spans`` holds the base spans and the random strings. Places are code
    points, the end is exclusive. Null and empty texts have no spans; repeated rows come back
    each; an empty table gives no rows; other columns are ignored.
    """
    scanned = scan(docs, doc_id, text, battery.passed)
    limits = thresholds(scanned, battery.false_share)
    # One entry per encoding with finds.
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    kind = len(KINDS) - 1
    if limit is None:
        random = F.array().cast("array<struct<start int, kind int, end int>>")
    else:
        passed = F.filter("cands", lambda c: F.coalesce(c["bin"] <= F.try_element_at(limit, c["encoding"]), F.lit(False)))
        random = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")
