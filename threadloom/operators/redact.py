"""Secret and PII detection and redaction.

Detection of spans runs as one Arrow UDF over the texts; values and counts that need no spans stay native.
Offsets are bytes of UTF-8. Overlapping findings merge; findings that only touch don't.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.shipping import ship

# What counts as a secret or as PII, and how sure each detector is. Group 1, where there is one, is the span.
SECRETS: dict[str, tuple[str, float]] = {
    "key_value_secret": (
        r"""(?im)["']?\b[A-Z0-9_.-]*(?:api[_-]?key|secret|token|password|passwd|pwd|private[_-]?key|access[_-]?key|credential)[A-Z0-9_.-]*\b["']?\s*(?:=|:)\s*["']?([^\s"',}#]+)["']?""",
        1.0,
    ),
    "openai_api_key": (r"\bsk-[A-Za-z0-9_-]{20,}\b", 0.98),
    "github_token": (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b", 0.98),
    "aws_access_key": (r"\bAKIA[0-9A-Z]{16}\b", 0.98),
    "slack_token": (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", 0.98),
    "google_api_key": (r"\bAIza[0-9A-Za-z_-]{30,}\b", 0.98),
    "private_key": (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", 0.98),
    "high_entropy_secret": (r"\b[A-Za-z0-9_+/=-]{32,}\b", 0.72),
}
PII: dict[str, tuple[str, float]] = {
    "private_email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.95),
    "private_phone": (r"\b(?:\+?1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}\b", 0.85),
    "private_address": (r"\b\d{1,6}\s+[A-Z][A-Za-z0-9.-]*(?:\s+[A-Z][A-Za-z0-9.-]*){0,4}\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?)\b", 0.75),
}
MIN_ENTROPY, MIN_DISTINCT = 3.5, 8
#: White space as Unicode has it: what \s stands for in the patterns, in Python and in Java alike.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that fold to k, s and i where case is ignored.
FOLDS = {"\u212a": "k", "\u017f": "s", "\u0131": "i", "\u0130": "i"}
#: What a finding of each kind always holds. Every gate lets through more than its detector finds, never less: it knows neither word
#: borders nor white space, and where the detector ignores case it is tried on the folded text.
GATES: dict[str, str] = {
    "key_value_secret": "key|secret|token|passw|pwd|credential",
    "openai_api_key": "sk-",
    "github_token": "gh[pousr]_|github_pat_",
    "aws_access_key": "AKIA",
    "slack_token": "xox[baprs]-",
    "google_api_key": "AIza",
    "private_key": "-----BEGIN ",
    "high_entropy_secret": "[A-Za-z0-9_+/=-]{32}",
    "private_email": "@",
    "private_phone": "[0-9]{3}[^0-9A-Za-z][0-9]{4}",
    "private_address": "[^0-9A-Za-z](?:St|Ave|Road|Rd|Lane|Ln|Dr)",
}
FINDINGS = "array<struct<kind string, start_byte long, end_byte long, replacement string, confidence double, blocks_sync boolean>>"

Detector = Callable[[str], list[tuple[str, int, int, float]]]


def looks_random(value: str) -> bool:
    raw = value.encode()
    counts = [raw.count(b) for b in set(raw)]
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts)
    return bool(re.search("[A-Za-z]", value)) and bool(re.search("[0-9]", value)) and len(counts) >= MIN_DISTINCT and entropy >= MIN_ENTROPY


def unicode_pattern(pattern: str) -> str:
    """``pattern`` with white space spelled out."""
    return pattern.replace(r"[^\s", "[^" + SPACE).replace(r"[-.\s]", f"[-.{SPACE}]").replace(r"\s", f"[{SPACE}]")


_COMPILED = {kind: (re.compile(unicode_pattern(p)), sure) for kind, (p, sure) in (SECRETS | PII).items()}
_GATES = {kind: re.compile(p) for kind, p in GATES.items()}
_FOLD = str.maketrans(FOLDS)


def folded(text: str) -> str:
    return (text if text.isascii() else text.translate(_FOLD)).lower()


def every_detector(text: str) -> list[tuple[str, int, int, float]]:
    """As ``pattern_detector``, without gates."""
    return _findings(text, _COMPILED)


def pattern_detector(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) in code points. Detectors whose gate is shut aren't run."""
    small = folded(text)
    return _findings(text, [k for k, gate in _GATES.items() if gate.search(small if k == "key_value_secret" else text)])


def _findings(text: str, kinds) -> list[tuple[str, int, int, float]]:
    found = []
    for kind in kinds:
        pattern, sure = _COMPILED[kind]
        hits = (m.span(pattern.groups and 1) for m in pattern.finditer(text))
        found += [(kind, a, b, sure) for a, b in hits if a < b and (kind != "high_entropy_secret" or looks_random(text[a:b]))]
    return found


def null_detector(text: str) -> list[tuple[str, int, int, float]]:
    return []


def merge(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Overlapping findings become one. Different kinds make it a ``secret`` if any is one, else ``pii``."""
    found = sorted(found, key=lambda f: f[1])
    reach = list(accumulate((end for _, _, end, _ in found), max))
    heads = [i for i in range(len(found)) if i == 0 or found[i][1] >= reach[i - 1]]
    out = []
    for a, b in zip(heads, [*heads[1:], len(found)]):
        kinds = {f[0] for f in found[a:b]}
        name = kinds.pop() if len(kinds) == 1 else "pii" if kinds <= PII.keys() else "secret"
        out.append((name, found[a][1], reach[b - 1], max(f[3] for f in found[a:b])))
    return out


def is_pii(kind: str) -> bool:
    return kind == "pii" or kind in PII


def replacement(kind: str) -> str:
    return f"[REDACTED:{kind}]" if is_pii(kind) else "[REDACTED:secret]"


def scan(detector: Detector = pattern_detector):
    """An Arrow UDF: text to its merged findings."""

    @F.pandas_udf(FINDINGS)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if not text:
                return []
            out, at, byte = [], 0, 0
            for k, s, e, c in merge(detector(text)):
                start = byte + len(text[at:s].encode())
                at, byte = e, start + len(text[s:e].encode())
                out.append({"kind": k, "start_byte": start, "end_byte": byte, "replacement": replacement(k), "confidence": c, "blocks_sync": not is_pii(k)})
            return out

        return texts.map(one)

    return run


def may_hold(text: Column) -> Column:
    """Whether any gate lets the text through; what is false here holds no finding."""
    plain = "|".join(p for k, p in GATES.items() if k != "key_value_secret")
    small = F.lower(F.translate(text, "".join(FOLDS), "".join(FOLDS.values())))
    return text.rlike(plain) | small.rlike(GATES["key_value_secret"])


def redact(rows: DataFrame, column: str, detector: Detector = pattern_detector) -> DataFrame:
    """``rows`` with ``findings``, ``redacted`` text, ``blocks_sync`` and ``coverage``; the text is rebuilt natively from byte spans."""
    ship(rows.sparkSession)
    # texts without anything that every finding of some kind holds don't go to Python
    worth = may_hold(F.col(column)) if detector is pattern_detector else F.lit(True)
    found = rows.withColumn("findings", scan(detector)(F.when(worth, F.col(column)).when(F.col(column).isNotNull(), F.lit(""))))
    raw = F.encode(F.col(column), "UTF-8")
    piece = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    state = F.aggregate(
        "findings",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, f: F.struct(F.concat(acc["text"], piece(acc["at"], f["start_byte"]), f["replacement"]).alias("text"), f["end_byte"].alias("at")),
    )
    whole = found.withColumn("_s", state)
    redacted = F.concat(F.col("_s.text"), piece(F.col("_s.at"), F.octet_length(column).cast("long")))
    blocks = F.exists("findings", lambda f: f["blocks_sync"])
    return whole.withColumns({"redacted": redacted, "blocks_sync": blocks, "coverage": F.lit("unavailable" if detector is null_detector else "deterministic")}).drop("_s")


def run_status(findings: Column, blocks: Column) -> Column:
    """Status of a redaction run, and the sync status it leads to."""
    return F.when(blocks, "blocked").otherwise(F.lit("passed"))


def sync_status(status: Column) -> Column:
    return F.when(status == "passed", "redacted").when(status.isin("blocked", "failed"), "blocked").otherwise("pending_redaction")


def values(text: Column, kind: str) -> Column:
    """All matches of a detector, natively, with the detector's white space, word borders, digits and folds of all of Unicode."""
    pattern = unicode_pattern((SECRETS | PII)[kind][0])
    if pattern.startswith("(?i"):  # Java folds into both ranges, not from one to the other
        pattern = pattern.replace("A-Z", "A-Za-z")
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(re.compile(pattern).groups and 1))
