"""Secret scans: known patterns, and windows of high Shannon entropy over candidate strings.

A span is (kind, start, end): code points of the text, end exclusive. Three kinds come from patterns: ``assign``
(a key word, a separator and a value of eight characters or more), ``access`` (AKIA keys of sixteen or more) and ``hex``
(runs of thirty-two or more). The fourth, ``entropy``, slides a window over every run of a character class. The
window's symbol counts change by one character in and one out, so its entropy follows in constant time per step.
Windows at or above the class's threshold are merged into one span, unless the run is on the allow list or the
span lies inside a pattern's span.

Null and empty texts have no spans. Repeated rows get equal spans. Texts of any length are read whole; memory is that
of one slice of an Arrow batch. A column that already has the output's name is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .registry import query, table

KINDS = ("assign", "access", "hex", "entropy")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

# fixed values: the contract's patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of at least 32 is the leftmost maximal run, so this equals [0-9a-f]+ kept from 32 on
_MIN_VALUE, _MIN_ACCESS = 8, 16


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern`` are candidates. A window of ``window`` characters is suspicious from ``bits`` of entropy on, if
    it mixes at least ``digits`` digits and ``letters`` letters."""

    name: str
    pattern: str
    window: int
    bits: float
    digits: int = 0
    letters: int = 0


CLASSES = (
    CharClass("hexadecimal", r"[0-9a-fA-F]{24,}", 24, 3.0, digits=3, letters=3),
    CharClass("alphanumeric", r"[A-Za-z0-9]{20,}", 20, 3.6, digits=2, letters=4),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.8, digits=2, letters=4),
)

#: A candidate that one of these matches whole is no secret: UUIDs, dates and numbers, and strings written as examples.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9TZ+:_-]+",
    r"(?i:.*(?:example|placeholder|changeme|0123456789|abcdefghij).*)",
)


def windows(text: str, classes, allow: re.Pattern, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged spans of the suspicious windows of one text, outside ``covered``."""
    found: list[tuple[int, int]] = []
    for cls, runs, weight in classes:
        for run in runs.finditer(text):
            s, at, w = run.group(), run.start(), cls.window
            if allow.fullmatch(s):
                continue
            counts: dict[str, int] = {}
            total, digits, letters = 0.0, 0, 0  # total: sum of c log2 c over the window's counts
            need = w * (math.log2(w) - cls.bits) + 1e-9
            begin = end = -1
            for i, c in enumerate(s):
                n = counts.get(c, 0)
                counts[c] = n + 1
                total += weight[n + 1] - weight[n]
                digits += c.isdigit()
                letters += c.isalpha()
                if i >= w:
                    old = s[i - w]
                    n = counts[old]
                    counts[old] = n - 1
                    total += weight[n - 1] - weight[n]
                    digits -= old.isdigit()
                    letters -= old.isalpha()
                if i >= w - 1 and total <= need and digits >= cls.digits and letters >= cls.letters:
                    if begin >= 0 and at + i - w + 1 > end:
                        found.append((begin, end))
                        begin = -1
                    if begin < 0:
                        begin = at + i - w + 1
                    end = at + i + 1
            if begin >= 0:
                found.append((begin, end))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [(a, b) for a, b in merged if not any(x <= a and b <= y for x, y in covered)]


def spans_of(text: str, classes, allow: re.Pattern) -> list[dict]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _MIN_VALUE]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("entropy", a, b) for a, b in windows(text, classes, allow, [(a, b) for _, a, b in found])]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": a, "end": b} for k, a, b in found]


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """``docs`` with ``out``: the spans of every text, by start, then kind in the order of KINDS."""
    ready = [(c, re.compile(c.pattern), [0.0] + [n * math.log2(n) for n in range(1, c.window + 2)]) for c in classes]
    allowed = re.compile("|".join(f"(?:{a})" for a in allow) if allow else r"(?!)")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPAN_TYPE)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches):
            yield pa.array([spans_of(t.as_py() or "", ready, allowed) for t in texts], type=kind)

    return docs.withColumn(out, scan(F.col(text)))


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """``text`` with every span replaced by ``[kind]``. Overlapping spans become one, named after the first. Texts without
    spans stay as they are."""
    step = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")),
            )
            .otherwise(acc["done"])
            .alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))),
    )
    return docs.withColumn(text, F.when(F.size(secrets) > 0, step).otherwise(F.col(text)))


def span_list(secrets, kinds=KINDS):
    """kind:start:end, comma-joined, of the spans of ``kinds``."""
    wanted = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_secret_scans")
def op1_secret_scans(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    secrets = F.col("secrets")
    count = lambda kind: F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_list(secrets, KINDS[:3]), 256).alias("base_sha256"),
        span_list(secrets).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
