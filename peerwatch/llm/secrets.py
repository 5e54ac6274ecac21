"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

The patterns give the base spans. The battery looks at every other run of
encoding characters, or, where a run mixes separators and no alphabet holds it, at
its parts between them: it infers the smallest alphabet that holds the run and asks
three questions, each a test whose null hypothesis is that the run is text or a
sequence, not random:

- uniformity: Pearson's chi-squared against equal symbol counts; a small p-value
  says it is lower than a run with the divergence of text would give;
- runs: changes between letter cases and digits; a small p-value says that there
  are more than text has, a fixed part of those that random symbols of the
  alphabet have. Digits: changes between the lower and the upper five. Letters of
  one case: changes between vowels and consonants, of which text has more than
  random letters;
- serial correlation at lag one; a small p-value says it is nearer to zero than
  in a run whose neighbours resemble each other.

All three must speak for randomness, so a run's p-value is the largest of them.
Short runs cannot reach a small one: every null widens with length. The
Benjamini-Hochberg procedure is applied over the whole corpus to each class of
lengths by itself, on p-values rounded up to a fixed grid, so only counts per
class and grid step leave the executors.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table
from peerwatch.sources.staging import stage

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Shortest run that is tested, and the lengths from which a new class begins.
SHORTEST = 20
CLASSES = (20, 24, 32, 48, 96)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
#: Alphabets by size: symbols in order of value, divergence of text per symbol.
ALPHABETS = (
    ("0123456789", 1.0),
    ("0123456789abcdef", 1.5),
    ("0123456789ABCDEF", 1.5),
    ("abcdefghijklmnopqrstuvwxyz", 1.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.0),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.4),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.5),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.5),
)
_SYMBOLS = [frozenset(symbols) for symbols, _ in ALPHABETS]
#: Under the null, changes of class as a part of those among random symbols of the alphabet, and the correlation of neighbours.
TEXT_CHANGES = 0.3
#: Share of neighbours of which one is a vowel, in text; letters of one case are tested by these.
TEXT_VOWEL_CHANGES = 0.6
VOWELS = frozenset("aeiouAEIOU")
SEPARATOR = re.compile(r"[+/_-]")
TEXT_CORRELATION = 0.75
FALSE_SHARE = 0.01
#: Grid of p-values: step b stands for 10 ** (-b / STEPS).
STEPS, LAST_STEP = 20, 400


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _at_least(k: int, n: int, p: float) -> float:
    """Chance of k or more successes in n."""
    if n > 400:
        return _below(-(k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def _kind(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def _class_of(symbols: str) -> dict[str, int]:
    """What the runs test tells apart in an alphabet."""
    if symbols.isdigit():
        return {c: c >= "5" for c in symbols}
    if symbols.isalpha() and (symbols.islower() or symbols.isupper()):
        return {c: c in VOWELS for c in symbols}
    return {c: _kind(c) for c in symbols}


_CLASS_OF = [_class_of(symbols) for symbols, _ in ALPHABETS]
#: Share of neighbours of different class among random symbols.
_CHANGES = [1 - sum(k * k for k in Counter(kinds.values()).values()) / len(kinds) ** 2 for kinds in _CLASS_OF]


def randomness(run: str) -> float:
    """p-value of the battery for one run; 1 where no alphabet holds it."""
    held = set(run)
    number = next((i for i, symbols in enumerate(_SYMBOLS) if held <= symbols), None)
    if number is None:
        return 1.0
    symbols, text = ALPHABETS[number]
    n, size = len(run), len(symbols)
    kinds = [_CLASS_OF[number][c] for c in run]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if size == 26:
        p_runs = _at_least(n - 1 - changes, n - 1, 1 - TEXT_VOWEL_CHANGES)
    else:
        p_runs = _at_least(changes, n - 1, TEXT_CHANGES * _CHANGES[number])
    if p_runs > 0.5:
        return 1.0
    expected = n / size
    counts = Counter(run)
    chi2 = sum((c - expected) ** 2 for c in counts.values()) / expected + (size - len(counts)) * expected
    mean, spread = size - 1 + n * text, math.sqrt(2 * (size - 1) + 4 * n * text)
    p_uniform = _below((chi2 - mean) / spread)
    value = {c: i for i, c in enumerate(symbols)}
    v = np.array([value[c] for c in run], float)
    v -= v.mean()
    r = min(0.999999, abs(float(v[:-1] @ v[1:] / (v @ v))) if v.any() else 1.0)
    p_serial = _below((math.atanh(r) - math.atanh(TEXT_CORRELATION)) * math.sqrt(n - 3))
    return max(p_uniform, p_runs, p_serial)


def _parts(run: str) -> Iterator[tuple[int, int]]:
    """What is tested of a run: the whole if an alphabet holds it, else its long parts between separators."""
    held = set(run)
    if any(held <= symbols for symbols in _SYMBOLS):
        yield 0, len(run)
        return
    at = 0
    for stop in [*(m.start() for m in SEPARATOR.finditer(run)), len(run)]:
        if stop - at >= SHORTEST:
            yield at, stop
        at = stop + 1


def _class(length: int) -> int:
    return sum(length >= least for least in CLASSES) - 1


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (kind, start, end) and candidates (start, end, class, step) of a whole text."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text)]
    tested = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        run = m[0]
        spans += [(2, a + h.start(), a + h.end()) for h in HEX.finditer(run)]
        for start, stop in _parts(run):
            p = randomness(run[start:stop])
            step = min(LAST_STEP, int(math.floor(-math.log10(max(p, 1e-300)) * STEPS)))
            tested.append((a + start, a + stop, _class(stop - start), step))
    spans.sort(key=lambda s: (s[1], s[0]))
    starts, farthest = [a for _, a, _ in spans], list(accumulate((b for _, _, b in spans), max))
    # The farthest end of the spans that begin before a run ends decides whether one touches it.
    before = [bisect_left(starts, c[1]) for c in tested]
    return spans, [c for c, k in zip(tested, before) if not k or farthest[k - 1] <= c[0]]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, tested): base spans and tested runs of whole texts, as arrays."""
    span = "array<struct<kind:int,start:bigint,stop:bigint>>"
    run_type = "array<struct<start:bigint,stop:bigint,length_class:int,step:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        tested_type = pa.list_(
            pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("length_class", pa.int32()), ("step", pa.int32())])
        )
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column(1)]
            base = [[dict(zip(("kind", "start", "stop"), s)) for s in spans] for spans, _ in found]
            tested = [[dict(zip(("start", "stop", "length_class", "step"), c)) for c in runs] for _, runs in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span_type), pa.array(tested, tested_type)], ["doc_id", "base", "tested"]
            )

    ship()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {span}, tested {run_type}")


def discovery_steps(scanned: DataFrame, share: float = FALSE_SHARE) -> list[int]:
    """Per class of lengths, the least grid step that Benjamini-Hochberg accepts (beyond the grid: none)."""
    counts = (
        scanned.select(F.explode("tested").alias("t")).groupBy("t.length_class", "t.step").count().collect()
    )  # at most classes x steps rows
    least = []
    for number in range(len(CLASSES)):
        steps = {r["step"]: r["count"] for r in counts if r["length_class"] == number}
        total, upto, chosen = sum(steps.values()), 0, LAST_STEP + 1
        for step in sorted(steps, reverse=True):
            upto += steps[step]
            if 10 ** (-step / STEPS) <= share * upto / total:
                chosen = step
        least.append(chosen)
    return least


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, stop) in code points, end exclusive, by start, then kind.

    `base` holds the pattern spans, `spans` these and the runs found random. One
    row per row; a NULL or empty text has none. Pattern kinds may overlap each
    other; a run that touches a pattern span is not tested. Rows repeated under
    one id each get a row and each count in the discovery control. Texts of any
    length are scanned whole, in time that grows with their length; an empty
    table gives no rows and other columns are ignored.
    """
    scanned = stage(scan(docs, id_col, text_col), "scanned")
    least = F.array(*[F.lit(step) for step in discovery_steps(scanned, share)])
    accepted = F.transform(
        F.filter("tested", lambda t: t["step"] >= F.element_at(least, t["length_class"] + 1)),
        lambda t: F.struct(F.lit(KINDS.index("random")).alias("kind"), t["start"].alias("start"), t["stop"].alias("stop")),
    )
    by_start = F.array_sort(
        F.transform(F.concat("base", accepted), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    )
    spans = F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return scanned.select("doc_id", "base", spans.alias("spans"))


def span_text(spans: str):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def _count(kind: str):
    number = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in all `documents`."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count(kind) for kind in KINDS[:3]], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans")
    )
