"""Secret scans: fixed patterns, and a sliding window of Shannon entropy over candidate strings.

A candidate is a run of characters that keys and tokens are made of. Its character class (digits, hex, letters,
letters with digits, base64) sets the entropy that counts as random. A window slides over it; the counts of its
characters, and with them the entropy, change by one character in and one out. Windows above the threshold are
joined to a span. Allow-listed candidates (identifiers, addresses before their query, paths, dates) are left alone. What
a fixed pattern has found already, and fillers (placeholder words, characters in order), are cut out of the spans; every
remainder that holds a full window stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import documents, table

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: bits a character that a window of each class must exceed; a window of 20 holds log2(20) = 4.32 at most, of
#: decimal digits 3.32, of hex digits 4.0. Words in one case stay below 3.9.
THRESHOLD = {"digits": math.inf, "hex": 3.0, "letters": 4.1, "alnum": 3.6, "base64": 3.8}


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: fixed values: forms that look random but are none
ALLOWED = re.compile(
    r"""(?ix)
      [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}  # universally unique identifiers
    | [0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9-]+Z?)?                   # dates
    | (?:[a-z]{2,}[0-9]{0,4}[/_=-]+)+[a-z]*[0-9]{0,4}                 # paths and names of several words
    | [-=_+/]+
    """
)
#: fixed values: words that stand in for a secret, looked for in lower case
FILLER = re.compile(r"example|placeholder|changeme|your[_-]|x{4,}")
ORDERED = 6  # characters, each the next after the one before, that are no secret: abcdef, 012345
MARKS = re.compile(r"://|www\.|@|#|\?")


class Addresses:
    """Whether a place of a text lies in an address, before its query. Places are asked in order, each the start of a
    candidate, so a text of any length is read once."""

    def __init__(self, text: str):
        self.text, self.at, self.inside = text, 0, False

    def hold(self, place: int) -> bool:
        read = self.text[self.at : place + 2]  # a candidate may begin with the slashes of ://
        run = read.rsplit(None, 1)[-1]
        self.inside &= len(run) == len(read)
        for mark in MARKS.finditer(run):
            self.inside = mark[0] != "?"  # values of a query are where tokens leak
        self.at = place + 2
        return self.inside


def fillers(run: str) -> list[tuple[int, int]]:
    """Ranges of placeholder words and of characters in order."""
    low = run.lower()
    out, start = [m.span() for m in FILLER.finditer(low)], 0
    for i in range(1, len(low) + 1):
        if i == len(low) or ord(low[i]) != ord(low[i - 1]) + 1:
            if i - start >= ORDERED:
                out.append((start, i))
            start = i
    return out


def character_class(s: str) -> str:
    if s.isdigit():
        return "digits"
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    if s.isalpha():
        return "letters"
    return "alnum" if s.isalnum() else "base64"


def random_parts(s: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Joined ranges of the windows whose entropy is above ``threshold``.

    With counts c of a window of n characters the entropy is log2(n) - sum(c log2 c) / n; one step changes two counts.
    """
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += clog[n + 1] - clog[n]
        counts[c] = n + 1
        if i >= window - 1:
            start = i - window + 1
            if math.log2(window) - total / window > threshold:
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
            gone = s[start]
            n = counts[gone]
            total += clog[n - 1] - clog[n]
            counts[gone] = n - 1
    return out


def remainders(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the ranges ``taken``, in order, leave of a range."""
    out = []
    for x, y in taken:
        if x < b and y > a:
            if x > a:
                out.append((a, x))
            a = max(a, y)
    return [*out, (a, b)] if a < b else out


def find(text: str, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start and then kind."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    added, addresses = [], Addresses(text)
    for m in CANDIDATE.finditer(text):
        run = m[0]
        # every hex match of 32 or more lies inside a candidate
        base += [("hex", m.start() + h.start(), m.start() + h.end()) for h in HEX.finditer(run) if h.end() - h.start() >= 32]
        threshold = THRESHOLD[character_class(run)]
        if threshold < math.inf:
            parts = random_parts(run, window, threshold)
            if parts and not addresses.hold(m.start()):
                at = m.start()
                taken = [(a - at, b - at) for _, a, b in base if a < m.end() and at < b]
                if not taken and ALLOWED.fullmatch(run):
                    continue
                taken = sorted(taken + fillers(run))
                if not taken:
                    left = parts
                else:  # the rest of the run is judged without what is taken
                    left = [x for part in parts for x in remainders(*part, taken) if x[1] - x[0] >= window]
                    left = [(a, b) for a, b in left if random_parts(run[a:b], window, threshold) and not ALLOWED.fullmatch(run[a:b].strip("-=_+/"))]
                added += [("entropy", at + a, at + b) for a, b in left]
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a] if end < 0 else text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[max(end, 0) :]])


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(window: int, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for t in batch.column("text"):
                text = t.as_py()
                own = find(text, window)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                texts.append(redact(text, own) if own else text)
            columns = [batch.column("doc_id"), pa.array(spans, _ROW)]
            names = ["doc_id", "spans"]
            if clean:
                columns.append(pa.array(texts, pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def scan(docs: DataFrame, window: int = WINDOW, clean: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row, with ``clean`` also ``clean_text``, where spans are replaced.

    Null and empty texts have no spans. Whole texts are read, repeated rows each on their own; an empty table gives
    no rows. Nothing is shuffled.
    """
    schema = f"doc_id long, spans {SPANS}" + (", clean_text string" if clean else "")
    return documents(docs).mapInArrow(_found(window, clean), schema)


def cleaning(window: int = WINDOW):
    """For ``mapInArrow`` on rows with ``text`` and ``n_chars``: all rows and columns, spans replaced in the texts.
    ``n_chars`` changes with the text; rows without a span stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for i, text in enumerate(texts):
                own = find(text, window) if text else []
                if own:
                    texts[i] = redact(text, own)
                    sizes[i] = len(texts[i])
            at = batch.schema.get_field_index
            batch = batch.set_column(at("text"), "text", pa.array(texts, pa.string()))
            yield batch.set_column(at("n_chars"), "n_chars", pa.array(sizes, pa.int64()))

    return run


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op7_entropy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s.kind != "entropy")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
