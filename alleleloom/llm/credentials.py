"""Secret scans: credentials that come in parts, linked by an interval join within scopes.

One pass over the texts finds parts: access identifiers, secrets and endpoints, each with its span. The base patterns are findings by
themselves. All other parts are weak candidates: a labelled value, a random-looking token, an address. They are reported
only when complementary parts co-occur: the parts of a text are joined by their intervals, in the same block (lines without a blank
one between them) and at most REACH code points apart, and an identifier needs a secret, a secret an identifier (or a label and an endpoint), an
endpoint both. In such a pair one side at least must be a base finding or bear a label, so that two random tokens report nothing.

The join deals each text's parts into bins of REACH code points; a part meets those that start within reach of its end, which are
bounded by the bin's width, never all parts of a text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: The base patterns, in the order of their kinds, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so that shorter ones needn't be looked at
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
BASE = 3
#: Code points between two parts that may belong together.
REACH = 256

ID, SECRET, ENDPOINT = 0, 1, 2
#: What a label says about its value; the first that fits counts.
LABELS = [
    (SECRET, re.compile(r"secret|passw|pwd|private|credential|auth|token|signature")),
    (ENDPOINT, re.compile(r"endpoint|host|server|url|uri|dsn|bucket|region")),
    (ID, re.compile(r"access_?key|key_?id|client|user|login|account|app_?id|tenant")),
    (SECRET, re.compile(r"key")),
]
LABELLED = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]{1,59})["']?\x20{0,8}[:=]\x20{0,8}["']?([^\s"'<>,;]{4,})""", re.ASCII)
ADDRESS = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,19}://[^\s"'<>]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}:[0-9]{2,5}(?![0-9])""", re.ASCII)
UNLABELLED_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])", re.ASCII)
UNLABELLED_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
#: A random-looking token has this many bits a character at least.
BITS = 3.5
#: Texts without any of these have no base finding and nothing labelled, hence no part that could be reported.
SUSPECT = r"""(?i:(?:pass|secret|token|key|pwd|auth|cred|private|signature|user|login|account|client|app_?id|tenant)[a-z0-9_-]*["']?\x20*[:=])|AKIA|[0-9a-f]{24}"""
BLANK = re.compile(r"\n[\x20\t\r]*(?=\n)")

PART = "start long, end long, kind int, role int, anchored boolean, block long"
_NAMES = [f.split()[0] for f in PART.split(", ")]


def bits(token: str) -> float:
    """Bits a character of a token by the frequencies of its own characters."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token) and bits(token) >= BITS


def parts_of(text: str) -> list[tuple]:
    """The parts of a text: start, end, kind, role, whether base or labelled, block. Weak ones overlap neither base ones nor those found before them."""
    found = [(*m.span(), 0, SECRET, True) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1, ID, True) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), 2, SECRET, True) for m in HEX.finditer(text)]
    taken = merged([x[:2] for x in found])
    for weak in (labelled, addresses, unlabelled):
        new = [x for x in weak(text) if not overlaps(taken, *x[:2])]
        found += new
        taken = merged(taken + [x[:2] for x in new])
    blanks = [m.start() for m in BLANK.finditer(text)] if found else []
    return [(*x, bisect_right(blanks, x[0])) for x in sorted(found)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span has a character in one of the sorted, separate ``spans``."""
    k = bisect_right(spans, (end - 1, math.inf)) - 1
    return k >= 0 and spans[k][1] > start


def labelled(text: str) -> Iterator[tuple]:
    for m in LABELLED.finditer(text):
        role = next((r for r, p in LABELS if p.search(m[1].lower())), None)
        if role is not None and not m[2].startswith("//"):
            yield *m.span(), BASE + role, role, role != ENDPOINT


def addresses(text: str) -> Iterator[tuple]:
    for m in ADDRESS.finditer(text):
        yield *m.span(), BASE + ENDPOINT, ENDPOINT, False


def unlabelled(text: str) -> Iterator[tuple]:
    for m in UNLABELLED_ID.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]):
            yield *m.span(), BASE + ID, ID, False
    for m in UNLABELLED_SECRET.finditer(text):
        if random_looking(m[0]):
            yield *m.span(), BASE + SECRET, SECRET, False


def with_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, parts) for every row of ``docs``, written; ``row`` is a number of its own for each.

    Texts that can't have a part to report aren't sent to Python. The others are read there one by one.
    """
    kind = pa.list_(pa.struct(list(zip(_NAMES, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]))))

    def scanned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [[dict(zip(_NAMES, p)) for p in parts_of(x.as_py())] if x.is_valid else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "parts"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(text.rlike(SUSPECT), text).alias("text"))
    parts = rows.mapInArrow(scanned, f"doc_id long, parts array<struct<{PART}>>")
    return cut(parts.withColumn("row", F.monotonically_increasing_id()))  # written with its number, which so stays the same


def linked(parts: DataFrame) -> DataFrame:
    """(row, start, end, kind) of the weak parts that have what complements them, from the parts of all rows (row, then PART)."""
    ahead = parts.select("row", "block", F.struct("start", "end", "kind", "role", "anchored").alias("a"))
    bins = F.sequence(F.floor(F.col("a.end") / REACH), F.floor((F.col("a.end") + REACH) / REACH))
    ahead = ahead.withColumn("bin", F.explode(bins))
    behind = parts.select("row", "block", F.floor(F.col("start") / REACH).alias("bin"), F.struct("start", "end", "kind", "role", "anchored").alias("b"))
    pairs = ahead.join(behind, ["row", "block", "bin"])
    near = (F.col("b.start") >= F.col("a.end")) & (F.col("b.start") <= F.col("a.end") + REACH)
    pairs = pairs.filter(near & (F.col("a.role") != F.col("b.role"))).withColumn("firm", F.col("a.anchored") | F.col("b.anchored"))
    sides = F.array(F.struct(F.col("a").alias("of"), F.col("b.role").alias("other")), F.struct(F.col("b").alias("of"), F.col("a.role").alias("other")))
    each = pairs.select("row", "firm", F.inline(sides)).filter(F.col("of.kind") >= BASE)
    has = lambda role: F.col("other") == role
    met = each.groupBy("row", "of").agg(*[F.max(has(r)).alias(f"has{r}") for r in (ID, SECRET, ENDPOINT)], *[F.max(has(r) & F.col("firm")).alias(f"firm{r}") for r in (ID, SECRET)])
    role = F.col("of.role")
    found = F.when(role == ID, F.col(f"firm{SECRET}")).when(role == SECRET, F.col(f"firm{ID}") | F.col("of.anchored") & F.col(f"has{ENDPOINT}"))
    found = found.otherwise(F.col(f"has{ID}") & F.col(f"has{SECRET}") & (F.col(f"firm{ID}") | F.col(f"firm{SECRET}")))
    return met.filter(found).select("row", "of.start", "of.end", "of.kind")


def listed(spans: Column) -> Column:
    """kind:start:end of each span (start, kind, end), by start and kind, with commas between them."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans of the base patterns), found (spans added by linking) for every row.

    Spans are structs of start, kind (its place in KINDS) and end, in code points. Equal rows have equal findings, each its
    own. A null text is empty and has none; a very long one is scanned whole, and its parts are joined bin by bin. Spans that start
    at one place go by kind. No rows, no result rows. Other columns are not read, whatever their names.
    """
    rows = with_parts(docs, id_col, text_col)
    weak = rows.filter(F.exists("parts", lambda p: p["kind"] >= BASE) & (F.size("parts") > 1))
    found = linked(weak.select("row", F.inline("parts")))
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))  # of one text
    base = F.transform(F.filter("parts", lambda p: p["kind"] < BASE), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rows = rows.withColumn("base", base).join(found, "row", "left")
    found = F.coalesce("found", F.filter("base", lambda s: F.lit(False)))
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)], "base", found.alias("found"))


def op12_credentials(spark, sf_dir: str) -> DataFrame:
    rows = find_credentials(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "found")).alias("spans"),
    )
