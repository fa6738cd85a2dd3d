"""Secrets in texts: certain spans by their form, weak ones where their other parts stand near.

Assignments to names of secrets, access key ids and long hexadecimal strings are reported for
themselves. Other credentials come in parts, none of which tells much alone: an identifier (user
or client names, other key ids), a secret (an opaque string, a short password) and an endpoint (URL,
host with port). Per text, regular expressions find candidates and the scope of each, the
paragraph that it stands in. Spark then joins the intervals: identifiers and secrets of one scope
that are at most ``gap`` code points apart are linked, and endpoints with such links. Of a link
between two weak parts something is reported only if an endpoint belongs to it too; certain spans
vouch for what they are linked with.

Intervals are joined by bins of ``gap`` code points. A pair is made in the first bin that both
touch, so it is made once; and as candidates of a kind don't overlap, few have a place in a bin:
there is no quadratic growth with the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import stored

GAP = 200
ROLES = ("identifier", "secret", "endpoint")
# Kinds in the order that spans of the same start are listed in.
CERTAIN = ("assign", "access", "hex")
WEAK = ("identifier", "opaque", "short", "endpoint")
_ROLE_OF = {"assign": "secret", "access": "identifier", "hex": "secret"} | {
    "identifier": "identifier", "opaque": "secret", "short": "secret", "endpoint": "endpoint"
}

_CASE = re.ASCII | re.IGNORECASE
# What counts as a certain secret, and the least length of what is assigned.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _CASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

_IDENTIFIER = re.compile(
    r"""\b(?:(?:A[A-Z]{2}A[A-Z0-9]{12,})\b
    |(?:user(?:_?name|_?id)?|login|account(?:_?(?:id|name))?|client_?id|(?:access_?)?key_?id|tenant_?id)
     ["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})""",
    re.ASCII | re.VERBOSE,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_SHORT = re.compile(
    r"""\b(?:pass(?:phrase|code)?|pwd|pin|key|auth|credential|password|passwd|secret|token)
    ["']?\x20*[:=]\x20*["']?[^\s"',;]{4,}""",
    re.ASCII | re.VERBOSE | re.IGNORECASE,
)
_ENDPOINT = re.compile(
    r"""(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+
    |(?<![\w.-])(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+:\d{2,5}(?!\d)
    |(?<![\w.-])localhost:\d{2,5}(?!\d))""",
    re.ASCII | re.VERBOSE,
)
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")


def certain_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what is a secret by itself, in the order of starts, then of kinds.
    Matches of a kind are found from the left without overlaps; those too short are dropped then."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return [(start, CERTAIN[kind], end) for start, kind, end in sorted(found)]


def _opaque(part: str) -> bool:
    """Whether a string looks drawn by chance: letters and digits, mixed more than once."""
    kinds = [c.isdigit() for c in part if c.isalnum()]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return changes >= 3


def weak_spans(text: str, certain: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of weak candidates that don't overlap certain spans or, of the other
    kinds, those listed before; none if the text has no identifier or no secret at all."""
    taken = sorted((start, end) for start, _, end in certain)
    found: list[tuple[int, str, int]] = []

    def take(kind: str, pattern: re.Pattern, test=None) -> None:
        starts = np.array([s for s, _ in taken], dtype=np.int64)
        ends = np.maximum.accumulate(np.array([e for _, e in taken], dtype=np.int64)) if taken else starts
        new = []
        for m in pattern.finditer(text):
            before = int(np.searchsorted(starts, m.end()))
            if before and ends[before - 1] > m.start() or test and not test(m[0]):
                continue
            new.append((m.start(), kind, m.end()))
        found.extend(new)
        taken.extend((start, end) for start, _, end in new)
        taken.sort()

    take("identifier", _IDENTIFIER)
    kinds = {_ROLE_OF[kind] for _, kind, _ in [*certain, *found]}
    if "identifier" not in kinds:
        return []
    take("endpoint", _ENDPOINT)
    take("short", _SHORT)
    take("opaque", _OPAQUE, _opaque)
    kinds |= {_ROLE_OF[kind] for _, kind, _ in found}
    return sorted(found) if "secret" in kinds else []


_SPAN = "struct<start: long, kind: string, end: long>"
_PART = "struct<scope: int, role: string, weak: boolean, start: long, kind: string, end: long>"


def scanned(docs: DataFrame) -> DataFrame:
    """row (unique in this result once it is stored), doc_id, certain (spans) and parts (certain and
    weak spans with their scopes; empty if no weak part can be linked) of every row's whole text.
    A null text is empty."""
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, certain array<{_SPAN}>, parts array<{_PART}>"
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
    part = pa.struct(
        [("scope", pa.int32()), ("role", pa.string()), ("weak", pa.bool_()), *[(f.name, f.type) for f in span]]
    )

    def parts_of(text: str, certain: list[tuple[int, str, int]]) -> list[tuple]:
        weak = weak_spans(text, certain)
        if not weak:
            return []
        ends = np.array([m.end() for m in _SCOPE_END.finditer(text)], dtype=np.int64)
        return [
            (int(np.searchsorted(ends, start, "right")), _ROLE_OF[kind], is_weak, start, kind, end)
            for spans, is_weak in ((certain, False), (weak, True))
            for start, kind, end in spans
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            certain, parts = [], []
            for scalar in batch.column("text"):
                text = scalar.as_py() or ""
                certain.append(certain_spans(text))
                parts.append(parts_of(text, certain[-1]))
            spans = [[dict(zip(span.names, s, strict=True)) for s in one] for one in certain]
            pieces = [[dict(zip(part.names, p, strict=True)) for p in one] for one in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)),
                    batch.column("doc_id"),
                    pa.array(spans, pa.list_(span)),
                    pa.array(pieces, pa.list_(part)),
                ],
                names=["row", "doc_id", "certain", "parts"],
            )
            row += batch.num_rows

    return docs.mapInArrow(run, schema)


def joined_intervals(left: DataFrame, right: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Pairs of rows of the same keys whose intervals are at most ``gap`` apart, each pair once.

    ``left`` and ``right`` have start_l, end_l and start_r, end_r (exclusive) besides the keys.
    """
    width = max(gap, 1)

    def bins(df: DataFrame, start: Column, end: Column, first: str) -> DataFrame:
        low, high = F.floor(start / width), F.floor(end / width)
        return df.withColumn(first, low).withColumn("_bin", F.explode(F.sequence(low, high)))

    a = bins(left, F.col("start_l") - gap, F.col("end_l") + gap, "_low_l")
    b = bins(right, F.col("start_r"), F.col("end_r"), "_low_r")
    near = (F.col("start_r") <= F.col("end_l") + gap) & (F.col("end_r") >= F.col("start_l") - gap)
    once = F.col("_bin") == F.greatest("_low_l", "_low_r")
    return a.join(b, [*keys, "_bin"]).where(near & once).drop("_bin", "_low_l", "_low_r")


def linked(parts: DataFrame, gap: int = GAP) -> DataFrame:
    """row, start, kind and end of the weak parts that belong to a credential.

    ``parts`` has row, scope, role, weak, start, kind and end. An identifier and a secret are
    linked if they stand in one scope at most ``gap`` apart. If one of them is certain, the other
    belongs to a credential; if none is, both do where an endpoint is at most ``gap`` from the
    stretch of the two. Such an endpoint does too, in either case.
    """
    keys = ["row", "scope"]

    def side(role: str, suffix: str) -> DataFrame:
        names = [F.col(c).alias(f"{c}_{suffix}") for c in ("weak", "start", "kind", "end")]
        return parts.where(F.col("role") == role).select(*keys, *names)

    pairs = joined_intervals(side("identifier", "l"), side("secret", "r"), keys, gap)
    stretch = pairs.select(
        *keys,
        F.struct("weak_l", "start_l", "kind_l", "end_l").alias("one"),
        F.struct("weak_r", "start_r", "kind_r", "end_r").alias("two"),
        F.least("start_l", "start_r").alias("start_l"),
        F.greatest("end_l", "end_r").alias("end_l"),
    )
    whole = joined_intervals(stretch, side("endpoint", "r"), keys, gap)

    def weak(df: DataFrame, part: str, suffix: str) -> DataFrame:
        fields = [F.col(f"{part}.{c}_{suffix}").alias(c) for c in ("start", "kind", "end")]
        return df.where(F.col(f"{part}.weak_{suffix}")).select("row", *fields)

    vouched = stretch.where("NOT one.weak_l OR NOT two.weak_r")
    found = whole.select("row", *[F.col(f"{c}_r").alias(c) for c in ("start", "kind", "end")])
    for df in (vouched, whole):
        found = found.unionAll(weak(df, "one", "l")).unionAll(weak(df, "two", "r"))
    return found.distinct()


def secret_spans(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, certain and linked, arrays of (start, kind, end) in code
    points, end exclusive: what is a secret by itself, and the weak parts of linked credentials.

    The whole text is searched; a null or empty text has no span. Rows that repeat an id or a text
    are rows of their own. Other columns of ``docs`` are not read. No row gives no row.
    """
    rows = stored(scanned(docs), "secret-scan")
    parts = rows.where(F.size("parts") > 0).select("row", F.inline("parts"))
    # All spans of one text, no more.
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked")
    found = linked(parts, gap).groupBy("row").agg(spans)
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.join(found, "row", "left").select(
        "doc_id", "certain", F.coalesce("linked", none).alias("linked")
    )


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas, by start, then in the order of kinds."""
    place = {kind: i for i, kind in enumerate([*CERTAIN, *WEAK])}
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")
            ),
        )
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
