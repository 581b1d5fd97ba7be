"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Base: e-mail addresses, IP addresses, card and phone numbers by their patterns, leftmost and without overlap within a kind.

Bootstrapping: the base entities are the seeds. Every seed, every other token that looks like an identifier, and every run of
neighbouring groups of digits (also masked with x or *, or with an area code in brackets) stands in lexical contexts (the word
before it, the two words before it, the words on both sides); these are the patterns. A run that is longer than a number of its
kind can be gives its longest stretches that are not. Candidates that begin at one place are readings of one thing: they count
once in the size of a pattern, with the surest of them. Patterns and the distinct values in them form a bipartite graph, which
Spark scores in turns:

* a pattern's score for a kind is the sum of its distinct values' confidence in that kind, over the same sum and what speaks
  against it: each value's doubt, two thirds of it where the value has the kind's shape; it needs SUPPORT distinct values that are
  at least CONFIDENCE sure;
* a value's confidence in a kind whose shape it has is 1 - product(1 - score) over its patterns that score at least
  PATTERN_SCORE; seeds keep 1. Values found in one turn back further patterns in the next.

After ROUNDS turns, tokens whose value is at least CONFIDENCE sure become spans of that kind, unless they overlap a base span;
of those of a kind that overlap each other, the leftmost and longest. Base spans always stay; the counts are of base spans.

Defined cases: a null text is empty; an empty text has no spans; rows that repeat a doc_id each get their row; spans count in
code points, ends exclusive; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import materialise, small_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
SUPPORT, PATTERN_SCORE, CONFIDENCE, ROUNDS = 5, 0.8, 0.9, 3
#: What a value that has a kind's shape, but isn't known to be of that kind, counts against a pattern; any other value counts 1.
UNKNOWN = 2 / 3

#: Fixed patterns of the contract. No number may start within the digits that a longer one has just tried in vain.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: A token with a digit or an at-sign, without quotes, brackets and stops around it.
TOKEN = re.compile(r"[^\s\"'()<>\[\]{},;]+")
#: Groups of digits, each perhaps with x, *, stops, hyphens or slashes in it, between single spaces; groups may be bracketed.
_GROUP = r"(?>[0-9xX*]+(?:[./-][0-9xX*]+)*)(?![./-]?\w|@)"
RUN = re.compile(rf"(?<![^\s\"'(<\[{{,;:=|])\+?(?:\({_GROUP}\)[ -]?)?{_GROUP}(?:(?: [-/] | ?\({_GROUP}\)[ -]?| ){_GROUP})*")
PIECE = re.compile("[^ ]+")
#: Fewest characters of a run, and most for a phone and a card number (as in SHAPES). Longer values are known by their hashes.
RUN_LEAST, RUN_MOST, LONG = 7, (22, 26), 64
#: The shape that a discovered value of each kind must have.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}([.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9][0-9 .*xX-]{10,24}[0-9]$",
    "phone": r"^[+(0-9][0-9 ()./-]{5,20}[0-9]$",
}

_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SEEN = T.StructType([*_SPAN.fields, T.StructField("value", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("seen", T.ArrayType(_SEEN))]
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Finds each at-sign and looks to both sides, so that no run of letters is tried twice."""
    at, free = text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(LOCAL))
        match = DOMAIN.match(text, at + 1) if local else None
        if match:
            yield at - local, match.end()
            free = match.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    left = text[max(0, start - 60) : start].lower().split()[-2:]
    right = text[end : end + 30].lower().split()[:1]
    near = left[-1] if left else "^"
    return [f"1 {near}", f"2 {' '.join(left) or '^'}", f"3 {near} _ {right[0] if right else '$'}"]


def stretches(text: str, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The longest stretches of neighbouring pieces that are no longer than a phone or a card number can be."""
    found = set()
    for most in RUN_MOST:
        end = last = 0
        for first, (a, _) in enumerate(pieces):
            end = max(end, first)
            while end < len(pieces) and pieces[end][1] - a <= most:
                end += 1
            if end <= max(first, last):
                continue
            last, whole = end, text[a : pieces[end - 1][1]]
            start, value = a + len(whole) - len(whole.lstrip(" /*xX-")), whole.strip(" /*xX-")
            if len(value) >= RUN_LEAST and (" " in value or "(" in value) and value.count("(") == value.count(")"):
                found.add((start, start + len(value)))
    yield from sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of identifier-like tokens and of runs of groups of digits, outside of base spans."""
    starts, ends = [], []  # of the base spans, joined where they overlap
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        at = bisect_right(ends, a)
        return at == len(starts) or starts[at] >= b

    for m in TOKEN.finditer(text):
        a, b = m.start(), m.start() + len(m[0].rstrip(".:!?|=\\"))
        if b - a >= 5 and ("@" in m[0] or DIGIT.search(m[0])) and free(a, b):
            yield a, b
    for m in RUN.finditer(text):
        pieces: list[tuple[int, int]] = []
        for piece in PIECE.finditer(text, *m.span()):
            if free(*piece.span()):
                pieces.append(piece.span())
            else:
                yield from stretches(text, pieces)
                pieces = []
        yield from stretches(text, pieces)


def key(value: str) -> str:
    """The value in small letters; of a long one a hash, which has the shape of an address if the value has."""
    if len(value) <= LONG:
        return value.lower()
    mark = "@" if re.match(SHAPES["email"], value) else " "
    return f"long{mark}{hashlib.blake2b(value.lower().encode(errors='surrogatepass'), digest_size=16).hexdigest()}"


def seen_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str | None, list[str]]]:
    """Seeds (with their kinds) and candidates (kind -1), with their contexts: kind, start, end, value, slot, patterns.

    slot: the value of the longest candidate that begins there, if that is another one.
    """
    out = [(k, a, b, text[a:b].lower(), None, contexts(text, a, b)) for k, a, b in base]
    if "@" not in text and not DIGIT.search(text):
        return out
    places, longest = list(candidates(text, base)), {}
    for a, b in places:
        longest[a] = max(b, longest.get(a, b))
    for a, b in places:
        slot = None if b == longest[a] else key(text[a : longest[a]])
        out.append((-1, a, b, key(text[a:b]), slot, contexts(text, a, b)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(FOUND)
    for batch in batches:
        base, seen = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([dict(kind=k, start=a, end=b) for k, a, b in spans])
            seen.append([dict(kind=k, start=a, end=b, value=v, slot=s, patterns=p) for k, a, b, v, s, p in seen_values(text or "", spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, schema.field(1).type), pa.array(seen, schema.field(2).type)], schema=schema)


def bootstrap(seen: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """kind, value: values that are no seeds, of which good patterns are sure. seen: kind (-1: none), value, slot, patterns."""
    kinds = range(len(KINDS))
    sure = [f"sure{k}" for k in kinds]
    slot = F.coalesce("slot", "value").alias("slot")
    fits = [F.col("value").rlike(SHAPES[kind]).alias(f"fits{k}") for k, kind in enumerate(KINDS)]
    edges = seen.select("kind", "value", slot, F.explode("patterns").alias("pattern")).distinct()
    edges = materialise(edges.select("*", *fits), "pii-edges")
    places = edges.where("kind < 0").select("value", "pattern", *[f"fits{k}" for k in kinds]).distinct()
    known = None
    for _ in range(rounds):
        own = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in kinds]
        if known is None:
            rated = edges.select("pattern", "slot", *[f"fits{k}" for k in kinds], *[c.alias(s) for c, s in zip(own, sure)])
        else:
            found = known.select(F.col("value").alias("known"), *[F.col(s).alias(f"found{k}") for k, s in enumerate(sure)])
            gained = [F.greatest(c, F.when(F.col("kind") < 0, F.coalesce(f"found{k}", F.lit(0.0))).otherwise(0.0)) for k, c in enumerate(own)]
            joined = edges.join(found, F.col("value") == F.col("known"), "left")
            rated = joined.select("pattern", "slot", *[f"fits{k}" for k in kinds], *[c.alias(s) for c, s in zip(gained, sure)])
        slots = rated.groupBy("pattern", "slot").agg(*[F.max(s).alias(s) for s in sure], *[F.max(f"fits{k}").alias(f"fits{k}") for k in kinds])
        sums = []
        for k, s in enumerate(sure):
            against = (1 - F.col(s)) * F.when(F.col(f"fits{k}"), UNKNOWN).otherwise(1.0)
            backed = F.count(F.when(F.col(s) >= CONFIDENCE, 1)) >= support
            sums.append(F.when(backed, F.sum(s) / F.sum(F.col(s) + against)).alias(f"score{k}"))
        scored = slots.groupBy("pattern").agg(*sums)
        good = [F.when(F.col(f"score{k}") >= PATTERN_SCORE, F.col(f"score{k}")).alias(f"score{k}") for k in kinds]
        good = scored.select("pattern", *good).where(F.coalesce(*[f"score{k}" for k in kinds]).isNotNull())
        met = places.join(materialise(good, "pii-patterns"), "pattern")
        sums = []
        for k, s in enumerate(sure):
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce(F.when(F.col(f"fits{k}"), F.col(f"score{k}")), F.lit(0.0)), F.lit(1e-9)))))
            sums.append((1 - doubt).alias(s))
        known = materialise(met.groupBy("value").agg(*sums), "pii-sure")
    shown = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(s).alias("sure")) for k, s in enumerate(sure)])).alias("k")
    return known.select("value", shown).where(F.col("k.sure") >= CONFIDENCE).select("k.kind", "value")


def _is_kind(k: int):
    return lambda s: s["kind"] == k  # a second parameter would be taken for the index


def _joined(spans: str) -> F.Column:
    """kind:start:end, comma-joined, by kind as listed and start."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def _apart(spans: str) -> F.Column:
    """Of (kind, start, -end), as spans: the leftmost and longest of each kind, without overlap."""

    def add(kept: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(kept, F.lit(-1))
        again = (last["kind"] == s["kind"]) & (last["end"] > s["start"])
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_spans_type()), add)


def _counted() -> list[F.Column]:
    return [F.size(F.filter("base", _is_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]


def base(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base for each row of docs: what the fixed patterns find, without any learning."""
    small_batches(docs.sparkSession)
    found = with_columns(docs, doc_id="bigint", text="string").mapInArrow(_extract, FOUND)
    spans = _joined("base")
    return found.select("doc_id", *_counted(), F.sha2(spans, 256).alias("base_sha256"), spans.alias("base"))


def find(docs: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    found = with_columns(docs, doc_id="bigint", text="string").mapInArrow(_extract, FOUND)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    seen = found.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    new = bootstrap(seen, support, rounds)
    more = seen.where("kind < 0").drop("kind").join(new, "value")
    more = more.groupBy("row").agg(F.collect_set(F.struct("kind", F.col("start"), (-F.col("end")).alias("back"))).alias("more"))
    more = more.select("row", _apart("more").alias("more"))
    none = F.array().cast(_spans_type())
    return found.join(more, "row", "left").select(
        "doc_id",
        *_counted(),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("more", none))).alias("spans"),
    )


def _spans_type() -> T.ArrayType:
    return T.ArrayType(_SPAN)
