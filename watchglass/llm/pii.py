"""Personal data: identifiers of known form, and others that stand where those stand.

Base spans are e-mail and IP addresses, card and phone numbers, by pattern and check.
They are the seeds of a bootstrap. Everything that looks like an identifier, whether it
passes a check or not, is an instance; the two words before it and its kind form a
lexical pattern, so that seeds of one form back a context in which others are found.
Patterns and instances are a bipartite graph. Seeds score 1. In
each round a pattern scores the mean of its instances, an instance the noisy-or of its
patterns; seeds keep their 1. Patterns that SUPPORT instances of a score above 1/2 back,
and that score CONFIDENCE at least, then give their other instances as further spans,
of the pattern's kind.

The graph is made of distinct pairs, so copies of a document add nothing. All joins and
sums are on patterns and instances; nothing of them is collected.

Defined results: a null text is empty and has no spans. Spans may overlap between kinds.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8
DAMPING = 0.9  # of a pattern's score in an instance's
_AROUND = 64  # code points beside an @ that may belong to an instance
_CONTEXT = 80  # code points before an instance in which its two words are looked for

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20-]{5,}[0-9]")
_LETTER = re.compile(r"[^\W\d_]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def _ips(text: str) -> list[Span]:
    def small(part: str) -> bool:
        bare = part.lstrip("0")
        return len(bare) < 3 or len(bare) == 3 and int(bare) <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": _ips(text),
        "card": _cards(text),
        "phone": _phones(text) if "+" in text else [],
    }


def _ordered(spans: dict[str, list[Span]]) -> list[tuple[int, int, int]]:
    """start, number of the kind, end"""
    return sorted((s, KINDS.index(k), e) for k, v in spans.items() for s, e in v)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def instances(text: str, spans: dict[str, list[Span]]) -> list[tuple[str, str, bool, int, int, int]]:
    """pattern, instance, whether a seed, number of the kind, start, end."""
    places: list[tuple[int, int, str]] = []
    for m in re.finditer("@", text) if "@" in text else ():
        before = re.search(r"\S*$", text[max(0, m.start() - _AROUND) : m.start()]).group()
        after = re.match(r"\S*", text[m.end() : m.end() + _AROUND]).group().rstrip(".,;:!?)>]\"'")
        if before and after:
            places.append((m.start() - len(before), m.end() + len(after), "email"))
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        dotted = m.group().count(".") == 3 and n <= 12
        kind = "ip" if dotted else "card" if n >= 14 else "phone"
        if n >= 6:
            places.append((*m.span(), kind))
    found = []
    for start, end, kind in places:
        words = text[max(0, start - _CONTEXT) : start].lower().split()[-2:]
        left = " ".join(re.sub(r"[0-9]", "0", w) for w in words)
        if len(words) < 2 or not _LETTER.search(left):
            continue
        here = [(s, e) for s, e in spans[kind] if s < end and start < e]
        seed = bool(here)
        if seed:
            start, end = here[0]
        elif any(s < end and start < e for v in spans.values() for s, e in v):
            continue
        value = text[start:end]
        pattern = f"{kind}|{left}"
        found.append((pattern, value, seed, KINDS.index(kind), start, end))
    return found


_INSTANCE = pa.struct([
    ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()),
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
])
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = (
    "doc_id long, hash long, counts array<long>, base string, spans " + _SPAN + ", instances "
    "array<struct<pattern:string,instance:string,seed:boolean,kind:int,start:int,end:int>>"
)


def _as_spans(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    return pa.array([[dict(zip(("start", "kind", "end"), s)) for s in r] for r in rows], kind)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bases, spans, seen = [], [], [], []
        for text in batch.column(2):
            text = text.as_py()
            found = base_spans(text)
            ordered = _ordered(found)
            counts.append([len(found[k]) for k in KINDS])
            bases.append(joined(ordered))
            spans.append(ordered)
            names = [f.name for f in _INSTANCE]
            seen.append([dict(zip(names, i)) for i in instances(text, found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int64())), pa.array(bases),
             _as_spans(spans), pa.array(seen, pa.list_(_INSTANCE))],
            names=["doc_id", "hash", "counts", "base", "spans", "instances"],
        )


def extracted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base spans and instances of each document; `hash` is that of its text."""
    whole = text_or_empty(text)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    return written(source.mapInArrow(_extract, _FOUND), "identifiers")


def patterns(pairs: DataFrame) -> DataFrame:
    """pattern, score, support: of distinct rows (pattern, instance, seed), after all rounds."""
    pairs = written(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pairs")
    scores = pairs.groupBy("instance").agg(F.max("seed").cast("double").alias("s"))
    for _ in range(ROUNDS):
        weighed = written(
            pairs.join(scores, "instance").groupBy("pattern").agg(
                F.avg("s").alias("score"), F.count_if(F.col("s") > 0.5).alias("support")
            ),
            "patterns",
        )
        backed = weighed.where(F.col("support") >= SUPPORT)
        miss = F.sum(F.log1p(-DAMPING * F.coalesce("score", F.lit(0.0))))
        scores = pairs.join(backed, "pattern", "left").groupBy("instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(1.0 - F.exp(miss)).alias("s")
        )
    return weighed


def further_spans(found: DataFrame) -> DataFrame:
    """doc_id, hash, more: spans that accepted patterns add, a row per document that has any."""
    seen = found.select("doc_id", "hash", F.explode("instances").alias("i")).select("doc_id", "hash", "i.*")
    accepted = patterns(seen.select("pattern", "instance", "seed")).where(
        (F.col("support") >= SUPPORT) & (F.col("score") >= CONFIDENCE)
    )
    new = seen.where(~F.col("seed")).join(accepted.select("pattern"), "pattern", "left_semi")
    more = F.collect_set(F.struct("start", "kind", "end")).alias("more")
    return written(new.groupBy("doc_id", "hash").agg(more), "further-spans")


def _with_more(df: DataFrame, found: DataFrame, hashed: Column) -> DataFrame:
    more = further_spans(found).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("more").alias("__more"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (hashed == F.col("__hash"))
    return df.join(more, same, "left").drop("__id", "__hash")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind of base spans, checksum of these, and all spans as text."""
    found = extracted(docs)
    both = _with_more(found.drop("instances"), found, F.col("hash"))
    every = F.array_sort(F.array_union("spans", F.coalesce("__more", F.array().cast(_SPAN))))
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(every, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    ))
    return both.select(
        "doc_id", *(F.get("counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2("base", 256).alias("base_sha256"), F.array_join(shown, ",").alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with each stretch of spans replaced by the name of its first one's kind."""
    out, at, ends = [], 0, -1
    for start, kind, end in sorted(spans):
        if start >= ends:
            out += [text[at:start] if at <= start else "", f"<{KINDS[kind].upper()}>"]
        ends = max(ends, end)
        at = ends
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with all spans masked; a column n_chars follows the text where it changes."""
    more = _with_more(docs, extracted(docs), F.xxhash64(text_or_empty()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size).to_pylist() if size >= 0 else []
            for i, (text, extra) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist())):
                spans = _ordered(base_spans(text)) if text else []
                spans += [(s["start"], s["kind"], s["end"]) for s in extra or ()]
                if spans:
                    texts[i] = masked(text, spans)
                    if size >= 0:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size >= 0:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return more.mapInArrow(run, docs.schema)
