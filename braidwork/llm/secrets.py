"""Secret scanning through a trigram index: Boolean trigram queries, postings, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty


@dataclass(frozen=True)
class Rule:
    """One kind of secret: an ASCII-only regex whose matches count where ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds that are found besides.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Texts of a character class or of alternatives are listed up to so many; beyond, the part is "anything".
MOST_STRINGS = 32


def trigram_query(rule: Rule) -> frozenset[frozenset[bytes]]:
    """The Boolean trigram query of a rule in disjunctive form, derived from its parsed regex.

    A set of clauses, of which any must hold; a clause is a set of lower-case trigrams, all of which a
    matching text has. An empty clause means that the rule has matches without mandatory trigrams.
    """
    anything = None

    def cross(left, right):
        if left is anything or right is anything or len(left) * len(right) > MOST_STRINGS:
            return anything
        return {a + b for a in left for b in right}

    def grams(texts) -> list[frozenset[bytes]]:
        return [frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]

    def both(a, b):
        return {x | y for x in a for y in b}

    def exact(items):
        """Clauses of a sequence, and the set of all its texts or anything."""
        clauses, run, whole = {frozenset()}, {b""}, {b""}

        def flush():
            nonlocal clauses, run
            if run is not anything:
                clauses = both(clauses, set(grams(run)))
            run = {b""}

        for op, arg in items:
            more, texts = one(op, arg)
            clauses = both(clauses, more)
            joined = cross(run, texts) if texts is not anything else anything
            if joined is anything:
                flush()
                run = texts if texts is not anything else {b""}
            else:
                run = joined
            whole = cross(whole, texts)
        flush()
        return clauses, whole

    def one(op, arg):
        free = {frozenset()}
        if op is sre.LITERAL:
            return free, {chr(arg).lower().encode()}
        if op is sre.IN:
            texts = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    texts.add(chr(value).lower().encode())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    texts |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
                else:
                    return free, anything
            return free, texts
        if op is sre.SUBPATTERN:
            return exact(arg[-1])
        if op is sre.BRANCH:
            parts = [exact(x) for x in arg[1]]
            texts = set().union(*(t for _, t in parts)) if all(t is not anything for _, t in parts) else anything
            return set().union(*(c for c, _ in parts)), texts
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            clauses, texts = exact(inner)
            if low == 0:
                return free, (texts | {b""} if high == 1 and texts is not anything else anything)
            return clauses, (texts if low == high == 1 else anything)
        return free, anything

    clauses, _ = exact(sre_parser.parse(rule.pattern, re.ASCII))
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


class TrigramIndex:
    """Postings of one batch of texts: for each trigram that a rule asks for, the texts that have it.

    Texts are bytes; A-Z is folded, so a posting never misses a text whose rule matches in either case.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule)) for rule in rules]
        wanted = sorted({g for _, _, query in self.rules for clause in query for g in clause})
        self.grams = {g: i for i, g in enumerate(wanted)}
        self.lookup = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for g, i in self.grams.items():
            self.lookup[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each wanted trigram the sorted positions of the texts that contain it."""
        found = [np.zeros(0, np.int64)] * len(self.grams)
        parts: list[list[np.ndarray]] = [[] for _ in self.grams]
        step = 1 << 22
        for at in range(0, len(data), step):
            low = self.fold[data[at : at + step + 2]].astype(np.uint32)
            if len(low) < 3:
                break
            hit = self.lookup[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            where = np.flatnonzero(hit)
            text = np.searchsorted(offsets, where + at, side="right") - 1
            inside = where + at + 3 <= offsets[text + 1]
            key = np.unique(hit[where[inside]].astype(np.int64) * len(offsets) + text[inside])
            gram, text = key // len(offsets) - 1, key % len(offsets)
            for g in np.unique(gram):
                parts[g].append(text[gram == g])
        return [np.unique(np.concatenate(p)) if p else e for p, e in zip(parts, found)]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
        """For each rule the texts that its query selects; None: the rule must scan them all."""
        postings = self.postings(data, offsets)
        out: list[np.ndarray | None] = []
        for _, _, query in self.rules:
            if frozenset() in query:
                out.append(None)
                continue
            hits = np.zeros(0, np.int64)
            for clause in query:
                lists = sorted((postings[self.grams[g]] for g in clause), key=len)
                got = lists[0]
                for other in lists[1:]:
                    got = np.intersect1d(got, other, assume_unique=True)
                hits = np.union1d(hits, got)
            out.append(hits)
        return out


def _matches(pattern: re.Pattern, rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in code points; those that fail the length are dropped afterwards."""
    return [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def _found(index: TrigramIndex, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text of a segment the spans ``(start, rule, end)``, sorted."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    chosen = index.candidates(np.frombuffer(b"".join(raw), np.uint8), offsets)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, ((rule, pattern, _), hits) in enumerate(zip(index.rules, chosen)):
        for i in range(len(texts)) if hits is None else hits.tolist():
            found[i] += [(a, order, b) for a, b in _matches(pattern, rule, texts[i])]
    return [sorted(f) for f in found]


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out_col: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` and ``out_col``: the spans of every rule, by start, then rule order.

    Each Arrow batch is one segment of the inverted index, so the index needs no shuffle, is bounded by
    the batch, and is rebuilt with its partition after a lost executor. Postings are kept for the
    trigrams that the rules' queries name. Null text is empty; an existing ``out_col`` is replaced.
    Spans count code points, end exclusive.
    """
    rows = docs.drop(out_col).withColumn(out_col, F.lit(None).cast(SPAN_TYPE))
    kept = [c for c in rows.columns if c != out_col]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in f] for f in _found(index, batch.column(at).fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(spans, span)], names=[*kept, out_col])

    return rows.mapInArrow(run, rows.schema)


def _cut(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, done = [], 0
    for a, b, k in merged:
        out += [text[done:a], f"[{rules[k].kind}]"]
        done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans merge under their first kind. Null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = _found(index, [t or "" for t in texts])
            if not any(found):
                yield batch
                continue
            clean = pa.array([_cut(t, f, rules) if f else t for t, f in zip(texts, found)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([clean if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_secrets``: counts and the digest of the base spans, and all spans, for every document."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    found = scan(docs).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))


def _oracle() -> str:
    """The same rows in DuckDB: matches by extraction, their places by the lengths of what lies between."""
    kinds = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        if rule.any_case:  # letters spelt out, so that only ASCII case counts
            head, tail = pattern.split(")", 1)
            pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail
        size = f"length(regexp_extract(m, '^(?:{pattern})$', {rule.group}))"
        kinds.append(
            f"select doc_id, {order} as ord, '{rule.kind}' as kind, s, s + length(m) as e from (select doc_id, unnest(ms) as m, unnest(list_transform(range(len(ms)), lambda i:"
            f" list_sum(list_transform(gaps[1:i+1], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i], lambda g: length(g))), 0)))::bigint as s"
            f" from (select doc_id, regexp_extract_all(text, '{pattern}') as ms, regexp_split_to_array(text, '{pattern}') as gaps from docs)) where {size} >= {max(rule.least, 1)}"
        )
    line = "string_agg(kind || ':' || s || ':' || e, ',' order by s, ord)"
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(kinds)}),
agg as (select doc_id, {', '.join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)},
  coalesce({line} filter (ord < {len(BASE_RULES)}), '') as base, coalesce({line}, '') as spans from found group by doc_id)
select d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in BASE_RULES)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs d left join agg using (doc_id)
"""


ORACLE_SQL = _oracle()
