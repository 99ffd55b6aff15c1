"""Personal data by pattern, and the terms that give it away by how often both occur together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.session import pin

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain. The local part is all of its characters before the @, back to the last match."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_BYTES:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start; a match that fails its check is dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


WORD = re.compile(r"[^\W\d_]{2,}")


def folded(word: str) -> str:
    """The word in lower case, where that keeps its length."""
    low = word.lower()
    return low if len(low) == len(word) else word


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Characters on either side that tell one use of a value or a term from another.
AROUND = 40


def _hashed(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _identity(text: str) -> tuple[int, int]:
    """Two longs that name a text."""
    raw = hashlib.blake2b(text.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _found(window: int):
    context = pa.struct([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64())])
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("base", pa.string()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("contexts", pa.list_(context))])

    def near(text: str, spans) -> list[dict]:
        out = {}
        covered = sorted((a, b) for _, a, b in spans)
        for _, a, b in spans:
            sides = WORD.findall(text, max(0, a - 12 * window), a)[-window:] + WORD.findall(text, b, b + 12 * window)[:window]
            entity, context = _hashed(text[a:b]), _hashed(text[max(0, a - AROUND) : b + AROUND])
            inside = {folded(w) for x, y in covered for w in WORD.findall(text, x, y) if abs(x - a) < 24 * window}
            for term in {folded(w) for w in sides} - inside:
                out[entity, term, context] = {"entity": entity, "term": term, "context": context}
        return list(out.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                texts = tx.decoded(data, offsets)
                high, low = zip(*map(_identity, texts))
                spans = [base_spans(t) for t in texts]
                count = lambda kind: [sum(k == kind for k, _, _ in s) for s in spans]  # noqa: E731, B023
                yield tx.batch_of(schema, high=high, low=low, doc_id=part.column("doc_id"), base=[joined(s) for s in spans], n_email=count("email"), n_ip=count("ip"), n_card=count("card"), n_phone=count("phone"), contexts=[near(t, s) for t, s in zip(texts, spans)])

    return run


FILTER_BITS = 1 << 23


def _slot(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=4).digest(), "little") % FILTER_BITS


USES = "high long, low long, term string, start array<int>, context array<long>"


def _uses(bits: bytes):
    """Every use of a word that may be a candidate: the filter has a fixed size and the join that follows is exact."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("term", pa.string()), ("start", pa.list_(pa.int32())), ("context", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, known = np.frombuffer(bits, np.uint8), {}

        def maybe(word: str) -> bool:
            got = known.get(word)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                slot = _slot(folded(word))
                got = known[word] = bool(marked[slot >> 3] >> (slot & 7) & 1)
            return got

        for batch in batches:
            for _, data, offsets in tx.chunks(batch):
                rows = []
                for text in tx.decoded(data, offsets):
                    places = {folded(w): [] for w in set(WORD.findall(text)) if maybe(w)}
                    if not places:
                        continue
                    for m in WORD.finditer(text):
                        if (term := folded(m[0])) in places:
                            places[term].append(m.start())
                    high, low = _identity(text)
                    rows += [{"high": high, "low": low, "term": t, "start": at, "context": [_hashed(text[max(0, a - AROUND) : a + len(t) + AROUND]) for a in at]} for t, at in places.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _bits(partials: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for batch in partials:
        for term in batch.column("term").to_pylist():
            slot = _slot(term)
            out[slot >> 3] |= np.uint8(1 << (slot & 7))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(out)), pa.array(out[out > 0].astype(np.int16))], names=["at", "byte"])


class Disclosure:
    """How strongly terms give protected values away, from all of ``docs`` (doc_id, text).

    A context is a found value with ``window`` words on either side. Contexts, and uses of a term, that repeat with
    AROUND characters on either side count once, so copied passages prove nothing. With n(e, t) contexts in which term t
    stands beside value e and n(t) uses of t in the corpus (or contexts with t, if more), the information t gives about e is PMI = log2 p(e|t) + IC(e), where
    p(e|t) = n(e, t) / n(t) and IC(e) = -log2 p(e). A term with at least ``support`` contexts is generalised if
    PMI >= ``generalise`` * IC(e) and removed if PMI >= ``remove`` * IC(e) for some e.
    """

    def __init__(self, docs: DataFrame, window: int = 5, support: int = 4, generalise: float = 0.9, remove: float = 0.95):
        spark = docs.sparkSession
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        schema = "high long, low long, doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, contexts array<struct<entity:long,term:string,context:long>>"
        self.rows = pin(texts.mapInArrow(tx.trimmed(_found(window)), schema))
        contexts = self.rows.select(F.explode("contexts").alias("c")).select("c.*").distinct()
        contexts = pin(contexts)
        values = contexts.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
        total = contexts.select("entity", "context").distinct().count()
        beside = contexts.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("n_beside"))
        together = contexts.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= support)
        content = -F.log2(F.col("n_entity") / F.lit(float(max(total, 1))))
        # n(t) is at least the number of contexts with t, which rules most terms out before the texts are read again
        most = F.col("together") * F.pow(F.lit(2.0), (1 - generalise) * content)
        together = pin(together.join(values, "entity").join(beside, "term").filter(F.col("n_beside") <= most))
        terms = together.select("term").distinct()
        marked = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        parts = terms.mapInArrow(tx.trimmed(_bits), "at long, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte"))
        for at, byte in parts.toLocalIterator():  # at most one row per byte of the filter
            marked[at] = byte & 255
        self.used = spark.createDataFrame([], USES)
        if marked.any():
            used = texts.mapInArrow(tx.trimmed(_uses(marked.tobytes())), USES).join(terms, "term", "left_semi")
            self.used = pin(used.dropDuplicates(["high", "low", "term"]))
        uses = self.used.select("term", F.explode("context").alias("context")).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
        known = together.join(uses, "term").withColumn("n_term", F.greatest("n_term", "n_beside"))
        share = F.log2(F.least(F.lit(1.0), F.col("together") / F.col("n_term")))
        pmi = known.select("entity", "term", "together", "n_term", "n_entity", content.alias("ic"), (content + share).alias("pmi"))
        self.evidence = pmi.filter((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
        verdict = F.when(F.max(F.col("pmi") / F.col("ic")) >= remove, "remove").otherwise("generalise")
        self.terms = pin(self.evidence.groupBy("term").agg(verdict.alias("action")))

    def spans(self, distinct: bool = False) -> DataFrame:
        """doc_id, the counts and base of every row, and found: array of (term, action, start).

        ``distinct``: without doc_id, a row for each text."""
        told = self.used.join(self.terms, "term").groupBy("high", "low").agg(F.collect_list(F.struct("term", "action", "start")).alias("found"))
        rows = self.rows.drop("contexts")
        if distinct:
            rows = rows.drop("doc_id").dropDuplicates(["high", "low"])
        return rows.join(told, ["high", "low"], "left")


def _digest(base, found):
    taken = [(int(a), int(b)) for _, a, b in (s.split(":") for s in base.split(","))] if base else []
    terms = sorted({(a, a + len(f["term"])) for f in found or [] for a in f["start"]})
    free = [(a, b) for a, b in terms if not any(a < y and x < b for x, y in taken)]
    parts = ([base] if base else []) + [f"term:{a}:{b}" for a, b in free]
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(parts), len(free)


def found(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row of ``docs``.

    ``spans`` lists the base spans by kind and start, then a ``term`` span for every use of a disclosing term
    outside them; offsets are code points. A null text is empty and has none. Rows that share a doc_id
    are treated one by one, a null doc_id stays null. Other columns are not read. An empty table gives an
    empty result.
    """
    digest = F.udf(_digest, "struct<base_sha256:string,spans:string,n_term:bigint>", useArrow=True)
    out = Disclosure(docs, **how).spans()
    return out.withColumn("d", digest("base", "found")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "d.base_sha256", "d.spans", F.col("d.n_term").alias("n_term"))


def cleaned(text: str, spans: str, generalised: set[str] = frozenset()) -> str:
    """``text`` with every span replaced: base kinds by their name, terms by a general word or by nothing.

    Of spans that overlap the first gives the name, and all that they cover goes."""
    edits = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in edits:
        if a < at:
            at = max(at, b)
            continue
        word = f"[{kind}]" if kind != "term" else "[something]" if folded(text[a:b]) in generalised else ""
        out += [text[at:a], word]
        at = b
    return "".join(out) + text[at:]


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])
    for batch in batches:
        for part, data, offsets in tx.chunks(batch):
            high, low = zip(*map(_identity, tx.decoded(data, offsets)))
            yield tx.batch_of(schema, high=high, low=low, doc_id=part.column("doc_id"), text=part.column("text"))


SANITISED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, n_generalised long, n_removed long, text string"
_COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def _sanitised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, whole[t]) for n, t in (c.split() for c in SANITISED.split(", "))])
    for batch in batches:
        for part, data, offsets in tx.chunks(batch):
            told = {n: [] for n in ("base_sha256", "spans", "n_term", "n_generalised", "n_removed", "text")}
            empty = part.column("text").is_null().to_pylist()
            for text, none, base, found in zip(tx.decoded(data, offsets), empty, part.column("base").to_pylist(), part.column("found").to_pylist()):
                sha, spans, n_term = _digest(base, found)
                general = {f["term"] for f in found or [] if f["action"] == "generalise"}
                uses = [s.split(":") for s in spans.split(",") if s.startswith("term:")]
                n_general = sum(folded(text[int(a) : int(b)]) in general for _, a, b in uses)
                for column, value in zip(told.values(), (sha, spans, n_term, n_general, n_term - n_general, None if none else cleaned(text, spans, general))):
                    column.append(value)
            yield tx.batch_of(schema, doc_id=part.column("doc_id"), **{n: part.column(n) for n in _COUNTS}, **told)


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``found``, n_generalised, n_removed and the sanitised text of every row of ``docs``.

    Of the same spans that ``spans`` lists, values become the name of their kind, and a disclosing term becomes
    "[something]" or goes, by its action; the two numbers count its uses. Equal texts share one row of
    spans. A null text stays null; else as ``found``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = Disclosure(docs, **how).spans(distinct=True)
    named = texts.mapInArrow(tx.trimmed(_named), "high long, low long, doc_id long, text string")
    both = named.join(told.hint("merge"), ["high", "low"])
    return both.select("doc_id", "text", *_COUNTS, "base", "found").mapInArrow(tx.trimmed(_sanitised), SANITISED)
