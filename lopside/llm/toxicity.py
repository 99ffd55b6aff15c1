"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx

#: The sample a model is fitted on: labelled documents per class, and the most characters one of them may have.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 3000, 5000, 20_000
#: Words in a window, and the bytes a window must save to be looked at word by word.
WINDOW, SUSPECT = 24, 1
#: What a word needs to enter the toxic dictionary: log likelihood ratio, different words before it, and times the
#: ordinary share.
EVIDENCE, CONTEXTS, RATIO = 20.0, 3, 8
#: Sizes of the dictionaries' content: common words of the ordinary one, bytes that only the toxic one has.
ORDINARY_WORDS, TOXIC_BYTES = 1500, 8192
#: Longer words are taken piece by piece.
PIECE = 256
#: Parts of the sample that calibrate in turn, and kinds of ordinary text told apart by their rates.
FOLDS, KINDS = 5, 8
CACHE = 200_000


def words_of(text: str) -> list[bytes]:
    """The text's words with A-Z as lower case; of words over PIECE bytes the consecutive pieces."""
    words = text.encode().lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


def _compressor(content: bytes, strategy: int):
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        compression_level=6, window_log=15, hash_log=13, chain_log=15, search_log=6, min_match=3, target_length=64,
        strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress


#: What a word can show: so many bytes saved under the parser that takes any match, or under the optimal one.
LEVELS = (("any", 3), ("any", 4), ("any", 5), ("any", 6), ("best", 1), ("best", 6))


def _surprise(count: int, expected: float) -> float:
    """-log10 of the chance of ``count`` or more events where ``expected`` are expected."""
    if not count:
        return 0.0
    if count <= expected:
        return 0.1
    term = count * math.log(expected) - expected - math.lgamma(count + 1)
    total, ratio, k = 1.0, 1.0, count
    while ratio > 1e-9:
        k += 1
        ratio *= expected / k
        total += ratio
    return -(term + math.log(total)) / math.log(10)


@dataclass(frozen=True)
class Model:
    """Both dictionaries' content, how often a word of each kind of ordinary text reaches each level, and the threshold."""

    ordinary: bytes
    toxic: bytes
    rates: tuple[tuple[float, ...], ...] = ((1e-4,) * len(LEVELS),)
    threshold: float = 3.0

    def evidence(self, words: int, found: list[int]) -> float:
        """How unlikely the least likely of the counts is in ordinary text of so many words, in powers of ten.

        The text may be of any of the kinds, each as likely as another: languages differ in how often their ordinary
        words look like a toxic one.
        """
        chance = 1.0
        for level, count in enumerate(found):
            if count:
                tails = (10 ** -_surprise(count, words * kind[level]) if words * kind[level] < count else 1.0 for kind in self.rates)
                chance = min(chance, sum(tails) / len(self.rates))
        return -math.log10(max(chance, 1e-30))

    def counter(self):
        """A function from a text to (words, different ones that reach each of LEVELS, the largest saving of a window).

        The toxic dictionary holds the ordinary one's content too, so a window's two compressed lengths
        differ only by what toxic text explains. Each window of WINDOW words is compressed with both; if
        the toxic one saves SUSPECT bytes or more, its words are compressed one by one, with a parser that
        takes any match and with one that takes the cheapest encoding. What is compressed stands beside
        stretches that both dictionaries hold: the first parser looks for no match in the last bytes of
        its input, and the second finds one in them only if it pays well.
        """
        size = len(self.ordinary)
        plain, toxic = (_compressor(d, zstandard.STRATEGY_BTLAZY2) for d in (self.ordinary, self.toxic))
        strict, strict_toxic = (_compressor(d, zstandard.STRATEGY_BTULTRA) for d in (self.ordinary, self.toxic[size:] + self.ordinary))
        head, tail = self.ordinary[-64:], self.ordinary[-200:-140]
        heads = [head, self.ordinary[-300:-200], self.ordinary[-777:-700] + b" "]
        known: dict[bytes, tuple[int, ...]] = {}

        def saved(window: bytes) -> int:
            window = head + window + b" " + tail
            return len(plain(window)) - len(toxic(window))

        def reached(word: bytes) -> tuple[int, ...]:
            got = known.get(word)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                saving = {"any": saved(word), "best": sum(len(strict(h + word + b" ")) - len(strict_toxic(h + word + b" ")) for h in heads)}
                got = known[word] = tuple(k for k, (kind, least) in enumerate(LEVELS) if saving[kind] >= least)
            return got

        def count(text: str) -> tuple[int, list[int], int]:
            words, suspects, most = words_of(text), set(), 0
            for k in range(0, len(words), WINDOW):
                part = words[k : k + WINDOW]
                gain = saved(b" ".join(part))
                most = max(most, gain)
                if gain >= SUSPECT:
                    suspects.update(part)
            found = Counter(level for word in suspects for level in reached(word))
            return len(words), [found[k] for k in range(len(LEVELS))], most

        return count

    def scorer(self):
        """A function from a text to (evidence, score).

        Long documents need more for the same evidence. Among equal evidence the windows' saving decides.
        """
        count = self.counter()

        def score(text: str) -> tuple[float, float]:
            words, found, most = count(text)
            best = self.evidence(words, found)
            value = best + 0.01 * min(max(most, 0), 10)
            return best, 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * (value - self.threshold)))))

        return score


def _contexts(texts: list[str]) -> Counter:
    """How many different words each word comes after."""
    number: dict[bytes, int] = {}
    pairs = [np.zeros(0, dtype=np.int64)]
    for text in texts:
        at = np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.int64)
        pairs.append(np.unique((np.concatenate([[0], at[:-1] + 1])[: len(at)] << 32) | at))
    counts = np.bincount(np.unique(np.concatenate(pairs)) & 0xFFFFFFFF, minlength=len(number))
    return Counter(dict(zip(number, counts.tolist())))


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """Twice the log likelihood ratio of a in n against b in m, 0 unless the first share is larger."""
    if a * m <= b * n:
        return 0.0
    part = lambda k, total, p: (k * math.log(p) if k else 0.0) + ((total - k) * math.log1p(-p) if total > k and p < 1 else 0.0)
    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m if b else 0.0) - part(a, n, p) - part(b, m, p))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    """Both dictionaries, with the threshold not yet calibrated.

    Most words of a toxic document are ordinary, so the built-in trainer, which takes what is frequent,
    finds no difference (see README); the toxic dictionary therefore gets the words that toxic documents use
    after more different words than chance allows. Counting contexts instead of uses keeps the words of
    copied passages out.
    """
    of_toxic, of_ordinary = _contexts(toxic), _contexts(ordinary)
    n, m = max(1, sum(of_toxic.values())), max(1, sum(of_ordinary.values()))
    value = {w: _evidence(c, n, of_ordinary[w], m) for w, c in of_toxic.items() if c >= CONTEXTS and c * m >= RATIO * of_ordinary[w] * n}
    chosen = sorted((w for w, v in value.items() if v >= EVIDENCE), key=lambda w: (value[w], w))
    uses = Counter(w for t in ordinary for w in words_of(t))
    common = sorted(uses, key=lambda w: (-uses[w], w))[:ORDINARY_WORDS][::-1]
    plain = b"".join(b" " + w for w in common) + b" "
    own, room = [], TOXIC_BYTES
    for w in reversed(chosen):
        if len(w) + 1 <= room:
            own.append(w)
            room -= len(w) + 1
    return Model(plain, plain + b" ".join(reversed(own)) + b" " if own else plain)


def kinds_of(seen: list[tuple[int, list[int], int]]) -> tuple[tuple[float, ...], ...]:
    """Rates per level of KINDS groups of ordinary texts of about equally many words, by their rate at the first level."""
    seen = sorted(seen, key=lambda s: (s[1][0] + 0.2) / (s[0] + 200))
    ends = np.cumsum([n for n, _, _ in seen])
    cuts = np.searchsorted(ends, np.arange(1, KINDS) * (ends[-1] / KINDS)) + 1 if len(seen) else []
    groups = [g for g in np.split(np.array(seen, dtype=object), cuts) if len(g)]
    return tuple(tuple((0.5 + sum(f[k] for _, f, _ in g)) / (1 + sum(n for n, _, _ in g)) for k in range(len(LEVELS))) for g in groups)


def fit(toxic: list[str], ordinary: list[str], toxic_share: float = 0.1) -> Model:
    """Train both dictionaries on all sampled texts.

    Each part of the texts in turn is counted with dictionaries trained on the others. That gives the rates at which
    ordinary words reach each level and the threshold that errs least, had toxic texts the given share (of equals, the
    middle).
    """
    seen, found = [], []
    for k in range(FOLDS):
        rest = [[t for i, t in enumerate(texts) if i % FOLDS != k] for texts in (toxic, ordinary)]
        count = dictionaries(*rest).counter()
        seen += map(count, ordinary[k::FOLDS])
        found += map(count, toxic[k::FOLDS])
    trained = dictionaries(toxic, ordinary)
    model = Model(trained.ordinary, trained.toxic, kinds_of(seen) or Model.rates)
    misses, hits = (sorted(model.evidence(n, f) for n, f, _ in part) for part in (seen, found))
    lost = lambda cut: np.searchsorted(hits, cut) / max(1, len(hits))
    false = lambda cut: 1 - np.searchsorted(misses, cut) / max(1, len(misses))
    errors = {cut: round(toxic_share * lost(cut) + (1 - toxic_share) * false(cut), 9) for cut in np.arange(0.5, 8.0, 0.05)}
    least = [c for c, e in errors.items() if e == min(errors.values())] if hits and misses else [3.0]
    return replace(model, threshold=float(least[len(least) // 2]))


def fold(doc_id):
    return F.crc32(F.col(doc_id).cast("long").cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows whose fold is not 0.

    The sample takes per class the documents of smallest hashed id among those of at most ``sample_chars``
    characters, ``toxic_sample`` and ``ordinary_sample`` of them; it is what reaches the driver. Rows without id or label are not used, a document
    with both labels counts as toxic.
    """
    told = labels.filter("doc_id is not null and toxic is not null").filter(fold("doc_id") != 0)
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sized = docs.filter(F.length("text") <= sample_chars).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = told.join(sized, "doc_id", "left_semi")
    counted = dict(known.groupBy("toxic").count().collect())
    ids = []
    for label, most in ((1, toxic_sample), (0, ordinary_sample)):
        ids += known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    texts = docs.filter(F.length("text") <= sample_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not ids:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, toxic int")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").collect()
    rows = sorted({(r[0], r[1], r[2]) for r in rows})
    share = counted.get(1, 0) / max(1, sum(counted.values()))
    return fit([t for _, y, t in rows if y], [t for _, y, t in rows if not y], share)


def _scored(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                found = [score(t) for t in tx.decoded(data, offsets)]
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), score=[s for _, s in found], evidence=[e for e, _ in found])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of ``docs`` (doc_id, text), scored by its text alone.

    A null or empty text scores low. held_out says that the id's fold is 0; a null doc_id is not held out.
    Rows that share a doc_id are scored one by one. Other columns are not read. An empty table gives an
    empty result; a model fitted on no rows calls everything ordinary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(tx.trimmed(_scored(model)), "doc_id long, score double, evidence double")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                kept = np.array([score(t)[1] < 0.5 for t in tx.decoded(data, offsets)], dtype=bool)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(tx.trimmed(run), docs.schema)
