"""Line-first cleaning: lines that break a rule go, and documents that lose too much text go with them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx


@dataclass(frozen=True)
class Rules:
    """What a line must pass and what a document may lose."""

    #: A line of so many words or more must hold one of ``ends``.
    sentence_words: int = 8
    ends: str = ".!?…:;。！？"
    #: More than so many symbols to a word, in a line of three words or more, are not prose.
    symbols: str = "#*$%&|<>{}~^=_\\"
    most_symbols: float = 0.5
    #: So many separators, at most ``item_words`` words to each, make a menu.
    separators: str = "|»›•·"
    menu_items: int = 3
    item_words: int = 3
    #: A line of at most ``notice_words`` words that holds one of these (lower case) is boilerplate.
    notices: tuple[str, ...] = (
        "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "powered by",
        "privacy policy", "read more", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
    )
    notice_words: int = 30
    #: A line of so many letters of which none is lower case, with ``shouts`` or more exclamation marks, shouts.
    shout_letters: int = 10
    shouts: int = 3
    #: Percent of a document's words that may go with its lines.
    most_lost: int = 50


def failing(line: str, words: int, rules: Rules) -> str | None:
    """The rule a line with ``words`` words breaks: punctuation, navigation, boilerplate or shouting."""
    marks = sum(map(line.count, rules.separators))
    if marks >= rules.menu_items and words - marks <= rules.item_words * (marks + 1):
        return "navigation"
    if words <= rules.notice_words:
        low = line.lower()
        if any(n in low for n in rules.notices):
            return "boilerplate"
    if line.count("!") >= rules.shouts and line == line.upper() and sum(map(str.isalpha, line)) >= rules.shout_letters:
        return "shouting"
    if words >= 3 and sum(map(line.count, rules.symbols)) > rules.most_symbols * words:
        return "punctuation"
    if words >= rules.sentence_words and not any(e in line for e in rules.ends):
        return "punctuation"
    return None


SYMBOLS = b"#*$%&|<>"


def counts(data: np.ndarray, offsets: np.ndarray, roll: tx.Roll) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of every text."""
    start, end, bounds = tx.words(data, offsets)
    owner, n = tx.owners(bounds), len(offsets) - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    word = roll.spans(roll.sums(tx.byte_codes(seed=1)[data]), start, end)
    repeated = np.zeros(len(word), dtype=bool)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(word) > 2 else np.zeros(0, dtype=np.int64)
    if len(at):
        key = tx.mix(tx.mix(tx.mix(word[at] + owner[at].astype(np.uint64)) + word[at + 1]) + word[at + 2])
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.bincount(owner, weights=chars[end] - chars[start], minlength=n).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_repeat_words": np.bincount(owner, weights=repeated, minlength=n).astype(np.int64),
    }


_FIELDS = [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lost_words", pa.int64()), ("n_lost_lines", pa.int64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def _rated(rules: Rules, with_text: bool):
    schema = pa.schema(_FIELDS + [("clean_text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = tx.Roll()
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                out = counts(data, offsets, roll)
                dups, lost_words, lost_lines, clean = [], [], [], []
                for text in tx.decoded(data, offsets):
                    seen, dup, gone, lines, left = set(), 0, 0, 0, []
                    for line in text.split("\n"):
                        words = len(line.encode().split())
                        again = bool(words) and line in seen
                        if words:
                            seen.add(line)
                            dup += again
                            if again or failing(line, words, rules):
                                gone += words
                                lines += 1
                                continue
                        left.append(line)
                    dups.append(dup)
                    lost_words.append(gone)
                    lost_lines.append(lines)
                    clean.append("\n".join(left) if with_text else None)
                n_words, repeat, gone = out["n_words"], out["n_repeat_words"], np.array(lost_words)
                failed = (n_words < 50) | (100 * repeat > 50 * n_words)
                out |= {"doc_id": part.column("doc_id"), "n_dup_lines": dups, "base_failed": failed, "kept": ~failed & (100 * gone <= rules.most_lost * n_words), "n_lost_words": gone, "n_lost_lines": lost_lines, "clean_text": clean}
                yield tx.batch_of(schema, **{f.name: out[f.name] for f in schema})

    return run


def rated(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """The columns of SCHEMA (and clean_text) of every row of ``docs`` (doc_id, text).

    Lines are judged first: an equal earlier line in the document, a menu, a notice, shouting, or a
    line of symbols or without any sentence mark removes a line. A document is kept unless it fails the base
    rules (under 50 words, or more than half of them in repeated three-word windows) or loses more than
    ``most_lost`` percent of its words with its lines.

    A null or empty text has no words and fails. Lines without a word are never judged. Rows that share a
    doc_id are rated one by one, a null doc_id stays null. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tx.trimmed(_rated(rules, with_text)), SCHEMA + ", clean_text string" * with_text)
