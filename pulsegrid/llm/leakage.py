"""Evaluation texts inside training text (problem 8).

Prompts and answers become sequences of words (runs of letters or digits, case ignored). Every run of SEED words of them is
a pattern of one Aho-Corasick automaton, which reads the normalised words of each document once. In a passage of 20 words
with at most one word in eight changed, dropped or added, some SEED words in a row are untouched, so no passage escapes.
Only where seeds hit are words aligned: an exact local alignment of the item with the document around its seeds decides, and
gives the first and last word of the passage, which are mapped back to characters of the original text.

A document's words are those of its cells; the exporter's markup between cells is left out, so a passage may go across it.

Defined results: null and empty texts hold nothing; without cells the whole text counts; items under 20 words can not be
held; texts are read whole, however long; repeated items and documents count once; columns with other names are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import need

#: Words of a passage, and of a seed. Of 20 words with 2 changes 18 are left in 3 runs, the longest of 6 at least; 5 leaves room.
PASSAGE, SEED = 20, 5
#: Of the words of a passage one in CHANGED may be changed, dropped or added.
CHANGED = 7
#: Words before or after a seed that a shortest passage around it may reach, changes included.
REACH = PASSAGE + 6
#: Words of all items up to which one automaton is sent to the executors (about 200 bytes a word), and automata beyond which it is an error.
ITEM_WORDS, MOST_AUTOMATA = 2_000_000, 100

_WORD = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def build_automaton(items: list[tuple[int, str | None, str | None]]):  # noqa: ANN201
    """(automaton, parts): patterns are runs of SEED words between blanks, values the (part, position) where each stands."""
    import ahocorasick

    parts: list[tuple[int, list[str]]] = []
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item_id, prompt, answer in items:
        for words in {tuple(item_words(t)) for t in (prompt, answer)}:
            if len(words) >= PASSAGE:
                for k in range(len(words) - SEED + 1):
                    where[" " + " ".join(words[k : k + SEED]) + " "].append((len(parts), k))
                parts.append((item_id, list(words)))
    automaton = ahocorasick.Automaton()
    for pattern, at in where.items():
        automaton.add_word(pattern, at)
    if where:
        automaton.make_automaton()
    return (automaton if where else None), parts


def document_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans in one line, a blank before and after each."""
    pieces = [text[a:b] for a, b in spans] if spans else [text]
    return " " + re.sub(r"[\W_]+", " ", "\n".join(pieces).lower()).strip() + " "


def passage_in(item: list[str], doc: list[str]) -> tuple[int, int] | None:
    """The longest stretch of the document, as its first and last word, that holds PASSAGE words of the item or more with at most one in CHANGED changed.

    For each number of changes c, an alignment keeps the most words of the item that a stretch ending at a pair of words
    covers with c changes, and where that stretch begins; it begins and ends with an equal word. A longer stretch with so few
    changes always has a part of about PASSAGE words with as few, so c need not go beyond that of PASSAGE words by more than one.
    """
    ids = {w: k for k, w in enumerate(set(item))}
    words = np.array([ids.get(w, -1) for w in doc])
    most, m = PASSAGE // CHANGED + 1, len(words)
    need_words = np.maximum(PASSAGE, np.arange(most + 1) * CHANGED)
    # one number holds how many words of the item a stretch covers and, below them, where it begins: more words come first, then the later beginning
    shift = m + 1
    begins = np.arange(m)
    prev = np.zeros((most + 1, m + 1), np.int64)
    best: tuple[int, int, int] | None = None
    for x in (ids[w] for w in item):
        equal = words == x
        cur = np.zeros_like(prev)
        cur[:, 1:] = np.where(equal, np.where(prev[:, :-1] > 0, prev[:, :-1] + shift, shift + begins), 0)
        for c in range(1, most + 1):
            swapped, dropped, added = prev[c - 1, :-1], prev[c - 1, 1:], cur[c - 1, :-1]
            changed = np.maximum(np.where(swapped > 0, swapped + shift, 0), np.where(dropped > 0, dropped + shift, 0))
            cur[c, 1:] = np.maximum(cur[c, 1:], np.maximum(changed, added))
        if equal.any():
            ends = np.where(equal, cur[:, 1:], 0)
            enough = ends // shift >= need_words[:, None]
            if enough.any():
                c, at = np.unravel_index(np.argmax(np.where(enough, ends, 0)), ends.shape)
                found = (int(ends[c, at] // shift), int(ends[c, at] % shift), int(at))
                best = max(best, found) if best else found
        prev = cur
    return best[1:] if best else None


def held_passages(line: str, automaton, parts: list[tuple[int, list[str]]]) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(item, first word, last word) of the passages the document holds, one for each stretch and part of an item."""
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for end, at in automaton.iter(line):
        for part, k in at:
            seeds[part].append((end, k))
    if not seeds:
        return []
    blanks = [i for i, c in enumerate(line) if c == " "]
    number = {p: k for k, p in enumerate(blanks)}  # the blank at the end of word k - 1 has number k
    words = line.split()
    found = []
    for part, hits in seeds.items():
        item_id, item = parts[part]
        # seeds near one diagonal belong to one passage; each group is aligned once
        spots = sorted((number[end] - SEED, k) for end, k in hits)
        groups: list[list[tuple[int, int]]] = []
        for p, k in spots:
            if groups and p - k <= max(q - j for q, j in groups[-1][-8:]) + len(item) and p <= groups[-1][-1][0] + len(item):
                groups[-1].append((p, k))
            else:
                groups.append([(p, k)])
        for group in groups:
            # PASSAGE words with so few changes keep more than one seed; what is a passage lies within REACH of its seeds
            if len({k for _, k in group}) < 2:
                continue
            ks = [k for _, k in group]
            part_item = item[max(0, min(ks) - REACH) : max(ks) + SEED + REACH]
            start = max(0, group[0][0] - REACH)
            window = words[start : group[-1][0] + SEED + REACH]
            shared = sum((Counter(part_item) & Counter(window)).values())
            if shared >= PASSAGE - PASSAGE // CHANGED - 1 and (span := passage_in(part_item, window)):
                found.append((item_id, start + span[0], start + span[1]))
    return found


def word_places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and past-the-last character, in the text, of each word of :func:`document_words`."""
    places = []
    for a, b in spans or [(0, len(text))]:
        for m in _WORD.finditer(text[a:b]):
            # lower-casing a letter may make a letter and a mark of it, which parts a word in two
            places += [(a + m.start(), a + m.end())] * len(_WORD.findall(m.group().lower()))
    return places


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_char, end_char), distinct: the passages of items in documents; characters 0-based, the end exclusive."""
    spark = documents.sparkSession
    rows = [(r.item_id, r.prompt, r.answer) for r in need(items, "item_id", "prompt", "answer").distinct().toLocalIterator()]
    total = sum(len(item_words(p)) + len(item_words(a)) for _, p, a in rows)
    # held-out items are a fixed set; beyond the bound they are scanned in several automata, one pass of the corpus each
    blocks, size = [[]], 0
    for r in rows:
        n = len(item_words(r[1])) + len(item_words(r[2]))
        if size + n > ITEM_WORDS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += n
    if len(blocks) > MOST_AUTOMATA:
        raise ValueError(f"more than {MOST_AUTOMATA * ITEM_WORDS} words of items; raise ITEM_WORDS with the memory of the executors")
    cells = "cells" in documents.columns
    docs = need(documents, "doc_id", "text", *(["cells"] if cells else [])).where("text IS NOT NULL")
    spans = F.transform(F.filter("cells", lambda c: c["start_char"].isNotNull() & c["end_char"].isNotNull()), lambda c: F.struct(c["start_char"], c["end_char"])) if cells else F.lit(None).cast("array<struct<start_char:int,end_char:int>>")
    docs = docs.select("doc_id", "text", F.to_json(spans).alias("spans") if cells else F.lit(None).cast("string").alias("spans"))

    def scan(block):  # noqa: ANN001, ANN202
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            automaton, parts = build_automaton(shared.value)
            for b in batches:
                out = []
                for doc, text, spans in zip(b.doc_id, b.text, b.spans, strict=True):
                    if automaton is not None and text:
                        own = sorted((s["start_char"], s["end_char"]) for s in json.loads(spans)) if spans else []
                        if held := held_passages(document_words(text, own), automaton, parts):
                            at = word_places(text, own)
                            out += [(doc, i, at[a][0], at[b][1]) for i, a, b in held]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start_char", "end_char"])

        return docs.mapInPandas(run, "doc_id long, item_id long, start_char long, end_char long")

    found = scan(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(scan(block))
    return found.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of all documents that hold a passage of an item; distinct."""
    return leaked_passages(documents, items).select("doc_id", "item_id").distinct()
