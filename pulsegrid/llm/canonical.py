"""Freely typed values onto a reference list (problem 3).

The reference entries are the rows of the list: each code, its display text, and every run of words of the display that
belongs to one code alone. A short table adds synonyms and translations of what the entries mean. A typed value is read by
rules that hold for any list: case, accents and punctuation do not count; a word cut short stands for the word of the list
it begins, and so does an initial; a word without its vowels stands for the word it is left of; words that only announce a value (``lead``, ``chest``) are
taken off. What is then left is searched in a BK-tree of the entries under the unrestricted Damerau-Levenshtein distance, a
true metric: a query at distance d from a node need only look at children whose edge lies in [d - r, d + r], so the tree
returns every entry within the threshold. Trees are built per shard of the entries, each small enough to be sent to the
executors; the best answers of the shards are merged. The values searched are the distinct ones, so a hot value costs one search.

Defined results: null and empty values are no cases; a value that is itself a code is none; equally near entries of different
codes go to the one that needs letters added rather than dropped, then to the first in order; where no entry is within the
threshold, but every run of the value's words that is an entry has one code, it is that code; all other values are
``UNMATCHED``, however long, and :func:`match_values` gives the entry that comes nearest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import cut, need, plain_letters
from pulsegrid.llm.metrics import damerau

UNMATCHED = "UNMATCHED"
#: Entries in a shard; the tree of a shard is sent to every executor. Entries of the whole list, beyond which it is an error.
SHARD, MOST_ENTRIES = 20_000, 2_000_000
#: Letters from which a cut-off word is read as what it begins, and from which a run of words may stand alone within a value.
CUT, ALONE = 3, 4

# Synonyms and translations (es, fr, de, pl, ru) of what the codes of sex and race mean.
MEANINGS = {
    "sex": {
        "M": "man, boy, mister, mr, masculine, hombre, masculino, homme, masculin, mann, herr, männlich, mężczyzna, муж, мужской, мужчина",
        "F": "woman, girl, miss, mrs, ms, feminine, mujer, femenino, femme, féminin, frau, weiblich, w, kobieta, жен, женский, женщина",
        "U": "undetermined, not known, not stated, not recorded, desconocido, inconnu, unbekannt, nieznana, неизвестно",
    },
    "race": {
        "ASI": "asiatic, asiático, asiatique, asiatisch, asien, azjata, азиат",
        "BLK": "afro american, negro, noir, schwarz, czarny, чёрный",
        "WHT": "caucasian, european, blanco, blanche, weiß, biały, белый",
        "AIA": "native american, amerindian, first nations",
        "NHP": "polynesian, nhopi",
        "HIS": "latin american, latina, latinx, hispano",
        "MEN": "mena, arab",
        "MUL": "mixed, multiracial, biracial, two or more, 2 races, more than one race, mestizo",
        "OTH": "some other race, otro, autre, andere, inny, другое",
        "UNK": "refused, not asked, not stated, prefers not to say, desconocido, inconnu, unbekannt, nieznana, неизвестно",
    },
}
# Words that announce a lead, by the leads they may stand with.
ANNOUNCING = {
    "": "lead, ecg, ekg, edf, mdc, ableitung, derivación, dérivation, odprowadzenie, отведение",
    "limb": "limb, einthoven", "augmented": "augmented, goldberger", "chest": "chest, precordial, wilson", "axis": "orthogonal, frank, axis",
}
_VOWELS = re.compile(r"(?<=.)[aeiouy]")


def words_of(text: str) -> list[str]:
    """The words of a text, plain and lower-case; digits part from letters only at blanks and marks."""
    return re.findall(r"[^\W_]+", plain_letters(text).casefold())


def squeeze(text: str) -> str:
    """The letters and digits of a text, without case and accents."""
    return "".join(words_of(text))


def lead_entries(codes: list[str]) -> dict[str, str]:
    """Entries of lead names by rule. What follows ``kind:`` counts only where a word of that kind announces it (``any``: any word)."""
    out: dict[str, str] = {}
    roman = {"i": "1", "ii": "2", "iii": "3"}
    for code in codes:
        low = code.lower()
        names = [low]
        if low in roman:
            names += [x + y for x in "dl" for y in (low, roman[low])] + [f"any:{roman[low]}", f"limb:{roman[low]}"]
        elif low.startswith("av"):
            names += [f"augmented:{low[1:]}", f"augmented:{low[2:]}"]
        elif re.fullmatch(r"v\d+r?", low):
            names += ["c" + low[1:], "chest:" + low[1:]]
        elif len(low) == 1:
            names += ["v" + low]
        for name in names:
            out.setdefault(name, code)
    return out


def phrase_entries(rows: list[tuple[str, str]], meanings: dict[str, str]) -> dict[str, str]:
    """Entries of (code, display) rows: codes, displays, runs of words that one display alone has, and what is known of their meaning."""
    owners: dict[str, set[str]] = defaultdict(set)
    for code, display in rows:
        words = words_of(display or code)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                owners["".join(words[a:b])].add(code)
    out: dict[str, str] = {}
    for code, display in rows:
        for whole in (code, display or code):
            out.setdefault(squeeze(whole), code)
    codes = {c for c, _ in rows}
    for code, texts in meanings.items():
        if code in codes:
            for text in texts.split(", "):
                out.setdefault(squeeze(text), code)
    for run, by in owners.items():
        if len(by) == 1 and len(run) >= ALONE:
            out.setdefault(run, next(iter(by)))
    return out


def entries_of(refs: list[tuple[str, str, str]]) -> tuple[dict[str, dict[str, str]], dict[str, list[str]], dict[str, list[list[str]]]]:
    """(field -> entry -> code, field -> words of its entries, field -> runs of words that are entries), from (field_name, code, display) rows."""
    out: dict[str, dict[str, str]] = {}
    vocabulary: dict[str, list[str]] = {}
    phrases: dict[str, list[list[str]]] = {}
    for field in sorted({r[0] for r in refs}):
        rows = [(code, display) for f, code, display in refs if f == field]
        if field == "label":
            known = lead_entries([c for c, _ in rows])
            texts = list(ANNOUNCING.values())
        else:
            known = phrase_entries(rows, MEANINGS.get(field, {}))
            texts = [display or "" for _, display in rows] + list(MEANINGS.get(field, {}).values())
        known.pop("", None)
        out[field] = known
        runs = [words[a:b] for t in texts for part in t.split(", ") for words in [words_of(part)] for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
        phrases[field] = [r for r in runs if "".join(r) in known]
        vocabulary[field] = sorted({w for t in texts for w in words_of(t) if len(w) > CUT}, key=lambda w: (len(w), w))
    return out, vocabulary, phrases


def threshold(length: int) -> int:
    """Edits allowed in a text of so many letters."""
    return 0 if length <= 2 else 1 if length <= 8 else 2


class BKTree:
    """All entries within a radius, by the triangle inequality."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.root: tuple[str, str, dict] | None = None
        for word, code in sorted(entries.items()):
            self._add(word, code)

    def _add(self, word: str, code: str) -> None:
        if self.root is None:
            self.root = (word, code, {})
            return
        node = self.root
        while True:
            d = damerau(word, node[0])
            if d not in node[2]:
                node[2][d] = (word, code, {})
                return
            node = node[2][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str, str]]:
        """(distance, entry, code) of every entry within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, code, children = todo.pop()
            d = damerau(word, entry)
            if d <= radius:
                found.append((d, entry, code))
            todo += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return found


    def nearest(self, word: str) -> tuple[int, str, str] | None:
        """The entry at the least distance, the first in order among equals; subtrees that cannot hold a nearer one are left out."""
        best: tuple[int, str, str] | None = None
        todo = [(0, self.root)] if self.root else []
        while todo:
            least, (entry, code, children) = todo.pop()
            if best is not None and least > best[0]:
                continue
            d = damerau(word, entry)
            best = min(best, (d, entry, code)) if best else (d, entry, code)
            todo += sorted(((abs(d - e), child) for e, child in children.items()), key=lambda x: -x[0])
        return best


def full_words(words: list[str], vocabulary: list[str], known: dict[str, str]) -> list[str]:
    """The words with what is cut short, or left without vowels, in full; a word that is an entry stays."""

    def full(word: str) -> str:
        if len(word) < CUT or word in known or word in vocabulary or word.isdigit():
            return word
        begun = next((v for v in vocabulary if v.startswith(word)), None)
        return begun or next((v for v in vocabulary if _VOWELS.sub("", v) == word), word)

    return [full(w) for w in words]


class Matcher:
    """Searches typed values in one shard of entries."""

    def __init__(self, entries: list[tuple[str, str, str]], vocabulary: dict[str, list[str]], phrases: dict[str, list[list[str]]]) -> None:
        self.known: dict[str, dict[str, str]] = defaultdict(dict)
        for field, entry, code in entries:
            self.known[field][entry] = code
        self.trees = {f: BKTree({e: c for e, c in own.items() if ":" not in e}) for f, own in self.known.items()}
        self.vocabulary, self.phrases = vocabulary, phrases
        self.kinds = {w: kind for kind, words in ANNOUNCING.items() for w in words_of(words)}
        self.announcing = BKTree({w: w for w in self.kinds})

    def _announced(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(kinds of the words that announce a lead, the other words); words of four letters or more may have a slip."""
        kinds, rest = [], []
        for w in words:
            found = self.announcing.within(w, 1 if len(w) >= 4 else 0)
            if found:
                kinds.append(self.kinds[min(found)[1]])
            else:
                rest.append(w)
        return kinds, rest

    def _runs(self, field: str, words: list[str]) -> tuple[str, str] | None:
        """(code, entry) where all runs of the words that are entries have one code, by the longest of them."""
        known = self.known[field]
        held = {r for a in range(len(words)) for b in range(a + 1, len(words) + 1) if len(r := "".join(words[a:b])) >= ALONE and r in known}
        if len({known[r] for r in held}) != 1:
            return None
        run = max(held, key=lambda r: (len(r), r))
        return known[run], run

    def _initials(self, field: str, words: list[str]) -> str | None:
        """The entry whose words the value gives, some of them by their initials alone."""
        if not any(len(w) == 1 for w in words) or not any(len(w) >= ALONE for w in words):
            return None
        fits = {"".join(p) for p in self.phrases.get(field, []) if len(p) == len(words) and all(w == x or (len(w) == 1 and x.startswith(w)) for w, x in zip(words, p, strict=True))}
        own = {self.known[field].get(f) for f in fits}
        return min(fits) if len(own) == 1 and None not in own else None

    def search(self, field: str, raw: str) -> tuple[str | None, tuple | None, int | None, str | None]:
        """(code, rank, distance, entry) of a value; without a code, distance and entry are those of the nearest entry."""
        if field not in self.trees:
            return None, None, None, None
        typed = words_of(raw)
        found = self._search(field, typed)
        short = [re.sub(r"([aou])e", r"\1", w) for w in typed]  # umlauts spelled with two letters
        return found if found[0] or short == typed or not (again := self._search(field, short))[0] else again

    def _search(self, field: str, typed: list[str]) -> tuple[str | None, tuple | None, int | None, str | None]:
        known, tree = self.known[field], self.trees[field]
        words = full_words(typed, self.vocabulary.get(field, []), known)
        if field == "label":
            kinds, rest = self._announced(words)
            word = "".join(rest)
            for kind in [*filter(None, kinds), *(["any"] if kinds else [])]:
                if code := known.get(f"{kind}:{word}"):
                    return code, (0, 0, word, code), 0, word
        else:
            word = "".join(words)
        if not word:
            return None, None, None, None
        if found := tree.within(word, threshold(len(word))):
            best = min(found, key=lambda x: rank(word, x))
            return best[2], rank(word, best), best[0], best[1]
        if field != "label":
            if entry := self._initials(field, words):
                return known[entry], (0, 0, entry, known[entry]), 0, entry
            # runs of the words as typed come before those of words made full
            if hit := self._runs(field, typed) or self._runs(field, words):
                code, run = hit
                return code, (len(word), 0, run, code), max(0, len(word) - len(run)), run
        near = tree.nearest(word)
        return None, None, near[0] if near else None, near[1] if near else None


def rank(word: str, found: tuple[int, str, str]) -> tuple:
    """Nearer first, then entries that add letters to the word, then alphabetically."""
    d, entry, code = found
    return (d, max(0, len(word) - len(entry)), entry, code)


def match_values(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(field_name, raw_value, code, entry, distance) for the distinct typed values (field_name, raw_value).

    ``entry`` is the one that matched or, for ``UNMATCHED``, came nearest, at ``distance``.
    """
    spark = values.sparkSession
    # the canonical list is a table of its own that does not grow with the data; its size is checked
    rows = need(refs, "field_name", "code", "display").where("field_name IS NOT NULL AND code IS NOT NULL").distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} reference entries")
    rows = sorted(((r.field_name, r.code, r.display) for r in rows), key=str)
    own, vocabulary, phrases = entries_of(rows)
    entries = sorted((f, w, c) for f, ws in own.items() for w, c in ws.items())
    codes = {(f, c) for f, c, _ in rows}
    shards = [spark.sparkContext.broadcast((entries[k : k + SHARD], vocabulary, phrases, codes)) for k in range(0, max(1, len(entries)), SHARD)]
    distinct = need(values, "field_name", "raw_value").where("raw_value IS NOT NULL AND raw_value <> ''").distinct()
    schema = "field_name string, raw_value string, code string, ranked array<string>, distance int, entry string"

    def search(shard):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, words, phrases, reserved = shard.value
            matcher = Matcher(held, words, phrases)
            for batch in batches:
                out = []
                for f, raw in zip(batch.field_name, batch.raw_value, strict=True):
                    if (f, raw) not in reserved:
                        code, ranked, distance, entry = matcher.search(f, raw)
                        out.append((f, raw, code, [f"{x:06}" if isinstance(x, int) else x for x in ranked] if ranked else None, distance, entry))
                yield pd.DataFrame(out, columns=["field_name", "raw_value", "code", "ranked", "distance", "entry"])

        return run

    if len(shards) > 1:
        distinct = cut(distinct)
    hits = [distinct.mapInPandas(search(s), schema) for s in shards]
    merged = hits[0]
    for h in hits[1:]:
        merged = merged.unionByName(h)
    if len(hits) > 1:
        # of the shards' answers the best match, or where none matched the nearest entry
        order = F.struct(F.col("code").isNull(), F.col("ranked"), F.coalesce("distance", F.lit(1 << 30)), "entry")
        merged = merged.groupBy("field_name", "raw_value").agg(F.min_by(F.struct("code", "entry", "distance"), order).alias("b")).select("field_name", "raw_value", "b.*")
    return merged.select("field_name", "raw_value", F.coalesce("code", F.lit(UNMATCHED)).alias("code"), "entry", "distance")


def typed_values(records: DataFrame, leads: DataFrame) -> DataFrame:
    """(field_name, raw_value) of lead labels, sexes and races, each distinct value once per table."""
    label = need(leads, "label").distinct().select(F.lit("label").alias("field_name"), F.col("label").alias("raw_value"))
    both = need(records, "patient").select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"patient.{f}").alias("raw_value")) for f in ("sex", "race")])))
    return label.unionByName(both.distinct())
