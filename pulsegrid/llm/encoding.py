"""Text spoilt by a wrong decoding (problem 5).

A smoothed character n-gram model is trained on clean text: words of fields in which no chain of a wrong and a right
decoding reads as valid UTF-8. Every chain is then tried on every word that has characters outside ASCII: the gain of a
chain is the log-likelihood of the word it gives less that of the word as stored. Within a field the chain with the
largest sum of accepted gains wins; a word is changed only where its gain exceeds a margin, which is validated on all clean
words with characters outside ASCII and on the same words spoilt on purpose, each under the model without that word. Letters
that a decoding replaced by question marks are found by the same model: a word is taken to have lost letters where the
likeliest letters in place of its marks gain beyond the margin over the word without them, as a mark that only ends a question
does not.

Counts and margin cover all rows; only the sums of the counts, as many as there are character sequences in the languages of
the data, and the mistakes at each margin come to the driver, and a check on the number of sequences stands before that.

Defined results: null, empty and ASCII text without ``?`` is no case; replacement characters, ``?`` in a name, runs of ``?``
and those the model takes for letters mean that letters are lost (-1); text of any length is read whole; repeated rows count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import Memo, cut, need

FIELDS = ("first_name", "last_name", "clinical_history")
# Decodings by which UTF-8 is misread, and pairs of one-byte encodings taken for each other (wrong, right).
MISREAD_UTF8 = ["cp1252", "mac_roman", "cp1251", "cp437", "cp1250", "koi8-r", "cp850", "cp866", "iso8859-2", "iso8859-15"]
MISREAD_BYTES = [
    ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "iso8859-2"), ("cp1252", "cp1250"), ("cp1251", "cp1252"), ("cp437", "cp1252"),
    ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp866"), ("cp1252", "iso8859-5"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1250", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"),
]
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[((w, "utf-8"),) for w in MISREAD_UTF8],
    *[((w, "utf-8"), (w, "utf-8")) for w in MISREAD_UTF8[:4]],
    *[((w, r),) for w, r in MISREAD_BYTES],
]
#: Character sequences the model may have; a language has some thousands.
MODEL_BOUND = 2_000_000
#: Margins that are tried, and the one taken where the words speak for none.
MARGINS = [x / 4 for x in range(2, 41)]
USUAL_MARGIN = 3.0


@Memo
def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters and their bytes; bytes the encoding leaves undefined stand for themselves, as many decoders do."""
    out = {chr(b): b for b in range(256)} if encoding in ("cp1252", "latin-1") else {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@Memo
def _chars_of(encoding: str) -> list[str]:
    return [bytes([b]).decode(encoding, "replace").replace("�", chr(b)) for b in range(256)]


def undo(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word with the chain of (wrong, right) decodings undone; None where it does not apply."""
    for wrong, right in chain:
        table = _bytes_of(wrong)
        try:
            raw = bytes([table[c] for c in word])
        except KeyError:
            return None
        if right == "utf-8":
            try:
                word = raw.decode("utf-8")
            except UnicodeDecodeError:
                return None
        else:
            chars = _chars_of(right)
            word = "".join(chars[b] for b in raw)
    return word


@Memo
def _misread(word: str) -> bool:
    """Whether the word reads as UTF-8 under one of the commonest misreadings."""
    return any(undo(word, ((m, "utf-8"),)) not in (None, word) for m in MISREAD_UTF8[:4])


def looks_clean(text: str) -> bool:
    """No word reads as UTF-8 under any misreading, nothing is lost, and there are no control characters."""
    if "�" in text or "?" in text or any("\x7f" <= c < "\xa0" for c in text):
        return False
    return not any(_misread(w) for w in text.split(" ") if not w.isascii())


def grams(word: str) -> Iterator[str]:
    """Sequences of one to three characters, each ending at one character of the word or at its end."""
    w = "\x02\x02" + word.lower() + "\x03"
    for k in range(2, len(w)):
        yield w[k]
        yield w[k - 1 : k + 1]
        yield w[k - 2 : k + 1]


class CharModel:
    """Interpolated trigrams with absolute discounts, down to a uniform share for characters never seen."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.n = counts
        self.after: Counter = Counter()
        self.kinds: Counter = Counter()
        for g, n in counts.items():
            self.after[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self._cache: dict[str, float] = {}
        self.gained: dict[str, dict[int, tuple[float, str]]] = {}
        alone = {g: n for g, n in counts.items() if len(g) == 1 and n > 0}
        total = sum(alone.values()) or 1.0
        self.letters = sorted(g for g in alone if g.isalpha() and not g.isascii())
        #: What a character costs a word by the frequency of characters alone.
        self.usual = -sum(n / total * math.log(n / total) for n in alone.values())

    def _p(self, g: str) -> float:
        back = self._p(g[1:]) if len(g) > 1 else 1e-6
        total = self.after.get(g[:-1], 0)
        if not total:
            return back
        kinds = self.kinds[g[:-1]]
        return (max(self.n.get(g, 0) - 0.75, 0) + 0.75 * kinds * back) / total

    def score(self, word: str) -> float:
        """Log-likelihood of the word."""
        if (s := self._cache.get(word)) is None:
            w = "\x02\x02" + word.lower() + "\x03"
            s = sum(math.log(self._p(w[k - 2 : k + 1])) for k in range(2, len(w)))
            if len(self._cache) < 200_000:
                self._cache[word] = s
        return s


def weight(n: int) -> float:
    """What a word met n times counts in the model: by the logarithm, so that a spelling met once or twice does not vouch for itself."""
    return 0.2 + max(0.0, math.log2(n + 1) - 1)


class Without(CharModel):
    """The model as it would be had it never met one of its words."""

    def __init__(self, model: CharModel) -> None:
        self.n, self.after, self.kinds = model.n, model.after, model.kinds
        self.leave("", 0)

    def leave(self, word: str, n: int) -> None:
        """Leave out a word that was met n times, and no other."""
        self.own: Counter = Counter()
        for g in grams(word) if n else ():
            self.own[g] += weight(n)
        self.own_after: Counter = Counter()
        self.own_kinds: Counter = Counter()
        for g, x in self.own.items():
            self.own_after[g[:-1]] += x
            self.own_kinds[g[:-1]] += self.n[g] - x < weight(1) / 2  # no other word has it
        self._cache, self.gained = {}, {}

    def _p(self, g: str) -> float:
        back = self._p(g[1:]) if len(g) > 1 else 1e-6
        kinds = self.kinds.get(g[:-1], 0) - self.own_kinds.get(g[:-1], 0)
        if not kinds:
            return back
        total = self.after[g[:-1]] - self.own_after.get(g[:-1], 0)
        return (max(self.n.get(g, 0) - self.own.get(g, 0) - 0.75, 0) + 0.75 * kinds * back) / total


def gains(word: str, model: CharModel) -> dict[int, tuple[float, str]]:
    """chain number -> (gain, restored word) of the chains that apply and change the word; kept with the model, as words recur."""
    if (kept := model.gained.get(word)) is not None:
        return kept
    out, base = {}, None
    for k, chain in enumerate(CHAINS):
        new = undo(word, chain)
        if new is None or new == word or any("\x7f" <= c < "\xa0" or c < " " for c in new):
            continue
        base = model.score(word) if base is None else base
        out[k] = (model.score(new) - base, new)
    if len(model.gained) < 200_000:
        model.gained[word] = out
    return out


def loss_gain(word: str, model: CharModel) -> float:
    """By how much the likeliest letters in place of the question marks of a word beat the word without them."""
    filled = word
    while (at := filled.find("?")) >= 0:
        filled = max((filled[:at] + c + filled[at + 1 :] for c in model.letters), key=lambda w: (model.score(w.replace("?", "")), w), default=filled.replace("?", "", 1))
    bare = word.replace("?", "")
    # the marks' own letters cost a share each of the likelihood, which any letter would
    return model.score(filled) - model.score(bare) + model.usual * (len(filled) - len(bare)) if bare else math.inf


def lost(text: str, name: bool, model: CharModel, margin: float) -> bool:
    """Letters were replaced, by U+FFFD or by question marks that are none."""
    if "\ufffd" in text or "??" in text:
        return True
    if "?" not in text:
        return False
    if name:
        return True
    for w in text.split(" "):
        if "?" not in w:
            continue
        core = w.rstrip("\"'”’)]")
        if w.lstrip("\"'“‘([").startswith("?"):
            return True  # no question begins with its mark
        # a mark within a word is a letter unless the model knows better, one at its end only where the model says so
        if loss_gain(w, model) > (margin if core.endswith("?") and core.count("?") == 1 else 0):
            return True
    return False


def restore(text: str, model: CharModel, margin: float) -> str:
    """The field with its likeliest chain undone word by word; unchanged where no chain gains beyond the margin."""
    words = text.split(" ")
    odd = {w: gains(w, model) for w in set(words) if not w.isascii()}
    total: Counter = Counter()
    for w in words:
        for k, (g, _) in odd.get(w, {}).items():
            if g > margin:
                total[k] += g
    if not total:
        return text
    best = max(total, key=lambda k: (total[k], -k))
    change = {w: new for w, by in odd.items() for k, (g, new) in by.items() if k == best and g > margin}
    # words too short to gain the margin follow where the chain was accepted for others of the field
    change |= {w: by[best][1] for w, by in odd.items() if best in by and w not in change and by[best][0] > 0}
    return " ".join(change.get(w, w) for w in words)


def trials(word: str, model: CharModel) -> tuple[float, list[float]]:
    """The largest gain of a chain over a clean word, and what it gains over its forms spoilt by the commonest misreadings."""
    spoilt = ["".join(_chars_of(wrong)[b] for b in word.encode("utf-8")) for wrong in MISREAD_UTF8[:4]]
    return max((g for g, _ in gains(word, model).values()), default=-1.0), [model.score(word) - model.score(w) for w in spoilt]


def validated_margin(words: DataFrame, counts: dict[str, float]) -> float:
    """The margin with the fewest mistakes on clean words left alone and on their spoilt forms restored.

    All of (word, n) with characters outside ASCII are tried, each under the model without it, by the tasks; their counts of mistakes alone are collected.
    """
    context = words.sparkSession.sparkContext
    shared = context.broadcast(counts)  # bounded by MODEL_BOUND

    def mistakes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Without(CharModel(shared.value))
        for b in batches:
            good, bad = [], []
            for w, n in zip(b.word, b.n, strict=True):
                model.leave(w, n)
                alone, restored = trials(w, model)
                good.append(alone)
                bad += restored
            yield pd.DataFrame({"margin": MARGINS, "mistakes": [sum(g > m for g in good) + sum(g <= m for g in bad) for m in MARGINS]})

    # words are few bytes and much work, so their number of tasks is not left to their size
    odd = words.where(F.col("word").rlike(r"[^\x00-\x7f]")).repartition(context.defaultParallelism)
    made = {r.margin: r.mistakes for r in odd.mapInPandas(mistakes, "margin double, mistakes long").groupBy("margin").agg(F.sum("mistakes").alias("mistakes")).collect()}
    shared.destroy()
    return min(MARGINS, key=lambda m: (made.get(m, 0), abs(m - USUAL_MARGIN)))


def field_texts(records: DataFrame) -> DataFrame:
    """(record_id, field_name, text), distinct and not empty."""
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"patient.{f}").alias("text")) for f in FIELDS])
    return need(records, "record_id", "patient").select("record_id", F.inline(fields)).where("text IS NOT NULL AND text <> ''").distinct()


#: A word is a spoilt form of another that a chain makes of it if that one is so many times as common.
COMMONER = 4


def _without_spoilt(words: DataFrame) -> DataFrame:
    """(word, n) without the words of which a chain makes far commoner ones, so that no spelling vouches for itself by recurring."""

    def undone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, new) for w, n in zip(b.word, b.n, strict=True) for new in {undo(w, c) for c in CHAINS} - {None, w}]
            yield pd.DataFrame(rows, columns=["word", "n", "new"])

    odd = words.where(F.col("word").rlike(r"[^\x00-\x7f]")).mapInPandas(undone, "word string, n long, new string")
    spoilt = odd.join(words.select(F.col("word").alias("new"), F.col("n").alias("n_new")), "new").where(F.col("n_new") >= COMMONER * F.col("n")).select("word").distinct()
    return words.join(spoilt, "word", "left_anti")


def train(texts: DataFrame) -> tuple[CharModel, float]:
    """The model of clean text and its margin, from all rows of (record_id, field_name, text)."""

    def clean_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for t in b.text:
                if looks_clean(t):
                    n.update(t.split(" "))
            yield pd.DataFrame(n.items(), columns=["word", "n"])

    words = cut(texts.select("text").mapInPandas(clean_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    words = cut(_without_spoilt(words))

    def word_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for w, k in zip(b.word, b.n, strict=True):
                for g in grams(w):
                    n[g] += weight(k)
            yield pd.DataFrame({"g": list(n), "n": list(n.values())})

    counts = cut(words.mapInPandas(word_grams, "g string, n double").groupBy("g").agg(F.sum("n").alias("n")))
    if counts.count() > MODEL_BOUND:
        raise ValueError(f"more than {MODEL_BOUND} character sequences; raise MODEL_BOUND with the memory of the executors")
    sums = {r.g: r.n for r in counts.toLocalIterator()}
    return CharModel(sums), validated_margin(words, sums)


def spoilt_fields(records: DataFrame) -> DataFrame:
    """(record_id, field_name, restored_crc32) of the fields spoilt by encoding."""
    texts = field_texts(records)
    model, margin = train(texts)
    shared = records.sparkSession.sparkContext.broadcast((model.n, margin))  # bounded by MODEL_BOUND
    odd = texts.where(F.col("text").rlike(r"[^\x00-\x7f]|\?"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, least = shared.value
        own = CharModel(counts)
        for b in batches:
            rows = []
            for r, f, t in zip(b.record_id, b.field_name, b.text, strict=True):
                if lost(t, f != "clinical_history", own, least):
                    rows.append((r, f, -1))
                elif (new := restore(t, own, least)) != t:
                    rows.append((r, f, zlib.crc32(new.encode("utf-8"))))
            yield pd.DataFrame(rows, columns=["record_id", "field_name", "restored_crc32"])

    return odd.mapInPandas(run, "record_id string, field_name string, restored_crc32 long").distinct()
