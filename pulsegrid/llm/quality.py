"""Per-document text statistics, and what a document mostly is (problem 10).

A text falls into blocks: what stands between blank lines. Each block is judged by combined rules on its lines: layout of
cells, list marks, lengths, shares of letters, digits and symbols, repeated lines, and how much of it its commonest
character sequences cover. Repetition over the whole document (:class:`Repetition`: shares of duplicate lines and paragraphs, and the
cover of its dominant sequence of words) separates boilerplate and debris from prose and listings; list marks, short entries
and cells separate lists and tables. Lines and blocks are read to their ends, and no rule depends on their number. Characters are summed over the blocks of a kind; a document is ``list``, ``table`` or ``junk``
where more than half of its characters are.

Defined results: a null text has null statistics and no form; an empty text has zeros; texts are read whole, however long;
a document given twice comes out once; ties between forms cannot occur, since a share above one half is unique.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.common import need

_LIST_MARK = re.compile(r"\s*(?:[-*•◦‣·+–○▪●■□✓✗☐☑]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|\(?[ivxlIVXL]{1,5}[.)]|\[[ xX]?\]|- \[[ xX]\])\s+\S")
_PIPES = re.compile(r"[|│┃║¦]")
_RULE = re.compile(r"[\s|+:=\-─━═┼┬┴├┤┌┐└┘╞╪╡╭╮╰╯│┃║]+$")
_HTML = re.compile(r"</?(?:t[rdh]|table|thead|tbody)\b", re.I)
_COLUMNS = re.compile(r"\S(?:\t|\s{2,})(?=\S)")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{4,16}[:h]?\s+(?:[0-9a-fA-F]{2,8}\s+){3,}")
_HEX_RUN = re.compile(r"(?:\\x[0-9a-fA-F]{2}|[0-9a-fA-F]{2}[\s,:]){8,}|[0-9a-fA-F]{32,}")
_LOG = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|\[?(?:WARN(?:ING)?|INFO|DEBUG|ERROR|TRACE|FATAL|NOTICE|CRITICAL)\b|(?:Epoch|Step|Iter(?:ation)?|Batch|Fold)\b.{0,3}\d+"
    r"|(?:Downloading|Collecting|Installing|Requirement already|Using cached|Building wheel|Fetching|Extracting|Loading)\b)"
)
_PROGRESS = re.compile(r"\d{1,3}(?:\.\d+)?\s?%\s*\||[█▉▊▋▌▍▎▏▓▒░]{2,}|\[[=>#.\-\s]{8,}\]|\d/\d+ \[|\bETA\b|it/s\b|\r")
_CODE = re.compile(
    r"(?:^\s*(?:def|class|for|while|if|elif|else|try|except|finally|with|import|from|return|assert|print|raise|lambda|yield|plt|np|pd|@|#|%|!|//|/\*|\}|\{)\b)|^\s*[#@%!]|[\w\])'\"]\s*(?:=|\+=|-=|\*=|/=|:=)\s*[\w('\"\[{-]|^\s*[}\])]+[;,]?$|:$"
)
_CALL = re.compile(r"\w\(")
_TRACE = re.compile(r"Traceback|^\s*File \"|^-{3,}>|^\s*\w*(?:Error|Exception)\b|^<ipython|^\s*-*> ?\d+ ")
_NUMBER = re.compile(r"[-+]?\d[\d_]*(?:[.,]\d+)?(?:[eE][-+]?\d+)?")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
_SENTENCE_END = re.compile(r"[.!?…:][\"'”’)\]]*\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MARKUP = re.compile(r"\s*(?:```\w*|In ?\[[\d ]*\]:?|Out ?(?:\[[\d ]*\])?:?|# ?%%.*|<!--.*-->|-{3,}|={3,})\s*$")

_PARAGRAPH = re.compile(r"\n[ \t]*\n")

#: A line stands often in a document from so many times on; a sequence of words dominates what it covers more than this share of.
OFTEN, COVER = 5, 0.3
#: Common words up to which their list is sent to the executors; more is an error.
COMMON_BOUND = 100_000

KINDS = ("prose", "code", "list", "table", "junk", "other")


def _common(counts: list[int]) -> tuple[int, float]:
    """The commonest number and its share."""
    (value, n), *_ = Counter(counts).most_common(1)
    return value, n / len(counts)


def _cells_share(lines: list[str]) -> bool:
    """Whether the lines are rows of cells in some layout."""
    n = len(lines)
    rules = sum(1 for x in lines if len(x) >= 3 and _RULE.fullmatch(x))
    body = [x for x in lines if not (len(x) >= 3 and _RULE.fullmatch(x))]
    if not body:
        return rules >= 1 and n >= 2
    html = sum(1 for x in body if _HTML.search(x))
    if html >= 0.6 * len(body):
        return True
    piped = sum(1 for x in body if len(_PIPES.findall(x)) >= 2)
    if piped >= 0.6 * len(body) and piped >= 2:
        return True
    latex = sum(1 for x in body if " & " in x and (x.rstrip().endswith("\\\\") or x.rstrip().endswith("\\hline")))
    if latex >= 0.6 * len(body) and latex >= 1:
        return True
    if len(body) < 2 or rules + len(body) < 3:
        return False
    for mark in "\t;,|:":
        counts = [x.count(mark) for x in body]
        k, share = _common(counts)
        if k >= 1 and share >= 0.8 and len(body) >= 3:
            cells = [c.strip() for x in body for c in x.split(mark)]
            words = sum(len(c.split()) for c in cells) / len(cells)
            longest = sum(1 for c in cells if len(c) > 40) / len(cells)
            if words <= 1.8 and longest < 0.1 and not (mark in ",:" and k == 1 and sum(_CODE.search(x) is not None for x in body) > 0.5 * len(body)):
                if mark == ":" and k == 1:
                    continue  # names and values are a short listing, not rows of cells
                return True
    spaced = [len(_COLUMNS.findall(x)) for x in body]
    k, share = _common(spaced)
    return k >= 1 and share >= 0.6 and sum(c >= 1 for c in spaced) >= 0.8 * len(body) and len(body) >= 3 and not sum(_LIST_MARK.match(x) is not None for x in body) > 0.6 * len(body)


def _encoded(text: str) -> bool:
    """Encoded data, or a dump of numbers or bytes."""
    if "base64," in text:
        return True
    size = len(text)
    squeezed = sum(len(m) for m in _BASE64.findall(text) if not m.isalpha() or len(m) > 60)
    if squeezed >= 0.7 * size and size >= 60:
        return True
    if sum(len(m.group()) for m in _HEX_RUN.finditer(text)) >= 0.6 * size and size >= 40:
        return True
    numbers = sum(len(m) for m in _NUMBER.findall(text))
    letters = sum(c.isalpha() for c in text)
    return size >= 60 and numbers >= 0.55 * size and letters <= 0.12 * size


def _noise(text: str) -> bool:
    """Keyboard noise: words without the shape of words, or many marks of many sorts among the letters."""
    marks = [c for c in text if c in "^~&#*|]{[}()%@!$<>`+=?;"]
    if len(text) >= 30 and len(marks) >= 0.12 * len(text) and len(set(marks)) >= 8:
        return True
    words = _WORD.findall(text)
    if len(words) < 3 and len(text) < 30:
        return False
    letters = [c for c in text.lower() if c.isalpha()]
    if not letters:
        return len(text) >= 10 and sum(not c.isalnum() and not c.isspace() for c in text) > 0.5 * len(text)
    odd = 0
    for w in words:
        low = w.lower()
        vowels = sum(c in "aeiouyàáâäãåæèéêëìíîïòóôöõøùúûüýœаеёиоуыэюяąęó" for c in low)
        run = re.search(r"[bcdfghjklmnpqrstvwxz]{5,}|(.)\1\1", low)
        if len(low) >= 4 and (vowels <= 0.15 * len(low) or run or re.search(r"asdf|sdfg|dfgh|fghj|ghjk|hjkl|qwer|wert|erty|zxcv|xcvb|cvbn|lkjh|poiu|uiop", low)):
            odd += len(w)
    return odd > 0.5 * sum(len(w) for w in words) if words else False


def top_cover(text: str, n: int = 4) -> float:
    """Share of the characters that the commonest sequence of n words covers; where it overlaps itself, each word counts once."""
    words = text.split()
    if len(words) < 2 * n:
        return 0.0
    runs = list(zip(*[words[k:] for k in range(n)], strict=False))
    gram, times = Counter(runs).most_common(1)[0]
    if times < 2:
        return 0.0
    covered, upto = 0, 0
    for k, run in enumerate(runs):
        if run == gram:
            covered += sum(len(w) for w in words[max(k, upto) : k + n])
            upto = k + n
    return covered / sum(map(len, words))


class Repetition:
    """How a document repeats itself: line and paragraph counts, their duplicate shares, and whether one sequence dominates."""

    def __init__(self, text: str) -> None:
        self.lines = Counter(x for line in text.split("\n") if (x := line.strip()))
        self.paragraphs = Counter(x for p in _PARAGRAPH.split(text) if (x := p.strip()))
        n, m = self.lines.total(), self.paragraphs.total()
        self.duplicate_lines = 1 - len(self.lines) / n if n else 0.0
        self.duplicate_paragraphs = 1 - len(self.paragraphs) / m if m else 0.0
        self._text, self._cover = text, None

    @property
    def cover(self) -> float:
        """:func:`top_cover` of the whole text, taken when first asked for."""
        if self._cover is None:
            self._cover = top_cover(self._text)
        return self._cover

    def debris(self, lines: list[str]) -> bool:
        """Whether a block is what the document says over and over.

        That is so where a third of the document's lines or paragraphs are duplicates, one sequence of words dominates it, and
        most of the block's lines stand in it OFTEN times or more.
        """
        if max(self.duplicate_lines, self.duplicate_paragraphs) < 1 / 3:
            return False
        often = sum(1 for x in lines if self.lines[x.strip()] >= OFTEN)
        return 2 * often > len(lines) and self.cover > COVER


def _looks_coded(line: str) -> bool:
    """A line of program text: indented, or with marks of code and no sentence's end."""
    if line.startswith("    "):
        return True
    call = _CALL.search(line)
    return (_CODE.search(line) is not None or (call is not None and line.rfind(")") >= call.end())) and not line.rstrip().endswith((".", "?", ";"))


def _logged(line: str) -> bool:
    """A line of a dump, a log or a progress display."""
    return _HEX.match(line) is not None or _LOG.match(line) is not None or _PROGRESS.search(line) is not None


def block_kind(block: str, repeats: Repetition | None = None) -> str:
    """What a block is: prose, code, list, table, junk or other; ``repeats`` are those of its document.

    The rules that settle most blocks come first; those that read a block several times only meet what is left.
    """
    lines = [x for x in block.split("\n") if x and not x.isspace() and not (len(x) < 40 and _MARKUP.match(x))]
    if not lines:
        return "other"
    n, first = len(lines), lines[0]
    words = sum(x.count(" ") + 1 for x in lines)
    ended = sum(1 for x in lines if _SENTENCE_END.search(x, max(0, len(x) - 8)))
    if ended >= 0.7 * n and words >= 7 * n and "|" not in first and not _LOG.match(first):
        return "prose"
    body = "\n".join(lines)
    trace = _TRACE.search(first) is not None
    logged = sum(map(_logged, lines))
    if (logged >= 0.6 * n and (n >= 2 or len(body) > 60) and not trace) or (len(first) > 150 or logged or "base64," in body) and _encoded(body):
        return "junk"
    if trace:
        return "code"
    coded = sum(map(_looks_coded, lines))
    if coded >= 0.45 * n and (coded >= 0.8 * n and "|" not in first and "\t" not in first.strip() or not _cells_share(lines)):
        return "code"
    if _encoded(body):
        return "junk"
    if _cells_share(lines):
        return "table"
    distinct = len({x.strip() for x in lines})
    if n >= 5 and (distinct <= 0.35 * n or top_cover(body) > COVER):
        return "junk"
    if _noise(body) or (repeats is not None and repeats.debris(lines)):
        return "junk"
    marked = sum(1 for x in lines if _LIST_MARK.match(x))
    if marked >= 0.6 * n and n >= 2 and words <= 14 * n and not (words > 8 * n and ended >= 0.7 * n):
        return "list"
    if n >= 2 and words == n and ended <= 0.3 * n:
        return "list"
    if n >= 4 and words <= 7 * n and ended <= 0.3 * n and max(x.count(" ") for x in lines) < 14:
        return "list"
    return "prose" if words >= 4 else "other"


def kind_sizes(text: str, repeats: Repetition | None = None) -> dict[str, int]:
    """Characters of the text by kind; the blank lines after a block count with it, headings with what they head."""
    sizes = dict.fromkeys(KINDS, 0)
    repeats = Repetition(text) if repeats is None else repeats
    for block in re.split(r"(?<=\n)(?=[ \t]*\n)", text):
        for piece in _split_mixed(block):
            sizes[block_kind(piece, repeats)] += len(piece)
    return sizes


def _split_mixed(block: str) -> list[str]:
    """A block with an exporter's mark between its lines falls into the parts before and after."""
    if "```" not in block and "# %%" not in block and "In [" not in block and "Out" not in block:
        return [block]
    parts, own = [], []
    for line in block.splitlines(keepends=True):
        if _MARKUP.match(line.rstrip("\n")):
            if own:
                parts.append("".join(own))
                own = []
            parts.append(line)
        else:
            own.append(line)
    return [*parts, "".join(own)] if own else parts


def statistics(text: str, common: set[str]) -> dict[str, float]:
    """The statistics of one text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip()]
    size = max(1, len(text))
    repeats = Repetition(text)
    sizes = kind_sizes(text, repeats)
    return {
        "n_chars": len(text), "n_words": len(words), "mean_word_length": sum(map(len, words)) / max(1, len(words)),
        "symbol_ratio": sum(not c.isalnum() and not c.isspace() for c in text) / size, "digit_ratio": sum(c.isdigit() for c in text) / size,
        "ended_lines": sum(1 for x in lines if _SENTENCE_END.search(x)) / max(1, len(lines)),
        "common_words": sum(w.lower() in common for w in words) / max(1, len(words)),
        "duplicate_lines": repeats.duplicate_lines, "duplicate_paragraphs": repeats.duplicate_paragraphs, "top_ngram_cover": repeats.cover, **{f"{k}_share": v / size for k, v in sizes.items()},
    }


MEASURES = [*statistics("", set())]
STAT_SCHEMA = "doc_id long, " + ", ".join(f"{c} {'long' if c in ('n_chars', 'n_words') else 'double'}" for c in MEASURES)


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row of statistics for each document; one narrow pass, the common words being a short fixed list."""
    rows = need(common_words, "word").where("word IS NOT NULL").distinct().limit(COMMON_BOUND + 1).collect()
    if len(rows) > COMMON_BOUND:
        raise ValueError(f"more than {COMMON_BOUND} common words; raise COMMON_BOUND with the memory of the executors")
    common = {r[0].lower() for r in rows}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"doc_id": d, **(statistics(t, common) if t is not None else {})} for d, t in zip(b.doc_id, b.text, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *MEASURES])

    return need(documents, "doc_id", "text").mapInPandas(run, STAT_SCHEMA).dropDuplicates(["doc_id"])


def document_forms(documents: DataFrame) -> DataFrame:
    """(doc_id, form) of the documents that are mostly list, table or junk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b.doc_id, b.text, strict=True):
                if t:
                    sizes = kind_sizes(t)
                    rows += [(d, k) for k in ("list", "table", "junk") if 2 * sizes[k] > len(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "form"])

    return need(documents, "doc_id", "text").where("text IS NOT NULL").mapInPandas(run, "doc_id long, form string").distinct()
