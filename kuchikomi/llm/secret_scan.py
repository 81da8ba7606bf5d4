"""Secret scans: fixed patterns, and values in the context of a credential judged by what it takes to guess them.

A value's guess cost is the least sum, over all ways to cut it into parts, of the decimal logarithms of the guesses each part
takes: a word of the ranked list (with capitals and look-alike digits), a date or year, a repeat of a short unit, a walk over
the keyboard or along the alphabet, or characters tried one by one. Dynamic programming over the value's positions finds it.
A value behind a word like "password" and a colon or equals sign, whatever characters it has, is a secret if it takes
10^10 guesses or more.

Words are ranked by their number in all documents, counted in Spark; the ``MOST_WORDS`` most frequent are the guesser's
dictionary, a list of that size by definition, and travel by broadcast. The scan is one pass without a shuffle: ``pyarrow``
finds the texts in which anything can match at all, and only those are searched in Python.

Edge cases: null and empty texts have no spans; texts of any length are searched whole and values of any length are cut
whole, in time linear in both; offsets are code points; rows that repeat an id, null ids and equal texts are scanned each on
its own; only ``doc_id`` and ``text`` are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuchikomi.llm.rows import frames, stored, texts
from kuchikomi.llm.vocabulary import Memory

KINDS = ("assign", "access", "hex", "guess")
FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS)
#: Runs of the alphabet are found whole, so asking for their length in the pattern drops the same ones as asking afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: What announces a credential, what stands between, and a value up to a blank, a quote, a bracket or a separator.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|login|bearer|(?:api|access|private|signing)[\x20_-]?key)"""
    r"""["']?(?:\x20*(?::=|=>|[:=])\x20*|(?<=bearer)\x20+)["'`]?([^\s"'`,;<>()\[\]{}|]{6,})""",
    FLAGS,
)
#: One of these is in every text that any pattern above can match.
ANY = r"(?i:pass|pwd|secret|token|credential|auth|login|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key|signing[ _-]?key)|AKIA|[0-9a-f]{24}"

# Fixed values of the guesser.
MOST_WORDS = 20_000
LEAST_COST = 10.0
SHORTEST, LONGEST = 3, 24
COMMON = "password passwd 123456 qwerty admin welcome letmein login secret master dragon monkey changeme default root test guest".split()
LOOK_ALIKE = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"}
OTHER_LOOK_ALIKE = LOOK_ALIKE | {"1": "l", "!": "l"}
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
DEGREE = 4.6
LONGEST_UNIT = 8
YEAR, CLOSE_YEARS, DAYS, SEPARATED = 2025, 20, 365, 4
DATE = re.compile(r"(?=((\d{4})([-/._]?)(\d\d?)\3(\d\d?)))|(?=((\d\d?)([-/._]?)(\d\d?)\8(\d{4}|\d\d)))")


@functools.cache
def neighbours() -> dict[str, set[str]]:
    """Keys next to each key; a key lies between two of the row above it."""
    place = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row) if key != " "}
    beside = {(0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)}
    return {a: {b for b, (r, c) in place.items() if (r - place[a][0], c - place[a][1]) in beside} for a in place}


def tried(character: str) -> float:
    """Cost of a character by itself: the size of its class."""
    size = 10 if character in "0123456789" else 26 if character.isascii() and character.isalpha() else 33 if character.isascii() else 100
    return math.log10(size)


def lowered(value: str) -> str:
    """In lower case, character by character, so that offsets stay."""
    return "".join([low if len(low := c.lower()) == 1 else c for c in value])


def capitals(word: str) -> float:
    """Ways of writing a word with so many capitals."""
    upper = sum(c.isupper() for c in word)
    lower = len(word) - upper
    if not upper:
        return 0.0
    if not lower or (upper == 1 and (word[0].isupper() or word[-1].isupper())):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), i) for i in range(1, min(upper, lower) + 1)))


class Guesser:
    """Least cost of values, given each dictionary word's rank (1 is the first guess)."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks | {w: min(i, ranks.get(w, i)) for i, w in enumerate(COMMON, 1)}
        self.longest = max(map(len, self.ranks))
        self.cost = Memory(lambda value: self.cheapest(value)[0])

    def words(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        low = lowered(value)
        spellings = {low} | {"".join(t.get(c, c) for c in low) for t in (LOOK_ALIKE, OTHER_LOOK_ALIKE)}
        for spelt in spellings:
            for i in range(len(value) - SHORTEST + 1):
                for j in range(i + SHORTEST, min(i + self.longest, len(value)) + 1):
                    rank = self.ranks.get(spelt[i:j])
                    if rank is not None:
                        replaced = sum(a != b for a, b in zip(low[i:j], spelt[i:j]))
                        yield i, j, math.log10(rank) + capitals(value[i:j]) + replaced * math.log10(2), "word"

    @staticmethod
    def dates(value: str) -> Iterator[tuple[int, int, float, str]]:
        for i in range(len(value) - 3):
            if value[i : i + 4].isascii() and value[i : i + 4].isdigit() and value[i : i + 2] in ("19", "20"):
                yield i, i + 4, math.log10(max(abs(int(value[i : i + 4]) - YEAR), CLOSE_YEARS)), "date"
        for found in DATE.finditer(value):
            for whole, year, mark, one, two in ((1, 2, 3, 4, 5), (6, 10, 8, 7, 9)):
                if found[whole] is None or not found[whole].isascii():
                    continue
                small, large = sorted((int(found[one]), int(found[two])))
                if not (1 <= small <= 12 and 1 <= large <= 31):
                    continue
                y = int(found[year])
                y = y if y > 99 else y + (2000 if y <= YEAR % 100 else 1900)
                guesses = max(abs(y - YEAR), CLOSE_YEARS) * DAYS * (SEPARATED if found[mark] else 1)
                yield found.start(whole), found.end(whole), math.log10(guesses), "date"

    def repeats(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        """Runs of a period, from their first character on, as far as whole units go."""
        for period in range(1, min(LONGEST_UNIT, len(value) // 2) + 1):
            start = 0
            for i in range(period, len(value) + 1):
                if i == len(value) or value[i] != value[i - period]:
                    units = (i - start) // period
                    if units > 1:
                        yield start, start + units * period, self.cost[value[start : start + period]] + math.log10(units), "repeat"
                    start = i - period + 1

    @staticmethod
    def walks(value: str) -> Iterator[tuple[int, int, float, str]]:
        """Longest walks of three keys or more; each change of direction multiplies the guesses."""
        near = neighbours()
        low = lowered(value)
        keys = [SHIFTED.get(c, c) for c in low]
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] not in near.get(keys[i - 1], ()):
                if i - start > 2:
                    places = [(r, row.index(k)) for k in keys[start:i] for r, row in enumerate(ROWS) if k in row]
                    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(places, places[1:])]
                    turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
                    yield start, i, math.log10(len(near) * (i - start)) + turns * math.log10(DEGREE), "walk"
                start = i
        for line in SEQUENCES:
            places = [line.find(c) for c in low]
            start = 0
            for i in range(1, len(places) + 1):
                step = places[i] - places[i - 1] if i < len(places) and places[i] >= 0 <= places[i - 1] else 0
                if i < len(places) and abs(step) == 1 and (i - start == 1 or step == places[start + 1] - places[start]):
                    continue
                if i - start > 2:
                    yield start, i, math.log10(len(line) * 2 * (i - start)), "walk"
                start = i - 1 if abs(step) == 1 else i

    def matches(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        yield from self.words(value)
        yield from self.dates(value)
        yield from self.repeats(value)
        yield from self.walks(value)

    def cheapest(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least cost of a value and the parts it comes from; of equal costs the one of the longest last part."""
        ending: dict[int, list[tuple[float, int, str]]] = {}
        for i, j, cost, kind in self.matches(value):
            ending.setdefault(j, []).append((cost, i, kind))
        best, back = [0.0], [(0, "")]
        for j, character in enumerate(value, 1):
            options = [(best[j - 1] + tried(character), j - 1, "tried")]
            options += [(best[i] + cost, i, kind) for cost, i, kind in ending.get(j, ())]
            cost, i, kind = min(options)
            best.append(cost)
            back.append((i, kind))
        parts, j = [], len(value)
        while j:
            i, kind = back[j]
            if parts and kind == "tried" == parts[-1][2]:
                parts[-1] = (i, parts[-1][1], kind)
            else:
                parts.append((i, j, kind))
            j = i
        return best[-1], parts[::-1]


Span = tuple[str, int, int, int, int, float | None]


def base_spans(text: str) -> list[Span]:
    """Kind, start and end of the match, start and end of the value in it; no cost yet."""
    out = [("assign", *m.span(), *m.span(2), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(kind, *m.span(), *m.span(), None) for m in pattern.finditer(text)]
    return out


def spans(text: str, guesser: Guesser, least: float = LEAST_COST) -> list[Span]:
    """All spans by start, then kind. Base spans get their value's cost; values in context that no base span meets are added."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    out = [(*s[:5], guesser.cost[text[s[3] : s[4]]]) for s in base]
    taken, reach = iter(base), -1  # base spans up to a value's end, and the furthest of their ends
    following = next(taken, None)
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while following is not None and following[1] < end:
            reach = max(reach, following[2])
            following = next(taken, None)
        if reach <= start and guesser.cost[m[1]] >= least:
            out.append(("guess", start, end, start, end, guesser.cost[m[1]]))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shown(found: list[Span]) -> str:
    return ",".join([f"{s[0]}:{s[1]}:{s[2]}" for s in found])


def masked(text: str, found: list[Span]) -> str:
    """The text with every value replaced by its kind; values that overlap are replaced together, by the first one's kind."""
    out, end = [], 0
    for s in sorted(found, key=lambda s: s[3]):
        if s[3] >= end:
            out += [text[end : s[3]], f"[{s[0]}]"]
        end = max(end, s[4])
    return "".join([*out, text[end:]])


# -- Spark


def ranked_words(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent words of 3 to 24 letters in all texts, with their ranks; equal counts go by the alphabet."""
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    counts = texts(docs).select(word).where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").count()
    # Written and read back, the list is picked by the executors; collected at once, every task would send one of its own.
    top = stored(counts.orderBy(F.desc("count"), "word").limit(most), "ranked-words")
    return {r.word: i for i, r in enumerate(sorted(top.collect(), key=lambda r: (-r["count"], r.word)), 1)}


SPAN = "array<struct<kind: string, start: long, end: long, value_start: long, value_end: long, cost: double>>"
RESULT = {
    "doc_id": "long",
    "found": SPAN,
    "masked": "string",
    "n_assign": "long",
    "n_access": "long",
    "n_hex": "long",
    "n_guess": "long",
    "base_sha256": "string",
    "spans": "string",
}


def scanned(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "found"), ranks: dict[str, int] | None = None, least: float = LEAST_COST) -> DataFrame:
    """The chosen columns of ``RESULT`` for every whole text; ``ranks`` are counted from the texts if not given."""
    ranks = ranked_words(docs) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "guesser" not in shared.value:
            shared.value["guesser"] = Guesser(shared.value["ranks"])
        guesser = shared.value["guesser"]
        for batch in batches:
            likely = pc.match_substring_regex(pa.array(batch.text, pa.large_string()), ANY).to_pylist()
            found = [spans(t, guesser, least) if hit else [] for t, hit in zip(batch.text, likely)]
            base = [[s for s in f if s[0] != "guess"] for f in found]
            whole = {
                "doc_id": lambda: batch.doc_id,
                "found": lambda: [[dict(zip(("kind", "start", "end", "value_start", "value_end", "cost"), s)) for s in f] for f in found],
                "masked": lambda: [masked(t, f) for t, f in zip(batch.text, found)],
                **{f"n_{k}": functools.partial(lambda k: [sum(s[0] == k for s in f) for f in found], k) for k in KINDS},
                "base_sha256": lambda: [hashlib.sha256(shown(f).encode()).hexdigest() for f in base],
                "spans": lambda: [shown(f) for f in found],
            }
            yield pd.DataFrame({c: whole[c]() for c in columns}, index=batch.index)

    return frames(texts(docs), run, ", ".join(f"{c} {RESULT[c]}" for c in columns))


def digests(docs: DataFrame) -> DataFrame:
    """Numbers of base spans, their digest, and all spans."""
    return scanned(docs, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
