"""Checks and repairs of prose whose guards depend on each other: pandas UDFs, one text at a time inside.

All of them refuse on doubt: a text is left as it is, or withheld whole, rather than changed on a guess.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import fixed
from factloom.functions.numeric import GRADES

#: Figures a record may hold before its sums are no longer formed, and digits a figure needs to be judged.
MOST_FIGURES, LEAST_DIGITS = 120, 5
_DOLLARS = re.compile(r"\$\s?([0-9][0-9,]*)(?:\.([0-9]+))?(?!\s*(?:[kmbt]\b|thousand|million|billion|trillion|mm\b|bn\b))(?![0-9,.]*[0-9])", re.I)
_FIGURE = re.compile(r"(?P<sign>\$)(?P<number>[0-9][0-9,]*(?:\.[0-9]+)?)(?P<gap>\s?)(?P<unit>billion|million|thousand|[BMK]\b)", re.I)


def dollars(text: str | None) -> list[int]:
    """Whole-dollar figures of a text; those with a scale word are round by nature and left out."""
    return [int(m[1].replace(",", "")) for m in _DOLLARS.finditer(text or "") if m[1].replace(",", "")]


def _sums(values: np.ndarray, repeat: bool) -> np.ndarray:
    """All sums of two or three values, of different places unless ``repeat``."""
    n = len(values)
    i, j = np.triu_indices(n, 0 if repeat else 1)
    pairs = values[i] + values[j]
    threes = [pairs[j <= k - (not repeat)] + values[k] for k in range(n)]
    return np.unique(np.concatenate([pairs, *threes])) if n else np.empty(0, values.dtype)


def _near(figure: int, known: np.ndarray) -> bool:
    """Whether a figure is one of the sorted known ones to a dollar, or any of them rounded."""
    def within(low: float, high: float) -> bool:
        at = int(np.searchsorted(known, low))
        return at < len(known) and known[at] <= high

    if within(figure - 1, figure + 1):
        return True
    unit = 10
    while figure and unit <= 10 * figure and figure % unit == 0:
        if within(figure - unit / 2, figure + unit / 2 - 1):
            return True
        unit *= 10
    return False


def _typos(figure: int) -> set[int]:
    """Numbers of equal length that are one digit, or one swap of neighbours, away."""
    digits = str(figure)
    out = {digits[:i] + d + digits[i + 1 :] for i in range(len(digits)) for d in "0123456789"}
    out |= {digits[:i] + digits[i + 1] + digits[i] + digits[i + 2 :] for i in range(len(digits) - 1)}
    return {int(x) for x in out if x != digits and x[0] != "0"}


def disagreements(text: str | None, stored: list[float] | None, most: int = MOST_FIGURES) -> tuple[list[int], bool]:
    """(figures that look like typos of what is stored, whether the record was too large to judge).

    A figure is one if it agrees with no stored figure and no sum of two or three, has enough digits, and is one edit
    away from exactly one stored figure or sum."""
    exact = np.array([x for x in stored or [] if x is not None and np.isfinite(x)], float)
    figures = dollars(text)
    if not len(exact) or not figures:
        return [], False
    size = np.unique(np.floor(np.abs(exact) + 0.5).astype(np.int64))
    size = size[size > 0]
    if len(size) > most:
        return [], True
    signed = np.floor(exact + 0.5).astype(np.int64)
    agreed = np.unique(np.concatenate([size, np.abs(_sums(np.unique(np.concatenate([size, signed[signed != 0]])), repeat=True))]))
    targets = set(size.tolist()) | set(_sums(size, repeat=False).tolist())
    out = []
    for f in figures:
        if len(str(f).rstrip("0")) >= LEAST_DIGITS and not _near(f, agreed) and len(_typos(f) & targets) == 1:
            out.append(f)
    return out, False


@F.pandas_udf(T.StructType().add("figures", T.ArrayType(T.LongType())).add("refused", T.BooleanType()))
def figure_block(text: pd.Series, stored: pd.Series) -> pd.DataFrame:
    """Verdict on the dollar figures of a text against the figures on record."""
    rows = [disagreements(t, None if s is None else list(s)) for t, s in zip(text, stored, strict=True)]
    return pd.DataFrame({"figures": [f for f, _ in rows], "refused": [r for _, r in rows]})


def numeric_leaves(value: object) -> list[float]:
    """All numbers inside a JSON value, in order; true and false are none."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, int | float):
        return [float(value)]
    if isinstance(value, dict):
        return [x for v in value.values() for x in numeric_leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in numeric_leaves(v)]
    return []


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def json_numbers(value: pd.Series) -> pd.Series:
    """Numbers inside JSON texts; empty for text that is no JSON."""

    def of(text: str | None) -> list[float]:
        try:
            return numeric_leaves(json.loads(text or "null"))
        except ValueError:
            return []

    return value.map(of)


_TOKEN = re.compile(r"\$?\d[\d,]*(?:\.\d+)?|[A-Za-z]+|\s+|.", re.S)
_SCORE = re.compile(r"\d{1,3}(?:\.\d+)?")
_LETTER = re.compile(r"[A-Fa-f]")


@dataclass
class Stated:
    """A score that a text states: where its name and its figure are among the tokens, and the letter before it, if any."""

    name: range
    figure: int
    letter: range | None = None


def _words(tokens: list[str], at: int) -> list[int]:
    """Places of the tokens from ``at`` that are no white space."""
    return [i for i in range(at, min(at + 12, len(tokens))) if not tokens[i].isspace()]


def _is_score(tokens: list[str], at: int) -> bool:
    """Whether a token is a figure that can be a score: three digits at most, no money and no percentage, and not the end of a longer number."""
    after = [tokens[i] for i in _words(tokens, at + 1)[:1]]
    joined = at > 0 and tokens[at - 1] in (".", "$") or at > 1 and tokens[at - 1].isspace() and tokens[at - 2] == "$"
    return bool(_SCORE.fullmatch(tokens[at])) and after != ["%"] and not joined


def names_in(tokens: list[str]) -> list[tuple[str, range]]:
    """The names of a score in a text, and where they are."""
    found = []
    for at, token in enumerate(tokens):
        for name in (*fixed.SCORE_NAMES_INSIDE, *fixed.SCORE_NAMES_OUTSIDE):
            words = name.split()
            places = _words(tokens, at)[: len(words)]
            if not token.isspace() and [tokens[i].lower() for i in places] == words and all(b - a == 2 for a, b in zip(places, places[1:], strict=False)):
                found.append((name, range(at, places[-1] + 1)))
    return found


def stated_scores(tokens: list[str]) -> list[tuple[str, Stated]]:
    """Names with the figure that belongs to each: behind a linking word or sign, or in brackets behind a letter, or right before the name."""
    found = []
    for name, where in names_in(tokens):
        ahead = _words(tokens, where.stop)
        linked = ahead[:1] and tokens[ahead[0]].lower() in fixed.SCORE_LINKS
        rest = ahead[1:] if linked else ahead
        if name.endswith("grade") and len(rest) > 1 and _LETTER.fullmatch(tokens[rest[0]]):
            end = 2 if tokens[rest[1]] in "+-" else 1
            if len(rest) > end + 1 and tokens[rest[end]] == "(" and _SCORE.fullmatch(tokens[rest[end + 1]]) and ")" in [tokens[i] for i in rest[end + 2 : end + 5]]:
                found.append((name, Stated(where, rest[end + 1], range(rest[0], rest[end - 1] + 1))))
                continue
        if linked and rest and _is_score(tokens, rest[0]):
            found.append((name, Stated(where, rest[0])))
        elif where.start > 1 and tokens[where.start - 1].isspace() and _is_score(tokens, where.start - 2):
            found.append((name, Stated(where, where.start - 2)))
    return found


def restated(text: str, score: float) -> str:
    """A text with every figure of a score made the given one: inside names that have a figure become the readers', letters follow the
    figure, and the words between stay as the author has them. Money and percentages are other people's numbers."""
    tokens = _TOKEN.findall(text)
    letter = next((g for g, least in GRADES if score >= least), "F")
    for name, stated in reversed(stated_scores(tokens)):
        tokens[stated.figure] = str(int(np.floor(score + 0.5)))
        if stated.letter:
            tokens[stated.letter.start] = letter
            for i in stated.letter[1:]:
                tokens[i] = ""
        if name in fixed.SCORE_NAMES_INSIDE:
            tokens[stated.name.start] = fixed.SCORE_NAMES_OUTSIDE[0]
            for i in stated.name[1:]:
                tokens[i] = ""
    return "".join(tokens)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def reader_facing_figures(text: pd.Series) -> pd.Series:
    """Figures that a text states as the score under the names that readers know."""

    def of(t: str | None) -> list[float]:
        tokens = _TOKEN.findall(t or "")
        return [float(tokens[s.figure]) for name, s in stated_scores(tokens) if name in fixed.SCORE_NAMES_OUTSIDE]

    return text.map(of)


@F.pandas_udf(T.StringType())
def repair_score(text: pd.Series, live: pd.Series, people: pd.Series) -> pd.Series:
    """Texts that state a score get the live one. Only with one person tagged and a live score; else as it is."""

    def of(t: str | None, score: float | None, n: int | None) -> str | None:
        return restated(t, score) if t and n == 1 and score is not None and np.isfinite(score) else t

    return pd.Series([of(*x) for x in zip(text, live, people, strict=True)], dtype=object)


def _named(text: Column, names: tuple[str, ...]) -> Column:
    shape = "|".join(n.replace(" ", r"\s+") for n in names)
    return F.coalesce(text.rlike(rf"(?i)\b(?:{shape})\b"), F.lit(False))


def names_score_inside(text: Column) -> Column:
    """Whether a text uses a score's inside name, with a figure or without."""
    return _named(text, fixed.SCORE_NAMES_INSIDE)


def withhold_inside_score(text: Column) -> Column:
    """Texts that use a score's inside name are withheld whole; to be asked after ``repair_score``, which renames what it can read."""
    return F.when(names_score_inside(text), "").otherwise(text)


def withhold_any_score(text: Column) -> Column:
    """Texts about people without a grade are withheld whole once they name the score in any way."""
    return F.when(_named(text, fixed.SCORE_NAMES_OUTSIDE + fixed.SCORE_NAMES_INSIDE), "").otherwise(text)


@F.pandas_udf(T.StringType())
def repair_holdings(text: pd.Series, stale: pd.Series, live: pd.Series) -> pd.Series:
    """Texts that state a stale total get the live one in the same unit and number of decimals; a figure counts as the
    stale one within half a percent. Left as it is if the live figure would round to nothing in that unit."""

    def of(t: str | None, old: float | None, new: float | None) -> str | None:
        if not t or old is None or new is None or not (np.isfinite(old) and np.isfinite(new)) or old <= 0 or new <= 0:
            return t

        def one(m: re.Match) -> str:
            scale = fixed.UNITS[m["unit"].lower()]
            said = float(m["number"].replace(",", "")) * scale
            decimals = len(m["number"].partition(".")[2])
            fresh = f"{new / scale:.{decimals}f}"
            return f"{m['sign']}{fresh}{m['gap']}{m['unit']}" if abs(said - old) <= 0.005 * old and float(fresh) > 0 else m[0]

        return _FIGURE.sub(one, t)

    return pd.Series([of(*x) for x in zip(text, stale, live, strict=True)], dtype=object)


class _Sections(HTMLParser):
    """Walks a page and notes, under each heading, the paragraphs that follow it in the same box, with their classes."""

    def __init__(self) -> None:
        super().__init__()
        self.sections: list[tuple[str, list[tuple[set[str], str]]]] = []
        self.said: list[str] = []
        self.within, self.open = "", False

    def finish(self) -> None:
        text = " ".join("".join(self.said).split())
        if self.within == "p":
            self.sections[-1][1].append((self.classes, text))
        elif self.within:
            self.sections.append((text, []))
            self.open = True
        self.within = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HEADINGS or tag == "p":
            self.finish()
        if tag in HEADINGS:
            self.within, self.said, self.open = tag, [], False
        elif tag == "p" and self.open:
            self.within, self.said = "p", []
            self.classes = set((dict(attrs).get("class") or "").split())

    def handle_endtag(self, tag: str) -> None:
        if tag == self.within or tag == "div":
            self.finish()
        if tag == "div":
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.within:
            self.said.append(data)


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def under_heading(page: str | None, heading: str, css: str) -> bool:
    """Whether a page has text of a class under a heading, before the next heading or the end of its box."""
    parser = _Sections()
    parser.feed(page or "")
    parser.close()
    return any(name.lower() == heading.lower() and any(css in classes and text for classes, text in told) for name, told in parser.sections)


def prose_under(heading: str, css: str):
    """A pandas UDF that says whether pages have such text."""

    @F.pandas_udf(T.BooleanType())
    def has(pages: pd.Series) -> pd.Series:
        return pd.Series([under_heading(p, heading, css) for p in pages], dtype=bool)

    return has
