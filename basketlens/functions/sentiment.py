"""Lexicon sentiment of a comment, as one regular expression pass over its whole text.

The words of both sides become one pattern in which only the positive side is a
capturing group. ``regexp_extract_all`` on that group then yields one entry per lexicon
word found, empty when the word is negative, so the score is a size difference and needs
no word array of the text, no lambda and no Python worker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Positive and negative words.

    ``whole_words`` is for text with word separators: a word counts only when no letter
    touches it, and case is ignored. Without it, for unsegmented text, the text is read
    left to right and the longest lexicon word at each place wins, so that a longer
    word hides the shorter ones inside it. ``neutral`` words take part in that and score nothing: they
    keep a word inside them, or one that begins in them, from scoring.
    """

    positive: frozenset[str]
    negative: frozenset[str]
    whole_words: bool = False
    neutral: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        both = self.positive & self.negative | self.neutral & (self.positive | self.negative)
        if both:
            raise ValueError(f"words on two sides: {sorted(both)}")
        if not self.positive | self.negative or "" in self.words:
            raise ValueError("a lexicon needs words, none of them empty")
        if self.whole_words and not all(w.isalpha() and w == w.lower() for w in self.words):
            raise ValueError("whole-word lexicons hold lower-case words of letters only")

    @property
    def words(self) -> frozenset[str]:
        return self.positive | self.negative | self.neutral

    def pattern(self, side: frozenset[str] | None = None) -> str:
        """Java pattern of all words with those of ``side``, by default the positive ones, as group 1."""
        side = self.positive if side is None else side
        words = sorted(self.words, key=lambda w: (-len(w), w))
        mine = [self._guarded(w, self.words - side) for w in words if w in side]
        others = [re.escape(w) for w in words if w not in side]
        # Group 1 always exists, also for a side without words.
        sides = ["(" + ("|".join(mine) or "(?!)") + ")"] + others
        first = "".join(sorted({re.escape(w[0]) for w in words}))
        # The set of first letters is tested first: most places of a text fail there.
        start, body = f"(?=[{first}])", f"(?:{'|'.join(sides)})"
        if self.whole_words:
            return rf"{start}(?<!\p{{L}}){body}(?!\p{{L}})"
        return start + body

    def _guarded(self, word: str, others: frozenset[str]) -> str:
        """``word``, refused where a longer one of ``others`` starts with it."""
        longer = sorted(n[len(word) :] for n in others if n.startswith(word) and n != word)
        if self.whole_words or not longer:
            return re.escape(word)
        return f"{re.escape(word)}(?!{'|'.join(map(re.escape, longer))})"


# The shop's review words, for unsegmented Chinese text.
CHINESE = Lexicon(
    positive=frozenset("好 不错 喜欢 清晰 快 赞 满意 值得 很多 好吃".split()),
    negative=frozenset(
        "差 坏 慢 卡 失望 退货 垃圾 不行 扔 乱 难吃 故障 说法 难 返修 变质".split()
    ),
    # Words of their own with a scored one inside: parcel, cheerful, long ago, no hurry, card, not good.
    neutral=frozenset("快递 愉快 好久 慢慢来 卡片 不好".split()),
)


def sentiment_score(comment: Column, lexicon: Lexicon = CHINESE) -> Column:
    """Positive minus negative lexicon words; 0 for a null comment."""
    text = F.coalesce(comment, F.lit(""))
    text = F.lower(text) if lexicon.whole_words else text

    def found(side: frozenset[str]) -> Column:
        return F.regexp_extract_all(text, F.lit(lexicon.pattern(side)), F.lit(1))

    def scored(side: frozenset[str]) -> Column:
        return F.size(F.array_remove(found(side), ""))

    if lexicon.neutral:
        # What is found is of three kinds, so each side is counted by itself.
        return scored(lexicon.positive) - scored(lexicon.negative)
    return scored(lexicon.positive) * F.lit(2) - F.size(found(lexicon.positive))


def sentiment_label(comment: Column, lexicon: Lexicon = CHINESE) -> Column:
    """1 for a comment that scores at least one, else 0 (neutral, empty and null too)."""
    return F.when(sentiment_score(comment, lexicon) >= 1, F.lit(1)).otherwise(F.lit(0))
