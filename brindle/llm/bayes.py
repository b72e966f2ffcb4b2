"""Naive Bayes over n-grams, fitted on bounded samples, and the likelihood of an end."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

_WORDS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\n|\w+|[^\w\s]")


class Languages:
    """Log posteriors of languages from the character n-grams of words; scores of words are kept."""

    def __init__(self, samples: list[tuple[str, str]], longest: int = 4, alpha: float = 0.5):
        self.labels = sorted({label for label, _ in samples})
        self.longest = longest
        counts = {x: Counter() for x in self.labels}
        for label, text in samples:
            for w, n in Counter(_WORDS.findall(text.lower())).items():
                for g in self._grams(w):
                    counts[label][g] += n
        grams = set().union(*counts.values()) if counts else set()
        total = {x: sum(c.values()) + alpha * (len(grams) + 1) for x, c in counts.items()}
        self.weights = {g: tuple(math.log((counts[x][g] + alpha) / total[x]) for x in self.labels) for g in grams}
        # n-grams of one word overlap: a word counts as one observation
        self.kept: dict[str, tuple] = {}

    def _grams(self, word: str) -> list[str]:
        w = f"<{word}>"
        return [w[i : i + n] for n in range(2, self.longest + 1) for i in range(len(w) - n + 1)] + ([w] if len(w) > self.longest else [])

    def word(self, w: str) -> tuple:
        s = self.kept.get(w)
        if s is None:
            known = [self.weights[g] for g in self._grams(w) if g in self.weights]
            mean = [sum(x) / len(known) for x in zip(*known)] if known else [0.0] * len(self.labels)
            top = max(mean) if mean else 0.0
            s = tuple(max(x - top, -2.5) for x in mean)
            if len(self.kept) > 500_000:
                self.kept.clear()
            self.kept[w] = s
        return s

    def scores(self, text: str) -> list[float]:
        """Log posterior of each label up to a constant."""
        total = [0.0] * len(self.labels)
        for w in _WORDS.findall(text.lower()):
            for i, x in enumerate(self.word(w)):
                total[i] += x
        return total


class Words:
    """Two-class naive Bayes over words and word pairs: log odds of the first class."""

    def __init__(self, yes: list[str], no: list[str], alpha: float = 0.3):
        a, b = Counter(), Counter()
        for texts, c in ((yes, a), (no, b)):
            for t in texts:
                c.update(self.terms(t))
        grams = set(a) | set(b)
        na, nb = sum(a.values()) + alpha * len(grams), sum(b.values()) + alpha * len(grams)
        self.weights = {g: math.log((a[g] + alpha) / na) - math.log((b[g] + alpha) / nb) for g in grams}
        self.prior = math.log(0.1 / 0.9)

    @staticmethod
    def terms(text: str) -> set[str]:
        w = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text.lower().replace("’", "'"))
        return set(w) | {f"{x} {y}" for x, y in zip(w, w[1:])}

    def odds(self, text: str) -> float:
        return self.prior + sum(self.weights.get(t, 0.0) for t in self.terms(text))


def end_tokens(text: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(text.strip()):
        out.append("A" if len(t) == 1 and t.isupper() else re.sub(r"\d+", "0", t).lower())
    return out


class Ends:
    """How likely a text is to end after its last tokens."""

    def __init__(self, texts: list[str], longest: int = 3, weight: float = 8.0):
        self.longest, self.weight = longest, weight
        self.seen = [Counter() for _ in range(longest + 1)]
        self.ended = [Counter() for _ in range(longest + 1)]
        self.begins: dict[str, int] = defaultdict(int)
        tokens_total = 0
        for text in texts:
            t = end_tokens(text)
            if not t:
                continue
            tokens_total += len(t)
            for n in range(1, longest + 1):
                self.seen[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
                self.ended[n][tuple(t[-n:])] += 1
        self.base = len(texts) / max(1, tokens_total)
        for (w,), n in self.seen[1].items():
            inside = n - self.ended[1][(w,)]
            if inside and w.isalpha():
                for k in range(1, len(w)):
                    self.begins[w[:k]] += inside
        self.begins = dict(self.begins)

    @classmethod
    def known(cls, tokens: list[str], base: float, seen: list[int], ended: list[int], begins: int) -> Ends:
        """What is counted elsewhere of one text's last n-grams (seen[n - 1], ended[n - 1]) and last word."""
        own = cls([], len(seen))
        own.base = base
        for n in range(1, min(own.longest, len(tokens)) + 1):
            own.seen[n][tuple(tokens[-n:])], own.ended[n][tuple(tokens[-n:])] = seen[n - 1], ended[n - 1]
        own.begins = {tokens[-1]: begins}
        return own

    def likelihood(self, tokens: list[str]) -> float:
        p = self.base
        for n in range(1, self.longest + 1):
            k = tuple(tokens[-n:])
            p = (self.ended[n][k] + self.weight * p) / (self.seen[n][k] + self.weight)
        return p

    def last_alone(self, tokens: list[str]) -> float:
        k = (tokens[-1],)
        return (self.ended[1][k] + 0.5 * self.base) / (self.seen[1][k] + 0.5)

    def cut_word(self, tokens: list[str], text: str) -> bool:
        """Whether the last word is met at ends alone: never inside a text, or hardly ever and as the beginning of another word."""
        w = tokens[-1]
        if not w.isalpha() or len(w) < 2:
            return False
        inside = self.seen[1][(w,)] - self.ended[1][(w,)]
        begins = self.begins.get(w, 0)
        if inside <= 0.2 * self.seen[1][(w,)] and begins > 2 or inside < 10 and begins >= 100 * (inside + 1):
            return True
        two = re.search(r"([^\W\d_]+)[ ,]+([^\W\d_]+)\W*$", text[-80:])
        return inside == 0 and not (two and two[1][0].isupper() and two[2][0].isupper())  # two capitals: a name
