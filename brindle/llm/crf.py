"""A linear-chain conditional random field over word shapes, in numpy.

A token's score for each label is the sum of the weights of the features of the
token itself and of its neighbours up to two tokens away. All features belong to
single tokens, so the scores of a token at each distance are worked out once per
distinct token and looked up after that. Digits count by their number, not by
their value.

Training maximises the likelihood of a labelled table (forward-backward in
batches, Adam). Decoding is Viterbi's algorithm in batches. It is run only where
it can matter: with a label's score so far below O's that no pair of transitions
makes up for it, O is part of every best path, and the text falls apart into
independent stretches there. The result equals that of the whole chain.
"""

from __future__ import annotations

import re

import numpy as np

REACH = 2
_TOKEN = re.compile(r"\n|\w+|[^\w\s]")
_FIND = _TOKEN.findall
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_DIGIT_MAP = {i: "0" for i in range(49, 58)}
PAD = "\x00"

# Words that introduce or make up the marked parts.
STREETS = set("street road rd ave avenue blvd boulevard lane close drive way st court terrace place crescent rue chemin allée quai impasse calle avda avenida camino plaza paseo".split())
STREET_ENDS = ("gasse", "allee", "weg", "straße", "strasse", "str", "platz", "ufer", "ring", "damm")
TITLES = set("mr mrs ms dr prof herr frau señor señora sr sra mme monsieur madame".split())
ID_WORDS = set("ssn ni passport tax identity tin reisepass dni nif ausweis".split())
PHONE_WORDS = set("tel phone mobile hotline callback ring fax ext dial text".split())


def normal(text: str) -> str:
    if text.isascii():
        return text.encode().translate(_DIGITS).decode()
    return text.translate(_DIGIT_MAP)


def tokens(text: str) -> list[str]:
    return _FIND(normal(text))


def spans_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(normal(text))]


def features(token: str, given: frozenset, family: frozenset) -> list[str]:
    low = token.lower()
    out = ["w=" + low, "bias"]
    if token.isdigit():
        out += ["digits", f"d={min(len(token), 12)}"]
    elif token.isalpha():
        shape = "X" if len(token) == 1 and token.isupper() else "Xx" if token[0].isupper() and token[1:].islower() else "XX" if token.isupper() else "x" if token.islower() else "xX"
        out += ["alpha", "s=" + shape, "z3=" + low[-3:]]
        if low in given:
            out += ["given", "given" + shape]
        if low in family:
            out += ["family", "family" + shape]
        if low in given or low in family:
            out.append("name")
        elif len(low) > 2:
            out.append("noname" + shape)
        if low in STREETS or low.endswith(STREET_ENDS) and len(low) > 5:
            out.append("street")
        if low in TITLES:
            out.append("title")
        if low in ID_WORDS:
            out.append("idword")
        if low in PHONE_WORDS:
            out.append("phoneword")
    elif token == PAD:
        out.append("pad")
    elif token[0].isalnum() or token[0] == "_":
        out += ["mixed", "m=" + re.sub(r"[a-z]+", "x", re.sub(r"[A-Z]+", "X", re.sub(r"0+", "0", token)))[:8], f"ml={min(len(token), 14)}"]
    else:
        out += ["punct"]
    return out


class Crf:
    def __init__(self, labels: list[str]):
        self.labels = labels  # the first one is O
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, 2 * REACH + 1, len(labels)), dtype=np.float32)
        self.moves = np.zeros((len(labels), len(labels)), dtype=np.float32)

    # training

    def fit(self, rows: list[tuple[list[str], list[int]]], given: frozenset, family: frozenset, unnamed: frozenset = frozenset(), epochs: int = 16, batch: int = 256, rate: float = 0.06, decay: float = 2e-5, seed: int = 5) -> None:
        """rows: tokens and labels. unnamed: words that are known by their shape alone."""
        kinds = len(self.labels)
        vocabulary: dict[str, int] = {PAD: 0}
        coded = [([vocabulary.setdefault(t, len(vocabulary)) for t in toks], labs) for toks, labs in rows if toks]
        lists = [[f for f in features(t, given, family) if f[:2] != "w=" or f[2:] not in unnamed] for t in vocabulary]
        counts: dict[str, int] = {}
        for fs in lists:
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
        seen = np.bincount([i for toks, _ in coded for i in toks], minlength=len(vocabulary))
        for fs, n in zip(lists, seen):
            for f in fs:
                if f not in self.index and (n >= 3 or counts[f] > 1 or not f.startswith("w=")):
                    self.index[f] = len(self.index)
        flat = np.array([(v, self.index[f]) for v, fs in enumerate(lists) for f in fs if f in self.index])
        nf, wide = len(self.index), (2 * REACH + 1) * kinds
        w = np.zeros((nf, wide), dtype=np.float32)
        move = np.zeros((kinds, kinds), dtype=np.float32)
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
        by_token = flat[np.argsort(flat[:, 0], kind="stable")]
        token_at = np.searchsorted(by_token[:, 0], np.arange(len(vocabulary) + 1))
        rng, step = np.random.default_rng(seed), 0
        coded.sort(key=lambda x: len(x[0]))
        groups = [coded[i : i + batch] for i in range(0, len(coded), batch)]
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                group = groups[g]
                n, long = len(group), max(len(t) for t, _ in group)
                ids = np.zeros((n, long + 2 * REACH), dtype=np.int64)
                gold = np.zeros((n, long), dtype=np.int64)
                live = np.zeros((n, long), dtype=bool)
                for i, (toks, labs) in enumerate(group):
                    ids[i, REACH : REACH + len(toks)] = toks
                    gold[i, : len(labs)] = labs
                    live[i, : len(toks)] = True
                # the batch's own tokens alone, with their features one after the other
                own, ids = np.unique(ids, return_inverse=True)
                ids = ids.reshape(n, long + 2 * REACH)
                many = token_at[own + 1] - token_at[own]
                first = np.cumsum(many) - many
                pairs = by_token[np.repeat(token_at[own] - first, many) + np.arange(many.sum()), 1]
                table = np.add.reduceat(w[pairs], first, axis=0).reshape(-1, 2 * REACH + 1, kinds)
                score = sum(table[ids[:, k : k + long], k] for k in range(2 * REACH + 1))
                grad_e, grad_m = self._gradient(score, move, gold, live)
                grad_t = np.zeros_like(table)
                for k in range(2 * REACH + 1):
                    where = ids[:, k : k + long][live]
                    for c in range(kinds):
                        grad_t[:, k, c] = np.bincount(where, grad_e[..., c][live], minlength=len(own))
                grad_w = -decay * n * w / batch
                np.add.at(grad_w, pairs, np.repeat(grad_t.reshape(len(own), wide) / n, many, axis=0))
                step += 1
                pace = rate * (0.5 ** (epoch / (epochs / 2)))
                for x, gr, a, b in ((w, grad_w, state[0], state[1]), (move, grad_m / n, state[2], state[3])):
                    a *= 0.9
                    a += 0.1 * gr
                    b *= 0.99
                    b += 0.01 * gr * gr
                    x += pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        self.weights, self.moves = w.reshape(nf, 2 * REACH + 1, kinds), move

    @staticmethod
    def _gradient(score: np.ndarray, move: np.ndarray, gold: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected counts of labels per token and of moves. Chains begin and end in O."""
        n, long, kinds = score.shape
        e = np.exp(score - score.max(axis=2, keepdims=True)).astype(np.float64)
        m = np.exp(move.astype(np.float64))
        ahead, back = np.zeros((n, long, kinds)), np.zeros((n, long, kinds))
        a = e[:, 0] * m[0]
        a /= a.sum(1, keepdims=True)
        ahead[:, 0] = a
        for t in range(1, long):
            a = (a @ m) * e[:, t]
            a /= a.sum(1, keepdims=True)
            ahead[:, t] = a
        last = np.broadcast_to(m[:, 0], (n, kinds))
        size = live.sum(1)
        b = np.array(last)
        for t in range(long - 1, -1, -1):
            end = (size - 1) == t
            b = np.where(end[:, None], last, b)
            back[:, t] = b
            b = (b * e[:, t]) @ m.T
            b /= b.sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        seen = np.eye(kinds)[gold]
        grad_e = (seen - p) * live[..., None]
        grad_m = np.zeros((kinds, kinds))
        both = live[:, 1:]
        np.add.at(grad_m, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        right = e[:, 1:] * back[:, 1:]
        pair = ahead[:, :-1, :, None] * m[None, None] * right[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        grad_m -= pair[both].sum(0)
        return grad_e, grad_m


class Tagger(dict):
    """Decoder with the scores of all tokens met so far; one per task."""

    MOST = 400_000

    def __init__(self, crf: Crf, given: frozenset, family: frozenset):
        super().__init__()
        self.crf, self.given, self.family = crf, given, family
        kinds = len(crf.labels)
        self.scores = np.zeros((1024, 2 * REACH + 1, kinds), dtype=np.float32)
        m = crf.moves
        # the most that a label may win over O by its moves to both neighbours
        self.bound = float(max(m[a, c] + m[c, b] - m[a, 0] - m[0, b] for a in range(kinds) for b in range(kinds) for c in range(kinds)))
        self[PAD]

    def __missing__(self, token: str) -> int:
        i = len(self)
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        index = self.crf.index
        known = [index[f] for f in features(token, self.given, self.family) if f in index]
        if known:
            self.scores[i] = self.crf.weights[known].sum(0)
        self[token] = i
        return i

    def tag(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """(index, labels of all tokens) of the texts that have any label but O."""
        if len(self) > self.MOST:
            self.clear()
            self[PAD]
        toks: list[str] = [PAD] * REACH
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            begin[i] = len(toks)
            toks += tokens(t)
            toks += (PAD, PAD)
        begin[len(texts)] = len(toks)
        ids = np.fromiter(map(self.__getitem__, toks), dtype=np.int64, count=len(toks))
        n, s = len(ids), self.scores
        score = s[ids, REACH]
        for k in range(2 * REACH + 1):
            off = k - REACH
            if off < 0:
                score[-off:] += s[ids[: n + off], k]
            elif off > 0:
                score[: n - off] += s[ids[off:], k]
        open_ = score[:, 1:].max(1) + self.bound >= score[:, 0]
        open_[ids == self[PAD]] = False
        labels = self._viterbi(score, open_)
        out = []
        for i in np.unique(np.searchsorted(begin, np.flatnonzero(labels), side="right") - 1):
            out.append((int(i), labels[begin[i] : begin[i + 1] - REACH]))
        return out

    def _viterbi(self, score: np.ndarray, open_: np.ndarray) -> np.ndarray:
        m = self.crf.moves
        labels = np.zeros(len(score), dtype=np.int8)
        edge = np.diff(np.concatenate([[0], open_.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return labels
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        best = score[start] + m[0]
        came = []
        finals = np.zeros((len(start), score.shape[1]), dtype=np.float32)
        live = len(start)
        for t in range(1, int(size[0]) + 1):
            more = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
            finals[more:live] = best[more:live]
            live = more
            if not live:
                break
            ways = best[:live, :, None] + m[None]
            came.append(ways.argmax(1).astype(np.int8))
            best = ways.max(1) + score[start[:live] + t]
        now = (finals + m[:, 0]).argmax(1).astype(np.int64)
        for t in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t, side="left"))
            labels[start[:n] + t] = now[:n]
            if t:
                now[:n] = came[t - 1][np.arange(n), now[:n]]
        return labels
