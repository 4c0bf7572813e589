"""The lattice of vocabulary pieces over a short text, as sampling and scoring use it.

A vocabulary file gives the pieces and their scores. A byte-pair vocabulary scores a piece by
its merge rank r (score -r); its weight is Zipf's, 1 / (r + 2), normalised over the pieces. Other
scores are log-probabilities and are taken as they are. A character that is no piece is spelt by
its UTF-8 bytes' pieces, each as likely as the rarest piece.

Pieces hold a space only in front, so text can be cut before each space, and around line ends, and
the lattices of the cuts are independent: the forward sums add up, the samples join.
"""

from __future__ import annotations

from math import exp, log

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The file's bytes; a vocabulary's size is fixed, so they can be broadcast."""
    with open(path.removeprefix("file://"), "rb") as f:
        return f.read()


class Pieces:
    """Pieces by text. ``known`` maps a text to its piece, or to -1 if longer pieces end in it."""

    def __init__(self, proto: bytes, log_weight: np.ndarray | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        self.size = n
        self.text: list[bytes] = [b""] * n  # what a piece decodes to
        self.byte = [-1] * 256
        normal: dict[str, int] = {}
        score = np.full(n, -np.inf)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b] = i
                self.text[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                t = piece.replace("▁", " ")
                never = sp.get_score(i) < -1e8  # given by hand, as runs of spaces are
                if t and " " not in t[1:] and "\n" not in t and (len(t) == 1 or not never):
                    normal[t] = i
                    score[i] = np.nan if never else sp.get_score(i)
                    self.text[i] = t.encode()
        if min(self.byte) < 0:
            raise ValueError("the vocabulary has no piece for some bytes")
        has = np.isfinite(score)
        score[np.isnan(score)] = score[has].min() if has.any() else 0.0
        has = np.isfinite(score)
        ranks = bool(has.any()) and bool((score[has] == np.round(score[has])).all())
        base = np.where(has, -np.log(2 - np.minimum(score, 0)) if ranks else score, -np.inf)
        base[self.byte] = base[has].min() if has.any() else 0.0
        self.log_weight = (base - np.logaddexp.reduce(base)) if log_weight is None else log_weight
        self.known: dict[str, int] = {}
        for t in normal:
            for k in range(1, len(t)):
                self.known.setdefault(t[k:], -1)
        self.known.update(normal)

    def spelt(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def forward(self, text: str) -> float:
        """Natural log of the summed weight of all segmentations."""
        known, w = self.known, self.weights()
        at = [0.0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            best: list[float] = []
            i = j - 1
            while i >= 0:
                k = known.get(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    best.append(at[i] + w[k])
                i -= 1
            if text[j - 1] not in known or known[text[j - 1]] < 0:
                best.append(at[j - 1] + sum(w[k] for k in self.spelt(text[j - 1])))
            if len(best) == 1:
                at[j] = best[0]
            else:
                top = max(best)
                at[j] = top + log(sum([exp(x - top) for x in best]))
        return at[-1]

    def trie(self) -> Trie:
        if not hasattr(self, "_trie"):
            self._trie = Trie(self)
        return self._trie

    def has(self) -> np.ndarray:
        """Whether each code point is a piece."""
        if not hasattr(self, "_has"):
            self._has = np.zeros(0x110000, bool)
            self._has[[ord(t) for t, k in self.known.items() if k >= 0 and len(t) == 1]] = True
        return self._has

    def weights(self) -> list[float]:
        if not hasattr(self, "_list"):
            self._list = self.log_weight.tolist()
        return self._list

    def edges(self, text: str) -> list[list[tuple[int, int, float]]]:
        """For each end 1..n: (start, piece or -1 for a spelt character, forward sum through this edge)."""
        known, w = self.known, self.weights()
        at, out = [0.0] * (len(text) + 1), []
        for j in range(1, len(text) + 1):
            here: list[tuple[int, int, float]] = []
            i = j - 1
            while i >= 0:
                k = known.get(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    here.append((i, k, at[i] + w[k]))
                i -= 1
            if not here or here[0][0] != j - 1:
                here.append((j - 1, -1, at[j - 1] + sum(w[k] for k in self.spelt(text[j - 1]))))
            top = max(x[2] for x in here)
            at[j] = top + log(sum([exp(x[2] - top) for x in here])) if len(here) > 1 else top
            out.append(here)
        self.total = at[-1]
        return out

    def expected(self, text: str, times: float, into: np.ndarray) -> None:
        """Add each piece's expected count over all segmentations of text, times so often."""
        ends = self.edges(text)
        n, w, total = len(text), self.weights(), self.total
        back = [-np.inf] * n + [0.0]
        for j in range(n, 0, -1):
            b = back[j]
            if b == -np.inf:
                continue
            for i, k, through in ends[j - 1]:
                p = exp(min(0.0, through + b - total)) * times
                if k >= 0:
                    into[k] += p
                    x = b + w[k]
                else:
                    x = b
                    for s in self.spelt(text[i]):
                        into[s] += p
                        x += w[s]
                y = back[i]
                back[i] = x if y == -np.inf else (x + log(1 + exp(y - x)) if x > y else y + log(1 + exp(x - y)))


class Trie:
    """The pieces' prefixes as an open-addressing table, so that many texts advance a character at once."""

    def __init__(self, pieces: Pieces):
        states = {"": 0}
        keys, to = [], []
        texts = [t for t, k in pieces.known.items() if k >= 0]
        for t in sorted(texts):
            for k in range(1, len(t) + 1):
                if t[:k] not in states:
                    states[t[:k]] = len(states)
                    keys.append(states[t[: k - 1]] << 21 | ord(t[k - 1]))
                    to.append(states[t[:k]])
        self.piece = np.full(len(states), -1, np.int32)
        for t in texts:
            self.piece[states[t]] = pieces.known[t]
        self.longest = max(map(len, texts), default=1)
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for k, s in zip(keys, to, strict=True):
            i = (k * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - bits)
            while self.key[i] >= 0:
                i = (i + 1) & ((1 << bits) - 1)
            self.key[i], self.to[i] = k, s

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on so."""
        key = state.astype(np.int64) << 21 | char
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.key[at]
        out = np.where(found == key, self.to[at], -1)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.key) - 1)
            found = self.key[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.to[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out


#: Log of the factor that weights have for each character; it cancels out, and keeps sums within range.
SCALE = 5.0
SHORT = 40  # characters of a text that is taken with others at once
SPELT = 14  # and of one with a character that is no piece


class Lattices:
    """The lattices of many short texts side by side.

    Texts are sorted by length, the longest first. Node (d, t), after d characters of text t, is
    base[d] + t, so what happens after d characters happens in one stretch of every array.
    weight[k, node] is the weight of the edge of k + 1 characters that ends there, piece[node, k] its
    piece, or -1 - i for spelt[i].
    """

    def __init__(self, pieces: Pieces, char: np.ndarray, first: np.ndarray, n: np.ndarray, logs: bool = False):
        """Text i is the code points char[first[i]:first[i] + n[i]].

        With logs, weights and forward sums are natural logs in double precision, which is what scores
        are read from; without, they are scaled weights, which samples and expected counts are drawn from.
        """
        trie = pieces.trie()
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        first = first[self.order]
        longest = int(self.n[0]) if len(n) else 0
        self.live = len(n) - np.searchsorted(self.n[::-1], np.arange(longest + 1), "left")  # texts of d characters at least
        self.base = np.cumsum(self.live) - self.live
        nodes = int(self.live.sum())
        # the character after each node, for nodes that have one
        after = np.zeros(nodes, np.int64)
        for d in range(longest):
            m = self.live[d + 1]
            after[self.base[d] : self.base[d] + m] = char[first[:m] + d]
        d = np.repeat(np.arange(longest), self.live[1:])
        t = np.concatenate([np.arange(m) for m in self.live[1:]]) if longest else d
        state = np.zeros(len(d), np.int32)
        edges = []
        k = 0
        while len(d):
            state = trie.step(state, after[self.base[d] + t])
            on = state >= 0
            d, t, state = d[on] + 1, t[on], state[on]
            p = trie.piece[state]
            has = p >= 0
            edges.append((self.base[d[has]] + t[has], p[has]))
            on = self.n[t] > d
            d, t, state = d[on], t[on], state[on]
            k += 1
        while len(edges) > 1 and not len(edges[-1][0]):
            edges.pop()
        self.logs = logs
        self.width = max(1, len(edges))
        if logs:
            self._log_forward(pieces, edges, after, len(n), longest)
            return
        w = np.exp(pieces.log_weight)
        self.weight = np.zeros((self.width, nodes), np.float32)
        self.piece = np.zeros((nodes, self.width), np.int32)
        for k, (to, p) in enumerate(edges):
            self.weight[k, to] = w[p] * np.exp(SCALE * (k + 1))
            self.piece[to, k] = p
        self.spelt: list[list[int]] = []
        known: dict[int, int] = {}
        for i in (np.flatnonzero(self.weight[0, len(n) :] == 0) + len(n)).tolist():
            at = int(np.searchsorted(self.base, i, "right")) - 1
            c = int(after[self.base[at - 1] + i - self.base[at]])
            if c not in known:
                known[c] = len(self.spelt)
                self.spelt.append(pieces.spelt(chr(c)))
            self.weight[0, i] = np.exp(sum(pieces.log_weight[x] for x in self.spelt[known[c]]) + SCALE)
            self.piece[i, 0] = -1 - known[c]
        # forward sums, and what the first edges make of each
        self.forward = np.ones(nodes)
        self.share = np.zeros((nodes, self.width), np.float32)
        for d in range(1, longest + 1):
            m, here = self.live[d], slice(self.base[d], self.base[d] + self.live[d])
            total = np.zeros(m)
            some = min(d, self.width)
            for k in range(some):
                b = self.base[d - k - 1]
                total += self.forward[b : b + m] * self.weight[k, here]
                self.share[here, k] = total
            self.share[here, some:] = total[:, None]
            self.forward[here] = total

    def _log_forward(self, pieces: Pieces, edges: list, after: np.ndarray, texts: int, longest: int) -> None:
        weight = np.full((self.width, len(after)), -np.inf)
        for k, (to, p) in enumerate(edges):
            weight[k, to] = pieces.log_weight[p]
        for i in (np.flatnonzero(np.isneginf(weight[0, texts:])) + texts).tolist():
            at = int(np.searchsorted(self.base, i, "right")) - 1
            weight[0, i] = sum(pieces.log_weight[x] for x in pieces.spelt(chr(int(after[self.base[at - 1] + i - self.base[at]]))))
        self.forward = np.zeros(len(after))
        for d in range(1, longest + 1):
            m, here = self.live[d], slice(self.base[d], self.base[d] + self.live[d])
            terms = np.stack([self.forward[self.base[d - k - 1] :][:m] + weight[k, here] for k in range(min(d, self.width))])
            top = terms.max(0)  # finite: each character is an edge, if need be spelt
            self.forward[here] = top + np.log(np.exp(terms - top).sum(0))

    def ends(self) -> np.ndarray:
        """The last node of each text, in their sorted order."""
        return self.base[self.n] + np.arange(len(self.n))

    def log_total(self) -> np.ndarray:
        """Natural log of each text's summed weight over all segmentations, in the given order."""
        out = np.empty(len(self.n))
        last = self.forward[self.ends()]
        out[self.order] = last if self.logs else np.log(last) - SCALE * self.n
        return out

    def expected(self, times: np.ndarray, into: np.ndarray) -> None:
        """Add the pieces' expected counts, text i of the given ones counting times[i]."""
        back = np.zeros(len(self.forward))
        ends = self.ends()
        back[ends] = times[self.order] / self.forward[ends]
        for d in range(len(self.base) - 1, 0, -1):
            m, here = self.live[d], slice(self.base[d], self.base[d] + self.live[d])
            for k in range(min(d, self.width)):
                b = self.base[d - k - 1]
                x = self.weight[k, here] * back[here]
                back[b : b + m] += x
                x *= self.forward[b : b + m]
                p = self.piece[here, k]
                whole = p >= 0
                into += np.bincount(p[whole], x[whole], minlength=len(into))
                for i in np.flatnonzero(~whole).tolist():
                    for s in self.spelt[-1 - p[i]]:
                        into[s] += x[i]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def short(pieces: Pieces, char: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which texts are within what Lattices takes; longer ones go one by one, in logs."""
    odd = np.r_[0, np.cumsum(~pieces.has()[char])]
    return (n <= SPELT) | ((n <= SHORT) & (odd[first + n] == odd[first]))


def _split(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    char, n = points("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(n) - n
    return char, first, n, short(pieces, char, first, n)


def log_totals(pieces: Pieces, texts: list[str]) -> list[float]:
    char, first, n, few = _split(pieces, texts)
    out = np.zeros(len(texts))
    if few.any():
        out[few] = Lattices(pieces, char, first[few], n[few], logs=True).log_total()
    for i in np.flatnonzero(~few).tolist():
        out[i] = pieces.forward(texts[i])
    return out.tolist()


def add_expected(pieces: Pieces, texts: list[str], times: list[float], into: np.ndarray) -> None:
    char, first, n, few = _split(pieces, texts)
    if few.any():
        Lattices(pieces, char, first[few], n[few]).expected(np.array(times, float)[few], into)
    for i in np.flatnonzero(~few).tolist():
        pieces.expected(texts[i], times[i], into)


_loaded: dict[int, Pieces] = {}


def loaded(proto: bytes, log_weight: np.ndarray | None = None) -> Pieces:
    """One copy for each Python process."""
    key = hash((proto, None if log_weight is None else log_weight.tobytes()))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto, log_weight)
    return _loaded[key]
