"""A linear-chain conditional random field over word shapes, for many short texts at once.

Texts are one array of code points. Tokens are runs of Latin letters, digits or blanks, single Han characters and single marks; a token is seen
through its word (if the labelled table has it), the last letters of the word, its shape and its neighbours. Training maximises the likelihood by forward-backward over all rows at once.
Decoding is Viterbi. It first leaves out tokens that no best path can label: for an interval of labelled tokens to beat the
unlabelled path, its summed margins must be positive, so tokens outside every such interval are surely unlabelled. The rest is decoded in batches by length.
"""

from __future__ import annotations

import numpy as np

HAN, LATIN, DIGIT, SPACE, MARK = 1, 2, 3, 4, 5
#: Counts changes of what the field sees; weights of another version don't fit.
VERSION = 2
SHAPES = 640
CELLS = 1 << 13

_TYPE = np.full(0x110000, MARK, dtype=np.uint8)
_FOLD = np.arange(0x110000, dtype=np.uint32)  # full-width forms to plain ones
_FOLD[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
_FOLD[[0x3000, 0xA0, 0x2002, 0x2003, 0x2009, 9]] = 32
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in [*range(65, 91), *range(0xC0, 0xDF), *range(0x100, 0x180)]:
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_UPPER = _LOWER != np.arange(0x110000)
for _a, _b in ((65, 91), (97, 123), (0xC0, 0x250)):
    _TYPE[_a:_b] = LATIN
_TYPE[[0xD7, 0xF7]] = MARK
_TYPE[48:58] = DIGIT
_TYPE[32] = SPACE
for _a, _b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2FA20)):
    _TYPE[_a:_b] = HAN
_R = np.uint64(0x100000001B3)
_RINV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, r, dtype=np.uint64))]) for r in (_R, _RINV)]
    return _POWERS[0], _POWERS[1]


class Tokens:
    """Tokens of texts: start and end in the joined text, text number, word hash, shape."""

    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        codes = _FOLD[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        n = len(codes)
        kind = _TYPE[codes]
        new = np.ones(n, dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == HAN) | (kind[1:] == MARK)
        new[self.at[:-1][lengths > 0]] = True
        self.start = np.flatnonzero(new)
        self.end = np.concatenate([self.start[1:], [n]]) if n else self.start
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1
        self.kind = kind[self.start]
        low = _LOWER[codes].astype(np.uint64)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15) * power[:n], out=sums[1:])
        self.length = self.end - self.start
        word = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.word = word ^ (word >> np.uint64(32)) ^ (self.length.astype(np.uint64) << np.uint64(56))
        digits = self.kind == DIGIT
        self.word[digits] = self.length[digits].astype(np.uint64) + np.uint64(1 << 40)  # digits by length only
        self.shape = self._shapes(codes, low, sums, inverse)

    def _shapes(self, codes, low, sums, inverse) -> np.ndarray:
        """0-9 Han and blanks, 10-39 digits, 40-69 Latin, 128+ marks by code."""
        shape = np.zeros(len(self.start), dtype=np.int32)
        k, length, s, e = self.kind, self.length, self.start, self.end
        shape[k == HAN] = 1
        shape[k == SPACE] = 2
        mark = k == MARK
        shape[mark] = 128 + (codes[s[mark]] % 512).astype(np.int32)
        d = np.flatnonzero(k == DIGIT)
        size = np.minimum(length[d], 20)
        shape[d] = 10 + size
        num = lambda at, off: (codes[at + off].astype(np.int32) - 48)

        def dated(at: np.ndarray, off: int) -> np.ndarray:
            year = num(at, off) * 1000 + num(at, off + 1) * 100 + num(at, off + 2) * 10 + num(at, off + 3)
            month, day = num(at, off + 4) * 10 + num(at, off + 5), num(at, off + 6) * 10 + num(at, off + 7)
            return (year >= 1900) & (year <= 2030) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)

        for n, off, code in ((17, 6, 31), (18, 6, 32), (8, 0, 33)):
            at = d[length[d] == n]
            ok = dated(s[at], off)
            shape[at[ok]] = code
        at = d[length[d] == 11]
        shape[at[(codes[s[at]] == 49) & (codes[s[at] + 1] >= 51)]] = 34
        a = np.flatnonzero(k == LATIN)
        upper = np.concatenate([[0], np.cumsum(_UPPER[codes])])
        caps = upper[e[a]] - upper[s[a]]
        first = _UPPER[codes[s[a]]]
        kind = np.where(caps == 0, 40, np.where((caps == 1) & first, 42, np.where(caps == length[a], 44, 46)))
        shape[a] = np.where((length[a] == 1), kind + 8, kind)
        # hashed endings of Latin words; what they mean is learned from the labelled table
        self.endings = []
        for m in (3, 4):
            ending = np.zeros(len(s), dtype=np.int32)
            at = a[length[a] > m]
            tail = (sums[e[at]] - sums[e[at] - m]) * inverse[e[at] - m]
            ending[at] = (tail >> np.uint64(40)).astype(np.int64) % (CELLS - 1) + 1
            self.endings.append(ending)
        return shape


class Tagger:
    """Weights of the field and what it needs to see a token."""

    def __init__(self, kinds: tuple[str, ...], lean: float = 0.0):
        self.kinds = kinds
        self.lean = lean  # taken off the unlabelled score in decoding: a piece missed weighs more than one too many
        self.labels = 1 + 2 * len(kinds)  # 0 outside, then begin and inside of each kind

    def _features(self, t: Tokens) -> list[np.ndarray]:
        """Row numbers of the weight tables, one array per template; positions outside a text are a class of their own."""
        n = len(t.start)
        place = np.searchsorted(self.vocabulary, t.word)
        place = np.minimum(place, len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[place] == t.word, place + 2, 1).astype(np.int32)
        pad = 4
        edge = np.concatenate([np.full(pad, -1), t.doc, np.full(pad, -2)])

        def shifted(values: np.ndarray, by: int) -> np.ndarray:
            wide = np.concatenate([np.zeros(pad, values.dtype), values, np.zeros(pad, values.dtype)])
            out = wide[pad + by : pad + by + n]
            return np.where(edge[pad + by : pad + by + n] == t.doc, out, 0) if by else out

        shapes = {k: shifted(t.shape, k) for k in range(-2, 3)}
        out = [shifted(word, k) for k in range(-4, 5)]
        out += [shapes[k] for k in range(-2, 3)]
        mix = lambda *xs: (sum(x.astype(np.int64) * p for x, p in zip(xs, (1, 641, 410881, 5003))) * 2654435761 >> 7) % CELLS
        out += [mix(shapes[-1], shapes[0]), mix(shapes[0], shapes[1]), mix(shapes[-1], shapes[0], shapes[1]), mix(shapes[0], shapes[1], shapes[2]), mix(shapes[-2], shapes[-1], shapes[0])]
        out += [mix(out[3], out[4]), mix(out[4], out[5])]
        out += [shifted(ending, k) for ending in t.endings for k in (0, 2, -2)]  # the word's own, and those of the words beyond a blank
        return out

    def _scores(self, feats: list[np.ndarray]) -> np.ndarray:
        scores = np.repeat(self.bias[None, :], len(feats[0]), axis=0)
        for table, rows in zip(self.tables, feats):
            scores += table[rows]
        return scores

    def emissions(self, t: Tokens) -> np.ndarray:
        return self._scores(self._features(t))

    def _targets(self, t: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
        gold = np.zeros(len(t.start), dtype=np.int64)
        for i, row in enumerate(spans):
            for a, b, kind in row:
                lo, hi = np.searchsorted(t.start, t.at[i] + a, side="right") - 1, np.searchsorted(t.start, t.at[i] + b)
                k = 1 + 2 * self.kinds.index(kind)
                gold[lo] = k
                gold[lo + 1 : hi] = k + 1
        return gold

    def train(self, rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 36, rate: float = 0.25, decay: float = 2e-3) -> "Tagger":
        t = Tokens([text for text, _ in rows])
        values, counts = np.unique(t.word, return_counts=True)
        self.vocabulary = values[counts >= 2]
        L = self.labels
        self.bias = np.zeros(L, dtype=np.float32)
        feats = self._features(t)
        sizes = [len(self.vocabulary) + 2] * 9 + [SHAPES] * 5 + [CELLS] * 13
        self.tables = [np.zeros((n, L), dtype=np.float32) for n in sizes]
        self.trans = np.zeros((L, L), dtype=np.float32)
        gold = self._targets(t, [spans for _, spans in rows])
        # step after step of all rows, longest rows first, so that a step and the one before it are slices
        first = np.searchsorted(t.doc, np.arange(len(rows)))
        length = np.diff(np.concatenate([first, [len(t.doc)]]))
        by_length = np.argsort(-length, kind="stable")
        first, length = first[by_length], length[by_length]
        live = [int(np.searchsorted(-length, -k)) for k in range(length[0])]
        perm = np.concatenate([first[:n] + k for k, n in enumerate(live)])
        at = np.concatenate([[0], np.cumsum(live)])
        feats, gold = [f[perm] for f in feats], gold[perm]
        orders = [np.argsort(f, kind="stable") for f in feats]
        cuts = [np.flatnonzero(np.concatenate([[True], f[o][1:] != f[o][:-1]])) for f, o in zip(feats, orders)]
        used = [f[o][c] for f, o, c in zip(feats, orders, cuts)]
        before = np.concatenate([np.arange(at[k - 1], at[k - 1] + n) for k, n in enumerate(live) if k] or [np.zeros(0, dtype=np.int64)])
        seen = np.zeros((L, L))
        np.add.at(seen, (gold[before], gold[at[1] :]), 1)
        params = [self.bias, self.trans, *self.tables]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for it in range(1, rounds + 1):
            e = self._scores(feats)
            e -= e.max(1, keepdims=True)
            pe, pt = np.exp(e), np.exp(self.trans)
            alpha, beta = np.empty_like(pe), np.full_like(pe, 1.0 / L)
            for k, n in enumerate(live):
                a = pe[: live[0]] if k == 0 else (alpha[at[k - 1] : at[k - 1] + n] @ pt) * pe[at[k] : at[k] + n]
                alpha[at[k] : at[k] + n] = a / a.sum(1, keepdims=True)
            for k in range(len(live) - 1, 0, -1):
                n = live[k]
                b = (beta[at[k] : at[k] + n] * pe[at[k] : at[k] + n]) @ pt.T
                beta[at[k - 1] : at[k - 1] + n] = b / b.sum(1, keepdims=True)
            d = alpha * beta
            d /= d.sum(1, keepdims=True)
            left, right = alpha[before], beta[at[1] :] * pe[at[1] :]
            norm = ((left @ pt) * right).sum(1)
            expected = ((left / norm[:, None]).T @ right) * pt
            d[np.arange(len(gold)), gold] -= 1
            grads = [d.sum(0), (expected - seen).astype(np.float32)]
            for table, o, c, u in zip(self.tables, orders, cuts, used):
                g = np.zeros_like(table)
                g[u] = np.add.reduceat(d[o], c, axis=0)
                grads.append(g)
            for x, g, a, b in zip(params, grads, m1, m2):
                g = g + decay * x * len(rows) / 100
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                x -= rate * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-3)
        return self

    def weights(self) -> dict[str, np.ndarray]:
        return {"vocabulary": self.vocabulary, "bias": self.bias, "trans": self.trans, **{f"table{i}": x for i, x in enumerate(self.tables)}}

    def restore(self, kept) -> "Tagger":
        self.vocabulary, self.bias, self.trans = kept["vocabulary"], kept["bias"], kept["trans"]
        self.tables = [kept[f"table{i}"] for i in range(sum(k.startswith("table") for k in kept))]
        return self

    def decode(self, t: Tokens) -> np.ndarray:
        """Best label of every token."""
        n, L = len(t.start), self.labels
        out = np.zeros(n, dtype=np.int8)
        if not n:
            return out
        e = self.emissions(t)
        e[:, 0] -= self.lean
        free = self.trans - self.trans[0, 0]
        free[0, 0] = -np.inf
        gain = max(0.0, float(free.max()))
        margin = (e[:, 1:].max(1) - e[:, 0]).astype(np.float64) + gain
        begins = np.concatenate([[True], t.doc[1:] != t.doc[:-1]])
        maybe = self._within(margin, begins, gain)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        if len(lo):
            cut = np.flatnonzero(begins & maybe)  # a run may not span two texts
            bounds = np.unique(np.concatenate([lo, cut]))
            hi = np.minimum(hi[np.searchsorted(lo, bounds, side="right") - 1], np.concatenate([bounds[1:], [n]]))
            lo = bounds
            self._viterbi(e, lo, hi, begins, np.concatenate([begins[1:], [True]]), out)
        return out

    @staticmethod
    def _within(margin: np.ndarray, begins: np.ndarray, gain: float) -> np.ndarray:
        """Tokens that lie in some interval of one text whose summed margins exceed -gain."""
        doc = np.cumsum(begins)
        base = doc * 1e8  # prefix sums of different texts are kept apart by steps no sum can reach
        total = np.cumsum(margin)
        first = np.flatnonzero(begins)
        start = np.concatenate([[0.0], total[:-1]])[first][doc - 1]
        own = np.clip(total - start, -4e7, 4e7)
        before = np.where(begins, 0.0, np.concatenate([[0.0], own[:-1]]))
        low = -np.maximum.accumulate(base - before) + base
        high = np.maximum.accumulate((own - base)[::-1])[::-1] + base
        return high - low + gain > -0.01

    def _viterbi(self, e, lo, hi, begins, ends, out) -> None:
        """Label runs [lo, hi); beside a run, within its text, is an unlabelled token."""
        length = hi - lo
        order = np.argsort(-length, kind="stable")
        lo, hi, length = lo[order], hi[order], length[order]
        L = self.labels
        block = 1 << 15
        for a in range(0, len(lo), block):
            s, n = lo[a : a + block], length[a : a + block]
            score = e[s] + np.where(begins[s][:, None], 0, self.trans[0])
            back = []
            done = np.zeros((len(s), L), dtype=np.float32)
            for k in range(1, int(n[0]) + 1):
                live = int(np.searchsorted(-n, -k))  # runs longer than k
                done[live : len(score)] = score[live:]
                score = score[:live]
                if not live:
                    break
                step = score[:, :, None] + self.trans[None]
                best = step.argmax(1).astype(np.int8)
                back.append(best)
                score = np.take_along_axis(step, best[:, None, :].astype(np.int64), 1)[:, 0] + e[s[:live] + k]
            last = s + n - 1
            y = (done + np.where(ends[last][:, None], 0, self.trans[:, 0])).argmax(1)
            out[last] = y
            for k in range(int(n[0]) - 1, 0, -1):
                live = int(np.searchsorted(-n, -k))
                y[:live] = back[k - 1][np.arange(live), y[:live]]
                out[s[:live] + k - 1] = y[:live]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(text number, start, end, kind number) of every labelled piece, in order."""
        t = Tokens(texts)
        y = self.decode(t)
        begin = (y > 0) & (y % 2 == 1)
        inside = (y > 0) & (y % 2 == 0)
        kind = (y - 1) // 2
        starts = begin | (inside & ~np.concatenate([[False], (y[:-1] > 0) & (kind[:-1] == kind[1:]) & (t.doc[:-1] == t.doc[1:])]))
        at = np.flatnonzero(starts)
        # a piece ends before the next start or unlabelled token
        breaks = np.flatnonzero(starts | (y == 0))
        nxt = np.searchsorted(breaks, at, side="right")
        end = np.where(nxt < len(breaks), breaks[np.minimum(nxt, len(breaks) - 1)] if len(breaks) else 0, len(y))
        return [t.doc[at], t.start[at] - t.at[t.doc[at]], t.end[end - 1] - t.at[t.doc[at]], kind[at]]
