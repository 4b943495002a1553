"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the embedding of its hashed form beside the mean embedding of its hashed character n-grams (blanks mark
its ends), so that unseen forms of a known stem are recognised. Two gated recurrent units read the words, one in either
direction; attention pools the states of a window's words; a linear layer gives the window's logit. A text's logit is the
greatest of all its overlapping windows, one at each word, and a logistic curve fitted on rows that training did not see
makes it a score.

Windows share the states of the words that they have in common: the units read a text in segments, beginning CONTEXT words
before each, and as pooling and the last layer are linear in the states, a window's logit is a sum over its words, weighted by
attention. So windows at all words cost two sliding sums. Training reads each window with CONTEXT words on either side.

Only texts are labelled, not windows, so training alternates: the windows that score highest in each text under the
present network stand for the text in the next round. Everything is trained in numpy on a bounded sample.

In a task, what a window needs of a word (its product with the input weights of both units) is computed once for each
word form of a batch and kept in a bounded cache; windows of many texts then go through the network together.

Defined results: null, empty and wordless texts get the score of a text without any evidence; long texts are scored whole,
window by window in bounded memory; equal texts get equal scores; an empty table gives an empty result; without labelled
rows of both classes every score is 0; other columns pass through ``filter_clean`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, map_batches, pick_sample, texts_of
from loomgraph.llm.lang_id import _BLANKS, ngram_buckets

#: Words of a window, of context that the units read before what counts, and of a segment that they read at a time.
WINDOW, CONTEXT, SEGMENT = 16, 8, 32
BITS = 16
GRAMS = (3, 4, 5)
WORD_DIM = CHAR_DIM = 8
HIDDEN = 8
#: Bound of the sample: documents of each class, and code points of a document in it.
SAMPLE_PER_CLASS = 1200
SAMPLE_MAX_CHARS = 12_000
#: Word forms that a task remembers; beyond that it forgets all and starts again.
CACHE_WORDS = 250_000
_NONE = 1 << BITS
#: Words with a row of their own: the most frequent of the sample, in at least so many of its documents.
KNOWN_WORDS, KNOWN_LEAST = 20_000, 5
_LETTERS = np.frombuffer(_BLANKS, np.uint8)


@dataclass
class Features:
    """Of a list of word forms: a 64-bit hash of each, and for each length of n-gram the buckets of all n-grams with the
    places where each form's begin."""

    hashes: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, forms: list[str]) -> Features:
        data = np.frombuffer("".join(f"\x00 {f} " for f in forms).lower().encode("utf-8", "replace"), np.uint8)
        cut = np.flatnonzero(data == 0)
        b = _LETTERS[data]
        begins = np.concatenate([cut, [len(b)]])
        size = np.diff(begins)
        letter = b != 32
        count = np.concatenate([[0], np.cumsum(letter)])
        place = count[:-1] - np.repeat(count[cut], size)
        mixed = (b.astype(np.uint64) + np.uint64(17)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD6E8FEB86659FD93))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed *= letter
        total = np.add.reduceat(mixed, cut) if len(cut) else np.zeros(0, np.uint64)
        grams = []
        for n in GRAMS:
            # A form's bytes begin with two blanks, of which the first only parts it from the form before.
            h = ngram_buckets(b, n, BITS) if len(b) >= n else np.zeros(0, np.uint32)
            at = np.flatnonzero(h < _NONE)
            grams.append((h[at].astype(np.int64), np.searchsorted(at, begins)))
        return cls(total ^ (total >> np.uint64(31)), grams)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams form by form, and where each form's begin."""
        owner = np.concatenate([np.repeat(np.arange(len(s) - 1), np.diff(s)) for _, s in self.grams])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([g for g, _ in self.grams])[order], np.searchsorted(owner[order], np.arange(len(self.hashes) + 1))


def _sum_by(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between consecutive ``begins``; an empty range gives zeros."""
    out = np.zeros((len(begins) - 1, values.shape[1]), values.dtype)
    full = begins[1:] > begins[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, begins[:-1][full], axis=0)
    return out


def n_windows(n_words: int) -> int:
    """Windows of a text: one at each word that has a whole window after it, or one for a shorter text."""
    return max(1, n_words - WINDOW + 1) if n_words else 0


def _slide(x: np.ndarray, op: np.ufunc) -> np.ndarray:
    """``op`` over WINDOW (a power of two) values from each place on; past the end as far as values reach."""
    out, width = x.copy(), 1
    while width < WINDOW:
        out[:-width] = op(out[:-width], out[width:])
        width *= 2
    return out


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray]
    known: np.ndarray  # sorted hashes of the words that have a row of their own
    scale: float = 1.0
    shift: float = 0.0
    fitted: bool = True

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        make = lambda *s, by=1.0: (rng.normal(0, by / np.sqrt(s[0]), s)).astype(np.float32)
        p = {"word": np.zeros((1, WORD_DIM), np.float32), "char": make(_NONE + 1, CHAR_DIM, by=20.0)}
        for k in ("f", "b"):
            p |= {"w" + k: make(d, 3 * h), "u" + k: make(h, 3 * h), "c" + k: np.zeros(3 * h, np.float32)}
        p |= {"wa": make(2 * h, h), "ba": np.zeros(h, np.float32), "v": make(h), "wo": make(2 * h), "bo": np.zeros(1, np.float32)}
        return cls(p, np.zeros(0, np.uint64))

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of the word table of each hash; the last row, zeros, for words that training did not keep."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return np.where(self.known[at] == hashes, at, len(self.known)) if len(self.known) else np.zeros(len(hashes), np.int64)

    def inputs(self, f: Features) -> np.ndarray:
        chars, n = np.zeros((len(f.hashes), CHAR_DIM), np.float32), np.zeros(len(f.hashes), np.float32)
        for grams, begins in f.grams:
            chars += _sum_by(self.p["char"][grams], begins)
            n += np.diff(begins)
        return np.concatenate([self.p["word"][self.word_rows(f.hashes)], chars / np.maximum(n, 1)[:, None]], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both units need of each input, side by side."""
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], axis=1).astype(np.float32)

    def attend(self, g: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of stretches ``ids`` (rows of ``g``; row 0 is padding), without the CONTEXT words at both ends: each word's weight
        before it is divided by its window's, and its state's share of a logit. ``keep`` gets what the backward pass needs.
        Stretches lie along the last axis throughout, so that every step works on long contiguous rows."""
        n, t = ids.shape
        h, side = HIDDEN, CONTEXT
        own = np.ascontiguousarray(g[ids.T].transpose(0, 2, 1))  # (t, 6h, n)
        states = np.empty((t - 2 * side, 2 * h, n), np.float32)
        full = bool((ids > 0).all())
        mask = (ids.T > 0).astype(np.float32)
        for k, steps, at, out in (("f", range(t - side), 0, 0), ("b", range(t - 1, side - 1, -1), 3 * h, h)):
            u, s = np.ascontiguousarray(self.p["u" + k].T), np.zeros((h, n), np.float32)
            for i in steps:
                gx, gh = own[i, at : at + 3 * h], u @ s
                zr = gx[: 2 * h] + gh[: 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:h], zr[h:]
                c = r * gh[2 * h :]
                c += gx[2 * h :]
                np.tanh(c, out=c)
                d = c - s
                d *= 1 - z
                if not full:
                    d *= mask[i]
                if keep is not None:
                    keep[k, i] = (s, z, r, c, gh[2 * h :], mask[i])
                s = s + d
                if side <= i < t - side:
                    states[i - side, out : out + h] = s
        act = np.tanh(np.ascontiguousarray(self.p["wa"].T) @ states + self.p["ba"][:, None])  # (words, h, n)
        # As act lies between -1 and 1, the weights neither vanish nor overflow.
        weight = np.exp(np.clip(np.einsum("h,thn->tn", self.p["v"], act), -60, 60)) * mask[side : t - side]
        if keep is not None:
            keep |= {"states": states, "act": act}
        return weight, np.einsum("d,tdn->tn", self.p["wo"], states)

    def run(self, g: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows ``ids``, each with CONTEXT words on either side."""
        weight, share = self.attend(g, ids, keep)
        a = weight / weight.sum(axis=0)
        if keep is not None:
            keep |= {"a": a, "pooled": np.einsum("tn,tdn->dn", a, keep["states"])}
        return (a * share).sum(axis=0) + self.p["bo"][0]

    def window_logits(self, g: np.ndarray, pieces: list[tuple[np.ndarray, int, int]], step: int = 1024) -> np.ndarray:
        """Logits of all windows of ``pieces``, one after another. A piece is its rows of ``g``, how many of them are context
        before its first window, and how many words its windows have; what follows is context as well."""
        lengths = np.array([-(-n // SEGMENT) * SEGMENT for _, _, n in pieces], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths + 2 * CONTEXT)])
        rows = np.zeros(begins[-1], np.int64)
        for (ids, before, _), at in zip(pieces, begins, strict=False):
            rows[at + CONTEXT - before : at + CONTEXT - before + len(ids)] = ids
        segments = np.concatenate([np.arange(at, at + n, SEGMENT) for at, n in zip(begins, lengths, strict=False)])
        weight, share = np.empty((len(segments), SEGMENT)), np.empty((len(segments), SEGMENT))
        offsets = np.arange(SEGMENT + 2 * CONTEXT)
        for lo in range(0, len(segments), step):
            w, q = self.attend(g, rows[segments[lo : lo + step, None] + offsets])
            weight[lo : lo + step], share[lo : lo + step] = w.T, q.T
        total = _slide(weight.reshape(-1), np.add)
        summed = _slide((weight * share).reshape(-1), np.add)
        first = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([np.arange(lo, lo + n_windows(n)) for lo, (_, _, n) in zip(first, pieces, strict=False)])
        return summed[at] / total[at] + float(self.p["bo"][0])

    def backward(self, x: np.ndarray, ids: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of each input row of ``x``."""
        p, h = self.p, HIDDEN
        t, side = ids.shape[1], CONTEXT
        states, act, a, pooled = (keep[k] for k in ("states", "act", "a", "pooled"))
        grad = {"wo": pooled @ dlogit, "bo": dlogit.sum(keepdims=True)}
        dpooled = p["wo"][:, None] * dlogit
        da = np.einsum("dn,tdn->tn", dpooled, states)
        ds = a[:, None, :] * dpooled
        de = a * (da - (a * da).sum(axis=0))
        grad["v"] = np.einsum("tn,thn->h", de, act)
        dact = de[:, None, :] * p["v"][:, None] * (1 - act * act)
        grad["wa"], grad["ba"] = np.einsum("tdn,thn->dh", states, dact), dact.sum(axis=(0, 2))
        ds += p["wa"] @ dact
        dx = np.zeros_like(x)
        for k, steps, lo in (("f", range(t - side - 1, -1, -1), 0), ("b", range(side, t), h)):
            w, u = p["w" + k], p["u" + k]
            gw, gu, gc = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * h, np.float32)
            carry = np.zeros((h, len(ids)), np.float32)
            for i in steps:
                s, z, r, c, ghc, m = keep[k, i]
                d = ds[i - side, lo : lo + h] + carry if side <= i < t - side else carry
                dc = d * (1 - z) * m * (1 - c * c)
                dz = d * (s - c) * m * z * (1 - z)
                dr = dc * ghc * r * (1 - r)
                dgx = np.concatenate([dz, dr, dc])
                dgh = np.concatenate([dz, dr, dc * r])
                gu += s @ dgh.T
                carry = d * (1 - m * (1 - z)) + u @ dgh
                gw += (dgx @ x[ids[:, i]]).T
                gc += dgx.sum(axis=1)
                np.add.at(dx, ids[:, i], (w @ dgx).T)
            grad |= {"w" + k: gw, "u" + k: gu, "c" + k: gc}
        return grad, dx

    def score(self, logits: np.ndarray) -> np.ndarray:
        # Rounded, as the last digits of a product may differ from batch to batch.
        return np.round(_sig(np.clip(self.scale * logits + self.shift, -30, 30)), 5) if self.fitted else np.zeros(len(logits))


class Scorer:
    """Scores texts with a bounded memory of word forms."""

    #: The logit of a text without words.
    NOTHING = -8.0

    def __init__(self, net: Network, step: int = 1024, cache_words: int = CACHE_WORDS):
        self.net, self.step, self.cache_words = net, step, cache_words
        self.at: dict[str, int] = {}
        self.g = np.zeros((1, 6 * HIDDEN), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.cache_words and self.at:
            self.at, self.g, new = {}, self.g[:1], list(words)
        if new:
            parts = [self.g]
            for lo in range(0, len(new), 20_000):
                parts.append(self.net.projected(self.net.inputs(Features.of(new[lo : lo + 20_000]))))
            self.at.update(zip(new, range(len(self.g), len(self.g) + len(new)), strict=True))
            self.g = np.concatenate(parts)

    def logits(self, texts: list[str], group: int = 200_000) -> np.ndarray:
        """The greatest logit of the windows of each text. Texts are taken in groups of about ``group`` words; a longer
        text goes through in pieces, which begin where segments do, so that its windows are the same in one piece as in many."""
        group = max(1, group // SEGMENT) * SEGMENT
        out = np.full(len(texts), self.NOTHING)
        pieces: list[tuple[list[str], int, int]] = []
        owner: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            words = text.replace("\x00", " ").split()
            windows = n_windows(len(words))
            for lo in range(0, windows, group):
                n = min(len(words), lo + min(group, windows - lo) - 1 + WINDOW) - lo
                before = min(CONTEXT, lo)
                piece = words[lo - before : lo + -(-n // SEGMENT) * SEGMENT + CONTEXT]
                if held and held + len(piece) > group:
                    self._flush(pieces, owner, out)
                    pieces, owner, held = [], [], 0
                pieces.append((piece, before, n))
                owner.append(i)
                held += len(piece)
        if pieces:
            self._flush(pieces, owner, out)
        return out

    def _flush(self, pieces: list[tuple[list[str], int, int]], owner: list[int], out: np.ndarray) -> None:
        self._learn(set().union(*(words for words, _, _ in pieces)))
        found = self.at.__getitem__
        logit = self.net.window_logits(self.g, [(np.array(list(map(found, words)), np.int64), before, n) for words, before, n in pieces], self.step)
        first = np.concatenate([[0], np.cumsum([n_windows(n) for _, _, n in pieces])[:-1]])
        np.maximum.at(out, owner, np.maximum.reduceat(logit, first))


def _start_from_counts(net: Network, features: Features, bags: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
    """Choose the words that get a row of their own, and give the first dimension of both embeddings the log-odds of
    occurring in a text of class 1, weakened where the counts are too few to tell."""
    grams, begins = features.flat()
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    hashes, form = np.unique(features.hashes, return_inverse=True)
    words = np.zeros((2, len(hashes)))
    chars = np.zeros((2, _NONE + 1))
    for bag, label in zip(bags, y, strict=True):
        words[int(label), np.unique(form[bag])] += 1
        size = begins[bag + 1] - begins[bag]
        cut = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(_NONE + 1, bool)
        seen[grams[np.arange(cut[-1]) - np.repeat(cut[:-1] - begins[bag], size)]] = True
        chars[int(label)] += seen

    def log_odds(neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
        a, b = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
        z = np.abs(a - b) / np.sqrt(a * (1 - a) / n1 + b * (1 - b) / n0 + 1e-12)
        return 0.5 * np.clip(np.log(a) - np.log(b), -4, 4) * np.minimum(1, (z / 5) ** 2)

    often = np.argsort(-words.sum(axis=0), kind="stable")[:KNOWN_WORDS]
    often = np.sort(often[words.sum(axis=0)[often] >= KNOWN_LEAST])
    net.known = hashes[often]
    net.p["word"] = rng.normal(0, 0.1, (len(often) + 1, WORD_DIM)).astype(np.float32)
    net.p["word"][:-1, 0] = log_odds(*words[:, often])
    net.p["word"][-1] = 0
    net.p["char"][:, 0] = log_odds(*chars)


def fit(rows: list[tuple[str, int]], rounds: int = 4, seed: int = 11) -> Network:
    """Train on (text, 0 or 1) rows. Every fifth row is kept for the curve from logit to score."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if len({c for _, c in rows}) < 2:
        net.fitted = False
        return net
    index: dict[str, int] = {}
    texts = [np.array([index.setdefault(w, len(index)) for w in t.replace("\x00", " ").split()], np.int64) for t, _ in rows]
    if not index:
        net.fitted = False
        return net
    features = Features.of(list(index))
    grams, begins = features.flat()
    y = np.array([c for _, c in rows])
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    _start_from_counts(net, features, [np.unique(t) for t, h in zip(texts, held, strict=True) if not h], y[~held], rng)
    word = net.word_rows(features.hashes)
    # All words one after another, with so much padding in between that no window with its context reaches the next text.
    gap = np.zeros(WINDOW + CONTEXT, np.int64)
    flat = np.concatenate([gap] + [x for t in texts for x in (t + 1, gap)])
    at = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts])[:-1]
    count = np.array([n_windows(len(t)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), count)
    wins = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(at, count, strict=True)])
    around = np.arange(-CONTEXT, WINDOW + CONTEXT)

    def table(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the forms ``own`` after a row of padding; their n-grams, and how many each has and where."""
        size = begins[own + 1] - begins[own]
        cut = np.concatenate([[0], np.cumsum(size)])
        mine = grams[np.arange(cut[-1]) - np.repeat(cut[:-1] - begins[own], size)]
        chars = _sum_by(net.p["char"][mine], cut) / np.maximum(size, 1)[:, None].astype(np.float32)
        x = np.concatenate([net.p["word"][word[own]], chars], axis=1)
        return np.concatenate([np.zeros((1, x.shape[1]), np.float32), x]), mine, size, cut

    def window_logits() -> np.ndarray:
        g = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), net.projected(net.inputs(features))])
        return net.window_logits(g, [(t + 1, 0, len(t)) for t in texts if len(t)])

    def top(score: np.ndarray) -> np.ndarray:
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, owner, score)
        return best

    dense = [k for k in net.p if k not in ("word", "char")]
    m = {k: np.zeros_like(net.p[k]) for k in dense}
    v = {k: np.zeros_like(net.p[k]) for k in dense}
    acc = {k: np.zeros(len(net.p[k]), np.float32) for k in ("word", "char")}
    step = 0
    # The first round's guess: the word of a window with the highest log-odds. Many windows hold it; a few stand for their text.
    x = net.inputs(features)
    guess = np.concatenate([[-9.0], x[:, 0] + x[:, WORD_DIM]])
    score = _slide(guess[flat], np.maximum)[wins] - 1e-3 * rng.integers(0, 4, len(wins))
    for _ in range(rounds):
        best = top(score)
        is_best = score >= best[owner] - 1e-9
        lucky = rng.random(len(wins)) < 4 * len(rows) / max(1, len(wins))
        chosen = np.flatnonzero(~held[owner] & (is_best | (lucky & (y[owner] == 0))))
        wy = y[owner[chosen]].astype(np.float32)
        weight = np.where(wy > 0, len(wy) / max(1, 2 * wy.sum()), len(wy) / max(1, 2 * (len(wy) - wy.sum()))).astype(np.float32)
        for _epoch in range(3):
            order = rng.permutation(len(chosen))
            for lo in range(0, len(order), 128):
                pick = order[lo : lo + 128]
                ids, back = np.unique(flat[wins[chosen[pick], None] + around], return_inverse=True)
                if ids[0] != 0:
                    ids, back = np.concatenate([[0], ids]), back + 1
                back = back.reshape(-1, len(around))
                own = ids[1:] - 1
                xs, mine, size, _ = table(own)
                g = net.projected(xs)
                g[0] = 0
                keep: dict = {}
                logit = net.run(g, back, keep)
                d = ((_sig(logit) - wy[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grad, dx = net.backward(xs, back, keep, d)
                step += 1
                for k in dense:
                    gk = grad[k].reshape(net.p[k].shape)
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.99 * v[k] + 0.01 * gk * gk
                    net.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                dx = dx[1:]
                dchar = np.repeat(dx[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0)
                for k, at, val in (("word", word[own], dx[:, :WORD_DIM]), ("char", mine, dchar)):
                    np.add.at(acc[k], at, (val * val).mean(axis=1))
                    np.add.at(net.p[k], at, (-0.05 * val / (np.sqrt(acc[k][at]) + 1e-4)[:, None]).astype(np.float32))
                net.p["word"][-1] = 0
        score = window_logits()
    best = np.maximum(top(score), Scorer.NOTHING)
    cal = held if held.any() and len(set(y[held])) == 2 else np.ones(len(rows), bool)
    z, c = best[cal], y[cal].astype(float)
    # Smoothed targets keep the curve finite where the classes do not overlap.
    target = np.where(c > 0, (c.sum() + 1) / (c.sum() + 2), 1 / ((1 - c).sum() + 2))
    w = np.where(c > 0, 0.5 / max(1, c.sum()), 0.5 / max(1, (1 - c).sum()))
    a, b = 1.0, 0.0
    for _ in range(100):
        pr = _sig(np.clip(a * z + b, -30, 30))
        r, q = w * (pr - target), w * pr * (1 - pr) + 1e-9
        hess = np.array([[np.sum(q * z * z) + 1e-6, np.sum(q * z)], [np.sum(q * z), np.sum(q) + 1e-6]])
        da, db = np.linalg.solve(hess, [np.sum(r * z), np.sum(r)])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -3, 3)
    net.scale, net.shift = max(0.05, float(a)), float(b)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_MAX_CHARS) -> Network:
    """A network fitted on a bounded sample of ``docs(doc_id, text)`` labelled by ``labels(doc_id, toxic)``."""
    rows = pick_sample(docs, labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("class")), per_class, max_chars)
    return fit([(r["text"], int(r["class"])) for r in rows])


def score(docs: DataFrame, net: Network, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, with ``score`` and ``predicted``, from the whole ``text``."""
    arrow_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").alias("_llm_text"))
    schema = docs.select(*keep).schema.simpleString()[7:-1] + ",score double,predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed tables of 2**BITS rows

    def make():
        scorer = Scorer(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = scorer.net.score(scorer.logits(texts_of(batch.column("_llm_text"))))
            columns = [batch.column(c) for c in keep] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

        return work

    return map_batches(source, make, schema)


def filter_clean(docs: DataFrame, net: Network, cache_words: int = CACHE_WORDS) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with all their columns and nothing else. A worker needs some 350 bytes for each
    word that it remembers; scores do not depend on how many."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = Scorer(shared.value, cache_words=cache_words)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scorer.net.score(scorer.logits(texts_of(batch.column("text")))) < 0.5))

        return work

    return map_batches(docs, make, docs.schema)
