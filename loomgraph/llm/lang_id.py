"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every byte n-gram inside a word (one neighbouring blank on either side belongs to it) is hashed into a bucket; a text
is the mean of its buckets' embeddings, classified by a linear softmax. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample.

Confidence is calibrated on rows of the sample that training did not see, and on foreign texts made of them: the same words
with their letters exchanged for others of the alphabet, in shuffled order, or moved to another script. A softmax alone is
sure of any text, so confidence is the softmax at a fitted temperature times a logistic curve of the share of the text's
n-grams that training has met, fitted to tell held rows from foreign ones. A text is rejected below the confidence that parts
right answers from foreign texts best, where one right answer turned away weighs as much as REJECT_WEIGHT foreign texts kept.

As the softmax is linear, mean(E[ids]) @ W = mean((E @ W)[ids]): tasks get the product table only, so that a text costs
one table row per n-gram whatever the embedding's width.

Defined results: null, empty or letterless text -> ``und`` with score 0 and rejected; very long texts are read whole, in
steps of bounded size; repeated rows get the same answer; an empty table gives an empty result; other columns of the
input pass through ``filter_known`` untouched and do not influence anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_batches, map_batches, pick_sample, texts_of

NGRAMS = (2, 3, 4)
BITS = 15
DIM = 16
#: Bound of the sample: documents of each language, and code points of a document in it.
SAMPLE_PER_LANGUAGE = 500
SAMPLE_MAX_CHARS = 20_000
#: What a right answer that is turned away costs, in foreign texts that are kept.
REJECT_WEIGHT = 50
#: Times that training has to meet an n-gram before it counts as known.
KNOWN_LEAST = 2
UNKNOWN = "und"

# ASCII other than letters is a blank; upper case has been lowered before.
_BLANKS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SALT = tuple(np.uint32(0x9E3779B1 * (n + 3) & 0xFFFFFFFF | 1) for n in range(8))


def letters_only(text: str) -> bytes:
    """Lower-cased UTF-8 with a blank in place of every ASCII character that is not a letter, and blanks at both ends."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_BLANKS) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_buckets(b: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Bucket of the n-gram beginning at each byte but the last n - 1; 2**bits where it spans more than one word."""
    m = len(b) - n + 1
    h = np.zeros(m, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h ^= b[i : i + m].astype(np.uint32)
    h *= _SALT[n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - bits)
    blank = b == 32
    bad = blank[:m] & blank[1 : m + 1] if n == 2 else np.zeros(m, bool)
    for i in range(1, n - 1):
        bad = bad | blank[i : i + m]
    h[bad] = 1 << bits
    return h


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (2**bits + 1, languages + 1): by n-gram, then whether training knows it; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float
    slope: float = 0.0  # of confidence by the share of known n-grams
    middle: float = 0.0

    def raw(self, datas: list[bytes], step: int = 1 << 19) -> np.ndarray:
        """Logits of each text of ``letters_only`` bytes, and in the last column its share of known n-grams."""
        k = self.logits.shape[1]
        total, count = np.zeros((len(datas), k)), np.zeros(len(datas))
        if not datas:
            return total
        b = np.frombuffer(b"".join(datas), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(d) for d in datas])])
        for lo in range(0, len(b), step):
            hi = min(len(b), lo + step)
            first = int(np.searchsorted(begins, lo, side="right")) - 1
            last = int(np.searchsorted(begins, hi, side="left"))
            cut = np.maximum(begins[first:last], lo) - lo
            for n in NGRAMS:
                ids = ngram_buckets(b[lo : min(len(b), hi + n - 1)], n)
                if len(ids) < hi - lo:
                    ids = np.concatenate([ids, np.full(hi - lo - len(ids), len(self.logits) - 1, np.uint32)])
                total[first:last] += np.add.reduceat(self.logits[ids], cut, axis=0)
                count[first:last] += np.add.reduceat((ids < len(self.logits) - 1).astype(np.int64), cut)
        return total / np.maximum(count, 1)[:, None] + np.append(self.bias, 0.0)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        """Of each language, given that it is one of them."""
        z = raw[:, :-1] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def familiar(self, raw: np.ndarray) -> np.ndarray:
        """How likely it is one of them."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw[:, -1] - self.middle), -30, 30))) if self.slope else np.ones(len(raw))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated confidence and rejection of each text."""
        known = np.fromiter((has_letter(t) for t in texts), bool, len(texts)) & bool(self.languages)
        at = np.flatnonzero(known)
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(at):
            raw = self.raw([letters_only(texts[i]) for i in at])
            p = self.probabilities(raw)
            score[at] = np.clip(p.max(axis=1) * self.familiar(raw), 0.0, 1.0)
            for i, c in zip(at, p.argmax(axis=1), strict=True):
                labels[i] = self.languages[c]
        return labels, score, ~known | (score < self.threshold)


def _segments(texts: list[str], rng: np.random.Generator) -> list[np.ndarray]:
    """Bucket ids of one training example for each text: as often a few words of it as much of it."""
    out = []
    for t in texts:
        words = t.split()
        n = max(1, min(len(words), int(2 ** rng.uniform(0, 8))))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        b = np.frombuffer(letters_only(" ".join(words[at : at + n])), np.uint8)
        ids = np.concatenate([ngram_buckets(b, g) for g in NGRAMS if len(b) >= g])
        out.append(ids[ids < 1 << BITS].astype(np.int64))
    return out


def foreign(text: str, rng: np.random.Generator) -> list[str]:
    """Texts of no learnt language, as long as ``text``: letters exchanged, letters shuffled, letters of another script."""
    alphabet = bytes(range(97, 123)).decode()
    exchange = str.maketrans(alphabet, "".join(alphabet[i] for i in rng.permutation(26)))
    order = rng.permutation(len(text))
    script = int(rng.choice([0x0410, 0x0531, 0x0E01, 0x10A0, 0x3041, 0x4E00]))
    return [text.lower().translate(exchange), "".join(text[i] for i in order), "".join(chr(script + ord(c) % 32) if c.isalpha() else c for c in text)]


def _logistic(x: np.ndarray, one: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the curve that tells the rows ``one`` from the others by ``x``; targets are smoothed, so that the
    slope stays finite where they do not overlap. No curve (0, 0) where ``x`` does not tell them apart."""
    n1, n0 = int(one.sum()), int((~one).sum())
    if not n1 or not n0 or x[one].mean() <= x[~one].mean():
        return 0.0, 0.0
    target = np.where(one, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(one, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, q = weight * (p - target), weight * p * (1 - p) + 1e-9
        hess = np.array([[np.sum(q * x * x) + 1e-6, np.sum(q * x)], [np.sum(q * x), np.sum(q) + 1e-6]])
        da, db = np.linalg.solve(hess, [np.sum(r * x), np.sum(r)])
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
    return (float(a), float(-b / a)) if a > 0 else (0.0, 0.0)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> LanguageModel:
    """Train on (text, language) rows. Every fifth row is kept for calibration."""
    languages = sorted({lang for _, lang in rows})
    k, size = len(languages), 1 << BITS
    if not k:
        return LanguageModel([], np.zeros((size + 1, 2), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    train = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 20]
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    emb = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    w += rng.normal(0, 0.1, w.shape)
    y_of = {lang: i for i, lang in enumerate(languages)}
    share = np.bincount([y_of[lang] for _, lang in train], minlength=k) / len(train)
    weight = 1 / np.maximum(k * share, 0.05)
    batch = 32
    steps = epochs * max(1, -(-len(train) // batch))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for lo in range(0, len(order), batch):
            chosen = [train[i] for i in order[lo : lo + batch]]
            segments = _segments([t for t, _ in chosen], rng)
            keep = [i for i, s in enumerate(segments) if len(s)]
            done += 1
            if not keep:
                continue
            ids = np.concatenate([segments[i] for i in keep])
            n = np.array([len(segments[i]) for i in keep])
            y = np.array([y_of[chosen[i][1]] for i in keep])
            h = np.add.reduceat(emb[ids], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
            z = h @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None] / len(y)
            lr = rate * (1 - done / (steps + 1))
            dh = (p @ w.T) / n[:, None] * len(y)
            w -= lr * (h.T @ p)
            bias -= 0.1 * lr * p.sum(axis=0)
            np.add.at(emb, ids, np.repeat((-lr * dh).astype(np.float32), n, axis=0))
    table = np.zeros((size + 1, k + 1), np.float32)
    table[:size, :k] = emb @ w
    met = np.zeros(size + 1, np.int64)
    for t, _ in train:
        b = np.frombuffer(letters_only(t), np.uint8)
        for g in NGRAMS:
            if len(b) >= g:
                met += np.bincount(ngram_buckets(b, g), minlength=size + 1)
    table[:size, k] = met[:size] >= KNOWN_LEAST
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0)
    held = [r for r in held if has_letter(r[0])]
    if held:
        # Confidence has to hold for short texts too: calibrate on whole rows and on a few words of each.
        few = [(" ".join(t.split()[:4]), lang) for t, lang in held]
        cal = held + [r for r in few if has_letter(r[0])]
        raw = model.raw([letters_only(t) for t, _ in cal])
        y = np.array([y_of[lang] for _, lang in cal])
        grid = np.exp(np.linspace(np.log(0.005), np.log(20), 90))

        def loss(t: float) -> float:
            z = raw[:, :-1] / t
            z = z - z.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))

        model.temperature = float(min(grid, key=loss))
        other = model.raw([letters_only(f) for t, _ in cal for f in foreign(t, rng) if has_letter(f)])
        share = np.concatenate([raw[:, -1], other[:, -1]])
        own = np.arange(len(share)) < len(raw)
        model.slope, model.middle = _logistic(share, own)
        p = model.probabilities(raw)
        right = np.sort((p.max(axis=1) * model.familiar(raw))[p.argmax(axis=1) == y])
        wrong = np.sort(model.probabilities(other).max(axis=1) * model.familiar(other))
        if len(right) and len(wrong):
            every = np.unique(np.concatenate([[0.0], right, wrong, [1.0]]))
            limits = np.concatenate([[0.0], (every[1:] + every[:-1]) / 2])
            turned = np.searchsorted(right, limits) / len(right)
            kept = 1 - np.searchsorted(wrong, limits) / len(wrong)
            model.threshold = float(limits[np.argmin(REJECT_WEIGHT * turned + kept)])
    return model


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, max_chars: int = SAMPLE_MAX_CHARS) -> LanguageModel:
    """A model fitted on a bounded sample of the labelled rows of ``docs(doc_id, text, lang)``."""
    rows = pick_sample(docs.select("doc_id", "text", F.col("lang").alias("class")), None, per_language, max_chars)
    return fit([(r["text"], r["class"]) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, with ``lang_pred``, ``score`` and ``rejected``, from the whole ``text``."""
    arrow_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").alias("_llm_text"))
    schema = docs.select(*keep).schema.simpleString()[7:-1] + ",lang_pred string,score double,rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of 2**BITS rows, whatever the corpus

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, score, rejected = fitted.predict(texts_of(batch.column("_llm_text")))
            columns = [batch.column(c) for c in keep] + [pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])

        return work

    return map_batches(source, make, schema)


def filter_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns and nothing else."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, _, rejected = fitted.predict(texts_of(batch.column("text")))
            return batch.filter(pa.array(~rejected))

        return work

    return map_batches(docs, make, docs.schema)
