"""Language identification with a linear-chain conditional random field over words.

Emissions come from hashed affixes, character n-grams and a lexicon of frequent training words;
transitions between word labels are learned with them, on training sequences stitched from stretches of
different languages, so that code-switched text is labelled word by word. A document's language is the one
with the largest mean marginal of its words, by forward-backward over the whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm.base import column, steps

UNKNOWN = "und"
#: The fit's bounds: labelled rows, words taken from each, words in the lexicon, hashed features.
ROWS, STRETCH, LEXICON, FEATURES = 3000, 48, 20_000, 1 << 16
#: Words whose emissions a worker remembers; words of one chunk of the forward-backward.
REMEMBERED, CHUNK = 300_000, 128
_TEXT_STEP = 1 << 20


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES + lexicon, labels)
    lexicon: dict[str, int]
    moves: np.ndarray  # (labels, labels), from row to column


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _stretches(length: int):
    """One stretch of words from a pseudo-random place of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts, langs, codes = (column(batch, c).to_pylist() for c in ("text", "lang", "code"))
            out = []
            for t, c in zip(texts, codes, strict=True):
                words = [w for w in t.lower().split() if _letters(w)]
                at = c % max(1, len(words) - length + 1)
                out.append(words[at : at + length])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["lang", "words"])

    return run


def training_rows(docs: DataFrame, rows: int = ROWS, length: int = STRETCH) -> list[tuple[str, list[str]]]:
    """(lang, words) of at most ``rows`` labelled documents outside the held-out quarter, drawn by a hash."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    drawn = usable.select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("code"))
    # First the threshold, by hashes alone; then the texts below it: no text travels to be sorted out.
    share = drawn.select("code").orderBy("code").limit(rows).agg(F.max("code")).first()[0]
    if share is None:
        return []
    picked = drawn.filter(F.col("code") <= share).mapInArrow(_stretches(length), "lang string, words array<string>")
    return sorted((r["lang"], list(r["words"])) for r in picked.limit(rows).collect() if r["words"])


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature numbers of a word as it stands in the text, lower-cased; none without a letter."""
    w = _letters(word)
    if not w:
        return []
    n, mask, crc = len(w), FEATURES - 1, zlib.crc32
    names = [f"p{w[:k]}" for k in (1, 2, 3, 4) if k <= n] + [f"s{w[-k:]}" for k in (1, 2, 3, 4) if k <= n]
    edged = f"<{w}>"
    names += [edged[i : i + 2] for i in range(n + 1)] + [edged[i : i + 3] for i in range(n)]
    out = [crc(x.encode()) & mask for x in names]
    if w in lexicon:
        out.append(FEATURES + lexicon[w])
    return out


def _emissions(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x labels) and which words have a letter."""
    feats = [features(w, model.lexicon) for w in words]
    sizes = np.fromiter(map(len, feats), np.int64, len(feats))
    out = np.zeros((len(words), len(model.labels)), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((x for f in feats for x in f), np.int64, int(sizes.sum()))
        at = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(model.weights[flat], at, axis=0) / np.sqrt(sizes[full])[:, None]
    return out, sizes > 0


def fit(rows: list[tuple[str, list[str]]], epochs: int = 8, rate: float = 0.5, seed: int = 5) -> Model:
    """Maximises the likelihood of word labels by stochastic gradients (scaled per weight) over sequences
    that are stitched from quarters of stretches of different documents."""
    labels = sorted({lang for lang, _ in rows})
    counts = Counter(w for _, ws in rows for w in {_letters(x) for x in ws})
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n >= 3}
    n_l = len(labels)
    model = Model(labels, np.zeros((FEATURES + len(lexicon), n_l), np.float32), lexicon, np.zeros((n_l, n_l)))
    if n_l < 2:
        return model
    rng = np.random.default_rng(seed)
    code = {x: i for i, x in enumerate(labels)}
    quarter = max(1, STRETCH // 4)
    parts = [(code[lang], ws[i : i + quarter]) for lang, ws in rows for i in range(0, len(ws), quarter) if len(ws) - i >= min(quarter, len(ws))]
    distinct = sorted({w for _, ws in parts for w in ws})
    index = {w: i for i, w in enumerate(distinct)}
    feats = [np.array(features(w, lexicon), np.int64) for w in distinct]
    parts = [(c, np.array([index[w] for w in ws])) for c, ws in parts]
    seen, seen_moves = np.full(model.weights.shape, 1e-2, np.float32), np.full((n_l, n_l), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        # Pairs of parts of one document make a label last, others make it switch: both occur.
        for at in range(0, len(order), 256):
            batch = [parts[i] for i in order[at : at + 256]]
            seqs = [batch[i : i + 4] for i in range(0, len(batch), 4)]
            words = [np.concatenate([w for _, w in s]) for s in seqs]
            gold = [np.concatenate([np.full(len(w), c) for c, w in s]) for s in seqs]
            flat, truth = np.concatenate(words), np.concatenate(gold)
            used, place = np.unique(flat, return_inverse=True)
            ids = [feats[i] for i in used]
            sizes = np.array([len(x) for x in ids])
            cat = np.concatenate(ids)
            head = np.cumsum(sizes) - sizes
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            scores = np.add.reduceat(model.weights[cat], head, axis=0) * scale[:, None]
            first = np.append(0, np.cumsum([len(w) for w in words]))
            marginal, pairs = forward_backward(scores[place], first, model.moves, want_pairs=True)
            error = marginal
            error[np.arange(len(truth)), truth] -= 1
            by_word = np.zeros((len(used), n_l))
            np.add.at(by_word, place, error)
            grad = np.repeat(by_word * scale[:, None], sizes, axis=0)
            rows_used, back = np.unique(cat, return_inverse=True)
            total = np.zeros((len(rows_used), n_l))
            np.add.at(total, back, grad)
            total = total / len(seqs) + 1e-5 * model.weights[rows_used]
            seen[rows_used] += total**2
            model.weights[rows_used] -= rate * total / np.sqrt(seen[rows_used])
            inner = np.ones(len(truth), bool)
            inner[first[1:] - 1] = False
            np.subtract.at(pairs, (truth[:-1][inner[:-1]], truth[1:][inner[:-1]]), 1)
            pairs /= len(seqs)
            seen_moves += pairs**2
            model.moves -= rate * 0.2 * pairs / np.sqrt(seen_moves)
    return model


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, want_pairs: bool = False):
    """Marginals of the labels of all words of many texts; ``first`` has the first word of each (and the end).

    Texts are cut into chunks that advance together: the product of a chunk's matrices carries messages
    across it, so long texts take no more steps than short ones and the result is that of one long chain.
    """
    n, n_l = scores.shape
    if not n:
        return (np.zeros((0, n_l)), np.zeros((n_l, n_l))) if want_pairs else np.zeros((0, n_l))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(moves - moves.max())
    lengths = np.diff(first)
    n_chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), n_chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = first[:-1][owner] + nth * CHUNK
    size = np.minimum(first[1:][owner] - start, CHUNK)
    by_size = np.argsort(-size, kind="stable")
    s, z = start[by_size], size[by_size]
    k = len(s)
    active = [int(np.searchsorted(-z, -t, "left")) for t in range(int(z[0]))]  # chunks longer than t
    # 1: the matrix of each chunk, from the label before it to the label of its last word
    m = np.repeat(np.eye(n_l)[None], k, axis=0)
    for t, n_a in enumerate(active):
        step = (m[:n_a].reshape(-1, n_l) @ a).reshape(n_a, n_l, n_l) * e[s[:n_a] + t][:, None, :]
        m[:n_a] = step / step.max(axis=(1, 2), keepdims=True)
    matrix = np.empty_like(m)
    matrix[by_size] = m
    # 2: messages into each chunk, text by text
    into, after = np.ones((k, n_l)), np.ones((k, n_l))
    base = np.cumsum(n_chunks) - n_chunks
    longest = np.argsort(-n_chunks, kind="stable")
    base_l, count_l = base[longest], n_chunks[longest]
    for c in range(1, int(count_l[0])):
        live = base_l[count_l > c] + c
        x = np.einsum("ki,kij->kj", into[live - 1], matrix[live - 1])
        into[live] = x / x.sum(axis=1, keepdims=True)
    for c in range(2, int(count_l[0]) + 1):
        sel = count_l >= c
        live = base_l[sel] + count_l[sel] - c
        x = np.einsum("kij,kj->ki", matrix[live + 1], after[live + 1])
        after[live] = x / x.sum(axis=1, keepdims=True)
    # 3: forward and backward inside all chunks. "into" is a label before the chunk; moves apply at every word
    alpha = np.zeros((n, n_l))
    x = into[by_size]
    for t, n_a in enumerate(active):
        y = (x[:n_a] @ a) * e[s[:n_a] + t]
        y /= y.sum(axis=1, keepdims=True)
        alpha[s[:n_a] + t] = y
        x[:n_a] = y
    beta = np.zeros((n, n_l))
    x = after[by_size]
    for t in range(len(active) - 1, -1, -1):
        n_a = active[t]
        beta[s[:n_a] + t] = x[:n_a]
        y = (x[:n_a] * e[s[:n_a] + t]) @ a.T
        x[:n_a] = y / y.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    if not want_pairs:
        return marginal
    inner = np.ones(n, bool)
    inner[first[1:][lengths > 0] - 1] = False
    i = np.flatnonzero(inner)
    joint = alpha[i][:, :, None] * a[None] * (e[i + 1] * beta[i + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return marginal, joint.sum(axis=0)


class Labeller:
    """Labels texts; the emissions of words are remembered between batches."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self._index: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.model.labels)), np.float32)
        self._real = np.zeros(0, bool)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts (words with a letter only) and the first of each text."""
        split = [t.lower().split() if t else [] for t in texts]
        if len(self._index) > REMEMBERED:
            self._clear()
        new = list(set().union(*split).difference(self._index))
        if new:
            scores, real = _emissions(new, self.model)
            at = len(self._index)
            self._index.update(zip(new, range(at, at + len(new)), strict=True))
            self._scores, self._real = np.concatenate([self._scores, scores]), np.concatenate([self._real, real])
        lookup = self._index.__getitem__
        numbers = np.fromiter((i for s in split for i in map(lookup, s)), np.int64, sum(map(len, split)))
        first = np.append(0, np.cumsum([len(s) for s in split])).astype(np.int64)
        real = self._real[numbers]
        kept = np.append(0, np.cumsum(real))
        return numbers[real], kept[first]

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        numbers, first = self.words(texts)
        return forward_backward(self._scores[numbers], first, self.model.moves), first

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 without a letter (or without a trained label)."""
        if not self.model.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        marginal, first = self.marginals(texts)
        sums = np.concatenate([np.zeros((1, len(self.model.labels))), np.cumsum(marginal, axis=0)])
        n = np.diff(first)
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        names = [self.model.labels[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, np.clip(mean[np.arange(len(n)), best], 0, 1), 0.0)

    def certainty(self, texts: list[str | None]) -> np.ndarray:
        """Mean of each word's largest marginal: near 1 for words of one language or several, all told with
        certainty. 0 without a letter; without a trained label nothing can be told, and a letter is enough for 1."""
        if not self.model.labels:
            return np.array([float(any(c.isalpha() for c in t or "")) for t in texts])
        marginal, first = self.marginals(texts)
        sums = np.append(0, np.cumsum(marginal.max(axis=1)))
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


def _labels(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in steps(batches, limit=_TEXT_STEP):
            names, scores = labeller.label(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def label(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred and score (0 to 1).

    Null texts and texts without a letter are UNKNOWN with score 0; only the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (FEATURES + LEXICON) rows of labels at most
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_labels(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _recognised(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in steps(batches, limit=_TEXT_STEP):
            certain = labeller.certainty(column(batch, "text").to_pylist())
            yield batch.filter(pa.array((certain > 0) & (certain >= least), pa.bool_()))

    return run


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose words' languages are known with certainty ``least``, be it one language or
    several, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_recognised(shared, least), docs.schema)
