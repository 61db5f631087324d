"""Operator 7: toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import EDGE, fold, tidied

SPANS = "array<struct<start:int,end:int,p:double>>"
STEP = 64


def features(word: str) -> tuple[str, ...]:
    """A token's own features: the word without edge punctuation, in lower case, and its first 3, 4 and 5 letters."""
    w = word.strip(EDGE).lower()
    return ("w=" + w, "3=" + w[:3], "4=" + w[:4], "5=" + w[:5]) if len(w) > 2 else ("w=" + w,)


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) for all t, with r[-1] = 1; exact, in blocks of STEP.

    The maps compose as 2 x 2 matrices: all blocks advance together one position at a time, then a short loop
    carries r from block to block.
    """
    n = len(a)
    if not n:
        return a
    blocks = -(-n // STEP)
    pad = blocks * STEP - n
    m = [np.concatenate((x, np.full(pad, fill))).reshape(blocks, STEP).T for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    out = np.empty((4, STEP, blocks))
    p = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(STEP):
        a, b, c, d = (x[j] for x in m)
        p = a * p[0] + b * p[2], a * p[1] + b * p[3], c * p[0] + d * p[2], c * p[1] + d * p[3]
        top = p[0] + p[1] + p[2] + p[3]
        p = tuple(x / top for x in p)
        out[:, j] = p
    enter = np.empty(blocks)
    r = 1.0
    for k, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in p))):
        enter[k] = r
        r = (a * r + b) / (c * r + d)
    return ((out[0] * enter + out[1]) / (out[2] * enter + out[3])).T.reshape(-1)[:n]


class Field:
    """A two-state chain: u[t] is the weight of state 1 at token t, trans[i, j] that of i followed by j."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, calibration: tuple[float, float], prior: float):
        self.weights, self.bias, self.trans, self.calibration, self.prior = weights, bias, trans, calibration, prior

    def unary(self, words: list[str], memo: dict[str, float], most: int = 60_000) -> np.ndarray:
        """Weights of the words; ``memo`` is the caller's, for words that recur, and is emptied at ``most``."""
        get = self.weights.get
        if len(memo) > most:
            memo.clear()
        out = []
        for w in words:
            u = memo.get(w)
            if u is None:
                u = self.bias + sum(get(f, 0.0) for f in features(w))
                if len(w) <= 64:
                    memo[w] = u
            out.append(u)
        return np.array(out, np.float64)

    @staticmethod
    def ratios(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of state 1 at each token; ``first`` marks the tokens that begin a text."""
        e, t = np.exp(np.clip(u, -40, 40)), np.exp(trans)
        start = first.astype(bool)
        fwd = chain(np.where(start, 0, e * t[1, 1]), np.where(start, e, e * t[0, 1]), np.where(start, 0, t[1, 0]), np.where(start, 1, t[0, 0]))
        end = np.concatenate((start[1:], [True]))[::-1] if len(u) else start
        nxt = np.concatenate((e[1:], [1.0]))[::-1] if len(u) else e
        bwd = chain(np.where(end, 0, nxt * t[1, 1]), np.where(end, 1, t[1, 0]), np.where(end, 0, nxt * t[0, 1]), np.where(end, 1, t[0, 0]))
        return fwd, bwd[::-1]

    def marginals(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        fwd, bwd = self.ratios(u, first, self.trans)
        odds = fwd * bwd
        return odds / (1 + odds)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Document probability from -sum(log(1 - p)): the noisy-or of the token marginals, calibrated."""
        if self.calibration is None:
            return np.full(len(evidence), self.prior)
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * _logit(evidence) + b, -50, 50)))


def _logit(evidence: np.ndarray) -> np.ndarray:
    """log odds of 1 - exp(-evidence), kept finite."""
    e = np.clip(evidence, 1e-9, 30)
    return np.log(np.expm1(e))


def _evidence(p: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(owner, -np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs)


def seeds(words: Iterable[set[str]], toxic: np.ndarray) -> set[str]:
    """Features that stand for the toxic documents: log-likelihood ratio above twice the log of their number, 9 in 10 toxic.

    These label the tokens from which the field learns: a token of a toxic document that has one is a toxic token.
    """
    inside, outside = Counter(), Counter()
    for own, t in zip(words, toxic):
        (inside if t else outside).update(own)
    a_all, b_all = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    share = a_all / (a_all + b_all)
    out = set()
    least = 2 * np.log(max(2, len(inside)))
    for f, a in inside.items():
        b = outside.get(f, 0)
        if a < 3 or a < 9 * b:
            continue
        n = a + b
        g = 2 * (a * np.log(a / (n * share)) + (b * np.log(b / (n * (1 - share))) if b else 0))
        if g > least:
            out.add(f)
    return out


def copies(cut: Iterable[list[str]], hashes: int = 3) -> np.ndarray:
    """Marks texts that share most of their least three-word shingle hashes with an earlier text of the sample.

    Copies of one text are one witness; counted as many they would make its chance words look like evidence.
    """
    first: dict[tuple[int, int], int] = {}
    out = []
    for i, words in enumerate(cut):
        runs = (" ".join(words[j : j + 3]).encode("utf-8", "replace") for j in range(max(1, len(words) - 2)))
        crcs = np.fromiter(map(zlib.crc32, runs), np.uint64)
        own = [(k, int(((crcs * np.uint64(2654435761 + 1000003 * k)) & np.uint64(0xFFFFFFFF)).min())) for k in range(0, 2 * hashes, 2)]
        earlier = Counter(first.get(x) for x in own)
        earlier.pop(None, 0)
        out.append(bool(earlier) and max(earlier.values()) * 2 > hashes)
        for x in own:
            first.setdefault(x, i)
    return np.array(out, bool)


def train(texts: list[str], toxic: list[int], prior: float, rounds: int = 60, ridge: float = 0.05, batch_tokens: int = 1 << 18) -> Field:
    """A field from labelled texts, all of them whole; gradients are summed over batches of about ``batch_tokens`` tokens."""
    y_doc = np.array(toxic, bool)
    if not y_doc.any() or y_doc.all():
        return Field({}, 0.0, np.zeros((2, 2)), None, prior)
    vocab: dict[str, int] = {}
    word_id: dict[str, int] = {}
    names: list[tuple[str, ...]] = []
    ids = []

    def numbered() -> Iterator[list[str]]:
        for text in texts:
            words = (text or "").split()
            for w in words:
                if w not in word_id:
                    word_id[w] = len(names)
                    names.append(features(w))
            ids.append(np.fromiter(map(word_id.__getitem__, words), np.int32, len(words)))
            yield words

    apart = np.flatnonzero(~copies(numbered()))
    marked = seeds(({f for w in np.unique(ids[i]).tolist() for f in names[w]} for i in apart), y_doc[apart])  # one set at a time
    df = Counter(f for x in ids for f in {f for w in np.unique(x).tolist() for f in names[w]})
    for f, n in df.items():
        if n >= 3 or f in marked:
            vocab[f] = len(vocab)
    none = len(vocab)
    table = np.full((max(1, len(names)), 4), none, np.int64)
    for i, own in enumerate(names):
        found = [vocab[f] for f in own if f in vocab]
        table[i, : len(found)] = found
    hot = np.array([any(f in marked for f in own) for own in names] or [False])
    batches = []  # (word numbers, document of each, whether it begins one, label)
    start = size = 0
    for stop in range(1, len(ids) + 1):
        size += len(ids[stop - 1])
        if size >= batch_tokens or stop == len(ids):
            lengths = np.array([len(x) for x in ids[start:stop]])
            flat, owner = np.concatenate(ids[start:stop]), np.repeat(np.arange(start, stop), lengths)
            first = np.zeros(len(flat), bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            batches.append((flat.astype(np.int32), owner.astype(np.int32), first, hot[flat] & y_doc[owner]))
            start, size = stop, 0
    seen_pairs = np.zeros((2, 2))
    for _, _, first, y in batches:
        pair = 2 * y[:-1].astype(int) + y[1:]
        seen_pairs += np.bincount(pair[~first[1:]], minlength=4).reshape(2, 2)
    w, bias, trans = np.zeros(none + 1), np.array([-4.0]), np.log((seen_pairs + 1.0) / (seen_pairs + 1.0).sum(1, keepdims=True))
    gathered = [np.zeros_like(x) for x in (w, bias, trans)]
    for _ in range(rounds):
        per_word, expected, per_type = np.zeros(len(table)), np.zeros((2, 2)), w[table].sum(1) + bias[0]
        for flat, _, first, y in batches:
            u = per_type[flat]
            fwd, bwd = Field.ratios(u, first, trans)
            odds = fwd * bwd
            per_word += np.bincount(flat, y - odds / (1 + odds), minlength=len(table))
            e, t = np.exp(np.clip(u[1:], -40, 40)), np.exp(trans)
            parts = np.array([np.full(len(e), t[0, 0]), t[0, 1] * e * bwd[1:], t[1, 0] * fwd[:-1], t[1, 1] * fwd[:-1] * e * bwd[1:]])
            expected += (parts / parts.sum(0))[:, ~first[1:]].sum(1).reshape(2, 2)
        grad_w = np.bincount(table.ravel(), np.repeat(per_word, 4), minlength=none + 1) - ridge * w
        grad_w[none] = 0
        grads = grad_w, np.array([per_word.sum()]), seen_pairs - expected - ridge * trans
        for x, g, total, rate in zip((w, bias, trans), grads, gathered, (1.0, 0.3, 0.3)):
            total += g * g
            x += rate * g / (np.sqrt(total) + 1e-9)
    weights = {f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 1e-3}
    field = Field(weights, float(bias[0]), trans, (1.0, 0.0), prior)
    per_type, evidence = field.bias + w[table].sum(1), np.zeros(len(ids))
    for flat, owner, first, _ in batches:
        evidence += _evidence(field.marginals(per_type[flat], first), owner, len(ids))
    x, target = _logit(evidence), y_doc.astype(float)
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * (a - 1) ** 2 + 0.005 * b * b)

    for _ in range(50):  # damped Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        v = p * (1 - p)
        ga, gb = ((target - p) * x).sum() - (a - 1), (target - p).sum() - 0.01 * b
        haa, hab, hbb = (v * x * x).sum() + 1, (v * x).sum(), v.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and loss(a + step * da, b + step * db) > loss(a, b):
            step /= 2
        a, b = a + step * da, b + step * db
    share = y_doc.mean()
    b += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0
    field.calibration = (float(max(a, 1e-3)), float(b))
    return field


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = 1000, most_clean: int = 3000) -> Field:
    """A field learned from ``labels`` (doc_id, toxic): a sample of at most most_toxic and most_clean of the labelled ids.

    The bound on rows is this function's documented sample bound: the ids with the least hashes are taken, with all of
    their text, whatever its length. Repeated labels of an id count as their largest; a repeated document counts once
    for each text, and of ids with many texts no more are taken, by their hashes, than twice the bound in all. Labels without an id or a value, or whose document isn't there, count for nothing. Ids may be of any type.
    The sampled ids are a broadcast of bounded size; only the sampled texts come to the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("t")).first()
    order = F.xxhash64("doc_id", F.lit("sample"))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).union(known.where("toxic <> 1").orderBy(order, "doc_id").limit(most_clean))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select("text", "toxic", F.xxhash64("doc_id", F.lit("order")).alias("at"), F.xxhash64("text").alias("h")).distinct()
    rows = rows.orderBy("at", "h").limit(2 * (most_toxic + most_clean)).collect()
    rows.sort(key=lambda r: (r.at, r.h))
    return train([r.text for r in rows], [r.toxic for r in rows], counts.t / counts.n if counts.n else 0.0)


def toxicity(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``spans``: start, end and marginal of toxic tokens.

    Whole texts, one pass, no shuffle; a token is a run without white space, and a span is one whose marginal
    reaches ``threshold``, in characters of the text. Null and empty texts have no tokens and get the score of
    a text without evidence. Columns of ``docs`` named score or spans are replaced, all others are kept. A field
    learned without both kinds of labels gives the labelled share as every score.
    """
    rows = docs.drop("score", "spans")
    schema = rows.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast(SPANS).alias("spans")).schema
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    model = docs.sparkSession.sparkContext.broadcast(field)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, memo = model.value, {}
        for whole in batches:
            for start in range(0, whole.num_rows, 400):
                b = whole.slice(start, 400)
                texts = b.column(at).to_pylist()
                cut = [t.split() if t else [] for t in texts]
                lengths = np.fromiter(map(len, cut), np.int64, len(cut))
                u = np.concatenate([crf.unary(words, memo) for words in cut]) if len(cut) else np.zeros(0)
                owner = np.repeat(np.arange(len(cut)), lengths)
                begin = np.cumsum(lengths) - lengths
                first = np.zeros(len(u), bool)
                first[begin[lengths > 0]] = True
                p = crf.marginals(u, first)
                scores = crf.score(_evidence(p, owner, len(cut)))
                spans = [[] for _ in cut]
                hits = np.flatnonzero(p >= threshold) if crf.calibration else np.zeros(0, np.int64)
                for doc in np.unique(owner[hits]).tolist():
                    wanted = set((hits[owner[hits] == doc] - begin[doc]).tolist())
                    spans[doc] = [
                        {"start": m.start(), "end": m.end(), "p": float(p[begin[doc] + i])} for i, m in enumerate(re.finditer(r"\S+", texts[doc])) if i in wanted
                    ]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array(spans, span_type)], names=[*whole.schema.names, "score", "spans"])

    return rows.mapInArrow(run, schema)


def training(labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """The labelled rows to learn from: those whose crc32(doc_id as text) mod ``parts`` isn't ``held``."""
    return labels.where(fold("doc_id", parts) != held)
