"""Operator 9: quality classifier from a weak-label model.

Seven overlapping heuristics vote good, bad or nothing on every document. Their
votes form a pattern (3**7 of them); the corpus is reduced to counts per pattern
and expectation-maximisation on those counts estimates each heuristic's vote
rates among good and bad documents, without labels. The posteriors of the
patterns are the soft labels on which a hashed linear scorer is trained: word
shapes, endings, repeats and vote evidence hashed into ``DIM`` weights. The scorer
then reads every whole document; those with a score under ``CUT`` are rejected.

The scorer is fitted on about ``SAMPLE`` documents drawn by hash of id and text and,
of every pattern that the corpus holds, on at least ``PER_PATTERN`` documents or all
it has (fewer where so many patterns occur that they were more than ``SAMPLE``). All
in all these are at most twice ``SAMPLE``; each stands for as many documents of its
pattern as its draw left out. Votes, pattern counts and scores cover every document.

Defined cases: a null or wordless text is rejected with score 0; a heuristic
without enough to judge abstains, so short clean texts stay; repeated rows
score alike and all stay; other columns are handed on; with an empty table, or
one that holds no pattern more likely bad than good, nothing is rejected but
wordless texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, lean, mix, text_chunks

DIM, SAMPLE, PER_PATTERN = 1024, 4096, 64
#: A score below this rejects. The classes weigh the same in training, so 0.5 would reject too eagerly where most is good.
CUT = 0.3
#: Frequent function words of the four languages.
STOPWORDS = (
    "the of and to in a is that it for was on are as with be by this have from or an not at but "
    "de la le les des du et en un une est que qui dans pour par sur au avec pas "
    "der die das und den von zu mit sich ist im dem nicht ein eine als auf für "
    "el los las del se por con para al lo su una y no es"
).split()
LABELLERS = ("symbols", "capitals", "columns", "stutter", "repeats", "shouting", "function_words")
GOOD, BAD, NONE = 1, 2, 0

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 other punctuation, 6 beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in "#$%&*~^=+<>{}[]_\\"]] = 4
_CLASS[[ord(c) for c in "!|.,;:?'\"()-/@"]] = 5
_CLASS[128:] = 6
_STOP_HASHES = np.sort(Words([" ".join(STOPWORDS).encode()], fold=True).hash)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(votes per document and labeller, dense feature rows) of a chunk."""
    words = Words(texts, fold=True)
    n_docs, n = len(texts), len(words.hash)
    doc_words = np.diff(words.bounds)
    a, b = words.bounds[:-1], words.bounds[1:]
    kind = _CLASS[words.buf]
    per_word = np.stack([_sums(kind == k, words.starts, words.ends) for k in range(1, 7)])
    size = words.ends - words.starts
    upper_word = (per_word[1] >= 2) & (per_word[0] == 0)
    same = np.zeros(n, bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.bounds[:-1][doc_words > 0]] = False
    bar = _sums(words.buf == ord("|"), words.starts, words.ends)
    bang = _sums(words.buf == ord("!"), words.starts, words.ends)
    at = np.minimum(np.searchsorted(_STOP_HASHES, words.hash), len(_STOP_HASHES) - 1)
    stop = _STOP_HASHES[at] == words.hash
    # 4-grams seen before in the same document
    doc = np.repeat(np.arange(n_docs), doc_words)
    grams = words.grams(4)
    inside = doc[3:] == doc[: len(grams)] if n > 3 else np.zeros(0, bool)
    salted = mix(grams + doc[: len(grams)].astype(np.uint64))[inside] if n > 3 else np.zeros(0, np.uint64)
    seen = np.zeros(n, bool)
    if len(salted):
        order = np.argsort(salted, kind="stable")
        again = np.zeros(len(salted), bool)
        again[order[1:]] = salted[order[1:]] == salted[order[:-1]]
        seen[np.flatnonzero(inside)] = again
    safe = np.maximum(doc_words, 1)
    share = lambda x: _sums(x, a, b) / safe
    letters = np.maximum(_sums(per_word[0] + per_word[1], a, b), 1)
    gram_count = np.maximum(doc_words - 3, 1)
    values = {
        "symbols": share(per_word[3] >= 2),
        "capitals": _sums(per_word[1], a, b) / letters,
        "columns": share(bar > 0),
        "stutter": share(same),
        "repeats": _sums(seen, a, b) / gram_count,
        "shouting": share(bang >= 2),
        "function_words": share(stop),
    }
    votes = np.zeros((n_docs, len(LABELLERS)), np.int8)
    limits = {"symbols": (0.02, 0.15), "capitals": (0.2, 0.5), "columns": (0.02, 0.15), "stutter": (0.08, 0.3), "repeats": (0.08, 0.3), "shouting": (0.02, 0.3)}
    for i, name in enumerate(LABELLERS[:-1]):
        good, bad = limits[name]
        enough = doc_words >= 8
        votes[:, i] = np.where(enough & (values[name] >= bad), BAD, np.where(enough & (values[name] <= good), GOOD, NONE))
    votes[:, -1] = np.where((doc_words >= 20) & (values["function_words"] < 0.02), BAD, np.where((doc_words >= 8) & (values["function_words"] > 0.08), GOOD, NONE))

    # hashed features: relative frequency of word shapes and endings, plus the evidence in steps
    last = words.buf[np.maximum(words.ends - 1, 0)] if n else np.zeros(0, np.uint8)
    shape = (
        np.minimum(size, 15) + 16 * (np.minimum(per_word[0], 3) + 4 * np.minimum(per_word[1], 3) + 16 * np.minimum(per_word[3], 2) + 48 * (bar > 0) + 96 * (bang > 1) + 192 * (per_word[5] > 0))
    ).astype(np.uint64)
    repeat = (same.astype(np.uint64) + np.uint64(2) * seen.astype(np.uint64)) if n else np.zeros(0, np.uint64)
    rows = np.zeros((n_docs, DIM), np.float32)
    flat = rows.reshape(-1)
    weight = (1.0 / safe)[doc] if n else np.zeros(0)
    for salt, code in ((1, shape), (2, last.astype(np.uint64)), (3, repeat), (4, stop.astype(np.uint64))):
        slot = (mix(code * np.uint64(7) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(DIM)).astype(np.int64)
        flat += np.bincount(doc * DIM + slot, weights=weight, minlength=n_docs * DIM).astype(np.float32)
    for i, name in enumerate(LABELLERS):
        step = np.minimum((values[name] * 20).astype(np.int64), 20).astype(np.uint64)
        enough = (doc_words >= 8).astype(np.uint64)
        slot = (mix((step * np.uint64(2) + enough) * np.uint64(31) + np.uint64(100 + i)) % np.uint64(DIM)).astype(np.int64)
        rows[np.arange(n_docs), slot] += 0.5
    rows[doc_words == 0] = 0
    return votes, rows


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ (3 ** np.arange(len(LABELLERS)))


def _votes(batches: Iterable) -> Iterator:
    """Per task and pattern: its count and the smallest of its documents' hashes."""
    import pyarrow as pa

    count: dict[int, int] = {}
    least: dict[int, np.ndarray] = {}
    for batch, texts in text_chunks(batches, "text"):
        patterns, keys = pattern_of(describe(texts)[0]), batch.column("h").to_numpy(zero_copy_only=False)
        for p in np.unique(patterns).tolist():
            own = keys[patterns == p]
            count[p] = count.get(p, 0) + len(own)
            least[p] = np.unique(np.concatenate((least.get(p, own[:0]), own)))[:PER_PATTERN]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([least[p].tolist() for p in count], pa.list_(pa.int64()))], ["pattern", "n", "least"]
    )


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of 'good' for each of the 3**k patterns, by expectation-maximisation over the pattern counts."""
    k = len(LABELLERS)
    every = np.arange(3**k)
    votes = every[:, None] // 3 ** np.arange(k) % 3
    seen, n = votes[patterns], counts.astype(float)
    # start: a document with any bad vote is more likely bad
    good = np.where((seen == BAD).any(axis=1), 0.1, 0.95)
    prior, rate = 0.5, np.zeros((2, k, 3))
    for _ in range(rounds):
        for c, w in ((0, n * (1 - good)), (1, n * good)):
            for v in range(3):
                rate[c, :, v] = ((seen == v) * w[:, None]).sum(axis=0) + 0.5
            rate[c] /= rate[c].sum(axis=1, keepdims=True)
        prior = (n * good).sum() / max(n.sum(), 1)
        prior = min(max(prior, 0.01), 0.99)
        update = _posterior(seen, rate, prior)
        if np.abs(update - good).max(initial=0) < 1e-6:
            break
        good = update
    return _posterior(votes, rate, prior)


def _posterior(votes: np.ndarray, rate: np.ndarray, prior: float) -> np.ndarray:
    k = votes.shape[1]
    log = [np.log(p) + np.log(rate[c][np.arange(k), votes]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _features(batches: Iterable) -> Iterator:
    import pyarrow as pa

    for batch, texts in text_chunks(batches, "text"):
        keys, first, n = np.unique(batch.column("h").to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
        votes, rows = describe([texts[i] for i in first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(pattern_of(votes), pa.int64()), pa.array([r.tobytes() for r in rows.astype("<f2")], pa.binary())], ["h", "n", "pattern", "x"]
        )


def train_scorer(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, rounds: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels (full-batch, accelerated) of rows that stand for ``counts`` documents each;
    the last weight is the bias."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    # both classes weigh the same
    weight = np.ones(len(y)) if counts is None else counts.astype(float)
    for side in (y >= 0.5, y < 0.5):
        weight[side] *= 0.5 * len(y) / max(weight[side].sum(), 1e-300)
    step = 4.0 / ((x * x).sum(axis=1) * weight).mean()
    for t in range(rounds):
        look = v + t / (t + 3) * (v - w)
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + l2 * look
        w, v = v, look - step * grad
    return v


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer: pattern counts over all documents, training on a bounded sample with every pattern in it."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    counted = (
        rows.mapInArrow(lean(_votes), "pattern long, n long, least array<long>").groupBy("pattern")
        .agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, PER_PATTERN).alias("least")).collect()
    )
    total = {r["pattern"]: r["n"] for r in counted}
    documents = sum(total.values())
    if not documents:
        return np.zeros(DIM + 1)
    good = estimate(np.array(list(total)), np.array(list(total.values())))
    if not (good[list(total)] < 0.5).any():
        return np.concatenate([np.zeros(DIM), [5.0]])
    share = min(1.0, sample / documents)
    each = max(1, min(PER_PATTERN, sample // len(total)))
    # patterns of which the draw by hash may hold fewer than their due
    named = sorted({h for r in counted if share < 1 and r["n"] * share < 2 * each for h in r["least"][:each]})
    even = F.pmod("h", F.lit(1 << 30))
    own = F.col("h").isin(named) if named else F.lit(False)
    drawn = rows.where((even < int(share * (1 << 30))) | own)
    drawn = drawn.mapInArrow(lean(_features), "h long, n long, pattern long, x binary").groupBy("h")
    drawn = drawn.agg(F.sum("n").alias("n"), F.first("pattern").alias("pattern"), F.first("x").alias("x"))
    got = drawn.orderBy(own.desc(), even, "h").limit(2 * sample).collect()
    pattern, n = np.array([r["pattern"] for r in got], np.int64), np.array([r["n"] for r in got], float)
    held = np.bincount(pattern, weights=n, minlength=3 ** len(LABELLERS))
    counts = n * np.array([total[p] for p in pattern.tolist()]) / held[pattern]
    return train_scorer(np.stack([np.frombuffer(r["x"], "<f2") for r in got]), good[pattern], counts)


def _scorer(weights: np.ndarray) -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch, texts in text_chunks(batches):
            votes, rows = describe(texts)
            score = 1 / (1 + np.exp(-np.clip(rows.astype("<f2").astype(np.float64) @ weights[:-1] + weights[-1], -30, 30)))
            score[~rows.any(axis=1)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pattern_of(votes), pa.int64()), pa.array(score, pa.float64())], [*batch.schema.names, "_vf_pattern", "_vf_score"]
            )

    return run


def score(docs: DataFrame, weights: np.ndarray | None = None, names: tuple[str, str, str] = ("votes", "quality_score", "accepted")) -> DataFrame:
    """``docs`` with the vote pattern, the score in 0..1 and whether it is accepted (columns of these names are replaced)."""
    ship(docs.sparkSession)
    weights = fit(docs) if weights is None else weights
    rest = docs.select(*[c for c in docs.columns if c not in names])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema], "_vf_pattern long, _vf_score double"])
    scored = rest.mapInArrow(lean(_scorer(weights)), schema)
    return scored.select(*rest.columns, F.col("_vf_pattern").alias(names[0]), F.col("_vf_score").alias(names[1]), (F.col("_vf_score") >= CUT).alias(names[2]))
