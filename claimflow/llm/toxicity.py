"""Toxicity: a convolutional text classifier trained in numpy.

Words and their beginnings are hashed into embedding tables. Filters of several
widths run over the whole text, each filter keeps its maximum, and a linear
layer weighs the maxima. Thresholds are calibrated per language; the language
is guessed from the text's function words, so the text stays the only input.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import need, small_batches, stored

WORD_BUCKETS = 1 << 16
STEM_BUCKETS = 1 << 14
STEM = 5
WIDTHS = (1, 2, 3)
#: Labelled rows that training uses at most, drawn by a hash of doc_id: all toxic ones first, up to half of them.
MOST_LABELLED = 6_000
#: Words of the labelled rows that training uses at most: rows beyond it (in the order of that hash) are left out, as are rows that alone have more.
MOST_WORDS = 8_000_000
#: Batches of an epoch at least.
ROUND_BATCHES = 100
#: Random starts, of which the best on watched documents stays.
STARTS = 4
#: Parts of the learning rows between which settings are compared.
FOLDS = 2
MARKS = b"".join(bytes([i]) for i in range(33, 127) if not bytes([i]).isalnum())

# Frequent function words of the languages that thresholds are kept for.
FUNCTION_WORDS = {
    "de": "der die das und ist von nicht mit den dem ein eine zu auf für sich im",
    "en": "the of and to in is that it for was with as be by on are at this from",
    "es": "de la el los las que y en un una por con su no es se del para al lo",
    "fr": "le la les de des et un une que est en dans du pour pas sur par au qui ce",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "other")
_LANGUAGE_OF = {w.encode(): [i for i, k in enumerate(sorted(FUNCTION_WORDS)) if w in FUNCTION_WORDS[k].split()] for w in {w for v in FUNCTION_WORDS.values() for w in v.split()}}

_MOST_KEPT = 300_000


@dataclass(frozen=True)
class Setting:
    """Filters of each width, length of embeddings, rates of weights and of embedding rows, and whether a maximum can only add to a score."""

    filters: int = 12
    dim: int = 16
    rate: float = 0.005
    row_rate: float = 0.05
    adds_only: bool = True


#: What is compared on folds of the learning rows; the first where these are too few to compare.
SETTINGS = (Setting(), Setting(adds_only=False), Setting(filters=6, dim=8), Setting(rate=0.002, row_rate=0.02))


class Words:
    """Hashes words to (word bucket, stem bucket, language votes); keeps what it has hashed."""

    def __init__(self) -> None:
        self.kept: dict[bytes, tuple[int, int, int]] = {}

    def one(self, word: bytes) -> tuple[int, int, int]:
        if len(self.kept) > _MOST_KEPT:
            self.kept.clear()
        bare = word.lower().strip(MARKS) or word
        try:
            low = bare.decode().lower()
        except UnicodeDecodeError:
            low = bare.decode("latin-1").lower()
        votes = 0
        for i in _LANGUAGE_OF.get(low.encode(), ()):
            votes |= 1 << (8 * i)
        got = zlib.crc32(low.encode()) % WORD_BUCKETS, zlib.crc32(b"^" + low[:STEM].encode()) % STEM_BUCKETS, votes
        self.kept[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Word ids, stem ids and the language of a whole text; an empty text is one blank word."""
        kept, one = self.kept, self.one
        got = [kept.get(w) or one(w) for w in (text or "").encode("utf-8", "surrogatepass").split()] or [one(b"")]
        ids = np.array(got, np.int64)
        votes = [int(((ids[:, 2] >> (8 * i)) & 255).sum()) for i in range(len(LANGUAGES) - 1)]
        return ids[:, 0].astype(np.int32), ids[:, 1].astype(np.int32), int(np.argmax(votes)) if max(votes) else len(LANGUAGES) - 1


@dataclass
class Network:
    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: float
    #: Of each language: the logit that counts as 0.5, and the slope there.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    slopes: np.ndarray = field(default_factory=lambda: np.ones(len(LANGUAGES)))

    def maxima(self, w: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the maximum of each filter and the word where it begins (documents end to end in w, s)."""
        x, size, at = self.words[w] + self.stems[s], ends - starts, np.arange(len(w))[:, None]
        best, where = [], []
        for k, f in zip(WIDTHS, self.filters, strict=True):
            y = x @ f[0]
            for o in range(1, k):
                y[:-o] += (x @ f[o])[o:]
            if k > 1:
                # A filter may run past its document's end by reading the next one: mask those places out.
                late = ends[:, None] - np.arange(1, k)[None, :]
                y[late[late >= starts[:, None]]] = -np.inf
                y[starts[size < k]] = 0.0
            top = np.maximum.reduceat(y, starts, axis=0)
            best.append(top)
            where.append(np.minimum.reduceat(np.where(y == np.repeat(top, size, 0), at, len(w)), starts, axis=0))
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def logits(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Filters as table look-ups: each distinct (word, stem) of the batch meets the filters once."""
        if not docs:
            return np.empty(0)
        ends = np.cumsum([len(d[0]) for d in docs])
        starts = np.concatenate([[0], ends[:-1]])
        both = np.concatenate([d[0] for d in docs]).astype(np.int64) * STEM_BUCKETS + np.concatenate([d[1] for d in docs])
        once, back = np.unique(both, return_inverse=True)
        x = self.words[once // STEM_BUCKETS] + self.stems[once % STEM_BUCKETS]
        best = []
        for k, f in zip(WIDTHS, self.filters, strict=True):
            y = (x @ f[0])[back]
            for o in range(1, k):
                y[:-o] += (x @ f[o])[back[o:]]
            if k > 1:
                late = ends[:, None] - np.arange(1, k)[None, :]
                y[late[late >= starts[:, None]]] = -np.inf
                y[starts[ends - starts < k]] = 0.0
            best.append(np.maximum.reduceat(y, starts, axis=0))
        h = np.maximum(np.concatenate(best, 1) + self.shift, 0)
        return h @ self.out + self.bias

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        at = np.array([d[2] for d in docs], int)
        z = (self.logits(docs) - self.thresholds[at]) * self.slopes[at]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _fresh(rng: np.random.Generator, how: Setting) -> Network:
    """Random weights: small embeddings, so that words never met in training hardly move a maximum."""
    n, dim = len(WIDTHS) * how.filters, how.dim
    small = lambda *shape: (rng.standard_normal(shape) * 0.02).astype(np.float32)
    filters = [(rng.standard_normal((k, dim, how.filters)) / np.sqrt(k * dim)).astype(np.float32) for k in WIDTHS]
    out = (np.abs(rng.standard_normal(n)) / np.sqrt(n)).astype(np.float32)
    return Network(small(WORD_BUCKETS, dim), small(STEM_BUCKETS, dim), filters, np.zeros(n, np.float32), out, 0.0)


def _loss(net: Network, docs: list, y: np.ndarray) -> float:
    """Mean logistic loss, both classes weighing the same."""
    z = np.where(y == 1, -1, 1) * _in_parts(net, docs)
    lost = np.logaddexp(0, z)
    return float(sum(lost[y == k].mean() for k in (0, 1)) / 2)


def _in_parts(net: Network, docs: list) -> np.ndarray:
    return np.concatenate([net.logits(docs[at : at + 256]) for at in range(0, len(docs), 256)]) if docs else np.empty(0)


def train(docs: list, y: np.ndarray, watched: tuple[list, np.ndarray] | None = None, epochs: int = 6, batch: int = 32, how: Setting = SETTINGS[0], seed: int = 1) -> Network:
    """Trains from random weights on mini-batches, both classes weighing the same; gradients pass the maxima only.

    Filters and weights move by running means of squared gradients, embedding
    rows by sums of them. With ``watched`` documents the epoch that loses least
    on them is kept, and two epochs without a better one end the training. Without both classes the score is constant.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, int)
    net = _fresh(rng, how)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        net.out[:], net.bias = 0, float(np.log(share / (1 - share)))
        return net
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias = np.zeros(1, np.float32)
    dense = {"shift": net.shift, "out": net.out, "bias": bias, **{f"f{i}": f for i, f in enumerate(net.filters)}}
    squares = {k: np.full(v.shape, 1e-8, np.float32) for k, v in dense.items()}
    rows = {"words": (net.words, np.full(WORD_BUCKETS, 1e-8, np.float32)), "stems": (net.stems, np.full(STEM_BUCKETS, 1e-8, np.float32))}
    best, least, since = None, np.inf, 0
    # Few documents are passed several times between two looks at the watched ones.
    passes = max(1, ROUND_BATCHES * batch // len(docs))
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(len(docs)) for _ in range(passes)])
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            some = [docs[i] for i in picked]
            ends = np.cumsum([len(d[0]) for d in some])
            starts = np.concatenate([[0], ends[:-1]])
            w, s = np.concatenate([d[0] for d in some]), np.concatenate([d[1] for d in some])
            top, where = net.maxima(w, s, starts, ends)
            h = top + net.shift
            on = h > 0
            h = np.where(on, h, 0)
            z = h @ net.out + bias[0]
            g = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[picked]) * weigh[picked] / len(some)).astype(np.float32)
            gh = (g[:, None] * net.out) * on
            grads = {"out": h.T @ g + 1e-4 * net.out, "shift": gh.sum(0), "bias": g.sum()}
            met, gx = [], []
            for i, (k, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                cols = slice(i * how.filters, (i + 1) * how.filters)
                first = where[:, cols]
                ghk = np.where((ends - starts >= k)[:, None], gh[:, cols], 0)
                live = ghk != 0
                gf = np.zeros_like(f)
                for o in range(k):
                    pos = np.minimum(first + o, len(w) - 1)
                    gf[o] = np.einsum("dje,dj->ej", net.words[w[pos]] + net.stems[s[pos]], ghk)
                    met.append(pos[live])
                    gx.append((ghk[:, :, None] * f[o].T[None])[live])
                grads[f"f{i}"] = gf + 1e-4 * f
            for k, v in grads.items():
                squares[k] *= 0.99
                squares[k] += 0.01 * v * v
                dense[k] -= how.rate * v / np.sqrt(squares[k] + 1e-8)
            if how.adds_only:
                # A passage can make a text toxic, and no further text makes it less so.
                np.maximum(net.out, 0, out=net.out)
            met, gx = np.concatenate(met), np.concatenate(gx)
            for name, ids in (("words", w), ("stems", s)):
                table, sums = rows[name]
                once, back = np.unique(ids[met], return_inverse=True)
                total = np.zeros((len(once), how.dim), np.float32)
                np.add.at(total, back, gx)
                sums[once] += (total * total).mean(1)
                table[once] -= how.row_rate * total / np.sqrt(sums[once])[:, None]
        net.bias = float(bias[0])
        if watched:
            lost = _loss(net, *watched)
            if lost < least:
                best, least, since = copy.deepcopy(net), lost, 0
            elif (since := since + 1) == 2:
                break
    return best or net


def calibrate(net: Network, docs: list, y: np.ndarray) -> None:
    """Sets each language's threshold where fewest documents are wrong; few documents: the overall one."""
    z, at = _in_parts(net, docs), np.array([d[2] for d in docs], int)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        low = np.flatnonzero(wrong == wrong.min())
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        # Of equally good places the one nearest the even odds of training, a quarter of its gap away from both sides.
        gaps = [(edges[k], edges[k + 1]) for k in low]
        inside = [np.clip(0.0, a + (b - a) / 4, b - (b - a) / 4) for a, b in gaps]
        return float(min(inside, key=abs))

    if not len(y) or y.min() == y.max():
        return
    overall = best(z, y)
    net.thresholds[:] = overall
    for k in range(len(LANGUAGES)):
        here = at == k
        if min(np.bincount(y[here], minlength=2)) >= 20:
            net.thresholds[k] = best(z[here], y[here])


def _trained(spark: SparkSession, docs: list, y: np.ndarray, jobs: list[tuple[Setting, int, np.ndarray]], keep: bool) -> list[tuple[float, Network | None]]:
    """(loss on the watched documents, network) of each job (setting, seed, which documents are watched), a task for each.

    The documents are a bounded sample, so they are broadcast; networks come back only to ``keep`` them.
    """
    held = spark.sparkContext.broadcast((docs, y, jobs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, y, jobs = held.value
        for job in (int(i) for b in batches for i in b["id"]):
            how, seed, watched = jobs[job]
            look = [d for d, w in zip(docs, watched, strict=True) if w], y[watched]
            net = train([d for d, w in zip(docs, watched, strict=True) if not w], y[~watched], look, how=how, seed=seed)
            yield pd.DataFrame({"job": [job], "loss": [_loss(net, *look)], "net": [pickle.dumps(net) if keep else None]})

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "job long, loss double, net binary").collect()
    held.unpersist()
    return [(r["loss"], pickle.loads(r["net"]) if keep else None) for r in sorted(rows)]


def _every(y: np.ndarray, n: int, at: int) -> np.ndarray:
    """Marks each ``n``-th document of each class, from the one at ``at``."""
    marked = np.zeros(len(y), bool)
    for k in (0, 1):
        marked[np.flatnonzero(y == k)[at::n]] = True
    return marked


def chosen_setting(spark: SparkSession, docs: list, y: np.ndarray) -> Setting:
    """The setting that loses least on folds it was not trained on; these are the learning rows themselves, no others are looked at."""
    folds = [_every(y, FOLDS, f) for f in range(FOLDS)]
    if min(min(np.bincount(y[f], minlength=2)) for f in folds) < 5:
        return SETTINGS[0]
    losses = _trained(spark, docs, y, [(how, 1, f) for how in SETTINGS for f in folds], False)
    means = [sum(x for x, _ in losses[at : at + FOLDS]) for at in range(0, len(losses), FOLDS)]
    return SETTINGS[int(np.argmin(means))]


def _sample(labels: DataFrame, learn: Column | None, most: int) -> pd.DataFrame:
    one = labels.where("toxic is not null and doc_id is not null").where(F.lit(True) if learn is None else learn)
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    pick = lambda k, n: one.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).toPandas()
    toxic = pick(1, most // 2)
    return pd.concat([toxic, pick(0, most - len(toxic))], ignore_index=True)


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_LABELLED, words: int = MOST_WORDS) -> Network:
    """Trains on at most ``most`` labelled documents of ``words`` words together and calibrates on a fifth of them that training leaves out.

    The setting is chosen on folds of the rest; all trainings run as tasks side by side.
    """
    said = _sample(labels, learn, most)
    if not len(said):
        return train([], np.empty(0, int))
    spark = docs.sparkSession
    small_batches(spark)
    # The sample's ids are bounded by ``most``: broadcasting them keeps texts where they are.
    ids = F.broadcast(spark.createDataFrame(said[["doc_id"]]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in batches:
            got = [hashed(t.as_py()) for t in b.column(1)]
            data = [np.stack(g[:2]).astype("<i4").tobytes() for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array([g[2] for g in got], pa.int32())], ["doc_id", "ids", "lang"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").mapInArrow(each, "doc_id long, ids binary, lang int")
    # A doc_id that comes several times counts with one of its texts, the first by their hash: as many rows as sampled ids.
    first = F.min(F.struct(F.xxhash64("doc_id", "ids").alias("turn"), "ids", "lang")).alias("one")
    rows = stored(rows.groupBy("doc_id").agg(first).select("doc_id", "one.*"), "toxic-words")
    # Of each row its number of words; then the words of those that fit, which bounds what the driver gets in bytes.
    sizes = rows.select("doc_id", "turn", (F.length("ids") / 8).cast("long").alias("n")).toPandas().sort_values(["turn", "doc_id"])
    sizes = sizes[sizes["n"] <= words]
    fit = sizes[sizes["n"].cumsum() <= words]
    if not len(fit):
        return train([], np.empty(0, int))
    rows = rows.join(F.broadcast(spark.createDataFrame(fit[["doc_id"]])), "doc_id", "left_semi").toPandas()
    rows = rows.merge(said, on="doc_id").sort_values("doc_id", ignore_index=True)
    pairs = [np.frombuffer(x, "<i4").reshape(2, -1) for x in rows["ids"]]
    data = [(p[0], p[1], int(k)) for p, k in zip(pairs, rows["lang"], strict=True)]
    y = rows["y"].to_numpy(int)
    # A fifth of each class is watched while training and calibrates the thresholds.
    held = _every(y, 5, 4)
    if min(np.bincount(y[held], minlength=2)) < 5:
        net = train(data, y)
        calibrate(net, data, y)
        return net
    how = chosen_setting(spark, [d for d, h in zip(data, held, strict=True) if not h], y[~held])
    # Random starts differ in how much they find: the one that loses least on the watched documents stays.
    net = min(_trained(spark, data, y, [(how, seed, held) for seed in range(1, STARTS + 1)], True), key=lambda x: x[0])[1]
    calibrate(net, [d for d, h in zip(data, held, strict=True) if h], y[held])
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``labels`` has doc_id and toxic (0/1; null rows are skipped, several rows of
    a doc_id vote); ``learn`` bounds which labels training sees. The score comes
    from the whole text alone; null counts as empty, an empty text is one blank
    word. Repeated rows are scored each; an empty table gives no rows. With
    labels of one class or none all rows have the same score.
    """
    need(docs, ["doc_id", "text"])
    need(labels, ["doc_id", "toxic"])
    model = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels, learn, most))
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in batches:
            score, some, size = [], [], 0
            for t in b.column(1):
                some.append(hashed(t.as_py()))
                size += len(some[-1][0])
                if size > 50_000:
                    score.append(model.value.scores(some))
                    some, size = [], 0
            if some:
                score.append(model.value.scores(some))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")
