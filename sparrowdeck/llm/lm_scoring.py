"""Language-model scores: a causal self-attention model in numpy over subword ids, and a word unigram base."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, documents, drop_table, materialize, small_batches, to_batch
from .tokens import WordEncoder, cut_words, split_buffer, strings

#: One document in so many is held out.
FOLDS = 10
VOCABULARY = 49_408
END = 49_407
#: Classes that the model predicts: the most frequent ids on their own, the others in bands of frequency.
SINGLE, BANDS = 80, 16
CLASSES = SINGLE + BANDS
#: Ids that the model tells apart in its context, and ids whose share of their class depends on the id before; the rest
#: are one each.
SEEN, OWN = 1024, 4096
WIDTH, WINDOW, STRIDE = 16, 32, 26
#: A table of at most so many training documents and STEPS times BATCH windows is learnt on the driver, in STEPS steps.
FEW, STEPS, BATCH = 1_000, 500, 96
#: A larger one is learnt by all tasks: in each of ROUNDS rounds another one in EVERY windows, so that all windows of all
#: training documents teach, once each; the rate of the first round, and the windows that are worth a task.
ROUNDS, EVERY, RATE, AT_TASK = 4, 4, 0.008, 20_000
#: Counts of words that a task holds before it sums them up and hands them on.
HELD = 600_000
#: Windows scored in one step: few enough for the caches, enough to make few calls.
AT_ONCE = 64
#: Sums of weights that a round brings to the driver.
SUMS = 8
#: Words whose base score each task keeps in a dictionary, at most; the others are looked up by a join.
FREQUENT = 300_000
#: A float32 holds sums of so many exponentials up to here.
SAFE = 75.0
#: Words whose ids a task keeps; it holds counts beside them.
CACHED = 700_000
COUNTS = "kind byte, key binary, n long, doc_id long, held_out boolean, text string, ids binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>"


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    """Whether the CRC-32 of the id as text (empty for null) is divisible by folds."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def _sound(sums: np.ndarray) -> bool:
    """Whether sums of exponentials, of which no maximum was subtracted, are as good as if it had been."""
    return not len(sums) or bool(sums.max() < math.exp(SAFE) and sums.min() > math.exp(-SAFE))


@dataclass
class Classes:
    """Ids to classes to predict, classes of context and columns of the pair table, by frequency."""

    predicted: np.ndarray
    seen: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Classes:
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        # bands double in width, so each has ids of similar frequency
        edges = np.append(np.unique(np.geomspace(SINGLE, OWN - 1, BANDS).astype(np.int64))[1:-1], OWN - 1)
        predicted = np.where(rank < SINGLE, rank, SINGLE + np.searchsorted(edges, rank, side="right")).astype(np.int16)
        return cls(predicted, np.minimum(rank, SEEN - 1).astype(np.int16), np.minimum(rank, OWN - 1).astype(np.int16))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over documents of `lengths` ids: (document, start, first scored place, places).

    Windows are WINDOW long and STRIDE apart; each scores the ids that no earlier window of the document has scored.
    """
    count = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = k * STRIDE
    return doc, start, np.where(k == 0, 0, WINDOW - STRIDE), np.minimum(WINDOW, lengths[doc] - start)


class Attention:
    """logits = prior[last seen id] + (x + softmax(mask(q k')) v) u, with x = embedding + position.

    Predicts the class of the next id from the ids before it. The prior is the smoothed table of class counts after each
    seen id over all training documents; the attention learns what earlier ids add.
    """

    NAMES = ("embed", "place", "wq", "wk", "wv", "out")

    def __init__(self, prior: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.prior = prior.astype(np.float32)
        shape = {"embed": (SEEN + 1, WIDTH), "place": (WINDOW, WIDTH), "wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}
        self.p = {k: (r.normal(size=s) * (0.3 if k == "embed" else 0.02 if k in ("place", "out") else 0.2)).astype(np.float32) for k, s in shape.items()}
        self.causal = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def forward(self, before: np.ndarray) -> tuple:
        """before: the seen class before each place of each window. Returns logits and what backward() needs."""
        p = self.p
        x = p["embed"][before] + p["place"]
        q, k, v = x @ p["wq"], x @ p["wk"], x @ p["wv"]
        s = q @ k.transpose(0, 2, 1)
        s *= 1 / math.sqrt(WIDTH)
        s += self.mask
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        h = s @ v
        h += x
        logits = h @ p["out"]
        logits += self.prior[before]
        return logits, (before, x, q, k, v, s, h)

    def bounded(self) -> bool:
        """Whether neither scores nor what is added to the prior can go beyond SAFE; then no maximum need be subtracted:
        the prior is of log probabilities, so none is over 0 and one of each row is not far below."""
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        longest = lambda w: sum(np.linalg.norm(p[x] @ w, axis=1).max() for x in ("embed", "place"))
        scores = longest(p["wq"]) * longest(p["wk"]) / math.sqrt(WIDTH)
        added = sum(np.abs(p[x] @ w).max(axis=0) for x in ("embed", "place") for w in (p["out"], p["wv"] @ p["out"])).max()
        return bool(max(scores, added) < SAFE and self.prior.max() <= 0)

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedding and position with a column more, of ones in their sum, and wq wk' scaled). With these, q k' is
        (x wq wk') x', and attention weights times x1 give their sum as well: neither k nor v is needed on its own."""
        p = self.p
        embed = np.concatenate((p["embed"], np.ones((len(p["embed"]), 1), p["embed"].dtype)), axis=1)
        return embed, np.pad(p["place"], ((0, 0), (0, 1))), p["wq"] @ p["wk"].T * p["wq"].dtype.type(1 / math.sqrt(WIDTH))

    def log_probs(self, before: np.ndarray, after: np.ndarray, first: int = 0, bounded: bool = False, folded: tuple | None = None) -> np.ndarray:
        """Natural log probability of the class `after` at the places from `first` on. forward(), with fewer passes."""
        p = self.p
        embed, place, both = folded or self.folded()
        x1 = embed.take(before.reshape(-1), axis=0).reshape(*before.shape, WIDTH + 1)
        x1 += place
        x = x1[:, :, :WIDTH]
        some = np.ascontiguousarray(x[:, first:]).reshape(-1, WIDTH)
        s = (some @ both).reshape(len(before), -1, WIDTH) @ x.transpose(0, 2, 1)
        if not bounded:
            s += self.mask[first:]
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s *= self.causal[first:]
        h = s @ x1
        h = (h[:, :, :WIDTH] / h[:, :, WIDTH:]).reshape(-1, WIDTH) @ p["wv"]
        h += some
        logits = h @ p["out"]
        logits += self.prior.take(before[:, first:].reshape(-1), axis=0)
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        got = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + after[:, first:].reshape(-1))
        np.exp(logits, out=logits)
        return (got - np.log(logits @ np.ones(CLASSES, np.float32))).reshape(len(before), -1)

    def gradients(self, before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients. Windows without a weight at the places that an earlier window scores go on their own,
        as nothing is asked there."""
        before, folded, total = before.astype(np.intp), self.folded(), weight.sum()
        whole = weight[:, : WINDOW - STRIDE].any(axis=1)
        loss, g, seen, dx = 0.0, {}, [], []
        for o, first in ((np.flatnonzero(whole), 0), (np.flatnonzero(~whole), WINDOW - STRIDE)):
            if len(o):
                one, more, d = self._part(before[o], after[o], weight[o] / total, first, folded)
                loss += one
                g = {k: g[k] + x if g else x for k, x in more.items()}
                seen.append(before[o].reshape(-1))
                dx.append(d.reshape(-1, WIDTH))
        p, scale = self.p, 1 / math.sqrt(WIDTH)
        both = g.pop("both") * p["wq"].dtype.type(scale)
        cells = (np.concatenate(seen)[:, None] * WIDTH + np.arange(WIDTH)).reshape(-1)
        embed = np.bincount(cells, np.concatenate(dx).reshape(-1), p["embed"].size).reshape(p["embed"].shape)
        return loss, g | {"wq": both @ p["wk"], "wk": both.T @ p["wq"], "embed": embed.astype(p["embed"].dtype)}

    def _part(self, before: np.ndarray, after: np.ndarray, share: np.ndarray, first: int, folded: tuple) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients ("both" for wq wk' before it is scaled) and gradient of x of windows without a weight before `first`."""
        p, n, m = self.p, len(before), WINDOW - first
        embed, place, both = folded
        x1 = embed.take(before.reshape(-1), axis=0).reshape(n, WINDOW, WIDTH + 1)
        x1 += place
        x = x1[:, :, :WIDTH]
        asked = np.ascontiguousarray(x[:, first:]).reshape(-1, WIDTH)
        # below, the gradients of the scores and the exponentials stand one over the other, and what each is multiplied by
        left = np.empty((n, 2 * m, WINDOW), x1.dtype)
        right = np.empty((n, 2 * m, WIDTH + 1), x1.dtype)
        ds, e, q, z = left[:, :m], left[:, m:], right[:, :m, :WIDTH], right[:, m:]
        q[:] = (asked @ both).reshape(n, m, WIDTH)
        for plain in (True, False):
            np.matmul(q, x.transpose(0, 2, 1), out=e)
            if not plain:
                e += self.mask[first:]
                e -= e.max(axis=2, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(e, out=e)
                e *= self.causal[first:]
                h = e @ x1
            if _sound(h[:, :, WIDTH]):
                break
        r = 1 / h[:, :, WIDTH:]
        met = h[:, :, :WIDTH] * r
        h = met.reshape(-1, WIDTH) @ p["wv"]
        h += asked
        # only places with a weight need classes
        share = share[:, first:].reshape(-1)
        here = np.flatnonzero(share)
        share, want, some = share[here], after[:, first:].reshape(-1)[here], h.take(here, axis=0)
        for plain in (True, False):
            d = some @ p["out"]
            d += self.prior.take(before[:, first:].reshape(-1)[here], axis=0)
            if not plain:
                d -= d.max(axis=1, keepdims=True)
            flat, at = d.reshape(-1), np.arange(0, d.size, CLASSES) + want
            got = flat[at]
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(d, out=d)
                total = d @ np.ones(CLASSES, d.dtype)
            if _sound(total):
                break
        loss = -float(((got - np.log(total)) * share).sum())
        flat[at] -= total
        share = (share / total).astype(d.dtype)[:, None]
        dh = np.zeros_like(h)
        dh[here] = (d @ p["out"].T) * share
        some *= share
        g = {"out": some.T @ d, "wv": met.reshape(-1, WIDTH).T @ dh}
        dmet = (dh @ p["wv"].T).reshape(n, m, WIDTH)
        np.multiply(dmet, r, out=z[:, :, :WIDTH])
        np.negative(np.einsum("abc,abc->ab", z[:, :, :WIDTH], met), out=z[:, :, WIDTH])
        np.matmul(z, x1.transpose(0, 2, 1), out=ds)
        ds *= e
        dq = (ds @ x).reshape(-1, WIDTH)
        g["both"] = asked.T @ dq
        dx = left.transpose(0, 2, 1) @ right[:, :, :WIDTH]
        dh += dq @ both.T
        dx[:, first:] += dh.reshape(n, m, WIDTH)
        g["place"] = dx.sum(axis=0)
        return loss, g, dx

    def fit(self, before: np.ndarray, after: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01) -> list[float]:
        """Adam over batches of windows, all windows in one shuffled order after the other; there are as many steps more as
        the first order takes. The losses."""
        r = np.random.default_rng(11)
        steps = max(steps, -(-len(before) // batch))
        picks = (order[at : at + batch] for _ in iter(int, 1) for order in [r.permutation(len(before))] for at in range(0, len(before), batch))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1 if len(before) else 1):
            pick = next(picks)
            loss, g = self.gradients(before[pick], after[pick].astype(np.int64), weight[pick])
            losses.append(loss)
            now = rate * min(1, t / 20) * (1 - 0.9 * t / steps)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.98 * s[k] + 0.02 * x * x
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.98**t)) + 1e-8)).astype(np.float32)
        return losses

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE) -> int:
        """Adam over batches of windows, each once; how many windows there were."""
        # all weights are parts of one array, so that a step is few operations
        flat = np.concatenate([self.p[k].reshape(-1) for k in self.NAMES])
        ends = np.cumsum([self.p[k].size for k in self.NAMES])
        self.p = {k: x.reshape(self.p[k].shape) for k, x in zip(self.NAMES, np.split(flat, ends[:-1]), strict=True)}
        m, s, n = np.zeros_like(flat), np.zeros_like(flat), 0
        for t, (before, after, weight) in enumerate(batches, 1):
            _, g = self.gradients(before, after.astype(np.int64), weight)
            x = np.concatenate([g[k].reshape(-1) for k in self.NAMES]).astype(flat.dtype, copy=False)
            m *= 0.9
            m += 0.1 * x
            x *= x
            x *= 0.02
            s *= 0.98
            s += x
            np.divide(s, 1 - 0.98**t, out=x)
            np.sqrt(x, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate * min(1, t / 20) / (1 - 0.9**t)
            flat -= x
            n += len(before)
        return n


@dataclass
class Model:
    """All that scoring needs: classes, attention, log probability of each id in its class after each seen id."""

    classes: Classes
    attention: Attention
    within: np.ndarray
    last: np.ndarray  # of each id in its column, which is one id but for the last column

    def score(self, ids: list[np.ndarray], at_once: int = AT_ONCE) -> np.ndarray:
        """Natural log probability of each sequence of ids; windows of many documents are scored together."""
        return self.score_flat(np.concatenate(ids), np.array([len(x) for x in ids], np.int64), at_once)

    def score_flat(self, flat: np.ndarray, lengths: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
        """The same for sequences that stand one after the other; none is empty."""
        begin = np.cumsum(lengths) - lengths
        # as many more as a window has, so that each window is whole
        previous = np.full(len(flat) + WINDOW, SEEN, np.intp)
        previous[1 : len(flat)] = self.classes.seen[flat[:-1]]
        previous[begin] = SEEN
        total = np.add.reduceat(self.within.reshape(-1).take(previous[: len(flat)] * OWN + self.classes.own[flat]) + self.last[flat], begin, dtype=np.float64)
        doc, start, first, places = windows(lengths)
        predicted = np.zeros(len(previous), np.intp)
        predicted[: len(flat)] = self.classes.predicted[flat]
        previous, predicted = (np.lib.stride_tricks.sliding_window_view(x, WINDOW) for x in (previous, predicted))
        begins = begin[doc] + start
        step = np.arange(WINDOW)
        bounded, folded = self.attention.bounded(), self.attention.folded()
        for skip in (0, WINDOW - STRIDE):
            group = np.flatnonzero(first == skip)
            for at in range(0, len(group), at_once):
                o = group[at : at + at_once]
                got = self.attention.log_probs(previous[begins[o]], predicted[begins[o]], skip, bounded, folded)
                got[step[skip:] >= places[o][:, None]] = 0
                total += np.bincount(doc[o], weights=got.sum(axis=1, dtype=np.float64), minlength=len(lengths))
        return total


def training_windows(ids: list[np.ndarray], classes: Classes, first_one: int = 0, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents, one in `every` from first_one on, as (seen before, predicted, weight)."""
    lengths = np.array([len(x) for x in ids], np.int64)
    if not len(lengths):
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.float32)
    flat = np.concatenate(ids)
    doc, start, first, places = (x[first_one::every] for x in windows(lengths))
    step = np.arange(WINDOW)
    where = np.minimum(((np.cumsum(lengths) - lengths)[doc] + start)[:, None] + step, len(flat) - 1)
    before = np.where((start == 0)[:, None] & (step == 0), SEEN, classes.seen[flat[np.maximum(where - 1, 0)]])
    weight = ((step >= first[:, None]) & (step < places[:, None])).astype(np.float32)
    return before, classes.predicted[flat[where]], weight


def _lower(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(text.cast(pa.string()))


def _ids(encoder: WordEncoder, cut: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ids of lower-case texts, each with the end, as unsigned 16-bit; end of each text)."""
    ids, ends = encoder.closed(cut, END)
    return ids.astype("<u2"), ends


def summed(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Distinct words of several batches with the sums of their counts."""
    table = pa.table({"w": pa.chunked_array(words), "n": pa.array(np.concatenate(counts), pa.int64())}).group_by("w").aggregate([("n", "sum")])
    return table.column("w").combine_chunks(), table.column("n_sum").combine_chunks()


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Partial counts (kind, key, n) over the training documents: 0 a word (the end is the empty word), 1 an id; and kind 3, each document with its ids (unsigned 16-bit), so that no text is encoded twice."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(COUNTS))

    def rows(count: int, **columns: object) -> pa.RecordBatch:
        return to_batch({f.name: columns.get(f.name, pa.nulls(count, f.type)) for f in schema}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer, CACHED)
        total = np.zeros(VOCABULARY, np.int64)
        held: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                words, n = summed(*held)
                yield rows(len(words), kind=np.zeros(len(words), np.int8), key=words.cast(pa.binary()), n=n)
                held[0].clear()
                held[1].clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                docs = part.column("doc_id").to_pylist()
                out = np.array([held_out(d) for d in docs])
                text = _lower(part.column("text"))
                cut = cut_words(text)
                ids, ends = _ids(encoder, cut)
                yield rows(len(docs), kind=np.full(len(docs), 3, np.int8), doc_id=part.column("doc_id"), held_out=out, text=part.column("text"), ids=split_buffer(ids, ends))
                if out.all():
                    continue
                teaches = np.repeat(~out, np.diff(np.concatenate(([0], ends))))
                total += np.bincount(ids[teaches], minlength=VOCABULARY)
                tokens, _, codes, words = cut
                teaches = np.repeat(~out, np.diff(tokens, prepend=0))
                n = np.bincount(codes[teaches], minlength=len(words))
                held[0].append(words.filter(pa.array(n > 0)))
                held[1].append(n[n > 0])
                held[0].append(pa.array([""]))
                held[1].append(np.array([(~out).sum()]))
                if sum(map(len, held[0])) > HELD:
                    yield from flush()
        yield from flush()
        some = np.flatnonzero(total)
        keys = some.astype(">u4").tobytes()
        yield rows(len(some), kind=np.full(len(some), 1, np.int8), key=[keys[4 * k : 4 * k + 4] for k in range(len(some))], n=total[some])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, COUNTS)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The ids of up to 200 documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.slice(at, 200).column("ids").to_pylist()]


def paired(encoded: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of each column after each seen id, over all rows of encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((SEEN + 1) * OWN, np.int64)
        for seqs in _sequences(batches):
            flat = np.concatenate(seqs)
            before = np.concatenate(([0], classes.seen[flat[:-1]])).astype(np.int64)
            before[np.cumsum([0, *map(len, seqs[:-1])])] = SEEN
            np.add.at(pairs, before * OWN + classes.own[flat], 1)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(pairs[some], pa.int64())], names=["key", "n"])

    out = np.zeros((SEEN + 1) * OWN, np.int64)
    got = encoded.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(SEEN + 1, OWN)


def window_count(encoded: DataFrame) -> tuple[int, int]:
    """Rows of encoded, and their windows (see windows)."""
    count = F.greatest(F.lit(1), F.ceil((F.octet_length("ids") / 2 - (WINDOW - STRIDE)) / STRIDE))
    return tuple(int(x or 0) for x in encoded.agg(F.count(F.lit(1)), F.sum(count)).first())


def taught(attention: Attention, encoded: DataFrame, classes: Classes, rounds: int = ROUNDS, every: int = EVERY) -> int:
    """Train the weights on the windows of all rows of encoded, one in `every` in each round; how many windows that were.
    With as many rounds as `every`, each window teaches once.

    In each round each task goes on from the same weights over its own windows; the mean of what the tasks reach,
    weighted by their windows, is where the next round starts. Few sums of weights come to the driver.
    """
    spark, total = encoded.sparkSession, 0
    # the same rows in each task each round, so that the rounds' windows are different ones
    encoded = encoded.select("ids").coalesce(max(1, window_count(encoded)[1] // AT_TASK))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((attention, classes))
        offset, rate = k * every // rounds, RATE * (1 - k / rounds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, offset: int = offset, rate: float = rate) -> Iterator[pa.RecordBatch]:
            start, classes = shared.value
            mine = Attention(start.prior)
            mine.p = dict(start.p)

            def chosen() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                held, size, first = [], 0, offset
                for seqs in _sequences(batches):
                    held.append(training_windows(seqs, classes, first, every))
                    size += len(held[-1][0])
                    there = len(windows(np.array([len(x) for x in seqs], np.int64))[0])
                    first = (first - there) % every
                    if size >= BATCH:
                        joined = tuple(map(np.concatenate, zip(*held, strict=True)))
                        for at in range(0, size, BATCH):
                            yield tuple(x[at : at + BATCH] for x in joined)
                        held, size = [], 0
                if size:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))

            if n := mine.learn(chosen(), rate):
                flat = np.concatenate([mine.p[x].reshape(-1) for x in Attention.NAMES]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "w"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, 0.0
            for batch in batches:
                for one, w in zip(batch.column("n").to_pylist(), batch.column("w").to_pylist(), strict=True):
                    n, sums = n + one, sums + np.frombuffer(w)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["n", "w"])

        got = encoded.mapInArrow(run, "n long, w binary").repartition(SUMS).mapInArrow(added, "n long, w binary").collect()
        if n := sum(r["n"] for r in got):
            mean, at = sum(np.frombuffer(bytes(r["w"])) for r in got) / n, 0
            for x in Attention.NAMES:
                old = attention.p[x]
                attention.p[x] = mean[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size
        total += n
    return total


def _table(counts: DataFrame, kind: int, size: int) -> np.ndarray:
    """Counts of one kind, whose keys are numbers below size, as an array."""
    out = np.zeros(size, np.int64)
    got = counts.where(F.col("kind") == kind).select(F.conv(F.hex("key"), 16, 10).cast("long").alias("k"), "n").toArrow()
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def fitted(docs: DataFrame, tokenizer: str, owner: str, sample: int = FEW, steps: int = STEPS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of word counts, and the documents with their ids.

    Which ids get classes of their own, the counts of words, ids and class pairs, and the attention weights come from all
    training documents. The weights start at random and learn from every window: on the driver where there are at most
    `sample` training documents, and no more windows than the steps take, and by all tasks otherwise. Nothing is sampled.
    """
    parts = materialize(counted(docs, tokenizer), owner, "parts", spread=True)
    table = materialize(parts.where("kind < 3").groupBy("kind", "key").agg(F.sum("n").alias("n")), owner, "counts")
    counts = _table(table, 1, VOCABULARY)
    classes = Classes.of(counts)
    training = parts.where("kind = 3 AND NOT held_out")
    joint = paired(training, classes).astype(np.float64)
    seen = counts + 0.5
    column = np.bincount(classes.own, weights=seen, minlength=OWN)
    class_of = np.zeros(OWN, np.int64)
    class_of[classes.own] = classes.predicted
    member = np.zeros((OWN, CLASSES))
    member[np.arange(OWN), class_of] = 1
    pairs = joint @ member
    overall = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + CLASSES)
    prior = np.log((pairs + 20 * overall) / (pairs.sum(axis=1, keepdims=True) + 20))
    share = column / np.bincount(class_of, weights=column, minlength=CLASSES)[class_of]
    within = np.log((joint + 5 * share) / (pairs + 5)[:, class_of]).astype(np.float32)
    attention = Attention(prior)
    rows, there = window_count(training)
    if rows <= sample and there <= steps * BATCH:
        sequences = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in training.select("ids").orderBy("ids").collect()]
        attention.fit(*training_windows(sequences, classes), steps=steps)
    else:
        taught(attention, training, classes)
    return Model(classes, attention, within, np.log(seen / column[classes.own])), table.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c")), parts.where("kind = 3").select("doc_id", "held_out", "text", "ids")


def least_count(words: DataFrame, most: int) -> int:
    """The least power of two such that at most so many words have that count: from a histogram of at most 64 rows."""
    sizes = {r["k"]: r["n"] for r in words.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    k, n = max(sizes, default=0) + 1, 0
    while k > 0 and n + sizes.get(k - 1, 0) <= most:
        k -= 1
        n += sizes.get(k, 0)
    return 1 << k


def lm_scores(docs: DataFrame, tokenizer: str | None = None, sample: int = FEW, steps: int = STEPS, frequent: int = FREQUENT, owner: str = "op2") -> DataFrame:
    """Base and model score of each document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Both are log10 probabilities of the whole lower-case text, end included, from models that learn from the documents
    whose id's CRC-32 is not divisible by ten. The model predicts subword ids of a public tokenizer by windows of WINDOW
    ids that overlap by WINDOW - STRIDE; each id is scored once.

    A null text is empty (one token, the end); a null id hashes as empty text and so is held out; equal rows are scored
    each; without training documents every word is unknown; an empty table gives an empty result; only doc_id and text
    are read. Frequent words (at most `frequent`) are scored from a dictionary on the spot; the others meet their counts
    in a join, by word, in which words that many documents share are few because the most frequent ones are not in it.
    A text of any length is one sequence, scored in windows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    model, words, encoded = fitted(docs, tokenizer, owner, sample, steps)
    total, distinct = (int(x or 0) for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    whole = total + 0.1 * (distinct + 1)
    often = words.where(F.col("c") >= least_count(words, frequent)).select(F.col("word").cast("string"), "c").toArrow()
    end = sum(r["c"] for r in words.where(F.col("word") == F.lit(b"")).collect())
    end_score = math.log10((end + 0.1) / whole)
    top = dict(zip(often.column("word").to_pylist(), np.log10((often.column("c").to_numpy() + 0.1) / whole).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((model, top))
    schema = to_arrow_schema(_parse_datatype_string(SCORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = []
                for k in range(0, part.num_rows, 100):
                    ids = part.column("ids").slice(k, 100)
                    lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 2
                    scores.append(model.score_flat(np.frombuffer(b"".join(ids.to_pylist()), "<u2").astype(np.int64), lengths) / math.log(10))
                ends, words, codes, distinct = cut_words(_lower(part.column("text")))
                known = np.array([top.get(w, np.nan) for w in strings(distinct)], np.float64)[codes]
                rare = np.isnan(known)
                # summed document by document, so a sum does not depend on its neighbours
                bounds = np.concatenate(([0], ends))
                base = np.array([np.where(rare[a:b], 0.0, known[a:b]).sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                unknown = np.concatenate(([0], np.cumsum(rare)))[bounds]
                lists = pa.ListArray.from_arrays(pa.array(unknown, pa.int32()), words.filter(pa.array(rare)).cast(pa.binary())).cast(schema.field("rare").type)
                yield to_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": ends - bounds[:-1] + 1, "n_known": ends - bounds[:-1] + (end > 0) - np.diff(unknown), "base": base + end_score, "score": np.concatenate(scores), "rare": lists}, schema)

    scored = materialize(encoded.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id()), owner, "scored", spread=True)
    drop_table(encoded, owner)  # the largest table; nothing reads it any more
    rare = scored.select("row", F.explode("rare").alias("w"))
    found = rare.join(words, F.col("w") == F.col("word"), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = found.groupBy(F.col("row").alias("s_row")).agg(F.sum(F.log10((c + F.lit(0.1)) / F.lit(whole))).alias("more"), F.count(F.col("c")).alias("known"))
    out = scored.drop("rare").join(sums, F.col("row") == F.col("s_row"), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of the documents table."""
    return lm_scores(documents(spark, sf_dir))
