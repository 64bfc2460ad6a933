"""A gated recurrent language model in numpy, and a smoothed unigram base, over whole documents.

Tokens: lower-cased words (A-Z only), then one end.  Counts of all training tokens come from the whole training part
by one exchange: each batch of texts tells every distinct word once, with its count, and gets the corpus's count back.

The model reads the previous token and predicts the next: first its class, then the word in the class.  The
``VOCABULARY`` most frequent training words stand in ``CLASSES`` classes by frequency; the end and "any other word" are
classes of their own, and another word's share of the latter is its smoothed count's, so all probabilities of a next
token sum to one.  Weights are fitted on all training documents by truncated backpropagation: ``STREAMS`` lanes of
documents, ``STEPS`` tokens a window, the state handed from window to window and set to zero where a document begins;
only when few long documents of a task are left, these go on in stretches, each of which begins without a state.
Each round takes some batches: every task goes on from the round's weights over all its training texts, and the next
round's weights are the mean by tokens.  Rounds, and tasks in a round, grow with the square root of the partitions, and
each batch is in one round.  Weights so depend on how the input is dealt out.  Scoring carries each document's state
through all its windows.

Null and empty texts have the end alone.  Repeated rows are scored, and counted, one by one.  A null id counts as an
empty id text.  Without any training tokens the model is the base.  An empty table gives no rows.  Further columns,
whatever their names, are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import Words, binary, byte_column, checkpoint_folder, crc_of, crc_of_id, cut, exists, remove
from veridicta.llm.repeats import _rows, pack, record, tell, unpacked

FOLDS, HELD_OUT = 7, 2
VOCABULARY, CLASSES, HIDDEN = 2000, 45, 32
STREAMS, STEPS, EPOCHS, LEAST_WINDOWS = 192, 24, 1, 300
RATE = 4e-3
SUMS = 8
FEW = 8  # rows of a word
SETTLED = 1 << 13  # tokens scored between two passes of the output layers, whose values then stay in the cache
PART_VALUES = 1_500_000
BATCH_BYTES, SCORED_BYTES = 4 << 20, 12 << 20
_COUNTS = "batch long, part long, counts binary, kinds long, total long, top array<struct<h:long,n:long>>"
_TOLD = "part long, batch long, value binary, extra binary, doc binary, place binary"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


LARGEST, LEAST = 60.0, 1e-25  # exponentials and their sums that are well inside a float32
_ones = np.ones(1, np.float32)


def _log_softmax_at(logits: Callable[[], np.ndarray], place: np.ndarray, rows: np.ndarray, all_: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Each row's log softmax at its place and, with ``all_``, its softmax.  Rows are set off by their largest value only
    where some are very large or small, since a row's own maximum costs more than its exponentials."""
    global _ones
    x = logits()
    if len(_ones) < x.shape[1]:
        _ones = np.ones(x.shape[1], np.float32)
    ones = _ones[: x.shape[1]]
    if safe := x.max() < LARGEST:
        here = x[rows, place]
        np.exp(x, out=x)
        total = x @ ones
        safe = total.min() > LEAST
    if not safe:
        x = logits()
        x -= x.max(1, keepdims=True)
        here = x[rows, place]
        np.exp(x, out=x)
        total = x @ ones
    if all_:
        x /= total[:, None]
    return here - np.log(total), x if all_ else None


def _sums(words: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Puts the sum of each word's rows into its row of ``out``; words are sorted.  A frequent word's rows are added up by
    themselves, the others' first, second, third ... rows for all words together."""
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    n = np.diff(np.r_[first, len(words)])
    at = words[first]
    out[at] = rows[first]
    some = np.flatnonzero((n > 1) & (n <= FEW))
    for k in range(1, FEW):
        some = some[n[some] > k]
        if len(some):
            out[at[some]] += rows[first[some] + k]
    for i in np.flatnonzero(n > FEW).tolist():
        np.add.reduce(rows[first[i] : first[i] + n[i]], 0, out=out[at[i]])


@dataclass
class Vocabulary:
    """Tokens: 0 .. size - 1 the known words by falling count, then any other word, then the end."""

    words: np.ndarray  # hashes, by falling count
    counts: np.ndarray
    ends: int
    total: int
    kinds: int

    def __post_init__(self):
        self.order = np.argsort(self.words, kind="stable")
        self.sorted = self.words[self.order]
        self.size = len(self.words)
        self.other, self.end = self.size, self.size + 1
        self.per_class = max(1, -(-self.size // CLASSES))
        self.classes = -(-self.size // self.per_class) + 2
        self.rest = (self.total - int(self.counts.sum()) - self.ends) + (self.kinds - self.size - (self.ends > 0)) + 1

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), self.other, np.int64)
        i = np.minimum(np.searchsorted(self.sorted, hashes), self.size - 1)
        return np.where(self.sorted[i] == hashes, self.order[i], self.other)

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.size, token // self.per_class, self.classes - 2 + (token - self.size))


class Model:
    def __init__(self, v: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, self.v = HIDDEN, v
        f = np.float32
        self.input = rng.normal(0, 0.3, (v.size + 2, 3 * h)).astype(f)
        self.recur = rng.normal(0, h**-0.5 * 0.7, (h, 3 * h)).astype(f)
        self.to_class = rng.normal(0, 0.05, (h, v.classes)).astype(f)
        self.to_word = rng.normal(0, 0.05, (v.classes - 2, h, v.per_class)).astype(f)
        count = np.zeros((v.classes - 2) * v.per_class)
        count[: v.size] = v.counts
        per = count.reshape(v.classes - 2, v.per_class)
        mass = np.r_[per.sum(1), max(1, v.total - v.counts.sum() - v.ends), max(1, v.ends)]
        self.class_bias = np.log(mass / mass.sum()).astype(f)
        with np.errstate(divide="ignore"):
            self.word_bias = np.where(per > 0, np.log(per / np.maximum(per.sum(1, keepdims=True), 1)), -1e4).astype(f)

    def parameters(self):
        return [self.input, self.recur, self.to_class, self.to_word, self.class_bias, self.word_bias]

    def step(self, token: np.ndarray, state: np.ndarray):
        h = HIDDEN
        x, u = self.input[token], state @ self.recur
        x[:, : 2 * h] += u[:, : 2 * h]
        gates = _sigmoid(x[:, : 2 * h].copy())
        z, r = gates[:, :h], gates[:, h:]
        n = r * u[:, 2 * h :]
        n += x[:, 2 * h :]
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        return new, (z, r, n, u[:, 2 * h :])

    def outputs(self, state: np.ndarray, target: np.ndarray, learn: list | None = None) -> np.ndarray:
        """Natural log probability of each target; with ``learn`` also the gradients of the summed loss."""
        v = self.v
        kind = v.class_of(target)
        rows = np.arange(len(target))
        out, d = _log_softmax_at(lambda: state @ self.to_class + self.class_bias, kind, rows, learn is not None)
        if learn is not None:
            d[rows, kind] -= 1
            to_state = d @ self.to_class.T
            to_class, class_bias = state.T @ d, d.sum(0)
            to_word, word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        by = np.argsort(kind.astype(np.uint16), kind="stable")  # a class's rows together
        edge = np.searchsorted(kind[by], np.arange(v.classes - 1)).tolist()
        if n := edge[-1]:
            some = by[:n]
            place = target[some] % v.per_class
            mine = np.ones((n, HIDDEN + 1), state.dtype)  # the ones are for the biases
            mine[:, :-1] = state[some]
            weights = np.concatenate([self.to_word, self.word_bias[:, None]], 1)
            runs = [(c, i, j) for c, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]

            def words():
                x = np.empty((n, v.per_class), np.result_type(mine, weights))
                for c, i, j in runs:
                    np.matmul(mine[i:j], weights[c], out=x[i:j])
                return x

            logs, d = _log_softmax_at(words, place, rows[:n], learn is not None)
            out[some] += logs
            if learn is not None:
                d[rows[:n], place] -= 1
                back, both = np.empty((n, HIDDEN), d.dtype), np.zeros_like(weights)
                for c, i, j in runs:
                    np.matmul(d[i:j], self.to_word[c].T, out=back[i:j])
                    np.matmul(mine[i:j].T, d[i:j], out=both[c])
                to_word, word_bias = np.ascontiguousarray(both[:, :-1]), both[:, -1].copy()
                to_state[some] += back
        if learn is not None:
            learn += [to_state, to_class, to_word, class_bias, word_bias]
        return out

    def log_likelihood(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each token sequence, without other words' shares of their class."""
        size = np.array([len(d) for d in documents])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        out = np.zeros(len(documents))
        state = np.zeros((len(documents), HIDDEN), np.float32)
        flat = np.concatenate([documents[i] for i in order])
        begin = np.cumsum(size) - size
        previous = np.full(len(documents), self.v.end)
        live = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []  # documents longer than t
        states, targets, whose = [], [], []

        def settle():
            if states:
                logp = self.outputs(np.concatenate(states), np.concatenate(targets))
                out[:] += np.bincount(np.concatenate(whose), weights=logp, minlength=len(out))
                states.clear(), targets.clear(), whose.clear()

        held = 0
        for t, n in enumerate(live):
            state = self.step(previous[:n], state[:n])[0]
            token = flat[begin[:n] + t]
            states.append(state)
            targets.append(token)
            whose.append(np.arange(n))
            previous = token
            held += n
            if held >= SETTLED:
                settle()
                held = 0
        settle()
        back = np.empty(len(documents))
        back[order] = out
        return back

    def train(self, documents: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        adam: list = []
        passes = epochs if documents else 0
        done, size = 0, sum(map(len, documents))
        while done < passes:
            windows = self.run(iter([documents[i] for i in rng.permutation(len(documents))]), adam, lambda seen, done=done: rate * max(0.05, 1 - (done + seen / size) / passes))
            if not done:  # small corpora are passed more often
                passes = max(epochs, -(-LEAST_WINDOWS // windows))
            done += 1
        return self

    def run(self, documents: Iterator[np.ndarray], adam: list, rate: Callable[[int], float]) -> int:
        """One pass over documents that come one by one; how many windows it took.  Every lane reads a document to its
        end, carries its state from window to window, and then takes the next one, so lanes stay full while documents
        last.  When few long ones are left, they go on in stretches, all lanes together.  ``adam``: the moments and how many windows they have seen, which go on over calls;
        ``rate``: of the tokens seen so far."""
        if not adam:
            adam += [[(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()], 0]
        end = np.array([self.v.end])
        lanes = [end for _ in range(STREAMS)]  # what was read last, and what is to come
        state = np.zeros((STREAMS, HIDDEN), np.float32)
        seen = windows = 0
        dry = False
        while lanes:
            for k, x in enumerate(lanes):
                while len(x) <= STEPS and not dry:
                    if (d := next(documents, None)) is None:
                        dry = True
                    else:
                        x = lanes[k] = np.concatenate([x, d])
            left = np.array([len(x) - 1 for x in lanes])
            if dry and np.count_nonzero(left) < STREAMS // 2 and left.max() > 4 * STEPS:
                lanes, state = self._dealt(lanes, state)
                left = np.array([len(x) - 1 for x in lanes])
            if not left.all():
                keep = np.flatnonzero(left)
                lanes, state, left = [lanes[k] for k in keep], state[keep], left[keep]
                if not lanes:
                    break
            span = min(STEPS, int(left.max()))
            pair = np.full((len(lanes), span + 1), self.v.end)
            for k, x in enumerate(lanes):
                pair[k, : min(len(x), span + 1)] = x[: span + 1]
                lanes[k] = x[min(span, len(x) - 1) :]
            real = (np.arange(span) < left[:, None]).astype(np.float32)
            adam[1] += 1
            windows += 1
            # where few lanes are left, a window has fewer tokens and moves the weights by as much less
            state = self._window(pair[:, :-1], pair[:, 1:], real, state, adam[0], adam[1], rate(seen) * len(lanes) / STREAMS)
            seen += int(real.sum())
        return windows

    @staticmethod
    def _dealt(lanes: list[np.ndarray], state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What is left of a few long documents, in stretches for all lanes; a stretch begins without a state."""
        size = max(4 * STEPS, -(-sum(len(x) - 1 for x in lanes) // STREAMS))
        parts = [(x[i : i + size + 1], state[k] if not i else np.zeros_like(state[k])) for k, x in enumerate(lanes) for i in range(0, len(x) - 1, size)]
        return [x for x, _ in parts], np.array([y for _, y in parts])

    def gradients(self, before: np.ndarray, token: np.ndarray, real: np.ndarray, state: np.ndarray):
        """(gradients of the summed negative log probability of the real tokens, state after the window): one window of
        truncated backpropagation, with the steps' products taken together where they don't depend on each other."""
        h, lanes, steps = HIDDEN, *before.shape
        begins = before.T == self.v.end  # a document begins after an end
        room = self.__dict__.setdefault("_room", {})  # kept over windows, since fresh memory costs as much as the sums

        def kept(name: str, *shape: int) -> np.ndarray:
            n = int(np.prod(shape))
            if len(room.get(name, ())) < n:
                room[name] = np.empty(n, np.float32)
            return room[name][:n].reshape(shape)

        x = np.take(self.input, before.T, 0, out=kept("x", steps, lanes, 3 * h), mode="clip")
        inputs, states, gates, u, n = kept("inputs", steps, lanes, h), kept("states", steps, lanes, h), kept("gates", steps, lanes, 2 * h), kept("u", steps, lanes, 3 * h), kept("n", steps, lanes, h)
        for t in range(steps):
            inputs[t] = state
            inputs[t][begins[t]] = 0
            np.matmul(inputs[t], self.recur, out=u[t])
            g = np.add(x[t, :, : 2 * h], u[t, :, : 2 * h], out=gates[t])
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            y = np.multiply(g[:, h:], u[t, :, 2 * h :], out=n[t])
            y += x[t, :, 2 * h :]
            np.tanh(y, out=y)
            state = np.subtract(inputs[t], y, out=states[t])
            state *= g[:, :h]
            state += y
        state = state.copy()
        use = real.T.ravel() > 0
        learn: list = []
        self.outputs(states.reshape(-1, h)[use], token.T.ravel()[use], learn)
        to_states = kept("to_states", steps * lanes, h)
        to_states[...] = 0
        to_states[use] = learn[0]
        to_states = to_states.reshape(steps, lanes, h)
        around, factor = kept("around", steps, lanes, 3, h), kept("factor", steps, lanes, 3, h)
        # what doesn't depend on later steps, for all of them: how much of a state's gradient each gate's sum gets
        z, r = gates[:, :, :h], gates[:, :, h:]
        to_n = np.subtract(1, z, out=kept("to_n", steps, lanes, h))
        to_z = np.subtract(inputs, n, out=kept("to_z", steps, lanes, h))
        to_z *= z
        np.multiply(to_z, to_n, out=factor[:, :, 0])
        n *= n
        np.subtract(1, n, out=n)
        to_n *= n
        through = np.multiply(to_n, r, out=factor[:, :, 2])
        to_r = np.subtract(1, r, out=to_z)
        to_r *= u[:, :, 2 * h :]
        np.multiply(to_r, through, out=factor[:, :, 1])
        back, d_state, held = np.ascontiguousarray(self.recur.T), np.zeros((lanes, h), np.float32), np.empty((lanes, h), np.float32)
        for t in range(steps - 1, -1, -1):
            d = to_states[t]
            d += d_state
            np.multiply(d[:, None], factor[t], out=around[t])
            np.matmul(around[t].reshape(lanes, 3 * h), back, out=d_state)
            d_state += np.multiply(d, z[t], out=held)
            d_state[begins[t]] = 0
        d_recur = inputs.reshape(-1, h).T @ around.reshape(-1, 3 * h)
        np.multiply(to_states, to_n, out=around[:, :, 2])  # the input's part does not go through the reset gate
        words = before.T.ravel()
        by = np.argsort(words.astype(np.uint32) if self.v.size >= 1 << 16 else words.astype(np.uint16), kind="stable")
        d_input = np.zeros_like(self.input)
        _sums(words[by], around.reshape(-1, 3 * h)[by], d_input)
        return [d_input, d_recur, *learn[1:]], state

    def _window(self, before, token, real, state, moments, turn, rate):
        grads, state = self.gradients(before, token, real, state)
        scale = np.float32(100 / max(1, real.sum()))
        norm = scale * np.sqrt(sum(float(np.dot(g.ravel(), g.ravel())) for g in grads))
        scale *= np.float32(min(1.0, 100 / max(norm, 1e-9)))
        largest = max(g.size for g in grads)
        room = self.__dict__.setdefault("_room", {})
        if len(room.get("step", ())) < largest:
            room["step"] = np.empty(largest, np.float32)
        for p, g, (m, s) in zip(self.parameters(), grads, moments, strict=True):
            step = room["step"][: g.size].reshape(g.shape)
            g *= scale
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1), out=step)
            np.multiply(g, g, out=step)
            step *= np.float32(0.01)
            s *= np.float32(0.99)
            s += step
            np.sqrt(s, out=step)
            step *= np.float32((1 - 0.99**turn) ** -0.5)
            step += np.float32(1e-6)
            np.divide(m, step, out=step)
            step *= np.float32(rate / (1 - 0.9**turn))
            p -= step
        return state


def _told(row: dict):
    """A batch's distinct words, sorted by hash, their training counts, and what is needed to look them up again."""
    rows = unpacked(row["rows"])
    doc = rows.column("doc_id").to_pylist()
    w = Words(byte_column(rows.column("text")), lower=True)
    train = np.array([crc_of(i) % FOLDS != HELD_OUT for i in doc], bool)
    value, inverse = np.unique(w.hash, return_inverse=True)
    count = np.bincount(inverse, weights=np.repeat(train, w.count).astype(float), minlength=len(value)).astype(np.uint64)
    return rows, w, train, value, inverse, count


def corpus_counts(packed: DataFrame, parts: int) -> DataFrame:
    """For each batch and part, the corpus's counts of the batch's words of that part, in their order; and for each
    part a row without batch: distinct training words, training words, the most frequent ones."""

    def told(batches):
        for row in _rows(batches):
            *_, value, _, count = _told(row)
            if out := tell(row["batch"], parts, value, extra=count.astype(np.uint64)):
                yield record(out, _TOLD)

    def reply(t: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(byte_column(t.column("value"))), np.uint64)
        count = np.frombuffer(b"".join(byte_column(t.column("extra"))), np.uint64)
        kinds, inverse = np.unique(value, return_inverse=True)
        total = np.bincount(inverse, weights=count.astype(float), minlength=len(kinds)).astype(np.int64)
        part = t.column("part")[0].as_py()
        by_batch, at = [], 0
        for b, v in zip(t.column("batch").to_pylist(), byte_column(t.column("value")), strict=True):
            n = len(v) // 8
            by_batch.append((b, part, binary(total[inverse[at : at + n]]), 0, 0, []))
            at += n
        most = np.lexsort((kinds, -total))[:VOCABULARY]
        top = [{"h": int(h), "n": int(n)} for h, n in zip(kinds[most].view(np.int64), total[most], strict=True) if n]
        by_batch.append((None, part, None, int((total > 0).sum()), int(total.sum()), top))
        kind = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))]
        names = [c.split()[0] for c in ("batch", "part", "counts", "kinds", "total", "top")]
        return pa.table([pa.array([r[i] for r in by_batch], k) for i, k in enumerate(kind)], names)

    return packed.mapInArrow(told, _TOLD).groupBy("part").applyInArrow(reply, _COUNTS)


def vocabulary(documents: DataFrame, counts: DataFrame) -> Vocabulary:
    sums = counts.where("batch IS NULL").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).first()
    top = counts.where("batch IS NULL").select(F.explode("top").alias("t")).select("t.h", "t.n").orderBy(F.col("n").desc(), "h").limit(VOCABULARY).collect()
    ends = documents.where(crc_of_id() % FOLDS != HELD_OUT).count()
    return Vocabulary(
        np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64), ends, (sums["total"] or 0) + ends, (sums["kinds"] or 0) + (ends > 0)
    )


def _round(part: DataFrame, model: Model, share: tuple[int, int]) -> int:
    """Trains on all training texts of some batches, each task on its own, and puts the mean of their weights into the
    model; how many tokens there were.  Tasks' weights are summed in ``SUMS`` groups before the driver gets them."""
    shared = part.sparkSession.sparkContext.broadcast(model)  # HIDDEN, VOCABULARY and CLASSES bound its size

    def learn(batches):
        model = Model.__new__(Model)  # the broadcast one stays as it is: workers are used again
        for name, x in vars(shared.value).items():
            setattr(model, name, x.copy() if isinstance(x, np.ndarray) else x)
        v, counted, held = model.v, [0], []

        def documents():
            for row in _rows(batches):
                rows = unpacked(row["rows"])
                train = [crc_of(i) % FOLDS != HELD_OUT for i in rows.column("doc_id").to_pylist()]
                texts = [t for t, use in zip(byte_column(rows.column("text")), train, strict=True) if use]
                if texts:
                    w = Words(texts, lower=True)
                    token = v.tokens(w.hash)
                    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                        d = np.append(token[a:b], v.end)
                        counted[0] += len(d)
                        if counted[0] <= few:
                            held.append(d)
                        yield d

        fall = lambda _: RATE * max(0.05, 1 - (share[0] + 0.5) / share[1])
        few = LEAST_WINDOWS // share[1] * STREAMS * STEPS
        adam: list = []
        windows = model.run(documents(), adam, fall)
        seen = counted[0]
        if seen <= few and windows:  # a small part is passed more often
            for _ in range(-(-(LEAST_WINDOWS // share[1]) // windows) - 1):
                model.run(iter(held), adam, fall)
        if seen:
            weights = np.concatenate([p.ravel() for p in model.parameters()]).astype(np.float64) * seen
            group = TaskContext.get().partitionId() % SUMS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen]), pa.array([binary(weights)], pa.binary())], ["group", "seen", "weights"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("weights"))
        return pa.table([pa.array([sum(t.column("seen").to_pylist())]), pa.array([binary(total)], pa.binary())], ["seen", "weights"])

    told = part.mapInArrow(learn, "group int, seen long, weights binary")
    got = told.groupBy("group").applyInArrow(add, "seen long, weights binary").collect()  # at most SUMS rows
    shared.destroy()
    total = sum(r["seen"] for r in got)
    if total:
        mean = sum(np.frombuffer(r["weights"]) for r in got) / total
        at = 0
        for p in model.parameters():
            p[...] = mean[at : at + p.size].reshape(p.shape)
            at += p.size
    return total


def fit(packed: DataFrame, v: Vocabulary) -> tuple[Model, int]:
    """The weights from the whole training part, and how many tokens they were fitted on.  Batches are laid out by round
    in the shared folder, so a round reads its own only."""
    model, seen, spark = Model(v), 0, packed.sparkSession
    rounds = max(1, round(packed.rdd.getNumPartitions() ** 0.5))
    folder = f"{checkpoint_folder(spark)}/lm-{uuid.uuid4().hex}"
    packed.select("rows", F.pmod(F.spark_partition_id(), F.lit(rounds)).alias("round")).write.partitionBy("round").parquet(folder)
    for k in range(rounds):
        if exists(spark, f"{folder}/round={k}"):
            seen += _round(spark.read.schema("rows binary").parquet(f"{folder}/round={k}"), model, (k, rounds))
    remove(spark, folder)
    return model, seen


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every (doc_id, text)."""
    documents = documents.select("doc_id", "text")
    packed = pack(documents, BATCH_BYTES)
    parts = max(4, int((packed.agg(F.sum("size")).first()[0] or 0) / 24 / PART_VALUES) + 1)
    counts = cut(corpus_counts(packed, parts))
    model, _ = fit(packed, vocabulary(documents, counts))
    told = counts.where("batch IS NOT NULL").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("told"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # HIDDEN, VOCABULARY and CLASSES bound its size

    def prepared(v: Vocabulary, row: dict):
        """(token sequences, what other words add to their scores, the columns but the score) of a batch."""
        rows, w, _, value, inverse, _ = _told(row)
        by = np.argsort((value % np.uint64(parts)).astype(np.int64), kind="stable")
        total = np.zeros(len(value), np.int64)
        if row["told"]:
            total[by] = np.concatenate([np.frombuffer(x["counts"], np.int64) for x in row["told"]])
        log_base = np.log10((total + 1) / (v.total + v.kinds + 1))
        log_other = np.log10((total + 1) / v.rest)
        token = v.tokens(value)
        of_text = w.text_of()
        n = len(w.count)

        def added(x):
            return np.bincount(of_text, weights=x[inverse], minlength=n)

        base = added(log_base) + np.log10((v.ends + 1) / (v.total + v.kinds + 1))
        known = added((total > 0).astype(float)).astype(np.int64) + (v.ends > 0)
        word = token[inverse].astype(np.int32)
        texts = [np.append(word[a:b], np.int32(v.end)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        doc = rows.column("doc_id").combine_chunks()
        held = [crc_of(i) % FOLDS == HELD_OUT for i in doc.to_pylist()]
        columns = [doc.cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(w.count + 1), pa.array(known), pa.array(np.full(n, v.total)), pa.array(base)]
        return texts, added(np.where(token == v.other, log_other, 0.0)), columns

    def scored(model: Model, group: list):
        """Some batches together, since as many steps are taken as the longest text has tokens."""
        logs = model.log_likelihood([t for texts, *_ in group for t in texts]) / np.log(10) if model.v.total else None
        at = 0
        for texts, other, columns in group:
            score = columns[-1] if logs is None else pa.array(logs[at : at + len(texts)] + other)
            at += len(texts)
            yield pa.RecordBatch.from_arrays([*columns, score], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        model = shared.value
        group, size = [], 0
        for row in _rows(batches):
            group.append(prepared(model.v, row))
            size += row["size"]
            if size >= SCORED_BYTES:
                yield from scored(model, group)
                group, size = [], 0
        if group:
            yield from scored(model, group)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.join(told, "batch", "left").mapInArrow(run, schema)
