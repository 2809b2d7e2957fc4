"""Document scores by a gated recurrent language model.

*Corpus.*  Word counts of all training documents are one shuffle.  The
``HEAD`` most frequent words go to the workers; counts of rarer words reach
the documents by a join.  Texts are split twice: to be counted, and then into
ids, which are frozen for all rounds and for the scores.

*Model.*  A gated recurrent unit over the ``VOCAB`` most frequent words, an
end and an unknown token.  The output is factored: a softmax over classes of
words of about equal root frequency, then one over the words of the class; a
word outside the vocabulary gets the unknown token's probability times its
smoothed share of the counts outside.  So the probabilities of a text's tokens
given what precedes them sum to one.  Biases start at the corpus frequencies.

*Training.*  The training documents are dealt by hash to ``ROUNDS`` rounds and,
in each, to copies of about ``COPY_TOKENS`` tokens; a copy takes its documents in
the order of their hashes.  So neither the files' layout nor the number of
partitions matters.  A copy starts from the last round's model and learns by
truncated back-propagation (Adam, ``WINDOW`` steps, states carried from window to
window) on all documents dealt to it, at most about ``BLOCK`` tokens at a time;
a round ends with the copies' average by their tokens, summed by slices of the parameters.

*Scoring.*  A batch's documents run side by side, longest first, each from its
first token to its end with the state carried across windows.

Null text counts as empty: its end alone is scored.  A null doc_id is not held
out, and not learned from.  Without training documents all counts are 0 and
the model knows an end and unknown words only.  Rows that repeat a doc_id are
scored each.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frozen, text_or_empty

HEAD = 262_144
VOCAB = 4096
CLASSES = 62
HIDDEN = 16
WINDOW = 20
STREAMS = 256
#: train on one in so many documents by hash; 1: on all
EVERY = 1
#: averages of the copies, and tokens that a copy learns between two of them, about
ROUNDS = 4
COPY_TOKENS = 1_000_000
#: tokens that a worker holds at least before it trains on them
BLOCK = 4_000_000
#: parameters that are averaged together
PART = 4096
#: tokens and rows that are scored side by side: the few longest documents then run alone less often
SCORED_TOKENS, SCORED_ROWS = 4_000_000, 50_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(texts):
    """The words of an Arrow array of texts, and the place of each word's text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, owners = split.flatten(), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(words), 0)  # blanks around a text leave empty words
    return words.filter(some), owners.filter(some).to_numpy()


class Gru:
    """Ids 0..len(counts)-1 are words by falling frequency, then unknown, then end."""

    def __init__(self, counts, unknown: float, end: float, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        k = len(counts)
        self.unknown, self.end, self.hidden = k, k + 1, hidden
        freq = np.asarray([*counts, unknown, end], dtype=np.float64) + 1
        # a class for each slice of root frequency; unknown and end are classes of their own
        root = np.sqrt(freq[:k])
        cls = np.minimum((np.cumsum(root) - root) / max(root.sum(), 1e-9) * classes, classes - 1).astype(int) if k else np.empty(0, int)
        cls = np.unique(cls, return_inverse=True)[1] if k else cls
        n = int(cls.max()) + 1 if k else 0
        self.cls = np.r_[cls, n, n + 1].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, np.diff(self.cls) > 0])
        self.starts, self.stops = starts, np.r_[starts[1:], k + 2]  # the words of a class are neighbours
        self.inner = np.repeat(self.stops - starts > 1, self.stops - starts)  # words that are not their class's only one
        mass = np.add.reduceat(freq, starts)
        h, v, c = hidden, k + 2, n + 2
        self.p = {
            "embed": rng.normal(0, 0.3, (v, h)),
            "in": rng.normal(0, h ** -0.5, (h, 3 * h)),
            "rec": rng.normal(0, 0.5 * h ** -0.5, (h, 3 * h)),
            "gate_bias": np.r_[np.full(h, -1.0), np.zeros(2 * h)],  # the update gate starts nearly shut
            "class": np.zeros((h, c)),
            "class_bias": np.log(mass / mass.sum()),
            "word": np.zeros((v, h)),
            "word_bias": np.log(freq / mass[self.cls]),
        }
        self.p = {name: a.astype(np.float32) for name, a in self.p.items()}
        self.moments, self.steps = {}, 0

    def flat(self):
        import numpy as np

        return np.concatenate([a.ravel() for a in self.p.values()])

    def load(self, flat) -> None:
        import numpy as np

        at = 0
        for name, a in self.p.items():
            self.p[name] = np.asarray(flat[at:at + a.size], dtype=np.float32).reshape(a.shape)
            at += a.size

    def tables(self):
        """What each input adds to the gates, ready to be looked up."""
        return self.p["embed"] @ self.p["in"] + self.p["gate_bias"]

    def step(self, x, state):
        """Gates, proposed and new state; x: looked-up inputs (n, 3 * hidden)."""
        import numpy as np

        n, h = state.shape
        gates, new, after = (np.empty((n, k), dtype=state.dtype) for k in (2 * h, h, h))
        self.advance(x.T, (state @ self.p["rec"]).T, state.T, gates.T, new.T, after.T)
        return gates, new, after

    def advance(self, x, r, state, gates, new, after):
        """Fills gates (update, then reset), the proposed and the new state; streams are the last axis."""
        import numpy as np

        h = self.hidden
        np.add(x[:2 * h], r[:2 * h], out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[h:], r[2 * h:], out=new)
        new += x[2 * h:]
        np.tanh(new, out=new)
        np.subtract(new, state, out=after)
        after *= gates[:h]
        after += state
        return after

    def log_probs(self, states, targets, joined=None):
        """Natural log-probability of each target given its state."""
        import numpy as np

        h = self.hidden
        order = np.argsort(targets.astype(np.int16 if len(self.cls) < 32_000 else np.int32), kind="stable")
        y = targets[order]  # the tokens of a word, and those of a class, are neighbours
        cls = self.cls[y]
        flat = np.ones((len(y), h + 1), dtype=states.dtype)  # the ones carry the biases
        flat[:, :h] = states[order]
        classes, words, reach = joined or self._joined()
        logs = self._log_sums(flat, classes, reach)
        for a, b, i, j in self._classes_of(cls):
            logs[i:j] += self._log_sums(flat[i:j], words[a:b], reach)
        right = classes.take(cls, axis=0)
        right += words.take(y, axis=0)
        out = np.empty_like(logs)
        out[order] = np.einsum("ij,ij->i", flat, right) - logs
        return out

    def _classes_of(self, cls):
        """For each class of several words among the sorted ``cls``: its words' bounds and its tokens' bounds."""
        import numpy as np

        bounds = np.searchsorted(cls, np.arange(len(self.starts) + 1))
        found = np.flatnonzero((np.diff(bounds) > 0) & (self.stops - self.starts > 1))
        return zip(*(x[found].tolist() for x in (self.starts, self.stops, bounds[:-1], bounds[1:])))

    def _joined(self):
        """Weights of classes and of words with their biases as a last column (0 for the only word of a class, whose
        probability in it is 1), and a bound of the logits: states lie in [-1, 1]."""
        import numpy as np

        classes = np.column_stack([self.p["class"].T, self.p["class_bias"]])
        words = np.column_stack([self.p["word"], self.p["word_bias"]])
        words *= self.inner[:, None]
        return classes, words, max(np.abs(w).sum(axis=1).max() for w in (classes, words))

    @staticmethod
    def _exponentials(states, weights, reach):
        """Exponentials of the logits less a top by row: 0 where they cannot leave the range of a float."""
        import numpy as np

        logits = states @ weights.T
        top = 0
        if reach > 60:
            top = logits.max(axis=1)
            logits -= top[:, None]
        return np.exp(logits, out=logits), top

    def _log_sums(self, states, weights, reach):
        import numpy as np

        exps, top = self._exponentials(states, weights, reach)
        return top + np.log(exps @ np.ones(len(weights), dtype=exps.dtype))

    def gradients(self, inputs, targets, state):
        """Mean loss over a window (steps, streams), its gradients, and the state after it."""
        import numpy as np

        h, p = self.hidden, self.p
        steps, streams = inputs.shape
        small = np.int16 if len(self.cls) < 32_000 else np.int32
        seen = inputs.ravel()
        embed = p["embed"].take(seen, axis=0)
        # streams last, so that gates and states are whole rows
        x = np.ascontiguousarray((p["in"].T @ embed.T + p["gate_bias"][:, None]).reshape(3 * h, steps, streams).transpose(1, 0, 2))
        inside = (inputs != self.end)[:, None, :].astype(state.dtype)  # a document starts from nothing
        befores, states, new = (np.empty((steps, h, streams), dtype=state.dtype) for _ in range(3))
        gates, recs = np.empty((steps, 2 * h, streams), dtype=state.dtype), np.empty((steps, 3 * h, streams), dtype=state.dtype)
        recurrent, state = np.ascontiguousarray(p["rec"].T), state.T
        for t in range(steps):
            before = np.multiply(state, inside[t], out=befores[t])
            state = self.advance(x[t], np.matmul(recurrent, before, out=recs[t]), before, gates[t], new[t], states[t])
        order = np.argsort(targets.ravel().astype(small), kind="stable")
        y = targets.ravel()[order]  # the tokens of a word, and those of a class, are neighbours
        cls, n = self.cls[y], len(y)
        # a column of ones carries the biases, and in the weights the sums of exponentials
        flat = np.ones((n, h + 1), dtype=state.dtype)
        flat[:, :h] = states.transpose(0, 2, 1).reshape(-1, h).take(order, axis=0)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        classes, words, reach = self._joined()
        pulled, class_slope, tops = self._pull(flat, classes, reach)
        logs = tops + np.log(pulled[:, -1])
        back = pulled[:, :-1] / pulled[:, -1:]
        word_slope = np.zeros_like(words)
        summing = words.copy()
        summing[:, -1] = 1
        pulled[:] = 0
        pulled[:, -1] = 1  # the only word of a class: no pull, and the logarithm is 0
        for a, b, i, j in self._classes_of(cls):
            pulled[i:j], word_slope[a:b], top = self._pull(flat[i:j], words[a:b], reach, summing[a:b])
            logs[i:j] += top
        logs += np.log(pulled[:, -1])
        pulled[:, :-1] /= pulled[:, -1:]
        back += pulled[:, :-1]
        # what the right class and word add: their own logits, weights and states
        firsts = np.flatnonzero(np.diff(y, prepend=-1))
        by_target = np.add.reduceat(flat, firsts, axis=0)
        mine = y[firsts]
        starts = np.flatnonzero(np.diff(self.cls[mine], prepend=-1))
        class_slope[self.cls[mine[starts]]] -= np.add.reduceat(by_target, starts, axis=0)
        class_slope /= n
        g["class"], g["class_bias"] = class_slope[:, :h].T, class_slope[:, h]
        by_target *= self.inner[mine][:, None]
        word_slope[mine] -= by_target
        word_slope /= n
        g["word"], g["word_bias"] = word_slope[:, :h], word_slope[:, h]
        right = classes.take(cls, axis=0)
        right += words.take(y, axis=0)
        loss = float(logs.sum() - np.einsum("ij,ij->", flat, right))
        back -= right[:, :h]
        back /= n
        unsorted = np.empty_like(back)
        unsorted[order] = back
        back = np.ascontiguousarray(unsorted.reshape(steps, streams, h).transpose(0, 2, 1))
        # what a step multiplies the error by, for all steps at once
        z, reset = gates[:, :h], gates[:, h:]
        keep = 1 - z
        to_update = (new - befores) * z * keep
        to_new = z * (1 - new * new)
        to_reset = recs[:, 2 * h:] * reset * (1 - reset)
        carry = np.zeros((h, streams), dtype=state.dtype)
        d_inputs, d_rec = (np.empty((steps, 3 * h, streams), dtype=state.dtype) for _ in range(2))
        for t in reversed(range(steps)):
            d = np.add(back[t], carry, out=carry)
            np.multiply(d, to_update[t], out=d_rec[t, :h])
            d_new = np.multiply(d, to_new[t], out=d_inputs[t, 2 * h:])
            np.multiply(d_new, to_reset[t], out=d_rec[t, h:2 * h])
            np.multiply(d_new, reset[t], out=d_rec[t, 2 * h:])
            carry = p["rec"] @ d_rec[t]
            d *= keep[t]
            carry += d
            carry *= inside[t]
        d_inputs[:, :2 * h] = d_rec[:, :2 * h]
        d_inputs, d_rec = (np.ascontiguousarray(d.transpose(1, 0, 2)).reshape(3 * h, -1) for d in (d_inputs, d_rec))
        g["rec"] = np.ascontiguousarray(befores.transpose(1, 0, 2)).reshape(h, -1) @ d_rec.T
        g["gate_bias"] = d_inputs.sum(axis=1)
        g["in"] = (d_inputs @ embed).T
        order = np.argsort(seen.astype(small), kind="stable")
        known = seen[order]
        firsts = np.flatnonzero(np.diff(known, prepend=-1))
        g["embed"][known[firsts]] = np.add.reduceat((d_inputs.T @ p["in"].T).take(order, axis=0), firsts, axis=0)
        return loss / n, g, state.T

    def _pull(self, states, weights, reach, summing=None):
        """For a softmax over ``weights`` (biases last) of ``states`` (ones last): the weights that each state expects
        times the sum of its exponentials, which is the last column, the sum of states by weight, each times its
        probability, and the tops.  Probabilities are never formed: the sums divide the narrow sides.
        ``summing``: the weights with ones last."""
        exps, top = self._exponentials(states, weights, reach)
        if summing is None:
            summing = weights.copy()
            summing[:, -1] = 1
        pull = exps @ summing
        return pull, exps.T @ (states / pull[:, -1:]), top

    def fit(self, tokens, rate: float = 0.01, window: int = WINDOW, streams: int = STREAMS) -> None:
        """One pass over ``tokens`` (documents, each closed by an end), cut into streams side by side.
        A further call goes on where the last one ended."""
        import numpy as np

        x = np.r_[self.end, tokens[:-1]]
        streams = max(1, min(streams, len(tokens) // (100 * window)))  # at least a hundred updates
        length = -(-len(tokens) // streams)  # the last stream is filled up from the start
        x, y = (np.resize(a, streams * length).reshape(streams, length).T for a in (x, tokens))
        state = np.zeros((streams, self.hidden), dtype=np.float32)
        if not self.moments:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for t in range(0, length, window):
            _, g, state = self.gradients(x[t:t + window], y[t:t + window], state)
            self.steps += 1
            # Adam; its moments are kept as sums, 10 and 1000 times what they are
            root = math.sqrt(0.001 / (1 - 0.999 ** self.steps))
            size = rate * 0.1 / (1 - 0.9 ** self.steps) / root
            for k, v in g.items():
                first, second = self.moments[k]
                first *= 0.9
                first += v
                second *= 0.999
                v *= v
                second += v
                np.sqrt(second, out=v)
                v += 1e-8 / root
                np.divide(first, v, out=v)
                v *= size
                self.p[k] -= v

    def document_log_probs(self, documents, window: int = 64, chunk: int = 16_384):
        """Natural log-probability of each document (ids without its end), ends included."""
        import numpy as np

        table, joined = self.tables(), self._joined()
        total = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        lengths = np.array([len(documents[i]) + 1 for i in order])
        state = np.zeros((len(order), self.hidden), dtype=np.float32)
        ids = [np.r_[self.end, documents[i], self.end] for i in order]
        states, targets, owners, held = [], [], [], 0

        def flush():
            nonlocal states, targets, owners, held
            if held:
                found = self.log_probs(np.concatenate(states), np.concatenate(targets), joined)
                total[:] += np.bincount(np.concatenate(owners), weights=found, minlength=len(total))
            states, targets, owners, held = [], [], [], 0

        for start in range(0, int(lengths[0]) if len(order) else 0, window):
            live = int(np.searchsorted(-lengths, -start, side="left"))  # documents longer than start
            block = np.full((live, window + 1), self.end, dtype=np.int64)
            for k in range(live):
                part = ids[k][start:start + window + 1]
                block[k, :len(part)] = part
            block = np.ascontiguousarray(block.T)
            for t in range(min(window, int(lengths[0]) - start)):
                live = int(np.searchsorted(-lengths, -(start + t), side="left"))
                new = self.step(table[block[t, :live]], state[:live])[-1]
                state[:live] = new
                states.append(new)
                targets.append(block[t + 1, :live])
                owners.append(np.arange(live))
                held += live
                if held >= chunk:
                    flush()
        flush()
        out = np.empty(len(documents))
        out[order] = total
        return out


class Corpus:
    """What the workers need of the corpus: bounded by HEAD and VOCAB."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, words: int, ends: int, vocab: int):
        self.words = [w for w, _ in head]
        self.counts = [c for _, c in head]
        self.vocab = min(vocab, len(head))
        self.n, self.ends = n, ends
        self.types = words + (ends > 0)
        inside = sum(self.counts[:self.vocab])
        #: smoothed count of all words outside the vocabulary, one more for those never seen
        self.outside = (n - ends - inside) + (words - self.vocab) + 1

    def model(self) -> Gru:
        return Gru(self.counts[:self.vocab], self.n - self.ends - sum(self.counts[:self.vocab]), self.ends)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and count over the documents that may be learned from."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            found = pc.value_counts(words_of(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "count"])

    texts = docs.where(_learned()).select(text_or_empty("text").alias("text"))
    return texts.mapInArrow(count, "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def _learned() -> Column:
    return F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))


def learn_corpus(docs: DataFrame, counts: DataFrame, head: int = HEAD, vocab: int = VOCAB) -> Corpus:
    total = counts.agg(F.sum("count"), F.count("*")).first()
    top = counts.orderBy(F.desc("count"), "word").limit(head).toArrow()
    words = [w.encode() for w in top.column("word").to_pylist()]
    ends = docs.where(_learned()).count()
    return Corpus(list(zip(words, top.column("count").to_pylist())), (total[0] or 0) + ends, total[1], ends, vocab)


def blocks(documents, size: int = BLOCK):
    """The documents' tokens in order, whole documents joined to ``size`` tokens or more each."""
    import numpy as np

    done, held = None, []  # a block waits for the next to fill, so that a short rest joins it
    length = 0
    for tokens in documents:
        held.append(tokens)
        length += len(tokens)
        if length >= size:
            if done is not None:
                yield done
            done, held, length = np.concatenate(held), [], 0
    if done is not None or held:
        yield np.concatenate([*([] if done is None else [done]), *held])


def id_type(vocab: int) -> str:
    return "<i2" if vocab + 2 < 32_768 else "<i4"


def encoded(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Every row's words once, frozen: row (doc_id, version), place (its hash), learned, ids (of the model, its end
    left out), once (n_words, head_words, head_log, extra: log10 shares of the words outside the vocabulary, rare ones'
    counts left out) and rare (words outside the head)."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty("text")
    # a row is known by its doc_id and text
    row = F.struct("doc_id", F.xxhash64(text).alias("version"))
    rows = docs.select(row.alias("row"), F.xxhash64("doc_id", text).alias("place"), _learned().alias("learned"), text.alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, head = corpus, pa.array(corpus.words, pa.binary()).cast(pa.string())
        logs = np.log10(np.r_[known.counts, 0] + 1.0)  # the last: not in the head
        outside, kind = math.log10(known.outside), np.dtype(id_type(known.vocab))
        for batch in batches:
            n = batch.num_rows
            words, owners = words_of(batch.column(3))
            places = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy()
            missing = places < 0
            other = missing | (places >= known.vocab)
            ids = np.where(other, known.vocab, places).astype(kind)
            n_words, n_missing = np.bincount(owners, minlength=n), np.bincount(owners[missing], minlength=n)
            ends, rare_ends = (np.r_[0, np.cumsum(x)].astype(np.int32) for x in (n_words, n_missing))
            once = pa.StructArray.from_arrays([
                pa.array(n_words, pa.int64()), pa.array(n_words - n_missing, pa.int64()),
                *(pa.array(np.bincount(owners[x], logs[places[x]] - less, n).astype(np.float64))  # whole numbers without any word
                  for x, less in ((~missing, 0), (other, outside)))],
                names=["n_words", "head_words", "head_log", "extra"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends * np.int32(kind.itemsize)), pa.py_buffer(ids)]), once,
                 pa.ListArray.from_arrays(pa.array(rare_ends), words.filter(pa.array(missing)))],
                names=["row", "place", "learned", "ids", "once", "rare"])

    return frozen(rows.mapInArrow(run, (
        f"row {rows.schema['row'].dataType.simpleString()}, place bigint, learned boolean, ids binary, "
        "once struct<n_words: bigint, head_words: bigint, head_log: double, extra: double>, rare array<string>")))


def train(docs: DataFrame, corpus: Corpus, every: int = EVERY, rounds: int = ROUNDS, copy_tokens: int = COPY_TOKENS) -> Gru:
    """The model after the last round; each round's copies are averaged, weighted by the tokens each has seen."""
    return train_encoded(encoded(docs, corpus), corpus, every, rounds, copy_tokens)


def train_encoded(rows: DataFrame, corpus: Corpus, every: int = EVERY, rounds: int = ROUNDS, copy_tokens: int = COPY_TOKENS) -> Gru:
    """``train`` on ``encoded`` documents."""
    share = rows.where("learned")
    if every > 1:
        share = share.where(F.pmod(F.xxhash64("row.doc_id"), F.lit(every)) == 0)
    bounded_batches(rows.sparkSession)
    copies = max(1, math.ceil(corpus.n / every / rounds / copy_tokens))
    dealt = share.select("ids", "place", F.pmod("place", F.lit(copies)).cast("int").alias("copy"))
    model, blank, kind = corpus.model(), corpus.model(), id_type(corpus.vocab)
    for r in range(rounds):
        mine = dealt.where(F.pmod(F.shiftrightunsigned("place", 40), F.lit(rounds)) == r)
        start = model.flat()

        def fit(batches, start=start):
            from copy import deepcopy
            from itertools import groupby

            import numpy as np
            import pyarrow as pa

            rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for _, own in groupby(rows, key=lambda row: row[0]):  # a task may hold more than one copy's documents
                copy, seen = deepcopy(blank), 0
                copy.load(start)
                ids = (np.append(np.frombuffer(ids, kind), copy.end).astype(np.int32) for _, ids in own)
                for tokens in blocks(ids):
                    copy.fit(tokens)
                    seen += len(tokens)
                flat = copy.flat()
                cuts = np.r_[np.arange(0, len(flat), PART), len(flat)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts) - 1), pa.int32()), pa.array([seen] * (len(cuts) - 1), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["part", "weight", "value"])

        def add(batches):
            import numpy as np
            import pyarrow as pa

            sums = {}  # of the parts dealt to this task: the model's size at most, however many copies there are
            for batch in batches:
                for i, (part, weight) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    value = batch.column(2)[i].values.to_numpy().astype(np.float64) * weight
                    before = sums.get(part, (0, 0.0))
                    sums[part] = (before[0] + weight, before[1] + value)
            for part, (weight, value) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([value / weight], pa.list_(pa.float64()))],
                                                 names=["part", "value"])

        found = (mine.repartitionById(copies, F.col("copy")).sortWithinPartitions("copy", "place", "ids")
                 .select("copy", "ids").mapInArrow(fit, "part int, weight bigint, value array<float>"))
        mean = found.repartition("part").mapInArrow(add, "part int, value array<double>")
        averaged = [value for row in sorted(mean.collect()) for value in row["value"]]
        if averaged:
            model.load(averaged)
    return model


def _scored(rows: DataFrame, corpus: Corpus, model: Gru) -> DataFrame:
    """Per row: row, once, score_log (log10, of all but rare words' shares), rare (words)."""
    bounded_batches(rows.sparkSession)
    kind = id_type(corpus.vocab)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def score(held):
            found = model.document_log_probs([ids for _, documents in held for ids in documents]) / math.log(10)
            at = 0
            for batch, documents in held:
                part = found[at:at + len(documents)] + batch.column(1).field(3).to_numpy()
                at += len(documents)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part), batch.column(3)],
                                                 names=["row", "once", "score_log", "rare"])

        held, tokens, n = [], 0, 0
        for batch in batches:
            documents = [np.frombuffer(ids, kind) for ids in batch.column(2).to_pylist()]
            held.append((batch, documents))
            tokens += sum(map(len, documents))
            n += len(documents)
            if tokens >= SCORED_TOKENS or n >= SCORED_ROWS:
                yield from score(held)
                held, tokens, n = [], 0, 0
        if held:
            yield from score(held)

    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("row", "once")}
    return rows.select("row", "once", "ids", "rare").mapInArrow(
        run, f"row {kinds['row']}, once {kinds['once']}, score_log double, rare array<string>")


def lm_scores(docs: DataFrame, head: int = HEAD, vocab: int = VOCAB, every: int = EVERY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    counts = frozen(word_counts(docs))
    corpus = learn_corpus(docs, counts, head, vocab)
    # equal rows stand together and are told apart by their number
    words = encoded(docs, corpus)
    scored = _scored(words, corpus, train_encoded(words, corpus, every))
    # one row per rare word; what a document has once rides on its first row, under
    # a key that is no word if it has no rare one, so that no key is common to many
    own = F.concat(F.lit(" "), F.col("row.version").cast("string"))
    rows = scored.select(
        "row", F.struct("once.n_words", "once.head_words", "once.head_log", "score_log").alias("once"),
        F.posexplode(F.when(F.size("rare") > 0, F.col("rare")).otherwise(F.array(own))).alias("at", "word"))
    rows = rows.select("row", "word", F.when(F.col("at") == 0, F.col("once")).alias("once"))
    known = rows.join(counts, "word", "left")
    summed = known.groupBy("row").agg(
        F.collect_list("once").alias("rows"), F.count("count").alias("rare_known"),
        F.sum(F.log10(F.coalesce("count", F.lit(0)) + 1)).alias("rare_log"))
    per_row = summed.withColumn("copies", F.size("rows")).select(
        "row.doc_id", (F.col("rare_known") / F.col("copies")).cast("bigint").alias("rare_known"),
        (F.col("rare_log") / F.col("copies")).alias("rare_log"), F.explode("rows").alias("r"))
    types, end = F.lit(float(corpus.n + corpus.types + 1)), F.lit(math.log10(corpus.ends + 1))
    tokens = F.col("r.n_words") + 1
    return per_row.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("r.head_words") + F.col("rare_known") + F.lit(int(corpus.ends > 0))).alias("n_known"),
        F.lit(corpus.n).cast("bigint").alias("train_tokens"),
        (F.col("r.head_log") + F.col("rare_log") + end - tokens * F.log10(types)).alias("base_score"),
        (F.col("r.score_log") + F.col("rare_log")).alias("score"))
