"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a window, each filter's
largest response (of those above zero) is pooled, and a softmax over the
languages follows.  Embeddings, filters and softmax are trained in numpy by
back-propagation on windows of labelled texts: ``SAMPLE_PER_LANG`` documents of
a language, or all it has, and at most ``SAMPLE_ROWS`` of all, the smallest by
hash.  A language of many documents is first thinned by its own share, to about
``CANDIDATES`` for each of its places in the sample.

Prediction covers the whole text: windows of ``WINDOW`` bytes overlap by three
bytes, so each run of four bytes lies in a window.  An embedded byte times a
filter's weights at one offset is a table entry, so the workers look responses
up by byte pairs instead of multiplying.  A text's language has the largest
mean probability over its windows, weighted by their bytes, and that is the score.

``und`` with score 0 if the text is null or has no letter, or if nothing could
be learned.  Rows with null lang, text or doc_id are not learned from.  Rows
that repeat a doc_id under one lang are learned from once.  An empty table gives
an empty result; lang, source and doc_id never reach the
network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, per_document

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
OVERLAP = max(WIDTHS) - 1
SAMPLE_PER_LANG = 1000
SAMPLE_ROWS = 8000
#: documents of a language, by hash, that are ranked for each of its places in the sample
CANDIDATES = 8
WINDOWS_PER_DOC = 4
EPOCHS = 4
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows_of(data: bytes):
    """(windows, WINDOW) bytes, zero-padded, and the number of bytes of each."""
    import numpy as np

    step = WINDOW - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    buffer = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    buffer[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = max(1, len(data) - (n - 1) * step)
    return np.lib.stride_tricks.as_strided(buffer, (n, WINDOW), (step, 1)), sizes


class ByteCnn:
    """Parameters: embedding (256, EMBED), filters per width (width, EMBED, FILTERS), their biases, softmax."""

    def __init__(self, langs: list[str], seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.p["out_bias"] = np.zeros(len(langs))

    def tables(self, width: int):
        """(width, 256, FILTERS): the response of each filter offset to each byte."""
        return self.p["embed"] @ self.p[f"filter{width}"]

    def gradients(self, x, y):
        """Mean cross-entropy of windows x (n, WINDOW) with languages y, and its gradients."""
        import numpy as np

        n, places = len(x), WINDOW - OVERLAP
        pooled, best = [], []
        for w in WIDTHS:
            t = self.tables(w)
            response = self.p[f"bias{w}"] + sum(t[j][x[:, j:j + places]] for j in range(w))  # (n, places, FILTERS)
            at = response.argmax(axis=1)
            best.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :])
        pooled = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = -np.log(prob[np.arange(n), y] + 1e-12).mean()
        prob[np.arange(n), y] -= 1
        prob /= n
        g = {"out": hidden.T @ prob, "out_bias": prob.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (prob @ self.p["out"].T) * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            mine = back[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"bias{w}"] = mine.sum(axis=0)
            by_byte = np.zeros((w, 256, FILTERS))  # only the pooled places pass a gradient on
            for j in range(w):
                np.add.at(by_byte[j], (x[np.arange(n)[:, None], best[i] + j], np.arange(FILTERS)), mine)
            g[f"filter{w}"] = np.einsum("be,wbf->wef", self.p["embed"], by_byte)
            g["embed"] += np.einsum("wbf,wef->be", by_byte, self.p[f"filter{w}"])
        return loss, g

    def fit(self, x, y, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 2) -> None:
        import numpy as np

        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), batch):
                rows = order[start:start + batch]
                _, g = self.gradients(x[rows], y[rows])
                step += 1
                for k, v in g.items():  # Adam
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def pair_tables(self):
        """Responses of all filters to bytes (p, p+1) and to bytes (p+2, p+3): their sum is the convolution at p."""
        import numpy as np

        near, far = [], []
        for w in WIDTHS:
            t = np.zeros((4, 256, FILTERS))
            t[:w] = self.tables(w)
            near.append((t[0][:, None] + t[1][None, :] + self.p[f"bias{w}"]).reshape(65536, FILTERS))
            far.append((t[2][:, None] + t[3][None, :]).reshape(65536, FILTERS))
        return tuple(np.ascontiguousarray(np.concatenate(x, axis=1), dtype=np.float32) for x in (near, far))


def predictor(model: ByteCnn, chunk: int = 32):
    """texts -> (language, score) of each."""
    import numpy as np

    near, far = model.pair_tables()
    out, out_bias = model.p["out"].astype(np.float32), model.p["out_bias"].astype(np.float32)
    places = WINDOW - OVERLAP
    a, b = (np.empty((chunk * places, near.shape[1]), dtype=np.float32) for _ in range(2))

    def probabilities(x):
        pairs = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        hidden = np.empty((len(x), near.shape[1]), dtype=np.float32)
        for i in range(0, len(x), chunk):
            p = pairs[i:i + chunk]
            n = len(p) * places
            np.take(near, p[:, :places].ravel(), axis=0, out=a[:n], mode="clip")
            np.take(far, p[:, 2:2 + places].ravel(), axis=0, out=b[:n], mode="clip")
            np.add(a[:n], b[:n], out=a[:n])
            np.max(a[:n].reshape(len(p), places, -1), axis=1, out=hidden[i:i + chunk])
        logits = np.maximum(hidden, 0) @ out + out_bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def predict(texts: list[str]):
        langs, scores = [], []
        for text in texts:
            x, sizes = windows_of(text.encode("utf-8", "surrogatepass"))
            total = np.zeros(len(model.langs))
            for i in range(0, len(x), 4096):  # a very long text goes in parts
                total += (probabilities(x[i:i + 4096]) * sizes[i:i + 4096, None]).sum(axis=0)
            best = int(total.argmax())
            langs.append(model.langs[best])
            scores.append(min(1.0, float(total[best] / sizes.sum())))
        return [langs, scores]

    return predict


def training_windows(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, rows: int = SAMPLE_ROWS):
    """(windows, language of each): at most ``rows`` documents' windows come to the driver."""
    import numpy as np

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
                     & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = labelled.select("doc_id", "lang")
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # a share of each language's documents by hash, so that its ranking sees a bounded number of rows at any size
    counts = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(CANDIDATES * per_lang)) / F.col("n"))
    ids = ids.join(F.broadcast(counts), "lang").where(order < share * (1 << 40)).select("doc_id", "lang").distinct()
    ranked = ids.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    sample = ranked.where(F.col("place") <= per_lang).orderBy("place", order, "doc_id").limit(rows)
    # rows that repeat an id under one label count once, by their smallest text
    texts = (labelled.join(F.broadcast(sample.select("doc_id", "lang")), ["doc_id", "lang"])
             .groupBy("doc_id", "lang").agg(F.min("text").alias("text")))
    bounded_batches(docs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, _ = windows_of(text.encode("utf-8", "surrogatepass"))
                for i in sorted({(len(x) - 1) * k // (WINDOWS_PER_DOC - 1) for k in range(WINDOWS_PER_DOC)}):  # the last, too
                    langs.append(lang)
                    out.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "bytes"])

    found = texts.select("lang", "text").mapInArrow(cut, "lang string, bytes binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.bytes)))
    x = np.frombuffer(b"".join(bytes(r.bytes) for r in found), dtype=np.uint8).reshape(-1, WINDOW)
    return x, [r.lang for r in found]


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    import numpy as np

    x, langs = training_windows(docs, per_lang, rows)
    if not len(x):
        return None
    names = sorted(set(langs))
    model = ByteCnn(names)
    at = {name: i for i, name in enumerate(names)}
    model.fit(x, np.array([at[lang] for lang in langs]))
    return model


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    text = F.col("text").cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    keyed = docs.select(F.struct("doc_id", known.alias("known")).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    if model is None:
        predicted = keyed.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        predicted = per_document(keyed, lambda: predictor(model), [("lang_pred", "string"), ("score", "double")])
    return predicted.select(
        "doc_id.doc_id", held_out(F.col("doc_id.doc_id")).alias("held_out"),
        F.when(F.col("doc_id.known"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("doc_id.known"), F.col("score")).otherwise(0.0).alias("score"))


def keep_identified(docs: DataFrame, model: ByteCnn | None, min_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a language of at least ``min_score``."""
    if model is None:
        return docs.limit(0)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        predict = predictor(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            _, scores = predict(texts)
            yield batch.filter(pa.array([s >= min_score and any(map(str.isalpha, t)) for s, t in zip(scores, texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
