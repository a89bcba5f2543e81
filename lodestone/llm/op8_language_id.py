"""Language ID with a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads a text's UTF-8 bytes in both directions, blanks included, so its state goes on from word to word. It
gives every byte position a distribution over the languages; a document's distribution is the normalised geometric
mean over all positions of its whole text. Texts are read in windows: a window labels its own CORE bytes and reads
CONTEXT more on either side first, so that both states are warm where it begins to label.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, forget, small_batches

UNDECIDED = "und"
CORE, CONTEXT = 960, 32
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def windows(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, first labelled position, labelled positions): every byte of raw is labelled by one window."""
    for a in range(0, len(raw), CORE):
        start = max(0, a - CONTEXT)
        yield raw[start : a + CORE + CONTEXT], a - start, min(CORE, len(raw) - a)


class ByteGru:
    """Parameters and both passes. Gates in the order update, reset, candidate."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 0):
        rng, h = np.random.default_rng(seed), hidden
        self.langs, self.hidden = langs, h
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * h, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.6 / np.sqrt(h), (h, 3 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, x: np.ndarray, d: str, keep: bool = False):
        """States at each step for x (n, L), read forwards or backwards."""
        n, length, h = len(x), x.shape[1], self.hidden
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        s, states, tape = np.zeros((n, h), np.float32), [None] * length, []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, u = wx[x[:, t]], s @ wh
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            if keep:
                tape.append((t, s, z, r, c, u[:, 2 * h :]))
            s = c + z * (s - c)
            states[t] = s
        return np.stack(states, 1), tape

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (n, L, languages) of every position of texts of one length."""
        both = np.concatenate([self._direction(x, "f")[0], self._direction(x, "b")[0]], 2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        n, length, h = len(x), x.shape[1], self.hidden
        (sf, tf), (sb, tb) = self._direction(x, "f", True), self._direction(x, "b", True)
        both = np.concatenate([sf, sb], 2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        loss = -np.log(prob[np.arange(n), :, y] + 1e-9).mean()
        prob[np.arange(n), :, y] -= 1
        prob /= n * length
        g = {"out": np.tensordot(both, prob, ([0, 1], [0, 1])), "bias": prob.sum((0, 1))}
        back = prob @ self.p["out"].T
        for d, tape, part in (("f", tf, back[:, :, :h]), ("b", tb, back[:, :, h:])):
            wh = self.p[f"h{d}"]
            gx, gh, ds, inputs, order = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros((n, h), np.float32), [], []
            for t, s, z, r, c, uc in reversed(tape):
                ds = ds + part[:, t]
                dz, dc = ds * (s - c) * z * (1 - z), ds * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                inputs.append(da)
                order.append(x[:, t])
                gh += s.T @ du
                ds = ds * z + du @ wh.T
            seen = np.concatenate(order)
            place = np.argsort(seen, kind="stable")
            first = np.flatnonzero(np.diff(seen[place].astype(np.int64), prepend=-1))
            gx[seen[place][first]] = np.add.reduceat(np.concatenate(inputs)[place], first)
            g[f"x{d}"], g[f"h{d}"] = gx, gh
        return g, float(loss)

    def fit(self, spans: list[bytes], labels: list[int], steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 1) -> ByteGru:
        """Adam over batches of spans of one length; lengths are drawn by how many spans have them."""
        rng = np.random.default_rng(seed)
        by: dict[int, list[tuple[bytes, int]]] = {}
        for s, y in zip(spans, labels):
            by.setdefault(len(s), []).append((s, y))
        sets = {k: (np.frombuffer(b"".join(s for s, _ in v), np.uint8).reshape(-1, k), np.array([y for _, y in v])) for k, v in sorted(by.items())}
        lengths, weight = list(sets), np.array([len(v[1]) for v in sets.values()], float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            x, y = sets[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
            pick = rng.integers(0, len(x), min(batch, len(x)))
            g, _ = self.gradients(x[pick], y[pick])
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                q[k] = 0.99 * q[k] + 0.01 * v * v
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def _scores(self, x: np.ndarray, d: str) -> np.ndarray:
        """This direction's part of the logits, (L, languages, n), for x (L, n) in reading order."""
        length, n, h = *x.shape, self.hidden
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        wx, wh = self.p[f"x{d}"] * half.T, np.ascontiguousarray(self.p[f"h{d}"].T) * half
        own = np.ascontiguousarray((self.p["out"][:h] if d == "f" else self.p["out"][h:]).T)
        s, out = np.zeros((h, n), np.float32), np.empty((length, len(self.langs), n), np.float32)
        for t in range(length):
            a, u = np.ascontiguousarray(wx.take(x[t], 0).T), wh @ s  # features lie in rows
            g = a[: 2 * h]
            g += u[: 2 * h]
            np.tanh(g, g)
            g *= 0.5
            g += 0.5
            c = u[2 * h :]
            c *= g[h:]
            c += a[2 * h :]
            np.tanh(c, c)
            s -= c
            s *= g[:h]
            s += c
            np.matmul(own, s, out[t])
        return out

    def window_sums(self, some: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Per window: the sum of the log probabilities of the positions it labels."""
        n, k = len(some), len(self.langs)
        size = np.array([len(raw) for raw, _, _ in some])
        length = int(size.max())
        ahead, back = np.zeros((length, n), np.uint8), np.zeros((length, n), np.uint8)
        for i, (raw, _, _) in enumerate(some):
            x = np.frombuffer(raw, np.uint8)
            ahead[: len(x), i], back[: len(x), i] = x, x[::-1]
        t = np.arange(length)[:, None]
        logits = self._scores(back, "b")
        logits = np.take_along_axis(logits, np.maximum(size[None, :] - 1 - t, 0)[:, None, :], 0)
        logits += self._scores(ahead, "f")
        logits += self.p["bias"][:, None]
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        first, many = np.array([a for _, a, _ in some]), np.array([m for _, _, m in some])
        logits *= ((t >= first) & (t < first + many))[:, None, :]
        return logits.sum(0, dtype=np.float64).T.reshape(n, k)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        owner: list[int] = []
        all_windows: list[tuple[bytes, int, int]] = []
        for i, t in enumerate(texts):
            if t and LETTER.search(t):
                mine = list(windows(t.encode("utf-8", "surrogatepass")))
                owner += [i] * len(mine)
                all_windows += mine
        total, many = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        step = max(16, 2_000_000 // ((CORE + 2 * CONTEXT) * max(4, len(self.langs))))
        order = sorted(range(len(owner)), key=lambda j: len(all_windows[j][0]))  # little padding
        for a in range(0, len(order), step):
            at = order[a : a + step]
            np.add.at(total, [owner[j] for j in at], self.window_sums([all_windows[j] for j in at]))
            np.add.at(many, [owner[j] for j in at], [all_windows[j][2] for j in at])
        for i in np.flatnonzero(many).tolist():
            mean = total[i] / many[i]
            prob = np.exp(mean - mean.max())
            prob /= prob.sum()
            k = int(prob.argmax())
            langs[i], scores[i] = self.langs[k], float(prob[k])
        return langs, scores


def training_spans(df: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: int, docs_a_lang: int, spans_a_doc: int, span: int, languages: int) -> list:
    """(lang, spans): a bounded sample of labelled rows outside the held-out fold.

    Of each of the `languages` most frequent languages at most `docs_a_lang` documents, those with the least hash of id
    and text (equal rows count once); of each, `spans_a_doc` spans of `span` bytes at even distances over the whole text,
    its end included. Every such row can be drawn; the choice is the same in each run. A language's share of hashes is
    taken from its row count first, so no task ranks more than a few times docs_a_lang rows.
    """
    rows = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull() & (fold(df[id_col], held_out) != 0))
    rows = rows.select(df[lang_col].cast("string").alias("lang"), F.xxhash64(df[id_col], df[text_col]).alias("h"), df[text_col].alias("text"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, (2 * docs_a_lang + 50) / r["count"]))])[F.col("lang")]
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                free = max(0, len(raw) - span)
                out.append([raw[a : a + span] for a in sorted({i * free // max(1, spans_a_doc - 1) for i in range(spans_a_doc)})] if raw else [])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "spans"])

    sample = drawn.mapInArrow(draw, "lang string, h long, spans array<binary>").dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return sample.withColumn("k", rank).where(F.col("k") <= docs_a_lang).select("lang", "spans").collect()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 5, docs_a_lang: int = 300, spans_a_doc: int = 24, span: int = 32, languages: int = 200, hidden: int = 8, steps: int = 500) -> ByteGru | None:
    """The network, or None where nothing is labelled. Languages weigh the same however many rows they have."""
    small_batches(df.sparkSession)
    sample = training_spans(df, id_col, text_col, lang_col, held_out, docs_a_lang, spans_a_doc, span, languages)
    langs = sorted({r.lang for r in sample})
    pairs = sorted((r.lang, bytes(s)) for r in sample for s in r.spans)
    if not pairs:
        return None
    most = max(sum(1 for x, _ in pairs if x == lang) for lang in langs)
    spans, labels = [], []
    for k, lang in enumerate(langs):
        own = [s for x, s in pairs if x == lang]
        own = (own * (1 + most // max(1, len(own))))[:most] if own else []
        spans += own
        labels += [k] * len(own)
    return ByteGru(langs, hidden).fit(spans, labels, steps)


def identify(df: DataFrame, net: ByteGru | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns with lang_pred and score. Null texts and texts without a letter are `und` with score 0.

    Only text_col is read for a prediction. Rows of any length are read whole; repeated rows get equal results; columns
    of df called lang_pred or score are replaced.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    own = text_col not in keep  # a text that is kept goes to Python once
    src = df.select(*keep, df[text_col].alias("text__")) if own else df.select(*keep)
    at = len(keep) if own else keep.index(text_col)
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    raw = pickle.dumps(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own_net = pickle.loads(raw)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                texts = b.column(at).to_pylist()
                langs, scores = own_net.predict(texts) if own_net is not None else ([UNDECIDED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return src.mapInArrow(each, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs)
    return identify(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), net, keep=["doc_id", "held_out"])
