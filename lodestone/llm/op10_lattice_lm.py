"""Language-model scoring by the marginal likelihood of subword lattices.

The pieces of an existing tokenizer vocabulary are the symbols of a unigram model. That vocabulary's own scores are the
ranks of its merges and no log probabilities, so they cannot weigh segmentations; the weights are estimated instead.
They start from the library's cuts of the training words, each distinct word counted as often as it stands in the
training texts, and are re-estimated by expectation: every segmentation of a word counts by its posterior probability
(forward-backward over the lattice). A text's probability sums over every way to cut its words into pieces; the forward
recursion does that in log space, one character at a time, for many words at once. No piece goes over a word's start,
so a document's likelihood is the product of its words' marginals and of the end symbol.

Documents are dealt into blocks of bounded bytes. A block's distinct words go, packed by hash, to word buckets together
with their counts (only to buckets that it has words for). A bucket adds up the counts of its words over all blocks,
scores each word once and answers each block with the count and marginal of that block's words. A block then streams
its documents past the answers. What moves besides the texts is the vocabulary of each block, not one row per token.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, forget, settle, small_batches, spread

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MARK = "▁"
LN10 = math.log(10.0)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class Pieces:
    """The vocabulary of a byte-fallback sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.sp.get_piece_size()
        self.names = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = []
        for i in range(n):
            if self.sp.is_byte(i):
                self.byte_ids[int(self.names[i][3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i)):
                normal.append(i)
        self.size, self.end = n, n  # the end symbol comes after the pieces
        self.longest = max(len(self.names[i]) for i in normal)
        hashes = np.array([self._hash(np.array([[ord(c) for c in self.names[i]]], np.uint64))[0] for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(normal, np.int64)[order]
        assert len(np.unique(self.hashes)) == len(self.hashes)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.full(len(codes), 1469598103934665603, np.uint64)
        for j in range(codes.shape[1]):
            h = (h ^ (codes[:, j] + np.uint64(0x9E3779B9))) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        return h

    def counts(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Weighted counts of the pieces that the library cuts the words into."""
        out = np.zeros(self.size + 1)
        for a in range(0, len(words), 8192):
            ids = self.sp.encode(words[a : a + 8192], num_threads=1)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            out += np.bincount(flat, np.repeat(weights[a : a + 8192], n), self.size + 1)
        return out

    def _edges(self, codes: np.ndarray, log_p: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int, np.ndarray]]]:
        """edges[k][:, i]: log probability of the piece of k + 1 characters from i, its id, and (row, place, byte ids) of characters without a piece."""
        n, length = codes.shape
        edges, names, raw_chars = [], [], []
        h = np.full((n, length), 1469598103934665603, np.uint64)
        for k in range(min(self.longest, length)):  # hashes grow one character at a time
            h = h[:, : length - k]
            h = (h ^ (codes[:, k:] + np.uint64(0x9E3779B9))) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
            pos = np.minimum(np.searchsorted(self.hashes, h.ravel()), len(self.hashes) - 1)
            hit = self.hashes[pos] == h.ravel()
            ids = np.where(hit, self.hash_ids[pos], -1).reshape(h.shape)
            e = np.where(ids >= 0, log_p[ids], -np.inf)
            if k == 0:  # a character without a piece falls back to its bytes
                for r, c in zip(*np.nonzero(ids < 0)):
                    own = self.byte_ids[np.frombuffer(chr(int(codes[r, c])).encode("utf-8", "surrogatepass"), np.uint8)]
                    e[r, c] = log_p[own].sum()
                    raw_chars.append((int(r), int(c), own))
            edges.append(e)
            names.append(ids)
        return edges, names, raw_chars

    @staticmethod
    def _sweep(edges: list[np.ndarray]) -> np.ndarray:
        """Log of the summed probability of all ways to each position, (length + 1, n)."""
        n, length = edges[0].shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for i in range(1, length + 1):
            ways = np.array([alpha[i - k - 1] + edges[k][:, i - k - 1] for k in range(min(len(edges), i))])
            top = ways.max(0)
            alpha[i] = top + np.log(np.exp(ways - top).sum(0))
        return alpha

    def _batches(self, words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of some words of one length, their characters with the mark)."""
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            step = max(1, min(4096, cells // (length + 1)))
            for a in range(0, len(at), step):
                some = at[a : a + step]
                codes = np.frombuffer("".join([MARK + words[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), length + 1)
                yield some, codes.astype(np.uint64)

    def marginals(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each marked word (log-space forward recursion)."""
        out = np.zeros(len(words))
        for some, codes in self._batches(words, 400_000):
            out[some] = self._sweep(self._edges(codes, log_p)[0])[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Weighted counts of the pieces over all segmentations, each by its posterior probability (forward-backward)."""
        out = np.zeros(self.size + 1)
        for some, codes in self._batches(words, 100_000):
            edges, names, raw_chars = self._edges(codes, log_p)
            length = codes.shape[1]
            alpha = self._sweep(edges)
            beta = self._sweep([e[:, ::-1] for e in edges])[::-1]  # the same lattice read from its end
            total, weight = alpha[-1], weights[some]
            for k, (e, ids) in enumerate(zip(edges, names)):
                share = np.exp(alpha[: length - k].T + e + beta[k + 1 :].T - total[:, None]) * weight[:, None]
                known = ids >= 0
                out += np.bincount(ids[known], share[known], self.size + 1)
                if k == 0:
                    for r, c, own in raw_chars:
                        np.add.at(out, own, share[r, c])
        return out


@functools.lru_cache(maxsize=1)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def score_texts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", held_out: int = 7, remainder: int = 2, rounds: int = 1, block_bytes: int = 24_000_000, bucket_rows: int = 60) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows with crc32(id as text) mod held_out != remainder (a null id is the empty text, so it trains);
    counts and vocabulary cover all of them. A null or empty text is its end token alone. Repeated rows each count and
    are each scored. Without training rows every count is 0. Other columns are not read.

    score is the model's log10 probability of the words and the end, after `rounds` rounds of re-estimation; unseen
    pieces and bytes have add-one counts.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), (fold(df[id_col], held_out) == remainder).alias("held"))
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = spread(spark, size, block_bytes)
    buckets = spread(spark, blocks, bucket_rows)
    # A block is a pure function of the row, so both reads deal the same; one hot id or text alone spreads by the other.
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: dict[int, dict[bytes, int]] = {}
        train: dict[int, list[int]] = {}
        for b in batches:
            for t, held, block in zip(b.column("text"), b.column("held").to_pylist(), b.column("block").to_pylist()):
                own, told = seen.setdefault(block, {}), train.setdefault(block, [0, 0])
                words = words_of(t.as_py())
                if held:
                    for w in words:
                        own.setdefault(w, 0)
                else:
                    told[0] += len(words) + 1
                    told[1] += 1
                    for w in words:
                        own[w] = own.get(w, 0) + 1
        for block, own in seen.items():
            parts: dict[int, tuple[list, list]] = {}
            for w, c in own.items():
                ws, cs = parts.setdefault(zlib.crc32(w) % buckets, ([], []))
                ws.append(w)
                cs.append(c)
            told = train[block]
            for bucket, (ws, cs) in (parts or {0: ([], [])}).items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([b" ".join(ws)], pa.binary()), pa.array([np.array(cs, "<u4").tobytes()], pa.binary()), pa.array(told[:1], pa.int64()), pa.array(told[1:], pa.int64())], names=["block", "bucket", "words", "counts", "train", "docs"])
                told = [0, 0]

    asked = docs.select("block", "text", "held").repartitionById(blocks, F.col("block")).mapInArrow(vocabulary, "block int, bucket int, words binary, counts binary, train long, docs long")
    asked = settle(asked, "lm-words")
    n_train, n_docs = asked.agg(F.sum("train"), F.sum("docs")).first()
    n_train, n_docs = n_train or 0, n_docs or 0
    dealt = asked.where("octet_length(words) > 0").select("bucket", "block", "words", "counts").repartitionById(buckets, F.col("bucket"))
    width = pieces(model_file).size + 1

    def merged(batches: Iterator[pa.RecordBatch]) -> tuple[dict[bytes, int], np.ndarray, list[tuple[int, bytes, list[int]]]]:
        """The words of a partition's buckets, their counts, and each block's words. A bucket is in one partition, and words in one bucket."""
        index: dict[bytes, int] = {}
        asks, totals = [], []
        for b in batches:
            for block, ws, cs in zip(b.column("block").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist()):
                asks.append((block, ws, [index.setdefault(w, len(index)) for w in ws.split(b" ")]))
                totals.append(np.frombuffer(cs, "<u4"))
        total = np.zeros(len(index), np.int64)
        for (_, _, at), c in zip(asks, totals):
            np.add.at(total, at, c)
        return index, total, asks

    def learned(log_p: np.ndarray | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, total, _ = merged(batches)
            names, known = list(index), np.flatnonzero(total > 0)
            words, own = [names[i].decode("utf-8", "surrogatepass") for i in known], pieces(model_file)
            counted = own.counts(words, total[known]) if log_p is None else own.expected(words, total[known], log_p)
            some = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array([len(known)], pa.int64()), pa.array([some.astype("<u4").tobytes()], pa.binary()), pa.array([counted[some].astype("<f8").tobytes()], pa.binary())], names=["v", "ids", "counts"])

        return each

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, v = np.zeros(width), 0
        for b in batches:
            v += sum(b.column("v").to_pylist())
            for i, c in zip(b.column("ids"), b.column("counts")):
                total[np.frombuffer(i.as_py(), "<u4")] += np.frombuffer(c.as_py(), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["v", "pieces"])

    log_p, distinct = None, 0
    for _ in range(1 + rounds):
        # Added up on the executors; the driver gets 12 vectors of vocabulary size, whatever the corpus.
        stats = dealt.mapInArrow(learned(log_p), "v long, ids binary, counts binary")
        sums = stats.repartition(12).mapInArrow(add, "v long, pieces binary").collect()
        distinct = sum(r.v for r in sums) + (1 if n_docs else 0)
        counts = sum((np.frombuffer(bytes(r.pieces), "<f8") for r in sums), np.zeros(width))
        counts[-1] = n_docs
        log_p = np.log((counts + 1.0) / (counts.sum() + width))
    base_total, end_base, end_score = math.log10(n_train + distinct + 1), math.log10(n_docs + 1), log_p[-1] / LN10

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, asks = merged(batches)
        log10 = pieces(model_file).marginals([w.decode("utf-8", "surrogatepass") for w in index], log_p) / LN10
        for block, ws, at in asks:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ws], pa.binary()), pa.array([total[at].astype("<u8").tobytes()], pa.binary()), pa.array([log10[at].astype("<f8").tobytes()], pa.binary())], names=["block", "words", "counts", "scores"])

    told = settle(dealt.mapInArrow(answers, "block int, words binary, counts binary, scores binary"), "lm-answers")
    own_type = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, own_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers come first, then the documents of the same blocks."""
        index: dict[int, dict[bytes, int]] = {}
        cs, ss, n = [np.zeros(0, "<u8")], [np.zeros(0, "<f8")], 0
        count = None
        for b in batches:
            kind = b.column("doc").to_numpy(zero_copy_only=False)
            cut = int((~kind).sum())
            for block, ws, c, s in zip(*[b.column(x).slice(0, cut).to_pylist() for x in ("block", "words", "counts", "scores")]):
                names = ws.split(b" ")
                index.setdefault(block, {}).update(zip(names, range(n, n + len(names))))
                n += len(names)
                cs.append(np.frombuffer(c, "<u8"))
                ss.append(np.frombuffer(s, "<f8"))
            if cut == len(kind):
                continue
            if count is None:
                count, marginal = np.concatenate(cs), np.concatenate(ss)
                base = np.log10(count + 1.0)
            cols: list[list] = [[], [], [], []]
            d = b.slice(cut)
            for t, block in zip(d.column("text"), d.column("block").to_pylist()):
                words = words_of(t.as_py())
                at = np.fromiter(map(index[block].__getitem__, words), np.int64, len(words)) if words else np.zeros(0, np.int64)
                cols[0].append(len(words) + 1)
                cols[1].append(int((count[at] > 0).sum()) + (n_docs > 0))
                cols[2].append(float(base[at].sum()) + end_base - (len(words) + 1) * base_total)
                cols[3].append(float(marginal[at].sum()) + end_score)
            yield pa.RecordBatch.from_arrays([d.column("id"), d.column("held"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([n_train] * len(cols[0]), pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=out.names)

    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = told.select("block", F.lit(False).alias("doc"), nothing("id", own_type), nothing("text", "string"), nothing("held", "boolean"), "words", "counts", "scores")
    right = docs.select("block", F.lit(True).alias("doc"), "id", "text", "held", nothing("words", "binary"), nothing("counts", "binary"), nothing("scores", "binary"))
    return left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("doc").mapInArrow(scored, out)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
