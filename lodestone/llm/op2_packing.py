"""Best-fit packing with certified bin counts.

Documents become runs of token ids; what is longer than a sequence is cut into full pieces and a rest. Pieces are
dealt over partitions of bounded size and packed best-fit decreasing in each. Dual feasible functions give a lower
bound on the bins that any packing needs; their sums add up over partitions, so the whole table is certified too.
While the packing is above the bound, partitions that have open bins give up the documents of those bins; they are
pooled over fewer partitions and packed again.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, settle, small_batches, spread

CAPACITY = 2048
#: Thresholds of the dual feasible functions: u_k rounds sizes to multiples of capacity/k; f_t drops sizes below t.
ROUNDINGS = tuple(range(2, 21))
CUTS = (1, 16, 32, 64, 128, 200, 256, 300, 341, 400, 450, 512, 600, 683, 750, 800, 900, 1000, 1024)


def dual_feasible_sums(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sums of dual feasible functions over integer sizes in 1..capacity, each scaled so that a bin holds at most 1.0.

    First the identity, then Fekete and Schepers' u_k, then Martello and Toth's cut functions.
    """
    x = sizes.astype(np.int64)
    sums = [x.sum() / capacity]
    for k in ROUNDINGS:
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        sums.append(np.where(whole, x / capacity, (scaled // capacity) / k).sum())
    for t in CUTS:
        sums.append(np.where(x > capacity - t, 1.0, np.where(x >= t, x / capacity, 0.0)).sum() if 2 * t <= capacity else 0.0)
    return np.array(sums)


def certified(sums: np.ndarray) -> int:
    return int(np.ceil(np.max(sums) - 1e-6)) if len(sums) else 0


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each size, and each bin's free space. Open bins are kept by free space; a bit mask finds the tightest."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            space = s + ((fits & -fits).bit_length() - 1)
            b = at[space].pop()
            if not at[space]:
                mask ^= 1 << space
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        free[b] = left = space - s
        if left:
            at[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(free, np.int64)


PACKED = "uid long, size long, bin long, offset long, free long, bound array<double>"


def _pack_group(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        uid, size = t["uid"].to_numpy(), t["size"].to_numpy()
        order = np.argsort(uid)  # the same packing whatever order the rows come in
        uid, size = uid[order], size[order]
        bins, offsets, free = best_fit_decreasing(size, capacity)
        group = int(t["part"][0].as_py())
        sums = dual_feasible_sums(size, capacity)
        bound = pa.array([sums.tolist()] + [None] * (len(uid) - 1), pa.list_(pa.float64()))
        return pa.table({"uid": pa.array(uid), "size": pa.array(size), "bin": pa.array((group << 32) + bins), "offset": pa.array(offsets), "free": pa.array(free[bins]), "bound": bound})

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000, rounds: int = 4) -> DataFrame:
    """items (uid: distinct long, size: 1..capacity) -> uid, sequence_id, offset.

    Sequence ids are any distinct numbers. Items as large as a sequence get one each without being compared.
    """
    spark = items.sparkSession
    done: DataFrame = items.where(F.col("size") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = items.where(F.col("size") < capacity).select("uid", "size")
    count = todo.count()
    bound, closed_bins, last_open = 0, 0, None
    for r in range(rounds):
        parts = spread(spark, count, group_rows) if r == 0 else max(1, -(-count // group_rows))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "uid"), F.lit(parts)))
        got = settle(dealt.groupBy("part").applyInArrow(_pack_group(capacity), PACKED), f"packed-{r}")
        got = got.withColumn("sequence_id", (F.lit(r).cast("long") * F.lit(1 << 56)) + F.col("bin"))
        tops = got.where("bound is not null").select(F.posexplode("bound").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row a function
        if r == 0:
            bound = certified(np.array([x.v for x in tops]))
        seen = got.where("offset = 0").select(F.count("*").alias("bins"), F.coalesce(F.sum(F.when(F.col("free") > 0, 1)), F.lit(0)).alias("open")).first()
        if r and last_open is not None and seen.bins > last_open[1]:  # the exchange did not help: keep the packing before it
            got, seen_open = last_open[0], 0
            done = done.unionByName(got.select("uid", "sequence_id", "offset"))
            return done
        closed_bins_now = closed_bins + seen.bins - seen.open
        short = closed_bins + seen.bins > bound
        if not short or seen.open <= 1 or r == rounds - 1:
            return done.unionByName(got.select("uid", "sequence_id", "offset"))
        done = done.unionByName(got.where("free = 0").select("uid", "sequence_id", "offset"))
        last_open = (got.where("free > 0"), seen.open)
        closed_bins = closed_bins_now
        todo = got.where("free > 0").select("uid", "size")
        count = todo.count()
    return done


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of a text by the library, one white-space word at a time, each distinct word encoded once (bounded memo).

    The tokenizer drops white space before it merges, so a text's ids are its words' ids in turn. Words of printable
    Latin-1 characters need no normalization but lower case; their letter runs, digits and symbol runs go straight to
    the library's merge model. All other words take its whole encode, and texts with control characters that only
    Python takes for white space are encoded whole.
    """

    ODD = tuple("\x1c\x1d\x1e\x1f")
    SAFE = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, memo_size: int = 600_000):
        from tokenizers import Tokenizer

        self.tok, self.memo, self.memo_size = Tokenizer.from_file(path), {}, memo_size
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model, self.specials = self.tok.model, [t.content for t in self.tok.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= self.memo_size:
                self.parts.clear()
            ids = array("I", [t.id for t in self.model.tokenize(part.translate(self.letters))])
            if sys.byteorder == "big":
                ids.byteswap()
            got = self.parts[part] = ids.tobytes()
        return got

    def learn(self, words: set[str] | list[str]) -> None:
        memo, part, safe, find = self.memo, self._part, self.SAFE.fullmatch, self.PARTS.findall
        for w in words:
            if not safe(w) or any(s in w for s in self.specials):
                memo[w] = self._encode(w)
            elif w.isalpha():
                memo[w] = part(w.lower())
            else:
                memo[w] = b"".join(map(part, find(w.lower())))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if any(c in text for c in self.ODD):
                yield self._encode(text)
                continue
            words = text.split()
            missing = set(words).difference(self.memo)
            if missing:
                if len(self.memo) + len(missing) > self.memo_size:  # two generations: words still in use move over
                    self.memo, self.old = {}, self.memo
                    missing = set(words)
                if self.old:
                    kept = [w for w in missing if w in self.old]
                    self.memo.update(zip(kept, map(self.old.__getitem__, kept)))
                    missing = missing.difference(kept)
                self.learn(missing)
            yield b"".join(map(self.memo.__getitem__, words))


def shared_words(path: str) -> WordIds:
    """One memo for each Python worker, kept between its tasks."""
    return held(("words", path), lambda: WordIds(path))


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32. Each document's ids are followed by end_id."""
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias(id_col), df[text_col].alias("text__"))
    schema = T.StructType([src.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    end = int(end_id).to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, step = shared_words(tokenizer), 4 * capacity
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(words.ids([t or "" for t in b.column(1).to_pylist()])):
                raw += end
                for k, a in enumerate(range(0, len(raw), step)):
                    part = raw[a : a + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return src.mapInArrow(each, schema)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece with just the end id. Null ids and repeated rows are packed like others;
    an empty table gives an empty result; other columns are not read.
    """
    pieces = token_pieces(df, tokenizer, id_col, text_col, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    pieces = settle(pieces, "pieces")
    placed = pack(pieces.select("uid", F.col("length").alias("size")), capacity)
    return pieces.join(placed, "uid").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
