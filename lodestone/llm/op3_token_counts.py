"""Token counts by a compiled finite-state transducer over a byte-fallback BPE vocabulary.

The tokens of a text prefix end with exactly one last token, and dropping it leaves the tokens of a shorter prefix.
So a deterministic transducer can read the text once: a state holds, for every position from which a longer token
may still start, the token that ends there and the count there relative to now; a transition carries how much the
count changes. Transitions are compiled on first use from the vocabulary and its scores and then reused; so are those of
whole words, since no piece holds a word mark after another character and every word starts from the start state.

Every text is cut into chunks. A chunk's state map takes an entry state to the exit state and the tokens emitted; it
is worked out for the states that are live at the cut, and for another one when composition asks for it: what
depends on the entry state ends with the chunk's first word. Maps compose associatively, pairwise as in a parallel
prefix scan; chunks of a text of several chunks are spread over the cluster.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, small_batches

MARK = "▁"
_RESET = re.compile(f"(?<=[^{MARK}])(?={MARK})")
#: The state before any character.
START = (("", None, 0),)
#: Characters before a cut that are read to find the state that is live there.
LOOK = 64


@dataclass
class StateMap:
    """What a chunk does: `head` is read from the entry state; after its first reset, `rest` tokens and the exit state follow.

    States stand here by value and not by number, so a map stays right when the table of numbers is cleared.
    """

    head: str
    rest: int
    exit: tuple | None  # None: no reset, the head is the whole chunk
    live: dict[tuple, tuple[tuple, int]]  # entry state: (exit state, tokens emitted)


class Transducer:
    """Counts the tokens that the sentencepiece BPE `model_file` gives a text (its default encode)."""

    def __init__(self, model_file: str, memo_size: int = 400_000, table_size: int = 600_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.starts = {p[:k] for p in self.score for k in range(1, len(p))}
        self.memo_size, self.table_size = memo_size, table_size
        self._reset_table()
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _reset_table(self) -> None:
        """Forget all that was compiled. Numbers of states are void after it."""
        self.states: list[tuple] = [START]
        self.ids: dict[tuple, int] = {START: 0}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}

    # -- compilation --------------------------------------------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """The BPE pieces of a short string: the best-scored neighbouring pair merges first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_token(self, t: str) -> bool:
        if t not in self.score:
            return len(t) == 1
        ok = self._whole.get(t)
        if ok is None:
            ok = self._whole[t] = len(self.merge(t)) == 1
        return ok

    def may_follow(self, u: str | None, t: str) -> bool:
        if u is None:
            return True
        ok = self._pairs.get((u, t))
        if ok is None:
            ok = self._pairs[u, t] = self.merge(u + t) == [u, t]
        return ok

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition from `state` on character c: (next state, tokens emitted; may be negative when pieces merge)."""
        live = self.states[state]
        for s, u, rel in live:  # longest first; exactly one fits
            t = s + c
            if self.is_token(t) and self.may_follow(u, t):
                emitted = rel + (1 if t in self.score else len(c.encode("utf-8", "surrogatepass")))
                break
        else:
            raise AssertionError(f"no token ends at {c!r}")
        nxt = tuple((s + c, u, rel - emitted) for s, u, rel in live if s + c in self.starts) + (("", t, 0),)
        to = self.number(nxt)
        self.table[state, c] = to, emitted
        return to, emitted

    def number(self, state: tuple) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        return at

    # -- running ------------------------------------------------------------------------------------------------
    def run(self, state: int, text: str) -> tuple[int, int]:
        """Read text from a state, without resets: (exit state, tokens emitted)."""
        n, table = 0, self.table
        for c in text:
            step = table.get((state, c)) or self.compile(state, c)
            state, n = step[0], n + step[1]
        return state, n

    def word(self, w: str) -> int:
        """Tokens of a word mark and w, read from the start state."""
        n = self.memo.get(w)
        if n is None and (n := self.old.get(w)) is not None:
            self.memo[w] = n
        if n is None:
            n = self.run(0, MARK + w)[1]
            if len(self.memo) >= self.memo_size:  # two generations: words still in use move over
                self.memo, self.old = {}, self.memo
            if len(w) <= 64:
                self.memo[w] = n
        return n

    @staticmethod
    def words(text: str) -> list[str]:
        """text cut at its resets; the first part is before the first one, the others are without their first mark."""
        if MARK + MARK in text:
            first, *more = _RESET.split(text)
            return [first, *[x[1:] for x in more]]
        first, *more = text.split(MARK)
        return [first, *more] if first or not more else [MARK + more[0], *more[1:]]

    def enter(self, state: tuple, head: str) -> tuple[tuple, int]:
        """Read a head from an entry state: a mark after another character starts anew."""
        last = state[-1][1]
        to, n = self.run(0 if last is not None and last[-1] != MARK and head[:1] == MARK else self.number(state), head)
        return self.states[to], n

    def state_map(self, before: str, chunk: str) -> StateMap:
        """The map of a chunk, worked out for the state that the characters before it lead to."""
        if len(self.table) > self.table_size:
            self._reset_table()
        head, *more = self.words(chunk)
        rest, exit_ = 0, None
        if more:
            to, rest = self.run(0, MARK + more[-1])
            exit_, word = self.states[to], self.word
            rest += sum([n if (n := self.memo.get(w)) is not None else word(w) for w in more[:-1]])
        out = StateMap(head, rest, exit_, {})
        entry = 0
        if before:
            first, *more = self.words(before)
            entry = self.run(0, MARK + more[-1])[0] if more else self.run(0, first)[0]
        self.apply(out, self.states[entry])
        return out

    def apply(self, m: StateMap, entry: tuple) -> tuple[tuple, int]:
        """(exit state, tokens emitted) of a map from any state."""
        got = m.live.get(entry)
        if got is None:
            state, n = self.enter(entry, m.head)
            got = m.live[entry] = (state, n) if m.exit is None else (m.exit, n + m.rest)
        return got

    def compose(self, f: StateMap, g: StateMap) -> StateMap:
        """First f, then g."""
        live = {}
        for entry, (between, n) in f.live.items():
            state, more = self.apply(g, between)
            live[entry] = state, n + more
        if f.exit is None:
            return StateMap(f.head + g.head, g.rest, g.exit, live)
        state, n = self.apply(g, f.exit)
        return StateMap(f.head, f.rest + n, state, live)

    def scan(self, maps: list[StateMap]) -> int:
        """Tokens of a whole text from the maps of its chunks, combined pairwise."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.apply(maps[0], START)[1]


def told(state: tuple | None) -> str | None:
    """A state on its way between workers."""
    return None if state is None else json.dumps(state)


def heard(state: str | None) -> tuple | None:
    return None if state is None else tuple(tuple(x) for x in json.loads(state))


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def chunks(text: str, size: int) -> Iterator[tuple[str, str]]:
    """(the characters just before, the chunk) for chunks of `size` characters."""
    for a in range(0, max(1, len(text)), size):
        yield text[max(0, a - LOOK) : a], text[a : a + size]


def shared_transducer(model_file: str, table_size: int) -> Transducer:
    """One transducer for each Python worker: what it has compiled stays for its later tasks."""
    return held(("transducer", model_file, table_size), lambda: Transducer(model_file, table_size=table_size))


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = 1 << 16, table_size: int = 600_000) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Null ids pass through; repeated rows are each counted; other
    columns are not read. A worker keeps about `table_size` transitions and compiles anew beyond. A text is the scan of its chunks' maps: one of a single chunk is done where it is read, the
    chunks of a longer one are spread over the cluster and only their maps come together.
    """
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias(id_col), df[text_col].alias("text__"))
    schema = T.StructType([src.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def rows(ids: pa.Array, size: list[int], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=schema.names)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = shared_transducer(model_file, table_size)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [fst.scan([fst.state_map(*c) for c in chunks(marked(t), chunk_chars)]) if t else 0 for t in texts]
            yield rows(b.column(0), [len(t.encode()) if t else 0 for t in texts], n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                parts = list(chunks(marked(t), chunk_chars))
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    same = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(2).take(same), pa.array([len(t.encode())] * len(some), pa.int64()), pa.array(range(a, a + len(some)), pa.int32()), pa.array([x for x, _ in some], pa.string()), pa.array([x for _, x in some], pa.string())], names=cut_schema.names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = shared_transducer(model_file, table_size)
        for b in batches:
            maps = [fst.state_map(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            pairs = [next(iter(m.live.items())) for m in maps]
            sent = [[m.head for m in maps], [m.rest for m in maps], [told(m.exit) for m in maps], [told(e) for e, _ in pairs], [told(x) for _, (x, _) in pairs], [n for _, (_, n) in pairs]]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array(x, pa.int64() if k in (1, 5) else pa.string()) for k, x in enumerate(sent)]], names=map_schema.names)

    def composed(t: pa.Table) -> pa.Table:
        fst = shared_transducer(model_file, table_size)
        t = t.sort_by("chunk")
        cols = [t[c].to_pylist() for c in ("head", "rest", "exit", "entry", "to", "n")]
        maps = [StateMap(head, rest, heard(exit_), {heard(entry): (heard(to), n)}) for head, rest, exit_, entry, to, n in zip(*cols)]
        ids = t.column(0).slice(0, 1).combine_chunks()
        return pa.Table.from_batches([rows(ids, t["n_bytes"].slice(0, 1).to_pylist(), [fst.scan(maps)])])

    own = src.schema[0]
    fixed = [own, T.StructField("uid", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("chunk", T.IntegerType())]
    cut_schema = T.StructType([*fixed, T.StructField("before", T.StringType()), T.StructField("part", T.StringType())])
    map_schema = T.StructType([*fixed, *[T.StructField(c, T.LongType() if c in ("rest", "n") else T.StringType()) for c in ("head", "rest", "exit", "entry", "to", "n")]])
    several = F.coalesce(F.length("text__") + 1 > chunk_chars, F.lit(False))
    long = src.where(several).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(cut, cut_schema)
    long = long.repartition("uid", "chunk").mapInArrow(mapped, map_schema).groupBy("uid").applyInArrow(composed, schema)
    return src.where(~several).mapInArrow(single, schema).unionByName(long)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
