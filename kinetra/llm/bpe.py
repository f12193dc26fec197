"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Greedy merging by rank has one result for each string, and a sequence of tokens is that result if and only if each two
neighbours are: no merge across their seam comes before the merges that built the two. So after any prefix of a piece at most
one token is known to end its encoding. A hypothesis is a place where a token may have begun: the bytes read since, and the
token before. A state of the transducer is the set of live hypotheses; it is built the first time that it is reached, and the
step (state, byte) -> (state, token that ends here) is kept. A token is certain, and put out, as soon as the ways of all live
hypotheses lead through it, which the longest token bounds; so a piece of any length is encoded with a bounded buffer.

Texts are cut by the tokenizer's pattern first; a piece that is itself a token is that token, as in the tiktoken library.
Decoding steps a UTF-8 state machine token by token, with the step (state, token) -> (state, characters) kept as well, so a
character whose bytes are split over tokens comes out when it is complete; malformed bytes come out as U+FFFD.

Edge cases: null and empty texts have no tokens; a null key is passed through; repeated rows come back repeated; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read

#: What a worker keeps: pieces in each of two generations, steps of the transducer and pairs of tokens; a full table is emptied.
PIECES, STEPS, PAIRS = 1 << 17, 3 << 17, 1 << 18
#: Bytes of a piece after which the tokens that are certain are put out.
BUFFER = 1 << 12

_BYTES = [bytes([i]) for i in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Transducer:
    """A state is a dict: byte -> (state, rank of the token that ends here or -1), and under HELD its hypotheses.

    The hypotheses are the bytes read since the first of them began, and (bytes since it began, rank of the token before).
    """

    HELD = -1

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # What tokens begin with: 2 * (rank + 1), 0 for no token; odd if a longer token begins so.
        self.known = {t[:i]: 1 for t in ranks for i in range(1, len(t))}
        for t, i in ranks.items():
            self.known[t] = self.known.get(t, 0) + 2 * (i + 1)
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._clear()

    def _clear(self) -> None:
        key = b"", ((0, -1),)
        self.first: dict = {self.HELD: key}
        self.states = {key: self.first}
        self.n_steps = 0
        self.pairs: dict[int, bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that the token's last merge joins; None if merges don't lead to it."""
        if token not in self.halves:
            parts, top = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, top), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= top:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def built(self, token: bytes) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a (nothing, at the start): going back in time from both, no earlier merge joins what stands at the seam."""
        if not self.built(b):
            return False
        if not a:
            return True
        rank, x, y = self.ranks, a, b
        until_x = until_y = len(rank)  # when x and y are merged into the next larger part
        while True:
            joint = rank.get(x + y)
            if joint is not None and joint < until_x and joint <= until_y:
                return False
            made_x, made_y = rank[x] if len(x) > 1 else -1, rank[y] if len(y) > 1 else -1
            if made_x > made_y:
                until_x, x = made_x, self.split(x)[1]
            elif made_y >= 0:
                until_y, y = made_y, self.split(y)[0]
            else:
                return True

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        pairs = self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        read, held = state[self.HELD]
        read += _BYTES[byte]
        live, ended = [], -1
        for length, last in held:  # the one that began first comes first
            length += 1
            now = read[-length:]
            if not (known := self.known.get(now)):
                continue
            if known & 1:
                live.append((length, last))
            if known > 1 and ended < 0:
                rank = (known >> 1) - 1
                if (fits := pairs.get(last << 32 | rank)) is None:
                    fits = pairs[last << 32 | rank] = self.fits(self.tokens[last] if last >= 0 else b"", now)
                if fits:  # one token ends here, and no other
                    ended = rank
        key = read[-live[0][0] :] if live else b"", (*live, (0, ended)) if ended >= 0 else tuple(live)
        if (after := self.states.get(key)) is None:
            after = self.states[key] = {self.HELD: key}
        self.n_steps += 1
        state[byte] = step = after, ended
        return step

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first `at` bytes, the last one first."""
        ids, tokens = [], self.tokens
        while at > 0:
            ids.append(ends[at - 1])
            at -= len(tokens[ends[at - 1]])
        return ids

    def _certain(self, state: dict, ends: list[int]) -> list[int]:
        """The tokens that the ways of all hypotheses begin with; their bytes leave ends."""
        ways = [self._back(ends, len(ends) - length)[::-1] for length, _ in state[self.HELD][1]]
        n = 0
        while all(len(w) > n for w in ways) and all(w[n] == ways[0][n] for w in ways):
            n += 1
        del ends[: sum(len(self.tokens[i]) for i in ways[0][:n])]
        return ways[0][:n]

    def piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if self.n_steps > STEPS:
            self._clear()
        state, ids, ends = self.first, [], []
        for byte in piece:
            step = state.get(byte)
            state, ended = self._step(state, byte) if step is None else step
            ends.append(ended)
            if len(ends) > BUFFER:
                ids += self._certain(state, ends)
        ids += self._back(ends, len(ends))[::-1]
        return ids


class Utf8Stream:
    """Bytes to characters, byte by byte. A state is the bytes of a character that isn't complete yet."""

    @staticmethod
    def step(state: bytes, byte: int) -> tuple[bytes, str]:
        if not state:
            if byte < 0x80:
                return b"", chr(byte)
            return (bytes([byte]), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")
        low, high = (0xA0 if state == b"\xe0" else 0x90 if state == b"\xf0" else 0x80), (0x9F if state == b"\xed" else 0x8F if state == b"\xf4" else 0xBF)
        if not (low if len(state) == 1 else 0x80) <= byte <= (high if len(state) == 1 else 0xBF):
            after, said = Utf8Stream.step(b"", byte)
            return after, "�" + said
        state += bytes([byte])
        need = 2 if state[0] < 0xE0 else 3 if state[0] < 0xF0 else 4
        return (b"", state.decode()) if len(state) == need else (state, "")

    @staticmethod
    def run(state: bytes, data: bytes) -> tuple[bytes, str]:
        said = []
        for byte in data:
            state, s = Utf8Stream.step(state, byte)
            said.append(s)
        return state, "".join(said)


class Codec:
    """Encoding and decoding of whole texts by one vocabulary. ascii: a faster pattern for texts of ASCII only, if any."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, ascii: str | None = None) -> None:
        self.transducer = Transducer(ranks)
        self.tokens = self.transducer.tokens
        self.cut = regex.compile(pattern).findall
        self.cut_ascii = re.compile(ascii).findall if ascii else self.cut
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; a piece that comes again moves up
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        self.whole: dict[int, str] = {}  # what the tokens say that begin and end between characters
        for i, t in self.tokens.items():
            state, said = Utf8Stream.run(b"", t)
            if not state:
                self.whole[i] = said

    def _piece(self, p: str) -> bytes:
        if (ids := self.older.get(p)) is None:
            ids = array("i", self.transducer.piece(p.encode("utf-8", "surrogatepass"))).tobytes()
        if len(p) <= 64:
            if len(self.pieces) >= PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[p] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        cut = self.cut_ascii(text) if text.isascii() else self.cut(text)
        known, at = list(map(self.pieces.get, cut)), 0
        for _ in range(known.count(None)):
            at = known.index(None, at)
            known[at] = self.pieces.get(cut[at]) or self._piece(cut[at])
        return np.frombuffer(b"".join(known), "<i4")

    def decode(self, ids: list[int]) -> str:
        said = list(map(self.whole.get, ids))
        if None not in said:  # the state machine is between characters after every token
            return "".join(said)
        state, said = b"", []
        for i in ids:
            steps = self.steps.setdefault(state, {})
            if (known := steps.get(i)) is None:
                known = steps[i] = Utf8Stream.run(state, self.tokens[i])
            state = known[0]
            said.append(known[1])
        return "".join(said) + "�" * bool(state)


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str, ascii: str | None) -> Codec:
    """One codec for each worker process; the vocabulary came with the job's files."""
    codec = Codec(load_ranks(SparkFiles.get(name)), pattern, ascii)
    gc.freeze()  # tables stay for the worker's life: looking through them for garbage is in vain
    gc.set_threshold(100_000, 50, 100)
    return codec


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, ascii: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) and decoded (string) of every row; vocabulary is the path of a tiktoken file, shipped to the executors."""
    sc, name = df.sparkSession.sparkContext, vocabulary.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in sc.listFiles}:
        sc.addFile(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern, ascii)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a bounded part of the batch
                part = b.slice(at, 256)
                ids = [codec.encode(t.as_py()) for t in part.column(1)]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, "<i4")])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([codec.decode(x.tolist()) for x in ids], pa.string())], names=["key", "ids", "decoded"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).transform(map_arrow, run, f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def encode_digests(df: DataFrame, vocabulary: str, pattern: str, ascii: str | None = None) -> DataFrame:
    coded = encode_decode(df, vocabulary, pattern, ascii)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: What public_tokenizers.PATTERN comes to on ASCII: its classes of letters, digits and white space written out.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ASCII_PATTERN


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return encode_digests(read(spark, sf_dir, "documents"), *default_vocabulary())
