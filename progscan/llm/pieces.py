"""Operator 9: SentencePiece encoding and decoding by a streaming Viterbi.

The lattice over a text has a node at every character boundary and an edge for
every piece of the vocabulary. One survivor, the best path, is kept per node:

* unigram models: the path with the largest sum of piece scores;
* BPE models: scores are merge ranks, and a sum of ranks is not what the model
  means. A sequence of pieces is the model's encoding exactly if every two
  neighbours, encoded alone, come out as these two pieces, so an edge survives
  only behind a piece it is stable with, and at most one path reaches a node.

The edges into a boundary are those of the pieces that end there, which an
automaton tells as it reads the text (a step per character; its states, the
beginnings of pieces, are made when first met), so no other substring is looked
up. Only the nodes of the last ``longest piece`` characters can still be left by
an edge. Every so many characters their backpointers are followed until all meet
in one boundary; what lies before it can no longer change, its ids are
committed and its nodes forgotten. A text of any length so needs a window, not
a lattice. Where no piece contains two adjacent characters (in the models at
hand: any character before a space, and line feeds) all paths meet by
construction (as before signs that no piece joins to letters), and what lies
between such places is remembered in a bounded cache.

Work is spread by Spark: one Arrow batch of whole texts at a time, no shuffle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from progscan.llm.common import table
from progscan.llm.registry import job

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A model file is sent to the executors; larger ones are refused.
MAX_MODEL_BYTES = 64 << 20
#: Encoded stretches a Python worker remembers, in each of two generations; longer stretches are not remembered.
CACHE_ITEMS, CACHE_CHARS = 200_000, 40
#: Texts encoded before their ids are handed back to Spark.
SLICE = 256
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """The pieces of a model file: id, score, kind, and the settings of its normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = {1: "unigram", 2: "bpe"}
        if proto.trainer_spec.model_type not in kinds:
            raise ValueError("only unigram and BPE models have scored pieces")
        self.kind = kinds[proto.trainer_spec.model_type]
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep the text as it is (identity, all white space) are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            surface = b""
            if p.type == p.NORMAL:
                self.pieces[p.piece], self.scores[p.piece] = i, p.score
                surface = p.piece.replace(SPACE, " ").encode()
            elif p.type == p.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                surface = bytes([int(p.piece[1:-1], 16)])
            elif p.type == p.UNKNOWN:
                self.unknown, surface = i, (proto.trainer_spec.unk_surface or " ⁇ ").encode()
            elif p.type == p.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            self.surface.append(surface)
        self.longest = max(map(len, self.pieces))
        self.least = min(self.scores.values()) - UNKNOWN_PENALTY
        inner = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.breaks_at_space = not any(x[1] == SPACE != x[0] for x in inner)
        self.breaks_at_lines = not any("\n" in p for p in self.pieces)
        # signs: ASCII characters that are no letters, and what stands before them inside pieces; a small class,
        # and no piece goes on from any other character to one
        signs = {c for p in self.pieces for c in p if c < "\x80" and not c.isalpha()} - {"\n"}
        while more := {x[0] for x in inner if x[1] in signs} - signs - {SPACE}:
            signs |= more
        letters = any(unicodedata.category(c)[0] in "LM" for c in signs)
        self.signs = "" if letters else "".join(sorted(signs))

    def ids_of(self, piece: str) -> list[int]:
        """The id of a piece; an unknown character becomes its UTF-8 bytes, or the unknown id."""
        i = self.pieces.get(piece)
        if i is not None:
            return [i]
        if len(self.byte_ids) == 256:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown]


class Piece:
    """A piece (or a character that is none): its text, score, and the two pieces that merge into it last."""

    __slots__ = ("text", "score", "left", "right", "stable", "ids")

    def __init__(self, text: str, score: float):
        self.text, self.score = text, score
        self.left = self.right = None
        self.ids = None  # int32 bytes, once asked for
        self.stable = None  # not yet known whether, encoded alone, it comes out as itself


class State:
    """What the characters read so far can still become: their longest end that begins a piece."""

    __slots__ = ("text", "ends", "next")

    def __init__(self, text: str):
        self.text, self.ends, self.next = text, [], {}


class StreamingViterbi:
    """Encodes normalised text piece by piece; ``commits`` tells where paths met, for tests."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.table = {text: Piece(text, score) for text, score in vocab.scores.items()}
        self.others: dict[str, Piece] = {}  # single characters that are no pieces
        self.fitting: dict[tuple[Piece, Piece], bool] = {}
        self.begun = {text[:i] for text in vocab.scores for i in range(1, len(text) + 1)}
        self._forget()

    def _piece(self, text: str) -> Piece:
        """The piece of this text, or of a single character that is none, with its parts."""
        got = self.table.get(text) or self.others.get(text)
        if got is None:
            if len(self.others) >= CACHE_ITEMS:
                self.others = {}
            got = self.others[text] = Piece(text, self.v.least)
        if got.stable is None:
            got.stable = True
            if len(text) > 1 and self.v.kind == "bpe":
                got.stable, got.left, got.right = self._merged(text)
        return got

    def _merged(self, text: str) -> tuple[bool, Piece | None, Piece | None]:
        """Whether byte-pair merges (best score first, leftmost on ties) make one piece of a text, and its last two parts."""
        parts, scores = list(text), self.v.scores
        while True:
            best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores),
                       default=None)
            if best is None:
                return False, None, None
            i = -best[1]
            if len(parts) == 2:
                return True, self._piece(parts[0]), self._piece(parts[1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, left: Piece, right: Piece) -> bool:
        """Whether two stable neighbours, encoded together, stay these two.

        The merges are undone, the later of the two sides' first. At every step
        the parts that touch at the border could have merged across it, if the
        vocabulary has their union and it would have come before the merge
        undone last (on a tie the merge further left comes first).
        """
        scores, limit, before = self.v.scores, -math.inf, False
        while True:
            across = scores.get(left.text + right.text)
            if across is not None and (across > limit or (across == limit and not before)):
                return False
            if left.left is not None and (right.left is None or left.score < right.score):
                limit, before, left = left.score, True, left.right
            elif right.left is not None:
                limit, before, right = right.score, False, right.left
            else:
                return True

    def _step(self, state: State, char: str) -> State:
        """The state behind one more character: the longest end of what was read that begins a piece, and the pieces
        (BPE: those that can survive) that end there, long ones first. A character no piece begins with is not kept."""
        text = state.text + char
        while text not in self.begun and text:
            text = text[1:]
        got = self.states.get(text)
        if got is None:
            got = State(text)
            ends = [text[i:] for i in range(len(text) - 1) if text[i:] in self.table]
            got.ends = [(len(p.text), p) for p in map(self._piece, [*ends, char]) if p.stable or self.v.kind != "bpe"]
            if not text:
                got.next = self.start.next
                return got
            self.states[text] = got
        if self.steps >= 2 * CACHE_ITEMS:
            self._forget()
        self.steps += 1
        state.next[char] = got
        return got

    def _forget(self) -> None:
        self.start, self.states, self.steps = State(""), {}, 0

    def found(self, text: str, commits: list[int] | None = None) -> Iterator[Piece]:
        """The pieces of a normalised text, each as soon as no later character can change it."""
        longest, bpe, fitting = self.v.longest, self.v.kind == "bpe", self.fitting
        known, state = fitting.get, self.start
        root = (0, None, None, 0.0)  # boundary, backpointer, piece that ends here, score
        nodes = [root]  # of the last boundaries, every one of which is reached
        for end, char in enumerate(text, 1):
            state = state.next.get(char) or self._step(state, char)
            best = None
            if bpe:
                for size, piece in state.ends:
                    node = nodes[-size]
                    left = node[2]
                    if left is not None:
                        fits = known((left, piece))
                        if fits is None:
                            if len(fitting) >= 2 * CACHE_ITEMS:
                                fitting.clear()
                            fits = fitting[left, piece] = self._fits(left, piece)
                        if not fits:
                            continue
                    best = (end, node, piece, 0.0)
                    break
            else:
                for size, piece in state.ends:
                    node = nodes[-size]
                    if best is None or node[3] + piece.score >= best[3]:
                        best = (end, node, piece, node[3] + piece.score)
            nodes.append(best)
            if end % longest == 0:
                del nodes[:-longest]
                met = self._meet(nodes)
                if met is not root:
                    yield from self._path(met, root)
                    # the meeting point becomes the root: nothing before it is kept
                    root = (met[0], None, met[2], 0.0)
                    nodes = self._rooted(nodes, met, root)
                    if commits is not None:
                        commits.append(root[0])
        if text:
            yield from self._path(nodes[-1], root)

    def pieces(self, text: str, commits: list[int] | None = None) -> Iterator[str]:
        """The texts of ``found``."""
        return (p.text for p in self.found(text, commits))

    @staticmethod
    def _meet(nodes: list) -> tuple:
        """The last boundary that the paths of all nodes share."""
        at = {id(n): n for n in nodes}
        while len(at) > 1:
            far = max(at.values(), key=lambda n: n[0])
            del at[id(far)]
            at[id(far[1])] = far[1]
        return next(iter(at.values()))

    @staticmethod
    def _rooted(alive: list, met: tuple, root: tuple) -> list:
        """The alive nodes with paths that begin at the new root."""
        made = {id(met): root}

        def copy(n: tuple) -> tuple:
            if id(n) not in made:
                made[id(n)] = (n[0], copy(n[1]), n[2], n[3] - met[3])
            return made[id(n)]

        return [copy(n) for n in alive]

    @staticmethod
    def _path(node: tuple, root: tuple) -> list[Piece]:
        out = []
        while node is not root:
            out.append(node[2])
            node = node[1]
        return out[::-1]


class Codec:
    """encode and decode of one model; one per Python worker."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.viterbi = StreamingViterbi(self.v)
        space, line = (SPACE if self.v.breaks_at_space else ""), ("\n" if self.v.breaks_at_lines else "")
        # a stretch: spaces, signs, then letters and the rest, up to the next sure meeting point
        signs, stops = re.escape(self.v.signs), re.escape(space + line)
        parts = [f"{line}+"] if line else []
        lead = f"{space}*" if space else ""
        if signs:
            parts += [f"{lead}[{signs}]*[^{signs}{stops}]+", f"{lead}[{signs}]+"]
        else:
            parts += [f"{lead}[^{stops}]+"] if stops else [".+"]
        parts += [f"{space}+"] if space else []
        self.stretches = re.compile("|".join(parts), re.S).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, p: Piece) -> bytes:
        p.ids = np.array(self.v.ids_of(p.text), dtype=np.int32).tobytes()
        return p.ids

    def _stretch(self, s: str) -> bytes:
        got = self.old.get(s)
        if got is None:
            got = b"".join([p.ids or self._ids(p) for p in self.viterbi.found(s)])
        if len(s) <= CACHE_CHARS:
            if len(self.new) >= CACHE_ITEMS:
                self.new, self.old = {}, self.new
            self.new[s] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a text as int32; none for a null or empty text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        stretches = self.stretches((SPACE if self.v.prefix else "") + text.replace(" ", SPACE))
        parts = list(map(self.new.get, stretches))
        if None in parts:
            parts = [self._stretch(s) if p is None else p for s, p in zip(stretches, parts)]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.v.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


_CODECS: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return model


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL,
           round_trip: str | None = None) -> DataFrame:
    """df with the piece ids of a text column as array<int>, and, if named, whether they decode to the same text.

    Null and empty texts have no ids (and decode to the empty text). Rows are
    neither dropped nor moved; columns of these names are replaced. The text's
    own U+2581 is a space to any SentencePiece model and decodes to one.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))
    kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("same", BooleanType())])
    check = round_trip is not None

    @F.arrow_udf(kind)
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(sent.value)
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                texts = batch[lo:lo + SLICE].to_pylist()
                got = [codec.encode(t) for t in texts]
                same = [codec.decode(i.tolist()) == (t or "") if check else None for i, t in zip(got, texts)]
                ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
                yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "same"])

    made = "_encoded"
    while made in df.columns:
        made = "_" + made
    out = df.withColumn(made, encoded(F.col(text))).withColumn(ids, F.col(made)["ids"])
    return (out.withColumn(round_trip, F.col(made)["same"]) if check else out).drop(made)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """df with the text of an id column; null ids: null. An id outside the vocabulary is an error."""
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    @F.pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(sent.value)
        for rows in batches:
            yield pd.Series([None if i is None else codec.decode(i) for i in rows], dtype=object)

    return df.withColumn(text, decoded(F.col(ids)))


@job("op9_streaming_viterbi")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, round_trip="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
