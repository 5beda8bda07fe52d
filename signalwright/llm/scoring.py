"""LM scoring by the subword lattice: a text's probability is the sum over all its segmentations into pieces of an existing vocabulary.

The pieces are those of a public sentence-piece vocabulary; their weights are unigram log-probabilities counted in the training
documents (its own scores are merge ranks, not probabilities). Pieces never cross words, so the forward recursion runs once for each
distinct word, in log space, over its bytes: every piece that matches is an edge, and each single byte is one too (byte fallback), so
that every text has a probability. A text's score is the sum over its words, plus that of the end: the marginal probability of its
words in their order under the pieces alone. The base score is a plain word model beside it and has no part in the score.

Word counts are a table that grows with the corpus. A word of at least one part in `FREQUENT` of all tokens is looked up in a
broadcast map, which holds FREQUENT words at most, whatever the corpus; all other words are joined, and none of them can be a hot key.

Defined results: a null text is an empty one, whose only token is its end; a very long text is scored whole; rows that repeat a doc_id,
or each other, are each scored, and each counted in training, so equal texts have equal scores; a null doc_id counts as the empty text
in the split; with no training rows every count is zero; an empty table gives no rows; other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import crc_mod, stored

FREQUENT = 1 << 17
#: The end of a text, as a key among the words, which are never empty.
END = b""
SPACE = "▁"
COUNT_KEYS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only


def count_words(docs: DataFrame, held_out) -> DataFrame:
    """word, c (in training documents), c_all; the end counts as a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            words = list(train.keys() | other.keys())
            c = [train[w] for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([a + other[w] for a, w in zip(c, words, strict=True)], pa.int64())], ["word", "c", "c_all"])

        for b in batches:
            texts, out = b.column(0).cast(pa.large_binary()), b.column(1).to_pylist()
            for k, held in enumerate(out):
                into = other if held else train
                into.update(words_of(texts[k].as_py()))
                into[END] += 1
                if len(train) + len(other) > COUNT_KEYS:
                    yield rows()
                    train, other = Counter(), Counter()
        if train or other:
            yield rows()

    partial = docs.select("text", held_out.alias("held_out")).mapInArrow(count, "word binary, c long, c_all long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


class Lattice:
    """log probabilities of words by the forward recursion over a piece vocabulary."""

    def __init__(self, logs: dict[bytes, float]):
        # every prefix of a piece is a key, so that a search from one place stops where nothing longer can match
        self.edges: dict[bytes, float | None] = {}
        for piece, lp in logs.items():
            self.edges[piece] = lp
            for k in range(1, len(piece)):
                self.edges.setdefault(piece[:k], None)

    def log_probability(self, word: bytes) -> float:
        """Natural log of the summed probability of all segmentations of the word, with the mark of its start before it."""
        text = SPACE.encode() + word
        n, get, log1p, exp = len(text), self.edges.get, math.log1p, math.exp
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            at = forward[i]
            if at == -math.inf:
                continue
            for j in range(i + 1, n + 1):
                lp = get(text[i:j], 1.0)
                if lp is None:
                    continue
                if lp == 1.0:
                    break
                x, y = at + lp, forward[j]
                if y < x:
                    x, y = y, x
                forward[j] = y + log1p(exp(x - y)) if x > -math.inf else y
        return forward[n]


def vocabulary(model: str) -> tuple[list[bytes], list[int]]:
    """The bytes of each piece that a word can hold, and its id. Pieces of the same bytes (a letter, and the byte of it) are both given."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, ids = [], []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            pieces.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or SPACE in piece[1:]:
            continue
        else:
            pieces.append(piece.encode())
        ids.append(i)
    return pieces, ids


def piece_counts(vocab: DataFrame, model: str) -> dict[int, int]:
    """How often each piece occurs in the training words, each segmented once by the vocabulary's own rule; at most one entry a piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        total = np.zeros(sp.get_piece_size(), dtype=np.int64)
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(words), 2000):
                found = sp.encode([w.decode("utf-8", "replace") for w in words[lo : lo + 2000]], num_threads=1)
                ids = np.fromiter((i for f in found for i in f), dtype=np.int64)
                times = np.repeat(c[lo : lo + 2000], [len(f) for f in found])
                total += np.bincount(ids, times, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    partial = vocab.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c").mapInArrow(count, "id long, n long")
    return {r["id"]: r["n"] for r in partial.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def piece_logs(counts: dict[int, int], ends: int, model: str) -> tuple[dict[bytes, float], float]:
    """Natural log-probabilities of the pieces, by their bytes, and of the end: counts plus one, over their sum."""
    pieces, ids = vocabulary(model)
    total = sum(counts.get(i, 0) + 1 for i in ids) + ends + 1
    mass: dict[bytes, int] = {}
    for p, i in zip(pieces, ids, strict=True):
        mass[p] = mass.get(p, 0) + counts.get(i, 0) + 1
    return {p: math.log(m / total) for p, m in mass.items()}, math.log((ends + 1) / total)


def score(docs: DataFrame, model: str, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: a boolean column; its rows are scored but not learned from. Default: crc32 of doc_id modulo 7 is 2.
    """
    spark = docs.sparkSession
    held_out = crc_mod(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    vocab = stored(count_words(docs, held_out), "words")
    totals = vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("c_all"), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first()
    n, v, n_all, ends = (x or 0 for x in totals)
    logs, end = piece_logs(piece_counts(vocab, model), ends, model)
    spread = spark.sparkContext.broadcast((logs, end))  # at most one entry a piece of the vocabulary
    floor = n + v + 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, end = Lattice(spread.value[0]), spread.value[1]
        for b in batches:
            lp = np.array([lattice.log_probability(w) if w else end for w in b.column(0).to_pylist()], dtype=np.float64) / math.log(10)
            base = np.log10((b.column(1).to_numpy(zero_copy_only=False) + 1) / floor)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base), pa.array(lp)], ["word", "c", "c_all", "base", "lp"])

    weighed = stored(vocab.mapInArrow(weigh, "word binary, c long, c_all long, base double, lp double"), "weighed")
    least = n_all // FREQUENT + 1  # fewer than FREQUENT words can occur so often
    often = weighed.where(F.col("c_all") >= least).select("word", "c", "base", "lp").toArrow()
    table = spark.sparkContext.broadcast({w: (b, p, int(c > 0)) for w, c, b, p in zip(*(often.column(k).to_pylist() for k in range(4)), strict=True)})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", F.monotonically_increasing_id().alias("row"))
    shape = "word binary, row long, times long, doc_id long, held_out boolean, n_tokens long, known long, base double, lp double"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text with what its frequent words add up to, under a key that no word has; one for each of its other words."""
        get = table.value.get
        for b in batches:
            doc_ids, held, row_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).cast(pa.large_binary())
            out: tuple[list, ...] = tuple([] for _ in range(9))

            def add(*values, out=out) -> None:
                for o, x in zip(out, values, strict=True):
                    o.append(x)

            for k, row in enumerate(row_ids):
                found = words_of(texts[k].as_py())
                found.append(END)
                known, base, lp = 0, 0.0, 0.0
                for w, t in Counter(found).items():
                    if (x := get(w)) is None:
                        add(w, row, t, None, None, None, None, None, None)
                    else:
                        base += t * x[0]
                        lp += t * x[1]
                        known += t * x[2]
                add(b" " + row.to_bytes(8, "little"), row, 0, doc_ids[k], held[k], len(found), known, base, lp)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    for o in out:
                        o.clear()
            if out[0]:
                yield _batch(out)

    parts = rows.mapInArrow(look_up, shape)
    rare = weighed.where(F.col("c_all") < least).select("word", F.col("c").alias("_c"), F.col("base").alias("_base"), F.col("lp").alias("_lp"))
    joined = parts.join(rare, "word", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("_c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce(F.col("base"), F.col("times") * F.col("_base"))).alias("base_score"),
        F.sum(F.coalesce(F.col("lp"), F.col("times") * F.col("_lp"))).alias("score"),
    )
    return joined.select("doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _batch(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["word", "row", "times", "doc_id", "held_out", "n_tokens", "known", "base", "lp"]
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)
