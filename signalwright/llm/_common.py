"""What the text operators share: the cluster's common folder, checkpoints, cached encoding, text slices."""

from __future__ import annotations

import atexit
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a temporary one under a local master
    (tests), and an error on a cluster, whose machines don't share such folders."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="signalwright-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        sc.setCheckpointDir(f"file://{folder.name}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A narrow intermediate as a reliable checkpoint: later jobs neither redo it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """A wide intermediate (texts, media) as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, case aside."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: The most words of 64 bits that tell rows apart before they travel.
SIEVE = 1 << 19


def sifted(rows: DataFrame, name: str, keys: DataFrame, *on: str) -> DataFrame:
    """rows with a boolean column `name`: false where no row of keys has the same values in the columns `on`, true where one may have them.

    A Bloom filter of SIEVE words at most is broadcast, whatever there is of keys, so that wide rows needn't be shuffled to be told apart;
    with too many keys for it more rows are true, and what follows has more to do.
    """
    word, bits, h = fresh(rows, "_word"), fresh(rows, "_bits"), F.xxhash64(*on)
    place = lambda lo: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, lo).bitwiseAND(63).cast("int"))
    own = place(40).bitwiseOR(place(50))
    held = keys.select(F.pmod(h, F.lit(SIEVE)).alias(word), own.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    met = rows.join(F.broadcast(held), F.pmod(h, F.lit(SIEVE)) == F.col(word), "left")
    return met.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(own) == own, F.lit(False))).drop(word, bits)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The batch's texts as UTF-8, null as empty, in lists of about most_bytes at most (one longer text goes alone)."""
    part: list[bytes] = []
    held = 0
    for x in texts.cast(pa.large_binary()):
        b = x.as_py() or b""
        if part and held + len(b) > most_bytes:
            yield part
            part, held = [], 0
        part.append(b)
        held += len(b)
    if part:
        yield part


class _Known(dict):
    """Remembers what make() gave for a key: the first `most` keys for good, the latest `few` others for a while. Keys longer than `longest`
    (whole texts of a script without spaces, say) are never kept, so that what is kept is bounded in bytes too."""

    def __init__(self, make: Callable, most: int, few: int = 50_000, longest: int = 96):
        super().__init__()
        self.make, self.most, self.few, self.longest, self.latest = make, most, few, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.latest.get(key)
        if value is None:
            value = self.make(key)
            if len(self) < self.most:
                self[key] = value
            else:
                if len(self.latest) >= self.few:
                    self.latest = {}
                self.latest[key] = value
        return value


class _Loose(Exception):
    """White space stands next to a space, so that words can't be told apart there."""


#: Letters that every reader takes for letters, up to ASCII punctuation or white space: a letter and such a mark never share a pre-token
#: (the apostrophe may).
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-&(-/:-@\[-`{-~\x20\x09-\x0D]|$)"
_PIECES = re.compile(rf" ?{_LETTERS}| ?[^\s\x85\u180e]+|\n")
_PARTS = re.compile(rf"{_LETTERS}|[^\x20\x09-\x0D]+")
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: A space between two characters that no reader takes for white space: there a byte-level pre-tokenizer always cuts.
_BORDER = re.compile(r"(?<=[^\s\x85\u180e])(?= [^\s\x85\u180e])")
_BLANK = re.compile(r"[\s\x85\u180e]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes whole texts through what it remembers of their words; the same ids as encoding each text at once.

    spaced: the tokenizer keeps white space, a space being part of the word after it. Else white space only parts words, and letters are
    lower-cased. Words are cut into pieces where the tokenizer always cuts; a piece of letters alone is one pre-token, and goes straight to
    its merge model. Ids are kept as little-endian bytes of the given width.
    """

    def __init__(self, path: str, spaced: bool, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.width, self.letters = spaced, width, byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.pieces = _Known(self._piece, 100_000 if spaced else 60_000)
        self.words = _Known(self._spaced_word if spaced else self._word, 250_000 if spaced else 160_000)

    def _raw(self, ids) -> bytes:
        own = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            own.byteswap()
        return own.tobytes()

    def whole(self, text: str) -> bytes:
        return self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if _PLAIN(piece):
            own = piece if self.spaced else piece.lower()
            return self._raw([t.id for t in self.merge(own.encode().decode("latin-1").translate(self.letters))])
        return self.whole(piece)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if (m := _SIMPLE(text)) is None:
            return b"".join(map(self.pieces.__getitem__, _PARTS.findall(text)))
        return self.pieces[m[1]] + (self.pieces[m[2]] if m[2] else b"")

    def _spaced_word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if (m := _SIMPLE(text)) is not None:
            return self.pieces[" " + m[1]] + (self.pieces[m[2]] if m[2] else b"")
        if not text or _BLANK.match(text[0]) or _BLANK.match(text[-1]):
            raise _Loose
        return self._between(" " + text)

    def _between(self, text: str) -> bytes:
        """The ids of a text without white space at its ends, but for a space before it."""
        found = _PIECES.findall(text)
        if "\n\n" in text or sum(map(len, found)) < len(text):
            return self.pieces[text]
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes."""
        get = self.words.__getitem__
        if not self.spaced:
            return [b"".join(map(get, b.lower().split())) for b in texts]
        out = []
        for b in texts:
            first, *rest = b.split(b" ")
            try:
                start = first.decode("utf-8", "replace")
                if not start or _BLANK.match(start[0]) or _BLANK.match(start[-1]):
                    raise _Loose
                out.append(b"".join([self._between(start), *map(get, rest)]))
            except _Loose:
                out.append(b"".join(map(self.pieces.__getitem__, _BORDER.split(b.decode("utf-8", "replace")))) if b else b"")
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def _encoder(path: str, spaced: bool, width: int) -> PieceEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, spaced, width)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, spaced, width)
    return _encoders[key]


def word_encoder(path: str) -> PieceEncoder:
    """For a tokenizer that drops white space and lower-cases; ids of 32 bits."""
    return _encoder(path, False, 4)


def byte_encoder(path: str) -> PieceEncoder:
    """For a byte-level tokenizer of at most 65,536 ids; ids of 16 bits."""
    return _encoder(path, True, 2)
