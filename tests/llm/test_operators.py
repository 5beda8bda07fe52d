"""The text operators against brute force, exact round trips, held-out accuracy and SQL, on odd and on real rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalwright.llm import _common, langid, linededup, media, mixing, packing, quality, queries, scoring, sharding, simhash, tokenfiles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, shuffle_key string, _row string, _drop string, n_removed string, prediction string, _source string, key string, id string, mark string"
ODD = [
    "", " ", "one", "two words", "  a  b ", "a\n\nb\n", "\n", "x" * 5000, "Word, word. Don't! 12 345 #$% éàü ÀÉ", "tab\tsep\x0b\x0c\rend", "日本語 テキスト", "!!! ... 123", "<|endoftext|> is text",
    "line one here\nline two here\nline three here\nline four here\nline five here", "start\nline one here\nline two here\nline three here\nline four here\nline five here\nend",
    "the of and to in is " * 30, "a\x1cb᠎c d e", "of the and to\nof the and to\nsomething else in the line of it here now", "·"]


def rows(texts):
    return [(i, t, None if i % 5 == 0 else ("en", "de", "fr")[i % 3], None if i % 4 == 0 else f"s{i % 3}", len(t or ""), *["x"] * 10) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, a repeated row, repeated texts, columns with clashing names."""
    own = rows([*ODD, None, ODD[8], ODD[13], "big " * 30_000])
    own += [own[8], (None, "no id here at all", None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)]
    return spark.createDataFrame(own, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same_as_sql(spark, name, sf=SF):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same_as_sql(spark, name)


@pytest.mark.parametrize("make,file,width", [(_common.word_encoder, "word_bpe_49k.json", 4), (_common.byte_encoder, "byte_bpe_50k.json", 2)])
def test_encoders_give_the_tokenizers_ids(docs, make, file, width):
    own = Tokenizer.from_file(public_tokenizers.path(file))
    own.encode_special_tokens = True
    texts = [*ODD, *(t for _, t in texts_of(docs)), "a '  b", "don't can't's 'll", "ABC'S×x", "İstanbul ΑΣ Σ", "é x ́y", "a\r\nb", "a\x01b \x01 c", "﻿ x", "q\n w", "lead\n\n\nx  y"]
    got = make(public_tokenizers.path(file)).encode([t.encode() for t in texts])
    for text, raw in zip(texts, got, strict=True):
        assert raw == b"".join(i.to_bytes(width, "little") for i in own.encode(text, add_special_tokens=False).ids), text[:50]


def check_packing(df, capacity=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), capacity).collect()
    want = []
    for doc, text in texts_of(df):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, lo in enumerate(range(0, len(ids), capacity)):
            own = ids[lo : lo + capacity]
            want.append((doc, n, lo, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans), sum(r[3] for r in want)


def test_packing(docs, odd, empty):
    used, tokens = check_packing(docs)
    assert used <= math.ceil(tokens / 2048 * 1.01)
    check_packing(odd, 64)
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_plan_is_near_the_bound():
    for seed, n in ((1, 300), (2, 20_000)):
        own = np.minimum(np.random.default_rng(seed).lognormal(6, 1, n).astype(int) + 1, 2048)
        counts = np.bincount(own, minlength=2049)
        plan = packing.plan(counts, 2048)
        # whatever is over half a sequence has one of its own
        assert plan.sequences <= 1.005 * max(math.ceil(own.sum() / 2048), (own > 1024).sum()) + 1
        assert (np.bincount(plan.length, plan.each, minlength=2049)[counts > 0] > 0).all()


def plain_best_fit(own, capacity):
    rooms = []
    for v in sorted(own, reverse=True):
        k = min((k for k, r in enumerate(rooms) if r >= v), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - v)
        else:
            rooms[k] -= v
    return len(rooms)


@pytest.mark.parametrize("name", ["lognormal", "uniform", "triplets", "few", "small"])
def test_packing_plan_never_loses_to_best_fit(name):
    rng = np.random.default_rng(4)
    if name == "triplets":
        a = rng.integers(300, 900, 400)
        b = ((2048 - a) * rng.random(400)).astype(int).clip(100)
        own = np.concatenate([a, b, 2048 - a - b]).clip(1)
    else:
        own = {"lognormal": np.minimum(rng.lognormal(6, 1, 2000).astype(int) + 1, 2048), "uniform": rng.integers(600, 1101, 1500), "few": rng.choice([700, 701, 350, 1300, 1348, 90], 1500), "small": rng.integers(50, 400, 2000)}[name]
    plan = packing.plan(np.bincount(own, minlength=2049), 2048)
    assert plan.sequences <= plain_best_fit(own.tolist(), 2048)
    if name in ("lognormal", "triplets", "small"):
        assert plan.sequences <= math.ceil(own.sum() / 2048) + 1


def test_packing_plan_against_exhaustive_search():
    rng = random.Random(9)

    def fewest(own, rooms, limit):
        if not own:
            return len(rooms)
        best = limit
        for r in sorted({*(r for r in rooms if r >= own[0]), 20} if len(rooms) < best - 1 else {r for r in rooms if r >= own[0]}):
            left = list(rooms)
            if r in left and r != 20 or r in left and r >= own[0]:
                left.remove(r)
            best = min(best, fewest(own[1:], sorted([*left, r - own[0]]), best))
        return best

    for _ in range(10):
        own = sorted((rng.randrange(3, 15) for _ in range(8)), reverse=True)
        assert packing.plan(np.bincount(own, minlength=21), 20).sequences <= fewest(own, [], 8) + 1


def test_knapsack_finds_the_best_price():
    """No more pieces than there are; every room's filling is worth what the program says."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = np.where(rng.random(13) < 0.6, rng.integers(0, 4, 13), 0)
        counts[0] = 0
        if not counts.any():
            continue
        price = rng.random(13)
        items = packing.multiples(counts, 12)
        items = [items[k] for k in rng.permutation(len(items))]
        best, taken = packing.knapsack(price, items, 12)
        own = [v for v in range(13) for _ in range(counts[v])]

        def most(k, room):
            return 0.0 if k == len(own) else max(most(k + 1, room), price[own[k]] + most(k + 1, room - own[k]) if own[k] <= room else 0.0)

        lengths = np.flatnonzero(counts)
        rooms = np.arange(13)
        held = packing.fillings(rooms, items, taken, {int(v): i for i, v in enumerate(lengths)})
        for room in rooms:
            assert math.isclose(best[room], most(0, room), abs_tol=1e-9)
            assert math.isclose(held[room] @ price[lengths], best[room], abs_tol=1e-9) and held[room] @ lengths <= room
            assert (held[room] <= counts[lengths]).all()


def histograms():
    rng = np.random.default_rng(2)
    yield "lognormal", np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2047), 0.9, 0.001
    yield "uniform", rng.integers(600, 1101, 3000), 0.8, None
    yield "bimodal", np.concatenate([rng.integers(900, 1100, 1500), rng.integers(100, 400, 3000)]), 0.9, 0.001


def test_the_program_places_the_pieces():
    """At least nine tenths of the tokens stand in the program's configurations, and the sequences are at the bound or near it."""
    for name, own, least, over in histograms():
        used, bound, share = packing.best_configurations(np.bincount(own, minlength=2049), 2048)
        assert share >= least, name
        n = sum(used.values())
        assert n >= bound - 1e-6
        assert over is None or n <= math.ceil(bound - 1e-6) * (1 + over), name
        placed = np.zeros(2049, dtype=int)
        for c, m in used.items():
            assert sum(v * k for v, k in c) <= 2048
            for v, k in c:
                placed[v] += k * m
        assert (placed == np.bincount(own, minlength=2049)).all()


def test_the_program_places_the_documents(docs):
    encode = _common.word_encoder(public_tokenizers.path("word_bpe_49k.json")).encode
    counts = np.zeros(2049, dtype=int)
    for raw in encode([(t or "").encode() for _, t in texts_of(docs)]):
        counts[(len(raw) // 4 + 1) % 2048] += 1
    counts[0] = 0
    used, bound, share = packing.best_configurations(counts, 2048)
    assert share >= 0.9 and sum(used.values()) <= math.ceil(bound) + 1


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mix(odd)
    assert got.columns == [*odd.columns, "copy_", "shuffle_key_"]
    assert mixing.mix(empty).count() == 0
    only = mixing.mix(odd, {"s1": 1.0}, other=0.0, total=500.0)
    assert {r["source"] for r in only.select("source").collect()} == {"s1"}
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix(big, {"a": 3.0, "b": 1.0}, other=0.5, total=200_000.0).groupBy("source").count().collect()}
    for name, share in (("a", 3 / 4.5), ("b", 1 / 4.5), (None, 0.5 / 4.5)):
        assert abs(counts[name] - 200_000 * share) < 5 * math.sqrt(200_000 * share)


def test_mixing_counts_are_poisson(spark):
    own = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    drawn = mixing.mix(own, total=60_000.0).groupBy("doc_id").count().groupBy("count").count().collect()
    found = {r[0]: r[1] for r in drawn}
    for k in range(1, 7):
        want = 30_000 * math.exp(-2) * 2**k / math.factorial(k)
        assert abs(found[k] - want) < 5 * math.sqrt(want)


def test_mixing_with_many_sources_joins_by_salted_keys(odd, monkeypatch):
    want = sorted(map(repr, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(odd).collect())) == want


def brute_base(df):
    train, rows_ = collections.Counter(), []
    for doc, text in texts_of(df):
        words = (text or "").encode().lower().split() + [None]
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
        rows_.append((doc, held, words))
        if not held:
            train.update(words)
    n, v = sum(train.values()), len(train)
    return train, n, [(doc, held, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for doc, held, w in rows_]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_scoring_base(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(scoring, "FREQUENT", 50)
    got = scoring.score(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    _, _, want = brute_base(df)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] < 0


def test_scoring_from_end_to_end(docs):
    """Counts of the pieces, their weights and the sum over all segmentations, in plain Python by recursion."""
    import functools

    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    train, _, _ = brute_base(docs)
    counts = collections.Counter()
    for w, c in train.items():
        if w is not None:
            for i in sp.encode(w.decode()):
                counts[i] += c
    mass, total = collections.Counter(), train[None] + 1
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw = bytes.fromhex(piece[3:-1])
        elif i > 2 and "▁" not in piece[1:]:
            raw = piece.encode()
        else:
            continue
        mass[raw] += counts[i] + 1
        total += counts[i] + 1

    @functools.cache
    def probability(text):
        return sum(mass[text[:k]] / total * probability(text[k:]) for k in range(1, len(text) + 1) if text[:k] in mass) if text else 1.0

    got = {r["doc_id"]: r["score"] for r in scoring.score(docs, model).collect()}
    for doc, text in texts_of(docs)[:60]:
        words = (text or "").encode().lower().split()
        want = sum(math.log10(probability("▁".encode() + w)) for w in words) + math.log10((train[None] + 1) / total)
        assert math.isclose(got[doc], want, rel_tol=1e-9)


def test_scoring_is_the_same_by_map_and_by_join(docs, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in scoring.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    monkeypatch.setattr(scoring, "FREQUENT", 1)
    for r in scoring.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        assert math.isclose(r["score"], whole[r["doc_id"]], rel_tol=1e-9)


def test_scoring_empty(empty):
    assert scoring.score(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_lattice_sums_all_segmentations():
    rng = random.Random(3)
    mark = scoring.SPACE.encode()
    logs = {bytes([b]): -rng.random() * 4 - 2 for b in {*mark, *b"abc"}}
    logs |= {p: -rng.random() * 5 for p in (b"ab", b"abc", b"ca", mark, mark + b"a", mark + b"abc", b"cab")}
    lattice = scoring.Lattice(logs)
    for word in map(bytes, itertools.product(b"abc", repeat=5)):
        text = mark + word
        total = 0.0
        for borders in itertools.product((0, 1), repeat=len(text) - 1):
            at = [0, *(i + 1 for i, x in enumerate(borders) if x), len(text)]
            parts = [text[i:j] for i, j in itertools.pairwise(at)]
            if all(p in logs for p in parts):
                total += math.exp(sum(logs[p] for p in parts))
        assert math.isclose(lattice.log_probability(word), math.log(total), rel_tol=1e-9)


def test_language_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred != 'und'")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def test_language_odd_rows(odd, empty):
    got = langid.identify(odd)
    assert got.columns[-1] == "prediction_" and got.count() == odd.count()
    for r in got.collect():
        p, text = r["prediction_"], r["text"]
        assert 0 <= p["score"] <= 1
        assert (p["lang_pred"] == "und") == (text is None or not any(map(str.isalpha, text)))
    assert langid.identify(empty).count() == 0
    assert {r["prediction_"]["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["prediction_"]["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}


@pytest.mark.parametrize("which,shards", [("docs", 16), ("odd", 4)])
def test_sharding(request, which, shards):
    df = request.getfixturevalue(which)
    got = sharding.assign_shards(_common.cut(sharding.sized(df)), shards).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts_of(df)]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(want, key=key)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    even = sum(sizes.values()) / shards
    assert max(abs(sizes[k] - even) for k in range(shards)) <= 0.02 * even + max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_subdivides_and_ignores_the_split_of_the_input(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    sized = _common.cut(sharding.sized(rows))
    ranged = sharding.ranges_of(sized, 16, first=np.zeros(0, dtype="S16")).groupBy("range").count().collect()
    assert len(ranged) >= 8 and max(r["count"] for r in ranged) <= sharding.OVERFULL * 4000 / 16
    one, two = (sorted(map(tuple, sharding.assign_shards(_common.cut(sharding.sized(rows.repartition(n)))).select("doc_id", "shard", "slot").collect())) for n in (1, 7))
    assert one == two


def test_sharding_hot_group_and_empty(spark, empty):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "same text " * 20).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = sharding.assign_shards(_common.cut(sharding.sized(hot)), 16).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 16 and max(r["b"] for r in got) < 1.03 * min(r["b"] for r in got)
    assert sharding.assign_shards(_common.cut(sharding.sized(empty)), 16).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(request, which):
    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    at, want = 0, []
    for doc, text in sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = tokenfiles.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_empty(empty):
    assert tokenfiles.round_trip(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_table_lookup_and_damage():
    rng = random.Random(2)
    ids = sorted({rng.randrange(-(10**6), 10**15) for _ in range(700)} | {-(1 << 63), 0, (1 << 63) - 1})
    own = [(None, b"\1\0"), *((i, rng.randbytes(2 * rng.randrange(0, 60))) for i in ids), ((1 << 63) - 1, b"again!")]
    table = tokenfiles.in_memory(own, block_bytes=512)
    assert list(table) == own and len(table.blocks) > 10
    for doc in [None, *ids]:
        assert table.get(doc) == [raw for d, raw in own if d == doc]
    misses = [i + 1 for i in ids[1:-1] if i + 1 not in ids]
    assert all(table.get(i) == [] for i in misses)
    passed = sum(all(table.bloom[p >> 3] >> (p & 7) & 1 for p in tokenfiles._probes(tokenfiles.key_of(i), table.bits, table.hashes)) for i in misses)
    assert passed < 0.05 * len(misses)
    raw = bytearray(table.file.getvalue())
    raw[100] ^= 1
    import io
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfiles.TableReader(io.BytesIO(bytes(raw)), len(raw)))


def brute_lines(own):
    """own: (doc_id, text) rows; what is left of each text, by (doc_id, text)."""
    import hashlib

    def chunks(text):
        lines, out = text.split("\n"), set()
        for factor in linededup.FACTORS:
            mixed = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) * factor % linededup.PRIME for x in lines]
            start = 0
            for i in range(1, len(lines)):
                if i == len(lines) - 1 or mixed[i] < 0.8 * linededup.PRIME:
                    if "\n".join(lines[start : i + 1]).encode().split():
                        out.add((start, tuple(lines[start : i + 1])))
                    start = i
        return out

    first, n, docs = {}, collections.Counter(), {r: chunks(r[1]) for r in own if r[1] is not None}
    for (doc, text), parts in docs.items():
        for start, c in parts:
            place = (doc is None, doc or 0, start, text)
            first[c] = min(place, first.get(c, place))
            n[c] += 1
    left = {}
    for (doc, text), parts in docs.items():
        here = {start + k: first[c] == (doc is None, doc or 0, start, text) for stays in (False, True) for start, c in parts if n[c] > 1 and (first[c] == (doc is None, doc or 0, start, text)) == stays for k in range(len(c))}
        gone = {i for i, stays in here.items() if not stays}
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone]
        left[(doc, text)] = "\n".join(kept) if kept else None
    return left


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_line_dedup(request, which):
    df = request.getfixturevalue(which)
    got = sorted(map(repr, ((r["doc_id"], r["text"]) for r in linededup.dedup_lines(df).select("doc_id", "text").collect())))
    left = brute_lines(texts_of(df))
    want = [(d, t if t is None else left[(d, t)]) for d, t in texts_of(df)]
    assert got == sorted(map(repr, (w for w, (d, t) in zip(want, texts_of(df), strict=True) if t is None or w[1] is not None)))


def test_line_dedup_columns_and_empty(odd, empty):
    assert linededup.dedup_lines(odd).columns == [*odd.columns, "n_removed_"]
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_boundaries_shift_with_the_text(spark):
    passage = "\n".join(f"line number {i} of a long shared passage" for i in range(400))
    got = linededup.dedup_lines(spark.createDataFrame([(1, "head\n" + passage), (2, "another\nhead here\nand more\n" + passage + "\ntail")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["n_removed"] == 0 and len(got[1]["text"]) < 0.1 * len(passage)


def test_line_dedup_finds_most_short_passages(spark):
    """Passages of three lines, each in two documents among other lines; the rest stays."""
    rows = [(d, "\n".join([f"own line {d} a", f"own line {d} b", *(f"shared line {d % 200} {k}" for k in range(3)), f"own line {d} c"])) for d in range(400)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == rows[d][1] for d in range(200))
    assert sum("shared" not in got[d] or got[d].count("shared") < 3 for d in range(200, 400)) > 160
    assert all(got[d].count("own") == 3 for d in range(400))


@pytest.mark.parametrize("k", [2, 3, 4])
def test_line_dedup_finds_runs_of_any_length(spark, k):
    """Of the runs of k lines with words that stood before, nine tenths go at least; every repeated pair stays whole once."""
    sf = "/root/testdata/sf0.01"
    own = [(d, t.split("\n")) for d, t in sorted(texts_of(spark.read.parquet(f"{sf}/documents.parquet"))) if t is not None]
    left = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    runs = lambda lines: (tuple(lines[i : i + k]) for i in range(len(lines) - k + 1) if all(x.split() for x in lines[i : i + k]))
    seen, kept = collections.Counter(), collections.Counter()
    for d, lines in own:
        seen.update(runs(lines))
        kept.update(runs(left[d][0].split("\n") if d in left else []))
    again = [r for r, n in seen.items() if n > 1]
    later, stays = sum(seen[r] - 1 for r in again), sum(max(0, kept[r] - 1) for r in again)
    assert later > 500 and stays <= 0.1 * later
    assert sum(not kept[r] for r in again) <= (0 if k == 2 else 0.1 * len(again))


def test_line_dedup_of_a_very_long_text(spark):
    """Its chunks repeat in itself a hundred thousand times: the work has to stay in proportion."""
    own = "\n".join([f"line {i} of twelve" for i in range(12)] * 20_000)
    (got,) = linededup.dedup_lines(spark.createDataFrame([(1, own)], "doc_id long, text string")).collect()
    assert got["text"] == brute_lines([(1, own)])[(1, own)] and got["n_removed"] > 20_000


def test_line_dedup_where_lines_share_a_hash(docs, monkeypatch):
    """The chunks with such lines are compared by their texts: nothing changes."""
    monkeypatch.setattr(linededup, "line_key", lambda line: F.xxhash64(line) % 50)
    left = brute_lines(texts_of(docs))
    assert sorted(texts_of(linededup.dedup_lines(docs))) == sorted((d, left[(d, t)]) for d, t in texts_of(docs) if left[(d, t)] is not None)


@pytest.mark.parametrize("lines", [1000, 1])
def test_line_dedup_keeps_chunks_that_share_a_hash(spark, monkeypatch, lines):
    """Of different chunks of one hash none goes, also where their lines share one."""
    monkeypatch.setattr(linededup, "chunk_key", lambda c: (F.size(c) * 0).cast("long"))
    monkeypatch.setattr(linededup, "line_key", lambda line: F.xxhash64(line) % lines)
    own = [(d, "\n".join(f"line {d % 3} {k}" for k in range(9))) for d in range(9)]
    assert sorted(texts_of(linededup.dedup_lines(spark.createDataFrame(own, "doc_id long, text string")))) == own


def brute_groups(prints, most=2):
    """prints: (doc_id, fingerprint) rows; the least doc_id that each reaches."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    u = np.array(distinct, dtype=np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= most):
            root[find(f)] = find(distinct[i + 1 + int(j)])
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=repr)


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    got = simhash.near_groups(df).collect()
    want = brute_groups([(d, brute_print(t)) for d, t in texts_of(df)])
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize("hot", [3, 64])
def test_simhash_links_of_dense_groups(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(60)}
    own = [(i, f) for i, f in enumerate(sorted(prints))]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in own], "fp long").repartition(5)
    rooted = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(simhash.links(df, hot=hot)).collect()}
    want = {f: c for (d, f), c in zip(own, [c for _, _, c in sorted(brute_groups(own), key=lambda r: r[0])], strict=True)}
    groups = collections.defaultdict(set)
    for d, f in own:
        groups[rooted.get(f, f)].add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 200)] + [(150, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 151


def test_one_of_each(odd, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = {(r["component_id"], None if r["component_id"] is not None else r["fp"]) for r in simhash.near_groups(odd).collect()}
    assert kept.count() == len(groups)
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_groups(empty).count() == 0


def test_quality_odd_rows(odd, empty):
    def brute(text):
        text = text or ""
        words = [w.decode() for w in text.encode().split()]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed

    got = quality.judge(odd).select(*quality.CONTRACT).collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, ((d, *brute(t)) for d, t in texts_of(odd))))
    assert not any(r["kept"] and r["base_failed"] for r in got) and quality.judge(empty).count() == 0


def test_media(docs, odd, empty):
    import hashlib

    for df in (docs, odd):
        got = media.store_and_read(df).collect()
        want = []
        for d, t in texts_of(df):
            raw = (t or "").encode()
            own = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            want.append((d, len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:])))
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
        by_payload = collections.defaultdict(set)
        for r in got:
            by_payload[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
        assert all(len(v) == 1 for v in by_payload.values())
    assert media.store_and_read(empty).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 64), dtype=np.uint8)
    lines = []
    for y in range(10):
        kind, row = y % 5, bytearray()
        for x in range(64):
            left, up = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0)
            corner = int(image[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row.append((int(image[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind]) + bytes(row))
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 10, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()
    for at in (0, 20, 60, len(png) - 6):
        bad = bytearray(png)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))


def test_cosine_hash_is_close_for_close_images():
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(0, 256, (40, 8)), np.ones((20, 8))).astype(np.uint8)
    near = image.copy()
    near[5, 5] ^= 7
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(image, near) <= 2 and bits(image, np.kron(rng.integers(0, 256, (40, 8)), np.ones((20, 8))).astype(np.uint8)) > 8
